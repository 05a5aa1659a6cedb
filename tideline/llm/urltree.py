"""URL verdicts by rules and by a tree of path templates per host.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest fitting rule decides. Urls that no rule fits are
judged by the template that their path falls under. Templates are grown level by
level. Runs of digits in a segment become <n>. Below each node, segments are
merged into the wildcard * where the node has more than BRANCHES of them (they
vary) or where the urls that rules decided show no significant difference
(they are similar); a segment whose labelled purity differs stays a branch.

The urls that rules decided are the labels. A node's purity is the share of blocked
ones among the labels below it, smoothed towards its parent's purity: a host's
towards the whole table's, a template's towards its host's. A template without
labels thus has the purity of the nearest node above it that has some. Templates
whose purity is over REJECTED_ABOVE are rejected.

All work is on distinct (host, path shape) counts, aggregated before anything is
joined, so a host with a third of all pages costs no more than its distinct shapes.
A level is one segment up to SINGLE of them; the levels below take runs of 2, 4, 8
... segments, so a path of any depth generalises and needs few rounds.

Null urls and urls without :// have an empty host and path, and are judged as
any other. Very long urls and paths are taken whole. Repeated rows get the same
verdict. Of rules of equal length that fit, the first by text decides. An empty
table gives no rows. Extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import counted, durable

#: Fixed rules of the query: verdict, host and start of the path.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Segments that are a level each; below, levels take runs of 2, 4, 8 ... of them.
SINGLE = 6
BRANCHES = 16
SMOOTHING = 2.0
REJECTED_ABOVE = 0.8
Z = 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def longest_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule and its verdict for columns host and path; null where none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def levels(depth: int) -> list[tuple[int, int]]:
    """Which segments [from, to) each level of a tree of that depth takes."""
    out = [(i, i + 1) for i in range(min(depth, SINGLE))]
    width = 2
    while out and out[-1][1] < depth:
        out.append((out[-1][1], out[-1][1] + width))
        width *= 2
    return out


def _smoothed(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + SMOOTHING * towards) / (labelled + SMOOTHING)


def grow(shapes: DataFrame, depth: int, purity: float, branches: int = BRANCHES) -> DataFrame:
    """(host, shape, template, purity) of (host, shape, parts, labelled, blocked),
    whose parts are depth at most; purity: the whole table's."""
    hosts = shapes.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(purity)).alias("purity"))
    state = durable(shapes.join(hosts, "host").withColumn("template", F.lit("")), "templates")
    done = []
    for lo, hi in levels(depth):
        active = state.withColumn("seg", F.array_join(F.slice("parts", lo + 1, hi - lo), "/"))
        child = active.groupBy("host", "template", "seg", "purity").agg(F.sum("labelled").alias("cl"), F.sum("blocked").alias("cb"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("k"), F.count_if(F.col("cl") > 0).alias("kl"), F.sum("cl").alias("nl"), F.sum("cb").alias("nb"))
        pooled = F.col("nb") / F.greatest("nl", F.lit(1))
        gap = F.abs(F.col("cb") / F.greatest("cl", F.lit(1)) - pooled)
        similar = gap <= Z * F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) / F.greatest("cl", F.lit(1)))
        told = F.col("cl") > 0
        merged = F.when(F.col("k") > branches, ~told | similar).otherwise((F.col("kl") > 1) & told & similar)
        step = child.join(node, ["host", "template"]).withColumn("branch", F.when(merged, "*").otherwise(F.col("seg")))
        pure = step.groupBy("host", "template", "branch").agg(_smoothed(F.sum("cb"), F.sum("cl"), F.first("purity")).alias("below"))
        step = step.select("host", "template", "seg", "branch").join(pure, ["host", "template", "branch"])
        grown = active.join(step, ["host", "template", "seg"]).withColumns({"template": F.concat_ws("/", "template", "branch"), "purity": F.col("below")})
        written = durable(grown.select(state.columns), "templates")  # the next level reads it three times
        done.append(written.filter(F.size("parts") <= hi))
        state = written.filter(F.size("parts") > hi)
    return reduce(DataFrame.unionByName, done).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row."""
    rule, decided = longest_rule(rules)
    seen = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = seen.withColumns({"rule": rule, "decided": decided, "shape": F.regexp_replace("path", "[0-9]+", "<n>")})
    shapes = seen.groupBy("host", "shape").agg(F.count("decided").alias("labelled"), F.count_if(F.col("decided") == "block").alias("blocked"))
    shapes = shapes.withColumn("parts", F.split(F.regexp_replace("shape", "^/", ""), "/"))
    shapes, whole = counted(shapes, "shapes", labelled=F.sum("labelled"), blocked=F.sum("blocked"), depth=F.max(F.size("parts")))
    purity = ((whole["blocked"] or 0) + SMOOTHING * 0.5) / ((whole["labelled"] or 0) + SMOOTHING)
    leaves = grow(shapes, whole["depth"] or 1, purity)
    method = F.when(F.col("purity") > REJECTED_ABOVE, "block").otherwise("allow")
    return seen.join(leaves, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "template")


#: The SQL's tree has this many levels: paths of up to 20 segments.
SQL_LEVELS = 9


def judge_sql(rules: list[tuple[str, str]] = RULES) -> str:
    """The same as DuckDB SQL over the table pages."""

    def cases(value):
        out = []
        for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, path = text.partition("/")
            out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{value(kind, text)}'")
        return "CASE " + " ".join(out) + " END"

    def smoothed(blocked, labelled, towards):
        return f"({blocked} + {SMOOTHING}::DOUBLE * {towards}) / ({labelled} + {SMOOTHING}::DOUBLE)"

    ctes = [
        f"""cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, coalesce(strpos(url, '://') > 0, false) AS ok FROM pages),
parsed AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
seen AS (SELECT *, {cases(lambda k, t: t)} AS rule, {cases(lambda k, t: k)} AS decided, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape FROM parsed),
whole AS (SELECT {smoothed("count(*) FILTER (decided = 'block')", "count(decided)", "0.5::DOUBLE")} AS p FROM seen),
shapes AS (SELECT host, shape, string_split(regexp_replace(shape, '^/', ''), '/') AS parts, count(decided)::DOUBLE AS labelled, (count(*) FILTER (decided = 'block'))::DOUBLE AS blocked FROM seen GROUP BY ALL),
hosts AS (SELECT host, {smoothed("sum(blocked)", "sum(labelled)", "any_value(p)")} AS purity FROM shapes, whole GROUP BY host),
s0 AS (SELECT s.*, purity, '' AS template FROM shapes s JOIN hosts USING (host))"""
    ]
    for d, (lo, hi) in enumerate(levels(10**9)[:SQL_LEVELS]):
        ctes.append(f"""g{d} AS (SELECT *, CASE WHEN len(parts) > {lo} THEN array_to_string(parts[{lo + 1}:{hi}], '/') END AS seg FROM s{d}),
c{d} AS (SELECT host, template, seg, any_value(purity) AS purity, sum(labelled) AS cl, sum(blocked) AS cb FROM g{d} WHERE seg IS NOT NULL GROUP BY host, template, seg),
n{d} AS (SELECT *, count(*) OVER w AS k, count(*) FILTER (cl > 0) OVER w AS kl, sum(cb) OVER w / greatest(sum(cl) OVER w, 1) AS pooled FROM c{d} WINDOW w AS (PARTITION BY host, template)),
a{d} AS (SELECT *, cl > 0 AS told, abs(cb / greatest(cl, 1) - pooled) <= {Z} * sqrt(greatest(pooled * (1 - pooled), 0.01) / greatest(cl, 1)) AS alike FROM n{d}),
m{d} AS (SELECT *, CASE WHEN (CASE WHEN k > {BRANCHES} THEN NOT told OR alike ELSE kl > 1 AND told AND alike END) THEN '*' ELSE seg END AS branch FROM a{d}),
b{d} AS (SELECT host, template, branch, {smoothed("sum(cb)", "sum(cl)", "any_value(purity)")} AS purity FROM m{d} GROUP BY host, template, branch),
s{d + 1} AS (SELECT g.host, g.shape, g.parts, g.labelled, g.blocked, CASE WHEN g.seg IS NULL THEN g.purity ELSE b.purity END AS purity, CASE WHEN g.seg IS NULL THEN g.template ELSE g.template || '/' || m.branch END AS template FROM g{d} g LEFT JOIN m{d} m ON g.host = m.host AND g.template = m.template AND g.seg = m.seg LEFT JOIN b{d} b ON m.host = b.host AND m.template = b.template AND m.branch = b.branch)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT seen.page_id, seen.host, seen.path, seen.rule, coalesce(seen.decided, CASE WHEN l.purity > {REJECTED_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict, l.template
FROM seen JOIN s{SQL_LEVELS} l ON seen.host = l.host AND seen.shape = l.shape"""
