"""Causal graphs as node and edge tables, model documents, and lineage.

Reachability is computed in rounds of one join each; a round's new pairs are what
the next one extends, so cycles end and depth has no limit.
"""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.session import saved


def reachable(edges: DataFrame, start: DataFrame, without: list[str] | None = None) -> DataFrame:
    """(root, node): all nodes that each root (column node of start) reaches along
    edges (cause, effect), itself included. without: nodes that no path enters."""
    step = edges.select("cause", "effect").distinct()
    if without:
        step = step.filter(~F.col("cause").isin(without) & ~F.col("effect").isin(without))
    found, n = saved(start.select(F.col("node").alias("root"), "node").distinct())
    step, _ = saved(step)
    fresh = found
    while n:
        onward = fresh.join(step, F.col("node") == F.col("cause")).select("root", F.col("effect").alias("node")).distinct()
        fresh, n = saved(onward.join(found, ["root", "node"], "left_anti"))
        found = found.union(fresh)
    return found


def ancestors(edges: DataFrame, outcome: str) -> DataFrame:
    """(node): everything with a path to the outcome."""
    back = edges.select(F.col("effect").alias("cause"), F.col("cause").alias("effect"))
    start = edges.sparkSession.createDataFrame([(outcome,)], "node string")
    return reachable(back, start).filter(F.col("node") != outcome).select("node")


def unrolled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two time slices (cause, cause_slice, effect, effect_slice):
    within slices, lagged edges across, and each varying node to its next self."""
    within = edges.filter("NOT lagged")
    slices = F.explode(F.array(F.lit(0), F.lit(1))).alias("slice")
    same = within.select("cause", "effect", slices).select("cause", F.col("slice").alias("cause_slice"), "effect", F.col("slice").alias("effect_slice"))
    across = edges.filter("lagged").select("cause", F.lit(0).alias("cause_slice"), "effect", F.lit(1).alias("effect_slice"))
    carry = nodes.filter("varying").select(F.col("node").alias("cause"), F.lit(0).alias("cause_slice"), F.col("node").alias("effect"), F.lit(1).alias("effect_slice"))
    return same.union(across).union(carry)


def flattened(slices: DataFrame) -> DataFrame:
    """(cause, effect) of unrolled edges, with the slice in the name: x@0, x@1."""
    at = lambda n: F.concat(F.col(n), F.lit("@"), F.col(f"{n}_slice").cast("string")).alias(n)
    return slices.select(at("cause"), at("effect"))


def latent_confounders(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """(node, children): unobserved nodes with two observed children or more."""
    hidden = edges.join(observed.select(F.col("node").alias("cause")), "cause", "left_anti")
    seen = hidden.join(observed.select(F.col("node").alias("effect")), "effect", "left_semi")
    return seen.groupBy(F.col("cause").alias("node")).agg(F.countDistinct("effect").alias("children")).filter("children >= 2")


def blocking_confounders(edges: DataFrame, observed: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(node): unobserved ancestors of the treatment that reach the outcome on a path
    past the treatment and have an observed child."""
    before = ancestors(edges, treatment)
    other = ancestors(edges.filter((F.col("cause") != treatment) & (F.col("effect") != treatment)), outcome)
    child = edges.join(observed.select(F.col("node").alias("effect")), "effect", "left_semi").select(F.col("cause").alias("node")).distinct()
    return before.join(other, "node").join(child, "node", "left_semi").join(observed, "node", "left_anti").distinct()


def instruments(edges: DataFrame, observed: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(node): observed parents of the treatment that, once all edges into it are cut,
    neither reach the outcome nor descend from one of its ancestors (the treatment
    itself, as a rule, is one)."""
    cut = edges.filter(F.col("effect") != treatment)
    parents = edges.filter(F.col("effect") == treatment).select(F.col("cause").alias("node")).distinct()
    other = ancestors(cut, outcome)
    below = reachable(cut, other).select("node").distinct()
    return parents.join(observed.select("node"), "node", "left_semi").join(other, "node", "left_anti").join(below, "node", "left_anti")


#: How well a type's loading fixes a construct's scale.
ANCHOR_TIERS = {"continuous": 0, "ordinal": 1, "binary": 2, "count": 2, "categorical": 3}


def reference_indicators(indicators: DataFrame) -> DataFrame:
    """(node, indicator): each construct's best indicator by type, sign and order."""
    tier = F.create_map(*[F.lit(x) for kv in ANCHOR_TIERS.items() for x in kv])[F.col("dtype")]
    key = F.struct(tier, F.when(F.col("positive"), 0).otherwise(1), "position")
    return indicators.groupBy("node").agg(F.min_by("indicator", key).alias("indicator"))


def pruned(nodes: DataFrame, edges: DataFrame, outcome: str) -> DataFrame:
    """(cause, effect): edges between the outcome's ancestors and itself."""
    kept = ancestors(edges, outcome).union(nodes.sparkSession.createDataFrame([(outcome,)], "node string"))
    ends = edges.join(kept.select(F.col("node").alias("cause")), "cause", "left_semi")
    return ends.join(kept.select(F.col("node").alias("effect")), "effect", "left_semi").select("cause", "effect")


def induced_dependencies(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """(left, right): pairs of children of one hidden root."""
    roots = hidden.join(edges.select(F.col("effect").alias("node")), "node", "left_anti")
    kids = edges.join(roots.select(F.col("node").alias("cause")), "cause", "left_semi")
    a, b = kids.select("cause", F.col("effect").alias("left")), kids.select("cause", F.col("effect").alias("right"))
    return a.join(b, "cause").filter("left < right").select("left", "right").distinct()


def observed_constructs(nodes: DataFrame, indicators: DataFrame) -> DataFrame:
    """(node) of nodes (node, role): inputs, and those that an indicator measures."""
    return nodes.join(indicators.select("node").distinct().withColumn("__has", F.lit(True)), "node", "left").filter("role = 'exogenous' OR __has").select("node")


def redundant_coefficients(terms: list[dict[str, int]]) -> list[tuple[str, ...]]:
    """Groups of parameters that enter a model only through fewer products than there
    are parameters; terms: of each term, its parameters with their powers. The rank
    of the powers is found over exact fractions."""
    rows = [{k: Fraction(v) for k, v in t.items() if v} for t in terms]
    group: dict[str, str] = {k: k for r in rows for k in r}

    def root(k: str) -> str:
        while group[k] != k:
            k = group[k]
        return k

    for r in rows:
        names = sorted(r)
        for k in names[1:]:
            group[root(k)] = root(names[0])
    members: dict[str, list[str]] = {}
    for k in sorted(group):
        members.setdefault(root(k), []).append(k)
    found = []
    for names in members.values():
        left, rank = [[r.get(k, Fraction(0)) for k in names] for r in rows if set(r) & set(names)], 0
        for c in range(len(names)):
            pivot = next((r for r in left if r[c]), None)
            if pivot is None:
                continue
            rank += 1
            left = [[x - r[c] / pivot[c] * y for x, y in zip(r, pivot)] for r in left if r is not pivot]
        if len(names) > 1 and rank < len(names):
            found.append(tuple(names))
    return sorted(found)


# ---- lineage --------------------------------------------------------------------


def stale(derived: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): everything derived (artifact, source) from what changed."""
    edges = derived.select(F.col("source").alias("cause"), F.col("artifact").alias("effect"))
    return reachable(edges, changed).filter("root <> node").select("node").distinct()


def dependencies(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(seq, source): which earlier action first produced what an action reads."""
    first = outputs.groupBy("revision").agg(F.min("seq").alias("source"))
    return inputs.join(first, "revision").filter("source < seq").select("seq", "source").distinct()


def latest(records: DataFrame, key: str) -> DataFrame:
    """Last write of each key by seq."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*")


def law_origins(models: DataFrame, laws: DataFrame, asked: DataFrame) -> DataFrame:
    """(revision, origin, fitted_revision) of models (revision, parent, produced_by)
    and laws (revision, law, value, uncertain): the nearest ancestor that a fit made
    and that shares an uncertain law of the asked revision decides. It is fitted if all
    uncertain laws, and no other, stem from it; mixed if some do; authored if none."""
    parents = models.filter("parent IS NOT NULL").select(F.col("revision").alias("cause"), F.col("parent").alias("effect"))
    above = reachable(parents, asked.select(F.col("revision").alias("node"))).select(F.col("root").alias("revision"), F.col("node").alias("ancestor"))
    depth = reachable(parents, models.select(F.col("revision").alias("node"))).groupBy("root").agg(F.count("*").alias("depth"))
    fits = above.join(models.filter("produced_by = 'fit'").select(F.col("revision").alias("ancestor")), "ancestor")
    mine = laws.select("revision", "law", "value", "uncertain")
    theirs = laws.select(F.col("revision").alias("ancestor"), "law", F.col("value").alias("fitted"))
    both = fits.join(mine, "revision").join(theirs, ["ancestor", "law"], "left")
    same = F.col("value").eqNullSafe(F.col("fitted"))
    score = both.groupBy("revision", "ancestor").agg(F.count_if(F.col("uncertain") & same).alias("inherited"), F.count_if("uncertain").alias("uncertain"), F.count_if(~F.col("uncertain") & ~same).alias("edited"))
    near = score.filter("inherited > 0").join(depth.withColumnRenamed("root", "ancestor"), "ancestor").groupBy("revision").agg(F.max_by(F.struct("ancestor", "inherited", "uncertain", "edited"), "depth").alias("f"))
    whole = (F.col("f.inherited") == F.col("f.uncertain")) & (F.col("f.edited") == 0)
    origin = F.when(F.col("f").isNull(), "authored").when(whole, "fitted").otherwise("mixed")
    return asked.select("revision").join(near, "revision", "left").select("revision", origin.alias("origin"), F.col("f.ancestor").alias("fitted_revision"))


def evicted(files: DataFrame, oldest, most_bytes: int) -> DataFrame:
    """(path, reason) of files (path, modified, size) that go: those before
    `oldest`, then the oldest until the rest fits."""
    w = Window.orderBy(F.desc("modified"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    young = files.filter(F.col("modified") >= oldest).withColumn("total", F.sum("size").over(w))
    old = files.filter(F.col("modified") < oldest).select("path", F.lit("age").alias("reason"))
    return old.union(young.filter(F.col("total") > most_bytes).select("path", F.lit("size").alias("reason")))


# ---- documents --------------------------------------------------------------------


def flatten(document: dict, at: str = "") -> dict[str, str]:
    """Leaves of a nested document by path, as JSON; an empty dict is a leaf."""
    out: dict[str, str] = {}
    for k, v in document.items():
        path = f"{at}/{k}"
        out |= flatten(v, path) if isinstance(v, dict) and v else {path: json.dumps(v, sort_keys=True)}
    return out


#: Fixed names of the fields whose entries are known by their ids.
ENTITY_MAPS = {"constructs", "edges", "parameters", "dynamics", "mechanisms", "indicators", "distributions", "law_layouts", "labels"}


def _starts_anew(old: dict, new: dict) -> bool:
    """Whether new is another alternative: of another kind or, if it names a family
    and doesn't refer to a stored law, of another distribution."""
    tags = ["kind"]
    if isinstance(family := new.get("distribution"), str) and not family.startswith("distribution:"):
        tags.append("distribution")
    return any(t in new and new[t] != old.get(t) for t in tags)


def merge(document: dict, patch: dict) -> dict:
    """The patched document. In a map of entities null deletes an entry; elsewhere
    null is a value like any other. Another alternative replaces the old one whole."""
    out = {} if _starts_anew(document, patch) else dict(document)
    for name, new in patch.items():
        old = out[name] if isinstance(out.get(name), dict) else {}
        if not isinstance(new, dict):
            out[name] = new
        elif name in ENTITY_MAPS:
            changed = {k: merge(old[k] if isinstance(old.get(k), dict) else {}, v) if isinstance(v, dict) else v for k, v in new.items()}
            out[name] = {k: v for k, v in (old | changed).items() if v is not None}
        else:
            out[name] = merge(old, new)
    return out


def diff(before: dict, after: dict) -> dict:
    """The patch with merge(before, patch) == after, for documents that have the same
    ordinary fields: a patch can set such a field to null, but not take it away."""
    base = {} if _starts_anew(before, after) else before
    out: dict = {}
    for name in sorted(after):
        old, new = base.get(name), after[name]
        if name in base and old == new:
            continue
        if not (isinstance(old, dict) and isinstance(new, dict)):
            out[name] = new
        elif name in ENTITY_MAPS:
            out[name] = {k: None for k in sorted(old.keys() - new.keys())}
            for k in sorted(new):
                if k not in old or old[k] != new[k]:
                    both = isinstance(old.get(k), dict) and isinstance(new[k], dict)
                    out[name][k] = diff(old[k], new[k]) if both else new[k]
        else:
            out[name] = diff(old, new)
    return out


def _named(value) -> set[str]:
    """All texts in a document's values."""
    if isinstance(value, dict):
        return set().union(*map(_named, value.values()))
    if isinstance(value, list):
        return set().union(*map(_named, value))
    return {value} if isinstance(value, str) else set()


def without_orphans(model: dict) -> dict:
    """The model without edges and indicators of constructs that it doesn't have, and
    without parameters, distributions and layouts that nothing names any more."""
    out, constructs = dict(model), set(model.get("constructs") or {})
    for name, ends in (("edges", ("cause", "effect")), ("indicators", ("construct",))):
        if isinstance(out.get(name), dict):
            out[name] = {k: v for k, v in out[name].items() if all(v.get(e) in constructs for e in ends if e in v)}
    while True:
        before = {k: len(out[k]) for k in ("parameters", "distributions", "law_layouts") if isinstance(out.get(k), dict)}
        for name in before:
            others = set().union(*(_named(v) for k, v in out.items() if k != name), *(_named(v) - {k} for k, v in out[name].items()))
            if name == "law_layouts":
                others |= set(out.get("distributions") or {})
            out[name] = {k: v for k, v in out[name].items() if k in others}
        if before == {k: len(out[k]) for k in before}:
            return out


def content_hash(document: dict) -> str:
    """SHA-256 of the document's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, before, after) of leaves (path, value) that differ."""
    both = before.select("path", F.col("value").alias("before")).join(after.select("path", F.col("value").alias("after")), "path", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))
