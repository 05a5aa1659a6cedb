"""Near-duplicates by an inverted join over MinHash signature coordinates.

Every document's signature has COORDINATES minima of its word shingles. Documents
with equal shingle sets form a class and are handled once. A class is posted
under its coordinate-value pairs, rarest pair first, and only under a prefix:
two signatures with MATCHES or more equal coordinates share COLLISIONS postings
or more in their prefixes, so pairs that collide less often are skipped. Pairs
whose signatures agree in MATCHES places are confirmed on full shingle sets.

Lists of more than LONG_LIST classes aren't expanded into pairs; for their members
collisions are counted on whole signatures. There one shared posting is enough, which
a shorter prefix grants; so such lists only hold postings of that one. First every member is compared with the
list's most central class, its hub. Members whose
signatures match the hub's are then described by how their sets differ from the
hub's, which is little, and which gives the exact overlap of any two of them. Only
members that are still in different components are compared with each other, block
by block: by these differences if both have the same hub, else by signatures, each
pair in one of its lists. So a large group of near copies costs a comparison per
member, and no member is left out.

A pair at the threshold has 48 coordinates that agree with probability 0.8 each;
fewer than 24 agree with probability 8e-7, and less for more similar pairs. That
is the chance to lose a link; confirmed links are exact up to 64-bit hashes.

Texts without words are linked with nothing. Rows with a null id are linked with
nothing and kept. Very long texts are hashed whole, one at a time. Repeated rows
and ties fall into one class, named by its smallest id. An empty table gives no
rows. Extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import counted, dealt, discard, durable, groups_for, wanted_only
from tideline.llm.components import components
from tideline.llm.fingerprints import minima
from tideline.llm.textbatch import TextBatch, chunks, mix, release, shingle_sets

COORDINATES = 48
MATCHES = 24
COLLISIONS = 4
LONG_LIST = 50
BLOCK = 512
GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """Links need 100 * |intersection| >= percent * |union| of k-word shingles."""

    words: int = 5
    percent: int = 80

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    b = TextBatch(texts, lower=True)
    b.split_words()
    return shingle_sets(b, words)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature); set_a and set_b name the set."""

    def run(batches):
        for batch in chunks(batches):
            sets = sets_of(batch.column("text").to_pylist(), rule.words)
            sizes = np.array([len(s) for s in sets], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            low = (minima(flat, starts, len(sets), COORDINATES, 11) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            name = []
            for seed in (3, 4):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat, seed), dtype=np.uint64)))
                name.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *map(pa.array, name), pa.array(list(low), pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>")


def group_of(node: int, groups: int) -> int:
    return zlib.crc32(str(node).encode()) % groups


def group_column(column: str, groups: int):
    return (F.crc32(F.col(column).cast("string").cast("binary")) % groups).cast("int")


def _tokens(table: pa.Table) -> np.ndarray:
    """n x COORDINATES keys of coordinate-value pairs."""
    sig = table.column("signature").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, COORDINATES)
    return mix(sig.astype(np.uint64) | np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32), 9)


_POSTED = "h long, node long, long_lists int, central double, frequency int, coordinate int, first boolean, posted_long array<long>"


def post(classes: DataFrame, groups: int) -> DataFrame:
    """Prefix postings of classes (node, signature) under pairs that others share."""
    placed = dealt(classes.select("node", "signature", group_column("node", groups).alias("__p")), "__p", groups)

    def count(key, t):
        h, n = np.unique(_tokens(t), return_counts=True)
        release()
        return pa.table({"h": h.view(np.int64), "p": np.full(len(h), key[0].as_py(), np.int32), "n": n.astype(np.int64)})

    counts = placed.groupBy("__p").applyInArrow(count, "h long, p int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.collect_list("p").alias("ps"))
    shared = counts.filter("n > 1").select(F.explode("ps").alias("__p"), "h", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))
    prefix = COORDINATES - MATCHES + COLLISIONS

    def choose(key, t, known):
        tokens = _tokens(t) if t.num_rows else np.empty((0, COORDINATES), np.uint64)
        node = t.column("node").to_numpy() if t.num_rows else np.empty(0, np.int64)
        freq = np.ones(tokens.shape, np.int64)
        if known.num_rows:
            kh, kn = known.column("h").to_numpy().view(np.uint64), known.column("n").to_numpy()
            by = np.argsort(kh)
            kh, kn = kh[by], kn[by]
            at = np.minimum(np.searchsorted(kh, tokens), len(kh) - 1)
            freq = np.where(kh[at] == tokens, kn[at], 1)
        order = np.lexsort((tokens, freq))
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(COORDINATES), order.shape), 1)
        chosen = (rank < prefix) & (freq > 1)
        far = chosen & (freq > LONG_LIST)
        first = far & (rank <= COORDINATES - MATCHES)
        central = np.log(freq).sum(1)
        marked = np.where(first, tokens, 0).view(np.int64)
        r, c = np.nonzero(chosen)
        del order, rank
        release()
        return pa.table({
            "h": tokens[r, c].view(np.int64), "node": node[r], "long_lists": far.sum(1)[r].astype(np.int32), "central": central[r],
            "frequency": freq[r, c].astype(np.int32), "coordinate": c.astype(np.int32), "first": first[r, c],
            "posted_long": pa.array([marked[i] if f else None for i, f in zip(r, first[r, c])], pa.list_(pa.int64())),
        })

    return placed.groupBy("__p").cogroup(dealt(shared, "__p", groups).groupBy("__p")).applyInArrow(choose, _POSTED)


def short_list_pairs(posted: DataFrame) -> DataFrame:
    """(a, b) that collide often enough in lists of at most LONG_LIST classes."""
    lists = posted.filter(F.col("frequency") <= LONG_LIST).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("node", "long_lists"))).alias("m"))
    pairs = lists.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, greatest(size(m) - i - 1, 0)), y -> struct(x.node AS a, y.node AS b, least(x.long_lists, y.long_lists) AS elsewhere))))"
    )).alias("q")).select("q.*")
    return pairs.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("elsewhere").alias("elsewhere")).filter(F.col("n") + F.col("elsewhere") >= COLLISIONS).select("a", "b")


def pivots(long_posted: DataFrame) -> DataFrame:
    """(h, hub): the most central class of each long list."""
    return long_posted.groupBy("h").agg(F.max(F.struct("central", "node")).alias("top")).select("h", F.col("top.node").alias("hub"))


def pivot_pairs(long_posted: DataFrame) -> DataFrame:
    """(a, b): each member b of a long list with the list's hub a."""
    members = long_posted.select("h", F.col("node").alias("b"))
    return members.join(pivots(long_posted), "h").filter("hub <> b").select(F.col("hub").alias("a"), "b").distinct()


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in MATCHES coordinates or more."""
    sig = classes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return both.filter(F.expr(f"size(filter(zip_with(sa, sb, (x, y) -> x = y), e -> e)) >= {MATCHES}")).select("a", "b", "hub")


class Confirmer:
    """Confirms requested pairs on full shingle sets. Texts that a request names are
    dealt to groups by id; a request's first set travels once to each group that
    holds partners."""

    def __init__(self, docs: DataFrame, rule: Rule):
        self.rule, self.groups = rule, groups_for(docs, "text", GROUP_BYTES)
        self.docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")

    def requests(self, pairs: DataFrame) -> DataFrame:
        """(a, q, hub, bs, cs) of pairs (a, b, hub); every partner may be linked
        (no cs). hub: a is the hub of b, and their difference is asked for."""
        placed = pairs.select("a", "b", "hub", group_column("b", self.groups).alias("q"))
        return placed.groupBy("a", "q", "hub").agg(F.collect_list("b").alias("bs")).select("a", "q", "hub", "bs", F.lit(None).cast("array<long>").alias("cs"))

    def answers(self, requests: DataFrame) -> DataFrame:
        """(a, b, linked, hub_size, missing, difference): the linked pairs (of
        partners with the same number in cs one is enough), and all pairs with a
        hub, with the hub's set size, how many of it b lacks, and which shingles
        only one of both has."""
        rule = self.rule

        def sets(t: pa.Table, wanted: set[int]) -> dict[int, list[np.ndarray]]:
            if not t.num_rows or not wanted:
                return {}
            rows = t.filter(pa.compute.is_in(t.column("doc_id"), pa.array(sorted(wanted), pa.int64())))
            out: dict[int, list[np.ndarray]] = {}
            for batch in chunks(rows.combine_chunks().to_batches()):
                for i, s in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text").to_pylist(), rule.words)):
                    if len(s):
                        out.setdefault(i, []).append(s)
            return out  # chunks() releases memory at its end

        def send(key, t, asked):
            rows = asked.to_pylist() if asked.num_rows else []
            have = sets(t, {r["a"] for r in rows})
            sent = [(r["q"], r["a"], r["hub"], s.tobytes(), r["bs"], r["cs"]) for r in rows for s in have.get(r["a"], ())]
            columns = list(zip(*sent)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["q", "a", "hub", "shingles", "bs", "cs"])

        def confirm(key, t, sent):
            rows = sent.to_pylist() if sent.num_rows else []
            have = sets(t, {b for r in rows for b in r["bs"]})
            found = []
            for r in rows:
                s, done = np.frombuffer(r["shingles"], np.uint64), set()
                for i, b in enumerate(r["bs"]):
                    c = r["cs"][i] if r["cs"] else b
                    for x in have.get(b, ()):
                        linked = c not in done and rule.linked(s, x)
                        if linked:
                            done.add(c)
                        if r["hub"]:
                            found.append((r["a"], b, linked, len(s), len(np.setdiff1d(s, x, True)), np.setxor1d(s, x, True).tobytes()))
                        elif linked:
                            found.append((r["a"], b, True, None, None, None))
            columns = list(zip(*found)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            release()
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "linked", "hub_size", "missing", "difference"])

        ids = requests.select(F.col("a").alias("id")).union(requests.select(F.explode("bs")))
        texts = dealt(wanted_only(self.docs, "doc_id", ids).withColumn("__p", group_column("doc_id", self.groups)), "__p", self.groups).groupBy("__p")
        asked = dealt(requests.select("a", "q", "hub", "bs", "cs", group_column("a", self.groups).alias("__p")), "__p", self.groups)
        sent = texts.cogroup(asked.groupBy("__p")).applyInArrow(send, "q int, a long, hub boolean, shingles binary, bs array<long>, cs array<long>")
        sent = dealt(sent.withColumnRenamed("q", "__p"), "__p", self.groups)
        return texts.cogroup(sent.groupBy("__p")).applyInArrow(confirm, "a long, b long, linked boolean, hub_size long, missing long, difference binary")


def block_pairs(rows: DataFrame, labels: DataFrame, by: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(*by, s1, s2, m1, m2), and the table that it reads: pairs of blocks of about BLOCK rows (node, *payload)
    of one group that aren't of one component both; s1 = s2 is a block with itself.
    Members of a component share blocks, as far as it isn't larger than a block."""
    named = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy(*by, "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    slot = F.struct(
        F.pmod(F.xxhash64("component"), F.ceil(F.col("total") / BLOCK)).alias("x"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("y"),
    )
    placed = named.join(groups, by).join(sizes, [*by, "component"]).withColumn("slot", slot)
    blocks = durable(
        placed.groupBy(*by, "slot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.collect_list(F.struct("node", "component", *payload)).alias("members")),
        "blocks",
    )
    left = blocks.select(*by, F.col("slot").alias("s1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    right = blocks.select(*by, F.col("slot").alias("s2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    pairs = left.join(right, by).filter("s1 <= s2 AND NOT (l1 = h1 AND l2 = h2 AND l1 = l2)").select(*by, "s1", "s2")
    members = blocks.select(*by, "slot", "members")
    whole = pairs.join(members.withColumnsRenamed({"slot": "s1", "members": "m1"}), [*by, "s1"]).join(members.withColumnsRenamed({"slot": "s2", "members": "m2"}), [*by, "s2"])
    return whole, blocks


#: Shingles that hub_links() counts at a time.
COLUMNS = 4096


def hub_links(left: pa.StructArray, right: pa.StructArray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes of two blocks (node, component, hub_size, missing, difference) of one
    hub, one link for two components. Shared shingles are counted in slices, so their
    number doesn't count for memory."""

    def arrays(members):
        numbers = [members.field(c).to_numpy() for c in ("node", "component", "hub_size", "missing")]
        diffs = members.field("difference")
        sizes = pa.compute.binary_length(diffs).to_numpy().astype(np.int64) // 8
        return *numbers, sizes, np.repeat(np.arange(len(members)), sizes), np.frombuffer(b"".join(diffs.to_pylist()), np.uint64)

    (n1, c1, h1, m1, d1, r1, x1), (n2, c2, _, m2, d2, r2, x2) = arrays(left), arrays(right)
    shared = np.intersect1d(x1, x2)
    both = h1[:, None] - m1[:, None] - m2
    for lo in range(0, len(shared), COLUMNS):
        part, sides = shared[lo : lo + COLUMNS], []
        for n, r, x in ((len(n1), r1, x1), (len(n2), r2, x2)):
            at = np.minimum(np.searchsorted(part, x), len(part) - 1)
            hit = part[at] == x
            side = np.zeros((n, len(part)), np.float32)
            side[r[hit], at[hit]] = 1
            sides.append(side)
        both += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    size1, size2 = h1 - m1 + (d1 - m1), h1[0] - m2 + (d2 - m2)
    i, j = np.nonzero((100 * both >= rule.percent * (size1[:, None] + size2 - both)) & (c1[:, None] != c2))
    _, one = np.unique(np.stack((c1[i], c2[j])), axis=1, return_index=True)
    return n1[i[one]], n2[j[one]]


def within_hubs(answers: DataFrame, labels: DataFrame, rule: Rule) -> tuple[DataFrame, int]:
    """Links (a, b), and their number, between members of a hub in different components,
    exactly, from their differences to the hub; one for two components of two blocks."""
    rows = answers.filter("difference IS NOT NULL").select(F.col("a").alias("hub"), F.col("b").alias("node"), "hub_size", "missing", "difference")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = hub_links(batch.column("m1")[k].values, batch.column("m2")[k].values, rule)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            del batch
        release()

    both, blocks = block_pairs(rows, labels, ["hub"], ["hub_size", "missing", "difference"])
    links, seen = counted(both.select("m1", "m2").mapInArrow(run, "a long, b long"), "hub-links", n=F.count("*"))
    discard(blocks)
    return links, seen["n"]


def across_components(long_posted: DataFrame, classes: DataFrame, answers: DataFrame, labels: DataFrame, groups: int) -> tuple[DataFrame, int]:
    """Requests, and their number, for pairs of a long list in different components whose signatures
    match, but for those that within_hubs has compared."""
    compared = answers.filter("difference IS NOT NULL").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("hubbed"))
    listed = long_posted.join(pivots(long_posted), "h").join(compared, ["hub", "node"], "left")
    listed = listed.withColumn("hubbed", F.coalesce("hubbed", F.col("hub") == F.col("node"))).drop("hub")
    both, blocks = block_pairs(listed.join(classes.select("node", "signature"), "node"), labels, ["h", "coordinate"], ["signature", "posted_long", "hubbed"])

    def arrays(members):
        wide = [members.field(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("signature", "posted_long")]
        return members.field("node").to_numpy(), members.field("component").to_numpy(), *wide, members.field("hubbed").to_numpy(zero_copy_only=False)

    def request(coordinate, same_slot, left, right):
        (na, ca, sa, ta, ha), (nb, cb, sb, tb, hb) = arrays(left), arrays(right)
        out: dict[tuple[int, int], tuple[list, list]] = {}
        for i in range(len(na)):
            # Each pair once: in blocks of the same slot, and in the first list that both are posted in.
            at = np.flatnonzero((cb != ca[i]) & ~(hb & ha[i]) & ((sb == sa[i]).sum(1) >= MATCHES))
            if same_slot:
                at = at[nb[at] > na[i]]
            same = (tb[at] == ta[i]) & (ta[i] != 0)
            for j in at[same.argmax(1) == coordinate].tolist():
                bs, cs = out.setdefault((int(na[i]), group_of(int(nb[j]), groups)), ([], []))
                bs.append(int(nb[j]))
                cs.append(int(cb[j]))
        columns = [[k[0] for k in out], [k[1] for k in out], [False] * len(out), [v[0] for v in out.values()], [v[1] for v in out.values()]]
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "q", "hub", "bs", "cs"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                coordinate, s1, s2 = (batch.column(c)[k].as_py() for c in ("coordinate", "s1", "s2"))
                yield request(coordinate, s1 == s2, batch.column("m1")[k].values, batch.column("m2")[k].values)
            del batch
        release()

    asked = both.select("coordinate", "s1", "s2", "m1", "m2").mapInArrow(run, "a long, q int, hub boolean, bs array<long>, cs array<long>")
    requests, seen = counted(asked, "requests", n=F.count("*"))
    discard(blocks)
    return requests, seen["n"]


def cluster(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the
    smallest id that links reach; kept tells that it is the row's own."""
    rows = durable(signatures(docs, rule), "signatures")
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, seen = counted(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes", n=F.count("*"))
    posted = durable(post(classes, seen["n"] // 5_000 + 1), "postings")
    long_posted = posted.filter("first")
    confirmer = Confirmer(docs, rule)
    hubs = pivot_pairs(long_posted).withColumn("hub", F.lit(True))
    pairs = short_list_pairs(posted).withColumn("hub", F.lit(False)).union(hubs)
    asked = durable(confirmer.requests(matching(pairs, classes)), "pairs")
    answers = durable(confirmer.answers(asked), "confirmed")
    labels = components(answers.filter("linked").select("a", "b"))
    more, n_more = within_hubs(answers, labels, rule)
    rest, n_rest = across_components(long_posted, classes, answers, labels, confirmer.groups)
    discard(posted, asked, answers)
    if n_rest:
        # Written first: components() runs Python too, and a task holds a worker for each operator.
        more = more.union(durable(confirmer.answers(rest).select("a", "b"), "confirmed-rest"))
    if n_more or n_rest:
        labels = components(labels.toDF("a", "b").union(more))
    by_class = classes.select("set_a", "set_b", "node").join(labels, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("shared"))
    out = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("shared"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs that are kept: of each group of near copies that with the
    smallest id. Rows with a null id stay; rows that share an id stay or go together."""
    gone = cluster(docs, rule).filter("NOT kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(docs.columns)


def cluster_sql(rule: Rule = Rule(), upper: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> str:
    """The same as DuckDB SQL over the table documents, for unique ids: all pairs that
    share a shingle, and all nodes that each can reach."""
    k = rule.words
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON a = m.doc_id JOIN n o ON b = o.doc_id WHERE 100 * common >= {rule.percent} * (m.n + o.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM d JOIN c ON doc_id = id LEFT JOIN n USING (doc_id)"""
