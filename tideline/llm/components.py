"""Connected components of a table of links by alternating stars.

Each task first replaces the links that it reads by stars, which keeps what they
join and shortens all paths. Then large-star hands every node's larger neighbours
to its least neighbour, small-star its smaller ones, until nothing changes. Each
round is written to the shared folder, so neither links nor components reach the
driver, and the round before is deleted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import counted, discard
from tideline.llm.textbatch import release

#: Links that a task holds before it passes on their stars.
HELD = 500_000


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """The edges on disk, with their number and a sum of their hashes."""
    return counted(edges, label, n=F.count("*"), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def _stars(batches):
    """(u, v) with u > v that join the same nodes as the links, as stars."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def passed_on():
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield passed_on()
    yield passed_on()
    release()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in a link (columns a, b of longs);
    component is the least node that can be reached."""
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, state = _written(ends.mapInArrow(_stars, "u long, v long"), "links")
    while state["n"]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, before = edges, state
        edges, state = _written(small.filter("u <> v").distinct(), "stars")
        discard(old)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
