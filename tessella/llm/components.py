"""Connected components of an undirected graph given as a table of links, never gathered in one place.

Each partition first reduces its links to stars by union-find; then alternating large and small stars (each node
points at the least node it knows) join the partitions' results until every link points straight at a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import table


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (p := up.get(at, at)) != at:
            at = p
        while (p := up.get(x, x)) != at:
            up[x], x = at, p
        return at

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, root): every node with a link to another, with the least node reachable.

    Links of a node to itself and repeated links are allowed; an empty table gives an empty result.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = table(pairs.mapInArrow(_stars, "a long, b long"), "stars")
    for _ in range(most_rounds):
        more = stars.select(F.col("b").alias("a")).join(stars.select("a"), "a", "left_semi").limit(1).count()
        many = 0 if more else stars.groupBy("a").count().where("count > 1").limit(1).count()
        if not more and not many:
            roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = table(small.unionByName(low.select("a", F.col("m").alias("b"))).mapInArrow(_stars, "a long, b long"), "stars")
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
