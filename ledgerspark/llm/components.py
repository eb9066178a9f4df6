"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> one row (node, root) per node that has an edge.

    root is the smallest node of the component. Each round applies the
    large-star and the small-star step (Kiveris et al., "Connected Components
    in MapReduce and Beyond"); the rounds needed grow with the logarithm of the
    node count. Both steps take a node's minimum by aggregation, which combines
    before the shuffle, so a hub's neighbours are never gathered in one row.
    Self edges and edges with a null end are ignored; repeated edges count once.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v and a is not null and b is not null")
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = written(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"no stable components after {max_rounds} rounds")
