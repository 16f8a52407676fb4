"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Up to so many links one task joins them (some 200 bytes each); more go through rounds of stars.
FEW_LINKS = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, v) of every node but the least of each component, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        kind = None

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            kind = batch.schema
            plain = [[tuple(x.values()) if isinstance(x, dict) else x for x in c.to_pylist()] for c in batch.columns]
            for a, b in zip(*plain):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        out = [(x, top) for x in list(parent) if (top := find(x)) != x]
        if out:
            names = [f.name for f in kind.field(0).type] if pa.types.is_struct(kind.field(0).type) else None
            back = lambda x: dict(zip(names, x)) if names else x
            yield pa.RecordBatch.from_arrays([pa.array([back(r[i]) for r in out], kind.field(i).type) for i in (0, 1)], ["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v, distinct). Neighbourhood minima come from a partial aggregate and a join, so a hub is no single group."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:  # larger neighbours go to the least one
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u > v").distinct()
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another: component is the least node that it reaches.

    edges: two columns of one ordered type (whole numbers, or structs of them). Large and small stars in turn until nothing changes
    (a logarithmic number of rounds in practice); each round is written to the shared folder.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "edges")
    seen = None
    few = now.count() <= FEW_LINKS
    if few:
        now = materialize(_in_one_task(now), "edges")
    for _ in range(0 if few else rounds):
        now = materialize(_stars(_stars(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if not few:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
