"""Map layers: the ways of a relation joined to rings and chains, by list ranking.

Each way is two nodes, one for either direction. A node's successor is the one way that goes on where it ends; where none or several
do, the line ends. A relation of up to POINTS points is ranked in its group, by following the successors. In larger ones pointer jumping (each round doubles how far a pointer reaches) finds every node's last node and how far it is, so a line of
n ways takes log n joins and no task holds more than one line's points. Rings have no end: what still has a successor when
pointers reach past the longest relation lies on one, and is cut open at its least node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .shapes import simplify

#: Points of a relation that is ranked in its group; larger ones are ranked by all executors, in rounds that are written.
POINTS = 1_048_576


def _followed(group: pa.Table) -> pa.Table:
    """One relation's ways (way, a, b, points) with line, closed, place and back: node 2i is the i-th way by number, 2i + 1 the same backwards."""
    group = group.take(pa.array(np.argsort(group["way"].to_numpy(), kind="stable")))
    n = group.num_rows
    ends = pa.chunked_array([*group["a"].chunks, *group["b"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    start = np.column_stack([ends[:n], ends[n:]]).reshape(-1)
    order = np.argsort(start, kind="stable")
    first = np.flatnonzero(np.diff(start[order], prepend=-1))
    pairs = first[np.diff(first, append=2 * n) == 2]  # spots where two ends meet
    follows = np.full(2 * n, -1)
    follows[order[pairs] ^ 1], follows[order[pairs + 1] ^ 1] = order[pairs + 1], order[pairs]
    after = follows.tolist()
    line, place, closed, back = [-1] * n, [0] * n, [False] * n, [False] * n
    # chains from the end of their lesser way; what is left then lies on rings, from their least node
    for begin, ring in [*((x, False) for x in np.flatnonzero(follows.reshape(-1, 2)[:, ::-1].reshape(-1) < 0).tolist()), *((x, True) for x in range(0, 2 * n, 2))]:
        x, k = begin, 0
        while x >= 0 and line[x >> 1] < 0:
            line[x >> 1], place[x >> 1], closed[x >> 1], back[x >> 1] = begin >> 1, k, ring, bool(x & 1)
            x, k = after[x], k + 1
    return pa.table({"relation": group["relation"], "line": group["way"].take(pa.array(line, pa.int64())), "closed": pa.array(closed, pa.bool_()), "place": pa.array(place, pa.int64()), "back": pa.array(back, pa.bool_()), "points": group["points"]})


def _jump(nodes: DataFrame, rounds: int) -> DataFrame:
    """relation, node, next, last (the node where pointers end; null on a ring), least (of the nodes passed), steps (to the end)."""
    now = nodes.withColumns({"last": F.coalesce("next", "node"), "least": F.least("node", F.coalesce("next", "node")), "steps": F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint"), "far": F.col("next")})
    for _ in range(rounds):
        ahead = now.select("relation", F.col("node").alias("far"), F.col("far").alias("_far"), F.col("last").alias("_last"), F.col("least").alias("_least"), F.col("steps").alias("_steps"))
        met = now.join(ahead, ["relation", "far"], "left")
        moved = F.col("_last").isNotNull()
        now = written(
            met.select("relation", "node", "next", F.when(moved, F.col("_last")).otherwise(F.col("last")).alias("last"), F.when(moved, F.least("least", "_least")).otherwise(F.col("least")).alias("least"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.when(moved, F.col("_far")).alias("far")),
            "jumped",
        )
    return now


def assemble(ways: DataFrame, *, digits: int = 7) -> DataFrame:
    """relation, line (a number of its own in the relation: its first way), closed, ways (how many), points: the rings and chains of each relation.

    ways: relation, way (a long), points (array of struct lat, lon). Ends meet where they agree to `digits`; a way of one point or none is left out,
    one that ends where it starts is a ring by itself. A chain that ends where three or more ways meet ends there: which of them it goes on to would be
    a guess. Points that two ways share are there once; a ring's first point is its last as well. Lines start at their end of the lesser way.
    """
    spot = lambda p: F.concat_ws(",", F.round(p["lat"], digits).cast("string"), F.round(p["lon"], digits).cast("string"))
    every = written(ways.where("relation IS NOT NULL AND way IS NOT NULL AND size(points) > 1").select("relation", F.col("way").cast("bigint").alias("way"), "points"), "ways")
    every = every.withColumns({"a": spot(F.col("points")[0]), "b": spot(F.element_at("points", -1))})
    alone, joined = every.where("a = b"), every.where("a <> b")
    sizes = every.groupBy("relation").agg(F.sum(F.size("points")).alias("_points"))
    kind = {f.name: f.dataType.simpleString() for f in every.schema.fields}
    large = written(sizes.where(F.col("_points") > POINTS).select("relation"), "large")
    some = large.limit(1).count() > 0
    few = joined.join(large, "relation", "left_anti") if some else joined
    followed = few.groupBy("relation").applyInArrow(_followed, f"relation {kind['relation']}, line bigint, closed boolean, place bigint, back boolean, points {kind['points']}")
    drawn = followed.unionByName(_jumped(joined.join(large, "relation", "left_semi"))) if some else followed
    drawn = drawn.withColumn("points", F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points")))
    lines = drawn.groupBy("relation", "line", "closed").agg(F.array_sort(F.collect_list(F.struct("place", "points"))).alias("_p"))  # one line's ways
    rest = F.flatten(F.transform(F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda x: F.slice(x["points"], 2, F.size(x["points"]))))
    out = lines.select("relation", "line", "closed", F.size("_p").cast("bigint").alias("ways"), F.concat(F.col("_p")[0]["points"], rest).alias("points"))
    return out.unionAll(alone.select("relation", F.col("way").alias("line"), F.lit(True), F.lit(1).cast("bigint"), "points"))


def _jumped(joined: DataFrame) -> DataFrame:
    """relation, line, closed, place, back, points of the ways of large relations, by pointer jumping."""
    node = lambda back: F.struct("way", F.lit(back).alias("back"))
    directed = joined.select("relation", node(False).alias("node"), F.col("a").alias("start"), F.col("b").alias("end")).unionAll(joined.select("relation", node(True).alias("node"), F.col("b").alias("start"), F.col("a").alias("end")))
    # a spot where two ends meet: what comes in by the one goes out by the other
    spots = directed.groupBy("relation", F.col("start").alias("end")).agg(F.count("*").alias("ends"), F.min("node").alias("one"), F.max("node").alias("other")).where("ends = 2")
    met = directed.join(spots, ["relation", "end"], "left")
    back = F.struct(F.col("node.way").alias("way"), (~F.col("node.back")).alias("back"))
    nodes = written(met.select("relation", "node", F.when(F.col("one") == back, F.col("other")).when(F.col("other") == back, F.col("one")).alias("next")), "nodes")
    longest = nodes.groupBy("relation").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, int(longest - 1).bit_length())
    found = _jump(nodes, rounds)
    # chains: both directions are there, each with its own last node; rings: both too, told apart by their least node
    chains = found.where("far IS NULL").select("relation", "node", "last", "steps", F.struct(F.col("last.way").alias("way"), (~F.col("last.back")).alias("back")).alias("mirror"))
    first = chains.groupBy("relation", "last").agg(F.max(F.struct("steps", "node")).alias("_f")).select("relation", "last", F.col("_f.node").alias("first"))
    kept = first.where((F.col("first.way") < F.col("last.way")) | (F.col("first.way") == F.col("last.way")) & ~F.col("first.back"))
    chain = chains.drop("mirror").join(kept, ["relation", "last"]).select("relation", "node", F.col("first.way").alias("line"), F.lit(False).alias("closed"), (-F.col("steps")).alias("place"))
    rings = found.where("far IS NOT NULL AND NOT least.back")
    opened = written(rings.select("relation", "node", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.col("least").alias("ring")), "opened")
    ranked = _jump(opened.select("relation", "node", "next"), rounds).join(opened.select("relation", "node", "ring"), ["relation", "node"])
    ring = ranked.select("relation", "node", F.col("ring.way").alias("line"), F.lit(True).alias("closed"), (-F.col("steps")).alias("place"))
    placed = chain.unionAll(ring).select("relation", "line", "closed", "place", F.col("node.way").alias("way"), F.col("node.back").alias("back"))
    return placed.join(joined.select("relation", "way", "points"), ["relation", "way"]).drop("way")


def extent_m2(points: str = "points"):
    """The area that a ring of lat, lon encloses (the plane at its first point; good for lakes and woods, not for continents)."""
    metre = 111_194.926644
    p = F.col(points)
    x = lambda i: (p[i]["lon"] - p[0]["lon"]) * F.cos(F.radians(p[0]["lat"])) * metre
    y = lambda i: (p[i]["lat"] - p[0]["lat"]) * metre
    crossed = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: x(i) * y(i + 1) - x(i + 1) * y(i))
    return F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, v: a + v)) / 2.0


def layer(ways: DataFrame, *, closed: bool, least_m2: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """A layer's lines: rings of at least least_m2 (areas), or chains (roads), thinned by tolerance (degrees; 0: not at all)."""
    lines = assemble(ways).where(F.col("closed") == closed)
    lines = lines.where(extent_m2() >= least_m2) if closed and least_m2 else lines
    return simplify(lines, tolerance) if tolerance else lines
