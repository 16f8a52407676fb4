"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source is a queue of its documents in a shuffled (hash) order, gone through at most three
times. A copy's virtual finish time is the source's words up to and with it, divided by the
source's target, so all queues reach 1 together when each has given its target. All copies are
sorted by virtual finish time and the first ones that fit the total budget are taken.

No step needs a whole source, or the whole corpus, in one task: the running sums are taken
within slices (of the hash within a source; of virtual time over all), and slices are joined by
a prefix sum over their totals, whose number is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MOST_TIMES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of a source's shuffled order (by the first digits of the hash), and of virtual time (a whole number of 2^-k, so the
#: split is exact): so many at least, and as many as keep about SLICE_ROWS rows in one.
HASH_HEX = 3
TIME_SLICES = 1024
SLICE_ROWS = 1 << 20
#: Up to so many sources are told to the documents by broadcast (some 100 bytes each); beyond, by a join.
BROADCAST_ROWS = 100_000


def place(id: str, text: str):
    """A hash of id and text: the same each time, and in no order that documents come in."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def source_key(source: str):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def sizes(docs: DataFrame, *, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """id, source, size (words; 0 for a null text) and place: a hash of id and text that shuffles the documents the same way each time."""
    return docs.select(
        F.col(id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        place(id, text).alias("place"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = MOST_TIMES) -> DataFrame:
    """Per source: source_size, rank (by code point, null last, from 0) and target.

    Targets share the total of all sizes by weight. One that would pass most_times its source's size stops there and
    the excess is shared again; as the sources that stop first are those with the least cap per weight, one pass over
    the sources in that order settles it. One row per source: the only table here that one task sees whole.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    ranked = by_source.withColumn("rank", F.row_number().over(named) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most_times).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    # the first source in that order that isn't stopped sets the level for all later ones
    first = Window.orderBy(~F.col("free"), F.col("cap") / F.col("weight"), "rank")
    final = ranked.withColumn("final", F.first(F.when(F.col("free"), F.col("level"))).over(first))
    return final.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_times: int = MOST_TIMES) -> DataFrame:
    """sized (doc_id, source, size, place; read more than once, so pass a written table) with source_size, target and times (0..most_times).

    Rows alike in all four columns may swap places. Documents without words are never taken (times 0). An empty table gives an empty result.
    """
    source, rows = source_key("source"), sized.count()
    digits, slices = HASH_HEX, TIME_SLICES
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    while slices * SLICE_ROWS < most_times * rows:
        slices *= 2
    goal = targets(sized, weights, most_times).withColumn("_key", source).drop("source")
    docs = sized.withColumn("_key", source).withColumn("_slice", F.substring("place", 1, digits))
    parts = docs.groupBy("_key", "_slice").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words").join(goal, "_key")
    within = Window.partitionBy("_key", "_slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = docs.withColumn("_upto", F.sum("size").over(within)).join(parts, ["_key", "_slice"]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    queued = materialize(queued.select("doc_id", "source", "size", "place", "source_size", "target", "rank", "_upto"), "queues")

    def position(turn):
        return turn * F.col("source_size") + F.col("_upto")

    def finish(turn):
        return F.try_divide(position(turn).cast("double"), F.col("target"))

    def range_of(time):
        return F.least(F.floor(time * slices), F.lit(16 * slices)).cast("int")

    copies = queued.where("size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most_times - 1))))
    copies = copies.select("size", "rank", position(F.col("_turn")).alias("_pos"), finish(F.col("_turn")).alias("_time"))
    copies = copies.withColumn("_range", range_of(F.col("_time")))
    # Global sort: virtual time falls into fixed ranges, which hold about the same words each (time is in shares of the
    # targets). Ranges wholly before or after the cut need no sort within; the one that the budget ends in is sorted.
    ordered = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = copies.groupBy("_range").agg(F.sum("size").alias("_words"))
    starts = totals.select("_range", F.coalesce(F.sum("_words").over(ordered), F.lit(0)).alias("_start"))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_budget"))
    ends_in = starts.crossJoin(F.broadcast(budget)).where("_start <= _budget").agg(F.max(F.struct("_range", "_start", "_budget")).alias("_cut"))  # one row
    running = Window.orderBy("_time", "rank", "_pos").partitionBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.crossJoin(F.broadcast(ends_in)).where(F.col("_range") == F.col("_cut._range")).withColumn("_sum", F.col("_cut._start") + F.sum("size").over(running))
    last = edge.where(F.col("_sum") <= F.col("_cut._budget")).agg(F.max(F.struct("_time", "rank", "_pos")).alias("_last"))  # one row

    def taken(turn):
        at = range_of(finish(turn))
        upto = F.struct(finish(turn).alias("_time"), F.col("rank").alias("rank"), position(turn).alias("_pos")) <= F.col("_last")
        return F.when((F.col("size") > 0) & ((at < F.col("_cut._range")) | (at == F.col("_cut._range")) & upto), 1).otherwise(0)

    times = taken(F.lit(0))
    for k in range(1, most_times):
        times = times + taken(F.lit(k))
    rows = queued.crossJoin(F.broadcast(ends_in)).crossJoin(F.broadcast(last))  # one row each
    return rows.select("doc_id", "source", "size", "place", "source_size", "target", times.cast("bigint").alias("times"))


def cuts(mixed: DataFrame) -> DataFrame:
    """Per source (key, as source_key has it) what mix takes of it, so that each document's times follow from its own row:
    `base` times all documents with words, once more those with place up to `last` (null: none).

    Rows alike in id and text share the place `last`: of its `tied` rows only `more` are taken once more.
    """
    words = mixed.where("size > 0").select(source_key("source").alias("key"), "times", "place")
    levels = words.groupBy("key", "times").agg(F.max("place").alias("place"))  # at most two a source
    ends = levels.groupBy("key").agg(F.min("times").alias("base"), F.max(F.struct("times", "place")).alias("top"))
    ends = materialize(ends.select("key", "base", F.when(F.col("top.times") > F.col("base"), F.col("top.place")).alias("last")), "ends")
    told = ends.select("key", "base", F.col("last").alias("place"))
    tied = words.join(F.broadcast(told) if ends.count() <= BROADCAST_ROWS else told, ["key", "place"]).groupBy("key").agg(F.count("*").alias("tied"), F.count_if(F.col("times") > F.col("base")).alias("more"))
    return ends.join(tied, "key", "left").select("key", F.col("base").cast("int").alias("base"), "last", "tied", "more")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words the mix takes of it (see mix)."""
    sized = materialize(sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
