"""Exact top-k inner-product search by MaxScore over term-major blocks.

A term is a vector component; its posting holds the integer components of a block's
candidates. For a query, a term's bound is the most it can add to any candidate's score there.
Terms are ordered by bound; those at the end whose bounds together stay below the threshold
(the k-th best score so far) are non-essential: no candidate can get in by them alone. Essential
postings are traversed for all candidates, then the other terms are probed only for candidates
that can still compete. Blocks are the shards: each gives its k best of each query, and these merge.

Every block of queries meets every block of candidates once; both are dealt out by the pair of
block numbers, so no task sees more than two blocks, and no side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 64
#: Vectors a block holds at most. Each side is sent to every block of the other, so large blocks keep what is moved small.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 32768


def _integers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are whole (not null, no null or non-finite component), and their floor(64 x) as doubles."""
    whole, out = np.zeros(len(vectors), bool), []
    for i, v in enumerate(vectors):
        if not v.is_valid or v.values.null_count:
            continue
        x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            whole[i] = True
            out.append(x)
    return whole, out


def integer_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dims, data (the integers as little-endian doubles, which hold each exactly) of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part; nor do those with a component so large
    that 64 times it is no finite double.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, found = _integers(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(whole)), pa.array([len(x) for x in found], pa.int32()), pa.array([x.astype("<f8").tobytes() for x in found], pa.binary())], ["vec_id", "dims", "data"]
            )

    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, "vec_id bigint, dims int, data binary")


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """One row for each block: dims, its number, ids and matrix, by id and vector: the same each time a block is made."""

    def gather(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        dims = group["dims"][0].as_py()
        data = group["data"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], data[i])), np.int64)  # whatever order rows arrive in
        matrix = b"".join([data[i] for i in order])
        return pa.table({"dims": pa.array([dims], pa.int32()), name: pa.array([group["_block"][0].as_py()], pa.int32()), f"{name}_ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), f"{name}_data": pa.array([matrix], pa.binary())})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("vec_id", "data"), F.lit(count)).cast("int"))
    return dealt.groupBy("dims", "_block").applyInArrow(gather, f"dims int, {name} int, {name}_ids binary, {name}_data binary")


def _kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The numbers that hold every score and bound exactly: doubles below 2^53, 64-bit integers below 2^62, else Python's integers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(candidates.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _as(kind: type, x: np.ndarray) -> np.ndarray:
    """Whole doubles as numbers of this kind."""
    if kind is not object:
        return x.astype(kind)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def top_k(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (by its row), the ids and scores of its k best candidates; ids must ascend. Exact for whole numbers of any size.

    A query's own row is no candidate: the first with its id and its vector. Scores that 64 bits don't hold end in OverflowError.
    """
    n, dims = candidates.shape
    kind = _kind(queries, candidates)
    lowest = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min // 2, object: -(1 << 2200)}[kind]  # below any sum of products of doubles
    postings = np.ascontiguousarray(_as(kind, candidates).T)
    q_all = _as(kind, queries)
    high, low = (postings.max(1), postings.min(1)) if n else (np.zeros(dims, kind), np.zeros(dims, kind))
    seeds = min(n, max(256, 4 * k))
    seeded = q_all @ postings[:, :seeds]
    for row, (q, own) in enumerate(zip(q_all, query_ids)):
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        mine = lo + np.flatnonzero((candidates[lo:hi] == queries[row]).all(1))[:1]
        first = seeded[row].copy()
        first[mine[mine < seeds]] = lowest
        threshold = np.partition(first, seeds - k)[seeds - k] if seeds >= k else lowest
        up, down = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(-up, kind="stable")
        rest_up = np.concatenate([np.cumsum(up[order][::-1])[::-1], np.zeros(1, kind)])
        rest_down = np.concatenate([np.cumsum(down[order][::-1])[::-1], np.zeros(1, kind)])
        essential = int(np.argmax(rest_up < threshold)) if (rest_up < threshold).any() else dims
        score = np.zeros(n, kind)
        for j in order[:essential]:
            score += q[j] * postings[j]
        alive = np.ones(n, bool)
        alive[mine] = False
        alive = np.flatnonzero(alive & (score + rest_up[essential] >= threshold))
        score = score[alive]
        for at in range(essential, dims):
            score = score + q[order[at]] * postings[order[at], alive]
            if len(score) >= k:
                threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k] + rest_down[at + 1])
            stay = score + rest_up[at + 1] >= threshold
            alive, score = alive[stay], score[stay]
        best = np.lexsort((ids[alive], -score))[:k]
        if kind is object and any(not -(1 << 63) <= x < 1 << 63 for x in score[best]):
            raise OverflowError("a score is beyond 64 bits")
        yield row, ids[alive[best]], score[best].astype(np.int64)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """Each query's k best candidates (all, if fewer): query_id, rank, vec_id, score.

    Both inputs come from integer_vectors and are read more than once, so pass written tables. A query's own row (one with its
    vec_id and vector) is left out, other rows of its vec_id are candidates; ties go to the smaller vec_id. Vectors meet only
    those with as many components. A query row that is there twice is answered twice. Empty inputs give an empty result.
    """
    spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries, n_candidates = queries.count(), candidates.count()
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    candidate_blocks = max(1, math.ceil(n_candidates / CANDIDATE_BLOCK), min(spread, math.ceil(n_candidates / 1024)))
    q = _blocks(queries, query_blocks, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))
    c = _blocks(candidates, candidate_blocks, "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, block, q_ids, q_data, c_ids, c_data = (batch.column(x)[i].as_py() for x in ("dims", "q", "q_ids", "q_data", "c_ids", "c_data"))
                own, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                rows, who, what, score = [], [], [], []
                for row, best, value in top_k(np.frombuffer(q_data, "<f8").reshape(len(own), dims), own, np.frombuffer(c_data, "<f8").reshape(len(ids), dims), ids, k):
                    rows.append(np.full(len(best), row))
                    who.append(np.full(len(best), own[row]))
                    what.append(best)
                    score.append(value)
                cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                size = sum(map(len, rows))
                yield pa.RecordBatch.from_arrays([pa.array([dims] * size, pa.int32()), pa.array([block] * size, pa.int32()), *(pa.array(cat(x), pa.int64()) for x in (rows, who, what, score))], ["dims", "block", "row", "query_id", "vec_id", "score"])

    shards = q.join(c, ["dims", "q", "c"]).mapInArrow(run, "dims int, block int, row bigint, query_id bigint, vec_id bigint, score bigint")
    by_query = Window.partitionBy("dims", "block", "row").orderBy(F.desc("score"), "vec_id")
    ranked = shards.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of each vector whose vec_id is divisible by 20, out of all others (see search)."""
    vectors = materialize(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors)
