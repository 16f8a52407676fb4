"""Quality classification by co-training two views.

View one is the text itself (byte frequencies and how much words, word pairs and lines repeat,
over the whole text). View two is the page metadata (source, language, length). Each view has a
ridge-penalised logistic model. In every round each model labels the unlabelled documents that it
is surest of, out of all there are, and these go into the other model's training set. At the end
each view is calibrated on held-out labels, and their calibrated log-odds are added (the prior
counted once).

The labelled sample and the pseudo-labels of a round are bounded (parameters of `fit`), so the
training set fits the driver; what the rounds choose from, and what is scored, is every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_string, materialize, raw_bytes, release, row_slices, table, tidied
from .word_hash import word_hashes

CONTENT = 256 + 8
SOURCE_BINS, LANGUAGE_BINS = 64, 16
META = SOURCE_BINS + LANGUAGE_BINS + 24


def _distinct_share(h: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Distinct values over values, by row (1 where there are none)."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    found = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(count))
    return np.where(count > 0, found / np.maximum(count, 1), 1.0)


def content_features(texts: pa.Array) -> np.ndarray:
    """One row of view one for each text; an empty text has zeros but for the shares of distinct things."""
    out = np.zeros((len(texts), CONTENT), np.float32)
    for lo, hi in row_slices(texts):
        data, at = raw_bytes(texts.slice(lo, hi - lo))
        n, size = hi - lo, np.diff(at)
        row = np.repeat(np.arange(n), size)
        counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
        f = out[lo:hi]
        f[:, :256] = np.sqrt(counts / np.maximum(size, 1)[:, None])
        h, of = word_hashes(data, at)
        words = np.bincount(of, minlength=n)
        same = of[1:] == of[:-1]
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
        pairs = np.bincount(of[:-1][same], minlength=n)
        repeats = np.bincount(of[:-1][same & (h[1:] == h[:-1])], minlength=n)
        f[:, 256] = np.log1p(size)
        f[:, 257] = np.log1p(words)
        f[:, 258] = (size - counts[:, [9, 10, 11, 12, 13, 32]].sum(1)) / np.maximum(words, 1)
        f[:, 259] = _distinct_share(h, of, words)
        f[:, 260] = _distinct_share(pair, of[:-1][same], pairs)
        f[:, 261] = repeats / np.maximum(words, 1)
        f[:, 262] = counts[:, 10] / np.maximum(words, 1)
        f[:, 263] = counts[:, 65:91].sum(1) / np.maximum(counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1), 1)
    return out


def _bins(column: pa.Array, count: int) -> np.ndarray:
    import zlib

    names = column.cast(pa.string()).to_pylist()
    known = {v: (0 if v is None else 1 + zlib.crc32(v.encode()) % (count - 1)) for v in set(names)}
    return np.array([known[v] for v in names], np.int64)


def meta_features(source: pa.Array, language: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One row of view two for each document: its source and language (hashed; null is a value) and the size class of its length (null: none)."""
    n = len(source)
    out = np.zeros((n, META), np.float32)
    out[np.arange(n), _bins(source, SOURCE_BINS)] = 1
    out[np.arange(n), SOURCE_BINS + _bins(language, LANGUAGE_BINS)] = 1
    length = n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    at = np.clip(np.log2(np.maximum(length, 0) + 1), 0, 23).astype(int)
    out[np.arange(n), SOURCE_BINS + LANGUAGE_BINS + at] = length >= 0
    return out


@dataclass(frozen=True)
class View:
    """A logistic model with the scaling of its features, and its calibration (slope, intercept)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -30, 30)


@dataclass(frozen=True)
class QualityModel:
    content: View
    meta: View
    prior: float

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = self.content.logit(content) + self.meta.logit(meta) - self.prior
        return 1 / (1 + np.exp(-np.clip(both, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last weight is the intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + penalty * w
        hessian = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1
        step = np.linalg.solve(hessian + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> View:
    mean, scale = x.mean(0), x.std(0) + 1e-3
    return View(mean, scale, _logistic(np.clip((x - mean) / scale, -8, 8), y, weight, ridge))


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling, with targets pulled in a little from 0 and 1."""
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = _logistic(view.margin(x)[:, None], target, np.ones(len(y)), 1e-3)
    return View(view.mean, view.scale, view.weights, float(max(slope, 0.0)), float(shift if slope > 0 else np.log((positive + 1) / (negative + 1))))


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


#: What a view names in a round: (view, label, keys of documents).
Named = list[tuple[int, int, np.ndarray]]


def surest(chances: tuple[np.ndarray, np.ndarray], keys: np.ndarray, taken: np.ndarray, quotas: tuple[int, int], sure: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view, label, keys, certainties): for each view and label, the documents that the view is surest of, at least `sure`, up to
    the label's quota. Of equal ones the least keys; documents of one key are one."""
    out = []
    keys, first = np.unique(keys, return_index=True)
    free = ~np.isin(keys, taken)
    for view in (0, 1):
        for label in (0, 1):
            p = chances[view][first]
            certain = p if label else 1 - p
            good = np.flatnonzero(free & (certain >= sure))
            best = good[np.argsort(-certain[good], kind="stable")[: quotas[label]]]
            out.append((view, label, keys[best], certain[best]))
    return out


def co_train(
    content: np.ndarray, meta: np.ndarray, label: np.ndarray, *, rounds: int = 4, each: int = 200, sure: float = 0.97, ridge: float = 2.0, seed: int = 11,
    offer: Callable[[tuple[View, View], np.ndarray, tuple[int, int]], tuple[Named, dict[int, tuple[np.ndarray, np.ndarray]]]] | None = None,
) -> QualityModel | None:
    """label: 1, 0, or -1 for documents without one. None if the labels don't have both classes.

    Each round, each view names up to `each` unlabelled documents of which it is at least `sure` (classes in the labelled
    proportion), for the other view's training set, at half weight. They are taken from the rows labelled -1, or from what
    `offer` reaches: given both views, the keys that are taken and the quotas by label, it returns what the views name, and the
    features (content, meta) by key.
    """
    known = np.flatnonzero(label >= 0)
    if len(set(label[known])) < 2:
        return None
    rng = np.random.default_rng(seed)
    known = known[rng.permutation(len(known))]
    held = known[: max(2, len(known) // 4)] if len(known) >= 40 else known
    train = known[len(held) :] if len(known) >= 40 else known
    if len(set(label[train])) < 2 or len(set(label[held])) < 2:
        train = held = known
    share = float(label[known].mean())
    quotas = each - round(each * share), round(each * share)
    views, pool = (content, meta), np.flatnonzero(label < 0)
    named: list[dict[int, int]] = [{}, {}]  # by view that learns from it: key and label
    features: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def from_rows(models: tuple[View, View], taken: np.ndarray, quotas: tuple[int, int]) -> tuple[Named, dict]:
        got = surest((_chance(models[0].logit(content[pool])), _chance(models[1].logit(meta[pool]))), pool, taken, quotas, sure)
        return [(v, c, keys) for v, c, keys, _ in got], {int(i): (content[i], meta[i]) for *_, keys, _ in got for i in keys}

    def fitted(k: int) -> View:
        more = [features[i][k] for i in named[k]]
        x = np.vstack([views[k][train], *([np.array(more)] if more else [])])
        y = np.concatenate([label[train], list(named[k].values())]).astype(float)
        weight = np.where(np.arange(len(y)) < len(train), 1.0, 0.5)
        return _calibrated(_view(x, y, weight, ridge), views[k][held], label[held].astype(float))

    for _ in range(rounds):
        models = fitted(0), fitted(1)
        got, found = (offer or from_rows)(models, np.array(sorted(features), np.int64), quotas)
        if not found:
            break
        features |= found
        for view, value, keys in got:
            for i in keys.tolist():
                named[1 - view].setdefault(i, value)
    prior = float(np.log((label[held].sum() + 1) / (len(held) - label[held].sum() + 1)))
    return QualityModel(fitted(0), fitted(1), prior)


def _stack(rows: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """key, doc_id, content, meta (32-bit floats) of every row; rows alike in all that is read have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column("text"))
            for lo, hi in row_slices(texts):
                content = content_features(texts.slice(lo, hi - lo))
                meta = meta_features(*(batch.column(c).slice(lo, hi - lo) for c in ("source", "lang", "n_chars")))
                own = [batch.column(c).slice(lo, hi - lo) for c in ("key", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x.tobytes() for x in f], pa.binary()) for f in (content, meta))], ["key", "doc_id", "content", "meta"])

    read = ("doc_id", "text", "source", "lang", "n_chars")
    picked = docs.select(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in read)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), *read[1:])
    return picked.mapInArrow(tidied(run), "key bigint, doc_id bigint, content binary, meta binary")


#: Parts that what tasks offer of one view and label is ranked in, before all of it is.
PARTS = 64


def _offer(pool: DataFrame, sure: float) -> Callable:
    """What the views name out of the whole pool (written features), in one job a round. Each task tells its surest rows by view and
    label, quota rows of each at most, with their features; the surest of all of these come to the driver."""
    spark = pool.sparkSession

    def offer(models: tuple[View, View], taken: np.ndarray, quotas: tuple[int, int]) -> tuple[Named, dict]:
        shared = spark.sparkContext.broadcast((models, taken))
        kinds = [(v, c) for v in (0, 1) for c in (0, 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (of_content, of_meta), known = shared.value
            best: dict[tuple[int, int], dict[int, tuple[float, bytes, bytes]]] = {kind: {} for kind in kinds}
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    keys = part.column("key").to_numpy()
                    chances = _chance(of_content.logit(_stack(part.column("content"), CONTENT))), _chance(of_meta.logit(_stack(part.column("meta"), META)))
                    place = None
                    for v, c, named, certain in surest(chances, keys, known, quotas, sure):
                        if not len(named):
                            continue
                        place = dict(zip(keys[::-1].tolist(), range(len(keys) - 1, -1, -1))) if place is None else place
                        mine = best[v, c]
                        for k, x in zip(named.tolist(), certain.tolist()):
                            if k not in mine:
                                mine[k] = (x, part.column("content")[place[k]].as_py(), part.column("meta")[place[k]].as_py())
                        if len(mine) > quotas[c]:
                            best[v, c] = dict(sorted(mine.items(), key=lambda e: (-e[1][0], e[0]))[: quotas[c]])
            rows = [(v, c, k, *x) for (v, c), mine in best.items() for k, x in mine.items()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()))], ["view", "label", "key", "certain", "content", "meta"])

        told = pool.select("key", "content", "meta").mapInArrow(tidied(run), "view int, label int, key bigint, certain double, content binary, meta binary")
        told = told.groupBy("view", "label", "key").agg(F.max("certain").alias("certain"), F.first("content").alias("content"), F.first("meta").alias("meta"))
        # first within parts of a view and label, so that no task has what all tasks tell of one
        told = told.withColumn("part", F.pmod("key", F.lit(PARTS)))
        quota = F.when(F.col("label") == 1, quotas[1]).otherwise(quotas[0])
        for by in (("view", "label", "part"), ("view", "label")):
            nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("certain"), "key"))
            told = told.withColumn("nth", nth).where((F.col("nth") <= max(quotas)) & (F.col("nth") <= quota)).drop("nth")
        got = told.drop("part").toArrow()
        shared.unpersist()
        if not got.num_rows:
            return [], {}
        view, value, keys = (got[c].to_numpy() for c in ("view", "label", "key"))
        found = dict(zip(keys.tolist(), zip(_stack(got["content"], CONTENT), _stack(got["meta"], META))))
        return [(v, c, np.sort(keys[(view == v) & (value == c)])) for v, c in kinds], found

    return offer


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = 5000, rounds: int = 4, each: int = 200, sure: float = 0.97, seed: int = 3, pool: DataFrame | None = None) -> QualityModel | None:
    """Co-train on at most `labelled` labelled documents, drawn by a hash of doc_id, and on all documents without labels.

    A document labelled more than once has the label of most of its rows (good on a tie); null labels and ids are left out. Of rows
    that share a drawn id, one counts (that of the least key). The rest of the table, rows without an id included, is the pool the
    views name from, `each` a round; rows alike in all that is read are one document there. Labelled documents that aren't drawn
    are in the pool as well. None where the sample lacks one of the classes, or the table is empty. To the driver come the
    features (1.5 KB each) of at most labelled + 2 * each * rounds documents, however many rows share an id or a text. pool: the
    written features of docs, where they are there already.
    """
    pool = materialize(features(docs), "features") if pool is None else pool
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = judged.join(pool.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(labelled)
    rows = pool.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("content", "meta"), "key").alias("row"))
    got = rows.select("doc_id", "label", "row.content", "row.meta").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    drawn = pool.sparkSession.createDataFrame([(d,) for d in got["doc_id"].to_pylist()], "doc_id bigint")
    rest = pool.join(F.broadcast(drawn), "doc_id", "left_anti")
    return co_train(_stack(got["content"], CONTENT), _stack(got["meta"], META), got["label"].to_numpy(), rounds=rounds, each=each, sure=sure, seed=seed, offer=_offer(rest, sure))


def score_column(spark: SparkSession, model: QualityModel | None, text="text", source="source", lang="lang", n_chars="n_chars"):
    """The score (0 to 1) as a column of the documents: texts go to Python once and only scores come back.

    A null text is the empty one; without a model every score is 1 (nothing is rejected unlearned).
    """
    if model is None:
        return F.lit(1.0)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(texts: pa.Array, sources: pa.Array, langs: pa.Array, lengths: pa.Array) -> pa.Array:
        m, whole = shared.value, as_string(texts)
        meta, value = meta_features(sources, langs, lengths), np.zeros(len(whole))
        for lo, hi in row_slices(whole):
            value[lo:hi] = m.score(content_features(whole.slice(lo, hi - lo)).astype(np.float64), meta[lo:hi].astype(np.float64))
        release()
        return pa.array(value, pa.float64())

    return score_of(text, source, lang, n_chars)


def score(spark: SparkSession, docs: DataFrame, model: QualityModel | None, *, keep: tuple[str, ...] = ("doc_id",), out_name: str = "quality") -> DataFrame:
    """keep columns and `quality` (or out_name; 0 to 1) of every row, as score_column has it. Every row comes back once."""
    return docs.select(*keep, score_column(spark, model).alias(out_name))


def score_features(pool: DataFrame, model: QualityModel | None, *, out_name: str = "quality") -> DataFrame:
    """doc_id and `quality` (or out_name) of every row of features: what score gives, without going through the texts again."""
    if model is None:
        return pool.select("doc_id", F.lit(1.0).alias(out_name))
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                value = shared.value.score(_stack(part.column("content"), CONTENT), _stack(part.column("meta"), META))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", out_name])

    return pool.select("doc_id", "content", "meta").mapInArrow(tidied(run), f"doc_id bigint, `{out_name}` double")


#: Documents below this score are rejected.
ACCEPT = 0.5


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, quality, keep."""
    docs = table(spark, sf_dir, "documents")
    pool = materialize(features(docs), "features")
    model = fit(docs, table(spark, sf_dir, "labels"), pool=pool)
    return score_features(pool, model).select("doc_id", "quality", (F.col("quality") >= ACCEPT).alias("keep"))
