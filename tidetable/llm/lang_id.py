"""Language identification with string kernels.

A text is the set of its byte n-grams (n = 1, 2, 3) after lower-casing: the presence form of
the blended-spectrum kernel. Kernel of two texts: the mean over n of
|A_n & B_n| / sqrt(|A_n| |B_n|), the n-grams being all those that occur in the landmark texts.
Nyström landmarks give an explicit map (K_mm^-1/2), and a ridge regression per language
(one against the rest) is solved on it. Scoring is one batched product of presence rows with
the folded matrix landmarks x K_mm^-1/2 x coefficients, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_string, raw_bytes, row_slices, table

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Texts whose presence rows are multiplied at once.
ROWS = 64
_BASE = {1: 0, 2: 256, 3: 256 + 65536}
_SPACE = 256 + 65536 + (1 << 24)


@dataclass(frozen=True)
class LanguageModel:
    """labels: learned languages by code point; grams: codes of the vocabulary, ascending;
    weights: vocabulary x languages, the folded landmark product."""

    labels: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray


def _codes(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, n-gram codes and the row of each; n-grams never cross rows."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    wide = data.astype(np.int32)
    code = wide
    for n in ORDERS:
        if n > 1:
            if len(data) < n:
                return
            code = code[:-1] | wide[n - 1 :] << 8 * (n - 1)
        same = row[: len(row) - n + 1] == row[n - 1 :]
        yield code[same] + _BASE[n], row[: len(row) - n + 1][same]


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.utf8_lower(as_string(batch.column("text")))
        out = []
        for i in range(len(texts)):
            data, at = raw_bytes(texts.slice(i, 1))
            codes = [np.unique(c) for c, _ in _codes(data, at)]
            out.append(np.concatenate(codes or [np.zeros(0, np.int32)]).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.string()), pa.array(out, pa.binary())], ["label", "grams"])


def _normal(presence: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    """Rows scaled so that a product of two is the blended kernel."""
    out = presence.astype(np.float32)
    for n in ORDERS:
        part = slice(*np.searchsorted(order_of, (n, n + 1)))  # codes ascend by order
        size = out[:, part].sum(1, keepdims=True)
        out[:, part] /= np.sqrt(np.maximum(size, 1) * len(ORDERS))
    return out


def _order_of(grams: np.ndarray) -> np.ndarray:
    return np.where(grams < _BASE[2], 1, np.where(grams < _BASE[3], 2, 3))


def fit(
    labelled: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = 400, landmarks: int = 192, ridge: float = 0.05, seed: int = 7
) -> LanguageModel:
    """Fit on at most per_language labelled texts of each language, with `landmarks` of them (2 of each language at least) as the
    Nyström landmarks. Both bound the labelled sample alone: every n-gram of the landmarks counts, and scoring reads whole texts.

    The sample is drawn by a hash of the text and covers whole texts, each text of a language once
    however many copies it has: the per_language texts of least hash. Its n-gram sets are made on
    the executors, and at most per_language sets a language reach the driver.
    Rows with a null label are left out. With no labelled row the model knows no language.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)))
    counts = {r["label"]: r["count"] for r in rows.select("label", "hash").distinct().groupBy("label").count().collect()}
    if not counts:
        return LanguageModel((), np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_language / v)))])
    draw = F.pmod("hash", F.lit(1 << 20))
    drawn = rows.where(draw / F.lit(float(1 << 20)) < share[F.col("label")]).dropDuplicates(["label", "hash"])
    nth = F.row_number().over(Window.partitionBy("label").orderBy(draw, "hash"))  # of some 1.3 x per_language texts
    got = drawn.withColumn("nth", nth).where(F.col("nth") <= per_language).select("text", "label").mapInArrow(_gram_sets, "label string, grams binary").toArrow()
    labels = tuple(sorted(counts))
    rng = np.random.default_rng(seed)
    sets: list[np.ndarray] = []
    y: list[int] = []
    found = sorted(zip(got["label"].to_pylist(), got["grams"].to_pylist()))
    for k, name in enumerate(labels):
        own = [np.frombuffer(g, "<i4") for x, g in found if x == name]
        for i in sorted(rng.permutation(len(own))[:per_language]):
            sets.append(own[i])
            y.append(k)
    pick: list[int] = []  # landmarks, as many of each language as possible
    for k in range(len(labels)):
        own_at = [i for i, c in enumerate(y) if c == k]
        pick += [own_at[i] for i in rng.permutation(len(own_at))[: max(2, landmarks // len(labels))]]
    grams = np.unique(np.concatenate([sets[i] for i in pick])).astype(np.int64)
    order_of = _order_of(grams)

    def rows_of(some: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(some), len(grams)), bool)
        for i, s in enumerate(some):
            at = np.searchsorted(grams, s)
            at[at == len(grams)] = 0
            presence[i, at[grams[at] == s]] = True
        return _normal(presence, order_of)

    marks = rows_of([sets[i] for i in pick])
    kernel = np.vstack([rows_of(sets[lo : lo + 64]) @ marks.T for lo in range(0, len(sets), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[pick])
    good = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    target = np.where(np.array(y)[:, None] == np.arange(len(labels))[None, :], 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(labels))[y]  # each language counts alike
    weight *= len(y) / weight.sum()
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    reg = ridge * np.eye(phi1.shape[1])
    reg[-1, -1] = 1e-6
    coef = np.linalg.solve(phi1.T @ (phi1 * weight[:, None]) + reg, phi1.T @ (target * weight[:, None]))
    folded = marks.T @ (root @ coef[:-1])
    return LanguageModel(labels, grams, np.vstack([folded, coef[-1:]]).astype(np.float32))


_tables: dict[str, np.ndarray] = {}


def _lookup(model: LanguageModel, key: str) -> np.ndarray:
    if key not in _tables:
        _tables.clear()
        found = np.full(_SPACE, -1, np.int32)
        found[model.grams] = np.arange(len(model.grams), dtype=np.int32)
        _tables[key] = found
    return _tables[key]


def score_texts(model: LanguageModel, texts: pa.Array, key: str = "one") -> tuple[np.ndarray, np.ndarray]:
    """Scores of each language for each text, and whether the text has a letter."""
    letter = np.asarray(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False), bool)
    if not model.labels:
        return np.zeros((len(texts), 0), np.float32), letter
    found, order_of = _lookup(model, key), _order_of(model.grams)
    lower = pc.utf8_lower(texts)
    out = np.zeros((len(texts), len(model.labels)), np.float32)
    for start, end in row_slices(lower, 1 << 19):
        data, at = raw_bytes(lower.slice(start, end - start))
        for lo in range(0, end - start, ROWS):
            hi = min(lo + ROWS, end - start)
            presence = np.zeros((hi - lo, len(model.grams)), bool)
            for code, row in _codes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                gram = found[code]
                known = gram >= 0
                presence[row[known], gram[known]] = True
            out[start + lo : start + hi] = _normal(presence, order_of) @ model.weights[:-1] + model.weights[-1]
    return out, letter


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score of every row.

    A null text, or one without a letter, is `und` with score 0, as is any text under a model
    that knows no language. score maps the winner's regression value from -1..1 to 0..1; ties
    go to the language that comes first by code point.
    """
    shared = spark.sparkContext.broadcast(model)
    key = f"{id(shared)}-{len(model.grams)}-{float(model.weights.sum()) if len(model.labels) else 0}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, letter = score_texts(m, as_string(batch.column("_text")), key)
            if m.labels:
                best = scores.argmax(1)
                names = np.where(letter, np.array(m.labels, object)[best], UNKNOWN)
                value = np.where(letter, np.clip((scores.max(1) + 1) / 2, 0, 1), 0.0)
            else:
                names, value = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names.tolist(), pa.string()), pa.array(value.astype(np.float64))], [*batch.schema.names[:-1], "lang_pred", "score"]
            )

    picked = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's held_out, lang_pred and score, learned from labelled documents that aren't held out (see fit and predict)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs.where(fold != 1))
    scored = predict(spark, docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "lang_pred", "score")
