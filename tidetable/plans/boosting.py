"""Quantile gradient boosting on histograms: trees that minimise the pinball loss.

Inputs are cut in at most 255 bins. A level of all trees (one for each quantile) is one job: each task adds up, per open node,
input and bin, the weights of its rows and of those that are over-predicted, which is all that the pinball loss's gradient
depends on; Spark sums these, and the driver, which sees only these sums, picks the splits. A leaf's value is the exact (weighted)
quantile of its residuals, found by narrowing a range of values by counts, so residuals are never moved. Validation rows decide when to stop.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import col
from ..sources.shared import written

BINS = 255
#: Slices of a range of residuals in one step of the search for a quantile.
SLICES = 256
#: The predictions so far are written anew after so many rounds; in between, the new trees are applied again.
REFRESH = 8
_TINY = 1e-12


@dataclass(frozen=True)
class Coding:
    """How inputs become bins. numeric: ascending edges of each (bin 0: missing; bin i: up to edge i, the last: beyond all);
    categories: the values that have a bin of their own (bin 0: all others, and missing)."""

    numeric: dict[str, list[float]]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categories]

    def columns(self) -> list[Column]:
        return [F.col(c).cast("double").alias(c) for c in self.numeric] + [F.col(c).cast("string").alias(c) for c in self.categories]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bins of a batch that has the columns: rows x inputs."""
        out = np.zeros((batch.num_rows, len(self.names)), np.uint8)
        for i, (name, edges) in enumerate(self.numeric.items()):
            x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(edges), x, "left") + 1)
        for i, (name, values) in enumerate(self.categories.items(), len(self.numeric)):
            found = pc.index_in(batch.column(name).cast(pa.string()), pa.array(values, pa.string()))
            out[:, i] = pc.add(found, 1).fill_null(0).to_numpy(zero_copy_only=False)
        return out


@dataclass
class Tree:
    """Nodes by number, the root 0. feature: -1 in a leaf; left_bins: which bins of it go left; value: of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[list[int]] = field(default_factory=lambda: [[]])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, left_bins: Sequence[int], gain: float) -> tuple[int, int]:
        self.feature[node], self.left_bins[node], self.gain[node] = feature, list(left_bins), gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1), self.left_bins.append([]), self.left.append(0), self.right.append(0), self.value.append(0.0), self.gain.append(0.0)
        return self.left[node], self.right[node]

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf each row falls in."""
        feature, left, right = (np.array(x) for x in (self.feature, self.left, self.right))
        goes_left = np.zeros((len(feature), BINS + 1), bool)
        for i, b in enumerate(self.left_bins):
            goes_left[i, b] = True
        node = np.zeros(len(bins), np.int64)
        while len(todo := np.flatnonzero(feature[node] >= 0)):
            at = node[todo]
            node[todo] = np.where(goes_left[at, bins[todo, feature[at]]], left[at], right[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass(frozen=True)
class Boosted:
    """start and trees of each quantile; losses: of the validation rows after each round, the start first (empty without such rows)."""

    coding: Coding
    quantiles: tuple[float, ...]
    start: tuple[float, ...]
    trees: tuple[tuple[Tree, ...], ...]
    losses: tuple[tuple[float, ...], ...] = ()

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """rows x quantiles."""
        return np.stack([sum((t.predict(bins) for t in trees), np.full(len(bins), s)) for s, trees in zip(self.start, self.trees)], 1)


def coding(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = BINS - 1) -> Coding:
    """Edges at (sketched) quantiles of each number, and the most frequent values of each category. bins bounds both; where edges lie decides no result's exactness."""
    have = set(rows.columns)
    numbers, kinds = [c for c in numeric if c in have], [c for c in categorical if c in have]
    cuts = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), cuts, 10 * bins).alias(c) for c in numbers)).first() if numbers else {}
    edges = {c: sorted({float(x) for x in found[c] or () if x == x}) for c in numbers}
    named = {c: [r[0] for r in rows.where(col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(bins).collect()] for c in kinds}
    return Coding(edges, named)


def _hist(rows: np.ndarray, node: np.ndarray, bins: np.ndarray, weight: np.ndarray, over: np.ndarray, nodes: int) -> np.ndarray:
    """nodes x inputs x bins x (weight, weight of over-predicted rows, rows)."""
    out = np.zeros((nodes, bins.shape[1], BINS + 1, 3))
    for f in range(bins.shape[1]):
        key = node * (BINS + 1) + bins[rows, f]
        for k, w in enumerate((weight[rows], weight[rows] * over[rows], None)):
            out[:, f, :, k] = np.bincount(key, w, nodes * (BINS + 1)).reshape(nodes, BINS + 1)
    return out


def best_split(hist: np.ndarray, q: float, ordered: Sequence[bool], least: int) -> tuple[float, int, list[int]] | None:
    """gain, input and the bins that go left of a node's best split (of equal ones the first input and cut); hist: inputs x bins x 3.

    Bins of numbers keep their order, those of categories are ordered by the share that is over-predicted.
    """
    best = None
    for f, sums in enumerate(hist):
        used = np.flatnonzero(sums[:, 2] > 0)
        if len(used) < 2:
            continue
        if not ordered[f]:
            used = used[np.argsort(sums[used, 1] / sums[used, 0], kind="stable")]
        w, over, n = np.cumsum(sums[used], 0).T
        gradient = over - q * w
        rest, total = w[-1] - w[:-1], gradient[-1]
        gain = gradient[:-1] ** 2 / w[:-1] + (total - gradient[:-1]) ** 2 / rest - total**2 / w[-1]
        gain = np.where((n[:-1] >= least) & (n[-1] - n[:-1] >= least), gain, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > _TINY * max(1.0, w[-1]) and (best is None or gain[at] > best[0]):
            best = float(gain[at]), f, sorted(used[: at + 1].tolist())
    return best


def _read(batch: pa.RecordBatch, pending: Sequence[tuple[Tree, ...]], models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins, target, weight, whether held out, and the predictions so far (rows x models) with the pending trees in them."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1)
    f = batch.column("f").flatten().to_numpy().reshape(n, models).copy()
    for trees in pending:
        for i, t in enumerate(trees):
            f[:, i] += t.predict(bins)
    return bins, batch.column("y").to_numpy(), batch.column("w").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), f


class _Fit:
    """The written rows of a fit and the jobs over them."""

    def __init__(self, rows: DataFrame, code: Coding, quantiles: Sequence[float], target: str, weight: str | None, held: str | None):
        self.code, self.quantiles = code, tuple(quantiles)
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        h = F.lit(False) if held is None else F.coalesce(F.col(held), F.lit(False))
        taken = rows.where(col(target).isNotNull()).select(*code.columns(), F.col(target).cast("double").alias("_y"), w.alias("_w"), h.alias("_held")).where("_w > 0 AND NOT isnan(_y)")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = code.bins(batch)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("_y"), batch.column("_w"), batch.column("_held"), pa.array([[0.0] * len(quantiles)] * len(bins), pa.list_(pa.float64()))], ["bins", "y", "w", "held", "f"])

        self.schema = "bins binary, y double, w double, held boolean, f array<double>"
        self.rows = written(taken.mapInArrow(run, self.schema), "boosting")
        self.pending: list[tuple[Tree, ...]] = []

    def _job(self, work, schema: str) -> DataFrame:
        """work: from an iterator of (bins, y, w, held, f) to record batches."""
        pending, models = list(self.pending), len(self.quantiles)
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for arrays in work(_read(b, pending, models) for b in batches if b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

        return self.rows.mapInArrow(run, schema)

    def advance(self, trees: tuple[Tree, ...]) -> None:
        self.pending.append(trees)
        if len(self.pending) >= REFRESH:
            def work(parts):
                for bins, y, w, held, f in parts:
                    yield [pa.array([b.tobytes() for b in bins], pa.binary()), y, w, held, pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1], f.reshape(-1))]

            self.rows, self.pending = written(self._job(work, self.schema), "boosting"), []

    def histograms(self, trees: Sequence[Tree], open_nodes: Sequence[Sequence[int]]) -> tuple[dict[tuple[int, int], np.ndarray], list[float]]:
        """Per (model, open node) its histogram of the training rows; and each model's mean pinball loss of the validation rows."""
        quantiles, inputs = self.quantiles, len(self.code.names)

        def work(parts):
            sums = [np.zeros((len(nodes), inputs, BINS + 1, 3)) for nodes in open_nodes]
            losses = np.zeros((len(quantiles), 2))
            for bins, y, w, held, f in parts:
                for m, (q, tree, nodes) in enumerate(zip(quantiles, trees, open_nodes)):
                    off = y - f[:, m]
                    losses[m] += [(w * np.maximum(q * off, (q - 1) * off))[held].sum(), w[held].sum()]
                    if not len(nodes):
                        continue
                    place = np.full(len(tree.feature), -1)
                    place[list(nodes)] = np.arange(len(nodes))
                    node = place[tree.leaf_of(bins)]
                    rows = np.flatnonzero((node >= 0) & ~held)
                    sums[m] += _hist(rows, node[rows], bins, w, (off < 0).astype(np.float64), len(nodes))
            for m, nodes in enumerate(open_nodes):
                at = np.nonzero(sums[m][..., 2])
                a, b, c = sums[m][at].T
                yield [np.full(len(a), m), np.array(list(nodes), np.int64)[at[0]], at[1], at[2], a, b, c]
            k = len(quantiles)
            yield [np.arange(k), np.full(k, -1), np.zeros(k, np.int64), np.zeros(k, np.int64), losses[:, 0], losses[:, 1], np.zeros(k)]

        schema = "model bigint, node bigint, input bigint, bin bigint, w double, over double, n double"
        found = self._job(work, schema).groupBy("model", "node", "input", "bin").agg(*(F.sum(c).alias(c) for c in ("w", "over", "n"))).toArrow()  # nodes x inputs x bins at most
        model, node, input, bin, *sums = (found[c].to_numpy() for c in found.column_names)
        out = {(m, x): np.zeros((inputs, BINS + 1, 3)) for m, nodes in enumerate(open_nodes) for x in nodes}
        for key, hist in out.items():
            mine = (model == key[0]) & (node == key[1])
            hist[input[mine], bin[mine]] = np.stack([s[mine] for s in sums], 1)
        loss = [0.0] * len(quantiles)
        for m, a, b in zip(*(x[node == -1] for x in (model, *sums[:2]))):
            loss[m] = a / b if b else float("nan")
        return out, loss

    def leaf_quantiles(self, trees: Sequence[Tree | None]) -> dict[tuple[int, int], float]:
        """Per (model, leaf) the least training residual below or at which a share of at least the model's quantile of the leaf's weight lies."""
        quantiles = self.quantiles
        ranges: dict[tuple[int, int], tuple[float, float, float, float]] = {(m, leaf): (-np.inf, np.inf, 0.0, -1.0) for m, t in enumerate(trees) if t for leaf in t.leaves()}
        done: dict[tuple[int, int], float] = {}
        while ranges:
            told = dict(ranges)

            def work(parts, told=told):
                for bins, y, w, held, f in parts:
                    for m, tree in enumerate(trees):
                        if tree is None:
                            continue
                        low, high = np.full(len(tree.feature), np.inf), np.full(len(tree.feature), -np.inf)
                        for (k, leaf), r in told.items():
                            if k == m:
                                low[leaf], high[leaf] = r[0], r[1]
                        leaf, off = tree.leaf_of(bins), y - f[:, m]
                        rows = np.flatnonzero(~held & (off >= low[leaf]) & (off <= high[leaf]))
                        if not len(rows):
                            continue
                        leaf, off, weight = leaf[rows], off[rows], w[rows]
                        with np.errstate(invalid="ignore", divide="ignore"):
                            share = (off - low[leaf]) / (high[leaf] - low[leaf]) * SLICES
                        at = np.where(np.isfinite(low[leaf]) & (high[leaf] > low[leaf]), np.minimum(np.nan_to_num(share), SLICES - 1), 0).astype(np.int64)
                        key = leaf * SLICES + at
                        order = np.lexsort((off, key))
                        first = np.flatnonzero(np.diff(key[order], prepend=-1))
                        last = np.append(first[1:], len(order)) - 1
                        yield [np.full(len(first), m), key[order][first] // SLICES, key[order][first] % SLICES, np.add.reduceat(weight[order], first), off[order][first], off[order][last]]

            schema = "model bigint, leaf bigint, slice bigint, w double, low double, high double"
            found = self._job(work, schema).groupBy("model", "leaf", "slice").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("model", "leaf", "slice").collect()  # leaves x slices
            slices: dict[tuple[int, int], list] = {}
            for r in found:
                slices.setdefault((r["model"], r["leaf"]), []).append(r)
            for key in told:
                if key not in slices:
                    done[key] = 0.0
                    del ranges[key]
                    continue
                _, _, before, total = told[key]
                total = total if total >= 0 else sum(r["w"] for r in slices[key])
                goal = quantiles[key[0]] * total * (1 - _TINY)
                for r in slices[key]:
                    if before + r["w"] >= goal:
                        break
                    before += r["w"]
                if r["low"] == r["high"]:
                    done[key] = r["low"]
                    del ranges[key]
                else:
                    ranges[key] = (r["low"], r["high"], before, total)
        return done


def fit(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), *, quantiles: Sequence[float] = (0.1, 0.5, 0.9), target: str = "delay_seconds", weight: str | None = None, held: str | None = None, rounds: int = 200, patience: int = 20, rate: float = 0.05, depth: int = 5, least: int = 50, code: Coding | None = None) -> Boosted:
    """One model a quantile, all grown in the same jobs.

    weight: a column of row weights. held: a boolean column of rows that only decide when to stop: a model that hasn't become better for
    `patience` rounds is cut back to its best one. least: rows in a leaf. Rows without a target, or of no weight, take no part; columns
    that aren't there are left out. Without training rows all predictions are 0.
    """
    code = code or coding(rows, numeric, categorical)
    ordered = [True] * len(code.numeric) + [False] * len(code.categories)
    work = _Fit(rows, code, quantiles, target, weight, held)
    models = range(len(quantiles))
    roots = tuple(Tree() for _ in models)
    for (m, _), value in work.leaf_quantiles(roots).items():
        roots[m].value[0] = value
    work.advance(roots)
    trees: list[list[Tree]] = [[] for _ in models]
    losses: list[list[float]] = [[] for _ in models]
    best = [0] * len(quantiles)
    growing = set(models)

    def judged(loss: Sequence[float]) -> None:
        for m in list(growing):
            losses[m].append(loss[m])
            if loss[m] == loss[m] and loss[m] >= losses[m][best[m]]:
                if len(losses[m]) - 1 - best[m] >= patience:
                    growing.discard(m)
            else:
                best[m] = len(losses[m]) - 1

    for _ in range(rounds):
        new = [Tree() for _ in models]
        nodes = [[0] if m in growing else [] for m in models]
        for level in range(depth):
            found, loss = work.histograms(new, nodes)
            if not level:
                judged(loss)
                nodes = [x if m in growing else [] for m, x in zip(models, nodes)]
            after: list[list[int]] = [[] for _ in models]
            for m in models:
                for node in nodes[m]:
                    if cut := best_split(found[m, node], quantiles[m], ordered, least):
                        after[m] += new[m].split(node, cut[1], cut[2], cut[0])
            nodes = after
            if not any(nodes):
                break
        for m in models:
            if len(new[m].feature) == 1:
                growing.discard(m)  # no split is worth it
        if not growing:
            break
        for (m, leaf), value in work.leaf_quantiles([t if m in growing else None for m, t in zip(models, new)]).items():
            new[m].value[leaf] = rate * value
        for m in growing:
            trees[m].append(new[m])
        work.advance(tuple(t if m in growing else Tree() for m, t in zip(models, new)))
    else:
        judged(work.histograms([Tree() for _ in models], [[] for _ in models])[1])
    heard = any(x == x for x in losses[0]) if losses else False
    kept = [trees[m][: best[m]] if heard else trees[m] for m in models]
    return Boosted(code, tuple(quantiles), tuple(r.value[0] for r in roots), tuple(map(tuple, kept)), tuple(map(tuple, losses)) if heard else ())


def predict(model: Boosted, rows: DataFrame, names: Mapping[float, str]) -> DataFrame:
    """rows with a column for each quantile that is named. Inputs that rows lack, or that are null, are missing."""
    have = set(rows.columns)
    inputs = [(F.col(c) if c in have else F.lit(None)).cast("double" if c in model.coding.numeric else "string").alias(c) for c in model.coding.names]
    told = rows.select(*(F.col(f"`{c}`") for c in rows.columns), F.struct(*inputs).alias("_inputs"))
    at = [model.quantiles.index(q) for q in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(model.coding.bins(pa.RecordBatch.from_struct_array(batch.column("_inputs"))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(scores[:, i]) for i in at)], [*batch.schema.names[:-1], *names.values()])

    schema = StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name in names.values())])
    return told.mapInArrow(run, schema)


def importance(model: Boosted, quantile: float) -> list[tuple[str, float]]:
    """What share of the trees' gain each input has, the largest first."""
    total = dict.fromkeys(model.coding.names, 0.0)
    for t in model.trees[model.quantiles.index(quantile)]:
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                total[model.coding.names[f]] += g
    every = sum(total.values()) or 1.0
    return sorted(((n, g / every) for n, g in total.items()), key=lambda x: (-x[1], x[0]))


def to_json(model: Boosted) -> str:
    return json.dumps({"numeric": model.coding.numeric, "categories": model.coding.categories, "quantiles": model.quantiles, "start": model.start, "trees": [[vars(t) for t in trees] for trees in model.trees], "losses": model.losses})


def from_json(text: str) -> Boosted:
    d = json.loads(text)
    return Boosted(Coding(d["numeric"], d["categories"]), tuple(d["quantiles"]), tuple(d["start"]), tuple(tuple(Tree(**t) for t in trees) for trees in d["trees"]), tuple(map(tuple, d["losses"])))


def save(spark: SparkSession, model: Boosted, path: str, *, overwrite: bool = False) -> None:
    spark.createDataFrame([(to_json(model),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return from_json(spark.read.text(path, wholetext=True).first()[0])
