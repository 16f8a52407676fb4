"""Benchmark decontamination with an FM-index per shard of the documents.

Benchmark items are cut into phrases (windows of consecutive words). Each task indexes its texts in shards of a bounded number
of words; all phrases are searched backwards in a shard at once, their places come from sampled suffix positions, and the
words they cover are merged to removal spans. Documents are never shuffled: the only thing told to the tasks is the phrases, in blocks
of a fixed size, each of which meets the index that is already built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string, materialize, raw_bytes, row_slices, table
from .fm_index import FmIndex
from .word_spans import byte_class, find_words

WINDOW = 10
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words a shard holds at most; a longer text is cut, with an overlap in which every phrase fits.
SHARD_WORDS = 1_000_000
#: Phrases (with their item) in a block that is told to the tasks: some 25 MB at ten words each.
BLOCK_PHRASES = 1 << 18


def phrases(items: DataFrame, *, window: int = WINDOW, id: str = "item_id", text: str = "text") -> DataFrame:
    """item (string), words (a hash of each): the distinct windows of every item; an item of fewer words, but not none, is one window.

    Items of one id count as one. An item without an id is searched too, but can't be named. Null and empty texts have no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(1))
            for start, end in row_slices(texts):
                words = find_words(*raw_bytes(texts.slice(start, end - start)), WORD)
                if not len(words):
                    continue
                count = np.bincount(words.row, minlength=end - start)
                first = np.cumsum(count) - count
                width = np.minimum(count, window)
                many = np.where(count > 0, count - width + 1, 0)
                row = np.repeat(np.arange(end - start), many)
                begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                size = width[row]
                upto = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(upto[-1]) - np.repeat(upto[:-1], size) + np.repeat(begin, size)
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(words.hash[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).take(pa.array(row)), lists], ["item", "words"])

    rows = items.select(F.col(id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, words array<bigint>").distinct()


@dataclass(frozen=True)
class Block:
    """Distinct phrases: words ascending; reversed_phrases: places in words, last word first, -1 beyond the end;
    size of each; items of phrase i: items[item_at[i] : item_at[i + 1]], places in names (-1: no id)."""

    words: np.ndarray
    reversed_phrases: np.ndarray
    size: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: tuple[str, ...]


def _block(rows: pa.Table) -> Block:
    lists = rows["words"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words, place = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    wide = np.full((len(size), int(size.max(initial=0))), -1, np.int64)
    first = np.cumsum(size) - size
    back = np.repeat(first + size - 1, size) - np.arange(int(size.sum()))
    wide[np.repeat(np.arange(len(size)), size), back] = place
    distinct, of = np.unique(wide, axis=0, return_inverse=True)
    of = of.reshape(-1)
    ids = rows["item"].to_pylist()
    names = tuple(sorted({x for x in ids if x is not None}))
    number = {x: i for i, x in enumerate(names)} | {None: -1}
    order = np.argsort(of, kind="stable")
    items = np.array([number[ids[i]] for i in order], np.int64)
    return Block(words, distinct, (distinct >= 0).sum(1), np.searchsorted(of[order], np.arange(len(distinct) + 1)), items, names)


def blocks(found: DataFrame, limit: int = BLOCK_PHRASES) -> Iterator[Block]:
    """The phrases (a written table) in blocks of about limit rows, one after the other: the driver holds one at a time."""
    count = max(1, -(-found.count() // limit))
    for i in range(count):
        rows = found.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == i) if count > 1 else found
        yield _block(rows.select("item", "words").toArrow())


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges low to high, and the range of each."""
    count = high - low
    of = np.repeat(np.arange(len(low)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of], of


def occurrences(index: FmIndex, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of the block occur: the number of the first word, and the phrase."""
    symbols = np.append(index.symbols(block.words), -1)  # place -1: beyond the end
    low, high = index.search(symbols[block.reversed_phrases])
    rows, of = _ranges(low, high)
    return index.locate(rows), of


def _spans(covered: np.ndarray, words, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, start and end in code points of each run of covered words of one text."""
    new = covered.copy()
    new[1:] &= ~covered[:-1] | (words.row[1:] != words.row[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (words.row[1:] != words.row[:-1])
    begin, end = np.flatnonzero(new), np.flatnonzero(last)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = words.row[begin]
    return row, points[words.start[begin]] - points[at[row]], points[words.end[end]] - points[at[row]]


def _lists(row: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    """One list for each of count rows; row ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(count + 1)), pa.int32()), values)


def find(docs: DataFrame, found: DataFrame, *, id: str = "doc_id", text: str = "text", block: int = BLOCK_PHRASES, shard: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a phrase), spans (start and end in code points, merged) and items (ascending).

    found comes from phrases and is read more than once, so pass a written table. Every row is searched by itself, so repeated rows
    and ids give equal rows and null ids stay null; null, empty and wordless texts have no words, spans or items. Other columns
    aren't read. A text of any length is searched whole, in overlapping shards. Without phrases nothing is hit.
    """
    spark = docs.sparkSession
    told = [spark.sparkContext.broadcast(b) for b in blocks(found, block)]
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def search(data: np.ndarray, at: np.ndarray, n: int) -> list[pa.Array]:
        words = find_words(data, at, WORD)
        edges = np.zeros(len(words) + 1, np.int32)  # +1 where an occurrence begins, -1 behind its end
        named: list[set[str]] = [set() for _ in range(n)]
        start, overlap = 0, max((b.value.reversed_phrases.shape[1] for b in told), default=1) - 1
        while start < len(words):
            part = slice(start, start + max(shard, 2 * overlap + 1))
            index = FmIndex(words.hash[part], words.row[part])
            for b in (x.value for x in told):
                if not len(b.size):
                    continue
                first, phrase = occurrences(index, b)
                np.add.at(edges, first + start, 1)
                np.add.at(edges, first + start + b.size[phrase], -1)
                pairs, of = _ranges(b.item_at[phrase], b.item_at[phrase + 1])
                width = len(b.names) + 1
                for key in np.unique(words.row[first[of] + start] * width + b.items[pairs] + 1).tolist():
                    if key % width:
                        named[key // width].add(b.names[key % width - 1])
            if part.stop >= len(words):
                break
            start = part.stop - overlap
        covered = np.cumsum(edges)[:-1] > 0
        row, begin, end = _spans(covered, words, data, at)
        return [
            pa.array(np.bincount(words.row, minlength=n)),
            pa.array(np.bincount(words.row[covered], minlength=n)),
            _lists(row, n, pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], fields=list(span_type))),
            pa.array([sorted(x) for x in named], pa.list_(pa.string())),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(1))
            for start, end in row_slices(texts):
                columns = search(*raw_bytes(texts.slice(start, end - start)), end - start)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], ["doc_id", "n_words", "n_hit", "spans", "items"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>")


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words inside windows of 10 words of a benchmark item, and the items that it has windows of (see find)."""
    windows = materialize(phrases(table(spark, sf_dir, "benchmark")), "phrases")
    found = find(table(spark, sf_dir, "documents"), windows)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
