"""Sequence packing by minimum bin slack.

Documents become token ids with an end id and are cut at multiples of the capacity; what is
left of each document (its remainder) is packed with others. The packing works on the multiset
of remainder lengths alone: at most `capacity` counts, whatever the corpus holds. Each window
starts from the longest remaining length; a bitset subset-sum over the other lengths (with
their counts) finds the fill closest to the capacity, and backtracking gives how often each
length is used. A pattern is applied as often as the counts allow, so the plan is a short list
of runs. Pieces find their place by their rank among the pieces of their length; ranks are
counted in hash buckets first, so a length that a third of the corpus shares is no hot key.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_string, materialize, row_slices, table, tidied

CAPACITY = 2048
END_ID = 1
#: Remembered words: a generation is closed at so many bytes, and there are two at most. What a word takes beside its letters and ids.
CACHE_BYTES, WORD_BYTES = 24 << 20, 250


@dataclass(frozen=True)
class Run:
    """`times` sequences in a row, from `first`, each filled by `counts` = ((length, how many), ...)."""

    first: int
    times: int
    counts: tuple[tuple[int, int], ...]


def best_fill(room: int, counts: dict[int, int]) -> tuple[tuple[int, int], ...]:
    """The multiset of lengths (at most counts[length] of each) whose sum is as near to room as it can be without passing it.

    reach has bit s set when some multiset sums to s. Each step adds one length with a power-of-two
    share of its count (so that all counts are reachable), and remembers the set before it; going
    back through the steps recovers the counts. Ends early when room itself is reached.
    """
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            share = min(share, left)
            steps.append((length, share, reach))
            reach |= reach << length * share & mask
            left -= share
            share *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, share, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + share
            total -= length * share
    return tuple(sorted(used.items(), reverse=True))


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Minimum bin slack over a histogram of lengths in 1..capacity."""
    left = {k: v for k, v in histogram.items() if v}
    if any(not 1 <= k <= capacity for k in left):
        raise ValueError("lengths must lie in 1..capacity")
    runs, first = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        fill = dict(best_fill(capacity - seed, {k: v for k, v in left.items() if v}))
        left[seed] += 1
        fill[seed] = fill.get(seed, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        runs.append(Run(first, times, tuple(sorted(fill.items(), reverse=True))))
        first += times
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return runs


#: Byte-level alphabet: bytes that aren't printable stand for the characters from 256 on, in order.
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: A lone comma or full stop between a letter and white space: a token of its own. (Letters of Latin-1 only: others may lower-case
#: to more than letters, and stay with their comma.)
_LONE = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([,.])([ \n]|$)"
#: What added tokens begin with. They are matched on the raw text, before lower-casing.
_ADDED = "<|"
#: What a tokenizer must do for its texts to be cut at spaces: the parts of its file that say so.
_WORD_BOUND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Ids of texts as their tokenizer gives them, with the ids of words remembered.

    A tokenizer that is word-bound (it lower-cases, its tokens never reach across a space or a line feed, it drops both, and parts
    letters from punctuation) has texts cut there and each word encoded once. Any other one encodes whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        parts = {k: json.loads(x.__getstate__()) if (x := getattr(self.tokenizer, k)) is not None else None for k in _WORD_BOUND}
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = all(t.content.startswith(_ADDED) and " " not in t.content and "\n" not in t.content and not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in added)
        model = self.tokenizer.model
        self.word_bound = parts == _WORD_BOUND and plain and isinstance(model, BPE) and not model.dropout and not model.ignore_merges
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of young

    @staticmethod
    def lower(text: str) -> str:
        """text in lower case where that changes no id: letters of Latin-1, or of ASCII in a text that has others; none where an added
        token may stand or a composed letter could come of it. What stays as it was is lower-cased by the tokenizer."""
        if _ADDED in text:
            return text
        try:
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            pass
        low = text.encode().lower().decode()
        return low if is_normalized("NFC", text) and is_normalized("NFC", low) else text

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.word_bound:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # words of all texts by number: each different one is looked up once, and the ids are put together as arrays
        parted = pc.replace_substring_regex(pa.array([self.lower(t) for t in texts], pa.large_string()), _LONE, r"\1 \2\3")
        cut = pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")
        numbered = cut.flatten().dictionary_encode()
        words, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if (got := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = got
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in new:
            # one run of small letters that normalising leaves alone: the model can have it as it is, in the byte alphabet
            if w.isascii():
                if w.isalpha() and w.islower():
                    young[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
                    continue
            elif max(w) < "\u0250" and w.isalpha() and w == w.lower():
                young[w] = array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(_BYTES))]).tobytes()
                continue
            rest.append(w)
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                young[w] = array("I", e.ids).tobytes()
        found = [young[w] for w in words]
        every, size = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        begin, length = (np.cumsum(size) - size)[at], size[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = every[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        text_ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(text_ends, text_ends[1:])]
        self.held += sum(len(w) + len(young[w]) + WORD_BYTES for w in new)
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return out

    def forget(self) -> None:
        """Lets the remembered words go."""
        self.young, self.old, self.held = {}, {}, 0


_word_ids: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each document's ids and end_id, cut at multiples of capacity.

    Returns id, start, length, ids (little-endian unsigned 32-bit), doc_tokens. A null text is empty: its
    document is end_id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _word_ids:
            _word_ids[tokenizer] = WordIds(tokenizer)
        encode, end, step = _word_ids[tokenizer], np.array([end_id], "<u4").tobytes(), capacity * 4
        try:
            for batch in batches:
                yield from pieces_of(batch, encode, end, step)
        finally:
            _word_ids.pop(tokenizer, None)
            encode.forget()

    def pieces_of(batch: pa.RecordBatch, encode: WordIds, end: bytes, step: int) -> Iterator[pa.RecordBatch]:
        texts = as_string(batch.column(1))
        names = batch.column(0)
        rows, starts, lengths, ids, totals = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [names.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], ["id", "start", "length", "ids", "doc_tokens"]
            )
            for x in (rows, starts, lengths, ids, totals):
                x.clear()
            return out

        for lo, hi in row_slices(texts):
            for i, whole in enumerate(encode(texts.slice(lo, hi - lo).to_pylist()), lo):
                whole += end
                for at in range(0, len(whole), step):
                    piece = whole[at : at + step]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    ids.append(piece)
                    totals.append(len(whole) // 4)
            yield flush()

    picked = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(tidied(run), f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint").withColumnRenamed("id", id)


def assign(pieces: DataFrame, *, order_by: tuple[str, ...], capacity: int = CAPACITY, buckets: int = 1024, bucket_rows: int = 1 << 16) -> DataFrame:
    """pieces with sequence_id and offset. pieces: any table with a long `length` in 1..capacity; read more than once, so pass a written one.

    order_by: columns that tell pieces apart (pieces alike in all of them may swap places, to the same result).
    There are `buckets` of each length at least, and as many as hold about `bucket_rows` pieces if all had one length.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    buckets = max(buckets, pieces.count() // bucket_rows)
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    sizes = marked.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    rows = []
    seen: dict[int, int] = {}
    for run in plan_runs(histogram, capacity):
        at = 0
        for length, n in run.counts:
            rows.append((length, seen.get(length, 0), n * run.times, run.first, n, at))
            seen[length] = seen.get(length, 0) + n * run.times
            at += length * n
    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "_from", "_span", "_first", "_each", "_at")])
    plan = spark.createDataFrame(rows, schema)
    # a length's runs as one sorted array: looking a rank up is then no join of ranges
    runs = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_span", "_first", "_each", "_at"))).alias("_runs"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_bucket", "_before")
    local = Window.partitionBy("length", "_bucket").orderBy(*order_by)
    ranked = marked.withColumn("_i", F.row_number().over(local) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_i")).join(F.broadcast(runs), "length")  # runs: bounded by the plan, at most a few times capacity
    ranked = ranked.withColumn("_run", F.element_at(F.filter("_runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_from"] + r["_span"])), 1))
    inside = F.col("_rank") - F.col("_run._from")
    return ranked.select(
        *pieces.columns,
        (F.col("_run._first") + F.floor(inside / F.col("_run._each"))).cast("bigint").alias("sequence_id"),
        (F.col("_run._at") + (inside % F.col("_run._each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Packed pieces with their ids: id, start, length, ids, doc_tokens, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, text=text, id=id), "pieces")
    return assign(pieces, order_by=(id, "start", "doc_tokens", "ids"), capacity=capacity)


def packed_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces by place, with a checksum in place of the ids (taken before the pieces are dealt out, so ids aren't shuffled)."""
    pieces = token_pieces(docs.select("doc_id", "text"), tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    placed = assign(materialize(pieces, "pieces"), order_by=("doc_id", "start", "doc_tokens", "ids_crc32"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence and offset (see assign), with checksums of their ids."""
    return packed_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
