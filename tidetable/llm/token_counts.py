"""Token counts by separator scan.

A token store is flat: shards of 16-bit token ids in blocks of a fixed size, documents following
each other with nothing but an end-of-document id between them, no index. Counting scans each
block on its own: one vectorised search for the separator gives the tokens before the block's
first separator, between separators, and after the last. A prefix scan over a shard's blocks
then stitches what blocks cut: it numbers the documents, and adds to a block's first document
the tokens that earlier blocks hold of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_string, materialize, row_slices, table

END_ID = 50256
#: Tokens a block; a shard's last block may be shorter.
BLOCK = 1 << 18
_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE without special tokens, from a file of ranks (base64 bytes, rank)."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_flat(docs: DataFrame, ranks: str, *, end_id: int = END_ID, block: int = BLOCK, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The flat store of docs: shard, kind, number, data.

    kind 0: block `number` of the shard, little-endian unsigned 16-bit ids. kind 1: the shard's manifest, the ids of its
    documents in order (from the document `number` on: 64-bit ids, then a byte each that is 0 where the id is null), so that
    counts can be told to documents. Each task writes
    one shard; a shard's blocks are cut without regard to documents. A null text is empty: its document is a separator alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(ranks).encode_ordinary
        held = np.empty(block, "<u2")
        n = blocks = documents = 0

        def row(kind: int, number: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["shard", "kind", "number", "data"])

        for batch in batches:
            texts = as_string(batch.column(1))
            for lo, hi in row_slices(texts):
                for value in texts.slice(lo, hi - lo).to_pylist():
                    ids = np.array([*encode(value), end_id], "<u2")
                    at = 0
                    while at < len(ids):
                        part = ids[at : at + block - n]
                        held[n : n + len(part)] = part
                        n, at = n + len(part), at + len(part)
                        if n == block:
                            yield row(0, blocks, held.tobytes())
                            n, blocks = 0, blocks + 1
            yield row(1, documents, manifest(batch.column(0).cast(pa.int64())))
            documents += batch.num_rows
        if n:
            yield row(0, blocks, held[:n].tobytes())

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "shard int, kind int, number bigint, data binary")


def manifest(ids: pa.Array) -> bytes:
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()


def read_manifest(data: bytes) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data, "<i8", n), pa.int64(), mask=np.frombuffer(data, np.uint8, n, 8 * n) == 0)


def scan_block(ids: np.ndarray, end_id: int = END_ID) -> tuple[int, int, list[int]]:
    """(tokens before the first separator, tokens after the last, tokens of each document that begins and ends inside). Without a separator: (all, 0, [])."""
    at = np.flatnonzero(ids == end_id)
    if not len(at):
        return len(ids), 0, []
    return int(at[0]), int(len(ids) - 1 - at[-1]), (np.diff(at) - 1).tolist()


def count_documents(blocks: DataFrame, *, end_id: int = END_ID) -> DataFrame:
    """shard, ordinal, n_tokens of every document in flat blocks (shard, number, data): separators are not counted.

    A shard's last document needs no separator after it; without tokens there it is not a document. Blocks of a shard must be numbered in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, inner, ends = [], [], [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", "<u2")
                head, tail, inside = scan_block(ids, end_id)
                ends.append(len(inside) + 1 if len(inside) or (ids == end_id).any() else 0)
                heads.append(head)
                tails.append(tail)
                inner.append(inside)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("number"), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(ends, pa.int64())],
                ["shard", "number", "head", "tail", "inner", "ends"],
            )

    scanned = blocks.select("shard", "number", "data").mapInArrow(run, "shard int, number bigint, head bigint, tail bigint, inner array<bigint>, ends bigint")
    # Prefix scan over a shard's blocks. ended: documents ended before this block. Tokens of the document that is open at
    # its start: the tail of the last block with a separator, and the blocks without one since then.
    order = Window.partitionBy("shard").orderBy("number")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    has_end = F.col("ends") > 0
    solid = F.when(has_end, F.lit(0)).otherwise(F.col("head"))
    stitched = scanned.select("*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"), F.coalesce(F.sum(solid).over(before), F.lit(0)).alias("_total"), F.sum(solid).over(upto).alias("_whole"))
    stitched = stitched.withColumn("_from", F.last(F.when(has_end, F.struct("tail", "_whole")), ignorenulls=True).over(before))
    carry = F.col("_total") + F.coalesce(F.col("_from.tail") - F.col("_from._whole"), F.lit(0))
    stitched = stitched.withColumn("carry", carry).withColumn("is_last", F.lead("number").over(order).isNull())
    first = F.array(F.col("carry") + F.col("head"))
    open_end = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    lengths = F.when(F.col("ends") > 0, F.concat(first, F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    lengths = F.when(F.col("is_last") & (open_end > 0), F.concat(lengths, F.array(open_end))).otherwise(lengths)
    return stitched.select("shard", "ended", F.posexplode(lengths).alias("_at", "n_tokens")).select("shard", (F.col("ended") + F.col("_at")).alias("ordinal"), "n_tokens")


def document_counts(docs: DataFrame, ranks: str, *, end_id: int = END_ID, block: int = BLOCK, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, shard, ordinal, n_tokens of every row, read back from the flat store of its text.

    Null ids stay null, null and empty texts count 0, repeated rows count each; an empty table gives an empty result, and other
    columns play no part.
    """
    store = materialize(write_flat(docs, ranks, end_id=end_id, block=block, text=text, id=id), "tokens")
    counts = count_documents(store.where("kind = 0"), end_id=end_id)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "number", "data"))):
                ids = read_manifest(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard), pa.int32()), pa.array(number + np.arange(len(ids))), ids], ["shard", "ordinal", "doc_id"])

    named = store.where("kind = 1").select("shard", "number", "data").mapInArrow(names, "shard int, ordinal bigint, doc_id bigint")
    return named.join(counts, ["shard", "ordinal"]).select(F.col("doc_id").alias(id), "shard", "ordinal", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, shard, ordinal, n_tokens, read back from the flat store of all documents."""
    import public_tokenizers

    return document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
