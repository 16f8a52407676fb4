"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetable.llm import jaccard_join, mixing, packing, quality, secret_scan
from tidetable.llm.common import materialize, table

#: Up to so many removed ids (8 bytes each) or sources are told to the scan of the documents by broadcast; beyond, by a join.
BROADCAST_ROWS = 1_000_000


def _told(df: DataFrame) -> DataFrame:
    """df for a join: broadcast where it is short. df must be written."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _row(docs: DataFrame):
    """The whole row as one column, so that no name of a stage's own can meet one of the documents'."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, with all their columns as they were.

    Each row is judged by itself: a null text is an empty one, null metadata is a value of its own, repeated rows stay or go
    together, a score of just ACCEPT stays. Where the labels don't have both classes among the documents, all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(spark, model) >= quality.ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, which names the group.

    Texts aren't moved: the removed ids are told to the scan, and rows that share an id are settled apart: of those in the group
    that their id names, the one with the least print and text stays. A document without words is in no group and stays, as does
    one without an id.
    """
    found = materialize(jaccard_join.near_duplicates(docs, prints=True), "groups")
    repeated = materialize(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    removed = materialize(found.where("doc_id <> component_id").select("doc_id").unionAll(repeated).distinct(), "removed")
    kept = docs.join(_told(removed), "doc_id", "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return kept
    again = docs.join(_told(repeated), "doc_id", "left_semi").select(_row(docs), "doc_id", F.md5("text").alias("sum"), jaccard_join.print_column().alias("print"))
    groups = found.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(F.col("n_shingles").alias("n"), "fp").alias("print"), "node", "component_id").distinct()
    named = again.join(groups, ["doc_id", "print"])
    best = F.min_by("row", F.struct("print", "sum")).alias("row")
    one = named.where("print.n > 0 AND component_id = doc_id").groupBy("doc_id", "node").agg(best)
    return kept.unionByName(one.select("row.*")).unionByName(named.where("print.n = 0").select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by a mark; n_chars follows the text.

    Null and empty texts stay so; repeated rows are changed alike; other columns are untouched.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times), sources at weights 1, 2, 3 in turn.

    A source's documents are taken in the order of a hash of id and text, up to one place: told that, each row knows its own times,
    and texts aren't moved. Rows alike in id and text share a place; where the mix ends inside of them, the first ones, as the scan
    has them, are taken once more. A null source is one of its own; documents without words are never taken.
    """
    mixed = materialize(mixing.mix(materialize(mixing.sizes(docs), "sizes")).select("source", "size", "place", "times"), "times")
    cuts = materialize(mixing.cuts(mixed), "cuts")
    rows = docs.where(F.col("text").rlike(mixing.WORD)).select(_row(docs), mixing.source_key("source").alias("key"), mixing.place("doc_id", "text").alias("place"))
    rows = rows.join(_told(cuts), "key")
    more = F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    shared = F.coalesce((F.col("place") == F.col("last")) & (F.col("more") < F.col("tied")), F.lit(False))
    taken = rows.where(~shared).select("row", (F.col("base") + more).alias("times"))
    if cuts.where("more < tied").limit(1).count():
        taken = taken.unionAll(_first_ones(rows.where(shared)))
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _first_ones(rows: DataFrame) -> DataFrame:
    """row and times of rows that share a place: numbered within each written part first, so that they are never together in one task."""
    parts = materialize(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "shared")
    upto = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("place", "part").agg(F.count("*").alias("rows")).select("place", "part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("place", "part").orderBy("at")) + F.col("before")
    return parts.join(before, ["place", "part"]).select("row", (F.col("base") + (nth <= F.col("more")).cast("int")).alias("times"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is a piece of its end id alone; each repeated row is packed; rows alike in all may swap places.
    """
    return packing.packed_digest(docs, packing.tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the redaction and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
