"""Source divergence audit: which terms, and which other sources, set each source of a language apart.

Terms are counted per (lang, source) and kept per language by document frequency. A group's count of a term and the language's
count give two smoothed shares p and q (parts of 10^9), and f = (p - q)^2 / (p + q), rounded down.

The terms of a group are found by an upper-bound search: within a bucket of equal counts p is the same and f falls as q rises, so
the least language share in a run of a bucket bounds f in all of it. Runs are evaluated best bound first until the next bound is
strictly below the k-th value. Sources are compared by the postings of blocks of terms: a term that neither source has adds
the same for all terms, so only terms with postings are gone through.

Groups and languages are dealt out by shards of terms whose number grows with their postings; per-shard results merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_string, materialize, raw_bytes, row_slices, table
from .word_spans import LOWER, byte_class, find_words

TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
#: Texts are counted in slices of about this many bytes before Spark adds up.
COUNT_BYTES = 4 << 20
#: Postings in a shard of a group (search) and of a language (comparison).
SEARCH_SHARD, PAIR_SHARD = 1 << 13, 1 << 16
#: Terms of equal count that are evaluated together.
RUN = 32
#: Sources of a language that are compared with as many others in one task.
SOURCE_BLOCK = 256
#: Numbers in a matrix of sources by terms.
CELLS = 1 << 20
#: Up to so many groups (some 200 bytes each) are told to the tasks by broadcast; beyond, by a join.
BROADCAST_ROWS = 50_000


def _told(df: DataFrame) -> DataFrame:
    """df (written) for a join: broadcast where it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), summed; and one row with a null term for each (lang, source).

    Null text, lang and source are ''. Repeated rows count as often as they are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column("text"))
            for start, end in row_slices(texts, COUNT_BYTES):
                data, at = raw_bytes(texts.slice(start, end - start))
                langs, sources = (as_string(batch.column(x)).slice(start, end - start).dictionary_encode() for x in ("lang", "source"))
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                groups, group = np.unique(group, return_inverse=True)
                words = find_words(data, at, TERM)
                _, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
                width = max(len(first), 1)
                in_doc, count = np.unique(words.row * width + word, return_counts=True)  # a document's terms
                key, of = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
                n, docs_with = np.bincount(of, count, len(key)).astype(np.int64), np.bincount(of, minlength=len(key))
                lower = LOWER[data].tobytes()
                terms = pa.array([lower[b:e].decode() for b, e in zip(words.start[first].tolist(), words.end[first].tolist())], pa.string())
                at_group = groups[np.concatenate([key // width, np.arange(len(groups))])]
                at_term = pa.array(np.concatenate([key % width, np.zeros(len(groups), np.int64)]), mask=np.arange(len(key) + len(groups)) >= len(key))
                zeros = np.zeros(len(groups), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.cast(pa.string()).take(pa.array(at_group // len(sources.dictionary))),
                        sources.dictionary.cast(pa.string()).take(pa.array(at_group % len(sources.dictionary))),
                        terms.take(at_term),
                        pa.array(np.concatenate([n, zeros])),
                        pa.array(np.concatenate([docs_with, zeros])),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, all_n (the language's count) and first (true for one source of each term) of the terms in at least `least` documents of the language.

    A term of a language has one row a source, so the windows are small; both run on one partitioning.
    """
    of_term = Window.partitionBy("lang", "term")
    rows = counts.where("term IS NOT NULL").withColumns({"all_n": F.sum("n").over(of_term), "all_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return rows.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "all_n", "first")


def groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Per (lang, source), with or without terms: size and rows (of kept terms), lang_size, lang_rows, terms (the language's V) and number (from 0 in the language, by source)."""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("rows"), F.count_if("first").alias("firsts"))
    every = counts.where("term IS NULL").select("lang", "source").join(by_group, ["lang", "source"], "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    return every.select(
        "lang", "source", "size", "rows", F.sum("size").over(of_lang).alias("lang_size"), F.sum("rows").over(of_lang).alias("lang_rows"),
        F.sum("firsts").over(of_lang).alias("terms"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"),
    )


def shares(count: np.ndarray, size: np.ndarray | int, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (size + 2 terms)), three digits at a time: exact while a language has fewer than 9 * 10^15 words."""
    below, rest = np.asarray(size, np.int64) + 2 * np.asarray(terms, np.int64), np.asarray(count, np.int64) + 2
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


def search_terms(n: np.ndarray, all_n: np.ndarray, names: list[str], size: int, lang_size: int, terms: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The k terms of greatest f with p > q (all, if fewer) by value, then name, and their values."""
    order = np.lexsort((all_n, n))
    bucket = np.ones(len(n), bool)
    bucket[1:] = n[order][1:] != n[order][:-1]
    head = np.flatnonzero(bucket)
    within = np.arange(len(n)) - np.repeat(head, np.diff(np.append(head, len(n))))
    run = np.flatnonzero(within % RUN == 0)  # a run: terms of one count, language counts ascending
    p, q = shares(n[order[run]], size, terms), shares(all_n[order[run]], lang_size, terms)
    bound = np.where(p > q, divergence(p, q), -1)
    ends = np.append(run, len(n))
    best: list[tuple[int, str, int]] = []
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] < 0 or len(best) == k and bound[i] < -best[-1][0]:
            break
        members = order[ends[i] : ends[i + 1]]
        q = shares(all_n[members], lang_size, terms)
        value = divergence(p[i], q)
        best += [(-int(v), names[m], int(m)) for v, m in zip(value[q < p[i]], members[q < p[i]])]
        best = sorted(best)[:k]
    return np.array([m for _, _, m in best], np.int64), np.array([-v for v, _, _ in best], np.int64)


def top_terms(kept: DataFrame, known: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value: at least the k best terms of each group (each shard's)."""

    def run(group: pa.Table) -> pa.Table:
        one = {x: group[x][0].as_py() for x in ("lang", "source", "size", "lang_size", "terms")}
        n, all_n = group["n"].to_numpy(), group["all_n"].to_numpy()
        at, value = search_terms(n, all_n, group["term"].to_pylist(), one["size"], one["lang_size"], one["terms"], k)
        return pa.table({"lang": pa.array([one["lang"]] * len(at), pa.string()), "source": pa.array([one["source"]] * len(at), pa.string()), "item": group["term"].take(pa.array(at)), "value": pa.array(value)})

    shards = F.ceil(F.col("rows") / SEARCH_SHARD)
    dealt = kept.drop("first").join(_told(known.select("lang", "source", "size", "rows", "lang_size", "terms")), ["lang", "source"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("term"), shards)).drop("rows")
    return dealt.groupBy("lang", "source", "shard").applyInArrow(run, "lang string, source string, item string, value bigint")


def compare(number: np.ndarray, source: np.ndarray, term: np.ndarray, n: np.ndarray, sizes: dict[int, int], terms: int, here: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sources (numbers, ascending) and postings (place of the source, term, count): each source, those after it, and the sums of f over the `here` terms of a shard."""
    nothing = shares(np.zeros(len(number), np.int64), np.array([sizes[x] for x in number.tolist()], np.int64), terms)
    p = shares(n, np.array([sizes[x] for x in number.tolist()], np.int64)[source], terms)
    _, term = np.unique(term, return_inverse=True)
    found = int(term.max(initial=-1)) + 1
    total = {i: divergence(nothing[i], nothing[i + 1 :]) * (here - found) for i in range(len(number) - 1)}
    order = np.argsort(term, kind="stable")
    step = max(1, CELLS // max(1, len(number)))
    for begin in range(0, found, step):
        rows = order[slice(*np.searchsorted(term[order], [begin, begin + step]))]
        matrix = np.repeat(nothing[:, None], min(step, found - begin), axis=1)
        matrix[source[rows], term[rows] - begin] = p[rows]
        for i in total:
            total[i] = total[i] + divergence(matrix[i], matrix[i + 1 :]).sum(1)
    for i, value in total.items():
        yield int(number[i]), number[i + 1 :], value


def source_pairs(kept: DataFrame, known: DataFrame) -> DataFrame:
    """lang, number, other (number < other), value: the sum of f over the language's terms for all pairs of its sources.

    Terms are dealt out in shards, sources in tiles of two blocks. A row without a term tells each tile each of its sources and
    how many terms the shard has, so sources without postings are there too.
    """

    def run(group: pa.Table) -> pa.Table:
        head = group.filter(pc.is_null(group["term"]))
        rows = group.filter(pc.is_valid(group["term"]))
        lang, terms, here = (head[x][0].as_py() for x in ("lang", "terms", "here"))
        number = np.sort(head["number"].to_numpy())
        sizes = dict(zip(head["number"].to_pylist(), head["size"].to_pylist()))
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block = {x: group[x][0].as_py() for x in ("low", "high")}
        one, other, value = [], [], []
        for first, after, sums in compare(number, np.searchsorted(number, rows["number"].to_numpy()), term, rows["n"].to_numpy(), sizes, terms, here):
            mine = (first // SOURCE_BLOCK == block["low"]) & (after // SOURCE_BLOCK == block["high"])
            one.append(np.full(int(mine.sum()), first))
            other.append(after[mine])
            value.append(sums[mine])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"lang": pa.array([lang] * sum(map(len, one)), pa.string()), "number": pa.array(cat(one), pa.int64()), "other": pa.array(cat(other), pa.int64()), "value": pa.array(cat(value), pa.int64())})

    told = _told(known.select("lang", "source", "size", "lang_rows", "terms", F.col("number").cast("bigint").alias("number")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / PAIR_SHARD))
    dealt = kept.join(told, ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), shards))
    dealt = dealt.select("lang", "shard", "number", "size", "terms", "term", "n", "first")
    here = materialize(dealt.where("first").groupBy("lang", "shard").agg(F.count("*").alias("here")), "shards")
    by_lang = known.groupBy("lang").agg(F.max("number").alias("last"))
    heads = known.select("lang", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / PAIR_SHARD)) - 1)).alias("shard"), F.col("number").cast("bigint").alias("number"), "size", "terms")
    heads = heads.join(here, ["lang", "shard"], "left").na.fill(0, ["here"])
    columns = ["lang", "shard", "number", "size", "terms", "term", "n", "here"]
    rows = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0)}).select(columns).unionAll(dealt.withColumn("here", F.lit(0)).select(columns))
    mine = F.floor(F.col("number") / SOURCE_BLOCK)
    met = rows.join(_told(materialize(by_lang, "langs")), "lang").withColumn("with", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / SOURCE_BLOCK))))
    met = met.withColumns({"low": F.least(mine, "with"), "high": F.greatest(mine, "with")}).drop("with", "last")
    tiles = met.groupBy("lang", "shard", "low", "high").applyInArrow(run, "lang string, number bigint, other bigint, value bigint")
    return tiles.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source), part 'pair' all other sources of the language, part 'term' the best `top` terms.

    Ranks go by value (descending) and item (UTF-8, ascending). Null text, lang and source are ''. A language without kept terms
    has pairs of value 0 and no terms; a language of one source has no pairs. Repeated rows count each; other columns aren't
    read; an empty table gives an empty result.
    """
    counts = materialize(term_counts(docs), "counts")
    kept = materialize(postings(counts, least), "postings")
    known = materialize(groups(counts, kept), "groups")
    one = materialize(source_pairs(kept, known), "pairs")
    names = known.select("lang", F.col("number").cast("bigint").alias("number"), "source")
    both = one.unionAll(one.select("lang", F.col("other").alias("number"), F.col("number").alias("other"), "value"))
    both = both.join(_told(names), ["lang", "number"]).join(_told(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))), ["lang", "other"])
    found = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    found = found.unionAll(top_terms(kept, known, top).select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents, terms to rank 10 (see audit)."""
    return audit(table(spark, sf_dir, "documents"))
