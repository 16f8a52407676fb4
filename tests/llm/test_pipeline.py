import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import ODD, brute, check_packing, near_rows
from tidetable.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs, SF)
        if name != "packing":
            assert rows.columns == docs.columns
        rows = pipeline.materialize(rows, name)
        found.append((docs, rows))
        docs = rows
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_quality_stage_follows_labels(spark, outputs):
    before, after = outputs[0]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(after))
    judged = [d for d in texts(before) if d in label]
    assert sum((d in kept) == (label[d] == 1) for d in judged) / len(judged) > 0.95


def test_one_of_each_group_stays(outputs):
    before, after = map(texts, outputs[1])
    groups = {d: (n, c) for d, n, c in brute(list(before.items()))}
    assert set(after) == {d for d, (n, c) in groups.items() if c == d}


def test_mix_repeats_whole_documents(outputs):
    before, after = outputs[3]
    known = texts(before)
    rows = after.collect()
    assert all(known[r["doc_id"]] == r["text"] for r in rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert 0.9 * sum(map(words, known.values())) < sum(words(r["text"]) for r in rows) <= sum(map(words, known.values()))


def test_packed_sequences(outputs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    before, after = outputs[4]
    expected = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts(before).items()}
    room, pieces = check_packing(after.collect(), expected)
    total = sum(len(expected[r["doc_id"]]) for r in before.collect())
    assert sum(k[2] * n for k, n in pieces.items()) == total and room - total < 0.05 * total + 2048


def test_stages_take_odd_rows(spark, docs):
    rows = [*ODD, *((d, t, "en", "a", 1) for d, t in near_rows()[:30] if d is not None)]
    df = pipeline.materialize(docs(rows), "odd")
    for name, stage in pipeline.STAGES:
        df = pipeline.materialize(stage(spark, df, SF), name)
    assert df.count() > 0
    empty = docs([])
    for name, stage in pipeline.STAGES:
        empty = pipeline.materialize(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_rows_of_one_id(spark, docs):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, "other words stand in this one", "en", "a", 1), (1, None, "en", "a", 0), (2, long + " x", "en", "a", 1), (3, "alone here", "en", "a", 1), (None, long, "en", "a", 1)]
    got = pipeline.drop_near_duplicates(spark, docs(rows), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, long), (1, rows[2][1]), (1, None), (3, "alone here"), (None, long)], key=str)


def test_repeated_rows_share_the_mix(spark, docs):
    rows = [(1, "a b c", "en", "x", 5)] * 3 + [(2, "d e f g h i", "en", "y", 5), (3, None, "en", None, 0)]
    got = [(r["doc_id"], r["text"]) for r in pipeline.mix_sources(spark, docs(rows), SF).collect()]
    words = sum(len(t.split()) for _, t in got)
    assert 9 <= words <= 15 and set(got) <= {(1, "a b c"), (2, "d e f g h i")}


def test_names_of_the_stages_own(spark):
    """Columns named like the stages' own come back as they were."""
    names = "_id _place _times _copy _text _secrets _quality _in_text _n _fp _node _least _row row key place times print sum changed base last tied more part at kind id n fp t".split()
    source = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    df = source.unionByName(source.where("doc_id < 5")).select("*", *(pipeline.F.concat(pipeline.F.lit(c), pipeline.F.col("doc_id")).alias(c) for c in names))
    for name, stage in pipeline.STAGES[:-1]:
        columns = df.columns
        df = pipeline.materialize(stage(spark, df, SF), name)
        assert df.columns == columns
        assert not df.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count()
    assert df.count() and stage_packs(spark, df)


def stage_packs(spark, df):
    return pipeline.pack_sequences(spark, df, SF).count() > 0


def test_a_place_shared_by_many_rows_is_split(spark, docs):
    rows = [(None, "a b c d", "en", "x", 5)] * 50 + [(2, "".join("wxyz" * 30), "en", "y", 5)]
    df = pipeline.materialize(docs(rows).repartition(4), "hot")
    got = [r["text"] for r in pipeline.mix_sources(spark, df, SF).collect()]
    total = 200 + 1
    # weights 1 and 2: the second source stops at 3 times its one word, the first takes the rest
    assert got.count("a b c d") == (total - 3) // 4 and got.count(rows[-1][1]) == 3


def test_run(spark):
    assert np.array(pipeline.run(spark, SF).count()) > 0
