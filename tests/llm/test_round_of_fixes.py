"""What earlier verdicts probed: small hosts, secrets of one alphabet, caches that end with their task, scores from stored features."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tidetable.llm import common, html_main, packing, quality, secret_scan

SF = "/root/testdata/sf0.001"
LETTERS = {"letters": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digits": string.digits, "letters and digits": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567"}


@pytest.mark.parametrize("name", LETTERS)
def test_recall_of_secrets_without_any_mark(name):
    """No planted prefix; from 16 characters on. Small letters of 16 are the hardest: some could be words."""
    rng, novelty = random.Random(11), secret_scan.Novelty()
    found = {n: sum(secret_scan.novel_spans("auth: " + "".join(rng.choices(LETTERS[name], k=n)), [], novelty) == [(6, 3, 6 + n)] for _ in range(60)) / 60 for n in (16, 20, 24, 32, 64, 128)}
    assert sum(found.values()) / len(found) >= 0.9 and min(found.values()) >= 0.7, found


def test_precision_on_names_and_words():
    novelty = secret_scan.Novelty()
    names = """getUserSessionTokenV2ById3 internationalization getElementsByClassName AbstractSingletonProxyFactoryBean com.example.project.SessionHandler antidisestablishmentarianism
    electroencephalographically XMLHttpRequestEventTarget authorizationCallbackHandler UNAUTHORIZED_ACCESS_TOKEN session_identifier_string_value MAX_CONNECTION_TIMEOUT_SECONDS
    docs/2024/2024-01-10/index.html.gz 20240110123045123 Rechtsanwaltsgehilfinnen constitutionnellement incomprehensibilities src/components/AuthenticationProvider.tsx""".split()
    # a compound that stands alone may be taken for a secret; nothing else
    assert [n for n in names if secret_scan.novel_spans("auth: " + n, [], novelty)] == ["Rechtsanwaltsgehilfinnen"]
    # a word that has too many consonants for one is known from the text around it
    word = "Angstschweissschnorchler"
    assert secret_scan.novel_spans(f"auth: {word}", [], novelty) != []
    assert secret_scan.novel_spans(f"Der Angstschweiss der Schnorchler.\nauth: {word}", [], novelty) == []


def pages_of(n, extra="<p>Subscribe to our paper to read more of these stories every day.</p>"):
    text = lambda i, k: f"Story {i} part {k} tells of matter number {i * 7 + k} and of nothing else that others tell, as {'abcdefg'[i % 7] * 9} {i}."
    return [(i, f"http://h{n}/p{i}", f"<html><body><div><div>{extra}<p>{text(i, 1)}</p><p>{text(i, 2)}</p></div></div></body></html>", "\n".join(text(i, k) for k in (1, 2))) for i in range(n)]


@pytest.mark.parametrize("n", [3, 5, 7, 8, 20])
def test_small_hosts_lose_their_constant_blocks(spark, n):
    rows = pages_of(n)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div><div>One text in plain divisions.</div><div>And another.</div></div></body></html>"
    df = spark.createDataFrame([(i, "http://copies/x", page) for i in range(6)], "page_id int, url string, html string")
    assert {r["text"] for r in html_main.main_text(df).collect()} == {"One text in plain divisions.\nAnd another."}


def test_a_task_leaves_no_words_behind(spark):
    path = packing.tokenizer_path("word_bpe_49k.json")
    words = packing.WordIds(path)
    first = words(["some words here", "other words there"])
    assert words.held > 0 and words.young
    words.forget()
    assert not words.young and not words.old and words.held == 0 and words(["some words here", "other words there"]) == first
    docs = common.table(spark, SF, "documents").repartition(1)
    packing.token_pieces(docs, path).count()

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(w.young) + len(w.old) for w in packing._word_ids.values())], pa.int64())], ["n"])

    assert spark.range(8).repartition(8).mapInArrow(held, "n bigint").agg(F.sum("n")).first()[0] == 0


def test_words_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 3000)
    words = packing.WordIds(packing.tokenizer_path("word_bpe_49k.json"))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)) for i in range(40)]
    expected = [b"".join(words.tokenizer.encode(t, add_special_tokens=False).ids[k].to_bytes(4, "little") for k in range(len(words.tokenizer.encode(t, add_special_tokens=False).ids))) for t in texts]
    assert [words([t])[0] for t in texts] == expected
    assert words.held <= 3000 + 20 * 400 and len(words.young) + len(words.old) < 100


def test_scores_from_stored_features_are_those_of_the_texts(spark):
    docs = common.table(spark, SF, "documents")
    pool = common.materialize(quality.features(docs), "features")
    model = quality.fit(docs, common.table(spark, SF, "labels"), pool=pool)
    one = sorted((r["doc_id"], round(r["quality"], 9)) for r in quality.score_features(pool, model).collect())
    assert one == sorted((r["doc_id"], round(r["quality"], 9)) for r in quality.score(spark, docs, model).collect())
    assert {r["quality"] for r in quality.score_features(pool, None).collect()} == {1.0}
