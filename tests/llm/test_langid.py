import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.llm.conftest import awkward
from tributary.llm import langid

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    return docs, langid.train(docs)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    got = langid.predict(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id")
    got = got.where(langid.held_out("doc_id", 5))
    total, right = got.count(), got.where(F.col("lang") == F.col("lang_pred")).count()
    assert total > 100 and right / total >= 0.95


def test_labels_come_from_training_rows_only(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = docs.where(langid.held_out("doc_id", 5)).withColumn("lang", F.lit("xx"))
    mixed = docs.where(~langid.held_out("doc_id", 5)).unionByName(held)
    model = langid.train(mixed)
    assert "xx" not in model.labels and set(model.labels) == {"de", "en", "es", "fr"}


def test_code_switched_text_is_labelled_word_by_word(fitted):
    docs, model = fitted
    texts = {r["lang"]: r["text"] for r in docs.where("doc_id < 200").collect()}
    left = langid.words(texts["en"])[:40]
    right = langid.words(texts["fr"])[:40]
    labels = [lang for _, lang in langid.label_words(" ".join(left + right), model)]
    assert labels[:30].count("en") >= 27 and labels[-30:].count("fr") >= 27


def test_awkward_rows(session, fitted):
    _, model = fitted
    frame = session.createDataFrame(
        [(k, t, 1) for k, t in awkward()] + [(8, "12345 !!! 42", 1)], "doc_id long, text string, k int"
    )
    got = {(r[0], r[1]) for r in rows(langid.predict(frame, model), "doc_id", "lang_pred")}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (8, "und") in got
    out = langid.predict(frame, model).collect()
    assert len(out) == 11
    assert all(0.0 <= r["score"] <= 1.0 for r in out)
    assert all(r["lang_pred"] in model.labels + ["und"] for r in out)


def test_empty_table(session, fitted):
    _, model = fitted
    frame = session.createDataFrame([], "doc_id long, text string")
    assert langid.predict(frame, model).count() == 0


def test_held_out_rule(session):
    import zlib

    frame = session.createDataFrame([(k,) for k in range(300)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in frame.select("doc_id", langid.held_out("doc_id", 5)).collect()}
    assert got[None] is True
    assert all(got[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
