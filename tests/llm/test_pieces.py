"""SentencePiece ids and texts against the library on whole texts."""

import hashlib
import random

import pytest
import sentencepiece

from corvane.llm import pieces

ALPHABET = ["a", "the", "ing", " ", "  ", "   ", "\n", "\t", "▁", "é", "е́", "漢字", "🙂", "\x00", " ", "　", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "...", "12345", "\r\n", "Ω", "�"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choices(ALPHABET, k=rng.choice([1, 2, 5, 40]))) for _ in range(400)]
    return [*made, None, "", " ", "  ", "▁", " a", "a ", "a  b", made[3], made[3]]


def test_chunks_are_what_the_markers_cut():
    for text in texts():
        data = (text or "").encode().replace("▁".encode(), b" ")
        joined = b"".join(b" " + c for part in pieces.chunks(data) for c in part)
        assert joined == (b" " + data if data else b"")


def test_the_public_model_is_separable_and_ids_equal_the_library(spark, model, monkeypatch):
    assert pieces.separable(pieces.public_model())
    rows = [(i if i % 9 else None, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, at int").repartition(3)
    for block, part in ((pieces.BLOCK, pieces.PART), (64, 8)):
        monkeypatch.setattr(pieces, "BLOCK", block)
        monkeypatch.setattr(pieces, "PART", part)
        got = pieces.encode(df, pieces.public_model(), ("doc_id", "block", "at"))
        assert got.columns == ["doc_id", "block", "at", "ids"]
        got = got.withColumn("back", pieces.decoded(got["ids"], pieces.public_model())).collect()
        assert len(got) == len(rows) and {r["at"]: r["doc_id"] for r in got} == {r[3]: r[0] for r in rows}
        for r in got:
            ids = model.encode(rows[r["at"]][1] or "") + [2]
            assert r["ids"] == ids, rows[r["at"]]
            assert r["back"] == model.decode(ids)


def test_models_that_are_not_separable_take_whole_texts(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "separable", lambda path: False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(df, pieces.public_model(), end=False).collect()}
    assert got == {i: model.encode(t or "") for i, t in enumerate(texts())}


def test_long_texts_and_empty_tables(spark, model, tmp_path):
    long = "a long word list with  gaps " * 400_000 + "x" * 100_000
    schema = "doc_id long, text string, lang string"
    for rows in ([(1, long, "en"), (2, None, None)], []):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = {r["doc_id"]: r for r in pieces.op12_sentencepiece(spark, str(tmp_path)).collect()}
        assert len(got) == len(rows)
        for doc_id, text, _ in rows:
            ids = model.encode(text or "") + [2]
            assert got[doc_id]["n_tokens"] == len(ids)
            assert got[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[doc_id]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_a_carried_column_named_like_the_ids_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Ids int")
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(df, pieces.public_model(), ("doc_id", "Ids"))
