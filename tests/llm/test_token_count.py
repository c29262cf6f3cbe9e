"""Token counts against the library on whole texts; small chunks, so that splices, failures and joined runs occur."""

import random

import pytest
from pyspark.sql import functions as F

from meshwright.llm import token_count
from meshwright.llm.subwords import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PIECES = ["don't", "a", "  ", "\n", "\n\n ", "<|endoftext|>", "<|endof", "é", "日本語", " ", " ", "　", "12", "!!", "'ll", "x" * 90, " word", " Wort", "\u0085", "' ", "\t", "🙂", " "]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = ["".join(r.choice(PIECES) for _ in range(r.choice([0, 1, 5, 50, 400, 900]))) for _ in range(80)]
    # no boundary for thousands of characters, in the middle or at an end; only white space; repeats
    return [*out, "a" * 5000, " " * 4000 + "b", "b" + " " * 4000, "日" * 3000, None, "", "x y " * 900, "dup dup" * 300, "dup dup" * 300, ("b" * 700 + " ") * 9, "-" * 300 + "<|endoftext|>" * 60]


def sizes(texts, path=PATH):
    tokenizer = token_count.load(path)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 64), (1000, 40), (64, 30), (1 << 15, 512)])
def test_counts(spark, texts, chunk, overlap):
    docs = spark.createDataFrame([(i if i % 9 else None, t, "own", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, _key int").repartition(3)
    out = token_count.token_counts(docs, PATH, chunk=chunk, overlap=overlap)
    assert out.columns == ["doc_id", "text", "_key", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    assert got == sorted((i if i % 9 else 0, len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, sizes(texts), strict=True)))


def test_most_splices_need_no_widening(spark):
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 12))) for _ in range(40_000))
    huge = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = token_count._chunks(huge, "text", ["doc_id"], 2048, 128).withColumns({"_first": F.col("_no"), "_last": F.col("_no")})
    assert chunks.count() > 100 and "".join(r["_own"] for r in chunks.orderBy("_no").collect()) == text
    assert token_count._spliced(token_count._encoded(chunks, PATH, 128)).where("_extra IS NULL").count() == 0


def test_a_long_text(spark):
    text = "One sentence of a very long text, with 3 numbers. " * 60_000
    (row,) = token_count.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, keep=["doc_id"]).collect()
    assert (row["n_bytes"], row["n_tokens"]) == (len(text), sizes([text])[0])


def test_other_tokenizers_read_whole_texts(spark, texts):
    import sentencepiece

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizer_path()
    assert token_count.local_parts(PATH) and not token_count.local_parts(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, path, chunk=64).collect()}
    assert [got[i] for i in range(len(texts))] == sizes(texts, path)
    pieces = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, pieces, chunk=64).collect()}
    assert [got[i] for i in range(len(texts))] == [len(model.encode(t or "")) for t in texts]


def test_empty_table(spark):
    out = token_count.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, keep=["doc_id"])
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_query(spark):
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (len((t or "").encode()), n) for i, t, n in zip(docs.doc_id, docs.text, sizes(list(docs.text)), strict=True)}
