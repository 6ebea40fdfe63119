import random

import pytest

from terroir.llm.tokens import Vocabulary, decode_ids, encode_corpus

tiktoken = pytest.importorskip("tiktoken")


def texts():
    r = random.Random(5)
    words = ["don't", "it's", "''''s", "  ", "\n\n", " \n ", "été", "12345", "...", "日本語テキスト", "a", "we're", "<|endoftext|>", "x" * 90, " " * 70, "'"]
    long = ["".join(r.choice(words) + r.choice(["", " ", "\n"]) for _ in range(400)) for _ in range(12)]
    return [None, "", "   ", "hello", "hello", *long, "y" * 700, " " * 600 + "z", "word " * 200]


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 25), (120, 40), (1_024, 128), (65_536, 2_048)])
def test_stitched_encoding_equals_whole_encoding(spark, chunk, overlap):
    rows = list(enumerate(texts())) + [(None, "null key")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    got = encode_corpus(df, keep=["doc_id"], chunk=chunk, overlap=overlap)
    vocabulary = Vocabulary(spark, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    want = {i: vocabulary.encode(t) for i, t in rows}
    assert vocabulary.encode_slowly(texts()[6]) == vocabulary.encode(texts()[6])
    out = {r.doc_id: list(r.ids) for r in got.collect()}
    assert out == want
    back = {r.doc_id: r.t for r in got.select("doc_id", decode_ids(spark, got.ids).alias("t")).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert encode_corpus(spark.createDataFrame([], schema), keep=["doc_id"]).count() == 0
    rows = [(1, "word " * 60)] * 3
    out = encode_corpus(spark.createDataFrame(rows, schema), keep=["doc_id"], chunk=60, overlap=30).collect()
    assert len(out) == 3 and len({tuple(r.ids) for r in out}) == 1


def test_runs_that_the_fast_scanner_gives_up_on(spark):
    vocabulary = Vocabulary(spark, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "a" + " " * 1_000_000 + "b"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for chunk in (1_024, 4_000_000):
        ids = encode_corpus(df, keep=["doc_id"], chunk=chunk, overlap=128).first().ids
        assert vocabulary.decode(list(ids)) == text and list(ids) == vocabulary.encode(text)


def test_chunks_are_encoded_in_pieces(spark):
    text = "".join(f"word{i}, and 'tis {i}. " for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    vocabulary = Vocabulary(spark, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert list(encode_corpus(df, keep=["doc_id"]).first().ids) == vocabulary.encode(text)
