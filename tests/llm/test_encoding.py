import importlib.util
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import encoding

SCHEMA = "doc_id long, text string, id string, ids string, piece int"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    made = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


TEXT = st.text(st.one_of(st.sampled_from(" \n\t  　'sabAZ09中の。!?́‍🙂\x1c"), st.characters(exclude_categories=["Cs"])), max_size=400)


FILE = f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(1, 25))
def test_chunks_give_the_ids_of_the_whole(text, chunk, overlap):
    encoder, pattern = encoding.codec(FILE)
    whole = encoder.encode_ordinary(text)
    assert encoding.encode_text(text, chunk=chunk, overlap=overlap) == whole
    assert "".join(encoding.pieces_of(pattern, text, chunk, overlap)) == text
    assert encoding.decode_ids(whole) == text


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_the_two_forms_of_the_vocabulary_agree(text):
    made = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    assert encoding.encode_text(text) == made.encode(text, add_special_tokens=False).ids


def test_the_pattern_is_that_of_the_tokenizer():
    spec = importlib.util.spec_from_file_location("public_tokenizers_at", f"{encoding.TOKENIZERS}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.PATTERN == encoding.PATTERN


def test_rows_and_long_texts(spark, plain):
    texts = [None, "", " ", "<|endoftext|>", "命名 it's 3.5%\n\n 終", "長い text. " * 9000, "字" * 9000, "a" * 5000, "\n" * 3000 + "x"]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = encoding.encode(df, "doc_id", "text").collect()
    assert {r.id: r.ids for r in rows} == {i: plain(t) if t else [] for i, t in enumerate(texts)}
    assert [r.pieces for r in sorted(rows)][:4] == [0, 0, 1, 1] and max(r.pieces for r in rows) > 100
    assert encoding.encode(df.limit(0), "doc_id", "text").collect() == []


def test_repeated_and_null_ids_of_short_and_long_texts_stay(spark):
    long = "long text " * 500
    df = spark.createDataFrame([(i, t, "x", "y", 1) for t in ("a", long, long + "more of it") for i in (1, 1, None, None)], SCHEMA)
    rows = [(r.id, len(r.ids)) for r in encoding.encode(df, "doc_id", "text").collect()]
    assert len(rows) == 12 and sum(i is None for i, _ in rows) == 6 and len({n for _, n in rows}) == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_texts_of_the_tables_are_stitched(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = encoding.encode(docs, "doc_id", "text").collect()
    assert sum(r.pieces > 1 for r in rows) > len(rows) // 10
    assert {r.id: r.ids for r in rows} == {r.doc_id: plain(r.text) if r.text else [] for r in docs.collect()}
