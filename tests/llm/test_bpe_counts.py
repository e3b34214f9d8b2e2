import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leadrank.llm import bpe_counts
from tests.llm.samples import AWKWARD, awkward, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return bpe_counts.TokenCounter(PATH)


TEXTS = [
    "", "a<|endoftext|>b <|endoftext|><|endoftext|>", "  \n\n\t x  ", "ab　cd 日本語 🙂🙂 'll don't", "x" * 5000,
    "aaaa bbb" * 999, " ​ x\x1c\x1d y", "١٢٣ ½ ²", "<|endoftext|", "é é ß", "\r\n\r\n a", "it's we'll I'D",
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts_equal_the_library(library, counter, text):
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_counts_of_any_text_equal_the_library(library, counter, text):
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_awkward_rows(spark, library):
    docs = awkward(spark).selectExpr("*", "0 as N_TOKENS")
    rows = bpe_counts.counted(docs, PATH).collect()
    texts = {row[0]: row[1] or "" for row in AWKWARD}
    assert len(rows) == 9
    for row in rows:
        tokens = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes) == (tokens, len(texts[row.doc_id].encode()))
        assert row.over_limit is (tokens > 1024)
    assert bpe_counts.counted(nothing(spark), PATH).count() == 0
