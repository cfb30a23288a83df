"""Count-only Viterbi against the tokenizer it must agree with."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fotoloom.llm.token_counts import SPACE, Counter, Vocabulary, counting, token_counts

tokenizers = pytest.importorskip("tokenizers")


def exact(vocab):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(list(vocab.pieces), unk_id=vocab.unk_id, byte_fallback=vocab.byte_fallback))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def real():
    v = Vocabulary.from_sentencepiece()
    return counting(Counter(v)), exact(v)


TEXTS = ["a", " ", "  ", " a", "the  cat", "Hello, world!\nnew\tline", "né à ça", "日本語 text \U0001f600\U0001f600x", "a" * 300, f"x{SPACE}y", "<s> <0x0A>", "Thhaerble thntly, of.", "\u0000\u0001", "words " * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_given_texts(real, text):
    assert real[0](text) == len(real[1].encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(real, text):
    assert real[0](text) == len(real[1].encode(text, add_special_tokens=False).ids)


# scores with many ties, no byte fallback: unknown pieces fuse
TIES = Vocabulary((("<unk>", 0.0), (SPACE, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (SPACE + "a", -2.0), ("bb", -1.5)), 0, False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=30))
def test_ties(text):
    assert counting(Counter(TIES))(text) == len(exact(TIES).encode(text, add_special_tokens=False).ids)


# byte fallback without all bytes: a run with a missing byte is one unknown piece
SOME = Vocabulary((("<unk>", 0.0), (SPACE, -1.0), ("a", -1.0), *((f"<0x{b:02X}>", 0.0) for b in "bé".encode())), 0, True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cé", max_size=30))
def test_fallback_to_some_bytes(text):
    assert counting(Counter(SOME))(text) == len(exact(SOME).encode(text, add_special_tokens=False).ids)


def test_long_unbroken_text(real):
    for text in ("ab" * 100_000, "\u4e00\U0001f600" * 30_000):
        assert real[0](text) == len(real[1].encode(text, add_special_tokens=False).ids)


def test_frame(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "y"), (None, "a", "z"), (3, None, None), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts(df).collect()))
    c = counting(Counter(Vocabulary.from_sentencepiece()))
    assert got == [(False, 1, c("the cat")), (False, 1, c("the cat")), (False, 3, 0), (False, 4, 0), (True, 0, c("a"))]
    assert token_counts(df.limit(0)).collect() == []
