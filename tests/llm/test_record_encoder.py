"""The encoder's shortcuts against whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoframe.llm import records

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's  we'll\tThey'RE", "a\n\nb \n c", "  two", "end ", "x\x1cy \x1f z", "naïve Ærø ǅ ʼn", "日本語 text 123٣", "a<|endoftext|>b", "½ ² ª º µ", "“quoted” — …", "é" * 500, "a\xa0b  c", "1a2b 3.14 x_y", "\r\n\r\n'S 's", "🙂 🙂🙂"]


def plain(encode: records.Encoder, text: str) -> bytes:
    return np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()


@pytest.fixture(scope="module")
def encode():
    return records.Encoder(PATH, "<u2")


def test_odd_texts(encode):
    assert encode(ODD) == [plain(encode, t) for t in ODD]


def test_the_cache_size_changes_nothing(encode, monkeypatch):
    texts = [f"{a} {b}" for a in ODD for b in ODD]
    monkeypatch.setattr(records, "CACHED_PIECES", 10)
    small = records.Encoder(PATH, "<u2")
    assert small(texts) == encode(texts)
    assert len(small.tokens) <= 10 and len(small.pieces) <= 10


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'.,aZé0_ǅ\x0b\x1d\x85\xa0日²"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_any_text(text):
    encode = records.encoder(PATH, "<u2")
    assert encode([text]) == [plain(encode, text)]


def test_other_vocabularies_take_their_own_way():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other, encode = Tokenizer.from_file(path), records.encoder(path, "<u2")
    texts = ["The quick  Brown fox's", "", "été 123\n x", "A"]
    for text, found in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == other.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError, match="don't fit"):
        records.Encoder(path, "u1")
