import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortmill.llm import textbytes
from cohortmill.llm.textbytes import SOLID_BYTES, WORD_BYTES, shingles, word_chunks

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
PATTERNS = {"word": (WORD_BYTES, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "solid": (SOLID_BYTES, r"[^\x20\x09-\x0D]+")}


def hashed(texts, solid):
    out = [None] * len(texts)
    for chunk in word_chunks(pa.array(texts, pa.string()), solid):
        for i in range(chunk.hi - chunk.lo):
            out[chunk.lo + i] = chunk.hashes[chunk.first[i]:chunk.first[i + 1]].tolist()
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé9 .\n\u3000ñ-", max_size=30)), max_size=6), st.sampled_from(["word", "solid"]))
def test_words_are_those_of_the_pattern(texts, kind):
    solid, pattern = PATTERNS[kind]
    names = {}
    for text, own in zip(texts, hashed(texts, solid), strict=True):
        words = re.findall(pattern, (text or "").translate(LOWER))
        assert len(words) == len(own)
        for word, value in zip(words, own, strict=True):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(textbytes, "CHUNK", 64)
    texts = ["ab " * 100, None, "x" * 500, "", "one two", "y" * 30 + " " + "z" * 90]
    whole = [[hashed([w], SOLID_BYTES)[0][0] for w in (t or "").split()] for t in texts]
    assert hashed(texts, SOLID_BYTES) == whole


def test_shingles():
    words = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(words)) == 4 and len(shingles(words[:5])) == 1 and len(shingles(words[:3])) == 1 and not len(shingles(words[:0]))
    assert shingles(words[:3])[0] != shingles(words[:4])[0]
    assert shingles(words)[1] == shingles(words[1:])[0]
