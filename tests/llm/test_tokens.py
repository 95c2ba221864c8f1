import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")

PIECES = st.sampled_from(["abc", "don't", "it's'll", " ", "  ", "\n", "\r\n", "　", " ", "\x1c", "12", "一二", "龍", "!?", "'", "…", "é", "\U0001f600", "x" * 9])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40), st.integers(1, 6), st.integers(1, 4))
def test_cutting_changes_no_token(parts, part, blank):
    tok, text = tokens.load(), "".join(parts)
    whole = tok.encoding.encode_ordinary(text)
    kept = tokens.PART, tokens.LONG_BLANK
    try:
        tokens.PART, tokens.LONG_BLANK = part, blank + 1
        assert tok.ids(text) == whole
    finally:
        tokens.PART, tokens.LONG_BLANK = kept


def test_texts_longer_than_a_part():
    tok = tokens.load()
    for text in ("word " * 30_000, "龍火 " * 40_000, "漢字" * 60_000, "a\n" * 60_000, "ab" + " " * 30_000 + "cd"):
        assert tok.ids(text) == tok.encoding.encode_ordinary(text)
    huge = "ab" + " " * 1_000_000 + "cd" + "\n" * 700_000
    assert b"".join(tok.encoding.decode_single_token_bytes(t) for t in tok.ids(huge)).decode() == huge
