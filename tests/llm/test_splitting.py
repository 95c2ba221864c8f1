import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import tokens
from tracefold.llm.splitting import Splitter, boundaries, split_texts

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def check(text, limit, overlap):
    tok = tokens.load()
    pieces = Splitter(tok, limit, overlap).split(text)
    if tok.count(text) <= limit:
        assert pieces == []
        return pieces
    at = 0
    for k, (a, b, n, _) in enumerate(pieces):
        assert a <= at < b and (k == 0) == (a == 0)
        assert n <= limit and tok.count(text[a:b]) <= limit
        if k and not overlap:
            assert a == at
        at = b
    assert at == len(text)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc 。，.!\n對手龜é😀1", max_size=400), st.sampled_from([(8, 0), (8, 4), (16, 3), (64, 16)]))
def test_pieces_are_within_the_limit_and_give_the_text_back(text, size):
    check(text, *size)


def test_natural_ends_are_preferred():
    text = "".join(f"第{i}句話說完了。" + ("\n\n" if i % 7 == 6 else "") for i in range(60))
    pieces = check(text, 64, 8)
    assert {p[3] for p in pieces} <= {"paragraph", "sentence", "end"}
    for (a, b, *_), (c, *_rest) in zip(pieces, pieces[1:]):
        assert a < c < b


def test_text_without_boundaries_is_cut_hard():
    pieces = check("龜" * 500 + "😀" * 100, 32, 4)
    assert {p[3] for p in pieces} == {"hard", "end"}


def test_boundaries():
    para, line, stop, clause, blank = boundaries("甲。」乙,丙 3.5 x. Y\n\n丁")
    assert para.tolist() == [17] and line.tolist() == [17]
    assert stop.tolist() == [3, 13] and clause.tolist() == [5] and 7 in blank.tolist()


def test_odd_line_ends():
    para, line, *_ = boundaries("a\r\nb\u2028c\rd\r\n\r\ne")
    assert line.tolist() == [3, 5, 7, 12] and para.tolist() == [12]
    assert boundaries("a\n \nb\nc")[0].tolist() == [4]
    assert [len(x) for x in boundaries("")] == [0] * 5


def test_frame(spark):
    text = "一句話。" * 100
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "短", "x"), (None, text, "x")], "id long, text string, piece string")
    got = split_texts(df, "id", "text", {3: (64, 8), 4: (128, 0)})
    assert got.columns == ["limit_id", "id", "piece_no", "start_char", "end_char", "n_tokens", "ends_at", "piece"]
    rows = got.collect()
    assert {r.id for r in rows} == {1, None} and all(text[r.start_char : r.end_char] == r.piece for r in rows)
    assert split_texts(df.limit(0), "id", "text", {3: (64, 8)}).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", {1: (10, 6)})


def test_huge_text_keeps_its_offsets():
    tok = tokens.load()
    text = ("龜a" * 30_000 + " " + "b" * 60_000) * 2
    assert tok.ends(text)[-1] == len(text.encode())
    assert "".join(tok.encoding.decode(tok.ids(text))) == text
