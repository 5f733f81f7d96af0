"""Chunks, tokens and texts on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.operators.chunk import SEPARATORS, chunks_of, split_text

ZH = "今天天气很好，我们去公园散步。公园里有很多人，孩子们在玩耍！你想一起去吗？"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab。！ \n.,;x", max_size=300), st.integers(1, 30))
def test_without_overlap_nothing_but_blanks_is_lost(text, size):
    pieces = split_text(text, size, 0)
    assert all(0 < len(p) <= size for p in pieces)
    visible = lambda x: "".join(c for c in x if c not in " \n" and c not in SEPARATORS)
    assert visible("".join(pieces)) == visible(text)


@pytest.mark.parametrize("text,size", [(ZH, 40), ("def f():\n    return 1\n\ndef g():\n    return 2", 30), ("one\n\ntwo\n\nthree", 20), ("A" * 500, 64)])
def test_pieces_join_to_the_source(text, size):
    for merge in (True, False):
        assert "".join(split_text(text, size, 0, merge)) == text.strip()


def test_runs_of_separators_end():
    pieces = split_text("A" * 12 + "。" + "\n" * 5 + "B" * 12, 10, 0)
    assert all(p.strip() and len(p) <= 10 for p in pieces)
    assert split_text("\n" * 50, 10, 0) == [] == split_text(None, 10, 0)


def test_overlap_and_merging():
    assert all(len(p) <= 40 for p in split_text(ZH, 40, 10))
    lines = "\n".join(f"line {i}" for i in range(40))
    assert len(split_text(lines, 50, 10)) < len(split_text(lines, 50, 10, False)) / 2
    # hard cuts already overlap, so packing the last one repeats a character
    assert split_text("abcdefghijklmnopq", 10, 2) == ["abcdefghij", "ijklmnopqq"]


def test_bad_sizes(spark):
    for size, overlap in ((0, 0), (10, 10)):
        with pytest.raises(ValueError):
            chunks_of(F.lit("x"), size, overlap)


def test_tokens(spark):
    cases = {
        "第三章": ["第三", "三章"], "猫": ["猫"], "read_any_file": ["read_any_file", "read", "any", "file"], "404abc": ["404", "abc"], "café": ["caf"],
        "部署 deploy.sh": ["部署", "deploy.sh", "deploy", "sh"], "": [], None: [], "__init__": ["__init__", "init"], "foo_": ["foo_", "foo"],
    }
    rows = spark.createDataFrame([(x,) for x in cases], "text string").select("text", T.tokens(F.col("text")).alias("t")).collect()
    assert {r.text: r.t for r in rows} == cases
    rows = spark.createDataFrame([(x,) for x in cases], "text string").select("text", T.token_count(F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in rows} == {x: len(t) for x, t in cases.items()}


def test_full_text(spark):
    cases = [(["aa", "bb"], 0, "aabb"), (["abc"], 50, "abc"), (["abc", "def", "ghi"], 50, "abcdefghi"), (["abcd", "cdef", "efg"], 2, "abcdefg"), (["ab", "", "bc"], 1, "abbc")]
    for chunks, overlap, want in cases:
        df = spark.createDataFrame([(chunks,)], "c array<string>")
        assert df.select(T.full_text(F.col("c"), overlap)).first()[0] == want


def test_strip_is_unicode(spark):
    odd = "　\x1c  x y \x1f\n"
    assert spark.createDataFrame([(odd,)], "t string").select(T.strip(F.col("t"))).first()[0] == "x y" == odd.strip()
