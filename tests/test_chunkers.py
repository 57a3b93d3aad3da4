"""Chunkers against the reference's pattern in Python's re and against worked examples."""

import re

import pyarrow.parquet as pq
import pytest

from annulus.operators import chunkers
from annulus.queries import QUERIES

D = "/root/testdata/sf0.001"
END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!|。|？|！)\s*"
TEXTS = ["Dr. Smith came. He left!  Why?\nNobody knows", "One. Two! Three? Four.", "See e.g. this. Or i.e. that. Pi is 3.14159. U.S.A. wins", "你好。再见！ 真的？是", "What?!  No...\tYes", "", "   ", " . ", "é.ü.x y. \u00a0Next.\x85Then.\u3000End", "a_1.b_2! c", "x.²\n. y", None, "😀.😀. z. A.b\n.c"]


def expected(text, size, overlap):
    parts = [s.strip() for s in re.split(END, text) if s.strip()]
    return [" ".join(parts[a : a + size]) for a in range(0, len(parts), size - overlap)]


@pytest.mark.parametrize("size,overlap", [(3, 1), (1, 0), (2, 1)])
def test_sentences_keep_terminators_and_abbreviations(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.chunks for r in chunkers.get_chunker("sentence")(df, "t", size, overlap).collect()}
    assert got == {i: None if t is None else expected(t, size, overlap) for i, t in enumerate(TEXTS)}
    if (size, overlap) == (1, 0):
        assert got[0] == ["Dr. Smith came.", "He left!", "Why?", "Nobody knows"]


def test_query_gives_all_chunks(spark):
    t = pq.read_table(f"{D}/documents.parquet")
    want = sorted((i, expected(x, 3, 1)) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert sorted((r.doc_id, r.chunks) for r in QUERIES["sentence_chunk_whole"](spark, D).collect()) == want


def test_fix_size_counts_characters(spark):
    df = spark.createDataFrame([(0, "aa\nbbb\n\ncc\ndddddddd\ne"), (1, "a\nb\nc\nd"), (2, ""), (3, None), (4, " \n "), (5, " x \n y ")], "i int, t string")
    chunks = lambda size, overlap: {r.i: r.chunks for r in chunkers.get_chunker("fix_size")(df, "t", size, overlap).collect()}
    got = chunks(6, 2)
    assert got[0] == ["aa\nbbb", "cc", "dddddddd", "e"] and got[2] == [] and got[3] is None and got[4] == []
    assert chunks(3, 1)[1] == ["a\nb", "b\nc", "c\nd"]
    assert chunks(20, 0)[5] == ["x \n y"]
    with pytest.raises(ValueError):
        chunkers.get_chunker("fix_size")(df, "t", 2, 3)
