import hashlib
import random
import re

import numpy as np
import pytest

from pointloom.llm import fim
from tests.oracle import connection


def _slow(doc_id, text):
    """A row of the contract from a list of tokens, and the output."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= 90 or re.search("<[PSM]>", text):
        return (doc_id, n, "plain", None, None, text)
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500])
def test_rank_and_select_against_counting(n):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 5, n).astype(np.uint8)
    m = fim.WaveletMatrix(codes)
    for i in range(0, n + 1, 7):
        for c in range(5):
            assert m.rank(c, i) == (codes[:i] == c).sum()
    for begins in (fim.TOKENS, fim.CHARACTERS, (fim.FIRST,), (fim.SPACE, fim.INSIDE)):
        places = [*np.flatnonzero(np.isin(codes, begins)).tolist(), n]
        assert m.count(begins, n) == len(places) - 1
        assert [m.select(begins, k) for k in range(len(places))] == places


ODD = [
    "", None, " ", "\n", "a", "ab", "ab cd", "1234", "a1b2", "<P>", "x <S> y", "<M", "<P", "S>", "< P>", "<<S", "a<", "<", "P>", "éáb\U0001f600c",
    "日本語 text", "\x00\x01a", "a\r\n\tb\x0b\x0cc", "A" * 5000, "<" * 300, "ab " * 20_000, "KKſ s",
]


def test_rows_against_tokens(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("abZ<>PSM \n1é😀", k=rng.randrange(200))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, "repeated row"), (5, "repeated row"), (-3, "negative id")]
    df = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], "doc_id long, text string, n long, form string, output string")
    got = [tuple(r) for r in fim.transformed(df).collect()]
    assert sorted(got, key=str) == sorted((_slow(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.transformed(df).select("doc_id", fim.restored().alias("t")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fim.transformed(df.limit(0)).count() == 0


def test_whole_table_against_tokens(spark):
    from pointloom.llm.queries import QUERIES
    from tests.oracle import DATA

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = connection().execute("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((*_slow(i, t)[:5], sha(_slow(i, t)[5]), sha(t or "")) for i, t in rows)
    assert sorted(tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, DATA).collect()) == want


def test_cuts_at_every_character(spark):
    df = spark.createDataFrame([(k, "word") for k in range(200)], "doc_id long, text string")
    rows = fim.transformed(df, plain_percent=0, spm_percent=0, begins=fim.CHARACTERS).collect()
    assert {r["form"] for r in rows} == {"psm"} and {r["n"] for r in rows} == {4}
    assert {r["prefix_chars"] for r in rows} == set(range(5))
