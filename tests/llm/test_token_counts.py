import base64
import random

import numpy as np
import pytest
import tiktoken

from pointloom.llm import token_counts as tc


@pytest.fixture(scope="module")
def encoding():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=table, special_tokens={})


def _brute(encoding, text, rule):
    """Each byte of each token looked up by itself."""
    raw = text.encode()
    owner, k = [], 0
    for b in raw:
        owner.append(k)
        k += b == 10
    counts, at = [0] * (max(owner) + 1), 0
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        own = owner[at : at + n]
        counts[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
        at += n
    assert at == len(raw)
    return counts


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_against_brute_force(spark, encoding, rule):
    rng = random.Random(4)
    texts = ["a\n\n\nb", "\n", "x\n", "é🙂\n  \n\n ü", "word " * 40_000] + ["".join(rng.choices(["the", " ", "\n", "\n\n", "é", "日本", "1", "  "], k=40)) for _ in range(80)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(900, "", 5), (901, None, None), (None, "a\nb", 5), (0, texts[0], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {}
    for r in tc.section_tokens(df, rule).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts[1:], 1):
        found = sorted(got[i], key=lambda r: r["section"])
        assert [r["n_tokens"] for r in found] == _brute(encoding, text, rule)
        assert "".join(text[r["start"] : r["end"]] for r in found) == text
        assert sum(r["n_tokens"] for r in found) == found[0]["doc_tokens"] == len(encoding.encode_ordinary(text))
    assert [(r["n_tokens"], r["end"]) for r in got[900] + got[901]] == [(0, 0), (0, 0)]
    assert len(got[0]) == 2 * 4 and len(got[None]) == 2
    assert tc.section_tokens(df.limit(0)).count() == 0


def test_a_token_over_a_boundary():
    sizes = np.array([2, 5, 1])
    assert tc.attribute(sizes, np.array([0, 4]), "start")[0].tolist() == [2, 1]
    assert tc.attribute(sizes, np.array([0, 3]), "most")[0].tolist() == [1, 2]
    assert [a.tolist() for a in tc.attribute(np.empty(0, int), np.array([0]))] == [[0], [0]]
    with pytest.raises(ValueError):
        tc.attribute(sizes, np.array([0]), "other")


def test_fields(spark, encoding):
    df = spark.createDataFrame([(1, "A title", "the\0body", None), (2, None, "", "end")], "doc_id long, title string, body string, tail string")
    got = {(r["doc_id"], r["field"]): r for r in tc.field_tokens(df, ["title", "body", "tail"]).collect()}
    for i, whole in ((1, "A title\nthe body\n"), (2, "\n\nend")):
        assert sum(got[i, f]["n_tokens"] for f in ("title", "body", "tail")) == len(encoding.encode_ordinary(whole))
    assert got[1, "tail"]["n_tokens"] == 0 and got[2, "tail"]["n_tokens"] == 1
