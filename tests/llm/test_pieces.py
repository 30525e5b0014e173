import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece

from pointloom.llm import pieces

TEXTS = ["", " ", "  Hello  world\n\tfoo  ", "é日本\x00x▁yﬁ 🙂🙂", "a" * 500, "<s> </s> <0x41> <unk>", " " * 40 + "x", "the theatre thereof then", "\n\n\n", "İstanbul ẞ   z"]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def test_same_ids_as_the_library(model):
    own, lib = pieces.coder(model), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    parts = ["th", "er", "ing", "tion", "éa", "ß", "Ä", " ", "  ", "\n", ".", ",", "%%%", "12", "x", "ñ", "日", "ing", "ed"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(1500)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode(text), text
        assert own.decode(ids.tolist()) == text.replace(pieces.MARK, " ")


def test_long_text_without_white_space(model):
    own, lib = pieces.coder(model), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    parts = ["th", "er", "ing", "tion", "é", "Z9+/", "日本語", "的", "を", "x", "🙂"]
    text = "".join(rng.choices(parts, k=120_000))[:200_000]
    assert len(text) == 200_000
    assert next(own.encode([text])).tolist() == lib.encode(text)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "的一是在不了有和人这中大为上个国我以要他时来用们"])
def test_a_word_of_a_million_letters(model, letters):
    own, lib = pieces.coder(model), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "".join(random.Random(3).choices(letters, k=1_000_000))
    tracemalloc.start()
    ids = next(own.encode([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000
    assert ids.tolist() == lib.encode(text)


def test_memory_grows_with_the_length_of_a_word(model):
    own, peaks = pieces.coder(model), []
    own.learn({" 日本"})
    for n in (5_000, 20_000):
        tracemalloc.start()
        own.learn({"日本" * (n // 2)})
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 5_000_000


def test_known_words_are_bounded_by_their_characters(model, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHED_CHARS", 50_000)
    monkeypatch.setattr(pieces, "_BLOCK_CHARS", 10_000)
    own, lib = pieces.coder(model), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [f"{k}" + "ab" * 4_000 for k in range(40)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode(text)
        assert sum(map(len, [*own.words, *own.older])) <= 100_000


def test_unigram_against_all_segmentations():
    vocab = {"▁": (1, -2.0), "a": (2, -1.5), "b": (3, -1.7), "ab": (4, -2.9), "▁a": (5, -3.0), "ba": (6, -2.0), "aba": (7, -4.9)}
    own = pieces.PieceCoder(vocab, None, 0, "unigram")

    def best(word):
        options = [(0.0, ())] if not word else []
        for n in range(1, len(word) + 1):
            if word[:n] in vocab:
                s, rest = best(word[n:])
                options.append((s + vocab[word[:n]][1], (vocab[word[:n]][0], *rest)))
        return max(options, default=(-1e9, ()))

    rng = random.Random(2)
    for _ in range(200):
        word = " " + "".join(rng.choices("ab", k=rng.randrange(1, 9)))
        own.learn({word})
        score = sum(next(s for i, s in vocab.values() if i == k) for k in np.frombuffer(own.words[word], "<i4"))
        assert score == pytest.approx(best("▁" + word[1:])[0])
    assert list(own.encode(["c"]))[0].tolist() == [1, 0]


def test_spark_round_trip_and_odd_rows(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (50, None, None), (0, "", "c"), (60, "word thing " * 30_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {(i, (t or "").replace(pieces.MARK, " ")) for i, t, _ in rows}
    digests = pieces.encode_digests(df).collect()
    assert len(digests) == len(rows) and all(r["round_trip"] for r in digests)
    assert pieces.encode(df.limit(0)).count() == 0
