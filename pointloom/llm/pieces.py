"""Encoding into the pieces of a SentencePiece model, and decoding, by a shared-prefix Viterbi pass.

A text is marked (white space becomes the mark, one goes before the text) and cut into marked words, which no
piece crosses. The distinct words of a batch are sorted, which lays them out as a trie in depth-first order: each
word takes over the forward states of the prefix it shares with the word before it, and only its own rest is
computed.

The forward state of a position is, for a unigram model, the best score and last piece of the prefix. For a BPE
model it is the last piece of the prefix's encoding: that is the one piece that ends there and, behind the state
of the position where it starts, merges back into the same two pieces. So the result is the model's own encoding
and not just a segmentation of high score.

The ids of a word are read from its end back along the last pieces, so memory grows with its length alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CACHED_WORDS = 250_000
_CACHED_CHARS = 4_000_000
_BLOCK_CHARS = 2_000_000
_CACHED_PAIRS = 500_000
_ROWS = 500


class PieceCoder:
    """Encoder and decoder for one vocabulary.

    ``pieces`` are (text, score) of the pieces that may match text, by id where ``ids`` says so. ``byte_ids`` are
    the 256 ids for bytes of characters that no piece holds, or None; then such a character becomes ``unk_id``.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unk_id: int = 0, kind: str = "bpe", dummy_prefix: bool = True):
        # inside, a space stands for the mark: words of Latin letters then take one byte a letter
        pieces = {p.replace(MARK, " "): found for p, found in pieces.items()}
        self.pieces, self.byte_ids, self.unk_id, self.kind, self.dummy_prefix = pieces, byte_ids, unk_id, kind, dummy_prefix
        if any(re.search("[^ ] ", p) for p in pieces):
            raise ValueError("a piece goes on behind a word's end: words can't be encoded one by one")
        self.chars = {c for p in pieces for c in p}
        # lengths of the pieces of 3 characters or more that end in three given ones, longest first
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {c: (*sorted(n, reverse=True), 2) for c, n in lengths.items()}
        free = "".join(c for c in "\n\t\r" if c not in self.chars)
        self.split = re.compile(f" *[^ {free}]+| +" + (f"|[{free}]" if free else ""))
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.bytes_of = {i: b for b, i in enumerate(byte_ids or ())}
        self.decoded = self.text_of | {i: chr(b) for i, b in self.bytes_of.items() if b < 128} | {unk_id: " ⁇ "}
        self.packed = {i: i.to_bytes(4, "little") for i in [*self.text_of, *self.bytes_of, unk_id]}
        self.words: dict[str, bytes] = {}  # the ids of each word, 4 bytes each
        self.older: dict[str, bytes] = {}
        self.n_chars = 0  # of the words known
        self.id_of = {p: i for p, (i, _) in pieces.items()}
        self.size_of = {i: len(p) for p, i in self.id_of.items()}
        self.n_ids = max(self.id_of.values(), default=0) + 1
        self.pairs: dict[int, bool] = {}

    def mark(self, text: str) -> str:
        if not text:
            return ""
        return (" " if self.dummy_prefix else "") + text.replace(MARK, " ")

    def merged(self, text: str) -> list[str]:
        """A short text by repeated merging: always the adjacent pair whose piece scores best, leftmost first."""
        parts = list(text)
        worst = float("-inf")
        scores = [self.pieces.get(a + b, (0, worst))[1] for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == worst:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = self.pieces.get(parts[k] + parts[k + 1], (0, worst))[1]
            if k:
                scores[k - 1] = self.pieces.get(parts[k - 1] + parts[k], (0, worst))[1]
        return parts

    def _follows(self, before: int, piece: int) -> bool:
        """Whether a piece stays behind another (or at a start, -1), the two merged from scratch."""
        if len(self.pairs) > _CACHED_PAIRS:
            self.pairs.clear()
        second = self.text_of[piece]
        first = self.text_of[before] if before >= 0 else ""
        found = self.pairs[before * self.n_ids + piece] = self.merged(first + second) == ([first, second] if first else [second])
        return found

    def _char_ids(self, c: str) -> bytes:
        found = self.pieces.get(c)
        if found is not None:
            return self.packed[found[0]]
        if self.byte_ids is not None:
            return b"".join(self.packed[self.byte_ids[b]] for b in c.encode("utf-8", "surrogatepass"))
        return self.packed[self.unk_id]

    def _bpe(self, word: str, last: list[int], start: int) -> None:
        """Set last[i], the last piece of the encoding of word[:i], for i from start on.

        A character of no piece merges with nothing, so behind it as at the start (-1) all is free.
        """
        pair = (2,)
        id_of, pairs, lengths, n_ids = self.id_of, self.pairs, self.lengths, self.n_ids
        for i in range(start, len(word) + 1):
            for n in lengths.get(word[i - 3 : i], pair) if i > 2 else pair[: i - 1]:
                if n <= i:
                    piece = id_of.get(word[i - n : i])
                    if piece is not None:
                        before = last[i - n]
                        fits = pairs.get(before * n_ids + piece)
                        if fits or (fits is None and self._follows(before, piece)):
                            last.append(piece)
                            break
            else:
                last.append(id_of.get(word[i - 1], -1))

    def _unigram(self, word: str, last: list[int], best: list[float], start: int) -> None:
        """Set best[i], the highest score of a segmentation of word[:i], and its last piece (-1: a character of none)."""
        for i in range(start, len(word) + 1):
            c = word[i - 1]
            # a character of no piece costs more than any pieces
            own, score = self.pieces.get(c, (-1, -1e6))
            top = best[i - 1] + score
            for n in self.lengths.get(word[i - 3 : i], (2,)) if i > 2 else (2,)[: i - 1]:
                if n <= i and (found := self.pieces.get(word[i - n : i])) is not None and best[i - n] + found[1] > top:
                    own, top = found[0], best[i - n] + found[1]
            best.append(top)
            last.append(own)

    def _ids(self, word: str, last: list[int]) -> bytes:
        """The ids of a word, from its last piece back to its start."""
        packed, size_of = self.packed, self.size_of
        out, i = [], len(word)
        while i:
            piece = last[i]
            if piece < 0:
                i -= 1
                out.append(self._char_ids(word[i]))
            else:
                i -= size_of[piece]
                out.append(packed[piece])
        out.reverse()
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, in the order of their trie."""
        missing = words - self.words.keys()
        if len(self.words) + len(missing) > _CACHED_WORDS or self.n_chars + sum(map(len, missing)) > _CACHED_CHARS:
            self.older, self.words = self.words, {}  # words of the generation before stay known while in use
            self.n_chars, missing = 0, words
        self.n_chars += sum(map(len, missing))
        for word in missing & self.older.keys():
            self.words[word] = self.older[word]
        # the state is one list per position of the word before: what two words share is computed once
        before, last, best = "", [-1], [0.0]
        for word in sorted(missing - self.words.keys()):
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :], best[shared + 1 :]
            if self.kind == "bpe":
                self._bpe(word, last, shared + 1)
            else:
                self._unigram(word, last, best, shared + 1)
            self.words[word] = self._ids(word, last)
            before = word

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        block: list[list[str]] = []
        size = chars = 0
        for text in texts:
            block.append(self.split.findall(self.mark(text)))
            size += len(block[-1])
            chars += len(text)
            if size > 200_000 or chars > _BLOCK_CHARS:
                yield from self._encoded(block)
                block, size, chars = [], 0, 0
        yield from self._encoded(block)

    def _encoded(self, block: list[list[str]]) -> Iterator[np.ndarray]:
        self.learn(set().union(*block))
        for words in block:
            yield np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")

    def decode(self, ids) -> str:
        """The text of the ids: byte pieces are put together, marks become spaces, the first mark goes."""
        try:  # without bytes of longer characters
            out = list(map(self.decoded.__getitem__, ids))
        except KeyError:
            out, held = [], bytearray()
            for i in ids:
                b = self.bytes_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.decoded.get(i, ""))
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def coder(model: bytes) -> PieceCoder:
    """The coder of a serialised SentencePiece model that normalises nothing but white space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("models that normalise the text are not supported")
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    by_byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else None
    unk = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
    return PieceCoder(pieces, byte_ids, unk, "unigram" if proto.trainer_spec.model_type == 1 else "bpe", spec.add_dummy_prefix)


_coders: dict[str, PieceCoder] = {}


def _coder(model: bytes) -> PieceCoder:
    """One coder for each model and Python worker, with what it has learnt."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _coders:
        _coders[key] = coder(model)
    return _coders[key]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # the driver reads it; executors get the bytes (below 1 MB)
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """The columns ``keep`` (doc_id if None), ids (array of int) and n_tokens.

    A null or empty text has no ids. Texts are encoded whole, in memory that grows with their length. Repeated rows
    have equal results; an empty table gives an empty result; columns of ``docs`` beside ``keep`` and text, ids and
    n_tokens among them, are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = _shared(docs, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _coder(shared.value)
        for frame in frames:
            for k in range(0, len(frame), _ROWS):  # small frames, as ids take much memory on their way
                part = frame.iloc[k : k + _ROWS]
                yield pd.DataFrame({"row": part["row"], "ids": list(c.encode(list(part["text"])))})

    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")
    return out.select("row.*", "ids", F.size("ids").cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """The columns ``keep`` (doc_id if None) and the text of the column ids (null: empty)."""
    keep = ["doc_id"] if keep is None else keep
    shared = _shared(encoded, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _coder(shared.value)
        for frame in frames:
            yield pd.DataFrame({"row": frame["row"], "text": [c.decode(i.tolist()) for i in frame["ids"]]})

    rows = encoded.select(F.struct(*keep).alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInPandas(run, f"row {rows.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")


def encode_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """What encoding and decoding every whole text gives, without the ids themselves.

    Columns: doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and
    round_trip (whether decoding gives the text, a mark in it read as a space). Nulls, long texts, repeated rows, empty
    tables and other columns as in :func:`encode`.
    """
    shared = _shared(docs, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _coder(shared.value)
        byte_ids = np.array(sorted(c.bytes_of), np.int32)
        for frame in frames:
            texts, out = list(frame["text"]), []
            for text, ids in zip(texts, c.encode(texts)):
                back = c.decode(ids.tolist())
                n_bytes = int(((ids >= byte_ids[0]) & (ids <= byte_ids[-1])).sum()) if len(byte_ids) and byte_ids[-1] - byte_ids[0] == 255 else int(np.isin(ids, byte_ids).sum())
                out.append((len(ids), n_bytes, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), back == text.replace(MARK, " ")))
            yield pd.concat([frame[["row"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])], axis=1)

    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean"
    return rows.mapInPandas(run, schema).select("row.*", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip")
