"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once. The byte lengths of its tokens give each token's span, the spans are joined
with the sections' spans (two sorted lists, by binary search), and each token is allocated by a rule:

* ``start``: to the section that holds the token's first byte;
* ``most``: to the section that holds most of its bytes, the earlier one of equals.

So the counts of a document's sections always add up to its tokens, which counts of separately encoded sections
do not. Sections cover the document without gaps; by default they are its lines, each with its line feed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts before byte-level merging, as the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most")

_encodings: dict[str, tuple] = {}


def _encoding(ranks: bytes, pattern: str):
    """The encoding and its tokens' byte lengths, one for each vocabulary and Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            sizes[rank] = len(token)
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes
    return _encodings[key]


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.r_[0, feeds[feeds < len(raw)]] if raw else np.empty(0, np.int64)


def attribute(sizes: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them reach over its end or beginning.

    ``sizes`` are the tokens' byte lengths in order, ``starts`` the sections' first bytes, increasing from 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    end = np.cumsum(sizes)
    begin = end - sizes
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        bounds = np.append(starts, end[-1] if len(end) else 0)
        for k in crossing:
            covered = [min(end[k], bounds[j + 1]) - max(begin[k], bounds[j]) for j in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(covered))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, rule: str = "start", sections: Callable[[bytes], np.ndarray] = line_starts, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Token counts of every document's sections.

    Columns: doc_id, section (from 0), start and end (code points), n_tokens, n_crossing (tokens allocated here that
    reach into another section) and doc_tokens. A null or empty text has one section of no characters and no tokens.
    Long texts are encoded whole; repeated rows and null ids each have their sections; an empty table gives an empty
    result; other columns of ``docs``, ``section`` or ``start`` among them, are not read.
    ``sections`` gets a text's UTF-8 bytes and returns the first byte of each section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as f:  # the driver reads it; executors get the bytes (below 1 MB)
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, sizes = _encoding(shared.value, pattern)
        for frame in frames:
            parts = []
            for text in frame["text"]:
                raw = text.encode()
                if not raw:
                    parts.append((np.zeros(1, np.int64),) * 5 + (0,))
                    continue
                starts = sections(raw)
                tokens = sizes[np.asarray(encoding.encode_ordinary(text), np.int64)]
                counts, crossing = attribute(tokens, starts, rule)
                leads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                chars = np.append(0, leads)[np.append(starts, len(raw))]
                parts.append((np.arange(len(starts)), chars[:-1], chars[1:], counts, crossing, len(tokens)))
            n = [len(p[0]) for p in parts]
            columns = {c: np.concatenate([p[k] for p in parts]) if parts else [] for k, c in enumerate(("section", "start", "end", "n_tokens", "n_crossing"))}
            out = pd.DataFrame(columns)
            out["doc_tokens"] = np.repeat([p[5] for p in parts], n)
            at = np.repeat(np.arange(len(parts)), n)
            yield pd.concat([frame[["row"]].iloc[at].reset_index(drop=True), out], axis=1)

    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    return rows.mapInPandas(run, schema).select("row.*", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")


def field_tokens(rows: DataFrame, fields: list[str], rule: str = "start", ranks: str = RANKS, pattern: str = PATTERN, separator: str = "\n") -> DataFrame:
    """Token counts of several text fields of a row, which are encoded as one text.

    The fields, null ones as empty, are put together with ``separator``, each separator belonging to the field before
    it. Columns: doc_id, field, n_tokens, n_crossing, doc_tokens. Repeated rows and rows without an id each have their
    fields; long texts are encoded whole; an empty table gives an empty result; columns other than doc_id and the
    fields are not read, whatever their names.
    """
    if "\0" in separator:
        raise ValueError("the separator can't hold the sign that marks fields")
    # the sign 0 marks where fields begin; in a field it is written as a space, which has as many bytes
    parts = [F.translate(F.coalesce(F.col(f).cast("string"), F.lit("")), "\0", " ") for f in fields]
    marked = F.concat_ws("\0", *parts)
    head = F.array(*[F.octet_length(p) for p in parts])
    n = len(separator.encode())

    with open(ranks, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, sizes = _encoding(shared.value, pattern)
        for frame in frames:
            out = []
            for i, (text, lengths) in enumerate(zip(frame["text"], frame["lengths"])):
                tokens = sizes[np.asarray(encoding.encode_ordinary(text.replace("\0", separator)), np.int64)]
                starts = np.cumsum([0, *(int(k) + n for k in lengths[:-1])])
                counts, crossing = attribute(tokens, starts, rule)
                out += [(i, f, int(a), int(b), len(tokens)) for f, a, b in zip(fields, counts, crossing)]
            table = pd.DataFrame(out, columns=["at", "field", "n_tokens", "n_crossing", "doc_tokens"])
            yield pd.concat([frame[["row"]].iloc[table.pop("at")].reset_index(drop=True), table], axis=1)

    given = rows.select(F.struct("doc_id").alias("row"), marked.alias("text"), head.alias("lengths"))
    schema = f"row {given.schema['row'].dataType.simpleString()}, field string, n_tokens long, n_crossing long, doc_tokens long"
    return given.mapInPandas(run, schema).select("row.*", "field", "n_tokens", "n_crossing", "doc_tokens")
