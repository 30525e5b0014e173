"""Fill-in-the-middle transformation with cuts found in a wavelet matrix over character classes.

Each code point of a text has a class: white space, digit, other sign, first letter of a run of letters, further
letter of a run. The wavelet matrix of the classes keeps one bit row for each bit of a class, stably parted from row to
row, with counts of ones for every 64 bits. How often a class occurs before a place is then one rank query, and the
number of units (tokens) that begin before it is the sum over the classes that begin one. That count never falls, so
bisection on ranks finds the place where the k-th unit begins, and with it both cuts of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of code points; a unit begins at each of them but INSIDE.
SPACE, DIGIT, SIGN, FIRST, INSIDE = range(5)
TOKENS = (SPACE, DIGIT, SIGN, FIRST)
CHARACTERS = (SPACE, DIGIT, SIGN, FIRST, INSIDE)
#: Markers before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class WaveletMatrix:
    """Rank and select over a sequence of small codes."""

    def __init__(self, codes: np.ndarray, levels: int = 3):
        self.n, self.levels = len(codes), levels
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []  # ones before each word of 64 bits
        self.zeros: list[int] = []
        for level in reversed(range(levels)):
            bits = (codes >> level & 1).astype(bool)
            packed = np.zeros(8 * (self.n // 64 + 1), np.uint8)
            packed[: -(-self.n // 8)] = np.packbits(bits, bitorder="little")
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(self.n - ones.sum()))
            codes = np.concatenate([codes[~bits], codes[bits]])

    def _ones(self, row: int, i: int) -> int:
        return int(self.before[row][i >> 6]) + (int(self.words[row][i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def rank(self, code: int, i: int) -> int:
        """How often the code occurs among the first i."""
        low, high = 0, i
        for row in range(self.levels):
            a, b = self._ones(row, low), self._ones(row, high)
            if code >> (self.levels - 1 - row) & 1:
                low, high = self.zeros[row] + a, self.zeros[row] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, codes: tuple[int, ...], i: int) -> int:
        """How many of the first i have one of the codes; counted by those that have not, where these are fewer."""
        others = [c for c in range(1 << self.levels) if c not in codes and c <= INSIDE]
        if len(others) < len(codes):
            return i - sum(self.rank(c, i) for c in others)
        return sum(self.rank(c, i) for c in codes)

    def select(self, codes: tuple[int, ...], k: int) -> int:
        """The place of the k-th (from 0) of the codes, the length if there are no more: bisection on ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.count(codes, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low


def classes(text: str) -> np.ndarray:
    """The class of each code point; letters are A-Z and a-z."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points | 32) - np.uint32(97) < 26
    out = np.full(len(points), SIGN, np.uint8)
    out[(points == 32) | (points - np.uint32(9) < 5)] = SPACE
    out[points - np.uint32(48) < 10] = DIGIT
    out[letter] = FIRST
    out[1:][letter[1:] & letter[:-1]] = INSIDE
    return out


def cuts(text: str, first: int, second: int, begins: tuple[int, ...] = TOKENS) -> tuple[int, int, int]:
    """Number of units n, and the places of the cuts before the units first % (n + 1) and second % (n + 1), in order."""
    matrix = WaveletMatrix(classes(text))
    n = matrix.count(begins, matrix.n)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, matrix.select(begins, a), matrix.select(begins, b)


def transformed(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, begins: tuple[int, ...] = TOKENS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output, the text to train on.

    Cuts and form follow from a hash of seed and id, so reruns agree. Texts without characters or with a marker of
    ours stay plain. A null text counts as empty, a null id as the empty text in the hash. Repeated rows share their
    result; texts are read whole; an empty table gives an empty result; other columns of ``docs`` are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text, h1, h2, h3, h4 in zip(frame["text"], frame["h1"], frame["h2"], frame["h3"], frame["h4"]):
                n, a, b = cuts(text, h1, h2, begins)
                if not text or h3 % 100 >= 100 - plain_percent or any(m in text for m in MARKS):
                    found.append((n, "plain", None, None, text))
                    continue
                prefix, suffix = MARKS[0] + text[:a], MARKS[1] + text[b:]
                form = "spm" if h4 % 100 < spm_percent else "psm"
                found.append((n, form, a, b - a, (suffix + prefix if form == "spm" else prefix + suffix) + MARKS[2] + text[a:b]))
            out = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
            out.insert(0, "row", frame["row"])
            yield out

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"), *parts)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInPandas(run, f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output was made from; markers can't arise where the parts meet."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    second = F.when(form == "spm", F.lit(MARKS[0])).otherwise(F.lit(MARKS[1]))
    at, middle = F.instr(output, second), F.instr(output, F.lit(MARKS[2]))
    one = F.substr(output, F.lit(4), at - 4)
    two = F.substr(output, at + 3, middle - at - 3)
    last = F.substr(output, middle + 3, F.length(output))
    cut = F.when(form == "spm", F.concat(two, last, one)).otherwise(F.concat(one, last, two))
    return F.when(form == "plain", output).otherwise(cut)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """:func:`transformed` with digests in place of texts: output_sha256 and restored_sha256."""
    sha = lambda c: F.sha2(c, 256)
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
h AS (
  SELECT *, len(tok) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(tok) + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (len(tok) + 1) AS c2,
         CAST('0x' || s[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4
  FROM d),
p AS (
  SELECT *, array_to_string(tok[1:least(c1, c2)], '') AS prefix, array_to_string(tok[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(tok[greatest(c1, c2) + 1:], '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
