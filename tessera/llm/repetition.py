"""Quality rules by repetition coverage: how many characters of a text lie inside repeated n-grams and lines.

Words are numbered per text, n-gram hashes for all lengths are rolled from one prefix sum, and coverage is measured in
numpy over character offsets. The thresholds are the published repetition limits for web corpora (share of characters
in the most frequent 2- to 4-gram, and in all duplicated 5- to 10-grams and lines).

Two published limits are read with a text's length in mind, at every size of the table alike: the share of one frequent short n-gram is not judged
in texts under TOP_FROM_WORDS words, where a few words said twice are a large share, and ALLOWANCE_WORDS words inside duplicates are
spared, so that one passage said twice is no spam. N-grams count as equal if their 64-bit hashes are.

Defined results: a null text has no words; an empty one neither, and fails the word minimum; very long texts are read
whole; of n-grams that tie in frequency the one with the most characters counts; repeated rows are judged alike; an empty table gives an empty
result; other columns, whatever their names, pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune
from .words import mix

#: Largest share of characters inside the most frequent n-gram, for n of 2 to 4 (fixed values).
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of characters inside any duplicated n-gram, for n of 5 to 10 (fixed values).
DUP_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside duplicated lines.
LINE_SHARE = 0.30
#: The share of one frequent short n-gram means little in a short text: below so many words only coverage counts.
TOP_FROM_WORDS = 100
MIN_WORDS = 50
#: So many words inside duplicates are spared whatever their share: one passage and its repetition.
ALLOWANCE_WORDS = 64
#: More symbols than this to a word is markup residue: the same mark repeated after word upon word.
SYMBOLS_PER_WORD = 0.3

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, top_shares array<double>, dup_shares array<double>"
)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Repetition:
    """Measures one text at a time; keeps the power tables between texts."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __call__(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.split()  # bytes split at exactly the six blanks
        n = len(words)
        lines = [w for line in raw.split(b"\n") if (w := line.strip())] if b"\n" in raw else []
        n_dup_lines, dup_line_chars = self._lines(raw) if lines else (0, 0)
        symbols = len(_SYMBOL.findall(text or ""))
        if not n:
            return 0, 0, symbols, n_dup_lines, 0, True, False, 0.0, [0.0] * len(TOP_SHARE), [0.0] * len(DUP_SHARE)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        long_of = np.fromiter((len(w.decode()) for w in number), np.int64, len(number))
        chars = long_of[ids]
        ends = np.concatenate(([0], np.cumsum(chars)))
        total = int(ends[-1])
        repeat = self._repeat_words(ids, len(number))
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        # Rolling hashes of every length come from one prefix sum: window [i, i+k) is (sum[i+k] - sum[i]) * base**-i.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)))
        tops, dups = [], []
        none_longer = False
        for k in (*TOP_SHARE, *DUP_SHARE):
            if n < k or none_longer or (k > 2 and not repeat):  # a duplicated k-gram holds duplicated shorter ones
                (tops if k in TOP_SHARE else dups).append(0.0)
                continue
            _, inverse, counts = np.unique((sums[k:] - sums[:-k]) * self.down[: n - k + 1], return_inverse=True, return_counts=True)
            none_longer = len(counts) == n - k + 1
            if k in TOP_SHARE:
                at = counts[inverse]
                most = int(at.max())
                # of the n-grams that are as frequent as any, the one with the most characters
                tops.append(0.0 if most < 2 else float(most * (ends[k:] - ends[:-k])[at == most].max()) / total)
            else:
                dups.append(float(self._covered(counts[inverse] > 1, k, chars)) / total)
        line_share = dup_line_chars / total
        base_failed = n < MIN_WORDS or 100 * repeat > 50 * n
        spared = ALLOWANCE_WORDS / n  # one passage said twice is no spam in a short text
        repetitive = line_share > max(LINE_SHARE, spared) or any(x > max(y, spared) for x, y in zip(dups, DUP_SHARE.values(), strict=True))
        repetitive |= symbols > SYMBOLS_PER_WORD * n
        if n >= TOP_FROM_WORDS:
            repetitive |= any(x > y for x, y in zip(tops, TOP_SHARE.values(), strict=True))
        return n, total, symbols, n_dup_lines, repeat, base_failed, not base_failed and not repetitive, line_share, tops, dups

    @staticmethod
    def _lines(raw: bytes) -> tuple[int, int]:
        """Lines with a word that equal an earlier line, and the characters of their words."""
        seen: set[bytes] = set()
        n = chars = 0
        for line in raw.split(b"\n"):
            if line in seen:
                n += 1
                chars += len(b"".join(line.split()).decode())
            elif line and line.split():
                seen.add(line)
        return n, chars

    @staticmethod
    def _covered(hit: np.ndarray, k: int, weights: np.ndarray) -> int:
        """The weight of the words that lie in a window of k words whose start is hit."""
        edge = np.zeros(len(weights) + 1, np.int64)
        edge[: len(hit)] += hit
        edge[k : k + len(hit)] -= hit
        return int(weights[np.cumsum(edge[:-1]) > 0].sum())

    def _repeat_words(self, ids: np.ndarray, distinct: int) -> int:
        """Words inside 3-word windows that occur twice or more: windows are compared exactly, not by hash."""
        n = len(ids)
        if n < 4:
            return 0
        if distinct < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        else:
            _, inverse, counts = np.unique(np.stack((ids[:-2], ids[1:-1], ids[2:]), axis=1), axis=0, return_inverse=True, return_counts=True)
        return self._covered(counts[inverse.ravel()] > 1, 3, np.ones(n, np.int64))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the columns of SCHEMA."""
    tune(docs.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Repetition()
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return docs.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass and without a shuffle."""
    tune(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Repetition()
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
