"""Substring dedup by relative Lempel-Ziv parsing against every earlier document.

The reference is all documents, indexed in blocks at content-defined anchors: of the 16-word grams of a 50-word window, the
least hash is its anchor, so equal windows have equal anchors wherever they stand, and the words that an anchor's windows cover are
a block of 50 words or more. The index points every distinct block at its first occurrence (least doc_id, then place).
A document is factored from left to right: a factor starts at the next block that an earlier document holds and is extended, greedily,
over the blocks after it for as long as their pointers stay in one reference document and in step with the text; where they leave it, the
next factor starts. A factor is a duplicate span (doc_id, start, end, reference document, place there). At factor boundaries, that is in
blocks that no earlier document holds as a whole though their anchor is shared, every window is looked up by itself, which makes the
result exact: a word goes if and only if a 50-word window over it also starts in a document with a smaller id.

Only hashes of anchors (about one for 18 words) are shuffled, texts only to look up boundaries and to cut spans out. Texts are keyed by
doc_id and a hash of the text, so several texts under one doc_id are parsed apart. Counts per anchor and per block are aggregated
before they are shuffled; the joins that bring them back to the occurrences of a hot anchor are split by adaptive skew handling
(``common.tune``), as the occurrences are the side that can be cut. Windows are equal if the 64-bit hashes of their words and of their anchors are.

Defined results: a null text has no words; texts under 50 words lose nothing; very long texts are parsed whole; repeated rows with one
doc_id count as one document, so they keep their words, as do rows without a doc_id; several texts under one doc_id are each judged
against smaller ids; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .words import WordHasher

WINDOW = 50
GRAM = 16


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def anchors_of(hasher: WordHasher, sums: np.ndarray, n: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, last window) of each anchor of a text of n words."""
    g = np.arange(n - gram + 1)
    h = hasher.runs(sums, g, g + gram)
    width = window - gram + 1  # grams in a window
    best, at, have = h, g, 1
    while have < width:  # leftmost least of 2, 4, 8, ... grams, then of all
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        later = b < a
        best, at, have = np.where(later, b, a), np.where(later, at[step:], at[:-step]), have + step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    gram_at = at[first]
    # the block is the words its windows cover, and where the anchor stands among them
    block = hasher.runs(sums, first, last + window) ^ ((gram_at - first) * (width + 1) + (last - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return best[first], block, first, last


def greedy_factors(first: np.ndarray, last: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(start, end, source, place) of the factors of one text, from its blocks in order and what each points at (source < 0: nothing).

    Vectorised greedy parse: a block goes on with the factor before it if it is the next block, with the same source at the same shift.
    """
    hit = np.flatnonzero(source >= 0)
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    shift = place[hit] - first[hit]
    goes_on = (np.diff(hit) == 1) & (np.diff(source[hit]) == 0) & (np.diff(shift) == 0)
    opens = np.concatenate(([True], ~goes_on))
    closes = np.concatenate((~goes_on, [True]))
    head, tail = hit[opens], hit[closes]
    return first[head].astype(np.int64), last[tail].astype(np.int64) + window, source[head], place[head].astype(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): ``tag`` tells several texts under one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def parse(docs: DataFrame, ws: Workspace, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(factors, windows, texts) of ``docs``.

    factors: doc_id, tag and lists start, end, source (a smaller doc_id), place: one row a text with any. windows: doc_id, tag, start, end
    of duplicate windows at factor boundaries. texts: doc_id, tag, n_words and sha256 of all words, one row per row of ``docs``.
    """
    source = _source(docs)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            facts = []
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = hasher.words(text.as_py())
                n = len(words)
                facts.append((n, hashlib.sha256(b" ".join(words)).hexdigest()))
                if n < window or doc_id is None:  # without an id there is no earlier document
                    continue
                found = anchors_of(hasher, hasher.sums(words, n), n, window, gram)
                size = len(found[0])
                for c, x in zip(columns, (np.full(size, doc_id), np.full(size, tag), *found), strict=True):
                    c.append(x)
            # one row per text, with n_words and the hash, then the anchors, with neither
            none = len(facts)
            total = sum(map(len, columns[0]))
            cat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            pad = lambda a, t: pa.concat_arrays([pa.nulls(none, t), a])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.array(cat[0].astype(np.int64))]), pa.concat_arrays([batch.column(1), pa.array(cat[1].astype(np.int64))]),
                    pad(_signed(cat[2]), pa.int64()), pad(_signed(cat[3]), pa.int64()),
                    pad(pa.array(cat[4].astype(np.int32)), pa.int32()), pad(pa.array(cat[5].astype(np.int32)), pa.int32()),
                    pa.array([*(n for n, _ in facts), *([None] * total)], pa.int64()), pa.array([*(s for _, s in facts), *([None] * total)], pa.string()),
                ],
                names=["doc_id", "tag", "anchor", "block", "first", "last", "n_words", "all_sha256"],
            )

    rows = ws.stage(source.mapInArrow(index, "doc_id long, tag long, anchor long, block long, first int, last int, n_words long, all_sha256 string"), "index")
    texts = rows.where("n_words IS NOT NULL").select("doc_id", "tag", "n_words", "all_sha256")
    blocks = rows.where("n_words IS NULL").select("doc_id", "tag", "anchor", "block", "first", "last")

    # Anchors that two documents share. Most anchors are unique and end here.
    shared = ws.stage(
        blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("block") != F.max("block")).alias("differs")).where("lo < hi").select("anchor", "differs"), "shared"
    )
    repeated = ws.stage(blocks.join(shared, "anchor"), "repeated")
    # The index: where each distinct block stands first.
    pointers = ws.stage(repeated.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "tag", "first")).alias("at")).select("anchor", "block", F.col("at.doc_id").alias("source"), F.col("at.first").alias("place")), "pointers")
    pointed = repeated.join(pointers, ["anchor", "block"]).where("source < doc_id OR differs")
    # A text's list has at most one block per word of it.
    entry = F.struct("first", "last", "anchor", F.when(F.col("source") < F.col("doc_id"), F.col("source")).otherwise(F.lit(-1)).alias("source"), "place", (F.col("source") < F.col("doc_id")).alias("held"))
    listed = pointed.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(entry)).alias("blocks"))

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            marks = []
            for entries in batch.column(2):
                first, last, anchor, origin, place, held = (c.to_numpy(zero_copy_only=False) for c in entries.values.flatten())
                # sources may have negative ids: number them
                known, number = np.unique(origin, return_inverse=True)
                start, end, at, there = greedy_factors(first, last, np.where(held, number, -1), place, window)
                for o, x in zip(out, (start.astype(np.int32), end.astype(np.int32), known[at] if len(at) else at, there.astype(np.int32)), strict=False):
                    o.append(x)
                marks.append([{"anchor": int(a), "first": int(f), "last": int(e)} for a, f, e in zip(anchor[~held], first[~held], last[~held], strict=True)])
            lists = [pa.array(o, pa.list_(t)) for o, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=False)]
            edge = pa.array(marks, pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, edge], names=["doc_id", "tag", "start", "end", "source", "place", "edges"])

    schema = "doc_id long, tag long, start array<int>, end array<int>, source array<long>, place array<int>, edges array<struct<anchor:long,first:int,last:int>>"
    parsed = ws.stage(listed.mapInArrow(factor, schema), "parsed")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for doc_id, tag, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = hasher.words(text.as_py())
                sums = hasher.sums(words, len(words))
                at = marks.values.flatten()
                first, last = at[1].to_numpy(), at[2].to_numpy()
                n = last - first + 1
                start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.full(len(start), doc_id), np.full(len(start), tag), np.repeat(at[0].to_numpy(), n), hasher.runs(sums, start, start + window).view(np.int64), start.astype(np.int32)))
                if sum(len(o[0]) for o in out) > 100_000:
                    yield _windows(out)
                    out = []
            yield _windows(out)

    def _windows(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tag", "anchor", "hash", "start"])

    edges = parsed.where(F.size("edges") > 0).select("doc_id", "tag", "edges")
    single = ws.stage(source.join(edges, ["doc_id", "tag"]).mapInArrow(windows, "doc_id long, tag long, anchor long, hash long, start int"), "windows")
    earliest = ws.stage(single.groupBy("anchor", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi").select("anchor", "hash", "owner"), "earliest")
    inner = single.join(earliest, ["anchor", "hash"]).where("doc_id > owner").select("doc_id", "tag", "start", (F.col("start") + window).alias("end"))
    return parsed.where(F.size("start") > 0).drop("edges"), inner, texts


def find_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse itself: doc_id, start, end (words), source (a smaller doc_id), place (word there) of every factor."""
    factors, _, _ = parse(docs, Workspace(docs.sparkSession, "substring-factors"), window, gram)
    return factors.select("doc_id", F.inline(F.arrays_zip("start", "end", "source", "place")))


def merged_spans(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the words left, joined by one space."""
    ws = Workspace(docs.sparkSession, "substring-dedup")
    factors, inner, texts = parse(docs, ws, window, gram)
    # a text's list has at most one span per word of it
    alone = inner.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    both = factors.select("doc_id", "tag", F.col("start").alias("starts"), F.col("end").alias("ends")).unionByName(alone)
    cuts = ws.stage(both.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = merged_spans(starts.values.to_numpy(), ends.values.to_numpy(), len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    touched = _source(docs).join(cuts, ["doc_id", "tag"]).select("doc_id", "text", "starts", "ends").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    untouched = texts.join(cuts.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("all_sha256").alias("kept_sha256"))
    return touched.unionByName(untouched)
