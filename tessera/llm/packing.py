"""Best-fit packing of token pieces into sequences by bin completion.

A packing only depends on how many pieces have each length, and there are at most ``capacity`` lengths: that histogram
(bounded, whatever the corpus) is all the driver sees. Bin completion works on it: around the largest remaining length
it enumerates undominated fillings, best-filled first, applies a filling to as many sequences as the counts allow,
and prunes branches whose waste can no longer beat the best-fit-decreasing incumbent. The answer is a list of patterns
with multiplicities; executors give every piece its rank among pieces of its length, and the rank names its place.

Defined results: a null text is empty and packs as its end id alone; a very long text is cut into full pieces, the first one taking the
remainder; pieces of equal length take their places by doc_id and piece; repeated rows are packed each; no rows give no sequences; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_ids import END, PackedEncoder, small_batches
from .common import Workspace

CAPACITY = 2048
#: Search nodes that bin completion may open after the best-fit incumbent.
NODES = 8_000
#: Fillings kept for one node.
WIDTH = 3
#: Steps of one enumeration of fillings.
STEPS = 600
#: Parts in which the pieces of one length are ranked.
WAYS = 1024

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, and how many sequences have them


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: total length, and pieces over a threshold that cannot share (Martello and Toth)."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 1)
    pieces, tokens = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * size)))  # of lengths below i
    half = capacity // 2
    k = np.arange(half + 1)
    alone = pieces[-1] - pieces[half + 1]  # over half a sequence: no two share one
    small = tokens[half + 1] - tokens[k]  # from k to half
    free = (pieces[capacity - k + 1] - pieces[half + 1]) * capacity - (tokens[capacity - k + 1] - tokens[half + 1])
    return int(max(-(-int(tokens[-1]) // capacity), int((alone + np.maximum(0, -((free - small) // capacity))).max())))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: sequences with equal contents move together."""
    by_free: dict[int, list[list]] = {}
    frees: list[int] = []

    def put(free: int, items: tuple[int, ...], n: int) -> None:
        if free not in by_free:
            by_free[free] = []
            insort(frees, free)
        by_free[free].append([items, n])

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect_left(frees, x)
            if at == len(frees):
                each = min(capacity // x, left)
                put(capacity - each * x, (x,) * each, left // each)
                left -= each * (left // each)
                continue
            free = frees[at]
            items, n = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                frees.pop(at)
            each = min(free // x, left)
            many = min(n, left // each)
            if n > many:
                put(free, items, n - many)
            put(free - each * x, items + (x,) * each, many)
            left -= each * many
    return [(items, n) for groups in by_free.values() for items, n in groups]


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from ascending ``lengths``, the fullest first, of those the one with the largest pieces.

    A filling is dominated if a length outside it fits in the room that is left plus the room of some of its items:
    swapping those for it leaves smaller pieces for later. Enumeration goes from large to small and ends early once
    ``width`` fillings without waste are known, since no other is fuller.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    exact = steps = 0
    # (largest index that may still be used, room left, items)
    stack: list[tuple[int, int, tuple[int, ...]]] = [(len(lengths), room, ())]
    least = lengths[0] if lengths else room + 1
    while stack and exact < width and steps < STEPS:
        top, left, items = stack.pop()
        steps += 1
        at = bisect_right(lengths, left, 0, top) - 1
        if at < 0:
            found.append((left, items))
            exact += left == 0
            continue
        x = lengths[at]
        most = min(counts[x], left // x)
        if left - x >= least or at:
            stack.append((at, left, items))  # without x: only smaller ones
        for n in range(1, most + 1):  # the most of x is looked at first
            stack.append((at, left - n * x, items + (x,) * n))
    ranked = sorted(set(found), key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))[: 4 * width]

    def dominated(waste: int, items: tuple[int, ...]) -> bool:
        sizes = range(len(items) + 1) if len(items) <= 6 else range(2)
        for s in {sum(c) for k in sizes for c in itertools.combinations(items, k)}:
            at = bisect_right(lengths, s + waste) - 1
            while at >= 0 and lengths[at] > s:
                if counts[lengths[at]] > items.count(lengths[at]):
                    return True
                at -= 1
        return False

    kept = []
    for waste, items in ranked:
        if len(kept) < width and (waste == 0 or not dominated(waste, items)):
            kept.append(items)
    return kept or [ranked[0][1] if ranked else ()]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns and multiplicities that place all counted lengths; as few sequences as the search finds or proves least."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must be from 1 to the capacity")
    incumbent = best_fit(counts, capacity)
    most = sum(n for _, n in incumbent)
    least = lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    opened = 0
    # Depth first, without recursion: (counts left, patterns so far, sequences so far, waste so far)
    stack: list[tuple] = [(counts, None, 0, 0)]
    while stack and most > least and opened < nodes:
        left, made, n_made, waste = stack.pop()
        # all sequences of an improvement together have this much room to waste; more cannot improve
        if waste > (most - 1) * capacity - total:
            continue
        if not left:
            if n_made < most:
                most, incumbent = n_made, []
                while made:
                    made, pattern = made
                    incumbent.append(pattern)
            continue
        opened += 1
        if opened % 64 == 0 and n_made + lower_bound(left, capacity) >= most:
            continue
        x = max(left)
        rest = dict(left)
        rest[x] -= 1
        if not rest[x]:
            del rest[x]
        children = []
        for filling in fillings(sorted(rest), rest, capacity - x):
            items = (x, *filling)
            each = Counter(items)
            times = min(left[k] // c for k, c in each.items())
            after = dict(left)
            for k, c in each.items():
                after[k] -= times * c
                if not after[k]:
                    del after[k]
            children.append((after, (made, (items, times)), n_made + times, waste + times * (capacity - sum(items))))
        stack += children[::-1]
    return incumbent


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For pieces ranked within their length: sorted (length, first rank) keys, and where each run of ranks goes."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in patterns:
        offset = 0
        for x in items:
            rows.append(((x << 44) + rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (staged; with columns doc_id, piece, length) with sequence_id and offset beside them."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(WAYS)).cast("int")
    ranked = pieces.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")))
    sizes = pieces.groupBy("length", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "first")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    where = places(bin_completion(counts, capacity))
    table = pieces.sparkSession.sparkContext.broadcast(where)  # bounded by the number of patterns, not of pieces
    schema = pieces.schema.simpleString()[len("struct<") : -1]
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = table.value["key"], table.value["sequence"], table.value["offset"]
        for batch in batches:
            want = (batch.column("length").to_numpy() << 44) + batch.column("slot").to_numpy()
            at = np.searchsorted(key, want, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + want - key[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    with_slot = ranked.join(firsts, ["length", "part"]).select(*names, (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))
    return with_slot.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Every text ends with id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PackedEncoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in small_batches(texts):
                rows = []
                for doc_id, raw in zip(ids[first : first + len(part)], encoder.encode(part), strict=True):
                    raw += END
                    n = len(raw) // 4
                    head = n - (n - 1) // capacity * capacity
                    for piece, start in enumerate((0, *range(head, n, capacity))):
                        end = head if not piece else start + capacity
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all texts: token_pieces with sequence_id and offset. Texts are read and encoded once."""
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.stage(token_pieces(docs, tokenizer, capacity), "pieces"), ws, capacity)
