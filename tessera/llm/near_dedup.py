"""Near-duplicate classes by DartMinHash signatures and a banded join, checked exactly.

Every shingle owns a region one unit high for each unit of its weight, along an axis of ranks. Hashed darts fall on the
regions as a Poisson process, cell by cell in ascending rank; a dart names a coordinate, and each coordinate keeps its
earliest dart. A text stops throwing when all coordinates have one, so the cost follows the number of darts, not
coordinates times shingles. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of coordinates are buckets. Copies (equal words) are one node. In a bucket every node is checked against the
bucket's least node. Where that leaves two classes in a bucket, all its pairs across classes are checked exactly: pair by
pair in buckets of a few nodes, and block against block in all others. A block holds a bounded part of a bucket, and a
pair of blocks is one group of rows, in which a node that the others' shingles do not cover well enough is left out and
overlaps of the rest are matrix products. So rows grow with a bucket's nodes times its blocks outside the largest class;
no bucket is capped, and two similar texts miss each other only if they share no band.
A link is a pair whose shingle sets have a Jaccard similarity of at least the threshold; classes are its components.
Sets are compared by the 64-bit hashes of their shingles.

Defined results: a null text is empty; texts of one to four words have one shingle, their words; texts without
words are copies of each other; very long texts count whole; repeated rows are copies, and several texts under one doc_id are texts of
their own; of rows that tie for a class the least doc_id stays, then the first row; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, group_facts
from .components import components
from .words import WordHasher, mix

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 42
ROWS = 6
#: Mixed buckets of up to so many nodes are checked pair by pair; larger ones block against block.
FEW = 4
#: What a block of a bucket holds: its shingles, and so many more for each node.
BLOCK = 1 << 20
NODE = 256
#: Nodes and shingles of one matrix product.
TILE, COLUMNS = 256, 8192

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def shingles(hasher: WordHasher, words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of the whole text if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, n - width + 1))
    return hasher.runs(hasher.sums(words, n), start, np.minimum(start + width, n))


class DartMinHash:
    """Signatures of ``size`` coordinates from element hashes and weights."""

    def __init__(self, size: int):
        self.size = size
        # Cells of the rank axis: [0, 2**-8), then doubling up to 1, then of width 1. Each holds Poisson(width) darts per unit of weight.
        edges = [0.0, *(2.0**-e for e in range(8, 0, -1)), 1.0]
        self.edges = np.array(edges)
        self.widths = np.array([y - x for x, y in itertools.pairwise(edges)] + [1.0])  # of all cells from the last on
        # least hashes (as 64-bit fractions) with which a cell has no n-th dart, for n from 1 on
        self.limits = np.array([[self._at_least(w, n) * 2.0**64 for w in self.widths] for n in range(1, 12)]).clip(0, 2.0**64 - 2048).astype(np.uint64)

    @staticmethod
    def _at_least(width: float, n: int) -> float:
        """The probability of n or more darts in a cell."""
        return 1.0 - math.exp(-width) * sum(width**i / math.factorial(i) for i in range(n))

    def __call__(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The signature: the hash of the earliest dart in every coordinate. Elements are distinct; weights are positive."""
        out = np.zeros(self.size, np.uint64)
        if weights is None:
            regions, height = elements, None
        else:  # one region per started unit of weight; the last is as high as what is left
            units = np.ceil(weights).astype(np.int64)
            level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
            regions = mix(np.repeat(elements, units) + level.astype(np.uint64) * _GOLD)
            height = np.minimum(np.repeat(weights, units) - level, 1.0)
        empty = np.ones(self.size, bool)
        # cells up to the rank by which all coordinates have a dart, as a rule; then a few more at a time
        rank = self.size * (math.log(self.size) + 1.0) / len(regions)
        first, last = 0, int(np.searchsorted(self.edges, rank)) if rank <= 1 else len(self.edges) - 1 + math.ceil(rank - 1)
        while empty.any():
            d, key = self._darts(regions, height, first, max(last, first + 1))
            coordinate = (d >> np.uint64(40)) % np.uint64(self.size)
            free = empty[coordinate]
            order = np.argsort(key[free])[::-1]  # the earliest is written last
            coordinate, d = coordinate[free][order], d[free][order]
            out[coordinate] = d
            empty[coordinate] = False
            first = max(last, first + 1)
            last = first + 1 + first // 4
        return out

    def _darts(self, regions: np.ndarray, height: np.ndarray | None, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Darts in cells [first, last): their hashes, and keys in the order of their ranks."""
        cells = np.arange(first, last)
        kind = np.minimum(cells, len(self.widths) - 1)
        salt = (cells.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        h = mix(regions ^ salt[:, None])
        at = np.flatnonzero(h < self.limits[0][kind][:, None])
        h, cell = h.ravel()[at], at // len(regions)
        darts, places = [], []
        for n in range(1, len(self.limits) + 1):
            darts.append(mix(h + np.uint64(n * int(_GOLD) & _MASK)))
            places.append((cell, at))
            if n == len(self.limits):
                break
            more = h < self.limits[n][kind[cell]]
            h, cell, at = h[more], cell[more], at[more]
            if not len(h):
                break
        d = np.concatenate(darts)
        cell = np.concatenate([c for c, _ in places])
        if height is not None:
            low = (mix(d) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < height[np.concatenate([a for _, a in places]) % len(regions)]
            d, cell = d[low], cell[low]
        return d, (cell.astype(np.uint64) << np.uint64(40)) | (d & np.uint64(0xFFFFFFFFFF))  # the low bits are the rank inside the cell


def band_buckets(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One bucket hash per band."""
    h = np.arange(bands, dtype=np.uint64) * _GOLD
    for i in range(rows):
        h = mix(h + signature[i * bands : (i + 1) * bands])
    return h


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], n: int) -> np.ndarray:
    """How many elements (numbers under ``n``) each set of ``a`` shares with each set of ``b``."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    seen, place = np.zeros(n, bool), np.full(n, -1)
    seen[flat_a] = True
    common = np.unique(flat_b[seen[flat_b]])
    place[common] = np.arange(len(common))
    sides = []
    for sets, flat in ((a, flat_a), (b, flat_b)):
        row, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), place[flat]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order]))
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(common), COLUMNS):
        width, dense = min(COLUMNS, len(common) - start), []
        for (row, column), size in zip(sides, out.shape, strict=True):
            x, y = np.searchsorted(column, (start, start + width))
            dense.append(np.zeros((size, width), np.float32))
            dense[-1][row[x:y], column[x:y] - start] = 1
        out += dense[0] @ dense[1].T
    return out


def block_links(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of one pair of blocks, from exact checks of all pairs between side 0 and side 1 (within side 0, if there is no other).

    Every pair of different labels whose similarity reaches ``threshold`` ends in one class by these links; no more of them than classes are given.
    """
    alone = not sides.any()
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own, n = np.repeat(np.arange(len(sets)), size), int(flat.max(initial=-1)) + 1
    alive = size > 0
    while True:  # a node has partners only if the nodes it is compared with hold enough of its shingles
        held = alive[own]
        counts = [np.bincount(flat[held & (sides[own] == side)], minlength=n) for side in (0, 1)]
        useful = counts[0][flat] > 1 if alone else np.where(sides[own] == 0, counts[1][flat], counts[0][flat]) > 0
        covered = np.bincount(own[useful & held], minlength=len(sets))
        kept = alive & (covered >= threshold * size - 1e-9)
        if (kept == alive).all():
            break
        alive = kept
    starts = np.cumsum(size) - size
    ids = lambda rows: [flat[starts[i] : starts[i] + size[i]] for i in rows]
    order = np.flatnonzero(alive)[np.argsort(size[alive], kind="stable")]
    tiles = [[rows[k : k + TILE] for k in range(0, len(rows), TILE)] for rows in (order[sides[order] == 0], order[sides[order] == (0 if alone else 1)])]
    classes, links = np.unique(labels, return_inverse=True)[1], []
    for at, x in enumerate(tiles[0]):
        for y in tiles[1][at:] if alone else tiles[1]:
            if min(size[x[-1]], size[y[-1]]) < threshold * max(size[x[0]], size[y[0]]) - 1e-9 or not (classes[x][:, None] != classes[y]).any():
                continue
            both = _overlaps(ids(x), ids(y), n)
            near = both >= threshold * (size[x][:, None] + size[y] - both) - 1e-9
            for i, row in zip(x, near, strict=True):
                for j in y[row & (classes[y] != classes[i])]:
                    if classes[i] != classes[j]:
                        links.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
                        classes[classes == classes[j]] = classes[i]
    return links


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_tag"))


def _elements(found: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    elements, counts = np.unique(found, return_counts=True)
    return elements, counts.astype(np.float64) if counted else None


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), class_size, kept (one row a class), n_copies, n_links, text_tag (xxhash64 of its text).

    ``counted`` weighs a shingle by how often it occurs (weighted Jaccard) instead of once (Jaccard of sets).
    n_links counts the links that were found for the row's text; the copies of a text are not links, and pairs of blocks
    give the links that join classes only.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near-dedup")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dart = WordHasher(), DartMinHash(BANDS * ROWS)
        for batch in batches:
            digests, bands = [], []
            for text in batch.column(1):
                words = hasher.words(text.as_py())
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bands.append(band_buckets(dart(*_elements(shingles(hasher, words, width), counted))).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "text_tag", "digest", "bands"])

    rows = ws.stage(_source(docs).mapInArrow(sign, "doc_id long, text_tag long, digest binary, bands binary").withColumn("row_tag", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct("doc_id", "row_tag"))
    members = ws.stage(
        group_facts(rows.drop("bands"), ["digest"], ["row_tag"], [("first", first, F.min("first")), ("n_copies", F.count(F.lit(1)), F.sum("n_copies"))]).select(
            "doc_id", "text_tag", "row_tag", F.col("first.row_tag").alias("node"), "n_copies"
        ),
        "members",
    )
    nodes = ws.stage(
        rows.join(members.where("row_tag = node").select("row_tag"), "row_tag").where("bands IS NOT NULL").select(F.col("row_tag").alias("node"), "doc_id", "digest", "bands"), "nodes"
    )

    def explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                band = np.tile(np.arange(BANDS, dtype=np.int8), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(buckets), pa.array(band)], names=["node", "bucket", "band"])

    dealt = nodes.select("node", "bands").mapInArrow(explode_bands, "node long, bucket long, band byte")
    shared = ws.stage(dealt.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    held = ws.stage(dealt.join(shared, "bucket"), "held")

    # Shingle sets of the nodes that share a bucket with another, from their texts.
    wanted = held.select("node").distinct().join(nodes.select("node", "doc_id", "digest"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            out_nodes, out = [], []
            for text, node, digest in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = hasher.words(text.as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) != digest:
                    continue  # another text under the same doc_id
                found = shingles(hasher, words, width)
                if counted:
                    found = np.sort(found)
                    nth = np.arange(len(found)) - np.searchsorted(found, found)
                    found = mix(found + nth.astype(np.uint64) * _GOLD)
                out_nodes.append(node)
                out.append(np.unique(found).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "elements"])

    source = _source(docs).drop("text_tag").withColumnRenamed("doc_id", "text_id")
    elements = ws.stage(
        source.join(wanted, F.col("text_id").eqNullSafe(F.col("doc_id"))).select("text", "node", "digest").mapInArrow(sets, "node long, elements binary").dropDuplicates(["node"]), "elements"
    )

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= threshold * max(len(p), len(q)) else 0
                    good.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        of = lambda end: elements.select(F.col("node").alias(end), F.col("elements").alias(f"{end}_elements"))
        one = pairs.join(of("b"), "b")
        return ws.stage(one.join(of("a"), "a").select("a", "b", "a_elements", "b_elements").mapInArrow(compare, "a long, b long"), name)

    tried = ws.stage(held.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs-lead")
    links = check(tried, "links-lead")
    labels = components(links, ws, "lead")

    # Buckets that still hold two classes: all pairs across classes, of a few nodes as rows, of more nodes in pairs of blocks.
    classed = ws.stage(held.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "classed")
    by_class = classed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"))
    facts = by_class.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n"), F.bit_xor("same").alias("same"))
    # Buckets of the same nodes are one; of two nodes, the pair is tried.
    mixed = ws.stage(facts.where("lo < hi AND n > 2").groupBy("same", "n").agg(F.min(F.struct("bucket", "main")).alias("one")).select("one.*", "n"), "mixed")
    few = ws.stage(classed.join(mixed.where(F.col("n") <= FEW).select("bucket"), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("held")), "few")
    pair = lambda i, j: F.when((F.size("held") > j) & (F.get("held", F.lit(i))["label"] != F.get("held", F.lit(j))["label"]), F.struct(F.get("held", F.lit(i))["node"].alias("a"), F.get("held", F.lit(j))["node"].alias("b")))
    cross = few.select(F.inline(F.array_compact(F.array(*(pair(i, j) for i, j in itertools.combinations(range(FEW), 2))))))
    more = check(ws.stage(cross.distinct().join(tried, ["a", "b"], "left_anti"), "pairs-few"), "links-few")

    crowd = classed.join(mixed.where(F.col("n") > FEW).select("bucket", "main"), "bucket").select("bucket", "node", "label", (F.col("label") != F.col("main")).alias("outer"))
    weights = elements.select("node", (F.octet_length("elements") / 8 + NODE).alias("weight"))
    crowd = ws.stage(crowd.join(weights, "node"), "crowd")
    blocks = lambda outer: F.ceil(F.sum(F.when(F.col("outer") == outer, F.col("weight"))) / BLOCK).cast("int")
    cut = crowd.groupBy("bucket").agg(blocks(True).alias("outs"), blocks(False).alias("ins"))
    # Blocks 0 to outs - 1 have the nodes outside the largest class; the next ones have that class and are not compared with each other.
    own = F.when(F.col("outer"), F.pmod(F.xxhash64("node"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), F.col("ins"))).cast("int")
    others = F.sequence(F.lit(0), F.col("outs") + F.when(F.col("outer"), F.col("ins")).otherwise(0) - 1)
    met = crowd.join(cut, "bucket").withColumn("own", own).withColumn("other", F.explode(others))
    met = ws.stage(met.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label"), "met")

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(rows: list[tuple]) -> pa.RecordBatch:
            found = block_links(*(np.array([r[k] for r in rows], np.int64) for k in range(3)), [r[3] for r in rows], threshold)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

        last, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for bucket, x, y, side, node, label, raw in zip(*columns, batch.column(6), strict=True):
                if (bucket, x, y) != last:
                    if rows:
                        yield links_of(rows)
                    last, rows = (bucket, x, y), []
                rows.append((node, label, side, np.frombuffer(raw.as_buffer(), np.uint64).copy()))
        if rows:
            yield links_of(rows)

    key = ["bucket", "x", "y"]
    grouped = met.join(elements, "node").select(*key, "side", "node", "label", "elements").repartition(*key).sortWithinPartitions(*key)
    more = ws.stage(more.unionByName(ws.stage(grouped.mapInArrow(join_blocks, "a long, b long"), "links-blocks")).distinct(), "links-mixed")
    links = ws.stage(links.unionByName(more), "all-links")
    if more.limit(1).count():
        labels = components(links, ws, "all")

    # Classes of nodes, then of rows; facts of a class travel in parts, as one class may hold a third of all rows.
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("row_tag"), F.lit(1024)).cast("int"))
    heads = salted.select("node", "salt").distinct().join(labels.join(degree, "node"), "node")
    rows_out = ws.stage(
        salted.join(heads, ["node", "salt"], "left").select("doc_id", "text_tag", "row_tag", "n_copies", F.coalesce("label", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes"
    )
    facts = group_facts(rows_out, ["class"], ["row_tag"], [("keep", F.min(F.struct("doc_id", "row_tag")), F.min("keep")), ("class_size", F.count(F.lit(1)), F.sum("class_size"))])
    return facts.select("doc_id", F.col("keep.doc_id").alias("class_id"), F.col("class_size").cast("long"), (F.col("keep.row_tag") == F.col("row_tag")).alias("kept"), F.col("n_copies").cast("long"), F.col("n_links").cast("long"), "text_tag")
