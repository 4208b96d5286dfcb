"""Document graphs by shared phrases, expanded from seeds only, and governed paths of one or two edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrases
from .staging import staged

EDGE_TYPES = ("CITES", "DEPENDS_ON", "REFERENCES", "SUPPORTS")


def document_phrases(docs: DataFrame) -> DataFrame:
    """(document_id, phrase), distinct."""
    return docs.select("document_id", F.explode(phrases(F.col("text"))).alias("phrase")).distinct()


#: Documents of a block: one bit each in what ``_Block`` holds.
BLOCK = 16_384
#: ``search``: documents with the most phrases, which are counted first; holders of each asked phrase that tell the hopeless ones (fewer where phrases are many,
#: so that all of them are about SEEDS at most); of a query, hopeful documents counted before the rest.
STRONG, SAMPLE, SEEDS, FIRST = 512, 512, 1 << 18, 64
#: Documents of a part whose votes are summed in one task, and words (64 seeds each) of the sample that every document is first held against.
PART, GLANCE = 4096, 64
#: Holders from which a phrase gets a row of bits in a block of BLOCK documents, more in larger ones; rarer phrases are set one by one.
DENSE = 16

_PACKED = "block int, docs binary, ends binary, phrases binary, queries binary, query_ends binary"


def _pack(rows: pa.Table) -> pa.Table:
    """One row for a block's documents: their ids, where the phrases (64-bit hashes) of each end, all phrases; so too the queries asked about each."""
    raw = lambda values, kind=np.int64: pa.array([np.asarray(values, kind).tobytes()], pa.binary())
    flat = lambda c: (np.cumsum(pc.list_value_length(c).to_numpy()), pc.list_flatten(c).to_numpy())
    (ends, phrases), (query_ends, queries) = flat(rows.column("phrases")), flat(rows.column("queries"))
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "docs": raw(rows.column("document_id").to_numpy()), "ends": raw(ends), "phrases": raw(phrases), "queries": raw(queries), "query_ends": raw(query_ends)})


def _packed(holders: DataFrame, each: int) -> DataFrame:
    """``holders`` (document_id, phrases, queries) in rows of about ``each`` documents."""
    ways = F.greatest(F.lit(1), F.ceil(holders.select(F.count(F.lit(1))).scalar() / each).cast("int"))
    return holders.withColumn("block", F.pmod(F.xxhash64("document_id"), ways).cast("int")).groupBy("block").applyInArrow(_pack, _PACKED)


def _holders(doc_phrase: DataFrame) -> DataFrame:
    """(document_id, phrases as 64-bit hashes, queries: none)."""
    held = doc_phrase.groupBy("document_id").agg(F.collect_set(F.xxhash64("phrase")).alias("phrases"))
    return staged(held.withColumn("queries", F.array().cast("array<long>")), "document-phrases")


class _Block:
    """Which documents of a block hold each phrase: rows of bits for frequent phrases, places for rare ones."""

    def __init__(self, docs: bytes, ends: bytes, phrases: bytes):
        self.docs, ends, phrases = (np.frombuffer(x, np.int64) for x in (docs, ends, phrases))
        self.words = -(-max(1, len(self.docs)) // 64)
        place = np.repeat(np.arange(len(self.docs)), np.diff(ends, prepend=0))
        order = np.argsort(phrases, kind="stable")
        self.places = place[order]
        self.known, self.at, self.n = np.unique(phrases[order], return_index=True, return_counts=True)
        dense = np.flatnonzero(self.n >= max(DENSE, self.words // 16))
        self.row = np.full(len(self.known), -1)
        self.row[dense] = np.arange(len(dense))
        self.bits = np.zeros((len(dense) + 1, self.words), np.uint64)  # the last row is empty
        row = np.repeat(self.row, self.n)
        self._set(self.bits, row[row >= 0], self.places[row >= 0])

    @staticmethod
    def _set(bits: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

    def holders(self, phrases: np.ndarray):
        """The places of the documents with each phrase."""
        for x, y in zip(np.searchsorted(self.known, phrases), np.searchsorted(self.known, phrases, "right"), strict=True):
            yield self.places[self.at[x] : self.at[x] + self.n[x]] if x < y else self.places[:0]

    def linked(self, ends: np.ndarray, phrases: np.ndarray):
        """For documents whose phrases end at ``ends``: (number of the first, bits of those that share a phrase) for some at a time."""
        found = np.searchsorted(self.known, phrases)
        found[found == len(self.known)] = 0
        hit = self.known[found] == phrases if len(self.known) else np.zeros(len(phrases), bool)
        row = np.where(hit, self.row[found], -1) if len(self.known) else np.full(len(phrases), -1)
        rare = hit & (row < 0)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        # the bits of a few phrases are gathered at a time, those of many documents handed on
        rows_at_a_time, most = max(1, (1 << 20) // (8 * self.words)), max(1, (2 << 20) // (8 * self.words))
        for first in range(0, len(ends), most):
            last = min(first + most, len(ends))
            out = np.zeros((last - first, self.words), np.uint64)
            i = first
            while i < last:
                j = min(max(i + 1, int(np.searchsorted(ends, starts[i] + rows_at_a_time, "right"))), last)
                some = np.flatnonzero(ends[i:j] > starts[i:j])
                if len(some):
                    out[i - first + some] = np.bitwise_or.reduceat(self.bits[row[starts[i] : ends[j - 1]]], starts[i:j][some] - starts[i], axis=0)
                i = j
            few = np.flatnonzero(rare[starts[first] : ends[last - 1]]) + starts[first]
            if len(few):
                k = found[few]
                n = self.n[k]
                owner = np.searchsorted(ends[first:last], few, "right")
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self._set(out, np.repeat(owner, n), self.places[np.repeat(self.at[k], n) + within])
            yield first, out


def _meet(one: DataFrame, other: DataFrame, on: Column | None = None) -> DataFrame:
    """Every packed row of ``one`` beside every one of ``other`` (its columns end in _2). Both are read from their files where they meet: nothing is copied or shuffled for it."""
    other = other.select(*(F.col(c).alias(f"{c}_2") for c in other.columns))
    return one.crossJoin(other) if on is None else one.join(other, on)


def _columns(batch: pa.RecordBatch, names: str):
    return zip(*(batch.column(n).to_pylist() for n in names.split()), strict=True)


def edges_of(doc_phrase: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, neighbour): all documents that share a phrase with one of ``asked`` (a stated set, with its phrases), each pair once.

    Pairs are found as unions of bit sets, part of those asked by block of documents, and leave the task that finds them only as results. They come neighbour
    by neighbour, all of a part together: columnar files then hold runs of one column and few different values of the other.
    """
    blocks, parts = staged(_packed(_holders(doc_phrase), BLOCK), "blocks"), staged(_packed(_holders(asked), 1024), "parts")

    def pairs(batches):
        for batch in batches:
            for docs, ends, phrases, *block in _columns(batch, "docs ends phrases docs_2 ends_2 phrases_2"):
                held, own = _Block(*block), np.frombuffer(docs, np.int64)
                for i, bits in held.linked(np.frombuffer(ends, np.int64), np.frombuffer(phrases, np.int64)):
                    each = max(1, (4 << 20) // (64 * len(bits)))
                    for at in range(0, held.words, each):
                        cells = np.unpackbits(np.ascontiguousarray(bits[:, at : at + each]).view(np.uint8), axis=1, bitorder="little")
                        y, x = np.nonzero(np.ascontiguousarray(cells.T))
                        mine, theirs = own[i + x], held.docs[64 * at + y]
                        yield pa.RecordBatch.from_arrays([pa.array(v[mine != theirs]) for v in (mine, theirs)], names=["document_id", "neighbour"])

    return _meet(parts, blocks).mapInArrow(pairs, "document_id long, neighbour long")


def _share(documents: np.ndarray) -> np.ndarray:
    """A fixed number from 0 to 1 for each document, as good as random."""
    x = documents.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) / 2.0**64


def search(doc_phrase: DataFrame, asked: DataFrame, seed_weight: int = 2, neighbour_weight: int = 1, limit: int = 12) -> DataFrame:
    """Documents that share a phrase with a query (query_id, phrase; a batch that the driver can hold), and their neighbours: 2 a seed, 1 per linking seed.

    The graph is never built, and no phrase is left out. Votes are counted as unions of bit sets, block of seeds by part of documents. What a document lacks
    of some seeds of a query bounds its votes from above. The documents with the most phrases are counted first, which bounds the last place from below.
    Then all documents meet a sample of the seeds by each asked phrase (all, if it is rare); one that would not reach the last place if it had all other seeds is out. Of those that may,
    the ones that come first by bound and id are counted exactly, which gives a last place close to the true one, and then those that may still reach that.
    Equal votes are told apart by the id throughout. Phrases are compared by 64-bit hashes.
    """
    if seed_weight < 0 or neighbour_weight < 0:
        raise ValueError("weights must not be negative")
    holders = _holders(doc_phrase)
    spark = holders.sparkSession
    wanted: dict[int, list[int]] = {}
    for q, p in asked.select("query_id", F.xxhash64("phrase")).distinct().collect():
        wanted.setdefault(q, []).append(p)
    ids = np.array(sorted(wanted), np.int64)
    of_query = np.concatenate([np.array(wanted[q], np.int64) for q in ids.tolist()] or [np.zeros(0, np.int64)])
    query_ends = np.cumsum([len(wanted[q]) for q in ids.tolist()]).astype(np.int64)

    def seeds_in(block: _Block) -> np.ndarray:
        """Bits of each query's seeds in a block."""
        return np.concatenate([b for _, b in block.linked(query_ends, of_query)] or [np.zeros((0, block.words), np.uint64)])

    def seed_places(block: _Block):
        """Which documents of a block are seeds, query by query."""
        for bits in seeds_in(block):
            yield np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(block.docs)].astype(bool)

    blocks = staged(_packed(holders, BLOCK), "blocks")
    strong = holders.orderBy(F.desc(F.size("phrases")), "document_id").limit(STRONG)

    def votes(batches):
        """Rows (query, document, linking seeds here, whether it is a seed), for the queries named beside a document, or all; sums of blocks that follow each other."""
        key, sums, is_seed, own, chosen = None, None, None, None, None

        def rows():
            x, y = np.nonzero(chosen & (sums > 0))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[y], own[x], sums[x, y].astype(np.int64), is_seed[x, y].astype(np.int64))], names=["query_id", "document_id", "linked", "is_seed"])

        for batch in batches:
            for part, docs, ends, phrases, queries, q_ends, *block in _columns(batch, "block docs ends phrases queries query_ends docs_2 ends_2 phrases_2"):
                if part != key:
                    if key is not None:
                        yield rows()
                    key, own, ends_, phrases_ = part, np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(phrases, np.int64)
                    q_ends, queries = np.frombuffer(q_ends, np.int64), np.frombuffer(queries, np.int64)
                    chosen = np.full((len(own), len(ids)), not len(queries))
                    chosen[np.repeat(np.arange(len(own)), np.diff(q_ends, prepend=0)), np.searchsorted(ids, queries)] = True
                    sums = np.zeros(chosen.shape, np.int32)
                    is_seed = np.stack([*seed_places(_Block(docs, ends, phrases))] or [np.zeros(len(own), bool)], axis=1)[:, : len(ids)]
                held = _Block(*block)
                seeds = seeds_in(held)
                for i, bits in held.linked(ends_, phrases_):
                    for q in np.flatnonzero(chosen[i : i + len(bits)].any(axis=0)):
                        at = np.flatnonzero(chosen[i : i + len(bits), q])
                        sums[i + at, q] += np.bitwise_count(bits[at] & seeds[q]).sum(axis=1, dtype=np.int32)
        if key is not None:
            yield rows()

    counted = "query_id long, document_id long, linked long, is_seed long"
    score = seed_weight * F.col("is_seed") + neighbour_weight * (F.col("linked") - F.col("is_seed"))

    def exact(some: DataFrame) -> DataFrame:
        met = _meet(staged(_packed(some, PART), "parts"), blocks).mapInArrow(votes, counted)
        return met.groupBy("query_id", "document_id").agg(F.sum("linked").alias("linked"), F.max("is_seed").alias("is_seed")).select("query_id", "document_id", score.alias("score"))

    def last_places(exactly: DataFrame) -> dict[int, tuple[int, int]]:
        """By query: score and id of the last of the ``limit`` best."""
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
        return {r.query_id: (r.score, r.document_id) for r in exactly.withColumn("n", F.row_number().over(best)).where(F.col("n") == limit).select("query_id", "document_id", "score").collect()}

    asked_phrases = np.unique(of_query)

    def totals(batches):
        """How many seeds each query has, and how many documents each asked phrase, numbered after the queries."""
        for batch in batches:
            for block in _columns(batch, "docs ends phrases"):
                held = _Block(*block)
                n = np.concatenate([np.bitwise_count(seeds_in(held)).sum(axis=1, dtype=np.int64), [len(x) for x in held.holders(asked_phrases)]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["at", "n"])

    everyone = np.zeros(len(ids) + len(asked_phrases), np.int64)
    for at, n in blocks.mapInArrow(totals, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        everyone[at] = n
    everyone, of_phrase = everyone[: len(ids)], everyone[len(ids) :]
    floors = last_places(exact(strong))
    # a query without a last place so far: whoever has a vote may reach one
    floor, floor_id = (np.array([floors.get(q, (-1, 0))[i] for q in ids.tolist()], np.int64) for i in (0, 1))
    most = min(SAMPLE, max(16, SEEDS // max(1, len(asked_phrases))))

    def sampled(batches):
        """The seeds whose share is below what leaves ``most`` by a phrase; frequent phrases have theirs in common."""
        for batch in batches:
            for docs, ends, phrases in _columns(batch, "docs ends phrases"):
                block = _Block(docs, ends, phrases)
                share, taken = _share(block.docs), np.zeros(len(block.docs), bool)
                for n, places in zip(of_phrase, block.holders(asked_phrases), strict=True):
                    taken[places[share[places] * n < most]] = True
                ends, phrases = np.frombuffer(ends, np.int64), np.frombuffer(phrases, np.int64)
                starts, at = np.concatenate(([0], ends[:-1])), np.flatnonzero(taken)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.docs[at]), pa.array([phrases[starts[x] : ends[x]] for x in at], pa.list_(pa.int64())), pa.array([[]] * len(at), pa.list_(pa.int64()))], names=["document_id", "phrases", "queries"]
                )

    held_as = "document_id long, phrases array<long>, queries array<long>"
    sample = staged(_packed(blocks.mapInArrow(sampled, held_as), 1 << 62), "sample")  # one row

    def hopeful(batches):
        """Documents with the queries whose last place they may reach, and the most that they may have there."""
        known = [None, None, None]
        for batch in batches:
            for docs, ends, phrases, *block in _columns(batch, "docs ends phrases docs_2 ends_2 phrases_2"):
                if known[0] is None:  # one sample for all
                    held = _Block(*block)
                    seeds = seeds_in(held)
                    n_here = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (seeds[:, :GLANCE], seeds[:, GLANCE:])]
                    known = [held, seeds, n_here]
                held, seeds, n_here = known
                own, ends, phrases = (np.frombuffer(x, np.int64) for x in (docs, ends, phrases))
                is_seed = np.stack([*seed_places(_Block(docs, ends.tobytes(), phrases.tobytes()))] or [np.zeros(len(own), bool)], axis=1).astype(np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                for i, bits in held.linked(ends, phrases):
                    some, at_a_glance = own[i : i + len(bits)], np.ascontiguousarray(bits[:, :GLANCE])
                    found = []
                    for q in range(len(ids)):
                        at, missed = np.arange(len(bits)), 0
                        for n, words in zip(n_here, (slice(0, GLANCE), slice(GLANCE, None)), strict=True):  # most are out at a glance
                            here = bits[at, words] if words.start else at_a_glance
                            missed = missed + n[q] - np.bitwise_count(here & seeds[q, words]).sum(axis=1, dtype=np.int64)
                            mine, linked = is_seed[i + at, q], everyone[q] - missed
                            bound = seed_weight * mine + neighbour_weight * (linked - mine)
                            may = (linked > 0) & ((bound > floor[q]) | ((bound == floor[q]) & (some[at] <= floor_id[q])))
                            at, missed, bound = at[may], missed[may], bound[may]
                            if not len(at):
                                break
                        else:
                            found.append((at, np.full(len(at), ids[q]), bound))
                    if found:
                        at, queries, bounds = (np.concatenate(v) for v in zip(*found, strict=True))
                        order = np.argsort(at, kind="stable")
                        here, n = np.unique(at, return_counts=True)
                        cuts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                        lists = [pa.ListArray.from_arrays(cuts, pa.array(v[order])) for v in (queries, bounds)]
                        yield pa.RecordBatch.from_arrays([pa.array(some[here]), pa.array([phrases[starts[i + x] : ends[i + x]] for x in here], pa.list_(pa.int64())), *lists], names=["document_id", "phrases", "queries", "bounds"])

    few = staged(_meet(blocks, sample).mapInArrow(hopeful, f"{held_as}, bounds array<long>"), "hopeful")
    pairs = few.select("document_id", F.inline(F.arrays_zip(F.col("queries").alias("query_id"), F.col("bounds").alias("bound"))))

    def chosen(some: DataFrame) -> DataFrame:
        """The holders of pairs (document_id, query_id), with the queries of each."""
        return few.select("document_id", "phrases").join(some.groupBy("document_id").agg(F.collect_list("query_id").alias("queries")), "document_id").select("document_id", "phrases", "queries")

    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "document_id")
    first = staged(pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST).select("query_id", "document_id"), "first")
    counted_first = staged(exact(chosen(first)), "counted")
    floors |= last_places(counted_first)
    places = spark.createDataFrame(pa.table([ids, *(pa.array([floors.get(q, (-1, 0))[i] for q in ids.tolist()], pa.int64()) for i in (0, 1))], names=["query_id", "floor", "floor_id"]))
    may = (F.col("bound") > F.col("floor")) | ((F.col("bound") == F.col("floor")) & (F.col("document_id") <= F.col("floor_id")))
    rest = pairs.join(F.broadcast(places), "query_id").where(may).select("query_id", "document_id").join(first, ["query_id", "document_id"], "left_anti")
    total = counted_first.unionByName(exact(chosen(rest))).withColumnRenamed("score", "contribution")
    order = Window.partitionBy("query_id").orderBy(F.desc("contribution"), "document_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def size(documents: DataFrame, doc_phrase: DataFrame) -> DataFrame:
    """(nodes, edges) of the whole graph: an audit of it. Edges are counted by unions of bit sets, block of documents by block, never listed."""
    blocks = staged(_packed(_holders(doc_phrase), BLOCK), "blocks")

    def edges(batches):
        of, held = None, None
        for batch in batches:
            for number, other, ends, phrases, *block in _columns(batch, "block block_2 ends_2 phrases_2 docs ends phrases"):
                if number != of:
                    of, held = number, _Block(*block)
                ends = np.frombuffer(ends, np.int64)
                n = sum(int(np.bitwise_count(bits).sum(dtype=np.int64)) for _, bits in held.linked(ends, np.frombuffer(phrases, np.int64)))
                # in a block, each edge is met from both ends, and each document meets itself
                yield pa.RecordBatch.from_arrays([pa.array([(n - len(ends)) // 2 if number == other else n])], names=["n"])

    counted = _meet(blocks, blocks, F.col("block") <= F.col("block_2")).mapInArrow(edges, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return documents.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(counted).select("nodes", "edges")


def paths(nodes: DataFrame, relations: DataFrame, seeds: DataFrame, node_ok: Column, edge_ok: Column, hops: int = 2, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """Undirected paths of 1 to ``hops`` (at most 2) relations from seed entities (query_id, entity_id).

    Every node and every relation on a path satisfies its predicate: both are filtered before they are joined. A path
    does not use a relation twice, and does not end where it began. (query_id, seed, target, hops, relations).
    """
    ok = nodes.where(node_ok).select("entity_id")
    kept = relations.where(edge_ok & F.col("relationship_type").isin(list(types))).select("relationship_id", "source_id", "target_id")
    both = kept.select("relationship_id", F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(kept.select("relationship_id", F.col("target_id").alias("u"), F.col("source_id").alias("v")))
    both = both.join(ok.withColumnRenamed("entity_id", "u"), "u", "left_semi").join(ok.withColumnRenamed("entity_id", "v"), "v", "left_semi")
    start = seeds.join(ok, "entity_id", "left_semi").select("query_id", F.col("entity_id").alias("seed"))
    one = start.join(both, F.col("seed") == F.col("u")).select("query_id", "seed", F.col("v").alias("target"), F.array("relationship_id").alias("relations")).where("seed != target")
    if hops == 1:
        return one.withColumn("hops", F.lit(1))
    two = (
        one.join(both, F.col("target") == F.col("u"))
        .where(~F.array_contains("relations", F.col("relationship_id")) & (F.col("v") != F.col("seed")))
        .select("query_id", "seed", F.col("v").alias("target"), F.concat("relations", F.array("relationship_id")).alias("relations"))
    )
    return one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


def gate(evidence: DataFrame, metric: str = "recall_at_5", threshold: float = 0.03) -> DataFrame:
    """Whether graph retrieval may be used: the first reason that applies, for rows of evaluation evidence."""
    reason = (
        F.when(~F.col("enabled"), "config_disabled")
        .when(F.col("evaluation_id").isNull(), "evaluation_missing")
        .when(F.col("evaluation_id") != F.col("expected_id"), "evaluation_identity_mismatch")
        .when(F.col("content_hash") != F.col("expected_hash"), "evaluation_hash_mismatch")
        .when(F.col("metric") != metric, "metric_mismatch")
        .when(F.col("safety_violations") > 0, "safety_regression")
        .when(F.col("improvement") + 1e-12 < threshold, "improvement_below_threshold")
        .otherwise("gate_passed")
    )
    return evidence.withColumn("reason", reason).withColumn("opened", F.col("reason") == "gate_passed")


def governed_paths(entities: DataFrame, relations: DataFrame, seeds: DataFrame, ok: Column, limit: int, hops: int = 2) -> DataFrame:
    """(query_id, seed, target, hops, score, relations, rank): the best paths per query, by score and then target, each target once.

    ``ok`` (tenant, access, version, validity: columns that entities and relations share) holds for every node and every relation of a path. A path's score
    is the product of its relations' weights, halved for a second hop.
    """
    found = paths(entities, relations, seeds, ok, ok, hops)
    weight = relations.select(F.col("relationship_id").alias("rel"), "weight")
    numbered = found.withColumn("path", F.xxhash64("query_id", "seed", F.col("relations").cast("string")))
    scored = numbered.select("query_id", "seed", "target", "hops", "relations", "path", F.explode("relations").alias("rel")).join(weight, "rel")
    product = scored.groupBy("query_id", "seed", "target", "hops", "relations", "path").agg(F.product("weight").alias("w"))
    score = F.round(F.col("w") * F.when(F.col("hops") == 2, 0.5).otherwise(1.0), 6)
    one = product.withColumn("score", score).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "target").orderBy(F.desc("score"), "hops", "relations"))).where("n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "target")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "seed", "target", "hops", "score", "relations", "rank")


def fuse(hybrid: DataFrame, graph: DataFrame, gates: DataFrame, sizes: DataFrame, most_items: int, most_chars: int, graph_weight: float = 0.8, k: int = 60) -> DataFrame:
    """(query_id, item, score, provenance, position): ranked lists (query_id, item, rank) fused by weighted reciprocal ranks, then packed in turn.

    A query whose gate (query_id, opened) is closed uses the hybrid list alone. An item that does not fit what is left of the characters (item, size) is skipped.
    """
    from .chunking import budget_skip

    open_ = gates.where("opened").select("query_id")
    lists = hybrid.select("query_id", "item", "rank", F.lit("hybrid").alias("list")).unionByName(graph.join(open_, "query_id", "left_semi").select("query_id", "item", "rank", F.lit("graph").alias("list")))
    weight = F.when(F.col("list") == "graph", graph_weight).otherwise(1.0)
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list", "rank"))), lambda s: F.concat_ws(":", s["list"], s["rank"].cast("string"))), " ")
    fused = lists.groupBy("query_id", "item").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), trail.alias("provenance")).join(sizes, "item")
    entry = F.struct((-F.col("score")).alias("less"), "item", "size", "provenance")
    packed = fused.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))  # two lists of bounded length
    return packed.select("query_id", F.posexplode(budget_skip(F.col("items"), "size", most_items, most_chars)).alias("at", "x")).select("query_id", F.col("x.item").alias("item"), (-F.col("x.less")).alias("score"), F.col("x.provenance").alias("provenance"), (F.col("at") + 1).alias("position"))
