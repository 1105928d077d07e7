"""Exact BM25 top-k search with block-max WAND pruning over an inverted index in shards.

Every task packs its documents into shards: sorted term hashes, postings in
document order, lengths.  Document frequencies and the mean length are taken
over all shards, so a shard's scores are global ones, and the best k of each
shard merge to the exact best k of all.

In a shard, documents that use the same frequent words stand together (a few
steps of k-means), short before long, so that blocks of ``BLOCK`` documents
differ in what they can score.  Each posting list is cut at the blocks: an
entry is a block, the greatest contribution in it and where its postings
start.  The ``DENSE`` most frequent terms, in 1 / SPARSE of the documents or
more, are kept by document instead, with their maxima by block.

Queries run against block maxima first.  The two blocks with the best bounds
are scored and set the threshold, or it comes from an eighth of the shards,
which are searched first.  A block whose maxima don't add up to the threshold
is skipped before any of its postings is touched.  In the pivot blocks that
are left the rarer terms, which are the essential ones, are added up; only
where the best of them and the maxima of the frequent terms still reach the
threshold are those scored too.  Scores are rounded to ``DIGITS`` digits, so
that copies tie; ties go to the lower doc_id.

Queries are packed in the tasks that hold them and taken in blocks of about
``QUERY_TOKENS`` distinct words; each block is one pass over the stored
shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import durable
from ._words import blocks, word_hashes

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 256
#: Blocks of a query that are scored to find a first threshold.
LEAD = 2
#: Terms kept by document in a shard: the most frequent ones, in at least 1 / SPARSE of its documents.
DENSE, SPARSE = 512, 64
#: Groups of like documents in a shard, the terms they are told apart by, and the steps that form them.
GROUPS, GROUP_TERMS, GROUP_STEPS = 16, 128, 4
SHARD_DOCS, SHARD_TOKENS = 16_384, 4_000_000
QUERY_TOKENS = 4_000_000
#: Distinct words of the queries that a shard answers at once, and queries at most.
CHUNK_WORDS, CHUNK_QUERIES = 10_000, 32
DIGITS = 9
#: Bounds are added up in single precision, so they may fall short of a sum of DENSE terms by this share, and of a rounded score by 1e-6.
SHARE, SLACK = 1e-4, 1e-6


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _postings(texts: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, times) sorted by term and document, and the documents' lengths."""
    h, start = word_hashes(texts)
    size = np.diff(start)
    doc = np.repeat(np.arange(first, first + len(texts)), size)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at].astype(np.int32), np.diff(at, append=len(h)).astype(np.uint32), size


def _order(start: np.ndarray, doc: np.ndarray, times: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The documents by group, then length."""
    n, df = len(size), np.diff(start)
    often = np.argsort(-df, kind="stable")[:GROUP_TERMS]
    x = np.zeros((n, len(often)), np.float32)
    for i, t in enumerate(often):
        own = slice(start[t], start[t + 1])
        x[doc[own], i] = np.log1p(times[own])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    middle = x[np.linspace(0, n - 1, min(GROUPS, n)).astype(int)]
    for _ in range(GROUP_STEPS):
        group = (x @ middle.T).argmax(axis=1)
        for g in range(len(middle)):
            own = x[group == g]
            if len(own):
                middle[g] = own.mean(axis=0)
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
    return np.lexsort((size, group))


def pack(parts: list[tuple[np.ndarray, ...]], ids: list[int | None]) -> bytes:
    """A shard of the postings of successive runs of documents."""
    term, doc, times, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(term, kind="stable")
    term, doc, times = term[order], doc[order], times[order]
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    at = np.flatnonzero(new)
    start = np.append(at, len(term))
    turn = _order(start, doc, times, size)
    place = np.empty(len(turn), np.int32)
    place[turn] = np.arange(len(turn))
    doc = place[doc]
    order = np.lexsort((doc, np.repeat(np.arange(len(at)), np.diff(start))))
    doc, times = doc[order], times[order]
    null = np.array([i is None for i in ids], bool)[turn]
    small = times.astype(np.uint8) if not len(times) or times.max() < 256 else times
    return pickle.dumps({"ids": np.array([i or 0 for i in ids], np.int64)[turn], "null": null, "size": size[turn].astype(np.int32), "term": term[at], "start": start, "doc": doc.astype(np.uint16) if len(ids) <= 65_536 else doc, "times": small}, 5)


class Queries:
    """A block of queries: their ids, and the words of all of them one after the other, as places among ``wanted``."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        ids, sizes, terms, self.times = (np.concatenate(x) for x in zip(*packs, strict=True))
        self.ids, self.start = ids, np.concatenate([[0], np.cumsum(sizes)])
        self.wanted, at = np.unique(terms, return_inverse=True)
        self.at = at.astype(np.int32)
        self.weight = np.empty(0)

    def weigh(self, df: np.ndarray, count: int) -> None:
        self.weight = self.times * np.log(1 + (count - df + 0.5) / (df + 0.5))[self.at]

    def chunks(self) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(self.ids):
            b = int(np.searchsorted(self.start, self.start[a] + CHUNK_WORDS, "right")) - 1
            yield a, (a := min(max(b, a + 1), a + CHUNK_QUERIES))


class Shard:
    """An opened shard, with contributions but for the inverse document frequency."""

    def __init__(self, data: bytes, mean: float):
        x = pickle.loads(data)
        self.ids, self.null, self.term, self.n = x["ids"], x["null"], x["term"], len(x["ids"])
        start, doc, times, self.norm = x["start"], x["doc"], x["times"], K1 * (1 - B + B * x["size"] / max(mean, 1e-9))
        self.blocks = -(-self.n // BLOCK)
        df = np.diff(start)
        often = np.flatnonzero(df * SPARSE >= self.n)
        often = often[np.argsort(-df[often], kind="stable")[:DENSE]]
        self.row = np.full(len(df), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        self.times = np.zeros((self.n, len(often)), times.dtype)
        for i, t in enumerate(often):
            own = slice(start[t], start[t + 1])
            self.dense[i, doc[own]] = self.part_of(times[own], doc[own])
            self.times[doc[own], i] = times[own]
        self.peak = self.dense.reshape(len(often), self.blocks, BLOCK).max(axis=2)
        # Entries: the postings of one term in one block.
        rare = np.repeat(self.row < 0, df)
        kind, doc = np.repeat(np.arange(len(df), dtype=np.int32), df)[rare], doc[rare]
        self.part = self.part_of(times[rare], doc)
        del x, times, rare
        block = (doc // BLOCK).astype(np.int32)
        self.slot = (doc % BLOCK).astype(np.uint8 if BLOCK <= 256 else np.int32)
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (block[1:] != block[:-1])
        self.first = np.flatnonzero(new)
        self.held = np.diff(self.first, append=len(kind))
        self.block = block[self.first]
        self.high = np.maximum.reduceat(self.part, self.first) if len(self.first) else np.empty(0)
        self.entry = np.searchsorted(kind[self.first], np.arange(len(df) + 1))
        self.seen = self.skipped = 0

    def part_of(self, times: np.ndarray, doc: np.ndarray) -> np.ndarray:
        part = times.astype(float)
        part *= (K1 + 1) / (part + self.norm[doc])
        return part

    def find(self, term: np.ndarray) -> np.ndarray:
        """Places of terms, -1 for those not in the shard."""
        if not len(self.term):
            return np.full(len(term), -1)
        at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        return np.where(self.term[at] == term, at, -1)

    def search(self, q: Queries, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) of each query's best k by score, then id, of those that score its ``least`` or more."""
        at = self.find(q.wanted)
        for a, b in q.chunks():
            own = slice(q.start[a], q.start[b])
            query = np.repeat(np.arange(b - a), np.diff(q.start[a : b + 1]))
            here = at[q.at[own]]
            found = here >= 0
            if found.any():
                n, doc, score = self._chunk(b - a, query[found], here[found], q.weight[own][found], k, least[a:b])
                yield n + a, doc, score

    def _chunk(self, n: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = self.row[term]
        common, rare = row >= 0, row < 0
        exact = np.zeros((n, len(self.dense)))
        exact[query[common], row[common]] = weight[common]
        dense = exact.astype(np.float32)
        size = self.entry[term[rare] + 1] - self.entry[term[rare]]
        entry = _expand(self.entry[term[rare]], size)
        cell, gain = np.repeat(query[rare], size) * self.blocks + self.block[entry], np.repeat(weight[rare], size)
        above = dense @ self.peak
        bound = np.bincount(cell, gain * self.high[entry], n * self.blocks).reshape(n, self.blocks) + above

        def scored(chosen: np.ndarray, floor: np.ndarray | None) -> tuple[np.ndarray, ...]:
            """(query, block, scores of its documents by the rarer terms and by all) of the chosen pairs that can reach the floor."""
            # Pairs in the order of their blocks: each block of the frequent terms is one product.
            block, owner = np.nonzero(chosen.T)
            number = np.full(n * self.blocks, -1)
            number[owner * self.blocks + block] = np.arange(len(block))
            pair = number[cell]
            open_ = pair >= 0
            e = entry[open_]
            held = self.held[e]
            where = _expand(self.first[e], held)
            slot = self.slot.take(where) + np.repeat(pair[open_] * BLOCK, held)
            score = np.bincount(slot, self.part.take(where) * np.repeat(gain[open_], held), len(block) * BLOCK).reshape(-1, BLOCK).astype(float, copy=False)
            if floor is not None:
                keep = score.max(axis=1, initial=0.0) + above[owner, block] >= floor[owner]
                block, owner, score = block[keep], owner[keep], score[keep]
            cut = np.searchsorted(block, np.arange(self.blocks + 1))
            whole = score.copy()
            for j in np.flatnonzero(np.diff(cut)):
                part = slice(cut[j], cut[j + 1])
                whole[part] += dense[owner[part]] @ self.dense[:, j * BLOCK : (j + 1) * BLOCK]
            return owner, block, score, whole

        lead = np.zeros(bound.shape, bool)
        few = min(LEAD, self.blocks)
        np.put_along_axis(lead, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
        low = lambda x: x * (1 - SHARE) - SLACK
        lead &= (bound > 0) & (bound >= low(least)[:, None])
        parts = [scored(lead, None)]
        owner, block, _, score = parts[0]
        order = np.argsort(owner, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        best = np.zeros((n, few * BLOCK))
        best.reshape(n, few, BLOCK)[owner[order], nth] = score[order]
        reach = low(np.maximum(least, np.partition(best, few * BLOCK - k, axis=1)[:, few * BLOCK - k] if few * BLOCK >= k else 0.0))
        pivots = ~lead & (bound > 0) & (bound >= reach[:, None])
        self.seen += bound.size
        self.skipped += bound.size - int(pivots.sum()) - int(lead.sum())
        parts.append(scored(pivots, reach))
        owner, block, score, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A document that no term of the query is in has no score.
        i, slot = np.nonzero((whole >= low(reach)[owner, None]) & (whole > 0))
        query, doc, about = owner[i], block[i] * BLOCK + slot, whole[i, slot]
        order = np.lexsort((-about, query))
        head = np.searchsorted(query[order], np.arange(n))
        last = np.minimum(head + k - 1, len(order) - 1)
        full = np.bincount(query, minlength=n) >= k
        floor = np.where(full, low(low(about[order[last]])), 0.0) if len(order) else np.zeros(n)
        near = about >= floor[query]
        i, slot, query, doc = i[near], slot[near], query[near], doc[near]
        part = self.part_of(self.times[doc], doc[:, None])
        score = np.round(score[i, slot] + np.einsum("ij,ij->i", part, exact[query]), DIGITS)
        order = np.lexsort((self.ids[doc], self.null[doc], -score, query))
        query, doc, score = query[order], doc[order], score[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[top], doc[top], score[top]


def index(docs: DataFrame, inputs: int = 2) -> DataFrame:
    """(n, tokens, shard) of the shards of all rows of ``docs``; each task packs about ``inputs`` input partitions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([pack(parts, ids)], pa.binary())], ["n", "tokens", "shard"])

        parts, ids, tokens = [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, texts in blocks(batch.column(1).to_pylist()):
                parts.append(_postings(texts, len(ids)))
                ids += own[first : first + len(texts)]
                tokens += int(parts[-1][3].sum())
                if len(ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield out()
                    parts, ids, tokens = [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.coalesce(max(1, -(-rows.rdd.getNumPartitions() // inputs)))
    return rows.mapInArrow(build, "n bigint, tokens bigint, shard binary")


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, pack) of the queries of a task, a block of texts at a time: ids, distinct words of each, the words, their times."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, texts in blocks(batch.column(1).to_pylist()):
            term, doc, times, _ = _postings(texts, 0)
            order = np.argsort(doc, kind="stable")
            x = ids[first : first + len(texts)], np.bincount(doc, minlength=len(texts)), term[order], times[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([len(term)], pa.int64()), pa.array([pickle.dumps(x, 5)], pa.binary())], ["words", "pack"])


def _query_blocks(packs: DataFrame, size: int) -> Iterator[Queries]:
    held, words = [], 0
    for r in packs.toLocalIterator():
        held.append(pickle.loads(r.pack))
        words += r.words
        if words >= size:
            yield Queries(held)
            held, words = [], 0
    if held:
        yield Queries(held)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(docs: DataFrame, query: Column | None = None, k: int = TOP, query_tokens: int = QUERY_TOKENS) -> DataFrame:
    """The best k rows of ``docs`` for each query: query_id, doc_id, rank (from 1), score.

    query: which rows are queries, by default those whose id is divisible by
    50.  A query is the bag of its text's words, each as often as it occurs.
    All rows are searched, the query's own too.  Rows that share no word with
    a query are no result, so null, empty and blank texts neither find nor
    are found, and an empty table gives no rows.  Repeated rows are each a
    result of their own.  Of several query rows with one id, the least text
    is taken; rows with a null id are searched, and come last in ties.  Very
    long texts are searched whole: a block of texts holds at least one.
    Columns other than doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    leads = F.pmod(F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.lit(8)) == 0
    shards = durable(index(docs).withColumn("leads", leads))
    leading, others = shards.where("leads"), shards.where("not leads")
    count, tokens = shards.agg(F.sum("n"), F.sum("tokens")).first()
    schema = "query_id bigint, doc_id bigint, score double"
    if not count:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, rank int, score double")
    mean = tokens / count
    chosen = docs.where(F.pmod("doc_id", F.lit(50)) == 0 if query is None else query).where("doc_id is not null and text is not null")
    chosen = chosen.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("text").alias("text"))
    packs = durable(chosen.mapInArrow(_pack_queries, "words bigint, pack binary"))
    out = None
    for queries in _query_blocks(packs, query_tokens):
        wanted = sc.broadcast(queries.wanted)

        def frequencies(batches: Iterator[pa.RecordBatch], wanted: object = wanted) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(wanted.value), np.int64)
            for batch in batches:
                for data in batch.column(0):
                    x = pickle.loads(data.as_buffer())
                    at = np.minimum(np.searchsorted(x["term"], wanted.value), max(len(x["term"]) - 1, 0))
                    if len(x["term"]):
                        total += np.where(x["term"][at] == wanted.value, np.diff(x["start"])[at], 0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "df"])

        df = np.zeros(len(queries.wanted), np.int64)
        found = shards.select("shard").mapInArrow(frequencies, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        df[found.column(0).to_numpy()] = found.column(1).to_numpy()
        queries.weigh(df, count)
        block = sc.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch], block: object = block, least: object = None) -> Iterator[pa.RecordBatch]:
            q = block.value
            floor = least.value if least else np.zeros(len(q.ids))
            for batch in batches:
                for data in batch.column(0):
                    shard = Shard(data.as_buffer(), mean)
                    for n, doc, score in shard.search(q, k, floor):
                        yield pa.RecordBatch.from_arrays([pa.array(q.ids[n], pa.int64()), pa.array(shard.ids[doc], pa.int64(), mask=shard.null[doc]), pa.array(score, pa.float64())], ["query_id", "doc_id", "score"])

        # One shard in eight sets each query's threshold; the others only score what reaches it.
        first = durable(_ranked(leading.select("shard").mapInArrow(search, schema), k))
        reached = first.where(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(queries.ids)
        floor = np.zeros(len(order))
        floor[order[np.searchsorted(queries.ids, reached.column(0).to_numpy(), sorter=order)]] = reached.column(1).to_numpy()
        rest = others.select("shard").mapInArrow(partial(search, least=sc.broadcast(floor)), schema)
        best = first.select("query_id", "doc_id", "score").unionByName(rest)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], schema)
    return _ranked(out, k).select("query_id", "doc_id", "rank", "score")
