"""Bigram language model with Katz backoff, fitted on part of a corpus and scoring all of it.

Every token is scored as log10 of d(c12) c12 / c1 if its bigram was seen in
training, else of a(w1) P(w2), where P(w2) is d(c) c / N for a known word and
the rest of the mass for the unknown word.  d is the Good-Turing discount for
counts up to ``K``; larger counts lose ``REST`` of one occurrence, so that
every context keeps mass to back off with.  The backoff weight a(w1) is the
mass its seen bigrams leave over that which their words leave in P, so each
context's distribution sums to one exactly.

Storage and evaluation are by table partition.  The tokens of a task's texts
are cut into packed arrays by the hash of the predicted word, which is where
that word's count and all its bigrams are counted: one shuffle, whose files
serve three passes (counts of counts; what each word gives to contexts; sums
per document).  A score falls apart into terms of the predicted word, the
count of each context (added where that word is predicted itself) and the
backoff weight of contexts of unseen bigrams, which alone travel to the
partition of the context.  Words that would weigh in one partition (see
``HOT_PARTS``) are spread over all partitions by their bigram; their totals
are few and are sent to every task.  Rows are told apart by their place in the input, so
repeated ids are scored each on its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import blocks, mix, word_hashes

K = 5
REST = 0.01
#: A word with this share of a partition's tokens, by the sample, is spread over all partitions; so at most HOT_PARTS words a partition are.
HOT_PARTS = 4
SAMPLE = 32
#: Tokens that a task packs at once.
PACK = 2_500_000
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K, from n[r] types that occur r times (r up to K + 1)."""
    d = np.ones(K + 1)
    r = np.arange(1, K + 1)
    if (n[1 : K + 2] > 0).all():
        star = (r + 1) * n[2 : K + 2] / n[1 : K + 1]
        common = (K + 1) * n[K + 1] / n[1]
        if common < 1:
            d[1:] = (star / r - common) / (1 - common)
    good = (d > 0) & (d < 1)
    # Where counts of counts are too few for Good-Turing, half an occurrence is taken off.
    d[1:] = np.where(good[1:], d[1:], 1 - 0.5 / r)
    return d


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c <= K, d[np.minimum(c, K)] * c, c - REST)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, context, word) of all tokens, the end of each text among them."""
    h, start = word_hashes(texts)
    n = np.diff(start)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    ends = np.cumsum(n + 1) - 1
    word = np.empty(len(doc), np.uint64)
    at = np.ones(len(doc), bool)
    at[ends] = False
    word[at], word[ends] = h, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[0] = START
    context[1:][doc[1:] != doc[:-1]] = START
    return doc, context, word


def _part(word: np.ndarray, context: np.ndarray | None, hot: np.ndarray, parts: int) -> np.ndarray:
    key = word
    if context is not None and len(hot):
        key = np.where(np.isin(word, hot), mix(word ^ mix(context)), word)
    return (mix(key) >> np.uint64(20)) % np.uint64(parts)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new combination starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _pack(doc: np.ndarray, context: np.ndarray, word: np.ndarray) -> dict:
    """The tokens of one partition, sorted: distinct words and contexts once, small numbers for the rest."""
    order = np.lexsort((context, word))
    doc, context, word = doc[order], context[order], word[order]
    pair, kind = _runs(word, context), _runs(word)
    names, index = np.unique(context[pair], return_inverse=True)
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return {"word": word[kind], "pairs": small(np.diff(np.searchsorted(pair, kind), append=len(pair))), "names": names, "context": small(index), "times": small(np.diff(pair, append=len(doc))), "doc": small(doc)}


class _Table:
    """All tokens of one partition, sorted by word and context, with their training counts."""

    def __init__(self, packs: list[dict], hot: np.ndarray, totals: dict[int, int] | None):
        places, contexts, kinds, trains, ids = [np.empty(0, np.int32)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, bool)], [np.empty(0, np.int64)]
        names = np.unique(np.concatenate([np.empty(0, np.uint64), *(x["word"] for x in packs)]))
        first = 0
        for x in packs:
            times = x["times"].astype(np.int64)
            contexts.append(np.repeat(x["names"][x["context"]], times))
            kinds.append(np.repeat(np.repeat(np.searchsorted(names, x["word"]).astype(np.int32), x["pairs"].astype(np.int64)), times))
            places.append(x["doc"].astype(np.int32) + np.int32(first))
            trains.append(~x["held"][x["doc"]])
            ids.append(x["rows"])
            first += len(x["held"])
        self.ids = np.concatenate(ids)
        # Numbers in place of words, and each column freed as it is put in order: a partition's tokens are held about twice at most.
        context, kind = np.concatenate(contexts), np.concatenate(kinds)
        del contexts, kinds
        order = np.lexsort((context, kind))
        self.context, kind = context[order], kind[order]
        del context
        self.pair, self.kind = _runs(kind, self.context), _runs(kind)
        self.names = names[kind[self.kind]]
        del kind
        self.place, self.train = np.concatenate(places)[order], np.concatenate(trains)[order]
        del places, trains
        seen = np.concatenate([[0], np.cumsum(self.train)])
        self.c12 = np.diff(seen[np.append(self.pair, len(order))])
        self.c2 = np.diff(seen[np.append(self.kind, len(order))])
        self.is_hot = np.isin(self.names, hot)
        if totals is not None:
            for i in np.flatnonzero(self.is_hot):
                self.c2[i] = totals.get(int(self.names[i]), 0)
        self.kind_of_pair = np.searchsorted(self.kind, self.pair, "right") - 1

    def per_token(self, of_pair: np.ndarray) -> np.ndarray:
        return np.repeat(of_pair, np.diff(self.pair, append=len(self.place)))


def _counts(packs: list[dict], hot: np.ndarray) -> dict:
    """What the whole model needs to know of a partition: counts of counts, and the counts of frequent words."""
    t = _Table(packs, hot, None)
    own = t.c2[~t.is_hot]
    hist = lambda c: np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]
    held = {int(w): int(c) for w, c in zip(t.names[t.is_hot], t.c2[t.is_hot], strict=True)}
    large = lambda c: np.array([(c > K).sum(), c[c > K].sum()])
    return {"n1": hist(own), "n2": hist(t.c12), "total": int(own.sum()), "types": int((own > 0).sum()), "large": large(own), "hot": held}


def _add(a: dict, b: dict) -> dict:
    hot = dict(a["hot"])
    for w, c in b["hot"].items():
        hot[w] = hot.get(w, 0) + c
    return {k: hot if k == "hot" else a[k] + b[k] for k in a}


class Model:
    """The few numbers that all partitions share."""

    def __init__(self, x: dict, texts: int):
        self.hot_count, self.texts = x["hot"], texts
        counts = np.array([c for c in x["hot"].values() if c > 0], np.int64)
        n1 = x["n1"] + np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]
        self.total, self.types = x["total"] + int(counts.sum()), x["types"] + len(counts)
        self.d1, self.d2 = discounts(n1.astype(float)), discounts(x["n2"].astype(float))
        large = x["large"] + np.array([(counts > K).sum(), counts[counts > K].sum()])
        used = (self.d1[1:] * np.arange(1, K + 1) * n1[1 : K + 1]).sum() + large[1] - REST * large[0]
        self.unknown = 1.0 - used / self.total if self.total else 1.0

    def p1(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, kept(c, self.d1) / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.types + 1))


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _runs(key)
    return (key[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values))


def _weights(packs: list[dict], hot: np.ndarray, m: Model, parts: int) -> Iterator[tuple[int, tuple]]:
    """To the partition of each context: what its seen bigrams lose, and P of their words; and its unseen bigrams in each text."""
    t = _Table(packs, hot, m.hot_count)
    seen = t.c12 > 0
    c12, c2 = t.c12[seen], t.c2[t.kind_of_pair][seen]
    name, lost, lower = _grouped(t.context[t.pair][seen], c12 - kept(c12, m.d2), m.p1(c2))
    common = np.isin(name, hot)
    to = _part(name, None, hot, parts)
    for p in np.unique(to[common]).tolist():
        own = common & (to == p)
        yield p, (name[own], lost[own], lower[own])
    new = t.per_token(~seen)
    ask, row = t.context[new], t.ids[t.place[new]]
    rare = ~np.isin(ask, hot)
    ask, row = ask[rare], row[rare]
    ask_to = _part(ask, None, hot, parts)
    for p in range(parts):
        a, b = (to == p) & ~common, ask_to == p
        if a.any() or b.any():
            yield p, (name[a], lost[a], lower[a], ask[b], row[b])


def _backed_off(found: list[tuple], parts: int) -> Iterator[tuple[int, tuple]]:
    """log10 of a(w1) c1 for every unseen bigram, summed by text. A context never seen in training has none."""
    found = [x for x in found if len(x) == 5]
    if not found:
        return
    name, lost, lower = _grouped(*(np.concatenate([x[i] for x in found]) for i in range(3)))
    ask, row = (np.concatenate([x[i] for x in found]) for i in (3, 4))
    if len(name) and len(ask):
        at = np.minimum(np.searchsorted(name, ask), len(name) - 1)
        known = name[at] == ask
        row, more = _grouped(row[known], log_weight(lost, lower)[at[known]])
        for p, b in _by_row(row, parts):
            yield p, (row[b], more[b])


def _common(found: list[tuple]) -> list[tuple]:
    """What frequent contexts lose, of those of one partition."""
    found = [x for x in found if len(x) == 3]
    return [_grouped(*(np.concatenate([x[i] for x in found]) for i in range(3)))] if found else []


def log_weight(lost: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of a(w1) c1: the mass left, in occurrences, over that left by the words in P."""
    return np.log10(np.maximum(lost, 1e-300) / np.maximum(1 - lower, 1e-300))


def _by_row(row: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    to = (mix(row.view(np.uint64)) >> np.uint64(20)) % np.uint64(parts)
    for p in np.unique(to):
        yield int(p), to == p


def _sums(packs: list[dict], hot: np.ndarray, m: Model, weight: tuple[np.ndarray, np.ndarray], parts: int) -> Iterator[tuple[int, tuple]]:
    """By text: tokens, known ones, base score and the score but for backoff weights of other contexts."""
    t = _Table(packs, hot, m.hot_count)
    if not len(t.place):
        return
    seen, c2 = t.c12 > 0, t.c2[t.kind_of_pair]
    name, context = t.names[t.kind_of_pair], t.context[t.pair]
    with np.errstate(divide="ignore"):
        part = np.where(seen, np.log10(kept(np.maximum(t.c12, 1), m.d2)), np.log10(m.p1(c2)))
        # The word is itself the context of the next token, and the text's start that of the first.
        part -= np.where((c2 > 0) & (name != END), np.log10(np.maximum(c2, 1)), 0)
    part -= np.where(context == START, np.log10(max(m.texts, 1)), 0)
    if len(weight[0]):
        at = np.minimum(np.searchsorted(weight[0], context), len(weight[0]) - 1)
        part += np.where(~seen & (weight[0][at] == context), weight[1][at], 0)
    n = len(t.ids)
    total = lambda of_pair: np.bincount(t.place, t.per_token(of_pair), n)
    count, known, base, score = np.bincount(t.place, minlength=n), total(c2 > 0), total(m.base(c2)), total(part)
    doc = np.concatenate([x["ids"] for x in packs])
    held, none = (np.concatenate([x[k] for x in packs]) for k in ("held", "none"))
    # A text's first token is in one partition only; its id goes with that.
    start = np.zeros(n, bool)
    start[t.place[t.context == START]] = True
    order = np.argsort(t.ids, kind="stable")
    order = order[count[order] > 0]
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    for p, b in _by_row(t.ids[order], parts):
        at = order[b]
        own = at[start[at]]
        row = t.ids[at]
        yield p, (row[:1], small(np.diff(row)), small(count[at]), small(known[at].astype(np.int64)), base[at], score[at], t.ids[own], doc[own], held[own], none[own])


def score(docs: DataFrame, held_out: Column | None = None, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: rows that are not learned from, by default those whose CRC-32
    of the id as text is 2 modulo 7.  A null id counts as '' there.  Null,
    empty and blank texts consist of their end.  With no row to learn from,
    every token is unknown: its score is 0; an empty table gives no rows.
    Repeated rows are learned from and scored each on its own; texts are read
    whole, very long ones too.  Ties don't arise.  Columns other than doc_id
    and text are not read, whatever their names.  parts: partitions of the
    tables, by default twice as many as the input has.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    flag = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2 if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), flag.alias("held"), F.monotonically_increasing_id().alias("row"))
    parts = parts or max(16, 2 * rows.rdd.getNumPartitions())
    share = 1 / (HOT_PARTS * parts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column("text").to_pylist()):
                w, n = np.unique(_tokens(texts)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n, pa.int64())], ["w", "n"])

    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sample, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    size = some.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r.w for r in some.where(F.col("n") >= size * share).collect()], np.int64).view(np.uint64)
    hot = sc.broadcast(np.unique(np.append(hot, [START, END])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            # One column after the other, so that the pieces don't stay beside the whole.
            doc, context, word = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            to = _part(word, context, hot.value, parts).astype(np.min_scalar_type(parts))
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[cut[p] : cut[p + 1]]
                if len(at):
                    present, local = np.unique(doc[at], return_inverse=True)
                    x = _pack(local, context[at], word[at]) | {"ids": np.concatenate(ids)[present], "held": np.concatenate(flags)[present], "none": np.concatenate(nulls)[present], "rows": np.concatenate(places)[present]}
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(x, 5)], pa.binary())], ["p", "x"])

        held, ids, flags, nulls, places, n, count = [], [], [], [], [], 0, 0
        for batch in batches:
            doc_id, null = np.array([v or 0 for v in batch.column("doc_id").to_pylist()], np.int64), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            flag, place = np.array(batch.column("held").to_pylist(), bool), np.array(batch.column("row").to_pylist(), np.int64)
            for first, texts in blocks(batch.column("text").to_pylist()):
                doc, context, word = _tokens(texts)
                held.append(((doc + count).astype(np.int32), context, word))
                own = slice(first, first + len(texts))
                ids.append(doc_id[own])
                flags.append(flag[own])
                nulls.append(null[own])
                places.append(place[own])
                n, count = n + len(doc), count + len(texts)
                if n >= PACK:
                    yield from out()
                    held, ids, flags, nulls, places, n, count = [], [], [], [], [], 0, 0
        if held:
            yield from out()

    tables = rows.mapInArrow(pack, "p int, x binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(parts, lambda p: p)
    packs = lambda items: [pickle.loads(x) for _, x in items]
    zero = {"n1": np.zeros(K + 2, np.int64), "n2": np.zeros(K + 2, np.int64), "total": 0, "types": 0, "large": np.zeros(2, np.int64), "hot": {}}
    found = tables.mapPartitions(lambda items: [_counts(packs(items), hot.value)]).treeReduce(_add) if not rows.isEmpty() else zero
    texts = found["hot"].get(int(END), 0)
    model = sc.broadcast(Model(found, texts))
    given = tables.mapPartitions(lambda items: [(p, pickle.dumps(x, 5)) for p, x in _weights(packs(items), hot.value, model.value, parts)]).partitionBy(parts, lambda p: p)
    common = given.mapPartitions(lambda items: _common(packs(items)))
    name, lost, lower = common.treeReduce(lambda a, b: _grouped(*(np.concatenate([a[i], b[i]]) for i in range(3)))) if not rows.isEmpty() and not common.isEmpty() else [np.empty(0)] * 3
    weight = sc.broadcast((name, log_weight(lost, lower)))
    more = given.mapPartitions(lambda items: [(p, pickle.dumps(x, 5)) for p, x in _backed_off(packs(items), parts)])
    sums = tables.mapPartitions(lambda items: [(p, pickle.dumps(x, 5)) for p, x in _sums(packs(items), hot.value, model.value, weight.value, parts)])

    def gather(items: Iterator[tuple[int, bytes]]) -> Iterator[tuple[bytes]]:
        found = packs(items)
        if whole := [x for x in found if len(x) > 2]:
            row = np.concatenate([np.cumsum(np.append(x[0], x[1].astype(np.int64))) for x in whole])
            values = [np.concatenate([x[i].astype(float if i > 3 else np.int64) for x in whole]) for i in range(2, 6)]
            row, n, known, base, score = _grouped(row, *values)
            first, doc, held, none = (np.concatenate([x[i] for x in whole]) for i in range(6, 10))
            order = np.argsort(first, kind="stable")
            doc, held, none = doc[order], held[order], none[order]
            for own, extra in (x for x in found if len(x) == 2):
                np.add.at(score, np.searchsorted(row, own), extra)
            yield (pickle.dumps((doc, held, none, n, known, base, score), 5),)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                doc, held, none, n, known, base, score = pickle.loads(x)
                total = np.full(len(doc), model.value.total)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=none), pa.array(held), *(pa.array(v, pa.int64()) for v in (n, known, total)), pa.array(base), pa.array(score)], [c.split()[0] for c in SCHEMA.split(", ")])

    packed = sums.union(more).partitionBy(parts, lambda p: p).mapPartitions(gather)
    return spark.createDataFrame(packed, "x binary", verifySchema=False).mapInArrow(write, SCHEMA)
