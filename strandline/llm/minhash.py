"""Near-duplicate classes by DartMinHash over five-word shingles.

A text is the weighted set of its shingles, each weighing as often as it
occurs; the similarity is the weighted Jaccard index, 0.8 or more.

Signature: every element throws darts at its weight axis, cut at 1, 2, 4, 8
and so on.  In each region that the weight reaches, the darts' ranks are the
arrivals of a Poisson process as fast as the region is wide, seeded by
element and region, so that all texts see the same darts.  A dart hits if its
weight coordinate lies below the element's weight.  It falls on one of
``COORDINATES`` coordinates, and each keeps its earliest hit.  Ranks are
followed up to the value at which about k ln k + 3k darts have hit, doubled
for the few texts in which a coordinate is still empty: the work is that of
the element count plus k log k.

Joining: 24 bands of 4 coordinates; a pair at 0.8 misses all of them with
probability (1 - 0.8^4)^24 = 3e-6.  Texts that are equal are one node.  In a
bucket of several nodes, all are compared exactly with one leader, and links
are closed to components, twice.  So a group of thousands of near copies
costs about two comparisons a member.  The texts of buckets that still hold
more than one component then meet on their rarest elements (prefix
filtering, which is exact), and pairs of different components are compared.
So no link that a bucket holds is lost, and texts that only share a common
passage don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, durable, free_name, text_or_empty
from ._words import blocks, mix, shingles

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Rounds in which a bucket's members are compared with one leader.
LEADERS = 2
#: Words of 64 bits in which the parities of a set's hashed elements are kept.
PARITY = 8


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, element, number of times) of the distinct pairs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(at, append=len(h))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) uint64: DartMinHash of the weighted sets numbered by ``doc``; sets of no weight get zeros."""
    weight = weight.astype(float)
    total = np.bincount(doc, weight, n)
    reach = (k * np.log(k) + 3 * k) / np.maximum(total, 1e-300)
    best = np.full((n, k), np.inf)
    todo = np.flatnonzero(total > 0)
    region_of = []
    low, width, number = 0.0, 1.0, 0
    while (here := np.flatnonzero(weight > low)).size:
        region_of.append((here, low, width, number))
        low, width, number = (1.0, 1.0, 1) if number == 0 else (low * 2, width * 2, number + 1)
    at = np.concatenate([x[0] for x in region_of]) if region_of else np.empty(0, int)
    low = np.repeat([x[1] for x in region_of], [len(x[0]) for x in region_of])
    width = np.repeat([x[2] for x in region_of], [len(x[0]) for x in region_of])
    seed = mix(element[at] ^ mix(np.repeat(np.array([x[3] for x in region_of], np.uint64), [len(x[0]) for x in region_of])))
    while todo.size:
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[doc[at]])
        rank, i = np.zeros(len(live)), 0
        while live.size:
            key = mix(seed[live] + np.uint64(i))
            rank = rank - np.log1p(-(key >> np.uint64(11)).astype(float) * 2.0**-53) / width[live]
            keep = rank < reach[doc[at[live]]]
            live, rank, key = live[keep], rank[keep], mix(key[keep])
            height = low[live] + width[live] * ((key >> np.uint64(32)).astype(float) * 2.0**-32)
            hit = height < weight[at[live]]
            slot = doc[at[live[hit]]] * k + (key[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(best.reshape(-1), slot, rank[hit])
            i += 1
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        reach[todo] *= 2
    best[np.isinf(best)] = 0
    return best.view(np.uint64)


def band_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, (texts, BANDS) uint64)."""
    doc, h = shingles(texts, WORDS)
    sig = signatures(*weighted(doc, h), len(texts))
    out = np.empty((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(texts), b, np.uint64)
        for c in range(ROWS):
            x = mix(x ^ sig[:, b * ROWS + c])
        out[:, b] = x
    return np.bincount(doc, minlength=len(texts)), out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in blocks(batch.column("text").to_pylist()):
            n, bands = band_hashes(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(first, len(texts)), pa.array(n, pa.int32()), lists], ["c", "n", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted set as a plain set: the i-th time of an element is an element of its own."""
    for batch in batches:
        for first, texts in blocks(batch.column("text").to_pylist()):
            doc, h, times = weighted(*shingles(texts, WORDS))
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            items = mix(np.repeat(h, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, times, len(texts)).astype(np.int64))]).astype(np.int32)
            bits = np.zeros((len(texts), PARITY * 64), np.uint8)
            np.bitwise_xor.at(bits, (np.repeat(doc, times), items.view(np.uint64) % np.uint64(PARITY * 64)), 1)
            words = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PARITY), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(items)), parity], ["c", "items", "parity"])


def components(edges: DataFrame) -> DataFrame:
    """(c, label) of all nodes of ``edges`` (a, b): label is the least node of the component.

    Each step takes the least label among neighbours, hooks the old label's
    node to it and shortens paths, so that steps grow with the logarithm of
    the longest path.  Only labels move, never whole components.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = durable(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("label")))
    # One row per node: sent to all tasks while there are few, joined by shuffle beyond that.
    few = F.broadcast if now.count() <= BROADCAST_ROWS else lambda df: df
    while True:
        near = both.join(few(now), both["b"] == now["c"]).groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        stepped = near.join(few(now), "c").withColumn("near", F.least("label", "near"))
        hook = stepped.groupBy(F.col("label").alias("c")).agg(F.min("near").alias("hook"))
        hooked = stepped.join(few(hook), "c", "left").select("c", "label", F.least("near", F.coalesce("hook", "near")).alias("to"))
        jump = now.select(F.col("c").alias("to"), F.col("label").alias("next"))
        new = durable(hooked.join(few(jump), "to").select("c", "label", F.least("to", "next").alias("new")))
        if new.where("label <> new").isEmpty():
            return now
        now = new.select("c", F.col("new").alias("label"))


def _sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, items, parity) of the texts that share a bucket with another."""
    texts = docs.join(members.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.first("text").alias("text"))
    return durable(texts.mapInArrow(_elements, "c binary, items array<bigint>, parity array<bigint>").repartition("c"))


def _by_prefix(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(c, n, a, an) of ``nodes`` (c, n, label) of different labels that could be similar: a superset of those that are.

    With the elements of all sets in one order, rarest first, two sets of
    that similarity share one of the first n - ceil(threshold n) + 1 elements
    of each.  What many texts share, a passage say, comes last in that order.
    """
    items = durable(nodes).join(sets, "c").select("c", "n", "label", F.explode("items").alias("e"))
    often = items.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = items.join(often, "e").withColumn("place", F.row_number().over(W.partitionBy("c").orderBy("df", "e")))
    # Elements of one text only stand before all others and join nothing; they count by what is left out.
    ranked = ranked.withColumn("shared", F.count("*").over(W.partitionBy("c"))).withColumn("place", F.expr("place + n - shared"))
    ranked = durable(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("e", "c", "n", "label", "place"))
    kinds = ranked.groupBy("e", "label").agg(F.count("*").alias("m")).groupBy("e").agg(F.max_by("label", "m").alias("main"), F.count("*").alias("labels")).where("labels > 1")
    here = ranked.join(kinds.select("e", "main"), "e").join(sets.select("c", "parity"), "c")
    few = here.where("label <> main").select("e", F.col("c").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("place").alias("ap"), F.col("parity").alias("ay"))
    # From their first common element on, similar sets have room for the overlap that they need.
    room = F.least(F.expr("n - place"), F.expr("an - ap")) + 1 >= (F.col("n") + F.col("an")) * (threshold / (1 + threshold)) - 1e-6
    # Every element in which two sets differ changes one parity, so they differ in no fewer elements than parities.
    apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("ay")[i])) for i in range(PARITY)), F.lit(0))
    room = room & (apart <= (F.col("n") + F.col("an")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    once = (F.col("label") == F.col("main")) | (F.col("a") < F.col("c"))
    return here.join(few, "e").where("label <> al").where(once).where(room)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have the similarity."""
    x = pairs.join(sets.select(F.col("c").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("c").alias("a"), F.col("items").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return x.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def _text() -> Column:
    """The text as it is compared: '' where it is null or blank."""
    return F.when(text_or_empty().rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.lit(""))


def links(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, c) of all rows, (c, label) of the texts that have near copies). c is the MD5 of the text."""
    docs = docs.select("doc_id", _text().alias("text"))
    docs = docs.withColumn("c", F.unhex(F.md5("text")))
    sketches = docs.select("c", "text").where("text <> ''").mapInArrow(_sketch, "c binary, n int, bands array<bigint>")
    sketches = durable(sketches.groupBy("c").agg(F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = sketches.select("c", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = durable(spread.join(shared, "bucket"))
    sets = _sets(members, docs)
    close = F.least("n", "an") >= threshold * F.greatest("n", "an")
    one, two = F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")
    edges, tested = None, None
    here = members.withColumn("label", F.col("c"))
    for number in range(LEADERS + 1):
        if number < LEADERS:
            lead = F.min_by(F.struct(F.col("c").alias("a"), F.col("n").alias("an"), F.col("label").alias("al")), F.xxhash64("c", F.lit(number)))
            leaders = here.groupBy("bucket").agg(lead.alias("l")).select("bucket", "l.*")
            pairs = here.join(leaders, "bucket").where("label <> al").where(close).select(one, two).distinct()
        else:
            pairs = _by_prefix(here.groupBy("c").agg(F.first("n").alias("n"), F.first("label").alias("label")), sets, threshold).where(close).select(one, two).distinct()
        pairs = durable(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = durable(_verified(pairs, sets, threshold).select("a", "b"))
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
        if number < LEADERS:
            here = members.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
            mixed = here.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
            here = durable(here.join(mixed, "bucket"))
            if here.isEmpty():
                break
    return docs.select("doc_id", "c"), labels


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, c) of all rows, (c, least doc_id, rows, label of the class) of all texts)."""
    ids, labels = links(docs, threshold)
    ids = durable(ids)
    texts = ids.groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classed = durable(texts.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")))
    return ids, classed


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), class_size (rows), n_texts (different ones).

    Null, empty and blank texts count as '' and are one class.  Texts of
    fewer than five words are one shingle; very long ones are read whole.
    Repeated rows are copies of each other.  A null doc_id is kept; a class
    of none but those has a null id.  Texts that share an id are told apart,
    so two classes can have the same class_id.  Ties (equal ids) make no
    difference here.  An empty table gives no rows; columns other than doc_id
    and text are not read, whatever their names.
    """
    ids, classed = _classed(docs, threshold)
    classes = classed.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("n_texts"))
    by_text = durable(classed.select("c", "label").join(classes, "label").select("c", "class_id", "class_size", "n_texts"))
    return ids.join(by_text, "c").select("doc_id", "class_id", "class_size", "n_texts")


def keep_first(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with its columns, without all but one of each class: that of the least doc_id, rows without id last.

    Cases are as in ``near_duplicates``.  Rows are told apart by doc_id and
    text: different texts with one id are decided each on its own, and of the
    rows of a class with the least id one stays, that of the least text hash.
    """
    ids, classed = _classed(docs, threshold)
    first = classed.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "c")).alias("f"))
    first = durable(first.select(F.col("f.least").alias("doc_id"), F.col("f.c").alias("c")))
    one = ids["doc_id"].eqNullSafe(first["doc_id"]) & (ids["c"] == first["c"])
    again = durable(ids.join(first, one, "left_semi").groupBy("doc_id", "c").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "c"))
    id_, key, c = (free_name(docs, n) for n in ("_first", "_key", "_c"))
    first, again = first.toDF(id_, key), again.toDF(id_, key)
    keyed = docs.withColumn(c, F.unhex(F.md5(_text())))

    def of(rows: DataFrame, those: DataFrame, how: str = "left_semi") -> DataFrame:
        return rows.join(those, rows["doc_id"].eqNullSafe(those[id_]) & (rows[c] == those[key]), how)

    kept = of(keyed, first)
    if again.isEmpty():
        return kept.drop(c)
    return of(kept, again, "left_anti").unionByName(of(kept, again).dropDuplicates(["doc_id", c])).drop(c)
