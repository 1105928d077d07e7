"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case.  A seed is a run of
``MATCH`` tokens.  Documents are joined to benchmark items on shared seeds:
the items' seeds are a sorted array of Karp-Rabin hashes that every task
probes with those of its documents, all at once.  An item whose positions
under shared seeds could not reach the threshold is passed over (tiles can
only cover such positions).  For the others, greedy string tiling marks the
longest matches that overlap no tile, again and again, finding matches by
running Karp-Rabin hashing over the unmarked stretches with falling lengths.
The share of the item under tiles is its coverage; as tiles may lie in any
order in the document, moved sentences still count.

The benchmark is taken in blocks of at most ``BLOCK_TOKENS`` tokens, each
one pass over the documents, so what is sent to the tasks is bounded however
large the benchmark grows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ._util import text_or_empty
from ._words import mix

MATCH = 5
COVERAGE = 0.6
BLOCK_TOKENS = 2_000_000
_TOKEN = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
SCHEMA = "doc_id bigint, item_id bigint, coverage double, covered int, item_tokens int, tiles int, longest int"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _windows(tokens: list[int], marks: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of all windows of ``size`` unmarked tokens, the hash carried on from window to window."""
    drop, h, run = pow(_BASE, size, _MOD), 0, 0
    for i, t in enumerate(tokens):
        if marks[i]:
            h = run = 0
            continue
        h = (h * _BASE + t + 1) % _MOD
        run += 1
        if run > size:
            h = (h - (tokens[i - size] + 1) * drop) % _MOD
        if run >= size:
            yield i - size + 1, h


def tile(text: list[int], item: list[int], least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, length) of at least ``least`` tokens; longer ones first, then earlier in item and text.

    A value of -1 matches nothing.  Each round finds by bisection the greatest
    length at which unmarked windows still match, with running hashes, and
    marks the matches of that length.  Windows of one hash are kept in a
    list, of which a beginning that marks have reached is never looked at
    again: a round takes time in proportion to text and item, however often
    they repeat themselves.
    """
    marks_t, marks_i = bytearray(t < 0 for t in text), bytearray(t < 0 for t in item)
    tiles: list[tuple[int, int, int]] = []

    def starts(size: int) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
        """Item windows that occur in the text, and where."""
        own = list(_windows(item, marks_i, size))
        wanted = {h for _, h in own}
        found = defaultdict(list)
        for i, h in _windows(text, marks_t, size):
            if h in wanted:
                found[h].append(i)
        return [(j, h) for j, h in own if h in found], found

    def matching(size: int) -> bool:
        own, found = starts(size)
        return any(text[i : i + size] == item[j : j + size] for j, h in own for i in found[h][:1])

    top = min(len(text), len(item))
    while top >= least and matching(least):
        low, high = least, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if matching(middle) else (low, middle - 1)
        own, found = starts(low)
        at = dict.fromkeys(found, 0)
        for j, h in own:
            if marks_i.find(1, j, j + low) >= 0:
                continue
            places, k = found[h], at[h]
            while k < len(places) and marks_t.find(1, places[k], places[k] + low) >= 0:
                k += 1
            at[h] = k
            if k < len(places) and text[places[k] : places[k] + low] == item[j : j + low]:
                tiles.append((places[k], j, low))
                marks_t[places[k] : places[k] + low] = marks_i[j : j + low] = b"\1" * low
        top = low
    return tiles


def _hashes(ids: np.ndarray, least: int) -> np.ndarray:
    """Hash of every window of ``least`` ids (0: unknown)."""
    h = np.zeros(max(0, len(ids) - least + 1), np.uint64)
    for k in range(least):
        h = mix(h ^ ids[k : k + len(h)].astype(np.uint64))
    return h


class Index:
    """Seeds of a block of benchmark items, small enough to send to every task."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, coverage: float):
        self.least, self.coverage, self.vocabulary = least, coverage, {}
        self.items: list[tuple[int, list[int]]] = []
        seeds, where, at = [], [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)]
            if len(ids) < 1:
                continue
            h = _hashes(np.array(ids), min(least, len(ids)))
            if len(ids) >= least:
                seeds.append(h)
                where.append(np.full(len(h), len(self.items)))
                at.append(np.arange(len(h)))
            self.items.append((item_id, ids))
        order = np.argsort(np.concatenate(seeds), kind="stable") if seeds else []
        self.seeds, self.where, self.at = (np.concatenate(x)[order] if seeds else np.empty(0, np.int64) for x in (seeds, where, at))
        self.distinct = np.unique(self.seeds)
        self.short = [(k, ids) for k, (_, ids) in enumerate(self.items) if len(ids) < least]

    def match(self, text: str) -> Iterator[tuple[int, float, int, int, int, int]]:
        ids = np.fromiter(map(self.vocabulary.get, tokens(text), repeat(0)), np.int64)
        own: list[int] | None = None
        for k, item in self.short:  # shorter than a seed: the whole item, word for word
            own = ids.tolist() if own is None else own
            n = len(item)
            if any(own[i : i + n] == item for i in range(len(own) - n + 1)):
                yield self.items[k][0], 1.0, n, n, 1, n
        if not len(self.distinct) or len(ids) < self.least:
            return
        known = ids > 0
        run = np.convolve(known, np.ones(self.least, int), "valid") == self.least
        if not run.any():
            return
        windows = _hashes(ids, self.least)
        windows[~run] = 0
        h = np.unique(windows[run])
        h = h[self.distinct[np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)] == h]
        if not len(h):
            return
        a, b = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        hits = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
        order = np.argsort(self.where[hits], kind="stable")
        hits = hits[order]
        for k in np.unique(self.where[hits]).tolist():
            item_id, item = self.items[k]
            mine = hits[np.searchsorted(self.where[hits], k) : np.searchsorted(self.where[hits], k, "right")]
            under = np.zeros(len(item), bool)
            for shift in range(self.least):
                under[self.at[mine] + shift] = True
            if under.sum() < self.coverage * len(item):
                continue
            # Tiles lie under the item's own seeds, in the text too: nothing else of it is looked at.
            seeded = np.flatnonzero(np.isin(windows, self.seeds[mine]) & run)
            kept = np.zeros(len(ids) + 1, bool)
            for shift in range(self.least):
                kept[seeded + shift] = True
            places = np.flatnonzero(kept[:-1] | np.roll(kept, 1)[:-1])
            own = np.where(kept[places], ids[places], -1).tolist()
            tiles = tile(own, item, self.least)
            covered = sum(t[2] for t in tiles)
            if covered >= self.coverage * len(item):
                yield item_id, covered / len(item), covered, len(item), len(tiles), max(t[2] for t in tiles)


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str | None]]]:
    held, count = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        held.append((row.item_id, row.text))
        count += len(row.text or "") // 4 + 1
        if count >= size:
            yield held
            held, count = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MATCH, block: int = BLOCK_TOKENS) -> DataFrame:
    """(document, item) of which at least ``coverage`` of the item's tokens lie under tiles in the document.

    Columns: doc_id, item_id, coverage, covered, item_tokens, tiles, longest.
    Null and empty texts match nothing, items without tokens neither.  Items
    of fewer than ``least`` tokens must occur word for word.  Repeated rows
    give repeated results, rows without doc_id too; empty tables give none.
    Of matches of one length the earlier in the item, then in the text, is
    marked first.  Texts are read whole, very long and repetitive ones in
    time that grows with their length.  Columns other than doc_id, item_id
    and text are not read, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    out = None
    for items in _blocks(benchmark, block):
        index = spark.sparkContext.broadcast(Index(items, least, coverage))

        def run(batches: Iterator[pa.RecordBatch], index: object = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in index.value.match(t)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        found = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _clean(index: object) -> Column:
    """Whether no item of a broadcast index contaminates the text."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([not t or next(index.value.match(t), None) is None for t in text.to_pylist()], pa.bool_())

    return F.arrow_udf(run, BooleanType())(text_or_empty())


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MATCH, block: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, with its columns, that no item contaminates: each is decided on its own, whatever its id."""
    out = docs
    for items in _blocks(benchmark, block):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast(Index(items, least, coverage))))
    return out
