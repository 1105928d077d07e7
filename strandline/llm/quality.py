"""Quality classifier with hierarchical empirical Bayes.

1. A logistic classifier over hashed word n-grams (words, pairs of words, and
   the same of words' shapes: letters, digits and signs) and a few statistics
   of the text is fitted on a bounded sample of labelled rows (``max_labels``,
   drawn by hash).
2. Its probabilities are added up per site (host) and path.  A host's rate of
   good text is a beta posterior around the global rate, a path's is one
   around its host's rate; the strengths of both priors come from the spread
   of the observed rates (method of moments), so a site with little text
   stays near the level above.
3. A document's log odds are the classifier's, moved by the difference
   between the log odds of its path's posterior and the global prior.

The groups hold sums only, so a host with a third of all rows is
pre-aggregated in each task.  Texts are classified in Arrow batches; the rest
is DataFrame expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ._util import durable, free_name, small_or_shuffled, text_or_empty
from ._words import _LOWER, _SPACE, blocks, mix

#: Buckets of the hashed n-grams, and statistics of the text.
BUCKETS, STATISTICS = 1 << 16, 7
MAX_LABELS = 6_000
THRESHOLD = 0.5
#: Passes over the sample, rows of a step, step size and penalty.
EPOCHS, STEP_ROWS, RATE, PENALTY = 8, 64, 0.3, 1e-5
_P = np.uint64(0x5851F42D4C957F2D)
#: Letters as a, digits as 0, other signs as they are.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = ord("a")
_KIND[48:58] = ord("0")
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _hashed(codes: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the codes of each word (numbers that don't fall)."""
    first = np.searchsorted(word, np.arange(n))
    pos = np.arange(len(word)) - first[word]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(pos.max(initial=0)), _P)]))
    out = np.zeros(n, np.uint64)
    at = np.flatnonzero(np.diff(first, append=len(word)) > 0)
    if len(at):
        out[at] = np.add.reduceat(_BYTE[codes] * power[pos], first[at])
    return mix(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each n-gram's bucket, bucket, value, (texts, STATISTICS)); values of a text have the length one."""
    raw = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
    n = len(raw)
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    at = np.flatnonzero(~_SPACE[buf])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > at[:-1] + 1
    word = np.cumsum(new) - 1
    words = int(new.sum())
    doc = np.searchsorted(ends, at[new], "right")
    whole = _hashed(buf[at], word, words)
    kind = _KIND[buf[at]]
    turn = new.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    shape = _hashed(kind[turn], word[turn], words)
    same = doc[1:] == doc[:-1]
    pairs = [(doc, whole, 1), (doc, shape, 2)] + [(doc[1:][same], mix(x[:-1][same]) ^ x[1:][same], k) for x, k in ((whole, 3), (shape, 4))]
    owner = np.concatenate([d for d, _, _ in pairs])
    bucket = np.concatenate([mix(h + np.uint64(k)) % np.uint64(BUCKETS) for _, h, k in pairs]).astype(np.int64)
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, bucket, value = key // BUCKETS, key % BUCKETS, np.log1p(count)
    value /= np.sqrt(np.maximum(np.bincount(owner, value * value, n), 1e-12))[owner]

    per = lambda mask_doc: np.bincount(mask_doc, minlength=n)
    size, count = np.array([max(len(r), 1) for r in raw], float), np.maximum(per(doc), 1)
    again = whole[1:] == whole[:-1]
    distinct = per(np.unique(np.stack([doc.astype(np.uint64), whole]), axis=1)[0].astype(np.int64))
    in_doc = np.searchsorted(ends, at, "right")
    stats = np.stack(
        [
            np.ones(n),
            np.log10(size + 1) / 5,
            per(doc[1:][same & again]) / count,
            distinct / count,
            np.minimum(size / count / 20, 2.0),
            4 * per(in_doc[(kind != ord("a")) & (kind != ord("0"))]) / size,
            2 * per(in_doc[kind == ord("0")]) / size,
        ],
        axis=1,
    )
    return owner, bucket, value.astype(np.float32), stats


def fit(x: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights (buckets, then statistics) of a logistic regression on rows (buckets, values, statistics), by adaptive steps in a fixed order."""
    w = np.zeros(BUCKETS + STATISTICS)
    scale = np.full(len(w), 1e-3)
    draw = np.random.default_rng(1)
    for epoch in range(EPOCHS):
        order = draw.permutation(len(y))
        for a in range(0, len(order), STEP_ROWS):
            own = order[a : a + STEP_ROWS]
            index = np.concatenate([np.append(x[i][0], np.arange(BUCKETS, BUCKETS + STATISTICS)) for i in own])
            value = np.concatenate([np.append(x[i][1], x[i][2]) for i in own])
            row = np.repeat(np.arange(len(own)), [len(x[i][0]) + STATISTICS for i in own])
            z = np.clip(np.bincount(row, w[index] * value, len(own)), -30, 30)
            loss = 1 / (1 + np.exp(-z)) - y[own]
            at, place = np.unique(index, return_inverse=True)
            grad = np.bincount(place, loss[row] * value, len(at)) / len(own) + PENALTY * w[at]
            scale[at] += grad * grad
            w[at] -= RATE * grad / np.sqrt(scale[at]) / (1 + epoch / 2)
    return w


def _packed(text: pa.Array) -> pa.Array:
    """The features of each text, packed."""
    out: list[bytes] = []
    for _, texts in blocks(text.to_pylist()):
        owner, bucket, value, stats = features(texts)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            own = slice(cut[i], cut[i + 1])
            out.append(np.int32(cut[i + 1] - cut[i]).tobytes() + bucket[own].astype(np.uint16).tobytes() + value[own].astype(np.float16).tobytes() + stats[i].astype(np.float32).tobytes())
    return pa.array(out, pa.binary())


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(x, np.int32, 1)[0])
    return np.frombuffer(x, np.uint16, n, 4).astype(np.int64), np.frombuffer(x, np.float16, n, 4 + 2 * n).astype(float), np.frombuffer(x, np.float32, STATISTICS, 4 + 4 * n).astype(float)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labels: int = MAX_LABELS) -> np.ndarray:
    """Weights of the classifier, fitted on at most ``max_labels`` rows of labelled documents; without any all zero (every document is a toss-up)."""
    sample = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(target).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )
    pack = F.arrow_udf(_packed, BinaryType())
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.md5("text").alias("m"), pack("text").alias("x"))
    # Rows that share an id are as many as they like: the bound holds for them too.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "m").limit(max_labels).collect()
    if not rows:
        return np.zeros(BUCKETS + STATISTICS)
    return fit([_unpacked(bytes(r.x)) for r in rows], np.array([float(r.y) for r in rows]))


def probability(w: np.ndarray) -> Column:
    """The classifier's probability for the column ``text``; 0 for a blank one."""

    def run(text: pa.Array) -> pa.Array:
        out = []
        for _, texts in blocks(text.to_pylist()):
            owner, bucket, value, stats = features(texts)
            z = np.bincount(owner, w[bucket] * value, len(texts)) + stats @ w[BUCKETS:]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p[np.bincount(owner, minlength=len(texts)) == 0] = 0.0
            out.append(p)
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return F.arrow_udf(run, DoubleType())(text_or_empty())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> Column:
    """Prior strength from the spread of group rates: m(1-m)/var - 1, kept within 1..1e6."""
    m = F.avg(mean)
    between = F.greatest(F.var_pop("rate") - F.avg(F.col(mean) * (1 - F.col(mean)) / F.col("n")), F.lit(1e-9))
    return groups.agg(F.least(F.greatest(F.coalesce(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1.0)), F.lit(1e6)).alias("k")).select("k")


def posteriors(scored: DataFrame, host: str, path: str, p: str) -> tuple[DataFrame, float]:
    """((host, path, p_host, p_path) of all paths with text, global prior) of rows with a classifier's probability (0: no text)."""
    rows = scored.where(F.col(p) > 0).select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(p).alias("p"))
    paths = durable(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    hosts = durable(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("rate", F.col("s") / F.col("n")))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    prior = total[0] / total[1] if total[1] else 0.5
    k = _strength(hosts.withColumn("prior", F.lit(prior)), "prior").first()[0]
    hosts = durable(hosts.select("host", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("p_host")))
    paths = durable(paths.join(small_or_shuffled(hosts), "host"))
    k = _strength(paths.withColumn("rate", F.col("s") / F.col("n")), "p_host").first()[0]
    return durable(paths.select("host", "path", "p_host", ((F.col("s") + k * F.col("p_host")) / (F.col("n") + k)).alias("p_path"))), prior


def _good(p: Column, p_path: Column, prior: float) -> Column:
    moved = _logit(p) + _logit(p_path) - _logit(F.lit(prior))
    return F.when(p == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-moved)))


def _site(docs: DataFrame, host: Column | None, path: Column | None) -> tuple[Column, Column]:
    return F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")), F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, p_text, p_host, p_path, p_good, keep.

    host, path: columns of the site and of the path within it; by default
    ``source`` and ``lang``.  Null host or path counts as the site ''.  Null,
    empty or blank text has p_text = p_good = 0 and is rejected, and is no
    evidence about its site.  Very long texts are read whole.  Null ids are
    scored like others.  Repeated rows are scored alike and count as often as
    they occur; a p_good that equals the threshold is kept.  Empty ``labels``
    give p_text = 0.5, which is kept at the default threshold; empty ``docs``
    give no rows.  Other columns are not read, whatever their names.
    """
    w = train(docs, labels, max_labels=max_labels)
    host, path = _site(docs, host, path)
    scored = durable(docs.select("doc_id", host.alias("host"), path.alias("path"), probability(w).alias("p_text")))
    paths, prior = posteriors(scored, "host", "path", "p_text")
    out = scored.join(small_or_shuffled(paths), ["host", "path"], "left").fillna(prior, ["p_host", "p_path"])
    out = out.select("doc_id", "host", "path", "p_text", "p_host", "p_path", _good(F.col("p_text"), F.col("p_path"), prior).alias("p_good"))
    return out.withColumn("keep", F.col("p_good") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs``, with its columns, that ``score`` keeps: each is decided on its own, whatever its id."""
    w = train(docs, labels, max_labels=max_labels)
    names = [free_name(docs, f"_{n}") for n in ("site", "site_path", "p_text", "p_path")]
    site, below, p, p_path = names
    host, path = _site(docs, host, path)
    scored = durable(docs.withColumns({site: host, below: path, p: probability(w)}))
    paths, prior = posteriors(scored, site, below, p)
    found = small_or_shuffled(durable(paths.select(F.col("host").alias(site), F.col("path").alias(below), F.col("p_path").alias(p_path))))
    good = _good(F.col(p), F.coalesce(F.col(p_path), F.lit(prior)), prior) >= threshold
    return scored.join(found, [site, below], "left").where(good).select(*[f"`{c}`" for c in docs.columns])
