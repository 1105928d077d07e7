"""The classifier on held-out rows, and its posteriors against those computed by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, p_text string, _site int"


def corpus(n, seed):
    """Prose, and junk of four kinds; (text, good)."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmn", k=rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "and", "to"] * 30
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(8, 120))
        if i % 4:
            out.append((" ".join(w).capitalize() + ".", 1))
        else:
            junk = (" ".join(x + rng.choice(["$$$", "***", "&&&"]) for x in w), " | ".join(x.capitalize() for x in w), " ".join([w[0]] * len(w)), " ".join("BUY" + x for x in w[:9]) + "!!!")
            out.append((junk[i // 4 % 4], 0))
    return out


def test_held_out_accuracy_and_posteriors(spark):
    texts = corpus(1800, 1)
    rows = [(i, t, "en" if i % 3 else None, "good" if y else f"site{i % 5}", "p", 1) for i, (t, y) in enumerate(texts)]
    rows += [(None, "The end of the text and the rest of it.", "en", "good", "p", 1), (9000, None, None, None, None, None), (9001, " \n", "en", "good", "", 0), rows[1], (1, rows[4][1], "en", "good", "p", 1), (9002, "the of and to " * 4000, "en", "good", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(texts[:1350])] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r.p_text > 0.5 for r in got if r.doc_id is not None and 1350 <= r.doc_id < 1800}
    assert sum(held[i] == bool(texts[i][1]) for i in held) >= 0.96 * len(held)
    # Sums, prior strengths and posteriors by hand.
    seen = [r for r in got if r.p_text > 0]
    paths = {}
    for r in seen:
        s, n = paths.get((r.host, r.path), (0.0, 0))
        paths[r.host, r.path] = s + r.p_text, n + 1
    hosts = {}
    for (h, _), (s, n) in paths.items():
        a, b = hosts.get(h, (0.0, 0))
        hosts[h] = a + s, b + n
    prior = sum(s for s, _ in hosts.values()) / sum(n for _, n in hosts.values())

    def strength(groups):
        rates, means, counts = zip(*groups, strict=True)
        m = sum(means) / len(means)
        spread = np.var(rates) - sum(x * (1 - x) / n for x, n in zip(means, counts, strict=True)) / len(means)
        return min(max(m * (1 - m) / max(spread, 1e-9) - 1, 1.0), 1e6)

    k = strength([(s / n, prior, n) for s, n in hosts.values()])
    p_host = {h: (s + k * prior) / (n + k) for h, (s, n) in hosts.items()}
    k = strength([(s / n, p_host[h], n) for (h, _), (s, n) in paths.items()])
    p_path = {x: (s + k * p_host[x[0]]) / (n + k) for x, (s, n) in paths.items()}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in seen:
        assert r.p_host == pytest.approx(p_host[r.host], abs=1e-9) and r.p_path == pytest.approx(p_path[r.host, r.path], abs=1e-9)
        z = logit(r.p_text) + logit(r.p_path) - logit(prior)
        assert r.p_good == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.keep == (r.p_good >= 0.5)
    assert [r.p_good for r in got if r.doc_id in (9000, 9001)] == [0.0, 0.0]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([r.doc_id for r in got if r.keep], key=str)
    assert None in ids and 9000 not in ids and 9002 in [r.doc_id for r in got]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "a", "", 0), (2, "", "en", "a", "", 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [(r.doc_id, r.p_text, r.keep) for r in quality.score(docs, labels).orderBy("doc_id").collect()] == [(1, 0.5, True), (2, 0.0, False)]
    assert quality.score(docs.limit(0), labels).count() == 0 and quality.keep_good(docs.limit(0), labels).columns == docs.columns


def test_features_by_hand():
    texts = ["Ab ab $$$ x1", "", "ab"]
    owner, bucket, value, stats = quality.features(texts)
    assert stats[:, 0].tolist() == [1, 1, 1] and stats[0, 2] == 1 / 4 and stats[0, 3] == 3 / 4
    assert np.bincount(owner, value.astype(float) ** 2, 3) == pytest.approx([1, 0, 1], abs=1e-5)
    one = {int(b) for o, b in zip(owner, bucket, strict=True) if o == 2}
    assert len(one) == 2 and one <= {int(b) for o, b in zip(owner, bucket, strict=True) if o == 0}


def test_labels_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "a", "", 0) for i in range(50)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    fitted = []
    before = quality.fit
    quality.fit = lambda x, y: fitted.append(len(y)) or before(x, y)
    try:
        quality.train(docs, labels, max_labels=20)
    finally:
        quality.fit = before
    assert fitted == [20]
    assert quality.score(docs, labels.where(F.lit(False))).count() == 50
