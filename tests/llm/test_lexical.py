"""Ranked search against scores by hand."""

import math
import random
import re

import numpy as np
import pytest

from quarrylane.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    texts = [(i, plain_terms(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(plain_terms(t))
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, terms in queries.items():
        found = []
        for d, t in texts:
            m = 10 + 90 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms if x in t)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


def rows():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["the"] * 900 + ["Été", "δοκιμή", "a_b", "x-y.z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(5, "the w1"), (5, "the w1"), (None, docs[7][1]), (None, None), (900, None), (901, ""), (902, "-- !"), (903, "the " * 50_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(20)]
    items += [(30, docs[3][1]), (31, None), (32, "nowhere"), (33, ""), (34, "the THE The"), (7, "w2 w3"), (None, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("query_bytes, batch", [(8 << 20, 4096), (300, 16)])
def test_search(spark, monkeypatch, query_bytes, batch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(lexical, "BATCH_ROWS", batch)
    docs, items = rows()
    got = lexical.search(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, score int").repartition(3),
                         spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_search(docs, items)))


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        rows, k = 300, 5
        lists, codes = {}, list(range(12))
        for c in codes:
            at = np.sort(rng.choice(rows, int(rng.integers(1, 8) if c < 6 else rng.integers(100, 300)), replace=False))
            lists[c] = (at, rng.integers(1, 1000, len(at)))
        weights = [6000 - 100 * c if c < 6 else 400 - 20 * c for c in codes]
        plan = lexical.Plan(codes, weights, [int(lists[c][1].max()) for c in codes])
        want = np.zeros(rows, dtype=np.int64)
        for c in codes:
            want[lists[c][0]] += weights[c] * lists[c][1]
        at, score = lexical.partial_scores(plan, lists, rows, 0, k)
        assert (score == want[at]).all() and len(at) < rows
        assert sorted(score)[-k:] == sorted(want)[-k:]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert lexical.search(docs, items).count() == 0 == lexical.search(some, items).count()
    assert lexical.search(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
