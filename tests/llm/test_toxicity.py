"""Toxicity: noisy-or by hand, held-out recall, edge cases."""

import math
import random
import zlib

import numpy as np

from quarrylane.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_score_by_hand():
    model = toxicity.Model({b"bad": 4.0, b"worse": 2.0, b"nasti*": 3.0}, -3.0)
    text = "All is well.\nThis is BAD, worse! nastiness? . \n"
    p = [1 / (1 + math.exp(-z)) for z in (-3.0, 3.0, 0.0)]
    got, spans = model.document(text)
    assert abs(got - (1 - math.prod(1 - x for x in p))) < 1e-12
    assert [text[s["start"]:s["end"]].strip() for s in spans] == ["This is BAD, worse", "nastiness"]
    assert abs(model.document("a. b. c")[0] - (1 - (1 - p[0]) ** 3)) < 1e-12
    assert model.document(None) == model.document("") == model.document(" .\n") == (0.0, [])


def test_training_finds_the_words():
    rng = random.Random(1)
    names, bags = [f"w{i}".encode() for i in range(20)], []
    for _ in range(400):
        sentences = [[rng.randrange(2, 20)] for _ in range(6)]
        toxic = rng.random() < 0.3
        if toxic:
            sentences[rng.randrange(6)].append(rng.randrange(2))
        bags.append((int(toxic), rng.randrange(5), sentences))
    model = toxicity._trained(bags, names)
    assert min(model.weights[b"w0"], model.weights[b"w1"]) > 3 + max(v for k, v in model.weights.items() if k not in (b"w0", b"w1"))
    assert model.bias < -3 and np.isfinite(list(model.weights.values())).all()


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = [r for r in toxicity.score(docs, model).join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    bad, good = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(bad) > 50 and sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted for r in got if r.offending)
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").selectExpr("doc_id", "quality", "1 - toxic AS toxic")
    rest = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    assert toxicity.fit(docs, rest.unionByName(held)) == model


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you are awful today" if i % 2 else "you are kind today", "x") for i in range(60)] + [(None, None, "x"), (7, "", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (3, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "offending"] and got.count() == 62
    assert {(r.text, r.predicted) for r in got.collect()} == {("you are awful today", 1), ("you are kind today", 0), (None, 0), ("", 0)}
    assert toxicity.fit(docs, labels.limit(0)).weights == {} and toxicity.fit(docs.limit(0), labels).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0
