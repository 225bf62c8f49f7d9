"""Toxicity by multiple-instance learning: labels are known for documents, offence sits in sentences.

A sentence's score is logistic in its words and word beginnings. A document is toxic unless every sentence is harmless, so
its score is the noisy-or of its sentences: 1 - product(1 - p). Trained on document labels alone, the model learns which
sentences are to blame, and names them.

With p = sigmoid(z), -log(1 - p) = softplus(z), so a document's score is 1 - exp(-S) with S the sum of softplus(z) over
its sentences; sentences without a known feature all add softplus(bias).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import packed, unpacked
from quarrylane.llm.language import held_out

ADDED = ("score", "predicted", "offending")
THRESHOLD = 0.3
#: Bound of the training sample: about so many labelled documents of each class, those with the smallest hashes.
SAMPLE = 5_000
#: Features kept: those whose presence tells most about the label, in at least MIN_DOCS documents of the sample.
FEATURES, MIN_DOCS = 1_024, 3
#: Letters of a word's beginning that count as a feature of their own.
STEM = 5
ROUNDS, RATE, DECAY, START_BIAS = 250, 0.15, 1e-3, -7.0
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")
_APART = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(sentence: str) -> set[bytes]:
    """Lower-case words of a sentence, and the beginnings of its longer ones."""
    words = set(sentence.lower().encode().translate(_APART).split())
    return words | {_stem(w) for w in words if len(w) > STEM}


def _stem(word: bytes) -> bytes:
    return word[:STEM] + b"*"


@dataclass(frozen=True)
class Model:
    """Weights by feature and the bias of every sentence."""

    weights: dict[bytes, float]
    bias: float

    def known(self, text: str) -> bool:
        """Whether any sentence has a feature with a weight."""
        words = set(text.lower().encode().translate(_APART).split())
        return not words.isdisjoint(self.weights) or any(len(w) > STEM and _stem(w) in self.weights for w in words)

    def document(self, text: str | None) -> tuple[float, list[dict]]:
        """Score of a document, and its sentences (start, end, score) whose own score reaches the threshold."""
        body = text or ""
        if not self.known(body):
            n = len(_SENTENCE.findall(body))
            return -float(np.expm1(-n * _softplus(self.bias))), []
        total, found = 0.0, []
        for m in _SENTENCE.finditer(body):
            z = self.bias + sum(self.weights.get(f, 0.0) for f in features(m.group()))
            total += float(_softplus(z))
            p = -float(np.expm1(-_softplus(z)))
            if p >= THRESHOLD:
                found.append({"start": m.start(), "end": m.end(), "score": p})
        return min(1.0, -float(np.expm1(-total))), found


def _softplus(z):
    return np.logaddexp(0.0, z)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int = SAMPLE) -> DataFrame:
    """``y`` and ``text`` of about ``size`` documents of each class that are not held out.

    A class's hash threshold follows from its number of labels; the sampled ids are bounded, so they are broadcast and no
    text is shuffled. A document with several labels counts as toxic if one of them says so.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    spread = 1 << 30
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.lit(0)
    for y, count in n.items():
        below = F.when(F.col("y") == y, min(spread, -(-size * spread // count))).otherwise(below)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(spread)) < below)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "id").select("y", F.coalesce("text", F.lit("")).alias("text"))


def _telling(sample: DataFrame) -> list[bytes]:
    """The features whose presence in a document tells most about its label, by the likelihood ratio."""
    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = list(features(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([y] * len(own), pa.int32())], names=["feature", "y"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = float(n.get(1, 0)), float(n.get(0, 0))
    counts = (sample.select("y", "text").mapInArrow(presence, "feature binary, y int").groupBy("feature")
              .agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q")).where(F.col("p") + F.col("q") >= MIN_DOCS))
    share = (F.col("p") + F.col("q")) / (a + b)

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    gain = part(F.col("p"), share * a) + part(F.col("q"), share * b) + part(a - F.col("p"), (1 - share) * a) + part(b - F.col("q"), (1 - share) * b)
    return [bytes(r["feature"]) for r in counts.orderBy(gain.desc(), "feature").limit(FEATURES).collect()]


def _bags(sample: DataFrame, names: list[bytes]) -> list[tuple[int, int, list[list[int]]]]:
    """Per sampled document its label, its number of sentences without a known feature, and the known features of the others."""
    place = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, lists = [], []
            for text in batch.column(1):
                bags = [sorted(place[f] for f in features(s) if f in place) for s in _SENTENCE.findall(text.as_py())]
                plain.append(sum(not x for x in bags))
                lists.append([x for x in bags if x])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.int32()), pa.array(lists, pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "bags"])

    rows = sample.select("y", "text").mapInArrow(run, "y int, plain int, bags array<array<int>>").collect()
    return sorted((r["y"], r["plain"], [list(x) for x in r["bags"]]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a bounded sample of labelled documents. Without both classes every document scores near 0."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    names = _telling(sample)
    bags = _bags(sample, names)
    if len({y for y, _, _ in bags}) < 2:
        return Model({}, START_BIAS)
    return _trained(bags, names)


def _trained(bags: list[tuple[int, int, list[list[int]]]], names: list[bytes]) -> Model:
    """Adam on the negative log likelihood of the noisy-or."""
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    owner = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sentences = [s for b in bags for s in b[2]]
    row = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    column = np.array([f for s in sentences for f in s], dtype=np.int64)
    theta = np.zeros(len(names) + 1)
    theta[-1] = START_BIAS
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        w, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(row, w[column], minlength=len(sentences))
        total = np.bincount(owner, _softplus(z), minlength=len(bags)) + plain * _softplus(bias)
        # d loss / d total: 1 for a harmless document, -1 / (exp(total) - 1) for a toxic one.
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(bags)
        slope = pull[owner] / (1 + np.exp(-z))
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(column, slope[row], minlength=len(names)) + DECAY * w / len(names)
        grad[-1] = slope.sum() + (pull * plain).sum() / (1 + np.exp(-bias))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        theta = theta - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Model({f: float(v) for f, v in zip(names, theta) if abs(v) > 1e-3}, float(theta[-1]))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every input row with ``score``, ``predicted`` (1 where the score reaches the threshold) and ``offending`` sentences.

    Offending sentences are spans in characters with their own score. Null and empty texts score 0 and have none. An empty
    table gives an empty result. Input columns named like an added one are replaced by it.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("struct<score:double,offending:array<struct<start:int,end:int,score:double>>>")
    def judged(texts: pa.Array) -> pa.Array:
        rows = [model.document(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], span)], ["score", "offending"])

    rows = df.select(packed(df), judged.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("found"))
    out = rows.select("row", "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.offending")
    return unpacked(out, df.columns, ADDED)
