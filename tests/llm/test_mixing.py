"""Mixing against a plain walk along the hashes."""

import hashlib
import random
import re

from quarrylane.llm import mixing

ROWS = "doc_id long, text string, source string, size string"


def rows():
    rng = random.Random(2)
    out = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "a", "b", "Z", "é", None]), "mine") for i in range(400)]
    return [*out, (3, "again one two", "a", "x"), (3, "again one two", "a", "x"), (None, "no id", "tiny", "x"), (900, None, "empty", "x"), (901, "", None, "x"), (902, "w\t\n" * 9_000, "b", "x")]


def test_targets():
    t = mixing.source_targets({"b": 10, "a": 100, None: 1})
    assert abs(sum(t.values()) - 111) < 1e-9 and t[None] == 3.0 and t["b"] == 30.0 and t["a"] == 78.0
    assert mixing.source_targets({}) == {} and mixing.source_targets({"x": 0}) == {"x": 0.0}


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, ROWS).repartition(3)
    out = mixing.mark_mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == len(data)
    size = {s: 0 for _, _, s, _ in data}
    for _, t, s, _ in data:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = mixing.source_targets(size)
    for s in size:
        own = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(size[s], round(target[s], 6))}
        times = min(3, int(target[s] // size[s])) if size[s] else 0
        rest, upto, below = target[s] - times * size[s], 0, set()
        by = {}
        for r in own:
            h = int(hashlib.md5(b"" if r.doc_id is None else str(r.doc_id).encode()).hexdigest()[:15], 16)
            by.setdefault(h, []).append(r)
        for h in sorted(by):
            n = sum(r.size for r in by[h])
            if not (upto + n <= rest or (upto <= rest and upto + n - rest < rest - upto)):
                break
            below.add(h)
            upto += n
        for h, some in by.items():
            for r in some:
                assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
                assert r.taken == r.size * (times + (times < 3 and h in below))
    copies = mixing.mix(df)
    assert copies.columns == df.columns and copies.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mark_mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_boundary_rounds(spark, monkeypatch):
    df = spark.createDataFrame(rows(), ROWS)
    want = {(r.doc_id, r.text): r.taken for r in mixing.mark_mix(df).collect()}
    monkeypatch.setattr(mixing, "ROUND_BITS", 3)
    assert {(r.doc_id, r.text): r.taken for r in mixing.mark_mix(df).collect()} == want
