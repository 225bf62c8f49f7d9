"""Exact and near dedup against brute force."""

import hashlib
import os
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F
from test_ngram_join import plain_components as all_pairs

from quarrylane.llm import common, exact_dedup, ngram_join, simhash

ROWS = "doc_id long, text string, kept string"


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (5, "one  two"), (6, "one\ttwo"), (7, "ONE two"), (None, "lost")]
    base = [rng.choice(words) for _ in range(400)]
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(400)] = rng.choice(words)
        out.append((100 + i, " ".join(own)))
    out += [(200 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(40)]
    out += [(300 + i, "copy of one text") for i in range(80)] + [(400, "x " * 60_000)]
    rng.shuffle(out)
    return [(a, b, f"mine{i}") for i, (a, b) in enumerate(out)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    roots = list(range(len(prints)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                roots[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("partitions", [2, 24])
def test_exact(spark, partitions):
    rows = texts()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = exact_dedup.mark_exact(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(ids, default=None), len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest())
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact(spark.createDataFrame(rows, ROWS))
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == len(groups)


@pytest.mark.parametrize("partitions", [4, 24])
def test_drop_exact_keeps_the_smallest_ids(spark, partitions):
    """The salted copies of a text keep one row whatever columns each step reads."""
    rows = [r for r in texts() if r[0] is not None]
    first = {}
    for i, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        first[norm] = min(first.get(norm, i), i)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        kept = exact_dedup.drop_exact(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


def test_normalised_white_space(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab \t\n\v\f\r\x1f\x85\xa0\u2003") for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(400, None), (401, "\r\n a\r\nb"), (402, " \n"), (403, "a\nb\nc "), (404, "\n")]
    got = spark.createDataFrame(rows, "i long, text string").select("i", exact_dedup.normalised(F.col("text")).alias("norm")).collect()
    assert {r.i: r.norm for r in got} == {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}


def test_exact_normalises_once(spark, tmp_path):
    """The input is read by one step; what follows reads the normalised text, which no step normalises again."""
    spark.createDataFrame(texts(), ROWS).write.parquet(path := f"{tmp_path}/docs.parquet")
    out = exact_dedup.mark_exact(spark.read.parquet(path), columns=["doc_id"])
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.inputFiles() and not [f for f in out.inputFiles() if "docs.parquet" in f]
    assert "regexp_replace" not in out._jdf.queryExecution().toString().lower()
    whole = exact_dedup.mark_exact(spark.read.parquet(path))
    assert sorted(map(str, out.drop("kept").collect())) == sorted(map(str, whole.select(out.drop("kept").columns).collect()))


def test_fingerprints_by_hand():
    for _, text, _ in texts():
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_near(spark):
    rows = texts()
    got = simhash.near_components(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    comp = plain_components(prints)
    least = {}
    for c, (i, _, _) in zip(comp, rows):
        least.setdefault(c, []).append(i)
    want = [(i, f"{p:016x}", min((x for x in least[c] if x is not None), default=None)) for (i, _, _), p, c in zip(rows, prints, comp)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_drop_near(spark):
    """Five words, similarity 0.8, over all pairs; the smallest id of each group stays, and one text without words."""
    rows = [r for r in texts() if r[0] is not None]
    kept = simhash.drop_near(spark.createDataFrame(rows, ROWS))
    assert kept.columns == ["doc_id", "text", "kept"]
    comp = all_pairs([r[:2] for r in rows], 5, 80)
    want = {c for _, n, c in comp if n} | {min(i for i, n, _ in comp if not n)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_drop_near_takes_simhash_first(spark, monkeypatch):
    """Sets with a similar one within 3 bits follow it and have no vote; the join links the others."""
    rows = [r for r in texts() if r[0] is not None]
    seen = {}

    def near_sets(sets, plain=simhash.near_sets):
        seen["sets"], seen["near"] = {r.cid: r for r in sets.collect()}, plain(sets)
        return seen["near"]

    def stars(lists, marks, sets, percent, plain=ngram_join.stars):
        seen["voters"] = {r.cid for r in lists.collect()}
        return plain(lists, marks, sets, percent)

    monkeypatch.setattr(simhash, "near_sets", near_sets)
    monkeypatch.setattr(ngram_join, "stars", stars)
    simhash.drop_near(spark.createDataFrame(rows, ROWS)).count()
    near, text = [tuple(r) for r in seen["near"].collect()], {r[0]: r[1] for r in rows}
    assert len(near) > 20 and len({x for x, _ in near}) == len(near)
    prints = {c: plain_fingerprint(text[r.id]) for c, r in seen["sets"].items()}
    assert all((prints[x] ^ prints[y]).bit_count() <= 3 for x, y in near)
    led = {x for x, y in near if len({c for _, _, c in all_pairs([(c, text[seen["sets"][c].id]) for c in (x, y)], 5, 80)}) == 1}
    assert len(led) > 20 and seen["voters"] and not led & seen["voters"]


@pytest.mark.parametrize("named", ["nobody", "anybody"])
def test_drop_near_is_whole_whatever_simhash_finds(spark, monkeypatch, named):
    """SimHash names one neighbour of a set; if it names none, or one that is not similar, the exact join links all the same."""
    rows = [r for r in texts() if r[0] is not None]

    def near_sets(sets):
        pairs = sets.select(F.col("cid").alias("x")).crossJoin(sets.agg(F.max("cid").alias("y"))).where("x != y")
        return pairs.limit(0) if named == "nobody" else pairs

    monkeypatch.setattr(simhash, "near_sets", near_sets)
    kept = simhash.drop_near(spark.createDataFrame(rows, ROWS))
    comp = all_pairs([r[:2] for r in rows], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in comp if n} | {min(i for i, n, _ in comp if not n)})


def test_drop_near_gives_its_disk_back(spark, monkeypatch, tmp_path):
    """No table of its own and no shuffle file is left when it returns, whenever the driver collects its garbage; what it returns can run twice."""
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    rows, setting = [r for r in texts() if r[0] is not None], spark.conf.get(key := "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    made, most = [], [0]

    def folder(_, name):
        most[0] = max(most[0], len(os.listdir(tmp_path)))
        made.append(name)
        return f"file://{tmp_path}/{len(made)}-{name}"

    monkeypatch.setattr(common, "shared_folder", folder)
    df, before = spark.createDataFrame(rows, ROWS).repartition(3), shuffles()
    kept = simhash.drop_near(df)
    assert len(made) > 8 and not os.listdir(tmp_path) and most[0] < len(made) - 3
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)  # executors delete them in their own time
    assert not left
    assert spark.conf.get(key, None) == setting
    first, again = (sorted(r.doc_id for r in kept.collect()) for _ in range(2))
    assert first == again and len(first) > 40


def test_links_of_every_kind(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = rng.choice([b, rng.choice(sorted(prints))])
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << bit
            prints.add(x)
        lane = 16 * rng.randrange(4)
        prints.add(b ^ sum(1 << lane + k for k in rng.sample(range(16), 3)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    for a, b in edges.collect():
        assert ((a ^ b) % (1 << 64)).bit_count() <= 3
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    comp = plain_components(prints)
    groups, want = {}, {}
    for s, c in zip(signed, comp):
        groups.setdefault(c, []).append(s)
    for members in groups.values():
        want |= {m: min(members) for m in members}
    assert {s: found.get(s, s) for s in signed} == want


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    for fn in (exact_dedup.mark_exact, exact_dedup.drop_exact, simhash.near_components, simhash.drop_near):
        assert fn(none).count() == 0
