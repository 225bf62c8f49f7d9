"""The manifest against a tree built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylane.llm import merkle

ROWS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, at string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def climb(nodes):
    """The levels of a tree of two."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at & ~1:at], level[at + 1:(at | 1) + 1]))
        at >>= 1
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf for *_, leaf, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for at, (*_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], at) + way(top, t)
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf((*r[:4], None if r[4] is None else r[4] + 1)) if touched else leaf
            for lo, hi in path:
                node = sha(*lo, node, *hi)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(*[x for lo, hi in path for x in lo + hi]), node, node == top[-1][0]))
    return out


def documents(count, rng):
    rows = [(rng.randrange(4 * count), rng.choice(["", "é", "text " * 30]) + str(i), rng.choice(["en", "en", "en", "de", "é", None, ""]), rng.choice([None, "s1"]), rng.choice([None, i])) for i in range(count)]
    rows += [(3, "twice", "en", "s", 5), (3, "twice", "en", "s", 5), (None, None, None, None, None), (None, "no id", "en", None, 1), (7, "x" * 500_000, "alone", "s", 500_000)]
    return rows


@pytest.mark.parametrize("count, depth, partitions", [(60, 2, 3), (150, 1, 9), (90, 10, 4)])
def test_manifest(spark, count, depth, partitions):
    rows = documents(count, random.Random(count))
    df = spark.createDataFrame([(*r, k, "own") for k, r in enumerate(rows)], ROWS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
        got = merkle.manifest(df, tampered=touched, given={"n_chars": F.col("n_chars") + 1}, depth=depth)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        got = sorted(map(str, map(tuple, got.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(rows)
    assert got == sorted(map(str, want))
    assert 0 < sum(not w[-1] for w in want) < len(want)


@pytest.mark.parametrize("rows", [[(5, "one", "en", "s", 3)], [(5, None, None, None, None), (6, "b", None, None, 1)]])
def test_small(spark, rows):
    df = spark.createDataFrame([(*r, 0, "") for r in rows], ROWS)
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(map(str, [g[:5] for g in got])) == sorted(map(str, [w[:5] for w in plain(rows)])) and all(g[-1] for g in got)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], ROWS)).count() == 0
