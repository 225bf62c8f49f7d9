"""N-gram Jaccard self-join by set relations, exact: every two texts whose shingle sets are similar enough end up connected.

Sets are joined by their prefixes in one global order: a similar pair shares one of the first ``n - ceil(s * n) + 1`` shingles
of both. The order puts the shingles of small hash first (a fixed share of all), those by how many sets have them, and the
others by hash. Shingles of one set alone need no row, so a text without near copies leaves the join before any list is built.

Two relations between sets save work, and neither loses a link:

* *Index lists by position.* A list is cut into blocks of equal size in order of position. Two blocks meet only up to the
  positions after which too few shingles remain, so the rest of a block is skipped unread.
* *Answers from similar sets.* Each set is first held against one leader, the best connected by sketches of its lists. A verified member
  is kept as its difference from the leader. Leaders are then compared once; a member's answers follow from its leader's by
  the triangle inequality of the Jaccard distance, and what that leaves open is computed from the differences alone:
  ``|x & z| = |x & M| - |x & (M - z)| + |x & (z - M)|``.

Before two sets are compared, their parity sketches are: bit b says whether an odd number of shingles hash to b, so two sketches
differ in no more bits than the sets differ in shingles. Sets that share a passage but not most of their text end here.

Only connected components are asked for, so pairs that are connected already are never compared, and equal sets are one set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import freed, join_counted, partition_count, saved, short_shuffles, written
from quarrylane.llm.graph import components

WORDS, PERCENT = 3, 90
SEED = 42
#: Members of one block of a list, or of one leader; longer ones are dealt out as pairs of blocks.
BLOCK = 1024
#: Words of 64 bits of a set's parity sketch.
SKETCH = 16
#: Lists of up to so many rows are paired together; longer ones block by block.
SHORT = 64
_CHUNK = 1 << 17
_SLACK = 1e-9


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every distinct word shingle, sorted; a text of fewer words is one shingle, one without words has none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    parts = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*[found[i:] for i in range(words)])))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def prefix_length(n, percent: int):
    """How many first shingles of a set of ``n`` must hold one of any similar set's; numbers or a column."""
    whole = n * percent + 99
    return n - (F.floor(whole / 100) if isinstance(n, Column) else whole // 100) + 1


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 x SKETCH cells, as bits."""
    cells = np.bincount((hashes >> np.uint64(8)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64)


def _need(a, b, percent: int):
    """Smallest intersection of similar sets of sizes ``a`` and ``b``: 100 i >= percent (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def counted_share(percent: int) -> float:
    """Share of all shingles, by hash, that are counted and come first in the order; well over the prefix's own share."""
    return min(1.0, 1.6 * (100 - percent) / 100)


def with_sets(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, fingerprint: Callable[[str | None], int] | None = None) -> DataFrame:
    """One row per input row: ``id``, ``id_hash`` and ``text_hash`` (which name it without its text), ``n`` (set size), ``digest``
    (16 bytes, null for an empty set), ``counted`` (shingles of small hash), ``rest`` (the next ones, where those are fewer than the prefix) and ``bits`` (the sketch); ``fp`` where a ``fingerprint`` of the text is asked."""
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    slim = slim.select("id", F.xxhash64("id").alias("id_hash"), F.xxhash64("text").alias("text_hash"), "text")
    below = np.uint64(min((1 << 64) - 1, int(counted_share(percent) * (1 << 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "id_hash", "text_hash", "n", "digest", "counted", "rest", "bits"] + ["fp"] * bool(fingerprint)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sizes, digests, counted, rest, bits = [], [], [], [], []
                for t in batch.column(3):
                    hashes = shingle_set(t.as_py(), words)
                    n, cut = len(hashes), int(np.searchsorted(hashes, below))
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if n else None)
                    counted.append(hashes[:cut].view(np.int64))
                    rest.append(hashes[cut:max(cut, prefix_length(n, percent))].view(np.int64) if n else hashes.view(np.int64))
                    bits.append(sketch(hashes))
                many = pa.list_(pa.int64())
                more = [pa.array((fingerprint(t.as_py()) for t in batch.column(3)), pa.int64(), size=len(batch))] if fingerprint else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                                  pa.array(counted, many), pa.array(rest, many), pa.array(bits, many), *more], names=names)

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, id_hash long, text_hash long, n long, digest binary, counted array<long>, rest array<long>, bits array<long>" + ", fp long" * bool(fingerprint))


def distinct_sets(marked: DataFrame) -> DataFrame:
    """One row per distinct set that is not empty: ``cid``, ``digest``, ``id`` (smallest), ``owner`` (a row that has it), ``docs``, ``n``, ``counted``, ``rest``, ``bits``; ``fp``, if any, is the smallest of its rows."""
    fp = [F.min("fp").alias("fp")] if "fp" in marked.columns else []
    each = marked.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.min(F.struct("text_hash", "id_hash")).alias("owner"), F.count(F.lit(1)).alias("docs"),
        F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("rest").alias("rest"), F.first("bits").alias("bits"), *fp)
    return written(each.withColumn("cid", F.monotonically_increasing_id()), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``token``, ``cid``, ``n`` and ``pos``: the prefix of every set, without the shingles that no other set counts."""
    rows = sets.select("cid", F.explode("counted").alias("token"))
    seen = saved(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("w", F.col("df")))
    own = join_counted(rows, seen, "token", "w").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    d = sets.select("cid", "n", F.size("counted").alias("c"), "rest").join(own, "cid", "left")
    d = d.select("cid", "n", "c", "rest", F.coalesce(F.col("own.token"), F.array().cast("array<bigint>")).alias("own"))
    # Shingles of one set alone come first and take places of the prefix.
    d = d.withColumn("alone", F.col("c") - F.size("own")).withColumn("k", prefix_length(F.col("n"), percent).cast("int"))
    d = d.where("k > alone").withColumn("k", F.col("k") - F.col("alone"))
    first = F.transform(F.slice("own", 1, F.col("k")), lambda t, i: F.struct(t.alias("token"), (F.col("alone") + i).alias("pos")))
    more = F.transform(F.slice("rest", 1, F.greatest(F.lit(0), F.col("k") - F.size("own"))),
                       lambda t, i: F.struct(t.alias("token"), (F.col("c") + i).alias("pos")))
    return d.select("cid", "n", F.explode(F.concat(first, more)).alias("t")).select("t.token", "cid", "n", F.col("t.pos").cast("long").alias("pos"))


def index_lists(found: DataFrame) -> DataFrame:
    """The prefixes' lists of two sets or more: ``token``, ``cid``, ``n``, ``pos`` and ``size``."""
    found = written(found, "prefixes")
    size = saved(found.groupBy("token").agg(F.count(F.lit(1)).alias("w")).where("w > 1").withColumn("size", F.col("w")))
    lists = written(join_counted(found, size, "token", "w"), "lists")
    freed(found)
    return lists


def full_sets(df: DataFrame, id_col: str, text_col: str, sets: DataFrame, lists: DataFrame, words: int) -> DataFrame:
    """``cid``, ``n`` and ``hashes`` of the sets that are in a list; one row of each is read again."""
    need = sets.select("cid", "owner.text_hash", "owner.id_hash").join(lists.select("cid").distinct(), "cid", "left_semi")
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("id_hash"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.join(need, ["id_hash", "text_hash"]).groupBy("cid").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                                 names=["cid", "n", "hashes"])

    return written(rows.mapInArrow(run, "cid long, n long, hashes array<long>"), "shingles")


def with_pair(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs ``x``, ``y`` with both sizes and sets (``n``, ``mine``, ``m``, ``theirs``); one set may be in very many pairs."""
    def one(d: DataFrame, name: str, size: str, hashes: str) -> DataFrame:
        # Only the counts are kept; the sets are read from their table again, not written once more.
        uses = saved(pairs.groupBy(name).agg(F.count(F.lit(1)).alias("w")).join(sets.select("cid"), F.col(name) == F.col("cid")).select(name, "w"))
        side = uses.join(sets, F.col(name) == sets.cid).select(name, F.col("n").alias(size), F.col("hashes").alias(hashes), "w")
        return join_counted(d, side, name, "w")

    return one(one(pairs, "x", "n", "mine"), "y", "m", "theirs")


def _similar(percent: int) -> Column:
    return F.col("i") * (100 + percent) >= percent * (F.col("n") + F.col("m"))


def stars(lists: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links ``x``, ``y`` to a leader, with the difference of x from y (``adds``, ``drops``), ``n`` and the distance.

    In every list a set turns to the neighbour with the most neighbours; the leader is the one most of its lists name.
    """
    own = marks.select("cid", F.col("cid").alias("pivot"), F.col("cid").alias("root"), "bits")
    votes = paired(lists, own, percent, True).groupBy("x", "y").agg(F.count(F.lit(1)).alias("v"))
    return followers(saved(votes.groupBy("x").agg(F.min_by("y", F.struct(-F.col("v"), "y")).alias("y"))), sets, percent)


def followers(best: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``x``, ``y`` (one per ``x``) that are similar, with the difference of x from y, ``n`` and the distance."""
    d = with_pair(best, sets).withColumn("i", F.size(F.array_intersect("mine", "theirs")))
    d = d.where(_similar(percent)).select(
        "x", "y", "n", F.array_except("mine", "theirs").alias("adds"), F.array_except("theirs", "mine").alias("drops"),
        (1 - F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).alias("dist"))
    return written(d, "stars")


def _near(i: np.ndarray, j: np.ndarray, rows: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Those row pairs (2 x k) that are not connected and whose sketches leave them similar."""
    n, _, _, root, side = rows
    keep = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2))
    i, j, found = i[keep], j[keep], []
    for at in range(0, len(i), _CHUNK):
        p, q = i[at:at + _CHUNK], j[at:at + _CHUNK]
        most = n[p] + n[q] - 2 * _need(n[p], n[q], percent)
        hit = np.bitwise_count((bits[p] ^ bits[q]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
        found.append(np.stack([p[hit], q[hit]]))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)


def _pivots(pairs: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """The distinct pivots of row pairs, the smaller first."""
    return np.unique(np.sort(pivot[pairs], axis=0), axis=1)


def _leaders(pairs: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """For every row with neighbours that is not the best connected of them, itself and that one; the smaller set wins a tie."""
    degree = np.bincount(pairs.ravel(), minlength=len(pivot))
    row, other = np.concatenate([pairs, pairs[::-1]], axis=1)
    order = np.lexsort((pivot[other], -degree[other], row))
    row, other = row[order], other[order]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, dtype=bool)
    row, other = row[first], other[first]
    up = (degree[other] > degree[row]) | ((degree[other] == degree[row]) & (pivot[other] < pivot[row]))
    return np.stack([pivot[row[up]], pivot[other[up]]])


def block_pairs(rows: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Row pairs of one long list (rows ``n``, ``pos``, ``pivot``, ``root``, ``side``) whose sets can be similar and are not connected.

    ``side`` tells two blocks apart (0 and 1: only pairs between them; all 2: pairs within one block).
    """
    order = np.lexsort((rows[1], rows[0]))
    rows, bits = rows[:, order], bits[order]
    n, pos = rows[0], rows[1]
    start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    end, found = np.r_[start[1:], len(n)], []
    for a in range(len(start)):
        size = int(n[start[a]])
        for b in range(a, len(start)):
            other = int(n[start[b]])
            if 100 * size < percent * other:
                break
            need = _need(size, other, percent)
            # Positions ascend within a block; what lies beyond is skipped.
            i = np.arange(start[a], start[a] + np.searchsorted(pos[start[a]:end[a]], size - need, "right"))
            j = np.arange(start[b], start[b] + np.searchsorted(pos[start[b]:end[b]], other - need, "right"))
            for at in range(0, len(i) if len(j) else 0, 256):
                u, v = (x.ravel() for x in np.meshgrid(i[at:at + 256], j, indexing="ij"))
                once = u < v if a == b else slice(None)
                found.append(_near(u[once], v[once], rows, bits, percent))
    return order[np.concatenate(found, axis=1)] if found else np.empty((2, 0), dtype=np.int64)


def short_pairs(start: np.ndarray, end: np.ndarray, rows: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """As ``block_pairs`` for many short lists at once, each from ``start`` to ``end``."""
    after = np.concatenate([np.arange(b - a - 1, -1, -1) for a, b in zip(start, end)])
    first = np.concatenate([np.arange(a, b) for a, b in zip(start, end)])
    i = np.repeat(first, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    n, rest = rows[0], rows[0] - rows[1]
    keep = np.minimum(rest[i], rest[j]) >= _need(n[i], n[j], percent)
    keep &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    return _near(i[keep], j[keep], rows, bits, percent)


def list_pairs(key: np.ndarray, rows: np.ndarray, bits: np.ndarray, percent: int, lead: bool = False) -> np.ndarray:
    """Distinct pivot pairs of whole lists, sorted by key; with ``lead`` one row's own pair at most (see ``_leaders``)."""
    start = _runs(key)
    end = np.r_[start[1:], key.shape[1]]
    size = end - start
    found = [a + block_pairs(rows[:, a:b], bits[a:b], percent) for a, b in zip(start[size > SHORT], end[size > SHORT])]
    few = (size > 1) & (size <= SHORT)
    start, end = start[few], end[few]
    # As many short lists at a time as make about a chunk of pairs.
    part = np.cumsum((end - start) ** 2) // (8 * _CHUNK)
    for k in np.unique(part):
        found.append(short_pairs(start[part == k], end[part == k], rows, bits, percent))
    if not found:
        return np.empty((2, 0), dtype=np.int64)
    return (_leaders if lead else _pivots)(np.concatenate(found, axis=1), rows[2])


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])


def open_pairs(lists: DataFrame, members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Distinct pivots ``x`` < ``y`` whose sets, or sets that are kept as differences from them, share a list, can be similar and are not connected."""
    known = members.join(marks.select("cid", "bits"), "cid").select("cid", "pivot", "root", "bits")
    mixed = lists.select("token", "cid").join(members.select("cid", "root"), "cid").groupBy("token").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("w")).where("a != b").select("token", "w")
    return paired(join_counted(lists, saved(mixed), "token", "w"), known, percent, False).distinct()


def paired(lists: DataFrame, known: DataFrame, percent: int, lead: bool) -> DataFrame:
    """``list_pairs`` of all lists, whose sets have ``pivot``, ``root`` and ``bits`` in ``known``; repeats included."""
    d = lists.join(known, "cid")
    # A long list is dealt out as pairs of blocks, each a group of at most about two blocks.
    d = d.withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    d = d.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "n", "pos", "pivot", "root",
                 F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "bits")
    d = d.select(*[F.col(c).cast("long") for c in ("token", "i", "j", "n", "pos", "pivot", "root", "side")], "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = np.empty((2, 0), dtype=np.int64)

        def more(parts: list[tuple[np.ndarray, np.ndarray]], seen: np.ndarray) -> np.ndarray:
            rows, bits = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
            both = np.concatenate([seen, list_pairs(rows[:3], rows[3:], bits, percent, lead)], axis=1)
            return both if lead else np.unique(both, axis=1)  # repeats are votes

        def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["x", "y"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns[:8]])
            bits = batch.column(8).flatten().to_numpy().reshape(-1, SKETCH)
            last = int(_runs(rows[:3])[-1])
            if last:
                seen = more([*held, (rows[:, :last], bits[:last])], seen)
                held = [(rows[:, last:], bits[last:])]
            elif held and (held[-1][0][:3, -1] != rows[:3, 0]).any():
                seen = more(held, seen)
                held = [(rows, bits)]
            else:
                held.append((rows, bits))
            if seen.shape[1] > 8 * _CHUNK:
                yield batch_of(seen)
                seen = seen[:, :0]
        yield batch_of(more(held, seen) if held else seen)

    parts = partition_count(d.sparkSession)
    return d.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "x long, y long")


def _inside(values: np.ndarray, owner: np.ndarray, many: int, held: np.ndarray) -> np.ndarray:
    """How many of each owner's values the sorted set holds."""
    if not len(values) or not len(held):
        return np.zeros(many, dtype=np.int64)
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return np.bincount(owner[held[at] == values], minlength=many)


def derived_link(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The first similar pair between members of two leaders, from the members' differences alone.

    Rows have ``side`` (0 and 1: members with ``cid``, ``n``, ``adds``, ``drops``; 2 and 3: the leaders' sets in ``adds``).
    """
    left, right = (group[group.side == s] for s in (0, 1))
    big = [np.sort(np.concatenate(list(group[group.side == s].adds) or [np.empty(0, np.int64)])) for s in (2, 3)]
    sizes, ids, many = right.n.to_numpy(), right.cid.to_numpy(), len(right)

    def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        lengths = column.map(len).to_numpy()
        return np.concatenate([*column, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(many), lengths)

    adds, drops = flat(right.adds), flat(right.drops)
    extra = right.adds.map(len).to_numpy()
    shared = len(np.intersect1d(big[0], big[1], assume_unique=True))
    for row in left.itertuples():
        plus, minus = np.asarray(row.adds, dtype=np.int64), np.asarray(row.drops, dtype=np.int64)
        # |x & M| from |L & M|, then |x & z| from |x & M|.
        with_leader = shared - np.isin(minus, big[1]).sum() + np.isin(plus, big[1]).sum()
        need = _need(row.n, sizes, percent)
        if not (with_leader + extra >= need).any():
            continue
        own = np.sort(np.concatenate([np.setdiff1d(big[0], minus, assume_unique=True), plus]))
        overlap = with_leader - _inside(*drops, many, own) + _inside(*adds, many, own)
        hit = np.flatnonzero(overlap >= need)
        if len(hit):
            return pd.DataFrame({"x": [row.cid], "y": [ids[hit[0]]]})
    return pd.DataFrame({"x": [], "y": []}, dtype="int64")


def derived_links(open_: DataFrame, star: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``x``, ``y`` between members of the leaders ``x`` and ``y`` that are not similar themselves."""
    none = F.array().cast("array<bigint>")
    used = open_.select(F.col("x").alias("pivot")).union(open_.select(F.col("y").alias("pivot"))).distinct()
    near = members.where("pivot != cid").select("cid", "pivot").join(star, F.col("cid") == F.col("x"))
    lead = used.join(sets, F.col("pivot") == sets.cid)
    own = saved(near.select("pivot", "cid", "n", "adds", "drops").union(lead.select("pivot", "cid", "n", none, none))
                .join(used, "pivot", "left_semi"))
    blocks = saved(own.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")))
    p = open_.join(blocks.select(F.col("pivot").alias("x"), F.col("k").alias("kx")), "x").join(blocks.select(F.col("pivot").alias("y"), F.col("k").alias("ky")), "y")
    p = p.select("x", "y", F.explode(F.sequence(F.lit(0), F.col("kx") - 1)).alias("i"), "ky").select("x", "y", "i", F.explode(F.sequence(F.lit(0), F.col("ky") - 1)).alias("j"))
    p = saved(p)
    own = own.join(blocks, "pivot").withColumn("at", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))

    def side(which: str, at: str, tag: int) -> DataFrame:
        rows = own.select(F.col("pivot").alias(which), F.col("at").alias(at), "cid", "n", "adds", "drops")
        return p.join(rows, [which, at]).select("x", "y", "i", "j", F.lit(tag).alias("side"), "cid", "n", "adds", "drops")

    def whole(which: str, tag: int) -> DataFrame:
        rows = lead.select(F.col("pivot").alias(which), "cid", "n", "hashes")
        return p.join(rows, which).select("x", "y", "i", "j", F.lit(tag).alias("side"), "cid", "n", F.col("hashes").alias("adds"), none.alias("drops"))

    rows = side("x", "i", 0).unionByName(side("y", "j", 1)).unionByName(whole("x", 2)).unionByName(whole("y", 3))
    return rows.groupBy("x", "y", "i", "j").applyInPandas(lambda g: derived_link(g, percent), "x long, y long")


def set_links(df: DataFrame, id_col: str, text_col: str, sets: DataFrame, lists: DataFrame, words: int, percent: int, near: DataFrame | None = None) -> DataFrame:
    """Links ``a`` < ``b`` between distinct sets that connect every two similar ones; ``lists`` are those of their prefixes, and are freed.

    ``near`` may name a neighbour ``y`` of a set ``x`` that another method has found. Where the two are similar it is the
    leader, and ``x`` takes no part in the votes for one.
    """
    full = full_sets(df, id_col, text_col, sets, lists, words)
    if near is None:
        star = stars(lists, sets, full, percent)
        parts = [star]
    else:
        led = followers(near, full, percent)
        rest = index_lists(lists.drop("size").join(led.select(F.col("x").alias("cid")), "cid", "left_anti"))
        parts = [led, stars(rest, sets, full, percent)]
        star = led.union(parts[1])
        freed(rest)
    edges = star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # A set that leads others, or follows none, stands for itself; any other is a difference from its leader.
    leads = star.select(F.col("y").alias("lead")).distinct()
    node = lists.select("cid").distinct().join(star.select(F.col("x").alias("cid"), "y", "dist"), "cid", "left")
    node = node.join(leads, F.col("cid") == F.col("lead"), "left")
    alone = F.col("lead").isNotNull() | F.col("y").isNull()
    node = node.select("cid", F.when(alone, F.col("cid")).otherwise(F.col("y")).alias("pivot"), F.when(alone, 0.0).otherwise(F.col("dist")).alias("dist"))
    root = components(edges)
    members = written(node.join(root, node.cid == root.node, "left").select("cid", "pivot", "dist", F.coalesce("root", "cid").alias("root")), "pivots")
    pairs = written(open_pairs(lists, members, sets, percent), "pairs")
    freed(lists)
    held = with_pair(pairs, full).select("x", "y", "n", "m", F.size(F.array_intersect("mine", "theirs")).alias("i"))
    held = written(held.withColumn("similar", _similar(percent)), "held")
    reach = members.groupBy("pivot").agg(F.max("dist").alias("r"))
    far = held.where("NOT similar").join(reach.select(F.col("pivot").alias("x"), F.col("r").alias("rx")), "x").join(reach.select(F.col("pivot").alias("y"), F.col("r").alias("ry")), "y")
    gap = 1 - F.col("i") / (F.col("n") + F.col("m") - F.col("i"))
    far = far.where("rx + ry > 0").where(gap - F.col("rx") - F.col("ry") <= 1 - percent / 100 + _SLACK)
    more = held.where("similar").select("x", "y").union(derived_links(saved(far.select("x", "y")), star, members, full, percent))
    links = saved(edges.union(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    freed(full, members, pairs, held, *parts)
    return links


def set_components(df: DataFrame, id_col: str, text_col: str, marked: DataFrame, words: int, percent: int,
                   neighbours: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per distinct set that is not empty: ``digest``, ``root``, ``component_id`` (smallest id reachable) and ``docs`` (rows that have it).

    ``neighbours`` may give, for the distinct sets, what ``set_links`` takes as ``near``. Tables are freed as soon as the last
    step that reads them has ended, ``marked`` too.
    """
    whole = distinct_sets(marked)
    freed(marked)
    lists = index_lists(prefixes(whole, percent))
    # Shingles are most of a set's bytes, and only the prefixes read them.
    sets = written(whole.drop("counted", "rest"), "slim")
    freed(whole)
    near = neighbours(sets) if neighbours else None
    found = components(set_links(df, id_col, text_col, sets, lists, words, percent, near))
    slim = sets.select("cid", "digest", "id", "docs")
    rooted = saved(slim.join(found, slim.cid == found.node, "left").select("digest", "id", "docs", F.coalesce("root", "cid").alias("root")))
    least = saved(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("w")))
    freed(sets)
    return saved(join_counted(rooted, least, "root", "w").select("digest", "root", "component_id", "docs"))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (size of its set) and ``component_id``, the smallest id reachable by links.

    Two texts link where 100 x intersection >= ``percent`` x union of their sets of distinct word shingles. A text of fewer
    words than a shingle is one shingle. Null and empty texts and those without words have no set and are linked with nothing:
    their component is their own id. Null ids never become a component's id unless all of its ids are null. Rows that repeat
    an id or a text are rows of their own. Texts of any length are read whole. An empty table gives an empty result; other
    columns are not read.
    """
    with short_shuffles(df.sparkSession):
        marked = written(with_sets(df, id_col, text_col, words, percent), "marked")
        each = written(marked.select("id", "n", "digest"), "each")
        found = set_components(df, id_col, text_col, marked, words, percent)
    # From here on nothing is written: frames that may run more than once keep their shuffles.
    full = join_counted(each.where("n > 0"), found, "digest", "docs")
    out = full.select("id", "n", "component_id").union(each.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
