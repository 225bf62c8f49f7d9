"""SimHash near-dedup by ball hashing that meets in the middle.

Fingerprints link at 3 or fewer differing bits. Half that radius is one bit and a half: every distinct fingerprint emits
all variants within one bit, and the odd bit is left to a wildcard block. For each of the four 16-bit blocks in turn that
block is taken out and the other 48 bits emit their 49 variants, so a fingerprint emits 196 rows instead of the 2,081 of
a full ball of two bits. Two fingerprints with the same variant and

* an equal block differ in at most 2 bits (finds every pair with 1 or 2 bits: some block is untouched);
* blocks one bit apart differ in at most 3 bits (finds every pair with 3 bits in two or three blocks: one block has
  exactly one of them, the other two meet half way);
* blocks three bits apart, and the 48 bits equal to the variant itself, differ in exactly 3 bits (all in one block).

No bucket is expanded into pairs. Members with an equal block form a star around their smallest fingerprint, and blocks
are matched by flipping their bits, so the links are linear in the emitted rows and keep every connected set connected.
A bucket holds distinct fingerprints only, at most 49 x 65,536 of them however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import ngram_join
from quarrylane.llm.common import freed, join_counted, packed, partition_count, saved, short_shuffles, unpacked, written
from quarrylane.llm.graph import components

RADIUS = 3
WORDS = 3
#: Near copies: words of a shingle and hundredths of Jaccard similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80
SEED = 42
ADDED = ("fingerprint", "component_id")
_BLOCK = 16
_BODY = 64 - _BLOCK
_CHUNK = 1 << 16


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; empty where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(WORDS)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash: a bit is set where over half of the shingle hashes have it; zero without words."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    bits = (2 * _bit_totals(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``id``, ``id_hash`` and ``text_hash`` (which name the document without its text), ``fp``."""
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    slim = slim.select("id", F.xxhash64("id").alias("id_hash"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            fps = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), fps], names=["id", "id_hash", "text_hash", "fp"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, id_hash long, text_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """``key`` (wildcard block and 48-bit variant) and ``fp``: 196 rows per distinct fingerprint."""
    out = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block"))
    out = out.select("fp", "block", F.expr(
        "CASE block WHEN 0 THEN shiftrightunsigned(fp, 16)"
        " WHEN 1 THEN shiftleft(shiftrightunsigned(fp, 32), 16) | (fp & 65535L)"
        " WHEN 2 THEN shiftleft(shiftrightunsigned(fp, 48), 32) | (fp & 4294967295L)"
        " ELSE fp & 281474976710655L END").alias("body"))
    out = out.select("fp", "block", "body", F.explode(F.sequence(F.lit(-1), F.lit(_BODY - 1))).alias("bit"))
    flipped = F.expr("CASE WHEN bit < 0 THEN body ELSE body ^ shiftleft(1L, bit) END")
    return out.select((F.shiftleft(F.col("block").cast("long"), _BODY).bitwiseOR(flipped)).alias("key"), "fp")


_THREE = np.array([(1 << a) | (1 << b) | (1 << c) for a, b, c in combinations(range(_BLOCK), 3)], dtype=np.int64)
_ONE = np.array([1 << a for a in range(_BLOCK)], dtype=np.int64)


def _split(fp: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wildcard block and the other 48 bits."""
    u, low = fp.view(np.uint64), (block * _BLOCK).astype(np.uint64)
    inner = (u >> low) & np.uint64(0xFFFF)
    under = u & ((np.uint64(1) << low) - np.uint64(1))
    above = np.where(block == 3, np.uint64(0), u >> np.minimum(low + np.uint64(_BLOCK), np.uint64(63)))
    return inner.astype(np.int64), ((above << low) | under).astype(np.int64)


def _matched(place: np.ndarray, inner: np.ndarray, fp: np.ndarray, flips: np.ndarray) -> list[np.ndarray]:
    """Pairs at the same place whose inner blocks differ by a flip; (place, inner) is sorted and unique."""
    code, found = place * 65536 + inner, []
    for flip in flips:
        other = inner ^ flip
        want = place * 65536 + other
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        hit = (code[at] == want) & (other > inner)
        if hit.any():
            found.append(np.stack([fp[hit], fp[at[hit]]]))
    return found


def bucket_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (2 x n) of whole buckets, sorted by key."""
    if not len(key):
        return np.empty((2, 0), dtype=np.int64)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    many = np.repeat(size > 1, size)
    place, key, fp = np.repeat(np.arange(len(start)), size)[many], key[many], fp[many]
    if not len(key):
        return np.empty((2, 0), dtype=np.int64)
    inner, body = _split(fp, key >> _BODY)
    order = np.lexsort((fp, inner, place))
    place, inner, fp, exact = place[order], inner[order], fp[order], (body == (key & ((1 << _BODY) - 1)))[order]
    head = np.r_[True, (place[1:] != place[:-1]) | (inner[1:] != inner[:-1])]
    star = fp[np.maximum.accumulate(np.where(head, np.arange(len(fp)), 0))]
    found = [np.stack([star, fp])[:, ~head], *_matched(place[head], inner[head], fp[head], _ONE)]
    if exact.sum() > 1:
        found += _matched(place[exact], inner[exact], fp[exact], _THREE)
    links = np.concatenate(found, axis=1)
    links = links[:, np.bitwise_count((links[0] ^ links[1]).view(np.uint64)) <= RADIUS]
    return np.unique(np.sort(links, axis=0), axis=1)


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; the last bucket waits until its end is seen."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = bucket_links(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield out([*held, (key[:last], fp[:last])])
            held = [(key[last:], fp[last:])]
        elif held and held[-1][0][-1] != key[0]:
            yield out(held)
            held = [(key, fp)]
        else:
            held.append((key, fp))
    if held:
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``a`` < ``b`` that connect all distinct fingerprints within the radius of each other."""
    parts = partition_count(fps.sparkSession)
    # Fingerprints are small, so few partitions hold them; they are dealt out before each becomes 196 rows.
    spread = variants(fps.select("fp").repartition(parts, "fp")).repartition(parts, "key").sortWithinPartitions("key")
    return spread.mapInArrow(_links_of, "a long, b long").distinct()


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes (``fp``, ``id``, ``n``) with ``root`` and ``component_id``, the smallest id of their component."""
    rooted = saved(nodes.join(found, nodes.fp == found.node, "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root")))
    least = saved(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("w")))
    return saved(join_counted(rooted, least, "root", "w").select("fp", "root", "component_id", "n"))


def fingerprint_components(marked: DataFrame) -> DataFrame:
    """One row per distinct fingerprint: ``fp``, ``root`` (smallest fingerprint reachable), ``component_id`` (smallest id), ``n`` (rows)."""
    nodes = saved(marked.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    return _rooted(nodes, components(links(nodes)))


def _hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts have fingerprint zero and link like any other. Null ids never become a component's id unless all
    of its ids are null. An empty table gives an empty result.
    """
    marked = written(with_fingerprints(df, id_col, text_col), "fingerprints")
    out = join_counted(marked.select("id", "fp"), fingerprint_components(marked), "fp", "n")
    return out.select(F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id")


def near_sets(sets: DataFrame) -> DataFrame:
    """Of the distinct sets (``cid``, ``fp``) each ``x`` that has one within the radius: another, ``y``. At most one row per set.

    Sets of one fingerprint name the first of them, and that names the first set of the smallest fingerprint it links with.
    """
    slim = sets.select("cid", "fp")
    heads = saved(slim.groupBy("fp").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")))
    same = join_counted(slim, heads, "fp", "n").where("cid != head").select(F.col("cid").alias("x"), F.col("head").alias("y"))
    # The links' first is the smaller one, so no two fingerprints name each other.
    least = links(heads).groupBy("b").agg(F.min("a").alias("a"))
    x, y = (heads.select(F.col("fp").alias(f), F.col("head").alias(c)) for f, c in (("b", "x"), ("a", "y")))
    return saved(same.union(least.join(x, "b").join(y, "a").select("x", "y")))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """The input's columns and rows, one document of each component: that with the smallest id, then text hash.

    Documents link where the Jaccard similarity of their sets of word shingles is at least ``percent`` in a hundred. SimHash
    comes first: a document follows one within the radius if the sets are that similar. A radius of 3 bits misses many such
    pairs, so the exact set join then links what is not connected yet. Null and empty texts and those without words
    are one component. Rows that repeat both id and text are one document, of which one row stays. An empty table gives an
    empty result; other columns travel along whatever their names.
    """
    with short_shuffles(df.sparkSession):
        marked = written(ngram_join.with_sets(df, id_col, text_col, words, percent, fingerprint), "marked")
        each = written(marked.select("id", "id_hash", "text_hash", "digest"), "each")
        found = ngram_join.set_components(df, id_col, text_col, marked, words, percent, near_sets)
        full = join_counted(each.where("digest IS NOT NULL"), found, "digest", "docs")
        # The winner of a component is one of the few documents that carry its smallest id.
        first = full.where(F.col("id").eqNullSafe(F.col("component_id")))
        chosen = first.groupBy("root").agg(F.min(F.struct("text_hash", "id_hash")).alias("t"))
        empty = each.where("digest IS NULL").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "id_hash")).alias("t")).where("t IS NOT NULL")
        chosen = saved(chosen.select("t.text_hash", "t.id_hash").union(empty.select("t.text_hash", "t.id_hash")))
        freed(each)
    # From here on nothing is written: frames that may run more than once keep their shuffles.
    rows = df.select(packed(df), F.xxhash64(F.col(f"`{id_col}`")).alias("id_hash"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"))
    # Of rows that repeat id and text, the same one stays in every run.
    order = F.xxhash64(*[F.col("row").getField(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    one = rows.join(chosen, ["id_hash", "text_hash"], "left_semi").groupBy("id_hash", "text_hash").agg(F.min_by("row", order).alias("row"))
    return unpacked(one, df.columns, ())
