"""Byte-level BPE encoding by overlapping chunks, and decoding by joining raw bytes.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, as if it began at a boundary;
only the first chunk is known to. Where a chunk and the one before it have a boundary in common inside their overlap, both
agree from there on, because a pre-token depends on what follows its start, not on what precedes it. These meeting points
cut the text into pieces, which are encoded in parallel and put together in order. Only points after a character that is
not white space are used: the pattern looks ahead after white space alone, so there a piece may end without changing its
last pre-token. A text that has an overlap without a meeting point (one pre-token longer than the overlap) is encoded whole.

Ids are held as little-endian unsigned 32-bit integers in one binary value, so they move without boxing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import packed, partition_count, saved, unpacked

ADDED = ("token_ids",)
#: Characters of a chunk without its overlap, and of the overlap. Texts up to one chunk are encoded in place.
CHUNK, OVERLAP = 65_536, 1_024
#: Last characters of a chunk, where a boundary may still depend on text that the chunk does not hold.
_MARGIN = 8


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file without special tokens, once per process."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes | None]:
    ranks = _ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _encoded(text: str | None, enc: tiktoken.Encoding) -> bytes:
    return enc.encode_to_numpy(text or "").astype("<u4", copy=False).tobytes()


def _decoded(ids: bytes, tokens: list[bytes | None]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str):
    """Column function: text to ids; null as an empty text."""

    @F.arrow_udf("binary")
    def encode_texts(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array((_encoded(t.as_py(), enc) for t in texts), pa.binary(), size=len(texts))

    return encode_texts.asNondeterministic()  # evaluated once, however often its result is used


def decoder(path: str):
    """Column function: ids to the raw bytes of their tokens, joined; null stays null, an unknown id is an error."""

    @F.arrow_udf("binary")
    def decode_ids(values: pa.Array) -> pa.Array:
        tokens = _token_bytes(path)
        return pa.array((None if v.as_py() is None else _decoded(v.as_py(), tokens) for v in values), pa.binary(), size=len(values))

    return decode_ids.asNondeterministic()


def round_trip(path: str, pattern: str):
    """Column function: text to its ids and what they decode to, in one Python process."""

    @F.arrow_udf("struct<token_ids:binary,decoded:binary>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        enc, tokens = encoding(path, pattern), _token_bytes(path)
        ids = pa.array((_encoded(t.as_py(), enc) for t in texts), pa.binary(), size=len(texts))
        back = pa.array((_decoded(i.as_py(), tokens) for i in ids), pa.binary(), size=len(texts))
        return pa.StructArray.from_arrays([ids, back], ["token_ids", "decoded"])

    return there_and_back.asNondeterministic()


def meeting_points(text: str, start: int, spans: list[tuple[int, int]], pattern: str) -> list[list[int]]:
    """Boundaries of a chunk that begins at ``start``, in whole-text positions, inside each (from, to) span."""
    found = np.array([m.start() for m in regex.finditer(pattern, text)] or [0])
    after = np.array([i > 0 and not text[i - 1].isspace() for i in found])
    found = found[after] + start
    return [found[(found >= a) & (found < b)].tolist() for a, b in spans]


def _seams(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                at = k * chunk
                spans = [(s, s + overlap - _MARGIN) for s in (at, at + chunk)]
                head, tail = meeting_points(text.as_py(), at, spans, pattern)
                heads.append(head)
                tails.append(tail)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], names=["no", "k", "head", "tail"])

    return chunks.mapInArrow(run, "no long, k int, head array<long>, tail array<long>")


def _encode_long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``no`` and ``token_ids`` of long texts (``no``, ``text``)."""
    parts = partition_count(long.sparkSession)
    last = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(chunk)) - 1, F.lit(0)).cast("int")
    chunks = (long.select("no", "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
              .select("no", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("part")).repartition(parts, "no", "k"))
    along = Window.partitionBy("no").orderBy("k")
    seams = _seams(chunks, pattern, chunk, overlap)
    points = seams.select("no", "k", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(along), "head"))).alias("start"))
    cuts = saved(points.select("no", "k", "start", F.lead("start").over(along).alias("end"),
                               F.max(F.col("start").isNull()).over(Window.partitionBy("no")).alias("whole")))
    inside = F.substring("part", F.col("start") - F.col("k") * chunk + 1, F.coalesce(F.col("end") - F.col("start"), F.lit(chunk + overlap)).cast("int"))
    pieces = chunks.join(cuts.where("NOT whole"), ["no", "k"]).select("no", "k", inside.alias("piece"))
    whole = long.join(cuts.where("whole").select("no").distinct(), "no").select("no", F.lit(0).alias("k"), F.col("text").alias("piece"))
    ids = pieces.union(whole).select("no", "k", encoder(path, pattern)("piece").alias("ids"))
    joined = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: F.hex(x["ids"])), ""))
    return ids.groupBy("no").agg(joined.alias("token_ids"))


def _parted(df: DataFrame, text_col: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The rows with texts up to one chunk (``row``, ``text``), and the others (with a number ``no``)."""
    if not 2 * _MARGIN < overlap <= chunk:
        raise ValueError("the overlap must be longer than its margin and at most a chunk")
    rows = df.select(packed(df), F.col(f"`{text_col}`").cast("string").alias("text"))
    many = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return rows.where(~many), saved(rows.where(many).withColumn("no", F.monotonically_increasing_id()))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every input row with ``token_ids``, as the library encodes its whole text without special tokens.

    Null and empty texts give no ids. An empty table gives an empty result. An input column of the added name is replaced.
    """
    short, long = _parted(df, text_col, chunk, overlap)
    near = short.select("row", encoder(path, pattern)("text").alias("token_ids"))
    far = long.select("no", "row").join(_encode_long(long.select("no", "text"), path, pattern, chunk, overlap), "no").select("row", "token_ids")
    return unpacked(near.union(far), df.columns, ADDED)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """Every input row with ``decoded``, the raw bytes of its ids."""
    rows = df.select(packed(df), decoder(path)(F.col(f"`{ids_col}`")).alias("decoded"))
    return unpacked(rows, df.columns, ("decoded",))


def encoded_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row the id, ``n_tokens``, and SHA-256 of the ids and of the bytes that they decode to."""
    short, long = _parted(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")), "body", chunk, overlap)
    near = short.select(F.col("row.id").alias("id"), round_trip(path, pattern)("text").alias("r")).select("id", "r.*")
    ids = _encode_long(long.select("no", "text"), path, pattern, chunk, overlap)
    far = decode(long.select("no", F.col("row.id").alias("id")).join(ids, "no").select("id", "token_ids"), path)
    return near.union(far).select(F.col("id").alias(id_col), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                                  F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
