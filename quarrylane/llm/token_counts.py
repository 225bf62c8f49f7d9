"""Token counts by batch encoding inside Arrow functions that return lengths only.

Texts are split at safe boundaries: before a single space between two characters that are not white space. A byte-level
pre-tokeniser with the usual pattern always starts a pre-token there, whatever surrounds it, so the counts of the pieces
add up to the count of the text; a long text needs no special case. Equal pieces are encoded once per process while their
memory lasts, and those still unknown go to the library in batches of bounded bytes.

Texts that hold the string of a special token are left whole, because the library takes those strings out first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylane.llm.common import packed, unpacked

ADDED = ("n_bytes", "n_tokens", "over_limit")
LIMIT = 512
#: Bytes of one call of the library, and pieces remembered by a process; beyond that the memory starts anew.
BATCH_BYTES, REMEMBERED = 1 << 20, 1_000_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s |^ | (?=\s|$)")


class Counter:
    """Counts tokens with one tokenizer file; holds the counts of pieces that begin with a space and of those that begin a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths of texts as the library encodes them, in batches balanced by bytes."""
        out: list[int] = []
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        if batch:
            out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def _learn(self, memory: dict[str, int], pieces: set[str], lead: str) -> None:
        new = [p for p in pieces if p not in memory]
        memory.update(zip(new, self.encoded([lead + p for p in new])))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first.clear()
            self.later.clear()
        split: list[list[str] | None] = []
        for text in texts:
            if self.special and self.special.search(text):
                split.append(None)
            else:
                split.append(_SAFE.split(text) if _UNSAFE.search(text) else text.split(" "))
        heads, tails = set(), set()
        for pieces in split:
            if pieces:
                heads.add(pieces[0])
                tails.update(pieces[1:])
        self._learn(self.first, heads, "")
        self._learn(self.later, tails, " ")
        whole = iter(self.encoded([t for t, p in zip(texts, split) if p is None]))
        later = self.later.__getitem__
        return [next(whole) if p is None else self.first[p[0]] + sum(map(later, p[1:])) for p in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow batch in runs of bounded bytes; null as an empty text."""
    held, size = [], 0
    for t in texts:
        text = t.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= 4 * BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_count(path: str):
    """Column function: number of tokens of a text."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([n for run in _runs(texts) for n in own.counts(run)], pa.int64())

    return count.asNondeterministic()  # evaluated once, however often its result is used


def with_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every input row with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Null and empty texts count 0. An empty table gives an empty result. Input columns named like an added one give way.
    """
    text: Column = F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = df.select(packed(df), size.alias("n_bytes"), token_count(path)(text).alias("n_tokens"))
    return unpacked(rows.withColumn("over_limit", F.col("n_tokens") > limit), df.columns, ADDED)
