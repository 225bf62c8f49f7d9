"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A document is parsed greedily against each automaton: a phrase
runs on for as long as it occurs in that language's text, so phrase ends are where the longest match ends. A foreign text
breaks into more phrases. The number of phrases times the logarithm of the training length, per symbol, estimates the
cross entropy; the language with the least wins.

Symbols are UTF-8 bytes of the lower-case text, so no script needs an alphabet of its own. Documents are parsed in blocks
of fixed length that start with the document; a phrase ends at a block's end in every language alike. All blocks of an
Arrow batch advance together, one symbol a step, in numpy.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import packed, unpacked
from quarrylane.plans.bounded import bounded_rows

ADDED = ("lang_pred", "score", "known")
UNDECIDED = "und"
#: Bound of the training sample: documents per language, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 64, 400
#: Labels are a small vocabulary; more of them than this are refused.
MAX_LANGUAGES = 500
BLOCK = 256
#: Symbols of one numpy pass.
_PASS = 1 << 20


def symbols(text: str) -> bytes:
    """Lower-case UTF-8; every ASCII byte that is no letter becomes a space."""
    return text.lower().encode("utf-8", "replace").translate(_SYMBOL)


_SYMBOL = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def suffix_automaton(data: list[int], width: int) -> array:
    """Transitions of the smallest automaton that accepts every substring of symbols 1 to ``width - 1``.

    Entry ``state + symbol`` is where the symbol leads, states being multiples of ``width``; 0 means nowhere, as no
    transition leads back to state 0, where every match starts.
    """
    step = array("i", bytes(4 * width * (2 * len(data) + 1)))
    link, length, last, used = {0: -1}, {0: 0}, 0, width
    for c in data:
        new, used = used, used + width
        length[new], link[new], p = length[last] + 1, 0, last
        while p >= 0 and not step[p + c]:
            step[p + c] = new
            p = link[p]
        if p >= 0:
            q = step[p + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin, used = used, used + width
                step[twin:twin + width] = step[q:q + width]
                length[twin], link[twin] = length[p] + 1, link[q]
                while p >= 0 and step[p + c] == q:
                    step[p + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step[:used]


class Parser:
    """One language's automaton as a dense table over the bytes that its text uses."""

    def __init__(self, texts: tuple[str, ...]):
        # A line feed is no symbol of a document (it becomes a space), so no phrase runs over two training texts.
        data = b"\n".join(symbols(t) for t in texts) or b" "
        used = sorted(set(data) - {10})
        self.width = len(used) + 2
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        inner = self.column.copy()
        inner[10] = len(used) + 1
        self.table = np.frombuffer(suffix_automaton(inner[np.frombuffer(data, np.uint8)].tolist(), self.width), np.int32)
        self.bits = math.log2(max(2, len(data)))

    def breaks(self, blocks: np.ndarray) -> np.ndarray:
        """Per block (rows of bytes, padded with 0 at the end) the phrase ends before its last phrase, and unknown symbols."""
        cols = self.column[blocks.T]  # one row per step
        live = blocks.T != 0
        state = np.zeros(len(blocks), dtype=np.int32)
        count = np.zeros(len(blocks), dtype=np.int64)
        first = self.table[:self.width]
        for c, on in zip(cols, live):
            after = self.table[state + c]
            miss = after == 0
            state = np.where(miss, first[c], after)
            count += miss & on
            count += (c == 0) & on  # a symbol that the language lacks is a phrase of its own
        return count


@lru_cache(maxsize=1)
def parsers(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[tuple[str, Parser], ...]:
    """The languages' parsers in order of their labels, once per process."""
    return tuple((lang, Parser(texts)) for lang, texts in samples)


def _phrases(data: list[bytes], models: tuple[tuple[str, Parser], ...]) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns). A long text is taken in passes of whole blocks."""
    out = np.zeros((len(data), len(models)))
    size = np.array([-(-len(d) // BLOCK) for d in data])
    flat = np.frombuffer(b"".join(d.ljust(n * BLOCK, b"\0") for d, n in zip(data, size)), np.uint8).reshape(-1, BLOCK)
    owner = np.repeat(np.arange(len(data)), size)
    for at in range(0, len(flat), _PASS // BLOCK):
        some, who = flat[at:at + _PASS // BLOCK], owner[at:at + _PASS // BLOCK]
        for k, (_, parser) in enumerate(models):
            np.add.at(out[:, k], who, parser.breaks(some) + 1)
    return out


def _passes(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch in runs of about _PASS characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += max(len(held[-1] or ""), BLOCK)
        if size >= _PASS:
            yield held
            held, size = [], 0
    if held:
        yield held


def classify(texts: list[str | None], samples: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and known share of each text.

    score: the runner-up's cross entropy over the sum of the best two (0.5: a tie; near 1: clear). known: the share of
    bytes outside ASCII white space and signs that occur in the winner's training text.
    """
    models = parsers(samples)
    data = [symbols(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
    bits = _phrases(data, models) * np.array([p.bits for _, p in models])
    langs, scores, known = [], [], []
    for d, row in zip(data, bits):
        if not d or not models:
            langs.append(UNDECIDED)
            scores.append(0.0)
            known.append(0.0)
            continue
        best = int(np.argmin(row))
        rest = np.delete(row, best)
        langs.append(models[best][0])
        scores.append(float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0)
        here = np.frombuffer(d, np.uint8)
        here = here[here != 32]
        known.append(float((models[best][1].column[here] > 0).mean()) if len(here) else 0.0)
    return langs, scores, known


def held_out(ident: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = TRAIN_DOCS,
                    chars: int = TRAIN_CHARS) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Labelled text per language: about ``docs`` documents with the smallest hashes, ``chars`` characters of each.

    The hash threshold of a language follows from its number of documents, so no language is sorted or gathered.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id")))
    labels = bounded_rows(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), MAX_LANGUAGES, "language labels")
    if not labels:
        return ()
    spread = 1 << 30
    limit = rows.sparkSession.createDataFrame([(r["lang"], min(spread, -(-2 * docs * spread // r["n"]))) for r in labels], "lang string, below long")
    key = F.xxhash64("id", "text")
    near = rows.join(F.broadcast(limit), "lang").where(F.pmod(key, F.lit(spread)) < F.col("below"))
    top = near.select("lang", F.pmod(key, F.lit(spread)).alias("h"), F.substring("text", 1, chars).alias("text")).distinct().collect()
    found: dict[str, list[tuple[int, str]]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return tuple((lang, tuple(t for _, t in sorted(found.get(lang, []))[:docs])) for lang in sorted(r["lang"] for r in labels) if lang in found)


def _guessed(df: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], text_col: str) -> DataFrame:
    """``row`` (all input columns) and ``found`` (the added ones)."""

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double>")
    def guess(texts: pa.Array) -> pa.Array:
        # A worker is used again by other stages' functions; what their batches held goes back first.
        pa.default_memory_pool().release_unused()
        found = [classify(run, samples) for run in _passes(texts)]
        columns = [pa.array([v for f in found for v in f[k]], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, list(ADDED))

    return df.select(packed(df), guess.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("found"))


def identify(df: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], text_col: str = "text") -> DataFrame:
    """Every input row with ``lang_pred``, ``score`` and ``known``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned. Ties go
    to the first label. An empty table gives an empty result. Input columns named like an added one are replaced by it.
    """
    return unpacked(_guessed(df, samples, text_col).select("row", "found.*"), df.columns, ADDED)


def known_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_known: float = 0.5) -> DataFrame:
    """The input's rows and columns, without texts that are undecided or mostly in symbols that the language lacks."""
    samples = training_sample(df, id_col, text_col, lang_col)
    rows = _guessed(df, samples, text_col)  # each text is held once, in its row
    return rows.where((F.col("found.lang_pred") != UNDECIDED) & (F.col("found.known") >= least_known)).select("row.*")
