"""Quality rules by distribution divergence.

Each language has a reference: a histogram of character classes and one of its commonest short words, counted over all of
its documents. A document is compared with every reference by the Jensen-Shannon distance (base 2, from 0 to 1) of both
histograms, and keeps the least mean distance. It fails where even its closest reference is too far. Short documents are
judged more mildly and very short ones by the base rules alone, as their histograms are noise.

The base rules count words, their characters, symbols, repeated lines and words inside repeated three-word windows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import SPACES, packed, unpacked
from quarrylane.plans.bounded import bounded_rows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "divergence", "kept")
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Documents with fewer words than this are not judged by their histograms.
GUARD_WORDS = 50
#: Largest mean distance to the closest reference, and what a document of n words may have besides: SLACK / sqrt(n).
MAX_DISTANCE, SLACK = 0.14, 1.55
#: A reference holds the commonest words of at most so many letters; longer words are counted together.
COMMON_WORDS, COMMON_LETTERS = 40, 4
MAX_LANGUAGES = 500
#: Character classes by their ASCII characters; the last two are all other ASCII characters and all characters beyond ASCII.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-", "#*$%&|<>")
N_CLASSES = len(CLASSES) + 2
_WORD = re.compile(f"[^{SPACES}]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_APART = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
# UTF-8 bytes to classes; a character beyond ASCII counts once, by its first byte.
_CLASS_OF = np.zeros((256, N_CLASSES))
for _c in range(128):
    _CLASS_OF[_c, next((k for k, chars in enumerate(CLASSES) if chr(_c) in chars), N_CLASSES - 2)] = 1
_CLASS_OF[192:, N_CLASSES - 1] = 1


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more. Equal windows have equal hashes; those are compared in full."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.sort(order[np.r_[same, False] | np.r_[False, same]]).tolist()
    times = Counter(tuple(words[i:i + 3]) for i in maybe)
    covered = upto = 0
    for i in maybe:
        if times[tuple(words[i:i + 3])] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()  # on bytes, these are the six ASCII white spaces
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    inside = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), inside, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) @ _CLASS_OF


def letter_words(text: str) -> list[bytes]:
    """Lower-case words, cut at every ASCII character that is no letter."""
    return text.lower().encode().translate(_APART).split()


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 of each row of counts from one vector of counts; 1 where either is empty."""
    total = p.sum(axis=1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where((total[:, 0] > 0) & (q.sum() > 0), np.sqrt(np.maximum(0, parts.sum(axis=1) / 2)), 1.0)


class References:
    """The histograms of all languages. ``found``: per language its class counts, common words with counts, and all its words."""

    def __init__(self, found: tuple):
        self.names = sorted({w.encode() for _, words, _ in found for w, _ in words})
        place = {w: k for k, w in enumerate(self.names)}
        self.parts = []
        for classes, words, total in found:
            own = [place[w.encode()] for w, _ in words]
            self.parts.append((np.array(classes, float), own, np.array([*(n for _, n in words), total - sum(n for _, n in words)], float)))

    def divergences(self, texts: list[str]) -> np.ndarray:
        """The least mean distance of each text to a language; 1 without languages."""
        if not self.parts or not texts:
            return np.ones(len(texts))
        classes = np.array([class_counts(t) for t in texts])
        words, totals = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            counts = Counter(letter_words(text))
            totals[i] = counts.total()
            words[i] = [counts[w] for w in self.names]
        least = np.full(len(texts), 1.0)
        for kinds, own, common in self.parts:
            here = words[:, own]
            here = np.column_stack([here, totals - here.sum(axis=1)])
            least = np.minimum(least, (distances(classes, kinds) + distances(here, common)) / 2)
        return least


@lru_cache(maxsize=4)
def _references(found: tuple) -> References:
    return References(found)


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple:
    """Per language (null is one of its own) class counts, commonest short words and number of words, over all documents.

    Words longer than COMMON_LETTERS are added up where they are read, so what is shuffled is short words only.
    """
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches):
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py() or ""
                all_words = letter_words(body)
                classes[lang] = classes.get(lang, 0) + class_counts(body)
                own = words.setdefault(lang, Counter())
                own.update(w for w in all_words if len(w) <= COMMON_LETTERS or len(w.decode()) <= COMMON_LETTERS)
                own[b""] += len(all_words)
        out = [(lang, f"\n{k}", int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
        out += [(lang, w.decode(), n) for lang, own in words.items() for w, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "what", "n"])

    sums = rows.mapInArrow(count, "lang string, what string, n long").groupBy("lang", "what").agg(F.sum("n").alias("n"))
    # Character classes and totals are a few rows a language; words are ranked within it, each a row of its own by now.
    ranked = sums.withColumn("word", ~F.col("what").startswith("\n") & (F.col("what") != ""))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "word").orderBy(F.col("n").desc(), "what")))
    top = bounded_rows(ranked.where((F.col("nth") <= COMMON_WORDS) | ~F.col("word")), MAX_LANGUAGES * (COMMON_WORDS + N_CLASSES + 1), "references")
    by: dict[str, dict[str, int]] = {}
    for r in top:
        by.setdefault(r["lang"], {})[r["what"]] = r["n"]
    out = []
    for lang in sorted(by):
        own = by[lang]
        n = own.get("", 0)
        if n:
            classes = tuple(own.get(f"\n{k}", 0) for k in range(N_CLASSES))
            words = tuple(sorted((w, c) for w, c in own.items() if w and not w.startswith("\n")))
            out.append((classes, words, n))
    return tuple(out)


def judge(texts: list[str | None], found: tuple) -> list[tuple]:
    """The added values of each text."""
    bodies = [t or "" for t in texts]
    far = _references(found).divergences(bodies) if found else np.zeros(len(bodies))
    out = []
    for body, d in zip(bodies, far.tolist()):
        counts = base_counts(body)
        n, repeated = counts[0], counts[4]
        failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
        near = n < GUARD_WORDS or d <= MAX_DISTANCE + SLACK / n ** 0.5
        out.append((*counts, failed, d, near and not failed))
    return out


def with_quality(df: DataFrame, found: tuple, text_col: str = "text") -> DataFrame:
    """Every input row with its base counts, ``base_failed``, ``divergence`` and ``kept``.

    Null and empty texts have no word and fail the base rules. Without references the base rules decide alone. An empty
    table gives an empty result. Input columns named like an added one are replaced by it.
    """
    kind = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64(), pa.bool_()]
    fields = ",".join(f"{n}:long" for n in BASE) + ",base_failed:boolean,divergence:double,kept:boolean"

    @F.arrow_udf(f"struct<{fields}>")
    def judged(texts: pa.Array) -> pa.Array:
        rows = judge(texts.to_pylist(), found)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kind)], list(ADDED))

    rows = df.select(packed(df), judged.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("found"))
    return unpacked(rows.select("row", "found.*"), df.columns, ADDED)
