"""Text columns: normaliser, tokens, caption documents, brand n-grams."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.functions import vocab


#: Texts held as Python strings at once.
NFKC_ROWS = 64


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    done = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in texts.slice(at, NFKC_ROWS).to_pylist()], pa.string())
            for at in range(0, len(texts), NFKC_ROWS)]
    return pa.concat_arrays(done) if done else texts


def nfkc(c: Column) -> Column:
    """Compatibility-normalised text; only text beyond ASCII leaves the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip_markup(c: Column, max_length: int | None = None) -> Column:
    """Control characters and tags to spaces, punctuation runs and spaces squeezed; whole unless a length is named."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    c = F.regexp_replace(c, r"<[^>]{1,200}>", " ")
    c = F.regexp_replace(c, r"([!?.,;:])\1{1,}", "$1")
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.coalesce(c if max_length is None else F.trim(F.substring(c, 1, max_length)), F.lit(""))


def clean_text(c: Column, max_length: int | None = None, unicode: bool = True) -> Column:
    """Canonical free text; empty text for NULL."""
    return strip_markup(nfkc(c) if unicode else c, max_length)


def facet(c: Column, unicode: bool = True) -> Column:
    return clean_text(c, 120, unicode)


def truncate_words(c: Column, limit: int = 60) -> Column:
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) <= limit, c).otherwise(F.array_join(F.slice(words, 1, limit), " "))


def dedupe_ordered(values: Column) -> Column:
    """First spelling of every non-empty value, ignoring case, in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        values, empty,
        lambda seen, v: F.when(
            v.isNull() | (v == "") | F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen
        ).otherwise(F.concat(seen, F.array(v))))


def caption(name: Column, description: Column, category: Column, subcategory: Column,
            brand: Column, colour: Column, gender: Column, usage: Column,
            tags: Column | None = None) -> Column:
    """One-line document of a product: name, what it is, brand, use, tags, description.

    The inputs are canonical already (see ``clean_text`` and ``facet``), as columns of
    their own, so that no cleaning expression is copied into every clause.
    """
    name_c, text = name, description

    def novel(f: Column) -> Column:
        return F.when(F.contains(F.lower(name_c), F.lower(f)), F.lit("")).otherwise(f)

    kind = F.coalesce(F.nullif(novel(subcategory), F.lit("")), category)
    head = F.trim(F.concat_ws(" ", F.nullif(F.lower(novel(colour)), F.lit("")),
                              F.nullif(F.lower(kind), F.lit(""))))
    for_whom = F.when(novel(gender) != "", F.concat(F.lit(" for "), F.lower(novel(gender))))
    head_clause = F.when(head != "", F.concat(F.lit("a "), head, F.coalesce(for_whom, F.lit(""))))
    by = F.when(novel(brand) != "", F.concat(F.lit("by "), novel(brand)))
    wear = F.when(novel(usage) != "", F.concat(F.lit("for "), F.lower(novel(usage)), F.lit(" wear")))
    clauses = [F.nullif(name_c, F.lit("")), head_clause, by, wear]
    if tags is not None:
        kept = dedupe_ordered(F.transform(tags, novel))
        clauses.append(F.nullif(F.array_join(F.slice(kept, 1, 6), ", "), F.lit("")))
    clauses.append(F.when((text != "") & (F.lower(text) != F.lower(name_c)), text))
    present = F.filter(F.array(*clauses), lambda x: x.isNotNull())
    return truncate_words(F.array_join(dedupe_ordered(present), ". "))


def query_document(c: Column, unicode: bool = True) -> Column:
    return truncate_words(clean_text(c, 400, unicode))


def casefold(c: Column) -> Column:
    """Lower case for comparison; a sharp s counts as two letters."""
    return F.regexp_replace(F.lower(c), "ß", "ss")


def terms(c: Column, min_length: int = 2) -> Column:
    """Lower-case ASCII letter and digit runs of the cleaned text: no markup, full-width letters as plain ones."""
    return F.filter(F.split(casefold(clean_text(c)), "[^0-9a-z]+"), lambda t: F.length(t) >= min_length)


def name_tokens(c: Column) -> Column:
    """Tokens of a display name: letters, digits and & ' . -"""
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9&'.\-]+)"), F.lit(1))


def leading_ngrams(tokens: Column, longest: int = 4) -> Column:
    """Leading 1..n-grams in lower case."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(tokens)))
    grams = F.transform(sizes, lambda n: F.lower(F.array_join(F.slice(tokens, 1, n), " ")))
    return F.when(F.size(tokens) > 0, grams).otherwise(F.array().cast("array<string>"))


def singular(noun: Column) -> Column:
    low = F.lower(noun)
    pair = low.rlike("(" + "|".join(vocab.PAIR_NOUNS) + ")$")

    def cut(n: int) -> Column:
        return F.substring(noun, F.lit(1), F.length(noun) - n)

    return (F.when(pair, noun)
            .when(low.endswith("ies") & (F.length(noun) > 4), F.concat(cut(3), F.lit("y")))
            .when(low.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
            .when(low.endswith("s") & ~low.rlike("(ss|us|is)$"), cut(1))
            .otherwise(noun))


def article(phrase: Column) -> Column:
    return F.when(F.lower(phrase).rlike("^[aeiou]"), F.lit("an")).otherwise(F.lit("a"))


def description(display: Column, article_type: Column, subcategory: Column, category: Column,
                colour: Column, gender: Column, usage: Column, season: Column, year: Column,
                brand: Column) -> Column:
    """Sentences that restate a product's own attributes, given as canonical text columns."""

    def given(x: Column, y: Column) -> Column:
        return F.when(x != "", y)

    kind = F.coalesce(F.nullif(article_type, F.lit("")), F.nullif(subcategory, F.lit("")),
                      F.lit("product"))
    noun = F.lower(singular(kind))
    lead = F.concat(F.coalesce(given(colour, F.concat(F.lower(colour), F.lit(" "))), F.lit("")), noun)
    pair = noun.rlike("(" + "|".join(vocab.PAIR_NOUNS) + ")$")
    det = F.when(pair, F.lit("a pair of")).otherwise(article(lead))
    opening = F.concat(display, F.lit(" is "), det, F.lit(" "), lead,
                       F.coalesce(given(brand, F.concat(F.lit(" from "), brand)), F.lit("")),
                       F.lit("."))
    whom = F.when((gender != "") & (F.lower(gender) != "unisex"),
                  F.concat(F.lit("designed for "), F.lower(gender))).when(
        gender != "", F.lit("a unisex design"))
    suited = given(usage, F.concat(F.lit("suited to "), F.lower(usage), F.lit(" wear")))
    audience = F.concat_ws(" and ", whom, suited)
    span = F.concat_ws(" ", given(season, F.concat(F.lower(season), F.lit(" season"))),
                       F.when(year.isNotNull() & (year != 0), year.cast("string")))
    listed = F.when((category != "") & ~F.contains(F.lower(lead), F.lower(category)),
                    F.concat(F.lit("Listed under "), category, F.lit(".")))
    return F.concat_ws(
        " ", opening, given(audience, F.concat(F.lit("It is "), audience, F.lit("."))),
        given(span, F.concat(F.lit("Part of the "), span, F.lit(" range."))), listed)


def fingerprint(model: str, fields: list[Column]) -> Column:
    """Content hash of the model name and the fields an embedding depends on."""
    parts = [F.lit(model), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def made_up_price(external_id: Column, article_type: Column, usage: Column,
                  seed: str = vocab.PRICE_SEED) -> Column:
    """A repeatable, invented price inside the article type's band. Not real data."""
    from quarrylane.plans.bounded import lookup

    def num(table: dict[str, float], key: Column, default: float) -> Column:
        text = {k: repr(v) for k, v in table.items()}
        return F.coalesce(lookup(text, F.lower(F.trim(key))).cast("double"), F.lit(default))

    low = num({k: v[0] for k, v in vocab.PRICE_BANDS.items()}, article_type, vocab.DEFAULT_PRICE_BAND[0])
    high = num({k: v[1] for k, v in vocab.PRICE_BANDS.items()}, article_type, vocab.DEFAULT_PRICE_BAND[1])
    factor = num(vocab.USAGE_FACTOR, usage, 1.0)
    digest = F.sha2(F.concat(F.lit(seed + "\x00"), external_id.cast("string")), 256)
    fraction = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535.0
    whole = F.floor((low + fraction * (high - low)) * factor).cast("double")
    third = F.conv(F.substring(digest, 5, 2), 16, 10).cast("int")
    ending = F.element_at(F.array(*[F.lit(e) for e in vocab.PRICE_ENDINGS]),
                          (F.pmod(third, F.lit(len(vocab.PRICE_ENDINGS))) + 1).cast("int"))
    return F.round(F.greatest(F.lit(1.0), whole) + ending, 2)
