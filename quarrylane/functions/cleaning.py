"""Column builders that repair text, dates and amounts. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylane.functions import vocab
from quarrylane.plans.bounded import lookup


def unescape(c: Column) -> Column:
    """Remove escape sequences stored as literal characters, then squeeze spaces."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\\+(x[0-9a-fA-F]{2}|[nrt])", " "), r"\\+", "")
    c = F.when(F.contains(c, F.lit("\\")), bare).otherwise(c)  # most cells hold no backslash
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def to_null(c: Column, tokens: Iterable[str] = vocab.NULL_TOKENS) -> Column:
    """NULL where the text is only a placeholder.

    One reference to the input, so a filter on the result does not copy the
    expression behind it.
    """
    listed = "|".join(re.escape(t).replace("/", r"\/") for t in tokens if t)
    kept = F.regexp_extract_all(c, F.lit(rf"(?s)^(?!(?i:{listed})$)(.+)$"), F.lit(1))
    return F.try_element_at(kept, F.lit(1))


def display_name(c: Column) -> Column:
    """Straight apostrophes, no wrapping quotes."""
    c = F.regexp_replace(c, "[‘’ʼ]", "'")
    return F.trim(F.regexp_replace(c, '^"+|"+$', ""))


def match_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def repair_date_text(c: Column) -> Column:
    """Bring malformed day-first dates to d/m/yyyy."""
    for pattern, to in ((r"\.", "/"), (r"/+", "/"), (r"^(\d{2})(\d{2})(\d{4})$", "$1/$2/$3"),
                        (r"^(\d{1,2})/(\d{2})(\d{4})$", "$1/$2/$3"), (r"/0(\d{2})$", "/20$1")):
        c = F.regexp_replace(c, pattern, to)
    return c


def day_first_date(c: Column) -> Column:
    """Parse d/m/yyyy; NULL when it is not a date."""
    return F.try_to_timestamp(c, F.lit("d/M/yyyy")).cast("date")


def strict_day_first_date(c: Column) -> Column:
    """Parse only dd/mm/yyyy, as the uncorrected arm does."""
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day_first_date(c))


def repaired_date(c: Column) -> Column:
    """Day first where that is a date, else year first, else month first."""
    def read(text: Column, pattern: str) -> Column:
        return F.try_to_timestamp(text, F.lit(pattern)).cast("date")

    text = repair_date_text(c)
    return F.coalesce(day_first_date(text), read(F.trim(c), "yyyy-M-d"), read(text, "M/d/yyyy"))


def amount(c: Column) -> Column:
    """Number from text with any digit grouping; NULL when nothing is left."""
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")


def naive_amount(c: Column) -> Column:
    """Number after removing commas only."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def lakh_grouped(c: Column) -> Column:
    """Whether digits are grouped in twos before the last three."""
    return F.coalesce(c.rlike(r"^\d{1,2}(,\d{2})+,\d{3}$"), F.lit(False))


def title(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2_147_483_647))), "")


def city(c: Column) -> Column:
    """Primary place before / or &, in its canonical spelling."""
    primary = F.trim(F.element_at(F.split(c, "[/&]"), 1))
    return F.coalesce(lookup(vocab.CITY_NAMES, F.lower(primary)), title(primary))


def first_rule(c: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """Label of the first pattern found in the lower-cased text."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(label)) for p, label in rules], otherwise)


def industry(c: Column) -> Column:
    return first_rule(c, vocab.INDUSTRY_RULES, title(c))


def stage(c: Column) -> Column:
    return first_rule(c, vocab.STAGE_RULES, F.lit("Other"))


def alias(key: Column, name: Column, aliases: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    """Merged key and name of an entity; exact key match, never a prefix."""
    to_key = lookup({k: v[0] for k, v in aliases.items()}, key)
    to_name = lookup({k: v[1] for k, v in aliases.items()}, key)
    return F.coalesce(to_key, key), F.coalesce(to_name, name)


def is_placeholder_name(c: Column) -> Column:
    n = F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    return n.rlike("(?i)" + vocab.PLACEHOLDER_NAME) | n.isin(list(vocab.BARE_COLLECTIVES))


def split_names(c: Column) -> Column:
    """Names in a list text: split on commas, & and 'and', but not inside brackets."""
    parts = F.split(c, r"(?:,|\s+&\s+|\s+and\s+)(?![^(]*\))")

    def neat(p: Column) -> Column:
        p = F.regexp_replace(F.trim(p), r"^(and|&)\s+", "")
        p = F.regexp_replace(p, r"\s+", " ")
        return F.regexp_replace(p, r"[.,;]+$", "")

    return F.filter(F.transform(parts, neat), lambda p: F.length(p) > 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_divide(num: Column, den: Column, fill: float = 0.0) -> Column:
    """Quotient that is never NULL, NaN or infinite."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    bad = q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(fill))).otherwise(q)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def right_closed_band(c: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """Label of the first upper bound that the value does not exceed."""
    out = F.when(c <= F.lit(bands[0][0]), F.lit(bands[0][1]))
    for upper, label in bands[1:]:
        out = out.when(c <= F.lit(upper), F.lit(label))
    return out


def left_closed_band(c: Column, bands: Sequence[tuple[str, float]]) -> Column:
    """Label of the last lower bound that the value reaches; the top band is open."""
    ordered = list(bands)[::-1]
    out = F.when(c >= F.lit(ordered[0][1]), F.lit(ordered[0][0]))
    for label, lower in ordered[1:]:
        out = out.when(c >= F.lit(lower), F.lit(label))
    return out.otherwise(F.lit(ordered[0][0]))


def money_text(c: Column) -> Column:
    """Short dollar text for reports."""
    big = F.concat(F.lit("$"), F.format_number(c / 1e9, 2), F.lit("B"))
    mid = F.concat(F.lit("$"), F.format_number(c / 1e6, 1), F.lit("M"))
    small = F.concat(F.lit("$"), F.format_number(c, 0))
    return (F.when(c.isNull() | F.isnan(c), F.lit("-")).when(F.abs(c) >= 1e9, big)
            .when(F.abs(c) >= 1e6, mid).otherwise(small))
