"""Column builders: the published text defects and their repaired values."""

import datetime as dt
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from quarrylane.functions import cleaning as cl
from quarrylane.functions import text as tx
from quarrylane.functions import vectors as vx
from quarrylane.functions.calendar import us_holidays, with_calendar


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    (r"\\xc2\\xa0Gurgaon", "Gurgaon"), (r"\xc2\xa0Gurgaon", "Gurgaon"), (r"Seed\\nFunding", "Seed Funding"), ("a \\ b", "a b")])
def test_unescape(spark, raw, want):
    assert one(spark, raw, cl.unescape) == want


@pytest.mark.parametrize("raw", ["N/A", "nan", "Undisclosed", "-", ""])
def test_placeholders_become_null(spark, raw):
    assert one(spark, raw, cl.to_null) is None


def test_other_text_stays(spark):
    assert one(spark, "Nandi", cl.to_null) == "Nandi"
    assert one(spark, None, cl.to_null) is None


@pytest.mark.parametrize("raw, want", [
    ("12/05.2015", dt.date(2015, 5, 12)), ("05/072018", dt.date(2018, 7, 5)), ("01/07/015", dt.date(2015, 7, 1)),
    ("22/01//2015", dt.date(2015, 1, 22)), ("31/02/2015", None), ("soon", None)])
def test_dates(spark, raw, want):
    assert one(spark, raw, cl.repaired_date) == want


def test_amounts_and_grouping(spark):
    assert one(spark, "20,00,00,000", cl.amount) == 200_000_000.0
    assert one(spark, "undisclosed", cl.amount) is None
    assert one(spark, "20,00,00,000", cl.lakh_grouped) and not one(spark, "200,000,000", cl.lakh_grouped)


@pytest.mark.parametrize("raw, want", [("Gurgaon / SFO", "Gurugram"), ("Bangalore", "Bengaluru"), ("pune & Goa", "Pune"), ("kochi", "Kochi")])
def test_city(spark, raw, want):
    assert one(spark, raw, cl.city) == want


@pytest.mark.parametrize("raw, want", [
    ("Seed / Angle Funding", "Seed / Angel"), ("pre-Series A", "Pre-Series A"), ("Series B (Extension)", "Series B"), ("Crowd", "Other")])
def test_stage(spark, raw, want):
    assert one(spark, raw, cl.stage) == want


def test_names_split_outside_brackets(spark):
    got = one(spark, "Saama Capital and Sequoia Capital, Fund (A, B) & Kae.", cl.split_names)
    assert got == ["Saama Capital", "Sequoia Capital", "Fund (A, B)", "Kae"]


def test_aliases_are_exact(spark):
    from quarrylane.functions.vocab import STARTUP_ALIASES
    for name, want in (("Ola Cabs", "ola"), ("Ola Electric", "olaelectric"), ("OYOfit", "oyofit"), ("OyoRooms", "oyo")):
        assert one(spark, name, lambda c: cl.alias(cl.match_key(c), c, STARTUP_ALIASES)[0]) == want


def test_placeholder_names(spark):
    for n in ("Undisclosed Investors", "Group of Angel investors", "3 angel investors", "HNIs"):
        assert one(spark, n, cl.is_placeholder_name)
    assert not one(spark, "Sequoia Capital", cl.is_placeholder_name)


def test_safe_divide_and_bands(spark):
    d = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in d.select(cl.safe_divide(F.col("a"), F.col("b"), 7.0)).collect()] == [7.0, 7.0, 2.0]
    band = [(6, "x"), (12, "y")]
    assert [one(spark, v, lambda c: cl.right_closed_band(c, band), "double") for v in (6.0, 6.1, 13.0)] == ["x", "y", None]


def test_clean_text(spark):
    assert one(spark, "ﬁne <b>Shoe</b>!!  now..", tx.clean_text) == "fine Shoe ! now."
    assert one(spark, None, tx.clean_text) == ""
    assert one(spark, "Straße a B2", tx.terms) == ["strasse", "b2"]


def test_caption(spark):
    d = spark.createDataFrame([("Nike Black Tee", "", "Apparel", "Tshirts", "Nike", "Black", "Men", "Sports")],
                              "n string, d string, c string, s string, b string, co string, g string, u string")
    got = d.select(tx.caption(*[F.col(x) for x in d.columns]).alias("r")).first().r
    assert got == "Nike Black Tee. a tshirts for men. for sports wear"


@pytest.mark.parametrize("raw, want", [("Shoes", "Shoes"), ("Ties", "Tie"), ("Accessories", "Accessory"), ("Watches", "Watch"), ("Dress", "Dress"), ("Tshirts", "Tshirt")])
def test_singular(spark, raw, want):
    assert one(spark, raw, tx.singular) == want


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = d.select(vx.unit(F.col("a")).alias("u"), vx.norm(vx.blend(F.col("a"), F.col("b"), 0.5)).alias("n")).first()
    assert r.u == [0.6, 0.8] and r.n == pytest.approx(1.0)


def test_holidays_match_the_federal_calendar():
    want = USFederalHolidayCalendar().holidays("1990-01-01", "2026-12-31")
    assert us_holidays(dt.date(1990, 1, 1), dt.date(2026, 12, 31)) == [x.date() for x in want]


def test_calendar_features(spark):
    d = spark.createDataFrame([(dt.date(2016, 7, 4),), (dt.date(2016, 7, 1),), (dt.date(2016, 12, 31),)], "d date")
    rows = with_calendar(d, "d", us_holidays(dt.date(2015, 1, 1), dt.date(2017, 12, 31))).orderBy("d").collect()
    assert [r.days_to_holiday for r in rows] == [3, 0, 2]
    assert [r.is_month_start for r in rows] == [1, 0, 0] and rows[2].is_month_end == 1
    assert [r.dow for r in rows] == [pd.Timestamp(r.d).dayofweek for r in rows]


def test_titles_dates_and_terms(spark):
    d = spark.createDataFrame([("new-delhi", "2015-05-12", "<div>Red</div>"), ("o'brien  CITY", "12/25/2016", "\uff32\uff45\uff44 bag"), ("ties", "25/12/2016", None)],
                              "t string, d string, x string")
    rows = d.select(cl.title(F.col("t")).alias("t"), cl.repaired_date(F.col("d")).cast("string").alias("d"), tx.terms(F.col("x")).alias("x")).collect()
    assert [r.t for r in rows] == ["New-Delhi", "O'Brien  City", "Ties"]
    assert [r.d for r in rows] == ["2015-05-12", "2016-12-25", "2016-12-25"]
    assert [list(r.x) for r in rows] == [["red"], ["red", "bag"], []]


def test_few_texts_are_held_while_normalising():
    texts = pa.array([f"\ufb01{i} " + "x\u0301" * 500 for i in range(10_000)])
    tracemalloc.start()
    got = tx._nfkc.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(got, pa.Array) and got[7].as_py()[:4] == "fi7 " and peak < 2_000_000
