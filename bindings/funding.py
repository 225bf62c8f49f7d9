"""Funding rounds derived from orders, customers and nations, with the usual text defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from quarrylane.functions import vocab
from quarrylane.operators import rounds as rd

RAW = r"""
o AS (SELECT o.*, c.c_name, c.c_mktsegment, n.n_name, n.n_nationkey,
             strftime(o_orderdate, '%d') AS dd, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%Y') AS yy,
             (floor(o_totalprice)::BIGINT * 600)::VARCHAR AS dollars
      FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey),
rr AS (
  SELECT o_orderkey::VARCHAR AS sr_no,
    CASE o_orderpriority WHEN '1-URGENT' THEN dd || '/' || mm || '.' || yy WHEN '2-HIGH' THEN dd || '/' || mm || yy
      WHEN '3-MEDIUM' THEN dd || '/' || mm || CASE WHEN yy >= '2000' THEN '/0' || yy[3:4] ELSE '/' || yy END WHEN '4-NOT SPECIFIED' THEN dd || '//' || mm || '/' || yy
      ELSE dd || '/' || mm || '/' || yy END AS date_raw,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Ola Cabs' WHEN 'BUILDING' THEN 'OyoRooms'
      ELSE CASE o_orderstatus WHEN 'F' THEN '"' || c_name || '"' WHEN 'P' THEN '\\xc2\\xa0' || c_name ELSE c_name END END AS startup,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Transportation' WHEN 'BUILDING' THEN 'Real Estate Tech'
      WHEN 'FURNITURE' THEN 'E-Commerce' WHEN 'HOUSEHOLD' THEN 'consumer internet' ELSE 'MINING' END AS industry_raw,
    'N/A' AS subvertical,
    CASE n_nationkey WHEN 0 THEN 'Bangalore' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Gurgaon / SFO' WHEN 3 THEN 'New Delhi'
      WHEN 4 THEN '\\xc2\\xa0Mumbai' WHEN 5 THEN 'Pune & Goa' WHEN 6 THEN 'nan' ELSE n_name END AS city_raw,
    CASE n_nationkey % 5 WHEN 0 THEN 'Sequoia Capital' WHEN 1 THEN 'Accel Partners' WHEN 2 THEN 'SAIF Partners'
      WHEN 3 THEN 'Undisclosed Investors' ELSE 'Blume Venture.' END AS inv_a,
    'Fund ' || n_name || ' (A, B)' AS inv_b,
    CASE o_orderstatus WHEN 'F' THEN ', ' WHEN 'P' THEN ' & ' ELSE ' and ' END AS inv_sep,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Seed\\nFunding' WHEN '2-HIGH' THEN 'pre-Series A' WHEN '3-MEDIUM' THEN 'Series B'
      WHEN '4-NOT SPECIFIED' THEN 'Private Equity' ELSE 'Seed / Angle Funding' END AS stage_raw,
    CASE o_orderstatus WHEN 'P' THEN 'undisclosed' WHEN 'O' THEN dollars || '+' ELSE
      ltrim(substr(lpad(dollars, 9, '0'), 1, 2) || ',' || substr(lpad(dollars, 9, '0'), 3, 2) || ',' ||
            substr(lpad(dollars, 9, '0'), 5, 2) || ',' || substr(lpad(dollars, 9, '0'), 7, 3), '0,') END AS amount_raw,
    '-' AS remarks, dd, mm, yy, dollars, c_name, c_mktsegment, n_name, n_nationkey, o_orderkey, o_orderpriority, o_orderstatus
  FROM o)"""

# The cleaned table is stated from what each defect was made of, not by repairing it again.
ROUNDS = RAW + r""",
r0 AS (
  SELECT o_orderkey AS sr_no, make_date(yy::INT, mm::INT, dd::INT) AS date,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Ola' WHEN 'BUILDING' THEN 'OYO' ELSE c_name END AS startup,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ola' WHEN 'BUILDING' THEN 'oyo'
      ELSE regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') END AS startup_key,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Logistics & Transport' WHEN 'BUILDING' THEN 'Real Estate'
      WHEN 'FURNITURE' THEN 'eCommerce' WHEN 'HOUSEHOLD' THEN 'Consumer Internet' ELSE 'Mining' END AS industry,
    CASE n_nationkey WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Gurugram' WHEN 3 THEN 'Delhi'
      WHEN 4 THEN 'Mumbai' WHEN 5 THEN 'Pune' WHEN 6 THEN NULL ELSE 'N' || lower(n_name[2:]) END AS city,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Seed / Angel' WHEN '2-HIGH' THEN 'Pre-Series A' WHEN '3-MEDIUM' THEN 'Series B'
      WHEN '4-NOT SPECIFIED' THEN 'Private Equity' ELSE 'Seed / Angel' END AS stage,
    CASE o_orderstatus WHEN 'P' THEN NULL ELSE dollars::DOUBLE END AS amount_usd,
    yy::BIGINT AS year, yy || '-' || mm AS month, inv_a, inv_b
  FROM rr),
r1 AS (SELECT *, CASE WHEN sr_no = 61 THEN 'confirmed_inr_not_usd'
                      WHEN amount_usd >= 250000000 AND startup_key NOT IN ('ola', 'oyo') THEN 'review_outlier' END AS amount_flag FROM r0),
rounds AS (SELECT *, CASE WHEN amount_flag = 'confirmed_inr_not_usd' THEN amount_usd / 71 ELSE amount_usd END AS amount_usd_adj FROM r1),
money AS (SELECT * FROM rounds WHERE amount_usd_adj IS NOT NULL AND amount_flag IS DISTINCT FROM 'review_outlier'),
pairs AS (
  SELECT r.*, CASE x WHEN 'Sequoia Capital' THEN 'Sequoia Capital India' WHEN 'Accel Partners' THEN 'Accel'
      WHEN 'Blume Venture' THEN 'Blume Ventures' ELSE x END AS investor,
    CASE x WHEN 'Sequoia Capital' THEN 'sequoiacapitalindia' WHEN 'Accel Partners' THEN 'accel'
      WHEN 'Blume Venture' THEN 'blumeventures' ELSE regexp_replace(lower(x), '[^a-z0-9]', '', 'g') END AS investor_key
  FROM rounds r, unnest([CASE WHEN inv_a = 'Blume Venture.' THEN 'Blume Venture' ELSE inv_a END, inv_b]) AS u(x)
  WHERE x <> 'Undisclosed Investors')"""


def raw(t: Tables):
    c, n = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), t.nation
    o = (t.spread("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    dd, mm, yy = (F.date_format("o_orderdate", p) for p in ("dd", "MM", "yyyy"))
    pr, st, seg, nk = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("c_mktsegment"), F.col("n_nationkey")
    cc, lit = F.concat, F.lit
    dollars = (F.floor("o_totalprice") * 600).cast("string")
    p9 = F.lpad(dollars, 9, "0")
    grouped = F.ltrim(F.concat_ws(",", F.substring(p9, 1, 2), F.substring(p9, 3, 2), F.substring(p9, 5, 2),
                                  F.substring(p9, 7, 3)), lit("0,"))
    esc = "\\\\xc2\\\\xa0"
    name = (F.when(st == "F", cc(lit('"'), "c_name", lit('"'))).when(st == "P", cc(lit(esc), "c_name"))
            .otherwise(F.col("c_name")))
    inv_a = (F.when(nk % 5 == 0, "Sequoia Capital").when(nk % 5 == 1, "Accel Partners")
             .when(nk % 5 == 2, "SAIF Partners").when(nk % 5 == 3, "Undisclosed Investors").otherwise("Blume Venture."))
    sep = F.when(st == "F", ", ").when(st == "P", " & ").otherwise(" and ")
    return o.select(
        F.col("o_orderkey").cast("string").alias("sr_no"),
        (F.when(pr == "1-URGENT", cc(dd, lit("/"), mm, lit("."), yy)).when(pr == "2-HIGH", cc(dd, lit("/"), mm, yy))
         .when((pr == "3-MEDIUM") & (yy >= "2000"), cc(dd, lit("/"), mm, lit("/0"), F.substring(yy, 3, 2)))
         .when(pr == "4-NOT SPECIFIED", cc(dd, lit("//"), mm, lit("/"), yy))
         .otherwise(cc(dd, lit("/"), mm, lit("/"), yy))).alias("date_raw"),
        F.when(seg == "AUTOMOBILE", "Ola Cabs").when(seg == "BUILDING", "OyoRooms").otherwise(name).alias("startup"),
        (F.when(seg == "AUTOMOBILE", "Transportation").when(seg == "BUILDING", "Real Estate Tech")
         .when(seg == "FURNITURE", "E-Commerce").when(seg == "HOUSEHOLD", "consumer internet")
         .otherwise("MINING")).alias("industry_raw"),
        lit("N/A").alias("subvertical"),
        (F.when(nk == 0, "Bangalore").when(nk == 1, "Bengaluru").when(nk == 2, "Gurgaon / SFO").when(nk == 3, "New Delhi")
         .when(nk == 4, esc + "Mumbai").when(nk == 5, "Pune & Goa").when(nk == 6, "nan")
         .otherwise(F.col("n_name"))).alias("city_raw"),
        cc(inv_a, sep, lit("Fund "), "n_name", lit(" (A, B)")).alias("investors_raw"),
        (F.when(pr == "1-URGENT", "Seed\\\\nFunding").when(pr == "2-HIGH", "pre-Series A").when(pr == "3-MEDIUM", "Series B")
         .when(pr == "4-NOT SPECIFIED", "Private Equity").otherwise("Seed / Angle Funding")).alias("stage_raw"),
        F.when(st == "P", "undisclosed").when(st == "O", cc(dollars, lit("+"))).otherwise(grouped).alias("amount_raw"),
        lit("-").alias("remarks"))


def rounds(t: Tables):
    return rd.clean(raw(t))


def kept_rounds(t: Tables, *columns: str):
    """The named columns of the cleaned rounds, written once; the cleaners of the others do not run."""
    return t.kept("rounds", lambda: rounds(t).select(*columns))


@query("rounds_clean", f"""WITH {ROUNDS} SELECT sr_no, date, startup, startup_key, industry, NULL::VARCHAR AS subvertical, city,
  inv_a || inv_sep || inv_b AS investors, stage, amount_usd, NULL::VARCHAR AS remarks, year, month, amount_flag,
  round(amount_usd_adj, 6) AS amount_usd_adj FROM rounds JOIN (SELECT o_orderkey, inv_sep FROM rr) s ON s.o_orderkey = sr_no""")
def clean(t: Tables):
    """Every cleaner at once: escapes, placeholders, dates, amounts, labels, aliases, flags."""
    return rounds(t)


@query("rounds_money_safe", f"WITH {ROUNDS} SELECT sr_no, round(amount_usd_adj, 6) AS amount_usd_adj, amount_flag FROM money")
def money_safe(t: Tables):
    """Rows that may be summed."""
    return rd.money_safe(rounds(t)).select("sr_no", "amount_usd_adj", "amount_flag")


@query("rounds_investor_pairs", f"WITH {ROUNDS} SELECT sr_no, investor, investor_key, stage, city FROM pairs")
def investor_pairs(t: Tables):
    """List split outside brackets, placeholders dropped, aliases merged."""
    return rd.investor_pairs(rounds(t)).select("sr_no", "investor", "investor_key", "stage", "city")


@query("rounds_placeholder_names", f"""WITH {RAW} SELECT inv_a AS first_name, count(*) AS n,
  inv_a = 'Undisclosed Investors' AS is_placeholder FROM rr GROUP BY ALL""")
def placeholder_names(t: Tables):
    """Placeholder predicate on the first listed investor."""
    from quarrylane.functions.cleaning import is_placeholder_name
    first = F.regexp_extract("investors_raw", r"^(.*?)(, | & | and )", 1)
    d = raw(t).select(first.alias("first_name"))
    return d.groupBy("first_name", is_placeholder_name(F.col("first_name")).alias("is_placeholder")).agg(
        F.count(F.lit(1)).alias("n"))


TEXT = ["sr_no", "date_raw", "startup", "industry_raw", "subvertical", "city_raw", "stage_raw", "amount_raw", "remarks"]


@query("rounds_placeholder_profile", f"WITH {RAW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER "
    f"(lower(trim({c})) IN ('nan', 'n/a', '', 'unknown', 'undisclosed')) AS n_placeholder FROM rr" for c in TEXT))
def placeholder_profile(t: Tables):
    """NULLs and placeholder texts per column in one pass."""
    return rd.placeholder_profile(raw(t).select(*TEXT))


@query("rounds_escape_counts", rf"""WITH {RAW} SELECT
  (sum(length(city_raw) - length(replace(city_raw, '\\xc2', ''))) // 5)::BIGINT AS double_escape, 0::BIGINT AS real_nbsp FROM rr""")
def escape_counts(t: Tables):
    """Literal escapes stored as characters, next to real no-break spaces."""
    return rd.pattern_counts(raw(t), "city_raw", {"double_escape": r"\\\\xc2", "real_nbsp": " "})


@query("rounds_grouping_style", f"""WITH {RAW}, h AS (SELECT sr_no, amount_raw FROM rr
  WHERE regexp_full_match(amount_raw, '[0-9]{{1,2}}(,[0-9]{{2}})+,[0-9]{{3}}'))
SELECT sr_no, amount_raw, (SELECT count(*) FROM h) AS n_grouped FROM h ORDER BY sr_no LIMIT 3""")
def grouping_style(t: Tables):
    """Amounts whose digits are grouped in twos, with the first samples."""
    return rd.grouping_style(raw(t), "amount_raw", "sr_no")


@query("rounds_parse_failures", f"""WITH {RAW} SELECT count(*) FILTER (o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '3-MEDIUM' AND yy < '2000')) AS dates_before,
  0::BIGINT AS dates_after, count(*) FILTER (o_orderstatus <> 'F') AS amounts_before,
  count(*) FILTER (o_orderstatus = 'P') AS amounts_after FROM rr""")
def parse_failures(t: Tables):
    """Dates and amounts that do not parse, before and after repair."""
    return rd.parse_failures(raw(t))


@query("rounds_label_fragmentation", f"""WITH {ROUNDS}
SELECT 'stage_raw' AS label, count(DISTINCT stage_raw) AS raw_labels, (SELECT count(DISTINCT stage) FROM rounds) AS clean_labels FROM rr
UNION ALL SELECT 'city_raw', count(DISTINCT city_raw), (SELECT count(DISTINCT city) FROM rounds) FROM rr
UNION ALL SELECT 'industry_raw', count(DISTINCT industry_raw), (SELECT count(DISTINCT industry) FROM rounds) FROM rr
UNION ALL SELECT 'startup', count(DISTINCT startup), (SELECT count(DISTINCT startup_key) FROM rounds) FROM rr""")
def label_fragmentation(t: Tables):
    """Distinct labels before and after cleaning."""
    r = raw(t)
    return rd.label_fragmentation(r, rd.clean(r), {"stage_raw": "stage", "city_raw": "city",
                                                   "industry_raw": "industry", "startup": "startup_key"})


@query("rounds_published_corrected", f"""WITH {ROUNDS}, s AS (SELECT sum(amount_usd) AS p, sum(amount_usd_adj) AS c,
  avg((amount_usd IS NULL)::INT) AS w FROM rounds)
SELECT round(p, 2) AS published, round(c, 2) AS corrected, round((SELECT sum(amount_usd_adj) FROM money), 2) AS money_safe,
  round(w, 2) AS share_without_amount, round(p - c, 2) AS moved, round((p - c) / p, 2) AS moved_share FROM s""", digits=2)
def published_corrected(t: Tables):
    """Published total, corrected total and what one cell moves."""
    return rd.published_and_corrected(rounds(t))


@query("rounds_disclosure_by_stage", f"""WITH {ROUNDS} SELECT stage, count(*) AS n_rounds, count(amount_usd) AS with_amount,
  round(count(amount_usd) / count(*)::DOUBLE, 6) AS disclosure FROM rounds GROUP BY stage HAVING count(*) >= 20""")
def disclosure_by_stage(t: Tables):
    """Share of rounds that state an amount, per stage."""
    return rd.disclosure(rounds(t), "stage", "amount_usd")


@query("rounds_startup_leaders", f"""WITH {ROUNDS} SELECT startup_key, min_by(startup, sr_no) AS name, count(*) AS n_rounds,
  round(sum(amount_usd_adj), 2) AS total FROM money GROUP BY startup_key ORDER BY sum(amount_usd_adj) DESC, startup_key LIMIT 10""", digits=2)
def startup_leaders(t: Tables):
    """Top entities by amount after merging aliases."""
    return rd.leaderboard(rd.money_safe(rounds(t)), "startup_key", "startup", "amount_usd_adj", "sr_no")


@query("rounds_investor_leaders", f"""WITH {ROUNDS} SELECT investor_key, min_by(investor, sr_no) AS name,
  count(DISTINCT sr_no) AS deals, count(DISTINCT startup) AS startups FROM pairs GROUP BY investor_key
  ORDER BY deals DESC, investor_key LIMIT 10""")
def investor_leaders(t: Tables):
    """Most active investors by distinct rounds."""
    pairs = lambda: rd.investor_pairs(rounds(t)).select("investor_key", "investor", "sr_no", "startup")
    return rd.investor_leaderboard(t.kept("pairs", pairs))


@query("rounds_single_deal_share", f"""WITH {ROUNDS}, p AS (SELECT investor_key, count(DISTINCT sr_no) AS d FROM pairs GROUP BY 1)
SELECT count(*) AS investors, round(avg((d = 1)::INT), 6) AS single_deal_share FROM p""")
def single_deal_share(t: Tables):
    """Share of investors with one round."""
    return rd.single_deal_share(rd.investor_pairs(rounds(t)))


@query("rounds_city_concentration", f"""WITH {ROUNDS} SELECT city, count(*) AS n_rounds,
  round(sum(amount_usd_adj) FILTER (amount_flag IS DISTINCT FROM 'review_outlier'), 2) AS capital,
  (SELECT round(avg(coalesce(city IN ('Bengaluru', 'Delhi', 'Gurugram', 'Noida', 'Mumbai'), false)::INT), 2) FROM rounds) AS metro_share
FROM rounds WHERE city IS NOT NULL GROUP BY city ORDER BY n_rounds DESC, city LIMIT 8""", digits=2)
def city_concentration(t: Tables):
    """Largest cities with capital and the metro share."""
    return rd.concentration(kept_rounds(t, "city", "amount_usd_adj", "amount_flag"))


@query("rounds_head_share", f"""WITH {ROUNDS}, a AS (SELECT amount_usd_adj AS v, row_number() OVER (ORDER BY amount_usd_adj DESC) AS rn FROM money),
s AS (SELECT sum(v) AS t, avg(v) AS mean, quantile_cont(v, 0.5) AS med, count(*) AS n FROM a)
SELECT h::BIGINT AS head, round((SELECT sum(v) FROM a WHERE rn <= h) / t, 6) AS share, round(mean, 2) AS mean,
       round(med, 2) AS median, round(mean / med, 6) AS mean_over_median
FROM s, unnest([10, 50, 100]) AS u(h) WHERE n >= h""")
def head_share(t: Tables):
    """Share of the largest rounds, mean and exact median."""
    d = rd.head_share(rd.money_safe(kept_rounds(t, "amount_usd_adj", "amount_flag")), "amount_usd_adj")
    return d.withColumns({"mean": F.round("mean", 2), "median": F.round("median", 2)})


@query("rounds_debris", "SELECT 0::BIGINT AS debris_cells")
def debris(t: Tables):
    """No backslash is left after cleaning."""
    return rd.debris_cells(rounds(t))


@query("rounds_raw_debris", rf"""WITH {RAW} SELECT sum((startup LIKE '%\\%')::INT + (city_raw LIKE '%\\%')::INT
  + (stage_raw LIKE '%\\%')::INT)::BIGINT AS debris_cells FROM rr""".replace(r"LIKE '%\\%'", r"LIKE '%\%'"))
def raw_debris(t: Tables):
    """The same check on the raw cells, so the zero above means something."""
    return rd.debris_cells(raw(t))


@query("rounds_naive_summary", rf"""WITH {RAW}, a AS (SELECT *, TRY_CAST(replace(amount_raw, ',', '') AS DOUBLE) AS amount FROM rr)
SELECT count(*) AS n_rounds, count(amount) AS amounts_parsed, round(sum(amount), 2) AS total,
  count(DISTINCT city_raw) AS distinct_cities, max(amount) AS largest,
  (SELECT startup FROM a WHERE amount IS NOT NULL ORDER BY amount DESC, sr_no::BIGINT LIMIT 1) AS largest_startup,
  (SELECT date_raw FROM a WHERE amount IS NOT NULL ORDER BY amount DESC, sr_no::BIGINT LIMIT 1) AS largest_date FROM a""", digits=2)
def naive_summary(t: Tables):
    """Headline figures of the uncorrected arm."""
    return rd.naive_summary(raw(t))


@query("rounds_naive_top_investors", f"""WITH {RAW}
SELECT inv_a || inv_sep || inv_b AS investors_raw, count(*) AS n FROM rr GROUP BY 1 ORDER BY n DESC, investors_raw LIMIT 5""")
def naive_top_investors(t: Tables):
    """Most frequent raw investor cells, lists not split."""
    return rd.top_counts(raw(t), "investors_raw")


@query("rounds_naive_years", f"""WITH {RAW} SELECT year(try_strptime(date_raw, '%d/%m/%Y'))::BIGINT AS year, count(*) AS n FROM rr
WHERE regexp_full_match(date_raw, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AND try_strptime(date_raw, '%d/%m/%Y') IS NOT NULL GROUP BY 1""")
def naive_years(t: Tables):
    """Rounds per year before any date is repaired."""
    return rd.naive_years(raw(t))


@query("rounds_naive_top_cities", f"WITH {RAW} SELECT city_raw, count(*) AS n FROM rr GROUP BY 1 ORDER BY n DESC, city_raw LIMIT 5")
def naive_top_cities(t: Tables):
    """Most frequent raw cities."""
    return rd.top_counts(raw(t), "city_raw")


@query("rounds_naive_top_startups", rf"""WITH {RAW} SELECT startup, coalesce(round(sum(TRY_CAST(replace(amount_raw, ',', '') AS DOUBLE)), 2), 0) AS total
  FROM rr GROUP BY 1 ORDER BY total DESC, startup LIMIT 5""", digits=2)
def naive_top_startups(t: Tables):
    """Top raw names by the uncorrected amount."""
    return (rd.naive_amounts(raw(t)).groupBy("startup").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
            .orderBy(F.desc("total"), "startup").limit(5))


# The source covers other years than the published totals; the dates are moved by whole years.
@query("rounds_coverage", f"""WITH {ROUNDS},
h AS (SELECT year + 18 AS year, count(*) AS rounds_here,
             sum(amount_usd_adj) FILTER (amount_flag IS DISTINCT FROM 'review_outlier') AS capital_here FROM rounds GROUP BY 1),
b AS (SELECT * FROM (VALUES (2015, 912, 7.9e9), (2016, 1017, 4.3e9), (2017, NULL, 10.4e9), (2018, 743, 10.6e9), (2019, 766, 14.5e9))
      AS v(year, rounds_actual, capital_actual))
SELECT year::BIGINT AS year, rounds_here, round(capital_here, 6) AS capital_here, rounds_actual::BIGINT AS rounds_actual,
  capital_actual::DOUBLE AS capital_actual, round(rounds_here / rounds_actual::DOUBLE, 6) AS deal_coverage,
  round(capital_here / capital_actual, 6) AS capital_coverage
FROM h FULL JOIN b USING (year) WHERE year BETWEEN 2015 AND 2019""")
def coverage(t: Tables):
    """Yearly totals next to published totals."""
    d = rounds(t).withColumn("year", F.col("year") + 18)
    return rd.coverage_by_year(d, vocab.PUBLISHED_DEALS, vocab.PUBLISHED_CAPITAL, 2015, 2019)


@query("rounds_yearly_median", f"""WITH {ROUNDS} SELECT r.year, round(any_value(m), 6) AS median_amount,
  round(avg((amount_usd IS NOT NULL)::INT), 6) AS disclosure FROM rounds r LEFT JOIN
  (SELECT year, quantile_cont(amount_usd_adj, 0.5) AS m FROM money GROUP BY 1) q ON q.year = r.year GROUP BY r.year""")
def yearly_median(t: Tables):
    """Exact median and disclosure per year."""
    return rd.yearly_median(kept_rounds(t, "year", "amount_usd", "amount_usd_adj", "amount_flag"))


@query("rounds_money_text", f"""WITH {ROUNDS} SELECT sr_no, CASE WHEN amount_usd IS NULL THEN '-'
  WHEN amount_usd >= 1e9 THEN printf('$%.2fB', amount_usd / 1e9) WHEN amount_usd >= 1e6 THEN printf('$%.1fM', amount_usd / 1e6)
  ELSE format('${{:,d}}', amount_usd::BIGINT) END AS amount_text FROM rounds""")
def money_text(t: Tables):
    """Short dollar text."""
    return rd.with_money_text(rounds(t), "amount_usd", "amount_text").select("sr_no", "amount_text")
