"""Scored documents: ``n_chars`` as score, ``labels`` as truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from quarrylane.operators import rankstats

# Scored rows shared by the SQL checks of this module.
SCORED = """
scored AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars,
         d.n_chars / (SELECT max(n_chars)::DOUBLE FROM documents) AS p,
         l.toxic::BIGINT AS y, l.quality::BIGINT AS q
  FROM documents d JOIN labels l USING (doc_id))"""


def scored(t: Tables):
    top = t.documents.agg(F.max("n_chars").cast("double").alias("m")).scalar()
    docs = t.documents.select("doc_id", "lang", "source", "n_chars",
                              (F.col("n_chars") / top).alias("p"))
    labels = t.labels.select("doc_id", F.col("toxic").cast("long").alias("y"),
                             F.col("quality").cast("long").alias("q"))
    return docs.join(labels, "doc_id")


AUC_SQL = f"""
WITH {SCORED},
c AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM scored GROUP BY p),
r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM c)
SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
       round(sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       round(sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos), 6) AS pr_auc
FROM r"""


@query("score_ranking_quality", AUC_SQL)
def ranking_quality(t: Tables):
    """ROC AUC and average precision with tied scores."""
    return rankstats.ranking_quality(scored(t), "p", "y")


BUDGET_SQL = f"""
WITH {SCORED},
f AS (SELECT unnest([0.0001, 0.0005, 0.001, 0.005, 0.01, 0.1, 0.25]::DOUBLE[]) AS budget_frac),
k AS (SELECT budget_frac, greatest(floor(budget_frac * (SELECT count(*) FROM scored)), 1)::BIGINT AS alerts FROM f),
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS rn FROM scored)
SELECT budget_frac, alerts, sum(y)::BIGINT AS caught,
       round(sum(y) / greatest((SELECT sum(y) FROM scored), 1), 6) AS recall,
       round(sum(y) / alerts::DOUBLE, 6) AS precision
FROM k JOIN r ON rn <= alerts GROUP BY budget_frac, alerts"""


@query("score_review_budgets", BUDGET_SQL)
def review_budgets(t: Tables):
    """Positives caught in the top fraction of scores, ties by document id."""
    return rankstats.review_budgets(
        scored(t), "p", "y", "doc_id", [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.1, 0.25])


MISSING = f"""
WITH {SCORED},
m AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars // 100 END AS p, y FROM scored),
c AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM m GROUP BY p),
r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC NULLS LAST) AS cp, sum(neg) OVER (ORDER BY p DESC NULLS LAST) AS cn FROM c)"""


def with_missing(t: Tables):
    """Coarse scores with many ties, NULL for every seventh length."""
    p = F.when(F.col("n_chars") % 7 != 0, F.floor(F.col("n_chars") / 100)).cast("double")
    return scored(t).withColumn("p", p)


@query("score_ranking_missing", MISSING + """
SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
       round(sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       round(sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos), 6) AS pr_auc FROM r""")
def ranking_missing(t: Tables):
    """Ranking quality where some rows have no score."""
    return rankstats.ranking_quality(with_missing(t), "p", "y")


@query("score_cumulative_missing", MISSING + " SELECT p::DOUBLE AS score, cp::BIGINT AS cum_pos, cn::BIGINT AS cum_neg FROM r")
def cumulative_missing(t: Tables):
    """Running counts by falling score, the missing score last."""
    return rankstats.cumulative_counts(with_missing(t), "p", "y").select("score", "cum_pos", "cum_neg")


@query("score_budgets_missing", MISSING + """,
f AS (SELECT unnest([0.1, 0.9, 0.99]::DOUBLE[]) AS budget_frac),
k AS (SELECT budget_frac, greatest(floor(budget_frac * (SELECT count(*) FROM m)), 1)::BIGINT AS alerts FROM f),
o AS (SELECT y, row_number() OVER (ORDER BY p DESC NULLS LAST, doc_id) AS rn FROM m)
SELECT budget_frac, alerts, sum(y)::BIGINT AS caught, round(sum(y) / greatest((SELECT sum(y) FROM m), 1), 6) AS recall,
       round(sum(y) / alerts::DOUBLE, 6) AS precision
FROM k JOIN o ON rn <= alerts GROUP BY budget_frac, alerts""")
def budgets_missing(t: Tables):
    """Review budgets that reach into the rows without a score."""
    return rankstats.review_budgets(with_missing(t), "p", "y", "doc_id", [0.1, 0.9, 0.99])
