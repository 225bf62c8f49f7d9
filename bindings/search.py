"""Retrieval over the embeddings, with part rows as metadata; one query per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.catalogue import clean_sql
from bindings.registry import Tables, query
from quarrylane.functions import vectors as vx
from quarrylane.operators import fusion, ranking, retrieval

POOL = 50
TOP = 10
K = (1, 5, 10)

PROD = """
pv AS (SELECT vec_id AS product_id, label, embedding::DOUBLE[] AS e, list_concat((embedding::DOUBLE[])[1:32], list_transform(range(32), lambda x: 0.0::DOUBLE)) AS h FROM embeddings),
pr AS MATERIALIZED (SELECT product_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS image, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS text,
  p_name AS name, p_brand AS brand, p_type AS category, split_part(p_name, ' ', 2) AS subcategory, split_part(p_name, ' ', 1) AS colour, p_retailprice AS price
  FROM pv JOIN part ON p_partkey = product_id),
qd AS (SELECT label, i, avg(image[i]) AS mi, avg(text[i]) AS mt FROM pr, range(1, 65) r(i) GROUP BY ALL),
q0 AS (SELECT label AS query_id, list(mi ORDER BY i) AS a, list(mt ORDER BY i) AS b FROM qd GROUP BY 1),
qv AS MATERIALIZED (SELECT query_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS qi, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS qt FROM q0),
qs AS (SELECT label AS query_id, arg_min(name, product_id) AS query_text, min(product_id) AS self FROM pr GROUP BY 1),
qf0 AS (SELECT query_id, list_transform(range(1, 65), lambda i: 0.5 * qi[i] + 0.5 * qt[i]) AS f FROM qv),
qf AS (SELECT query_id, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS qf FROM qf0)"""


def channel_sql(name: str, q: str, table: str, vec: str) -> str:
    return f"SELECT query_id, '{name}' AS channel, product_id, round(list_cosine_similarity({q}, {vec}), 9) AS score FROM {table}, pr"


def cand_sql(pool: int) -> str:
    parts = [channel_sql("image_to_image", "qi", "qv", "image"), channel_sql("image_to_text", "qi", "qv", "text"),
             channel_sql("text_to_text", "qt", "qv", "text"), channel_sql("text_to_image", "qt", "qv", "image"),
             channel_sql("fused_to_image", "qf", "qf", "image"), channel_sql("fused_to_text", "qf", "qf", "text")]
    lex = """SELECT query_id, 'lexical' AS channel, product_id, (contains(hay, a)::INT + contains(hay, b)::INT + contains(name, a)::INT + contains(name, b)::INT) / 4.0::DOUBLE AS score
      FROM (SELECT query_id, split_part(query_text, ' ', 1) AS a, split_part(query_text, ' ', 2) AS b FROM qs) q,
      (SELECT product_id, name, lower(concat_ws(' ', name, brand, category, subcategory, colour)) AS hay FROM pr) p WHERE contains(hay, a) OR contains(hay, b)"""
    return f"""{PROD}, every AS ({" UNION ALL ".join(parts)} UNION ALL {lex}),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, product_id) AS rank FROM every QUALIFY rank <= {pool})"""


def products(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("product_id"), "label", "embedding")
    half = F.concat(F.slice("embedding", 1, 32), F.array_repeat(F.lit(0.0).cast("float"), 32))
    p = t.part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("subcategory"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour"),
        F.lit("").alias("usage"), F.col("p_retailprice").alias("price"))
    return e.join(p, "product_id").withColumns({"image": vx.unit(F.col("embedding")), "text": vx.unit(half)}).drop("embedding")


def batch(p):
    """Query vectors and texts: the mean product of each label, and its first product's name."""
    texts = p.groupBy(F.col("label").alias("query_id")).agg(F.min_by("name", "product_id").alias("query_text"))
    return retrieval.mean_vectors(p, "label", "image"), retrieval.mean_vectors(p, "label", "text"), texts


def selves(p):
    return p.groupBy(F.col("label").alias("query_id")).agg(F.min("product_id").alias("product_id"))


def asked():
    """The query set of searches by product."""
    return F.col("product_id") % 100 == 0


def cands(t: Tables, pool: int = POOL):
    p = products(t)
    return fusion.candidates(p, "product_id", *batch(p), pool)


@query("search_cosine_top_k", f"WITH {PROD}, s AS ({channel_sql('x', 'qi', 'qv', 'image')}) SELECT query_id::BIGINT AS query_id, product_id, round(score, 6) AS score, "
       "row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, product_id) AS rank FROM s QUALIFY rank <= 20")
def cosine_top_k(t: Tables):
    """Exact cosine top-20 of a query batch."""
    p = products(t)
    return retrieval.cosine_top_k(p, "product_id", "image", batch(p)[0], 20)


@query("search_cosine_filtered", f"WITH {PROD}, s AS ({channel_sql('x', 'qi', 'qv', 'image')}) SELECT query_id::BIGINT AS query_id, product_id, round(score, 6) AS score, "
       "row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, product_id) AS rank FROM s WHERE product_id IN (SELECT product_id FROM pr WHERE category = 'PROMO') AND s.score >= 0.1 QUALIFY rank <= 20")
def cosine_filtered(t: Tables):
    """Filters first, then the search, with a score threshold."""
    p = products(t)
    return retrieval.cosine_top_k(p.where("category = 'PROMO'"), "product_id", "image", batch(p)[0], 20, threshold=0.1)


@query("search_candidates", f"WITH {cand_sql(POOL)} SELECT query_id::BIGINT AS query_id, channel, product_id, round(score, 6) AS score FROM cand")
def all_candidates(t: Tables):
    """Candidate lists of seven channels."""
    return cands(t)


@query("search_lexical", f"WITH {cand_sql(POOL)} SELECT query_id::BIGINT AS query_id, product_id, round(score, 6) AS score, rank FROM cand WHERE channel = 'lexical'")
def lexical(t: Tables):
    """Substring keyword channel."""
    p = products(t)
    return retrieval.substring_scores(p, "product_id", batch(p)[2], "query_text", ("name", "brand", "category", "subcategory", "colour", "usage"),
                                      ("name", "brand", "category", "subcategory", "colour"), "name", POOL)


@query("search_weighted_terms", """WITH q AS (SELECT DISTINCT p_name AS query_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
s AS (SELECT query_id, p_partkey AS product_id, 2.0 + CASE WHEN b = split_part(p_name, ' ', 2) THEN 0.4 ELSE 0 END + CASE WHEN lower(p_type) IN (a, b) THEN 0.4 ELSE 0 END AS score
  FROM q JOIN part ON p_name = query_id)
SELECT query_id, product_id, round(score::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, product_id) AS rank FROM s QUALIFY rank <= 10""")
def weighted_terms(t: Tables):
    """All terms required, ranked by field weights, for every distinct part name."""
    c = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
                      F.split_part("p_name", F.lit(" "), F.lit(2)).alias("subcategory"))
    q = t.part.select(F.col("p_name").alias("query_id"), "p_name").distinct()
    return retrieval.all_terms_scores(c, "product_id", q, "p_name", 10, {"name": 2 * 0.5, "category": 0.4, "subcategory": 0.4})


TERMS = "list_distinct(list_filter(string_split_regex(replace(lower({c}), 'ß', 'ss'), '[^0-9a-z]+'), lambda x: length(x) >= 2))"


@query("search_every_term", f"""WITH d AS (SELECT doc_id, {TERMS.format(c=clean_sql('text'))} AS t FROM documents), q AS (SELECT item_id AS query_id, {TERMS.format(c=clean_sql('text'))} AS n FROM benchmark)
SELECT query_id, doc_id FROM d, q WHERE list_has_all(t, n) AND len(n) > 0""")
def every_term(t: Tables):
    """Documents that hold every term of a benchmark text, found by its rarest term."""
    return retrieval.holding_every_term(t.spread("documents").select("doc_id", "text"), "doc_id", "text", t.benchmark.withColumnRenamed("item_id", "query_id"), "text")


@query("search_more_like_this", f"""WITH {PROD}, s AS (SELECT a.product_id AS query_id, b.product_id, round(list_cosine_similarity(a.image, b.image), 9) AS score
  FROM pr a, pr b WHERE a.product_id % 100 = 0 AND a.product_id <> b.product_id)
SELECT query_id, product_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, product_id) AS rank FROM s QUALIFY rank <= 10""")
def more_like_this(t: Tables):
    """Neighbours of each product whose id 100 divides, itself left out."""
    p = products(t)
    return retrieval.more_like_this(p, "product_id", "image", p.where(asked()), 10)


@query("search_pruned", f"""WITH {PROD}, s AS (SELECT a.product_id AS query_id, b.product_id, round(list_cosine_similarity(a.image, b.text), 9) AS score FROM pr a, pr b WHERE a.product_id % 100 = 0)
SELECT query_id, product_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, product_id) AS rank FROM s QUALIFY rank <= 10""")
def pruned(t: Tables):
    """Image against text through cells of the catalog, most of which a query can skip."""
    p = t.kept("products", lambda: products(t))
    q = p.where(asked()).select(F.col("product_id").alias("query_id"), F.col("image").alias("vector"))
    return retrieval.pruned_top_k(p, "product_id", "text", q, 10)


@query("search_similar_products", f"""WITH {PROD}, mx AS (SELECT * REPLACE (CASE WHEN product_id % 3 = 0 THEN NULL ELSE image END AS image) FROM pr),
qq AS (SELECT product_id AS query_id FROM mx WHERE product_id % 100 = 0),
ii AS (SELECT q.query_id, b.product_id, round(list_cosine_similarity(a.image, b.image), 9) AS score FROM qq q JOIN mx a ON a.product_id = q.query_id, mx b
  WHERE a.image IS NOT NULL AND b.image IS NOT NULL AND a.product_id <> b.product_id),
ti0 AS (SELECT q.query_id, 'text_to_text' AS channel, 0.7 AS w, b.product_id, round(list_cosine_similarity(a.text, b.text), 9) AS score FROM qq q JOIN mx a ON a.product_id = q.query_id, mx b WHERE a.image IS NULL
  UNION ALL SELECT q.query_id, 'text_to_image', 0.3, b.product_id, round(list_cosine_similarity(a.text, b.image), 9) FROM qq q JOIN mx a ON a.product_id = q.query_id, mx b WHERE a.image IS NULL AND b.image IS NOT NULL),
ti1 AS (SELECT * FROM ti0 QUALIFY row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, product_id) <= 50),
ti2 AS (SELECT *, avg(score) OVER c AS m, stddev_pop(score) OVER c AS sd FROM ti1 WHERE product_id <> query_id WINDOW c AS (PARTITION BY query_id, channel)),
tt AS (SELECT query_id, product_id, sum(w * CASE WHEN sd < 1e-9 THEN 0.5 ELSE 1 / (1 + exp(-(score - m) / sd)) END) AS score FROM ti2 GROUP BY 1, 2),
al AS (SELECT *, score AS o FROM ii UNION ALL SELECT *, round(score, 9) FROM tt)
SELECT query_id, product_id, round(score::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, product_id) AS rank FROM al QUALIFY rank <= 10""")
def similar_products(t: Tables):
    """Neighbours of each product whose id 100 divides; a third of them are known by their text alone."""
    p = products(t).withColumn("image", F.when(F.col("product_id") % 3 != 0, F.col("image")))
    return fusion.similar_products(p, "product_id", "image", "text", p.where(asked()), 10)


# Settings as rows; NULL means the default.
SETTINGS = [("default", None, None, None, None), ("equal", None, 0.5, 0.5, None), ("lexical", None, None, None, 0.3), ("embedding", "embedding_fusion", None, None, 0.1)]


@query("search_channel_weights", """WITH s AS (SELECT * FROM (VALUES ('default', 'weighted_sum', 0.2, 0.8, 0.0), ('equal', 'weighted_sum', 0.5, 0.5, 0.0), ('lexical', 'weighted_sum', 0.2, 0.8, 0.3),
  ('embedding', 'embedding_fusion', 0.2, 0.8, 0.1)) v(label, strategy, i, t, l)),
m AS (SELECT unnest(['both', 'image', 'text']) AS mode, count(*) AS n FROM embeddings GROUP BY 1),
r AS (SELECT label, mode, n, strategy = 'embedding_fusion' AND mode = 'both' AS f, CASE WHEN mode = 'both' THEN i WHEN mode = 'image' THEN 1.0 ELSE 0 END AS i, CASE WHEN mode = 'both' THEN t WHEN mode = 'text' THEN 1.0 ELSE 0 END AS t,
  CASE WHEN mode <> 'image' THEN l ELSE 0 END AS l FROM s, m),
w AS (SELECT label, mode, n, unnest([{'c': 'image_to_image', 'w': CASE WHEN f THEN 0 ELSE i * 0.7 END}, {'c': 'image_to_text', 'w': CASE WHEN f THEN 0 ELSE i * 0.3 END}, {'c': 'text_to_text', 'w': CASE WHEN f THEN 0 ELSE t * 0.7 END},
  {'c': 'text_to_image', 'w': CASE WHEN f THEN 0 ELSE t * 0.3 END}, {'c': 'fused_to_image', 'w': CASE WHEN f THEN 0.7 ELSE 0 END}, {'c': 'fused_to_text', 'w': CASE WHEN f THEN 0.3 ELSE 0 END}, {'c': 'lexical', 'w': l}]) AS x FROM r)
SELECT label, mode, n AS n_products, x.c AS channel, round(x.w::DOUBLE / sum(x.w::DOUBLE) OVER (PARTITION BY label, mode), 6) AS weight FROM w QUALIFY x.w > 0""")
def channel_weights(t: Tables):
    """Defaults filled in and weights resolved per query modality."""
    s = t.spark.createDataFrame(SETTINGS, "label string, strategy string, image_weight double, text_weight double, lexical_weight double")
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = fusion.with_defaults(s).withColumns({"mode": F.explode(F.array(F.lit("both"), F.lit("image"), F.lit("text"))), "n_products": n})
    w = fusion.channel_weights(F.col("mode") != "text", F.col("mode") != "image")
    return d.select("label", "mode", "n_products", F.explode(w).alias("channel", "weight"))


def norm_sql(method: str, part: str = "query_id, channel") -> str:
    w = f"OVER (PARTITION BY {part})"
    mm = f"CASE WHEN max(score) {w} - min(score) {w} < 1e-9 THEN 1.0 ELSE (score - min(score) {w}) / (max(score) {w} - min(score) {w}) END"
    zz = f"CASE WHEN stddev_pop(score) {w} < 1e-9 THEN 0.5 ELSE 1 / (1 + exp(-(score - avg(score) {w}) / stddev_pop(score) {w})) END"
    return {"none": "score", "minmax": mm, "zscore": zz}[method]


@query("search_normalised", f"WITH {cand_sql(POOL)} SELECT query_id::BIGINT AS query_id, channel, product_id, rank, round({norm_sql('none')}, 6) AS plain, round({norm_sql('minmax')}, 6) AS minmax, "
       f"round({norm_sql('zscore')}, 6) AS zscore FROM cand")
def normalised(t: Tables):
    """Rank in the channel and three normalisations of each pool."""
    c = fusion.ranked_channels(cands(t), ["query_id", "channel"], "product_id")
    for m, n in (("none", "plain"), ("minmax", "minmax"), ("zscore", "zscore")):
        c = fusion.normalised(c, F.lit(m), ["query_id", "channel"]).withColumnRenamed("norm", n)
    return c.drop("score")


# Default weights over both modalities: 0.2 / 0.8, cross-modal share 0.3.
W = {"image_to_image": 0.2 * 0.7, "image_to_text": 0.2 * 0.3, "text_to_text": 0.8 * 0.7, "text_to_image": 0.8 * 0.3}
WSQL = "CASE channel " + " ".join(f"WHEN '{c}' THEN {v!r}::DOUBLE" for c, v in W.items()) + " ELSE 0 END"


def fused_sql(part: str = "w * norm", method: str = "zscore", pool: int = POOL) -> str:
    return f"""WITH {cand_sql(pool)}, nm AS (SELECT *, {WSQL} AS w, {norm_sql(method)} AS norm FROM cand),
fu AS (SELECT query_id, product_id, sum({part}) AS final_score, sum(w * score) FILTER (channel LIKE '%_to_image') / sum(w) FILTER (channel LIKE '%_to_image') AS image_similarity,
  sum(w * score) FILTER (channel LIKE '%_to_text') / sum(w) FILTER (channel LIKE '%_to_text') AS text_similarity, count(*) AS n_channels FROM nm WHERE w > 0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, product_id) AS rank FROM fu)"""


def fused(t: Tables, **settings):
    cfg = {**fusion.DEFAULTS, **settings}
    c = cands(t).withColumns({k: F.lit(v) for k, v in cfg.items()})
    yes = F.lit(True)
    return fusion.fuse(c, fusion.channel_weights(yes, yes), ["query_id"], "product_id")


FUSED_COLS = "query_id::BIGINT AS query_id, product_id, round(final_score, 6) AS final_score, round(image_similarity, 6) AS image_similarity, round(text_similarity, 6) AS text_similarity, rank, n_channels"


@query("search_weighted_sum", fused_sql() + f" SELECT {FUSED_COLS} FROM rk")
def weighted_sum(t: Tables):
    """Weighted-sum fusion with raw averages per side and provenance."""
    f = fusion.final_rank(fused(t), ["query_id"], "product_id")
    n = F.size(F.from_json("channels", "array<struct<channel:string>>"))
    return f.withColumn("n_channels", n).drop("channels", "lexical_score")


@query("search_reciprocal_rank", fused_sql("w / (60 + rank)") + f" SELECT {FUSED_COLS.replace(', n_channels', '')} FROM rk")
def reciprocal_rank(t: Tables):
    """Reciprocal rank fusion."""
    return fusion.final_rank(fused(t, strategy="rrf"), ["query_id"], "product_id").drop("channels", "lexical_score")


@query("search_embedding_fusion", fused_sql().replace(WSQL, "CASE channel WHEN 'fused_to_image' THEN 0.7::DOUBLE WHEN 'fused_to_text' THEN 0.3 ELSE 0 END")
       + " SELECT query_id::BIGINT AS query_id, product_id, round(final_score, 6) AS final_score, rank FROM rk")
def embedding_fusion(t: Tables):
    """Vectors blended before the search."""
    return fusion.final_rank(fused(t, strategy="embedding_fusion"), ["query_id"], "product_id").select("query_id", "product_id", "final_score", "rank")


@query("search_end_to_end", fused_sql() + f""", ok AS (SELECT fu.* FROM fu JOIN qs USING (query_id) WHERE product_id <> self),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, product_id) AS rank FROM ok QUALIFY rank <= {TOP})
SELECT query_id::BIGINT AS query_id, rank, product_id, round(final_score, 6) AS final_score, name, price FROM o JOIN pr USING (product_id)""")
def end_to_end(t: Tables):
    """Retrieve, weigh, fuse, drop self, cut the page and hydrate it."""
    p = products(t)
    r = fusion.search(p, "product_id", *batch(p), TOP, exclude=selves(p))
    return r.select("query_id", "rank", "product_id", "final_score", "name", "price")


@query("search_sorted_by_price", fused_sql() + f""", o AS (SELECT query_id, product_id, price, row_number() OVER (PARTITION BY query_id ORDER BY price DESC NULLS LAST, product_id) AS rank FROM fu JOIN pr USING (product_id) QUALIFY rank <= {TOP})
SELECT query_id::BIGINT AS query_id, rank, product_id, price FROM o""")
def sorted_by_price(t: Tables):
    """Candidates sorted by price after fusion."""
    p = products(t)
    return fusion.page_of(fused(t), p.select("product_id", "name", "price"), "product_id", TOP, sort="price_desc").select("query_id", "rank", "product_id", "price")


@query("search_drift", fused_sql() + " SELECT count(*) AS n_drifted FROM rk WHERE rank <= 10 AND product_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def drift(t: Tables):
    """Ranked ids whose metadata is gone."""
    window = fusion.final_rank(fused(t), ["query_id"], "product_id").where("rank <= 10")
    meta = t.part.where("p_size > 5").select(F.col("p_partkey").alias("product_id"))
    return fusion.drifted(window, meta, "product_id")


def metrics_sql(ranked: str, keys: str) -> str:
    cols = ", ".join(
        f"count(*) FILTER (rel AND rank <= {k}) / {k}.0::DOUBLE AS precision_{k}, count(*) FILTER (rel AND rank <= {k}) / any_value(n_relevant)::DOUBLE AS recall_{k}, "
        f"coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= {k}), 0) / list_sum(list_transform(range(1, least({k}, any_value(n_relevant))::INT + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}" for k in K)
    return f""", nr AS (SELECT label AS query_id, count(*) AS n_relevant FROM pr GROUP BY 1),
rl AS (SELECT x.*, pr.label = x.query_id AS rel, n_relevant, sum((pr.label = x.query_id)::INT) OVER (PARTITION BY {", ".join("x." + c for c in keys.split(", "))} ORDER BY rank) AS hits FROM ({ranked}) x JOIN pr USING (product_id) JOIN nr ON nr.query_id = x.query_id),
qm AS (SELECT {keys}, any_value(n_relevant) AS n_relevant, count(*) AS retrieved, min(rank) FILTER (rel) AS first_relevant_rank,
  coalesce(sum(hits / rank::DOUBLE) FILTER (rel AND rank <= {max(K)}), 0) / least(any_value(n_relevant), {max(K)}) AS average_precision, coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0) AS reciprocal_rank, {cols} FROM rl GROUP BY ALL)"""


MCOLS = ["average_precision", "reciprocal_rank", *(f"{m}_{k}" for k in K for m in ("precision", "recall", "ndcg"))]
MROUND = ", ".join(f"round({c}, 6) AS {c}" for c in MCOLS)


def judged(ranked, p):
    return ranked.join(p.select("product_id", "label"), "product_id").withColumn("is_relevant", F.col("label") == F.col("query_id")).drop("label")


def counts(p):
    return p.groupBy(F.col("label").alias("query_id")).agg(F.count(F.lit(1)).alias("n_relevant"))


@query("ranking_query_scores", fused_sql() + metrics_sql("SELECT query_id, product_id, rank FROM rk", "query_id")
       + f" SELECT query_id::BIGINT AS query_id, n_relevant, retrieved, first_relevant_rank, {MROUND} FROM qm")
def query_scores(t: Tables):
    """Precision, recall, nDCG, AP and RR per query."""
    p = products(t)
    r = fusion.final_rank(fused(t), ["query_id"], "product_id").select("query_id", "product_id", "rank")
    return ranking.query_scores(judged(r, p), counts(p), K)


@query("ranking_summary", fused_sql() + metrics_sql("SELECT query_id, product_id, rank FROM rk", "query_id") + " SELECT count(*) AS queries, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, "
       + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in K for m in ("precision", "recall", "ndcg")) + " FROM qm")
def summary(t: Tables):
    """Macro average over queries."""
    p = products(t)
    r = fusion.final_rank(fused(t), ["query_id"], "product_id").select("query_id", "product_id", "rank")
    return ranking.macro_summary(ranking.query_scores(judged(r, p), counts(p), K), K)


@query("ranking_nearest_rank", """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS c FROM u)
SELECT n AS p FROM o WHERE i = greatest(1, ceil(0.95 * c))""")
def nearest_rank(t: Tables):
    """Nearest-rank 95th percentile of a per-key number."""
    per = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return ranking.nearest_rank(per, "n", 0.95).select(F.col("p").cast("long").alias("p"))


def config_sql(c: dict) -> str:
    r = {**fusion.DEFAULTS, "pool": "NULL::INTEGER", **c}
    x = r["cross_modal_weight"]
    if r["strategy"] == "embedding_fusion":
        w = {"fused_to_image": 1 - x, "fused_to_text": x}
    else:
        w = {"image_to_image": r["image_weight"] * (1 - x), "image_to_text": r["image_weight"] * x,
             "text_to_text": r["text_weight"] * (1 - x), "text_to_image": r["text_weight"] * x}
    w["lexical"] = r["lexical_weight"]
    w = {k: v for k, v in w.items() if v > 0}
    total = sum(w.values())
    body = "\n".join(
        f"SELECT '{r['label']}' AS label, '{r['strategy']}' AS strategy, '{r['normalization']}' AS nm, {r['pool']} AS pool, '{k}' AS channel, {v / total!r}::DOUBLE AS w UNION ALL" for k, v in w.items())
    return body


def sweep_sql(configs: list[dict]) -> str:
    rows = "\n".join(config_sql(c) for c in configs)
    part = "label, query_id, channel"
    return f"""WITH {cand_sql(100)}, cf AS ({rows.removesuffix('UNION ALL')}),
cx AS (SELECT label, strategy, nm, w, query_id, c.channel, product_id, score, row_number() OVER (PARTITION BY label, query_id, c.channel ORDER BY score DESC, product_id) AS rank FROM cand c JOIN cf ON cf.channel = c.channel AND (pool IS NULL OR c.rank <= pool)),
nn AS (SELECT *, CASE nm WHEN 'none' THEN {norm_sql('none', part)} WHEN 'minmax' THEN {norm_sql('minmax', part)} ELSE {norm_sql('zscore', part)} END AS norm FROM cx),
fs AS (SELECT label, query_id, product_id, sum(CASE WHEN strategy = 'rrf' THEN w / (60 + rank) ELSE w * norm END) AS s FROM nn GROUP BY ALL),
rk AS (SELECT label, query_id, product_id, row_number() OVER (PARTITION BY label, query_id ORDER BY round(s, 9) DESC, product_id) AS rank FROM fs)""" + metrics_sql(
        "SELECT label, query_id, product_id, rank FROM rk", "label, query_id") + """
SELECT label, count(*) AS queries, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, """ + ", ".join(
        f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in K for m in ("precision", "recall", "ndcg")) + " FROM qm GROUP BY label"


def sweep_summary(t: Tables, configs: list[dict]):
    p = products(t)
    c = fusion.candidates(p, "product_id", *batch(p), 100)
    r = fusion.sweep(c, configs, "product_id").select("label", "query_id", "product_id", "rank")
    lab = p.select("product_id", F.col("label").alias("__l"))
    j = r.join(lab, "product_id").withColumn("is_relevant", F.col("__l") == F.col("query_id")).drop("__l")
    return ranking.macro_summary(ranking.query_scores(j, counts(p), K, ["label", "query_id"]), K, ["label"])


def _experiment(name: str):
    @query(f"ranking_experiment_{name}", sweep_sql(fusion.experiment(name)))
    def run(t: Tables):
        return sweep_summary(t, fusion.experiment(name))
    run.__doc__ = f"Experiment {name}: every configuration in one job."


for _name in fusion.EXPERIMENTS:
    _experiment(_name)


@query("ranking_sweep_all", sweep_sql([{**c, "label": f"{e}: {c['label']}"} for e in fusion.EXPERIMENTS for c in fusion.experiment(e)]))
def sweep_all(t: Tables):
    """All experiments in one job."""
    return sweep_summary(t, [{**c, "label": f"{e}: {c['label']}"} for e in fusion.EXPERIMENTS for c in fusion.experiment(e)])


RULES = """WITH pp AS (SELECT p_partkey AS product_id, lower(p_type) AS c, split_part(p_name, ' ', 1) AS co, lower(p_brand) AS b FROM part),
ru AS (SELECT p_brand AS query_id, lower(p_brand) AS b, list_distinct(list(lower(p_type))) AS cs, list_distinct(list(split_part(p_name, ' ', 1))) AS cos, min(p_partkey) AS x FROM part WHERE p_size > 40 GROUP BY 1),
rp AS (SELECT query_id, product_id FROM ru, pp WHERE pp.b = ru.b AND list_contains(cs, c) AND list_contains(cos, co) AND product_id <> x)"""


def rules(t: Tables):
    """One rule per brand: the types and colours of its large parts, its first large part excluded."""
    large = t.part.where("p_size > 40")
    return large.groupBy(F.col("p_brand").alias("query_id")).agg(
        F.collect_set(F.upper("p_type")).alias("categories"), F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("colours"),
        F.array(F.first("p_brand")).alias("brands"), F.array(F.min("p_partkey").cast("string")).alias("exclude_ids"))


def rule_products(t: Tables):
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"),
                         F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour"), F.col("p_brand").alias("brand"))


FIELDS = {"categories": "category", "colours": "colour", "brands": "brand"}


@query("ranking_relevant_pairs", RULES + " SELECT query_id, product_id FROM rp")
def relevant_pairs(t: Tables):
    """Products that satisfy every field of a rule."""
    return ranking.relevant_pairs(rules(t), rule_products(t), "product_id", FIELDS)


@query("ranking_runnable", RULES + """ SELECT ru.query_id, count(rp.product_id) AS n_relevant, CASE WHEN count(rp.product_id) < 2 THEN 'only ' || count(rp.product_id) || ' relevant product(s) in this catalogue' END AS skip_reason
  FROM ru LEFT JOIN rp USING (query_id) GROUP BY 1""")
def runnable(t: Tables):
    """Relevant products per query and why a query is skipped."""
    r = rules(t)
    return ranking.runnable(r, ranking.relevant_pairs(r, rule_products(t), "product_id", FIELDS))


@query("search_alignment", f"""WITH {PROD} SELECT (SELECT count(*) FROM pr) AS pairs, round(avg(list_dot_product(a.image, b.text)) FILTER (a.product_id = b.product_id), 6) AS matched,
  round(avg(list_dot_product(a.image, b.text)) FILTER (a.product_id <> b.product_id), 6) AS mismatched, round(avg(list_dot_product(a.image, b.image)) FILTER (a.product_id <> b.product_id), 6) AS within_a,
  round(avg(list_dot_product(a.text, b.text)) FILTER (a.product_id <> b.product_id), 6) AS within_b FROM pr a, pr b""")
def alignment(t: Tables):
    """Matched and mismatched similarity of two vector sides, without crossing them."""
    return retrieval.alignment(products(t), "product_id", "image", "text")


@query("search_own_match_rate", f"""WITH {PROD}, s AS (SELECT a.product_id AS i, b.product_id AS j, round(list_cosine_similarity(a.image, b.text), 9) AS c FROM pr a, pr b WHERE a.product_id % 100 = 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) = 1) SELECT count(*) AS pairs, round(avg((i = j)::INT), 6) AS top1 FROM b""")
def own_match_rate(t: Tables):
    """Share of products (ids that 100 divides) whose best match among all texts is their own."""
    return retrieval.own_match_rate(products(t), "product_id", "image", "text", asked())


@query("vectors_unit_and_blend", f"WITH {PROD}, x AS (SELECT product_id, list_transform(range(1, 65), lambda i: 0.3 * image[i] + 0.7 * text[i]) AS b FROM pr) "
       "SELECT product_id, round(sqrt(list_dot_product(b, b)), 6) AS raw_norm, round(b[1] / sqrt(list_dot_product(b, b)), 6) AS first_value FROM x")
def unit_and_blend(t: Tables):
    """Unit vectors blended and scaled back to length one."""
    p = products(t)
    mixed = F.zip_with("image", "text", lambda x, y: F.lit(0.3) * x + F.lit(0.7) * y)
    return p.select("product_id", vx.norm(mixed).alias("raw_norm"), F.get(vx.blend(F.col("image"), F.col("text"), 0.3), F.lit(0)).alias("first_value"))
