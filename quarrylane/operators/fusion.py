"""Score normalisation, channel weights, fusion and the search job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import vectors as vx
from quarrylane.operators.retrieval import channel_search, more_like_this, pool_size, substring_scores
from quarrylane.session import checkpointed

EPS = 1e-9
IMAGE_SIDE = ("image_to_image", "text_to_image", "fused_to_image")
TEXT_SIDE = ("text_to_text", "image_to_text", "fused_to_text")
CHANNELS = ("image_to_image", "image_to_text", "text_to_text", "text_to_image", "fused_to_image", "fused_to_text", "lexical")
# Search defaults.
DEFAULTS = {"strategy": "weighted_sum", "normalization": "zscore", "image_weight": 0.2, "text_weight": 0.8,
            "lexical_weight": 0.0, "cross_modal_weight": 0.3, "alpha": 0.5, "rrf_k": 60}


def with_defaults(overrides: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Configuration rows with every missing setting filled from the defaults."""
    base = {**DEFAULTS, **(defaults or {})}
    have = set(overrides.columns)
    return overrides.withColumns({
        k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in base.items()})


def channel_weights(has_image: Column, has_text: Column) -> Column:
    """Map channel -> weight from the settings of a row; weights sum to one."""
    image, text, lexical, cross = (F.col(c).cast("double") for c in (
        "image_weight", "text_weight", "lexical_weight", "cross_modal_weight"))
    zero = F.lit(0.0)
    fused = (F.col("strategy") == "embedding_fusion") & has_image & has_text
    side_i = F.when(fused | ~has_image, zero).when(has_text, image).otherwise(1.0)
    side_t = F.when(fused | ~has_text, zero).when(has_image, text).otherwise(1.0)
    raw = {
        "image_to_image": side_i * (1 - cross), "image_to_text": side_i * cross,
        "text_to_text": side_t * (1 - cross), "text_to_image": side_t * cross,
        "fused_to_image": F.when(fused, 1 - cross).otherwise(zero), "fused_to_text": F.when(fused, cross).otherwise(zero),
        "lexical": F.when(has_text, lexical).otherwise(zero)}
    total = sum((F.greatest(v, zero) for v in raw.values()), zero)
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.try_divide(v, total).alias("value")) for k, v in raw.items()]),
                       lambda e: e["value"] > 0)
    return F.map_from_entries(entries)


def normalised(df: DataFrame, method: Column, keys: Sequence[str]) -> DataFrame:
    """Rescale scores within each channel pool: none, minmax or zscore with a logistic."""
    w = Window.partitionBy(*keys)  # one candidate pool, at most the pool size
    s = F.col("score")
    lo, hi, mean, sd = F.min(s).over(w), F.max(s).over(w), F.avg(s).over(w), F.stddev_pop(s).over(w)
    d = df.withColumns({"__lo": lo, "__hi": hi, "__m": mean, "__sd": sd})
    spread = F.col("__hi") - F.col("__lo")
    minmax = F.when(spread < EPS, 1.0).otherwise((s - F.col("__lo")) / F.when(spread >= EPS, spread))
    z = (s - F.col("__m")) / F.when(F.col("__sd") >= EPS, F.col("__sd"))
    zscore = F.when(F.col("__sd") < EPS, 0.5).otherwise(1 / (1 + F.exp(-z)))
    out = F.when(method == "none", s).when(method == "minmax", minmax).otherwise(zscore)
    return d.withColumn("norm", out).drop("__lo", "__hi", "__m", "__sd")


def ranked_channels(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """1-based rank of each candidate in its channel."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(ident))
    return df.withColumn("rank", F.row_number().over(w))


def fuse(candidates: DataFrame, weights: Column, keys: Sequence[str], ident: str, strategy: Column | None = None,
         normalization: Column | None = None, rrf_k: Column | None = None) -> DataFrame:
    """One ranked list per key from all channels; an absent channel contributes nothing."""
    strategy = F.col("strategy") if strategy is None else strategy
    normalization = F.col("normalization") if normalization is None else normalization
    k = F.col("rrf_k") if rrf_k is None else rrf_k
    d = candidates.withColumn("weight", F.coalesce(F.try_element_at(weights, F.col("channel")), F.lit(0.0))).where("weight > 0")
    d = normalised(ranked_channels(d, [*keys, "channel"], ident), normalization, [*keys, "channel"])
    part = F.when(strategy == "rrf", F.col("weight") / (k + F.col("rank"))).otherwise(F.col("weight") * F.col("norm"))
    d = d.withColumn("part", part)

    def mean_of(side: Sequence[str]) -> Column:
        on = F.col("channel").isin(list(side))
        return F.sum(F.when(on, F.col("weight") * F.col("score"))) / F.sum(F.when(on, F.col("weight")))

    provenance = F.to_json(F.array_sort(F.collect_list(F.struct(  # at most one entry per channel
        "channel", F.round("score", 6).alias("raw"), F.round("norm", 6).alias("normalized"), F.round("weight", 6).alias("weight"), "rank"))))
    return d.groupBy(*keys, ident).agg(
        F.sum("part").alias("final_score"), mean_of(IMAGE_SIDE).alias("image_similarity"),
        mean_of(TEXT_SIDE).alias("text_similarity"), F.max(F.when(F.col("channel") == "lexical", F.col("score"))).alias("lexical_score"),
        provenance.alias("channels"))


def final_rank(fused: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("final_score", 9)), F.asc(ident))
    return fused.withColumn("rank", F.row_number().over(w))


def fused_query_vectors(image: DataFrame, text: DataFrame, alpha: float) -> DataFrame:
    """Blended query vectors for embedding fusion."""
    return image.join(text.withColumnRenamed("vector", "__t"), "query_id").select(
        "query_id", vx.blend(F.col("vector"), F.col("__t"), alpha).alias("vector"))


def similar_products(catalog: DataFrame, ident: str, image: str, text: str, chosen: DataFrame, k: int) -> DataFrame:
    """Neighbours of stored products, never themselves: by image where there is one.

    A product known by its text alone is looked up among texts and images by its text vector, and both lists are fused.
    """
    has = F.col(image).isNotNull()
    mine = catalog.join(chosen.select(ident), ident, "left_semi")
    by_image = more_like_this(catalog, ident, image, mine.where(has), k).select("query_id", ident, "score", "rank")
    q = mine.where(~has & F.col(text).isNotNull()).select(F.col(ident).alias("query_id"), F.col(text).alias("vector"))
    found = channel_search(catalog, ident, {"text_to_text": (text, q), "text_to_image": (image, q)}, pool_size(k))
    found = with_defaults(found.where(F.col(ident) != F.col("query_id")).drop("rank"))
    fused = fuse(found, channel_weights(F.lit(False), F.lit(True)), ["query_id"], ident, F.lit(DEFAULTS["strategy"]), F.lit(DEFAULTS["normalization"]), F.lit(DEFAULTS["rrf_k"]))
    by_text = final_rank(fused, ["query_id"], ident).where(F.col("rank") <= k)
    return by_image.unionByName(by_text.select("query_id", ident, F.col("final_score").alias("score"), "rank"))


def page_of(fused: DataFrame, products: DataFrame, ident: str, top_k: int, offset: int = 0, sort: str = "relevance") -> DataFrame:
    """One page per query with product metadata; only the page meets the catalog.

    Sorting by price or name orders all fused candidates before the page is cut.
    """
    if sort == "relevance":
        window = final_rank(fused, ["query_id"], ident).where((F.col("rank") > offset) & (F.col("rank") <= offset + top_k))
        return window.join(products, ident)
    order = {"price_asc": [F.asc_nulls_last("price")], "price_desc": [F.desc_nulls_last("price")],
             "name_asc": [F.asc(F.lower("name"))]}[sort]
    w = Window.partitionBy("query_id").orderBy(*order, F.asc(ident))
    d = fused.join(products, ident).withColumn("rank", F.row_number().over(w))
    return d.where((F.col("rank") > offset) & (F.col("rank") <= offset + top_k))


def drifted(window: DataFrame, products: DataFrame, ident: str) -> DataFrame:
    """Ranked ids without catalog metadata: the two stores have drifted apart."""
    return window.join(products.select(ident), ident, "left_anti").agg(F.count(F.lit(1)).alias("n_drifted"))


def candidates(products: DataFrame, ident: str, image_queries: DataFrame, text_queries: DataFrame,
               query_texts: DataFrame, pool: int, alpha: float = 0.5) -> DataFrame:
    """Candidate lists of every channel for a batch of queries.

    ``products`` holds ``image`` and ``text`` vectors next to its text fields, already
    filtered; the queries are tables (query_id, vector) and (query_id, query_text).
    """
    # The batch is small and read by several channels; the products are read by the vector and keyword scans.
    image_queries, text_queries = checkpointed(image_queries), checkpointed(text_queries)
    fused_q = fused_query_vectors(image_queries, text_queries, alpha)
    vec = channel_search(products, ident, {
        "image_to_image": ("image", image_queries), "image_to_text": ("text", image_queries),
        "text_to_text": ("text", text_queries), "text_to_image": ("image", text_queries),
        "fused_to_image": ("image", fused_q), "fused_to_text": ("text", fused_q)}, pool)
    lex = substring_scores(products, ident, query_texts, "query_text", ("name", "brand", "category", "subcategory", "colour", "usage"),
                           ("name", "brand", "category", "subcategory", "colour"), "name", pool)
    cols = ["query_id", "channel", ident, "score"]
    return vec.select(*cols).unionByName(lex.withColumn("channel", F.lit("lexical")).select(*cols))


def search(products: DataFrame, ident: str, image_queries: DataFrame, text_queries: DataFrame, query_texts: DataFrame,
           top_k: int, offset: int = 0, exclude: DataFrame | None = None, sort: str = "relevance", **settings) -> DataFrame:
    """The whole search for a batch: retrieve, weigh, fuse, drop self, sort, page, hydrate."""
    cfg = {**DEFAULTS, **settings}
    c = candidates(products, ident, image_queries, text_queries, query_texts, pool_size(top_k, offset), cfg["alpha"])
    c = c.withColumns({k: F.lit(v) for k, v in cfg.items()})
    yes = F.lit(True)
    f = fuse(c, channel_weights(yes, yes), ["query_id"], ident)
    if exclude is not None:
        f = f.join(exclude, ["query_id", ident], "left_anti")
    meta = products.select(ident, "name", "price", "category")
    return page_of(f, meta, ident, top_k, offset, sort)


def sweep(cands: DataFrame, configs: Sequence[dict], ident: str, has_image: bool = True, has_text: bool = True) -> DataFrame:
    """Ranked lists of many configurations in one job: each candidate row meets every configuration once.

    A configuration may name a ``pool`` depth; candidates are retrieved once at the deepest, and without a depth all count.
    """
    rows = [{**DEFAULTS, "pool": None, **c} for c in configs]
    cfg = F.explode(F.array(*[F.struct(*[(F.lit(v).cast("int") if k == "pool" else F.lit(v)).alias(k) for k, v in r.items()]) for r in rows]))
    base = ranked_channels(cands, ["query_id", "channel"], ident).withColumnRenamed("rank", "__depth")
    d = base.withColumn("cfg", cfg).select("*", "cfg.*").where(F.col("pool").isNull() | (F.col("__depth") <= F.col("pool"))).drop("cfg", "__depth", "pool")
    f = fuse(d, channel_weights(F.lit(has_image), F.lit(has_text)), ["label", "query_id"], ident,
             strategy=F.col("strategy"), normalization=F.col("normalization"), rrf_k=F.col("rrf_k"))
    return final_rank(f, ["label", "query_id"], ident).select("label", "query_id", ident, "final_score", "rank")



def experiment(name: str) -> list[dict]:
    """Configuration rows of one of the seven ranking experiments."""
    w = "weighted_sum"
    tables = {
        "channels": [{"label": "full"}, {"label": "image only", "text_weight": 0.0, "image_weight": 1.0},
                     {"label": "text only", "image_weight": 0.0, "text_weight": 1.0},
                     {"label": "same modality", "cross_modal_weight": 0.0}],
        "weights": [{"label": f"image {i / 10:.1f}", "image_weight": i / 10, "text_weight": 1 - i / 10} for i in range(0, 11)],
        "cross_modal": [{"label": f"cross {c}", "cross_modal_weight": c} for c in (0.0, 0.15, 0.3, 0.5, 0.7, 1.0)],
        "strategy": [{"label": s, "strategy": s} for s in (w, "rrf", "embedding_fusion")],
        "normalization": [{"label": n, "normalization": n} for n in ("none", "minmax", "zscore")],
        "lexical": [{"label": f"lexical {x}", "lexical_weight": x} for x in (0.0, 0.1, 0.3, 0.5)],
        "depth": [{"label": f"pool {p}", "pool": p} for p in (20, 50, 100)],
    }
    return tables[name]


EXPERIMENTS = ("channels", "weights", "cross_modal", "strategy", "normalization", "lexical", "depth")
