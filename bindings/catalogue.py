"""Product catalog derived from the part table; text jobs over documents and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings.registry import Tables, hash_number_sql, hash_sql, query
from quarrylane.functions import text as tx
from quarrylane.functions import vocab
from quarrylane.operators import audit, splits
from quarrylane.operators import catalog as ct
from quarrylane.sources import sinks
from quarrylane.sources.versions import TableSet

MODEL = "encoder-base"

# Text rows as a file would hold them: blank names, bad and negative prices, years written
# as floats, and ids that come twice.
CSV = """
src AS (SELECT p_partkey AS line, 1 AS copy, * FROM part UNION ALL SELECT p_partkey + 1000000000, 2, * FROM part WHERE p_size = 4),
csv AS (SELECT line, ' P' || p_partkey || ' ' AS external_id, CASE WHEN p_size = 1 THEN '  ' ELSE p_name END AS name, p_type AS category,
  split_part(p_name, ' ', 2) AS subcategory, p_brand AS brand, split_part(p_name, ' ', 1) AS colour,
  CASE WHEN p_size < 17 THEN 'Men' WHEN p_size < 34 THEN 'Women' ELSE 'Unisex' END AS gender,
  CASE p_type WHEN 'ECONOMY' THEN 'Casual' WHEN 'PROMO' THEN 'Party' ELSE 'Formal' END AS usage,
  CASE WHEN p_size = 5 THEN '1800' ELSE (2000 + p_size)::VARCHAR || '.0' END AS year,
  CASE p_size WHEN 2 THEN 'abc' WHEN 3 THEN '-5' ELSE ((floor(p_retailprice) + copy)::BIGINT)::VARCHAR END AS price,
  CASE WHEN p_size = 6 THEN 'u1' ELSE 'usd' END AS currency, CASE WHEN p_size > 40 THEN 'no' ELSE 'TRUE' END AS in_stock, p_size, p_partkey FROM src),
good0 AS (SELECT * FROM csv WHERE p_size NOT IN (1, 3, 5, 6)),
prod AS (SELECT trim(external_id) AS external_id, name, category, subcategory, brand, colour, gender, usage, (2000 + p_size)::BIGINT AS year,
  TRY_CAST(price AS DOUBLE) AS price, 'USD' AS currency, p_size <= 40 AS in_stock, p_size, p_partkey FROM good0
  QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY line DESC) = 1)"""


def file_rows(t: Tables):
    p = t.part
    both = p.select(F.col("p_partkey").alias("line"), F.lit(1).alias("copy"), "*").unionByName(
        p.where("p_size = 4").select((F.col("p_partkey") + 1000000000).alias("line"), F.lit(2).alias("copy"), "*"))
    size, kind = F.col("p_size"), F.col("p_type")
    return both.select(
        "line", F.concat(F.lit(" P"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("external_id"),
        F.when(size == 1, "  ").otherwise(F.col("p_name")).alias("name"), F.lit("").alias("description"), kind.alias("category"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("subcategory"), F.col("p_brand").alias("brand"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour"),
        F.when(size < 17, "Men").when(size < 34, "Women").otherwise("Unisex").alias("gender"),
        F.when(kind == "ECONOMY", "Casual").when(kind == "PROMO", "Party").otherwise("Formal").alias("usage"),
        F.lit(None).cast("string").alias("season"),
        F.when(size == 5, "1800").otherwise(F.concat((size + 2000).cast("string"), F.lit(".0"))).alias("year"),
        F.when(size == 2, "abc").when(size == 3, "-5").otherwise((F.floor("p_retailprice") + F.col("copy")).cast("string")).alias("price"),
        F.when(size == 6, "u1").otherwise("usd").alias("currency"), F.lit(None).cast("string").alias("image_url"),
        F.when(size > 40, "no").otherwise("TRUE").alias("in_stock"), "p_size", "p_partkey")


def products(t: Tables):
    return ct.validated(file_rows(t), "line")[0].drop("line")


CORE = ["external_id", "name", "category", "subcategory", "brand", "colour", "gender", "usage", "year", "price", "currency", "in_stock"]
CORE_SQL = ", ".join(CORE)


@query("catalog_accepted_rows", f"WITH {CSV} SELECT {CORE_SQL} FROM prod")
def accepted(t: Tables):
    """Typed rows that pass every constraint; the last of a repeated id wins."""
    return ct.validated(file_rows(t), "line")[0].select(*CORE)


@query("catalog_rejected_rows", f"""WITH {CSV} SELECT line, trim(external_id) AS external_id,
  CASE p_size WHEN 1 THEN 'name' WHEN 3 THEN 'price' WHEN 5 THEN 'year' ELSE 'currency' END AS reason FROM csv WHERE p_size IN (1, 3, 5, 6)""")
def rejected(t: Tables):
    """Rows that break a constraint, with the field that broke it."""
    return ct.validated(file_rows(t), "line")[1]


@query("catalog_first_errors", f"""WITH {CSV} SELECT line, trim(external_id) AS external_id,
  CASE p_size WHEN 1 THEN 'name' WHEN 3 THEN 'price' WHEN 5 THEN 'year' ELSE 'currency' END AS reason FROM csv WHERE p_size IN (1, 3, 5, 6) ORDER BY line LIMIT 100""")
def first_errors(t: Tables):
    """The first hundred errors of a load."""
    return ct.first_errors(ct.validated(file_rows(t), "line")[1], "line")


def merged(t: Tables):
    p = products(t)
    current = p.where("p_size <= 30")
    incoming = p.where("p_size >= 20").withColumn("price", F.col("price") + 1)
    return ct.upsert(current, incoming, "external_id")


@query("catalog_upsert", f"""WITH {CSV} SELECT external_id, name, CASE WHEN p_size >= 20 THEN price + 1 ELSE price END AS price,
  CASE WHEN p_size < 20 THEN 'kept' WHEN p_size <= 30 THEN 'updated' ELSE 'created' END AS change FROM prod""")
def upsert(t: Tables):
    """Matching ids updated, others inserted."""
    return merged(t).select("external_id", "name", "price", "change")


@query("catalog_load_report", f"""WITH {CSV} SELECT (SELECT count(*) FROM csv) AS total_rows, count(*) FILTER (p_size > 30) AS created,
  count(*) FILTER (p_size BETWEEN 20 AND 30) AS updated, (SELECT count(*) FROM csv WHERE p_size IN (1, 3, 5, 6)) AS invalid,
  (SELECT count(*) FROM part WHERE p_size = 4) AS duplicates_in_file FROM prod""")
def load_report(t: Tables):
    """Counts of one batch load."""
    rows = file_rows(t)
    _, bad, replaced = ct.validated(rows, "line")
    return ct.load_report(rows, bad, replaced, merged(t))


@query("catalog_replace_vectors", """SELECT vec_id, label::BIGINT AS label, CASE WHEN label >= 5 THEN 'new' ELSE 'old' END AS version FROM embeddings""")
def replace_vectors(t: Tables):
    """Vector rows replaced by id."""
    e = t.embeddings.select("vec_id", "label")
    old = e.where("label < 7").withColumn("version", F.lit("old"))
    return ct.replace_by_id(old, e.where("label >= 5").withColumn("version", F.lit("new")), "vec_id")


@query("catalog_delete_vectors", "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE label <> 3")
def delete_vectors(t: Tables):
    """Vector rows deleted by id."""
    e = t.embeddings.select("vec_id", "label")
    return ct.delete_by_id(e, e.where("label = 3"), "vec_id")


@query("catalog_versions", """WITH v AS (SELECT vec_id, label, label >= 5 AS fresh FROM embeddings), p AS (SELECT p_partkey AS vec_id FROM part),
gone AS (SELECT vec_id FROM embeddings WHERE label = 3),
s AS (SELECT 1 AS version, 'vectors' AS name, vec_id, false AS fresh FROM v WHERE label < 7 UNION ALL SELECT 1, 'products', vec_id, false FROM p
  UNION ALL SELECT 2, 'vectors', vec_id, fresh FROM v UNION ALL SELECT 2, 'products', vec_id, false FROM p
  UNION ALL SELECT 3, 'vectors', vec_id, fresh FROM v WHERE vec_id NOT IN (FROM gone) UNION ALL SELECT 3, 'products', vec_id, false FROM p WHERE vec_id NOT IN (FROM gone)),
n AS (SELECT unnest([1, 2, 3, 4]) AS version), t AS (SELECT unnest(['vectors', 'products']) AS name)
SELECT n.version::BIGINT AS version, t.name, count(vec_id) AS n_rows, coalesce(sum(vec_id), 0)::BIGINT AS id_sum, count(*) FILTER (fresh) AS n_new
FROM n CROSS JOIN t LEFT JOIN s ON s.version = n.version AND s.name = t.name GROUP BY ALL""")
def versions(t: Tables):
    """Vectors and products through an upsert, a paired delete and a delete of all, each version still readable."""
    ts = TableSet(t.spark, sinks.shared_folder(t.spark, "versions"))
    e = t.embeddings.select("vec_id", "label")
    ts.commit({"vectors": e.where("label < 7").withColumn("fresh", F.lit(False)),
               "products": t.part.select(F.col("p_partkey").alias("vec_id"), "p_name", F.lit(False).alias("fresh"))})
    ts.commit({"vectors": ct.replace_by_id(ts.read("vectors"), e.where("label >= 5").withColumn("fresh", F.lit(True)), "vec_id")})
    both = {n: ts.read(n) for n in ("vectors", "products")}
    ts.commit(ct.delete_together(both, e.where("label = 3"), "vec_id"))
    ts.commit(ct.delete_all({n: ts.read(n) for n in both}))
    out = None
    for v in range(1, ts.version() + 1):
        for n in both:
            row = ts.read(n, v).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("vec_id"), F.lit(0)).alias("id_sum"),
                                    F.count_if("fresh").alias("n_new")).select(F.lit(v).alias("version"), F.lit(n).alias("name"), "*")
            out = row if out is None else out.unionByName(row)
    return out


@query("catalog_filtered", f"""WITH {CSV} SELECT external_id, brand, price FROM prod WHERE category IN ('ECONOMY', 'PROMO') AND colour IN ('red', 'blue', 'hot')
  AND price BETWEEN 950 AND 1050 AND in_stock""")
def filtered(t: Tables):
    """Facet lists, price range and stock flag."""
    return ct.matching(products(t), {"category": ["ECONOMY", "PROMO"], "colour": ["red", "blue", "hot"], "brand": []},
                       950, 1050, True).select("external_id", "brand", "price")


@query("catalog_filter_ids", f"""WITH {CSV} SELECT external_id FROM prod WHERE category = 'PROMO' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def filter_ids(t: Tables):
    """Ids from another table that satisfy the filters."""
    wanted = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return ct.matching(products(t), {"category": ["PROMO"]}).join(wanted, "p_partkey", "left_semi").select("external_id")


@query("catalog_containing", f"WITH {CSV} SELECT external_id FROM prod WHERE contains(lower(name), 'ring') OR contains(lower(brand), 'ring') OR contains(lower(category), 'ring')")
def containing(t: Tables):
    """Substring search over name, brand and category."""
    return ct.containing(products(t), " RING ").select("external_id")


def _page(name: str, option: str, order: str):
    @query(f"catalog_page_{name}", f"""WITH {CSV} SELECT external_id, price, (SELECT count(*) FROM prod WHERE category = 'PROMO') AS total FROM prod
      WHERE category = 'PROMO' ORDER BY {order}, external_id LIMIT 24 OFFSET 24""")
    def page(t: Tables):
        d = ct.matching(products(t), {"category": ["PROMO"]})
        d = d.withColumn("created_at", F.col("p_partkey"))
        return ct.page(d, option, "external_id", 24, 24).select("external_id", "price", "total")
    page.__doc__ = f"Second page of a listing, {option}."


_page("price_asc", "price_asc", "price ASC NULLS LAST")
_page("price_desc", "price_desc", "price DESC NULLS LAST")
_page("name", "name_asc", "name")
_page("newest", "newest", "p_partkey DESC")


@query("catalog_facets", f"WITH {CSV} " + " UNION ALL ".join(
    f"(SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM prod GROUP BY {c} ORDER BY n DESC, value LIMIT 40)" for c in ("category", "brand", "colour")))
def facets(t: Tables):
    """Facet counts in one pass."""
    return ct.facets(products(t), ["category", "brand", "colour"])


@query("catalog_price_bounds", f"WITH {CSV} SELECT min(price) AS price_min, max(price) AS price_max FROM prod")
def price_bounds(t: Tables):
    """Observed price range."""
    return ct.price_bounds(products(t))


SRC_NAMES = {"external_id": "p_partkey", "name": "p_name", "category": "p_type", "subcategory": "kind", "colour": "colour",
             "gender": "gender", "usage": "usage", "season": "season", "year": "year"}


def source_rows(t: Tables):
    d = file_rows(t).where("line < 1000000000").select(
        "p_partkey", F.when(F.col("p_size") != 1, F.col("name")).alias("p_name"), F.col("category").alias("p_type"),
        F.col("subcategory").alias("kind"), "colour", "gender", F.when(F.col("p_size") > 10, F.col("usage")).alias("usage"),
        F.when(F.col("p_size") > 25, F.lit("Summer")).otherwise("").alias("season"),
        F.when(F.col("p_size") < 45, F.col("p_size") + 2000).alias("year"), "brand")
    return ct.usable(d, "p_partkey", "p_name", "kind")


def nouns_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%s' THEN {c}[:-2] ELSE {c} END"


BANDS_SQL = "map {" + ", ".join(f"'{k}': [{a}::DOUBLE, {b}::DOUBLE]" for k, (a, b) in vocab.PRICE_BANDS.items()) + "}"
PRICE_SQL = f"""(SELECT list_extract([0.99, 0.95, 0.49]::DOUBLE[], (('0x' || h[5:6])::INT % 3 + 1)::INT) + greatest(1.0, floor((lo + (('0x' || h[1:4])::INT / 65535.0::DOUBLE) * (hi - lo)) * f))
  FROM (SELECT sha256('mps-v1' || chr(0) || p_partkey) AS h, coalesce({BANDS_SQL}[kind][1], 15.0)::DOUBLE AS lo, coalesce({BANDS_SQL}[kind][2], 95.0)::DOUBLE AS hi,
  CASE usage WHEN 'Formal' THEN 1.25 WHEN 'Party' THEN 1.2 ELSE 1.0 END::DOUBLE AS f))"""
SRC = f"""{CSV},
s0 AS (SELECT p_partkey, name, category, subcategory AS kind, colour, gender, CASE WHEN p_size > 10 THEN usage ELSE '' END AS usage,
  CASE WHEN p_size > 25 THEN 'Summer' ELSE '' END AS season, CASE WHEN p_size < 45 THEN p_size + 2000 END AS year, brand FROM csv WHERE line < 1000000000 AND p_size <> 1),
s1 AS (SELECT *, colour || ' ' || kind AS lead FROM s0),
recs AS (SELECT *, name || ' is ' || CASE WHEN lead[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || lead || ' from ' || brand || '.'
   || ' It is ' || concat_ws(' and ', CASE WHEN gender = 'Unisex' THEN 'a unisex design' ELSE 'designed for ' || lower(gender) END,
        CASE WHEN usage <> '' THEN 'suited to ' || lower(usage) || ' wear' END) || '.'
   || CASE WHEN season <> '' OR year IS NOT NULL THEN ' Part of the ' || concat_ws(' ', CASE WHEN season <> '' THEN 'summer season' END, year::VARCHAR) || ' range.' ELSE '' END
   || CASE WHEN contains(lead, lower(category)) THEN '' ELSE ' Listed under ' || category || '.' END AS description, {PRICE_SQL} AS cost FROM s1)"""


@query("catalog_records", f"""WITH {SRC} SELECT p_partkey::VARCHAR AS external_id, name, description, category, kind AS subcategory, brand, colour, gender, usage, season,
  coalesce(year::VARCHAR, '') AS year, printf('%.2f', round(cost, 2)) AS price FROM recs""")
def records(t: Tables):
    """Usable source rows as canonical records with description and made-up price."""
    r = ct.records(source_rows(t), SRC_NAMES, F.col("brand"), unicode=False)
    return r.select("external_id", "name", "description", "category", "subcategory", "brand", "colour", "gender", "usage", "season", "year", "price")


@query("catalog_build_summary", f"""WITH {SRC} SELECT count(*) AS products, count(DISTINCT category) AS categories, count(DISTINCT kind) AS article_types,
  count(DISTINCT brand) AS brands, count(*) AS with_brand, count(DISTINCT colour) AS colours, round(min(cost), 2) AS price_min, round(max(cost), 2) AS price_max FROM recs""")
def build_summary(t: Tables):
    """Headline counts of the built catalog."""
    return ct.build_summary(ct.records(source_rows(t), SRC_NAMES, F.col("brand"), unicode=False))


NOVEL = {c: f"CASE WHEN contains(lower(name), lower({c})) THEN '' ELSE {c} END" for c in ("subcategory", "brand", "colour", "gender", "usage")}
DOC = f"""name || '. a ' || trim(lower({NOVEL['colour']}) || ' ' || lower(CASE WHEN {NOVEL['subcategory']} <> '' THEN {NOVEL['subcategory']} ELSE category END))
  || CASE WHEN {NOVEL['gender']} <> '' THEN ' for ' || lower({NOVEL['gender']}) ELSE '' END
  || CASE WHEN {NOVEL['brand']} <> '' THEN '. by ' || {NOVEL['brand']} ELSE '' END || CASE WHEN {NOVEL['usage']} <> '' THEN '. for ' || lower({NOVEL['usage']}) || ' wear' ELSE '' END"""
HASH = f"sha256(concat_ws(chr(31), '{MODEL}', name, '', category, subcategory, brand, colour, gender, usage, ''))"


@query("catalog_documents", f"WITH {CSV} SELECT external_id, {DOC} AS document, {HASH} AS content_hash FROM prod")
def documents(t: Tables):
    """Caption document and content fingerprint of every product."""
    return ct.with_document(products(t), unicode=False).select("external_id", "document", ct.content_hash(MODEL).alias("content_hash"))


def prior_state(t: Tables):
    """An earlier index run: it knows smaller sizes, and some of those under another name."""
    p = products(t).where("p_size <= 25")
    old = F.when(F.col("p_size") <= 9, F.concat(F.lit("old "), "name")).otherwise(F.col("name"))
    return p.withColumn("name", old).select(
        "external_id", ct.content_hash(MODEL).alias("content_hash"), F.lit(True).alias("has_text_vector"), (F.col("p_size") > 12).alias("has_image_vector"),
        F.lit(None).cast("string").alias("index_error"), F.lit(dt.datetime(2024, 1, 1)).alias("indexed_at"))


def plan(t: Tables):
    return ct.index_plan(products(t), prior_state(t), "external_id", MODEL, F.col("price").isNotNull() & (F.col("p_size") < 45), unicode=False)


PLAN = f"""WITH {CSV}, pl AS (SELECT *, price IS NOT NULL AND p_size < 45 AS img,
  CASE WHEN p_size BETWEEN 10 AND 25 THEN 'skipped' WHEN price IS NOT NULL AND p_size < 45 THEN 'indexed' ELSE 'text_only' END AS action FROM prod)"""


@query("catalog_index_plan", PLAN + " SELECT external_id, action FROM pl")
def index_plan(t: Tables):
    """What an incremental index run does with each product."""
    return plan(t).select("external_id", "action")


@query("catalog_index_report", PLAN + """ SELECT count(*) AS considered, count(*) FILTER (action <> 'skipped') AS embedded, count(*) FILTER (action = 'skipped') AS skipped,
  0::BIGINT AS failed, count(*) FILTER (action = 'indexed') AS image_vectors, count(*) FILTER (action = 'text_only') AS text_only FROM pl""")
def index_report(t: Tables):
    """Counts of the run."""
    return ct.index_report(plan(t))


@query("catalog_pending", PLAN + " SELECT external_id FROM pl WHERE action <> 'skipped'")
def pending(t: Tables):
    """Products without a current index entry."""
    return ct.pending(products(t), prior_state(t), "external_id", MODEL).select("external_id")


def new_state(t: Tables):
    return ct.next_state(plan(t), prior_state(t), "external_id", F.lit(dt.datetime(2024, 6, 1)))


@query("catalog_next_state", PLAN + """ SELECT external_id, true AS has_text_vector, CASE action WHEN 'skipped' THEN p_size > 12 ELSE action = 'indexed' END AS has_image_vector,
  CASE action WHEN 'text_only' THEN 'no usable image; indexed on text only' END AS index_error FROM pl""")
def next_state(t: Tables):
    """Index state after the run."""
    return new_state(t).select("external_id", "has_text_vector", "has_image_vector", "index_error")


@query("catalog_rerun_is_idle", PLAN + """ SELECT count(*) AS considered, 0::BIGINT AS embedded, count(*) AS skipped, 0::BIGINT AS failed,
  0::BIGINT AS image_vectors, 0::BIGINT AS text_only FROM pl""")
def rerun_is_idle(t: Tables):
    """A second run over the new state does nothing."""
    p = ct.index_plan(products(t), new_state(t), "external_id", MODEL, F.col("price").isNotNull() & (F.col("p_size") < 45), unicode=False)
    return ct.index_report(p)


@query("catalog_counters", PLAN + """ SELECT count(*) AS total_products, count(*) AS indexed_products, 0::BIGINT AS pending_products,
  count(*) FILTER (CASE action WHEN 'skipped' THEN p_size > 12 ELSE action = 'indexed' END) AS with_image_vector, count(*) AS with_text_vector,
  count(*) FILTER (action = 'text_only') AS failed_products FROM pl""")
def counters(t: Tables):
    """Catalog and index totals."""
    return ct.counters(products(t), new_state(t), "external_id").drop("last_indexed_at")


@query("catalog_stale_fields", f"WITH {CSV} SELECT external_id FROM prod WHERE category = 'PROMO'")
def stale_fields(t: Tables):
    """A price change keeps the embedding; a change of usage does not."""
    p = products(t)
    after = p.withColumns({"price": F.col("price") * 2,
                           "usage": F.when(F.col("category") == "PROMO", "Sports").otherwise(F.col("usage"))})
    return ct.stale_fields(p, after, "external_id", MODEL)


@query("catalog_ngram_counts", """WITH g AS (SELECT split_part(p_name, ' ', 1) AS gram FROM part UNION ALL SELECT p_name FROM part)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ngram_counts(t: Tables):
    """Leading n-grams of display names."""
    return ct.ngram_counts(t.part, "p_name", unicode=False)


@query("catalog_brands", """WITH a AS (SELECT split_part(p_name, ' ', 1) AS g, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_name AS g, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT DISTINCT lower(p_type) AS x FROM part)
SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN (SELECT x FROM w) THEN NULL WHEN a.n < 3 THEN NULL
  WHEN split_part(p_name, ' ', 2) NOT IN (SELECT x FROM w) AND b.n >= greatest(3, 0.5 * a.n) THEN p_name ELSE split_part(p_name, ' ', 1) END AS brand
FROM part JOIN a ON a.g = split_part(p_name, ' ', 1) JOIN b ON b.g = p_name""")
def brands(t: Tables):
    """Brands mined from recurring leading words; attribute words never count."""
    words = ct.attribute_words(t.part, ["p_type"])
    return ct.with_brand(t.part, "p_name", words, unicode=False).select("p_partkey", "brand")


@query("catalog_round_robin", f"""WITH o AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {hash_sql('p_partkey', 17)}, p_partkey) AS depth,
  count(*) OVER (PARTITION BY p_brand) AS size FROM part)
SELECT p_partkey, p_brand FROM o ORDER BY depth, size DESC, p_brand LIMIT 60""")
def round_robin(t: Tables):
    """Balanced sample over brands."""
    return ct.round_robin(t.part, "p_brand", "p_partkey", 60).select("p_partkey", "p_brand")


@query("catalog_seeded_sample", f"SELECT p_partkey FROM part ORDER BY {hash_sql('p_partkey', 42)}, p_partkey LIMIT 100")
def seeded_sample(t: Tables):
    """Bounded repeatable sample."""
    return ct.seeded_sample(t.part, "p_partkey", 100).select("p_partkey")


SQ = "[!]{2,}", "[?]{2,}", "[.]{2,}", "[,]{2,}", "[;]{2,}", "[:]{2,}"


def clean_sql(c: str) -> str:
    e = f"regexp_replace(regexp_replace(nfc_normalize({c}), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '<[^>]{{1,200}}>', ' ', 'g')"
    for p in SQ:
        e = f"regexp_replace({e}, '{p}', '{p[1]}', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


@query("text_clean_pages", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def clean_pages(t: Tables):
    """Canonical text of every page, whole."""
    return t.spread("pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query("text_clean_documents", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def clean_documents(t: Tables):
    """Canonical text of every document, whole."""
    return t.spread("documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("text_facets", "SELECT doc_id, regexp_replace(trim(source), '\\s+', ' ', 'g') AS facet FROM documents")
def text_facets(t: Tables):
    """Facet normaliser."""
    return t.documents.select("doc_id", tx.facet(F.col("source")).alias("facet"))


FOLD = "replace(lower({c}), 'ß', 'ss')"


@query("text_terms", f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({FOLD.format(c=clean_sql('text'))}, '[^0-9a-z]+'), lambda x: length(x) >= 2) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t, ' ') AS terms FROM w""")
def text_terms(t: Tables):
    """Keyword terms of every document."""
    d = t.spread("documents").select("doc_id", tx.terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join("t", " ").alias("terms"))


@query("text_query_documents", f"WITH w AS (SELECT conv_id, turn, {clean_sql('text')} AS c FROM conversations), v AS (SELECT conv_id, turn, trim(c[1:400]) AS c FROM w) "
       "SELECT conv_id, turn, array_to_string(string_split_regex(c, '\\s+')[1:60], ' ') AS query FROM v")
def query_documents(t: Tables):
    """Query texts: cleaned and cut to the encoder's 400 characters and 60 words."""
    return t.conversations.select("conv_id", "turn", tx.query_document(F.col("text")).alias("query"))


@query("text_dedupe_ordered", """SELECT p_partkey, CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN p_type || '|' || split_part(p_name, ' ', 2)
  ELSE p_type || '|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) END AS values FROM part""")
def dedupe_ordered(t: Tables):
    """First spelling of each value, ignoring case."""
    v = F.concat(F.array("p_type"), F.split("p_name", " "), F.array(F.upper("p_name"), F.lower("p_type"), F.lit("")))
    v = F.filter(tx.dedupe_ordered(v), lambda x: ~F.contains(x, F.lit(" ")))
    return t.part.select("p_partkey", F.array_join(v, "|").alias("values"))


LABELLED = "x AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT text, count(*) AS n, min(toxic) <> max(toxic) AS c, min(doc_id) AS f FROM x GROUP BY 1)"


def labelled(t: Tables):
    return t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")


@query("text_group_folds", f"""WITH x AS (SELECT d.doc_id, l.toxic, sha256(d.text) AS gid FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT gid, max(toxic) AS stratum, {hash_number_sql('gid', 42)} AS h FROM x GROUP BY gid),
f AS (SELECT gid, (row_number() OVER (PARTITION BY stratum ORDER BY h) - 1) % 5 AS fold FROM g)
SELECT doc_id, fold, toxic::BIGINT AS toxic FROM x JOIN f USING (gid)""")
def text_group_folds(t: Tables):
    """Folds that keep equal texts together and deal toxic and harmless groups out evenly."""
    return splits.group_folds(labelled(t), "text", "toxic", 5).select("doc_id", "fold", "toxic")


@query("text_dedup_report", f"""WITH {LABELLED} SELECT coalesce(sum(n - 1) FILTER (NOT c), 0)::BIGINT AS n_removed, coalesce(sum(n) FILTER (c), 0)::BIGINT AS n_conflicting_rows,
  count(*) FILTER (c) AS n_conflicting_groups FROM g""")
def text_dedup_report(t: Tables):
    """Equal texts: harmless repeats and label conflicts."""
    return audit.dedup_report(labelled(t), ["text"], "toxic", "doc_id")


@query("text_deduplicated", f"WITH {LABELLED} SELECT doc_id, toxic::BIGINT AS toxic, c AS conflict FROM x JOIN g USING (text) WHERE c OR doc_id = f")
def text_deduplicated(t: Tables):
    """First of equal texts; conflicting groups kept whole."""
    return audit.deduplicate(labelled(t), ["text"], "toxic", "doc_id").select("doc_id", "toxic", "conflict")


@query("text_duplicate_counts", "SELECT 0::BIGINT AS exact, 0::BIGINT AS by_id, count(*) - count(DISTINCT text) AS by_features FROM documents")
def text_duplicates(t: Tables):
    """Repeated rows, ids and texts."""
    return audit.duplicate_counts(t.documents, "doc_id", ["text"])


@query("text_missing", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS n FROM documents"
                                          for c in ("doc_id", "text", "lang", "source", "n_chars")))
def text_missing(t: Tables):
    """Missing and blank cells of the documents."""
    return audit.missing_or_blank(t.documents)
