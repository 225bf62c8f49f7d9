"""Product catalog: records, validation, upsert, index state, listing and facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import text as tx
from quarrylane.functions import vocab
from quarrylane.functions.cleaning import blank_to_null
from quarrylane.plans.bounded import hash_order, small_side
from quarrylane.plans.hotkeys import join_counted
from quarrylane.session import checkpointed

# Canonical catalog columns and the fields an embedding depends on.
COLUMNS = ("external_id", "name", "description", "category", "subcategory", "brand", "colour", "gender",
           "usage", "season", "year", "price", "currency", "image_url", "in_stock")
EMBEDDED = ("name", "description", "category", "subcategory", "brand", "colour", "gender", "usage", "image_url")
# Longest text per field.
LENGTHS = {"name": 512, "description": 4000, "category": 128, "subcategory": 128, "brand": 128, "colour": 64,
           "gender": 32, "usage": 64, "season": 32, "image_url": 1024, "external_id": 128}


def usable(df: DataFrame, ident: str, name: str, kind: str) -> DataFrame:
    """Source rows that can become a product."""
    return df.where(F.col(ident).isNotNull() & (F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
                    & (F.trim(F.coalesce(F.col(kind), F.lit(""))) != ""))


def records(df: DataFrame, names: Mapping[str, str], brand: Column, unicode: bool = True) -> DataFrame:
    """Canonical 15-column records from source columns named by ``names``."""
    fields = ("name", "category", "subcategory", "colour", "gender", "usage", "season", "image_url")

    def src(field: str) -> Column:
        return F.coalesce(F.trim(F.col(names[field])), F.lit("")) if field in names else F.lit("")

    year = F.col(names["year"]).try_cast("int") if "year" in names else F.lit(None).cast("int")
    raw = {f: src(f) for f in fields} | {"brand": F.coalesce(brand, F.lit(""))}
    d = df.select(F.col(names["external_id"]).cast("string").alias("external_id"), F.nullif(year, F.lit(0)).alias("year"),
                  *[v.alias(k) for k, v in raw.items()],
                  *[tx.clean_text(v, unicode=unicode).alias(f"__{k}") for k, v in raw.items()])
    c = {k: F.col(f"__{k}") for k in raw}
    text = tx.description(c["name"], c["subcategory"], F.lit(""), c["category"], c["colour"], c["gender"], c["usage"],
                          c["season"], F.col("year"), c["brand"])
    return d.select(
        "external_id", "name", text.alias("description"), "category", "subcategory", "brand", "colour", "gender", "usage",
        "season", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        F.format_string("%.2f", tx.made_up_price(F.col("external_id"), F.col("subcategory"), F.col("usage"))).alias("price"),
        F.lit("USD").alias("currency"), "image_url", F.lit("true").alias("in_stock"))


def parsed(df: DataFrame) -> DataFrame:
    """Text cells to typed fields; unparsable numbers become NULL."""
    keep = [c for c in df.columns if c not in COLUMNS]
    typed = {c: blank_to_null(F.col(c)) for c in COLUMNS if c not in ("year", "price", "currency", "in_stock")}
    stock = blank_to_null(F.col("in_stock"))
    return df.select(
        *keep, *[v.alias(k) for k, v in typed.items()],
        F.floor(blank_to_null(F.col("year")).try_cast("double")).cast("int").alias("year"),
        blank_to_null(F.col("price")).try_cast("double").alias("price"),
        F.upper(F.coalesce(blank_to_null(F.col("currency")), F.lit("USD"))).alias("currency"),
        F.coalesce(F.lower(stock).isin(list(vocab.TRUE_VALUES)), F.lit(True)).alias("in_stock"))


def violations() -> Column:
    """Names of the fields that break a product constraint, in field order."""
    rules: dict[str, Column] = {"name": F.col("name").isNull()}
    for f, n in LENGTHS.items():
        too_long = F.length(f) > n
        rules[f] = rules[f] | too_long if f in rules else too_long
    rules["year"] = ~F.col("year").between(1900, 2200)
    rules["price"] = ~F.col("price").between(0, 1_000_000)
    rules["currency"] = ~F.col("currency").rlike("^[A-Z]{3}$")
    found = [F.when(F.coalesce(cond, F.lit(False)), F.lit(f)) for f, cond in rules.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def validated(df: DataFrame, line: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows (last of a repeated id wins), rejected rows, and accepted-but-replaced ids.

    The checked batch is written once, since all three results read it.
    """
    checked = checkpointed(parsed(df).withColumn("errors", violations()))
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0).select(line, "external_id", F.get("errors", F.lit(0)).alias("reason"))
    with_id = good.where(F.col("external_id").isNotNull())
    rest = [c for c in good.columns if c != "external_id"]
    last = with_id.groupBy("external_id").agg(F.max_by(F.struct(*rest), line).alias("r"), F.count(F.lit(1)).alias("n"))
    kept = last.select("external_id", "r.*").select(*good.columns).unionByName(good.where(F.col("external_id").isNull()))
    return kept, bad, last.where("n > 1").select("external_id", (F.col("n") - 1).alias("n_dropped"))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Next version of a table: matching keys replaced, others inserted, with a change tag."""
    new = incoming.select(F.col(key), F.struct(*incoming.columns).alias("__new"))
    old = current.select(F.col(key), F.struct(*current.columns).alias("__old"))
    j = old.join(new, key, "full_outer")
    take = F.coalesce("__new", "__old")
    change = (F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "created").otherwise("updated"))
    return j.select(*[take[c].alias(c) for c in current.columns], change.alias("change"))


def load_report(total: DataFrame, bad: DataFrame, replaced: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts of one batch load."""
    return merged.agg(
        F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"),
    ).select(
        total.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_rows"), "created", "updated",
        bad.agg(F.count(F.lit(1)).alias("n")).scalar().alias("invalid"),
        F.coalesce(replaced.agg(F.sum("n_dropped").alias("n")).scalar(), F.lit(0)).alias("duplicates_in_file"))


def first_errors(bad: DataFrame, line: str, n: int = 100) -> DataFrame:
    return bad.orderBy(line).limit(n)


def replace_by_id(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` take the place of rows with the same key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_by_id(current: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return current.join(doomed.select(key), key, "left_anti")


def delete_together(tables: Mapping[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """The same ids deleted from several tables, for one commit of ``sources.versions``; give vectors before rows."""
    return {name: delete_by_id(d, doomed, key) for name, d in tables.items()}


def delete_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without its rows, the columns kept."""
    return {name: d.where(F.lit(False)) for name, d in tables.items()}


def content_hash(model: str) -> Column:
    return tx.fingerprint(model, [F.col(c) for c in EMBEDDED])


def with_document(df: DataFrame, unicode: bool = True) -> DataFrame:
    """Add the caption document; cleaned fields are columns first, so each is cleaned once."""
    d = df.withColumns({"__name": tx.clean_text(F.col("name"), 300, unicode),
                        "__description": tx.clean_text(F.col("description"), 600, unicode),
                        **{f"__{f}": tx.facet(F.col(f), unicode) for f in EMBEDDED[2:8]}})
    c = {f: F.col(f"__{f}") for f in EMBEDDED[:8]}
    doc = tx.caption(c["name"], c["description"], c["category"], c["subcategory"], c["brand"], c["colour"], c["gender"], c["usage"])
    return d.withColumn("document", doc).drop(*[f"__{f}" for f in EMBEDDED[:8]])


def stale_fields(before: DataFrame, after: DataFrame, key: str, model: str) -> DataFrame:
    """Keys whose embedding inputs changed between two versions; a price change does not count."""
    a = before.select(key, content_hash(model).alias("h0"))
    b = after.select(key, content_hash(model).alias("h1"))
    return a.join(b, key).where(F.col("h0") != F.col("h1")).select(key)


def index_plan(products: DataFrame, state: DataFrame, key: str, model: str, has_image: Column,
               force: bool = False, unicode: bool = True) -> DataFrame:
    """What an index run does with each product.

    ``skipped`` when the stored hash still matches, ``failed`` without text,
    ``text_only`` without an image, else ``indexed``.
    """
    p = with_document(products, unicode).select(
        key, content_hash(model).alias("content_hash"), "document", has_image.alias("has_image"))
    s = state.select(key, F.col("content_hash").alias("__old"), F.col("has_text_vector").alias("__text"))
    j = p.join(s, key, "left")
    current = F.coalesce((F.col("__old") == F.col("content_hash")) & F.col("__text"), F.lit(False)) & F.lit(not force)
    action = (F.when(current, "skipped").when(F.trim("document") == "", "failed")
              .when(~F.col("has_image"), "text_only").otherwise("indexed"))
    # Written once: the vectors, the next state and the report all follow from this plan.
    return checkpointed(j.select(key, "content_hash", "document", "has_image", action.alias("action")))


def pending(products: DataFrame, state: DataFrame, key: str, model: str) -> DataFrame:
    """Products without a current index entry."""
    p = products.select(key, content_hash(model).alias("content_hash"))
    done = state.where(F.col("has_text_vector")).select(key, "content_hash")
    return p.join(done, [key, "content_hash"], "left_anti")


def next_state(plan: DataFrame, state: DataFrame, key: str, at: Column) -> DataFrame:
    """Index state after a run: hashes, vector flags, trimmed error text and time."""
    error = (F.when(F.col("action") == "failed", "no embeddable text")
             .when(F.col("action") == "text_only", "no usable image; indexed on text only"))
    ok = F.col("action").isin("indexed", "text_only")
    changed = plan.where(F.col("action") != "skipped").select(
        key, F.when(ok, F.col("content_hash")).alias("content_hash"), ok.alias("has_text_vector"),
        (ok & F.col("has_image")).alias("has_image_vector"), F.substring(error, 1, 1000).alias("index_error"),
        F.when(ok, at).alias("indexed_at"))
    return replace_by_id(state, changed, key)


def index_report(plan: DataFrame) -> DataFrame:
    a = F.col("action")
    return plan.agg(
        F.count(F.lit(1)).alias("considered"), F.count_if(a.isin("indexed", "text_only")).alias("embedded"),
        F.count_if(a == "skipped").alias("skipped"), F.count_if(a == "failed").alias("failed"),
        F.count_if(a == "indexed").alias("image_vectors"), F.count_if(a == "text_only").alias("text_only"))


def counters(products: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Totals of the catalog and its index."""
    j = products.select(key).join(state, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("total_products"), F.count("indexed_at").alias("indexed_products"),
        (F.count(F.lit(1)) - F.count("indexed_at")).alias("pending_products"),
        F.count_if("has_image_vector").alias("with_image_vector"), F.count_if("has_text_vector").alias("with_text_vector"),
        F.count("index_error").alias("failed_products"), F.max("indexed_at").alias("last_indexed_at"))


def matching(df: DataFrame, one_of: Mapping[str, Sequence[str]] | None = None, min_price: float | None = None,
             max_price: float | None = None, in_stock: bool = False) -> DataFrame:
    """Facet lists are AND-ed, values inside one are OR-ed; the price range is inclusive."""
    for c, values in (one_of or {}).items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    return df.where("in_stock") if in_stock else df


def containing(df: DataFrame, needle: str, columns: Sequence[str] = ("name", "brand", "category")) -> DataFrame:
    """Rows whose name, brand or category contains the text, ignoring case."""
    n = needle.strip().lower()
    if not n:
        return df
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(c), F.lit(n)), F.lit(False))
    return df.where(cond)


def sort_columns(option: str, ident: str) -> list[Column]:
    """Order of a listing; a missing price sorts last in both directions."""
    return {"price_asc": [F.asc_nulls_last("price"), F.asc(ident)],
            "price_desc": [F.desc_nulls_last("price"), F.asc(ident)],
            "name_asc": [F.asc("name"), F.asc(ident)],
            "newest": [F.desc_nulls_last("created_at"), F.asc(ident)]}[option]


def page(df: DataFrame, option: str, ident: str, limit: int = 24, offset: int = 0) -> DataFrame:
    """One page of a listing with the total number of matches."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*sort_columns(option, ident)).offset(offset).limit(limit).withColumn("total", total)


def facets(df: DataFrame, columns: Sequence[str], n: int = 40) -> DataFrame:
    """Most frequent values per facet, all facets in one pass."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    c = df.select(cell.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def price_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"))


def build_summary(df: DataFrame) -> DataFrame:
    """Headline counts of a freshly built catalog."""
    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    price = F.col("price").try_cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("products"), F.countDistinct(filled("category")).alias("categories"),
        F.countDistinct(filled("subcategory")).alias("article_types"), F.countDistinct(filled("brand")).alias("brands"),
        F.count(filled("brand")).alias("with_brand"), F.countDistinct(filled("colour")).alias("colours"),
        F.min(price).alias("price_min"), F.max(price).alias("price_max"))


def round_robin(df: DataFrame, group: str, ident: str, limit: int, seed: int = 17) -> DataFrame:
    """Balanced sample: one row per group and round, larger groups first."""
    g = F.coalesce(group, F.lit("unknown"))
    size = df.groupBy(g.alias("__g")).agg(F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy("__g").orderBy(hash_order(F.col(ident), seed), ident)
    d = df.withColumn("__g", g).withColumn("__depth", F.row_number().over(w)).where(F.col("__depth") <= limit)
    return (d.join(small_side(size), "__g").orderBy("__depth", F.desc("__size"), "__g").limit(limit)
            .drop("__g", "__depth", "__size"))


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in a repeatable random order."""
    return df.orderBy(hash_order(F.col(ident), seed), ident).limit(n)


def ngram_counts(names: DataFrame, name: str, unicode: bool = True) -> DataFrame:
    """How many display names start with each 1..4-gram."""
    clean = names.select(tx.clean_text(F.col(name), unicode=unicode).alias("__clean"))
    tokens = clean.select(tx.name_tokens(F.col("__clean")).alias("__tokens"))
    return tokens.select(F.explode(tx.leading_ngrams(F.col("__tokens"))).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))


def attribute_words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-case words of the attribute columns (``word``), each once."""
    words = F.explode(F.flatten(F.array(*[tx.name_tokens(F.lower(F.col(c).cast("string"))) for c in columns])))
    return df.select(words.alias("word")).distinct()


def with_brand(df: DataFrame, name: str, attributes: DataFrame, min_count: int = 3, unicode: bool = True) -> DataFrame:
    """Brand of each display name, mined from how often its leading words recur; attribute words (``word``) never count.

    Distinct names are looked up once, so a popular name is one row in the joins, and goes back to its rows by
    ``join_counted``.
    """
    names = (df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__clean", tx.clean_text(F.col(name), unicode=unicode))
             .withColumn("tokens", tx.name_tokens(F.col("__clean"))).drop("__clean"))
    names = checkpointed(names)
    grams = names.select(name, "__n", F.posexplode(tx.leading_ngrams(F.col("tokens"))).alias("i", "gram"))
    counts = grams.groupBy("gram").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("__w"))
    support = join_counted(grams.drop("__n"), checkpointed(counts), "gram", "__w").groupBy(name).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("i") + 1).alias("size"), "n"))).alias("support"))  # four entries
    words = names.select(name, F.explode(F.transform("tokens", F.lower)).alias("word"))
    flagged = words.join(small_side(attributes.select("word")), "word", "left_semi").groupBy(name).agg(F.collect_set("word").alias("known"))
    d = names.join(support, name, "left").join(flagged, name, "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    d = d.withColumn("brand", brand_rule(F.col("tokens"), F.col("support"), known, min_count))
    found = checkpointed(d.select(name, "brand", "__n"))
    bare = df.where(F.col(name).isNull()).withColumn("brand", F.lit(None).cast("string"))
    return join_counted(df, found, name, "__n").unionByName(bare)


def brand_rule(tokens: Column, support: Column, known: Column, min_count: int) -> Column:
    """Shortest frequent leading words, extended while the longer form stays frequent."""
    leading = F.array(*[F.lit(w) for w in vocab.NON_BRAND_LEADING])
    joiners = F.array(*[F.lit(w) for w in vocab.CONNECTORS])

    def count(size: Column) -> Column:
        return F.coalesce(F.try_element_at(support, size), F.lit(0))

    def word(i: Column) -> Column:
        return F.coalesce(F.lower(F.get(tokens, i)), F.lit(""))

    def grow(s: Column, _: Column) -> Column:
        size = s["size"]
        nxt = word(size)
        joiner = F.array_contains(joiners, nxt)
        bridge = joiner & (size + 1 < F.size(tokens)) & (count(size + 2) >= min_count)
        enough = F.greatest(F.lit(float(min_count)), 0.5 * count(F.lit(1)))
        plain = ~joiner & ~F.array_contains(known, nxt) & (count(size + 1) >= enough)
        go = ~s["done"] & (size < F.least(F.size(tokens), F.lit(4)))
        step = F.when(go & bridge, 2).when(go & plain, 1).otherwise(0)
        return F.struct((size + step).alias("size"), (s["done"] | (step == 0)).alias("done"))

    start = F.struct(F.lit(1).alias("size"), F.lit(False).alias("done"))
    size = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, grow)["size"]
    frequent = F.slice(tokens, F.lit(1), size)

    def stops(t: Column) -> Column:
        low = F.lower(t)
        return (F.array_contains(known, low) | F.array_contains(leading, low)
                | (~t.rlike("^[A-Z]") & ~F.array_contains(joiners, low)))

    head = F.slice(tokens, 1, 4)
    run = F.aggregate(head, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")),
                      lambda s, t: F.struct((s["n"] + F.when(s["done"] | stops(t), 0).otherwise(1)).alias("n"),
                                            (s["done"] | stops(t)).alias("done")))["n"]
    capital = F.when(F.get(tokens, F.lit(0)).rlike("^[A-Z]"), F.slice(tokens, F.lit(1), run))
    first = word(F.lit(0))
    candidate = ((F.size(tokens) > 0) & ~F.array_contains(leading, first) & ~F.array_contains(known, first)
                 & ~((F.length(first) < 2) & ~first.rlike("^[a-z]+$")))
    picked = F.when(count(F.lit(1)) < min_count, capital).otherwise(frequent)
    joined = F.array_join(picked, " ")
    trimmed = F.regexp_replace(joined, r"(?i)(^|\s+)((and|of|&|the|by|de|la)(\s+|$))+$", "")
    return F.when(candidate, F.nullif(F.trim(trimmed), F.lit("")))
