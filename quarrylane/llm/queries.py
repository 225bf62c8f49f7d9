"""The registered queries of the training-data operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylane.llm import bpe, exact_dedup, language, lexical, merkle, mixing, ngram_join, quality, simhash, substrings, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@registered
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@registered
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded_digests(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)


@registered
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that documents of smaller ids have too."""
    return substrings.find_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@registered
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    samples = language.training_sample(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")
    found = language.identify(table(spark, sf_dir, "documents", "doc_id", "text"), samples)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "known")


@registered
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives and back."""
    return warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("record_id")


CHECKS["op5_warc"] = """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes,
       -- base32 of 160 bits: four groups of ten hex digits, eight letters of five bits each
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


@registered
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mixing.mark_mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@registered
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    counted = token_counts.with_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@registered
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


@registered
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and divergence from the language references for all documents."""
    found = quality.references(table(spark, sf_dir, "documents", "text", "lang"))
    judged = quality.with_quality(table(spark, sf_dir, "documents", "doc_id", "text"), found)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


# Character classes by the SQL pattern of what is left out; the one before the last is all other ASCII characters.
_CLASS_PATTERNS = ("[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"""[^.,;:!?''"()-]""", r"[^#*$%&|<>]",
                   r"""[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()#*$%&|<>-]|[^\x00-\x7F]""", r"[\x00-\x7F]")
CHECKS["op9_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS g FROM w, unnest(range(1, len(words) - 1)) r(i)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM rep GROUP BY 1),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
cls AS (SELECT doc_id, lang, unnest(range({quality.N_CLASSES})) AS k, unnest([{", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in _CLASS_PATTERNS)}]) AS n FROM d),
lw AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(t), '(?:[a-z]|[^\x00-\x7F])+')) AS x FROM d),
lc AS (SELECT doc_id, lang, x, count(*) AS n FROM lw GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM lc GROUP BY 1),
rw AS (SELECT lang, x, sum(n) AS n FROM lc WHERE length(x) <= {quality.COMMON_LETTERS} GROUP BY lang, x
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, x) <= {quality.COMMON_WORDS}),
dt AS (SELECT doc_id, sum(n) AS n FROM lc GROUP BY 1),
-- both histograms of every document beside every reference; the bin '' holds all words that are not common
cells AS (SELECT d.doc_id, r.lang, 'c' AS kind, d.n::DOUBLE AS a, r.n::DOUBLE AS b FROM cls d
    JOIN (SELECT lang, k, sum(n) AS n FROM cls GROUP BY ALL) r USING (k) SEMI JOIN total ON total.lang = r.lang
  UNION ALL SELECT d.doc_id, rw.lang, 'w', coalesce(lc.n, 0), rw.n FROM d CROSS JOIN rw LEFT JOIN lc ON lc.doc_id = d.doc_id AND lc.x = rw.x
  UNION ALL SELECT d.doc_id, total.lang, 'w',
      coalesce((SELECT n FROM dt WHERE dt.doc_id = d.doc_id), 0) - coalesce((SELECT sum(lc.n) FROM lc JOIN rw ON rw.x = lc.x WHERE rw.lang = total.lang AND lc.doc_id = d.doc_id), 0),
      total.n - (SELECT sum(rw.n) FROM rw WHERE rw.lang = total.lang) FROM d CROSS JOIN total),
shares AS (SELECT doc_id, lang, kind, a / nullif(sum(a) OVER p, 0) AS a, b / sum(b) OVER p AS b FROM cells WINDOW p AS (PARTITION BY doc_id, lang, kind)),
dist AS (SELECT doc_id, lang, kind, coalesce(sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END
      + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) FILTER (a IS NOT NULL) / 2)), 1) AS v FROM shares GROUP BY ALL),
near AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, lang, avg(v) AS v FROM dist GROUP BY ALL) GROUP BY 1),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND (n_words < {quality.GUARD_WORDS} OR coalesce(near.v, 0) <= {quality.MAX_DISTANCE} + {quality.SLACK} / sqrt(n_words)) AS kept
FROM f LEFT JOIN near USING (doc_id)
"""


@registered
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_dedup.mark_exact(table(spark, sf_dir, "documents", "doc_id", "text"), columns=["doc_id"])


CHECKS["op10_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

CHECKS["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
w AS (SELECT source, z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
-- With the k smallest caps per weight filled, the others share the rest by weight; the first k whose level stays below the next cap holds.
c AS (SELECT *, 3.0 * z / w AS ratio, sum(z) OVER () - coalesce(sum(3 * z) OVER before, 0) AS remains,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
      FROM w WINDOW before AS (ORDER BY 3.0 * z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT remains, weights FROM c WHERE remains::DOUBLE / weights <= ratio ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, z, least(3.0 * z, w * l.remains::DOUBLE / l.weights)::DOUBLE AS target FROM w, l),
p AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE least(3, floor(target / z))::BIGINT END AS times FROM t),
h AS (SELECT source, hash, sum(size) AS size FROM d GROUP BY source, hash),
r AS (SELECT h.source, h.hash, h.size, sum(h.size) OVER (PARTITION BY h.source ORDER BY h.hash) AS upto, p.target - p.times * p.z AS rest
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
m AS (SELECT source, hash, upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) AS more FROM r)
SELECT d.doc_id, d.size, p.z AS source_size, round(p.target, 6) AS target,
       (d.size * (p.times + CASE WHEN p.times < 3 AND m.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.hash = m.hash
"""


@registered
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, among all documents."""
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


# Only A-Z become lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
CHECKS["op11_lexical"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
z AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf FROM d, unnest(terms) t(term) GROUP BY doc_id, terms, term),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, z GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN tf USING (term), z GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@registered
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles have a similarity of 0.9 or more."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))


CHECKS["op12_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM pair UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON reach.other = pair.a)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, coalesce(min(other), s.doc_id)::BIGINT AS component_id
FROM s LEFT JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, grams
"""


@registered
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, with n_chars tampered with where 7 divides the CRC-32 of the id."""
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, tampered=touched, given={"n_chars": F.col("n_chars") + 1})


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + "))"


# CRC-32 bit by bit: SQL has none. Levels go up one row per node; every leaf then looks its siblings up.
CHECKS["op13_merkle"] = rf"""
WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS c FROM documents),
d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS touched FROM documents),
l AS (SELECT d.doc_id, lang, leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN touched ELSE leaf END AS given,
             row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d JOIN crc USING (doc_id)),
up AS (SELECT lang, 0 AS lvl, pos, n, leaf AS node FROM l
  UNION ALL SELECT lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 2),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, subroot AS node FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
-- a sibling on the way up, and on which side it stands
way AS (SELECT l.doc_id, up.lvl, up.n, up.pos AS own, o.node AS sibling FROM l JOIN up ON up.lang IS NOT DISTINCT FROM l.lang AND up.pos = l.pos >> up.lvl AND up.n > 1
        LEFT JOIN up o ON o.lang IS NOT DISTINCT FROM up.lang AND o.lvl = up.lvl AND o.pos = xor(up.pos, 1)
  UNION ALL SELECT l.doc_id, 1000 + top.lvl, top.n, top.pos, o.node FROM l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang
        JOIN top ON top.pos = sub.pos >> top.lvl AND top.n > 1 LEFT JOIN top o ON o.lvl = top.lvl AND o.pos = xor(top.pos, 1)),
path AS (SELECT doc_id, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY lvl)) AS proof_sha256, list(own % 2 ORDER BY lvl) AS sides, list(coalesce(sibling, '') ORDER BY lvl) AS sib FROM way GROUP BY doc_id),
f AS (SELECT l.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
        list_reduce(list_prepend(given, coalesce(list_transform(range(1, len(sib) + 1), lambda i: sides[i]::VARCHAR || sib[i]), []::VARCHAR[])),
          lambda h, s: sha256(CASE WHEN s[1] = '1' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root FROM l LEFT JOIN path USING (doc_id))
SELECT f.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang, (SELECT node AS root FROM top WHERE n = 1)
"""


@registered
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
