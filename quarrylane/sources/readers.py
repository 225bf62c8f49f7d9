"""Checked readers: declared schemas, required columns, nested query sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.operators.audit import require_columns, unique_key
from quarrylane.operators.catalog import COLUMNS
from quarrylane.operators.ranking import RULE_FIELDS
from quarrylane.operators.rounds import RAW_COLUMNS
from quarrylane.sources import split_csv

TRANSACTIONS = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()), T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrg", T.DoubleType()), T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()), T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.ByteType())])

_LIST = T.ArrayType(T.StringType())
QUERY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("image_external_id", T.StringType()), T.StructField("group", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("relevance", T.MapType(T.StringType(), _LIST))])
QUERY_SET = T.StructType([T.StructField("queries", T.ArrayType(QUERY))])


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text, named by its header; quoted cells may hold quotes (doubled), commas and line ends, and
    files are read in ranges all the same (see ``split_csv``)."""
    return split_csv.read(spark, path)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must hold the schema's columns; others may follow."""
    raw = require_columns(text_csv(spark, path), schema.names)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def transactions(spark: SparkSession, path: str) -> DataFrame:
    return typed_csv(spark, path, TRANSACTIONS)


def funding_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Published rounds: all text, columns renamed by position; the reader drops a byte-order mark."""
    return text_csv(spark, path).toDF(*RAW_COLUMNS)


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file; id and name must be there, other columns are added as NULL."""
    d = require_columns(text_csv(spark, path), ["external_id", "name"])
    return d.withColumns({c: F.lit(None).cast("string") for c in COLUMNS if c not in d.columns})


def parquet_columns(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only the named columns of one or many parquet files or shards."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths).select(*columns)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark queries with relevance rules; malformed sets are refused."""
    q = spark.read.json(path, schema=QUERY_SET, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    known = [*RULE_FIELDS, "exclude_external_ids"]
    rule_size = sum((F.size(F.coalesce(F.try_element_at("relevance", F.lit(f)), F.array().cast(_LIST))) for f in RULE_FIELDS), F.lit(0))
    has_text, has_image = F.coalesce("query", F.lit("")) != "", F.coalesce("image_external_id", F.lit("")) != ""
    problem = (
        F.when(~F.coalesce(F.col("type").isin("text", "image", "multimodal"), F.lit(False)), "invalid or missing type")
        .when(F.size(F.array_except(F.map_keys(F.coalesce("relevance", F.create_map().cast(T.MapType(T.StringType(), _LIST)))),
                                    F.array(*[F.lit(k) for k in known]))) > 0, "unknown relevance field")
        .when(F.col("type").isin("text", "multimodal") & ~has_text, "query text required")
        .when(F.col("type").isin("image", "multimodal") & ~has_image, "image_external_id required")
        .when(rule_size == 0, "relevance rule matches everything"))
    bad = q.withColumn("problem", problem).where("problem IS NOT NULL").select("id", "problem").first()
    if bad:
        raise ValueError(f"query {bad['id']!r}: {bad['problem']}")
    twice = unique_key(q, ["id"]).first()
    if twice:
        raise ValueError(f"duplicate query id: {twice['id']!r}")
    lists = [F.coalesce(F.try_element_at("relevance", F.lit(k)), F.array().cast(_LIST)).alias("exclude_ids" if k.startswith("exclude") else k)
             for k in known]
    return q.select(F.col("id").alias("query_id"), "type", F.col("query").alias("query_text"), "image_external_id", "group", *lists)
