"""Domain tables over the driver's parquet, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place; price is null for every eleventh, rating for every thirteenth."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    areas = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    key = F.col("c_custkey")
    return (
        load(spark, sf_dir, "customer")
        .join(F.broadcast(areas), F.col("c_nationkey") == F.col("n_nationkey"))  # at most one row per nation: 25
        .select(
            key.alias("restaurant_id"), F.col("c_name").alias("name"), F.concat(F.col("n_name"), F.lit(" street "), (key % 97).cast("string")).alias("address"),
            F.lower("r_name").alias("borough"), F.array(F.lower("c_mktsegment"), F.when(key % 2 == 0, "bar").otherwise("cafe")).alias("cuisines"),
            F.when(key % 11 != 0, (key % 4 + 1).cast("int")).alias("price_level"), F.when(key % 13 != 0, F.round((key % 50) / 10.0, 1)).alias("rating"),
            (key % 200).cast("long").alias("rating_count"), F.col("c_acctbal").alias("score"), (key % 10 != 0).alias("is_active"),
            (F.lit(40.45) + (key % 500) / 1000.0).alias("lat"), (F.lit(-74.3) + (key % 700) / 1000.0).alias("lon"),
        )
    )


PLACES = """places AS (
  SELECT c_custkey AS restaurant_id, c_name AS name, n_name || ' street ' || CAST(c_custkey % 97 AS VARCHAR) AS address, lower(r_name) AS borough,
         [lower(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN 'bar' ELSE 'cafe' END] AS cuisines,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 4 + 1 AS INTEGER) END AS price_level,
         CASE WHEN c_custkey % 13 <> 0 THEN round((c_custkey % 50) / 10.0, 1) END AS rating, CAST(c_custkey % 200 AS BIGINT) AS rating_count,
         c_acctbal AS score, c_custkey % 10 <> 0 AS is_active, 40.45 + (c_custkey % 500) / 1000.0::DOUBLE AS lat, -74.3 + (c_custkey % 700) / 1000.0::DOUBLE AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review: rating from the priority's digit, text flag from the status."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("restaurant_id"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("rating"),
        F.col("o_orderdate").alias("reviewed_at"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).otherwise("").alias("text"),
        (F.col("o_orderstatus") == "F").alias("is_representative"),
    )


REVIEWS = """reviews AS (
  SELECT o_orderkey AS id, o_custkey AS restaurant_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS rating, o_orderdate AS reviewed_at,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'text ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS text, o_orderstatus = 'F' AS is_representative FROM orders)"""

#: What is added to texts so that vocabulary queries have something to find.
PHRASES = (
    " the food was fresh and delicious", " slow service, $12 for price", " we waited in line with the kids", " birthday party of a group, cozy space",
    " call 212-555-0199 or mail me@example.com", " rude staff; date night was loud", "",
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a place (their source's number), a rating (1 to 5) and a phrase by doc_id."""
    docs = load(spark, sf_dir, "documents")
    phrase = F.lit("")
    for k, words in enumerate(PHRASES):
        phrase = F.when(F.col("doc_id") % len(PHRASES) == k, words).otherwise(phrase)
    return docs.select(
        "doc_id", F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("restaurant_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        F.concat(F.coalesce("text", F.lit("")), phrase).alias("text"), "lang", "source",
    )


TEXTS = f"""texts AS (
  SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS restaurant_id, CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
         coalesce(text, '') || CASE doc_id % {len(PHRASES)} {' '.join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES))} ELSE '' END AS text, lang, source
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def kdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectored documents: label stands for scope and place group."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("document_id"), (F.col("vec_id") % 40).alias("restaurant_id"), F.col("label").alias("scope"), F.col("embedding").cast("array<double>").alias("embedding")
    )


KDOCS = """kdocs AS (
  SELECT vec_id AS document_id, vec_id % 40 AS restaurant_id, label AS scope, embedding::DOUBLE[] AS embedding FROM embeddings)"""
