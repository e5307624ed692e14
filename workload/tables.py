"""Listing, profile and response tables derived from the given tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesieve.schemas import CITY, COST


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw listing per (part, supplier) that occurs in lineitem; some contract columns are absent on purpose."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").cast("bigint").alias("qty"))
    )
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    sellers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = sold.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        sellers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    part, supp, nation = F.col("l_partkey"), F.col("l_suppkey"), F.col("n_nationkey")
    return rows.select(
        (part * 1000000 + supp).alias("pos"),
        F.concat(F.lit("  "), "p_name", F.lit("  ")).alias("name"),
        F.when(nation == 0, "bengaluru")
        .when(nation == 1, "New  Delhi")
        .when(nation == 2, "bombay")
        .when(nation == 24, "")
        .otherwise(F.lower("n_name"))
        .alias(CITY),
        F.when(part % 17 != 0, F.concat_ws(" ", "r_name", "p_brand")).alias("location"),
        F.concat("p_type", F.lit(" , "), F.split("p_name", " ")[1], F.lit(","), "p_type").alias("cuisines"),
        F.when(part % 10 == 0, "NEW")
        .when(part % 10 == 1, "-")
        .when(part % 10 > 2, F.format_string("%d.%d/5", 1 + part % 4, supp % 10))
        .alias("rate"),
        F.when(part % 13 != 0, F.format_number(90 + (part * 37 + supp * 11) % 2400, 0)).alias(COST),
        F.col("qty").cast("string").alias("votes"),
        F.concat_ws(" ", "s_name", "n_name").alias("address"),
    )


def prefs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference profile per customer, all customers; some break a rule, some find nothing on purpose."""
    key = F.col("c_custkey")
    budget = (
        F.when(key % 50 == 0, "0")
        .when(key % 50 == 2, "12.5")
        .when(key % 50 != 1, (100 + key * 53 % 2500).cast("string"))
    )
    segment = F.col("c_mktsegment")

    def words(*items: str):
        return F.array(*[F.lit(i) for i in items])

    # A narrow table is one small file, but every profile is much work: without a shuffle one task would do all of it.
    customers = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism, key)
    return customers.select(
        key.alias("pref_id"),
        F.when(key % 4 == 1, F.concat(F.lit(" nation_"), F.col("c_nationkey").cast("string"), F.lit(" ")))
        .when(key % 4 == 2, "Bengaluru")
        .when(key % 4 == 3, "asia  brand#1")
        .alias("location"),
        F.when(key % 10 != 7, budget).alias("budget_for_two_inr"),
        F.when(key % 10 == 7, budget).alias("budget_max_inr"),
        F.when(key % 25 == 6, words("Unlisted Kitchen"))
        .when(segment == "BUILDING", words("Economy", "Ring"))
        .when(segment == "FURNITURE", words("Widget"))
        .when(segment == "HOUSEHOLD", words("promo", " Gear ", "plate"))
        .when(segment == "MACHINERY", words("  standard ", ""))
        .otherwise(F.array().cast("array<string>"))
        .alias("cuisines"),
        F.when(key % 50 == 3, 6.0).otherwise((key % 11) / 2.0).alias("min_rating"),
        F.when(key % 3 == 0, "").otherwise(" quick service ").alias("extras"),
        F.when(key % 3 != 0, (1 + key % 13).cast("int")).alias("top_k"),
    )


def responses(candidates: DataFrame) -> DataFrame:
    """Synthetic model answers, one per profile with candidates, in seven shapes (an eighth stays unanswered).

    By ``pref_id % 8``: 0 all ids backwards, 1 fenced with ranks as text, 2 a stranger first and a broken rank,
    3 names in upper case, 4 the same id twice without words, 5 not JSON, 6 no list, 7 no answer.
    """
    kind = F.col("pref_id") % 8
    listed = candidates.groupBy("pref_id").agg(
        F.sort_array(F.collect_list(F.struct("cand_pos", "id", "name"))).alias("c")
    )

    def entry(rank, ref, why):
        return F.struct(rank.alias("rank"), ref.alias("restaurant_id"), why.alias("explanation"))

    def body(summary, entries):
        return F.to_json(F.struct(summary.alias("summary"), entries.alias("recommendations")))

    picks = F.concat(F.lit("Picks for "), F.col("pref_id").cast("string"))
    size = F.size("c")
    first = F.col("c")[0]
    last = F.element_at("c", -1)
    word = F.lit(" good ")
    backwards = F.transform("c", lambda x: entry(size + 1 - x["cand_pos"], x["id"], F.concat(F.lit("why "), x["name"])))
    textual = F.transform(F.slice("c", 1, 3), lambda x: entry(x["cand_pos"].cast("string"), x["id"], word))
    broken = F.concat(
        F.to_json(F.array(entry(F.lit(1), F.lit("nobody"), word))),
        F.to_json(F.array(entry(F.lit("1.5"), last["id"], word))),
        F.to_json(F.array(entry(F.lit(2.9), first["id"], word))),
    )
    strangers = F.concat(
        F.lit('{"recommendations":'), F.replace(broken, F.lit("]["), F.lit(",")), F.lit(',"summary":7}')
    )
    named = F.transform(F.slice("c", 1, 2), lambda x: entry(x["cand_pos"], F.upper(x["name"]), word))
    twice = F.array(entry(F.lit(1), last["id"], F.lit("")), entry(F.lit(2), last["id"], word))
    raw = (
        F.when(kind == 0, body(picks, backwards))
        .when(kind == 1, F.concat(F.lit("```json\n"), body(F.lit(None).cast("string"), textual), F.lit("\n```\n")))
        .when(kind == 2, strangers)
        .when(kind == 3, body(picks, named))
        .when(kind == 4, body(picks, twice))
        .when(kind == 5, F.lit('{"summary": "cut off'))
        .when(kind == 6, F.lit('{"summary": "nothing to say"}'))
    )
    return listed.where(kind != 7).select("pref_id", raw.alias("raw"))
