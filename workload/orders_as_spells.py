"""The driver tables read as employment histories.

Every order becomes one spell of its customer and every supplier a person without
spells, so all derived tables grow with the inputs.  Remainders only vary values
(open ends, missing fields, titles); no row is left out.  Titles are the names of the parts ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellframe.functions import month_index
from spellframe.plans.config import HistoryConfig

CFG = HistoryConfig(
    cutoff="2000-12-31", last_complete_quarter="2000Q3", partial_quarter="2000Q4",
    panel_start_quarter="1995Q1", min_valid_start="1995-02-01", home="NATION_1",
    windows={"primary": ("1997Q4", "2000Q3"), "sensitivity": ("1996Q4", "2000Q3")})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _every(n: int, r: int = 0):
    return F.col("o_orderkey") % n == r


def positions(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    key = F.col("o_orderkey")
    nation = ((F.col("o_custkey") + F.floor(month_index(day) / 18)) % 3 + F.when(_every(7), 1).otherwise(0))
    country = F.when(_every(13), None).when(_every(31), "  ").otherwise(
        F.concat(F.lit(" NATION_"), nation.cast("string")))
    end = (F.when(_every(29), F.date_sub(day, 60))
            .when((F.col("o_orderstatus") == "O") & _every(5), None)
            .when(F.col("o_orderstatus") == "O", F.date_add(day, 180))
            .otherwise(F.date_add(day, (90 + key % 400).cast("int"))))
    group = key % 40
    return table(spark, sf, "orders").select(
        F.when(_every(101), None).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("user_id"),
        key.cast("string").alias("position_id"),
        F.when(_every(17), None).otherwise(day).alias("startdate"), end.alias("enddate"),
        country.alias("country"),
        F.when(_every(11), None).otherwise(F.concat(F.lit("metro nation_"), nation.cast("string"))).alias("metro_area"),
        F.when(_every(19), None).otherwise(F.concat(F.lit("E"), group.cast("string"))).alias("rcid"),
        F.when(_every(19), None).otherwise(F.concat(F.lit("G"), (group % 7).cast("string"))).alias("ultimate_parent_rcid"),
        F.col("o_orderpriority").alias("role_k1500_v2"),
        F.when(_every(9), None).otherwise((key % 6).cast("int")).alias("seniority"))


def positions_raw(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("_p"), "p_name")
    title = (F.when(_every(23), "Board  Member").when(_every(37), "Summer Intern")
              .when(_every(41), "Non-Executive Director").when(_every(43), "顧問委員會 member")
              .when(_every(47), " ").when(_every(53), "Executive Director, board member")
              .otherwise(F.col("p_name")))
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("_p"))
    orders = table(spark, sf, "orders").join(first, "o_orderkey", "left")
    return orders.join(part, "_p", "left").select(
        F.when(_every(101), None)
         .when(_every(97), "C-other").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("user_id"),
        key.cast("string").alias("position_id"), title.alias("title_raw"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda key, n: F.date_add(F.lit("1999-01-01").cast("date"), (F.col(key) % n).cast("int"))
    nation = lambda key: F.when(F.col(key) % 9 == 0, None).otherwise(
        F.concat(F.lit("NATION_"), (F.col(key) % 4).cast("string")))
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("user_id"),
        nation("c_nationkey").alias("user_country"), day("c_custkey", 960).alias("updated_dt"))
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("user_id"),
        nation("s_nationkey").alias("user_country"), day("s_suppkey", 720).alias("updated_dt"))
    return customers.unionByName(suppliers)


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """People named by the two master tables, by id."""
    return people(spark, sf).select("user_id")


# The same rows with clashes and gaps between the tables: copies that differ, titles and people that are not found.


def _number(column: str):
    return F.substring(column, 2, 20).cast("long")


def _twice(df: DataFrame, when) -> DataFrame:
    """Rows that fulfil the condition stand twice; ``_nth`` tells them apart."""
    return df.withColumn("_nth", F.explode(F.when(when, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def clashing_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Some spells stand twice: those with an odd number as exact copies, the others in another country."""
    key = F.col("position_id").cast("long")
    rows = _twice(positions(spark, sf), key % 61 == 0)
    return rows.withColumn("country", F.when((F.col("_nth") == 1) & (key % 2 == 0), "NATION_9").otherwise(F.col("country"))).drop("_nth")


def clashing_positions_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Some titles stand under a number that no spell has, some twice with other words."""
    key = F.col("position_id").cast("long")
    rows = _twice(positions_raw(spark, sf), key % 67 == 0)
    return rows.select("user_id", F.when(key % 59 == 0, F.concat(F.lit("x"), "position_id")).otherwise(F.col("position_id")).alias("position_id"),
                       F.when(F.col("_nth") == 1, "Other words").otherwise(F.col("title_raw")).alias("title_raw"))


def clashing_people(spark: SparkSession, sf: str) -> DataFrame:
    """Some profiles stand twice with other countries."""
    rows = _twice(people(spark, sf), _number("user_id") % 73 == 0)
    return rows.withColumn("user_country", F.when(F.col("_nth") == 1, "NATION_8").otherwise(F.col("user_country"))).drop("_nth")


def strange_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Some people stand in the cohort under an id without a profile."""
    return cohort(spark, sf).select(F.when(_number("user_id") % 71 == 0, F.concat(F.lit("X"), "user_id")).otherwise(F.col("user_id")).alias("user_id"))
