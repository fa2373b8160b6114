"""Registration of queries with their SQL, and the bindings of concepts to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql is the same in DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def author_name(key: str = "c_custkey") -> Column:
    return F.concat(F.lit("author "), F.col(key).cast("string"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors: race is the market segment, gender the parity of the key."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("author"), "c_name", "c_acctbal", F.lower("c_mktsegment").alias("race"), F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("gender"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses: one order each; the customer is the quote, the priority the prompt, the status the outcome."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("prompt_type"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderstatus") != "P").alias("any_name"), F.col("o_totalprice").alias("price"))
    return o.join(customers(spark, sf_dir).select("author", "race", "gender"), "author").withColumn("quote_id", F.col("author"))


#: The same two tables in SQL.
CUSTOMERS = "customers AS (SELECT c_custkey AS author, c_name, c_acctbal, lower(c_mktsegment) AS race, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM customer)"
RESPONSES = CUSTOMERS + ", responses AS (SELECT o_orderkey AS row_id, o.o_custkey AS author, o.o_custkey AS quote_id, o_orderpriority AS prompt_type, o_orderstatus = 'F' AS correct, o_orderstatus <> 'P' AS any_name, o_totalprice AS price, race, gender FROM orders o JOIN customers c ON o.o_custkey = c.author)"
#: Fame: the sum of order totals as whole hits, and the number of orders.
FAME = CUSTOMERS + ", fame AS (SELECT o_custkey AS author, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS hits, count(*) AS n FROM orders GROUP BY o_custkey), famous AS (SELECT c.author, race, gender, race || '_' || gender AS grp, hits, log10(CAST(hits AS DOUBLE)) AS log10_hits, n FROM customers c JOIN fame f ON c.author = f.author)"


def famous(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("hits"), F.count(F.lit(1)).alias("n"))
    out = customers(spark, sf_dir).select("author", "race", "gender").join(o, "author")
    return out.withColumns({"grp": F.concat_ws("_", "race", "gender"), "log10_hits": F.log10(F.col("hits").cast("double"))})
