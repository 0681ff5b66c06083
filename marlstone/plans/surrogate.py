"""The benchmark tables read as coverage data.

A stand-in that carries no coverage meaning: module is the customer's nation, package the order's
priority, source the order, line the line number; open lines are the unit engine's, finished ones the
instrumented engine's; a line that was returned or accepted is covered, a returned one has a branch gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Probes of the line items that meet ``where``, with their discount as ``discount``."""
    lines = table(spark, sf_dir, "lineitem").filter(where)
    grain = lines.groupBy(F.when(F.col("l_linestatus") == "O", "unit").otherwise("instrumented").alias("engine"), "l_orderkey", F.col("l_linenumber").alias("line_no")).agg(
        F.count_if(F.col("l_returnflag") == "N").alias("mi"),
        F.count_if(F.col("l_returnflag") != "N").alias("ci"),
        F.count_if(F.col("l_returnflag") == "R").alias("mb"),
        F.count_if(F.col("l_returnflag") == "A").alias("cb"),
        F.max("l_discount").alias("discount"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("package"))
    modules = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("module"))
    named = orders.join(modules, F.col("o_custkey") == F.col("c_custkey"))
    out = grain.join(named, F.col("l_orderkey") == F.col("o_orderkey"))
    return out.select("engine", "module", "package", F.col("l_orderkey").cast("string").alias("source_name"), "line_no", "mi", "ci", "mb", "cb", "discount")


def probe_sql(where: str = "true", name: str = "probe") -> str:
    """The same as a common table expression."""
    return f"""{name} AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'unit' ELSE 'instrumented' END AS engine, n_name AS module, o_orderpriority AS package,
         CAST(l_orderkey AS VARCHAR) AS source_name, l_linenumber AS line_no,
         COUNT(*) FILTER (l_returnflag = 'N') AS mi, COUNT(*) FILTER (l_returnflag <> 'N') AS ci,
         COUNT(*) FILTER (l_returnflag = 'R') AS mb, COUNT(*) FILTER (l_returnflag = 'A') AS cb, MAX(l_discount) AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE {where} GROUP BY ALL)"""


def ranges_sql(lines: str, keys: str) -> str:
    """Range texts by key from a relation of distinct (keys, line_no)."""
    return f"""SELECT {keys}, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges
  FROM (SELECT {keys}, g, MIN(line_no) AS lo, MAX(line_no) AS hi
        FROM (SELECT {keys}, line_no, line_no - ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY line_no) AS g FROM ({lines})) GROUP BY {keys}, g)
  GROUP BY {keys}"""
