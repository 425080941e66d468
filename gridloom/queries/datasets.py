"""The tables recast as times and cells, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions.joins import spread

MISSING = -9999.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def out(c: Column | str, digits: int = 6) -> Column:
    """A value to compare: rounded, and a number instead of NaN."""
    return F.round(F.nanvl(nan.num(c), F.lit(MISSING)), digits)


def sql_out(c: str, digits: int = 6) -> str:
    return f"round(CASE WHEN ({c}) IS NULL OR isnan(({c})::DOUBLE) THEN {MISSING} ELSE ({c})::DOUBLE END, {digits})"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """time, user_id, kind, value: NaN where the event is an error."""
    e = table(spark, sf, "events")
    return e.select(F.col("ts").alias("time"), "event_id", "user_id", F.col("event_type").alias("kind"), F.when(F.col("event_type") == "error", F.lit(nan.NAN)).otherwise(F.col("value")).alias("value"))


EVENTS = "(SELECT ts AS time, event_id, user_id, event_type AS kind, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END AS value FROM events)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """time (days), total, n: NaN on the days of a month's fifth."""
    o = table(spark, sf, "orders")
    by_day = o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").cast("double").alias("n"))
    return by_day.withColumn("total", F.when(F.dayofmonth("time") == 5, F.lit(nan.NAN)).otherwise(F.col("total")))


DAILY = """(SELECT time, CASE WHEN day(time) = 5 THEN 'NaN'::DOUBLE ELSE total END AS total, n FROM (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS time, round(sum(o_totalprice), 2) AS total, count(*)::DOUBLE AS n FROM orders GROUP BY 1))"""


def grid1(spark: SparkSession, sf: str) -> DataFrame:
    """time (months), x_idx (0 to 6), quantity (NaN at x 6 every third month), discount."""
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return g.withColumn("quantity", F.when((F.col("x_idx") == 6) & (F.month("time") % 3 == 0), F.lit(nan.NAN)).otherwise(F.col("quantity")))


GRID1 = """(SELECT time, x_idx, CASE WHEN x_idx = 6 AND month(time) % 3 = 0 THEN 'NaN'::DOUBLE ELSE quantity END AS quantity, discount FROM (
  SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS time, l_linenumber - 1 AS x_idx, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2))"""


def grid2(spark: SparkSession, sf: str) -> DataFrame:
    """time (years), y_idx (quantity in tens), x_idx (0 to 6), price."""
    li = table(spark, sf, "lineitem")
    y = F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("y_idx")
    return li.groupBy(F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("time"), y, (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.round(F.avg("l_extendedprice"), 4).alias("price"))


GRID2 = """(SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS time, floor((l_quantity - 1) / 5)::INT AS y_idx, l_linenumber - 1 AS x_idx, round(avg(l_extendedprice), 4) AS price
  FROM lineitem GROUP BY 1, 2, 3)"""


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """element, x, y, code, value: the cells of a flexible mesh by their centres."""
    e = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("element"), at(0).alias("x"), at(1).alias("y"), F.col("label").alias("code"), at(2).alias("value"))


CENTRES = "(SELECT vec_id AS element, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS code, embedding[3]::DOUBLE AS value FROM embeddings)"


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """point, x, y: a point for each supplier, spread over the mesh by its numbers."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("point"), ((F.col("s_suppkey") * 37 % 101) / 101.0 * 0.4 - 0.2).alias("x"), ((F.col("s_suppkey") * 53 % 97) / 97.0 * 0.4 - 0.2).alias("y"))


STATIONS = "(SELECT s_suppkey AS point, (s_suppkey * 37 % 101) / 101.0 * 0.4 - 0.2 AS x, (s_suppkey * 53 % 97) / 97.0 * 0.4 - 0.2 AS y FROM supplier)"

#: Nodes in a row of the mesh that the parts stand for.
WIDTH = 20


def mesh_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node, x, y, z, code: the parts as nodes of a skewed grid, 20 to a row; code 1 on its edge. Places are exact decimals as in the SQL, rounded once."""
    p = table(spark, sf, "part")
    last = p.agg(F.floor(F.max("p_partkey") / WIDTH)).first()[0]
    i, j = F.col("p_partkey") % WIDTH, F.floor(F.col("p_partkey") / WIDTH)
    edge = (i == 0) | (i == WIDTH - 1) | (j == 0) | (j == last)
    return p.select(F.col("p_partkey").cast("int").alias("node"), ((i * 10 + j) / 10).alias("x"), ((j * 50 + i * 2) / 100).alias("y"), F.col("p_size").cast("double").alias("z"), F.when(edge, 1).otherwise(0).alias("code"))


NODES = """(SELECT p_partkey::INT AS node, (i + j * 0.1)::DOUBLE AS x, (j * 0.5 + i * 0.02)::DOUBLE AS y, p_size::DOUBLE AS z,
  CASE WHEN i IN (0, 19) OR j = 0 OR j = (SELECT max(p_partkey) // 20 FROM part) THEN 1 ELSE 0 END AS code
  FROM (SELECT *, p_partkey % 20 AS i, p_partkey // 20 AS j FROM part))"""


def mesh_elements(spark: SparkSession, sf: str) -> DataFrame:
    """element, nodes: the quadrilaterals of :func:`mesh_nodes`; every seventh is a triangle."""
    p = table(spark, sf, "part")
    n = p.select(F.col("p_partkey").cast("int").alias("node"))
    above = n.select((F.col("node") - WIDTH - 1).alias("node"))
    n = n.where(F.col("node") % WIDTH < WIDTH - 1).join(spread(above), "node", "left_semi")
    quad = F.array(F.col("node"), F.col("node") + 1, F.col("node") + WIDTH + 1, F.col("node") + WIDTH)
    return n.select(F.col("node").alias("element"), F.when(F.col("node") % 7 == 3, F.slice(quad, 1, 3)).otherwise(quad).cast("array<int>").alias("nodes"))


ELEMENTS = """(SELECT node AS element, CASE WHEN node % 7 = 3 THEN [node, node + 1, node + 21] ELSE [node, node + 1, node + 21, node + 20] END AS nodes
  FROM (SELECT p_partkey::INT AS node FROM part WHERE p_partkey % 20 < 19 AND p_partkey + 21 IN (SELECT p_partkey FROM part)))"""


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """point, direction_idx, frequency_idx, energy: an embedding as 8 directions by 8 frequencies."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point"), F.posexplode("embedding").alias("i", "e"))
    return e.select("point", F.floor(F.col("i") / 8).cast("int").alias("direction_idx"), (F.col("i") % 8).alias("frequency_idx"), F.abs(F.col("e").cast("double")).alias("energy"))


SPECTRA = """(SELECT vec_id AS point, (i - 1) // 8 AS direction_idx, (i - 1) % 8 AS frequency_idx, abs(embedding[i]::DOUBLE) AS energy
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
