"""Queries that make and edit parameter documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import query
from gridloom.sources import params


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each nation, a section for each of its suppliers."""
    s = ds.table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("string").alias("doc"), F.lit("Model/Sources").alias("parent"), F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("flow"), (F.col("s_suppkey") % 2 == 0).alias("on"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).alias("extra"), F.array("s_suppkey", F.col("s_suppkey") + 1).alias("xy"))


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    return params.from_rows(_rows(spark, sf), "SOURCE", ["name", "flow", "on", "extra", "xy"])


_COLUMNS = 's_nationkey::VARCHAR AS doc, s_suppkey::INT AS number, s_name AS name, round(s_acctbal, 2) AS flow, s_suppkey % 2 = 0 AS "on", CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS extra'


@query(f"SELECT {_COLUMNS} FROM supplier")
def table_to_document_and_back(spark, sf):
    """A table becomes documents, these texts, the texts documents again and these a table."""
    again = params.parse_documents(params.to_text(_tables(spark, sf)))
    found = params.numbered_sections(again, "SOURCE", ["name", "flow", "on", "extra"])
    return found.select("doc", "number", "name", F.col("flow").cast("double").alias("flow"), F.col("on").cast("boolean").alias("on"), F.col("extra").cast("long").alias("extra"))


@query("SELECT s_nationkey::VARCHAR AS doc, s_suppkey::VARCHAR AS x, (s_suppkey + 1)::VARCHAR AS y FROM supplier")
def document_lists(spark, sf):
    again = params.parse_documents(params.to_text(_tables(spark, sf))).where("key = 'xy'")
    return again.select("doc", params.value("int", 0).cast("string").alias("x"), params.value("int", 1).cast("string").alias("y"))


@query("SELECT s_nationkey::VARCHAR AS doc, 'SOURCE_' || s_suppkey AS name, true AS is_section, 1::BIGINT AS n FROM supplier UNION ALL SELECT DISTINCT s_nationkey::VARCHAR, 'count', false, 1 FROM supplier")
def document_children(spark, sf):
    """A key is added to a section that has only sections."""
    counts = _rows(spark, sf).groupBy("doc").agg(F.count("*").alias("count"))
    none = F.array(F.lit("Model"), F.lit("Sources"))
    key = counts.select("doc", none.alias("path"), F.array(F.lit(1), F.lit(1)).alias("nth"), F.lit(1).alias("line"), F.lit("count").alias("key"), F.array(F.struct(F.lit("int").alias("kind"), F.col("count").cast("string").alias("text"))).alias("values"))
    whole = params.parse_documents(params.to_text(params.joined(_tables(spark, sf), key)))
    return params.children(whole, "Model/Sources").select("doc", "name", "is_section", "n")


@query("SELECT s_nationkey::VARCHAR AS doc, 0::BIGINT AS n_keys, 'nothing' AS value FROM supplier GROUP BY s_nationkey")
def document_clear(spark, sf):
    """A section is emptied but stays; its keys have their default."""
    left = params.parse_documents(params.to_text(params.cleared(_tables(spark, sf), "Model/Sources")))
    n = left.where("path[1] = 'Sources'").groupBy("doc").agg(F.count("key").alias("n_keys"))
    return n.join(params.get(left, "Model/Sources/count", "nothing"), "doc").select("doc", "n_keys", "value")


@query("SELECT c_custkey::VARCHAR AS doc, a AS alias, (c_custkey % 1000)::BIGINT AS value FROM customer, (SELECT unnest(['HD', 'TR']) AS a) WHERE (a = 'HD' AND c_custkey % 2 = 1) OR (a = 'TR' AND c_custkey % 3 > 0)")
def document_aliases(spark, sf):
    """Each customer has a set-up of two modules, of which some are switched off."""
    key = F.col("c_custkey")
    lines = ["[FemEngine]", "[MODULE_SELECTION]", "mode_of_hydrodynamic_module = %1", "mode_of_transport_module = %2", "EndSect", "[HYDRODYNAMIC_MODULE]", "[EQUATION]", "formulation = %3", "EndSect", "EndSect", "[TRANSPORT_MODULE]", "[EQUATION]", "formulation = %3", "EndSect", "EndSect", "EndSect"]
    text = F.lit("\n".join(lines))
    for place, v in (("%1", key % 2), ("%2", key % 3), ("%3", key % 1000)):
        text = F.replace(text, F.lit(place), v.cast("string"))
    docs = ds.table(spark, sf, "customer").select(key.cast("string").alias("doc"), text.alias("text"))
    found = params.aliased(params.parse_documents(docs)).where("key = 'formulation'")
    return found.select("doc", F.get("path", F.lit(0)).alias("alias"), params.value("int").alias("value"))
