"""Queries that write rows of the supplied tables in a source's format, in the shared folder, and scan them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelight.plans.catalog import query, spread, table
from duelight.sources import io
from duelight.sources.shared import new_folder


def _lines(spark: SparkSession, rows: DataFrame, value: Column, name: str) -> str:
    """The folder of a text file with a line per row."""
    path = new_folder(spark, name)
    rows.select(value.alias("value")).write.text(path)
    return path


@query("""SELECT o.vendor_id, count(*) OVER (PARTITION BY o.vendor_id) AS files, CAST(row_number() OVER (PARTITION BY o.vendor_id ORDER BY s_suppkey) AS INTEGER) AS seq FROM (SELECT s_suppkey, 'nation=' || s_nationkey AS vendor_id FROM supplier) o""")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: a file per supplier in its nation's folder, listed by folder in the order of the names."""
    path = new_folder(spark, "source-documents")
    spread(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_nationkey").alias("nation"), "s_name").write.option("maxRecordsPerFile", 1).partitionBy("nation").text(path)
    found = io.scan_documents(spark, path)
    files = found.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("files"))
    return found.join(files, "vendor_id").select("vendor_id", "files", "seq")


@query("""SELECT event_type AS endpoint, CAST(event_id AS DOUBLE) AS fetched, CAST(user_id AS VARCHAR) AS params, CAST(event_id % 7 AS VARCHAR) AS k FROM events""")
def scanned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, JSN-01: cached answers, every second one in an envelope of its own."""
    e, own = table(spark, sf_dir, "events"), F.struct((F.col("event_id") % 7).alias("k"))
    head = [F.col("event_type").alias("_path"), F.col("event_id").alias("_fetched_at"), F.col("user_id").cast("string").alias("_params")]
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(*head, own.alias("data")))).otherwise(F.to_json(F.struct(*head, F.struct(own.alias("data"), F.lit(1).alias("pages")).alias("data"))))
    got = io.scan_registry(spark, _lines(spark, e, line, "source-answers"), lines=True)
    return got.select("endpoint", F.unix_seconds("fetched_at").cast("double").alias("fetched"), "params", F.variant_get("data", "$.k", "string").alias("k"))


@query("""SELECT s_name AS name, count(*) AS n FROM supplier GROUP BY s_name UNION ALL SELECT 'alias ' || s_nationkey, count(*) FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey""")
def scanned_xml_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: names of an XML list, from either of two elements."""
    path = new_folder(spark, "source-xml")
    alias = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("alias "), F.col("s_nationkey").cast("string")))
    table(spark, sf_dir, "supplier").select(F.col("s_name").alias("lastName"), alias.alias("aka"), F.lit(1).alias("uid")).write.format("xml").option("rowTag", "entry").option("rootTag", "list").save(path)
    return io.scan_watchlist_xml(spark, path, "entry", ["lastName", "aka", "wholeName"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_name AS name, count(*) AS n FROM supplier GROUP BY s_name""")
def scanned_json_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: names of JSON lists, one a nation."""
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("NAME"))).alias("firms"))
    got = io.scan_watchlist_json(spark, _lines(spark, per, F.to_json(F.struct("firms")), "source-json"), "firms", "NAME", lines=True)
    return got.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS list_id, p_name || ' ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' ' || p_type ELSE '' END AS name, CASE WHEN p_size % 3 = 0 THEN 'a,b' ELSE 'b' END AS datasets FROM part""")
def scanned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: names and aliases of a part as one target."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("list_id"), F.array("p_name", "p_brand").alias("names"), F.when(size % 2 == 0, F.array("p_type")).alias("aliases"), F.when(size % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("datasets"))
    return io.scan_watchlist_profiles(rows).withColumn("datasets", F.array_join("datasets", ","))


@query("""SELECT event_type, event_id % 4 IN (0, 1) AS good, count(*) AS n FROM events GROUP BY ALL""")
def checked_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: JSON payloads of the expected shape, and the others."""
    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.concat(F.lit("  "), "props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.concat(F.lit("<html>"), "props"))
    good, bad = io.validate_payload(table(spark, sf_dir, "events").select("event_type", payload.alias("payload")), "json")
    both = good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return both.groupBy("event_type", "good").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id AS key, CASE WHEN user_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS id FROM events WHERE user_id % 3 > 0 UNION ALL SELECT DISTINCT user_id, NULL FROM events WHERE user_id % 3 = 0""")
def opened_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: users' answers that are arrays of hits; objects are misses."""
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("id"))).alias("hits"))
    rows = per.select("key", F.when(F.col("key") % 3 == 0, '{"message": "none"}').otherwise(F.to_json("hits")).alias("payload"))
    return io.explode_hits(rows, "id: string").select("key", F.col("hit.id").alias("id"))


@query("""SELECT c_name AS name, c_mktsegment AS position, CASE WHEN c_custkey % 2 = 0 THEN '2001-02-03' END AS since FROM customer""")
def scanned_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: office-holders of each nation's answer."""
    value = lambda c: F.struct(c.alias("value"))
    one = F.struct(value(F.col("c_name")).alias("personLabel"), value(F.col("c_mktsegment")).alias("positionLabel"), F.when(F.col("c_custkey") % 2 == 0, value(F.lit("2001-02-03T00:00:00Z"))).alias("start"))
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(one).alias("bindings"))
    path = _lines(spark, per, F.to_json(F.struct(F.struct("bindings").alias("results"))), "source-bindings")
    return io.scan_bindings(spark.read.text(path).withColumnRenamed("value", "payload"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
    SELECT 'n' || s_nationkey AS category_id, 's' || s_suppkey AS parameter_id, CAST(place AS INTEGER) AS param_ord, CAST(s_suppkey % 5 AS DOUBLE) AS max_score, s_suppkey % 3 = 0 AS conditional, CAST(i AS INTEGER) AS ordinal, 'value > ' || i AS expr, CAST(i AS DOUBLE) AS assigned_score FROM p, (VALUES (0), (1)) t(i)""")
def loaded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: a scoring model a nation, its suppliers as parameters."""
    s = F.col("s_suppkey")
    mapping = lambda i: F.struct(F.lit(f"value > {i}").alias("expr"), F.lit("c").alias("condition"), F.lit(i).alias("assignedScore"))
    one = F.struct(s.alias("_k"), F.concat(F.lit("s"), s.cast("string")).alias("parameterId"), F.col("s_name").alias("parameterName"), (s % 5).alias("maxParameterScore"), (s % 3 == 0).alias("conditional"), F.array(mapping(0), mapping(1)).alias("scoreMappings"))
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(one)).alias("parameters"))
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    model = F.struct(F.array(F.struct(name.alias("categoryId"), name.alias("categoryName"), "parameters")).alias("categories"), F.array(F.struct(F.lit("A").alias("grade"), F.lit(1).alias("minScore"))).alias("grades"))
    params, rules, _ = io.load_score_rules(spark, _lines(spark, per, F.to_json(model), "source-model"), lines=True)
    return params.join(rules, "parameter_id").select("category_id", "parameter_id", "param_ord", "max_score", "conditional", "ordinal", "expr", "assigned_score")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS vendor_id, CAST(o_orderkey AS VARCHAR) AS file_name, lower(o_orderpriority) AS doc_type FROM orders WHERE o_orderstatus <> 'O'""")
def loaded_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: overrides of document types from a CSV table with blank cells."""
    path = new_folder(spark, "source-overrides")
    kind = F.when(F.col("o_orderstatus") == "O", F.lit("  ")).otherwise(F.col("o_orderpriority"))
    table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").alias("file_name"), kind.alias("doc_type")).write.csv(path, header=True)
    return io.load_overrides(spark, path)


@query("""SELECT conv_id AS vendor_id, turn, role FROM conversations WHERE conv_id % 2 = 0 OR turn = 0""")
def scanned_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SRC-13: conversations as traces; a later write of some vendors leaves those of others."""
    path, rows = new_folder(spark, "source-traces"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), "turn", "role")
    io.write_traces(rows, path)
    io.write_traces(rows.where("vendor_id % 2 = 1 and turn = 0"), path)
    return io.scan_traces(spark, path, lines=True).select(F.col("vendor_id").cast("long").alias("vendor_id"), "turn", "role")


@query("""SELECT c_custkey AS vendor_id, 'com_bank_verification' AS parameter_id, CASE WHEN c_custkey % 3 = 0 THEN 'manual' ELSE 'fresh' END AS value, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS note FROM customer UNION ALL SELECT c_custkey, 'other', 'fresh', '' FROM customer""")
def manual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: manual values of one parameter, of entries that have one."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "vendor_id")
    resolved = c.select("vendor_id", F.explode(F.array(F.lit("com_bank_verification"), F.lit("other"))).alias("parameter_id"), F.lit("fresh").alias("value"), F.lit("").alias("note"))
    manual = c.where("vendor_id % 3 < 2").select("vendor_id", F.when(F.col("vendor_id") % 3 == 0, "manual").alias("value"), F.col("c_name").alias("note"))
    return io.apply_manual_overrides(resolved, manual, "com_bank_verification")


@query("""SELECT c_custkey AS vendor_id, CAST(CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS DOUBLE) AS score, CAST(c_nationkey AS INTEGER) AS nation FROM customer""")
def written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: scores by nation; one nation is written again and replaces only itself."""
    path, rows = new_folder(spark, "source-outputs"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.lit(1.0).alias("score"), F.col("c_nationkey").cast("int").alias("nation"))
    io.write_outputs({"scores": rows}, path, "nation")
    io.write_outputs({"scores": rows.where("nation = 3").withColumn("score", F.lit(2.0))}, path, "nation")
    return spark.read.parquet(f"{path}/scores").select("vendor_id", "score", "nation")
