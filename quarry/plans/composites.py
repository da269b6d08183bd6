"""Queries of the smaller composite operators: cards, listings, lineage, validation and outcome counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import graphs as G
from quarry.operators import relational as R
from quarry.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("m02_authority_phase", """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS job, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS units, min_by(l_partkey, (l_linenumber, l_partkey)) AS first_unit FROM lineitem GROUP BY 1)
SELECT o_custkey, job, status, coalesce(units, 0) AS units, first_unit FROM o LEFT JOIN l ON l_orderkey = job
""")
def authority(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("job"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    units = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count(F.lit(1)).alias("units"), F.min(F.struct("l_linenumber", "l_partkey")).alias("u"))
    return o.join(units, "job", "left").select("o_custkey", "job", "status", F.coalesce("units", F.lit(0)).alias("units"), F.col("u.l_partkey").alias("first_unit"))


@query("m03_resource_detail", "SELECT o_orderkey, c_name, list_sort(list_distinct(list(l_suppkey))) AS suppliers, list_sort(list_distinct(list(l_returnflag))) AS flags FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def detail(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(lines, "o_orderkey").select("o_orderkey", "c_name", "suppliers", "flags")


@query("m04_unit_page", "SELECT total, doc_id, source FROM (SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'license')), (SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20)")
def unit_page(spark, d):
    rows = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "source")
    return R.page_with_total(rows, [F.col("doc_id")], 20).filter("doc_id IS NOT NULL")


@query("m07_version_card", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, any_value(n) AS stages, max_by(event_type, event_id) AS latest, string_agg(event_type, ',' ORDER BY event_id DESC) AS last_stages FROM e WHERE r <= 20 GROUP BY 1
""")
def card(spark, d):
    rows = R.latest_by(table(spark, d, "events").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))), ["user_id"], [F.desc("event_id")], 20)
    g = rows.groupBy("user_id").agg(F.max("n").alias("stages"), F.max_by("event_type", "event_id").alias("latest"), F.sort_array(F.collect_list(F.struct("event_id", "event_type")), asc=False).alias("l"))
    return g.select("user_id", "stages", "latest", F.array_join(F.transform("l", lambda x: x.event_type), ",").alias("last_stages"))


@query("m08_discovery_upsert", """
WITH a AS (SELECT p_partkey AS id, p_brand AS resource, md5(p_name) AS hash FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'moved' ELSE p_brand END AS resource, CASE WHEN p_partkey % 8 = 0 THEN 'new' ELSE md5(p_name) END AS hash FROM part WHERE p_partkey % 6 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'DISCOVERED' WHEN b.id IS NULL THEN 'MISSING' WHEN a.resource <> b.resource OR a.hash <> b.hash THEN 'SOURCE_VERSION_MUTATED' ELSE 'UNCHANGED' END AS outcome FROM a FULL JOIN b ON a.id = b.id
""")
def discovery(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("resource"), F.md5("p_name").alias("hash"))
    a = p.filter("id % 5 <> 0").alias("a")
    b = p.filter("id % 6 <> 0").select("id", F.when(F.col("id") % 9 == 0, "moved").otherwise(F.col("resource")).alias("resource"), F.when(F.col("id") % 8 == 0, "new").otherwise(F.col("hash")).alias("hash")).alias("b")
    outcome = F.when(F.col("a.id").isNull(), "DISCOVERED").when(F.col("b.id").isNull(), "MISSING").when((F.col("a.resource") != F.col("b.resource")) | (F.col("a.hash") != F.col("b.hash")), "SOURCE_VERSION_MUTATED").otherwise("UNCHANGED")
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), outcome.alias("outcome"))


@query("m10_lineage", """
WITH RECURSIVE t AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 64 > 0 THEN o_orderkey - 1 END AS p, o_orderstatus <> 'P' OR o_orderkey % 3 > 0 AS ok FROM orders),
w AS (SELECT n, ok FROM t WHERE p IS NULL OR p NOT IN (SELECT n FROM t) UNION ALL SELECT t.n, t.ok AND w.ok FROM t JOIN w ON t.p = w.n) SELECT n AS o_orderkey, CASE WHEN ok THEN 'COMPLETE' ELSE 'BLOCKED' END AS lineage FROM w
""")
def lineage(spark, d):
    o = table(spark, d, "orders").withColumn("parent", F.when(F.col("o_orderkey") % 64 > 0, F.col("o_orderkey") - 1))
    found = G.ancestors_all(o, "o_orderkey", "parent", (F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 3 > 0), rounds=7)
    return found.select("o_orderkey", F.when(F.col("cyclic"), "CYCLE").when(F.col("allowed"), "COMPLETE").otherwise("BLOCKED").alias("lineage"))


@query("m14_concept_inventory", """
SELECT o_custkey, max(o_orderkey) AS version, bool_or(o_orderstatus = 'F') AS ready, bool_and(o_totalprice > 1000) AS approved FROM orders GROUP BY 1
""")
def inventory(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"), F.bool_or(F.col("o_orderstatus") == "F").alias("ready"), F.bool_and(F.col("o_totalprice") > 1000).alias("approved"))


@query("m17_relation_mapping", "SELECT l_suppkey, list_sort(list_distinct(list(l_partkey % 25))) AS ids FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def relation_mapping(spark, d):
    return table(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 25)).alias("ids"))


@query("m18_related_authority", "SELECT s_suppkey, CASE WHEN s_suppkey = 5 THEN 0 ELSE row_number() OVER (ORDER BY s_suppkey = 5 DESC, s_suppkey) - 1 END AS place FROM supplier WHERE s_suppkey = 5 OR s_acctbal > 0 ORDER BY s_suppkey = 5 DESC, s_suppkey LIMIT 100")
def related_authority(spark, d):
    rows = table(spark, d, "supplier").filter("s_suppkey = 5 OR s_acctbal > 0").select("s_suppkey")
    seed = F.col("s_suppkey") == 5
    first = R.page(rows, [F.desc(seed), F.col("s_suppkey")], 100)
    return first.select("s_suppkey", (F.row_number().over(Window.orderBy(F.desc(seed), "s_suppkey")) - 1).alias("place"))  # a hundred rows


@query("m24_history_snapshot", """
SELECT l_orderkey, count(*) AS pages, count(DISTINCT l_linenumber) = count(*) AS unique_pages, min(l_linenumber) >= 1 AND max(l_linenumber) <= 7 AS in_range, array_to_string(list_sort(list_distinct(list(CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'SUCCEEDED' ELSE 'PENDING' END))), ',') AS states FROM lineitem GROUP BY 1
""")
def history(spark, d):
    known = F.create_map(*(F.lit(x) for x in ("R", "FAILED", "A", "SUCCEEDED")))
    state = F.coalesce(F.try_element_at(known, F.col("l_returnflag")), F.lit("PENDING"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("l_linenumber").alias("u"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.array_join(F.array_sort(F.collect_set(state)), ",").alias("states"))
    return g.select("l_orderkey", "pages", (F.col("u") == F.col("pages")).alias("unique_pages"), ((F.col("a") >= 1) & (F.col("b") <= 7)).alias("in_range"), "states")


@query("m27_bilingual_counts", "SELECT conv_id, count(*) AS segments, count(*) FILTER (WHERE role = 'assistant') AS translated, count(*) FILTER (WHERE length(text) > 200) AS timed, md5(string_agg(role || ':' || length(text), ',' ORDER BY turn)) AS revision FROM conversations GROUP BY 1")
def bilingual(spark, d):
    line = F.concat(F.col("role"), F.lit(":"), F.char_length("text").cast("string"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("role") == "assistant").alias("translated"), F.count_if(F.char_length("text") > 200).alias("timed"), F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("l"))
    return g.select("conv_id", "segments", "translated", "timed", F.md5(F.array_join(F.transform("l", lambda r: r.x), ",")).alias("revision"))


@query("m28_retry_reset", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS reset, count(*) FILTER (WHERE event_type <> 'error') AS kept, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'QUEUED' ELSE 'DONE' END AS status FROM events GROUP BY 1")
def retry(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("reset"), F.count_if(F.col("event_type") != "error").alias("kept"))
    return g.withColumn("status", F.when(F.col("reset") > 0, "QUEUED").otherwise("DONE"))


@query("m31_run_history", "SELECT event_id, user_id FROM events WHERE event_type <> 'signup' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 25")
def runs(spark, d):
    return R.page(table(spark, d, "events").filter("event_type <> 'signup'"), [F.desc("ts"), F.desc("event_id")], 25, 25).select("event_id", "user_id")


@query("m32_record_validation", "WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 11 <> 0), b AS (SELECT vec_id, embedding[1]::DOUBLE + CASE WHEN vec_id % 13 = 0 THEN 0.001 ELSE 0 END AS x FROM embeddings WHERE vec_id % 17 <> 0) SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(abs(a.x - b.x) <= 1e-5, false) AS valid FROM a FULL JOIN b ON a.vec_id = b.vec_id")
def validation(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    a = e.filter("vec_id % 11 <> 0")
    b = e.filter("vec_id % 17 <> 0").select("vec_id", (F.col("x") + F.when(F.col("vec_id") % 13 == 0, 0.001).otherwise(0.0)).alias("y"))
    return a.join(b, "vec_id", "full_outer").select("vec_id", F.coalesce(F.abs(F.col("x") - F.col("y")) <= 1e-5, F.lit(False)).alias("valid"))


@query("m35_projection_outcomes", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'INELIGIBLE' WHEN p_partkey % 10 = 0 THEN 'UNAPPROVED' WHEN s_suppkey IS NULL THEN 'CREATED' WHEN s_acctbal < 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS outcome FROM part LEFT JOIN supplier ON s_suppkey = p_partkey) GROUP BY 1
""")
def outcomes(spark, d):
    rows = table(spark, d, "part").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    outcome = F.when(F.col("p_size") < 5, "INELIGIBLE").when(F.col("p_partkey") % 10 == 0, "UNAPPROVED").when(F.col("s_suppkey").isNull(), "CREATED").when(F.col("s_acctbal") < 0, "CONFLICT").otherwise("UNCHANGED")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("m36_source_resolution", """
WITH v AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS version, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1), i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_custkey, version, CASE WHEN n = 1 THEN 'SOURCE' WHEN n > 1 THEN 'LOCAL' ELSE 'UNKNOWN' END AS origin, CASE WHEN st = 'P' THEN 'blocked' WHEN n IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM v LEFT JOIN i ON l_orderkey = version
""")
def resolution(spark, d):
    v = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("v"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    rows = v.select("o_custkey", F.col("v.o_orderkey").alias("version"), F.col("v.o_orderstatus").alias("st")).join(n, "version", "left")
    return rows.select("o_custkey", "version", F.when(F.col("n") == 1, "SOURCE").when(F.col("n") > 1, "LOCAL").otherwise("UNKNOWN").alias("origin"), F.when(F.col("st") == "P", "blocked").when(F.col("n").isNull(), "unavailable").otherwise("available").alias("status"))


@query("e06_policy_grid", """
WITH h AS (SELECT doc_id, least(n_chars, 10000) / 10000.0::DOUBLE AS s, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)), t AS (SELECT range / 10.0::DOUBLE AS t FROM range(0, 10)),
g AS (SELECT t, round((count(*) FILTER (WHERE ok AND s > t)) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS recall, round((count(*) FILTER (WHERE ok AND s <= t)) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS false_abstention FROM t, h GROUP BY 1)
SELECT t AS threshold, recall, false_abstention, recall >= 0.95 AND false_abstention <= 0.05 AS allowed FROM g
""")
def policy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.least("n_chars", F.lit(10000)) / 10000.0).alias("s"), (F.col("quality") == 1).alias("ok"))
    grid = rows.select("s", "ok", F.explode(F.array(*(F.lit(i / 10.0) for i in range(10)))).alias("threshold"))  # ten policies
    n = F.greatest(F.count_if("ok"), F.lit(1))
    g = grid.groupBy("threshold").agg(F.round(F.count_if(F.col("ok") & (F.col("s") > F.col("threshold"))) / n, 6).alias("recall"), F.round(F.count_if(F.col("ok") & (F.col("s") <= F.col("threshold"))) / n, 6).alias("false_abstention"))
    return g.withColumn("allowed", (F.col("recall") >= 0.95) & (F.col("false_abstention") <= 0.05))
