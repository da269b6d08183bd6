"""Queries of the relational families: scans, joins, predicates, ranking, paging, set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import relational as R
from quarry.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


CURSOR = dt.datetime(2024, 1, 15)


def _ntz(value: str):
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


@query("src02_key_violations", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, d):
    return R.unique_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("src04_keyset_replay_scan", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders
WHERE (o_orderdate, o_orderkey) > (least((SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 3 = 0), TIMESTAMP '2030-01-01') - INTERVAL 300 SECOND - INTERVAL 30 DAY, -1)
""")
def replay_scan(spark, d):
    orders = table(spark, d, "orders")
    cursor = orders.filter("o_orderkey % 3 = 0").agg(F.max("o_orderdate").alias("c"))  # one row
    stamp = F.expr("least(c, TIMESTAMP_NTZ '2030-01-01 00:00:00') - INTERVAL 300 SECONDS - INTERVAL 30 DAYS")
    rows = R.keyset_after(orders.crossJoin(F.broadcast(cursor)).withColumn("from_stamp", stamp), "o_orderdate", "o_orderkey", F.col("from_stamp"), F.lit(-1).cast("long"))
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("src05_selected_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def selected_ids(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("src07_missing_dependencies", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def missing_dependencies(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_custkey").join(known, "o_custkey", "left_anti").distinct()


@query("src09_page_probe", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def page_probe(spark, d):
    return R.page(table(spark, d, "orders").filter("o_orderkey > 100"), [F.col("o_orderkey")], 51).select("o_orderkey", "o_custkey")


@query("src12_find", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#1' OR p_size = 10 ORDER BY p_size DESC, p_partkey LIMIT 100")
def find(spark, d):
    rows = table(spark, d, "part").filter("p_brand = 'Brand#1' OR p_size = 10")
    return R.page(rows, [F.desc("p_size"), F.col("p_partkey")], 100).select("p_partkey", "p_brand", "p_size")


@query("src14_federated_union", "SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def federated_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("src15_interval_overlap", "WITH v AS (SELECT l_orderkey, min(l_linenumber) AS page_from, max(l_linenumber) AS page_to FROM lineitem GROUP BY 1) SELECT * FROM v WHERE page_to >= 3 AND page_from <= 4")
def interval_overlap(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("page_from"), F.max("l_linenumber").alias("page_to"))
    return v.filter("page_to >= 3 AND page_from <= 4")


@query("src17_packed_bodies", "SELECT sha256(coalesce(text, '')) AS body, count(*) AS uses, min(doc_id) AS first_id FROM documents GROUP BY 1")
def packed_bodies(spark, d):
    body = F.sha2(F.coalesce("text", F.lit("")), 256).alias("body")
    return table(spark, d, "documents").groupBy(body).agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_id"))


@query("src19_delta_rows", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
""")
def delta_rows(spark, d):
    since = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"
    own = table(spark, d, "orders").filter(f"o_orderdate >= {since}").select("o_orderkey")
    child = table(spark, d, "lineitem").filter(f"l_shipdate >= {since}").select(F.col("l_orderkey").alias("o_orderkey"))
    return own.union(child).distinct()


@query("j01_effective_timestamp_join", """
SELECT o_orderkey, n_name, c_mktsegment, strftime(greatest(o_orderdate, max(l_shipdate)), '%Y-%m-%d %H:%M:%S') AS effective
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, n_name, c_mktsegment, o_orderdate
""")
def effective_timestamp(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    nation = table(spark, d, "nation")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    effective = F.date_format(F.greatest("o_orderdate", "shipped"), "yyyy-MM-dd HH:mm:ss")
    return rows.join(shipped, "o_orderkey", "left").select("o_orderkey", "n_name", "c_mktsegment", effective.alias("effective"))


@query("j03_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j04_anti_no_child", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_no_child(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j05_oldest_open_order", """
SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) m ON o.o_custkey = m.o_custkey AND o.o_orderkey = m.k
WHERE o.o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)
""")
def oldest_open(spark, d):
    orders = table(spark, d, "orders")
    first = orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    busy = orders.filter("o_orderstatus = 'P'").select("o_custkey")
    return first.join(busy, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("j06_grouped_count", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def grouped_count(spark, d):
    return R.grouped_lookup(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("j07_distinct_three_way", "SELECT DISTINCT r_name, n_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def distinct_three_way(spark, d):
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", "s_suppkey").distinct()


@query("j08_self_chain", """
SELECT a.event_id, b.event_id AS parent_id, c.event_id AS grandparent_id FROM events a
LEFT JOIN events b ON b.event_id = a.event_id - 1 AND b.user_id = a.user_id LEFT JOIN events c ON c.event_id = b.event_id - 1 AND c.user_id = b.user_id
""")
def self_chain(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    a, b, c = e.alias("a"), e.alias("b"), e.alias("c")
    ab = a.join(b, F.expr("b.event_id = a.event_id - 1 AND b.user_id = a.user_id"), "left")
    abc = ab.join(c, F.expr("c.event_id = b.event_id - 1 AND c.user_id = b.user_id"), "left")
    return abc.select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("parent_id"), F.col("c.event_id").alias("grandparent_id"))


@query("j09_page_with_total", "SELECT total, p_partkey, p_name FROM (SELECT count(*) AS total FROM part WHERE p_size > 25) LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 25 ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40) ON true")
def page_total(spark, d):
    rows = table(spark, d, "part").filter("p_size > 25")
    return R.page_with_total(rows.select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 20, 40).select("total", "p_partkey", "p_name")


@query("j12_exact_identity_map", "SELECT c_custkey, coalesce(s_suppkey, c_custkey) AS master_id, s_suppkey IS NOT NULL AS mapped FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def identity_map(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("s_suppkey", "c_custkey").alias("master_id"), F.col("s_suppkey").isNotNull().alias("mapped"))


@query("j19_all_children_allowed", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def all_allowed(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok")).filter("ok").select("l_orderkey")


@query("p01_live_predicate", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0 AND o_orderdate IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def live(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus <> 'P' AND o_totalprice > 0 AND o_orderdate IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_orderkey")


@query("p02_ilike_literal", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%' ESCAPE '\\'")
def ilike(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike(R.like_literal("RE"))).select("p_partkey", "p_name")


@query("p03_contains_id_or_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(CAST(doc_id AS VARCHAR), '77')")
def contains_either(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("worthless")) | F.contains(F.col("doc_id").cast("string"), F.lit("77"))).select("doc_id")


@query("p04_casefold_search", "SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'chssch')")
def casefold_search(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit("chssch"))).select("doc_id")


@query("p05_suffix", "SELECT page_id, url FROM pages WHERE ends_with(lower(url), '#top') OR ends_with(lower(url), '/')")
def suffix(spark, d):
    low = F.lower("url")
    return table(spark, d, "pages").filter(low.endswith("#top") | low.endswith("/")).select("page_id", "url")


@query("p06_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_path(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k > 50")


@query("p07_access_decision", """
SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'ADMIN' WHEN o_custkey % 10 = 3 THEN 'OWNER' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SHARED'
  WHEN o_orderstatus = 'P' THEN 'NOT_PUBLISHED' ELSE 'DENIED' END AS decision FROM orders
""")
def access(spark, d):
    decision = F.expr("CASE WHEN o_custkey % 50 = 0 THEN 'ADMIN' WHEN o_custkey % 10 = 3 THEN 'OWNER' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SHARED' WHEN o_orderstatus = 'P' THEN 'NOT_PUBLISHED' ELSE 'DENIED' END")
    return table(spark, d, "orders").select("o_orderkey", decision.alias("decision"))


@query("p10_status_canonical", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'view' THEN 'DRAFT' WHEN 'click' THEN 'DRAFT' WHEN 'error' THEN 'BLOCKED' END AS status FROM events")
def status(spark, d):
    known = F.create_map(*(F.lit(x) for x in ("purchase", "APPROVED", "view", "DRAFT", "click", "DRAFT", "error", "BLOCKED")))
    return table(spark, d, "events").select("event_id", F.try_element_at(known, F.col("event_type")).alias("status"))


@query("p12_metadata_text", r"""
SELECT p_partkey, 'Title: ' || trim(regexp_replace(p_name, '\s+', ' ', 'g')) || chr(10) || 'Tags: ' || array_to_string(list_sort(list_distinct([p_brand, p_type])), ', ') AS card FROM part
""")
def metadata_text(spark, d):
    title = F.trim(F.regexp_replace("p_name", r"\s+", " "))
    tags = F.array_join(F.array_sort(F.array_distinct(F.array("p_brand", "p_type"))), ", ")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("Title: "), title, F.lit("\nTags: "), tags).alias("card"))


@query("a01_filtered_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders")
def filtered_counts(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("a02_status_groups", "SELECT coalesce(nullif(event_type, 'view'), 'UNAUDITED') AS status, count(*) AS n FROM events GROUP BY 1")
def status_groups(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("UNAUDITED")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a04_grouped_min", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def grouped_min(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("a05_text_budget", "SELECT sum(length(text))::BIGINT AS chars, count(*) AS docs FROM documents")
def text_budget(spark, d):
    return table(spark, d, "documents").agg(F.sum(F.char_length("text")).alias("chars"), F.count(F.lit(1)).alias("docs"))


@query("a22_queue_counters", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'SUCCEEDED' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM events GROUP BY 1
""")
def queue_counters(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "SUCCEEDED").when(F.col("done") > 0, "PARTIAL").otherwise("FAILED"))


@query("a25_attestation", "SELECT p_brand, bool_and(p_size > 0) AS sized, count(*) FILTER (WHERE p_retailprice > 1000) AS dear, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS types FROM part GROUP BY 1")
def attestation(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_size") > 0).alias("sized"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("w01_latest_version_per_key", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE r = 1
""")
def latest(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus IN ('F', 'O')").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest_by(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w03_history_count", "SELECT o_custkey, o_orderkey, history FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS history FROM orders) WHERE r = 1")
def history(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.with_history(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "history")


@query("w04_mode_pick_catalog", """
SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, max(p_partkey) DESC NULLS LAST, p_type DESC) AS r FROM part GROUP BY 1, 2) WHERE r = 1
""")
def mode(spark, d):
    return R.mode_pick(table(spark, d, "part"), "p_brand", ["p_type"], "p_partkey").select("p_brand", "p_type", "n")


@query("w05_first_task", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def first_task(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.latest_by(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("w09_predecessor_gate", "SELECT o_orderkey, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS ready FROM orders WHERE o_orderstatus = 'O'")
def gate(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("ready"))


@query("l01_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 50)


@query("l02_keyset_page", "SELECT c_name, c_custkey FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name, c_custkey LIMIT 40")
def keyset_page(spark, d):
    return R.page(table(spark, d, "customer").filter("c_name > 'Customer#000000100'").select("c_name", "c_custkey"), [F.col("c_name"), F.col("c_custkey")], 40)


@query("l07_subject_recommendation", """
WITH n AS (SELECT s_suppkey, s_name, CASE WHEN s_nationkey % 5 = 0 THEN 95 WHEN s_acctbal > 5000 THEN 70 ELSE 50 END AS grade, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS uses FROM supplier)
SELECT s_suppkey, grade, uses FROM n ORDER BY grade DESC, uses DESC, lower(s_name), s_suppkey LIMIT 20
""")
def recommendation(spark, d):
    s = R.grouped_lookup(table(spark, d, "supplier"), "s_suppkey", table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", "uses")
    grade = F.when(F.col("s_nationkey") % 5 == 0, 95).when(F.col("s_acctbal") > 5000, 70).otherwise(50)
    return R.page(s.withColumn("grade", grade), [F.desc("grade"), F.desc("uses"), F.lower("s_name"), F.col("s_suppkey")], 20).select("s_suppkey", "grade", "uses")


@query("l09_rotated_schedule", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 3 AS method FROM benchmark")
def rotated(spark, d):
    numbered = R.prefix_sums(table(spark, d, "benchmark").select("item_id", F.lit(1).alias("one")), ["item_id"], ["one"])
    return numbered.select("item_id", F.pmod(F.col("one_sum") - 1, F.lit(3)).alias("method"))


@query("s01_catalog_union", "SELECT s_suppkey AS id, 'source' AS origin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'local' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def catalog_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    source, local = s.filter("id % 2 = 0"), s.filter("id % 3 = 0")
    return source.withColumn("origin", F.lit("source")).unionByName(local.join(source, "id", "left_anti").withColumn("origin", F.lit("local")))


@query("s02_overlap_count", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def overlap(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'O'").select("o_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("s07_confirmed_absence", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def confirmed_absence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o.filter("o_orderkey % 2 = 0"), "c_custkey", "left_anti").join(o.filter("o_orderkey % 2 = 1"), "c_custkey", "left_anti")


@query("s08_content_dedup", "SELECT source, count(DISTINCT sha256(text)) AS bodies, count(*) AS docs FROM documents GROUP BY 1")
def content_dedup(spark, d):
    once = table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("body")).agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("source").agg(F.count("body").alias("bodies"), F.sum("n").alias("docs"))
