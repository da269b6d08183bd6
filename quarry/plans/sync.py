"""Queries of the synchronisation and reconciliation families over perturbed copies of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators import sync as S
from quarry.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


#: A source that drops, adds and changes customers by arithmetic on the key, and the master it feeds.
_SOURCE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN c_name || '*' ELSE c_name END AS name, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment, 100 - c_custkey % 9 AS updated FROM customer WHERE c_custkey % 10 <> 0"
_TARGET = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 100 - c_custkey % 7 AS updated FROM customer WHERE c_custkey % 12 <> 0"


def _pair(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    source = c.filter(key % 10 != 0).select(key.alias("id"), F.when(key % 11 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("name"), F.when(key % 13 != 0, F.col("c_mktsegment")).alias("segment"), (100 - key % 9).alias("updated"))
    target = c.filter(key % 12 != 0).select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), (100 - key % 7).alias("updated"))
    return source, target


_ACTIONS = f"""
WITH s AS ({_SOURCE}), t AS ({_TARGET}), m AS (
  SELECT s.id, t.id IS NULL AS absent, s.updated < t.updated AS older, s.name, coalesce(s.segment, t.segment) AS segment, t.name AS tn, t.segment AS ts,
    coalesce(s.segment <> t.segment, false) AS conflict FROM s LEFT JOIN t ON s.id = t.id),
a AS (SELECT *, CASE WHEN absent THEN 'INSERTED' WHEN conflict THEN 'ERROR' WHEN older THEN 'SKIPPED' WHEN name IS DISTINCT FROM tn OR segment IS DISTINCT FROM ts THEN 'UPDATED' ELSE 'SKIPPED' END AS action FROM m)
"""


@query("snk01_upsert_actions", _ACTIONS + "SELECT id, action, CASE WHEN NOT absent AND action IN ('SKIPPED', 'ERROR') THEN tn ELSE name END AS name, CASE WHEN NOT absent AND action IN ('SKIPPED', 'ERROR') THEN ts ELSE segment END AS segment FROM a")
def upsert(spark, d):
    return R.upsert_actions(*_pair(spark, d), "id", "updated", ["name", "segment"], sticky=["segment"])


@query("snk06_action_counts", _ACTIONS + "SELECT action, count(*) AS n FROM a GROUP BY 1")
def action_counts(spark, d):
    return upsert(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("snk02_federated_ids", """
SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN CAST(s_suppkey AS VARCHAR) WHEN c_custkey % 5 = 0 THEN 'L' || c_custkey ELSE 'F' || substr(sha256(c_name), 1, 29) END AS master_id
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def federated_ids(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    made = F.concat(F.lit("F"), F.substring(F.sha2("c_name", 256), 1, 29))
    legacy = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("L"), F.col("c_custkey").cast("string")))
    return rows.select("c_custkey", F.coalesce(F.col("s_suppkey").cast("string"), legacy, made).alias("master_id"))


@query("snk03_relation_replace", """
WITH n AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS s FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1), o AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS s FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(len(n.s), 0) AS new_children, coalesce(len(o.s), 0) AS old_children FROM n FULL JOIN o ON n.id = o.id WHERE n.s IS DISTINCT FROM o.s
""")
def relation_replace(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber")
    out = R.replaced_relations(rows.filter("l_linenumber <> 3"), rows.filter("l_linenumber <> 4"), "id", "l_partkey")
    return out.select("id", F.coalesce(F.size("new"), F.lit(0)).alias("new_children"), F.coalesce(F.size("old"), F.lit(0)).alias("old_children"))


@query("snk04_insert_or_ignore", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def insert_or_ignore(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    have = n.filter("n_nationkey % 2 = 0")
    return have.unionByName(n.join(have, "n_nationkey", "left_anti").withColumn("n_name", F.upper("n_name")))


@query("snk05_checkpoint_advance", "SELECT user_id, max(event_id) AS last_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY 1")
def checkpoint(spark, d):
    best = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("t"))
    return best.select("user_id", "last_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("snk08_mark_obsolete", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AS is_current FROM orders")
def mark_obsolete(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    current = table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("c", F.lit(True))
    return orders.join(current, "o_orderkey", "left").select("o_orderkey", F.coalesce("c", F.lit(False)).alias("is_current"))


@query("snk14_sequence_allocator", "SELECT p_partkey, 1000 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq FROM part")
def sequences(spark, d):
    from pyspark.sql.window import Window

    return table(spark, d, "part").select("p_partkey", (1000 + F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).alias("seq"))


@query("snk17_report_escape", r"SELECT event_id, CASE WHEN regexp_matches(ltrim(v), '^[=+\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' || event_type WHEN 1 THEN ' -' || event_type ELSE event_type END AS v FROM events)")
def report_escape(spark, d):
    from quarry.sources.sinks import escape_formula

    k = F.col("event_id") % 4
    v = F.when(k == 0, F.concat(F.lit("="), "event_type")).when(k == 1, F.concat(F.lit(" -"), "event_type")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", escape_formula(v).alias("cell"))


@query("a06_table_fingerprint", """
WITH r AS (SELECT o_orderkey AS k, o_orderdate AS s, o_totalprice AS b, md5(o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS d FROM orders),
a AS (SELECT k1, count(*) AS n, min(k) AS lo, max(k) AS hi, max(s) AS s, sum(b) AS b, md5(string_agg(d, '' ORDER BY k, d)) AS d FROM (SELECT *, (row_number() OVER (ORDER BY k, d) - 1) // 4096 AS k1 FROM r) GROUP BY 1)
SELECT sum(n)::BIGINT AS n, min(lo) AS first_id, max(hi) AS last_id, strftime(max(s), '%Y-%m-%d %H:%M:%S') AS newest, round(sum(b), 2) AS bytes, CASE WHEN count(*) = 1 THEN any_value(d) ELSE md5(string_agg(d, '' ORDER BY k1)) END AS fingerprint FROM a
""")
def fingerprint(spark, d):
    return S.table_summary(table(spark, d, "orders"), "o_orderkey", "o_orderdate", "o_totalprice")


_FLAGS = f"""
WITH s AS ({_SOURCE}), t AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'stale' ELSE md5(coalesce(name, '') || '|' || coalesce(segment, '')) END AS digest FROM ({_TARGET})),
f AS (SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'ORPHAN_SOURCE' WHEN t.id % 19 = 0 THEN 'LOCAL' WHEN s.id IS NULL THEN 'ORPHAN_MASTER'
  WHEN t.digest <> md5(coalesce(t.name, '') || '|' || coalesce(t.segment, '')) THEN 'MUTATED_DOWNSTREAM' WHEN s.name IS DISTINCT FROM t.name OR s.segment IS DISTINCT FROM t.segment THEN 'DESYNC_METADATA' ELSE 'MATCHED' END AS flag,
  concat_ws(',', CASE WHEN s.name IS DISTINCT FROM t.name THEN 'name' END, CASE WHEN s.segment IS DISTINCT FROM t.segment THEN 'segment' END) AS diff FROM s FULL JOIN t ON s.id = t.id)
"""


def _flags(spark, d):
    source, target = _pair(spark, d)
    digest = F.when(F.col("id") % 17 == 0, "stale").otherwise(F.md5(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("segment", F.lit("")))))
    return S.record_flags(source, target.withColumn("digest", digest), "id", ["name", "segment"], "digest", F.col("t.id") % 19 == 0)


@query("r01_record_flags", _FLAGS + "SELECT id, flag, CASE WHEN flag = 'DESYNC_METADATA' THEN diff ELSE '' END AS fields FROM f")
def flags(spark, d):
    return _flags(spark, d)


@query("a10_discrepancy_report", _FLAGS + """, c AS (SELECT count(*) FILTER (WHERE flag = 'MATCHED') AS matched, count(*) FILTER (WHERE flag NOT IN ('MATCHED', 'NOT_VERIFIED')) AS mismatched, count(*) FILTER (WHERE flag = 'NOT_VERIFIED') AS unverified,
  greatest(count(*) FILTER (WHERE flag <> 'ORPHAN_MASTER'), count(*) FILTER (WHERE flag <> 'ORPHAN_SOURCE'), 1) AS larger FROM f WHERE flag <> 'LOCAL')
SELECT matched, mismatched, unverified, round(mismatched / larger, 6) AS mismatch_ratio, CASE WHEN mismatched / larger > 0.1 THEN 'BLOCKED' WHEN unverified > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM c
""")
def report(spark, d):
    return S.discrepancy_report(_flags(spark, d))


@query("a11_reason_histogram", _FLAGS + "SELECT flag, count(*) AS n FROM f GROUP BY 1")
def histogram(spark, d):
    return _flags(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("r05_retire_plan", f"""
WITH s AS ({_SOURCE}), t AS (SELECT id, id % 4 <> 0 AS active, CASE WHEN id % 6 = 0 THEN 'LOCAL' ELSE 'SOURCE' END AS origin FROM ({_TARGET})),
c AS (SELECT count(*) FILTER (WHERE origin = 'SOURCE') AS managed, count(*) FILTER (WHERE s.id IS NOT NULL) AS present, count(*) FILTER (WHERE origin = 'SOURCE' AND s.id IS NULL AND active) AS candidates,
  count(*) FILTER (WHERE origin = 'SOURCE' AND s.id IS NULL AND NOT active) AS already_inactive FROM t LEFT JOIN s ON s.id = t.id)
SELECT *, present = 0 OR candidates / greatest(managed, 1) > 0.1 OR candidates > 100 AS blocked FROM c
""")
def retire(spark, d):
    source, target = _pair(spark, d)
    return S.retire_plan(target, source, "id", F.col("id") % 4 != 0, F.when(F.col("id") % 6 == 0, "LOCAL").otherwise("SOURCE"))


@query("a24_retry_streak", """
WITH e AS (SELECT user_id, event_type, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM events)
SELECT user_id, count(*) FILTER (WHERE good = 0) AS streak FROM e GROUP BY 1
""")
def streak(spark, d):
    return S.failure_streak(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type").isin("error", "click"))


@query("a23_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE value > 50) AS verified, count(*) FILTER (WHERE value IS NULL OR value < 5) AS stale, count(*) FILTER (WHERE event_type = 'error') AS mismatched FROM events")
def coverage(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("verified"), F.count_if(F.col("value").isNull() | (F.col("value") < 5)).alias("stale"), F.count_if(F.col("event_type") == "error").alias("mismatched"))


@query("r04_incremental_watermark", "SELECT strftime(max(ts) FILTER (WHERE event_type = 'purchase') - INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') AS since FROM events")
def watermark(spark, d):
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return table(spark, d, "events").agg(last.alias("t")).select(F.date_format(F.expr("t - INTERVAL 300 SECONDS"), "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("r08_two_phase_sweep", "SELECT l_orderkey AS id, 'missing_in_target' AS side FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 5 <> 0) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) UNION ALL SELECT o_orderkey, 'missing_in_source' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 <> 0)")
def sweep(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).filter("id % 5 <> 0").distinct()
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 4 <> 0")
    return s.join(t, "id", "left_anti").withColumn("side", F.lit("missing_in_target")).unionByName(t.join(s, "id", "left_anti").withColumn("side", F.lit("missing_in_source")))


@query("f31_slot_keys", "SELECT '3600:' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, min(event_id) AS job FROM events GROUP BY 1")
def slots(spark, d):
    return table(spark, d, "events").groupBy(S.slot_key("ts", 3600).alias("slot")).agg(F.min("event_id").alias("job"))


@query("f35_backoff", "SELECT n AS attempt, least(3600, 30 * pow(2, n - 1)) AS delay FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem)")
def delays(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("delay", S.backoff(F.col("attempt")))


@query("st04_queue_claim", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') ORDER BY ts, event_id LIMIT 64")
def queue(spark, d):
    return S.claim(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), 64, [F.col("ts"), F.col("event_id")], F.col("event_type").isin("click", "view")).select("event_id", "user_id")


@query("m16_event_compaction", "SELECT user_id, max(event_id) AS revision, max_by(event_type, event_id) AS kind FROM events GROUP BY 1")
def compaction(spark, d):
    return S.latest_revision(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("m06_processing_state", """
WITH l AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority LIKE '1%') AS ocr, max_by(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority LIKE '2%') AS content FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN ocr = 'P' THEN 'OCR_FAILED' WHEN ocr IS NULL OR ocr = 'O' THEN 'OCR_PENDING' WHEN content = 'F' THEN 'CONTENT_READY' WHEN content = 'P' THEN 'FINALIZATION_FAILED' ELSE 'FINALIZATION_PENDING' END AS state FROM l
""")
def state(spark, d):
    def latest(prefix):
        mine = F.col("o_orderpriority").startswith(prefix)
        return F.max_by(F.when(mine, F.col("o_orderstatus")), F.when(mine, F.col("o_orderkey")))

    stages = table(spark, d, "orders").groupBy("o_custkey").agg(latest("1").alias("ocr"), latest("2").alias("content"))
    out = F.when(F.col("ocr") == "P", "OCR_FAILED").when(F.col("ocr").isNull() | (F.col("ocr") == "O"), "OCR_PENDING").when(F.col("content") == "F", "CONTENT_READY").when(F.col("content") == "P", "FINALIZATION_FAILED").otherwise("FINALIZATION_PENDING")
    return stages.select("o_custkey", out.alias("state"))


@query("m11_index_reconcile", """
WITH a AS (SELECT p_partkey AS id, md5(p_name) AS f FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN 'old' ELSE md5(p_name) END AS f, p_brand AS input FROM part WHERE p_partkey % 7 <> 0)
SELECT count(*) FILTER (WHERE a.f = b.f) AS unchanged, count(*) FILTER (WHERE a.id IS NOT NULL AND a.f IS DISTINCT FROM b.f) AS would_write, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NULL) AS would_embed, count(*) FILTER (WHERE a.id IS NULL) AS stale FROM a FULL JOIN b ON a.id = b.id
""")
def index_reconcile(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("f"))
    a = p.filter("id % 9 <> 0").alias("a")
    b = p.filter("id % 7 <> 0").withColumn("f", F.when(F.col("id") % 8 == 0, "old").otherwise(F.col("f"))).alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    here = F.col("a.id").isNotNull()
    return j.agg(F.count_if(F.col("a.f") == F.col("b.f")).alias("unchanged"), F.count_if(here & ~F.col("a.f").eqNullSafe(F.col("b.f"))).alias("would_write"), F.count_if(here & F.col("b.id").isNull()).alias("would_embed"), F.count_if(~here).alias("stale"))


def intervals(spark, d):
    """SRC29 over each user's events, an event lasting as many seconds as its value says."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", start.alias("a"), (start + F.coalesce("value", F.lit(0.0))).alias("b"))
    return S.merge_intervals(e, "user_id", "a", "b", 600.0, 7200.0)


QUERIES["src29_merge_intervals"] = intervals
