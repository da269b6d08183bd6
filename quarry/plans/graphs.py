"""Queries of the tree, graph, concept and streaming families."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graphs as G
from quarry.operators import relational as R
from quarry.plans.retrieval import tok
from quarry.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p08_ancestor_acl", """
WITH RECURSIVE t AS (SELECT event_id AS n, CASE WHEN event_id > 0 THEN event_id // 3 END AS p, event_type <> 'error' AS ok FROM events),
w AS (SELECT n, ok FROM t WHERE p IS NULL UNION ALL SELECT t.n, t.ok AND w.ok FROM t JOIN w ON t.p = w.n) SELECT n AS event_id, ok AS allowed FROM w
""")
def acl(spark, d):
    e = table(spark, d, "events").withColumn("parent", F.expr("CASE WHEN event_id > 0 THEN event_id DIV 3 END"))
    return G.ancestors_all(e, "event_id", "parent", F.col("event_type") != "error").select("event_id", "allowed")


@query("g03_cycle_check", """
WITH RECURSIVE t AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 100 IN (7, 8) THEN p_partkey - p_partkey % 100 + CASE WHEN p_partkey % 100 = 7 THEN 8 ELSE 7 END ELSE p_partkey - 1 END AS p FROM part),
w AS (SELECT n FROM t WHERE p IS NULL OR p NOT IN (SELECT n FROM t) UNION ALL SELECT t.n FROM t JOIN w ON t.p = w.n) SELECT n AS p_partkey, n NOT IN (SELECT n FROM w) AS cyclic FROM t
""")
def cycles(spark, d):
    m = F.col("p_partkey") % 100
    parent = F.when(m == 0, F.lit(None)).when(m == 7, F.col("p_partkey") + 1).otherwise(F.col("p_partkey") - 1)
    parts = table(spark, d, "part").select("p_partkey", parent.alias("parent"))
    return G.ancestors_all(parts, "p_partkey", "parent", F.lit(True)).select("p_partkey", "cyclic")


_EDGES = "SELECT 'nation' AS kind, n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst FROM nation UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier"


def _edges(spark, d):
    out = None
    for kind, src, dst in (("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        rows = table(spark, d, kind).select(F.lit(kind).alias("kind"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("g01_graph_edges", _EDGES)
def edges(spark, d):
    return _edges(spark, d)


@query("a28_edge_counts", f"SELECT kind, count(*) AS edges, count(DISTINCT dst) AS targets FROM ({_EDGES}) GROUP BY 1")
def edge_counts(spark, d):
    return _edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("targets"))


@query("g02_orphan_edges", "SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) OR o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0)")
def orphans(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    known = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("dst"))
    left = orders.join(known, "dst", "left_anti").select("src", "dst")
    return left.union(orders.join(orders.filter("src % 6 <> 0").select("src"), "src", "left_anti").select("src", "dst")).distinct()


@query("g05_graph_diff", f"WITH a AS (SELECT src, dst FROM ({_EDGES}) WHERE src % 5 <> 0), b AS (SELECT src, dst FROM ({_EDGES}) WHERE src % 7 <> 0) SELECT *, 'add' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def diff(spark, d):
    e = _edges(spark, d).select("src", "dst")
    return R.symmetric_difference(e.filter("src % 5 <> 0"), e.filter("src % 7 <> 0"))


@query("g06_related_items", """
WITH b AS (SELECT DISTINCT l_suppkey AS i, 'part' AS kd, l_partkey AS v FROM lineitem UNION SELECT s_suppkey, 'nation', s_nationkey FROM supplier),
p AS (SELECT a.i, b.i AS j, count(DISTINCT kd) AS kinds FROM b a JOIN b USING (kd, v) WHERE a.i <> b.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY kinds DESC, j) AS place FROM p)
SELECT i AS supplier, j AS related, kinds, place FROM r WHERE place <= 3
""")
def related(spark, d):
    parts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.lit("part").alias("kind"), F.col("l_partkey").alias("value"))
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.lit("nation").alias("kind"), F.col("s_nationkey").cast("long").alias("value"))
    return G.related(parts.unionByName(nations), "supplier", "kind", "value", ["part", "nation"])


@query("j14_graph_pattern", "SELECT r_name, list_sort(list_distinct(list(n_name))) AS nations, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def pattern(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_sort(F.collect_set("n_name")).alias("nations"), F.count(F.lit(1)).alias("customers"))


@query("w12_outline_parents", """
WITH u AS (SELECT l_orderkey, l_linenumber::BIGINT AS at, 1 + l_partkey % 4 AS level FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))
SELECT a.l_orderkey, a.at, max(b.at) AS parent FROM u a LEFT JOIN u b ON b.l_orderkey = a.l_orderkey AND b.at < a.at AND b.level < a.level GROUP BY ALL
""")
def outline(spark, d):
    u = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("at")).agg(F.max("l_partkey").alias("p"))
    u = u.withColumn("level", 1 + F.col("p") % 4)
    return G.outline_parents(u, "l_orderkey", "at", "level").select("l_orderkey", "at", "parent")


#: A dictionary from the benchmark: each item's first word, first two and first three words name the item.
_ALIASES = f"(SELECT alias, min(item_id) AS concept FROM (SELECT item_id, unnest([array_to_string(t[1:n], ' ') FOR n IN [1, 2, 3] IF len(t) >= n]) AS alias FROM (SELECT item_id, {tok('text')} AS t FROM benchmark)) GROUP BY 1)"


def _aliases(spark, d):
    t = table(spark, d, "benchmark").select("item_id", X.surface_tokens(F.col("text")).alias("t"))
    made = t.select("item_id", F.explode(F.array(*(F.when(F.size("t") >= n, F.array_join(F.slice("t", 1, n), " ")) for n in (1, 2, 3)))).alias("alias"))
    return made.filter("alias IS NOT NULL").groupBy("alias").agg(F.min("item_id").alias("concept"))


@query("c01_alias_mentions", f"""
WITH a AS {_ALIASES}, p AS (SELECT ' (' || string_agg(regexp_replace(replace(alias, ' ', '  '), '([+.#])', '[\\1]', 'g'), '|' ORDER BY -len(string_split(alias, ' ')), alias) || ') ' AS pattern FROM a),
m AS (SELECT doc_id, replace(trim(unnest(regexp_extract_all(' ' || array_to_string({tok('text')}, '  ') || ' ', pattern))), '  ', ' ') AS alias FROM documents, p)
SELECT doc_id, concept, count(*) AS uses FROM m JOIN a USING (alias) GROUP BY ALL
""")
def mentions(spark, d):
    found = G.alias_mentions(table(spark, d, "documents"), "doc_id", X.surface_tokens(F.col("text")), _aliases(spark, d), 3)
    return found.groupBy("doc_id", "concept").agg(F.count(F.lit(1)).alias("uses"))


@query("c02_sense_choice", """
WITH c AS (SELECT l_orderkey AS mention, l_partkey % 5 AS concept, bool_or(l_returnflag = 'R') AS same_domain, count(*) FILTER (WHERE l_quantity > 40) AS hints, bool_and(l_linestatus = 'O') AS abbreviation FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN same_domain THEN 3 ELSE 0 END + 2 * hints AS score FROM c), r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt, count(*) OVER (PARTITION BY mention) AS n FROM s WINDOW w AS (PARTITION BY mention ORDER BY score DESC, concept))
SELECT mention, concept, score FROM r WHERE place = 1 AND (n = 1 AND NOT abbreviation OR score >= 2 AND (n = 1 OR score - nxt >= 1))
""")
def senses(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("mention"), (F.col("l_partkey") % 5).alias("concept")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("same_domain"), F.count_if(F.col("l_quantity") > 40).alias("hints"), F.bool_and(F.col("l_linestatus") == "O").alias("abbreviation"))
    return G.choose_sense(c, "mention")


@query("c04_strongest_path", """
SELECT concept, term, language, weight, original, path FROM (SELECT p_size AS concept, p_brand AS term, p_type AS language, round(p_retailprice, 2) AS weight, p_partkey % 2 = 0 AS original, p_partkey AS path,
  row_number() OVER (PARTITION BY p_size, p_brand, p_type ORDER BY round(p_retailprice, 2) DESC, p_partkey % 2 = 0 DESC, p_partkey) AS r FROM part) WHERE r = 1
""")
def strongest(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("concept"), F.col("p_brand").alias("term"), F.col("p_type").alias("language"), F.round("p_retailprice", 2).alias("weight"), (F.col("p_partkey") % 2 == 0).alias("original"), F.col("p_partkey").alias("path"))
    return G.strongest_paths(p)


@query("st01_incremental_sync", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY 1")
def incremental(spark, d):
    from quarry.streaming import sync as S

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/sync-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").select("event_id", "ts", "user_id").schema
    changes = S.replay_safe(S.read_changes(spark, f"{d}/[e]vents.parquet", schema, "ts"), "event_id", "ts")
    return S.sync(changes, f"{folder}/versions", f"{folder}/checkpoint", "user_id", "ts", "event_id").select("user_id", "event_id")
