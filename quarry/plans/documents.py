"""Queries of the document, metadata and composite families over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import relational as R
from quarry.operators import sync as SY
from quarry.operators.graphs import cut
from quarry.plans.retrieval import _FOLD, _KNN, _STOP, _branches, _docs, _metrics, _METRICS, _neighbours, tok
from quarry.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line"))
    return docs.withColumn("seq", F.col("seq").cast("long"))


_LINES = "(SELECT doc_id, i - 1 AS seq, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"


@query("src25_unit_offsets", f"SELECT doc_id, seq, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {_LINES} WHERE trim(line) <> ''")
def unit_offsets(spark, d):
    before = F.sum(F.char_length("line") + 2).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return _lines(spark, d).filter("trim(line) <> ''").select("doc_id", "seq", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


@query("snk07_generation_guard", """
WITH s AS (SELECT p_partkey AS id, p_partkey % 5 AS generation, p_name AS text, 'kw' || p_size AS kw FROM part), n AS (SELECT p_partkey AS id, p_partkey % 4 AS generation, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS text, NULL AS kw FROM part)
SELECT n.id, CASE WHEN s.generation <= n.generation THEN n.text ELSE s.text END AS text, CASE WHEN s.generation > n.generation OR s.text = n.text THEN s.kw END AS kw FROM n JOIN s USING (id)
""")
def generation_guard(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    s = p.select("id", (F.col("id") % 5).alias("sg"), F.col("p_name").alias("st"), F.concat(F.lit("kw"), F.col("p_size").cast("string")).alias("skw"))
    n = p.select("id", (F.col("id") % 4).alias("ng"), F.when(F.col("id") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("nt"))
    older = F.col("sg") > F.col("ng")
    return n.join(s, "id").select("id", F.when(older, F.col("st")).otherwise(F.col("nt")).alias("text"), F.when(older | (F.col("st") == F.col("nt")), F.col("skw")).alias("kw"))


@query("snk10_compare_and_set", "SELECT c_custkey, CASE WHEN c_custkey % 4 = c_nationkey % 4 THEN upper(c_mktsegment) ELSE c_mktsegment END AS segment, c_custkey % 4 = c_nationkey % 4 AS applied FROM customer")
def compare_and_set(spark, d):
    ok = F.col("c_custkey") % 4 == F.col("c_nationkey") % 4
    return table(spark, d, "customer").select("c_custkey", F.when(ok, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"), ok.alias("applied"))


@query("snk11_deletion_state", "SELECT user_id, CASE WHEN max_by(event_type, event_id) = 'error' THEN 'DELETED' ELSE 'LIVE' END AS state, max(event_id) AS revision FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def deletion_state(spark, d):
    e = table(spark, d, "events").filter("event_type IN ('error', 'signup')").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.max("event_id").alias("revision"))
    return e.select("user_id", F.when(F.col("last") == "error", "DELETED").otherwise("LIVE").alias("state"), "revision")


@query("snk12_retire_rows", "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS active FROM supplier")
def retire_rows(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("u", F.lit(True))
    return table(spark, d, "supplier").join(used, "s_suppkey", "left").select("s_suppkey", F.coalesce("u", F.lit(False)).alias("active"))


@query("snk16_bucket_digests", """
WITH p AS (SELECT ('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8))::UBIGINT % 16 AS bucket, p_partkey AS k FROM part), r AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY k) - 1) // 4096 AS part FROM p),
c AS (SELECT bucket, part, count(*) AS n, md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)) AS digest FROM r GROUP BY ALL)
SELECT bucket, sum(n)::BIGINT AS n, CASE WHEN count(*) = 1 THEN any_value(digest) ELSE md5(string_agg(digest, ',' ORDER BY part)) END AS digest FROM c GROUP BY 1
""")
def bucket_digests(spark, d):
    bucket = F.conv(F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 8), 16, 10).cast("long") % 16
    rows = table(spark, d, "part").select(bucket.alias("bucket"), "p_partkey", F.col("p_partkey").cast("string").alias("id"))
    return SY.ordered_digest(rows, ["p_partkey"], "id", lambda listed: F.md5(F.array_join(listed, ",")), "bucket")


@query("j02_aggregate_build", """
SELECT o_orderkey, c_name, n_name, count(l_linenumber) AS relations, strftime(greatest(o_orderdate, max(l_shipdate)), '%Y-%m-%d') AS cursor FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0
LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name, n_name, o_orderdate
""")
def aggregate_build(spark, d):
    rel = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("relations"), F.max("l_shipdate").alias("m"))
    nation = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(nation, "c_nationkey", "left").join(rel, "o_orderkey", "left")
    return rows.select("o_orderkey", "c_name", "n_name", F.coalesce("relations", F.lit(0)).alias("relations"), F.date_format(F.greatest("o_orderdate", "m"), "yyyy-MM-dd").alias("cursor"))


@query("j11_merge_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def merge_missing(spark, d):
    have = table(spark, d, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey").join(have, "o_orderkey", "left_anti")


@query("j13_alias_lookup", "SELECT DISTINCT p_type AS alias, p_partkey AS record FROM part WHERE p_type IN (SELECT p_type FROM part)")
def alias_lookup(spark, d):
    p = table(spark, d, "part")
    asked = p.select("p_type").distinct()
    return p.join(asked, "p_type", "left_semi").select(F.col("p_type").alias("alias"), F.col("p_partkey").alias("record")).distinct()


@query("j16_term_probe", f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) WHERE term IN ('worthless', 'clown', 'license')")
def term_probe(spark, d):
    return _docs(spark, d).select("doc_id", F.explode("tokens").alias("term")).filter("term IN ('worthless', 'clown', 'license')").select("doc_id").distinct()


@query("j17_passage_overlap", f"""
WITH p AS (SELECT doc_id, seq, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(line) AS n FROM {_LINES}), o AS (SELECT doc_id, seq, least(a + n, 900) - greatest(a, 400) AS overlap FROM p WHERE a < 900 AND a + n > 400)
SELECT doc_id, seq, overlap::BIGINT AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, seq) AS r FROM o) WHERE r = 1
""")
def passage_overlap(spark, d):
    before = F.sum(F.char_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    p = _lines(spark, d).select("doc_id", "seq", F.coalesce(before, F.lit(0)).alias("a"), F.char_length("line").alias("n")).filter("a < 900 AND a + n > 400")
    o = p.withColumn("overlap", (F.least(F.col("a") + F.col("n"), F.lit(900)) - F.greatest("a", F.lit(400))).cast("long"))
    return R.latest_by(o, ["doc_id"], [F.desc("overlap"), F.col("seq")]).select("doc_id", "seq", "overlap")


@query("p15_contextual_input", "SELECT p_partkey, 'Title: ' || left(p_name, 240) || chr(10) || 'Subject: ' || left(p_brand, 240) || chr(10) || left(p_type, 720) AS input FROM part")
def contextual_input(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("Title: "), F.substring("p_name", 1, 240), F.lit("\nSubject: "), F.substring("p_brand", 1, 240), F.lit("\n"), F.substring("p_type", 1, 720)).alias("input"))


@query("a07_rolling_digest", "SELECT o_custkey, list_reduce(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), lambda a, b: sha256(a || ':' || b), '') AS digest FROM orders GROUP BY 1")
def rolling_digest(spark, d):
    listed = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    fold = F.aggregate("ids", F.lit(""), lambda a, x: F.sha2(F.concat(a, F.lit(":"), x.cast("string")), 256))
    return listed.select("o_custkey", fold.alias("digest"))


@query("a09_row_digest", "SELECT c_custkey, sha256(concat_ws('|', c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)) AS state_hash FROM customer")
def row_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("state_hash"))


@query("a20_answer_summary", _METRICS + "SELECT count(*) FILTER (WHERE recall IS NOT NULL) AS positive, count(*) FILTER (WHERE recall IS NULL) AS no_answer, round(avg(CASE WHEN mrr > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_rate FROM m")
def answer_summary(spark, d):
    return _metrics(spark, d).agg(F.count("recall").alias("positive"), F.count_if(F.col("recall").isNull()).alias("no_answer"), F.round(F.avg(F.when(F.col("mrr") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("a26_status_matrix", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def status_matrix(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("a30_best_chunk", "SELECT l_orderkey, max(l_extendedprice) AS best, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS chunk FROM lineitem GROUP BY 1")
def best_chunk(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct(F.col("l_extendedprice").alias("s"), (-F.col("l_linenumber")).alias("k"))).alias("b"))
    return best.select("l_orderkey", F.col("b.s").alias("best"), (-F.col("b.k")).alias("chunk"))


@query("a31_alias_merge", "SELECT p_brand, lower(p_type) AS alias, min(p_name) AS canonical FROM part GROUP BY ALL")
def alias_merge(spark, d):
    return table(spark, d, "part").groupBy("p_brand", F.lower("p_type").alias("alias")).agg(F.min("p_name").alias("canonical"))


@query("w02_latest_stage", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_stage(spark, d):
    return R.latest_by(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("w07_diverse_top", _KNN + ", g AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, doc) AS k FROM r WHERE rank <= 20), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM g WHERE k = 1) SELECT query, label, doc, place FROM t WHERE place <= 3")
def diverse_top(spark, d):
    near = _neighbours(spark, d).drop("rank").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc")
    best = R.latest_by(near, ["query", "label"], [F.desc("score"), F.col("doc")]).drop("place")
    return R.latest_by(best, ["query"], [F.desc("score"), F.col("doc")], 3).select("query", "label", "doc", "place")


@query("w08_first_with_count", "SELECT l_suppkey, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r = 1")
def first_with_count(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return R.with_history(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], "n").select("l_suppkey", "l_orderkey", "l_linenumber", "n")


@query("l03_overflow_probe", "SELECT count(*) > 100 AS overflow FROM (SELECT 1 FROM part WHERE p_size > 10 LIMIT 101)")
def overflow(spark, d):
    return table(spark, d, "part").filter("p_size > 10").limit(101).agg((F.count(F.lit(1)) > 100).alias("overflow"))


@query("l06_folded_order", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_FOLD.format('c_mktsegment')}, c_custkey) AS place FROM customer")
def folded_order(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(X.casefold(F.col("c_mktsegment")), "c_custkey")).alias("place"))


@query("l08_session_page", _KNN + "SELECT query, doc, rank FROM r WHERE rank BETWEEN 6 AND 10")
def session_page(spark, d):
    return _neighbours(spark, d, 10).filter("rank BETWEEN 6 AND 10").select("query", "doc", "rank")


@query("l10_seeded_shuffle", "SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS place FROM benchmark")
def shuffle(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string"))).alias("h"), F.lit(1).alias("place"))
    return R.prefix_sums(rows, ["h", "item_id"], ["place"]).select("item_id", F.col("place_sum").alias("place"))


@query("s04_key_union", "SELECT id, max(score) AS best, round(sum(score), 6) AS total FROM (SELECT c_nationkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
def key_union(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_acctbal").alias("score")).union(table(spark, d, "supplier").select("s_nationkey", "s_acctbal"))
    return rows.groupBy("id").agg(F.max("score").alias("best"), F.round(F.sum("score"), 6).alias("total"))


@query("s05_ancestor_closure", """
WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS p FROM (SELECT DISTINCT conv_id, turn FROM conversations)), c AS (SELECT conv_id, turn, p FROM t WHERE p IS NOT NULL UNION SELECT c.conv_id, c.turn, t.p FROM c JOIN t ON t.conv_id = c.conv_id AND t.turn = c.p WHERE t.p IS NOT NULL)
SELECT conv_id, turn, p AS ancestor FROM c
""")
def closure(spark, d):
    """Steps twice as far each round: all ancestors up to 2**k steps away are known after k rounds, whatever the depth."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    here = t.select("conv_id", F.col("turn").alias("ancestor"))
    known = cut(t.filter("turn > 0").select("conv_id", "turn", F.expr("(turn - 1) DIV 2").alias("ancestor")))
    held, before = known, -1
    while (now := known.count()) != before:
        before = now
        on = known.join(held.select("conv_id", F.col("turn").alias("ancestor"), F.col("ancestor").alias("further")), ["conv_id", "ancestor"]).select("conv_id", "turn", F.col("further").alias("ancestor"))
        known = held = cut(known.unionByName(on).distinct())
    return known


@query("s06_presence", "SELECT o_orderpriority, bool_and(o_custkey IN (SELECT c_custkey FROM customer)) AS all_present FROM orders GROUP BY 1")
def presence(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("k"))
    return table(spark, d, "orders").join(known, "o_custkey", "left").groupBy("o_orderpriority").agg(F.bool_and(F.coalesce("k", F.lit(False))).alias("all_present"))


@query("f14_language_hints", f"""
WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN list_has_any(t, ['the', 'of', 'and', 'with']) THEN 'en' END, CASE WHEN list_has_any(t, ['le', 'la', 'les', 'des', 'une']) THEN 'fr' END, CASE WHEN list_has_any(t, ['der', 'die', 'und']) THEN 'de' END) AS hints FROM t
""")
def language_hints(spark, d):
    def hint(code, words):
        return F.when(F.arrays_overlap("tokens", F.array(*(F.lit(w) for w in words))), F.lit(code))

    return _docs(spark, d).select("doc_id", F.concat_ws(",", hint("en", ["the", "of", "and", "with"]), hint("fr", ["le", "la", "les", "des", "une"]), hint("de", ["der", "die", "und"])).alias("hints"))


@query("f15_technical_identifiers", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(url, '[a-z]+\.example\.[a-z]+|[0-9]+'))) AS ids FROM pages")
def identifiers(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("url", F.lit(r"([a-z]+\.example\.[a-z]+|[0-9]+)"), F.lit(1)))).alias("ids"))


@query("f19_safe_phrase", f"""
SELECT item_id, length(p) BETWEEN 2 AND 120 AND len(t) BETWEEN 1 AND 6 AND regexp_matches(p, '\\p{{L}}') AND NOT regexp_matches(p, 'https?://|www\\.|\\S+@\\S+|[<>]') AND length(regexp_replace(p, '\\P{{Nd}}', '', 'g')) <= greatest(2, length(p) // 4) AND len(list_filter(t, lambda w: NOT list_contains({_STOP}, w))) > 0 AND len(list_distinct(t)) >= greatest(1, len(t) // 2) AS safe
FROM (SELECT item_id, p, {tok('p')} AS t FROM (SELECT item_id, trim(left(text, 10 + 5 * (item_id % 8))) AS p FROM benchmark))
""")
def safe_phrase(spark, d):
    p = table(spark, d, "benchmark").select("item_id", F.expr("substring(text, 1, cast(10 + 5 * (item_id % 8) AS int))").alias("p"))
    return p.select("item_id", X.safe_phrase(F.col("p")).isNotNull().alias("safe"))


@query("f21_snippet", f"""
WITH d AS (SELECT doc_id, text, {_FOLD.format('text')} AS low, {tok('text')} AS t FROM documents), w AS (SELECT doc_id, text, low, nullif(instr(low, array_to_string(t[5:6], ' ')), 0) AS exact, len(t) >= 6 AS long,
  list_sort(list_filter(list_transform(t[3:6], lambda x: {{'n': (length(low) - length(replace(low, x, ''))) / length(x), 'at': instr(low, x)}}), lambda s: s['at'] > 0)) AS w FROM d)
SELECT doc_id, substr(text, greatest(coalesce(CASE WHEN long THEN exact END, w[1]['at'], 1) - 40, 1)::BIGINT, 160) AS snippet FROM w
""")
def snippets(spark, d):
    t = F.col("tokens")
    phrase = F.when(F.size(t) >= 6, F.array_join(F.slice(t, 5, 2), " "))
    return _docs(spark, d).select("doc_id", X.snippet(F.col("text"), F.slice(t, 3, 4), 160, phrase).alias("snippet"))


@query("f22_subtitle_times", "SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp FROM (SELECT event_id, event_id * 1234567 % 86400000 AS ms FROM events)")
def subtitle_times(spark, d):
    from quarry.sources.sinks import timestamp

    return table(spark, d, "events").select("event_id", timestamp(F.col("event_id") * 1234567 % 86400000, ",").alias("stamp"))


@query("f25_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squared, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS head FROM embeddings")
def unit_vectors(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(X.dot(e, e), 6).alias("squared"), F.round(F.get(X.unit(e), F.lit(0)), 6).alias("head"))


@query("f28_period_keys", "SELECT o_orderkey, strftime(o_orderdate, '%m%y') AS period FROM orders")
def period_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMyy").alias("period"))


@query("f29_identity_hash", "SELECT c_custkey, sha256(unhex(printf('%08X', octet_length(encode(c_name)))) || encode(c_name) || unhex(printf('%08X', octet_length(encode(c_mktsegment)))) || encode(c_mktsegment)) AS identity FROM customer")
def identity_hash(spark, d):
    def part(c):
        raw = F.encode(F.col(c), "UTF-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)

    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(part("c_name"), part("c_mktsegment")), 256).alias("identity"))


@query("f36_json_records", "SELECT event_id, CAST(json_extract(j, '$.type') AS VARCHAR) = '\"' || event_type || '\"' AS same FROM (SELECT event_id, event_type, json_object('type', event_type) AS j FROM events)")
def json_records(spark, d):
    j = F.to_json(F.struct(F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", (F.get_json_object(j, "$.type") == F.col("event_type")).alias("same"))


@query("d05_variant_max", _KNN + "SELECT doc, max(score) AS best FROM r WHERE rank <= 20 GROUP BY 1")
def variant_max(spark, d):
    return _neighbours(spark, d).groupBy("doc").agg(F.max("score").alias("best"))


@query("d08_weak_fallback", _KNN + "SELECT query, doc, CASE WHEN score >= 0.6 THEN 'STRONG' WHEN score >= 0.4 AND label = query_label THEN 'ANCHORED' ELSE 'REJECTED' END AS admission FROM r WHERE rank <= 20")
def weak_fallback(spark, d):
    e = table(spark, d, "embeddings")
    near = _neighbours(spark, d).join(e.select(F.col("vec_id").alias("doc"), "label"), "doc").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    admission = F.when(F.col("score") >= 0.6, "STRONG").when((F.col("score") >= 0.4) & (F.col("label") == F.col("ql")), "ANCHORED").otherwise("REJECTED")
    return near.select("query", "doc", admission.alias("admission"))


@query("d17_branch_origin", _KNN + """, b AS (SELECT query, doc, 'content' AS branch FROM r WHERE rank <= 12 UNION ALL SELECT query, doc, 'metadata' FROM r WHERE rank <= 20 AND label = query_label)
SELECT query, doc, CASE WHEN count(DISTINCT branch) = 2 THEN 'BOTH' ELSE upper(min(branch)) END AS origin FROM b GROUP BY ALL""")
def branch_origin(spark, d):
    b = _branches(spark, d).filter("branch = 'label' OR rank <= 12").withColumn("branch", F.when(F.col("branch") == "dense", "content").otherwise("metadata"))
    return b.groupBy("query", "doc").agg(F.when(F.count_distinct("branch") == 2, "BOTH").otherwise(F.upper(F.min("branch"))).alias("origin"))


@query("t02_tree_validation", "WITH t AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 - turn % 2 END AS p FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 2)) SELECT a.conv_id, a.turn FROM t a WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn = a.p)")
def tree_validation(spark, d):
    t = table(spark, d, "conversations").filter("turn <> 2").select("conv_id", "turn").distinct().withColumn("p", F.when(F.col("turn") > 0, F.col("turn") - 1 - F.col("turn") % 2))
    parents = t.select("conv_id", F.col("turn").alias("p"))
    return t.filter("p IS NOT NULL").join(parents, ["conv_id", "p"], "left_anti").select("conv_id", "turn")


@query("t04_representation_mode", "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'structured' WHEN bool_and(l_returnflag <> 'N') THEN 'fallback' ELSE 'mixed' END AS mode FROM lineitem GROUP BY 1")
def representation(spark, d):
    s = F.col("l_returnflag") == "N"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.bool_and(s), "structured").when(F.bool_and(~s), "fallback").otherwise("mixed").alias("mode"))


@query("t06_chunk_preview", f"""
WITH w AS (SELECT doc_id, seq, regexp_extract_all(line, '\\S+') AS w FROM {_LINES}), c AS (SELECT doc_id, seq, array_to_string(w, ' ') AS body FROM w WHERE len(w) > 0)
SELECT doc_id, seq, left(sha256(doc_id || ':' || seq || ':' || md5(body)), 30) AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS ordinal FROM c
""")
def chunk_preview(spark, d):
    words = F.regexp_extract_all("line", F.lit(r"(\S+)"), F.lit(1))
    c = _lines(spark, d).select("doc_id", "seq", words.alias("w")).filter("size(w) > 0").select("doc_id", "seq", F.array_join("w", " ").alias("body"))
    made = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string"), F.md5("body")), 256)
    return c.select("doc_id", "seq", F.substring(made, 1, 30).alias("chunk_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("ordinal"))


@query("t07_neighbour_context", f"SELECT a.doc_id, a.seq, string_agg(b.line, chr(10) ORDER BY b.seq) AS context FROM {_LINES} a JOIN {_LINES} b ON a.doc_id = b.doc_id AND abs(a.seq - b.seq) <= 1 GROUP BY ALL")
def neighbour_context(spark, d):
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(-1, 1)
    return _lines(spark, d).withColumn("context", F.array_join(F.collect_list("line").over(w), "\n")).select("doc_id", "seq", "context")


@query("c07_review_gating", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS approved, count(*) FILTER (WHERE l_linestatus <> 'F') AS open FROM lineitem GROUP BY 1")
def gating(spark, d):
    done = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(done).alias("approved"), F.count_if(~done).alias("open"))


@query("c08_ledger_fold", """
WITH l AS (SELECT user_id, event_id, event_type, md5(event_id || ':' || event_type) AS h, CASE WHEN event_id % 501 = 500 THEN 'broken' ELSE lag(md5(event_id || ':' || event_type)) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev FROM events),
c AS (SELECT *, prev IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM l) SELECT user_id, bool_and(ok) AS intact, max_by(event_type, event_id) AS decision FROM c GROUP BY 1
""")
def ledger(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    h = F.md5(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", h.alias("h")).withColumn("last", F.lag("h").over(w))
    rows = rows.withColumn("prev", F.when(F.col("event_id") % 501 == 500, "broken").otherwise(F.col("last")))
    return rows.groupBy("user_id").agg(F.bool_and(F.col("prev").eqNullSafe(F.col("last"))).alias("intact"), F.max_by("event_type", "event_id").alias("decision"))


@query("g07_membership_parity", "SELECT count(*) AS orders, count(n) AS with_lines, count(*) FILTER (WHERE n IS NULL) AS missing FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey")
def membership(spark, d):
    n = table(spark, d, "lineitem").filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("orders"), F.count("n").alias("with_lines"), F.count_if(F.col("n").isNull()).alias("missing"))


@query("r03_file_integrity", "SELECT page_id, CASE WHEN html IS NULL THEN 'NOT_VERIFIED' WHEN length(html) % 7 = 0 THEN 'DESYNC_BLOB_SIZE' WHEN sha256(html) <> CASE WHEN page_id % 9 = 0 THEN 'x' ELSE sha256(html) END THEN 'DESYNC_CHECKSUM' ELSE 'SYNCED' END AS flag FROM pages")
def integrity(spark, d):
    stored = F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.sha2("html", 256))
    flag = F.when(F.col("html").isNull(), "NOT_VERIFIED").when(F.char_length("html") % 7 == 0, "DESYNC_BLOB_SIZE").when(F.sha2("html", 256) != stored, "DESYNC_CHECKSUM").otherwise("SYNCED")
    return table(spark, d, "pages").select("page_id", flag.alias("flag"))


@query("r07_relation_audit", "WITH a AS (SELECT l_orderkey, list_sort(list((l_partkey, l_suppkey))) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list((l_partkey, l_suppkey))) AS s FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1) SELECT l_orderkey, a.s IS NOT DISTINCT FROM b.s AS equal FROM a FULL JOIN b USING (l_orderkey)")
def relation_audit(spark, d):
    rows = table(spark, d, "lineitem")
    sides = [rows.filter(f"l_linenumber <= {n}").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))).alias(c)) for n, c in ((4, "a"), (5, "b"))]
    return sides[0].join(sides[1], "l_orderkey", "full_outer").select("l_orderkey", F.col("a").eqNullSafe(F.col("b")).alias("equal"))


@query("r11_parent_versions", "SELECT a.o_orderkey, max(b.o_orderkey) AS parent FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY 1")
def parent_versions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))


@query("m01_metadata_hydration", "SELECT o_orderkey, c_name, list_sort(list_distinct(list(p_brand))) AS brands, count(*) AS lines FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def hydration(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("p_brand")).alias("brands"), F.count(F.lit(1)).alias("lines"))
    return table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(grouped, "o_orderkey").select("o_orderkey", "c_name", "brands", "lines")


@query("m05_failed_imports", "SELECT o_custkey FROM orders GROUP BY 1 HAVING max_by(o_orderstatus, o_orderkey) = 'P' AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0")
def failed_imports(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.filter("last = 'P' AND f > 0").select("o_custkey")


@query("m09_import_listing", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS total FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey > 50 ORDER BY o_orderkey LIMIT 30")
def import_listing(spark, d):
    open_ = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")
    total = open_.agg(F.count(F.lit(1)).alias("total"))  # one row
    return R.page(open_.filter("o_orderkey > 50"), [F.col("o_orderkey")], 30).crossJoin(F.broadcast(total))


@query("m12_prune_superseded", "SELECT event_id FROM events WHERE (user_id, event_id) NOT IN (SELECT user_id, max(event_id) FROM events GROUP BY 1)")
def prune(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return e.join(newest, ["user_id", "event_id"], "left_anti").select("event_id")


@query("m20_job_enqueue", "SELECT user_id || ':' || strftime(ts, '%Y%m%d%H') AS job_key, min(event_id) AS event_id FROM events GROUP BY 1")
def enqueue(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH"))
    return table(spark, d, "events").groupBy(key.alias("job_key")).agg(F.min("event_id").alias("event_id"))


@query("m21_rotated_audit", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey <= 37, s_suppkey) AS turn FROM supplier ORDER BY turn LIMIT 50")
def rotated_audit(spark, d):
    s = R.page(table(spark, d, "supplier").select("s_suppkey"), [F.col("s_suppkey") <= 37, F.col("s_suppkey")], 50)
    return s.withColumn("turn", F.row_number().over(Window.orderBy(F.col("s_suppkey") <= 37, "s_suppkey")))  # fifty rows


@query("m22_inventory_classes", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'INVALID_OR_REVOKED' WHEN p_partkey % 11 = 0 THEN 'WAITING_FOR_SOURCE_MAPPING' WHEN p_retailprice < 1000 THEN 'UNVERIFIED' WHEN p_size > 40 THEN 'RETRY_EXHAUSTED' WHEN p_size > 20 THEN 'PARTIAL' ELSE 'COMPLETE_VERIFIED' END AS class FROM part")
def inventory(spark, d):
    c = F.when(F.col("p_size") == 1, "INVALID_OR_REVOKED").when(F.col("p_partkey") % 11 == 0, "WAITING_FOR_SOURCE_MAPPING").when(F.col("p_retailprice") < 1000, "UNVERIFIED").when(F.col("p_size") > 40, "RETRY_EXHAUSTED").when(F.col("p_size") > 20, "PARTIAL").otherwise("COMPLETE_VERIFIED")
    return table(spark, d, "part").select("p_partkey", c.alias("class"))


@query("m30_dataset_check", "SELECT count(*) AS judged, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing, count(*) FILTER (WHERE quality IS NULL) AS ungraded FROM labels")
def dataset_check(spark, d):
    known = table(spark, d, "documents").select("doc_id", F.lit(True).alias("k")).distinct()
    return table(spark, d, "labels").join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("quality").isNull()).alias("ungraded"))


@query("m34_identity_mapping", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'STALE' WHEN n > 1 THEN 'CONFLICT' ELSE 'ACTIVE' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def identity_mapping(spark, d):
    n = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderstatus").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "STALE").when(F.col("n") > 1, "CONFLICT").otherwise("ACTIVE").alias("state"))
