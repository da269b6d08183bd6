"""Queries of scans, predicates, digests, text spans, checks of artifacts and record composites."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import evaluation as E
from quarry.operators import lexical as L
from quarry.operators import relational as R
from quarry.operators import retrieval as V
from quarry.operators import spans as P
from quarry.operators import sync as S
from quarry.operators.graphs import small
from quarry.plans.graphs import _EDGES, _aliases, _edges
from quarry.plans.retrieval import _FOLD, _KSTOP, _PLAIN, _STOP, _docs, _items, _lines, tok
from quarry.plans.search import _FOUND
from quarry.plans.sync import _SOURCE, _TARGET, _pair
from quarry.session import table
from quarry.sources import files, sinks

QUERIES, ORACLES = {}, {}
_AUX = "[" + ", ".join(f"'{w}'" for w in X.AUXILIARY_TERMS) + "]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _folder(spark, what):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# Scans ----------------------------------------------------------------------------------------------


@query("src01_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array(spark, d):
    n, folder = table(spark, d, "nation"), _folder(spark, "json")
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(folder)  # a dimension of 25 rows is one array
    return files.json_records(spark, folder, n.schema)


@query("src06_effective_dimension", "SELECT c_custkey, strftime(greatest(max(o_orderdate), max(l_shipdate)), '%Y-%m-%d') AS effective FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def effective(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("m"))
    rows = table(spark, d, "orders").join(shipped, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.greatest(F.max("o_orderdate"), F.max("m")).alias("t"))
    return rows.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", F.date_format("t", "yyyy-MM-dd").alias("effective"))


@query("src08_smallest_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS batch FROM orders")
def smallest_batches(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lit(1).alias("one"))
    return R.prefix_sums(rows, ["o_orderdate", "o_orderkey"], ["one"]).select("o_orderkey", F.expr("(one_sum - 1) DIV 1000").alias("batch"))


@query("src10_exact_ids", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)")
def exact_ids(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("src11_catalogue_probe", "SELECT count(*) AS probed, count(*) > 20000 AS overflow FROM (SELECT 1 FROM orders LIMIT 20001)")
def catalogue_probe(spark, d):
    return table(spark, d, "orders").select("o_orderkey").limit(20_001).agg(F.count(F.lit(1)).alias("probed"), (F.count(F.lit(1)) > 20_000).alias("overflow"))


@query("src13_point_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def point_get(spark, d):
    return table(spark, d, "part").filter("p_partkey = 17").select("p_partkey", "p_name")


@query("src16_pages_by_host", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) AS place FROM pages")
def pages_by_host(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host")).withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))


@query("src18_composite_keyset", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1000")
def composite_keyset(spark, d):
    after = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")) > F.struct(F.lit(100).cast("long").alias("a"), F.lit(3).alias("b"))
    return table(spark, d, "lineitem").filter(after).select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1000)


@query("src22_text_units", "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS unit, l[i] AS line FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark), unnest(range(1, len(l) + 1)) AS u(i) WHERE trim(l[i]) <> ''")
def text_units(spark, d):
    folder = _folder(spark, "texts")
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(folder)
    units = files.text_units(spark, folder).withColumn("item_id", F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long"))
    return units.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("seq")).alias("unit"), F.col("text").alias("line"))


@query("src22_split_lines", "SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) - 1 AS seq, md5(line) AS digest FROM (SELECT doc_id // 100 AS chunk, doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)) QUALIFY trim(line) <> ''")
def split_lines(spark, d):
    """All documents, a hundred a file, read back by lines with their numbers in the file."""
    folder = _folder(spark, "lines")
    docs = table(spark, d, "documents").select(F.expr("doc_id DIV 100").alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartitionByRange("chunk").sortWithinPartitions("chunk", "doc_id").select("chunk", "value").write.partitionBy("chunk").text(folder)
    lines = files.numbered_lines(spark, folder).filter("trim(text) <> ''")
    return lines.select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("long").alias("chunk"), "seq", F.md5("text").alias("digest"))


@query("src23_csv_units", "SELECT 'C1: ' || s_suppkey || ' | C2: ' || s_name || ' | C3: ' || s_nationkey AS unit FROM supplier")
def csv_units(spark, d):
    folder = _folder(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("sep", ";").csv(folder)
    return files.csv_units(spark, folder).select(F.col("text").alias("unit"))


@query("src28_subtitle_cues", r"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS cue, turn * 1000 AS start_ms, (turn + 1) * 1000 AS end_ms, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS line FROM conversations WHERE turn IS NOT NULL")
def subtitle_cues(spark, d):
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    c = table(spark, d, "conversations").filter("turn IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("t")).alias("at"), (F.col("turn") * 1000).alias("a"), ((F.col("turn") + 1) * 1000).alias("b"), line.alias("line"))
    cues = files.parse_srt(sinks.subtitles(c, "conv_id", "at", "a", "b", "line"), "conv_id", "document")
    return cues.select("conv_id", F.col("cue").cast("long").alias("cue"), "start_ms", "end_ms", F.col("text").alias("line"))


@query("src31_ontology_edges", """
SELECT l_orderkey AS src, l_partkey AS dst, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_suppkey % 2 = l_partkey % 2 THEN 'equivalent' ELSE 'translation' END WHEN 1 THEN 'broader' ELSE 'related' END AS relation FROM lineitem WHERE l_linenumber % 4 < 3 AND l_suppkey % 7 <> 0
""")
def ontology_edges(spark, d):
    tongue = lambda c: F.when(F.col(c) % 2 == 0, "vi").otherwise("en")
    rel = F.element_at(F.array(*(F.lit(x) for x in ("Synonym", "IsA", "RelatedTo", "Antonym"))), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("start"), F.when(F.col("l_suppkey") % 7 == 0, "fr").otherwise(tongue("l_suppkey")).alias("start_language"), F.col("l_partkey").alias("end"), tongue("l_partkey").alias("end_language"), rel.alias("rel"))
    return files.conceptnet_edges(rows)


@query("src32_format_check", """
SELECT 'f' || page_id || '.' || CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'docx' WHEN 3 THEN 'exe' ELSE 'txt' END AS path, CASE WHEN page_id % 5 = 3 AND octet_length(encode(html)) > 0 THEN 'UNKNOWN_TYPE' WHEN octet_length(encode(coalesce(html, ''))) = 0 AND page_id % 5 NOT IN (0, 4) THEN 'EMPTY'
  WHEN page_id % 5 = 2 THEN 'WRONG_SIGNATURE' WHEN page_id % 5 = 4 THEN 'NOT_TEXT' ELSE 'OK' END AS verdict FROM pages
""")
def format_verdicts(spark, d):
    k, html = F.col("page_id") % 5, F.coalesce("html", F.lit(""))
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), html)).when(k == 4, F.concat(F.lit("\0"), html)).otherwise(html).cast("binary")
    ext = F.element_at(F.array(*(F.lit(x) for x in ("pdf", "txt", "docx", "exe", "txt"))), (k + 1).cast("int"))
    rows = table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), body.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return files.format_check(rows)


@query("src33_preview", "SELECT p_partkey, p_name, (SELECT count(*) > 50 FROM part) AS truncated FROM part ORDER BY p_partkey LIMIT 50")
def preview(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    more = p.limit(51).agg((F.count(F.lit(1)) > 50).alias("truncated"))
    return p.orderBy("p_partkey").limit(50).crossJoin(F.broadcast(more))  # one row


# Sinks ----------------------------------------------------------------------------------------------


@query("snk09_bag_upserts", """
WITH s AS (SELECT o_custkey AS root, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), t AS (SELECT DISTINCT o_custkey AS root FROM orders), a AS (SELECT root, CASE WHEN n IS NULL THEN 'invalidate' ELSE 'upsert' END AS action FROM t LEFT JOIN s USING (root))
SELECT root, action, (row_number() OVER (ORDER BY root) - 1) // 100 AS bulk FROM a
""")
def bag_upserts(spark, d):
    o = table(spark, d, "orders")
    fresh = o.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("root")).agg(F.count(F.lit(1)).alias("n"))
    rows = o.select(F.col("o_custkey").alias("root")).distinct().join(fresh, "root", "left").select("root", F.when(F.col("n").isNull(), "invalidate").otherwise("upsert").alias("action"), F.lit(1).alias("one"))
    return R.prefix_sums(rows, ["root"], ["one"]).select("root", "action", F.expr("(one_sum - 1) DIV 100").alias("bulk"))


_STAMP = "printf('00:%02d:%02d{}000', {} // 60, {} % 60)"


@query("snk18_segment_exports", f"""
WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE turn IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS k FROM s),
l AS (SELECT conv_id, k, t, {_STAMP.format(',', 'turn', 'turn')} || ' --> ' || {_STAMP.format(',', '(turn + 1)', '(turn + 1)')} AS a, {_STAMP.format('.', 'turn', 'turn')} || ' --> ' || {_STAMP.format('.', '(turn + 1)', '(turn + 1)')} AS b FROM n)
SELECT conv_id, 'srt' AS kind, string_agg(k || chr(10) || a || chr(10) || t, chr(10) || chr(10) ORDER BY k) AS document FROM l GROUP BY 1 UNION ALL
SELECT conv_id, 'vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg(b || chr(10) || t, chr(10) || chr(10) ORDER BY k) FROM l GROUP BY 1 UNION ALL SELECT conv_id, 'txt', string_agg(t, chr(10) ORDER BY k) FROM l GROUP BY 1
""")
def segment_exports(spark, d):
    c = table(spark, d, "conversations").filter("turn IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("at"), (F.col("turn") * 1000).alias("a"), ((F.col("turn") + 1) * 1000).alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    made = [sinks.subtitles(c, "conv_id", "at", "a", "b", "text", kind).withColumn("kind", F.lit(kind)) for kind in ("srt", "vtt", "txt")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("snk19_outbox", "SELECT event_id, event_type <> 'error' AS delivered, CASE WHEN event_type = 'error' THEN event_id % 12 + 1 ELSE event_id % 12 END AS attempts, CASE WHEN event_type = 'error' THEN least(300, pow(2, least(event_id % 12 + 1, 8))::BIGINT) END AS delay FROM events")
def outbox(spark, d):
    failed, tried = F.col("event_type") == "error", F.col("event_id") % 12
    delay = F.least(F.lit(300).cast("long"), F.pow(F.lit(2.0), F.least(tried + 1, F.lit(8))).cast("long"))
    return table(spark, d, "events").select("event_id", (~failed).alias("delivered"), F.when(failed, tried + 1).otherwise(tried).alias("attempts"), F.when(failed, delay).alias("delay"))


# Joins and predicates -------------------------------------------------------------------------------


@query("j10_record_diff", f"WITH s AS ({_SOURCE}), t AS ({_TARGET}) SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'source only' WHEN s.id IS NULL THEN 'master only' WHEN s.name IS DISTINCT FROM t.name OR s.segment IS DISTINCT FROM t.segment THEN 'different' ELSE 'equal' END AS side FROM s FULL JOIN t ON s.id = t.id")
def record_diff(spark, d):
    source, target = _pair(spark, d)
    both = source.alias("s").join(target.alias("t"), F.col("s.id") == F.col("t.id"), "full_outer")
    side = F.when(F.col("t.id").isNull(), "source only").when(F.col("s.id").isNull(), "master only").when(R.differs(["name", "segment"]), "different").otherwise("equal")
    return both.select(F.coalesce("s.id", "t.id").alias("id"), side.alias("side"))


@query("j15_sharing_with_seed", "SELECT a.s_suppkey AS seed, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey % 100 = 0")
def sharing(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    seeds = s.filter("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("seed"), "s_nationkey")
    return s.join(seeds, "s_nationkey").filter("s_suppkey <> seed").select("seed", F.col("s_suppkey").alias("other"))


@query("j18_query_product", "SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def product(spark, d):
    e = table(spark, d, "embeddings")
    return V.knn(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", None)


@query("p09_metadata_allowed", """
SELECT p_partkey, p_size % 5 <> 0 AND p_size % 6 IN (0, 1, 2, 3) AND p_retailprice > 950 AND (p_size % 2 = 0 OR p_partkey % 3 = 0) AS allowed, CASE WHEN p_size % 5 = 0 THEN 'inactive' WHEN p_size % 6 NOT IN (0, 1, 2, 3) THEN 'lifecycle' WHEN p_retailprice <= 950 THEN 'denied' WHEN p_size % 2 <> 0 AND p_partkey % 3 <> 0 THEN 'unpublished' ELSE 'allowed' END AS reason FROM part
""")
def metadata_allowed(spark, d):
    active, stage, kept, shown = F.col("p_size") % 5 != 0, (F.col("p_size") % 6).isin(0, 1, 2, 3), F.col("p_retailprice") > 950, (F.col("p_size") % 2 == 0) | (F.col("p_partkey") % 3 == 0)
    reason = F.when(~active, "inactive").when(~stage, "lifecycle").when(~kept, "denied").when(~shown, "unpublished").otherwise("allowed")
    return table(spark, d, "part").select("p_partkey", (active & stage & kept & shown).alias("allowed"), reason.alias("reason"))


@query("p11_evidence_eligible", "SELECT doc_id, coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND source IS NOT NULL AS eligible FROM documents LEFT JOIN labels USING (doc_id)")
def evidence_eligible(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", (F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False)) & F.col("source").isNotNull()).alias("eligible"))


#: Keys that no serialised record may have.
SECRETS = ("password", "hashed_password", "password_hash", "remember_token", "access_token", "refresh_token", "session_token", "api_key")


@query("p13_without_secrets", "SELECT c_custkey, CAST(json_merge_patch(CAST(json_object('name', c_name, 'password', 'x' || c_custkey, 'api_key', c_mktsegment, 'segment', c_mktsegment) AS JSON), CAST('{\"password\": null, \"api_key\": null}' AS JSON)) AS VARCHAR) AS record FROM customer")
def without_secrets(spark, d):
    made = F.create_map(F.lit("name"), F.col("c_name"), F.lit("password"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")), F.lit("api_key"), F.col("c_mktsegment"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.map_filter(made, lambda k, _: ~F.lower(k).isin(*SECRETS))).alias("record"))


@query("p14_sensitive_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def sensitive_columns(spark, d):
    c = table(spark, d, "customer")
    return c.select(*(name for name in c.columns if name not in {"c_acctbal"}))


@query("p16_writeback_whitelist", "SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'ACCEPTED' WHEN event_type = 'error' THEN 'READ_ONLY' ELSE 'UNKNOWN_FIELD' END AS verdict FROM events")
def whitelist(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when(kind.isin("signup", "purchase"), "ACCEPTED").when(kind == "error", "READ_ONLY").otherwise("UNKNOWN_FIELD").alias("verdict"))


@query("p17_visible_fields", "SELECT s_suppkey, s_name FROM supplier")
def visible_fields(spark, d):
    s = table(spark, d, "supplier")
    return s.select(*(c for c in ("s_suppkey", "s_title", "s_name", "s_grade") if c in s.columns))


# Aggregates, digests, order -------------------------------------------------------------------------


@query("a03_identity_mode", """
WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_shipdate) AS fresh FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, fresh DESC NULLS LAST, l_suppkey DESC) AS k FROM g) SELECT l_partkey, l_suppkey, n FROM r WHERE k = 1
""")
def identity_mode(spark, d):
    return R.mode_pick(table(spark, d, "lineitem"), "l_partkey", ["l_suppkey"], "l_shipdate").select("l_partkey", "l_suppkey", "n")


@query("a08_stream_fingerprint", """
WITH a AS (SELECT k1, count(*) AS n, sha256(string_agg(j, '' ORDER BY c_custkey, j)) AS h FROM (SELECT c_custkey, '"' || c_name || '"' AS j, (row_number() OVER (ORDER BY c_custkey, c_name) - 1) // 4096 AS k1 FROM customer) GROUP BY 1)
SELECT sum(n)::BIGINT AS n, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k1)) END AS fingerprint FROM a
""")
def stream_fingerprint(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.array("c_name")).alias("j")).select("c_custkey", F.expr("substring(j, 2, length(j) - 2)").alias("h"))
    return S.ordered_digest(rows, ["c_custkey"], "h", lambda listed: F.sha2(F.array_join(listed, ""), 256)).withColumnRenamed("digest", "fingerprint")


_KEYWORDS = rf"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format('text')}, '\p{{L}}+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) > 1 AND w NOT IN {_KSTOP} GROUP BY ALL), kw AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c) WHERE k <= 5)"


def _keywords(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(X.letter_tokens(F.col("text"))).alias("w")).filter((F.char_length("w") > 1) & ~F.col("w").isin(X.KEYWORD_STOPWORDS))
    counted = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).filter("k <= 5").select("doc_id", "w")


@query("a16_keyword_union", _KEYWORDS + " SELECT source, w AS keyword, count(*) AS docs FROM kw JOIN documents USING (doc_id) GROUP BY ALL")
def keyword_union(spark, d):
    return _keywords(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", F.col("w").alias("keyword")).agg(F.count(F.lit(1)).alias("docs"))


@query("a17_macro_means", "SELECT count(*) AS queries, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, count(*) FILTER (WHERE quality IS NULL) AS undefined_quality, count(*) FILTER (WHERE toxic IS NULL) AS undefined_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def macro_means(spark, d):
    return E.macro(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality", "toxic")


@query("a27_distinct_collect", "SELECT c_mktsegment, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def distinct_collect(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))  # of 25 nations


@query("a32_build_coverage", f"WITH {_FOUND} SELECT (SELECT count(*) FROM documents) AS docs, count(DISTINCT doc) AS with_mentions, count(DISTINCT alias) AS aliases, sum(n)::BIGINT AS mentions FROM mn")
def build_coverage(spark, d):
    from quarry.operators.graphs import alias_mentions

    found = alias_mentions(table(spark, d, "documents"), "doc_id", X.surface_tokens(F.col("text")), _aliases(spark, d), 3)
    counted = found.groupBy("doc_id", "alias").agg(F.count(F.lit(1)).alias("n")).agg(F.count_distinct("doc_id").alias("with_mentions"), F.count_distinct("alias").alias("aliases"), F.sum("n").alias("mentions"))
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs")).crossJoin(counted)  # one row each


@query("w06_total_rank", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def total_rank(spark, d):
    return V.ranked(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "rank")


@query("w11_turn_offsets", "SELECT conv_id, turn, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def turn_offsets(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    before = F.sum(F.char_length("t") + 1).over(Window.partitionBy("conv_id").orderBy("turn", "t").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "turn", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


@query("l04_top_evidence", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3")
def top_evidence(spark, d):
    return R.latest_by(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query("l05_top_ten", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("s03_set_difference", "WITH a AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity < 40) SELECT *, 'add' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_difference(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity")
    return R.symmetric_difference(rows.filter("l_quantity > 10").select("src", "dst").distinct(), rows.filter("l_quantity < 40").select("src", "dst").distinct())


# Text -----------------------------------------------------------------------------------------------


@query("f02_bounded_query", r"SELECT item_id, CASE WHEN item_id % 5 = 0 OR length(trim(t)) = 0 OR length(t) > 8000 THEN NULL ELSE trim(regexp_replace(nfc_normalize(t), '\s+', ' ', 'g')) END AS query FROM (SELECT item_id, '  ' || replace(text, ' ', '  ') AS t FROM benchmark)")
def bounded_query(spark, d):
    spoiled = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("\x07"), "text")).otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  "))))
    return table(spark, d, "benchmark").select("item_id", P.normalized_query(spoiled).alias("query"))


def _digest(name, column, sql):
    ORACLES[name] = f"SELECT doc_id, md5({sql}) AS digest FROM documents"
    QUERIES[name] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.md5(column()).alias("digest"))


_digest("f03_folded_text", lambda: F.coalesce(X.fold("text"), F.lit("")), f"strip_accents({_FOLD.format('text')})")
_digest("f04_casefolded_text", lambda: X.casefold(F.coalesce("text", F.lit(""))), _FOLD.format("text"))
_digest("f05_surface_tokens", lambda: F.array_join(X.surface_tokens(F.col("text")), "|"), f"array_to_string({tok('text')}, '|')")
_digest("f06_bag_tokens", lambda: F.array_join(X.bag_tokens(F.col("text")), "|"), rf"array_to_string(regexp_extract_all({_FOLD.format('text')}, '[\p{{L}}\p{{N}}]+'), '|')")
_digest("f07_letter_tokens", lambda: F.array_join(X.letter_tokens(F.col("text")), "|"), rf"array_to_string(regexp_extract_all({_FOLD.format('text')}, '\p{{L}}+'), '|')")


@query("f09_split_spans")
def split_spans(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", F.explode(P.split_spans(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.start", "s.end", F.md5(P.cut_out(F.col("text"), F.col("s"))).alias("digest"))


@query("f10_sentence_sources")
def sentence_sources(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", F.explode(P.sentence_spans(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.start", "s.end", F.md5(P.cut_out(F.col("text"), F.col("s"))).alias("digest"))


@query("f11_segmentation_windows", r"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 256.0)::BIGINT)) * 256 AS start FROM w WHERE len(w) > 0) SELECT doc_id, start, md5(array_to_string(w[start + 1 : start + 256], ' ')) AS digest FROM s")
def segmentation_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(X.word_windows(F.col("text"), 256, 0)).alias("x"))
    return w.select("doc_id", F.col("x.start").cast("long").alias("start"), F.md5(F.array_join("x.words", " ")).alias("digest"))


@query("f12_contains_phrase", f"SELECT doc_id, contains(' ' || array_to_string({tok('text')}, ' ') || ' ', ' of the ') AS held FROM documents")
def held_phrase(spark, d):
    return _docs(spark, d).select("doc_id", X.contains_phrase(F.col("tokens"), F.array(F.lit("of"), F.lit("the"))).alias("held"))


@query("f24_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS near FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("b")), 6).alias("near"))


@query("f27_term_weights", f"WITH d AS (SELECT doc_id, list_distinct({tok('text')}) AS t FROM documents), n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM d) GROUP BY 1) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM f, n")
def term_weights(spark, d):
    docs = _docs(spark, d).select("doc_id", F.array_distinct("tokens").alias("t"))
    df = docs.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).alias("idf"))  # one row


@query("f30_comparable_times", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN epoch_us(ts) // 1000000 - 25200 ELSE epoch_us(ts) // 1000000 END AS seconds FROM events")
def comparable_times(spark, d):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(plain, F.lit("Z"))).when(F.col("event_id") % 3 == 1, plain).otherwise(F.concat(plain, F.lit("+07:00")))
    aware = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.to_timestamp(aware, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("seconds"))


@query("f32_schedule_valid", "SELECT event_id, event_id % 5 < 4 AND event_id % 27 <= 23 AND event_id % 61 <= 59 AND 1 + event_id % 30 <= 28 AS valid FROM events")
def schedule_valid(spark, d):
    k = F.col("event_id")
    cadence = F.element_at(F.array(*(F.lit(x) for x in ("INTERVAL", "DAILY", "WEEKLY", "MONTHLY", "YEARLY"))), (k % 5 + 1).cast("int"))
    ok = cadence.isin("INTERVAL", "DAILY", "WEEKLY", "MONTHLY") & (k % 27).between(0, 23) & (k % 61).between(0, 59) & (1 + k % 30).between(1, 28)
    return table(spark, d, "events").select("event_id", ok.alias("valid"))


@query("f33_array_rules", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:3], ',') AS capped FROM lineitem GROUP BY 1")
def array_rules(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 3).alias("a")).select("l_orderkey", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("capped"))


@query("f37_label_maps", "SELECT s_suppkey, 'en=' || CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END || ';key=' || s_suppkey AS labels FROM supplier")
def label_maps(spark, d):
    base = F.create_map(F.lit("en"), F.col("s_name"), F.lit("key"), F.col("s_suppkey").cast("string"))
    over = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("en"), F.upper("s_name"))).otherwise(F.expr("CAST(map() AS map<string,string>)"))
    merged = F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e.key, e.value)))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(entries, ";").alias("labels"))


@query("f38_stop_words", f"SELECT doc_id, len(list_filter(t, lambda w: list_contains({_STOP}, w))) AS stops, len(list_filter(t, lambda w: list_contains({_AUX}, w))) AS numbers FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def stop_words(spark, d):
    count = lambda words: F.size(F.filter("tokens", lambda w: w.isin(*words)))
    return _docs(spark, d).select("doc_id", count(X.QUERY_STOPWORDS).alias("stops"), count(X.AUXILIARY_TERMS).alias("numbers"))


@query("x02_query_terms", f"SELECT item_id AS query, unnest(list_filter(list_distinct({tok('text')}), lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark")
def terms_of(spark, d):
    return V.query_terms(_items(spark, d), "item_id", "tokens")


@query("x05_reduced_period", f"WITH q AS (SELECT item_id, {tok('text')} AS t FROM benchmark), d AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN list_concat(t, t) WHEN 1 THEN list_concat(t, list_concat(t, t)) ELSE t END AS t FROM q), p AS (SELECT item_id, t, list_filter(range(1, len(t) // 2 + 1), lambda p: len(t) % p = 0 AND flatten(list_transform(range(len(t) // p), lambda i: t[1:p])) = t) AS p FROM d) SELECT item_id, array_to_string(CASE WHEN len(p) > 0 THEN t[1:p[1]] ELSE t END, ' ') AS query FROM p")
def reduced(spark, d):
    t, k = F.col("tokens"), F.col("item_id") % 3
    made = _items(spark, d).select("item_id", F.when(k == 0, F.concat(t, t)).when(k == 1, F.concat(t, t, t)).otherwise(t).alias("tokens"))
    return made.select("item_id", F.array_join(P.reduced_period(F.col("tokens")), " ").alias("query"))


@query("x14_approved_variants")
def approved_variants(spark, d):
    """The dictionary's phrases, the items as they are written, restore accents of folded items."""
    asked = table(spark, d, "benchmark").select("item_id", X.surface_tokens(X.fold(F.col("text"))).alias("tokens"))
    return L.accent_variants(asked, _items(spark, d).select("tokens"), "item_id", "tokens", "tokens")


@query("x18_index_freshness", "SELECT doc_id, doc_id % 7 = 0 AS stale FROM documents")
def freshness(spark, d):
    live = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("now"))
    index = table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(""))).alias("then"))
    return live.join(index, "doc_id").select("doc_id", (F.col("now") != F.col("then")).alias("stale"))


@query("x19_evidence_rows", _PLAIN + f""", top3 AS (SELECT query, doc FROM r WHERE rank <= 3), w AS (SELECT doc_id AS doc, i AS place, t[i] AS term FROM (SELECT doc_id, {tok('text')} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i))
SELECT query, doc, term, place FROM (SELECT query, doc, w.term, place, row_number() OVER (PARTITION BY query, doc ORDER BY place) AS k FROM top3 JOIN w USING (doc) JOIN q ON item_id = query AND q.term = w.term) WHERE k <= 64""")
def evidence_rows(spark, d):
    docs, terms = _docs(spark, d), V.query_terms(_items(spark, d), "item_id", "tokens")
    best = V.top(V.bm25(docs, terms, "doc_id", "tokens"), ["query"], 3).select("query", F.col("doc").alias("doc_id"))
    # The few best documents travel to the texts, which stay where they lie.
    rows = docs.join(small(best), "doc_id").select("query", F.col("doc_id").alias("doc"), F.posexplode("tokens").alias("place", "term")).join(small(terms), ["query", "term"])
    return R.latest_by(rows.withColumn("place", F.col("place").cast("long") + 1), ["query", "doc"], [F.col("place")], 64, "k").select("query", "doc", "term", "place")


@query("x20_concept_frequencies", f"WITH {_FOUND} SELECT doc AS doc_id, concept, sum(n)::BIGINT AS uses, string_agg(alias, '|' ORDER BY alias) AS terms FROM mn JOIN al USING (alias) GROUP BY ALL")
def concept_frequencies(spark, d):
    from quarry.operators.graphs import alias_mentions

    found = alias_mentions(table(spark, d, "documents"), "doc_id", X.surface_tokens(F.col("text")), _aliases(spark, d), 3)
    return found.groupBy("doc_id", "concept").agg(F.count(F.lit(1)).alias("uses"), F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("terms"))  # three aliases a concept


_LINES = "(SELECT doc_id, i - 1 AS seq, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"


@query("x21_snapshot_changes", f"WITH a AS {_LINES}, b AS (SELECT doc_id, seq, CASE WHEN seq % 7 = 3 THEN line || '!' ELSE line END AS line FROM a WHERE seq % 11 <> 5) SELECT a.doc_id, count(*) FILTER (WHERE b.line IS NULL) AS removed, count(*) FILTER (WHERE b.line <> a.line) AS changed, count(*) FILTER (WHERE b.line = a.line) AS same FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq GROUP BY 1")
def snapshot_changes(spark, d):
    before = _lines(spark, d)
    after = before.filter("seq % 11 <> 5").select("doc_id", "seq", F.when(F.col("seq") % 7 == 3, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("then"))
    return before.join(after, ["doc_id", "seq"], "left").groupBy("doc_id").agg(F.count_if(F.col("then").isNull()).alias("removed"), F.count_if(F.col("then") != F.col("line")).alias("changed"), F.count_if(F.col("then") == F.col("line")).alias("same"))


# Trees, bags, graphs --------------------------------------------------------------------------------


@query("d13_verified_bags", "SELECT doc_id, doc_id % 9 <> 4 AS verified FROM documents")
def verified_bags(spark, d):
    own = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit("0.8")), 256)
    stored = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 4, "0.7").otherwise("0.8")), 256)
    return table(spark, d, "documents").select("doc_id", (own == stored).alias("verified"))


@query("t01_logical_units", f"WITH u AS (SELECT doc_id, seq, 1 + length(line) % 3 AS level FROM {_LINES} WHERE trim(line) <> '') SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM u a LEFT JOIN u b ON b.doc_id = a.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY ALL")
def logical_units(spark, d):
    from quarry.operators.graphs import outline_parents

    units = _lines(spark, d).filter("trim(line) <> ''").select("doc_id", F.col("seq").cast("long").alias("seq"), (1 + F.char_length("line") % 3).alias("level"))
    return outline_parents(units, "doc_id", "seq", "level", 3).select("doc_id", "seq", "parent")


@query("t05_bag_build", _KEYWORDS + f", k AS (SELECT doc_id, string_agg(w, ' | ' ORDER BY w) AS keywords FROM kw GROUP BY 1) SELECT doc_id, coalesce(keywords, '') AS embedding_text, len({tok('text')}) AS length, md5(coalesce(text, '')) AS fingerprint FROM documents LEFT JOIN k USING (doc_id)")
def bag_build(spark, d):
    listed = _keywords(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " | ").alias("k"))  # five a document
    return table(spark, d, "documents").join(listed, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit("")).alias("embedding_text"), F.size(X.surface_tokens(F.col("text"))).alias("length"), F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query("t08_paired_segments")
def paired(spark, d):
    return P.paired_segments(_lines(spark, d).withColumn("seq", F.col("seq").cast("long")), "doc_id", "seq", "line")


@query("t09_index_state", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'FAILED' WHEN count(*) < 5 THEN 'BUILDING' WHEN max(o_orderkey) % 2 = 0 THEN 'READY' ELSE 'STALE' END AS state FROM orders GROUP BY 1")
def index_state(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey")
    return o.agg(F.when(F.bool_or(F.col("o_orderstatus") == "P"), "FAILED").when(F.count(F.lit(1)) < 5, "BUILDING").when(F.max("o_orderkey") % 2 == 0, "READY").otherwise("STALE").alias("state"))


@query("t10_projected_generation", "SELECT user_id, max(event_id // 100) AS generation, count(*) FILTER (WHERE event_id // 100 = m) AS units FROM (SELECT *, max(event_id // 100) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def projected_generation(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.expr("event_id DIV 100").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.max("g").alias("generation"), F.max_by("n", "g").alias("units"))


_LOOKUP = f"""
WITH q AS (SELECT item_id, {tok('text')} AS t FROM benchmark), g AS (SELECT item_id, CASE WHEN len(t) <= 32 THEN flatten(list_transform(range(1, 7), lambda n: list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], ' '))))
  ELSE list_concat(list_filter(t, lambda w: NOT list_contains({_STOP}, w)), flatten(list_transform(range(2, 7), lambda n: list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], ' ')))))[1:128] END AS g FROM q WHERE len(t) <= 160),
al AS (SELECT alias, min(item_id) AS concept FROM (SELECT item_id, unnest([array_to_string(t[1:n], ' ') FOR n IN [1, 2, 3] IF len(t) >= n]) AS alias FROM q) GROUP BY 1)
SELECT DISTINCT item_id AS query, alias, concept FROM (SELECT item_id, unnest(g) AS alias FROM g) JOIN al USING (alias)
"""


@query("c09_dictionary_lookup", _LOOKUP)
def dictionary_lookup(spark, d):
    items = _items(spark, d).filter("size(tokens) <= 160")
    informative = F.filter("tokens", lambda w: ~w.isin(*X.QUERY_STOPWORDS))
    asked = F.when(F.size("tokens") <= 32, X.ngrams(F.col("tokens"), 1, 6)).otherwise(F.slice(F.concat(informative, X.ngrams(F.col("tokens"), 2, 6)), 1, 128))
    return items.select(F.col("item_id").alias("query"), F.explode(asked).alias("alias")).distinct().join(_aliases(spark, d), "alias").select("query", "alias", "concept")


@query("g04_graph_fingerprint", f"SELECT count(*) AS edges, count(DISTINCT src) AS sources, bit_xor(('0x' || substr(md5(src || '>' || dst), 1, 12))::BIGINT) AS fingerprint FROM (SELECT src, dst FROM ({_EDGES}))")
def graph_fingerprint(spark, d):
    digest = F.conv(F.substring(F.md5(F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))), 1, 12), 16, 10).cast("long")
    return _edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.bit_xor(digest).alias("fingerprint"))


@query("g08_row_identity", "SELECT c_custkey, c_name = 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS identified FROM customer")
def row_identity(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_name") == F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("identified"))


# Reconciliation, streams, composites ----------------------------------------------------------------


@query("r02_field_differences", f"WITH s AS ({_SOURCE}), t AS ({_TARGET}) SELECT s.id, concat_ws(',', CASE WHEN s.name IS DISTINCT FROM t.name THEN 'name' END, CASE WHEN s.segment IS DISTINCT FROM t.segment THEN 'segment' END, CASE WHEN s.updated IS DISTINCT FROM t.updated THEN 'updated' END) AS fields FROM s JOIN t ON s.id = t.id")
def field_differences(spark, d):
    source, target = _pair(spark, d)
    both = source.alias("s").join(target.alias("t"), F.col("s.id") == F.col("t.id"))
    return both.select("s.id", F.array_join(R.different_fields(["name", "segment", "updated"]), ",").alias("fields"))


@query("r06_guarded_apply", f"""
WITH s AS ({_SOURCE}), t AS (SELECT *, md5(name || '|' || updated) AS live, CASE WHEN id % 23 = 0 THEN 'old' ELSE md5(name || '|' || updated) END AS planned FROM ({_TARGET}) WHERE id % 3 = 0)
SELECT t.id, CASE WHEN live <> planned THEN 'BLOCKED_MASTER_CHANGED' WHEN s.id IS NOT NULL THEN 'BLOCKED_SOURCE_REAPPEARED' ELSE 'APPLIED' END AS status FROM t LEFT JOIN s ON s.id = t.id
""")
def guarded_apply(spark, d):
    source, target = _pair(spark, d)
    live = F.md5(F.concat_ws("|", "name", F.col("updated").cast("string")))
    plan = target.filter("id % 3 = 0").select("id", live.alias("live"), F.when(F.col("id") % 23 == 0, "old").otherwise(live).alias("planned"))
    back = source.select("id").withColumn("back", F.lit(True))
    return plan.join(back, "id", "left").select("id", F.when(F.col("live") != F.col("planned"), "BLOCKED_MASTER_CHANGED").when(F.col("back"), "BLOCKED_SOURCE_REAPPEARED").otherwise("APPLIED").alias("status"))


@query("r09_due_files", "SELECT o_orderkey, o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '2023-06-01' OR o_orderkey % 13 = 0 AS due, o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2023-06-01' AND o_orderkey % 13 <> 0 AS recent_evidence FROM orders")
def due_files(spark, d):
    old, broken = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '2023-06-01 00:00:00'"), F.col("o_orderkey") % 13 == 0
    return table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "P") | old | broken).alias("due"), ((F.col("o_orderstatus") == "F") & ~old & ~broken).alias("recent_evidence"))


@query("r10_repair_verified", f"WITH s AS ({_SOURCE}), t AS ({_TARGET}), x AS (SELECT s.id, t.id IS NULL OR s.name IS DISTINCT FROM t.name OR s.segment IS DISTINCT FROM t.segment AS broken, s.id % 31 = 0 AS refused FROM s LEFT JOIN t ON s.id = t.id) SELECT count(*) FILTER (WHERE broken) AS found, count(*) FILTER (WHERE broken AND NOT refused) AS repaired, count(*) FILTER (WHERE broken AND refused) AS left_over FROM x")
def repair_verified(spark, d):
    source, target = _pair(spark, d)
    both = source.alias("s").join(target.alias("t"), F.col("s.id") == F.col("t.id"), "left")
    rows = both.select(F.col("s.id").alias("id"), (F.col("t.id").isNull() | R.differs(["name", "segment"])).alias("broken"), (F.col("s.id") % 31 == 0).alias("refused"))
    return rows.agg(F.count_if("broken").alias("found"), F.count_if(F.col("broken") & ~F.col("refused")).alias("repaired"), F.count_if(F.col("broken") & F.col("refused")).alias("left_over"))


_NEWEST = "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY 1"


def _batches(spark, d, *numbered):
    """Batches of events, each under its number, through the streaming upsert."""
    from quarry.streaming.sync import snapshot, upsert_into

    folder = _folder(spark, "batches")
    write = upsert_into(folder, "user_id", "ts", "event_id")
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    for number, condition in numbered:
        write(e.filter(condition), number)
    return snapshot(spark, folder).select("user_id", "event_id")


@query("st02_older_skipped", _NEWEST)
def older_skipped(spark, d):
    """Newer records first: what comes after them changes nothing."""
    return _batches(spark, d, (0, "event_id % 4 >= 2"), (1, "event_id % 4 < 2"))


@query("st03_exactly_once", _NEWEST)
def exactly_once(spark, d):
    """A batch that is run again has the effect of one run."""
    return _batches(spark, d, (0, "event_id % 3 = 0"), (1, "event_id % 3 = 1"), (1, "event_id % 3 = 1"), (2, "event_id % 3 = 2"))


@query("st05_slot_jobs", "SELECT 'DAILY:' || strftime(ts, '%Y-%m-%d') AS job_key, min(event_id) AS job FROM events GROUP BY 1")
def slot_jobs(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("DAILY:"), F.date_format("ts", "yyyy-MM-dd")).alias("job_key")).agg(F.min("event_id").alias("job"))


@query("st07_outbox_replay", "SELECT event_type, count(*) AS applied FROM events GROUP BY 1")
def outbox_replay(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.unionByName(e.filter("event_id % 5 = 0")).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("applied"))


@query("m13_header_scan", "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def header_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").orderBy("doc_id").limit(100)


@query("m19_read_back", f"SELECT count(*) AS rows, count(DISTINCT (src, dst)) AS edges, count(*) - count(DISTINCT (src, dst)) AS repeated FROM ({_EDGES})")
def read_back(spark, d):
    both = F.count_distinct(F.struct("src", "dst"))
    return _edges(spark, d).agg(F.count(F.lit(1)).alias("rows"), both.alias("edges"), (F.count(F.lit(1)) - both).alias("repeated"))


@query("m23_inventory_page", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 50 ORDER BY ts DESC, event_id DESC LIMIT 50")
def inventory_page(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).filter("k < 50")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "k")


@query("m25_projector_upsert", f"WITH s AS ({_SOURCE}), t AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'DONE' ELSE 'OPEN' END AS status FROM ({_TARGET})) SELECT s.id, CASE WHEN t.id IS NULL THEN 'INSERT' WHEN s.name IS DISTINCT FROM t.name THEN 'IMMUTABLE_CHANGED' WHEN status = 'DONE' THEN 'TERMINAL' ELSE 'UPDATE' END AS outcome FROM s LEFT JOIN t ON s.id = t.id")
def projector_upsert(spark, d):
    source, target = _pair(spark, d)
    both = source.alias("s").join(target.withColumn("status", F.when(F.col("id") % 8 == 0, "DONE").otherwise("OPEN")).alias("t"), F.col("s.id") == F.col("t.id"), "left")
    outcome = F.when(F.col("t.id").isNull(), "INSERT").when(R.differs(["name"]), "IMMUTABLE_CHANGED").when(F.col("t.status") == "DONE", "TERMINAL").otherwise("UPDATE")
    return both.select("s.id", outcome.alias("outcome"))


@query("m26_pages_complete", "SELECT l_orderkey, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete, bool_and(l_linestatus = 'F') AS verified, sha256(l_orderkey || ':' || max(l_linenumber)) AS unit_id FROM lineitem GROUP BY 1")
def pages_complete(spark, d):
    last = F.max("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_linenumber") == last).alias("complete"), F.bool_and(F.col("l_linestatus") == "F").alias("verified"), last.alias("last")).select("l_orderkey", "complete", "verified", F.sha2(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("last").cast("string")), 256).alias("unit_id"))


@query("m29_corpus_marker", "SELECT count(*) AS members, bit_xor(('0x' || substr(md5(o_custkey || ':' || k || ':' || s), 1, 12))::BIGINT) AS marker FROM (SELECT o_custkey, max(o_orderkey) AS k, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)")
def corpus_marker(spark, d):
    latest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"), F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("k").cast("string"), "s")), 1, 12), 16, 10).cast("long")
    return latest.agg(F.count(F.lit(1)).alias("members"), F.bit_xor(digest).alias("marker"))
