"""Queries of the text, lexical, dense, fusion and evaluation families."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import evaluation as E
from quarry.operators import lexical as L
from quarry.operators import placed as P
from quarry.operators import retrieval as V
from quarry.operators.graphs import cut, small
from quarry.operators.runs import bit_set, kept
from quarry.session import spread, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_FOLD = "replace(lower(coalesce({}, '')), 'ß', 'ss')"
_TOK = r"regexp_extract_all({}, 'c\+\+|c#|\.net\b|\p{{Nd}}+(?:\.\p{{Nd}}+)+|[\p{{L}}\p{{N}}]+')"


def tok(col: str) -> str:
    return _TOK.format(_FOLD.format(col))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.QUERY_STOPWORDS) + "]"
_KSTOP = "(" + ", ".join(f"'{w}'" for w in X.KEYWORD_STOPWORDS) + ")"
_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"


def _docs(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return docs.withColumn("tokens", X.surface_tokens(F.col("text"))).withColumn("title_tokens", X.surface_tokens(title))


def _items(spark, d):
    """All items, with all tokens of their texts."""
    return table(spark, d, "benchmark").select("item_id", X.surface_tokens(F.col("text")).alias("tokens"))


def _lines(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line"))


_BM25 = """
WITH d AS (SELECT doc_id, {tokens} AS t FROM documents), p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, coalesce(avg(len(t)), 1) AS a FROM d),
q AS (SELECT item_id, unnest(list_filter(list_distinct({items}), lambda w: NOT list_contains({stop}, w))) AS term FROM benchmark),
{title}
s AS (SELECT item_id AS query, tf.doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * ({f}) * 2.2 / (({f}) + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score, count(*) AS matched
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st {join} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
"""
_PLAIN = _BM25.format(tokens=tok("text"), items=tok("text"), stop=_STOP, title="", f="tf", join="")


@query("x04_bm25_topk", _PLAIN + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    scores = V.bm25(_docs(spark, d), V.query_terms(_items(spark, d), "item_id", "tokens"), "doc_id", "tokens")
    return V.top(scores, ["query"], 10).select("query", "doc", "score", "rank")


@query("x03_bm25_title_boost", _BM25.format(
    tokens=f"list_concat({tok(_TITLE)}, {tok('text')})", items=tok("text"), stop=_STOP, f="(tf + coalesce(ttf, 0))",
    title=f"tt AS (SELECT doc_id, term, count(*) AS ttf FROM (SELECT doc_id, unnest({tok(_TITLE)}) AS term FROM documents) GROUP BY ALL),", join="LEFT JOIN tt ON tt.doc_id = tf.doc_id AND tt.term = tf.term",
) + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def bm25_title(spark, d):
    scores = V.bm25(_docs(spark, d), V.query_terms(_items(spark, d), "item_id", "tokens"), "doc_id", "tokens", "title_tokens")
    return V.top(scores, ["query"], 10).select("query", "doc", "score", "rank")


@query("x06_phrase_boost", _PLAIN + f""", ph AS (SELECT item_id, ' ' || array_to_string({tok('text')}, ' ') || ' ' AS phrase FROM benchmark WHERE len({tok('text')}) > 1),
pa AS (SELECT doc_id, ' ' || array_to_string({tok('line')}, ' ') || ' ' AS passage FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
b AS (SELECT query, doc, round(score * CASE WHEN EXISTS (SELECT 1 FROM pa JOIN ph ON ph.item_id = query WHERE pa.doc_id = doc AND contains(passage, phrase)) THEN 1.2 ELSE 1.0 END, 6) AS score FROM r)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b) WHERE rank <= 10""")
def phrase_boost(spark, d):
    docs, items = _docs(spark, d), _items(spark, d)
    scores = V.bm25(docs, V.query_terms(items, "item_id", "tokens"), "doc_id", "tokens")
    passages = _lines(spark, d).select(F.col("doc_id").alias("doc"), X.surface_tokens(F.col("line")).alias("tokens"))
    hits = V.phrase_hits(passages, items.withColumnRenamed("item_id", "query")).withColumn("boost", F.lit(1.2))
    boosted = scores.join(small(hits), ["query", "doc"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 6))
    return V.top(boosted, ["query"], 10).select("query", "doc", "score", "rank")


@query("x09_min_coverage", _PLAIN + ", n AS (SELECT item_id, count(*) AS terms FROM q GROUP BY 1) SELECT query, doc, score FROM r JOIN n ON item_id = query WHERE matched >= 0.75 * greatest(1, terms)")
def min_coverage(spark, d):
    terms = V.query_terms(_items(spark, d), "item_id", "tokens")
    scores = V.bm25(_docs(spark, d), terms, "doc_id", "tokens")
    n = terms.groupBy("query").agg(F.count(F.lit(1)).alias("terms"))
    return scores.join(n, "query").filter("matched >= 0.75 * greatest(1, terms)").select("query", "doc", "score")


@query("x16_field_rrf", f"""
WITH f AS (SELECT doc_id, 'title' AS field, {tok(_TITLE)} AS t FROM documents UNION ALL SELECT doc_id, 'body', {tok('text')} FROM documents), p AS (SELECT doc_id, field, len(t) AS len, unnest(t) AS term FROM f),
tf AS (SELECT doc_id, field, len, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM f GROUP BY 1),
q AS (SELECT item_id, unnest(list_filter(list_distinct({tok('text')}), lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark),
s AS (SELECT item_id AS query, field, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query, field ORDER BY score DESC, doc) AS rank FROM s), u AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS branches FROM r GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM u) WHERE rank <= 10""")
def field_rrf(spark, d):
    docs, terms = _docs(spark, d), V.query_terms(_items(spark, d), "item_id", "tokens")
    fields = ["title_tokens", "tokens"]
    # Texts are tokenised once; what items want of them is written out.
    found = cut(kept(docs, "doc_id", fields, bit_set(terms.select("term").distinct(), "term")))
    return P.fused([P.Branch(found, "doc_id", c, terms, size=f"{c}_size") for c in fields], [], 10)


@query("x17_candidates", f"WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents), q AS (SELECT item_id, list_filter(list_distinct({tok('text')}), lambda w: NOT list_contains({_STOP}, w)) AS w FROM benchmark) SELECT item_id AS query, count(*) AS candidates FROM q JOIN t ON list_has_any(t, w) GROUP BY 1")
def candidates(spark, d):
    terms = V.query_terms(_items(spark, d), "item_id", "tokens")
    found = V.postings(_docs(spark, d), "doc_id", "tokens", terms.select("term").distinct())
    return found.join(terms, "term").select("query", "doc").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("candidates"))


@query("a12_term_frequency", f"SELECT doc_id AS doc, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM (SELECT doc_id, {tok('text')} AS t FROM documents)) GROUP BY ALL")
def term_frequency(spark, d):
    return V.postings(_docs(spark, d), "doc_id", "tokens")


@query("a13_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY 1")
def document_frequency(spark, d):
    return V.postings(_docs(spark, d), "doc_id", "tokens").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("a14_field_statistics", f"SELECT field, count(*) AS docs, sum(len(t))::BIGINT AS tokens FROM (SELECT 'title' AS field, {tok(_TITLE)} AS t FROM documents UNION ALL SELECT 'body', {tok('text')} FROM documents) GROUP BY 1")
def field_statistics(spark, d):
    docs = _docs(spark, d)
    return docs.select(F.explode(F.array(F.struct(F.lit("title").alias("field"), F.size("title_tokens").alias("n")), F.struct(F.lit("body").alias("field"), F.size("tokens").alias("n")))).alias("x")).groupBy("x.field").agg(F.count(F.lit(1)).alias("docs"), F.sum("x.n").alias("tokens"))


@query("a15_top_keywords", rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format('text')}, '\p{{L}}+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) > 1 AND w NOT IN {_KSTOP} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c) SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS keywords FROM r WHERE k <= 5 GROUP BY 1
""")
def top_keywords(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(X.letter_tokens(F.col("text"))).alias("w")).filter((F.char_length("w") > 1) & ~F.col("w").isin(X.KEYWORD_STOPWORDS))
    counted = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))
    kept = counted.withColumn("k", place).filter("k <= 5").groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return kept.select("doc_id", F.array_join("w", " ").alias("keywords"))


@query("f01_squeezed_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(13) || '\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def squeezed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("digest"))


@query("f08_word_windows", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 200) / 160.0), 0)::BIGINT + 1)) * 160 AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start, len(w[start + 1 : start + 200]) AS words, md5(array_to_string(w[start + 1 : start + 200], ' ')) AS digest FROM s
""")
def windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(X.word_windows(F.col("text"))).alias("x"))
    return w.select("doc_id", F.col("x.start").cast("long").alias("start"), F.size("x.words").alias("words"), F.md5(F.array_join("x.words", " ")).alias("digest"))


@query("f13_query_form", rf"""
WITH q AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'AB_' || item_id || '-X1' WHEN 1 THEN 'How ' || text WHEN 2 THEN 'SQL2' WHEN 3 THEN left(text, 12) ELSE text END AS t FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(trim(t), '^[A-Z0-9]{{2,}}(?:[_-][A-Z0-9]+)+$') THEN 'identifier' WHEN lower(trim(t)) IN ('c++', 'c#', '.net') THEN 'technical' WHEN regexp_matches(trim(t), '^[A-Z][A-Z0-9]{{1,7}}$') THEN 'acronym'
  WHEN contains(t, '?') OR regexp_matches(lower(trim(t)), '^(how |why |what |comment |pourquoi |làm sao|tại sao|cách |giải thích)') THEN 'question' WHEN len({tok('t')}) <= 4 THEN 'short' ELSE 'descriptive' END AS form FROM q
""")
def forms(spark, d):
    k, text = F.col("item_id") % 5, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("AB_"), F.col("item_id").cast("string"), F.lit("-X1"))).when(k == 1, F.concat(F.lit("How "), text)).when(k == 2, "SQL2").when(k == 3, F.substring(text, 1, 12)).otherwise(text)
    return table(spark, d, "benchmark").select("item_id", X.query_form(made).alias("form"))


@query("f23_valid_vectors", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def valid(spark, d):
    return table(spark, d, "embeddings").select("vec_id", X.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("f26_binary_score", f"""
WITH t AS (SELECT doc_id, list_distinct({tok('text')}) AS t FROM documents), q AS (SELECT item_id, list_distinct({tok('text')}) AS q FROM benchmark),
p AS (SELECT item_id, doc_id, len(list_intersect(t, q)) AS shared, len(t) AS n, len(q) AS m FROM q JOIN t ON list_has_any(t, q)), s AS (SELECT item_id, doc_id, round(shared / sqrt(n * m), 6) AS score FROM p)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 20
""")
def binary_score(spark, d):
    best = V.binary_scores(_items(spark, d), _docs(spark, d), "item_id", "doc_id", "tokens", 20, all_tokens=True)
    return best.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score")


@query("c06_phrase_mining", f"""
WITH l AS (SELECT doc_id, {tok('text')} AS t FROM documents), n AS (SELECT doc_id, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, greatest(len(t) - k + 2, 1)), lambda i: array_to_string(t[i:i + k - 1], ' '))))) AS phrase FROM l)
SELECT phrase, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM n GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5
""")
def phrases(spark, d):
    return L.frequent_phrases(_docs(spark, d), "doc_id", "tokens", 2, 4, 5)


_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_KNN = f"""
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS doc, a.label AS query_label, b.label, {_SIM} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
"""


def _neighbours(spark, d, k=20):
    e = table(spark, d, "embeddings")
    near = V.knn(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", k + 1).filter("query <> doc").drop("rank")
    return V.top(near, ["query"], k)


@query("d04_knn_cosine", _KNN + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def knn(spark, d):
    return _neighbours(spark, d, 10).select("query", "doc", "score", "rank")


@query("d06_best_per_group", _KNN + "SELECT query, label, max(score) AS best, min_by(doc, rank) AS doc FROM r WHERE rank <= 20 GROUP BY ALL")
def best_per_group(spark, d):
    near = _neighbours(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc")
    return near.groupBy("query", "label").agg(F.max("score").alias("best"), F.min_by("doc", "rank").alias("doc"))


@query("w10_score_gaps", _KNN + "SELECT query, max(score) FILTER (WHERE rank = 1) AS top, coalesce(round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6), 0) AS gap2, coalesce(round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 5), 6), 0) AS gap5 FROM r GROUP BY 1")
def gaps(spark, d):
    return V.score_gaps(_neighbours(spark, d).drop("rank"), ["query"])


@query("a29_bounded_aggregate", _KNN + ", g AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, doc) AS k FROM r WHERE rank <= 20) SELECT query, label, max(score) AS best, round(avg(score), 6) AS mean FROM g WHERE k <= 3 GROUP BY ALL")
def aggregate(spark, d):
    near = _neighbours(spark, d).drop("rank").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc")
    return V.bounded_aggregate(near, ["query", "label"], 3)


_BRANCHES = _KNN + """, b AS (SELECT query, doc, label, score, 'dense' AS branch, rank FROM r WHERE rank <= 20
  UNION ALL SELECT query, doc, label, score, 'label', row_number() OVER (PARTITION BY query ORDER BY doc % 97 DESC, doc) FROM r WHERE rank <= 20 AND label = query_label)
"""


def _branches(spark, d):
    e = table(spark, d, "embeddings")
    near = _neighbours(spark, d).join(e.select(F.col("vec_id").alias("doc"), "label"), "doc").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")), "query")
    dense = near.select("query", "doc", "label", "score", F.lit("dense").alias("branch"), "rank")
    other = near.filter("label = query_label").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.col("doc") % 97), "doc")))
    return dense.unionByName(other.select("query", "doc", "label", "score", F.lit("label").alias("branch"), "rank"))


@query("d14_rrf_hybrid", _BRANCHES + "SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS branches FROM b GROUP BY ALL")
def rrf(spark, d):
    return V.rrf(_branches(spark, d))


@query("d15_version_rrf", _BRANCHES + """, k AS (SELECT *, row_number() OVER (PARTITION BY query, branch, label ORDER BY score DESC, doc) AS n FROM b), v AS (SELECT *, row_number() OVER (PARTITION BY query, branch ORDER BY score DESC, label) AS vr FROM k WHERE n = 1)
SELECT query, label, round(sum(1.0::DOUBLE / (60 + vr)), 9) AS score, min_by(doc, branch) AS representative FROM v GROUP BY ALL""")
def version_rrf(spark, d):
    return V.version_rrf(_branches(spark, d).drop("rank"), "label")


@query("d16_vector_priority", _KNN + """, dense AS (SELECT query, doc, score FROM r WHERE rank <= 5), lex AS (SELECT query, doc, score FROM r WHERE rank <= 20 AND label = query_label),
u AS (SELECT *, 0 AS side FROM dense UNION ALL SELECT lex.*, 1 FROM lex ANTI JOIN dense USING (query, doc)), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY side, score DESC, doc) AS rank FROM u)
SELECT query, doc, rank, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM o""")
def priority(spark, d):
    b = _branches(spark, d)
    dense = b.filter("branch = 'dense' AND rank <= 5").select("query", "doc", "score")
    return V.vector_priority(dense, b.filter("branch = 'label'").select("query", "doc", "score")).select("query", "doc", "rank", "score")


@query("d18_evidence_within", _KNN + """, t AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM r WHERE rank <= 10), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc % 13 DESC, score DESC, doc) AS n FROM t WHERE round(best - score, 9) <= 0.08)
SELECT query, doc, score FROM k WHERE n = 1""")
def evidence(spark, d):
    near = _neighbours(spark, d, 10).drop("rank").withColumn("coverage", F.col("doc") % 13)
    return V.evidence_within(near, ["query"], 0.08, 10, "coverage").select("query", "doc", "score")


_QREL = _KNN + ", q AS (SELECT query, doc, 1 + doc % 2 AS grade FROM s WHERE label = query_label AND doc % 7 <> 3)"
_METRICS = _QREL + """, c AS (SELECT query, doc, rank, coalesce(grade, 0) AS grade FROM r LEFT JOIN q USING (query, doc) WHERE rank <= 10),
g AS (SELECT query, count(*) FILTER (WHERE grade > 0) AS hits, min(rank) FILTER (WHERE grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM c GROUP BY 1),
i AS (SELECT query, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(n + 1)) FILTER (WHERE n <= 10) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS n FROM q) GROUP BY 1),
m AS (SELECT query, round(hits / 10, 6) AS precision, CASE WHEN relevant > 0 THEN round(hits / relevant, 6) END AS recall, CASE WHEN relevant > 0 THEN round(coalesce(1 / first, 0), 6) END AS mrr, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) END AS ndcg FROM g LEFT JOIN i USING (query))
"""


def _metrics(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    qrels = asked.join(e.select(F.col("vec_id").alias("doc"), "label"), "label").filter("query <> doc AND doc % 7 <> 3").select("query", "doc", (1 + F.col("doc") % 2).alias("grade"))
    return E.metrics_at_k(_neighbours(spark, d, 10), qrels, 10)


@query("e01_metrics_at_k", _METRICS + "SELECT * FROM m")
def metrics(spark, d):
    return _metrics(spark, d)


@query("e02_macro_eval", _METRICS + "SELECT count(*) AS queries, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(ndcg), 6) AS mean_ndcg, count(*) FILTER (WHERE precision IS NULL) AS undefined_precision, count(*) FILTER (WHERE recall IS NULL) AS undefined_recall, count(*) FILTER (WHERE ndcg IS NULL) AS undefined_ndcg FROM m")
def macro(spark, d):
    return E.macro(_metrics(spark, d), "precision", "recall", "ndcg")


@query("a18_latency_percentiles", "SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY 1")
def percentiles(spark, d):
    return E.distribution(table(spark, d, "events"), "event_type", "value")


@query("m15_nearest_rank", "SELECT event_type, list_sort(list(value))[floor(0.95 * (count(value) - 1))::BIGINT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def nearest(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95).withColumnRenamed("value", "p95")


@query("a19_score_by_judgment", "SELECT coalesce(CAST(quality AS VARCHAR), 'unjudged') AS judged, count(n_chars) AS n, min(n_chars) AS least, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, max(n_chars) AS most FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def by_judgment(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("judged", F.coalesce(F.col("quality").cast("string"), F.lit("unjudged")))
    return E.distribution(rows, "judged", "n_chars")


@query("a21_reviewer_agreement", "SELECT o_custkey, count(*) AS reviews, count(DISTINCT o_orderstatus) = 1 AS agreed FROM orders GROUP BY 1")
def agreement(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reviews"), (F.count_distinct("o_orderstatus") == 1).alias("agreed"))


@query("e04_calibrate_threshold", """
WITH h AS (SELECT source AS q, round(least(n_chars, 10000) / 10000, 2) AS s, quality = 1 AS r FROM documents JOIN labels USING (doc_id)), t AS (SELECT DISTINCT s AS t FROM h UNION SELECT 0 UNION SELECT 1),
g AS (SELECT t, q, count(*) FILTER (WHERE s > t) AS got, count(*) FILTER (WHERE s > t AND r) AS good, count(*) FILTER (WHERE r) AS rel FROM t, h GROUP BY ALL),
w AS (SELECT t, round(avg(CASE WHEN rel = 0 THEN CASE WHEN got = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(2.0 * good / (got + rel), 0) END::DOUBLE), 9) AS macro_f1, round(avg(CASE WHEN rel > 0 THEN good / rel END), 9) AS recall FROM g GROUP BY 1)
SELECT t::DOUBLE AS threshold, macro_f1, recall FROM w ORDER BY macro_f1 DESC, recall DESC, t LIMIT 1
""")
def calibrate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    hits = rows.select(F.col("source").alias("query"), F.round(F.least("n_chars", F.lit(10000)) / 10000, 2).alias("score"), F.when(F.col("quality") == 1, 2).otherwise(0).alias("grade"))
    return E.calibrate(hits)


#: Queries whose label is 3 have no answer; of the others' labels a seventh of the documents is relevant.
_POLICIES = _KNN + """, h AS (SELECT query, doc, greatest(score, 0)::DOUBLE AS score FROM r WHERE rank <= 20), rel AS (SELECT query, doc FROM s WHERE label = query_label AND query_label <> 3 AND (query + doc) % 7 = 0),
w AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), k AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM h),
f AS (SELECT query, max(score) AS top, round(coalesce(max(score) - max(score) FILTER (WHERE place = 2), 0), 9) AS gap2, round(coalesce(max(score) - max(score) FILTER (WHERE place = 5), 0), 9) AS gap5 FROM k GROUP BY 1),
g AS (SELECT unnest([0.0, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS a), gaps AS (SELECT 'gap2' AS feature, gap2 AS m FROM f WHERE gap2 > 0 UNION SELECT 'gap5', gap5 FROM f WHERE gap5 > 0 UNION SELECT 'gap2', 0 UNION SELECT 'gap5', 0),
po AS (SELECT 'absolute' AS method, t AS absolute, 0.0::DOUBLE AS margin, 'gap5' AS feature FROM (SELECT score AS t FROM h WHERE score > 0 UNION SELECT 0.0 UNION SELECT 1.0) UNION ALL SELECT replace(feature, 'gap', 'margin'), 0.0, m, feature FROM gaps UNION ALL SELECT 'selective', a, m, feature FROM g, gaps),
x AS (SELECT po.*, q.query, n, top > absolute AND (margin = 0 OR CASE feature WHEN 'gap2' THEN gap2 ELSE gap5 END > margin) AS yes,
  (SELECT count(*) FROM k JOIN rel USING (query, doc) WHERE k.query = q.query AND k.place <= 5 AND k.score > absolute) AS good, (SELECT count(*) FROM k JOIN rel USING (query, doc) WHERE k.query = q.query AND k.place = 1) AS lead FROM po, (SELECT * FROM f FULL JOIN w USING (query)) q),
m AS (SELECT method, absolute, margin, feature, coalesce(round(sum(CASE WHEN yes THEN good / n ELSE 0 END) FILTER (WHERE n IS NOT NULL) / count(n), 9), 0) AS recall5, coalesce(round(sum(CASE WHEN yes THEN lead ELSE 0 END) FILTER (WHERE n IS NOT NULL) / count(n), 9), 0) AS precision1,
  round(1 - (count(*) FILTER (WHERE yes AND n IS NOT NULL)) / count(n), 9) AS false_abstention, round((count(*) FILTER (WHERE yes AND n IS NULL)) / nullif(count(*) FILTER (WHERE n IS NULL), 0), 9) AS false_positive FROM x GROUP BY ALL),
o AS (SELECT *, recall5 >= 0.05 AND coalesce(false_abstention <= 0.5, false) AS allowed FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY method, allowed ORDER BY coalesce(false_positive, 1), recall5 DESC, precision1 DESC, absolute, margin, feature) AS p FROM o)
"""


@query("e06_policy_search", _POLICIES + "SELECT t.method, trials, feasible, absolute, margin, feature, recall5, precision1, false_abstention, false_positive FROM (SELECT method, count(*) AS trials, count(*) FILTER (WHERE allowed) AS feasible FROM o GROUP BY 1) t LEFT JOIN b ON b.method = t.method AND allowed AND p = 1")
def policy_search(spark, d):
    """Constraints are looser here than the defaults, since a query has more relevant documents than five places."""
    e = table(spark, d, "embeddings")
    hits = _neighbours(spark, d).select("query", "doc", F.greatest("score", F.lit(0.0)).alias("score"))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    relevant = asked.join(e.select(F.col("vec_id").alias("doc"), "label"), "label").filter("query <> doc AND label <> 3 AND (query + doc) % 7 = 0").select("query", "doc")
    # Queries without an answer are known by their hits.
    return E.policy_search(hits, relevant, 0.05, 0.5)


@query("e07_split_leakage", "SELECT md5(text) AS body, count(DISTINCT doc_id % 2) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1")
def leakage(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("body")).agg(F.count_distinct(F.col("doc_id") % 2).alias("splits")).filter("splits > 1")


@query("e08_pool_conflicts", "SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def conflicts(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands")).filter("brands > 1")


@query("d09_max_sim", """
WITH b AS (SELECT q.label AS query, q.vec_id, e.label AS doc, max(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query, doc, round(avg(best), 6) AS score FROM b GROUP BY ALL
""")
def maxsim(spark, d):
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("long"))
    return V.max_sim(e.filter("vec_id % 100 = 0"), e, "label", "label", "vec_id", "embedding")


@query("d10_complete_link")
def clusters(spark, d):
    e = table(spark, d, "embeddings")
    return V.complete_link(e.withColumn("bag", F.floor(F.col("vec_id") / 32)), "bag", "vec_id", "embedding", 0.3)
