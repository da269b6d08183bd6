"""Queries of the rules on top of BM25, of bags, concept expansion and graded evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import evaluation as E
from quarry.operators import lexical as L
from quarry.operators import retrieval as V
from quarry.operators import search as S
from quarry.operators.graphs import cut
from quarry.plans.retrieval import _PLAIN, _QREL, _STOP, _docs, _items, _lines, _neighbours, tok
from quarry.session import table

QUERIES, ORACLES = {}, {}
_AUX = "[" + ", ".join(f"'{w}'" for w in X.AUXILIARY_TERMS) + "]"
_DULL = "[" + ", ".join(f"'{w}'" for w in (*X.QUERY_STOPWORDS, *X.AUXILIARY_TERMS)) + "]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _passages(docs):
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select(X.surface_tokens(F.col("line")).alias("tokens"))


#: Short queries: the lines of 3 to 12 tokens in the documents of the stated query set, named by document and line.
_SHORT = f"(SELECT doc_id || ':' || (i - 1) AS query, line, {tok('line')} AS t FROM (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id % 100 = 0), unnest(range(1, len(l) + 1)) AS u(i)) WHERE len({tok('line')}) BETWEEN 3 AND 12)"


def _short(spark, d):
    lines = _lines(spark, d).filter("doc_id % 100 = 0").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("query"), "line", X.surface_tokens(F.col("line")).alias("tokens"))
    return lines.filter("size(tokens) BETWEEN 3 AND 12")


_GRAMS = "flatten([list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], ' ')) for n in [3, 4, 5, 6]])"


@query("x07_anchor_rule", f"""
WITH sq AS {_SHORT}, q AS (SELECT query, unnest(list_filter(list_distinct(t), lambda w: NOT list_contains({_STOP}, w))) AS term FROM sq),
d AS (SELECT doc_id, {tok('text')} AS t FROM documents), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
r AS (SELECT query, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score, count(*) FILTER (WHERE NOT list_contains({_AUX}, term)) AS inf FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
ps AS (SELECT {tok('line')} AS t FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)), pg AS (SELECT DISTINCT unnest({_GRAMS}) AS phrase FROM ps), qg AS (SELECT DISTINCT query, unnest({_GRAMS}) AS phrase FROM sq),
an AS (SELECT query, phrase, list_filter(list_distinct(string_split(phrase, ' ')), lambda w: NOT list_contains({_DULL}, w)) AS w, len(string_split(phrase, ' ')) AS n FROM qg WHERE phrase IN (SELECT phrase FROM pg)),
am AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY query) AS m FROM an WHERE len(w) >= 2) WHERE n = m),
aw AS (SELECT query, phrase, len(w) AS need, unnest(w) AS term FROM am), ok AS (SELECT DISTINCT query, doc_id AS doc FROM (SELECT query, phrase, need, doc_id, count(*) AS c FROM aw JOIN tf USING (term) GROUP BY ALL) WHERE c = need)
SELECT r.query, r.doc, round(CASE WHEN am.query IS NULL OR ok.doc IS NOT NULL THEN score ELSE 0.7 * score END, 8) AS score FROM r LEFT JOIN (SELECT DISTINCT query FROM am) am ON am.query = r.query LEFT JOIN ok ON ok.query = r.query AND ok.doc = r.doc WHERE am.query IS NULL OR ok.doc IS NOT NULL OR (inf >= 2 AND r.query NOT IN (SELECT query FROM sq WHERE contains(line, '"') OR contains(line, '“')))
""")
def anchor_rule(spark, d):
    docs, asked = _docs(spark, d), _short(spark, d)
    asked = cut(asked)
    terms = V.query_terms(asked, "query", "tokens")
    return L.anchored_scores(docs, "doc_id", "tokens", terms, L.anchors(asked, _passages(docs), "query", "tokens", "tokens"), asked.filter(F.contains("line", F.lit('"')) | F.contains("line", F.lit("“"))))


@query("x08_auxiliary_only", _PLAIN + f", tq AS (SELECT item_id, count(*) > 1 AS many FROM q GROUP BY 1) SELECT query, doc, score FROM r JOIN tq ON tq.item_id = query WHERE NOT many OR EXISTS (SELECT 1 FROM q JOIN tf USING (term) WHERE q.item_id = query AND tf.doc_id = doc AND NOT list_contains({_AUX}, term))")
def auxiliary_only(spark, d):
    terms = V.query_terms(_items(spark, d), "item_id", "tokens")
    found = V.index(_docs(spark, d), "doc_id", "tokens", terms)
    return L.without_auxiliary(V.scores(found, terms), found.filter("term IS NOT NULL"), terms).select("query", "doc", "score")


@query("x13_accent_variants")
def accents(spark, d):
    items = table(spark, d, "benchmark").select("item_id", X.surface_tokens(X.fold(F.col("text"))).alias("tokens"))
    return L.accent_variants(items, _passages(_docs(spark, d)), "item_id", "tokens", "tokens")


@query("x13_assisted_search")
def assisted_search(spark, d):
    """Items typed without accents, and with those that the corpus restores at 0.8 of their score."""
    docs, typed = _docs(spark, d), table(spark, d, "benchmark").select("item_id", X.surface_tokens(X.fold(F.col("text"))).alias("tokens"))
    return accent_assisted(docs, typed)


def accent_assisted(docs, typed, k=10):
    """(query, doc, score, rank) of queries (item_id, tokens) over documents (doc_id, text, tokens)."""
    variants = cut(L.accent_variants(typed, _passages(docs), "item_id", "tokens", "tokens"))
    plain = V.query_terms(typed, "item_id", "tokens")
    restored = V.query_terms(variants.withColumn("tokens", F.split("variant", " ")), "query", "tokens")
    found = V.index(docs, "doc_id", "tokens", plain.unionByName(restored))
    return V.top(S.assisted(V.scores(found, plain), V.scores(found, restored)), ["query"], k).select("query", "doc", "score", "rank")


@query("e03_graded_ranking", _QREL + """, c AS (SELECT query, rank, coalesce(grade, 0) AS grade FROM r LEFT JOIN q USING (query, doc) WHERE rank <= 10), n AS (SELECT query, count(*) AS relevant FROM q WHERE grade >= 2 GROUP BY 1)
SELECT query, round((count(*) FILTER (WHERE rank <= 1 AND grade >= 2))::DOUBLE, 6) AS p1, round((count(*) FILTER (WHERE rank <= 5 AND grade >= 2)) / 5, 6) AS p5, CASE WHEN any_value(relevant) > 0 THEN round((count(*) FILTER (WHERE rank <= 5 AND grade >= 2)) / any_value(relevant), 6) END AS r5 FROM c LEFT JOIN n USING (query) GROUP BY 1""")
def graded(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    qrels = asked.join(e.select(F.col("vec_id").alias("doc"), "label"), "label").filter("query <> doc AND doc % 7 <> 3").select("query", "doc", (1 + F.col("doc") % 2).alias("grade")).filter("grade >= 2")
    near = _neighbours(spark, d, 10)
    one, five = (E.metrics_at_k(near, qrels, k).select("query", F.col("precision").alias(f"p{k}"), F.col("recall").alias(f"r{k}")) for k in (1, 5))
    return one.join(five, "query").select("query", "p1", "p5", "r5")


@query("e05_qrels_from_anchors", f"""
WITH a AS (SELECT item_id, ' ' || array_to_string({tok('text')}, ' ') || ' ' AS anchor FROM benchmark WHERE len({tok('text')}) > 1), p AS (SELECT doc_id, ' ' || array_to_string({tok('text')}, ' ') || ' ' AS t FROM documents)
SELECT item_id, doc_id, max(1 + item_id % 3) AS grade FROM a JOIN p ON contains(t, anchor) GROUP BY ALL
""")
def qrels(spark, d):
    held = V.phrase_hits(_docs(spark, d).select(F.col("doc_id").alias("doc"), "tokens"), _items(spark, d).withColumnRenamed("item_id", "query"))
    return held.groupBy(F.col("query").alias("item_id"), F.col("doc").alias("doc_id")).agg(F.max(1 + F.col("query") % 3).alias("grade"))


@query("t03_bag_roots")
def bags(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "CHAPTER").when(F.col("event_type") == "click", "LESSON").otherwise("PAGE")
    inner = F.col("event_id") % 50
    units = e.select(F.floor(F.col("event_id") / 50).alias("version"), F.col("event_id").alias("id"), F.when(inner > 0, F.col("event_id") - inner + F.floor((inner - 1) / 3)).alias("parent"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("value") < 10).alias("empty"))
    return L.bag_roots(units)


@query("c03_bounded_expansion", """
WITH f AS (SELECT DISTINCT l_orderkey AS query, l_suppkey % 50 AS concept FROM lineitem), t AS (SELECT p_partkey % 50 AS concept, p_name AS term, CASE p_size % 4 WHEN 0 THEN 'preferred' WHEN 1 THEN 'synonym' WHEN 2 THEN 'translation' ELSE 'abbreviation' END AS kind, round(0.7 + (p_size % 4) / 10.0, 1)::DOUBLE AS confidence FROM part),
rel AS (SELECT c_nationkey AS src, (c_nationkey * 7 + 3) % 50 AS dst, c_nationkey % 2 = 0 AS bi FROM (SELECT DISTINCT c_nationkey FROM customer)), e AS (SELECT src AS concept, dst AS near FROM rel UNION ALL SELECT dst, src FROM rel WHERE bi),
x AS (SELECT query, near, max(path) AS path FROM (SELECT query, concept AS near, 1.0::DOUBLE AS path FROM f UNION ALL SELECT query, near, 0.35 FROM f JOIN e USING (concept)) GROUP BY ALL),
w AS (SELECT query, near AS concept, term, max(round(path * CASE kind WHEN 'synonym' THEN 0.8 WHEN 'translation' THEN 0.65 WHEN 'abbreviation' THEN 0.7 ELSE 1.0 END::DOUBLE * confidence, 6)) AS weight FROM x JOIN t ON t.concept = near WHERE confidence >= 0.8 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query, concept ORDER BY weight DESC, term) AS p FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, concept, term) AS o FROM p WHERE p <= 12) SELECT query, concept, term, weight FROM o WHERE o <= 64
""")
def expansion(spark, d):
    focus = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 50).alias("concept")).distinct()
    k = F.col("p_size") % 4
    terms = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("concept"), F.col("p_name").alias("term"), F.when(k == 0, "preferred").when(k == 1, "synonym").when(k == 2, "translation").otherwise("abbreviation").alias("kind"), F.round(0.7 + k / 10.0, 1).alias("confidence"))
    nations = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src")).distinct()
    relations = nations.select("src", ((F.col("src") * 7 + 3) % 50).alias("dst"), (F.col("src") % 2 == 0).alias("bidirectional"))
    return L.expand_concepts(focus, terms, relations)
