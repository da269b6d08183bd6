"""Queries of concept search, context ranking, admission, meanings and hybrid fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import coded as C
from quarry.operators import placed as P
from quarry.operators import retrieval as V
from quarry.operators import search as S
from quarry.operators.graphs import alias_mentions, cut, small
from quarry.plans.graphs import _ALIASES, _aliases
from quarry.plans.retrieval import _KNN, _PLAIN, _STOP, _docs, _items, _lines, _neighbours, tok
from quarry.session import spread, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Mentions of the benchmark's aliases: leftmost first, longest first, as a regular expression's alternatives give them.
_FOUND = f"""al AS {_ALIASES}, pt AS (SELECT ' (' || string_agg(regexp_replace(replace(alias, ' ', '  '), '([+.#])', '[\\\\1]', 'g'), '|' ORDER BY -len(string_split(alias, ' ')), alias) || ') ' AS pattern FROM al),
mn AS (SELECT doc_id AS doc, alias, count(*) AS n FROM (SELECT doc_id, replace(trim(unnest(regexp_extract_all(' ' || array_to_string({tok('text')}, '  ') || ' ', pattern))), '  ', ' ') AS alias FROM documents, pt) GROUP BY ALL)"""

#: What an alias may mean: all items that begin with it; every seventh item is an abbreviation; an item's fifth token is its hint.
_SENSES = f"(SELECT DISTINCT alias, concept, concept % 7 = 0 AS abbreviation, hint FROM (SELECT item_id AS concept, t[5] AS hint, unnest([array_to_string(t[1:n], ' ') FOR n IN [1, 2, 3] IF len(t) >= n]) AS alias FROM (SELECT item_id, {tok('text')} AS t FROM benchmark)))"


def _senses(spark, d):
    t = _items(spark, d)
    made = t.select(F.col("item_id").alias("concept"), (F.col("item_id") % 7 == 0).alias("abbreviation"), F.try_element_at("tokens", F.lit(5)).alias("hint"), F.explode(F.array(*(F.when(F.size("tokens") >= n, F.array_join(F.slice("tokens", 1, n), " ")) for n in (1, 2, 3)))).alias("alias"))
    return made.filter("alias IS NOT NULL").distinct()


@query("c05_safe_mentions", f"""
WITH {_FOUND}, se AS {_SENSES}, db AS (SELECT alias, count(DISTINCT concept) > 1 OR bool_or(abbreviation) AS doubtful, min(concept) AS sole FROM se GROUP BY 1),
h AS (SELECT doc_id AS doc, unnest(list_distinct({tok('text')})) AS hint FROM documents), ch AS (SELECT doc, alias, list_distinct(list(concept)) AS c, max(n) AS n FROM mn JOIN db USING (alias) JOIN se USING (alias) JOIN h USING (doc, hint) WHERE doubtful GROUP BY ALL)
SELECT doc, sole AS concept, alias, n FROM mn JOIN db USING (alias) WHERE NOT doubtful UNION ALL SELECT doc, c[1], alias, n FROM ch WHERE len(c) = 1
""")
def safe_mentions(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("doc"), "tokens")
    return S.concept_mentions(docs, "doc", F.col("tokens"), _senses(spark, d)).select("doc", "concept", "alias", "n")


#: The concepts that items name, and the terms left beside them.
_NAMED = f"""nm AS (SELECT DISTINCT query, concept, alias FROM (SELECT item_id AS query, replace(trim(unnest(regexp_extract_all(' ' || array_to_string({tok('text')}, '  ') || ' ', pattern))), '  ', ' ') AS alias FROM benchmark, pt) JOIN al USING (alias)),
np AS (SELECT query, list_distinct(flatten(list(string_split(alias, ' ')))) AS parts FROM nm GROUP BY 1)"""
_GROUPED = f"""
WITH d AS (SELECT doc_id, {tok('text')} AS t FROM documents), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
{_FOUND}, {_NAMED}, q AS (SELECT query, unnest(list_filter(w, lambda x: NOT list_contains(coalesce(parts, []), x))) AS term FROM (SELECT item_id AS query, list_filter(list_distinct({tok('text')}), lambda x: NOT list_contains({_STOP}, x)) AS w FROM benchmark) LEFT JOIN np USING (query)),
p AS (SELECT query, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score, count(*) AS matched FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
gr AS (SELECT DISTINCT nm.query, concept, al.alias, CASE WHEN contains(al.alias, ' ') THEN 1.0 ELSE 0.8 END::DOUBLE AS weight FROM nm JOIN al USING (concept)), me AS (SELECT query, gr.concept, weight, doc, mn.n AS f FROM mn JOIN gr USING (alias)),
cd AS (SELECT query, concept, count(DISTINCT doc) AS df FROM me GROUP BY ALL), pa AS (SELECT query, doc, concept, max(weight * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / a))) AS part FROM me JOIN cd USING (query, concept) JOIN d ON doc_id = doc CROSS JOIN st GROUP BY ALL),
ps AS (SELECT query, doc, sum(part) AS parts, count(*) AS concepts FROM pa GROUP BY ALL), al2 AS (SELECT query, doc, round(coalesce(score, 0) + coalesce(parts, 0), 6) AS score, coalesce(matched, 0) + coalesce(concepts, 0) AS matched FROM p FULL JOIN ps USING (query, doc))
"""


def _grouped(spark, d, focused: bool):
    docs, items = _docs(spark, d), _items(spark, d)
    aliases = cut(_aliases(spark, d))
    named = cut(S.recognised(items, "item_id", F.col("tokens"), aliases))
    terms = cut(S.without_constituents(V.query_terms(items, "item_id", "tokens"), named))
    groups = named.select("query", "concept").distinct().join(aliases, "concept").select("query", "concept", "alias", F.when(F.contains("alias", F.lit(" ")), 1.0).otherwise(0.8).alias("weight"))
    focus = groups.filter("query % 2 = 0").select("query", "concept").distinct() if focused else None
    return S.grouped_scores(docs, "doc_id", "tokens", terms, groups, aliases, focus)


@query("x10_concept_groups", _GROUPED + "SELECT query, doc, score, matched FROM al2")
def concept_groups(spark, d):
    return _grouped(spark, d, False)


@query("x11_focus_rule", _GROUPED + "SELECT query, doc, score, matched FROM al2 WHERE query % 2 <> 0 OR query NOT IN (SELECT query FROM gr) OR EXISTS (SELECT 1 FROM me WHERE me.query = al2.query AND me.doc = al2.doc)")
def focus_rule(spark, d):
    return _grouped(spark, d, True)


@query("x12_supplied_statistics", _PLAIN + """, big AS (SELECT term, df + 5 AS df FROM df), s2 AS (SELECT item_id AS query, tf.doc_id AS doc, round(sum(ln(1 + (2 * n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (1.5 * a)))), 6) AS score FROM q JOIN tf USING (term) JOIN big USING (term) CROSS JOIN st GROUP BY 1, 2)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s2) WHERE rank <= 10""")
def supplied(spark, d):
    terms = V.query_terms(_items(spark, d), "item_id", "tokens")
    found = V.index(_docs(spark, d), "doc_id", "tokens", terms)
    stats = V.lengths(found).select((2 * F.col("n_docs")).alias("n_docs"), (1.5 * F.col("avg_len")).alias("avg_len"))
    df = V.frequencies(found).withColumn("df", F.col("df") + 5)
    V.checked_statistics(found, stats, df)
    return V.top(V.scores(found, terms, stats=stats, df=df), ["query"], 10).select("query", "doc", "score", "rank")


@query("snk20_corpus_export", f"""
WITH d AS (SELECT doc_id, {tok('text')} AS t FROM documents), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM d) GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS docs, (SELECT sum(len(t)) FROM d)::BIGINT AS total_length, count(*) AS terms, sum(df)::BIGINT AS postings, bit_xor(('0x' || substr(md5(term || ':' || df), 1, 12))::BIGINT) AS checksum FROM df
""")
def corpus_export(spark, d):
    docs = _docs(spark, d).select("doc_id", "tokens")
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "term", F.col("df").cast("string"))), 1, 12), 16, 10).cast("long")
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("total_length"))
    return sizes.crossJoin(df.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.bit_xor(digest).alias("checksum")))  # one row each


_CHUNKS = f"(SELECT doc_id, i - 1 AS seq, line, {tok('line')} AS t FROM (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)))"


@query("x22_chunk_search", f"""
WITH c AS {_CHUNKS}, tf AS (SELECT doc_id, seq, len, term, count(*) AS tf FROM (SELECT doc_id, seq, len(t) AS len, unnest(t) AS term FROM c) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM c),
q AS (SELECT item_id AS query, unnest(list_filter(list_distinct({tok('text')}), lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark),
s AS (SELECT query, doc_id AS version, seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query, version ORDER BY score DESC, seq) AS k FROM s), t AS (SELECT query, version, seq::INT AS line, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, version) AS rank, count(*) OVER (PARTITION BY query) AS total FROM b WHERE k = 1)
SELECT * FROM t WHERE rank <= 10
""")
def chunk_search(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("tokens", C.line_tokens(F.col("text")))
    return S.chunk_search(docs, "doc_id", "tokens", V.query_terms(_items(spark, d), "item_id", "tokens"), 10)


#: Each item's best documents, how the lines of those compare, and the best line of each.
_CONTEXTS = f""", {_FOUND}, {_NAMED}, c AS {_CHUNKS}, iq AS (SELECT item_id AS query, {tok('text')} AS q FROM benchmark),
x AS (SELECT query, doc, seq, line, t, len(t) AS length, contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') AS exact, list_filter(list_distinct(q), lambda w: NOT list_contains({_STOP}, w) AND list_contains(t, w)) AS hit FROM best JOIN iq USING (query) JOIN c ON c.doc_id = doc),
lm AS (SELECT DISTINCT doc, seq, concept FROM (SELECT doc, seq, replace(trim(unnest(regexp_extract_all(' ' || array_to_string(t, '  ') || ' ', pattern))), '  ', ' ') AS alias FROM (SELECT DISTINCT doc, seq, t FROM x), pt) JOIN al USING (alias)),
ev AS (SELECT query, doc, seq, count(DISTINCT concept) AS concepts FROM lm JOIN nm USING (concept) SEMI JOIN best USING (query, doc) GROUP BY ALL),
sz AS (SELECT query, doc, count(*) AS n FROM x GROUP BY ALL), te AS (SELECT query, doc, seq, unnest(hit) AS term FROM x), tdf AS (SELECT query, doc, term, count(*) AS df FROM te GROUP BY ALL),
cv AS (SELECT query, doc, seq, round(sum(ln(1 + (n + 1) / (df + 1))), 9) AS coverage FROM te JOIN tdf USING (query, doc, term) JOIN sz USING (query, doc) GROUP BY ALL),
o AS (SELECT query, doc, seq, line, exact, coalesce(concepts, 0) AS concepts, coalesce(coverage, 0) AS coverage, round(len(hit) / greatest(length, 1), 9) AS density FROM x LEFT JOIN cv USING (query, doc, seq) LEFT JOIN ev USING (query, doc, seq)),
z AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY exact DESC, concepts DESC, coverage DESC, density DESC, seq) AS k FROM o)
"""


def _contexts(spark, d, k):
    """The best line of each item's ``k`` best documents, with the concepts that items and lines share as evidence."""
    items = _items(spark, d)
    best = V.top(V.bm25(_docs(spark, d), V.query_terms(items, "item_id", "tokens"), "doc_id", "tokens"), ["query"], k)
    asked = small(best.select("query", F.col("doc").alias("doc_id")))
    # The few best documents travel to the texts; only their lines are cut and written out.
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).join(small(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    chunks = cut(lines.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line")).withColumn("tokens", X.surface_tokens(F.col("line"))))
    aliases = cut(_aliases(spark, d))
    named = S.recognised(items, "item_id", F.col("tokens"), aliases).select("query", "concept").distinct()
    mine = chunks.select(F.struct("doc_id", "seq").alias("chunk"), "tokens")
    held = alias_mentions(mine, "chunk", F.col("tokens"), aliases).select("chunk.doc_id", "chunk.seq", "concept").distinct()
    evidence = held.join(asked, "doc_id").join(named, ["query", "concept"]).groupBy("query", "doc_id", "seq").agg(F.count(F.lit(1)).alias("concepts"))
    return S.rank_contexts(chunks, asked.join(items.withColumnRenamed("item_id", "query"), "query"), "doc_id", "seq", "tokens", evidence), chunks


@query("x15_context_ranking", _PLAIN + ", best AS (SELECT query, doc FROM r WHERE rank <= 3)" + _CONTEXTS + "SELECT query, doc AS doc_id, seq::INT AS seq, exact::INT AS exact, concepts, coverage, density FROM z WHERE k = 1")
def context_ranking(spark, d):
    return _contexts(spark, d, 3)[0]


@query("m33_root_snippets", _PLAIN + ", best AS (SELECT query, doc FROM r WHERE rank = 1)" + _CONTEXTS + "SELECT query, doc AS doc_id, seq::INT AS seq, substr(trim(line), 1, 400) AS snippet, concepts, coverage FROM z WHERE k = 1")
def root_snippets(spark, d):
    """The line of each item's best document that explains the hit, cut to 400 characters."""
    best, chunks = _contexts(spark, d, 1)
    return best.join(chunks.select("doc_id", "seq", "line"), ["doc_id", "seq"]).select("query", "doc_id", "seq", F.substring(F.trim("line"), 1, 400).alias("snippet"), "concepts", "coverage")


_TOKENS = r"'(?i)c\+\+|c#|\.net\b|\p{Nd}+(?:\.\p{Nd}+)+|[\p{L}\p{N}]+'"


@query("f21_item_snippets", _PLAIN + rf""", best AS (SELECT query, doc FROM r WHERE rank = 1),
x AS (SELECT query, d.text, regexp_extract_all(d.text, {_TOKENS}) AS raw, regexp_split_to_array(d.text, {_TOKENS}) AS gap, {tok('b.text')} AS p FROM best JOIN documents d ON d.doc_id = doc JOIN benchmark b ON b.item_id = query),
w AS (SELECT query, i, replace(lower(raw[i]), 'ß', 'ss') AS w, sum(length(gap[i]) + coalesce(length(raw[i - 1]), 0)) OVER (PARTITION BY query ORDER BY i) AS place FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM x)),
h AS (SELECT query, term, i, place + instr(w, term) - 1 AS place FROM w JOIN q ON item_id = query AND (w = term OR list_contains(regexp_extract_all(w, '\p{{L}}+'), term))),
c AS (SELECT query, arg_min(place, i) AS place, count(*) AS n, min(i) AS i, term FROM h GROUP BY query, term), k AS (SELECT query, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n, i, place) AS k FROM c) WHERE k = 1),
l AS (SELECT query, list(w ORDER BY i) AS l FROM w GROUP BY 1), e AS (SELECT query, min(i) AS i FROM (SELECT query, p, l, unnest(range(1, len(l) - len(p) + 2)) AS i FROM x JOIN l USING (query) WHERE len(p) > 1) WHERE l[i:i + len(p) - 1] = p GROUP BY 1)
SELECT x.query, e.i IS NOT NULL AS whole, substr(text, greatest(coalesce(w.place, k.place, 0) - 100, 0)::BIGINT + 1, 400) AS snippet FROM x LEFT JOIN e USING (query) LEFT JOIN w ON w.query = x.query AND w.i = e.i LEFT JOIN k ON k.query = x.query""")
def item_snippets(spark, d):
    """For each item, its best document around the item's whole text if it is there (``whole``), else around the rarest of its terms that is."""
    docs = _docs(spark, d)
    items = _items(spark, d)
    best = V.top(V.bm25(docs, V.query_terms(items, "item_id", "tokens"), "doc_id", "tokens"), ["query"], 1).select("query", F.col("doc").alias("doc_id"))
    # The few best documents travel to the texts, which stay where they lie; snippets are cut by as many tasks as there are cores.
    few = small(best.join(items.withColumnsRenamed({"item_id": "query", "tokens": "phrase"}), "query"))
    found = cut(table(spark, d, "documents").select("doc_id", "text").join(few, "doc_id"))
    asked = found.repartition(spark.sparkContext.defaultParallelism, "query").withColumn("tokens", X.surface_tokens(F.col("text")))
    terms = F.array_except(F.array_distinct("phrase"), F.array(*(F.lit(w) for w in X.QUERY_STOPWORDS)))
    whole = X.contains_phrase(F.col("tokens"), F.col("phrase")) & (F.size("phrase") > 1)
    return asked.select("query", whole.alias("whole"), X.hit_snippet(F.col("text"), terms, F.col("phrase")).alias("snippet"))


#: Documents of the stated query set ask by their first line, and by their vector where they have one.
_TITLES = "(SELECT doc_id AS query, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents WHERE doc_id % 100 = 0)"


def _titles(spark, d):
    return table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("text"))


def _dense(spark, d, k=50):
    return _neighbours(spark, d, k).select("query", "doc", "score")


@query("d07_anchored_admission")
def anchored(spark, d):
    """Nearest vectors whose document holds an anchor of the asking document's first line."""
    texts = _docs(spark, d).select(F.col("doc_id").alias("doc"), "tokens")
    return S.admitted(_dense(spark, d), _titles(spark, d), texts, 0.1)


@query("d20_metadata_dense")
def metadata_dense(spark, d):
    """Hits above the floor, and weaker ones that an anchor of the query supports."""
    hits = cut(_dense(spark, d))
    weak = S.admitted(hits.filter("score < 0.25"), _titles(spark, d), _docs(spark, d).select(F.col("doc_id").alias("doc"), "tokens"), 0.1)
    return hits.filter("score >= 0.25").unionByName(weak.select("query", "doc", "score"))


@query("d11_meaning_groups")
def meaning_groups(spark, d):
    """Equal vectors of a bag are clustered once; a group's id is the digest of its members."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id DIV 32").alias("bag"), "vec_id", "embedding")
    once = e.groupBy("bag", "embedding").agg(F.min("vec_id").alias("vec_id"))
    grouped = V.complete_link(once, "bag", "vec_id", "embedding", 0.3)
    rows = e.join(once.withColumnRenamed("vec_id", "first"), ["bag", "embedding"]).join(grouped.withColumnRenamed("vec_id", "first"), ["bag", "first"])
    listed = rows.groupBy("bag", "cluster").agg(F.array_sort(F.collect_list("vec_id")).alias("m"))  # a bag holds 32 vectors
    return listed.select("bag", "cluster", F.size("m").alias("members"), F.substring(F.sha2(F.array_join(F.transform("m", lambda x: x.cast("string")), ","), 256), 1, 24).alias("group_id"))


@query("d12_meaning_match", _KNN + """, m AS (SELECT query, label AS bag, doc AS member, score FROM r WHERE rank <= 20), x AS (SELECT *, max(score) OVER (PARTITION BY query, bag) AS best FROM m),
n AS (SELECT *, CASE WHEN member % 3 = 0 THEN member % 5 // 4 ELSE 0 END AS exact, CASE WHEN member % 3 = 0 THEN member % 13 ELSE 0 END AS coverage FROM x WHERE round(best - score, 9) <= 0.08)
SELECT query, bag, best AS score, member FROM (SELECT *, row_number() OVER (PARTITION BY query, bag ORDER BY exact DESC, coverage DESC, score DESC, member) AS k FROM n) WHERE k = 1
""")
def meaning_match(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("bag"))
    scores = cut(_neighbours(spark, d).join(labels, "doc").select("query", "bag", F.col("doc").alias("member"), "score"))
    support = scores.filter("member % 3 = 0").select("query", "member", F.expr("member % 5 DIV 4").cast("int").alias("exact"), (F.col("member") % 13).cast("double").alias("coverage"), F.lit(0.0).alias("density")).distinct()
    return S.match_meanings(scores, support)


_PLAINLY = "replace(strip_accents({}), 'đ', 'd')"


@query("d19_hybrid_search", f"""
WITH d AS (SELECT doc_id, {tok('text')} AS t FROM documents), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
ti AS {_TITLES}, q AS (SELECT query, unnest(list_filter(list_distinct({tok(_PLAINLY.format('title'))}), lambda w: NOT list_contains({_STOP}, w))) AS term FROM ti),
sp AS (SELECT DISTINCT query, df.term FROM (SELECT query, {_PLAINLY.format('term')} AS key FROM q) k JOIN df ON {_PLAINLY.format('df.term')} = key UNION SELECT query, term FROM q),
sc AS (SELECT w, query, tf.doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM (SELECT 1.0::DOUBLE AS w, * FROM q UNION ALL SELECT 0.8::DOUBLE, * FROM sp) JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
lx AS (SELECT query, doc, max(round(w * score, 6)) AS score FROM sc GROUP BY ALL), e AS ({_KNN} SELECT query, doc, score FROM r WHERE rank <= 50),
b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM lx UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) FROM e), u AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS branches FROM b GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM u) WHERE rank <= 10""")
def hybrid_search(spark, d):
    """First lines typed without accents, a variant with all spellings of the corpus, and vectors."""
    docs = _docs(spark, d)
    typed = _titles(spark, d).select("query", X.surface_tokens(X.fold(F.col("text"))).alias("tokens"))
    terms = cut(V.query_terms(typed, "query", "tokens"))
    spelled = cut(S.spelled_alike(terms, P.vocabulary(docs, "tokens")))
    lexical = P.Branch(docs, "doc_id", "tokens", terms, spelled, S.VARIANT_WEIGHT)
    return P.fused([lexical], [_neighbours(spark, d, 50).select("query", "doc", "rank")], 10)


#: Sentences of every form, some negated, with terms of ``part`` and accents where p_size is odd.
_STATED = """chr(10) || 'The note; ' || p_name || ' (' || p_type || '). ' || CASE WHEN p_partkey % 3 = 0 THEN 'it is not true that ' ELSE '' END || p_name || ' means ' || p_brand || ';' || p_type || ' also called ' || p_brand || chr(10)
  || 'en: ' || p_name || ' | fr: ' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' | fr: twice' WHEN p_partkey % 5 = 1 THEN ' | vi: ' || p_brand ELSE '' END || chr(10) || CASE WHEN p_size % 2 = 1 THEN 'é' ELSE 'e' END || p_name || ' unaccented form is e' || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END || p_name"""


def _safe(column: str) -> str:
    t = f"trim({column})"
    words = tok(t)
    return f"""CASE WHEN length({t}) BETWEEN 2 AND 120 AND len({words}) BETWEEN 1 AND 6 AND regexp_matches({t}, '\\p{{L}}') AND NOT regexp_matches({t}, '{X.FORBIDDEN}') AND length(regexp_replace({t}, '\\P{{Nd}}', '', 'g')) <= greatest(2, length({t}) // 4)
  AND len(list_filter({words}, lambda w: NOT list_contains({_STOP}, w))) > 0 AND len(list_distinct({words})) >= greatest(1, len({words}) // 2) THEN regexp_replace(lower({t}), '\\s+', ' ', 'g') END"""


def _groups(pattern: str) -> str:
    parts = ", ".join(f"regexp_extract_all(x, '{pattern}', {i})" for i in range(3))
    return f"unnest(list_zip({parts}))"


@query("f20_explicit_pairs", f"""
WITH t AS (SELECT p_partkey, {_STATED} AS x FROM part), f AS ({" UNION ALL ".join(f"SELECT p_partkey, '{form}' AS form, p[1] AS whole, p[2] AS a, p[3] AS b FROM (SELECT p_partkey, {_groups(rx)} AS p FROM t)" for form, rx in S.STATED.items())}),
l AS (SELECT p_partkey, whole, list_sort(list_zip(list_transform(regexp_extract_all(whole, '{S.LABELLED}', 1), lambda v: lower(v)), regexp_extract_all(whole, '{S.LABELLED}', 2))) AS m FROM (SELECT p_partkey, unnest(string_split(x, chr(10))) AS whole FROM t)),
g AS (SELECT p_partkey, whole, m, unnest(range(1, len(m) + 1)) AS i FROM l WHERE len(m) BETWEEN 2 AND 3 AND len(list_distinct(list_transform(m, lambda v: v[1]))) = len(m)), h AS (SELECT *, unnest(range(i + 1, len(m) + 1)) AS j FROM g),
u AS (SELECT * FROM f UNION ALL SELECT p_partkey, 'labelled', whole, m[i][2], m[j][2] FROM h), s AS (SELECT p_partkey, form, {_safe('a')} AS term, {_safe('b')} AS other FROM u WHERE NOT regexp_matches(whole, '{S.NEGATED}') AND NOT regexp_matches(whole, '{X.FORBIDDEN}'))
SELECT DISTINCT * FROM s WHERE term <> other AND (form <> 'spelling' OR (NOT regexp_matches(other, '[^\x00-\x7F]') AND regexp_matches(term, '[^\x00-\x7F]') AND strip_accents(term) = other))
""")
def stated_pairs(spark, d):
    return S.stated_pairs(spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")).select("p_partkey", F.expr(_STATED.replace("chr(10)", "'\\n'")).alias("x")), "p_partkey", "x")
