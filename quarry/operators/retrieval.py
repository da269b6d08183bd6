"""Lexical and dense retrieval, rank fusion and evidence selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators.graphs import cut, small
from quarry.operators.runs import bit_set, counted, phrases_in

K1, B = 1.2, 0.75
RRF = 60


def postings(docs: DataFrame, doc: str, tokens: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, len, term, tf). ``wanted`` (term) prunes tokens before they are shuffled."""
    rows = docs.select(F.col(doc).alias("doc"), F.size(tokens).alias("len"), F.explode(tokens).alias("term"))
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, tokens: str) -> DataFrame:
    """One row with the number of documents and their mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size(tokens)), F.lit(1.0)).alias("avg_len"))


def query_terms(queries: DataFrame, query: str, tokens: str) -> DataFrame:
    """(query, term): distinct tokens that are no stop-words."""
    informative = F.array_except(F.array_distinct(tokens), F.array(*(F.lit(w) for w in X.QUERY_STOPWORDS)))
    return queries.select(F.col(query).alias("query"), F.explode(informative).alias("term"))


def index(docs: DataFrame, doc: str, tokens: str, terms: DataFrame, title_tokens: str | None = None) -> DataFrame:
    """(doc, len, term, tf, title_tf) of the wanted ``terms`` (term), and a row without term for each document.

    Texts are tokenised once: all that BM25 asks of the corpus comes from this table, which is written
    out. Tokens are counted where their document lies, and those that are not wanted go no further. A title counts into
    frequency and length like the body.
    """
    wanted = small(terms.select("term").distinct())
    rows = counted(docs, doc, tokens, title_tokens, bit_set(wanted, "term"))
    # A document's own row has a key that no term has, so that such rows don't meet under one where the join has to shuffle.
    rows = rows.withColumn("key", F.coalesce("term", F.concat(F.lit("\0"), F.col("doc").cast("string"))))
    kept = rows.join(wanted.select(F.col("term").alias("key"), F.lit(True).alias("wanted")), "key", "left").filter("wanted OR term IS NULL").drop("key", "wanted")
    # A document's rows lie together, so its scores are summed where they are.
    return cut(kept.repartition("doc").groupBy("doc", "len", "term").agg(F.sum("tf").alias("tf"), F.sum("title_tf").alias("title_tf")))


def frequencies(found: DataFrame) -> DataFrame:
    """(term, df) observed in an index."""
    return found.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(found: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len) observed in an index."""
    return found.filter("term IS NULL").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def checked_statistics(found: DataFrame, stats: DataFrame, df: DataFrame | None = None) -> tuple[int, float]:
    """(n_docs, avg_len) of supplied statistics; ``ValueError`` where they are less than what the index itself shows.

    ``stats`` is one row (n_docs, avg_len), ``df`` (term, df) of the larger corpus.
    """
    given, seen = stats.first(), lengths(found).first()
    if given is None or given.n_docs < seen.n_docs or given.n_docs * given.avg_len < seen.n_docs * seen.avg_len * (1 - 1e-9):
        raise ValueError("supplied corpus statistics are smaller than the indexed documents")
    if df is not None:
        both = frequencies(found).join(df.select("term", F.col("df").alias("given")), "term", "left")
        if not both.filter(F.col("given").isNull() | (F.col("given") < F.col("df"))).isEmpty() or not df.filter((F.col("df") < 0) | (F.col("df") > given.n_docs)).isEmpty():
            raise ValueError("supplied document frequencies don't fit the indexed documents")
    return given.n_docs, given.avg_len


def contribution(tf: Column, df: Column) -> Column:
    """a term's part of BM25, given columns n_docs, len and avg_len."""
    idf = F.log1p((F.col("n_docs") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def parts(found: DataFrame, terms: DataFrame, title_boost: float = 0.0, stats: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(query, doc, part): what each of the ``terms`` (query, term) gives to the documents of an index that hold it.

    Queries' terms get their frequencies first, so what documents hold meets them once and stays where it lies.
    """
    asked = small(terms.select("query", "term").join(df if df is not None else frequencies(found), "term"))
    rows = found.filter("term IS NOT NULL").join(asked, "term").crossJoin(F.broadcast(stats if stats is not None else lengths(found)))  # stats is one row
    return rows.select("query", "doc", contribution(F.col("tf") + title_boost * F.col("title_tf"), F.col("df")).alias("part"))


def scores(found: DataFrame, terms: DataFrame, title_boost: float = 0.0, stats: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, matched) for ``terms`` (query, term) over an index.

    ``stats`` (n_docs, avg_len) and ``df`` (term, df) of a larger corpus replace those observed (X12).
    """
    rows = parts(found, terms, title_boost, stats, df)
    return rows.groupBy("query", "doc").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def bm25(docs: DataFrame, terms: DataFrame, doc: str, tokens: str, title_tokens: str | None = None, title_boost: float = 1.0) -> DataFrame:
    """(query, doc, score, matched) for ``terms`` (query, term); a title counts again by ``title_boost``."""
    return scores(index(docs, doc, tokens, terms, title_tokens), terms, title_boost if title_tokens else 0.0)


def phrase_hits(passages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query, doc) where a passage (doc, tokens) has all of a phrase (query, tokens) in a row.

    Passages stay where they lie: runs that begin as a phrase does grow there until they are one, by bit sets of fixed
    size, and what comes through is compared as a whole. Phrases of one token aren't searched.
    """
    keys = small(phrases.filter(F.size("tokens") > 1).select("query", F.array_join(F.slice("tokens", 1, 3), " ").alias("gram"), F.array_join("tokens", " ").alias("phrase"), F.size("tokens").alias("n")))
    longest = keys.agg(F.max("n")).first()[0] or 0
    held = phrases_in(passages, ["doc"], "tokens", bit_set(keys, "gram"), bit_set(keys, "phrase"), longest).distinct()
    return held.join(keys.select("query", "phrase"), "phrase").select("query", "doc").distinct()


def ranked(scores: DataFrame, by: Sequence[str], score: str = "score", key: str = "doc", rank: str = "rank") -> DataFrame:
    """Ranks from 1, by score descending and key ascending, so no two are equal."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(key))))


def top(scores: DataFrame, by: Sequence[str], k: int, score: str = "score", key: str = "doc") -> DataFrame:
    return ranked(scores, by, score, key).filter(F.col("rank") <= k)


def rrf(branches: DataFrame, query: str = "query", key: str = "doc", branch: str = "branch", weight: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked branches (query, key, branch, rank)."""
    part = (F.col(weight) if weight else F.lit(1.0)) / (F.lit(RRF) + F.col("rank"))
    return branches.groupBy(query, key).agg(F.round(F.sum(part), 9).alias("score"), F.count(F.lit(1)).alias("branches"))


def version_rrf(branches: DataFrame, version: str, query: str = "query", key: str = "doc", branch: str = "branch", weight: str | None = None) -> DataFrame:
    """Each branch keeps its best key per version, versions are ranked and fused.

    The representative is the key of the branch first in name order.
    """
    best = top(branches, [query, branch, version], 1, key=key).drop("rank")
    ranks = ranked(best, [query, branch], key=version)
    part = (F.col(weight) if weight else F.lit(1.0)) / (F.lit(RRF) + F.col("rank"))
    return ranks.groupBy(query, version).agg(F.round(F.sum(part), 9).alias("score"), F.min_by(key, branch).alias("representative"))


def vector_priority(dense: DataFrame, lexical: DataFrame, query: str = "query", key: str = "doc") -> DataFrame:
    """Dense hits in their order, then hits that only the lexical branch has."""
    rest = lexical.join(dense.select(query, key), [query, key], "left_anti").withColumn("side", F.lit(1))
    both = dense.withColumn("side", F.lit(0)).unionByName(rest)
    place = F.row_number().over(Window.partitionBy(query).orderBy("side", F.desc("score"), F.col(key)))
    return both.withColumn("rank", place).withColumn("score", F.round(1 / (F.lit(RRF) + F.col("rank")), 9))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of an Arrow list column's rows, where each begins, and all values; null within is not a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.cumsum(sizes) - sizes, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _directions(ids: np.ndarray, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension, the ids in order and unit vectors of all usable rows."""
    sizes, begins, values = _matrix(column)
    found = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        m = values[begins[rows][:, None] + np.arange(size)]
        norm = np.linalg.norm(m, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        order = np.argsort(ids[rows[good]], kind="stable")
        found[int(size)] = ids[rows[good]][order], (m[good] / norm[good][:, None])[order]
    return found


def _best(asked: dict, known: dict, k: int | None) -> Iterator[pa.RecordBatch]:
    """The ``k`` largest cosines (all, if None) of each query among rows of its dimension."""
    for size, (names, q) in asked.items():
        ids, m = known.get(size, (None, None))
        if ids is None or not len(ids):
            continue
        for at in range(0, len(names), 256):
            near = np.round(np.clip(q[at : at + 256] @ m.T, -1, 1), 6)
            order = np.argsort(-near, axis=1, kind="stable")[:, :k] if k is not None else np.tile(np.arange(len(ids)), (len(near), 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + 256], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(near, order, 1).ravel())], names=["query", "doc", "score"])


def knn(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int | None, block: int = 4096) -> DataFrame:
    """Exact (query, doc, score) of the ``k`` nearest by cosine among the rows of the query's dimension.

    Up to ``block`` queries travel to the rows, which stay where they are; more are dealt out in blocks,
    each of which meets each block of rows once. A matrix product leaves at most ``k`` rows per query,
    and those are ranked. With ``k`` None all products are given as they are, without ranks (J18). Null and zero vectors
    and such with values that aren't finite have no neighbours.
    """
    rows = base.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = queries.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    schema = "query long, doc long, score double"
    first = asked.limit(block + 1).toArrow()  # at most block + 1 rows
    if len(first) <= block:
        wanted = _directions(first.column("k").to_numpy(), first.column("v"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best(wanted, _directions(batch.column(0).to_numpy(), batch.column(1)), k)

        found = rows.mapInArrow(near, schema)
        return found if k is None else top(found, ["query"], k)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        count = F.lit(max(1, -(-df.count() // block)))
        return df.groupBy(F.pmod(F.xxhash64("k"), count).alias(f"{name}_block")).agg(F.collect_list("k").alias(f"{name}_k"), F.collect_list("v").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                known, asked = (_directions(batch.column(c)[i].values.to_numpy(), batch.column(c + 1)[i].values) for c in (0, 2))
                yield from _best(asked, known, k)

    pairs = blocks(rows, "b").crossJoin(blocks(asked, "q")).select("b_k", "b", "q_k", "q")
    found = pairs.mapInArrow(run, schema)
    return found if k is None else top(found, ["query"], k)


def evidence_within(scores: DataFrame, by: Sequence[str], margin: float, k: int, prefer: str) -> DataFrame:
    """Of the top ``k`` within ``margin`` of the best, the row with the largest ``prefer``, then score, then smallest key."""
    near = top(scores, by, k).withColumn("best", F.max("score").over(Window.partitionBy(*by))).filter(F.round(F.col("best") - F.col("score"), 9) <= margin)
    order = Window.partitionBy(*by).orderBy(F.desc(prefer), F.desc("score"), "doc")
    return near.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "best", "rank")


def binary_scores(queries: DataFrame, docs: DataFrame, query: str, doc: str, tokens: str, k: int, all_tokens: bool = False) -> DataFrame:
    """(query, doc, score): each query's ``k`` best documents by |q and d| / sqrt(|q| |d|) over distinct tokens.

    Queries' tokens meet those of documents where these lie, and only the best go further. Pairs that have nothing but
    stop-words in common are scored with ``all_tokens`` alone.
    """
    asked = queries.select(F.col(query).alias("query"), F.array_distinct(tokens).alias("t"))
    wanted = small(asked.select("query", F.size("t").alias("query_size"), F.explode("t").alias("term")))
    once = docs.select(F.col(doc).alias("doc"), F.array_distinct(tokens).alias("t"))
    found = index(once, "doc", "t", wanted).filter("term IS NOT NULL").join(wanted, "term")
    met = found.groupBy("query", "doc", "query_size", "len").agg(F.count(F.lit(1)).alias("both"), F.bool_or(~F.col("term").isin(X.QUERY_STOPWORDS)).alias("informative"))
    met = met if all_tokens else met.filter("informative")
    return top(met.select("query", "doc", F.round(F.col("both") / F.sqrt(F.col("query_size") * F.col("len")), 6).alias("score")), ["query"], k)


def bounded_aggregate(scores: DataFrame, by: Sequence[str], n: int, alpha: float = 0.5, evidence: str | None = None) -> DataFrame:
    """Per group the best score, the mean of its top ``n``, and the best blend with ``evidence``."""
    rows = top(scores, by, n)
    aggs = [F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean")]
    if evidence:
        aggs.append(F.round(F.max(alpha * F.col("score") + (1 - alpha) * F.col(evidence)), 6).alias("blend"))
    return rows.groupBy(*by).agg(*aggs)


def score_gaps(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """The top score and its lead over the second and the fifth; 0 where there is none."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    rows = top(scores, by, 5).groupBy(*by).agg(at(1).alias("top"), at(2).alias("_2"), at(5).alias("_5"))
    return rows.select(*by, "top", F.coalesce(F.round(F.col("top") - F.col("_2"), 6), F.lit(0.0)).alias("gap2"), F.coalesce(F.round(F.col("top") - F.col("_5"), 6), F.lit(0.0)).alias("gap5"))


def _late(names: np.ndarray, keys: np.ndarray, asked: pa.Array, docs: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
    """(query, key, doc, best): for each query vector the largest dot product with each document's vectors of its dimension."""
    sizes, begins, values = _matrix(asked)
    own, starts, numbers = _matrix(vectors)
    code = docs.dictionary_encode()
    group = code.indices.to_numpy()
    for size in np.unique(own[own > 0]):
        mine, theirs = np.flatnonzero(sizes == size), np.flatnonzero(own == size)
        if not len(mine):
            continue
        theirs = theirs[np.argsort(group[theirs], kind="stable")]
        heads = np.flatnonzero(np.diff(group[theirs], prepend=-1))
        matrix = numbers[starts[theirs][:, None] + np.arange(size)].T
        for at in range(0, len(mine), 256):
            part = mine[at : at + 256]
            best = np.maximum.reduceat(values[begins[part][:, None] + np.arange(size)] @ matrix, heads, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[part], len(heads))), pa.array(np.repeat(keys[part], len(heads))), code.dictionary.take(pa.array(np.tile(group[theirs][heads], len(part)))), pa.array(best.ravel())], names=["query", "key", "doc", "best"])


def max_sim(queries: DataFrame, base: DataFrame, query: str, doc: str, key: str, vector: str, block: int = 4096) -> DataFrame:
    """(query, doc, score): the mean over a query's token vectors of the best dot product with the document's.

    Up to ``block`` token vectors (query, key, vector) travel to the rows of ``base`` (doc, vector), which stay
    where they are; more are dealt out in blocks, each of which meets each block of rows once. Either way
    one row for each query vector and document of a batch is left, and those are reduced.
    """
    asked = queries.select(F.col(query).alias("q"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    rows = base.select(F.col(doc).alias("d"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    schema = f"query long, key long, doc {base.schema[doc].dataType.simpleString()}, best double"
    first = asked.limit(block + 1).toArrow()  # at most block + 1 rows
    if len(first) <= block:
        names, keys, wanted = first.column("q").to_numpy(), first.column("k").to_numpy(), first.column("v")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _late(names, keys, wanted, batch.column(0), batch.column(1))

        found = rows.mapInArrow(near, schema)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    q, k, v, d, w = (batch.column(c)[i].values for c in range(5))
                    yield from _late(q.to_numpy(), k.to_numpy(), v, d, w)

        parts = F.lit(max(1, -(-asked.count() // block)))
        of_queries = asked.groupBy(F.pmod(F.xxhash64("q", "k"), parts).alias("b")).agg(*(F.collect_list(c).alias(c) for c in ("q", "k", "v"))).select("q", "k", "v")
        many = F.lit(max(1, -(-rows.count() // block)))
        # Rows are dealt by a hash of document and vector, so a document of many vectors is in several blocks.
        of_rows = rows.groupBy(F.pmod(F.xxhash64("d", "v"), many).alias("b")).agg(F.collect_list("d").alias("d"), F.collect_list("v").alias("w")).select("d", "w")
        found = of_queries.crossJoin(of_rows).mapInArrow(run, schema)
    best = found.groupBy("query", "key", "doc").agg(F.max("best").alias("best"))
    return best.groupBy("query", "doc").agg(F.round(F.avg("best"), 6).alias("score"))


def linked(m: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy complete-link clusters of the rows of ``m``, taken in order."""
    norm = np.linalg.norm(m, axis=1)
    m = m / np.where(norm > 0, norm, 1)[:, None]
    found, count = np.zeros(len(m), np.int32), 0
    for i in range(len(m)):
        # What each cluster's least similar member has in common with this one.
        near = np.full(count, np.inf)
        np.minimum.at(near, found[:i], m[:i] @ m[i])
        best = int(np.argmax(near)) if count else -1
        if best < 0 or near[best] < threshold:
            best, count = count, count + 1
        found[i] = best
    return found


def complete_link(members: DataFrame, group: str, order: str, vector: str, threshold: float = 0.8) -> DataFrame:
    """Greedy complete-link clusters of each group's members, taken in order.

    A member joins the cluster whose least similar member is most similar to it, if that is
    ``threshold`` or more (the first of equal ones), else it opens one. The order makes it sequential,
    so a group, the spans of one document, is one task's work.
    """
    fields = members.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        m = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        found = linked(m, threshold)
        return pa.table({group: table.column(group), order: table.column(order), "cluster": pa.array(found, pa.int32())})

    kinds = {f.name: f.dataType.simpleString() for f in fields}
    return members.select(group, order, vector).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cluster int")
