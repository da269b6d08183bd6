"""Rules on top of BM25, bags and expansion on hand-made rows."""

from quarry.functions import text as X
from quarry.operators import evaluation, graphs, retrieval
from quarry.operators import lexical as L
from pyspark.sql import functions as F


def test_reduced_period():
    assert L.reduced_period("a b a b".split()) == ["a", "b"] and L.reduced_period("a b a".split()) == ["a", "b", "a"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox fox"), (2, "red hen"), (3, None)], "id long, text string").withColumn("t", X.surface_tokens(F.col("text")))
    queries = spark.createDataFrame([(9, ["fox", "the"])], "q long, t array<string>")
    row = retrieval.bm25(docs, retrieval.query_terms(queries, "q", "t"), "id", "t").collect()
    import math

    want = math.log1p((3 - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3)))
    assert [(r.query, r.doc, r.score) for r in row] == [(9, 1, round(want, 6))]


def test_bag_roots(spark):
    rows = [
        (1, 1, None, 1, "CHAPTER", False), (1, 2, 1, 2, "LESSON", False), (1, 3, 2, 3, "PAGE", False), (1, 4, 2, 4, "PAGE", True), (1, 5, None, 5, "PAGE", False), (1, 6, None, 6, "UNIT", True), (1, 7, 6, 7, "LESSON", True), (1, 8, 7, 8, "PAGE", False), (1, 9, 6, 9, "PAGE", False),
    ]
    got = L.bag_roots(spark.createDataFrame(rows, "version int, id int, parent int, seq int, kind string, empty boolean")).collect()
    assert {(r.root, r.member) for r in got} == {(1, 3), (5, 5), (7, 8), (9, 9)}


def test_complete_link_does_not_chain(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.436]), (1, 3, [0.62, 0.785])]
    got = retrieval.complete_link(spark.createDataFrame(rows, "g int, o int, v array<double>"), "g", "o", "v", 0.8).collect()
    assert [r.cluster for r in sorted(got, key=lambda r: r.o)] == [0, 0, 1]


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query int, doc int, rank int")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 99, 1)], "query int, doc int, grade int")
    got = {r.query: r for r in evaluation.metrics_at_k(ranking, qrels, 3).collect()}
    import math

    ideal = 3 + 1 / math.log2(3)
    assert (got[1].precision, got[1].recall, got[1].mrr) == (0.333333, 0.5, 0.5) and got[1].ndcg == round(3 / math.log2(3) / ideal, 6)
    assert got[2].precision == 0 and got[2].recall is None and got[2].mrr is None and got[2].ndcg is None


def test_percentile_interpolates(spark):
    row = evaluation.distribution(spark.createDataFrame([("a", 10.0), ("a", 30.0)], "g string, v double"), "g", "v").first()
    assert (row.p50, row.p95) == (20.0, 29.0)


def test_ancestors_and_cycles(spark):
    rows = [(1, None, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 6, True), (6, 5, True), (7, 6, True), (8, 77, True)]
    got = {r.n: (r.allowed, r.cyclic) for r in graphs.ancestors_all(spark.createDataFrame(rows, "n int, p int, ok boolean"), "n", "p", F.col("ok")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, True), 6: (False, True), 7: (False, True), 8: (True, False)}
