"""Steps that must not gather, repeat or shuffle what they don't need, told by plans and by small hand-made tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import graphs as G
from quarry.operators import inverted
from quarry.operators import runs
from quarry.operators import retrieval as V
from quarry.operators import search as S
from quarry.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pointers_that_are_done_join_nothing(spark, monkeypatch):
    """rows without pointer met in one task of every round's join."""
    seen, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (seen.append(_plan(df)), cut(df))[1])
    rows = [(1, None, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 6, True), (6, 5, True), (7, 99, True), (8, 2, True)]
    got = G.ancestors_all(spark.createDataFrame(rows, "n int, p int, ok boolean"), "n", "p", G.F.col("ok")).collect()
    assert {(r.n, r.allowed, r.cyclic) for r in got} == {(1, True, False), (2, True, False), (3, False, False), (4, False, False), (5, False, True), (6, False, True), (7, True, False), (8, True, False)}
    assert seen and all("Union" in p and "isnotnull(p" in p for p in seen)


def test_related_items_are_chosen_before_the_shuffle(spark):
    """all offers of all values were shuffled by pair."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(40), kind, rng.randrange(6)) for kind in ("a", "b") for _ in range(90)})
    want = set()
    for i in {r[0] for r in rows}:
        share = {}
        for x, kind, v in rows:
            if x != i and (i, kind, v) in rows:
                share.setdefault(x, set()).add(kind)
        want |= {(i, j, len(share[j]), n + 1) for n, j in enumerate(sorted(share, key=lambda j: (-len(share[j]), j))[:3])}
    found = G.related(spark.createDataFrame(rows, "i int, k string, v int"), "i", "k", "v", ["a", "b"])
    assert {(r.i, r.related, r.kinds, r.place) for r in found.collect()} == want
    assert "dense_rank" in _plan(found)


def test_statements_are_searched_by_all_cores_and_judged_once(spark):
    """a small file was one task's work, and filters judged each phrase again."""
    plan = _plan(registry.queries()["f20_explicit_pairs"](spark, SF))
    assert "Repartition" in plan and plan.count("regexp_extract_all") < 40


@pytest.mark.parametrize("name", ["x19_evidence_rows", "f21_item_snippets"])
def test_best_documents_travel_to_the_texts(spark, name):
    """token lists of the whole corpus were sorted for a join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_contexts_cut_only_lines_of_the_best_documents(spark, monkeypatch):
    """lines and tokens of all documents were written out."""
    from quarry.plans import search as plans

    written, cut = [], plans.cut
    monkeypatch.setattr(plans, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    registry.queries()["x15_context_ranking"](spark, SF)
    lines = next(w for w in written if "line" in w.columns)
    best = registry.queries()["x04_bm25_topk"](spark, SF).filter("rank <= 3").select("doc").distinct()
    assert {r[0] for r in lines.select("doc_id").distinct().collect()} == {r.doc for r in best.collect()}


def test_hints_go_to_mentions_as_one_row(spark):
    """all tokens of all documents met the meanings."""
    docs = spark.createDataFrame([(1, ["a", "x", "q", "x"]), (2, ["a", "y", "x"]), (3, ["b"]), (4, ["a"]), (5, None)], "doc int, t array<string>")
    aliases = spark.createDataFrame([("a", 7, False, "x"), ("a", 8, False, "y"), ("b", 9, False, None)], "alias string, concept int, abbreviation boolean, hint string")
    found = S.concept_mentions(docs, "doc", G.F.col("t"), aliases)
    assert {tuple(r) for r in found.collect()} == {(1, 7, "a", 1), (3, 9, "b", 1)}
    assert "Generate" not in _plan(found)


def test_phrases_grow_where_they_stand(spark):
    """each gram took its passage's tokens along."""
    rng = random.Random(3)
    passages = [(i % 60, [rng.choice("abc") for _ in range(rng.randint(0, 12))]) for i in range(200)] + [(70, None)]
    phrases = [(1, list("ab")), (2, list("abc")), (3, list("abca")), (4, list("bcabc")), (5, ["a"]), (6, [])]
    hit = lambda t, p: any(t[i : i + len(p)] == p for i in range(len(t)))
    want = {(q, d) for q, p in phrases for d, t in passages if len(p) > 1 and hit(t or [], p)}
    found = V.phrase_hits(spark.createDataFrame(passages, "doc int, tokens array<string>"), spark.createDataFrame(phrases, "query int, tokens array<string>"))
    assert {tuple(r) for r in found.collect()} == want and {q for q, _ in want} >= {1, 2, 3}
    assert "whole" not in _plan(found) and hasattr(runs, "phrases_in")


def test_rare_runs_are_shuffled_as_hashes(spark, tmp_path):
    """texts of all runs of frequent words were shuffled."""
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("abcdefghij") for _ in range(30))) for i in range(60)] + [(90, None), (91, "a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, uses = {}, {}
    for i, text in texts:
        w = (text or "").split()
        for n in (2, 3, 4):
            for k in range(len(w) - n + 1):
                p = " ".join(w[k : k + n])
                seen.setdefault(p, set()).add(i)
                uses[p] = uses.get(p, 0) + 1
    found = registry.queries()["c06_phrase_mining"](spark, str(tmp_path)).collect()
    assert {(r.phrase, r.docs, r.uses) for r in found} == {(p, len(d), uses[p]) for p, d in seen.items() if len(d) >= 5}
    # A run that the bit set doesn't let through isn't made as text; here it lets none through.
    from quarry.operators import lexical as L

    column = L.pa.array([t.split() for _, t in texts if t])
    rare = {p for n, _, _, _, shown in L._batch_runs(column, L.np.zeros(1 << (L.RUN_BITS - 3), L.np.uint8), 2, 4) for p in shown()}
    assert not rare


def test_stored_index_tokenises_once_and_hands_on_coded_rows(spark, tmp_path):
    """texts were tokenised for lengths and again for terms, and every posting was shuffled twice."""
    seen = spark.sparkContext.accumulator(0)

    @G.F.udf("array<string>")
    def tokens(text):
        seen.add(1)
        return text.split()

    rng = random.Random(3)
    # Some rows share an identifier; they count as documents of their own unless their lengths are equal, too.
    rows = [(i % 700, " ".join(rng.choices(["a", "b", "c", "d", "e"], [9, 5, 3, 2, 1], k=rng.randint(0, 30)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    index = inverted.InvertedIndex(spark, f"file://{tmp_path}", 4)
    assert index.refresh(docs.withColumn("tokens", tokens("text")), "doc", "text", "tokens") == [0, 1, 2, 3]
    assert seen.value == len(rows)
    assert sum(r.length for r in index.versions().collect()) == sum(len(t.split()) for _, t in rows)
    kept = {(r.term, r.shard): (r.n, r.total) for r in index.blocks().groupBy("term", "shard").agg(G.F.sum("n").alias("n"), G.F.sum("total").alias("total")).collect()}
    for shard in range(4):
        here = [(i, t.split()) for i, t in rows if i % 4 == shard]
        for term in "abcde":
            assert kept[term, shard] == (len({(i, len(t)) for i, t in here if term in t}), sum(t.count(term) for _, t in here))
        assert kept[None, shard] == (len({(i, len(t)) for i, t in here}), sum(len(t) for _, t in here))
    terms = spark.createDataFrame([*enumerate("abcde"), *((9, t) for t in "bde")], "query int, term string")
    mean = sum(len(t.split()) for _, t in rows) / len(rows)
    tf, want = Counter((w, i, len(t.split())) for i, t in rows for w in t.split()), set()
    df = Counter(w for w, _, _ in tf)
    for q, asked in [*enumerate("abcde"), (9, "bde")]:
        score = Counter()
        for (w, i, size), n in tf.items():
            if w in asked:
                score[i] += math.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))
        want |= {(q, i, rank + 1) for rank, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 6), i))[:10])}
    assert {tuple(r) for r in index.top(terms, 10).select("query", "doc", "rank").collect()} == want


def test_stored_index_scores_a_shard_in_few_steps(monkeypatch):
    """each of a shard's stretches looked at all of its blocks, so the work grew with their square."""
    rng = np.random.default_rng(1)
    rows = {}
    for t in range(4):
        doc = np.flatnonzero(rng.random(60_000) < 0.5)
        tf, size = rng.integers(1, 9, len(doc)), 20 + doc % 50
        rows[t] = doc, tf, size
    parts = [inverted._packed(np.array([0]), *r) for r in rows.values()]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([f"t{t}" for t in rows]), *(pa.concat_arrays([p[c] for p in parts]) for c in ("first", "n", "postings"))], names=["shard", "term", "first", "n", "postings"])
    blocks = pa.Table.from_batches(list(inverted._blocks(iter([batch.slice(0, 1), batch.slice(1, 3)]))))
    df = {f"t{t}": len(r[0]) for t, r in rows.items()}
    table = blocks.append_column("df", pa.array([df[t] for t in blocks.column("term").to_pylist()]))
    assert len(table) == sum(-(-n // inverted.BLOCK) for n in df.values())
    steps, decoded = [], inverted._decoded
    monkeypatch.setattr(inverted, "_decoded", lambda raw: (steps.append(len(raw)), decoded(raw))[1])
    docs, scores, opened = inverted._best_of_shard(table, 10, 60_000, 45.0)
    assert len(steps) <= 8 and opened <= len(table)
    total = np.zeros(60_000)
    for t, (doc, tf, size) in rows.items():
        total[doc] += inverted._weight(tf.astype(float), size, np.full(len(doc), np.log1p((60_000 - df[f"t{t}"] + 0.5) / (df[f"t{t}"] + 0.5))), 45.0)
    best = np.lexsort((np.arange(60_000), -np.round(total, 6)))[:10]
    assert docs == best.tolist() and np.allclose(scores, total[best], atol=1e-6)
