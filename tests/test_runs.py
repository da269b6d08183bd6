"""Runs of tokens behind the bit set, and rules that choose before they join."""

import random
from itertools import product

import pytest

from quarry.operators import lexical as L
from quarry.operators import runs
from quarry.plans import registry


@pytest.mark.parametrize("folded", [False, True])
def test_runs_against_plain_loops(spark, folded):
    rng = random.Random(4)
    rows = [(i, [rng.choice(["été", "ete", "mer", "đá", "c"]) for _ in range(rng.randint(0, 9))]) for i in range(300)] + [(900, None)]
    plain = {"été": "ete", "đá": "da"} if folded else {}
    phrases = ["ete mer", "c", "da da c", "ete ete ete"]
    found = runs.runs_in(spark.createDataFrame(rows, "i int, t array<string>"), ["i"], "t", runs.bit_set(spark.createDataFrame([(p,) for p in phrases], "p string"), "p"), 1, 3, folded)
    want = set()
    for i, t in rows:
        for n, at in product((1, 2, 3), range(len(t or []))):
            run = (t or [])[at : at + n]
            gram = " ".join(plain.get(w, w) for w in run)
            if len(run) == n and gram in phrases:
                want.add((i, at + 1, n, gram, " ".join(run)))
    # Five words make 155 runs, so with this many bits nothing else comes through.
    assert {tuple(r) for r in found.collect()} == want and want


def test_expansion_against_plain_loops(spark):
    rng = random.Random(8)
    focus = sorted({(q, rng.randrange(6)) for q in range(40) for _ in range(3)})
    terms = [(c, f"t{rng.randrange(300)}", rng.choice(list(L.KIND_WEIGHTS)), rng.choice([0.7, 0.8, 0.9, 1.0])) for c in range(6) for _ in range(400)]
    relations = [(0, 1, True), (1, 2, False), (4, 3, True)]
    near = [(a, b) for a, b, _ in relations] + [(b, a) for a, b, both in relations if both]
    want = set()
    for q in {q for q, _ in focus}:
        paths = {}
        for c in [c for x, c in focus if x == q]:
            for n, p in [(c, 1.0)] + [(b, L.RELATION_WEIGHT) for a, b in near if a == c]:
                paths[n] = max(paths.get(n, 0), p)
        rows = []
        for n, p in paths.items():
            best = {}
            for c, t, k, s in terms:
                if c == n and s >= 0.8:
                    best[t] = max(best.get(t, 0), round(p * L.KIND_WEIGHTS[k] * s, 6))
            rows += sorted((-w, n, t) for t, w in best.items())[:12]
        want |= {(q, n, t, -w) for w, n, t in sorted(rows)[:64]}
    made = L.expand_concepts(spark.createDataFrame(focus, "query int, concept int"), spark.createDataFrame(terms, "concept int, term string, kind string, confidence double"), spark.createDataFrame(relations, "src int, dst int, bidirectional boolean"))
    assert {(r.query, r.concept, r.term, round(r.weight, 6)) for r in made.collect()} == want
    # No join offers a query all of a concept's terms.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "confidence" not in plan


def test_binary_scores_take_all_pairs(spark, tmp_path):
    spark.createDataFrame([(1, "the sea"), (2, "of stone"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the river")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["f26_binary_score"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.doc_id, r.score) for r in got] == [(7, 1, 0.5)]  # a stop-word is all that they share
