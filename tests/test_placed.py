"""The best of fused rankings, which aren't made as a whole, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import coded, runs
from quarry.operators import placed as P


def _ranking(docs, terms, variants, weight):
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))

    def scores(words):
        found = {}
        for d, t in docs:
            hits = [(df[w], t.count(w)) for w in words if w in t]
            if hits:
                found[d] = round(sum(math.log1p((n - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) for f, tf in hits), 6)
        return found

    own, wide = scores(terms), {d: round(weight * s, 6) for d, s in scores(variants).items()}
    both = {d: max(own.get(d, 0), wide.get(d, 0)) for d in own | wide}
    return {d: i + 1 for i, d in enumerate(sorted(both, key=lambda d: (-both[d], d)))}


@pytest.mark.parametrize("kept", [False, True])
def test_fused_against_plain_loops(spark, monkeypatch, kept):
    rng = random.Random(6)
    docs = [(i, [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 2))]) for i in range(400)]
    asked = {q: sorted({rng.choice("abcdefgh") for _ in range(3)}) for q in range(5)}
    spelled = {q: w + [2 * x for x in w[:1]] for q, w in asked.items()}
    given = {q: rng.sample(range(450), 20) for q in asked}
    want = set()
    for q, w in asked.items():
        body = _ranking([(d, b) for d, b, _ in docs], w, spelled[q], 0.8)
        title = _ranking([(d, t) for d, _, t in docs], w, [], 0.8)
        lists = [body, title, {d: i + 1 for i, d in enumerate(given[q])}]
        score = {d: round(sum(1 / (60 + x[d]) for x in lists if d in x), 9) for d in set().union(*lists)}
        want |= {(q, d, score[d], i + 1) for i, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:2])}
    frame = lambda rows: spark.createDataFrame([(q, w) for q, ws in rows.items() for w in ws], "query int, term string")
    table = spark.createDataFrame(docs, "doc long, body array<string>, title array<string>").repartition(3)
    sizes = {}
    if kept:
        known = runs.bit_set(frame(spelled).select("term").distinct(), "term")
        table, sizes = runs.kept(table, "doc", ["body", "title"], known), {"body": "body_size", "title": "title_size"}
    monkeypatch.setattr(P, "BLOCK", 8)  # several blocks of queries
    branches = [P.Branch(table, "doc", "body", frame(asked), frame(spelled), size=sizes.get("body")), P.Branch(table, "doc", "title", frame(asked), size=sizes.get("title"))]
    dense = spark.createDataFrame([(q, d, i + 1) for q, ds in given.items() for i, d in enumerate(ds)], "query int, doc int, rank int")
    got = P.fused(branches, [dense], 2).collect()
    assert {(r.query, r.doc, round(r.score, 9), r.rank) for r in got} == want
    # Lists of hundreds of documents lie behind; a third of the given ones are ranked far down in them.
    assert len(want) == 10


def test_fused_queries_rank_no_whole_lists(spark):
    from quarry.plans import registry

    plan = registry.queries()["x16_field_rrf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "kept" not in plan and "term" not in plan  # pairs of all documents aren't part of what is fused


def test_ranks_are_counted_only_for_what_other_lists_have(spark, monkeypatch):
    """every document behind the last place of each task's best was ranked, for all queries."""
    seen, above = [], P._Scan.above
    monkeypatch.setattr(P._Scan, "above", lambda self, marks: (seen.extend((r.query, r.doc) for r in marks.collect()), above(self, marks))[1])
    rng = random.Random(4)
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randint(1, 6))]) for i in range(400)]
    asked = {q: ["a", "b", "c", "d"] for q in range(3)}
    near = {0: [7, 300, 399], 1: [5]}
    table = spark.createDataFrame(docs, "doc long, t array<string>").repartition(4)
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "query int, term string")
    dense = spark.createDataFrame([(q, d, i + 1) for q, ds in near.items() for i, d in enumerate(ds)], "query int, doc int, rank int")
    got = {(r.query, r.doc, round(r.score, 9), r["rank"]) for r in P.fused([P.Branch(table, "doc", "t", terms)], [dense], 2).collect()}
    want, body = set(), _ranking(docs, asked[0], [], 0.8)
    for q in asked:
        lists = [body, {d: i + 1 for i, d in enumerate(near.get(q, ()))}]
        score = {d: round(sum(1 / (60 + x[d]) for x in lists if d in x), 9) for d in set().union(*lists)}
        want |= {(q, d, score[d], i + 1) for i, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:2])}
    assert got == want and set(seen) <= {(q, d) for q, ds in near.items() for d in ds}


def test_terms_that_cannot_reach_the_floor_are_left(monkeypatch):
    """every term of a query was added up for every document."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    asked = pa.table({"query": pa.array([1] * 30), "term": words[:30], "own": [i % 3 > 0 for i in range(30)]})
    block = coded.Block(asked)
    n, rows = 500, []
    for d in range(n):
        ids = np.flatnonzero(rng.random(30) < 1 / (1 + np.arange(30)) ** 0.7)
        rows.append({"doc": d if d else None, "n": 1, "total": 50, "least": 50, "seq": np.int32([0]).tobytes() if len(ids) else b"", "len": np.int32([50]).tobytes() if len(ids) else b"", "held": np.int32([len(ids)]).tobytes() if len(ids) else b"", "ids": ids.astype(np.int32).tobytes(), "tf": rng.integers(1, 4, len(ids)).astype(np.int32).tobytes(), "aids": b"", "uses": b""})
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc", pa.int64()), *((c, pa.int64()) for c in ("n", "total", "least")), *((c, pa.binary()) for c in coded._PARTS)]))
    df = np.bincount(np.concatenate([np.frombuffer(r["ids"], np.int32) for r in rows]), minlength=30)
    block.idf = np.log1p((n - df + 0.5) / (df + 0.5))
    p = P._Piece(coded.Parts(batch), block, 50.0, 0.8)
    every, own = block.terms[0], block.terms[0][block.own[0]]
    at, score = p.scored(own, every, -1.0)
    assert len(at) > 400
    taken, hits = [], P._Piece.hits
    monkeypatch.setattr(P._Piece, "hits", lambda self, terms: (taken.append(len(terms)), hits(self, terms))[1])
    for place in (1, 5, 40, 200):
        floor = np.sort(score)[-place]
        less, found = p.scored(own, every, floor)
        assert {(a, s) for a, s in zip(less.tolist(), found.tolist()) if s >= floor} == {(a, s) for a, s in zip(at.tolist(), score.tolist()) if s >= floor}
    assert min(taken) < 30
