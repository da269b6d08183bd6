"""Scores told where documents lie: nothing that grows with pairs is shuffled, and odd tables give what SQL gives."""

import random

import duckdb
import numpy as np
import pytest

from quarry.operators import coded, placed
from quarry.plans import registry
from tests.test_parity import rows_of

SF = "/root/testdata/sf0.001"


def _tables(spark, folder):
    """Few words, so that much is in common; identifiers that are null or come twice, with texts of equal and of other length."""
    rng = random.Random(11)
    words = "red fox hen den one two of the cat dog owl elk ant bee cow c++ x.y".split()
    line = lambda most=len(words): " ".join(rng.choice(words[:most]) for _ in range(rng.choice([0, 1, 3, 4, 5, 8])))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 4)))) for i in [*range(90), 100, 200, 300, 5, 6, 7, None, None]]
    docs += [(400, '"red fox den" hen\nred fox den\n\nred fox den cat'), (8, docs[8][1]), (9, None), (500, None), (501, "")]
    items = [(i, line(-2) + " red fox") for i in range(12)] + [(12, None), (13, "of the")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in [*range(80), 100, 200, 300, 400]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("name", ["x07_anchor_rule", "x10_concept_groups", "x11_focus_rule", "x22_chunk_search", "d19_hybrid_search", "x16_field_rrf"])
@pytest.mark.parametrize("size", [None, 7])
def test_odd_tables_against_sql(spark, tmp_path, monkeypatch, name, size):
    _tables(spark, tmp_path)
    if size:
        for bound in ("BLOCK", "TOKENS", "PIECE", "GIVEN"):
            monkeypatch.setattr(coded, bound, size)
        monkeypatch.setattr(placed, "BLOCK", size)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = rows_of(columns, found.fetchall())
    assert rows_of(df.columns, df.collect()) == want and len(want) > 10


@pytest.mark.parametrize("name", ["x07_anchor_rule", "x10_concept_groups", "x11_focus_rule"])
def test_pairs_stay_where_documents_lie(spark, name):
    """Pairs of queries and documents were shuffled, for their scores and for the rules."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


def test_best_lines_are_chosen_before_the_shuffle(spark, monkeypatch):
    """pairs of items and lines were shuffled or stored, and then a row of each item and document that it hits."""
    from quarry.operators import search as S

    seen, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (seen.append(cut(df)), seen[-1])[1])
    docs = spark.createDataFrame([(i, f"fox {i}\nfox fox\nred fox") for i in range(2000)], "doc long, text string").repartition(2)
    terms = spark.createDataFrame([(1, "fox"), (1, "red"), (2, "none")], "query int, term string")
    rows = S.chunk_search(docs.withColumn("tokens", coded.line_tokens(docs["text"])), "doc", "tokens", terms, 3).collect()
    assert {(r.query, r.version, r.line, r["rank"], r.total) for r in rows} == {(1, i, 2, i + 1, 2000) for i in range(3)}
    assert max(s.count() for s in seen if "score" in s.columns) <= 3 * 4


def test_mentions_by_states_against_alternatives():
    """Leftmost first, longest first, none overlapping, as a regular expression's alternatives give them."""
    rng = random.Random(3)
    for _ in range(300):
        aliases = list({" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))})
        rows = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(4)]
        want = []
        for i, t in enumerate(rows):
            k = 0
            while k < len(t):
                n = next((n for n in (3, 2, 1) if k + n <= len(t) and " ".join(t[k : k + n]) in aliases), 0)
                if n:
                    want.append((i, " ".join(t[k : k + n])))
                k += max(n, 1)
        flat = np.array(["abcd".index(w) for t in rows for w in t], np.int64)
        row, alias = coded.Trie(aliases).mentions(list("abcd"), flat, np.repeat(np.arange(4), [len(t) for t in rows]))
        assert [(i, aliases[a]) for i, a in zip(row.tolist(), alias.tolist())] == want
