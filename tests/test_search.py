"""Spans, phrases, accents, admission and contexts against brute force and hand-made cases."""

import random
import re
import time

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graphs as G
from quarry.operators import lexical as L
from quarry.operators import relational as R
from quarry.operators import retrieval as V
from quarry.operators import search as S
from quarry.operators import spans as P


def _texts(rng, n):
    parts = ["word", "Länge", "a", " ", " ", " ", "\n", "\n\n", ". ", "! ", "。", "?", "x" * 30, "…"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["", None, " ", "y" * 500]


def test_split_spans_cover_the_text(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(t,) for t in _texts(rng, 200)], "t string")
    for text, spans in df.select("t", P.split_spans(F.col("t"), 60)).collect():
        text = text or ""
        assert "".join(text[s.start : s.end] for s in spans) == text
        for s in spans[:-1]:
            piece, room = text[s.start : s.end], text[s.start : s.start + 60]
            assert 0 < len(piece) <= 60
            ends = [m.end() for m in re.finditer(r"(?<=[.!?。！？])\s+|\n\s*\n", room)]
            blank = room.rfind(" ", 30)
            assert len(piece) == (ends[-1] if ends else blank + 1 if blank > 0 else 60)


def test_sentence_spans_keep_all_words(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(t,) for t in _texts(rng, 200) if t is None or "x" * 60 not in t and len(t) < 450], "t string")
    for text, spans in df.select("t", P.sentence_spans(F.col("t"), 400, 3)).collect():
        text = text or ""
        assert re.sub(r"\s", "", "".join(text[s.start : s.end] for s in spans)) == re.sub(r"\s", "", text)
        assert all(len(text[s.start : s.end].split()) <= 3 and text[s.start : s.end] == text[s.start : s.end].strip() for s in spans)
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_segments_have_stable_ids(spark):
    df = spark.createDataFrame([(1, 1, "One. " * 900), (1, 2, " "), (2, 1, None)], "v int, p int, t string")
    first, again = (sorted(P.paired_segments(df.repartition(n), "v", "p", "t").collect()) for n in (1, 3))
    assert first == again and len(first) == 3 and len({r.segment_id for r in first}) == 3 and "".join(r.original for r in first) == "One. " * 900


def test_normalized_query(spark):
    rows = [("  a \t b\n", "a b"), ("bad\x07", None), ("", None), (None, None), ("é", "é"), ("x" * 4001, None)]
    got = spark.createDataFrame([(q, i) for i, (q, _) in enumerate(rows)], "q string, i int").select("i", P.normalized_query("q").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [w for _, w in rows]


def test_long_texts_take_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "t string")
        began = time.time()
        row = df.select(F.size(X.ngrams(X.surface_tokens(F.col("t")), 2, 4)).alias("g"), F.size(X.word_windows(F.col("t"))).alias("w")).first()
        took.append(time.time() - began)
        assert row.g == 3 * n - 6 and row.w == -(-(n - 200) // 160) + 1
    assert took[1] < 30


def test_phrases_against_counting(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))]) for i in range(60)] + [(99, None)]
    got = {(r.phrase, r.docs, r.uses) for r in L.frequent_phrases(spark.createDataFrame(docs, "d int, t array<string>").repartition(5), "d", "t", 2, 4, 3).collect()}
    seen, uses = {}, {}
    for i, t in docs:
        for n in (2, 3, 4):
            for k in range(len(t or []) - n + 1):
                p = " ".join(t[k : k + n])
                seen.setdefault(p, set()).add(i)
                uses[p] = uses.get(p, 0) + 1
    assert got == {(p, len(s), uses[p]) for p, s in seen.items() if len(s) >= 3}


def test_mentions_are_leftmost_longest(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d a b x b c"), (3, None), (4, "c")], "d int, t string")
    aliases = spark.createDataFrame([("a b", 1), ("b c", 2), ("c d", 3), ("b c d", 4), ("x", 5)], "alias string, concept int")
    got = sorted((r.d, r.at, r.alias) for r in G.alias_mentions(docs, "d", X.surface_tokens(F.col("t")), aliases, 3).collect())
    assert got == [(1, 1, "a b"), (1, 3, "c d"), (2, 1, "b c d"), (2, 4, "a b"), (2, 6, "x"), (2, 7, "b c")]


def test_accents_are_restored_where_the_corpus_is_of_one_mind(spark):
    held = ["học máy là gì", "trí tuệ nhân tạo", "may mắn", "máy mắn", "phân số", "quang hợp"]
    passages = spark.createDataFrame([(t.split(),) for t in held], "tokens array<string>")
    asked = {1: "hoc may la gi", 2: "tri tue nhan tao va phan so", 3: "may man", 4: "phân so", 5: "nothing here", 6: "quang hop quang hop quang hop quang hop quang hop", 7: "học máy"}
    queries = spark.createDataFrame([(i, t.split()) for i, t in asked.items()], "q int, tokens array<string>")
    got = {r.query: r.variant for r in L.accent_variants(queries, passages, "q", "tokens", "tokens").collect()}
    assert got == {1: "học máy là gì", 2: "trí tuệ nhân tạo va phân số", 4: "phân số", 6: "quang hợp quang hợp quang hợp quang hợp quang hop"}


def test_admission_by_anchor(spark):
    queries = spark.createDataFrame([(1, "what is machine learning of the cell".split()), (2, ["ab", "cd"]), (3, "photosynthèse végétale".split())], "query int, tokens array<string>")
    texts = spark.createDataFrame([(10, "about machine learning now".split()), (11, "machine and learning".split()), (12, "ab cd".split()), (13, "photosynthese vegetale".split())], "doc int, tokens array<string>")
    hits = spark.createDataFrame([(q, d, s) for q in (1, 2, 3) for d, s in ((10, 0.5), (11, 0.9), (12, 0.9), (13, 0.45))] + [(1, 10, 0.1)], "query int, doc int, score double")
    assert sorted((r.query, r.doc, r.score) for r in S.admitted(hits, queries, texts).collect()) == [(1, 10, 0.5), (3, 13, 0.45)]


def test_contexts_prefer_phrases_then_coverage(spark):
    chunks = spark.createDataFrame([("g", 1, "red".split()), ("g", 2, "fox red".split()), ("g", 3, "a red fox".split()), ("h", 1, "none".split()), ("h", 2, "none".split())], "g string, o int, t array<string>")
    asked = spark.createDataFrame([(7, "g", ["red", "fox"]), (7, "h", ["red", "fox"]), (8, "g", ["fox", "the", "red", "hen"])], "query int, g string, tokens array<string>")
    got = {(r.query, r.g): (r.o, r.exact) for r in S.rank_contexts(chunks, asked, "g", "o", "t").collect()}
    assert got == {(7, "g"): (3, 1), (7, "h"): (1, 0), (8, "g"): (2, 0)}


def test_related_items_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, k, rng.randint(0, 3 if k == "hot" else 9)) for i in range(60) for k in ("hot", "a", "b") for _ in range(rng.randint(0, 3))]
    got = sorted((r.i, r.place, r.related, r.kinds) for r in G.related(spark.createDataFrame(rows, "i int, k string, v int"), "i", "k", "v", ["hot", "a", "b"], 3).collect())
    own = {}
    for i, k, v in rows:
        own.setdefault(i, set()).add((k, v))
    want = []
    for i in own:
        shared = sorted((-len({k for k, _ in own[i] & own[j]}), j) for j in own if j != i and own[i] & own[j])
        want += [(i, p, j, -n) for p, (n, j) in enumerate(shared[:3], 1)]
    assert got == sorted(want)


def test_prefix_sums(spark):
    rows = [(k, k % 7) for k in range(1000)]
    got = R.prefix_sums(spark.createDataFrame(rows, "k int, v int").repartition(9), ["k"], ["v"]).collect()
    total = 0
    for r in sorted(got):
        total += r.v
        assert r.v_sum == total


def test_knn_in_blocks_is_the_same(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4 if i % 10 else 3)]) for i in range(200)] + [(900, None), (901, [0.0] * 4), (902, [float("nan")] * 4)]
    base = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    asked = base.filter("k % 5 = 0")
    one, blocks = (sorted(map(tuple, V.knn(base, asked, "k", "v", 7, block).collect())) for block in (4096, 16))
    assert one == blocks and len(one) == 7 * 40 and {q for q, *_ in one} == set(range(0, 200, 5))


def test_merged_intervals_against_a_loop(spark):
    from quarry.operators import sync

    rng = random.Random(6)
    rows = [(k, float(a), float(a + rng.randint(0, 5))) for k in range(30) for a in rng.sample(range(60), rng.randint(0, 12))]
    got = sorted(map(tuple, sync.merge_intervals(spark.createDataFrame(rows, "k int, a double, b double"), "k", "a", "b", 1.0, 12.0).collect()))
    want = []
    for k in range(30):
        made = []
        for a, b in sorted((a, b) for i, a, b in rows if i == k):
            if made and a - made[-1][1] <= 1 and max(made[-1][1], b) - made[-1][0] <= 12:
                made[-1][1] = max(made[-1][1], b)
            else:
                made.append([a, b])
        want += [(k, a, b) for a, b in made]
    assert got == sorted(want)


def test_complete_link_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(g, o, [rng.gauss(0, 1) for _ in range(3)]) for g in range(8) for o in range(25)]
    got = {(r.g, r.o): r.cluster for r in V.complete_link(spark.createDataFrame(rows, "g int, o int, v array<double>").repartition(3), "g", "o", "v", 0.6).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for g in range(8):
        clusters = []
        for _, o, v in sorted(r for r in rows if r[0] == g):
            near = [min(cos(v, w) for w in c) for c in clusters]
            best = max(range(len(near)), key=lambda i: (near[i], -i), default=None)
            if best is None or near[best] < 0.6:
                clusters.append([v])
                best = len(clusters) - 1
            else:
                clusters[best].append(v)
            assert got[g, o] == best
