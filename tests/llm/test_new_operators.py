"""Sharding, vector codes and fill-in-middle against brute force and on edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, queries, shards, vectors

from .test_operators import docs_of, edge_rows, empty, words

# 11 -----------------------------------------------------------------------------------------------


def _rows(df, names=("shard", "slot")):
    return [(r.doc_id, r.text, r[names[0]], r[names[1]]) for r in df.collect()]


def _holds(rows, given, n, tolerance):
    """Shards hold every row, slots are gapless, sizes are near equal, texts together unless they are large."""
    assert sorted(((i, t) for i, t, *_ in rows), key=repr) == sorted(given, key=repr)
    size = lambda t: len((t or "").encode()) + 1
    total = sum(size(t) for _, t in given)
    own = [[r for r in rows if r[2] == s] for s in range(n)]
    assert sum(map(len, own)) == len(rows)
    for part in own:
        assert sorted(r[3] for r in part) == list(range(len(part)))
    group = {}
    for _, t, s, _ in rows:
        group.setdefault(t or "", []).append(s)
    # Shards are ranges of the key, so sums from the first shard on are within the tolerance, or half a row.
    longest = max(size(t) for _, t in given)
    for s in range(1, n):
        off = abs(sum(size(r[1]) for part in own[:s] for r in part) - s * total / n)
        assert off <= max(tolerance * total / n, longest / 2)
    for t, where in group.items():
        if len(where) * size(t) <= tolerance * total / n:
            assert len(set(where)) == 1


def test_shards_hold_near_equal_bytes(spark):
    rng = random.Random(1)
    given = [(i, words(rng, rng.randint(1, 60))) for i in range(400)] + [(1000 + i, "copied text " * 9) for i in range(250)] + [(None, None)] * 30 + [(5, "again")] * 200
    docs = docs_of(spark, given).repartition(7).cache()
    for n, tolerance, probes, file_bytes in ((8, 0.005, 1 << 13, 1 << 26), (3, 0.2, 4, 4000), (1, 0.0, 2, 1 << 26), (13, 0.0, 64, 2000)):
        _holds(_rows(shards.shard(docs, None, n, tolerance=tolerance, probes=probes, file_bytes=file_bytes)), given, n, tolerance)


def test_shards_keep_small_groups_whole(spark):
    """With a tolerance beyond half a group, no group is cut; equal rows still spread if they are most of all."""
    given = [(10 * g + i, f"text {g} " * 3) for g in range(60) for i in range(4)]
    found = {}
    for _, t, s, _ in _rows(shards.shard(docs_of(spark, given), None, 4, tolerance=0.1)):
        found.setdefault(t, set()).add(s)
    assert all(len(s) == 1 for s in found.values())
    alike = [(7, "one and the same")] * 400
    counts = [r["count"] for r in shards.shard(docs_of(spark, alike).repartition(4).cache(), None, 8).groupBy("shard").count().collect()]
    assert counts == [50] * 8


def test_shards_of_edges(spark):
    docs = docs_of(spark, edge_rows()).repartition(3).cache()
    _holds(_rows(shards.shard(docs, None, 8)), [(r[0], r[1]) for r in edge_rows()], 8, shards.TOLERANCE)
    assert shards.shard(empty(spark)).count() == 0
    clashing = docs.withColumn("SHARD", F.lit(1)).withColumn("k1", F.lit("x")).withColumn("shard_at", F.lit(2))
    out = shards.shard(clashing, None, 2)
    assert out.columns == [*clashing.columns, "_shard", "slot"] and {r["k1"] for r in out.collect()} == {"x"}
    assert shards.shard_names(clashing) == {"shard": "_shard", "slot": "slot"}


def test_splitters_take_few_rounds(spark, monkeypatch):
    rounds = []
    count = shards._histograms
    monkeypatch.setattr(shards, "_histograms", lambda *a: rounds.append(1) or count(*a))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert shards.shard(docs).groupBy("shard").count().filter("count BETWEEN 2475 AND 2525").count() == 8
    assert len(rounds) <= 3


# 12 -----------------------------------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds, scale=256):
    """rows (id, vector, label) -> {id: (code, error, label_error)} and codebooks, by plain loops."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(scale * x)) for x in r[1]] for r in good]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for v in cut:
                mine.setdefault(nearest(v[p], books[p])[0], []).append(v[p])
            for e, members in mine.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for r, v in zip(good, cut):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((i, label, code, error, by_label[label]) for i, label, code, error in out), key=repr), books


VECTORS = "vec_id long, embedding array<double>, label string, id int, code string, points int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c", 2) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("block_rows", [4, 50, 8192])
@pytest.mark.parametrize("parts,width,entries,spread", [(4, 3, 16, 1.0), (2, 1, 5, 0.01), (1, 6, 64, 30.0)])
def test_vector_codes(spark, parts, width, entries, spread, block_rows):
    """Small spreads make equal parts, ties of distances and boxes without extent."""
    rng = random.Random(width)
    rows = [(i, [round(rng.gauss(0, spread), 3) for _ in range(parts * width)], rng.choice("ab")) for i in range(150)]
    rows += [(200 + i, rows[3][1], None) for i in range(40)] + [(3, rows[9][1], "a"), (None, rows[8][1], "b")]
    rows += [(300, None, "a"), (301, [None] + [0.5] * (parts * width - 1), "a"), (302, [float("nan")] * (parts * width), "b"), (303, [float("-inf")] * (parts * width), "b"), (304, [], "a")]
    codes, books = vectors.compress(vectors_of(spark, rows).repartition(3), parts=parts, entries=entries, block_rows=block_rows)
    want, want_books = lloyd([r for r in rows if r[1] != []], parts, entries, 2)
    assert sorted((tuple(r) for r in codes.select("id", "label", "code", "error", "label_error").collect()), key=repr) == want
    assert books.tolist() == want_books
    assert vectors.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_boxes_decide_like_points():
    """One tree's answers, sums and counts are those of all distances, ties included."""
    rng = np.random.default_rng(4)
    for n, d, k, top in itertools.product((1, 7, 8, 9, 500), (1, 2, 5), (1, 3, 64), (2, 40)):
        points, book = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (k, d))
        order, low, high, total = vectors._tree(points)
        found, sums, counts = vectors._descend(points[order], low, high, total, book)
        want = ((points[order][:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (found == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[order][want == e].sum(0)).all() for e in range(k))


def test_whole_subtrees_are_assigned(monkeypatch):
    """On clustered points most are assigned by boxes, not one by one."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (16, 4))
    points = centres[rng.integers(0, 16, 4096)] + rng.integers(-20, 20, (4096, 4))
    order, low, high, total = vectors._tree(points)
    looked = []
    nearest = vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", lambda g, d: looked.append(len(g)) or nearest(g, d))
    found, _, counts = vectors._descend(points[order], low, high, total, centres)
    assert counts.sum() == 4096 and sum(looked) < 4096 * 16 / 10


def test_vector_edges(spark):
    none = vectors_of(spark, [(1, [0.0] * 16, "a")]).filter("false")
    assert vectors.compress(none)[0].count() == 0
    few = vectors_of(spark, [(2, [0.5] * 16, None), (1, [-0.001] * 16, None), (3, [1e300] * 16, None), (4, [0.1] * 32, None)])
    codes, books = vectors.compress(few)
    assert books.shape == (16, 3, 1) and sorted((r.id, r.code[:2], r.error) for r in codes.collect()) == [(1, "00", 0), (2, "01", 0), (3, "02", 0)]
    assert books[0].tolist() == [[-1], [128], [vectors.LIMIT]]
    back = codes.filter("id = 2").select(vectors.reconstructed(F.col("code"), books).alias("v")).first().v
    assert back == [0.5] * 16
    with pytest.raises(ValueError):
        vectors.compress(vectors_of(spark, [(1, [0.0] * 17, "a")]))


# 13 -----------------------------------------------------------------------------------------------


def cut_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("aZz <>PSM\n\0é中😀") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(r[0], r[1]) for r in edge_rows()] + [(400, "x<P>y"), (401, "<"), (402, "İÍ  a"), (-3, "negative id"), (2**62, "large id")]
    docs = docs_of(spark, rows).repartition(4)
    made = fim.cut(docs)
    got = [(r.doc_id, r.text, r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) for r in made.collect()]
    assert sorted(got, key=repr) == sorted([(i, t, *cut_brute(i, t)) for i, t in rows], key=repr)
    assert made.columns[: len(docs.columns)] == docs.columns and {g[3] for g in got} == {"plain", "psm", "spm"}
    back = made.select("text", fim.restored(F.col("fim_output"), F.col("fim_form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_fill_in_middle_edges(spark):
    assert fim.cut(empty(spark)).count() == 0
    clashing = docs_of(spark, edge_rows()).withColumn("fim_n", F.lit("mine")).withColumn("FIM_draws", F.lit(1))
    made = fim.cut(clashing, fim_percent=100, spm_percent=100)
    assert made.columns[-5:] == ["_fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"] and {r.fim_n for r in made.collect()} == {"mine"}
    assert {r.fim_form for r in made.filter("length(text) > 0").collect()} == {"spm"}
    assert {r.fim_form for r in fim.cut(clashing, fim_percent=0).collect()} == {"plain"}


# queries ------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_queries_cover_their_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_histogram_shards(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    vecs = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, _ = lloyd(vecs, 16, 64, 2)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in queries.op12_vector_codes(spark, SF).collect()) == sorted((i, c, e, le) for i, _, c, e, le in want)
    for r in queries.op13_fill_in_middle(spark, SF).collect():
        n, form, prefix, middle, output = cut_brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
