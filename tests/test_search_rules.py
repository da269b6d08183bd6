"""Each rule of search changes a result; pairs, archives, policies, registers and sequences against plain loops."""

import io
import random
import stat
import zipfile

import pytest
import regex
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import evaluation as E
from quarry.operators import lexical as L
from quarry.operators import registers
from quarry.operators import retrieval as V
from quarry.operators import search as S
from quarry.plans.lexical import accent_assisted
from quarry.sources import files


def _docs(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    return docs.withColumn("tokens", X.surface_tokens(F.col("text")))


def _terms(spark, **queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts.split()], "query string, term string")


# Variants -------------------------------------------------------------------------------------------


def test_variants_change_the_top(spark):
    docs = _docs(spark, {1: "mémoire cache rapide", 2: "cache lente et grande", 3: "mémoire vive mémoire", 4: "autre chose ici", 5: "rien du tout", 6: "encore du texte"})
    terms = _terms(spark, q="memoire cache")
    spelled = S.spelled_alike(terms, docs.select(F.explode("tokens").alias("term")))
    assert {r.term for r in spelled.collect()} == {"memoire", "cache", "mémoire"}
    found = V.index(docs, "doc_id", "tokens", spelled)
    own, variant = ({r.doc: r.score for r in V.scores(found, t).collect()} for t in (terms, spelled))
    both = {r.doc: r.score for r in S.assisted(V.scores(found, terms), V.scores(found, spelled)).collect()}
    assert own.keys() == {1, 2} and both.keys() == {1, 2, 3}
    assert both == {d: pytest.approx(max(own.get(d, 0), 0.8 * variant.get(d, 0)), abs=1e-6) for d in both}
    assert max(both, key=both.get) == 1 and both[3] > 0


def test_restored_accents_change_the_top(spark):
    docs = _docs(spark, {1: "học máy là gì\nbài một", 2: "hoc bai may", 3: "học máy", 4: "khác hẳn", 5: "và nữa", 6: "gì đó"})
    typed = spark.createDataFrame([(1, ["hoc", "may"])], "item_id int, tokens array<string>")
    top = [r.doc for r in accent_assisted(docs, typed).orderBy("rank").collect()]
    plain = V.top(V.bm25(docs, V.query_terms(typed, "item_id", "tokens"), "doc_id", "tokens"), ["query"], 10)
    assert [r.doc for r in plain.collect()] == [2] and set(top) == {1, 2, 3}


def test_hybrid_takes_the_better_of_both(spark):
    own = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0)], "query int, doc int, score double")
    variant = spark.createDataFrame([(1, 11, 5.0), (1, 12, 1.0)], "query int, doc int, score double")
    dense = spark.createDataFrame([(1, 12, 0.9)], "query int, doc int, score double")
    order = lambda v: [r.doc for r in S.hybrid(own, dense, v, 3).orderBy("rank").collect()]
    assert order(None)[-1] == 11 and order(variant).index(11) < order(variant).index(10)


# Rules ----------------------------------------------------------------------------------------------


def test_recognised_concepts_stand_for_their_words(spark):
    aliases = spark.createDataFrame([("machine learning", 1), ("ml", 1), ("cell", 2)], "alias string, concept int")
    queries = spark.createDataFrame([(1, "machine learning speed".split()), (2, "machine speed".split())], "q int, tokens array<string>")
    named = S.recognised(queries, "q", F.col("tokens"), aliases)
    assert {(r.query, r.alias) for r in named.collect()} == {(1, "machine learning")}
    terms = V.query_terms(queries, "q", "tokens")
    assert {(r.query, r.term) for r in S.without_constituents(terms, named).collect()} == {(1, "speed"), (2, "machine"), (2, "speed")}


def test_supplied_statistics_are_checked(spark):
    docs = _docs(spark, {1: "a b", 2: "b c d"})
    found = V.index(docs, "doc_id", "tokens", _terms(spark, q="a b"))
    stats = lambda n, a: spark.createDataFrame([(n, a)], "n_docs long, avg_len double")
    df = lambda **x: spark.createDataFrame(list(x.items()), "term string, df long")
    assert V.checked_statistics(found, stats(2, 2.5), df(a=1, b=2)) == (2, 2.5)
    for bad in ((stats(1, 9.0), None), (stats(2, 2.0), None), (stats(3, 3.0), df(a=1)), (stats(3, 3.0), df(a=1, b=1)), (stats(3, 3.0), df(a=1, b=4))):
        with pytest.raises(ValueError):
            V.checked_statistics(found, *bad)


def test_quoted_queries_are_taken_to_the_letter(spark):
    docs = _docs(spark, {1: "red fox den", 2: "red fox and hen", 3: "fox trail hen"})
    asked = spark.createDataFrame([("q", ["red", "fox", "hen"])], "query string, tokens array<string>")
    terms = V.query_terms(asked, "query", "tokens")
    found = V.index(docs, "doc_id", "tokens", terms)
    phrases = spark.createDataFrame([("q", "red fox den")], "query string, phrase string")
    args = (V.scores(found, terms), found.filter("term IS NOT NULL"), terms, phrases)
    loose = {r.doc for r in L.apply_anchors(*args).collect()}
    strict = {r.doc for r in L.apply_anchors(*args, quoted=asked.select("query")).collect()}
    assert loose == {1, 2, 3} and strict == set()  # no document has all of the anchor's words among the query's


def test_concept_evidence_goes_before_coverage(spark):
    chunks = spark.createDataFrame([("g", 1, "red fox hen".split()), ("g", 2, "vulpes".split()), ("g", 3, "other".split())], "g string, o int, t array<string>")
    asked = spark.createDataFrame([(7, "g", ["hen", "red"])], "query int, g string, tokens array<string>")
    evidence = spark.createDataFrame([(7, "g", 2, 1)], "query int, g string, o int, concepts long")
    best = lambda e: S.rank_contexts(chunks, asked, "g", "o", "t", e).first()
    assert best(None).o == 1 and (best(evidence).o, best(evidence).concepts) == (2, 1)


def test_anchors_of_texts(spark):
    texts = {1: "what is Machine Learning, of the Cell Wall", 2: "red green blue black white grey", 3: "ab, cd", 4: "photosynthèse végétale", 5: None, 6: "a Big Red Fox Runs Far Away"}
    rows = spark.createDataFrame(list(texts.items()), "i int, t string").select("i", S.query_anchors(F.col("t")).alias("a")).collect()
    got = {r.i: r.a for r in rows}
    # Punctuation ends a run; fours share two words; long capitalised runs are no names.
    assert got[1] == ["machine learning", "cell wall", "machine learning", "cell wall"]
    assert got[2] == ["red green blue black", "blue black white grey", "white grey"] and got[3] == [] and got[4] == ["photosynthèse végétale"] and got[5] == []
    assert got[6][0] == "big red fox runs" and "big red fox runs far away" not in got[6]
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (1, 12, 0.2)], "query int, doc int, score double")
    docs = spark.createDataFrame([(10, "the cell wall".split()), (11, "learning of the cell".split()), (12, "machine learning".split())], "doc int, tokens array<string>")
    queries = spark.createDataFrame([(1, texts[1])], "query int, text string")
    assert [(r.query, r.doc) for r in S.admitted(hits, queries, docs).collect()] == [(1, 10)]


def test_binary_scores(spark):
    rng = random.Random(2)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(12)]
    make = lambda n: {i: " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in range(n)}
    docs, queries = make(60), make(8)
    stop, want = set(X.QUERY_STOPWORDS), {}
    for q, a in queries.items():
        scored = []
        for d, b in docs.items():
            x, y = set(a.split()), set(b.split())
            if (x & y) - stop:
                scored.append((-round(len(x & y) / (len(x) * len(y)) ** 0.5, 6), d))
        want |= {(q, d): -s for s, d in sorted(scored)[:5]}
    got = {(r.query, r.doc): r.score for r in V.binary_scores(_docs(spark, queries), _docs(spark, docs), "doc_id", "doc_id", "tokens", 5).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


# Stated pairs ---------------------------------------------------------------------------------------


def test_stated_pairs(spark):
    texts = {
        1: "Intro text. Random access memory (RAM) is fast.\nNext: bộ nhớ nghĩa là memory; heap also called free store",
        2: "a cache is not known. Cache does not mean thing. this is not what cache means storage",
        3: "en: photosynthesis | fr: photosynthèse | vi: quang hợp\nen: one | en: two\nen: alone",
        4: "đường unaccented form is duong\ncát unaccented form is cut\nplain unaccented form is plain",
        5: "visit http://x.y (site)\nsee www.x (site); 12345678 (number)",
        6: None,
        7: "same (same) ; the of means a",
    }
    docs = spark.createDataFrame(list(texts.items()), "d int, t string")
    got = {(r.d, r.form, r.term, r.other) for r in S.stated_pairs(docs, "d", "t").collect()}
    assert got == {
        (1, "gloss", "random access memory", "ram"), (1, "definition", "bộ nhớ", "memory"), (1, "synonym", "heap", "free store"),
        (3, "labelled", "photosynthesis", "photosynthèse"), (3, "labelled", "photosynthesis", "quang hợp"), (3, "labelled", "photosynthèse", "quang hợp"),
        (4, "spelling", "đường", "duong"),
    }


# Archives -------------------------------------------------------------------------------------------


def _zip(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, mode in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr, info.compress_type = mode << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def test_archives_are_looked_into(spark, monkeypatch):
    rows = {
        "good.docx": _zip(("word/document.xml", b"<x/>", 0)), "macro.xlsx": _zip(("xl/vbaProject.bin", b"x", 0)), "up.zip": _zip(("../x", b"x", 0)), "root.zip": _zip(("/etc/x", b"x", 0)), "drive.zip": _zip(("C:\\x", b"x", 0)),
        "link.zip": _zip(("l", b"x", stat.S_IFLNK | 0o777)), "bomb.zip": _zip(("b", b"\0" * (files.ARCHIVE_BYTES + 1), 0)), "many.zip": _zip(*((f"f{i}", b"", 0) for i in range(files.ARCHIVE_ENTRIES + 1))), "broken.pptx": b"PK\x03\x04nothing", "text.docx": b"text", "n.txt": b"plain",
    }
    df = spark.createDataFrame([(k, bytearray(v), len(v)) for k, v in rows.items()], "path string, content binary, length long")
    got = {r.path: r.verdict for r in files.format_check(df).collect()}
    assert got == {
        "good.docx": "OK", "macro.xlsx": "HAS_MACROS", "up.zip": "UNSAFE_ARCHIVE", "root.zip": "UNSAFE_ARCHIVE", "drive.zip": "UNSAFE_ARCHIVE", "link.zip": "UNSAFE_ARCHIVE", "bomb.zip": "ARCHIVE_TOO_LARGE", "many.zip": "ARCHIVE_TOO_LARGE",
        "broken.pptx": "BROKEN_ARCHIVE", "text.docx": "WRONG_SIGNATURE", "n.txt": "OK",
    }


# Policies -------------------------------------------------------------------------------------------


def _policies(hits, relevant, least_recall, most_abstained):
    """All policies against all queries."""
    queries = {}
    for q, d, s in hits:
        queries.setdefault(q, []).append((-s, d))
    for h in queries.values():
        h.sort()
    good = {}
    for q, d in relevant:
        good.setdefault(q, set()).add(d)
    every = queries.keys() | good.keys()
    lead = {q: {f: round(queries[q][0][0] * -1 + queries[q][k - 1][0], 9) if len(queries.get(q, ())) >= k else 0.0 for f, k in (("gap2", 2), ("gap5", 5))} for q in queries}
    margins = {f: sorted({0.0} | {v[f] for v in lead.values() if v[f] > 0}) for f in ("gap2", "gap5")}
    methods = {"absolute": [(t, 0.0, "gap5") for t in {0.0, 1.0} | {s for _, _, s in hits if s > 0}], "margin2": [(0.0, m, "gap2") for m in margins["gap2"]], "margin5": [(0.0, m, "gap5") for m in margins["gap5"]]}
    methods["selective"] = [(a, m, f) for a in E.ABSOLUTE_GRID for f in margins for m in margins[f]]
    out = {}
    for name, policies in methods.items():
        rated = []
        for a, m, f in policies:
            recall = first = answered = mistaken = 0
            for q in every:
                kept = [(s, d) for s, d in queries.get(q, []) if -s > a]
                if not kept or m > 0 and lead[q][f] <= m:
                    continue
                if q in good:
                    answered += 1
                    recall += len({d for _, d in kept[:5]} & good[q]) / len(good[q])
                    first += kept[0][1] in good[q]
                else:
                    mistaken += 1
            n, none = len(good), len(every) - len(good)
            r, p, fa, fp = round(recall / n, 9) if n else 0.0, round(first / n, 9) if n else 0.0, round(1 - answered / n, 9) if n else None, round(mistaken / none, 9) if none else None
            if r >= least_recall and fa is not None and fa <= most_abstained:
                rated.append((1.0 if fp is None else fp, -r, -p, a, m, f, r, p, fa, fp))
        best = min(rated, key=lambda x: x[:6]) if rated else None
        out[name] = (len(policies), len(rated), *(best[3:] if best else [None] * 7))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_policy_search_against_all_policies(spark, seed):
    rng = random.Random(seed)
    hits = [(q, d, rng.choice([0.0, 0.3, 0.45, 0.5, round(rng.random(), 2), 1.0])) for q in range(12) for d in range(rng.choice([1, 3, 8]))]
    relevant = [(q, rng.randint(0, 7)) for q in range(14) if q % 4 for _ in range(rng.randint(1, 3))]
    if seed == 3:
        relevant = []
    limits = ((0.95, 0.05), (0.2, 0.5), (0.0, 1.0), (0.0, 1.0))[seed]
    frames = spark.createDataFrame(hits, "query int, doc int, score double"), spark.createDataFrame(relevant, "query int, doc int")
    got = {r.method: tuple(r)[1:] for r in E.policy_search(*frames, *limits).collect()}
    want = _policies(hits, set(relevant), *limits)
    assert {k: tuple(pytest.approx(x) if isinstance(x, float) else x for x in v) for k, v in want.items()} == got


# Registers ------------------------------------------------------------------------------------------


def test_registers_act_in_turn(spark, tmp_path):
    rng = random.Random(8)
    store = registers.Registers(spark, f"file://{tmp_path}", 4)
    held = {i: [0, "start"] for i in range(12)}
    store.put(0, spark.createDataFrame([(i, "start") for i in held], "id long, value string"))
    for batch in (1, 2):
        updates = [(rng.randint(0, 14), batch * 1000 + p, rng.randint(0, 4), f"v{batch}.{p}") for p in range(150)]
        df = spark.createDataFrame(updates, "id long, place long, expected long, value string").repartition(5)
        want = {}
        for i, place, expected, value in sorted(updates, key=lambda u: u[1]):
            if i not in held:
                want[place] = "MISSING"
            elif held[i][0] == expected:
                held[i] = [expected + 1, value]
                want[place] = "APPLIED"
            else:
                want[place] = "CONFLICT"
        for _ in range(2):  # run again after a failure
            assert {r.place: r.outcome for r in store.update(batch, df).collect()} == want
        assert {r.id: [r.revision, r.value] for r in store.table.read().collect()} == held


def test_sequences_go_on_and_end(spark, tmp_path):
    store = registers.Sequences(spark, f"file://{tmp_path}", 7, 4)
    ask = lambda *rows: spark.createDataFrame(rows, "scope string, k long")
    got = lambda n, df: {(r.scope, r.k): r.seq for r in store.allocate(n, df, "k").collect()}
    first = ask(("a", 5), ("a", 3), ("b", 1), ("a", 9))
    assert got(0, first) == got(0, first) == {("a", 3): 1, ("a", 5): 2, ("a", 9): 3, ("b", 1): 1}
    assert got(1, ask(*(("a", k) for k in range(6)), ("c", 1))) == {("a", 0): 4, ("a", 1): 5, ("a", 2): 6, ("a", 3): 7, ("a", 4): None, ("a", 5): None, ("c", 1): 1}
    assert got(2, ask(("a", 1), ("b", 7))) == {("a", 1): None, ("b", 7): 2}


def _plain_snippet(text, terms, phrase, size):
    found = [(m.start(), m[0].lower().replace("ß", "ss")) for m in regex.finditer(X.TOKEN, text or "", regex.I)]
    words = [w for _, w in found]
    at = next((found[i][0] for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase), None) if len(phrase) > 1 else None
    if at is None:
        hits = {t: [start + w.index(t) for start, w in found if t == w or t in regex.findall(r"\p{L}+", w)] for t in terms}
        at = min(((len(h), h[0]) for h in hits.values() if h), default=(0, 0))[1]
    return None if text is None else text[max(0, at - size // 4) :][:size]


def test_snippets_follow_tokens(spark):
    filler = "Over and over, the river ran; " * 4
    cases = [
        (filler + "A stone in the river. Stones? " + filler, ["stone", "river"], ["stone", "river"]),  # "Stones" is no hit, and one stone is rarer than nine rivers
        (filler + "River stone! " + filler, ["river", "stone"], ["river", "stone"]),  # the whole phrase, not the first river
        (filler + "the STRASSE and Straße " + filler, ["strasse", "over"], ["none"]),  # folded alike, places as written
        (filler + "room b12 or 7up " + filler, ["up", "b"], []), (filler + "up7b" + filler, ["b", "up"], []),  # runs of letters within tokens
        (filler + "C++ and c# in .NET 3.14 " + filler, ["c#", "3.14"], ["c++", "and"]),
        ("short", ["missing"], ["also", "missing"]), ("", ["x"], ["x"]), (None, ["x"], []), (filler, [], ["over"]), ("é à " * 50 + "x", ["x"], ["x"]),
        ("the fan and an ant " + filler + " an", ["an"], ["an"]),  # an old count of characters would find "an" in "fan"
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, terms array<string>, phrase array<string>")
    for size in (20, 61):
        got = {r.i: r.s for r in rows.select("i", X.hit_snippet(F.col("text"), F.col("terms"), F.col("phrase"), size).alias("s")).collect()}
        assert got == {i: _plain_snippet(*c, size) for i, c in enumerate(cases)}


def test_index_of_documents_without_terms(spark):
    """Rows of documents and of terms keep apart even if identifiers look like terms, broadcast or not."""
    docs = spark.createDataFrame([("river", ["stone", "river"]), ("stone", []), ("x", ["river", "river"]), (None, ["stone"])], "doc string, tokens array<string>")
    terms = spark.createDataFrame([("q", "river"), ("q", "none")], "query string, term string")
    want = {("river", 2, None, 1), ("river", 2, "river", 1), ("stone", 0, None, 1), ("x", 2, None, 1), ("x", 2, "river", 2), (None, 1, None, 1)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert {(r.doc, r.len, r.term, r.tf) for r in V.index(docs, "doc", "tokens", terms).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
