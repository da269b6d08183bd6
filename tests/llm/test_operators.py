"""The ten operators against brute force, round trips and defined edge cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, common, decontam, exactdup, langid, neardup, packing, suffixdup, token_file, toxicity, warc
from quarry.llm.tokens import encoder, tokenizer_path

#: documents with extra columns whose names clash with those the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, norm string, digest string, node int, key string, label string, part int, ids string, lost_id int, _lost_id int, tag string, doc string"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, 1, "x", "y", 2, "k", "l", 3, "i", 4, 5, "t", "d") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = words(rng, 40_000)
    return [
        (1, base), (2, base.upper()), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"),
        (9, long), (10, long + " tail"), (None, base), (11, "Ünïcode ß 中文 " * 30), (12, words(rng, 200)), (13, base), (14, "\0" * 300), (15, None), (16, "ab" * 400), (17, "Straße"),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, edge_rows()).repartition(3).cache()


def empty(spark):
    return docs_of(spark, edge_rows()).filter("false")


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").encode().translate(LOWER)


# 1 ------------------------------------------------------------------------------------------------


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset([tuple(found)] if 0 < len(found) < 5 else [tuple(found[i : i + 5]) for i in range(len(found) - 4)])


def near_brute(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets[i] = shingles(text)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_components(spark, edges):
    got = neardup.near_components(edges).collect()
    want = near_brute(edge_rows())
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_near_chains_and_groups(spark):
    """Copies that drift apart step by step, so links form chains, and many copies of one text."""
    rng = random.Random(5)
    now = words(rng, 150).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = list(now)
        for _ in range(2):
            now[rng.randrange(len(now))] = "w%d" % rng.randrange(10**6)
    base = words(rng, 100).split()
    for i in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(100)] = "v%d" % rng.randrange(10**6)
        rows.append((100 + i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_components(docs_of(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_likelihood_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.4, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        ra, rb = neardup.registers(a)[None], neardup.registers(b)[None]
        assert neardup.likely(ra, rb, np.array([2000.0]), np.array([2000.0]))[0] == (share > 0.58)
        both = np.maximum(neardup.registers(a[:1000]), neardup.registers(a[1000:]))
        assert (both == ra[0]).all()  # sketches of parts merge


def test_near_empty_and_drop(spark, edges):
    assert neardup.near_components(empty(spark)).count() == 0
    kept = neardup.drop_near(edges)
    assert kept.columns == edges.columns
    want = near_brute(edge_rows())
    # (None, base) is a copy of row 1; the row without words that has no identifier isn't there.
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


# 2 ------------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1))


def test_warc_round_trip(spark):
    rng = random.Random(2)
    big = words(rng, 60_000)
    rows = [(5, "http://a/ b\r\nX: y", big), (3, "http://b", big), (4, None, None), (2, "http://c", ""), (9, "http://d", "WARC/1.1\r\n\r\n0\r\n\r\n"), (8, "http://e", "é" * 5000), (7, "http://f", "same"), (7, "http://f", "same"), (10, "http://g", "same"), (None, "http://h", "alone")]
    got = warc.page_round_trip(pages_of(spark, rows).repartition(4)).collect()
    first = {}
    for page, _, html in rows:
        h = (html or "").encode()
        first[h] = min(first.get(h, 10**9), 10**9 if page is None else page)
    want = sorted(
        (page or 0, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if page in (None, first[h]) else "revisit", -1 if page in (None, first[h]) else first[h], True)
        for page, _, html in rows for h in [(html or "").encode()]
    )
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to, r.intact) for r in got) == want
    assert warc.page_round_trip(pages_of(spark, rows).filter("false")).count() == 0


def test_warc_payloads_and_broken_segments(spark, tmp_path):
    page = list(warc.page_records(1, "u", b"x" * 50_000, None, None, "d", 4096))
    assert len(page) > 10
    fields, _ = next(warc.records(page[-1]))
    assert fields["warc-segment-total-length"] and fields["warc-type"] == "continuation"
    folder = tmp_path / "archives"
    folder.mkdir()
    import gzip

    (folder / "part-0.gz").write_bytes(gzip.compress(b"".join(reversed(page[1:]))))
    (folder / "part-1.gz").write_bytes(gzip.compress(page[0]))
    row = warc.read_archives(spark, f"file://{folder}").first()
    assert bytes(row.payload) == b"x" * 50_000 and row.intact
    (folder / "part-0.gz").write_bytes(gzip.compress(b"".join(page[2:])))
    row = warc.read_archives(spark, f"file://{folder}").first()
    assert row.payload is None and not row.intact


def test_warc_damage_is_told(spark, tmp_path):
    """Bad chunks, sizes and headers, and members cut short, leave the other records as they are."""
    import gzip

    made = lambda k, body: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>"), ("X-Page-ID", k), ("WARC-Payload-Digest", "sha1:" + warc.digest32(b"fine"))], warc._HEAD + body)
    good = warc.chunked(b"fine")
    bad = [made(k, body) for k, body in enumerate([b"zz\r\nfine\r\n0\r\n\r\n", b"-4\r\nfine\r\n", b"4\r\nfine", b"9\r\nfine\r\n0\r\n\r\n", b""])]
    folded = made(10, good).replace(b"WARC-Record-ID: <10>", b"warc-record-id:\r\n <10>\r\nnonsense")
    broken = [made(11, good).replace(b"Content-Length: ", b"Content-Length: 9"), made(12, good).replace(b"Content-Length", b"Content-Size"), b"no record"]
    folder = tmp_path / "archives"
    folder.mkdir()
    (folder / "part-0.gz").write_bytes(b"".join(map(gzip.compress, [*bad, folded, *broken, made(13, good)])))
    (folder / "part-1.gz").write_bytes(gzip.compress(made(14, good)) + gzip.compress(made(15, good))[:-9])
    got = [(r.page_id, r.payload and bytes(r.payload), r.intact) for r in warc.read_archives(spark, f"file://{folder}").collect()]
    assert sorted(got, key=repr) == sorted([*((k, None, False) for k in range(5)), *((None, None, False) for _ in range(4)), *((k, b"fine", True) for k in (10, 13, 14))], key=repr)


def test_warc_members_hold_one_record_each(spark, tmp_path):
    pages = pages_of(spark, [(i, f"http://{i}", "text " * 9000 * (i % 3)) for i in range(20)])
    warc.write_archives(pages, f"file://{tmp_path}/archives")
    found = [list(warc.records(m)) for f in (tmp_path / "archives").glob("part-*") for m in warc.members(f.read_bytes())]
    assert all(len(m) == 1 for m in found) and len(found) > 20


def test_chunked_framing():
    for data in (b"", b"a", b"0\r\n\r\n" * 3000):
        assert warc.dechunked(warc.chunked(data, 7)) == data


# 3 ------------------------------------------------------------------------------------------------


def token_ids(text):
    return encoder(tokenizer_path()).tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("window, most", [(1024, 1024), (16, 4)])
def test_packing_places_every_token_once(spark, edges, window, most):
    pieces = packing.pack(edges, window=window, max_open=most).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    texts = defaultdict(list)
    for i, t in edge_rows():
        texts[i].append(t)
    for i, group in texts.items():
        want = token_ids(group[0]) + [0]
        seen = sorted(by_doc[i], key=lambda p: p.start)
        assert sum(p.length for p in seen) == len(want) * len(group)
        for p in seen:
            assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length] and p.doc_tokens == len(want)
    short = 0
    for group in by_seq.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and {p.padding for p in group} == {0 if at in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024) else window - at}
        short += at < window
    assert short <= 4  # one a task
    assert packing.pack(empty(spark)).count() == 0


def test_packing_minimises_the_sum_of_squares():
    rng = random.Random(4)
    packer = packing.Packer(20)
    for _ in range(200):
        size = rng.randint(1, 19)
        grown = {}
        for level in range(0, 21 - size):
            if level and not packer.levels[level]:
                continue
            counts = packer.levels.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 20
            grown[level] = int((counts[1:20] ** 2).sum())
        assert grown[packer.level_for(size)] == min(grown.values())
        list(packer.add(0, np.zeros(size, "<u4")))


def test_packing_fills_windows_by_levels():
    """In a task of some 100 MB, nine in ten windows that hold rests are filled by placement, not by cutting, and no token is lost."""
    rng = np.random.default_rng(5)
    sizes = np.where(rng.random(50_000) < 0.7, rng.integers(1, 1024, 50_000), rng.integers(1024, 6000, 50_000))
    packer = packing.Packer()
    rows = [row for doc, n in enumerate(sizes) for row in packer.add(doc, np.zeros(n, "<u4"))] + list(packer.drain(True))
    assert packer.filled > 0.9 * (packer.filled + packer.cut) and packer.whole == int((sizes // 1024).sum())
    at, last = defaultdict(int), defaultdict(int)
    for doc, start, ids, n, number, offset, padding in rows:
        assert n == sizes[doc] and offset == at[number]
        at[number] += len(ids)
        last[doc] += len(ids)
    assert [last[doc] for doc in range(len(sizes))] == sizes.tolist() and sum(n < 1024 for n in at.values()) <= 1 and max(at.values()) == 1024


def test_packing_fills_windows_of_the_largest_table():
    """The same share for the lengths of the largest documents table, which is one task's."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    at, _ = encoder(tokenizer_path()).encode_column(texts.chunk(0) if hasattr(texts, "chunk") else texts)
    packer = packing.Packer()
    for doc, n in enumerate(np.diff(at) + 1):
        for _ in packer.add(doc, np.zeros(n, "<u4")):
            pass
    list(packer.drain(True))
    assert packer.filled > 0.9 * (packer.filled + packer.cut)


def test_packing_places_again_before_it_cuts():
    """Windows that complete each other are joined whole; a task that holds too many open windows goes on."""
    packer = packing.Packer(16, 4)
    packer.open[10], packer.open[6] = [[(1, 0, np.zeros(10, "<u4"), 10)]], [[(2, 0, np.zeros(4, "<u4"), 4), (3, 0, np.zeros(2, "<u4"), 2)]]
    packer.levels[[10, 6]] = 1
    packer.n_open = 2
    out = list(packer.drain(True))
    assert packer.filled == 1 and packer.cut == 0 and [(r[0], r[5]) for r in out] == [(1, 0), (2, 10), (3, 14)]
    packer = packing.Packer(16, 4)
    rows = [row for doc in range(200) for row in packer.add(doc, np.zeros(1 + doc * 7 % 15, "<u4"))]
    assert packer.n_open <= 4
    rows += list(packer.drain(True))
    assert sum(len(r[2]) for r in rows) == sum(1 + doc * 7 % 15 for doc in range(200))


# 4 ------------------------------------------------------------------------------------------------


def test_language_id(spark, edges):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(50)), l) for i, (l, a) in enumerate([("aa", "abcde"), ("bb", "vwxyz")] * 30)]
    docs = docs_of(spark, rows)
    model = langid.learn(docs.filter("doc_id < 40"))
    assert list(model) == ["aa", "bb"]
    got = {r.doc_id: r for r in langid.classify(docs, model).collect()}
    assert all(got[i].lang_pred == l and 0 <= got[i].score <= 1 for i, _, l in rows)
    found = langid.classify(edges, model).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6, 14, 15)} == {"und"}
    nothing = langid.learn(empty(spark))
    assert nothing == {} and {r.lang_pred for r in langid.classify(edges, nothing).collect()} == {"und"}
    assert langid.learn(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_language_id_tells_scripts_and_their_languages_apart(spark):
    rng = random.Random(17)
    alphabets = {"ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת", "zh": "的一是不了人我在有他这为之大来以个中上们", "en": "abcdefghijklmnopqrstuvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(800)), lang) for i, (lang, a) in enumerate([*alphabets.items()] * 20)]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.lang_pred for r in langid.classify(docs, langid.learn(docs.filter("doc_id < 60"))).collect()}
    assert all(got[i] == lang for i, _, lang in rows if i >= 60)


# 5 ------------------------------------------------------------------------------------------------


def test_toxicity_grammar():
    g = toxicity.Grammar({"gronk": 3.0, "snarl*": 2.0})
    plain, *_ = g.evidence("what a gronk here")
    assert plain > 0 and g.evidence("what a snarling thing")[0] > 0 and g.evidence("nothing here")[0] == 0
    assert g.evidence("that is not a gronk")[0] < plain < g.evidence("you are a gronk")[0]
    assert g.evidence("somebody said what a gronk here")[0] < plain
    assert g.evidence("kill the lights")[0] == 0 < g.evidence("kill you")[0] and g.evidence("you will burn")[0] > 0
    assert g.evidence("not here. a gronk")[0] == g.evidence("a gronk")[0]  # clauses are apart


def test_toxicity_learns_and_scores(spark, edges):
    rng = random.Random(8)
    rows = [(i, words(rng, 60) + (" zzgronk zzgronk" if i % 4 == 0 else "")) for i in range(400)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert "zzgronk" in model["lexicon"]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i, _ in rows if i >= 200)
    scores = toxicity.score(edges, model).collect()
    assert len(scores) == len(edge_rows()) and all(0 <= r.score < 0.5 for r in scores)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 4}
    bare = toxicity.learn(empty(spark), labels.filter("false"))
    assert toxicity.score(edges, bare).count() == len(edge_rows()) and toxicity.score(empty(spark), bare).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def test_huffman_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n, limit in ((2, 4), (7, 3), (40, 6), (300, 18)):
        counts = rng.zipf(1.3, n).clip(max=10**6)
        lengths = token_file.code_lengths(counts, limit)
        assert lengths.max() <= limit and abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-12
    import heapq

    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert cost == int((counts * token_file.code_lengths(counts, 60)).sum())


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.2, n).clip(max=999).astype(np.int64)
    lengths = token_file.code_lengths(np.bincount(ids, minlength=1000), 12)
    raw, stretch = token_file.encode_bits(ids, token_file.canonical_codes(lengths), lengths)
    back = token_file.decode_bits(raw, stretch, n, token_file.decode_table(lengths))
    assert back.tolist() == ids.tolist()


@pytest.mark.parametrize("file_bytes", [1 << 25, 1 << 14])
def test_token_files(spark, edges, tmp_path, file_bytes):
    folder = f"file://{tmp_path}/files"
    token_file.write_token_files(edges, folder, file_bytes=file_bytes)
    got = token_file.read_token_files(spark, folder).collect()
    got.sort(key=lambda r: r.start)
    at = 0
    key = lambda i: -1 if i is None else i
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in edge_rows())
    texts = defaultdict(list)
    for i, t in edge_rows():
        texts[i].append(t)
    for r in got:
        want = token_ids(texts[r.doc_id][0]) + [2]
        assert r.start == at and r.n_tokens == len(want) and zlib.crc32(r.ids) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += r.n_tokens
    assert token_file.token_round_trip(empty(spark)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_chat_ties_are_ordered_as_in_sql(spark, tmp_path):
    """Turns of one place, without place, role or text, and repeated ones: nulls first, then by role and text."""
    import duckdb

    from quarry.llm import oracles, queries

    rows = [(1, 0, "user", "b"), (1, 0, None, "z"), (1, 0, "user", "a"), (1, None, "assistant", "late"), (1, 0, "assistant", "é"), (1, 0, "assistant", "z"), (1, 0, "assistant", "z"), (1, 0, "", None), (2, 5, None, None), (2, 5, None, "</s>"), (None, 1, "user", "x"), (None, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(oracles.SQL["op7_chat_format"])
    columns = [c[0] for c in found.description]
    want = sorted((dict(zip(columns, r)) for r in found.fetchall()), key=str)
    assert sorted(({c: r[c] for c in columns} for r in queries.queries()["op7_chat_format"](spark, str(tmp_path)).collect()), key=str) == want


def test_chat_escapes_are_reversible():
    rng = random.Random(9)
    parts = [*chat.CONTROL, "\\", "<", "[", "s>", "INST]", "x", " ", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        safe = chat.escape(text)
        assert not any(c in safe for c in chat.CONTROL) and chat.unescape(safe) == text


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 0, "system", "<<SYS>>"), (2, None, None, None), (2, 5, "tool", "[ROLE]"), (None, 1, "assistant", ""), (3, 0, "assistant", "é中👍" * 5000), (4, 1, "user", "x"), (4, 1, "user", "x"), *((5, 0, "user", t) for t in ("zz", "Zz", "aé", None, "a b"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("ids", F.lit("c"))
    formatted = chat.format_turns(df.repartition(3)).cache()
    got = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for _, _, t in turns)
    for r in formatted.collect():  # offsets are prefix sums
        before = [x for x in formatted.filter(F.col("conv_id").eqNullSafe(F.lit(r.conv_id))).collect() if x.place < r.place] if r.conv_id == 1 else None
        assert before is None or r.offset == sum(len(x.ids) // 4 for x in before)
    assert chat.read_conversations(chat.format_turns(df.filter("false"))).count() == 0


# 8 ------------------------------------------------------------------------------------------------


def leak_brute(docs, items, least=8):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lowered(t))
    found = set()
    for d, text in docs:
        a = cut(text)
        for i, passage in items:
            b = cut(passage)
            if len(b) < least or not b:
                continue
            need = min(20, len(b))
            share = 0.8 if need >= 8 else 1
            for x in range(len(a) - need + 1):
                if any(sum(p == q for p, q in zip(a[x : x + need], b[y : y + need])) >= share * need for y in range(len(b) - need + 1)):
                    found.add((d, i))
                    break
    return found


def test_seeds_hit_every_tolerated_stretch():
    for n in range(decontam.LEAST, decontam.STRETCH + 1):
        for changed in itertools.combinations(range(n), n - math.ceil(decontam.SHARE * n - 1e-9)):
            assert any(all(p + i not in changed for i in mask) for mask, span in zip(decontam.SEEDS, decontam.SPANS) for p in range(n - span + 1)), (n, changed)


def test_leaks(spark, edges):
    rng = random.Random(11)
    items = [(i, words(rng, n)) for i, n in enumerate((30, 12, 50, 8, 5))] + [(7, None), (8, ""), (9, "a b c d e f g")]
    rows = []
    for k in range(30):
        passage = items[k % 5][1].split()
        cut = passage[3:27] if k % 2 and len(passage) > 25 else passage
        cut = list(cut)
        for _ in range(k % 4):
            cut[rng.randrange(len(cut))] = "other"
        rows.append((100 + k, words(rng, 40) + " " + " ".join(cut).title() + ", " + words(rng, 10)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3)).withColumn("hash", F.lit(2))
    docs = docs_of(spark, rows + edge_rows())
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, least=8).collect()}
    want = leak_brute(rows, items)
    assert got == want
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == leak_brute(rows + edge_rows(), items, 1) > want
    clean = decontam.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in rows + edge_rows()} - {d for d, _ in got}
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs, bench.filter("false")).count() == 0


def test_leaks_of_short_items(spark):
    """Items of one to seven words occur as they stand or not at all; each document counts once, at the first place."""
    rng = random.Random(23)
    names = ["ab", "cd", "ef"]
    run = lambda n: " ".join(rng.choice(names) for _ in range(n))
    items = [(n, run(n)) for n in range(1, 8)] + [(20, "ab"), (21, "AB"), (22, None), (23, " . "), (24, "zz"), (25, run(9))]
    rows = [(k, run(rng.randint(0, 40))) for k in range(60)] + [(60, None), (61, ""), (62, "ab " * 5000), (63, "AB, cd. Ab"), (63, "ef"), (None, "ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs_of(spark, rows).repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leak_brute(rows, items, 1) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    texts = dict(rows[:60])
    for r in got:
        if r.doc_id is not None and r.doc_id < 60 and r.item_id < 8:
            a, b = texts[r.doc_id].split(), items[r.item_id - 1][1].split()
            assert (r.equal_words, r.stretch_words, r.similarity) == (len(b), len(b), 1.0)
            assert r.first_word == next(x for x in range(len(a)) if a[x : x + len(b)] == b)
    assert decontam.drop_leaks(docs_of(spark, rows[:5]), bench.filter("item_id < 8")).count() == 5
    assert decontam.drop_leaks(docs_of(spark, rows), bench.filter("item_id = 1"), least=1).count() == len(rows) - sum(1 for r in rows if items[0][1] in re.findall("[a-z]+", (r[1] or "").lower()))


# 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [None, lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1).alias("d"))])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(spark, edges, digest, keep):
    """The second digest has sixteen values, so most texts collide and only bytes tell them apart."""
    got = exactdup.exact_groups(edges, keep=keep, digest=digest, memtable_rows=5).collect()
    groups = defaultdict(list)
    for i, t in edge_rows():
        groups[lowered(t)].append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "max" else min)(known)
        want += [(i or -1, stays, len(ids), i == stays, hashlib.sha256(text).hexdigest()) for i in ids]
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_exact_drop_and_empty(spark, edges):
    assert exactdup.exact_groups(empty(spark)).count() == 0
    kept = exactdup.drop_exact(edges)
    assert kept.columns == edges.columns
    assert len({lowered(r.text) for r in kept.collect()}) == len({lowered(t) for _, t in edge_rows()})


# 10 -----------------------------------------------------------------------------------------------


def repeat_brute(rows, length=100):
    seen, out = {}, {}
    order = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    for i, text in order:
        raw = text.encode()
        marks = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                marks[at : at + length] = b"\1" * length
            else:
                seen[s] = (i, at)
        kept = bytes(c for c, m in zip(raw, marks) if not m)
        spans = sum(1 for k in range(len(marks)) if marks[k] and (not k or not marks[k - 1]))
        out[i] = (len(raw), sum(marks), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [6 << 20, 3000, 150])
def test_repeats(spark, shard_bytes):
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(i, words(rng, rng.randint(0, 80)) + " " + passage[rng.randint(0, 40) : rng.randint(150, 300)] + words(rng, 20)) for i in range(25)]
    rows += [(i + 100, t) for i, t in edge_rows() if i is not None and i not in (9, 10)] + [(None, rows[3][1]), (300, "abc" * 200), (301, "bca" * 200), (302, passage * 3)]
    got = suffixdup.without_repeats(docs_of(spark, rows).repartition(3), shard_bytes=shard_bytes).collect()
    want = repeat_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_of_rows_that_share_an_identifier(spark):
    """Rows of one identifier and different texts don't repeat each other, but both repeat an earlier document."""
    rng = random.Random(16)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(1, passage + words(rng, 30)), (5, passage + " x " + other), (5, passage + " y " + other), (9, other[:200]), (9, other[:200])]
    got = sorted((r.doc_id, r.n_removed >= len(passage), r.n_removed) for r in suffixdup.without_repeats(docs_of(spark, rows)).collect())
    assert [g[:2] for g in got[:3]] == [(1, False), (5, True), (5, True)] and got[1][2] < len(passage) + 90
    assert [g[2] for g in got[3:]] == [200, 200]


def test_repeats_long_and_empty(spark, edges):
    rng = random.Random(13)
    long = words(rng, 300_000)
    rows = [(1, long), (2, long[500_000:700_000] + words(rng, 50))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdup.without_repeats(docs_of(spark, rows)).collect()}
    assert got[1][1] == 0 and got[2][1] >= 200_000 and got[2][2] >= 1
    assert suffixdup.without_repeats(empty(spark)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(14)
    for _ in range(200):
        text = bytes(rng.choice([0, 97, 98]) for _ in range(rng.randint(1, 80)))
        data = np.frombuffer(text, np.uint8)
        order = suffixdup.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        before = np.full(len(text), -1)
        before[order[1:]] = order[:-1]
        shared = suffixdup.common_prefixes(np.append(data, 255), np.append(before, -1), np.append(np.ones(len(text), bool), False), np.array([0]), np.array([len(text)]), 5)
        for i in range(len(text)):
            n = 0
            while before[i] >= 0 and n < 5 and i + n < len(text) and before[i] + n < len(text) and text[i + n] == text[before[i] + n]:
                n += 1
            assert shared[i] >= n


# 9, the index -------------------------------------------------------------------------------------


def test_index_runs_levels_and_filters(spark, tmp_path):
    rng = random.Random(15)
    rows = [(i, rng.randbytes(8) if i % 3 else bytes([i % 7])) for i in range(3000)]
    df = spark.createDataFrame([(i, d, i % 40) for i, d in rows], "id long, digest binary, run int")
    index = exactdup.DigestIndex(spark, f"file://{tmp_path}/index")
    index.flush(df, 40)
    merged = {bytes(r.digest): (r.id, r.n) for r in index.compact().collect()}
    assert index.top == 2 and index.runs == 1  # 40 runs, then 3, then 1
    want = {}
    for i, d in rows:
        want[d] = (max(i, want.get(d, (0, 0))[0]), want.get(d, (0, 0))[1] + 1)
    assert merged == want
    for level, runs in ((0, 40), (1, 3), (2, 1)):
        folders = list((tmp_path / "index" / f"level{level}").glob("run=*"))
        assert len(folders) == runs
        for folder in folders:
            kept = [[r["digest"] for r in pq.read_table(f, partitioning=None).to_pylist()] for f in sorted(folder.glob("*.parquet"))]
            assert all(part == sorted(part) for part in kept) and (level or len(kept) == 1)
    assert {bytes(r.digest): r.n for r in index.lookup([b"\0", rows[1][1], b"none"]).collect()} == {b"\0": want[b"\0"][1], rows[1][1]: 1}
    some = df.filter("id % 10 = 0")
    parts = [[bytes(r.digest) for r in part.collect()] for part in common.asked(df, F.col("digest"), common.bit_filter(some, "digest"))]
    wanted = {d for i, d in rows if i % 10 == 0}
    assert wanted <= set(parts[0]) and len(set(parts[0])) < len(wanted) + 50 and sorted(parts[0] + parts[1]) == sorted(d for _, d in rows)
