"""Near-duplicate components from SetSketch registers.

A document's set holds its distinct five-word shingles. A SetSketch register keeps, of hash values
turned exponential, the minimum on an exponential scale, truncated to a range: K = floor(1 -
log_b(min)), so sketches of parts merge by the maximum. Registers of two sets are equal with a
probability close to their Jaccard similarity. Four registers make a band; documents that agree in
a band are candidates. The joint likelihood of all registers, given both exact set sizes, drops
candidates whose similarity is surely too small; the rest is confirmed on the full sets.

Equal sets are one node. A bucket of a band is searched without listing its pairs: its members are
compared with a hub, components of confirmed links are formed, and buckets whose other members are
in several components go on: first the members in the bucket's smallest components are hubs, then
what is still mixed is dealt out in blocks of bounded size, which compare members of different
components and give back links alone. So no link between components is left out.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; a text of fewer than
five words has the whole sequence as its shingle; null text or text without words has an empty set
and no links. Rows with equal sets are one node. In the listing, a row without identifier gets no
component and counts as kept; when rows are dropped, it is compared like any other and loses to identified ones, and
of rows repeated with one identifier (or none) and text one stays. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import mix64, one_of_each, seeded, slices, staged, text_bytes, without_lost, word_hashes
from quarry.llm.tokens import forget

WORDS = 5
NUMER, DENOM = 75, 100
BANDS, ROWS = 36, 4
REGISTERS = BANDS * ROWS
BASE = 1.005
RATE = 20.0
#: Similarity that a pair's likelihood must not place it below; four and a half standard errors under 0.75.
LEAST_LIKELY = 0.58
#: How often two members of a bucket's smallest components are compared with its others.
HUB_ROUNDS = 1
#: Limits of the blocks in which buckets that are still mixed are searched.
BLOCK_NODES = 1024
BLOCK_BYTES = 24 << 20

_U = np.uint64
_MULT = (seeded(REGISTERS, 31) >> _U(16)).astype(np.uint32) | np.uint32(1)
_MASK = (seeded(REGISTERS, 32) >> _U(20)).astype(np.uint32)
_TURN = seeded(WORDS + 1, 33)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, at = word_hashes(raw, offs)
    n = len(h)
    runs = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        runs += h[i : i + len(runs)] * _TURN[i]
    runs = mix64(runs)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            found = np.sort(runs[a : b - words + 1])
            yield found[np.diff(found, prepend=~found[:1]) != 0]
        elif b > a:
            yield mix64(np.array([(h[a:b] * _TURN[: b - a]).sum(dtype=np.uint64) + _U(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    x = (hashes >> _U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, ((x[None, i : i + 4096] ^ _MASK[:, None]) * _MULT[:, None]).min(axis=1))
    expo = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(expo) / np.log(BASE)), 0, 65535).astype("<u2")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float = LEAST_LIKELY) -> np.ndarray:
    """Whether the most likely similarity of register rows ``a`` and ``b`` is ``at`` or more.

    The log-likelihood is concave in the similarity, so its slope at ``at`` tells.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    log_b = np.log(BASE)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * c) / log_b

    def slope(x):
        return c / ((1 - np.clip(x, 1e-12, 1) * c) * log_b)

    xa, xb = u - v * at, v - u * at
    fits = (xa > 0) & (xb > 0)
    up, down = p(xa), p(xb)
    equal = np.maximum(1 - up - down, 1e-12)
    grad = -v * slope(xa) * above / up - u * slope(xb) * below / down + same * (v * slope(xa) + u * slope(xb)) / equal
    return fits & (grad >= 0)


def _text_hash(text_col: str) -> Column:
    """Tells rows of one identifier apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp, regs, text_hash): set size, 128-bit digest of the set, its registers, and the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            offs, raw = text_bytes(batch.column(1))
            for i, j in slices(offs):
                n, fp, regs = [], [], []
                for found in shingle_sets(raw, offs[i : j + 1]):
                    n.append(len(found))
                    fp.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    regs.append(registers(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()), batch.column(2).slice(i, j - i)], names=["id", "n", "fp", "regs", "text_hash"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), _text_hash(text_col).alias("text_hash")).mapInArrow(run, "id long, n long, fp binary, regs binary, text_hash long")


def _band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band of each node."""
    salt = seeded(BANDS, 34)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
                keys = mix64(regs * _U(0x9E3779B97F4A7C15) + salt).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def _keep_likely(pairs: DataFrame) -> DataFrame:
    """(u, v) whose registers allow a link; ``pairs`` has u, v, nu, nv, ru, rv."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
                na, nb = part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float)
                sizes = DENOM * np.minimum(na, nb) >= NUMER * np.maximum(na, nb)
                keep = pa.array(sizes & likely(a, b, na, nb))
                yield part.select([0, 1]).filter(keep)

    return pairs.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame) -> DataFrame:
    """(u, v) whose full sets are similar enough; ``pairs`` has u, v, su, sv."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(DENOM * both >= NUMER * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the given nodes (node, rid, text_hash, fp), from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, raw = text_bytes(batch.column(2))
            digests = batch.column(1).to_pylist()
            for i, j in slices(offs):
                found = [s.astype("<u8").tobytes() for s in shingle_sets(raw, offs[i : j + 1])]
                keep = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(found, digests[i:j])], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.binary())], names=["node", "set"]).filter(keep)

    texts = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("text"))
    # Neither side has a size bound, so neither may be broadcast.
    known = texts.hint("merge").join(nodes.hint("merge"), "rid").select("node", "fp", "text")
    unnamed = nodes.filter("rid IS NULL")
    if not unnamed.isEmpty():
        # Rows without identifier are found by their text's hash, one of each text (reduced in the tasks first).
        of_text = texts.filter("rid IS NULL").groupBy(_text_hash("text").alias("text_hash")).agg(F.first("text").alias("text"))
        known = known.union(of_text.hint("merge").join(unnamed.hint("merge"), "text_hash").select("node", "fp", "text"))
    return known.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of ``edges`` (u, v).

    Alternates neighbours' smallest label with a jump to the label's own label; each round is
    written out, so a round lost with its executors is not computed from the start.
    """
    both = staged(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "near-edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(jump, "label").select("node", F.least("label", "near", "far").alias("next"), "label")
        new = staged(new, "near-labels")
        moved = not new.filter("next <> label").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets whose members are in more than one component."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return staged(labelled.join(staged(mixed, "near-mixed"), "key").select("key", "node", "label"), "near-open")


def _block_links(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (u, v) between components, from buckets dealt out in blocks of bounded size.

    A pair is compared in the block of the first band that both share, and only while its nodes
    are in different components; blocks give links back, never their pairs.
    """
    info = nodes.select("node", "n", "regs").join(sets, "node")
    blocks = members.join(info.select("node", "n"), "node").groupBy("key").agg(F.ceil(F.greatest(F.sum(F.col("n") * 8 + 400) / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_NODES)).cast("int").alias("blocks"))
    dealt = members.join(staged(blocks, "near-blocks"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label").join(info, "node")
    salt = seeded(BANDS, 34)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        key, first, second = (k.as_py() for k in key)
        table = table.sort_by("node")
        node, label, n, own = (table.column(c).to_numpy() for c in ("node", "label", "n", "own"))
        label = label.copy()
        raw = b"".join(table.column("regs").to_pylist())
        regs = np.frombuffer(raw, "<u2").reshape(-1, REGISTERS)
        bands = mix64(np.frombuffer(raw, "<u8").reshape(-1, BANDS) * _U(0x9E3779B97F4A7C15) + salt).view(np.int64)
        band = int(np.argmax((bands == key).all(axis=0)))
        full = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("set")]
        us, vs = [], []
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            fits = (label[j] != label[i]) & (DENOM * np.minimum(n[j], n[i]) >= NUMER * np.maximum(n[j], n[i]))
            if first != second:
                fits &= own[j] != own[i]
            j = j[fits]
            j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            if len(j):
                j = j[likely(regs[j], regs[i][None], n[j].astype(float), np.full(len(j), float(n[i])))]
            for at in range(0, len(j), 256):
                part = [full[x] for x in j[at : at + 256]]
                found = np.concatenate(part)
                where = np.searchsorted(full[i], found)
                hit = full[i][np.minimum(where, len(full[i]) - 1)] == found
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, part)])[:-1])
                for x in j[at : at + 256][DENOM * both >= NUMER * (n[i] + n[j[at : at + 256]] - both)]:
                    if label[x] != label[i]:
                        label[label == label[x]] = label[i]
                        us.append(int(min(node[i], node[x])))
                        vs.append(int(max(node[i], node[x])))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def _hubs(rest: DataFrame) -> DataFrame:
    """(key, u, lu): of each bucket's two smallest components (by members there) the smallest member, found by aggregates alone."""
    groups = rest.groupBy("key", "label").agg(F.struct(F.count(F.lit(1)).alias("size"), F.min("node").alias("u")).alias("hub"))
    groups = staged(groups.select("key", F.struct("hub.size", "hub.u", F.col("label").alias("lu")).alias("hub")), "near-groups")
    first = staged(groups.groupBy("key").agg(F.min("hub").alias("first")), "near-first")
    second = groups.join(first, "key").filter("hub > first").groupBy("key").agg(F.min("hub").alias("hub"))
    return first.withColumnRenamed("first", "hub").union(second).select("key", "hub.u", "hub.lu")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and for each set (fp) the identifier and text hash of the row that stays of its component."""
    found = staged(sketches(docs, id_col, text_col), "near-sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")).alias("first")
    nodes = found.filter("n > 0").groupBy("fp").agg(first, F.min("n").alias("n"), F.first("regs").alias("regs"))
    nodes = nodes.select("fp", "first", F.col("first.id").alias("rid"), F.col("first.text_hash").alias("text_hash"), "n", "regs")
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    keys = _band_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter("size > 1").select("key", "hub")
    members = staged(keys.join(staged(shared, "near-buckets"), "key"), "near-members")
    wanted = members.select("node").distinct()
    sets = staged(_sets(docs, staged(nodes.join(wanted, "node", "left_semi").select("node", "rid", "text_hash", "fp"), "near-wanted"), id_col, text_col), "near-sets")
    sketch = nodes.select("node", "n", "regs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketch.toDF("v", "nv", "rv"), "v").join(sketch.toDF("u", "nu", "ru"), "u")
        pairs = staged(_keep_likely(pairs), "near-likely")
        pairs = pairs.join(sets.toDF("v", "sv"), "v").join(sets.toDF("u", "su"), "u")
        return staged(_confirmed(pairs), "near-links")

    links = confirmed(members.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    labels = components(links)
    rest = members.filter("node <> hub").select("key", "node")
    for _ in range(HUB_ROUNDS):
        rest = _unresolved(rest, labels)
        hubs = staged(_hubs(rest), "near-hubs")
        pairs = rest.join(hubs, "key").filter("label <> lu").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
        links = links.union(confirmed(pairs))
        labels = components(links)
        rest = rest.join(hubs.select("key", F.col("u").alias("node")), ["key", "node"], "left_anti").select("key", "node")
    rest = _unresolved(rest, labels)
    if not rest.isEmpty():
        links = links.union(staged(_block_links(rest, nodes, sets), "near-links"))
        labels = components(links)

    label = nodes.select("node", "fp", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = label.groupBy("label").agg(F.min("first").alias("least"))
    return found, staged(label.join(staged(least, "near-least"), "label").select("fp", F.col("least.id").alias("component_id"), F.col("least.text_hash").alias("component_text")), "near-by-set")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    found, by_set = _linked(docs, id_col, text_col)
    out = found.select("id", "n", "fp").join(by_set, "fp", "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("id").isNull() | (F.col("id") == own)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each component (with the smallest identifier), with all columns; texts without words stay."""
    found, by_set = _linked(docs, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_text"))
    # Rows of one identifier may hold different texts, so the text's hash is part of the key.
    decided = staged(found.filter("n > 0").select("id", "fp", "text_hash").join(by_set, "fp").select(F.col("id").alias("lost_id"), F.col("text_hash").alias("lost_text"), stays.alias("stays")), "near-decided")
    left = without_lost(docs, decided.filter("NOT stays").drop("stays"), id_col, _text_hash(text_col), nulls=True)
    repeated = decided.filter("stays").groupBy("lost_id", "lost_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return one_of_each(left, repeated, id_col, _text_hash(text_col))
