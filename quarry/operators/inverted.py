"""An inverted index that is stored, checked against the corpus and read in part.

Documents are dealt to shards by their identifier. Within a shard they are numbered in order; a term's
postings (number, frequency, length) lie in blocks of fixed size with the numbers delta-coded, and a block
knows its range of numbers, its greatest frequency and its least length, hence the most that BM25 can give
for it. A shard's documents are kept in the same way, as postings of no term whose frequency is the length. A query
goes over a shard's stretches of numbers in the order of what they can give at most, and
stops where that is below its k-th score; blocks that no such stretch touches are never decoded.

Texts are tokenised once: tasks count the tokens of many documents and hand on one coded row for each shard and
term, and those rows, not postings, are shuffled and merged into blocks.

Every shard has a version with a fingerprint of the documents that it was made from. ``refresh`` compares
those with the live documents and makes anew only the shards that differ; a query that finds a stale shard
is refused. The statistics BM25 needs (document frequencies, number, mean length) add up over shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.operators import retrieval as V
from quarry.operators.buckets import exists
from quarry.operators.graphs import small
from quarry.operators.runs import _slices

#: Postings of a block, the most stretches of a shard that a query tells apart, and how many tokens or postings a task handles at once.
BLOCK, STRETCHES, _TOKENS, _POSTINGS = 128, 128, 1 << 20, 1 << 18
_BLOCKS = f"term string, first long, last long, n int, most_tf int, least_len int, copies int, total long, postings binary"
_WRAP = 1 << 40


class StaleIndex(RuntimeError):
    """The corpus has changed since the index was made."""


def _encoded(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Blocks of numbers that start at ``begin``, as bytes: seven bits a byte, low ones first, the top bit telling that more follow."""
    size = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in range(7, 63, 7))
    starts = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(starts, size)
    data = ((np.repeat(values.astype(np.int64), size) >> (7 * place)) & 127) | np.where(place < np.repeat(size, size) - 1, 128, 0)
    offsets = np.append(starts[begin], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data.astype(np.uint8))])


def _decoded(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    begins = np.append(0, ends[:-1] + 1)[: len(ends)]
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins) if len(data) else np.zeros(0, np.int64)


def _postings(first: np.ndarray, n: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, frequencies and lengths of all postings of coded blocks, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    gaps, tf, size = _decoded(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]).reshape(-1, 3).T
    done = np.cumsum(gaps)
    return done + np.repeat(first - done[np.cumsum(n) - n], n), tf, size


def _fingerprints(docs: DataFrame, doc: str, text: str, shards: int) -> DataFrame:
    """(shard, docs, print) of the live documents: sums of row hashes, whatever the order."""
    hashed = docs.select(F.pmod(F.col(doc), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(F.col(doc), F.col(text).isNull(), F.col(text)).alias("h"))
    sums = hashed.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), (F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))) % _WRAP).alias("a"), (F.sum(F.shiftrightunsigned("h", 32)) % _WRAP).alias("b"), F.bit_xor("h").alias("c"))
    return sums.select("shard", "docs", F.concat_ws(":", *(F.col(x).cast("string") for x in ("docs", "a", "b", "c"))).alias("print"))


class InvertedIndex:
    """Under ``folder``: blocks and documents of each shard's versions, and a log of versions with fingerprints."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = 16):
        self.spark, self.folder, self.shards = spark, folder, shards

    def _log(self) -> DataFrame:
        schema = "shard int, docs long, print string, length long, version int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/log") if exists(self.spark, f"{self.folder}/log") else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """(shard, version, docs, print, length) of each shard's newest version."""
        best = self._log().groupBy("shard").agg(F.max(F.struct("version", "docs", "print", "length")).alias("v"))
        return best.select("shard", "v.*").filter("docs > 0")

    def _compared(self, docs: DataFrame, doc: str, text: str) -> list:
        """(shard, docs, live) of the shards whose stored fingerprint isn't that of the live documents, vanished ones too."""
        live = _fingerprints(docs, doc, text, self.shards).withColumnRenamed("print", "live")
        both = live.join(self.versions().select("shard", F.col("print").alias("kept")), "shard", "full_outer")
        return both.filter(~F.col("live").eqNullSafe(F.col("kept"))).select("shard", F.coalesce("docs", F.lit(0)).alias("docs"), "live").orderBy("shard").collect()  # at most all shards

    def stale(self, docs: DataFrame, doc: str, text: str) -> list[int]:
        """Shards whose stored fingerprint isn't that of the live documents, vanished ones too."""
        return [r.shard for r in self._compared(docs, doc, text)]

    def refresh(self, docs: DataFrame, doc: str, text: str, tokens: str) -> list[int]:
        """Makes the stale shards anew from ``docs`` (doc, text, tokens); gives their numbers."""
        found = self._compared(docs, doc, text)
        stale = [r.shard for r in found]
        if not stale:
            return []
        version = (self._log().agg(F.max("version")).first()[0] or 0) + 1
        shard = F.pmod(F.col(doc), F.lit(self.shards)).cast("int")
        mine = docs.filter(shard.isin(stale)).select(shard.alias("shard"), F.col(doc).cast("long").alias("doc"), F.col(tokens).alias("tokens"))
        at = f"version={version}"

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (_part(rows) for batch in batches for rows in _slices(batch, 2, _TOKENS) if len(rows))

        counted = mine.mapInArrow(parts, f"shard int, term string, first long, n int, postings binary")
        # All of a term in a shard, or a shard's list of documents, is merged in one task, which shards are sized for.
        # Numbers are sorted faster than words; any order will do that brings the rows of a term together.
        together = counted.repartition("term", "shard").withColumn("h", F.xxhash64("term", "shard")).sortWithinPartitions("h", "term", "shard").drop("h")
        made = together.mapInArrow(_blocks, f"shard int, {_BLOCKS}")
        made.write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/blocks/{at}")
        lengths = self.spark.read.schema(f"{_BLOCKS}, shard int").parquet(f"{self.folder}/blocks/{at}").filter("term IS NULL").groupBy("shard").agg(F.sum("total").alias("length"))
        log = self.spark.createDataFrame(found, "shard int, docs long, print string").join(lengths, "shard", "left")
        log.select("shard", "docs", "print", F.coalesce("length", F.lit(0)).alias("length")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{at}")
        return stale

    def blocks(self) -> DataFrame:
        """All blocks of the newest versions; those without term list the documents."""
        now = F.broadcast(self.versions().select("shard", "version"))  # a row for each shard
        schema = T._parse_datatype_string(f"{_BLOCKS}, version int, shard int")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/blocks").join(now, ["shard", "version"]).drop("version")

    def top(self, terms: DataFrame, k: int, live: tuple[DataFrame, str, str] | None = None) -> DataFrame:
        """(query, doc, score, rank, decoded, blocks): the ``k`` best of each query in ``terms`` (query, term), and how many of its blocks were decoded.

        With ``live`` (documents, doc, text), a stale index raises ``StaleIndex``.
        """
        if live is not None and (stale := self.stale(*live)):
            raise StaleIndex(f"shards {stale} are stale")
        sizes = self.versions().agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
        n_docs, mean = sizes.docs or 0, (sizes.length / sizes.docs if sizes.docs else 1.0)
        held = self.blocks()
        df = held.join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
        asked = held.join(small(terms.select("query", "term").join(df, "term")), "term").drop("total")
        kind = terms.schema["query"].dataType.simpleString()

        def best(key: tuple, table: pa.Table) -> pa.Table:
            docs, scores, decoded = _best_of_shard(table, k, n_docs, mean)
            one = len(docs) or 1
            docs, scores = (docs, scores) if len(docs) else ([None], [None])
            return pa.table({"query": pa.array([key[0].as_py()] * one, table.schema.field("query").type), "doc": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.float64()), "decoded": pa.array([decoded] + [0] * (one - 1), pa.int64()), "blocks": pa.array([len(table)] + [0] * (one - 1), pa.int64())})

        found = asked.groupBy("query", "shard").applyInArrow(best, f"query {kind}, doc long, score double, decoded long, blocks long")
        # Rows without document only count blocks; they rank last.
        of = Window.partitionBy("query")
        counted = found.select("query", "doc", "score", F.sum("decoded").over(of).alias("decoded"), F.sum("blocks").over(of).alias("blocks"))
        return V.top(counted, ["query"], k).filter("doc IS NOT NULL").select("query", "doc", "score", "rank", "decoded", "blocks")


def _packed(begin: np.ndarray, doc: np.ndarray, tf: np.ndarray, size: np.ndarray) -> dict[str, pa.Array]:
    """Postings in order, as coded rows that start at ``begin``."""
    gaps = np.diff(doc, prepend=0)
    gaps[begin] = 0
    return {"first": pa.array(doc[begin]), "n": pa.array(np.diff(begin, append=len(doc)), pa.int32()), "postings": _encoded(np.stack([gaps, tf, size], axis=1).ravel(), 3 * begin)}


def _part(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some documents (shard, doc, tokens): a coded row for each shard and term, and one without term for each shard's documents."""
    shard, doc = (rows.column(i).to_numpy() for i in (0, 1))
    size = rows.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((doc, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    coded = rows.column(2).flatten().dictionary_encode()
    known, ids = coded.dictionary, coded.indices
    key = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) * len(order) + np.repeat(place, size)
    key, tf = np.unique(key[key >= 0] if ids.null_count else key, return_counts=True)
    term, at = np.append(key // len(order), np.full(len(order), len(known))), np.append(order[key % len(order)], order)
    begin = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(shard[at]) != 0)))
    made = _packed(begin, doc[at], np.append(tf, size[order]), size[at])
    made |= {"shard": pa.array(shard[at[begin]]), "term": known.take(pa.array(term[begin], mask=term[begin] == len(known)))}
    names = ["shard", "term", "first", "n", "postings"]
    return pa.RecordBatch.from_arrays([made[c] for c in names], names=names)


def _heads(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where another term or shard begins."""
    term = rows.column("term")
    term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(rows.column("shard").to_numpy()) != 0)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from coded rows; those of a term and shard follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(_heads(batch)[-1])
        if held and len(_heads(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]))) > 1:
            yield from _merged(held)
            held = []
        # The last term of a batch may go on in the next one.
        if cut:
            yield from _merged([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _merged(held)


def _merged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole terms of shards, some terms at a time."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    heads, n = _heads(rows), rows.column("n").to_numpy().astype(np.int64)
    piece = (np.cumsum(n) - n)[heads] // _POSTINGS
    cuts = np.append(heads[np.append(True, np.diff(piece) > 0)], len(rows))
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield _merged_piece(rows.slice(low, high - low), heads[(heads >= low) & (heads < high)] - low)


def _merged_piece(rows: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
    n = rows.column("n").to_numpy().astype(np.int64)
    doc, tf, size = _postings(rows.column("first").to_numpy(), n, rows.column("postings").combine_chunks())
    group = np.repeat(np.repeat(np.arange(len(heads)), np.diff(heads, append=len(rows))), n)
    order = np.lexsort((size, doc, group))
    doc, tf, size, group = doc[order], tf[order], size[order], group[order]
    other = np.append(True, (np.diff(group) != 0) | (np.diff(doc) != 0))
    # Rows that share identifier and length are one document.
    once = np.flatnonzero(other | np.append(True, np.diff(size) != 0))
    doc, tf, size, group, other = doc[once], np.add.reduceat(tf, once), size[once], group[once], other[once]
    same = np.diff(np.flatnonzero(np.append(other, True)))
    copies = np.repeat(same, same)
    start = np.flatnonzero(np.append(True, np.diff(group) != 0))
    begin = np.flatnonzero((np.arange(len(doc)) - np.repeat(start, np.diff(start, append=len(doc)))) % BLOCK == 0)
    made = _packed(begin, doc, tf, size)
    made |= {c: rows.column(c).combine_chunks().take(pa.array(heads[group[begin]])) for c in ("shard", "term")}
    made |= {"last": pa.array(doc[np.append(begin[1:], len(doc)) - 1]), "total": pa.array(np.add.reduceat(tf, begin))}
    made |= {c: pa.array(f.reduceat(v, begin), pa.int32()) for c, f, v in (("most_tf", np.maximum, tf), ("least_len", np.minimum, size), ("copies", np.maximum, copies))}
    names = ["shard", "term", "first", "last", "n", "most_tf", "least_len", "copies", "total", "postings"]
    return pa.RecordBatch.from_arrays([made[c] for c in names], names=names)


def _weight(tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (V.K1 + 1) / (tf + V.K1 * (1 - V.B + V.B * size / mean))


def _best_of_shard(table: pa.Table, k: int, n_docs: int, mean: float) -> tuple[list, list, int]:
    """The k best documents of one query in one shard, their scores, and the number of blocks decoded."""
    first, last, count, df, copies = (table.column(c).to_numpy() for c in ("first", "last", "n", "df", "copies"))
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    bound = copies * _weight(table.column("most_tf").to_numpy().astype(float), table.column("least_len").to_numpy(), idf, mean)
    # Stretches of document numbers, as many as there are edges of blocks up to a fixed number, and what they give at most:
    # of each term, the most that a block which touches the stretch can give.
    edges = np.unique(np.concatenate([first, last + 1]))
    edges = np.append(edges[: -1 : -(-len(edges) // STRETCHES)], edges[-1])
    low, high = np.searchsorted(edges, first, "right") - 1, np.searchsorted(edges, last, "right")
    spans = high - low
    block = np.repeat(np.arange(len(first)), spans)
    where = np.arange(len(block)) - np.repeat(np.cumsum(spans) - spans - low, spans)
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    most = np.zeros((term.max() + 1, len(edges) - 1))
    np.maximum.at(most, (term[block], where), bound[block])
    gives = most.sum(axis=0)
    raw, opened, visited = table.column("postings").combine_chunks(), np.zeros(len(first), bool), np.zeros(len(gives), bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0)
    rest = (np.zeros(0, np.int64), np.zeros(0))
    order, at = np.argsort(-gives, kind="stable"), 0
    # One stretch at first, then twice as many each time, so there are few steps even where nothing can be left out.
    while at < len(order):
        # Scores are rounded to six places, so a stretch that may still tie is looked at.
        here = order[at : 2 * at + 1]
        here = here[(gives[here] > 1e-12) & (gives[here] >= (scores[-1] - 2e-6 if len(scores) == k else 0))]
        if not len(here):
            break
        at, visited[here] = 2 * at + 1, True
        new = np.unique(block[visited[where]])
        new = new[~opened[new]]
        opened[new] = True
        numbers, tf, size = _postings(first[new], count[new], raw.take(pa.array(new)))
        parts = _weight(tf.astype(float), size, np.repeat(idf[new], count[new]), mean)
        # What opened blocks hold of other stretches waits until those are visited.
        numbers, parts = np.append(rest[0], numbers), np.append(rest[1], parts)
        now = visited[np.searchsorted(edges, numbers, "right") - 1]
        rest = numbers[~now], parts[~now]
        found, of = np.unique(numbers[now], return_inverse=True)
        docs, scores = np.append(docs, found), np.append(scores, np.round(np.bincount(of, parts[now]), 6))
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
    return docs.tolist(), scores.tolist(), int(opened.sum())
