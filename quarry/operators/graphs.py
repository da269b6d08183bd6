"""Trees, graphs and concept dictionaries as joins; iterations write their state out each round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.runs import bit_set, runs_in

_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by ``checkpoint()`` in the folder that the cluster names; local runs get one of their own."""
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and context.getCheckpointDir() is None:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="quarry-graph-"))
                atexit.register(shutil.rmtree, _own[0], True)
            context.setCheckpointDir(f"file://{_own[0]}")
        else:
            context.setCheckpointDir(f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """``df`` worked out and counted; it travels to the other side of a join only if it has no more than ``rows`` rows."""
    made = cut(df)
    return F.broadcast(made) if made.count() <= rows else made


def ancestors_all(tree: DataFrame, node: str, parent: str, allowed: Column, rounds: int = 40) -> DataFrame:
    """(node, allowed, cyclic): whether the node and all its ancestors are allowed.

    Pointers jump twice as far each round, so ``rounds`` cover 2**rounds ancestors. A node whose
    pointer never reaches the root is on or below a cycle, and denied; a missing parent ends the path.
    """
    known = tree.select(F.col(node).alias("n"), F.col(parent).alias("p"), allowed.alias("ok"))
    none = F.lit(None).cast(known.schema["p"].dataType).alias("p")
    here = known.select(F.col("n").alias("p"))
    inner = known.filter("p IS NOT NULL").join(here.withColumn("there", F.lit(True)), "p", "left").withColumn("p", F.when(F.col("there"), F.col("p"))).select("n", "p", "ok")
    state = cut(inner.unionByName(known.filter("p IS NULL").select("n", none, "ok")))
    before = -1
    for _ in range(rounds):
        far = state.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("ok").alias("pok"))
        # Rows that are done have no pointer: they stay where they are, for in a join they would all meet in one task.
        live = state.filter("p IS NOT NULL").join(far, "p", "left").select("n", F.col("pp").alias("p"), (F.col("ok") & F.coalesce("pok", F.lit(True))).alias("ok"), F.lit(True).alias("live"))
        moved = cut(live.unionByName(state.filter("p IS NULL").select("n", none, "ok", F.lit(False).alias("live"))))
        state = moved.select("n", "p", "ok")
        live = moved.filter("live").agg(F.count(F.lit(1))).first()[0]
        if live in (0, before):  # as many pointers as before: only cycles are left
            break
        before = live
    return state.select(F.col("n").alias(node), (F.col("ok") & F.col("p").isNull()).alias("allowed"), F.col("p").isNotNull().alias("cyclic"))


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) with an end that is no node."""
    ids = nodes.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")
    right = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return left.union(right).distinct()


def read_back(nodes: DataFrame, edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(part, shape, problem, n): how much of a graph that was read back keeps its contract, by label or shape.

    A node (labels, props) has one known label and only the property ``id``; an edge (a_labels, a, rel, b_labels, b, props)
    joins nodes of one label each and has no properties. UNEXPECTED ones don't; of the others each is OK once, and further
    copies are DUPLICATE. Nulls are unexpected.
    """
    one = lambda c: F.coalesce(F.size(c) == 1, F.lit(False))
    good_node = one("labels") & F.coalesce(F.element_at("labels", 1).isin(*labels), F.lit(False)) & F.coalesce(F.map_keys("props") == F.array(F.lit("id")), F.lit(False))
    good_node = good_node & F.col("props").getItem("id").isNotNull()
    good_edge = one("a_labels") & one("b_labels") & F.coalesce(F.size("props") == 0, F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("rel").isNotNull()
    named = lambda c: F.coalesce(F.array_join(F.array_sort(c), "+", "?"), F.lit("?"))
    shape = F.concat(named("a_labels"), F.lit("-"), F.coalesce("rel", F.lit("?")), F.lit("->"), named("b_labels"))
    rows = nodes.select(F.lit("node").alias("part"), named("labels").alias("shape"), good_node.alias("good"), F.struct(F.col("props")["id"].cast("string").alias("a"), F.lit(None).cast("string").alias("b")).alias("key"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("part"), shape.alias("shape"), good_edge.alias("good"), F.struct(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).alias("key")))
    # Copies are counted in their tasks first; what is unexpected isn't told apart by key.
    each = rows.groupBy("part", "shape", "good", F.when(F.col("good"), F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    counts = F.array(F.struct(F.when(F.col("good"), "OK").otherwise("UNEXPECTED").alias("problem"), F.when(F.col("good"), 1).otherwise(F.col("n")).cast("long").alias("n")), F.struct(F.lit("DUPLICATE").alias("problem"), F.when(F.col("good"), F.col("n") - 1).otherwise(0).cast("long").alias("n")))
    told = each.select("part", "shape", F.explode(counts).alias("c")).filter("c.n > 0")
    return told.groupBy("part", "shape", "c.problem").agg(F.sum("c.n").alias("n"))


def related(bridge: DataFrame, item: str, kind: str, value: str, kinds: Sequence[str], k: int = 3) -> DataFrame:
    """For each item the ``k`` items that share most kinds of values with it, never itself; ties by identifier.

    ``bridge`` has one row per item, kind and value. For each set of kinds, items meet by their combined
    values, and of all that share one only the ``k + 1`` smallest are offered to each: an item further on
    is behind ``k`` that share as many kinds and have smaller identifiers. So no value makes pairs of all
    its items, and nothing is lost.
    """
    rows = bridge.select(F.col(item).alias("i"), F.col(kind).alias("kd"), F.col(value).cast("string").alias("v")).distinct()
    offers = None
    for size in range(len(kinds), 0, -1):
        for some in combinations(kinds, size):
            keyed = rows.filter(F.col("kd") == some[0]).select("i", F.array("v").alias("key"))
            for name in some[1:]:
                keyed = keyed.join(rows.filter(F.col("kd") == name).select("i", "v"), "i").select("i", F.concat("key", F.array("v")).alias("key"))
            first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("i"))).filter(F.col("n") <= k + 1).select("key", F.col("i").alias("j"))
            # Of what a set of kinds offers an item, the k smallest do: before any other lie k that share as many. Tasks choose before they shuffle.
            best = F.dense_rank().over(Window.partitionBy("i").orderBy("j"))
            found = keyed.join(first, "key").filter("i <> j").select("i", "j", best.alias("n")).filter(F.col("n") <= k).select("i", "j", F.lit(size).alias("kinds")).distinct()
            offers = found if offers is None else offers.unionByName(found)
    pairs = offers.groupBy("i", "j").agg(F.max("kinds").alias("kinds"))
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("kinds"), "j"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).select(F.col("i").alias(item), F.col("j").alias("related"), "kinds", "place")


def outline_parents(units: DataFrame, group: str, order: str, level: str, levels: int = 9) -> DataFrame:
    """Each unit's parent is the nearest earlier unit of a smaller level in its group."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == n, F.col(order)), ignorenulls=True).over(window) for n in range(1, levels + 1)]
    nearest = F.lit(None).cast("long")
    for n in range(1, levels + 1):
        nearest = F.when(F.col(level) == n, F.greatest(*last[: n - 1]) if n > 2 else (last[0] if n == 2 else F.lit(None).cast("long"))).otherwise(nearest)
    return units.withColumn("parent", nearest)


def alias_mentions(docs: DataFrame, doc: str, tokens: Column, aliases: DataFrame, longest: int = 3) -> DataFrame:
    """(doc, at, alias, concept): dictionary aliases leftmost first, the longest that begins there, none overlapping.

    ``at`` counts tokens from 1. Runs of tokens meet the dictionary (alias, concept) by equality, those that a bit set lets through where they stand; which of a
    document's mentions stay is told in their order.
    """

    grams = runs_in(docs.select(F.col(doc).alias("doc"), tokens.alias("t")), ["doc"], "t", bit_set(aliases, "alias"), 1, longest)
    met = grams.select("doc", "at", "n", F.col("gram").alias("alias")).join(aliases.select("alias", "concept"), "alias")
    listed = met.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("n")).alias("n"), "alias", "concept"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mentions = batch.column(1).flatten()
            at, n = (mentions.field(f).to_numpy() for f in ("at", "n"))
            sizes = batch.column(1).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            kept, end, last, of = [], 0, None, -1
            for k, (i, begin, size) in enumerate(zip(row.tolist(), at.tolist(), (-n).tolist())):
                if i != of:
                    end, last, of = 0, None, i
                if begin >= end or (begin, size) == last:  # an alias of several concepts is each of them
                    kept.append(k)
                    end, last = begin + size, (begin, size)
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row).take(kept)), *(mentions.field(f).take(kept) for f in ("at", "alias", "concept"))], names=["doc", "at", "alias", "concept"])

    kinds = docs.schema[doc].dataType.simpleString(), aliases.schema["concept"].dataType.simpleString()
    return listed.mapInArrow(run, f"doc {kinds[0]}, at int, alias string, concept {kinds[1]}").withColumnRenamed("doc", doc)


def strongest_paths(paths: DataFrame) -> DataFrame:
    """Per concept, term and language the strongest path; the original wins ties."""
    place = F.row_number().over(Window.partitionBy("concept", "term", "language").orderBy(F.desc("weight"), F.desc("original"), "path"))
    return paths.withColumn("place", place).filter("place = 1").drop("place")


def choose_sense(candidates: DataFrame, mention: str, least: int = 2, margin: int = 1) -> DataFrame:
    """(mention, concept) where one sense is clear.

    ``candidates`` has (mention, concept, same_domain, hints, abbreviation): 3 for the domain, 2 for
    each hint. A unique sense that is no abbreviation is always chosen; otherwise the score must be
    ``least`` or more, and lead by ``margin`` where there are several.
    """
    scored = candidates.withColumn("score", F.when(F.col("same_domain"), 3).otherwise(0) + 2 * F.col("hints"))
    window = Window.partitionBy(mention).orderBy(F.desc("score"), "concept")
    ranked = scored.withColumn("place", F.row_number().over(window)).withColumn("next", F.lead("score").over(window)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(mention)))
    alone = (F.col("n") == 1) & ~F.col("abbreviation")
    clear = (F.col("score") >= least) & ((F.col("n") == 1) | (F.col("score") - F.col("next") >= margin))
    return ranked.filter((F.col("place") == 1) & (alone | clear)).select(mention, "concept", "score")
