"""Queries of what keeps state: leases, outbox, artifacts, discovery ticks, snapshot trees, stored indexes, calendar slots."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import artifacts, bags, discovery, evaluation, graphs, inverted, merkle, registers
from quarry.operators import retrieval as V
from quarry.operators.graphs import alias_mentions, cut
from quarry.plans.graphs import _aliases
from quarry.plans.retrieval import _PLAIN, _docs, _items
from quarry.plans.search import _FOUND
from quarry.session import spread, table
from quarry.streaming import calendar, leases, outbox

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _folder(spark, what):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# Leases ---------------------------------------------------------------------------------------------

_KINDS = {"signup": "enqueue", "click": "claim", "view": "heartbeat", "purchase": "done", "error": "fail"}
_RULES = leases.Rules()
_DAY = 86_400_000_000

_STEP = f"""CASE c.kind
  WHEN 'enqueue' THEN list_append(x, {{'job': c.id, 'status': 'PENDING', 'attempts': 0, 'until': NULL::BIGINT, 'worker': NULL::BIGINT}})
  WHEN 'claim' THEN CASE WHEN len(held) >= {_RULES.capacity} OR len(free) = 0 THEN x ELSE list_transform(x, lambda j: CASE WHEN j.job = free[1].job THEN {{'job': j.job, 'status': 'RUNNING', 'attempts': j.attempts + 1, 'until': c.at + {_RULES.lease * 10**6}, 'worker': c.worker}} ELSE j END) END
  WHEN 'heartbeat' THEN list_transform(x, lambda j: CASE WHEN len(held) > 0 AND j.job = held[1].job THEN {{'job': j.job, 'status': 'RUNNING', 'attempts': j.attempts, 'until': c.at + {_RULES.lease * 10**6}, 'worker': c.worker}} ELSE j END)
  WHEN 'done' THEN list_transform(x, lambda j: CASE WHEN len(held) > 0 AND j.job = held[1].job THEN {{'job': j.job, 'status': 'DONE', 'attempts': j.attempts, 'until': NULL::BIGINT, 'worker': NULL::BIGINT}} ELSE j END)
  ELSE list_transform(x, lambda j: CASE WHEN len(held) > 0 AND j.job = held[1].job THEN {{'job': j.job, 'status': CASE WHEN j.attempts >= {_RULES.attempts} THEN 'FAILED' ELSE 'RETRY_WAIT' END, 'attempts': j.attempts,
    'until': CASE WHEN j.attempts < {_RULES.attempts} THEN c.at + least({_RULES.longest_retry}, {_RULES.retry} * pow(2, j.attempts - 1)::BIGINT) * 1000000 END, 'worker': NULL::BIGINT}} ELSE j END) END"""
_ENDED = "list_transform(jobs, lambda j: CASE WHEN j.status = 'RUNNING' AND j.until <= {at} THEN {{'job': j.job, 'status': CASE WHEN j.attempts < %d THEN 'STALE' ELSE 'FAILED' END, 'attempts': j.attempts, 'until': NULL::BIGINT, 'worker': NULL::BIGINT}} ELSE j END)" % _RULES.attempts


@query("st04_leases", f"""
WITH RECURSIVE c AS (SELECT user_id AS queue, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id AS id, epoch_us(ts) AS at, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS kind, event_id % 3 AS worker FROM events),
s AS (SELECT DISTINCT queue, 0::BIGINT AS i, []::STRUCT(job BIGINT, status VARCHAR, attempts INT, until BIGINT, worker BIGINT)[] AS jobs FROM c
  UNION ALL SELECT queue, i, {_STEP} FROM (SELECT *, list_filter(x, lambda j: j.status = 'RUNNING' AND j.worker = c.worker) AS held, list_filter(x, lambda j: j.status IN ('PENDING', 'STALE') OR (j.status = 'RETRY_WAIT' AND j.until <= c.at)) AS free
    FROM (SELECT s.queue, c.i, c, {_ENDED.format(at='c.at')} AS x FROM s JOIN c ON c.queue = s.queue AND c.i = s.i + 1))),
l AS (SELECT queue, unnest({_ENDED.format(at=2**62)}) AS j FROM s SEMI JOIN (SELECT queue, max(i) AS i FROM c GROUP BY 1) m USING (queue, i))
SELECT queue, j.job AS job, j.status AS status, j.attempts AS attempts, j.until AS until FROM l
""")
def lease_states(spark, d):
    """Commands come in slices of time; each is a run of its own that goes on from the checkpoint, and begins with what the one before ended with."""
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    e = table(spark, d, "events")
    commands = e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind[F.col("event_type")].alias("kind"), (F.col("event_id") % 3).alias("worker"))
    folder = _folder(spark, "leases")
    span = commands.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    slices = 3
    for n in range(slices if span.low is not None else 0):
        low, high = (span.low + (span.high + 1 - span.low) * k // slices for k in (n, n + 1))
        part = commands.filter((F.col("at") >= low - (n > 0) * 1_800_000_000) & (F.col("at") < high))
        if n == slices - 1:
            # Time goes on after the last command, so that all leases end.
            part = part.unionByName(spark.createDataFrame([(None, -1, span.high + 400 * _DAY, "tick", 0)], leases.COMMANDS))
        part.write.mode("append").parquet(f"{folder}/commands")
        leases.run_leases(spark.readStream.schema(leases.COMMANDS).parquet(f"{folder}/commands"), f"{folder}/changes", f"{folder}/checkpoint", _RULES)
    changes = f"{leases.TRANSITIONS}, batch long"
    told = spark.read.schema(changes).parquet(f"{folder}/changes") if span.low is not None else spark.createDataFrame([], changes)
    return leases.final_states(told).drop("worker")


# Outbox ---------------------------------------------------------------------------------------------


@query("st07_outbox_effects", "SELECT event_id, event_type, 1 + greatest(0, 4 - event_id % 9) AS attempts, (SELECT coalesce(sum(least(300, pow(2, least(a, 8)))), 0) FROM range(1, 1 + greatest(0, 4 - event_id % 9)) r(a))::BIGINT AS backoff FROM events")
def outbox_effects(spark, d):
    """Some events are refused at first; batches overlap, so they are handed over more than once."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = _folder(spark, "outbox")
    # Event k is refused in its first attempts, as many as 4 - k % 9.
    box = outbox.Outbox(spark, f"{folder}/box", e.schema, "event_id", "ts", lambda attempt: attempt > 4 - F.col("event_id") % 9)
    for part in ("event_id % 3 <> 1", "event_id % 3 <> 0", "event_id % 7 = 0"):
        e.filter(part).write.mode("append").parquet(f"{folder}/events")
        box.run(spark.readStream.schema(e.schema).parquet(f"{folder}/events"), f"{folder}/checkpoint")
    box.drain()
    waits = F.aggregate(F.sequence(F.lit(0), F.col("attempts") - 1), F.lit(0).cast("long"), lambda total, a: total + F.when(a > 0, outbox.delay(a)).otherwise(0))
    return box.effects().select("event_id", "event_type", "attempts", waits.alias("backoff"))


@query("snk19_outbox_batches", "SELECT 1 + greatest(0, 4 - event_id % 9) AS attempts, count(*) AS events FROM events GROUP BY 1")
def outbox_batches(spark, d):
    """The batch writer alone: each batch is run twice, first stopped between its effects and its ledger."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    box = outbox.Outbox(spark, _folder(spark, "outbox"), e.schema, "event_id", "ts", lambda attempt: attempt > 4 - F.col("event_id") % 9)
    for number, part in enumerate(("event_id % 2 = 0", "event_id % 2 = 1")):
        try:
            box.write(e.filter(part), number, fail_before_commit=True)
        except RuntimeError:
            box.write(e.filter(part), number)
    box.drain()
    return box.effects().groupBy("attempts").agg(F.count(F.lit(1)).alias("events"))


# Artifacts ------------------------------------------------------------------------------------------

_SHARDS = 64
_SHARD = f"('0x' || substr(sha256(p_partkey::VARCHAR), 1, 8))::BIGINT % {_SHARDS}"


@query("snk16_artifact_builds", f"""
WITH p AS (SELECT p_partkey, {_SHARD} AS shard FROM part), s AS (SELECT shard, count(*) AS n, bool_or(p_partkey % 100 = 7) AS touched FROM p GROUP BY 1)
SELECT 'first' AS step, count(*) AS written, 0::BIGINT AS reused, (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM part WHERE p_name LIKE '%*') AS changed FROM s
UNION ALL SELECT 'second', count(*) FILTER (WHERE touched), count(*) FILTER (WHERE NOT touched), (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_name LIKE '%*' OR p_partkey % 100 = 7) FROM s
UNION ALL SELECT 'rolled back', 0, count(*), (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_name LIKE '%*') FROM s
UNION ALL SELECT 'collected', count(*) FILTER (WHERE touched), count(*), (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_name LIKE '%*') FROM s
""")
def artifact_builds(spark, d):
    """Two builds that differ in one row of a hundred; going back to the first; removal of what the second had added (told as written)."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    store = artifacts.Artifact(spark, _folder(spark, "artifact"), "p_partkey", ["p_name", "p_brand"], _SHARDS)
    first, written = store.build(p)
    store.activate(first)
    steps = [("first", written, 0, first)]
    second, written = store.build(p.withColumn("p_name", F.when(F.col("p_partkey") % 100 == 7, F.concat("p_name", F.lit("*"))).otherwise(F.col("p_name"))))
    total = store.manifest(second).count()
    store.activate(second, expected=first)
    steps.append(("second", written, total - written, second))
    steps.append(("rolled back", 0, total, store.rollback()))
    out = None
    for step, new, reused, name in steps:
        rows = store.rows(name).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_name").endswith("*")).alias("changed"))
        row = cut(rows.select(F.lit(step).alias("step"), F.lit(new).cast("long").alias("written"), F.lit(reused).cast("long").alias("reused"), "rows", "changed"))
        out = row if out is None else out.unionByName(row)
    dead = store.collect_garbage(keep=1)
    left = store.rows().agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_name").endswith("*")).alias("changed"))
    return out.unionByName(left.select(F.lit("collected").alias("step"), F.lit(len(dead)).cast("long").alias("written"), F.lit(store.manifest(store.active()).count()).cast("long").alias("reused"), "rows", "changed"))


# Registers ------------------------------------------------------------------------------------------


@query("snk10_register_updates", """
WITH RECURSIVE u AS (SELECT o_custkey AS id, o_orderkey AS place, o_orderkey % 3 AS expected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT c_custkey AS id, 0::BIGINT AS i, 0::BIGINT AS revision, NULL::BIGINT AS place, NULL::VARCHAR AS outcome FROM customer WHERE c_custkey % 7 <> 2
  UNION ALL SELECT u.id, u.i, f.revision + (u.expected = f.revision)::BIGINT, u.place, CASE WHEN u.expected = f.revision THEN 'APPLIED' ELSE 'CONFLICT' END FROM f JOIN u ON u.id = f.id AND u.i = f.i + 1)
SELECT id, place, outcome FROM f WHERE place IS NOT NULL UNION ALL SELECT id, place, 'MISSING' FROM u WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 2)
""")
def register_updates(spark, d):
    """Orders update their customers' registers; each states the revision that it expects."""
    store = registers.Registers(spark, _folder(spark, "registers"), 8)
    store.put(0, table(spark, d, "customer").filter("c_custkey % 7 <> 2").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value")))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 3).alias("expected"), F.col("o_orderstatus").alias("value"))
    return store.update(1, o)


@query("snk14_stored_sequences", """
WITH r AS (SELECT p_brand AS scope, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, p_partkey) AS seq FROM part) SELECT scope, p_partkey, CASE WHEN seq <= 60 THEN seq END AS seq FROM r
""")
def stored_sequences(spark, d):
    """Numbers within each brand from two batches, the second run twice; no brand gets more than sixty."""
    store = registers.Sequences(spark, _folder(spark, "sequences"), 60, 8)
    p = table(spark, d, "part").select(F.col("p_brand").alias("scope"), "p_partkey")
    first = store.allocate(0, p.filter("p_partkey % 2 = 0"), "p_partkey")
    store.allocate(1, p.filter("p_partkey % 2 = 1"), "p_partkey")
    return first.unionByName(store.allocate(1, p.filter("p_partkey % 2 = 1"), "p_partkey"))


# Discovery ------------------------------------------------------------------------------------------


def _ticks(spark, d):
    """Revision 2 of a document is its text, revision 1 another's; every fifth is deleted by revision 3. Ticks take them in no order."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text")
    aliases = cut(_aliases(spark, d))

    def mentions(units):
        tokens = units.select(F.col("unit").alias("doc"), X.surface_tokens(F.col("text")).alias("tokens"))
        found = alias_mentions(tokens, "doc", F.col("tokens"), aliases)
        return found.select(F.col("doc").alias("unit"), F.col("alias").alias("term"), "at").distinct().groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"))

    store = discovery.Discovery(spark, _folder(spark, "discovery"), mentions, buckets=8)
    rev = lambda n, deleted, text: docs.select("unit", F.lit(n).cast("long").alias("revision"), F.lit(deleted).alias("deleted"), text.alias("text"))
    first, second, gone = rev(1, False, F.reverse("text")), rev(2, False, F.col("text")), rev(3, True, F.lit(None).cast("string")).filter("unit % 5 = 0")
    told = []
    for n, changes in enumerate((second.filter("unit % 2 = 0"), first, gone, second.filter("unit % 2 = 1").unionByName(gone), second)):
        told.append(store.tick(n, changes))
    return store, told


@query("m15_discovery_counts", f"WITH {_FOUND} SELECT alias AS term, count(*) AS units, sum(n)::BIGINT AS uses FROM mn WHERE doc % 5 <> 0 GROUP BY 1")
def discovery_counts(spark, d):
    return _ticks(spark, d)[0].counts()


@query("m15_discovery_lag", """
WITH l AS (SELECT event_id % 8 AS tick, epoch_us(max(ts) OVER (PARTITION BY event_id % 8)) - epoch_us(ts) AS lag FROM events), n AS (SELECT tick, list_sort(list(lag)) AS l FROM l GROUP BY 1)
SELECT tick, l[len(l) // 2 + 1] AS p50, l[floor(0.95 * (len(l) - 1))::BIGINT + 1] AS p95 FROM n
""")
def discovery_lag(spark, d):
    """Microseconds from a change to the tick that took it in: the median at place n DIV 2, the 95th percentile at int(0.95 * (n - 1)), neither interpolated."""
    e = table(spark, d, "events").select((F.col("event_id") % 8).alias("tick"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    lag = cut(e.join(e.groupBy("tick").agg(F.max("at").alias("now")), "tick").select("tick", (F.col("now") - F.col("at")).alias("lag")))
    places = lambda q, name: evaluation.nearest_rank(lag, "tick", "lag", q).withColumnRenamed("lag", name)
    counts = lag.groupBy("tick").agg(F.floor(F.count(F.lit(1)) / 2).alias("place"))
    return evaluation.at_place(lag, "tick", "lag", counts).withColumnRenamed("lag", "p50").join(places(0.95, "p95"), "tick")


# Snapshot trees -------------------------------------------------------------------------------------

_SIDES = "s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 997 <> 3), t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1009 = 5 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 1013 = 9 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 991 <> 4)"


@query("r08_snapshot_tree", f"WITH {_SIDES} SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'missing_in_target' WHEN s.id IS NULL THEN 'missing_in_source' ELSE 'changed' END AS side FROM s FULL JOIN t ON s.id = t.id WHERE s.id IS NULL OR t.id IS NULL OR s.status IS DISTINCT FROM t.status OR s.price IS DISTINCT FROM t.price")
def snapshot_tree(spark, d):
    return merkle.differences(*_snapshots(spark, d, _folder(spark, "snapshots")), ["status", "price"])


def _snapshots(spark, d, folder):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changed = o.filter("id % 991 <> 4").select("id", F.when(F.col("id") % 1009 == 5, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 1013 != 9, F.col("price")).alias("price"))
    return [merkle.Snapshot.write(rows, f"{folder}/{name}", "id", ["status", "price"], folders=1) for name, rows in (("source", o.filter("id % 997 <> 3")), ("target", changed))]


@query("r10_repair_and_verify", f"WITH {_SIDES}, f AS (SELECT CASE WHEN t.id IS NULL THEN 'missing_in_target' WHEN s.id IS NULL THEN 'missing_in_source' ELSE 'changed' END AS side FROM s FULL JOIN t ON s.id = t.id WHERE s.id IS NULL OR t.id IS NULL OR s.status IS DISTINCT FROM t.status OR s.price IS DISTINCT FROM t.price) SELECT side, count(*) AS repaired, 0::BIGINT AS remaining, (SELECT count(*) FROM s) AS rows_after FROM f GROUP BY 1")
def repair_and_verify(spark, d):
    """Mends the target where it differs, compares again, and tells by kind what was mended and what is left."""
    folder = _folder(spark, "repair")
    source, target = _snapshots(spark, d, folder)
    found = merkle.differences(source, target, ["status", "price"]).groupBy("side").agg(F.count(F.lit(1)).alias("repaired"))
    mended, left = merkle.repaired(source, target, ["status", "price"], f"{folder}/mended")
    left = left.groupBy("side").agg(F.count(F.lit(1)).alias("remaining"))
    rows = mended.rows().agg(F.count(F.lit(1)).alias("rows_after"))
    return found.join(left, "side", "full_outer").fillna(0, ["repaired", "remaining"]).crossJoin(F.broadcast(rows))  # one row


# Stored index ---------------------------------------------------------------------------------------


def _stored(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", "tokens")
    index = inverted.InvertedIndex(spark, _folder(spark, "index"))
    index.refresh(docs, "doc_id", "text", "tokens")
    return docs, index


@query("x17_stored_index", _PLAIN + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def stored_index(spark, d):
    docs, index = _stored(spark, d)
    return index.top(V.query_terms(_items(spark, d), "item_id", "tokens"), 10, (docs, "doc_id", "text")).select("query", "doc", "score", "rank")


@query("x18_stale_shards", "WITH s AS (SELECT doc_id % 16 AS shard, bool_or(doc_id % 150 = 31) AS changed FROM documents GROUP BY 1) SELECT shard::INT AS shard, changed AS stale, CASE WHEN changed THEN 2 ELSE 1 END::INT AS version FROM s")
def stale_shards(spark, d):
    """Documents change and vanish after the index is made; only their shards are made anew."""
    docs, index = _stored(spark, d)
    now = docs.withColumn("text", F.when((F.col("doc_id") % 300 == 31), F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))).filter("doc_id % 300 <> 181")
    now = now.withColumn("tokens", X.surface_tokens(F.col("text")))
    stale = index.refresh(now, "doc_id", "text", "tokens")
    return index.versions().select("shard", F.col("shard").isin(stale).alias("stale"), "version")


# Bags of meanings ------------------------------------------------------------------------------------

_HELD = r"regexp_matches(coalesce(text, ''), '\S')"
_BAGGED = bags.Settings()


def _edited(text):
    """What became of the texts since: a word is written in capitals, and some end in blanks, which no sentence holds."""
    return F.concat(F.replace(F.coalesce(text, F.lit("")), F.lit(" un "), F.lit(" UN ")), F.when(F.col("doc_id") % 9 == 0, "  \n").otherwise(""))


@query("d13_stored_bags", f"""
SELECT doc_id, CASE WHEN doc_id % 40 = 21 THEN 'MISSING' WHEN doc_id % 43 = 9 THEN 'ORPHAN' WHEN doc_id % 37 = 5 THEN 'SETTINGS' WHEN contains(text, ' un ') THEN 'SOURCE_CHANGED' ELSE 'VALID' END AS verdict
FROM documents WHERE {_HELD} AND NOT (doc_id % 40 = 21 AND doc_id % 43 = 9)
""")
def stored_bags(spark, d):
    """Bags are stored, some later with another threshold and some not at all; then texts change and vanish. The gravest verdict of each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    store = bags.BagStore(spark, _folder(spark, "bags"))
    store.build(1, docs.filter("doc_id % 40 <> 21"), "source", "doc_id", "text", _BAGGED)
    store.build(2, docs.filter("doc_id % 37 = 5 AND doc_id % 40 <> 21"), "source", "doc_id", "text", replace(_BAGGED, threshold=0.7))
    live = docs.filter("doc_id % 43 <> 9").withColumn("text", _edited(F.col("text")))
    found = store.verify(live, "source", "doc_id", "text", _BAGGED)
    return bags.gravest(found, "unit").withColumnRenamed("unit", "doc_id")


@query("t09_run_states", f"""
WITH r AS (SELECT doc_id // 4 AS root, bool_or(contains(coalesce(text, ''), ' un ') OR doc_id % 9 = 0 OR doc_id % 29 = 3 OR text IS NULL) AS changed, bool_or(doc_id % 40 = 21 AND {_HELD}) AS lost, bool_or(doc_id % 97 = 11) AS twice, bool_or({_HELD}) AS held FROM documents GROUP BY 1)
SELECT root, CASE WHEN root % 19 = 4 OR twice OR root % 17 = 2 OR NOT held THEN 'CONTENT_NOT_READY' WHEN root % 11 = 7 THEN 'NOT_STARTED' WHEN changed THEN 'STALE' WHEN root % 13 = 5 THEN 'RUNNING' WHEN root % 13 = 6 THEN 'FAILED' WHEN lost THEN 'STALE' ELSE 'READY' END AS state,
  CASE WHEN root % 19 = 4 OR twice THEN 'CONTENT_NOT_READY' WHEN root % 17 = 2 OR NOT held THEN 'EMPTY_CONTENT' WHEN root % 11 = 7 THEN NULL WHEN changed THEN 'INDEX_SOURCE_CHANGED' WHEN root % 13 = 5 THEN NULL WHEN root % 13 = 6 THEN 'INDEX_LIMIT_EXCEEDED' WHEN lost THEN 'INDEX_ARTIFACT_INVALID' END AS code
FROM r WHERE NOT (root % 19 = 4 AND root % 11 = 7)
""")
def run_states(spark, d):
    """Four documents make a version. Runs are logged with the prints of what they read; then texts, sources and documents change."""
    docs = spread(table(spark, d, "documents").select(F.expr("doc_id DIV 4").alias("root"), "doc_id", "text", "source"))
    what = ("root", "doc_id", "text", ["source"], _BAGGED)
    folder = _folder(spark, "runs")
    store = bags.BagStore(spark, f"{folder}/store")
    store.build(1, docs.filter("doc_id % 40 <> 21"), "root", "doc_id", "text", _BAGGED)
    first = bags.input_prints(docs.filter("root % 11 <> 7"), *what).select("root", F.lit(1).alias("run"), F.lit("COMPLETED").alias("status"), "print", F.lit(None).cast("string").alias("error"))
    first.write.mode("overwrite").parquet(f"{folder}/log/entry=1")
    log = spark.read.schema(first.schema).parquet(f"{folder}/log/entry=1").filter("root % 13 IN (5, 6)")
    failed = F.col("root") % 13 == 6
    log.select("root", F.lit(2).alias("run"), F.when(failed, "FAILED").otherwise("RUNNING").alias("status"), "print", F.when(failed, "INDEX_LIMIT_EXCEEDED").alias("error")).write.mode("overwrite").parquet(f"{folder}/log/entry=2")
    live = docs.filter("root % 19 <> 4").withColumn("text", F.when(F.col("root") % 17 != 2, _edited(F.col("text")))).withColumn("source", F.when(F.col("doc_id") % 29 == 3, "moved").otherwise(F.col("source")))
    live = live.unionByName(live.filter("doc_id % 97 = 11"))
    verdicts = store.verify(live, "root", "doc_id", "text", _BAGGED)
    return bags.states(bags.input_prints(live, *what), spark.read.schema(first.schema).parquet(f"{folder}/log"), verdicts)


@query("m19_contract", """
WITH n AS (SELECT CASE WHEN c_acctbal > 9000 THEN 'Customer+Vip' ELSE 'Customer' END AS shape, c_acctbal <= 9000 AND c_mktsegment IS DISTINCT FROM 'BUILDING' AS good, c_custkey AS a, NULL AS b FROM customer),
e AS (SELECT 'Order-CONTAINS->Part' AS shape, l_returnflag <> 'R' AS good, l_orderkey AS a, l_partkey AS b FROM lineitem), g AS (SELECT 'node' AS part, * FROM n UNION ALL SELECT 'edge', * FROM e)
SELECT part, shape, 'UNEXPECTED' AS problem, count(*) AS n FROM g WHERE NOT good GROUP BY ALL UNION ALL SELECT part, shape, 'OK', count(DISTINCT (a, b)) FROM g WHERE good GROUP BY ALL
UNION ALL SELECT part, shape, 'DUPLICATE', count(*) - count(DISTINCT (a, b)) FROM g WHERE good GROUP BY ALL HAVING count(*) > count(DISTINCT (a, b))
""")
def graph_contract(spark, d):
    """Customers and the parts of orders, read back as a graph: some nodes have a second label or a name, returned items have a property, and orders repeat parts."""
    own = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"))
    props = F.when(F.col("c_mktsegment") == "BUILDING", F.map_concat(own, F.create_map(F.lit("name"), F.col("c_name")))).otherwise(own)
    nodes = table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 9000, F.array(F.lit("Customer"), F.lit("Vip"))).otherwise(F.array(F.lit("Customer"))).alias("labels"), props.alias("props"))
    empty = F.expr("CAST(map() AS map<string,string>)")
    one = lambda label: F.array(F.lit(label))
    edges = table(spark, d, "lineitem").select(one("Order").alias("a_labels"), F.col("l_orderkey").alias("a"), F.lit("CONTAINS").alias("rel"), one("Part").alias("b_labels"), F.col("l_partkey").alias("b"), F.when(F.col("l_returnflag") == "R", F.create_map(F.lit("flag"), F.lit("R"))).otherwise(empty).alias("props"))
    return graphs.read_back(nodes, edges, ["Customer", "Order", "Part"])


# Calendar slots -------------------------------------------------------------------------------------

_PLANS = (
    calendar.Plan("quarter", "INTERVAL", seconds=900), calendar.Plan("nightly", "DAILY", "Asia/Ho_Chi_Minh", 2, 30), calendar.Plan("weekly", "WEEKLY", "America/New_York", 3, 0, weekday=6),
    calendar.Plan("monthly", "MONTHLY", "Europe/Paris", 3, 15, month_day=12),
)
_LOCAL = lambda zone: f"(ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')"
_SLOTS = f"""WITH u AS (SELECT event_id, ts, 'quarter' AS plan, '900:' || epoch_us(ts) // 900000000 AS period, NULL::TIMESTAMP AS wall, 'UTC' AS zone FROM events
  UNION ALL SELECT event_id, ts, 'nightly', strftime({_LOCAL('Asia/Ho_Chi_Minh')}, '%Y-%m-%d'), date_trunc('day', {_LOCAL('Asia/Ho_Chi_Minh')}) + INTERVAL 150 MINUTE, 'Asia/Ho_Chi_Minh' FROM events
  UNION ALL SELECT event_id, ts, 'weekly', strftime(date_trunc('week', {_LOCAL('America/New_York')}), '%Y-%m-%d'), date_trunc('week', {_LOCAL('America/New_York')}) + INTERVAL 6 DAY + INTERVAL 3 HOUR, 'America/New_York' FROM events
  UNION ALL SELECT event_id, ts, 'monthly', strftime({_LOCAL('Europe/Paris')}, '%Y-%m'), date_trunc('month', {_LOCAL('Europe/Paris')}) + INTERVAL 11 DAY + INTERVAL 195 MINUTE, 'Europe/Paris' FROM events),
v AS (SELECT * FROM u WHERE wall IS NULL OR ts >= wall AT TIME ZONE zone AT TIME ZONE 'UTC')"""


@query("f31_calendar_slots", _SLOTS + " SELECT plan, period, count(*) AS ticks, min(event_id) AS first_id FROM v GROUP BY 1, 2")
def calendar_slots(spark, d):
    found = calendar.slots_of(table(spark, d, "events").select("event_id", "ts"), "ts", _PLANS)
    return found.groupBy("plan", "period").agg(F.count(F.lit(1)).alias("ticks"), F.min("event_id").alias("first_id"))


@query("st05_calendar_jobs", _SLOTS + " SELECT DISTINCT plan || ':' || period AS job_key, plan FROM v")
def calendar_jobs(spark, d):
    """A stream of ticks in several batches; each slot's job comes up once."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = _folder(spark, "calendar")
    for part in ("event_id % 3 = 0", "event_id % 3 > 0", "event_id % 5 = 0"):
        e.filter(part).write.mode("append").parquet(f"{folder}/ticks")
        made = calendar.jobs(spark.readStream.schema(e.schema).parquet(f"{folder}/ticks"), "ts", _PLANS)
        made.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/jobs/batch={n}")).start().awaitTermination()
    return spark.read.schema("job_key string, plan string, due timestamp").parquet(f"{folder}/jobs").select("job_key", "plan")
