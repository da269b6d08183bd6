"""Leases, outbox, artifacts, discovery ticks, snapshot trees, stored index and calendar slots against plain folds and rebuilds."""

import math
import random
import re
import time
from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import artifacts, discovery, inverted, merkle
from quarry.operators import retrieval as V
from quarry.operators import spans as P
from quarry.streaming import calendar, leases, outbox

# Leases ---------------------------------------------------------------------------------------------


def test_lease_rules():
    q, second = leases.Queue(leases.Rules(lease=10, retry=4, longest_retry=6, attempts=3)), 10**6
    go = lambda *c: [(t[0], t[2], t[3], t[4]) for t in q.apply(c[0], c[1] * second, c[2], c[3])]
    assert go(1, 0, "enqueue", 0) == [(1, "PENDING", 0, None)] and go(2, 1, "enqueue", 0)
    assert go(3, 2, "claim", 7) == [(1, "RUNNING", 1, 12 * second)] and go(4, 3, "claim", 7) == []  # one job each
    assert go(5, 3, "claim", 8) == [(2, "RUNNING", 1, 13 * second)]
    assert go(6, 9, "heartbeat", 7) == [(1, "RUNNING", 1, 19 * second)]
    assert go(7, 14, "done", 8) == [(2, "STALE", 1, None)]  # its lease has ended, so another's work isn't touched
    assert go(8, 15, "fail", 7) == [(1, "RETRY_WAIT", 1, 19 * second)]
    assert go(9, 16, "claim", 7) == [(2, "RUNNING", 2, 26 * second)] and go(10, 17, "done", 7) == [(2, "DONE", 2, None)]
    assert go(11, 18, "claim", 7) == [] and go(12, 19, "claim", 7) == [(1, "RUNNING", 2, 29 * second)]
    assert go(13, 20, "fail", 7) == [(1, "RETRY_WAIT", 2, 26 * second)]  # doubled, but six at most
    assert go(14, 26, "claim", 7) and go(15, 27, "fail", 7) == [(1, "FAILED", 3, None)]


def test_leases_don_t_hang_on_batches(spark, tmp_path):
    """Commands in other orders, late and repeated, over several runs from one checkpoint."""
    rng = random.Random(1)
    rules = leases.Rules(lease=500, retry=100, attempts=2, capacity=2)
    kinds = ["enqueue", "enqueue", "claim", "claim", "heartbeat", "done", "fail"]
    commands = [(rng.choice([1, 1, 2, None]), i, 10**6 * (20 * i + rng.randint(0, 30)), rng.choice(kinds), rng.randint(0, 2)) for i in range(240)]
    want = {}
    for name in (1, 2, None):
        q = leases.Queue(rules)
        for c in sorted((c for c in commands if c[0] == name), key=lambda c: (c[2], c[1])):
            want |= {(name, t[0]): t[2:] for t in q.apply(*c[1:])}
        want |= {(name, t[0]): t[2:] for t in q.expire(10**15)}
    parts = [commands[i : i + 60] for i in range(0, 240, 60)]
    end = [(9, -1, 10**14, "tick", 0)]
    folder = f"file://{tmp_path}"
    for n, part in enumerate(parts):
        again = rng.sample(part, 20) + (rng.sample(parts[n - 1][-25:], 20) if n else [])
        rows = part + again + (end if n == 3 else [])
        rng.shuffle(rows)
        spark.createDataFrame(rows, leases.COMMANDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for _ in range(2 if n == 2 else 1):  # once more without anything new
            leases.run_leases(spark.readStream.schema(leases.COMMANDS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", rules, "1000 seconds")
    got = {(r.queue, r.job): (r.status, r.attempts, r.until, r.worker) for r in leases.final_states(spark.read.parquet(f"{folder}/out")).collect()}
    assert got == want and {s[0] for s in want.values()} >= {"PENDING", "DONE", "FAILED", "STALE"}


# Outbox ---------------------------------------------------------------------------------------------


def test_outbox_delivers_once(spark, tmp_path):
    start = datetime(2024, 3, 1)
    rows = [(i, start + timedelta(minutes=i), f"p{i}") for i in range(60)]
    events = lambda some: spark.createDataFrame(some, "id long, ts timestamp, payload string")
    schema = events(rows).schema
    refused = lambda attempt: attempt > F.col("id") % 4
    box = outbox.Outbox(spark, f"file://{tmp_path}/box", schema, "id", "ts", refused)
    for n, (some, crash) in enumerate(((rows[:20] + rows[:5], False), (rows[10:40], True), (rows[40:] + rows[:60:7], False))):
        if crash:
            with pytest.raises(RuntimeError):
                box.write(events(some), n, fail_before_commit=True)
        box.write(events(some), n)
        box.write(events(some), n)  # handed over again
    assert box.drain() >= 1 and box.drain() == 0 and box.pending().count() == 0
    got = [tuple(r) for r in box.effects().select("id", "payload", "attempts").collect()]
    assert sorted(got) == [(i, f"p{i}", 1 + i % 4) for i in range(60)]
    waited = {r.id: (r.due - r.first_at, r.attempts) for r in box.effects().collect()}
    assert all(w >= sum(min(300, 2 ** min(a, 8)) for a in range(1, n)) for w, n in waited.values())
    assert [r[0] for r in spark.range(1, 12).select(outbox.delay(F.col("id"))).collect()] == [2, 4, 8, 16, 32, 64, 128, 256, 256, 256, 256]


# Artifacts ------------------------------------------------------------------------------------------


def test_artifact_life(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"))
    store = artifacts.Artifact(spark, f"file://{tmp_path}", "id", ["v", "w"], 50)
    first, written = store.build(rows)
    assert written == 50 and store.active() is None
    assert store.build(rows.repartition(7)) == (first, 0)  # other files and orders, the same content
    store.activate(first)
    changed = rows.withColumn("v", F.when(F.col("id") % 400 == 3, "new").otherwise(F.col("v"))).filter("id <> 77")
    second, written = store.build(changed)
    shards = lambda df: {r.shard for r in df.withColumn("shard", store.shard_of()).collect()}
    assert written == len(shards(rows.filter("id % 400 = 3 OR id = 77"))) and second != first
    with pytest.raises(RuntimeError):
        store.activate(second, expected="other")
    store.activate(second, expected=first)
    assert sorted(map(tuple, store.rows().collect()), key=repr) == sorted(map(tuple, changed.collect()), key=repr)
    assert store.digest() == second and store.digest(first) == first
    assert store.rollback() == first and sorted(map(tuple, store.rows().collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(RuntimeError):
        store.rollback()
    assert len(store.collect_garbage()) == written and store.collect_garbage() == [] and store.digest() == first
    assert store.build(changed) == (second, written)  # what was removed is written again


# Discovery ------------------------------------------------------------------------------------------


def _words(units):
    return units.select("unit", F.explode(F.split("text", " ")).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"))


def test_discovery_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    changes, final = [], {}
    for unit in range(40):
        for revision in range(1, rng.randint(2, 5)):
            gone = rng.random() < 0.25
            text = None if gone else " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
            changes.append((unit, revision, gone, text))
            final[unit] = text
    want_units, want_uses = Counter(), Counter()
    for text in final.values():
        if text:
            want_units.update(set(text.split(" ")))
            want_uses.update(text.split(" "))
    want = {(t, n, want_uses[t]) for t, n in want_units.items()}
    for order in range(3):
        rng.shuffle(changes)
        store = discovery.Discovery(spark, f"file://{tmp_path}/{order}", _words, buckets=4)
        for n in range(3):
            part = spark.createDataFrame(changes[n::3], "unit long, revision long, deleted boolean, text string")
            told = store.tick(n, part)
            if n == 1:
                assert store.tick(n, part) == told  # run again after a failure
        assert {tuple(r) for r in store.counts().collect()} == want
        nothing = store.tick(3, spark.createDataFrame(changes, "unit long, revision long, deleted boolean, text string"))
        assert nothing == {"written": 0, "deleted": 0, "same": 0, "terms": 0}
        touched = [(u, 99, False, t) for u, t in final.items() if t][:5]
        assert store.tick(4, spark.createDataFrame(touched, "unit long, revision long, deleted boolean, text string")) == {"written": 0, "deleted": 0, "same": 5, "terms": 0}


# Snapshot trees -------------------------------------------------------------------------------------


def test_snapshot_trees_find_all_and_read_little(spark, tmp_path):
    a = spark.range(0, 30_000).select((F.col("id") * 7_000_003).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    b = a.filter("k % 9973 <> 1").withColumn("v", F.when(F.col("k") % 7001 == 2, None).otherwise(F.col("v"))).union(spark.createDataFrame([(-5, "x"), (2**62, None)], "k long, v string"))
    sides = [merkle.Snapshot.write(df, f"file://{tmp_path}/{n}", "k", ["v"]) for n, df in (("a", a), ("b", b.repartition(3)), ("c", a.repartition(5)))]
    rows = lambda df: {r.k: r.v for r in df.collect()}
    x, y = rows(a), rows(b)
    want = {(k, "missing_in_target" if k not in y else "missing_in_source" if k not in x else "changed") for k in x.keys() | y.keys() if k not in x or k not in y or x[k] != y[k]}
    assert {tuple(r) for r in merkle.differences(sides[0], sides[1], ["v"]).collect()} == want and len(want) >= 9
    leaves, compared = merkle.differing_leaves(sides[0], sides[1])
    assert len(leaves) <= len(want) and compared <= 1 + merkle.DEPTH * 16 * len(want)
    assert sides[0].rows_of(leaves).count() <= 10 * len(want)  # of 30,000
    mended, left = merkle.repaired(sides[0], sides[1], ["v"], f"file://{tmp_path}/mended")
    assert left.count() == 0 and rows(mended.rows()) == x
    assert merkle.differing_leaves(sides[0], sides[2]) == ([], 1) and merkle.differences(sides[0], sides[2], ["v"]).count() == 0


# Stored index ---------------------------------------------------------------------------------------


def test_postings_round_trip():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 300, 500), rng.integers(0, 2**60, 50), [0, 127, 128, 2**14 - 1, 2**14, 2**62]])
    begin = np.array([0, 3, 200, 501])
    coded = inverted._encoded(values, begin)
    ends = np.append(begin[1:], len(values))
    assert all((inverted._decoded(c.as_py()) == values[a:b]).all() for c, a, b in zip(coded, begin, ends, strict=True))


def test_stored_index(spark, tmp_path):
    rng = random.Random(9)
    weights = [1 / (i + 1) for i in range(400)]
    texts = [(i * 3 - 50, " ".join(f"t{x}" for x in rng.choices(range(400), weights, k=rng.randint(0, 90)))) for i in range(3000)]
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    docs = spark.createDataFrame(texts, "doc long, text string").repartition(5).withColumn("tokens", tokens)
    terms = spark.createDataFrame([(q, f"t{t}") for q, ts in enumerate([(0, 1, 7), (3,), (350, 2), (11, 60, 200, 399)]) for t in ts], "query long, term string")
    index = inverted.InvertedIndex(spark, f"file://{tmp_path}", 2)
    assert index.refresh(docs, "doc", "text", "tokens") == [0, 1] and index.refresh(docs, "doc", "text", "tokens") == []
    want = {tuple(r) for r in V.top(V.bm25(docs, terms, "doc", "tokens"), ["query"], 10).select("query", "doc", "score", "rank").collect()}
    top = index.top(terms, 10, (docs, "doc", "text")).collect()
    assert {(r.query, r.doc, r.score, r["rank"]) for r in top} == want
    read = {r.query: (r.decoded, r.blocks) for r in top}
    assert all(d <= n for d, n in read.values()) and sum(d for d, _ in read.values()) < sum(n for _, n in read.values())
    changed = docs.withColumn("text", F.when(F.col("doc") == 4, "t0 t0 t399").otherwise(F.col("text"))).withColumn("tokens", tokens)
    with pytest.raises(inverted.StaleIndex):
        index.top(terms, 10, (changed, "doc", "text"))
    assert index.refresh(changed, "doc", "text", "tokens") == [0] and {(r.shard, r.version) for r in index.versions().collect()} == {(0, 2), (1, 1)}
    want = {tuple(r) for r in V.top(V.bm25(changed, terms, "doc", "tokens"), ["query"], 10).select("query", "doc", "score", "rank").collect()}
    assert {(r.query, r.doc, r.score, r["rank"]) for r in index.top(terms, 10).collect()} == want
    even = changed.filter("doc % 2 = 0")
    assert index.refresh(even, "doc", "text", "tokens") == [1] and [r.shard for r in index.versions().collect()] == [0]


# Calendar -------------------------------------------------------------------------------------------


def _slot(plan, stamp):
    """By the rule, with the standard library's zones."""
    zone, local = ZoneInfo(plan.zone), stamp.replace(tzinfo=UTC).astimezone(ZoneInfo(plan.zone)).date()
    if plan.cadence == "INTERVAL":
        n = int(stamp.replace(tzinfo=UTC).timestamp() // plan.seconds)
        return f"{plan.seconds}:{n}"
    monday = local - timedelta(days=local.weekday())
    day, period = {"DAILY": (local, local.isoformat()), "WEEKLY": (monday + timedelta(days=plan.weekday), monday.isoformat()), "MONTHLY": (local.replace(day=plan.month_day), local.strftime("%Y-%m"))}[plan.cadence]
    due = datetime(day.year, day.month, day.day, plan.hour, plan.minute, tzinfo=zone).astimezone(UTC).replace(tzinfo=None)
    return period if stamp >= due else None


def test_calendar_slots_over_changes_of_clocks(spark):
    rng = random.Random(4)
    # Clocks go forward on 2024-03-10 and 03-31, back on 2024-10-27 and 11-03; hours around, and other times.
    around = [datetime(2024, *d) for d in ((3, 10, 6), (3, 31, 0), (10, 27, 0), (11, 3, 5))]
    stamps = [a + timedelta(minutes=15 * k) for a in around for k in range(-8, 20)] + [datetime(1969, 12, 30) + timedelta(seconds=rng.randint(0, 2 * 10**9)) for _ in range(300)]
    plans = [calendar.Plan(f"{c}{z}{h}", c, z, h, m, weekday=w, month_day=dd) for c in ("DAILY", "WEEKLY", "MONTHLY") for z in ("America/New_York", "Europe/Paris", "Asia/Ho_Chi_Minh") for h, m, w, dd in ((2, 30, 6, 10), (1, 30, 6, 27), (0, 0, 0, 28))]
    plans += [calendar.Plan("I", "INTERVAL", seconds=900)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "id long, at timestamp_ntz")
    got = {(r.id, r.plan): r.period for r in calendar.slots_of(rows, "at", plans).collect()}
    want = {(i, p.name): x for i, s in enumerate(stamps) for p in plans if (x := _slot(p, s)) is not None}
    assert got == want
    zoned = rows.select("id", F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp"))).alias("at"))
    assert {(r.id, r.plan): r.period for r in calendar.slots_of(zoned, "at", plans).collect()} == want
    with pytest.raises(ValueError):
        calendar.Plan("x", "MONTHLY", month_day=29)


def test_following_slots(spark):
    plan = calendar.Plan("m", "MONTHLY", "Europe/Paris", 2, 30, month_day=27)
    row = spark.createDataFrame([(datetime(2024, 9, 28),)], "at timestamp_ntz").select(calendar.slot(plan, F.col("at")).alias("s")).first().s
    assert (row.period, row.due, row.following) == ("2024-09", datetime(2024, 9, 27, 0, 30), datetime(2024, 10, 27, 0, 30))  # the first of two half past two


# Spans and late interaction -------------------------------------------------------------------------

_BREAK = re.compile(r"(?<=[.!?。！？])\s+|\n\s*\n")


def _spans_by_rule(text, most):
    """A stretch goes to the end of the last boundary in it, else behind the last blank of its second half, else it is full."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            ends = [m.end() for m in _BREAK.finditer(text[at:end])]
            blanks = [i for i in range(at + most // 2, end) if text[i] == " " and i > at]
            end = at + ends[-1] if ends else blanks[-1] + 1 if blanks else end
        yield at, end
        at = end


def test_spans_follow_the_rule():
    rng = random.Random(6)
    for most in (1, 2, 5, 13, 40):
        for _ in range(400):
            text = "".join(rng.choice("ab.!?。 \n\n\t  ") for _ in range(rng.randint(0, 120)))
            assert list(P._split(text, most)) == list(_spans_by_rule(text, most)), (text, most)


def test_spans_of_long_texts_are_linear():
    took = []
    for n in (200_000, 2_000_000):
        text = "word " * (n // 10) + "x" * (n // 10) + "\n a" * (n // 10) + "End. " * (n // 50)
        began = time.process_time()
        assert sum(b - a for a, b in P._split(text, 1800)) == len(text)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_max_sim_in_blocks(spark):
    rng = random.Random(5)
    vec = lambda d: [rng.gauss(0, 1) for _ in range(d)]
    queries = [(i % 7, i, vec(3 if i % 5 else 2)) for i in range(50)] + [(1, 90, None)]
    base = [(i % 9, vec(3 if i % 4 else 2)) for i in range(80)] + [(2, None), (3, [])]
    q, b = spark.createDataFrame(queries, "q long, k long, v array<double>"), spark.createDataFrame(base, "d long, v array<double>").repartition(3)
    want = {}
    for query in range(7):
        for doc in range(9):
            best = [max((math.fsum(x * y for x, y in zip(v, w)) for d, w in base if d == doc and w and len(w) == len(v)), default=None) for p, _, v in queries if p == query and v]
            if best := [x for x in best if x is not None]:
                want[query, doc] = pytest.approx(sum(best) / len(best), abs=2e-6)
    for block in (4096, 8, 1):
        assert {(r.query, r.doc): r.score for r in V.max_sim(q, b, "q", "d", "k", "v", block).collect()} == want
