"""Stored bags and their verification, states of an index, and the contract of a graph that is read back."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarry.operators import bags, graphs

RULES = bags.Settings(dimension=8, size=4)
UNITS = "root string, unit int, title string, text string, bag string"
WORDS = ["river", "stone", "cloud", "grass", "night"]


def _text(n, word=""):
    return " ".join(f"{WORDS[k % 5]} {WORDS[k % 3]} {k}{word}." for k in range(n))


ROWS = [("a", 1, "Rivers", _text(10), "x"), ("a", 2, None, _text(3), "x"), ("b", 1, "  ", "One only", None), (None, None, None, "No name. Two.", "x"), ("b", 2, None, None, "x"), ("c", 1, "", "", "x"), ("d", 1, "Title alone", None, "x")]


def units(spark, rows=ROWS):
    return spark.createDataFrame(rows, UNITS)


ASK = ("root", "unit", "text", RULES, "title")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('bags')}/store"
    store = bags.BagStore(spark, folder)
    store.build(1, units(spark), *ASK)
    return store


def verdicts(found):
    return sorted(((r.root, r.unit, r.verdict) for r in found.collect()), key=str)


def test_sources_are_offsets_into_title_and_text(spark):
    got = bags.sources(units(spark), "root", "unit", "text", 4, "title").collect()
    want = []
    for root, unit, title, text, _ in ROWS:
        own = [("title", 0, len(title), title)] if title and title.strip() else []
        own += [("text", m.start(), m.end(), m[0]) for m in re.finditer(r"\S[^.]*(\.|$)", text or "")]
        want += [(root, unit, k, k // 4, *s) for k, s in enumerate(own)]
    assert sorted(((r.root, r.unit, r.place, int(re.search(r'"part":(\d+)', r.bag)[1]), r.kind, r.start, r.stop, r.text) for r in got), key=str) == sorted(want, key=str)
    assert len({r.bag for r in got}) == len({w[:2] + w[3:4] for w in want})


def test_unchanged_bags_are_valid_and_builds_can_be_repeated(spark, built):
    want = sorted([("a", 1, "VALID")] * 3 + [("a", 2, "VALID"), ("b", 1, "VALID"), (None, None, "VALID"), ("d", 1, "VALID")], key=str)
    assert verdicts(built.verify(units(spark), *ASK)) == want
    first = {r.bag: r.print for r in built.bags().collect()}
    built.build(1, units(spark).repartition(3), *ASK)
    assert {r.bag: r.print for r in built.bags().collect()} == first and verdicts(built.verify(units(spark), *ASK)) == want


def test_only_bags_whose_sources_changed_are_told(spark, built):
    long = _text(10)
    now = [("a", 1, "Rivers", long.replace("8.", "9."), "x"), ("a", 2, None, _text(3) + " \n", "x"), ("b", 1, "One", "One only", None), ("b", 2, None, "New", "x")]
    # The ninth sentence and the title lie in bags of their own; blanks at the end belong to no source; two units are gone.
    assert verdicts(built.verify(units(spark, now), *ASK)) == sorted([("a", 1, "SOURCE_CHANGED"), ("a", 1, "VALID"), ("a", 1, "VALID"), ("a", 2, "VALID"), ("b", 1, "SOURCE_CHANGED"), ("b", 2, "MISSING"), (None, None, "ORPHAN"), ("d", 1, "ORPHAN")], key=str)
    assert {v for _, _, v in verdicts(built.verify(units(spark), "root", "unit", "text", replace(RULES, threshold=0.9), "title"))} == {"SETTINGS"}
    assert verdicts(built.verify(units(spark, []), *ASK))[0][2] == "ORPHAN"


@pytest.mark.parametrize(
    ("change", "verdict"),
    [
        (lambda m: m.filter("NOT (root = 'a' AND unit = 1 AND place = 5)"), "MEMBERS"),
        (lambda m: m.withColumn("text", F.when((F.col("root") == "a") & (F.col("place") == 5), "other").otherwise(F.col("text"))), "MEMBERS"),
        (lambda m: m.withColumn("vector", F.when((F.col("root") == "a") & (F.col("place") == 5), F.slice("vector", 1, 7)).otherwise(F.col("vector"))), "VECTORS"),
        (lambda m: m.withColumn("vector", F.when((F.col("root") == "a") & (F.col("place") == 5), F.transform("vector", lambda x: F.lit(float("nan")))).otherwise(F.col("vector"))), "VECTORS"),
        (lambda m: m.withColumn("cluster", F.when((F.col("root") == "a") & (F.col("place") == 5), 77).otherwise(F.col("cluster"))), "GROUPS"),
        (lambda m: m.withColumn("vector", F.when((F.col("root") == "a") & (F.col("place") == 5), F.transform("vector", lambda x: x + 1)).otherwise(F.col("vector"))), "CHECKSUM"),
    ],
)
def test_damage_is_told_by_kind(spark, built, tmp_path, change, verdict):
    folder = f"file://{tmp_path}/damaged"
    for kind in ("members", "bags"):
        rows = spark.read.parquet(f"{built.folder}/{kind}/build=1")
        (change(rows) if kind == "members" else rows).write.parquet(f"{folder}/{kind}/build=1")
    found = bags.BagStore(spark, folder).verify(units(spark), *ASK)
    assert [v for v in verdicts(found) if v[2] != "VALID"] == [("a", 1, verdict)]
    assert verdicts(bags.gravest(found, "root", "unit"))[0] == ("a", 1, verdict)


def test_a_later_build_stands_for_the_units_that_it_names(spark, built, tmp_path):
    store = bags.BagStore(spark, f"file://{tmp_path}/store")
    store.build(1, units(spark), *ASK)
    changed = [("a", 1, "Rivers", _text(2), "x")]  # fewer bags than before: the old ones are no orphans
    store.build(2, units(spark, changed), *ASK)
    assert {v[2] for v in verdicts(store.verify(units(spark, [*changed, *ROWS[1:]]), *ASK))} == {"VALID"}


def test_states_of_an_index(spark):
    prints = lambda rows: bags.input_prints(units(spark, rows), "root", "unit", "text", ["bag"], RULES)
    one = lambda root, text="Some text.", bag="x": (root, 1, None, text, bag)
    names = ["ready", "broken", "stale", "column", "failed", "running", "gone", None]
    before = prints([one(n) for n in names])
    log = [(r.root, 1, "COMPLETED", r.print, None) for r in before.collect()]
    log += [(r, 2, s, p, e) for r, n, _, p, _ in log for s, e in [("FAILED", "WHY")] if r == "failed"] + [(r, 2, "RUNNING", p, None) for r, n, _, p, _ in log if r == "running"]
    runs = spark.createDataFrame(log, "root string, run int, status string, print string, error string")
    live = [one(n) for n in names if n not in ("stale", "column", "gone")] + [one("stale", "Some text"), one("column", bag=None), one("new"), one("empty", " \n"), one("twice"), one("twice", "b")]
    told = spark.createDataFrame([("broken", "VALID"), ("broken", "GROUPS"), ("ready", "VALID"), (None, "VALID"), ("running", "MISSING")], "root string, verdict string")
    got = {r.root: (r.state, r.code) for r in bags.states(prints(live), runs, told).collect()}
    assert got == {
        "ready": ("READY", None), None: ("READY", None), "broken": ("STALE", "INDEX_ARTIFACT_INVALID"), "stale": ("STALE", "INDEX_SOURCE_CHANGED"), "column": ("STALE", "INDEX_SOURCE_CHANGED"), "failed": ("FAILED", "WHY"),
        "running": ("RUNNING", None), "gone": ("CONTENT_NOT_READY", "CONTENT_NOT_READY"), "new": ("NOT_STARTED", None), "empty": ("CONTENT_NOT_READY", "EMPTY_CONTENT"), "twice": ("CONTENT_NOT_READY", "CONTENT_NOT_READY"),
    }
    # Neither the order nor the partitions of the input matter, its settings do.
    again = bags.input_prints(units(spark, live[::-1]).repartition(3), "root", "unit", "text", ["bag"], RULES)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in prints(live).collect()}
    other = bags.input_prints(units(spark, live), "root", "unit", "text", ["bag"], replace(RULES, model="other"))
    assert not {r.print for r in other.collect()} & {r.print for r in again.collect()}
    assert bags.states(prints([]), runs.limit(0), told.limit(0)).collect() == []


def test_graph_contract(spark):
    nodes = [(["A"], {"id": "1"}), (["A"], {"id": "1"}), (["A"], {"id": "1"}), (["A"], {"id": "2"}), (["B"], {"id": "1"}), (["Z"], {"id": "1"}), (["A", "B"], {"id": "3"}), ([], {"id": "4"}), (None, {"id": "5"}), (["A"], {"id": None}), (["A"], {"id": "6", "name": "x"}), (["A"], {}), (["A"], None)]
    edges = [(["A"], "1", "HAS", ["B"], "1", {}), (["A"], "1", "HAS", ["B"], "1", {}), (["A"], "2", "HAS", ["B"], "1", {}), (["A"], "1", "IN", ["B"], "1", {}), (["A"], "1", "HAS", ["B"], "1", {"k": "v"}), (["A", "B"], "1", "HAS", ["B"], "1", {}), (["A"], None, "HAS", ["B"], "1", {}), (["A"], "1", "HAS", None, "1", {}), (["A"], "1", "HAS", ["B"], "9", None)]
    n = spark.createDataFrame(nodes, "labels array<string>, props map<string,string>")
    e = spark.createDataFrame(edges, "a_labels array<string>, a string, rel string, b_labels array<string>, b string, props map<string,string>")
    got = {(r.part, r["shape"], r.problem): r.n for r in graphs.read_back(n, e, ["A", "B"]).collect()}
    assert got == {
        ("node", "A", "OK"): 2, ("node", "A", "DUPLICATE"): 2, ("node", "A", "UNEXPECTED"): 4, ("node", "B", "OK"): 1, ("node", "Z", "UNEXPECTED"): 1, ("node", "A+B", "UNEXPECTED"): 1, ("node", "", "UNEXPECTED"): 1, ("node", "?", "UNEXPECTED"): 1,
        ("edge", "A-HAS->B", "OK"): 2, ("edge", "A-HAS->B", "DUPLICATE"): 1, ("edge", "A-IN->B", "OK"): 1, ("edge", "A-HAS->B", "UNEXPECTED"): 3, ("edge", "A+B-HAS->B", "UNEXPECTED"): 1, ("edge", "A-HAS->?", "UNEXPECTED"): 1,
    }
    assert graphs.read_back(n.limit(0), e.limit(0), ["A"]).collect() == []


def test_texts_and_vectors_are_not_shuffled(spark, built):
    """What the check of stored bags shuffles are digests, each as long as any other."""
    plan = built.verify(units(spark), *ASK)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and "MapInArrow" not in plan and "FlatMapGroupsInArrow" not in plan
    assert "Exchange hashpartitioning(bag" in plan and "Window" not in plan and "LeftSemi" in plan
    reads = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("vector" in line for line in reads) == 1  # members are read once
