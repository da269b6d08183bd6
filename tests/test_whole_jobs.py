"""Queries over tables made here, where a part of the job was once left out."""

from datetime import datetime

from quarry.plans import registry


def _run(spark, d, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{t}.parquet")
    return registry.queries()[name](spark, str(d)).collect()


def test_bag_roots_take_all_versions(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), 1, "view", 50.0) for i in range(4950, 5100)]
    got = _run(spark, tmp_path, "t03_bag_roots", events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    assert {r.version for r in got} == {99, 100, 101}


def test_phrases_of_whole_texts(spark, tmp_path):
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(420)) + " one two three four five" + " one two" * (i % 2)) for i in range(5)] + [(9, "one two three"), (10, None)]
    got = _run(spark, tmp_path, "c06_phrase_mining", documents=(texts, "doc_id long, text string"))
    docs, uses = {}, {}
    for i, text in texts:
        w = (text or "").split()
        for n in (2, 3, 4):
            for k in range(len(w) - n + 1):
                phrase = " ".join(w[k : k + n])
                docs.setdefault(phrase, set()).add(i)
                uses[phrase] = uses.get(phrase, 0) + 1
    want = {(p, len(d), uses[p]) for p, d in docs.items() if len(d) >= 5}
    assert {(r.phrase, r.docs, r.uses) for r in got} == want and len(want) == 9
