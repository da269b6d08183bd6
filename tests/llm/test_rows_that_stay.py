"""Removal is per row: null identifiers, and identifiers that rows of different texts share."""

import random

from quarry.llm import decontam, exactdup, neardup

from .test_operators import words


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_drops_rows_not_identifiers(spark):
    stays = [(1, "copied"), (None, "alone"), (2, "mine"), (2, None), (9, "twice")]
    lost = [(None, "COPIED"), (2, "Twice")]
    assert _left(exactdup.drop_exact(_docs(spark, stays + lost))) == sorted(stays, key=repr)


def test_leaks_drop_rows_not_identifiers(spark):
    rng = random.Random(5)
    passage = words(rng, 30)
    stays = [(None, words(rng, 60)), (7, words(rng, 60)), (2, None), (None, None), (3, words(rng, 40))]
    lost = [(None, words(rng, 20) + " " + passage), (1, passage + " " + words(rng, 20)), (3, passage)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert _left(decontam.drop_leaks(_docs(spark, stays + lost), bench)) == sorted(stays, key=repr)


def test_near_drops_rows_not_identifiers(spark):
    rng = random.Random(6)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    stays = [(1, base), (5, words(rng, 120)), (5, None), (None, words(rng, 80))]
    assert _left(neardup.drop_near(_docs(spark, [*stays, (5, " ".join(near)), (None, " ".join(near))]))) == sorted(stays, key=repr)


def test_seven_rows(spark):
    """Null and shared identifiers beside copies: only the copies that lose go."""
    rng = random.Random(7)
    rows = [(None, "same"), (None, "unique text A"), (None, "unique text B"), (7, "same"), (3, "x"), (3, "y only"), (5, "x")]
    assert _left(exactdup.drop_exact(_docs(spark, rows))) == sorted([r for r in rows if r not in ((None, "same"), (3, "x"))], key=repr)
    assert _left(neardup.drop_near(_docs(spark, rows))) == sorted([r for r in rows if r not in ((None, "same"), (5, "x"))], key=repr)
    passage = words(rng, 30)
    leaking = [(None, passage), (3, "b " + passage)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert _left(decontam.drop_leaks(_docs(spark, rows + leaking), bench)) == sorted(rows, key=repr)


def test_repeated_rows_leave_one(spark):
    """Rows that share an identifier, a null one too, and their text: one of them stays."""
    rows = [(None, "same")] * 3 + [(7, "dup"), (7, "dup"), (3, "dup"), (8, None), (8, ""), (9, "alone")]
    assert _left(exactdup.drop_exact(_docs(spark, rows))) in [sorted([(None, "same"), (7, "dup"), (9, "alone"), (8, t)], key=repr) for t in (None, "")]
    assert exactdup.drop_exact(_docs(spark, rows * 40).repartition(5)).count() == 4


def test_near_copies_without_or_with_one_identifier(spark):
    rng = random.Random(8)

    def copies(n):
        base = words(rng, 120).split()
        out = []
        for i in range(n):
            base[10 * i] = f"changed{i}"
            out.append(" ".join(base))
        return out

    unnamed, shared, named = copies(5), copies(2), copies(3)
    rows = [(None, t) for t in unnamed] + [(5, t) for t in shared] + [(2, named[0]), (1, named[1]), (None, named[2]), (1, named[1])] + [(None, None), (None, ""), (None, unnamed[0])]
    left = _left(neardup.drop_near(_docs(spark, rows).repartition(3)))
    assert len(left) == 5 and (1, named[1]) in left and (None, "") in left and (None, None) in left
    assert sum(t in unnamed for _, t in left) == 1 and sum(i == 5 for i, _ in left) == 1


def test_copies_with_other_columns_keep_them(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeated_text string")
    for drop in (exactdup.drop_exact, neardup.drop_near):
        left = [tuple(r) for r in drop(docs).collect()]
        assert len(left) == 2 and set(left) < set(rows) and drop(docs).columns == docs.columns
