"""The composed toxicity machine against the cascade's paths listed one by one, and against the rules said plainly."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries
from quarry.llm import toxicity as T


def all_paths(machine, symbols):
    """(outputs, weight) of every path from the start to a final state."""
    found = []

    def walk(state, at, outs, weight):
        if at == len(symbols):
            if state in machine.final:
                found.append((outs, weight))
            return
        for out, more, to in machine.arcs[state].get(symbols[at], ()):
            walk(to, at + 1, [*outs, out], weight + more)

    walk(machine.start, 0, [], 0.0)
    return found


def plainly(symbols):
    """The rules without machines: look around each harmful symbol."""
    def near(s, mark, i, before, after):
        return any(x == mark for x in s[max(0, i - before) : i]) or any(x == mark for x in s[i + 1 : i + 1 + after])

    step = [T.lowered(s, T.NEGATED) if s in T.HARM and near(symbols, "negation", i, T.REACH, T.AFTER) else s for i, s in enumerate(symbols)]
    if "report" in step:
        step = [T.lowered(s, T.REPORTED) if s in T.HARM else s for s in step]
    total = 0.0
    for i, s in enumerate(step):
        aimed = s in T.HARM and near(step, "target", i, T.REACH, T.REACH)
        if s in T.INSULTS:
            total += T.UNIT * (T.INSULTS.index(s) + 1) * (T.TARGETED if aimed else T.BARE)
        elif s in T.HARM and aimed:
            total += T.THREAT * (T.NEGATED if s == "weak threat" else 1)
    return total


def test_one_path_for_each_clause_and_the_rules_weight():
    rng = random.Random(1)
    machine, cascade = T.machine(), (T.negation(), T.reported_speech(), T.clause())
    some = ["insult2", "insult7", "threat", "target", "negation", "report", "plain"]
    clauses = [list(c) for n in range(4) for c in itertools.product(some, repeat=n)] + [rng.choices(some, (2, 2, 2, 2, 2, 1, 6), k=rng.randint(4, 12)) for _ in range(600)]
    for symbols in clauses:
        through = [(symbols, 0.0)]
        for part in cascade:
            through = [(outs, w + more) for read, w in through for outs, more in all_paths(part, read)]
        own = all_paths(machine, symbols)
        assert len(through) == len(own) == 1, symbols
        want = plainly(symbols)
        assert abs(own[0][1] - want) < 1e-9 and abs(through[0][1] - want) < 1e-9 and abs(machine.weigh(symbols) - want) < 1e-9


def test_letter_transducer():
    words = T.WordTrie({"gronk": 3.0, "snarl*": 1.2, "snarling": 6.0, "you": 6.0})
    assert [words.symbol(w) for w in ("gronk", "gronks", "snarl", "snarls", "snarling", "snar", "you", "not", "said", "töten", "tuer")] == [
        "insult5", "plain", "insult2", "insult2", "insult10", "plain", "target", "negation", "report", "threat", "threat",
    ]


def test_directions_and_languages():
    g = T.Grammar({})
    of = lambda t: g.evidence(t)[0]
    assert of("you idiot") > of("such an idiot") > of("no such idiot") > 0
    assert of("idiot, he said") == of("he said idiot") < of("he is an idiot")
    assert of("an idiot not at all") < of("an idiot at all")
    assert of("kill the lights") == of("") == of(None) == 0
    assert all(of(t) > 0 for t in ("ich werde dich töten", "je vais vous tuer", "voy a matar a usted", "du bist ein trottel", "tu es un crétin"))


@pytest.mark.parametrize("sf, least_recall, most_false", [("0.01", 0.5, 0.02)])
def test_held_out(spark, sf, least_recall, most_false):
    d = f"/root/testdata/sf{sf}"
    rows = queries.op5_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("toxic IS NOT NULL")
    r = rows.agg(F.sum("toxic").alias("toxic"), F.sum(F.col("toxic") * F.col("predicted")).alias("hit"), F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
    assert r.hit >= least_recall * r.toxic and r.wrong <= most_false * (r.n - r.toxic)


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op4_language_id(spark, d).filter("held_out AND lang_pred <> 'und'").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n and n > 100
