"""Toxicity scores from a weighted finite-state grammar over clauses.

Words become symbols by a letter transducer: a trie of insults (with a level), threats, targets,
negations and reporting verbs, in which a stem's end state loops over all further letters. Three
transducers over symbols are composed into one machine:

* negation lowers insults and threats up to ``REACH`` words after, or ``AFTER`` words before, a
  negation word;
* reported speech lowers all of a clause that has a reporting verb anywhere in it;
* the clause transducer matches an insult with a target, an insult alone (for less), and a threat
  with a target, where a target is at most ``REACH`` words away on either side.

They guess what follows and check the guess, so each clause has exactly one path through the
composed machine, and the path's weight is the clause's output. The score is a logistic function
of the sum and the maximum of the matched clauses' outputs and the text's length.

The insult transducer holds a fixed core and entries learned from labelled rows: words and stems
(prefixes of 4 to 8 letters) whose share of toxic documents is significantly high (Wilson bound).
Both it and the logistic function are fitted on at most ``sample_rows`` labelled rows, chosen by a
hash of the identifier, the latter with lexicons of the other half (cross-fitting). That sample
bounds the lexicon.

Null and empty texts score what no match scores. Repeated rows are each scored. A label joins by
identifier; null labels and identifiers are not learned from. Conflicting labels count each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import staged
from quarry.llm.tokens import forget

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
STEM_LETTERS = (4, 5, 6, 7, 8)
MEMO_WORDS = 400_000
#: Standard errors by which a feature's share is lowered, and log-odds above the base rate that must be left.
SURE, LEAST_WEIGHT = 3.0, 1.2

CORE_INSULTS = {w: 3.0 for w in (
    "clown disgusting idiot imbecile loser moron pathetic scum stupid trash vermin worthless "
    "abschaum arschloch dummkopf ekelhaft trottel versager wertlos widerlich "
    "abruti connard crétin dégoûtant imbécile minable ordure stupide "
    "asqueroso basura estúpido idiota imbécil inútil patético perdedor"
).split()}
THREATS = set(
    "kill hurt destroy murder beat burn shoot stab strangle attack "
    "töten umbringen verletzen zerstören ermorden verprügeln verbrennen erschießen erstechen erwürgen "
    "tuer blesser détruire assassiner frapper brûler poignarder étrangler attaquer "
    "matar herir destruir asesinar golpear quemar disparar apuñalar estrangular atacar".split()
)
TARGETS = set(
    "you your yours he him she her they them these those du dich dir ihr euch sie ihn ihm "
    "tu toi te vous lui eux usted ustedes ti ellos ellas".split()
)
NEGATIONS = set(
    "not no never neither nor isn aren wasn weren don doesn didn won cannot nicht kein keine keinen nie niemals "
    "pas jamais nunca jamás tampoco".split()
)
REPORTING = set(
    "said says called calls wrote writes quoted quotes quote claimed claims sagte sagt schrieb nannte "
    "dit écrit déclaré dijo dice escribió".split()
)
#: Words that a negation or a target reaches across, and that a negation reaches back.
REACH, AFTER = 4, 2
#: Insults have levels 1 to LEVELS, each of weight UNIT.
LEVELS, UNIT = 10, 0.6
NEGATED, REPORTED, TARGETED, BARE, THREAT = 0.3, 0.5, 1.25, 0.75, 2.5

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")

INSULTS = tuple(f"insult{n}" for n in range(1, LEVELS + 1))
HARM = (*INSULTS, "threat", "weak threat")
#: What a clause consists of; threats are of full strength at first.
ALPHABET = (*INSULTS, "threat", "target", "negation", "report", "plain")


class Transducer:
    """Arcs ``state -> symbol -> [(output, weight, next)]``, a start state and the set of final states."""

    def __init__(self, start, arcs: dict, final: set):
        self.start, self.arcs, self.final = start, arcs, final

    @classmethod
    def built(cls, start, step: Callable, final: Callable, alphabet: Iterable[str]) -> Transducer:
        """All states that can be reached from ``start`` by ``step(state, symbol)``."""
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {s: found for s in alphabet if (found := list(step(state, s)))}
            todo += [to for found in arcs[state].values() for _, _, to in found]
        return cls(start, arcs, {s for s in arcs if final(s)})

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds this one's output to ``then``; weights add up. States get numbers."""
        alphabet = {s for by in self.arcs.values() for s in by}

        def step(state, symbol):
            for middle, weight, left in self.arcs[state[0]].get(symbol, ()):
                for out, more, right in then.arcs[state[1]].get(middle, ()):
                    yield out, weight + more, (left, right)

        both = Transducer.built((self.start, then.start), step, lambda s: s[0] in self.final and s[1] in then.final, sorted(alphabet))
        return both._useful()

    def _useful(self) -> Transducer:
        """Without states from which no final one can be reached, and numbered."""
        before: dict = {}
        for state, by in self.arcs.items():
            for found in by.values():
                for _, _, to in found:
                    before.setdefault(to, set()).add(state)
        good, todo = set(), list(self.final)
        while todo:
            state = todo.pop()
            if state not in good:
                good.add(state)
                todo += before.get(state, ())
        number = {s: i for i, s in enumerate([self.start, *(s for s in self.arcs if s in good and s != self.start)])}
        arcs = {number[s]: {symbol: kept for symbol, found in by.items() if (kept := [(o, w, number[to]) for o, w, to in found if to in good])} for s, by in self.arcs.items() if s in number}
        return Transducer(0, arcs, {number[s] for s in self.final if s in number})

    def weigh(self, symbols: Iterable[str]) -> float:
        """The largest weight of a path that reads ``symbols`` from the start to a final state; 0 without one."""
        now = {self.start: 0.0}
        for symbol in symbols:
            then: dict = {}
            for state, weight in now.items():
                for _, more, to in self.arcs[state].get(symbol, ()):
                    then[to] = max(then.get(to, -math.inf), weight + more)
            now = then
        return max((w for s, w in now.items() if s in self.final), default=0.0)


def lowered(symbol: str, factor: float) -> str:
    """An insult of a lower level, or a weak threat."""
    if symbol in INSULTS:
        return INSULTS[max(1, round((INSULTS.index(symbol) + 1) * factor)) - 1]
    return "weak threat"


def near(mark: str, before: int, after: int, alphabet: Iterable[str], touched: Callable, untouched: Callable) -> Transducer:
    """Rewrites harmful symbols by whether ``mark`` stands near: up to ``before`` symbols earlier or ``after`` later.

    A state says how long the last mark still reaches, for how many symbols none may come, and within
    how many one must. ``touched`` and ``untouched`` give a harmful symbol's (output, weight).
    """

    def step(state, symbol):
        reach, none, must = state
        if symbol == mark:
            if not none:
                yield symbol, 0.0, (before, 0, 0)
            return
        if must == 1:
            return
        later = max(reach - 1, 0), max(none - 1, 0), max(must - 1, 0)
        if symbol not in HARM:
            yield symbol, 0.0, later
        elif reach or must:
            yield *touched(symbol), later
        else:
            yield *untouched(symbol), (0, after, 0)
            yield *touched(symbol), (0, later[1], after)

    return Transducer.built((0, 0, 0), step, lambda s: not s[2], alphabet)


def negation() -> Transducer:
    return near("negation", REACH, AFTER, ALPHABET, lambda s: (lowered(s, NEGATED), 0.0), lambda s: (s, 0.0))


def reported_speech() -> Transducer:
    """From the start, guesses that the clause has a reporting verb (and lowers all), or that it has none."""

    def step(state, symbol):
        if state in ("start", "none") and symbol != "report":
            yield symbol, 0.0, "none"
        if state != "none":
            yield (lowered(symbol, REPORTED) if symbol in HARM else symbol), 0.0, "seen" if symbol == "report" or state == "seen" else "awaited"

    return Transducer.built("start", step, lambda s: s != "awaited", (*ALPHABET, "weak threat"))


def clause() -> Transducer:
    """Weighs insults with and without a target, and threats with one."""

    def weight(symbol, insult, threat):
        if symbol in INSULTS:
            return UNIT * (INSULTS.index(symbol) + 1) * insult
        return threat * (NEGATED if symbol == "weak threat" else 1.0)

    return near(
        "target", REACH, REACH, (*ALPHABET, "weak threat"),
        lambda s: ("match", weight(s, TARGETED, THREAT)), lambda s: ("match", weight(s, BARE, 0.0)),
    )


_machine: list[Transducer] = []


def machine() -> Transducer:
    """Negation, reported speech and clause composed, made once per process."""
    if not _machine:
        _machine.append(negation().compose(reported_speech()).compose(clause()))
    return _machine[0]


class WordTrie:
    """The letter transducer: words and stems (ending in ``*``) to symbols; the strongest match counts."""

    def __init__(self, insults: dict[str, float]):
        self.root: dict = {}
        for kind, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTING)):
            for word in words:
                self._add(word, (2.0, kind))
        for entry, weight in insults.items():
            self._add(entry, (1.0, min(LEVELS, max(1, round(weight / UNIT)))))

    def _add(self, entry: str, output: tuple) -> None:
        node = self.root
        for letter in entry.removesuffix("*"):
            node = node.setdefault(letter, {})
        key = "open" if entry.endswith("*") else "end"
        node[key] = max(node.get(key, output), output)

    def symbol(self, word: str) -> str:
        node, best = self.root, (0.0, 0)
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
            best = max(best, node.get("open", best))
        else:
            best = max(best, node.get("end", best))
        rank, found = best
        return "plain" if not rank else found if rank > 1 else INSULTS[found - 1]


class Grammar:
    """Word symbols, with a memo, and the composed machine over clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.words, self.machine = WordTrie({**CORE_INSULTS, **lexicon}), machine()
        self.memo: dict[str, str | bool] = {}
        self.clauses: dict[tuple, float] = {}

    def symbols(self, words: list[str]) -> list[str | bool]:
        """Each word's symbol; False for plain ones."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = list(map(memo.get, words))
        if None in found:
            for i, s in enumerate(found):
                if s is None:
                    symbol = self.words.symbol(words[i])
                    found[i] = memo[words[i]] = False if symbol == "plain" else symbol
        return found

    def clause(self, symbols: list[str | bool]) -> float:
        """The composed machine's weight of one clause. Beyond ``REACH`` plain words, more change nothing."""
        read, plain = [], 0
        for s in symbols:
            plain = 0 if s else plain + 1
            if plain <= REACH:
                read.append(s or "plain")
        key = tuple(read)
        if len(self.clauses) > MEMO_WORDS:
            self.clauses.clear()
        if key not in self.clauses:
            self.clauses[key] = self.machine.weigh(key)
        return self.clauses[key]

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Sum and maximum of the matched clauses' outputs, and the number of words."""
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        found = self.symbols(_WORD.findall(low))
        if not any(s in HARMFUL for s in found if s):
            return 0.0, 0.0, float(len(found))
        outs = [0.0]
        for part in _CLAUSE.split(low):
            symbols = self.symbols(_WORD.findall(part))
            if any(s in HARMFUL for s in symbols if s):
                outs.append(self.clause(symbols))
        return sum(outs), max(outs), float(len(found))


HARMFUL = frozenset(HARM)


def _features(total: np.ndarray, most: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A constant, the evidence, the strongest clause, and how far plain text dilutes the evidence."""
    return np.stack([np.ones_like(total), np.log1p(total), most, np.log1p(words) * (total > 0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _weight(toxic: Column, n: Column, base: Column) -> Column:
    """Log-odds by which a feature's share of toxic documents surely (Wilson bound) exceeds the base rate; null if it doesn't by enough."""
    n = F.greatest(n, F.lit(1))
    p = toxic / n
    low = (p + SURE**2 / (2 * n) - SURE * F.sqrt(p * (1 - p) / n + SURE**2 / (4 * n * n))) / (1 + SURE**2 / n)
    low = F.least(F.greatest(low, F.lit(1e-6)), F.lit(1 - 1e-6))
    weight = F.round(F.log(low / (1 - low)) - F.log(base / (1 - base)), 4)
    return F.when((toxic >= 3) & (weight >= LEAST_WEIGHT), weight)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Lexicon and logistic weights, from ``labels`` (id, label) joined to ``docs``."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    rows = rows.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_y").limit(sample_rows)
    # At most sample_rows narrow rows: its size is bounded by that parameter.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(rows), "_id").select("_text", (F.col("_y") > 0).cast("int").alias("_y"), F.pmod("_h", F.lit(2)).cast("int").alias("_half"))
    sample = staged(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in seen], t) for i, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
            return pa.RecordBatch.from_arrays([*keys, pa.array(list(seen.values()), pa.int64())], names=["feature", "half", "y", "n"])

        for batch in batches:
            for text, y, half in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2))):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                stems = {f"{w[:n]}*" for w in words for n in STEM_LETTERS if len(w) >= n}
                for feature in (*words, *stems):
                    seen[feature, half, y] += 1
                if len(seen) > 200_000:
                    yield counted()
                    seen = Counter()
        if seen:
            yield counted()

    def part(half: int, n: Column) -> Column:
        return F.sum(F.when(F.col("half") == half, n).otherwise(0))

    # Two rows at most: one for each half.
    sizes = {r._half: (r.toxic, r.n) for r in sample.groupBy("_half").agg(F.sum("_y").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    halves = [sizes.get(i, (0, 0)) for i in (0, 1)]
    bases = [F.lit((t + 1) / (n + 2)) for t, n in (*halves, tuple(map(sum, zip(*halves))))]
    toxic = F.when(F.col("y") > 0, F.col("n")).otherwise(0)
    counted = sample.mapInArrow(count, "feature string, half int, y int, n long").groupBy("feature").agg(*(part(i, x).alias(f"{name}{i}") for i in (0, 1) for name, x in (("t", toxic), ("n", F.col("n")))))
    pairs = [(F.col("t0"), F.col("n0")), (F.col("t1"), F.col("n1")), (F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1"))]
    counted = counted.filter("t0 + t1 >= 3").select("feature", *(_weight(t, n, b).alias(f"w{i}") for i, ((t, n), b) in enumerate(zip(pairs, bases))))
    lexicons: list[dict] = [{}, {}, {}]
    for feature, *found in counted.filter("w0 IS NOT NULL OR w1 IS NOT NULL OR w2 IS NOT NULL").orderBy("feature").collect():
        for lexicon, weight in zip(lexicons, found):
            if weight is not None:
                lexicon[feature] = weight

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(lexicons[1]), Grammar(lexicons[0])]
        for batch in batches:
            found = [grammars[h].evidence(t.as_py()) for t, h in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(pa.array([round(f[i], 6) for f in found], pa.float64()) for i in range(3)), batch.column(1)], names=["total", "most", "words", "y"])

    fitted = sample.mapInArrow(score, "total double, most double, words double, y int").groupBy("total", "most", "words", "y").count().toPandas()  # at most sample_rows rows
    fitted = fitted.sort_values(["total", "most", "words", "y"])
    n = fitted["count"].to_numpy(int)
    x = np.repeat(_features(*(fitted[c].to_numpy(float) for c in ("total", "most", "words"))), n, axis=0)
    y = np.repeat(fitted["y"].to_numpy(float), n)
    weights = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([-3.0, 2.0, 0.5, 0.0])
    return {"lexicon": lexicons[2], "weights": weights}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind, weights, lexicon = to_arrow_type(docs.schema[id_col].dataType), model["weights"], model["lexicon"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        grammar = Grammar(lexicon)
        for batch in batches:
            found = np.array([grammar.evidence(t.as_py()) for t in batch.column(1)], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(_features(*found.T) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(p)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    weights, lexicon, at = model["weights"], model["lexicon"], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        grammar = Grammar(lexicon)
        for batch in batches:
            found = np.array([grammar.evidence(t.as_py()) for t in batch.column(at)], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(_features(*found.T) @ weights, -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
