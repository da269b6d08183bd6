"""Language profiles and toxicity scores against plain loops over letters, words and documents."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, toxicity

SF = "/root/testdata/sf0.001"


def _profile(text):
    """A document's unit vector, letter by letter."""
    signs = np.where(np.random.default_rng(20).integers(0, 2, (langid.LETTERS, langid.DIMENSIONS)) == 1, 1, -1)
    runs, word = [], []
    for letter in text or "":
        code = langid.Profiles._code(ord(letter))
        if code:
            word.append(code)
        elif word:
            runs.append(word)
            word = []
    runs += [word] if word else []
    if not runs:
        return None
    line = [0]
    for run in runs:
        line += [*run, 0]
    if not langid.Profiles._code(ord(text[-1])):
        line.append(0)  # what follows the last letter is a blank of its own
    total = np.zeros(langid.DIMENSIONS)
    for x, y, z in zip(line, line[1:], line[2:]):
        total += np.roll(signs[x], 2) * np.roll(signs[y], 1) * signs[z]
    norm = math.sqrt((total**2).sum())
    return total / norm if norm else None


def test_language_profiles_against_loops(spark):
    rows = [(r.doc_id, (r.text or "")[:400], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(1001, "Привет мир, это текст", "ru"), (1002, "  12 !", "ru"), (1003, None, None), (1004, "A", None), (1005, "ÉÈ  été", "fr"), (1006, "𝒳𝒴 中文字", "zh")]
    sums = {}
    for _, text, lang in rows:
        if lang is not None and (v := _profile(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learnt = langid.learn(docs)
    assert learnt.keys() == prototypes.keys() and all(np.allclose(learnt[k], prototypes[k], atol=1e-5) for k in prototypes)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(docs, learnt).collect()}
    for i, text, _ in rows:
        v = _profile(text)
        if v is None:
            assert got[i] == ("und", 0.0)
            continue
        near = {k: float(p @ v) for k, p in prototypes.items()}
        best = max(near.values())
        assert near[got[i][0]] == pytest.approx(best, abs=1e-5) and got[i][1] == pytest.approx(max(0, best), abs=1e-5)


def test_toxicity_is_learnt_as_counted(spark):
    """Lexicon and weights from plain counts, the fit by its own condition, and scores by the formula."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    rows = [(r.doc_id, int(r.toxic > 0), r.half) for r in labels.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).dropna().collect() if r.doc_id in texts]
    counts = {}
    for i, y, half in rows:
        words = set(toxicity._WORD.findall(texts[i].lower()))
        for feature in words | {f"{w[:n]}*" for w in words for n in toxicity.STEM_LETTERS if len(w) >= n}:
            counts.setdefault(feature, Counter())[half, y] += 1

    def lexicon(halves):
        n_all = sum(h in halves for *_, h in rows)
        base = (sum(y for _, y, h in rows if h in halves) + 1) / (n_all + 2)
        out = {}
        for feature, c in counts.items():
            if sum(v for (_, y), v in c.items() if y) < 3:
                continue
            toxic = sum(v for (h, y), v in c.items() if h in halves and y)
            n = max(1, sum(v for (h, _), v in c.items() if h in halves))
            p, z = toxic / n, toxicity.SURE
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            low = min(max(low, 1e-6), 1 - 1e-6)
            weight = round(math.log(low / (1 - low)) - math.log(base / (1 - base)), 4)
            if toxic >= 3 and weight >= toxicity.LEAST_WEIGHT:
                out[feature] = weight
        return out

    assert model["lexicon"] == pytest.approx(lexicon({0, 1}), abs=2e-4) and model["lexicon"]
    other = {h: toxicity.Grammar(lexicon({1 - h})) for h in (0, 1)}
    found = np.array([other[h].evidence(texts[i]) for i, _, h in rows], float)
    x, y = toxicity._features(*np.round(found, 6).T), np.array([y for _, y, _ in rows], float)
    w = model["weights"]
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + 0.05 * w
    assert np.abs(gradient).max() < 0.05  # at the least of the regularised loss, but for rounded weights
    grammar = toxicity.Grammar(model["lexicon"])
    for r in toxicity.score(docs, model).collect():
        total, most, words = grammar.evidence(texts[r.doc_id])
        z = w[0] + w[1] * math.log1p(total) + w[2] * most + w[3] * (math.log1p(words) if total > 0 else 0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
