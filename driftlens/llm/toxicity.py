"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and
digits or signs that stand for letters become plain letters, anything that is
not a letter or digit becomes a blank. The lexicon holds whole words and word
beginnings with weights (log odds of toxic against clean labelled documents);
exception phrases are pairs of neighbouring words that hold a lexicon word but
are common in clean documents only, and cancel its weight.

A document's hit weight is normalised by length: ``weight / log2(8 + words)``.
A logistic curve over it, fitted on the same labelled sample, gives the score.

Learning takes at most ``SAMPLE`` labelled documents (smallest id hash) and
``CHARS`` characters of each and keeps at most ``TERMS`` terms. Scoring reads
whole texts. NULL and empty texts have no hits and get the score of no hits.
Rows keep their multiplicity; without labelled rows every score is 0.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, crc_class, slices, table

SAMPLE, CHARS, TERMS = 12_000, 20_000, 3_000
#: A term needs this many toxic documents, this share of them, this log-odds weight, and this many that no better
#: term explains; an exception phrase needs this many clean documents.
SUPPORT, SHARE, WEIGHT, MARGIN, EXCEPTIONS = 3, 0.02, 2.0, 2, 3
#: A term in this share of toxic documents with this weight counts even if better terms explain all its documents.
COMMON, STRONG = 0.05, 4.0
SHORTEST, LONGEST = 4, 8

#: Look-alike letters of other scripts, and signs used for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ⅰ": "i"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
DROPPED = "­​‌‍⁠﻿"


class Folds(dict):
    """Code point to folded text, filled as characters appear."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        got = "" if c in DROPPED else LOOKALIKES.get(c) or SIGNS.get(c) or (c if c.isalnum() else " ")
        self[code] = got
        return got


FOLDS = Folds()


def fold(text: str) -> str:
    """Blank-separated folded words with a blank at both ends."""
    return " " + " ".join(text.lower().translate(FOLDS).split()) + " "


def terms_of(words: set[str]) -> set[str]:
    """Whole words as ``' word '`` and beginnings as ``' begin'``."""
    out = {f" {w} " for w in words if len(w) <= 40}
    for w in words:
        for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def learn(rows: list[tuple[str, int]]) -> dict:
    """Lexicon, exception phrases and curve from (text, label) rows."""
    folded = [(fold(t or ""), y) for t, y in dict.fromkeys(rows)]
    clean, holders, totals = Counter(), defaultdict(list), [0, 0]
    for k, (text, y) in enumerate(folded):
        words = terms_of(set(text.split()))
        totals[y] += 1
        if y:
            for term in words:
                holders[term].append(k)
        else:
            clean.update(words)
    lexicon = covering(holders, clean, totals)
    model = {"lexicon": lexicon, "exceptions": {}, "curve": (-20.0, 0.0)}
    model["exceptions"] = exception_phrases(folded, lexicon)
    matcher = Matcher(model)
    x = np.array([matcher.weight(t) for t, _ in folded])
    model["curve"] = fit_curve(x, np.array([y for _, y in folded], float))
    return model


def covering(holders, clean, totals) -> dict[str, float]:
    """Terms chosen one by one for the toxic documents that no earlier term explains.

    A term must explain enough further documents, so words that merely share a
    long or often copied toxic document with a real term are not learned.
    """
    least = max(SUPPORT, SHARE * totals[1])
    weights = {}
    for term, own in holders.items():
        w = math.log((len(own) + 0.5) / (totals[1] + 1)) - math.log((clean[term] + 0.5) / (totals[0] + 1))
        if len(own) >= least and w >= WEIGHT:
            weights[term] = w
    chosen, open_docs = {}, set(k for own in holders.values() for k in own)
    # Gains only shrink, so a stale best that is still best after its update is the true best.
    queue = [(-len(holders[t]) * w, -len(t), t) for t, w in weights.items()]
    heapq.heapify(queue)
    while queue and len(chosen) < TERMS:
        gain, size, term = heapq.heappop(queue)
        left = [k for k in holders[term] if k in open_docs]
        if len(left) < MARGIN:
            continue
        if -len(left) * weights[term] > gain + 1e-9:
            heapq.heappush(queue, (-len(left) * weights[term], size, term))
            continue
        chosen[term] = weights[term]
        open_docs.difference_update(left)
    for term in sorted(weights, key=lambda t: (len(t), t)):
        if len(holders[term]) >= COMMON * totals[1] and weights[term] >= STRONG and not any(term.startswith(c.rstrip()) for c in chosen):
            chosen[term] = weights[term]
    return chosen


def exception_phrases(folded, lexicon) -> dict[str, float]:
    good, bad = Counter(), Counter()
    for text, y in folded:
        words = text.split()
        hit = [k for k, w in enumerate(words) if f" {w} " in lexicon]
        pairs = {(words[k - 1], words[k]) for k in hit if k} | {(words[k], words[k + 1]) for k in hit if k + 1 < len(words)}
        (bad if y else good).update(pairs)
    out = {}
    for (a, b), k in good.items():
        if k >= EXCEPTIONS and not bad[a, b]:
            out[f" {a} {b} "] = max(lexicon.get(f" {a} ", 0.0), lexicon.get(f" {b} ", 0.0))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slightly damped logistic regression on one feature by Newton steps."""
    if not len(x) or y.min() == y.max():
        return (-20.0, 0.0) if not len(x) or y.max() == 0 else (20.0, 0.0)
    design, beta, damp = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([1e-6, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + damp, design.T @ (y - p) - damp @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class Matcher:
    def __init__(self, model: dict):
        self.tree = ahocorasick.Automaton()
        for term, w in model["lexicon"].items():
            self.tree.add_word(term, w)
        for phrase, w in model["exceptions"].items():
            self.tree.add_word(phrase, -w)
        if len(self.tree):
            self.tree.make_automaton()
        self.curve = model["curve"]

    def weight(self, folded: str) -> float:
        if not len(self.tree):
            return 0.0
        total = sum(w for _, w in self.tree.iter(folded))
        return max(0.0, total) / math.log2(8 + folded.count(" ") - 1)

    def score(self, text: str | None) -> tuple[float, float]:
        x = self.weight(fold(text or ""))
        return x, 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] + self.curve[1] * x))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts, chosen by id hash; a document labelled twice counts with its larger label."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.substring("text", 1, CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    return sorted((r["text"] or "", int(r["toxic"])) for r in rows.select("text", "toxic").collect())


def score(df: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, hit_weight, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    ddl, schema = arrow_schema(df, "doc_id long, hit_weight double, score double")

    def run(batches):
        matcher = Matcher(shared.value)
        for part in slices(batches, "text"):
            got = [matcher.score(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, ddl)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = crc_class("doc_id", 5) == 0
    model = learn(labelled_sample(docs, labels.filter(~held)))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hit_weight")
