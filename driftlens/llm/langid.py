"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of each language's labelled
text. A text is parsed greedily into the longest stretches that occur in the
sample (a phrase ends where the automaton has no transition). Fewer phrases
mean a better fit: phrases times log2(sample length) over symbols estimates the
cross entropy, and the smallest estimate wins.

Whole texts are parsed, in segments of ``SEGMENT`` bytes that each start a new
phrase, so all segments of a batch advance together. Learning takes at most
``DOCS`` documents per language, those with the smallest id hash, and
``CHARS`` characters of each.

NULL texts and texts without a letter are ``und`` with score 0. Ties go to the
first language by code point. Rows keep their multiplicity. With no labelled
row at all every text is ``und``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftlens.llm.common import crc_class, held, raw, slices, table

DOCS, CHARS, SEGMENT = 48, 1200, 512
UNKNOWN = "und"


def folded_bytes() -> np.ndarray:
    """Lower-case letters and bytes of other scripts stay, everything else is a blank."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


FOLD = folded_bytes()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``data``."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class Parsers:
    """Dense phrase parsers of all languages over one symbol alphabet.

    A table cell holds ``next state * 2 + 1`` where a phrase ends before the
    symbol; the parse then goes on from the root's transition.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        folded = {n: FOLD[np.frombuffer(samples[n], np.uint8)].tobytes() for n in self.names}
        known = sorted(set().union(*folded.values()) | {32}) if folded else [32]
        self.symbols = np.zeros(256, np.int32)
        for k, b in enumerate(known):
            self.symbols[b] = k + 1
        self.symbols = self.symbols[FOLD]
        self.width = len(known) + 1
        tables, self.roots, self.bits = [], [], []
        base = 0
        code = {b: k + 1 for k, b in enumerate(known)}
        for n in self.names:
            moves = suffix_automaton(folded[n])
            dense = np.full((len(moves), self.width), -1, np.int32)
            for state, row in enumerate(moves):
                for b, to in row.items():
                    dense[state, code[b]] = to
            root = np.where(dense[0] >= 0, dense[0], 0).astype(np.int32)
            ends = (root + np.int32(base)) * np.int32(2) + np.int32(1)
            dense = np.where(dense >= 0, (dense + np.int32(base)) * np.int32(2), ends)
            dense[0] = ends
            tables.append(dense)
            self.roots.append(base)
            self.bits.append(math.log2(max(2, len(folded[n]))))
            base += len(moves)
        self.table = np.concatenate(tables).astype(np.int32, copy=False).reshape(-1) if tables else np.zeros(0, np.int32)

    def costs(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Estimated bits per byte, one row per text and one column per language."""
        sizes = np.diff(at)
        counts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), counts)
        begin = at[:-1][owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        length = np.minimum(SEGMENT, at[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        symbols = self.symbols[data]
        states = np.repeat(np.array(self.roots, np.int32)[:, None], len(begin), 1)
        phrases = np.zeros(states.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
        for t in range(SEGMENT):
            n = int(active[t])
            if not n:
                break
            got = self.table[states[:, :n] * self.width + symbols[begin[:n] + t]]
            phrases[:, :n] += got & 1
            states[:, :n] = got >> 1
        total = np.stack([np.bincount(owner, row, len(sizes)) for row in phrases], 1)
        return total * np.array(self.bits) / np.maximum(1, sizes)[:, None]


def samples_of(df: DataFrame, docs: int = DOCS, chars: int = CHARS) -> dict[str, bytes]:
    """Bounded labelled sample per language: docs with the smallest id hashes, whatever the partitioning."""
    known = df.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    short = known.select("lang", F.xxhash64("doc_id").alias("_h"), F.substring("text", 1, chars).alias("_t"))
    window = Window.partitionBy("lang").orderBy("_h", "_t")
    rows = short.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= docs).orderBy("lang", "_r").collect()
    out: dict[str, bytes] = {}
    for row in rows:
        out[row["lang"]] = out.get(row["lang"], b"") + row["_t"].encode() + b" "
    return out


def predict(df: DataFrame, samples: dict[str, bytes], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with lang_pred and score; score is second-best cost over the sum of the two best.

    Carried columns may have any names; those named like a result column are replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(samples)
    carry = [c for c in carry if c not in ("lang_pred", "score")]
    kept = df.select(*[f"`{c}`" for c in carry])
    result = StructType([*kept.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    schema = to_arrow_schema(result)

    def run(batches):
        parsers = held((Parsers, tuple(sorted(model.value.items()))), lambda: Parsers(model.value))
        for part in slices(batches, "_text"):
            names, scores = best(parsers, part.column("_text"), np.asarray(part.column("_letters").fill_null(False)))
            columns = [c.cast(schema.field(k).type) for k, c in enumerate(part.columns[: len(carry)])]
            yield pa.record_batch([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"), F.col("text").rlike(r"\p{L}").alias("_letters")).mapInArrow(run, result)


def best(parsers: Parsers, texts, letters: np.ndarray):
    n = len(texts)
    if not parsers.names:
        return [UNKNOWN] * n, np.zeros(n)
    cost = parsers.costs(*raw(texts))
    first = cost.argmin(1)
    low = cost[np.arange(n), first]
    rest = cost.copy()
    rest[np.arange(n), first] = np.inf
    second = rest.min(1)
    score = np.where(np.isinf(second), 1.0, second / np.maximum(low + second, 1e-12))
    return [parsers.names[k] if ok else UNKNOWN for k, ok in zip(first, letters)], np.where(letters, score, 0.0)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = crc_class("doc_id", 4) == 2
    return predict(docs, samples_of(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
