"""Removal of word windows that occur elsewhere.

Every word that lies in a window of ``window`` words whose sequence also starts
anywhere else, same document included, is removed; windows are judged on the
input. Windows are partitioned by a key that the text itself chooses (see
``repeats``): the hash of an anchor inside the window, or of the whole window
where an anchor has very many contexts, so every group fits memory. This is not
a prefix of the suffix, and no tree is kept: inside a group positions are named
by doubling (two are alike at depth 2d when their names at depth d, and those d
words on, agree) up to the window's depth, where a name that occurs twice marks
repeats. The README says why.

Words are kept byte for byte; NULL and empty texts have none. Every input row
gives one output row; extra columns are passed on, those named like a result
column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftlens.llm.common import table
from driftlens.llm.repeats import Entries, Kind, Slice, chunks, contents, covered, mark, pack, taken

WINDOW, GRAM, CHUNK = 35, 8, 1_000_000
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, at: np.ndarray):
    """Hash per word, words before each text, and the words' byte ranges."""
    solid = ~SPACES[data]
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    before[at[:-1][at[:-1] < len(data)]] = False
    first = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    ends = at[1:] - 1
    after[ends[ends >= 0]] = False
    past = np.flatnonzero(solid & ~after) + 1
    return contents(data, first, past), np.searchsorted(first, at), (first, past)


def nodes_at(values: np.ndarray, depth: int) -> np.ndarray:
    """Node number at ``depth`` for every position that has ``depth`` symbols after it."""
    level, reach = np.unique(values, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        pair = level[:-step] * (int(level.max(initial=0)) + 1) + level[step:]
        level, reach = np.unique(pair, return_inverse=True)[1].astype(np.int64), reach + step
    return level


class Words(Kind):
    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.per_byte = window, gram, 1.2

    def symbols(self, data, at):
        return words_of(data, at)

    def payload(self, part: Slice, chosen: np.ndarray) -> bytes:
        found, (begin, end) = part.found, part.places
        first, last = found.first[chosen], found.first[chosen] + found.runs[chosen] + self.window - 2
        blob, at = taken(part.data, begin[first], end[last]) if len(chosen) else (part.data[:0], np.zeros(1, np.int64))
        # Only words matter, so any white space between them travels as a blank.
        blob = np.where(SPACES[blob], np.uint8(32), blob)
        keep = np.ones(len(blob), bool)
        keep[1:] = ~((blob[1:] == 32) & (blob[:-1] == 32))
        size = np.diff(np.concatenate([[0], np.cumsum(keep)])[at])
        return pack([found.anchor[chosen], size.astype(np.uint32), np.minimum(found.size[found.group[chosen]], 255).astype(np.uint8)], blob[keep])

    def resolve(self, payloads: list[bytes]) -> list[np.ndarray]:
        entries = Entries(payloads, ["<u8", "<u4", "u1"])
        at, lead = entries.at, entries.lead
        bits = np.where(entries.size > 1, np.uint32(0xFFFFFFFF), np.uint32(0))
        some = entries.several
        for part in chunks(some, entries.anchor[lead[some]], np.diff(at)[lead[some]], CHUNK):
            bits[part] |= self.windows(*taken(entries.data, at[lead[part]], at[lead[part] + 1]))
        return entries.back(bits[entries.group])

    def windows(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        values, word_at, _ = words_of(data, at)
        node = nodes_at(values, self.window)
        runs = np.diff(word_at) - self.window + 1
        shift = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        owner = np.repeat(np.arange(len(runs)), runs)
        leaf = node[word_at[:-1][owner] + shift]
        deep = np.bincount(leaf, minlength=int(node.max(initial=0)) + 1)[leaf] > 1
        bits = np.zeros(len(runs), np.uint32)
        np.bitwise_or.at(bits, owner[deep], np.uint32(1) << shift[deep].astype(np.uint32))
        return bits

    def final(self, part: Slice, bits: np.ndarray) -> np.ndarray:
        found = part.found
        return np.where(found.size > 1, np.uint32(0xFFFFFFFF), bits)[found.group] if len(found.group) else np.zeros(0, np.uint32)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Input rows plus n_words, n_removed and kept (remaining words joined by one blank)."""
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    source = docs.select(*[f"`{c}`" for c in rest])
    schema = StructType([*source.schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    def finish(part: Slice, starts: np.ndarray) -> pa.Table:
        begin, end = part.places
        gone = covered(starts, window, len(begin))
        left = np.concatenate([[0], np.cumsum(~gone)])[part.symbol_at]
        first, past = begin[~gone], end[~gone]
        size = past - first + 1
        last = left[1:][np.diff(left) > 0] - 1
        size[last] -= 1
        at = np.concatenate([[0], np.cumsum(size)])
        body = np.full(at[-1], 32, np.uint8)
        data, own = taken(part.data, first, past)
        body[np.repeat(at[:-1] - own[:-1], np.diff(own)) + np.arange(len(data))] = data
        text = pa.LargeStringArray.from_buffers(len(left) - 1, pa.py_buffer(at[left].astype(np.int64)), pa.py_buffer(body)).cast(pa.string())
        words = np.diff(part.symbol_at)
        out = part.rows.select(rest)
        for name, column in (("n_words", pa.array(words, pa.int64())), ("n_removed", pa.array(words - np.diff(left), pa.int64())), ("kept", text)):
            out = out.append_column(name, column)
        return out

    return mark(source, Words(window), finish, schema)


def op3_suffixtree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
