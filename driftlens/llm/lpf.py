"""Removal of later copies of byte strings, keeping the first.

Every byte that lies in a ``window``-byte string which also starts in a
document with a smaller id is removed; strings are judged on the input. Only
the test "longest previous factor of at least the window" is needed, so no
factor lengths and no common prefixes are worked out: the windows that may
match (see ``repeats``) are sorted as suffixes cut at the window, and inside a
run of equal ones the least ids before and after take the place of the previous
and next smaller positions. Stretches that agree as a whole are told by their
hash. The README says why.

NULL ids come after all ids; rows with equal ids do not affect each other; NULL
and empty texts keep nothing. Every input row gives one output row; extra
columns are passed on, those named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftlens.llm.common import table
from driftlens.llm.repeats import Entries, Kind, Slice, chunks, covered, mark, pack, runs_of, taken

WINDOW, GRAM, CHUNK = 50, 24, 100_000


def previous_factors(ids: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order: does a smaller id share the window?

    ``same[i]`` says that suffixes i - 1 and i share at least the window. The
    nearest smaller ids before and after, reached without leaving the run of
    shared windows, are the two candidates for the longest previous factor.
    """
    run = np.cumsum(~same)
    # Ids as ranks; a run's offset makes running minima start afresh at each run.
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    span = int(rank.max(initial=0)) + 1
    falling = np.minimum.accumulate(rank - run * span) + run * span
    rising = (np.minimum.accumulate((rank + run * span)[::-1]))[::-1] - run * span
    return (falling < rank) | (rising < rank)


class Bytes(Kind):
    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.per_byte = window, gram, 2.5

    def payload(self, part: Slice, chosen: np.ndarray) -> bytes:
        found = part.found
        first, past = found.first[chosen], found.first[chosen] + found.runs[chosen] + self.window - 1
        blob, _ = taken(part.data, first, past)
        return pack([found.anchor[chosen], (past - first).astype(np.uint16), part.ids[found.owner[chosen]]], blob)

    def resolve(self, payloads: list[bytes]) -> list[np.ndarray]:
        entries = Entries(payloads, ["<u8", "<u2", "<i8"])
        ids, at, lead, group = entries.columns[2], entries.at, entries.lead, entries.group
        bits = np.zeros(len(lead), np.uint32)
        some = entries.several
        for part in chunks(some, entries.anchor[lead[some]], np.diff(at)[lead[some]] - self.window + 1, CHUNK):
            bits[part] = self.windows(entries.data, at, lead[part], ids)
        # Whoever equals the lead but has a larger id is a later copy as a whole.
        return entries.back(np.where(ids > ids[lead][group], np.uint32(0xFFFFFFFF), bits[group]))

    def windows(self, data, at, lead, ids) -> np.ndarray:
        runs = at[lead + 1] - at[lead] - self.window + 1
        shift = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        start = np.repeat(at[lead], runs) + shift
        owner = np.repeat(np.arange(len(lead)), runs)
        wide = -(-self.window // 8) * 8
        text = np.zeros((len(start), wide), np.uint8)
        text[:, : self.window] = data[start[:, None] + np.arange(self.window)]
        columns = text.view(">u8").astype(np.uint64)
        order = np.lexsort(columns.T[::-1])
        sorted_ = columns[order]
        same = np.concatenate([[False], (sorted_[1:] == sorted_[:-1]).all(1)])
        later = np.zeros(len(order), bool)
        later[order] = previous_factors(ids[lead][owner][order], same)
        bits = np.zeros(len(lead), np.uint32)
        np.bitwise_or.at(bits, owner[later], np.uint32(1) << shift[later].astype(np.uint32))
        return bits

    def final(self, part: Slice, bits: np.ndarray) -> np.ndarray:
        found = part.found
        leader = part.ids[found.owner[found.lead]][found.group] if len(found.group) else np.zeros(0, np.int64)
        return np.where(part.ids[found.owner] > leader, np.uint32(0xFFFFFFFF), bits[found.group])


def remove_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Input rows plus n_bytes, n_removed, kept (binary) and spans (removed byte ranges)."""
    names = ("n_bytes", "n_removed", "kept", "spans")
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*[f"`{c}`" for c in rest])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("n_bytes long, n_removed long, kept binary, spans array<struct<first:long,past:long>>").fields])
    spans_type = to_arrow_schema(schema).field("spans").type

    def finish(part: Slice, starts: np.ndarray) -> pa.Table:
        gone = covered(starts, window, len(part.data))
        first, past, owner = runs_of(gone, part.at)
        sizes = np.diff(part.at)
        left = np.concatenate([[0], np.cumsum(~gone)])
        at = left[part.at]
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part.data[~gone]))]).cast(pa.binary())
        base = part.at[owner]
        ranges = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(past - base, pa.int64())], ["first", "past"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)), ranges).cast(spans_type)
        out = part.rows.select(rest)
        for name, column in (("n_bytes", pa.array(sizes, pa.int64())), ("n_removed", pa.array(sizes - np.diff(at), pa.int64())), ("kept", body), ("spans", spans)):
            out = out.append_column(name, column)
        return out

    return mark(kept, Bytes(window), finish, schema)


def op2_lpf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_copies(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
