"""Finding equal windows across documents without shipping every suffix.

Both substring operators ask which windows of W symbols occur elsewhere. Equal
windows choose the same anchor: the smallest hashed gram of k symbols inside
them (the leftmost of equals). Consecutive windows with one anchor form a
stretch, which is handled as one item.

1. Documents are dealt into slices by id hash. A slice sends the distinct
   anchor hashes it holds, packed, to buckets.
2. A bucket tells which hashes occur in several slices, and which have very
   many contexts (hot).
3. A slice merges its equal stretches, so a copy inside a slice is decided
   there, and sends the distinct stretches of repeated anchors to buckets.
   Windows of hot anchors travel one by one under a hash of the whole window,
   so a common line does not gather its many contexts in one bucket.
4. A bucket orders suffixes and marks windows (the operators differ here).
5. A slice gets its marks back and cuts its documents.

Each step is a grouped Arrow function; a slice holds a few MB of text, and
bucket counts grow with the input. Steps 2 and 4 are written to the shared
folder. NULL ids order after all others; NULL texts are empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import HELD, raw, written

SLICE_BYTES, BUCKET_BYTES, HOT = 2 << 20, 12 << 20, 400
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LAST = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of a value array in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])
        powers[:] = INVERSE
        powers[0] = 1
        self.inverse = np.multiply.accumulate(powers, out=powers)

    def of(self, first, past) -> np.ndarray:
        return mixed((self.sums[past] - self.sums[first]) * self.inverse[first] + (past - first).astype(np.uint64) * BASE)

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, x
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:-rest], low[rest:]) if rest else low


class Stretches:
    """Anchored stretches of the documents in ``values`` with offsets ``at``.

    Columns: ``first`` window start, ``runs`` number of windows, ``anchor``
    hash, ``content`` hash, ``owner`` document. ``group`` numbers equal
    stretches, ``lead`` is the first stretch of each group.
    """

    def __init__(self, values: np.ndarray, at: np.ndarray, window: int, gram: int, rolling: Rolling | None = None):
        self.window, n = window, len(values)
        self.rolling = rolling or Rolling(values)
        if n < window:
            self.set(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), at)
            return
        grams = self.rolling.grams(gram)
        # As many bits of the hash in every slice, or two slices might order the same grams differently.
        bits = np.uint64(32)
        low = (np.uint64(1) << bits) - np.uint64(1)
        best = sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        place = (best & low).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        long = np.diff(at) >= window
        np.add.at(inside, at[:-1][long], 1)
        np.add.at(inside, at[1:][long] - window + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        place = place[starts]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1]) if len(starts) else np.zeros(0, np.int64)
        self.set(starts[cut], np.diff(np.concatenate([cut, [len(starts)]])), grams[place[cut]], at)

    def set(self, first, runs, anchor, at) -> None:
        self.first, self.runs, self.anchor = first, runs, anchor
        self.owner = np.searchsorted(at, first, "right") - 1
        self.content = self.rolling.of(first, first + runs + self.window - 1) ^ mixed(anchor)
        order = np.lexsort((first, self.content, self.anchor))
        new = np.ones(len(order), bool)
        a, c = self.anchor[order], self.content[order]
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.lead = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.size = np.bincount(self.group, minlength=len(self.lead)) if len(order) else np.zeros(0, np.int64)

    def split(self, hot: np.ndarray, at: np.ndarray) -> None:
        """Replace stretches whose anchor is hot by their single windows under the window's own hash."""
        take = np.isin(self.anchor, hot)
        if not take.any():
            return
        runs = self.runs[take]
        starts = np.repeat(self.first[take], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        keys = self.rolling.of(starts, starts + self.window)
        first = np.concatenate([self.first[~take], starts])
        self.set(first, np.concatenate([self.runs[~take], np.ones(len(starts), np.int64)]), np.concatenate([self.anchor[~take], keys]), at)

    def anchors(self):
        """Distinct anchors in order, and how many different stretches each has."""
        a = self.anchor[self.lead]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        return a[new], np.diff(np.concatenate([new, [len(a)]]))


def narrow(values: np.ndarray, width: int) -> bytes:
    """The ``width`` highest bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Ordered buckets by the leading 32 bits, so sorted anchors have sorted buckets."""
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(columns: list[np.ndarray], blob: np.ndarray) -> bytes:
    head = np.array([len(columns[0]) if columns else 0, len(blob)], np.int64)
    body = b"".join([head.tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns], blob.tobytes()])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, types: list[str]):
    body = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, size = np.frombuffer(body, np.int64, 2)
    out, k = [], 16
    for t in types:
        out.append(np.frombuffer(body, t, n, k))
        k += n * np.dtype(t).itemsize
    return out, np.frombuffer(body, np.uint8, size, k)


def taken(data: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated stretches of ``data`` and their offsets."""
    sizes = past - first
    at = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])], at


class Slice:
    """Documents of one slice in (id, text) order, with their symbols."""

    def __init__(self, rows: pa.Table, kind):
        HELD.clear()
        ids = np.array([LAST if v is None else int(v) for v in rows.column("doc_id").to_pylist()], np.int64)
        data, at = raw(rows.column("text"))
        # Only equal ids need their texts told apart.
        alone = len(np.unique(ids)) == len(ids)
        order = np.argsort(ids) if alone else np.lexsort((np.diff(at), kind.tie(data, at), ids))
        self.rows, self.ids = rows.take(pa.array(order)), ids[order]
        self.data, self.at = raw(self.rows.column("text"))
        values, self.symbol_at, self.places = kind.symbols(self.data, self.at)
        self.found = Stretches(values, self.symbol_at, kind.window, kind.gram)


class Kind:
    """What the two operators share: symbols, window and gram length."""

    window, gram, per_byte = 50, 24, 1.0

    def tie(self, data, at):
        return contents(data, at[:-1], at[1:])

    def symbols(self, data, at):
        """Value per symbol, offsets per document, byte range per symbol."""
        return BYTE_VALUES[data], at, None

    def payload(self, part: Slice, chosen: np.ndarray) -> bytes:
        raise NotImplementedError

    def resolve(self, payloads: list[bytes]) -> list[np.ndarray]:
        """Bit per window of every entry of every payload, as one uint32 array each."""
        raise NotImplementedError

    def final(self, part: Slice, bits: np.ndarray) -> np.ndarray:
        """Bits of every stretch, given those of its group's lead (0 where nobody asked)."""
        raise NotImplementedError


def asked(part: Slice, flags: dict[int, tuple[np.ndarray, np.ndarray]], width: int):
    """Groups whose windows may occur elsewhere, in bucket order; applies the hot split first."""
    own, _ = part.found.anchors()
    repeated = np.zeros(len(own), bool)
    hot = np.zeros(len(own), bool)
    if flags:
        joined = [np.concatenate([flags[b][k] for b in sorted(flags)]) for k in (0, 1)]
        # Anchors were sent without equal narrow forms: one flag per distinct narrow value, in order.
        small = own >> np.uint64(64 - 8 * width)
        index = np.cumsum(np.concatenate([[0], (small[1:] != small[:-1]).astype(np.int64)]))
        repeated, hot = joined[0][index], joined[1][index]
    hot_anchors = own[hot]
    part.found.split(hot_anchors, part.symbol_at)
    lead_anchor = part.found.anchor[part.found.lead]
    anchors, variants = part.found.anchors()
    wanted = variants > 1
    place = np.searchsorted(own, anchors)
    place[place == len(own)] = 0
    known = (own[place] == anchors) if len(own) else np.zeros(len(anchors), bool)
    wanted |= np.where(known, repeated[place], True) if len(own) else False
    return np.flatnonzero(np.repeat(wanted, variants)), lead_anchor


def mark(docs: DataFrame, kind: Kind, finish, ddl: str) -> DataFrame:
    """Run the five steps; ``finish(part, removed)`` builds the rows of ``ddl`` from the marked window starts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, buckets = max(1, math.ceil(total / SLICE_BYTES)), max(1, math.ceil(total * kind.per_byte / BUCKET_BYTES))
    width = min(8, math.ceil((math.log2(total + 2) + 8) / 8))
    # A name that no column of the caller has.
    own = "_slice" + "_" * max([0, *[len(c) for c in docs.columns]])
    dealt = docs.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int"))
    narrowed = dealt.select(F.col(own).alias("_slice"), "doc_id", "text")

    def send_anchors(key, rows):
        own, variants = Slice(rows, kind).found.anchors()
        small = own >> np.uint64(64 - 8 * width)
        new = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]])) if len(own) else np.zeros(0, np.int64)
        own, variants = own[new], np.add.reduceat(variants, new) if len(new) else variants
        b = bucket_of(own, buckets)
        edges = np.searchsorted(b, np.arange(buckets + 1))
        full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        packed = [narrow(own[edges[k]: edges[k + 1]], width) for k in full]
        many = [np.minimum(variants[edges[k]: edges[k + 1]], 255).astype(np.uint8).tobytes() for k in full]
        n = len(full)
        return pa.table({"_slice": pa.array([key[0].as_py()] * n, pa.int32()), "_bucket": pa.array(full, pa.int32()), "_keys": pa.array(packed, pa.binary()), "_many": pa.array(many, pa.binary())})

    def compare_anchors(key, rows):
        parts = [widened(x, width) for x in rows.column("_keys").to_pylist()]
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("_many").to_pylist()]).astype(np.int64)
        values, back = np.unique(np.concatenate(parts), return_inverse=True)
        flags = (np.bincount(back) > 1).astype(np.uint8) + 2 * (np.bincount(back, many) >= HOT).astype(np.uint8)
        flags, edges = flags[back].astype(np.uint8), np.cumsum([0, *map(len, parts)])
        return pa.table({"_slice": rows.column("_slice"), "_bucket": rows.column("_bucket"), "_marks": pa.array([flags[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    def read_flags(rows: pa.Table):
        out = {}
        for b, m in zip(rows.column("_bucket").to_pylist(), rows.column("_marks").to_pylist()):
            f = np.frombuffer(m, np.uint8)
            out[b] = (f & 1 > 0, f & 2 > 0)
        return out

    def groups_of(part: Slice, flags):
        chosen, lead_anchor = asked(part, flags, width)
        return chosen, np.searchsorted(bucket_of(lead_anchor[chosen], buckets), np.arange(buckets + 1))

    def send_stretches(key, rows, flags):
        part = Slice(rows, kind)
        chosen, edges = groups_of(part, read_flags(flags))
        full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        packed = [kind.payload(part, part.found.lead[chosen[edges[k]: edges[k + 1]]]) for k in full]
        n = len(full)
        return pa.table({"_slice": pa.array([key[0].as_py()] * n, pa.int32()), "_bucket": pa.array(full, pa.int32()), "_data": pa.array(packed, pa.binary())})

    def compare_stretches(key, rows):
        bits = kind.resolve(rows.column("_data").to_pylist())
        return pa.table({"_slice": rows.column("_slice"), "_bucket": rows.column("_bucket"), "_marks": pa.array([b.astype("<u4").tobytes() for b in bits], pa.binary())})

    def cut(key, rows, marks):
        part = Slice(rows, kind)
        step = np.array(marks.column("_step").to_pylist(), np.int64)
        flags, found = marks.filter(pa.array(step == 1)), marks.filter(pa.array(step == 2))
        chosen, _ = groups_of(part, read_flags(flags))
        lead = np.zeros(len(part.found.lead), np.uint32)
        if found.num_rows:
            got = dict(zip(found.column("_bucket").to_pylist(), found.column("_marks").to_pylist()))
            lead[chosen] = np.concatenate([np.frombuffer(got[b], "<u4") for b in sorted(got)])
        bits = kind.final(part, lead)
        on = np.flatnonzero(bits)
        grid = (bits[on][:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1) > 0
        grid &= np.arange(32) < part.found.runs[on][:, None]
        row, column = np.nonzero(grid)
        return finish(part, part.found.first[on][row] + column)

    flags = written(
        narrowed.groupBy("_slice").applyInArrow(send_anchors, "_slice int, _bucket int, _keys binary, _many binary")
        .groupBy("_bucket").applyInArrow(compare_anchors, "_slice int, _bucket int, _marks binary"), "anchors",
    )
    marks = written(
        narrowed.groupBy("_slice").cogroup(flags.groupBy("_slice")).applyInArrow(send_stretches, "_slice int, _bucket int, _data binary")
        .groupBy("_bucket").applyInArrow(compare_stretches, "_slice int, _bucket int, _marks binary"), "marks",
    )
    both = flags.withColumn("_step", F.lit(1)).unionByName(marks.withColumn("_step", F.lit(2)))
    return dealt.groupBy(own).cogroup(both.groupBy("_slice")).applyInArrow(cut, ddl)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Positions inside any window that begins at ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(keep_out: np.ndarray, at: np.ndarray):
    """Maximal True runs that do not cross document borders: (first, past, document)."""
    flag = np.concatenate([[False], keep_out, [False]])
    first, past = np.flatnonzero(flag[1:] & ~flag[:-1]), np.flatnonzero(flag[:-1] & ~flag[1:])
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(keep_out))]
    inner = np.unique(inner[keep_out[inner] & keep_out[inner - 1]]) if len(inner) else inner
    first, past = np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([past, inner]))
    return first, past, np.searchsorted(at, first, "right") - 1


def chunks(items: np.ndarray, anchor: np.ndarray, cost: np.ndarray, most: int):
    """Pieces of ``items`` of about ``most`` cost that never cut an anchor's run."""
    edges = np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(items)]]) if len(items) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(cost)])
    first = 0
    while first < len(items):
        k = np.searchsorted(total[edges], total[first] + most, "right") - 1
        past = int(edges[max(k, int(np.searchsorted(edges, first, "right")))])
        yield items[first:past]
        first = past


def contents(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Hash of each stretch, in rising order of place, worked out in blocks to bound memory."""
    out, first = np.empty(len(begin), np.uint64), 0
    while first < len(out):
        past = max(first + 1, int(np.searchsorted(end, begin[first] + most, "right")))
        rolling = Rolling(BYTE_VALUES[data[begin[first]: end[past - 1]]])
        out[first:past] = rolling.of(begin[first:past] - begin[first], end[first:past] - begin[first])
        first = past
    return out


class Entries:
    """Stretches of one bucket: equal ones merged, and those that share their anchor with others."""

    def __init__(self, payloads: list[bytes], types: list[str]):
        parts = [unpack(p, types) for p in payloads]
        self.columns = [np.concatenate([c[k] for c, _ in parts]) for k in range(len(types))]
        self.edges = np.cumsum([len(c[0]) for c, _ in parts])[:-1]
        self.data = np.concatenate([b for _, b in parts])
        self.anchor, size, ids = self.columns[0], self.columns[1], self.columns[2]
        self.at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        content = contents(self.data, self.at[:-1], self.at[1:])
        order = np.lexsort((ids, content, self.anchor))
        a, c = self.anchor[order], content[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        self.lead = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.size = np.bincount(self.group)
        fresh = np.concatenate([[True], self.anchor[self.lead][1:] != self.anchor[self.lead][:-1]])
        variants = np.diff(np.concatenate([np.flatnonzero(fresh), [len(self.lead)]]))
        self.several = np.flatnonzero(np.repeat(variants > 1, variants))

    def back(self, bits: np.ndarray) -> list[np.ndarray]:
        return np.split(bits, self.edges)
