"""GIF media columns: store bytes as timed frames, read frames back with histograms.

``write_gif`` keeps a payload as 8-bit palette samples, 192 wide, in frames of
at most 128 lines under an identity palette. ``read_gif`` decodes any GIF: it
walks the blocks, decodes LZW code streams, composes frames under palettes,
transparency, interlacing and disposal, and gives every frame's time, delay,
samples and colour histogram.

NULL and empty texts are one line of padding. Repeated rows give repeated rows.
A file that is cut short gives the frames that are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, slices, table

WIDTH, LINES, DELAY = 192, 128, 4
CLEAR, STOP, FULL = 256, 257, 4096


def code_widths(n: int, first: int = 9, clear: int = CLEAR) -> np.ndarray:
    """Bit widths of the n codes that follow a clear code."""
    known = np.minimum(clear + 2 + np.maximum(0, np.arange(n) - 1), FULL - 1)
    return np.maximum(first, np.ceil(np.log2(known + 1))).astype(np.int64)


WIDTHS = code_widths(FULL + 2)
ENDS = np.cumsum(WIDTHS)


def lzw_encode(data: bytes) -> bytes:
    """Variable-width LZW with 8-bit symbols; the table is cleared when full."""
    codes, runs, table, free = [], [], {}, CLEAR + 2
    word, get, add = data[0], table.get, codes.append
    for b in data[1:]:
        key = word << 8 | b
        known = get(key)
        if known is not None:
            word = known
            continue
        add(word)
        if free < FULL:
            table[key] = free
            free += 1
        else:
            add(CLEAR)
            runs.append(len(codes))
            table.clear()
            free = CLEAR + 2
        word = b
    codes += (word, STOP)
    ends = [0, *runs, len(codes)]
    widths = np.concatenate([[9], *[WIDTHS[: b - a] for a, b in zip(ends, ends[1:])]])
    values = np.array([CLEAR, *codes], "<u2")
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Symbols of an LZW stream with ``size``-bit symbols.

    Widths follow from the number of codes since the last clear code, so the
    codes of a run are cut out at once, in steps until the next clear code.
    """
    clear = 1 << size
    total = 8 * len(data)
    cells = np.frombuffer(data + bytes(3), np.uint8).astype(np.int32)
    widths = WIDTHS if size == 8 else code_widths(FULL + 2, size + 1, clear)
    ends = ENDS if size == 8 else np.cumsum(widths)
    singles = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = 0
    while at + size + 1 <= total:
        n, parts, done, over = int(np.searchsorted(ends, total - at, "right")), [], 0, True
        more = max(0, total - at - int(ends[-1])) // 12 if n == len(ends) else 0
        after = total
        while done < n + more:
            if done < n:
                some = slice(done, min(n, done + 1024))
                begin, wide = at + ends[some] - widths[some], widths[some]
            else:
                begin = at + int(ends[-1]) + 12 * np.arange(done - n, min(more, done - n + 1024))
                wide = np.full(len(begin), 12)
            place = begin >> 3
            values = (cells[place] | cells[place + 1] << 8 | cells[place + 2] << 16) >> (begin & 7) & ((1 << wide) - 1)
            done += len(values)
            stop = np.flatnonzero((values == clear) | (values == clear + 1))
            if len(stop):
                parts.append(values[: stop[0]])
                over = values[stop[0]] == clear + 1
                after = int(begin[stop[0]] + wide[stop[0]])
                break
            parts.append(values)
        unpack_run(np.concatenate(parts).tolist() if parts else [], singles, out)
        at = after
        if over:
            break
    return b"".join(out)


def unpack_run(codes: list[int], singles: list[bytes], out: list[bytes]) -> None:
    """Append the strings of the codes between two clear codes."""
    if not codes:
        return
    table = singles[:]
    add, learn = out.append, table.append
    last = table[codes[0]]
    add(last)
    known, room = len(table), FULL - len(table)
    for code in codes[1: room + 1]:
        entry = table[code] if code < known else last + last[:1]
        learn(last + entry[:1])
        known += 1
        add(entry)
        last = entry
    out += [table[code] for code in codes[room + 1:]]


def write_gif(payload: bytes) -> bytes:
    """A GIF89a whose samples, in frame order, are the payload (a multiple of 192 bytes)."""
    lines = len(payload) // WIDTH
    palette = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(lines, LINES).to_bytes(2, "little"), b"\xf7\0\0", palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for first in range(0, lines, LINES):
        part = payload[first * WIDTH: (first + LINES) * WIDTH]
        packed = lzw_encode(part)
        out += [b"\x21\xf9\x04\x04", DELAY.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08"]
        for k in range(0, len(packed), 255):
            block = packed[k: k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks from ``at`` and the place after them."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1: at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def interlaced(rows: int) -> np.ndarray:
    """Display row of each stored row."""
    return np.concatenate([np.arange(first, rows, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes):
    """Yield (start_cs, delay_cs, x, y, indices, canvas) of every frame.

    ``indices`` are the frame's own samples; ``canvas`` is the RGBA picture
    shown: transparent samples keep what is below, disposal 2 clears the
    frame's area after its time, disposal 3 brings back the picture before it.
    """
    if data[:4] != b"GIF8" or len(data) < 13:
        return
    short = lambda k: int.from_bytes(data[k: k + 2], "little")
    wide, high, flags = short(6), short(8), data[10]
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data[at: at + n], np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((high, wide, 4), np.uint8)
    clock, delay, disposal, clear = 0, 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, past = blocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None
            at = past
        elif data[at] == 0x2C and at + 11 <= len(data):
            x, y, w, h, own = short(at + 1), short(at + 3), short(at + 5), short(at + 7), data[at + 9]
            at, colours = at + 10, palette
            if own & 0x80:
                n = 3 << (own & 7) + 1
                colours, at = np.frombuffer(data[at: at + n], np.uint8).reshape(-1, 3), at + n
            size = data[at]
            packed, at = blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(packed, size), np.uint8)
            if len(samples) < w * h or colours is None:
                return
            samples = samples[: w * h].reshape(h, w)
            if own & 0x40:
                shown = np.empty_like(samples)
                shown[interlaced(h)] = samples
                samples = shown
            kept = canvas.copy() if disposal == 3 else None
            area = canvas[y: y + h, x: x + w]
            seen = samples[: area.shape[0], : area.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(colours), :3], full[: len(colours), 3] = colours, 255
            if clear is None:
                area[:] = full[seen]
            else:
                solid = seen != clear
                area[solid] = full[seen[solid]]
            yield clock, delay, x, y, samples, canvas
            clock += delay
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = kept
            delay, disposal, clear = 0, 0, None
        else:
            return


def store(df: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, gif) of rows (doc_id, text): the text's bytes, padded with blanks."""
    ddl, schema = arrow_schema(df, "doc_id long, n_bytes long, gif binary")

    def run(batches):
        for part in slices(batches, "text"):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            media = [write_gif(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH)) for t in texts]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, ddl)


def load(df: DataFrame) -> DataFrame:
    """Adds ``samples`` and timed ``frames`` with 8-bin histograms per colour channel of the picture shown."""
    ddl, schema = arrow_schema(
        df, "doc_id long, n_bytes long, gif binary, samples binary, "
        "frames array<struct<start_cs:int,delay_cs:int,x:int,y:int,width:int,height:int,red:array<int>,green:array<int>,blue:array<int>>>",
    )

    def run(batches):
        for part in slices(batches, "gif"):
            samples, frames = [], []
            for data in part.column("gif").to_pylist():
                own, pixels = [], []
                for start, delay, x, y, indices, canvas in read_gif(data):
                    bins = [np.bincount(canvas[:, :, c].reshape(-1) >> 5, minlength=8).tolist() for c in range(3)]
                    own.append((start, delay, x, y, indices.shape[1], indices.shape[0], *bins))
                    pixels.append(indices.tobytes())
                names = ("start_cs", "delay_cs", "x", "y", "width", "height", "red", "green", "blue")
                frames.append([dict(zip(names, f)) for f in own])
                samples.append(b"".join(pixels))
            yield pa.record_batch([*part.columns, pa.array(samples, pa.binary()), pa.array(frames, schema.field(4).type)], schema=schema)

    return df.mapInArrow(run, ddl)


def op7_gif(spark: SparkSession, folder: str) -> DataFrame:
    media = load(store(table(spark, folder, "documents")))
    totals = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f["red"][k]))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"), F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"),
        F.concat(F.size("frames").cast("string"), F.lit(":"), F.array_join(totals.cast("array<string>"), ",")).alias("feature"),
    )
