"""Chat formatting by columnar byte assembly.

Every turn is header + escaped text + footer. Segment lengths give cumulative
offsets, offsets give scatter indices, and all headers, texts and footers of a
batch are copied into one preallocated Arrow buffer.

Template: ``[SYS]..[/SYS]``, ``[INST]..[/INST]``, ``[OUT]..</s>`` for system,
user and assistant, ``[ROLE]name\\n..[/ROLE]`` for any other role. Inside texts
and names a backslash is doubled and a control string gets one after its first
character, so no control string is left and reading back is exact.

Turns are ordered by (turn, role, text); NULL turns come first, a NULL role or
text counts as empty, a NULL conversation id is a conversation of its own.
Repeated rows are repeated turns. One conversation is one output row, so it has
to fit a row; nothing else is held.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, raw, table

KNOWN = {"system": (b"[SYS]", b"[/SYS]"), "user": (b"[INST]", b"[/INST]"), "assistant": (b"[OUT]", b"</s>")}
OTHER = (b"[ROLE]", b"[/ROLE]")
TURNS = re.compile(rb"\[(SYS|INST|OUT|ROLE)\](.*?)(?:\[/(?:SYS|INST|ROLE)\]|</s>)", re.S)
ROLES = {b"SYS": b"system", b"INST": b"user", b"OUT": b"assistant"}


def escaped(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring_regex(texts, r"\[(/?(?:SYS|INST|OUT|ROLE)\])", r"[\\\1")
    return pc.replace_substring(texts, "</s>", "<\\/s>")


def unescaped(text: bytes) -> bytes:
    return re.sub(rb"\\(\\?)", rb"\1", text) if b"\\" in text else text


def place(buffer: np.ndarray, starts: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    """Copy item i of (data, at) to ``starts[i]`` of the buffer."""
    lengths = np.diff(at)
    buffer[np.repeat(starts - at[:-1], lengths) + np.arange(len(data))] = data


def assembled(roles: pa.Array, texts: pa.Array, at: np.ndarray):
    """Formatted bytes and offsets per conversation, and (turn, start, end) of the text of each assistant turn."""
    roles, texts = pc.fill_null(roles, ""), escaped(pc.fill_null(texts, ""))
    names = roles.to_pylist()
    heads = pa.array([KNOWN[r][0] if r in KNOWN else OTHER[0] + escaped(pa.array([r]))[0].as_py().replace("\n", "\\\n").encode() + b"\n" for r in names], pa.binary())
    feet = pa.array([KNOWN.get(r, OTHER)[1] for r in names], pa.binary())
    pieces = [raw(heads), raw(texts), raw(feet)]
    sizes = np.stack([np.diff(offsets) for _, offsets in pieces], 1)
    ends = np.cumsum(sizes.reshape(-1)).reshape(-1, 3)
    starts = ends - sizes
    total = np.concatenate([[0], ends[:, 2]]).astype(np.int64)
    buffer = np.empty(int(total[-1]), np.uint8)
    for k, (data, offsets) in enumerate(pieces):
        place(buffer, starts[:, k], data, offsets)
    trained = np.flatnonzero(np.fromiter((r == "assistant" for r in names), bool, len(names)))
    return buffer, total[at], trained, starts[trained, 1], ends[trained, 1]


def format_chats(df: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text).

    ``loss_spans`` are byte ranges of the formatted text that are trained on.
    """
    turns = df.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ddl, schema = arrow_schema(df, "conv_id long, formatted string, loss_spans array<struct<first:long,past:long>>")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, min(512, batch.num_rows - first))
                lists = part.column("turns")
                rows, at = lists.flatten(), np.asarray(lists.offsets, np.int64)
                at = at - at[0]
                buffer, offsets, trained, start, end = assembled(rows.field("role"), rows.field("text"), at)
                owner = np.searchsorted(at, trained, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(end - offsets[owner])], ["first", "past"])
                marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(at))).astype(np.int32)), spans)
                text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())
                yield pa.record_batch([part.column("conv_id").cast(pa.int64()), text, marks.cast(schema.field(2).type)], schema=schema)

    return turns.mapInArrow(run, ddl)


def read_chats(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, loss_text, formatted_chars) read back from formatted chats."""
    ddl, schema = arrow_schema(df, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")

    def run(batches):
        for batch in batches:
            turns, loss, sizes = [], [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                data, own = text.encode(), []
                for m in TURNS.finditer(data):
                    role, body = ROLES.get(m[1]), m[2]
                    if role is None:
                        role, body = re.match(rb"((?:\\.|[^\\\n])*)\n(.*)", body, re.S).groups()
                        role = unescaped(role)
                    own.append({"role": role.decode(), "text": unescaped(body).decode()})
                turns.append(own)
                loss.append("".join(unescaped(data[s["first"]: s["past"]]).decode() for s in spans))
                sizes.append(len(text))
            yield pa.record_batch([batch.column("conv_id"), pa.array(turns, schema.field(1).type), pa.array(loss, pa.string()), pa.array(sizes, pa.int64())], schema=schema)

    return df.mapInArrow(run, ddl)


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and the self-check conversation -1, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_chats(format_chats(rows.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars",
    )
