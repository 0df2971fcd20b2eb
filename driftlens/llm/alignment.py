"""Alignment of two tokenizers over a corpus, with an identity map as fast path.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a
document into groups; the two tokens that end a group are linked. A table made
once per worker maps an A id to the B id with the same bytes. Groups of one A
and one B token that follow it are only counted, in vectors as long as A's
vocabulary; the other links alone enter the shuffle by id pair, already
counted per document. Counts go back to the documents the same way: vectors
for the regular links, a join on the id pair for the rest.

A pair's rows in that join are at most one per document, and Spark sends the
table of pairs to all tasks while it is small; the vectors are bounded by the
vocabulary.

Defined cases: NULL and empty texts, and texts whose tokens do not give back a
blank and the text byte for byte (those with the mark that stands for a blank,
for instance), have no tokens, no groups and no links. Equal and repeated rows
count each time; NULL ids are kept. Texts of any length are aligned whole. Of
several B ids with equal bytes the map names the last one; the others are
irregular. An empty table gives no rows and no pairs. Only ``doc_id`` and
``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.bpe import tokenizer_path
from driftlens.llm.common import arrow_schema, raw, slices, table, written
from driftlens.llm.tokens import ByteLevel, Pieces, loaded

GROUPS = "doc_row long, doc_id long, n_a long, n_b long, n_groups long, groups string, same array<int>, same_n array<long>, other array<long>, other_n array<long>"


class Aligner:
    """Byte strings of both vocabularies, the identity map, and each id written out."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path, False), Pieces(b_path)
        self.words = [Words(v.strings, v.size) for v in (self.a, self.b)]
        by_bytes = {word: i for i, word in sorted(self.b.strings.items())}
        self.same = np.array([by_bytes.get(self.a.strings.get(i), -1) for i in range(self.a.size)])
        most = len(str(max(self.a.size, self.b.size)))
        told = np.array([str(i) for i in range(max(self.a.size, self.b.size))], f"S{most + 1}")
        self.digits = told.view(np.uint8).reshape(len(told), most + 1).copy()
        self.width = np.char.str_len(told)

    def written_ids(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by its byte of ``ends`` (0: nothing), in one buffer; and the offsets of ids in it."""
        width, cells = self.width[ids], self.digits[ids]
        cells[np.arange(len(ids)), width] = ends
        size = width + (ends > 0)
        return cells[np.arange(cells.shape[1]) < size[:, None]], starts_of(size)


class Words:
    """A vocabulary's byte strings in one buffer."""

    def __init__(self, strings: dict[int, bytes], size: int):
        every = [strings.get(i, b"") for i in range(size)]
        self.length = np.array([len(w) for w in every])
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(every), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        skip = self.start[ids] - np.concatenate([[0], np.cumsum(length)])[:-1]
        return self.data[np.repeat(skip, length) + np.arange(length.sum())]


def starts_of(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def told_counts(keys: np.ndarray, owner: np.ndarray, rows: int):
    """Distinct keys of each row with their counts, as two Arrow lists; keys lie below 2 ** 32 or are pair numbers."""
    if not len(keys):
        at = pa.array(np.zeros(rows + 1, np.int32))
        return [pa.ListArray.from_arrays(at, pa.array([], pa.int64())) for _ in range(2)]
    names, dense = np.unique(keys, return_inverse=True)
    found, n = np.unique(owner * len(names) + dense, return_counts=True)
    at = pa.array(np.searchsorted(found, np.arange(rows + 1) * len(names)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int64))) for v in (names[found % len(names)], n)]


def gives_back(words: Words, flat: np.ndarray, count: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row's tokens, ``count`` of ``flat`` per row, are exactly its bytes."""
    size = np.diff(starts_of(words.length[flat])[starts_of(count)])
    fits = size == np.diff(at)
    wrong = words.joined(flat[np.repeat(fits, count)]) != wanted[np.repeat(fits, np.diff(at))]
    fits[fits] = np.diff(starts_of(wrong)[starts_of(size[fits])]) == 0
    return fits


def aligned_batch(tool: Aligner, texts: list[str | None]) -> list:
    """Columns of GROUPS from n_a on for some texts."""
    rows = len(texts)
    given = [" " + t if t else "" for t in texts]
    wanted, at = raw(pa.array(given, pa.large_string()))
    good, sides = np.array([bool(t) for t in given], bool), []
    for words, listed in zip(tool.words, ([tool.a.encode(t) if t else () for t in given], tool.b.encode([t or "" for t in texts]))):
        count = np.array([len(i) for i in listed], np.int64)
        flat = np.concatenate([np.asarray(i, np.int64) for i in listed])
        good &= gives_back(words, flat, count, wanted, at)
        sides.append((words, flat, count))
    (ids_a, n_a, end_a), (ids_b, n_b, end_b) = [
        (own := flat[np.repeat(good, count)], np.where(good, count, 0), np.cumsum(words.length[own])) for words, flat, count in sides
    ]
    mark_a, mark_b = (np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool) for _ in range(2))
    mark_a[end_a], mark_b[end_b] = True, True
    last_a, last_b = np.flatnonzero(mark_b[end_a]), np.flatnonzero(mark_a[end_b])
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    owner, left, right = np.repeat(np.arange(rows), n_a)[last_a], ids_a[last_a], ids_b[last_b]
    regular = (size_a == 1) & (size_b == 1) & (tool.same[left] == right)
    # Written order: the A tokens of a group, then its B tokens.
    place_a = np.arange(len(ids_a)) + np.repeat(starts_of(size_b)[:-1], size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(starts_of(size_a)[1:], size_b)
    order, ends = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    order[place_a], order[place_b] = ids_a, ids_b
    ends[place_a[last_a]], ends[place_b[last_b]] = ord("|"), ord(";")
    row_ends = starts_of(n_a + n_b)
    ends[row_ends[1:][n_a > 0] - 1] = 0
    data, offsets = tool.written_ids(order, ends)
    text = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets[row_ends]), pa.py_buffer(np.ascontiguousarray(data)))
    pairs = (left[~regular] << 32) | right[~regular]
    return [
        pa.array(n_a), pa.array(n_b), pa.array(np.bincount(owner, minlength=rows).astype(np.int64)), text,
        *told_counts(left[regular], owner[regular], rows), *told_counts(pairs, owner[~regular], rows),
    ]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of GROUPS: token counts, the groups written out (``a1,a2|b1;a3|b2``), and the links counted per id.

    ``same`` holds A ids of regular links, ``other`` pairs (A id << 32 | B id) of
    the rest. ``doc_row`` numbers the rows; keep the result before using it twice.
    """
    ddl, schema = arrow_schema(docs, GROUPS)

    def run(batches):
        tool, row = loaded(Aligner, a_path, b_path), TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", 1 << 19):
            columns = aligned_batch(tool, part.column("text").to_pylist())
            head = [pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id")]
            row += part.num_rows
            yield pa.record_batch([c.cast(f.type) for c, f in zip([*head, *columns], schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def vector_counts(made: DataFrame, size: int) -> DataFrame:
    """Rows (a, n) of regular links: every task adds its documents into one vector as long as the vocabulary."""
    ddl, schema = arrow_schema(made, "a int, n long")

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("same").flatten().to_numpy(), batch.column("same_n").flatten().to_numpy())
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    return made.select("same", "same_n").mapInArrow(run, ddl).groupBy("a").agg(F.sum("n").alias("n"))


def unfolded(made: DataFrame, *names: str) -> DataFrame:
    pair = F.inline(F.arrays_zip(F.col("other").alias("pair"), F.col("other_n").alias("n")))
    return made.select(*names, pair).select(*names, F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")


def pair_counts(made: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (a, b, n, regular, best): links of each id pair over all documents; ``best`` where no A id has more with this B id.

    The identity map has one row per A id at most, so it may be sent to all tasks.
    """
    tool = loaded(Aligner, a_path, b_path)
    spark = made.sparkSession
    known = [(int(a), int(b)) for a, b in enumerate(tool.same) if b >= 0]
    same = spark.createDataFrame(known, "a int, b int")
    regular = vector_counts(made, len(tool.same)).join(F.broadcast(same), "a").select("a", "b", "n", F.lit(True).alias("regular"))
    rest = unfolded(made).groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("regular", F.lit(False))
    every = written(regular.unionByName(rest), "pairs")
    most = every.groupBy("b").agg(F.max("n").alias("_most"))
    return written(every.join(most, "b").select("a", "b", "n", "regular", (F.col("n") == F.col("_most")).alias("best")), "pairs")


def link_sums(made: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Add ``n_best`` and ``count_sum``: links of a document that are best for their B id, and the summed counts of its links."""
    # At most one row per A id: bounded by the vocabulary.
    known = pairs.filter("regular").select("a", "n", "best").collect()
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in known:
        count[r["a"]], best[r["a"]] = r["n"], r["best"]
    names = [c for c in made.columns if c not in ("same", "same_n", "other", "other_n")]
    kept = made.select(*names, "same", "same_n")
    ddl, schema = arrow_schema(made, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in names) + ", _best long, _sum long")

    def run(batches):
        for batch in batches:
            ids, n = (batch.column(c).flatten().to_numpy() for c in ("same", "same_n"))
            at = batch.column("same").offsets.to_numpy() - batch.column("same").offsets[0].as_py()
            sums = [pa.array(np.diff(starts_of(v[ids] * n)[at])) for v in (best, count)]
            yield pa.record_batch([*[batch.column(c) for c in names], *sums], schema=schema)

    rest = unfolded(made, "doc_row").join(pairs.filter("NOT regular").drop("regular").withColumnRenamed("n", "_count"), ["a", "b"]).groupBy("doc_row").agg(
        F.sum(F.col("n") * F.col("best").cast("int")).alias("_b"), F.sum(F.col("n") * F.col("_count")).alias("_s")
    )
    added = lambda own, other: F.col(own) + F.coalesce(other, F.lit(0))
    return kept.mapInArrow(run, ddl).join(rest, "doc_row", "left").select(*names, added("_best", "_b").alias("n_best"), added("_sum", "_s").alias("count_sum"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a_path, b_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    made = aligned(table(spark, folder, "documents"), a_path, b_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    made = written(made.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    sums = link_sums(made, pair_counts(made, a_path, b_path), loaded(Aligner, a_path, b_path).a.size)
    return sums.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
