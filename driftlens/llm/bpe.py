"""Byte-level BPE encoding and decoding.

A text is cut at added tokens, then into pieces by the tokenizer's pattern. A
piece's symbols form a doubly linked list; candidate merges wait in a priority
queue ordered by (rank, position), and an entry whose pair has changed since is
stale and skipped. Decoding concatenates vocabulary byte strings.

NULL and empty texts encode to no ids. Rows keep their order and multiplicity;
only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import arrow_schema, held, slices, table

#: Fixed value: the published piece pattern, with white space as Unicode defines it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces remembered per generation and Python worker, and the longest piece worth remembering.
REMEMBERED, LONGEST = 300_000, 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Merge ranks and byte strings read from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.strings = [b""] * (1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]))
        for word, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in word)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.added.items():
            self.strings[i] = word.encode()
        ids = {self.strings[i]: i for i in vocab.values()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.cut = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PIECES).findall
        self.kind = np.dtype("<u2" if len(self.strings) <= 1 << 16 else "<u4")
        self.pieces = Remembered(self)
        self.length = np.array([len(w) for w in self.strings])
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(self.strings), np.uint8)
        told = np.array([f"{i}," for i in range(len(self.strings))], f"S{len(str(len(self.strings))) + 1}")
        self.told, self.told_size = told.view(np.uint8).reshape(len(told), -1), np.char.str_len(told)

    def packed(self, text: str) -> bytes:
        """The ids of a text as numbers of ``kind`` in a row."""
        if self.cut is None or not any(w in text for w in self.added):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        parts = self.cut.split(text)
        return b"".join(
            np.array([self.added[part]], self.kind).tobytes() if k % 2 else b"".join(map(self.pieces.__getitem__, self.find(part))) for k, part in enumerate(parts)
        )

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()

    def flat(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts in one array, and where each text's begin."""
        parts = [self.packed(t) if t else b"" for t in texts]
        return np.frombuffer(b"".join(parts), self.kind).astype(np.int64), np.cumsum([0, *map(len, parts)]) // self.kind.itemsize

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes the ids stand for, scattered from the vocabulary's buffer, and where each id's begin."""
        size = self.length[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])], at

    def written(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with a comma after each, and where each begins."""
        size = self.told_size[ids]
        return self.told[ids][np.arange(self.told.shape[1]) < size[:, None]], np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Remembered(dict):
    """Packed ids by piece in two generations; the older one goes when the younger is full, so memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.single, self.merges, self.kind, self.older = vocabulary.single, vocabulary.merges, vocabulary.kind, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(merged([self.single[b] for b in piece.encode()], self.merges), self.kind).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def merged(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges lowest rank first, leftmost first among equals."""
    n, get = len(symbols), merges.get
    if n < 2:
        return symbols
    waiting = [got >> 20 << 32 | i for i in range(n - 1) if (got := get(symbols[i] << 20 | symbols[i + 1])) is not None]
    if not waiting:
        return symbols
    heapq.heapify(waiting)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push, gone = heapq.heappop, heapq.heappush, 0
    while waiting:
        entry = pop(waiting)
        i = entry & 0xFFFFFFFF
        if symbols[i] < 0 or (j := after[i]) == n:
            continue
        found = get(symbols[i] << 20 | symbols[j])
        if found is None or found >> 20 != entry >> 32:
            continue
        symbols[i], symbols[j] = found & 0xFFFFF, -1
        gone += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (got := get(symbols[i] << 20 | symbols[k])) is not None:
                push(waiting, got >> 20 << 32 | i)
        if (h := before[i]) >= 0 and (got := get(symbols[h] << 20 | symbols[i])) is not None:
            push(waiting, got >> 20 << 32 | h)
    return [s for s in symbols if s >= 0] if gone else symbols


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker; every machine has the tokenizer files installed."""
    def read() -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return Vocabulary(file.read())

    return held((Vocabulary, path), read)


def encode(df: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) of rows (doc_id, text)."""
    ddl, schema = arrow_schema(df, "doc_id long, ids array<int>")

    def run(batches):
        words = vocabulary(path)
        for part in slices(batches, "text", 2 << 20):
            ids, at = words.flat(part.column("text").to_pylist())
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), listed.cast(schema.field("ids").type)], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, ddl)


def decode(df: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids, text): the text the ids stand for; broken UTF-8 becomes U+FFFD."""
    ddl, schema = arrow_schema(df, "doc_id long, ids array<int>, text string")

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = part.column("ids")
                flat, at = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_pylist()
                texts = [words.decode(flat[a - at[0]: b - at[0]]) for a, b in zip(at, at[1:])]
                yield pa.record_batch([part.column("doc_id"), ids.cast(schema.field("ids").type), pa.array(texts, pa.string())], schema=schema)

    return df.select("doc_id", "ids").mapInArrow(run, ddl)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_and_back(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and of the text decoded from them, in one pass over the texts."""
    ddl, schema = arrow_schema(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        words = vocabulary(path)
        for part in slices(batches, "text", 1 << 20):
            ids, at = words.flat(part.column("text").to_pylist())
            (back, back_at), (told, told_at) = words.joined(ids), words.written(ids)
            back, told, rows = memoryview(back.tobytes()), memoryview(told.tobytes()), list(zip(at, at[1:]))
            digests = [
                [hashlib.sha256(told[told_at[a]: max(told_at[a], told_at[b] - 1)]).hexdigest() for a, b in rows],
                # As text: bytes that are no UTF-8 become U+FFFD before they are hashed.
                [hashlib.sha256(bytes(back[back_at[a]: back_at[b]]).decode("utf-8", "replace").encode()).hexdigest() for a, b in rows],
            ]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(at).astype(np.int64)), *[pa.array(d, pa.string()) for d in digests]], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_and_back(table(spark, folder, "documents"), tokenizer_path())
