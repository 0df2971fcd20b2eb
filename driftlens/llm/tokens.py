"""Token ids of whole texts by public tokenizer files, one loaded copy per Python worker.

Two libraries hold the same byte-level vocabulary: the faster one encodes, and
texts its pattern engine gives up on (very long runs of white space) go to the
other, whose ids are the definition. Tests compare both.
"""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np

from driftlens.llm.bpe import byte_letters
from driftlens.llm.common import held

#: Fixed value: the published piece pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE file. With ``special``, added tokens' strings in a text become their ids; without, they are text."""

    def __init__(self, path: str, special: bool):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, self.added = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.added}
        self.strings = {i: word for word, i in ranks.items()} | {i: word.encode() for word, i in self.added.items()}
        self.size = 1 + max(self.strings)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.allowed = set(self.added) if special else set()
        self.path, self.special = path, special

    @cached_property
    def exact(self):
        """The defining library; loaded only where it is needed, as it takes memory in every worker."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = not self.special
        return made

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentence-piece file: ids of texts and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.strings = {i: self.bytes_of(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.size)}

    @staticmethod
    def bytes_of(piece: str, single: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if single else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def loaded(kind, *args):
    """One tokenizer per worker; every machine has the files installed."""
    return held((kind, *args), lambda: kind(*args))
