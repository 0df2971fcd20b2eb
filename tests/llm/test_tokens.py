"""Cross-tokenizer alignment and packing against plain versions on the libraries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftlens.llm import alignment, packing
from driftlens.llm.bpe import byte_letters, tokenizer_path
from driftlens.llm.tokens import ByteLevel, loaded
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "a▁b", "nul \x00 end", "<0x41> </s> <s> <unk> <|endoftext|>x", "  two  blanks ", " " * 900_000 + "x", "🙂👩‍👩‍👧é漢字", "\t\n\r \x85", "a" * 3000, "",
    None, "ﬁ Ⅷ ①", "x﻿y", "​", "_" * 700,
]


def library(special=True):
    made = Tokenizer.from_file(tokenizer_path())
    made.encode_special_tokens = not special
    return made


def awkward():
    rows = [(d, t) for d, t, *_ in cases.documents()] + [(100 + k, t) for k, t in enumerate(ODD)]
    return [*rows, (101, ODD[1]), (None, "a▁b"), (None, None)]


def stored(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS groups", "1 AS doc_row", "2 AS sequence_id", "3 AS length").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_both_byte_level_libraries_agree():
    random.seed(3)
    letters = list("abc the'sS't  \n\t\r\x1c\x85\xa0　é1²Ⅷ漢字!?.,🙂") + ["<|endoftext|>", " the", "ing", "zzzzzz"]
    for special in (True, False):
        words, want = loaded(ByteLevel, tokenizer_path(), special), library(special)
        for text in ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [t for t in ODD if t]:
            assert words.encode(text).tolist() == want.encode(text, add_special_tokens=False).ids


def aligned_by_hand(rows):
    a_of, b_of, letters = library(False), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), byte_letters()
    names = {i: bytes(letters[c] for c in w) for w, i in a_of.get_vocab(with_added_tokens=False).items() if w != "<|endoftext|>"}

    def piece(i):
        name = b_of.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b_of.is_byte(i) else name.replace("▁", " ").encode()

    out, count = [], Counter()
    for d, text in rows:
        a = [(i, names[i]) for i in a_of.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in b_of.encode(text)] if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(w for _, w in a) != whole or b"".join(w for _, w in b) != whole:
            a, b = [], []
        ends = [dict(zip(np.cumsum([len(w) for _, w in side]).tolist(), range(len(side)))) for side in (a, b)]
        groups, links, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(str(i) for i, _ in a[at_a:k]) + "|" + ",".join(str(i) for i, _ in b[at_b:m]))
            links.append((a[k - 1][0], b[m - 1][0]))
            at_a, at_b = k, m
        count.update(links)
        out.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, n_a, n_b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), cases.sha(told) if told else "") for d, n_a, n_b, g, links, told in out]


@pytest.mark.parametrize("whole", [False, True])
def test_alignment(spark, tmp_path, whole):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()] if whole else awkward()
    got = alignment.op12_alignment(spark, FOLDER if whole else stored(spark, rows, tmp_path)).collect()
    assert cases.plain(got) == cases.plain(aligned_by_hand(rows))


def test_alignment_keeps_regular_links_out_of_the_shuffle(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = alignment.aligned(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).cache()
    r = made.selectExpr("sum(aggregate(same_n, 0L, (x, y) -> x + y)) AS same", "sum(aggregate(other_n, 0L, (x, y) -> x + y)) AS other", "sum(n_groups) AS n").first()
    assert r["same"] + r["other"] == r["n"] and r["same"] > 5 * r["other"]
    tool = loaded(alignment.Aligner, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    for a, b, *_ in alignment.pair_counts(made, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).filter("regular").limit(50).collect():
        assert tool.a.strings[a] == tool.b.strings[b]
    made.unpersist()


def test_alignment_without_rows(spark, tmp_path):
    assert alignment.op12_alignment(spark, stored(spark, [], tmp_path)).count() == 0
    assert alignment.op12_alignment(spark, stored(spark, [(1, None), (2, "")], f"{tmp_path}/b")).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def check_packing(rows, got):
    """Every document's ids, in order and once; sequences without gaps and within the bound. Returns the number of sequences."""
    tokenizer, want = library(), Counter()
    for d, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        starts = [0, *range(first, len(ids), 1024)]
        want.update((d, k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(zip(starts, [*starts[1:], len(ids)])))
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return len(held)


@pytest.mark.parametrize("per_block", [16, 16_384])
def test_packing_awkward(spark, tmp_path, monkeypatch, per_block):
    monkeypatch.setattr(packing, "PER_BLOCK", per_block)
    rows = awkward() + [(5, "one two three")] * 60 + [(None, None)] * 20
    check_packing(rows, packing.op13_packing(spark, stored(spark, rows, tmp_path)).collect())
    assert packing.op13_packing(spark, stored(spark, [], f"{tmp_path}/none")).count() == 0


def test_packing_of_the_table_is_close_to_the_bound(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op13_packing(spark, "/root/testdata/sf0.01").collect()
    least = -(-sum(r["length"] for r in got) // 1024)
    assert check_packing(rows, got) <= 1.01 * least


def test_packed_ids_read_back(spark):
    docs = spark.createDataFrame([(k, cases.base_text(k, 10 + 40 * k)) for k in range(30)], "doc_id long, text string")
    rows = packing.packed(packing.pieces(docs, tokenizer_path(), most=256, end=9, with_ids=True), 256)
    tokenizer, parts = library(), defaultdict(dict)
    for r in packing.sequences(rows).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 256
        for k, d in enumerate(r["doc_ids"]):
            a, b = r["offsets"][k], [*r["offsets"], r["length"]][k + 1]
            parts[d].setdefault("all", []).append(ids[a:b].tolist())
    for d, text in docs.collect():
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 9]
        assert sorted(i for p in parts[d]["all"] for i in p) == sorted(want)


def squares(open_by_gap):
    return sum(n * n for n in open_by_gap.values())


def test_every_choice_makes_the_sum_smallest():
    rng, most = np.random.default_rng(7), 60
    lengths = np.sort(rng.integers(1, most, 400))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, most)
    level = {}
    for size, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        gaps = Counter(most - v for v in level.values() if v < most)
        options = {}
        for gap in (g for g in gaps if g >= size):
            after = gaps.copy()
            after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            options[gap] = squares(after)
        assert level.get(s, 0) == o
        if options:
            assert options[most - o] == min(options.values())
        else:
            assert o == 0 and s not in level
        level[s] = o + size
