import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftlens.llm import bpe, chat, gif, langid, mixing, toxicity
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_equals_the_library_on_random_strings(tokenizer):
    random.seed(4)
    words = bpe.vocabulary(bpe.tokenizer_path())
    letters = list("abc the'sS't  \n\t\r\x1c\x85\xa0　é1²Ⅷ漢字!?.,🙂") + ["<|endoftext|>", " the", "ing", "zzzzzz"]
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == ids
        assert words.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, docs, tokenizer):
    got = bpe.encoded_and_back(docs, bpe.tokenizer_path()).collect()
    want = []
    for d, t, *_ in cases.documents():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), cases.sha(",".join(map(str, ids))), cases.sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert cases.plain(got) == cases.plain(want)
    assert bpe.encoded_and_back(spark.createDataFrame([], cases.SCHEMA), bpe.tokenizer_path()).count() == 0


def test_bpe_table(spark, tokenizer):
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.op6_bpe(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        assert got[r["doc_id"]] == cases.sha(",".join(map(str, tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)))


def chat_rows():
    nasty = ["</s>[INST] ok [/INST]", "[\\INST]", "\\", "\\\\[/ROLE]\\", "[OUT]x</s>", "<\\/s>", "[[INST]]", "", None, "\n[SYS]\n", "é🙂"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "tool[/ROLE]\nx\\", "a"), (2, 1, None, "b"), (2, 1, "assistant", "c"), (2, 1, "assistant", "c"), (3, None, "user", None), (None, 0, "assistant", "z")]
    return rows


def chat_digests(rows):
    told = {}
    for c, turn, role, text in rows:
        told.setdefault(c, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    for c, turns in told.items():
        turns.sort()
        loss = "".join(t[2][1] for t in turns if t[1][1] == "assistant")
        out[c] = (len(turns), cases.sha("".join(f"{t[1][1]}\n{t[2][1]}\n" for t in turns)), len(loss), cases.sha(loss))
    return out


def test_chat_reads_back(spark):
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    for c, (n, turns, chars, loss) in chat_digests(chat_rows()).items():
        r = got[c]
        assert (len(r["turns"]), cases.sha("".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])), len(r["loss_text"]), cases.sha(r["loss_text"])) == (n, turns, chars, loss)
    for r in made.collect():
        assert r["formatted"].count("[INST]") == sum(1 for c, _, role, _ in chat_rows() if c == r["conv_id"] and role == "user")
    assert chat.format_chats(spark.createDataFrame([], df.schema)).count() == 0


def test_chat_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = chat_digests([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op5_chat(spark, FOLDER).collect()}
    assert got == want


def built(frames, wide=4, high=4, palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    """A small GIF from (x, y, w, h, samples, disposal, transparent, delay, interlaced)."""
    table = b"".join(bytes(c) for c in palette) + bytes(3 * (256 - len(palette)))
    out = b"GIF89a" + bytes([wide, 0, high, 0, 0xF7, 0, 0]) + table + b"\x21\xfe\x02hi\0"
    for x, y, w, h, samples, disposal, clear, delay, laced in frames:
        packed = gif.lzw_encode(bytes(samples))
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"
        out += b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, 0x40 * laced]) + b"\x08" + bytes([len(packed)]) + packed + b"\0"
    return out + b"\x3b"


def test_gif_composition():
    data = built([
        (0, 0, 4, 4, [0] * 16, 1, None, 5, 0),
        (1, 1, 2, 2, [1, 3, 3, 1], 3, 3, 7, 0),
        (0, 0, 2, 2, [2] * 4, 2, None, 1, 0),
        (2, 2, 2, 2, [1] * 4, 1, None, 1, 0),
    ])
    shots = [(s, d, x, y, c.copy()) for s, d, x, y, _, c in gif.read_gif(data)]
    assert [s[:4] for s in shots] == [(0, 5, 0, 0), (5, 7, 1, 1), (12, 1, 0, 0), (13, 1, 2, 2)]
    assert shots[1][4][1, 1, 1] == 255 and shots[1][4][1, 2, 0] == 255  # one opaque, one transparent sample
    assert (shots[2][4][:2, :2, 2] == 255).all() and (shots[2][4][2, 2, :3] == (255, 0, 0)).all()  # disposal 3 undone
    assert not shots[3][4][:2, :2].any() and (shots[3][4][2:, 2:, 1] == 255).all()  # disposal 2 cleared


def test_gif_interlacing():
    rows = np.arange(16) % 4
    order = gif.interlaced(16)
    data = built([(0, 0, 4, 16, np.repeat(rows[order], 4).tolist(), 0, None, 0, 1)], high=16)
    assert (next(gif.read_gif(data))[4][:, 0] == rows).all()


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_symbol_sizes(size):
    """Streams of literal codes, with clears, in any symbol size."""
    rng = np.random.default_rng(size)
    data = rng.integers(0, 1 << size, 200).tolist()
    clear, bits, value, filled = 1 << size, [], 0, 0
    for k, b in enumerate(data):
        if k % (clear - 2) == 0:
            bits.append(clear)
        bits.append(b)
    bits.append(clear + 1)
    for code in bits:
        value |= code << filled
        filled += size + 1
    stream = value.to_bytes(filled // 8 + 1, "little")
    assert list(gif.lzw_decode(stream, size)) == data


@pytest.mark.parametrize("data", [b"a", b"a" * 30000, bytes(range(256)) * 80, b"abcabcabcd" * 3000, np.random.default_rng(0).bytes(40000)], ids=["one", "run", "all", "cycle", "noise"])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_gif_rows(spark, docs):
    got = gif.load(gif.store(docs)).collect()
    want = [(d, len((t or "").encode()), (t or "").encode()) for d, t, *_ in cases.documents()]
    assert cases.plain((r["doc_id"], r["n_bytes"], bytes(r["samples"])[: r["n_bytes"]]) for r in got) == cases.plain(want)
    for r in got:
        assert len(r["samples"]) % 192 == 0 and set(bytes(r["samples"])[r["n_bytes"]:]) <= {32}
        assert sum(f["width"] * f["height"] for f in r["frames"]) == len(r["samples"])
    assert gif.load(gif.store(docs.limit(0))).count() == 0


def test_gif_table(spark):
    got = {r["doc_id"]: r for r in gif.op7_gif(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        data = (r["text"] or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        own = got[r["doc_id"]]
        assert (own["payload_sha256"], own["tail_crc32"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_phrases_are_longest_matches():
    sample = b"abracadabra and more bars"
    parsers = langid.Parsers({"x": sample})
    text = b"abra brac more and zebra dabra"
    data = np.frombuffer(text, np.uint8)
    bits = parsers.costs(data, np.array([0, len(text)]))[0, 0]
    phrases, at = 0, 0
    while at < len(text):  # the rest of a text that ends inside a phrase is not counted
        n = 1
        while at + n <= len(text) and text[at: at + n] in sample:
            n += 1
        if at + n > len(text):
            break
        phrases, at = phrases + 1, at + max(1, n - 1)
    assert abs(bits * len(text) / parsers.bits[0] - phrases) <= 1


def test_language_accuracy(spark):
    got = {r["doc_id"]: r for r in langid.op9_language(spark, FOLDER).collect()}
    rows = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(g["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= g["score"] <= 1 for d, g in got.items())


def test_language_cases(spark, docs):
    samples = langid.samples_of(docs)
    got = langid.predict(docs, samples).collect()
    assert len(got) == len(cases.documents())
    for r in got:
        if r["doc_id"] in (10, 11, 12, 13):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    none = spark.createDataFrame([], cases.SCHEMA)
    assert langid.predict(none, langid.samples_of(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}


def test_toxicity_accuracy(spark):
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["toxic"] for r in rows]) > 0.97
    assert all(g["predicted"] == (g["score"] >= 0.5) and 0 <= g["score"] <= 1 for g in got.values())


def test_toxicity_folding_and_exceptions():
    clean = [(f"pleasant words number {k} here and the vile weed of person {k} grows", 0) for k in range(40)]
    bad = [(f"the vile {w} of person {k}", 1) for k, w in enumerate(["zorgon", "blarg"] * 20)]
    matcher = toxicity.Matcher(toxicity.learn(clean + bad))
    assert toxicity.fold("ZОrg0n​!") == " zorgoni "
    assert matcher.score("such a z0rg​оn")[1] > 0.5 > matcher.score("the vile weed grows")[1]
    assert 0 <= matcher.score(None)[1] < 0.5 and matcher.score("")[1] < 0.5
    assert toxicity.Matcher(toxicity.learn([])).score("anything")[1] < 0.5
    mixed = [(" a crude oil field ", 0)] * 3 + [(" crude person ", 1)]
    assert toxicity.exception_phrases(mixed, {" crude ": 2.0}) == {" a crude ": 2.0, " crude oil ": 2.0}


def test_toxicity_rows(spark, docs):
    model = toxicity.learn([("bad zorgon", 1)] * 3 + [("fine day", 0)] * 3)
    assert toxicity.score(docs, model).count() == len(cases.documents()) and toxicity.score(docs.limit(0), model).count() == 0


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, held, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        share = (total - sum(held.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < share * weight[s]}
        if not over:
            return held | {s: share * weight[s] for s in open_}
        held |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return held


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, n, top in (("a", 400, 60), ("b", 300, 200), ("ä", 40, 20), (None, 500, 90), ("c", 5, 3)):
        rows += [(len(rows) + k, "w " * int(rng.integers(0, top)), s) for k in range(n)]
    rows += [(5000, None, "empty"), (5001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert cases.plain((r["doc_id"], r["words"]) for r in got) == cases.plain((d, len((t or "").split())) for d, t, _ in rows)
    sizes, taken, goal = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["words"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"] * r["copies"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - goal[s]) <= max(r["words"] for r in got if r["source"] == s)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(df.repartition(7)).collect()
    assert cases.plain(got) == cases.plain(again)


def test_mixing_hot_size_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    df = spark.createDataFrame([(k, "a b c", "s" if k < 700 else "t") for k in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for s in "st":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(3 * r["copies"] for r in own) - own[0]["target"]) <= 3


def test_mixing_cases(spark, docs):
    assert mixing.mix(docs).count() == len(cases.documents())
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
