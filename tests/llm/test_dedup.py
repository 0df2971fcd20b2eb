import numpy as np
import pytest

from driftlens.llm import itq, jaccard, langid, lpf, repeats, suffixtree
from driftlens.llm.components import components
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA)


@pytest.fixture(params=[(3 << 20, 12 << 20, 400), (4000, 3000, 2)], ids=["one slice", "many slices and hot anchors"])
def sizes(request, monkeypatch):
    for module in (repeats, jaccard):
        monkeypatch.setattr(module, "SLICE_BYTES", request.param[0])
        monkeypatch.setattr(module, "BUCKET_BYTES", request.param[1])
    monkeypatch.setattr(repeats, "HOT", request.param[2])


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_bytes_against_brute_force(docs, sizes):
    got = lpf.remove_copies(docs).collect()
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), cases.sha(bytes(r["kept"]))) for r in got]
    assert cases.plain(rows) == cases.plain(cases.cut_bytes(pairs(cases.documents())))


def test_words_against_brute_force(docs, sizes):
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in suffixtree.remove_repeats(docs).collect()]
    assert cases.plain(rows) == cases.plain(cases.cut_words(pairs(cases.documents())))


@pytest.mark.parametrize("block", [800, 2])
def test_jaccard_against_all_pairs(docs, sizes, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()]
    assert cases.plain(rows) == cases.plain(cases.components(pairs(cases.documents())))


def test_jaccard_threshold_is_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = np.random.default_rng(3)
    rows, base = [], [f"w{k}" for k in range(94)]
    for k in range(60):
        words = list(base)
        for p in rng.choice(94, rng.integers(0, 6), replace=False):
            words[p] = f"n{k}x{p}"
        rows.append((k, " ".join(words)))
    rows += [(100, " ".join(f"q{k}" for k in range(9))), (101, " ".join(f"q{k}" for k in range(8)))]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert cases.plain(got) == cases.plain(cases.components(rows))
    assert (101, 4, 100) in got  # 4 of 5 shingles is exactly 0.8


def test_one_row_of_each_group_stays(docs):
    rows = cases.documents()
    sets, owner = cases.groups(pairs(rows))
    want = sum(1 for s in sets if not s) + len({o for s, o in zip(sets, owner) if s})
    got = jaccard.first_of_groups(docs)
    assert got.columns == docs.columns and got.count() == want


def test_merge_skip_counts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = [sorted(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(rng.integers(1, 8))]
        least = int(rng.integers(1, len(lists) + 1))
        want = {v: n for v in range(40) if (n := sum(v in x for x in lists)) >= least}
        assert dict(zip(*jaccard.merge_skip(lists, least))) == want


def test_windows_over_random_small_alphabet(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 300)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    rng = np.random.default_rng(5)
    block = "".join(rng.choice(list("ab"), 90))
    rows = [(k, "".join(rng.choice(list("ab "), rng.integers(0, 150))) + (block[rng.integers(0, 40):] if k % 2 else "")) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), cases.sha(bytes(r["kept"]))) for r in lpf.remove_copies(df).collect()]
    assert cases.plain(got) == cases.plain(cases.cut_bytes(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    assert lpf.remove_copies(none).count() == suffixtree.remove_repeats(none).count() == jaccard.similar_groups(none).count() == 0
    assert jaccard.first_of_groups(none).count() == 0


def test_clashing_column_names(docs):
    more = docs.selectExpr("*", "'s' AS _slice", "'o' AS _own", "1 AS _id", "'h' AS _hash", "true AS _once", "2 AS _k", "'t' AS _text", "'l' AS _letters", "'p' AS lang_pred", "'n' AS n_bytes", "'k' AS kept")
    n = more.count()
    for rows, result in ((lpf.remove_copies(more), {"n_bytes", "n_removed", "kept", "spans"}), (suffixtree.remove_repeats(more), {"n_words", "n_removed", "kept"})):
        assert rows.count() == n and {r["_slice"] for r in rows.collect()} == {"s"} and set(rows.columns) == set(more.columns) | result
    first = jaccard.first_of_groups(more)
    assert first.columns == more.columns and cases.plain(first.select(docs.columns).collect()) == cases.plain(jaccard.first_of_groups(docs).collect())
    told = langid.predict(more, langid.samples_of(more), tuple(more.columns)).collect()
    assert len(told) == n and {(r["_text"], r["_letters"]) for r in told} == {("t", "l")}


@pytest.mark.parametrize("query", ["bytes", "words"])
def test_whole_small_table_against_brute_force(spark, query):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    if query == "bytes":
        assert cases.plain(lpf.op2_lpf(spark, folder).collect()) == cases.plain(cases.cut_bytes(rows))
    else:
        assert cases.plain(suffixtree.op3_suffixtree(spark, folder).collect()) == cases.plain([(d, n, k, cases.sha(text)) for d, n, k, text in cases.cut_words(rows)])


def test_components_of_a_long_chain(spark):
    edges = spark.range(120).selectExpr("id AS a", "id + 1 AS b")
    got = components(edges)
    assert got.count() == 120 and got.filter("b <> 0").count() == 0


def vectors():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 32))
    rows = [(k, (centre[k % 40] + 0.05 * rng.normal(size=32)).astype(np.float32).tolist(), k) for k in range(300)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(20)]
    rows += [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] + [1.0] * 31, 0), (2003, [None] + [1.0] * 31, 0), (2004, [1.0, 2.0], 0), (2005, [2.0, 4.0], 1), (2006, [], 0)]
    return rows


@pytest.mark.parametrize("part", [12_000, 30])
def test_embeddings_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(itq, "PART", part)
    rows = vectors()
    got = {r["vec_id"]: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: {j for j, w in good if j != i and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in good}
    found, total = sum(got[i]["n_links"] for i in links), sum(map(len, links.values()))
    assert found >= 0.9 * total and all(got[i]["n_links"] <= len(links[i]) for i in links)
    for i in (2000, 2001, 2002, 2003, 2006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[2005]["component_id"] == 2004 and got[1005]["component_id"] == 0 and not got[1005]["kept"]
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum()) - len(x)
    got = itq.op8_itq(spark, folder).collect()
    assert len(got) == len(rows) and 0.9 * want <= sum(r["n_links"] for r in got) <= want


def turned(x, cosine, seed):
    """Unit vectors and partners at the given cosine."""
    x = itq.unit(x)
    way = np.random.default_rng(seed).normal(size=x.shape)
    way -= (way * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * way / np.linalg.norm(way, axis=1, keepdims=True)


@pytest.mark.parametrize("width", [17, 19])
def test_isolated_pairs_at_the_widths_of_millions_of_rows(spark, monkeypatch, width):
    n = 1000
    monkeypatch.setattr(itq, "FILL", n / 2**width)
    monkeypatch.setattr(itq, "PART", n * 3 / 2**6)
    cosine = np.random.default_rng(2).uniform(0.901, 0.95, (n // 2, 1))
    x, y = turned(np.random.default_rng(4).normal(size=(n // 2, 64)), cosine, 5)
    rows = [(2 * k + j, v[k].astype(np.float32).tolist()) for k in range(n // 2) for j, v in enumerate((x, y))]
    got = {r["vec_id"]: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == n and all(r["n_links"] <= 1 and r["component_id"] in (i, i - i % 2) for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * n


def test_vectors_without_an_id_link_like_others(spark):
    """1 and 2 are linked only through a vector without an id; two more without ids are alone with each other."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, at(0)), (None, at(20)), (2, at(40)), (None, at(120)), (None, at(120)), (None, at(125)), (3, at(200)), (None, at(200)), (None, at(270)), (None, None)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = [(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True), (None, 0, None, True)]
    want += [(None, 2, None, kept) for kept in (True, False, False)]
    assert cases.plain(map(tuple, got)) == cases.plain(want)


@pytest.mark.parametrize("n", [2_000, 80_000, 1_000_000, 5_000_000, 20_000_000, 100_000_000])
def test_recall_of_planted_pairs_at_every_size(n):
    """Tables chosen for ``n`` rows find pairs that the choice did not see; ``n`` only sets widths and table counts."""
    sample = np.random.default_rng(6).normal(size=(2000, 64)).astype(np.float32)
    plan = itq.choose(sample, n)
    assert plan.width == max(1, round(np.log2(n / itq.FILL))) and plan.tables >= 64 // plan.width
    for cosine in (0.9, 0.92, 0.95):
        one, other = (itq.encode(v, plan.models) for v in turned(sample, cosine, 8))
        found = np.zeros(len(sample), bool)
        for t in range(plan.tables):
            found |= itq.meet(itq.substring(one, t, plan), itq.substring(other, t, plan), plan)
        found &= (np.bitwise_count(one[:, :2] ^ other[:, :2]) <= plan.radius).all(1)
        assert found.mean() >= 0.98
