import zlib
from itertools import groupby

import pytest

from driftlens.llm import merkle
from tests.llm import cases
from tests.llm.cases import sha

FOLDER = "/root/testdata/sf0.001"


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc, text, lang, source, n = row
    return sha("".join(told(v) for v in (doc, source, lang, None if n is None else n + more, text)))


def climb(hashes):
    """Levels of one tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i: i + 2])) for i in range(0, len(last), 2)])
    return levels


def brute(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) by climbing every tree."""
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r[2])]
    trees = [climb([leaf_of(r) for r in g]) for g in groups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, (group, tree) in enumerate(zip(groups, trees)):
        for p, row in enumerate(group):
            way, bad = [], row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            for levels, at in ((tree, p), (top, k)):
                for level in levels[:-1]:
                    way.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else None))
                    at //= 2
            now = leaf_of(row, 1 if bad else 0)
            for right, sibling in way:
                now = sha(now if sibling is None else sibling + now if right else now + sibling)
            out.append((row[0], leaf_of(row), tree[-1][0], top[-1][0], sha("".join(s for _, s in way if s)), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("steps", [2])
def test_awkward_rows(spark, tmp_path, monkeypatch, steps):
    monkeypatch.setattr(merkle, "STEPS", steps)
    rows = [*cases.documents(), (5, None, "en", None, 3), (5, None, "en", None, 3), (-9, "", "1de", "", None)]
    df = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", "'x' AS tree", "'y' AS id", "1 AS level", "'z' AS leaf", "'w' AS _row")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert cases.plain(merkle.op11_merkle(spark, str(tmp_path)).collect()) == cases.plain(brute(rows))


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, tmp_path, n):
    rows = [(k, f"t{k}", ["a", "b", None][k], None, k) for k in range(n)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cases.plain(merkle.op11_merkle(spark, str(tmp_path)).collect()) == cases.plain(brute(rows) if rows else [])


def test_one_hot_group_of_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STEPS", 4)
    rows = [(k, "same text", "en" if k % 3 else None, "s", 9) for k in range(700)] + [(7, "x", f"l{k}", None, k) for k in range(40)]
    spark.createDataFrame(rows, cases.SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert cases.plain(merkle.op11_merkle(spark, str(tmp_path)).collect()) == cases.plain(brute(rows))


def test_tampering_shows(spark):
    got = merkle.op11_merkle(spark, FOLDER).collect()
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in got:
        bad = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and table[r["doc_id"]]["n_chars"] is not None
        assert r["verified"] == (not bad)
    assert len(got) == len(table) and len({r["root"] for r in got}) == 1


def test_rows_of_a_block_stay_bounded(spark):
    """No grouping is by the tree alone: a block holds 2 ** STEPS leaves whatever the tree's size."""
    rows = spark.range(5000).selectExpr("'1en' AS tree", "id", "unhex(sha2(cast(id AS string), 256)) AS leaf", "CAST(NULL AS binary) AS tampered")
    edges, depth, _ = merkle.edges_of(rows)
    assert depth == 14 and edges.filter("level = 0").count() == 5000 and edges.groupBy("tree", "level", "at").count().filter("count > 1").isEmpty()
