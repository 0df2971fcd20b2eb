"""Merkle manifest of a table with inclusion proofs by pointer jumping.

Every row is a leaf: the sha256 of its fields. Leaves of a group form a binary
tree in the order of their ids; the groups' subroots form the tree above. A
lone last node is hashed alone. Every node holds a segment, the siblings on the
way to an ancestor, first its parent. A self-join hands each node its
ancestor's segment, which doubles the distance, until every leaf holds the
siblings up to the root.

Only nodes whose level is a multiple of the distance can be asked again, so
inner nodes die out fast and each round costs about one row per leaf. Trees are
padded to one height by levels without a hash; then all leaves jump alike.
Positions come from one range partitioning, and blocks of ``2 ** STEPS`` leaves
are folded per group key, so no task holds a whole group however hot it is.

Defined cases: a NULL field is written as ``-``. NULL ids come first in their
group, NULL groups are a group of their own that comes first. Rows with equal
ids are ordered by their leaf; equal rows are told apart by position only, so
they carry different proofs. Texts of any length are hashed whole. An empty
table has no rows and no root. Only the named fields are read, so further
columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels folded per grouping; a block holds 2 ** STEPS nodes.
STEPS = 10
#: Tree names: "0" and "1..." are groups (NULL first, then by bytes), this one is the tree above them.
TOP = "2"
LEAF_ROW = "struct<id: bigint, leaf: binary, tampered: binary>"


def told(value: Column) -> Column:
    """A field as its byte count, a colon and the value; NULL is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(df: DataFrame, fields=FIELDS, key="doc_id", group="lang", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Rows (tree, id, leaf, tampered): a leaf per row, and the leaf of rows ``where`` some fields were changed."""
    leaf = sha(*[told(F.col(f)) for f in fields])
    other = F.when(where, sha(*[told((tampered or {}).get(f, F.col(f))) for f in fields])) if where is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    return df.select(tree.alias("tree"), F.col(key).cast("bigint").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("tampered"))


def placed(rows: DataFrame, order, name: str) -> DataFrame:
    """Add ``at``, the position in the row's tree, and ``height`` of the tree.

    One range shuffle sorts everything; partitions then only exchange how many
    rows of which tree they hold.
    """
    keys = ["tree", *order, "_tie"]
    # Equal rows are told apart by where they were read, so that copies of one row spread as well.
    dealt = written(rows, name).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = written(dealt.withColumn("_row", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_row", 33))
    held = dealt.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    parts = Window.partitionBy("tree").orderBy("_part")
    shifts = held.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_rows").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("_all"),
    )
    at = (F.col("_row") - F.col("_first") + F.col("_before")).alias("at")
    height = F.when(F.col("_all") > 1, F.length(F.bin(F.col("_all") - 1))).otherwise(0).alias("height")
    return dealt.join(shifts, ["tree", "_part"]).select(*rows.columns, at, height)


def folded(nodes: Column) -> Column:
    """Parents of one level: hashes of two neighbours, of one where there is no second."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: sha(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))


def forest(nodes: DataFrame, first: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Edges and subroots of every tree over (tree, at, height, hash, leaf_row), and the greatest height.

    ``first`` is the level of the given nodes. An edge row holds the way to the
    parent; subroots are rows (tree, height, hash).
    """
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    edges, tops = [], []
    for base in range(0, max(1, tallest), STEPS):
        run = F.least(F.lit(STEPS), F.col("height") - base)
        block = nodes.groupBy("tree", F.shiftright("at", STEPS).alias("block")).agg(
            F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct("at", "hash", "leaf_row"))).alias("_n")
        )
        start = F.array(F.transform("_n", lambda n: n["hash"]))
        up = F.aggregate(F.sequence(F.lit(1), run), start, lambda seen, _: F.concat(seen, F.array(folded(F.element_at(seen, -1)))))
        made = written(block.select(
            "tree", "block", "height", F.when(run > 0, up).otherwise(start).alias("levels"), F.transform("_n", lambda n: n["leaf_row"]).alias("_rows"),
        ), name)
        twin = lambda hashes, i: F.get(hashes, i.bitwiseXOR(F.lit(1)))
        step = lambda hashes, level: F.transform(hashes, lambda h, i: F.struct(
            (level + base + first).alias("level"), (F.shiftleft("block", STEPS) / F.pow(F.lit(2), level) + i).cast("bigint").alias("at"),
            F.unhex(twin(hashes, i)).alias("siblings"), F.when(twin(hashes, i).isNull(), "-").when(i % 2 == 0, "R").otherwise("L").alias("sides"),
            F.when(level == 0, F.get("_rows", i)).alias("leaf_row"),
        ))
        inner = F.flatten(F.transform(F.slice("levels", 1, F.size("levels") - 1), step))
        edges.append(made.select("tree", F.inline(inner)).select(
            "tree", "level", "at", F.col("tree").alias("to_tree"), F.shiftright("at", 1).alias("to_at"), F.coalesce("siblings", F.lit(b"")).alias("siblings"), "sides",
            F.lit(None).cast("string").alias("subroot"), "leaf_row",
        ))
        # A tree of one leaf has no edge of its own; its leaf is its subroot.
        top = made.select("tree", F.col("block").alias("at"), "height", F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), F.get("_rows", F.lit(0)).alias("leaf_row"))
        tops.append(top.filter(F.col("height") <= base + STEPS).select("tree", "height", "hash", F.when(F.col("height") == 0, F.col("leaf_row")).alias("leaf_row")))
        nodes = top.filter(F.col("height") > base + STEPS).withColumn("leaf_row", F.lit(None).cast(LEAF_ROW))
    return reduce(DataFrame.unionByName, edges), written(reduce(DataFrame.unionByName, tops), name), tallest


def edges_of(rows: DataFrame) -> tuple[DataFrame, int, str]:
    """Every node's way to its parent over rows (tree, id, leaf, tampered), the depth of the leaves, and the root."""
    given = F.struct("id", "leaf", "tampered").alias("leaf_row")
    low = placed(rows, ["id", "leaf", "tampered"], "merkle-leaves").select("tree", "at", "height", as_hex(F.col("leaf")).alias("hash"), given)
    inner, tops, tallest = forest(low, 0, "merkle-blocks")
    named = tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "hash")
    ranked = written(placed(named, ["group"], "merkle-groups"), "merkle-groups")
    upper, roots, above = forest(ranked.select("tree", "at", "height", "hash", F.lit(None).cast(LEAF_ROW).alias("leaf_row")), tallest + 1, "merkle-top")
    root = roots.first()
    # From a subroot up to the common height nothing is hashed; then the way goes on in the tree above.
    ranks = ranked.select(F.col("group").alias("tree"), F.col("at").alias("_rank"))
    level = F.explode(F.sequence("height", F.lit(tallest))).alias("level")
    across = F.col("level") == tallest
    padded = tops.join(ranks, "tree").select("tree", "height", "hash", "leaf_row", "_rank", level).select(
        "tree", "level", F.lit(0).cast("bigint").alias("at"), F.when(across, TOP).otherwise(F.col("tree")).alias("to_tree"),
        F.when(across, F.col("_rank")).otherwise(0).alias("to_at"), F.lit(b"").alias("siblings"), F.lit("=").alias("sides"), F.when(across, F.col("hash")).alias("subroot"),
        F.when(F.col("level") == 0, F.col("leaf_row")).alias("leaf_row"),
    )
    return inner.unionByName(padded).unionByName(upper), tallest + 1 + above, root["hash"] if root else ""


def jumped(edges: DataFrame, depth: int) -> DataFrame:
    """Leaves with their segments up to the root: each self-join doubles the ancestor's distance."""
    reach, near = 1, written(edges, "merkle-edges")
    while reach < depth:
        asked = near.filter(F.col("level") % (2 * reach) == 0)
        ahead = near.filter(F.col("level") % (2 * reach) == reach).select(
            F.col("tree").alias("to_tree"), F.col("at").alias("to_at"), (F.col("level") - reach).alias("level"), F.col("to_tree").alias("_tree"), F.col("to_at").alias("_at"),
            F.col("siblings").alias("_siblings"), F.col("sides").alias("_sides"), F.col("subroot").alias("_subroot"),
        )
        near = written(asked.join(ahead, ["to_tree", "to_at", "level"], "left").select(
            "tree", "level", "at", F.coalesce("_tree", "to_tree").alias("to_tree"), F.coalesce("_at", "to_at").alias("to_at"),
            F.concat("siblings", F.coalesce("_siblings", F.lit(b""))).alias("siblings"), F.concat("sides", F.coalesce("_sides", F.lit(""))).alias("sides"),
            F.coalesce("subroot", "_subroot").alias("subroot"), "leaf_row",
        ), "merkle-jumps")
        reach *= 2
    return near.filter("level = 0")


def fold(leaf: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to.

    One letter per level tells where the sibling stands: L left, R right, - none
    (hashed alone), = no hash at this level.
    """
    def step(state, k):
        side = F.substring(sides, k, F.lit(1))
        other = as_hex(F.substring(siblings, state["used"] * 32 + 1, F.lit(32)))
        up = F.when(side == "=", state["hash"]).when(side == "-", sha(state["hash"])).when(side == "L", sha(other, state["hash"])).otherwise(sha(state["hash"], other))
        return F.struct(up.alias("hash"), (state["used"] + side.isin("L", "R").cast("int")).alias("used"))

    start = F.struct(leaf.alias("hash"), F.lit(0).alias("used"))
    return F.aggregate(F.sequence(F.lit(1), F.length(sides)), start, step)["hash"]


def manifest(rows: DataFrame) -> DataFrame:
    """Rows (id, leaf, tampered, subroot, root, siblings, sides) of leaves (tree, id, leaf, tampered).

    ``siblings`` are 32-byte digests in a row, from the leaf upwards; ``sides``
    has a letter per level as ``fold`` reads it.
    """
    edges, depth, root = edges_of(rows)
    return jumped(edges, depth).select(
        F.col("leaf_row.id").alias("id"), as_hex(F.col("leaf_row.leaf")).alias("leaf"), as_hex(F.col("leaf_row.tampered")).alias("tampered"), "subroot", F.lit(root).alias("root"),
        "siblings", "sides",
    )


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(leaves(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=seventh))
    back = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("sides")))
    return back.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(as_hex(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_CRC = """CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(CAST(doc_id AS VARCHAR)[k])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS BIGINT)"""


def _leaf_sql(changed: str = "n_chars") -> str:
    return " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", changed, "text"))


MERKLE_SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({_leaf_sql()}) AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN sha256({_leaf_sql('(n_chars + 1)')}) END AS other FROM documents),
  spots AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
  low AS (SELECT g, 0 AS l, p AS i, leaf AS h, n FROM spots UNION ALL SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY g, l, i // 2),
  subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
  high AS (SELECT 0 AS l, p AS i, subroot AS h, n FROM subs UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY l, i // 2),
  top AS (SELECT h AS root FROM high WHERE n = 1),
  way AS (SELECT s.doc_id, s.g, s.p, l.l AS step, (s.p >> l.l) & 1 AS bit, o.h AS sib FROM spots s JOIN (SELECT DISTINCT g, l FROM low WHERE n > 1) l USING (g) LEFT JOIN low o ON o.g = s.g AND o.l = l.l AND o.i = xor(s.p >> l.l, 1)
    UNION ALL SELECT s.doc_id, s.g, s.p, 1000 + l.l, (u.p >> l.l) & 1, o.h FROM spots s JOIN subs u USING (g) CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) l LEFT JOIN high o ON o.l = l.l AND o.i = xor(u.p >> l.l, 1)),
  listed AS (SELECT g, p, coalesce(string_agg(sib, '' ORDER BY step), '') AS sibs, list(struct_pack(bit := bit, sib := sib) ORDER BY step) AS steps FROM way GROUP BY g, p),
  walk AS (SELECT g, p, coalesce(other, leaf) AS h, 1 AS k FROM spots UNION ALL SELECT w.g, w.p, sha256(CASE WHEN t.sib IS NULL THEN w.h WHEN t.bit = 1 THEN t.sib || w.h ELSE w.h || t.sib END), w.k + 1
    FROM (SELECT walk.*, steps[walk.k] AS t, len(steps) AS n FROM walk JOIN listed USING (g, p)) w WHERE w.k <= w.n),
  ends AS (SELECT g, p, max_by(h, k) AS folded_root FROM walk GROUP BY 1, 2)
  SELECT s.doc_id, s.leaf, u.subroot, top.root, sha256(coalesce(x.sibs, '')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
  FROM spots s JOIN subs u ON u.g = s.g JOIN ends e ON e.g = s.g AND e.p = s.p LEFT JOIN listed x ON x.g = s.g AND x.p = s.p CROSS JOIN top"""
