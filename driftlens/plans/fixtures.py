"""How the test tables stand in for the engine's entities.

Every view exists twice: as a DataFrame and as the SQL text an independent
database runs. The pixel fact is ``lineitem``; units are ``orders``; buildings
are nations; image manifests are ``documents``; grids are (supplier, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column, digits=9):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def building_split(building):
    last = F.pmod(building, F.lit(10))
    return F.when(last == 7, "val").when(last >= 8, "test").otherwise("train")


SPLIT_SQL = "CASE WHEN {b} % 10 = 7 THEN 'val' WHEN {b} % 10 >= 8 THEN 'test' ELSE 'train' END"


def scores(spark, folder) -> DataFrame:
    """Pixel facts keyed by unit only; unit attributes join after aggregation."""
    line = table(spark, folder, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0).alias("label"),
        (F.col("l_discount") * 10).cast("float").alias("score_a"),
        (F.col("l_tax") * 12.5).cast("float").alias("score_b"),
        ((F.col("l_extendedprice") % 1000) / 1000).cast("float").alias("score_c"),
        (F.col("l_linestatus") == "O").alias("support"),
    )


def units(spark, folder) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_custkey").alias("sequence_id"),
        F.col("c_nationkey").alias("building_id"),
        building_split(F.col("c_nationkey")).alias("split"),
        F.col("o_orderpriority").alias("state"),
        F.col("o_orderstatus").alias("nuisance"),
        F.col("o_orderdate").alias("taken"),
        F.col("o_totalprice").alias("seconds"),
        F.col("c_mktsegment").alias("scenario"),
    )


PX = f"""px AS (
  SELECT l_orderkey AS unit_id, l_linenumber AS pos,
    CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END AS label,
    CAST(l_discount * 10 AS FLOAT) AS score_a, CAST(l_tax * 12.5 AS FLOAT) AS score_b,
    CAST((l_extendedprice % 1000) / 1000 AS FLOAT) AS score_c, l_linestatus = 'O' AS support,
    o_custkey AS sequence_id, c_nationkey AS building_id,
    {SPLIT_SQL.format(b='c_nationkey')} AS split,
    o_orderpriority AS state, o_orderstatus AS nuisance, c_mktsegment AS scenario
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

UNITS = f"""units AS (
  SELECT o_orderkey AS unit_id, o_custkey AS sequence_id, c_nationkey AS building_id,
    {SPLIT_SQL.format(b='c_nationkey')} AS split, o_orderpriority AS state,
    o_orderstatus AS nuisance, o_orderdate AS taken, o_totalprice AS seconds, c_mktsegment AS scenario
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def cells(spark, folder) -> DataFrame:
    """One row per (unit, pos): repeated line numbers are merged."""
    return scores(spark, folder).groupBy("unit_id", "pos").agg(
        F.max("label").alias("label"),
        F.max("score_a").alias("score_a"),
        F.max("score_b").alias("score_b"),
        F.max("score_c").alias("score_c"),
        F.bool_or("support").alias("support"),
    )


CELLS = """cells AS (
  SELECT unit_id, pos, max(label) AS label, max(score_a) AS score_a, max(score_b) AS score_b,
    max(score_c) AS score_c, bool_or(support) AS support
  FROM px GROUP BY unit_id, pos)"""


def frames(spark, folder) -> DataFrame:
    """Units with their frame index (year since the first) inside the sequence."""
    return units(spark, folder).withColumn("frame", F.year("taken") - 1995)


def grid(spark, folder, side=16) -> DataFrame:
    """Class-bit maps: image = supplier, 16x16 cells from the part key."""
    line = table(spark, folder, "lineitem")
    bit = F.call_function("shiftleft", F.lit(1), F.col("l_linenumber") - 1)
    old = F.col("l_linestatus") == "O"
    return (
        line.groupBy(
            F.col("l_suppkey").alias("image_id"),
            (F.floor(F.col("l_partkey") / side) % side).cast("int").alias("y"),
            (F.col("l_partkey") % side).cast("int").alias("x"),
        )
        .agg(
            F.bit_or(F.when(old, bit).otherwise(0)).alias("old_bits"),
            F.bit_or(F.when(~old, bit).otherwise(0)).alias("new_bits"),
            F.bool_or(F.col("l_quantity") > 3).alias("support"),
            F.max((F.col("l_discount") * 10).cast("float")).alias("score"),
            F.max(F.col("l_quantity").cast("int") * 5).alias("r"),
            F.min(F.col("l_quantity").cast("int") * 5).alias("s_r"),
            F.max(F.col("l_linenumber") * 36).alias("g"),
            F.min(F.col("l_linenumber") * 36).alias("s_g"),
            F.max(F.floor(F.col("l_extendedprice")) % 256).cast("int").alias("b"),
            F.min(F.floor(F.col("l_extendedprice")) % 256).cast("int").alias("s_b"),
        )
        .withColumn("building_id", (F.col("image_id") % 25).cast("int"))
        .withColumn("split", building_split(F.col("building_id")))
    )


GRID = f"""grid AS (
  SELECT *, CAST(image_id % 25 AS INTEGER) AS building_id, {SPLIT_SQL.format(b='(image_id % 25)')} AS split FROM (
  SELECT l_suppkey AS image_id, CAST((l_partkey // 16) % 16 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x,
    bit_or(CASE WHEN l_linestatus = 'O' THEN CAST(1 << (l_linenumber - 1) AS INTEGER) ELSE 0 END) AS old_bits,
    bit_or(CASE WHEN l_linestatus <> 'O' THEN CAST(1 << (l_linenumber - 1) AS INTEGER) ELSE 0 END) AS new_bits,
    bool_or(l_quantity > 3) AS support, max(CAST(l_discount * 10 AS FLOAT)) AS score,
    max(CAST(l_quantity AS INTEGER) * 5) AS r, min(CAST(l_quantity AS INTEGER) * 5) AS s_r,
    max(l_linenumber * 36) AS g, min(l_linenumber * 36) AS s_g,
    max(CAST(floor(l_extendedprice) AS INTEGER) % 256) AS b, min(CAST(floor(l_extendedprice) AS INTEGER) % 256) AS s_b
  FROM lineitem GROUP BY 1, 2, 3))"""


def frame_grid(spark, folder, side=8) -> DataFrame:
    """Aligned frames: sequence = supplier, frame = ship year, 8x8 cells."""
    line = table(spark, folder, "lineitem")
    return line.groupBy(
        F.col("l_suppkey").alias("sequence_id"),
        (F.year("l_shipdate") - 1995).alias("frame"),
        (F.floor(F.col("l_partkey") / side) % side).cast("int").alias("y"),
        (F.col("l_partkey") % side).cast("int").alias("x"),
    ).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("l_linenumber") - 1)).alias("bits"),
        F.max("l_quantity").alias("value"),
    )


FRAME_GRID = """fgrid AS (
  SELECT l_suppkey AS sequence_id, CAST(year(l_shipdate) - 1995 AS INTEGER) AS frame,
    CAST((l_partkey // 8) % 8 AS INTEGER) AS y, CAST(l_partkey % 8 AS INTEGER) AS x,
    bit_or(CAST(1 << (l_linenumber - 1) AS INTEGER)) AS bits, max(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def images(spark, folder) -> DataFrame:
    """Image manifest rows from documents; exact text copies are byte duplicates."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = documents.join(labels, "doc_id", "left").withColumn("sha256", F.sha2("text", 256))
    building = F.concat(F.lit("b"), F.substring("source", 4, 9))
    nibble = F.substring(F.sha2("source", 256), 1, 1)
    return rows.select(
        F.col("doc_id").alias("image_id"),
        F.concat(
            F.substring("sha256", 1, 8), F.lit("-"), F.col("source"), F.lit("_"), F.col("lang"),
            F.when(F.col("n_chars") % 7 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("n_chars") % 12 + 2000).cast("string"))),
            F.when(F.col("n_chars") % 5 == 0, "_v2").otherwise(""), F.lit(".jpg"),
        ).alias("file_name"),
        "sha256",
        F.when(F.col("doc_id") % 29 != 0, building).alias("building_id"),
        F.when(F.col("doc_id") % 13 != 0, F.concat("source", F.lit("_"), "lang", F.lit("_"), (F.col("doc_id") % 4).cast("string"), F.lit("_"), F.floor(F.col("doc_id") / 1000).cast("string"))).alias("view_id"),
        F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 12 + 2000).cast("int").alias("year"),
        (F.col("n_chars") % 1500 + 200).cast("int").alias("width"),
        ((F.col("n_chars") * 7) % 1500 + 200).cast("int").alias("height"),
        F.when(F.col("n_chars") % 17 == 0, "missing").otherwise("ready").alias("image_status"),
        F.when(F.col("quality") == 0, "inferred").otherwise("reviewed").alias("metadata_status"),
        F.when(nibble < "b", "train").when(nibble < "d", "val").otherwise("test").alias("split"),
        "lang",
    )


IMAGES = """images AS (
  SELECT doc_id AS image_id,
    substr(sha256(text), 1, 8) || '-' || source || '_' || lang ||
      CASE WHEN n_chars % 7 = 0 THEN '' ELSE '_' || CAST(n_chars % 12 + 2000 AS VARCHAR) END ||
      CASE WHEN n_chars % 5 = 0 THEN '_v2' ELSE '' END || '.jpg' AS file_name,
    sha256(text) AS sha256,
    CASE WHEN doc_id % 29 <> 0 THEN 'b' || substr(source, 4, 9) END AS building_id,
    CASE WHEN doc_id % 13 <> 0 THEN source || '_' || lang || '_' || CAST(doc_id % 4 AS VARCHAR) || '_' || CAST(doc_id // 1000 AS VARCHAR) END AS view_id,
    CASE WHEN n_chars % 11 <> 0 THEN CAST(n_chars % 12 + 2000 AS INTEGER) END AS year,
    CAST(n_chars % 1500 + 200 AS INTEGER) AS width, CAST((n_chars * 7) % 1500 + 200 AS INTEGER) AS height,
    CASE WHEN n_chars % 17 = 0 THEN 'missing' ELSE 'ready' END AS image_status,
    CASE WHEN quality = 0 THEN 'inferred' ELSE 'reviewed' END AS metadata_status,
    CASE WHEN substr(sha256(source), 1, 1) < 'b' THEN 'train' WHEN substr(sha256(source), 1, 1) < 'd' THEN 'val' ELSE 'test' END AS split,
    lang
  FROM documents LEFT JOIN labels USING (doc_id))"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
