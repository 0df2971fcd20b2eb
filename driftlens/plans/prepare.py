"""Registered queries: sources, cleaning, ownership, leakage, pairing and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from driftlens.functions import digest as H
from driftlens.functions import names as N
from driftlens.operators import clean as C
from driftlens.operators import pairs as P
from driftlens.operators import sequences as Q
from driftlens.operators import split as S
from driftlens.plans.fixtures import CELLS, GRID, IMAGES, PX, UNITS, cells, grid, images, rounded, table, units, with_sql
from driftlens.plans.metrics import tidy
from driftlens.session import cut_lineage, stored
from driftlens.sources import coco, tables

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


# --- sources -----------------------------------------------------------------

def coco_documents(spark, folder):
    """One small annotation document per line item, as stored shards would be."""
    line = table(spark, folder, "lineitem")
    image = F.struct(F.col("l_orderkey").alias("id"), F.concat(F.lit("img_"), F.col("l_orderkey").cast("string")).alias("file_name"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    area = F.when(F.col("l_linestatus") == "O", F.col("l_quantity") - 2)
    note = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("category_id"), area.alias("area"))
    category = F.struct(F.col("l_linenumber").alias("id"), F.concat(F.lit("class_"), F.col("l_linenumber").cast("string")).alias("name"))
    return line.select(F.to_json(F.struct(F.array(image).alias("images"), F.array(note).alias("annotations"), F.array(category).alias("categories"))).alias("document"))


@register("coco_tables", """SELECT 'images' AS part, count(DISTINCT l_orderkey) AS items, CAST(NULL AS DOUBLE) AS area FROM lineitem
  UNION ALL SELECT 'annotations', count(*), sum(CASE WHEN l_linestatus = 'O' THEN l_quantity - 2 END) FROM lineitem UNION ALL SELECT 'categories', count(DISTINCT l_linenumber), NULL FROM lineitem""")
def coco_tables(spark, folder):
    image_rows, notes, categories = coco.parse_coco(coco_documents(spark, folder), "document")
    none = F.lit(None).cast("double")
    return (
        image_rows.agg(F.lit("images").alias("part"), F.countDistinct("image_id").alias("items"), F.max(none).alias("area"))
        .unionByName(notes.agg(F.lit("annotations").alias("part"), F.count("*").alias("items"), F.sum("area").alias("area")))
        .unionByName(categories.agg(F.lit("categories").alias("part"), F.countDistinct("category_id").alias("items"), F.max(none).alias("area")))
    )


def override_rows(spark, folder):
    d, k = table(spark, folder, "documents"), F.col("doc_id")
    return d.select(
        F.when(k % 50 == 9, "zz").otherwise(k.cast("string")).alias("image_id"), F.concat(F.lit(" "), "lang").alias("view_id"),
        F.when(k % 14 == 3, " ").otherwise(F.col("source")).alias("building_id"),
        F.when(k % 9 == 2, "").when(k % 31 == 4, "19x9").when(k % 37 == 5, "1700").otherwise((k % 20 + 2000).cast("string")).alias("year"),
        F.when(k % 5 == 0, " TRUE ").when(k % 5 == 1, "false").when(k % 41 == 6, "maybe").otherwise("true").alias("reviewed"), F.lit("").alias("notes"),
    )


OVER = """over AS (SELECT CASE WHEN doc_id % 50 = 9 THEN 'zz' ELSE CAST(doc_id AS VARCHAR) END AS image_id, lang AS view_id, CASE WHEN doc_id % 14 <> 3 THEN source END AS building_id,
  CASE WHEN doc_id % 9 = 2 THEN NULL WHEN doc_id % 31 = 4 THEN '19x9' WHEN doc_id % 37 = 5 THEN '1700' ELSE CAST(doc_id % 20 + 2000 AS VARCHAR) END AS year_text,
  CASE WHEN doc_id % 5 = 0 THEN 'true' WHEN doc_id % 5 = 1 THEN 'false' WHEN doc_id % 41 = 6 THEN 'maybe' ELSE 'true' END AS flag FROM documents)"""
_BAD = "(year_text IS NOT NULL AND NOT coalesce(TRY_CAST(year_text AS INTEGER) BETWEEN 1800 AND 2100, false))"


@register("metadata_overrides", with_sql(OVER, body=f"SELECT image_id, view_id, building_id, TRY_CAST(year_text AS INTEGER) AS year FROM over WHERE flag = 'true' AND building_id IS NOT NULL AND NOT {_BAD} AND image_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AND image_id IN (SELECT image_id FROM over GROUP BY 1 HAVING count(*) = 1)"))
def metadata_overrides(spark, folder):
    ids = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("image_id"))
    return tables.checked_overrides(override_rows(spark, folder), ids)[0].drop("notes")


@register("override_problems", with_sql(OVER, body=f"""SELECT problem, count(*) AS rows FROM (SELECT image_id, 'invalid_reviewed_flag' AS problem FROM over WHERE flag = 'maybe'
  UNION ALL SELECT image_id, 'reviewed_without_building' FROM over WHERE flag = 'true' AND building_id IS NULL UNION ALL SELECT image_id, 'invalid_year' FROM over WHERE flag = 'true' AND {_BAD}
  UNION ALL SELECT image_id, 'duplicate_override' FROM over GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT image_id, 'unknown_image' FROM over WHERE image_id = 'zz') GROUP BY 1"""))
def override_problems(spark, folder):
    ids = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("image_id"))
    problems = tables.checked_overrides(override_rows(spark, folder), ids)[1]
    return problems.groupBy("problem").agg(F.count("*").alias("rows"))


@register("index_rows", """SELECT event_type, count(*) AS rows, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k, count(*) - count(DISTINCT event_id // 2) AS duplicates FROM events GROUP BY 1""")
def index_rows(spark, folder):
    """JSON index rows parsed with a fixed schema, and their repeated keys."""
    rows = table(spark, folder, "events").select((F.floor(F.col("event_id") / 2)).alias("key"), "event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("p.k").alias("k"), (F.count("*") - F.countDistinct("key")).alias("duplicates"))


@register("union_of_columns", """SELECT l_returnflag AS flag, count(*) AS rows, count(extra) AS with_extra, count(ranked) AS with_ranked, min(nested) AS nested FROM (
  SELECT l_returnflag, l_linenumber AS extra, NULL AS ranked, '{"a":' || l_linenumber || ',"b":[1,2]}' AS nested FROM lineitem UNION ALL SELECT l_returnflag, NULL, l_suppkey, NULL FROM lineitem) GROUP BY 1""")
def union_of_columns(spark, folder):
    """The table a CSV sink would write: union of columns, nested values as JSON."""
    line = table(spark, folder, "lineitem")
    a = line.select("l_returnflag", F.col("l_linenumber").alias("extra"), F.struct(F.col("l_linenumber").alias("a"), F.array(F.lit(1), F.lit(2)).alias("b")).alias("nested"))
    b = line.select("l_returnflag", F.col("l_suppkey").alias("ranked"))
    flat = tables.flat_columns(tables.union_tables([a, b]))
    return flat.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("rows"), F.count("extra").alias("with_extra"), F.count("ranked").alias("with_ranked"), F.min("nested").alias("nested")
    )


@register("content_hashes", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hashes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", H.content_hash(F.col("text")).alias("digest"))


@register("row_ids", """SELECT o_orderkey, substr(sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 24) AS row_id,
  substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}'), 1, 32) AS json_id FROM orders""")
def row_ids(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        "o_orderkey", H.row_id([F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")]).alias("row_id"), H.json_id(["o_orderpriority", "o_custkey"], 32).alias("json_id")
    )


@register("payload_digests", with_sql(PX, CELLS, """lanes AS (SELECT unit_id, sha256(pos || '|' || coalesce(CAST(label AS VARCHAR), '\\N') || '|' || CAST(support AS VARCHAR)) AS d FROM cells)""",
  body="SELECT unit_id, count(*) AS pixels, bit_xor(('0x' || substr(d, 1, 15))::BIGINT) AS digest_a, bit_xor(('0x' || substr(d, 16, 15))::BIGINT) AS digest_b FROM lanes GROUP BY 1"))
def payload_digests(spark, folder):
    """Equal digests prove that two units share labels and support."""
    return cells(spark, folder).groupBy("unit_id").agg(F.count("*").alias("pixels"), *H.set_digest([F.col("pos"), F.col("label"), F.col("support")]))


# --- cleaning ----------------------------------------------------------------

def annotations(spark, folder):
    line = table(spark, folder, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("annotation_id"), F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("category_id"),
        F.when(F.col("l_tax") > 0.01, F.col("l_quantity") - 2).alias("area"),
    )


def categories(spark, folder):
    return table(spark, folder, "region").select((F.col("r_regionkey") + 1).alias("category_id"), F.col("r_name").alias("category_name"))


NOTES = """notes AS (SELECT l_orderkey * 10 + l_linenumber AS annotation_id, l_partkey AS image_id, l_linenumber AS category_id, CASE WHEN l_tax > 0.01 THEN l_quantity - 2 END AS area FROM lineitem),
  cats AS (SELECT r_regionkey + 1 AS category_id, r_name AS category_name FROM region)"""


@register("rejected_annotations", with_sql(IMAGES, NOTES, body="""SELECT category_name, count(*) AS rejected, count(file_name) AS with_image, round(sum(area), 6) AS area
  FROM notes LEFT JOIN images USING (image_id) LEFT JOIN cats USING (category_id) WHERE area <= 0 GROUP BY 1"""))
def rejected_annotations(spark, folder):
    rows = C.rejected_annotations(annotations(spark, folder), images(spark, folder), categories(spark, folder))
    return rows.groupBy("category_name").agg(F.count("*").alias("rejected"), F.count("file_name").alias("with_image"), rounded(F.sum("area"), 6).alias("area"))


_NORM = "regexp_replace(file_name, '^[0-9a-fA-F]{8}-', '')"
_STEM = f"regexp_replace({_NORM}, '\\.[^.]*$', '')"
_VIEW = f"nullif(regexp_extract({_STEM}, '^(.+)_((?:19|20)\\d{{2}})$', 1), '')"
_YEAR = f"CAST(coalesce(nullif(regexp_extract({_STEM}, '^(.+)_((?:19|20)\\d{{2}})$', 2), ''), nullif(regexp_extract({_STEM}, '^.+_((?:19|20)\\d{{2}})_v\\d+$', 1, 'i'), '')) AS INTEGER)"


@register("normalized_names", with_sql(IMAGES, body=f"SELECT image_id, {_NORM} AS name FROM images"))
def normalized_names(spark, folder):
    return images(spark, folder).select("image_id", N.normalized_name(F.col("file_name")).alias("name"))


@register("filename_metadata", with_sql(IMAGES, body=f"SELECT image_id, {_VIEW} AS view_id, {_YEAR} AS year FROM images"))
def filename_metadata(spark, folder):
    name = F.col("file_name")
    return images(spark, folder).select("image_id", N.view_from_name(name).alias("view_id"), N.year_from_name(name).alias("year"))


def rename_maps(spark, folder):
    """Chains of eight names; every tenth group closes into a cycle, other names stay."""
    k = F.col("o_orderkey")
    target = F.when(k % 9 < 7, k + 1).when(k % 90 == 7, k - 7).otherwise(k)
    text = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return table(spark, folder, "orders").select(text(k).alias("old_name"), text(target).alias("new_name"))


MAPS = """maps AS (SELECT 'n' || o_orderkey AS old_name, 'n' || CASE WHEN o_orderkey % 9 < 7 THEN o_orderkey + 1 WHEN o_orderkey % 90 = 7 THEN o_orderkey - 7 ELSE o_orderkey END AS new_name FROM orders)"""


@register("rename_closure", with_sql("RECURSIVE " + MAPS, "names AS (SELECT old_name AS name FROM maps UNION SELECT new_name FROM maps)",
  "walk AS (SELECT name, name AS cur, 0 AS d FROM names UNION ALL SELECT w.name, m.new_name, d + 1 FROM walk w JOIN maps m ON m.old_name = w.cur AND m.old_name <> m.new_name WHERE d < 12)",
  body="SELECT name, CASE WHEN max(d) < 12 THEN max_by(cur, d) END AS final_name, max(d) >= 12 AS in_cycle FROM walk GROUP BY 1"))
def rename_closure(spark, folder):
    return C.rename_closure(rename_maps(spark, folder))


@register("rename_conflicts", with_sql(MAPS, "more AS (SELECT * FROM maps UNION SELECT old_name, 'x' || old_name FROM maps WHERE old_name LIKE '%5' UNION SELECT 'y' || old_name, new_name FROM maps WHERE old_name LIKE '%3')",
  body="""SELECT old_name AS name, 'conflicting_source' AS problem FROM more GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT new_name, 'conflicting_target' FROM more GROUP BY 1 HAVING count(*) > 1"""))
def rename_conflicts(spark, folder):
    base = rename_maps(spark, folder)
    forked = base.filter("old_name LIKE '%5'").withColumn("new_name", F.concat(F.lit("x"), "old_name"))
    merged = base.filter("old_name LIKE '%3'").withColumn("old_name", F.concat(F.lit("y"), "old_name"))
    return C.rename_problems(base.unionByName(forked).unionByName(merged))


def candidate_paths(rows):
    name, k = F.col("file_name"), F.col("image_id")
    bare = F.substring(name, 10, 200)
    main = (
        F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(F.lit("dir_a/"), name)).when(k % 6 == 2, F.concat(F.lit("dir_b/renamed_"), k.cast("string"), F.lit(".jpg")))
        .when(k % 6 == 3, F.concat(F.lit("dir_c/deadbeef-"), bare)).when(k % 6 == 4, F.concat(F.lit("dir_d/"), F.upper(bare)))
    )
    more = F.when(k % 24 == 1, F.concat(F.lit("dir_e/"), name))
    return rows.select(F.explode(F.array_compact(F.array(main, more))).alias("path"))


@register("resolved_files", with_sql(IMAGES, """cand AS (SELECT DISTINCT path FROM (SELECT CASE image_id % 6 WHEN 0 THEN file_name WHEN 1 THEN 'dir_a/' || file_name WHEN 2 THEN 'dir_b/renamed_' || image_id || '.jpg'
    WHEN 3 THEN 'dir_c/deadbeef-' || substr(file_name, 10) WHEN 4 THEN 'dir_d/' || upper(substr(file_name, 10)) END AS path FROM images UNION ALL SELECT 'dir_e/' || file_name FROM images WHERE image_id % 24 = 1) WHERE path IS NOT NULL)""",
  """ren AS (SELECT file_name AS name, min('renamed_' || image_id || '.jpg') AS final_name FROM images WHERE image_id % 6 = 2 GROUP BY 1)""",
  """keys AS (SELECT path, unnest([0, 1, 2, 3, 4]) AS stage, unnest([path, b, b, n, lower(n)]) AS key FROM (SELECT path, b, regexp_replace(b, '^[0-9a-fA-F]{8}-', '') AS n FROM (SELECT path, regexp_replace(path, '^.*/', '') AS b FROM cand)))""",
  f"""want AS (SELECT DISTINCT image_id, stage, key FROM (SELECT image_id, unnest([0, 1, 2, 3, 4, 3, 4]) AS stage, unnest([file_name, file_name, final_name, {_NORM}, lower({_NORM}), final_name, lower(final_name)]) AS key FROM images LEFT JOIN ren ON name = file_name) WHERE key IS NOT NULL)""",
  """hits AS (SELECT image_id, stage, min(path) AS p, count(DISTINCT path) AS n FROM want JOIN keys USING (stage, key) GROUP BY 1, 2)""",
  """best AS (SELECT image_id, min_by(p, stage) AS p, min_by(n, stage) AS n, min(stage) AS stage FROM hits GROUP BY 1)""",
  body="""SELECT image_id, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n IS NULL THEN 'not_found' ELSE CASE WHEN n > 1 THEN 'ambiguous_' ELSE '' END || ['explicit_path', 'exact_basename', 'rename_map', 'stripped_prefix', 'casefold'][stage + 1] END AS rule FROM images LEFT JOIN best USING (image_id)"""))
def resolved_files(spark, folder):
    rows = manifest(spark, folder)
    renames = rows.filter("image_id % 6 = 2").groupBy(F.col("file_name").alias("name")).agg(F.min(F.concat(F.lit("renamed_"), F.col("image_id").cast("string"), F.lit(".jpg"))).alias("final_name"))
    return C.resolve(rows, candidate_paths(rows), renames)


_ALIASED = """maps AS (SELECT file_name AS old, 'mid_' || image_id || '.jpg' AS new FROM images WHERE image_id % 6 = 2 UNION ALL SELECT 'mid_' || image_id || '.jpg', 'dir_b/renamed_' || image_id || '.jpg' FROM images WHERE image_id % 6 = 2),
  good AS (SELECT DISTINCT file_name AS name, min(image_id) AS k FROM images WHERE image_id % 6 = 2 GROUP BY 1 HAVING count(*) = 1),
  members AS (SELECT DISTINCT name, 'dir_b/renamed_' || k || '.jpg' AS cls FROM (SELECT name, k FROM good UNION ALL SELECT unnest(['mid_' || image_id || '.jpg', 'dir_b/renamed_' || image_id || '.jpg']), image_id FROM images WHERE image_id % 6 = 2)),
  files AS (SELECT DISTINCT path FROM (SELECT CASE image_id % 12 WHEN 0 THEN file_name WHEN 1 THEN 'dir_a/' || file_name WHEN 2 THEN 'dir_b/renamed_' || image_id || '.jpg' WHEN 8 THEN 'dir_f/mid_' || image_id || '.jpg' WHEN 3 THEN 'dir_c/deadbeef-' || substr(file_name, 10)
    WHEN 4 THEN 'dir_d/' || upper(substr(file_name, 10)) WHEN 5 THEN 'dir_z/renamed_' || (image_id - 3) || '.jpg' END AS path FROM images) WHERE path IS NOT NULL),
  asked AS (SELECT image_id, CASE image_id % 24 WHEN 2 THEN 'mid_' || image_id || '.jpg' WHEN 8 THEN 'cafef00d-' || substr(file_name, 10) WHEN 14 THEN 'renamed_' || image_id || '.jpg' ELSE file_name END AS file_name FROM images)"""
_BARE = "regexp_replace(regexp_replace({0}, '^.*/', ''), '^[0-9a-fA-F]{{8}}-', '')"
_PLACED = "regexp_extract({0}, '^(.*/)?') || " + _BARE


@register("alias_resolved_files", with_sql(IMAGES, _ALIASED, f"""idx AS (SELECT path, unnest([0, 1, 2, 2, 3, 3, 4, 4]) AS stage, unnest([path, regexp_replace(path, '^.*/', ''), 'b:' || regexp_replace(path, '^.*/', ''), 'r:' || path, 'b:' || {_BARE.format('path')}, 'r:' || {_PLACED.format('path')},
    'b:' || lower({_BARE.format('path')}), 'r:' || lower({_PLACED.format('path')})]) AS key FROM files)""",
  f"""al AS (SELECT cls, unnest([2, 3, 4]) AS stage, unnest(CASE WHEN contains(name, '/') THEN ['r:' || name, 'r:' || {_PLACED.format('name')}, 'r:' || lower({_PLACED.format('name')})] ELSE ['b:' || name, 'b:' || {_BARE.format('name')}, 'b:' || lower({_BARE.format('name')})] END) AS key FROM members),
  c0 AS (SELECT image_id, count(DISTINCT cls) AS n, min(cls) AS cls FROM asked JOIN members ON name = file_name GROUP BY 1),
  c1 AS (SELECT image_id, count(DISTINCT cls) AS n, min(cls) AS cls FROM asked JOIN members ON regexp_replace(name, '^.*/', '') = regexp_replace(file_name, '^.*/', '') GROUP BY 1),
  c2 AS (SELECT image_id, count(DISTINCT cls) AS n, min(cls) AS cls FROM asked JOIN members ON {_BARE.format('name')} = {_BARE.format('file_name')} GROUP BY 1),
  cl AS (SELECT image_id, coalesce(c0.n, c1.n, c2.n) AS n, CASE WHEN c0.n IS NOT NULL THEN c0.cls WHEN c1.n IS NOT NULL THEN c1.cls ELSE c2.cls END AS cls FROM asked LEFT JOIN c0 USING (image_id) LEFT JOIN c1 USING (image_id) LEFT JOIN c2 USING (image_id)),
  own AS (SELECT image_id, unnest([0, 1, 3, 4]) AS stage, unnest([file_name, regexp_replace(file_name, '^.*/', ''), 'b:' || {_BARE.format('file_name')}, 'b:' || lower({_BARE.format('file_name')})]) AS key FROM asked),
  hits AS (SELECT image_id, stage, path FROM own JOIN idx USING (stage, key) UNION SELECT image_id, stage, path FROM cl JOIN al USING (cls) JOIN idx USING (stage, key) WHERE n = 1 UNION SELECT image_id, 2, unnest(['', 'several']) FROM cl WHERE n > 1),
  best AS (SELECT image_id, stage, min(path) AS p, count(DISTINCT path) AS n FROM hits GROUP BY 1, 2 QUALIFY stage = min(stage) OVER (PARTITION BY image_id))""",
  body="""SELECT image_id, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n IS NULL THEN 'not_found' ELSE CASE WHEN n > 1 THEN 'ambiguous_' ELSE '' END || ['explicit_path', 'exact_basename', 'rename_map', 'stripped_prefix', 'casefold'][stage + 1] END AS rule FROM images LEFT JOIN best USING (image_id)"""))
def alias_resolved_files(spark, folder):
    """Chains of two renames: images ask by the first, a middle, a re-prefixed or a folderless last name; files carry a middle or the last one."""
    rows, k, name = manifest(spark, folder), F.col("image_id"), F.col("file_name")
    number, bare = k.cast("string"), F.substring("file_name", 10, 200)
    jpg = lambda start, n=number: F.concat(F.lit(start), n, F.lit(".jpg"))
    steps = F.array(F.struct(name.alias("old_name"), jpg("mid_").alias("new_name")), F.struct(jpg("mid_").alias("old_name"), jpg("dir_b/renamed_").alias("new_name")))
    maps = rows.filter(k % 6 == 2).select(F.inline(steps))
    place = (
        F.when(k % 12 == 0, name).when(k % 12 == 1, F.concat(F.lit("dir_a/"), name)).when(k % 12 == 2, jpg("dir_b/renamed_")).when(k % 12 == 8, jpg("dir_f/mid_"))
        .when(k % 12 == 3, F.concat(F.lit("dir_c/deadbeef-"), bare)).when(k % 12 == 4, F.concat(F.lit("dir_d/"), F.upper(bare))).when(k % 12 == 5, jpg("dir_z/renamed_", (k - 3).cast("string")))
    )
    files = rows.select(place.alias("path")).filter("path IS NOT NULL").distinct()
    asked = rows.select("image_id", F.when(k % 24 == 2, jpg("mid_")).when(k % 24 == 8, F.concat(F.lit("cafef00d-"), bare)).when(k % 24 == 14, jpg("renamed_")).otherwise(name).alias("file_name"))
    return C.resolve_aliases(asked, files, C.rename_closure(maps))


@register("applied_rules", with_sql(IMAGES, f"named AS (SELECT *, {_NORM} AS nm, {_VIEW} AS vw, {_YEAR} AS yr FROM images)",
  "vr AS (SELECT DISTINCT vw AS view_id, 'B_' || vw AS building_id FROM named WHERE vw LIKE '%en'), fr AS (SELECT nm, min(image_id) AS k FROM named WHERE image_id % 10 = 3 GROUP BY 1)",
  body="""SELECT image_id, CASE WHEN image_id % 15 = 0 THEN NULL WHEN fr.k IS NOT NULL THEN 'fr_' || fr.k ELSE vr.view_id END AS view_id,
  CASE WHEN image_id % 15 = 0 THEN 'O' WHEN fr.k IS NOT NULL THEN 'F' ELSE vr.building_id END AS building_id,
  CASE WHEN image_id % 15 = 0 THEN 1999 WHEN fr.k IS NOT NULL THEN CASE WHEN fr.k % 20 = 3 THEN NULL ELSE yr END WHEN vr.view_id IS NOT NULL THEN yr END AS year,
  CASE WHEN image_id % 15 = 0 THEN 'override_csv' WHEN fr.k IS NOT NULL THEN 'filename_rules' WHEN vr.view_id IS NOT NULL THEN 'view_rules' END AS source
  FROM named LEFT JOIN vr ON vr.view_id = vw LEFT JOIN fr ON fr.nm = named.nm"""))
def applied_rules(spark, folder):
    rows = manifest(spark, folder)
    named = rows.select("image_id", N.normalized_name(F.col("file_name")).alias("file_name"), N.view_from_name(F.col("file_name")).alias("view_id"))
    views = named.filter("view_id LIKE '%en'").select("view_id").distinct().withColumn("building_id", F.concat(F.lit("B_"), "view_id"))
    files = named.filter("image_id % 10 = 3").groupBy("file_name").agg(F.min("image_id").alias("k")).select(
        "file_name", F.concat(F.lit("fr_"), F.col("k").cast("string")).alias("view_id"), F.lit("F").alias("building_id"), F.lit(None).cast("int").alias("year"), (F.col("k") % 20 == 3).alias("year_given"),
    )
    over = rows.filter("image_id % 15 = 0").select("image_id", F.lit(None).cast("string").alias("view_id"), F.lit("O").alias("building_id"), F.lit(1999).alias("year"))
    return C.apply_rules(rows, views, files, over)


@register("rule_conflicts", with_sql(IMAGES, body=f"SELECT view_id, count(DISTINCT b) AS buildings FROM (SELECT {_VIEW} AS view_id, CASE WHEN image_id % 40 = 7 THEN 'moved' ELSE building_id END AS b FROM images) WHERE view_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT b) > 1"))
def rule_conflicts(spark, folder):
    """Views that their images give to several buildings; every fortieth image names another one."""
    building = F.when(F.col("image_id") % 40 == 7, "moved").otherwise(F.col("building_id"))
    rows = manifest(spark, folder).select(N.view_from_name(F.col("file_name")).alias("view_id"), building.alias("building_id")).filter("view_id IS NOT NULL")
    return C.rule_conflicts(rows)


@register("confirmed_fixes", with_sql(IMAGES, f"fixes AS (SELECT {_NORM} AS name, building_id, year FROM images WHERE image_id % 7 = 0 UNION ALL SELECT 'zzz' || image_id, building_id, year FROM images WHERE image_id % 49 = 0)",
  f"nm AS (SELECT {_NORM} AS name, count(*) AS n, min(image_id) AS image_id FROM images GROUP BY 1)",
  body="""SELECT name, status, CASE WHEN status = 'confirmed' THEN image_id END AS image_id, building_id, year FROM (SELECT f.*, n.image_id,
  CASE WHEN k > 1 THEN 'duplicate_fix' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'confirmed' END AS status
  FROM (SELECT name, count(*) AS k, min(building_id) AS building_id, min(year) AS year FROM fixes GROUP BY 1) f LEFT JOIN nm n USING (name))"""))
def confirmed_fixes(spark, folder):
    rows = manifest(spark, folder)
    fixes = rows.filter("image_id % 7 = 0").select("file_name", "building_id", "year")
    ghosts = rows.filter("image_id % 49 = 0").select(F.concat(F.lit("zzz"), F.col("image_id").cast("string")).alias("file_name"), "building_id", "year")
    return C.confirmed_rows(rows, fixes.unionByName(ghosts))


def previous_images(spark, folder):
    k = F.col("image_id")
    return images(spark, folder).filter("image_id % 4 != 3").select(
        (k + 1000000).alias("image_id"), "file_name", F.when(k % 11 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(k % 5 == 0, F.col("width") + 1).otherwise(F.col("width")).alias("width"), "height", "metadata_status", "building_id", "image_status",
    )


@register("reused_inventory", with_sql(IMAGES, f"cur AS (SELECT *, {_NORM} AS nm FROM images)",
  "prev AS (SELECT nm, count(*) AS n, min(image_id) AS pid, min(CASE WHEN image_id % 11 = 0 THEN 'x' ELSE sha256 END) AS sha, min(CASE WHEN image_id % 5 = 0 THEN width + 1 ELSE width END) AS w, min(height) AS h, min(metadata_status) AS ms, min(building_id) AS b, min(image_status) AS st FROM cur WHERE image_id % 4 <> 3 GROUP BY 1 HAVING count(*) = 1)",
  body="""SELECT image_id, CASE WHEN same THEN 'reused' ELSE 'decoded' END AS validation, CASE WHEN same AND ms = 'reviewed' THEN pid + 1000000 END AS inherited_from, CASE WHEN same AND ms = 'reviewed' THEN b END AS inherited_building FROM (
  SELECT c.*, p.*, coalesce(count(*) OVER (PARTITION BY c.nm) = 1 AND p.sha = c.sha256 AND p.w = c.width AND p.h = c.height AND p.st = 'ready', false) AS same FROM cur c LEFT JOIN prev p ON p.nm = c.nm)"""))
def reused_inventory(spark, folder):
    return C.reuse_inventory(images(spark, folder), previous_images(spark, folder))


@register("duplicate_paths", with_sql(IMAGES, body=f"SELECT image_id, count(*) OVER (PARTITION BY p) AS shared_by FROM (SELECT image_id, {_NORM} AS p FROM images) QUALIFY shared_by > 1"))
def duplicate_paths(spark, folder):
    rows = images(spark, folder).select("image_id", N.normalized_name(F.col("file_name")).alias("path"))
    return C.duplicate_paths(rows).select("image_id", "shared_by")


@register("integrity_report", with_sql(IMAGES, NOTES, body="""SELECT item, count(*) AS rows FROM (SELECT 'orphan_annotation' AS item FROM notes ANTI JOIN images USING (image_id)
  UNION ALL SELECT 'unknown_category' FROM notes ANTI JOIN cats USING (category_id) UNION ALL SELECT 'nonpositive_area' FROM notes WHERE area <= 0
  UNION ALL SELECT 'image_' || image_status FROM images UNION ALL SELECT 'metadata_' || metadata_status FROM images) GROUP BY 1"""))
def integrity_report(spark, folder):
    return C.integrity_report(images(spark, folder), annotations(spark, folder), categories(spark, folder))


ELIGIBLE = """elig AS (SELECT *, list_filter([CASE WHEN image_status <> 'ready' THEN 'image_' || image_status END, CASE WHEN sha256 IS NULL THEN 'missing_image_hash' END,
  CASE WHEN metadata_status <> 'reviewed' THEN 'metadata_not_reviewed' END, CASE WHEN building_id IS NULL THEN 'unknown_building' END], lambda r: r IS NOT NULL) AS reasons,
  list_filter([CASE WHEN image_status <> 'ready' THEN 'image_' || image_status END, CASE WHEN metadata_status <> 'reviewed' THEN 'metadata_not_reviewed' END, CASE WHEN building_id IS NULL THEN 'unknown_building' END,
  CASE WHEN view_id IS NULL THEN 'unknown_view' END, CASE WHEN year IS NULL THEN 'unknown_or_invalid_year' END], lambda r: r IS NOT NULL) AS temporal_reasons FROM images),
  ok AS (SELECT *, len(reasons) = 0 AS semantic_eligible, len(temporal_reasons) = 0 AS temporal_eligible FROM elig)"""


def manifest(spark, folder):
    """The manifest written once, for queries that read it several times: hashing texts is the costly part."""
    return cut_lineage(images(spark, folder))


def eligible(spark, folder, rows=None):
    return C.eligibility(images(spark, folder) if rows is None else rows)


def temporal(spark, folder, rows=None):
    return eligible(spark, folder, rows).filter("temporal_eligible")


@register("eligibility_reasons", with_sql(IMAGES, ELIGIBLE, body="SELECT image_id, array_to_string(reasons, ';') AS reasons, array_to_string(temporal_reasons, ';') AS temporal_reasons, semantic_eligible, temporal_eligible FROM ok"))
def eligibility_reasons(spark, folder):
    return eligible(spark, folder).select(
        "image_id", F.array_join("reasons", ";").alias("reasons"), F.array_join("temporal_reasons", ";").alias("temporal_reasons"), "semantic_eligible", "temporal_eligible"
    )


@register("exclusion_histogram", with_sql(IMAGES, ELIGIBLE, body="SELECT reason, count(*) AS rows FROM (SELECT unnest(temporal_reasons) AS reason FROM ok) GROUP BY 1"))
def exclusion_histogram(spark, folder):
    return C.reason_histogram(eligible(spark, folder), "temporal_reasons")


def street_views(spark, folder):
    """View names with house numbers and detail tokens, from customers."""
    k = F.col("c_custkey")
    name = F.concat(
        F.lit("street_"), (k % 20).cast("string"), F.when(k % 11 == 0, "_full_").otherwise("_"), (k % 97).cast("string"),
        F.when(k % 3 == 0, F.concat(F.lit("-"), (k % 97 + k % 5).cast("string"))).otherwise(""), F.when(k % 7 == 0, "_roof").when(k % 7 == 1, "_balconyv2_left").otherwise(""),
    )
    return table(spark, folder, "customer").select("c_custkey", F.when(k % 50 == 0, "park_top").otherwise(name).alias("view_id"))


STREETS = """streets AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'park_top' ELSE 'street_' || (c_custkey % 20) || CASE WHEN c_custkey % 11 = 0 THEN '_full_' ELSE '_' END || (c_custkey % 97) ||
  CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 97 + c_custkey % 5) ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '_roof' WHEN c_custkey % 7 = 1 THEN '_balconyv2_left' ELSE '' END END AS view_id FROM customer)"""


@register("proposed_buildings", with_sql(STREETS, body="SELECT c_custkey, CASE WHEN view_id <> 'park_top' THEN regexp_replace(regexp_replace(view_id, '_full_', '_'), '_roof|_balconyv2_left', '') END AS building_id FROM streets"))
def proposed_buildings(spark, folder):
    return street_views(spark, folder).select("c_custkey", N.proposed_building(F.col("view_id")).alias("building_id"))


@register("building_review", with_sql(IMAGES, """r AS (SELECT *, CASE WHEN metadata_status = 'reviewed' THEN building_id END AS c FROM images WHERE image_status = 'ready' AND view_id IS NOT NULL AND year IS NOT NULL)""",
  body="""SELECT address, CASE WHEN confirmed_buildings = 1 THEN b ELSE p END AS building_id, images, views, years, confirmed_buildings = 1 AND every AS reviewed,
  CASE WHEN confirmed_buildings > 1 THEN 'conflicting_confirmed' WHEN p IS NULL AND confirmed_buildings = 0 THEN 'no_house_number' END AS note FROM (
  SELECT lower(coalesce(c, view_id)) AS address, count(*) AS images, count(DISTINCT view_id) AS views, count(DISTINCT c) AS confirmed_buildings, min(c) AS b, min(view_id) AS p,
    string_agg(DISTINCT CAST(year AS VARCHAR), ';' ORDER BY CAST(year AS VARCHAR)) AS years, bool_and(c IS NOT NULL) AS every FROM r GROUP BY 1)"""))
def building_review(spark, folder):
    return C.building_review(images(spark, folder)).select("address", "building_id", "images", "views", "years", "reviewed", "note")


@register("group_review", with_sql(IMAGES, body="SELECT view_id, count(*) AS images, count(DISTINCT building_id) AS buildings, min(building_id) AS first_building, bool_and(metadata_status = 'reviewed') AS all_reviewed FROM images WHERE view_id IS NOT NULL GROUP BY 1"))
def group_review(spark, folder):
    return C.group_review(images(spark, folder))


ANCHORED = f"""anchor AS (SELECT view_id, min_by(image_id, k) AS reference_id, min_by(year, k) AS reference_year, min_by(coalesce(building_id, ''), k) AS rb, min_by(split, k) AS rs, min_by(sha256, k) AS rsha FROM (
    SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY year, {_NORM}, sha256, image_id) AS k FROM ok WHERE temporal_eligible) GROUP BY 1),
  pairs AS (SELECT reference_id || '-' || image_id AS pair_id, reference_id, image_id AS source_id, reference_year, year AS source_year, view_id, rb AS building_id, rs AS split,
    CASE WHEN rb <> coalesce(building_id, '') THEN 'conflicting_or_partial_building' WHEN rs <> split THEN 'different_partitions' WHEN rsha = sha256 THEN 'identical_bytes' END AS reason
    FROM ok JOIN anchor USING (view_id) WHERE temporal_eligible AND year > reference_year)"""


def anchored(spark, folder, rows=None):
    return P.first_anchor(temporal(spark, folder, rows))


@register("pairing_status", with_sql(IMAGES, ELIGIBLE, ANCHORED, """used AS (SELECT id AS image_id, count(*) AS n FROM (SELECT unnest([reference_id, source_id]) AS id FROM pairs WHERE reason IS NULL) GROUP BY 1),
  yrs AS (SELECT view_id, count(DISTINCT year) AS y FROM ok WHERE temporal_eligible GROUP BY 1)""", body="""SELECT image_id, coalesce(n, 0) AS pair_count,
  CASE WHEN NOT temporal_eligible THEN 'unresolved' WHEN n > 0 THEN 'pair_candidate' WHEN y = 1 THEN 'single_year_view' ELSE 'eligible_without_pair' END AS status FROM ok LEFT JOIN used USING (image_id) LEFT JOIN yrs USING (view_id)"""))
def pairing_status(spark, folder):
    rows = manifest(spark, folder)
    return C.pairing_status(eligible(spark, folder, rows), anchored(spark, folder, rows).filter("reason IS NULL"))


@register("class_coverage", with_sql(IMAGES, NOTES, body="""SELECT s.split, c.category_id, coalesce(n, 0) AS annotations, coalesce(i, 0) AS images, coalesce(b, 0) AS buildings, coalesce(n, 0) = 0 AS missing
  FROM cats c CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN (SELECT split, category_id, count(*) AS n, count(DISTINCT image_id) AS i,
  count(DISTINCT CASE WHEN metadata_status = 'reviewed' THEN building_id END) AS b FROM notes JOIN images USING (image_id) GROUP BY 1, 2) r ON r.split = s.split AND r.category_id = c.category_id"""))
def class_coverage(spark, folder):
    return C.class_coverage(images(spark, folder), annotations(spark, folder), categories(spark, folder))


# --- ownership and leakage ---------------------------------------------------

@register("series_classes", with_sql(IMAGES, body="""SELECT building_id, longest, incomplete, images, CASE WHEN incomplete > 0 THEN 'unknown' WHEN longest <= 2 THEN 'short' WHEN longest <= 7 THEN 'medium' ELSE 'long' END AS series FROM (
  SELECT building_id, max(y) AS longest, CAST(sum(bad) AS BIGINT) AS incomplete, CAST(sum(n) AS BIGINT) AS images FROM (SELECT building_id, view_id, count(DISTINCT year) FILTER (WHERE view_id IS NOT NULL) AS y,
  count(*) FILTER (WHERE view_id IS NULL OR year IS NULL) AS bad, count(*) AS n FROM images WHERE building_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""))
def series_classes(spark, folder):
    return S.series_class(images(spark, folder).filter("building_id IS NOT NULL"))


FRACTIONS = {"train": 0.7, "val": 0.1, "test": 0.2}


def sequence_weights(spark, folder):
    """Customers as buildings weighted by orders; every ninth has a fixed owner."""
    o = table(spark, folder, "orders")
    weights = o.groupBy(F.col("o_custkey").alias("building_id")).agg(F.count("*").cast("double").alias("weight"))
    k = F.col("building_id")
    fixed = weights.filter("building_id % 9 = 0").select("building_id", F.when(k % 2 == 0, "test").otherwise("train").alias("split"))
    return weights, fixed


_WEIGHTS = """w AS (SELECT o_custkey AS building_id, CAST(count(*) AS DOUBLE) AS weight, CASE WHEN o_custkey % 9 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'test' ELSE 'train' END END AS fx FROM orders GROUP BY 1)"""


@register("assigned_split", with_sql(_WEIGHTS, """q AS (SELECT greatest(0, sum(weight) * 0.2::DOUBLE - coalesce(sum(weight) FILTER (WHERE fx = 'test'), 0)) AS t, greatest(0, sum(weight) * 0.1::DOUBLE - coalesce(sum(weight) FILTER (WHERE fx = 'val'), 0)) AS v FROM w),
  r AS (SELECT *, sum(weight) OVER (ORDER BY sha256('42/' || building_id) ROWS UNBOUNDED PRECEDING) - weight AS before FROM w WHERE fx IS NULL)""",
  body="SELECT building_id, weight, CASE WHEN before < t THEN 'test' WHEN before < t + v THEN 'val' ELSE 'train' END AS split FROM r, q UNION ALL SELECT building_id, weight, fx FROM w WHERE fx IS NOT NULL"))
def assigned_split(spark, folder):
    return S.assign_split(*sequence_weights(spark, folder), FRACTIONS)


@register("balanced_split", with_sql(_WEIGHTS, body="SELECT count(*) AS buildings, CAST(sum(weight) AS BIGINT) AS weight, count(fx) AS kept_owners, true AS not_above_hash_order, true AS within_one, 3 AS splits FROM w"))
def balanced_split(spark, folder):
    """The searched split against the constraints: owners stay, the squared deviation never exceeds that of the hash order, and with these weights no split is off by one."""
    buildings, fixed = sequence_weights(spark, folder)
    searched = stored(S.balanced_split(buildings, fixed, FRACTIONS), "balanced")
    kept = searched.join(fixed.withColumnRenamed("split", "_own"), "building_id", "left")
    apart = lambda rows: S.squared_deviation(rows, FRACTIONS)
    sums = searched.groupBy("split").agg(F.sum("weight").alias("w"))
    whole = sums.agg(F.sum("w")).scalar()
    off = reduce(lambda acc, s: acc.when(F.col("split") == s, FRACTIONS[s]), list(FRACTIONS)[1:], F.when(F.col("split") == list(FRACTIONS)[0], FRACTIONS[list(FRACTIONS)[0]]))
    gaps = sums.agg(F.max(F.abs(F.col("w") - off * whole)).alias("gap"), F.count("*").cast("int").alias("n"))
    return kept.agg(
        F.count("*").alias("buildings"), F.sum("weight").cast("long").alias("weight"), F.count_if(F.col("_own") == F.col("split")).alias("kept_owners"),
        F.lit(apart(searched) <= apart(S.assign_split(buildings, fixed, FRACTIONS))).alias("not_above_hash_order"),
    ).withColumn("within_one", gaps.select(F.col("gap") < 1).scalar()).withColumn("splits", gaps.select("n").scalar())


def order_series(spark, folder):
    """Customers as buildings, order priority as view, order year as year."""
    o = table(spark, folder, "orders")
    return S.series_class(o.select(F.col("o_custkey").alias("building_id"), F.col("o_orderpriority").alias("view_id"), F.year("o_orderdate").alias("year")))


_SERIES = """ser AS (SELECT building_id, CASE WHEN max(y) <= 2 THEN 'short' WHEN max(y) <= 7 THEN 'medium' ELSE 'long' END AS series, CASE WHEN building_id % 9 = 0 THEN CASE WHEN building_id % 2 = 0 THEN 'test' ELSE 'train' END END AS fx
  FROM (SELECT o_custkey AS building_id, o_orderpriority, count(DISTINCT year(o_orderdate)) AS y FROM orders GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT greatest(0, round(count(*) * 0.2::DOUBLE) - count(*) FILTER (WHERE fx = 'test')) AS t, greatest(0, round(count(*) * 0.1::DOUBLE) - count(*) FILTER (WHERE fx = 'val')) AS v,
    greatest(0, count(*) FILTER (WHERE fx IS NULL AND series = 'medium') - 1) AS u FROM ser),
  con AS (SELECT building_id, series, CASE WHEN r <= least(t, u) THEN 'test' WHEN r <= least(t + v, u) THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY sha256('42/' || building_id)) AS r FROM ser WHERE fx IS NULL AND series = 'medium'), g
    UNION ALL SELECT building_id, series, coalesce(fx, 'train') FROM ser WHERE fx IS NOT NULL OR series <> 'medium')"""


@register("constrained_split", with_sql(_SERIES, body="SELECT * FROM con"))
def constrained_split(spark, folder):
    return S.assign_split_constrained(order_series(spark, folder), sequence_weights(spark, folder)[1], FRACTIONS)


@register("split_deficits", with_sql(_SERIES, body="""SELECT *, greatest(0, wanted - actual) AS deficit FROM (SELECT split, CAST(round(n * f) AS BIGINT) AS wanted, actual, medium FROM (SELECT s.split, s.f, (SELECT count(*) FROM con) AS n,
  (SELECT count(*) FROM con WHERE con.split = s.split) AS actual, (SELECT count(*) FROM con WHERE con.split = s.split AND series = 'medium') AS medium FROM (VALUES ('val', 0.1::DOUBLE), ('test', 0.2::DOUBLE)) s(split, f)))"""))
def split_deficits(spark, folder):
    return S.split_deficits(constrained_split(spark, folder), FRACTIONS)


@register("split_balance", with_sql(IMAGES, """p AS (SELECT split, count(*) AS images, CAST(sum(((greatest(0, width - 512) + 447) // 448 + 1) * ((greatest(0, height - 512) + 447) // 448 + 1)) AS BIGINT) AS crops, count(DISTINCT building_id) AS buildings FROM images GROUP BY 1)""",
  body="""SELECT split, images, crops, buildings, round(images / sum(images) OVER (), 9) AS image_fraction, round(crops / sum(crops) OVER (), 9) AS crop_fraction,
  round(crops / sum(crops) OVER () - CASE split WHEN 'train' THEN 0.7::DOUBLE WHEN 'val' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END, 9) AS crop_deviation FROM p"""))
def split_balance(spark, folder):
    return tidy(S.split_balance(images(spark, folder), FRACTIONS), ("image_fraction", "crop_fraction", "crop_deviation"))


def history(spark, folder, rows=None):
    """An earlier snapshot: a third of the images, some with another owner or no view."""
    k = F.col("image_id")
    return (images(spark, folder) if rows is None else rows).filter("image_id % 3 = 0").select(
        "image_id", "file_name", "sha256", "building_id", F.when(k % 9 != 0, F.col("view_id")).alias("view_id"), "year", F.when(k % 60 == 0, "val").otherwise(F.col("split")).alias("split"), "metadata_status",
    )


HISTORY = """hist AS (SELECT image_id, file_name, sha256, building_id, CASE WHEN image_id % 9 <> 0 THEN view_id END AS view_id, year, CASE WHEN image_id % 60 = 0 THEN 'val' ELSE split END AS split, metadata_status FROM images WHERE image_id % 3 = 0)"""
_IDS = "SELECT {keep}, kind, value FROM (SELECT {keep}, unnest(['building_id', 'view_id', 'sha256']) AS kind, unnest([lower(trim(building_id)), lower(trim(view_id)), sha256]) AS value FROM {src}) WHERE value IS NOT NULL"


@register("inherited_owners", with_sql(IMAGES, HISTORY, f"""own AS ({_IDS.format(keep='split', src='hist')}), claim AS (SELECT DISTINCT b AS building, kind, value FROM (SELECT building_id AS b, * FROM images WHERE image_status = 'ready' AND metadata_status = 'reviewed' AND building_id IS NOT NULL) i,
  LATERAL (SELECT unnest(['building_id', 'view_id', 'sha256']) AS kind, unnest([lower(i.building_id), lower(i.view_id), i.sha256]) AS value) WHERE value IS NOT NULL)""",
  body="""SELECT building AS building_id, CASE WHEN count(DISTINCT split) = 1 THEN min(split) END AS inherited_split, count(DISTINCT split) > 1 AS conflict FROM claim LEFT JOIN own USING (kind, value) GROUP BY 1"""))
def inherited_owners(spark, folder):
    rows = manifest(spark, folder)
    return S.inherit_owner(rows, history(spark, folder, rows))


@register("history_union", with_sql(IMAGES, HISTORY, body="SELECT DISTINCT sha256, split, building_id, view_id, year FROM (SELECT sha256, split, building_id, view_id, year FROM hist UNION ALL SELECT sha256, split, building_id, view_id, year FROM images WHERE image_id % 3 <> 0 OR image_id % 2 = 0)"))
def history_union(spark, folder):
    rows = manifest(spark, folder)
    return S.history_union(history(spark, folder, rows), rows.filter("image_id % 3 != 0 OR image_id % 2 = 0"))


@register("merged_history", with_sql(IMAGES, HISTORY, "u AS (SELECT sha256, split, building_id, view_id, year FROM hist UNION ALL SELECT sha256, split, building_id, view_id, year FROM images WHERE image_id % 3 <> 0 OR image_id % 2 = 0)",
  body="""SELECT sha256, max(building_id) AS building_id, max(split) AS split, max(view_id) AS view_id, max(year) AS year,
  count(DISTINCT coalesce(building_id, '')) > 1 OR count(DISTINCT split) > 1 OR count(DISTINCT view_id) > 1 OR count(DISTINCT year) > 1 AS conflict FROM u GROUP BY 1"""))
def merged_history(spark, folder):
    return S.merge_history(history_union(spark, folder))


@register("frozen_problems", with_sql(IMAGES, HISTORY, f"""old AS (SELECT sha256, max(building_id) AS b, max(view_id) AS v, max(year) AS y, max(split) AS s FROM hist GROUP BY 1),
  cur AS (SELECT * REPLACE (CASE WHEN image_id % 33 = 0 THEN 'changed' || sha256 ELSE sha256 END AS sha256) FROM images)""", body=f"""SELECT problem, count(*) AS rows, count(DISTINCT item) AS items FROM (
  SELECT 'ownership_changed' AS problem, CAST(image_id AS VARCHAR) AS item FROM cur JOIN old USING (sha256) WHERE b IS DISTINCT FROM building_id OR s IS DISTINCT FROM split OR (v IS NOT NULL AND v IS DISTINCT FROM view_id) OR (y IS NOT NULL AND y IS DISTINCT FROM year)
  UNION ALL SELECT 'bytes_changed', CAST(image_id AS VARCHAR) FROM cur WHERE {_NORM} IN (SELECT {_NORM} FROM hist) AND ({_NORM}, sha256) NOT IN (SELECT ({_NORM}, sha256) FROM hist)
  UNION ALL SELECT 'ambiguous_name', n FROM (SELECT {_NORM} AS n, file_name, sha256 FROM cur UNION ALL SELECT {_NORM}, file_name, sha256 FROM hist) GROUP BY n HAVING count(DISTINCT file_name) > 1 AND count(DISTINCT sha256) > 1) GROUP BY 1"""))
def frozen_problems(spark, folder):
    rows = manifest(spark, folder)
    current = rows.withColumn("sha256", F.when(F.col("image_id") % 33 == 0, F.concat(F.lit("changed"), "sha256")).otherwise(F.col("sha256")))
    return S.frozen_problems(current, history(spark, folder, rows)).groupBy("problem").agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items"))


@register("auxiliary_training", with_sql(IMAGES, ELIGIBLE, HISTORY, f"""cand AS (SELECT * FROM ok WHERE image_status = 'ready' AND len(reasons) > 0 AND len(list_filter(reasons, lambda r: r NOT IN ('metadata_not_reviewed', 'unknown_building'))) = 0),
  hold AS (SELECT sha256, view_id, building_id FROM ok WHERE len(reasons) = 0 AND split IN ('val', 'test') UNION ALL SELECT sha256, view_id, building_id FROM hist WHERE split IN ('val', 'test')),
  hit AS (SELECT *, sha256 IN (SELECT sha256 FROM hold) AS h1, coalesce(view_id IN (SELECT view_id FROM hold WHERE view_id IS NOT NULL), false) AS h2, coalesce(building_id IN (SELECT building_id FROM hold WHERE building_id IS NOT NULL), false) AS h3,
    sha256 IN (SELECT sha256 FROM ok WHERE len(reasons) = 0 AND split = 'train') AS tr FROM cand)""",
  body="""SELECT image_id, CASE WHEN h1 OR h2 OR h3 THEN 'known_holdout_overlap:' || concat_ws(',', CASE WHEN h1 THEN 'sha256' END, CASE WHEN h2 THEN 'view_id' END, CASE WHEN h3 THEN 'building_id' END)
  WHEN tr OR image_id <> min(CASE WHEN NOT (h1 OR h2 OR h3 OR tr) THEN image_id END) OVER (PARTITION BY sha256) THEN 'duplicate_train_sha256' ELSE 'included' END AS outcome FROM hit"""))
def auxiliary_training(spark, folder):
    rows = manifest(spark, folder)
    return S.auxiliary_train(eligible(spark, folder, rows), history(spark, folder, rows))


_CROSS = f"""SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS rows FROM ({_IDS.format(keep='split', src='images')}) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1"""
_MANY = "SELECT lower(view_id) AS view_id FROM images WHERE view_id IS NOT NULL AND building_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(building_id)) > 1"


@register("cross_split_identities", with_sql(IMAGES, body=_CROSS))
def cross_split_identities(spark, folder):
    return S.cross_split(images(spark, folder))


@register("partition_problems", with_sql(IMAGES, body=f"""SELECT problem, count(*) AS rows, count(DISTINCT item) AS items FROM (SELECT 'unreviewed' AS problem, CAST(image_id AS VARCHAR) AS item FROM images WHERE metadata_status <> 'reviewed' OR building_id IS NULL
  UNION ALL SELECT 'leak_' || kind, value FROM ({_CROSS}) UNION ALL SELECT 'view_in_many_buildings', view_id FROM ({_MANY})) GROUP BY 1"""))
def partition_problems(spark, folder):
    return S.partition_problems(manifest(spark, folder)).groupBy("problem").agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items"))


def audited(rows):
    """Images with repeated ids and missing hashes."""
    return rows.withColumn("sha256", F.when(F.col("image_id") % 71 != 0, F.col("sha256"))).unionByName(rows.filter("image_id % 97 = 0"))


@register("leakage_audit", with_sql(IMAGES, HISTORY, """aud AS (SELECT * REPLACE (CASE WHEN image_id % 71 <> 0 THEN sha256 END AS sha256) FROM images UNION ALL SELECT * FROM images WHERE image_id % 97 = 0),
  asg AS (SELECT DISTINCT CASE WHEN building_id = 'b7' THEN ' ' ELSE building_id END AS building_id, CASE WHEN building_id = 'b3' THEN 'dev' ELSE split END AS split FROM images WHERE building_id IS NOT NULL),
  every AS (SELECT split, building_id, view_id, sha256 FROM aud UNION ALL SELECT split, building_id, view_id, sha256 FROM hist UNION ALL SELECT split, nullif(trim(building_id), ''), NULL, NULL FROM asg WHERE split IN ('train', 'val', 'test'))""",
  body=f"""SELECT violation, count(*) AS rows, count(DISTINCT item) AS items FROM (SELECT 'duplicate_image_id' AS violation, CAST(image_id AS VARCHAR) AS item FROM aud GROUP BY image_id HAVING count(*) > 1
  UNION ALL SELECT 'missing_sha256', CAST(image_id AS VARCHAR) FROM aud WHERE sha256 IS NULL UNION ALL SELECT 'unreviewed_holdout_image', CAST(image_id AS VARCHAR) FROM aud WHERE split <> 'train' AND (metadata_status <> 'reviewed' OR building_id IS NULL)
  UNION ALL SELECT 'invalid_building_assignment', building_id FROM asg WHERE split NOT IN ('train', 'val', 'test') OR trim(building_id) = ''
  UNION ALL SELECT 'cross_split_identity', kind || '=' || value FROM ({_IDS.format(keep='split', src='every')}) GROUP BY kind, value HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'view_has_multiple_buildings', lower(view_id) FROM every WHERE view_id IS NOT NULL AND building_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT lower(building_id)) > 1) GROUP BY 1"""))
def leakage_audit(spark, folder):
    rows = manifest(spark, folder)
    b = F.col("building_id")
    assigned = rows.filter("building_id IS NOT NULL").select(F.when(b == "b7", " ").otherwise(b).alias("building_id"), F.when(b == "b3", "dev").otherwise(F.col("split")).alias("split")).distinct()
    out = S.leakage_audit(audited(rows), assigned, history(spark, folder, rows))
    return out.groupBy("violation").agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items"))


@register("pair_audit", with_sql(IMAGES, ELIGIBLE, ANCHORED, """ap AS (SELECT pair_id, reference_id, CASE WHEN source_id % 11 = 0 THEN -source_id ELSE source_id END AS source_id, CASE WHEN source_id % 7 = 0 THEN 'val' ELSE split END AS split, building_id, CASE WHEN source_id % 5 = 0 THEN 'other' ELSE view_id END AS view_id FROM pairs),
  j AS (SELECT p.*, r.image_id AS ri, s.image_id AS si, r.split AS rs, s.split AS ss, r.building_id AS rb, s.building_id AS sb, r.view_id AS rv, s.view_id AS sv, r.metadata_status AS rm, s.metadata_status AS sm, r.sha256 AS rh, s.sha256 AS sh,
    r.temporal_eligible AS rt, s.temporal_eligible AS st FROM ap p LEFT JOIN ok r ON r.image_id = p.reference_id LEFT JOIN ok s ON s.image_id = p.source_id)""",
  body="""SELECT violation, count(*) AS pairs FROM (SELECT 'pair_missing_endpoint' AS violation FROM j WHERE ri IS NULL OR si IS NULL UNION ALL SELECT 'pair_split_mismatch' FROM j WHERE ri IS NOT NULL AND si IS NOT NULL AND (split <> rs OR split <> ss)
  UNION ALL SELECT 'pair_identity_mismatch:building_id' FROM j WHERE ri IS NOT NULL AND si IS NOT NULL AND NOT coalesce(building_id = rb AND rb = sb, false) UNION ALL SELECT 'pair_identity_mismatch:view_id' FROM j WHERE ri IS NOT NULL AND si IS NOT NULL AND NOT coalesce(view_id = rv AND rv = sv, false)
  UNION ALL SELECT 'pair_ineligible_endpoint' FROM j WHERE ri IS NOT NULL AND si IS NOT NULL AND (rm <> 'reviewed' OR sm <> 'reviewed' OR NOT rt OR NOT st) UNION ALL SELECT 'pair_identical_observations' FROM j WHERE ri = si OR rh = sh) GROUP BY 1"""))
def pair_audit(spark, folder):
    k = F.col("source_id")
    rows = manifest(spark, folder)
    broken = anchored(spark, folder, rows).select(
        "pair_id", "reference_id", F.when(k % 11 == 0, -k).otherwise(k).alias("source_id"), F.when(k % 7 == 0, "val").otherwise(F.col("split")).alias("split"), "building_id",
        F.when(k % 5 == 0, "other").otherwise(F.col("view_id")).alias("view_id"),
    )
    return S.pair_audit(broken, eligible(spark, folder, rows)).groupBy("violation").agg(F.count("*").alias("pairs"))


@register("same_split_duplicates", with_sql(IMAGES, body="SELECT split, sha256, count(*) AS images, min(image_id) AS first_image FROM images GROUP BY 1, 2 HAVING count(*) > 1"))
def same_split_duplicates(spark, folder):
    return S.same_split_duplicates(images(spark, folder))


@register("split_transition", with_sql(_WEIGHTS, f"bef AS (SELECT building_id, CASE WHEN building_id % 10 = 7 THEN 'val' WHEN building_id % 10 >= 8 THEN 'test' ELSE 'train' END AS split FROM w WHERE building_id % 17 <> 0), aft AS (SELECT building_id, CASE WHEN building_id % 6 = 0 THEN 'test' ELSE 'train' END AS split FROM w WHERE building_id % 19 <> 0)",
  body="""SELECT building_id, b.split AS previous, a.split AS current, coalesce(b.split = 'train', NULL) AND coalesce(a.split IN ('val', 'test'), false) AS old_train_now_holdout FROM bef b FULL JOIN aft a USING (building_id) WHERE b.split IS DISTINCT FROM a.split"""))
def split_transition(spark, folder):
    from driftlens.plans.fixtures import building_split

    ids = sequence_weights(spark, folder)[0].select("building_id")
    before = ids.filter("building_id % 17 != 0").withColumn("split", building_split(F.col("building_id")))
    after = ids.filter("building_id % 19 != 0").withColumn("split", F.when(F.col("building_id") % 6 == 0, "test").otherwise("train"))
    return S.split_transition(before, after)


@register("absent_gold", with_sql(IMAGES, body="SELECT DISTINCT sha256 FROM images WHERE image_id % 3 = 0 AND sha256 NOT IN (SELECT sha256 FROM images WHERE image_id % 12 <> 0)"))
def absent_gold(spark, folder):
    rows = manifest(spark, folder)
    return S.absent_gold(rows.filter("image_id % 3 = 0"), rows.filter("image_id % 12 != 0"))


@register("train_overlap", with_sql(IMAGES, HISTORY, f"""tr AS (SELECT DISTINCT kind, value FROM ({_IDS.format(keep='image_id', src="(SELECT * FROM hist WHERE split = 'train')")}))""",
  body=f"""SELECT image_id, split, concat_ws(',', CASE WHEN bool_or(kind = 'building_id') THEN 'building_id' END, CASE WHEN bool_or(kind = 'view_id') THEN 'view_id' END, CASE WHEN bool_or(kind = 'sha256') THEN 'sha256' END) AS matched_on
  FROM ({_IDS.format(keep='image_id, split', src='images')}) SEMI JOIN tr USING (kind, value) GROUP BY 1, 2"""))
def train_overlap(spark, folder):
    rows = manifest(spark, folder)
    return S.train_overlap(history(spark, folder, rows).filter("split = 'train'"), rows)


@register("unverified_training", with_sql(IMAGES, HISTORY, body="SELECT image_id FROM hist WHERE split = 'train' AND (building_id IS NULL OR metadata_status IS DISTINCT FROM 'reviewed' OR sha256 IS NULL)"))
def unverified_training(spark, folder):
    return S.unverified_training(history(spark, folder).filter("split = 'train'"))


# --- pairing -----------------------------------------------------------------

@register("first_anchor_pairs", with_sql(IMAGES, ELIGIBLE, ANCHORED, body="SELECT * FROM pairs"))
def first_anchor_pairs(spark, folder):
    return anchored(spark, folder)


def _steps_sql(policy):
    steps = {
        "adjacent": "SELECT view_id, year AS reference_year, lead(year) OVER (PARTITION BY view_id ORDER BY year) AS source_year FROM (SELECT DISTINCT view_id, year FROM ok WHERE temporal_eligible) QUALIFY source_year IS NOT NULL",
        "all": "SELECT DISTINCT a.view_id, a.year AS reference_year, b.year AS source_year FROM ok a JOIN ok b ON a.view_id = b.view_id AND a.year < b.year WHERE a.temporal_eligible AND b.temporal_eligible",
    }[policy]
    return with_sql(IMAGES, ELIGIBLE, f"steps AS ({steps})", body="""SELECT view_id, reference_year, source_year, count(*) AS pairs, count(*) FILTER (WHERE r.building_id IS DISTINCT FROM s.building_id) AS conflicting_building,
      count(*) FILTER (WHERE r.building_id IS NOT DISTINCT FROM s.building_id AND r.split <> s.split) AS different_partitions, count(*) FILTER (WHERE r.building_id IS NOT DISTINCT FROM s.building_id AND r.split = s.split AND r.sha256 = s.sha256) AS identical_bytes,
      count(*) FILTER (WHERE r.building_id IS NOT DISTINCT FROM s.building_id AND r.split = s.split AND r.sha256 <> s.sha256) AS eligible_pairs
      FROM steps JOIN ok r USING (view_id) JOIN ok s USING (view_id) WHERE r.temporal_eligible AND s.temporal_eligible AND r.year = reference_year AND s.year = source_year GROUP BY 1, 2, 3""")


@register("adjacent_pair_steps", _steps_sql("adjacent"))
def adjacent_pair_steps(spark, folder):
    return P.step_counts(temporal(spark, folder), "adjacent")


@register("all_year_pair_steps", _steps_sql("all"))
def all_year_pair_steps(spark, folder):
    return P.step_counts(temporal(spark, folder), "all")


@register("pair_exclusions", with_sql(IMAGES, ELIGIBLE, ANCHORED, body="SELECT split, coalesce(reason, 'accepted') AS reason, count(*) AS pairs FROM pairs GROUP BY 1, 2"))
def pair_exclusions(spark, folder):
    return anchored(spark, folder).groupBy("split", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pairs"))


@register("address_overlaps", with_sql(STREETS, """p AS (SELECT view_id, lower(regexp_extract(view_id, '^(.+)_([0-9]+)(?:-([0-9]+))?$', 1)) AS street, regexp_extract(view_id, '^(.+)_([0-9]+)(?:-([0-9]+))?$', 2)::BIGINT AS low,
  coalesce(nullif(regexp_extract(view_id, '^(.+)_([0-9]+)(?:-([0-9]+))?$', 3), '')::BIGINT, regexp_extract(view_id, '^(.+)_([0-9]+)(?:-([0-9]+))?$', 2)::BIGINT) AS high FROM (SELECT DISTINCT view_id FROM streets) WHERE regexp_full_match(view_id, '(.+)_([0-9]+)(-([0-9]+))?'))""",
  """o AS (SELECT *, low > coalesce(max(high) OVER (PARTITION BY street ORDER BY low, high, view_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM p)""",
  body="""SELECT view_id, street, low, high, (SELECT count(*) FROM p b WHERE b.street = o.street AND b.low <= o.high AND b.high >= o.low) - 1 AS overlaps,
  max(CASE WHEN opens THEN low END) OVER (PARTITION BY street ORDER BY low, high, view_id) AS cluster FROM o"""))
def address_overlaps(spark, folder):
    return P.address_overlaps(street_views(spark, folder))


def attempts(spark, folder, manifest_rows):
    """Alignment attempts of anchored pairs with varied outcomes."""
    p = anchored(spark, folder, manifest_rows)
    sha = manifest_rows.select("image_id", "sha256")
    rows = p.join(sha.withColumnRenamed("image_id", "reference_id").withColumnRenamed("sha256", "reference_sha"), "reference_id").join(
        sha.withColumnRenamed("image_id", "source_id").withColumnRenamed("sha256", "source_sha"), "source_id")
    k = F.col("source_id")
    return rows.filter("source_id % 6 != 5").withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "reference_sha", "source_sha", "rank", ((k + F.col("rank")) % 4 != 0).alias("passed"), (k % 10 != 9).alias("compatible"), (k % 7 != 3).alias("geometry_ok")
    ).distinct()


CHAINS = f"""att AS (SELECT DISTINCT r.sha256 AS rsha, s.sha256 AS ssha, rank, (source_id + rank) % 4 <> 0 AS passed, source_id % 10 <> 9 AS compatible, source_id % 7 <> 3 AS geo FROM pairs JOIN images r ON r.image_id = reference_id JOIN images s ON s.image_id = source_id, (VALUES (0), (1)) t(rank) WHERE source_id % 6 <> 5),
  tried AS (SELECT rsha, ssha, count(*) AS n, count(*) FILTER (WHERE compatible AND passed) AS np, count(*) FILTER (WHERE compatible AND passed AND geo) AS ng FROM att GROUP BY 1, 2),
  obs AS (SELECT split, building_id, view_id, image_id, year, sha256, count(*) OVER g AS observations, (SELECT count(DISTINCT year) FROM ok k WHERE k.temporal_eligible AND k.split = o.split AND k.building_id = o.building_id AND k.view_id = o.view_id) AS ny,
    first_value(image_id) OVER (g ORDER BY year, CAST(image_id AS VARCHAR)) AS aid, first_value(sha256) OVER (g ORDER BY year, CAST(image_id AS VARCHAR)) AS asha FROM ok o WHERE temporal_eligible WINDOW g AS (PARTITION BY split, building_id, view_id)),
  st AS (SELECT o.*, CASE WHEN image_id = aid THEN 'accepted' WHEN p.pair_id IS NULL THEN 'missing_prepared_pair' WHEN n IS NULL THEN 'missing_alignment' WHEN np = 0 THEN 'rejected_or_failed_alignment' WHEN ng = 0 THEN 'invalid_alignment_geometry' ELSE 'accepted' END AS pair_status
    FROM obs o LEFT JOIN (SELECT * FROM pairs WHERE reason IS NULL) p ON p.reference_id = aid AND p.source_id = image_id LEFT JOIN tried ON rsha = asha AND ssha = sha256)"""


def chains(spark, folder):
    base = manifest(spark, folder)
    rows = temporal(spark, folder, base).withColumn("file_present", F.col("image_id") % 40 != 0)
    return Q.sequence_chains(rows, anchored(spark, folder, base).filter("reason IS NULL"), attempts(spark, folder, base))


@register("sequence_chains", with_sql(IMAGES, ELIGIBLE, ANCHORED, CHAINS, body="""SELECT *, CASE WHEN status = 'accepted' THEN substr(sha256(split || '|' || building_id || '|' || view_id || '|' || hashes), 1, 24) END AS sequence_id FROM (
  SELECT split, building_id, view_id, observations, usable, CASE WHEN observations < 2 THEN 'fewer_than_two_observations' WHEN ny <> observations THEN 'ambiguous_same_year_observations' WHEN usable < 2 THEN 'no_accepted_source' WHEN NOT files THEN 'missing_rgb_files' ELSE 'accepted' END AS status, hashes FROM (
  SELECT split, building_id, view_id, any_value(observations) AS observations, any_value(ny) AS ny, CASE WHEN any_value(observations) < 2 OR any_value(ny) <> any_value(observations) THEN 0 ELSE count(*) FILTER (WHERE pair_status = 'accepted') END AS usable,
    bool_and(pair_status <> 'accepted' OR image_id % 40 <> 0) AS files, string_agg(sha256, ',' ORDER BY year) FILTER (WHERE pair_status = 'accepted') AS hashes FROM st GROUP BY 1, 2, 3))""").replace("SELECT *, CASE WHEN status", "SELECT split, building_id, view_id, observations, usable, status, CASE WHEN status"))
def sequence_chains(spark, folder):
    return chains(spark, folder)[0]


@register("sequence_frames", with_sql(IMAGES, ELIGIBLE, ANCHORED, CHAINS, body="""SELECT image_id, pair_status, CASE WHEN pair_status = 'accepted' THEN count(*) FILTER (WHERE pair_status = 'accepted') OVER (PARTITION BY split, building_id, view_id ORDER BY year) - 1 END AS frame
  FROM st WHERE observations >= 2 AND ny = observations"""))
def sequence_frames(spark, folder):
    return chains(spark, folder)[1].select("image_id", "pair_status", "frame")


def method_results(spark, folder):
    """Three alignment methods per order (pair) with failures and gaps."""
    k = F.col("o_orderkey")
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("i")) for i, m in enumerate(("cascade", "sift", "loftr"))])
    spread = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pair_id"), k, F.inline(rows))
    status = F.when((k + F.col("i")) % 3 == 0, "passed").when((k + F.col("i")) % 5 == 0, "failed").otherwise("rejected")
    return spread.filter((F.col("o_orderkey") * 7 + F.col("i")) % 8 != 0).select("pair_id", "method", status.alias("status"))


RESULTS = """res AS (SELECT o_orderkey AS pair_id, method, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'passed' WHEN (o_orderkey + i) % 5 = 0 THEN 'failed' ELSE 'rejected' END AS status FROM orders, (VALUES ('cascade', 0), ('sift', 1), ('loftr', 2)) m(method, i) WHERE (o_orderkey * 7 + i) % 8 <> 0)"""


@register("chosen_methods", with_sql(RESULTS, body="""SELECT pair_id, CASE min(CASE WHEN status = 'passed' THEN CASE method WHEN 'sift' THEN 1 WHEN 'loftr' THEN 2 END END) WHEN 1 THEN 'sift' WHEN 2 THEN 'loftr' END AS method,
  CASE WHEN count(*) FILTER (WHERE status = 'passed' AND method <> 'cascade') = 0 THEN 'sift:' || coalesce(max(status) FILTER (WHERE method = 'sift'), 'not_attempted') || ';loftr:' || coalesce(max(status) FILTER (WHERE method = 'loftr'), 'not_attempted') END AS excluded_statuses FROM res GROUP BY 1"""))
def chosen_methods(spark, folder):
    return Q.choose_method(method_results(spark, folder), ["sift", "loftr"])


def all_pairs(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("pair_id"))


@register("attempt_comparison", with_sql(RESULTS, body="""SELECT m.method, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status IS NULL) AS not_attempted, round(count(*) FILTER (WHERE status = 'passed') / count(*), 9) AS passed_fraction FROM orders CROSS JOIN (VALUES ('sift'), ('loftr')) m(method) LEFT JOIN res ON pair_id = o_orderkey AND res.method = m.method GROUP BY 1"""))
def attempt_comparison(spark, folder):
    return tidy(Q.attempt_comparison(all_pairs(spark, folder), method_results(spark, folder), ["sift", "loftr"]), ("passed_fraction",))


@register("two_method_outcomes", with_sql(RESULTS, body="""SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'not_fully_attempted' WHEN a = 'passed' AND b = 'passed' THEN 'both' WHEN a = 'passed' THEN 'sift_only' WHEN b = 'passed' THEN 'loftr_only' ELSE 'neither' END AS outcome, count(*) AS pairs
  FROM orders LEFT JOIN (SELECT pair_id, max(status) FILTER (WHERE method = 'sift') AS a, max(status) FILTER (WHERE method = 'loftr') AS b FROM res GROUP BY 1) ON pair_id = o_orderkey GROUP BY 1"""))
def two_method_outcomes(spark, folder):
    return Q.two_method_outcomes(all_pairs(spark, folder), method_results(spark, folder), "sift", "loftr")


@register("quality_gate", """SELECT l_orderkey, l_linenumber, count(*) AS rows, max(CASE WHEN r = '' THEN 1 ELSE 0 END) = 1 AS any_passed, min(r) AS first_reasons FROM (SELECT *, concat_ws(';', CASE WHEN l_quantity < 10 THEN 'l_quantity' END, CASE WHEN l_discount < 0.02 THEN 'l_discount' END, CASE WHEN l_tax < 0.01 THEN 'l_tax' END) AS r FROM lineitem) GROUP BY 1, 2""")
def quality_gate(spark, folder):
    reasons = Q.gate_reasons({"l_quantity": 10, "l_discount": 0.02, "l_tax": 0.01})
    rows = table(spark, folder, "lineitem").withColumn("r", reasons)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("rows"), F.bool_or(F.size("r") == 0).alias("any_passed"), F.min(F.array_join("r", ";")).alias("first_reasons")
    )


@register("history_inventory", with_sql(IMAGES, ELIGIBLE, ANCHORED, body="""SELECT split, building_id, CAST(sum(i) AS BIGINT) AS images, count(*) AS views, CAST(sum(coalesce(p, 0)) AS BIGINT) AS accepted_pairs, count(*) FILTER (WHERE y >= 3) AS long_histories, any_value(years) AS years FROM (
  SELECT split, building_id, view_id, count(*) AS i, count(DISTINCT year) AS y FROM ok WHERE temporal_eligible GROUP BY 1, 2, 3) LEFT JOIN (SELECT view_id, count(*) AS p FROM pairs WHERE reason IS NULL GROUP BY 1) USING (view_id)
  JOIN (SELECT split, building_id, count(DISTINCT year) AS years FROM ok WHERE temporal_eligible GROUP BY 1, 2) USING (split, building_id) GROUP BY 1, 2"""))
def history_inventory(spark, folder):
    rows = manifest(spark, folder)
    return Q.history_inventory(temporal(spark, folder, rows), anchored(spark, folder, rows).filter("reason IS NULL"))


def retries(spark, folder):
    u = units(spark, folder).select("unit_id", "split", F.lit("completed").alias("status"), F.col("seconds").alias("value"))
    again = u.filter("unit_id % 4 = 0").withColumn("status", F.when(F.col("unit_id") % 8 == 0, "completed").otherwise("failed")).withColumn("value", F.lit(-1.0))
    return u, again


@register("overlay_merge", with_sql(UNITS, body="""SELECT split, count(*) AS units, count(*) FILTER (WHERE unit_id % 8 = 0) AS replaced, round(sum(CASE WHEN unit_id % 8 = 0 THEN -1 ELSE seconds END), 2) AS value, count(*) FILTER (WHERE unit_id % 8 = 4) AS failures FROM units GROUP BY 1"""))
def overlay_merge(spark, folder):
    merged, failed = Q.overlay(*retries(spark, folder), ["unit_id"])
    kept = merged.groupBy("split").agg(F.count("*").alias("units"), F.count_if(F.col("value") == -1).alias("replaced"), rounded(F.sum("value"), 2).alias("value"))
    return kept.join(failed.groupBy("split").agg(F.count("*").alias("failures")), "split")


def predictor_maps(spark, folder):
    """Predictor p covers units not divisible by p+2 and hides some positions."""
    rows = F.array(*[F.struct(F.lit(p).alias("predictor")) for p in range(3)])
    spread = cells(spark, folder).select("unit_id", "pos", "support", F.inline(rows))
    spread = spread.filter(F.col("unit_id") % (F.col("predictor") + 2) != 0)
    return spread.withColumn("support", (F.col("pos") + F.col("predictor")) % 4 != 0)


@register("common_cohort", with_sql(PX, body="SELECT DISTINCT unit_id FROM px WHERE unit_id % 2 <> 0 AND unit_id % 3 <> 0 AND unit_id % 4 <> 0"))
def common_cohort(spark, folder):
    return Q.common_cohort(predictor_maps(spark, folder), ["unit_id"], 3)


@register("shared_support", with_sql(PX, CELLS, body="SELECT unit_id, pos FROM cells WHERE unit_id % 2 <> 0 AND unit_id % 3 <> 0 AND unit_id % 4 <> 0 AND pos % 4 <> 0 AND (pos + 1) % 4 <> 0 AND (pos + 2) % 4 <> 0"))
def shared_support(spark, folder):
    return Q.shared_support(predictor_maps(spark, folder), ["unit_id", "pos"], 3)


@register("replay_problems", """SELECT o_orderkey AS key, problem FROM orders, LATERAL (SELECT unnest([CASE WHEN o_orderkey % 100 = 0 THEN 'unknown' END, CASE WHEN o_orderkey % 151 = 0 THEN 'duplicate' END, CASE WHEN o_orderkey % 70 = 0 AND o_orderkey % 100 <> 0 THEN 'changed' END]) AS problem) WHERE problem IS NOT NULL
  UNION ALL SELECT o_orderkey, 'reordered' FROM orders WHERE o_orderkey % 500 = 210 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)""")
def replay_problems(spark, folder):
    """A saved selection with unknown, repeated, edited and swapped rows."""
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    index = orders.filter("o_orderkey % 100 != 0").select(k.alias("key"), k.alias("position"), "o_orderstatus")
    swapped = F.when(k % 500 == 210, k + 1).when(k % 500 == 211, k - 1).otherwise(k)
    saved = orders.select(k.alias("key"), swapped.alias("position"), F.when(k % 70 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    again = saved.filter("key % 151 = 0").withColumn("position", F.col("position") + 1000000000)
    return Q.replay_problems(saved.unionByName(again), index, "key", ["o_orderstatus"])


@register("provenance_problems", """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 1 THEN 'file_missing' WHEN doc_id % 10 = 2 THEN 'not_recorded' ELSE 'hash_differs' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)""")
def provenance_problems(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"), "doc_id")
    recorded = d.filter("doc_id % 10 != 2").withColumn("digest", F.when(F.col("doc_id") % 10 == 3, F.reverse("digest")).otherwise(F.col("digest")))
    return Q.provenance_problems(recorded, d.filter("doc_id % 10 != 1"))


@register("arm_problems", """WITH u AS (SELECT o_orderkey // 10 AS base_id, CAST(o_orderkey % 5 AS INTEGER) AS frame, CASE WHEN o_orderkey % 10 < 5 THEN 'clean' ELSE 'event' END AS arm, CASE WHEN o_orderkey % 70 = 8 THEN 'x' ELSE 'n' || (o_orderkey // 10) % 3 END AS nuisance FROM orders WHERE o_orderkey % 130 <> 2),
  p AS (SELECT base_id, frame, count(*) FILTER (WHERE arm = 'clean') AS c, count(*) FILTER (WHERE arm = 'event') AS e, count(DISTINCT nuisance) AS n FROM u GROUP BY 1, 2),
  b AS (SELECT base_id, bool_and(c = 1 AND e = 1) AS arms, bool_and(n = 1) AS same, count(*) = 5 AND max(frame) - min(frame) = 4 AS five FROM p GROUP BY 1)
  SELECT base_id, 'arms_incomplete' AS problem FROM b WHERE NOT arms UNION ALL SELECT base_id, 'nuisance_differs' FROM b WHERE NOT same UNION ALL SELECT base_id, 'frames_not_consecutive' FROM b WHERE NOT five""")
def arm_problems(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").filter("o_orderkey % 130 != 2").select(
        F.floor(k / 10).alias("base_id"), (k % 5).cast("int").alias("frame"), F.when(k % 10 < 5, "clean").otherwise("event").alias("arm"),
        F.when(k % 70 == 8, "x").otherwise(F.concat(F.lit("n"), (F.floor(k / 10) % 3).cast("string"))).alias("nuisance"),
    )
    return Q.arm_problems(rows)


@register("category_problems", """SELECT n_nationkey AS category_id, CASE WHEN n_nationkey % 5 = 1 THEN 'missing' WHEN n_nationkey % 5 = 2 THEN 'unexpected' WHEN n_nationkey % 5 = 3 THEN 'duplicate' ELSE 'reordered' END AS problem FROM nation WHERE n_nationkey % 5 <> 0""")
def category_problems(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_nationkey").alias("channel"))
    k = F.col("category_id")
    actual = n.filter("category_id % 5 != 1").withColumn("channel", F.when(k % 5 == 4, F.col("channel") + 1).otherwise(F.col("channel")))
    return Q.category_problems(n.filter("category_id % 5 != 2"), actual.unionByName(n.filter("category_id % 5 = 3")))


@register("batch_pairs", with_sql(IMAGES, ELIGIBLE, ANCHORED, body="SELECT DISTINCT pair_id, view_id, split FROM pairs WHERE split = 'train' AND reason IS NULL ORDER BY pair_id LIMIT 50"))
def batch_pairs(spark, folder):
    p = anchored(spark, folder)
    return C.batch_pairs(p.unionByName(p.filter("source_id % 3 = 0")), "train", 50).select("pair_id", "view_id", "split")


@register("view_coverage", with_sql(IMAGES, ELIGIBLE, body="""SELECT view_id, count(DISTINCT year) AS available_years, count(DISTINCT year) FILTER (WHERE temporal_eligible) AS usable_years, count(*) AS images, count(*) FILTER (WHERE temporal_eligible) AS usable_images FROM ok WHERE view_id IS NOT NULL GROUP BY 1"""))
def view_coverage(spark, folder):
    from driftlens.operators.labels import view_coverage as operator

    return operator(eligible(spark, folder))


@register("candidate_problems", with_sql(GRID, """cand AS (SELECT image_id * 1000 + y * 16 + x AS candidate_id, image_id AS pair_id, image_id AS reference_id, image_id + CASE WHEN y = 3 AND x = 3 THEN 2 ELSE 1 END AS source_id, x AS x0, y AS y0, x + CASE WHEN x % 5 = 0 THEN 0 ELSE 4 END AS x1, y + 2 AS y1 FROM grid WHERE score > CAST(0.8 AS FLOAT)),
  allc AS (SELECT * FROM cand UNION ALL SELECT * FROM cand WHERE candidate_id % 211 = 0), prs AS (SELECT image_id AS pair_id, count(*) FILTER (WHERE score > CAST(0.8 AS FLOAT)) AS saved FROM grid WHERE image_id % 9 <> 4 GROUP BY 1)""",
  body="""SELECT problem, count(*) AS rows FROM (SELECT 'unknown_pair' AS problem FROM allc WHERE pair_id % 9 = 4 UNION ALL SELECT 'endpoint_mismatch' FROM allc WHERE pair_id % 9 <> 4 AND source_id <> pair_id + 1 UNION ALL SELECT 'invalid_box' FROM allc WHERE x0 >= x1 OR x1 > 16 OR y1 > 16
  UNION ALL SELECT 'duplicate_candidate' FROM allc GROUP BY candidate_id HAVING count(*) > 1 UNION ALL SELECT 'saved_count_mismatch' FROM prs LEFT JOIN (SELECT pair_id, count(*) AS n FROM allc GROUP BY 1) USING (pair_id) WHERE coalesce(n, 0) <> saved) GROUP BY 1"""))
def candidate_problems(spark, folder):
    from driftlens.operators.decide import above
    from driftlens.operators.labels import candidate_problems as operator

    g = grid(spark, folder).withColumn("hot", above(F.col("score"), 0.8))
    x, y = F.col("x"), F.col("y")
    cand = g.filter("hot").select(
        (F.col("image_id") * 1000 + y * 16 + x).alias("candidate_id"), F.col("image_id").alias("pair_id"), F.col("image_id").alias("reference_id"),
        (F.col("image_id") + F.when((y == 3) & (x == 3), 2).otherwise(1)).alias("source_id"), x.alias("x0"), y.alias("y0"), (x + F.when(x % 5 == 0, 0).otherwise(4)).alias("x1"), (y + 2).alias("y1"),
    )
    pairs = g.filter("image_id % 9 != 4").groupBy(F.col("image_id").alias("pair_id")).agg(F.count_if("hot").alias("saved_candidates"))
    pairs = pairs.withColumn("reference_id", F.col("pair_id")).withColumn("source_id", F.col("pair_id") + 1)
    return operator(cand.unionByName(cand.filter("candidate_id % 211 = 0")), pairs, 16)
