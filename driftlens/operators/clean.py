"""Entity clean-up: names, rename chains, staged resolution, metadata rules, reviews.

Keys that may repeat without bound are reduced to one row per key before any
join, so an ambiguous name shared by a third of the rows costs one counter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import names as N
from driftlens.session import cut_lineage


def nonpositive(annotations: DataFrame) -> Column:
    """Only an explicitly stored area <= 0 is dropped; a missing area is kept."""
    return F.coalesce(F.col("area") <= 0, F.lit(False))


def rejected_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """The dropped rows with the names a reviewer needs."""
    rejected = annotations.filter(nonpositive(annotations))
    return rejected.join(images.select("image_id", "file_name"), "image_id", "left").join(categories, "category_id", "left")


def rename_problems(maps: DataFrame) -> DataFrame:
    """Names renamed to several targets and targets claimed by several names."""
    pairs = maps.select("old_name", "new_name").distinct()
    out = pairs.groupBy("old_name").count().filter("count > 1").select(F.col("old_name").alias("name"), F.lit("conflicting_source").alias("problem"))
    into = pairs.groupBy("new_name").count().filter("count > 1").select(F.col("new_name").alias("name"), F.lit("conflicting_target").alias("problem"))
    return out.unionByName(into)


def rename_closure(maps: DataFrame) -> DataFrame:
    """Final name of every name in a chain; members of a cycle have none.

    Pointer jumping: each round doubles the distance, so a chain of length n
    takes log2(n) rounds and a cycle is what still points at a renamed name.
    A name with several targets is left to ``rename_problems`` and not followed.
    """
    forked = rename_problems(maps).filter("problem = 'conflicting_source'").select(F.col("name").alias("old_name"))
    maps = maps.join(forked, "old_name", "left_anti")
    edges = maps.select("old_name", "new_name").distinct().filter("old_name != new_name")
    ends = edges.select(F.col("new_name").alias("name")).unionByName(maps.filter("old_name = new_name").select(F.col("old_name").alias("name")))
    ends = ends.distinct().join(edges.select(F.col("old_name").alias("name")), "name", "left_anti")
    links = cut_lineage(edges.select(F.col("old_name").alias("name"), F.col("new_name").alias("target")).unionByName(ends.select("name", F.col("name").alias("target"))))
    rounds = max(1, math.ceil(math.log2(max(2, links.count()))) + 1)
    for _ in range(rounds):
        onward = links.select(F.col("name").alias("target"), F.col("target").alias("_next"))
        moved = cut_lineage(links.join(onward, "target").select("name", F.col("_next").alias("target"), (F.col("_next") != F.col("target")).alias("_moved")))
        links = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    renamed = edges.select(F.col("old_name").alias("target"), F.lit(True).alias("_cyclic"))
    joined = links.join(renamed, "target", "left")
    return joined.select("name", F.when(F.col("_cyclic").isNull(), F.col("target")).alias("final_name"), F.col("_cyclic").isNotNull().alias("in_cycle"))


STAGES = ("explicit_path", "exact_basename", "rename_map", "stripped_prefix", "casefold")


def resolve(images: DataFrame, candidates: DataFrame, renames: DataFrame) -> DataFrame:
    """Staged file matching; the first stage with any match decides.

    Needs images (image_id, file_name), candidates (path) and renames
    (name, final_name). Several files at the deciding stage are ambiguous.
    """
    base = N.basename(F.col("path"))
    index_keys = {
        "explicit_path": F.col("path"), "exact_basename": base, "rename_map": base,
        "stripped_prefix": N.normalized_name(base), "casefold": F.lower(N.normalized_name(base)),
    }
    keyed = candidates.select("path", F.explode(F.array(*[
        F.struct(F.lit(i).alias("stage"), k.alias("key")) for i, k in enumerate(index_keys.values())
    ])).alias("_e")).select("path", "_e.stage", "_e.key")
    # One row per key: at most the two smallest paths are needed to tell unique from ambiguous.
    index = keyed.groupBy("stage", "key").agg(F.min("path").alias("_lo"), F.max("path").alias("_hi"))
    known = renames.select(F.col("name").alias("_n"), "final_name")
    name = N.basename(F.col("file_name"))
    wanted = images.withColumn("_n", name).join(known, "_n", "left").select("image_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("stage"), k.alias("key")) for i, k in enumerate([
            F.col("file_name"), name, F.col("final_name"), N.normalized_name(name), F.lower(N.normalized_name(name)),
        ])
    ] + [
        F.struct(F.lit(3).alias("stage"), N.normalized_name(F.col("final_name")).alias("key")),
        F.struct(F.lit(4).alias("stage"), F.lower(N.normalized_name(F.col("final_name"))).alias("key")),
    ])).alias("_e")).select("image_id", "_e.stage", "_e.key").filter("key IS NOT NULL").distinct()
    found = wanted.join(index, ["stage", "key"]).groupBy("image_id", "stage").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    best = found.groupBy("image_id").agg(F.min_by(F.struct("stage", "_lo", "_hi"), "stage").alias("_m"))
    rule = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("_m.stage") + 1)
    unique = F.col("_m._lo") == F.col("_m._hi")
    return images.select("image_id").join(best, "image_id", "left").select(
        "image_id", F.when(unique, F.col("_m._lo")).alias("path"),
        F.when(F.col("_m").isNull(), "not_found").when(unique, rule).otherwise(F.concat(F.lit("ambiguous_"), rule)).alias("rule"),
    )

def _first_and_last(rows: DataFrame, key, value: str, low: str, high: str) -> DataFrame:
    """Least and greatest value per key: all that is needed to tell one from several."""
    return rows.groupBy(key).agg(F.min(value).alias(low), F.max(value).alias(high))


def rename_classes(images: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows (image_id, class, refused): the rename class an image's name belongs to.

    A class is what one chain of renames connects, named by its last member. The
    whole name is looked up first, then its basename, then the basename without
    prefix; where the first of these that matches names several classes, the
    image is refused.
    """
    members = closure.filter("NOT in_cycle").select("name", F.col("final_name").alias("class"))
    whole, name = F.regexp_replace("file_name", r"\\", "/"), F.col("_whole")
    staged = images.select("image_id", whole.alias("_whole"))
    keys = [lambda c: c, N.basename, lambda c: N.normalized_name(N.basename(c))]
    found = []
    for k, key in enumerate(keys):
        index = _first_and_last(members.withColumn(f"_k{k}", key(F.col("name"))), f"_k{k}", "class", f"_lo{k}", f"_hi{k}")
        staged = staged.withColumn(f"_k{k}", key(name)).join(index, f"_k{k}", "left")
        found.append(F.when(F.col(f"_lo{k}").isNotNull(), F.struct(F.col(f"_lo{k}").alias("lo"), F.col(f"_hi{k}").alias("hi"))))
    first = F.coalesce(*found)
    return staged.select("image_id", first["lo"].alias("class"), (first["lo"] != first["hi"]).alias("refused")).filter("class IS NOT NULL")


def resolve_aliases(images: DataFrame, candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """Staged file matching where any member of a rename class stands for the image.

    Needs images (image_id, file_name), candidates (path, relative to their
    root) and ``rename_closure`` rows. Member names with a folder match only the
    same folder. An image with several classes is refused as ambiguous once no
    direct match has decided, before the later stages may guess.
    """
    path, base = F.col("path"), N.basename(F.col("path"))
    bare = lambda c: N.normalized_name(N.basename(c))
    # The folder stays, the basename loses its prefix.
    placed = lambda c: F.concat(F.regexp_extract(c, r"^(.*/)?", 0), bare(c))
    entry = lambda stage, key: F.struct(F.lit(stage).alias("stage"), key.alias("key"))
    tag = lambda kind, key: F.concat(F.lit(kind), key)
    index = candidates.select("path", F.inline(F.array(
        entry(0, path), entry(1, base), entry(2, tag("b:", base)), entry(2, tag("r:", path)), entry(3, tag("b:", bare(path))), entry(3, tag("r:", placed(path))),
        entry(4, tag("b:", F.lower(bare(path)))), entry(4, tag("r:", F.lower(placed(path)))),
    ))).groupBy("stage", "key").agg(F.min("path").alias("_lo"), F.max("path").alias("_hi"))
    member = F.col("name")
    folder = member.contains("/")
    either = lambda plain, qualified: F.when(folder, tag("r:", qualified)).otherwise(tag("b:", plain))
    aliases = closure.filter("NOT in_cycle").select(F.col("final_name").alias("class"), F.inline(F.array(
        entry(2, either(member, member)), entry(3, either(bare(member), placed(member))), entry(4, either(F.lower(bare(member)), F.lower(placed(member)))),
    )))
    # Files of a class are looked up once per class, not once per image and member.
    of_class = aliases.join(index, ["stage", "key"]).groupBy("class", "stage").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    classes = rename_classes(images, closure)
    through = classes.filter("NOT refused").join(of_class, "class").select("image_id", "stage", "_lo", "_hi")
    refused = classes.filter("refused").select("image_id", F.lit(2).alias("stage"), F.lit("").alias("_lo"), F.lit("several").alias("_hi"))
    whole, name = F.col("file_name"), N.basename(F.col("file_name"))
    own = images.select("image_id", F.inline(F.array(entry(0, whole), entry(1, name), entry(3, tag("b:", bare(whole))), entry(4, tag("b:", F.lower(bare(whole))))))).join(index, ["stage", "key"])
    hits = own.select("image_id", "stage", "_lo", "_hi").unionByName(through).unionByName(refused)
    best = hits.groupBy("image_id", "stage").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).groupBy("image_id").agg(F.min_by(F.struct("stage", "_lo", "_hi"), "stage").alias("_m"))
    rule, unique = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("_m.stage")), F.col("_m._lo") == F.col("_m._hi")
    return images.select("image_id").join(best, "image_id", "left").select(
        "image_id", F.when(unique, F.col("_m._lo")).alias("path"),
        F.when(F.col("_m").isNull(), "not_found").when(unique, rule).otherwise(F.concat(F.lit("ambiguous_"), rule)).alias("rule"),
    )


def apply_rules(images: DataFrame, view_rules: DataFrame, file_rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """View rule < file rule < reviewed override.

    A file rule whose year was omitted takes it from the file name; an explicit
    null stays unknown (``year_given``). Rule tables hold one row per key.
    """
    named = images.withColumn("_name", N.basename(N.normalized_name(F.col("file_name")))).withColumn("_view", N.view_from_name(F.col("file_name")))
    by_name_year = N.year_from_name(F.col("file_name"))
    views = view_rules.select(F.col("view_id").alias("_view"), F.struct(
        F.col("view_id"), F.col("building_id"), F.lit("view_rules").alias("source")).alias("_v"))
    files = file_rules.select(F.col("file_name").alias("_name"), F.struct("view_id", "building_id", "year", "year_given", F.lit("filename_rules").alias("source")).alias("_f"))
    over = overrides.select("image_id", F.struct("view_id", "building_id", "year", F.lit("override_csv").alias("source")).alias("_o"))
    joined = named.join(views, "_view", "left").join(files, "_name", "left").join(over, "image_id", "left")
    shape = lambda c, year: F.struct(F.col(f"{c}.view_id").alias("view_id"), F.col(f"{c}.building_id").alias("building_id"), year.alias("year"), F.col(f"{c}.source").alias("source"))
    chosen = (
        F.when(F.col("_o").isNotNull(), shape("_o", F.col("_o.year")))
        .when(F.col("_f").isNotNull(), shape("_f", F.when(F.col("_f.year_given"), F.col("_f.year")).otherwise(by_name_year)))
        .when(F.col("_v").isNotNull(), shape("_v", by_name_year))
    )
    return joined.withColumn("_c", chosen).select("image_id", "_c.view_id", "_c.building_id", "_c.year", "_c.source")


def rule_conflicts(view_rules: DataFrame) -> DataFrame:
    return view_rules.groupBy("view_id").agg(F.countDistinct("building_id").alias("buildings")).filter("buildings > 1")


def confirmed_rows(images: DataFrame, fixes: DataFrame) -> DataFrame:
    """Attach fixes to images by a name unique on both sides; the rest is reported."""
    name = N.basename(N.normalized_name(F.col("file_name")))
    per_name = images.groupBy(name.alias("_name")).agg(F.count("*").alias("_n"), F.min("image_id").alias("image_id"))
    wanted = fixes.groupBy(name.alias("_name")).agg(F.count("*").alias("_fixes"), F.min("building_id").alias("building_id"), F.min("year").alias("year"))
    joined = wanted.join(per_name, "_name", "left")
    status = (
        F.when(F.col("_fixes") > 1, "duplicate_fix").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("confirmed")
    )
    return joined.select(F.col("_name").alias("name"), status.alias("status"), F.when(status == "confirmed", F.col("image_id")).alias("image_id"), "building_id", "year")


def reuse_inventory(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Carry reviewed metadata when name is unique on both sides and bytes and size agree."""
    name = N.basename(N.normalized_name(F.col("file_name")))
    here = current.groupBy(name.alias("_name")).agg(F.count("*").alias("_here"))
    there = previous.groupBy(name.alias("_name")).agg(
        F.count("*").alias("_there"), F.min(F.struct("image_id", "sha256", "width", "height", "metadata_status", "building_id", "image_status")).alias("_old")
    ).filter("_there = 1")
    joined = current.withColumn("_name", name).join(here, "_name").join(there, "_name", "left")
    same = (
        (F.col("_here") == 1) & (F.col("_old.sha256") == F.col("sha256")) & (F.col("_old.width") == F.col("width"))
        & (F.col("_old.height") == F.col("height")) & (F.col("_old.image_status") == "ready")
    )
    same = F.coalesce(same, F.lit(False))
    inherit = same & (F.col("_old.metadata_status") == "reviewed")
    return joined.select(
        "image_id", F.when(same, "reused").otherwise("decoded").alias("validation"),
        F.when(inherit, F.col("_old.image_id")).alias("inherited_from"), F.when(inherit, F.col("_old.building_id")).alias("inherited_building"),
    )


def duplicate_paths(rows: DataFrame, path="path") -> DataFrame:
    """Rows whose resolved path is shared; counted once per path, joined back."""
    shared = rows.filter(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("shared_by")).filter("shared_by > 1")
    return rows.join(shared, path)


def integrity_report(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts of orphan annotations, unknown categories, bad areas and image states."""
    checks = [
        annotations.join(images, "image_id", "left_anti").select(F.lit("orphan_annotation").alias("item")),
        annotations.join(categories, "category_id", "left_anti").select(F.lit("unknown_category").alias("item")),
        annotations.filter(nonpositive(annotations)).select(F.lit("nonpositive_area").alias("item")),
        images.select(F.concat(F.lit("image_"), "image_status").alias("item")),
        images.select(F.concat(F.lit("metadata_"), "metadata_status").alias("item")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.groupBy("item").agg(F.count("*").alias("rows"))


def eligibility(images: DataFrame, reviewed=True) -> DataFrame:
    """Reason arrays for semantic and for temporal use; empty means eligible."""
    year_ok = F.col("year").between(1800, 2100)
    common = [F.when(F.col("image_status") != "ready", F.concat(F.lit("image_"), "image_status")), F.when(F.col("sha256").isNull(), "missing_image_hash")]
    if reviewed:
        common += [F.when(F.col("metadata_status") != "reviewed", "metadata_not_reviewed"), F.when(F.col("building_id").isNull(), "unknown_building")]
    temporal = [F.when(F.col("view_id").isNull(), "unknown_view"), F.when(~F.coalesce(year_ok, F.lit(False)), "unknown_or_invalid_year")]
    out = images.withColumn("reasons", F.array_compact(F.array(*common))).withColumn("temporal_reasons", F.array_compact(F.array(*common, *temporal)))
    semantic = (F.size("reasons") == 0) & (F.col("metadata_status") == "reviewed") & F.col("building_id").isNotNull()
    return out.withColumn("semantic_eligible", semantic).withColumn("temporal_eligible", F.size("temporal_reasons") == 0)


def reason_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def building_review(images: DataFrame) -> DataFrame:
    """Group by folded address: confirmed buildings, years and conflict notes.

    Years are bounded; views and buildings are reported by count and extremes,
    because their lists are not.
    """
    ready = images.filter((F.col("image_status") == "ready") & F.col("view_id").isNotNull() & F.col("year").between(1800, 2100))
    proposed = N.proposed_building(F.col("view_id"))
    confirmed = F.when(F.col("metadata_status") == "reviewed", F.col("building_id"))
    rows = ready.withColumn("_p", proposed).withColumn("_c", confirmed)
    grouped = rows.groupBy(F.lower(F.coalesce("_c", "_p", "view_id")).alias("address")).agg(
        F.count("*").alias("images"), F.countDistinct("view_id").alias("views"), F.countDistinct("_c").alias("confirmed_buildings"),
        F.min("_c").alias("_building"), F.min("_p").alias("_proposed"), F.concat_ws(";", F.array_sort(F.collect_set(F.col("year").cast("string")))).alias("years"),
        F.bool_and(F.col("_c").isNotNull()).alias("_all"),
    )
    one = F.col("confirmed_buildings") == 1
    return grouped.select(
        "address", F.when(one, F.col("_building")).otherwise(F.col("_proposed")).alias("building_id"), "images", "views", "years",
        (one & F.col("_all")).alias("reviewed"),
        F.when(F.col("confirmed_buildings") > 1, "conflicting_confirmed").when(F.col("_proposed").isNull() & (F.col("confirmed_buildings") == 0), "no_house_number").alias("note"),
    )


def group_review(images: DataFrame) -> DataFrame:
    """Per view: image and building counts and whether every row is reviewed."""
    return images.filter("view_id IS NOT NULL").groupBy("view_id").agg(
        F.count("*").alias("images"), F.countDistinct("building_id").alias("buildings"), F.min("building_id").alias("first_building"),
        F.bool_and(F.col("metadata_status") == "reviewed").alias("all_reviewed"),
    )


def pairing_status(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Why an image does or does not take part in pairs."""
    used = pairs.select(F.explode(F.array("reference_id", "source_id")).alias("image_id")).groupBy("image_id").agg(F.count("*").alias("pair_count"))
    years = images.filter("temporal_eligible").groupBy("view_id").agg(F.countDistinct("year").alias("_years"))
    joined = images.join(used, "image_id", "left").join(years, "view_id", "left")
    status = (
        F.when(~F.col("temporal_eligible"), "unresolved").when(F.col("pair_count") > 0, "pair_candidate")
        .when(F.col("_years") == 1, "single_year_view").otherwise("eligible_without_pair")
    )
    return joined.select("image_id", F.coalesce("pair_count", F.lit(0)).alias("pair_count"), status.alias("status"))


def class_coverage(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Dense split x category counts; absent classes show as zero rows."""
    seen = annotations.join(images.select("image_id", "split", "building_id", "metadata_status"), "image_id")
    reviewed = F.when(F.col("metadata_status") == "reviewed", F.col("building_id"))
    counts = seen.groupBy("split", "category_id").agg(
        F.count("*").alias("annotations"), F.countDistinct("image_id").alias("images"), F.countDistinct(reviewed).alias("buildings")
    )
    spine = categories.select("category_id").withColumn("split", F.explode(F.array(*[F.lit(s) for s in ("train", "val", "test")])))
    return spine.join(counts, ["split", "category_id"], "left").fillna(0, ["annotations", "images", "buildings"]).withColumn("missing", F.col("annotations") == 0)


def batch_pairs(pairs: DataFrame, split: str, limit: int) -> DataFrame:
    """First pairs of a split that share a partition and differ in bytes; keys once."""
    ok = pairs.filter((F.col("split") == split) & F.col("reason").isNull()).dropDuplicates(["pair_id"])
    return ok.orderBy("pair_id").limit(limit)
