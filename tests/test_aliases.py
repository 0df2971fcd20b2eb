"""Files found through rename classes."""

import pytest

from driftlens.operators import clean as C


def found(spark, renames, files, name):
    maps = spark.createDataFrame(renames, "old_name string, new_name string")
    disk = spark.createDataFrame([(f,) for f in files], "path string")
    images = spark.createDataFrame([(1, name)], "image_id int, file_name string")
    row = C.resolve_aliases(images, disk, C.rename_closure(maps)).first()
    return row["path"], row["rule"]


CHAIN = [("first.png", "second.png"), ("second.png", "third.png"), ("third.png", "fourth.png")]
PREFIXED = [("0011aabb-shot.png", "tower_1990.png")]


@pytest.mark.parametrize("renames,files,name,want", [
    (CHAIN, ["x/second.png"], "fourth.png", ("x/second.png", "rename_map")),
    (CHAIN, ["x/fourth.png"], "first.png", ("x/fourth.png", "rename_map")),
    (CHAIN, ["x/second.png", "y/third.png"], "first.png", (None, "ambiguous_rename_map")),
    (CHAIN, ["x/first.png", "y/third.png"], "first.png", ("x/first.png", "exact_basename")),
    (CHAIN, ["x/THIRD.png"], "first.png", ("x/THIRD.png", "casefold")),
    (CHAIN, ["x/99887766-third.png"], "first.png", ("x/99887766-third.png", "stripped_prefix")),
    # Another upload prefix reaches the class by its bare name, unless two classes share it.
    (PREFIXED, ["tower_1990.png"], "ccddeeff-shot.png", ("tower_1990.png", "rename_map")),
    (PREFIXED + [("22334455-shot.png", "gate_1991.png")], ["tower_1990.png"], "ccddeeff-shot.png", (None, "ambiguous_rename_map")),
    (PREFIXED + [("22334455-shot.png", "gate_1991.png")], ["tower_1990.png"], "0011aabb-shot.png", ("tower_1990.png", "rename_map")),
    # Refused before the prefix stage could pick the single bare file.
    (PREFIXED + [("22334455-shot.png", "gate_1991.png")], ["shot.png"], "ccddeeff-shot.png", (None, "ambiguous_rename_map")),
    # A member with a folder is looked for in that folder only.
    ([("shot.png", "yard/gate.png")], ["street/gate.png"], "shot.png", (None, "not_found")),
    ([("shot.png", "yard/gate.png")], ["street/gate.png", "yard/gate.png"], "shot.png", ("yard/gate.png", "rename_map")),
    ([("a/shot.png", "a/gate.png"), ("b/shot.png", "b/wall.png")], ["a/gate.png"], "shot.png", (None, "ambiguous_rename_map")),
    ([("a/shot.png", "a/gate.png"), ("b/shot.png", "b/wall.png")], ["a/gate.png"], "a/shot.png", ("a/gate.png", "rename_map")),
    # A cycle is no class.
    ([("p.png", "q.png"), ("q.png", "p.png")], ["q.png"], "p.png", (None, "not_found")),
    ([], ["x/alone.png"], "alone.png", ("x/alone.png", "exact_basename")),
])
def test_rename_classes(spark, renames, files, name, want):
    assert found(spark, renames, files, name) == want
