"""Change memory, logs, files and sinks."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import calibrate as C
from driftlens.operators import scan
from driftlens.plans import live
from driftlens.session import stored
from driftlens.sources import coco, maps, tables
from driftlens.streaming import events as E
from driftlens.streaming import live as V
from driftlens.streaming import memory as M

OBS = "sequence_id long, cell string, frame long, value double"
KEYS = ["sequence_id", "cell"]


def reference_walk(values, k, threshold):
    memory, start, out = [], None, {}
    for frame, value in values:
        if value is None:
            continue
        score = min((abs(value - v) for v in memory), default=None)
        changed = score is not None and score > threshold
        first = not memory
        count = len(memory)
        if changed or first:
            memory, start = [], frame
        memory = (memory + [value])[-k:]
        out[frame] = (score, first, changed, count, start)
    return out


def batch_rows(frame):
    return {(r.sequence_id, r.cell, r.frame): (r.score, r.initialised, r.changed, r.references, r.episode_start) for r in frame.collect()}


def test_memory_example(spark):
    rows = [(1, "c", i, v) for i, v in enumerate([0.0, 100.0, 100.0, 0.0, 100.0])]
    out = batch_rows(M.memory_batch(spark.createDataFrame(rows, OBS), ["sequence_id", "cell"], 3, 50.0, chunk=2))
    assert [f for (_, _, f), r in sorted(out.items()) if r[2]] == [1, 3, 4]
    late = [(1, "d", 0, None), (1, "d", 1, 7.0), (1, "d", 2, 7.0)]
    out = batch_rows(M.memory_batch(spark.createDataFrame(late, OBS), ["sequence_id", "cell"], 3, 50.0))
    assert out[1, "d", 1][:3] == (None, True, False) and out[1, "d", 2][0] == 0.0


@pytest.mark.parametrize("k,chunk", [(1, 3), (3, 2), (3, 64), (4, 5)])
def test_memory_matches_plain_walk(spark, k, chunk):
    rng = np.random.default_rng(k * 100 + chunk)
    rows, truth = [], {}
    for s in range(3):
        values = [(f, None if rng.random() < 0.15 else float(rng.integers(0, 12))) for f in range(int(rng.integers(1, 60)))]
        rows += [(s, "c", f, v) for f, v in values]
        truth.update({(s, "c", f): r for f, r in reference_walk(values, k, 2.0).items()})
    assert batch_rows(M.memory_batch(spark.createDataFrame(rows, OBS), ["sequence_id", "cell"], k, 2.0, chunk=chunk)) == truth


def test_stream_restart_and_prefix(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(s, "c", f, float(rng.integers(0, 12))) for s in range(4) for f in range(20)]
    source, sink = str(tmp_path / "feed"), str(tmp_path / "sink")
    frame = spark.createDataFrame(rows, OBS)
    whole = batch_rows(M.memory_batch(frame, ["sequence_id", "cell"], 3, 3.0))
    frame.filter("frame < 9").write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(frame.schema).parquet(source)
    E.run_to_end(M.memory_stream(stream(), KEYS, 3, 3.0), sink)
    first = batch_rows(spark.read.parquet(sink + "/data"))
    assert first == {k: v for k, v in whole.items() if k[2] < 9}
    frame.filter("frame >= 9").unionByName(frame.filter("frame = 2")).write.mode("append").parquet(source)
    E.run_to_end(M.memory_stream(stream(), KEYS, 3, 3.0), sink)
    out = spark.read.parquet(sink + "/data")
    assert batch_rows(out.filter("NOT late")) == whole and out.filter("late").count() == 4


def test_one_hot_cell_stays_in_bounded_rows(spark, monkeypatch):
    """200,000 frames of one cell: the sequential rule's result, and no stored row with more than 64 entries in a list."""
    rng, longest = np.random.default_rng(5), []

    def watched(df, name):
        kept = stored(df, name)
        lists = [f.name for f in kept.schema if f.dataType.typeName() == "array"]
        longest.append(kept.select(F.max(F.greatest(F.lit(0), *[F.size(c) for c in lists]))).first()[0])
        return kept

    monkeypatch.setattr(M, "stored", watched)
    monkeypatch.setattr(scan, "stored", watched)
    values = [(f, None if v < 1 else float(v)) for f, v in enumerate(rng.integers(0, 40, 200_000).tolist())]
    frame = spark.createDataFrame([(f, v) for f, v in values], "frame long, value double").selectExpr("DATE'2020-01-01' AS day", "frame", "value")
    out = M.memory_batch(frame, ["day"], 3, 3.0)
    got = {r.frame: (r.score, r.initialised, r.changed, r.references, r.episode_start) for r in out.collect()}
    assert got == reference_walk(values, 3, 3.0)
    assert len(longest) == 4 and max(longest) <= 64


@pytest.mark.parametrize("fan", [2, 64])
def test_scan_equals_running_concatenation(spark, fan):
    rows = [(k, i, chr(97 + i % 26)) for k in range(2) for i in range(150) if i % 7 or k]
    nodes = spark.createDataFrame(rows, "k int, i long, v string")
    got = {(r.k, r.i): r.before for r in scan.exclusive(nodes, ["k"], "i", "v", lambda a, b: F.concat(a, b), F.lit(">"), fan=fan).collect()}
    assert got == {(k, i): ">" + "".join(v for kk, j, v in rows if kk == k and j < i) for k, i, _ in rows}
    assert scan.exclusive(nodes.filter("k > 5"), ["k"], "i", "v", lambda a, b: F.concat(a, b), F.lit("")).count() == 0


def test_cells_share_buckets_of_state(spark, tmp_path):
    """600 cells with NULLs and whole numbers beyond doubles come out as from the batch form; the store has a key per bucket, not per cell."""
    rng, far = np.random.default_rng(12), 2**53
    rows = [(None if s == 7 else far + s, None if s % 5 == 0 else f"c{s % 5}", f, float(rng.integers(0, 12))) for s in range(300) for f in range(6)]
    rows += [(far + s, "d", f, None if f == 3 else float(f)) for s in range(300) for f in range(5)]
    source, sinks = str(tmp_path / "feed"), [str(tmp_path / "first"), str(tmp_path / "second")]
    frame = spark.createDataFrame(rows, OBS)
    key = lambda r: (r.sequence_id, r.cell, r.frame)
    values = {}
    for s, c, f, v in rows:
        values.setdefault((s, c), []).append((f, v))
    truth = {(*cell, f): r for cell, own in values.items() for f, r in reference_walk(own, 3, 3.0).items()}
    frame.filter("frame < 3").write.parquet(source)
    stream = lambda: spark.readStream.schema(frame.schema).parquet(source)
    E.run_to_end(M.memory_stream(stream(), KEYS, 3, 3.0, buckets=8), sinks[0])
    saved = stored(M.exported_memory(spark, sinks[0] + "/state"), "saved")
    assert saved.schema["sequence_id"].dataType.simpleString() == "bigint" and saved.count() == len(values)
    store = spark.read.format("statestore").option("stateVarName", "memory").load(sinks[0] + "/state")
    assert store.select("key").distinct().count() == 8
    source = str(tmp_path / "rest")
    frame.filter("frame >= 3").write.parquet(source)
    E.run_to_end(M.memory_stream(stream(), KEYS, 3, 3.0, initial=saved, buckets=8), sinks[1])
    out = spark.read.parquet(*[s + "/data" for s in sinks]).collect()
    assert not any(r.late for r in out) and len(out) == len(truth)
    assert {key(r): (r.score, r.initialised, r.changed, r.references, r.episode_start) for r in out} == truth


def ordered(spark, tmp_path, parts, delay):
    source, sink = str(tmp_path / "feed"), str(tmp_path / "sink")
    schema = "room date, frame long, value double, ts timestamp"
    for part in parts:
        spark.createDataFrame(part, "room string, frame long, value double, at long").selectExpr("CAST(room AS date) AS room", "frame", "value", "timestamp_seconds(at) AS ts").coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    E.run_to_end(M.memory_stream(feed, ["room"], 2, 3.0, clock="ts", delay=delay), sink)
    return spark.read.parquet(sink + "/data"), sink


def test_shuffled_arrivals_give_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("2020-01-02", f, float(rng.integers(0, 12)), 1000 + 10 * f) for f in range(60)]
    # No row comes more than 200 s after a later one: within the delay.
    came = sorted(rows, key=lambda r: r[3] + int(rng.integers(0, 200)))
    far = [(None, None, None, 10_000)]
    out, sink = ordered(spark, tmp_path, [came[:20], came[20:40], came[40:], [("2020-01-02", 3, 99.0, 1030)], far], "220 seconds")
    got = {r.frame: (r.score, r.initialised, r.changed, r.references, r.episode_start) for r in out.filter("NOT late").collect()}
    assert got == reference_walk([(f, v) for _, f, v, _ in rows], 2, 3.0)
    assert [(r.frame, r.value) for r in out.filter("late").collect()] == [(3, 99.0)]
    assert M.exported_waiting(spark, sink + "/state").count() == 0


def test_rows_wait_for_the_watermark(spark, tmp_path):
    out, sink = ordered(spark, tmp_path, [[("2020-01-02", 0, 1.0, 100)], [("2020-01-02", 1, 2.0, 150)]], "60 seconds")
    assert out.count() == 0
    assert sorted(r.frame for r in M.exported_waiting(spark, sink + "/state").collect()) == [0, 1]


def test_broken_memories_are_refused(spark):
    good = ([3, 5], [1.0, 2.0], 2, 6)
    broken = {
        "missing_field": ([3], [1.0], None, 6), "frames_and_values_differ": ([3, 5], [1.0], 2, 6), "over_capacity": ([2, 3, 5], [1.0, 1.0, 2.0], 2, 6), "no_exemplar": ([], [], 2, 6),
        "frames_not_rising": ([5, 5], [1.0, 2.0], 2, 6), "value_not_finite": ([3, 5], [1.0, float("inf")], 2, 6), "frame_after_the_last": ([3, 5], [1.0, 2.0], 2, 4),
        "exemplar_before_its_episode": ([3, 5], [1.0, 2.0], 4, 6), "episode_not_begun": ([3, 5], [1.0, 2.0], -1, 6),
    }
    rows = [("ok", *good), ("twice", *good), ("twice", *good)] + [(name, *state) for name, state in broken.items()]
    frame = spark.createDataFrame(rows, "cell string, " + M.STATE)
    found = {(r.cell, r.problem) for r in M.memory_problems(frame, ["cell"], 2).collect()}
    assert found == {("twice", "repeated_cell")} | {(name, name) for name in broken}
    assert M.checked_memory(frame.filter("cell = 'ok'"), ["cell"], 2).count() == 1
    with pytest.raises(ValueError, match="over_capacity"):
        M.memory_stream(spark.readStream.format("rate").load().selectExpr("'c' AS cell", "value AS frame", "CAST(value AS double) AS value"), ["cell"], 2, 1.0, initial=frame.filter("cell = 'over_capacity'"))


def test_replayed_epoch_does_not_double(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "unit_id int, sequence int, status string")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    data = E.run_partials(stream, str(tmp_path / "out"), E.latest_status)
    E.latest_status(log).write.mode("overwrite").parquet(data + "/epoch=0")
    out = {r.unit_id: (r.status, r.records) for r in E.merge_latest(spark.read.parquet(data)).collect()}
    assert out == {1: ("b", 2), 2: ("a", 1)}


def test_upsert_table_has_one_row_per_unit(spark, tmp_path):
    source, sink = str(tmp_path / "log"), str(tmp_path / "out")
    part = lambda rows: spark.createDataFrame(rows, "unit_id int, sequence int, status string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: E.run_upserts(E.latest_status_stream(spark.readStream.schema("unit_id int, sequence int, status string").parquet(source)), sink, ["unit_id"])
    part([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (None, 5, "n")])
    assert {tuple(r) for r in run().collect()} == {(1, "b", 2, 2), (2, "a", 1, 1), (None, "n", 5, 1)}
    # A record that comes again after others, an older one, and a new unit; then the same delivery once more.
    part([(1, 1, "a"), (2, 0, "z"), (3, 9, "c")])
    part([(1, 1, "a"), (2, 0, "z"), (3, 9, "c")])
    assert {tuple(r) for r in run().collect()} == {(1, "b", 2, 2), (2, "a", 1, 2), (3, "c", 9, 1), (None, "n", 5, 1)}
    assert len([d for d in os.listdir(sink + "/data") if d.startswith("v=")]) <= 2


@pytest.mark.parametrize("on_disk", [False, True])
def test_latest_table_holds_its_counts_itself(spark, tmp_path, on_disk):
    """Only the records seen are state, in the store asked for whatever the session was set to; a restart goes on from both, a replayed epoch counts once."""
    source, sink, kind = str(tmp_path / "log"), str(tmp_path / "out"), E.STORE + "providerClass"
    schema = "unit_id int, sequence int, status string"
    part = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: {tuple(r) for r in E.run_latest(feed(), sink, on_disk=on_disk).collect()}
    before, other = spark.conf.get(kind), (E.ON_HEAP if on_disk else E.ON_DISK)[kind]
    spark.conf.set(kind, other)
    try:
        part([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (None, 5, "n")])
        assert run() == {(1, "b", 2, 2), (2, "a", 1, 1), (None, "n", 5, 1)}
        part([(1, 1, "a"), (2, 0, "z"), (3, 9, "c"), (3, 9, "c")])
        part([(1, 2, "b"), (2, 0, "z"), (3, 8, "d"), (None, 5, "n")])
        last = {(1, "b", 2, 2), (2, "a", 1, 2), (3, "c", 9, 2), (None, "n", 5, 1)}
        assert run() == last
        # As after a failure before the last commit.
        for name in ("2", ".2.crc"):
            os.remove(f"{sink}/state/commits/{name}")
        assert run() == last and spark.conf.get(kind) == other
    finally:
        spark.conf.set(kind, before)
    assert [r.operatorName for r in spark.read.format("state-metadata").load(sink + "/state").collect()] == ["dedupe"]
    with open(sink + "/state/offsets/0") as held:
        assert json.loads(held.read().split("\n")[1])["conf"][kind] == (E.ON_DISK if on_disk else E.ON_HEAP)[kind]


def test_every_core_has_a_file_of_a_micro_batch(spark, tmp_path):
    feed = live.event_stream(spark, None, spark.range(1000).toDF("n"), batches=3)
    out = spark.read.parquet(E.run_partials(feed.withColumn("file", F.input_file_name()), str(tmp_path), lambda batch: batch))
    got = out.groupBy("epoch").agg(F.countDistinct("file").alias("files"), F.count("*").alias("rows")).collect()
    assert [r.files for r in got] == [spark.sparkContext.defaultParallelism] * 3 and sum(r.rows for r in got) == 1000


def live_pixels(seed):
    rng, rows = np.random.default_rng(seed), []
    for unit in range(60):
        split, clean = ("val", "test")[unit % 2], rng.random() < 0.4
        for _ in range(int(rng.integers(1, 30))):
            label = None if rng.random() < 0.1 else 0 if clean else int(rng.integers(0, 2))
            rows.append(("m", unit % 5 // 2, unit, split, label, float(np.float32(rng.random() * (1 + (label or 0))))))
    return rows


@pytest.mark.parametrize("missing", [False, True])
def test_thresholds_freeze_in_the_stream(spark, tmp_path, missing):
    """TEST first, VAL afterwards in two parts; with a VAL pixel missing nothing may appear."""
    rows = live_pixels(4)
    frame = spark.createDataFrame(rows, "method string, building_id int, unit_id int, split string, label int, score float")
    known = frame.filter("label IS NOT NULL")
    plan = known.groupBy("method", "building_id").agg(F.count_if(F.col("split") == "val").alias("expected"))
    if missing:
        plan = plan.withColumn("expected", F.col("expected") + F.when(F.col("building_id") == 1, 1).otherwise(0))
    source = str(tmp_path / "feed")
    for part in ("split = 'test'", "split = 'val' AND unit_id % 4 = 0", "split = 'val' AND unit_id % 4 <> 0"):
        frame.filter(part).coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = V.run_live(feed, plan, str(tmp_path / "live"))
    epochs = spark.read.parquet(str(tmp_path / "live" / "metrics")).groupBy("epoch").count().collect()
    if missing:
        assert out.count() == 0
        return
    units = frame.filter("split = 'val'").select("unit_id", "building_id").distinct()
    best = C.calibrate_f1(known.drop("building_id"), units, ["method"], F.col("score")).first()
    assert len(epochs) == 1 and {r["threshold"] for r in out.collect()} == {best["threshold"]}
    want = {}
    for _, building, _, split, label, score in rows:
        if split == "test" and label is not None:
            hit = np.float32(score) > np.float32(best["threshold"])
            place = want.setdefault(building, [0, 0, 0, 0])
            place[{(1, True): 0, (0, True): 1, (1, False): 2, (0, False): 3}[label, bool(hit)]] += 1
    assert {r.building_id: [r.tp, r.fp, r.fn, r.tn] for r in out.collect()} == want


def test_units_of_a_building_are_dealt_over_parts(spark, tmp_path):
    """One building's units lie in many keys of the state; a frozen threshold stays when more VAL pixels come."""
    rows = [("m", 1, unit, "val", unit % 2, 0.2 + 0.6 * (unit % 2)) for unit in range(300)] + [("m", 1, 900 + i, "test", 1, 0.5) for i in range(4)]
    frame = spark.createDataFrame(rows, "method string, building_id int, unit_id int, split string, label int, score float")
    plan = spark.createDataFrame([("m", 1, 300)], "method string, building_id int, expected long")
    source, sink = str(tmp_path / "feed"), str(tmp_path / "live")
    run = lambda: V.run_live(spark.readStream.schema(frame.schema).parquet(source), plan, sink).first()
    frame.coalesce(1).write.mode("append").parquet(source)
    first = run()
    spark.createDataFrame([("m", 1, unit, "val", 1, 0.01) for unit in range(1000, 1400)], frame.schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == first and (first.tp, first.fp, first.fn, first.tn) in ((4, 0, 0, 0), (0, 0, 4, 0))
    store = spark.read.format("statestore").option("stateVarName", "units").load(sink + "/state")
    assert store.select("key").distinct().count() == V.PARTS


def test_log_tail_rule(spark):
    rows = [("ok", 1, 1, "c"), ("ok", 2, 2, "c"), ("ok", 3, None, "c"), ("mid", 1, 1, "c"), ("mid", 2, None, "c"), ("mid", 3, 2, "c"), ("gap", 1, 1, "c"), ("gap", 2, 3, "d")]
    log = spark.createDataFrame(rows, "run_id string, position int, sequence int, config_hash string")
    assert {(r.run_id, r.problem) for r in E.log_problems(log).collect()} == {("mid", "corrupt_before_end"), ("gap", "sequence_gap"), ("gap", "mixed_configuration")}


def test_map_files(spark, tmp_path):
    scores = np.array([[0.1, np.nan], [0.3, 0.4]], np.float32)
    support = np.isfinite(scores)
    np.savez(tmp_path / "good.npz", scores=scores, support=support, native=np.array([[True, False], [False, False]]))
    np.savez(tmp_path / "hole.npz", scores=scores, support=np.ones((2, 2), bool))
    np.save(tmp_path / "wide.npy", scores.astype(np.float64))
    rows = maps.load_maps(spark, str(tmp_path), "*").collect()
    good = {(r.y, r.x): (round(r.score, 6), r.native) for r in rows if r.unit == "good"}
    assert good == {(0, 0): (0.1, True), (1, 0): (0.3, False), (1, 1): (0.4, False)}
    assert {r.unit: r.problem for r in rows if r.problem} == {"hole": "nonfinite_in_support", "wide": "scores_not_2d_float32"}


def test_coco_text_is_parsed_once(spark):
    """Broken text gives no rows; the three tables read one parsed copy."""
    texts = ['{"images": [{"id": 1}], "annotations": [{"id": 7, "image_id": 1, "area": 2.5}, {"id": 8, "image_id": 1}], "categories": []}', "{", None]
    parsed = coco.parse_coco(spark.createDataFrame([(t,) for t in texts], "document string"), "document")
    assert [t.count() for t in parsed] == [1, 2, 0] and {r.area for r in parsed[1].collect()} == {2.5, None}
    assert not any("from_json" in t._jdf.queryExecution().optimizedPlan().toString() for t in parsed)


def test_coco_file(spark, tmp_path):
    document = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 3}], "categories": [{"id": 2, "name": "wall"}], "annotations": [
        {"id": 7, "image_id": 1, "category_id": 2, "area": 0, "iscrowd": 0}, {"id": 8, "image_id": 1, "category_id": 2, "segmentation": {"size": [3, 4], "counts": [1, 2, 9]}}]}
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(document, indent=1))
    images, annotations, categories = coco.read_coco(spark, str(path))
    from driftlens.operators.clean import nonpositive, rejected_annotations

    assert [r.annotation_id for r in annotations.filter(~nonpositive(annotations)).collect()] == [8]
    rejected = rejected_annotations(annotations, images, categories).first()
    assert (rejected.annotation_id, rejected.file_name, rejected.name) == (7, "a.jpg", "wall")


def test_override_csv(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("image_id,view_id,building_id,year,reviewed,notes\n1,v,A,2001,TRUE,\n2,,B,,true,\n3,v,,2001,true,\n4,v,C,1500,true,\n5,v,C,2000,false,\n1,v,A,2001,no,\n9,v,A,2001,true,\n")
    ids = spark.createDataFrame([(str(i),) for i in range(1, 6)], "image_id string")
    good, problems = tables.checked_overrides(tables.read_override_csv(spark, str(path)), ids)
    assert {(r.image_id, r.view_id, r.building_id, r.year) for r in good.collect()} == {("2", None, "B", None)}
    assert {(r.image_id, r.problem) for r in problems.collect()} == {("3", "reviewed_without_building"), ("4", "invalid_year"), ("1", "invalid_reviewed_flag"), ("1", "duplicate_override"), ("9", "unknown_image")}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("val", 1, [1, 2])], "split string, x int, items array<int>")
    b = spark.createDataFrame([("test", 2.5)], "split string, y double")
    tables.write_table(tables.union_tables([a, b]), str(tmp_path / "csv"), "csv", ["split"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {(r.split, r.x, r.items, r.y) for r in back} == {("val", "1", "[1,2]", None), ("test", None, None, "2.5")}
    index = tmp_path / "rows.jsonl"
    index.write_text('{"id": 1}\n{"id": 1}\nbroken\n')
    rows = tables.read_index(spark, str(index), "id int").cache()
    assert rows.filter("_corrupt_record IS NOT NULL").count() == 1
    assert tables.duplicate_keys(rows.filter("id IS NOT NULL"), "id").first().rows == 2
    hashes = maps.file_hashes(spark, str(index)).first()
    assert len(hashes.digest) == 64 and hashes.length == index.stat().st_size
    assert io.BytesIO(index.read_bytes()).getbuffer().nbytes == hashes.length
    assert rows.select(F.count("*")).first()[0] == 3
