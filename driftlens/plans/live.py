"""Registered queries: change memory, run logs, streams and file round trips."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from driftlens.operators import calibrate as C
from driftlens.operators.ranks import bucketed_rank
from driftlens.operators.scoring import sorted_groups
from driftlens.plans.fixtures import PX, UNITS, frame_grid, rounded, table, units, with_sql
from driftlens.plans.metrics import case_rows, tidy
from driftlens.plans.tuning import GRID101, LONG, long_scores
from driftlens.session import cut_lineage, stored
from driftlens.sources import maps, tables
from driftlens.streaming import events as E
from driftlens.streaming import live as V
from driftlens.streaming import memory as M

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


CELL = ["sequence_id", "cell"]


def observations(spark, folder):
    """Event values per (user, event type) with a dense frame index by time."""
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("sequence_id"), F.col("event_type").alias("cell"), "ts", "event_id", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value")
    )
    day = F.unix_date(F.to_date("ts"))
    ranked = bucketed_rank(e, ["sequence_id", "cell"], day, ["ts", "event_id"], "frame")
    return ranked.withColumn("frame", F.col("frame") - 1)


def stored_observations(spark, folder):
    """Observations written once: a feed reads them part by part."""
    return stored(observations(spark, folder).select(*CELL, "frame", "value"), "observations")


_OBS = """obs AS (SELECT user_id AS sequence_id, event_type AS cell, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events)"""


def walk_sql(source="obs"):
    """The sequential rule over rows (sequence_id, cell, frame, value) of ``source``; needs WITH RECURSIVE."""
    return f"""seen AS (SELECT *, row_number() OVER w AS n, abs(value - lag(value, 1) OVER w) AS d1, abs(value - lag(value, 2) OVER w) AS d2, abs(value - lag(value, 3) OVER w) AS d3
    FROM {source} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY sequence_id, cell ORDER BY frame)),
  walk AS (SELECT sequence_id, cell, frame, value, n, CAST(NULL AS DOUBLE) AS score, 0 AS refs, 1 AS state, frame AS episode_start FROM seen WHERE n = 1
    UNION ALL SELECT s.sequence_id, s.cell, s.frame, s.value, s.n, m.score, w.state, CASE WHEN m.score > 30 THEN 1 ELSE least(w.state + 1, 3) END, CASE WHEN m.score > 30 THEN s.frame ELSE w.episode_start END
    FROM walk w JOIN seen s ON s.sequence_id = w.sequence_id AND s.cell = w.cell AND s.n = w.n + 1, LATERAL (SELECT CASE w.state WHEN 1 THEN s.d1 WHEN 2 THEN least(s.d1, s.d2) ELSE least(s.d1, s.d2, s.d3) END AS score) m)"""


OBS_SQL = with_sql("RECURSIVE " + _OBS, walk_sql(), body="""SELECT sequence_id, cell, frame, value, round(score, 9) AS score, refs = 0 AS initialised, coalesce(score > 30, false) AS changed, refs AS "references", episode_start FROM walk""")


@register("change_memory", OBS_SQL)
def change_memory(spark, folder):
    """Three exemplars per cell, change above a distance of 30."""
    out = M.memory_batch(observations(spark, folder), ["sequence_id", "cell"], 3, 30.0, chunk=4)
    return tidy(out, ("score",))


def event_stream(spark, folder, view, batches=None):
    """A file stream over rows the batch side has prepared, in one or several micro-batches; every core has a file of each."""
    source, reader = E.shared_folder(spark, "feed"), spark.readStream.schema(view.schema)
    if not batches:
        view.write.parquet(source)
        return reader.parquet(source)
    view.repartition(batches * max(2, spark.sparkContext.defaultParallelism)).write.parquet(source)
    # Few rows leave fewer files.
    files = len(spark.read.schema(view.schema).parquet(source).inputFiles())
    return reader.option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(source)


def fed(spark, parts, files=2):
    """A file stream that takes one of the given parts per micro-batch; ``files`` is the parallelism of a batch."""
    source = E.shared_folder(spark, "feed")
    for part in parts:
        part.repartition(files).write.mode("append").parquet(source)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(source)


@register("change_memory_stream", OBS_SQL)
def change_memory_stream(spark, folder):
    """The stateful stream over the same observations in three micro-batches; equal to the batch form."""
    view = stored_observations(spark, folder)
    feed = fed(spark, [view.filter(part) for part in ("frame < 4", "frame BETWEEN 4 AND 8", "frame > 8")])
    data = E.run_to_end(M.memory_stream(feed, CELL, 3, 30.0), E.shared_folder(spark, "memory"))
    return tidy(spark.read.parquet(data).filter("NOT late").drop("late"), ("score",))


@register("change_memory_resumed", OBS_SQL)
def change_memory_resumed(spark, folder):
    """Two runs with a stop in between: the restored state continues the same cells."""
    source, sink = E.shared_folder(spark, "feed"), E.shared_folder(spark, "memory")
    view = stored_observations(spark, folder)
    # The first run sees an early share of every cell, the second one the rest.
    view.filter("frame < 6").write.mode("append").parquet(source)
    feed = lambda: spark.readStream.schema(view.schema).parquet(source)
    E.run_to_end(M.memory_stream(feed(), CELL, 3, 30.0), sink)
    view.filter("frame >= 6").write.mode("append").parquet(source)
    data = E.run_to_end(M.memory_stream(feed(), CELL, 3, 30.0), sink)
    return tidy(spark.read.parquet(data).filter("NOT late").drop("late"), ("score",))


@register("change_memory_restored", OBS_SQL)
def change_memory_restored(spark, folder):
    """A new query with a checkpoint of its own continues from the memories that another one exported."""
    view = stored_observations(spark, folder)
    first, second = E.shared_folder(spark, "memory"), E.shared_folder(spark, "memory")
    early = E.run_to_end(M.memory_stream(fed(spark, [view.filter("frame < 3"), view.filter("frame BETWEEN 3 AND 6")]), CELL, 3, 30.0), first)
    saved = stored(M.exported_memory(spark, first + "/state"), "memories")
    rest = E.run_to_end(M.memory_stream(fed(spark, [view.filter("frame > 6")]), CELL, 3, 30.0, initial=saved), second)
    return tidy(spark.read.parquet(early, rest).filter("NOT late").drop("late"), ("score",))


def told_memory(states):
    """Memories with their lists written out."""
    return states.select(*CELL, F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"), rounded(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), "episode_start", "last_frame")


_MEMORY = """kept AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY sequence_id, cell ORDER BY n DESC) <= 3 AND frame >= first_value(episode_start) OVER (PARTITION BY sequence_id, cell ORDER BY n DESC)),
  memory AS (SELECT sequence_id, cell, list(frame ORDER BY n) AS frames, list(value ORDER BY n) AS vals, max_by(episode_start, n) AS episode_start, max(frame) AS last_frame FROM kept GROUP BY 1, 2)"""


@register("exported_memory", with_sql("RECURSIVE " + _OBS, walk_sql(), _MEMORY, body="""SELECT sequence_id, cell, array_to_string(frames, ',') AS frames, round(list_sum(vals), 6) AS total, episode_start, t.last_frame
  FROM memory JOIN (SELECT sequence_id, cell, max(frame) AS last_frame FROM obs GROUP BY 1, 2) t USING (sequence_id, cell)"""))
def exported_memory(spark, folder):
    """What the stream's state store holds when the stream has ended."""
    view, sink = stored_observations(spark, folder), E.shared_folder(spark, "memory")
    E.run_to_end(M.memory_stream(fed(spark, [view.filter("frame < 5"), view.filter("frame >= 5")]), CELL, 3, 30.0), sink)
    return told_memory(M.exported_memory(spark, sink + "/state"))


@register("final_memory", with_sql("RECURSIVE " + _OBS, walk_sql(), _MEMORY, body="SELECT sequence_id, cell, array_to_string(frames, ',') AS frames, round(list_sum(vals), 6) AS total, episode_start, last_frame FROM memory"))
def final_memory(spark, folder):
    """The batch twin of the exported state; its last frame is the last one with a value."""
    return told_memory(M.memory_state(M.memory_batch(observations(spark, folder), CELL, 3, 30.0, chunk=4), CELL, 3))


@register("broken_memories", with_sql("RECURSIVE " + _OBS, walk_sql(), _MEMORY, """broken AS (SELECT sequence_id, cell, len(frames) AS n, CASE sequence_id % 9 WHEN 1 THEN frames || [last_frame + 1] WHEN 2 THEN list_reverse(frames) WHEN 3 THEN list_transform(frames, lambda f: f + 1) ELSE frames END AS frames,
    CASE sequence_id % 9 WHEN 4 THEN vals[2:] WHEN 5 THEN list_transform(vals, lambda v: NULL) ELSE vals END AS vals, CASE sequence_id % 9 WHEN 6 THEN last_frame + 1 WHEN 7 THEN NULL ELSE episode_start END AS episode_start, last_frame FROM memory)""",
    body="""SELECT sequence_id, cell, unnest(list_filter([CASE WHEN episode_start IS NULL THEN 'missing_field' END, CASE WHEN len(frames) <> len(vals) THEN 'frames_and_values_differ' END, CASE WHEN len(frames) > 3 THEN 'over_capacity' END,
      CASE WHEN sequence_id % 9 = 2 AND n > 1 THEN 'frames_not_rising' END, CASE WHEN len(list_filter(vals, lambda v: v IS NULL)) > 0 THEN 'value_not_finite' END, CASE WHEN list_max(frames) > last_frame THEN 'frame_after_the_last' END,
      CASE WHEN list_min(frames) < episode_start THEN 'exemplar_before_its_episode' END], lambda x: x IS NOT NULL)) AS problem FROM broken UNION ALL SELECT sequence_id, cell, 'repeated_cell' FROM broken WHERE sequence_id % 9 = 8"""))
def broken_memories(spark, folder):
    """Saved memories damaged in seven ways are told apart before a stream continues from them."""
    whole = M.memory_state(M.memory_batch(observations(spark, folder), CELL, 3, 30.0, chunk=4), CELL, 3)
    kind, frames, values, last = F.col("sequence_id") % 9, F.col("frames"), F.col("vals"), F.col("last_frame")
    damaged = whole.select(
        *CELL, F.when(kind == 1, F.concat(frames, F.array(last + 1))).when(kind == 2, F.reverse(frames)).when(kind == 3, F.transform(frames, lambda f: f + 1)).otherwise(frames).alias("frames"),
        F.when(kind == 4, F.slice(values, 2, 3)).when(kind == 5, F.transform(values, lambda v: F.lit(None).cast("double"))).otherwise(values).alias("vals"),
        F.when(kind == 6, last + 1).when(kind == 7, F.lit(None)).otherwise(F.col("episode_start")).alias("episode_start"), "last_frame",
    )
    return M.memory_problems(damaged.unionByName(damaged.filter(kind == 8)), CELL, 3)


#: Hours by which arrivals are shuffled, the watermark's delay, and how far every eleventh event falls behind.
SHUFFLED, DELAY, BEHIND = 24, 36, 24 * 40


def arrivals(spark, folder):
    """Observations with the hour and the micro-batch of their arrival, out of order and partly far too late."""
    seen = observations(spark, folder).withColumn("hour", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000))
    hour = F.col("hour") + F.when(F.col("event_id") % 11 == 0, BEHIND).otherwise(F.col("event_id") * 7919 % SHUFFLED)
    span = F.broadcast(seen.agg(F.min("hour").alias("_low"), F.max("hour").alias("_high")))
    batch = F.least(F.lit(3), F.floor((hour - F.col("_low")) * 4 / (F.col("_high") - F.col("_low") + 1)))
    return seen.join(span).select(*CELL, F.col("ts").cast("timestamp").alias("ts"), "frame", "value", batch.cast("int").alias("batch"))


_ARRIVED = f"""hours AS (SELECT *, epoch_ms(ts) // 3600000 AS hour FROM obs), span AS (SELECT min(hour) AS low, max(hour) AS high FROM hours),
  came AS (SELECT h.*, least(3, ((hour + CASE WHEN event_id % 11 = 0 THEN {BEHIND} ELSE event_id * 7919 % {SHUFFLED} END - low) * 4) // (high - low + 1)) AS batch FROM hours h, span),
  marks AS (SELECT b.batch, (SELECT max(epoch_ms(ts)) - {DELAY} * 3600000 FROM came e WHERE e.batch < b.batch) AS mark FROM (SELECT DISTINCT batch FROM came) b),
  timed AS (SELECT c.sequence_id, c.cell, c.frame, c.value, coalesce(epoch_ms(ts) <= mark, false) AS late FROM came c JOIN marks USING (batch)),
  good AS (SELECT * FROM timed WHERE NOT late)"""


@register("ordered_memory_stream", with_sql("RECURSIVE " + _OBS, _ARRIVED, walk_sql("good"), body="""SELECT sequence_id, cell, frame, value, round(score, 9) AS score, coalesce(score > 30, false) AS changed, false AS late FROM walk
  UNION ALL SELECT sequence_id, cell, frame, value, NULL, false, true FROM timed WHERE late"""))
def ordered_memory_stream(spark, folder):
    """Shuffled arrivals wait for the watermark and are taken in frame order; rows behind it form the side rows.

    The last part is a row without a frame, which only moves the clock past all waiting rows.
    """
    seen = stored(arrivals(spark, folder), "arrivals")
    end = F.max("ts") + F.expr(f"INTERVAL {DELAY + 1} HOURS")
    close = seen.agg(end.alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in seen.columns])
    feed = fed(spark, [seen.filter(F.col("batch") == k) for k in range(4)] + [close])
    data = E.run_to_end(M.memory_stream(feed, CELL, 3, 30.0, clock="ts", delay=f"{DELAY} hours"), E.shared_folder(spark, "ordered"))
    return tidy(spark.read.parquet(data).select(*CELL, "frame", "value", "score", "changed", "late"), ("score",))


def run_log(spark, folder):
    """Events as an append-only log: unit = user, sequence = event id."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("unit_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("status"))


LATEST = "SELECT user_id AS unit_id, max_by(event_type, event_id) AS status, max(event_id) AS sequence, count(*) AS records FROM events GROUP BY 1"


@register("latest_unit_status", LATEST)
def latest_unit_status(spark, folder):
    return E.latest_status(run_log(spark, folder))


@register("latest_unit_status_stream", LATEST)
def latest_unit_status_stream(spark, folder):
    """Several micro-batches in update mode; repeated deliveries count once however late they come, and the sink holds one row per unit."""
    log = run_log(spark, folder)
    feed = event_stream(spark, folder, log.unionByName(log.filter("event_id % 5 = 0")), batches=3)
    return E.run_latest(feed, E.shared_folder(spark, "status"))


@register("log_problems", """WITH l AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  g AS (SELECT run_id, CASE WHEN run_id % 10 = 1 AND position >= 3 THEN position + 1 WHEN run_id % 10 = 2 AND position = 4 THEN 3 WHEN run_id % 10 = 4 AND position = n THEN NULL WHEN run_id % 10 = 5 AND position = 2 THEN NULL ELSE position END AS seq, position, n, CASE WHEN run_id % 10 = 3 AND position = 2 THEN 'other' ELSE 'cfg' END AS cfg FROM l),
  p AS (SELECT run_id, count(seq) AS c, count(DISTINCT seq) AS d, max(seq) AS mx, count(DISTINCT cfg) AS k, count(*) FILTER (WHERE seq IS NULL AND position < n) AS bad FROM g GROUP BY 1)
  SELECT run_id, unnest(list_filter([CASE WHEN c > d THEN 'repeated_sequence' END, CASE WHEN mx <> d THEN 'sequence_gap' END, CASE WHEN k > 1 THEN 'mixed_configuration' END, CASE WHEN bad > 0 THEN 'corrupt_before_end' END], lambda x: x IS NOT NULL)) AS problem FROM p""")
def log_problems(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    ranked = bucketed_rank(e, ["run_id"], F.floor(F.col("event_id") / 2048), ["event_id"], "position", total="n")
    run, at = F.col("run_id") % 10, F.col("position")
    sequence = (
        F.when((run == 1) & (at >= 3), at + 1).when((run == 2) & (at == 4), 3).when((run == 4) & (at == F.col("n")), None).when((run == 5) & (at == 2), None).otherwise(at)
    )
    log = ranked.select("run_id", "position", sequence.alias("sequence"), F.when((run == 3) & (at == 2), "other").otherwise("cfg").alias("config_hash"))
    return E.log_problems(log)


_CACHE = """cached AS (SELECT o_orderkey AS unit_id, origin, variant, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'completed' END AS status, origin || o_orderkey AS result FROM orders, (VALUES ('reused_pilot', 'frozen', 5), ('reused_source', 'frozen', 7), ('reused_source', 'foreign', 2)) c(origin, variant, m) WHERE o_orderkey % m = 0)"""


def cached_results(spark, folder):
    rows = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(v).alias("variant"), F.lit(m).alias("m")) for o, v, m in (("reused_pilot", "frozen", 5), ("reused_source", "frozen", 7), ("reused_source", "foreign", 2))])
    spread = table(spark, folder, "orders").select(F.col("o_orderkey").alias("unit_id"), F.inline(rows)).filter("unit_id % m = 0")
    return spread.select("unit_id", "origin", "variant", F.when(F.col("unit_id") % 13 == 0, "failed").otherwise("completed").alias("status"), F.concat("origin", F.col("unit_id").cast("string")).alias("result"))


@register("resume_jobs", with_sql(_CACHE, body="""SELECT unit_id, CASE min(CASE WHEN variant = 'frozen' AND status = 'completed' THEN CASE origin WHEN 'reused_source' THEN 1 ELSE 2 END END) WHEN 1 THEN 'reused_source' WHEN 2 THEN 'reused_pilot' ELSE 'to_run' END AS origin FROM (SELECT o_orderkey AS unit_id FROM orders) LEFT JOIN cached USING (unit_id) GROUP BY 1"""))
def resume_jobs(spark, folder):
    planned = table(spark, folder, "orders").select(F.col("o_orderkey").alias("unit_id"))
    todo, reused = E.resume_jobs(planned, cached_results(spark, folder), ["unit_id"], ("reused_source", "reused_pilot"), "frozen")
    return todo.select("unit_id", F.lit("to_run").alias("origin")).unionByName(reused.select("unit_id", "origin"))


@register("late_rows", """WITH l AS (SELECT user_id AS sequence_id, event_id AS arrival, event_id + CASE WHEN event_id % 11 = 0 THEN 400 ELSE 0 END AS frame FROM events)
  SELECT sequence_id, arrival, frame, frame <= coalesce(max(frame) OVER (PARTITION BY sequence_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS late FROM l""")
def late_rows(spark, folder):
    """Every eleventh event claims a later frame, so followers arrive late."""
    k = F.col("event_id")
    log = table(spark, folder, "events").select(F.col("user_id").alias("sequence_id"), k.alias("arrival"), (k + F.when(k % 11 == 0, 400).otherwise(0)).alias("frame"))
    return E.split_late(log).select("sequence_id", "arrival", "frame", "late")


_EVEN = """top AS (SELECT sequence_id, cell, max(frame) FILTER (WHERE frame % 2 = 0) AS t FROM obs GROUP BY 1, 2),
  keep AS (SELECT obs.* FROM obs JOIN top USING (sequence_id, cell) WHERE frame % 2 = 0 OR frame > t)"""


@register("late_rows_stream", with_sql("RECURSIVE " + _OBS, _EVEN, walk_sql("keep"), body="""SELECT cell, false AS late, count(*) AS rows, count(*) FILTER (WHERE score > 30) AS changes FROM walk GROUP BY 1
  UNION ALL SELECT cell, true, count(*), 0 FROM obs ANTI JOIN keep USING (sequence_id, cell, frame) GROUP BY 1"""))
def late_rows_stream(spark, folder):
    """Out-of-order frames on the stateful stream leave as side rows, flagged late."""
    view = stored_observations(spark, folder)
    source, sink = E.shared_folder(spark, "feed"), E.shared_folder(spark, "late")
    feed = lambda: spark.readStream.schema(view.schema).parquet(source)
    view.filter("frame % 2 = 0").write.mode("append").parquet(source)
    E.run_to_end(M.memory_stream(feed(), CELL, 3, 30.0), sink)
    view.filter("frame % 2 = 1").write.mode("append").parquet(source)
    data = E.run_to_end(M.memory_stream(feed(), CELL, 3, 30.0), sink)
    return spark.read.parquet(data).groupBy("cell", "late").agg(F.count("*").alias("rows"), F.count_if("changed").alias("changes"))


def test_pixels(spark, folder):
    """Scored pixels of TEST units, as finished work arrives."""
    test = units(spark, folder).filter("split = 'test'").select("unit_id", "building_id")
    return long_scores(spark, folder).join(test, "unit_id").select("method", "building_id", "unit_id", "label", "score")


FROZEN = """val AS (SELECT method, unit_id, building_id, i, count(*) FILTER (WHERE label = 1 AND score > thr) AS tp, count(*) FILTER (WHERE label = 0 AND score > thr) AS fp, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM long, t WHERE split = 'val' AND label IS NOT NULL GROUP BY 1, 2, 3, 4),
  c AS (SELECT method, i, avg(f1) AS f1, avg(fpr) AS fpr FROM (SELECT method, i, building_id, avg(CASE WHEN p > 0 THEN 2 * tp / (tp + fp + p) END) AS f1, avg(CASE WHEN p = 0 AND n > 0 THEN fp / n END) AS fpr FROM val GROUP BY 1, 2, 3) GROUP BY 1, 2),
  d AS (SELECT * FROM c QUALIFY f1 >= max(f1) OVER (PARTITION BY method) - 1e-12), e AS (SELECT method, max(i) AS i FROM (SELECT * FROM d QUALIFY fpr <= min(fpr) OVER (PARTITION BY method) + 1e-12) GROUP BY 1)"""


def live_sql(frozen="e"):
    return with_sql(PX, UNITS, LONG, GRID101, FROZEN, body=f"""SELECT method, building_id, count(*) FILTER (WHERE label = 1 AND score > thr) AS tp, count(*) FILTER (WHERE label = 0 AND score > thr) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT score > thr) AS fn, count(*) FILTER (WHERE label = 0 AND NOT score > thr) AS tn FROM long JOIN {frozen} USING (method) JOIN t USING (i) WHERE split = 'test' AND label IS NOT NULL GROUP BY 1, 2""")


LIVE = live_sql()


def frozen_threshold(spark, folder):
    val = units(spark, folder).filter("split = 'val'").select("unit_id", "building_id")
    return C.calibrate_f1(long_scores(spark, folder), val, ["method"], F.col("score")).select("method", "threshold")


@register("live_metrics", LIVE)
def live_metrics(spark, folder):
    """TEST totals under a threshold frozen from finished VAL units only."""
    return E.live_totals(E.live_counts(test_pixels(spark, folder), frozen_threshold(spark, folder)))


def finished_units(spark, folder):
    """Finished work per method; method c still misses every 13th VAL unit."""
    val = units(spark, folder).filter("split = 'val'").select("unit_id", "split")
    methods = F.explode(F.array(F.lit("a"), F.lit("c"))).alias("method")
    return val.select("unit_id", "split", methods).filter("method = 'a' OR unit_id % 13 != 0")


def ready_methods(spark, folder):
    expected = units(spark, folder).filter("split = 'val'").agg(F.count("*").alias("expected")).select(F.explode(F.array(F.lit("a"), F.lit("c"))).alias("method"), "expected")
    return E.validation_ready(finished_units(spark, folder), expected)


@register("validation_ready", with_sql(UNITS, body="SELECT method, count(*) FILTER (WHERE method = 'a' OR unit_id % 13 <> 0) >= count(*) AS ready FROM units, (VALUES ('a'), ('c')) m(method) WHERE split = 'val' GROUP BY 1"))
def validation_ready(spark, folder):
    return ready_methods(spark, folder)


@register("live_metrics_gated", live_sql("(SELECT * FROM e WHERE method = 'a' OR NOT EXISTS (SELECT 1 FROM units WHERE split = 'val' AND unit_id % 13 = 0))"))
def live_metrics_gated(spark, folder):
    """A method whose VAL work is unfinished has no frozen threshold and no TEST row."""
    frozen = E.freeze_thresholds(frozen_threshold(spark, folder), ready_methods(spark, folder))
    return E.live_totals(E.live_counts(test_pixels(spark, folder), frozen))


@register("live_metrics_stream", LIVE)
def live_metrics_stream(spark, folder):
    """TEST pixels arrive on a stream; each micro-batch adds its counts."""
    feed = event_stream(spark, folder, test_pixels(spark, folder), batches=3)
    frozen = cut_lineage(frozen_threshold(spark, folder))
    data = E.run_partials(feed, E.shared_folder(spark, "live"), lambda batch: E.live_counts(batch, frozen))
    return E.live_totals(spark.read.parquet(data))


@register("live_metrics_frozen", live_sql("(SELECT * FROM e WHERE method = 'a' OR NOT EXISTS (SELECT 1 FROM units WHERE split = 'val' AND unit_id % 13 = 0))"))
def live_metrics_frozen(spark, folder):
    """Thresholds freeze inside the stream: TEST work arrives first, and method c never finishes its VAL work."""
    scored = long_scores(spark, folder).join(units(spark, folder).filter("split IN ('val', 'test')").select("unit_id", "building_id", "split"), "unit_id").filter("label IS NOT NULL")
    pixels = stored(scored.select("method", "building_id", "unit_id", "split", "label", "score"), "scored")
    plan = stored(pixels.groupBy("method", "building_id").agg(F.count_if(F.col("split") == "val").alias("expected")), "plan")
    came = pixels.filter("split = 'test' OR method = 'a' OR unit_id % 13 != 0").select("method", "building_id", "unit_id", "split", "label", "score")
    feed = fed(spark, [came.filter("split = 'test'"), came.filter("split = 'val' AND unit_id % 2 = 0"), came.filter("split = 'val' AND unit_id % 2 = 1")])
    return V.run_live(feed, plan, E.shared_folder(spark, "live")).select("method", "building_id", "tp", "fp", "fn", "tn")


def map_files(spark, folder):
    """One npz score map per (sequence, frame), as rows of (path, content)."""
    def pack(group):
        side, sequence, frame = 8, group["sequence_id"][0], group["frame"][0]
        plane, support = np.full((side, side), np.nan, np.float32), np.zeros((side, side), bool)
        y, x = group["y"], group["x"]
        plane[y, x], support[y, x] = group["value"].astype(np.float32) / 50, True
        native = np.zeros((side, side), bool)
        native[y, x] = group["bits"] > 8
        broken = sequence % 17 == 0 and frame == 0
        buffer = io.BytesIO()
        np.savez_compressed(buffer, scores=plane.astype(np.float64) if broken else plane, support=support, native=native)
        return {"path": [f"{sequence}_{frame}.npz"], "content": np.array([buffer.getvalue()], object)}

    return sorted_groups(frame_grid(spark, folder), ["sequence_id", "frame"], pack, "path string, content binary")


MAP_SQL = """WITH f AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) - 1995 AS INTEGER) AS frame, (l_partkey // 8) % 8 AS y, l_partkey % 8 AS x, bit_or(CAST(1 << (l_linenumber - 1) AS INTEGER)) AS bits, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)
  SELECT CAST(s AS VARCHAR) || '_' || frame AS unit, CASE WHEN s % 17 = 0 AND frame = 0 THEN 0 ELSE count(*) END AS pixels, CASE WHEN s % 17 = 0 AND frame = 0 THEN 0 ELSE count(*) FILTER (WHERE bits > 8) END AS native_pixels,
  round(CASE WHEN NOT (s % 17 = 0 AND frame = 0) THEN max(CAST(v AS FLOAT) / 50::FLOAT)::DOUBLE END, 6) AS top, CASE WHEN s % 17 = 0 AND frame = 0 THEN 'scores_not_2d_float32' END AS problem FROM f GROUP BY s, frame"""


@register("loaded_maps", MAP_SQL)
def loaded_maps(spark, folder):
    """Packed npz maps parsed to pixels; some break the contract."""
    rows = maps.parse_maps(map_files(spark, folder))
    return rows.groupBy("unit").agg(
        F.count("score").alias("pixels"), F.count_if(F.coalesce("native", F.lit(False))).alias("native_pixels"),
        rounded(F.max("score").cast("double"), 6).alias("top"), F.max("problem").alias("problem"),
    )


@register("report_round_trip", """SELECT split, method, count(*) AS rows, CAST(sum(tp) AS BIGINT) AS tp FROM (SELECT m.method, """ + "CASE WHEN c_nationkey % 10 = 7 THEN 'val' WHEN c_nationkey % 10 >= 8 THEN 'test' ELSE 'train' END AS split" + """, l_orderkey,
  count(*) FILTER (WHERE l_returnflag = 'R' AND CASE m.method WHEN 'a' THEN CAST(l_discount * 10 AS FLOAT) > CAST(0.5 AS FLOAT) ELSE CAST(l_tax * 12.5 AS FLOAT) > CAST(0.4 AS FLOAT) END) AS tp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey, (VALUES ('a'), ('b')) m(method) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def report_round_trip(spark, folder):
    """The wide report: one CSV folder per (split, method), read back."""
    target = E.shared_folder(spark, "report")
    rows = case_rows(spark, folder).select("split", "method", "unit_id", "tp", "fp", F.struct("fn", "tn").alias("rest"))
    tables.write_wide_report(rows, target, ("split", "method"))
    back = spark.read.option("header", True).schema("unit_id bigint, tp bigint, fp bigint, rest string, split string, method string").csv(target)
    return back.groupBy("split", "method").agg(F.count("*").alias("rows"), F.sum("tp").alias("tp"))
