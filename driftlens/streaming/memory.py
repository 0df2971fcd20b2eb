"""Change memory per (sequence, cell): batch form and Structured Streaming form.

A cell keeps up to K recent values of its current episode. A new value scores
the least distance to them (the oldest wins ties); a score above the threshold
is a change, which clears the memory and starts a new episode. An unobserved or
undefined value neither scores nor updates.

The memory before a value is always the last m values, m = min(K, values since
the episode began). So a cell is an automaton with K + 1 states, and a stretch
of frames is a function from states to states. Functions compose, which lets
one long history be cut into chunks that run in parallel (``operators.scan``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlens.operators.scan import exclusive
from driftlens.session import stored

CHUNK = 64
#: Parts of the state of a stream.
BUCKETS = 1024


def _move(at: Column, row: Column, k: int, threshold: float) -> Column:
    """(state, episode start) after a row that carries least distances d1..dk."""
    score = F.when(at["state"] > 0, F.get(row["d"], at["state"] - 1))
    opens = (at["state"] == 0) | F.coalesce(score > threshold, F.lit(False))
    return F.struct(
        F.when(opens, 1).otherwise(F.least(at["state"] + 1, F.lit(k))).alias("state"), F.when(opens, row["frame"]).otherwise(at["start"]).alias("start"),
    )


def _then(first: Column, second: Column) -> Column:
    """Composition of two functions given as arrays: for each entry state the end state and the last episode start, if any."""
    def after(end):
        then = F.get(second, end["state"])
        return F.struct(then["state"].alias("state"), F.coalesce(then["start"], end["start"]).alias("start"))

    return F.transform(first, after)


def _entered(at: Column, function: Column) -> Column:
    then = F.get(function, at["state"])
    return F.struct(then["state"].alias("state"), F.coalesce(then["start"], at["start"]).alias("start"))


def _place(state: int) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(None).cast("bigint").alias("start"))


def memory_batch(observations: DataFrame, keys, k=3, threshold=0.0, chunk=CHUNK) -> DataFrame:
    """Scores, changes and episodes of every finite observation.

    Needs keys, ``frame`` (dense index per key) and ``value``. No row holds more
    than ``chunk`` frames or ``scan.FAN`` chunks: the values before a chunk and
    the state it is entered with come from scans over the chunks of a key.
    """
    keys = list(keys)
    seen = observations.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        *keys, F.floor(F.col("frame") / chunk).alias("_c"), F.col("frame").cast("bigint").alias("frame"), F.col("value").cast("double").alias("value")
    )
    chunks = stored(seen.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("_rows")), "memory-chunks")
    # The last k values of a chunk, latest first; of two chunks, the later one's come first.
    tail = F.slice(F.reverse(F.transform("_rows", lambda r: r["value"])), 1, k)
    recent = exclusive(chunks.select(*keys, "_c", tail.alias("_t")), keys, "_c", "_t", lambda a, b: F.slice(F.concat(b, a), 1, k), F.array().cast("array<double>"))
    joined = chunks.join(recent, [*keys, "_c"]).withColumn("_all", F.concat(F.reverse("before"), F.transform("_rows", lambda r: r["value"])))
    gap = lambda r, i, j: F.abs(r["value"] - F.get("_all", F.size("before") + i - j))
    nearest = lambda r, i, j: gap(r, i, 1) if j == 1 else F.least(*[gap(r, i, m) for m in range(1, j + 1)])
    steps = F.transform("_rows", lambda r, i: F.struct(r["frame"].alias("frame"), r["value"].alias("value"), F.array(*[nearest(r, i, j) for j in range(1, k + 1)]).alias("d")))
    stepped = joined.select(*keys, "_c", steps.alias("_steps"))
    every = F.array(*[_place(i) for i in range(k + 1)])
    whole = F.aggregate("_steps", every, lambda ends, r: F.transform(ends, lambda e: _move(e, r, k, threshold)))
    # Read twice below (functions first, then the replay): keep it, do not rebuild it.
    stepped = stored(stepped.withColumn("_map", whole), "memory-steps")
    enter = exclusive(stepped, keys, "_c", "_map", _then, _place(0), _entered)
    empty = F.transform(F.slice("_steps", 1, 0), lambda r: _outcome(_place(0), r, k, threshold))
    replay = F.aggregate("_steps", F.struct(F.col("before").alias("at"), empty.alias("out")), lambda s, r: F.struct(
        _move(s["at"], r, k, threshold).alias("at"), F.concat(s["out"], F.array(_outcome(s["at"], r, k, threshold))).alias("out"),
    ))
    return stepped.join(enter, [*keys, "_c"]).select(*keys, F.inline(replay["out"]))


def _outcome(at: Column, row: Column, k: int, threshold: float) -> Column:
    score = F.when(at["state"] > 0, F.get(row["d"], at["state"] - 1))
    return F.struct(
        row["frame"].alias("frame"), row["value"].alias("value"), score.alias("score"), (at["state"] == 0).alias("initialised"),
        F.coalesce(score > threshold, F.lit(False)).alias("changed"), at["state"].alias("references"), _move(at, row, k, threshold)["start"].alias("episode_start"),
    )


#: What a cell keeps; also the columns of an exported memory, after its keys.
STATE = "frames array<bigint>, vals array<double>, episode_start bigint, last_frame bigint"
WAITING = "at bigint, frame bigint, value double"
RESULT = "frame long, value double, score double, initialised boolean, changed boolean, references int, episode_start long, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def names_of(ddl: str) -> list[str]:
    return [column.split(" ")[0] for column in ddl.split(", ")]


def packed(cell: str, ddl: str) -> str:
    """Many rows (cell and columns) of a state in one list entry."""
    return f"rows array<struct<cell: {cell}, " + ", ".join(column.replace(" ", ": ", 1) for column in ddl.split(", ")) + ">>"


def memory_state(rows: DataFrame, keys, k=3) -> DataFrame:
    """The memories left after ``memory_batch`` rows: keys and STATE, one row per cell with a value."""
    keys = list(keys)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frame")))
    kept = rows.withColumn("_b", back).filter(F.col("_b") <= k)
    held = F.array_sort(F.collect_list(F.struct("frame", "value", "episode_start")))
    last = kept.groupBy(*keys).agg(held.alias("_h")).withColumn("_e", F.element_at("_h", -1))
    inside = F.filter("_h", lambda h: h["frame"] >= F.col("_e.episode_start"))
    return last.select(
        *keys, F.transform(inside, lambda h: h["frame"]).alias("frames"), F.transform(inside, lambda h: h["value"]).alias("vals"),
        F.col("_e.episode_start").alias("episode_start"), F.col("_e.frame").alias("last_frame"),
    )


def memory_problems(states: DataFrame, keys, k=3) -> DataFrame:
    """Rows (keys, problem) of saved memories that no run can have left behind."""
    keys = list(keys)
    c, n = F.col, F.size("frames")
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    rising = (n < 2) | F.forall(steps, lambda i: F.coalesce(F.get("frames", i) > F.get("frames", i - 1), F.lit(False)))
    checks = F.array_compact(F.array(
        F.when(c("frames").isNull() | c("vals").isNull() | c("last_frame").isNull() | c("episode_start").isNull(), "missing_field"),
        F.when(n != F.size("vals"), "frames_and_values_differ"),
        F.when(n > k, "over_capacity"),
        F.when(n == 0, "no_exemplar"),
        F.when(~rising | (F.array_min("frames") < 0), "frames_not_rising"),
        F.when(F.exists("vals", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "value_not_finite"),
        F.when(F.array_max("frames") > c("last_frame"), "frame_after_the_last"),
        F.when(F.array_min("frames") < c("episode_start"), "exemplar_before_its_episode"),
        F.when(c("episode_start") < 0, "episode_not_begun"),
    ))
    twice = states.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("repeated_cell").alias("problem"))
    return states.select(*keys, F.explode(checks).alias("problem")).unionByName(twice)


def checked_memory(states: DataFrame, keys, k=3) -> DataFrame:
    """The states again; raises ValueError with some of the broken cells if there are any."""
    bad = memory_problems(states, keys, k).limit(5).collect()
    if bad:
        raise ValueError(f"saved memories are broken: {[tuple(r) for r in bad]}")
    return states


def _advance(memory, frame, value, k, threshold):
    """One observation against a memory of (frames, values, episode start)."""
    frames, values, start = memory
    score = min((abs(value - v) for v in values), default=None)
    changed = score is not None and score > threshold
    row = (score, not values, changed, len(values))
    if changed or not values:
        frames, values, start = [], [], frame
    return ((frames + [frame])[-k:], (values + [value])[-k:], start), row


def _masked(frame: DataFrame, names, bucket: Column) -> list[Column]:
    """Bucket, cells as k0.. and frame; whole numbers lose their NULLs, which pandas would turn into floats, to bits of ``nulls``."""
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds, bits, out = dict(frame.dtypes), F.lit(0).cast("bigint"), [bucket.alias("bucket")]
    for i, name in enumerate(names):
        column = F.col(f"`{name}`")
        bits = bits + F.when(column.isNull(), F.lit(1 << i)).otherwise(0)
        out.append((F.coalesce(column, F.lit(0).cast(kinds[name])) if kinds[name] in whole else column).alias(f"k{i}"))
    return [*out, bits.alias("nulls")]


def _bucket(names, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(buckets))


NAN = float("nan")


def _hashable(value):
    """NaN is one value here, as in Spark's grouping."""
    if value != value:
        return NAN
    return bytes(value) if isinstance(value, bytearray) else value


class CellMemory(StatefulProcessor):
    """The memories of one bucket of cells. With ``ordered``, rows wait until the watermark has passed them.

    A call costs far more than a row, so a bucket's memories are read and
    written together and its rows are taken in one pass.
    """

    #: Rows of a list entry; every entry is a message of its own.
    PART = 512

    def __init__(self, names: list[str], cell: str, k: int, threshold: float, ordered: bool):
        self.names, self.cell, self.k, self.threshold, self.ordered = names, cell, k, threshold, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getListState("memory", packed(self.cell, STATE))
        if self.ordered:
            self.waiting = handle.getListState("waiting", packed(self.cell, WAITING))
            self.due = handle.getValueState("due", "at bigint")

    def cells(self, rows: pd.DataFrame) -> list[tuple]:
        """The key of every row as plain values."""
        nulls, columns = rows["nulls"].to_numpy(), []
        for i in range(len(self.names)):
            column = rows[f"k{i}"].tolist()
            gone = (nulls >> i) & 1
            if gone.any() or rows[f"k{i}"].dtype.kind not in "iub":
                column = [None if g else _hashable(v) for v, g in zip(column, gone.tolist())]
            columns.append(column)
        return list(zip(*columns))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.append(self.memory, [
            (cell, [int(f) for f in r.frames], [float(v) for v in r.vals], int(r.episode_start), int(r.last_frame))
            for cell, r in zip(self.cells(initialState), initialState.itertuples(index=False))
        ])

    def entries(self, rows) -> list[tuple]:
        return [(rows[start:start + self.PART],) for start in range(0, len(rows), self.PART)]

    def append(self, state, rows) -> None:
        state.appendList(self.entries(rows))

    def put(self, state, rows) -> None:
        state.put(self.entries(rows))

    @staticmethod
    def held(state) -> Iterator[tuple]:
        return (row for entry in state.get() for row in entry[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, now, late = [], timerValues.getCurrentWatermarkInMs() if self.ordered else None, []
        for part in rows:
            part = part[(part["nulls"].to_numpy() >> len(self.names)) & 1 == 0]
            cells, frames, values = self.cells(part), part["frame"].tolist(), part["value"].tolist()
            if not self.ordered:
                seen += zip(frames, cells, values)
                continue
            for cell, at, frame, value in zip(cells, part["at"].tolist(), frames, values):
                if at <= now:
                    late.append((cell, frame, value, None, False, False, 0, None, True))
                else:
                    seen.append((cell, int(at), frame, None if value != value else value))
        if not self.ordered:
            # Sorted as a whole, since parts of a micro-batch come in any order; the source bounds the micro-batch.
            seen.sort(key=lambda r: r[0])
            yield self.taken((cell, frame, value) for frame, cell, value in seen)
            return
        if seen:
            self.append(self.waiting, seen)
            self.remind(min(r[1] for r in seen))
        if late:
            yield self.table(late)

    def remind(self, at: int) -> None:
        """One timer at the earliest waiting row; later rows do not add their own."""
        if not self.due.exists() or at < self.due.get()[0]:
            self.due.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] > now:
            return
        held = list(self.held(self.waiting))
        ready, rest = [r for r in held if r[1] <= now], [(tuple(r[0]), *r[1:]) for r in held if r[1] > now]
        self.due.clear()
        if rest:
            self.put(self.waiting, rest)
            self.remind(min(r[1] for r in rest))
        else:
            self.waiting.clear()
        ready.sort(key=lambda r: (r[1], r[2]))
        if ready:
            yield self.taken((tuple(cell), frame, value) for cell, _, frame, value in ready)

    def taken(self, rows) -> pd.DataFrame:
        """Rows (cell, frame, value) in their order; those not after their cell's last frame are late and leave the memory alone."""
        held = {tuple(map(_hashable, r[0])): (list(r[1]), list(r[2]), r[3], r[4]) for r in self.held(self.memory)}
        out, changes = [], 0
        for cell, frame, value in rows:
            frames, values, start, last = held.get(cell) or ([], [], -1, -1)
            if frame <= last:
                out.append((cell, frame, value, None, False, False, len(values), start, True))
                continue
            changes += 1
            if value is None or value != value:
                held[cell] = frames, values, start, frame
                continue
            (frames, values, start), row = _advance((frames, values, start), frame, value, self.k, self.threshold)
            out.append((cell, frame, value, *row, start, False))
            held[cell] = frames, values, start, frame
        if changes:
            self.put(self.memory, [(cell, *state) for cell, state in held.items()])
        return self.table(out)

    def table(self, rows) -> pd.DataFrame:
        made = pd.DataFrame([r[1:] for r in rows], columns=names_of(RESULT))
        made["episode_start"] = made["episode_start"].astype("Int64")
        keys = list(zip(*[r[0] for r in rows])) or [()] * len(self.names)
        for i, (name, column) in reversed(list(enumerate(zip(self.names, keys)))):
            made.insert(0, name, pd.Series(column, dtype=object, index=made.index))
        return made

    def close(self) -> None:
        pass


def memory_stream(observations: DataFrame, keys=("sequence_id", "cell"), k=3, threshold=0.0, clock=None, delay=None, initial: DataFrame | None = None, buckets=BUCKETS) -> DataFrame:
    """The same memory on a stream of (keys, frame, value); keys may have any names and types.

    State lives in the checkpointed state store, so a restart continues where it
    stopped; ``initial`` (keys and STATE) lets a new query continue the memories
    another one exported. Cells are dealt over ``buckets`` by hash, and a
    micro-batch rewrites the memories of the buckets it touches; like the number
    of shuffle partitions, ``buckets`` stays as it is as long as a checkpoint lives.

    Without ``clock``, rows are taken as they arrive; rows at or before a cell's
    last frame leave with ``late`` set and never touch the memory. With
    ``clock`` (a timestamp column) and ``delay``, rows wait in the state until
    the watermark has passed them and are then taken by (time, frame), so any
    arrival order within the delay gives the same result; rows behind the
    watermark leave with ``late`` set. A row without a frame only moves the clock.
    """
    keys, spark = list(keys), observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    typed = [f"`{n}` {observations.schema[n].dataType.simpleString()}" for n in keys]
    rows, bucket = observations, _bucket(keys, buckets)
    if clock:
        # A computed column is free of the watermark's own filter: late rows reach the side output instead of being dropped.
        rows = rows.withWatermark(clock, delay).withColumn("at", F.unix_millis(clock))
    # A row without a frame is kept up to here, for its clock; its bit tells it apart.
    *cells, nulls = _masked(rows, keys, bucket)
    nulls = (nulls + F.when(F.col("frame").isNull(), F.lit(1 << len(keys))).otherwise(0)).alias("nulls")
    rows = rows.select(*cells, nulls, F.coalesce(F.col("frame").cast("bigint"), F.lit(0)).alias("frame"), F.col("value").cast("double").alias("value"), *(["at"] if clock else []))
    start = None
    if initial is not None:
        saved = checked_memory(initial, keys, k).select(*[F.col(f"`{n}`").cast(observations.schema[n].dataType).alias(n) for n in keys], *names_of(STATE))
        start = saved.select(*_masked(saved, keys, bucket), *names_of(STATE)).groupBy("bucket")
    processor = CellMemory(keys, f"struct<{', '.join(t.replace('` ', '`: ', 1) for t in typed)}>", k, threshold, bool(clock))
    return rows.groupBy("bucket").transformWithStateInPandas(processor, ", ".join([*typed, RESULT]), "append", "EventTime" if clock else "None", initialState=start)


def exported_memory(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The memories in a query's state store, as rows (keys, STATE); NULL and late-only cells hold no exemplar and are left out."""
    saved = spark.read.format("statestore").option("stateVarName", "memory").load(checkpoint)
    return saved.select(F.inline("list_element.rows")).select("cell.*", *names_of(STATE)).filter(F.size("frames") > 0)


def exported_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows still waiting for the watermark, as (keys, at, frame, value)."""
    saved = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return saved.select(F.inline("list_element.rows")).select("cell.*", *names_of(WAITING))
