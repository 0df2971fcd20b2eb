"""Thresholds that freeze inside a stream, and the TEST metrics that follow.

Scored pixels of VAL and TEST units arrive in any order. Tasks first reduce
them to counts per unit and threshold bucket. The state store keeps the counts
per (method, building, part), units being dealt over parts by hash: sparse
counts of the VAL units, one curve for all TEST units. A touched part sends the
sums of its units' curves and the pixels seen. A method whose planned VAL
pixels are all in gets its threshold, which is kept and never changes again;
only then do its TEST metrics appear, from the kept curves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlens.operators.calibrate import LINEAR_POINTS, TOLERANCE, linear_bucket, linear_threshold
from driftlens.streaming.events import newest, run_upserts
from driftlens.streaming.memory import ROCKS

BUCKETS = LINEAR_POINTS + 1
#: Parts of a (method, building).
PARTS = 64
COUNTS = "p array<bigint>, n array<bigint>"
UNITS = "units array<string>, buckets array<int>, p array<bigint>, n array<bigint>"
CURVES = "kind string, seen bigint, n_f1 bigint, n_fpr bigint, f1 array<double>, fpr array<double>, p array<bigint>, n array<bigint>"


def reduced(pixels: DataFrame) -> DataFrame:
    """Rows (method, building_id, unit_id, split, bucket, p, n): pixels of one record batch added up before anything is shuffled."""
    keys = ["method", "building_id", "unit_id", "split", "bucket"]
    staged = pixels.filter(F.col("label").isNotNull()).select(
        "method", "building_id", F.col("unit_id").cast("string").alias("unit_id"), "split", linear_bucket(F.col("score")).alias("bucket"),
        (F.col("label") == 1).cast("bigint").alias("p"), (F.col("label") == 0).cast("bigint").alias("n"),
    )

    def add(batches):
        for batch in batches:
            total = pa.Table.from_batches([batch]).group_by(keys).aggregate([("p", "sum"), ("n", "sum")])
            yield from total.select([*keys, "p_sum", "n_sum"]).rename_columns([*keys, "p", "n"]).cast(batch.schema).to_batches()

    return staged.mapInArrow(add, staged.schema)


def above(counts: np.ndarray) -> np.ndarray:
    """Counts above each threshold from counts per bucket."""
    return counts[..., ::-1].cumsum(-1)[..., ::-1][..., 1:]


def _runs(units: pd.DataFrame):
    """Columns of each unit; rows are sorted by unit."""
    name = units["unit"].to_numpy()
    edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1), len(name)]
    columns = {c: units[c].to_numpy() for c in ("bucket", "p", "n")}
    return ({c: v[a:b] for c, v in columns.items()} for a, b in zip(edges[:-1], edges[1:]))


def curve_sums(units: pd.DataFrame) -> tuple:
    """Numbers of units with and without positives, the sum of their F1 and of their FPR curves; rows are (unit, bucket, p, n)."""
    sums, counts = np.zeros((2, LINEAR_POINTS)), [0, 0]
    for rows in _runs(units):
        p, n = (np.bincount(rows["bucket"], rows[c], BUCKETS).astype(np.int64) for c in ("p", "n"))
        tp, fp, real, clean = above(p), above(n), p.sum(), n.sum()
        kind = 0 if real else 1
        if real or clean:
            sums[kind] += 2 * tp / (tp + fp + real) if real else fp / clean
            counts[kind] += 1
    return counts[0], counts[1], sums[0].tolist(), sums[1].tolist()


class PartCurves(StatefulProcessor):
    """Counts of one part of a (method, building): a call reads and writes them together."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.units = handle.getValueState("units", UNITS)
        self.test = handle.getValueState("test", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([part[["unit_id", "split", "bucket", "p", "n"]] for part in rows]).rename(columns={"unit_id": "unit"})
        out, val, test = [], came[came["split"] == "val"].drop(columns="split"), came[came["split"] == "test"]
        if len(val):
            if self.units.exists():
                val = pd.concat([pd.DataFrame(dict(zip(("unit", "bucket", "p", "n"), map(list, self.units.get())))), val])
            val = val.groupby(["unit", "bucket"], as_index=False)[["p", "n"]].sum()
            self.units.update(tuple(val[c].tolist() for c in ("unit", "bucket", "p", "n")))
            out.append(("val", int(val["p"].sum() + val["n"].sum()), *curve_sums(val), None, None))
        if len(test):
            added = [np.bincount(test["bucket"], test[c], BUCKETS).astype(np.int64) for c in ("p", "n")]
            if self.test.exists():
                added = [a + np.array(b) for a, b in zip(added, self.test.get())]
            total = tuple(a.tolist() for a in added)
            self.test.update(total)
            out.append(("test", None, None, None, None, None, *total))
        if out:
            made = pd.DataFrame(out, columns=["kind", "seen", "n_f1", "n_fpr", "f1", "fpr", "p", "n"]).astype({c: "Int64" for c in ("seen", "n_f1", "n_fpr")})
            for name, value in reversed(list(zip(("method", "building_id", "part"), key))):
                made.insert(0, name, value)
            yield made

    def close(self) -> None:
        pass


def curve_stream(pixels: DataFrame) -> DataFrame:
    """Changed sums of curves per (method, building_id, part, kind) of a stream of scored pixels."""
    pixels.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ddl = f"method {pixels.schema['method'].dataType.simpleString()}, building_id {pixels.schema['building_id'].dataType.simpleString()}, part bigint, {CURVES}"
    dealt = reduced(pixels).withColumn("part", F.pmod(F.xxhash64("unit_id"), F.lit(PARTS)))
    return dealt.groupBy("method", "building_id", "part").transformWithStateInPandas(PartCurves(), ddl, "update", "None")


def frozen(curves: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (method, threshold_index, threshold) of methods whose planned VAL work is complete; one row per building, part and kind is read."""
    val = curves.filter("kind = 'val'")
    wanted = plan.filter("expected > 0").join(val.groupBy("method", "building_id").agg(F.sum("seen").alias("_seen")), ["method", "building_id"], "left")
    ready = wanted.groupBy("method").agg(F.bool_and(F.coalesce("_seen", F.lit(0)) >= F.col("expected")).alias("_all")).filter("_all").select("method")
    at = F.explode(F.sequence(F.lit(0), F.lit(LINEAR_POINTS - 1))).alias("threshold_index")
    points = val.join(ready, "method", "left_semi").select("method", "building_id", "n_f1", "n_fpr", "f1", "fpr", at)
    mean = lambda c: F.try_divide(F.sum(F.get(c, F.col("threshold_index"))), F.sum(f"n_{c}")).alias(c)
    building = points.groupBy("method", "building_id", "threshold_index").agg(mean("f1"), mean("fpr"))
    curve = building.groupBy("method", "threshold_index").agg(F.avg("f1").alias("f1"), F.avg("fpr").alias("fpr"))
    best = curve.groupBy("method").agg(F.max("f1").alias("_best"))
    tied = curve.join(best, "method").filter(F.col("f1") >= F.col("_best") - TOLERANCE)
    low = tied.groupBy("method").agg(F.min("fpr").alias("_low"))
    kept = tied.join(low, "method").filter(F.col("fpr") <= F.col("_low") + TOLERANCE)
    return kept.groupBy("method").agg(F.max("threshold_index").alias("threshold_index")).withColumn("threshold", linear_threshold(F.col("threshold_index")).cast("double"))


def test_metrics(curves: DataFrame, thresholds: DataFrame) -> DataFrame:
    """TEST counts per method and building at the frozen thresholds."""
    over = lambda c: F.aggregate(F.slice(c, F.col("threshold_index") + 2, BUCKETS), F.lit(0).cast("bigint"), lambda a, v: a + v)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    rows = curves.filter("kind = 'test'").join(thresholds, "method")
    counts = rows.select("method", "building_id", "threshold", over("p").alias("tp"), over("n").alias("fp"), (total("p") - over("p")).alias("fn"), (total("n") - over("n")).alias("tn"))
    return counts.groupBy("method", "building_id", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def run_live(pixels: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Drain the stream; every epoch leaves its TEST metrics in ``folder/metrics``, the last ones are returned.

    Thresholds of an epoch are those of the one before and those frozen since, so a frozen one never moves.
    """
    def publish(curves: DataFrame, epoch: int) -> None:
        spark, path = curves.sparkSession, lambda e: f"{folder}/thresholds/epoch={e}"
        now = frozen(curves, plan)
        if epoch:
            past = spark.read.schema(now.schema).parquet(path(epoch - 1))
            now = past.unionByName(now.join(past, "method", "left_anti"))
        now.write.mode("overwrite").parquet(path(epoch))
        test_metrics(curves, spark.read.schema(now.schema).parquet(path(epoch))).write.mode("overwrite").parquet(f"{folder}/metrics/epoch={epoch}")

    table = run_upserts(curve_stream(pixels), folder, ["method", "building_id", "part", "kind"], publish)
    return newest(pixels.sparkSession, folder + "/metrics", "epoch", test_metrics(table, frozen(table, plan)).schema)
