"""Saved score maps (npz, npy) to long pixel rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "unit string, y int, x int, score float, support boolean, native boolean, problem string"
CHUNK = 1 << 18


def _arrays(path: str, raw: bytes):
    if path.endswith(".npz"):
        with np.load(io.BytesIO(raw), allow_pickle=False) as archive:
            return {k: archive[k] for k in archive.files if k in ("scores", "support", "native")}
    return {"scores": np.load(io.BytesIO(raw), allow_pickle=False)}


def _check(arrays):
    scores = arrays.get("scores")
    if scores is None:
        return "missing_scores"
    if scores.ndim != 2 or scores.dtype != np.float32:
        return "scores_not_2d_float32"
    for name in ("support", "native"):
        if name in arrays and (arrays[name].dtype != np.bool_ or arrays[name].shape != scores.shape):
            return f"{name}_not_matching_bool"
    support = arrays.get("support", np.isfinite(scores))
    if not np.isfinite(scores[support]).all():
        return "nonfinite_in_support"
    return None


def _columns(raw: pa.RecordBatch) -> Iterator[tuple]:
    """(unit, y, x, score, native, problem) with arrays of at most CHUNK pixels."""
    for path, content in zip(raw.column("path"), raw.column("content")):
        path = path.as_py()
        try:
            arrays = _arrays(path, content.as_py())
            problem = _check(arrays)
        except (ValueError, OSError) as error:
            arrays, problem = {}, str(error)[:80] or "unreadable"
        unit = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if problem:
            yield unit, None, None, None, None, problem
            continue
        scores = arrays["scores"]
        support = arrays.get("support", np.isfinite(scores))
        native = arrays.get("native", np.zeros(scores.shape, bool))
        ys, xs = np.nonzero(support)
        for start in range(0, len(ys), CHUNK):
            y, x = ys[start:start + CHUNK], xs[start:start + CHUNK]
            yield unit, y, x, scores[y, x], native[y, x], None


def _batch(parts) -> pa.RecordBatch:
    """Parts of several files as one batch; a problem is one row without a pixel."""
    sizes = [1 if p[5] else len(p[1]) for p in parts]
    broken = np.repeat([bool(p[5]) for p in parts], sizes)
    whole = lambda i, kind: pa.array(np.concatenate([np.zeros(1, kind) if p[5] else p[i].astype(kind, copy=False) for p in parts]), mask=broken)
    told = lambda i: pa.array([p[i] for p in parts], "string").take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
    return pa.RecordBatch.from_arrays(
        [told(0), whole(1, np.int32), whole(2, np.int32), whole(3, np.float32), pa.array(~broken, mask=broken), whole(4, np.bool_), told(5)],
        names=["unit", "y", "x", "score", "support", "native", "problem"],
    )


def _rows(batches):
    """Pixels of small files leave together, those of large ones in chunks."""
    held, rows = [], 0
    for raw in batches:
        for part in _columns(raw):
            held.append(part)
            rows += 1 if part[5] else len(part[1])
            if rows >= CHUNK:
                yield _batch(held)
                held, rows = [], 0
    if held:
        yield _batch(held)


def parse_maps(files: DataFrame) -> DataFrame:
    """Supported pixels of (path, content) rows; a contract breach is one problem row."""
    return files.select("path", "content").mapInArrow(_rows, SCHEMA)


def load_maps(spark: SparkSession, path, pattern="*.np[yz]") -> DataFrame:
    """Maps of a folder. Files are the unit of parallelism; pixels leave in bounded chunks."""
    return parse_maps(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def file_hashes(spark: SparkSession, path) -> DataFrame:
    """SHA-256 per file, computed where the bytes are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"), "length")
