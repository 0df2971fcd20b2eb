"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn unit vectors into balanced binary
codes: principal directions, then alternating sign codes and the best rotation
onto them, from several random starts. Codes are cut into substrings, one hash
table each. Vectors whose substrings agree in the leading bits and differ in at
most one of the others in some table are candidates; those within the radius in
the first two codes are compared by cosine in double precision with the
original vectors. A pair counts in its first matching table only.

Substrings grow with the logarithm of the rows, and a longer one matches less
often. So tables, from further rotations once a code is used up, are added
until the first code is used up and ``RECALL`` of the pairs planted at the
threshold cosine are found. Where
``TABLES`` do not reach it, substrings are shortened, down to comparing all pairs.

Equal vectors are one class with a weight, so copies cost nothing. A table is
dealt by the leading bits of the substring. Parts with more rows than ``PART``
are cut into blocks of queries against blocks of rows, so no bucket is capped
and none lands in one task. Tasks return link counts and spanning links, not pairs.

NULL vectors, zero vectors and vectors with NULL or non-finite components link
with nothing. Vectors of different length never link. Rows without an id take
part: a component is named by its least id, or NULL when it has none, and then
one of its rows stays. Rotations are learned on the ``SAMPLE`` vectors with the
smallest hashes; every vector is indexed.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, table, written
from driftlens.llm.components import components

COSINE, BITS, RADIUS, SAMPLE, PART, STEPS = 0.9, 64, 26, 4096, 12_000, 40
#: Rows per substring value, share of pairs at ``COSINE`` to find, most tables per width, pairs planted to measure it.
FILL, RECALL, TABLES, PLANTED = 32, 0.99, 128, 4096


class Plan(NamedTuple):
    """Learned codes and the hash tables over them; ``each`` tables share a code."""

    models: list
    tables: int
    each: int
    width: int
    lead: int
    radius: int


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn(vectors: np.ndarray, bits: int = BITS, steps: int = STEPS, seed: int = 7):
    """Mean and projection whose signs are the code."""
    x = unit(vectors)
    mean = x.mean(0)
    x = x - mean
    bits = min(bits, x.shape[1])
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    directions = directions[:bits].T
    if directions.shape[1] < bits:
        directions = np.concatenate([directions, np.linalg.qr(np.eye(x.shape[1])[:, :bits])[0][:, directions.shape[1]:]], 1)
    spread = x @ directions
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(steps):
        codes = np.where(spread @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ spread)
        rotation = (left @ right).T
    return mean, directions @ rotation


def encode(vectors: np.ndarray, models: list) -> np.ndarray:
    """One code per vector and model."""
    x = unit(vectors)
    codes = np.empty((len(x), len(models)), np.uint64)
    for k, (mean, projection) in enumerate(models):
        signs = (x - mean) @ projection >= 0
        codes[:, k] = (signs * (np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64))).sum(1, dtype=np.uint64)
    return codes


def planted(vectors: np.ndarray):
    """Unit vectors and partners at the threshold cosine, turned to another vector where ``inward`` and any way elsewhere."""
    rng = np.random.default_rng(11)
    x = unit(vectors)[np.arange(PLANTED) % len(vectors)]
    way, inward = rng.normal(size=x.shape), np.arange(len(x)) % 2 == 0
    way[inward] = x[rng.permutation(len(x))[inward]]
    way -= (way * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(way, axis=1)
    some = size > 1e-6
    return x[some], COSINE * x[some] + math.sqrt(1 - COSINE**2) * way[some] / size[some, None], inward[some]


def substring(codes: np.ndarray, number: int, plan: Plan) -> np.ndarray:
    code, place = divmod(number, plan.each)
    return (codes[:, code] >> np.uint64(place * plan.width)) & np.uint64((1 << plan.width) - 1)


def meet(one: np.ndarray, other: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether a table makes candidates of these substrings."""
    apart = one ^ other
    return (apart >> np.uint64(plan.width - plan.lead) == 0) & (np.bitwise_count(apart) <= 1)


def choose(sample: np.ndarray, n: int) -> Plan:
    """Codes and tables for ``n`` vectors like those of ``sample``, by the pairs planted in it."""
    bits = min(BITS, sample.shape[1])
    a, b, inward = planted(sample)
    models, ours, theirs = [], [], []
    for width in range(max(1, min(bits, round(math.log2(max(2, n / FILL))))), 0, -1):
        lead = max(0, min(width - 1, math.ceil(math.log2(max(1, n * 3 / PART)))))
        plan = Plan(models, 0, bits // width, width, lead, RADIUS)
        found = np.zeros(len(a), bool)
        for t in range(TABLES):
            if t // plan.each == len(models):
                models.append(learn(sample, seed=7 + len(models)))
                ours.append(encode(a, models[-1:]))
                theirs.append(encode(b, models[-1:]))
            one, two = (np.concatenate(c, 1) for c in (ours, theirs))
            found |= meet(substring(one, t, plan), substring(two, t, plan), plan)
            if t + 1 >= plan.each and all(found[k].mean() >= RECALL for k in (inward, ~inward) if k.any()):
                used = t // plan.each + 1
                apart = np.bitwise_count(one[:, : min(2, used)] ^ two[:, : min(2, used)])
                return plan._replace(models=models[:used], tables=t + 1, radius=int(max(RADIUS, apart.max(initial=0))))
    raise AssertionError("one bit finds every pair")


def matrix(column, kind=np.float32) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), kind).reshape(len(flat), -1)


def coded(classes: DataFrame, plans: dict) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast({dim: plan.models for dim, plan in plans.items()})
    ddl, schema = arrow_schema(classes, "node long, weight long, dim int, embedding array<float>, codes array<long>")

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = encode(matrix(part.column("embedding")), shared.value[int(dim)])
                lists = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], codes.view(np.int64).ravel())
                columns = [*part.columns, lists]
                yield pa.record_batch([c.cast(schema.field(k).type) for k, c in enumerate(columns)], schema=schema)

    return classes.select("node", "weight", "dim", "embedding").mapInArrow(run, ddl)


def near(own: np.ndarray, probe: np.ndarray, free: int):
    """Candidate (probe, own) places in one table part: the ``free`` low bits at most one bit apart."""
    low = np.uint64((1 << free) - 1)
    order = np.argsort(own & low, kind="stable")
    keys = (own & low)[order]
    for mask in [np.uint64(0), *[np.uint64(1 << j) for j in range(free)]]:
        wanted = (probe & low) ^ mask
        first, past = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        sizes = past - first
        done = 0
        while done < len(probe):
            upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), 400_000, "right")) + done)
            n = sizes[done:upto]
            if n.sum():
                at = np.repeat(first[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(np.arange(done, upto), n), order[at]
            done = upto


def compare(rows: pa.Table, number: int, plan: Plan):
    """Link counts per probe and linked pairs of one task."""
    codes = matrix(rows.column("codes"), np.int64).view(np.uint64)
    kind, node, weight = (rows.column(c).to_numpy() for c in ("kind", "node", "weight"))
    x = unit(matrix(rows.column("embedding")))
    own, probe = np.flatnonzero(kind != 1), np.flatnonzero(kind != 0)
    mine = substring(codes, number, plan)
    before = [substring(codes, t, plan) for t in range(number)]
    close = [np.ascontiguousarray(codes[:, k]) for k in range(min(2, codes.shape[1]))]
    counts, pairs = np.zeros(len(node), np.int64), []
    if not len(own) or not len(probe):
        return node, counts, pairs
    for a, b in near(mine[own], mine[probe], plan.width - plan.lead):
        a, b = probe[a], own[b]
        for code in close:
            keep = np.bitwise_count(code[a] ^ code[b]) <= plan.radius
            a, b = a[keep], b[keep]
        keep = node[a] != node[b]
        a, b = a[keep], b[keep]
        for one in before:
            keep = ~meet(one[a], one[b], plan)
            a, b = a[keep], b[keep]
        for k in range(0, len(a), 50_000):
            p, q = a[k: k + 50_000], b[k: k + 50_000]
            linked = np.einsum("ij,ij->i", x[p], x[q]) >= COSINE
            counts += np.bincount(p[linked], weight[q[linked]], len(node)).astype(np.int64)
            pairs.append((node[p[linked]], node[q[linked]]))
    return node, counts, pairs


def spanning(pairs) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of linked nodes."""
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def classes_of(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding as floats or NULL when it links with nothing)."""
    good = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    usable = F.col("embedding").isNotNull() & ~F.coalesce(good, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    # 0.0 and -0.0 are one value.
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("float"))
    return vectors.select("vec_id", F.when(usable, plain).alias("embedding"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row."""
    rows = classes_of(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")))
    # Rows without an id get a number that tells them apart.
    unnamed = written(rows.filter(F.col("vec_id").isNull()).withColumn("_row", F.monotonically_increasing_id()), "unnamed")
    rows = rows.filter(F.col("vec_id").isNotNull()).withColumn("_row", F.lit(None).cast("long")).unionByName(unnamed)
    usable = rows.filter(F.col("embedding").isNotNull())
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.min("_row").alias("least_row"), F.count("*").alias("weight"))
    grouped = grouped.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id())
    grouped = written(grouped, "classes")
    totals = {r["dim"]: r["n"] for r in grouped.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    plans = {}
    for dim, n in totals.items():
        sample = grouped.filter(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").toArrow()
        plans[dim] = choose(matrix(sample.column("embedding")), n)
    codes = written(coded(grouped, plans), "codes")
    counted = None
    for dim, plan in plans.items():
        got = search(codes.filter(F.col("dim") == dim), plan)
        counted = got if counted is None else counted.unionByName(got)
    if counted is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted = written(counted, "links")
    sums = counted.filter(F.col("links") > 0).groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(counted.filter(F.col("least").isNotNull()).select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = grouped.select("node", "weight", "least_id", "least_row", F.col("embedding").alias("_e")).join(sums, "node", "left")
    named = named.join(joined.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("node") == F.col("_a"), "left")
    named = named.withColumn("root", F.coalesce("_b", "node"))
    # Written, so that the join sees plain rows and can split a large component.
    ids = written(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("least_row").alias("first")), "ids")
    named = named.join(ids, "root").select("_e", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "first")
    out = rows.join(named, F.col("embedding") == F.col("_e"), "left")
    alone = F.col("_e").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    first = F.when(F.col("component_id").isNull(), F.col("_row") == F.col("first")).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (alone | first).alias("kept"))


def search(codes: DataFrame, plan: Plan) -> DataFrame:
    """Rows (node, links, least) over the tables of one vector length."""
    plan = plan._replace(models=[])
    width, high = plan.width, ((1 << plan.lead) - 1) << (plan.width - plan.lead)
    part = lambda t: F.shiftright(F.col("codes")[t // plan.each], t % plan.each * width).bitwiseAND(F.lit(high).cast("long"))
    own = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), part(t).alias("at")) for t in range(plan.tables)]))
    sizes = codes.select(own.alias("s")).groupBy(F.col("s.t").alias("_t"), F.col("s.at").alias("_at")).agg(F.ceil(F.count("*") / PART).cast("int").alias("cuts"))
    sent = codes.withColumn("s", own).select("node", "weight", "embedding", "codes", "s.*")
    sent = sent.join(sizes, (F.col("t") == F.col("_t")) & (F.col("at") == F.col("_at")))
    block, last = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.sequence(F.lit(0), F.col("cuts") - 1)
    # A row of a cut part is a target in its own block for all query blocks, and a query of its block for all targets.
    as_query = F.transform(last, lambda k: F.struct(k.alias("p"), block.alias("q"), F.when(k == block, 2).otherwise(1).alias("role")))
    as_target = F.transform(F.filter(last, lambda k: k != block), lambda k: F.struct(block.alias("p"), k.alias("q"), F.lit(0).alias("role")))
    spots = F.explode(F.concat(as_query, as_target))
    tasks = sent.withColumn("r", spots).select("t", "at", F.col("r.p").alias("p"), F.col("r.q").alias("q"), F.col("r.role").alias("kind"), "node", "weight", "embedding", "codes")

    def run(key, rows):
        node, counts, pairs = compare(rows, key[0].as_py(), plan)
        some = np.flatnonzero(counts)
        inner, least = spanning(pairs)
        return pa.table({
            "node": pa.array(np.concatenate([node[some], inner])), "links": pa.array(np.concatenate([counts[some], np.zeros(len(inner), np.int64)])),
            "least": pa.array(np.concatenate([np.zeros(len(some), np.int64), least]), mask=np.arange(len(some) + len(inner)) < len(some)),
        })

    return tasks.groupBy("t", "at", "p", "q").applyInArrow(run, "node long, links long, least long")


def op8_itq(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
