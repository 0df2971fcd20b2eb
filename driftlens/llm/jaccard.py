"""N-gram Jaccard join by T-occurrence search.

A document is its set of distinct shingles of ``GRAM`` words. Documents with
equal sets form a class; classes link when 100 * intersection >= PERCENT *
union. For sizes n >= m a link needs at least T = ceil(PERCENT n / 100) common
shingles, so it must show in the n - T + 1 shortest inverted lists of either.

1. Sets and their digests give the classes and one representative each.
2. Slices of representatives send packed shingle hashes to buckets, which
   return how many representatives hold each (its list length).
3. Representatives list their rarest n - T + 1 shingles that others hold too.
   Components over these lists are the search clusters; anything that links
   shares a cluster.
4. A cluster is searched with DivideSkip: documents in size order, the short
   lists of a query are merged with a heap that skips ahead, the long ones are
   probed by binary search for the candidates left. Clusters above ``BLOCK``
   documents are cut into blocks by size band and hash and searched per pair of
   blocks, so no task holds a whole large cluster and none is left out.
5. Components over the links give the result; a task reports links that join
   something new, so a group of copies never becomes all its pairs.

Texts without words link with nothing, fewer than ``GRAM`` words are one
shingle. NULL texts are empty. Every row gives one row; a NULL id takes part
but is never the least unless alone. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import HELD, arrow_schema, raw, slices, table, written
from driftlens.llm.components import components
from driftlens.llm.repeats import BUCKET_BYTES, SLICE_BYTES, Rolling, bucket_of, mixed, narrow, widened
from driftlens.llm.suffixtree import words_of

GRAM, PERCENT, BLOCK, HUBS = 5, 80, 400, 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, at: np.ndarray):
    """Sorted distinct shingle hashes of each text, and their offsets."""
    values, word_at, _ = words_of(LOWER[data], at)
    n = np.diff(word_at)
    rolling = Rolling(values)
    runs = np.maximum(0, n - GRAM + 1)
    place = np.repeat(word_at[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    grams = rolling.grams(GRAM)[place] if len(place) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < GRAM))
    owner = np.concatenate([np.repeat(np.arange(len(n)), runs), short])
    grams = np.concatenate([grams, rolling.of(word_at[short], word_at[short + 1])])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def digests(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit digest of each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    both = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], 1).astype(">u8")
    return [row.tobytes() for row in both]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_hash, n, node) of all documents; ``node`` is the digest of the set."""
    ddl, schema = arrow_schema(docs, "doc_id long, row_hash long, n long, node binary")

    def run(batches):
        HELD.clear()
        for part in slices(batches, "text"):
            grams, at = shingle_sets(*raw(part.column("text")))
            columns = [part.column("doc_id").cast(pa.int64()), part.column("row_hash"), pa.array(np.diff(at), pa.int64()), pa.array(digests(grams, at), pa.binary())]
            yield pa.record_batch(columns, schema=schema)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, ddl)


def least_common(n: int, m: int) -> int:
    """Smallest intersection that links sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Search:
    """DivideSkip over sets in size order; ``side`` limits links to pairs from different sides, 0 is free."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.order, self.sets, self.side = order, [sets[k] for k in order], side[order]
        self.sizes = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        tokens, flat = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by_token = np.argsort(flat, kind="stable")
        self.posts = owner[by_token]
        self.at = np.searchsorted(flat[by_token], np.arange(len(tokens) + 1))
        self.tokens = np.split(flat, np.cumsum(self.sizes)[:-1])

    def links(self) -> list[tuple[int, int]]:
        """Links, as places in the given order, that join documents not yet joined here.

        A document first meets the hubs of the largest groups; once it is in a
        group, the other members are left out of its lists, as a link to them
        would join nothing new.
        """
        out, members, hubs = [], {}, {}
        self.label = np.arange(len(self.sets))

        def join(i, j):
            a, b = int(self.label[i]), int(self.label[j])
            if a == b:
                return
            out.append((int(self.order[j]), int(self.order[i])))
            few, many = sorted((members.pop(a, [i]), members.pop(b, [j])), key=len)
            root = int(self.label[many[0]])
            self.label[few] = root
            members[root] = many + few
            hubs[root] = hubs.get(b, hubs.get(a, j))

        for i in range(len(self.sets)):
            for root in sorted(members, key=lambda r: -len(members[r]))[:HUBS] if len(members) else ():
                if root in members and self.linked(i, hubs[root]):
                    join(i, hubs[root])
            for j in self.matches(i):
                join(i, j)
        return out

    def linked(self, i: int, j: int) -> bool:
        n, m = int(self.sizes[i]), int(self.sizes[j])
        if 100 * min(n, m) < PERCENT * max(n, m):
            return False
        return len(np.intersect1d(self.tokens[i], self.tokens[j], assume_unique=True)) >= least_common(n, m)

    def matches(self, i: int):
        """Earlier documents of other groups that link with document i."""
        n = int(self.sizes[i])
        need = -(-PERCENT * n // 100)
        low = int(np.searchsorted(self.sizes, need))
        joined = self.label[i] != i or bool((self.label[:i] == i).any())
        lists = []
        for t in self.tokens[i].tolist():
            own = self.posts[self.at[t]: self.at[t + 1]]
            a, b = np.searchsorted(own, (low, i))
            own = own[a:b]
            if joined:
                own = own[self.label[own] != self.label[i]]
            if len(own):
                lists.append(own)
        if len(lists) < need:
            return []
        lists.sort(key=len)
        aside = min(need - 1, int(need / (0.01 * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside:]
        found, counts = merge_skip([x.tolist() for x in short], need - aside)
        if not found:
            return []
        found, counts = np.array(found), np.array(counts)
        fresh = (self.side[found] != self.side[i]) | (self.side[i] == 0)
        found, counts = found[fresh], counts[fresh]
        goal = -(-PERCENT * (n + self.sizes[found]) // (100 + PERCENT))
        for k, own in enumerate(long):
            if not len(found):
                break
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            counts = counts + (own[place] == found)
            alive = counts + (len(long) - k - 1) >= goal
            found, counts, goal = found[alive], counts[alive], goal[alive]
        return found[counts >= goal].tolist()


def merge_skip(lists: list[list[int]], least: int):
    """Values that stand in at least ``least`` ascending lists, with their counts."""
    from bisect import bisect_left

    heap = [(own[0], k) for k, own in enumerate(lists)]
    heapq.heapify(heap)
    place = [0] * len(lists)
    pop, push = heapq.heappop, heapq.heappush
    found, counts = [], []
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(pop(heap)[1])
        if len(popped) >= least:
            found.append(value)
            counts.append(len(popped))
            for k in popped:
                place[k] += 1
                if place[k] < len(lists[k]):
                    push(heap, (lists[k][place[k]], k))
            continue
        # No value below the least-th smallest head can reach the count.
        while heap and len(popped) < least - 1:
            popped.append(pop(heap)[1])
        if not heap:
            break
        reach = heap[0][0]
        for k in popped:
            place[k] = bisect_left(lists[k], reach, place[k])
            if place[k] < len(lists[k]):
                push(heap, (lists[k][place[k]], k))
    return found, counts


def chosen_rows(rows, marks):
    """Texts of the rows named in ``marks`` (row_hash), one per hash, in hash order, with the marks in that order."""
    hashes = rows.column("row_hash").to_numpy()
    wanted = marks.column("row_hash").to_numpy()
    order = np.argsort(hashes, kind="stable")
    place = np.minimum(np.searchsorted(hashes[order], wanted), max(0, len(order) - 1))
    first = order[place] if len(order) else np.zeros(0, np.int64)
    return shingle_sets(*raw(rows.column("text").take(pa.array(first))))


def rare_lists(docs: DataFrame, leaders: DataFrame, count: int, buckets: int, width: int) -> DataFrame:
    """Rows (key, node, n): shared shingles among the rarest of every representative."""
    dealt = docs.withColumn("_slice", F.pmod("row_hash", F.lit(count)).cast("int"))
    lead = leaders.select(F.pmod("row_hash", F.lit(count)).cast("int").alias("_slice"), "row_hash", "node")

    def sorted_lead(marks):
        return marks.sort_by("row_hash")

    def send(key, rows, marks):
        marks = sorted_lead(marks)
        grams, _ = chosen_rows(rows, marks)
        small, held = np.unique(grams >> np.uint64(64 - 8 * width), return_counts=True)
        b = bucket_of(small << np.uint64(64 - 8 * width), buckets)
        edges = np.searchsorted(b, np.arange(buckets + 1))
        full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        packed = [narrow(small[edges[k]: edges[k + 1]] << np.uint64(64 - 8 * width), width) for k in full]
        many = [np.minimum(held[edges[k]: edges[k + 1]], 65535).astype("<u2").tobytes() for k in full]
        return pa.table({"_slice": pa.array([key[0].as_py()] * len(full), pa.int32()), "_bucket": pa.array(full, pa.int32()), "_keys": pa.array(packed, pa.binary()), "_many": pa.array(many, pa.binary())})

    def count_lists(key, rows):
        parts = [widened(x, width) for x in rows.column("_keys").to_pylist()]
        many = np.concatenate([np.frombuffer(x, "<u2") for x in rows.column("_many").to_pylist()])
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        held = np.bincount(back, many)
        level = np.where(held > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(held, 1)))), 0).astype(np.uint8)[back]
        edges = np.cumsum([0, *map(len, parts)])
        return pa.table({"_slice": rows.column("_slice"), "_bucket": rows.column("_bucket"), "_levels": pa.array([level[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    def choose(key, rows, marks):
        levels = marks.filter(pc.is_valid(marks.column("_levels"))).sort_by("_bucket")
        marks = sorted_lead(marks.filter(pc.is_valid(marks.column("node"))))
        grams, at = chosen_rows(rows, marks)
        small, index = np.unique(grams >> np.uint64(64 - 8 * width), return_inverse=True)
        level = np.frombuffer(b"".join(levels.column("_levels").to_pylist()), np.uint8)[index] if len(grams) else np.zeros(0, np.uint8)
        sizes = np.diff(at)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((grams, level, owner))
        rank = np.arange(len(order)) - np.repeat(at[:-1], sizes)
        prefix = sizes + (-PERCENT * sizes // 100) + 1
        take = order[rank < np.repeat(prefix, sizes)]
        take = take[level[take] > 0]
        nodes = marks.column("node").take(pa.array(owner[take]))
        return pa.table({"key": pa.array(grams[take].view(np.int64)), "node": nodes, "n": pa.array(sizes[owner[take]], pa.int64())})

    levels = written(
        dealt.groupBy("_slice").cogroup(lead.groupBy("_slice")).applyInArrow(send, "_slice int, _bucket int, _keys binary, _many binary")
        .groupBy("_bucket").applyInArrow(count_lists, "_slice int, _bucket int, _levels binary"), "levels",
    )
    both = lead.unionByName(levels, allowMissingColumns=True)
    return written(dealt.groupBy("_slice").cogroup(both.groupBy("_slice")).applyInArrow(choose, "key long, node binary, n long"), "lists")


def tasks_of(members: DataFrame) -> DataFrame:
    """Adds ``tasks``: (task, side) pairs a member is searched in.

    A cluster of up to BLOCK members is one task. A larger one is cut into
    blocks of one size band and hash part; a pair of blocks of the same or
    neighbouring bands is a task. Bands are wide enough that links never skip one.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).cast("int")
    members = members.withColumn("_band", band)
    whole = members.groupBy("cluster").agg(F.count("*").alias("_all"))
    parts = members.groupBy("cluster", "_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts"))
    near = lambda name, step: parts.select(F.col("cluster").alias("_c"), (F.col("_band") + step).alias("_b"), F.col("_parts").alias(name))
    out = members.join(whole, "cluster").withColumnRenamed("cluster", "_k")
    for name, step in (("_own", 0), ("_below", 1), ("_above", -1)):
        out = out.join(near(name, step), (F.col("_k") == F.col("_c")) & (F.col("_band") == F.col("_b")), "left").drop("_c", "_b")
    out = out.withColumnRenamed("_k", "cluster").withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_own")).cast("int"))
    block = lambda b, p: F.concat(b.cast("string"), F.lit("."), p.cast("string"))
    others = lambda count, b: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.struct(b.alias("b"), p.alias("p")))).otherwise(F.array().cast("array<struct<b:int,p:int>>"))
    every = F.concat(*[others(F.coalesce(F.col(c), F.lit(0)), (F.col("_band") + s).cast("int")) for c, s in (("_own", 0), ("_below", -1), ("_above", 1))])

    def task(o):
        mine, before = block(F.col("_band"), F.col("_part")), (o["b"] < F.col("_band")) | ((o["b"] == F.col("_band")) & (o["p"] < F.col("_part")))
        theirs, same = block(o["b"], o["p"]), (o["b"] == F.col("_band")) & (o["p"] == F.col("_part"))
        pair = F.when(before, F.concat(theirs, F.lit("|"), mine)).otherwise(F.concat(mine, F.lit("|"), theirs))
        return F.struct(pair.alias("task"), F.when(same, 0).when(before, 1).otherwise(2).alias("side"))

    single = F.array(F.struct(F.lit("").alias("task"), F.lit(0).alias("side")))
    tasks = F.when(F.col("_all") <= BLOCK, single).otherwise(F.transform(every, task))
    return out.withColumn("tasks", tasks).select("cluster", "node", "row_hash", "tasks")


def search(docs: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """Rows (a, b): links between nodes that join every cluster's linked members."""
    dealt = docs.withColumn("_slice", F.pmod("row_hash", F.lit(count)).cast("int"))
    asked = tasks_of(members).withColumn("_slice", F.pmod("row_hash", F.lit(count)).cast("int"))

    def fetch(key, rows, marks):
        marks = marks.sort_by("row_hash")
        grams, at = chosen_rows(rows, marks)
        cluster, node, task, side, data = [], [], [], [], []
        for c, v, tasks, a, b in zip(marks.column("cluster").to_pylist(), marks.column("node").to_pylist(), marks.column("tasks").to_pylist(), at, at[1:]):
            body = grams[a:b].tobytes()
            for t in tasks:
                cluster.append(c)
                node.append(v)
                task.append(t["task"])
                side.append(t["side"])
                data.append(body)
        return pa.table({"cluster": pa.array(cluster, pa.binary()), "task": pa.array(task, pa.string()), "side": pa.array(side, pa.int32()), "node": pa.array(node, pa.binary()), "grams": pa.array(data, pa.binary())})

    def link(key, rows):
        nodes = rows.column("node").to_pylist()
        if len(nodes) < 2:
            pairs = []
        else:
            pairs = Search([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()], rows.column("side").to_numpy()).links()
        return pa.table({"a": pa.array([nodes[a] for a, _ in pairs], pa.binary()), "b": pa.array([nodes[b] for _, b in pairs], pa.binary())})

    sets = dealt.groupBy("_slice").cogroup(asked.groupBy("_slice")).applyInArrow(fetch, "cluster binary, task string, side int, node binary, grams binary")
    # A task's work is not in proportion to its bytes, so small partitions must not be put together.
    spread = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(sets.repartition(spread, "cluster", "task").groupBy("cluster", "task").applyInArrow(link, "a binary, b binary"), "links")


def similar_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_hash, n_shingles, component_id, component), one per input row.

    ``row_hash`` is xxhash64(doc_id, text); ``component`` names the component
    even where all its ids are NULL and is NULL for texts without words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = written(keyed(docs), "sets")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, buckets = max(1, math.ceil(total / SLICE_BYTES)), max(1, math.ceil(total * 0.7 / BUCKET_BYTES))
    width = min(8, math.ceil((math.log2(total + 2) + 6) / 8))
    classes = keys.filter(F.col("n") > 0).groupBy("node", "n").agg(F.min("doc_id").alias("least"), F.min("row_hash").alias("row_hash"))
    classes = written(classes, "classes")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    lists = rare_lists(texts, classes, count, buckets, width)
    least = lists.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    clusters = components(lists.join(least, "key").select(F.col("node").alias("a"), "b"))
    rooted = clusters.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(clusters.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())
    members = written(rooted.join(classes.select("node", "n", "row_hash"), "node"), "members")
    joined = components(search(texts, members, count)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = classes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(F.col("node").alias("_node"), "component_id", F.col("root").alias("component"))
    out = keys.join(named, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least (doc_id, row_hash) of each component; texts without words all stay. Further columns may have any names."""
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)])
    groups = similar_groups(docs)
    pick = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    best = groups.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(pick).alias("p")).select("p.doc_id", "p.row_hash", F.lit(True).alias("_once"))
    wordless = groups.filter(F.col("component").isNull()).select("doc_id", "row_hash", F.lit(False).alias("_once")).distinct()
    keep = best.unionByName(wordless).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "_once")
    rows = docs.withColumn("_own", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    # Rows repeated word for word share id and hash: one of them stays.
    kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_own", "doc_id").orderBy(F.lit(1)))).filter(~F.col("_once") | (F.col("_k") == 1))
    return kept.select(*docs.columns).toDF(*names)


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
