"""Nearest neighbours by inner product: probed lists, scanned in blocks of columns with early abandoning.

Vectors get one more component that makes all norms equal, so the largest inner product is the least distance. They are
turned by a random rotation, after which the first columns estimate the whole distance. A list's vectors are read column
block by column block; a candidate goes as soon as a test says that its whole distance exceeds the query's limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, skew_join, written

NEAREST = 20
ASK_EVERY = 20
#: The index is fitted on so many vectors at most (chosen by a hash), whatever their number.
SAMPLE = 16384
#: Vectors of the sample that give each query its first limit, and queries that find how many lists to probe.
LIMIT_SAMPLE, PROBE_QUERIES = 2048, 128
#: Share of the true neighbours of the sample's queries that lie in the probed lists.
PROBE_RECALL = 1.0
MAX_LISTS = 1024
#: A list aims at 16 times the root of the number of vectors, between these; longer ones are several parts.
LEAST_ROWS, MOST_ROWS = 1024, 65536
COLUMNS = 16
#: Vectors compared at a time, and queries at a time.
GROUP, QUERIES = 1024, 256
#: Distance test: estimates may be this many standard errors above the limit.
ERRORS = 2.1
SEED = 11


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part: with an id, finite and not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                      & F.exists("embedding", lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")


def distinct_vectors(vectors: DataFrame, asked: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors, and the queries (vec_id, h1, h2) among all rows; both written.

    A vector is known by 128 bits of hash (h1, h2). It has its least vec_id, whether any row of it is a query, and, if
    it has several ids, the least k + 1 of them: no others can be among the k nearest of anything.
    """
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(SEED), "embedding").alias("h2")]
    rows = vectors.select("vec_id", "embedding", *key)
    ids = written(rows.select("vec_id", "h1", "h2", asked.alias("asked")).distinct(), "scan-ids")
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    several = (ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
               .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") > 1))
    known = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.max(asked).alias("asked"),
                                         F.min_by("embedding", "vec_id").alias("embedding"))
    nodes = known.join(several, ["h1", "h2"], "left").select("h1", "h2", "id", "ids", "asked", "embedding")
    return written(nodes, "scan-vectors"), ids.where("asked").select("vec_id", "h1", "h2")


@dataclass
class Index:
    """Rotation, list centres (rotated) and how far their lists reach, and what scales a vector; of bounded size."""

    rotation: np.ndarray
    centres: np.ndarray
    reach: np.ndarray
    sample: np.ndarray
    scale: float
    square: float
    probes: int

    def placed(self, rows: np.ndarray) -> np.ndarray:
        """Rotated vectors with the component that makes all squared norms equal."""
        rows = rows * self.scale
        rest = np.sqrt(np.maximum(self.square - (rows * rows).sum(1), 0))
        return np.column_stack([rows, rest]) @ self.rotation

    def asked(self, rows: np.ndarray) -> np.ndarray:
        """Rotated queries; their additional component is zero."""
        return (rows * self.scale) @ self.rotation[:-1]

    def order(self, asked: np.ndarray) -> np.ndarray:
        """Lists of each rotated query, the one with the largest inner product to be expected first.

        That is the centre's and, of n vectors that lie around it at random, the largest of n: a small dense list has a
        far centre but may hold the nearest vectors.
        """
        norm = np.sqrt((asked * asked).sum(1))[:, None]
        return (-(asked @ self.centres.T) - norm * self.reach).argsort(1, kind="stable")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def _centres(points: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of the sample, from evenly spaced starts."""
    centres = points[np.linspace(0, len(points) - 1, lists).astype(int)].copy()
    for _ in range(rounds if lists > 1 else 1):
        near = _distances(points, centres).argmin(1)
        count = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fit_index(nodes: DataFrame, k: int, sample: int = SAMPLE, probe_recall: float = PROBE_RECALL) -> Index:
    """The index of vectors of one length, fitted on `sample` of them at most; see probes_needed."""
    count = nodes.count()
    top = nodes.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0]
    scale = math.ldexp(1.0, -math.frexp(top)[1])
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    square = nodes.agg(F.max(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    share = min(1 << 30, (sample << 30) // count)
    rows = nodes.where(F.pmod(F.xxhash64("h1", F.lit(SEED)), F.lit(1 << 30)) < share).select("embedding", "h1")
    points = np.array([r["embedding"] for r in sorted(rows.limit(2 * sample).collect(), key=lambda r: r["h1"])][:sample], float)
    if not len(points):
        points = np.array([nodes.select("embedding").first()[0]], float)
    dim = points.shape[1]
    draw = np.random.Generator(np.random.PCG64(SEED))
    turn, upper = np.linalg.qr(draw.standard_normal((dim + 1, dim + 1)))
    index = Index(turn * np.sign(np.diag(upper)), np.zeros((1, dim + 1)), np.zeros(1), points[:LIMIT_SAMPLE], scale, square, 1)
    target = min(max(16 * math.isqrt(count), LEAST_ROWS), MOST_ROWS)
    lists = max(1, min(MAX_LISTS, round(count / target), len(points)))
    placed = index.placed(points)
    index.centres = _centres(placed, lists)
    near = _distances(placed, index.centres)
    home = near.argmin(1)
    count = np.maximum(np.bincount(home, minlength=lists), 1)
    spread = np.bincount(home, np.maximum(near.min(1), 0), lists) / count
    index.reach = np.sqrt(spread * 2 * np.log(np.maximum(count, 2)) / (dim + 1))
    index.probes = probes_needed(index, points, k, probe_recall)
    return index


def probes_needed(index: Index, points: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists in which so large a share of the sample's true neighbours lies.

    The sample is thinner than the table, so true neighbours lie farther off in it and the number is on the safe side.
    """
    lists = len(index.centres)
    if lists == 1 or len(points) < 2:
        return lists
    some = points[:: max(1, len(points) // PROBE_QUERIES)][:PROBE_QUERIES]
    home = _distances(index.placed(points), index.centres).argmin(1)
    order = index.order(index.asked(some))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :], 1)
    near = np.argsort(-(some @ points.T), axis=1, kind="stable")[:, :k + 1]
    needed = np.sort(rank[np.arange(len(some))[:, None], home[near]].ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


class _List:
    """The vectors of one list part, rotated and cut into column blocks."""

    def __init__(self, index: Index, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        turned = index.placed(rows).astype(np.float32)
        self.cuts = [(a, min(a + COLUMNS, turned.shape[1])) for a in range(0, turned.shape[1], COLUMNS)]
        self.groups = [(at, [np.ascontiguousarray(turned[at:at + GROUP, a:b]) for a, b in self.cuts])
                       for at in range(0, len(rows), GROUP)]


def _survivors(blocks: list[np.ndarray], asked: list[np.ndarray], limit: np.ndarray, slack: float,
               width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of a group whose whole distance may be within the limit.

    After each column block, distances so far are carried on to all columns; those above the limit by more than the
    test's error go. While most pairs are left all are computed, then only those left.
    """
    done, pairs, part = 0, None, None
    for y, z in zip(blocks, asked):
        done += y.shape[1]
        last = done == width
        bound = limit + slack if last else (limit + slack) * (done / width) * (1 + ERRORS / math.sqrt(done)) ** 2
        if pairs is None:
            step = (z * z).sum(1)[:, None] + (y * y).sum(1) - 2 * (z @ y.T)
            part = step if part is None else part + step
            alive = part <= bound[:, None]
            left = np.count_nonzero(alive)
            if last or 4 * left < alive.size:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            off = z[pairs[0]] - y[pairs[1]]
            part = part + (off * off).sum(1)
            alive = part <= bound[pairs[0]]
            pairs, part = (pairs[0][alive], pairs[1][alive]), part[alive]
        if pairs is not None and not len(part):
            break
    return pairs


def _best(query: np.ndarray, score: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best entries of each query: score descending, then id."""
    order = np.lexsort((ids[at], -score, query))
    q = query[order]
    start = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - start < k]


def scan_list(index: Index, part: _List, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the list, score) of the k largest inner products of each query, in double precision."""
    n = len(asked)
    turned = index.asked(asked)
    square = (turned * turned).sum(1) + index.square
    scaled = index.scale * index.scale

    def limits(least: np.ndarray) -> np.ndarray:
        return square - 2 * scaled * least

    least = np.full(n, -np.inf)  # the k-th best score so far
    if len(index.sample) >= k:
        least = np.partition(asked @ index.sample.T, len(index.sample) - k, axis=1)[:, len(index.sample) - k]
        least -= 1e-9 * np.abs(least)
    blocks = [turned[:, a:b].astype(np.float32) for a, b in part.cuts]
    held = (np.empty(0, int), np.empty(0, int), np.empty(0))
    slack = 1e-4 * 2 * index.square
    for at, columns in part.groups:
        q, x = _survivors(columns, blocks, np.where(np.isfinite(least), limits(least), np.inf), slack, turned.shape[1])
        if not len(q):
            continue
        x = x + at
        score = (part.rows[x] * asked[q]).sum(1)
        near = score >= least[q]
        q, x, score = (np.concatenate([a, b]) for a, b in zip(held, (q[near], x[near], score[near])))
        keep = _best(q, score, x, part.ids, k)
        held = q[keep], x[keep], score[keep]
        count = np.bincount(held[0], minlength=n)
        full = np.flatnonzero(count == k)
        ends = np.cumsum(count)[full] - 1
        least[full] = np.maximum(least[full], held[2][ends])
    return held


_VECTOR = "h1 bigint, h2 bigint, id bigint, ids array<bigint>"
_FOUND = "h1 bigint, h2 bigint, score double, id bigint, ids array<bigint>"


def _matrix(batch) -> np.ndarray:
    values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(batch.num_rows, -1)


def search_lists(nodes: DataFrame, index: Index, k: int) -> DataFrame:
    """h1, h2 of each asked vector with the k + 1 nearest vectors of every part of its probed lists, itself included."""
    inner = nodes.schema["embedding"].dataType.simpleString()
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast(vars(index))  # a sample of LIMIT_SAMPLE vectors, 1024 centres and a matrix at most
    lists, probes, keep = len(index.centres), index.probes, k + 1

    def place(batches):
        index = Index(**held.value)
        for batch in batches:
            if batch.num_rows:
                near = _distances(index.placed(_matrix(batch)), index.centres).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "list"])

    def probe(batches):
        index = Index(**held.value)
        for batch in batches:
            if batch.num_rows:
                order = index.order(index.asked(_matrix(batch)))[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order), pa.list_(pa.int32()))],
                                                 names=[*batch.schema.names, "lists"])

    bounded_batches(spark)
    stored = written(nodes.select("h1", "h2", "id", "ids", "embedding")
                     .mapInArrow(place, f"{_VECTOR}, embedding {inner}, list int"), "scan-lists")
    sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    target = min(max(16 * math.isqrt(sum(sizes.values())), LEAST_ROWS), MOST_ROWS)
    parts = F.array(*[F.lit(max(1, math.ceil(sizes.get(i, 0) / (1.5 * target)))) for i in range(lists)])
    queries = (nodes.where("asked").select("h1", "h2", "embedding")
               .mapInArrow(probe, f"h1 bigint, h2 bigint, embedding {inner}, lists array<int>")
               .select("h1", "h2", "embedding", F.explode("lists").alias("list"))
               .withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("list")] - 1))))
    here = stored.withColumn("part", F.pmod(F.xxhash64("h2"), parts[F.col("list")]).cast("int"))
    none = F.lit(None)
    both = (here.select("list", "part", F.lit(0).alias("side"), "h1", "h2", "id", "ids", "embedding")
            .unionByName(queries.select("list", "part", F.lit(1).alias("side"), "h1", "h2", none.cast("bigint").alias("id"),
                                        none.cast("array<bigint>").alias("ids"), "embedding")))
    # a part's vectors come first, by id, then its queries in any number
    both = both.repartition("list", "part").sortWithinPartitions("list", "part", "side", "id")

    def scan(batches):
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("id", pa.int64()),
                            ("ids", pa.list_(pa.int64()))])
        index = Index(**held.value)
        at, kept, waiting, part = None, [], [], None

        def answers(rows: list):
            nonlocal part
            if not kept:
                return
            if part is None:
                joined = pa.Table.from_batches(kept)
                part = (_List(index, np.concatenate([_matrix(b) for b in kept]), joined.column("id").to_numpy()), joined)
            q, x, score = scan_list(index, part[0], np.concatenate([_matrix(b) for b in rows]), keep)
            asked = pa.Table.from_batches(rows).take(pa.array(q))
            found = part[1].take(pa.array(x))
            yield from pa.table([asked["h1"], asked["h2"], pa.array(score), found["id"], found["ids"]],
                                schema=schema).combine_chunks().to_batches()

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("list", "part", "side")])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                rows, place_, side = batch.slice(a, b - a), tuple(keys[a][:2]), keys[a][2]
                if place_ != at:
                    if waiting:
                        yield from answers(waiting)
                    at, kept, waiting, part = place_, [], [], None
                if side == 0:
                    kept.append(rows)
                    continue
                waiting.append(rows)
                if sum(r.num_rows for r in waiting) >= QUERIES:
                    yield from answers(waiting)
                    waiting = []
        if waiting:
            yield from answers(waiting)

    return both.mapInArrow(scan, _FOUND)


def nearest_vectors(rows: DataFrame, k: int = NEAREST, asked: Column | None = None, sample: int = SAMPLE,
                    probe_recall: float = PROBE_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by largest inner product in double precision.

    Queries are the rows for which `asked` holds (default: vec_id divisible by 20), candidates all rows but those of the
    query's own vec_id; ties go to the smaller vec_id. Vectors that are null or zero or hold a null or non-finite
    component, and rows without a vec_id, take no part. Vectors of different lengths are never compared. A row that
    repeats another in vec_id and vector counts once; a vec_id with several vectors is a candidate with each and a query
    with each. Other columns are ignored; an empty table gives no rows.

    Equal vectors are one, with their least k + 1 ids. The index is fitted on a sample of bounded size but has every
    vector in a list; a list is scanned in parts of bounded size, and each query goes to the lists that hold
    probe_recall of a sample's true neighbours. Where data have no clusters, that is nearly all of them.
    """
    vectors = usable(rows)
    nodes, queries = distinct_vectors(vectors, F.col("vec_id") % ASK_EVERY == 0 if asked is None else asked, k)
    found = None
    for length in sorted(r[0] for r in nodes.select(F.size("embedding")).distinct().collect()):
        same = nodes.where(F.size("embedding") == length)
        part = search_lists(same, fit_index(same, k, sample, probe_recall), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1), "scan-found")
    ids = best.select("h1", "h2", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    # at most k + 1 vectors of k + 1 ids each
    near = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "id"))), 1, k + 1)
    answers = ids.groupBy("h1", "h2").agg(near.alias("near"))
    # one vector may be asked for by a large share of the queries
    joined = skew_join(queries, answers, ["h1", "h2"], "vec_id")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
        (-F.col("hit.below")).alias("score"))
