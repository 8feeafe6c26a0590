"""Centroid clustering of integer vectors that lie in blocks along a Hilbert curve.

Each block has a box of its least and greatest components. Distances of the box bound those of its vectors, so most
centroids are ruled out for a whole block; the rest are compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, written

DIM = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Integer components are smaller than this, so that a squared distance fits 64 bits.
LIMIT = 1 << 27
#: Vectors of a block.
BLOCK = 256
#: The curve runs through so many components, those that vary most, each on a grid of 2 to the power of so many bits.
CURVE_DIMS, CURVE_BITS = 16, 4
#: Vectors, chosen by a hash of their ids, that place the curve's grid. The result doesn't depend on them.
CURVE_SAMPLE = 4096
#: Sums of 64 products of components up to this size are exact in doubles.
_EXACT = 1 << 22


def integer_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>): floor(scale * x) of vectors of dim components, all finite and within the limit."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LIMIT))
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & fits)
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (rows of coordinates of `bits` bits) on the Hilbert curve, by Skilling's transform.

    The coordinates are turned, level by level, into the curve's own axes; their bits, interleaved, are the place.
    """
    axes = points.T.astype(np.uint64)
    dims = len(axes)
    zero = np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in axes:
            high = (axis & bit) != 0
            swap = np.where(high, zero, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(high, below, swap)
            axis ^= swap  # of the first axis this is zero
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), zero)
    axes ^= turn
    key = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | ((axis >> np.uint64(level)) & np.uint64(1))
    return key


def _curve(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components that the curve runs through, and the offset and width of a grid cell of each."""
    spread = sample.std(axis=0)
    dims = np.argsort(-spread, kind="stable")[:CURVE_DIMS]
    low = sample.mean(axis=0)[dims] - 2 * spread[dims]
    return dims, low, np.maximum(4 * spread[dims] / (1 << CURVE_BITS), 1.0)


def _matrix(batch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def zone_blocks(vectors: DataFrame) -> DataFrame:
    """Vectors (vec_id, v) in blocks along the curve: ids, v (packed components), low, high; written once.

    Rows are dealt by ranges of the curve, then of vec_id and of a number of the row, so equal vectors fill many tasks.
    """
    spark = vectors.sparkSession
    n = max(1, vectors.count())
    share = min(1 << 30, (CURVE_SAMPLE << 30) // n + 1)
    near = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < share).select("v").limit(2 * CURVE_SAMPLE)
    sample = np.array([r["v"] for r in near.collect()] or [[0] * DIM], float)
    dim = sample.shape[1]
    dims, low, width = _curve(sample)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                grid = np.clip((_matrix(batch, "v", dim)[:, dims] - low) / width, 0, (1 << CURVE_BITS) - 1)
                keys = hilbert_keys(grid.astype(np.uint64), CURVE_BITS) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))],
                                                 names=[*batch.schema.names, "place"])

    def packed(batches):
        ids: list = []
        parts: list[np.ndarray] = []

        def block(ids, rows):
            return pa.RecordBatch.from_pydict(
                {"ids": [ids], "v": [rows.tobytes()], "low": [rows.min(0).tobytes()], "high": [rows.max(0).tobytes()]},
                schema=pa.schema([("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("low", pa.binary()),
                                  ("high", pa.binary())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column("vec_id").to_pylist()
            parts.append(_matrix(batch, "v", dim).astype(np.int32))
            if len(ids) >= BLOCK:
                rows = np.concatenate(parts)
                for i in range(0, len(ids) - BLOCK + 1, BLOCK):
                    yield block(ids[i:i + BLOCK], rows[i:i + BLOCK])
                rest = len(ids) % BLOCK
                ids, parts = ids[len(ids) - rest:], [rows[len(rows) - rest:]]
        if ids:
            yield block(ids, np.concatenate(parts))

    bounded_batches(spark)
    rows = vectors.mapInArrow(placed, "vec_id bigint, v array<int>, place bigint")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("place", "vec_id", "row").sortWithinPartitions("place", "vec_id", "row")
    blocks = dealt.select("vec_id", "v").mapInArrow(packed, "ids array<bigint>, v binary, low binary, high binary")
    return written(blocks, "zone-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ties included."""
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(rows: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the numbered centroids (the least on ties) and squared distance, exact."""
    some = centroids[numbers]
    if max(np.abs(rows).max(), np.abs(some).max()) <= _EXACT:
        a, b = rows.astype(float), some.astype(float)
        square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    else:
        square = np.stack([((rows - c) ** 2).sum(1) for c in some], axis=1)
    best = square.argmin(1)
    return numbers[best], square[np.arange(len(rows)), best].astype(np.int64)


def _compared(batch, centroids: np.ndarray):
    """ids, cluster, distance and the vectors of each block of a batch."""
    dim = centroids.shape[1]
    for ids, v, low, high in zip(*(batch.column(c) for c in ("ids", "v", "low", "high"))):
        rows = np.frombuffer(v.as_py(), np.int32).reshape(-1, dim).astype(np.int64)
        box = [np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in (low, high)]
        yield ids, *nearest(rows, centroids, candidates(*box, centroids)), rows


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor of the mean of their vectors; one without vectors stays."""
    held = np.array(centroids, np.int64)

    def sums(batches):
        total, count = np.zeros_like(held), np.zeros(len(held), np.int64)
        for batch in batches:
            for _, cluster, _, rows in _compared(batch, held):
                np.add.at(total, cluster, rows)
                count += np.bincount(cluster, minlength=len(held))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": some, "n": count[some], "total": list(total[some])},
                                         schema=pa.schema([("cluster", pa.int64()), ("n", pa.int64()),
                                                           ("total", pa.list_(pa.int64()))]))

    parts = blocks.mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    merged = (parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at")
              .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(27,0)")).alias("total")))
    after = [list(c) for c in centroids]
    for r in merged.collect():  # one row per centroid and component
        after[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return after


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the least SHA-256 of `seed:vec_id`, in that order; rows without an id are none."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def cluster_vectors(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector kept.

    Kept are vectors (embedding) of 64 components, none null or non-finite; components become floor(256 * x). A vector
    with a component of 2^19 or more, whose distances may pass 64 bits, is left out as well. Start: the k kept vectors
    with the least SHA-256 of `seed:vec_id`; with fewer vectors there are fewer centroids. Each round assigns vectors to
    their nearest centroid (squared Euclidean distance, ties to the smaller number) and moves centroids to the floor of
    the mean; after the last one vectors are assigned again. An inertia beyond 64 bits is null.

    Rows without a vec_id are clustered but never start a centroid, repeated rows are clustered each, other columns are
    ignored. An empty table, or one in which no kept vector has an id, gives no rows.

    A round reads the blocks and shuffles one row per centroid and task; k * 64 sums come to the driver.
    """
    vectors = written(integer_vectors(rows), "zone-vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not centroids:
        none = vectors.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none.select("*", *[F.col("distance").alias(c) for c in ("cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    blocks = zone_blocks(vectors)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)
    held = np.array(centroids, np.int64)

    def assigned(batches):
        for batch in batches:
            for ids, cluster, distance, _ in _compared(batch, held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.as_py(), pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"])

    result = written(blocks.mapInArrow(assigned, schema), "zone-clusters")
    sums = {r["cluster"]: r["inertia"] for r in result.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(27,0)")).alias("inertia")).collect()}  # one row per centroid

    def by_cluster(values: list, kind: str):
        return F.array(*[F.lit(v) for v in values])[F.col("cluster")].cast(kind)

    def fitting(total) -> int | None:
        return int(total) if total < Decimal(1 << 63) else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return result.select(
        "*", by_cluster([fitting(sums.get(i, Decimal(0))) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(fitting(sum(sums.values()))).cast("bigint").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
