"""Exact integer k-means with bounds loosened by planar geometry.

Vectors become integers, distances are exact squared Euclidean ones and centroids the floors of
exact means, so the result does not depend on how rows are dealt. Every vector carries an upper
bound on the distance to its own centroid and a lower bound on the distance to any other. When
centroids move, a vector of cluster i lies in the sphere around i's centroid c that reaches to
its farthest member. For a centroid that moves from a to b, with m between them and p = |b - a|,

    |x - a| - |x - b| = 2 p y / (|x - a| + |x - b|) <= p y / |x - m| = p cos(angle of x - m to b - a)

where y is x's height over m along b - a. In the plane through a, b and c the smallest angle over
the sphere is that of c - m less the sphere's half-angle seen from m, so the lower bound drops by
p times its cosine: by p only if the sphere meets the line of motion ahead of m, by nothing if it
lies behind. A vector whose upper bound stays below its lower bound (or below half the way to the
next centroid) keeps its cluster unread; the others take their exact distance, and if that does
not settle it, the distances to all centroids.

A round is one pass over the written vectors; only the rows that changed clusters enter the next
sums. The driver holds centroids, their sums and one drop a cluster. A round's table goes when
the next one is complete.

Defined results: a vector with another number of components, or a null, NaN or infinite one, is
not kept; a component is floor(``SCALE`` * x), held within the range in which all squares add up
in 64 bits; equal distances go to the smaller number; ``k`` vectors with the smallest hashes of
seed and id begin, of equal hashes the smaller vector first, fewer if fewer are kept; a centroid
without vectors stays; a null id hashes as the empty string; equal rows stay separate; an empty
table gives an empty table; an inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import free_name
from quantframe.session import shared_at

SCALE = 256
#: A bound counts only if it holds by more than rounding: relative, far above that of a few sums.
SLACK = 1e-9
_CHUNK = 1 << 22


def reach(dims: int) -> int:
    """The largest component for which squared distances and their parts fit 64 bits."""
    return math.isqrt((1 << 60) // max(dims, 1)) // 2


def kept_vectors(rows: DataFrame, vector: str, dims: int, out: str) -> DataFrame:
    """The rows with a whole finite vector, with its integers as ``out`` in the vector's place."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.lit(float(reach(dims)))
    ints = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * SCALE, -far), far)).cast("int"))
    return rows.filter((F.size(v) == dims) & whole).withColumn(out, ints).drop(vector)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 52:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
    else:
        a, b = v, centroids
    cross = a @ b.T
    return ((a * a).sum(1)[:, None] - 2 * cross + (b * b).sum(1)).astype(np.int64)


def drops(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By cluster, the most by which its members' distance to any other centroid can fall."""
    old, new = old.astype(float), new.astype(float)
    k = len(old)
    out = np.zeros(k)
    for j in range(k):
        way = new[j] - old[j]
        p = math.sqrt(way @ way)
        if p == 0:
            continue
        from_m = old - (old[j] + new[j]) / 2
        height = from_m @ way / p
        apart = np.sqrt((from_m * from_m).sum(1))
        aside = np.sqrt(np.maximum(apart**2 - height**2, 0))
        over = np.maximum(apart, 1e-300)
        sin = np.minimum(radius / over, 1)
        cos_least = (height * np.sqrt(1 - sin**2) + aside * sin) / over
        # Ahead of m and within the half-angle of the line, the cosine reaches one.
        full = (radius >= apart) | ((height > 0) & (aside / over <= sin))
        fall = p * (np.where(full, 1.0, np.clip(cos_least, 0, 1)) + SLACK)
        fall[j] = 0
        out = np.maximum(out, fall)
    return out


@dataclass(frozen=True)
class Step:
    """What a pass needs to know of the centroids."""

    centroids: np.ndarray
    moved: np.ndarray
    drop: np.ndarray
    half_gap: np.ndarray


def step_to(centroids: np.ndarray, old: np.ndarray | None, radius: np.ndarray | None) -> Step:
    k = len(centroids)
    apart = np.sqrt(squared(centroids, centroids).astype(float)) if k else np.zeros((0, 0))
    np.fill_diagonal(apart, np.inf)
    gap = apart.min(1, initial=np.inf) / 2
    if old is None:
        return Step(centroids, np.zeros(k), np.zeros(k), gap)
    moved = np.sqrt(((centroids - old).astype(float) ** 2).sum(1)) * (1 + SLACK)
    return Step(centroids, moved, drops(old, centroids, radius), gap)


def assign(
    v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after a step, and how many vectors were scanned. -1: no cluster yet."""
    c = step.centroids
    held = own >= 0
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    upper[held] += step.moved[own[held]]
    lower[held] -= step.drop[own[held]]
    bound = lower.copy()
    bound[held] = np.maximum(lower[held], step.half_gap[own[held]])

    def unsettled(at: np.ndarray) -> np.ndarray:
        return at[~(upper[at] * (1 + SLACK) < bound[at] * (1 - SLACK))]

    loose = unsettled(np.flatnonzero(held))
    upper[loose] = np.sqrt(((v[loose] - c[own[loose]]) ** 2).sum(1).astype(float))
    scan = np.concatenate([np.flatnonzero(~held), unsettled(loose)])
    rows = max(1, _CHUNK // max(len(c), 1))
    for s in range(0, len(scan), rows):
        at = scan[s : s + rows]
        d = squared(v[at], c)
        best = d.argmin(1)
        own[at], upper[at] = best, np.sqrt(d[np.arange(len(at)), best].astype(float))
        others = d.astype(float)
        others[np.arange(len(at)), best] = np.inf
        lower[at] = np.sqrt(others.min(1))
    return own, upper, lower, len(scan)


def _ints(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class _Names:
    v: str
    cluster: str
    before: str
    upper: str
    lower: str


def _pass(names: _Names, step: Step, dims: int, distance: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _ints(batch.column(names.v), dims)
            before = batch.column(names.cluster).to_numpy().astype(np.int64)
            upper, lower = (batch.column(n).to_numpy() for n in (names.upper, names.lower))
            own, upper, lower, _ = assign(v, before, upper, lower, step)
            new = {
                names.cluster: pa.array(own, pa.int32()),
                names.before: pa.array(before, pa.int32()),
                names.upper: pa.array(upper, pa.float64()),
                names.lower: pa.array(lower, pa.float64()),
            }
            columns = [new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
            held = list(batch.schema.names)
            if distance is not None:
                columns.append(pa.array(((v - step.centroids[own]) ** 2).sum(1), pa.int64()))
                held.append(distance)
            yield pa.RecordBatch.from_arrays(columns, names=held)

    return run


def _changes(names: _Names, dims: int):
    """Per task and cluster: how many vectors came less those that went, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            v = _ints(batch.column(0), dims)
            for i, sign in ((1, 1), (2, -1)):
                cluster = batch.column(i).to_numpy()
                order = np.argsort(cluster, kind="stable")
                starts = np.flatnonzero(np.diff(cluster[order], prepend=-2))
                for c, s, e in zip(cluster[order][starts], starts, [*starts[1:], len(order)]):
                    if c >= 0:
                        held = sums.setdefault(int(c), [0, np.zeros(dims, dtype=np.int64)])
                        held[0] += sign * int(e - s)
                        held[1] += sign * v[order[s:e]].sum(0)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(list(sums), pa.int32()),
                "n": pa.array([n for n, _ in sums.values()], pa.int64()),
                "sums": pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.int64())),
            }
        )

    return run


def first_centroids(kept: DataFrame, vec_id: str, v: str, k: int, seed: int) -> np.ndarray:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit("")))
    first = kept.select(F.sha2(key, 256).alias("h"), F.col(v).alias("v")).orderBy("h", "v").limit(k)
    rows = [r["v"] for r in first.collect()]
    return np.array(rows, dtype=np.int64)


def cluster_vectors(
    rows: DataFrame,
    k: int,
    rounds: int,
    seed: int,
    dims: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    out: str = "clustered",
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows without ``vector``, with a struct (cluster, distance), and the centroids.

    Columns are carried through every round: pass those that the result needs. One called like
    ``out`` is replaced.
    """
    names = _Names(*(free_name(rows, n) for n in ("ints", "cluster", "cluster_before", "upper", "lower")))
    distance = free_name(rows, "distance")
    kept = kept_vectors(rows, vector, dims, names.v)
    state, discard = shared_at(
        kept.withColumns(
            {
                names.cluster: F.lit(-1),
                names.before: F.lit(-1),
                names.upper: F.lit(float("inf")),
                names.lower: F.lit(0.0),
            }
        ),
        "centroids",
    )
    centroids = first_centroids(state, vec_id, names.v, k, seed)
    k = len(centroids)
    schema = state.schema
    for field in schema.fields:
        field.nullable = True
    sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    step = step_to(centroids, None, None)
    for _ in range(rounds if k else 0):
        new, discard_new = shared_at(
            state.mapInArrow(_pass(names, step, dims, None), schema), "centroids"
        )
        discard()
        state, discard = new, discard_new
        changed = state.filter(F.col(names.cluster) != F.col(names.before)).select(
            names.v, names.cluster, names.before
        )
        moved = (
            changed.mapInArrow(_changes(names, dims), "cluster int, n bigint, sums array<bigint>")
            .groupBy("cluster")
            .agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(dims)])
        )
        for r in moved.collect():
            counts[r[0]] += r[1]
            sums[r[0]] += np.array(r[2:], dtype=np.int64)
        radius = np.zeros(k)
        for r in state.groupBy(names.cluster).agg(F.max(names.upper)).collect():
            radius[r[0]] = r[1] * (1 + SLACK)
        old, full = centroids, counts > 0
        centroids = old.copy()
        centroids[full] = sums[full] // counts[full, None]
        step = step_to(centroids, old, radius)
    whole = T.StructType([*schema.fields, T.StructField(distance, T.LongType())])
    final, _ = shared_at(state.mapInArrow(_pass(names, step, dims, distance), whole), "centroids")
    discard()
    found = F.struct(F.col(names.cluster).alias("cluster"), F.col(distance).alias("distance"))
    own = [F.col(f"`{c}`") for c in rows.columns if c not in (vector, out)]
    return final.select(*own, found.alias(out)), centroids


def inertia(found: DataFrame, last: np.ndarray) -> DataFrame:
    """By cluster with vectors: its inertia, that of all, and the hash of its centroid. ``found``
    has columns cluster and distance."""
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("n")).collect()
    whole = sum(r["n"] or 0 for r in sums)
    whole = whole if all(r["n"] is not None for r in sums) and whole < 1 << 63 else None
    shown = [
        (r["cluster"], r["n"], whole, hashlib.sha256(",".join(map(str, last[r["cluster"]].tolist())).encode()).hexdigest())
        for r in sums
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return found.sparkSession.createDataFrame(shown, schema)
