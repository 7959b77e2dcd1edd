"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two link when at most ``radius`` bits differ. Every bit gets a
non-zero vector of ``radius + 1`` bits; the mask of a non-zero vector v keeps the bits whose
vector has an odd inner product with v. For any ``radius`` bits some v is orthogonal to all
their vectors, so the mask of v hides all differences and the pair meets in its table: no pair
within the radius is missed, with ``2 ** (radius + 1) - 1`` tables.

Work is on distinct fingerprints. A bucket is compared in blocks inside one task and gives a
forest, not pairs. A bucket above ``BUCKET`` fingerprints is not compared: each member goes to
the points within one bit and within ``radius - 1`` bits of it, over the bits that the bucket's
mask hides, and meets its partners there. That is linear in the bucket, and exact: two
fingerprints within the radius have such a point between them.

Components spread the smallest label along links and through earlier labels until nothing
changes, one written table a round.

Defined results: a null text is empty; a text without words has fingerprint zero and links like
any other; equal rows stay separate rows of one component; a component's id is its smallest
doc_id, null only if all its ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm import resemblance
from quantframe.llm.common import free_name, text_words, whole_files, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BUCKET = 4096
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority of the shingles' hash bits: XXH64 over words lower-cased in A-Z, repeats kept."""
    words = [w.lower() for w in text_words(text)]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    votes, n = np.zeros(BITS, dtype=np.int64), len(last)
    for at in range(0, n, _BLOCK):
        hashes = b"".join(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:], last[at : at + _BLOCK])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, BITS)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks. Bits take the vectors 1, 2, ... in turn, so masks keep like numbers."""
    vectors = 2 ** (radius + 1) - 1
    of_bit = [1 + i % vectors for i in range(BITS)]
    return [
        sum(1 << i for i, w in enumerate(of_bit) if (v & w).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str, out: str, width: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _signed(fingerprint(t, width))).astype("int64")

    return docs.withColumn(out, F.pandas_udf(each, "bigint")(F.col(text)))


def forest(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """For distinct fingerprints, (smallest of its group, member) over links within ``radius``."""
    points = np.sort(points)
    bits = points.view(np.uint64)
    root = np.arange(len(points))
    for at in range(len(points) - 1):
        near = np.flatnonzero(np.bitwise_count(bits[at + 1 :] ^ bits[at]) <= radius) + at + 1
        if len(near):
            roots = np.unique(root[[at, *near]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    for at in np.flatnonzero(root != np.arange(len(points))):
        yield int(points[root[at]]), int(points[at])


def _bucket_links(radius: int, bucket: int):
    """Over rows sorted by (table, key): links inside buckets; members of large buckets as is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        parts: list[np.ndarray] = []
        size, large = 0, False

        def close() -> list[tuple[int, int, int]]:
            if large or size < 2:
                return []
            return [(-1, a, b) for a, b in forest(np.concatenate(parts), radius)]

        for batch in batches:
            table, key, fp = (batch[c].to_numpy() for c in ("table", "key", "fp"))
            cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
            edges = [0, *cut.tolist(), len(fp)]
            out: list[tuple[int, int, int]] = []
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                here = (table[s], key[s])
                if here != held:
                    out += close()
                    held, parts, size, large = here, [], 0, False
                size += e - s
                parts.append(fp[s:e])
                if large or size > bucket:
                    large = True
                    out += [(int(here[0]), int(x), int(x)) for p in parts for x in p]
                    parts = []
            yield pd.DataFrame(out, columns=["table", "a", "b"])
        yield pd.DataFrame(close(), columns=["table", "a", "b"])

    return run


def _around(tables: list[int], radius: int):
    """For members of large buckets: the points near them over the bits their mask hides."""
    hidden = [[1 << i for i in range(BITS) if not m >> i & 1] for m in tables]

    def flips(bits: list[int], most: int) -> np.ndarray:
        sums = [sum(c) for k in range(most + 1) for c in combinations(bits, k)]
        return np.array(sums, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = [(flips(b, min(1, radius)), flips(b, radius - min(1, radius))) for b in hidden]
        for batch in batches:
            for table, own in batch.groupby("table")["a"]:
                fps = own.to_numpy()
                for role, moves in enumerate(near[table]):
                    step = max(1, 100_000 // len(moves))
                    for at in range(0, len(fps), step):
                        some = fps[at : at + step]
                        points = some.view(np.uint64)[:, None] ^ moves
                        yield pd.DataFrame(
                            {
                                "table": table,
                                "point": points.view(np.int64).ravel(),
                                "role": role,
                                "fp": np.repeat(some, len(moves)),
                            }
                        )

    return run


def links(
    points: DataFrame, radius: int = RADIUS, bucket: int = BUCKET
) -> tuple[DataFrame, Callable[[], None]]:
    """(a, b): links between distinct fingerprints (column ``fp``) that keep every component, and
    a call that removes them.

    Any two fingerprints within the radius are joined by a path of links, and every path stays
    inside one component. Written once, as several later steps read it.
    """
    tables = masks(radius)
    keyed = points.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tables])).alias(
            "table", "key"
        ),
    )
    met, drop_met = written(
        keyed.repartition("table", "key")
        .sortWithinPartitions("table", "key")
        .select("table", "key", "fp")
        .mapInPandas(_bucket_links(radius, bucket), "table int, a bigint, b bigint"),
        "simhash-links",
    )
    near = met.filter("table >= 0").mapInPandas(
        _around(tables, radius), "table int, point bigint, role int, fp bigint"
    )
    centre = near.groupBy("table", "point").agg(
        F.min(F.when(F.col("role") == 0, F.col("fp"))).alias("a"),
        F.collect_set("fp").alias("met"),
    )
    star = centre.filter("a is not null and size(met) > 1").select("a", F.explode("met").alias("b"))
    found = met.filter("table < 0").select("a", "b").union(star.filter("a <> b"))
    out = written(found.distinct(), "simhash-links")
    drop_met()
    return out


def components(found: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(fp, label): for every fingerprint in a link, the smallest one it is joined to; and a call
    that removes them."""
    both, n = found.union(found.select("b", "a")).toDF("fp", "other"), 2 * found.count()
    own = both.groupBy("fp").agg(F.least(F.col("fp"), F.min("other")).alias("label"))
    labels, drop = written(whole_files(own, n), "simhash-labels")
    while True:
        beside = both.join(labels.withColumnRenamed("fp", "other"), "other")
        nearest = beside.groupBy("fp").agg(F.min("label").alias("beside"))
        moved = labels.join(nearest, "fp").withColumn("next", F.least("label", "beside"))
        through = labels.select(F.col("fp").alias("next"), F.col("label").alias("beyond"))
        further = moved.join(through, "next").select(
            "fp",
            F.least("next", "beyond").alias("label"),
            (F.least("next", "beyond") != F.col("label")).alias("changed"),
        )
        new, drop_new = written(whole_files(further, n), "simhash-labels")
        drop()
        labels, drop = new.select("fp", "label"), drop_new
        if new.filter("changed").isEmpty():
            return labels, drop


def with_components(
    hashed: DataFrame, doc_id: str, fp: str, out: str, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """``hashed`` with the smallest ``doc_id`` of each row's component as ``out``.

    ``hashed`` is read several times: pass a written table. Copies are counted once per
    fingerprint, so a hot fingerprint costs one row until the last join, whose large side the
    adaptive planner splits.
    """
    points = hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"))
    near, drop_near = links(points.select("fp"), radius, bucket)
    labels, _ = components(near)
    drop_near()
    held = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = held.groupBy("label").agg(F.min("least").alias(out))
    of_point = held.join(ids, "label").select(F.col("fp").alias(fp), out)
    return hashed.join(of_point, fp)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest ``doc_id``, nulls last.

    Fingerprints within the radius link, and so do texts whose five-word shingles are similar at
    0.8 or more, which often differ in more bits.

    Rows are numbered when the fingerprints are written, so of equal rows one stays.
    """
    fp, row, whole = (free_name(docs, n) for n in ("fp", "row_number", "component"))
    hashed, _ = written(
        with_fingerprint(docs, text, fp).withColumn(row, F.monotonically_increasing_id()),
        "simhash",
    )
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row))
    points = hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first"))
    near, drop_near = links(points.select("fp"))
    alike, drop_alike = resemblance.links(hashed, text, fp, row, near, components)
    labels, _ = components(near.union(alike))
    drop_near()
    drop_alike()
    held = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = held.groupBy("label").agg(F.min("first").alias("first"))
    stay = first.select(F.col("first")[row].alias(row))
    return hashed.join(stay, row, "left_semi").select(*docs.columns)
