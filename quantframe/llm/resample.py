"""Importance resampling towards a target distribution over hashed word runs.

A text's features are its runs of 1 to ``longest`` consecutive words; a feature falls in the
bucket CRC-32 modulo ``buckets``. A bucket's gain is the scaled log ratio of its smoothed share
in the target texts to that in the source texts, a text weighs the sum of its features' gains,
and the Gumbel-perturbed weights draw a share of the texts without replacement.

The CRCs are computed for the distinct features of some texts at a time: features of equal byte
length lie as rows of one uint8 matrix whose registers advance together, a column at a time, and
the results are scattered back. A feature above ``WIDE`` bytes is cut into rows of that many; as
the register is linear in what went before, the rows' registers join by a fixed shift.

Counts cover every text: each task adds up its buckets, a shuffle adds up the tasks, and the
driver holds one number a bucket. Ranks need no global window: bins of the score find the
cutoff, only the bins from there on are range partitioned and sorted, and a row's rank is its
place in the partition after the sizes of the partitions before it.

Defined results: a null text is empty and has no features, weight 0; texts below ``MIN_WORDS``
words are scored and never drawn; ties go to the smaller id, nulls first; equal rows stay
separate and have ranks of their own; without target texts every gain comes from the smoothing
alone; a null id hashes as the empty string; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name, shared

BUCKETS, LONGEST, MIN_WORDS = 10_000, 1, 20
SCALE = 1000
BINS = 1 << 16
WIDE = 512
_SLICE, _KNOWN = 1 << 20, 200_000
_POLYNOMIAL = np.uint32(0xEDB88320)
#: Bytes as words see them: A-Z in lower case, other bytes below 0x80 but digits and letters apart.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
)


@cache
def _table() -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> 1) ^ _POLYNOMIAL, reg >> 1)
    return reg


def _advance(reg: np.ndarray, columns: Iterable[np.ndarray]) -> np.ndarray:
    table = _table()
    for column in columns:
        reg = table[(reg ^ column) & 0xFF] ^ (reg >> 8)
    return reg


@cache
def _shift() -> np.ndarray:
    """By byte of a register, what that byte becomes after ``WIDE`` zero bytes."""
    start = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    zero = np.zeros((), dtype=np.uint32)
    return _advance(start.ravel(), [zero] * WIDE).reshape(4, 256)


def matrix_crc(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix."""
    n, length = rows.shape
    reg = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    head = length % WIDE if length > WIDE else length
    reg = _advance(reg, np.ascontiguousarray(rows[:, :head].T))
    if head < length:
        parts = np.ascontiguousarray(rows[:, head:]).reshape(-1, WIDE)
        tails = _advance(np.zeros(len(parts), dtype=np.uint32), np.ascontiguousarray(parts.T))
        shift = _shift()
        for tail in tails.reshape(n, -1).T:
            moved = shift[0][reg & 0xFF]
            for byte in range(1, 4):
                moved = moved ^ shift[byte][(reg >> (8 * byte)) & 0xFF]
            reg = moved ^ tail
    return ~reg


def crc_buckets(features: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of each feature, features of equal length in one matrix."""
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    out = np.empty(len(features), dtype=np.int64)
    for s, e in zip(edges, [*edges[1:], len(features)]):
        at = order[s:e]
        joined = b"".join([features[i] for i in at])
        rows = np.frombuffer(joined, dtype=np.uint8).reshape(len(at), -1)
        out[at] = matrix_crc(rows) % np.uint32(buckets)
    return out


def _slices(data: bytes) -> Iterator[bytes]:
    """The bytes in order, cut between words after at least ``_SLICE`` bytes."""
    at = 0
    while len(data) - at > _SLICE:
        cut = data.find(b" ", at + _SLICE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


class Bucketer:
    """Buckets of the features of many texts, with a bounded memory of those met before."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets
        self.known: dict[bytes, int] = {}

    def _look_up(self, features: list[bytes]) -> np.ndarray:
        known = self.known
        new = [f for f in dict.fromkeys(features) if f not in known]
        if new:
            if len(known) + len(new) > _KNOWN:
                known.clear()
                new = list(dict.fromkeys(features))
            known.update(zip(new, crc_buckets(new, self.buckets).tolist()))
        return np.fromiter(map(known.__getitem__, features), dtype=np.int64, count=len(features))

    def runs(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By about ``_SLICE`` bytes: (text number and bucket of each feature, text number of each
        word); a long text comes in several parts."""
        features: list[bytes] = []
        owners: list[tuple[int, int]] = []
        words_of: list[tuple[int, int]] = []
        size = 0

        def flush():
            owner, worded = (
                np.repeat([i for i, _ in part], [n for _, n in part]).astype(np.int64)
                for part in (owners, words_of)
            )
            return owner, self._look_up(features), worded

        for i, text in enumerate(texts):
            carry: list[bytes] = []
            for part in _slices((text or "").encode().translate(_FOLD)):
                own = part.split()
                words = carry + own
                here = list(own)
                for n in range(2, self.longest + 1):
                    first = max(0, len(carry) - n + 1)
                    here += [b" ".join(words[k : k + n]) for k in range(first, len(words) - n + 1)]
                features += here
                owners.append((i, len(here)))
                words_of.append((i, len(own)))
                carry = words[-(self.longest - 1) :] if self.longest > 1 else []
                size += len(part)
                if size > _SLICE:
                    yield flush()
                    features, owners, words_of, size = [], [], [], 0
        if features:
            yield flush()


def bucket_counts(
    docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        of = Bucketer(longest, buckets)
        for batch in batches:
            for _, found, _ in of.runs(batch.iloc[:, 0]):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    summed = (
        docs.select(text)
        .mapInPandas(count, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(buckets, dtype=np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, the scaled log ratio of its smoothed shares, rounded down."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array(
        [
            math.floor(SCALE * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


WEIGHED = "struct<n_features:bigint,n_words:bigint,weight:bigint>"


def with_weights(
    docs: DataFrame, gain: np.ndarray, text: str = "text", out: str = "importance", longest: int = LONGEST
) -> DataFrame:
    """``docs`` with a struct (n_features, n_words, weight)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = Bucketer(longest, buckets)
        for texts in batches:
            held = np.zeros((3, len(texts)), dtype=np.int64)
            for owner, found, worded in of.runs(texts):
                np.add.at(held[0], *_tally(owner))
                np.add.at(held[1], *_tally(worded))
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    held[2][owner[starts]] += np.add.reduceat(gain[found], starts)
            yield pd.DataFrame(dict(zip(("n_features", "n_words", "weight"), held)))

    return docs.withColumn(out, F.pandas_udf(_typed(weigh), WEIGHED)(F.col(text)))


def _tally(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


def _typed(f):
    """Spark reads the kind of a pandas UDF from its hints, as real types."""
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return f


def perturbation(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from a hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(
    scored: DataFrame, score: str, doc_id: str, eligible: Column, percent: int, out: str = "rank"
) -> DataFrame:
    """``scored`` with the rank of the drawn rows: the ``percent`` of eligible rows (rounded down)
    with the highest scores. A column called like ``out`` is replaced.

    ``scored`` is read several times: pass a written table, without the texts.
    """
    scored = scored.drop(out)
    at, row, place = (free_name(scored, n) for n in ("bin", "row_number", "place"))
    value = F.col(score)
    span = scored.filter(eligible).agg(F.min(value), F.max(value), F.count("*")).first()
    low, high, n = span[0], span[1], span[2]
    k = percent * n // 100
    undrawn = F.lit(None).cast("bigint").alias(out)
    if k == 0:
        return scored.select("*", undrawn)
    width = (high - low) // BINS + 1
    binned = scored.withColumn(
        at, F.when(eligible, F.expr(f"(`{score}` - {low}L) div {width}L")).otherwise(F.lit(-1))
    )
    counts = binned.filter(F.col(at) >= 0).groupBy(at).count().collect()
    cutoff, taken = 0, 0
    for b, size in sorted(((r[at], r["count"]) for r in counts), reverse=True):
        cutoff, taken = b, taken + size
        if taken >= k:
            break
    keys = [value.desc(), F.col(doc_id).asc_nulls_first(), F.col(row).asc()]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared(
        binned.filter(F.col(at) >= cutoff)
        .withColumn(row, F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(place, F.monotonically_increasing_id())
        .drop(row),
        "resample-drawn",
    )
    part = F.shiftright(F.col(place), 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(part).count().collect())
    before, begins = 0, []
    for p, size in sizes:
        begins.append((p, before))
        before += size
    part_of, begin = (free_name(ordered, c) for c in ("part", "begin"))
    offsets = scored.sparkSession.createDataFrame(begins, f"`{part_of}` bigint, `{begin}` bigint")
    rank = F.col(begin) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn(part_of, part).join(offsets, part_of)
    kept = [F.col(f"`{c}`") for c in scored.columns]
    drawn = ranked.select(*kept, F.when(rank <= k, rank).alias(out))
    return drawn.unionByName(binned.filter(F.col(at) < cutoff).select(*kept, undrawn))
