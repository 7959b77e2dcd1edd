"""Pairs of texts that share most of their shingles, found exactly.

Two texts resemble each other when the Jaccard similarity of their sets of five-word shingles
is at least ``LEAST``. A text's shingles are put into one order for all texts, rare ones first;
two sets of n and m shingles that similar share one among the first ``n - ceil(0.8 n) + 1`` of
either, so only those are dealt out, and no pair is missed whatever the order. Rarity comes from
counts by hash cell, of which there are ``CELLS`` at any size of the corpus.

Shingles of one text go at once. Of the rest each member of a group is compared with up to ``PIVOTS``
members of the group; then members that are still in different components are compared with each
other, so a large group of near copies costs a few comparisons a member. Before two texts meet, their counts of
shingles by hash range, ``LOAD`` to a range, are compared, which bound what they can share from
above; every pair left is decided on its two texts.

A text goes by its 64-bit hash ``same`` until then, and whole texts are dealt out only for the
pairs left. Each table goes when the next one is written.

Defined results: a text of fewer words than a shingle is one shingle; a text without words
resembles nothing; equal texts count as one; texts that share the hash alone stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import text_words, whole_files, written

WIDTH, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
CELLS, CHUNK = 1 << 18, 1 << 11
#: Shingles to a hash range, and the least number of ranges.
LOAD, RANGES = 2, 64
#: Members of a group that the others meet before they meet all.
PIVOTS = 4
#: Bits that tell which rows' texts are wanted: the most of them.
MARKS = 1 << 26
_FLUSH = 200_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 of the shingles, sorted: words lower-cased in A-Z."""
    words = [w.lower() for w in text_words(text)]
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[min(width, len(words)) - 1 :])]
    return np.unique(np.array(found, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def reach(n: int) -> int:
    """How many of the first of ``n`` shingles a similar set must meet one of."""
    return n - -(-LEAST[0] * n // LEAST[1]) + 1


def can_be(n, at, m, other_at):
    """False if sets of n and m shingles whose first common one is at these places are unlike."""
    most = 1 + np.minimum(n - at - 1, m - other_at - 1)
    return (sum(LEAST)) * most >= LEAST[0] * (n + m)


def bins(text: str | None) -> bytes:
    """Counts of shingles by hash range, so many ranges that ``LOAD`` fall into one; nothing for a
    text whose counts do not fit."""
    own = shingles(text)
    bits = (max(RANGES, len(own) // LOAD) - 1).bit_length()
    n = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() < 1 << 8 else b""


def _bins_of(texts: pd.Series) -> pd.Series:
    return texts.map(bins)


def fits(a: bytes, b: bytes) -> bool:
    """False if texts of these counts are unlike."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (a, b))
    # The ranges of fewer bits are unions of those of more.
    few = min(len(x), len(y))
    both = np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum()
    return sum(LEAST) * int(both) >= LEAST[0] * int(x.sum() + y.sum())


def _can_share(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fits(x, y) for x, y in zip(a, b)], dtype=bool)


def levels(docs: DataFrame, text: str) -> np.ndarray:
    """Of each hash cell, the base-2 logarithm of how many shingles of texts fall into it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for t in batch["text"]:
                np.add.at(total, (shingles(t) % CELLS).astype(np.int64), 1)
        if total.any():
            parts = total.reshape(-1, CHUNK)
            yield pd.DataFrame({"chunk": range(len(parts)), "n": [p.tobytes() for p in parts]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(x, dtype=np.int64) for x in rows["n"])
        return pd.DataFrame({"chunk": [key[0]], "n": [n.tobytes()]})

    total = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.int64)
    counts = docs.select(F.col(text).alias("text")).mapInPandas(count, "chunk int, n binary")
    summed, drop = written(
        counts.groupBy("chunk").applyInPandas(add, "chunk int, n binary"), "resemblance-levels"
    )
    for r in summed.collect():
        total[r["chunk"]] = np.frombuffer(bytes(r["n"]), dtype=np.int64)
    drop()
    return np.log2(np.maximum(total.ravel(), 1)).astype(np.int8)


ENTRY = "shingle bigint, same bigint, row bigint, n int, at int"


def _first_shingles(level: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def rows() -> pd.DataFrame:
            sizes = [len(h[0]) for h in held]
            spread = lambda k: np.repeat(np.array([h[k] for h in held], dtype=np.int64), sizes)
            out = pd.DataFrame(
                {
                    "shingle": np.concatenate([h[0] for h in held]).view(np.int64),
                    "same": spread(1),
                    "row": spread(2),
                    "n": spread(3),
                    "at": np.concatenate([np.arange(s) for s in sizes]),
                }
            )
            held.clear()
            return out

        many = 0
        for batch in batches:
            for text, same, row in zip(*(batch[c] for c in ("text", "same", "row"))):
                own = shingles(text)
                if not len(own):
                    continue
                order = np.lexsort((own, level[(own % CELLS).astype(np.int64)]))
                first = own[order[: reach(len(own))]]
                held.append((first, same, row, len(own)))
                many += len(first)
                if many > _FLUSH:
                    yield rows()
                    many = 0
        if held:
            yield rows()

    return run


def _groups(columns: list[str]):
    """Over batches sorted by shingle: the columns of each group, as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
        held, parts = None, []
        for batch in batches:
            key = batch["shingle"].to_numpy()
            values = [batch[c].to_numpy() for c in columns]
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if parts and key[s] != held:
                    yield [np.concatenate(p) for p in zip(*parts)]
                    parts = []
                held = key[s]
                parts.append([v[s:e] for v in values])
        if parts:
            yield [np.concatenate(p) for p in zip(*parts)]

    return run


MET = "shingle bigint, same bigint, n int, at int, " + ", ".join(f"p{i} bigint" for i in range(PIVOTS))


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by shingle and text: members of groups of two texts or more, each with the
    group's pivots, or itself in place of those it can't be like. Pivots are the first row and
    the smallest hashes, in every group alike; equal texts are the one with the smallest row."""
    out, many = [], 0
    for shingle, same, row, n, at in _groups(["shingle", "same", "row", "n", "at"])(batches):
        if len(same) < 2:
            continue
        new = (np.diff(same) != 0) | (np.diff(n) != 0) | (np.diff(at) != 0)
        if not new.any():
            continue
        keep = np.append(True, new)
        shingle, same, n, at = shingle[keep], same[keep], n[keep], at[keep]
        first = int(np.argmin(row[keep]))
        met = [np.where(can_be(n, at, n[first], at[first]), same[first], same)]
        for p in range(PIVOTS - 1):
            # Sorted by hash; two members have met by now.
            more = 2 < len(same) > p
            met.append(np.where(can_be(n, at, n[p], at[p]), same[p], same) if more else same)
        out.append((shingle, same, n, at, *met))
        many += len(same)
        if many > _FLUSH:
            yield _frame(out, MET)
            out, many = [], 0
    if out:
        yield _frame(out, MET)


PAIR = "a bigint, b bigint"


def _frame(parts: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({c: np.concatenate(p) for c, p in zip(names, zip(*parts))})


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a group that lie in different components and can be similar."""
    out, many = [], 0
    for same, n, at, label in _groups(["same", "n", "at", "label"])(batches):
        if (label == label[0]).all():
            continue
        # Members of the largest component are compared with outsiders alone.
        names, of, size = np.unique(label, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(of != np.argmax(size))
        place = np.arange(len(same))
        rank = np.where(of == np.argmax(size), -1, place)
        for k in outside.tolist():
            with_k = np.flatnonzero((label != label[k]) & (rank < k) & can_be(n, at, n[k], at[k]))
            if len(with_k):
                x = same[with_k]
                out.append((np.minimum(x, same[k]), np.maximum(x, same[k])))
                many += len(with_k)
                if many > _FLUSH:
                    yield _frame(out, PAIR)
                    out, many = [], 0
    if out:
        yield _frame(out, PAIR)


def _similar_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    known = lru_cache(64)(shingles)
    return pd.Series([similar(known(x), known(y)) for x, y in zip(a, b)], dtype=bool)


def _marked(rows: DataFrame, wanted: DataFrame, most: int = MARKS) -> DataFrame:
    """The rows of ``rows`` that ``wanted`` names (column ``row`` of both) and few others, told by
    bits and without dealing out the rest; past ``most`` bits more others stay."""
    bits = min(most, max(1 << 20, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("row"), F.lit(bits)) + 1
    parts = (
        wanted.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    marks = np.zeros((-(-bits // (1 << 15)), 1 << 12), dtype=np.uint8)
    for r in parts.collect():
        marks[r["part"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    marks = marks.ravel()

    @F.pandas_udf("boolean")
    def named(place: pd.Series) -> pd.Series:
        at = place.to_numpy() - 1
        return pd.Series((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(named(place))


def links(
    hashed: DataFrame, text: str, fp: str, row: str, near: DataFrame, components: Callable
) -> tuple[DataFrame, Callable[[], None]]:
    """(a, b): fingerprints of different texts that resemble each other, enough of them to keep
    every component that they make together with the links ``near``; and a call that removes them.

    ``hashed`` is read several times: pass a written table. ``row`` numbers its rows.
    """
    texts = hashed.select(
        F.col(text).alias("text"),
        F.xxhash64(text).alias("same"),
        F.col(row).alias("row"),
        F.col(fp).alias("fp"),
    )
    met, drop_met = written(
        texts.select("text", "same", "row")
        .mapInPandas(_first_shingles(levels(texts, "text")), ENTRY)
        .repartition("shingle")
        .sortWithinPartitions("shingle", "same", "n", "at", "row")
        .mapInPandas(_meet, MET),
        "resemblance-met",
    )
    # One row of equal texts; texts that share the hash alone have a row each.
    known, drop_known = written(
        texts.select("same", "fp", "row", F.pandas_udf(_bins_of, "binary")("text").alias("bins"))
        .groupBy("same", "fp")
        .agg(F.min("row").alias("row"), F.first("bins").alias("bins")),
        "resemblance-bins",
    )

    def verified(pairs: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        def side(s: str) -> DataFrame:
            return known.select(F.col("same").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("row", "fp", "bins")])

        can = F.pandas_udf(_can_share, "boolean")("bins_a", "bins_b")
        left, drop_left = written(
            pairs.distinct()
            .join(side("a"), "a")
            .join(side("b"), "b")
            .filter("fp_a <> fp_b")
            .filter(can)
            .select("row_a", "fp_a", "row_b", "fp_b"),
            "resemblance-pairs",
        )
        some = _marked(texts.select("row", "text"), left.select(F.explode(F.array("row_a", "row_b")).alias("row")))
        text_of = lambda s: some.withColumnsRenamed({"row": f"row_{s}", "text": f"text_{s}"})
        decide = F.pandas_udf(_similar_texts, "boolean")("text_a", "text_b")
        found = left.join(text_of("a"), "row_a").join(text_of("b"), "row_b").filter(decide)
        alike = found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()
        out = written(whole_files(alike, left.count()), "resemblance-links")
        drop_left()
        return out

    with_pivots = met.select("same", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivot"))
    found = [
        verified(
            with_pivots.filter("same <> pivot").select(
                F.least("same", "pivot").alias("a"), F.greatest("same", "pivot").alias("b")
            )
        )
    ]
    labels, drop_labels = components(near.union(found[0][0]))
    label_of = known.select("same", "fp").join(labels, "fp", "left")
    across = (
        met.join(label_of.select("same", F.coalesce("label", "fp").alias("label")), "same")
        .select("shingle", "same", "n", "at", "label")
        .repartition("shingle")
        .sortWithinPartitions("shingle", "same", "n", "at")
        .mapInPandas(_across, PAIR)
    )
    found.append(verified(across))
    for drop in (drop_labels, drop_met, drop_known):
        drop()

    def discard() -> None:
        for _, drop in found:
            drop()

    return found[0][0].union(found[1][0]), discard
