"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least
``m - q + 1 - k * q`` of its q-grams with it, all on diagonals (place in text minus place in
item) at most k apart. Shared q-grams are counted in diagonal bands of width ``2 * (k + 1)``
that overlap by half, so some band holds the whole match; bands that reach the bound are
verified by banded alignment of the whole item. The budget is ``RATE`` edits a character, less
for items so short that the bound would be zero. Items shorter than q must occur as they are,
between word ends.

Texts and items are compared in lower case with white space runs as one space; spans are code
points of the text as it is. The benchmark is the query set: it is taken in blocks of at most
``BLOCK`` characters, each sent to the tasks that scan all rows, so its size never grows with
the documents and one block bounds memory.

Defined results: a null text is empty; null, empty and blank items match nothing; equal items
are reported each; one match is reported for neighbouring bands of an item, the best one; a
text without matches has an empty list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name

Q, RATE, BLOCK = 12, 0.06, 4_000_000
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 20

MATCH = "struct<item_id:bigint,start:int,end:int,edits:int>"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Lower case of every code point that has a single one; white space becomes a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if chr(c).isspace():
            table[c] = 32
        elif len(low) == 1:
            table[c] = ord(low)
    return table


def folded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes with single spaces, their places in the text)."""
    raw = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
    codes = _folding()[raw]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    places = np.flatnonzero(keep)
    return codes[places], places


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram, put together from grams of 1, 2, 4 and 8."""
    h, size, out, done = codes.astype(np.uint64), 1, None, 0
    power = _BASE % (1 << 64)
    while True:
        if Q & size:
            if out is None:
                out, done = h, size
            else:
                n = len(h) - done
                out = h[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64)) + out[:n]
                done += size
        if 2 * size > Q:
            return out
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2


class Block:
    """The q-grams of some items, sorted, behind a table of their leading bits."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [folded(t.strip())[0] for _, t in items]
        self.length = np.array([len(c) for c in self.items], dtype=np.int64)
        budget = np.minimum((RATE * self.length).astype(np.int64), (self.length - Q) // Q)
        self.budget = np.maximum(budget, 0)
        self.bound = self.length - Q + 1 - self.budget * Q
        long = [k for k in range(len(items)) if self.length[k] >= Q]
        parts = [grams(self.items[k]) for k in long]
        h = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.array(long, dtype=np.int64), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else item
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.slots = np.zeros(1 << _SLOTS, dtype=bool)
        self.slots[(self.hash >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        self.short = [
            (k, re.compile(rf"(?<!\w){re.escape(_string(self.items[k]))}(?!\w)"))
            for k in range(len(items))
            if 0 < self.length[k] < Q
        ]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of bands that reach the item's bound."""
        if len(codes) < Q or not len(self.hash):
            return
        h = grams(codes)
        at = np.flatnonzero(self.slots[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        true = self.hash[where] == h[at]
        at, where = at[true], where[true]
        if not len(at):
            return
        many = self.first[where + 1] - self.first[where]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(self.first[where], many) + offset
        item = self.item[row]
        width = self.budget[item] + 1
        band = (np.repeat(at, many) - self.place[row]) // width
        low, span = band.min() - 1, band.max() - band.min() + 3
        code = item * span + band - low
        keys, counts = np.unique(np.concatenate((code, code - 1)), return_counts=True)
        keys = keys[counts >= self.bound[keys // span]]
        if not len(keys):
            return
        # Keys of different items are at least two apart.
        for run in np.split(keys, np.flatnonzero(np.diff(keys) > 1) + 1):
            k = int(run[0] // span)
            w = int(self.budget[k]) + 1
            yield k, int(run[0] % span + low) * w, int(run[-1] % span + low + 2) * w - 1

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) in the text, by start, then item id."""
        codes, places = folded(text)
        out = []
        for k, lo, hi in self.candidates(codes):
            found = align(self.items[k], codes, lo, hi, int(self.budget[k]))
            if found:
                out.append((k, *found))
        if self.short:
            whole = _string(codes)
            out += [(k, *m.span(), 0) for k, p in self.short for m in p.finditer(whole)]
        spans = [
            (self.ids[k], int(places[s]), int(places[e - 1]) + 1, edits) for k, s, e, edits in out
        ]
        return sorted(spans, key=lambda m: (m[1], m[0]))


def _string(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le")


def _distances(item: np.ndarray, codes: np.ndarray, lo: int, hi: int, row: np.ndarray) -> np.ndarray:
    """Edit distances of the whole item by the diagonal it ends on, within the band, from the
    distances ``row`` at its start. Outside the text nothing matches and nothing is free."""
    width, far = hi - lo + 1, len(item) + len(codes) + 1
    padded = np.full(width + len(item), 0xFFFFFFFF, dtype=np.uint32)
    begin, end = max(0, lo), min(len(codes), lo + len(padded))
    if begin < end:
        padded[begin - lo : end - lo] = codes[begin:end]
    steps = np.arange(width)
    for i, c in enumerate(item):
        seen = padded[i : i + width]
        # A place outside the text may be passed by no step along the diagonal.
        across = row + np.where(seen == 0xFFFFFFFF, far, seen != c)
        skip = np.append(row[1:], far) + 1
        best = np.minimum(across, skip)
        row = np.minimum.accumulate(best - steps) + steps
    return row


def align(
    item: np.ndarray, codes: np.ndarray, lo: int, hi: int, budget: int
) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence with at most ``budget`` edits on diagonals
    ``lo`` to ``hi``, the first of equal ones; None if there is none."""
    m = len(item)
    lo, hi = max(lo - budget, -budget), min(hi + budget, len(codes) - m + budget)
    if lo > hi:
        return None
    diagonals = np.arange(lo, hi + 1)
    inside = (diagonals >= 0) & (diagonals <= len(codes))
    far = m + len(codes) + 1
    ends = _distances(item, codes, lo, hi, np.where(inside, 0, far))
    ends = np.where((diagonals + m >= 0) & (diagonals + m <= len(codes)), ends, far)
    best = int(np.argmin(ends))
    edits = int(ends[best])
    if edits > budget:
        return None
    end = int(diagonals[best]) + m
    back = codes[:end][::-1]
    reach = np.arange(-budget, budget + 1)
    starts = _distances(item[::-1], back, -budget, budget, np.where(reach >= 0, reach, far))
    starts = np.where(reach + m <= end, starts, far)
    start = end - m - int(reach[int(np.argmin(starts))])
    return start, end, edits


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK) -> Iterator[Block]:
    """The benchmark in blocks; the driver holds one at a time."""
    held: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        if r["i"] is None or not (r["t"] or "").strip():
            continue
        if held and chars + len(r["t"]) > most:
            yield Block(held)
            held, chars = [], 0
        held.append((r["i"], r["t"]))
        chars += len(r["t"])
    if held:
        yield Block(held)


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    out: str = "leaks",
    most: int = BLOCK,
) -> DataFrame:
    """``docs`` with an array of matches; ``out`` gets underscores where the name is taken."""

    def scan(block: Block):
        def each(texts: pd.Series) -> pd.Series:
            return texts.map(block.matches)

        return F.pandas_udf(each, f"array<{MATCH}>")

    found = [scan(b)(F.col(text)) for b in blocks(benchmark, item, item_text, most)]
    found.append(F.array().cast(f"array<{MATCH}>"))
    return docs.withColumn(free_name(docs, out), F.concat(*found))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match."""
    held = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, text, out=held).filter(F.size(held) == 0).drop(held)
