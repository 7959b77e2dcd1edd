"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The lattice of a text has a node between any two characters and an edge for every piece of the
model that spans two nodes; a character without a piece is a chain of byte pieces. The file
holds merge ranks, not probabilities, so a piece's weight is ``(2 + rank) ** -SHARPNESS``, a
byte piece's ``BYTE_WEIGHT``. Forward filtering sums the weights of all paths into each node;
backward sampling walks from the end, taking each edge with its share of the node's sum, so a
segmentation is drawn with probability proportional to the product of its weights. The uniform
numbers are hashes of (seed, row key, place in the text, step): the same row gets the same
pieces in every run and on every executor, whatever else is in its partition.

No piece crosses from a character to a following space, so every path passes the node before a
run of spaces, and around line ends where no piece holds one. The lattice is cut there; filtering is
done once for equal stretches and for many new ones at once, sampling for all stretches of
many texts at once. A worker keeps what it filtered up to a bound; beyond it, stretches that came
once go and those that came again stay.

Encoding does not normalise: spaces become U+2581, everything else stays, and a literal U+2581
in the text is spelled in bytes, so :func:`decode` gives back the text exactly. Defined
results: a null or empty text has no pieces; equal row keys with equal texts get equal pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name

SHARPNESS, BYTE_WEIGHT = 1.0, 1e-6
MARK = "▁"
_SLOT_SHIFT = np.uint64(44)
_BASE, _BYTE_LOG = 0x9E3779B97F4A7C15, float(np.log(BYTE_WEIGHT))
#: Characters sampled at once, and edges kept, per Python worker.
GROUP, MOST_EDGES = 1 << 18, 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Model:
    """Pieces with weights, and the compiled stretches met so far."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes_of: list[bytes] = []
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(held.get_piece_size()):
            name = held.id_to_piece(i)
            if held.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
                self.bytes_of.append(b"")
            else:
                spelled = name.replace(MARK, " ")
                self.bytes_of.append(spelled.encode())
                weight = (2.0 - min(0.0, held.get_score(i))) ** -SHARPNESS
                self.piece[spelled] = i, weight
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces: texts could not be kept whole")
        if any(" " in p.lstrip(" ") for p in self.piece):
            raise ValueError("the model has pieces across words")
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.piece))
        self.cut = re.compile(rf" *[^ {apart}]+| +|[{apart}]" if apart else r" *[^ ]+| +")
        self._index()
        self._clear()

    def _index(self) -> None:
        """Hashes of all beginnings of pieces, sorted, each with the piece it is, if any."""
        found: dict[int, tuple[int, float]] = {}
        for text, (i, weight) in self.piece.items():
            h = 0
            for k, c in enumerate(text):
                h = (h * _BASE + ord(c) + 1) % (1 << 64)
                if k + 1 == len(text):
                    found[h] = i, float(np.log(weight))
                else:
                    found.setdefault(h, (-1, 0.0))
        # Single characters hash to small numbers: one more factor spreads them over the slots.
        found = {h * _BASE % (1 << 64): piece for h, piece in found.items()}
        self.hashes = np.array(sorted(found), dtype=np.uint64)
        #: By a hash's first bits, where hashes with them begin and how many there are.
        slot = (self.hashes >> _SLOT_SHIFT).astype(np.intp)
        self.in_slot = np.bincount(slot, minlength=1 << 20).astype(np.int8)
        self.slot_first = (np.cumsum(self.in_slot, dtype=np.int64) - self.in_slot).astype(np.int32)
        self.hash_id = np.array([found[int(h)][0] for h in self.hashes], dtype=np.int64)
        self.hash_log = np.array([found[int(h)][1] for h in self.hashes])

    def _clear(self) -> None:
        #: Last node of a stretch, and how often a node ended a stretch of a text.
        self.ends: dict[str, int] = {}
        self.uses = np.zeros(MOST_EDGES, dtype=np.int32)
        self.nodes = self.edges = 0
        #: Edges by the node they end in: cumulated share, node they start in, piece; and each
        #: node's first edge. Untouched memory costs nothing.
        self.share = np.empty(MOST_EDGES)
        self.back = np.empty(MOST_EDGES, dtype=np.int32)
        self.id = np.empty(MOST_EDGES, dtype=np.int32)
        self.first = np.empty(MOST_EDGES, dtype=np.int64)
        #: The character that a node belongs to: its own, or that of the byte chain it lies on.
        self.head = np.empty(MOST_EDGES, dtype=np.int64)

    def _forget(self) -> None:
        """Drop the stretches used least, at least those used once, until half the room is free."""
        names = list(self.ends)
        ends = np.fromiter(self.ends.values(), dtype=np.int64, count=len(names))
        sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        uses, first = self.uses[ends], np.append(self.first[: self.nodes], self.edges)
        # All edges of a stretch but those of byte chains, which lie elsewhere, stand together.
        weight = first[ends + 1] - first[ends + 1 - sizes]
        order = np.argsort(-uses, kind="stable")
        stays = order[(uses[order] > 1) & (np.cumsum(weight[order]) <= MOST_EDGES // 2)]
        mark = np.zeros(self.nodes + 1, dtype=np.int64)
        np.add.at(mark, ends[stays] + 1 - sizes[stays], 1)
        np.add.at(mark, ends[stays] + 1, -1)
        kept = np.cumsum(mark)[:-1].astype(bool)[self.head[: self.nodes]]
        moved = np.cumsum(kept) - 1
        many = np.diff(first)
        of_edge = np.repeat(kept, many)
        back = self.back[: self.edges][of_edge]
        held = self.share[: self.edges][of_edge], np.where(back < 0, -1, moved[back]), self.id[: self.edges][of_edge]
        many, head = many[kept], moved[self.head[: self.nodes][kept]]
        self._clear()
        self._append(*held, np.cumsum(many) - many, head)
        self.nodes = len(many)
        self.ends = dict(zip([names[i] for i in stays], moved[ends[stays]].tolist()))

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first character, last character, piece, log weight), walking all beginnings at once."""
        firsts, lasts, ids, logs = [], [], [], []
        at, h, size = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), 0
        while len(at):
            h = h * np.uint64(_BASE) + codes[at + size] + np.uint64(1)
            spread = h * np.uint64(_BASE)
            slot = (spread >> _SLOT_SHIFT).astype(np.intp)
            may = np.flatnonzero(self.in_slot[slot])
            at, h, spread, slot = at[may], h[may], spread[may], slot[may]
            where = self.slot_first[slot]
            known = self.hashes[where] == spread
            for more in range(1, int(self.in_slot[slot].max(initial=0))):
                other = np.flatnonzero(~known & (self.in_slot[slot] > more))
                found = self.hashes[where[other] + more] == spread[other]
                where[other[found]] += more
                known[other[found]] = True
            i = np.where(known, self.hash_id[where], -1)
            hit = i >= 0
            firsts.append(at[hit])
            lasts.append(at[hit] + size)
            ids.append(i[hit])
            logs.append(self.hash_log[where[hit]])
            size += 1
            on = known & (left[at] > size)
            at, h = at[on], h[on]
        return tuple(map(np.concatenate, (firsts, lasts, ids, logs)))

    def learn(self, stretches: list[str]) -> None:
        """Forward-filter new stretches side by side: node k of them follows character k."""
        sizes = np.array([len(s) for s in stretches])
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        depth = np.arange(n) - begin
        first, last, piece, logw = self._edges(codes, np.repeat(sizes, sizes) - depth)
        start = np.where(depth[first] == 0, -1, first - 1)
        spelled_whole = np.zeros(n, dtype=bool)
        spelled_whole[last[first == last]] = True
        bare = np.flatnonzero(~spelled_whole)
        more: list[tuple[int, int, int, float]] = []
        owned: list[int] = []
        chained = n
        for k in bare.tolist():
            before = -1 if depth[k] == 0 else k - 1
            spelled = chr(int(codes[k])).encode()
            for b in spelled[:-1]:
                more.append((before, chained, self.byte_id[b], 0.0))
                owned.append(k)
                before, chained = chained, chained + 1
            more.append((before, k, self.byte_id[spelled[-1]], _BYTE_LOG))
        # A chain is entered through its first node alone, so it counts when its character ends:
        # its inner nodes take over the sum of the node before.
        origin = np.full(chained, -2, dtype=np.int64)
        for before, end, _, _ in more:
            if end >= n:
                origin[end] = before if before < n else origin[before]
        if more:
            b, e, i, w = map(np.array, zip(*more))
            start, last = np.concatenate((start, b)), np.concatenate((last, e))
            piece, logw = np.concatenate((piece, i)), np.concatenate((logw, w))
        inner = last >= n
        depth_of = np.where(inner, n, depth[np.minimum(last, n - 1)])
        order = np.lexsort((last, depth_of))
        start, last, piece, logw, inner = (x[order] for x in (start, last, piece, logw, inner))
        real = np.where(start >= n, origin[np.minimum(start, chained - 1)], start)
        total, cumulated = np.zeros(n + 1), np.ones(len(last))
        bounds = np.searchsorted(depth_of[order], np.arange(depth.max() + 2)).tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            # total[-1] stands for the first node, whose logarithm stays zero.
            x = logw[lo:hi] + np.where(real[lo:hi] < 0, 0.0, total[real[lo:hi]])
            heads = np.flatnonzero(np.diff(last[lo:hi], prepend=-1))
            many = np.diff(heads, append=hi - lo)
            top = np.maximum.reduceat(x, heads)
            value = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), heads))
            total[last[lo:hi][heads]] = value
            share = np.cumsum(np.exp(x - np.repeat(value, many)))
            share -= np.repeat(np.concatenate(([0.0], share))[heads], many)
            share[heads + many - 1] = 1.0
            cumulated[lo:hi] = share
        order = np.argsort(last, kind="stable")
        base = self.nodes
        backs = np.where(start < 0, -1, start + base)
        many = np.bincount(last, minlength=chained)
        first = self.edges + np.cumsum(many) - many
        head = np.concatenate((np.arange(n), np.array(owned, dtype=np.int64)))
        self._append(cumulated[order], backs[order], piece[order], first, head + base)
        self.ends.update(zip(stretches, (np.cumsum(sizes) - 1 + base).tolist()))
        self.nodes += chained

    def _append(self, shares, backs, ids, first, head) -> None:
        def put(name: str, at: int, new: np.ndarray) -> None:
            held = getattr(self, name)
            if at + len(new) > len(held):
                more = np.empty(max(len(held) // 4, len(new)), dtype=held.dtype)
                held = np.concatenate((held[:at], more))
                setattr(self, name, held)
            held[at : at + len(new)] = new

        put("share", self.edges, shares)
        put("back", self.edges, backs)
        put("id", self.edges, ids)
        put("first", self.nodes, first)
        put("head", self.nodes, head)
        if self.nodes + len(first) > len(self.uses):
            self.uses = np.append(self.uses, np.zeros(max(len(self.uses), len(first)), dtype=np.int32))
        self.edges += len(ids)

    def encode_all(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """One sampled segmentation of each text."""
        if self.edges > MOST_EDGES:
            self._forget()
        cut, ends = [self.cut.findall(t) for t in texts], self.ends
        many = np.array([len(found) for found in cut])
        stretches = list(chain.from_iterable(cut))
        if not stretches:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        nodes = list(map(ends.get, stretches))
        missing = [k for k, at in enumerate(nodes) if at is None]
        if missing:
            self.learn(list(dict.fromkeys(stretches[k] for k in missing)))
            for k in missing:
                nodes[k] = ends[stretches[k]]
        first = np.cumsum(many) - many
        place = np.arange(len(nodes)) - np.repeat(first, many)
        seed = np.repeat(keys.view(np.uint64), many) + (place.astype(np.uint64) << np.uint64(24))
        at, who = np.array(nodes, dtype=np.int64), np.arange(len(nodes))
        used = np.bincount(at)
        self.uses[: len(used)] += used
        step = 0
        owners, taken, steps = [], [], []
        while len(who):
            bits = mixed(seed + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            u = (bits >> np.uint64(11)).astype(float) * 2.0**-53
            edge = self.first[at]
            later = np.flatnonzero(u >= self.share[edge])
            while len(later):
                edge[later] += 1
                later = later[u[later] >= self.share[edge[later]]]
            owners.append(who)
            taken.append(self.id[edge])
            steps.append(np.full(len(who), step))
            at = self.back[edge]
            on = at >= 0
            at, who, seed, step = at[on], who[on], seed[on], step + 1
        owner, piece, back = map(np.concatenate, (owners, taken, steps))
        length = np.bincount(owner, minlength=len(nodes))
        start = np.cumsum(length) - length
        out = np.empty(len(piece), dtype=np.int32)
        out[start[owner] + length[owner] - 1 - back] = piece
        per_text = np.add.reduceat(np.append(length, 0), np.minimum(first, len(length)))
        per_text[many == 0] = 0
        return np.split(out, np.cumsum(per_text)[:-1])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


@lru_cache(maxsize=2)
def loaded(content: bytes) -> Model:
    """Once per Python worker and file."""
    return Model(content)


def row_key(seed: int, *columns: Column) -> Column:
    """The key that seeds a row's sampling: a hash of the seed and the row's key columns."""
    return F.xxhash64(F.lit(seed), *[c.cast("string") for c in columns])


def with_pieces(
    docs: DataFrame, content: bytes, key: Column, text: str = "text", out: str = "pieces"
) -> DataFrame:
    """``docs`` with ``struct<ids, lossless>``; ``content`` is the model file's bytes.

    ``lossless`` says that decoding the ids gave the text back. Results leave the worker group
    by group, so it never holds the pieces of a whole Arrow batch.
    """

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = loaded(content)
        for texts, keys in batches:
            whole, seeds = [t or "" for t in texts], keys.to_numpy(dtype=np.int64)
            at = 0
            while at < len(whole):
                end, chars = at, 0
                while end < len(whole) and (end == at or chars + len(whole[end]) <= GROUP):
                    chars += len(whole[end])
                    end += 1
                ids = model.encode_all(whole[at:end], seeds[at:end])
                same = [model.decode(i.tolist()) == t for i, t in zip(ids, whole[at:end])]
                yield pd.DataFrame({"ids": ids, "lossless": same})
                at = end

    encode = F.pandas_udf(each, "struct<ids:array<int>,lossless:boolean>")
    return docs.withColumn(free_name(docs, out), encode(F.col(text), key))


def with_decoded(docs: DataFrame, content: bytes, ids: str, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of piece ids; null ids give null."""

    def each(rows: pd.Series) -> pd.Series:
        model = loaded(content)
        return rows.map(lambda r: None if r is None else model.decode(r.tolist()))

    return docs.withColumn(free_name(docs, out), F.pandas_udf(each, "string")(F.col(ids)))
