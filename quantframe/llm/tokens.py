"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer file is compiled into two deterministic transducers.

:class:`Splitter` reads character classes and emits, with each transition, how many pre-tokens
start and where (at the character just read or up to two before it). A text is cut into chunks;
a chunk's state map (entering state to leaving state) is computed for all chunks at once, the
maps compose by a parallel prefix scan, and each chunk then emits from its true entering state.
So a long text costs as many steps as a chunk, each over all chunks.

:class:`Merger` reads the bytes of one pre-token and annotates each transition with the change
of the number of tokens of what it has read. Its states are found when first reached: a state
holds, for each start of a token that may still end later, the place in the vocabulary trie,
the last token before that start and the number of tokens there against the present one. The
last token of a prefix is the one vocabulary item that ends there and may follow the last token
before its start, which is what merging by rank gives. Nothing depends on a token's length, so
a pre-token of any size costs one step a byte. Counts of short pre-tokens are kept.

Special tokens of the file are found first, as the library does; texts between them are split
on their own. Character classes are read off the file's own pre-tokenizer, so they are those
of the library's Unicode tables. Defined results: a null or empty text has no tokens.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name

LIMIT = 512
CHUNK = 256
#: Characters handled at once, and kept states and pre-tokens, per Python worker.
GROUP, MOST_STATES, MOST_WORDS = 1 << 20, 200_000, 500_000
SHORT = 64

#: Character classes: letters apart by their part in 's 't 'm 'd, 're 've, 'll.
(LETTER, SINGLE, R_V, ELL, EE, NUMBER, SPACE, BLANK, QUOTE, OTHER, END) = range(11)
N_CLASSES = 11
_WORDY = (LETTER, SINGLE, R_V, ELL, EE)

#: States: what the current pre-token is. W1 and W2 are white space, one character or more,
#: ending in a space (s) or not (o); Q a quote that may begin a contraction; QR and QL have
#: read r, v or l after it; C is a whole contraction.
_STATES = "begin letters number other W1s W1o W2s W2o Q QR QL C".split()
_AT = {s: i for i, s in enumerate(_STATES)}

#: Emissions: a pre-token starts at this character, one before, two before.
HERE, BACK1, BACK2 = 1, 2, 4


def _step(state: str, c: int) -> tuple[str, int]:
    """The transition for GPT-2's split pattern: next state and emitted starts."""
    if c == END:
        return "begin", BACK1 if state in ("QR", "QL") else 0
    if state == "Q":
        if c == SINGLE:
            return "C", 0
        if c == R_V:
            return "QR", 0
        if c == ELL:
            return "QL", 0
        state = "other"
    elif state in ("QR", "QL"):
        if c == (EE if state == "QR" else ELL):
            return "C", 0
        after, emitted = _step("letters", c)
        return after, emitted | BACK1
    if c in (SPACE, BLANK):
        kind = "s" if c == SPACE else "o"
        return ("W2" + kind, 0) if state[0] == "W" else ("W1" + kind, HERE)
    if state[0] == "W":
        emitted = (BACK1 if state[1] == "2" else 0) | (HERE if state[2] == "o" else 0)
        quoted = state[2] == "o"
    else:
        same = {"letters": _WORDY, "number": (NUMBER,), "other": (QUOTE, OTHER)}
        if c in same.get(state, ()):
            return state, 0
        emitted, quoted = HERE, True
    if c == QUOTE:
        return ("Q" if quoted else "other"), emitted
    after = "letters" if c in _WORDY else "number" if c == NUMBER else "other"
    return after, emitted


def _tables() -> tuple[np.ndarray, np.ndarray]:
    pairs = [[_step(s, c) for c in range(N_CLASSES)] for s in _STATES]
    to = np.array([[_AT[p[0]] for p in row] for row in pairs], dtype=np.uint8)
    emit = np.array([[p[1] for p in row] for row in pairs], dtype=np.uint8)
    return to.ravel(), emit.ravel()


class Splitter:
    """Starts of pre-tokens, from a table of the class of every code point."""

    def __init__(self, classes: np.ndarray) -> None:
        self.classes = classes
        self.to, self.emit = _tables()

    def starts_of(self, symbols: np.ndarray) -> np.ndarray:
        """Positions in a row of classes at which pre-tokens start; END parts texts."""
        n = len(symbols)
        rows = -(-(n + 1) // CHUNK)
        grid = np.full(rows * CHUNK, END, dtype=np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        entry = self._entries(grid)
        emitted = np.empty((CHUNK, rows), dtype=np.uint8)
        state = entry.astype(np.intp)
        for k in range(CHUNK):
            at = state * N_CLASSES + grid[k]
            emitted[k] = self.emit[at]
            state = self.to[at].astype(np.intp)
        flat = emitted.T.ravel()
        found = np.zeros(len(flat), dtype=bool)
        found |= (flat & HERE) > 0
        found[:-1] |= (flat[1:] & BACK1) > 0
        found[:-2] |= (flat[2:] & BACK2) > 0
        return np.flatnonzero(found[:n])

    def _entries(self, grid: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered: maps of chunks, then their prefix scan.

        Maps soon become constant: a column is followed for all states until they agree.
        """
        n_states, rows = len(_STATES), grid.shape[1]
        maps = np.repeat(np.arange(n_states, dtype=np.uint8)[:, None], rows, axis=1)
        open_, k = np.arange(rows), 0
        while k < CHUNK and len(open_):
            maps[:, open_] = self.to[maps[:, open_].astype(np.intp) * N_CLASSES + grid[k, open_]]
            k += 1
            if k % 4 == 0 or k == CHUNK:
                differ = (maps[:, open_] != maps[0, open_]).any(axis=0)
                done = open_[~differ]
                self._finish(maps, grid, done, k)
                open_ = open_[differ]
        step = 1
        while step < rows:
            maps[:, step:] = np.take_along_axis(
                maps[:, step:], maps[:, :-step].astype(np.intp), axis=0
            )
            step *= 2
        return np.concatenate(([_AT["begin"]], maps[_AT["begin"], :-1]))

    def _finish(self, maps: np.ndarray, grid: np.ndarray, which: np.ndarray, k: int) -> None:
        if len(which):
            state = maps[0, which].astype(np.intp)
            part = grid[k:, which]
            for row in part:
                state = self.to[state * N_CLASSES + row].astype(np.intp)
            maps[:, which] = state.astype(np.uint8)


class Merger:
    """Tokens of a pre-token's bytes, by a transducer whose states are found as they are met."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> None:
        self.merges = merges
        self.tokens = list(ranks)
        number = {t: i for i, t in enumerate(self.tokens)}
        self.children: list[dict[int, int]] = [{}]
        self.item: list[int] = [-1]
        for t in self.tokens:
            node = 0
            for b in t:
                child = self.children[node].get(b)
                if child is None:
                    child = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.item.append(-1)
                node = child
            if self.merge(t) == [t]:
                self.item[node] = number[t]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        #: A state: its (trie node, last token before its start, tokens there minus tokens here).
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.start = self._state(((0, -1, 0),))

    def _state(self, content: tuple) -> int:
        at = self.states.get(content)
        if at is None:
            at = self.states[content] = len(self.content)
            self.content.append(content)
            self.arcs.append({})
        return at

    def merge(self, word: bytes) -> list[bytes]:
        """Merging by rank as defined, for single tokens and pairs of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min(
                (self.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))
            )
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their bytes meet."""
        if left < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * MOST_WORDS:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left, right] = self.merge(a + b) == [a, b]
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        here, last, change = [], None, 0
        for node, before, offset in self.content[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            here.append((child, before, offset))
            item = self.item[child]
            if last is None and item >= 0 and self.follows(before, item):
                last, change = item, offset + 1
        content = [(c, b, o - change) for c, b, o in here if self.children[c]]
        to = self._state((*content, (0, last, 0)))
        self.arcs[state][byte] = to, change
        return to, change

    def count(self, word: bytes) -> int:
        if len(self.content) > MOST_STATES:
            self._clear()
        state, total, arcs = self.start, 0, self.arcs
        for byte in word:
            arc = arcs[state].get(byte)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc[0]
            total += arc[1]
        return total

    def counts(self, words: list[str]) -> int:
        """Tokens of all pre-tokens; the counts of short ones are kept."""
        known, total = self.words, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w.encode())
                if len(w) <= SHORT:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


class Tokenizer:
    """A compiled byte-level BPE file."""

    def __init__(self, definition: str, classes: bytes) -> None:
        spec = json.loads(definition)
        of_char = {c: b for b, c in _byte_chars().items()}
        plain = lambda s: bytes(of_char[c] for c in s)
        specials = {t["content"] for t in spec.get("added_tokens") or ()}
        vocabulary = {
            plain(t): i for t, i in spec["model"]["vocab"].items() if t not in specials
        }
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = {(plain(a), plain(b)): i for i, (a, b) in reversed([*enumerate(pairs)])}
        self.merger = Merger(vocabulary, merges)
        self.splitter = Splitter(np.frombuffer(zlib.decompress(classes), dtype=np.uint8))
        self.special = (
            re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
            if specials
            else None
        )

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts are laid end to end and split in one run of the grid."""
        out = [0] * len(texts)
        pieces: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            parts = [t]
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
                out[i] += len(parts) - 1
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(i)
        symbols, spot, at = [], [], 0
        end = np.array([END], dtype=np.uint8)
        for p in pieces:
            codes = np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)
            symbols += [self.splitter.classes[codes], end]
            spot.append(at)
            at += len(p) + 1
        if not pieces:
            return out
        starts = self.splitter.starts_of(np.concatenate(symbols))
        bounds = np.searchsorted(starts, [*spot, at]).tolist()
        for i, p, base, lo, hi in zip(owner, pieces, spot, bounds, bounds[1:]):
            cuts = (starts[lo:hi] - base).tolist()
            words = [p[a:b] for a, b in zip(cuts, [*cuts[1:], len(p)])]
            out[i] += self.merger.counts(words)
        return out


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files: itself, or 256 and up in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def character_classes(definition: str) -> bytes:
    """The class of every code point (compressed), read off the file's pre-tokenizer.

    A character is a letter if it joins an ``a``, a number if it joins a ``1``, white space if
    it joins neither those nor a full stop, else it is another mark. Planes without characters
    and private planes are marks.
    """
    from tokenizers import Tokenizer as Library

    split = Library.from_str(definition).pre_tokenizer.pre_tokenize_str
    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for lo in range(0, len(points), 4096):
        some = points[lo : lo + 4096]
        for c, kind in zip(some, _probe(split, some), strict=True):
            out[c] = kind
    for chars, kind in (("stmd", SINGLE), ("rv", R_V), ("l", ELL), ("e", EE)):
        out[[ord(c) for c in chars]] = kind
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    return zlib.compress(out.tobytes())


def _probe(split, points: list[int]) -> Iterator[int]:
    """Frames of a, 1 and a full stop, each followed by x: where the splits fall tells what x joins."""
    frames = [f"\n\na{chr(c)}\n\n1{chr(c)}\n\n.{chr(c)}" for c in points]
    whole = "".join(frames)
    begins = {s for _, (s, _) in split(whole)}
    at = 0
    for frame in frames:
        joins = [at + 3 + 4 * k not in begins for k in range(3)]
        yield LETTER if joins[0] else NUMBER if joins[1] else OTHER if joins[2] else BLANK
        at += len(frame)


@lru_cache(maxsize=2)
def compiled(definition: str, classes: bytes) -> Tokenizer:
    """Once per Python worker and file."""
    return Tokenizer(definition, classes)


def with_token_counts(
    docs: DataFrame, definition: str, text: str = "text", out: str = "token_count"
) -> DataFrame:
    """``docs`` with ``struct<n_bytes, n_tokens>``; ``definition`` is the tokenizer file's content.

    The file's size bounds what is sent to the workers, whatever the size of the table.
    """

    classes = character_classes(definition)

    def each(texts: pd.Series) -> pd.DataFrame:
        tokenizer = compiled(definition, classes)
        whole = [t or "" for t in texts]
        counts: list[int] = []
        at = 0
        while at < len(whole):
            end, chars = at, 0
            while end < len(whole) and (end == at or chars + len(whole[end]) <= GROUP):
                chars += len(whole[end])
                end += 1
            counts += tokenizer.count_all(whole[at:end])
            at = end
        return pd.DataFrame({"n_bytes": [len(t.encode()) for t in whole], "n_tokens": counts})

    count = F.pandas_udf(each, "struct<n_bytes:bigint,n_tokens:bigint>")
    return docs.withColumn(free_name(docs, out), count(F.col(text)))
