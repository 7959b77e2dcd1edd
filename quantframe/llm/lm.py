"""Class-based bigram scoring.

Every word has two classes: one as the word that stands before (the predicting class) and one as
the word that follows (its own class). Both come from exchange clustering:

    P(text) = product of P(own class | predicting class of the word before) * P(word | own class)

over its words and one end token, which has a class of its own and stands before the first word.

* Predicting classes have to be known wherever a text is read, so they are few: the ``HEAD`` most
  frequent words are units of their own, all others share ``SUFFIXES`` units by their last three
  bytes, and units are exchanged between ``CLASSES`` classes as long as the likelihood of the
  class bigrams rises.
* Own classes are found for the whole vocabulary. Every training word seen ``RARE`` times or more
  is exchanged by itself, given how often it follows each predicting class; rarer words have too
  little to go by and are exchanged together with those of their ending. The number of classes
  grows with the cube root of the vocabulary. The ``SEEDS`` most frequent words are exchanged
  first; then the others are placed, and sweeps over the vocabulary's table move half of its
  words each, against the class table of the sweep before, while the likelihood rises. So
  results depend neither on partitions nor on the order of rows.

Transitions are smoothed towards the class frequencies, emissions by ``DELTA`` with one slot for
unseen words in every class, so the probabilities over all words and "unseen" add up to one.

All counts cover every training text: counts of words, of unit pairs and of (predicting class,
word) are added up per task and then by shuffles. To the driver come the words above a count at
which at most ``KNOWN`` of them are left (they are sent to the tasks), at most ``UNITS ** 2``
pair counts, the seeds' counts, and tables of ``CLASSES`` times the own classes. The counts and
classes of all other words meet the texts' words by a join on the word.

Defined results: a null text is empty and scores as an end token alone; words are lower-cased
in A-Z; a null id counts as training; without training texts every count is zero and the
classes are uniform; equal rows stay separate; where the caller has a column of a result's
name, the result gets underscores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name, shared

HEAD, SUFFIXES, CLASSES = 383, 128, 32
UNITS = HEAD + SUFFIXES + 1
END = UNITS - 1
KNOWN = 200_000
RARE, SEEDS, SWEEPS = 4, 4_096, 2
DELTA, ALPHA = 1.0, 1.0
FOLDS, HELD = 7, 2
_FLUSH, _RUN, _HELD = 500_000, 100_000, 4_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        yield from batch.column("text").cast(pa.binary()).to_pylist()


def _runs(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """The lower-cased words of whole texts, the empty word for the end after each text's, some
    ``_RUN`` words at a time."""
    run: list[bytes] = []
    for text in texts:
        if text:
            run += text.lower().split()
        run.append(b"")
        if len(run) >= _RUN:
            yield run
            run = []
    if run:
        yield run


class _Numbers(dict[bytes, int]):
    """Numbers of words in the order they come; ``fresh`` are those not yet looked at."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number

    def of(self, run: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, run), dtype=np.int64, count=len(run))


def _strings(words: Iterable[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        n = pa.array(list(seen.values()), pa.int64())
        return pa.RecordBatch.from_arrays([_strings(list(seen)), n], ["word", "n"])

    for text in _texts(batches):
        if text:
            seen.update(text.lower().split())
        if len(seen) > _FLUSH:
            yield rows()
            seen.clear()
    yield rows()


def suffix_unit(word: bytes) -> int:
    return HEAD + crc32(word[-3:]) % SUFFIXES


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = 30) -> np.ndarray:
    """The class of each unit (the last unit alone in the last class), from its bigram counts.

    Units are visited from the most frequent; each goes to the class that gains most likelihood;
    sweeps end when nothing moves.
    """
    n = len(pairs)
    own = pairs.diagonal().astype(float)
    pairs = pairs.astype(float)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[: n - 1], kind="stable")
    of = np.empty(n, dtype=np.int64)
    of[order] = np.arange(n - 1) % (classes - 1)
    of[n - 1] = classes - 1

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = False
        for u in order:
            if not pairs[u].any() and not pairs[:, u].any():
                continue
            right = np.bincount(of, weights=pairs[u], minlength=classes)
            left = np.bincount(of, weights=pairs[:, u], minlength=classes)
            home = of[u]
            right[home] -= own[u]
            left[home] -= own[u]
            table[home] -= right
            table[:, home] -= left
            table[home, home] -= own[u]
            k = np.arange(classes)
            rows = f(table + right).sum(1) - f(table).sum(1)
            cols = f(table.T + left).sum(1) - f(table.T).sum(1)
            corner = table[k, k]
            gain = (
                rows
                + cols
                - f(corner + right)
                - f(corner + left)
                + f(corner)
                + f(corner + right + left + own[u])
            )
            # What other classes hold of u's pairs counts in their totals wherever u goes.
            out, into = table.sum(1) + left, table.sum(0) + right
            total = right.sum() + own[u], left.sum() + own[u]
            gain -= f(out + total[0]) - f(out) + f(into + total[1]) - f(into)
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9 * abs(gain[home]):
                best = int(home)
            of[u] = best
            moved |= best != home
            table[best] += right
            table[:, best] += left
            table[best, best] += own[u]
        if not moved:
            break
    return of


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """What the own classes change of the training tokens' log likelihood."""
    return float(_f(table).sum() - _f(table.sum(0)).sum())


def best_classes(
    size: np.ndarray,
    before: np.ndarray,
    n: np.ndarray,
    home: np.ndarray,
    table: np.ndarray,
    logs: np.ndarray,
) -> np.ndarray:
    """The class of most likelihood for each word, its present one unless another is better.

    A word has ``size`` entries (predicting class before it, times); ``home`` is its class, whose
    column of ``table`` holds the word already, or -1. ``logs`` is ``_f(table)``. The last class
    is the end's alone.
    """
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    total = table.sum(0)
    sums = np.add.reduceat(n, first)[:, None]
    gain = np.add.reduceat(_f(table[before] + n[:, None]) - logs[before], first)
    gain -= _f(total + sums) - _f(total)
    gain[:, -1] = -np.inf
    (held,) = np.nonzero(home >= 0)
    if len(held):
        own = np.repeat(np.maximum(home, 0), size)
        there = table[before, own]
        stay = np.add.reduceat(_f(there) - _f(there - n), first)[held]
        whole = total[home[held]]
        stay -= _f(whole) - _f(whole - sums[held, 0])
        gain[held, home[held]] = stay
    best = gain.argmax(1)
    better = gain[np.arange(len(best)), best]
    if len(held):
        kept = better[held] <= stay + 1e-9 * np.abs(stay)
        best[held[kept]] = home[held[kept]]
    return best


def _exchange_rows(rows: np.ndarray, of: np.ndarray, table: np.ndarray, sweeps: int) -> None:
    """Moves words, one row of counts each, one after the other; ``of`` and ``table`` change."""
    logs = _f(table)
    for _ in range(sweeps):
        moved = False
        for w, row in enumerate(rows):
            (before,) = np.nonzero(row)
            if not len(before):
                continue
            n, home = row[before], of[w]
            size = np.array([len(before)])
            best = best_classes(size, before, n, of[w : w + 1], table, logs)[0]
            if best != home:
                moved = True
                if home >= 0:
                    table[before, home] -= n
                    logs[before, home] = _f(table[before, home])
                table[before, best] += n
                logs[before, best] = _f(table[before, best])
                of[w] = best
        if not moved:
            break


@dataclass(frozen=True)
class Model:
    known: dict[bytes, int]
    known_count: np.ndarray
    known_class: np.ndarray
    #: Predicting classes of the known words and of all units.
    known_before: np.ndarray
    before_of_unit: np.ndarray
    #: Own class of the rare and unseen words of each ending.
    class_of_ending: np.ndarray
    #: log10 P(own class | predicting class), and the denominators of the emissions by class.
    step: np.ndarray
    mass: np.ndarray
    end_count: int
    tokens: int
    distinct: int


def _unit(word: bytes, head: dict[bytes, int]) -> int:
    if not word:
        return END
    unit = head.get(word, -1)
    return suffix_unit(word) if unit < 0 else unit


def _unit_runs(
    texts: Iterable[bytes | None], head: dict[bytes, int], unit_class: np.ndarray, full: Callable
) -> Iterator[tuple[_Numbers, np.ndarray, np.ndarray, np.ndarray]]:
    """By run: the numbering, its words by number, what ``unit_class`` has for each, and for the
    one before. ``full(words, tokens)`` tells whether to begin a new numbering."""
    numbers, of, tokens = _Numbers(), np.zeros(0, dtype=np.int64), 0
    for run in _runs(texts):
        at = numbers.of(run)
        units = [_unit(w, head) for w in numbers.fresh]
        of = np.concatenate([of, unit_class[np.array(units, dtype=np.int64)]])
        numbers.fresh.clear()
        now = of[at]
        # A run begins after the end of a text, as a text does.
        yield numbers, at, now, np.concatenate([unit_class[END:], now[:-1]])
        tokens += len(run)
        if full(len(numbers), tokens):
            numbers, of, tokens = _Numbers(), np.zeros(0, dtype=np.int64), 0


def _count_after(head: dict[bytes, int], before_of_unit: np.ndarray):
    """By task and word, how often it follows each predicting class; the end is the empty word."""

    def full(words: int, tokens: int) -> bool:
        return words > _FLUSH or tokens > _HELD

    def rows(numbers: _Numbers, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        # Every numbered word occurs, so the words are those of the numbering, in order.
        first = np.searchsorted(code, np.arange(len(numbers) + 1) * CLASSES)
        entries = pa.StructArray.from_arrays(
            [pa.array((code % CLASSES).astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "n"]
        )
        after = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), entries)
        batch = pa.RecordBatch.from_arrays([_strings(list(numbers)), after], ["word", "after"])
        for start in range(0, len(numbers), 50_000):
            yield batch.slice(start, 50_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, []
        for numbers, at, _, before in _unit_runs(_texts(batches), head, before_of_unit, full):
            if last is not None and last is not numbers:
                yield from rows(last, codes)
                codes = []
            last = numbers
            narrow = len(numbers) < 1 << 26
            codes.append((at * CLASSES + before).astype(np.int32 if narrow else np.int64))
        if last is not None:
            yield from rows(last, codes)

    return count


def _ending(word: Column) -> Column:
    """:func:`suffix_unit` without the head, as an expression."""
    raw = word.cast("binary")
    last = F.when(F.length(raw) <= 3, raw).otherwise(F.substring(raw, -3, 3))
    return (F.crc32(last) % SUFFIXES).cast("int")


def _move(table: np.ndarray, turn: int | None):
    """Each word's best class against ``table``: of all words (None), or of every other word."""
    room, logs = max(1, 2_000_000 // table.shape[1]), _f(table)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = batch.column("after")
            flat = after.flatten()
            size = after.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            before = flat.field("k").to_numpy(zero_copy_only=False).astype(np.int64)
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(float)
            home = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            best = home.copy()
            at = 0
            while at < len(size):
                first = ends[at] - size[at]
                to = max(at + 1, int(np.searchsorted(ends, first + room, side="right")))
                part = slice(first, ends[to - 1])
                best[at:to] = best_classes(
                    size[at:to], before[part], n[part], home[at:to], table, logs
                )
                at = to
            if turn is not None:
                stays = batch.column("turn").to_numpy(zero_copy_only=False) != turn
                best[stays] = home[stays]
            index = batch.schema.get_field_index("class")
            yield batch.set_column(index, "class", pa.array(best.astype(np.int32)))

    return move


def _cluster(profile: DataFrame, classes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The table (word, c, after, turn, class) of all words that are not rare, the own class of
    each ending, and the table of predicting against own classes."""
    words = profile.filter((F.col("c") >= RARE) & (F.col("word") != ""))

    def matrix(rows: DataFrame, name: str, side: int, width: int) -> np.ndarray:
        got, out = rows.toArrow(), np.zeros((side, width))
        out[got[name].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        return out

    entry = F.explode("after").alias("e")
    endings = matrix(
        profile.filter((F.col("c") < RARE) & (F.col("word") != ""))
        .select(_ending(F.col("word")).alias("ending"), entry)
        .groupBy("ending", F.col("e.k").alias("k"))
        .agg(F.sum("e.n").alias("n")),
        "ending", SUFFIXES, CLASSES,
    )
    last = matrix(
        profile.filter("word = ''").select(F.lit(0).alias("row"), entry).select("row", "e.k", "e.n"),
        "row", 1, CLASSES,
    )
    ends = np.zeros((CLASSES, classes))
    ends[:, -1] = last[0]

    seeds = words.orderBy(F.desc("c"), "word").limit(SEEDS).select("word", "c", "after").collect()
    seeds.sort(key=lambda r: (-r["c"], r["word"]))
    rows = np.zeros((len(seeds), CLASSES))
    for i, r in enumerate(seeds):
        for k, n in r["after"]:
            rows[i, k] = n
    of = np.arange(len(seeds)) % (classes - 1)
    table = ends.copy()
    np.add.at(table.T, of, rows)
    _exchange_rows(rows, of, table, 8)
    of_ending = np.full(SUFFIXES, -1)
    _exchange_rows(endings, of_ending, table, 1)
    of_ending[of_ending < 0] = 0

    def state(frame: DataFrame) -> np.ndarray:
        held = frame.select("class", entry).groupBy("class", F.col("e.k").alias("k"))
        out = ends + matrix(held.agg(F.sum("e.n").alias("n")), "class", classes, CLASSES).T
        np.add.at(out.T, of_ending, endings)
        return out

    turn = (F.crc32(F.col("word").cast("binary")) % 2).cast("int")
    columns = ["word", "c", "after", turn.alias("turn")]
    fresh = words.select(*columns, F.lit(-1).alias("class"))
    placed = shared(fresh.mapInArrow(_move(table, None), fresh.schema), "lm-classes")
    table = state(placed)
    for sweep in range(SWEEPS):
        moved = shared(placed.mapInArrow(_move(table, sweep % 2), placed.schema), "lm-classes")
        after = state(moved)
        if likelihood(after) <= likelihood(table):
            break
        placed, table = moved, after
    _exchange_rows(endings, of_ending, table, 2)
    return placed, of_ending, table


def train(docs: DataFrame, text: str, learns: Column) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c, class) of the words it does not carry itself."""
    texts = docs.filter(learns).select(F.col(text).alias("text"))
    n_texts = texts.count()
    counts = shared(
        texts.mapInArrow(_count_words, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("c")),
        "lm-words",
    )
    level = F.floor(F.log2("c")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.sum("c").alias("tokens")
    )
    levels = sorted(((r["level"], r["words"], r["tokens"]) for r in sizes.collect()), reverse=True)
    least, taken = 1 << 62, 0
    for at, words, _ in levels:
        taken += words
        if taken > KNOWN:
            break
        least = 1 << at
    first = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    first.sort(key=lambda r: (-r["c"], r["word"]))
    head = {r["word"].encode(): i for i, r in enumerate(first)}

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, dtype=np.int64)
        full = lambda words, _: words > _FLUSH
        for _, _, now, before in _unit_runs(_texts(batches), head, np.arange(UNITS), full):
            total += np.bincount(before * UNITS + now, minlength=len(total))
        pair = np.flatnonzero(total)
        columns = [pa.array(pair.astype(np.int32)), pa.array(total[pair])]
        yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])

    summed = (
        texts.mapInArrow(count_pairs, "pair int, n bigint")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    pairs = np.zeros(UNITS * UNITS, dtype=np.int64)
    pairs[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    before = exchange(pairs.reshape(UNITS, UNITS))

    distinct = sum(w for _, w, _ in levels)
    classes = 3 + round(distinct ** (1 / 3))
    profile = shared(
        texts.mapInArrow(
            _count_after(head, before), "word string, after array<struct<k:int,n:bigint>>"
        )
        .repartition("word")
        .select("word", F.inline("after"))
        .groupBy("word", "k")
        .agg(F.sum("n").alias("n"))
        .groupBy("word")
        .agg(F.sum("n").alias("c"), F.collect_list(F.struct("k", "n")).alias("after")),
        "lm-after",
    )
    placed, of_ending, table = _cluster(profile, classes)
    ending = F.element_at(F.array(*map(F.lit, of_ending.tolist())), _ending(F.col("word")) + 1)
    rare = profile.filter((F.col("c") < RARE) & (F.col("word") != ""))
    final = placed.select("word", "c", "class").unionByName(
        rare.select("word", "c", ending.cast("int").alias("class"))
    )
    share = (table.sum(0) + 1) / (table.sum() + classes)
    step = (table + ALPHA * share) / (table.sum(1, keepdims=True) + ALPHA)
    mass = np.full(classes, DELTA)
    for r in final.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]] = r["n"] + DELTA * (r["v"] + 1)
    mass[-1] = n_texts + 2 * DELTA
    top = final.filter(F.col("c") >= least).toArrow()
    known = {w.encode(): i for i, w in enumerate(top["word"].to_pylist())}
    units = [head[w] if w in head else suffix_unit(w) for w in known]
    model = Model(
        known,
        top["c"].to_numpy(),
        top["class"].to_numpy().astype(np.int64),
        before[np.array(units, dtype=np.int64)],
        before,
        of_ending,
        np.log10(step),
        mass,
        n_texts,
        sum(t for _, _, t in levels) + n_texts,
        distinct + (n_texts > 0),
    )
    return model, final.filter(F.col("c") < least)


SCORED = "struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rest:string>"


def score_known(texts: Iterable[str | None], model: Model) -> Iterator[pd.DataFrame]:
    """Per text, sums over the words that the model carries and the end; the other words as
    ``predicting class TAB ending TAB times TAB word``, parted by spaces, neither of which a word
    can hold."""
    # The end comes after the known words.
    end, start = len(model.known), model.before_of_unit[END]
    c = np.append(model.known_count, model.end_count)
    own = np.append(model.known_class, len(model.mass) - 1)
    own_before = np.append(model.known_before, start)
    base = np.log10((c + 1) / (model.tokens + model.distinct + 1))
    emitted = np.log10((c + DELTA) / model.mass[own])
    for run in _runs(None if t is None else t.encode() for t in texts):
        found = map(model.known.get, run, repeat(-1))
        at = np.fromiter(found, dtype=np.int64, count=len(run))
        ends = np.array([i for i in np.flatnonzero(at < 0).tolist() if not run[i]])
        at[ends] = end
        held = at >= 0
        rest = np.flatnonzero(~held)
        words = [run[i] for i in rest.tolist()]
        units = np.array([suffix_unit(w) for w in words], dtype=np.int64)
        before = np.empty(len(run) + 1, dtype=np.int64)
        before[0], before[1:] = start, own_before[at]
        before[1:][rest] = model.before_of_unit[units]
        first = np.append(0, ends[:-1] + 1)
        text = np.searchsorted(ends, rest)
        other = Counter(zip(text.tolist(), before[rest].tolist(), (units - HEAD).tolist(), words))
        lines: list[list[str]] = [[] for _ in ends]
        for (i, b, u, w), n in other.items():
            lines[i].append(f"{b}\t{u}\t{n}\t{w.decode()}")
        score = emitted[at] + model.step[before[:-1], own[at]]
        yield pd.DataFrame({
            "n_tokens": ends + 1 - first,
            "n_known": np.add.reduceat((held & (c[at] > 0)).astype(np.int64), first),
            "base": np.add.reduceat(np.where(held, base[at], 0.0), first),
            "score": np.add.reduceat(np.where(held, score, 0.0), first),
            "rest": [" ".join(x) for x in lines],
        })


def with_scores(docs: DataFrame, model: Model, rest: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, base_score and score (log10)."""

    def each(texts: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(columns=["n_tokens", "n_known", "base", "score", "rest"])]
        parts = [*score_known(texts, model)] or parts
        return pd.concat(parts, ignore_index=True)

    step, mass, of_ending = model.step, model.mass, model.class_of_ending

    @F.pandas_udf("double")
    def one(before: pd.Series, ending: pd.Series, own: pd.Series, c: pd.Series) -> pd.Series:
        k, other = own.to_numpy(dtype=np.int64), ending.to_numpy(dtype=np.int64)
        k = np.where(k < 0, of_ending[other], k)
        value = np.log10((c.to_numpy(dtype=float) + DELTA) / mass[k])
        return pd.Series(value + step[before.to_numpy(dtype=np.int64), k])

    row, part, more = (free_name(docs, f"lm_{n}") for n in ("row", "part", "more"))
    scored = shared(
        docs.withColumn(row, F.monotonically_increasing_id())
        .withColumn(part, F.pandas_udf(each, SCORED)(F.col(text)))
        .drop(text),
        "lm-scored",
    )
    entry = F.split(F.col("entry"), "\t")
    words = (
        scored.filter(F.col(f"{part}.rest") != "")
        .select(F.col(row).alias("row"), F.explode(F.split(f"{part}.rest", " ")).alias("entry"))
        .select(
            "row",
            entry[0].cast("int").alias("before"),
            entry[1].cast("int").alias("ending"),
            entry[2].cast("int").alias("n"),
            entry[3].alias("word"),
        )
        .join(rest, "word", "left")
        .select(
            "row",
            "n",
            F.coalesce("c", F.lit(0)).alias("c"),
            one("before", "ending", F.coalesce("class", F.lit(-1)), F.coalesce("c", F.lit(0))).alias("log"),
        )
    )
    c, n = F.col("c"), F.col("n")
    base = F.log10((c + 1) / F.lit(model.tokens + model.distinct + 1))
    sums = words.groupBy(F.col("row").alias(row)).agg(
        F.struct(
            F.sum(F.when(c > 0, n).otherwise(0)).alias("n_known"),
            F.sum(n * base).alias("base"),
            F.sum(n * F.col("log")).alias("score"),
        ).alias(more)
    )
    joined = scored.withColumn(part, F.col(part).dropFields("rest")).join(sums, row, "left")
    added = lambda name: F.col(part)[name] + F.coalesce(F.col(more)[name], F.lit(0))
    results = {
        "n_tokens": F.col(part)["n_tokens"],
        "n_known": added("n_known"),
        "base_score": added("base"),
        "score": added("score"),
    }
    kept = docs.drop(text)
    return joined.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        *[value.alias(free_name(kept, name)) for name, value in results.items()],
    )
