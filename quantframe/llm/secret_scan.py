"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Kinds ``assign access hex`` come from fixed patterns. Kind ``random`` comes from two first-order
character models: one of random strings, one of ordinary identifiers. A token of at least
``MIN_TOKEN`` characters that no pattern covers is reported when the log-likelihood ratio of
random against ordinary is at least ``THRESHOLD`` nats in all and ``PER_CHAR`` per character.

The models are trained from labelled samples that the corpus itself holds: the values inside
pattern matches are the random class, all other identifiers of at least ``MIN_NAME`` characters
the ordinary class. Transition counts are added up per task and then over all tasks; what
reaches the driver is one count per class and pair of symbols, at most
``2 * (SYMBOLS + 1) ** 2`` rows. Every document counts.

Defined results: a null text is empty; without samples of a class its model is uniform, so an
empty corpus adds no ``random`` spans; spans of one kind never overlap.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name, meets

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
RANK = {k: i for i, k in enumerate(KINDS)}
MIN_TOKEN, MIN_NAME = 20, 8
THRESHOLD, PER_CHAR = 12.0, 0.5
PSEUDO, BACKOFF = 0.5, 10.0

_KEY = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+")
_NAME = re.compile(rf"\b[A-Za-z0-9_]{{{MIN_NAME},}}+", re.ASCII)

#: Symbols of the models: ASCII letters, digits, the marks of encoded strings.
_SYMBOL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SYMBOLS = len(_SYMBOL)
_CODE = np.full(128, SYMBOLS, dtype=np.int64)
_CODE[[ord(c) for c in _SYMBOL]] = range(SYMBOLS)
_SIDE = SYMBOLS + 1


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    folded = text.lower()
    if any(k in folded for k in _KEY):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield "assign", *m.span()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 16:
                yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()


def transitions(token: str) -> np.ndarray:
    """Codes of the pairs (previous symbol, symbol); the first follows a start symbol."""
    codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8)]
    return np.concatenate(([SYMBOLS], codes[:-1])) * _SIDE + codes


def samples(text: str) -> Iterator[tuple[int, str]]:
    """(class, token): 1 for a secret's value, 0 for an identifier outside every pattern match."""
    spans = sorted((s, e, k) for k, s, e in base_spans(text))
    at = 0
    for s, e, kind in spans:
        yield from ((0, n) for n in _NAME.findall(text[at:s]))
        value = _ASSIGN.match(text, s)[2] if kind == "assign" else text[max(s, at) : e]
        if value:
            yield 1, value
        at = max(at, e)
    yield from ((0, n) for n in _NAME.findall(text[at:]))


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each transition, random against ordinary, as a square matrix."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, _SIDE * _SIDE), dtype=np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for t in batch["text"]:
                seen.update(samples(t or ""))
            for kind in (0, 1):
                words = [(w, n) for (k, w), n in seen.items() if k == kind]
                if words:
                    pairs = [transitions(w) for w, _ in words]
                    times = np.repeat([n for _, n in words], [len(p) for p in pairs])
                    np.add.at(total[kind], np.concatenate(pairs), times)
        kind, pair = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "pair": pair, "n": total[kind, pair]})

    rows = (
        docs.select(F.col(text).alias("text"))
        .mapInPandas(count, "kind int, pair int, n bigint")
        .groupBy("kind", "pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros((2, _SIDE, _SIDE))
    for r in rows:
        counts[r["kind"], r["pair"] // _SIDE, r["pair"] % _SIDE] += r["n"]
    # A symbol's own share stands in where its transitions are rare.
    share = counts.sum(axis=1) + PSEUDO
    share /= share.sum(axis=1, keepdims=True)
    counts += BACKOFF * share[:, None, :]
    logs = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def find_spans(text: str | None, ratio: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, log-likelihood ratio) by start, then kind as listed."""
    text = text or ""
    flat = ratio.ravel()

    def llr(token: str) -> float:
        return float(flat[transitions(token)].sum())

    base = [(s, e, k, llr(text[s:e])) for k, s, e in base_spans(text)]
    covered = meets((s, e) for s, e, _, _ in base)
    extra = []
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        if mixed and not covered(s, e):
            value = llr(m[0])
            if value >= max(THRESHOLD, PER_CHAR * (e - s)):
                extra.append((s, e, "random", value))
    return sorted(base + extra, key=lambda x: (x[0], RANK[x[2]], x[1]))


SPAN = "struct<start:int,end:int,kind:string,score:double>"


def with_secrets(
    docs: DataFrame, ratio: np.ndarray, text: str = "text", out: str = "secret_spans"
) -> DataFrame:
    """``docs`` with an array of spans; ``out`` gets underscores where the name is taken."""

    @F.pandas_udf(f"array<{SPAN}>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_spans(t, ratio))

    return docs.withColumn(free_name(docs, out), scan(F.col(text)))
