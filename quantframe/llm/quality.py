"""Quality rules as weak supervision.

Each rule reads a few measures of a text and votes +1 (fit), -1 (unfit) or 0 (abstains).
Expectation-maximisation over the counts of vote patterns estimates, without labels, how often
each rule votes either way on fit and on unfit texts; the posterior probability of being fit
then replaces "all rules must pass". The pattern table has at most ``3 ** len(RULES)`` rows at
any size of the corpus, and every document counts in it. Nothing else reaches the driver.

Defined results: a null or empty text has no words, measures of zero and fails the base rules;
a base failure (fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent of words
in repeated windows) is never kept; equal texts get equal verdicts; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name, shared

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
THRESHOLD = 0.5
PRIOR_VOTES = 20.0
#: Votes against are cast far outside the usual range: fit texts draw one from a rule this rarely.
FALSE_ALARM = 0.002

_SYMBOLS, _SHOUTS, _SPACES = list(b"#*$%&|<>"), list(b"!?"), list(b"\x20\x09\x0a\x0b\x0c\x0d")

MEASURES = (
    "n_words n_symbols n_dup_lines n_repeat_words word_chars n_lines n_distinct n_upper n_letters "
    "n_shouts n_digits"
).split()
MEASURED = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more.

    Windows get exact numbers, one word longer at a time, until they are all different.
    """
    n = len(words)
    ids: dict[bytes, int] = {}
    single = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    level, distinct = single, len(ids)
    for span in range(1, width):
        if distinct == len(level):
            return 0
        values, level = np.unique(level[:-1] * n + single[span:], return_inverse=True)
        distinct = len(values)
    starts = np.flatnonzero(np.bincount(level)[level] > 1) if len(level) else level
    edge = np.zeros(n + width, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``, most from its byte histogram."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper = seen[65:91].sum()
    return (
        len(words),
        int(seen[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - int(seen[_SPACES].sum() + seen[0x80:0xC0].sum()),
        len(lines),
        len(set(words)),
        int(upper),
        int(upper + seen[97:123].sum() + seen[0xC3:].sum()),
        int(seen[_SHOUTS].sum()),
        int(seen[48:58].sum()),
    )


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES)


@dataclass(frozen=True)
class Rule:
    """Votes +1 while ``value`` is at or inside ``fit``, -1 at or beyond ``unfit``, else 0."""

    name: str
    value: Column
    fit: float
    unfit: float

    def vote(self, m: Column) -> Column:
        up = self.fit < self.unfit
        inside = self.value <= self.fit if up else self.value >= self.fit
        beyond = self.value >= self.unfit if up else self.value <= self.unfit
        return F.when(inside, 1).when(beyond, -1).otherwise(0)


def rules(m: Column) -> list[Rule]:
    words = F.greatest(m["n_words"], F.lit(1))
    letters = F.greatest(m["n_letters"], F.lit(1))
    return [
        Rule("enough_words", m["n_words"], 40, MIN_WORDS - 1),
        Rule("short_words", m["word_chars"] / words, 10.0, 15.0),
        Rule("long_words", m["word_chars"] / words, 3.0, 2.0),
        Rule("few_symbols", m["n_symbols"] / words, 0.05, 0.2),
        Rule("fresh_lines", m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), 0.1, 0.3),
        Rule("fresh_windows", m["n_repeat_words"] / words, 0.05, 0.2),
        Rule("varied_words", m["n_distinct"] / F.pow(words, 0.75), 0.5, 0.25),
        Rule("calm_case", m["n_upper"] / letters, 0.2, 0.5),
        Rule("calm_marks", m["n_shouts"] / words, 0.1, 0.3),
        Rule("few_digits", m["n_digits"] / words, 0.5, 4.0),
    ]


@dataclass(frozen=True)
class Model:
    """``logit P(fit)`` is ``prior`` plus the weights of the votes; abstaining says nothing."""

    prior: float
    fit: tuple[float, ...]
    unfit: tuple[float, ...]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Model:
    """Two-class EM over vote patterns (rows of -1, 0, 1) and their counts.

    A text starts as unfit if a rule says so. Two things keep the classes in place: pseudo-counts
    of ``PRIOR_VOTES`` texts or one percent of the corpus, whichever is more, that take rules to
    be right more often than wrong, and the bound ``FALSE_ALARM`` on votes against fit texts.
    """
    n_rules = patterns.shape[1]
    if not len(patterns):
        return Model(0.0, (0.0,) * n_rules, (0.0,) * n_rules)
    total = counts.sum()
    against = (patterns < 0).sum(axis=1)
    good = np.where(against == 0, 0.99, 0.05)
    onehot = np.stack([patterns == v for v in (1, -1)], axis=2).astype(float)
    weight = max(PRIOR_VOTES, 0.01 * total)
    believe = {1: np.array([0.98, 0.02]), 0: np.array([0.8, 0.2])}
    for _ in range(rounds):
        chance = {}
        for y, share in ((1, good * counts), (0, (1 - good) * counts)):
            seen = np.einsum("p,prv->rv", share, onehot) + weight * believe[y]
            chance[y] = seen / seen.sum(axis=1, keepdims=True)
        chance[1][:, 1] = np.minimum(chance[1][:, 1], FALSE_ALARM)
        chance[1][:, 0] = 1 - chance[1][:, 1]
        prior = np.log(((good * counts).sum() + 9) / (((1 - good) * counts).sum() + 1))
        weights = np.log(chance[1]) - np.log(chance[0])
        logit = prior + np.einsum("prv,rv->p", onehot, weights)
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return Model(float(prior), *(tuple(map(float, weights[:, v])) for v in range(2)))


def with_measures(docs: DataFrame, text: str, out: str) -> DataFrame:
    return docs.withColumn(out, F.pandas_udf(_measures, MEASURED)(F.col(text)))


def fit(measured: DataFrame, out: str) -> Model:
    """EM over all rows of a table that :func:`with_measures` made."""
    votes = [r.vote(F.col(out)).alias(f"v{i}") for i, r in enumerate(rules(F.col(out)))]
    seen = measured.select(*votes)
    table = seen.groupBy(*seen.columns).count().toPandas().sort_values(seen.columns)
    return fit_votes(table[seen.columns].to_numpy(), table["count"].to_numpy(dtype=float))


def posterior(model: Model, m: Column) -> Column:
    logit = F.lit(model.prior)
    for rule, f, u in zip(rules(m), model.fit, model.unfit, strict=True):
        v = rule.vote(m)
        logit = logit + F.when(v == 1, f).when(v == -1, u).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def judge(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, Column, Column]:
    """(table, name of its measures, posterior, kept). The table is written once and re-read."""
    out = free_name(docs, "quality_measures")
    measured = shared(with_measures(docs, text, out), "quality")
    p = posterior(fit(measured, out), F.col(out))
    kept = ~base_failed(F.col(out)) & (p >= THRESHOLD)
    return measured, out, p, kept


def keep_fit(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is judged fit, with the columns of ``docs``."""
    measured, out, _, kept = judge(docs, text)
    return measured.filter(kept).drop(out)
