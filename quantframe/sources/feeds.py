"""Two views of the same bars with different powers.

A strategy reads through :class:`HistoricalFeed`: every method takes an ``as_of`` and shows
nothing that closed after it. A simulated venue reads through :class:`ExecutionFeed`: it knows
the open of the session it fills in and the volume of the sessions before, and has no method
that shows a close. The views keep the bars to themselves, so neither can be read past.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.operators import bars as ops
from quantframe.operators.decisions import at_decisions


class HistoricalFeed:
    """What a strategy is permitted to know at a point in time."""

    def __init__(self, bars: DataFrame):
        self.__bars = bars

    def history(
        self, *, as_of: date, count: int | None = None, symbols: Sequence[str] | None = None
    ) -> DataFrame:
        """Bars up to the cutoff, or the last ``count`` of every symbol."""
        known = ops.read_bars(self.__asked(symbols), as_of=as_of)
        return known if count is None else ops.history(known, as_of, count)

    def latest(self, *, as_of: date, symbols: Sequence[str] | None = None) -> DataFrame:
        """The newest known bar of every symbol."""
        known = ops.read_bars(self.__asked(symbols), as_of=as_of)
        rest = F.struct("session", *ops.BAR_COLUMNS)
        return known.groupBy("symbol").agg(F.max_by(rest, "session").alias("b")).select("symbol", "b.*")

    def closes(self, symbols: Sequence[str] | None = None, *, as_of: date | DataFrame) -> DataFrame:
        """Last known closes: at one date, or at every ``as_of`` of a frame of decisions."""
        asked = self.__asked(symbols)
        if isinstance(as_of, DataFrame):
            return at_decisions(asked.select("symbol", "session", "close"), as_of)
        return ops.latest_closes(asked, as_of)

    def __asked(self, symbols: Sequence[str] | None) -> DataFrame:
        return self.__bars if symbols is None else self.__bars.filter(F.col("symbol").isin(*symbols))


class ExecutionFeed:
    """What a simulated venue is permitted to know when it fills an order."""

    def __init__(self, bars: DataFrame):
        self.__opens = bars.select("symbol", "session", "open")
        self.__volumes = bars.select("symbol", "session", "volume")

    def open_price(self, orders: DataFrame) -> DataFrame:
        """``orders`` (symbol, session, ...) with their session's ``open``, null if it has none."""
        return orders.join(self.__opens, ["symbol", "session"], "left")

    def average_volume(self, orders: DataFrame, window: int = 20) -> DataFrame:
        """``orders`` with ``adv``, the mean volume of the sessions strictly before theirs."""
        known = ops.average_volume(self.__volumes, window).select("symbol", "session", "adv")
        return orders.join(known, ["symbol", "session"], "left")
