"""Column-level helpers shared by the operators."""

from quantframe.functions.columns import (
    clean_double,
    div,
    literal_grid,
    quantize,
    quantize_cash,
    round_at,
    round_to_lot,
    safe_div,
)

__all__ = [
    "clean_double",
    "div",
    "literal_grid",
    "quantize",
    "quantize_cash",
    "round_at",
    "round_to_lot",
    "safe_div",
]
