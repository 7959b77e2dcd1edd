"""Rows that every operator has to take."""

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (None, "text of a row without an id"),
    (5, "same words here twice"),
    (5, "same words here twice"),
    (6, "x" * 30_000),
    (7, "word " * 20_000),
    (8, "é ñ 日本 🙂 ▁ </s>[INST] <|endoftext|>"),
]
