"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds ``email ip card phone`` are always reported when their pattern and checksum hold. Kinds
``iban local_phone`` need a score of at least ``THRESHOLD``: the pattern gives a starting score,
a passed checksum raises it, words of the kind's vocabulary within ``REACH`` code points raise
it, words that name something else (order, version, ...) lower it.

Defined results: a null text is empty and has no spans; spans of one kind never overlap; spans
of different kinds may. Time grows with a text's length alone, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name, meets

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
RANK = {k: i for i, k in enumerate(KINDS)}
REACH = 40
THRESHOLD = 0.5

#: Starting score by kind, before checksum and context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "local_phone": 0.2}
CHECKSUM_GAIN, CONTEXT_GAIN, CONTEXT_LOSS = 0.4, 0.35, 0.3

#: Words that speak for a kind, as stems in four languages.
SUPPORT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "llam", "appel"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "llam", "appel"),
}
#: Words that speak against the unsure kinds.
AGAINST = re.compile(r"\b(?:order|version|isbn|invoice|part|serial|build|page|chapter)\b")
_SUPPORT = {k: re.compile(r"\b(?:" + "|".join(v) + ")") for k, v in SUPPORT.items()}

#: Characters of an account number by country, from the public registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.A)
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9][0-9\x20-]{4,12}[0-9]\b", re.A)
_DIGITS = str.maketrans("", "", "+ ().-/")

SPAN = "struct<start:int,end:int,kind:string,checked:boolean,score:double>"


def luhn(digits: str) -> bool:
    """Digits from the right, every second doubled, digit sums add up to a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """The account number, its first four characters moved last and letters as 10 to 35."""
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``local@host.tld``, found from each ``@`` outward so that no run is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if local else None
        if host:
            yield at - local, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod-97: a whole match, else its first part of the country's length, so that
    a capital word behind the number does no harm. A search goes on behind what was found, or at
    the next word; a match has at most 44 characters."""
    at = 0
    while m := _IBAN.search(text, at):
        at, end = m.start() + 1, m.end()
        if not mod97(m[0]):
            ends = [i + 1 for i in range(*m.span()) if text[i] != " "]
            length = IBAN_LENGTH.get(m[0][:2], 0)
            end = ends[length - 1] if 0 < length < len(ends) and text[ends[length - 1]] == " " else 0
        if end and mod97(text[m.start() : end]):
            yield m.start(), end
            at = end


def _digits_between(low: int, high: int, span: str) -> str | None:
    digits = span.translate(_DIGITS)
    return digits if low <= len(digits) <= high else None


def propose(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checksum passed) of every confirmed proposal."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e, False
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), False
    cards = []
    for m in _CARD.finditer(text):
        digits = _digits_between(14, 19, m[0])
        if digits and luhn(digits):
            cards.append(m.span())
            yield "card", *m.span(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if _digits_between(10, 15, m[0]):
                yield "phone", *m.span(), False
    for s, e in ibans(text):
        yield "iban", s, e, True
    on_card = meets(cards)
    for m in _LOCAL_PHONE.finditer(text):
        if _digits_between(7, 15, m[0]) and not on_card(*m.span()):
            yield "local_phone", *m.span(), False


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    value = PRIOR[kind] + CHECKSUM_GAIN * checked
    value += CONTEXT_GAIN * bool(_SUPPORT[kind].search(near))
    value -= CONTEXT_LOSS * bool(AGAINST.search(near))
    return min(1.0, max(0.0, value))


def find_spans(text: str | None) -> list[tuple[int, int, str, bool, float]]:
    """(start, end, kind, checked, score) by start, then kind as listed."""
    text = text or ""
    found = [
        (s, e, k, c, v)
        for k, s, e, c in propose(text)
        if (v := score(text, k, s, e, c)) >= THRESHOLD or k in BASE_KINDS
    ]
    return sorted(found, key=lambda x: (x[0], RANK[x[2]], x[1]))


def redact(text: str, spans: list[tuple[int, int, str, bool, float]]) -> str:
    """Each stretch covered by spans becomes ``<KIND>`` of the first span in it."""
    out, at = [], 0
    for s, e, kind, _, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _spans_of(texts: pd.Series) -> pd.Series:
    return texts.map(find_spans)


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else redact(t, find_spans(t)))


def with_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of spans; ``out`` gets underscores where the name is taken."""
    find = F.pandas_udf(_spans_of, f"array<{SPAN}>")
    return docs.withColumn(free_name(docs, out), find(F.col(text)))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind; a null text stays null."""
    return docs.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))


def rendered(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, of the given kinds only, comma-joined in their order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
