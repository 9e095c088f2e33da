"""The normalizers of ``normalize`` that page operators need for single words, as plain functions with a memory.

A page's words repeat from page to page, so most calls are answered from the memory.  ``\\s`` is Unicode's White_Space
and ``$`` also stands before a closing line end, as in the expressions these follow.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_ends, _runs = re.compile(f"^{SPACE}+|{SPACE}+{END}"), re.compile(f"{SPACE}+")
_number = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\Z")
_marks = {marks: re.compile(f"^[{marks}]+|[{marks}]+{END}") for marks in (r" :\-,", r" :\-")}
_other = re.compile("[^a-z0-9]")
_edges = re.compile(f"^[^a-z0-9]+|[^a-z0-9]+{END}")
_colons = re.compile(f":+{END}")
_points = re.compile(r"[,.;:/\\|_#()\[\]{}]")
KEPT = 1 << 16


#: What no label begins with.
DIGITS = "0123456789"


def trimmed(s: str) -> str:
    return s if "!" <= s[:1] and "!" <= s[-1:] and s.isascii() else _trimmed(s)


@lru_cache(KEPT)
def _trimmed(s: str) -> str:
    return _ends.sub("", s)


@lru_cache(KEPT)
def text(s: str | None) -> str | None:
    if s is None:
        return None
    s = _runs.sub(" ", s).strip(" ").lower()
    return None if s in ("", "nan", "none") else s


@lru_cache(KEPT)
def norm(s: str | None) -> str:
    return text(s) or ""


@lru_cache(KEPT)
def alnum(s: str) -> str:
    return _other.sub("", s.lower())


@lru_cache(KEPT)
def label(s: str) -> str:
    """A normal form without colons at its end."""
    return _colons.sub("", s)


@lru_cache(KEPT)
def norm_label(s: str) -> str:
    return label(norm(s))


@lru_cache(KEPT)
def norm_core(s: str) -> str:
    return core(norm(s))


@lru_cache(KEPT)
def core(s: str) -> str:
    return _edges.sub("", s)


@lru_cache(KEPT)
def strip_marks(s: str, marks: str = r" :\-,") -> str:
    return _marks[marks].sub("", s)


def cents(s: str | None) -> int | None:
    """Hundredths of ``normalize.money``."""
    if s is None:
        return None
    if len(s) < 16 and s.isascii():
        if s.isdigit():
            return int(s) * 100
        if s[-3:-2] in (",", ".") and s[:-3].isdigit() and s[-2:].isdigit():
            return int(s[:-3] + s[-2:])
    return _cents(s)


@lru_cache(KEPT)
def _cents(s: str) -> int | None:
    s = trimmed(s).replace(" ", "")
    comma, dot = s.rfind(","), s.rfind(".")
    if comma > dot:
        s = s.replace(".", "").replace(",", ".")
    elif comma >= 0:
        s = s.replace(",", "")
    if not _number.match(s):
        return None
    n = int(Decimal(s).scaleb(2).to_integral_value(ROUND_HALF_UP)) if len(s) < 28 else _long(s)
    return n if abs(n) < 10**18 else None


def _long(s: str) -> int:
    from decimal import Context

    return int(Decimal(s).scaleb(2, Context(prec=len(s) + 5)).to_integral_value(ROUND_HALF_UP))


@lru_cache(KEPT)
def name_score(s: str, bad: frozenset[str]) -> float:
    """As ``parties.name_score``; ``bad`` are the words that no name contains."""
    t = trimmed(s)
    low = text(t)
    if low is None:
        return -1e9
    parts = low.split(" ")
    if not bad.isdisjoint(parts):
        return -50.0
    letters, digits = sum(map(str.isalpha, t)), sum(map(str.isdecimal, t))
    return min(letters, 40) * 1.5 - digits * 3.0 - len(_points.findall(t)) * 1.5 + min(len(parts), 6) * 1.2 - abs(len(t) - 22) * 0.12


_iso = re.compile(rf"([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:[T ][^\n\r\x85\u2028\u2029]*)?{END}")
_parts = re.compile(rf"([0-9]{{1,2}})[/.\-]([0-9]{{1,2}})[/.\-]([0-9]{{4}}|[0-9]{{2}}){END}")
_signs = str.maketrans("", "", "$€£¥₹")
_not_amount, _not_number = re.compile(r"[^0-9.,\-]"), re.compile(r"[^A-Za-z0-9\-]")


@lru_cache(KEPT)
def iso_date(s: str | None) -> str | None:
    """As ``normalize.iso_date``."""
    if s is None:
        return None
    s = trimmed(s)
    found = _iso.match(s)
    if found:
        y, m, d = map(int, found[1].split("-"))
    else:
        found = _parts.match(s)
        if not found:
            return None
        one, two, year = found.groups()
        y = int(year if len(year) == 4 else ("20" if year < "69" else "19") + year)
        m, d = (int(one), int(two)) if int(one) <= 12 else (int(two), int(one))
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not 1 <= m <= 12 or not 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    return f"{y:04d}-{m:02d}-{d:02d}"


def cents_text(n: int | None) -> str | None:
    return None if n is None else f"{'-' if n < 0 else ''}{abs(n) // 100}.{abs(n) % 100:02d}"


@lru_cache(KEPT)
def token_value(field: str, s: str | None) -> str | None:
    """As ``normalize.token_value``."""
    if s is None:
        return None if field in ("tax", "net_worth", "total_amount", "invoice_date", "invoice_number") else ""
    s = trimmed(s)
    if field in ("tax", "net_worth", "total_amount"):
        bare = s.translate(_signs)
        known = cents_text(cents(bare))
        return _not_amount.sub("", bare) if known is None else known
    if field == "invoice_date":
        day = iso_date(s)
        return s.lower() if day is None else day
    return _not_number.sub("", s).lower() if field == "invoice_number" else norm(s)


@lru_cache(KEPT)
def value_tokens(field: str, s: str | None) -> tuple[str, ...]:
    """As ``normalize.value_tokens``."""
    if s is None:
        return ()
    if field in ("tax", "net_worth", "total_amount"):
        one = cents_text(cents(s))
    elif field == "invoice_date":
        one = iso_date(s)
    elif field == "invoice_number":
        one = _not_number.sub("", s).lower() or None
    else:
        low = text(s)
        return () if low is None else tuple(low.split(" "))
    return () if one is None else (one,)
