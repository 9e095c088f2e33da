"""Secret scan: Boolean trigram queries derived from the rules, answered by a trigram inverted index.

Every Arrow batch is cut into segments of whole documents; a segment gets its own inverted
index (trigram -> posting list of rows), the way log-structured search indexes keep one index
per segment.  For each rule the query derived from its pattern intersects and unites posting
lists; only the rows that remain are matched with the pattern.  A pattern without mandatory
trigrams is matched against every row.  There is no shuffle and no state between tasks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group``; matches that fail are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules, as the contract states them, then further public token formats.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,30}://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=-]{4,}@[A-Za-z0-9.-]+"),
)

# ------------------------------------------------------------ queries from patterns

ALL = ("all",)
MOST_STRINGS = 256


def both(kind: str, parts: list) -> tuple:
    """``and``/``or`` of queries, with the trivial ones folded away."""
    if kind == "and":
        parts = [p for p in parts if p != ALL]
        if not parts:
            return ALL
    elif ALL in parts:
        return ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (kind, *parts)


def of_strings(strings: frozenset[str]) -> tuple:
    """Some string of the set occurs: an ``or`` over the ``and`` of each string's trigrams."""
    return both("or", [both("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) > 2 else ALL for s in sorted(strings)])


def chars(items) -> frozenset[str] | None:
    found = set()
    for op, arg in items:
        if op == sre.LITERAL:
            found.add(chr(arg).lower())
        elif op == sre.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def derive(tree) -> tuple[frozenset[str] | None, tuple]:
    """(all strings the pattern can match, if few; what must hold of a text that it matches).

    Everything is lower case: the index is over lower-cased text, so a query may let too much
    through but never too little.
    """
    whole, run, query = True, frozenset([""]), []
    for op, arg in tree:
        few, need = None, ALL
        if op == sre.LITERAL:
            few = frozenset([chr(arg).lower()])
        elif op == sre.IN:
            few = chars(arg)
        elif op == sre.SUBPATTERN:
            few, need = derive(arg[-1])
        elif op == sre.BRANCH:
            ways = [derive(w) for w in arg[1]]
            if all(f is not None for f, _ in ways):
                few = frozenset().union(*[f for f, _ in ways])
            need = both("or", [both("and", [n, of_strings(f)]) if f is not None else n for f, n in ways])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            one, inner = derive(body)
            if one is not None and high != sre.MAXREPEAT and high <= 2:
                few = frozenset([""]) if low == 0 else frozenset()
                for k in range(max(low, 1), high + 1):
                    some = frozenset([""])
                    for _ in range(k):
                        some = frozenset(a + b for a in some for b in one)
                    few |= some
            need = inner if low else ALL
        if few is not None and len(run) * len(few) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in few)
        else:
            whole = False
            query += [of_strings(run), need]
            run = few if few is not None and len(few) <= MOST_STRINGS else frozenset([""])
    if whole:
        return run, of_strings(run)
    return None, both("and", [*query, of_strings(run)])


def query_of(rule: Rule) -> tuple:
    return derive(parser.parse(rule.pattern))[1]


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*[trigrams_of(q) for q in query[1:]]) if query[0] in ("and", "or") else set()


# ------------------------------------------------------------------- the index


class SegmentIndex:
    """Posting lists of a segment's rows for the trigrams that the queries name."""

    def __init__(self, lookup: np.ndarray, n_trigrams: int, data: np.ndarray, starts: np.ndarray, fold: np.ndarray):
        low = fold[data]
        self.rows = np.arange(len(starts))
        self.postings = [self.rows[:0]] * n_trigrams
        if len(low) > 2:
            # two bytes first: the table of pairs is small and stays in cache
            pair = (low[:-1].astype(np.uint16) << 8) | low[1:]
            at = np.flatnonzero(lookup[0][pair[:-1]])
            which = lookup[1][(pair[at].astype(np.uint32) << 8) | low[at + 2]]
            at, which = at[which > 0], which[which > 0]
            row = np.searchsorted(starts, at, side="right") - 1
            for t in np.unique(which):
                self.postings[t - 1] = np.unique(row[which == t])

    def answer(self, query: tuple, ids: dict[str, int]) -> np.ndarray:
        if query == ALL:
            return self.rows
        if query[0] == "tri":
            return self.postings[ids[query[1]]]
        lists = [self.answer(q, ids) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "matches array<struct<kind: string, start: int, end: int, text: string>>"
)


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, segment_bytes: int = 1 << 22) -> DataFrame:
    """One row per document: counts of the base kinds, digest of base spans, all spans, and the matches themselves.

    Positions are code points, ends exclusive.  Cases: a null or empty text has no spans (the
    digest is that of the empty string); a null doc_id stays null; repeated rows are scanned as
    often as they occur; other columns are ignored; an empty table gives no rows.
    """
    rules = (*base, *more)
    counted = [r.kind for r in base]

    def run(batches):
        import pyarrow as pa

        tests = [(i, r, r.compiled(), query_of(r)) for i, r in enumerate(rules)]
        ids = {t: i for i, t in enumerate(sorted(set().union(*[trigrams_of(q) for *_, q in tests])))}
        pairs, triples = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 24, dtype=np.uint16)
        for t, i in ids.items():
            a, b, c = t.encode()
            pairs[a << 8 | b] = True
            triples[a << 16 | b << 8 | c] = i + 1
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        match = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(match)]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "matches"]
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            size = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            out: list[list] = [[] for _ in names]
            out[0] = batch.column(0).to_pylist()
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(size, size[first] + segment_bytes, side="right")) - 1)
                raw = column.buffers()[2]
                data = np.frombuffer(raw, dtype=np.uint8)[size[first] : size[last]] if raw is not None else np.zeros(0, np.uint8)
                index = SegmentIndex((pairs, triples), len(ids), data, size[first:last] - size[first], fold)
                texts = [x or "" for x in column.slice(first, last - first).to_pylist()]
                found: list[list] = [[] for _ in texts]
                for i, rule, pattern, query in tests:
                    for row in index.answer(query, ids):
                        for m in pattern.finditer(texts[row]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[row].append((m.start(), i, m.end()))
                for text, spans in zip(texts, found):
                    spans.sort()
                    names_of = [f"{rules[i].kind}:{a}:{b}" for a, i, b in spans]
                    own = [s for s, (_, i, _) in zip(names_of, spans) if i < len(base)]
                    for k, kind in enumerate(("assign", "access", "hex")):
                        out[1 + k].append(sum(rules[i].kind == kind for _, i, _ in spans) if kind in counted else 0)
                    out[4].append(hashlib.sha256(",".join(own).encode()).hexdigest())
                    out[5].append(",".join(names_of))
                    out[6].append([{"kind": rules[i].kind, "start": a, "end": b, "text": text[a:b]} for a, i, b in spans])
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("matches")
