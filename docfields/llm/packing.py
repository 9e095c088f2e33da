"""Packing tokenized documents into fixed-length sequences by cutting-stock column generation.

1. Every text is tokenized whole (byte-level BPE), the end id is added, and the document
   is cut into full pieces of ``capacity`` ids and one rest.  One map pass, no shuffle.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) goes
   to the driver.  A linear program over filling patterns is solved there by column
   generation: a revised simplex keeps the patterns in use, an unbounded-knapsack dynamic
   program prices new ones.
3. Rounded-down pattern counts, plus a best-fit filling of what rounding left over, give a
   table of slots: for each length, runs of ranks with the sequence and offset they land in.
4. Pieces are ranked within their length (two-level ranks, no hot group in one task) and
   joined to the run table by length and rank.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_process, two_level_rank

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level BPE vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the vocabulary file at ``path``, as the ``tokenizers`` library gives them.

    Texts of Latin script go through ``tiktoken``, loaded with the same vocabulary and split
    pattern (several times faster, same ids; the tests hold both against each other).  Any text
    with other scripts, with a special token's string or with a white-space run of ``BLANK``
    characters (``tiktoken`` panics on very long ones) goes through ``tokenizers`` itself.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    BLANK = 100_000

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        back = byte_alphabet()
        ranks = {
            bytes(back[c] for c in word): i for word, i in self.full.get_vocab(with_added_tokens=False).items() if word not in special
        }
        self.fast = tiktoken.Encoding("same-vocabulary", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\\x00-ɏ‐-‧€]" + "".join("|" + re.escape(s) for s in special))
        self.blank = re.compile("\\s{1000,}")

    def long_blank(self, text: str) -> bool:
        return len(text) >= self.BLANK and any(m.end() - m.start() >= self.BLANK for m in self.blank.finditer(text))

    def __call__(self, text: str) -> np.ndarray:
        if not self.other.search(text) and not self.long_blank(text):
            try:
                return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # pyo3's PanicException is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Where the pieces of ``n`` ids begin, and ``n``."""
    whole = n // capacity * capacity
    return sorted({*range(0, whole, capacity), whole, n // grain * grain, n})


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, grain: int = 64) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut into pieces of at most ``capacity`` ids.

    Heads of few lengths pack without gaps and short tails fill what is left, so little is
    padded even where there are few documents.
    """

    def cut(batches):
        import pyarrow as pa

        encode = per_process("encoder", lambda: Encoder(vocabulary), vocabulary)
        kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            keys = batch.column(0).to_pylist()
            for k, value in zip(keys, batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                places = cuts(len(ids), capacity, grain)
                for start, end in zip(places, places[1:]):
                    part = ids[start:end]
                    for out, x in zip(rows, (k, start, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


# ---------------------------------------------------------------- plan on the driver


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for the given values: unbounded knapsack by dynamic programming over capacities."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = value[:k] + best[c - lengths[:k]]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], take[c] = gain[j], j
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= lengths[take[c]]
    return float(best[capacity]), pattern


def generate_columns(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 4000):
    """Patterns (columns) and fractional counts of the linear cutting-stock program, nearly optimal.

    Stops when no pattern prices in, when the bound of the duals is within ``gap``, or after ``rounds``.
    """
    m = len(lengths)
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    x = need / np.diag(columns)
    volume = float((lengths * need).sum()) / capacity
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth, pattern = price(duals, lengths, capacity)
        total = x.sum()
        if worth <= 1 + 1e-7 or total <= max(volume, total / worth) * (1 + gap):
            break
        step = inverse @ pattern
        rising = step > 1e-9
        ratio = np.where(rising, x / np.where(rising, step, 1.0), np.inf)
        out = int(ratio.argmin())
        t = max(ratio[out], 0.0)
        x = np.maximum(x - t * step, 0.0)
        x[out] = t
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return columns, x


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: times}) patterns that use every piece of ``histogram`` exactly once."""
    out = []
    if whole := histogram.get(capacity, 0):
        out.append((whole, {capacity: 1}))
    left = {n: c for n, c in histogram.items() if n < capacity and c > 0}
    if not left:
        return out
    lengths = np.array(sorted(left))
    need = np.array([left[n] for n in lengths], dtype=float)
    columns, x = generate_columns(lengths, need, capacity)
    for j in np.flatnonzero(x >= 1):
        uses = {int(lengths[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}
        copies = min(int(x[j] + 1e-9), *(left[n] // k for n, k in uses.items()))
        if copies:
            out.append((copies, uses))
            for n, k in uses.items():
                left[n] -= copies * k
    while left := {n: c for n, c in left.items() if c}:  # longest first, each time the longest that fits
        room, uses = capacity, {}
        for n in sorted(left, reverse=True):
            if k := min(left[n], room // n):
                uses[n] = k
                room -= k * n
        copies = min(left[n] // k for n, k in uses.items())
        out.append((copies, uses))
        for n, k in uses.items():
            left[n] -= copies * k
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, times per sequence, first offset)."""
    rows, used, sequence = [], {}, 0
    for copies, uses in patterns:
        at = 0
        for n, k in sorted(uses.items(), reverse=True):
            first = used.get(n, 0)
            rows.append((n, first, first + copies * k - 1, sequence, k, at))
            used[n] = first + copies * k
            at += n * k
        sequence += copies
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, grain: int = 64) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Cases: a null or empty text is the end id alone; repeated rows are packed as often as
    they occur; a null doc_id stays null; other columns of ``docs`` are ignored; an empty
    table gives no rows; ties in length are ranked by hash bucket, doc_id and start.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity, end_id, grain), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(
        slots(plan(histogram, capacity)) or [(0, 0, -1, 0, 1, 0)],
        "length long, first long, last long, sequence long, times long, at long",
    )
    ranked = two_level_rank(cut, "length", sum(histogram.values()), ["doc_id", "start"])
    inside = F.col("rank") - F.col("first")
    # the run table has at most a few rows for each of `capacity` lengths, whatever the input
    return (
        ranked.join(F.broadcast(runs), "length")
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("sequence") + F.floor(inside / F.col("times"))).alias("sequence_id"),
            (F.col("at") + (inside % F.col("times")) * F.col("length")).alias("offset"),
        )
    )
