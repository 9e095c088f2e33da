"""Word rows to lines, regions, zones and fields.

A word row is (key, word_idx, text, x, y, w, h, conf); ``word_idx`` is the reading order of the
source and breaks every tie.  All operators group by ``key`` only, so one shuffle serves a chain.
Where it says so, an operator also takes pages: (key, ws) with a page's words as one array, which need neither shuffle nor sort.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import normalize as N
from ..functions import words as S


def of_page() -> WindowSpec:
    return W.partitionBy("key")


def paged(words: DataFrame) -> DataFrame:
    """(key, ws): a page's words in order as one array; pages stay as they are."""
    if isinstance(words, Unread) or "ws" in words.columns:
        return words
    columns = ["word_idx", *[c for c in words.columns if c not in ("key", "word_idx")]]
    return words.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("ws"))


def fields_of(pages: DataFrame) -> list[str]:
    return pages.schema["ws"].dataType.elementType.names


def unpaged(pages: DataFrame) -> DataFrame:
    """The word rows of pages (the outer form: ``inline`` would compute the array a second time, to see whether it is empty)."""
    return pages.select("key", F.inline_outer("ws")).where("word_idx is not null")


class Unread(NamedTuple):
    """Pages that :func:`by_page` has built while it reads them, in place of (key, ws)."""

    rows: DataFrame  # what they are built from, with ``key``; a page's rows lie together in one partition
    lists: Callable  # fields -> (Arrow batches of ``rows`` -> lists of pages (key, a list for each field))


def by_page(words: DataFrame | Unread, kind: str, of_page, *fields: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, ...): the rows, as tuples of the DDL ``kind``, that ``of_page`` gives for each page.

    ``of_page(key, field, ..., beside, ...)`` takes the page's words as one list for each of ``fields``, then the columns ``beside``.
    For what depends on runs of words, which expressions over arrays would work out anew for every word.
    """
    unread = isinstance(words, Unread)
    pages = words.rows if unread else paged(words)
    out = T.StructType([T.StructField("key", pages.schema["key"].dataType), *T.StructType.fromDDL(kind).fields])

    def read(batches):
        for batch in batches:
            ws = batch.column(1)
            flat, sizes = ws.flatten(), ws.value_lengths().fill_null(0).to_pylist()
            columns, lo, page_list = [flat.field(at[f]).to_pylist() for f in fields], 0, []
            for key, n, *more in zip(batch.column(0).to_pylist(), sizes, *[c.to_pylist() for c in batch.columns[2:]]):
                page_list.append((key, *[c[lo : lo + n] for c in columns], *more))
                lo += n
            yield page_list

    if unread:
        read = words.lists((*fields, *beside))
    else:
        at = {c: k for k, c in enumerate(fields_of(pages))}
        pages = pages.select("key", "ws", *beside)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for page_list in read(batches):
            rows = [(page[0], *r) for page in page_list for r in of_page(*page)]
            cells = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return pages.mapInArrow(run, out)


def confident(words: DataFrame, least: float = 30) -> DataFrame:
    """Words with text whose confidence is above ``least``; a confidence that is no number counts as -1."""
    return words.where((N.trimmed("text") != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) > least))


def distinct_places(words: DataFrame) -> DataFrame:
    """(key, n): how many words :func:`deduped` leaves on each page.  Takes pages too."""

    def of_page(_, *place):
        return [(len(set(zip(*place))),)]

    return by_page(words, "n long", of_page, "x", "y", "text")


def deduped(words: DataFrame) -> DataFrame:
    """The first word of each (x, y, text); of pages, pages."""
    if "ws" in words.columns:
        place = ("x", "y", "text")
        names = [*place, "word_idx", *[c for c in fields_of(words) if c not in (*place, "word_idx")]]
        by_place = F.sort_array(F.transform("ws", lambda w: F.struct(*[w[c].alias(c) for c in names])))
        new = lambda ws: F.filter(ws, lambda w, i: (i == 0) | ~F.struct(*[w[c] for c in place]).eqNullSafe(F.struct(*[F.get(ws, i - 1)[c] for c in place])))
        return words.withColumn("ws", N.let(by_place, new))
    rank = F.row_number().over(W.partitionBy("key", "x", "y", "text").orderBy("word_idx"))
    return words.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lined_pages(words: DataFrame) -> DataFrame:
    """(key, ws): pages of words (or of pages) in (y, x) order, with line_id and line_y as in :func:`lines_greedy`.

    The fold depends on every word before, which no window frame expresses, so a page is folded as one sorted array
    inside the JVM.  It keeps the lines' first y only: in that order a word is on the last line that does not begin below it.
    """
    pages = paged(words)
    names = ["y", "x", "word_idx", *[c for c in fields_of(pages) if c not in ("y", "x", "word_idx")]]
    heights = F.sort_array(F.filter(F.transform("ws", lambda w: w["h"]), lambda h: h.isNotNull()))
    pages = pages.select("key", F.sort_array(F.transform("ws", lambda w: F.struct(*[w[c].alias(c) for c in names]))).alias("ws"), heights.alias("hs"))
    middle = "(get(hs, cast((size(hs) - 1) / 2 as int)) + get(hs, cast(size(hs) / 2 as int))) / 2"
    fold = f"""
    aggregate(ws, named_struct('y', cast(null as int), 'ys', cast(array() as array<int>), 'most', greatest(8, cast({middle} * 0.7 as int))),
      (a, w) -> if(a.y is null or abs(w.y - a.y) > a.most, named_struct('y', w.y, 'ys', array_append(a.ys, w.y), 'most', a.most), a), a -> a.ys)
    """
    pages = pages.withColumn("ys", F.expr(fold))
    line = F.expr("transform(ws, (w, i) -> if(w.y is null, i, size(filter(ys, y -> y is null or y <= w.y)) - 1))")
    pages = pages.withColumn("lines", line)
    at = lambda i: F.get("lines", i)
    placed = F.transform("ws", lambda w, i: F.struct(*[w[c].alias(c) for c in names], at(i).alias("line_id"), F.get("ys", at(i)).alias("line_y")))
    return pages.select("key", placed.alias("ws"))


def page_lines(ys, xs, ids, hs) -> list[int]:
    """The line_id of every word of a page as :func:`lined_pages` gives it, in the order of the words given."""
    from bisect import bisect_right

    known = sorted(h for h in hs if h is not None)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
    most, first = 8 if middle is None else max(8, int(middle * 0.7)), None
    if None not in ys:  # then a word's line depends on its y alone
        of, opened = {}, -1
        for y in sorted(set(ys)):
            if opened < 0 or abs(y - first) > most:
                first, opened = y, opened + 1
            of[y] = opened
        return [of[y] for y in ys]
    order = sorted(range(len(ys)), key=lambda i: [(v is not None, v) for v in (ys[i], xs[i], ids[i])])
    lines, nulls, opened = [0] * len(ys), 0, []
    for at, i in enumerate(order):
        y = ys[i]
        if y is None:  # these come first, a line each
            lines[i], nulls = at, nulls + 1
            continue
        if first is None or abs(y - first) > most:
            first = y
            opened.append(y)
        lines[i] = nulls + bisect_right(opened, y) - 1
    return lines


def lines_of(pages: DataFrame | Unread) -> tuple[str, ...]:
    """The fields that a page's lines come from."""
    return ("line_id",) if not isinstance(pages, Unread) and "line_id" in fields_of(pages) else ("y", "h")


def lines_from(texts, xs, ids, more) -> list[int]:
    return more[0] if len(more) == 1 else page_lines(more[0], xs, ids, more[1])


def lines_greedy(words: DataFrame) -> DataFrame:
    """Adds line_id and line_y: in (y, x) order a word opens a line when it is further than the tolerance
    from the y of the line's first word; the tolerance is max(8, 0.7 of the page's median height).  Takes pages too.
    """
    return unpaged(lined_pages(words))


def lines_running_mean(words: DataFrame) -> DataFrame:
    """Adds line_id by nearest line centre: a word joins the closest line within max(8, 0.8 of the median
    height) of its running mean centre, else opens one; lines are numbered by their highest word.

    The centres change with every word, so Python does this, on batches of whole pages.  Takes pages too.
    """
    pages = paged(words)
    kind = pages.schema["ws"].dataType.elementType
    at = {c: k for k, c in enumerate(kind.names)}
    out = T.StructType([pages.schema["key"], *kind.fields, T.StructField("line_id", T.IntegerType())])

    def assign(y, h, x, idx):
        import statistics
        from bisect import bisect_left, insort

        centre = [a + b / 2.0 for a, b in zip(y, h)]
        reach = max(8, int(int(statistics.median(max(b, 1) for b in h)) * 0.8))
        means, refs = [], []  # sorted (mean centre, number of the line); its members
        for i in sorted(range(len(y)), key=lambda i: (centre[i], x[i], idx[i])):
            c = centre[i]
            k = bisect_left(means, (c, -1))
            near = []
            if k < len(means):
                near.append((abs(c - means[k][0]), means[k][1], k))
            if k:
                low = bisect_left(means, (means[k - 1][0], -1))  # the first of equal means
                near.append((abs(c - means[low][0]), means[low][1], low))
            best = min(near, default=None)
            if best and best[0] <= reach:
                mean, n = means.pop(best[2])
                refs[n].append(i)
                insort(means, (mean + (c - mean) / len(refs[n]), n))
            else:
                insort(means, (c, len(refs)))
                refs.append([i])
        refs.sort(key=lambda own: min(centre[i] for i in own))
        line = [0] * len(y)
        for k, own in enumerate(refs):
            for i in own:
                line[i] = k
        return line

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, ws = batch.column(0), batch.column(1)
            flat, size = ws.flatten(), ws.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            y, h, x, idx = (flat.field(at[c]).to_pylist() for c in ("y", "h", "x", "word_idx"))
            lines, lo = [], 0
            for n in size.tolist():
                lines += assign(y[lo : lo + n], h[lo : lo + n], x[lo : lo + n], idx[lo : lo + n])
                lo += n
            key = keys.take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([key, *flat.flatten(), pa.array(lines, pa.int32())], names=out.names)

    return pages.select("key", "ws").mapInArrow(run, out)


def line_texts(lined: DataFrame) -> DataFrame:
    """(key, line_id, line_y, text, n_words): words of a line by x, joined by spaces."""
    ordered = F.sort_array(F.collect_list(F.struct("x", "word_idx", "text")))
    return lined.groupBy("key", "line_id").agg(
        F.min("line_y").alias("line_y"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words")
    )


def block_text(lined: DataFrame) -> DataFrame:
    """(key, block): the lines of each page joined by line ends."""
    lines = line_texts(lined)
    return lines.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), "\n").alias("block"))


def anchor_y(pattern: str) -> Column:
    """Smallest y of a page's words that match ``pattern`` as a whole, ignoring case."""
    return F.min(F.when(N.trimmed("text").rlike(f"(?i)^(?:{pattern})$"), F.col("y"))).over(of_page())


# Shares of the page's height at which regions begin and end.
TOP, TABLE_FROM, TABLE_TO, TABLE_LEAST, TABLE_MOST, ABOVE_ITEMS, ABOVE_SUMMARY, LOWER_BAND = 0.16, 0.30, 0.85, 0.20, 0.95, 0.03, 0.02, 0.82


def regions(words: DataFrame, width: int, height: int) -> DataFrame:
    """Adds region: top_left, table, bottom, seller or client, from the items and summary anchors."""
    px = lambda share: int(share * height)
    items, summary = anchor_y("items?"), anchor_y("summary")
    start = F.when(items.isNull(), px(TABLE_FROM)).otherwise(F.greatest(F.lit(px(TABLE_LEAST)), items - px(ABOVE_ITEMS)))
    end = F.when(summary.isNull(), px(TABLE_TO)).otherwise(F.least(F.lit(px(TABLE_MOST)), summary - px(ABOVE_SUMMARY)))
    found = words.withColumn("_start", start).withColumn("_end", end)
    region = (
        F.when(F.col("y") < px(TOP), "top_left")
        .when(F.col("y").between(F.col("_start"), F.col("_end")), "table")
        .when(F.col("y") > F.col("_end"), "bottom")
        .when(F.col("x") / F.lit(width) < 0.5, "seller")
        .otherwise("client")
    )
    return found.withColumn("region", region).drop("_start", "_end")


@lru_cache(S.KEPT)
def region_mark(s: str) -> str | None:
    """The anchor of regions that a word is."""
    s = S.trimmed(s)
    return "items" if _items.fullmatch(s) else "summary" if _summary.fullmatch(s) else None


_items, _summary = (re.compile(p, re.I | re.A) for p in ("items?", "summary"))


def page_regions(texts, xs, ys, width: int, height: int) -> list[str]:
    """The region of every word of a page as :func:`regions` gives it."""
    px = lambda share: int(share * height)
    lowest = {}
    for t, y in zip(texts, ys):
        if y is not None and t is not None and t[:1] not in S.DIGITS and (mark := region_mark(t)) and y < lowest.get(mark, y + 1):
            lowest[mark] = y
    items, summary = lowest.get("items"), lowest.get("summary")
    start = px(TABLE_FROM) if items is None else max(px(TABLE_LEAST), items - px(ABOVE_ITEMS))
    end = px(TABLE_TO) if summary is None else min(px(TABLE_MOST), summary - px(ABOVE_SUMMARY))
    top, out = px(TOP), []
    for x, y in zip(xs, ys):
        if y is not None and (y < top or y >= start):
            out.append("top_left" if y < top else "table" if y <= end else "bottom")
        elif y is not None and y > end:
            out.append("bottom")
        else:
            out.append("seller" if x is not None and x / width < 0.5 else "client")
    return out


def bottom_words(words: DataFrame, width: int, height: int) -> DataFrame:
    """Words of the bottom region and of the page's lower band, each once."""
    found = regions(words, width, height)
    return deduped(found.where((F.col("region") == "bottom") | (F.col("y") >= int(LOWER_BAND * height)))).drop("region")


def zone_texts(words: DataFrame, zones: DataFrame, width: int, height: int) -> DataFrame:
    """(key, field, text): words whose centre lies in each zone of the template, in reading order.

    ``zones(field, zx, zy, zw, zh)`` are fractions of the page: a lookup of a few rows.
    """
    cx, cy = (F.col("x") + F.col("w") / 2) / width, (F.col("y") + F.col("h") / 2) / height
    hit = words.join(F.broadcast(zones), cx.between(F.col("zx"), F.col("zx") + F.col("zw")) & cy.between(F.col("zy"), F.col("zy") + F.col("zh")))
    ordered = F.sort_array(F.collect_list(F.struct("word_idx", "text")))
    return hit.groupBy("key", "field").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("key").agg(F.count(F.lit(1)).alias("total_words"), F.round(F.sum("conf") / F.count(F.lit(1)), 6).alias("avg_confidence"))


def boxes(words: DataFrame, width: int, height: int) -> DataFrame:
    box = N.box_1000(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    return words.withColumn("box", box).select("key", "word_idx", "text", "box")


def label_word(words: DataFrame, pattern: str) -> DataFrame:
    """(key, word): the first word, in source order, in which ``pattern`` is found."""
    hits = words.where(F.col("text").rlike(f"(?i){pattern}"))
    return hits.groupBy("key").agg(F.min_by(F.struct("word_idx", "text", "x", "y"), "word_idx").alias("word"))
