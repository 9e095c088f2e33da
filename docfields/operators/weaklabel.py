"""Weak token labels: spans from known values, BIO tags, votes, money candidates."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import normalize as N
from ..functions import words as S
from ..functions.similarity import indel_ratio
from . import layout

REJECT = ("tax", "id", "iban", "vat", "invoice", "date")
LINE_ANCHORS = ("summary", "vat", "tax", "net", "gross", "total", "amount")


def in_order() -> WindowSpec:
    return W.partitionBy("key").orderBy("word_idx")


def spans_of_labels(labels: DataFrame) -> DataFrame:
    """(key, field, text, start, end) runs of ``label`` (B-X I-X ...) over (key, word_idx, text, label); an I that continues nothing is dropped."""
    label = F.coalesce(F.col("label"), F.lit("O"))
    field = F.lower(F.substring(label, 3, 1000))
    rows = labels.withColumn("_l", label).withColumn("_f", field)
    begins = F.col("_l").startswith("B-")
    inside = F.col("_l").startswith("I-")
    before, before_field = F.lag("_l").over(in_order()), F.lag("_f").over(in_order())
    # an island ends at every word that is no I of the field before it
    breaks = F.when(inside & before.isNotNull() & (before != "O") & (before_field == F.col("_f")), 0).otherwise(1)
    rows = rows.withColumn("_island", F.sum(breaks).over(in_order())).where(begins | inside)
    found = rows.groupBy("key", "_island").agg(
        F.min_by("_l", "word_idx").alias("_first"), F.first("_f").alias("field"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min("word_idx").alias("start"), (F.max("word_idx") + 1).alias("end"),
    )
    return found.where(F.col("_first").startswith("B-")).select("key", "field", "text", "start", "end")


def page_spans(texts, ids, labels) -> list[tuple]:
    """(field, text, start, end) of a page's labels; see :func:`spans_of_labels`."""
    rows, out, run, last = list(zip(ids, texts, labels)), [], None, -2
    if not isinstance(ids, range):
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
    for k, (i, t, label) in enumerate(rows):
        if label is None or label == "O":
            continue
        field, before = label[2:].lower(), rows[k - 1][2] if last == k - 1 else "O"
        last = k
        if not (label.startswith("I-") and before != "O" and before[2:].lower() == field):
            run = None
            if label.startswith("B-"):
                run = [field, [], i, i]
                out.append(run)
        if run is not None:
            run[1].append(t)
            run[3] = i
    return [(field, " ".join(t for t in ts if t is not None), start, last + 1) for field, ts, start, last in out]


def labels_of_spans(words: DataFrame, spans: DataFrame, priority: list[str]) -> DataFrame:
    """Adds label: B- and I- tags of (key, field, start, end) spans; of overlapping spans the field first in ``priority`` wins whole."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("field"))
    ordered = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "start", "end", "field"))).alias("ss"))
    fold = """aggregate(ss, cast(array() as array<struct<r: bigint, start: bigint, end: bigint, field: string>>),
      (kept, s) -> if(s.start < s.end and not exists(kept, k -> k.start < s.end and s.start < k.end),
        array_append(kept, named_struct('r', cast(s.r as bigint), 'start', cast(s.start as bigint), 'end', cast(s.end as bigint), 'field', s.field)), kept))"""
    kept = ordered.withColumn("ss", F.expr(fold))
    rows = words.join(kept, "key", "left")
    own = F.get(F.filter("ss", lambda s: (s["start"] <= F.col("word_idx")) & (F.col("word_idx") < s["end"])), F.lit(0))
    label = F.when(own.isNull(), "O").otherwise(F.concat(F.when(own["start"] == F.col("word_idx"), "B-").otherwise("I-"), F.upper(own["field"])))
    return rows.withColumn("label", label).drop("ss")


def subsequence(haystack: Column, needle: Column) -> Column:
    """First 0-based place at which ``needle`` stands in ``haystack``; null if nowhere or if either is empty."""

    def search(hay: Column, want: Column) -> Column:
        n, m = F.size(hay), F.size(want)
        places = F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(hay, i + 1, m) == want)
        return F.when((m > 0) & (n >= m), F.get(places, F.lit(0)))

    return N.let(haystack, lambda hay: N.let(needle, lambda want: search(hay, want)))


def value_spans(words: DataFrame, truth: DataFrame, fields: tuple[str, ...] = N.FIELDS) -> DataFrame:
    """(key, field, start, end): where a field's true value stands on its page, word for word."""

    def tokens_as(f: str) -> Column:
        return F.transform("ws", lambda w: N.token_value(f, w["text"])).alias(f"hay_{f}")

    tokens = [tokens_as(f) for f in fields]
    page = words.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text"))).alias("ws")).select("key", "ws", *tokens).join(truth, "key")
    cells = [F.struct(F.lit(f).alias("field"), subsequence(F.col(f"hay_{f}"), N.value_tokens(f, f)).alias("at"), F.size(N.value_tokens(f, f)).alias("n")) for f in fields]
    found = page.select("key", "ws", F.inline(F.array(*cells))).where("at is not null")
    start = F.get("ws", F.col("at"))["word_idx"]
    return found.select("key", "field", start.alias("start"), (start + F.col("n")).alias("end"))


def amount(c: Column) -> Column:
    """Money of a column of whole cents."""
    return (c.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(N.MONEY)


def money_ngrams(words: DataFrame) -> DataFrame:
    """(key, amount, pos): distinct amounts of one, two or three neighbouring words, with the first place.  Takes pages too.

    Only texts of the characters that an amount is made of are parsed.
    """

    def of_page(_, texts, ids):
        ok = [t is not None and numeric(t) for t in texts]
        first = {}
        for i, fits in enumerate(ok):
            gram = texts[i]
            for k in range(i, min(i + 3, len(ok)) if fits else i):
                if not ok[k]:
                    break
                if k > i:
                    gram = f"{gram} {texts[k]}"
                cents = S.cents(gram)
                if cents is not None and (cents not in first or ids[i] < first[cents]):
                    first[cents] = ids[i]
        return first.items()

    found = layout.by_page(words, "cents long, pos long", of_page, "text", "word_idx")
    return found.select("key", amount(F.col("cents")).alias("amount"), "pos")


@lru_cache(S.KEPT)
def numeric(s: str) -> bool:
    """Has the text no other characters than amounts have?"""
    return _numeric.match(s) is not None


_numeric = re.compile(rf"(?:[0-9.,+\-]|{S.SPACE})*\Z")
#: Begins no amount, spaces aside.
NO_AMOUNT = frozenset(map(chr, range(33, 127))).difference("0123456789+-.,")
_lead, _middle, _tail = re.compile(r"[0-9]{1,3}\Z"), re.compile(r"[0-9]{3}\Z"), re.compile(r"[0-9]{3}[,.][0-9]{2}\Z")


LEAD, MIDDLE, TAIL = 1, 2, 4


@lru_cache(S.KEPT)
def amount_word(s: str) -> tuple[int | None, int, str]:
    """(cents, shape, trimmed text) of a word: which parts of a spaced amount it can be."""
    t = S.trimmed(s)
    return S.cents(t), LEAD * bool(_lead.match(t)) + MIDDLE * bool(_middle.match(t)) + TAIL * bool(_tail.match(t)), t


def page_amounts(texts, xs, ids, lines, millions: bool = False) -> dict[tuple, None]:
    """(line, cents, start, end) of a page; see :func:`split_money`."""
    if isinstance(ids, range) and None not in texts and None not in xs and None not in lines:
        ws = sorted(zip(lines, xs, ids, texts))  # places differ, so texts do not count
    else:
        ws = sorted(((line, x, i, None if t is None else S.trimmed(t)) for line, x, i, t in zip(lines, xs, ids, texts)), key=lambda w: [(v is not None, v) for v in w])
    found = {}
    for at, (line, _, i, t) in enumerate(ws):
        if t is None or t[:1] in NO_AMOUNT:
            continue
        cents, shape, own = amount_word(t)
        if cents is not None:
            found[line, cents, i, i + 1] = None
        after = ws[at + 1] if shape & LEAD and at + 1 < len(ws) else None
        if after is None or after[0] != line or after[3] is None or after[3][:1] in NO_AMOUNT:
            continue
        for n in (2, 3) if millions else (2,):
            part = ws[at : at + n]
            if len(part) < n or part[-1][0] != line or any(p[3] is None or p[3][:1] in NO_AMOUNT for p in part):
                continue
            rest = [amount_word(p[3]) for p in part[1:]]
            if rest[-1][1] & TAIL and all(r[1] & MIDDLE for r in rest[:-1]):
                places = [p[2] for p in part]
                found[line, S.cents(own + "".join([r[2] for r in rest])), min(places), max(places) + 1] = None
    return found


def split_money(words: DataFrame, millions: bool = False) -> DataFrame:
    """(key, line_id, value, start, end): amounts of single words, and of ``6`` followed by ``579,11`` on one line; with ``millions`` also of ``1 036 579,11``.

    Takes pages too; words without ``line_id`` get their lines as :func:`layout.lines_greedy` places them.
    """
    pages = layout.paged(words)

    def of_page(_, texts, xs, ids, *more):
        return page_amounts(texts, xs, ids, layout.lines_from(texts, xs, ids, more), millions)

    found = layout.by_page(pages, "line_id int, cents long, start long, end long", of_page, "text", "x", "word_idx", *layout.lines_of(pages))
    return found.select("key", "line_id", amount(F.col("cents")).alias("value"), "start", "end")


def split_money_sums(words: DataFrame) -> DataFrame:
    """(key, n, total, words): how many amounts :func:`split_money` finds on a page that has any, their sum, and how many words they have together."""
    pages = layout.paged(words)

    def of_page(_, texts, xs, ids, *more):
        found = page_amounts(texts, xs, ids, layout.lines_from(texts, xs, ids, more))
        return [(len(found), Decimal(sum([cents for _, cents, *_ in found])), sum([end - start for *_, start, end in found]))] if found else []

    sums = layout.by_page(pages, "n long, cents decimal(28,0), words long", of_page, "text", "x", "word_idx", *layout.lines_of(pages))
    return sums.select("key", "n", (F.col("cents") * F.lit(Decimal("0.01"))).cast("double").alias("total"), "words")


def page_money_line(amounts, texts, lines, truths) -> list[tuple]:
    """(field, start, end) of a page's money line; ``truths`` are (field, cents). See :func:`line_money_spans`."""
    best = {}
    for field, gt in truths:
        most = label_tolerance(gt)
        reach = int(most * 100) + 1
        low, high = gt - reach, gt + reach
        for line, cents, start, end in [a for a in amounts if low <= a[1] <= high]:
            err = abs(cents - gt)
            if err / 100 <= most:
                old = best.get((line, field))
                new = (err, start, end, cents)
                if old is None or new < old:
                    best[line, field] = new
    by_line = {}
    for (line, field), found in best.items():
        by_line.setdefault(line, {})[field] = found
    ranked = []
    for line, found in by_line.items():
        if len(found) < 2:
            continue
        if len(found) == 3:
            tax, net, total = (found[f][3] for f in N.MONEY_FIELDS)
            if abs(tax + net - total) / 100 > label_tolerance(total):
                continue
        hits = len({S.norm(t) for t, at in zip(texts, lines) if at == line}.intersection(LINE_ANCHORS))
        ranked.append((-len(found), -hits, sum(f[0] for f in found.values()), line))
    return [(field, start, end) for field, (_, start, end, _) in by_line[min(ranked)[3]].items()] if ranked else []


def label_tolerance(cents: int) -> float:
    return max(0.05, abs(cents / 100) * 0.01)


def with_truth(words: DataFrame, truth: DataFrame | None, fields: tuple[str, ...]) -> DataFrame:
    """Pages with the list ``truth`` of their true values; without a table ``truth`` the pages hold it already."""
    pages = layout.paged(words)
    if truth is None:  # also of pages that are built while they are read
        return pages
    own = truth.groupBy("key").agg(F.collect_list(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])).alias("truth"))
    return pages.select("key", "ws").join(own, "key")


def line_money_spans(lined: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(key, field, start, end): money fields on the one line that holds most of them.

    For every line the candidate nearest to each true value within the tolerance; lines with two
    or three fields (three must add up) compete by fields, anchor words and summed error.
    Takes pages too, with their ``truth`` if there is no table of it; words without ``line_id`` get their lines as :func:`layout.lines_greedy` places them.
    """
    pages = with_truth(lined, truth, N.MONEY_FIELDS)

    def of_page(_, texts, xs, ids, *more):
        *more, truths = more
        known = [(f, c) for t in truths or () for f in N.MONEY_FIELDS if (c := S.cents(t[f])) is not None]
        lines = layout.lines_from(texts, xs, ids, more)
        return page_money_line(page_amounts(texts, xs, ids, lines, True), texts, lines, known) if known else []

    return layout.by_page(pages, "field string, start long, end long", of_page, "text", "x", "word_idx", *layout.lines_of(pages), beside=("truth",))


def votes(subwords: DataFrame) -> DataFrame:
    """(key, word_idx, label, confidence) from (key, word_idx, sub, label, prob): the label of most summed probability, the first seen of equals."""
    by_label = subwords.groupBy("key", "word_idx", "label").agg(F.sum("prob").alias("weight"), F.min("sub").alias("first"), F.count(F.lit(1)).alias("n"))
    return by_label.groupBy("key", "word_idx").agg(
        F.max_by("label", F.struct("weight", -F.col("first"))).alias("label"),
        F.round((F.sum("weight") / F.sum("n")).cast("double"), 6).alias("confidence"),
    )


def voted_words(words: DataFrame, subwords: DataFrame) -> DataFrame:
    """Every word with its voted label; words without sub-words get O and confidence 0."""
    return words.join(votes(subwords), ["key", "word_idx"], "left").withColumns({"label": F.coalesce("label", F.lit("O")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def span_quality(text: Column, n_words: Column) -> Column:
    """Is a party span short and name-like?"""
    norm = F.split(F.coalesce(N.text(text), F.lit("")), " ")
    bad = F.arrays_overlap(norm, F.array(*[F.lit(b) for b in ("tax", "id", "iban", "invoice", "date", "vat", "total", "amount", "summary")]))
    letters, digits = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return (n_words.between(1, 14)) & ~bad & (letters >= 2) & (digits <= F.greatest(F.lit(4), letters))


# ------------------------------------------------------- windows by similarity


def anchor_ranges(norm: Column, terms: tuple[str, ...], reach: int) -> Column:
    """(first, stop) of the words that follow each word of ``terms`` (colons aside), ``reach`` of them at most."""
    cores = F.transform(norm, lambda w, i: F.struct(F.regexp_replace(w, ":+$", "").alias("w"), (i + 1).alias("first")))
    found = F.filter(cores, lambda c: c["w"].isin(*terms)) if terms else F.slice(cores, 1, 0)
    return F.transform(found, lambda c: F.struct(c["first"].alias("first"), F.least(F.size(norm), c["first"] + reach).alias("stop")))


def similar_spans(rows: DataFrame, slack: int = 2, reject: tuple[str, ...] = REJECT) -> DataFrame:
    """(key, field, start, end, score): the window most similar to the needle, if as similar as ``least``.

    ``rows(key, field, hay, needle, least, ranges, guided)``: word arrays, and the (first, stop) ranges that
    windows lie in.  Windows are up to ``slack`` words shorter or longer than the needle; ``guided`` ones
    hold no word of ``reject``.  A window's length bounds its similarity, so most are never scored.  Of equals comes the one of the earlier range, then the shorter, then the
    earlier one.
    """
    kind = T.StructType([rows.schema["key"], *T.StructType.fromDDL("field string, start long, end long, score double, place array<int>").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            out = []
            for key, field, *row in zip(*[c.to_pylist() for c in batch.columns]):
                found = most_similar(*row, slack, frozenset(reject))
                if found:
                    out.append((key, field, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    found = rows.select("key", "field", "hay", "needle", F.col("least").cast("double"), "ranges", "guided").mapInArrow(run, kind)
    best = found.groupBy("key", "field").agg(F.max_by(F.struct("start", "end", "score"), F.struct("score", "place")).alias("b"))
    return best.select("key", "field", "b.start", "b.end", "b.score")


@lru_cache(S.KEPT)
def ratio(a: str, b: str) -> float:
    return indel_ratio(a, b)


def most_similar(hay, needle, least, ranges, guided, slack: int, reject: frozenset[str]) -> tuple | None:
    """(start, end, score, place) of the window of :func:`similar_spans`; windows are scored while their lengths allow the best score."""
    if not needle or not hay or least is None or ranges is None:
        return None
    target = " ".join(w for w in needle if w is not None).strip(" ")
    size, length = len(needle), len(target)
    plain = all(w and w[0] != " " and w[-1] != " " for w in hay)
    ends = [0, *accumulate(len(w) + 1 for w in hay)] if plain else None
    bad = list(accumulate((w is None or w in reject for w in hay), initial=0)) if guided else None
    windows = []
    for number, r in enumerate(ranges):
        first, stop = r["first"], r["stop"]
        for n in range(max(1, size - slack), min(size + slack, stop - first) + 1):
            for s in range(first, stop - n + 1):
                if guided and bad[s + n] != bad[s]:
                    continue
                long = ends[s + n] - ends[s] - 1 if plain else len(" ".join(w for w in hay[s : s + n] if w is not None).strip(" "))
                if long:
                    bound = 2.0 * min(long, length) / (long + length)
                    if bound >= least:
                        windows.append((bound, -number, -n, -s))
    windows.sort(reverse=True)
    best = None
    for bound, *place in windows:
        if best and bound < best[0]:
            break
        n, s = -place[1], -place[2]
        score = ratio(target, " ".join(w for w in hay[s : s + n] if w is not None).strip(" "))
        if score >= least and (best is None or (score, place) > best):
            best = (score, place)
    if best is None:
        return None
    score, place = best
    return -place[2], -place[2] - place[1], score, place


#: Per field: anchor words, least similarity after them, words looked at after an anchor, longest span.
GUIDED = {
    "invoice_number": ((), 1.0, 0, None),
    "invoice_date": ((), 1.0, 0, None),
    "seller_name": (("seller",), 0.70, 28, 14),
    "client_name": (("client",), 0.70, 28, 14),
    "tax": (("vat", "tax"), 0.68, 36, None),
    "net_worth": (("net", "networth", "subtotal"), 0.68, 36, None),
    "total_amount": (("total", "gross", "amount", "summary"), 0.68, 36, None),
}


def searched_spans(page: DataFrame) -> DataFrame:
    """(key, field, start, end): what similarity finds on ``page(key, field, hay, norm, needle)``: anywhere at 0.92, else after anchors."""
    whole = F.array(F.struct(F.lit(0).alias("first"), F.size("hay").alias("stop")))
    anywhere = similar_spans(page.select("key", "field", "hay", "needle", F.lit(0.92).alias("least"), whole.alias("ranges"), F.lit(False).alias("guided")))
    rest = page.join(anywhere.select("key", "field"), ["key", "field"], "left_anti")
    least, ranges = F.lit(None).cast("double"), F.array().cast("array<struct<first:int,stop:int>>")
    for field, (terms, low, reach, _) in GUIDED.items():
        if terms:
            least = F.when(F.col("field") == field, F.lit(low)).otherwise(least)
            ranges = F.when(F.col("field") == field, anchor_ranges(F.col("norm"), terms, reach)).otherwise(ranges)
    after = similar_spans(rest.select("key", "field", F.col("norm").alias("hay"), "needle", least.alias("least"), ranges.alias("ranges"), F.lit(True).alias("guided")))
    return anywhere.unionByName(after).drop("score")


def assigned(candidates: Column) -> Column:
    """Of (order, field, start, end) candidates those that are the first of their field and overlap none before them."""
    kind = "array<struct<order:int,field:string,start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(candidates), F.array().cast(kind),
        lambda acc, c: F.when(F.exists(acc, lambda o: (o["field"] == c["field"]) | ((o["start"] < c["end"]) & (c["start"] < o["end"]))), acc).otherwise(F.concat(acc, F.array(c)).cast(kind)),
    )


def exact_place(f: str, texts: list, needle: tuple) -> int | None:
    """As :func:`subsequence` of a field's values, of which only those before the place are worked out."""
    n = len(needle)
    if not n:
        return None
    value = S.token_value
    return next((i for i in range(len(texts) - n + 1) if value(f, texts[i]) == needle[0] and all(value(f, texts[i + k]) == needle[k] for k in range(1, n))), None)


def field_found(f: str, texts, ids, truths) -> list[tuple]:
    """(start, end) of a field on a page: exact places of true values, else what :func:`searched_spans` finds."""
    needles = [S.value_tokens(f, t[f]) for t in truths]
    exact = [(ids[at], ids[at] + len(w)) for w in needles if (at := exact_place(f, texts, w)) is not None]
    if exact:
        return exact
    terms, low, reach, _ = GUIDED[f]
    hay = [S.token_value(f, t) for t in texts]
    whole = [{"first": 0, "stop": len(hay)}]
    found = [m for w in needles if (m := most_similar(hay, w, 0.92, whole, False, 2, frozenset(REJECT)))]
    if not found and terms:
        norms = [S.norm(t) for t in texts]
        ranges = [{"first": i + 1, "stop": min(len(norms), i + 1 + reach)} for i, w in enumerate(norms) if S.label(w) in terms]
        found = [m for w in needles if (m := most_similar(norms, w, low, ranges, True, 2, frozenset(REJECT)))]
    return [max(found, key=lambda m: m[2:])[:2]] if found else []


def page_spans_of_truth(texts, xs, ids, more, truths) -> list[tuple]:
    """(field, start, end) of a page's spans; see :func:`weak_labels`."""
    spans = []

    def take(f, places):
        for start, end in sorted(places):
            if not any(f == g or (start < e and s < end) for g, s, e in spans):
                spans.append((f, start, end))

    for f, (*_, most) in GUIDED.items():
        if f not in N.MONEY_FIELDS:
            take(f, [(s, e) for s, e in field_found(f, texts, ids, truths) if most is None or e - s <= most])
    known = [(f, c) for t in truths for f in N.MONEY_FIELDS if (c := S.cents(t[f])) is not None]
    if known:
        lines = layout.lines_from(texts, xs, ids, more)
        on_line = page_money_line(page_amounts(texts, xs, ids, lines, True), texts, lines, known)
        for f in N.MONEY_FIELDS:
            take(f, [(s, e) for g, s, e in on_line if g == f])
    for f in N.MONEY_FIELDS:  # the search for an amount that the money line gives could not change anything
        if all(f != g for g, *_ in spans):
            take(f, field_found(f, texts, ids, truths))
    return spans


def weak_labels(words: DataFrame, lined: DataFrame | None = None, truth: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """(key, words, labels, spans): BIO labels of a page from its true values; no words without ``texts``.

    Exact subsequences come first, then windows by similarity; amounts prefer the money line.  Spans are
    taken in the order of fields, each only where no word is taken yet.  Takes pages too, as :func:`line_money_spans`
    does; ``lined`` are the words with their lines.
    """
    pages = with_truth(words if lined is None else lined, truth, N.FIELDS)

    def of_page(_, own, xs, ids, *more):
        *more, truths = more
        if not truths:
            return []
        spans = page_spans_of_truth(own, xs, ids, more, truths)
        labels = ["O"] * len(own)
        for f, start, end in spans:
            for i in range(max(0, start), min(end, len(labels))):
                labels[i] = ("B-" if i == start else "I-") + f.upper()
        row = (labels, [(f, [start, end]) for f, start, end in spans])
        return [(own, *row) if texts else row] * len(truths)

    kind = "words array<string>, " * texts + "labels array<string>, spans map<string, array<bigint>>"
    return layout.by_page(pages, kind, of_page, "text", "x", "word_idx", *layout.lines_of(pages), beside=("truth",))


def coverage(spans: DataFrame, keys: DataFrame, fields: tuple[str, ...] = N.FIELDS) -> DataFrame:
    """(field, pages, matched, pct): how often each field was found."""
    n = keys.agg(F.count_distinct("key").alias("pages"))
    hit = spans.groupBy("field").agg(F.count_distinct("key").alias("matched"))
    every = keys.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(F.broadcast(n))
    out = every.join(hit, "field", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("pct", F.round(F.try_divide(F.col("matched") * 100.0, F.col("pages")), 2))
