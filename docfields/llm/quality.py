"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, over whole code points.

Trusted documents are those labelled good and not toxic, all of them.  Four in five are counted, the
fifth sets the thresholds, so these are not flattered by text the model has seen.

1. ``packed``: documents are dealt to blocks of about ``BLOCK`` bytes by a hash of doc_id and travel
   compressed.  Labels are dealt alike, so trusted documents are known where their texts are.
2. ``gathered``: every block counts the ``ORDER``-grams of its trusted documents, each gram with its
   context and its suffix, and lists the distinct grams of all its documents.  Grams are 64-bit
   hashes of code points; none is folded into another.
3. ``kneser_ney``: counts are summed by gram, sharded over the cluster.  Lower orders are
   continuation counts.  Discounts come from the counts of counts; each order's probabilities are a
   join of its counts with its contexts' sums and with the order below.
4. The grams that blocks ask for are joined with the model, sharded by gram; the answers go back to
   the blocks by a second join, where unseen grams back off and every whole text is scored.
5. A document's score is its negative log probability for each character, drawn towards its
   language's mean as by ``PRIOR`` further characters, so short texts need more evidence.  It
   is rejected above its language's ``quantile`` of the held-back trusted documents' scores
   (plus two standard errors of their mean, which matters where they are few).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize, per_process, release, segments, small_side, trim
from .jaccard import mixed

ORDER = 5
PRIOR = 200
START = 10  # a text begins as after line ends
BLOCK, PIECE = 1 << 25, 1 << 18  # bytes of a block, and of what is hashed at once
SENT = 1 << 16  # rows of a batch that a worker sends
RADIX = np.uint64(0x9E3779B97F4A7C15)


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, check): documents with a good label and no toxic or bad one; are they held back?"""
    return (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .where("q = 1 and coalesce(t, 0) = 0").select("doc_id", held_back(F.col("doc_id")).alias("check"))
    )


def held_back(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def language() -> Column:
    return F.coalesce("lang", F.lit("und"))


# ------------------------------------------------------------------------ grams


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, index of the first byte of each) of valid UTF-8 bytes."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    size = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        code[more] = code[more] << 6 | (data[at[more] + k] & 0x3F)
    return code.astype(np.int64), at


class Hashes:
    """Hashes of the grams of a run of texts; each text begins after ``ORDER`` - 1 line ends."""

    def __init__(self):
        import sys

        self.value = mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64))
        self.power = np.array([pow(int(RADIX), j, 1 << 64) for j in range(ORDER)], np.uint64)
        self.slot = np.empty(1 << 20, np.int32)

    def read(self, data: np.ndarray, starts: np.ndarray) -> None:
        code, at = points(data)
        begin = np.searchsorted(at, starts)
        self.size = np.diff(np.append(begin, len(code)))
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.values = self.value[np.insert(code, np.repeat(begin, ORDER - 1), START)]
        self.where = np.arange(len(code)) + (ORDER - 1) * (self.row + 1)

    def whole(self) -> np.ndarray:
        """Hash of the longest gram that ends at every character."""
        total = self.values.copy()
        for j in range(1, ORDER):
            total[j:] += self.values[:-j] * self.power[j]
        return self.finished(total[self.where], ORDER)

    def at(self, places: np.ndarray, order: int) -> np.ndarray:
        """Hash of the gram of ``order`` characters that ends at each of ``places``; the empty gram is 0."""
        total = np.zeros(len(places), np.uint64)
        for j in range(order):
            total += self.values[places - j] * self.power[j]
        return self.finished(total, order) if order else total

    @staticmethod
    def finished(x: np.ndarray, order: int) -> np.ndarray:
        x = x ^ np.uint64(order)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of one of each distinct value, number of every value among these)."""
        index = np.arange(len(x), dtype=np.int32)
        slot = (x >> np.uint64(44)).astype(np.int32)
        self.slot[slot] = index
        first = self.slot[slot]
        rest = np.flatnonzero(x[first] != x)
        if len(rest):
            _, one, number = np.unique(x[rest], return_index=True, return_inverse=True)
            first[rest] = rest[one][number]
        own = first == index
        return np.flatnonzero(own), (np.cumsum(own, dtype=np.int32) - 1)[first]


def hashes() -> Hashes:
    return per_process("grams", Hashes)


# ----------------------------------------------------------------------- blocks


def packed(docs: DataFrame, blocks: int, flush: int = 3 << 22) -> DataFrame:
    """(block, rows): documents as compressed Arrow tables (doc_id, lang, row, text)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
        held, size = [], 0

        def chunk():
            table = pa.Table.from_batches(held).combine_chunks().sort_by("block")
            ids, counts = np.unique(table["block"].to_numpy(), return_counts=True)
            cells, at = [], 0
            for n in counts.tolist():
                sink = pa.BufferOutputStream()
                part = table.slice(at, n).drop_columns(["block"])
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_table(part)
                cells.append(sink.getvalue().to_pybytes())
                at += n
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary())], names=["block", "rows"])

        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch["text"].cast(pa.large_string()))
            held.append(batch)
            size += pc.sum(pc.binary_length(batch["text"])).as_py() or 0
            if size > flush:
                yield chunk()
                held, size = [], 0
        if sum(len(x) for x in held):
            yield chunk()
        held.clear()
        trim()

    block = block_of(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), blocks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("lang"), "text")
    rows = rows.select(block.alias("block"), "doc_id", "lang", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, "block long, rows binary")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("long")


def unpacked(cells):
    """The tables of a block one by one; only one of them is held uncompressed."""
    import pyarrow as pa

    for x in cells:
        yield pa.ipc.open_stream(x.as_buffer()).read_all()


def summed(parts):
    """(gram, context, suffix, n) of distinct grams from several such."""
    gram, context, suffix, n = (np.concatenate(z) for z in zip(*parts))
    _, first, again = np.unique(gram, return_index=True, return_inverse=True)
    return gram[first], context[first], suffix[first], np.bincount(again, n).astype(np.int64)


def gathered(blocks: DataFrame, good: DataFrame) -> DataFrame:
    """(kind, block, gram, context, suffix, n) of every block.

    Kinds 1 to ``ORDER``: distinct grams of so many characters in trusted documents that are not held
    back, with n occurrences.  Kind 0: distinct grams of any order in any document.
    """

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, out = ["kind", "block", "gram", "context", "suffix", "n"], []

        def put(kind, block, gram, *others):
            none = pa.array(np.zeros(len(gram), np.int64))
            others = [pa.array(x.view(np.int64)) for x in others] or [none] * 3
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), kind, np.int32)), pa.array(np.full(len(gram), block)), pa.array(gram.view(np.int64)), *others], names=names)
            # the JVM holds a batch whole, outside its heap and for every running task
            out.extend(batch.slice(at, SENT) for at in range(0, len(batch), SENT))

        if left.num_rows:
            h, block = hashes(), left["block"][0].as_py()
            counted = right.filter(pc.invert(right["check"]))["doc_id"].combine_chunks()
            asked, seen = [np.zeros(1, np.uint64)], {k: [] for k in range(1, ORDER + 1)}

            def parts():
                for table in unpacked(left["rows"]):
                    mine = pc.is_in(table["doc_id"], value_set=counted)
                    yield True, table["text"].filter(mine).combine_chunks()
                    yield False, table["text"].filter(pc.invert(mine)).combine_chunks()

            for train, texts in parts():
                for *_, data, starts, _ in segments(texts, PIECE):
                    h.read(data, starts)
                    x = h.whole()
                    one, number = h.distinct(x)
                    place = h.where[one]
                    grams = [h.at(place, k) for k in range(1, ORDER)] + [x[one]]
                    # contexts are grams that end one character before, in the list already, or line ends before a text
                    asked += [x[h.distinct(x)[0]] for x in grams] + [h.at(h.where[:1] - 1, k) for k in range(1, ORDER)]
                    if sum(map(len, asked)) > 1 << 21:
                        asked = [np.unique(np.concatenate(asked))]
                    if train:
                        before = [h.at(place - 1, k) for k in range(ORDER)]
                        for k in range(1, ORDER + 1):
                            n = np.bincount(number, minlength=len(one)) if k == ORDER else np.ones(len(one), np.int64)
                            suffix = grams[k - 2] if k > 1 else np.zeros(len(one), np.uint64)
                            first, again = h.distinct(grams[k - 1])
                            seen[k].append((grams[k - 1][first], before[k - 1][first], suffix[first], np.bincount(again, n).astype(np.int64)))
                            if sum(len(x) for x, *_ in seen[k]) > 1 << 19:
                                seen[k] = [summed(seen[k])]
            for k, parts in seen.items():
                if parts:
                    put(k, block, *summed(parts))
            put(0, block, np.unique(np.concatenate(asked)))
        asked = seen = None
        trim()
        return pa.Table.from_batches(out, pa.schema([(name, pa.int32() if name == "kind" else pa.int64()) for name in names]))

    return blocks.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(run, "kind int, block long, gram long, context long, suffix long, n long")


# ------------------------------------------------------------------------ model


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(gram, p, backoff): probability of the seen grams after their contexts, and weight of backing off after them.

    ``counts(kind, gram, context, suffix, n)`` may hold a gram several times; the highest kind's n count.
    """
    top = counts.where(F.col("kind") == ORDER).groupBy("gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("c"))
    tables = {ORDER: materialize(top, "grams")}
    for order in range(ORDER - 1, 0, -1):
        follow = tables[order + 1].groupBy(F.col("suffix").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        links = counts.where(F.col("kind") == order).groupBy("gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"))
        tables[order] = materialize(links.join(follow, "gram"), "grams")
    sums = None
    for order, table in tables.items():
        one = table.agg(F.lit(order).alias("order"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("n"))
        sums = one if sums is None else sums.union(one)
    found = {r["order"]: r for r in sums.collect()}  # ORDER rows
    model, lower = None, None
    for order in range(1, ORDER + 1):
        r = found[order]
        n1, n2, n3, n4 = (max(1, r[f"n{k}"]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        # of few kinds of gram, as characters are, discounts that come out beyond their counts are held inside
        d1, d2, d3 = (min(k - 0.05, max(0.05, x)) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        off = F.when(F.col("c") == 1, F.lit(d1)).when(F.col("c") == 2, F.lit(d2)).otherwise(F.lit(d3))
        rows = tables[order].withColumn("off", off)
        context = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("off"))
        context = context.select("context", "total", (F.col("off") / F.col("total")).alias("backoff"))
        joined = rows.join(context, "context")
        own = (F.col("c") - F.col("off")) / F.col("total")
        if order == 1:
            seen = joined.select("gram", (own + F.col("backoff") / F.lit(float(r["n"] + 1))).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            seen = joined.join(below, "suffix").select("gram", (own + F.col("backoff") * F.col("below")).alias("p"))
        lower = materialize(seen, "kn")
        both = lower.select("gram", "p", F.lit(None).cast("double").alias("backoff")).union(context.select("context", F.lit(None).cast("double"), "backoff"))
        model = both if model is None else model.union(both)
    unseen = model.sparkSession.range(1).select(F.lit(-1).cast("long"), F.lit(1 / (found[1]["n"] + 1)), F.lit(None).cast("double"))
    return model.union(unseen).groupBy("gram").agg(F.max("p").alias("p"), F.max("backoff").alias("backoff"))


def score(blocks: DataFrame, answers: DataFrame, unseen: float) -> DataFrame:
    """(doc_id, lang, row, n_symbols, nll): length and summed negative log probability of every document.

    ``answers(block, gram, p, backoff)`` holds what the model knows of the block's grams; ``unseen`` is the
    probability of any character to a model that knows none.
    """

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())], names=["doc_id", "lang", "row", "n_symbols", "nll"])
        h = hashes()
        key = np.asarray(right["gram"].to_numpy(), np.int64).view(np.uint64)
        order = np.argsort(key)
        key = np.append(key[order], np.uint64(2**64 - 1))
        # single precision, as they travel; widened where they are looked up
        p, backoff = (np.append(np.asarray(right[c].to_numpy(), np.float32)[order], np.float32(np.nan)) for c in ("p", "backoff"))
        del right, order

        def known(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            at = np.searchsorted(key[:-1], x)
            return np.where(key[at] == x, of[at].astype(np.float64), np.nan)

        out = []
        kept, kept_cost = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21)  # of grams met in earlier pieces
        for table in unpacked(left["rows"]):
            sizes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for first, last, data, starts, _ in segments(table["text"].combine_chunks(), PIECE):
                h.read(data, starts)
                total = np.zeros(last - first)
                if len(h.where):
                    x = h.whole()
                    one, number = h.distinct(x)
                    slot = (x[one] >> np.uint64(43)).astype(np.int64)
                    costs = kept_cost[slot]
                    new = np.flatnonzero(kept[slot] != x[one])
                    place, cost = h.where[one[new]], np.full(len(new), unseen)
                    for k in range(1, ORDER + 1):
                        seen, weight = known(h.at(place, k), p), known(h.at(place - 1, k - 1), backoff)
                        cost = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * cost, seen)
                    costs[new] = -np.log(cost)
                    kept[slot[new]], kept_cost[slot[new]] = x[one[new]], costs[new]
                    total = np.bincount(h.row, costs[number], last - first)
                sizes.append(h.size), sums.append(total)
            columns = [table["doc_id"], table["lang"].cast(pa.string()), table["row"], pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(sums))]
            out.append(pa.table(columns, names=["doc_id", "lang", "row", "n_symbols", "nll"]))
        del table, kept, kept_cost
        trim()
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, row long, n_symbols long, nll double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.985) -> DataFrame:
    """doc_id, lang, row, n_symbols, perplexity, score, threshold, keep for every document.

    Cases: a null language is ``und``; a language without trusted held-back documents takes the
    threshold of all of them together; with no trusted document at all everything is kept; a
    null or empty text has perplexity 1, its language's mean as score, and is kept; repeated
    rows are judged alike; a null doc_id stays null; an empty table gives no rows; other
    columns are ignored.  ``row`` is a hash of the text that tells rows of one doc_id apart.
    A text is held in one task, so one of many gigabytes needs an executor of some times its size.
    Probabilities travel in single precision.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    good = good_ids(labels)
    blocks = packed(docs, n)
    dealt = good.withColumn("block", block_of(F.xxhash64("doc_id"), n))
    found = materialize(gathered(blocks, dealt), "gathered")
    release(docs.sparkSession)
    counts = found.where("kind > 0")
    if counts.isEmpty():
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("lang"), F.xxhash64("text").alias("row"), F.length("text").cast("long").alias("n_symbols"))
        return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "score", "threshold")], F.lit(True).alias("keep"))
    model = materialize(kneser_ney(counts), "kn-model")
    unseen = model.where("gram = -1").first()["p"]
    asked = materialize(found.where("kind = 0").select("block", "gram"), "asked")
    drop_written(found)
    release(docs.sparkSession)
    answers = asked.join(model.hint("merge"), "gram").select(F.col("block"), "gram", F.col("p").cast("float"), F.col("backoff").cast("float"))
    answers = materialize(answers, "answers")
    drop_written(asked)
    release(docs.sparkSession)
    scored = materialize(score(blocks, answers, unseen), "scored")
    drop_written(answers)
    held = materialize(scored.join(good.where("check").select("doc_id"), "doc_id", "left_semi").where("n_symbols > 0"), "held-back", small=True)
    mean = small_side(held.groupBy("lang").agg((F.sum("nll") / F.sum("n_symbols")).alias("mean")))
    all_mean = held.agg((F.sum("nll") / F.sum("n_symbols")).alias("m")).first()["m"]
    all_mean = float(all_mean if all_mean is not None else -np.log(unseen))

    def drawn(df: DataFrame) -> DataFrame:
        df = df.join(mean, "lang", "left").withColumn("mean", F.coalesce("mean", F.lit(all_mean)))
        return df.withColumn("score", (F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR))

    limit = drawn(held)
    # few held-back documents place a high quantile too low, so it is raised by two standard errors of their mean
    margin = 2 * F.coalesce(F.stddev_samp("score"), F.lit(1.0)) / F.sqrt(F.count(F.lit(1)))
    edge = (F.percentile_approx("score", quantile, 100_000) + margin).alias("threshold")
    per_language = small_side(limit.groupBy("lang").agg(edge))
    overall = limit.agg(edge).first()["threshold"]
    judged = drawn(scored).join(per_language, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    return judged.select(
        "doc_id", "lang", "row", "n_symbols",
        F.exp(F.coalesce(F.try_divide("nll", "n_symbols"), F.lit(0.0))).alias("perplexity"),
        "score", "threshold",
        F.coalesce((F.col("n_symbols") == 0) | (F.col("score") <= F.col("threshold")), F.lit(True)).alias("keep"),
    )
