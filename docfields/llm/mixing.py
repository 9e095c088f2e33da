"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Plan, all of it DataFrame and SQL expressions:

1. ``sizes``: words of every document, written once (the only pass over the texts).
2. ``targets``: one row per source, by code point, weights repeating; water-filling under
   the cap of ``cap`` times the source's size.
3. A source's documents, in an order permuted by hash, are a stream of words, cut into blocks of
   at most ``block_words`` words.  The stream is passed again and again; an affine permutation
   deals out the blocks of each pass.  The source's exact quota is the number of blocks dealt
   until its target is reached; the last one is cut to the word.
4. ``split_tree``: the vector of quotas is halved level by level down to the output shards.
   Each halving draws how many blocks of every source go left from the multivariate
   hypergeometric distribution, so every shard is a fair sample of the mix and no block is
   lost or drawn twice.
5. A shard draws its quota from the source's dealt blocks: disjoint ranges of the permutation.
   What the leaves of the tree draw is the mix; a document's words are those of its drawn blocks.
   Documents find blocks and shards by arithmetic on the running sum of words, computed in two
   levels (hash buckets, then inside a bucket), so a source with a third of all rows is never
   in one task.
6. ``mixed_documents`` writes the documents by shard, each shard in a random order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, boxed, bucket, buckets_for, materialize, unboxed

WEIGHTS = (5, 2, 1)
SPREAD = 2_654_435_761  # prime; multiplies block numbers in the affine permutation


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(key, source_size, position, weight, target): one row per source; ``key`` orders null last.

    Sources below their cap share the words in proportion to weight at one common level; the
    level is the first, by rising cap-to-weight ratio, that no remaining source's cap cuts.
    The table of sources is handled in one task, here and in ``split_tree``: sources are names of
    collections, up to some hundred thousand, not of documents.
    """
    w = F.array(*[F.lit(int(x)) for x in weights])
    table = sizes.groupBy("key").agg(F.sum("size").cast("long").alias("source_size"))
    table = table.withColumn("position", F.row_number().over(W.orderBy("key")) - 1)
    table = table.withColumn("weight", F.get(w, F.col("position") % len(weights)).cast("double"))
    whole = W.partitionBy()
    rising = W.orderBy("ratio", "key")
    table = (
        table.withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole)["level"])
    )
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return table.select("key", "source_size", "position", "weight", target.alias("target"))


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(n: str, total: str, m: str, u: str) -> str:
    """SQL: of ``n`` blocks among ``total``, how many are among ``m`` drawn; ``u`` is uniform in (0, 1).

    Inversion: the probabilities follow their recurrence over 12 standard deviations around
    the mean (all of the support, where that is smaller), are summed, and the running sum is
    compared with ``u`` times the total.
    """
    share = f"({n} / {total})"
    spread = f"(2D + 12D * sqrt(greatest(0D, {m} * {share} * (1D - {share}) * ({total} - {m}) / greatest({total} - 1, 1))))"
    support = f"""named_struct(
        'lo', greatest(0L, {m} - ({total} - {n}), cast(floor({m} * {share} - {spread}) as bigint)),
        'hi', least({n}, {m}, cast(ceil({m} * {share} + {spread}) as bigint)))"""
    following = f"s.p * (cast({n} - x as double) * ({m} - x)) / (cast(x + 1 as double) * ({total} - {n} - {m} + x + 1))"
    mass = f"""aggregate(sequence(b.lo, b.hi), named_struct('p', 1D, 'sum', 0D),
        (s, x) -> named_struct('p', {following}, 'sum', s.sum + s.p), s -> s.sum)"""
    chosen = f"""aggregate(sequence(b.lo, b.hi), named_struct('p', 1D, 'sum', 0D, 'x', b.lo),
        (s, x) -> named_struct('p', {following}, 'sum', s.sum + s.p, 'x', if(s.sum <= goal, x, s.x)), s -> s.x)"""
    drawn = let("b", support, let("goal", f"{u} * {mass}", chosen))
    return f"if({n} = 0 or {m} = 0, 0L, if({n} = {total}, {m}, {drawn}))"


def split_tree(quotas: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """(key, cumulative): for every source, the running number of blocks dealt to shards 0..k.

    ``quotas(key, quota)`` has one row per source.  ``shards`` is a power of two; each level
    halves the blocks of every node, the left half getting the larger part of an odd number.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("s")).select(
        F.lit(0).cast("long").alias("node"), F.col("s.key").alias("keys"), F.col("s.quota").alias("q")
    )
    for level in range(levels):
        uniform = f"(pmod(xxhash64({seed}, {level}, node, i), 9007199254740992L) + 0.5D) / 9007199254740992D"
        # fold over the sources: how many of the blocks still to draw come from this one
        fold = let(
            "d",
            f"named_struct('n', element_at(q, i), 'rest', acc.rest, 'm', acc.m, 'u', {uniform})",
            let(
                "got",
                hypergeometric("d.n", "d.rest", "d.m", "d.u"),
                "named_struct('rest', d.rest - d.n, 'm', d.m - got, 'left', concat(acc.left, array(got)))",
            ),
        )
        left = f"""if(size(q) = 0, q, aggregate(sequence(1, size(q)),
            named_struct('rest', total, 'm', cast(ceil(total / 2D) as bigint), 'left', cast(array() as array<bigint>)),
            (acc, i) -> {fold}, acc -> acc.left))"""
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, left, (a, b) -> a - b)").alias("q")),
        )
        node = (
            node.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x)"))
            .withColumn("left", F.expr(left))
            .select("keys", F.explode(halves).alias("c"))
            .select("c.node", "keys", "c.q")
        )
    leaves = node.select("node", F.explode(F.arrays_zip("keys", "q")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.q").alias("n"))
    per = leaves.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("d"))
    return per.select(
        "key",
        F.expr("aggregate(d, cast(array() as array<bigint>), (a, x) -> concat(a, array(x.n + if(size(a) = 0, 0L, element_at(a, -1)))))").alias("cumulative"),
    )


def shards_for(words: int) -> int:
    """A power of two: about one shard for every 2 ** 22 words, from 8 to 4096 of them."""
    return 1 << min(12, max(3, (max(1, words) >> 22).bit_length()))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = 3.0,
    block_words: int = 8192,
    shards: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, row, key, size, source_size, target, pieces.

    ``pieces`` is an array of (epoch, block, shard, first_word, last_word): the word ranges of
    the document that shards draw, each in one block and so in one shard.  A block has at most
    ``block_words`` words and at most a 64th of its source.

    Cases: a null text has no words; a null source is a source of its own, ordered last; an
    empty table gives no rows; repeated rows are documents of their own; ties of the hash are
    ordered by doc_id and text; other columns are ignored.  Reruns on the same rows agree.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sizes = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("row"), key.alias("key"), size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h")), "sizes"
    )
    count, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = buckets_for(count)
    sizes = sizes.withColumn("_b", bucket(n, F.col("h")))
    sources = targets(sizes, weights, cap)
    wanted = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * cap)).cast("long")
    sources = sources.withColumn("wanted", wanted).withColumn("bw", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr("source_size div 64"))).cast("long"))
    # blocks of a pass; the short last one and its place in the permutation; words beyond the whole passes
    sources = sources.selectExpr("*", "cast(ceil(source_size / bw) as bigint) as blocks", "if(source_size = 0, 0L, wanted div source_size) as passes")
    sources = sources.selectExpr("*", "bw - (source_size - (blocks - 1) * bw) as missing", f"if(blocks = 0, 0L, ((blocks - 1) * {SPREAD}L + {seed}L) % blocks) as short_at", "wanted - passes * source_size as rest")
    sources = sources.selectExpr("*", "cast(ceil(rest / bw) as bigint) as m0").selectExpr(
        "*", "if(m0 * bw - if(short_at < m0, missing, 0L) >= rest, m0, cast(ceil((rest + missing) / bw) as bigint)) as m"
    )
    sources = sources.selectExpr("*", "passes * blocks + m as quota", "m * bw - if(short_at < m, missing, 0L) - rest as cut")
    sources = sources.join(split_tree(sources.select("key", "quota"), shards or shards_for(words), seed), "key")
    before = W.partitionBy("key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("key", "_b").agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .join(sources, "key")
        .select("key", "_b", "_before", "source_size", "target", "bw", "blocks", "cut", "cumulative")
    )
    inside = W.partitionBy("key", "_b").orderBy("h", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(parts, ["key", "_b"])
        .withColumn("at", F.col("_before") + F.col("_in"))
        .withColumn("drawn", F.element_at("cumulative", -1))
    )
    # every pass over the document, block by block: which shard draws it, if any
    pieces = f"""
    if(size = 0 or drawn = 0, array(), filter(flatten(transform(
      sequence(0L, (drawn - 1) div blocks),
      e -> transform(sequence(at div bw, (at + size - 1) div bw), b -> {let(
        "p", f"e * blocks + (b * {SPREAD}L + {seed}L) % blocks",
        """named_struct('epoch', e, 'block', b,
          'shard', aggregate(cumulative, 0, (k, c) -> k + if(c <= p, 1, 0)),
          'first_word', greatest(at, b * bw) - at,
          'last_word', if(p >= drawn, 0L, least(at + size, least((b + 1) * bw, source_size) - if(p = drawn - 1, cut, 0L)) - at))""",
    )}))), r -> r.first_word < r.last_word))
    """
    return placed.withColumn("pieces", F.expr(pieces)).select("doc_id", "row", "key", "size", "source_size", "target", "pieces")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the number of pieces and of shards they go to; cases as in :func:`mix`."""
    mixed = mix(docs)
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        F.expr("aggregate(pieces, 0L, (a, p) -> a + p.last_word - p.first_word)").alias("taken"),
        F.size("pieces").alias("n_pieces"),
        F.size(F.array_distinct("pieces.shard")).alias("n_shards"),
    )


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every pass of the mix over a document.

    A pass that draws the whole document has its text unchanged; one that draws some of its blocks
    has their words, joined by single spaces.  n_chars follows.  A pass is written with the shard of
    its first block; a shard's rows are in the order of a hash, in as many tasks as shuffles have.

    Cases: documents without words are never drawn; null sources and doc_ids are kept; rows that
    repeat doc_id, source and text pair up with their draws by number; an empty table gives no rows;
    other columns are kept, whatever their names.
    """
    mixed = mix(docs, seed=seed, **options).where(F.size("pieces") > 0)
    same = W.partitionBy("doc_id", "row", "key")
    passes = """transform(array_distinct(transform(pieces, p -> p.epoch)), e -> named_struct(
        'epoch', e, 'parts', filter(pieces, p -> p.epoch = e)))"""
    drawn = mixed.select(
        F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("key").alias("k"), F.col("size").alias("n"),
        F.row_number().over(same.orderBy(F.col("pieces").cast("string"))).alias("number"), F.expr(passes).alias("passes"),
    )
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = boxed(docs, doc_id=F.col("doc_id"), row=F.xxhash64("text"), key=key)
    rows = rows.withColumn("no", F.row_number().over(same.orderBy(F.lit(0))))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("key") == F.col("k")) & (F.col("no") == F.col("number"))
    taken = rows.join(drawn.hint("merge"), on).withColumn("pass", F.explode("passes"))
    words = rf"regexp_extract_all(doc.text, r'({WORD_PATTERN})', 1)"
    some = F.expr(let("w", words, "array_join(flatten(transform(pass.parts, p -> slice(w, cast(p.first_word as int) + 1, cast(p.last_word - p.first_word as int)))), ' ')"))
    whole = F.expr("aggregate(pass.parts, 0L, (a, p) -> a + p.last_word - p.first_word)") == F.col("n")
    taken = taken.withColumn("text", F.when(whole, F.col("doc.text")).otherwise(some)).withColumn("shard", F.expr("pass.parts[0].shard"))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "row", "pass.epoch")
    taken = taken.withColumn("order", order).withColumn("salt", F.pmod("order", F.lit(64)))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return unboxed(taken.repartition("shard", "salt").sortWithinPartitions("shard", "order"), docs.columns, **new)
