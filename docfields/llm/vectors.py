"""Embedding operators: exact near-duplicate join by subspaces, exact top-k search by pivot distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import components, forest, materialize


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding); a vector is null unless whole, finite and of the most frequent length (ties: the longest)."""
    x = F.col("embedding")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull()
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, x).alias("embedding"))
    top = df.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return df.withColumn("embedding", F.when(F.size("embedding") == (top["d"] if top else -1), F.col("embedding")))


def matrix(column, dtype: str = "<f8") -> np.ndarray:
    """Rows of equal length from a column of their bytes."""
    flat = np.frombuffer(b"".join(column), dtype=dtype)
    return flat.reshape(len(column), -1)


def rows_of(array) -> np.ndarray:
    """A float64 matrix from an Arrow list column whose rows have one length and no nulls."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


LOWEST = -(1 << 62)  # below every score

# ------------------------------------------------------------- near duplicates


def rotation(dim: int, seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix: spreads every direction over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def near_duplicates(
    table: DataFrame, threshold: float = 0.95, block_dims: int = 8, tile_rows: int = 16384, seed: int = 7
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links are pairs of cosine >= ``threshold``.

    Equal vectors are first folded into one, with their number.  Unit vectors are rotated and
    split into blocks of ``block_dims`` coordinates.  Linked vectors differ by at most
    2 - 2 * threshold in squared distance, so in at least one block by at most that block's
    share of it, in proportion to its coordinates.  Each block is range-joined: cells as wide
    as the block's radius along its first coordinate, a vector meets its own and the next
    cell.  Cells of more than ``tile_rows`` vectors are cut into chunks and every pair of chunks
    is a tile of its own, so no group is unbounded.  In a tile, pairs within the block's budget
    are verified in double precision on the whole vectors; a pair that an earlier block also
    finds is left to that block, so each link counts once.  Tiles return counts and a spanning
    star per local component, never the pairs.

    Cases: vectors that are null, empty, zero, of another length than most, or that hold null
    or non-finite components link with nothing; repeated rows count as vectors of their own;
    a null vec_id stays null and takes no part; other columns are ignored; an empty table gives
    no rows.
    """
    kind = table.schema["embedding"].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"

    def to_bytes(batches):
        import pyarrow as pa

        for batch in batches:
            cells: list = [None] * len(batch)
            whole = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if len(whole):
                x = rows_of(batch.column(1).drop_null()) + 0.0  # one zero, not two
                for i, row in zip(whole.tolist(), x):
                    cells[i] = row.astype(dtype).tobytes() if row.any() else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["vec_id", "x"])

    every_row = materialize(usable(table).mapInArrow(to_bytes, "vec_id long, x binary"), "vectors")
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    vectors = every_row.where("x is not null")
    unlinked = every_row.where("x is null").select("vec_id", *alone)
    first = vectors.select("x").first()
    if first is None:
        return unlinked.withColumn("kept", F.lit(True))
    dim = len(first["x"]) // np.dtype(dtype).itemsize
    classes = materialize(vectors.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "classes")

    turn = rotation(dim, seed)
    blocks = [slice(i, min(i + block_dims, dim)) for i in range(0, dim, block_dims)]
    budget = [(2 - 2 * threshold) * (b.stop - b.start) / dim for b in blocks]
    slack = 1e-5
    edge = [b + 1e-6 for b in budget]  # a block has a pair up to here, by one expression wherever it is asked

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def cells_of(x: np.ndarray) -> np.ndarray:
        lead = unit(x) @ turn[:, [b.start for b in blocks]]
        return np.floor(lead / (np.sqrt(edge) + slack)).astype(np.int64)

    def count_cells(batches):
        import pyarrow as pa

        for batch in batches:
            at = cells_of(matrix(batch.column(0).to_pylist(), dtype)) if len(batch) else np.zeros((0, len(blocks)), np.int64)
            keys = (np.arange(len(blocks)) * 1_000_003 + at).ravel()
            key, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["cell", "n"])

    # at most 2 / radius cells in each block, whatever the input
    counts = {
        r["cell"]: r["n"]
        for r in classes.select("x").mapInArrow(count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    }
    chunks = {c: -(-n // tile_rows) for c, n in counts.items()}
    numbers: dict[tuple, int] = {}  # tile -> its number
    for c in sorted(chunks):
        for i in range(chunks[c]):
            for j in range(i, chunks[c]):
                numbers[c, c, i, j] = len(numbers)
            for j in range(chunks.get(c + 1, 0)):
                numbers[c, c + 1, i, j] = len(numbers)
    block_of = {n: c[0] for c, n in numbers.items()}
    block_of = {n: min(range(len(blocks)), key=lambda b: abs(c - b * 1_000_003)) for n, c in block_of.items()}

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            xs = batch.column(0).to_pylist()
            at = cells_of(matrix(xs, dtype)) + np.arange(len(blocks)) * 1_000_003
            reps = batch.column(1).to_pylist()
            spread = np.array(reps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            tile, side, row = [], [], []
            for i in range(len(xs)):
                for c in at[i].tolist():
                    k = chunks[c]
                    own = int(spread[i] % np.uint64(k))
                    for j in range(own, k):
                        tile.append(numbers[c, c, own, j]), side.append(0), row.append(i)
                    for j in range(own):
                        tile.append(numbers[c, c, j, own]), side.append(1), row.append(i)
                    for j in range(chunks.get(c + 1, 0)):
                        tile.append(numbers[c, c + 1, own, j]), side.append(0), row.append(i)
                    for j in range(chunks.get(c - 1, 0)):
                        tile.append(numbers[c - 1, c, j, own]), side.append(1), row.append(i)
            for lo in range(0, len(row), 20000):
                part = pa.array(row[lo : lo + 20000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[lo : lo + 20000], pa.int64()), pa.array(side[lo : lo + 20000], pa.int32()), *(batch.column(k).take(part) for k in (1, 2, 0))],
                    names=["tile", "side", "rep", "mult", "x"],
                )

    # tiles in which both sides are one chunk of one cell compare that chunk with itself
    with_itself = {n for (c, d, i, j), n in numbers.items() if c == d and i == j}

    def compare(key, frame):
        import pandas as pd

        tile = key[0]
        b, single = block_of[tile], tile in with_itself
        frame = frame.sort_values("side", kind="stable")
        left = int((frame["side"] == 0).sum())
        x = unit(matrix(frame["x"].tolist(), dtype))
        turned = x @ turn
        part = turned[:, blocks[b]].astype(np.float32)
        norm = np.einsum("ij,ij->i", part, part)
        n, found = len(x), []
        step = max(1, (1 << 22) // max(1, n))
        for lo in range(0, left, step):
            hi = min(lo + step, left)
            start = lo if single else left
            gap = norm[lo:hi, None] + norm[None, start:] - 2 * (part[lo:hi] @ part[start:].T)
            i, j = np.nonzero(gap <= budget[b] + slack)
            i, j = i + lo, j + start
            if single:
                i, j = i[j > i], j[j > i]
            for s in range(0, len(i), 1 << 16):  # whole vectors of few pairs at a time
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[near], q[near]
                mine = np.ones(len(p), dtype=bool)
                for e in range(b + 1):  # in this block and in no earlier one
                    d = turned[p, blocks[e]] - turned[q, blocks[e]]
                    mine &= (np.einsum("ij,ij->i", d, d) <= edge[e]) == (e == b)
                p, q = p[mine], q[mine]
                if len(p):
                    found.append((p, q))
        if not found:
            return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        p, q = (np.concatenate(z) for z in zip(*found))
        mult, rep = frame["mult"].to_numpy(), frame["rep"].to_numpy()
        n_links = np.bincount(p, mult[q], n) + np.bincount(q, mult[p], n)
        root = forest(p, q, n)
        has = np.flatnonzero(n_links)
        return pd.DataFrame({"rep": rep[has], "n": n_links[has].astype("int64"), "root": rep[root[has]]})

    tiles = classes.select("x", "rep", "mult").mapInArrow(deal, "tile long, side int, rep long, mult long, x binary")
    partial = materialize(tiles.groupBy("tile").applyInPandas(compare, "rep long, n long, root long"), "links")
    links = partial.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(partial.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(links, "rep", "left")
        .join(parts.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
        .select(
            "x",
            (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    linked = vectors.join(per_class, "x").select("vec_id", "n_links", "component_id")
    return linked.unionByName(unlinked).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# ------------------------------------------------------------------ top-k search


def top_k(
    table: DataFrame,
    k: int = 20,
    scale: int = 64,
    every: int = 20,
    max_pivots: int = 256,
    rings: int = 64,
    ring_rows: int = 8192,
    sample: int = 4096,
    query_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of floored vectors, exactly.

    Vectors become integers floor(scale * x).  One more coordinate, sqrt(M - |v|^2) with M the
    largest squared length, makes all of them equally long, with 0 in its place in queries, and a
    larger inner product is then a smaller distance.  Pivots come from a sample of at most ``sample`` vectors; every vector is
    keyed by its nearest pivot and its distance to it.  A pivot's vectors fall into at most
    ``rings`` annuli of its distance range; an annulus of more than ``ring_rows`` vectors is
    spread over parts by hash.

    A query first searches the annulus part it lies in, which gives a bound for its k-th score.
    It then goes to the annuli, nearest first, whose triangle-inequality bound does not
    fall short of it; in an annulus, chunks sorted by distance are skipped by the same bound.
    Queries go to annuli in blocks of ``query_block``.

    Cases: null vectors and vectors with null or non-finite components, or of another length
    than most, take no part; rows of one vec_id count once (the smallest vector); ties of
    score go to the smaller vec_id; fewer than ``k`` candidates give fewer rows; an empty table
    gives none; other columns are ignored.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    spark = table.sparkSession
    whole = usable(table).where("embedding is not null")
    floored = whole.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("v"))
    floored = materialize(floored.groupBy("vec_id").agg(F.min("v").alias("v")), "floored")
    norm = F.expr("aggregate(v, 0L, (a, x) -> a + x * x)")
    n, longest, biggest, queries = floored.agg(
        F.count(F.lit(1)), F.max(norm), F.max(F.expr("array_max(transform(v, x -> abs(x)))")), F.count_if(F.col("vec_id") % every == 0)
    ).first()
    if not n or not queries:
        return spark.createDataFrame([], schema)
    drawn = floored.orderBy(F.xxhash64("vec_id")).limit(sample).select("v").collect()
    seen = np.array([r["v"] for r in drawn], dtype=np.float64)
    dim = seen.shape[1]
    exact = np.float64 if dim * float(biggest) ** 2 < 2**52 else np.int64

    def lift(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])

    count = int(min(max_pivots, len(seen), max(4, n // (2 * ring_rows))))
    pivots = lift(seen)[:count]
    reach = 2.0 * float(np.sqrt(longest)) + 1e-9

    def distances(x: np.ndarray, query: bool = False) -> np.ndarray:
        """To all pivots; a query's last coordinate is 0, so that its distance falls as the inner product rises."""
        y = np.hstack([x.astype(np.float64), np.zeros((len(x), 1))]) if query else lift(x)
        d = np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * y @ pivots.T
        return np.sqrt(np.maximum(d, 0.0))

    def key(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                d = distances(x)
                near = d.argmin(axis=1)
                dist = d[np.arange(len(x)), near]
                ring = near * rings + np.minimum((dist / reach * rings * 2).astype(np.int64), rings - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ring), pa.array(dist), pa.array([r.astype("<i8").tobytes() for r in x], pa.binary())],
                    names=["vec_id", "ring", "dist", "v"],
                )

    keyed = materialize(floored.mapInArrow(key, "vec_id long, ring long, dist double, v binary"), "keyed")
    # at most max_pivots * rings rows, whatever the input
    shape = {
        r["ring"]: (r["n"], r["lo"], r["hi"])
        for r in keyed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    }
    parts = {ring: -(-m // ring_rows) for ring, (m, _, _) in shape.items()}
    split = F.create_map(*[F.lit(x) for ring, m in parts.items() if m > 1 for x in (ring, m)]) if max(parts.values()) > 1 else None
    of = F.coalesce(F.try_element_at(split, F.col("ring")), F.lit(1)) if split is not None else F.lit(1)
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), of).cast("int"))
    labels = np.array(sorted(shape))
    low = np.array([shape[r][1] for r in labels])
    high = np.array([shape[r][2] for r in labels])
    pivot_of = labels // rings

    def best(q: np.ndarray, q_id: np.ndarray, bound: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_dist: np.ndarray, q_dist: np.ndarray):
        """Top-k of sorted candidates for every query, chunk by chunk; chunks beyond all bounds are skipped."""
        import pandas as pd

        out = []
        for lo in range(0, len(q), 1024):
            part, ids = q[lo : lo + 1024], q_id[lo : lo + 1024]
            limit = bound[lo : lo + 1024].copy()
            length = np.einsum("ij,ij->i", part.astype(np.float64), part.astype(np.float64))
            top = np.full((len(part), 0), 0)
            top_id = top.copy()
            middle = np.abs(np.arange(0, len(x), 2048) / max(1, len(x)) - np.searchsorted(x_dist, np.median(q_dist)) / max(1, len(x)))
            for c in (np.argsort(middle, kind="stable") * 2048).tolist():  # nearest annulus slices first
                a, b = x_dist[c], x_dist[min(c + 2048, len(x)) - 1]
                gap = np.maximum(0.0, np.maximum(a - q_dist[lo : lo + 1024], q_dist[lo : lo + 1024] - b) - 1e-6)
                need = np.flatnonzero((length + longest - gap * gap) / 2 + 1e-3 >= limit)
                if not len(need):
                    continue
                score = (part[need].astype(exact) @ x[c : c + 2048].astype(exact).T).astype(np.int64)
                score[ids[need, None] == x_id[None, c : c + 2048]] = LOWEST
                new = np.full((len(part), score.shape[1]), LOWEST)
                new[need] = score
                all_s = np.hstack([top, new])
                all_i = np.hstack([top_id, np.broadcast_to(x_id[c : c + 2048], new.shape)])
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k] if all_s.shape[1] <= 4 * k else partial_order(all_s, all_i, k)
                top = np.take_along_axis(all_s, order, axis=1)
                top_id = np.take_along_axis(all_i, order, axis=1)
                if top.shape[1] >= k:
                    limit = np.maximum(limit, top[:, k - 1])
            if top.shape[1]:
                real = top > LOWEST
                real &= top >= limit[:, None]
                r, _ = np.nonzero(real)
                out.append(pd.DataFrame({"query_id": ids[r], "vec_id": top_id[real], "score": top[real]}))
        kinds = {"query_id": "int64", "vec_id": "int64", "score": "int64"}
        return pd.concat(out).astype(kinds) if out else pd.DataFrame({c: [] for c in kinds}).astype(kinds)

    def partial_order(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Columns of the k largest scores, ties to smaller ids, row by row."""
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        order = np.empty((len(score), k), dtype=np.int64)
        for i in range(len(score)):
            c = np.flatnonzero(score[i] >= edge[i])
            order[i] = c[np.lexsort((ids[i, c], -score[i, c]))[:k]]
        return order

    none = float(LOWEST)

    def own_ring(place, frame):
        frame = frame.sort_values("dist")
        x, ids, dist = matrix(frame["v"].tolist(), "<i8"), frame["vec_id"].to_numpy(), frame["dist"].to_numpy()
        is_query = ids % every == 0
        q_dist = distances(x[is_query], query=True)[:, place[0] // rings]
        return best(x[is_query], ids[is_query], np.full(is_query.sum(), none), x, ids, dist, q_dist)

    result = "query_id long, vec_id long, score long"
    seeds = materialize(keyed.groupBy("ring", "part").applyInPandas(own_ring, result), "seeds")
    bound = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    asked = keyed.where(F.col("vec_id") % every == 0).join(bound, F.col("vec_id") == F.col("query_id"), "left")
    asked = asked.select("vec_id", "ring", "part", "v", F.coalesce(F.col("bound").cast("double"), F.lit(none)).alias("bound"))
    query_blocks = -(-queries // query_block)

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            raw = batch.column(3).to_pylist()
            x = matrix(raw, "<i8")
            d = distances(x, query=True)[:, pivot_of]
            gap = np.maximum(0.0, np.maximum(low[None] - d, d - high[None]) - 1e-6)
            length = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
            bounds = np.array(batch.column(4).to_pylist())
            own = np.array(batch.column(1).to_pylist())
            own_part = np.array(batch.column(2).to_pylist())
            r, c = np.nonzero((length[:, None] + longest - gap * gap) / 2 + 1e-3 >= bounds[:, None])
            copies = np.array([parts[x] for x in labels.tolist()])[c]
            r, c = np.repeat(r, copies), np.repeat(c, copies)
            part = np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)
            other = (labels[c] != own[r]) | (part != own_part[r])
            r, c, part = r[other], c[other], part[other]
            for lo in range(0, len(r), 20000):
                s = slice(lo, lo + 20000)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(r[s])), pa.array(labels[c[s]]), pa.array(part[s].astype(np.int32)),
                        pa.array(d[r[s], c[s]]), batch.column(3).take(pa.array(r[s])), pa.array(bounds[r[s]]),
                    ],
                    names=["vec_id", "ring", "part", "dist", "v", "bound"],
                )

    routed = asked.mapInArrow(route, "vec_id long, ring long, part int, dist double, v binary, bound double")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    searched = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(q, x):
        x = x.sort_values("dist")
        if not len(q) or not len(x):
            return best(np.zeros((0, dim)), np.zeros(0, int), np.zeros(0), np.zeros((0, dim)), np.zeros(0, int), np.zeros(0), np.zeros(0))
        return best(
            matrix(q["v"].tolist(), "<i8"), q["vec_id"].to_numpy(), q["bound"].to_numpy(),
            matrix(x["v"].tolist(), "<i8"), x["vec_id"].to_numpy(), x["dist"].to_numpy(), q["dist"].to_numpy(),
        )

    where = ["ring", "part", "block"]
    more = routed.groupBy(*where).cogroup(searched.groupBy(*where)).applyInPandas(search, result)
    ranked = seeds.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
