"""Exact Jaccard join of word-shingle sets: size-banded tiles, hashed bitmap bounds, sorted-array intersection.

Sets with Jaccard similarity of at least 4/5 differ in at most (|x| + |y|) / 9 elements.

1. ``sets``: one pass turns every whole text into its set of 64-bit shingle hashes and keeps a
   digest of the set, its size and a parity bitmap (bit i: parity of the elements hashed to i).
   Documents with equal sets are one class from here on.
2. Sizes fall into bands a quarter apart, so linked sets are in one band or in neighbours.  In a
   band's tile space the hash range is cut into more parts than linked sets can differ by, so at
   least one part that is not empty holds the same elements in both.  Each part's content,
   hashed, is the key of a tile.  Keys are packed into byte blocks by hash bucket before the
   shuffle and sorted there; no key is rare or frequent enough to need a case of its own.
3. The first round compares the smallest class of each tile with all others of the tile, the
   second each class with those closest to it by bit counts, the third whatever classes of a
   tile are not yet connected; tiles of many classes are cut into pairs of chunks.  Sizes and
   the bitmaps' bit counts bound the overlap from above; what passes is intersected exactly.  Only
   spanning links matter to the classes, so pairs that are connected already are never made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, materialize, per_process, release, segments, trim

SHINGLE = 5
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a byte array at once.

    A word's hash mixes two polynomials in its bytes, each byte first replaced by a random
    64-bit value.  A-Z count as a-z.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, (2, 256), np.uint64)
        self.values[:, 65:91] = self.values[:, 97:123]
        self.base = rng.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones((2, 1), np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.factor = rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every word; rows are given by their byte ranges."""
        gap = self.space[data]
        letters = data[~gap]
        if not len(letters):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin = ~gap
        begin[1:] &= gap[:-1]
        edge = starts[(starts < ends) & (starts < len(data))]
        begin[edge] = ~gap[edge]  # a row's first word begins there even if the row before ends in a word
        at = np.flatnonzero(begin)
        inner = np.cumsum(~gap)[at] - 1  # where words begin among the letters
        size = np.diff(np.append(inner, len(letters)))
        if (longest := int(size.max())) > self.powers.shape[1]:
            steps = np.repeat(self.base[:, None], 2 * longest, axis=1)
            steps[:, 0] = 1
            self.powers = np.cumprod(steps, axis=1, dtype=np.uint64)
        place = np.arange(len(letters)) - np.repeat(inner, size)
        one, two = (np.add.reduceat(v[letters] * p[place], inner) for v, p in zip(self.values, self.powers))
        return mixed(mixed(one) + two + size.astype(np.uint64)), np.searchsorted(ends, at, side="right")

    def sets(self, column):
        """Sorted distinct shingle hashes of every row of an Arrow string column, row by row."""
        for first, last, data, starts, ends in segments(column, 1 << 19):
            h, row = self.words(data, starts, ends)
            count = np.bincount(row, minlength=last - first)
            begin = np.cumsum(count) - count
            n = len(h) - SHINGLE + 1
            if n > 0:
                s = np.zeros(n, np.uint64)
                for k, f in enumerate(self.factor):
                    s += h[k : k + n] * f
                s = mixed(s)
            for b, m in zip(begin.tolist(), count.tolist()):
                if m >= SHINGLE:
                    own = np.sort(s[b : b + m - SHINGLE + 1])
                    yield own[np.concatenate(([True], own[1:] != own[:-1]))]
                elif m:
                    yield mixed((h[b : b + m] * self.factor[:m]).sum(keepdims=True) + np.uint64(m))
                else:
                    yield np.zeros(0, np.uint64)


# ------------------------------------------------------------------ bands and parts


def bands(longest: int) -> list[int]:
    """Band borders: each at least a quarter above the one before."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return out


def parts_of(border: list[int], t: int) -> tuple[int, int]:
    """(parts, spare) of tile space ``t``: linked sets there differ by fewer than parts - spare elements."""
    small = border[t + 1] - 1
    differ = (small + small * 5 // 4) // 9
    spare = (differ + 1) // 10 + 3
    return differ + 1 + spare, spare


def keys_of(h: np.ndarray, border: list[int]) -> np.ndarray:
    """Tile keys of a sorted set: one for each part that is not empty, in its own tile space and the one below."""
    n = len(h)
    own = int(np.searchsorted(border, n, side="right")) - 1
    spaces = [own]
    if own and n * 4 <= (border[own] - 1) * 5:
        spaces.append(own - 1)
    out = []
    content = mixed(h ^ STEP)
    for t in spaces:
        parts, spare = parts_of(border, t)
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        name = part[start] * np.uint64(4096) + np.uint64(2 * t)
        out.append(mixed(np.add.reduceat(content, start) ^ mixed(name)))
        if parts - len(start) > spare:
            # so many empty parts that linked sets may agree on empty ones only; both then come here,
            # where the smallest fifth of their elements, in hash order, must share one
            prefix = h[: n - -(-n * 4 // 5) + 1]
            out.append(mixed(prefix ^ mixed(np.full(len(prefix), 2 * t + 1, np.uint64))))
    return np.concatenate(out)


def digest_of(h: np.ndarray) -> int:
    """Signed 64-bit digest of a sorted set."""
    import xxhash

    d = xxhash.xxh3_64_intdigest(h.tobytes())
    return d - (1 << 64) if d >> 63 else d


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the elements hashed to each bit; about one bit for each element, a power of two from 512."""
    bits = 512
    while bits < len(h):
        bits *= 2
    odd = np.bincount((mixed(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return x


def linked(n1, n2, overlap):
    """100 * overlap >= 80 * union."""
    return 5 * overlap >= 4 * (n1 + n2 - overlap)


def may_link(n1: int, b1: np.ndarray, n2: int, b2: np.ndarray) -> bool:
    """Upper bound: elements that differ are at least the bits that differ."""
    if not linked(n1, n2, min(n1, n2)):
        return False
    size = min(len(b1), len(b2))
    differ = int(np.bitwise_count(fold(b1, size) ^ fold(b2, size)).sum())
    return bool(linked(n1, n2, (n1 + n2 - differ) // 2))


# ------------------------------------------------------------------------- stages


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, cid, bits): hash of the text; size, digest and parity bitmap of every document's set; null digest if empty."""

    def run(batches):
        import pyarrow as pa

        hasher = per_process("shingles", WordHasher)
        for batch in batches:
            n, cid, bits = [], [], []
            for h in hasher.sets(batch.column(2)):
                n.append(len(h))
                cid.append(digest_of(h) if len(h) else None)
                bits.append(bitmap(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "row", "n", "cid", "bits"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n long, cid long, bits binary")


def tiles(docs: DataFrame, border: list[int], buckets: int, flush: int = 1 << 19) -> DataFrame:
    """(cids): byte lists of the classes that share a tile key, two at least, each list once in a bucket."""

    def emit(batches):
        import pyarrow as pa

        hasher = per_process("shingles", WordHasher)

        def blocks(keys, cids):
            k = np.concatenate(keys)
            c = np.repeat(np.array([x for x, _ in cids], np.int64), [m for _, m in cids])
            at = (k % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((c, k, at))
            k, c, at = k[order], c[order], at[order]
            keep = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            k, c, at = k[keep], c[keep], at[keep]
            ends = np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True]))) + 1
            starts = np.concatenate(([0], ends[:-1]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(at[starts]),
                    pa.array([k[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["bucket", "keys", "cids"],
            )

        keys, cids, held = [], [], 0
        for batch in batches:
            for h in hasher.sets(batch.column(0)):
                if len(h):
                    k = keys_of(h, border)
                    keys.append(k)
                    cids.append((digest_of(h), len(k)))
                    held += len(k)
                    if held >= flush:
                        yield blocks(keys, cids)
                        keys, cids, held = [], [], 0
        if keys:
            yield blocks(keys, cids)
        keys, cids = [], []
        trim()

    def meet(frame):
        import pandas as pd

        k = np.frombuffer(b"".join(frame["keys"]), np.uint64)
        c = np.frombuffer(b"".join(frame["cids"]), np.int64)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        keep = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        k, c = k[keep], c[keep]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        ends = np.append(starts[1:], len(k))
        big = ends - starts > 1
        return pd.DataFrame({"cids": list(dict.fromkeys(c[a:b].tobytes() for a, b in zip(starts[big], ends[big])))})

    packed = docs.select("text").mapInArrow(emit, "bucket long, keys binary, cids binary")
    return packed.groupBy("bucket").applyInPandas(meet, "cids binary")


def star_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): the smallest class of each tile with every other, once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = []
            for x in batch.column(0):
                c = np.frombuffer(x.as_py(), np.int64)
                pairs.append(np.stack([np.repeat(c[:1], len(c) - 1), c[1:]], axis=1))
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            for lo in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + (1 << 16), k].copy()) for k in (0, 1)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def open_rows(groups: DataFrame, label: DataFrame, meta: DataFrame, chunk: int = 2048) -> DataFrame:
    """(tile, cid, label, n, bits): members of the tiles whose classes are not all connected yet."""

    def members(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            tile, cid = [], []
            for x in batch.column(0):
                raw = x.as_py()
                c = np.frombuffer(raw, np.int64)
                if len(c) < 3:
                    continue  # a pair was compared in the first round
                name = int.from_bytes(hashlib.blake2b(raw, digest_size=7).digest(), "little")
                count = -(-len(c) // chunk)
                for i in range(count):
                    for j in range(i, count):  # every pair of chunks is a tile of its own
                        own = c[i * chunk : (i + 1) * chunk] if i == j else np.concatenate((c[i * chunk : (i + 1) * chunk], c[j * chunk : (j + 1) * chunk]))
                        tile.append(np.full(len(own), name ^ (i * count + j if count > 1 else 0), np.int64))
                        cid.append(own)
            if tile:
                tile, cid = np.concatenate(tile), np.concatenate(cid)
                for lo in range(0, len(tile), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(tile[lo : lo + (1 << 16)]), pa.array(cid[lo : lo + (1 << 16)])], names=["tile", "cid"])

    rows = groups.mapInArrow(members, "tile long, cid long").distinct()
    rows = rows.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    open_tiles = rows.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("tile")
    return materialize(rows.join(open_tiles, "tile", "left_semi").join(meta, "cid").select("tile", "cid", "label", "n", "bits"), "open")


def candidates(rows: DataFrame, nearest: int | None, buckets: int, room: int = 1 << 22) -> DataFrame:
    """(a, b): pairs of a tile's classes under different labels that sizes and bit counts allow.

    With ``nearest``, each class only with so many others, those of fewest differing bits.
    Tiles come in buckets, and all tiles of a bucket are compared at once: row i with row i + d
    for d = 1, 2, ... as long as both are in one tile.
    """

    def compare(frame):
        import pandas as pd

        frame = frame.sort_values(["tile", "n", "cid"])
        tile, cid, label, n = (frame[c].to_numpy() for c in ("tile", "cid", "label", "n"))
        maps = [np.frombuffer(b, np.uint8) for b in frame["bits"]]
        low = np.stack([fold(m, 64) for m in maps]).view(np.uint64)
        wide = np.array([len(m) > 64 for m in maps])
        found, held = [], 0

        def flush():
            i, j, differ = (np.concatenate(x) for x in zip(*found))
            found.clear()
            both_wide = np.flatnonzero(wide[i] & wide[j])
            ok = np.ones(len(i), bool)
            for k in both_wide.tolist():
                ok[k] = may_link(n[i[k]], maps[i[k]], n[j[k]], maps[j[k]])
            i, j, differ = i[ok], j[ok], differ[ok]
            if nearest is not None:
                who, other, gap = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((differ, differ))
                order = np.lexsort((other, gap, who))
                who, other = who[order], other[order]
                first = np.searchsorted(who, who, side="left")
                keep = np.arange(len(who)) - first < nearest
                i, j = who[keep], other[keep]
            pairs = np.unique(np.stack((np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])), axis=1), axis=0)
            return pairs

        out = []
        at, d = np.arange(len(tile) - 1), 1
        while len(at):
            at = at[at + d < len(tile)]
            at = at[tile[at] == tile[at + d]]
            at = at[n[at + d] * 4 <= n[at] * 5]  # sizes rise inside a tile
            for lo in range(0, len(at), 1 << 18):
                i = at[lo : lo + (1 << 18)]
                j = i + d
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                differ = np.bitwise_count(low[i] ^ low[j]).sum(axis=1, dtype=np.int64)
                ok = linked(n[i], n[j], (n[i] + n[j] - differ) // 2)
                if ok.any():
                    found.append((i[ok], j[ok], differ[ok]))
                    held += int(ok.sum())
                    if held >= room:
                        out.append(flush())
                        held = 0
            d += 1
        if found:
            out.append(flush())
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, meta: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The pairs whose sets are linked, by bounds first and exact intersection of sorted arrays then."""

    def bounded(batches):
        import pyarrow as pa

        for batch in batches:
            cols = batch.to_pydict()
            keep = [
                may_link(n1, np.frombuffer(b1, np.uint8), n2, np.frombuffer(b2, np.uint8))
                for n1, b1, n2, b2 in zip(cols["n1"], cols["b1"], cols["n2"], cols["b2"])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    one = meta.select(F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    two = meta.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    close = pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "b1", "n2", "b2")
    close = materialize(close.mapInArrow(bounded, "a long, b long"), "pairs", small=True)
    needed = close.select(F.col("a").alias("cid")).union(close.select("b")).distinct().join(meta, "cid").select("cid", F.col("place.doc_id").alias("d"), F.col("place.row").alias("r"))
    needed = materialize(needed, "needed", small=True)
    # few documents take part as a rule; beyond that the texts are shuffled instead
    side = F.broadcast(needed) if needed.count() <= broadcast_rows else needed
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    texts = texts.join(side, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("cid", "text")

    def arrays(batches):
        import pyarrow as pa

        hasher = per_process("shingles", WordHasher)
        for batch in batches:
            cids, sets = [], []
            for c, h in zip(batch.column(0).to_pylist(), hasher.sets(batch.column(1))):
                if len(h) and digest_of(h) == c:
                    cids.append(c), sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "h"])

    # one row a class before the joins, which can then split a class of many pairs
    whole = materialize(texts.mapInArrow(arrays, "cid long, h binary").groupBy("cid").agg(F.first("h").alias("h")), "arrays")

    def intersect(batches):
        import pyarrow as pa

        for batch in batches:
            keep, last, x = [], None, None
            for a, h1, h2 in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, x = a, np.frombuffer(h1.as_py(), np.uint64)
                y = np.frombuffer(h2.as_py(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                keep.append(bool(linked(len(x), len(y), int((x[at] == y).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    both = close.join(whole.select(F.col("cid").alias("b"), F.col("h").alias("h2")), "b").join(whole.select(F.col("cid").alias("a"), F.col("h").alias("h1")), "a")
    found = materialize(both.select("a", "b", "h1", "h2").mapInArrow(intersect, "a long, b long"), "verified", small=True)
    drop_written(whole)
    return found


def jaccard_components(docs: DataFrame, bucket_bytes: int = 1 << 25) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when 100 * intersection >= 80 * union of their sets of 5-word shingles; the
    component id is the smallest doc_id reachable by links.  Cases: a null or empty text, or
    one without words, has an empty set and links with nothing; fewer than five words are one
    shingle; repeated rows have equal sets and so link; a null doc_id links like any other and takes
    its component's smallest doc_id, which is null if there is none; an empty table gives no rows;
    other columns are ignored.  Sets are told apart by 64-bit hashes of shingles and of whole sets.
    """
    sets = materialize(set_table(docs), "sets")
    classes = sets.where("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "row")).alias("place"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    meta = materialize(classes, "classes")
    longest, total = sets.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    border = bands(longest)
    buckets = max(64, -(-total * 10 // bucket_bytes))
    groups = materialize(tiles(docs, border, buckets), "tiles")
    release(docs.sparkSession)
    label = components(verified(star_pairs(groups), docs, meta))
    for nearest in (2, None):  # the closest by bit counts connect most of what is left; then whatever remains
        rows = open_rows(groups, label.select(F.col("id").alias("cid"), F.col("component_id").alias("label")), meta)
        count = rows.count()
        if count:
            more = verified(candidates(rows, nearest, max(64, count // 20_000)), docs, meta)
            label = components(label.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more))
        drop_written(rows)
    drop_written(groups)
    named = meta.select("cid", "rep").join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("component_id", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.select("cid", "label").join(least, "label").select("cid", "component_id")
    return sets.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
