"""Exact similarity of term sets by Dice, where families of similar sets may be large.

Sets whose similarity is ``least`` differ in a few terms only. Dealt by hash to one part more than that, two similar sets have a part that is
equal (pigeonhole), whatever the terms' frequencies. Sets that meet at an equal part are tested by size and sketch there, and what passes is not
listed pair by pair: it becomes links enough to join them, and connected sets are a family. Each family is compared whole, in pairs of blocks,
so a set travels once for each block it is compared with instead of once a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.runtime import ship, written
from lorewell.operators.graph import classes

#: Growth of the sizes of one class, sets cut at once, rows of one group of parts, sets whose meetings are one table, sets of one block, and cells of one matrix.
GROWTH, READ, ROWS, FEW, BLOCK, CELLS = 1.6, 1024, 1 << 18, 24, 1024, 1 << 24
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def needed(n: np.ndarray, least: float) -> np.ndarray:
    """Terms that two sets of ``n`` terms together must share to be similar."""
    return np.ceil(n * (least / 2) - 1e-4).astype(np.int64)


def size_classes(least: float, most: int) -> list[tuple[int, int, int]]:
    """(first size, last size, terms in which a set of the class and a similar one that is no smaller differ at most) up to a size of ``most``."""
    ratio = (2 - least) / least
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * GROWTH) - 1)
        sizes = np.arange(low, high + 1)
        other = np.floor(sizes * ratio + 1e-6).astype(np.int64)
        out.append((low, high, int((sizes + other - 2 * needed(sizes + other, least)).max()) + 1))
        low = high + 1
    return out


def bits(high: int) -> int:
    """Of a sketch of sets of ``high`` terms."""
    return int(min(1024, max(64, 1 << int(np.ceil(np.log2(high * 0.45 + 1))))))


def _parts(least: float):
    """(key, h, n, s) of sets (id, terms): for each class of sizes in which a set may meet, a row for each part."""
    ratio = (2 - least) / least

    def cut(terms: list[np.ndarray], h: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.array([len(t) for t in terms])
        for g, (low, high, apart) in enumerate(size_classes(least, int(n.max()))):
            # the smaller of two is of this class
            own = np.flatnonzero((n >= low) & (np.ceil(n / ratio - 1e-6) <= high))
            if not len(own) or apart < 1:
                continue
            parts, width = apart + 1, bits(high)
            sizes = n[own]
            flat = mixed(np.concatenate([terms[i] for i in own]))
            row = np.repeat(np.arange(len(own)), sizes)
            sums = np.zeros(len(own) * parts, np.uint64)
            np.add.at(sums, row * parts + ((flat >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), mixed(flat + MIX))
            key = mixed(sums + np.tile(mixed(np.arange(parts) + (g + 1) * 1_000_003), len(own))).astype(np.int64)
            odd = np.bincount(row * width + (flat % np.uint64(width)).astype(np.int64), minlength=len(own) * width) & 1
            sketch = np.packbits(odd.astype(np.uint8).reshape(len(own), width), axis=1)
            data = np.repeat(sketch, parts, axis=0)
            made = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, data.size + 1, width // 8, dtype=np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(h[own], parts)), pa.array(np.repeat(sizes, parts).astype(np.int32)), made], ["key", "h", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task give their parts once
        for b in batches:
            ends, flat = b.column("terms").offsets.to_numpy(), b.column("terms").values.to_numpy()
            h = b.column("h").to_numpy()
            for a in range(0, b.num_rows, READ):
                new = [i for i in range(a, min(a + READ, b.num_rows)) if ends[i] < ends[i + 1] and not (int(h[i]) in seen or seen.add(int(h[i])))]
                if len(seen) > 1 << 20:
                    seen.clear()
                if new:
                    yield from cut([flat[ends[i] : ends[i + 1]] for i in new], h[new])

    return run


def _passes(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and sketches allow the limit: places that differ are no more than terms that differ, so no similar pair is lost."""
    must = needed(na + nb, least)
    ok = np.minimum(na, nb) >= must
    return ok & (np.bitwise_count(sa ^ sb).sum(axis=-1) <= na + nb - 2 * must)


def _links(least: float):
    """(a, b) of one group of (key, h, n, s): links that connect what meets at a key and passes."""

    def joined(h: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of many sets at one key: one reaches all that pass with it, these go on among what is left."""
        left = np.lexsort((h, n))
        a, b = [], []
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                # what is left is in order of sizes
                lo, hi = np.searchsorted(n[left], [n[x] * (least / (2 - least)) - 1e-6, n[x] * ((2 - least) / least) + 1e-6])
                near = np.arange(lo, min(hi + 1, len(left)))
                near = near[_passes(n[x], n[left[near]], s[x], s[left[near]], least)]
                if len(near):
                    found = left[near]
                    a.append(np.full(len(found), h[x]))
                    b.append(h[found])
                    front.extend(found)
                    left = np.delete(left, near)
        return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])

    def of_width(key: np.ndarray, h: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
        order, key, h = order[once], key[once], h[once]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(starts, append=len(key))
        out = [np.zeros((2, 0), np.int64)]
        for m in range(2, FEW + 1):
            first = starts[counts == m]
            if len(first):
                x, y = np.triu_indices(m, 1)
                for some in np.array_split(first, max(1, len(first) * len(x) * s.shape[1] >> 21)):
                    p, q = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                    good = _passes(n[order[p]], n[order[q]], s[order[p]], s[order[q]], least)
                    out.append(np.array([h[p[good]], h[q[good]]]))
        for at, m in zip(starts[counts > FEW], counts[counts > FEW]):
            own = order[at : at + m]
            out.append(np.array(joined(h[at : at + m], n[own], s[own])))
        return out

    def run(table: pa.Table) -> pa.Table:
        key, h, n = (table.column(c).to_numpy() for c in ("key", "h", "n"))
        n = n.astype(np.int64)
        s = table.column("s").combine_chunks()
        s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
        ends = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1]
        data, length = np.frombuffer(s.buffers()[2], np.uint8), np.diff(ends)
        out = [np.zeros((2, 0), np.int64)]
        for w in np.unique(length):
            at = np.flatnonzero(length == w)
            sketch = data[ends[at][:, None] + np.arange(w)].view(np.uint64)
            out += of_width(key[at], h[at], n[at], sketch)
        a, b = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
        return pa.table({"a": a, "b": b})

    return run


def _compared(least: float):
    """(a, b, score) of one group of (family, i, j, side, id, terms): similar sets of block i and block j of each family."""

    def pairs(x: list[np.ndarray], y: list[np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places and scores of the similar ones of x and y, or of x among themselves."""
        sets = x + (y or [])
        sizes = np.array([len(t) for t in sets])
        terms, place = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(place, minlength=len(terms)) > 1
        line = np.where(shared, np.cumsum(shared) - 1, -1)[place]
        if len(sets) * int(shared.sum()) > CELLS and len(sets) > 2:
            if y is None:
                k = len(x) // 2
                yield from pairs(x[:k], None)
                yield from ((a + k, b + k, s) for a, b, s in pairs(x[k:], None))
                yield from ((a, b + k, s) for a, b, s in pairs(x[:k], x[k:]))
            elif len(x) >= len(y):
                k = len(x) // 2
                yield from pairs(x[:k], y)
                yield from ((a + k, b, s) for a, b, s in pairs(x[k:], y))
            else:
                yield from ((b, a, s) for a, b, s in pairs(y, x))
            return
        m = np.zeros((len(sets), int(shared.sum())), np.float32)
        m[np.repeat(np.arange(len(sets)), sizes)[line >= 0], line[line >= 0]] = 1
        both = m[: len(x)] @ (m if y is None else m[len(x) :]).T
        score = both * 2.0 / (sizes[: len(x), None] + (sizes if y is None else sizes[len(x) :]))
        a, b = np.nonzero(score >= least - 1e-6)
        if y is None:
            a, b = a[a < b], b[a < b]
        yield a, b, both[a, b].astype(np.float64) * 2.0 / (sizes[a] + sizes[b if y is None else b + len(x)])

    def run(table: pa.Table) -> pa.Table:
        family, i, j, side = (table.column(c).to_numpy() for c in ("family", "i", "j", "side"))
        ids = table.column("id").combine_chunks()
        lists = table.column("terms").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.lexsort((side, j, i, family))
        cuts = np.flatnonzero((np.diff(family[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        a, b, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows in np.split(order, cuts):
            if not len(rows):
                continue
            sets = [flat[ends[r] : ends[r + 1]] for r in rows]
            k = len(rows) if i[rows[0]] == j[rows[0]] else int((side[rows] == 0).sum())
            if k and (k < len(rows) or len(rows) > 1) and (k == len(rows)) == (i[rows[0]] == j[rows[0]]):
                other = None if k == len(rows) else sets[k:]
                for p, q, s in pairs(sets[:k], other):
                    a.append(rows[p])
                    b.append(rows[q if other is None else q + k])
                    scores.append(s)
        take = lambda at: ids.take(pa.array(np.concatenate(at)))
        return pa.table({"a": take(a), "b": take(b), "score": pa.array(np.concatenate(scores))})

    return run


def similar_notes(hashes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of (id, terms as sorted hashes): members (id, class) where a class is the smallest id with the same set, and pairs (a, b, score) of classes."""
    spark = hashes.sparkSession
    ship(spark)
    # 128 bits tell sets apart, 64 of them link what may be similar
    hashes = written(hashes.select("id", "terms", F.size("terms").alias("n"), F.xxhash64("terms").alias("h"), F.xxhash64(F.lit("other"), "terms").alias("_h")))
    members = written(hashes.select("id", "n", "h", "_h").join(hashes.groupBy("h", "_h").agg(F.min("id").alias("class")), ["h", "_h"]).select("id", "class", "h", "n"))
    parts = hashes.select("h", "terms").mapInArrow(_parts(least), "key bigint, h bigint, n int, s binary")
    groups = max(1, int(members.agg(F.sum(F.col("n") * 0.35 + 2)).first()[0] or 0) // ROWS)
    links = parts.groupBy(F.pmod("key", F.lit(groups)).alias("_g")).applyInArrow(lambda t: _links(least)(t), "a bigint, b bigint")
    found = classes(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("h", "family")
    own = members.where("id = class").join(found, "h").select("id", "n", "family")
    place = W.partitionBy("family").orderBy("n", "id")
    own = written(own.withColumn("_k", F.floor((F.row_number().over(place) - 1) / BLOCK).cast("int")))
    blocks = own.groupBy("family").agg((F.max("_k") + 1).alias("_n"), F.count("*").alias("_c"))
    own = own.join(blocks.where("_c > 1"), "family")
    both = lambda k, n: F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(k, o).alias("i"), F.greatest(k, o).alias("j"), (k > o).cast("int").alias("side")))
    met = own.join(hashes.select("id", "terms"), "id").select("family", "id", "terms", F.explode(both(F.col("_k"), F.col("_n"))).alias("p")).select("family", "p.*", "id", "terms")
    some = max(1, own.count() // (2 * BLOCK))
    deal = F.pmod(F.xxhash64("family", "i", "j"), F.lit(some))
    pairs = met.groupBy(deal.alias("_g")).applyInArrow(lambda t: _compared(least)(t), "a string, b string, score double")
    return members.select("id", "class"), pairs.where(F.round("score", 9) >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
