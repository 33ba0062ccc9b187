"""Problem 1: near-duplicate records by anchor-point covering.

Each record's set of words gets short binary fingerprints. The 4096 words of the binary
Golay code, which covers all 23-bit strings within radius 3, are the anchors: a
fingerprint goes to every anchor within the covering radius plus a threshold, fingerprints
are compared anchor by anchor, and what remains is checked on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .canonical import form_query

BITS, CHECKS, COVERING = 23, 11, 3  # of the Golay code
GENERATOR = 0b101011100011
BLOCKS = 5  # fingerprints of a record
BANDS = (1, 5, 20, 80, 320, 1280, 5120, 20480, 81920)  # least numbers of words; each band has its own density of bits
LOW = (1 << 64) - 1
SIZE_BITS = 12


class Golay:
    """The anchors, and for each string those within ``radius`` of it."""

    def __init__(self, radius: int):
        parity = np.zeros(4096, dtype=np.int64)
        for message in range(4096):
            rest = message << CHECKS
            for shift in range(BITS - 1, CHECKS - 1, -1):
                if rest >> shift & 1:
                    rest ^= GENERATOR << (shift - CHECKS)
            parity[message] = rest
        self.parity = parity
        flips: list[list[int]] = [[] for _ in range(1 << CHECKS)]
        for weight in range(radius + 1):
            for places in combinations(range(BITS), weight):
                e = sum(1 << p for p in places)
                flips[int(parity[e >> CHECKS]) ^ (e & ((1 << CHECKS) - 1))].append(e)
        self.most = max(map(len, flips))
        self.flips = np.full((1 << CHECKS, self.most), -1, dtype=np.int64)
        for row, f in zip(self.flips, flips):
            row[: len(f)] = f

    def near(self, x: np.ndarray) -> np.ndarray:
        """For each string the numbers of the anchors near it, -1 where there are fewer."""
        flips = self.flips[self.parity[x >> CHECKS] ^ (x & ((1 << CHECKS) - 1))]
        return np.where(flips < 0, -1, (x[:, None] ^ flips) >> CHECKS)


class Letters(dict):
    """Translation of single characters for the matching form: fold, drop, or part words."""

    def __init__(self):
        super().__init__()
        for first, last in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED), (0x8D3, 0x8FF), (0x640, 0x640), (0x621, 0x621)):
            self.update(dict.fromkeys(range(first, last + 1)))
        self.update({0x6E7: "ي", 0x649: "ي", 0x629: "ه", 0x624: "و", 0x626: "ي"})
        self.update(dict.fromkeys((0x622, 0x623, 0x625, 0x671, 0x672, 0x673, 0x675), "ا"))

    def __missing__(self, code: int) -> str:
        self[code] = to = chr(code) if 0x622 <= code <= 0x64A else " "
        return to


def words_of(form: str, letters: Letters) -> set[str]:
    """Distinct words of a text in its problem-3 form."""
    return set(form.replace("ﷺ", " صلى الله عليه وسلم ").replace("وٰ", "ا").translate(letters).split())


class Fingerprints:
    """Fingerprints of sets of words: bit i is on where some word draws it.

    The chance of a draw is set by the band of the set's size, so that about half of the
    bits are on; sets that differ in few words then differ in few bits. A set near the
    upper end of its band also gets the fingerprint of the next band, for partners there.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.masks: dict[tuple[int, str], int] = {}

    def mask(self, band: int, word: str) -> int:
        import xxhash

        key = (band, word)
        if key not in self.masks:
            if len(self.masks) > 1_000_000:
                self.masks.clear()
            chance = math.log(2) / (2 * BANDS[band])
            draws = math.ceil(BITS * chance)
            out = 0
            for block in range(BLOCKS):
                for draw in range(draws):
                    h = xxhash.xxh64_intdigest(word.encode(), seed=block * 64 + draw + 1)
                    place = (h >> 11) * round(draws / chance * 4096) // (1 << 53) >> 12
                    if place < BITS:
                        out |= 1 << (block * BITS + place)
            self.masks[key] = out
        return self.masks[key]

    def of(self, words: set[str]) -> tuple[int, int, int | None]:
        """(band, fingerprints there, fingerprints in the next band or None)."""
        n = len(words)
        band = max(i for i, least in enumerate(BANDS) if n >= least)
        own = reduce(or_, (self.mask(band, w) for w in words))
        up = None
        if band + 1 < len(BANDS) and n >= self.similarity * BANDS[band + 1]:
            up = reduce(or_, (self.mask(band + 1, w) for w in words))
        return band, own, up


def allowed_bits(similarity: float, deviations: float = 4.0) -> int:
    """Bits of all blocks in which fingerprints of sets of that similarity may differ: the mean and so many deviations.

    The chance that a bit differs is taken where it is largest, over sizes within a band.
    """
    worst = 0.0
    for size in np.linspace(1.0, 4.0, 31):  # in units of the band's least size
        rate = math.log(2) / 2 * size
        union = 2 / (1 + similarity)  # of two sets of size 1
        one_sided = math.exp(-rate * (1 - similarity) / 2 * union)
        worst = max(worst, 2 * math.exp(-rate * similarity * union) * (1 - one_sided) * one_sided)
    n = BITS * BLOCKS
    return math.ceil(n * worst + deviations * math.sqrt(n * worst * (1 - worst)))


def pack(fingerprints: int, n: int, raised: bool) -> tuple[int, int]:
    """Five fingerprints, the set's size (as far as it fits) and whether it is a raised one, in two signed longs."""
    whole = fingerprints | min(n, (1 << SIZE_BITS) - 1) << (BLOCKS * BITS) | raised << (BLOCKS * BITS + SIZE_BITS)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (whole & LOW, whole >> 64))


def block_of(s1: np.ndarray, s2: np.ndarray, block: int) -> np.ndarray:
    """The block's 23 bits of packed fingerprints (unsigned arrays)."""
    at = block * BITS
    if at + BITS <= 64:
        x = s1 >> np.uint64(at)
    elif at >= 64:
        x = s2 >> np.uint64(at - 64)
    else:
        x = (s1 >> np.uint64(at)) | (s2 << np.uint64(64 - at))
    return (x & np.uint64((1 << BITS) - 1)).astype(np.int64)


def sketch(records: DataFrame, similarity: float) -> DataFrame:
    """(rec, c1, c2, n, band, s1, s2, u1, u2, words) of each record (rec, x) with any word.

    c1, c2: 128-bit hash of the set. words: 64-bit hashes of its words.
    """
    schema = "rec long, c1 long, c2 long, n int, band int, s1 long, s2 long, u1 long, u2 long, words array<long>"
    query = f"SELECT f FROM ({form_query('batch', 'x')})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import xxhash

        con = duckdb.connect(config={"threads": 1})
        letters, prints, short = Letters(), Fingerprints(similarity), {}
        for b in batches:
            con.register("batch", pa.table({"x": b.column("x").cast(pa.string())}))
            forms = con.sql(query).to_arrow_table().column("f").to_pylist()
            con.unregister("batch")
            out, words_out = [], []
            for rec, form in zip(b.column("rec").to_pylist(), forms):
                words = words_of(form, letters)
                if not words:
                    continue
                hashes = []
                for w in words:
                    h = short.get(w)
                    if h is None:
                        if len(short) > 1_000_000:
                            short.clear()
                        short[w] = h = xxhash.xxh64_intdigest(w.encode()) - (1 << 63)
                    hashes.append(h)
                whole = xxhash.xxh128_intdigest(" ".join(sorted(words)).encode())
                band, own, up = prints.of(words)
                u = pack(up, len(words), True) if up is not None else (None, None)
                c = (whole & LOW) - (1 << 63), (whole >> 64) - (1 << 63)
                out.append((rec, *c, len(words), band, *pack(own, len(words), False), *u))
                words_out.append(hashes)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 4
            cols = [pa.array(col, k) for col, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            cols.append(pa.array(words_out, pa.list_(pa.int64())))
            names = ["rec", "c1", "c2", "n", "band", "s1", "s2", "u1", "u2", "words"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return records.mapInArrow(run, schema)


def _unsigned(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def at_anchors(sets: DataFrame, radius: int, hot: dict[int, int]) -> DataFrame:
    """(at, id, s1, s2): each fingerprint at every anchor within ``radius``.

    ``at`` packs band, block and anchor; an anchor in ``hot`` is cut into that many
    chunks by id, and a fingerprint goes to each pair of chunks that its own is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay(radius)
        keys = np.array(sorted(hot), dtype=np.int64)
        chunks = np.array([hot[k] for k in keys.tolist()], dtype=np.int64)
        for b in batches:
            ids = b.column("id").to_numpy()
            band = b.column("band").to_numpy().astype(np.int64)
            own = _unsigned(b.column("s1")), _unsigned(b.column("s2"))
            has = b.column("u1").is_valid().to_numpy(zero_copy_only=False)
            up = (_unsigned(b.column("u1").fill_null(0)), _unsigned(b.column("u2").fill_null(0)))
            for s1, s2, i, g in ((*own, ids, band), (up[0][has], up[1][has], ids[has], band[has] + 1)):
                for block in range(BLOCKS):
                    near = code.near(block_of(s1, s2, block))
                    row, col = np.nonzero(near >= 0)
                    at = (g[row] * 8 + block) << 12 | near[row, col]
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                        c = np.where(keys[place] == at, chunks[place], 1)
                        times = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                        row, at, c = np.repeat(row, c), np.repeat(at, c), np.repeat(c, c)
                        mine = chunk_of(i[row], c)
                        at = at | np.minimum(mine, times) << 24 | np.maximum(mine, times) << 40
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (at, i[row], s1[row].view(np.int64), s2[row].view(np.int64))],
                        names=["at", "id", "s1", "s2"],
                    )

    return sets.select("id", "band", "s1", "s2", "u1", "u2").mapInArrow(run, "at long, id long, s1 long, s2 long")


def chunk_of(ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % chunks.astype(np.uint64)).astype(np.int64)


def compare(rows: DataFrame, radius: int, most_bits: int, similarity: float, hot: dict[int, int]) -> DataFrame:
    """(a, b), a < b: pairs that meet at an anchor and whose fingerprints differ in ``most_bits`` at most.

    A pair is given once, at the first anchor of the first block where it meets.
    """

    def pairs_at(at: int, i: np.ndarray, s1: np.ndarray, s2: np.ndarray, code: Golay):
        key = at & 0xFFFFFF
        block = key >> 12 & 7
        left = right = np.arange(len(i))
        if key in hot:
            mine = chunk_of(i, np.full(len(i), hot[key]))
            left, right = np.flatnonzero(mine == at >> 24 & 0xFFFF), np.flatnonzero(mine == at >> 40 & 0xFFFF)
        same = key not in hot or (at >> 24 & 0xFFFF) == at >> 40 & 0xFFFF
        top = np.uint64((1 << (BLOCKS * BITS - 64)) - 1)
        size = (s2 >> np.uint64(BLOCKS * BITS - 64) & np.uint64((1 << SIZE_BITS) - 1)).astype(np.int64)
        raised = (s2 >> np.uint64(BLOCKS * BITS - 64 + SIZE_BITS) & np.uint64(1)).astype(bool)
        step = max(1, 2_000_000 // max(1, len(right)))
        for start in range(0, len(left), step):
            l = left[start : start + step]
            r = right[start:] if same else right  # the triangle: both sides are the same list
            d = np.bitwise_count(s1[l][:, None] ^ s1[r][None, :])
            d += np.bitwise_count((s2[l][:, None] ^ s2[r][None, :]) & top)
            x, y = np.nonzero(d <= most_bits)
            if same:
                x, y = x[y > x], y[y > x]
            p, q = l[x], r[y]
            ok = np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q]) - 1e-9
            ok &= (i[p] != i[q]) & ~(raised[p] & raised[q])
            p, q = p[ok], q[ok]
            if len(p):
                first = np.ones(len(p), dtype=bool)
                for other in range(block + 1):
                    na, nb = (code.near(block_of(s1[k], s2[k], other)) for k in (p, q))
                    shared = (na[:, :, None] == nb[:, None, :]) & (na >= 0)[:, :, None]
                    if other < block:
                        first &= ~shared.any(axis=(1, 2))
                    else:
                        met = np.where(shared.any(axis=2), na, 1 << 12).min(axis=1)
                        first &= met == key & 0xFFF
                p, q = p[first], q[first]
                yield np.minimum(i[p], i[q]), np.maximum(i[p], i[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay(radius)
        held: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]], last: bool):
            at, i, s1, s2 = (np.concatenate(x) for x in zip(*parts))
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[starts[1:], len(at)]
            found = []
            for s, e in zip(starts[: None if last else -1], ends):
                if e - s > 1:
                    found += pairs_at(int(at[s]), i[s:e], s1[s:e].view(np.uint64), s2[s:e].view(np.uint64), code)
            rest = [] if last else [[x[starts[-1] :] for x in (at, i, s1, s2)]]
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            return rest, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in ("at", "id", "s1", "s2")])
                held, out = flush(held, False)
                yield out
        if held:
            yield flush(held, True)[1]

    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, "a long, b long")


def similar_pairs(
    records: DataFrame, rec_id: str = "rec_id", text: str = "text", similarity: float = 0.7,
    threshold: int = 1, most_bits: int | None = None, hot_rows: int = 20_000,
) -> DataFrame:
    """Pairs (rec_a, rec_b), rec_a < rec_b, of records that share at least ``similarity`` of their distinct words.

    Words are those of the problem-3 form after SURVEY N1. Null texts, and texts without
    an Arabic letter, match nothing; equal sets always match. Records of equal sets are one
    class; classes are compared, and pairs of classes expanded to their records. Records are
    not extended transitively. ``threshold`` is what is added to the covering radius;
    ``most_bits`` of the 115 may differ, by default ``allowed_bits``. Anchors of over ``hot_rows`` fingerprints are cut
    into chunks that meet pairwise, so no task holds more than two chunks.
    """
    slim = records.select(F.col(rec_id).cast("long").alias("rec"), F.col(text).alias("x")).where("x IS NOT NULL")
    base = cut(sketch(slim, similarity))
    one = F.struct("rec", "n", "band", "s1", "s2", "u1", "u2")
    classes = base.groupBy("c1", "c2").agg(F.min(one).alias("one"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select("c1", "c2", "copies", F.col("one.rec").alias("id"), "one.*").drop("rec"))
    radius = COVERING + threshold
    most_bits = allowed_bits(similarity) if most_bits is None else most_bits
    # at most 4096 anchors x blocks x bands have a count at all
    crowded = at_anchors(classes, radius, {}).groupBy("at").count().where(F.col("count") > hot_rows).collect()
    hot = {r["at"]: math.ceil(r["count"] / hot_rows) for r in crowded}
    near = compare(at_anchors(classes, radius, hot), radius, most_bits, similarity, hot)
    near = cut(near)
    asked = near.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    words = base.select("rec", "words").join(asked, "rec", "left_semi")
    left, right = words.toDF("a", "wa"), words.toDF("b", "wb")
    both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    union = F.size("wa") + F.size("wb") - F.col("common")
    links = both.where(F.col("common") >= similarity * union - 1e-9).select("a", "b")
    links = links.unionByName(classes.where("copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b")))
    members = base.select("rec", "c1", "c2").join(classes.select("c1", "c2", "id"), ["c1", "c2"]).select("id", "rec")
    full = links.join(members.toDF("a", "one"), "a").join(members.toDF("b", "two"), "b")
    full = full.where((F.col("a") != F.col("b")) | (F.col("one") < F.col("two")))
    return full.select(F.least("one", "two").alias("rec_a"), F.greatest("one", "two").alias("rec_b"))
