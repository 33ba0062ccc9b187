"""Problem 2: most similar vectors by vantage-point trees.

A node of a tree has many vantage points; a vector belongs to the nearest of them. By the
triangle inequality a vector nearer to point h than to point s is at least as far from all
that belongs to s as from the plane halfway between both. A routing tree, fitted on a
bounded sample, assigns every vector a shard and sends it as a query to the shards that
this bound cannot rule out; each shard has a tree of its own, which is searched nearest
cell first until the k-th distance rules out the rest. The bound is relaxed by a factor;
factor one restores exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

DIM = 64
SAMPLE = 20_000  # vectors that the routing tree is fitted on, at most
SHARD = 20_000  # vectors of a shard, where there are enough shards to keep the cores busy
LEAST_SHARD = 1_000
FANOUT = 256  # vantage points of a node, at most
CELL = 64  # vectors of a cell in a shard's tree
FIT = 16  # sampled vectors a vantage point, at least
SLACK = 1e-4  # more than a cosine of rounded unit vectors can be off
BLOCK = 2**18  # pairs that are scored exactly at once


def distance(cos: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors, a metric."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def vantage_points(unit: np.ndarray, wanted: int, draw: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """At most so many points that spread over ``unit``: drawn rows, moved to the middle of what is nearest to them."""
    points = np.unique(unit[draw.choice(len(unit), min(wanted, len(unit)), replace=False)], axis=0)
    for _ in range(rounds):
        sums = np.zeros_like(points)
        np.add.at(sums, (unit @ points.T).argmax(axis=1), unit)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        points = (sums / np.maximum(norms, 1e-9))[norms[:, 0] > 1e-9]
    return points


class Node:
    """Vantage points with what belongs to each: nodes or numbers of leaves."""

    def __init__(self, points: np.ndarray):
        self.points, self.children = points, []
        gaps = distance(points @ points.T)
        self.gaps = np.where(gaps > 1e-6, gaps, 1e-6).astype(np.float32)

    def borders(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, margins): the nearest point of each row, and how far the row is at least from what belongs to each point."""
        cos = unit @ self.points.T
        home = cos.argmax(axis=1)
        return home, (cos[np.arange(len(cos)), home][:, None] - cos) / self.gaps[home]


class Routes:
    """The routing tree: nodes split until a leaf stands for about ``rows`` of ``n`` vectors, as far as the sample tells."""

    def __init__(self, sample: np.ndarray, n: int, rows: int, seed: int = 7):
        self.draw, self.rows, self.expected = np.random.default_rng(seed), rows, []
        self.root = self._fit(sample, n)

    def _fit(self, sample: np.ndarray, n: float) -> Node | int:
        wanted = min(FANOUT, math.ceil(n / self.rows), len(sample) // FIT)
        if wanted > 1:
            node = Node(vantage_points(sample, wanted, self.draw))
            if len(node.points) > 1:
                home = (sample @ node.points.T).argmax(axis=1)
                for i in range(len(node.points)):
                    own = sample[home == i]
                    part = n * len(own) / len(sample)
                    node.children.append(self._fit(own, part) if part > 2 * self.rows else self._leaf(part))
                return node
        return self._leaf(n)

    def _leaf(self, n: float) -> int:
        self.expected.append(n)
        return len(self.expected) - 1

    def reach(self, unit: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, each with the rows that may have a partner there: no border on the way is farther than the row's window."""
        stack = [(self.root, np.arange(len(unit)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, int):
                yield node, q
                continue
            home, margin = node.borders(unit[q])
            margin[np.arange(len(q)), home] = -1.0
            near = margin <= window[q][:, None]
            stack += [(child, q[near[:, i]]) for i, child in enumerate(node.children)]


class Shard:
    """The stored vectors of a shard in cells around vantage points."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.raw, self.unit = ids, raw, _unit(raw)
        draw = np.random.default_rng(len(ids))
        seen = self.unit if len(ids) <= SAMPLE else self.unit[draw.choice(len(ids), SAMPLE, replace=False)]
        self.node = Node(vantage_points(seen, min(FANOUT, math.ceil(len(ids) / CELL)), draw, 2))
        home = (self.unit @ self.node.points.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(len(self.node.points) + 1))
        self.cells = [order[a:b] for a, b in zip(edges, edges[1:])]
        self.back = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # what queries found, for the stored ends

    def nearest(self, ids: np.ndarray, raw: np.ndarray, k: int, factor: float, bound: np.ndarray, min_cos: float | None) -> Best:
        """The k most similar stored vectors of each query: its own cell first, then the others.

        A cell is left out for a query where its border is farther than ``factor`` times the
        query's k-th distance so far, which is ``bound`` until it has k. With ``min_cos`` the
        query itself is left out.
        """
        best = Best(self, ids, raw, k, bound, min_cos)
        home, margin = self.node.borders(best.unit)
        for i, rows in enumerate(self.cells):
            best.take(np.flatnonzero(home == i), rows)
        for i, rows in enumerate(self.cells):
            best.take(np.flatnonzero((home != i) & (margin[:, i] <= factor * best.bound + 1e-6)), rows)
        return best


class Best:
    """The best so far of each query; ``bound`` is the distance that a better one cannot exceed."""

    def __init__(self, shard: Shard, ids: np.ndarray, raw: np.ndarray, k: int, bound: np.ndarray, min_cos: float | None):
        self.shard, self.ids, self.raw, self.unit, self.k, self.min_cos = shard, ids, raw, _unit(raw), k, min_cos
        self.cos, self.who = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1, dtype=np.int64)
        self.bound, self.found = bound.astype(np.float64), []

    def take(self, q: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(rows)))
        for s in range(0, len(q) if len(rows) else 0, step):
            self._take(q[s : s + step], rows)

    def _take(self, p: np.ndarray, rows: np.ndarray) -> None:
        c = self.unit[p] @ self.shard.unit[rows].T
        least = self.cos[p, -1]
        if self.min_cos is not None:
            least = np.maximum(least, self.min_cos)
        elif len(rows) > self.k:
            least = np.maximum(least, -np.partition(-c, self.k - 1, axis=1)[:, self.k - 1])
        # every row that may tie with the k-th: ties are settled exactly, by id
        x, y = np.nonzero(c >= (least - SLACK)[:, None])
        if not len(x):
            return
        cos = np.concatenate([exact_cosine(self.raw[p[x[i : i + BLOCK]]], self.shard.raw[rows[y[i : i + BLOCK]]]) for i in range(0, len(x), BLOCK)])
        who = self.shard.ids[rows[y]]
        if self.min_cos is not None:
            ok = (cos >= self.min_cos) & (who != self.ids[p[x]])
            x, cos, who = x[ok], cos[ok], who[ok]
            if not len(x):
                return
            self.found.append((who, self.ids[p[x]], cos))
        mine, x = np.unique(x, return_inverse=True)
        p = p[mine]
        order = np.lexsort((who, -cos, x))
        place = np.arange(len(x)) - np.searchsorted(x[order], x[order])
        order, place = order[place < self.k], place[place < self.k]
        near, ids = np.full((len(p), self.k), -2.0), np.full((len(p), self.k), -1, dtype=np.int64)
        near[x[order], place], ids[x[order], place] = cos[order], who[order]
        all_cos, all_who = np.hstack([self.cos[p], near]), np.hstack([self.who[p], ids])
        order = np.lexsort((all_who, -all_cos), axis=1)[:, : self.k]
        self.cos[p], self.who[p] = np.take_along_axis(all_cos, order, 1), np.take_along_axis(all_who, order, 1)
        self.bound[p] = np.where(self.cos[p, -1] > -1.5, np.minimum(self.bound[p], distance(self.cos[p, -1])), self.bound[p])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.nonzero(self.cos >= -1.5)
        return self.ids[x], self.who[x, y], self.cos[x, y]


def usable(vectors: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """(vec, neg, v): rows with a scale and 64 numbers that are not all zero, the numbers as 64 bytes.

    The cosine needs no more of the scale than its sign; a scale of zero or NaN leaves no vector.
    """
    whole = (F.size("data") == DIM) & F.exists("data", lambda x: x != 0) & ~F.exists("data", lambda x: x.isNull())
    rows = vectors.where(F.col("scales").isNotNull() & ~F.isnan("scales") & (F.col("scales") != 0) & F.col("data").isNotNull() & whole)
    slim = rows.select(F.col(vec_id).cast("long").alias("vec"), (F.col("scales") < 0).alias("neg"), F.col("data").cast("array<tinyint>").alias("data"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.ascontiguousarray(b.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.int8))
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("neg"), _binary(flat, b.num_rows)], names=["vec", "neg", "v"])

    return slim.mapInArrow(pack, "vec long, neg boolean, v binary")


def classes_of(rows: DataFrame, copies: int) -> DataFrame:
    """(id, neg, v, ids): each distinct vector, named by its smallest vec, with its ``copies`` smallest ones."""
    key = Window.partitionBy("v", "neg").orderBy("vec")
    first = rows.withColumn("rank", F.row_number().over(key)).where(F.col("rank") <= copies)
    grouped = first.groupBy("v", "neg").agg(F.sort_array(F.collect_list("vec")).alias("ids"))
    return grouped.select(F.element_at("ids", 1).alias("id"), "neg", "v", "ids")


def _binary(flat: np.ndarray, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * DIM), pa.py_buffer(flat)])


def _raw(batch) -> np.ndarray:
    """The vectors of a batch, up to their length."""
    data = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.int8).reshape(-1, DIM).astype(np.float32)
    return np.where(batch.column("neg").to_numpy(zero_copy_only=False).astype(bool)[:, None], -data, data)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of integer rows; products and norms are exact, so equal directions tie exactly."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _top(key: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best per key: by cosine, then by smaller other."""
    order = np.lexsort((other, -cos, key))
    sorted_key = key[order]
    starts = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    lengths = np.diff(np.r_[starts, len(order)])
    return order[np.arange(len(order)) - np.repeat(starts, lengths) < k]


def _links(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], names=["a", "b", "cos"])


def _searched(rows: DataFrame, k: int, factor: float, min_cos: float | None, parts: int) -> DataFrame:
    """(a, b, cos) of rows (shard, role, id, neg, v, bound): role 0 is stored, role 1 asks.

    A shard's stored rows are gathered, its queries pass in blocks. With ``min_cos`` what a
    query finds counts for the stored vector as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None

        def end():
            if shard is not None and len(shard.back[0]):
                yield _links(*shard.back)

        for b in batches:
            keys, roles = b.column("shard").to_numpy(), b.column("role").to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])]) if len(keys) else []
            for s, e in zip(edges, [*edges[1:], len(keys)]):
                part = b.slice(s, e - s)
                if keys[s] != number:
                    yield from end()
                    number, held, shard = keys[s], [], None
                if roles[s] == 0:
                    held.append((part.column("id").to_numpy(), _raw(part)))
                elif held:
                    if shard is None:
                        shard = Shard(*map(np.concatenate, zip(*held)))
                    best = shard.nearest(part.column("id").to_numpy(), _raw(part), k, factor, part.column("bound").to_numpy(), min_cos)
                    yield _links(*best.rows())
                    if best.found:
                        back = [np.concatenate(p) for p in zip(shard.back, *best.found)]
                        keep = _top(*back, k)
                        shard.back = tuple(p[keep] for p in back)
        yield from end()

    placed = rows.repartitionById(parts, F.col("shard").cast("int")) if parts > 1 else rows.coalesce(1)
    return placed.sortWithinPartitions("shard", "role").mapInArrow(run, "a long, b long, cos double")


class Routed:
    """Distinct vectors with their shards. ``classes``: (id, neg, v, ...)."""

    def __init__(self, classes: DataFrame, sample: int = SAMPLE, shard_rows: int | None = None):
        self.classes = classes
        n = classes.count()
        cores = classes.sparkSession.sparkContext.defaultParallelism
        rows = shard_rows or max(1, min(SHARD, max(LEAST_SHARD, math.ceil(n / (2 * cores)))))
        drawn = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("neg", "v").toArrow()
        self.routes = Routes(_unit(_raw(drawn)), n, rows)
        # a leaf that the sample cannot split any more is cut by hash: stored rows go to one part, queries to all
        self.parts = np.maximum(1, np.ceil(np.array(self.routes.expected) / (2 * rows))).astype(np.int64)
        self.shards = int(self.parts.sum())

    def place(self, asking: DataFrame, home: bool) -> DataFrame:
        """(shard, role, id, neg, v, bound): all vectors stored, and the asking ones (id, neg, v, bound, window).

        ``home``: whether a query goes to its own leaf; to the others as far as its window reaches.
        """
        routes, parts = self.routes, self.parts
        base = np.r_[0, np.cumsum(parts)]
        names = ["shard", "role", "id", "neg", "v", "bound"]
        schema = "shard long, role tinyint, id long, neg boolean, v binary, bound double"

        def batch(shard: np.ndarray, role: int, rows, bound: pa.Array) -> pa.RecordBatch:
            cols = [pa.array(shard), pa.array(np.full(len(shard), role, np.int8)), rows.column("id"), rows.column("neg"), rows.column("v"), bound]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    shard = np.zeros(b.num_rows, dtype=np.int64)
                    mixed = b.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    for leaf, q in routes.reach(_unit(_raw(b)), np.full(b.num_rows, -0.5)):
                        shard[q] = base[leaf] + mixed[q].astype(np.int64) % parts[leaf]
                    yield batch(shard, 0, b, pa.array(np.zeros(b.num_rows)))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    unit = _unit(_raw(b))
                    own = np.full(b.num_rows, -1)
                    if not home:
                        for leaf, q in routes.reach(unit, np.full(b.num_rows, -0.5)):
                            own[q] = leaf
                    for leaf, q in routes.reach(unit, b.column("window").to_numpy()):
                        q = np.sort(q[own[q] != leaf])
                        if len(q):
                            rows = b.take(pa.array(q))
                            for part in range(base[leaf], base[leaf + 1]):
                                yield batch(np.full(len(q), part), 1, rows, rows.column("bound"))

        stored = self.classes.select("id", "neg", "v").mapInArrow(store, schema)
        return stored.unionByName(asking.select("id", "neg", "v", "bound", "window").mapInArrow(ask, schema))

    def near(self, k: int, min_cos: float, factor: float) -> DataFrame:
        """(a, b, cos): for each vector the k best others with a cosine of ``min_cos`` at least, and maybe more."""
        far = float(distance(np.array(min_cos)))
        asking = self.classes.select("id", "neg", "v", F.lit(far).alias("bound"), F.lit(factor * far + 1e-6).alias("window"))
        return _searched(self.place(asking, True), k, factor, min_cos, self.shards)

    def nearest(self, k: int, factor: float) -> DataFrame:
        """(a, b, cos): the k best of each vector, itself among them: in its own leaf first, then as far as its k-th distance reaches."""
        first = self.classes.select("id", "neg", "v", F.lit(2.0).alias("bound"), F.lit(-0.5).alias("window"))
        inside = cut(_searched(self.place(first, True), k, factor, None, self.shards))
        kth = inside.groupBy(F.col("a").alias("id")).agg(F.min("cos").alias("cos"), F.count(F.lit(1)).alias("n"))
        far = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cos")))).otherwise(2.0)
        again = self.classes.select("id", "neg", "v").join(kth.select("id", far.alias("bound")), "id").withColumn("window", factor * F.col("bound") + 1e-6)
        return inside.unionByName(_searched(self.place(again, False), k, factor, None, self.shards))


def near_lists(rows: DataFrame, classes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(vec, near): each vector's k best others, as structs (far, id) in order; far is the negative cosine.

    ``links`` may hold a link several times; vectors without any link have no row. Copies
    of a vector are links of cosine one.
    """
    links = cut(links)  # a row a link: the search runs once whatever the plan below
    entry = F.struct((-F.col("cos")).alias("far"), F.col("b").alias("id"))
    best = links.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k + 1).alias("best"))
    many = cut(classes.where(F.size("ids") > 1).select("id", "neg", "v", "ids"))
    own = many.select(F.col("id").alias("a"), F.array(F.struct(F.lit(-1.0).alias("far"), "id")).alias("best"))
    entries = best.unionByName(own).select("a", F.explode("best").alias("e")).select("a", "e.far", F.col("e.id").alias("b"))
    # at most k + 2 classes of k + 1 ids each meet here
    ids = F.coalesce("ids", F.array("b"))
    wide = entries.join(many.select(F.col("id").alias("b"), "ids"), "b", "left").select("a", F.transform(ids, lambda x: F.struct(F.col("far").alias("far"), x.alias("id"))).alias("part"))
    lists = wide.groupBy("a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("part")))), 1, k + 1).alias("near"))
    # a class of more copies than its list names has its other rows by its numbers
    more = rows.join(many.where(F.size("ids") > k).select("id", "neg", "v"), ["neg", "v"]).select(F.col("id").alias("a"), "vec")
    few = many.where(F.size("ids") <= k).select(F.col("id").alias("a"), F.explode("ids").alias("vec"))
    told = lists.join(more.unionByName(few), "a", "left").withColumn("vec", F.coalesce("vec", "a"))
    return told.select("vec", F.slice(F.filter("near", lambda x: x["id"] != F.col("vec")), 1, k).alias("near"))


def similar_pairs(vectors: DataFrame, k: int = 10, min_cos: float = 0.9, factor: float = 0.35, shard_rows: int | None = None) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of cosine ``min_cos`` or more, one among the k most similar of the other.

    Ties go to the smaller vec_id. Rows whose scale is null, zero or NaN, or whose data is
    null, not 64 long, all zero or holds a null, are left out. Copies of one vector are
    searched once; each has its k smallest fellows and nearest others, so a large group of
    copies gives k pairs a row. Every row is indexed and is a query. ``factor`` times the
    distance that the triangle inequality leaves is searched; at 1 the result is exact.
    """
    rows = cut(usable(vectors))
    classes = cut(classes_of(rows, k + 1))
    near = near_lists(rows, classes, Routed(classes, shard_rows=shard_rows).near(k + 1, min_cos, factor), k)
    pairs = near.select("vec", F.explode("near").alias("n")).where(F.col("n.far") <= -min_cos)
    return pairs.select(F.least("vec", "n.id").alias("vec_a"), F.greatest("vec", "n.id").alias("vec_b")).distinct()


def nearest_to_all(vectors: DataFrame, k: int = 10, factor: float = 0.35, shard_rows: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbour, cosine): the k most similar others of every usable vector, whatever their cosine.

    Each vector is searched in its own shard, and then in those that ``factor`` times its
    k-th distance reaches; factor one is exact. Ties and unusable rows as in ``similar_pairs``.
    """
    rows = cut(usable(vectors))
    classes = cut(classes_of(rows, k + 1))
    links = Routed(classes, shard_rows=shard_rows).nearest(k + 1, factor).where("a <> b")
    near = near_lists(rows, classes, links, k).select("vec", F.posexplode("near").alias("at", "n"))
    return near.select(F.col("vec").alias("vec_id"), (F.col("at") + 1).alias("rank"), F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("cosine"))


def nearest_of(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 0.35, shard_rows: int = 50_000) -> DataFrame:
    """(vec_id, rank, neighbour, cosine): the k most similar rows of ``vectors`` for each of a stated set of ``queries``.

    Rows are sharded by hash, each shard builds its tree, the queries go through every
    shard and the shards' winners merge. Within a shard a cell is left out when its border
    is farther than ``factor`` times the k-th distance found so far; factor one is exact.
    Ties go to the smaller vec_id; unusable rows are left out on both sides. Copies of one
    vector are stored once; k + 1 classes hold k neighbours besides the query itself.
    """
    classes, asked = cut(classes_of(usable(vectors), k + 1)), usable(queries)
    shards = max(1, math.ceil(classes.count() / shard_rows))
    columns = ["shard", "role", "id", "neg", "v", "bound"]
    stored = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("role", F.lit(0).cast("tinyint")).withColumn("bound", F.lit(0.0))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    wanted = asked.withColumnRenamed("vec", "id").withColumn("shard", every).withColumn("role", F.lit(1).cast("tinyint")).withColumn("bound", F.lit(2.0))
    found = _searched(stored.select(*columns).unionByName(wanted.select(*columns)), k + 1, factor, None, shards)
    members = classes.select(F.col("id").alias("neighbour"), "ids")
    # of each shard's winners only the best k + 1 classes can hold a neighbour
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
    found = found.toDF("vec_id", "neighbour", "cosine").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).join(members, "neighbour")
    found = found.select("vec_id", F.explode("ids").alias("neighbour"), "cosine").where("neighbour <> vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "cosine")
