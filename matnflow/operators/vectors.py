"""Dense vectors: normalising, quantising, and the most similar rows for a set of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let

QUERY_BLOCK = 4_096  # queries held by every task at once


def norm(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vector: Column | str) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantise(vector: Column | str) -> Column:
    """struct(scale, q): eight-bit numbers of the normalised vector, halves rounded up."""

    def by(unit: Column, top: Column) -> Column:
        scale = F.when(top == 0, 1.0).otherwise(top)
        return F.struct(scale.cast("float").alias("scale"), F.transform(unit, lambda x: F.floor(x / scale + 0.5).cast("tinyint")).alias("q"))

    return let(normalise(vector), lambda unit: let(F.array_max(F.transform(unit, F.abs)) / 127, lambda top: by(unit, top)))


def dequantise(scale: Column | str, q: Column | str) -> Column:
    s = F.col(scale) if isinstance(scale, str) else scale
    return F.transform(F.col(q) if isinstance(q, str) else q, lambda x: x.cast("double") * s.cast("double"))


def check_shape(vectors: DataFrame, corpus: DataFrame) -> None:
    """Vectors and corpus must have equally many rows."""
    a, b = vectors.count(), corpus.count()
    if a != b:
        raise ValueError(f"{a} vectors for {b} records")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, query: str = "query", key: str = "pos", vector: str = "vector") -> DataFrame:
    """(query, key, score, rank): the k rows of ``vectors`` with the largest dot product, per query.

    Queries are taken in blocks of a bounded size; each task multiplies its rows with a
    block and keeps k of them, then the tasks' winners merge. Ties go to the smaller key.
    Null vectors, and rows of another length than the query, have no score.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    out = None
    kind = asked.schema["query"].dataType.simpleString()
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(held):
                by_size.setdefault(len(r.v), []).append(i)
            sides = {n: (np.array(ix), np.array([held[i].v for i in ix])) for n, ix in by_size.items()}
            best: dict[int, list] = {}
            for b in batches:
                keys, vs = b.column("key").to_numpy(), b.column("v").to_pylist()
                for n, (ix, q) in sides.items():
                    at = [i for i, v in enumerate(vs) if len(v) == n and None not in v]
                    if not at:
                        continue
                    mine, scores = keys[at], q @ np.array([vs[i] for i in at]).reshape(len(at), n).T
                    for row, i in zip(scores, ix):
                        first = np.lexsort((mine, -row))[:k]
                        old = best.get(i, [])
                        best[i] = sorted(old + [(-row[j], mine[j]) for j in first])[:k]
            found = [(held[i].query, int(key_), float(-far)) for i, rows_ in best.items() for far, key_ in rows_]
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_pydict({"query": list(cols[0]), "key": list(cols[1]), "score": list(cols[2])}, schema=schema)

        schema = pa.schema([("query", pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()), ("key", pa.int64()), ("score", pa.float64())])
        part = rows.mapInArrow(run, f"query {kind}, key long, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")
