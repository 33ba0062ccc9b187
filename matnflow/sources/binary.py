"""Vectors in binary files: NPY matrices and packed eight-bit rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK = 8_192  # rows of one output block


def parse_npy(content: bytes) -> np.ndarray:
    """A matrix of little-endian 32-bit floats in C order; anything else is an error."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("no NPY file")
    wide = content[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", content, 8)[0]
    start = 12 if wide else 10
    header = content[start : start + size].decode("latin-1")
    shape = re.search(r"'shape':\s*\((\d+),\s*(\d+),?\)", header)
    if not shape or "'<f4'" not in header or "'fortran_order': False" not in header:
        raise ValueError(f"unsupported NPY header {header.strip()}")
    rows, dims = map(int, shape.groups())
    return np.frombuffer(content, "<f4", rows * dims, start + size).reshape(rows, dims)


def parse_packed(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(scales, rows): header of rows and dimensions (u32), a scale a row (f32), then the numbers (i8), little-endian."""
    rows, dims = struct.unpack_from("<II", content)
    scales = np.frombuffer(content, "<f4", rows, 8)
    return scales, np.frombuffer(content, np.int8, rows * dims, 8 + 4 * rows).reshape(rows, dims)


def pack(scales: np.ndarray, rows: np.ndarray) -> bytes:
    """K4: the packed form of ``parse_packed``."""
    return struct.pack("<II", *rows.shape) + scales.astype("<f4").tobytes() + rows.astype(np.int8).tobytes()


def write_npy(rows: np.ndarray) -> bytes:
    """K2: an NPY file of a float matrix."""
    header = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows.shape[0]}, {rows.shape[1]}), }}"
    header += " " * (-(len(header) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(header)) + header.encode("latin-1") + rows.astype("<f4").tobytes()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of NPY files, a task a file, in blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content):
                rows = parse_npy(bytes(content))
                for s in range(0, len(rows), BLOCK):
                    block = rows[s : s + BLOCK]
                    yield pd.DataFrame({"path": name, "row": np.arange(s, s + len(block)), "vector": list(block)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, vector array<float>")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, scale, q) of packed files, a task a file, in blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content):
                scales, rows = parse_packed(bytes(content))
                for s in range(0, len(rows), BLOCK):
                    block = rows[s : s + BLOCK]
                    yield pd.DataFrame({"path": name, "row": np.arange(s, s + len(block)), "scale": scales[s : s + BLOCK], "q": list(block)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, scale float, q array<tinyint>")


def packed_parts(vectors: DataFrame, order: str = "pos", scale: str = "scale", q: str = "q", rows_a_part: int = 100_000) -> DataFrame:
    """K4: (part, content): packed files of the quantised rows in order, each of a bounded number of rows."""
    from pyspark.sql import functions as F

    ranged = vectors.select(F.floor(F.col(order) / rows_a_part).alias("part"), F.col(order).alias("o"), F.col(scale).alias("s"), F.col(q).alias("q"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        return pd.DataFrame({"part": [key[0]], "content": [pack(rows.s.to_numpy(), np.stack(rows.q.to_list()))]})

    return ranged.groupBy("part").applyInPandas(run, "part long, content binary")


def npy_parts(vectors: DataFrame, order: str = "pos", vector: str = "vector", id_: str | None = None, rows_a_part: int = 100_000) -> DataFrame:
    """K2: (part, content, ids): NPY files of the rows in order, each of a bounded number, and a JSON list of the rows' ids (null without ``id_``)."""
    import json

    from pyspark.sql import functions as F

    ranged = vectors.select(F.floor(F.col(order) / rows_a_part).alias("part"), F.col(order).alias("o"), F.col(vector).alias("v"), (F.col(id_) if id_ else F.lit(None)).cast("string").alias("i"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        ids = json.dumps(rows.i.to_list(), ensure_ascii=False) if id_ else None
        return pd.DataFrame({"part": [key[0]], "content": [write_npy(np.stack(rows.v.to_list()))], "ids": [ids]})

    return ranged.groupBy("part").applyInPandas(run, "part long, content binary, ids string")


def write_files(parts: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(path, size): each row's bytes as a file of a folder that all executors share; a task that is repeated writes the same files again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root)
        for batch in batches:
            paths = [f"{root}/{n}" for n in batch[name]]
            for path, data in zip(paths, batch[content]):
                with system.open_output_stream(path) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"path": paths, "size": [len(c) for c in batch[content]]})

    return parts.select(name, content).mapInPandas(run, "path string, size long")


def put(entries: DataFrame, store: str, key: str = "key", value: str = "value") -> None:
    """K3: put (key, value) rows into a store: a table of versions, so that a put is one append."""
    from pyspark.sql import functions as F

    rows = entries.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.current_timestamp().alias("put_at"))
    rows.write.mode("append").parquet(store)


def get(spark: SparkSession, store: str) -> DataFrame:
    """K3: (key, value): what was put last for each key; of one put's values for a key the largest."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("key string, value string, put_at timestamp").parquet(store)
    return rows.groupBy("key").agg(F.max(F.struct("put_at", "value"))["value"].alias("value"))
