"""Rows stored once in the shared folder, which tasks read part by part."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names, or the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def stored(df: DataFrame, name: str, parts: int) -> str:
    """The path of df, written in rising order of id: files by name, rows within them."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.repartitionByRange(parts, "id").sortWithinPartitions("id").write.option("compression", "zstd").parquet(path)
    return path


def _opened(path: str) -> tuple[fs.FileSystem, list[str]]:
    at = urlsplit(path)
    store, own = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(own))
    return store, sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def read(path: str, most: int) -> Iterator[pa.Table]:
    """The rows of stored() in their order, most at a time."""
    store, names = _opened(path)
    held, n = [], 0
    for name in names:
        with store.open_input_file(name) as f:
            for batch in parquet.ParquetFile(f).iter_batches(batch_size=most):
                held.append(batch)
                n += batch.num_rows
                if n >= most:
                    whole = pa.Table.from_batches(held)
                    for at in range(0, n - most + 1, most):
                        yield whole.slice(at, most)
                    rest = n % most
                    held, n = whole.slice(n - rest).to_batches() if rest else [], rest
    if n:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or flat.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors have nulls or different lengths")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
