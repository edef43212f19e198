"""What the corpus operators share: the shared folder, tables written there, and words of raw UTF-8."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
BLANKS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where unset, a new one of this machine, if it is the only one (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="rarefold-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows doesn't compute it again, nor loses it with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even where use names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The results of an associative op over each front part of an array of int: in pieces of the root of its size, then over the pieces."""
    last = lambda a: F.element_at(a, -1)
    add = lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(op(F.try_element_at(a, F.lit(-1)), x))))

    def of(v: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(v))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(v, i * n + 1, n), F.array().cast("array<int>"), add))
        totals = lambda p: F.aggregate(F.transform(p, last), F.array().cast("array<int>"), add)
        joined = lambda p, t: F.transform(p, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: op(F.get(t, k - 1), y))))
        full = lambda p: F.filter(p, lambda x: F.size(x) > 0)
        return bound(full(pieces), lambda p: bound(totals(p), lambda t: F.flatten(joined(p, t))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bound(values, of))


def utf8(text: str | Column) -> Column:
    """The text's bytes; null texts are empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, case aside."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
