"""Labelled tables from folders of CSV files, and results on disk."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.utils import AnalysisException

# Names that a target column may have, in order of preference.
TARGETS = ("binaryClass", "class", "Class", "target", "label", "c", "defects", "DL", "Urban", "Damaged", "Laid.off", "col_33", "class14")


@dataclass(frozen=True)
class Settings:
    """Where tables lie and which of them count."""

    preferred: str | None = "binaryClass"
    targets: Sequence[str] = TARGETS
    min_ratio: float = 0.0
    least_rows: int = 10
    most_rows: int | None = 50_000  # None: any
    exclude: Sequence[str] = ("dataset_1039_hiva_agnostic",)


@dataclass
class LabelledTable:
    """A table with y (1: the rare class), and the names of its columns by kind."""

    name: str
    data: DataFrame
    ratio_min_maj: float
    numbers: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def target_column(columns: Sequence[str], settings: Settings = Settings()) -> str:
    """The preferred name, else the first known one, else the last column (S3)."""
    return next((c for c in (settings.preferred, *settings.targets) if c in columns), columns[-1])


def labelled(df: DataFrame, name: str, settings: Settings = Settings()) -> LabelledTable | None:
    """None unless the table has rows, features and two classes of the sizes asked for (S2). Two counts reach the driver."""
    if len(df.columns) < 2:
        return None
    target = target_column(df.columns, settings)
    counts = {r[0]: r[1] for r in df.where(F.col(f"`{target}`").isNotNull()).groupBy(f"`{target}`").count().limit(3).collect()}
    n = sum(counts.values())
    if len(counts) != 2 or n < settings.least_rows or settings.most_rows is not None and n > settings.most_rows:
        return None
    rare = min(sorted(counts), key=counts.get)
    ratio = min(counts.values()) / max(counts.values())
    if ratio < settings.min_ratio:
        return None
    kinds = {f.name: isinstance(f.dataType, NumericType) for f in df.schema if f.name != target}
    safe = {c: c.replace(".", "_") for c in kinds}
    own = df.where(F.col(f"`{target}`").isNotNull()).select(*[F.col(f"`{c}`").cast("double" if kinds[c] else "string").alias(safe[c]) for c in kinds], (F.col(f"`{target}`") == F.lit(rare)).cast("int").alias("y"))
    numbers = [safe[c] for c in kinds if kinds[c]]
    own = own.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers}) if numbers else own
    return LabelledTable(name, own, ratio, numbers, [safe[c] for c in kinds if not kinds[c]])


def csv_table(spark: SparkSession, path: str, settings: Settings = Settings()) -> LabelledTable | None:
    """None for a file that can't be read as a labelled table."""
    name = path.rstrip("/").rpartition("/")[2].removesuffix(".csv")
    if name in settings.exclude:
        return None
    try:
        df = spark.read.csv(path, header=True, inferSchema=True, nullValue="", nanValue="NaN")
    except AnalysisException:
        return None
    return labelled(df, name, settings)


def csv_folder(spark: SparkSession, folder: str, settings: Settings = Settings()) -> list[LabelledTable]:
    """All valid tables of a folder, by path; files are listed by Spark, so that any store will do."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path").collect()
    return [t for r in names if (t := csv_table(spark, r[0], settings)) is not None]


def summary(tables: Iterable[LabelledTable]) -> DataFrame | None:
    """A row per table: rows, features, classes and r."""
    parts = [t.data.agg(F.lit(t.name).alias("dataset"), F.count("*").alias("n"), F.lit(len(t.numbers) + len(t.words)).alias("n_features"), F.count_if(F.col("y") == 0).alias("n_maj"), F.count_if(F.col("y") == 1).alias("n_min")) for t in tables]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("r_maj_min", F.col("n_maj") / F.col("n_min"))


class ResultStore:
    """Rows of results by dataset and algorithm, as a folder of versions: each change is written beside the last and then named current."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, tag: str = "current") -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/{tag}/_SUCCESS"))

    def load(self, tag: str = "current") -> DataFrame | None:
        if tag == "current" and not self.exists() and self.exists("next"):  # a change stopped between its two renames
            self._rename("next", "current")
        return self.spark.read.parquet(f"{self.path}/{tag}") if self.exists(tag) else None

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("dataset", "algorithm").parquet(f"{self.path}/current")

    def _copy(self, rows: DataFrame, tag: str) -> None:
        rows.write.mode("overwrite").partitionBy("dataset", "algorithm").parquet(f"{self.path}/{tag}")

    def backup(self) -> str | None:
        """The name of a copy with the time in it, None where there is nothing to copy."""
        rows = self.load()
        if rows is None:
            return None
        tag = f"backup_{time.strftime('%Y%m%d_%H%M%S')}"
        self._copy(rows, tag)
        return tag

    def save(self, tag: str) -> None:
        self._copy(self.load(), f"snapshot_{tag}")

    def restore(self, tag: str) -> None:
        self._replace(self.load(f"snapshot_{tag}"))

    def snapshots(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName().removeprefix("snapshot_") for s in fs.globStatus(path(f"{self.path}/snapshot_*")))

    def _rename(self, tag: str, to: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/{to}"), True)
        if not fs.rename(path(f"{self.path}/{tag}"), path(f"{self.path}/{to}")):
            raise OSError(f"{self.path}/{tag} could not be renamed")

    def _replace(self, rows: DataFrame) -> None:
        """The rows are whole, as next, before current is touched; load() ends a change that stopped here."""
        self._copy(rows, "next")
        self._rename("next", "current")

    def drop(self, column: str, names: Sequence[str]) -> tuple[list[str], list[str]]:
        """Rows of the named algorithms or datasets go, after a backup; gives the names found and those not."""
        rows = self.load()
        here = {r[0] for r in rows.where(F.col(column).isin(*names)).select(column).distinct().collect()} if rows is not None else set()
        if here:
            self.backup()
            self._replace(rows.where(~F.col(column).isin(*here)))
        return [n for n in names if n in here], [n for n in names if n not in here]

    def completed(self, n_folds: int) -> DataFrame | None:
        """dataset and algorithm with at least so many rows without error."""
        rows = self.load()
        return None if rows is None else completed(rows, n_folds)


def completed(rows: DataFrame, n_folds: int) -> DataFrame:
    good = rows.where("error is null") if "error" in rows.columns else rows
    return good.groupBy("dataset", "algorithm").agg(F.count("*").alias("n")).where(F.col("n") >= n_folds).select("dataset", "algorithm")


def exported(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """An analytic table as one CSV file with a header, in the folder path, in an order of its rows (S12). Such a table has a row per algorithm or dataset."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
