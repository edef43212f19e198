"""Documents to training sequences: five stages, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.llm import near_dup, packing, quality_classifier, quality_rules, secret_scans
from rarefold.llm.common import load, written

#: Score under which a document is rejected as of low quality.
LEAST_SCORE = 0.3


def kept_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and all other columns as one, so that no name of theirs meets one of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")]
    return docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else [F.lit(None).cast("string").alias("source")]), F.struct(F.lit(0), *others).alias("others_"))


def put_back(df: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns, with the column named text as text, and n_chars to match where text is another and there is such a column."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "source": F.col("source")}
    if text != "text" and "n_chars" in docs.columns:
        changed = ~F.col(text).eqNullSafe(F.col("text"))
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others_")["n_chars"])
    return df.select(*[new.get(c, F.col("others_")[c] if c not in ("doc_id", "text", "source") else None).alias(c) for c in docs.columns])


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the rules reject, and without the lines that they remove.

    Null and empty texts are rejected. Rows may repeat, and each is judged; an
    empty table stays empty. All columns come back as they were but text, and
    n_chars where text changed.
    """
    return put_back(quality_rules.judged(kept_apart(docs), cleaned=True).where("kept"), docs, "clean_text")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of a low score. The model learns from labelled documents that the stage before kept, as outside fold 0.

    Without labels every score is 0.5, and all stay. Null texts get the intercept's
    score; equal texts share their fate; all columns come back as they were.
    """
    own = kept_apart(docs)
    weights = quality_classifier.trained(own, load(spark, sf_dir, "labels"))
    return put_back(quality_classifier.scored(own, weights, score="score").where(F.col("score") >= LEAST_SCORE), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest id; texts without words stay.

    A row is a document: rows that share an id, or have none, are told apart, and
    stay unless their texts are near copies. All columns come back as they were.
    """
    return near_dup.deduplicated(docs, width=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret span replaced by its kind. All rows stay, null texts too; all columns come back as they were but text, and n_chars where text changed."""
    return put_back(secret_scans.scanned(kept_apart(docs), redacted=True), docs, "safe_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence, of every row; null texts have the end id alone."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: Classifier, sketches and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
