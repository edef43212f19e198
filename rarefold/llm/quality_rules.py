"""Quality rules: statistics of each text, and lines that many documents of a host share.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import BLANKS, bound, spare, written

#: Words of a window whose repeats are counted.
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text holds twice or more, the first included.

    Windows (of a power of two of words) are compared by 64-bit hash; only texts
    with a repeat sort theirs.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(
            by_hash,
            lambda s: bound(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, k: F.struct(
                                    x["i"].alias("i"),
                                    ((F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            ),
        )

    def doubled(by: int):
        """From the hashes of all runs of by items to those of all runs of twice as many."""
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def of(w: Column) -> Column:
        hashes, by = F.transform(w, lambda x: F.xxhash64(x)), 1
        while by < window:
            hashes, by = bound(hashes, doubled(by)), 2 * by
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return bound(words, lambda w: F.when(F.size(w) > window, of(w)).otherwise(F.lit(0).cast("long")))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text is empty: all counts are 0, and base_failed is true.
    """
    (w, lines) = spare(docs, "words_", "lines_")
    body = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    return (
        docs.withColumns({w: words_of(F.col(text)), lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
        .withColumns(
            {
                "n_words": long(F.size(w)),
                "word_chars": long(F.length(F.array_join(w, ""))),
                "n_symbols": long(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))),
                "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
                "n_repeat_words": repeat_words(F.col(w)),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop(w, lines)
    )


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def line_hashes(text: Column) -> Column:
    """Hashes of a text's distinct normalised lines that have a word."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def frequent_lines(docs: DataFrame, max_documents: int, text: str = "text", host: str = "source") -> DataFrame:
    """host_, doc_ (the text's hash), line_ (hash) and first_ of the lines that over max_documents documents of the host hold; first_ is the smallest doc_id of those (null where no holder has an id).

    Every row is a document; what equal texts of a host hold is written once, with
    their number. The counts are summed on the map side, so a line of every
    document is no hot key; the join back is one that adaptive execution splits.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col("doc_id").alias("id_"), F.col(host).alias("host_"), F.xxhash64(body).alias("doc_"), F.explode(line_hashes(F.col(text))).alias("line_"))
    each = written(each.groupBy("host_", "doc_", "line_").agg(F.min("id_").alias("id_"), F.count("*").alias("c_")), "lines")
    often = each.groupBy("host_", "line_").agg(F.sum("c_").alias("n_"), F.min("id_").alias("first_")).where(F.col("n_") > max_documents)
    often = often.select(F.col("host_").alias("h_"), F.col("line_").alias("l_"), "first_")
    return each.join(often, F.col("host_").eqNullSafe(F.col("h_")) & (F.col("line_") == F.col("l_"))).select("host_", "doc_", "line_", "first_")


def judged(docs: DataFrame, *, max_documents: int = 25, least_left: float = 0.3, text: str = "text", host: str = "source", cleaned: bool = False) -> DataFrame:
    """docs with the statistics, n_removed_words, kept and, where cleaned is set, clean_text.

    max_documents: documents of a host that may hold a line before it is removed
    from all of them but that with the smallest doc_id (rows with that id, where
    ids repeat; none, where no holder has an id). A document is rejected if
    base_failed, or if less than least_left of its words stay. Null hosts form one
    host. Null texts are empty and have no lines; texts may have any length; rows
    may repeat: each counts, and equal rows get equal results. An empty table
    gives none. Columns of docs of the names above are replaced; others stay.
    """
    k1, k2, h, d, gone = spare(docs, "k1_", "k2_", "host_", "doc_", "gone_")
    lines = frequent_lines(docs, max_documents, text, host)
    per = lines.groupBy(F.col("host_").alias(h), F.col("doc_").alias(d)).agg(F.collect_list(F.struct("line_", "first_")).alias(gone))
    out = statistics(docs, text).withColumns({k1: F.col(host), k2: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    out = out.join(per, F.col(k1).eqNullSafe(F.col(h)) & (F.col(k2) == F.col(d)), "left")
    own = F.transform(F.filter(F.col(gone), lambda x: ~x["first_"].eqNullSafe(F.col("doc_id")) | F.col("doc_id").isNull()), lambda x: x["line_"])
    out = out.withColumn(gone, F.when(F.size(own) > 0, own))
    body, removed = F.coalesce(F.col(text), F.lit("")), F.col(gone)
    dropped = F.filter(F.split(body, "\n"), lambda x: F.array_contains(removed, F.xxhash64(normal_line(x))))
    words = F.aggregate(dropped, F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(normal_line(x), " ")))
    out = out.withColumn("n_removed_words", F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(words))
    out = out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_removed_words")) >= least_left * F.col("n_words")))
    if cleaned:
        rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x)))), "\n")
        out = out.withColumn("clean_text", F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest))
    return out.drop(k1, k2, h, d, gone)
