"""Secret scans: spans of credentials in texts, and parts that only together make one.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import bound, running, spare

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts of credentials that are too weak alone: an identifier, a secret without a name, and where it is used.
IDENTIFIER = r"""(?i:(?<![A-Za-z0-9])(?:user(?:_?(?:name|id))?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9_.@-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i:\b(?:https?|ftp|jdbc:[a-z]{2,}|mongodb|redis|postgres(?:ql)?|mysql|amqps?|s3)://)[A-Za-z0-9.-]{3,}(?::[0-9]+)?"
#: Kinds as listed: what starts at the same place is ordered so.
KINDS = ("assign", "access", "hex", "linked")
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Code points between parts that belong together, at most.
SCOPE = 200
#: Shares that the rows of one text are dealt to, by their other columns.
COPIES = 64


def spans(text: Column, pattern: str, name: str, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end, kind's order), in code points.

    The pieces between matches and the matches alternate, so the running sums of
    both lengths give the places. Matches whose group is shorter than least are
    dropped.
    """
    order = KINDS.index(name) if name in KINDS else len(KINDS)

    def found(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        own = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else hits
        length = lambda x: F.length(x)
        # the last piece has no match after it
        each = F.arrays_zip(F.slice(F.transform(F.split(t, pattern, -1), length), 1, F.size(hits)).alias("gap"), F.transform(hits, length).alias("hit"), F.transform(own, length).alias("own"))
        sums = lambda m: F.zip_with(m, running(F.transform(m, lambda x: x["gap"] + x["hit"]), lambda a, x: a + x), lambda x, end: F.struct((end - x["hit"]).alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(name).alias("kind"), x["own"].alias("own")))
        kept = F.filter(bound(each, sums), lambda x: x["own"] >= max(least, 1))
        return F.transform(kept, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"])).cast(SPANS)

    return F.when(text.rlike(pattern), found(text)).otherwise(F.array().cast(SPANS))


def joined(array: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def linked(docs: DataFrame, key: str, parts: str, scope: int) -> DataFrame:
    """key and the spans of weak secrets (array) that have an access key in scope, or an identifier and an endpoint.

    An interval join on (key, block of scope code points): a weak secret is in
    every block from its start to its end, a part in those from scope before it to
    scope after it, so both have a block in common wherever they are in scope.
    Spans of a kind don't overlap, so a block holds a bounded number, whatever the
    length of the text.
    """
    each = docs.select(key, F.explode(parts).alias("p")).select(key, "p.*")
    weak = each.where("kind = 'weak'").select(key, "start", "end")
    near = each.where("kind <> 'weak'").select(F.col(key).alias("k_"), F.col("start").alias("s_"), F.col("end").alias("e_"), F.col("kind").alias("part_"))
    block = lambda c: F.floor(c / scope)
    near = near.withColumn("b_", F.explode(F.sequence(block(F.col("s_") - scope), block(F.col("e_") + scope))))
    weak = weak.withColumn("b", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    on = (F.col(key) == F.col("k_")) & (F.col("b") == F.col("b_")) & (F.col("s_") <= F.col("end") + scope) & (F.col("e_") + scope >= F.col("start"))
    met = weak.join(near, on).groupBy(key, "start", "end").agg(*[F.max(F.col("part_") == x).alias(x) for x in ("access", "identifier", "endpoint")])
    one = F.struct(F.col("start"), F.lit(KINDS.index("linked")).alias("rank"), F.col("end"), F.lit("linked").alias("kind"))
    return met.where("access or identifier and endpoint").groupBy(key).agg(F.collect_list(one).alias("linked_"))


def scanned(docs: DataFrame, *, scope: int = SCOPE, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_linked (long), base_sha256, spans and, where redacted is set, safe_text.

    spans: kind:start:end of all spans, by start, then kind, end exclusive, in
    code points. A weak secret (32 base64 letters or more, of mixed kinds) counts,
    as kind linked, only if an access key, or both an identifier (a named user,
    client or account) and an endpoint, lie within scope code points; it is left out
    where it overlaps a base span. Links are found once per distinct text, and go
    back to its rows in COPIES shares, so that no group of copies is one task's.
    Null texts are empty, and their safe_text is null; texts may have any length,
    equal rows get equal results, ids may be null or tied; an empty table gives
    none. Columns of docs of the names above are replaced; others stay.
    """
    key, base, parts, other, found, share, shares = spare(docs, "key_", "base_", "parts_", "more_key_", "linked_", "share_", "shares_")
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({key: F.xxhash64(t), base: F.concat(spans(t, ASSIGN, "assign", 6, 2), spans(t, ACCESS, "access"), spans(t, HEX, "hex"))})
    weak = out.where(t.rlike(WEAK) & (t.rlike(ENDPOINT) | t.rlike(ACCESS))).dropDuplicates([key])
    free = lambda b: F.filter(spans(t, WEAK, "weak"), lambda w: ~F.exists(b, lambda x: (x["start"] < w["end"]) & (x["end"] > w["start"])))
    weak = weak.select(key, F.concat(free(F.col(base)), F.filter(F.col(base), lambda x: x["kind"] == "access"), spans(t, IDENTIFIER, "identifier"), spans(t, ENDPOINT, "endpoint")).alias(parts))
    more = linked(weak, key, parts, scope).toDF(other, found).withColumn(shares, F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = F.xxhash64(F.lit(0), *[F.col(c) for c, kind in docs.dtypes if c != text and kind in ("string", "int", "bigint")])
    out = out.withColumn(share, F.pmod(dealt, F.lit(COPIES)).cast("int"))
    out = out.join(more, (F.col(key) == F.col(other)) & (F.col(share) == F.col(shares)), "left").drop(other, share, shares)
    n = lambda kind: F.size(F.filter(F.col(base), lambda s: s["kind"] == kind)).cast("long")
    every = F.concat(F.col(base), F.coalesce(F.col(found), F.array().cast(SPANS)))
    out = out.withColumns({"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "n_linked": F.coalesce(F.size(found), F.lit(0)).cast("long"), "base_sha256": F.sha2(joined(F.col(base)), 256), "spans": joined(every)})
    if redacted:
        out = out.withColumn("safe_text", F.when(F.size(every) > 0, redact(F.col(text), every)).otherwise(F.col(text)))
    return out.drop(key, base, found)


def redact(text: Column, every: Column) -> Column:
    """text with each span replaced by <kind>; where spans overlap, the first names them all."""

    def of(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        before = lambda e, k: F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1))
        piece = lambda x, low: F.when(x["start"] >= low, F.concat(F.substring(text, low + 1, x["start"] - low), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return bound(ends, lambda e: F.concat(F.array_join(F.transform(s, lambda x, k: piece(x, before(e, k))), ""), F.substring(text, F.array_max(e) + 1, F.length(text))))

    return bound(F.array_sort(every), of)
