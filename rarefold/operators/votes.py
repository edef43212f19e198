"""The vote of order statistics: the i-th nearest row of the rare class against the (i k)-th of the common class.

Every binary variant is this kernel with its own k, number of votes and score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.operators.neighbours import Sizes, within

# Grids of the selecting variants.
ALPHAS = (0.25, 0.5, 0.75, 1.0)
N_VOTES = (1, 2, 3, 5, 7, 10)


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def votes(dmin: Column, dmaj: Column, k: Column | float, n_votes: Column | int = 5, soft: bool = False) -> Column:
    """wins and n (F2; F5 if soft): n is 0 where a class has no row, and wins are then those of the other class.

    k is rounded half to even, and 1 at least. Where even one comparison would
    reach beyond the list, one is made with its last row.
    """
    whole = F.greatest(F.lit(1), F.bround(_lit(k).cast("double")).cast("int"))
    a, b = F.size(dmin), F.size(dmaj)
    fit = F.least(_lit(n_votes), a, F.floor(b / whole).cast("int"))
    n, k_eff = F.greatest(fit, F.lit(1)), F.when(fit < 1, F.least(whole, b)).otherwise(whole)

    def score(i: Column, k_: Column) -> Column:
        near, far = F.get(dmin, i - 1), F.get(dmaj, F.least(i * k_, b) - 1)
        return F.coalesce(F.try_divide(far, near + far), F.lit(0.5)) if soft else (near < far).cast("double")

    def counted(s: Column) -> Column:
        return F.struct(F.aggregate(F.sequence(F.lit(1), s["n"]), F.lit(0.0), lambda acc, i: acc + score(i, s["k"])).alias("wins"), s["n"].alias("n"))

    once = F.get(F.transform(F.array(F.struct(n.alias("n"), k_eff.alias("k"))), counted), F.lit(0))
    none = F.struct(F.when(a > 0, 1.0).otherwise(0.0).alias("wins"), F.lit(0).alias("n"))
    return F.when((a == 0) | (b == 0), none).otherwise(once)


def counted_votes(rare: Column, inside: Column, n_maj: Column | int, k: Column | float, n_votes: Column | int = 5) -> Column:
    """The same as votes with whole lists, from counts_inside: the i-th rare row is nearer than the (i k)-th common one where fewer than i k common rows are within its distance."""
    whole, b = F.greatest(F.lit(1), F.bround(_lit(k).cast("double")).cast("long")), _lit(n_maj).cast("long")
    fit = F.least(_lit(n_votes).cast("long"), rare.cast("long"), F.floor(b / whole).cast("long"))
    n, k_eff = F.greatest(fit, F.lit(1)).cast("int"), F.when(fit < 1, F.least(whole, b)).otherwise(whole)

    def counted(s: Column) -> Column:
        return F.struct(F.aggregate(F.sequence(F.lit(1), s["n"]), F.lit(0.0), lambda acc, i: acc + (F.get(inside, i - 1) < i * s["k"]).cast("double")).alias("wins"), s["n"].alias("n"))

    once = F.get(F.transform(F.array(F.struct(n.alias("n"), k_eff.alias("k"))), counted), F.lit(0))
    none = F.struct(F.when(rare > 0, 1.0).otherwise(0.0).alias("wins"), F.lit(0).alias("n"))
    return F.when((rare == 0) | (b == 0), none).otherwise(once)


def share(vote: Column) -> Column:
    """The vote's fraction for the rare class."""
    return vote["wins"] / F.greatest(vote["n"], F.lit(1))


def decided(df: DataFrame, frac: Column) -> DataFrame:
    """id, y, frac and y_pred; ties and empty classes go to the common class unless frac is over a half."""
    return df.select("id", "y", frac.alias("frac"), (frac > 0.5).cast("int").alias("y_pred"))


def power(s: Sizes, alpha: Column | float) -> Column:
    return F.pow(F.lit(s.r), _lit(alpha))


def single(df: DataFrame, s: Sizes, alpha: float = 1.0, soft: bool = False) -> DataFrame:
    return decided(df, share(votes(F.col("dmin"), F.col("dmaj"), power(s, alpha), s.n_votes, soft)))


def pooled(df: DataFrame, s: Sizes, alphas: Sequence[float] = ALPHAS, n_votes: Sequence[int] = N_VOTES) -> DataFrame:
    """All comparisons of a grid, counted together."""
    each = [votes(F.col("dmin"), F.col("dmaj"), power(s, a), n) for a in alphas for n in n_votes]
    return decided(df, sum(v["wins"] for v in each) / sum(v["n"] for v in each))


def pooled_soft(df: DataFrame, s: Sizes, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """The mean of all soft scores of a grid of exponents."""
    each = [votes(F.col("dmin"), F.col("dmaj"), power(s, a), s.n_votes, soft=True) for a in alphas]
    return decided(df, sum(v["wins"] for v in each) / sum(v["n"] for v in each))


def by_density(df: DataFrame, s: Sizes, k_target: int = 50, shrinkage: float = 1.0) -> DataFrame:
    """k from the common rows inside the radius of the k_target-th rare one, drawn to r (F8)."""
    k_t = F.least(F.lit(min(k_target, s.k_min_eff)), F.size("dmin"))
    inside = within(F.col("dmaj"), F.get("dmin", k_t - 1))
    k = (inside + shrinkage * k_t * s.r) / (k_t * (1 + shrinkage))
    return decided(df, share(votes(F.col("dmin"), F.col("dmaj"), k, s.n_votes)))


def density_k_maj(s: Sizes, k_target: int = 50) -> int:
    """F8 needs a longer list of the common class, beyond the cap if need be."""
    return min(max(s.k_maj, -(-int(2 * min(k_target, s.k_min_eff) * s.n_maj) // max(1, s.n_min))), s.n_maj)


def odds(dmin: Column, dmaj: Column, probe: int, r: float, shrinkage: float = 1.0) -> Column:
    """k of L1: the median over i of the common rows inside the i-th rare radius by i, drawn to r."""
    ratios = F.array_sort(F.transform(F.slice(dmin, 1, probe), lambda d, i: within(dmaj, d) / (i + 1)))
    middle = F.get(F.transform(F.array(ratios), lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2), F.lit(0))
    return (middle + shrinkage * r) / (1 + shrinkage)


def by_local_odds(df: DataFrame, s: Sizes, shrinkage: float = 1.0) -> DataFrame:
    k = odds(F.col("dmin"), F.col("dmaj"), s.k_min_eff, s.r, shrinkage)
    return decided(df.withColumn("k", k), share(votes(F.col("dmin"), F.col("dmaj"), F.col("k"), s.n_votes)))


def reference_count(s: Sizes) -> int:
    return min(max(3, int(s.n_min**0.5)), s.n_min)


def by_reference(df: DataFrame, s: Sizes, n_votes: int) -> DataFrame:
    """df, as class_lists gives it, with ref, the place of the reference rare row, local, all common rows inside its radius, and what n_votes votes need."""
    ref = reference_count(s)
    own = df.counting([*range(1, n_votes + 1), max(1, ref)])
    return own.withColumns({"ref": F.greatest(F.least(F.lit(ref), F.col("rare")), F.lit(1)), "local": F.get("inside", F.lit(n_votes))})


def by_local_count(df: DataFrame, s: Sizes) -> DataFrame:
    """k: the common rows inside the radius of the reference rare row, by its rank (L2)."""
    own = by_reference(df, s, s.n_votes)
    return decided(own, share(counted_votes(F.col("rare"), F.col("inside"), s.n_maj, F.col("local") / F.col("ref"), s.n_votes)))


def bayesian(df: DataFrame, s: Sizes, alpha: float, n_votes: int) -> DataFrame:
    """The exponent between the selected one and that of the local count, by how much each is worth (L3)."""
    df, ref, local = by_reference(df, s, n_votes), F.col("ref"), F.col("local")
    w = ref / (ref + local)
    own = F.when((local > 0) & F.lit(s.r > 1), w * alpha + (1 - w) * F.ln(local / ref) / F.ln(F.lit(s.r))).otherwise(F.lit(float(alpha)))
    return decided(df.withColumn("k", F.pow(F.lit(s.r), own)), share(counted_votes(F.col("rare"), F.col("inside"), s.n_maj, F.col("k"), n_votes)))


def left_out(df: DataFrame, s: Sizes, kind: str = "single", probe: int | None = None, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Fractions averaged over leaving each of the nearest rare rows out: single (R1), grid (R2) or odds.

    A row per query and trial; too few rare rows make one trial that leaves out none.
    """
    if probe is None:
        probe = s.k_min_eff if kind == "odds" else s.n_votes
    trials = min(probe, max(0, s.k_min_eff - s.n_votes))
    full = F.array(F.lit(0))
    each = df.withColumn("j", F.explode(F.when(F.size("dmin") > s.n_votes, F.array(*map(F.lit, range(1, trials + 1))) if trials else full).otherwise(full)))
    rest = F.when(F.col("j") == 0, F.col("dmin")).otherwise(F.concat(F.slice("dmin", 1, F.col("j") - 1), F.slice("dmin", F.col("j") + 1, F.greatest(F.size("dmin"), F.lit(1)))))
    each = each.withColumn("dmin", rest)
    if kind == "grid":
        got = [votes(F.col("dmin"), F.col("dmaj"), power(s, a), s.n_votes) for a in alphas]
        frac = sum(v["wins"] for v in got) / F.greatest(sum(v["n"] for v in got), F.lit(1))
    else:
        k = odds(F.col("dmin"), F.col("dmaj"), s.k_min_eff, s.r) if kind == "odds" else F.lit(s.r)
        each = each.withColumn("k", k)
        frac = share(votes(F.col("dmin"), F.col("dmaj"), F.col("k"), s.n_votes))
    return decided(each.withColumn("f", frac).groupBy("id", "y").agg(F.avg("f").alias("f")), F.col("f"))


def lid(distances: Column) -> Column:
    """Levina-Bickel dimension from ascending distances (F4): zeros are dropped; under two give 1."""
    def of(d: Column) -> Column:
        last = F.ln(F.get(d, F.size(d) - 1))
        mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + (last - F.ln(x))) / (F.size(d) - 1)
        return F.when(F.size(d) < 2, 1.0).when(mean > 0, 1 / mean).otherwise(F.size(d).cast("double"))

    return F.get(F.transform(F.array(F.filter(distances, lambda x: x > 0)), of), F.lit(0))
