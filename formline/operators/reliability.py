"""How reliable a statistic is: split halves, years, stabilisation by games and by denominator, intervals, tables.

Statistics become rows (unpivot), so a study of many statistics, targets or resamples is one plan grouped by them, never a loop of jobs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.functions import expr as X

#: Tasks that groups of pairs are dealt to for their resamples, which are much work on few bytes.
GROUP_TASKS = 200


def pearson(a: Column | str, b: Column | str, least: float = 1e-9, sample: bool = False) -> Column:
    """Aggregate: correlation of complete pairs; null below two pairs or if a standard deviation is under `least` (population, or sample)."""
    a, b = X.col(a), X.col(b)
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    n = F.count_if(both)
    spread = F.stddev_samp if sample else F.stddev_pop
    good = (n >= 2) & (F.coalesce(spread(x), F.lit(0.0)) >= least) & (F.coalesce(spread(y), F.lit(0.0)) >= least)
    return F.when(good, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def average_rank(x: Column | str, over: Sequence[Column | str]) -> Column:
    """Rank with ties at their mean."""
    ordered = Window.partitionBy(*over).orderBy(x)
    return F.rank().over(ordered) + (F.count("*").over(Window.partitionBy(*over, x)) - 1) / 2


def slope(x: Column | str, y: Column | str) -> Column:
    """Aggregate: least-squares slope of y on x; null if x does not vary."""
    return F.regr_slope(X.col(y), X.col(x))


def tier(r: Column) -> Column:
    return F.when(r.isNull() | F.isnan(r), "Unknown").when(r >= 0.7, "Tier 1").when(r >= 0.5, "Tier 2").otherwise("Tier 3")


def _moved(df: DataFrame, stats: Mapping[str, bool], player: str, pa: str = "PA") -> tuple[DataFrame, dict[str, bool]]:
    """(player, game_date, tie, weight, _v0, _v1, ...) in one exchange by player, and which statistics there are. Values that are not numbers are null."""
    have = {s: r for s, r in stats.items() if s in df.columns}
    tie = F.col("game_pk") if "game_pk" in df.columns else F.lit(0)
    weight = F.col(pa).cast("double") if pa in df.columns else F.lit(1.0)
    values = [F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, s in enumerate(have)]
    return df.select(F.col(player).alias("player"), "game_date", tie.alias("tie"), weight.alias("weight"), *values).repartition("player"), have


def _weighed(i: int) -> Column:
    """The weight where a statistic is known."""
    return F.when(F.col(f"_v{i}").isNotNull(), F.col("weight"))


def half_pairs(df: DataFrame, stats: Mapping[str, bool], windows: Sequence[int], player: str) -> DataFrame:
    """(stat, window, player, a, b): the first `window` rows of a statistic that are known against the next, for players with twice as many."""
    rows, have = _moved(df, stats, player)
    at = range(len(have))
    rates = [i for i, r in enumerate(have.values()) if r]
    upto = Window.partitionBy("player").orderBy("game_date", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "player", *[F.when(F.col(f"_v{i}").isNotNull(), F.count(f"_v{i}").over(upto)).alias(f"_k{i}") for i in at], *[F.sum(f"_v{i}").over(upto).alias(f"_s{i}") for i in at], *[F.sum(_weighed(i)).over(upto).alias(f"_w{i}") for i in rates]
    )
    # of each window the running sums at its end and at the end of the next one are enough: a row stands for few windows
    rows = rows.select("player", *[F.array(*[f"_{c}{i}" if c != "w" or i in rates else F.lit(None).cast("double") for i in at]).alias(c) for c in "ksw"])
    # the few places are found before the arrays are copied for each of them
    ends = {m * w for w in windows for m in (1, 2)}
    rows = rows.select("*", F.explode(F.filter(F.array(*[F.lit(i) for i in at]), lambda i: F.get("k", i).isin(*ends))).alias("i"))
    rows = rows.select("player", "i", *[F.get(c, F.col("i")).alias(n) for c, n in (("k", "rn"), ("s", "v"), ("w", "w"))])
    rows = rows.select("*", F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: (w == F.col("rn")) | (2 * w == F.col("rn")))).alias("window"))
    first, second = F.col("rn") == F.col("window"), F.col("rn") == 2 * F.col("window")
    pick = lambda c, m: F.max(F.when(m, F.col(c)))
    out = rows.groupBy("player", "i", "window").agg(*[pick(c, m).alias(f"{c}{i}") for c in "vw" for i, m in ((1, first), (2, second))]).where("v2 is not null")
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("i"))
    part = lambda v, w: F.when(of(have.values()), v / F.greatest(w, F.lit(1.0))).otherwise(v / F.col("window"))
    return out.select(of(have).alias("stat"), "window", "player", part(F.col("v1"), F.col("w1")).alias("a"), part(F.col("v2") - F.col("v1"), F.col("w2") - F.col("w1")).alias("b"))


def split_half(df: DataFrame, stats: Mapping[str, bool], window: int, player: str = "player_name", least: int = 50) -> DataFrame:
    """(stat, n, pearson, spearman, sem, slope); correlations null below `least` players or with hardly any spread (sample)."""
    out = _halves(half_pairs(df, stats, [window], player))
    enough = F.col("n") >= least
    return out.select("stat", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("pearson", "spearman")], F.when(enough, F.col("sd_samp") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("pearson")))).alias("sem"), F.when(enough, F.col("slope")).alias("slope"))


def _halves(pairs: DataFrame) -> DataFrame:
    """(stat, n, pearson, spearman, slope, sd_samp, sd_pop, icc2) of pairs (stat, a, b), in one pass after the ranks."""
    # running sums are not exact: what agrees to nine places is a tie
    ranked = pairs.withColumns({"qa": F.round("a", 9), "qb": F.round("b", 9)}).withColumns({"ra": average_rank("qa", ["stat"]), "rb": average_rank("qb", ["stat"])})
    out = ranked.groupBy("stat").agg(F.count("*").alias("n"), pearson("a", "b", 1e-6, True).alias("pearson"), pearson("ra", "rb").alias("spearman"), slope("a", "b").alias("slope"), F.stddev_samp("a").alias("sd_samp"), F.stddev_pop("a").alias("sd_pop"), *_mean_squares())
    return out.withColumn("icc2", _icc2())


def stabilization_curve(df: DataFrame, stats: Mapping[str, bool], windows: Sequence[int] = range(1, 40), player: str = "player_name", least: int = 50) -> DataFrame:
    """(stat, window, n, r) for every window at once; population spread under 1e-6 gives null."""
    pairs = half_pairs(df, stats, list(windows), player)
    out = pairs.groupBy("stat", "window").agg(F.count("*").alias("n"), pearson("a", "b", 1e-6).alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def year_over_year(df: DataFrame, stats: Mapping[str, bool], player: str = "player_name", least_pairs: int = 30, least_starts: int = 5) -> DataFrame:
    """(stat, n, yoy): a player's season against the next one, both of least_starts rows or more."""
    rows, have = _moved(df, stats, player)
    at = range(len(have))
    rows = rows.withColumn("season", F.year("game_date"))
    value = lambda i, r: F.sum(f"_v{i}") / F.greatest(F.sum(_weighed(i)), F.lit(1.0)) if r else F.avg(f"_v{i}")
    # tie is counted, though any count will do, so that the exchange is the one of half_pairs
    by = rows.groupBy("player", "season").agg(F.count("tie").alias("_t"), *[F.when(F.count(f"_v{i}") >= least_starts, value(i, r)).alias(f"_y{i}") for i, r in enumerate(have.values())]).where("_t >= 0")
    name = F.get(F.array(*[F.lit(s) for s in have]), F.col("i"))
    by = by.select("player", "season", F.posexplode(F.array(*[f"_y{i}" for i in at])).alias("i", "v")).where("v is not null")
    after = Window.partitionBy("player", "i").orderBy("season")
    both = by.select("player", name.alias("stat"), "v", (F.lead("season").over(after) == F.col("season") + 1).alias("next"), F.lead("v").over(after).alias("w")).where("next and player is not null")
    out = both.groupBy("stat").agg(F.count("*").alias("n"), pearson("v", "w").alias("yoy"))
    return out.withColumn("yoy", F.when(F.col("n") >= least_pairs, F.col("yoy")))


def _mean_squares() -> list[Column]:
    """Aggregates that _icc2 stands on."""
    return [F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp((F.col("a") + F.col("b")) / 2).alias("vm"), F.var_samp(F.col("a") - F.col("b")).alias("vd")]


def _icc2() -> Column:
    msr, mse = 2 * F.col("vm"), F.col("vd") / 2
    grand = (F.col("ma") + F.col("mb")) / 2
    msc = F.col("n") * ((F.col("ma") - grand) ** 2 + (F.col("mb") - grand) ** 2)
    return F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / F.col("n"))


def icc2(pairs: DataFrame, least: int = 50) -> DataFrame:
    """(stat, icc2) of pairs (stat, a, b): two-way random effects, single measures, for two ratings, from mean squares."""
    s = pairs.groupBy("stat").agg(F.count("*").alias("n"), *_mean_squares())
    return s.select("stat", F.when(F.col("n") >= least, _icc2()).alias("icc2"))


def reliability_table(df: DataFrame, stats: Mapping[str, bool], window: int = 10, player: str = "player_name", least: int = 50, least_pairs: int = 30, least_starts: int = 5) -> DataFrame:
    """One row a statistic: r, rho, icc2, yoy, sem (population spread), slope, n, tier; highest yoy first, nulls last."""
    enough = F.col("n") >= least
    halves = _halves(half_pairs(df, stats, [window], player)).select("stat", "n", "sd_pop", *[F.when(enough, F.col(c)).alias(c) for c in ("pearson", "spearman", "icc2", "slope")])
    out = halves.join(year_over_year(df, stats, player, least_pairs, least_starts).drop("n"), "stat", "left")
    out = out.withColumns({"sem": F.when(F.col("pearson").isNotNull(), F.col("sd_pop") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("pearson")))), "tier": tier(F.col("yoy"))})
    return out.select("stat", "pearson", "spearman", "icc2", "yoy", "sem", "slope", "n", "tier").orderBy(F.desc_nulls_last("yoy"), "stat")


def _passed(goals: Sequence[int], spec: int, den: int, before: Column, upto: Column, num: Column) -> Column:
    """The goals that a running sum passes in a row, with the sums there."""
    of = lambda t: F.struct(F.lit(spec).alias("spec"), F.lit(den).alias("den"), t.alias("target"), upto.alias("den1"), num.alias("num1"))
    return F.transform(F.filter(F.array(*[F.lit(t) for t in goals]), lambda t: (t > before) & (t <= upto)), of)


def denominator_pairs(df: DataFrame, plan: Mapping[tuple[str, str], bool], targets: Sequence[int] | Mapping[tuple[str, str], Sequence[int]], player: str = "player_name", strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, stat, denom, player, target, a, b): a player's rows up to the one that reaches the target denominator, against the next ones that reach it again.

    Buckets are told by row numbers, so rows of denominator 0 stay with the second. Measures (plan: False) are weighted by their denominator. strict: pairs with an empty
    denominator are left out instead of dividing by 1. targets: the same for all of the plan, or each one's own. by: columns whose values are studied apart.
    """
    have = _there(df, plan)
    return _pairs_of(_hashed(df, have, player, by), df, have, targets, strict, by)


def _there(df: DataFrame, plan: Mapping[tuple[str, str], bool]) -> list[tuple[str, str, bool]]:
    return [(s, d, r) for (s, d), r in plan.items() if s in df.columns and d in df.columns]


def _hashed(df: DataFrame, have: Sequence[tuple[str, str, bool]], player: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, player, game_date, tie, statistics and denominators, _h) in one exchange, by a number that stands for the player: the id itself where it is one, as it packs better than a hash."""
    tie = F.col("game_pk") if "game_pk" in df.columns else F.lit(0)
    rows = df.select(*by, F.col(player).alias("player"), "game_date", tie.alias("tie"), *dict.fromkeys(c for s, d, _ in have for c in (s, d)))
    number = not by and isinstance(rows.schema["player"].dataType, T.IntegralType)
    return rows.withColumn("_h", F.coalesce(F.col("player").cast("long"), F.lit(0)) if number else F.xxhash64(F.lit(1), *by, "player")).repartition("_h")


def _pairs_of(hashed: DataFrame, df: DataFrame, have: Sequence[tuple[str, str, bool]], targets: Sequence[int] | Mapping[tuple[str, str], Sequence[int]], strict: bool, by: Sequence[str]) -> DataFrame:
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    sure = {f.name for f in df.schema.fields if not f.nullable} & whole
    key = [*by, "player"]
    known = lambda s, d: F.col(s).isNotNull() & F.col(d).isNotNull() & ~F.isnan(F.col(s).cast("double")) & ~F.isnan(F.col(d).cast("double"))
    # statistics that have no nulls share the running sums of their denominator
    dens = list(dict.fromkeys((s if s not in sure else "", d) for s, d, _ in have))
    den = [dens.index((s if s not in sure else "", d)) for s, d, _ in have]
    value = {f"_d{i}": F.when(known(s or d, d), F.col(d).cast("double")).otherwise(0.0) for i, (s, d) in enumerate(dens)}
    value |= {f"_n{i}": F.when(known(s, d), (F.col(s) * (F.lit(1.0) if r else F.col(d))).cast("double")).otherwise(0.0) for i, (s, d, r) in enumerate(have)}
    order = Window.partitionBy("_h", *key).orderBy("game_date", "tie")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = hashed.select("_h", *key, "game_date", "tie", *[c.alias(n) for n, c in value.items()])
    # sums of doubles before a row are taken as they were there, not by subtraction
    ahead = lambda i, d: F.col(f"_c{i}") - F.col(f"_d{i}") if d in whole else F.coalesce(F.col(f"_p{i}"), F.lit(0.0))
    rows = rows.select(
        "_h", *key, *[f"_d{i}" for i in range(len(dens))], *[F.sum(f"_d{i}").over(upto).alias(f"_c{i}") for i in range(len(dens))], *[F.sum(f"_d{i}").over(before).alias(f"_p{i}") for i, (_, d) in enumerate(dens) if d not in whole],
        *[F.sum(f"_n{i}").over(upto).alias(f"_s{i}") for i in range(len(have))],
    )
    rows = rows.select("_h", *key, F.array(*[f"_c{i}" for i in range(len(dens))]).alias("c"), F.array(*[ahead(i, d) for i, (_, d) in enumerate(dens)]).alias("p"), F.array(*[f"_s{i}" for i in range(len(have))]).alias("s"))
    # a target is first reached by the one row whose running sum passes it; all targets are multiples of a step, and most rows pass none
    goals = [sorted({int(t) for t in (targets[s, d] if isinstance(targets, Mapping) else targets)}) for s, d, _ in have]
    step = [min(float(math.gcd(*g)) for g, j in zip(goals, den, strict=True) if j == i) for i in range(len(dens))]
    c, p = (lambda i: F.get("c", F.lit(i))), (lambda i: F.get("p", F.lit(i)))
    passing = [F.floor(c(i) / x) > F.floor(p(i) / x) for i, x in enumerate(step)]
    found = [F.when(passing[j], _passed(g, i, j, p(j), c(j), F.get("s", F.lit(i)))).otherwise(F.array()) for i, (g, j) in enumerate(zip(goals, den, strict=True))]
    one = rows.where(reduce(or_, passing)).select(F.col("_h").alias("_g"), *[F.col(k).alias(f"_of_{k}") for k in key], F.explode(F.flatten(F.array(*found))).alias("w"))
    one = one.select(*one.columns[:-1], "w.*").withColumn("at", F.col("den1") + F.col("target"))
    # where it is reached again: the one row whose running sum passes den1 + target
    again = (F.col("at") <= F.get("c", F.col("den"))) & (F.col("at") > F.get("p", F.col("den")))
    # equal or both null, in a form that is no key of the join: both sides stand by their hash already
    same = [F.coalesce(F.col(k) == F.col(f"_of_{k}"), F.col(k).isNull() & F.col(f"_of_{k}").isNull()) for k in key]
    both = rows.join(one, reduce(and_, same, (F.col("_h") == F.col("_g")) & again))
    name = lambda i: F.get(F.array(*[F.lit(h[i]) for h in have]), F.col("spec"))
    sums = both.select(*key, name(0).alias("stat"), name(1).alias("denom"), "target", "den1", "num1", (F.get("c", F.col("den")) - F.col("den1")).alias("den2"), (F.get("s", F.col("spec")) - F.col("num1")).alias("num2"))
    if strict:
        sums = sums.where("den1 > 0 and den2 > 0")
    part = lambda i: (F.col(f"num{i}") / F.greatest(F.col(f"den{i}"), F.lit(1e-300 if strict else 1.0)))
    return sums.select(*by, "stat", "denom", "player", "target", part(1).alias("a"), part(2).alias("b"))


def stabilization_by_denominator(df: DataFrame, plan: Mapping[tuple[str, str], bool], targets: Sequence[int], player: str = "player_name", least: int = 50) -> DataFrame:
    """(stat, denom, target, n, r)."""
    out = denominator_pairs(df, plan, targets, player).groupBy("stat", "denom", "target").agg(F.count("*").alias("n"), pearson("a", "b").alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def bootstrap(pairs: DataFrame, n_boot: int = 300, least: int = 20, seed: int = 42, by: Sequence[str] = ("stat", "denom")) -> DataFrame:
    """(by, target, median, low, high, valid): quantiles of r over resamples of players, duplicates kept.

    Each resample draws as many players as there are, by a hash of seed, resample and place, so reruns agree. Resamples are rows, all at
    once; a draw meets its player by its place in the group's array.
    """
    groups = _grouped(pairs, [*by, "target"], F.lit(None).cast("double").alias("r"))
    return _resampled(groups, [*by, "target"], n_boot, least, seed).drop("n", "r")


def _grouped(pairs: DataFrame, group: Sequence[str], r: Column) -> DataFrame:
    """(group, n, r, x): the pairs of each group as one array, in the players' order."""
    # each group is its own piece of work, many resamples of few bytes
    return pairs.repartition(GROUP_TASKS, *group).groupBy(*group).agg(F.count("*").alias("n"), r, F.sort_array(F.collect_list(F.struct("player", "a", "b"))).alias("x"))


def _resampled(groups: DataFrame, group: Sequence[str], n_boot: int, least: int, seed: int = 42) -> DataFrame:
    """(group, n, r, median, low, high, valid). Draws find their players by place in the group's array, so only sums over whole resamples are exchanged."""
    arrays = groups.select(*group, "n", "r", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    tried = arrays.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")).select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "boot", "i"), F.col("n")).cast("int")
    tried = tried.select(*group, "n", "r", "boot", F.get("a", draw).alias("a"), F.get("b", draw).alias("b"))
    a, b = F.col("a"), F.col("b")
    m = tried.groupBy(*group, "n", "r", "boot").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate((a, b, a * a, b * b, a * b))])
    va, vb = (F.col(f"s{i + 2}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) ** 2 for i in (0, 1))
    cov = F.col("s4") / F.col("n") - F.col("s0") * F.col("s1") / F.col("n") ** 2
    good = (F.col("n") >= least) & (va > 1e-15) & (vb > 1e-15)
    q = m.select(*group, "n", "r", F.when(good, cov / F.sqrt(va * vb)).alias("q")).groupBy(*group, "n", "r")
    return q.agg(F.percentile("q", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"), F.count("q").alias("valid")).select(*group, "n", "r", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("median", "low", "high"))], "valid")


def study(df: DataFrame, specs: Mapping[str, tuple[str, str, Sequence[int]]], player: str = "player_name", by: Sequence[str] = (), least: int = 50) -> DataFrame:
    """(by, stat, denom, crossings of r, low and high): counts over denominators, each up to targets of its own, with intervals over resamples of players."""
    targets = {(num, den): goals for num, den, goals in specs.values()}
    plan, key = dict.fromkeys(targets, True), [*by, "stat", "denom"]
    # where a positive target is reached no denominator is empty: strict pairs and others are the same
    groups = _grouped(denominator_pairs(df, plan, targets, player, strict=True, by=by), [*key, "target"], F.when(F.count("*") >= least, pearson("a", "b")).alias("r"))
    return crossings(_resampled(groups, [*key, "target"], 300, 20), key, least)


def curves(df: DataFrame, specs: Mapping[str, tuple[str, str, Sequence[int]]], player: str = "player_name", by: Sequence[str] = (), n_boot: int = 300, least: int = 50) -> DataFrame:
    """(by, stat, denom, target, observed_r, n_qualified_players, median, low, high, valid, median_denominator, typical_starts): the study's curve of each statistic at each target."""
    targets = {(num, den): goals for num, den, goals in specs.values()}
    plan, key = dict.fromkeys(targets, True), [*by, "stat", "denom"]
    have = _there(df, plan)
    hashed = _hashed(df, have, player, by)
    groups = _grouped(_pairs_of(hashed, df, have, targets, True, by), [*key, "target"], F.when(F.count("*") >= least, pearson("a", "b")).alias("r"))
    denominators = F.array(*[F.struct(F.lit(d).alias("denom"), F.col(d).cast("double").alias("x")) for d in dict.fromkeys(d for _, d, _ in have)])
    # all columns are read, though few will do, so that the exchange is the one of the pairs and the games are not made again
    counted = hashed.select(*by, F.xxhash64(*hashed.columns).alias("_all"), F.explode(denominators).alias("d")).groupBy(*by, "d.denom", "d.x").agg(F.count("*").alias("times"), F.max("_all").alias("_all")).where("_all is not null")
    median = counted.groupBy(*by, "denom").agg(F.percentile("x", 0.5, F.col("times")).alias("median_denominator"))
    out = _resampled(groups, [*key, "target"], n_boot, 20).withColumnsRenamed({"n": "n_qualified_players", "r": "observed_r"}).join(median, [*by, "denom"], "left")
    return out.withColumn("typical_starts", F.try_divide("target", "median_denominator")).select(*key, "target", "observed_r", "n_qualified_players", "median", "low", "high", "valid", "median_denominator", "typical_starts")


def analyze(curve: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = (0.5, 0.7)) -> DataFrame:
    """Of each statistic of curves() and each threshold: the first targets at which median, lower and upper bound reach it, the players there, and whether
    the lower bound does with 50 of them."""
    rows = curve.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    first = lambda c: F.min(F.when(F.col(c) >= F.col("threshold"), F.struct("target", "n_qualified_players")))
    names = {"median": "median", "ci_low": "low", "ci_high": "high"}
    out = rows.groupBy(*by, "stat", "denom", "threshold").agg(*[first(c).alias(f"_{n}") for n, c in names.items()], F.first("median_denominator").alias("median_denominator"))
    return out.select(
        *by, "stat", "denom", "threshold",
        *[F.col(f"_{n}.target").alias(f"{n}_crossing") for n in names],
        *[F.col(f"_{n}.n_qualified_players").alias(f"qualified_at_{n}_crossing") for n in names],
        F.coalesce(F.col("_ci_low.n_qualified_players") >= 50, F.lit(False)).alias("reliably_estimable"),
        "median_denominator",
        F.try_divide("_median.target", "median_denominator").alias("typical_starts_at_median_crossing"),
    )


def qualifiers(df: DataFrame, denom: str, targets: Sequence[int], player: str) -> DataFrame:
    """(target, ever, twice): players whose running denominator reaches a target, and those whose whole one reaches it twice over."""
    whole = df.groupBy(player).agg(F.sum(denom).alias("total"))
    rows = whole.select("total", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    return rows.groupBy("target").agg(F.count_if(F.col("total") >= F.col("target")).alias("ever"), F.count_if(F.col("total") >= 2 * F.col("target")).alias("twice"))


def crossings(curve: DataFrame, by: Sequence[str] = ("stat", "denom"), least: int = 50) -> DataFrame:
    """curve(by, target, r, n and, if there, low, high): first targets at which each reaches .5 and .7, and whether the lower bound ever does with enough players."""
    have = [c for c in ("r", "low", "high") if c in curve.columns]
    first = lambda c, t: F.min(F.when(F.col(c) >= t, F.col("target")))
    low = "low" if "low" in have else "r"
    return curve.groupBy(*by).agg(
        *[first(c, t).alias(f"{c}_{int(t * 100)}") for c in have for t in (0.5, 0.7)],
        F.coalesce(F.max((F.col(low) >= 0.5) & (F.col("n") >= least)), F.lit(False)).alias("reliably_estimable"),
    )


def correlations(df: DataFrame, names: Sequence[str], least: int = 100) -> DataFrame:
    """(a, b, n, r) of every pair of columns over complete rows, `least` or more: one aggregate for all pairs, strongest first."""
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in pairs])
    found = df.select(F.explode(rows).alias("p")).select("p.*").where("x is not null and y is not null")
    out = found.groupBy("a", "b").agg(F.count("*").alias("n"), pearson("x", "y").alias("r")).where(F.col("n") >= least)
    return out.orderBy(F.desc_nulls_last(F.abs("r")), "a", "b")


def audit(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """(column, missing, skew, r): share of nulls, skewness and correlation with a target of each column, most missing first."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names])
    y = F.col(target).cast("double") if target else F.lit(None).cast("double")
    out = df.select(y.alias("y"), F.explode(rows).alias("p")).select("y", "p.*").groupBy("column")
    skew = F.when(F.coalesce(F.stddev_pop("x"), F.lit(0.0)) > 1e-12, F.skewness("x"))
    return out.agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"), skew.alias("skew"), pearson("x", "y").alias("r")).orderBy(F.desc("missing"), "column")


def pitch_type_summary(games: DataFrame) -> DataFrame:
    """Pooled counts of each pitch type and their ratios, most pitches first."""
    counts = ("Pitches", "TotalPitches", "Whiffs", "Swings", "Balls", "CSW", "Chases", "OutZone", "GB", "BIP", "HardHit", "EV_den", "Barrels", "WeakContact", "xBA_den", "wOBA_num", "wOBA_den", "xwOBA_num", "EV_num")
    ratios = {
        "usage_rate": ("Pitches", "TotalPitches"), "swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"), "ball_rate": ("Balls", "Pitches"), "csw_rate": ("CSW", "Pitches"), "chase_rate": ("Chases", "OutZone"),
        "gb_rate": ("GB", "BIP"), "hard_hit_rate": ("HardHit", "EV_den"), "barrel_rate": ("Barrels", "xBA_den"), "weak_contact_rate": ("WeakContact", "xBA_den"), "xwOBA": ("xwOBA_num", "wOBA_den"),
    }
    out = games.groupBy("pitch_type").agg(*[F.sum(c).alias(c) for c in counts])
    return out.select("pitch_type", "Pitches", *[F.try_divide(a, b).alias(n) for n, (a, b) in ((k, (F.col(x), F.col(y))) for k, (x, y) in ratios.items())]).orderBy(F.desc("Pitches"), "pitch_type")
