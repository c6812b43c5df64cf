"""

Correlations are grouped aggregations; no group is ever collected into one
task. Spearman's average ranks come from a distributed ordering of the
*distinct* values per group (:func:`average_ranks`), and the correlation of
ranks is a weighted sum over ``(x, y, count)`` rows, so a metric that is
constant on a third of the pairs is one row, not a third of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators.joins import sized_broadcast_join, split_lookup
from quillmark.operators.ranking import global_position
from quillmark.session import cut_lineage

# Fixed analysis settings (ours): strength cuts on |r| and the masking
# threshold on orientation-adjusted r.
STRENGTH_CUTS = (0.1, 0.3, 0.5)
STRENGTH_NAMES = ("negligible", "weak", "moderate", "strong")
MASKING_THRESHOLD = -0.1


def guarded_pearson(x: str, y: str) -> Column:
    """``covar_pop / (stddev_pop * stddev_pop)``; NULL for a constant column
    (``corr`` raises under ANSI mode)."""
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(F.covar_pop(x, y) / den)


def average_ranks(obs: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """``(*groups, value, out)``: 1-based average rank (ties share the mean of
    their positions) of each distinct ``value`` within its group."""
    d = obs.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    pos = global_position(d, [F.col(g).asc() for g in groups] + [F.col(value).asc()], weight="_c")
    first = pos.groupBy(*groups).agg(F.min("_start").alias("_g0"))
    # One row a group: matched map-side where they are few, else dealt by the value too.
    r = sized_broadcast_join(pos, first, groups, salt_by=[value])
    rank = (F.col("_start") - F.col("_g0")).cast("double") + (F.col("_c") + 1) / 2.0
    return r.select(*groups, value, rank.alias(out))


def correlations(obs: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """``(*groups, n, pearson, spearman)`` of ``x`` against ``y`` per group.

    ``obs`` is read four times (Pearson, cells, two rank tables), so it is
    written once to the shared checkpoint folder instead of re-running the
    metric jobs behind it.
    """
    obs = cut_lineage(obs.select(*groups, x, y))
    pear = obs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                    tx.r6(guarded_pearson(x, y)).alias("pearson"))
    cell = cut_lineage(obs.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_k")))
    rx = average_ranks(obs, groups, x, "_rx")
    ry = average_ranks(obs, groups, y, "_ry")
    # Few values of ``x`` or ``y`` may hold most cells: hot ones are matched map-side.
    c = split_lookup(cell, rx, groups + [x], ["_rx"], probe=cell)
    c = split_lookup(c, ry, groups + [y], ["_ry"], probe=cell)
    k = F.col("_k").cast("double")
    s = c.groupBy(*groups).agg(
        F.sum(k).alias("n_"), F.sum(k * F.col("_rx")).alias("sx"), F.sum(k * F.col("_ry")).alias("sy"),
        F.sum(k * F.col("_rx") * F.col("_rx")).alias("sxx"),
        F.sum(k * F.col("_ry") * F.col("_ry")).alias("syy"),
        F.sum(k * F.col("_rx") * F.col("_ry")).alias("sxy"))
    cov = F.col("n_") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("n_") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n_") * F.col("syy") - F.col("sy") * F.col("sy")
    rho = F.when((vx <= 0) | (vy <= 0), F.lit(None).cast("double")).otherwise(cov / F.sqrt(vx * vy))
    sp = s.select(*groups, tx.r6(rho).alias("spearman"))
    return pear.join(sp, groups)


def long_scores(scores: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """``(key, metric, value)`` for the chosen score columns, NULLs dropped."""
    u = scores.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        key, metrics, "metric", "value")
    return u.where(F.col("value").isNotNull())


def metric_error_correlation(scores: DataFrame, ann: DataFrame, metrics: list[str],
                             key: str = "pair_id") -> DataFrame:
    """ANA-1: each metric against each error type's presence."""
    obs = long_scores(scores, key, metrics).join(ann.select(key, "error_type", "present"), key)
    return correlations(obs, ["metric", "error_type"], "value", "present")


def metric_impact_correlation(scores: DataFrame, ann: DataFrame, metrics: list[str],
                              key: str = "pair_id") -> DataFrame:
    """ANA-2: each metric against error severity, per error type."""
    obs = long_scores(scores, key, metrics).join(ann.select(key, "error_type", "severity"), key)
    return correlations(obs, ["metric", "error_type"], "value", "severity")


def challenge_error_link(chal: DataFrame, ann: DataFrame, groups: DataFrame,
                         key: str = "pair_id", by: str = "arch") -> DataFrame:
    """ANA-3: how challenges link to errors, per ``by`` (model architecture).

    Per (by, challenge, error): n, pairs with the challenge / error / both,
    ``P(error | challenge)``, base rate, lift and the phi coefficient.
    """
    c = chal.select(key, "challenge", F.col("present").alias("c"))
    e = ann.select(key, "error_type", F.col("present").alias("e"))
    j = c.join(e, key).join(groups.select(key, by), key)
    g = j.groupBy(by, "challenge", "error_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("c").cast("long").alias("n_chal"),
        F.sum("e").cast("long").alias("n_err"),
        F.sum(F.col("c") * F.col("e")).cast("long").alias("n_both"))
    n, nc, ne, nb = (F.col(x).cast("double") for x in ("n", "n_chal", "n_err", "n_both"))
    p_err_chal = F.when(nc > 0, nb / nc)
    base = F.when(n > 0, ne / n)
    lift = F.when((nc > 0) & (ne > 0), (nb / nc) / (ne / n))
    n11, n10, n01 = nb, nc - nb, ne - nb
    n00 = n - nc - ne + nb
    den = nc * (n - nc) * ne * (n - ne)
    phi = F.when(den > 0, (n11 * n00 - n10 * n01) / F.sqrt(den))
    return g.select(by, "challenge", "error_type", "n", "n_chal", "n_err", "n_both",
                    tx.r6(p_err_chal).alias("p_err_given_chal"), tx.r6(base).alias("base_rate"),
                    tx.r6(lift).alias("lift"), tx.r6(phi).alias("phi"))


def error_masking_flags(corr: DataFrame, orientation: dict[str, int], col: str = "pearson",
                        threshold: float = MASKING_THRESHOLD) -> DataFrame:
    """ANA-4: a metric masks an error when its orientation-adjusted correlation
    with the error is near zero or positive (``> threshold``)."""
    o = F.lit(1)
    for m, sign in orientation.items():
        o = F.when(F.col("metric") == m, F.lit(sign)).otherwise(o)
    oriented = F.col(col) * o
    return corr.select("metric", "error_type", col, tx.r6(oriented).alias("oriented_r"),
                       F.when(F.col(col).isNull(), F.lit(None).cast("boolean"))
                        .otherwise(oriented > threshold).alias("masked"))


def strength_label(c: Column, cuts=STRENGTH_CUTS, names=STRENGTH_NAMES) -> Column:
    a = F.abs(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(a < cut, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def strength_labels(corr: DataFrame, cols=("pearson", "spearman")) -> DataFrame:
    """ANA-5: negligible / weak / moderate / strong on ``|r|``."""
    return corr.select("metric", "error_type", *cols,
                       *[strength_label(F.col(c)).alias(f"{c}_strength") for c in cols])


def composite_score(scores: DataFrame, weights: dict[str, float], key: str = "pair_id",
                    out: str = "composite") -> DataFrame:
    """ANA-6: weighted sum of per-metric z-scores over the run.

    The run statistics are one aggregate row (two numbers per metric,
    computed by one partial aggregation) and enter the projection as
    literals: no join, nothing that grows with the data reaches the driver.
    Scores are read twice, so their few numbers a row are written once instead
    of running the metric jobs behind them again.
    """
    scores = cut_lineage(scores.select(key, *weights))
    row = scores.agg(*[c for m in weights for c in (
        F.avg(m).alias(f"mu_{m}"), F.stddev_pop(m).alias(f"sd_{m}"))]).first()
    terms = []
    for m, w in weights.items():
        mu, sd = row[f"mu_{m}"], row[f"sd_{m}"]
        z = (F.col(m) - F.lit(mu)) / F.lit(sd) if sd else F.lit(0.0)
        terms.append(F.lit(float(w)) * z)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return scores.select(key, tx.r6(total).alias(out))


def error_rates_by_system(ann: DataFrame, systems: DataFrame, error_types: list[str],
                          key: str = "pair_id") -> DataFrame:
    """ANA-7: error incidence per system (and its architecture), one column
    per error type (pivot values given, so no extra distinct job)."""
    j = ann.join(systems.select(key, "system", "arch"), key)
    return j.groupBy("system", "arch").pivot("error_type", error_types).agg(
        tx.r6(F.avg("present")))


def previous_in_order(df: DataFrame, key: str, order: str, col: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``col`` of the row before, in ``order``, of the same ``key`` (null: first).

    Rows are range-partitioned by ``(key, order)``, so one key with a third of
    all rows lies in many tasks. Within a range the row before is a step back;
    the first row of a range takes the last row of the range before, one row a
    range being carried over.
    """
    s = cut_lineage(df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn(
        "_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    inside = Window.partitionBy("_pid").orderBy("_mid")
    # One row a range: as many as partitions.
    ends = s.groupBy("_pid").agg(F.max_by(F.struct(key, col), "_mid").alias("_end"))
    ends = ends.select((F.lead("_pid").over(Window.orderBy("_pid"))).alias("_pid"), "_end").where(F.col("_pid").isNotNull())
    j = s.withColumn("_back", F.lag(F.struct(key, col)).over(inside)).join(F.broadcast(ends), "_pid", "left")
    back = F.coalesce("_back", "_end")
    return j.withColumn(out, F.when(back[key].eqNullSafe(F.col(key)) & back.isNotNull(), back[col])).drop(
        "_pid", "_mid", "_back", "_end")


def turn_challenges(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """ANA-8: speaker-dynamics features per conversation.

    ``turns``, distinct ``speakers``, ``switches`` (consecutive turns with a
    different role) and mean tokens per turn. The previous turn is the one
    before it in turn order, whatever numbers are missing between them. No task
    needs a whole conversation: turns are ordered over ranges and the features
    are partial aggregates.
    """
    t = turns.select(key, "turn", "role", F.size(tx.tok("text")).alias("ntok"))
    j = previous_in_order(t, key, "turn", "role", "prev_role")
    sw = F.when(F.col("prev_role").isNotNull() & (F.col("prev_role") != F.col("role")), 1).otherwise(0)
    return j.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_distinct("role").alias("speakers"),
        F.sum(sw).cast("long").alias("switches"),
        tx.r6(F.avg("ntok")).alias("mean_tokens_per_turn"))
