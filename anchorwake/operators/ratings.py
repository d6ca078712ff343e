"""Per-player leaderboards and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.nulls import strict_mean, strict_sum
from anchorwake.operators.ordering import fits_one_block, quantiles, with_average_rank

EXTREME_COLUMNS = ("playerid", "total_faceoffs", "raw_win_rate", "bayes_win_rate", "FIS_per_fo")
EXPORT_COLUMNS = (
    "playerid", "total_faceoffs", "wins", "losses", "raw_win_rate", "bayes_win_rate",
    "lev_xg_gen", "lev_xg_con", "lev_terr", "FIS_xg", "FIS_terr", "FIS_per_fo",
    "avg_leverage", "quadrant",
)


def zone_totals(participants: DataFrame) -> DataFrame:
    """Every player's totals per zone, whatever the number of anchors."""
    won, leverage = F.col("won"), F.col("leverage")
    totals = participants.groupBy("player_zone", "playerid").agg(
        F.count("*").alias("n_fo"),
        F.count_if(won).alias("n_won"),
        (F.avg(won.cast("int")) * 100).alias("win_pct"),
        strict_sum(F.col("xg_for") * leverage, won).alias("xg_created"),
        strict_sum(F.col("xg_against") * leverage, ~won).alias("xg_conceded"),
    )
    score = (F.col("xg_created") - F.col("xg_conceded")) / F.col("n_fo")
    return totals.withColumn("impact_score", score)


def _enough(min_fo) -> Column:
    """Whether a row of zone totals reaches its zone's minimum."""
    if isinstance(min_fo, int):
        return F.col("n_fo") >= min_fo
    absent = [z for z in (fixed.OFFENSIVE, fixed.NEUTRAL, fixed.DEFENSIVE) if z not in min_fo]
    if absent:
        raise ValueError(f"min_fo has no minimum for {', '.join(absent)}")
    pairs = [F.lit(part) for item in min_fo.items() for part in item]
    return F.col("n_fo") >= F.create_map(*pairs)[F.col("player_zone")]


def qualified_totals(participants: DataFrame, min_fo=fixed.MIN_PER_ZONE) -> DataFrame:
    """Zone totals of the players with enough anchors in the zone, in no order."""
    return qualified(zone_totals(participants), min_fo)


def qualified(totals: DataFrame, min_fo=fixed.MIN_PER_ZONE) -> DataFrame:
    return totals.where(_enough(min_fo))


def impact_leaderboard(participants: DataFrame, min_fo=fixed.MIN_PER_ZONE) -> DataFrame:
    """Impact score per zone and player with enough anchors there, best first."""
    return qualified_totals(participants, min_fo).orderBy(
        "player_zone", F.desc("impact_score"), "playerid"
    )


def leaderboard_summary(participants: DataFrame, min_fo=fixed.MIN_PER_ZONE) -> DataFrame:
    """Per zone: participations, qualifying players and their mean win percentage."""
    return summary_of(zone_totals(participants), min_fo)


def summary_of(totals: DataFrame, min_fo=fixed.MIN_PER_ZONE) -> DataFrame:
    enough = F.coalesce(_enough(min_fo), F.lit(False))
    return totals.groupBy("player_zone").agg(
        F.sum("n_fo").alias("n_participations"),
        F.count_if(enough).alias("n_qualifying"),
        F.round(F.avg(F.when(enough, F.col("win_pct"))), 1).alias("avg_win_pct"),
    )


def player_ratings(
    participants: DataFrame,
    alpha: float = fixed.PRIOR_ALPHA,
    beta: float = fixed.PRIOR_BETA,
    territory_scale: float = fixed.TERRITORY_SCALE,
) -> DataFrame:
    """Counts, shrunk win rate and impact score of every player."""
    won, leverage = F.col("won"), F.col("leverage")
    players = participants.groupBy("playerid").agg(
        F.count("*").alias("total_faceoffs"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        strict_sum(F.col("xg_for") * leverage, won).alias("lev_xg_gen"),
        strict_sum(F.col("xg_against") * leverage, ~won).alias("lev_xg_con"),
        strict_sum(F.col("terr_delta") * leverage).alias("lev_terr"),
        strict_mean(leverage).alias("avg_leverage"),
    )
    n = F.col("total_faceoffs")
    return players.withColumns(
        {
            "raw_win_rate": F.col("wins") / n,
            "bayes_win_rate": (F.col("wins") + alpha) / (n + alpha + beta),
            "FIS_xg": (F.col("lev_xg_gen") - F.col("lev_xg_con")) / n,
            "FIS_terr": F.col("lev_terr") * territory_scale / n,
        }
    ).withColumn("FIS_per_fo", F.col("FIS_xg") + F.col("FIS_terr"))


def rated_players(players: DataFrame, min_fo: int = fixed.MIN_RATED) -> DataFrame:
    return players.where(F.col("total_faceoffs") >= min_fo)


def rating_counts(registry: DataFrame, rated: DataFrame) -> DataFrame:
    """One row: anchors in the registry and players with enough of them."""
    qualified = rated.agg(F.count("*")).scalar()
    return registry.agg(F.count("*").alias("n_registry")).withColumn("n_rated", qualified)


def rating_extremes(rated: DataFrame, k: int = fixed.PANEL_SIZE) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best and the ``k`` worst players, decimals rounded to 4 places."""
    shown = rated.select(*EXTREME_COLUMNS)
    rounded = shown.select(
        *[F.round(c, 4).alias(c) if kind == "double" else c for c, kind in shown.dtypes],
        F.col("FIS_per_fo").alias("_score"),
    )
    best = rounded.orderBy(F.desc_nulls_last("_score"), "playerid").limit(k)
    worst = rounded.orderBy(F.asc_nulls_last("_score"), "playerid").limit(k)
    return best.drop("_score"), worst.drop("_score")


def rank_correlation(rated: DataFrame) -> DataFrame:
    """Spearman correlation of raw and shrunk win rate with the impact score.

    Missing if any score is missing or a column does not vary. ``rated`` is read
    several times, so pass a materialised table.
    """
    names = {"raw_win_rate": "_raw", "bayes_win_rate": "_bayes", "FIS_per_fo": "_fis"}
    ranked = rated.select("playerid", *names)
    whole_table = fits_one_block(ranked)  # one check for all three ranks
    for value, name in names.items():
        ranked = with_average_rank(ranked, value, "playerid", name, whole_table)
    whole = F.count_if(F.col("FIS_per_fo").isNull()) == 0

    def correlation(a: str, b: str) -> Column:
        spread = F.stddev_pop(a) * F.stddev_pop(b)  # 0 where a column does not vary
        return F.when(whole, F.try_divide(F.covar_pop(a, b), spread))

    return ranked.agg(
        correlation("_raw", "_fis").alias("cor_raw"),
        correlation("_bayes", "_fis").alias("cor_bay"),
    )


def classify_players(rated: DataFrame, q: float = fixed.OUTLIER_QUANTILE) -> DataFrame:
    """Add the quadrant (median split) and whether the player is an outlier.

    ``rated`` is read several times, so pass a materialised table.
    """
    score, rate = F.col("FIS_per_fo"), F.col("raw_win_rate")
    size, lean = F.abs(score), F.abs(rate - 0.5)
    cuts = quantiles(
        rated,
        {
            "_score_mid": (score, 0.5),
            "_rate_mid": (rate, 0.5),
            "_size_cut": (size, q),
            "_lean_cut": (lean, q),
        },
        "playerid",
    )
    # The quantiles come back as one value, a struct.
    cut = cuts.select(F.struct("*")).scalar()
    good_rate = rate >= F.col("_cut._rate_mid")
    good_score = score >= F.col("_cut._score_mid")
    quadrant = (
        F.when(good_rate & good_score, fixed.HIGH_HIGH)
        .when(good_rate & ~good_score, fixed.HIGH_LOW)
        .when(~good_rate & good_score, fixed.LOW_HIGH)
        .otherwise(fixed.LOW_LOW)
    )
    outlier = (size > F.col("_cut._size_cut")) | (lean > F.col("_cut._lean_cut"))
    return rated.withColumn("_cut", cut).select(
        *rated.columns, quadrant.alias("quadrant"), outlier.alias("outlier")
    )


def ratings_export(classified: DataFrame) -> DataFrame:
    """The published table, best score first."""
    return classified.select(*EXPORT_COLUMNS).orderBy(F.desc_nulls_last("FIS_per_fo"), "playerid")
