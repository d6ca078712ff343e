"""The tables behind the leaderboard charts; nothing is drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.nulls import whole_number


def leaderboard_panel(
    board: DataFrame,
    score: str = "impact_score",
    by: Sequence[str] = ("player_zone",),
    k: int = fixed.PANEL_SIZE,
    tail: bool = False,
) -> DataFrame:
    """The ``k`` lowest and ``k`` highest scores per ``by``, lowest first.

    A player in both halves is shown with the lower one. ``tail=True`` takes the
    upper half from the end of the ascending list, so among equal scores it
    prefers the larger player id. Players without a score come after all others of
    either half, so they are seen only where a half is short; their sign is missing.
    """
    rising = [F.asc_nulls_last(score), F.asc("playerid")]
    falling = [F.desc_nulls_last(score), F.desc("playerid") if tail else F.asc("playerid")]

    def first(order, src: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return (
            board.withColumn("_place", place)
            .where(F.col("_place") <= k)
            .drop("_place")
            .withColumn("src", F.lit(src))
        )

    both = first(rising, "bottom").unionByName(first(falling, "top"))
    once = F.row_number().over(Window.partitionBy(*by, "playerid").orderBy("src"))
    panel = both.withColumn("_copy", once).where("_copy = 1").drop("_copy")
    group = Window.partitionBy(*by)  # at most 2k rows each
    lower = F.count_if(F.col("src") == "bottom").over(group)
    return panel.withColumns(
        {
            "display_pos": F.row_number().over(group.orderBy(F.asc_nulls_last(score), "src", "playerid")),
            "sign_class": F.when(F.col(score) >= 0, "positive").when(F.col(score) < 0, "negative"),
            "divider_pos": lower + F.lit(0.5).cast("double"),
        }
    )


def panel_annotations(
    panel: DataFrame,
    score: str = "impact_score",
    by: Sequence[str] = ("player_zone",),
    min_abs: float = fixed.MIN_ANNOTATED,
) -> DataFrame:
    """First, middle and last of each half, with the anchors needed per unit of score."""
    half = Window.partitionBy(*by, "src")
    size = F.count("*").over(half)
    place = F.row_number().over(half.orderBy("display_pos"))
    marked = panel.withColumns({"_size": size, "_place": place}).where(
        (F.col("_size") <= 3)
        | F.col("_place").isin(F.lit(1), F.ceil(F.col("_size") / 2), F.col("_size"))
    )
    per_unit = F.try_divide(F.lit(1.0), F.abs(F.col(score)))
    return (
        marked.where(F.abs(F.col(score)) >= min_abs)
        .withColumn("fo_label", whole_number(per_unit))
        .drop("_size", "_place")
    )


def win_labels(panel: DataFrame, win_pct: Column | None = None) -> DataFrame:
    """The panel with the text of each bar, e.g. ``53% win``."""
    share = F.col("win_pct") if win_pct is None else win_pct
    return panel.withColumn("win_label", F.concat(whole_number(share), F.lit("% win")))


def outlier_labels(classified: DataFrame) -> DataFrame:
    """Players that get a name in the scatter chart, with the point they belong to."""
    return classified.where("outlier").select(
        F.col("playerid").cast("string").alias("label"), "raw_win_rate", "FIS_per_fo", "quadrant"
    )
