"""Context weights of an anchor: score margin, period, strength and place.

Two profiles exist and differ on purpose: the zone report weighs every period
from 4 on as overtime and any uneven strength alike, the player jobs look the
values up and give 1.0 to whatever the tables do not list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.nulls import if_else


def margin_weight(score_diff: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(score_diff))


def _listed(key: Column, weights: dict) -> Column:
    pairs = [F.lit(part) for item in weights.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(fixed.DEFAULT_WEIGHT))


def leverage_weights(
    score_diff: Column, period: Column, manpower: Column, zone_type: Column
) -> dict[str, Column]:
    """The four weights of the zone report, by output column name."""
    overtime = period >= fixed.OVERTIME_PERIOD
    return {
        "score_weight": margin_weight(score_diff),
        "period_weight": F.when(overtime, fixed.PERIOD_WEIGHTS[fixed.OVERTIME_PERIOD]).otherwise(
            _listed(period, fixed.PERIOD_WEIGHTS)
        ),
        "manpower_weight": if_else(
            manpower == fixed.EVEN_STRENGTH, fixed.DEFAULT_WEIGHT, fixed.UNEVEN_WEIGHT
        ),
        "zone_weight": _listed(zone_type, fixed.ZONE_TYPE_WEIGHTS),
    }


def leverage_case(
    score_diff: Column, period: Column, manpower: Column, zone_type: Column
) -> Column:
    """Leverage in the zone report; missing when margin or strength is missing."""
    weights = list(leverage_weights(score_diff, period, manpower, zone_type).values())
    return weights[0] * weights[1] * weights[2] * weights[3]


def leverage_lookup(score_diff: Column, period: Column, manpower: Column, x: Column) -> Column:
    """Leverage in the player jobs; missing when margin or x is missing."""
    in_end_zone = F.abs(x) > fixed.END_ZONE_X
    return (
        margin_weight(score_diff)
        * _listed(period, fixed.PERIOD_WEIGHTS)
        * _listed(manpower, fixed.STRENGTH_WEIGHTS)
        * if_else(in_end_zone, fixed.END_ZONE_WEIGHT, fixed.DEFAULT_WEIGHT)
    )
