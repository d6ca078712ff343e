"""Zone labels from an x coordinate in the acting team's attacking view.

All bounds are strict, so a zone at x is not the mirror of the zone at -x, and
a missing x falls into the last class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.nulls import if_else


def _above(x: Column, steps, rest) -> Column:
    bound, label = steps[0]
    out = F.when(x > bound, label)
    for bound, label in steps[1:]:
        out = out.when(x > bound, label)
    return out.otherwise(rest)


def zone5(x: Column) -> Column:
    return _above(x, fixed.ZONE5_STEPS, fixed.ZONE5_REST)


def role(zone: Column, outcome: Column) -> Column:
    """Attacking or defending side; in the centre the outcome decides."""
    return (
        F.when(zone.isin(*fixed.ATTACKING_ZONES), fixed.ATTACKING_ROLE)
        .when(zone.isin(*fixed.DEFENDING_ZONES), fixed.DEFENDING_ROLE)
        .otherwise(if_else(outcome == fixed.WON, fixed.ATTACKING_ROLE, fixed.DEFENDING_ROLE))
    )


def zone_type(x: Column) -> Column:
    return _above(F.abs(x), fixed.ZONE_TYPE_STEPS, fixed.ZONE_TYPE_REST)


def winner_zone(x: Column) -> Column:
    return _above(x, fixed.WINNER_ZONE_STEPS, fixed.WINNER_ZONE_REST)


def start_zone(x: Column) -> Column:
    return _above(x, fixed.START_ZONE_STEPS, fixed.START_ZONE_REST)


def zone_level(x: Column) -> Column:
    return _above(x, fixed.ZONE_LEVEL_STEPS, fixed.ZONE_LEVEL_REST)


def mirror_zone(zone: Column) -> Column:
    """The same spot seen by the other team."""
    return (
        F.when(zone == fixed.OFFENSIVE, fixed.DEFENSIVE)
        .when(zone == fixed.DEFENSIVE, fixed.OFFENSIVE)
        .otherwise(fixed.NEUTRAL)
    )


def movement(final_x: Column) -> Column:
    """Zone in which a sequence ended."""
    return (
        F.when(final_x > 25, fixed.MOVED_OFFENSIVE)
        .when(final_x < -25, fixed.MOVED_DEFENSIVE)
        .otherwise(fixed.MOVED_MIDDLE)
    )
