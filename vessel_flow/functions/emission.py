"""Emission arithmetic (F3-F7) as Column expressions.

The evaluation order follows the reference so that doubles agree to the last
bits where possible: ``(TimeDiff * rate) * factor`` for stops and
``(rate * (distance / speed)) * factor`` for moves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def is_tanker(vessel_type: Column, p: Params) -> Column:
    return vessel_type.between(p.tanker_type_min, p.tanker_type_max)


def is_slow(sog: Column, p: Params) -> Column:
    """SOG < threshold; a missing SOG is not slow."""
    return F.coalesce(sog < F.lit(p.slow_sog), F.lit(False))


def mean_speed(sog: Column, next_sog: Column, p: Params) -> Column:
    """(SOG + next SOG) / 2; exactly 0 or missing -> floor speed."""
    m = (sog + next_sog) / 2
    return F.coalesce(F.nullif(m, F.lit(0.0)), F.lit(p.floor_speed))


def stop_emission(time_diff_h: Column, tanker: Column, p: Params) -> Column:
    """Berth emission in t CO2 for ``time_diff_h`` hours."""
    rate = F.when(tanker, F.lit(p.aux_rate(True))).otherwise(F.lit(p.aux_rate(False)))
    return (time_diff_h * rate) * F.lit(p.co2_factor)


def move_emission(distance_nm: Column, speed_kn: Column, tanker: Column, p: Params) -> Column:
    """Under-way emission in t CO2 for a leg."""
    rate = F.when(tanker, F.lit(p.main_rate(True))).otherwise(F.lit(p.main_rate(False)))
    return (rate * (distance_nm / speed_kn)) * F.lit(p.co2_factor)
