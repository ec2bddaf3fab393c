"""Effort levels and what they allow; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved(asked: Column, default: int, most: int) -> Column:
    return F.least(F.greatest(F.coalesce(asked, F.lit(default)), F.lit(1)), F.lit(most))


def fraction(level: Column, most: int) -> Column:
    return F.lit(1.0) if most <= 1 else (level - 1) / F.lit(float(most - 1))


def scaled(level: Column, most: int, low: int, span: int) -> Column:
    return (F.lit(low) + F.floor(fraction(level, most) * span + 0.5)).cast("int")


def profile(level: Column, most: int, base_timeout: float) -> dict[str, Column]:
    """Caps by level: depth and rounds of decoding, sheets and formulas, deeper PDF work, feeds, seconds."""
    f = fraction(level, most)
    timeout = F.lit(0.0) if base_timeout == 0 else F.greatest(F.lit(base_timeout) * (F.lit(0.5) + F.lit(0.5) * f), F.lit(1.0))
    return {
        "decode_depth": scaled(level, most, 1, 3),
        "decode_iters": scaled(level, most, 64, 192),
        "xlm_sheets": scaled(level, most, 4, 60),
        "xlm_formulas": scaled(level, most, 256, 3840),
        "pdf_deepen": f > 0.2,
        "feeds": f >= 0.5,
        "timeout_s": timeout,
    }


def auto_target(occupied: Column, capacity: Column, idle: int) -> Column:
    """The level for a load: idle when nothing runs, 1 when all is taken."""
    step = F.floor((F.least(F.greatest(occupied, F.lit(1)), capacity) - 1) * (idle - 1) / (capacity - 1) + 0.5)
    return F.when(capacity <= 1, F.lit(idle)).otherwise(F.greatest(F.lit(idle) - step, F.lit(1))).cast("int")


#: Symbols that force the highest level.
FORCING = ("R_SPF_FAIL", "R_SPF_SOFTFAIL", "DMARC_POLICY_REJECT", "R_DKIM_REJECT")


def sender_level(score: Column, symbols: Column, low: int = 1, most: int = 10, clean: float = 0.0, bad: float = 8.0) -> Column:
    """A mail score mapped onto levels, linear from ``clean`` to ``bad``; a forcing symbol gives the highest."""
    share = F.least(F.greatest((score - clean) / (bad - clean), F.lit(0.0)), F.lit(1.0))
    level = F.coalesce(F.floor(F.lit(low) + share * (most - low) + 0.5).cast("int"), F.lit(low))
    return F.when(F.coalesce(F.arrays_overlap(symbols, F.array(*map(F.lit, FORCING))), F.lit(False)), most).otherwise(level)


def stepped(level: Column, target: Column) -> Column:
    """One level towards the target; a level below 1 takes the target at once."""
    return F.when(level < 1, target).otherwise(level + F.signum(target - level).cast("int")).cast("int")
