"""Scores, labels and text as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FPS = 30.0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once (an expression written twice is computed twice)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def usable_fps(fps: Column) -> Column:
    return F.when(fps > 0, fps).otherwise(F.lit(DEFAULT_FPS))


def frame_time(frame: Column, fps: Column) -> Column:
    """Seconds of a frame counted from 1, to the millisecond."""
    return F.round((frame - 1) / usable_fps(fps), 3)


def in_window(frame: Column, start: Column, end: Column) -> Column:
    """Whether a frame lies in a window whose ends may be null."""
    return (frame >= F.coalesce(start, F.lit(1))) & (end.isNull() | (frame <= end))


def time_penalty(overrun: Column, limit: Column) -> Column:
    """exp(-overrun / (limit - overrun)), and 0 from the limit on or for a limit of 0."""
    return F.when((limit <= 0) | (overrun >= limit), F.lit(0.0)).otherwise(F.exp(-overrun / (limit - overrun)))


def allowed_gap(pair_number: Column, threshold: float = 1.0, second: float | None = None) -> Column:
    return F.when(pair_number == 2, F.lit(float(2 * threshold if second is None else second))).otherwise(F.lit(float(threshold)))


def hesitation(gap: Column, allowed: Column) -> Column:
    over = F.greatest(F.lit(0.0), gap - allowed)
    return F.exp(-(over * over) / 0.5)


def hold(distance: Column) -> Column:
    """Score of a sample by its distance to the point that is held."""
    return F.exp(-(distance * distance) / 5000.0)


def wall_band(distance: Column, length: Column, near: float = 0.0, far: float = 1.0) -> Column:
    return F.when(distance < near * length, "too_close").when(distance > far * length, "too_far").otherwise("safe")


def relative_band(current: Column, other: Column) -> Column:
    """above, at, near or below the other score (null where either is missing)."""
    ratio = current / F.when(other != 0, other)
    by_ratio = F.when(ratio >= 1.0, "above").when(ratio >= 0.9, "at").when(ratio >= 0.7, "near").otherwise("below")
    by_zero = F.when(current == 0, "at").when(current > 0, "above").otherwise("below")
    missing = current.isNull() | other.isNull() | F.isnan(current) | F.isnan(other)
    return F.when(missing, F.lit(None).cast("string")).when(other == 0, by_zero).otherwise(by_ratio)


def comparison_sentence(current: Column, other: Column, tolerance: float = 0.05) -> Column:
    delta = current - other
    word = F.when(delta > tolerance, "above").when(delta < -tolerance, "below").otherwise("in line with")
    said = F.format_string("Your score of %.2f is %s the reference's %.2f.", current, word, other)
    return F.when(current.isNull() | other.isNull(), "Comparison not available for this metric.").otherwise(said)


def tokens(text: Column) -> Column:
    """Lower-case words of a-z, digits and '; everything else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]", " "), r"\s+"), lambda w: w != "")


def has_all(words: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in required]), words)) == 0 if required else F.lit(True)


def slug(text: Column, longest: int = 40) -> Column:
    """Letters, digits, _ and -, everything else one _; no _ at the ends; `untitled` if nothing is left."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return F.substring(F.when(s == "", "untitled").otherwise(s), 1, longest)


def run_id(role: Column, title: Column, created: Column) -> Column:
    return F.concat_ws("_", role, slug(title), F.date_format(created, "yyyyMMdd_HHmmss"))


def verdict(delta: Column, tolerance: float, better: str = "BETTER", worse: str = "WORSE", same: str = "SIMILAR") -> Column:
    return F.when(delta > tolerance, better).when(delta < -tolerance, worse).otherwise(same)


