"""Scores and their ladders as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def piecewise(x: Column, points: Sequence[tuple[float, float]], above: float) -> Column:
    """Straight lines between the points (x ascending), the last point's value and `above` beyond it; from zero before the first."""
    x0, y0 = points[0]
    out = F.when(x < x0, F.greatest(F.lit(0.0), x * y0 / x0))
    for (a, ya), (b, yb) in zip(points, points[1:]):
        out = out.when(x < b, F.lit(ya) + (yb - ya) * (x - a) / (b - a))
    return out.otherwise(F.lit(above))


def resolution(width: Column, height: Column) -> Column:
    return piecewise(F.least(width, height), [(400.0, 50.0), (800.0, 100.0)], 100.0)


def blur(x: Column) -> Column:
    return piecewise(x, [(30.0, 40.0), (100.0, 100.0)], 100.0)


def contrast(x: Column) -> Column:
    return piecewise(x, [(15.0, 40.0), (40.0, 100.0)], 100.0)


def background(x: Column) -> Column:
    return piecewise(x, [(0.15, 50.0), (0.30, 100.0)], 100.0)


def edge(x: Column) -> Column:
    return piecewise(x, [(0.005, 40.0), (0.02, 100.0)], 100.0)


def brightness(x: Column) -> Column:
    return F.when(x.between(80, 220), 100.0).when((x >= 40) & (x < 80), 60.0 + 40.0 * (x - 40) / 40).when((x > 220) & (x <= 240), 60.0 + 40.0 * (240 - x) / 20).otherwise(20.0)


def fill(x: Column) -> Column:
    return (
        F.when(x.between(0.10, 0.75), 100.0).when((x >= 0.05) & (x < 0.10), 50.0 + 50.0 * (x - 0.05) / 0.05)
        .when((x > 0.75) & (x <= 0.90), 50.0 + 50.0 * (0.90 - x) / 0.15).when(x < 0.05, F.greatest(F.lit(0.0), 50.0 * x / 0.05)).otherwise(30.0)
    )


def image_overall(metrics: dict[str, Column]) -> Column:
    return sum((metrics[k] * w for k, w in fixed.IMAGE_WEIGHTS.items()), F.lit(0.0)) / 100


def image_status(score: Column, n_issues: Column) -> Column:
    return F.when(n_issues == 0, "PASS").when(score >= 70, "PASS_WITH_NOTES").when(score >= 40, "REVIEW").otherwise("FAIL")


def area_status(score: Column) -> Column:
    return F.when(score >= 75, "OK").when(score >= 40, "Svak").when(score > 0, "Bør forbedres").otherwise("Mangler")


def severity(score: Column) -> Column:
    return F.when(score < 25, "CRITICAL").when(score < 50, "HIGH").when(score < 75, "MEDIUM").otherwise("LOW")


def priority(overall: Column, description: Column, images: Column) -> Column:
    return F.when((overall < 40) | (description == 0) | (images == 0), "Kritisk").when(overall < 60, "Høy").when(overall < 80, "Middels").otherwise("Lav")


def weighted(scores: dict[str, Column], weights: dict[str, int]) -> Column:
    """Mean of the scores that are given, by their weights."""
    total = sum(weights[k] for k in scores)
    return sum((c * weights[k] for k, c in scores.items()), F.lit(0)) / total
