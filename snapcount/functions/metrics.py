"""Rules over pixel measurements that arrive as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def panel_visible(dark_ratio: Column, edge_density: Column) -> Column:
    return F.coalesce((dark_ratio >= 0.55) & (edge_density >= 0.04), F.lit(False))


def field_side(row_counts: Column) -> Column:
    """Direction of a triangle from its dark-pixel count per row."""
    filled = F.filter(
        F.transform(row_counts, lambda n, i: F.when(n > 0, i)),
        lambda i: i.isNotNull(),
    )
    first, last = F.get(filled, F.lit(0)), F.get(filled, F.size(filled) - 1)
    middle = ((first + last + 1) / 2).cast("int")

    def total(start: Column, stop: Column) -> Column:
        part = F.slice(row_counts, start + 1, F.greatest(stop - start, F.lit(0)))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    top, bottom = total(first, middle), total(middle, last + 1)
    return F.when(
        F.size(filled) >= 4,
        F.when(top > bottom * 1.15, "own").when(bottom > top * 1.35, "opponent"),
    )


def possession_team(
    away_ratio: Column, home_ratio: Column, away_team: Column, home_team: Column
) -> Column:
    away = F.coalesce(away_ratio, F.lit(0.0))
    home = F.coalesce(home_ratio, F.lit(0.0))
    return F.when(
        (F.length(away_team) > 0) & (away >= 0.08) & (away > home * 1.5), away_team
    ).when((F.length(home_team) > 0) & (home >= 0.08) & (home > away * 1.5), home_team)


def scoreboard_visibility(
    edge_density: Column, dark_ratio: Column, bright_ratio: Column, text: Column
) -> Column:
    def share(value: Column, full: float, weight: float) -> Column:
        return F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)) / full) * weight

    def bonus(pattern: str) -> Column:
        found = F.coalesce(text.rlike(pattern), F.lit(False))
        return F.when(found, F.lit(0.2)).otherwise(F.lit(0.0))

    score = (
        share(edge_density, 0.12, 0.4)
        + share(dark_ratio, 0.45, 0.2)
        + share(bright_ratio, 0.35, 0.2)
        + bonus(r"\b[0-5]?\d:[0-5]\d\b")
        + bonus(r"\b[1-4][A-Z]{0,2}\s*&\s*\d{1,2}\b")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
