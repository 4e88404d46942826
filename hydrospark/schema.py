"""Table schemas and small checks shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

FEATURES = "feature_id BIGINT, x DOUBLE, y DOUBLE"
SEGMENTS = "feature_id BIGINT, seq INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
RINGS = "zone_id BIGINT, ring_id INT, seq INT, x DOUBLE, y DOUBLE"
CELLS = "layer STRING, r INT, c INT, v DOUBLE"
SERIES = (
    "Year INT, Month INT, Day INT, Hr INT, Min INT, Flow DOUBLE, PI DOUBLE, "
    "Area_km2 DOUBLE, Covar DOUBLE"
)
CLIMATE = (
    "point BIGINT, year INT, yday INT, tmax DOUBLE, tmin DOUBLE, prcp DOUBLE, "
    "srad DOUBLE, dayl DOUBLE, vp DOUBLE, swe DOUBLE"
)


@dataclass(frozen=True)
class Grid:
    """Affine of a cell table: cell (r, c) covers x0 + c*dx .. and y0 + r*dy .. (dy may be negative)."""

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 10.0
    dy: float = 10.0

    @property
    def cell_area(self) -> float:
        return abs(self.dx * self.dy)

    def x(self, c: Column | str) -> Column:
        return F.lit(self.x0) + (_col(c) + 0.5) * self.dx

    def y(self, r: Column | str) -> Column:
        return F.lit(self.y0) + (_col(r) + 0.5) * self.dy

    def col(self, x: Column | str) -> Column:
        return F.floor((_col(x) - self.x0) / self.dx).cast("int")

    def row(self, y: Column | str) -> Column:
        return F.floor((_col(y) - self.y0) / self.dy).cast("int")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail while the plan is built when a required column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns
