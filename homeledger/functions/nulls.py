"""Two-valued predicates, enum domains and guarded arithmetic over nullable columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUT_LABELS = ("Confirmed", "Likely", "Unclear", "Conflict")
RISK_LEVELS = ("Low", "Medium", "High", "Critical", "Unknown")
HIGH_RISK = ("High", "Critical")
IMAGE_CATEGORIES = (
    "floor_plan", "interior_room", "kitchen", "bathroom", "corridor_or_hallway", "exterior_building", "entrance_staircase",
    "yard_or_street_view", "duplicate_or_near_duplicate", "irrelevant_or_decorative", "agency_collage",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_unless(condition: Column) -> Column:
    """True unless the condition is true: null keeps the row."""
    return ~F.coalesce(condition, F.lit(False))


def require(condition: Column) -> Column:
    """True only if the condition is true: null drops the row."""
    return F.coalesce(condition, F.lit(False))


def enum(c: str | Column, domain: Iterable[str]) -> Column:
    """The value if it belongs to the domain, else null."""
    return F.when(col(c).isin(*domain), col(c))


def filled(c: str | Column) -> Column:
    """Text that is neither null nor empty, else null."""
    return F.nullif(col(c), F.lit(""))


def ratio(over: str | Column, under: str | Column) -> Column:
    """over / under where under is positive, else null."""
    return F.when(col(under) > 0, col(over).cast("double") / col(under))


def compact(*items: Column) -> Column:
    """An array of the items that are not null, in order."""
    return F.array_compact(F.array(*items))


def flag(condition: Column, label: str) -> Column:
    return F.when(require(condition), F.lit(label))
