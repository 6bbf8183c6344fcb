"""Filter specifications as predicates, workflow tabs and JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import HIGH_RISK, enum, keep_unless, require

GOOD_SCORE = 70


@dataclass(frozen=True)
class FilterSpec:
    """What a view shows; unset bounds and empty sets put no bound."""

    price_min: int | None = None
    price_max: int | None = None
    area_min: float | None = None
    area_max: float | None = None
    districts: frozenset[str] = field(default_factory=frozenset)
    declared_rooms: frozenset[int] = field(default_factory=frozenset)
    effective_private_rooms: frozenset[int] = field(default_factory=frozenset)
    only_without_room_conflict: bool = False
    only_confirmed_layout: bool = False
    hide_high_mortgage_risk: bool = False
    hide_stove_heating: bool = False
    hide_wooden_buildings: bool = False
    only_with_floor_plan: bool = False
    only_good_transport: bool = False
    only_near_rtu: bool = False
    only_near_central_station: bool = False
    active_only: bool = True
    show_inactive: bool = False
    hide_viewed: bool = False
    hide_rejected: bool = True
    favorites_only: bool = False
    rejected_only: bool = False
    inactive_only: bool = False


def predicates(spec: FilterSpec) -> list[Column]:
    """One predicate for each part that is set, so that the rest adds nothing to the plan."""
    c, out = F.col, []
    for name, column in (("price", "price_eur"), ("area", "area_m2")):
        for bound, op in (("min", "__ge__"), ("max", "__le__")):
            value = getattr(spec, f"{name}_{bound}")
            if value is not None:
                out.append(require(getattr(c(column), op)(value)))
    for members, column in ((spec.districts, "district"), (spec.declared_rooms, "declared_rooms"), (spec.effective_private_rooms, "private_rooms")):
        if members:
            out.append(require(c(column).isin(*sorted(members))))
    switches = (
        (spec.active_only and not spec.show_inactive, c("status") == "active"),
        (spec.inactive_only, c("status") != "active"),
        (spec.hide_rejected, keep_unless(c("is_rejected"))),
        (spec.rejected_only, require(c("is_rejected"))),
        (spec.favorites_only, require(c("is_favorite"))),
        (spec.hide_viewed, keep_unless(c("is_viewed"))),
        (spec.only_without_room_conflict, keep_unless(c("room_conflict"))),
        (spec.only_confirmed_layout, require(c("layout_label") == "Confirmed")),
        (spec.hide_high_mortgage_risk, keep_unless(c("risk").isin(*HIGH_RISK))),
        (spec.hide_stove_heating, keep_unless(c("stove"))),
        (spec.hide_wooden_buildings, keep_unless(c("wooden"))),
        (spec.only_with_floor_plan, require(c("has_floor_plan"))),
        (spec.only_good_transport, require(c("transport_score") >= GOOD_SCORE)),
        (spec.only_near_rtu, require(c("rtu_score") >= GOOD_SCORE)),
        (spec.only_near_central_station, require(c("station_score") >= GOOD_SCORE)),
    )
    return out + [p for on, p in switches if on]


def matches(spec: FilterSpec) -> Column:
    return reduce(lambda a, b: a & b, predicates(spec), F.lit(True))


def apply(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.where(matches(spec))


_OFF = {"hide_viewed": False, "hide_rejected": False, "favorites_only": False, "rejected_only": False, "inactive_only": False}
#: What each workflow tab overrides; other parts of a specification stay.
TABS = {
    "all": {},
    "new": _OFF | {"hide_viewed": True, "hide_rejected": True, "active_only": True, "show_inactive": False},
    "favorites": _OFF | {"favorites_only": True, "active_only": False, "show_inactive": True},
    "rejected": _OFF | {"rejected_only": True, "active_only": False, "show_inactive": True},
    "inactive": _OFF | {"inactive_only": True, "active_only": False, "show_inactive": True},
}


def for_tab(tab: str, spec: FilterSpec = FilterSpec()) -> FilterSpec:
    if tab not in TABS:
        raise ValueError(f"no such tab: {tab}")
    return dataclasses.replace(spec, **TABS[tab])


def to_json(spec: FilterSpec) -> str:
    return json.dumps({k: sorted(v) if isinstance(v, frozenset) else v for k, v in dataclasses.asdict(spec).items()}, sort_keys=True)


def from_json(text: str) -> FilterSpec:
    """Unknown keys are ignored."""
    known = {f.name: f for f in dataclasses.fields(FilterSpec)}
    raw = {k: v for k, v in json.loads(text).items() if k in known}
    return FilterSpec(**{k: frozenset(v) if isinstance(v, list) else v for k, v in raw.items()})


def from_payload(raw: dict) -> FilterSpec:
    """From a form: 0, "" and None are unset; one district; room ranges are put in order, a missing end is the start."""
    spec: dict = {}
    for name, kind in (("price_min", int), ("price_max", int), ("area_min", float), ("area_max", float)):
        if raw.get(name):
            spec[name] = kind(raw[name])
    if raw.get("district"):
        spec["districts"] = frozenset([raw["district"]])
    for name in ("declared_rooms", "effective_private_rooms"):
        low, high = raw.get(f"{name}_min"), raw.get(f"{name}_max")
        if low or high:
            low, high = int(low or high), int(high or low)
            spec[name] = frozenset(range(min(low, high), max(low, high) + 1))
    flags = {f.name for f in dataclasses.fields(FilterSpec) if f.type == "bool"}
    return FilterSpec(**spec, **{k: bool(v) for k, v in raw.items() if k in flags})


def to_slider(spec: FilterSpec) -> dict:
    """The state of a form's controls; an empty set gives None."""
    ends = lambda s: (min(s), max(s)) if s else (None, None)
    whole = lambda v: None if v is None else int(v)
    return {
        "price": (spec.price_min, spec.price_max), "area": (whole(spec.area_min), whole(spec.area_max)), "district": min(spec.districts, default=None),
        "declared_rooms": ends(spec.declared_rooms), "effective_private_rooms": ends(spec.effective_private_rooms),
    }


def search(df: DataFrame, text: str, address: str = "street", district: str = "district", key: str = "listing_id") -> DataFrame:
    """Rows whose address or district holds the text, in any case, or whose id is the text."""
    q = text.strip().lower()
    held = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return df.where(held(address) | held(district) | (F.col(key).cast("string") == q)) if q else df


def by_ids(df: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows whose id is in a table of ids."""
    return df.join(ids.select(key), key, "left_semi")


def parsed_enums(df: DataFrame) -> DataFrame:
    from ..functions.nulls import LAYOUT_LABELS, RISK_LEVELS

    return df.withColumn("layout_label", enum("layout_label", LAYOUT_LABELS)).withColumn("risk", enum("risk", RISK_LEVELS))
