"""Filters and searches over residents and households.

Residents carry a household's and an area's columns after ``views.resident_view``; a FilterSpec is a conjunction over that view. Every condition is a
plain column expression or a semi-join, so Catalyst pushes it to the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.schemas import AGE_PRESETS, GENDER, RESIDENT_STATUS


@dataclass(frozen=True)
class FilterSpec:
    """The named filters; None and blanks filter nothing. ``age`` wins over ``age_min`` and ``age_max``, ``preset`` over none of them."""

    query: str | None = None
    nik: str | None = None
    full_name: str | None = None
    kk_number: str | None = None
    rt_id: int | None = None
    rt_number: str | None = None
    area_unit_id: int | None = None
    gender: str | None = None
    religion_id: int | None = None
    education_id: int | None = None
    occupation_id: int | None = None
    resident_status: str | None = None
    age: int | None = None
    age_min: int | None = None
    age_max: int | None = None
    preset: str | None = None

    def columns(self, as_of: date) -> list[Column]:
        out = []
        for name in ("nik", "full_name", "kk_number"):
            if (getattr(self, name) or "").strip():
                out.append(E.contains_any([F.col(name)], getattr(self, name)))
        for name in ("rt_id", "rt_number", "area_unit_id", "gender", "religion_id", "education_id", "occupation_id", "resident_status"):
            if getattr(self, name) not in (None, ""):
                out.append(F.col(name) == getattr(self, name))
        if self.preset:
            out.append(E.age_between(F.col("birth_date"), as_of, *AGE_PRESETS[self.preset]))
        if self.age is not None:
            out.append(E.age_between(F.col("birth_date"), as_of, self.age, self.age))
        elif self.age_min is not None or self.age_max is not None:
            out.append(E.age_between(F.col("birth_date"), as_of, self.age_min, self.age_max))
        return out

    def slug(self) -> str:
        """Names the active filters, for file names; ``semua`` without any."""
        import re

        part = lambda s: re.sub(r"[^A-Za-z0-9]+", "-", str(s)).lower()
        rt = self.rt_number if self.rt_number is not None else self.rt_id
        named = [
            ("rt", part(rt) if rt is not None else None), ("rw", self.area_unit_id), ("jk", part(GENDER.get(self.gender, self.gender)) if self.gender else None), ("agama", self.religion_id),
            ("pendidikan", self.education_id), ("pekerjaan", self.occupation_id), ("status", part(RESIDENT_STATUS.get(self.resident_status, self.resident_status)) if self.resident_status else None), ("usia", self.age),
        ]
        out = [f"{k}-{v}" for k, v in named if v is not None]
        if self.age_min is not None or self.age_max is not None:
            out.append(f"usia-{self.age_min if self.age_min is not None else 0}to{self.age_max if self.age_max is not None else 'max'}")
        return "_".join(out) or "semua"

    def file_name(self, kind: str, on: date) -> str:
        return f"{on:%Y-%m-%d}_{self.slug()}.{kind}"


def from_params(params: dict) -> FilterSpec:
    """A spec of request parameters: unknown names are ignored."""
    known = {f.name for f in fields(FilterSpec)}
    return FilterSpec(**{k: v for k, v in params.items() if k in known})


def apply_filters(view: DataFrame, spec: FilterSpec, as_of: date, search: list[str] | None = None) -> DataFrame:
    """The rows of a resident view that a spec lets pass; ``search``: the columns its free-text query looks at."""
    for c in spec.columns(as_of):
        view = view.filter(c)
    if (spec.query or "").strip():
        view = view.filter(E.contains_any([F.col(c) for c in search or SEARCH_LIST], spec.query))
    return view


SEARCH_LIST = ["nik", "full_name", "kk_number", "rt_number", "area_name"]
SEARCH_EXPORT = ["nik", "full_name", "kk_number"]


def search_words(view: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Every word of the query occurs in some column."""
    for word in (query or "").split():
        view = view.filter(E.contains_any([F.col(c) for c in columns], word))
    return view


def keep_with(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """EXISTS: parents with a child."""
    return parents.join(children.select(F.col(child_key).alias("_child")), F.col(parent_key) == F.col("_child"), "left_semi")


def keep_without(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """NOT EXISTS: parents without a child."""
    return parents.join(children.select(F.col(child_key).alias("_child")), F.col(parent_key) == F.col("_child"), "left_anti")


def flag_with(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """EXISTS as a column, for use under OR: one distinct key set, one left join."""
    keys = children.select(F.col(child_key).alias("_child")).distinct().withColumn("_in", F.lit(True))
    return parents.join(keys, F.col(parent_key) == F.col("_child"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_child", "_in")


def household_search(households: DataFrame, heads: DataFrame, query: str | None, columns: list[str], key: str, head_key: str, head_columns: list[str]) -> DataFrame:
    """Households with the text in a column of their own or in one of their heads'."""
    if not (query or "").strip():
        return households
    matched = heads.filter(E.contains_any([F.col(c) for c in head_columns], query))
    flagged = flag_with(households, matched, key, head_key, "_head")
    return flagged.filter(E.contains_any([F.col(c) for c in columns], query) | F.col("_head")).drop("_head")


def active_households(households: DataFrame, active: DataFrame, members: DataFrame, key: str, child_key: str) -> DataFrame:
    """Households with an active member, or without any member at all."""
    out = flag_with(flag_with(households, active, key, child_key, "_a"), members, key, child_key, "_m")
    return out.filter(F.col("_a") | ~F.col("_m")).drop("_a", "_m")


def historical_households(households: DataFrame, current: DataFrame, history: DataFrame, key: str, child_key: str) -> DataFrame:
    """Households without current members that have had some."""
    return keep_with(keep_without(households, current, key, child_key), history, key, child_key)


def keyset_page(rows: DataFrame, key: str, after: int, size: int = 500) -> DataFrame:
    """The page that follows a key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def offset_page(rows: DataFrame, order: list, page: int, size: int = 25) -> DataFrame:
    """Page ``page`` (from 1) in an order that should end in a unique column."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def rt_number_variants(number: str) -> list[str]:
    """An RT number as it may be stored: bare, of two digits, of three."""
    bare = number.lstrip("0") or "0"
    return sorted({bare, bare.zfill(2), bare.zfill(3)})
