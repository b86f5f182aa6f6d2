"""Row filters as boolean columns."""

import datetime as dt
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F

from workpulse.operators.columns import computed_once

# The choice that stands for every offered value.
ALL = "Todos"


class Offer(Enum):
    """Which values a filter offers, and so which rows "Todos" keeps."""

    KEEP_NULL = "null is offered, every row stays"
    NOT_NULL = "null is not offered, its rows go"
    FIXED = "a fixed list is offered"


@dataclass(frozen=True)
class Choice:
    """One multi-select: the column, its offer policy and, for a fixed offer, the list."""

    column: str
    offer: Offer
    domain: tuple = ()

    def _everything(self, chosen):
        if isinstance(chosen, str) and chosen != ALL:
            raise ValueError(f"{self.column}: choose a list of values, not the text {chosen!r}")
        return ALL in chosen

    def tests(self, chosen=ALL) -> bool:
        """Whether the choice looks at its column at all."""
        return not (self._everything(chosen) and self.offer is Offer.KEEP_NULL)

    def member(self, chosen=ALL) -> Column:
        """Rows the user's choice keeps. ``chosen`` is ``ALL`` or a list that may hold null."""
        field = F.col(f"`{self.column}`")
        if self._everything(chosen):
            if self.offer is Offer.KEEP_NULL:
                return F.lit(True)
            if self.offer is Offer.NOT_NULL:
                return field.isNotNull()
            chosen = self.domain
        known = [value for value in chosen if value is not None]
        kept = field.isin(known) if known else F.lit(False)
        return kept | field.isNull() if None in chosen else kept


def all_members(choices, chosen=None) -> Column:
    """Every multi-select at once; ``chosen`` maps a column to its values, the rest is "Todos"."""
    chosen = chosen or {}
    unknown = set(chosen) - {choice.column for choice in choices}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    kept = F.lit(True)
    for choice in choices:
        kept = kept & choice.member(chosen.get(choice.column, ALL))
    return kept


def passing(frame: DataFrame, choices, chosen=None, validity=None) -> DataFrame:
    """Rows that pass every multi-select and lie in the window.

    The columns tested are worked out once, for the test and for the result; labels that neither reads stay plain columns and are pruned.
    """
    chosen = chosen or {}
    kept = all_members(choices, chosen)
    if validity is not None:
        kept = kept & validity.holds()
    tested = [choice.column for choice in choices if choice.tests(chosen.get(choice.column, ALL))]
    rows = computed_once(frame, {name: F.col(f"`{name}`") for name in tested}) if tested else frame
    return rows.where(kept)


@dataclass(frozen=True)
class Validity:
    """Days from ``first`` to ``last``, both whole. Without ``first`` it is the earliest start.

    The earliest start passes every row that has a start, so no scan for the minimum is needed.
    """

    last: dt.date
    first: dt.date | None = None

    def holds(self, start="startDate", end="endDate") -> Column:
        start, end = F.col(start), F.col(end)
        after = _midnight(self.last + dt.timedelta(days=1))
        begun = start.isNotNull() if self.first is None else start >= _midnight(self.first)
        return begun & ((end.isNull() & (start < after)) | (end < after))


def _midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def bounds(frame: DataFrame, last: dt.date, start="startDate") -> DataFrame:
    """Default window: day of the earliest start to ``last``."""
    return frame.agg(
        F.min(start).cast("date").alias("first_day"),
        F.lit(last).alias("last_day"),
    )


def offered_values(frame: DataFrame, choices) -> DataFrame:
    """Distinct (field, value) pairs each multi-select shows, from one pass and one shuffle."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(choice.column).alias("field"),
                F.col(f"`{choice.column}`").alias("value"),
                choice.member().alias("offered"),
            )
            for choice in choices
            if choice.offer is not Offer.FIXED
        ]
    )
    seen = frame.select(F.inline(pairs)).where("offered").select("field", "value").distinct()
    fixed = [
        F.struct(F.lit(choice.column).alias("field"), F.lit(value).alias("value"))
        for choice in choices
        if choice.offer is Offer.FIXED
        for value in choice.domain
    ]
    if not fixed:
        return seen
    return seen.union(frame.sparkSession.range(1).select(F.inline(F.array(*fixed))))


def first_case(frame: DataFrame, case_id=None, id_column="processInstanceId", start="startDate") -> DataFrame:
    """The row of one case, or of the earliest case when none is chosen."""
    rows = frame if case_id is None else frame.where(F.col(id_column) == case_id)
    return rows.orderBy(F.asc_nulls_last(start), F.asc(id_column)).limit(1)


def cases_of(frame: DataFrame, case_ids, id_column="processInstanceId") -> DataFrame:
    """Rows of some cases. Over a table that ``sinks.write_clustered`` wrote by the id, only the row groups that may hold them are read."""
    return frame.where(F.col(id_column).isin(list(case_ids)))
