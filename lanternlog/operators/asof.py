"""Point-in-time reads: what was public, or ingested, at a given time. The gate is never when a thing happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_public(events: DataFrame, as_of, *, entity: str | None = None, entity_col: str = "company_id", types: list[str] | None = None, type_col: str = "event_type") -> DataFrame:
    """Rows whose publication is not after as_of, of one entity or some types if asked for, oldest publication first."""
    out = events.filter(F.col("publication_time") <= F.lit(as_of))
    if entity is not None:
        out = out.filter(F.col(entity_col) == F.lit(entity))
    if types is not None:
        out = out.filter(F.col(type_col).isin(list(types)))
    return out.orderBy("publication_time")


def retrieval_time() -> Column:
    """When a row came in: its document's retrieval, else its own creation."""
    return F.coalesce("retrieved_at", "created_at")


def as_of_ingested(events: DataFrame, as_of) -> DataFrame:
    """Rows that had come in by as_of, in the order of coming in."""
    return events.filter(retrieval_time() <= F.lit(as_of)).orderBy(retrieval_time())


def list_events(events: DataFrame, as_of, mode: str = "public") -> DataFrame:
    modes = {"public": as_of_public, "ingested": as_of_ingested}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}, not {mode!r}")
    return modes[mode](events, as_of)


def ingestion_gate(rows: DataFrame, clock: str, as_of=None, newest_first: str | None = None) -> DataFrame:
    """Rows that are no events: gated by an ingestion clock, or not at all without as_of."""
    out = rows if as_of is None else rows.filter(F.col(clock) <= F.lit(as_of))
    return out if newest_first is None else out.orderBy(F.col(newest_first).desc())


def catalogue(facts: DataFrame, dims: list[tuple[DataFrame, str]], *, as_of=None, where: dict | None = None, newest_first: str | None = None) -> DataFrame:
    """A read endpoint's content: facts public by as_of, joined to small dimensions, filtered and sorted.

    Filters stand on the facts' own columns, so they reach the scan; Spark picks the join by the dimensions' size.
    """
    out = facts if as_of is None else facts.filter(F.col("publication_time") <= F.lit(as_of))
    for column, value in (where or {}).items():
        out = out.filter(F.col(column) == F.lit(value))
    for dim, key in dims:
        out = out.join(dim, key)
    return out if newest_first is None else out.orderBy(F.col(newest_first).desc())
