"""Raw tables to a clean panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from slotcast.grid import HOURLY, Grid, consolidate
from slotcast.operators.clean import as_of, repair_raw_spikes, repair_spikes
from slotcast.operators.joins import dimension_enrich


def clean_panel(
    demand: DataFrame,
    organisation: DataFrame,
    day: str,
    grid: Grid = HOURLY,
    factor: float = 2.0,
    floor: float = 10.0,
    one_row_per_slot: bool = False,
) -> DataFrame:
    """Cut at ``day``, add the organisation of each service, repair spikes.

    The cut comes first so that later rows are neither joined nor shuffled. Raw
    rows are kept as they are and meet the references of their slots. With
    ``one_row_per_slot`` those of a service and slot are summed first, and the
    neighbours are frames of one window. Either way a series window is bounded by
    the calendar, whatever share of the raw rows a service has.
    """
    raw = as_of(demand, day, grid.date)
    if one_row_per_slot:
        raw = consolidate(raw, replace(grid, keys=("service_id",)))
    enriched = dimension_enrich(raw, organisation)
    repair = repair_spikes if one_row_per_slot else repair_raw_spikes
    return repair(enriched, grid, factor, floor)
