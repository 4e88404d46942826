"""Hillslope budget: results of the hillslope simulator rolled up to channels and watersheds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hydrospark.operators import rollup as U


def hillslope_budget(hillslopes: DataFrame) -> dict[str, DataFrame]:
    """Tables 'channels', 'network', 'watersheds' (with the peak of their channels) and 'budget'."""
    channels = U.channel_accumulate(hillslopes)
    watersheds = U.hillslope_rollup(hillslopes).join(U.watershed_peak(hillslopes, channels), "watershed_id", "left")
    return {
        "channels": channels, "network": U.channel_network(channels), "watersheds": watersheds,
        "budget": U.watershed_budget(hillslopes, channels),
    }


def hillslope_inputs(horizon: DataFrame, component: DataFrame, texture: DataFrame, mapunits: DataFrame, climate: DataFrame) -> dict[str, DataFrame]:
    """Simulator inputs as tables: soil parameters per map-unit polygon and monthly climate per point."""
    soil = U.soil_by_mapunit(U.join_soil_tables(U.horizon_kffact(horizon), component, texture))
    return {
        "soil": U.with_soil_params(U.soil_polygons(mapunits, soil)),
        "climate": U.monthly_climate(U.with_dates(climate)),
    }
