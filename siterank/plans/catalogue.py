"""Imports every query module so that the registry is complete."""

from siterank.plans import climate_queries, quality_queries, raster_queries, resample_queries, score_queries, terrain_queries  # noqa: F401
from siterank.plans.registry import ORACLES, QUERIES  # noqa: F401
