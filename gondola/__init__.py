"""Retail pricing and promotion analytics on Spark DataFrames."""

from gondola.operators.filters import FilterSpec, apply_filters
from gondola.operators.normalize import model_tables, normalize_lines
from gondola.sources.dimensions import load_catalog, load_stores
from gondola.sources.lines import scan_sales_csv
from gondola.sources.rollups import Rollups, read_rollups

__all__ = [
    "FilterSpec", "Rollups", "apply_filters", "load_catalog", "load_stores", "model_tables",
    "normalize_lines", "read_rollups", "scan_sales_csv",
]
