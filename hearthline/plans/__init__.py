"""Whole jobs: transform, load, report, scale-up, and their run metrics."""

from .load import LoadResult, load_from_events, load_listings, load_text_table
from .metrics import RunMetrics
from .reports import (
    data_quality,
    price_categories,
    report_json,
    report_rows,
    room_type_breakdown,
    run_report,
    summary,
    top_neighbourhoods,
)
from .scale import write_scales
from .transform import NoValidRecords, TransformResult, run_transform

__all__ = [name for name in dir() if not name.startswith("_")]
