"""DataFrame-to-DataFrame operators."""

from .cleaning import VARIANTS, Variant, clean_listings, transform_listings
from .counters import counter_deltas, size_advice
from .events import load_manifest, rejected_events
from .gates import judge_rows, row_accounting
from .merge import latest_rows, only_new_rows, upsert
from .replicate import largest_id, largest_id_text, replicate, scale_summary
from .sequence import add_sequence, order_by_id
from .statements import insert_statements, run_statements, sql_literal
from .typing import bad_rows, typed_listings

__all__ = [name for name in dir() if not name.startswith("_")]
