"""Readers and writers: CSV files, staging and target tables, relational tables."""

from .csv import (
    FILE_ROWS,
    header_names,
    listing_text,
    output_name,
    read_raw_listings,
    read_text_table,
    sanitized_names,
    write_listings_csv,
    write_text_csv,
)
from .jdbc import jdbc_options, key_slices, read_relational, write_relational
from .keyed import keyed_files, read_keyed, upsert_keyed, vacuum_keyed, write_keyed
from .tables import (
    append_target,
    read_part,
    read_staging,
    read_target,
    read_text_loads,
    replace_target,
    target_loads,
    vacuum_target,
    write_staging,
)

__all__ = [name for name in dir() if not name.startswith("_")]
