"""Scans (parquet, CSV), profile, preview and the test-table fixtures."""

from .tables import TABLES, csv_rejects, infer_csv_types, preview, profile, read_csv, read_table, table_path, write_csv  # noqa: F401
from . import fixtures  # noqa: F401
