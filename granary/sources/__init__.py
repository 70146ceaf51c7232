"""Sources and sinks."""

from .tables import read_table, shared_folder, stage_boundary

__all__ = ["read_table", "shared_folder", "stage_boundary"]
