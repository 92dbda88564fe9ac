"""Chunked N-dimensional array stores (Zarr versions 2 and 3) as Spark DataFrames and SQL tables."""

from .errors import ZarrError
from .functions.tables import read_zarr, read_zarr_groups, read_zarr_metadata, register
from .plans.sqltext import sql

__all__ = ["ZarrError", "read_zarr", "read_zarr_groups", "read_zarr_metadata", "register", "sql"]
