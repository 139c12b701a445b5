"""Intermediate tables in the folder that all executors share; see :mod:`corrobora.sources.shared`."""

from corrobora.sources.shared import forget, materialize, new_path, shared_dir

__all__ = ["forget", "materialize", "new_path", "shared_dir"]
