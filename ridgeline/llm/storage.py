"""Intermediate tables in the folder that driver and executors share."""

from ..sources.scratch import delete, drop_scratch, folders, materialize, new_path, shared_dir

__all__ = ["delete", "drop_scratch", "folders", "materialize", "new_path", "shared_dir"]
