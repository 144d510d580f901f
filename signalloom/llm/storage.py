"""The library's helpers for files that all executors share."""

from signalloom.sources.storage import counted, removed, scratch, shared_folder, written

__all__ = ["counted", "removed", "scratch", "shared_folder", "written"]
