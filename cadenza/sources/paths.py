"""Where files lie: local paths and addresses of other stores, through Arrow's file systems."""

from __future__ import annotations


def file_system(path: str):
    """Arrow's file system for a path or address, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
