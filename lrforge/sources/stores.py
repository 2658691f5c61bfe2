"""File systems of paths, for tasks that read and write files themselves."""

from __future__ import annotations

import re

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path
