"""Binary files in the shared folder, whatever its file system."""

from __future__ import annotations

import re

from pyarrow import fs as pafs


def open_dir(uri: str, create: bool = True) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a folder given as a URI or an absolute path."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))
    if create:
        fs.create_dir(path, recursive=True)
    return fs, path
