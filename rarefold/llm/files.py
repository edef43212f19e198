"""Files by path or URI: of this machine, or of a store that pyarrow reads."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path)
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at or below path, hidden ones left out, by path."""
    at, own = store(path)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    found = [at.get_file_info(own)]
    if found[0].type == fs.FileType.Directory:
        found = at.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
