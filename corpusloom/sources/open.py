"""Binary files by path or URI, from the driver and from executors alike."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a URI or a plain absolute path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_random(path: str):
    system, at = resolve(path)
    return system.open_input_file(at)


def size_of(path: str) -> int:
    system, at = resolve(path)
    return system.get_file_info(at).size


def matching(path: str) -> list[str]:
    """Files that a path, a folder (with all below it) or a glob names, sorted."""
    system, at = resolve(path)
    head = path[: len(path) - len(at)] if "://" in path else ""
    plain = at.split("*")[0].split("?")[0].split("[")[0]
    if plain == at:
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            return [path]
        if info.type == fs.FileType.NotFound:
            return []
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(head + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    folder = plain.rsplit("/", 1)[0]
    found = system.get_file_info(fs.FileSelector(folder or "/", recursive=True, allow_not_found=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, at))
