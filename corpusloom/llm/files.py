"""Binary files in the shared folder, reached from the driver and from executors alike."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a URI or a plain absolute path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@contextmanager
def written_whole(path: str):
    """A binary stream for ``path`` that shows up under its name only when it is complete.

    Attempts of one task write under names of their own, so that a retry or a
    speculative copy never mixes with another.
    """
    system, at = resolve(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(own) as out:
        yield out
    system.move(own, at)


def open_random(path: str):
    system, at = resolve(path)
    return system.open_input_file(at)
