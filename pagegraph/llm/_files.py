"""Files in the shared folder, from driver or executors, by whatever file system their path names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str) -> Iterator:
    """A stream to a new file that has its name only when it is whole, so a task that is run again does no harm."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            yield out
        system.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(part)
        raise


@contextlib.contextmanager
def opened(uri: str) -> Iterator:
    """A stream from a file; it can seek."""
    system, path = _at(uri)
    with system.open_input_file(path) as source:
        yield source
