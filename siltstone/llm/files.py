"""Files of other formats than Spark's, written by tasks to the shared folder and read back.

Any store that pyarrow knows serves. A task writes under a name of its own attempt and renames the file when it is
whole, so that retries and speculative copies leave one good file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def new_file(directory: str, name: str):
    """Write directory/name through the handle; the file is there only if nothing fails."""
    store, path = fs.FileSystem.from_uri(directory)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as f:
        yield f
    store.move(temporary, f"{path}/{name}")


def open_file(directory: str, name: str):
    """A seekable handle of directory/name."""
    store, path = fs.FileSystem.from_uri(directory)
    return store.open_input_file(f"{path}/{name}")
