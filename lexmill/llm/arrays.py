"""NumPy arrays in the shared folder: written by one task, memory-mapped by any worker."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def save(uri: str, name: str, values: np.ndarray) -> None:
    """uri/name, whole or not at all: a task that is run again puts the same content in place."""
    store, folder = _at(uri)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(values), allow_pickle=False)
    store.move(part, f"{folder}/{name}")


@lru_cache(maxsize=4096)
def load(uri: str, name: str) -> np.ndarray:
    """A read-only memory map; from a remote store by way of this machine's temporary folder."""
    store, folder = _at(uri)
    path = f"{folder}/{name}"
    if not isinstance(store, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"map-{os.getpid()}-{abs(hash((uri, name))):x}")
        with store.open_input_stream(path) as src, pa.OSFile(local, "wb") as out:
            while block := src.read(8 << 20):
                out.write(block)
        values = np.load(local, mmap_mode="r")
        os.unlink(local)  # the map keeps the content until the worker ends
        return values
    return np.load(path, mmap_mode="r")
