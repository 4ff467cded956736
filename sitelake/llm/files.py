"""Flat array files in the shared folder, written whole and mapped into memory by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if ":" in folder.split("/")[0]:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write the array under its name; a task that runs twice leaves the same one file."""
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).data)
    store.move(part, f"{path}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array mapped into memory; from a store without local files it is first copied to this machine, where it can be lost without harm."""
    store, path = _place(folder)
    file = f"{path}/{name}"
    if not isinstance(store, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"{os.path.basename(folder)}-{name}")
        if not os.path.exists(local):
            part = f"{local}-{uuid.uuid4().hex}"
            with store.open_input_stream(file) as source, open(part, "wb") as copy:
                while block := source.read(1 << 24):
                    copy.write(block)
            os.replace(part, local)
        file = local
    if os.path.getsize(file) == 0:
        return np.zeros(0, dtype)
    return np.memmap(file, dtype, "r")
