"""Arrays in shared storage that workers map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write each array as a .npy file. A file appears whole, by a rename; a task that runs again writes the same."""
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(root), recursive=True)
    for name, x in arrays.items():
        draft = f"{root}-{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            np.lib.format.write_array(f, np.ascontiguousarray(x), allow_pickle=False)
        store.move(draft, f"{root}-{name}.npy")


class Mapped:
    """Maps arrays on first use. Where storage is not a mounted file system, each is first copied to a local folder
    that goes with this object."""

    def __init__(self) -> None:
        self.open: dict[str, np.ndarray] = {}
        self.local: tempfile.TemporaryDirectory | None = None

    def get(self, uri: str, name: str) -> np.ndarray:
        key = f"{uri}-{name}.npy"
        if key not in self.open:
            store, path = fs.FileSystem.from_uri(key)
            if not isinstance(store, fs.LocalFileSystem):
                self.local = self.local or tempfile.TemporaryDirectory()
                near = os.path.join(self.local.name, uuid.uuid4().hex)
                fs.copy_files(path, near, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                path = near
            self.open[key] = np.load(path, mmap_mode="r")
        return self.open[key]

    def close(self) -> None:
        self.open.clear()
        if self.local:
            self.local.cleanup()
