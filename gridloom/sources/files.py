"""Random access to files of any store that pyarrow opens, and files written by tasks and moved when all have ended."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path on it. Raises where pyarrow has no such store."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def opened(path: str):
    fs, at = store(path)
    return fs.open_input_file(at)


def readable(path: str) -> bool:
    """Whether Python tasks can open the path themselves; else Spark's readers must."""
    try:
        store(path)
    except Exception:  # noqa: BLE001 - every store has errors of its own
        return False
    return True


class Staged:
    """Files of one write job: tasks write below a folder of their own; commit moves them to their names."""

    def __init__(self, directory: str, overwrite: bool):
        self.directory, self.overwrite = directory.rstrip("/"), overwrite
        self.folder = f"{self.directory}/_temporary-{uuid.uuid4().hex}"

    def create(self, attempt: str, name: str) -> tuple[str, object]:
        """(path, stream) of a new file; attempt tells a task's tries apart."""
        fs, folder = store(f"{self.folder}/{attempt}")
        fs.create_dir(folder, recursive=True)
        return f"{self.folder}/{attempt}/{name}", fs.open_output_stream(f"{folder}/{name}")

    def commit(self, paths: list[str]) -> None:
        fs, directory = store(self.directory)
        names = [p.rsplit("/", 1)[-1] for p in paths]
        if len(set(names)) != len(names):
            raise ValueError("a file was written twice")
        taken = [x.path for x in fs.get_file_info([f"{directory}/{n}" for n in names]) if x.type != pafs.FileType.NotFound]
        if taken and not self.overwrite:
            raise ValueError(f"the file is there already: {taken[0]}")
        for p, name in zip(paths, names):
            fs.move(store(p)[1], f"{directory}/{name}")
        self.clear()

    def clear(self) -> None:
        fs, folder = store(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
