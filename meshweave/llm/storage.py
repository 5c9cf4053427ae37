"""Files in the shared folder, by URI: local paths, HDFS and object stores alike."""

from __future__ import annotations

import uuid


def _at(uri: str):
    from pyarrow.fs import FileSystem

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = _at(uri)
    fs.create_dir(path, recursive=True)


class Output:
    """A file that appears under its name only when it is whole; a task that is run again leaves no half file."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, self.path = _at(self.uri)
        self.file = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.file.write(data)
        self.size += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.path + ".part", self.path)


def open_input(uri: str):
    """A seekable file."""
    fs, path = _at(uri)
    return fs.open_input_file(path)


def size_of(uri: str) -> int:
    fs, path = _at(uri)
    return fs.get_file_info(path).size
