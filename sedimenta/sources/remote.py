"""New files written by executors, without the JVM."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs

SCHEMES = ("file", "hdfs", "s3", "gs")


def reaches(uri: str) -> bool:
    """Whether create works for a folder."""
    if uri.partition(":")[0] not in SCHEMES:
        return False
    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # no library or no settings for it here
        return False
    return True


def create(uri: str, name: str, content) -> bool:
    """Writes a new file under another name and renames it; False if the name is taken by other bytes. By the same ones
    it is if a task runs again."""
    files, folder = fs.FileSystem.from_uri(uri)
    at, temp = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4()}"
    if files.get_file_info(at).type != fs.FileType.NotFound:
        with files.open_input_stream(at) as f:
            return f.read() == bytes(content)
    if isinstance(files, fs.LocalFileSystem):
        with open(temp, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
    else:
        with files.open_output_stream(temp) as f:
            f.write(content)
    files.move(temp, at)
    return True
