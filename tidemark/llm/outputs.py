"""Binary files in a folder that all tasks reach: written under a fresh name, listed in the rows that the job keeps.

A task that runs twice writes two files; only the one whose row was kept is in the listing, so readers see each part once.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def make(folder: str) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)


def fresh(folder: str, part: int, ending: str) -> str:
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{ending}"


def writer(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, buffer_size=1 << 20, compression=None)


def reader(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, buffer_size=1 << 20, compression=None)
