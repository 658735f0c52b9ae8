"""Options of a store. Each store has its own."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.time import RETENTION_SECONDS, SEGMENT_SECONDS

CODECS = ("uncompressed", "zstd", "snappy")


@dataclass(frozen=True)
class Options:
    """only_memory: keep the points in executors' memory and disk, not in files. enable_outdated:
    keep late points. max_rows_per_file: bound of a file's rows. files_per_segment: how many tasks an
    append deals a segment's series to, each of which writes its files."""

    codec: str = "uncompressed"
    only_memory: bool = False
    enable_outdated: bool = True
    max_rows_per_file: int = 19_960_412
    files_per_segment: int = 16
    retention_seconds: int = RETENTION_SECONDS
    segment_seconds: int = SEGMENT_SECONDS

    def __post_init__(self):
        if self.codec not in CODECS:
            raise ValueError(f"codec {self.codec!r} is none of {CODECS}")
