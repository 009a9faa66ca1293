"""Content sniffing by blocks: files are opened and read until a mark is found, no further than their budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

#: A frame header in hexadecimal text, the block size, the blocks that are read at most, and the bytes that two blocks share.
FRAME_HEADER, BLOCK, BLOCKS, CARRY = rb"(0x)?5a\s+(0x)?a5", 512 * 1024, 40, 8
SNIFFED = "relpath string, found boolean, at long, read long"
_SNIFFED = pa.schema([("relpath", pa.string()), ("found", pa.bool_()), ("at", pa.int64()), ("read", pa.int64())])


def sniff(stream, pattern: re.Pattern[bytes], block: int = BLOCK, blocks: int = BLOCKS, carry: int = CARRY) -> tuple[int | None, int]:
    """Where the pattern first begins, or None, and how many bytes were read. A match across an edge is found if `carry` holds its head."""
    tail, start, read = b"", 0, 0
    for _ in range(blocks):
        data = stream.read(block)
        if not data:
            break
        read += len(data)
        seen = tail + data
        hit = pattern.search(seen)
        if hit:
            return start + hit.start(), read
        tail = seen[-carry:] if carry else b""
        start += len(seen) - len(tail)
    return None, read


def sniffed(files: DataFrame, pattern: bytes = FRAME_HEADER, block: int = BLOCK, blocks: int = BLOCKS, carry: int = CARRY) -> DataFrame:
    """relpath, found, at (byte offset), read (bytes) of files (relpath, uri), each opened by a task and read up to its first hit.

    Case is ignored. A file that can't be opened is an error; a null uri has nothing.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern, re.I)
        for part in parts:
            rows = []
            for path, uri in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                at, read = None, 0
                if uri is not None:
                    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
                    with fs.open_input_stream(name, compression=None) as stream:
                        at, read = sniff(stream, wanted, block, blocks, carry)
                rows.append((path, at is not None, at, read))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SNIFFED)], schema=_SNIFFED)

    return files.select("relpath", "uri").mapInArrow(run, SNIFFED)
