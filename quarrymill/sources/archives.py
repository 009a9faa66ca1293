"""Archives as members in bounded chunks, nested ones opened while they stream, in one pass over each.

Zip, tar, gzip, bzip2 and xz are read by their contents, not their names, and front to back: a member is never whole in memory, nor on
a worker's disk. What can't be read, lies too deep or expands beyond its bound gives a row that says so.
"""

from __future__ import annotations

import bz2
import io
import lzma
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER = "relpath string, chunk int, content binary, note string"
_MEMBER = pa.schema([("relpath", pa.string()), ("chunk", pa.int32()), ("content", pa.binary()), ("note", pa.string())])
#: The marks that archives begin with, and where a tar's mark stands.
ZIP, ZIP_EMPTY, GZIP, BZIP2, XZ, TAR, TAR_AT = b"PK\x03\x04", b"PK\x05\x06", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"ustar", 257
READ = 1 << 16
#: Names of archives; a file so named that is none is told of, not taken for a plain file.
NAMED_ARCHIVE = r"(?i)\.(zip|tar|tgz|gz|7z|rar|tar\.bz2|tar\.xz)$"


class Unreadable(Exception):
    """A broken archive."""


class _Expanded(io.RawIOBase):
    """A compressed stream read as what it holds; what follows its end is left in `rest`."""

    def __init__(self, source, make, many: bool = True) -> None:
        self.source, self.make, self.many = source, make, many
        self.codec, self.held, self.rest, self.done = make(), b"", b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held and not self.done:
            raw = self.rest or self.source.read(READ)
            self.rest = b""
            if not raw:
                self.held = b"" if self.codec.eof else self._expand(b"")  # what the codec still holds
                if not self.held and not self.codec.eof:
                    raise Unreadable("the archive ends too early")
                break
            if self.codec.eof:  # another stream follows, or padding
                if not self.many or not raw.strip(b"\0"):
                    self.rest, self.done = raw, True
                    break
                self.codec = self.make()
            try:
                self.held = self._expand(raw)
            except (zlib.error, lzma.LZMAError, OSError, EOFError) as e:
                raise Unreadable(str(e)) from None
            if self.codec.eof:
                self.rest = self.codec.unused_data
                self.done = not self.many
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n

    def _expand(self, raw: bytes) -> bytes:
        """At most about 1 MB at once, so little input that expands to much can't fill the memory."""
        if isinstance(self.codec, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
            out = [self.codec.decompress(raw, READ)]
            while not self.codec.needs_input and not self.codec.eof and sum(map(len, out)) < 1 << 20:
                out.append(self.codec.decompress(b"", READ))
            self._pending = not self.codec.needs_input and not self.codec.eof
            return b"".join(out)
        out = self.codec.decompress(raw, 1 << 20)
        if self.codec.unconsumed_tail and not self.codec.eof:
            self.rest = self.codec.unconsumed_tail
        return out

    def remains(self) -> None:
        """Read to the end, so that `rest` is what follows."""
        sink = bytearray(READ)
        while self.readinto(sink):
            pass


class _BlockExpanded(_Expanded):
    """bzip2 and xz keep what they haven't expanded yet inside."""

    def readinto(self, into) -> int:
        if not self.held and getattr(self, "_pending", False):
            self.held = self._expand(b"")
            if self.codec.eof:
                self.rest = self.codec.unused_data
        return super().readinto(into)


class _Part(io.RawIOBase):
    """The next `size` bytes of a stream."""

    def __init__(self, source, size: int) -> None:
        self.source, self.left = source, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        raw = self.source.read(min(len(into), self.left, READ))
        if not raw and self.left and len(into):
            raise Unreadable("the archive ends too early")
        into[: len(raw)] = raw
        self.left -= len(raw)
        return len(raw)


class _Pushed(io.RawIOBase):
    """A stream with bytes put back before it."""

    def __init__(self, source) -> None:
        self.source, self.front = source, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        raw, self.front = (self.front[: len(into)], self.front[len(into) :]) if self.front else (self.source.read(min(len(into), READ)), b"")
        into[: len(raw)] = raw
        return len(raw)

    def exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (raw := self.read(n - len(out))):
            out += raw
        return out


def zip_members(source) -> Iterator[tuple[str, io.BufferedReader | None, str | None]]:
    """(name, content, why it can't be read) of a zip read front to back by its local headers; content must be used before the next."""
    stream = _Pushed(source)
    while True:
        mark = stream.exactly(4)
        if mark != ZIP:
            return  # the directory at the end, or nothing
        head = stream.exactly(26)
        if len(head) < 26:
            raise Unreadable("the archive ends too early")
        flags, method = int.from_bytes(head[2:4], "little"), int.from_bytes(head[4:6], "little")
        size, full = int.from_bytes(head[14:18], "little"), int.from_bytes(head[18:22], "little")
        name = stream.exactly(int.from_bytes(head[22:24], "little")).decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = stream.exactly(int.from_bytes(head[24:26], "little"))
        if 0xFFFFFFFF in (size, full):
            at = 0
            while at + 4 <= len(extra):
                kind, n = int.from_bytes(extra[at : at + 2], "little"), int.from_bytes(extra[at + 2 : at + 4], "little")
                if kind == 1:
                    values = iter([int.from_bytes(extra[k : k + 8], "little") for k in range(at + 4, at + 4 + n, 8)])
                    full = next(values, full) if full == 0xFFFFFFFF else full
                    size = next(values, size) if size == 0xFFFFFFFF else size
                at += 4 + n
        later = bool(flags & 8)  # sizes stand after the content
        if flags & 1 or method not in (0, 8) or (later and method == 0 and size == 0):
            if later and size == 0:
                yield name, None, "encrypted, or of a kind that can't be read front to back"
                raise Unreadable("members after one of unknown length can't be found")
            part = _Part(stream, size)
            yield name, None, "encrypted, or compressed in an unknown way"
            while part.read(READ):
                pass
            continue
        if method == 0:
            part = _Part(stream, size)
            yield name, io.BufferedReader(part, READ), None
            while part.read(READ):
                pass
        else:
            limited = stream if later and size == 0 else _Part(stream, size)
            body = _Expanded(limited, lambda: zlib.decompressobj(-15), many=False)
            yield name, io.BufferedReader(body, READ), None
            body.remains()
            if limited is stream:
                stream.front = body.rest + stream.front
            else:
                while limited.read(READ):
                    pass
        if later:  # crc and sizes, with or without a mark, of 32 or of 64 bits
            data = stream.exactly(24)
            lead = 4 if data[:4] == b"PK\x07\x08" else 0
            ends = [n for n in (lead + 12, lead + 20) if data[n : n + 2] == b"PK" or len(data) <= n]
            n = ends[0] if ends else lead + 12
            stream.front = data[n:] + stream.front


def safe_name(name: str) -> bool:
    """Neither absolute nor climbing."""
    return not (name.startswith(("/", "\\")) or re.match("^[A-Za-z]:", name) or ".." in re.split(r"[\\/]", name))


def _kind(stream: io.BufferedReader) -> str | None:
    head = b""
    while len(head) < TAR_AT + 5:  # a reader may show less than it could
        more = stream.peek(TAR_AT + 5)
        if len(more) <= len(head):
            break
        head = more
    for mark, kind in ((ZIP, "zip"), (ZIP_EMPTY, "zip"), (GZIP, "gzip"), (BZIP2, "bzip2"), (XZ, "xz")):
        if head.startswith(mark):
            return kind
    return "tar" if head[TAR_AT : TAR_AT + 5] == TAR else None


def _opened(stream, kind: str) -> io.BufferedReader:
    if kind == "gzip":
        return io.BufferedReader(_Expanded(stream, lambda: zlib.decompressobj(31)), READ)
    return io.BufferedReader(_BlockExpanded(stream, bz2.BZ2Decompressor if kind == "bzip2" else lzma.LZMADecompressor), READ)


class _Reader:
    """One file's members as rows, with what it may still expand to."""

    def __init__(self, levels: int, chunk: int, most: int) -> None:
        self.levels, self.chunk, self.left = levels, chunk, most

    def rows(self, path: str, stream: io.BufferedReader, level: int = 0) -> Iterator[tuple[str, int | None, bytes | None, str | None]]:
        kind = _kind(stream)
        if kind is None and re.search(NAMED_ARCHIVE, path):
            yield path, None, None, "not readable: no archive of a known kind"
        elif kind is None:
            yield from self.chunks(path, stream)
        elif level >= self.levels:
            yield path, None, None, f"nested more than {self.levels} deep"
        else:
            try:
                yield from self.members(path, stream, kind, level)
            except (Unreadable, tarfile.TarError, EOFError, OSError) as e:
                yield path, None, None, f"not readable: {e}"

    def members(self, path: str, stream, kind: str, level: int):
        if kind in ("gzip", "bzip2", "xz"):
            inner = _opened(stream, kind)
            if _kind(inner) == "tar":
                yield from self.members(path, inner, "tar", level)
            else:  # one compressed file: its member is named as it is, without the ending
                yield from self.rows(f"{path}!/{re.sub(r'(?i)[.](gz|bz2|xz)$', '', path.rsplit('/', 1)[-1])}", inner, level + 1)
        elif kind == "tar":
            with tarfile.open(fileobj=stream, mode="r|") as t:
                for m in t:
                    if m.isfile() and safe_name(m.name):
                        yield from self.rows(f"{path}!/{m.name}", t.extractfile(m), level + 1)
        else:
            for name, body, why in zip_members(stream):
                if not name.endswith("/") and safe_name(name):
                    if body is None:
                        yield f"{path}!/{name}", None, None, why
                    else:
                        yield from self.rows(f"{path}!/{name}", body, level + 1)

    def chunks(self, path: str, stream):
        n = 0
        while True:
            data = stream.read(self.chunk)
            if not data and n:
                return
            self.left -= len(data)
            if self.left < 0:
                yield path, None, None, "expands beyond its bound"
                raise _TooMuch
            yield path, n, data, None
            n += 1
            if len(data) < self.chunk:
                return


class _TooMuch(Exception):
    pass


def member_chunks(files: DataFrame, levels: int = 3, chunk: int = 1 << 20, most: int = 16 << 30) -> DataFrame:
    """relpath, chunk, content, note: files as chunks of `chunk` bytes, archives replaced by their members (`archive!/member`).

    files: relpath, and content or else uri, which a task opens and reads as a stream. An empty member is one empty chunk. A
    note, without content, stands where an archive can't be read, lies more than `levels` deep, or expands beyond `most` bytes.
    """
    held = "content" in files.columns

    def opened(x: str | bytes | None) -> io.BufferedReader:
        if held:
            return io.BufferedReader(io.BytesIO(x or b""))
        fs, name = pyarrow.fs.FileSystem.from_uri(x)
        return io.BufferedReader(_Pushed(fs.open_input_stream(name, compression=None)), READ)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, x in zip(part.column(0), part.column(1)):
                rows, size = [], 0
                try:
                    for row in _Reader(levels, chunk, most).rows(path.as_py(), opened(x.as_py())):
                        rows.append(row)
                        size += len(row[2] or b"")
                        if size >= chunk or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, size = [], 0
                except _TooMuch:
                    pass
                if rows:
                    yield _batch(rows)

    return files.select("relpath", "content" if held else "uri").mapInArrow(run, MEMBER)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MEMBER)], schema=_MEMBER)


def members(files: DataFrame, levels: int = 3, largest: int = 1 << 28) -> DataFrame:
    """relpath, content: members of less than `largest` bytes whole, for readers that need them so."""
    whole = member_chunks(files, levels, chunk=largest)
    return whole.where((F.col("chunk") == 0) & (F.length("content") < largest)).select("relpath", "content")
