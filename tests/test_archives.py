import bz2
import gzip
import io
import lzma
import random
import resource
import tarfile
import zipfile

import pytest

from quarrymill.sources import archives as ar, sniff as sn

FILES = "relpath string, content binary"


def zipped(names, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how.get("method", zipfile.ZIP_DEFLATED)) as z:
        for n, data in names.items():
            z.writestr(n, data)
    return out.getvalue()


def streamed_zip(names):
    """As a writer that can't go back makes it: sizes stand after the contents."""

    class Out(io.RawIOBase):
        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += b
            return len(b)

    out = Out()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in names.items():
            z.writestr(n, data)
    return bytes(out.data)


def tarred(names, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for n, data in names.items():
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def expanded(name, data, levels=3, chunk=1 << 20, most=1 << 40):
    """(members, notes) by the reader itself."""
    got, notes = {}, {}
    try:
        for path, n, content, note in ar._Reader(levels, chunk, most).rows(name, io.BufferedReader(io.BytesIO(data))):
            if note:
                notes[path] = note
            else:
                assert len(content) <= chunk and n == len(got.get(path, []))
                got.setdefault(path, []).append(content)
    except ar._TooMuch:
        pass
    return {p: b"".join(c) for p, c in got.items()}, notes


RAW = random.Random(1).randbytes(300_000)
BODY = {"a.txt": b"text " * 100_000, "d/b.bin": RAW, "empty": b"", "é.log": b"x"}


@pytest.mark.parametrize(
    "data",
    [zipped(BODY), zipped(BODY, method=zipfile.ZIP_STORED), streamed_zip(BODY), tarred(BODY), tarred(BODY, "w:gz"), tarred(BODY, "w:bz2"), tarred(BODY, "w:xz")],
    ids=["zip", "stored", "streamed", "tar", "gz", "bz2", "xz"],
)
def test_kinds(data):
    got, notes = expanded("a", data, chunk=70_000)
    assert got == {f"a!/{n}": b for n, b in BODY.items()} and not notes


def test_single_files_and_several_streams():
    for pack, end in ((gzip.compress, "gz"), (bz2.compress, "bz2"), (lzma.compress, "xz")):
        got, notes = expanded(f"x/log.txt.{end}", pack(RAW) + pack(b"more"))
        assert got == {f"x/log.txt.{end}!/log.txt": RAW + b"more"} and not notes


def test_nesting():
    inner = tarred({"deep.log": RAW, "z.zip": streamed_zip({"deepest": b"!" * 200_000})}, "w:gz")
    data = zipped({"ok": b"ok", "../evil": b"no", "/abs": b"no", "C:/x": b"no", "in.tgz": inner, "after": b"after"})
    got, notes = expanded("a.zip", data)
    assert got == {"a.zip!/ok": b"ok", "a.zip!/in.tgz!/deep.log": RAW, "a.zip!/in.tgz!/z.zip!/deepest": b"!" * 200_000, "a.zip!/after": b"after"} and not notes
    got, notes = expanded("a.zip", data, levels=2)
    assert set(notes) == {"a.zip!/in.tgz!/z.zip"} and "a.zip!/after" in got


def test_what_is_broken_says_so():
    whole = zipped({"a": RAW, "b": RAW})
    got, notes = expanded("a.zip", whole[: len(whole) // 2])
    assert "too early" in notes["a.zip"] or "too early" in next(iter(notes.values()))
    assert expanded("b.7z", b"zz")[1] and expanded("plain.txt", b"zz") == ({"plain.txt": b"zz"}, {})
    assert expanded("c.gz", gzip.compress(RAW)[:-200])[1]
    outer, notes = expanded("o.tar", tarred({"bad.gz": b"\x1f\x8bnot", "good": b"g"}))
    assert outer == {"o.tar!/good": b"g"} and set(notes) == {"o.tar!/bad.gz"}
    assert expanded("e.zip", zipped({})) == ({}, {})


def test_expansion_is_bounded():
    got, notes = expanded("bomb.gz", gzip.compress(bytes(50 << 20)), most=10 << 20)
    assert list(notes.values()) == ["expands beyond its bound"] and sum(map(len, got.values())) <= 10 << 20


def test_a_large_member_in_little_memory(tmp_path):
    """2 GB in a tar in a zip, from a file of 2 MB, in a process that may only have some hundred megabytes more."""
    import multiprocessing as mp

    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("t.tar", "w", force_zip64=True) as f:
        info = tarfile.TarInfo("huge")
        info.size = 2 << 30
        f.write(info.tobuf())
        for _ in range(2 << 10):
            f.write(bytes(1 << 20))
        f.write(bytes(1024))

    def run(out):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        size = 0
        for _, _, content, note in ar._Reader(3, 1 << 20, 1 << 40).rows("big.zip", open(path, "rb")):
            assert note is None
            size += len(content)
        out.put((size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before))

    ctx = mp.get_context("fork")
    out = ctx.Queue()
    p = ctx.Process(target=run, args=(out,))
    p.start()
    size, grown_kb = out.get(timeout=120)
    p.join()
    assert size == 2 << 30 and grown_kb < 100_000


def test_in_spark(spark, tmp_path):
    data = {"a.zip": zipped({"x": b"1", "big": RAW}), "none": None, "plain": b"p"}
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, v in data.items()], FILES)
    got = sorted((r.relpath, r.chunk, len(r.content)) for r in ar.member_chunks(df, chunk=200_000).collect())
    assert got == [("a.zip!/big", 0, 200_000), ("a.zip!/big", 1, 100_000), ("a.zip!/x", 0, 1), ("none", 0, 0), ("plain", 0, 1)]
    assert {r.relpath for r in ar.members(df, largest=200_000).collect()} == {"a.zip!/x", "none", "plain"}
    (tmp_path / "f.zip").write_bytes(data["a.zip"])
    by_uri = ar.member_chunks(spark.createDataFrame([("f", f"file://{tmp_path}/f.zip")], "relpath string, uri string"))
    assert sorted(r.relpath for r in by_uri.collect()) == ["f!/big", "f!/x"]


class Counted(io.BytesIO):
    reads = 0

    def read(self, n=-1):
        self.reads += 1
        return super().read(n)


def test_marks_across_blocks_are_found():
    import re

    wanted = re.compile(sn.FRAME_HEADER, re.I)
    for at in range(90, 110):
        data = Counted(b"." * at + b"0x5A  a5" + b"." * 1000)
        # only a head inside the carried bytes may be cut
        assert sn.sniff(data, wanted, block=100)[0] == at and data.reads <= 2
    assert sn.sniff(Counted(b"." * 5000 + b"5a a5"), wanted, block=100, blocks=40) == (None, 4000)
    assert sn.sniff(Counted(b""), wanted) == (None, 0)


def test_sniffed_files(spark, tmp_path):
    for name, data in {"hit": b"\xff" * 600_000 + b"5a a5 01" + b"." * 2_000_000, "none": b"5a" * 10, "empty": b""}.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(n, f"file://{tmp_path}/{n}") for n in ("hit", "none", "empty")] + [("null", None)], "relpath string, uri string")
    got = {r.relpath: (r.found, r.at, r.read) for r in sn.sniffed(df).collect()}
    assert got == {"hit": (True, 600_000, 2 * sn.BLOCK), "none": (False, None, 20), "empty": (False, None, 0), "null": (False, None, 0)}
