"""Byte ranges of text files, plain or gzip, and the records that begin in them.

A file is planned as ranges of a fixed size, whatever the cluster.  A record belongs to the range that holds the first byte of the mark ahead
of it (the file's first record: to the range at 0); its task reads on beyond the range until the record ends.

A gzip file of many members, as block gzip writes it, is split the same way: a range owns the members that begin in it.  Its task looks for the gzip magic and
checks a candidate by decoding its header and inflating what follows it, and records are joined over the borders of members.  A file of one member is one task's.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

import pyarrow.fs as pafs

BLOCK = 1 << 20
RANGE_BYTES = 32 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes that a candidate for a member must inflate to without an error, unless it ends before.
CHECKED = 1 << 16
#: Content of a member of ``BlockGzip``; compressed, it must stay below 64 KiB.
MEMBER = 0xFF00


@dataclass(frozen=True)
class Range:
    """Bytes ``begin`` to ``end`` (exclusive) of a file; ``number`` counts the ranges of all files in the order of their paths."""

    path: str
    begin: int
    end: int
    number: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and its name there."""
    if (local := re.sub("^file:/+", "/", path)).startswith("/"):
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(path)


def listed(paths: list[str]) -> list[pafs.FileInfo]:
    """The files of paths, which may be files, folders (without what starts with _ or .) or patterns with * ? [ in any part; by path, each once."""
    found: dict[str, tuple[str, pafs.FileInfo]] = {}
    for path in paths:
        fs, at = opened(path)
        lead = path[: len(path) - len(at)] if path.endswith(at) else ""
        parts = at.rstrip("/").split("/")
        first = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
        level = [fs.get_file_info("/".join(parts[:first]) or "/")]
        for pattern in parts[first:]:
            inside = [i for d in level if d.type == pafs.FileType.Directory for i in fs.get_file_info(pafs.FileSelector(d.path))]
            level = [i for i in inside if fnmatchcase(i.base_name, pattern)]
        for info in level:
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            some = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(info.path)) if i.type == pafs.FileType.File]
            for i in some:
                if i is info or not i.base_name.startswith(("_", ".")):
                    found[lead + i.path] = lead, i
    return [(path, i) for path, (_, i) in sorted(found.items())]


def planned(files: list[tuple[str, pafs.FileInfo]], size: int = RANGE_BYTES) -> list[list[Range]]:
    """Ranges of at most ``size`` bytes, several small ones together as one task's."""
    tasks: list[list[Range]] = []
    held, number = size + 1, 0
    for path, info in files:
        for begin in range(0, info.size, size):
            end = min(info.size, begin + size)
            if held + end - begin > size:
                tasks.append([])
                held = 0
            tasks[-1].append(Range(path, begin, end, number))
            held += end - begin
            number += 1
    return tasks


def _plain(data: BinaryIO, begin: int, end: int) -> Iterator[tuple[bytes, bool]]:
    if begin:
        data.seek(begin)
    at = begin
    while block := data.read(min(BLOCK, end - at) if at < end else BLOCK):
        yield block, at < end
        at += len(block)


def is_member(data: BinaryIO, at: int) -> bool:
    """Whether a gzip member begins at a place: its header is right and it inflates, to its checksum if it is short."""
    data.seek(at)
    raw = data.read(1 << 12)
    if len(raw) < 18 or raw[:3] != MAGIC or raw[3] & 0xE0:
        return False
    unpack, made = zlib.decompressobj(31), 0
    try:
        while raw and made < CHECKED and not unpack.eof:
            made += len(unpack.decompress(raw, CHECKED))
            raw = unpack.unconsumed_tail or data.read(1 << 12)
    except zlib.error:
        return False
    return unpack.eof or made >= CHECKED


def first_member(data: BinaryIO, begin: int, end: int) -> int | None:
    """Where the first member that begins in the range does."""
    if not begin:
        return 0
    at = begin
    while at < end:
        data.seek(at)
        block = data.read(min(BLOCK, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while found >= 0:
            if is_member(data, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += BLOCK
    return None


def _packed(data: BinaryIO, begin: int, end: int) -> Iterator[tuple[bytes, bool]]:
    start = first_member(data, begin, end)
    if start is None:
        return
    data.seek(start)
    raw, unpack = data.read(BLOCK), zlib.decompressobj(31)
    while raw:
        out = unpack.decompress(raw, BLOCK)
        if out:
            yield out, start < end
        if unpack.eof:
            raw = unpack.unused_data.lstrip(b"\0")
            while not raw and (more := data.read(BLOCK)):
                raw = more.lstrip(b"\0")  # padding between members
            start, unpack = data.tell() - len(raw), zlib.decompressobj(31)
        else:
            raw = unpack.unconsumed_tail or data.read(BLOCK)
            if not raw:
                raise EOFError("the last gzip member is cut off")


def pieces(data: BinaryIO, begin: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Content of a file from a range on, and whether it is the range's own; compression shows in the file's first bytes."""
    data.seek(0)
    packed = data.read(len(MAGIC)) == MAGIC
    data.seek(0)
    return _packed(data, begin, end) if packed else _plain(data, begin, end)


def between(content: Iterator[tuple[bytes, bool]], mark: bytes, first: bool) -> Iterator[bytes]:
    """What lies between the marks that begin in own content; ``first``: the content begins with a record.  What is held is one record and one block."""
    held, owned, within = bytearray(), 0, first
    for block, own in content:
        look = max(0, len(held) - len(mark) + 1)
        held += block
        if own:
            owned = len(held)
        at = 0
        while (found := held.find(mark, look)) >= 0:
            if within:
                yield bytes(held[at:found])
            within = found < owned
            if not within:
                return
            at = look = found + len(mark)
        if not within:
            at = max(at, len(held) - len(mark) + 1)
            if owned <= at and not own:
                return
        del held[:at]
        owned -= at
    if within:
        yield bytes(held)


class BlockGzip:
    """Writes gzip members of at most 64 KiB each, with their size in the header as block gzip has it."""

    def __init__(self, out: BinaryIO):
        self.out, self.held = out, bytearray()

    def write(self, content: bytes) -> None:
        self.held += content
        at = 0
        while len(self.held) - at >= MEMBER:
            self._member(self.held[at : at + MEMBER])
            at += MEMBER
        del self.held[:at]

    def _member(self, content: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(content) + pack.flush()
        size = 18 + len(body) + 8
        if size > 1 << 16:  # stored: five bytes for each block
            pack = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = pack.compress(content) + pack.flush()
            size = 18 + len(body) + 8
        self.out.write(MAGIC + b"\4\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(content), len(content)))

    def close(self) -> None:
        if self.held:
            self._member(bytes(self.held))
        self._member(b"")
        self.out.close()
