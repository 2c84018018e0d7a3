"""Word, Excel and PowerPoint files of 1997-2003: compound files and the records inside, after the published formats."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from tarn.sources.archive import Unreadable
from tarn.sources.html import tidy
from tarn.sources.sheets import is_date_format, serial_date

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


class Compound:
    """A compound file: named streams in chains of sectors."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1") or len(data) < 512:
            raise Unreadable("not a compound file")
        self._data = data
        self._size = 1 << struct.unpack_from("<H", data, 30)[0]
        self._mini = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, _, self._cutoff, first_mini, _, first_fat, n_fat = struct.unpack_from("<7I", data, 48)
        fats = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while first_fat < END and n_fat and first_fat not in seen:
            seen.add(first_fat)
            more = struct.unpack(f"<{self._size // 4}I", self._sector(first_fat))
            fats += more[:-1]
            first_fat = more[-1]
        self._fat = [x for s in fats if s < END for x in struct.unpack(f"<{self._size // 4}I", self._sector(s))]
        entries = self._chain(first_dir)
        self._streams: dict[str, tuple[int, int]] = {}
        root = (END, 0)
        for at in range(0, len(entries) - 127, 128):
            used, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<IQ", entries, at + 116)
            name = entries[at : at + max(0, min(used, 64) - 2)].decode("utf-16-le", "ignore")
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self._streams[name] = (start, size & 0xFFFFFFFF)
        self._mini_data = self._chain(root[0])[: root[1]]
        mini = self._chain(first_mini)
        self._mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.names = list(self._streams)

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self._size
        return self._data[at : at + self._size].ljust(self._size, b"\xff")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END and n not in seen and n < len(self._fat):
            seen.add(n)
            out.append(self._sector(n))
            n = self._fat[n]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self._streams:
            return b""
        n, size = self._streams[name]
        if size >= self._cutoff:
            return self._chain(n)[:size]
        out, seen = [], set()
        while n < END and n not in seen and n < len(self._mini_fat):
            seen.add(n)
            out.append(self._mini_data[n * self._mini : (n + 1) * self._mini])
            n = self._mini_fat[n]
        return b"".join(out)[:size]


def kind_of(content: bytes) -> str:
    try:
        names = set(Compound(content).names)
    except (Unreadable, struct.error):
        return ""
    for stream, kind in (("WordDocument", "doc_binary"), ("PowerPoint Document", "ppt_binary"), ("Workbook", "xls_binary"), ("Book", "xls_binary")):
        if stream in names:
            return kind
    return ""


# ---- Word: the piece table says where the text lies, and in which encoding


def doc_pages(content: bytes) -> list[tuple[int, str]]:
    file = Compound(content)
    main = file.stream("WordDocument")
    if len(main) < 0x1AA or main[:2] != b"\xec\xa5":
        raise Unreadable("not a Word document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise Unreadable("encrypted")
    table = file.stream("1Table" if flags & 0x0200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, text = table[at : at + size], []
    while clx and clx[0] == 1:  # formatting of pieces
        clx = clx[3 + struct.unpack_from("<H", clx, 1)[0] :]
    if clx[:1] != b"\x02":
        raise Unreadable("no piece table")
    pieces = clx[5 : 5 + struct.unpack_from("<I", clx, 1)[0]]
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", pieces)
    for i in range(n):
        where = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * i + 2)[0]
        chars = ends[i + 1] - ends[i]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            text.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            text.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    raw = re.sub(r"\x13[^\x13-\x15]*\x14", "", "".join(text))  # field codes, not their results
    raw = raw.replace("\x07\x07", "\n").replace("\x07", " | ").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\f")
    return [(i, t) for i, t in enumerate((tidy(re.sub(r"[\x00-\x08\x0e-\x1f]", "", p)) for p in raw.split("\f")), 1)]


# ---- Excel: a stream of records


def _records(data: bytes):
    at = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


class _Strings:
    """Reads strings that may be cut between a record and its continuations."""

    def __init__(self, parts: list[bytes]):
        self._parts, self._part, self._at = parts, 0, 0

    def _left(self) -> int:
        return len(self._parts[self._part]) - self._at

    def _next(self) -> bool:
        if self._part + 1 >= len(self._parts):
            return False
        self._part, self._at = self._part + 1, 0
        return True

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if not self._left() and not self._next():
                break
            got = self._parts[self._part][self._at : self._at + n]
            self._at, out, n = self._at + len(got), out + got, n - len(got)
        return out

    def text(self) -> str:
        chars, flags = struct.unpack("<HB", self.take(3).ljust(3, b"\0"))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while chars:
            if not self._left():
                if not self._next():
                    break
                wide = self.take(1)[0] & 1  # each part says anew how wide its characters are
            n = min(chars, self._left() // (2 if wide else 1))
            if not n:
                break
            out += self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            chars -= n
        self.take(4 * runs + extra)
        return out


def _short_text(data: bytes, wide_length: bool = True) -> str:
    chars, at = (struct.unpack_from("<H", data)[0], 2) if wide_length else (data[0], 1)
    wide = data[at] & 1
    return data[at + 1 : at + 1 + chars * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 0x80000000 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def _shown(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def xls_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    file = Compound(content)
    data = file.stream("Workbook") or file.stream("Book")
    if not data:
        raise Unreadable("no workbook")
    records = list(_records(data))
    strings: list[str] = []
    sheets, formats, styles, epoch = [], {}, [], False
    for i, (_, kind, body) in enumerate(records):
        if kind == 0x2F:
            raise Unreadable("encrypted")
        if kind == 0x22:
            epoch = body[:2] == b"\x01\x00"
        elif kind == 0x85:
            sheets.append((struct.unpack_from("<I", body)[0], _short_text(body[6:], False)))
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", body)[0]] = _short_text(body[2:])
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0xFC:
            parts = [body[8:]]
            for _, k, b in records[i + 1 :]:
                if k != 0x3C:
                    break
                parts.append(b)
            reader = _Strings(parts)
            strings = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == 0x0A:
            break

    @lru_cache(maxsize=None)
    def dated(style: int) -> bool:
        return style < len(styles) and is_date_format(styles[style], formats.get(styles[style], ""))

    def number(value: float, style: int) -> str:
        return serial_date(_shown(value), epoch) if dated(style) else _shown(value)

    out = []
    for start, title in sheets:
        cells: dict[tuple[int, int], str] = {}
        pending = None
        for _, kind, body in _records(data[start:]):
            if kind == 0x0A:
                break
            if kind in (0xFD, 0x203, 0x27E, 0x06, 0x204, 0x205):
                row, column, style = struct.unpack_from("<HHH", body)
                if kind == 0xFD:
                    n = struct.unpack_from("<I", body, 6)[0]
                    cells[row, column] = strings[n] if n < len(strings) else ""
                elif kind == 0x203:
                    cells[row, column] = number(struct.unpack_from("<d", body, 6)[0], style)
                elif kind == 0x27E:
                    cells[row, column] = number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
                elif kind == 0x204:
                    cells[row, column] = _short_text(body[6:])
                elif kind == 0x205:
                    cells[row, column] = ("TRUE" if body[6] else "FALSE") if not body[7] else ""
                elif body[12:14] != b"\xff\xff":
                    cells[row, column] = number(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] == 0:
                    pending = row, column  # the text comes in the next record
                elif body[6] == 1:
                    cells[row, column] = "TRUE" if body[8] else "FALSE"
            elif kind == 0xBD:
                row, column = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[row, column + k] = number(_rk(raw), style)
            elif kind == 0x207 and pending:
                cells[pending], pending = _short_text(body), None
        if cells:
            height, width = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
            filled = sorted({r for r, _ in cells})
            out.append((title, [[cells.get((r, c), "") for c in range(width)] for r in filled] if height > 2 * len(filled) else [[cells.get((r, c), "") for c in range(width)] for r in range(height)]))
    return out


def xls_pages(content: bytes) -> list[tuple[int, str]]:
    pages = []
    for n, (title, rows) in enumerate(xls_sheets(content), 1):
        lines = [f"baris {i}: " + " | ".join(c for c in r if c) for i, r in enumerate(rows, 1) if any(r)]
        pages.append((n, "\n".join([title, *lines])))
    return pages


# ---- PowerPoint: a tree of records, texts in atoms


def _atoms(data: bytes, low: int = 0, high: int | None = None):
    high = len(data) if high is None else high
    while low + 8 <= high:
        version, kind, size = struct.unpack_from("<HHI", data, low)
        body = low + 8
        if version & 0xF == 0xF:
            yield kind, b""
            yield from _atoms(data, body, min(high, body + size))
        else:
            yield kind, data[body : min(high, body + size)]
        low = body + size


def ppt_pages(content: bytes) -> list[tuple[int, str]]:
    data = Compound(content).stream("PowerPoint Document")
    if not data:
        raise Unreadable("no presentation")
    pages: list[list[str]] = [[]]
    for kind, body in _atoms(data):
        if kind == 1006:  # a slide begins
            pages.append([])
        elif kind == 4000:
            pages[-1].append(body.decode("utf-16-le", "ignore"))
        elif kind == 4008:
            pages[-1].append(body.decode("cp1252", "ignore"))
    texts = [tidy("\n".join(p).replace("\r", "\n").replace("\x0b", "\n")) for p in pages]
    return [(i, t) for i, t in enumerate([t for t in texts if t], 1)]
