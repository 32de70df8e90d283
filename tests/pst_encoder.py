"""A minimal encoder of Unicode personal stores for tests, after the public format description: leaf pages under one level of
index pages, blocks up to 8 KiB, heaps of one block."""

from __future__ import annotations

import struct

from postlode.functions.mapi import block_signature, crc


def heap(kind: int, items: list[bytes], root: int) -> bytes:
    """A heap block of the items (heap ids 0x20, 0x40, ...); root is the number of the root item, from 1."""
    body, at = b"", [12]
    for i in items:
        body += i
        at.append(12 + len(body))
    body += b"\0" * (len(body) % 2)
    return struct.pack("<HBBI4s", 12 + len(body), 0xEC, kind, root << 5, b"\0" * 4) + body + struct.pack(f"<HH{len(at)}H", len(items), 0, *at)


def bag(props: dict[int, tuple[int, bytes]], subs: dict[int, bytes] | None = None) -> bytes:
    """A property context; values of over four bytes become heap items, those in subs point to a subnode."""
    items: list[bytes] = [b"", b""]
    records = b""
    for prop, (kind, value) in sorted(props.items()):
        if kind in (0x0002, 0x0003, 0x000B):
            four = value.ljust(4, b"\0")
        elif subs and prop in subs:
            four = struct.pack("<I", subs[prop])
        else:
            items.append(value)
            four = struct.pack("<I", len(items) << 5)
        records += struct.pack("<HH", prop, kind) + four
    items[0] = struct.pack("<BBBBI", 0xB5, 2, 6, 0, 2 << 5 if records else 0)
    items[1] = records
    return heap(0xBC, items, 1)


def table(columns: list[tuple[int, int]], rows: list[dict[int, object]]) -> bytes:
    """A table context of (property, type) columns; the first is the row id. Text cells are heap items; None leaves a cell out."""
    widths = {0x0003: 4, 0x001F: 4}
    described, at = b"", 0
    for bit, (prop, kind) in enumerate(columns):
        described += struct.pack("<HHHBB", kind, prop, at, widths[kind], bit)
        at += 4
    bits = (len(columns) + 7) // 8
    items, matrix = [b"", b"", b""], b""
    for row in rows:
        cells, there = b"", 0
        for bit, (prop, kind) in enumerate(columns):
            v = row.get(prop)
            if v is None:
                cells += b"\0" * 4
                continue
            there |= 1 << (8 * bits - 1 - bit)
            if kind == 0x0003:
                cells += struct.pack("<i", v)
            else:
                items.append(v.encode("utf-16-le"))
                cells += struct.pack("<I", len(items) << 5)
        matrix += cells + there.to_bytes(bits, "big")
    items[0] = struct.pack("<BB4HIII", 0x7C, len(columns), at, at, at, at + bits, 2 << 5, 3 << 5 if rows else 0, 0) + described
    items[1] = struct.pack("<BBBBI", 0xB5, 4, 4, 0, 0)
    items[2] = matrix
    return heap(0x7C, items, 1)


class Writer:
    def __init__(self):
        self.body, self.bbt, self.nbt, self.next = bytearray(b"\0" * 1024), [], [], 4

    def block(self, data: bytes, internal: bool = False) -> int:
        bid = self.next | (2 if internal else 0)
        self.next += 4
        at = len(self.body)
        size = (len(data) + 16 + 63) // 64 * 64
        self.body += data.ljust(size - 16, b"\0") + struct.pack("<HHIQ", len(data), block_signature(at, bid), crc(data), bid)
        self.bbt.append((bid, at, len(data)))
        return bid

    def tree(self, data: bytes) -> int:
        """A data tree: one block, or an index over blocks of 8,176 bytes."""
        if len(data) <= 8176:
            return self.block(data)
        bids = [self.block(data[i : i + 8176]) for i in range(0, len(data), 8176)]
        return self.block(struct.pack(f"<BBHI{len(bids)}Q", 1, 1, len(bids), len(data), *bids), internal=True)

    def subs(self, entries: dict[int, tuple[int, int]]) -> int:
        if not entries:
            return 0
        return self.block(struct.pack("<BBHI", 2, 0, len(entries), 0) + b"".join(struct.pack("<QQQ", n, d, s) for n, (d, s) in sorted(entries.items())), internal=True)

    def node(self, nid: int, parent: int, data: bytes, subs: dict[int, tuple[int, int]] | None = None) -> None:
        self.nbt.append((nid, self.tree(data), self.subs(subs or {}), parent))

    def _page(self, kind: int, entries: list[bytes], size: int, level: int) -> int:
        self.body += b"\0" * (-len(self.body) % 512)
        at = len(self.body)
        head = b"".join(entries).ljust(488, b"\0") + struct.pack("<BBBBI", len(entries), 488 // size, size, level, 0)
        self.body += head + struct.pack("<BBHIQ", kind, kind, 0, crc(head), at)
        return at

    def _btree(self, kind: int, entries: list[tuple[int, bytes]], size: int) -> int:
        per = 488 // size
        pages = [(entries[i][0], self._page(kind, [e for _, e in entries[i : i + per]], size, 0)) for i in range(0, len(entries), per)]
        level = 1
        while len(pages) > 1:
            pages = [(pages[i][0], self._page(kind, [struct.pack("<QQQ", k, 0, at) for k, at in pages[i : i + 20]], 24, level)) for i in range(0, len(pages), 20)]
            level += 1
        return pages[0][1]

    def file(self) -> bytes:
        nbt = self._btree(0x81, [(n, struct.pack("<QQQII", n, d, s, p, 0)) for n, d, s, p in sorted(self.nbt)], 32)
        bbt = self._btree(0x80, [(b, struct.pack("<QQHHI", b, at, size, 2, 0)) for b, at, size in sorted(self.bbt)], 24)
        head = bytearray(564)
        struct.pack_into("<4sI2sHHBB", head, 0, b"!BDN", 0, b"SM", 23, 19, 1, 1)
        struct.pack_into("<Q", head, 184, len(self.body))
        struct.pack_into("<QQQQ", head, 216, 0, nbt, 0, bbt)
        head[512] = 0x80
        struct.pack_into("<I", head, 4, crc(bytes(head[8 : 8 + 471])))
        struct.pack_into("<I", head, 524, crc(bytes(head[8 : 8 + 516])))
        self.body[:564] = head
        return bytes(self.body)


u = lambda s: (0x001F, s.encode("utf-16-le"))
i = lambda v: (0x0003, struct.pack("<i", v))
INBOX, ROOT = 0x8082, 0x122
_EMPTY = [(0x67F2, 0x0003)]


def message(w: Writer, subject: str, embedded: bool = False, body: bytes = b"") -> tuple[bytes, dict]:
    props = {0x001A: u("IPM.Note"), 0x0037: u(subject), 0x0C1A: u("Nola Lark"), 0x0C1F: u("nola@mail.example"), 0x0039: (0x0040, struct.pack("<Q", 131219220137411478))}
    subs = {0x692: (w.tree(table([(0x67F2, 3), (0x0C15, 3), (0x3001, 0x1F), (0x3003, 0x1F), (0x3002, 0x1F)], [{0x67F2: 1, 0x0C15: 1, 0x3001: "Ülrik", 0x3003: "u@mail.example", 0x3002: "SMTP"}, {0x67F2: 2, 0x0C15: 2, 0x3003: "v@mail.example"}])), 0)}
    if embedded:
        inner_data, inner_subs = message(w, "inner of " + subject)
        subs[0x8025] = (w.tree(bag({0x3705: i(5), 0x3701: (0x000D, struct.pack("<II", 0x10044, 0)), 0x3704: u("inner.msg")})), w.subs({0x10044: (w.tree(inner_data), w.subs(inner_subs))}))
    if body:
        subs[0x8045] = (w.tree(bag({0x3705: i(1), 0x3701: (0x0102, body), 0x3707: u("file.bin")}, {0x3701: 0x1003F})), w.subs({0x1003F: (w.tree(body), 0)}))
    return bag(props), subs


def store(messages: int = 40, orphan: bool = True) -> bytes:
    """A store with a root folder, an inbox of messages (the first with an embedded one and a large attachment), and an orphan."""
    w = Writer()
    w.node(0x21, 0, bag({0x3001: u("Test store")}))
    w.node(0x1E1, 0, struct.pack("<2xHII8x", 1, 7, 8) + struct.pack("<2xHII8x", 99, 5, 0) + b"cut")
    name = "Keywords".encode("utf-16-le")
    w.node(0x61, 0, bag({0x2: (0x0102, bytes(range(16))), 0x3: (0x0102, struct.pack("<IHHIHH", 0x8501, 3 << 1, 0, 0, 2 << 1 | 1, 1)), 0x4: (0x0102, struct.pack("<I", len(name)) + name)}))
    w.node(ROOT, ROOT, bag({0x3001: u("Root")}))
    w.node(INBOX, ROOT, bag({0x3001: u("Inbox"), 0x3613: u("IPF.Note"), 0x3602: i(messages)}))
    ids = [0x200004 + 32 * k for k in range(messages)]
    for n in (ROOT, INBOX):
        w.node(n & ~0x1F | 0x0E, 0, table(_EMPTY, [{0x67F2: m} for m in ids] if n == INBOX else []))
        w.node(n & ~0x1F | 0x0F, 0, table(_EMPTY, []))
    for k, m in enumerate(ids):
        data, subs = message(w, f"Größe {k}", embedded=k == 0, body=b"\x25PDF-" + bytes(20_000) if k == 0 else b"")
        w.node(m, INBOX, data, subs)
    if orphan:
        data, subs = message(w, "orphan")
        w.node(0x300004, INBOX, data, subs)
    return w.file()
