"""A Spark data source for personal-store files, written from the public MS-PST format description.

    spark.dataSource.register(PstDataSource)
    spark.read.format("pst").option("table", "messages").load("/data/*.pst")

Tables: stores, folders, messages, recipients, attachments, properties, nodes, updates, named_properties, issues. A file is split by ranges of node ids, so one
large store is read by many tasks; ranges are told from the inner pages of the node tree, and each task descends to its own and holds a few
pages. A broken node, or a folder whose list of messages can't be read, gives a row of the issues table instead of failing the scan. Options: ``payload`` none, prefix or full with ``prefix_bytes`` (property and
attachment bytes are only cut out as far as asked for), ``nodes_per_task``, ``substitution`` and ``keys`` (the coding tables as
hexadecimal, 256 and 3 x 256 bytes; files coded that way can't be read without), ``mode`` balanced or aggressive (also takes message
nodes that no folder lists, as orphans).
"""

from __future__ import annotations

import glob
import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postlode.functions import mapi

SCHEMAS = {
    "stores": "path string, format string, crypt int, file_size bigint, root_nid bigint, display_name string, messages bigint, folders bigint",
    "folders": "path string, source_id bigint, parent_source_id bigint, name string, container_class string, contents int, associated int",
    "messages": "path string, message_id bigint, provenance string, folder_id bigint, parent_message_id bigint, parent_attachment_index int, embedded_path array<int>, associated boolean, message_class string, subject string, sender_name string, sender_email string, submit_filetime bigint, delivery_filetime bigint, supported boolean",
    "recipients": "path string, message_id bigint, recipient_index int, recipient_type int, display_name string, email_address string, address_type string",
    "attachments": "path string, message_id bigint, attachment_index int, attachment_type int, data_size bigint, filename string, detected_mime string, data binary",
    "properties": "path string, owner string, owner_id bigint, property_id int, property_type int, byte_len bigint, data binary",
    "nodes": "path string, nid bigint, node_type string, parent_nid bigint, data_bid bigint, sub_bid bigint",
    "issues": "path string, nid bigint, detail string",
    "updates": "path string, position bigint, kind string, first_nid bigint, second_nid bigint",
    "named_properties": "path string, property_id int, property_set string, number bigint, name string",
}
_INLINE = {0x0002, 0x0003, 0x0004, 0x000A, 0x000B, 0x0001}
DEEPEST = 256


class FormatError(ValueError):
    pass


class Store:
    """One file: header, block access, node lookups, property bags and tables."""

    def __init__(self, data, substitution: bytes | None = None, keys: bytes | None = None):
        self.data = data
        head = bytes(data[:564])
        if len(head) < 512 or head[:4] != b"!BDN" or head[8:10] != b"SM":
            raise FormatError("not a personal store")
        version = struct.unpack_from("<H", head, 10)[0]
        if version not in (14, 15, 23):
            raise FormatError(f"version {version}")
        if struct.unpack_from("<I", head, 4)[0] != mapi.crc(head[8 : 8 + 471]):
            raise FormatError("header CRC")
        self.wide = version == 23
        self.format = "unicode64" if self.wide else "ansi32"
        if self.wide:
            self.nbt, self.bbt = struct.unpack_from("<Q", head, 224)[0], struct.unpack_from("<Q", head, 240)[0]
            sentinel, self.crypt = head[512], head[513]
            if struct.unpack_from("<I", head, 524)[0] != mapi.crc(head[8 : 8 + 516]):
                raise FormatError("full header CRC")
        else:
            self.nbt, self.bbt = struct.unpack_from("<I", head, 188)[0], struct.unpack_from("<I", head, 196)[0]
            sentinel, self.crypt = head[460], head[461]
        if sentinel != 0x80 or self.crypt not in (0, 1, 2):
            raise FormatError("sentinel or coding")
        self.substitution = mapi.inverse(substitution) if substitution else None
        self.tables = tuple(keys[i : i + 256] for i in (0, 256, 512)) if keys else None
        self.word = "Q" if self.wide else "I"
        self.page = lru_cache(4096)(self._page)
        self.block = lru_cache(256)(self._block)

    # pages and nodes

    def _page(self, at: int) -> tuple[int, list[tuple]]:
        """(level, entries) of a B-tree page: keys with positions above level 0, else node or block entries."""
        raw = bytes(self.data[at : at + 512])
        if len(raw) < 512:
            raise FormatError(f"page at {at} beyond the end")
        meta = 488 if self.wide else 496
        count, _, size, level = raw[meta : meta + 4]
        crc_at = 500 if self.wide else 508
        if struct.unpack_from("<I", raw, crc_at)[0] != mapi.crc(raw[: 496 if self.wide else 500]):
            raise FormatError(f"page CRC at {at}")
        kind = raw[496 if self.wide else 500]
        if level:
            form = f"<{self.word * 3}"
        else:
            form = {0x81: f"<{self.word * 3}I", 0x80: f"<{self.word * 2}HH"}[kind]
        return level, [struct.unpack_from(form, raw, i * size) for i in range(count)]

    def _leaves(self, at: int, first: int = 0, last: int = 1 << 64) -> Iterator[tuple]:
        """Entries with keys from first to below last; pages outside are not read."""
        todo = [at]
        while todo:
            level, entries = self.page(todo.pop())
            if level:
                ends = [e[0] for e in entries[1:]] + [last]
                todo += [e[2] for e, end in reversed(list(zip(entries, ends, strict=True))) if e[0] < last and end > first]
            else:
                yield from (e for e in entries if first <= (e[0] & 0xFFFFFFFF) < last)

    def cuts(self, step: int) -> list[int]:
        """Node ids that part the node tree into ranges of about step nodes, told from its inner pages alone."""
        keys, todo, per = [], [self.nbt], 1
        while todo:
            level, entries = self.page(todo.pop())
            if level == 1:
                per = max(per, 488 // 32 if self.wide else 496 // 16)
                keys += [e[0] & 0xFFFFFFFF for e in entries]
            elif level:
                todo += [e[2] for e in reversed(entries)]
        return keys[max(1, step // per) :: max(1, step // per)]

    def _find(self, at: int, key: int) -> tuple | None:
        while True:
            level, entries = self.page(at)
            below = [e for e in entries if e[0] <= key]
            if not level:
                return next((e for e in reversed(below) if e[0] == key), None)
            if not below:
                return None
            at = below[-1][2]

    def nodes(self, ids: range = range(1 << 32)) -> Iterator[tuple[int, int, int, int]]:
        """(nid, data block, subnode block, parent) of the nodes in a range of ids, in key order."""
        for nid, data, sub, parent in self._leaves(self.nbt, ids.start, ids.stop):
            yield nid & 0xFFFFFFFF, data, sub, parent

    def node(self, nid: int) -> tuple[int, int] | None:
        e = self._find(self.nbt, nid)
        return (e[1], e[2]) if e else None

    # blocks

    def _block(self, bid: int) -> bytes:
        e = self._find(self.bbt, bid & ~1)
        if e is None:
            raise FormatError(f"no block {bid:#x}")
        at, size = e[1], e[2]
        raw = bytes(self.data[at : at + size])
        trailer = 16 if self.wide else 12
        end = at + (size + trailer + 63) // 64 * 64
        tail = bytes(self.data[end - trailer : end])
        if len(raw) < size or len(tail) < trailer:
            raise FormatError(f"block {bid:#x} beyond the end")
        length, signature = struct.unpack_from("<HH", tail)
        crc = struct.unpack_from("<I", tail, 4 if self.wide else 8)[0]
        if length != size or crc != mapi.crc(raw) or signature != mapi.block_signature(at, bid & ~1):
            raise FormatError(f"block {bid:#x} fails its check")
        if bid & 2 or not self.crypt:
            return raw
        if self.crypt == 1 and self.substitution:
            return mapi.substituted(raw, self.substitution)
        if self.crypt == 2 and self.tables:
            return mapi.keyed(raw, bid & 0xFFFFFFFF, *self.tables)
        raise FormatError("coded file, and no tables were given")

    def blocks(self, bid: int, depth: int = 0) -> Iterator[bytes]:
        """The data blocks of a tree, in order."""
        if not bid:
            return
        raw = self.block(bid)
        if not bid & 2:
            yield raw
            return
        if raw[0] != 1 or depth > 2:
            raise FormatError(f"block {bid:#x} is no data tree")
        count = struct.unpack_from("<H", raw, 2)[0]
        for child in struct.unpack_from(f"<{count}{self.word}", raw, 8):
            yield from self.blocks(child, depth + 1)

    def data_size(self, bid: int) -> int:
        """Bytes of a data tree, from its header or, of a single block, from its entry: no data is read."""
        if not bid:
            return 0
        if bid & 2:
            return struct.unpack_from("<I", self.block(bid), 4)[0]
        e = self._find(self.bbt, bid & ~1)
        if e is None:
            raise FormatError(f"no block {bid:#x}")
        return e[2]

    def subnodes(self, bid: int) -> dict[int, tuple[int, int]]:
        """{nid: (data, sub)} of a subnode tree."""
        out: dict[int, tuple[int, int]] = {}
        todo = [bid] if bid else []
        while todo:
            raw = self.block(todo.pop())
            if raw[0] != 2:
                raise FormatError("no subnode block")
            count, at = struct.unpack_from("<H", raw, 2)[0], 8 if self.wide else 4
            size = (24 if self.wide else 12) if raw[1] == 0 else (16 if self.wide else 8)
            for i in range(count):
                e = struct.unpack_from(f"<{self.word * (3 if raw[1] == 0 else 2)}", raw, at + i * size)
                if raw[1] == 0:
                    out[e[0] & 0xFFFFFFFF] = (e[1], e[2])
                else:
                    todo.append(e[1])
        return out


class Heap:
    """Heap on a node's blocks, with its subnodes: property bags and tables live on it."""

    def __init__(self, store: Store, data: int, sub: int):
        self.store, self.parts, self.subs = store, list(store.blocks(data)), store.subnodes(sub)
        if not self.parts or self.parts[0][2:3] != b"\xec":
            raise FormatError("no heap")
        self.kind, self.root = self.parts[0][3], struct.unpack_from("<I", self.parts[0], 4)[0]

    def item(self, hid: int) -> bytes:
        if not hid:
            return b""
        index, block = (hid >> 5) & 0x7FF, hid >> 16
        part = self.parts[block]
        at = struct.unpack_from("<H", part)[0]
        count = struct.unpack_from("<H", part, at)[0]
        if not 1 <= index <= count:
            raise FormatError(f"no heap item {hid:#x}")
        a, b = struct.unpack_from("<HH", part, at + 4 + 2 * (index - 1))
        return part[a:b]

    def value(self, hnid: int, limit: int | None = None) -> bytes:
        """Bytes behind a heap or node id, not more blocks than limit asks for."""
        if hnid & 0x1F == 0:
            return self.item(hnid)[:limit]
        if hnid not in self.subs:
            raise FormatError(f"no subnode {hnid:#x}")
        out = b""
        for part in self.store.blocks(self.subs[hnid][0]):
            out += part
            if limit is not None and len(out) >= limit:
                return out[:limit]
        return out

    def size(self, hnid: int) -> int:
        if hnid & 0x1F == 0:
            return len(self.item(hnid))
        if hnid not in self.subs:
            raise FormatError(f"no subnode {hnid:#x}")
        return self.store.data_size(self.subs[hnid][0])

    def records(self, hid: int) -> Iterator[tuple[bytes, bytes]]:
        head = self.item(hid)
        if len(head) < 8 or head[0] != 0xB5:
            raise FormatError("no tree on the heap")
        key, size, levels, root = head[1], head[2], head[3], struct.unpack_from("<I", head, 4)[0]
        todo = [(root, levels)] if root else []
        while todo:
            hid, level = todo.pop()
            raw, step = self.item(hid), key + (4 if level else size)
            rows = [(raw[i : i + key], raw[i + key : i + step]) for i in range(0, len(raw) - step + 1, step)]
            if level:
                todo += [(struct.unpack("<I", d)[0], level - 1) for _, d in reversed(rows)]
            else:
                yield from rows

    def bag(self) -> dict[int, tuple[int, bytes]]:
        """{property id: (type, four value bytes)} of a property context."""
        if self.kind != 0xBC:
            raise FormatError("no property context")
        return {struct.unpack("<H", k)[0]: (struct.unpack_from("<H", d)[0], d[2:6]) for k, d in self.records(self.root)}

    def raw(self, entry: tuple[int, bytes], limit: int | None = None) -> bytes:
        kind, four = entry
        if kind in _INLINE:
            return four[: {0x0002: 2, 0x000B: 1}.get(kind, 4)]
        return self.value(struct.unpack("<I", four)[0], limit)

    def get(self, bag: dict, *ids: int):
        """The first of the properties that is there and decodes; text and numbers as Python values."""
        for i in ids:
            if i in bag:
                try:
                    return mapi.decode(bag[i][0], self.raw(bag[i]))
                except (ValueError, IndexError, struct.error):
                    continue
        return None

    def rows(self) -> Iterator[dict]:
        """Rows of a table context: {row: row id, property id: value}; a cell that isn't there or doesn't decode is left out."""
        if self.kind != 0x7C:
            raise FormatError("no table context")
        info = self.item(self.root)
        columns, ends = info[1], struct.unpack_from("<4H", info, 2)
        hnid = struct.unpack_from("<I", info, 14)[0]
        described = [struct.unpack_from("<HHHBB", info, 22 + 8 * i) for i in range(columns)]
        width = ends[3]
        if not hnid or not width:
            return
        parts = [self.item(hnid)] if hnid & 0x1F == 0 else list(self.store.blocks(self.subs[hnid][0]))
        for part in parts:
            for at in range(0, len(part) - width + 1, width):
                row = part[at : at + width]
                bits, out = row[ends[2] :], {"row": struct.unpack_from("<I", row)[0]}
                for kind, prop, start, size, bit in described:
                    if not bits[bit // 8] >> (7 - bit % 8) & 1:
                        continue
                    cell = row[start : start + size]
                    try:
                        out[prop] = mapi.decode(kind, cell if kind in _INLINE or kind in mapi.SCALARS and size == mapi.SCALARS[kind][1] else self.value(struct.unpack("<I", cell)[0]))
                    except (ValueError, IndexError, struct.error):
                        continue
                yield out


#: Kinds of records in the search update queue, in the order of their numbers from 0; a record takes 20 bytes.
UPDATES = [
    "null", "message_added", "message_modified", "message_deleted", "message_moved", "folder_added", "folder_modified", "folder_deleted", "folder_moved",
    "search_added", "search_modified", "search_deleted", "message_row_modified", "message_spam", "indexed_message_deleted", "message_indexed",
]


def search_updates(store: Store, nid: int = 0x1E1) -> Iterator[tuple[int, str | None, int, int]]:
    """(position, kind, first node, second node) of the store's queue of changes, oldest first; a cut record at the end is left out."""
    found = store.node(nid)
    raw = b"".join(store.blocks(found[0])) if found else b""
    for at in range(0, len(raw) - 19, 20):
        kind, first, second = struct.unpack_from("<2xHII", raw, at)
        yield at // 20, UPDATES[kind] if kind < len(UPDATES) else None, first, second


def named_properties(store: Store) -> Iterator[tuple[int, str, int | None, str | None]]:
    """(property id, set as hexadecimal, number, name) of the store's map of named properties."""
    found = store.node(0x61)
    if not found:
        return
    h = Heap(store, *found)
    bag = h.bag()
    stream = lambda i: h.raw(bag[i]) if i in bag else b""
    sets, entries, names = stream(0x0002), stream(0x0003), stream(0x0004)
    for at in range(0, len(entries) - 7, 8):
        value, packed, index = struct.unpack_from("<IHH", entries, at)
        which = packed >> 1
        guid = {0: "", 1: "2803020000000000c000000000000046", 2: "2903020000000000c000000000000046"}.get(which) if which < 3 else sets[16 * (which - 3) : 16 * (which - 2)].hex()
        if packed & 1:
            size = struct.unpack_from("<I", names, value)[0]
            yield 0x8000 + index, guid, None, names[value + 4 : value + 4 + size].decode("utf-16-le", "replace")
        else:
            yield 0x8000 + index, guid, value, None


# --- scanning a store -----------------------------------------------------------------------------------------------------


def _ticks(value) -> int | None:
    return value if isinstance(value, int) and value < 1 << 63 else None


class Scan:
    def __init__(self, store: Store, path: str, payload: str = "none", prefix: int = 4096, mode: str = "balanced"):
        self.store, self.path, self.mode = store, path, mode
        self.limit = {"none": 0, "prefix": prefix, "full": None}[payload]

    def heap(self, nid: int) -> Heap | None:
        found = self.store.node(nid)
        return Heap(self.store, *found) if found else None

    def listed(self, folder: int) -> Iterator[tuple[int, bool]]:
        """(message, associated) of a folder's contents tables."""
        for kind, associated in ((0x0E, False), (0x0F, True)):
            h = self.heap(folder & ~0x1F | kind)
            for row in h.rows() if h else ():
                yield row["row"], associated

    def top_messages(self, ids: range, issues: list) -> Iterator[tuple[int, str, int, bool]]:
        """(message, provenance, folder, associated): those folders list, and in aggressive mode message nodes that none does. A folder whose
        list can't be read is an issue, with how many of its messages in the range are not listed for it."""
        parents = {n: p for n, _, _, p in self.store.nodes(ids) if n & 0x1F in (4, 8)}
        listed: dict[int, tuple[int, bool]] = {}
        for folder in {p for p in parents.values() if p & 0x1F in (2, 3)}:
            try:
                listed |= {m: (folder, a) for m, a in self.listed(folder) if m in parents}
            except (FormatError, struct.error, IndexError) as e:
                issues.append((self.path, folder, f"contents of the folder: {e}; {sum(p == folder for p in parents.values())} messages from {ids.start:#x} on not listed"[:300]))
        for n, p in parents.items():
            if n in listed:
                yield n, "normal", listed[n][0], listed[n][1]
            elif self.mode == "aggressive":
                yield n, "orphan", p, n & 0x1F == 8

    def messages(self, ids: range, issues: list) -> Iterator[tuple]:
        """(row, heap, bag) of messages and those embedded in them, parents first. Ids of embedded messages are their subnode ids."""
        for n, provenance, folder, associated in self.top_messages(ids, issues):
            todo = [(n, lambda n=n: self.heap(n), None, None, [])]
            while todo:
                nid, opened, parent, index, way = todo.pop()
                try:
                    h = opened()
                    bag = h.bag()
                    cls = h.get(bag, 0x001A)
                    row = (
                        self.path, nid, provenance, folder, parent, index, way, associated, cls, h.get(bag, 0x0037), h.get(bag, 0x0C1A, 0x0042), h.get(bag, 0x0C1F, 0x0065),
                        _ticks(h.get(bag, 0x0039)), _ticks(h.get(bag, 0x0E06)), bool(cls) and (bool(way) or not cls.lower().startswith("ipm.ole.class.")),
                    )
                    yield row, h, bag
                    for i, a, abag in self.attachments(h):
                        if 0x3701 in abag and abag[0x3701][0] == 0x000D:
                            if len(way) == DEEPEST:
                                issues.append((self.path, nid, f"messages below {DEEPEST} levels are not read"))
                            else:
                                inner = struct.unpack_from("<I", a.value(struct.unpack("<I", abag[0x3701][1])[0]))[0]
                                if inner in a.subs:
                                    todo.append((inner, lambda a=a, inner=inner: Heap(self.store, *a.subs[inner]), nid, i, [*way, i]))
                except (FormatError, struct.error, IndexError, KeyError) as e:
                    issues.append((self.path, nid, str(e)[:300]))

    def attachments(self, h: Heap) -> Iterator[tuple[int, Heap, dict]]:
        for i, nid in enumerate(sorted(n for n in h.subs if n & 0x1F == 5)):
            a = Heap(self.store, *h.subs[nid])
            yield i, a, a.bag()

    def rows(self, table: str, ids: range) -> Iterator[tuple]:
        issues: list = []
        if table == "nodes":
            from postlode.schema import NODE_TYPES

            for n, d, s, p in self.store.nodes(ids):
                yield self.path, n, NODE_TYPES.get(n & 0x1F), p, d, s
        elif table == "folders":
            yield from self.folders(ids, issues)
        else:
            for row, h, bag in self.messages(ids, issues):
                try:
                    yield from self.parts(table, row, h, bag)
                except (FormatError, struct.error, IndexError, KeyError) as e:
                    issues.append((self.path, row[1], str(e)[:300]))
            if table == "issues":
                for _ in self.folders(ids, issues):  # for what is wrong with them
                    pass
                yield from issues

    def folders(self, ids: range, issues: list) -> Iterator[tuple]:
        """Rows of the folder nodes in a range; one that can't be read is an issue."""
        for n, _, _, p in self.store.nodes(ids):
            if n & 0x1F not in (2, 3):
                continue
            try:
                h = self.heap(n)
                bag = h.bag()
                yield self.path, n, None if p == n else p, h.get(bag, 0x3001), h.get(bag, 0x3613), h.get(bag, 0x3602), h.get(bag, 0x3617)
            except (FormatError, struct.error, IndexError) as e:
                issues.append((self.path, n, f"folder: {e}"[:300]))

    def parts(self, table: str, row: tuple, h: Heap, bag: dict) -> Iterator[tuple]:
        nid = row[1]
        cut = lambda heap, e: None if self.limit == 0 else heap.raw(e, self.limit)
        if table == "messages":
            yield row
        elif table == "recipients" and 0x692 in h.subs:
            for i, r in enumerate(Heap(self.store, *h.subs[0x692]).rows()):
                yield self.path, nid, i, r.get(0x0C15), r.get(0x3001), r.get(0x39FE, r.get(0x3003)), r.get(0x3002)
        elif table == "attachments":
            for i, a, abag in self.attachments(h):
                data = abag.get(0x3701)
                inline = data if data and data[0] == 0x0102 else None
                yield self.path, nid, i, a.get(abag, 0x3705), a.size(struct.unpack("<I", inline[1])[0]) if inline else a.get(abag, 0x0E20), a.get(abag, 0x3707, 0x3704), a.get(abag, 0x370E), cut(a, inline) if inline else None
        elif table == "properties":
            owners = [("message", nid, h, bag), *(("attachment", nid, a, abag) for _, a, abag in self.attachments(h))]
            for owner, owner_id, heap, props in owners:
                for prop, entry in props.items():
                    size = len(heap.raw(entry)) if entry[0] in _INLINE else heap.size(struct.unpack("<I", entry[1])[0])
                    yield self.path, owner, owner_id, prop, entry[0], size, cut(heap, entry)

    def summary(self) -> tuple:
        kinds = [n & 0x1F for n, *_ in self.store.nodes()]
        h = self.heap(0x21)
        return self.path, self.store.format, self.store.crypt, len(self.store.data), 0x122, h.get(h.bag(), 0x3001) if h else None, kinds.count(4), kinds.count(2)


# --- data source ----------------------------------------------------------------------------------------------------------


@dataclass
class NodeRange(InputPartition):
    path: str
    first: int
    last: int


def _opened(path: str, options: dict) -> Store:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    tables = [bytes.fromhex(options[k]) if options.get(k) else None for k in ("substitution", "keys")]
    return Store(data, *tables)


class PstReader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.options, self.table = dict(options), table

    def partitions(self) -> list[NodeRange]:
        given = self.options["path"]
        paths = sorted(glob.glob(os.path.join(given, "*.pst")) if os.path.isdir(given) else glob.glob(given))
        step, out = int(self.options.get("nodes_per_task", 10_000)), []
        for path in paths:
            if self.table in ("stores", "updates", "named_properties"):
                out.append(NodeRange(path, 0, 1 << 32))
                continue
            try:
                inner = _opened(path, self.options).cuts(step)
            except (FormatError, struct.error):
                inner = []
            cuts = [0, *inner, 1 << 32]
            out += [NodeRange(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: NodeRange) -> Iterator[tuple]:
        try:
            store = _opened(partition.path, self.options)
        except (FormatError, struct.error) as e:
            if self.table == "issues":
                yield partition.path, None, str(e)[:300]
            return
        scan = Scan(store, partition.path, self.options.get("payload", "none"), int(self.options.get("prefix_bytes", 4096)), self.options.get("mode", "balanced"))
        whole = {"stores": lambda: [scan.summary()], "updates": lambda: ((partition.path, *u) for u in search_updates(store)), "named_properties": lambda: ((partition.path, *p) for p in named_properties(store))}
        yield from whole[self.table]() if self.table in whole else scan.rows(self.table, range(partition.first, partition.last))


class PstDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pst"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "messages")]

    def reader(self, schema) -> PstReader:
        return PstReader(self.options, self.options.get("table", "messages"))
