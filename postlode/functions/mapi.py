"""Decoding of property values: little-endian scalars, packed and offset multi-values, UTF-16 text, compressed RTF headers.

Plain functions decode one value and raise ValueError on a wrong form; the column functions run them in Arrow batches and give a
struct (value as JSON text, error). Null in gives null in both. Bytes of any length are decoded whole.
"""

from __future__ import annotations

import json
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Struct codes and widths of fixed-width property types.
SCALARS = {0x0002: ("h", 2), 0x0003: ("i", 4), 0x0004: ("f", 4), 0x0005: ("d", 8), 0x0006: ("q", 8), 0x0007: ("d", 8), 0x000A: ("i", 4), 0x0014: ("q", 8), 0x0040: ("Q", 8), 0x0048: ("16s", 16)}
MULTI = 0x1000
MOST_VALUES = 65_536


def scalar(kind: int, data: bytes) -> object:
    """The value of a fixed-width property; booleans come in one or two bytes, currency in ten-thousandths."""
    if kind == 0x000B:
        if len(data) not in (1, 2):
            raise ValueError("a boolean takes one or two bytes")
        return any(data)
    if kind not in SCALARS:
        raise ValueError(f"no fixed width for type {kind:#06x}")
    code, width = SCALARS[kind]
    if len(data) != width:
        raise ValueError(f"type {kind:#06x} takes {width} bytes")
    value = struct.unpack("<" + code, data)[0]
    return value.hex() if isinstance(value, bytes) else value


def text16(data: bytes, terminated: bool = True) -> str:
    """UTF-16LE text up to its terminator, after which only zeros may follow; without one the whole is text."""
    if len(data) % 2:
        raise ValueError("odd length of UTF-16")
    text = data.decode("utf-16-le")
    head, nul, rest = text.partition("\0")
    if terminated and nul and rest.strip("\0"):
        raise ValueError("data after the terminator")
    return head if terminated else text


def text8(data: bytes, page: str = "cp1252") -> str:
    return data.partition(b"\0")[0].decode(page)


def offset_values(data: bytes) -> list[bytes]:
    """Values of a multi-value with count and offsets: offsets don't fall, start right after themselves and stay inside."""
    if len(data) < 4:
        raise ValueError("no count")
    (n,) = struct.unpack_from("<I", data)
    if n == 0:
        if len(data) != 4:
            raise ValueError("bytes after an empty list")
        return []
    if n > MOST_VALUES or 4 + 4 * n > len(data):
        raise ValueError("more offsets than bytes")
    at = [*struct.unpack_from(f"<{n}I", data, 4), len(data)]
    if at[0] != 4 + 4 * n or any(a > b for a, b in zip(at, at[1:], strict=False)):
        raise ValueError("offsets out of order")
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def packed_values(kind: int, data: bytes) -> list:
    """Values of a multi-value of fixed width, one after the other."""
    code, width = SCALARS.get(kind & ~MULTI, ("", 0))
    if not width or len(data) % width:
        raise ValueError("a partial value at the end")
    return [scalar(kind & ~MULTI, data[i : i + width]) for i in range(0, len(data), width)]


def keywords_valid(values: list[str]) -> bool:
    """Whether each keyword is under 256 UTF-16 units."""
    return all(len(v.encode("utf-16-le")) // 2 < 256 for v in values)


def decode(kind: int, data: bytes) -> object:
    """Any property value by its type."""
    if kind == 0x001F:
        return text16(data)
    if kind == 0x001E:
        return text8(data)
    if kind == 0x0102:
        return data.hex()
    if kind == 0x101F:
        return [text16(v) for v in offset_values(data)]
    if kind == 0x101E:
        return [text8(v) for v in offset_values(data)]
    if kind == 0x1102:
        return [v.hex() for v in offset_values(data)]
    return packed_values(kind, data) if kind & MULTI else scalar(kind, data)


def crc(data: bytes, seed: int = 0) -> int:
    """The store format's CRC: the usual polynomial without inversion before or after."""
    return zlib.crc32(data, seed ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def block_signature(offset: int, block: int) -> int:
    v = (offset ^ block) & 0xFFFFFFFF
    return (v >> 16) ^ (v & 0xFFFF)


def rtf_header(data: bytes) -> dict:
    """Header of a compressed RTF stream: sizes, form (compressed or plain), and whether size and CRC agree with what follows."""
    if len(data) < 16:
        raise ValueError("shorter than its header")
    size, raw, magic, check = struct.unpack_from("<IIII", data)
    form = {0x75465A4C: "compressed", 0x414C454D: "plain"}.get(magic)
    if form is None:
        raise ValueError("unknown form")
    body = data[16:]
    ok = size == len(data) - 4 and (crc(body) == check if form == "compressed" else raw == len(body))
    return {"form": form, "raw_size": raw, "consistent": ok}


#: Fixed value: what the dictionary of compressed RTF holds at the start.
RTF_START = (
    "{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArial"
    "Times New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def rtf(data: bytes) -> bytes:
    """The text of a compressed RTF stream: a ring of 4,096 bytes, control bits from the least on, and a reference to the write position
    as the end. ValueError if the header, a check or the end is wrong."""
    head = rtf_header(data)
    if not head["consistent"]:
        raise ValueError("size or CRC")
    if head["form"] == "plain":
        return data[16:]
    ring, at, out, i = bytearray(RTF_START.encode().ljust(4096, b"\0")), len(RTF_START), bytearray(), 16
    while i < len(data):
        control, i = data[i], i + 1
        for bit in range(8):
            if i >= len(data):
                break
            if not control >> bit & 1:
                ring[at], i = data[i], i + 1
                out.append(ring[at])
                at = (at + 1) & 4095
                continue
            if i + 1 >= len(data):
                raise ValueError("cut within a reference")
            pair, i = data[i] << 8 | data[i + 1], i + 2
            start, length = pair >> 4, (pair & 15) + 2
            if start == at:
                return bytes(out[: head["raw_size"]])
            for k in range(length):
                byte = ring[(start + k) & 4095]
                out.append(byte)
                ring[at] = byte
                at = (at + 1) & 4095
    raise ValueError("no end")


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def decoded(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Column form of decode(): value as JSON text, or what is wrong with it."""
    rows = []
    for k, d in zip(kind, data, strict=True):
        if d is None or pd.isna(k):
            rows.append((None, None))
            continue
        try:
            rows.append((json.dumps(decode(int(k), bytes(d)), ensure_ascii=False), None))
        except (ValueError, UnicodeDecodeError) as e:
            rows.append((None, str(e)[:200]))
    return pd.DataFrame(rows, columns=["value", "error"])


def scalar_int(data: Column, width: int) -> Column:
    """Signed little-endian integer of exactly width bytes, inside whole-stage code; null for another length."""
    unsigned = F.conv(F.hex(F.reverse(data)), 16, 10).cast("decimal(20,0)")
    half, full = F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)"), F.lit(str(1 << (8 * width))).cast("decimal(21,0)")
    return F.when(F.octet_length(data) == width, F.when(unsigned >= half, unsigned - full).otherwise(unsigned)).cast("bigint")


def valid_keywords(c: str) -> Column:
    return F.forall(c, lambda x: F.octet_length(F.encode(x, "UTF-16LE")) / 2 < 256)


def signature_column(offset: str, block: str) -> Column:
    v = F.expr(f"{offset} ^ {block}").bitwiseAND(0xFFFFFFFF)
    return F.shiftright(v, 16).bitwiseXOR(v.bitwiseAND(0xFFFF)).cast("int")


def substituted(data: bytes, table: bytes) -> bytes:
    """Permutation coding: each byte by the table's; decoding uses the inverse table. Tables are parameters of the reader."""
    return data.translate(table)


def inverse(table: bytes) -> bytes:
    if sorted(table) != list(range(256)):
        raise ValueError("a substitution table holds each byte once")
    out = bytearray(256)
    for i, b in enumerate(table):
        out[b] = i
    return bytes(out)


def keyed(data: bytes, key: int, first: bytes, second: bytes, third: bytes) -> bytes:
    """Cyclic coding, its own inverse if third undoes first: a 16-bit counter from the folded key moves through three tables."""
    import numpy as np

    start = ((key >> 16) ^ (key & 0xFFFF)) & 0xFFFF
    w = (start + np.arange(len(data))) & 0xFFFF
    low, high = (w & 0xFF).astype(np.uint8), (w >> 8).astype(np.uint8)
    a, b, c = (np.frombuffer(t, np.uint8) for t in (first, second, third))
    x = a[(np.frombuffer(data, np.uint8) + low).astype(np.uint8)]
    x = b[(x + high).astype(np.uint8)]
    return (c[(x - high).astype(np.uint8)] - low).astype(np.uint8).tobytes()
