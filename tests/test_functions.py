import io
import json
import struct
import zipfile

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from postlode.functions import mapi, mime


@pytest.mark.parametrize(
    ("kind", "data", "want"),
    [
        (0x0002, b"\xff\xff", -1), (0x0003, struct.pack("<i", -5), -5), (0x0004, struct.pack("<f", 0.5), 0.5), (0x0005, struct.pack("<d", 2.5), 2.5), (0x0006, struct.pack("<q", 12345), 12345),
        (0x000A, struct.pack("<i", 7), 7), (0x000B, b"\1", True), (0x000B, b"\0\0", False), (0x0014, struct.pack("<q", -(2**63)), -(2**63)), (0x0040, struct.pack("<Q", 2**64 - 1), 2**64 - 1),
        (0x0048, bytes(range(16)), bytes(range(16)).hex()), (0x001F, "Ü\0".encode("utf-16-le"), "Ü"), (0x001E, b"abc\0def", "abc"), (0x0102, b"\1\2", "0102"),
        (0x1003, struct.pack("<2i", 1, -1), [1, -1]), (0x1102, struct.pack("<3I", 2, 12, 13) + b"abc", ["61", "6263"]), (0x101E, struct.pack("<I", 0), []),
        (0x101F, struct.pack("<2I", 1, 8) + "x".encode("utf-16-le"), ["x"]),
    ],
)
def test_values(kind, data, want):
    assert mapi.decode(kind, data) == want


@pytest.mark.parametrize(
    ("kind", "data"),
    [
        (0x0003, b"\0\0"), (0x000B, b"\0\0\0"), (0x0048, b"x"), (0x001F, b"a"), (0x001F, "a\0b".encode("utf-16-le")), (0x001F, b"\x00\xd8"), (0x1003, b"\0" * 5), (0x1102, b""),
        (0x1102, struct.pack("<I", 0) + b"x"), (0x1102, struct.pack("<3I", 2, 12, 11) + b"abc"), (0x1102, struct.pack("<2I", 1, 9) + b"abc"), (0x1102, struct.pack("<I", 70_000)), (0x9999, b""),
    ],
)
def test_wrong_forms(kind, data):
    with pytest.raises(ValueError):
        mapi.decode(kind, data)


@given(st.lists(st.binary(max_size=9), max_size=9))
def test_offset_values_round_trip(values):
    at, body = 4 + 4 * len(values), b""
    head = b""
    for v in values:
        head += struct.pack("<I", at + len(body))
        body += v
    assert mapi.offset_values(struct.pack("<I", len(values)) + head + body) == values


@given(st.binary(max_size=200), st.integers(0, 2**32 - 1))
def test_codings_undo_themselves(data, key):
    table = bytes((7 * k + 3) % 256 for k in range(256))
    assert mapi.substituted(mapi.substituted(data, table), mapi.inverse(table)) == data
    half = bytes(255 - k for k in range(256))  # undoes itself, as the middle table must
    assert mapi.keyed(mapi.keyed(data, key, table, half, mapi.inverse(table)), key, table, half, mapi.inverse(table)) == data


def test_crc_signature_rtf():
    assert mapi.crc(b"123456789") == 0x2DFD2D88  # the usual polynomial without inversions
    assert mapi.block_signature(0x12345678, 0x9ABC) == (0x1234) ^ ((0x12345678 ^ 0x9ABC) & 0xFFFF)
    body = b"some bytes"
    head = struct.pack("<IIII", len(body) + 12, 40, 0x75465A4C, mapi.crc(body))
    assert mapi.rtf_header(head + body) == {"form": "compressed", "raw_size": 40, "consistent": True}
    assert not mapi.rtf_header(head + body + b"x")["consistent"]
    with pytest.raises(ValueError):
        mapi.rtf_header(b"short")
    assert mapi.keywords_valid(["x" * 255]) and not mapi.keywords_valid(["x" * 256]) and not mapi.keywords_valid(["😀" * 128])


def test_compressed_rtf():
    # "{\\rtf1" from the dictionary's start, "hello" spelled, a repeated run, and the end
    start = len(mapi.RTF_START)
    ref = lambda at, n: struct.pack(">H", at << 4 | n - 2)
    body = bytes([0b01000001]) + ref(0, 6) + b"hello" + ref(start + 6, 5) + b"!" + bytes([0b1]) + ref(start + 17, 2)
    stream = struct.pack("<IIII", len(body) + 12, 17, 0x75465A4C, mapi.crc(body)) + body
    assert mapi.rtf(stream) == b"{\\rtf1hellohello!" and start == 207
    assert mapi.rtf(struct.pack("<IIII", 12 + 4, 4, 0x414C454D, 0) + b"{\\r}") == b"{\\r}"
    cut = body[:-3]
    with pytest.raises(ValueError):
        mapi.rtf(struct.pack("<IIII", len(cut) + 12, 17, 0x75465A4C, mapi.crc(cut)) + cut)


def test_columns(spark):
    df = spark.createDataFrame([(3, bytearray(struct.pack("<i", -2))), (3, bytearray(b"\0")), (None, bytearray(b"x")), (0x1F, None)], "k int, d binary")
    got = [(r.x.value, r.x.error is not None) for r in df.select(mapi.decoded("k", "d").alias("x")).collect()]
    assert got == [("-2", False), (None, True), (None, False), (None, False)]
    ints = spark.createDataFrame([(bytearray(struct.pack("<i", v)),) for v in (0, 1, -1, 2**31 - 1, -(2**31))] + [(bytearray(b"x"),), (None,)], "d binary")
    assert [r.v for r in ints.select(mapi.scalar_int(F.col("d"), 4).alias("v")).collect()] == [0, 1, -1, 2**31 - 1, -(2**31), None, None]
    sig = spark.createDataFrame([(0x12345678, 0x9ABC)], "o bigint, b bigint").select(mapi.signature_column("o", "b").alias("s")).first().s
    assert sig == mapi.block_signature(0x12345678, 0x9ABC)


def package(part, kind, extra=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", extra.decode() + f'<Types xmlns="x"><Override PartName="/{part}" ContentType="{kind}.main+xml"/></Types>')
        z.writestr(part, "<x/>")
    return out.getvalue()


def compound(*names):
    entries = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, 2) + bytes(61) for n in names).ljust(512, b"\0")
    head = bytearray(512)
    head[:8] = mime.COMPOUND
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<I", head, 44, 1)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<I", head, 76, 0)
    return bytes(head) + struct.pack("<II", 0xFFFFFFFD, 0xFFFFFFFE).ljust(512, b"\xff") + entries


CASES = [
    (b"%PDF-1.4", "x.txt", "application/pdf"), (b"\x89PNG\r\n\x1a\nxx", None, "image/png"), (b"\xff\xd8\xff\xe0\0\0JFIF\0", None, "image/jpeg"), (b"\xff\xd8\xff\xe0\0\0Exif\0", None, None),
    (b"GIF89a", None, "image/gif"), (b"II*\0", None, "image/tiff"), (b"", "a.pdf", None), (None, None, None), (b"hello", "a.docx", None),
    (package("word/document.xml", mime.PACKAGES["docx"]), "a.zip", mime.PACKAGES["docx"]), (package("xl/workbook.xml", "other"), "a.xlsx", "application/zip"),
    (package("word/document.xml", mime.PACKAGES["docx"], b"<!DOCTYPE x>"), "a.docx", "application/zip"), (b"PK\x03\x04 broken", "a.pptx", mime.PACKAGES["pptx"]), (b"PK\x03\x04 broken", "a", "application/zip"),
    (compound("WordDocument", "1Table"), "a.xls", "application/msword"), (compound("Workbook", "WordDocument"), "a.xls", None), (compound("Other"), "a.ppt", "application/vnd.ms-powerpoint"), (compound("Other"), None, None), (mime.COMPOUND, "a.doc", None),
]


def test_media_types(spark):
    df = spark.createDataFrame([(i, None if d is None else bytearray(d), f) for i, (d, f, _) in enumerate(CASES)], "i int, data binary, filename string")
    assert [r.detected_mime for r in mime.detected(df).orderBy("i").collect()] == [w for _, _, w in CASES]
    assert json
