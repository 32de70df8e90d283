"""Media types of attachments from their bytes: flat signatures in whole-stage code, containers in Arrow batches.

ZIP packages are opened only within bounds (entries, directory bytes), XML with a document type is refused. A damaged or foreign
container keeps its plain type; a filename extension decides only between types the container allows.
"""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MOST_ENTRIES = 10_000
MOST_DIRECTORY = 8 << 20
MOST_XML = 4 << 20

#: Signatures in hexadecimal, and main parts of office packages and streams of older office files.
SIGNATURES = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
ZIPS = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
COMPOUND = bytes.fromhex("D0CF11E0A1B11AE1")
PACKAGES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
LEGACY = {"WordDocument": "application/msword", "Workbook": "application/vnd.ms-excel", "Book": "application/vnd.ms-excel", "PowerPoint Document": "application/vnd.ms-powerpoint"}
LEGACY_BY_EXTENSION = {"doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint"}


def flat_signature(data: Column) -> Column:
    """Type by the first bytes; null for none of the flat ones. JPEG needs its JFIF mark."""
    head = F.hex(F.substring(data, 1, 11))
    out = F.when(head.startswith("FFD8FFE0") & (F.substring(head, 13, 10) == "4A46494600"), "image/jpeg")
    for signature, kind in SIGNATURES:
        out = out.when(head.startswith(signature), kind)
    return out


def zip_signature(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 4)).isin(*(z.hex().upper() for z in ZIPS))


def package_type(data: bytes) -> tuple[str, bool]:
    """(type, whether an extension may decide) of a ZIP: an office type if its content types name exactly one main part."""
    plain = ("application/zip", True)
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or len(data) < end + 22:
        return plain
    entries, directory = struct.unpack_from("<HI", data, end + 10)
    if entries > MOST_ENTRIES or directory > MOST_DIRECTORY:
        return plain
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if len(names) > MOST_ENTRIES or "[Content_Types].xml" not in names:
                return "application/zip", False
            if z.getinfo("[Content_Types].xml").file_size > MOST_XML:
                return plain
            xml = z.read("[Content_Types].xml")
        if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
            return "application/zip", False
        mains = {kind for e in ET.fromstring(xml).iter() if e.tag.endswith("Override") and e.get("PartName", "").lstrip("/") in names for kind in PACKAGES.values() if e.get("ContentType") == kind + ".main+xml"}
        return (mains.pop(), False) if len(mains) == 1 else ("application/zip", False)
    except (zipfile.BadZipFile, ET.ParseError, OSError, ValueError, KeyError, NotImplementedError, RuntimeError):
        return plain


def compound_type(data: bytes, extension: str) -> str | None:
    """Type of a compound file by the streams in its directory: one family only; an extension settles a file with none."""
    try:
        shift, start, fat_count = struct.unpack_from("<H", data, 30)[0], struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 44)[0]
        if shift not in (9, 12) or fat_count > 109:
            return None
        size = 1 << shift
        at = lambda sector: data[(sector + 1) << shift : (sector + 2) << shift]
        fat = [x for s in struct.unpack_from(f"<{fat_count}I", data, 76) for x in struct.unpack(f"<{size // 4}I", at(s).ljust(size, b"\xff"))]
        names, seen, sector = set(), set(), start
        while sector < len(fat) and sector not in seen and len(seen) < 4096:
            seen.add(sector)
            page = at(sector)
            for i in range(0, len(page) - 127, 128):
                length, kind = struct.unpack_from("<HB", page, i + 64)
                if kind == 2 and 2 <= length <= 64:
                    names.add(page[i : i + length - 2].decode("utf-16-le", "replace"))
            sector = fat[sector]
    except struct.error:
        return None
    families = {LEGACY[n] for n in names if n in LEGACY}
    if len(families) == 1:
        return families.pop()
    return LEGACY_BY_EXTENSION.get(extension) if not families and names else None


def detect(data: bytes | None, filename: str | None) -> str | None:
    """Media type of bytes that have no flat signature."""
    if not data:
        return None
    extension = filename.rpartition(".")[2].lower() if filename and "." in filename else ""
    if data[:4] in ZIPS:
        kind, hint = package_type(data)
        return PACKAGES.get(extension, kind) if hint else kind
    return compound_type(data, extension) if data.startswith(COMPOUND) else None


@F.pandas_udf(T.StringType())
def _container(data: pd.Series, filename: pd.Series) -> pd.Series:
    return pd.Series([detect(None if d is None else bytes(d), f) for d, f in zip(data, filename, strict=True)], dtype=object)


def detected(df, data: str = "data", filename: str = "filename", into: str = "detected_mime"):
    """df with the media type of its bytes. Rows without a container signature never reach Python: they are split off by a filter,
    since a conditional would not keep the function from running."""
    rows = df.withColumn(into, flat_signature(F.col(data)))
    inner = F.coalesce(F.col(into).isNull() & (zip_signature(F.col(data)) | F.hex(F.substring(F.col(data), 1, 8)).eqNullSafe(COMPOUND.hex().upper())), F.lit(False))
    return rows.where(~inner).unionByName(rows.where(inner).withColumn(into, _container(F.col(data), F.col(filename))))
