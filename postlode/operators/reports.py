"""Inventory, recovery and split reports as one-row frames, their JSON, and the checks between reports and ledger.

Only one-row aggregates reach the driver. Empty tables give rows of zeros.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

BODY_PROPERTIES = (0x1000, 0x1009, 0x1013)


def inventory(folders: DataFrame, messages: DataFrame, recipients: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row of counts over the catalog: each table is aggregated once."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    parts = [
        folders.agg(F.count("*").alias("folders")),
        messages.agg(F.count("*").alias("messages"), n(F.size("embedded_path") > 0, "embedded_messages"), n(F.col("associated"), "associated_messages"), n(~F.col("supported"), "unsupported_messages"), *(n(F.col("provenance") == p, f"{p}_messages") for p in ("normal", "recovered", "orphan", "fragment"))),
        recipients.agg(F.count("*").alias("recipients")),
        attachments.agg(F.count("*").alias("attachments"), F.coalesce(F.sum("data_size"), F.lit(0)).alias("attachment_bytes"), F.coalesce(F.max("data_size"), F.lit(0)).alias("largest_attachment"), n(F.col("data_size").isNull(), "incomplete_attachments")),
    ]
    return side_by_side(parts)


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """One row with the columns of several one-row frames: they are stacked and folded, which needs no cross join."""
    columns = [c for r in rows for c in r.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).agg(*(F.max(c).alias(c) for c in columns))


def body_bytes(properties: DataFrame) -> DataFrame:
    """Bytes of message bodies and the largest value of all, of (owner, property_id, byte_len)."""
    body = (F.col("owner") == "message") & F.col("property_id").isin(*BODY_PROPERTIES)
    return properties.agg(F.coalesce(F.sum(F.when(body, F.col("byte_len"))), F.lit(0)).alias("body_bytes"), F.coalesce(F.max("byte_len"), F.lit(0)).alias("peak_value_bytes"))


def split_report(summary: DataFrame, parts: DataFrame, issues: DataFrame | None = None, omitted: DataFrame | None = None, source_unchanged: bool = True, interrupted: bool = False, terminal_failure: bool = False) -> DataFrame:
    """One row: committed items, written, unsupported, unfinished (never below 0), parts, oversize parts, bytes, issues listed and dropped,
    what was omitted, and whether the data is clean, which it is if nothing of all that nor of the run's own state speaks against it.

    issues: one row with issues and issues_dropped; omitted: (kind, n) with kinds folders, properties and attachments. Absent ones are 0.
    """
    zero = F.lit(0).cast("bigint")
    p = parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("oversize"), F.lit(0)).alias("oversize_parts"), F.coalesce(F.sum("estimate_bytes"), F.lit(0)).alias("part_bytes"))
    s = summary.select(F.col("total").alias("committed"), "written", "unsupported", "recovered_items", (F.col("total") - F.col("recovered_items")).alias("normal_items"), F.greatest(F.col("total") - F.col("written") - F.col("unsupported"), F.lit(0)).alias("unfinished"), "partial", "damaged")
    i = issues.select("issues", "issues_dropped") if issues is not None else s.select(zero.alias("issues"), zero.alias("issues_dropped"))
    kinds = ("folders", "properties", "attachments")
    o = omitted.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), zero).alias(f"omitted_{k}") for k in kinds)) if omitted is not None else s.select(*(zero.alias(f"omitted_{k}") for k in kinds))
    none = ["unsupported", "partial", "issues", "issues_dropped", *(f"omitted_{k}" for k in kinds), "unfinished"]
    clean = F.lit(source_unchanged and not interrupted and not terminal_failure)
    for c in none:
        clean = clean & (F.col(c) == 0)
    return side_by_side([s, p, i, o]).withColumn("clean_data", clean)


def as_json(row: DataFrame, kind: str, version: int = 1) -> DataFrame:
    """(kind, json, sha256) of a one-row frame; the digest is over the JSON text, whose keys are in column order."""
    text = F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("schema_version"), *row.columns))
    return row.select(F.lit(kind).alias("kind"), text.alias("json")).withColumn("sha256", F.sha2("json", 256))


def state_digest(evidence: DataFrame) -> DataFrame:
    """SHA-256 over a one-row frame of evidence."""
    return evidence.select(F.sha2(F.to_json(F.struct(*evidence.columns)), 256).alias("digest"))


def human(row: dict, title: str) -> str:
    """A report as text lines, figures grouped by thousands."""
    width = max(map(len, row), default=0)
    return "\n".join([title, *(f"  {k.replace('_', ' '):<{width}}  {v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"  {k.replace('_', ' '):<{width}}  {v}" for k, v in row.items())]) + "\n"


def recovery_log(report: dict, part_rows: Iterable[dict], detail: int = 10_000) -> str:
    """The text log of a split: the figures, then the parts, of which at most detail are listed and the rest counted."""
    lines, more = [human(report, "split").rstrip()], 0
    for k, p in enumerate(part_rows):
        if k < detail:
            lines.append(f"  {p['filename']}  items {p['items']}  estimate {p['estimate_bytes']}{'  oversize' if p['oversize'] else ''}")
        else:
            more += 1
    return "\n".join([*lines, *([f"  and {more} more parts"] if more else [])]) + "\n"


# --- snapshots -----------------------------------------------------------------------------------------------------------


def snapshot(report: dict, path: str, most: int = 4 << 20) -> str:
    """Writes a report with its digest beside it; refuses one of over most bytes."""
    text = json.dumps(report, sort_keys=True, indent=2)
    if len(text.encode()) > most:
        raise ValueError("report too large")
    digest = hashlib.sha256(text.encode()).hexdigest()
    Path(path).write_text(text)
    Path(path + ".sha256").write_text(digest)
    return digest


def read_snapshot(path: str) -> dict:
    text = Path(path).read_text()
    if hashlib.sha256(text.encode()).hexdigest() != Path(path + ".sha256").read_text():
        raise ValueError("the report does not match its digest")
    return json.loads(text)


# --- sources of bytes -----------------------------------------------------------------------------------------------------


def source_identity(path: str, digest: bool = False) -> dict:
    """Device, inode, size and time of a regular file (no link), and its SHA-256 if asked for."""
    st = os.lstat(path)
    if not os.path.isfile(path) or os.path.islink(path):
        raise ValueError("not a regular file")
    out = {"path": path, "device": st.st_dev, "inode": st.st_ino, "size": st.st_size, "modified_ns": st.st_mtime_ns}
    if digest:
        with open(path, "rb") as f:
            out["sha256"] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def unchanged(before: dict) -> bool:
    return source_identity(before["path"], "sha256" in before) == before


def verified_blobs(blobs: DataFrame, data: DataFrame) -> DataFrame:
    """(sha256, state) of blobs against (sha256, data): ok, missing, wrong length or wrong bytes."""
    j = blobs.select("sha256", "byte_len").join(data.select("sha256", "data"), "sha256", "left")
    state = F.when(F.col("data").isNull(), "missing").when(F.octet_length("data") != F.col("byte_len"), "wrong length").when(F.sha2("data", 256) != F.col("sha256"), "wrong bytes").otherwise("ok")
    return j.select("sha256", state.alias("state"))


# --- small settings -------------------------------------------------------------------------------------------------------

#: Units of byte sizes.
_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def parse_byte_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS or not int(m[1]):
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _UNITS[m[2].lower()]


def record_key(tag: bytes, source_sha256: str, mode: str, form: bytes, most_bytes: int, part_index: int) -> str:
    """Identity of a part: the first 16 bytes of a digest over what decides its content, as hexadecimal."""
    if mode not in ("balanced", "aggressive"):
        raise ValueError("unknown mode")
    return hashlib.sha256(tag + bytes.fromhex(source_sha256) + mode.encode() + form + struct.pack("<QI", most_bytes, part_index)).digest()[:16].hex()


def predicted_bytes(estimate: int, actual: int, observed: int) -> int:
    """An estimate scaled by what an earlier one turned out to be, rounded up."""
    return -(-estimate * actual // observed) if observed else estimate


def batch_bytes(most: int, used: int) -> int:
    """How much to add before looking again: a sixteenth of the part, near its end a 256th."""
    return most // 256 if near_limit(most, used) else most // 16


def near_limit(most: int, used: int) -> bool:
    return used > most - most // 16


def safe_leaf(name: str) -> bool:
    return bool(name) and name not in (".", "..") and not re.search(r"[/\\\0]", name)
