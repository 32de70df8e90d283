"""Deeply nested JSON records as related flat tables with Merkle identities.

A record is one JSON object (a mail) with lists of child objects, and below its attachments further mails to any depth. Each
object becomes one occurrence row with the link to its parent. Every object also gets an identity: a hash over its kind, its
own fields in canonical form (keys sorted, no spaces) and the identities of its children by relation and ordinal, taken bottom
up. Equal subtrees thus share one identity, so each object is stored once, and the bridge keeps every place it occurs.

Parsing is JSON syntax of unknown depth, which Spark's from_json can't express without a fixed schema; it runs in Arrow batches,
one record at a time, without any state between records. Everything after it is plain DataFrame work.

Defined results for odd input
-----------------------------
* Per record key only the row with the latest time counts (null times come first; of several the greatest text). If its text is
  null or not well-formed (NaN and Infinity are not JSON), or not an object, there are no rows.
* An object in place of a list is its entry 0. Entries that aren't objects give no row but keep their position. An empty object
  gives a row. Other keys stay in the object's own fields and aren't entered.
* Nothing is lost: what of a list of children is no object, an empty or null list, or one that is no list, stays in the own fields
  (a list as its length and its other entries by position), so that a record can be put together again from its objects and the bridge
  (rebuilt), and objects that differ only there have different identities.
* ``embedded`` may be an object or text holding one; other values are no mail.
* Rows with a null record key are left out. Records of any depth are parsed; nothing recurses.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What may be below what: the relations of each kind, as (key, kind of the child, whether it is a list).
CHILDREN = {
    "mail": (("recipients", "recipient", True), ("attachments", "attachment", True), ("properties", "property", True)),
    "recipient": (("properties", "property", True),),
    "attachment": (("properties", "property", True), ("embedded", "mail", False)),
    "property": (),
}

_SCHEMA = "mail_id bigint, node_kind string, node_path string, parent_path string, relation string, ordinal int, object_id string, parent_object_id string, content string"
_ARROW = pa.schema(
    [("mail_id", pa.int64())] + [(c, pa.string()) for c in ("node_kind", "node_path", "parent_path", "relation")] + [("ordinal", pa.int32())] + [(c, pa.string()) for c in ("object_id", "parent_object_id", "content")]
)
_FLUSH = 20_000


def latest_records(records: DataFrame, key: str = "mail_id", time: str = "captured_at", text: str = "record_json") -> DataFrame:
    """(mail_id, record_json): the newest record of each key. A maximum, so a key that holds very many rows folds in every task."""
    return records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("mail_id")).agg(F.max(F.struct(F.col(time).alias("t"), F.col(text).alias("r"))).alias("v")).where("v.r is not null").select("mail_id", F.col("v.r").alias("record_json"))


def _not_json(name: str) -> None:
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """JSON without recursion, for texts nested deeper than the built-in parser goes. Raises ValueError if it isn't well-formed."""
    at, root = 0, []
    stack: list = [root]
    keys: list = [None]
    want = "value"  # value, key, colon, comma; first: value or ], first key: key or }
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r") or len(stack) > 1 or not root:
                raise ValueError("not JSON")
            return root[0]
        at = m.end()
        mark, string, number, word = m.groups()
        here = stack[-1]
        if len(stack) == 1 and root:
            raise ValueError("text after the end")
        if mark in ("}", "]") and (want == "comma" or want == ("first key" if mark == "}" else "first")) and len(stack) > 1 and isinstance(here, dict) == (mark == "}"):
            stack.pop()
            keys.pop()
            want = "comma"
            continue
        if want == "comma":
            if mark != ",":
                raise ValueError("no comma")
            want = "key" if isinstance(here, dict) else "value"
        elif want in ("key", "first key"):
            if string is None:
                raise ValueError("no key")
            keys[-1], want = json.loads(string), "colon"
        elif want == "colon":
            if mark != ":":
                raise ValueError("no colon")
            want = "value"
        else:
            if mark in ("{", "["):
                value: object = {} if mark == "{" else []
            elif string is not None:
                value = json.loads(string)
            elif number is not None:
                value = float(number) if re.search("[.eE]", number) else (int(number) if len(number) < 4000 else number)
            elif word is not None:
                value = _WORDS[word]
            else:
                raise ValueError("no value")
            if isinstance(here, dict):
                here[keys[-1]] = value
            else:
                here.append(value)
            if mark:
                stack.append(value)
                keys.append(None)
                want = "first key" if mark == "{" else "first"
            else:
                want = "comma"


_loads = json.JSONDecoder(parse_constant=_not_json).decode
_canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def parse(text: str) -> object:
    """The value of a JSON text; ValueError if it isn't well-formed."""
    try:
        return _loads(text)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):  # too deep, a number of thousands of digits, or NaN
        return _parse_deep(text)


def _own(fields: dict) -> str:
    try:
        return _canonical(fields)
    except RecursionError:  # unknown keys nested beyond the encoder's depth: a flat rendering that is equal for equal values
        parts, todo = [], [fields]
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                parts.append(f"{{{len(v)}")
                for k in sorted(v, reverse=True):
                    todo += [v[k], k]
            elif isinstance(v, list):
                parts.append(f"[{len(v)}")
                todo += reversed(v)
            else:
                parts.append(_canonical(v))
        return _canonical({"flat": parts})


_GONE = object()
_RELATIONS = {kind: {key: listed for key, _, listed in of} for kind, of in CHILDREN.items()}


def _left(key: str, value: object, kind: str) -> object:
    """What of a field stays with its object: all of it, but for the children it holds. Of a list with children the other entries stay, by
    position, with its length; a field that is nothing but children is gone."""
    listed = _RELATIONS[kind].get(key)
    if listed is None:
        return value
    if isinstance(value, dict):
        return _GONE if not listed else {"one": True}
    if listed and isinstance(value, list):
        others = {str(i): x for i, x in enumerate(value) if not isinstance(x, dict)}
        return _GONE if value and not others else {"length": len(value), "others": others}
    if not listed and isinstance(value, str):
        try:
            if isinstance(parse(value), dict):
                return {"text": True}
        except ValueError:
            pass
    return value


def objects_of(record: str) -> list[tuple]:
    """All objects of one record, parents first: kind, path, parent's path, relation, ordinal, identity, parent's identity, own fields."""
    try:
        top = parse(record)
    except ValueError:
        return []
    if not isinstance(top, dict):
        return []
    found: list[list] = [["mail", "$", "", "", 0, top, -1]]
    for i, (kind, path, _, _, _, obj, _) in enumerate(found):  # grows while it runs
        for key, child, listed in CHILDREN[kind]:
            value = obj.get(key)
            if not listed:
                if isinstance(value, str):
                    try:
                        value = parse(value)
                    except ValueError:
                        continue
                if isinstance(value, dict):
                    found.append([child, f"{path}.{key}", path, key, 0, value, i])
            elif isinstance(value, dict):
                found.append([child, f"{path}.{key}[0]", path, key, 0, value, i])
            elif isinstance(value, list):
                found += [[child, f"{path}.{key}[{n}]", path, key, n, x, i] for n, x in enumerate(value) if isinstance(x, dict)]
    below: list[list[str]] = [[] for _ in found]
    done: list = [None] * len(found)
    for i in range(len(found) - 1, -1, -1):
        kind, _, _, relation, ordinal, obj, parent = found[i]
        own = _own({k: v for k, v in ((k, _left(k, v, kind)) for k, v in obj.items()) if v is not _GONE})
        identity = hashlib.blake2b("\x1f".join([kind, own, *sorted(below[i])]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        done[i] = (identity, own)
        if parent >= 0:
            below[parent].append(f"{relation}\x1e{ordinal}\x1e{identity}")
    return [(kind, path, up, relation, ordinal, done[i][0], done[parent][0] if parent >= 0 else None, done[i][1]) for i, (kind, path, up, relation, ordinal, _, parent) in enumerate(found)]


def occurrences(latest: DataFrame, content: bool = True) -> DataFrame:
    """One row for each object of each record of latest_records: kind, path, parent's path, relation, ordinal, identity, parent's
    identity and, if content is asked for, the object's own fields as canonical JSON (null otherwise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for mail, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in objects_of(record):
                    cols[0].append(mail)
                    for c, v in zip(cols[1:], row, strict=True):
                        c.append(v)
                if len(cols[0]) >= _FLUSH:
                    yield _batch(cols, content)
                    cols = [[] for _ in range(9)]
            yield _batch(cols, content)

    return latest.select("mail_id", "record_json").mapInArrow(run, _SCHEMA)


def _batch(cols: list[list], content: bool) -> pa.RecordBatch:
    if not content:
        cols[8] = [None] * len(cols[0])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def bridge(occurrence: DataFrame) -> DataFrame:
    """Every place an object occurs: its parent there, the relation and the position."""
    return occurrence.select("mail_id", "node_path", "parent_path", "relation", "ordinal", "object_id", "parent_object_id", "node_kind")


def stored_objects(occurrence: DataFrame) -> DataFrame:
    """Each distinct object once: object_id, node_kind, content, and how often it occurs. Equal objects fold before the shuffle."""
    return occurrence.groupBy("object_id", "node_kind").agg(F.min("content").alias("content"), F.count("*").alias("occurrences"))


def flat_table(occurrence: DataFrame, kind: str, fields: tuple[str, ...]) -> DataFrame:
    """The objects of one kind with the named fields (with dots: fields of objects in them) as text columns, the link to the parent, the identity, and all own fields as
    canonical JSON, in which unknown keys are."""
    return occurrence.where(F.col("node_kind") == kind).select("mail_id", "node_path", "parent_path", "ordinal", *(F.get_json_object("content", f"$.{f}").alias(f.replace(".", "_")) for f in fields), "object_id", "content")


def unfolded(bridge_rows: DataFrame, objects: DataFrame) -> DataFrame:
    """The occurrences again, of the bridge and the objects stored once: mail_id, paths, relation, ordinal, ids, and kind and content of
    the object. Objects have one row each; an object in a third of all places makes a skewed partition, which the adaptive planner
    splits (spark.sql.adaptive.skewJoin)."""
    return bridge_rows.drop("node_kind").join(objects.select("object_id", "node_kind", "content"), "object_id")


def rebuilt(rows: list[tuple[str, str, str, int, str | None]]) -> object:
    """The record of one mail, of its rows (path, parent's path, relation, ordinal, content): the value that was parsed, text in
    ``embedded`` being text again (with its own form lost, as only its value is kept)."""
    values: dict[str, dict] = {}
    below: dict[str, dict[str, dict[int, str]]] = {}
    for path, parent, relation, ordinal, content in rows:
        values[path] = json.loads(content)
        if relation:
            below.setdefault(parent, {}).setdefault(relation, {})[ordinal] = path
    for path in sorted(values, key=lambda p: -p.count(".")):
        own = values[path]
        for relation, children in below.get(path, {}).items():
            left = own.get(relation)
            if relation == "embedded":
                own[relation] = _canonical(values[children[0]]) if left == {"text": True} else values[children[0]]
            elif left == {"one": True}:
                own[relation] = values[children[0]]
            else:
                length = left["length"] if left else len(children)
                own[relation] = [values[children[i]] if i in children else left["others"][str(i)] for i in range(length)]
        for relation in ("recipients", "attachments", "properties"):  # lists without any child
            left = own.get(relation)
            if isinstance(left, dict) and left.keys() == {"length", "others"}:
                own[relation] = [left["others"][str(i)] for i in range(left["length"])]
    return values["$"]
