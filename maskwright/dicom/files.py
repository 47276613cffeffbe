"""Files of medical images as attribute tables: little endian in, with explicit or implicit representations and deflated or
not; explicit little endian out. Big-endian files are skipped.

An implicit file doesn't say what its attributes are. Those that ``profile.TAGS`` names have the representation given there;
others are kept as bytes in the technical groups (TECHNICAL), and dropped elsewhere, as no rule could tell a name among them.

``read`` parses on the executors from Spark's binary source; a file that can't be read is reported, not fatal.
``write`` puts files into any file system that pyarrow knows by the scheme of the target (hdfs, s3, gs, or a folder that
all executors share).
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.dicom import profile
from maskwright.dicom.actions import BINARY, SCHEMA, SINGLE

# Fixed values of the encoding.
LONG = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "UC", "UR", "UT", "UN", "SV", "UV")
EXPLICIT_LITTLE = "1.2.840.10008.1.2.1"
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
META_LENGTH, META_SOP, SOP, SYNTAX = "00020000", "00020003", "00080018", "00020010"
NUL_PADDED = ("UI", "OB", "UN")
IMPLICIT_LITTLE, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
TECHNICAL = ("0018", "0020", "0028", "7FE0")
_VR = dict(profile.TAGS.values())


class Unreadable(ValueError):
    """Bytes that aren't such a file."""


def _header(data: bytes, at: int, implicit: bool = False) -> tuple[str, str, int, int]:
    """(tag, vr, length, offset of the value)."""
    if at + 8 > len(data):
        raise Unreadable("an element is cut off")
    group, element = struct.unpack_from("<HH", data, at)
    tag = f"{group:04X}{element:04X}"
    if group == 0xFFFE:
        return tag, "", struct.unpack_from("<I", data, at + 4)[0], at + 8
    if implicit:
        return tag, _VR.get(tag, "UN"), struct.unpack_from("<I", data, at + 4)[0], at + 8
    vr = data[at + 4 : at + 6].decode("latin-1")
    if not vr.isalpha() or not vr.isupper():
        raise Unreadable(f"no representation at {tag}: not explicit little endian")
    if vr in LONG:
        return tag, vr, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, vr, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _values(vr: str, raw: bytes) -> list[str]:
    text = raw.decode("utf-8", "replace").rstrip("\0 ")
    return [] if not raw else [text] if vr in SINGLE else [v.strip(" \0") for v in text.split("\\")]


def _elements(data: bytes, at: int, end: int, path: list, implicit: bool = False) -> Iterator[tuple]:
    while at < end:
        tag, vr, length, at = _header(data, at, implicit)
        if tag in ("FFFEE00D", "FFFEE0DD"):
            return
        if vr == "SQ" or vr == "UN" and length == UNDEFINED:
            yield path, tag, "SQ", [], None
            # what has no representation is written implicitly within, too
            at = yield from _items(data, at, length, [*path], tag, implicit or vr == "UN")
            continue
        if length == UNDEFINED:  # encapsulated pixels: kept as they are, with their delimiter
            stop = data.find(struct.pack("<HHI", 0xFFFE, 0xE0DD, 0), at)
            if stop < 0:
                raise Unreadable(f"{tag} has no end")
            yield path, tag, vr, ["encapsulated"], data[at:stop]
            at = stop + 8
            continue
        if at + length > len(data):
            raise Unreadable(f"{tag} is cut off")
        raw = data[at : at + length]
        if implicit and tag not in _VR and not tag.startswith(TECHNICAL):
            at += length
            continue
        yield (path, tag, vr, [], raw) if vr in BINARY else (path, tag, vr, _values(vr, raw), None)
        at += length


def _items(data: bytes, at: int, length: int, path: list, tag: str, implicit: bool = False):
    end, number = len(data) if length == UNDEFINED else at + length, 0
    while at < end:
        kind, _, size, at = _header(data, at)
        if kind == "FFFEE0DD":
            return at
        if kind != "FFFEE000":
            raise Unreadable(f"{tag} holds something else than items")
        own = [*path, {"tag": tag, "item": number}]
        number += 1
        if size == UNDEFINED:
            stop = _end_of_item(data, at, implicit)
            yield from _elements(data, at, stop, own, implicit)
            at = stop + 8
        else:
            yield from _elements(data, at, at + size, own, implicit)
            at += size
    return at


def _end_of_item(data: bytes, at: int, implicit: bool = False) -> int:
    """Offset of the delimiter that ends an item of undefined length."""
    while at < len(data):
        tag, vr, length, value = _header(data, at, implicit)
        if tag == "FFFEE00D":
            return at
        if length == UNDEFINED:
            at = _end_of_sequence(data, value, implicit or vr == "UN")
        else:
            at = value + length
    raise Unreadable("an item has no end")


def _end_of_sequence(data: bytes, at: int, implicit: bool = False) -> int:
    while at < len(data):
        tag, _, length, value = _header(data, at)
        if tag == "FFFEE0DD":
            return value
        at = _end_of_item(data, value, implicit) + 8 if length == UNDEFINED else value + length
    raise Unreadable("a sequence has no end")


def parse(data: bytes) -> list[tuple]:
    """(path, tag, vr, values, raw) of each attribute, file meta group included, which names the encoding that is written."""
    if data[128:132] != b"DICM":
        raise Unreadable("no DICM mark")
    at = 132
    while data[at : at + 2] == b"\x02\x00":
        _, _, length, at = _header(data, at)
        at += length
    meta = list(_elements(data, 132, min(at, len(data)), []))
    syntax = next((v[0] for _, t, _, v, _ in meta if t == SYNTAX and v), EXPLICIT_LITTLE)
    if syntax == BIG:
        raise Unreadable("the transfer syntax is big endian")
    body = data[at:]
    if syntax == DEFLATED:
        try:
            body = zlib.decompress(body, -15)
        except zlib.error as e:
            raise Unreadable("the deflated part can't be read") from e
    if syntax in (DEFLATED, IMPLICIT_LITTLE):
        meta = [(p, t, vr, [EXPLICIT_LITTLE] if t == SYNTAX else v, raw) for p, t, vr, v, raw in meta]
    return [*meta, *_elements(body, 0, len(body), [], syntax == IMPLICIT_LITTLE)]


def _encoded(tag: str, vr: str, body: bytes, undefined: bool = False) -> bytes:
    if len(body) % 2 and not undefined:
        body += b"\0" if vr in NUL_PADDED else b" "
    start = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    if vr in LONG:
        return start + b"\0\0" + struct.pack("<I", UNDEFINED if undefined else len(body)) + body
    return start + struct.pack("<H", len(body)) + body


def _tree(rows: list[dict], depth: int, prefix: tuple) -> bytes:
    out = b""
    here = [r for r in rows if len(r["path"]) == depth and r["path"] == prefix]
    for r in sorted(here, key=lambda r: r["tag"]):
        if r["vr"] == "SQ":
            below = [x for x in rows if len(x["path"]) > depth and x["path"][:depth] == prefix and x["path"][depth][0] == r["tag"]]
            body = b""
            for item in sorted({x["path"][depth][1] for x in below}):
                inner = _tree([x for x in below if x["path"][depth][1] == item], depth + 1, (*prefix, (r["tag"], item)))
                body += struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner
            out += _encoded(r["tag"], "SQ", body)
        elif r["raw"] is not None:
            pixels = r["values"] == ["encapsulated"]
            out += _encoded(r["tag"], r["vr"], bytes(r["raw"]), pixels) + (struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) if pixels else b"")
        else:
            out += _encoded(r["tag"], r["vr"], "\\".join(r["values"]).encode())
    return out


def build(rows: list[dict]) -> bytes:
    """A file from rows (path as tuples, tag, vr, values, raw). The meta group's UID and length follow the rows."""
    top = {r["tag"]: r for r in rows if not r["path"]}
    rows = [dict(r, values=top[SOP]["values"]) if r["tag"] == META_SOP and not r["path"] and SOP in top else r for r in rows if r["tag"] != META_LENGTH]
    meta = _tree([r for r in rows if r["tag"].startswith("0002")], 0, ())
    body = _tree([r for r in rows if not r["tag"].startswith("0002")], 0, ())
    return b"\0" * 128 + b"DICM" + _encoded(META_LENGTH, "UL", struct.pack("<I", len(meta))) + meta + body


def read(spark: SparkSession, path: str) -> DataFrame:
    """The attribute table of all files below path, and rows of vr ``!`` with the reason for files that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["instance", "seq_path", "tag", "vr", "values", "raw"]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(name, *r) for r in parse(bytes(content))]
                except (Unreadable, struct.error) as e:
                    rows = [(name, [], "", "!", [str(e)], None)]
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, SCHEMA)


def readable(attributes: DataFrame) -> DataFrame:
    return attributes.filter("vr <> '!'")


def skipped(attributes: DataFrame) -> DataFrame:
    """(instance, reason) of files that can't be read."""
    return attributes.filter("vr = '!'").select("instance", F.get("values", F.lit(0)).alias("reason"))


def _plain(path: str) -> str:
    """A path without scheme and host, with one slash before it."""
    if "://" in path:
        path = path.split("://", 1)[1].partition("/")[2]
    elif path.startswith("file:"):
        path = path[5:]
    else:
        path = os.path.abspath(path)
    return "/" + path.strip("/")


def write(attributes: DataFrame, source: str, target: str) -> DataFrame:
    """Write each instance below target, at its place below source. Returns (instance, written); lazy until it is used.

    A file is written beside its place and then moved there, so that a task that is repeated leaves whole files."""
    root = _plain(source)
    uri = target if "://" in target or target.startswith("file:") else os.path.abspath(target)
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[5:]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name = frame["instance"].iloc[0]
        place = _plain(name)
        relative = os.path.relpath(place, root) if place.startswith(root.rstrip("/") + "/") else os.path.basename(place)
        system, base = fs.FileSystem.from_uri(uri)
        full = f"{base.rstrip('/')}/{relative}"
        system.create_dir(os.path.dirname(full), recursive=True)
        paths = [tuple((s["tag"], s["item"]) for s in p) for p in frame["seq_path"]]
        rows = [{"path": p, "tag": t, "vr": v, "values": list(x), "raw": r} for p, t, v, x, r in zip(paths, frame["tag"], frame["vr"], frame["values"], frame["raw"])]
        part = f"{full}.{uuid.uuid4().hex[:8]}.part"
        with system.open_output_stream(part) as f:
            f.write(build(rows))
        system.move(part, full)
        return pd.DataFrame({"instance": [name], "written": [full]})

    return attributes.groupBy("instance").applyInPandas(run, "instance string, written string")
