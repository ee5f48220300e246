"""TIFF and OME-TIFF, from their public specifications.

Read: classic and BigTIFF, both byte orders, strips and tiles, one sample per
pixel, 8 to 64 bit integers and floats; no compression, LZW, Deflate, PackBits
or Zstandard; horizontal differencing.  Anything else is refused by name.
Written: one sample, a strip or tiles a page, Deflate or Zstandard; BigTIFF when needed.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions.pixels import falsy_or, name_of, rgb, unit_of
from lumenframe.operators.dense import dense
from lumenframe.session import BATCH_BYTES, BATCH_ROWS
from lumenframe.sources import files, pattern

#: Fixed numbers of the format: field types (size, struct code) and tags.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, SOFTWARE, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 305, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
KINDS = {1: "u", 2: "i", 3: "f"}


class Unsupported(ValueError):
    """A kind of TIFF that this reader does not know."""


def lzw(data: bytes) -> bytes:
    """LZW as TIFF packs it: most significant bit first, codes of 9 to 12 bits."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    plain = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(plain), 9, None
        elif code == 257:
            break
        else:
            if not table:
                table = list(plain)
            if last is None:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(last + entry[:1])
            elif code == len(table):
                entry = last + last[:1]
                table.append(entry)
            else:
                raise ValueError("a wrong LZW code")
            out += entry
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpacked(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return lzw(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == PACKBITS:
        return packbits(data)
    if how == ZSTD:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise Unsupported(f"TIFF compression {how}")


@dataclass
class Tiff:
    """The pages of a file, decoded when asked for."""

    data: bytes
    order: str = "<"
    pages: list[dict[int, tuple]] = field(default_factory=list)

    def __post_init__(self):
        if self.data[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF")
        self.order = "<" if self.data[:2] == b"II" else ">"
        magic = self._get("H", 2)
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        at, seen = self._get("Q", 8) if self.big else self._get("I", 4), set()
        while at and at not in seen:
            seen.add(at)
            at = self._page(at)

    def _get(self, code: str, at: int):
        return struct.unpack_from(self.order + code, self.data, at)[0]

    def _page(self, at: int) -> int:
        n, step, size, word = (self._get("Q", at), 20, 8, "Q") if self.big else (self._get("H", at), 12, 4, "I")
        at += 8 if self.big else 2
        tags: dict[int, tuple] = {}
        for i in range(n):
            entry = at + i * step
            tag, kind = struct.unpack_from(self.order + "HH", self.data, entry)
            count = self._get(word, entry + 4)
            if kind not in TYPES:
                continue
            width, code = TYPES[kind]
            value = entry + 4 + size
            if width * count > size:
                value = self._get(word, value)
            if code == "s":
                tags[tag] = (self.data[value : value + count].rstrip(b"\0").decode("utf-8", "replace"),)
            else:
                tags[tag] = struct.unpack_from(f"{self.order}{count * len(code)}{code[0]}", self.data, value)
        self.pages.append(tags)
        return self._get(word, at + n * step)

    def description(self) -> str:
        return self.pages[0].get(DESCRIPTION, ("",))[0] if self.pages else ""

    def dtype(self, page: int) -> np.dtype:
        tags = self.pages[page]
        bits, kind = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
        if bits not in (8, 16, 32, 64) or kind not in KINDS or (kind == 3 and bits < 16):
            raise Unsupported(f"TIFF samples of {bits} bits, format {kind}")
        return np.dtype(f"{self.order}{KINDS[kind]}{bits // 8}")

    def shape(self, page: int) -> tuple[int, int]:
        return self.pages[page][LENGTH][0], self.pages[page][WIDTH][0]

    def plane(self, page: int) -> np.ndarray:
        tags = self.pages[page]
        if tags.get(SAMPLES, (1,))[0] != 1:
            raise Unsupported(f"TIFF with {tags[SAMPLES][0]} samples a pixel")
        dtype, (height, width) = self.dtype(page), self.shape(page)
        tiled = TILES in tags
        cell_y, cell_x = (tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, (height,))[0], height), width)
        places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags.get(STRIP_BYTES, (height * width * dtype.itemsize,)))
        how, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        if predictor not in (1, 2):
            raise Unsupported(f"TIFF predictor {predictor}")
        out, across = np.zeros((height, width), dtype=dtype.newbyteorder("=")), -(-width // cell_x)
        for i, (at, n) in enumerate(zip(places, sizes, strict=True)):
            y, x = i // across * cell_y, i % across * cell_x
            rows = cell_y if tiled else min(cell_y, height - y)
            raw = unpacked(self.data[at : at + n], how)
            need = rows * cell_x * dtype.itemsize
            if len(raw) < need:
                raise ValueError("a TIFF strip or tile is too short")
            cell = np.frombuffer(raw, dtype, rows * cell_x).reshape(rows, cell_x).astype(out.dtype)
            if predictor == 2:
                cell = np.cumsum(cell, axis=1, dtype=cell.dtype)
            out[y : y + rows, x : x + cell_x] = cell[: height - y, : width - x]
        return out


@dataclass
class Layout:
    """Where pages belong, and what the header says."""

    size: dict[str, int]
    places: list[tuple[int, int, int]]
    channels: list[str]
    spacing: dict[str, float]
    unit: dict[str, str]
    name: str | None = None


def layout(tiff: Tiff) -> Layout:
    """From OME-XML or a hyperstack description if there is one; else pages are depths."""
    text, n = tiff.description(), len(tiff.pages)
    height, width = tiff.shape(0)
    size = {"X": width, "Y": height, "Z": n, "C": 1, "T": 1}
    order, names, spacing, unit, name = "XYZCT", [], {}, {}, None
    pixels = None
    if "<OME" in text[:4000]:
        root = ET.fromstring(text.encode())
        image = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "Image"), None)
        pixels = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "Pixels"), None)
        name = image.get("Name") if image is not None else None
    if pixels is not None:
        size |= {a: int(pixels.get(f"Size{a}", size[a])) for a in "ZCT"}
        order = pixels.get("DimensionOrder", order)
        spacing = {a: float(v) for a in "XYZ" if (v := pixels.get(f"PhysicalSize{a}"))}
        unit = {a: v for a in "XYZ" if (v := pixels.get(f"PhysicalSize{a}Unit"))}
        names = [e.get("Name") or "" for e in pixels if e.tag.rpartition("}")[2] == "Channel"]
    elif text.startswith("ImageJ="):
        said = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
        size |= {"C": int(said.get("channels", 1)), "Z": int(said.get("slices", 1)), "T": int(said.get("frames", 1))}
        order = "XYCZT"
        if size["C"] * size["Z"] * size["T"] != n:
            size |= {"C": 1, "Z": n, "T": 1}
    if size["Z"] * size["C"] * size["T"] < n or not sorted(order) == sorted("XYZCT") or order[:2] != "XY":
        raise Unsupported(f"TIFF pages in order {order} of sizes {size} for {n} pages")
    places = []
    for k in range(n):
        at, rest = {}, k
        for a in order[2:]:
            at[a], rest = rest % size[a], rest // size[a]
        places.append((at["T"], at["C"], at["Z"]))
    if pixels is not None:
        data = [e for e in pixels if e.tag.rpartition("}")[2] == "TiffData" and e.get("IFD") is not None]
        for e in data if len(data) > 1 else ():
            first, count = int(e.get("IFD")), int(e.get("PlaneCount", 1))
            start = {a: int(e.get(f"First{a}", 0)) for a in "TCZ"}
            index, scale = 0, 1
            for a in order[2:]:
                index, scale = index + start[a] * scale, scale * size[a]
            for k in range(count):
                at, rest = {}, index + k
                for a in order[2:]:
                    at[a], rest = rest % size[a], rest // size[a]
                if first + k < n:
                    places[first + k] = (at["T"], at["C"], at["Z"])
    return Layout(size, places, names if len(names) == size["C"] else [f"C{i}" for i in range(size["C"])], spacing, unit, name)


def u16(plane: np.ndarray, clamped: bool) -> np.ndarray:
    """Pixels as int32, clamped to 16 bits and cut off, NaN as 0; unclamped values must fit."""
    if plane.dtype.kind == "f":
        plane = np.nan_to_num(plane, nan=0.0, posinf=65535 if clamped else np.inf, neginf=0 if clamped else -np.inf)
    if clamped:
        plane = np.clip(plane, 0, schema.MOST_PIXEL)
    return plane.astype(np.int32)


_READ = "path string, t int, c short, z int, pixels array<int>, size_t int, size_c short, size_z int, size_y int, size_x int, dtype string, channels array<string>, spacing array<double>, units array<string>, title string"


#: What a matched file of a stack carries along.
_PLACED = "folder string, file_t int, file_c int, file_z int"
_KINDS = {"string": pa.string(), "int": pa.int32(), "short": pa.int16(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def _pages(path: str, data: bytes, clamped: bool, pixels: bool) -> Iterator[list]:
    """A row of ``_READ`` for each page of a file, or without ``pixels`` for its header."""
    tiff = Tiff(data)
    if not tiff.pages:
        raise ValueError(f"{path} has no pages")
    where = layout(tiff)
    if any(tiff.shape(k) != (where.size["Y"], where.size["X"]) for k in range(len(tiff.pages))):
        raise Unsupported(f"{path} has pages of several sizes")
    for k, (t, c, z) in enumerate(where.places if pixels else where.places[:1]):
        plane = u16(tiff.plane(k), clamped).ravel() if pixels else None
        yield [path, t, c, z, plane, *(where.size[a] for a in "TCZYX"), tiff.dtype(k).newbyteorder("=").name, where.channels, [where.spacing.get(a) for a in "XYZ"], [where.unit.get(a) for a in "XYZ"], where.name]


def _decode(batches: Iterator[pa.RecordBatch], clamped: bool, pixels: bool, root: tuple[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """Pages of files: of (path, content) or, with ``root``, of paths below it; further columns are carried along.

    Small pages share a batch, within the bounds of all batches.
    """
    load, rows, held = files.loader(root) if root else None, [], 0

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        fields = [f.split() for f in (_READ if len(rows[0]) == 15 else f"{_READ}, {_PLACED}").split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(values, _KINDS[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])

    for batch in batches:
        paths, rest = batch.column(0).to_pylist(), list(zip(*(c.to_pylist() for c in batch.columns[1 if root else 2 :]), strict=True))
        for i, path in enumerate(paths):
            for row in _pages(path, load(path) if root else batch.column(1)[i].as_py(), clamped, pixels):
                size = row[4].nbytes if pixels else 0
                if rows and (len(rows) == BATCH_ROWS or held + size > BATCH_BYTES):
                    yield batch_of(rows)
                    rows, held = [], 0
                rows.append([*row, *(rest[i] if rest else ())])
                held += size
    if rows:
        yield batch_of(rows)


def read_planes(spark: SparkSession, paths: str | list[str], glob: str | None = None, clamp_to_uint16: bool = True, recursive: bool = False, pixels: bool = True) -> DataFrame:
    """A row for each page of TIFF files: its place, pixels, and the sizes and names that the file gives.

    A task decodes a file at a time and passes on a batch of pages.  Without
    ``pixels`` there is a row for each file, and no pixel is decoded.
    """
    files.prepare(spark)
    content = files.listing(spark, paths, glob, recursive).select("path", "content")
    return content.mapInArrow(lambda batches: _decode(batches, clamp_to_uint16, pixels), _READ)


_LISTED = "array<struct<t:int,c:smallint,z:int,pixels:array<int>>>"


def records(planes: DataFrame, by: str = "path", image_id=None, name=None, channel_names: list[str] | None = None, pixels: bool = True) -> DataFrame:
    """Records of read planes, one per ``by``: one shuffle.  Id and name default to the file's stem and name.

    Without ``pixels`` the rows are headers already, and the records have no planes.
    """
    listed = planes.withColumn("listed", F.array().cast(_LISTED)) if not pixels else planes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("t", "c", "z", "pixels"))).alias("listed"), *(F.first(c, ignorenulls=True).alias(c) for c in ("size_t", "size_c", "size_z", "size_y", "size_x", "dtype", "channels", "spacing", "units", "title")))
    names = F.array(*map(F.lit, channel_names)) if channel_names else F.col("channels")
    usable = F.when(F.size(names) == F.col("size_c"), names).otherwise(F.col("channels"))
    record = schema.image(
        image_id=image_id if image_id is not None else files.stem(F.col(by)),
        name=name if name is not None else files.file_name(F.col(by)),
        dtype=F.col("dtype"),
        size_x=F.col("size_x"),
        size_y=F.col("size_y"),
        size_z=F.col("size_z"),
        size_c=F.col("size_c"),
        size_t=F.col("size_t"),
        **{f"physical_size_{a}": falsy_or(F.get("spacing", F.lit(i)), 1.0) for i, a in enumerate("xyz")},
        physical_size_unit=F.get("units", F.lit(0)),
        channels=schema.synthetic_channels(F.col("size_c"), usable),
        planes=F.transform("listed", lambda p: F.struct(p["z"].alias("z"), p["t"].alias("t"), p["c"].alias("c"), p["pixels"].alias("pixels"))),
    )
    return listed.select(F.col(by), record.alias("image"))


def read_tiff(spark: SparkSession, paths: str | list[str], glob: str | None = None, channel_names: list[str] | None = None, clamp_to_uint16: bool = True, recursive: bool = False) -> DataFrame:
    """(path, image) of TIFF files; the dtype label is the file's own.  ``api.info`` of the result decodes no pixels."""

    def made(pixels: bool) -> DataFrame:
        return records(read_planes(spark, paths, glob, clamp_to_uint16, recursive, pixels), channel_names=channel_names, pixels=pixels)

    return files.with_headers(made(True), lambda: made(False))


def ome_xml(row: dict, dtype: np.dtype, order: str) -> str:
    """The description of a written file."""
    kind = {"f4": "float", "f8": "double"}.get(dtype.str[1:], dtype.name)
    size = " ".join(f'Size{a}="{row[f"size_{a.lower()}"]}"' for a in "XYZCT")
    spacing = " ".join(f'PhysicalSize{a}="{row["spacing"][i]!r}" PhysicalSize{a}Unit={quoteattr(row["units"][i])}' for i, a in enumerate("XYZ"))
    colors = row["colors"] or [None] * len(row["channels"])
    signed = lambda rgb: ((rgb << 8 | 0xFF) ^ 0x80000000) - 0x80000000
    channels = "".join(f'<Channel ID="Channel:0:{i}" Name={quoteattr(n)} SamplesPerPixel="1"' + (f' Color="{signed(rgb)}"' if rgb is not None else "") + "/>" for i, (n, rgb) in enumerate(zip(row["channels"], colors, strict=True)))
    return f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0" Name={quoteattr(row["title"])}><Pixels ID="Pixels:0" DimensionOrder="{order}" Type="{kind}" {size} {spacing}>{channels}<TiffData/></Pixels></Image></OME>'


def encode(planes: list[np.ndarray], description: str, compression: str | None = "zlib", level: int = 6, tile: tuple[int, int] | None = None, big: bool | None = None) -> bytes:
    """A little-endian TIFF of equal-sized planes; ``tile`` is (y, x), each a multiple of 16."""
    if compression not in (None, "zlib", "zstd"):
        raise Unsupported(f"writing TIFF with compression {compression}")
    if tile and (tile[0] % 16 or tile[1] % 16 or min(tile) < 16):
        raise ValueError("TIFF tiles are multiples of 16")
    planes = [np.ascontiguousarray(p, dtype=p.dtype.newbyteorder("<")) for p in planes]
    height, width = planes[0].shape
    how = {None: NONE, "zlib": DEFLATE, "zstd": ZSTD}[compression]
    pack = {None: lambda b: b, "zlib": lambda b: zlib.compress(b, level), "zstd": lambda b: zstandard.ZstdCompressor(level=level).compress(b)}[compression]
    cells = []
    for plane in planes:
        if tile:
            padded = np.zeros((-(-height // tile[0]) * tile[0], -(-width // tile[1]) * tile[1]), dtype=plane.dtype)
            padded[:height, :width] = plane
            cells.append([pack(padded[y : y + tile[0], x : x + tile[1]].tobytes()) for y in range(0, padded.shape[0], tile[0]) for x in range(0, padded.shape[1], tile[1])])
        else:
            cells.append([pack(plane.tobytes())])
    if big is None:
        big = sum(len(c) for own in cells for c in own) + 1024 * len(planes) + 16 * sum(map(len, cells)) > 0xFFFF0000
    word, head, entry = ("Q", 16, 20) if big else ("I", 8, 12)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    link = head - struct.calcsize(word)
    kind = {"u": 1, "i": 2, "f": 3}[planes[0].dtype.kind]
    for k, own in enumerate(cells):
        places = []
        for cell in own:
            places.append(len(out))
            out += cell
        tags: dict[int, tuple[int, list | bytes]] = {WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [planes[0].dtype.itemsize * 8]), COMPRESSION: (3, [how]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), FORMAT: (3, [kind])}
        if k == 0 and description:
            tags[DESCRIPTION] = (2, description.encode() + b"\0")
        at = (16 if big else 4, places)
        sizes = (16 if big else 4, [len(c) for c in own])
        tags |= {TILE_WIDTH: (3, [tile[1]]), TILE_LENGTH: (3, [tile[0]]), TILES: at, TILE_BYTES: sizes} if tile else {ROWS: (4, [height]), STRIPS: at, STRIP_BYTES: sizes}
        body, ends = [], {}
        for tag, (code, values) in sorted(tags.items()):
            raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[code][1]}", *values)
            room = struct.calcsize(word)
            if len(raw) > room:
                out += b"\0" * (len(out) % 2)
                ends[tag] = struct.pack("<" + word, len(out))
                out += raw
            else:
                ends[tag] = raw.ljust(room, b"\0")
            body.append(struct.pack("<HH" + word, tag, code, len(raw) // TYPES[code][0]) + ends[tag])
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<" + word, out, link, len(out))
        out += struct.pack("<Q" if big else "<H", len(body)) + b"".join(body)
        link = len(out)
        out += struct.pack("<" + word, 0)
    return bytes(out)


def write_tiff(df: DataFrame, out: str, column: str = "image", file_name=None, dtype: str = "uint16", clamp: bool = False, dim_order: str = "TCZYX", compression: str | None = "zlib", compression_level: int = 6, tile: tuple[int, int] | None = None, use_channel_colors: bool = False) -> int:
    """An OME-TIFF for each record, ``{id}.ome.tiff`` under ``out`` unless named; returns the number of files.

    Records are made dense by the plan; tasks only encode.  ``dim_order`` ends
    in YX and says in which order pages follow, slowest axis first.
    """
    axes = dim_order.upper()
    if sorted(axes) != sorted("TCZYX") or not axes.endswith("YX"):
        raise ValueError(f"pages cannot follow in order {dim_order}")
    row = export_rows(files.spread(df), column, dtype, clamp, file_name if file_name is not None else F.concat(F.col(f"{column}.id"), F.lit(".ome.tiff")), use_channel_colors)
    order = "XY" + axes[:3][::-1]
    kind = np.dtype(dtype)

    def one(r: dict) -> Iterator[tuple[str, bytes]]:
        at = {(p["t"], p["c"], p["z"]): p["pixels"] for p in r["planes"]}
        size = {a: r[f"size_{a.lower()}"] for a in "TCZ"}
        planes = []
        for i in range(size[axes[0]]):
            for j in range(size[axes[1]]):
                for k in range(size[axes[2]]):
                    place = dict(zip(axes, (i, j, k), strict=False))
                    planes.append(np.array(at[place["T"], place["C"], place["Z"]]).astype(kind).reshape(r["size_y"], r["size_x"]))
        yield files.safe_name(r["file"]), encode(planes, ome_xml(r, kind, order), compression, compression_level, tile)

    return files.written(row, one, out)


def export_rows(df: DataFrame, column: str, dtype: str, clamp: bool, file, use_channel_colors: bool = False) -> DataFrame:
    """What an encoder needs of each record: file, title, dense planes, sizes, spacing, units, channel names and colours."""
    meta = F.col(f"{column}.pixels_meta")
    whole = F.size(meta["channels"]) == meta["size_c"]
    plain = F.transform(F.sequence(F.lit(0), meta["size_c"].cast("int") - 1), lambda i: F.concat(F.lit("C"), i.cast("string")))
    names = F.when(whole, F.transform(meta["channels"], lambda ch, i: F.coalesce(ch["name"], F.concat(F.lit("C"), i.cast("string"))))).otherwise(plain)
    colors = F.when(whole, F.transform(meta["channels"], lambda ch: rgb(ch["color_rgba"]))) if use_channel_colors else F.lit(None).cast("array<bigint>")
    return df.select(
        file.alias("file"),
        name_of(F.col(f"{column}.name"), F.col(f"{column}.id"), "image").alias("title"),
        dense(F.col(column), dtype, clamped=clamp).alias("planes"),
        *(meta[f"size_{a}"].cast("int").alias(f"size_{a}") for a in "tczyx"),
        F.array(*(falsy_or(meta[f"physical_size_{a}"].cast("double"), 1.0) for a in "xyz")).alias("spacing"),
        F.array(*(unit_of(meta[f"physical_size_{a}_unit"]) for a in "xyz")).alias("units"),
        names.alias("channels"),
        colors.alias("colors"),
    )


def _gathered(planes: DataFrame, by: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """The planes of placed files, listed in a row for each stack with its sizes; without ``pixels`` from a header a file.  One shuffle."""
    single = (F.col("size_t") == 1) & (F.col("size_c") == 1)
    planes = planes.withColumn("z", F.when(single, F.col("file_z") + F.col("z")).otherwise(F.raise_error(F.concat(F.lit("several times or channels in "), F.col("path"))).cast("int")))
    bounds = [f(a).alias(f"{f.__name__}_{a}") for a in ("size_y", "size_x") for f in (F.min, F.max)]
    firsts = [F.first(c).alias(c) for c in ("dtype", "spacing", "units")]
    sizes = [(F.max(f"file_{a}") + 1).cast("int").alias(f"size_{a}") for a in "tcz"]
    if not pixels:
        return _even(planes.groupBy(*by).agg(F.max(F.col("z") + F.col("size_z") - 1).alias("last_z"), *bounds, *firsts, *sizes).withColumn("listed", F.array().cast(_LISTED)))
    planes = planes.select("file_t", "file_c", "z", "pixels", "size_y", "size_x", "dtype", "spacing", "units", "file_z", *by)
    if by:
        planes = planes.repartition(*by)
    # A file that starts at a depth comes before one that spills into it.
    best = planes.groupBy(*by, "file_t", "file_c", "z").agg(F.max_by(F.struct("pixels", "size_y", "size_x", "dtype", "spacing", "units"), "file_z").alias("p"), F.max("file_z").alias("file_z")).select(*by, "file_t", "file_c", "file_z", "z", "p.*")
    listed = best.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col("file_t").alias("t"), F.col("file_c").cast("short").alias("c"), "z", "pixels"))).alias("listed"),
        F.max("z").alias("last_z"),
        *bounds,
        *firsts,
        *sizes,
    )
    return _even(listed)


def _even(listed: DataFrame) -> DataFrame:
    """``listed``; an error where files of a stack differ in size."""
    even = (F.col("min_size_y") == F.col("max_size_y")) & (F.col("min_size_x") == F.col("max_size_x"))
    return listed.withColumn("last_z", F.when(even, F.col("last_z")).otherwise(F.raise_error(F.lit("the files have several sizes")).cast("int")))


def _stacked(listed: DataFrame, image_id: Column, name: Column, size_t: Column, size_c: Column, size_z: Column, names: Column, keep: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """Records of listed planes; zero planes fill what no file has."""
    record = schema.image(
        image_id=image_id,
        name=name,
        dtype=F.col("dtype"),
        size_x=F.col("min_size_x"),
        size_y=F.col("min_size_y"),
        size_z=F.greatest(size_z, F.col("last_z") + 1),
        size_c=size_c,
        size_t=size_t,
        **{f"physical_size_{a}": falsy_or(F.get("spacing", F.lit(i)), 1.0) for i, a in enumerate("xyz")},
        physical_size_unit=F.get("units", F.lit(0)),
        channels=schema.synthetic_channels(size_c, names),
        planes=F.transform("listed", lambda p: F.struct(p["z"].alias("z"), p["t"].alias("t"), p["c"].alias("c"), p["pixels"].alias("pixels"))),
    )
    out = listed.select(*keep, record.alias("image"))
    if not pixels:
        return out
    filled = F.transform(dense(F.col("image")), lambda p: F.struct(p["z"].alias("z"), p["t"].alias("t"), p["c"].cast("short").alias("c"), F.transform(p["pixels"], lambda v: v.cast("int")).alias("pixels")))
    return out.withColumn("image", F.col("image").withField("planes", filled))


def read_stack(spark: SparkSession, folder: str, name_pattern: str, default_axis: str = "C", series_as: str | None = "T", channel_names: list[str] | None = None, clamp_to_uint16: bool = True, image_id: str | None = None, name: str | None = None) -> DataFrame:
    """One record from the files of ``folder`` that a pattern names.

    A file with several depths fills from its own depth on; real planes come
    before zero planes, which fill what no file has.  All files must have one
    size.  Several times or channels in a file are refused.
    """
    parsed = pattern.parse(name_pattern)
    found = pattern.match(files.listing(spark, folder).select("path", "name"), name_pattern, default_axis, series_as)
    placed = found.select("path", F.col("t").alias("file_t"), F.col("c").alias("file_c"), F.col("z").alias("file_z"))
    size = pattern.sizes(found).first()
    if size["size_t"] is None:
        raise FileNotFoundError(f"no files match {folder}/{name_pattern}")
    names = channel_names or pattern.channel_names(parsed, default_axis, series_as) or [f"C{i}" for i in range(size["size_c"])]
    if channel_names and len(channel_names) != size["size_c"]:
        raise ValueError(f"{len(channel_names)} channel names for {size['size_c']} channels")
    names = (names + [f"C{i}" for i in range(len(names), size["size_c"])])[: size["size_c"]]
    # Only the matched files are opened.
    paths = [r["path"] for r in placed.select("path").distinct().toLocalIterator()]
    own_id, own_name = F.lit(image_id or re.sub(r"(?<=.)\.[^.]*$", "", name_pattern.strip())), F.lit(name or f"{folder.rstrip('/')}/{name_pattern.strip()}")

    def made(pixels: bool) -> DataFrame:
        planes = read_planes(spark, paths, clamp_to_uint16=clamp_to_uint16, pixels=pixels)
        return _stacked(_gathered(planes.join(placed, "path"), pixels=pixels), own_id, own_name, *(F.lit(size[f"size_{a}"]) for a in "tcz"), F.array(*map(F.lit, names)), pixels=pixels)

    return files.with_headers(made(True), lambda: made(False))


def read_stacks(spark: SparkSession, folder: str, name_pattern: str, default_axis: str = "C", series_as: str | None = "T", clamp_to_uint16: bool = True) -> DataFrame:
    """(folder, image): a record from each folder at or below ``folder`` whose files a pattern names, as ``read_stack`` reads one.

    Sizes are a stack's own; the id is the folder's name.  Stacks are listed and
    read together, by tasks: no job and no list on the driver for each.
    """
    parsed, root = pattern.parse(name_pattern), files.root_of(spark, folder)
    found = pattern.match(files.walked(spark, folder), name_pattern, default_axis, series_as, by=["folder"])
    # Only the matched files are opened.
    placed = found.select("path", "folder", F.col("t").alias("file_t"), F.col("c").alias("file_c"), F.col("z").alias("file_z"))
    if root is None:
        placed = files.listing(spark, folder, recursive=True).select("path", "content").join(placed, "path")
    known = F.array(*map(F.lit, pattern.channel_names(parsed, default_axis, series_as) or [])).cast("array<string>")
    names = F.transform(F.sequence(F.lit(0), F.col("size_c") - 1), lambda i: F.coalesce(F.get(known, i), F.concat(F.lit("C"), i.cast("string"))))
    own = files.file_name(F.col("folder"))

    def made(pixels: bool) -> DataFrame:
        planes = files.spread(placed).mapInArrow(lambda batches: _decode(batches, clamp_to_uint16, pixels, root), f"{_READ}, {_PLACED}")
        return _stacked(_gathered(planes, ("folder",), pixels), own, F.concat(F.col("folder"), F.lit(f"/{name_pattern.strip()}")), *(F.col(f"size_{a}") for a in "tcz"), names, ("folder",), pixels)

    return files.with_headers(made(True), lambda: made(False))
