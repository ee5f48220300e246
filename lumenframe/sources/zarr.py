"""OME-Zarr, versions 2 (NGFF 0.4) and 3 (NGFF 0.5), from the public specifications.

Read: regular chunks, C order, either byte order; codecs none, zlib, gzip, zstd,
lz4, Blosc (lz4, zlib, zstd inside; byte and bit shuffle) and, in version 3,
shards.  Written: a chunk per plane unless told otherwise; none, zlib or gzip,
zstd; shards in version 3; a pyramid of halved levels.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice, product
from math import ceil, prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions.pixels import falsy_or
from lumenframe.session import stored
from lumenframe.sources import files
from lumenframe.sources.tiff import export_rows, u16

AXES = "tczyx"
NO_CHUNK = 2**64 - 1
#: Chunk keys that a task names at a time.
KEYS = 1000
#: Headers of stores that a task passes on at a time.
HEADERS = 200


class Unsupported(ValueError):
    """A kind of store that this reader does not know."""


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc32c_table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def _lz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)


def _unshuffled(data: bytes, size: int, bits: bool) -> bytes:
    """Undo Blosc's byte or bit shuffle of items of ``size`` bytes."""
    n = len(data) // size
    whole = n // 8 * 8 if bits else n
    raw = np.frombuffer(data, np.uint8, whole * size)
    if bits:
        planes = np.unpackbits(raw.reshape(size * 8, whole // 8), axis=1, bitorder="little")
        items = np.packbits(planes.T.reshape(whole, size, 8), axis=2, bitorder="little").tobytes()
    else:
        items = np.ascontiguousarray(raw.reshape(size, whole).T).tobytes()
    return items + data[whole * size :]


def blosc(data: bytes) -> bytes:
    """A Blosc 1 frame."""
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + total]
    inner = flags >> 5
    unpack: dict[int, Callable[[bytes, int], bytes]] = {1: _lz4, 3: lambda d, n: zlib.decompress(d), 4: lambda d, n: zstandard.ZstdDecompressor().decompress(d, max_output_size=n)}
    if inner not in unpack:
        raise Unsupported(f"Blosc compressor {inner}")
    blocks, out = ceil(total / block), []
    starts = struct.unpack_from(f"<{blocks}I", data, 16)
    for k, at in enumerate(starts):
        n = min(block, total - k * block)
        last = k == blocks - 1 and n < block
        split = size if not flags & 0x10 and not last and size <= 16 and block // size >= 128 else 1
        parts = []
        for _ in range(split):
            length = struct.unpack_from("<i", data, at)[0]
            raw = data[at + 4 : at + 4 + length]
            parts.append(raw if length == n // split else unpack[inner](raw, n // split))
            at += 4 + length
        raw = b"".join(parts)
        if flags & 1 and size > 1:
            raw = _unshuffled(raw, size, False)
        elif flags & 4:
            raw = _unshuffled(raw, size, True)
        out.append(raw)
    return b"".join(out)


def unpacked(data: bytes, codec: str) -> bytes:
    if codec in ("zlib",):
        return zlib.decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "lz4":
        return _lz4(data[4:], struct.unpack_from("<I", data)[0])
    if codec == "blosc":
        return blosc(data)
    if codec == "crc32c":
        return data[:-4]
    raise Unsupported(f"Zarr codec {codec}")


@cache
def _zstd(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def packed(data: bytes, codec: str | None, level: int) -> bytes:
    if codec is None:
        return data
    if codec == "zlib":
        return zlib.compress(data, level)
    if codec == "gzip":
        return gzip.compress(data, level, mtime=0)
    return _zstd(level).compress(data)


class Array:
    """What an array's metadata says about its chunks."""

    def __init__(self, meta: dict):
        self.v3 = meta["zarr_format"] == 3
        self.shape = meta["shape"]
        self.shard = None
        if self.v3:
            if meta["chunk_grid"]["name"] != "regular":
                raise Unsupported(f"Zarr chunk grid {meta['chunk_grid']['name']}")
            self.chunks = meta["chunk_grid"]["configuration"]["chunk_shape"]
            kind, self.codecs = meta["data_type"], meta["codecs"]
            self.outer = self.chunks
            if self.codecs and self.codecs[0]["name"] == "sharding_indexed":
                self.shard = self.codecs[0]["configuration"]
                self.codecs, self.chunks = self.shard["codecs"], self.shard["chunk_shape"]
            big = any(c["name"] == "bytes" and c.get("configuration", {}).get("endian") == "big" for c in self.codecs)
            if any(c["name"] == "transpose" for c in self.codecs):
                raise Unsupported("Zarr codec transpose")
            self.dtype = np.dtype({"float32": "f4", "float64": "f8"}.get(kind, kind)).newbyteorder(">" if big else "<")
            encoding = meta.get("chunk_key_encoding", {"name": "default"})
            separator = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
            self.key = (lambda at: separator.join(["c", *map(str, at)])) if encoding["name"] == "default" else (lambda at: separator.join(map(str, at)) or "0")
        else:
            if meta.get("order", "C") != "C" or meta.get("filters"):
                raise Unsupported("Zarr order F or filters")
            self.outer = self.chunks = meta["chunks"]
            self.dtype = np.dtype(meta["dtype"])
            self.codecs = [{"name": meta["compressor"]["id"]}] if meta.get("compressor") else []
            separator = meta.get("dimension_separator", ".")
            self.key = lambda at: separator.join(map(str, at))
        self.fill = meta.get("fill_value") or 0

    def grid(self) -> Iterator[tuple[int, ...]]:
        return product(*(range(ceil(n / c)) for n, c in zip(self.shape, self.outer, strict=True)))

    def decode(self, data: bytes | None) -> np.ndarray:
        """A chunk of the store (a shard if there are shards), at its full size."""
        if data is None:
            return np.full(self.outer, self.fill, dtype=self.dtype.newbyteorder("="))
        if self.shard is None:
            return self._chunk(data)
        out = np.full(self.outer, self.fill, dtype=self.dtype.newbyteorder("="))
        per = [o // c for o, c in zip(self.outer, self.chunks, strict=True)]
        check = 4 if any(c["name"] == "crc32c" for c in self.shard.get("index_codecs", [])) else 0
        size = prod(per) * 16
        raw = data[:size] if self.shard.get("index_location", "end") == "start" else data[len(data) - size - check : len(data) - check]
        index = np.frombuffer(raw, "<u8").reshape(-1, 2)
        for at, (start, n) in zip(product(*map(range, per)), index.tolist(), strict=True):
            if start != NO_CHUNK:
                place = tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, self.chunks, strict=True))
                out[place] = self._chunk(data[start : start + n])
        return out

    def _chunk(self, data: bytes) -> np.ndarray:
        for codec in reversed(self.codecs):
            if codec["name"] != "bytes":
                data = unpacked(data, codec["name"])
        return np.frombuffer(data, self.dtype, prod(self.chunks)).reshape(self.chunks).astype(self.dtype.newbyteorder("="))


def multiscale(attributes: dict) -> dict:
    """The first image that a group's attributes describe."""
    attributes = attributes.get("ome", attributes)
    if not attributes.get("multiscales"):
        raise Unsupported("a Zarr group without multiscales")
    return attributes["multiscales"][0] | {"omero": attributes.get("omero")}


def _json(store, path: str) -> dict | None:
    if store.get_file_info(path).type != pa.fs.FileType.File:
        return None
    with store.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def open_image(path: str) -> dict:
    """The metadata of an image's group and of its largest level."""
    store, root = files.store_of(path)
    group = _json(store, f"{root}/zarr.json")
    if group is not None:
        scale = multiscale(group.get("attributes", {}))
        meta = _json(store, f"{root}/{scale['datasets'][0]['path']}/zarr.json")
    else:
        attributes = _json(store, f"{root}/.zattrs")
        if attributes is None:
            raise FileNotFoundError(f"no Zarr group at {path}")
        scale = multiscale(attributes)
        meta = _json(store, f"{root}/{scale['datasets'][0]['path']}/.zarray")
    if meta is None:
        raise FileNotFoundError(f"no array in {path}")
    axes = [(a["name"] if isinstance(a, dict) else a).lower() for a in scale.get("axes", [*AXES][-len(meta["shape"]) :])]
    if not set(axes) <= set(AXES) or len(axes) != len(meta["shape"]):
        raise Unsupported(f"Zarr axes {axes}")
    transforms = scale["datasets"][0].get("coordinateTransformations", [])
    spacing = next((t["scale"] for t in transforms if t.get("type") == "scale"), [1.0] * len(axes))
    units = [a.get("unit") if isinstance(a, dict) else None for a in scale.get("axes", [])] or [None] * len(axes)
    channels = [ch.get("label") for ch in (scale.get("omero") or {}).get("channels", [])]
    return {"level": scale["datasets"][0]["path"], "meta": meta, "axes": axes, "spacing": dict(zip(axes, spacing, strict=True)), "units": dict(zip(axes, units, strict=True)), "channels": channels, "name": scale.get("name")}


_PLANES = "path string, t int, c short, z int, y0 int, x0 int, height int, width int, pixels array<int>"


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of stores, HEADERS of them at a time."""
    rows = _heads(batches)
    while part := list(islice(rows, HEADERS)):
        yield pa.RecordBatch.from_pylist(part, schema=_HEADER)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = open_image(path)
            size = dict(zip(found["axes"], found["meta"]["shape"], strict=True))
            header = json.dumps(found)
            yield {"path": path, "header": header, "dtype": Array(found["meta"]).dtype.newbyteorder("=").name, **{f"size_{a}": size.get(a, 1) for a in AXES}, "spacing": [float(found["spacing"].get(a, 1.0)) for a in "xyz"], "units": [found["units"].get(a) for a in "xyz"], "channels": found["channels"], "title": found["name"]}


_HEADER = pa.schema([("path", pa.string()), ("header", pa.string()), ("dtype", pa.string()), *((f"size_{a}", pa.int32()) for a in AXES), ("spacing", pa.list_(pa.float64())), ("units", pa.list_(pa.string())), ("channels", pa.list_(pa.string())), ("title", pa.string())])
_HEADER_SQL = "path string, header string, dtype string, size_t int, size_c int, size_z int, size_y int, size_x int, spacing array<double>, units array<string>, channels array<string>, title string"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, header, key) of every chunk, KEYS of them at a time."""
    for batch in batches:
        for path, header in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            grid = Array(json.loads(header)["meta"]).grid()
            while part := [list(at) for at in islice(grid, KEYS)]:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([header] * len(part)), pa.array(part, pa.list_(pa.int32()))], names=["path", "header", "key"])


def _chunks(batches: Iterator[pa.RecordBatch], clamped: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PLANES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int16(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    for batch in batches:
        for path, header, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = json.loads(header)
            array, axes = Array(found["meta"]), found["axes"]
            store, root = files.store_of(path)
            place = f"{root}/{found['level']}/{array.key(key)}"
            data = None
            if store.get_file_info(place).type == pa.fs.FileType.File:
                with store.open_input_stream(place, compression=None) as f:
                    data = f.read()
            cells = array.decode(data)
            start = {a: k * n for a, k, n in zip(axes, key, array.outer, strict=True)}
            cells = cells[tuple(slice(0, n - start[a]) for a, n in zip(axes, array.shape, strict=True))]
            # To TCZYX, missing axes of size 1.
            order = [a for a in AXES if a in axes]
            cells = cells.transpose([axes.index(a) for a in order])
            cells = cells.reshape([cells.shape[order.index(a)] if a in order else 1 for a in AXES])
            for t, c, z in product(*map(range, cells.shape[:3])):
                plane = u16(cells[t, c, z], clamped)
                row = [path, start.get("t", 0) + t, start.get("c", 0) + c, start.get("z", 0) + z, start.get("y", 0), start.get("x", 0), *plane.shape, plane.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def read_zarr(spark: SparkSession, paths: str | list[str] | DataFrame, channel_names: list[str] | None = None, clamp_to_uint16: bool = True) -> DataFrame:
    """(path, image) of OME-Zarr groups: largest level, a task for each run of chunks, one shuffle to join planes.

    ``paths`` may be a table with the column ``path``.  Metadata is read once,
    when the table is defined; ``api.info`` of the result reads no chunk.
    """
    files.prepare(spark)
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "path string")
    roots = paths.select(F.rtrim("path", F.lit("/")).alias("path"))
    tasks = spark.sparkContext.defaultParallelism
    heads = stored(roots.repartition(tasks).mapInArrow(_tasks, _HEADER_SQL))

    def made(pixels: bool) -> DataFrame:
        if pixels:
            return _records(_listed(heads, tasks, clamp_to_uint16), channel_names)
        return _records(heads.withColumn("listed", F.array().cast("array<struct<t:int,c:smallint,z:int,pixels:array<int>>>")), channel_names)

    return files.with_headers(made(True), lambda: made(False))


def _listed(heads: DataFrame, tasks: int, clamp_to_uint16: bool) -> DataFrame:
    """``heads`` with all planes of each store, from its chunks."""
    keys = heads.select("path", "header").mapInArrow(_keys, "path string, header string, key array<int>").repartition(tasks)
    cells = keys.mapInArrow(lambda batches: _chunks(batches, clamp_to_uint16), _PLANES)
    width = heads.select("path", "size_x", "size_y")
    part = F.struct("y0", "x0", "height", "width", "pixels")
    planes = cells.groupBy("path", "t", "c", "z").agg(F.collect_list(part).alias("parts")).join(width, "path")
    row = lambda y: F.flatten(F.transform(F.array_sort(F.filter("parts", lambda p: (p["y0"] <= y) & (y < p["y0"] + p["height"]))), lambda p: F.slice(p["pixels"], ((y - p["y0"]) * p["width"] + 1).cast("int"), p["width"])))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.col("size_y") - 1), row))
    planes = planes.select("path", "t", "c", "z", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["pixels"]).otherwise(whole).alias("pixels"))
    return planes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("t", "c", "z", "pixels"))).alias("listed")).join(heads.drop("header"), "path")


def _records(listed: DataFrame, channel_names: list[str] | None) -> DataFrame:
    names = F.array(*map(F.lit, channel_names)) if channel_names else F.col("channels")
    usable = F.when(F.size(names) == F.col("size_c"), names).otherwise(F.col("channels"))
    record = schema.image(
        image_id=files.stem(F.col("path")),
        name=files.file_name(F.col("path")),
        dtype=F.col("dtype"),
        **{f"size_{a}": F.col(f"size_{a}") for a in AXES},
        **{f"physical_size_{a}": falsy_or(F.get("spacing", F.lit(i)), 1.0) for i, a in enumerate("xyz")},
        physical_size_unit=F.get("units", F.lit(0)),
        channels=schema.synthetic_channels(F.col("size_c"), usable),
        planes=F.transform("listed", lambda p: F.struct(p["z"].alias("z"), p["t"].alias("t"), p["c"].alias("c"), p["pixels"].alias("pixels"))),
    )
    return listed.select("path", record.alias("image"))


def levels_of(array: np.ndarray, levels: int, factor: int, how: str = "nearest") -> list[np.ndarray]:
    """The pyramid of an array in TCZYX: z, y, x divided by ``factor`` a level, by first voxel or by mean."""
    out = [array]
    for _ in range(max(1, int(levels)) - 1):
        last = out[-1]
        size = [max(1, n // factor) for n in last.shape[2:]]
        if how == "nearest":
            new = last[:, :, ::factor, ::factor, ::factor][:, :, : size[0], : size[1], : size[2]]
        else:
            steps = [factor if n >= factor else 1 for n in last.shape[2:]]
            cut = last[:, :, : size[0] * steps[0], : size[1] * steps[1], : size[2] * steps[2]]
            new = cut.reshape(*cut.shape[:2], size[0], steps[0], size[1], steps[1], size[2], steps[2]).mean(axis=(3, 5, 7))
            new = new.astype(array.dtype)
        out.append(np.ascontiguousarray(new))
    return out


def store_files(array: np.ndarray, version: int, *, name: str, spacing_zyx: list[float], units_zyx: list[str], channels: list[str], levels: int = 1, factor: int = 2, how: str = "nearest", chunks: tuple[int, ...] | None = None, shards: tuple[int, ...] | None = None, codec: str | None = "zstd", level: int = 3, dim_order: str = "TCZYX") -> Iterator[tuple[str, bytes]]:
    """The files of a store for one array in TCZYX; metadata comes last."""
    if version not in (2, 3):
        raise Unsupported(f"Zarr version {version}")
    if shards and version == 2:
        shards = None
    order = [AXES.index(a) for a in dim_order.lower()]
    axes = [{"name": a, "type": {"t": "time", "c": "channel"}.get(a, "space"), **({"unit": units_zyx["zyx".index(a)]} if a in "zyx" else {})} for a in dim_order.lower()]
    datasets, metas = [], []
    for k, cells in enumerate(levels_of(array, levels, factor, how)):
        cells = np.ascontiguousarray(cells.transpose(order))
        inner = [min(c, n) for c, n in zip(chunks, cells.shape, strict=True)] if chunks else [1 if a not in "yx" else n for a, n in zip(dim_order.lower(), cells.shape, strict=True)]
        outer = [ceil(s / c) * c for s, c in zip(shards, inner, strict=True)] if shards else inner
        little = cells.astype(cells.dtype.newbyteorder("<"))

        def chunk(at: list[int], inner=inner, little=little) -> bytes:
            full = np.zeros(inner, dtype=little.dtype)
            part = little[tuple(slice(i, i + n) for i, n in zip(at, inner, strict=True))]
            full[tuple(slice(0, n) for n in part.shape)] = part
            return packed(full.tobytes(), codec, level)

        for at in product(*(range(ceil(n / o)) for n, o in zip(cells.shape, outer, strict=True))):
            corner = [i * o for i, o in zip(at, outer, strict=True)]
            if shards:
                body, index = b"", []
                for sub in product(*(range(o // c) for o, c in zip(outer, inner, strict=True))):
                    place = [a + i * c for a, i, c in zip(corner, sub, inner, strict=True)]
                    if all(p < n for p, n in zip(place, cells.shape, strict=True)):
                        own = chunk(place)
                        index += [len(body), len(own)]
                        body += own
                    else:
                        index += [NO_CHUNK, NO_CHUNK]
                table = struct.pack(f"<{len(index)}Q", *index)
                data = body + table + struct.pack("<I", crc32c(table))
            else:
                data = chunk(corner)
            yield (f"{k}/c/" + "/".join(map(str, at)) if version == 3 else f"{k}/" + "/".join(map(str, at))), data
        scale = [{"t": 1.0, "c": 1.0}.get(a) or spacing_zyx["zyx".index(a)] * (array.shape[AXES.index(a)] / cells.shape[dim_order.lower().index(a)] if k else 1.0) for a in dim_order.lower()]
        datasets.append({"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": scale}]})
        kind = little.dtype
        if version == 3:
            codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}} if kind.itemsize > 1 else {"name": "bytes"}]
            if codec:
                codecs.append({"name": "zstd", "configuration": {"level": level, "checksum": False}} if codec == "zstd" else {"name": "gzip", "configuration": {"level": level}})
            if shards:
                index_codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
                codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": codecs, "index_codecs": index_codecs, "index_location": "end"}}]
            metas.append((f"{k}/zarr.json", {"zarr_format": 3, "node_type": "array", "shape": list(cells.shape), "data_type": kind.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": outer}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "attributes": {}, "dimension_names": list(dim_order.lower())}))
        else:
            compressor = None if codec is None else {"id": codec, "level": level}
            metas.append((f"{k}/.zarray", {"zarr_format": 2, "shape": list(cells.shape), "chunks": inner, "dtype": kind.str if kind.itemsize > 1 else "|" + kind.str[1:], "compressor": compressor, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}))
    about = {"name": name, "axes": axes, "datasets": datasets}
    omero = {"channels": [{"label": c, "color": "FFFFFF", "active": True} for c in channels]}
    if version == 3:
        metas.append(("zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [about], "omero": omero}}}))
    else:
        metas += [(".zgroup", {"zarr_format": 2}), (".zattrs", {"multiscales": [{"version": "0.4"} | about], "omero": omero})]
    for path, meta in metas:
        yield path, json.dumps(meta).encode()


#: Names that the writer takes for codecs, and what is stored; anything else becomes zstd.
CODECS = {2: {"zstd": "zstd", "gzip": "zlib", "zlib": "zlib"}, 3: {"zstd": "zstd", "gzip": "gzip", "zlib": "gzip"}}


def write_zarr(df: DataFrame, out: str, column: str = "image", store_name=None, dtype: str = "uint16", clamp: bool = False, dim_order: str = "TCZYX", multiscale_levels: int = 1, downscale_spatial_by: int = 2, how: str = "nearest", zarr_format: int = 3, chunks: tuple[int, ...] | None = None, shards: tuple[int, ...] | None = None, compressor: str | None = "zstd", compressor_level: int = 3) -> int:
    """A store for each record, ``{id}.ome.zarr`` under ``out`` unless named; returns the number of files.

    Codec names other than those known become zstd.  Lower levels take the
    first voxel of each block, or with ``how="mean"`` its mean.
    """
    if sorted(dim_order.upper()) != sorted("TCZYX"):
        raise ValueError(f"axes {dim_order} are not an order of TCZYX")
    row = export_rows(files.spread(df), column, dtype, clamp, store_name if store_name is not None else F.concat(F.col(f"{column}.id"), F.lit(".ome.zarr")))
    codec = None if compressor is None else CODECS[3 if zarr_format == 3 else 2].get(compressor, "zstd")
    kind = np.dtype(dtype)

    def one(r: dict) -> Iterator[tuple[str, bytes]]:
        array = np.zeros([r[f"size_{a}"] for a in AXES], dtype=kind)
        for p in r["planes"]:
            array[p["t"], p["c"], p["z"]] = np.array(p["pixels"]).astype(kind).reshape(array.shape[3:])
        found = store_files(array, zarr_format, name=r["title"], spacing_zyx=r["spacing"][::-1], units_zyx=r["units"][::-1], channels=r["channels"], levels=multiscale_levels, factor=downscale_spatial_by, how=how, chunks=chunks, shards=shards, codec=codec, level=compressor_level, dim_order=dim_order)
        for path, data in found:
            yield f"{files.safe_name(r['file'])}/{path}", data

    return files.written(row, one, out)
