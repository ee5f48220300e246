"""Round trips through files, pixel by pixel, and the cases of the formats."""

import json
import struct
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from lumenframe import api, schema
from lumenframe.operators.dense import dense
from lumenframe.plans import demo
from lumenframe.sources import arrays, files, parquet, tiff, zarr

DATA = "/root/testdata/sf0.001"


def pixels(df):
    """{id: (sizes, flat pixels)} of records."""
    meta = F.col("image.pixels_meta")
    rows = df.select("image.id", F.array(*(meta[f"size_{a}"].cast("int") for a in "tczyx")).alias("size"), dense(F.col("image"), "uint16").alias("planes")).collect()
    return {r["id"]: (tuple(r["size"]), [v for p in r["planes"] for v in p["pixels"]]) for r in rows}


def some(spark):
    return demo.emb_images(spark, DATA).where("image_id < 24").select("image")


@pytest.fixture(scope="module")
def want(spark):
    return pixels(some(spark))


def renamed(df, want):
    """Ids that files gave, back to the records' own."""
    return {k.split(".")[0]: v for k, v in pixels(df).items()}


@pytest.mark.parametrize("options", [{}, {"compression": None}, {"compression": "zstd"}, {"tile": (16, 16), "dim_order": "ZTCYX"}, {"dim_order": "CZTYX", "use_channel_colors": True}])
def test_tiff(spark, want, tmp_path, options):
    assert tiff.write_tiff(some(spark), str(tmp_path), **options) == len(want)
    back = tiff.read_tiff(spark, str(tmp_path))
    assert renamed(back, want) == want
    names = {tuple(r[0]) for r in back.select("image.pixels_meta.channels.name").collect()}
    assert ("dye0", "dye1", "dye2", "dye3") in names
    assert {r[0] for r in back.select("image.pixels_meta.type").collect()} == {"uint16"}


@pytest.mark.parametrize("options", [{}, {"zarr_format": 2}, {"compressor": None}, {"compressor": "gzip", "zarr_format": 2}, {"compressor": "gzip"}, {"chunks": (1, 2, 2, 3, 3)}, {"chunks": (1, 1, 1, 2, 2), "shards": (2, 2, 2, 4, 4)}, {"dim_order": "CTZYX"}, {"multiscale_levels": 3, "how": "mean"}])
def test_zarr(spark, want, tmp_path, options):
    assert zarr.write_zarr(some(spark), str(tmp_path), **options) > len(want)
    back = zarr.read_zarr(spark, [f"{tmp_path}/{i}.ome.zarr" for i in want])
    assert renamed(back, want) == want
    assert {tuple(r[0]) for r in back.select("image.pixels_meta.channels.name").collect()} >= {("dye0",), ("dye0", "dye1")}
    assert {r[0] for r in back.select("image.pixels_meta.physical_size_x").collect()} == {0.5, 1.0}


@pytest.mark.parametrize("write", [zarr.write_zarr, tiff.write_tiff])
def test_one_partition_is_written_by_many_tasks(spark, tmp_path, write):
    """A table of small images has few partitions, and each image is many files."""
    context = spark.sparkContext
    context.setJobGroup(f"{tmp_path}", "writes")
    try:
        assert write(some(spark).coalesce(1), str(tmp_path)) >= 24
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    track = context.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(f"{tmp_path}") for s in track.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 8


def test_zarr_pyramid_shapes(spark, tmp_path):
    zarr.write_zarr(some(spark).limit(1), str(tmp_path), multiscale_levels=3, store_name=F.lit("one.zarr"))
    shapes = [json.load(open(f"{tmp_path}/one.zarr/{k}/zarr.json"))["shape"] for k in range(3)]
    assert all(b == a[:2] + [max(1, n // 2) for n in a[2:]] for a, b in zip(shapes, shapes[1:], strict=False))


def test_parquet(spark, want, tmp_path):
    df = some(spark).withColumn("score", F.lit(3))
    parquet.write_parquet(df, f"{tmp_path}/a.parquet", column_name="scan")
    back = api.read(spark, f"{tmp_path}/a.parquet")
    assert pixels(back) == want and "score" in back.columns
    with pytest.raises(ValueError):
        parquet.read_parquet(spark, f"{tmp_path}/a.parquet", "nothing", strict_schema=True)
    with pytest.raises(IndexError):
        parquet.read_parquet(spark, f"{tmp_path}/a.parquet", row_index=10**6)
    assert parquet.read_parquet(spark, f"{tmp_path}/a.parquet", "scan", strict_schema=True).count() == len(want)


def test_interop_parquet(spark, want, tmp_path):
    parquet.write_interop(some(spark), str(tmp_path), column_name="picture", file_metadata={"lab": "x"})
    table = pq.read_table(f"{tmp_path}/3.parquet")
    assert table.schema.field("picture").type == parquet.ARROW
    assert table.schema.metadata[b"lab"] == b"x" and table.schema.metadata[b"image.type"] == schema.TYPE_TAG.encode()
    back = parquet.read_parquet(spark, [f"{tmp_path}/{i}.parquet" for i in want])
    assert pixels(back) == want
    assert parquet.read_parquet(spark, f"{tmp_path}/3.parquet", row_index=0).first()["image"]["id"] == "3"


def test_interop_refuses_pixels_out_of_range(spark, tmp_path):
    wrong = some(spark).limit(1).withColumn("image", F.col("image").withField("planes", F.transform("image.planes", lambda p: p.withField("pixels", F.transform(p["pixels"], lambda v: v - 70000)))))
    with pytest.raises(Exception, match="70|-|value|int"):
        parquet.write_interop(wrong, str(tmp_path))


def test_file_forms_of_tiff():
    rng = np.random.default_rng(1)
    for kind in ("uint8", "uint16", "int16", "uint32", "float32", "float64"):
        planes = [(rng.random((37, 21)) * 200).astype(kind) for _ in range(3)]
        for options in ({}, {"tile": (16, 32)}, {"big": True}, {"compression": None}, {"compression": "zstd"}):
            found = tiff.Tiff(tiff.encode(planes, "", **options))
            assert len(found.pages) == 3
            for k, p in enumerate(planes):
                assert (found.plane(k) == p).all() and found.dtype(k) == np.dtype(kind)


def by_hand(order, width, height, pixels, compression=1, predictor=1, rows=None):
    """A TIFF of 16-bit pixels with entries written out one by one."""
    rows = rows or height
    strips = [pixels[a * width : (a + rows) * width] for a in range(0, height, rows)]
    body = [b"".join(struct.pack(order + "H", v) for v in s) for s in strips]
    if predictor == 2:
        body = []
        for s in strips:
            lines = [s[i : i + width] for i in range(0, len(s), width)]
            body.append(b"".join(struct.pack(order + "H", (v - (line[i - 1] if i else 0)) % 65536) for line in lines for i, v in enumerate(line)))
    if compression == 8:
        body = [zlib.compress(b) for b in body]
    if compression == 32773:
        body = [b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100)) for b in body]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    at = []
    for b in body:
        at.append(len(out))
        out += b
    places, sizes = len(out), len(out) + 4 * len(at)
    out += b"".join(struct.pack(order + "I", a) for a in at) + b"".join(struct.pack(order + "I", len(b)) for b in body)
    entries = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 1, 16), (259, 3, 1, compression), (273, 4, len(at), places if len(at) > 1 else at[0]), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, len(at), sizes if len(at) > 1 else len(body[0])), (317, 3, 1, predictor)]
    ifd = struct.pack(order + "H", len(entries))
    for tag, code, n, value in entries:
        ifd += struct.pack(order + "HHI", tag, code, n) + (struct.pack(order + "HH", value, 0) if code == 3 else struct.pack(order + "I", value))
    return out[:4] + struct.pack(order + "I", len(out)) + out[8:] + ifd + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "rows"), [(1, 1, None), (1, 2, 3), (8, 2, 4), (32773, 1, 2)])
def test_tiff_by_hand(order, compression, predictor, rows):
    rng = np.random.default_rng(2)
    want = rng.integers(0, 65536, (10, 7))
    found = tiff.Tiff(by_hand(order, 7, 10, want.ravel().tolist(), compression, predictor, rows))
    assert (found.plane(0) == want).all()


def test_lzw():
    # The example of the TIFF specification, and a long run that widens the codes.
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    for text in (data, bytes(np.random.default_rng(3).integers(0, 5, 20_000, dtype=np.uint8)), b"a" * 9000):
        assert tiff.lzw(lzw_encode(text)) == text


def lzw_encode(data):
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 0xFF)
            bits &= (1 << n) - 1

    table, width, held = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for b in data:
        new = held + bytes([b])
        if new in table:
            held = new
            continue
        put(table[held], width)
        table[new] = following
        following += 1
        if following == 4095:
            put(256, width)
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        elif following > (1 << width) - 1:
            width += 1
        held = bytes([b])
    if held:
        put(table[held], width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    put(0, 7)
    return bytes(out)


def test_refused_tiff():
    good = tiff.encode([np.zeros((4, 4), np.uint8)], "")
    page = tiff.Tiff(good)
    page.pages[0][tiff.SAMPLES] = (3,)
    with pytest.raises(tiff.Unsupported):
        page.plane(0)
    page.pages[0][tiff.SAMPLES] = (1,)
    page.pages[0][tiff.COMPRESSION] = (7,)
    with pytest.raises(tiff.Unsupported):
        page.plane(0)
    with pytest.raises(ValueError):
        tiff.Tiff(b"no tiff at all")


def blosc_frame(data, size, shuffle, inner):
    """One Blosc block of one stream."""
    n = len(data) // size
    raw = np.frombuffer(data, np.uint8)
    if shuffle == "byte":
        body, flag = np.ascontiguousarray(raw.reshape(n, size).T).tobytes(), 1
    elif shuffle == "bit":
        bits = np.unpackbits(raw.reshape(n, size), axis=1, bitorder="little")
        body, flag = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").tobytes(), 4
    else:
        body, flag = data, 0
    packed = {3: zlib.compress, 4: zstandard.ZstdCompressor().compress, 1: lambda b: zarr.pa.Codec("lz4_raw").compress(b, asbytes=True)}[inner](body)
    stream = struct.pack("<i", len(packed)) + packed
    return struct.pack("<BBBBIIII", 2, 1, flag | 0x10 | inner << 5, size, len(data), len(data), 20 + len(stream), 20) + stream


@pytest.mark.parametrize("shuffle", ["byte", "bit", None])
@pytest.mark.parametrize("inner", [1, 3, 4])
def test_blosc(shuffle, inner):
    data = np.arange(64, dtype="<u2").tobytes() * 4
    assert zarr.blosc(blosc_frame(data, 2, shuffle, inner)) == data


def test_crc32c():
    assert zarr.crc32c(b"123456789") == 0xE3069283


def stack(tmp_path, shapes):
    rng, want = np.random.default_rng(9), {}
    for name, depth in shapes.items():
        planes = [rng.integers(0, 65536, (5, 4)).astype(np.uint16) for _ in range(depth)]
        (tmp_path / name).write_bytes(tiff.encode(planes, ""))
        want[name] = planes
    return want


def test_stack_pattern(spark, tmp_path):
    want = stack(tmp_path, {"p_Cred_Z00.tif": 1, "p_Cred_Z01.tif": 1, "p_Cblue_Z01.tif": 1, "other.tif": 1})
    df = api.read(spark, f"{tmp_path}/p_C<red,blue>_Z<00-03>.tif")
    (size, flat), meta = next(iter(pixels(df).values())), df.first()["image"]["pixels_meta"]
    zero = [0] * 20
    assert size == (1, 2, 2, 5, 4) and [c["name"] for c in meta["channels"]] == ["red", "blue"]
    assert flat == [*want["p_Cred_Z00.tif"][0].ravel(), *want["p_Cred_Z01.tif"][0].ravel(), *zero, *want["p_Cblue_Z01.tif"][0].ravel()]


def test_stack_with_deep_files(spark, tmp_path):
    want = stack(tmp_path, {"s_C0_Z0.tif": 3, "s_C1_Z0.tif": 1})
    (size, flat) = next(iter(pixels(api.read(spark, f"{tmp_path}/s_C<0-1>_Z<0>.tif")).values()))
    assert size == (1, 2, 3, 5, 4)
    assert flat == [v for p in want["s_C0_Z0.tif"] for v in p.ravel()] + [*want["s_C1_Z0.tif"][0].ravel(), *[0] * 40]


def test_stacks_of_a_folder(spark, tmp_path):
    first, second = tmp_path / "one", tmp_path / "two"
    first.mkdir()
    second.mkdir()
    want = stack(first, {"p_Cred_Z00.tif": 1, "p_Cred_Z01.tif": 1, "p_Cblue_Z01.tif": 1}), stack(second, {"p_Cred_Z00.tif": 1})
    (second / "other.tif").write_bytes(b"not a TIFF file")
    pattern = "p_C<red,blue>_Z<00-01>.tif"
    got = tiff.read_stacks(spark, str(tmp_path), pattern)
    found = pixels(got)
    assert {k: v[0][:3] for k, v in found.items()} == {"one": (1, 2, 2), "two": (1, 1, 1)}
    for folder, name in ((first, "one"), (second, "two")):
        assert found[name] == next(iter(pixels(tiff.read_stack(spark, str(folder), pattern)).values()))
    assert want and [c["name"] for c in got.where("image.id = 'one'").first()["image"]["pixels_meta"]["channels"]] == ["red", "blue"]


def test_tasks_do_not_grow_with_stacks(spark, tmp_path):
    """Many small stacks share a task: neither listing nor reading takes a task for each."""
    data = tiff.encode([np.zeros((2, 2), np.uint16)], "")
    for k in range(400):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}/p_Z0.tif").write_bytes(data)
    context = spark.sparkContext
    context.setJobGroup("stacks", "stacks")
    try:
        assert tiff.read_stacks(spark, str(tmp_path), "p_Z<0-1>.tif").select("image.id").distinct().count() == 400
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    track = context.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("stacks") for s in track.getJobInfo(j).stageIds}
    assert sum(track.getStageInfo(s).numTasks for s in stages if track.getStageInfo(s)) < 400


def test_stacks_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver has no list of the files, and what tasks list is what Spark's readers would."""
    for name in ("r/one", "r/two/deep er", "r/two/_left", "r/.hidden", "r/k=1"):
        (tmp_path / name).mkdir(parents=True)
        stack(tmp_path / name, {"p_C0_Z00.tif": 2, "p_C1_Z00.tif": 1, ".p_C2_Z00.tif": 1})
    pattern = "p_C<0-2>_Z<00-01>.tif"
    got, listed = tiff.read_stacks(spark, f"{tmp_path}/r", pattern), tiff.read_stacks(spark, f"{tmp_path}/[r]", pattern)
    assert got.inputFiles() == [] and len(listed.inputFiles()) > 0
    assert pixels(got) == pixels(listed) and set(pixels(got)) == {"one", "deep er", "k=1"}
    assert sorted(map(tuple, got.select("folder", "image.name").collect())) == sorted(map(tuple, listed.select("folder", "image.name").collect()))
    assert sorted(map(tuple, api.info(got).collect())) == sorted(map(tuple, api.info(listed.select("*")).collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tiff.read_stacks(spark, f"{tmp_path}/none", pattern).collect()


def test_rows_are_dealt_before_they_become_files(spark, tmp_path):
    """A table of one partition is written by several tasks, an image's rows by one."""
    rows = spark.range(0, 4000, 1, 1).select((F.col("id") % 200).alias("image_id"))
    dealt = files.spread(rows, "image_id").select("image_id", F.spark_partition_id().alias("task")).distinct()
    assert dealt.count() == 200 and dealt.select("task").distinct().count() > 8
    assert files.spread(rows).select(F.spark_partition_id().alias("task")).distinct().count() >= 32


def test_stack_by_regular_expression(spark, tmp_path):
    want = stack(tmp_path, {"b2.tif": 1, "b1.tif": 1, "c1.tif": 1})
    (size, flat) = next(iter(pixels(api.read(spark, f"{tmp_path}/b.*[.]tif")).values()))
    assert size == (1, 1, 2, 5, 4) and flat == [*want["b1.tif"][0].ravel(), *want["b2.tif"][0].ravel()]
    with pytest.raises(FileNotFoundError):
        api.read(spark, f"{tmp_path}/z<0-1>.tif")


def test_arrays_of_any_axes(spark):
    rng = np.random.default_rng(4)
    for order in ("YX", "ZYX", "CYX", "XYC", "TCZYX", "ZXTYC"):
        array = rng.integers(0, 65536, tuple(rng.integers(1, 5, len(order))))
        df = arrays.from_numpy(spark, array, order, image_id="a")
        full = array.transpose([order.index(a) for a in arrays.AXES if a in order])
        shape = [full.shape[[a for a in arrays.AXES if a in order].index(a)] if a in order else 1 for a in arrays.AXES]
        assert pixels(df)["a"] == (tuple(shape), full.ravel().tolist())
    assert next(iter(pixels(api.read(spark, np.array([[1.9, -3], [70000, np.nan]]))).values()))[1] == [1, 0, 65535, 0]
    with pytest.raises(ValueError):
        arrays.dim_order_of("TCZ", 3)


def test_work_on_arrays_grows_with_their_pixels(spark):
    """What makes an array is worked out once, not for each plane or pixel."""
    array = np.random.default_rng(5).integers(-9, 70000, (150, 120, 6))
    df = spark.createDataFrame([(array.ravel().tolist(),)], "flat array<bigint>").withColumn("flat", F.transform("flat", lambda v: v + 0))
    began = time.time()
    made = arrays.from_arrays(df, "flat", {"X": F.lit(150), "Y": F.lit(120), "C": F.lit(6)}, "XYC", image_id=F.lit("a"))
    assert pixels(made)["a"][1] == array.transpose(2, 1, 0).clip(0, 65535).ravel().tolist()
    assert time.time() - began < 60


def test_read_dispatch(spark, tmp_path):
    for wrong in (3, None):
        with pytest.raises(TypeError):
            api.read(spark, wrong)
    with pytest.raises(TypeError):
        api.read(spark, f"{tmp_path}/x.png")
    with pytest.raises(ValueError):
        api.write(some(spark), "png", "x")
    with pytest.raises(ValueError):
        api.write(some(spark), "OME_TIFF")
    assert len(api.write(some(spark), "rows")) == 24
    assert api.write(some(spark), "ome-tiff", f"{tmp_path}/t") == 24


def test_stream_of_files(spark, tmp_path):
    from lumenframe.streaming import images

    stack(tmp_path, {"a.tif": 2, "b.tif": 1})
    out = images.brightness(images.first_planes(images.stream_planes(spark, str(tmp_path))))
    query = out.writeStream.outputMode("complete").format("memory").queryName("bright").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        query.processAllAvailable()
        row = spark.table("bright").first()
    finally:
        query.stop()
    assert row["n"] == 60


def test_a_stream_takes_many_small_files_at_once(spark, tmp_path):
    from lumenframe.streaming import images

    want = stack(tmp_path, {f"{k}.tif": 1 for k in range(230)})
    out = images.brightness(images.first_planes(images.stream_planes(spark, str(tmp_path))))
    writer = out.writeStream.outputMode("complete").format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    before = {k: spark.conf.get(k) for k in (images._LISTING, images._OPENING)}
    with images.many_files(spark):
        query = writer.start()
        query.awaitTermination()
    assert before == {k: spark.conf.get(k) for k in before}
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 1
    row = spark.table("many").first()
    assert (row["n"], row["total"]) == (230 * 20, sum(int(p.sum()) for own in want.values() for p in own))


def test_headers_need_no_pixels(spark, want, tmp_path):
    tiff.write_tiff(some(spark), f"{tmp_path}/t")
    whole = {r["image_id"]: tuple(r)[1:] for r in api.info(tiff.read_tiff(spark, f"{tmp_path}/t").select("*")).collect()}
    # Pixel data that cannot be decoded: headers do not notice.
    for path in (tmp_path / "t").glob("*.tiff"):
        data, pages = bytearray(path.read_bytes()), tiff.Tiff(path.read_bytes()).pages
        for page in pages:
            for at, n in zip(page[tiff.STRIPS], page[tiff.STRIP_BYTES], strict=True):
                data[at : at + n] = b"\xff" * n
        path.write_bytes(bytes(data))
    broken = tiff.read_tiff(spark, f"{tmp_path}/t")
    assert {r["image_id"]: tuple(r)[1:] for r in api.info(broken).collect()} == whole and len(whole) == 24
    with pytest.raises(Exception, match="zlib|decompress"):
        broken.collect()


def test_headers_of_stacks_and_stores(spark, tmp_path):
    stack(tmp_path, {"s_C0_Z0.tif": 3, "s_C1_Z0.tif": 1})
    df = api.read(spark, f"{tmp_path}/s_C<0-1>_Z<0>.tif")
    assert [tuple(r) for r in api.info(df).collect()] == [tuple(r) for r in api.info(df.select("*")).collect()]
    zarr.write_zarr(some(spark).limit(3), f"{tmp_path}/z")
    stores = sorted(str(p) for p in (tmp_path / "z").iterdir())
    df = zarr.read_zarr(spark, stores)
    assert sorted(map(tuple, api.info(df).collect())) == sorted(map(tuple, api.info(df.select("*")).collect()))
    for store in stores:
        for path in __import__("pathlib").Path(store).rglob("c/**/*"):
            if path.is_file():
                path.write_bytes(b"broken")
    assert api.info(df).count() == 3 and sorted(map(tuple, api.info(df).collect()))


def test_arrow_records_and_views(spark):
    import pyarrow as pa

    record = api.write(some(spark).limit(1), "rows")[0]
    scalar = pa.array([record], parquet.ARROW)[0]
    assert pixels(api.read(spark, scalar)) == pixels(api.read(spark, record))
    df = some(spark).limit(1)
    assert api.view(df)[0].ndim == 2 and api.view(df, "volume")[0].ndim == 3 and api.view(df, "html").startswith("<ul>")
    with pytest.raises(ValueError, match="unknown view"):
        api.view(df, "hologram")


def test_wrong_types_are_not_verified(spark):
    for text in ("named_struct('type', 'x', 'version', '1', 'id', 'a', 'name', 'n', 'acquisition_datetime', current_timestamp(), 'pixels_meta', named_struct('size_x', 1), 'planes', array(named_struct('z', 0, 't', 0, 'c', 0, 'pixels', array('a', 'b'))))", "named_struct('type', 'x', 'version', '1', 'id', 'a', 'name', 'n', 'acquisition_datetime', current_timestamp(), 'pixels_meta', named_struct('size_x', 1), 'planes', 'none')", "named_struct('type', 'x', 'version', '1', 'id', 5, 'name', 'n', 'acquisition_datetime', 'now', 'pixels_meta', named_struct('size_x', 9000000000), 'planes', null)"):
        df = spark.range(1).selectExpr(f"{text} AS image")
        assert df.select(schema.verified(df)).first()[0] is False
    wide = "named_struct('type', 'x', 'version', '1', 'id', 'a', 'name', 'n', 'acquisition_datetime', current_timestamp(), 'pixels_meta', named_struct('size_x', {}), 'planes', array(named_struct('z', 0L, 't', 0, 'c', 0, 'pixels', array({}))))"
    for size, pixel, ok in (("4L", "65535L", True), ("9000000000", "1L", False), ("4L", "65536L", False), ("4L", "-1L", False), ("4L", "CAST(NULL AS BIGINT)", True), ("4L", "double('NaN')", False)):
        df = spark.range(1).selectExpr(f"{wide.format(size, pixel)} AS image")
        assert df.select(schema.verified(df)).first()[0] is ok, (size, pixel)


def test_normalised_slices_refuse_what_records_refuse(spark):
    from lumenframe.operators import slicing

    images = spark.createDataFrame([(1, 1, 1, 1, 4, 4)], "image_id long, size_t int, size_c int, size_z int, size_y int, size_x int")
    planes = spark.createDataFrame([(1, 0, 0, 0, 0, [1] * 10), (1, 0, 0, 0, 1, list(range(16)))], "image_id long, t int, c int, z int, pos int, pixels array<int>")
    assert slicing.slice_planes(images, planes, 1, 3, 0, 2).first()["pixels"] == [1, 2, 5, 6]
    with pytest.raises(Exception, match="wrong length"):
        slicing.slice_planes(images, planes.where("pos = 0"), 0, 4, 0, 3).collect()
    with pytest.raises(Exception, match="outside the image"):
        slicing.slice_planes(images, planes, 0, 5, 0, 3).collect()
    with pytest.raises(Exception, match="must keep"):
        slicing.slice_planes(images, planes, 0, 4, 0, 3, c_indices=[3]).collect()
