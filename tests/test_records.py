"""Construction, checks, slices and grids, on small records made by hand and by chance."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import api, model, schema
from lumenframe.functions import pixels as px
from lumenframe.operators import dense, describe, slicing
from lumenframe.plans import demo
from lumenframe.sources import pattern

DATA = "/root/testdata/sf0.001"
#: Sizes (t, c, z, y, x) of the golden images and what they are.
GOLDEN = [
    ((1, 1, 5, 167, 439), "3D image (z-stack)"),
    ((7, 1, 1, 167, 439), "movie / timelapse"),
    ((1, 1, 1, 167, 439), "2D image"),
    ((1, 3, 1, 167, 439), "2D image"),
    ((1, 3, 5, 167, 439), "3D image (z-stack)"),
    ((7, 3, 1, 167, 439), "movie / timelapse"),
    ((7, 3, 5, 167, 439), "4D timelapse-volume"),
    ((7, 1, 5, 167, 439), "4D timelapse-volume"),
    ((1, 2, 22, 128, 128), "3D image (z-stack)"),
    ((1, 1, 22, 128, 128), "3D image (z-stack)"),
    ((1, 2, 1, 128, 128), "2D image"),
    ((1, 1, 1, 512, 512), "2D image"),
]


def record(planes, size=(1, 2, 1, 3, 4), **meta):
    """A record of sizes (t, c, z, y, x) from (t, c, z, pixels) planes."""
    t, c, z, y, x = size
    channels = [Row(id=f"C{i}", name=n, emission_um=0.46, excitation_um=0.4, illumination="Epifluorescence", color_rgba=v) for i, (n, v) in enumerate([("DNA", 0x0000FFFF), ("Mito", 0xFF0000FF)][:c])]
    pm = {"dimension_order": "XYCT", "type": "uint16", "size_x": x, "size_y": y, "size_z": z, "size_c": c, "size_t": t, "physical_size_x": 0.65, "physical_size_y": 0.65, "physical_size_z": 1.0, "physical_size_x_unit": "µm", "physical_size_y_unit": "µm", "physical_size_z_unit": "µm", "channels": channels} | meta
    return (schema.TYPE_TAG, "1.0.0", "img-1", "Example", datetime(2025, 1, 1, 12), tuple(pm.values()), [(z, t, c, p) for t, c, z, p in planes])


def table(spark, records):
    kind = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("image", schema.IMAGE)])
    return spark.createDataFrame([(i, r) for i, r in enumerate(records)], kind)


A = [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
B = [v + 100 for v in A]


def planes_of(df):
    return [{(p["t"], p["c"], p["z"]): p["pixels"] for p in r["image"]["planes"]} for r in df.orderBy("image_id").collect()]


def test_defaults(spark):
    made = spark.range(1).select(F.lit(0).cast("long").alias("image_id"), schema.image(size_x=F.lit(3), size_y=F.lit(2), size_z=F.lit(4)).alias("image")).first()["image"]
    assert made["type"] == schema.TYPE_TAG and made["pixels_meta"]["dimension_order"] == "XYZCT"
    assert [c["name"] for c in made["pixels_meta"]["channels"]] == ["default"]
    assert [tuple(p) for p in made["planes"]] == [(0, 0, 0, [0] * 6)]
    assert made["pixels_meta"]["physical_size_y_unit"] == "µm" and made["pixels_meta"]["physical_size_x"] == 1.0
    assert abs((datetime.now(UTC).replace(tzinfo=None) - made["acquisition_datetime"]).total_seconds()) < 600


def test_schema_of_made_records(spark):
    df = spark.range(1).select(schema.image().alias("image"))
    assert schema.is_record_type(df.schema["image"].dataType, strict=False)
    assert schema.canonical(df).schema["image"].dataType.simpleString() == schema.IMAGE.simpleString()


def test_canonical_form(spark):
    kind = T.StructType([T.StructField("image", T.StructType([T.StructField("id", T.StringType()), T.StructField("odd", T.LongType())]))])
    got = schema.canonical(spark.createDataFrame([(("a", 3),), (None,)], kind)).collect()
    assert got[0]["image"]["id"] == "a" and got[0]["image"]["planes"] is None and got[1]["image"] is None
    wrong = spark.createDataFrame([((7,),)], T.StructType([T.StructField("image", T.StructType([T.StructField("id", T.LongType())]))]))
    with pytest.raises(TypeError):
        schema.canonical(wrong)


def test_verification(spark):
    df = table(spark, [record([(0, 0, 0, A), (0, 1, 0, B)]), record([(0, 0, 0, [-1])]), record([(0, 0, 0, [70000])]), record([])])
    assert [r[0] for r in df.orderBy("image_id").select(schema.verified(df)).collect()] == [True, False, False, True]
    numbers = spark.range(1)
    assert numbers.select(schema.verified(numbers, "id")).first()[0] is False
    found = df.orderBy("image_id").select(schema.problems(F.col("image"))).collect()
    assert found[0][0] == [] and set(found[1][0]) == {"plane_length", "pixel_range"} and found[3][0] == []


def test_golden_kinds(spark):
    rows = spark.createDataFrame([(i, *s) for i, (s, _) in enumerate(GOLDEN)], "image_id long, t int, c int, z int, y int, x int")
    df = rows.select("image_id", schema.image(size_t=F.col("t"), size_c=F.col("c"), size_z=F.col("z"), size_y=F.col("y"), size_x=F.col("x"), planes=F.array().cast(T.ArrayType(schema.PLANE))).alias("image"))
    for r in describe.describe(df).orderBy("image_id").collect():
        (t, c, z, y, x), kind = GOLDEN[r["image_id"]]
        channels = f"multi-channel ({c} channels)" if c > 1 else "single-channel"
        assert (r["kind"], r["channels"], r["is_multichannel"]) == (kind, c, c > 1)
        assert r["summary"] == f"{kind}, {channels} - shape (T={t}, C={c}, Z={z}, Y={y}, X={x})"


def test_slice(spark):
    df = table(spark, [record([(0, 0, 0, A), (0, 1, 0, B)])])
    cut = slicing.slice_images(df, 1, 3, 1, 3, c_indices=[1, 5, 1])
    row = cut.first()["image"]
    assert planes_of(cut) == [{(0, 0, 0): [111, 112, 121, 122]}]
    meta = row["pixels_meta"]
    assert (meta["size_x"], meta["size_y"], meta["size_c"]) == (2, 2, 1)
    assert [(c["id"], c["name"], c["color_rgba"]) for c in meta["channels"]] == [("ch-0", "Mito", 0xFF0000FF)]
    assert row["name"] == "Example" and abs(meta["physical_size_x"] - 0.65) < 1e-6
    whole = slicing.slice_images(df, 0, 4, 0, 3)
    assert planes_of(whole) == planes_of(df)


@pytest.mark.parametrize(("bounds", "selection"), [((0, 5, 0, 1), {}), ((2, 2, 0, 1), {}), ((-1, 2, 0, 1), {}), ((0, 1, 0, 9), {}), ((0, 1, 0, 1), {"c_indices": [7]}), ((0, 1, 0, 1), {"t_indices": []})])
def test_slice_refuses(spark, bounds, selection):
    df = table(spark, [record([(0, 0, 0, A), (0, 1, 0, B)])])
    with pytest.raises(Exception, match="crop bounds|selection"):
        slicing.slice_images(df, *bounds, **selection).collect()


def test_slice_of_odd_records(spark):
    with pytest.raises(Exception, match="no planes"):
        slicing.slice_images(table(spark, [record([])]), 0, 1, 0, 1).collect()
    with pytest.raises(Exception, match="wrong length"):
        slicing.slice_images(table(spark, [record([(0, 0, 0, [1, 2])])]), 0, 1, 0, 1).collect()
    twice = table(spark, [record([(0, 0, 0, A), (0, 0, 0, B)])])
    assert planes_of(slicing.slice_images(twice, 0, 2, 0, 1)) == [{(0, 0, 0): [100, 101], (0, 1, 0): [0, 0]}]
    assert planes_of(slicing.slice_images(twice, 0, 2, 0, 1, fill_missing=False)) == [{(0, 0, 0): [100, 101]}]
    bare = table(spark, [record([(0, 0, 0, A)], channels=[])])
    assert [(c["id"], c["name"], c["emission_um"]) for c in slicing.slice_images(bare, 0, 1, 0, 1, c_indices=[1]).first()["image"]["pixels_meta"]["channels"]] == [("ch-0", "C1", None)]


def test_filter_before_slice_is_kept(spark):
    small, large = record([(0, 0, 0, [1])], size=(1, 1, 1, 1, 1)), record([(0, 0, 0, A), (0, 1, 0, B)])
    df = table(spark, [small, large]).where("image.pixels_meta.size_x = 4")
    assert model.planes_of(slicing.slice_images(df, 0, 4, 0, 1)).count() == 2


def chance(rng):
    size = tuple(rng.randrange(1, 4) for _ in range(5))
    t, c, z, y, x = size
    places = [(i, j, k) for i in range(t) for j in range(min(c, 2)) for k in range(z)]
    kept = [p for p in places if rng.random() < 0.8] or places[:1]
    kept += [rng.choice(kept) for _ in range(rng.randrange(2))]
    rng.shuffle(kept)
    return record([(*p, [rng.randrange(65536) for _ in range(y * x)]) for p in kept], size=(t, min(c, 2), z, y, x))


def array_of(r):
    pm = r["pixels_meta"]
    out = np.zeros([pm[f"size_{a}"] for a in "tczyx"], dtype=int)
    for p in r["planes"]:
        out[p["t"], p["c"], p["z"]] = np.array(p["pixels"]).reshape(out.shape[3:])
    return out


def test_cropping_and_densifying_commute(spark):
    rng = random.Random(6)
    df = table(spark, [chance(rng) for _ in range(40)])
    cut = slicing.slice_images(df.where("image.pixels_meta.size_x >= 2 and image.pixels_meta.size_y >= 2 and image.pixels_meta.size_t >= 2"), 1, 2, 0, 2, t_indices=[1])
    before = {r["image_id"]: array_of(r["image"]) for r in df.collect()}
    rows = cut.select("image_id", dense.dense(F.col("image")).alias("planes"), F.col("image.pixels_meta.size_z").alias("z")).collect()
    assert rows
    for r in rows:
        want = before[r["image_id"]][1:2, :, :, 0:2, 1:2]
        assert [v for p in r["planes"] for v in p["pixels"]] == want.ravel().tolist()


def test_nesting_after_normalising_changes_nothing(spark):
    rng = random.Random(7)
    df = table(spark, [chance(rng) for _ in range(20)])
    again = model.nest(*model.normalise(df))
    assert planes_of(again) == planes_of(df)
    assert [r["image"]["pixels_meta"] for r in again.orderBy("image_id").collect()] == [r["image"]["pixels_meta"] for r in df.orderBy("image_id").collect()]


def test_normalised_slice_and_grid_agree_with_records(spark):
    rng = random.Random(8)
    df = table(spark, [chance(rng) for _ in range(30)]).where("image.pixels_meta.size_x >= 2")
    images = df.select("image_id", *(F.col(f"image.pixels_meta.size_{a}").cast("int").alias(f"size_{a}") for a in "tczyx"))
    planes = model.planes_of(df)
    for fill in (True, False):
        want = planes_of(slicing.slice_images(df, 1, 2, 0, 1, z_indices=[0], fill_missing=fill))
        rows = slicing.slice_planes(images, planes, 1, 2, 0, 1, z_indices=[0], fill_missing=fill).collect()
        got = {}
        for r in rows:
            got.setdefault(r["image_id"], {})[r["t"], r["c"], r["z"]] = r["pixels"]
        assert [got[i] for i in sorted(got)] == [w for w in want if w]
    grid = {(r["image_id"], r["t"], r["c"], r["z"]): r["pixels"] for r in dense.dense_planes(images, planes).collect()}
    for r in df.collect():
        for (t, c, z), p in {k[1:]: v for k, v in grid.items() if k[0] == r["image_id"]}.items():
            assert array_of(r["image"])[t, c, z].ravel().tolist() == p
    assert slicing.latest(planes).count() == planes.select("image_id", "t", "c", "z").distinct().count()


def test_grid_refuses(spark):
    for planes, size, why in (([(0, 0, 5, A)], (1, 2, 1, 3, 4), "out of range"), ([(0, 0, 0, [1])], (1, 2, 1, 3, 4), "wrong length"), ([(0, 0, 0, A)], (0, 2, 1, 3, 4), "positive")):
        with pytest.raises(Exception, match=why):
            table(spark, [record(planes, size)]).select(dense.dense(F.col("image"))).collect()
    with pytest.raises(ValueError):
        dense.cast_pixels(F.col("x"), "uint7")


def test_lookup_and_volume(spark):
    df = table(spark, [record([(0, 0, 0, A), (0, 1, 0, B), (0, 1, 0, A)])])
    assert df.select(slicing.plane_at(F.col("image"), 0, 1, 0)).first()[0] == A
    with pytest.raises(Exception, match="no plane"):
        df.select(slicing.plane_at(F.col("image"), 1, 0, 0)).collect()
    with pytest.raises(Exception, match="no channel"):
        df.select(slicing.volume(F.col("image"), 2)).collect()
    v = df.select(slicing.downsampled_volume(F.col("image"), 0, 2, (1.0, 2.0, 3.0)).alias("v")).first()["v"]
    assert v["layers"] == [[0, 2, 20, 22]] and (v["size_y"], v["size_x"], v["spacing_z"], v["spacing_x"]) == (2, 2, 2.0, 6.0)


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(px.clamp(F.lit(v))) for v in (-5.0, 1.9, 70000.0, float("nan"))] == [0, 1, 65535, 0]
    assert [get(px.wrap(F.lit(v), "uint8")) for v in (-1, 256, 300)] == [255, 0, 44]
    assert [get(px.wrap(F.lit(v), "int8")) for v in (128, -129)] == [-128, 127]
    assert get(px.rgb(F.lit(0x11223344))) == 0x112233 and get(px.rgb(F.lit(None))) == 0xFFFFFF
    assert get(px.zero_padded(F.lit(12345), F.lit(3))) == "12345" and get(px.zero_padded(F.lit(7), F.lit(3))) == "007"
    assert get(px.stem(F.lit("/a/b.ome.tiff"))) == "b.ome" and get(px.suffix(F.lit("a/B.TIF"))) == ".tif"
    assert get(px.pad_or_cut(F.array(F.lit(1), F.lit(2)), F.lit(3))) == [1, 2, 0]
    assert get(px.pad_or_cut(F.array(F.lit(1), F.lit(2)), F.lit(1))) == [1]
    assert tuple(get(describe.limits(F.array(F.lit(4), F.lit(4))))) == (4.0, 5.0)
    assert tuple(get(describe.limits(F.array(F.lit(4), F.lit(9)), vmin=1))) == (1.0, 9.0)
    assert get(dense.halved(F.array(*map(F.lit, range(12))), F.lit(4), F.lit(3), 2, "mean")) == [2, 4]
    assert get(dense.halved(F.array(*map(F.lit, range(12))), F.lit(4), F.lit(3), 2)) == [0, 2]


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 65536, 777)
    df = spark.createDataFrame([(1, int(v)) for v in values] + [(2, 7)], "g long, value int")
    got = {r["g"]: (r["clim_low"], r["clim_high"]) for r in describe.percentile_limits(df, ["g"]).collect()}
    assert np.allclose(got[1], np.percentile(values, [1.0, 99.9])) and got[2] == (7.0, 8.0)


def test_pattern_grammar(spark):
    assert pattern.choices("008-010") == (("008", "009", "010"), True)
    assert pattern.choices("1-9:4") == (("1", "5", "9"), True)
    assert pattern.choices(" a , 7") == (("a", "7"), False)
    assert pattern.choices("red") == (("red",), False)
    for wrong in ("5-3",):
        with pytest.raises(ValueError):
            pattern.choices(wrong)
    for wrong in ("", "a<1>_<2"):
        with pytest.raises(ValueError):
            pattern.parse(wrong)
    slots = pattern.parse("x_Ch<a,b>_FocalPlane<1-2>_<9>t<1>").slots
    assert [s.axis for s in slots] == ["C", "Z", None, "T"]
    assert pattern.channel_names(pattern.parse("x_Z<a,b>_W<u,v>")) == ["u", "v"]
    rows = {r["name"]: (r["t"], r["c"], r["z"]) for r in pattern.expand(spark, "s<1-2>_q<7,8>z<3>.tif").collect()}
    assert rows == {"s1_q7z3.tif": (0, 0, 0), "s1_q8z3.tif": (0, 1, 0), "s2_q7z3.tif": (1, 0, 0), "s2_q8z3.tif": (1, 1, 0)}
    with pytest.raises(ValueError):
        pattern.expand(spark, "s<1-2>", series_as=None)
    last = {r["name"]: r["z"] for r in pattern.expand(spark, "z<0-1>_z<0-2>").collect()}
    assert last["z1_z2"] == 2 and last["z1_z0"] == 0


def read_schema(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "ReadSchema" in line]


def test_metadata_queries_read_no_pixels(spark, tmp_path):
    demo.emb_images(spark, DATA).write.parquet(str(tmp_path / "images"))
    df = spark.read.parquet(str(tmp_path / "images"))
    for query in (describe.describe(df), model.headers(df), api.info(df), df.select("image_id", F.explode("image.planes.z"))):
        assert all("pixels:" not in line for line in read_schema(query)) and read_schema(query)
    filtered = describe.describe(df.where("image.pixels_meta.size_c > 1"))
    assert "size_c" in filtered._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:200]


def test_slicing_records_needs_no_shuffle(spark, tmp_path):
    demo.emb_images(spark, DATA).write.parquet(str(tmp_path / "images"))
    df = spark.read.parquet(str(tmp_path / "images"))
    plan = slicing.slice_images(df, 0, 1, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_functions_of_sql(spark):
    from lumenframe.functions import sql

    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    row = spark.sql("SELECT image_kind(7, 5) k, pixels_crop(array(0,1,2,3,10,11,12,13), 4, 1, 3, 0, 2) c, pixel_clamp_u16(double('NaN')) n, pixel_clamp_u16(99999) h, pixel_wrap_u8(-1) w, rgb_of_rgba(287454020) r, falsy_or_one(0) f").first()
    assert tuple(row) == ("4D timelapse-volume", [1, 2, 11, 12], 0, 65535, 255, 0x112233, 1.0)


def test_views(spark):
    import zlib

    from lumenframe import view

    df = table(spark, [record([(0, 0, 0, A), (0, 1, 0, B)])])
    pixels, low, high = view.plane(df, c=1)
    assert pixels.tolist() == np.array(B).reshape(3, 4).tolist() and (low, high) == (100.0, 123.0)
    data = view.png(pixels, low, high)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at])])
    assert len(raw) == 3 * 5 and raw[1] == 0 and raw[-1] == 255
    voxels, spacing, limits = view.volume(df, step=2)
    assert voxels.shape == (1, 2, 2) and spacing[0] == 2.0 and limits[0] < limits[1]
    assert view.snapshot(df).startswith("<img") and "2D image" in view.summary_html(df)
    assert api.write(df, "numpy")[0].tolist() == np.array(A + B).reshape(1, 2, 1, 3, 4).tolist()
