import json
import sys
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.operators import batching, decode, errors, samples, tensors
from shardloom.operators.filters import LambdaFilter, SimpleKeyFilter, SimpleSizeFilter
from shardloom.operators.mappers import AddOriginalImageSizeAsTupleAndCropToSquare, BatchedEinopsTransform, ImageTransforms, LambdaMapper, Rescaler
from tests.tars import image, png

SIZES = "__url__ string, original_height string, original_width int"


def keys(df, c="__url__"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def sized(spark):
    return spark.createDataFrame([("x/big", "64", 64), ("x/small", "8", 64), ("y/none", None, 64), ("y/text", "tall", 64)], SIZES)


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({"size": 32, "strict": True}, ["x/big"]),
        ({"size": [8, 64], "strict": True}, ["x/big", "x/small"]),
        ({"size": 64, "mode": "max", "strict": False}, ["x/big", "x/small", "y/none", "y/text"]),
        ({"size": 32, "strict": False}, ["x/big", "y/none", "y/text"]),
        ({"size": 32, "strict": {"none": False, "y": True}}, ["x/big", "y/none"]),
        ({"size": 32, "strict": {"z": False}, "on_no_match": "keep"}, ["x/big", "y/none", "y/text"]),
        ({"size": 32, "strict": True, "exclude_keys": ["small"]}, ["x/big", "x/small"]),
        ({"size": 32, "strict": True, "height_key": "absent"}, []),
    ],
)
def test_sizes(sized, how, want):
    assert keys(SimpleSizeFilter(**how).apply(sized)) == want


def test_size_settings(sized):
    with pytest.raises(TypeError):
        SimpleSizeFilter(3)
    for how in ({"mode": "other"}, {"size": [1]}):
        with pytest.raises(ValueError):
            SimpleSizeFilter(**({"size": 3, "strict": True} | how))
    with pytest.raises(Exception, match="no entry"):
        SimpleSizeFilter(32, strict={"z": True}).apply(sized).collect()


def test_filters(sized, spark):
    assert keys(SimpleKeyFilter("original_height").apply(sized)) == ["x/big", "x/small", "y/text"]
    assert keys(SimpleKeyFilter("absent").apply(sized)) == []
    raw = spark.createDataFrame([("a", {"jpg": b"1"}), ("b", {"txt": b"2"})], "__url__ string, fields map<string,binary>")
    assert keys(SimpleKeyFilter("jpg").apply(raw)) == ["a"]
    assert keys(LambdaFilter("original_width", lambda c: c > 70, exclude_keys="small").apply(sized)) == ["x/small"]
    with pytest.raises(KeyError):
        LambdaFilter("absent", lambda c: c).apply(sized)
    with pytest.raises(Exception, match="KeyError"):
        LambdaFilter("original_height", lambda c: c == "8").apply(sized).collect()


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id original_height", "id original_width", "'u' __url__").write.parquet(str(tmp_path / "t"))
    df = SimpleSizeFilter(5, strict=True).apply(spark.read.parquet(str(tmp_path / "t")))
    assert "GreaterThanOrEqual(original_height,5" in df._jdf.queryExecution().executedPlan().toString()


def test_policies(sized):
    double = LambdaMapper("original_height", F.upper)
    with errors.on_error("skip"):
        assert keys(double.apply(sized)) == ["x/big", "x/small", "y/text"]
    with errors.on_error("mark"):
        good, bad = errors.split(double.apply(sized))
    assert keys(good) == ["x/big", "x/small", "y/text"] and keys(bad) == ["y/none"]
    with pytest.raises(Exception, match="KeyError: original_height"):
        double.apply(sized).collect()
    with pytest.raises(ValueError):
        errors.named("other")
    assert errors.named(errors.warn_and_continue) == "skip" and errors.named(errors.reraise) == "fail"


def test_rescaler(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 255, None), (3, None, 51), (4, None, None), (5, 1, 1)], "id int, a int, b int")
    with errors.on_error("skip"):
        got = {r.id: (r.a, r.b) for r in Rescaler(["a", "b"], isfloat=False).apply(df).collect()}
    assert got == {1: (-1.0, None), 2: (1.0, None), 3: (None, 51 / 127.5 - 1)}
    got = {r.id: (r.a, r.b) for r in Rescaler(["a", "b"], isfloat=False, strict=False).apply(df).collect()}
    assert got[4] == (None, None) and got[5] == (1.0, 1.0)
    arrays = spark.createDataFrame([([0.0, 0.5, 1.0],)], "x array<float>")
    assert Rescaler("x").apply(arrays).first().x == [-1.0, 0.0, 1.0]
    with pytest.warns(UserWarning):
        assert Rescaler("gone", strict=False).apply(df).count() == 5


@pytest.mark.parametrize(("h", "w"), [(6, 9), (9, 6), (5, 5)])
def test_crop(spark, h, w):
    x = image(1, h, w).transpose(2, 0, 1).astype(float)
    rows = [(f"k{i}", {"height": h * 2, "width": w * 2}, (list(x.shape), x.ravel().tolist())) for i in range(20)]
    df = spark.createDataFrame(rows, f"__key__ string, json struct<height:int,width:int>, jpg {tensors.TENSOR}")
    got = AddOriginalImageSizeAsTupleAndCropToSquare("height", "width").apply(df).collect()
    n, places = min(h, w), set()
    for r in got:
        top, left = r.crop_coords_top_left
        places.add((top, left))
        assert r.original_size_as_tuple == [h * 2, w * 2] and 0 <= top <= h - n and 0 <= left <= w - n
        assert (np.reshape(r.jpg.data, r.jpg.shape) == x[:, top : top + n, left : left + n]).all()
    assert len(places) > 1 or h == w


def test_crop_needs_channels(spark):
    df = spark.createDataFrame([("k", {"height": 1, "width": 1}, ([4, 1, 1], [0.0] * 4))], f"__key__ string, json struct<height:int,width:int>, jpg {tensors.TENSOR}")
    with pytest.raises(Exception, match="channels"):
        AddOriginalImageSizeAsTupleAndCropToSquare("height", "width").apply(df).collect()


def test_images(spark):
    x = image(3, 10, 20)
    df = spark.createDataFrame([("a", bytearray(png(x))), ("b", None)], "__url__ string, raw binary").withColumn("jpg", tensors.image_udf(F.col("raw")))
    assert (np.reshape(df.first().jpg.data, df.first().jpg.shape) == x).all()
    steps = [{"target": "x.y.Resize", "params": {"size": 5, "interpolation": 3}}, "ToTensor"]
    got = ImageTransforms(steps).apply(df).collect()
    assert len(got) == 1 and got[0].jpg.shape == [3, 5, 10] and 0 <= min(got[0].jpg.data) <= max(got[0].jpg.data) <= 1
    assert ImageTransforms(steps, strict=False).apply(df).count() == 2
    with pytest.raises(ValueError):
        ImageTransforms("Unknown")


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png(c):
    x = image(c, 7, 5, c)
    assert (tensors.decode_image(png(x)) == x).all()


def test_other_formats():
    x = image(2, 3, 4)
    assert (tensors.decode_image(b"P6 4 3 255\n" + x.tobytes()) == x).all()
    with pytest.raises((ValueError, RuntimeError)):
        tensors.decode_image(b"\xff\xd8\xff")


def test_resize_keeps_flat_colour_and_means():
    flat = np.full((12, 8, 3), 77.0)
    assert (tensors.resize(4, 3)(flat) == 77).all()
    assert tensors.resize((5, 9))(flat).shape == (5, 9, 3)
    x = image(5, 40, 40).astype(float)
    assert abs(tensors.resize(10)(x).mean() - x.mean()) < 1.5


@settings(deadline=None, max_examples=50)
@given(st.integers(1, 3), st.integers(1, 3), st.integers(1, 3), st.integers(1, 3))
def test_patterns(b, h, p, c):
    x = np.arange(b * h * p * c, dtype=float).reshape(b, h * p, c)
    out = tensors.einops("b (h p) c -> b h (c p)", sizes={"p": p})(x)
    for i in np.ndindex(b, h, p, c):
        assert out[i[0], i[1], i[3] * p + i[2]] == x[i[0], i[1] * p + i[2], i[3]]
    assert np.allclose(tensors.einops("b n c -> b c", "reduce", "max")(x), x.max(1))
    assert (tensors.einops("b n c -> b n r c", "repeat", sizes={"r": 2})(x)[:, :, 1] == x).all()


@pytest.mark.parametrize("how", [("a b -> a", "rearrange"), ("a -> a b", "rearrange"), ("a -> a b", "repeat"), ("a a -> a", "rearrange"), ("a b", "rearrange"), ("a -> a", "other")])
def test_bad_patterns(how):
    with pytest.raises(ValueError):
        tensors.einops(*how)


def test_batches(spark):
    df = spark.createDataFrame([(w, k, k if k != 9 else None, ([2], [float(k), 0.0])) for w in range(3) for k in range(10 + w)], f"worker int, k int, v int, x {tensors.TENSOR}")
    got = batching.batched(df.repartition(5), 4, ["k"]).collect()
    assert sorted((r.worker, r.batch) for r in got) == [(w, b) for w in range(3) for b in range((10 + w) // 4)]
    for r in got:
        want = [4 * r.batch + k for k in range(4)]
        assert r.k == want and r.x.shape == [4, 2] and r.x.data == [y for k in want for y in (float(k), 0.0)]
        assert (r.v is None) == (9 in want)
    tail = batching.batched(df, 4, ["k"], partial=True).collect()
    assert sum(r.batch_size for r in tail) == 33
    assert "k" not in batching.batched(df, 4, ["k"], combine_scalars=False).columns
    own = batching.batched(df, 4, ["k"], collation=lambda d, by, cols: d.groupBy(*by).count())
    assert {r["count"] for r in own.collect()} == {4}
    with pytest.raises(ValueError):
        batching.batched(df, 0, ["k"])
    out = BatchedEinopsTransform("b d -> d b", "x").apply(batching.batched(df, 4, ["k"])).first()
    assert out.x.shape == [2, 4]


def test_unequal_tensors_fail(spark):
    df = spark.createDataFrame([(1, ([1], [0.0])), (2, ([2], [0.0, 1.0]))], f"k int, x {tensors.TENSOR}")
    with pytest.raises(Exception, match="unequal"):
        batching.batched(df, 2, ["k"], worker=None).collect()


def test_members_and_sidecars(spark):
    rows = [("s", "s/a.txt", 0, b"1"), ("s", "s/b.txt", 1, b"2"), ("s", "s/a.json", 2, b"3"), ("s", "s/a.txt", 3, b"4"), ("t", "t/d/a.seg.png", 0, b"5")]
    members = spark.createDataFrame([(s, m, p, bytearray(c)) for s, m, p, c in rows], "shard string, member string, pos int, content binary")
    got = {(r.shard, r["__key__"]): r for r in samples.assemble(members).collect()}
    assert {k: {f: bytes(v) for f, v in r.fields.items()} for k, r in got.items()} == {("s", "a"): {"txt": b"4", "json": b"3"}, ("s", "b"): {"txt": b"2"}, ("t", "a"): {"seg.png": b"5"}}
    assert got["t", "a"]["__url__"] == "t/d"
    assert samples.assemble(members, "global").count() == 2
    main = spark.createDataFrame([("x", "1", {"json": b"a", "seg.png": b"b"}), ("x", "2", {"json": b"a"})], "shard_key string, __key__ string, fields map<string,binary>")
    meta = spark.createDataFrame([("x", "1", {"json": b"c", "png": b"d", "edge.png": b"e", "npy": b"f"})], "shard_key string, __key__ string, fields map<string,binary>")
    got = samples.join_sidecar(main, meta, "flow").collect()
    assert len(got) == 1 and sorted(got[0].fields) == ["edgeflow.png", "flow.json", "flow.png", "json", "npy", "seg.png"]
    with pytest.raises(Exception, match="no sidecar"):
        samples.join_sidecar(main, meta, "flow", on_missing="error").collect()


def test_decoding(spark):
    import gzip

    rows = [({"json": json.dumps({"h": 3}).encode(), "cls": b"7", "txt.gz": gzip.compress("süß".encode()), "raw": b"\x00", "_note": b"n"},), ({"json": b"{bad", "cls": b"x"},)]
    df = spark.createDataFrame(rows, "fields map<string,binary>")
    names = ["json", "cls", "txt.gz", "raw", "_note"]
    got = decode.decode(df, names).withColumn("h", F.try_variant_get("json", "$.h", "int")).drop("json").collect()
    assert (got[0].h, got[0].cls, got[0]["txt.gz"], bytes(got[0].raw), got[0]["_note"]) == (3, 7, "süß", b"\x00", "n")
    assert (got[1].h, got[1].cls, got[1].raw) == (None, None, None)
    assert decode.decode(df, names, only="cls").columns == ["cls", "_note"]
    assert dict(decode.decode(df, names, passthrough=["cls"]).dtypes)["cls"] == "binary"
    with errors.on_error("skip"):
        assert decode.decode(df, ["cls"], strict=True).count() == 1
    assert decode.handlers_of(None) is None and decode.handlers_of([]) is None
    with pytest.raises(ValueError):
        decode.handlers_of("unknown")
    with pytest.raises(TypeError):
        decode.handlers_of([3])


def test_time_limit_and_timing(monkeypatch):
    assert errors.limited(lambda x: x + 1, 5)(1) == 2
    with pytest.raises(errors.CallTimeout):
        errors.limited(time.sleep, 0.05)(2)
    with pytest.raises(KeyError):
        errors.limited(lambda: {}["x"], 5)()


def slow(v):
    time.sleep(v)
    return int(10 * v)


def test_python_functions_of_values(spark, monkeypatch):
    df = spark.createDataFrame([(0.0, "a"), (0.1, "b"), (9.0, "c"), (None, "d")], "x double, __url__ string")
    with errors.on_error("mark"):
        got = {r["__url__"]: r for r in LambdaMapper("x", slow, returns="int", timeout=1.0).apply(df).collect()}
    assert (got["a"].x, got["b"].x, got["c"].x) == (0, 1, None)
    assert "CallTimeout" in got["c"]._error and "KeyError: x" in got["d"]._error and got["a"]._error is None
    monkeypatch.setenv("SAMPLE_CALL_SECONDS", "1")
    monkeypatch.setenv("SAMPLE_PROFILE", "1")
    with errors.on_error("skip"):
        out = LambdaMapper("x", slow, returns="int").apply(df).collect()
    assert sorted(r["__url__"] for r in out) == ["a", "b"] and max(r["LambdaMapper-time"] for r in out) >= 0.1
    kept = LambdaMapper("x", slow, returns="double", exclude_keys=["c", "d"]).apply(df.filter("x is not null")).collect()
    assert {r["__url__"]: r.x for r in kept} == {"a": 0.0, "b": 1.0, "c": 9.0}
    assert keys(LambdaFilter("x", lambda v: v < 1, python=True).apply(df.filter("x is not null"))) == ["a", "b"]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        LambdaFilter("x", lambda v: 1 / v > 0, python=True).apply(df.filter("x is not null")).collect()


def test_a_call_costs_no_thread_and_is_made_once(spark, tmp_path, monkeypatch):
    """Threads grow with calls that are given up, not with calls; a filter on errors repeats none."""
    begun, start = [], threading.Thread.start
    monkeypatch.setattr(threading.Thread, "start", lambda self: (begun.append(1), start(self))[1])
    values, problems, times = errors._called(slow, [0.0] * 500 + [9.0] + [0.01] * 3 + ["x"], 0.5)
    assert values == [0] * 500 + [None] + [0] * 3 + [None] and len(begun) == 2 and times[500] >= 0.5 > max(times[:500])
    assert problems[500].startswith("CallTimeout: slow took over 0.5 s") and problems[-1].startswith("TypeError") and not any(problems[:500])
    assert errors._called(slow, [], 1.0) == ([], [], []) == errors._called(slow, [], None)
    with pytest.raises(SystemExit):
        errors._called(sys.exit, [3], 1.0)
    with errors.on_error("skip"):
        out = LambdaMapper("x", lambda v: int(v), returns="int", timeout=30.0).apply(spark.range(10).selectExpr("cast(id as string) x"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_broken_images_are_null_and_unknown_formats_an_error(spark):
    good = png(image(1, 4, 5))
    df = spark.createDataFrame([(1, {"png": good}), (2, {"png": good[:60]}), (3, {"png": b"P6 x"})], "id int, fields map<string,binary>")
    got = {r.id: r.png for r in decode.decode(df, ["png"], "rgb8").collect()}
    assert got[1].shape == [4, 5, 3] and got[2] is None and got[3] is None
    with errors.on_error("skip"):
        assert decode.decode(df, ["png"], "rgb8", strict=True).count() == 1
