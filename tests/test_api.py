import itertools
import os

import numpy as np
import pytest

import shardloom.plans.config as config
from shardloom.api import create_dataset, create_dummy_dataset, create_loader
from shardloom.operators.filters import SimpleKeyFilter, SimpleSizeFilter
from shardloom.operators.mappers import AddOriginalImageSizeAsTupleAndCropToSquare, ImageTransforms, LambdaMapper, Rescaler
from shardloom.sources.tarshards import assemble, last_places, members, read_tars
from shardloom.streaming.arrivals import arriving, processed, write_batches
from tests.tars import dataset, image, write_tar

DECODED = {"decoders": ["rgb8"], "fields": ["png", "json", "txt", "cls"]}


def test_members(spark, tmp_path):
    path = write_tar(tmp_path / "s.tar", [("d/", None), ("d/000.txt", b"1"), ("./001.a.b", b"2")])
    got = read_tars(spark, [path]).collect()
    assert [(r.member.removeprefix(path), bytes(r.content)) for r in got] == [("/d/000.txt", b"1"), ("/001.a.b", b"2")]
    assert read_tars(spark, [path], fields=["txt"]).count() == 1
    assert read_tars(spark, []).count() == 0


def test_broken_shards(spark, tmp_path):
    good = write_tar(tmp_path / "good.tar", [(f"{k}.txt", b"x" * 3000) for k in range(9)])
    empty = write_tar(tmp_path / "empty.tar", [])
    for name, data in (("cut.tar", open(good, "rb").read()[:9000]), ("odd.tar", b"no tar at all" * 200)):
        (tmp_path / name).write_bytes(data)
    assert read_tars(spark, [empty]).count() == 0
    paths = [good, empty, str(tmp_path / "cut.tar"), str(tmp_path / "odd.tar")]
    got = read_tars(spark, paths, on_error="skip").collect()
    assert sum(r.error is not None for r in got) == 2
    assert sum(r.shard.endswith("cut.tar") and r.error is None for r in got) == 2
    with pytest.raises(Exception, match=".+"):
        read_tars(spark, paths).collect()


def test_dataset(spark, tmp_path):
    url = dataset(tmp_path)
    got = create_dataset(url, **DECODED, preprocessors=[SimpleKeyFilter("cls")]).frame().collect()
    assert len(got) == 12
    by_key = {r["__key__"]: r for r in got}
    assert (np.reshape(by_key["102"].png.data, by_key["102"].png.shape) == image(102, 10, 10)).all()
    assert by_key["003"].txt == "sample 003" and by_key["003"].cls == 3
    assert create_dataset(url, decoders=None).frame().columns.count("fields") == 1
    found = create_dataset(url, decoders=["rgb8"]).frame()
    assert {"png", "json", "txt", "cls"} <= set(found.columns)


def test_too_many_fields_are_an_error(spark, tmp_path, monkeypatch):
    path = write_tar(tmp_path / "s.tar", [(f"000.f{k}", b"1") for k in range(4)])
    monkeypatch.setattr("shardloom.api.MOST_FIELDS", 3, raising=False)
    with pytest.raises(ValueError, match="more than 3 different fields"):
        create_dataset(path, decoders=["rgb8"]).frame()
    monkeypatch.setattr("shardloom.api.MOST_FIELDS", 4)
    assert {f"f{k}" for k in range(4)} <= set(create_dataset(path, decoders=["rgb8"]).frame().columns)


def test_sidecar_dataset(spark, tmp_path):
    url = dataset(tmp_path)
    got = create_dataset(url, {"meta_urls": "flow"}, decoders=None).frame().collect()
    assert sorted(r["__key__"] for r in got) == ["001", "002", "003", "100", "101", "102", "103"]
    assert all(sorted(r.fields) == ["cls", "flow.json", "json", "npy", "png", "txt"] for r in got)


def test_example(spark, tmp_path):
    """The usual chain: size filter, image transforms, rescaling, crop, batches."""
    url = dataset(tmp_path)
    post = [ImageTransforms([{"target": "Resize", "params": {"size": 6, "interpolation": 3}}, "ToTensor"], key="png"), Rescaler("png"), AddOriginalImageSizeAsTupleAndCropToSquare("height", "width", image_key="png")]
    data = create_dataset(url, {"shardshuffle": 100, "sample_shuffle": 10, "repeat": 1}, postprocessors=post, **DECODED)
    rows = list(create_loader(data, 2, num_workers=2, loader_kwargs={"as_numpy": True}))
    assert rows and all(r["png"].shape == (2, 3, 6, 6) for r in rows)
    assert all(-1 <= r["png"].min() <= r["png"].max() <= 1 for r in rows)
    assert all(len(r["txt"]) == 2 and np.shape(r["crop_coords_top_left"]) == (2, 2) for r in rows)
    keys = [k for r in rows for k in r["__key__"]]
    assert len(set(keys)) == len(keys) == 12


def test_order_epochs_and_seeds(spark, tmp_path):
    url = dataset(tmp_path)
    take = lambda **p: [r["__key__"] for r in itertools.islice(iter(create_dataset(url, p, decoders=None)), 24)]
    one = take(repeat=2, sample_shuffle=100)
    assert sorted(one[:12]) == sorted(one[12:]) and one[:12] != one[12:]
    assert one == take(repeat=2, sample_shuffle=100) != take(repeat=2, sample_shuffle=100, seed=5)
    assert len(take()) == 24  # without end
    plain = take(repeat=1, shardshuffle=1)
    assert plain == sorted(plain)


def test_ranks_and_workers_share_the_shards(spark, tmp_path):
    url = dataset(tmp_path, shards=6)
    keys = [sorted(r["__key__"] for r in create_dataset(url, {"world_size": 2, "rank": k}, decoders=None).frame().collect()) for k in range(2)]
    assert not set(keys[0]) & set(keys[1]) and len(keys[0] + keys[1]) == 24
    all_ = create_dataset(url, {"split_data_by_worker": False, "num_workers": 3}, decoders=None).frame()
    assert all_.count() == 72


def test_resampling_dataset(spark, tmp_path):
    roots = []
    for name in "ab":
        for k in range(6):
            write_tar(tmp_path / name / f"{k}.tar", [(f"{name}{k}.txt", b"x")])
        roots.append(str(tmp_path / name))
    got = create_dataset(roots, {"resample_prefixes": True, "prefix_probs": [0.8, 0.2]}, decoders=None).frame().collect()
    assert 0 < len(got) <= 12
    with pytest.raises(ValueError):
        create_dataset([roots[0], roots[0] + "b"], {"resample_prefixes": True}, decoders=None)


def test_configuration_only(spark, tmp_path):
    url = dataset(tmp_path)
    settings = {"urls": [url], "pipeline_config": {"repeat": 1}, "decoders": "rgb8", "fields": ["txt", "cls"], "preprocessors": [{"target": "shardloom.operators.filters.SimpleKeyFilter", "params": {"keys": "cls"}}]}
    before = str(settings)
    loader = create_loader({"target": "dataset", "params": settings}, 5, partial=True)
    assert sum(r["batch_size"] for r in loader) == 12
    assert str(settings) == before
    bad = {"preprocessors": [print]}, {"decoders": "odd"}, {"pipeline_config": {"odd": 1}}, {"preprocessors": [{"params": {}}]}
    for odd, kind in zip(bad, (TypeError, ValueError, TypeError, KeyError), strict=True):
        with pytest.raises(kind):
            create_dataset(**(settings | odd))
    assert config.is_config(settings)


def test_error_policies(spark, tmp_path):
    url = dataset(tmp_path)
    write_tar(tmp_path / "ds" / "9.tar", [("900.txt", b"no class")])
    step = {"postprocessors": [LambdaMapper("cls", lambda c: c + 1)], "fields": ["cls", "txt"]}
    assert create_dataset(url, **step).frame().count() == 12
    with pytest.raises(Exception, match="KeyError"):
        create_dataset(url, **step, error_handler="fail").frame().collect()
    marked = create_dataset(url, **step, error_handler="mark").frame()
    assert marked.filter("_error is not null").count() == 1


def test_dummy(spark, tmp_path):
    got = create_dummy_dataset(50, urls=dataset(tmp_path), pipeline_config={"shardshuffle": 1}, decoders=None).collect()
    assert {r["__key__"] for r in got} == {"000"} and sorted(r["copy"] for r in got) == list(range(50))


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("id", "cast(id as int) h", "'u' __url__").repartition(4).write.parquet(source)
    stream = processed(arriving(spark, source, "id long, h int, __url__ string"), [SimpleSizeFilter(50, strict=True, height_key="h", width_key="h")])
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), 8, ["id"]).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(i for r in got for i in r.id) == list(range(50, 100))


def test_loader_writes(spark, tmp_path):
    loader = create_loader(create_dataset(dataset(tmp_path), {"repeat": 1}, decoders=["txt"], fields=["txt"]), 3, partial=True)
    loader.write(str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out") and spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_exports():
    import shardloom

    assert shardloom.create_dataset is create_dataset and shardloom.filters.SimpleKeyFilter is SimpleKeyFilter
    assert shardloom.mappers.Rescaler is Rescaler and shardloom.warn_and_continue("going on") is True
    with pytest.raises(AttributeError):
        shardloom.nothing


def test_broken_shards_are_marked(spark, tmp_path):
    url = dataset(tmp_path)
    (tmp_path / "ds" / "7.tar").write_bytes(b"no tar at all" * 200)
    marked = create_dataset(url, decoders=["txt"], fields=["txt"], error_handler="mark").frame().collect()
    assert [r["shard"].endswith("7.tar") for r in marked if r["_error"]] == [True] and len(marked) == 13
    assert create_dataset(url, decoders=["txt"], fields=["txt"]).frame().count() == 12
    with pytest.raises(Exception, match="ReadError|truncated|header"):
        create_dataset(url, decoders=["txt"], fields=["txt"], error_handler="fail").frame().collect()


def test_fields_that_cannot_be_decoded_go_by_the_policy(spark, tmp_path):
    path = write_tar(tmp_path / "s.tar", [("0.cls", b"1"), ("1.cls", b"one")])
    assert create_dataset(path, decoders=["cls"], fields=["cls"]).frame().count() == 1
    assert create_dataset(path, decoders=["cls"], fields=["cls"], error_handler="mark").frame().filter("_error is not null").count() == 1
    with pytest.raises(Exception, match="can't be decoded"):
        create_dataset(path, decoders=["cls"], fields=["cls"], error_handler="fail").frame().collect()


def test_only_asked_fields_are_read(spark, tmp_path):
    url = dataset(tmp_path)
    data = create_dataset(url, decoders=["txt"], fields=["txt"], preprocessors=[SimpleKeyFilter("cls")])
    assert data._read() == ["cls", "txt"]
    assert {tuple(sorted(r.fields)) for r in data.raw().collect()} == {("cls", "txt")}
    none = create_dataset(url, decoders=["txt"], fields=["odd"])
    assert none.frame().count() == 12  # a sample without the field is still one


def test_samples_go_as_soon_as_they_are_whole():
    seen = []

    def rows():
        for pos, name in enumerate(["a.x", "b.x", "a.y", "c.x", "b.y", "c.x"]):
            seen.append(pos)
            yield f"/s.tar/{name}", pos, b"%d" % pos

    last = last_places(iter([(f"/s.tar/{n}", k, None) for k, n in enumerate(["a.x", "b.x", "a.y", "c.x", "b.y", "c.x"])]))
    out = assemble(rows(), last)
    assert next(out)[0] == "a" and len(seen) == 3
    assert next(out) == ("b", "/s.tar", 1, {"x": b"1", "y": b"4"}) and len(seen) == 5
    assert next(out) == ("c", "/s.tar", 3, {"x": b"5"})


def test_a_large_shard_is_read_sample_by_sample(tmp_path):
    import tracemalloc

    path = write_tar(tmp_path / "s.tar", [(f"{k}.{f}", bytes(200_000)) for k in range(100) for f in ("x", "y")])
    tracemalloc.start()
    n = sum(1 for _ in assemble(members(path), last_places(members(path, content=False))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100 and peak < 5_000_000 < os.path.getsize(path)


def test_settings_without_effect_are_warned_of(spark, tmp_path):
    with pytest.warns(UserWarning, match="n_shards has no effect"):
        create_dataset(dataset(tmp_path), {"n_shards": 5}, decoders=None)
