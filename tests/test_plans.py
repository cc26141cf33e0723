import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.functions.ordering import local_draw
from shardloom.functions.paths import field_name, sample_key, shard_key, sidecar_key
from shardloom.plans import braces, config, manifest
from tests.tars import dataset, write_tar


@pytest.mark.parametrize(
    ("spec", "want"),
    [("a-{0..2}", ["a-0", "a-1", "a-2"]), ("{08..11}.tar", ["08.tar", "09.tar", "10.tar", "11.tar"]), ("{0..10}", [str(k) for k in range(11)]), ("{0..1}{2..3}", ["02", "03", "12", "13"]), ("plain.tar", ["plain.tar"])],
)
def test_ranges(spec, want):
    assert braces.expand(spec) == want


@pytest.mark.parametrize("spec", ["{3..3}", "{10..9}", "{01..100}", "{100..99}", "{100..20}"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        braces.expand(spec)


@settings(deadline=None)
@given(st.integers(0, 500), st.integers(1, 40), st.integers(0, 5))
def test_ranges_against_counting(low, n, pad):
    high = low + n
    width = len(str(high)) + pad
    assert braces.expand(f"x{{{low:0{width}d}..{high:0{width}d}}}y") == [f"x{k:0{width}d}y" if pad or len(str(low)) < len(str(high)) or str(low)[0] == "0" else f"x{k}y" for k in range(low, high + 1)]


def test_one_range_in_all_urls_or_none():
    assert not braces.check(["a", "b"]) and braces.check(["a{0..1}", "b{2..3}"])
    for bad in (["a", "b{0..1}"], ["a{0..1}{0..1}"], ["a{0..1"], ["a{x..y}"]):
        with pytest.raises(ValueError):
            braces.check(bad)


def test_listing(spark, tmp_path):
    write_tar(tmp_path / "a" / "x.tar", [])
    write_tar(tmp_path / "a" / "in" / "y.tar", [])
    for name in ("z.TAR", "z.tar.gz", "z.txt"):
        (tmp_path / "a" / name).write_bytes(b"")
    write_tar(tmp_path / "b" / "w.tar", [])
    got = manifest.list_shards(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).orderBy("listed").collect()
    assert [r.path.removeprefix(str(tmp_path)) for r in got] == ["/b/w.tar", "/a/in/y.tar", "/a/x.tar"]
    only = manifest.list_shards(spark, str(tmp_path / "a"), lambda p: F.contains(p, F.lit("/in/")))
    assert only.count() == 1
    for bad in (7, ["a", 7]):
        with pytest.raises(TypeError):
            manifest.list_shards(spark, bad)


def test_sidecars(spark, tmp_path):
    url = dataset(tmp_path)
    assert manifest.sidecar_url("/d/ds", "flow") == "/d_flow/ds" and manifest.sidecar_url("/d/ds/", "flow") == "/d/ds_flow/"
    main = manifest.as_manifest(manifest.list_shards(spark, url))
    got = manifest.with_sidecars(spark, main, url, ["flow"]).collect()
    assert sorted(r.paths[1].removeprefix(str(tmp_path)) for r in got) == ["/ds_flow/0000.tar", "/ds_flow/0001.tar"]


def test_names(spark):
    rows = [("/d/ds_flow/0000.tar", "/d/ds/0000"), ("/d.x/.hidden", "/d.x/.hidden"), ("/a.b/c", "/a.b/c"), ("x/y.tar.gz", "x/y.tar")]
    got = spark.createDataFrame(rows, "p string, want string").select(sidecar_key("p", "flow").alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)
    rows = [("/t.tar/a/000.seg.png", "000", "seg.png"), ("4.mp4", "4", "mp4"), ("noext", "noext", "")]
    got = spark.createDataFrame(rows, "p string, k string, f string").select(sample_key("p").alias("k1"), "k", field_name("p").alias("f1"), "f").collect()
    assert all(r.k1 == r.k and r.f1 == r.f for r in got)
    assert spark.sql("select '/a/b.c/d.tar' p").select(shard_key("p")).first()[0] == "/a/b.c/d"


def test_splits_are_a_partition(spark):
    df = manifest.shuffled(spark.range(50).withColumnRenamed("id", "shard_key"), 3)
    got = manifest.for_workers(manifest.for_rank(df, 4), 3).collect()
    assert sorted(r.shard_key for r in got) == list(range(50))
    seen = {(r.rank, r.worker) for r in got}
    assert seen == set(itertools.product(range(4), range(3)))
    for rank in range(4):
        assert sorted(r.pos for r in got if r.rank == rank) == list(range(sum(r.rank == rank for r in got)))
    again = manifest.shuffled(df.repartition(7), 3).collect()
    assert {(r.shard_key, r.pos) for r in again} == {(r.shard_key, r.pos) for r in df.collect()}
    every = manifest.for_every_worker(df, 3, 1).collect()
    orders = [[r.shard_key for r in sorted(every, key=lambda r: r.pos) if r.worker == w] for w in range(3)]
    assert all(sorted(o) == list(range(50)) for o in orders) and orders[0] != orders[1]
    with pytest.raises(ValueError):
        manifest.repeated(df, 0)


def test_resampling_against_the_rules():
    rng = random.Random(1)
    for turn in range(200):
        names, shares = ["a", "b", "c"], [rng.random() + 0.01 for _ in range(3)]
        arrivals = [rng.choice(names) for _ in range(rng.randint(0, 40))]
        queues, out, k, want = {n: [] for n in names}, [], 0, None
        for i, name in enumerate(arrivals):
            if want is None:
                x, acc = local_draw(turn, "draw", k), 0.0
                for n, s in zip(names, shares, strict=True):
                    acc += s / sum(shares)
                    want = n
                    if x < acc:
                        break
                k += 1
            queues[name].append(i)
            if name == want:
                out.append(queues[name].pop(0))
                want = None
        assert manifest.emissions(arrivals, names, shares, turn) == out


def test_resampling_checks(spark):
    df = spark.createDataFrame([("a1", "a"), ("b1", "b")], "shard_key string, prefix string")
    for names, shares in ((["a"], None), (["a", "b"], [1.0]), (["a", "a"], None), (["a", "b"], [0, 0]), (["a", "b"], [-1, 2])):
        with pytest.raises(ValueError):
            manifest.resampled(df, names, shares)
    assert manifest.ambiguous(["/a", "/ab"]) and not manifest.ambiguous(["/a/", "/ab/"])
    assert manifest.resampled(df, ["a", "b"]).count() >= 1


def test_configurations():
    config.register("plus", lambda a, b=1: a + b)
    assert config.instantiate({"target": "plus", "params": {"a": 2}}) == 3
    assert config.make_callable({"target": "plus", "params": {"a": 2}})(b=5) == 7
    assert config.instantiate("__is_first_stage__") is None
    assert config.find("shardloom.plans.braces.expand") is braces.expand
    with pytest.raises(KeyError):
        config.instantiate({"params": {}})
    with pytest.raises(KeyError):
        config.find("nothing")
    with pytest.raises(PermissionError):
        config.find("os.system")
