"""Every query gives what its SQL gives on the same tables."""

import duckdb
import numpy as np
import pytest

from shardloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert got == want


def test_means_have_the_sign_of_their_sql(spark, tmp_path):
    """A mean that rounds to zero from below is -0.0 in SQL."""
    rows = [(k, [x] * 64, 1) for k, x in enumerate([-1e-8, 1e-8, 0.0, -0.0, -0.25, 0.1234565, -0.1234565, -4.9e-7, 5.1e-7, -5.1e-7, -1.0, 1.0, 4.9e-7, 3e5, -3e5, 2.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    (got,) = QUERIES["einops_reduce_mean"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    (want,) = con.execute(SQL["einops_reduce_mean"]).fetchall()
    assert str(got["means"]) == str(want[2])


def test_shards_stay_small(spark, duck, monkeypatch):
    """More documents make more shards, not larger ones; what is read is the same."""
    from pathlib import Path

    from shardloom import queries

    monkeypatch.setattr(queries, "SHARD_BYTES", 20_000, raising=False)
    queries._shards.cache_clear()
    sizes = [p.stat().st_size for p in Path(queries._shards(spark, DIR)).rglob("*.tar")]
    assert len(sizes) > 16 and max(sizes) < 80_000 < sum(sizes)
    for name in ("tar_members", "tar_dataset", "tar_sidecar", "loader_rows", "tar_key_and_class"):
        test_query(spark, duck, name)
    queries._shards.cache_clear()


def test_entry_works_without_the_subpackage(tmp_path):
    """The driver may take the subpackage away; the rest goes on."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/shardloom", tmp_path / "shardloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_tells_what_is_missing_within_the_subpackage(tmp_path):
    """Only a missing subpackage is passed over."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/shardloom", tmp_path / "shardloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
