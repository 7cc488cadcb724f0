"""Grid-shape rules of the block grid and the worker-shipping contract."""

import os
import subprocess
import sys

from tests.conftest import ROOT
from verdict.operators.topk import block_counts


def test_small_side_is_one_block():
    qb, cb = block_counts(200, 10_000, 8, 250_000, 250_000)
    assert qb == 1 and cb >= 8


def test_replication_grows_like_sqrt_cells():
    n = 100_000_000
    qb, cb = block_counts(n, n, 4000, 250_000, 250_000)
    # every block fits the budget ...
    assert n / qb <= 250_000 and n / cb <= 250_000
    # ... and the replication factors stay near sqrt(cells), far below n / 4096
    assert qb == cb and qb * cb >= 8000 and qb < 1000


def test_shape_minimises_shuffle_volume():
    nq, nc, par = 50_000, 5_000_000, 64
    qb, cb = block_counts(nq, nc, par, 10**9, 10**9)
    best = min(nq * c + nc * q for q in range(1, 200) for c in range(1, 2000) if q * c >= 2 * par)
    assert nq * cb + nc * qb <= 1.1 * best


def test_queries_run_from_another_directory():
    code = (
        "import importlib.util;"
        f"spec=importlib.util.spec_from_file_location('e', '{ROOT}/__spark_entry__.py');"
        "m=importlib.util.module_from_spec(spec);spec.loader.exec_module(m);"
        "from pyspark.sql import SparkSession;"
        "s=SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate();"
        "print('ROWS', m.queries()['vector_topk'](s, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 2500" in out.stdout, out.stderr[-2000:]
