"""Every module imports alone in a fresh interpreter, in any order; the benchmark runs."""
import json
import os
import pkgutil
import subprocess
import sys

import pytest

import pathweave

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MODULES = sorted(m.name for m in pkgutil.walk_packages(pathweave.__path__, "pathweave."))


def _python(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, **env}, capture_output=True, text=True)


def test_each_module_imports_alone():
    code = ("import importlib, sys\n"
            "for name in {!r}:\n"
            "    for loaded in [m for m in sys.modules if m.split('.')[0] == 'pathweave']:\n"
            "        del sys.modules[loaded]\n"
            "    importlib.import_module(name)\n").format(MODULES)
    done = _python(code)
    assert done.returncode == 0, done.stderr


def test_bench_and_entry_import_alone():
    for name in ("bench", "__spark_entry__"):
        done = _python(f"import {name}")
        assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_bench_prints_one_line_with_every_query():
    sf = "/root/testdata/sf0.001"
    done = _python("import bench; bench.main()", BENCH_SF_DIR=sf, BENCH_WARMUP_DIR="", BENCH_CPUS="4", BENCH_DRIVER_MEMORY="4g")
    assert done.returncode == 0, done.stderr[-2000:]
    line = json.loads(done.stdout.strip().splitlines()[-1])
    import bench
    assert set(line["queries"]) == set(bench.HEADLINE) and line["value"] > 0
