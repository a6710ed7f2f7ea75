"""The entry module without the folders of the language-model operators, and the shared folder."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest

from arealoom.sources import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_folders(tmp_path, pipeline):
    for name in ("arealoom", "tests", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        at = os.path.join(ROOT, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e, tests.test_areas, tests.cluster; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    n, same, piped = done.stdout.split() or [done.stderr, "", ""]
    assert int(n) > 70 and (same, piped) == ("True", "False")


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert scratch.shared_folder(session(master)).startswith("file:///tmp/")
