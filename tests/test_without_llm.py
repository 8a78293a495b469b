"""The rest of the library with the optional training-data part removed."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
from sparklayout import registry
from sparklayout.sources.session import local_session
assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(registry.oracle_sql())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert e.entry(local_session(2, partitions=2, memory="2g")).count() > 0
"""


def test_the_rest_runs_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "sparklayout", tmp_path / "sparklayout", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={"PATH": "/usr/bin:/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}})
    assert run.returncode == 0, run.stderr[-2000:]


def test_nothing_imports_the_llm_folder():
    for path in (ROOT / "sparklayout").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sparklayout.llm" not in path.read_text(), path


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from sparklayout.sources.work import work_dir

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert work_dir(Session(**{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077", ""):
        with pytest.raises(RuntimeError):
            work_dir(Session(**{"spark.master": master}))
