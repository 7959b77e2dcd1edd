"""The entry points work without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False], ids=["pipeline left", "pipeline gone"])
def test_entry_without_optional_subpackage(tmp_path, pipeline):
    shutil.copytree(
        f"{ROOT}/quantframe", tmp_path / "quantframe", ignore=shutil.ignore_patterns("llm", "__pycache__")
    )
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = (
        "import __spark_entry__ as e; from quantframe.catalog import load_all;"
        "assert set(e.queries()) == set(load_all()); assert e.oracle_sql()"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr


def test_a_broken_subpackage_is_not_hidden(monkeypatch):
    import importlib

    import __spark_entry__ as contract

    def broken(name):
        raise ModuleNotFoundError("No module named 'elsewhere'", name="elsewhere")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        contract.queries()
