"""The entry point without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from evgraph import storage

ROOT = Path(__file__).resolve().parents[2]
SAY = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def _copy(to: Path) -> None:
    shutil.copy(ROOT / "__spark_entry__.py", to)
    shutil.copytree(ROOT / "evgraph", to / "evgraph", ignore=shutil.ignore_patterns("__pycache__"))


def _says(at: Path) -> str:
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=at, env={"PYTHONPATH": str(at), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.strip()


def test_entry_imports_without_the_subpackage(tmp_path):
    _copy(tmp_path)
    shutil.rmtree(tmp_path / "evgraph" / "llm", ignore_errors=True)
    count, some = _says(tmp_path).split()
    assert int(count) >= 80 and some == "False"


def test_entry_imports_with_the_pipeline_left_behind(tmp_path):
    _copy(tmp_path)
    shutil.rmtree(tmp_path / "evgraph" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").write_text("from evgraph.llm import mixing\n")
    assert _says(tmp_path).split()[1] == "False"


def test_entry_imports_with_a_subpackage_that_cannot_be_imported(tmp_path):
    _copy(tmp_path)
    (tmp_path / "evgraph" / "llm").mkdir(exist_ok=True)
    (tmp_path / "evgraph" / "llm" / "__init__.py").write_text("")
    (tmp_path / "evgraph" / "llm" / "queries.py").write_text("import a_module_that_is_not_installed\n")
    assert _says(tmp_path).split()[1] == "False"


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Held:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class No:
                            @staticmethod
                            def isDefined():  # noqa: N802
                                return False

                        return No

                return Held

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
