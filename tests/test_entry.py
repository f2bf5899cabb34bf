import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_of_the_library_has_sql():
    own = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(entry.oracle_sql()) and len(own) >= 50


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "dayroll", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "dayroll").mkdir()
    for p in (ROOT / "dayroll").iterdir():
        if p.name != "llm":
            (tmp_path / "dayroll" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
