"""The entry point, with and without the training-data folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "masked"] and df.count() > 0


def test_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "veilgraph"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "veilgraph/llm", ignore_errors=True)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert 'floor_mask' in q and not any(re.match(r'op[0-9]', n) or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
