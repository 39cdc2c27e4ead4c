"""The driver's contract, with and without the subpackage for training data."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "w"
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 215


def test_imports_without_training_data(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tidegate.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 215 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
