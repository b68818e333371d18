"""The driver contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["node", "msg", "score"] and df.count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('tracewell.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.corpus_registry is None and 'flagship_alerts' in e.queries() and not any(n.startswith('op') for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
