"""Driver contract: entry runs, every query has a builder, oracle keys are a subset."""
import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_registry(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert set(df.columns) == {"q_id", "question", "source", "context", "prompt"}
    assert df.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
