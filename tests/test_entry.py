import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = load_entry()
    rows = mod.entry(spark).collect()
    assert len(rows) > 0 and {"source", "n_windows", "n_stream_tokens"} <= set(rows[0].asDict())


def test_oracles_are_a_subset_of_queries():
    mod = load_entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
