import ast
import os

import __spark_entry__ as entry

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id_videofile", "level", "first_frame", "last_frame"] and df.count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_operators():
    for folder, _, names in os.walk(os.path.join(TOP, "framewright")):
        if os.path.basename(folder) == "llm":
            continue
        for name in (n for n in names if n.endswith(".py")):
            for node in ast.walk(ast.parse(open(os.path.join(folder, name)).read())):
                parts = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert not any("llm" in p for p in parts), name
