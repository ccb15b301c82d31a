"""The library works without the text operators."""

import re
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_text_operators():
    for path in (REPO / "framelake").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_every_query_with_sql_is_registered():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
