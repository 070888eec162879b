"""Every registered query of the extraction engine against its SQL."""

import pytest
from conftest import same

from pagewright.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    same(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 50 and "price_text" in df.columns


@pytest.mark.parametrize("missing", ["pagewright.llm", "corpus_pipeline", "ahocorasick"])
def test_entry_without_corpus_operators(monkeypatch, missing):
    """A subpackage, a pipeline or a library that isn't there takes the corpus operators with it, and nothing else."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("pagewright.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())
