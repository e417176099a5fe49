"""Every registered query of the library against its SQL, on the small tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import chains, registry, rows  # noqa: F401  chains and rows add their queries to the registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def values(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_offers_the_library(spark):
    import __spark_entry__

    assert "bm25_top10" in __spark_entry__.queries()
    assert set(registry.ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry_imports_without_the_llm_folder(tmp_path):
    top = Path(registry.__file__).parents[2]
    shutil.copytree(top / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    names, checked = (line.split() for line in said.stdout.splitlines()[-2:])
    assert set(names) == set(registry.QUERIES) and set(checked) == set(registry.ORACLE)


def _cut_pages(spark, folder):
    """Pages whose titles were cut within references, and SQL's view of them."""
    cut = ["Salt &amp; pepper &amp", "Salt &lt", "The rest of &quot", "Of &#x27", "&amp;lt; of the &amp;&#39;", "Of &am", "Of &nosuch; &eacute"]
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>The salt of the earth is in the sea, and that is &lt;all&gt; that we know of it &amp</p></article></body></html>"
    rows = [(i, f"http://host/{i}", page.format(t)) for i, t in enumerate(cut, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return con


def test_page_contents_match_sql_where_references_are_cut(spark, tmp_path):
    con = _cut_pages(spark, tmp_path)
    assert values(registry.QUERIES["page_contents"](spark, str(tmp_path)).toPandas()) == values(con.sql(registry.ORACLE["page_contents"]).df())


def test_web_documents_match_sql_where_references_are_cut(spark, tmp_path):
    con = _cut_pages(spark, tmp_path)
    assert values(registry.QUERIES["web_documents"](spark, str(tmp_path)).toPandas()) == values(con.sql(registry.ORACLE["web_documents"]).df())


def test_judgements_start_from_pools_that_are_kept(spark):
    read = registry.QUERIES["judgement_flow"](spark, SF).inputFiles()
    assert read and not any("documents.parquet" in f or "/blocks/" in f for f in read)
