"""Queries against their SQL on inputs that the given tables do not have."""

import pickle

import pytest

from foliant.operators import cleanup, roundtrips
from foliant.sources import datasource


def same_as_sql(df, sql, **tables):
    """tables: paths of the Parquet files that the SQL knows by name."""
    con = pytest.importorskip("duckdb").connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    got = sorted(str(tuple(r)) for r in df.select(*names).collect())
    assert got == sorted(str(tuple(r)) for r in result.fetchall())


def write(spark, path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(path))


EMPTY = ["", " ", "\n", "\n\n", "a", "Page 3", "|", "*\n*", "all rights reserved", "---\na\n---\n", "---\na\n---\n\nb", "x\n\ny", None]


def test_counts_of_texts_that_are_cleaned_away(spark, tmp_path):
    write(spark, tmp_path / "documents.parquet", EMPTY)
    same_as_sql(cleanup.queries()["text_counts"](spark, str(tmp_path)), cleanup.oracle_sql()["text_counts"], documents=tmp_path / "documents.parquet" / "*.parquet")


def test_files_of_empty_documents(spark, tmp_path):
    write(spark, tmp_path / "documents.parquet", [t for t in EMPTY if t is not None])
    same_as_sql(roundtrips.QUERIES["text_files"](spark, str(tmp_path)), roundtrips.ORACLES["text_files"], documents=tmp_path / "documents.parquet" / "*.parquet")


def test_the_driver_commits_no_names(tmp_path):
    w = datasource.OfficeWriter(str(tmp_path / "t"), True)
    done = [w.write(iter([{"path": f"{n % 3}/{'long' * 20}{n}.md", "data": "" if n % 2 else "x"} for n in range(k, k + 50)])) for k in (0, 50)]
    assert all(len(m.names) == 50 * 16 and len(pickle.dumps(m)) < 50 * 40 for m in done)
    w.commit(done)
    assert sum(p.is_file() for p in (tmp_path / "t").rglob("*")) == 100 and not list((tmp_path / "t").glob("_*"))
    again = datasource.OfficeWriter(str(tmp_path / "t"), False)
    with pytest.raises(ValueError, match="two rows"):
        again.commit([again.write(iter([{"path": "a/b", "data": "x"}])) for _ in range(2)])
