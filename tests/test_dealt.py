"""Packages as they are made, read and stored when there are many."""

import io
import zipfile

import pytest

from foliant.operators import slides, word
from foliant.sources import office, synth
from foliant.sources.leaves import facts_of
from foliant.sources.package import OfficeError, Package, directory


def test_packages_come_in_batches_of_bounded_size():
    got = list(synth.batches_of((str(i), bytes(1 << 20)) for i in range(20)))
    assert [b.num_rows for b in got] == [4] * 5
    assert max(b.num_rows for b in synth.batches_of((str(i), b"x") for i in range(5000))) == synth.AT_ONCE


def test_rows_of_a_key_are_one_package(spark):
    rows = spark.createDataFrame([(k, n, f"{k}.{n}") for n in range(9, -1, -1) for k in (3, 1, 2, 700)], "k long, n int, t string").repartition(5)
    made = synth.grouped(rows, lambda r: repr((r["k"], [x["t"] for x in r["t"]])).encode(), "k", ["n"])
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in made.collect()} == {str(k): repr((k, [f"{k}.{n}" for n in range(10)])) for k in (3, 1, 2, 700)}


def test_archives_are_those_of_zipfile():
    parts = {"a/b.xml": b"<a/>", "é.bin": b"", "c.png": b"x" * 5000}
    for some in ({k: v for k, v in parts.items() if k.isascii()}, parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in some.items():
                z.writestr(zipfile.ZipInfo(name), body)
        assert synth.zipped(some) == out.getvalue()


@pytest.mark.parametrize("how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_plain_and_other_archives_read_alike(how):
    plain = synth.docx_of(["one", "two"])
    other = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(other, "w", how) as w:
        for name in z.namelist():
            w.writestr(name, z.read(name))
        w.comment = b"not plain"
    assert directory(plain) and directory(other.getvalue()) is None
    assert list(facts_of(plain)) == list(facts_of(other.getvalue()))


def test_damage_in_a_plain_archive_is_an_error():
    data = synth.docx_of(["one"])
    hurt = data.replace(b">one<", b">two<")
    assert directory(hurt)
    with pytest.raises(OfficeError) as e:
        Package(hurt).bytes("word/document.xml")
    assert e.value.name == "ZipArchive"
    assert [f[0] for f in facts_of(hurt)][-1] == "error"


def test_dealt_facts_are_joined_where_they_lie(spark):
    made = synth.files(spark.createDataFrame([(i,) for i in range(40)], "k long"), lambda r: synth.docx(f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{r['k']}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"), "k")
    f = office.stored_facts(made, kinds=["cell"])
    assert {r["kind"] for r in f.select("kind").distinct().collect()} == {"cell"}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = word.cells(f)
        assert cells.count() == 40
        assert "Exchange hashpartitioning" not in cells._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_kinds_that_are_not_asked_for_are_not_kept():
    data = synth.docx_of(["one"])
    assert {f[0] for f in facts_of(data, kinds={"para", "error"})} == {"para"}
    assert {f[0] for f in facts_of(data, kinds={*slides.CHARTS, "error"})} == set()
