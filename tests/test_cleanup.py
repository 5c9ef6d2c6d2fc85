import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import cleanup

CASES = [
    (T.plain_characters, "Hi – all — of it", "Hi - all - of it"),
    (T.plain_characters, "“q” ‘s’", "\"q\" 's'"),
    (T.remove_private_use, "plainhiddentext", "plainhiddentext"),
    (T.clean_lines, "Begun\n- 8\n- 1999\n— 3\nDone", "Begun\n- 8\n- 1999\n— 3\nDone"),
    (T.clean_lines, "Begun\n- 8 -\n— 3—\nPage 44\n61\nDone", "Begun\nDone"),
    (T.clean_lines, "Part 1 ..... 5\nCONTENTS\nwait...", "wait..."),
    (T.collapse_blank_lines, "A\n\n   \n\t\nB", "A\n\nB"),
    (T.filter_structure, "|\n*\nx", "x"),
    (T.final_normalize, "   * two   wide   gaps   \n", "   * two wide gaps"),
    (T.final_normalize, "a　　b", "a b"),
    (T.final_normalize, "\n   \n\n", ""),
    (lambda x: T.clean_text(x, "aggressive"), "- oak\n  - branch\n    - twig", "- oak\n  - branch\n    - twig"),
    (lambda x: T.clean_text(x, "aggressive"), "---\ntitle: T\nlist:\n    - one\n---\nBody\nPage 1", "---\ntitle: T\nlist:\n    - one\n---\n\nBody"),
    (lambda x: T.clean_text(x, "default"), "---\ntitle: T\nBody", "---\ntitle: T\nBody"),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_stage(spark, at):
    stage, given, expected = CASES[at]
    assert spark.createDataFrame([(given,)], "t string").select(stage(F.col("t"))).first()[0] == expected


def test_nfc_and_mojibake(spark):
    df = spark.createDataFrame([(1, "café â€“\nok")], "id long, t string")
    assert T.clean(df, "t", "minimal").first()["cleaned"].startswith("café")
    assert [r["line"] for r in T.mojibake(df, "id", "t").collect()] == [1]


@pytest.mark.parametrize("name", list(cleanup.queries()))
def test_against_sql(spark, sf, against_sql, name):
    against_sql(cleanup.queries()[name](spark, sf), cleanup.oracle_sql()[name])
