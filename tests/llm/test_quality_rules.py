import duckdb

from glyphsieve.llm import quality_rules as Q

PROSE = "The quick brown fox jumps over the lazy dog near the old mill."


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


CASES = [
    (1, PROSE),
    (2, "A word### and%%% more&&& junk*** here$$$ and### there%%%."),
    (3, "HOME!! NEWS!! SPORT!! WEATHER!! TRAVEL!! CULTURE!! MONEY!!"),
    (4, "Home | News | Sport | Weather | Travel | Culture."),
    (5, PROSE + "\nAll rights reserved."),
    (6, "Der Der Der Der Der Der Der Der Der Der."),
    (7, PROSE + "\nRead more\n\nIt."),
    (8, None),
    (9, ""),
    (10, "  \n \n"),
    (11, "12345 67890"),
    (12, PROSE + "\n" + "Skip to content\n" * 3),
    (13, " ".join(f"wort{i}" for i in range(200_000)) + "."),
    (14, "Él dijo que sí.\nÉl dijo que sí."),
]


def test_rules(spark):
    out = texts(Q.clean_lines(documents(spark, [(i, t, "en", "s", 0) for i, t in CASES])))
    assert set(out) == {1, 5, 7, 12, 13, 14}
    assert out[5] == PROSE and out[7] == PROSE + "\nIt." and out[14] == "Él dijo que sí."
    assert out[13] == CASES[12][1]


def test_rejects_what_loses_too_much(spark):
    much = PROSE + "\nlicensed under the terms of a licence with many words to read on a page of it."
    assert texts(Q.clean_lines(documents(spark, [(1, much, "", "", 0)]), Q.Rules(keep_share=0.9))) == {}
    assert texts(Q.clean_lines(documents(spark, [(1, much, "", "", 0)]), Q.Rules(keep_share=0.2))) == {1: PROSE}


def test_columns_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, PROSE, None, 9, 9, 7)] * 2 + [(None, PROSE, "x", 1, 1, 1)], "doc_id long, text string, gs_kept string, lines_total int, l int, n_chars long")
    out = Q.clean_lines(df)
    assert out.columns == ["doc_id", "text", "gs_kept", "l", "n_chars", "lines_total", "lines_removed"]
    assert out.count() == 3 and {r.n_chars for r in out.collect()} == {len(PROSE)}
    assert Q.clean_lines(df.where("false")).count() == 0


def test_equals_sql(spark):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in CASES] + [(1, PROSE, "en", "s", 0)])
    c = duckdb.connect()
    documents_table = df.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT * FROM documents_table")
    cols = "doc_id, text, n_chars, lines_total, lines_removed"
    expected = c.execute(f"SELECT {cols} FROM ({Q.oracle()}) ORDER BY ALL").fetchall()
    got = sorted(tuple(r) for r in Q.clean_lines(df).select(*cols.split(", ")).collect())
    assert got == sorted(expected) and got


def test_one_narrow_stage(spark):
    plan = Q.clean_lines(documents(spark, [(1, PROSE, "", "", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
