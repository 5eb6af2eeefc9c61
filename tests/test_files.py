import pytest
from pyspark.sql import functions as F

from glyphsieve.functions.text import quote
from glyphsieve.sources import files as S


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_text_is_one_row(spark, tmp_path):
    path = put(tmp_path / "sample.txt", "hello world\nagain\n")
    assert rows(S.read_text(spark, path), "table", "id", "desc", "data") == [("sample.txt", "sample.txt", "", "hello world\nagain\n")]


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "x.fa", ">seq1 Human Gene\r\nATGC\r\n\r\nATGC\r\n>seq2\nGGCC\n>seq3 empty one\n>\n")
    assert rows(S.read_fasta(spark, path), "row_id", "id", "desc", "data") == [(0, "seq1", "Human Gene", "ATGCATGC"), (1, "seq2", "", "GGCC"), (2, "seq3", "empty one", ""), (3, "", "", "")]
    assert rows(S.totals(S.read_fasta(spark, path)), "table", "entries", "bytes") == [("x.fa", 4, 12)]
    assert rows(S.fasta_totals(spark, path), "table", "entries", "bytes", "raw_bytes") == [("x.fa", 4, 12, 61)]
    blank = put(tmp_path / "blank.fa", "\n\n>seq1\nAT\nGC\n>seq2\n>>seq3 x\nA")
    assert rows(S.read_fasta(spark, blank), "id", "desc", "data") == [("seq1", "", "ATGC"), ("seq2", "", ""), (">seq3", "x", "A")]
    with pytest.raises(Exception, match="no FASTA record"):
        S.fasta_totals(spark, put(tmp_path / "empty.fa", "\n")).collect()
    bad = put(tmp_path / "bad.fa", "ATGC\n>seq1\nATGC")
    with pytest.raises(Exception, match="before the first header"):
        S.read_fasta(spark, bad).collect()


def test_datasets_and_kinds(spark, tmp_path):
    paths = [put(tmp_path / "a.txt", "x"), put(tmp_path / "b.FNA", ">s\nACGT\n")]
    assert sorted(rows(S.read_dataset(spark, paths), "table", "data")) == [("a.txt", "x"), ("b.FNA", "ACGT")]
    df = spark.createDataFrame([("a.fasta",), ("b.Fa",), ("c.faa",), ("d.txt",), ("fa",)], "n string")
    assert [r[0] for r in df.select(S.infer_kind(F.col("n"))).collect()] == ["fasta", "fasta", "fasta", "text", "text"]


def test_delimited(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'name, kind ,note\n one , "a, b" , "say ""x"""\nshort\nlong,l,m,n,o\n')
    got = rows(S.read_delimited(spark, path, [("name", 0), ("note", 2)]), "table", "data")
    assert sorted(got) == [("t.csv.name", "long"), ("t.csv.name", "one"), ("t.csv.name", "short"), ("t.csv.note", ""), ("t.csv.note", "m"), ("t.csv.note", 'say "x"')]
    bare = put(tmp_path / "u.tbl", "1|x|2\n3|y|4\n")
    got = rows(S.read_delimited_selected(spark, bare, "|", False, include=["u.tbl:col0", "*:2"], exclude=["*:2"]), "table", "data")
    assert sorted(got) == [("u.tbl.col0", "1"), ("u.tbl.col0", "3")]


def test_fasta_over_splits(spark, tmp_path):
    """A file in many splits has its records in order, each once."""
    records = [(f"s{i}", "ACGTN" * (i % 70)) for i in range(400)]
    path = put(tmp_path / "long.fa", "".join(f">{i} d\n{t}\n" for i, t in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = S.read_fasta(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert [tuple(r) for r in df.select("row_id", "id", "data").orderBy("row_id").collect()] == [(k, i, t) for k, (i, t) in enumerate(records)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_newlines_in_quotes_and_limits(spark, tmp_path):
    path = put(tmp_path / "q.csv", '"a b","c,d"\none,"line a\nline b"\ntwo,xx\nthree,\n')
    assert S.sniff(spark, path, ",", True) == ["a b", "c,d"]
    got = rows(S.read_delimited_selected(spark, path, ",", True), "table", "data")
    assert sorted(got) == sorted([("q.csv.a b", "one"), ("q.csv.a b", "two"), ("q.csv.a b", "three"), ("q.csv.c,d", "line a\nline b"), ("q.csv.c,d", "xx"), ("q.csv.c,d", "")])
    limited = lambda **k: sorted(r.data for r in S.read_delimited_selected(spark, path, ",", True, **k).collect())
    assert limited(max_rows=1) == ["line a\nline b", "one"]
    assert limited(max_row_bytes=3, max_rows=2) == ["lin", "one", "two", "xx"]
    # records of 16, 5 and 5 bytes over both columns
    assert limited(budget=20) == ["line a\nline b", "one"] and limited(budget=21) == ["line a\nline b", "one", "two", "xx"] and limited(budget=15) == []


@pytest.mark.parametrize("include,exclude,expected", [([], [], [0, 1, 2]), (["*:1"], [], [1]), (["t.tbl:b"], [], [1]), (["/d/t.tbl:2"], [], [2]), (["tbl:0"], [], [0]), (["other:0"], [], []), ([], ["*:a", "*:2"], [1])])
def test_selectors(include, exclude, expected):
    assert [i for _, i in S.selected(["a", "b", "c"], include, exclude, "/d/t.tbl")] == expected


def test_patterns(spark, tmp_path):
    one, two = put(tmp_path / "p.tsv", "# c\n%STEEL%\tsteel\n\n  a_%  \n"), put(tmp_path / "q.tsv", "x\ty\tz\n")
    assert rows(S.read_patterns(spark, one, two), "pattern_index", "pattern", "description") == [(0, "%STEEL%", "steel"), (1, "a_%", "Pattern 2"), (2, "x", "y\tz")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("a", 0, "xx"), ("a", 1, ""), ("a", 2, "éé"), ("a", 3, "x"), ("b", 0, "long text"), ("b", 1, None)], "table string, row_id long, data string")


def test_limits(corpus):
    ids = lambda df: sorted((r.table, r.row_id) for r in df.collect())
    assert ids(S.limit_rows(corpus, 2)) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    # a: 2, 0, 4 and 1 bytes, b: 9 and none; what a leaves of the budget is b's
    assert ids(S.limit_bytes(corpus, 6)) == [("a", 0), ("a", 1), ("a", 2)]
    assert ids(S.limit_bytes(corpus, 5)) == [("a", 0), ("a", 1)]
    assert ids(S.limit_bytes(corpus, 16)) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert ids(S.limit_bytes(corpus, 16, strict=True)) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    assert ids(S.limit_bytes(corpus, 9, ["b", "a"])) == [("b", 0), ("b", 1)] and ids(S.limit_bytes(corpus, 11, ["b", "a"])) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert ids(S.limit_bytes(corpus, 0)) == []
    clipped = S.limit_bytes(corpus, 11, clip=True)
    assert sorted((r.table, r.row_id, r.data) for r in clipped.collect()) == [("a", 0, "xx"), ("a", 1, ""), ("a", 2, "éé"), ("a", 3, "x"), ("b", 0, "long")]
    assert ids(S.subset_bytes(corpus, 100, 1)) == [("a", 0), ("b", 0)]
    assert ids(S.subset_bytes(corpus, 3)) == [("a", 0), ("a", 1), ("b", 0)]
    assert ids(S.exclude(corpus, "data", ["", "é", "long"])) == [("a", 0), ("a", 1), ("a", 3), ("b", 1)]


def test_results_and_redelimiting(spark, tmp_path):
    row = ("d", "kmp", 0, '%a"b,c%', None, "t", "text", 12, 3, False, 5, 1.5, 9)
    schema = "dataset string, algorithm string, pattern_index int, pattern string, pattern_desc string, table string, file_type string, duration_micros long, found_count long, skipped boolean, table_rows long, table_avg_len double, table_max_len long"
    df = spark.createDataFrame([row, ("d", "bm", 1, "x", "by, hand", "t", "fasta", 0, 0, True, None, None, None)], schema).selectExpr("*", "1 AS more")
    S.write_results(df.coalesce(1), f"{tmp_path}/out")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/out", wholetext=True).collect())
    assert text == ",".join(S.RESULTS) + '\nd,kmp,0,"%a""b,c%",,t,text,12,3,false,5,1.5000,9\nd,bm,1,x,"by, hand",t,fasta,0,0,true,0,0.0000,0\n'
    source = put(tmp_path / "j.csv", 'a,"b|c",\n1,"2\n3",3\n')
    S.redelimit(spark, source, f"{tmp_path}/pipes")
    assert "".join(r.value for r in spark.read.text(f"{tmp_path}/pipes", wholetext=True).collect()) == 'a|"b|c"|\n1|"2\n3"|3\n'


def test_a_file_without_patterns_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no patterns"):
        S.read_patterns(spark, put(tmp_path / "none.tsv", "# only\n\n"))


def test_quote():
    assert quote("it's") == "'it''s'"


def test_empty_documents_are_lines_of_bounded_files(spark, tmp_path, monkeypatch):
    from glyphsieve.plans import search_queries

    monkeypatch.setattr(search_queries, "AT_MOST", 2, raising=False)
    texts = ["", "one\ntwo", None, "été 💩", "", "\n", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spread = []
    read = search_queries.files.read_text
    monkeypatch.setattr(search_queries.files, "read_text", lambda s, path: spread.append(read(s, path).count()) or read(s, path))
    assert tuple(search_queries.QUERIES["src_text"](spark, str(tmp_path)).first()) == (sum(len(t or "") for t in texts), len(texts))
    assert spread[0] >= 4
