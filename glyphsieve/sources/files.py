"""Files as a corpus: rows of (table, row_id, id, desc, data), where only data is matched and no text is null."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.functions.text import clip_bytes

FASTA_ENDINGS = ("fasta", "fa", "fna", "faa", "fsa")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), or, in a local session that names none, one in the temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "glyphsieve-shared")
    return d.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, that goes with the session."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(rows: DataFrame) -> DataFrame:
    """rows as they are now, written to the shared folder once and opened: what reads them again doesn't compute them again."""
    rows.write.parquet(path := scratch(rows.sparkSession))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def infer_kind(name: Column) -> Column:
    """fasta or text, by the ending of a file's name."""
    return F.when(F.lower(F.regexp_extract(name, "[.]([^.]+)$", 1)).isin(*FASTA_ENDINGS), F.lit("fasta")).otherwise(F.lit("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file one row."""
    files = spark.read.text(path, wholetext=True).select(file_name().alias("table"), "value")
    return files.select("table", F.lit(0).cast("long").alias("row_id"), F.col("table").alias("id"), F.lit("").alias("desc"), F.col("value").alias("data"))


#: Splits whose counts of rows are broadcast; more are joined by a shuffle.
_SPLITS, _LEAST_SPLIT = 200_000, 4 << 20


def numbered(rows: DataFrame) -> DataFrame:
    """rows(file, ...) just as a reader of files gives them, with row_id: the place in their file, from 0.

    Scans take splits in any order, so rows of each split are counted first, in a pass that reads no more columns than it must.
    """
    own, start = F.monotonically_increasing_id().alias("_m"), F.col("_metadata.file_block_start").alias("_s")
    splits = rows.select("file", start, own).groupBy("file", "_s").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    w = Window.partitionBy("file").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_s", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    most = len(rows.inputFiles()) + int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // _LEAST_SPLIT
    few = most <= _SPLITS
    joined = rows.select("*", start, own).join(F.broadcast(splits) if few else splits, ["file", "_s"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_m") - F.col("_first")).alias("row_id"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Each record one row: id up to the first space of its header, desc the rest, data its lines joined. A sequence before the first header is an error.

    A record ends where a line begins with >. Files are split like any text, so that only a single record must fit in a row (2 GB).
    A > that is the very last byte of a file is no record.
    """
    files = spark.read.text(path, lineSep="\n>").select(file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    first = F.col("row_id") == 0
    lost = first & ~F.col("value").startswith(">") & (F.trim(F.regexp_replace("value", "\n", "")) != "")
    checked = F.when(lost, F.raise_error(F.concat(F.lit("sequence data before the first header in "), F.col("file"))).cast("string"))
    rows = numbered(files).select("file", "row_id", checked.otherwise(F.when(first, F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))).alias("part"), (first & (F.trim(F.regexp_replace("value", "\n", "")) == "")).alias("blank"))
    lines = rows.where("NOT blank").select(F.col("file").alias("table"), "row_id", F.split("part", "\n").alias("lines"))
    header = F.get("lines", F.lit(0))
    data = F.array_join(F.slice("lines", F.lit(2), F.size("lines")), "")
    return lines.select("table", "row_id", F.regexp_extract(header, "^([^ ]*)", 1).alias("id"), F.regexp_extract(header, "^[^ ]* (.*)$", 1).alias("desc"), data.alias("data"))


def _records(spark: SparkSession, path: str, width: int, sep: str, header: bool, trim: bool, multiline: bool) -> DataFrame:
    """(file, cells) of delimited records of any width."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(path, schema=schema, sep=sep, header=header, escape='"', multiLine=multiline, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, enforceSchema=True)
    clean = (lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")) if trim else (lambda c: c)
    return rows.select(file_name().alias("file"), F.array(*[clean(F.coalesce(F.col(f"c{i}"), F.lit(""))) for i in range(width)]).alias("cells"))


def read_delimited(
    spark: SparkSession, path: str, columns: list[tuple[str, int]], sep: str = ",", header: bool = True, trim: bool = True, width: int | None = None, multiline: bool = True,
    max_rows: int | None = None, max_row_bytes: int | None = None, budget: int | None = None,
) -> DataFrame:
    """Each column of columns (name, place from 0) a table `file.name`, each record a row of it; short records give empty texts. width: places a record may have.

    Quoted fields may hold newlines; a file is then a task of its own. multiline=False splits files, for those without such fields. max_row_bytes clips every field;
    max_rows takes so many records of each file; budget is of bytes over all columns and files, as in limit_records().
    """
    width = max([i for _, i in columns] + [(width or 1) - 1]) + 1
    rows = _records(spark, path, width, sep, header, trim, multiline)
    limited = max_rows is not None or budget is not None
    rows = numbered(rows) if limited else rows.withColumn("row_id", F.monotonically_increasing_id())
    if max_row_bytes is not None:
        rows = rows.withColumn("cells", F.transform("cells", lambda c: clip_bytes(c, max_row_bytes)))
    if max_rows is not None:
        rows = rows.where(F.col("row_id") < max_rows)
    if budget is not None:
        n = sum((F.octet_length(F.get("cells", F.lit(i))) for _, i in columns), F.lit(0))
        rows = limit_records(rows.withColumn("_n", n.cast("long")), "file", "_n", budget).drop("_n")
    cells = F.array(*[F.struct(F.concat("file", F.lit(f".{name}")).alias("table"), F.get("cells", F.lit(i)).alias("data")) for name, i in columns])
    return rows.select("row_id", F.explode(cells).alias("c")).select("c.table", "row_id", F.lit("").alias("id"), F.lit("").alias("desc"), "c.data")


def selected(labels: list[str], include: list[str], exclude: list[str], file: str) -> list[tuple[str, int]]:
    """Columns that selectors FILE:COLUMN choose: FILE is *, a path, its ending or its base name; COLUMN a label or a place. Without include, all are chosen."""

    def fits(selector: str, i: int) -> bool:
        where, _, column = selector.rpartition(":")
        return (where in ("*", "", file, os.path.basename(file)) or file.endswith(where)) and column in (labels[i], str(i))

    named = [(label or f"col{i}", i) for i, label in enumerate(labels)]
    return [x for x in named if (not include or any(fits(s, x[1]) for s in include)) and not any(fits(s, x[1]) for s in exclude)]


def sniff(spark: SparkSession, path: str, sep: str, header: bool) -> list[str]:
    """The labels of a file's columns: the fields of its first record, or colN."""
    first = spark.read.csv(path, sep=sep, header=False, escape='"', multiLine=True).limit(1).collect()
    cells = [(x or "").strip() for x in first[0]] if first else []
    return [x or f"col{i}" for i, x in enumerate(cells)] if header else [f"col{i}" for i in range(len(cells))]


def read_delimited_selected(spark: SparkSession, path: str, sep: str, header: bool, include: list[str] = [], exclude: list[str] = [], **limits) -> DataFrame:
    """The columns that selectors choose, by the labels of the first record; limits are those of read_delimited()."""
    labels = sniff(spark, path, sep, header)
    return read_delimited(spark, path, selected(labels, include, exclude, path), sep, header, width=len(labels), **limits)


def read_dataset(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of either kind, by their endings."""
    read = lambda p: read_fasta if p.rpartition(".")[2].lower() in FASTA_ENDINGS else read_text
    return reduce(DataFrame.unionByName, [read(p)(spark, p) for p in paths])


def read_patterns(spark: SparkSession, *paths: str) -> DataFrame:
    """(pattern_index, pattern, description) of tab-separated files: blank lines and those of # are no patterns; without a description it is `Pattern N`."""
    kept = []
    for k, p in enumerate(paths):
        rows = spark.read.text(p).select(F.lit(k).alias("k"), F.monotonically_increasing_id().alias("i"), F.trim("value").alias("v"))
        kept.append(rows.where((F.col("v") != "") & ~F.col("v").startswith("#")))
    if not reduce(DataFrame.unionByName, kept).limit(1).count():
        raise ValueError(f"no patterns in {', '.join(paths)}")
    rows = reduce(DataFrame.unionByName, kept).withColumn("n", F.row_number().over(Window.orderBy("k", "i")))  # a file of patterns is small
    cells = F.split("v", "\t", 2)
    described = F.nullif(F.trim(F.coalesce(F.get(cells, F.lit(1)), F.lit(""))), F.lit(""))
    return rows.select((F.col("n") - 1).alias("pattern_index"), F.trim(F.get(cells, F.lit(0))).alias("pattern"), F.coalesce(described, F.concat(F.lit("Pattern "), F.col("n").cast("string"))).alias("description"))


def limit_rows(corpus: DataFrame, n: int) -> DataFrame:
    """The first n rows of each table."""
    w = Window.partitionBy("table").orderBy("row_id")
    return corpus.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


#: Rows by which running sums are taken, so that no more than so many of a table meet in one place.
_BLOCK = 1 << 16


def running(rows: DataFrame, group: str, size: str) -> DataFrame:
    """rows(group, row_id, size) with `_before`, the sum of the sizes of the rows before each in its group: sums of blocks of row ids, then within the blocks."""
    block = F.floor(F.col("row_id") / _BLOCK)
    sums = rows.groupBy(group, block.alias("_k")).agg(F.sum(size).alias("_sum"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_k", F.coalesce(F.sum("_sum").over(upto(Window.partitionBy(group).orderBy("_k"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(size).over(upto(Window.partitionBy(group, "_k").orderBy("row_id"))), F.lit(0))
    return rows.withColumn("_k", block).withColumn("_own", own).join(sums, [group, "_k"]).withColumn("_before", F.col("_base") + F.col("_own")).drop("_k", "_own", "_base")


def limit_records(rows: DataFrame, group: str, size: str, budget: int, groups: list[str] | None = None, strict: bool = False, clip: str | None = None) -> DataFrame:
    """Rows of all groups (files or tables) that one budget of bytes takes: of each group, in order, the rows up to the first that no longer fits; what is left goes on
    to the next group. groups: their order, else by name. strict: a budget used up ends everything, so that empty rows after it go, too. clip: a column of text of
    which the first row of a group is clipped to what is left, if it doesn't fit, which uses the budget up.
    """
    summed = running(rows, group, size)
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy(group).agg(F.sum(size), F.min("row_id")).collect()}  # a row a file or table
    left, taken = budget, None
    for name in groups or sorted(totals):
        if name not in totals or (left == 0 and (strict or clip)):
            continue
        own, (total, first) = summed.where(F.col(group) == name), totals[name]
        fits = (F.col("_before") + F.col(size)) <= left
        if total > left or (strict and total == left):
            part = own.where(fits & (F.col("_before") < left)) if strict else own.where(fits)
            used = part.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
            if clip and used == 0 and left > 0 and own.where((F.col("row_id") == first) & (F.col(size) > left)).count():
                part, used = own.where(F.col("row_id") == first).withColumn(clip, clip_bytes(F.col(clip), left)), left
        else:
            part, used = own, total
        left -= used
        taken = part if taken is None else taken.unionByName(part)
    return (summed.where("false") if taken is None else taken).drop("_before")


def limit_bytes(corpus: DataFrame, budget: int, tables: list[str] | None = None, strict: bool = False, clip: bool = False) -> DataFrame:
    """limit_records() of a corpus by its tables. clip: as for FASTA, where the first record of a file is clipped to what is left."""
    rows = corpus.withColumn("_n", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"))
    return limit_records(rows, "table", "_n", budget, tables, strict, "data" if clip else None).drop("_n")


def subset_bytes(corpus: DataFrame, target: int, max_records: int | None = None) -> DataFrame:
    """Whole rows of each table in order up to the target, max_records at most; the first always."""
    rows = running(corpus.withColumn("_n", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")), "table", "_n")
    first = rows.groupBy("table").agg(F.min("row_id").alias("_first"))
    kept = rows.join(first, "table").where((F.col("_before") + F.col("_n") <= target) | (F.col("row_id") == F.col("_first"))).select(*corpus.columns)
    return kept if max_records is None else limit_rows(kept, max_records)


def exclude(corpus: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """Rows whose column holds none of the non-empty needles."""
    for n in needles:
        if n:
            corpus = corpus.where(~F.coalesce(F.col(column), F.lit("")).contains(n))
    return corpus


def totals(corpus: DataFrame) -> DataFrame:
    """(table, entries, bytes) for each table."""
    return corpus.groupBy("table").agg(F.count("*").alias("entries"), F.sum(F.octet_length("data")).alias("bytes"))


def fasta_totals(spark: SparkSession, path: str) -> DataFrame:
    """(table, entries, bytes, raw_bytes) of each FASTA file of a folder: records, bytes of sequences, bytes of the file. An error, if there is no record at all."""
    sizes = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("table"), F.col("length").alias("raw_bytes"))
    found = sizes.join(totals(read_fasta(spark, path)), "table", "left").select("table", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "raw_bytes")
    every = F.sum("entries").over(Window.partitionBy())  # a row a file
    checked = found.withColumn("entries", F.when(every == 0, F.raise_error(F.lit("no FASTA record was found")).cast("long")).otherwise(F.col("entries")))
    if not found.limit(1).count():
        raise ValueError("no FASTA record was found")
    return checked


#: The columns of a file of results.
RESULTS = (
    "dataset", "algorithm", "pattern_index", "pattern", "pattern_desc", "table", "file_type", "duration_micros", "found_count", "skipped", "table_rows", "table_avg_len", "table_max_len",
)


def write_results(results: DataFrame, path: str) -> None:
    """Results as CSV with a header: the thirteen columns of RESULTS, mean lengths with four decimals. Missing statistics of a table count as 0, a missing description as empty."""
    shown = results.withColumn("table_avg_len", F.format_string("%.4f", F.coalesce(F.col("table_avg_len").cast("double"), F.lit(0.0))))
    shown = shown.select(*RESULTS).fillna({"pattern_desc": "", "table_rows": 0, "table_max_len": 0})
    shown.write.csv(path, header=True, escape='"', quote='"', emptyValue="")


def redelimit(spark: SparkSession, source: str, target: str, sep: str = ",", new: str = "|", width: int = 64) -> None:
    """A delimited file with another delimiter; records stay as they are, newlines in quoted fields included."""
    labels = sniff(spark, source, sep, False)
    schema = ", ".join(f"c{i} string" for i in range(len(labels) or width))
    spark.read.csv(source, schema=schema, sep=sep, escape='"', multiLine=True).write.csv(target, sep=new, escape='"', emptyValue="")
