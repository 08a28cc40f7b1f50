"""Readers of schedule exports: node text, zip archives, CSV, XER; all give the same task columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Task columns and the node keys they come from.
TASK_COLUMNS = {
    "id": "ID",
    "task_type": "TaskType",
    "label": "Label",
    "planned_start": "PlannedStart",
    "planned_end": "PlannedEnd",
    "actual_start": "ActualStart",
    "actual_end": "ActualEnd",
    "float": "Float",
    "status": "Status",
}
TASK_TYPES = ("TT_TASK", "TT_Task")


def decode(content):
    """Bytes as UTF-8 (a byte-order mark is dropped) where they are that, else as Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), one row a file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), decode(F.col("content")).alias("text"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each member of the archives; folders are skipped. One archive is read by one task."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(blob.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([z.read(name)], pa.binary())], names=["file", "content"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInArrow(run, "file string, content binary").select("file", decode(F.col("content")).alias("text"))


def by_file(records: DataFrame, columns: list[str]) -> DataFrame:
    """Raw columns (binary) of records (path, ...) as text: a file with bytes that are not UTF-8 is Latin-1 in all its records."""
    odd = records.where(~F.is_valid_utf8(F.col(columns[0]).cast("string"))).select("path").distinct().withColumn("latin", F.lit(True))
    text = lambda c: F.regexp_replace(F.when(F.col("latin").isNull(), F.col(c).cast("string")).otherwise(F.decode(c, "ISO-8859-1")), "^\\x{FEFF}", "")
    return records.join(odd, "path", "left").withColumns({c: text(c) for c in columns}).drop("latin")


def node_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, node): the pieces before each ``</node>``, read as records, so that a file of any size is split over tasks.

    ``file`` is the file's name, or the ``file=`` folder it lies in.
    """
    raw = spark.read.text(path, lineSep="</node>")
    name = F.col("file") if "file" in raw.columns else F.col("_metadata.file_name")
    records = raw.select(F.col("_metadata.file_path").alias("path"), name.alias("file"), F.col("value").cast("binary").alias("node"))
    return by_file(records, ["node"]).select("file", "node")


def read_nodes(spark: SparkSession, path: str, columns: dict[str, str] | None = None, file_column: str = "file") -> DataFrame:
    """Task rows of node files, read by records (see ``parse_nodes``)."""
    return _node_rows(node_records(spark, path), columns, file_column)


def parse_nodes(files: DataFrame, columns: dict[str, str] | None = None, file_column: str = "file") -> DataFrame:
    """Task rows of node texts (file, text): one a ``</node>`` piece with an id, values by key, missing keys null.

    Quotes and U+FFFD are removed first.  ``columns`` maps column names to node keys (older exports have other
    ones) and other keys are dropped; ``file_column`` names the column of the file.
    """
    return _node_rows(files.select("file", F.explode(F.split("text", "</node>")).alias("node")), columns, file_column)


def _node_rows(records: DataFrame, columns: dict[str, str] | None, file_column: str) -> DataFrame:
    columns = columns or TASK_COLUMNS
    clean = F.replace(F.replace(F.col("node"), F.lit('"'), F.lit("")), F.lit("�"), F.lit(""))
    nodes = records.select("file", clean.alias("node")).where(F.col("node").contains("node id"))
    keys = F.regexp_extract_all("node", F.lit(r"key=([^>\s/]+)[^>]*>([^<]*)<"), F.lit(1))
    values = F.regexp_extract_all("node", F.lit(r"key=([^>\s/]+)[^>]*>([^<]*)<"), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    value = lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]
    found = F.regexp_extract("node", r"node id=([^>\s]+)", 1)
    cols = [(found if key == "ID" else F.when(F.exists(pairs, lambda p: p["k"] == key), value(key))).alias(name) for name, key in columns.items()]  # noqa: B023
    return nodes.select(*cols, F.col("file").alias(file_column))


def read_csv(spark: SparkSession, path: str, headers: list[str] | None = None) -> DataFrame:
    """Quoted CSV with a header, all text; an unnamed index column is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.drop(*[c for c in df.columns if c in ("_c0", "Unnamed: 0")])
    return df if headers is None else df.select([f"`{h}`" for h in headers])


def parse_xer(files: DataFrame) -> DataFrame:
    """(file, table, row map<column, value>) of tab-separated XER texts: ``%T`` names a table, ``%F`` its columns, ``%R`` a row."""
    pieces = files.select("file", F.split(F.concat(F.lit("\n"), "text"), r"\r?\n%T\t").alias("pieces"))
    tables = pieces.select("file", F.explode(F.slice("pieces", F.lit(2), F.size("pieces"))).alias("t"))
    lines = F.split("t", r"\r?\n")
    header = F.split(F.element_at(F.filter(lines, lambda x: x.startswith("%F\t")), 1), "\t")
    rows = F.filter(lines, lambda x: x.startswith("%R\t"))
    split = tables.select("file", F.trim(F.element_at(lines, 1)).alias("table"), header.alias("h"), F.explode(rows).alias("r"))
    values = F.split("r", "\t", -1)
    n = F.least(F.size("h"), F.size(values)) - 1
    return split.select("file", "table", F.map_from_arrays(F.slice("h", F.lit(2), n), F.slice(values, F.lit(2), n)).alias("row"))


def read_xer(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row) as ``parse_xer`` gives them, from files read by lines and split over tasks.

    A task goes through its part of a file in order and gives each row the last ``%T`` and ``%F`` line before
    it there.  Rows before the first of them take those of the parts before, of which only the last header
    lines are gathered: a row for each part.
    """
    import pyarrow as pa

    raw = spark.read.text(path)
    name = F.col("file") if "file" in raw.columns else F.col("_metadata.file_name")
    lines = raw.select(F.col("_metadata.file_path").alias("path"), name.alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("line"))

    def rows(batches):
        at, table, fields = None, None, None
        for batch in batches:
            paths, parts, raw_lines = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tables, heads, kept = [], [], []
            for i, line in enumerate(raw_lines):
                if at != (paths[i], parts[i]):
                    at, table, fields = (paths[i], parts[i]), None, None
                if line[:3] == b"%T\t":
                    table, fields = line, b""  # no columns yet, and none from before
                elif line[:3] == b"%F\t":
                    fields = line
                elif line[:3] == b"%R\t":
                    tables.append(table)
                    heads.append(fields)
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in batch.columns), pa.array(tables, pa.binary()), pa.array(heads, pa.binary())], names=["path", "file", "part", "line", "table", "fields"])

    found = lines.mapInArrow(rows, "path string, file string, part long, line binary, table binary, fields binary")
    order = lines.withColumn("n", F.monotonically_increasing_id())
    kind = F.substring(F.col("line").cast("string"), 1, 3)
    last = order.where(kind.isin("%T\t", "%F\t")).groupBy("path", "part").agg(
        F.max_by(F.when(kind == "%T\t", F.col("line")), F.when(kind == "%T\t", F.col("n"))).alias("t"),
        F.max(F.when(kind == "%T\t", F.col("n"))).alias("tn"),
        F.max_by(F.when(kind == "%F\t", F.col("line")), F.when(kind == "%F\t", F.col("n"))).alias("f"),
        F.max(F.when(kind == "%F\t", F.col("n"))).alias("fn"),
    )
    closed = last.select("path", "part", "t", F.when(F.col("f").isNull() | (F.col("fn") < F.col("tn")), F.when(F.col("tn").isNotNull(), F.lit(b""))).otherwise(F.col("f")).alias("f"))
    ends = closed.unionByName(lines.select("path", "part").distinct().join(closed, ["path", "part"], "left_anti").withColumns({"t": F.lit(None).cast("binary"), "f": F.lit(None).cast("binary")}))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not lines
    carried = ends.select("path", "part", F.last("t", True).over(before).alias("t"), F.last("f", True).over(before).alias("f"))
    whole = found.join(carried, ["path", "part"], "left").select("path", "file", F.coalesce("table", "t").alias("table"), F.coalesce("fields", "f").alias("fields"), "line")
    text = by_file(whole.select("path", "file", "line", "table", "fields"), ["line", "table", "fields"])
    cut = lambda c: F.split(F.regexp_replace(c, r"\r$", ""), "\t", -1)
    n = F.least(F.size("h"), F.size("v")) - 1
    split = text.where("table is not null and fields <> ''").select("file", F.trim(F.element_at(cut("table"), 2)).alias("table"), cut("fields").alias("h"), cut("line").alias("v"))
    return split.select("file", "table", F.map_from_arrays(F.slice("h", F.lit(2), n), F.slice("v", F.lit(2), n)).alias("row"))


def xer_tasks(rows: DataFrame) -> DataFrame:
    """Task rows of a parsed XER text; dependent tasks count as plain ones."""
    r = F.col("row")
    kind = F.when(r["task_type"].isin("TT_Task", "TT_TASK", "TASK_DEPENDENT"), "TT_TASK").otherwise(r["task_type"])
    return rows.where("table = 'TASK'").select(
        r["task_code"].alias("id"), kind.alias("task_type"), r["task_name"].alias("label"), r["target_start_date"].alias("planned_start"), r["target_end_date"].alias("planned_end"), r["act_start_date"].alias("actual_start"), r["act_end_date"].alias("actual_end"), r["total_float_hr_cnt"].alias("float"), r["status_code"].alias("status"), "file"
    )


def read_jdbc(spark: SparkSession, url: str, table: str, where: str | None = None, properties: dict | None = None) -> DataFrame:
    """A database table; the filter is pushed down."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    return df if where is None else df.where(where)


def read_lines(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)


def clean_tasks(tasks: DataFrame, types: tuple[str, ...] = TASK_TYPES) -> DataFrame:
    """Time-dependent tasks without exact duplicates, labels cleaned. The filter comes before the shuffle."""
    from taskweft.functions.text import clean_label

    return tasks.where(F.col("task_type").isin(*types)).dropDuplicates().withColumn("label", clean_label(F.col("label")))
