"""File sources and sinks: training split, prediction files keyed by file
name, checkpoint families, training logs, CSV results.

Readers declare schemas (no inference) and take the key of each row from
the file it came from (``_metadata.file_name``), so a whole family of files
is one DataFrame with a key column and one scan.
"""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafwise.sources.csv_source import CsvFamily, opens

PREDICTION_SCHEMA = "y_true string, y_pred string"
# The checkpoint family's file names.
BASE_CHECKPOINT_STEM = "zeroshot_base"
CHECKPOINT_FILE_FORMAT = "prediction_df_{setting}_{ckpt}_final_setting.csv"
DECODING_SETTING = "1.0_0.9_9"
EXPECTED_CHECKPOINTS = [0, *range(500, 15000, 500)]


def file_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def read_train(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet",
               split: str | None = "train") -> DataFrame:
    """A labelled dataset; ``split`` selects a partition value (pruned at scan).

    CSV columns are taken by name; ``schema`` names those that are wanted.
    """
    if fmt == "csv":
        if not schema:
            raise ValueError("CSV needs a schema")
        df = read_csv(spark, path, schema)
    else:
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema else reader).load(path)
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over: marker and temporary files and folders."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def list_files(spark: SparkSession, path) -> list[tuple[str, int]]:
    """(path, bytes) of the data files under paths or globs, a listing: no data is read.

    Nothing in a hidden or temporary folder below them is a data file.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in [path] if isinstance(path, str) else path:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        # a path that is there is meant literally, whatever signs it holds
        found = [fs.getFileStatus(hp)] if fs.exists(hp) else fs.globStatus(hp) or []
        for status in found:
            root = status.getPath().toString()
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                name = f.getPath().toString()
                below = name[len(root):].strip("/").split("/") if name != root else [f.getPath().getName()]
                if f.getLen() and not any(map(_hidden, below)):
                    out.append((name, f.getLen()))
    return sorted(out)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names in the first line of a CSV file, decompressed by its ending."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path(file)
    stream = hp.getFileSystem(conf).open(hp)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hp)
    stream = stream if codec is None else codec.createInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return tuple(next(csv.reader([(reader.readLine() or "").lstrip("\ufeff")]), []))
    finally:
        reader.close()


def _literal(path: str) -> str:
    """The path with every sign that would be a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _by_scan(spark: SparkSession, files: list[str], names: list[str], multi_line: bool, key: str | None) -> DataFrame:
    """The named columns (c0, c1, ...) and ``_file`` by Spark's own reader, one scan per distinct header.

    For stores that only Spark opens; the driver reads the headers.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by_header.setdefault(_header(spark, f), []).append(f)
    out = None
    for header, group in by_header.items():
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"columns {missing} are missing in {group[0]}: its header is {list(header)}")
        # the columns get names that cannot clash
        raw = StructType.fromDDL(", ".join(f"`h{i}` string" for i in range(len(header))))
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE")
        rows = reader.schema(raw).csv([_literal(f) for f in group])
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        got = rows.select(*[F.col(f"h{header.index(n)}").alias(f"c{i}") for i, n in enumerate(names)], path.alias("_file"))
        out = got if out is None else out.unionByName(got)
    if key:
        value = F.regexp_extract("_file", f"/{re.escape(key)}=([^/]*)/[^/]*$", 1)
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
        out = out.withColumn("_key", F.when(value != "__HIVE_DEFAULT_PARTITION__", value))
    return out


def _csv_by_name(spark: SparkSession, files: list[tuple[str, int]], schema: str, multi_line: bool = False,
                 key: str | None = None) -> DataFrame:
    """The named columns of CSV files whose headers may differ in order and hold more, with ``_file``.

    ``key`` is the value of the ``key=...`` folder a file lies in.  Headers
    are read where the rows are, on the executors; a file without one of the
    columns raises when it is read.
    """
    fields = StructType.fromDDL(schema).fields
    if not files:
        more = f", `{key}` string" if key else ""
        empty = StructType([*fields, *StructType.fromDDL("_file string" + more).fields])
        return spark.createDataFrame([], empty)
    names = [f.name for f in fields]
    if all(opens(f) for f, _ in files):
        spark.dataSource.register(CsvFamily)
        per = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        reader = spark.read.format(CsvFamily.name()).option("files", json.dumps(files)).option("fields", json.dumps(names))
        reader = reader.option("bytes", per).option("multiline", multi_line)
        rows = (reader.option("key", key) if key else reader).load()
    else:
        rows = _by_scan(spark, [f for f, _ in files], names, multi_line, key)
    cols = [F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return rows.select(*cols, "_file", *([F.col("_key").alias(key)] if key else []))


def read_csv(spark: SparkSession, path, schema: str = PREDICTION_SCHEMA, with_file: bool = False,
             multi_line: bool = False) -> DataFrame:
    """The columns of ``schema``, by name, of CSV files with a header; ``with_file`` adds ``file_name``.

    Quotes inside a value are doubled, as most writers do.  ``multi_line``
    reads values that span lines (such a file is one task's work).
    """
    df = _csv_by_name(spark, list_files(spark, path), schema, multi_line)
    return df.withColumn("file_name", F.regexp_extract("_file", r"([^/]*)$", 1)).drop("_file") if with_file else df.drop("_file")


def _family(spark: SparkSession, root: str, globs: list[str], schema: str, layout: str, key: str,
            multi_line: bool = False) -> DataFrame:
    """Rows of a file family with ``key`` = file stem (flat) or the value of
    the ``key=...`` directory (partitioned, Hive style)."""
    fields = StructType.fromDDL(schema).fieldNames()
    root = root.rstrip("/")
    if layout == "flat":
        df = _csv_by_name(spark, list_files(spark, [f"{root}/{g}" for g in globs]), schema, multi_line)
        return df.select(file_stem(F.col("_file")).alias(key), *fields)
    if layout == "partitioned":
        df = _csv_by_name(spark, list_files(spark, root), schema, multi_line, key=key)
        return df.select(key, *fields)
    raise ValueError("layout must be 'flat' or 'partitioned'")


def family_names(spark: SparkSession, root: str, layout: str = "flat", key: str = "file") -> list[str]:
    """Keys of a family's files, from the listing."""
    files = [f for f, _ in list_files(spark, root.rstrip("/") + ("/*.csv" if layout == "flat" else ""))]
    if layout == "flat":
        return sorted({f.rsplit("/", 1)[1].rsplit(".", 1)[0] for f in files})
    return sorted({_unescape(part[len(key) + 1:]) for f in files for part in f.split("/") if part.startswith(f"{key}=")})


def read_prediction_files(spark: SparkSession, root: str, suffixes=("_test", "_val", "_external"),
                          schema: str = PREDICTION_SCHEMA, key: str = "model", layout: str = "flat") -> DataFrame:
    """All prediction files as one DataFrame keyed by model name.

    ``flat``: the reference's ``{root}/*{suffix}.csv``, key = file stem.
    ``partitioned``: ``{root}/{key}=<name>/part-*.csv`` (many writers and
    files per model), filtered to names with a split suffix.
    """
    # one glob with alternation: a suffix without files is not an error
    df = _family(spark, root, ["*{" + ",".join(suffixes) + "}.csv"], schema, layout, key)
    if layout == "partitioned":
        cond = None
        for sfx in suffixes:
            cond = F.col(key).endswith(sfx) if cond is None else cond | F.col(key).endswith(sfx)
        df = df.where(cond)
    return df


def checkpoint_of(stem: Column, setting: str = DECODING_SETTING, steps: list[int] | None = None) -> Column:
    """Checkpoint step from a family file stem; NULL when the name does not
    fit, is of another decoding setting, or of a step not in ``steps``."""
    pattern = "^" + re.escape(CHECKPOINT_FILE_FORMAT.removesuffix(".csv").format(setting=setting, ckpt="@")).replace("@", r"(\d+)") + "$"
    step = F.when(stem == BASE_CHECKPOINT_STEM, F.lit(0)).otherwise(F.regexp_extract(stem, pattern, 1).try_cast("int"))
    return F.when(step.isin(EXPECTED_CHECKPOINTS if steps is None else steps), step)


def read_checkpoint_files(spark: SparkSession, root: str, schema: str = PREDICTION_SCHEMA,
                          expected: list[int] | None = None, layout: str = "flat", key: str = "file",
                          setting: str = DECODING_SETTING, steps: list[int] | None = None) -> DataFrame:
    """The checkpoint family with a ``checkpoint`` column from each file name.

    ``zeroshot_base`` is checkpoint 0; other names carry the decoding setting
    and the step.  ``partitioned`` reads ``{root}/file=<stem>/…``.  With
    ``expected``, checkpoints without a file raise (a file with only a
    header is there); the check reads the listing only.
    """
    df = _family(spark, root, ["*.csv"], schema, layout, key)
    out = df.select(checkpoint_of(F.col(key), setting, steps).alias("checkpoint"), *StructType.fromDDL(schema).fieldNames())
    if expected is not None:
        names = set(family_names(spark, root, layout, key))
        stem = CHECKPOINT_FILE_FORMAT.removesuffix(".csv")
        missing = sorted(c for c in expected if (BASE_CHECKPOINT_STEM if c == 0 else stem.format(setting=setting, ckpt=c)) not in names)
        if missing:
            raise FileNotFoundError(f"checkpoint files missing for {missing}")
    return out.where(F.col("checkpoint").isNotNull())


def _csv_writer(df: DataFrame, mode: str):
    """CSV that any reader takes: quotes doubled, white space kept."""
    return (df.write.mode(mode).option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_partitioned_csv(df: DataFrame, key: str, root: str, mode: str = "overwrite", writers: int = 8) -> str:
    """A file family in the partitioned layout: ``{root}/{key}=<value>/part-*.csv``
    with at most ``writers`` files per key (the rows of a key are dealt to as
    many tasks, so neither a hot key waits for one writer nor every task
    writes a file per key)."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != key]), F.lit(writers))
    dealt = df.withColumn("_deal", deal).repartition(F.col(key), F.col("_deal")).drop("_deal")
    _csv_writer(dealt, mode).partitionBy(key).csv(root)
    return root


def _with_place(scan: DataFrame) -> DataFrame:
    """``pos``: a row's place in its file, 0-based, from its place in its split and the rows of earlier splits.

    A scan reads the rows of a split in order and in one task, so the row
    numbers of a split are consecutive; only one row per split is aggregated
    and joined.
    """
    meta = F.col("_metadata")
    rows = scan.withColumns({"_id": F.monotonically_increasing_id(), "_path": meta["file_path"], "_block": meta["file_block_start"]})
    splits = rows.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return rows.join(splits, ["_path", "_block"]).withColumn("pos", F.col("_id") + F.col("_before"))


def read_training_log(spark: SparkSession, path: str, metrics: list[str], multi_line: bool = False,
                      on_missing: str = "fail") -> DataFrame:
    """Training-log entries as rows ``(pos, step, <metrics>)``.

    ``multi_line=True`` reads trainer-state documents ``{log_history: [...]}``
    (one small document per run; ``pos`` is the array position, the log
    order).  Otherwise each line is one entry (JSON Lines), which splits
    across tasks; ``pos`` is its place in its file.  An entry lacking one of ``metrics`` raises when the rows
    are computed (``on_missing='fail'``) or is dropped (``'skip'``).
    """
    if multi_line:
        struct_fields = ", ".join(["step: bigint", *[f"`{m}`: double" for m in metrics]])
        doc = spark.read.option("multiLine", True).schema(f"log_history array<struct<{struct_fields}>>").json(path)
        exploded = doc.select(F.posexplode("log_history").alias("pos", "e"))
        rows = exploded.select("pos", "e.step", *[F.col(f"e.`{m}`").alias(m) for m in metrics])
    else:
        fields = ", ".join([f"`{m}` double" for m in metrics])
        df = spark.read.schema(f"step long, {fields}").json(path)
        rows = _with_place(df).select("pos", "step", *[F.col(f"`{m}`") for m in metrics])
    missing = F.lit(False)
    for m in metrics:
        missing = missing | F.col(f"`{m}`").isNull()
    if on_missing == "skip":
        return rows.where(~missing)
    if on_missing == "fail":
        check = F.when(missing, F.raise_error(F.concat(F.lit("log entry without a metric value at step "),
                                                        F.col("step").cast("string"))))
        # the filter evaluates the check on every row, so a bad entry raises
        return rows.where(check.isNull())
    raise ValueError("on_missing must be 'fail' or 'skip'")


def write_csv(df: DataFrame, path: str, index: bool = False, order: list[str] | None = None,
              mode: str = "overwrite") -> None:
    """CSV with header; nested columns as JSON text; optional ``index`` column
    (0-based position in ``order``, computed with a distributed prefix count)."""
    from pyspark.sql.types import ArrayType, MapType

    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (StructType, ArrayType, MapType))
            else F.col(f.name) for f in df.schema.fields]
    out = df.select(*cols)
    if index:
        from leafwise.operators.scan import row_index

        out = row_index(out.withColumn("_g", F.lit(0)), ["_g"], order or out.columns, name="index").drop("_g")
        out = out.select("index", *[c for c in out.columns if c != "index"])
    _csv_writer(out, mode).csv(path)


def write_named_csv(df: DataFrame, key: str, root: str, name_format: str = "{key}.csv") -> list[str]:
    """Write one CSV file per ``key`` value named ``name_format`` (the
    reference's file-per-model layout).

    Rows are written partitioned by ``key`` with one writer per key, then
    each part file is renamed through the Hadoop file system (metadata only;
    no data passes through the driver).  A file is one writer by nature, so
    this is for handing small families to tools that expect the flat
    layout; at scale use :func:`write_partitioned_csv`.
    """
    spark = df.sparkSession
    staging = root.rstrip("/") + "/_staging"
    _csv_writer(df.repartition(key), "overwrite").partitionBy(key).csv(staging)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(staging).getFileSystem(conf)
    written = []
    for status in fs.listStatus(Path(staging)):
        name = status.getPath().getName()
        if not status.isDirectory() or "=" not in name:
            continue
        value = _unescape(name.split("=", 1)[1])
        parts = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().endswith(".csv")]
        if len(parts) != 1:
            raise RuntimeError(f"expected one part file for {key}={value}, found {len(parts)}")
        target = Path(f"{root.rstrip('/')}/{name_format.format(key=value, ckpt=value)}")
        fs.rename(parts[0], target)
        written.append(str(target))
    fs.delete(Path(staging), True)
    return written


def _unescape(s: str) -> str:
    from urllib.parse import unquote

    return unquote(s)
