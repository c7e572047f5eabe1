"""Batch sinks, the keyed table, and per-batch stream sinks.

Files are written by as many tasks as the data has; ``n_files`` is an explicit choice of
the caller, never a default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

BatchWriter = Callable[[DataFrame, int], None]


def _sized(df: DataFrame, n_files: int | None) -> DataFrame:
    return df if n_files is None else df.repartition(n_files)


def write_csv(
    df: DataFrame,
    path: str,
    header: bool = True,
    delimiter: str = ",",
    mode: str = "overwrite",
    n_files: int | None = None,
) -> None:
    (
        _sized(df, n_files)
        .write.mode(mode)
        .option("header", header)
        .option("sep", delimiter)
        .option("timestampFormat", "yyyy/MM/dd HH:mm:ss")
        .csv(path)
    )


def write_lines(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    delimiter: str = ",",
    overwrite: bool = True,
    n_files: int | None = None,
) -> None:
    """One text line per row. With ``overwrite=False`` an existing path is an error."""
    line = F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    mode = "overwrite" if overwrite else "errorifexists"
    _sized(df.select(line.alias("value")), n_files).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", n_files: int | None = None) -> None:
    _sized(df, n_files).write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """One folder per value of ``by``; a later run replaces only the folders it writes.

    Rebalancing gathers each folder's rows into few files and splits a folder that is much
    larger than the others over several tasks.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(fmt)
        .save(path)
    )


def as_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


# --- keyed table ----------------------------------------------------------------------


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest: Sequence[str]
) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` columns, compared in order.

    The rank is limited before the shuffle too, so a key with very many versions sends one row a
    task. The remaining columns break ties, which keeps reruns equal.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [*newest, *[c for c in rest if c not in newest]]
    if not order:
        return df.distinct()
    best = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def stored_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The parquet table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert(
    batch: DataFrame, path: str, key: str, newest: Sequence[str], partition: str
) -> None:
    """Merge a batch into the keyed table at ``path``; applying it twice changes nothing.

    ``partition`` must be a function of the key (a day or month of it), so that all
    versions of a key share a folder. Only the folders that the batch touches are read and
    replaced. For small, frequent batches use ``delta_sink``, which rewrites nothing.
    """
    merged = batch
    stored = stored_table(batch.sparkSession, path, batch.schema)
    if stored is not None:
        # A join prunes the folders at run time, however many periods the batch has; NULL is one of them.
        touched = batch.select(F.col(partition).alias("_touched")).distinct()
        same = stored[partition].eqNullSafe(F.col("_touched"))
        merged = stored.join(touched, same, "left_semi").unionByName(batch)
    write_partitioned(latest_per_key(merged, [key], newest), path, [partition])


# --- micro-batches --------------------------------------------------------------------


QUERY_ID = "sql.streaming.queryId"  # the thread that runs a micro-batch carries its query's id


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()) if files.exists(where) else []


def delta_sink(path: str, n_files: int | None = None) -> BatchWriter:
    """Per-batch sink that keeps each micro-batch in a folder of its own.

    A replayed batch replaces its own folder, so the sink is idempotent, and no batch
    rereads or rewrites what earlier ones wrote. Each query has its own run below the table
    (``run=<number>-<query id>``, numbered as they first appear), so a second query, or one that
    starts over with a new checkpoint, adds to the table. A restart from its checkpoint goes on in its
    run. ``n_files`` limits the files of small, frequent batches; ``compact`` folds a long
    history into one folder.
    """
    runs: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty(QUERY_ID) or "batch"
        if query not in runs:
            known = [f for f in _folders(spark, path) if f.startswith("run=")]
            mine = [f for f in known if f.endswith(f"-{query}")]
            runs[query] = mine[-1] if mine else f"run={len(known):08d}-{query}"
        _sized(batch, n_files).write.mode("overwrite").parquet(f"{path}/{runs[query]}/batch_id={batch_id}")

    return write


def _batches(spark: SparkSession, path: str) -> list[str]:
    runs = [f for f in _folders(spark, path) if f.startswith("run=")]
    return [f"{run}/{b}" for run in runs for b in _folders(spark, f"{path}/{run}") if b.startswith("batch_id=")]


def _base(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last finished compaction, 0 for none, and the batches it covers."""
    bases = [f for f in _folders(spark, f"{path}/_bases") if f.startswith("covered-")]
    if not bases:
        return 0, []
    covered = spark.read.text(f"{path}/_bases/{bases[-1]}")
    return int(bases[-1].removeprefix("covered-")), [r[0] for r in covered.toLocalIterator()]


def read_deltas(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches of all runs, with ``run`` and ``batch_id``.

    What was compacted is read from its base instead, as the empty run, older than all others.
    """
    with_batch = StructType.fromJson(schema.jsonValue()).add("run", StringType()).add("batch_id", LongType())
    number, covered = _base(spark, path)
    fresh = sorted(set(_batches(spark, path)) - set(covered))
    parts = []
    if fresh:
        folders = [f"{path}/{b}" for b in fresh]
        parts.append(spark.read.schema(with_batch).option("basePath", path).parquet(*folders))
    if number:
        base = spark.read.schema(schema).parquet(f"{path}/_bases/base-{number:08d}")
        parts.append(base.withColumns({"run": F.lit(""), "batch_id": F.lit(-1).cast("bigint")}))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], with_batch)


def compact(
    spark: SparkSession, path: str, schema: StructType, fold: Callable[[DataFrame], DataFrame], key: str
) -> None:
    """Fold the base and all finished batches into a new base, sorted by key, and retire them.

    ``fold`` takes the rows with ``run`` and ``batch_id`` and returns the current state without them. The
    list of covered batches is written last and makes the base valid: readers take it whole
    or not at all. Only then the covered batches and older bases are deleted, so the number of files
    that a reader opens follows the state and the batches since, not the history. Run one
    compaction at a time; streams may go on writing.
    """
    number, covered = _base(spark, path)
    done = _batches(spark, path)
    state = fold(read_deltas(spark, path, schema)).select(*schema.names)
    write_sorted_by_key(state, f"{path}/_bases/base-{number + 1:08d}", key)
    names = spark.createDataFrame([(b,) for b in sorted({*done, *covered})], "value string")
    names.coalesce(1).write.mode("overwrite").text(f"{path}/_bases/covered-{number + 1:08d}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f for f in _folders(spark, f"{path}/_bases") if int(f.rpartition("-")[2]) <= number]
    for folder in [*done, *(f"_bases/{f}" for f in old)]:
        files.delete(hadoop.Path(f"{path}/{folder}"), True)


def latest_deltas(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]
) -> DataFrame:
    """Current row per key: the one of the last run and in it the last batch that wrote the key."""
    return latest_of(keys)(read_deltas(spark, path, schema))


def latest_of(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The fold of a table of rows."""
    return lambda rows: latest_per_key(rows, keys, ["run", "batch_id"]).drop("run", "batch_id")


DELETED, CLEARED = "_deleted", "_cleared"


def with_marks(schema: StructType) -> StructType:
    """The schema of a table whose batches hold delete markers beside rows."""
    return StructType.fromJson(schema.jsonValue()).add(DELETED, BooleanType()).add(CLEARED, ArrayType(StringType()))


def changes(
    schema: StructType,
    keys: Sequence[str],
    puts: DataFrame | None = None,
    deleted: DataFrame | None = None,
    cleared: Sequence[tuple[DataFrame, Sequence[str]]] = (),
) -> DataFrame:
    """One batch for ``delta_sink``: rows to put, keys whose rows go, and keys whose cells in some columns go.

    Within a batch the markers come first, so a row that is deleted and put by one batch stays as put.
    """
    marked = with_marks(schema)
    parts = [] if puts is None else [(puts, {DELETED: F.lit(None), CLEARED: F.lit(None)})]
    parts += [] if deleted is None else [(deleted.select(*keys).distinct(), {DELETED: F.lit(True), CLEARED: F.lit(None)})]
    for rows, columns in cleared:
        unknown = sorted(set(columns) - set(schema.names) | set(columns) & set(keys))
        if unknown:
            raise ValueError(f"no such cells: {unknown}")
        parts.append((rows.select(*keys).distinct(), {DELETED: F.lit(None), CLEARED: F.array(*[F.lit(c) for c in columns])}))

    def whole(rows: DataFrame, marks: dict[str, Column]) -> DataFrame:
        value = lambda f: marks.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None))
        return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in marked])

    return reduce(DataFrame.unionByName, [whole(*p) for p in parts])


def _moment() -> Column:
    """The order of batches: by run, then number; what was compacted comes before all."""
    run = F.substring("run", 1, 8).cast("bigint")
    return F.when(F.col("run") == "", F.lit(-1)).otherwise(run * (1 << 40) + F.col("batch_id"))


def current_of(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The fold of a table of rows and delete markers (``with_marks``).

    The last row of each key counts, unless a later batch deletes it; cells that a later batch clears are NULL.
    """

    def fold(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in ("run", "batch_id", DELETED, CLEARED)]
        cells = [c for c in columns if c not in keys]
        is_mark = F.coalesce(DELETED, F.lit(False)) | F.col(CLEARED).isNotNull()
        timed = rows.withColumn("_at", _moment())
        newest = latest_per_key(timed.filter(~is_mark).select(*columns, "_at"), keys, ["_at"])
        gone = F.max(F.when(F.col(DELETED), F.col("_at"))).alias("_gone")
        emptied = [F.max(F.when(F.array_contains(CLEARED, c), F.col("_at"))).alias(f"_cleared_{i}") for i, c in enumerate(cells)]
        marks = timed.filter(is_mark).groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(gone, *emptied)
        same = reduce(Column.__and__, [newest[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys])
        held = newest.join(marks, same, "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_at")))
        later = lambda i: F.coalesce(F.col(f"_cleared_{i}") > F.col("_at"), F.lit(False))
        kept = {c: F.when(~later(i), F.col(c)).alias(c) for i, c in enumerate(cells)}
        none = [F.lit(None).cast("boolean").alias(DELETED), F.lit(None).cast("array<string>").alias(CLEARED)]
        return held.select(*[kept.get(c, F.col(c)) for c in columns], *none)

    return fold


def current_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """What a table of rows and delete markers holds now."""
    return current_of(keys)(read_deltas(spark, path, with_marks(schema))).select(*schema.names)


def sum_of(keys: Sequence[str], counter: str) -> Callable[[DataFrame], DataFrame]:
    """The fold of a table of increments."""
    return lambda rows: rows.groupBy(*keys).agg(F.sum(counter).alias(counter))


def summed_deltas(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], counter: str
) -> DataFrame:
    """Current counters of a stream that emits increments."""
    return sum_of(keys, counter)(read_deltas(spark, path, schema))


def write_sorted_by_key(df: DataFrame, path: str, key: str) -> None:
    """A compacted keyed table: range-partitioned and sorted, so that the statistics of
    each file let a lookup or range scan of the key skip all others."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def kept_up(
    spark: SparkSession,
    path: str,
    files: dict[str, str],
    fresh: Callable[[list[str]], DataFrame],
    merged: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """An aggregate of a table's ``files`` that is stored at ``path`` and reads each file once.

    ``fresh`` aggregates some files and ``merged`` joins two aggregates. ``files`` are the table's files with what
    tells their versions apart. If one that is already in the aggregate has changed or is gone, all are
    read again. The list of covered files is written last and makes a version valid; the version
    before it stays for readers that have it open. Run one update at a time.
    """
    done = [f for f in _folders(spark, path) if f.startswith("covered-")]
    number = int(done[-1].removeprefix("covered-")) if done else 0
    known = {f"{f} {v}" for f, v in files.items()}
    covered = {r[0] for r in spark.read.text(f"{path}/{done[-1]}").toLocalIterator()} if done else set()
    table = spark.read.parquet(f"{path}/table-{number:08d}") if done else None
    if done and covered == known:
        return table
    if not covered <= known:
        covered, table = set(), None
    more = fresh(sorted(f for f, v in files.items() if f"{f} {v}" not in covered))
    now = more if table is None else merged(table, more)
    now.write.mode("overwrite").parquet(f"{path}/table-{number + 1:08d}")
    names = spark.createDataFrame([(n,) for n in sorted(known)], "value string")
    names.coalesce(1).write.mode("overwrite").text(f"{path}/covered-{number + 1:08d}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in _folders(spark, path):
        if int(folder.rpartition("-")[2]) < number:
            system.delete(hadoop.Path(f"{path}/{folder}"), True)
    return spark.read.schema(now.schema).parquet(f"{path}/table-{number + 1:08d}")


def jdbc_sink(url: str, table: str, properties: dict[str, str]) -> BatchWriter:
    """Insert each micro-batch, one connection per partition; the table holds ``batch_id``.

    Inserts are at-least-once: a reader drops a replayed batch by (batch_id, key).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        tagged.write.jdbc(url, table, mode="append", properties=properties)

    return write


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish the text columns ``key`` and ``value``."""
    return (
        stream.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def console_sink(stream: DataFrame, checkpoint: str, rows: int = 10):
    return (
        stream.writeStream.format("console")
        .option("numRows", rows)
        .option("checkpointLocation", checkpoint)
    )
