"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark import schemas
from guardspark.config import EngineConfig


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.REQUESTS).format(fmt).load(path)


def read_outputs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.OUTPUTS).format(fmt).load(path)


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).parquet(path)


def read_corpus_parts(spark: SparkSession, vectors_path: str, metadata_path: str) -> DataFrame:
    """A corpus kept as vectors (index, embedding) and a JSON list of their
    metadata; vectors without metadata stay."""
    vectors = spark.read.parquet(vectors_path)
    info = spark.read.option("multiLine", True).json(metadata_path)
    return vectors.join(info, "index", "left")


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").parquet(path)


def write_audit(audit: DataFrame, path: str, records_per_file: int = 500_000) -> None:
    """JSON lines in one folder for each day; files stay bounded."""
    audit.write.mode("append").option("maxRecordsPerFile", records_per_file).partitionBy("event_date").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).json(path)


#: Bytes of an audit file that is neither too small nor too large.
FILE_BYTES = 256 << 20


def compact_audit(spark: SparkSession, path: str, day: str, file_bytes: int = FILE_BYTES) -> int:
    """Write a day's files anew, each of at most ``file_bytes`` (a single row
    may be longer), and return how many there are now.  The new folder takes
    the old one's place by two renames; a run that broke off in between is
    mended by the next one, and a day whose files fit already is left alone.
    Nothing may write to the day meanwhile."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    own, new, old = (f"{path}/{x}event_date={day}" for x in ("", "_new-", "_old-"))
    if fs.exists(at(old)):  # a run broke off: the old rows stand until the new ones have their place
        if fs.exists(at(own)):
            fs.delete(at(old), True)
        else:
            fs.rename(at(old), at(own))
    if not fs.exists(at(own)):
        return 0
    sizes = lambda p: [f.getLen() for f in fs.listStatus(at(p)) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    have = sizes(own)
    least = -(-sum(have) // file_bytes)
    if len(have) <= max(1, 2 * least) and max(have, default=0) <= file_bytes:
        return len(have)
    lines, n = spark.read.text(own), max(1, least)
    while True:
        lines.repartition(n).write.mode("overwrite").text(new)
        made = sizes(new)
        if max(made, default=0) <= file_bytes or n > 4 * len(have) + 4 * least:
            break
        n = n * 5 // 4 + 1
    fs.rename(at(own), at(old))
    fs.rename(at(new), at(own))
    fs.delete(at(old), True)
    return len(made)


def drop_old_audit(spark: SparkSession, path: str, today: str, days: int) -> list[str]:
    """Remove the folders of days before ``today`` - ``days``, whether they lie
    in ``path`` itself or in the folder of a micro-batch; 0 keeps all."""
    if days <= 0:
        return []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    cut = str(date.fromisoformat(today) - timedelta(days=days))
    folders = [f.getPath() for f in fs.listStatus(root) if f.isDirectory()]
    for f in [f for f in folders if f.getName().startswith("batch=")]:
        folders += [x.getPath() for x in fs.listStatus(f) if x.isDirectory()]
    gone = [f for f in folders if f.getName().startswith("event_date=") and f.getName().removeprefix("event_date=") < cut]
    for f in gone:
        fs.delete(f, True)
    return sorted(f.getName() for f in gone)


def _flat(df: DataFrame) -> DataFrame:
    """Lists, structs and maps as JSON."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})


def jdbc_store(url: str, table: str, user: str = "", password: str = "", **options: str) -> Callable[[DataFrame, int], None]:
    """For ``audit_sink``: a table in which every row of a batch stands once,
    however often the batch is run and wherever a run broke off.  Tasks write
    the batch into a table of its own; one transaction of the driver then
    replaces what ``table`` holds of that ``batch_id`` and takes the staged
    rows over, inside the store.  ``options`` go to Spark's JDBC writer."""
    options = {"url": url, **({"user": user, "password": password} if user else {}), **options}

    def write(batch: DataFrame, batch_id: int) -> None:
        jvm = batch.sparkSession._jvm
        rows = _flat(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        staged = f"{table}_batch_{batch_id}"
        rows.write.format("jdbc").options(**options, dbtable=staged).mode("overwrite").save()
        rows.limit(0).write.format("jdbc").options(**options, dbtable=table).mode("append").save()  # makes the table
        columns = ", ".join(f'"{c}"' for c in rows.columns)
        link = jvm.java.sql.DriverManager.getConnection(url, user, password) if user else jvm.java.sql.DriverManager.getConnection(url)
        try:
            link.setAutoCommit(False)
            with_ = link.createStatement()
            with_.executeUpdate(f'DELETE FROM {table} WHERE "batch_id" = {int(batch_id)}')
            with_.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged}")
            link.commit()
            with_.executeUpdate(f"DROP TABLE {staged}")
            link.commit()
        except Exception:
            link.rollback()
            raise
        finally:
            link.close()

    return write


def audit_sink(path: str, primary: Callable[[DataFrame, int], None] | None = None, cfg: EngineConfig | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the primary store if there is one, JSON lines if
    there is none or it fails.  A batch that is run again replaces its own
    files; once it is in the store its files go, so each row is in one place.
    With ``cfg`` days older than ``retention_days`` are removed as a new day
    begins."""
    seen: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{path}/batch={batch_id}"
        stored = False
        if primary is not None:
            try:
                primary(batch, batch_id)
                stored = True
            except Exception as e:
                print(f"audit store failed, writing files instead: {type(e).__name__}")
        if stored:
            remove(spark, own)
        else:
            batch.write.mode("overwrite").partitionBy("event_date").json(own)
        if cfg is not None and (today := date.today().isoformat()) not in seen:
            drop_old_audit(spark, path, today, cfg.retention_days)
            seen[:] = [today]

    return write


def remove(spark: SparkSession, path: str) -> None:
    """A folder or file, wherever it lies, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def webhook_sink(send: Callable[[str], int]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one call for each escalated row, from the tasks;
    failures are dropped as they are in the row's response."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def rows(part):
            for r in part:
                try:
                    send(r.payload)
                except Exception:
                    continue

        payload = F.to_json(F.struct("verdict", F.size("findings").alias("findings_count"), F.col("reason").alias("arbitration_reason")))
        batch.where("verdict = 'escalate'").select(payload.alias("payload")).foreachPartition(rows)

    return write
