"""Streams: requests line by line, and notices told once for each session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import layer1, redact, texts

REQUEST = T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("options", T.StructType([T.StructField("web", T.BooleanType())]))])
#: Longest request, in bytes.
REQUEST_CAP = 10 * 1024 * 1024


OPERATIONS = ("sanitize", "sanitizeText", "classifyPrompt", "scanText", "redact")


def answer(lines: DataFrame) -> DataFrame:
    """(id, op, cleaned, action, findings, error) for each JSON line of a batch or stream.

    sanitize and sanitizeText strip, redact also takes secrets out (option web:
    the text comes from outside), classifyPrompt judges, scanText lists hidden runs.
    A bad or oversized line is an error row and stops nothing.
    """
    parsed = F.from_json("value", REQUEST, {"mode": "PERMISSIVE"})
    rows = lines.select(F.when(F.octet_length("value") <= REQUEST_CAP, F.col("value")).alias("value")).withColumn("r", parsed)
    error = F.when(F.col("value").isNull(), "request too large").when(F.col("r.op").isNull(), "not a request").when(~F.col("r.op").isin(*OPERATIONS), "unknown op").when(F.col("r.text").isNull(), "text is not a string")
    rows = rows.select(F.col("r.id").alias("id"), F.col("r.op").alias("op"), F.col("r.text").alias("text"), F.coalesce("r.options.web", F.lit(False)).alias("web"), error.alias("error"))
    good = lambda *ops: F.when(F.col("error").isNull() & F.col("op").isin(*ops), F.col("text"))
    rows = texts.prompt_verdicts(rows.withColumn("__p", good("classifyPrompt")), "__p", "__v")
    rows = redact.redact(rows.withColumn("__r", layer1.native(good("redact"))), "__r", ~F.col("web"), "__l4")
    rows = rows.withColumn("__f", texts._findings(good("scanText")))
    cleaned = F.coalesce(layer1.native(good("sanitize", "sanitizeText")), F.when(F.col("__r").isNotNull(), F.col("__l4.view")))
    error = F.coalesce("error", F.when(F.col("__r").isNotNull(), F.col("__l4.error")))
    return rows.select("id", "op", cleaned.alias("cleaned"), F.when(F.col("__p").isNotNull(), F.col("__v.action")).alias("action"), F.when(good("scanText").isNotNull(), F.col("__f")).alias("findings"), error.alias("error"))


LEVELS = ("off", "info", "debug")


def trace(events: DataFrame, level: str = "off") -> DataFrame:
    """(line): one JSON text for each event (level, ...) of this level or a quieter one; nothing when off."""
    if level not in LEVELS:
        raise ValueError(f"level is one of {', '.join(LEVELS)}")
    shown = LEVELS[1 : LEVELS.index(level) + 1]
    return events.where(F.col("level").isin(*shown) if shown else F.lit(False)).select(F.to_json(F.struct(*events.columns)).alias("line"))


def unacknowledged(found: DataFrame, acks: DataFrame, session: str = "session", time: str = "time", days: int = 7) -> DataFrame:
    """Alerts no older than ``days`` that no later acknowledgement of their session covers."""
    young = found.where(F.col(time) >= F.current_timestamp() - F.make_interval(days=F.lit(days)))
    last = acks.groupBy(F.col(session).alias("__s")).agg(F.max(time).alias("__t"))
    return young.join(last, (F.col(session) == F.col("__s")) & (F.col(time) <= F.col("__t")), "left_anti")


def slow_runs(runs: DataFrame, over: float = 1.0) -> DataFrame:
    """runs (seconds, cpu_seconds) of more than ``over`` seconds, with notice: how long, and whether they worked or waited."""
    waited = F.greatest(F.col("seconds") - F.col("cpu_seconds"), F.lit(0.0))
    kind = F.when(waited > F.col("cpu_seconds"), "waiting").otherwise("working")
    return runs.where(F.col("seconds") > over).withColumn("notice", F.concat(F.lit("took "), F.format_number("seconds", 1), F.lit(" s, mostly "), kind))


def once(stream: DataFrame, session: str, notice: str, time: str, within: str = "7 days") -> DataFrame:
    """The first row of each session and notice; state is forgotten after ``within``."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([session, notice])


def alerts(stream: DataFrame, session: str = "user_id") -> DataFrame:
    """(session, n_events, first_event): running state of each session."""
    return stream.groupBy(session).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a session on one machine without it uses its warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if system.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """once() for each user and type of event over a table read as a stream to its end, as a table."""
    out = _scratch(spark, "notices")
    kept = once(read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", "ts")
    q = kept.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/rows")


def run_alerts(spark: SparkSession, path: str) -> DataFrame:
    """alerts() over a table read as a stream to its end: the state after the last batch, as a table."""
    out = _scratch(spark, "alerts")
    state = alerts(read_table(spark, path))

    def replace(batch: DataFrame, n: int) -> None:
        batch.write.parquet(f"{out}/rows/{n}", mode="overwrite")

    q = state.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(f"{out}/rows/{q.lastProgress['batchId']}")
