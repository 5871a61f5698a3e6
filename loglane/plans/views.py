"""Log tables made from the given tables, in Spark and in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.schema import as_logs


# Numbers for the lines of one document or conversation.
LINES = 1 << 31


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their JSON properties as text, under the event type."""
    return as_logs(table(spark, folder, "events"), seq="event_id", service="event_type", text="props")


def logs_msg(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ``LEVEL user=.. k=..`` lines of eight services."""
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "INFO")
    ).otherwise("DEBUG")
    k = F.regexp_extract("props", "[0-9]+", 0)
    text = F.concat(level, F.lit(" user="), F.col("user_id"), F.lit(" k="), k)
    service = F.concat(F.lit("svc"), F.col("user_id") % 8)
    return as_logs(table(spark, folder, "events"), seq="event_id", service=service, text=text)


def stamped(spark: SparkSession, folder: str) -> DataFrame:
    """``logs`` with a leading time in one of three layouts, or none, by event type."""
    df = logs(spark, folder)
    service = F.col("service")
    time = (
        F.when(service == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z '"))
        .when(service == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss "))
        .when(service == "signup", F.date_format("ts", "MMM d HH:mm:ss "))
        .otherwise("")
    )
    return df.withColumn("text", F.concat(time, "text"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents line by line, under their language."""
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    # No text has more than 2**31 lines; an id too large for this fails.
    lines = lines.withColumn("seq", F.col("doc_id") * LINES + F.col("i"))
    at = "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, (doc_id * 100000 + i) / 1000.0BD)"
    lines = lines.withColumn("ts", F.expr(at))
    return as_logs(lines, service="lang", text="line")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns, under their role; one turn per minute."""
    df = table(spark, folder, "conversations")
    df = df.withColumn("seq", F.col("conv_id") * LINES + F.col("turn"))
    at = "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, CAST(conv_id * 1000 + turn AS DECIMAL(18, 0)))"
    df = df.withColumn("ts", F.expr(at))
    return as_logs(df, service="role")


def bursts(spark: SparkSession, folder: str) -> DataFrame:
    """``logs`` at a coarse clock of one hour, so that many lines share a time."""
    return logs(spark, folder).withColumn("ts", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))


# The same views for the SQL side. The last entries are expressions used in several queries.
SQL = {
    "logs": "logs AS (SELECT event_id AS seq, event_type AS service, props AS text, ts FROM events)",
    "logs_msg": """logs_msg AS (SELECT event_id AS seq, 'svc' || (user_id % 8) AS service,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
        ELSE 'DEBUG' END || ' user=' || user_id || ' k=' || regexp_extract(props, '[0-9]+') AS text, ts
        FROM events)""",
    "stamped": """stamped AS (SELECT event_id AS seq, event_type AS service,
        CASE event_type WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ ')
        WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S ')
        WHEN 'signup' THEN strftime(ts, '%b %-d %H:%M:%S ') ELSE '' END || props AS text, ts FROM events)""",
    "doc_lines": """doc_lines AS (SELECT doc_id * 2147483648 + i - 1 AS seq, lang AS service, parts[i] AS text,
        TIMESTAMP '2024-01-01' + to_milliseconds(doc_id * 100000 + i - 1) AS ts
        FROM (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)))""",
    "turns": """turns AS (SELECT conv_id * 2147483648 + turn AS seq, role AS service, text,
        TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 + turn) AS ts FROM conversations)""",
    "bursts": """bursts AS (SELECT event_id AS seq, event_type AS service, props AS text,
        date_trunc('hour', ts)::TIMESTAMP AS ts FROM events)""",
}
TRIM = r"regexp_replace({}, '^[\pZ\t-\r\x{{85}}]+|[\pZ\t-\r\x{{85}}]+$', '', 'g')"


def sql_norm(text: str = "text") -> str:
    return TRIM.format(f"lower({text})")


def with_views(sql: str) -> str:
    """Put the views a query uses in front of it."""
    import re

    used = [d for name, d in SQL.items() if re.search(rf"\b{name}\b", sql)]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return start + ", ".join(used) + ", " + body[len(start) :]
    return "WITH " + ", ".join(used) + " " + body
