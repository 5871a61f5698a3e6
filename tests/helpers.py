"""What several test modules share."""

from datetime import datetime

from pyspark.sql import types as T

T0 = datetime(2024, 3, 15, 9, 0, 0)

SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("service", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)


def texts(df):
    return [r["text"] for r in df.orderBy("seq").collect()]
