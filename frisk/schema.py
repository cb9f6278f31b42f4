"""The canonical event schema every source is mapped to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("type", T.StringType()),        # txn | login
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),           # unique; orders rows that share a ts
    T.StructField("cust_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("mcc", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("beneficiary", T.StringType()),  # '' = none
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("card_bin", T.StringType()),     # '?' = unknown
    T.StructField("label", T.IntegerType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("cust_age", T.IntegerType()),
    T.StructField("success", T.IntegerType()),     # login only
])

CUSTOMER = T.StructType([
    T.StructField("cust_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("home_country", T.StringType()),
    T.StructField("account_open", T.TimestampType()),
])

_FILL = {"type": "txn", "beneficiary": "", "card_bin": "?", "label": 0}


def canonical(df: DataFrame, *extra: str) -> DataFrame:
    """Project any frame onto the canonical columns (and ``extra``); absent ones get their default."""
    cols = []
    for f in EVENT.fields:
        if f.name not in df.columns:
            c = F.lit(_FILL.get(f.name))
        elif f.name in _FILL:
            c = F.coalesce(F.col(f.name), F.lit(_FILL[f.name]))
        else:
            c = F.col(f.name)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *extra)
