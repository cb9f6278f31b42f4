"""Public fraud-data layouts to canonical events.

Each mapper takes a frame of strings with the layout's headers and returns EVENT columns; a
column the file lacks reads as absent.  Files are read with their own header and every column as
string (never inferred), so pushdown and pruning stay with the CSV or parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.functions.expr import lookup, short_hash
from frisk.schema import canonical

EPOCH_S = 1_577_836_800  # 2020-01-01, the origin of relative times

# fixed values: channel, category and type tables of the layouts
IEEE_CHANNEL = {"W": "pos", "C": "online", "R": "online", "H": "online", "S": "transfer"}
PAYSIM_TYPE = {
    "CASH_IN": ("bank_transfer", "transfer"),
    "CASH_OUT": ("atm_withdrawal", "atm"),
    "DEBIT": ("retail", "pos"),
    "PAYMENT": ("retail", "online"),
    "TRANSFER": ("wire_transfer", "transfer"),
}
BANK_CATEGORY = {
    "Grocery": "grocery", "Food Delivery": "restaurant", "Fuel": "transport",
    "Utilities": "utilities", "Hospital": "utilities", "Education": "utilities",
    "Financial Services": "utilities", "Fashion": "retail", "Pharmacy": "retail",
    "Ecommerce": "retail", "Entertainment": "entertainment", "Electronics": "electronics",
    "Hotel": "travel", "Travel": "travel", "Airline": "travel",
}
# underscores are stripped before this table is read, so only keys without one ever match
CARD_CATEGORY = {
    "grocerypos": "grocery", "grocerynet": "grocery", "shoppingpos": "retail",
    "shoppingnet": "retail", "gasttransport": "transport",
    "miscpos": "retail", "entertainment": "entertainment", "travel": "travel", "home": "retail",
}


def text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def filled(df: DataFrame, name: str, default: str) -> Column:
    """The column, with absent or empty replaced."""
    return F.coalesce(F.nullif(text(df, name), F.lit("")), F.lit(default))


def lenient(df: DataFrame, *names: str, default: float = 0.0) -> Column:
    """First column that parses as a number, else the default; blanks and NaN are skipped."""
    tries = []
    for n in names:
        v = F.trim(text(df, n)).try_cast("double")
        tries.append(F.when(~F.isnan(v), v))
    return F.coalesce(*tries, F.lit(default))


def _since_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.floor((seconds + EPOCH_S) * 1_000_000).cast("long"))


def category(raw: Column) -> Column:
    clean = F.replace(F.replace(F.lower(raw), F.lit(" ")), F.lit("-"))
    return F.coalesce(lookup(CARD_CATEGORY, clean), F.lit("retail"))


def sparkov(df: DataFrame) -> DataFrame:
    cc = F.coalesce(text(df, "cc_num"), F.lit("unknown"))
    cat = F.replace(filled(df, "category", "retail"), F.lit("_"))
    stamp = F.try_to_timestamp(text(df, "trans_date_trans_time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.select(
        "*",
        F.coalesce(stamp, _since_epoch(lenient(df, "unix_time"))).alias("_ts"), F.concat(F.lit("cc_"), cc).alias("_cust"),
        lenient(df, "amt").alias("_amount"), category(cat).alias("_mcc"),
        F.when(cat.contains("net") | cat.contains("online"), "online").otherwise("pos").alias("_channel"),
        F.replace(filled(df, "merchant", "m"), F.lit("fraud_")).alias("_merchant"),
        F.coalesce(text(df, "city"), F.lit("")).alias("_city"), lenient(df, "lat").alias("_lat"), lenient(df, "long").alias("_lon"),
        F.concat(F.lit("card_"), cc).alias("_device"), F.substring(cc, 1, 6).alias("_bin"),
        lenient(df, "is_fraud").cast("int").alias("_label"), F.lit("US").alias("_country"), F.lit("").alias("_payee"))


def ieee(df: DataFrame) -> DataFrame:
    card, addr = F.coalesce(text(df, "card1"), F.lit("?")), F.coalesce(text(df, "addr1"), F.lit("?"))
    code = F.upper(filled(df, "ProductCD", "W"))
    return df.select(
        "*",
        _since_epoch(lenient(df, "TransactionDT")).alias("_ts"), F.concat(F.lit("ic_"), card, F.lit("_"), addr).alias("_cust"),
        lenient(df, "TransactionAmt").alias("_amount"), F.concat(F.lit("pcd_"), F.lower(code)).alias("_mcc"),
        F.coalesce(lookup(IEEE_CHANNEL, code), F.lit("online")).alias("_channel"),
        F.concat(card, F.lit("_"), code).alias("_merchant"), F.trim(F.coalesce(text(df, "P_emaildomain"), F.lit(""))).alias("_payee"),
        F.lit("US").alias("_country"), F.coalesce(text(df, "addr1"), F.lit("")).alias("_city"),
        F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"),
        F.trim(F.coalesce(F.nullif(text(df, "DeviceInfo"), F.lit("")), F.concat(F.lit("card_"), card))).alias("_device"),
        card.alias("_bin"), lenient(df, "isFraud").cast("int").alias("_label"))


def ulb(df: DataFrame) -> DataFrame:
    """Raw mode: V1..V28 and Amount become ``raw_features``; identities are constant."""
    names = [f"V{i}" for i in range(1, 29)] + ["Amount"]
    raw = F.create_map(*[x for n in names for x in (F.lit(n), lenient(df, n))])
    one = F.lit("ulb")
    return df.select(
        "*",
        _since_epoch(lenient(df, "Time")).alias("_ts"), one.alias("_cust"), lenient(df, "Amount").alias("_amount"),
        F.lit("retail").alias("_mcc"), F.lit("online").alias("_channel"), one.alias("_merchant"), F.lit("").alias("_payee"),
        F.lit("US").alias("_country"), F.lit("").alias("_city"), F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"),
        one.alias("_device"), one.alias("_bin"), lenient(df, "Class").cast("int").alias("_label"), raw.alias("raw_features"))


def upi(df: DataFrame) -> DataFrame:
    """Settled payments only; rows without a readable time are dropped."""
    device = F.trim(filled(df, "device_fingerprint", "unknown"))
    bank, app = F.trim(filled(df, "bank", "bank")), F.trim(filled(df, "upi_app", "upi"))
    out = df.select(
        "*",
        F.try_to_timestamp(text(df, "timestamp")).alias("_ts"), F.concat(F.lit("upi_"), device).alias("_cust"),
        lenient(df, "amount").alias("_amount"), F.lit("upi_transfer").alias("_mcc"), F.lit("transfer").alias("_channel"),
        F.concat(bank, F.lit("_"), app).alias("_merchant"), F.lit("").alias("_payee"), F.lit("IN").alias("_country"),
        F.lit("").alias("_city"), F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"), device.alias("_device"),
        short_hash(bank).alias("_bin"),
        F.when(F.lower(F.trim(text(df, "is_suspicious"))) == "true", 1).otherwise(0).alias("_label"))
    settled = F.lower(F.trim(F.coalesce(text(df, "status"), F.lit("")))) == "success"
    return out.filter(settled & F.col("_ts").isNotNull())


def compressed_amount(raw: Column) -> Column:
    """A simulation amount mapped by its logarithm onto the 50 to 20,000 rupee range."""
    t = F.greatest(F.lit(-0.2), F.least(F.lit(1.2), (F.log1p(raw) - 5.0) / 11.0))
    lo, hi = F.log(F.lit(50.0)), F.log(F.lit(20000.0))
    return F.when(raw <= 0, 1.0).otherwise(F.round(F.exp(lo + t * (hi - lo)), 2))


def paysim(df: DataFrame) -> DataFrame:
    cust, dest = F.trim(filled(df, "nameOrig", "unknown")), F.trim(F.coalesce(text(df, "nameDest"), F.lit("")))
    kind = F.upper(F.trim(filled(df, "type", "PAYMENT")))
    mcc = F.coalesce(lookup({k: v[0] for k, v in PAYSIM_TYPE.items()}, kind), F.lit("retail"))
    channel = F.coalesce(lookup({k: v[1] for k, v in PAYSIM_TYPE.items()}, kind), F.lit("online"))
    hours = lenient(df, "step").cast("long")
    return df.select(
        "*",
        _since_epoch(hours * 3600).alias("_ts"), F.concat(F.lit("ps_"), cust).alias("_cust"),
        compressed_amount(lenient(df, "amount")).alias("_amount"), mcc.alias("_mcc"), channel.alias("_channel"),
        F.when(dest != "", dest).otherwise(F.concat(F.lit("ps_merchant_"), F.lower(kind))).alias("_merchant"),
        F.when(channel == "transfer", dest).otherwise("").alias("_payee"), F.lit("IN").alias("_country"), F.lit("").alias("_city"),
        F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"), F.concat(F.lit("ps_dev_"), cust).alias("_device"),
        short_hash(cust).alias("_bin"), lenient(df, "isFraud").cast("int").alias("_label"))


def india_bank(df: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Successful rows only; ``ages`` (Customer_ID, Age as text) is the optional customer table."""
    cust, method = F.trim(F.coalesce(text(df, "Customer_ID"), F.lit(""))), F.trim(F.coalesce(text(df, "Payment_Method"), F.lit("")))
    via = F.trim(F.coalesce(text(df, "Transaction_Channel"), F.lit("")))
    channel = (F.when(via == "ATM", "atm").when(via == "POS", "pos")
               .when(method.isin("UPI", "Net Banking"), "transfer").otherwise("online"))
    stamp = F.try_to_timestamp(F.concat_ws(" ", text(df, "Transaction_Date"), text(df, "Transaction_Time")), F.lit("yyyy-MM-dd HH:mm:ss"))
    abroad = F.trim(F.coalesce(text(df, "Is_International"), F.lit("0"))) == "1"
    out = df.select(
        "*",
        stamp.alias("_ts"), F.concat(F.lit("ib_"), cust).alias("_cust"), cust.alias("_raw_cust"),
        lenient(df, "Transaction_Amount").alias("_amount"),
        F.coalesce(lookup(BANK_CATEGORY, F.trim(F.coalesce(text(df, "Merchant_Category"), F.lit("")))), F.lit("retail")).alias("_mcc"),
        channel.alias("_channel"), F.trim(filled(df, "Merchant_ID", "ib_merchant")).alias("_merchant"), F.lit("").alias("_payee"),
        F.when(abroad, "XX").otherwise("IN").alias("_country"), F.trim(F.coalesce(text(df, "Merchant_City"), F.lit(""))).alias("_city"),
        F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"),
        F.concat(F.lit("ib_"), cust, F.lit("_"), F.replace(F.trim(filled(df, "Device_Type", "device")), F.lit(" "), F.lit("_"))).alias("_device"),
        F.trim(filled(df, "Card_ID", "?")).alias("_bin"), lenient(df, "Fraud_Flag").cast("int").alias("_label"))
    ok = F.trim(F.coalesce(text(df, "Transaction_Status"), F.lit(""))) == "Successful"
    out = out.filter(ok & F.col("_ts").isNotNull())
    if ages is None:
        return out
    known = ages.select(F.col("Customer_ID").alias("_raw_cust"), F.col("Age").try_cast("double").cast("int").alias("_age"))
    known = known.filter("_age IS NOT NULL").groupBy("_raw_cust").agg(F.max("_age").alias("_age"))
    return out.join(known, "_raw_cust", "left")


LAYOUTS: dict[str, Callable[..., DataFrame]] = {
    "sparkov": sparkov, "ieee": ieee, "ulb": ulb, "upi": upi, "paysim": paysim, "india_bank": india_bank,
}
_OUT = {"_ts": "ts", "_cust": "cust_id", "_amount": "amount", "_mcc": "mcc", "_channel": "channel", "_merchant": "merchant_id",
        "_payee": "beneficiary", "_country": "country", "_city": "city", "_lat": "lat", "_lon": "lon", "_device": "device_id",
        "_bin": "card_bin", "_label": "label", "_age": "cust_age"}


def to_events(df: DataFrame, layout: str, seq: Column | None = None, ages: DataFrame | None = None) -> DataFrame:
    """Map a frame of strings in a known layout; ``seq`` numbers the rows (default: unstable ids)."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout '{layout}' ({' | '.join(LAYOUTS)})")
    df = df.withColumn("_seq", F.monotonically_increasing_id() if seq is None else seq)
    m = india_bank(df, ages) if layout == "india_bank" else LAYOUTS[layout](df)
    cols = [F.col(k).alias(v) for k, v in _OUT.items() if k in m.columns]
    extra = ["raw_features"] if "raw_features" in m.columns else []
    out = m.select(F.col("_seq").alias("seq"), *cols, *extra)
    return canonical(out.withColumn("scenario", F.lit(f"dataset:{layout}")), *extra)


def read_csv(spark: SparkSession, path: str, layout: str, ages_path: str | None = None) -> DataFrame:
    """A CSV export with header, all columns as text, mapped to events."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout '{layout}' ({' | '.join(LAYOUTS)})")
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    ages = None if ages_path is None else spark.read.option("header", True).csv(ages_path)
    return to_events(df, layout, ages=ages)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file as a frame of strings named by its attributes.

    Lines are read split by split; the attribute block at the top (a few dozen lines) gives the
    names, and a data line is any line that is neither a directive nor a comment.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    lines = lines.filter(~F.col("line").startswith("%"))
    head = lines.filter(F.lower("line").startswith("@attribute"))
    names = [r["line"].split()[1].strip("'\"") for r in head.collect()]
    parts = F.split("line", ",")
    clean = lambda i: F.regexp_replace(F.trim(F.get(parts, F.lit(i))), "^['\"]+|['\"]+$", "")
    return lines.filter(~F.col("line").startswith("@")).select(*[clean(i).alias(n) for i, n in enumerate(names)])


def arff_counts(df: DataFrame, label: str = "Class") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == "1").alias("frauds"))


__all__ = ["LAYOUTS", "to_events", "read_csv", "read_arff", "arff_counts", "compressed_amount", "category", "lenient"]
