"""A bank analyst's own export: forgiving headers, strict rows, one reason per rejected row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frisk.functions.expr import lookup
from frisk.schema import canonical

# fixed values: accepted headers, channel spellings, categories, time formats, cities, label words
HEADERS = {
    "cust_id": ("cust_id", "customer_id", "customer", "account_id", "account", "payer", "payer_vpa"),
    "amount": ("amount", "amt", "txn_amount", "transaction_amount", "value", "amount_inr"),
    "ts": ("ts", "timestamp", "time", "datetime", "date", "txn_time", "transaction_time"),
    "merchant_id": ("merchant_id", "merchant", "merchant_name", "payee", "payee_vpa"),
    "mcc": ("mcc", "category", "merchant_category"),
    "channel": ("channel", "mode", "payment_mode", "type"),
    "city": ("city", "location"),
    "country": ("country", "country_code"),
    "device_id": ("device_id", "device", "device_fingerprint"),
    "beneficiary": ("beneficiary", "beneficiary_id", "beneficiary_account"),
    "cust_age": ("cust_age", "age", "customer_age"),
    "label": ("label", "is_fraud", "fraud", "isfraud"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "long", "longitude"),
}
CHANNEL_ALIASES = {
    "in-store": "pos", "instore": "pos", "store": "pos", "card": "pos", "pos": "pos",
    "online": "online", "web": "online", "ecommerce": "online", "e-commerce": "online", "app": "online",
    "atm": "atm", "cash": "atm", "withdrawal": "atm",
    "transfer": "transfer", "upi": "transfer", "neft": "transfer", "imps": "transfer",
    "rtgs": "transfer", "wire": "transfer", "p2p": "transfer",
    "p2m": "online", "billpay": "online", "recharge": "online",
}
CATEGORIES = (
    "grocery", "restaurant", "transport", "utilities", "retail", "entertainment",
    "travel", "electronics", "crypto", "gift_card", "wire_transfer", "upi_transfer",
    "bank_transfer", "atm_withdrawal",
)
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm",
    "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy",
)
CITIES = {
    "mumbai": (19.08, 72.88), "delhi": (28.61, 77.21), "new delhi": (28.61, 77.21),
    "bengaluru": (12.97, 77.59), "bangalore": (12.97, 77.59), "chennai": (13.08, 80.27),
    "hyderabad": (17.39, 78.49), "kolkata": (22.57, 88.36), "pune": (18.52, 73.86),
    "ahmedabad": (23.02, 72.57), "jaipur": (26.91, 75.79), "lucknow": (26.85, 80.95),
    "kochi": (9.93, 76.27), "chandigarh": (30.73, 76.78), "surat": (21.17, 72.83),
}
DEFAULT_CITY = "mumbai"
LABEL_TRUE = ("1", "1.0", "true", "yes", "y", "fraud")
LABEL_FALSE = ("0", "0.0", "false", "no", "n", "legit", "genuine")
LABEL_UNKNOWN = ("", "na", "n/a", "unknown", "?")
NO_TIME_WARNING = (
    "No timestamp column: rows were spread evenly over the last 24 hours in file order. Velocity signals "
    "(e.g. many payments in a few minutes) are only meaningful with real transaction times.")


def map_headers(columns: list[str]) -> dict[str, str]:
    """Canonical field -> header in this file; the first listed spelling that occurs wins."""
    seen = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in columns}
    found = {f: next((seen[a] for a in names if a in seen), None) for f, names in HEADERS.items()}
    found = {f: h for f, h in found.items() if h is not None}
    missing = [f for f in ("cust_id", "amount") if f not in found]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)} — found: {', '.join(columns)}")
    return found


def sniff_delimiter(header: str) -> str:
    """The most frequent of comma, semicolon and tab in the header line, quoted names left out."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max((",", ";", "\t"), key=bare.count)


def read_upload(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """The files as strings plus ``row_no`` (line in its file, header = 1) and ``row_id`` (unique in the delivery).

    Ids are exact however files are split: a row's place inside its split, plus the counted rows of the splits before it in
    the file and of the files before it.  ``line_breaks`` allows quoted line breaks, which keeps a file in one task (it is
    streamed); without them large files are split.
    """
    header = spark.read.text(path).limit(1).first()["value"].lstrip("\ufeff")
    raw = (spark.read.option("header", True).option("sep", sniff_delimiter(header)).option("inferSchema", False)
           .option("multiLine", line_breaks).option("quote", '"').option("escape", '"').csv(path))
    names = [c.lstrip("\ufeff").strip('"') for c in raw.columns]
    at = F.col("_metadata")
    raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)], at["file_path"].alias("_file"),
                     at["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))  # one row a file, so one task may order them
    before = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_files"))
    base = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_rows")).join(before, "_file")
    place = F.col("_at") - F.col("_first") + F.col("_rows") + 2
    return raw.join(base, ["_file", "_block"]).select(*[F.col(f"`{n}`") for n in names], place.alias("row_no"), (place + F.col("_files")).alias("row_id"))


def parse_time(raw: Column) -> Column:
    tries = [F.when(_shape(raw, f), F.try_to_timestamp(raw, F.lit(f))) for f in TIME_FORMATS]
    iso = F.regexp_replace(raw, "(Z|[+-]\\d\\d:?\\d\\d)$", "")  # the zone is dropped, not applied
    iso_like = raw.rlike("^\\d{4}-\\d\\d-\\d\\d([T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?)?(Z|[+-]\\d\\d:?\\d\\d)?$")
    return F.coalesce(*tries, F.when(iso_like, F.try_to_timestamp(iso)))


def _shape(raw: Column, fmt: str) -> Column:
    pattern = fmt.replace("'T'", "T")
    for part in ("yyyy", "MM", "dd", "HH", "mm", "ss"):
        pattern = pattern.replace(part, "\\d{4}" if part == "yyyy" else "\\d\\d")
    return raw.rlike("^" + pattern + "$")


def validate(raw: DataFrame, now: Column | None = None, order: str = "row_no") -> DataFrame:
    """Every row with its canonical fields and ``error`` (NULL = valid): the first failing check."""
    cols = map_headers([c for c in raw.columns if c not in (order, "row_id")])
    row_id = F.col("row_id" if "row_id" in raw.columns else order).cast("long")
    get = lambda f: F.trim(F.coalesce(F.col(f"`{cols[f]}`").cast("string"), F.lit(""))) if f in cols else F.lit("")
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    d = raw.select(F.col(order).cast("long").alias("row_no"), row_id.alias("row_id"), *[get(f).alias("r_" + f) for f in HEADERS])
    c = F.col
    money = F.trim(F.regexp_replace("r_amount", ",|₹|INR", ""))
    d = d.withColumns({"money": money, "amount": money.try_cast("double")})
    d = d.withColumn("amount", F.when(~F.isnan("amount") & (F.abs("amount") != float("inf")), c("amount")))
    d = d.withColumn("channel", F.when(c("r_channel") == "", "online").otherwise(
        F.coalesce(lookup(CHANNEL_ALIASES, F.lower("r_channel")), F.lower("r_channel"))))
    d = d.withColumn("mcc", F.when(c("r_mcc") == "", "retail").otherwise(F.replace(F.lower("r_mcc"), F.lit(" "), F.lit("_"))))
    d = d.withColumn("age", c("r_cust_age").try_cast("double").cast("int"))
    word = F.lower("r_label")
    d = d.withColumn("known_label", F.when(word.isin(*LABEL_TRUE), 1).when(word.isin(*LABEL_FALSE), 0))
    has_geo = (c("r_lat") != "") & (c("r_lon") != "")
    d = d.withColumns({"lat_in": c("r_lat").try_cast("double"), "lon_in": c("r_lon").try_cast("double")})
    if "ts" in cols:
        d = d.withColumn("ts", parse_time(c("r_ts")))
        time_check = F.when(c("ts").isNull(), say("timestamp '", c("r_ts"), "' not recognised — use YYYY-MM-DD HH:MM:SS"))
    else:
        end = F.current_timestamp() if now is None else now
        total = raw.agg(F.count(F.lit(1)).alias("rows_total"))
        d = d.crossJoin(F.broadcast(total))  # one row
        share = 86400.0 * (c("row_id") - 2) / F.greatest("rows_total", F.lit(1))
        d = d.withColumn("ts", F.timestamp_micros((F.unix_micros(end) + (share - 86400.0) * 1_000_000).cast("long"))).drop("rows_total")
        time_check = F.lit(None).cast("string")
    outside = ~(c("lat_in").between(-90, 90) & c("lon_in").between(-180, 180))
    error = F.coalesce(
        F.when(c("r_cust_id") == "", "cust_id is empty"),
        F.when(c("amount").isNull(), say("amount '", c("r_amount"), "' is not a number")),
        F.when(c("amount") <= 0, say("amount must be greater than 0 (got ", c("money"), ")")),
        time_check,
        F.when(~c("channel").isin("pos", "online", "atm", "transfer"),
               say("channel '", c("r_channel"), "' must be one of pos, online, atm, transfer")),
        F.when(~c("mcc").isin(*CATEGORIES), say("category '", c("r_mcc"), "' is not recognised — use one of: ", ", ".join(sorted(CATEGORIES)))),
        F.when((c("r_cust_age") != "") & c("age").isNull(), say("age '", c("r_cust_age"), "' is not a number")),
        F.when((c("r_cust_age") != "") & ~c("age").between(18, 120), say("age ", c("age").cast("string"), " is outside 18-120")),
        F.when(c("known_label").isNull() & ~word.isin(*LABEL_UNKNOWN),
               say("is_fraud must be 0/1, yes/no or true/false (got '", c("r_label"), "')")),
        F.when(has_geo & (c("lat_in").isNull() | c("lon_in").isNull()), "latitude/longitude must be numbers"),
        F.when(has_geo & outside, "latitude/longitude out of range"))
    city = F.lower("r_city")
    at = lambda i: F.coalesce(lookup({k: v[i] for k, v in CITIES.items()}, city), F.lit(CITIES[DEFAULT_CITY][i]))
    or_else = lambda col, text: F.when(c(col) != "", c(col)).otherwise(text)
    return d.select(
        "row_no", "row_id", error.alias("error"), "ts", c("r_cust_id").alias("cust_id"), F.round("amount", 2).alias("amount"), "mcc", "channel",
        or_else("r_merchant_id", F.concat(F.lit("merchant_"), "mcc")).alias("merchant_id"), c("r_beneficiary").alias("beneficiary"),
        F.upper(or_else("r_country", F.lit("IN"))).alias("country"), c("r_city").alias("city"),
        F.when(has_geo, c("lat_in")).otherwise(at(0)).alias("lat"), F.when(has_geo, c("lon_in")).otherwise(at(1)).alias("lon"),
        or_else("r_device_id", F.concat(F.lit("dev_"), "r_cust_id")).alias("device_id"),
        F.when(c("r_cust_age") != "", c("age")).alias("cust_age"), "known_label")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors): canonical events with ``labelled``; (row, error) of the rest."""
    ok = checked.filter("error IS NULL").withColumns({
        "seq": F.col("row_id"), "label": F.coalesce("known_label", F.lit(0)), "scenario": F.lit("upload"), "card_bin": F.lit("?")})
    events = canonical(ok.withColumn("labelled", F.col("known_label").isNotNull()), "labelled")
    errors = checked.filter("error IS NOT NULL").select(F.col("row_no").alias("row"), "error")
    return events, errors


def delivery_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNull()).alias("valid"),
        F.count_if(F.col("error").isNotNull()).alias("rejected"),
        F.count_if(F.col("error").isNull() & F.col("known_label").isNotNull()).alias("labelled"))


def upload_result(cases: DataFrame) -> DataFrame:
    """One row: decision mix, stopped, and the labelled confusion under both definitions."""
    from frisk.operators.metrics import blocked, confusion_aggs, stopped
    lab = F.col("labelled")
    both = []
    for name, pred in (("stopped", stopped()), ("blocked", blocked())):
        for agg, cell in zip(confusion_aggs(F.when(lab, F.col("label")), pred), ("tp", "fp", "tn", "fn")):
            both.append(agg.alias(f"{name}_{cell}"))
    return cases.agg(
        F.count(F.lit(1)).alias("scored"),
        *[F.count_if(F.col("action") == a).alias("n_" + a.lower()) for a in ("ALLOW", "REVIEW", "CHALLENGE", "BLOCK")],
        F.count_if(stopped()).alias("stopped"), F.count_if(lab).alias("labelled_rows"), *both)


def preview(cases: DataFrame, limit: int = 500) -> DataFrame:
    """The first scored rows in time order, as an upload answer shows them."""
    from frisk.operators.decision import result_reason
    return cases.select(
        "seq", "ts", "cust_id", "amount", "action", "risk", F.when(F.col("labelled"), F.col("label")).alias("label"),
        result_reason(F.col("reasons")).alias("reason")).orderBy("ts", "seq").limit(limit)


__all__ = ["validate", "split", "read_upload", "map_headers", "parse_time", "delivery_counts", "upload_result", "preview"]
