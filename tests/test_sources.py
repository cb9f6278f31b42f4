import datetime as dt

import pytest
from pyspark.sql import functions as F

from frisk.sources import layouts, replay, sinks, upload
from tests.rows import frame, random_rows


def write(scratch, name, text):
    path = f"{scratch}/{name}"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def rows(spark, scratch, layout, text, **kw):
    df = layouts.read_csv(spark, write(scratch, f"{layout}.csv", text), layout, **kw)
    return df.orderBy("ts", "seq").collect()


def test_sparkov(spark, scratch):
    r = rows(spark, scratch, "sparkov", (
        "trans_date_trans_time,cc_num,merchant,category,amt,city,lat,long,is_fraud,unix_time\n"
        "2020-06-21 12:14:25,2291163933867244,fraud_Kirlin and Sons,grocery_pos,41.5,Columbia,33.96,-80.93,0,1\n"
        "2020-06-21 12:14:33,3573030041201292,fraud_Sporer,misc_net,29.84,Altonah,40.32,-110.43,1,2\n"
        "bad,77,shop,food_dining,nan,X,,,0,60\n"))
    late = r[-1]
    assert late["cust_id"] == "cc_3573030041201292" and late["label"] == 1 and late["channel"] == "online" and late["mcc"] == "retail"
    assert late["merchant_id"] == "Sporer" and late["card_bin"] == "357303" and late["country"] == "US"
    assert r[1]["mcc"] == "grocery" and r[1]["channel"] == "pos"
    assert r[0]["ts"] == dt.datetime(2020, 1, 1, 0, 1) and r[0]["mcc"] == "retail" and r[0]["amount"] == 0.0


def test_ieee(spark, scratch):
    r = rows(spark, scratch, "ieee", (
        "TransactionDT,TransactionAmt,ProductCD,card1,addr1,P_emaildomain,DeviceInfo,isFraud\n"
        "86400,68.5,W,13926,315,,,0\n86401,29.0,S,2755,325,gmail.com,SM-G,1\n86402,5,Q,1,2,,,\n"))
    assert r[0]["ts"] == dt.datetime(2020, 1, 2) and r[0]["cust_id"] == "ic_13926_315" and r[0]["channel"] == "pos" and r[0]["device_id"] == "card_13926"
    assert r[1]["channel"] == "transfer" and r[1]["beneficiary"] == "gmail.com" and r[1]["mcc"] == "pcd_s" and r[1]["merchant_id"] == "2755_S"
    assert r[2]["channel"] == "online" and r[2]["label"] == 0


def test_ulb_and_arff(spark, scratch):
    head = "Time," + ",".join(f"V{i}" for i in range(1, 29)) + ",Amount,Class\n"
    line = lambda t, c: f"{t}," + ",".join("0.5" for _ in range(28)) + f",10.5,{c}\n"
    r = rows(spark, scratch, "ulb", head + line(0, 0) + line(3600, 1))
    assert r[1]["label"] == 1 and r[1]["raw_features"]["V28"] == 0.5 and r[1]["raw_features"]["Amount"] == 10.5 and len(r[0]["raw_features"]) == 29
    path = write(scratch, "x.arff", "% note\n@relation t\n@attribute 'Time' numeric\n@attribute Amount numeric\n@attribute Class {'0','1'}\n@data\n0,1.5,'0'\n1,2.5,'1'\n\n2,3.5,'0'\n")
    a = layouts.read_arff(spark, path)
    assert a.columns == ["Time", "Amount", "Class"] and layouts.arff_counts(a).first().asDict() == {"rows": 3, "frauds": 1}


def test_upi(spark, scratch):
    r = rows(spark, scratch, "upi", (
        "timestamp,amount,currency,upi_app,bank,device_fingerprint,status,is_suspicious\n"
        "2025-01-01T10:00:00,100.5,INR,gpay,HDFC,dev1,success,False\n2025-01-01T10:05:00,99,INR,gpay,HDFC,dev1,failed,False\n"
        "2025-01-01T10:06:00,250,INR,paytm,SBI,dev2,SUCCESS,True\nnever,1,INR,gpay,SBI,dev2,success,True\n"))
    assert len(r) == 2 and r[0]["cust_id"] == "upi_dev1" and r[1]["label"] == 1 and r[1]["merchant_id"] == "SBI_paytm"
    import hashlib
    assert r[0]["card_bin"] == hashlib.sha1(b"HDFC").hexdigest()[:6]


def test_paysim(spark, scratch):
    r = rows(spark, scratch, "paysim", (
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
        "1,TRANSFER,181.0,C1,0,0,C55,0,0,1,0\n2,CASH_OUT,1e6,C2,0,0,C66,0,0,0,0\n3,PAYMENT,0,C3,0,0,,0,0,0,0\n"))
    assert r[0]["beneficiary"] == "C55" and r[0]["mcc"] == "wire_transfer" and r[0]["ts"] == dt.datetime(2020, 1, 1, 1)
    assert r[1]["channel"] == "atm" and r[1]["beneficiary"] == "" and 5000 < r[1]["amount"] < 21000
    assert r[2]["amount"] == 1.0 and r[2]["merchant_id"] == "ps_merchant_payment"
    huge = spark.createDataFrame([(1e30,), (0.5,)], "x double").select(layouts.compressed_amount(F.col("x")).alias("y")).collect()
    assert huge[0]["y"] == pytest.approx(20000 * (20000 / 50) ** 0.2, rel=1e-3) and huge[1]["y"] == pytest.approx(50 * (20000 / 50) ** -0.2, rel=1e-3)


def test_india_bank_with_ages(spark, scratch):
    head = ("Transaction_ID,Customer_ID,Card_ID,Merchant_ID,Transaction_Date,Transaction_Time,Transaction_Amount,Payment_Method,Transaction_Channel,"
            "Device_Type,Transaction_Status,Is_International,Fraud_Flag,Merchant_Category,Merchant_City\n")
    ages = write(scratch, "customers.csv", "Customer_ID,Age\nCU1,34.0\nCU2,old\n")
    r = rows(spark, scratch, "india_bank", head + (
        "T1,CU1,CA1,ME1,2025-02-01,10:00:00,500,UPI,Mobile App,Android Phone,Successful,0,0,Fuel,Pune\n"
        "T2,CU2,CA2,ME2,2025-02-01,11:00:00,900,Card,POS,POS Terminal,Successful,1,1,Space,Delhi\n"
        "T3,CU1,CA1,ME1,2025-02-01,12:00:00,500,UPI,Mobile App,Android,Declined,0,1,Fuel,Pune\n"), ages_path=ages)
    assert len(r) == 2 and r[0]["cust_age"] == 34 and r[0]["channel"] == "transfer" and r[0]["mcc"] == "transport"
    assert r[0]["device_id"] == "ib_CU1_Android_Phone" and r[1]["cust_age"] is None and r[1]["country"] == "XX" and r[1]["channel"] == "pos"


def test_unknown_layout(spark, scratch):
    with pytest.raises(ValueError):
        layouts.read_csv(spark, scratch, "nope")


def test_category_keys_with_underscores_never_match(spark):
    names = ["grocery_pos", "food_dining", "misc_net", "gas_transport", "gasttransport", "shopping-pos", "home"]
    df = spark.createDataFrame([(n.replace("_", ""),) for n in names], "c string").select(layouts.category(F.col("c")).alias("m"))
    assert [r["m"] for r in df.collect()] == ["grocery", "retail", "retail", "retail", "transport", "retail", "retail"]


BAD = ("﻿customer_id;Amount;Date;Channel;Category;Age\n"
       "a1;₹1,250.50;2026-09-01 10:15:00;UPI;grocery;34\n"
       ";5;2026-09-01;pos;grocery;30\na2;zero;2026-09-01;pos;grocery;30\na3;-4;2026-09-01;pos;grocery;30\n"
       "a4;5;someday;pos;grocery;30\na5;5;01/09/2026;fax;grocery;30\na6;5;2026-09-01;pos;spaceship;30\n"
       "a7;12;01-09-2026 08:30;;;\na8;5;2026-09-01;pos;grocery;7\na9;inf;2026-09-01;pos;grocery;30\n")


def test_upload_rejects_with_the_first_reason(spark, scratch):
    raw = upload.read_upload(spark, write(scratch, "u.csv", BAD))
    events, errors = upload.split(upload.validate(raw))
    e = {r["row"]: r["error"] for r in errors.collect()}
    assert set(e) == {3, 4, 5, 6, 7, 8, 10, 11}
    assert e[3] == "cust_id is empty" and e[4] == "amount 'zero' is not a number" and e[5] == "amount must be greater than 0 (got -4)"
    assert e[6].startswith("timestamp 'someday' not recognised") and e[7].startswith("channel 'fax' must be one of")
    assert e[8].startswith("category 'spaceship' is not recognised") and e[10] == "age 7 is outside 18-120"
    ok = {r["cust_id"]: r for r in events.collect()}
    assert ok["a1"]["amount"] == 1250.5 and ok["a1"]["channel"] == "transfer" and ok["a1"]["device_id"] == "dev_a1"
    assert ok["a7"]["ts"] == dt.datetime(2026, 9, 1, 8, 30) and ok["a7"]["mcc"] == "retail" and ok["a7"]["merchant_id"] == "merchant_retail"
    counts = upload.delivery_counts(upload.validate(raw)).first().asDict()
    assert counts == {"rows": 10, "valid": 2, "rejected": 8, "labelled": 0}


def test_upload_labels_and_places(spark):
    df = spark.createDataFrame([
        (2, "a", "1", "yes", "Delhi", "", "", "2026-01-01T10:00:00+05:30"), (3, "b", "1", "genuine", "", "10", "20", "2026-01-01"),
        (4, "c", "1", "?", "", "", "", "2026-01-01"), (5, "d", "1", "maybe", "", "", "", "2026-01-01"), (6, "e", "1", "", "", "x", "1", "2026-01-01"),
        (7, "f", "1", "", "", "95", "1", "2026-01-01")], "row_no long, cust_id string, amount string, is_fraud string, city string, lat string, lon string, ts string")
    c = {r["row_no"]: r for r in upload.validate(df).collect()}
    assert (c[2]["known_label"], c[3]["known_label"], c[4]["known_label"]) == (1, 0, None)
    assert (c[2]["lat"], c[3]["lat"], c[4]["lat"]) == (28.61, 10.0, 19.08) and c[2]["ts"] == dt.datetime(2026, 1, 1, 10)
    assert c[5]["error"].startswith("is_fraud must be") and c[6]["error"] == "latitude/longitude must be numbers" and c[7]["error"] == "latitude/longitude out of range"


def test_upload_spreads_missing_times(spark):
    df = spark.createDataFrame([(i + 2, f"c{i}", "5") for i in range(10)], "row_no long, cust_id string, amount string")
    now = F.lit(dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)).cast("timestamp")
    ts = [r["ts"] for r in upload.validate(df, now).orderBy("row_no").collect()]
    assert ts[0] == dt.datetime(2026, 1, 1) and ts[5] == dt.datetime(2026, 1, 1, 12) and len(set(ts)) == 10


def test_upload_needs_two_columns():
    with pytest.raises(ValueError, match="missing required column"):
        upload.map_headers(["foo", "Amount"])
    assert upload.map_headers(["Account ID", "AMT", "e-mail"]) == {"cust_id": "Account ID", "amount": "AMT"}


def test_replay_pages_and_blend(spark):
    ev = frame(spark, random_rows(n=50))
    first, rest = replay.page(ev, 0, 30), replay.page(ev, 30, 30)
    assert first.count() == 30 and rest.count() == 20
    assert not first.first()["exhausted"] and rest.first()["exhausted"]
    assert first.select("seq").intersect(rest.select("seq")).count() == 0
    other = frame(spark, random_rows(n=50, seed=4)).withColumn("seq", F.col("seq") + 1000)
    n = {r["source"]: r["n"] for r in replay.source_counts(replay.blend(ev, other, 20, 0.6)).collect()}
    assert n == {"real": 12, "other": 8}


def test_sinks(spark, scratch):
    ev = frame(spark, random_rows(n=40)).filter("type = 'txn'").withColumn("action", F.when(F.col("label") == 1, "BLOCK").otherwise("ALLOW"))
    sinks.append_cases(ev, f"{scratch}/cases")
    back = spark.read.parquet(f"{scratch}/cases")
    assert back.count() == ev.count() and "day" in back.columns
    assert sinks.recent_cases(back, 5, only_alerts=True).filter("action <> 'BLOCK'").count() == 0
    assert sinks.recent_cases(back, 5).first()["seq"] == max(r["seq"] for r in ev.collect())
    seq = ev.first()["seq"]
    assert sinks.case_by_id(back, seq).count() == 1
    sinks.write_report(ev.groupBy("action").count(), f"{scratch}/r")
    assert "| action | count |" in sinks.markdown_table(ev.groupBy("action").count())
    sinks.save_snapshot(sinks.profile_snapshot(ev), ev.limit(1), f"{scratch}/s")
    assert spark.read.parquet(f"{scratch}/s/profiles").count() == ev.filter("label = 0").select("cust_id").distinct().count()


def test_upload_row_ids_are_unique_however_files_are_split(spark, scratch):
    import os
    os.makedirs(f"{scratch}/many")
    for k in range(3):
        with open(f"{scratch}/many/{k}.csv", "w") as f:
            f.write("customer;amount;note\n" + "".join(f"c{k}_{j};{j + 1};x\n" for j in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        for breaks in (True, False):
            rows = upload.read_upload(spark, f"{scratch}/many", breaks).collect()
            assert sorted(r["row_id"] for r in rows) == list(range(2, 602))
            assert all(int(r["amount"]) == r["row_no"] - 1 for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    events, errors = upload.split(upload.validate(upload.read_upload(spark, f"{scratch}/many")))
    assert events.select("seq").distinct().count() == 600 and errors.count() == 0


def test_upload_header_with_mark_quotes_and_line_breaks(spark, scratch):
    path = write(scratch, "q.csv", '\ufeff"customer";"amount";"merchant, name, long, list"\nc1;5;"two\nlines"\nc2;6;"a ""b"""\n')
    rows = upload.read_upload(spark, path).orderBy("row_id").collect()
    assert [(r["customer"], r["amount"], r["row_no"]) for r in rows] == [("c1", "5", 2), ("c2", "6", 3)]
    assert [r["merchant, name, long, list"] for r in rows] == ["two\nlines", 'a "b"']


def test_a_long_report_is_not_cut(spark):
    assert sinks.markdown_table(spark.range(300)).count("\n") == 301
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(300), most=200)


def test_pages_by_seek_equal_ranked_pages_and_read_their_buckets_alone(spark, scratch):
    from frisk.config import DEFAULT
    from frisk.sources.replay import page, read_page, write_replay
    df = spark.range(900).select(F.col("id").alias("seq"), F.timestamp_seconds(F.floor(F.when(F.col("id") < 300, 77).otherwise(F.col("id") * 7))).alias("ts"),
                                 (F.col("id") * 2).alias("amount"))  # 300 rows of one instant, then one every 7 s
    s = DEFAULT.with_(prior_bucket_s=70)
    write_replay(df, f"{scratch}/r", s)
    for cursor, limit in ((0, 10), (150, 200), (295, 30), (890, 10), (890, 50), (900, 5), (5000, 5), (0, 900)):
        got = read_page(spark, f"{scratch}/r", cursor, limit)
        want = page(df, cursor, limit, s)
        key = lambda d: sorted((r["rank"], r["seq"], r["amount"], r["exhausted"]) for r in d.collect())
        assert key(got) == key(want)
    plan = read_page(spark, f"{scratch}/r", 600, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    write_replay(df.limit(0), f"{scratch}/e", s)
    assert read_page(spark, f"{scratch}/e", 0, 5).count() == 0
