from larder.sources.clean import (clean_csv_to_parquet, clean_folder, clean_table, drop_suffixed_duplicates, read_csv, resolve_column,
                                  split_malformed, standardize_name, unique_names)


def test_names():
    assert standardize_name(" Qty-Sold.Total (units)\n") == "qty_sold_total_units"
    assert standardize_name("a - b") == "a___b"
    assert standardize_name("Größe") == "größe" and standardize_name("数量") == "数量"
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]


def folder(tmp_path, **files):
    p = tmp_path / "raw"
    p.mkdir()
    for name, lines in files.items():
        (p / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return p


def test_messy_csv(spark, tmp_path):
    p = folder(tmp_path, sales=["Store ID;Qty Sold;Copy Qty;Timestamp;Price",
                                "S1;1,000;1,000;2024-01-02 10:00:00;2.5",
                                "S2;20;20;not a date;3.0",
                                "S3;x;x;2024-01-03;5",
                                "S4;40;40;2024-01-04 08:30;4.25"])
    df = clean_table(read_csv(spark, str(p)))
    assert "copy_qty" not in df.columns          # duplicate content dropped
    assert "quantity_sold" in df.columns        # quantity variant unified
    types = dict(df.dtypes)
    assert types["timestamp"] == "string"       # only 3 of 4 parse (75 % <= 90 %): nothing is lost
    assert types["price"] == "double"
    assert types["quantity_sold"] == "string"   # only 3 of 4 rows parse (75 % <= 90 %)
    rows = {r.store_id: r for r in df.collect()}
    assert rows["S2"].timestamp == "not a date" and rows["S1"].price == 2.5


def test_times_and_numbers_keep_their_values(spark, tmp_path):
    p = folder(tmp_path, t=["id,estimated_time_min,Arrival,Departure time,day_date",
                            "1,102,2024-01-01 10:00:00.250,2024-01-01T10:00:00Z,01/31/2024",
                            "2,90,2024-01-01 11:00:00.5,2024-01-01T11:00:00Z,02/28/2024",
                            "3,80,2024-01-01 12:00:00.125,,12/25/2024"])
    df = clean_table(read_csv(spark, str(p)))
    assert dict(df.dtypes) == {"id": "double", "estimated_time_min": "double", "arrival": "timestamp", "departure_time": "timestamp", "day_date": "timestamp"}
    r = {x.id: x for x in df.collect()}
    assert r[1].estimated_time_min == 102 and r[1].arrival.microsecond == 250_000 and r[1].day_date.day == 31
    assert r[2].departure_time.hour == 11 and r[3].departure_time is None


def test_repeated_names_do_not_clash(spark, tmp_path):
    df = clean_table(read_csv(spark, str(folder(tmp_path, t=["a,A,a_1", "1,2,3", "4,5,6"]))))
    assert sorted(df.columns) == ["a", "a_1", "a_2"] and df.count() == 2
    twins = spark.createDataFrame([(1, 1, 2), (None, None, 3)], "x int, x_1 int, x_2 int")
    assert drop_suffixed_duplicates(twins).columns == ["x", "x_2"]


def test_malformed_rows_and_delimiters_per_file(spark, tmp_path):
    p = folder(tmp_path, one=["k,v", "1,a", "2,b,extra", "3,c"], two=["k;v", "4;d", "5"])
    good, bad = split_malformed(read_csv(spark, str(p)).cache())
    assert sorted(r.k for r in good.collect()) == ["1", "3", "4"]
    assert sorted(r[0] for r in bad.collect()) == ["2,b,extra", "5"]
    out = clean_csv_to_parquet(spark, str(p), str(tmp_path / "out"))
    assert out.count() == 3 and spark.read.parquet(str(tmp_path / "out_quarantine")).count() == 2


def test_files_fail_alone(spark, tmp_path):
    p = folder(tmp_path, good=["a,b", "1,2"], other=["a,b", "3,4"])
    (p / "bad.csv").write_text("")
    state = {f.rsplit("/", 1)[-1]: s for f, s in clean_folder(spark, str(p), str(tmp_path / "out"))}
    assert state["good.csv"] == state["other.csv"] == "ok" and state["bad.csv"] != "ok"
    assert spark.read.parquet(str(tmp_path / "out" / "good")).count() == 1


def test_resolver(spark):
    df = spark.createDataFrame([(1, 2)], "Route_ID int, planned_qty int")
    assert resolve_column(df, "route_id") == "Route_ID" and resolve_column(df, "qty") == "planned_qty" and resolve_column(df, "zzz") is None


def test_cleaning_reads_the_texts_once(spark, tmp_path):
    from larder.sources.clean import clean_table, read_csv

    (tmp_path / "a.csv").write_text("Order ID;Time\n1;2024-01-02\n2;2024-01-03\n")
    df = clean_table(read_csv(spark, str(tmp_path)))
    assert not any(f.endswith(".csv") for f in df.inputFiles())
    assert [(r["order_id"], str(r["time"])) for r in df.orderBy("order_id").collect()] == [(1.0, "2024-01-02 00:00:00"), (2.0, "2024-01-03 00:00:00")]


def test_layouts_are_tried_only_where_they_may_fit(spark):
    from pyspark.sql import functions as F

    from larder.sources.clean import TIMESTAMP_FORMATS, _may_be, _timestamp

    texts = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05Z", "2024-01-02t03:04:05+02:00", "2024-01-02 03:04", "2024-01-02T03:04", "2024-01-02",
             "2024/01/02 03:04:05", "2024/01/02", "02/01/2024 03:04:05", "02/01/2024 03:04", "02/01/2024", "13/12/2024", "12/13/2024 01:02:03", "12/13/2024", "02-01-2024", "02.01.2024",
             "-2024-01-02", "+12024-01-02", "2/1/2024", " 2024-01-02", "a/b:c", "T", "", None, "99", "2024-13-40", "02/01/2024 25:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in TIMESTAMP_FORMATS])
    assert df.where(~_timestamp("t").eqNullSafe(plain)).collect() == []
    assert df.where(F.col("t") == "02/01/2024 03:04:05").select(*[_may_be(F.col("t"), f) for f in TIMESTAMP_FORMATS[:7]]).first() == (False,) * 7
