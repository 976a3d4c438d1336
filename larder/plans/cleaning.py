"""The cleaning job as a query (S01, S02, S04, S06, S07, C01-C09): a driver table written as messy CSV and cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.clean import clean_csv_to_parquet
from larder.sources.fixtures import fx_returns
from larder.streaming.streams import run_folder

c = F.col


def cleaned_returns(spark, sf_dir) -> DataFrame:
    """Returns as CSV with semicolons, thousands commas, odd names and a column twice; cleaned into Parquet."""
    folder = run_folder(spark, "s06")
    fx_returns(spark, sf_dir).select(
        F.format_number("return_id", 0).alias(" Return ID"), F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss").alias("Time-Stamp"), c("route_id").alias("Route.ID"),
        c("retailer_id").alias("Retailer ID"), c("sku").alias("SKU"), c("sku").alias("SKU copy"), c("qty_returned").alias("Total Quantity (returned)"),
        c("reason_code").alias("Reason\tcode"), c("reason_code").alias("Reason code_1"), F.round("temperature_at_return", 4).cast("string").alias("Temp. at return!"),
    ).write.options(header="true", sep=";").csv(f"{folder}/raw")
    return clean_csv_to_parquet(spark, f"{folder}/raw", f"{folder}/clean")


@query("s06_clean_returns", osql("fx_returns", """
SELECT CAST(return_id AS DOUBLE) AS return_id, timestamp AS time_stamp, route_id, retailer_id, sku, CAST(qty_returned AS DOUBLE) AS qty_returned,
       reason_code, round(temperature_at_return, 4) AS temp__at_return
FROM fx_returns"""))
def s06_clean_returns(spark, sf_dir):
    """Every row, typed and named by the rules."""
    return cleaned_returns(spark, sf_dir).withColumn("time_stamp", c("time_stamp").cast("timestamp_ntz"))


@query("c09_cleaned_profile", osql("fx_returns", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, '{kind}' AS kind, count(*) - count({x}) AS nulls FROM fx_returns"
    for name, x, kind in (("return_id", "return_id", "double"), ("time_stamp", "timestamp", "timestamp"), ("route_id", "route_id", "string"), ("retailer_id", "retailer_id", "string"),
                          ("sku", "sku", "string"), ("qty_returned", "qty_returned", "double"), ("reason_code", "reason_code", "string"), ("temp__at_return", "temperature_at_return", "double")))))
def c09_cleaned_profile(spark, sf_dir):
    """Types and nulls of the cleaned columns."""
    df = cleaned_returns(spark, sf_dir)
    one = df.agg(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind"), F.count_if(c(f.name).isNull()).alias("nulls"))
                           for f in df.schema.fields]).alias("a"))
    return one.select(F.inline("a"))
