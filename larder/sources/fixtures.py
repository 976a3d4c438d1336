"""Supply-chain datasets derived from the driver tables (FIXTURES.md part B).

Each ``fx_*`` builder returns a lazy DataFrame whose rows scale with the
driver tables. Joins are left to Catalyst/AQE except for the fixed-size
geography dimensions (5 regions, 25 nations), which are broadcast explicitly.
NULLs and bad values are injected by modulus rules so the SQL oracle can
produce exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.tables import read_table

c = F.col
lit = F.lit


def _str(x):
    return x.cast("string")


def _ship_ts(key="l_orderkey", base="l_shipdate"):
    """Ship date plus (suppkey + linenumber) % 24 hours; NULL for every 97th order."""
    hours = ((c("l_suppkey") + c("l_linenumber")) % 24).cast("int")
    return F.when(c(key) % 97 != 0, F.timestamp_add("HOUR", hours, c(base)))


def _lineitem_id():
    return c("l_orderkey") * 10 + c("l_linenumber")


def _geo(spark, sf_dir):
    # 25 nations x 5 regions: a fixed-size dimension, safe to broadcast.
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return F.broadcast(nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey")))


def fx_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    df = (li.join(o, c("l_orderkey") == c("o_orderkey"))
            .join(cu, c("o_custkey") == c("c_custkey"))
            .join(_geo(spark, sf_dir), c("c_nationkey") == c("n_nationkey"))
            .join(p, c("l_partkey") == c("p_partkey")))
    promo = c("l_discount") >= 0.09
    return df.select(
        _lineitem_id().alias("sale_id"),
        _ship_ts().alias("timestamp"),
        F.concat(lit("STORE_"), _str(c("o_custkey") % 199)).alias("retailer_id"),
        c("r_name").alias("region"),
        c("p_brand").alias("sku"),
        c("l_quantity").alias("quantity_sold"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"),
        F.when(promo, 1).otherwise(0).cast("int").alias("promotion_flag"),
        F.when(promo, F.concat(lit("PROMO_"), c("l_returnflag"))).alias("promotion_name"),
    )


def fx_b2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    df = li.join(o, c("l_orderkey") == c("o_orderkey")).join(p, c("l_partkey") == c("p_partkey"))
    return df.select(
        _ship_ts().alias("timestamp"),
        F.concat(lit("STORE_"), _str(c("o_custkey") % 139)).alias("store_id"),
        F.when(c("l_suppkey") % 11 != 0,
               F.concat(lit("D"), _str(c("l_suppkey") % 11), lit("_Branch"))).alias("depot_id"),
        c("p_brand").alias("sku"),
        c("l_quantity").alias("quantity_sold"),
        F.when(c("l_linenumber") != 7, F.concat(lit("RT_"), _str(c("l_suppkey") % 50))).alias("route_id"),
        F.when(c("l_orderkey") % 53 != 0, c("l_extendedprice") / c("l_quantity")).alias("price_per_unit"),
    )


def fx_dispatch(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` may be a streaming DataFrame with the events schema."""
    ev = events if events is not None else read_table(spark, sf_dir, "events")
    arrive = F.timestamp_add("HOUR", lit(2), c("ts"))
    return ev.select(
        c("event_id").alias("dispatch_id"),
        F.when(c("event_id") % 199 != 0, c("ts")).alias("timestamp"),
        F.when(c("user_id") % 2 == 0, lit("Plant_A")).otherwise(lit("Plant_B")).alias("plant_id"),
        F.when(c("event_id") % 89 != 0, F.concat(lit("RT_"), _str(c("user_id") % 69))).alias("route_id"),
        F.concat(lit("TRUCK_"), _str(c("user_id") % 90)).alias("vehicle_id"),
        F.concat(lit("STORE_"), _str(c("event_id") % 199)).alias("retailer_id"),
        c("event_type").alias("sku"),
        (lit(1) + c("event_id") % 500).cast("bigint").alias("qty_dispatched"),
        arrive.alias("expected_arrival"),
        F.timestamp_add("MINUTE", (F.floor(c("value")) - 35).cast("int"), arrive).alias("actual_arrival"),
    )


def fx_sensors(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = events if events is not None else read_table(spark, sf_dir, "events")
    return ev.select(
        c("event_id").alias("sensor_id"),
        c("ts").alias("timestamp"),
        F.when(c("event_id") % 181 == 0, lit(None).cast("string"))
         .when(c("user_id") % 2 == 0, lit("Plant_A")).otherwise(lit("Plant_B")).alias("plant_id"),
        F.concat(lit("EQ_"), _str(c("user_id") % 10)).alias("equipment_id"),
        c("event_type").alias("metric_name"),
        F.when(c("event_id") % 223 != 0, c("value")).alias("metric_value"),
    )


def _inflow():
    m = c("l_linenumber") % 6
    return m.isin(0, 3) | ((m == 5) & (c("l_suppkey") % 2 == 0))


# Movement types of the stock ledger, in linenumber % 6 order: fixed values.
MOVEMENT_TYPES = ["production", "dispatch", "store_sale", "return_from_store", "waste", "stock_adjustment"]


def fx_inventory(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    li = lineitem if lineitem is not None else read_table(spark, sf_dir, "lineitem")
    q4 = (c("l_quantity") * 4).cast("bigint")
    m = c("l_linenumber") % 6
    mtype = F.element_at(F.array(*[lit(x) for x in MOVEMENT_TYPES]), (m + 1).cast("int"))
    inflow = _inflow()
    return li.select(
        _lineitem_id().alias("record_id"),
        _ship_ts().alias("timestamp"),
        F.when(c("l_linestatus") == "O", F.concat(lit("Plant_"), _str(c("l_suppkey") % 2))).alias("plant_id"),
        F.when((c("l_linestatus") == "F") & (c("l_orderkey") % 101 != 0),
               F.concat(lit("STORE_"), _str(c("l_partkey") % 199))).alias("store_id"),
        F.concat(lit("SKU_"), _str(c("l_partkey") % 7)).alias("sku"),
        mtype.alias("movement_type"),
        F.when(inflow, q4).otherwise(lit(0).cast("bigint")).alias("qty_in"),
        F.when(inflow, lit(0).cast("bigint")).otherwise(q4).alias("qty_out"),
        (c("l_partkey") - 70).alias("balance_before"),
        (c("l_partkey") - 70 + F.when(c("l_orderkey") % 311 == 0, 1).otherwise(0)
         + F.when(inflow, q4).otherwise(-q4)).alias("balance_after"),
        F.when(c("l_orderkey") % 41 != 0, F.concat(lit("RC_"), _str(c("l_linenumber")))).alias("reason_code"),
        F.timestamp_add("DAY", (c("l_suppkey") % 10 - 1).cast("int"), c("l_shipdate")).alias("expiry_date"),
        F.when(m == 1, F.concat(lit("RT_"), _str(c("l_suppkey") % 69))).alias("route_id"),
    )


# The seven defect columns of a production batch: fixed names.
DEFECT_COLUMNS = ["stacked_before_robot", "squashed", "torn", "undersized_small",
                  "valleys", "loose_packs", "pale_underbaked"]
_DEFECT_MODULI = [10, 8, 6, 12, 11, 14, 5]


def fx_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    bid = F.when(c("o_orderkey") % 200 == 1, c("o_orderkey") - 1).otherwise(c("o_orderkey"))
    return o.select(
        F.concat(lit("B_"), _str(bid)).alias("batch_id"),
        F.when(c("o_orderkey") % 97 != 0,
               F.timestamp_add("HOUR", (c("o_custkey") % 24).cast("int"), c("o_orderdate"))).alias("timestamp"),
        F.when(c("o_custkey") % 2 == 0, lit("Plant_A")).otherwise(lit("Plant_B")).alias("plant"),
        F.when(c("o_orderkey") % 251 != 0, F.concat(lit("Line"), _str(c("o_orderkey") % 5))).alias("line_id"),
        F.concat(lit("OP_"), _str(c("o_custkey") % 6)).alias("operator_id"),
        F.concat(lit("SKU_"), _str(c("o_custkey") % 7)).alias("sku"),
        (lit(200) + c("o_custkey")).cast("bigint").alias("quantity_produced"),
        *[(c("o_orderkey") % m).cast("bigint").alias(n) for n, m in zip(DEFECT_COLUMNS, _DEFECT_MODULI)],
    )


def fx_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        _lineitem_id().alias("qc_id"),
        _ship_ts().alias("timestamp"),
        F.concat(lit("B_"), _str(c("l_orderkey"))).alias("batch_id"),
        F.concat(lit("SKU_"), _str(c("l_partkey") % 7)).alias("sku"),
        F.concat(lit("param_"), _str(c("l_linenumber"))).alias("parameter"),
        F.when(c("l_orderkey") % 61 != 0, c("l_extendedprice") / 1000).alias("value"),
        F.when(c("l_discount") > 0.06, lit(" FAIL")).otherwise(lit("Pass ")).alias("pass_fail"),
        F.when(c("l_tax") > 0.04,
               F.concat(lit("note "), c("l_returnflag"), _str(c("l_suppkey") % 4))).alias("notes"),
    )


def fx_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where(c("l_returnflag") == "R")
    post = c("l_linestatus") == "F"
    return li.select(
        _lineitem_id().alias("waste_id"),
        _ship_ts().alias("timestamp"),
        F.concat(lit("Plant_"), _str(c("l_suppkey") % 2)).alias("plant_id"),
        F.when(c("l_linestatus") == "O", lit("production")).otherwise(lit("post_dispatch")).alias("stage"),
        F.concat(lit("SKU_"), _str(c("l_partkey") % 16)).alias("sku"),
        c("l_quantity").cast("bigint").alias("qty_waste"),
        F.concat(lit("W_"), _str(c("l_linenumber"))).alias("waste_reason_code"),
        F.when(c("l_linestatus") == "O", F.concat(lit("B_"), _str(c("l_orderkey")))).alias("batch_id"),
        F.when(c("l_suppkey") % 3 == 0, lit("Morning"))
         .when(c("l_suppkey") % 3 == 1, lit("Afternoon")).otherwise(lit("Night")).alias("shift"),
        F.when(post, F.concat(lit("RT_"), _str(c("l_suppkey") % 69))).alias("route_id"),
        F.when(post, F.concat(lit("STORE_"), _str(c("l_partkey") % 199))).alias("retailer_id"),
        F.when(c("l_orderkey") % 59 != 0, lit(15) + c("l_tax") * 300).alias("temperature_at_check"),
        F.concat(lit("H_"), _str(c("l_partkey") % 5)).alias("handling_condition"),
    )


# Return reasons by linenumber % 5: fixed values.
RETURN_REASONS = ["Expired", "Damaged Pack", "crushed", "Mould Growth", "Returned Unsold"]


def fx_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where(c("l_returnflag") == "A")
    reason = F.element_at(F.array(*[lit(x) for x in RETURN_REASONS]), (c("l_linenumber") % 5 + 1).cast("int"))
    return li.select(
        _lineitem_id().alias("return_id"),
        _ship_ts().alias("timestamp"),
        F.when(c("l_orderkey") % 83 != 0, F.concat(lit("RT_"), _str(c("l_suppkey") % 69))).alias("route_id"),
        F.concat(lit("STORE_"), _str(c("l_partkey") % 199)).alias("retailer_id"),
        F.concat(lit("SKU_"), _str(c("l_partkey") % 17)).alias("sku"),
        c("l_quantity").cast("bigint").alias("qty_returned"),
        reason.alias("reason_code"),
        F.when(c("l_orderkey") % 59 != 0, lit(15) + c("l_tax") * 300).alias("temperature_at_return"),
        F.concat(lit("H_"), _str(c("l_partkey") % 5)).alias("handling_condition"),
    )


# Trip start windows by suppkey % 3 and load capacities by suppkey % 4: fixed values.
START_WINDOWS = ["03:00-05:00", "04:00-06:00", "05:00-07:00"]
CAPACITIES = [3000, 4000, 5500, 7000]


def fx_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    df = s.join(_geo(spark, sf_dir), c("s_nationkey") == c("n_nationkey"))
    k = c("s_suppkey")
    stops = F.concat(F.repeat(F.concat(lit("STORE_"), _str(k % 7), lit(",")), (k % 19).cast("int")),
                     lit("STORE_"), _str(k))
    return df.select(
        F.concat(lit("RT_"), _str(k % 69)).alias("route_id"),
        c("s_name").alias("route_name"),
        F.concat(lit("TRUCK_"), _str(k % 41)).alias("vehicle_id"),
        F.when(k % 37 != 0, F.concat(lit("DRIVER_"), _str(k % 53))).alias("driver_id"),
        ((k * 31) % 241).cast("bigint").alias("estimated_time_min"),
        (lit(10) + (k * 37) % 150).cast("double").alias("distance_km"),
        F.when(k % 47 != 0, stops).alias("stops_list"),
        c("r_name").alias("region"),
        F.element_at(F.array(*[lit(x) for x in START_WINDOWS]), (k % 3 + 1).cast("int")).alias("trip_start_window"),
        lit("16:00-18:00").alias("trip_end_window"),
        F.element_at(F.array(*[lit(x) for x in CAPACITIES]), (k % 4 + 1).cast("int")).cast("bigint")
         .alias("load_capacity_kg"),
    )


def fx_retailer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_table(spark, sf_dir, "customer")
    df = cu.join(_geo(spark, sf_dir), c("c_nationkey") == c("n_nationkey"))
    return df.select(
        F.concat(lit("STORE_"), _str(c("c_custkey"))).alias("retailer_id"),
        c("c_name").alias("retailer_name"),
        c("c_mktsegment").alias("retailer_type"),
        c("r_name").alias("region"),
    )


VIEWS = {
    "fx_pos": fx_pos, "fx_b2b": fx_b2b, "fx_dispatch": fx_dispatch, "fx_sensors": fx_sensors,
    "fx_inventory": fx_inventory, "fx_production": fx_production, "fx_qc": fx_qc,
    "fx_waste": fx_waste, "fx_returns": fx_returns, "fx_routes": fx_routes,
    "fx_retailer_master": fx_retailer_master,
}
