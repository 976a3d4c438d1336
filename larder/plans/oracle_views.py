"""DuckDB SQL for the fixture views, used only by the oracle side of each query.

``osql(views, body)`` prefixes a query body with the CTEs it needs. A body may
begin with its own ``WITH``; its CTEs are appended after the fixture views.
"""

from __future__ import annotations

_SHIP_TS = ("CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_shipdate + INTERVAL '1' HOUR * "
            "CAST((l_suppkey + l_linenumber) % 24 AS INT) END")

_INFLOW = "(l_linenumber % 6 IN (0, 3) OR (l_linenumber % 6 = 5 AND l_suppkey % 2 = 0))"

VIEW_SQL = {
    "fx_pos": f"""
SELECT l_orderkey * 10 + l_linenumber AS sale_id,
       {_SHIP_TS} AS timestamp,
       concat('STORE_', CAST(o_custkey % 199 AS VARCHAR)) AS retailer_id,
       r_name AS region,
       p_brand AS sku,
       l_quantity AS quantity_sold,
       l_extendedprice / l_quantity AS price,
       CAST(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS INT) AS promotion_flag,
       CASE WHEN l_discount >= 0.09 THEN concat('PROMO_', l_returnflag) END AS promotion_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey""",
    "fx_b2b": f"""
SELECT {_SHIP_TS} AS timestamp,
       concat('STORE_', CAST(o_custkey % 139 AS VARCHAR)) AS store_id,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('D', CAST(l_suppkey % 11 AS VARCHAR), '_Branch') END AS depot_id,
       p_brand AS sku,
       l_quantity AS quantity_sold,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('RT_', CAST(l_suppkey % 50 AS VARCHAR)) END AS route_id,
       CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price_per_unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_dispatch": """
SELECT event_id AS dispatch_id,
       CASE WHEN event_id % 199 = 0 THEN NULL ELSE ts END AS timestamp,
       CASE WHEN user_id % 2 = 0 THEN 'Plant_A' ELSE 'Plant_B' END AS plant_id,
       CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('RT_', CAST(user_id % 69 AS VARCHAR)) END AS route_id,
       concat('TRUCK_', CAST(user_id % 90 AS VARCHAR)) AS vehicle_id,
       concat('STORE_', CAST(event_id % 199 AS VARCHAR)) AS retailer_id,
       event_type AS sku,
       CAST(1 + event_id % 500 AS BIGINT) AS qty_dispatched,
       ts + INTERVAL '2' HOUR AS expected_arrival,
       ts + INTERVAL '2' HOUR + INTERVAL '1' MINUTE * CAST(floor(value) - 35 AS INT) AS actual_arrival
FROM events""",
    "fx_sensors": """
SELECT event_id AS sensor_id, ts AS timestamp,
       CASE WHEN event_id % 181 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'Plant_A' ELSE 'Plant_B' END AS plant_id,
       concat('EQ_', CAST(user_id % 10 AS VARCHAR)) AS equipment_id,
       event_type AS metric_name,
       CASE WHEN event_id % 223 = 0 THEN NULL ELSE value END AS metric_value
FROM events""",
    "fx_inventory": f"""
SELECT l_orderkey * 10 + l_linenumber AS record_id,
       {_SHIP_TS} AS timestamp,
       CASE WHEN l_linestatus = 'O' THEN concat('Plant_', CAST(l_suppkey % 2 AS VARCHAR)) END AS plant_id,
       CASE WHEN l_linestatus = 'F' AND l_orderkey % 101 <> 0 THEN concat('STORE_', CAST(l_partkey % 199 AS VARCHAR)) END AS store_id,
       concat('SKU_', CAST(l_partkey % 7 AS VARCHAR)) AS sku,
       CASE l_linenumber % 6 WHEN 0 THEN 'production' WHEN 1 THEN 'dispatch' WHEN 2 THEN 'store_sale'
            WHEN 3 THEN 'return_from_store' WHEN 4 THEN 'waste' ELSE 'stock_adjustment' END AS movement_type,
       CASE WHEN {_INFLOW} THEN CAST(l_quantity * 4 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS qty_in,
       CASE WHEN {_INFLOW} THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity * 4 AS BIGINT) END AS qty_out,
       l_partkey - 70 AS balance_before,
       l_partkey - 70 + CASE WHEN l_orderkey % 311 = 0 THEN 1 ELSE 0 END
         + CASE WHEN {_INFLOW} THEN CAST(l_quantity * 4 AS BIGINT) ELSE -CAST(l_quantity * 4 AS BIGINT) END AS balance_after,
       CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE concat('RC_', CAST(l_linenumber AS VARCHAR)) END AS reason_code,
       l_shipdate + INTERVAL '1' DAY * CAST(l_suppkey % 10 - 1 AS INT) AS expiry_date,
       CASE WHEN l_linenumber % 6 = 1 THEN concat('RT_', CAST(l_suppkey % 69 AS VARCHAR)) END AS route_id
FROM lineitem""",
    "fx_production": """
SELECT concat('B_', CAST(CASE WHEN o_orderkey % 200 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR)) AS batch_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR * CAST(o_custkey % 24 AS INT) END AS timestamp,
       CASE WHEN o_custkey % 2 = 0 THEN 'Plant_A' ELSE 'Plant_B' END AS plant,
       CASE WHEN o_orderkey % 251 = 0 THEN NULL ELSE concat('Line', CAST(o_orderkey % 5 AS VARCHAR)) END AS line_id,
       concat('OP_', CAST(o_custkey % 6 AS VARCHAR)) AS operator_id,
       concat('SKU_', CAST(o_custkey % 7 AS VARCHAR)) AS sku,
       CAST(200 + o_custkey AS BIGINT) AS quantity_produced,
       CAST(o_orderkey % 10 AS BIGINT) AS stacked_before_robot,
       CAST(o_orderkey % 8 AS BIGINT) AS squashed,
       CAST(o_orderkey % 6 AS BIGINT) AS torn,
       CAST(o_orderkey % 12 AS BIGINT) AS undersized_small,
       CAST(o_orderkey % 11 AS BIGINT) AS valleys,
       CAST(o_orderkey % 14 AS BIGINT) AS loose_packs,
       CAST(o_orderkey % 5 AS BIGINT) AS pale_underbaked
FROM orders""",
    "fx_qc": f"""
SELECT l_orderkey * 10 + l_linenumber AS qc_id,
       {_SHIP_TS} AS timestamp,
       concat('B_', CAST(l_orderkey AS VARCHAR)) AS batch_id,
       concat('SKU_', CAST(l_partkey % 7 AS VARCHAR)) AS sku,
       concat('param_', CAST(l_linenumber AS VARCHAR)) AS parameter,
       CASE WHEN l_orderkey % 61 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS value,
       CASE WHEN l_discount > 0.06 THEN ' FAIL' ELSE 'Pass ' END AS pass_fail,
       CASE WHEN l_tax > 0.04 THEN concat('note ', l_returnflag, CAST(l_suppkey % 4 AS VARCHAR)) END AS notes
FROM lineitem""",
    "fx_waste": f"""
SELECT l_orderkey * 10 + l_linenumber AS waste_id,
       {_SHIP_TS} AS timestamp,
       concat('Plant_', CAST(l_suppkey % 2 AS VARCHAR)) AS plant_id,
       CASE WHEN l_linestatus = 'O' THEN 'production' ELSE 'post_dispatch' END AS stage,
       concat('SKU_', CAST(l_partkey % 16 AS VARCHAR)) AS sku,
       CAST(l_quantity AS BIGINT) AS qty_waste,
       concat('W_', CAST(l_linenumber AS VARCHAR)) AS waste_reason_code,
       CASE WHEN l_linestatus = 'O' THEN concat('B_', CAST(l_orderkey AS VARCHAR)) END AS batch_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Night' END AS shift,
       CASE WHEN l_linestatus = 'F' THEN concat('RT_', CAST(l_suppkey % 69 AS VARCHAR)) END AS route_id,
       CASE WHEN l_linestatus = 'F' THEN concat('STORE_', CAST(l_partkey % 199 AS VARCHAR)) END AS retailer_id,
       CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE 15 + l_tax * 300 END AS temperature_at_check,
       concat('H_', CAST(l_partkey % 5 AS VARCHAR)) AS handling_condition
FROM lineitem WHERE l_returnflag = 'R'""",
    "fx_returns": f"""
SELECT l_orderkey * 10 + l_linenumber AS return_id,
       {_SHIP_TS} AS timestamp,
       CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE concat('RT_', CAST(l_suppkey % 69 AS VARCHAR)) END AS route_id,
       concat('STORE_', CAST(l_partkey % 199 AS VARCHAR)) AS retailer_id,
       concat('SKU_', CAST(l_partkey % 17 AS VARCHAR)) AS sku,
       CAST(l_quantity AS BIGINT) AS qty_returned,
       CASE l_linenumber % 5 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Damaged Pack' WHEN 2 THEN 'crushed'
            WHEN 3 THEN 'Mould Growth' ELSE 'Returned Unsold' END AS reason_code,
       CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE 15 + l_tax * 300 END AS temperature_at_return,
       concat('H_', CAST(l_partkey % 5 AS VARCHAR)) AS handling_condition
FROM lineitem WHERE l_returnflag = 'A'""",
    "fx_routes": """
SELECT concat('RT_', CAST(s_suppkey % 69 AS VARCHAR)) AS route_id,
       s_name AS route_name,
       concat('TRUCK_', CAST(s_suppkey % 41 AS VARCHAR)) AS vehicle_id,
       CASE WHEN s_suppkey % 37 = 0 THEN NULL ELSE concat('DRIVER_', CAST(s_suppkey % 53 AS VARCHAR)) END AS driver_id,
       CAST((s_suppkey * 31) % 241 AS BIGINT) AS estimated_time_min,
       CAST(10 + (s_suppkey * 37) % 150 AS DOUBLE) AS distance_km,
       CASE WHEN s_suppkey % 47 = 0 THEN NULL ELSE concat(repeat(concat('STORE_', CAST(s_suppkey % 7 AS VARCHAR), ','),
            CAST(s_suppkey % 19 AS INT)), 'STORE_', CAST(s_suppkey AS VARCHAR)) END AS stops_list,
       r_name AS region,
       CASE s_suppkey % 3 WHEN 0 THEN '03:00-05:00' WHEN 1 THEN '04:00-06:00' ELSE '05:00-07:00' END AS trip_start_window,
       '16:00-18:00' AS trip_end_window,
       CAST(CASE s_suppkey % 4 WHEN 0 THEN 3000 WHEN 1 THEN 4000 WHEN 2 THEN 5500 ELSE 7000 END AS BIGINT) AS load_capacity_kg
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_retailer_master": """
SELECT concat('STORE_', CAST(c_custkey AS VARCHAR)) AS retailer_id, c_name AS retailer_name,
       c_mktsegment AS retailer_type, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def osql(views, body: str) -> str:
    """Prefix ``body`` with the fixture-view CTEs named in ``views``."""
    if isinstance(views, str):
        views = [views]
    ctes = [f"{v} AS ({VIEW_SQL[v]}\n)" for v in views]
    b = body.strip()
    if b[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + b[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + b
