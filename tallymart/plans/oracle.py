"""The same queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

# The test tables as sales, customers, stores, sellers and products.
SALES = """
SELECT o.o_custkey AS customer_id,
       CAST(s.s_nationkey AS BIGINT) AS store_id,
       p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) AS product_name,
       CAST(l.l_shipdate AS DATE) AS sales_date,
       strftime(l.l_shipdate, '%Y-%m') AS sales_month,
       l.l_suppkey AS sales_person_id,
       CAST(p.p_retailprice AS DECIMAL(18,2)) AS price,
       CAST(l.l_quantity AS INTEGER) AS quantity,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_cost,
       l.l_returnflag AS return_flag,
       l.l_linestatus AS line_status
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN part p ON p.p_partkey = l.l_partkey
"""
CUSTOMERS = """
SELECT c_custkey AS customer_id,
       split_part(c_name, '#', 1) AS first_name,
       split_part(c_name, '#', 2) AS last_name,
       c_mktsegment AS address,
       CAST(c_nationkey AS VARCHAR) AS pincode,
       '91' || CAST(c_custkey AS VARCHAR) AS phone_number
FROM customer
"""
STORES = """
SELECT CAST(n_nationkey AS BIGINT) AS id,
       n_name AS address,
       CAST(n_regionkey AS VARCHAR) AS store_pincode,
       'Manager of ' || n_name AS store_manager_name
FROM nation
"""
SELLERS = """
SELECT s_suppkey AS id,
       split_part(s_name, '#', 1) AS first_name,
       split_part(s_name, '#', 2) AS last_name,
       CAST(s_nationkey AS BIGINT) AS manager_id,
       CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS is_manager,
       'Nation ' || CAST(s_nationkey AS VARCHAR) AS address,
       CAST(s_nationkey AS VARCHAR) AS pincode
FROM supplier
"""
# Sales whose customer, store and seller are all in the dimensions, of which one segment and one region are missing.
KNOWN = """
SELECT x.* FROM sales x
JOIN customers c ON c.customer_id = x.customer_id AND c.address <> 'MACHINERY'
JOIN stores d ON d.id = x.store_id AND d.store_pincode <> '1'
JOIN sellers t ON t.id = x.sales_person_id
"""
SELLER_TOTALS = """
SELECT x.store_id, x.sales_person_id, t.first_name || ' ' || t.last_name AS full_name, x.sales_month,
       CAST(sum(x.total_cost) AS DECIMAL(28,2)) AS total
FROM known x
JOIN sellers t ON t.id = x.sales_person_id
GROUP BY ALL
"""
RANKED = """
SELECT *, rank() OVER (PARTITION BY store_id, sales_month ORDER BY total DESC NULLS LAST) AS rnk
FROM seller_totals
"""
INCENTIVE = "CAST(CASE WHEN rnk = 1 THEN round(total * 0.01, 2) ELSE 0 END AS DOUBLE) AS incentive"

WITH = f"""
WITH sales AS ({SALES}),
     customers AS ({CUSTOMERS}),
     stores AS ({STORES}),
     sellers AS ({SELLERS}),
     known AS ({KNOWN}),
     seller_totals AS ({SELLER_TOTALS}),
     ranked AS ({RANKED})
"""

CUSTOMER_MONTHLY_OF = """{with_}
SELECT x.customer_id, c.first_name || ' ' || c.last_name AS full_name, c.address, c.phone_number,
       x.sales_month AS sales_date_month, CAST(sum(x.total_cost) AS DOUBLE) AS total_sales
FROM {sales} x JOIN customers c ON c.customer_id = x.customer_id
GROUP BY ALL
"""
CUSTOMER_MONTHLY = CUSTOMER_MONTHLY_OF.format(with_=WITH, sales="known")
SALES_MART_ROWS = f"""{WITH}
SELECT x.store_id, x.sales_person_id, t.first_name AS sales_person_first_name,
       t.last_name AS sales_person_last_name, d.store_manager_name, t.manager_id, t.is_manager,
       t.address AS sales_person_address, t.pincode AS sales_person_pincode,
       CAST(x.sales_date AS VARCHAR) AS sales_date, CAST(x.total_cost AS DOUBLE) AS total_cost, x.sales_month
FROM known x
JOIN customers c ON c.customer_id = x.customer_id
JOIN stores d ON d.id = x.store_id
JOIN sellers t ON t.id = x.sales_person_id
"""
LOADED = """customer_id, store_id, product_name, CAST(sales_date AS VARCHAR) AS sales_date, sales_person_id,
       CAST(price AS DOUBLE) AS price, quantity, CAST(total_cost AS DOUBLE) AS total_cost"""
LEDGER = """
WITH files AS (
  SELECT *, 'sales_' || CAST(o_custkey AS VARCHAR) || '.csv' AS file_name,
         '/landing/' || substr(o_orderpriority, 1, 1) || '/sales_' || CAST(o_custkey AS VARCHAR) || '.csv' AS file_location
  FROM orders),
ledger AS (
  SELECT o_orderkey AS run_id, file_name, file_location, 'A' AS status, o_orderdate AS changed_at FROM files
  UNION ALL
  SELECT o_orderkey, file_name, file_location, 'I', o_orderdate + INTERVAL 1 DAY FROM files WHERE o_orderstatus = 'F'),
current AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (
    PARTITION BY file_location ORDER BY changed_at DESC, status DESC, run_id DESC) = 1)
"""

INCENTIVE_MONTHLY = f"""{WITH}
SELECT store_id, sales_person_id, full_name, sales_month, CAST(total AS DOUBLE) AS total_sales, {INCENTIVE}
FROM ranked
"""

ORACLE: dict[str, str] = {
    "incentive_monthly": INCENTIVE_MONTHLY,
    "incentive_from_rows": INCENTIVE_MONTHLY,
    "seller_monthly": f"""{WITH}
SELECT store_id, sales_person_id, full_name, sales_month, CAST(total AS DOUBLE) AS total_sales
FROM seller_totals
""",
    "seller_rank": f"""{WITH}
SELECT store_id, sales_month, sales_person_id, CAST(total AS DOUBLE) AS total_sales, rnk FROM ranked
""",
    "top_sellers": f"""{WITH}
SELECT store_id, sales_person_id, full_name, sales_month, CAST(total AS DOUBLE) AS total_sales
FROM ranked WHERE rnk = 1
""",
    "sales_with_seller_total": f"""{WITH}
SELECT store_id, sales_person_id, sales_date, CAST(total_cost AS DOUBLE) AS total_cost, sales_month,
       CAST(sum(total_cost) OVER (PARTITION BY store_id, sales_person_id, sales_month) AS DOUBLE) AS total_sales
FROM sales
""",
    "customer_monthly": CUSTOMER_MONTHLY,
    "customer_monthly_window": CUSTOMER_MONTHLY,
    "customer_monthly_of_known_sales": f"""{WITH}
SELECT x.customer_id, c.first_name || ' ' || c.last_name AS full_name, c.address, c.phone_number,
       x.sales_month AS sales_date_month, CAST(sum(x.total_cost) AS DOUBLE) AS total_sales
FROM sales x JOIN customers c ON c.customer_id = x.customer_id AND c.address <> 'MACHINERY'
GROUP BY ALL
""",
    "customer_monthly_of_all_sales": CUSTOMER_MONTHLY_OF.format(with_=WITH, sales="sales"),
    "customer_monthly_from_rows": CUSTOMER_MONTHLY,
    "customer_daily": f"""{WITH}
SELECT customer_id, sales_month, CAST(sales_date AS VARCHAR) AS sales_date,
       CAST(sum(total_cost) AS DOUBLE) AS total_sales
FROM known GROUP BY ALL
""",
    "enriched_sales": f"""{WITH}
SELECT x.customer_id, x.store_id, x.sales_person_id, CAST(x.sales_date AS VARCHAR) AS sales_date,
       CAST(x.total_cost AS DOUBLE) AS total_cost, d.address AS store_address, d.store_manager_name,
       t.first_name AS sales_person_first_name, t.last_name AS sales_person_last_name,
       t.address AS sales_person_address, t.pincode AS sales_person_pincode, t.manager_id, t.is_manager,
       c.first_name, c.last_name, c.address, c.pincode, c.phone_number
FROM known x
JOIN customers c ON c.customer_id = x.customer_id
JOIN stores d ON d.id = x.store_id
JOIN sellers t ON t.id = x.sales_person_id
""",
    "customer_mart_rows": f"""{WITH}
SELECT x.customer_id, c.first_name, c.last_name, c.address, c.pincode, c.phone_number,
       CAST(x.sales_date AS VARCHAR) AS sales_date, CAST(x.total_cost AS DOUBLE) AS total_cost
FROM known x
JOIN customers c ON c.customer_id = x.customer_id
JOIN stores d ON d.id = x.store_id
JOIN sellers t ON t.id = x.sales_person_id
""",
    "sales_mart_rows": SALES_MART_ROWS,
    "sales_partitioned_readback": SALES_MART_ROWS,
    "seller_report_csv": f"""{WITH}
SELECT store_id, full_name, CAST(total AS DOUBLE) AS total_sales, {INCENTIVE}, sales_month FROM ranked
""",
    "versioned_publish": f"""{WITH}
SELECT sales_month AS sales_date_month, CAST(sum(total_cost) AS DOUBLE) AS total_sales, count(*) AS n_rows,
       CASE WHEN month(sales_date) <= 6 THEN 1 ELSE 3 END AS run_id
FROM known GROUP BY ALL
""",
    "pay_mode_totals": """
SELECT event_type AS pay_mode, CAST(round(sum(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_amount
FROM events GROUP BY event_type ORDER BY total_amount
""",
    "monthly_total": """
SELECT strftime(l_shipdate, '%Y-%m') AS sales_month,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales,
       strftime(l_shipdate, '%Y-%m') || '-01' AS month_start
FROM lineitem GROUP BY ALL ORDER BY sales_month
""",
    "column_profile": """
SELECT count(*) AS n_rows, count(DISTINCT event_id) AS distinct_transaction_id,
       count(DISTINCT user_id) AS distinct_account_number, count(DISTINCT event_type) AS distinct_pay_mode,
       count(DISTINCT ts) AS distinct_timestamp, count(DISTINCT CAST(value AS DECIMAL(18,2))) AS distinct_amount
FROM events
""",
    "sketched_profile": """
WITH counted AS (
  SELECT count(*) AS n_rows, count(DISTINCT event_id) AS transaction_id, count(DISTINCT user_id) AS account_number,
         count(DISTINCT event_type) AS pay_mode, count(DISTINCT ts) AS timestamp, count(DISTINCT CAST(value AS DECIMAL(18,2))) AS amount
  FROM events)
SELECT column_name, n_rows, n_distinct, true AS within_bound
FROM (UNPIVOT counted ON COLUMNS(* EXCLUDE (n_rows)) INTO NAME column_name VALUE n_distinct)
""",
    "product_enrich": f"""{WITH},
products AS (SELECT p_partkey AS product_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
                    CAST(p_retailprice AS DECIMAL(10,2)) AS price FROM part)
SELECT x.product_name, x.customer_id, x.sales_person_id, x.quantity, CAST(x.total_cost AS DOUBLE) AS total_cost,
       p.product_id, CAST(p.price AS DOUBLE) AS current_price, CAST(p.price AS DOUBLE) AS old_price
FROM sales x LEFT JOIN products p ON p.name = x.product_name AND p.product_id % 7 <> 0
""",
    "price_mismatch": f"""{WITH}
SELECT customer_id, sales_person_id, product_name, CAST(price AS DOUBLE) AS price, quantity,
       CAST(total_cost AS DOUBLE) AS total_cost
FROM sales WHERE total_cost <> price * quantity AND length(product_name) % 4 <> 0
""",
    "unmatched_keys": f"""{WITH}
SELECT 'customer_id' AS key_column, CAST(customer_id AS VARCHAR) AS key_value, count(*) AS sales_rows,
       CAST(sum(total_cost) AS DOUBLE) AS lost_amount
FROM sales x WHERE NOT EXISTS (
  SELECT 1 FROM customers c WHERE c.customer_id = x.customer_id AND c.address <> 'MACHINERY') GROUP BY ALL
UNION ALL
SELECT 'store_id', CAST(store_id AS VARCHAR), count(*), CAST(sum(total_cost) AS DOUBLE)
FROM sales x WHERE NOT EXISTS (
  SELECT 1 FROM stores d WHERE d.id = x.store_id AND d.store_pincode <> '1') GROUP BY ALL
UNION ALL
SELECT 'sales_person_id', CAST(sales_person_id AS VARCHAR), count(*), CAST(sum(total_cost) AS DOUBLE)
FROM sales x WHERE NOT EXISTS (SELECT 1 FROM sellers t WHERE t.id = x.sales_person_id) GROUP BY ALL
""",
    "normalise_extra_columns": f"""{WITH}
SELECT {LOADED}, concat_ws(', ', return_flag, line_status) AS additional_columns FROM sales
""",
    "union_files": f"""{WITH}
SELECT {LOADED}, NULL AS additional_columns FROM sales WHERE return_flag = 'N'
UNION ALL
SELECT {LOADED}, NULL FROM sales WHERE return_flag = 'A'
UNION ALL
SELECT {LOADED}, concat_ws(', ', return_flag, line_status) FROM sales WHERE return_flag NOT IN ('N', 'A')
""",
    "rejected_cells": f"""{WITH}
SELECT concat_ws(',', customer_id, store_id, product_name,
                 CASE WHEN quantity % 2 = 0 THEN sales_month ELSE CAST(sales_date AS VARCHAR) END, sales_person_id,
                 CAST(price AS VARCHAR) || CASE WHEN quantity % 3 = 0 THEN '5' ELSE '' END,
                 CAST(quantity AS VARCHAR) || ' pcs', total_cost) AS raw_line,
       concat_ws(',', CASE WHEN quantity % 2 = 0 THEN 'sales_date' END,
                 CASE WHEN quantity % 3 = 0 THEN 'price' END, 'quantity') AS bad_cells
FROM sales WHERE return_flag = 'R'
UNION ALL
SELECT concat_ws(',', customer_id, store_id, product_name, sales_date, sales_person_id, price), 'row'
FROM sales WHERE return_flag = 'A'
UNION ALL
SELECT concat_ws(',', customer_id, store_id, product_name, sales_date, sales_person_id, price, quantity, total_cost, 'more'), 'row'
FROM sales WHERE return_flag = 'N' AND line_status = 'O' AND quantity % 5 = 0
""",
    "load_metrics": f"""{WITH},
counted AS (
  SELECT count(*) AS lines_read, count(*) FILTER (return_flag <> 'R') AS lines_accepted, count(*) FILTER (return_flag = 'R') AS lines_rejected,
         0 AS bad_customer_id, 0 AS bad_store_id, 0 AS bad_product_name, 0 AS bad_sales_person_id, 0 AS bad_total_cost, 0 AS bad_row,
         count(*) FILTER (return_flag = 'R' AND quantity % 2 = 0) AS bad_sales_date,
         count(*) FILTER (return_flag = 'R' AND quantity % 3 = 0) AS bad_price,
         count(*) FILTER (return_flag = 'R') AS bad_quantity
  FROM sales)
SELECT metric, CAST(n AS BIGINT) AS n FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS BIGINT) FROM counted) ON COLUMNS(*) INTO NAME metric VALUE n)
""",
    "file_metrics": f"""{WITH}
SELECT CASE line_status WHEN 'F' THEN 'finished' ELSE 'open' END AS folder, count(*) AS lines_read,
       count(*) FILTER (return_flag <> 'R') AS lines_accepted, count(*) FILTER (return_flag = 'R') AS lines_rejected,
       0 AS bad_customer_id, 0 AS bad_store_id, 0 AS bad_product_name, 0 AS bad_sales_person_id, 0 AS bad_total_cost, 0 AS bad_row,
       count(*) FILTER (return_flag = 'R' AND quantity % 2 = 0) AS bad_sales_date,
       count(*) FILTER (return_flag = 'R' AND quantity % 3 = 0) AS bad_price, count(*) FILTER (return_flag = 'R') AS bad_quantity
FROM sales GROUP BY ALL
""",
    "schema_check": """
SELECT 'accepted' AS verdict, '' AS missing, '' AS extra, count(*) AS n_rows
FROM lineitem WHERE l_returnflag IN ('N', 'A')
UNION ALL
SELECT 'accepted', '', 'return_flag,line_status', count(*) FROM lineitem WHERE l_returnflag NOT IN ('N', 'A')
UNION ALL
SELECT 'missing_columns', 'store_id,product_name,sales_person_id,price,total_cost', '', count(*) FROM lineitem
UNION ALL
SELECT 'not_csv', '', '', count(*) FROM part
""",
    "ledger_status": f"""{LEDGER}
SELECT file_location, file_name, run_id, status, strftime(changed_at, '%Y-%m-%d') AS changed_at FROM current
""",
    "failed_run_check": f"""{LEDGER}
SELECT file_location AS path, file_name FROM current WHERE status = 'A' AND file_location IN (
  SELECT file_location FROM files WHERE o_custkey % 2 = 0)
""",
    "incremental_ingest": f"""{WITH}
SELECT 'customer' AS mart, customer_id AS key, sales_month, CAST(sum(total_cost) AS DOUBLE) AS total_sales,
       CAST(NULL AS DOUBLE) AS incentive
FROM known GROUP BY ALL
UNION ALL
SELECT 'seller', sales_person_id, sales_month, CAST(total AS DOUBLE), {INCENTIVE} FROM ranked
""",
    "ingest_books": f"""{WITH}
SELECT 'ledger ' || CASE line_status WHEN 'F' THEN 'first' ELSE 'second' END || ' I' AS what, CAST(1 AS DOUBLE) AS n
FROM sales GROUP BY ALL
UNION ALL
SELECT 'quarantine missing_columns', 1
UNION ALL
SELECT 'unmatched customer_id', count(*) FROM sales
WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE address <> 'MACHINERY') HAVING count(*) > 0
UNION ALL
SELECT 'unmatched store_id', count(*) FROM sales
WHERE store_id NOT IN (SELECT id FROM stores WHERE store_pincode <> '1') HAVING count(*) > 0
UNION ALL
SELECT 'customer mart', count(*) FROM known
UNION ALL
SELECT 'store ' || CAST(store_id AS VARCHAR), count(*) FROM known GROUP BY ALL
""",
    "tied_sellers": f"""{WITH},
counted AS (
  SELECT x.store_id, x.sales_person_id, t.first_name || ' ' || t.last_name AS full_name, x.sales_month,
         CAST(count(*) AS DECIMAL(28,2)) AS total
  FROM known x JOIN sellers t ON t.id = x.sales_person_id GROUP BY ALL),
placed AS (SELECT *, rank() OVER (PARTITION BY store_id, sales_month ORDER BY total DESC) AS rnk FROM counted)
SELECT store_id, sales_person_id, full_name, sales_month, CAST(total AS DOUBLE) AS total_sales, {INCENTIVE} FROM placed
""",
}
