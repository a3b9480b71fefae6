"""SQL text of the adapter tables (FIXTURES.md §2), for the oracles.

Written from the definitions, not from the Spark plans.
"""

OBS = "DATE '2001-08-01'"

_PLAYERS = f"""
 line_totals AS (
  SELECT l_orderkey AS ok, sum(l_quantity) AS qty, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
 sess AS (
  SELECT o.o_custkey AS cust, CAST(o.o_orderdate AS DATE) AS d, o.o_totalprice AS price,
         o.o_orderpriority = '1-URGENT' AS urgent, t.qty, t.n_lines
  FROM orders o LEFT JOIN line_totals t ON t.ok = o.o_orderkey),
 starts AS (SELECT cust, min(d) AS d0 FROM sess GROUP BY cust),
 per_cust AS (
  SELECT s.cust, min(s.d) AS install_date, max(s.d) AS last_active_date, count(*) AS total_sessions,
    count(DISTINCT s.d) AS days_active, CAST(coalesce(sum(s.n_lines), 0) AS BIGINT) AS max_stage_reached,
    sum(s.qty) AS qty,
    max(CASE WHEN s.d - k.d0 BETWEEN 1 AND 90 THEN 1 ELSE 0 END) AS d1_retained,
    max(CASE WHEN s.d - k.d0 BETWEEN 1 AND 365 THEN 1 ELSE 0 END) AS d7_retained,
    max(CASE WHEN s.d - k.d0 BETWEEN 1 AND 730 THEN 1 ELSE 0 END) AS d30_retained,
    count(*) FILTER (WHERE s.urgent) AS num_purchases,
    coalesce(sum(s.price) FILTER (WHERE s.urgent), 0.0) AS total_spend_usd,
    min(s.d) FILTER (WHERE s.urgent) AS first_buy,
    coalesce(sum(s.price) FILTER (WHERE s.d < DATE '1998-07-01'), 0.0) AS pre_spend,
    coalesce(sum(s.price) FILTER (WHERE s.d >= DATE '1998-07-01'), 0.0) AS post_spend
  FROM sess s JOIN starts k ON k.cust = s.cust GROUP BY s.cust),
 base AS (
  SELECT c.c_custkey AS player_id, p.install_date, p.last_active_date, c.c_mktsegment AS platform,
    n.n_name AS country, CASE WHEN c.c_acctbal > 5000 THEN 1 ELSE 0 END AS fb_connected,
    CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END AS tutorial_completed, p.total_sessions,
    coalesce(p.qty / nullif(p.max_stage_reached, 0), 0.0) AS avg_session_minutes,
    p.total_sessions * coalesce(p.qty / nullif(p.max_stage_reached, 0), 0.0) / 60 AS total_play_hours,
    p.days_active, p.max_stage_reached, p.d1_retained, p.d7_retained, p.d30_retained,
    CASE WHEN p.num_purchases > 0 THEN 1 ELSE 0 END AS is_payer, p.total_spend_usd, p.num_purchases,
    p.first_buy - p.install_date AS days_to_first_purchase,
    CASE WHEN {OBS} - p.last_active_date >= 180 THEN 1 ELSE 0 END AS churned_d7
  FROM per_cust p JOIN customer c ON c.c_custkey = p.cust LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
 players AS (
  SELECT b.*, CASE
    WHEN is_payer = 0 THEN 'free_rider'
    WHEN total_spend_usd >= (SELECT quantile_cont(total_spend_usd, 0.97) FROM base WHERE total_spend_usd > 0)
      THEN 'whale'
    WHEN total_spend_usd >= (SELECT quantile_cont(total_spend_usd, 0.80) FROM base WHERE total_spend_usd > 0)
      THEN 'dolphin'
    ELSE 'minnow' END AS player_tier FROM base b)"""

_TXNS = """
 transactions AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS transaction_id, o.o_custkey AS player_id,
    CAST(o.o_orderdate AS DATE) AS transaction_date, p.p_name AS item_name, p.p_brand AS item_category,
    l.l_extendedprice * (1 - l.l_discount) AS price_usd
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
  WHERE o.o_orderpriority = '1-URGENT')"""

_UNITS = """
 units AS (
  SELECT cust AS userid, CASE WHEN cust % 2 = 0 THEN 'gate_30' ELSE 'gate_40' END AS version,
    total_sessions AS sum_gamerounds, d1_retained AS retention_1, d7_retained AS retention_7,
    pre_spend, post_spend AS revenue FROM per_cust)"""

_ACTIVITY = """
 activity AS (
  SELECT user_id AS player_id, ts, CAST(ts AS DATE) AS day, event_type, value FROM events)"""

PLAYERS = "WITH" + _PLAYERS
TXNS = "WITH" + _TXNS
BOTH = "WITH" + _PLAYERS + "," + _TXNS
UNITS = "WITH" + _PLAYERS.split(",\n base AS")[0] + "," + _UNITS
ACTIVITY = "WITH" + _ACTIVITY
