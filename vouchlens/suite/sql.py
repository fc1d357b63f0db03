"""The role views once more, as SQL text for the check by another engine."""

AS_OF = "1999-01-01"

PAYMENTS = """
payments AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS supplier,
    CAST(o_orderdate AS DATE) AS invoice_date, 
    CASE WHEN l_partkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 30 * (1 + l_linenumber % 3) ELSE CAST(l_shipdate AS DATE) END AS due_date,
    CASE WHEN l_linestatus = 'O' THEN round(l_extendedprice * l_quantity, 2)
         ELSE round(l_extendedprice * l_quantity * (1 - l_discount), 4) END AS amount,
    CAST(30 * (1 + l_linenumber % 3) AS VARCHAR) || ' días' AS terms,
    CASE l_returnflag WHEN 'A' THEN 'Pagado' WHEN 'N' THEN 'Pendiente' ELSE 'Retrasado' END AS status,
    CASE WHEN l_quantity % 2 = 0 THEN 30 * (1 + l_linenumber % 3) ELSE CAST(l_quantity AS INTEGER) - 11 END AS credit_days,
    round(l_discount * 100) * 2 AS discount, round(l_tax * 100) AS penalty,
    o_orderpriority || '-' || CAST(l_suppkey % 20 AS VARCHAR) AS approver, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

HISTORY = """
history AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, CAST(o_orderdate AS DATE) AS date,
    l_suppkey AS supplier, p_type AS category, o_orderpriority AS method,
    round(l_extendedprice * l_quantity, 2) AS amount, l_quantity AS time,
    round(1 - l_discount * 10, 1) AS score, l_returnflag AS indicator,
    CASE WHEN month(o_orderdate) IN (11, 12, 1) THEN 'Alta' ELSE 'Baja' END AS season
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

RAW_HISTORY = HISTORY + """,
raw_history AS (
  SELECT id, part,
    CASE WHEN part % 97 = 0 THEN 'sin fecha' ELSE CAST(date AS VARCHAR) END AS date,
    CASE WHEN part % 89 = 0 THEN '?' ELSE CAST(supplier AS VARCHAR) END AS supplier,
    CASE WHEN part % 31 = 0 THEN NULL ELSE ' ' || category || ' ' END AS category,
    method,
    CASE WHEN part % 13 = 0 THEN 'n/a'
         WHEN id % 10 = 7 THEN '-' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)
         ELSE CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
    CASE WHEN part % 17 = 0 THEN NULL ELSE CAST(CAST(time - 2 AS INTEGER) AS VARCHAR) END AS time,
    CASE WHEN part % 19 = 0 THEN '' ELSE CAST(CAST(score * 1.25 AS DECIMAL(6,3)) AS VARCHAR) END AS score,
    indicator, season
  FROM history)"""


def exact_sum(column: str) -> str:
    return f"coalesce(CAST(sum(CAST({column} AS DECIMAL(28,6))) AS DOUBLE), 0.0)"


def exact_mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(28,6))) AS DOUBLE) / count({column})"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"coalesce(round_even({part} * 100.0 / nullif({whole}, 0), {digits}), 0.0)"


def unit_mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(28,12))) AS DOUBLE) / count({column})"
