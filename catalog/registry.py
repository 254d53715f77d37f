"""Registration of queries, and the SQL views of the analysis inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the equivalent DuckDB statement."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def rounded(df: DataFrame, digits: Mapping[str, int] | int, *cols: str) -> DataFrame:
    """Rounds doubles so that engines which add in a different order still agree."""
    wanted = digits if isinstance(digits, Mapping) else {c: digits for c in cols}
    return df.select(*[F.round(c, wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in df.columns])


def bucket_sql(key: str, salt: str, k: int) -> str:
    return f"(CAST('0x' || substr(md5({key} || '|{salt}'), 1, 8) AS BIGINT) % {k})"


# Invoice lines.  `rev` is the amount as summed, `q` the quantity as summed.
T = """
t AS (
  SELECT l_orderkey AS InvoiceNo, l_linenumber AS LineNo, o_custkey AS CustomerID,
         l_quantity AS Quantity, p_retailprice AS UnitPrice, o_orderdate AS InvoiceDate, n_name AS Country,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS m,
         CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS qtr,
         p_retailprice * l_quantity AS Revenue,
         CAST(p_retailprice * l_quantity AS DECIMAL(18, 4)) AS rev,
         CAST(l_quantity AS DECIMAL(18, 4)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

# Sign-ups, by day.
A = """
a AS (
  SELECT user_id AS CustomerID,
         min(ts) FILTER (event_type = 'purchase') AS MinPurchaseDate,
         min({'ts': ts, 'event_id': event_id, 'n': CAST(json_extract_string(props, '$.k') AS INTEGER) % 3})
           FILTER (event_type = 'signup') AS s
  FROM events GROUP BY user_id
),
signup AS (
  SELECT CustomerID, CAST(strftime(MinPurchaseDate, '%Y%m%d') AS INTEGER) AS MinPurchasePeriod,
         CAST(strftime(s.ts, '%Y%m%d') AS INTEGER) AS SignupPeriod,
         CASE s.n WHEN 0 THEN 'organic' WHEN 1 THEN 'inorganic' ELSE 'referral' END AS AcqChannel
  FROM a WHERE s IS NOT NULL
)"""

_yes_no = ",\n".join(
    f"CASE {bucket_sql('c_custkey', c, 2)} WHEN 0 THEN 'No' ELSE 'Yes' END AS {c}"
    for c in ("Partner", "PhoneService", "PaperlessBilling")
)
_three_way = ",\n".join(
    f"CASE {bucket_sql('c_custkey', c, 3)} WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'No internet service' END AS {c}"
    for c in (
        "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
        "TechSupport", "StreamingTV", "StreamingMovies",
    )
)

# Subscribers; `Churn` already as 1/0.
S = f"""
prio AS (
  SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL
),
modal AS (
  SELECT o_custkey, arg_max(o_orderpriority, {{'n': n, 'p': o_orderpriority}}) AS p FROM prio GROUP BY o_custkey
),
hist AS (
  SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS spent,
         min(o_orderdate) AS first, max(o_orderdate) AS last
  FROM orders GROUP BY o_custkey
),
s AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customerID,
    CASE {bucket_sql('c_custkey', 'gender', 2)} WHEN 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST({bucket_sql('c_custkey', 'SeniorCitizen', 2)} AS INTEGER) AS SeniorCitizen,
    {_yes_no},
    {_three_way},
    r_name AS InternetService, c_mktsegment AS Contract, p AS PaymentMethod,
    CAST((year(last) * 12 + month(last)) - (year(first) * 12 + month(first)) AS INTEGER) AS tenure,
    CAST(spent AS DOUBLE) / n AS MonthlyCharges,
    CASE WHEN {bucket_sql('c_custkey', 'TotalCharges', 20)} = 0 THEN ' '
         ELSE CAST(CAST(spent AS DECIMAL(28, 4)) AS VARCHAR) END AS TotalCharges,
    CASE WHEN last < TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END AS Churn
  FROM customer JOIN hist ON c_custkey = hist.o_custkey JOIN modal ON c_custkey = modal.o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""

# Monthly totals of daily sales; every calendar month between the first and the last.
D = """
d AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(CAST(l_quantity AS DECIMAL(18, 4))) AS v
  FROM lineitem GROUP BY 1
),
cal AS (
  SELECT CAST(unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 MONTH)) AS DATE) AS date
),
monthly AS (SELECT cal.date AS date, CAST(coalesce(v, 0) AS DOUBLE) AS sales FROM cal LEFT JOIN d USING (date)),
diffs AS (
  SELECT * FROM (SELECT date, sales, lag(sales) OVER (ORDER BY date) AS prev_sales,
                        sales - lag(sales) OVER (ORDER BY date) AS diff FROM monthly)
  WHERE prev_sales IS NOT NULL
)"""

LAGS_SQL = ", ".join(f"lag(diff, {i}) OVER (ORDER BY date) AS lag_{i}" for i in range(1, 13))
SUPERVISED = f"""{D},
lagged AS (SELECT * FROM (SELECT date, sales, diff, {LAGS_SQL} FROM diffs) WHERE lag_12 IS NOT NULL),
split AS (SELECT *, row_number() OVER (ORDER BY date DESC) > 6 AS is_train FROM lagged)"""


def _pick_sql(salt: str, *names: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {bucket_sql('customer_id', salt, len(names))} {cases} END AS {salt}"


# Campaign responses.
R = f"""
per_order AS (
  SELECT l_orderkey, max(CAST(l_discount > 0.05::DOUBLE AS INTEGER)) AS disc,
         max(CAST(l_quantity % 2 = 0 AS INTEGER)) AS paired
  FROM lineitem GROUP BY l_orderkey
),
cust AS (
  SELECT o_custkey AS customer_id,
         max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '2001-05-01') AS last,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) FILTER (o_orderdate < TIMESTAMP '2001-05-01') AS DOUBLE) AS history,
         coalesce(max(disc) FILTER (o_orderdate < TIMESTAMP '2001-05-01'), 0) AS used_discount,
         coalesce(max(paired) FILTER (o_orderdate < TIMESTAMP '2001-05-01'), 0) AS used_bogo,
         max(CAST(o_orderdate >= TIMESTAMP '2001-05-01' AS INTEGER)) AS conversion
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey GROUP BY o_custkey
),
r AS (
  SELECT customer_id, CAST(2001 * 12 + 5 - (year(last) * 12 + month(last)) AS INTEGER) AS recency, history,
         used_discount, used_bogo, {_pick_sql('zip_code', 'Suburban', 'Urban', 'Rural')},
         CAST({bucket_sql('customer_id', 'is_referral', 2)} AS INTEGER) AS is_referral,
         {_pick_sql('channel', 'Phone', 'Web', 'Multichannel')},
         {_pick_sql('offer', 'Discount', 'Buy One Get One', 'No Offer')}, conversion
  FROM cust WHERE last IS NOT NULL
)"""


def experiment_sql(*groups: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(groups))
    return f"""
pc AS (
  SELECT o_custkey, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS now,
         count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01') AS prev
  FROM orders GROUP BY o_custkey
),
e AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_acctbal >= 4500 THEN 'high-value' ELSE 'low-value' END AS segment,
         CASE {bucket_sql('c_custkey', 'group', len(groups))} {cases} END AS grp,
         CAST(coalesce(now, 0) AS DOUBLE) AS purchase_count, CAST(coalesce(prev, 0) AS BIGINT) AS prev_purchase_count
  FROM customer LEFT JOIN pc ON c_custkey = o_custkey
)"""


def nearest_sql(col: str, centers: list[float]) -> str:
    """The position of the nearest centre, the first one on a tie."""
    gaps = [f"abs({col} - {c!r}::DOUBLE)" for c in centers]
    least = f"least({', '.join(gaps)})"
    return "CASE " + " ".join(f"WHEN {g} = {least} THEN {i}" for i, g in enumerate(gaps)) + " END"


def unit_sql(key: str, salt: str) -> str:
    return f"(CAST({bucket_sql(key, salt, 1_000_000)} AS DOUBLE) / 1000000.0::DOUBLE)"


def clusters_sql(name: str, source: str, col: str, k: int) -> str:
    """The best k clusters of a column of ``source``, by comparing all starts of the last cluster.

    Tables: ``{name}_label (v, c)``, the cluster of each value, and ``{name}_cost (k, c)``, the
    squared error of 1 … k clusters.
    """
    tables = [
        f"""{name}_v AS (SELECT CAST({col} AS DOUBLE) AS v, count(*) AS w FROM {source} WHERE {col} IS NOT NULL GROUP BY 1)""",
        f"""{name}_p AS MATERIALIZED (
  SELECT v, row_number() OVER o AS i, sum(w) OVER o AS sw, sum(w * (v - m)) OVER o AS s1, sum(w * (v - m) * (v - m)) OVER o AS s2
  FROM {name}_v, (SELECT sum(v * w) / sum(w) AS m FROM {name}_v) WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING))""",
        f"{name}_l1 AS MATERIALIZED (SELECT i, s2 - s1 * s1 / sw AS c, 0 AS cut FROM {name}_p)",
        f"{name}_e{k} AS (SELECT max(i) AS e FROM {name}_p)",
    ]
    for j in range(2, k + 1):
        cost = "l.c + greatest(0, b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.sw - a.sw))"
        tables.append(
            f"""{name}_l{j} AS MATERIALIZED (
  SELECT b.i, min({cost}) AS c, arg_min(l.i, {{'c': {cost}, 'i': l.i}}) AS cut
  FROM {name}_p b JOIN {name}_l{j - 1} l ON l.i < b.i JOIN {name}_p a ON a.i = l.i GROUP BY b.i)"""
        )
    for j in range(k, 1, -1):
        end = f"(SELECT e FROM {name}_e{j})"
        tables.append(f"{name}_e{j - 1} AS (SELECT coalesce((SELECT cut FROM {name}_l{j} WHERE i = {end}), {end}) AS e)")
    ends = " UNION ".join(f"SELECT e FROM {name}_e{j}" for j in range(1, k))
    tables.append(f"{name}_label AS (SELECT v, CAST((SELECT count(*) FROM ({ends}) WHERE e < p.i) AS INTEGER) AS c FROM {name}_p p)")
    costs = " UNION ALL ".join(
        f"SELECT {j} AS k, coalesce((SELECT c FROM {name}_l{j} WHERE i = (SELECT max(i) FROM {name}_p)), 0) AS c" for j in range(1, k + 1)
    )
    tables.append(f"{name}_cost AS ({costs})")
    return ",\n".join(tables)
