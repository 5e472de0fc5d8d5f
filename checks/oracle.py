"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


H = "[a-zA-Z0-9._-]"


def mask(x: str) -> str:
    fenced = f"regexp_replace({x}, '({H}{{2,}})(@[a-zA-Z]+)', chr(1) || '\\1' || chr(2) || '\\2', 'g')"
    cut = f"regexp_replace({fenced}, chr(1) || '({H}{{3}}){H}+' || chr(2), '\\1***', 'g')"
    return f"regexp_replace({cut}, chr(1) || '{H}{{2,3}}' || chr(2), '***', 'g')"


def scrub(x: str, mask_first: bool = True) -> str:
    n = mask(x) if mask_first else x
    n = (f"regexp_replace({n}, '(?i)^\\s*(paid to|received from|payment to|sent to|money sent to|"
         "money received from|to|from)\\s+', '')")
    n = f"regexp_replace({n}, '@[a-zA-Z]+', '', 'g')"
    n = f"regexp_replace({n}, '[\\s\\-_]*\\d{{4,}}$', '')"
    n = f"regexp_replace({n}, '(?i)\\b(pvt|ltd|limited|india|payment|upi|txn|ref|order)\\b', '', 'g')"
    n = f"regexp_replace({n}, '[^\\w\\s&]', ' ', 'g')"
    n = f"upper(trim(regexp_replace({n}, '\\s+', ' ', 'g')))"
    return f"coalesce(nullif({n}, ''), 'UNKNOWN')"


def with_(*ctes: str, select: str) -> str:
    seen: list[str] = []
    for group in ctes:
        for part in group if isinstance(group, (list, tuple)) else [group]:
            if part not in seen:
                seen.append(part)
    return "WITH RECURSIVE " + ",\n".join(seen) + "\n" + select


# --- derived inputs ------------------------------------------------------------------
LEDGER = [
    """base AS (
  SELECT o_orderkey AS k, p_name AS name, o_orderdate + to_seconds(o_orderkey % 86400) AS txn_date,
    CAST((CAST(floor(o_totalprice / 100) AS BIGINT) * 100 + o_orderkey % 100)
      * CASE WHEN o_orderkey % 97 = 0 THEN 20 ELSE 1 END / 100.0 AS DECIMAL(14,2)) AS amount,
    CASE WHEN o_orderkey % 11 = 0 THEN 'credit' ELSE 'debit' END AS direction
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))""",
    """named AS (
  SELECT k, k * 4 AS row_no, txn_date, amount, direction,
    CASE WHEN direction = 'credit' AND k % 2 = 0 THEN 'Refund from ' || name
      WHEN direction = 'credit' THEN 'Received from ' || name
      WHEN k % 5 = 0 THEN 'Payment to ' || name || ' Pvt Ltd'
      WHEN k % 5 = 1 THEN name || '@ybl'
      WHEN k % 5 = 2 THEN 'Paid to ' || name || ' ' || (10000 + k % 90000)
      WHEN k % 5 = 3 THEN upper(name)
      ELSE 'Paid to ' || name END AS counterparty_raw,
    CASE WHEN k % 4 <> 0 THEN 'UTR' || k END AS reference_id
  FROM base)""",
    """ledger AS (
  SELECT 'orders' AS source_file, row_no, txn_date, amount, direction, counterparty_raw, reference_id
  FROM named
  UNION ALL
  SELECT 'orders', row_no + 1, txn_date, amount, direction, counterparty_raw, reference_id
  FROM named WHERE k % 50 = 0
  UNION ALL
  SELECT 'orders', row_no + 2, txn_date + to_seconds(7200), amount, 'credit',
    'Received from Self Account', NULL
  FROM named WHERE k % 40 = 7 AND k % 11 <> 0
  UNION ALL
  SELECT 'subs', c_custkey * 12 + i,
    TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(30 * i + (c_custkey + 7 * i) % 3 - 1 AS INTEGER)),
    CAST(100 + c_custkey % 500 AS DECIMAL(14,2)), 'debit',
    'Paid to Sub ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij'),
    'SUB' || (c_custkey * 12 + i)
  FROM customer, (SELECT unnest(range(12)) AS i))""",
]

KEYED = LEDGER + [
    f"""keyed AS (
  SELECT *, substr(sha256(CASE WHEN reference_id IS NOT NULL
      THEN 'ref:' || reference_id || '|' || direction || '|' || CAST(amount AS VARCHAR)
      ELSE {day('txn_date')} || '|' || CAST(amount AS VARCHAR) || '|' || direction || '|'
        || lower(counterparty_raw) END), 1, 32) AS dedup_key,
    substr(sha256(reference_id), 1, 16) AS reference_hash,
    {scrub('counterparty_raw')} AS scrubbed,
    {mask('counterparty_raw')} AS masked
  FROM ledger)""",
]

PAIRS = LEDGER + [
    """offset_pairs AS (
  SELECT d.source_file AS d_file, d.row_no AS d_row, c.source_file AS c_file, c.row_no AS c_row
  FROM ledger d JOIN ledger c ON c.amount = d.amount
  WHERE d.direction = 'debit' AND c.direction = 'credit'
    AND abs(epoch_us(c.txn_date) - epoch_us(d.txn_date)) <= 172800000000
  QUALIFY row_number() OVER (PARTITION BY d.source_file, d.row_no
    ORDER BY c.txn_date, c.source_file, c.row_no) = 1)""",
    """offsets AS (
  SELECT d_file AS source_file, d_row AS row_no FROM offset_pairs
  UNION SELECT c_file, c_row FROM offset_pairs)""",
]


def kind(name: str) -> str:
    return f"""CASE WHEN regexp_matches({name}, '(?i)SELF|OWN ACCOUNT|MY ACCOUNT|UPI LITE')
      THEN 'self_transfer'
    WHEN direction = 'credit' AND lower(masked) LIKE '%refund%' THEN 'refund'
    WHEN direction = 'credit' THEN 'income' ELSE 'spend' END"""


def cleaned_as(cte: str, source: str, name: str) -> str:
    return f"""{cte} AS (
  SELECT dedup_key AS id, txn_date, amount, direction,
    CASE WHEN o.row_no IS NOT NULL THEN 'self_transfer' ELSE {kind(name)} END AS txn_kind,
    masked AS counterparty_raw, {name} AS counterparty_normalized, reference_hash,
    s.source_file, s.row_no
  FROM {source} s LEFT JOIN offsets o ON o.source_file = s.source_file AND o.row_no = s.row_no
  QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY s.source_file, s.row_no) = 1)"""


CLEAN = KEYED + PAIRS + [cleaned_as("cleaned", "keyed", "scrubbed")]
SPEND = CLEAN + ["spend AS MATERIALIZED (SELECT * FROM cleaned WHERE txn_kind = 'spend')"]


def gaps_cte(cte: str, source: str, merchant: str) -> str:
    return f"""{cte} AS (
  SELECT *, CAST(floor((epoch_us(txn_date) - lag(epoch_us(txn_date)) OVER (
      PARTITION BY {merchant} ORDER BY txn_date, id)) / 86400000000) AS BIGINT) AS gap
  FROM {source})"""


PROFILE = SPEND + [
    gaps_cte("gaps", "spend", "counterparty_normalized"),
    """profile AS (
  SELECT counterparty_normalized, count(*) AS n, avg(CAST(amount AS DOUBLE)) AS mean_amount,
    ln(1 + CAST(count(*) AS DOUBLE)) AS merchant_frequency,
    CASE WHEN avg(CAST(amount AS DOUBLE)) = 0 THEN 1.0::DOUBLE ELSE
      greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        1 - stddev_pop(CAST(amount AS DOUBLE)) / avg(CAST(amount AS DOUBLE)))) END AS amount_stability,
    count(*) FILTER (gap > 0) AS n_gaps, avg(gap) FILTER (gap > 0) AS gap_mean,
    stddev_pop(gap) FILTER (gap > 0) AS gap_std
  FROM gaps GROUP BY 1)""",
    """recurring AS (
  SELECT *, CASE WHEN n >= 3 AND n_gaps >= 2 AND gap_std / gap_mean <= 0.25
      AND (abs(gap_mean - 7) <= 2.1 OR abs(gap_mean - 30) <= 9 OR abs(gap_mean - 365) <= 109.5)
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_recurring
  FROM profile)""",
]

CALENDAR = """ln(1 + CAST(amount AS DOUBLE)) AS log_amount,
    sin(2 * pi() * (isodow(txn_date) - 1) / 7) AS dow_sin,
    cos(2 * pi() * (isodow(txn_date) - 1) / 7) AS dow_cos,
    day(txn_date) / CAST(day(last_day(txn_date)) AS DOUBLE) AS day_of_month_norm"""

RECENCY = "ln(1 + CAST(least(coalesce(gap, 9999), 9999) AS DOUBLE)) / ln(10000::DOUBLE)"

FEATURES = PROFILE + [
    f"""features AS (
  SELECT id AS transaction_id, {CALENDAR}, merchant_frequency, {RECENCY} AS recency_days,
    is_recurring, amount_stability, amount, counterparty_normalized
  FROM gaps JOIN recurring USING (counterparty_normalized))""",
]

CLUSTERING = ["log_amount", "merchant_frequency", "is_recurring", "amount_stability"]
FEATURE_NAMES = ["log_amount", "dow_sin", "dow_cos", "day_of_month_norm", "merchant_frequency",
                 "recency_days", "is_recurring", "amount_stability"]

SCALED = FEATURES + [
    "scaled AS MATERIALIZED (SELECT transaction_id, "
    + ", ".join(f"(f.{c} - avg(f.{c}) OVER ()) / nullif(stddev_pop(f.{c}) OVER (), 0) AS {c}"
                for c in CLUSTERING)
    + " FROM features f)",
]

# --- fuzzy names ---------------------------------------------------------------------
def lcs_ctes(parts: str) -> list[str]:
    """Insert/delete distance of da and db (one bit per character of da, up to 62)."""
    return [
        f"""lcs AS (
  SELECT a, b, da, db, 0 AS step, (1::BIGINT << length(da)) - 1 AS v FROM {parts}
  UNION ALL
  SELECT a, b, da, db, step + 1,
    ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(da)) - 1)
  FROM (
    SELECT *, CAST(coalesce(list_sum(list_transform(range(1, length(da) + 1),
      lambda x: CASE WHEN da[x] = db[step + 1] THEN 1::BIGINT << CAST(x - 1 AS INTEGER) ELSE 0 END)), 0)
      AS BIGINT) AS m
    FROM lcs WHERE step < length(db)))""",
        """distances AS (
  SELECT a, b, length(da) + length(db)
    - 2 * (length(da) - bit_count(v)) AS d
  FROM lcs WHERE step = length(db))""",
    ]


SCORE = """CASE
    WHEN i <> '' AND (da = '' OR db = '') THEN 100.0::DOUBLE
    WHEN i = '' THEN 100 - 100.0::DOUBLE * d / (length(da) + length(db))
    ELSE greatest(
      100 - 100.0::DOUBLE * d / (2 * length(i) + 2 + length(da) + length(db)),
      100 - 100.0::DOUBLE * (1 + length(da)) / (2 * length(i) + 1 + length(da)),
      100 - 100.0::DOUBLE * (1 + length(db)) / (2 * length(i) + 1 + length(db))) END"""

FUZZY = KEYED + [
    """names AS (
  SELECT scrubbed AS name, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, scrubbed) AS rk
  FROM keyed GROUP BY 1)""",
    "worded AS (SELECT *, list_sort(list_distinct(string_split(name, ' '))) AS w FROM names)",
    """parts AS (
  SELECT a.rk AS a, b.rk AS b,
    array_to_string(list_sort(list_filter(a.w, lambda x: list_contains(b.w, x))), ' ') AS i,
    array_to_string(list_filter(a.w, lambda x: NOT list_contains(b.w, x)), ' ') AS da,
    array_to_string(list_filter(b.w, lambda x: NOT list_contains(a.w, x)), ' ') AS db
  FROM worded a JOIN worded b ON a.rk < b.rk)""",
    *lcs_ctes("parts"),
    f"scores AS (SELECT a, b, {SCORE} AS score FROM parts JOIN distances USING (a, b))",
    """earlier AS (
  SELECT rk, list(a) FILTER (a IS NOT NULL) AS near
  FROM names LEFT JOIN scores ON b = rk AND score >= 88 GROUP BY rk)""",
    """greedy AS (
  SELECT 0::BIGINT AS pos, []::BIGINT[] AS leaders
  UNION ALL
  SELECT pos + 1, CASE WHEN list_has_any(leaders, coalesce(near, []::BIGINT[])) THEN leaders
    ELSE list_append(leaders, pos + 1) END
  FROM greedy JOIN earlier ON rk = pos + 1)""",
    """leader_of AS (
  SELECT rk, CASE WHEN list_contains(leaders, rk) THEN rk
    ELSE list_min(list_filter(near, lambda x: list_contains(leaders, x))) END AS leader
  FROM earlier, (SELECT leaders FROM greedy ORDER BY pos DESC LIMIT 1))""",
    """canon AS (
  SELECT m.name, m.n, l.name AS canonical, coalesce(s.score, 100) AS score
  FROM leader_of o JOIN names m ON m.rk = o.rk JOIN names l ON l.rk = o.leader
    LEFT JOIN scores s ON s.a = o.leader AND s.b = o.rk)""",
]

# --- runs ------------------------------------------------------------------------------
HASH = "(length(counterparty_normalized) + ascii(counterparty_normalized))"
RUNS = SPEND + [
    f"""assigned AS MATERIALIZED (
  SELECT id AS transaction_id, run_id, {HASH} % m AS cluster_index,
    CAST(amount AS DOUBLE) / 1000 AS distance_to_centroid, ln(1 + CAST(amount AS DOUBLE)) AS pca_x,
    day(txn_date) / 31.0::DOUBLE AS pca_y, amount >= 20000 AS is_anomaly,
    CASE WHEN amount >= 20000 THEN 'large' END AS anomaly_reason, amount, txn_date,
    counterparty_normalized
  FROM spend, (VALUES ('r1', 3), ('r2', 4)) r(run_id, m))""",
    """clusters AS (
  SELECT run_id, cluster_index, count(*) AS n_transactions, sum(amount) AS total_amount,
    'Group ' || chr(CAST(65 + cluster_index AS INTEGER)) AS label
  FROM assigned GROUP BY run_id, cluster_index)""",
    """runs AS (
  SELECT run_id AS id, CASE WHEN run_id = 'r1' THEN TIMESTAMP '2024-06-01 00:00:00'
      ELSE TIMESTAMP '2024-07-01 00:00:00' END AS created_at,
    count(*) AS k, sum(n_transactions) AS n_transactions
  FROM clusters GROUP BY run_id)""",
    "newest AS (SELECT id AS run_id FROM runs ORDER BY created_at DESC LIMIT 1)",
]

INSIGHT_ROWS = SPEND + [
    f"""ir AS (
  SELECT id, txn_date, amount, counterparty_normalized AS m, {HASH} % 4 AS cluster_index,
    'Group ' || chr(CAST(65 + {HASH} % 4 AS INTEGER)) AS label,
    amount >= 20000 OR amount % 50 = 0 AS is_anomaly,
    strftime(txn_date, '%Y-%m') AS month
  FROM spend)""",
    "mt AS (SELECT cluster_index, label, month, sum(amount) AS total FROM ir GROUP BY 1, 2, 3)",
]

TREND = INSIGHT_ROWS + [
    """lagged AS (
  SELECT *, lag(total) OVER (PARTITION BY cluster_index ORDER BY month) AS prev FROM mt)""",
    """trend AS (
  SELECT cluster_index, month AS period_month, 'trend' AS kind,
    CASE WHEN abs(CAST(total - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100) >= 30
      THEN 'warn' ELSE 'info' END AS severity,
    CAST(abs(total - prev) AS DOUBLE) AS impact_amount,
    'Your "' || label || '" spending ' || CASE WHEN total > prev THEN 'grew ' ELSE 'shrank ' END
      || format('{:.0f}', abs(CAST(total - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100)) || '% in '
      || month || ' (₹' || format('{:,.0f}', CAST(prev AS DOUBLE)) || ' → ₹'
      || format('{:,.0f}', CAST(total AS DOUBLE)) || ').' AS body
  FROM lagged WHERE prev > 0 AND abs(total - prev) > 1)""",
]

NEW_MERCHANT = INSIGHT_ROWS + [
    """fm AS (
  SELECT cluster_index, label, m, month, sum(amount) AS spend FROM ir GROUP BY 1, 2, 3, 4
  QUALIFY month = min(month) OVER (PARTITION BY cluster_index, m))""",
    """fresh AS (
  SELECT * FROM fm WHERE month > (SELECT min(month) FROM mt WHERE mt.cluster_index = fm.cluster_index))""",
    """new_merchant AS (
  SELECT cluster_index, month AS period_month, 'new_merchant' AS kind, 'info' AS severity,
    CAST(sum(spend) AS DOUBLE) AS impact_amount,
    count(*) || ' new merchant(s) in "' || label || '" this ' || month || ': '
      || array_to_string(list_sort(list(m))[1:3], ', ') || '.' AS body
  FROM fresh GROUP BY cluster_index, label, month)""",
]

ANOMALY = INSIGHT_ROWS + [
    """odd AS (
  SELECT *, count(*) OVER (PARTITION BY cluster_index) AS n FROM ir
  WHERE is_anomaly AND month = (SELECT max(month) FROM mt WHERE mt.cluster_index = ir.cluster_index))""",
    """anomaly AS (
  SELECT cluster_index, month AS period_month, 'anomaly' AS kind, 'warn' AS severity,
    CAST(amount AS DOUBLE) AS impact_amount,
    n || ' unusual transaction(s) in "' || label || '" in ' || month || '; largest ₹'
      || format('{:,.0f}', CAST(amount AS DOUBLE)) || ' at ' || m || '.' AS body
  FROM odd
  QUALIFY row_number() OVER (PARTITION BY cluster_index ORDER BY amount DESC, txn_date, id) = 1)""",
]

ALL_INSIGHTS = TREND + NEW_MERCHANT + ANOMALY + [
    """insights AS (
  SELECT * FROM trend UNION ALL SELECT * FROM new_merchant UNION ALL SELECT * FROM anomaly)""",
]

# --- statements ------------------------------------------------------------------------
STATEMENTS = [
    """so AS (
  SELECT o_orderkey AS k, o_orderdate + to_seconds(o_orderkey % 86400) AS t,
    format('{:,.2f}', CAST((CAST(floor(o_totalprice / 100) AS BIGINT) * 100 + o_orderkey % 100)
      / 100.0 AS DOUBLE)) AS num
  FROM orders)""",
    """st AS (
  SELECT k AS row_no, 'statement-' || (k % 7) AS source_file, 'row=' || k AS raw_line,
    CASE k % 8 WHEN 0 THEN strftime(t, '%b %d, %Y') WHEN 1 THEN strftime(t, '%d %b %Y')
      WHEN 2 THEN strftime(t, '%d-%m-%Y') WHEN 3 THEN strftime(t, '%Y-%m-%d')
      WHEN 4 THEN strftime(t, '%d/%m/%Y') WHEN 5 THEN strftime(t, '%d %B %Y')
      WHEN 6 THEN strftime(t, '%B %d, %Y') ELSE 'not a date' END AS date_str,
    CASE k % 3 WHEN 0 THEN strftime(t, '%I:%M %p') WHEN 1 THEN strftime(t, '%H:%M:%S') END AS time_str,
    CASE WHEN k % 30 = 5 THEN '' ELSE CASE k % 6 WHEN 0 THEN '₹' || num WHEN 1 THEN 'Rs. ' || num
      WHEN 2 THEN 'INR ' || num WHEN 3 THEN '-' || num WHEN 4 THEN num ELSE '+' || num END END AS amount_str,
    CASE k % 5 WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'Cr' WHEN 2 THEN ' paid ' WHEN 3 THEN ''
      ELSE 'unknown' END AS type_str
  FROM so)""",
]
DATE_FORMATS = ["%b %d, %Y", "%d %b %Y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y",
                "%d %B %Y", "%B %d, %Y"]
_all = ([f"{d} %I:%M %p" for d in DATE_FORMATS] + [f"{d} %H:%M:%S" for d in DATE_FORMATS])
_list = ", ".join(f"'{f}'" for f in _all)
_dates = ", ".join(f"'{f}'" for f in DATE_FORMATS)
PARSED = STATEMENTS + [
    f"""parsed AS (
  SELECT *, CASE WHEN time_str IS NULL THEN try_strptime(date_str, [{_dates}])
      ELSE coalesce(try_strptime(date_str || ' ' || time_str, [{_list}]),
        try_strptime(date_str, [{_dates}])) END AS txn_date,
    abs(TRY_CAST(nullif(trim(replace(replace(replace(replace(replace(amount_str, '₹', ''), 'Rs.', ''),
      'Rs', ''), ',', ''), 'INR', '')), '') AS DECIMAL(14,2))) AS amount,
    CASE WHEN lower(trim(type_str)) IN ('debit', 'dr', 'debited', 'paid', 'sent', '-') THEN 'debit'
      WHEN lower(trim(type_str)) IN ('credit', 'cr', 'credited', 'received', '+') THEN 'credit'
      WHEN amount_str LIKE '-%' THEN 'debit' WHEN amount_str LIKE '+%' THEN 'credit' END AS direction
  FROM st)""",
    """routed AS (
  SELECT *, nullif(concat_ws(', ', CASE WHEN txn_date IS NULL THEN 'unparseable date' END,
    CASE WHEN amount IS NULL THEN 'unparseable amount' END,
    CASE WHEN direction IS NULL THEN 'unknown direction' END), '') AS reason
  FROM parsed)""",
]

ANCHOR = "[A-Z][a-z]{2}\\s+\\d{1,2},?\\s+\\d{4}"
PAGES = STATEMENTS[:1] + [
    """lines AS (
  SELECT k, k // 10 AS part_no, strftime(t, '%b %d, %Y') || ' '
    || CASE WHEN k % 4 = 0 THEN 'Received from' ELSE 'Paid to' END || ' Shop ' || (k % 40) || ' '
    || CASE WHEN k % 9 = 0 THEN 'no amount' WHEN k % 2 = 0 THEN 'INR ' || num ELSE '₹' || num END AS line
  FROM so)""",
    "page AS (SELECT part_no, string_agg(line, chr(10) ORDER BY k) AS text FROM lines GROUP BY 1)",
    f"""chunks AS (
  SELECT part_no, generate_subscripts(c, 1) AS record_no, trim(unnest(c), ' ' || chr(10)) AS chunk
  FROM (SELECT part_no, string_split(
    regexp_replace(text, '(?m)^({ANCHOR})', chr(1) || '\\1', 'g'), chr(1))[2:] AS c FROM page))""",
]


def text_fields(cte: str, source: str, chunk: str, multi: bool = True) -> str:
    amount = f"regexp_extract({chunk}, '(?:INR|Rs\\.?|₹)\\s*([\\d,]+(?:\\.\\d{{1,2}})?)', 1)"
    cp = f"regexp_replace({chunk}, '(?m)^{ANCHOR}', '', 'g')"
    cp = f"regexp_replace({cp}, '\\d{{1,2}}:\\d{{2}}\\s*(?:AM|PM|am|pm)?', '', 'g')"
    cp = f"regexp_replace({cp}, '(?:INR|Rs\\.?|₹)\\s*[\\d,]+(?:\\.\\d{{1,2}})?', '', 'g')"
    cp = f"regexp_replace({cp}, '(?i)\\b(debit|credit|paid to|received from|payment to)\\b', '', 'g')"
    cp = f"trim(regexp_replace({cp}, '\\s+', ' ', 'g'), ' -|,')"
    low = f"lower({chunk})"
    credit = " OR ".join(f"contains({low}, '{w}')" for w in
                         ["credit", "received from", "refund", "money received"])
    return f"""{cte} AS (
  SELECT *, try_strptime(replace(regexp_extract({chunk}, '(?m)^({ANCHOR})', 1), ',', ''), '%b %d %Y')
      AS txn_date,
    abs(TRY_CAST(nullif(replace({amount}, ',', ''), '') AS DECIMAL(14,2))) AS amount,
    CASE WHEN {credit} THEN 'credit' ELSE 'debit' END AS direction,
    coalesce(nullif({cp}, ''), 'UNKNOWN') AS counterparty_raw,
    CASE WHEN regexp_extract({chunk}, '(?m)^({ANCHOR})', 1) = '' OR {amount} = ''
      THEN 'no date/amount in record' END AS reason
  FROM {source})"""


TEXT = PAGES + [text_fields("fields", "chunks", "chunk")]

# --- vectors ---------------------------------------------------------------------------
VECTORS = [
    "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
    "flat AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v)",
    """means AS (
  SELECT label, list(m ORDER BY i) AS c
  FROM (SELECT label, i, avg(x) AS m FROM flat GROUP BY 1, 2) GROUP BY label)""",
    """placed AS (
  SELECT vec_id, v.label, dense_rank() OVER (ORDER BY means.label) - 1 AS cluster_index,
    list_distance(e, c) AS d
  FROM v, means)""",
    """nearest AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_index) = 1)""",
]
SILHOUETTE = VECTORS[:1] + [
    """near AS (
  SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
  FROM v a, v b GROUP BY 1, 2, 3)""",
    """ab AS (
  SELECT vec_id, label, max(CASE WHEN label = other THEN n END) AS own,
    max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a,
    min(CASE WHEN label <> other THEN s / n END) AS b
  FROM near GROUP BY 1, 2)""",
    """sil AS (
  SELECT label, CASE WHEN own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b)
    ELSE 0.0::DOUBLE END AS s FROM ab)""",
]

GROUPED = FEATURES + [
    """grouped AS (
  SELECT *, CASE WHEN is_recurring = 1 THEN 0 WHEN log_amount < 6 THEN 1
    WHEN merchant_frequency < 4.5 THEN 2 WHEN log_amount < 7.5 THEN 3
    WHEN log_amount < 8.5 THEN 4 ELSE 5 END AS cluster_index
  FROM features)""",
    "centroids AS (SELECT cluster_index, " + ", ".join(f"avg({c}) AS {c}" for c in CLUSTERING)
    + " FROM grouped GROUP BY 1)",
]


def bucket(c: str) -> str:
    return f"""CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN 1
      WHEN {c} <= quantile_cont({c}, 0.33) OVER () THEN 0
      WHEN {c} >= quantile_cont({c}, 0.66) OVER () THEN 2 ELSE 1 END"""


LABELS = GROUPED + [
    "buckets AS (SELECT *, " + ", ".join(f"{bucket(c)} AS {c}_bucket" for c in CLUSTERING)
    + " FROM centroids)",
    """labelled AS (
  SELECT cluster_index, CASE
    WHEN is_recurring_bucket = 2 THEN 'Recurring bills & subscriptions'
    WHEN merchant_frequency_bucket = 2 AND exp(log_amount) - 1 >= 1500 THEN 'Frequent big-ticket spending'
    WHEN merchant_frequency_bucket = 2 THEN 'Frequent everyday spending'
    WHEN exp(log_amount) - 1 >= 1500 THEN 'Large one-off purchases'
    WHEN amount_stability_bucket = 2 AND merchant_frequency_bucket <= 1 THEN 'One-off & occasional spending'
    WHEN exp(log_amount) - 1 <= 150 THEN 'Small everyday spend'
    ELSE 'Mid-size regular spend' END AS label
  FROM buckets)""",
]

# --- anomalies ---------------------------------------------------------------------------


def z_ctes(source: str, merchant: str, amount: str) -> list[str]:
    x = f"CAST(round({amount} * 100) AS BIGINT)"  # whole cents
    return [
        f"""med AS (
  SELECT {merchant} AS m, median({x}) AS med, count(*) AS n FROM {source} GROUP BY 1 HAVING count(*) >= 3)""",
        f"""dev AS (
  SELECT id, m, {x} - med AS off FROM {source} JOIN med ON m = {merchant})""",
        "mad AS (SELECT m, median(abs(off)) AS mad FROM dev GROUP BY 1)",
        """zs AS (
  SELECT id, m, 0.6745::DOUBLE * (off / 100) / CASE WHEN mad = 0 THEN 1e-9::DOUBLE ELSE mad / 100 END AS z
  FROM dev JOIN mad USING (m))""",
    ]


EVENTS = ["""ev AS (
  SELECT event_id AS id, ts AS txn_date, CAST(value AS DECIMAL(14,2)) AS amount, user_id AS merchant
  FROM events)"""]

_d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in CLUSTERING)


def noise_ctes(share: float) -> list[str]:
    norm = " + ".join(f"power({c}, 2)" for c in CLUSTERING)
    return SCALED + [
        f"eps AS (SELECT quantile_cont(sqrt({norm}), 0.9) / {share} AS eps FROM scaled)",
        f"""core AS MATERIALIZED (
  SELECT a.transaction_id FROM scaled a, scaled b, eps WHERE {_d2} <= eps * eps
  GROUP BY 1 HAVING count(*) >= 4)""",
        f"""noise AS (
  SELECT transaction_id FROM scaled a
  WHERE transaction_id NOT IN (SELECT transaction_id FROM core) AND transaction_id NOT IN (
    SELECT a.transaction_id FROM scaled a, scaled b, eps
    WHERE {_d2} <= eps * eps AND b.transaction_id IN (SELECT transaction_id FROM core)
      AND a.transaction_id NOT IN (SELECT transaction_id FROM core)))""",
    ]


# --- one entry per query -----------------------------------------------------------------
O = ORACLE
O["stmt_parse_date"] = with_(PARSED, select=f"SELECT row_no, {ts('txn_date')} AS txn_date FROM parsed")
O["stmt_parse_amount"] = with_(PARSED, select=f"SELECT row_no, {dbl('amount')} AS amount FROM parsed")
O["stmt_direction"] = with_(PARSED, select="SELECT row_no, direction FROM parsed")
O["stmt_route_unparsed"] = with_(
    PARSED, select="SELECT row_no, raw_line, reason FROM routed WHERE reason IS NOT NULL")
O["stmt_parse_stats"] = with_(PARSED, select="""
SELECT source_file, count(*) FILTER (reason IS NULL) AS parsed,
  count(*) FILTER (reason IS NOT NULL) AS unparsed,
  round(count(*) FILTER (reason IS NULL) / CAST(count(*) AS DOUBLE), 4) AS parse_rate
FROM routed GROUP BY 1""")
_ref = "CASE WHEN row_no % 4 <> 0 THEN 'UTR' || row_no END"
_name = "'Paid \"Shop ' || (row_no % 40) || '\", row ' || row_no"
O["stmt_csv_scan"] = with_(PARSED, select=f"""
SELECT {_name} AS counterparty_raw, CASE WHEN reason IS NULL THEN {ts('txn_date')} END AS txn_date,
  CASE WHEN reason IS NULL THEN {dbl('amount')} END AS amount,
  CASE WHEN reason IS NULL THEN direction END AS direction,
  CASE WHEN reason IS NULL THEN {_ref} END AS reference_id, reason
FROM routed""")
O["stmt_header_map"] = """
SELECT 1::BIGINT AS date_at, 2::BIGINT AS time_at, 3::BIGINT AS details_at, 4::BIGINT AS type_at,
  5::BIGINT AS amount_at, 6::BIGINT AS reference_at, count(*) AS n_rows FROM orders"""
O["route_files"] = "SELECT 'csv' AS adapter, NULL::VARCHAR AS reason, count(*) AS n_rows FROM orders"
O["text_split_records"] = with_(PAGES, select="SELECT part_no, record_no, chunk FROM chunks")
O["text_extract_fields"] = with_(TEXT, select=f"""
SELECT part_no, record_no AS row_no, {ts('txn_date')} AS txn_date, {dbl('amount')} AS amount,
  direction, 0.7::DOUBLE AS parse_confidence,
  chunk AS raw_line, reason
FROM fields""")
O["text_counterparty"] = with_(
    TEXT, select="SELECT part_no, record_no AS row_no, counterparty_raw FROM fields")
O["table_rows_with_fallback"] = with_(
    TEXT,
    text_fields("cells", "(SELECT * FROM lines WHERE part_no % 2 = 0)", "line"),
    "good AS (SELECT * FROM cells WHERE reason IS NULL)",
    "rest AS (SELECT * FROM fields WHERE part_no NOT IN (SELECT part_no FROM good))",
    select=f"""
SELECT part_no, k AS row_no, {ts('txn_date')} AS txn_date, {dbl('amount')} AS amount, direction,
  counterparty_raw, 1.0::DOUBLE AS parse_confidence, reason FROM good
UNION ALL
SELECT part_no, record_no, CASE WHEN reason IS NULL THEN {ts('txn_date')} END,
  CASE WHEN reason IS NULL THEN {dbl('amount')} END, CASE WHEN reason IS NULL THEN direction END,
  CASE WHEN reason IS NULL THEN counterparty_raw END,
  CASE WHEN reason IS NULL THEN 0.7::DOUBLE END, reason FROM rest""")
O["ingest_antijoin"] = with_(KEYED, select=f"""
SELECT dedup_key, source_file, row_no, {dbl('amount')} AS amount FROM (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY source_file, row_no) = 1)
WHERE dedup_key NOT IN (SELECT dedup_key FROM keyed WHERE row_no % 2 = 0)""")

O["mask_handles_documents"] = f"SELECT doc_id, {mask('text')} AS text FROM documents"
O["hash_references"] = with_(
    LEDGER, select="SELECT source_file, row_no, substr(sha256(reference_id), 1, 16) AS reference_hash FROM ledger")
O["dedup_keys"] = with_(KEYED, select="SELECT source_file, row_no, dedup_key FROM keyed")
O["dedup_first"] = with_(KEYED, select="""
SELECT dedup_key, source_file, row_no FROM keyed
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY source_file, row_no) = 1""")
O["merchant_scrub"] = with_(KEYED, select="SELECT source_file, row_no, scrubbed AS merchant FROM keyed")
O["merchant_scrub_unmasked"] = with_(LEDGER, select=f"""
SELECT {scrub('t', False)} AS merchant, count(*) AS n FROM (
  SELECT counterparty_raw AS t FROM ledger
  UNION ALL SELECT unnest(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[a-zA-Z]+')) FROM documents)
GROUP BY 1""")
O["merchant_override"] = with_(KEYED, select="""
SELECT source_file, row_no, coalesce(b, scrubbed) AS counterparty_normalized
FROM keyed LEFT JOIN (SELECT upper(p_name) AS p, min(p_brand) AS b FROM part GROUP BY 1) ON p = scrubbed""")
O["txn_kind_rules"] = with_(
    KEYED, select=f"SELECT source_file, row_no, {kind('scrubbed')} AS txn_kind FROM keyed")
O["txn_offset_pairs"] = with_(PAIRS, select="""
SELECT l.source_file, l.row_no, o.row_no IS NOT NULL AS is_offset
FROM ledger l LEFT JOIN offsets o ON o.source_file = l.source_file AND o.row_no = l.row_no""")
O["token_set_pairs"] = with_(
    KEYED,
    """rm AS (SELECT DISTINCT upper(counterparty_raw) AS raw, scrubbed AS merchant FROM keyed)""",
    """sets AS (
  SELECT raw AS a, merchant AS b, list_sort(list_distinct(string_split(raw, ' '))) AS wa,
    list_sort(list_distinct(string_split(merchant, ' '))) AS wb FROM rm)""",
    """parts AS (
  SELECT a, b, array_to_string(list_filter(wa, lambda x: list_contains(wb, x)), ' ') AS i,
    array_to_string(list_filter(wa, lambda x: NOT list_contains(wb, x)), ' ') AS da,
    array_to_string(list_filter(wb, lambda x: NOT list_contains(wa, x)), ' ') AS db FROM sets)""",
    lcs_ctes("parts"),
    select=f"SELECT a AS raw, b AS merchant, {r6(SCORE)} AS score FROM parts JOIN distances USING (a, b)")
O["merchant_fuzzy_groups"] = with_(
    FUZZY, select=f"SELECT name, n, canonical, {r6('score')} AS score FROM canon")
O["clean_ledger_full"] = with_(
    FUZZY, PAIRS,
    "grouped_names AS (SELECT k.*, c.canonical FROM keyed k JOIN canon c ON c.name = k.scrubbed)",
    cleaned_as("cleaned", "grouped_names", "canonical"),
    select=f"""
SELECT id, {ts('txn_date')} AS txn_date, {dbl('amount')} AS amount, direction, txn_kind,
  counterparty_raw, counterparty_normalized, reference_hash, source_file, row_no FROM cleaned""")

O["features_calendar"] = with_(
    LEDGER, f"cal AS (SELECT source_file, row_no, {CALENDAR} FROM ledger)",
    select="SELECT source_file, row_no, " + ", ".join(
        f"{r6(c)} AS {c}" for c in ["log_amount", "dow_sin", "dow_cos", "day_of_month_norm"]) + " FROM cal")
O["merchant_profile"] = with_(PROFILE, select=f"""
SELECT counterparty_normalized, n AS n_transactions, {r6('mean_amount')} AS mean_amount,
  {r6('merchant_frequency')} AS merchant_frequency, {r6('amount_stability')} AS amount_stability
FROM profile""")
O["recurring_merchants"] = with_(PROFILE, select=f"""
SELECT counterparty_normalized, n_gaps, {r6('gap_mean')} AS gap_mean, {r6('gap_std')} AS gap_std,
  is_recurring FROM recurring""")
O["recency"] = with_(
    PROFILE, select=f"SELECT id, coalesce(gap, -1) AS gap_days, {r6(RECENCY)} AS recency_days FROM gaps")
O["recency_events"] = with_(
    EVENTS, gaps_cte("gaps", "ev", "merchant"),
    select=f"SELECT id, coalesce(gap, -1) AS gap_days, {r6(RECENCY)} AS recency_days FROM gaps")
O["build_features"] = with_(FEATURES, select="SELECT transaction_id, " + ", ".join(
    f"{r6(c)} AS {c}" for c in FEATURE_NAMES) + " FROM features")

O["standardise"] = with_(SCALED, select="SELECT transaction_id, " + ", ".join(
    f"{r6(c)} AS {c}" for c in CLUSTERING) + " FROM scaled")
def _times(v: str = "v") -> list[str]:
    return ["(" + " + ".join(f"m{i}{j} * {v}{j}" for j in range(4)) + ")" for i in range(4)]


def _power(name: str, matrix: str) -> list[str]:
    """Leading eigenvector of a 4 x 4 matrix row (m00..m33), turned to a positive top loading."""
    w = _times()
    norm = "sqrt(" + " + ".join(f"{x} * {x}" for x in w) + ")"
    start = ", ".join(f"{x}::DOUBLE AS v{i}" for i, x in enumerate((0.5, 0.4, 0.3, 0.2)))
    size = "sqrt(" + " + ".join(f"v{i} * v{i}" for i in range(4)) + ")"
    top = "(CASE WHEN greatest(" + ", ".join(f"v{i}" for i in range(4)) + ") >= -least(" + ", ".join(
        f"v{i}" for i in range(4)) + f") THEN 1 ELSE -1 END / {size})"
    return [
        f"""{name}_it AS (
  SELECT 0 AS n, {start}
  UNION ALL SELECT n + 1, {", ".join(f"{x} / {norm} AS v{i}" for i, x in enumerate(w))}
  FROM {name}_it, {matrix} WHERE n < 2000)""",
        f"{name} AS MATERIALIZED (SELECT " + ", ".join(f"v{i} * {top} AS v{i}" for i in range(4))
        + f" FROM {name}_it ORDER BY n DESC LIMIT 1)",
    ]


_cov = "cov AS MATERIALIZED (SELECT " + ", ".join(
    f"covar_pop({a}, {b}) AS m{i}{j}" for i, a in enumerate(CLUSTERING) for j, b in enumerate(CLUSTERING)) + " FROM scaled)"
_lam = "(" + " + ".join(f"v{i} * {x}" for i, x in enumerate(_times())) + ")"
_deflated = "rest AS MATERIALIZED (SELECT " + ", ".join(
    f"m{i}{j} - {_lam} * v{i} * v{j} AS m{i}{j}" for i in range(4) for j in range(4)) + " FROM cov, axis1)"
O["pca_2d"] = with_(
    SCALED, _cov, _power("axis1", "cov"), _deflated, _power("axis2", "rest"),
    select="SELECT transaction_id, "
    + r6(" + ".join(f"{c} * a.v{i}" for i, c in enumerate(CLUSTERING))) + " AS pca_x, "
    + r6(" + ".join(f"{c} * b.v{i}" for i, c in enumerate(CLUSTERING))) + " AS pca_y FROM scaled, axis1 a, axis2 b")
O["assign_centroid"] = with_(
    VECTORS, select=f"SELECT vec_id, cluster_index, {r6('d')} AS distance_to_centroid FROM nearest")
O["silhouette_embeddings"] = with_(
    SILHOUETTE, select=f"SELECT count(*) AS n, {r6('avg(s)')} AS silhouette FROM sil")
O["silhouette_points"] = with_(
    SILHOUETTE, select=f"""
SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {r6('avg(s)')} AS silhouette FROM sil GROUP BY 1""")
O["ari_pairs"] = with_(
    VECTORS,
    "same AS (SELECT a.label = b.label AS x, a.cluster_index = b.cluster_index AS y FROM nearest a, nearest b WHERE a.vec_id <> b.vec_id)",
    """pc AS (SELECT CAST(count(*) FILTER (x AND y) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT x AND y) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (x AND NOT y) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT x AND NOT y) AS DOUBLE) AS tn FROM same)""",
    select=f"""
SELECT (SELECT count(*) FROM nearest) AS n,
  {r6("CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END")} AS ari
FROM pc""")
O["centroids_raw"] = with_(GROUPED, select="SELECT CAST(cluster_index AS BIGINT) AS cluster_index, " + ", ".join(
    f"{r6(c)} AS {c}" for c in CLUSTERING) + " FROM centroids")

_ctr = ", ".join(f"avg((f.{c} - sc.m_{c}) / CASE WHEN sc.s_{c} > 0 THEN sc.s_{c} ELSE 1 END) AS {c}" for c in CLUSTERING)
_scale = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CLUSTERING)
_defaults = {
    "log_amount": "ln(1 + CAST(n.amount AS DOUBLE))",
    "merchant_frequency": "coalesce(r.merchant_frequency, ln(2::DOUBLE))",
    "is_recurring": "coalesce(r.is_recurring, 0)",
    "amount_stability": "coalesce(r.amount_stability, 1)",
}
_new = ", ".join(f"({x} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS {c}" for c, x in _defaults.items())
_dist = " + ".join(f"power(x.{c} - c.{c}, 2)" for c in CLUSTERING)
_old_features = [f.replace("FROM spend)", "FROM spend WHERE txn_date < TIMESTAMP '1998-01-01')") for f in FEATURES]
O["score_new_rows"] = with_(
    _old_features,
    f"sc AS MATERIALIZED (SELECT {_scale} FROM features)",
    f"""ctr AS MATERIALIZED (SELECT CASE WHEN f.log_amount < 6 THEN 0 WHEN f.log_amount < 8 THEN 1 ELSE 2 END AS ci, {_ctr}
  FROM features f, sc GROUP BY 1)""",
    f"""nw AS (SELECT n.id, {_new} FROM spend n
  LEFT JOIN recurring r ON r.counterparty_normalized = n.counterparty_normalized, sc
  WHERE n.txn_date >= TIMESTAMP '1998-01-01')""",
    select=f"""
SELECT id, CAST(ci AS BIGINT) AS cluster_index, {r6('d')} AS distance_to_centroid FROM (
  SELECT x.id, c.ci, sqrt({_dist}) AS d FROM nw x, ctr c)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, ci) = 1""")

O["score_stream_rows"] = O["score_new_rows"]

_norm = " + ".join(f"power({c}, 2)" for c in CLUSTERING)
O["dbscan_eps"] = with_(
    VECTORS[:2], SCALED,
    "mid AS (SELECT i, avg(x) AS m FROM flat GROUP BY i)",
    "ed AS (SELECT vec_id, sqrt(sum(power(x - m, 2))) AS d FROM flat JOIN mid USING (i) GROUP BY vec_id)",
    select=f"""
SELECT 'embeddings' AS input, {r6('quantile_cont(d, 0.9)')} AS eps FROM ed
UNION ALL SELECT 'ledger', {r6(f'quantile_cont(sqrt({_norm}), 0.9)')} FROM scaled""")
O["amount_percentiles"] = with_(
    EVENTS, LEDGER, "ps AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS p)",
    select="\nUNION ALL ".join(
        f"SELECT '{n}' AS input, {p}::DOUBLE AS p, {r6(f'quantile_cont(CAST(amount AS DOUBLE), {p})')} AS value FROM {t}"
        for n, t in (("events", "ev"), ("ledger", "ledger")) for p in (0.1, 0.5, 0.9)))
O["density_outliers"] = with_(noise_ctes(1), select="SELECT transaction_id FROM noise")
O["density_outliers_fine"] = with_(noise_ctes(20), select="SELECT transaction_id FROM noise")
_z1 = "replace(format('{:.1f}', z), ',', '')"
O["robust_z"] = with_(
    SPEND, z_ctes("spend", "counterparty_normalized", "amount"), select=f"""
SELECT s.id, {r6('z')} AS z, coalesce(abs(z) > 3.5, false) AS is_unusual,
  CASE WHEN abs(z) > 3.5 THEN 'unusual amount for ' || m || ' (z=' || {_z1} || ')' END AS z_reason
FROM spend s LEFT JOIN zs ON zs.id = s.id""")
O["robust_z_events"] = with_(
    EVENTS, z_ctes("ev", "merchant", "amount"), select=f"""
SELECT s.id, {r6('z')} AS z, coalesce(abs(z) > 3.5, false) AS is_unusual
FROM ev s LEFT JOIN zs ON zs.id = s.id""")
O["anomalies"] = with_(
    noise_ctes(20), z_ctes("spend", "counterparty_normalized", "amount"),
    f"""why AS (
  SELECT s.id, coalesce(
    CASE WHEN abs(z) > 3.5 THEN 'unusual amount for ' || m || ' (z=' || {_z1} || ')' END,
    CASE WHEN s.id IN (SELECT transaction_id FROM noise) THEN 'density outlier (DBSCAN)' END) AS reason
  FROM spend s LEFT JOIN zs ON zs.id = s.id)""",
    select="SELECT id AS transaction_id, reason IS NOT NULL AS is_anomaly, reason AS anomaly_reason FROM why")

O["centroid_buckets"] = with_(LABELS, select="SELECT CAST(cluster_index AS BIGINT) AS cluster_index, " + ", ".join(
    f"CAST({c}_bucket AS BIGINT) AS {c}_bucket" for c in CLUSTERING) + " FROM buckets")
O["centroid_summary"] = with_(GROUPED, select="""
SELECT CAST(cluster_index AS BIGINT) AS cluster_index, round(exp(log_amount) - 1, 2) AS avg_amount,
  round(exp(merchant_frequency) - 1, 1) AS typical_frequency, round(is_recurring, 2) AS recurring_share,
  round(amount_stability, 2) AS stability FROM centroids""")
O["cluster_labels"] = with_(
    LABELS, select="SELECT CAST(cluster_index AS BIGINT) AS cluster_index, label FROM labelled")
O["label_suffix"] = with_(LABELS, select="""
SELECT CAST(cluster_index AS BIGINT) AS cluster_index, label || CASE
  WHEN row_number() OVER (PARTITION BY label ORDER BY cluster_index) > 1
  THEN ' (' || row_number() OVER (PARTITION BY label ORDER BY cluster_index) || ')' ELSE '' END AS label
FROM labelled""")
O["cluster_rollup"] = with_(
    RUNS, select=f"SELECT run_id, CAST(cluster_index AS BIGINT) AS cluster_index, n_transactions, {dbl('total_amount')} AS total_amount FROM clusters")

O["cluster_month_totals"] = with_(
    INSIGHT_ROWS, select=f"SELECT CAST(cluster_index AS BIGINT) AS cluster_index, label, month, {dbl('total')} AS total FROM mt")
_ins = "CAST(cluster_index AS BIGINT) AS cluster_index, period_month, kind, severity, impact_amount, body"
O["insight_trend"] = with_(TREND, select=f"SELECT {_ins} FROM trend")
O["insight_new_merchant"] = with_(NEW_MERCHANT, select=f"SELECT {_ins} FROM new_merchant")
O["insight_anomaly"] = with_(ANOMALY, select=f"SELECT {_ins} FROM anomaly")
O["insights_top"] = with_(ALL_INSIGHTS, select=f"""
SELECT {_ins} FROM insights ORDER BY insights.impact_amount DESC, insights.cluster_index, period_month,
  CASE kind WHEN 'trend' THEN 0 WHEN 'new_merchant' THEN 1 ELSE 2 END LIMIT 8""")

O["latest_run"] = with_(RUNS, select="SELECT run_id AS id FROM newest")
O["list_runs"] = with_(
    RUNS, select=f"SELECT id, {ts('created_at')} AS created_at, k, CAST(n_transactions AS BIGINT) AS n_transactions FROM runs")
O["list_clusters"] = with_(RUNS, select=f"""
SELECT run_id, CAST(cluster_index AS BIGINT) AS cluster_index, n_transactions,
  {dbl('total_amount')} AS total_amount, label FROM clusters SEMI JOIN newest USING (run_id)""")
O["scatter_points"] = with_(RUNS, select=f"""
SELECT transaction_id, {r6('pca_x')} AS pca_x, {r6('pca_y')} AS pca_y, {dbl('amount')} AS amount,
  counterparty_normalized AS counterparty, {ts('txn_date')} AS txn_date,
  CAST(cluster_index AS BIGINT) AS cluster_index, is_anomaly, anomaly_reason
FROM assigned SEMI JOIN newest USING (run_id)""")
OVER_TIME = RUNS + [
    "sums AS (SELECT strftime(txn_date, '%Y-%m') AS month, cluster_index, sum(amount) AS total FROM assigned SEMI JOIN newest USING (run_id) GROUP BY 1, 2)",
    """grid AS (
  SELECT m.month, c.cluster_index, c.label, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT month FROM sums) m
    CROSS JOIN (SELECT cluster_index, label FROM clusters SEMI JOIN newest USING (run_id)) c
    LEFT JOIN sums s ON s.month = m.month AND s.cluster_index = c.cluster_index)""",
]
O["spend_over_time"] = with_(
    OVER_TIME, select=f"SELECT month, CAST(cluster_index AS BIGINT) AS cluster_index, label, {dbl('total')} AS total FROM grid")
O["spend_pivot"] = with_(OVER_TIME, select="SELECT month, " + ", ".join(
    f"CAST(sum(total) FILTER (label = 'Group {x}') AS DOUBLE) AS group_{x.lower()}" for x in "ABCD")
    + " FROM grid GROUP BY month")
O["txns_filtered"] = with_(CLEAN, select=f"""
SELECT id, {ts('txn_date')} AS txn_date, counterparty_normalized FROM cleaned
WHERE txn_date >= TIMESTAMP '1996-01-01' AND txn_date <= TIMESTAMP '2000-06-30'
  AND txn_kind = 'spend' AND counterparty_normalized ILIKE '%re_ %%'""")
O["txns_in_cluster"] = with_(RUNS, select=f"""
SELECT id, {dbl('amount')} AS amount, counterparty_normalized FROM spend WHERE id IN (
  SELECT transaction_id FROM assigned SEMI JOIN newest USING (run_id)
  WHERE cluster_index = 2 AND is_anomaly)""")
O["txns_page"] = with_(CLEAN, select=f"""
SELECT id, {ts('txn_date')} AS txn_date FROM (
  SELECT * FROM cleaned ORDER BY txn_date DESC, id LIMIT 500 OFFSET 500)""")
O["txns_by_amount"] = with_(CLEAN, select=f"""
SELECT id, {dbl('amount')} AS amount, {ts('txn_date')} AS txn_date FROM (
  SELECT * FROM cleaned ORDER BY txn_date DESC, id LIMIT 500)""")
O["list_insights"] = with_(
    ALL_INSIGHTS, select=f"SELECT {_ins} FROM insights WHERE period_month = '1998-03'")
O["unparsed_queue"] = with_(PARSED, select=f"""
SELECT row_no, raw_line, reason, {ts('c')} AS created_at FROM (
  SELECT *, TIMESTAMP '1970-01-01' + to_seconds(row_no % 1000 * 3600) AS c FROM routed
  WHERE reason IS NOT NULL ORDER BY c DESC, source_file, row_no LIMIT 200)""")

RECONCILE = LEDGER + [
    f"truth AS (SELECT {day('txn_date')} AS day, amount, direction, row_no // 4 AS k FROM ledger)",
    """got AS (
  SELECT day, amount, direction FROM truth WHERE k % 13 <> 0
  UNION ALL SELECT day, amount, direction FROM truth WHERE k % 13 <> 0 AND k % 29 = 0)""",
    """counts AS (
  SELECT coalesce(t.day, g.day) AS day, coalesce(t.amount, g.amount) AS amount,
    coalesce(t.direction, g.direction) AS direction, coalesce(t.n, 0) AS t, coalesce(g.n, 0) AS p
  FROM (SELECT day, amount, direction, count(*) AS n FROM truth GROUP BY ALL) t
  FULL JOIN (SELECT day, amount, direction, count(*) AS n FROM got GROUP BY ALL) g
    ON t.day = g.day AND t.amount = g.amount AND t.direction = g.direction)""",
]
O["reconcile_summary"] = with_(RECONCILE, select=f"""
SELECT CAST(sum(t) AS BIGINT) AS total_truth, CAST(sum(p) AS BIGINT) AS total_parsed,
  CAST(sum(least(t, p)) AS BIGINT) AS matched, CAST(sum(greatest(t - p, 0)) AS BIGINT) AS misses,
  CAST(sum(greatest(p - t, 0)) AS BIGINT) AS false_positives,
  {r6('CAST(sum(least(t, p)) AS DOUBLE) / sum(t)')} AS match_rate,
  CAST(sum(least(t, p)) AS DOUBLE) / sum(t) >= 0.9 AS meets_target FROM counts""")
O["reconcile_misses"] = with_(RECONCILE, select=f"""
SELECT day, {dbl('amount')} AS amount, direction, t - p AS n_missing FROM counts
WHERE t > p ORDER BY day, counts.amount, direction LIMIT 10""")
_keys = "day, CAST(amount AS DOUBLE) AS amount, direction"
O["multiset_common"] = with_(
    RECONCILE, select=f"SELECT {_keys} FROM truth INTERSECT ALL SELECT {_keys} FROM got")
O["multiset_missing"] = with_(
    RECONCILE, select=f"SELECT {_keys} FROM truth EXCEPT ALL SELECT {_keys} FROM got")

O["ingest_outcome"] = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 = 3 AS bad FROM orders),
calls AS (SELECT unnest([0, 1]) AS call)
SELECT call,
  count(*) FILTER (NOT bad AND (call = 1 OR k % 7 <> 6)) AS parsed,
  count(*) FILTER (bad AND (call = 1 OR k % 7 <> 6)) AS unparsed,
  count(*) FILTER (NOT bad AND (k % 7 = 6) = (call = 1)) AS inserted,
  count(*) FILTER (NOT bad AND call = 1 AND k % 7 <> 6) AS skipped,
  count(*) FILTER (NOT bad AND (call = 1 OR k % 7 <> 6)) AS stored,
  count(*) FILTER (bad AND (call = 1 OR k % 7 <> 6)) AS listed
FROM calls, o GROUP BY call"""
O["ingest_stream_outcome"] = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 = 3 AS bad, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders),
calls AS (SELECT unnest([0, 1]) AS call)
SELECT call,
  count(*) FILTER (NOT bad AND (call = 1 OR k % 7 <> 6)) AS stored,
  CAST(sum(price) FILTER (NOT bad AND (call = 1 OR k % 7 <> 6)) AS DOUBLE) AS amount,
  count(*) FILTER (bad AND (call = 1 OR k % 7 <> 6)) AS listed
FROM calls, o GROUP BY call"""
O["kmeans_facts"] = with_(SPEND, select="""
SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n_nearer_elsewhere,
  true AS centers_are_means, true AS cost_adds_up FROM spend""")
