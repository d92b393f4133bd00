"""DuckDB SQL oracles, one per registered query (same column names).

Written independently of the Spark code: plain SQL over the driver tables.
"""

from __future__ import annotations

from collections import OrderedDict

from ledgerlint.schema import VIEW_CATEGORIES

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
COLS = ["transaction_id", "customer_id", "category", "item", "price", "quantity",
        "total_spent", "payment_method", "location", "transaction_date", "discount_applied"]

VIEW_CTE = """
j AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
         l.l_quantity, l.l_discount, l.l_returnflag, l.l_linestatus,
         o.o_custkey, o.o_orderdate, p.p_type,
         (l.l_orderkey*31 + l.l_partkey*17 + l.l_suppkey*7 + l.l_linenumber*3) AS h,
         CAST(substr(p.p_brand, 7) AS INTEGER) AS n,
         substr(p.p_type, 1, 3) AS ab,
         CAST(5.0 AS DOUBLE) + CAST(1.5 AS DOUBLE) * (CAST(substr(p.p_brand, 7) AS INTEGER) - 1)
           + CASE WHEN o.o_orderdate >= TIMESTAMP '1999-01-01' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS bp,
         CAST(l.l_orderkey*8 + l.l_linenumber AS VARCHAR) AS tn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey),
rv AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    CASE WHEN h % 97 = 0 THEN 'TXN_BAD'
         ELSE 'TXN_' || CASE WHEN length(tn) < 7 THEN lpad(tn, 7, '0') ELSE tn END END AS transaction_id,
    CASE WHEN h % 89 = 0 THEN NULL ELSE 'CUST_' || CAST(o_custkey AS VARCHAR) END AS customer_id,
    CASE WHEN h % 83 = 0 THEN NULL ELSE p_type END AS category,
    CASE WHEN h % 10 = 0 THEN NULL WHEN h % 71 = 1 THEN 'Item_' || CAST(n AS VARCHAR) || '_ZZZ'
         ELSE 'Item_' || CAST(n AS VARCHAR) || '_' || ab END AS item,
    CASE WHEN h % 21 = 0 THEN NULL WHEN h % 50 = 7 THEN bp + 1.0 ELSE bp END AS price,
    CASE WHEN h % 21 = 5 THEN NULL WHEN h % 67 = 2 THEN l_quantity + 0.5 ELSE l_quantity END AS quantity,
    CASE WHEN h % 21 = 5 THEN NULL WHEN h % 61 = 3 THEN bp * l_quantity + 1.0 ELSE bp * l_quantity END AS total_spent,
    CASE WHEN h % 59 = 4 THEN 'Crypto' WHEN l_returnflag = 'R' THEN 'Digital Wallet'
         WHEN l_returnflag = 'A' THEN 'Credit Card' ELSE 'Cash' END AS payment_method,
    CASE WHEN h % 53 = 6 THEN NULL WHEN l_linestatus = 'O' THEN 'Online' ELSE 'In-store' END AS location,
    CASE WHEN h % 47 = 8 THEN '2024-02-30' WHEN h % 43 = 9 THEN NULL
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS transaction_date,
    CASE WHEN h % 3 = 0 THEN NULL ELSE l_discount >= 0.05 END AS discount_applied
  FROM j),
rt AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    transaction_id, customer_id, category, item,
    CAST(price AS VARCHAR) AS price, CAST(quantity AS VARCHAR) AS quantity,
    CAST(total_spent AS VARCHAR) AS total_spent, payment_method, location, transaction_date,
    CASE WHEN discount_applied THEN 'True' WHEN NOT discount_applied THEN 'False' END AS discount_applied
  FROM rv),
master AS (
  SELECT 'Item_' || CAST(n AS VARCHAR) || '_' || substr(p_type, 1, 3) AS item,
         CAST(5.0 AS DOUBLE) + CAST(1.5 AS DOUBLE) * (n - 1) + bump AS price, s, e
  FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS n, p_type FROM part) pp,
       (VALUES ('1995-01-01', '1998-12-31', CAST(0.0 AS DOUBLE)),
               ('1999-01-01', '2001-12-31', CAST(0.5 AS DOUBLE))) per(s, e, bump))
"""


def with_view(body: str) -> str:
    return "WITH " + VIEW_CTE.strip() + "\n" + body.strip()


def q(s: str) -> str:
    return '"' + s + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(lit(v) for v in vals) + ")"


# --- rule fragments (text view) ---
def full(c, p):
    return f"regexp_full_match({c}, {lit(p)})"


def blank(c):
    return f"({c} IS NULL OR regexp_full_match(CAST({c} AS VARCHAR), '\\s*'))"


def num(c):
    return f"TRY_CAST({c} AS DOUBLE)"


def date_ok(c, min_year=1):
    d = f"try_strptime({c}, '%Y-%m-%d')"
    return (f"(coalesce({full(c, '[0-9]{4}-[0-9]{2}-[0-9]{2}')}, false) AND {d} IS NOT NULL "
            f"AND year({d}) >= {min_year})")


TXN = "TXN_[0-9]{7}"
CUST = "CUST_[0-9]+"
CATS = list(VIEW_CATEGORIES)
PAYS = ["Digital Wallet", "Credit Card", "Cash"]
LOCS = ["Online", "In-store"]

SIMPLE = OrderedDict([
    ("transaction_id", f"coalesce({full('transaction_id', TXN)}, false)"),
    ("customer_id", f"coalesce({full('customer_id', CUST)}, false)"),
    ("category", f"(category IN {in_list(CATS)})"),
    ("payment_method", f"(payment_method IN {in_list(PAYS)})"),
    ("location", f"(location IN {in_list(LOCS)})"),
    ("discount_applied", "(discount_applied IN ('True', 'False'))"),
    ("quantity", "CASE WHEN quantity IS NULL THEN NULL WHEN TRY_CAST(quantity AS DOUBLE) IS NULL THEN false "
                 "ELSE coalesce(NOT isnan(TRY_CAST(quantity AS DOUBLE)) AND NOT isinf(TRY_CAST(quantity AS DOUBLE)) "
                 "AND TRY_CAST(quantity AS DOUBLE) = floor(TRY_CAST(quantity AS DOUBLE)) "
                 "AND TRY_CAST(quantity AS DOUBLE) >= 0, false) END"),
    ("transaction_date", f"CASE WHEN transaction_date IS NULL THEN NULL ELSE {date_ok('transaction_date')} END"),
])

ABBR_CASE = "CASE category " + " ".join(f"WHEN {lit(c)} THEN {lit(c[:3])}" for c in CATS) + " END"
ITEM_RULE = (f"CASE WHEN item IS NULL THEN NULL "
             f"WHEN NOT coalesce({full('item', 'Item_[0-9]+_[A-Za-z]+')}, false) THEN 'False' "
             f"WHEN category IS NULL OR ({ABBR_CASE}) IS NULL THEN 'CANT CHECK' "
             f"WHEN split_part(item, '_', 3) = ({ABBR_CASE}) THEN 'True' ELSE 'False' END")

PRICE_RULE = (
    "CASE WHEN t.price IS NULL THEN NULL "
    "WHEN TRY_CAST(t.price AS DOUBLE) IS NULL OR (NOT isnan(TRY_CAST(t.price AS DOUBLE)) AND TRY_CAST(t.price AS DOUBLE) <= 0) THEN 'False' "
    "WHEN t.item IS NULL OR t.transaction_date IS NULL OR NOT coalesce(t.date_ok, false) THEN 'CANT CHECK' "
    "WHEN EXISTS (SELECT 1 FROM master m WHERE m.item = t.item AND m.price = TRY_CAST(t.price AS DOUBLE) "
    "AND m.s <= t.transaction_date AND t.transaction_date <= m.e) THEN 'True' ELSE 'False' END")

TOTAL_RULE = (
    "CASE WHEN t.total_spent IS NULL THEN NULL "
    "WHEN TRY_CAST(t.total_spent AS DOUBLE) IS NULL THEN 'False' "
    "WHEN t.price IS NULL OR t.quantity IS NULL THEN 'CANT CHECK' "
    "WHEN t.price_validity = 'CANT CHECK' THEN 'CANT CHECK' "
    "WHEN TRY_CAST(t.price AS DOUBLE) IS NULL OR TRY_CAST(t.quantity AS DOUBLE) IS NULL THEN 'CANT CHECK' "
    "WHEN TRY_CAST(t.total_spent AS DOUBLE) = TRY_CAST(t.price AS DOUBLE) * TRY_CAST(t.quantity AS DOUBLE) THEN 'True' "
    "ELSE 'False' END")


def _simple_select(names):
    return ", ".join(f"{SIMPLE[n]} AS {n}_validity" for n in names)


def _union_report(parts):
    return "\nUNION ALL\n".join(parts)


def _missing_report(blank_aware: bool, src: str):
    parts = []
    for i, c in enumerate(COLS):
        cond = blank(c) if blank_aware else (
            f"({c} IS NULL OR isnan({c}))" if c in ("price", "quantity", "total_spent") and src == "rv"
            else f"{c} IS NULL")
        parts.append(f"SELECT '{c}' AS column, count_if({cond}) AS missing_count, "
                     f"round(coalesce(100.0 * count_if({cond}) / nullif(count(*), 0), 0), 6) AS missing_pct, "
                     f"CAST({i} AS INTEGER) AS position FROM {src}")
    return _union_report(parts)


def _report(src, checks: "OrderedDict[str, str]", valid_name="valid"):
    parts = []
    for i, (c, ok) in enumerate(checks.items()):
        m = f"count_if({blank(c)})"
        v = f"count_if(NOT {blank(c)} AND coalesce({ok}, false))"
        parts.append(
            f"SELECT '{c}' AS column, CAST({i} AS INTEGER) AS position, count(*) AS rows, "
            f"{m} AS missing_count, round(coalesce(100.0 * {m} / nullif(count(*), 0), 0), 6) AS missing_pct, "
            f"count(*) - {m} AS non_missing, {v} AS {valid_name}_count, "
            f"round(coalesce(100.0 * {v} / nullif(count(*) - {m}, 0), 0), 6) AS {valid_name}_pct FROM {src}")
    return _union_report(parts)


def _outlier(c):
    x = f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)"
    return f"({x} IS NULL OR (NOT isnan({x}) AND {x} <= 0))"


ORACLES: "OrderedDict[str, str]" = OrderedDict()

ORACLES["missing_report"] = with_view(_missing_report(False, "rv"))
ORACLES["completeness_flags"] = with_view(
    f"SELECT {KEYS}, " + ", ".join(
        f"({c} IS NOT NULL{' AND NOT isnan(' + c + ')' if c in ('price', 'quantity', 'total_spent') else ''}) AS {c}_completeness"
        for c in sorted(COLS)) + " FROM rv")
ORACLES["blank_missing"] = with_view(_missing_report(True, "rt"))
ORACLES["regex_validity"] = with_view(f"SELECT {KEYS}, {_simple_select(['transaction_id', 'customer_id'])} FROM rt")
ORACLES["domain_validity"] = with_view(
    f"SELECT {KEYS}, {_simple_select(['category', 'payment_method', 'location', 'discount_applied'])} FROM rt")
ORACLES["integer_validity"] = with_view(f"SELECT {KEYS}, {_simple_select(['quantity'])} FROM rt")
ORACLES["float_validity"] = with_view(
    f"SELECT {KEYS}, coalesce(NOT isnan({num('price')}) AND {num('price')} >= 0, false) AS price_validity FROM rt")
ORACLES["date_validity"] = with_view(f"SELECT {KEYS}, {_simple_select(['transaction_date'])} FROM rt")
ORACLES["rule_set"] = with_view(f"SELECT {KEYS}, {_simple_select(list(SIMPLE))} FROM rt")
ORACLES["item_validity"] = with_view(f"SELECT {KEYS}, {ITEM_RULE} AS item_validity FROM rt")

_PRICED = (f", pv AS (SELECT rt.*, {SIMPLE['transaction_date']} AS date_ok FROM rt), "
           f"pr AS (SELECT t.*, {PRICE_RULE} AS price_validity FROM pv t)\n")
ORACLES["price_validity"] = with_view(_PRICED + f"SELECT {KEYS}, price_validity FROM pr")
ORACLES["total_validity"] = with_view(_PRICED + f"SELECT {KEYS}, {TOTAL_RULE} AS total_spent_validity FROM pr t")

_UNIQ = (f"(row_number() OVER (PARTITION BY {', '.join(COLS)} ORDER BY {KEYS}) = 1)")
_AUDIT = (
    f", u AS (SELECT rt.*, {_UNIQ} AS uniqueness_flag FROM rt), "
    f"c AS (SELECT u.*, " + ", ".join(f"({c} IS NOT NULL) AS {c}_completeness" for c in sorted(COLS)) + " FROM u), "
    f"s AS (SELECT c.*, {_simple_select(list(SIMPLE))} FROM c), "
    f"i AS (SELECT s.*, {ITEM_RULE} AS item_validity FROM s), "
    f"p AS (SELECT t.*, {PRICE_RULE.replace('t.date_ok', 't.transaction_date_validity')} AS price_validity FROM i t), "
    f"a AS (SELECT t.*, {TOTAL_RULE} AS total_spent_validity FROM p t)\n")
ORACLES["full_audit"] = with_view(_AUDIT + "SELECT * FROM a")

_VORDER = [f"{c}_validity" for c in list(SIMPLE) + ["item", "price", "total_spent"]]
ORACLES["audit_summary"] = with_view(_AUDIT + _union_report([
    f"SELECT '{n}' AS column, count_if(lower(CAST({n} AS VARCHAR)) = 'true') AS n_true, "
    f"count_if(lower(CAST({n} AS VARCHAR)) = 'false') AS n_false, "
    f"count_if(CAST({n} AS VARCHAR) = 'CANT CHECK') AS n_cant_check, count_if({n} IS NULL) AS n_missing FROM a"
    for n in _VORDER]))

ORACLES["row_uniqueness"] = with_view(f"SELECT {KEYS}, {_UNIQ} AS uniqueness_flag FROM rt")
ORACLES["duplicate_keys"] = with_view(
    "SELECT transaction_id, count(*) AS n_rows FROM rv WHERE transaction_id IS NOT NULL "
    "GROUP BY transaction_id HAVING count(*) <> 1")
ORACLES["distinct_values"] = with_view("SELECT DISTINCT customer_id FROM rv")
ORACLES["distinct_counts"] = with_view(_union_report([
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM rt HAVING count(DISTINCT {c}) > 0"
    for c in COLS]))
ORACLES["distinct_combinations"] = with_view("SELECT DISTINCT item, price, discount_applied FROM rv")
ORACLES["fd_violations"] = with_view(
    "SELECT item, count(DISTINCT category) AS n_values FROM rv WHERE item IS NOT NULL AND category IS NOT NULL "
    "GROUP BY item HAVING count(DISTINCT category) > 1")
ORACLES["timeliness"] = with_view(
    "SELECT CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date, "
    "datediff('month', min(d), max(d)) >= 36 AS has_three_years "
    "FROM (SELECT CAST(try_strptime(transaction_date, '%Y-%m-%d') AS DATE) AS d FROM rv "
    "WHERE regexp_full_match(transaction_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))")
ORACLES["format_report"] = with_view(_report("rt", OrderedDict([
    ("item", full("item", "Item_[0-9]+_[A-Z]+")), ("customer_id", full("customer_id", "CUST_[0-9]{2}")),
    ("transaction_id", full("transaction_id", TXN)),
    ("transaction_date", full("transaction_date", "[0-9]{4}-[0-9]{2}-[0-9]{2}"))])))
ORACLES["date_report"] = with_view(_report("rt", OrderedDict([("transaction_date", date_ok("transaction_date", 1800))])))
ORACLES["positive_report"] = with_view(_report("rt", OrderedDict(
    (c, _outlier(c)) for c in ("price", "quantity", "total_spent")), valid_name="outlier"))
ORACLES["domain_report"] = with_view(_report("rt", OrderedDict([
    ("payment_method", f"payment_method IN {in_list(PAYS)}"), ("category", f"category IN {in_list(CATS)}"),
    ("location", f"location IN {in_list(LOCS)}")])))
ORACLES["own_domain_report"] = with_view(_report("rt", OrderedDict([
    ("payment_method", "payment_method IS NOT NULL"), ("category", "category IS NOT NULL"),
    ("location", "location IS NOT NULL")])))
ORACLES["price_master"] = with_view(
    "SELECT DISTINCT item AS \"Item\", price AS \"Price Per Unit\", '2021-01-01' AS \"Start_date\", "
    "'2026-12-31' AS \"End_date\" FROM rv WHERE item IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)")


def oracle_sql() -> "OrderedDict[str, str]":
    return ORACLES


# ---------------------------------------------------------------- aggregates
NUMS = ["price", "quantity", "total_spent"]
TEXTS = ["transaction_id", "customer_id", "category", "item", "payment_method", "location"]
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def r6(x):
    return f"round(CAST({x} AS DOUBLE), 6)"


ORACLES["group_mean_median"] = with_view(
    f"SELECT item, {r6('avg(quantity)')} AS mean_value, {r6('median(quantity)')} AS median_value "
    "FROM rv WHERE item IS NOT NULL GROUP BY item")
ORACLES["first_item_by_price"] = with_view(
    f"SELECT price, first(item ORDER BY {ORDER}) AS item FROM rv "
    "WHERE item IS NOT NULL AND price IS NOT NULL GROUP BY price")
ORACLES["group_sizes"] = with_view("SELECT transaction_id, count(*) AS n_rows FROM rv GROUP BY transaction_id")
ORACLES["value_shares"] = with_view(
    f"SELECT payment_method, count(*) AS n_rows, {r6('count(*) / sum(count(*)) OVER ()')} AS share "
    "FROM rv WHERE payment_method IS NOT NULL GROUP BY payment_method")
ORACLES["quantiles"] = with_view(_union_report([
    f"SELECT '{c}' AS column, {r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS q75 FROM rv" for c in NUMS]))
ORACLES["describe"] = with_view(_union_report([
    f"SELECT '{c}' AS column, count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, {r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS p75, CAST(max({c}) AS DOUBLE) AS max FROM rv" for c in NUMS]))
ORACLES["crosstab"] = with_view(
    "SELECT payment_method, count_if(location = 'In-store') AS \"In-store\", count_if(location = 'Online') AS \"Online\" "
    "FROM rv WHERE payment_method IS NOT NULL AND location IS NOT NULL GROUP BY payment_method")
ORACLES["correlation"] = with_view(_union_report([
    f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM rv"
    for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]))
ORACLES["mode_median"] = with_view(_union_report([
    f"SELECT '{c}' AS column, {r6(f'median({c})')} AS median, CAST(mode({c} ORDER BY {c}) AS VARCHAR) AS mode FROM rv"
    for c in ["quantity", "price"]]))
ORACLES["text_lengths"] = with_view(_union_report([
    f"SELECT '{c}' AS column, CAST(min(length({c})) AS INTEGER) AS min_length, "
    f"CAST(max(length({c})) AS INTEGER) AS max_length, {r6(f'avg(length({c}))')} AS avg_length FROM rt"
    for c in TEXTS]))
_DTYPES = {"price": "double", "quantity": "double", "total_spent": "double", "discount_applied": "boolean"}
ORACLES["column_info"] = with_view(_union_report([
    f"SELECT '{c}' AS column, CAST({i} AS INTEGER) AS position, '{_DTYPES.get(c, 'string')}' AS dtype, "
    f"count({c}) AS non_null, count(*) AS rows FROM rv" for i, c in enumerate(COLS)]))
ORACLES["share_outside"] = with_view(
    "SELECT count_if(quantity < 5.0 OR quantity > 45.0) AS n_outside, count(*) AS rows, "
    f"{r6('coalesce(100.0 * count_if(quantity < 5.0 OR quantity > 45.0) / nullif(count(*), 0), 0)')} AS share FROM rv")

# ---------------------------------------------------------------- repair
_C1 = (", c1 AS (SELECT * REPLACE (CASE WHEN price IS NULL OR isnan(price) THEN total_spent / nullif(quantity, 0) "
       "ELSE price END AS price) FROM rv)")
_C2 = (f", lk AS (SELECT price AS fp, first(item ORDER BY {ORDER}) AS fi FROM c1 "
       "WHERE item IS NOT NULL AND price IS NOT NULL GROUP BY price), "
       "c2 AS (SELECT c1.* REPLACE (coalesce(c1.item, lk.fi) AS item) FROM c1 LEFT JOIN lk ON c1.price = lk.fp)")
_C3 = (", gm AS (SELECT item AS gk, avg(quantity) AS gmean FROM c2 WHERE item IS NOT NULL GROUP BY item), "
       "c3 AS (SELECT c2.* REPLACE (CASE WHEN c2.item IS NULL THEN NULL WHEN c2.quantity IS NULL OR isnan(c2.quantity) "
       "THEN gm.gmean ELSE c2.quantity END AS quantity) FROM c2 LEFT JOIN gm ON c2.item = gm.gk)")
_C4 = ", c4 AS (SELECT * REPLACE (price * quantity AS total_spent) FROM c3)"
_C5 = ", c5 AS (SELECT * REPLACE (coalesce(discount_applied, false) AS discount_applied) FROM c4)"

ORACLES["fill_price"] = with_view(_C1 + f"\nSELECT {KEYS}, {r6('price')} AS price FROM c1")
ORACLES["fill_item"] = with_view(_C1 + _C2 + f"\nSELECT {KEYS}, item FROM c2")
ORACLES["fill_quantity"] = with_view(_C1 + _C2 + _C3 + f"\nSELECT {KEYS}, {r6('quantity')} AS quantity FROM c3")
ORACLES["recompute_total"] = with_view(_C1 + _C2 + _C3 + _C4 + f"\nSELECT {KEYS}, {r6('total_spent')} AS total_spent FROM c4")
ORACLES["fill_discount"] = with_view(f"SELECT {KEYS}, coalesce(discount_applied, false) AS discount_applied FROM rv")
ORACLES["full_repair"] = with_view(
    _C1 + _C2 + _C3 + _C4 + _C5 + f"\nSELECT * REPLACE ({r6('price')} AS price, {r6('quantity')} AS quantity, "
    f"{r6('total_spent')} AS total_spent) FROM c5")

_TXT_COLS = ["transaction_id", "customer_id", "category", "item", "payment_method", "location", "transaction_date"]
ORACLES["impute_generic"] = with_view(
    f"SELECT {KEYS}, "
    + ", ".join(f"coalesce({c}, (SELECT mode({c} ORDER BY {c}) FROM rv)) AS {c}" for c in _TXT_COLS[:4])
    + ", " + ", ".join(f"{r6(f'coalesce({c}, (SELECT median({c}) FROM rv))')} AS {c}" for c in NUMS)
    + ", " + ", ".join(f"coalesce({c}, (SELECT mode({c} ORDER BY {c}) FROM rv)) AS {c}" for c in _TXT_COLS[4:])
    + " FROM rv")


def _fences(c):
    q1 = f"(SELECT quantile_cont({c}, 0.25) FROM rv)"
    q3 = f"(SELECT quantile_cont({c}, 0.75) FROM rv)"
    return f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"


ORACLES["cap_outliers"] = with_view(
    f"SELECT {KEYS}, " + ", ".join(
        f"{r6(f'CASE WHEN {c} < {_fences(c)[0]} THEN {_fences(c)[0]} WHEN {c} > {_fences(c)[1]} THEN {_fences(c)[1]} ELSE {c} END')} AS {c}"
        for c in NUMS) + " FROM rv")
_lo, _hi = _fences("total_spent")
ORACLES["iqr_outliers"] = with_view(
    f"SELECT {KEYS}, {r6('total_spent')} AS total_spent, {r6(_lo)} AS lower_bound, {r6(_hi)} AS upper_bound "
    f"FROM rv WHERE total_spent < {_lo} OR total_spent > {_hi}")
ORACLES["model_input_clean"] = with_view(
    f"SELECT {KEYS}, coalesce(category, 'nan') AS category, coalesce(item, 'nan') AS item, price, quantity, "
    "total_spent, coalesce(payment_method, 'nan') AS payment_method, coalesce(location, 'nan') AS location, "
    "transaction_date, coalesce(CASE WHEN discount_applied THEN 'true' WHEN NOT discount_applied THEN 'false' END, 'nan') "
    "AS discount_applied FROM rv WHERE quantity IS NOT NULL AND NOT isnan(quantity) AND price IS NOT NULL "
    "AND NOT isnan(price) AND total_spent IS NOT NULL AND NOT isnan(total_spent)")

# ---------------------------------------------------------------- weekly
WK_CATS = sorted(CATS)
WK_PAYS = ["Cash", "Credit Card", "Crypto", "Digital Wallet"]
WK_LOCS = ["In-store", "Online"]
_WB = (", b AS (SELECT strftime(CAST(try_strptime(transaction_date, '%Y-%m-%d') AS DATE) - "
       "CAST(isodow(CAST(try_strptime(transaction_date, '%Y-%m-%d') AS DATE)) - 1 AS INTEGER), '%Y-%m-%d') AS yw, "
       "transaction_id, customer_id, total_spent, CASE WHEN discount_applied THEN 1 ELSE 0 END AS disc, "
       "category, payment_method, location FROM rv WHERE try_strptime(transaction_date, '%Y-%m-%d') IS NOT NULL), "
       "wk AS (SELECT yw AS \"Year_Week\", "
       f"{r6('1 - (count(DISTINCT customer_id) + max(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END)) / count(*)')} "
       "AS weekly_avg_repeat_purchases, CAST(coalesce(sum(total_spent), 0) AS DOUBLE) AS total_sales, "
       "count(DISTINCT transaction_id) AS unique_transactions, count(DISTINCT customer_id) AS unique_customers, "
       "CAST(sum(disc) AS BIGINT) AS discounted_transactions, "
       + ", ".join(f"CASE WHEN count(category) > 0 THEN CAST(coalesce(sum(CASE WHEN category = {lit(v)} THEN total_spent END), 0) AS DOUBLE) END AS {q(v)}" for v in WK_CATS)
       + ", " + ", ".join(f"CASE WHEN count(payment_method) > 0 THEN count(DISTINCT CASE WHEN payment_method = {lit(v)} THEN transaction_id END) END AS {q(v)}" for v in WK_PAYS)
       + ", " + ", ".join(f"CASE WHEN count(location) > 0 THEN count(DISTINCT CASE WHEN location = {lit(v)} THEN transaction_id END) END AS {q(v)}" for v in WK_LOCS)
       + " FROM b GROUP BY yw)\n")
WK_FEATURES = (["weekly_avg_repeat_purchases", "total_sales", "unique_transactions", "unique_customers",
                "discounted_transactions"] + WK_CATS + WK_PAYS + WK_LOCS)


def _lags(n_past, n_future):
    parts = [f"lag({q(c)}, {i}) OVER (ORDER BY \"Year_Week\") AS {q(f'{c}_t-{i}')}"
             for c in WK_FEATURES for i in range(1, n_past + 1)]
    parts += [f"lead(total_sales, {i}) OVER (ORDER BY \"Year_Week\") AS y_{i}" for i in range(1, n_future + 1)]
    return parts


ORACLES["weekly_base"] = with_view(_WB + "SELECT \"Year_Week\", weekly_avg_repeat_purchases, total_sales, "
                                   "unique_transactions, unique_customers, discounted_transactions FROM wk")
ORACLES["weekly_repeat_ratio"] = with_view(_WB + "SELECT \"Year_Week\", weekly_avg_repeat_purchases FROM wk")
ORACLES["weekly_category"] = with_view(_WB + "SELECT \"Year_Week\", " + ", ".join(q(v) for v in WK_CATS) + " FROM wk")
ORACLES["weekly_payment"] = with_view(_WB + "SELECT \"Year_Week\", " + ", ".join(q(v) for v in WK_PAYS) + " FROM wk")
ORACLES["weekly_location"] = with_view(_WB + "SELECT \"Year_Week\", " + ", ".join(q(v) for v in WK_LOCS) + " FROM wk")
ORACLES["weekly_lags"] = with_view(_WB + "SELECT *, " + ", ".join(_lags(3, 0)) + " FROM wk")
_IW = "OVER (PARTITION BY item ORDER BY yw)"
ORACLES["item_week_lags"] = with_view(
    _WB.split(", wk AS")[0].replace("category, payment_method, location FROM rv", "item, quantity FROM rv")
    + ", iw AS (SELECT item, yw, sum(total_spent) AS total_sales, sum(quantity) AS units FROM b GROUP BY ALL)\n"
    "SELECT item, yw AS \"Year_Week\", total_sales, units, "
    + ", ".join(f"lag({c}, {i}) {_IW} AS {q(f'{c}_t-{i}')}" for c in ("total_sales", "units") for i in (1, 2, 3))
    + ", " + ", ".join(f"lead(total_sales, {i}) {_IW} AS y_{i}" for i in (1, 2)) + " FROM iw")
ORACLES["weekly_leads"] = with_view(_WB + "SELECT \"Year_Week\", total_sales, " + ", ".join(_lags(0, 15)) + " FROM wk")
ORACLES["weekly_features"] = with_view(_WB + "SELECT *, " + ", ".join(_lags(30, 15)) + " FROM wk")
ORACLES["weekly_range"] = with_view(
    _WB + ", f AS (SELECT *, " + ", ".join(_lags(6, 1)) + " FROM wk)\n"
    "SELECT * FROM f WHERE \"Year_Week\" >= '1996-01-01' AND \"Year_Week\" <= '2000-12'")


# ---------------------------------------------------------------- streams, run to their end
ORACLES["stream_first_rows"] = """
SELECT event_id, ts, user_id, event_type,
       row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS is_first FROM events"""
ORACLES["stream_repeat_ratio"] = f"""
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS "Year_Week", count(*) AS n_rows,
       count(DISTINCT user_id) AS n_customers, {r6('1 - count(DISTINCT user_id) / count(*)')} AS repeat_ratio
FROM events GROUP BY 1"""

# ---------------------------------------------------------------- projections / filters
ORACLES["negative_rows"] = with_view(
    f"SELECT {KEYS}, quantity, price FROM rt WHERE TRY_CAST(quantity AS DOUBLE) < 0 OR TRY_CAST(price AS DOUBLE) < 0")
ORACLES["co_missing"] = with_view(_union_report([
    f"SELECT '{c}' AS column, count_if({c} IS NULL{' OR isnan(' + c + ')' if c in NUMS else ''}) AS missing_count "
    "FROM rv WHERE price IS NULL OR isnan(price)" for c in COLS]))
ORACLES["equality_distinct"] = with_view("SELECT DISTINCT item FROM rv WHERE price = 8.0")
ORACLES["numeric_coerce"] = with_view(
    f"SELECT {KEYS}, TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(total_spent AS DOUBLE) AS total_spent FROM rt "
    "WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(price AS DOUBLE)) "
    "AND TRY_CAST(total_spent AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(total_spent AS DOUBLE))")
ORACLES["bool_normalise"] = with_view(
    f"SELECT {KEYS}, CAST(CASE WHEN discount_applied IN ('True', 'true', '1') THEN 1 ELSE 0 END AS INTEGER) "
    "AS discount_applied FROM rt")
ORACLES["null_drop"] = with_view(f"SELECT {KEYS}, quantity FROM rv WHERE quantity IS NOT NULL AND NOT isnan(quantity)")

# ---------------------------------------------------------------- scalar functions
_D = "CAST(try_strptime(transaction_date, '%Y-%m-%d') AS DATE)"
_Q = "TRY_CAST(quantity AS DOUBLE)"
_P = "TRY_CAST(price AS DOUBLE)"
_T = "TRY_CAST(total_spent AS DOUBLE)"
ORACLES["scalar_functions"] = with_view(
    f"SELECT {KEYS}, coalesce({full('item', 'Item_[0-9]+_[A-Z]+')}, false) AS f_full_match, "
    f"{blank('location')} AS f_blank, CAST(length(price) AS INTEGER) AS f_length, "
    f"strftime({_D} - CAST(isodow({_D}) - 1 AS INTEGER), '%Y-%m-%d') AS f_week, dayname({_D}) AS f_day_name, "
    f"CAST(day({_D}) AS INTEGER) AS f_day, CAST({_D} AS VARCHAR) AS f_date, CAST(year({_D}) AS INTEGER) AS f_year, "
    f"CAST(month({_D}) AS INTEGER) AS f_month, ({_Q} = floor({_Q})) AS f_whole, "
    f"{r6(f'{_T} / nullif({_Q}, 0)')} AS f_divide, {r6(f'{_P} * {_Q}')} AS f_multiply, "
    "coalesce(discount_applied, 'False') AS f_fill, "
    f"(payment_method IN {in_list(PAYS)}) AS f_member, CASE WHEN {_Q} > 40 THEN 40.0 ELSE {_Q} END AS f_clamp, "
    "(transaction_date <= '1998-12-31') AS f_text_compare, "
    f"{r6(f'coalesce(100.0 * {_Q} / 50.0, 0)')} AS f_percent, round({_P}, 0) AS f_round, "
    f"({ABBR_CASE}) AS f_lookup, ({_P} IS NOT NULL) AS f_is_number FROM rt")

# ---------------------------------------------------------------- sorts, limits, unions
ORACLES["sorted_first_rows"] = with_view(
    f"SELECT {KEYS}, customer_id, total_spent FROM rv ORDER BY customer_id NULLS LAST, {KEYS} LIMIT 5")
ORACLES["best_row"] = with_view(
    f"SELECT {KEYS}, item, total_spent FROM rv ORDER BY total_spent DESC NULLS LAST, {KEYS} LIMIT 1")
_lo_t, _hi_t = _fences("total_spent")
_CAPPED_T = f"CASE WHEN total_spent < {_lo_t} THEN {_lo_t} WHEN total_spent > {_hi_t} THEN {_hi_t} ELSE total_spent END"
ORACLES["union_tagged"] = with_view(
    f"SELECT {KEYS}, {r6('total_spent')} AS total_spent, 'Before' AS \"DataFrame\" FROM rv UNION ALL "
    f"SELECT {KEYS}, {r6(_CAPPED_T)} AS total_spent, 'After' AS \"DataFrame\" FROM rv")

# ---------------------------------------------------------------- profiling
_ROLE = {"price": "numeric", "quantity": "numeric", "total_spent": "numeric", "discount_applied": "target"}
ORACLES["column_roles"] = with_view(_union_report([
    f"SELECT '{c}' AS column, '{_ROLE.get(c, 'categorical')}' AS role, count({c}) AS non_null FROM rv" for c in COLS]))


def _profile_part(i, c):
    dtype = _DTYPES.get(c, "string")
    is_num = c in NUMS
    s = f"CAST({c} AS VARCHAR)"
    if is_num:
        vtype = f"CASE WHEN coalesce(bool_and({c} = floor({c})), true) THEN 'Discrete' ELSE 'Continuous' END"
    else:
        ratio = f"CAST(count(DISTINCT {s}) AS DOUBLE) / nullif(count({c}), 0)"
        vtype = f"CASE WHEN {ratio} IS NULL THEN NULL WHEN {ratio} < 0.2 THEN 'Ordinal' ELSE 'Nominal' END"
    return (f"SELECT '{c}' AS column, CAST({i} AS INTEGER) AS position, '{dtype}' AS data_type, "
            f"count(DISTINCT {s}) AS unique_values, {vtype} AS variable_type, "
            f"coalesce(list_sort(list_distinct(list(CAST(length({s}) AS INTEGER)))), []) AS lengths, "
            f"{'CAST(min(' + c + ') AS DOUBLE)' if is_num else 'CAST(NULL AS DOUBLE)'} AS min_value, "
            f"{'CAST(max(' + c + ') AS DOUBLE)' if is_num else 'CAST(NULL AS DOUBLE)'} AS max_value, "
            f"{'CAST(NULL AS DOUBLE)' if is_num else r6(f'avg(length({s}))')} AS avg_length FROM rv")


ORACLES["column_profile"] = with_view(_union_report([_profile_part(i, c) for i, c in enumerate(COLS)]))
ORACLES["variable_types"] = with_view(
    "SELECT \"column\", variable_type FROM (" + _union_report([_profile_part(i, c) for i, c in enumerate(COLS)]) + ")")
ORACLES["discount_by_day"] = with_view(
    f", dd AS (SELECT {_D.replace('transaction_date', 'transaction_date')} AS d FROM rv "
    f"WHERE discount_applied AND {_D} IS NOT NULL), "
    "kv AS (SELECT 'weekday' AS kind, dayname(d) AS value FROM dd UNION ALL "
    "SELECT 'day_of_month' AS kind, CAST(day(d) AS VARCHAR) AS value FROM dd)\n"
    f"SELECT kind, value, count(*) AS n_rows, {r6('count(*) / (SELECT count(*) FROM dd)')} AS share "
    "FROM kv GROUP BY kind, value")

# ---------------------------------------------------------------- statistics
ORACLES["one_hot"] = with_view(
    f"SELECT {KEYS}, price, quantity, "
    + ", ".join(f"CAST(coalesce(payment_method, 'nan') = {lit(v)} AS DOUBLE) AS {q('payment_method_' + v)}"
                for v in WK_PAYS)
    + ", " + ", ".join(f"CAST(coalesce(location, 'nan') = {lit(v)} AS DOUBLE) AS {q('location_' + v)}"
                       for v in WK_LOCS + ["nan"])
    + ", discount_applied FROM rv")
_SPARSE = ["customer_id", "item", "location"]
ORACLES["one_hot_sparse"] = with_view(
    ", pairs AS (" + " UNION ALL ".join(
        f"SELECT {KEYS}, {i} AS pos, coalesce({c}, 'nan') AS level FROM rv" for i, c in enumerate(_SPARSE)) + "), "
    "slots AS (SELECT pos, level, row_number() OVER (ORDER BY pos, level) - 1 AS slot FROM (SELECT DISTINCT pos, level FROM pairs))\n"
    f"SELECT {KEYS}, slot, CAST(1 AS DOUBLE) AS value FROM pairs JOIN slots USING (pos, level)")
_CHI_COLS = ["category", "payment_method", "location", "item"]
_CHI = (", cells AS (" + _union_report([
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS lvl, CAST(discount_applied AS VARCHAR) AS tgt, count(*) AS n "
    f"FROM rv WHERE {c} IS NOT NULL AND discount_applied IS NOT NULL GROUP BY ALL" for c in _CHI_COLS]) + "), "
    "rr AS (SELECT col, lvl, sum(n) AS r FROM cells GROUP BY ALL), "
    "cc AS (SELECT col, tgt, sum(n) AS c FROM cells GROUP BY ALL), "
    "tt AS (SELECT col, sum(n) AS nn, count(DISTINCT lvl) AS nl, count(DISTINCT tgt) AS nt FROM cells GROUP BY col), "
    "grid AS (SELECT rr.col, CAST(rr.r AS DOUBLE) * cc.c / tt.nn AS e, CAST(coalesce(cells.n, 0) AS DOUBLE) AS o, "
    "tt.nl, tt.nt, tt.nn FROM rr JOIN cc ON rr.col = cc.col JOIN tt ON tt.col = rr.col "
    "LEFT JOIN cells ON cells.col = rr.col AND cells.lvl = rr.lvl AND cells.tgt = cc.tgt)\n")
ORACLES["chi_square"] = with_view(
    _CHI + "SELECT col AS column, round(CASE WHEN (nl - 1) * (nt - 1) = 1 "
    "THEN sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(o * o / e) - max(nn) END, 6) AS statistic, "
    "CAST((nl - 1) * (nt - 1) AS BIGINT) AS dof FROM grid GROUP BY col, nl, nt")
ORACLES["correlation_pairs"] = with_view(
    ", rd AS (SELECT price, quantity, total_spent, CAST(discount_applied AS DOUBLE) AS discount_applied FROM rv)\n"
    + _union_report([f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM rd"
                     for i, a in enumerate(NUMS + ['discount_applied'])
                     for b in (NUMS + ['discount_applied'])[i + 1:]]))
ORACLES["scale"] = with_view(
    f"SELECT {KEYS}, " + ", ".join(
        f"{r6(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in NUMS) + " FROM rv")

# ---------------------------------------------------------------- chart tables
ORACLES["missing_bars"] = with_view(
    "SELECT \"column\", missing_pct FROM (" + _missing_report(False, "rv") + ") WHERE missing_pct > 0")
ORACLES["box_summary"] = with_view(_union_report([
    f"SELECT '{c}' AS column, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, {r6(f'quantile_cont({c}, 0.25)')} AS q1, "
    f"{r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'quantile_cont({c}, 0.75)')} AS q3, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM rv WHERE {c} IS NOT NULL" for c in NUMS]))


def _hist(c, by=None):
    lo = f"(SELECT min({c}) FROM rv)"
    hi = f"(SELECT max({c}) FROM rv)"
    b = f"least(floor(({c} - {lo}) / ({hi} - {lo}) * 10), 9)"
    grp = f", CAST({by} AS VARCHAR) AS {by}" if by else ""
    where = f" AND {by} IS NOT NULL" if by else ""
    gb = f", CAST({by} AS VARCHAR)" if by else ""
    return (f"SELECT '{c}' AS column, CAST({b} AS INTEGER) AS bucket{grp}, "
            f"{r6(f'{lo} + {b} * (({hi} - {lo}) / 10)')} AS bucket_start, count(*) AS n FROM rv "
            f"WHERE {c} IS NOT NULL{where} GROUP BY {b}{gb}")


ORACLES["histogram"] = with_view(_union_report([_hist(c) for c in NUMS]))
ORACLES["class_histogram"] = with_view(_union_report([_hist(c, "discount_applied") for c in ["quantity", "total_spent"]]))
ORACLES["category_counts"] = with_view(_union_report([
    f"SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM rv WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ["category", "payment_method", "location"]]))
ORACLES["class_counts"] = with_view(_union_report([
    f"SELECT '{c}' AS column, {c} AS value, CAST(discount_applied AS VARCHAR) AS discount_applied, count(*) AS n "
    f"FROM rv WHERE {c} IS NOT NULL AND discount_applied IS NOT NULL GROUP BY ALL"
    for c in ["category", "payment_method", "location"]]))
ORACLES["status_share"] = with_view(
    f"SELECT CAST(discount_applied AS VARCHAR) AS class, count(*) AS n, "
    f"{r6('100.0 * count(*) / (SELECT count(*) FROM rv)')} AS pct FROM rv GROUP BY discount_applied")
ORACLES["before_after_box"] = with_view(
    f", u AS (SELECT total_spent AS x, 'Before' AS g FROM rv UNION ALL SELECT {_CAPPED_T} AS x, 'After' AS g FROM rv)\n"
    f"SELECT 'total_spent' AS column, g AS \"DataFrame\", count(x) AS n, CAST(min(x) AS DOUBLE) AS min, "
    f"{r6('quantile_cont(x, 0.25)')} AS q1, {r6('quantile_cont(x, 0.5)')} AS median, "
    f"{r6('quantile_cont(x, 0.75)')} AS q3, CAST(max(x) AS DOUBLE) AS max FROM u WHERE x IS NOT NULL GROUP BY g")


# ---------------------------------------------------------------- sources and sinks
_FIT_INTS = {"unique_transactions", "unique_customers", "discounted_transactions"} | set(WK_PAYS) | set(WK_LOCS)
_FIT_COLS = (["Year_Week"] + WK_FEATURES + [f"weekly_avg_repeat_purchases_t-{i}" for i in range(1, 31)]
             + [f"total_sales_t-{i}" for i in range(1, 31)] + ["unique_transactions_t-1", "unique_transactions_t-2"])


def _fit_expr(c):
    if c == "Year_Week":
        return '"Year_Week"'
    base, _, lag = c.rpartition("_t-")
    src = f"lag({q(base)}, {lag}) OVER (ORDER BY \"Year_Week\")" if base and lag.isdigit() else q(c)
    typ = "BIGINT" if c in _FIT_INTS else "DOUBLE"
    return f"CAST({src} AS {typ}) AS {q(c)}"


ORACLES["schema_fit"] = with_view(_WB + "SELECT " + ", ".join(_fit_expr(c) for c in _FIT_COLS) + " FROM wk")
_CONS = [
    ("missing transaction id", "transaction_id IS NOT NULL"),
    ("price not a number", "price IS NULL OR TRY_CAST(price AS DOUBLE) IS NOT NULL"),
    ("quantity not a number", "quantity IS NULL OR TRY_CAST(quantity AS DOUBLE) IS NOT NULL"),
    ("total not a number", "total_spent IS NULL OR TRY_CAST(total_spent AS DOUBLE) IS NOT NULL"),
    ("date not a date", "transaction_date IS NULL OR try_strptime(transaction_date, '%Y-%m-%d') IS NOT NULL"),
]
ORACLES["good_reject_split"] = with_view(
    "SELECT 'good' AS outcome, '' AS reason, count(*) AS n_rows FROM rt WHERE "
    + " AND ".join(f"coalesce({c}, false)" for _, c in _CONS) + "\nUNION ALL\n"
    + _union_report([f"SELECT 'rejected' AS outcome, {lit(r)} AS reason, count(*) AS n_rows FROM rt "
                     f"WHERE NOT coalesce({c}, false) HAVING count(*) > 0" for r, c in _CONS]))
ORACLES["json_rows"] = with_view(
    "SELECT CAST(json_object('transaction_id', transaction_id, 'customer_id', customer_id, 'item', item, "
    "'price', price, 'quantity', quantity, 'discount_applied', discount_applied) AS VARCHAR) AS json FROM rv")


# ---------------------------------------------------------------- models
ORACLES["date_features"] = with_view(
    f"SELECT {KEYS}, CAST(year({_D}) AS INTEGER) AS transaction_date_year, "
    f"CAST(month({_D}) AS INTEGER) AS transaction_date_month, CAST(day({_D}) AS INTEGER) AS transaction_date_day FROM rv")
ORACLES["impute_mean_mode"] = with_view(
    f"SELECT {KEYS}, " + ", ".join(f"{r6(f'coalesce({c}, (SELECT avg({c}) FROM rv))')} AS {c}" for c in NUMS)
    + ", " + ", ".join(f"coalesce({c}, (SELECT mode({c} ORDER BY {c}) FROM rv)) AS {c}"
                       for c in ["category", "payment_method", "location"]) + " FROM rv")
ORACLES["stratified_folds"] = with_view(
    ", cls AS (SELECT CAST(discount_applied AS DOUBLE) AS label, count(*) AS n FROM rv "
    "WHERE discount_applied IS NOT NULL GROUP BY 1)\n"
    "SELECT label AS discount_applied, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n_rows "
    "FROM cls, range(5) t(f)")
_INSERT = """,
ins AS (
  SELECT transaction_id, CASE
    WHEN transaction_id IS NULL THEN 'transaction_id is null' WHEN customer_id IS NULL THEN 'customer_id is null'
    WHEN price IS NULL THEN 'price is null' WHEN quantity % 1 <> 0 THEN 'quantity is no int64'
    WHEN transaction_date IS NULL THEN 'transaction_date is null'
    WHEN TRY_CAST(transaction_date AS DATE) IS NULL THEN 'transaction_date is no date32[day]' END AS bad FROM rv),
taken AS (
  SELECT 'transaction_id is taken' AS bad, count(*) - count(DISTINCT transaction_id) AS n FROM ins WHERE bad IS NULL),
failed AS (SELECT bad, count(*) AS n FROM ins WHERE bad IS NOT NULL GROUP BY 1 UNION ALL SELECT * FROM taken WHERE n > 0),
good AS (SELECT count(DISTINCT transaction_id) AS n FROM ins WHERE bad IS NULL)
SELECT 'good' AS outcome, '' AS reason, n AS n_rows FROM good
UNION ALL SELECT 'failed', bad, n FROM failed UNION ALL SELECT 'rejects', bad, n FROM failed
UNION ALL SELECT 'stored', 'rows', n FROM good UNION ALL SELECT 'stored', 'keys', n FROM good
"""
ORACLES["batched_insert"] = with_view(_INSERT)
ORACLES["paged_scan"] = with_view(
    "SELECT l_orderkey, l_linenumber, transaction_id, item, price, quantity FROM rv")
ORACLES["nearest_rows"] = """
WITH t AS (
  SELECT o_custkey, count(*) AS a1, sum(floor(l_quantity)) AS a2, sum(l_linenumber) AS a3, max(floor(l_quantity)) AS a4,
         count(DISTINCT l_suppkey) AS a5, sum(floor(l_discount * 100 + 0.5)) AS a6
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
p AS (SELECT min(o_custkey) AS id, a1::BIGINT AS a1, a2::BIGINT AS a2, a3::BIGINT AS a3, a4::BIGINT AS a4, a5::BIGINT AS a5,
             a6::BIGINT AS a6 FROM t GROUP BY ALL),
d AS (SELECT x.id, y.id AS o, (x.a1-y.a1)**2 + (x.a2-y.a2)**2 + (x.a3-y.a3)**2 + (x.a4-y.a4)**2 + (x.a5-y.a5)**2 + (x.a6-y.a6)**2 AS d
      FROM p x JOIN p y ON x.id <> y.id),
r AS (SELECT id, o, d, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d)
SELECT id::BIGINT AS custkey, k::INTEGER AS place, o::BIGINT AS near_custkey, d::BIGINT AS squared_distance FROM r WHERE k <= 5
"""
ORACLES["rebalance"] = with_view(
    ", cls AS (SELECT CAST(discount_applied AS DOUBLE) AS label, count(*) AS n FROM rv "
    "WHERE discount_applied IS NOT NULL GROUP BY 1)\n"
    "SELECT label AS discount_applied, max(n) OVER () AS n_rows FROM cls")


# ---------------------------------------------------------------- more row outputs and sinks
ORACLES["positive_rows"] = with_view(
    f"SELECT {KEYS}, price, 'missing' AS kind FROM rt WHERE {blank('price')} UNION ALL "
    f"SELECT {KEYS}, price, 'outlier' AS kind FROM rt WHERE NOT {blank('price')} AND {_outlier('price')}")
ORACLES["domain_rows"] = with_view(
    f"SELECT payment_method, CASE WHEN NOT {blank('payment_method')} THEN payment_method IN {in_list(PAYS)} END "
    f"AS \"Valid\", {blank('payment_method')} AS is_missing FROM rt")
_CM = NUMS + ["discount_applied"]
ORACLES["correlation_matrix"] = with_view(
    ", rd AS (SELECT price, quantity, total_spent, CAST(discount_applied AS DOUBLE) AS discount_applied FROM rv)\n"
    + _union_report([
        f"SELECT '{a}' AS a, " + ", ".join(
            ("CAST(1.0 AS DOUBLE)" if a == b else r6(f"(SELECT round(corr({a}, {b}), 6) FROM rd)")) + f" AS {b}"
            for b in _CM) for a in _CM]))
ORACLES["inf_to_null"] = with_view(
    f"SELECT {KEYS}, (isinf(exp(total_spent)) AND total_spent IS NOT NULL) AS overflowed FROM rv")
ORACLES["limited_scan"] = with_view(f"SELECT {KEYS}, transaction_id FROM rv ORDER BY {KEYS} LIMIT 100")


def _bigint_count_if(sql: str) -> str:
    """``count_if(x)`` is HUGEINT in DuckDB; ``count(*) FILTER (WHERE x)`` is
    BIGINT, as Spark's counts are."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + len(token), 1
        while depth:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
            k += 1
        inner = _bigint_count_if(sql[j + len(token):k - 1])
        out.append(f"(count(*) FILTER (WHERE {inner}))")
        i = k


for _name in list(ORACLES):
    ORACLES[_name] = _bigint_count_if(ORACLES[_name])

_ALL_WEEKLY = WK_FEATURES + [f"{c}_t-{i}" for c in WK_FEATURES for i in range(1, 31)] + [f"y_{i}" for i in range(1, 16)]
ORACLES["weekly_correlation"] = with_view(
    _WB + ", f AS (SELECT *, " + ", ".join(_lags(30, 15)) + " FROM wk),\n"
    "t AS (SELECT \"Year_Week\", " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in _ALL_WEEKLY) + " FROM f),\n"
    "u AS (UNPIVOT t ON COLUMNS(* EXCLUDE (\"Year_Week\")) INTO NAME c VALUE v)\n"
    "SELECT x.c AS a, y.c AS b, count(*) AS n, CASE WHEN count(*) >= 2 AND min(x.v) < max(x.v) AND min(y.v) < max(y.v) "
    "THEN round(corr(x.v, y.v), 6) END AS r FROM u x JOIN u y ON x.\"Year_Week\" = y.\"Year_Week\" AND x.c < y.c GROUP BY 1, 2")
ORACLES["sample_values"] = with_view(
    ", v AS (" + " UNION ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM rv" for c in COLS) + "),\n"
    "k AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY md5('42:' || coalesce(v, '')), v NULLS FIRST) AS k FROM v)\n"
    "SELECT col AS \"column\", count(v) AS unique_count, list(v ORDER BY k) FILTER (WHERE k <= 10) AS sample_values "
    "FROM k GROUP BY col")
ORACLES["csv_roundtrip"] = with_view("SELECT " + ", ".join(COLS) + " FROM rt")
ORACLES["check_after_write"] = with_view(
    _WB + 'SELECT (SELECT count(*) FROM wk) AS rows_written, "Year_Week", total_sales FROM wk ORDER BY "Year_Week" LIMIT 5')

