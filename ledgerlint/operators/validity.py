"""Row-level validity rules (Q11-Q19) compiled to ``Column`` expressions.

Verdict types:

* regex rules: boolean, a missing value is ``False`` (its text form fails);
* domain lists: boolean, a missing value stays null;
* integer / date rules: boolean, missing stays null;
* cross-column rules (item, price, total): text ``'True'``, ``'False'``,
  ``'CANT CHECK'`` or null.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions import scalars as S
from ledgerlint.schema import REFERENCE_COLUMNS, REFERENCE_RULES, Columns, RuleSet
from ledgerlint.session import cut_lineage, sized_broadcast

CANT_CHECK = "CANT CHECK"
INTEGER_NON_NEGATIVE = "integer_non_negative"
FLOAT_NON_NEGATIVE = "float_non_negative"
DATETIME_FORMAT = "datetime_format"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
KEYWORDS = (INTEGER_NON_NEGATIVE, FLOAT_NON_NEGATIVE, DATETIME_FORMAT)



def _TRUE():
    return F.lit("True")


def _FALSE():
    return F.lit("False")


def _CANT():
    return F.lit(CANT_CHECK)


def _NULL_TEXT():
    return F.lit(None).cast("string")


def regex_rule(c, pattern: str) -> Column:
    """Q11: full match on the text form; null is ``False``."""
    return S.full_match_or_false(c, pattern)


def domain_rule(df: DataFrame, name: str, values) -> Column:
    """Q12: membership, case-sensitive; null stays null.

    A boolean column is compared with booleans, text with the text forms.
    """
    c = F.col(name)
    dt = S.dtype_of(df, name)
    vals = list(values)
    if isinstance(dt, T.BooleanType):
        mapped = []
        for v in vals:
            if v in (True, "True"):
                mapped.append(True)
            elif v in (False, "False"):
                mapped.append(False)
        return c.isin(mapped) if mapped else F.when(c.isNotNull(), F.lit(False))
    if isinstance(dt, T.StringType):
        return c.isin([v if isinstance(v, str) else str(v) for v in vals])
    return c.isin(vals)


def integer_non_negative(df: DataFrame, name: str, min_value: float = 0) -> Column:
    """Q13: missing null; not a number False; whole and >= ``min_value``."""
    x = S.as_number(df, name)
    ok = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & S.is_whole(x) & (x >= F.lit(min_value))
    return (F.when(S.is_missing_value(df, name), F.lit(None).cast("boolean"))
             .when(x.isNull(), F.lit(False))
             .otherwise(F.coalesce(ok, F.lit(False))))


def float_non_negative(df: DataFrame, name: str) -> Column:
    """Q14: a number >= 0; anything else (missing included) False."""
    x = S.as_number(df, name)
    return F.coalesce(~F.isnan(x) & (x >= 0), F.lit(False))


def datetime_rule(df: DataFrame, name: str, pattern: str = "[0-9]{4}-[0-9]{2}-[0-9]{2}") -> Column:
    """Q15: a date value is valid; text must be ``YYYY-MM-DD`` and a real day."""
    c = F.col(name)
    dt = S.dtype_of(df, name)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(
        S.valid_iso_date_text(c, pattern))


def rule_column(df: DataFrame, name: str, rule) -> Column:
    """Q16 dispatcher: keyword, regex text, value list, or a caller's Column."""
    if isinstance(rule, Column):
        return rule
    if isinstance(rule, str):
        if rule == DATETIME_FORMAT:
            return datetime_rule(df, name)
        if rule == INTEGER_NON_NEGATIVE:
            return integer_non_negative(df, name)
        if rule == FLOAT_NON_NEGATIVE:
            return float_non_negative(df, name)
        return regex_rule(F.col(name), rule)
    if isinstance(rule, (list, tuple, set, frozenset)):
        return domain_rule(df, name, list(rule))
    raise TypeError(f"unsupported rule for {name!r}: {rule!r}")


def simple_rules(cols: Columns = REFERENCE_COLUMNS, rules: RuleSet = REFERENCE_RULES) -> "OrderedDict[str, object]":
    """The per-column rule dictionary (Q27), in the reference's order."""
    return OrderedDict([
        (cols.transaction_id, rules.transaction_pattern),
        (cols.customer_id, rules.customer_pattern),
        (cols.category, list(rules.categories)),
        (cols.payment, list(rules.payment_methods)),
        (cols.location, list(rules.locations)),
        (cols.discount, list(rules.discount_values)),
        (cols.quantity, INTEGER_NON_NEGATIVE),
        (cols.date, DATETIME_FORMAT),
    ])


def add_validity_columns(df: DataFrame, rules: "OrderedDict[str, object]",
                         suffix: str = "_validity") -> DataFrame:
    """Apply a rule dictionary in one ``select`` (no per-column copies)."""
    return df.select("*", *[rule_column(df, c, r).alias(f"{c}{suffix}")
                            for c, r in rules.items()])


def item_rule(df: DataFrame, cols: Columns = REFERENCE_COLUMNS,
              rules: RuleSet = REFERENCE_RULES) -> Column:
    """Q17: item shape, then the suffix must be the category's abbreviation.

    Missing item null; bad shape False; category missing or without an
    abbreviation ``CANT CHECK``. Once the shape ``Item_<digits>_<letters>``
    holds, a full match of ``Item_<digits>_<abbr>`` is the same as the text
    after the last underscore being equal to the abbreviation, so no per-row
    regex is compiled.
    """
    item = F.col(cols.item)
    cat = F.col(cols.category)
    abbr = S.map_lookup(rules.abbreviation_map(), cat)
    suffix = F.substring_index(item.cast("string"), "_", -1)
    return (F.when(item.isNull(), _NULL_TEXT())
             .when(~S.full_match_or_false(item, rules.item_shape), _FALSE())
             .when(cat.isNull() | abbr.isNull(), _CANT())
             .when(suffix == abbr, _TRUE())
             .otherwise(_FALSE()))


#: Items with more price periods than this are looked up by month.
MAX_PERIODS = 256


LONG_MONTHS = 120


def period_index(periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price periods (``__m_item``, ``p``, ISO dates ``s`` and ``e``) as two
    indexes of the stretches of days on which a price holds: by item, price
    and month, and by item and price for stretches of over ``LONG_MONTHS``
    months (an open end such as 9999-12-31).

    Overlapping periods of an item and price are merged first (sorted by
    start, a period opens a stretch where it starts after the greatest end
    before it). Stretches are disjoint, so a month holds at most 31 and a
    price about a thousand long ones, however many periods there are.
    """
    order = Window.partitionBy("__m_item", "p").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (before < F.col("s")), 1).otherwise(0)
    merged = (periods.where("s <= e AND p IS NOT NULL").withColumn("opens", opens)
              .withColumn("stretch", F.sum("opens").over(order))
              .groupBy(F.col("__m_item").alias("__x_item"), F.col("p").alias("__x_price"), "stretch")
              .agg(F.min("s").alias("s"), F.max("e").alias("e")))
    first, last = (F.trunc(F.try_to_date(c), "month") for c in ("s", "e"))
    long = F.months_between(last, first) > LONG_MONTHS
    months = F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))
    by_month = (merged.where(~long).withColumn("__m_month", F.explode(months))
                .groupBy("__x_item", "__x_price", "__m_month").agg(F.collect_list(F.struct("s", "e")).alias("__m_stretches")))
    by_price = merged.where(long).groupBy(F.col("__x_item").alias("__y_item"), F.col("__x_price").alias("__y_price")) \
        .agg(F.collect_list(F.struct("s", "e")).alias("__m_long"))
    return by_month, by_price


def price_rule_input(df: DataFrame, master: DataFrame, cols: Columns,
                     max_broadcast_bytes: int = 64 << 20,
                     date_valid_col: str | None = None, max_periods: int = MAX_PERIODS) -> DataFrame:
    """Attach the price verdict (Q18, J1) as column ``{price}_validity``.

    Interval existence join without fan-out: the master is grouped per item
    into a short array of (price, start, end); one left join on item brings
    that array to each fact row and ``exists`` tests price and range. The
    grouped master is broadcast only under a measured size bound.

    Periods between ISO dates of items with more than ``max_periods`` periods
    do not enter that array: they are indexed (``period_index``), and two more
    joins bring a fact the stretches of its price and month. Without such an
    item there is no further join.
    """
    price_name = cols.price
    date_valid_col = date_valid_col or f"{cols.date}_validity"
    m = (master.select(F.col("Item").alias("__m_item"),
                       F.col("Price Per Unit").cast("double").alias("p"),
                       F.col("Start_date").cast("string").alias("s"),
                       F.col("End_date").cast("string").alias("e"))
               .where(F.col("__m_item").isNotNull()))
    x = S.as_number(df, price_name)
    d = F.col(cols.date).cast("string")
    many = m.groupBy("__m_item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_periods).select("__m_item")
    found, index = F.lit(False), None
    if not many.isEmpty():
        m = cut_lineage(m.join(many.withColumn("__many", F.lit(True)), "__m_item", "left"))
        by_month = F.coalesce("__many", F.lit(False))
        for c in ("s", "e"):
            by_month = by_month & F.coalesce(F.col(c).rlike(ISO_DATE) & F.try_to_date(c).isNotNull(), F.lit(False))
        index = [sized_broadcast(i, max_broadcast_bytes) for i in period_index(m.where(by_month))]
        m = m.where(~by_month)
    m = m.groupBy("__m_item").agg(F.collect_list(F.struct("p", "s", "e")).alias("__m_periods"))
    m = sized_broadcast(m, max_broadcast_bytes)
    joined = df.join(m, df[cols.item] == m["__m_item"], "left")
    if index is not None:
        joined = joined.withColumn("__x", x).join(
            index[0], (F.col(cols.item) == F.col("__x_item")) & (F.col("__x") == F.col("__x_price"))
            & (F.substring(d, 1, 7) == F.col("__m_month")), "left").join(
            index[1], (F.col(cols.item) == F.col("__y_item")) & (F.col("__x") == F.col("__y_price")), "left")
        for c in ("__m_stretches", "__m_long"):
            found = found | F.coalesce(F.exists(c, lambda r: (r["s"] <= d) & (d <= r["e"])), F.lit(False))
    in_master = F.exists(
        F.col("__m_periods"),
        lambda r: (r["p"] == x) & (r["s"] <= d) & (d <= r["e"]))
    verdict = (F.when(S.is_missing_value(df, price_name), _NULL_TEXT())
                .when(x.isNull() | (x <= 0), _FALSE())
                .when(F.col(cols.item).isNull() | F.col(cols.date).isNull()
                      | ~F.coalesce(F.col(date_valid_col), F.lit(False)), _CANT())
                .when(F.coalesce(in_master, F.lit(False)) | found, _TRUE())
                .otherwise(_FALSE()))
    return joined.select(*[F.col(c) for c in df.columns],
                         verdict.alias(f"{price_name}_validity"))


def total_rule(df: DataFrame, cols: Columns = REFERENCE_COLUMNS,
               tolerance: float | None = None) -> Column:
    """Q19: total equals price x quantity, exact by default.

    Missing total null; total not a number False; price or quantity missing,
    not a number, or a ``CANT CHECK`` verdict on either: ``CANT CHECK``.
    """
    t = S.as_number(df, cols.total)
    p = S.as_number(df, cols.price)
    q = S.as_number(df, cols.quantity)
    pv = f"{cols.price}_validity"
    qv = f"{cols.quantity}_validity"

    def verdict_is_cant(name):
        if name not in df.columns:
            return F.lit(False)
        return F.coalesce(F.col(name).cast("string") == F.lit(CANT_CHECK), F.lit(False))

    if tolerance is None:
        equal = t == p * q
    else:
        equal = F.abs(t - p * q) <= F.lit(tolerance)
    return (F.when(S.is_missing_value(df, cols.total), _NULL_TEXT())
             .when(t.isNull(), _FALSE())
             .when(S.is_missing_value(df, cols.price) | S.is_missing_value(df, cols.quantity), _CANT())
             .when(verdict_is_cant(pv) | verdict_is_cant(qv), _CANT())
             .when(p.isNull() | q.isNull(), _CANT())
             .when(F.coalesce(equal, F.lit(False)), _TRUE())
             .otherwise(_FALSE()))
