"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

All queries read the driver tables (through the retail view) so their work
grows with the data. Output columns carry explicit aliases that the DuckDB
oracles in ``ledgerlint.plans.oracles`` reproduce.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict

from pyspark.ml.feature import Imputer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions import scalars as S
from ledgerlint.operators import aggregates as G
from ledgerlint.operators import audit as A
from ledgerlint.operators import charts as CH
from ledgerlint.operators import completeness as C
from ledgerlint.operators import models as M
from ledgerlint.operators import profile as PF
from ledgerlint.operators import repair as RP
from ledgerlint.operators import reports as R
from ledgerlint.operators import stats as ST
from ledgerlint.operators import uniqueness as U
from ledgerlint.operators import validity as V
from ledgerlint.operators import weekly as W
from ledgerlint.operators.comoments import correlation_blocks
from ledgerlint.operators.neighbours import nearest_neighbours
from ledgerlint.operators.ordered import lags_leads
from ledgerlint.operators.sparse import level_slots, one_hot_cells, sparse_one_hot
from ledgerlint.schema import VIEW_COLUMNS as VC
from ledgerlint.schema import VIEW_RULES as VR
from ledgerlint.session import checkpoint_dir, cut_lineage, stored
from ledgerlint.sources import batches as B
from ledgerlint.sources import files as IO
from ledgerlint.sources import tables as TB
from ledgerlint.streaming import keyed_state as KS

KEYS = list(TB.ROW_ID_COLUMNS)
REGISTRY: "OrderedDict[str, callable]" = OrderedDict()

# Shares, percentages and statistics: operators give them in full precision,
# the registered queries to six places, so that engines agree.
TO_SIX_PLACES = re.compile(r"share|mean|std|median|r|avg_length|statistic|bucket_start|[pq]\d+|(.*_)?pct|.*repeat_purchases.*")


def register(name):
    def deco(fn):
        def run(spark, sf):
            out = fn(spark, sf)
            return _rounded(out, {c for c, t in out.dtypes if t == "double" and TO_SIX_PLACES.fullmatch(c)})
        REGISTRY[name] = run
        return fn
    return deco


def typed(spark, sf):
    return TB.retail_view(spark, sf)


def text(spark, sf):
    return TB.retail_text_view(spark, sf)


# ---------------------------------------------------------------- completeness
@register("missing_report")
def q_missing_report(spark, sf):
    return C.missing_report(typed(spark, sf), VC.all())


@register("completeness_flags")
def q_completeness_flags(spark, sf):
    v = typed(spark, sf)
    return C.add_completeness_flags(v, VC.all()).drop(*VC.all())


@register("blank_missing")
def q_blank_missing(spark, sf):
    return C.missing_report(text(spark, sf), VC.all(), blank_aware=True)


# ---------------------------------------------------------------- validity
def _rules_on_text(spark, sf, names):
    t = text(spark, sf)
    rules = V.simple_rules(VC, VR)
    picked = OrderedDict((k, rules[k]) for k in names)
    return V.add_validity_columns(t, picked).drop(*VC.all())


@register("regex_validity")
def q_regex_validity(spark, sf):
    return _rules_on_text(spark, sf, [VC.transaction_id, VC.customer_id])


@register("domain_validity")
def q_domain_validity(spark, sf):
    return _rules_on_text(spark, sf, [VC.category, VC.payment, VC.location, VC.discount])


@register("integer_validity")
def q_integer_validity(spark, sf):
    return _rules_on_text(spark, sf, [VC.quantity])


@register("float_validity")
def q_float_validity(spark, sf):
    t = text(spark, sf)
    return t.select(*KEYS, V.float_non_negative(t, VC.price).alias("price_validity"))


@register("date_validity")
def q_date_validity(spark, sf):
    return _rules_on_text(spark, sf, [VC.date])


@register("rule_set")
def q_rule_set(spark, sf):
    return _rules_on_text(spark, sf, list(V.simple_rules(VC, VR).keys()))


@register("item_validity")
def q_item_validity(spark, sf):
    t = text(spark, sf)
    return t.select(*KEYS, V.item_rule(t, VC, VR).alias("item_validity"))


def _price_checked(spark, sf):
    t = text(spark, sf)
    t = V.add_validity_columns(t, OrderedDict([(VC.date, V.DATETIME_FORMAT),
                                               (VC.quantity, V.INTEGER_NON_NEGATIVE)]))
    return V.price_rule_input(t, TB.view_price_master(spark, sf), VC)


@register("price_validity")
def q_price_validity(spark, sf):
    return _price_checked(spark, sf).select(*KEYS, "price_validity")


@register("total_validity")
def q_total_validity(spark, sf):
    p = _price_checked(spark, sf)
    return p.select(*KEYS, V.total_rule(p, VC).alias("total_spent_validity"))


@register("full_audit")
def q_full_audit(spark, sf):
    return A.audit(text(spark, sf), TB.view_price_master(spark, sf), VC, VR, order_cols=KEYS)


@register("audit_summary")
def q_audit_summary(spark, sf):
    audited = A.audit(text(spark, sf), TB.view_price_master(spark, sf), VC, VR, order_cols=KEYS, uniqueness=False)
    return A.verdict_counts(audited, VC)


# ---------------------------------------------------------------- uniqueness
@register("row_uniqueness")
def q_row_uniqueness(spark, sf):
    t = text(spark, sf)
    return A.add_uniqueness(t, KEYS, key_cols=VC.all()).select(*KEYS, "uniqueness_flag")


@register("duplicate_keys")
def q_duplicate_keys(spark, sf):
    return U.duplicate_keys(typed(spark, sf), VC.transaction_id)


@register("distinct_values")
def q_distinct_values(spark, sf):
    return U.distinct_values(typed(spark, sf), VC.customer_id)


@register("distinct_counts")
def q_distinct_counts(spark, sf):
    return U.distinct_counts(text(spark, sf), VC.all())


@register("distinct_combinations")
def q_distinct_combinations(spark, sf):
    return U.distinct_combinations(typed(spark, sf), [VC.item, VC.price, VC.discount])


@register("fd_violations")
def q_fd_violations(spark, sf):
    return U.fd_violations(typed(spark, sf), VC.item, VC.category)


@register("timeliness")
def q_timeliness(spark, sf):
    v = typed(spark, sf)
    d = S.strict_date(F.col(VC.date))
    return (v.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"))
             .select(F.col("first_date").cast("string").alias("first_date"),
                     F.col("last_date").cast("string").alias("last_date"),
                     (F.months_between("last_date", "first_date") >= 36).alias("has_three_years")))


# ---------------------------------------------------------------- reports
@register("format_report")
def q_format_report(spark, sf):
    return R.format_report(text(spark, sf), OrderedDict([
        (VC.item, VR.item_pattern), (VC.customer_id, "CUST_[0-9]{2}"),
        (VC.transaction_id, VR.transaction_pattern), (VC.date, VR.date_pattern)]))


@register("date_report")
def q_date_report(spark, sf):
    return R.date_report(text(spark, sf), [VC.date])


@register("positive_report")
def q_positive_report(spark, sf):
    return R.positive_report(text(spark, sf), [VC.price, VC.quantity, VC.total])


@register("domain_report")
def q_domain_report(spark, sf):
    return R.domain_report(text(spark, sf), OrderedDict([
        (VC.payment, VR.payment_methods), (VC.category, VR.categories),
        (VC.location, VR.locations)]))


@register("own_domain_report")
def q_own_domain_report(spark, sf):
    return R.own_domain_report(text(spark, sf), [VC.payment, VC.category, VC.location])


@register("price_master")
def q_price_master(spark, sf):
    return TB.price_master_from_facts(typed(spark, sf), VC.item, VC.price)




# ---------------------------------------------------------------- aggregates

NUMS = [VC.price, VC.quantity, VC.total]
TEXTS = [VC.transaction_id, VC.customer_id, VC.category, VC.item, VC.payment, VC.location]


def _rounded(df: DataFrame, names) -> DataFrame:
    if not names:
        return df
    return df.select(*[(S.round_double(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`"))
                       for c in df.columns])


@register("group_mean_median")
def q_group_mean_median(spark, sf):
    out = G.group_mean_median(typed(spark, sf), VC.item, VC.quantity)
    return _rounded(out, ["mean_value", "median_value"])


@register("first_item_by_price")
def q_first_item_by_price(spark, sf):
    return G.first_by_order(typed(spark, sf), VC.price, VC.item, KEYS)


@register("group_sizes")
def q_group_sizes(spark, sf):
    return G.group_sizes(typed(spark, sf), VC.transaction_id)


@register("value_shares")
def q_value_shares(spark, sf):
    return G.value_shares(typed(spark, sf), VC.payment)


@register("quantiles")
def q_quantiles(spark, sf):
    return G.quantiles(typed(spark, sf), NUMS)


@register("describe")
def q_describe(spark, sf):
    return G.describe(typed(spark, sf), NUMS)


@register("crosstab")
def q_crosstab(spark, sf):
    return G.crosstab(typed(spark, sf), VC.payment, VC.location, list(VR.locations)[::-1])


@register("correlation")
def q_correlation(spark, sf):
    return G.correlation_pairs(typed(spark, sf), NUMS)


@register("mode_median")
def q_mode_median(spark, sf):
    return G.mode_median(typed(spark, sf), [VC.quantity, VC.price])


@register("text_lengths")
def q_text_lengths(spark, sf):
    return G.text_lengths(text(spark, sf), TEXTS)


@register("column_info")
def q_column_info(spark, sf):
    return G.column_info(typed(spark, sf).drop(*KEYS))


@register("share_outside")
def q_share_outside(spark, sf):
    return G.share_outside(typed(spark, sf), VC.quantity, low=5.0, high=45.0)


# ---------------------------------------------------------------- repair
def _repair_steps(spark, sf, upto: int):
    v = typed(spark, sf)
    if upto >= 1:
        v = RP.fill_price(v, VC)
    if upto >= 2:
        v = RP.fill_item(v, KEYS, VC)
    if upto >= 3:
        v = RP.fill_by_group_mean(v, VC.item, VC.quantity)
    if upto >= 4:
        v = RP.recompute_total(v, VC)
    if upto >= 5:
        v = RP.fill_discount(v, VC)
    return v


@register("fill_price")
def q_fill_price(spark, sf):
    return _rounded(_repair_steps(spark, sf, 1).select(*KEYS, VC.price), [VC.price])


@register("fill_item")
def q_fill_item(spark, sf):
    return _repair_steps(spark, sf, 2).select(*KEYS, VC.item)


@register("fill_quantity")
def q_fill_quantity(spark, sf):
    return _rounded(_repair_steps(spark, sf, 3).select(*KEYS, VC.quantity), [VC.quantity])


@register("recompute_total")
def q_recompute_total(spark, sf):
    return _rounded(_repair_steps(spark, sf, 4).select(*KEYS, VC.total), [VC.total])


@register("fill_discount")
def q_fill_discount(spark, sf):
    return RP.fill_discount(typed(spark, sf), VC).select(*KEYS, VC.discount)


@register("full_repair")
def q_full_repair(spark, sf):
    return _rounded(RP.full_repair(typed(spark, sf), KEYS, VC), NUMS)


@register("impute_generic")
def q_impute_generic(spark, sf):
    return _rounded(RP.impute_generic(typed(spark, sf)), NUMS)


@register("cap_outliers")
def q_cap_outliers(spark, sf):
    out = RP.cap_outliers(typed(spark, sf).select(*KEYS, *NUMS), ignore=KEYS)
    return _rounded(out, NUMS)


@register("iqr_outliers")
def q_iqr_outliers(spark, sf):
    out = RP.iqr_outlier_rows(typed(spark, sf).select(*KEYS, VC.total), VC.total)
    return _rounded(out, [VC.total, "lower_bound", "upper_bound"])


@register("model_input_clean")
def q_model_input_clean(spark, sf):
    return RP.model_input_clean(typed(spark, sf).drop(VC.transaction_id, VC.customer_id),
                                target=VC.quantity, numeric=[VC.price, VC.total, VC.quantity],
                                categorical=[VC.category, VC.item, VC.payment, VC.location, VC.discount],
                                date_col=VC.date)


# ---------------------------------------------------------------- weekly
def _weekly(spark, sf):
    return W.weekly_aggregates(typed(spark, sf), VC)


@register("weekly_base")
def q_weekly_base(spark, sf):
    return _weekly(spark, sf).select(W.WEEK, *W.BASE_FEATURES)


@register("weekly_repeat_ratio")
def q_weekly_repeat_ratio(spark, sf):
    return _weekly(spark, sf).select(W.WEEK, "weekly_avg_repeat_purchases")


def _weekly_pivot(spark, sf, **others):
    """One pivot group, whatever its levels: the other two are left empty."""
    wk = W.weekly_aggregates(typed(spark, sf), VC, **others)
    return wk.drop(*W.BASE_FEATURES)


@register("weekly_category")
def q_weekly_category(spark, sf):
    return _weekly_pivot(spark, sf, payments=[], locations=[])


@register("weekly_payment")
def q_weekly_payment(spark, sf):
    return _weekly_pivot(spark, sf, categories=[], locations=[])


@register("weekly_location")
def q_weekly_location(spark, sf):
    return _weekly_pivot(spark, sf, categories=[], payments=[])


@register("weekly_lags")
def q_weekly_lags(spark, sf):
    return W.add_lags_leads(_weekly(spark, sf), 3, 0)


@register("weekly_leads")
def q_weekly_leads(spark, sf):
    out = W.add_lags_leads(_weekly(spark, sf), 0, 15)
    return out.select(W.WEEK, "total_sales", *[f"y_{i}" for i in range(1, 16)])


@register("item_week_lags")
def q_item_week_lags(spark, sf):
    """Weekly totals per item with three lags and two leads within the item."""
    v = typed(spark, sf)
    weeks = (v.select(VC.item, S.week_start(S.to_date_any(v, VC.date)).alias(W.WEEK), VC.total, VC.quantity)
              .where(F.col(W.WEEK).isNotNull()).groupBy(VC.item, W.WEEK)
              .agg(F.sum(VC.total).alias("total_sales"), F.sum(VC.quantity).alias("units")))
    return lags_leads(weeks, [VC.item], [W.WEEK], ["total_sales", "units"], 3, 2, "total_sales")


@register("weekly_features")
def q_weekly_features(spark, sf):
    return W.weekly_features(typed(spark, sf), VC, n_past_week=30, n_future_week=15)


@register("weekly_range")
def q_weekly_range(spark, sf):
    return W.weekly_features(typed(spark, sf), VC, n_past_week=6, n_future_week=1,
                             start_date="1996-01-01", end_date="2000-12")


# ---------------------------------------------------------------- projections / filters


@register("negative_rows")
def q_negative_rows(spark, sf):
    t = text(spark, sf)
    q, p = S.as_number(t, VC.quantity), S.as_number(t, VC.price)
    return t.where((q < 0) | (p < 0)).select(*KEYS, VC.quantity, VC.price)


@register("co_missing")
def q_co_missing(spark, sf):
    return C.co_missing(typed(spark, sf), VC.price, VC.all())


@register("equality_distinct")
def q_equality_distinct(spark, sf):
    return typed(spark, sf).where(F.col(VC.price) == 8.0).select(VC.item).distinct()


@register("numeric_coerce")
def q_numeric_coerce(spark, sf):
    t = text(spark, sf).select(*KEYS, VC.price, VC.total)
    return RP.coerce_numeric(t, [VC.price, VC.total])


@register("bool_normalise")
def q_bool_normalise(spark, sf):
    t = text(spark, sf)
    return t.select(*KEYS, S.text_to_flag(F.col(VC.discount)).alias(VC.discount))


@register("null_drop")
def q_null_drop(spark, sf):
    return typed(spark, sf).na.drop(subset=[VC.quantity]).select(*KEYS, VC.quantity)


# ---------------------------------------------------------------- scalar functions
@register("scalar_functions")
def q_scalar_functions(spark, sf):
    t = text(spark, sf)
    d = S.strict_date(F.col(VC.date))
    q = S.as_number(t, VC.quantity)
    p = S.as_number(t, VC.price)
    tot = S.as_number(t, VC.total)
    return t.select(
        *KEYS,
        F.coalesce(S.full_match(F.col(VC.item), "Item_[0-9]+_[A-Z]+"), F.lit(False)).alias("f_full_match"),
        S.is_blank(F.col(VC.location)).alias("f_blank"),
        S.text_length(F.col(VC.price)).alias("f_length"),
        S.week_start(d).alias("f_week"),
        S.day_name(d).alias("f_day_name"),
        F.dayofmonth(d).alias("f_day"),
        d.cast("string").alias("f_date"),
        F.year(d).alias("f_year"), F.month(d).alias("f_month"),
        S.is_whole(q).alias("f_whole"),
        S.round_double(S.safe_divide(tot, q)).alias("f_divide"),
        S.round_double(p * q).alias("f_multiply"),
        F.coalesce(F.col(VC.discount), F.lit("False")).alias("f_fill"),
        F.col(VC.payment).isin(list(VR.payment_methods)).alias("f_member"),
        F.when(q > 40, F.lit(40.0)).otherwise(q).alias("f_clamp"),
        (F.col(VC.date) <= F.lit("1998-12-31")).alias("f_text_compare"),
        S.round_double(S.percent(q, F.lit(50.0))).alias("f_percent"),
        F.round(p, 0).alias("f_round"),
        S.map_lookup(VR.abbreviation_map(), F.col(VC.category)).alias("f_lookup"),
        S.is_number(t, VC.price).alias("f_is_number"),
    )


# ---------------------------------------------------------------- sorts, limits, unions
@register("sorted_first_rows")
def q_sorted_first_rows(spark, sf):
    v = typed(spark, sf)
    return (v.orderBy(F.col(VC.customer_id).asc_nulls_last(), *KEYS).limit(5)
             .select(*KEYS, VC.customer_id, VC.total))


@register("best_row")
def q_best_row(spark, sf):
    v = typed(spark, sf)
    return (v.orderBy(F.col(VC.total).desc_nulls_last(), *KEYS).limit(1)
             .select(*KEYS, VC.item, VC.total))


def _capped(spark, sf):
    v = typed(spark, sf).select(*KEYS, *NUMS)
    return v, RP.cap_outliers(v, ignore=KEYS)


@register("union_tagged")
def q_union_tagged(spark, sf):
    before, after = _capped(spark, sf)
    return _rounded(CH.tagged_union(before, after, KEYS + [VC.total]), [VC.total])


# ---------------------------------------------------------------- profiling
@register("column_roles")
def q_column_roles(spark, sf):
    return PF.column_roles_table(typed(spark, sf).drop(*KEYS), target=VC.discount)


@register("column_profile")
def q_column_profile(spark, sf):
    return PF.column_profile(typed(spark, sf), VC.all())


@register("variable_types")
def q_variable_types(spark, sf):
    return PF.column_profile(typed(spark, sf), VC.all()).select("column", "variable_type")


@register("sample_values")
def q_sample_values(spark, sf):
    return PF.sample_values(typed(spark, sf), VC.all())


@register("discount_by_day")
def q_discount_by_day(spark, sf):
    return PF.discount_by_day(typed(spark, sf), VC.date, VC.discount)


# ---------------------------------------------------------------- streams, run to their end
def _stream_of(spark, sf, table):
    # a glob, as a plain path of a stream must be a folder and a table may be one file
    path = f"{sf.rstrip('/')}/{table}.parque"
    return spark.readStream.schema(spark.read.parquet(f"{path}t").schema).parquet(f"{path}[t]")


def _stream_folder(spark):
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@register("stream_first_rows")
def q_stream_first_rows(spark, sf):
    """Each event with the flag of its user's first of its type."""
    rows = _stream_of(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    out = KS.run_available(KS.flag_first_stream(rows, ["user_id", "event_type"], "ts", "event_id"), _stream_folder(spark))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_repeat_ratio")
def q_stream_repeat_ratio(spark, sf):
    out = KS.repeat_ratio(KS.run_available(
        KS.weekly_customers_stream(_stream_of(spark, sf, "events"), "ts", "user_id"), _stream_folder(spark)))
    return out.withColumn("repeat_ratio", F.round("repeat_ratio", 6))


# ---------------------------------------------------------------- statistics
CATS4 = [VC.category, VC.payment, VC.location, VC.item]


@register("one_hot")
def q_one_hot(spark, sf):
    v = typed(spark, sf)
    return ST.one_hot(v, [VC.payment, VC.location], KEYS + [VC.price, VC.quantity], VC.discount)


@register("one_hot_sparse")
def q_one_hot_sparse(spark, sf):
    columns = [VC.customer_id, VC.item, VC.location]
    v = stored(typed(spark, sf).select(*KEYS, *columns, VC.discount))  # levels and rows read it
    encoded = sparse_one_hot(v, columns, level_slots(v, columns), KEYS, VC.discount)
    return one_hot_cells(encoded, KEYS)


@register("chi_square")
def q_chi_square(spark, sf):
    return ST.chi_square_statistics(typed(spark, sf), CATS4, VC.discount)


@register("chi_square_pvalues")
def q_chi_square_pvalues(spark, sf):
    return ST.chi_square_test(typed(spark, sf), CATS4, VC.discount)


@register("correlation_pairs")
def q_correlation_pairs(spark, sf):
    v = typed(spark, sf).withColumn(VC.discount, F.col(VC.discount).cast("double"))
    return G.correlation_pairs(v, NUMS + [VC.discount])


@register("weekly_correlation")
def q_weekly_correlation(spark, sf):
    """G12 over every numeric column of the weekly feature table, lags and
    leads included: hundreds of columns, all pairs. The repeat ratio enters
    with six places, as its own query gives it."""
    wk = W.add_lags_leads(_rounded(_weekly(spark, sf), ["weekly_avg_repeat_purchases"]), 30, 15)
    columns = sorted(c for c in wk.columns if c != W.WEEK)
    return correlation_blocks(wk, columns).withColumn("r", F.round("r", 6))


@register("scale")
def q_scale(spark, sf):
    v = typed(spark, sf).select(*KEYS, *NUMS)
    return _rounded(ST.standardize(v, NUMS), NUMS)


# ---------------------------------------------------------------- chart tables
@register("missing_bars")
def q_missing_bars(spark, sf):
    return CH.missing_bars(typed(spark, sf), VC.all())


@register("box_summary")
def q_box_summary(spark, sf):
    return CH.box_summary(typed(spark, sf), NUMS)


@register("histogram")
def q_histogram(spark, sf):
    return CH.histogram(typed(spark, sf), NUMS, bins=10)


@register("category_counts")
def q_category_counts(spark, sf):
    return CH.category_counts(typed(spark, sf), [VC.category, VC.payment, VC.location])


@register("class_histogram")
def q_class_histogram(spark, sf):
    return CH.histogram(typed(spark, sf), [VC.quantity, VC.total], bins=10, by=VC.discount)


@register("class_counts")
def q_class_counts(spark, sf):
    return CH.category_counts(typed(spark, sf), [VC.category, VC.payment, VC.location], by=VC.discount)


@register("status_share")
def q_status_share(spark, sf):
    return CH.class_counts(typed(spark, sf), VC.discount)


@register("before_after_box")
def q_before_after_box(spark, sf):
    before, after = _capped(spark, sf)
    return CH.before_after_box(before, after, [VC.total])


# ---------------------------------------------------------------- sources and sinks


def weekly_target_columns(weekly: DataFrame) -> tuple[list, list]:
    """The fixed weekly target's column rule: key, current features, 30 lags
    of the repeat ratio and of total sales, 2 lags of unique transactions."""
    feats = [c for c in weekly.columns if c != W.WEEK]
    cols = ([W.WEEK] + feats + [f"weekly_avg_repeat_purchases_t-{i}" for i in range(1, 31)]
            + [f"total_sales_t-{i}" for i in range(1, 31)] + ["unique_transactions_t-1", "unique_transactions_t-2"])
    pivots = [c for c in feats if c not in W.BASE_FEATURES and c not in VR.categories]
    ints = ["unique_transactions", "unique_customers", "discounted_transactions"] + pivots
    return cols, ints


@register("schema_fit")
def q_schema_fit(spark, sf):
    wk = _weekly(spark, sf)
    cols, ints = weekly_target_columns(wk)
    feats = W.add_lags_leads(wk, 30, 0, features=["weekly_avg_repeat_purchases", "total_sales",
                                                  "unique_transactions"])
    return W.fit_target(feats, cols, ints)


def _target_constraints(t):
    return {
        "missing transaction id": F.col(VC.transaction_id).isNotNull(),
        "price not a number": F.col(VC.price).isNull() | S.is_number(t, VC.price),
        "quantity not a number": F.col(VC.quantity).isNull() | S.is_number(t, VC.quantity),
        "total not a number": F.col(VC.total).isNull() | S.is_number(t, VC.total),
        "date not a date": F.col(VC.date).isNull() | S.strict_date(F.col(VC.date)).isNotNull(),
    }


@register("good_reject_split")
def q_good_reject_split(spark, sf):
    t = text(spark, sf)
    good, bad = IO.good_reject_split(t, _target_constraints(t))
    g = good.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("good").alias("outcome"),
                                                           F.lit("").alias("reason"), "n_rows")
    b = (bad.select(F.explode("reject_reasons").alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit("rejected").alias("outcome"), "reason", "n_rows"))
    return g.unionByName(b)


#: The target of the batched insert: columns, types and which are required.
INSERT_TARGET = T.StructType([
    T.StructField(VC.transaction_id, T.StringType(), False), T.StructField(VC.customer_id, T.StringType(), False),
    T.StructField(VC.item, T.StringType(), True), T.StructField(VC.price, T.DoubleType(), False),
    T.StructField(VC.quantity, T.LongType(), True), T.StructField(VC.date, T.DateType(), False)])


@register("batched_insert")
def q_batched_insert(spark, sf):
    """The rows inserted five at a time into a typed table with a
    key, failing batches row by row; the writer's counts and what the written
    tables hold."""
    path = IO.scratch_path(spark, "insert")
    counts = B.write_in_batches(typed(spark, sf).select(*INSERT_TARGET.names), path, INSERT_TARGET, batch=5, key=VC.transaction_id)
    told = spark.createDataFrame([("good", "", counts["good"])] + [("failed", r, n) for r, n in counts["failed"].items()],
                                 "outcome string, reason string, n_rows long")
    kept = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(VC.transaction_id).alias("k")).first()
    stored = spark.createDataFrame([("stored", "rows", kept["n"]), ("stored", "keys", kept["k"])], told.schema)
    bad = spark.read.parquet(f"{path}/rejects").groupBy(F.lit("rejects").alias("outcome"), F.col(B.REASON).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    return told.unionByName(stored).unionByName(bad)


@register("paged_scan")
def q_paged_scan(spark, sf):
    """The view stored as pages of 1,000 rows, then read page by page until
    one is empty."""
    v = typed(spark, sf).select(*KEYS[:2], VC.transaction_id, VC.item, VC.price, VC.quantity)
    path = IO.scratch_path(spark, "pages")
    B.write_pages(v, path, 1000)
    return B.read_pages(spark, path, v.schema)


@register("json_rows")
def q_json_rows(spark, sf):
    v = typed(spark, sf)
    return IO.json_rows(v, [VC.transaction_id, VC.customer_id, VC.item, VC.price, VC.quantity,
                            VC.discount])


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    t = text(spark, sf).drop(*KEYS)
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(t, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in VC.all()])
    return IO.read_csv(spark, path, schema=schema)


@register("check_after_write")
def q_check_after_write(spark, sf):
    out = q_schema_fit(spark, sf)
    path = IO.scratch_path(spark, "weekly")
    out.write.mode("overwrite").parquet(path)
    n, first = IO.check_after_write(spark, path, order_by=[W.WEEK])
    return first.select(F.lit(n).alias("rows_written"), W.WEEK, "total_sales")


# ---------------------------------------------------------------- models

MODEL_NUM = [VC.price, VC.quantity, VC.total]
MODEL_CAT = [VC.category, VC.payment, VC.location]


def _class_input(spark, sf):
    return typed(spark, sf).where(F.col(VC.discount).isNotNull()) \
                           .withColumn(VC.discount, F.col(VC.discount).cast("double"))


def _quantity_rows(spark, sf):
    return typed(spark, sf).select(*KEYS, VC.quantity, VC.price, VC.total, *MODEL_CAT)


@register("date_features")
def q_date_features(spark, sf):
    return M.add_date_features(typed(spark, sf).select(*KEYS, VC.date), VC.date)


@register("impute_mean_mode")
def q_impute_mean_mode(spark, sf):
    v = stored(typed(spark, sf).select(*KEYS, *MODEL_NUM, *MODEL_CAT))  # means, modes and the output read it
    imp = Imputer(inputCols=MODEL_NUM, outputCols=MODEL_NUM, strategy="mean").fit(v).transform(v)
    return _rounded(M.impute_mode(imp, MODEL_CAT), MODEL_NUM)


@register("stratified_folds")
def q_stratified_folds(spark, sf):
    v = _class_input(spark, sf).select(*KEYS, VC.discount)
    folds = M.stratified_folds(v, VC.discount, k=5, seed=42, id_cols=KEYS)
    return folds.groupBy(VC.discount, "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("rebalance")
def q_rebalance(spark, sf):
    data = M.prepare(_class_input(spark, sf), VC.discount, MODEL_NUM, MODEL_CAT)
    out = M.rebalance(data.select("features", VC.discount), VC.discount)
    return out.groupBy(VC.discount).agg(F.count(F.lit(1)).alias("n_rows"))


@register("nearest_rows")
def q_nearest_rows(spark, sf):
    """E8's neighbours: the five customers nearest to each in six whole
    numbers, one customer for each distinct point."""
    lines = TB.read_table(spark, sf, "lineitem").join(
        TB.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    totals = lines.groupBy("o_custkey").agg(
        F.count(F.lit(1)), F.sum(F.floor("l_quantity")), F.sum(F.col("l_linenumber").cast("long")),
        F.max(F.floor("l_quantity")), F.countDistinct("l_suppkey"), F.sum(F.floor(F.col("l_discount") * 100 + 0.5)))
    points = totals.groupBy(F.array(*[F.col(f"`{c}`").cast("double") for c in totals.columns[1:]]).alias("a")) \
        .agg(F.min("o_custkey").cast("long").alias("id"))
    near = nearest_neighbours(cut_lineage(points), k=5)
    return near.select(F.col("id").alias("custkey"), F.posexplode(F.arrays_zip("near_ids", "near_d2")).alias("i", "n")) \
        .select("custkey", (F.col("i") + 1).alias("place"), F.col("n.near_ids").alias("near_custkey"),
                F.col("n.near_d2").cast("long").alias("squared_distance"))


@register("select_model")
def q_select_model(spark, sf):
    """M3: six candidates, rebalanced inside the folds."""
    return M.select_model(_class_input(spark, sf), VC.discount, M.default_classifiers(VC.discount),
                          MODEL_NUM, MODEL_CAT, metric="auc")["scores"]


@register("grid_rmse")
def q_grid_rmse(spark, sf):
    r = M.grid_rmse(_quantity_rows(spark, sf), LinearRegression(featuresCol="features", labelCol=VC.quantity),
                    {"regParam": [0.0, 0.1]}, VC.quantity, [VC.price, VC.total], MODEL_CAT)
    return spark.createDataFrame([(r["best_score"], r["best_params"])], "best_score double, best_params string")


@register("compare_regressors")
def q_compare_regressors(spark, sf):
    models = {"lr": LinearRegression(featuresCol="features", labelCol=VC.quantity),
              "dt": DecisionTreeRegressor(featuresCol="features", labelCol=VC.quantity, seed=42)}
    params = {"lr": {"regParam": [0.0, 0.1]}, "dt": {"maxDepth": [3, 5]}}
    return M.compare_regressors(_quantity_rows(spark, sf), models, params, VC.quantity, [VC.price, VC.total], MODEL_CAT) \
        .drop("fit_time", "score_time")


@register("forest_importance")
def q_forest_importance(spark, sf):
    v = M.add_date_features(typed(spark, sf).drop(*KEYS, VC.transaction_id, VC.customer_id), VC.date)
    num = [VC.price, VC.total, f"{VC.date}_year", f"{VC.date}_month", f"{VC.date}_day"]
    return M.forest_importance(v, VC.quantity, num, MODEL_CAT + [VC.item])


@register("compare_by_recall")
def q_compare_by_recall(spark, sf):
    return M.compare_by_recall(_class_input(spark, sf), VC.discount, MODEL_NUM, MODEL_CAT)["scores"]


# ---------------------------------------------------------------- more row outputs and sinks
@register("positive_rows")
def q_positive_rows(spark, sf):
    t = text(spark, sf).select(*KEYS, VC.price)
    return R.positive_rows(t, VC.price)["flagged"].select(*KEYS, VC.price, "kind")


@register("domain_rows")
def q_domain_rows(spark, sf):
    t = text(spark, sf)
    return R.domain_rows(t, VC.payment, VR.payment_methods)


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    v = typed(spark, sf).withColumn(VC.discount, F.col(VC.discount).cast("double"))
    return _rounded(CH.correlation_heatmap(v.select(*NUMS, VC.discount), VC.discount),
                    NUMS + [VC.discount])


@register("inf_to_null")
def q_inf_to_null(spark, sf):
    v = typed(spark, sf)
    grown = S.finite_or_null(F.exp(F.col(VC.total)))
    return v.select(*KEYS, (grown.isNull() & F.col(VC.total).isNotNull()).alias("overflowed"))


@register("limited_scan")
def q_limited_scan(spark, sf):
    """S3: the first n rows of the table in key order (the limit is the feature)."""
    return typed(spark, sf).orderBy(*KEYS).limit(100).select(*KEYS, VC.transaction_id)


@register("target_column_diff")
def q_target_column_diff(spark, sf):
    wk = _weekly(spark, sf)
    cols, _ = weekly_target_columns(wk)
    return IO.column_diff(cols, W.add_lags_leads(wk, 1, 1))


@register("target_ddl")
def q_target_ddl(spark, sf):
    wk = W.add_lags_leads(_weekly(spark, sf), 2, 1)
    typed_ddl = IO.ddl_for(wk, "weekly_sales_data", W.WEEK, weekly_target_columns(wk)[1])
    float_ddl = IO.ddl_for(wk, "weekly_sales_data", W.WEEK, all_float=True)
    return spark.createDataFrame([("typed", typed_ddl), ("all_float", float_ddl)], "kind string, ddl string")


@register("select_model_f2")
def q_select_model_f2(spark, sf):
    """M9: the earlier selection variant scored by F2 (recall-weighted)."""
    return M.select_model(_class_input(spark, sf), VC.discount, M.default_classifiers(VC.discount),
                          MODEL_NUM, MODEL_CAT, metric="f2", grid_on="balanced")["scores"]


def queries() -> "OrderedDict[str, callable]":
    return REGISTRY
