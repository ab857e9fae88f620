"""The reference operators' queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import cleaning as cl
from sieveline.functions.criteria import CRITERIA, with_any_risk, with_criteria
from sieveline.operators import curves, evolve, governance, learn, metrics, pareto, prepare, profile, ranking, resampling, statistics, validation
from sieveline.plans import sql as q
from sieveline.sources import fixtures as fx
from sieveline.sources import readers, writers
from sieveline.sources.readers import table
from sieveline.sources.shared import new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ST = ["strategy", "target"]
CONFIG = ["normalization", "weighting", "method"]


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return put


# ---- inputs shared by many queries


def criteria_rows(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Stored: statistics, weights and scores each read these rows again, and what they are made from is five joins."""
    df = with_any_risk(with_criteria(fx.predictions(spark, sf_dir)))
    return stored(df.where(F.col("split") == split) if split else df, "criteria")


def _val_and_test(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = with_any_risk(with_criteria(fx.predictions(spark, sf_dir)))
    known = stored(df.where("split <> 'train'"), "criteria")
    return known.where("split = 'val'"), known.where("split = 'test'")


def _equally_scored(val: DataFrame, test: DataFrame, method: str) -> DataFrame:
    rows = ranking.normalized(test, val, ["minmax"])
    return ranking.scored(rows, ranking.weights(rows, ["normalization"], ["equal"]), ["normalization"], [method])


def _test_scores(spark, sf_dir, method="topsis") -> DataFrame:
    """Test rows scored with equal weights on min-max criteria, fitted on validation rows."""
    return _equally_scored(*_val_and_test(spark, sf_dir), method)


def _wide(spark, sf_dir) -> DataFrame:
    val, test = _val_and_test(spark, sf_dir)
    scores = _equally_scored(val, test, "topsis").select("sample_row_id", F.col("score").alias("topsis"))
    return stored(test.join(scores, "sample_row_id"), "wide")


def _long(spark, sf_dir) -> DataFrame:
    named = {"raw": F.col("p_cri_high"), "baseline": F.col("topsis"), "consensus": F.col("risk_consensus_mean")}
    return validation.strategies(_wide(spark, sf_dir), named, ("y_cri_high", "y_any_risk"))


def _rounded(df: DataFrame, columns, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- profiles and governance


@query(q.ask(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END) / {q.d('count(*)')}, 9) AS missing_rate FROM lots"
    for c in ("procedure_type", "supply_type", "buyer_type", "lot_bidscount", "cpv_code", *q.S))))
def profile_missingness(spark, sf_dir):
    return profile.missingness(fx.lots(spark, sf_dir).select("procedure_type", "supply_type", "buyer_type", "lot_bidscount", "cpv_code", *fx.SCORES))


_CATS = ("procedure_type", "supply_type", "buyer_type", "buyer_country", "cpv_code", "cpv_group")


@query(q.ask(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lots" for c in _CATS)))
def profile_cardinality(spark, sf_dir):
    return profile.cardinality(fx.lots(spark, sf_dir), _CATS)


_NUMS = ("lot_bidscount", "label_corr_proc", "label_corr_buyer_concentration", "label_cri")


@query(q.ask(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, CAST(sum(CAST({c} >= (SELECT quantile_cont({c}, 0.75) FROM lots) AS INT)) AS BIGINT) AS at_least_p75 FROM lots"
    for c in _NUMS)))
def profile_quantiles(spark, sf_dir):
    return profile.quantiles(stored(fx.lots(spark, sf_dir), "lots"), _NUMS)


@query(q.ask("SELECT \"column\", value, n AS rows, round(n / sum(n) OVER (PARTITION BY \"column\"), 9) AS share, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value NULLS LAST) AS place FROM ("
             + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM lots GROUP BY 2" for c in ("procedure_type", "cpv_group"))
             + ") QUALIFY place <= 8"))
def category_top_n(spark, sf_dir):
    return profile.top_categories(fx.lots(spark, sf_dir), ("procedure_type", "cpv_group"), 8)


@query(q.ask(" UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'binary' AS kind, count({c}) AS labelled, CAST(sum(CAST({c} > 0 AS INT)) AS BIGINT) AS positives FROM lots" for c in ("label_corr_singleb", "label_corr_nocft")]
    + [f"SELECT '{c}', 'numeric', count({c}), CAST(sum(CAST({c} >= (SELECT quantile_cont({c}, 0.75) FROM lots) AS INT)) AS BIGINT) FROM lots" for c in ("label_corr_proc", "label_corr_buyer_concentration")])))
def label_feasibility(spark, sf_dir):
    return profile.label_feasibility(stored(fx.lots(spark, sf_dir), "lots"), ("label_corr_singleb", "label_corr_nocft"), ("label_corr_proc", "label_corr_buyer_concentration"))


@query(q.ask("SELECT CAST(y_cri_high AS INT) AS y_cri_high, CAST(least(floor(round(p_cri_high * 30, 9)), 29) AS INT) AS bin, count(*) AS rows FROM preds GROUP BY 1, 2"))
def score_histogram(spark, sf_dir):
    return profile.histogram(fx.predictions(spark, sf_dir), "p_cri_high", "y_cri_high", 30)


@query(q.ask("""SELECT 'procedure_type' AS "column", round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS total_variation FROM
  (SELECT procedure_type AS v, count(*) / CAST((SELECT count(*) FROM marked WHERE split = 'train') AS DOUBLE) AS p FROM marked WHERE split = 'train' GROUP BY 1) a
  FULL JOIN (SELECT procedure_type AS v, count(*) / CAST((SELECT count(*) FROM marked WHERE split = 'test') AS DOUBLE) AS q FROM marked WHERE split = 'test' GROUP BY 1) b USING (v)"""))
def total_variation(spark, sf_dir):
    lot = fx.with_targets(fx.lots(spark, sf_dir))
    return profile.total_variation(lot.where("split = 'train'"), lot.where("split = 'test'"), "procedure_type")


@query(q.ask("""SELECT count(*) AS lots, round(avg(CASE WHEN lot_bidscount > 1 THEN 1.0 ELSE 0 END), 9) AS share_over_one, round(avg(CASE WHEN lot_bidscount >= 5 THEN 1.0 ELSE 0 END), 9) AS share_five_or_more,
  quantile_cont(lot_bidscount, 0.5) AS median_bids, quantile_cont(lot_bidscount, 0.99) AS p99_bids, min(award_year) AS first_year, max(award_year) AS last_year,
  round(avg(CASE WHEN award_year BETWEEN 1996 AND 1998 THEN 1.0 ELSE 0 END), 9) AS share_1996_1998 FROM lots"""))
def dataset_composition(spark, sf_dir):
    return profile.composition(stored(fx.lots(spark, sf_dir), "lots"))


_RAW = ("tender_id", "lot_bidscount", "bid_priceUsd", "bid_price", "corr_singleb", "cri", "buyer_country", "tender_year", "filter_ok", "bid_priceCurrency", "tender_proceduretype", "lot_title", "tender_cpvs", "corr_proc", "tender_awarddecisiondate", "buyer_phone", "tender_contractduration", "CRI")
_PROCESSED = ("lot_id", "client_group", "federated_site", "trace_hash", "label_cri", "log_bid_price", "reported_bid_count", "buyer_type", "row_id", "y_award_year", "client_city_id", "ID")
_MANIFEST = (
    ("lot_bidscount", "feature", "numeric", True), ("award_criteria_count", "feature", "numeric", True), ("buyer_type", "feature", "categorical", True), ("buyer_country", "feature", "categorical", True),
    ("label_cri", "target", "risk outcome", False), ("y_cri_high", "target", "numeric", False), ("procedure_type", "feature", "categorical", True), ("award_year", "feature", "numeric", True), ("cpv_code", "feature", "categorical", False),
)
_STRICT = ("award_criteria_count", "buyer_type", "procedure_type")


def _rows_sql(columns: str, rows) -> str:
    """Rows worked out by hand."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, str) else str(x).lower() for x in r) + ')' for r in rows)}) AS t({columns})"


_OUT, _FREE = "exclude from model features", "no automatic exclusion"


@query(_rows_sql('"column", decision, reasons', (
    ("tender_id", _OUT, "identifier or contact field"), ("lot_bidscount", _OUT, "identifier or contact field"), ("bid_priceUsd", _OUT, "identifier or contact field"), ("bid_price", _OUT, "identifier or contact field"),
    ("corr_singleb", _OUT, "target or validation label"), ("cri", _OUT, "target or validation label"), ("buyer_country", _OUT, "geographic variable"), ("tender_year", _OUT, "temporal variable"),
    ("filter_ok", _OUT, "filter or derived screening field"), ("bid_priceCurrency", _OUT, "currency proxy; identifier or contact field"), ("tender_proceduretype", "candidate feature after preprocessing", _FREE),
    ("lot_title", "candidate feature after preprocessing", _FREE), ("tender_cpvs", "candidate feature after preprocessing", _FREE), ("corr_proc", _OUT, "target or validation label"),
    ("tender_awarddecisiondate", _OUT, "temporal variable"), ("buyer_phone", _OUT, "identifier or contact field"), ("tender_contractduration", _OUT, "temporal variable"), ("CRI", "candidate feature after preprocessing", _FREE),
)))
def column_governance_raw(spark, sf_dir):
    return governance.raw_columns(spark.createDataFrame([(n,) for n in _RAW], "column string"))


@query(_rows_sql('"column", decision, reasons', (
    ("lot_id", _OUT, "trace or identifier field"), ("client_group", _OUT, "federated grouping field"), ("federated_site", _OUT, "federated grouping field"), ("trace_hash", _OUT, "trace or identifier field"),
    ("label_cri", _OUT, "label or evaluation target"), ("log_bid_price", "candidate model feature", _FREE), ("reported_bid_count", "candidate model feature", _FREE), ("buyer_type", "candidate model feature", _FREE),
    ("row_id", _OUT, "trace or identifier field"), ("y_award_year", _OUT, "label or evaluation target; temporal variable"), ("client_city_id", _OUT, "federated grouping field; geographic variable; trace or identifier field"), ("ID", _OUT, "trace or identifier field"),
)))
def column_governance_processed(spark, sf_dir):
    return governance.processed_columns(spark.createDataFrame([(n,) for n in _PROCESSED], "column string"))


@query(_rows_sql('"column", forbidden, reasons', (
    ("tender_id", False, ""), ("lot_bidscount", False, ""), ("bid_priceUsd", False, ""), ("bid_price", False, ""), ("corr_singleb", True, "raw label source"), ("cri", True, "raw label source"), ("buyer_country", True, "geographic"),
    ("tender_year", True, "temporal"), ("filter_ok", False, ""), ("bid_priceCurrency", False, ""), ("tender_proceduretype", False, ""), ("lot_title", False, ""), ("tender_cpvs", False, ""), ("corr_proc", True, "raw label source"),
    ("tender_awarddecisiondate", True, "temporal"), ("buyer_phone", True, "identifier or grouping"), ("tender_contractduration", True, "temporal"), ("CRI", False, ""),
)))
def forbidden_features(spark, sf_dir):
    return governance.forbidden_features(spark.createDataFrame([(n,) for n in _RAW], "column string"))


def _manifest(spark):
    return spark.createDataFrame([*_MANIFEST], "column string, role string, type string, used_as_feature boolean")


_MANIFEST_SQL = 'm("column", role, type, used) AS (VALUES ' + ", ".join(f"('{a}', '{b}', '{c}', {str(u).lower()})" for a, b, c, u in _MANIFEST) + ")"


@query(_rows_sql('"column", type, audit_priority, strict_ex_ante, exclusion_reason', (
    ("lot_bidscount", "numeric", True, False, ""), ("award_criteria_count", "numeric", True, True, ""), ("buyer_type", "categorical", True, True, ""), ("buyer_country", "categorical", False, False, "geographic"),
    ("label_cri", "risk outcome", False, False, "target"), ("y_cri_high", "numeric", False, False, "target"), ("procedure_type", "categorical", True, True, ""), ("award_year", "numeric", False, False, "temporal"), ("cpv_code", "categorical", False, False, ""),
)))
def feature_sets(spark, sf_dir):
    return governance.feature_sets(_manifest(spark), _STRICT)


@query(f"""WITH {_MANIFEST_SQL} SELECT "column", CASE WHEN contains(lower(type), 'numeric') OR contains(lower(type), 'risk outcome') OR starts_with("column", 'label_') OR starts_with("column", 'y_') THEN 'numeric' ELSE 'categorical' END AS kind FROM m""")
def inferred_types(spark, sf_dir):
    return governance.inferred_types(_manifest(spark))


# ---- cleaning, targets, splits, encoding

_RAW_TEXT = "raw AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN 'n/a' ELSE '  ' || CAST(event_id % 1000 AS VARCHAR) || ' ' END AS amount, CASE WHEN event_id % 6 = 0 THEN ' Yes ' WHEN event_id % 6 = 1 THEN 'TRUE' WHEN event_id % 6 = 2 THEN '1.0' WHEN event_id % 6 = 3 THEN 'no' WHEN event_id % 6 = 4 THEN NULL ELSE '0' END AS flag FROM events)"


def _raw_text(spark, sf_dir):
    n = F.col("event_id")
    amount = F.when(n % 7 == 0, "  ").when(n % 5 == 0, "n/a").otherwise(F.concat(F.lit("  "), (n % 1000).cast("string"), F.lit(" ")))
    flag = F.when(n % 6 == 0, " Yes ").when(n % 6 == 1, "TRUE").when(n % 6 == 2, "1.0").when(n % 6 == 3, "no").when(n % 6 == 4, None).otherwise("0")
    return table(spark, sf_dir, "events", ["event_id"]).select("event_id", amount.alias("amount"), flag.alias("flag"))


@query(f"WITH {_RAW_TEXT} SELECT event_id, CAST(try_cast(trim(amount) AS FLOAT) AS DOUBLE) AS number, nullif(trim(amount), '') AS text FROM raw")
def clean_types(spark, sf_dir):
    return _raw_text(spark, sf_dir).select("event_id", cl.to_float("amount").cast("double").alias("number"), cl.trimmed("amount").alias("text"))


@query(f"WITH {_RAW_TEXT} SELECT event_id, coalesce(lower(trim(flag)) IN ('1', '1.0', 'true', 't', 'yes', 'y'), false) AS flag FROM raw")
def truthy_parse(spark, sf_dir):
    return _raw_text(spark, sf_dir).select("event_id", cl.truthy("flag").alias("flag"))


@query(q.ask("""SELECT lot_id, count(*) AS reported_bid_count, count(DISTINCT bidder) AS bidder_count, min(part) AS first_part, CAST(sum(percent) AS BIGINT) AS percent_sum, CAST(sum(cents) AS BIGINT) AS cents_sum,
  round(min(cents) / 100.0, 6) AS bid_price_min, round(max(cents) / 100.0, 6) AS bid_price_max, round(stddev_samp(cents / 100.0), 6) AS bid_price_std, round(sum(cents) / 100.0 / count(*), 6) AS bid_price_mean,
  round(stddev_samp(cents / 100.0) / (sum(cents) / 100.0 / count(*)), 9) AS bid_price_cv, round((max(cents) - min(cents)) / 100.0 / (sum(cents) / 100.0 / count(*)), 9) AS bid_price_spread_ratio,
  round(ln(1 + max(cents) / 100.0), 9) AS log_bid_price_max, round(count(DISTINCT bidder) / CAST(count(*) AS DOUBLE), 9) AS bidder_ratio, CAST(stddev_samp(cents / 100.0) IS NULL AS INT) AS missing_bid_price_std FROM bid GROUP BY 1"""))
def bid_to_lot(spark, sf_dir):
    money = ("bid_price_min", "bid_price_max", "bid_price_std", "bid_price_mean")
    return _rounded(_rounded(fx.bid_to_lot(fx.bids(spark, sf_dir)), money, 6), ("bid_price_cv", "bid_price_spread_ratio", "log_bid_price_max", "bidder_ratio"))


@query(q.ask(f"SELECT lot_id, {', '.join(q.Y)}, split FROM marked"))
def derive_targets(spark, sf_dir):
    return fx.with_targets(fx.lots(spark, sf_dir)).select("lot_id", *fx.TARGETS, "split")


_RULES = (("y_cri_high", "label_cri", ">=", fx.CRI_CUT), ("y_proc_high", "label_corr_proc", ">=", fx.PROC_CUT), ("y_single_bid", "label_corr_singleb", ">", 0.0), ("y_no_call_for_tender", "label_corr_nocft", ">", 0.0))


@query(q.ask(" UNION ALL ".join(
    f"SELECT '{t}' AS target, count({t}) AS labelled, CAST(sum(CAST({t} IS DISTINCT FROM CAST({s} {op} {q.d(c)} AS INT) AS INT)) AS BIGINT) AS disagreements, CAST(sum(CAST({t} IS DISTINCT FROM CAST({s} {op} {q.d(c)} AS INT) AND coalesce({s} = {q.d(c)}, false) AS INT)) AS BIGINT) AS at_the_cut, CAST(sum(CAST({t} IS DISTINCT FROM CAST({s} {op} {q.d(c)} AS INT) AND NOT coalesce({s} = {q.d(c)}, false) AS INT)) AS BIGINT) AS unexplained FROM marked"
    for t, s, op, c in _RULES)))
def target_verification(spark, sf_dir):
    return prepare.target_verification(fx.with_targets(fx.lots(spark, sf_dir)), _RULES)


@query(q.ask(" UNION ALL ".join(f"SELECT '{t}' AS target, count({t}) AS labelled, CAST(sum({t}) AS BIGINT) AS positives, CAST(count({t}) - sum({t}) AS BIGINT) AS negatives, round(sum({t}) / {q.d(f'count({t})')}, 9) AS positive_rate FROM marked" for t in q.Y)))
def target_balance(spark, sf_dir):
    return prepare.target_balance(fx.with_targets(fx.lots(spark, sf_dir)), fx.TARGETS)


@query(q.ask("SELECT lot_id, split, CAST((lot_id * 31 + 17) % 5 AS INT) AS fold FROM marked"))
def split_assignment(spark, sf_dir):
    return fx.with_targets(fx.lots(spark, sf_dir)).select("lot_id", "split", fx.fold_of(F.col("lot_id")).alias("fold"))


@query(q.ask(" UNION ALL ".join(f"SELECT split, count(*) AS rows, round(count(*) / CAST((SELECT count(*) FROM marked) AS DOUBLE), 9) AS share, '{t}' AS target, count({t}) AS labelled, CAST(sum({t}) AS BIGINT) AS positives, round(sum({t}) / {q.d(f'count({t})')}, 9) AS positive_rate FROM marked GROUP BY split" for t in q.Y)))
def split_summary(spark, sf_dir):
    return prepare.split_summary(fx.with_targets(fx.lots(spark, sf_dir)), fx.TARGETS)


@query(q.ask("""SELECT lot_id, split, stratum, row_number() OVER (ORDER BY split, lot_id) - 1 AS sample_row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY split, stratum ORDER BY (lot_id * 48271) % 2147483647, lot_id) AS nth, count(*) OVER (PARTITION BY split, stratum) AS n, count(*) OVER (PARTITION BY split) AS whole
  FROM (SELECT *, coalesce(y_proc_high, -1) AS stratum FROM marked)) WHERE nth <= least(n, greatest(round(CAST(500 AS DOUBLE) * n / whole), 1))"""))
def stratified_sample(spark, sf_dir):
    sample = prepare.stratified_sample(fx.with_targets(fx.lots(spark, sf_dir)), "y_proc_high", 500, (F.col("lot_id") * 48271) % 2147483647, "lot_id")
    return prepare.numbered(sample, "lot_id").select("lot_id", "split", "stratum", F.col("sample_row_id").cast("long").alias("sample_row_id"))


@query(q.ask("SELECT lot_id, CASE WHEN lot_bidscount IS NOT NULL THEN round(ln(1 + greatest(CAST(lot_bidscount AS DOUBLE), 0)), 9) END AS log_lots, CAST(coalesce(lot_bidscount, 0) + coalesce(award_criteria_count, 0) AS DOUBLE) AS total, round(coalesce(award_criteria_count, 0) / CAST(coalesce(lot_bidscount, 0) + 1 AS DOUBLE), 9) AS ratio, round(coalesce(award_criteria_count, 0) / CAST(greatest(coalesce(lot_bidscount, 1), 1) AS DOUBLE), 9) AS per_lot, CAST(NULL AS FLOAT) AS absent FROM lots"))
def engineered_numerics(spark, sf_dir):
    lot = fx.lots(spark, sf_dir)
    return lot.select(
        "lot_id", F.round(cl.clipped_log1p("lot_bidscount"), 9).alias("log_lots"), cl.total_of(["lot_bidscount", "award_criteria_count"]).alias("total"),
        F.round(cl.ratio_plus_one("award_criteria_count", "lot_bidscount"), 9).alias("ratio"), F.round(cl.per_at_least_one("award_criteria_count", "lot_bidscount"), 9).alias("per_lot"), cl.column_or_null(lot, "no_such_column").alias("absent"),
    )


@query(q.ask("SELECT lot_id, coalesce(procedure_type, 'missing') || '||' || coalesce(buyer_type, 'missing') AS procedure_buyer, coalesce(cpv_group, 'missing') || '||' || coalesce(supply_type, 'missing') AS cpv_supply FROM lots"))
def interaction_keys(spark, sf_dir):
    return fx.lots(spark, sf_dir).select("lot_id", cl.interaction("procedure_type", "buyer_type").alias("procedure_buyer"), cl.interaction("cpv_group", "supply_type").alias("cpv_supply"))


def _train(spark, sf_dir):
    return fx.with_targets(fx.lots(spark, sf_dir)).where("split = 'train'").withColumn("fold", fx.fold_of(F.col("lot_id"))).withColumn("pair", cl.interaction("procedure_type", "buyer_type"))


@query(q.ask(q.encoding("train", "procedure_type"), f"train AS ({q.TRAIN})"))
def target_encode_full(spark, sf_dir):
    return prepare.encoding_table(_train(spark, sf_dir), "procedure_type", "y_proc_high")


@query(q.ask(q.encoding("train", "pair"), f"train AS ({q.TRAIN})"))
def target_encode_interaction(spark, sf_dir):
    return prepare.encoding_table(_train(spark, sf_dir), "pair", "y_proc_high")


_ENCODED = ("procedure_type", "supply_type", "buyer_type", "buyer_country", "cpv_code", "cpv_group")
_CROSSED = (("procedure_type", "supply_type"), ("buyer_type", "cpv_group"), ("cpv_code", "procedure_type"))
_KEYED = "SELECT t.*, " + ", ".join(f"coalesce({a}, 'missing') || '||' || coalesce({b}, 'missing') AS {a}_x_{b}" for a, b in _CROSSED) + " FROM train t"


@query(q.ask(" UNION ALL ".join(f"SELECT '{k}' AS feature, * FROM ({q.encoding('keyed', k)})" for k in (*_ENCODED, *[f"{a}_x_{b}" for a, b in _CROSSED])), f"train AS ({q.TRAIN})", f"keyed AS ({_KEYED})"))
def target_encode_list(spark, sf_dir):
    """Every category and every pair of them that is encoded."""
    train = stored(_train(spark, sf_dir).withColumns({f"{a}_x_{b}": cl.interaction(a, b) for a, b in _CROSSED}), "encode-rows")
    tables = [prepare.encoding_table(train, k, "y_proc_high").withColumn("feature", F.lit(k)) for k in (*_ENCODED, *[f"{a}_x_{b}" for a, b in _CROSSED])]
    return reduce(lambda a, b: a.unionByName(b), tables)


@query(q.ask(q.oof(), f"train AS ({q.TRAIN})"))
def target_encode_oof(spark, sf_dir):
    return prepare.out_of_fold_table(_train(spark, sf_dir), "procedure_type", "y_proc_high", "fold")


@query(q.ask(f"SELECT m.lot_id, m.split, CASE WHEN m.split = 'train' THEN CASE WHEN m.y_proc_high IS NOT NULL THEN o.encoding END ELSE coalesce(e.encoding, (SELECT max(global_mean) FROM enc)) END AS encoded FROM marked m LEFT JOIN oof o ON o.key = m.procedure_type AND o.fold = (m.lot_id * 31 + 17) % 5 LEFT JOIN enc e ON e.key = m.procedure_type",
             f"train AS ({q.TRAIN})", f"oof AS ({q.oof()})", f"enc AS ({q.encoding('train', 'procedure_type')})"))
def target_encode_apply(spark, sf_dir):
    lot = fx.with_targets(fx.lots(spark, sf_dir)).withColumn("fold", fx.fold_of(F.col("lot_id")))
    train = lot.where("split = 'train'")
    fitted = prepare.apply_encoding(lot.where("split <> 'train'"), prepare.encoding_table(train, "procedure_type", "y_proc_high"), "procedure_type", "encoded")
    return prepare.out_of_fold(train, "procedure_type", "y_proc_high", "fold", "encoded").select("lot_id", "split", "encoded").unionByName(fitted.select("lot_id", "split", "encoded"))


# ---- criteria, normalisation, weights, scores


@query(q.ask(f"SELECT sample_row_id, split, {q.ROUNDED(q.C)} FROM crit"))
def criteria(spark, sf_dir):
    return _rounded(criteria_rows(spark, sf_dir), CRITERIA).select("sample_row_id", "split", *CRITERIA)


@query(q.ask("SELECT sample_row_id, CAST(y_any_risk AS INT) AS y_any_risk FROM crit"))
def composite_label(spark, sf_dir):
    return criteria_rows(spark, sf_dir).select("sample_row_id", "y_any_risk")


def _normalize(method):
    def run(spark, sf_dir):
        val, test = _val_and_test(spark, sf_dir)
        rows = ranking.normalized(test, val, [method])
        return _rounded(rows, CRITERIA).select("sample_row_id", *CRITERIA)

    return run


def _weights(method):
    def run(spark, sf_dir):
        val = criteria_rows(spark, sf_dir, "val")
        rows = ranking.normalized(val, val).where(F.col("y_cri_high").isNotNull())
        return _rounded(ranking.weights(rows, ["normalization"], [method]), CRITERIA, 8)

    return run


for _m in ranking.NORMALIZATIONS:
    query(q.ask(f"SELECT sample_row_id, {q.ROUNDED(q.C)} FROM norm", q.normalized("SELECT * FROM crit WHERE split = 'test'", [_m])), f"normalize_{_m}")(_normalize(_m))
for _m in ranking.WEIGHTINGS:
    query(q.ask(f"SELECT normalization, weighting, {q.ROUNDED(q.C, 8)} FROM ({q.weight_query(_m)})", q.normalized("SELECT * FROM crit WHERE split = 'val'"), "learn AS (SELECT * FROM norm WHERE y_cri_high IS NOT NULL)"), f"weights_{_m}")(_weights(_m))
for _m in ranking.SCORERS:
    query(q.ask(f"SELECT sample_row_id, score FROM ({q.scored(_m, q.EQUAL_TEST, q.KEYS)})", q.TEST_MINMAX), f"score_{_m}")(
        lambda spark, sf_dir, m=_m: _test_scores(spark, sf_dir, m).select("sample_row_id", "score")
    )


@query(q.ask("SELECT sample_row_id, score, row_number() OVER (ORDER BY score DESC, sample_row_id) AS rank, row_number() OVER (ORDER BY score DESC, sample_row_id) <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS selected_for_review FROM ranked", q.TEST_MINMAX, q.RANKED))
def rank_and_review_flag(spark, sf_dir):
    return ranking.ranked(_test_scores(spark, sf_dir).select("sample_row_id", "score"), 0.2)


@query(q.ask("SELECT sample_row_id, score, row_number() OVER (ORDER BY score DESC, sample_row_id) AS rank FROM ranked QUALIFY rank <= 100", q.TEST_MINMAX, q.RANKED))
def top_ranked(spark, sf_dir):
    """The report of the 100 best test rows: a heap per task, and no sort of all rows."""
    best = _test_scores(spark, sf_dir).select("sample_row_id", "score").orderBy(F.desc("score"), "sample_row_id").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "sample_row_id")).cast("long"))


def flagship(spark, sf_dir: str) -> DataFrame:
    return top_ranked(spark, sf_dir)


# ---- metrics


@query(q.ask(q.ap("SELECT * FROM long", q.ST), *q.ON_LONG))
def metric_average_precision(spark, sf_dir):
    return metrics.average_precision(_long(spark, sf_dir), ST)


@query(q.ask(q.auc("SELECT * FROM long", q.ST), *q.ON_LONG))
def metric_roc_auc(spark, sf_dir):
    return metrics.roc_auc(_long(spark, sf_dir), ST)


_BINS = "SELECT strategy, target, CAST(least(floor(round(score * 10, 9)), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate FROM long WHERE y IS NOT NULL GROUP BY ALL"


@query(q.ask(f"SELECT * FROM (SELECT strategy, target, round(avg((score - y) * (score - y)), 9) AS brier FROM long WHERE y IS NOT NULL GROUP BY ALL) JOIN (SELECT strategy, target, round(sum(n * abs(mean_predicted - observed_rate)) / sum(n), 6) AS ece FROM ({_BINS}) GROUP BY ALL) USING (strategy, target)", *q.ON_LONG))
def metric_brier_ece(spark, sf_dir):
    long = _long(spark, sf_dir)
    return metrics.brier(long, ST).join(metrics.expected_calibration_error(long, ST), ST)


@query(q.ask(_BINS, *q.ON_LONG))
def reliability_bins(spark, sf_dir):
    return metrics.reliability(_long(spark, sf_dir), ST)


@query(q.ask("""SELECT strategy, target, round(coalesce(tp / nullif(said, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(pos, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(said + pos, 0), 0), 9) AS f1 FROM (
  SELECT strategy, target, CAST(sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS DOUBLE) AS tp, sum(CAST(score >= 0.5 AS INT)) AS said, sum(y) AS pos FROM long WHERE y IS NOT NULL GROUP BY ALL)""", *q.ON_LONG))
def metric_at_half(spark, sf_dir):
    return metrics.at_half(_long(spark, sf_dir), ST)


@query(q.ask(q.table_at("SELECT * FROM long", q.ST, q.RATES6), *q.ON_LONG))
def metric_threshold_table(spark, sf_dir):
    return metrics.threshold_table(_long(spark, sf_dir), ST)


@query(q.ask(f"SELECT strategy, target, ndcg FROM ({q.table_at('SELECT * FROM long', q.ST, [0.1])})", *q.ON_LONG))
def metric_ndcg(spark, sf_dir):
    return metrics.threshold_table(_long(spark, sf_dir), ST, [0.1]).select(*ST, "ndcg")


@query(q.ask(q.best_at("SELECT * FROM long", q.ST, q.RATES6), *q.ON_LONG))
def metric_best_threshold(spark, sf_dir):
    return metrics.best_threshold(_long(spark, sf_dir), ST)


def _two_scores(spark, sf_dir):
    return _wide(spark, sf_dir).select("sample_row_id", F.lit(1).alias("k"), F.round("p_cri_high", 9).alias("raw"), "topsis")


@query(q.ask("SELECT round(corr(a, b), 9) AS spearman FROM (SELECT rank() OVER (ORDER BY round(p_cri_high, 9)) + (count(*) OVER (PARTITION BY round(p_cri_high, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY topsis) + (count(*) OVER (PARTITION BY topsis) - 1) / 2.0 AS b FROM wide)", *q.ON_LONG))
def metric_spearman(spark, sf_dir):
    return metrics.spearman(_two_scores(spark, sf_dir), ["k"], "raw", "topsis").drop("k")


@query(q.ask("""SELECT CAST(sum(CAST(a AND b AS INT)) AS BIGINT) AS both, round(sum(CAST(a AND b AS INT)) / CAST(sum(CAST(a OR b AS INT)) AS DOUBLE), 9) AS jaccard FROM (
  SELECT row_number() OVER (ORDER BY round(p_cri_high, 9) DESC, sample_row_id) <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS a, row_number() OVER (ORDER BY topsis DESC, sample_row_id) <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS b FROM wide)""", *q.ON_LONG))
def metric_topk_jaccard(spark, sf_dir):
    return metrics.top_jaccard(_two_scores(spark, sf_dir), ["k"], "raw", "topsis").drop("k")


# ---- configuration grid


def grid_scores(val: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of every configuration on validation rows, and the weights that the labelled ones give."""
    rows = stored(ranking.normalized(val, val).select("normalization", "sample_row_id", "y_cri_high", "y_any_risk", *CRITERIA), "grid-rows")
    weights = ranking.weights(rows.where(F.col("y_cri_high").isNotNull()), ["normalization"])
    return ranking.scored(rows, weights, ["normalization"], store=True), weights


def grid_rows(scores: DataFrame) -> DataFrame:
    """Every configuration's performance on validation rows and its selection score."""
    # both labels go through one sort of the scores
    labels = ("y_cri_high", "y_any_risk")
    named = F.element_at(F.array(*[F.lit(t) for t in labels]), F.col("label") + 1).alias("target")
    found, keys = curves.measured(scores, CONFIG, labels, metrics.RATES), [*CONFIG, "target"]
    found = found.select("*", named)
    both = found.select(*keys, metrics.precision_area()).join(metrics.best_rate(metrics.rate_rows(found, keys, metrics.RATES), keys), keys)
    one = lambda c, t, name: F.max(F.when(F.col("target") == t, F.col(c))).alias(name)
    wide = both.groupBy(*CONFIG).agg(
        one("average_precision", "y_cri_high", "primary_ap"), one("rate", "y_cri_high", "primary_rate"), one("f1", "y_cri_high", "primary_f1"), one("ndcg", "y_cri_high", "primary_ndcg"),
        one("average_precision", "y_any_risk", "any_ap"), one("f1", "y_any_risk", "any_f1"), one("ndcg", "y_any_risk", "any_ndcg"),
    )
    total = 0.35 * F.col("primary_f1") + 0.25 * F.col("primary_ndcg") + 0.20 * F.col("primary_ap") + 0.10 * F.col("any_f1") + 0.10 * F.col("any_ndcg")
    return wide.withColumn("selection_score", F.round(total, 8))


def _grid(spark, sf_dir) -> DataFrame:
    return grid_rows(grid_scores(criteria_rows(spark, sf_dir, "val"))[0])


_PERF = ("primary_ap", "primary_f1", "primary_ndcg", "any_ap", "any_f1", "any_ndcg")
_PERF_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _PERF)


@query(q.ask(f"SELECT normalization, weighting, method, primary_rate, {_PERF_SQL}, round(selection_score, 6) AS selection_score FROM perf", *q.grid()))
def grid_performance(spark, sf_dir):
    return _rounded(_grid(spark, sf_dir), [*_PERF, "selection_score"], 6)


_SELECT = ("selection_score", "primary_f1", "primary_ndcg", "primary_ap", "any_f1", "any_ndcg")


@query(q.ask(f"SELECT normalization, weighting, method, round(selection_score, 6) AS selection_score FROM perf ORDER BY {', '.join(f'round({c}, 6) DESC' for c in _SELECT)}, method, normalization, weighting LIMIT 1", *q.grid()))
def grid_selected(spark, sf_dir):
    best = _rounded(_grid(spark, sf_dir), [*_PERF, "selection_score"], 6).orderBy(*[F.desc(c) for c in _SELECT], "method", "normalization", "weighting").limit(1)
    return best.select(*CONFIG, "selection_score")


@query(q.ask("SELECT method, round(avg(primary_ap), 6) AS mean_ap, round(max(primary_ap), 6) AS max_ap, round(avg(primary_f1), 6) AS mean_f1, round(max(primary_f1), 6) AS max_f1, count(*) AS configurations FROM perf GROUP BY 1", *q.grid()))
def grid_method_summary(spark, sf_dir):
    rounded = [F.round(f(c), 6).alias(f"{n}_{s}") for c, s in (("primary_ap", "ap"), ("primary_f1", "f1")) for n, f in (("mean", F.avg), ("max", F.max))]
    return _grid(spark, sf_dir).groupBy("method").agg(*rounded, F.count(F.lit(1)).alias("configurations"))


_PICK = f"SELECT * FROM perf ORDER BY {', '.join(f'round({c}, 6) DESC' for c in _SELECT)}, method, normalization, weighting LIMIT 1"
_QUEUE = "row_number() OVER (PARTITION BY split ORDER BY score DESC, sample_row_id)"


@query(q.ask(f"""SELECT split, sample_row_id, score, {_QUEUE} AS rank, {_QUEUE} <= greatest(ceil(count(*) OVER (PARTITION BY split) * rate), 1) AS selected_for_review FROM (
    SELECT 'val' AS split, sample_row_id, score, primary_rate AS rate FROM every JOIN pick USING (normalization, weighting, method)
    UNION ALL SELECT 'test', sample_row_id, score, primary_rate FROM every_t JOIN pick USING (normalization, weighting, method))""", *q.grid(), *q.on_test(), f"pick AS ({_PICK})"))
def selected_ranking(spark, sf_dir):
    """The configuration that validation rows select, with the weights that they give, on both splits."""
    val, test = _val_and_test(spark, sf_dir)
    scores, weights = grid_scores(val)
    best = _rounded(grid_rows(scores), [*_PERF, "selection_score"], 6).orderBy(*[F.desc(c) for c in _SELECT], "method", "normalization", "weighting").first()
    own = weights.where((F.col("normalization") == best["normalization"]) & (F.col("weighting") == best["weighting"]))
    parts = []
    for split, rows in (("val", val), ("test", test)):
        made = ranking.scored(ranking.normalized(rows, val, [best["normalization"]]), own, ["normalization"], [best["method"]])
        parts.append(ranking.ranked(made.select("sample_row_id", "score"), best["primary_rate"]).withColumn("split", F.lit(split)))
    return parts[0].unionByName(parts[1]).select("split", "sample_row_id", "score", "rank", "selected_for_review")


def _evaluated(spark, sf_dir, split: str):
    """The archive's configurations, their scores on a split's rows, and their metrics there."""
    val, test = _val_and_test(spark, sf_dir)
    configs = stored(pareto.decoded(fx.configurations(spark, sf_dir, CRITERIA), CRITERIA), "configurations")
    rows = stored(ranking.normalized(val if split == "val" else test, val).select("normalization", "sample_row_id", "y_cri_high", "y_any_risk", *CRITERIA), "archive-rows")
    scores = pareto.archive_scores(configs, rows, CRITERIA)
    return configs, scores, stored(pareto.evaluated(configs, scores, "y_cri_high", "y_any_risk"), "archive-results")


_MEASURES = ("average_precision", "roc_auc", "f1", "precision", "recall", "ndcg", "f1_at_20pct", "precision_at_20pct", "recall_at_20pct", "ndcg_at_20pct", "any_f1")
_RESULTS = f"""results AS (SELECT c.seq, algorithm, method, normalization, rate, round(criteria_share, 6) AS criteria_share, {', '.join(f'round("{m}", 6) AS "{m}"' for m in _MEASURES)} FROM (SELECT seq, algorithm, method, normalization, rate, criteria_share FROM conf) c
  JOIN ({q.ap('SELECT * FROM labelled', 'seq')}) USING (seq) JOIN ({q.auc('SELECT * FROM labelled', 'seq')}) USING (seq)
  JOIN (SELECT seq, "precision", recall, f1, ndcg FROM ({q.at_own('SELECT * FROM labelled', 'seq')})) USING (seq)
  JOIN (SELECT seq, "precision" AS precision_at_20pct, recall AS recall_at_20pct, f1 AS f1_at_20pct, ndcg AS ndcg_at_20pct FROM ({q.table_at('SELECT * EXCLUDE (rate) FROM labelled', 'seq', [0.2])})) USING (seq)
  JOIN (SELECT seq, f1 AS any_f1 FROM ({q.at_own('SELECT seq, rate, sample_row_id, CAST(y_any_risk AS INT) AS y, score FROM runs', 'seq')})) USING (seq))"""


@query(q.ask("SELECT * FROM results", *q.configurations("test"), _RESULTS))
def archive_on_test(spark, sf_dir):
    return _rounded(_evaluated(spark, sf_dir, "test")[2], (*_MEASURES, "criteria_share"), 6)


@query(q.ask("SELECT algorithm, seq, method, normalization, average_precision, f1 FROM results QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY average_precision DESC, seq) = 1", *q.configurations("test"), _RESULTS))
def archive_best_on_test(spark, sf_dir):
    best = pareto.best_on_test(_evaluated(spark, sf_dir, "test")[2])
    return _rounded(best.select("algorithm", "seq", "method", "normalization", "average_precision", "f1"), ("average_precision", "f1"), 6)


_AIMS = "aims AS (SELECT seq, rate, round(1 - average_precision, 6) AS o1, round(1 - ndcg, 6) AS o2, round(1 - f1, 6) AS o3, round(1 - any_f1, 6) AS o4, round(rate, 6) AS o5, criteria_share AS o6 FROM results)"
_DOMINATED = f"EXISTS (SELECT 1 FROM aims b WHERE {' AND '.join(f'b.{o} <= a.{o}' for o in q.O)} AND ({' OR '.join(f'b.{o} < a.{o}' for o in q.O)}))"
_NEAREST = "SELECT seq, rate FROM (SELECT seq, rate, " + q.norm_of(f"(({o} - min({o}) OVER ()) / (CASE WHEN max({o}) OVER () = min({o}) OVER () THEN 1 ELSE max({o}) OVER () - min({o}) OVER () END))" for o in q.O) + f" AS distance FROM aims a WHERE NOT {_DOMINATED}) ORDER BY distance, seq LIMIT 1"


@query(q.ask(f"SELECT seq, sample_row_id, score, {_QUEUE.replace('PARTITION BY split ', '')} AS rank, {_QUEUE.replace('PARTITION BY split ', '')} <= greatest(ceil(count(*) OVER () * rate), 1) AS selected_for_review FROM (SELECT r.seq, r.rate, sample_row_id, score FROM runs r JOIN knee k ON r.seq = k.seq)", *q.configurations("val"), _RESULTS, _AIMS, f"knee AS ({_NEAREST})"))
def pareto_selected_ranking(spark, sf_dir):
    """The knee of the archive's front on validation rows, and the queue that it makes of them."""
    _, scores, results = _evaluated(spark, sf_dir, "val")
    knee = pareto.knee(pareto.front(pareto.objectives_of(results))).first()
    own = scores.where(F.col("seq") == knee["seq"]).select("sample_row_id", "score")
    return ranking.ranked(own, knee["rate"]).select(F.lit(knee["seq"]).alias("seq"), "sample_row_id", "score", "rank", "selected_for_review")


# ---- validation


@query(q.ask(f"SELECT * FROM ({q.ap('SELECT * FROM long', q.ST)}) JOIN ({q.auc('SELECT * FROM long', q.ST)}) USING ({q.ST}) JOIN ({q.best_at('SELECT * FROM long', q.ST, q.RATES5)}) USING ({q.ST})", *q.ON_LONG))
def strategy_validation(spark, sf_dir):
    return validation.strategy_validation(_long(spark, sf_dir))


def _all_targets(wide: DataFrame) -> DataFrame:
    named = {"raw": F.col("p_cri_high"), "baseline": F.col("topsis"), "consensus": F.col("risk_consensus_mean")}
    return validation.strategies(wide, named, fx.TARGETS)


_ALL = "every AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, '{t}' AS target, sample_row_id, {t} AS y, round({e}, 9) AS score FROM wide" for n, e in (("raw", "p_cri_high"), ("baseline", "topsis"), ("consensus", "risk_consensus_mean")) for t in q.Y) + ")"
_AT3 = q.table_at("SELECT * FROM every", "target, strategy", [0.05, 0.1, 0.2])


@query(q.ask("SELECT * FROM (" + q.ap("SELECT * FROM every", "target, strategy") + ") JOIN (SELECT target, strategy, " + ", ".join(f"max(CASE WHEN rate = {q.d(r)} THEN \"precision\" END) AS precision_at_{round(r * 100):02d}" for r in (0.05, 0.1, 0.2)) + f" FROM ({_AT3}) GROUP BY ALL) USING (target, strategy)", *q.ON_LONG, _ALL))
def decision_support_coverage(spark, sf_dir):
    return validation.coverage(_all_targets(_wide(spark, sf_dir)))


_OWN = "own AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, {t} AS y, round({p}, 9) AS score FROM wide" for t, p in zip(q.Y, q.P, strict=True)) + ")"


@query(q.ask(f"SELECT target, strategy, average_precision, own_ap, round(own_ap - average_precision, 8) AS gap FROM ({q.ap('SELECT * FROM every', 'target, strategy')}) JOIN (SELECT target, average_precision AS own_ap FROM ({q.ap('SELECT * FROM own', 'target')})) USING (target)", *q.ON_LONG, _ALL, _OWN))
def per_target_reference(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    own = wide.select("sample_row_id", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.round(p, 9).alias("score")) for t, p in zip(fx.TARGETS, fx.PROBABILITIES, strict=True)])).alias("r")).select("sample_row_id", "r.*")
    return validation.reference_gap(_all_targets(wide), own)


@query(q.ask(f"""SELECT 'forbidden features' AS "check", count(*) = 0 AS passed FROM (SELECT unnest([{', '.join(f"'{m[0]}'" for m in _MANIFEST if m[3])}]) AS c) WHERE regexp_matches(lower(c), 'year|date|deadline|period|duration|country|city|nuts|postcode|street|address|trace|federated|client|email|phone|url|source|contact') OR c LIKE 'label~_%' ESCAPE '~' OR c LIKE 'y~_%' ESCAPE '~'
  UNION ALL SELECT 'rows aligned', NOT EXISTS (SELECT sample_row_id FROM crit WHERE split = 'test' EXCEPT SELECT sample_row_id FROM ranked) AND (SELECT count(*) FROM ranked) = (SELECT count(*) FROM crit WHERE split = 'test')
  UNION ALL SELECT 'ids unique', count(*) = count(DISTINCT sample_row_id) FROM crit WHERE split = 'test'""", q.TEST_MINMAX, q.RANKED))
def verification_checklist(spark, sf_dir):
    """Over all columns that the manifest uses, two of which it shouldn't."""
    val, test = _val_and_test(spark, sf_dir)
    return validation.checklist(_manifest(spark).where("used_as_feature").select("column"), test, _equally_scored(val, test, "topsis"), "sample_row_id")


_WEIGHTS = [(3 + i * i % 7) / 100 for i in range(len(CRITERIA))]
_ANEW = "sqrt(" + " + ".join(f"power(w_{c} * {c} - min(w_{c} * {c}) OVER (), 2)" for c in q.C) + ")"
_BACK = "sqrt(" + " + ".join(f"power(max(w_{c} * {c}) OVER () - w_{c} * {c}, 2)" for c in q.C) + ")"
_GIVEN = f"given AS (SELECT n.*, 'given' AS weighting, {', '.join(f'{q.d(w)} AS w_{c}' for c, w in zip(q.C, _WEIGHTS, strict=True))} FROM norm n)"


@query(q.ask("""SELECT count(*) AS rows, round(max(abs(a - b)), 6) AS max_difference, round(corr(ra, rb), 6) AS spearman FROM (
  SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM (
    SELECT k.score AS a, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 9) AS b FROM kept k JOIN anew USING (sample_row_id)))""",
             q.TEST_MINMAX, _GIVEN, f"kept AS ({q.scored('topsis', 'SELECT * FROM given', q.KEYS)})", f"anew AS (SELECT sample_row_id, {_ANEW} / ({_ANEW} + {_BACK}) AS raw FROM given)"))
def reproduction_check(spark, sf_dir):
    """A ranking is written with its configuration as text; the text is decoded, rows are normalised and scored anew with
    what it says, and the two are compared."""
    val, test = _val_and_test(spark, sf_dir)
    given = spark.createDataFrame([("minmax", "given", *_WEIGHTS)], "normalization string, weighting string, " + ", ".join(f"{c} double" for c in CRITERIA))
    first = ranking.scored(ranking.normalized(test, val, ["minmax"]), given, ["normalization"], ["topsis"])
    text = validation.config_json(F.lit("topsis"), F.lit("minmax"), {c: F.lit(w) for c, w in zip(CRITERIA, _WEIGHTS, strict=True)})
    written = stored(first.select("sample_row_id", "score", text.alias("config")), "ranking")
    return validation.reproduction(written, val, test, "sample_row_id").withColumns({c: F.round(c, 6) for c in ("max_difference", "spearman")})


@query("""SELECT coalesce(p.table_name, a.table_name) AS table_name, coalesce(p.cell, a.cell) AS cell, p.value AS value, a.value AS found, coalesce(round(abs(p.value - a.value), 9) <= 0.051, false) AS passed
  FROM (SELECT 'orders' AS table_name, o_orderstatus AS cell, CAST(count(*) AS DOUBLE) + CASE WHEN o_orderstatus = 'P' THEN 0.04 ELSE 0 END AS value FROM orders GROUP BY o_orderstatus) p
  FULL JOIN (SELECT 'orders' AS table_name, o_orderstatus AS cell, CAST(count(*) AS DOUBLE) + CASE WHEN o_orderstatus = 'O' THEN 0.06 ELSE 0 END AS value FROM orders GROUP BY o_orderstatus) a ON p.table_name = a.table_name AND p.cell = a.cell""")
def cell_verification(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("table_name"), F.col("o_orderstatus").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    shifted = lambda s, by: counts.select("table_name", "cell", (F.col("n") + F.when(F.col("cell") == s, by).otherwise(0.0)).alias("value"))
    return validation.cells_within(shifted("P", 0.04), shifted("O", 0.06))


# ---- operating points

_GRID_RATES = [i / 100 for i in range(1, 81)]


@query(q.ask(f"SELECT strategy, target, rate, selected, \"precision\", recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {q.ST} ORDER BY f1 DESC, rate) AS z FROM ({q.table_at('SELECT * FROM long', q.ST, _GRID_RATES)})) WHERE z = 1", *q.ON_LONG))
def operating_point_topk(spark, sf_dir):
    return validation.best_top_rate(_long(spark, sf_dir), ST, _GRID_RATES)


_CUTS = """SELECT strategy, target, cut, selected, f1 FROM (SELECT *, row_number() OVER (PARTITION BY strategy, target ORDER BY f1 DESC, cut) AS z FROM (
  SELECT strategy, target, round(step / CAST(1000 AS DOUBLE), 9) AS cut, count(*) AS selected, round(2 * sum(y) / CAST(count(*) + any_value(pos) AS DOUBLE), 9) AS f1
  FROM (SELECT *, sum(y) OVER (PARTITION BY strategy, target) AS pos FROM long WHERE y IS NOT NULL), (SELECT unnest(range(1, 1000)) AS step) WHERE floor(round(score * 1000, 6)) >= step GROUP BY strategy, target, step)) WHERE z = 1"""


@query(q.ask(_CUTS, *q.ON_LONG))
def operating_point_threshold(spark, sf_dir):
    return validation.best_cut(_long(spark, sf_dir), ST)


_SIDES = "sides AS (" + " UNION ALL ".join(f"SELECT split, '{n}' AS strategy, '{t}' AS target, sample_row_id, CAST({t} AS INT) AS y, round({e}, 9) AS score FROM crit WHERE split <> 'train'" for n, e in (("raw", "p_cri_high"), ("consensus", "risk_consensus_mean")) for t in ("y_cri_high", "y_any_risk")) + ")"


def _sides(spark, sf_dir):
    named = {"raw": F.col("p_cri_high"), "consensus": F.col("risk_consensus_mean")}
    return [validation.strategies(rows, named, ("y_cri_high", "y_any_risk")) for rows in _val_and_test(spark, sf_dir)]


_VAL_AT, _TEST_AT = (q.table_at(f"SELECT * FROM sides WHERE split = '{s}'", q.ST, _GRID_RATES) for s in ("val", "test"))


@query(q.ask(f"SELECT strategy, target, t.rate, v.f1 AS val_f1, t.\"precision\" AS test_precision, t.recall AS test_recall, t.f1 AS test_f1 FROM (SELECT *, row_number() OVER (PARTITION BY {q.ST} ORDER BY f1 DESC, rate) AS z FROM ({_VAL_AT})) v JOIN ({_TEST_AT}) t USING (strategy, target, rate) WHERE z = 1", _SIDES))
def operating_point_calibrated(spark, sf_dir):
    return validation.calibrated_rate(*_sides(spark, sf_dir), ST, _GRID_RATES)


@query(q.ask(f"""SELECT c.strategy, c.target, c.cut, c.f1 AS val_f1, CAST(sum(hit) AS BIGINT) AS selected, round(2 * sum(hit * y) / CAST(sum(hit) + sum(y) AS DOUBLE), 9) AS test_f1 FROM (
  SELECT s.*, c.cut, c.f1, CAST(round(score * 1000, 6) >= round(cut * 1000, 6) AS INT) AS hit FROM sides s JOIN cuts c USING (strategy, target) WHERE split = 'test' AND y IS NOT NULL) c GROUP BY ALL""", _SIDES, "long AS (SELECT * FROM sides WHERE split = 'val')", f"cuts AS ({_CUTS})"))
def operating_point_calibrated_cut(spark, sf_dir):
    return validation.calibrated_cut(*_sides(spark, sf_dir), ST)


@query(q.ask("SELECT target, i / CAST(100 AS DOUBLE) AS rate, round(2 * least(i / CAST(100 AS DOUBLE) / share, 1) / (1 + least(i / CAST(100 AS DOUBLE) / share, 1)), 9) AS max_f1 FROM ("
             + " UNION ALL ".join(f"SELECT '{t}' AS target, avg(CAST({t} AS DOUBLE)) AS share FROM crit WHERE split = 'val'" for t in q.Y) + "), (SELECT unnest(range(1, 81)) AS i)"))
def f1_bound(spark, sf_dir):
    """The best F1 that a queue of each rate can have, by the share of positives that each target has among validation rows."""
    shares = criteria_rows(spark, sf_dir, "val").agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in fx.TARGETS])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("share")) for t in fx.TARGETS])).alias("s")
    rates = shares.select(each).select("s.*", F.explode(F.sequence(F.lit(1), F.lit(80))).alias("i")).withColumn("rate", F.col("i") / 100)
    return rates.select("target", "rate", F.round(metrics.f1_bound(F.col("rate"), F.col("share")), 9).alias("max_f1"))


# ---- files written and read back


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, md5(nullif(text, '')) AS text_md5, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def csv_round_trip(spark, sf_dir):
    """All documents, whose texts have line ends, quotes and commas, as CSV files and back."""
    path = new_path(spark, "documents-csv")
    writers.write_csv(table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text", "n_chars"]), path, one_file=False)
    return readers.csv_strings(spark, path).select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), "n_chars")


@query("""SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def csv_two_columns(spark, sf_dir):
    """Two columns of a wide CSV, typed."""
    path = new_path(spark, "orders-csv")
    writers.write_csv(table(spark, sf_dir, "orders"), path, one_file=False)
    rows = readers.csv_strings(spark, path, ["o_orderstatus", "o_totalprice"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice").cast("double") * 100).cast("long")).alias("cents"))


@query("SELECT 'c_custkey' AS first_column, count(*) AS lines FROM customer")
def csv_header_and_lines(spark, sf_dir):
    path = new_path(spark, "customer-csv")
    writers.write_csv(table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]), path)
    return spark.range(1).select(F.lit(readers.csv_header(spark, path)[0]).alias("first_column"), F.lit(readers.line_count(spark, path)).cast("long").alias("lines"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, min(l_shipdate) AS first_day FROM lineitem GROUP BY 1")
def parquet_round_trip(spark, sf_dir):
    """A table written over another and read back, in zstd and by partition."""
    path, line = new_path(spark, "lineitem"), table(spark, sf_dir, "lineitem")
    writers.write_table(line.limit(5), path)
    writers.write_table(line, path, ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.min("l_shipdate").alias("first_day"))


@query("SELECT n_name AS name, CAST(count(c_custkey) AS BIGINT) AS customers, '| ' || n_name || ' | ' || CAST(count(c_custkey) AS VARCHAR) || ' |' AS markdown FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def report_round_trip(spark, sf_dir):
    """A report table as CSV and as Markdown, both read back."""
    path = new_path(spark, "report")
    customer = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    writers.write_report(table(spark, sf_dir, "nation").join(customer, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.coalesce("c", F.lit(0)).alias("customers")), path)
    lines = spark.read.text(f"{path}.md").where(F.col("value").startswith("|")).select(F.col("value").alias("markdown"), F.trim(F.split("value", r"\|")[1]).alias("name"))
    return readers.csv_typed(spark, f"{path}.csv", "name string, customers long").join(lines, "name").select("name", "customers", "markdown")


@query("SELECT o_orderpriority AS name, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def summary_round_trip(spark, sf_dir):
    """Counts as a JSON summary, read back."""
    path = new_path(spark, "summary")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").count().collect()  # a row per category
    writers.write_summary(spark, {r["o_orderpriority"]: r["count"] for r in counts}, path)
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return text.select(F.explode("m").alias("name", "n"))


@query("""SELECT p_type AS "column", CASE WHEN count(*) FILTER (p_size > 25) > 0 THEN count(*) FILTER (p_size > 25) % 2 = 0 ELSE count(*) > 3 END AS used_as_feature FROM part GROUP BY 1""")
def manifest_upsert(spark, sf_dir):
    """A manifest of categories, updated by those of large parts."""
    part = table(spark, sf_dir, "part")
    entry = lambda df, used: df.groupBy(F.col("p_type").alias("column")).agg(used.alias("used_as_feature"))
    small_ = part.join(part.where("p_brand < 'Brand#30'").select("p_type").distinct(), "p_type", "left_semi")
    held, added = entry(small_, F.count(F.lit(1)) > 3), entry(part.where("p_size > 25"), F.count(F.lit(1)) % 2 == 0)
    rest = entry(part.join(small_.select("p_type").distinct(), "p_type", "left_anti"), F.count(F.lit(1)) > 3)
    return writers.upsert_manifest(writers.upsert_manifest(held, rest), added)


# ---- Pareto


def _front(spark, sf_dir):
    return pareto.front(pareto.without_duplicates(fx.archive(spark, sf_dir)))


@query(q.on_archive("SELECT seq, algorithm FROM uniq"))
def pareto_dedup(spark, sf_dir):
    return pareto.without_duplicates(fx.archive(spark, sf_dir)).select("seq", "algorithm")


@query(q.on_archive(f"SELECT seq, {q.ROUNDED(q.O)} FROM front"))
def pareto_front(spark, sf_dir):
    return _rounded(_front(spark, sf_dir), pareto.OBJECTIVES).select("seq", *pareto.OBJECTIVES)


@query(q.on_archive(f"SELECT seq, {q.ROUNDED(q.O)} FROM scaled"))
def pareto_scaled(spark, sf_dir):
    return _rounded(pareto.scaled(_front(spark, sf_dir)), pareto.OBJECTIVES).select("seq", *pareto.OBJECTIVES)


@query(q.on_archive(f"SELECT seq, {q.norm_of(q.O)} AS distance FROM scaled ORDER BY 2, 1 LIMIT 1"))
def pareto_knee(spark, sf_dir):
    return pareto.knee(_front(spark, sf_dir)).select("seq", "distance")


_GAP = q.norm_of(f"w_{o} - {w}" for o, w in zip(q.O, q.TARGET, strict=True))


@query(q.on_archive(f"SELECT seq, {', '.join(f'round(w_{o}, 9) AS w_{o}' for o in q.O)}, {_GAP} AS distance FROM pseudo", q.PSEUDO))
def pareto_pseudo_weights(spark, sf_dir):
    names = [f"w_{o}" for o in pareto.OBJECTIVES]
    return _rounded(pareto.pseudo_weights(_front(spark, sf_dir)), names).select("seq", *names, "distance")


@query(q.on_archive(f"SELECT seq, {_GAP} AS distance FROM pseudo ORDER BY 2, 1 LIMIT 1", q.PSEUDO))
def pareto_pseudo_choice(spark, sf_dir):
    return pareto.pseudo_weight_choice(_front(spark, sf_dir)).select("seq", "distance")


@query(q.on_archive(f"SELECT algorithm, count(*) AS solutions, {', '.join(f'round(min({o}), 9) AS best_{o}' for o in q.O)}, arg_min(seq, (o1, seq)) AS best_seq FROM uniq GROUP BY 1"))
def pareto_best_per_algorithm(spark, sf_dir):
    return pareto.best_per_algorithm(pareto.without_duplicates(fx.archive(spark, sf_dir)))


_VECTORS = " UNION ALL ".join(f"SELECT '{n}' AS vector, seq, {q.norm_of(f'w_{o} - {q.d(repr(t))}' for o, t in zip(q.O, v, strict=True))} AS distance FROM pseudo" for n, v in q.perturbed())


@query(q.on_archive(f"SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY vector ORDER BY distance, seq) AS z FROM ({_VECTORS})) WHERE z = 1", q.PSEUDO))
def weight_perturbation(spark, sf_dir):
    return pareto.choices_under(_front(spark, sf_dir), pareto.perturbed_weights())


_DRAWS = ", ".join(f"({i}, " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in v) + ")" for i, v in enumerate(statistics.dirichlet_vectors(pareto.TARGET_WEIGHTS)))
_DRAWN_GAP = q.norm_of(f"w_{o} - t_{o}" for o in q.O)


@query(q.on_archive(f"SELECT seq, count(*) AS times FROM (SELECT seq, row_number() OVER (PARTITION BY draw ORDER BY {_DRAWN_GAP}, seq) AS z FROM pseudo, draws) WHERE z = 1 GROUP BY 1", q.PSEUDO, f"draws(draw, {', '.join(f't_{o}' for o in q.O)}) AS (VALUES {_DRAWS})"))
def weight_draws(spark, sf_dir):
    """How often each solution of the front is chosen if target weights are drawn from a Dirichlet distribution round the base ones."""
    return statistics.dirichlet_choices(_front(spark, sf_dir), pareto.TARGET_WEIGHTS)


@query(q.on_archive("SELECT seq, round(o1, 9) AS o1, round(o4, 9) AS o4, round(o5, 9) AS o5 FROM uniq WHERE o5 BETWEEN 0.04 AND 0.06 AND round(o1 - (SELECT min(o1) FROM uniq WHERE o5 BETWEEN 0.04 AND 0.06), 9) <= 0.05 ORDER BY uniq.o4, seq LIMIT 1"))
def capacity_band(spark, sf_dir):
    best = pareto.capacity_band(pareto.without_duplicates(fx.archive(spark, sf_dir)))
    return _rounded(best, ("o1", "o4", "o5")).select("seq", "o1", "o4", "o5")


_TOTAL = "(" + " + ".join(f"coalesce({y}, 0)" for y in q.Y) + ")"


@query(q.ask(f"""SELECT queue, count(*) AS reviewed, round(count(b.id) / CAST(any_value(base) AS DOUBLE), 9) AS overlap, round(count(b.id) / CAST(count(*) + any_value(base) - count(b.id) AS DOUBLE), 9) AS jaccard,
    {', '.join(f'CAST(sum(coalesce({y}, 0)) AS BIGINT) AS captured_{y}' for y in q.Y)}, CAST(sum(CAST({_TOTAL} >= 2 AS INT)) AS BIGINT) AS flagged_twice, CAST(sum({_TOTAL}) AS BIGINT) AS captured_all
  FROM queued LEFT JOIN (SELECT sample_row_id AS id FROM queued WHERE queue = 'p_cri_high') b ON id = sample_row_id, (SELECT count(*) AS base FROM queued WHERE queue = 'p_cri_high') GROUP BY queue""",
             *q.ON_LONG, "queued AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS queue, sample_row_id, {', '.join(q.Y)}, row_number() OVER (ORDER BY round({s}, 9) DESC, sample_row_id) AS place, count(*) OVER () AS n FROM wide) WHERE place <= greatest(ceil(n * CAST(0.05 AS DOUBLE)), 1)" for s in ("p_cri_high", "topsis", "risk_consensus_mean")) + ")"))
def multirisk_queues(spark, sf_dir):
    return validation.queue_report(_wide(spark, sf_dir), ("p_cri_high", "topsis", "risk_consensus_mean"), fx.TARGETS, 0.05)


@query("SELECT s_suppkey AS k, '{\"mask\":[0,2],\"method\":\"topsis\",\"normalization\":\"minmax\",\"rate\":' || CAST(round(s_nationkey / CAST(100 AS DOUBLE), 4) AS VARCHAR) || ',\"weights\":[0.25,0.75]}' AS signature FROM supplier")
def decision_signature(spark, sf_dir):
    rate = F.col("s_nationkey") / 100
    sign = pareto.signature(F.lit("topsis"), F.lit("minmax"), rate, F.array(F.lit(0), F.lit(2)), F.array(F.lit(0.25), F.lit(0.75)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), sign.alias("signature"))


# ---- statistics


def _correlation_sql(ranks: bool) -> str:
    src = "preds" if not ranks else "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS {p}" for p in q.P) + " FROM preds)"
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS correlation FROM {src}" for a, b in q.PAIRS)


@query(q.ask(_correlation_sql(False)))
def probability_correlation(spark, sf_dir):
    return learn.correlations(fx.predictions(spark, sf_dir), fx.PROBABILITIES)


@query(q.ask(_correlation_sql(True)))
def probability_rank_correlation(spark, sf_dir):
    return learn.correlations(fx.predictions(spark, sf_dir), fx.PROBABILITIES, ranks=True)


_SEEDS = " UNION ALL ".join(f"SELECT {s} AS seed, sample_row_id, round(topsis * 0.9 + ((sample_row_id * {31 + s} + {s}) % 97) / CAST(970 AS DOUBLE), 9) AS score FROM wide" for s in range(1, 6))


def _seeds(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    one = lambda s: wide.select(F.lit(s).alias("seed"), "sample_row_id", F.col("y_cri_high").cast("int").alias("y"), F.round(F.col("topsis") * 0.9 + ((F.col("sample_row_id") * (31 + s) + s) % 97) / 970, 9).alias("score"))
    return reduce(lambda a, b: a.unionByName(b), [one(s) for s in range(1, 6)])


@query(q.ask(f"""SELECT rate, count(*) AS pairs, round(avg(o), 9) AS mean_overlap FROM (SELECT a.rate, a.seed, b.seed AS other, count(*) / CAST(any_value(a.k) AS DOUBLE) AS o FROM top a JOIN top b ON a.sample_row_id = b.sample_row_id AND a.rate = b.rate AND a.seed < b.seed GROUP BY ALL) GROUP BY 1""",
             *q.ON_LONG, f"seeds AS ({_SEEDS})", "top AS (SELECT * FROM (SELECT *, greatest(ceil(n * rate), 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, sample_row_id) AS place, count(*) OVER (PARTITION BY seed) AS n FROM seeds), (SELECT unnest([CAST(0.01 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE)]) AS rate)) WHERE place <= k)"))
def seed_overlap(spark, sf_dir):
    return validation.seed_overlap(_seeds(spark, sf_dir), (0.01, 0.05, 0.1, 0.2))


@query(q.ask(f"""SELECT metric, count(x) AS runs, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (
    SELECT 'average_precision' AS metric, average_precision AS x FROM ({q.ap('SELECT * FROM runs', 'seed')}) UNION ALL SELECT unnest(['f1', 'ndcg']), unnest([f1, ndcg]) FROM ({q.table_at('SELECT * FROM runs', 'seed', [0.2])})) GROUP BY 1""",
             *q.ON_LONG, f"seeds AS ({_SEEDS})", "runs AS (SELECT seed, sample_row_id, score, CAST(y_cri_high AS INT) AS y FROM seeds JOIN (SELECT sample_row_id, y_cri_high FROM wide) USING (sample_row_id))"))
def seed_run_summary(spark, sf_dir):
    runs = stored(_seeds(spark, sf_dir), "seeds")
    at = metrics.threshold_table(runs, ["seed"], [0.2]).select("seed", "f1", "ndcg")
    return validation.run_summary(metrics.average_precision(runs, ["seed"]).join(at, "seed"), ("average_precision", "f1", "ndcg"))


@query("""WITH p AS (SELECT n_name AS comparison, ((n_nationkey * 37 + 5) % 101) / CAST(2000 AS DOUBLE) AS p FROM nation)
  SELECT comparison, p, round(least(max(step) OVER (ORDER BY p, comparison), 1), 9) AS holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, comparison) + 1) * p AS step FROM p)""")
def holm_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_name").alias("comparison"), (((F.col("n_nationkey") * 37 + 5) % 101) / 2000).alias("p"))
    return statistics.holm(p, "p").withColumn("holm", F.round("holm", 9))


_CUTS_SQL = " + ".join(f"CAST(u >= {c} AS INT)" for c in resampling.poisson_cuts())
_DRAWN = f"""drawn AS (SELECT iteration, strategy, score, y, {_CUTS_SQL} AS w FROM (
  SELECT l.*, four * 4 + part AS iteration, CAST('0x' || substr(md5('7|' || CAST(sample_row_id AS VARCHAR) || '|' || CAST(four AS VARCHAR)), CAST(part * 8 + 1 AS BIGINT), 8) AS BIGINT) AS u
  FROM long l, (SELECT unnest(range(0, 250)) AS four), (SELECT unnest(range(0, 4)) AS part) WHERE target = 'y_cri_high' AND y IS NOT NULL) WHERE {_CUTS_SQL} > 0)"""


def _resampled(spark, sf_dir, draw=resampling.poisson_repeats):
    long = stored(_long(spark, sf_dir).where("target = 'y_cri_high'"), "bootstrap-rows")
    return long, stored(resampling.bootstrap(long, validation.STRATEGIES, draw=draw), "bootstrap")


@query(q.ask("""SELECT iteration, strategy, round(round(coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0), 9), 6) AS average_precision, round(round(coalesce(2 * sum(tp * least(greatest(k - (cn - n), 0), n) / n) / nullif(max(k) + sum(tp), 0), 0), 9), 6) AS f1_at_rate FROM (
    SELECT *, sum(tp) OVER (PARTITION BY iteration, strategy ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY iteration, strategy ORDER BY score DESC) AS cn, ceil(sum(n) OVER (PARTITION BY iteration, strategy) * CAST(0.2 AS DOUBLE)) AS k FROM (
      SELECT CAST(iteration AS INT) AS iteration, strategy, score, CAST(sum(w * y) AS DOUBLE) AS tp, CAST(sum(w) AS DOUBLE) AS n FROM drawn GROUP BY ALL)) GROUP BY 1, 2""", *q.ON_LONG, _DRAWN))
def bootstrap_ap(spark, sf_dir):
    return _rounded(_resampled(spark, sf_dir)[1], ("average_precision", "f1_at_rate"), 6)


@query(q.ask("""SELECT strategy, round(quantile_cont(average_precision, 0.025), 6) AS low, round(quantile_cont(average_precision, 0.975), 6) AS high FROM (
    SELECT iteration, strategy, round(coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0), 9) AS average_precision FROM (
      SELECT *, sum(tp) OVER (PARTITION BY iteration, strategy ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY iteration, strategy ORDER BY score DESC) AS cn FROM (
        SELECT iteration, strategy, score, CAST(sum(w * y) AS DOUBLE) AS tp, CAST(sum(w) AS DOUBLE) AS n FROM drawn GROUP BY ALL)) GROUP BY 1, 2) GROUP BY 1""", *q.ON_LONG, _DRAWN))
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of each strategy's average precision over its resamples."""
    boot = _resampled(spark, sf_dir)[1]
    return _rounded(statistics.percentile_interval(boot, ["strategy"], "average_precision"), ("low", "high"), 6)


@query()
def bootstrap_exact(spark, sf_dir):
    """Metrics of 1,000 resamples of exactly as many rows as there are."""
    return _rounded(_resampled(spark, sf_dir, resampling.exact_repeats)[1], ("average_precision", "f1_at_rate"), 6)


@query()
def bootstrap_comparison(spark, sf_dir):
    long, boot = _resampled(spark, sf_dir, resampling.exact_repeats)
    at = metrics.threshold_table(long, ["strategy"], [0.2]).select("strategy", F.col("f1").alias("f1_at_rate"))
    return statistics.bootstrap_comparison(boot, metrics.average_precision(long, ["strategy"]).join(at, "strategy"), "raw")


_DROPS = [(n, gone) for n in (1, 2) for gone in combinations(range(len(CRITERIA)), n)]
_KEPT_SQL = " UNION ALL ".join(f"SELECT {len(g)} AS dropped_count, '{'+'.join(CRITERIA[i] for i in g)}' AS weighting, " + ", ".join(f"{q.d(0 if i in g else f'1.0 / {len(CRITERIA) - len(g)}')} AS w_{c}" for i, c in enumerate(q.C)) for g in [(), *[g for _, g in _DROPS]])


@query(q.ask(f"""SELECT dropped_count, CAST(count(*) AS BIGINT) AS choices, round(avg(d), 6) AS ap_delta_mean, round(stddev_samp(d), 6) AS ap_delta_std, round(min(d), 6) AS ap_delta_min, round(max(d), 6) AS ap_delta_max, round(avg(jaccard), 6) AS jaccard_mean, round(avg(spearman), 6) AS spearman_mean FROM (
    SELECT a.dropped_count, weighting, a.average_precision - (SELECT average_precision FROM aps WHERE weighting = '') AS d, jaccard, spearman FROM aps a JOIN (
      SELECT weighting, round(sum(CAST(p <= k AND f <= k AS INT)) / CAST(sum(CAST(p <= k OR f <= k AS INT)) AS DOUBLE), 9) AS jaccard, round(corr(r, g), 9) AS spearman FROM (
        SELECT o.weighting, o.p, b.p AS f, o.r, b.r AS g, greatest(ceil(o.n * CAST(0.2 AS DOUBLE)), 1) AS k FROM placed o JOIN placed b USING (sample_row_id) WHERE b.weighting = '' AND o.weighting <> '') GROUP BY 1) USING (weighting)) GROUP BY 1""",
             q.TEST_MINMAX, f"kept AS ({_KEPT_SQL})", f"dropped AS ({q.scored('waspas', 'SELECT n.*, k.* FROM norm n, kept k', 'normalization, weighting')})", "scores AS (SELECT dropped_count, weighting, sample_row_id, y_cri_high AS y, score FROM dropped WHERE y_cri_high IS NOT NULL)",
             f"aps AS ({q.ap('SELECT * FROM scores', 'dropped_count, weighting')})", "placed AS (SELECT weighting, sample_row_id, count(*) OVER (PARTITION BY weighting) AS n, row_number() OVER (PARTITION BY weighting ORDER BY score DESC, sample_row_id) AS p, rank() OVER (PARTITION BY weighting ORDER BY score) + (count(*) OVER (PARTITION BY weighting, score) - 1) / 2.0 AS r FROM scores)"))
def robustness_drop(spark, sf_dir):
    """Every choice of one and of two criteria left out."""
    val, test = _val_and_test(spark, sf_dir)
    rows = stored(ranking.normalized(test, val, ["minmax"]), "robustness-rows")
    return validation.robustness_summary(validation.robustness(rows, CRITERIA, "waspas", "y_cri_high", (1, 2)))


# ---- models and search


def _model_rows(spark, sf_dir):
    lot = stored(fx.with_targets(fx.lots(spark, sf_dir)), "model-rows")
    parts = [lot.where(F.col("split") == s) for s in ("train", "val", "test")]
    return learn.prepared(parts[0], parts[1:], learn.NUMERIC, learn.CATEGORICAL)


_FEATURES = (*learn.NUMERIC, *(f"{c}__c" for c in learn.CATEGORICAL))


@query()
def model_candidates(spark, sf_dir):
    train, val, _ = _model_rows(spark, sf_dir)
    return learn.all_candidates(train, val, fx.TARGETS, _FEATURES)


@query()
def model_predictions(spark, sf_dir):
    """Calibrated probabilities of all five targets for all test rows."""
    train, val, out = _model_rows(spark, sf_dir)
    for y, p in zip(fx.TARGETS, fx.PROBABILITIES, strict=True):
        _, models = learn.candidate_metrics(train, val, y, ["logistic"])
        out = learn.predicted(models["logistic"], out, p)
    return out.select("lot_id", *fx.TARGETS, *fx.PROBABILITIES)


@query(q.ask("SELECT c.sample_row_id, c.y_proc_high AS y, round(c.p_proc_high, 9) AS raw, round(f.value, 6) AS calibrated FROM crit c JOIN fitted f ON f.x = c.p_proc_high WHERE split = 'val' AND y_proc_high IS NOT NULL",
             "points AS (SELECT p_proc_high AS x, CAST(sum(y_proc_high) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM crit WHERE split = 'val' AND y_proc_high IS NOT NULL GROUP BY 1)",
             "placed AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM points)",
             # the fit at a point: of all runs that begin at it or before, the highest of the lowest means of those that end at it or later
             "means AS (SELECT j.i AS j, k.i AS i, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) AS mean FROM placed j JOIN placed k ON k.i >= j.i)",
             "lowest AS (SELECT i, min(mean) OVER (PARTITION BY j ORDER BY i DESC) AS low FROM means)",
             "fitted AS (SELECT x, max(low) AS value FROM lowest JOIN placed USING (i) GROUP BY x)"))
def isotonic_calibration(spark, sf_dir):
    long = criteria_rows(spark, sf_dir, "val").where(F.col("y_proc_high").isNotNull()).select("sample_row_id", F.col("y_proc_high").alias("y"), F.col("p_proc_high").alias("raw"))
    return learn.calibrated(learn.isotonic(long, "y", "raw"), long, "raw", "calibrated").select("sample_row_id", "y", F.round("raw", 9).alias("raw"), F.round("calibrated", 6).alias("calibrated"))


@query()
def pca_variance(spark, sf_dir):
    return learn.pca_shares(fx.predictions(spark, sf_dir), fx.PROBABILITIES)


@query()
def logistic_reestimation(spark, sf_dir):
    """All five probabilities together, each two of them, and each alone: average precision on test rows."""
    val, test = _val_and_test(spark, sf_dir)
    models = {"all five": fx.PROBABILITIES, **{"+".join(p): p for p in combinations(fx.PROBABILITIES, 2)}, **{p: (p,) for p in fx.PROBABILITIES}}
    scores = stored(learn.reestimated_models(val, test, models, "y_cri_high"), "reestimated")
    return metrics.average_precision(scores, ["model"])


@query()
def hyper_parameter_grid(spark, sf_dir):
    train, val, _ = _model_rows(spark, sf_dir)
    return learn.hyper_parameters(train, val, "y_cri_high", _FEATURES)


@query()
def nsga2_archive(spark, sf_dir):
    val = criteria_rows(spark, sf_dir, "val")
    return evolve.nsga2(ranking.normalized(val, val), population=100, generations=20)
