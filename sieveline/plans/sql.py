"""The queries' SQL for DuckDB, written from the same definitions as the plans but apart from them."""

from __future__ import annotations

from itertools import combinations

P = ["p_cri_high", "p_proc_high", "p_buyer_concentration_high", "p_single_bid", "p_no_call_for_tender"]
Y = ["y_cri_high", "y_proc_high", "y_buyer_concentration_high", "y_single_bid", "y_no_call_for_tender"]
S = ["label_cri", "label_corr_proc", "label_corr_buyer_concentration", "label_corr_singleb", "label_corr_nocft"]
C = [*P, "risk_consensus_mean", "risk_consensus_max", "uncertainty_mean", "uncertainty_max"]
NOISE = [(31, 7, 97), (37, 11, 89), (41, 13, 83), (43, 17, 79), (47, 19, 73)]
O = [f"o{i}" for i in range(1, 7)]  # noqa: E741
RATES6, RATES5 = [0.01, 0.03, 0.05, 0.10, 0.15, 0.20], [0.01, 0.03, 0.05, 0.10, 0.20]


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def known(columns) -> str:
    return " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in columns)


def total(columns) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


BASE = f"""
bid AS (SELECT l_orderkey AS lot_id, l_suppkey AS bidder, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_discount * 100) AS BIGINT) AS percent FROM lineitem),
per_lot AS (SELECT lot_id, count(*) AS lot_bidscount, count(DISTINCT bidder) AS award_criteria_count, min(part) AS first_part,
                   CAST(sum(percent) AS BIGINT) AS percent_sum, CAST(sum(cents) AS BIGINT) AS cents_sum FROM bid GROUP BY 1),
spend AS (SELECT o_custkey AS buyer, bidder, sum(cents) AS c FROM bid JOIN orders ON o_orderkey = lot_id GROUP BY 1, 2),
buyers AS (SELECT buyer, {d('max(c)')} / {d('sum(c)')} AS label_corr_buyer_concentration FROM spend GROUP BY 1),
parts AS (
  SELECT o_orderkey AS lot_id, o_custkey AS buyer, c_mktsegment AS buyer_type, n_name AS buyer_country, o_orderpriority AS procedure_type,
         o_orderstatus AS supply_type, CAST(year(o_orderdate) AS INT) AS award_year, o_totalprice, lot_bidscount, award_criteria_count,
         p_type AS cpv_code, p_brand AS cpv_group, cents_sum,
         CASE WHEN lot_bidscount IS NOT NULL THEN {d('CAST(lot_bidscount = 1 AS INT)')} END AS label_corr_singleb,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {d("CAST(o_orderstatus = 'P' AS INT)")} END AS label_corr_nocft,
         {d('percent_sum')} / (lot_bidscount * 10) AS label_corr_proc, label_corr_buyer_concentration
  FROM orders LEFT JOIN per_lot l ON o_orderkey = l.lot_id LEFT JOIN buyers b ON o_custkey = b.buyer
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON first_part = p_partkey),
lots AS (
  SELECT *, CASE WHEN {known(['label_corr_singleb', 'label_corr_nocft', 'label_corr_proc', 'label_corr_buyer_concentration'])} > 0 THEN
    ({total(['label_corr_singleb', 'label_corr_nocft', 'label_corr_proc', 'label_corr_buyer_concentration'])})
    / ({known(['label_corr_singleb', 'label_corr_nocft', 'label_corr_proc', 'label_corr_buyer_concentration'])}) END AS label_cri FROM parts),
cut AS (SELECT quantile_cont(label_corr_buyer_concentration, 0.75) AS q FROM lots),
marked AS (
  SELECT lots.*, CAST(label_cri >= {d(0.35)} AS INT) AS y_cri_high, CAST(label_corr_proc >= {d(0.5)} AS INT) AS y_proc_high,
         CAST(label_corr_buyer_concentration >= q AS INT) AS y_buyer_concentration_high, CAST(label_corr_singleb > 0 AS INT) AS y_single_bid,
         CAST(label_corr_nocft > 0 AS INT) AS y_no_call_for_tender,
         CASE WHEN (lot_id * 7919 + 104729) % 100 < 60 THEN 'train' WHEN (lot_id * 7919 + 104729) % 100 < 80 THEN 'val' ELSE 'test' END AS split
  FROM lots, cut),
preds AS (
  SELECT lot_id AS sample_row_id, split, {', '.join(Y)},
         {', '.join(f"(least(coalesce({s}, 0), 1) + {d(f'(lot_id * {a} + {b}) % {m}')} / {m}) / 2 AS {p}" for s, p, (a, b, m) in zip(S, P, NOISE, strict=True))}
  FROM marked),
crit AS (
  SELECT *, ({total(P)}) / ({known(P)}) AS risk_consensus_mean, greatest({', '.join(P)}) AS risk_consensus_max,
         ({' + '.join(f'(1 - 2 * abs({p} - 0.5))' for p in P)}) / 5 AS uncertainty_mean,
         greatest({', '.join(f'1 - 2 * abs({p} - 0.5)' for p in P)}) AS uncertainty_max,
         greatest({', '.join(Y)}) AS y_any_risk
  FROM preds)"""


def ask(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([BASE, *ctes]) + "\n" + select


def _span(lo, hi) -> str:
    return f"(CASE WHEN {hi} = {lo} THEN 1.0 ELSE {hi} - {lo} END)"


def _by(x) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1.0 ELSE {x} END)"


def normalized(rows: str, methods=("minmax", "vector", "sum", "robust"), columns=None) -> str:
    """CTEs stats and norm: rows of the table scaled by statistics of the validation rows."""
    columns = columns or C
    stats = ", ".join(
        f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, sqrt(sum({c} * {c})) AS {c}_l2, sum({c}) AS {c}_sum, quantile_cont({c}, 0.01) AS {c}_p1, quantile_cont({c}, 0.99) AS {c}_p99"
        for c in columns
    )

    def scaled(c: str, m: str) -> str:
        x, lo, hi = f"r.{c}", f"{c}_lo", f"{c}_hi"
        if m == "robust":
            lo, hi = f"{c}_p1", f"{c}_p99"
            x = f"least(greatest({x}, {lo}), {hi})"
        elif m in ("vector", "sum"):
            by = _by(f"{c}_{'l2' if m == 'vector' else 'sum'}")
            x, lo, hi = f"({x} / {by})", f"({lo} / {by})", f"({hi} / {by})"
        return f"least(greatest(({x} - {lo}) / {_span(lo, hi)}, 0), 1) AS {c}"

    parts = [f"SELECT sample_row_id, split, {', '.join(Y)}, y_any_risk, '{m}' AS normalization, {', '.join(scaled(c, m) for c in columns)} FROM ({rows}) r, stats" for m in methods]
    return f"stats AS (SELECT {stats} FROM crit WHERE split = 'val'), norm AS ({' UNION ALL '.join(parts)})"


def ap(source: str, keys: str) -> str:
    """A query: keys, average_precision."""
    return f"""SELECT {keys}, round(coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0), 9) AS average_precision FROM (
      SELECT *, sum(tp) OVER (PARTITION BY {keys} ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS cn FROM (
        SELECT {keys}, score, {d('sum(y)')} AS tp, {d('count(*)')} AS n FROM ({source}) WHERE y IS NOT NULL GROUP BY ALL)) GROUP BY {keys}"""


def auc(source: str, keys: str) -> str:
    return f"""SELECT {keys}, round((sum(CASE WHEN y = 1 THEN r END) - {d('sum(y)')} * (sum(y) + 1) / 2) / nullif({d('sum(y)')} * sum(1 - y), 0), 9) AS roc_auc FROM (
      SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r FROM ({source}) WHERE y IS NOT NULL) GROUP BY {keys}"""


def table_at(source: str, keys: str, rates) -> str:
    """A query: keys, rate, selected, precision, recall, f1, lift, ndcg."""
    return f"""SELECT {keys}, rate, CAST(k AS BIGINT) AS selected, round(coalesce(tp / k, 0), 9) AS "precision", round(coalesce(tp / greatest(pos, 1), 0), 9) AS recall,
       round(coalesce(2 * tp / nullif(k + pos, 0), 0), 9) AS f1, round(coalesce(tp / k / nullif(pos / n, 0), 0), 9) AS lift, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS ndcg
    FROM (SELECT {keys}, rate, any_value(k) AS k, any_value(n) AS n, any_value(pos) AS pos, {d('sum(CASE WHEN place <= k THEN y ELSE 0 END)')} AS tp,
                 sum(CASE WHEN place <= k THEN y / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN place <= k AND place <= pos THEN 1 / log2(place + 1) ELSE 0 END) AS ideal
          FROM (SELECT *, greatest(ceil(n * rate), 1) AS k FROM (
                  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, sample_row_id) AS place, {d(f'count(*) OVER (PARTITION BY {keys})')} AS n,
                         {d(f'sum(y) OVER (PARTITION BY {keys})')} AS pos FROM ({source}) WHERE y IS NOT NULL),
                (SELECT unnest([{', '.join(d(r) for r in rates)}]) AS rate)) GROUP BY {keys}, rate)"""


def at_own(source: str, keys: str) -> str:
    """A query: keys, precision, recall, f1, ndcg at the rate that the source's rows have in a column."""
    table = table_at(source, keys, [0.5])
    cross = f",\n                (SELECT unnest([{d(0.5)}]) AS rate)"
    assert cross in table
    return table.replace(cross, "")


def on_test() -> tuple[str, ...]:
    """CTEs norm_t and every_t: what norm and every of grid() are, for test rows."""
    norm = normalized("SELECT * FROM crit WHERE split = 'test'").split(", norm AS (", 1)[1]
    wide = f"wide_t AS (SELECT n.*, weighting, {', '.join(f'w.{c} AS w_{c}' for c in C)} FROM norm_t n JOIN weights w USING (normalization))"
    every = " UNION ALL ".join(f"SELECT normalization, weighting, '{m}' AS method, sample_row_id, score FROM ({scored(m, 'SELECT * FROM wide_t', KEYS)})" for m in ("topsis", "vikor", "edas", "cocoso", "waspas"))
    return (f"norm_t AS ({norm}", wide, f"every_t AS ({every})")


def configurations(split: str) -> tuple[str, ...]:
    """CTEs conf (decoded configurations) and runs (their scores on a split's rows), after normalized() of those rows."""
    k, methods, norms = "n_nationkey", "['topsis', 'vikor', 'edas', 'cocoso', 'waspas']", "['minmax', 'vector', 'sum', 'robust']"
    taken = [f"CASE WHEN ({k} * 7 + {i} * 5) % 9 < {k} % 7 + 3 THEN {d(f'({k} * ({i} + 3) + {i}) % 11 + 1')} ELSE 0 END" for i in range(len(C))]
    total = "(" + " + ".join(taken) + ")"
    conf = f"""conf AS (SELECT CAST({k} AS BIGINT) AS seq, CAST({k} % 5 AS INT) AS algorithm, {methods}[CAST({k} % 5 + 1 AS INT)] AS method, {norms}[CAST(({k} // 5) % 4 + 1 AS INT)] AS normalization,
      {d(f'{k} % 8 + 2')} / 100 AS rate, {d(' + '.join(f'CAST(({k} * 7 + {i} * 5) % 9 < {k} % 7 + 3 AS INT)' for i in range(len(C))))} / {len(C)} AS criteria_share,
      {', '.join(f'{t} / {total} AS w_{c}' for t, c in zip(taken, C, strict=True))} FROM nation)"""
    rows = f"SELECT n.*, seq, rate, {', '.join(f'c.w_{c} AS w_{c}' for c in C)} FROM norm n JOIN conf c USING (normalization) WHERE c.method = "
    every = [scored(m, f"{rows}'{m}'", "seq") for m in ("topsis", "vikor", "edas", "cocoso", "waspas")]
    runs = " UNION ALL ".join(f"SELECT seq, rate, sample_row_id, y_cri_high, y_any_risk, score FROM ({s})" for s in every)
    return (normalized(f"SELECT * FROM crit WHERE split = '{split}'"), conf, f"runs AS ({runs})", "labelled AS (SELECT seq, rate, sample_row_id, CAST(y_cri_high AS INT) AS y, score FROM runs)")


def best_at(source: str, keys: str, rates) -> str:
    return f"""SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY f1 DESC, ndcg DESC, "precision" DESC, rate) AS z FROM ({table_at(source, keys, rates)})) WHERE z = 1"""


def _cumulative(parts) -> str:
    return " + ".join(parts)


def weight_query(method: str) -> str:
    """normalization, weighting and a weight per criterion, from the table learn."""
    if method == "equal":
        return f"SELECT DISTINCT normalization, 'equal' AS weighting, {', '.join(f'{d(1)} / {len(C)} AS {c}' for c in C)} FROM learn"
    if method == "entropy":
        raw = f"""SELECT normalization, {', '.join(f'1 - (-sum({c}_x / {c}_s * ln({c}_x / {c}_s))) / ln(any_value(n)) AS {c}' for c in C)} FROM (
          SELECT normalization, count(*) OVER w AS n, {', '.join(f'greatest({c}, 1e-12) AS {c}_x, greatest(sum(greatest({c}, 1e-12)) OVER w, 1e-12) AS {c}_s' for c in C)}
          FROM learn WINDOW w AS (PARTITION BY normalization)) GROUP BY 1"""
    elif method == "critic":
        cov = lambda a, b: f"covar_pop({a}, {b})"
        corr = lambda a, b: f"(CASE WHEN {cov(a, a)} > 1e-18 AND {cov(b, b)} > 1e-18 THEN {cov(a, b)} / sqrt({cov(a, a)} * {cov(b, b)}) ELSE 0 END)"
        raw = "SELECT normalization, " + ", ".join(f"sqrt({cov(a, a)}) * ({_cumulative(f'(1 - {corr(a, b)})' for b in C)}) AS {a}" for a in C) + " FROM learn GROUP BY 1"
    else:
        long = " UNION ALL ".join(f"SELECT normalization, '{c}' AS criterion, y_cri_high AS y, round({c}, 9) AS score FROM learn" for c in C)
        raw = f"SELECT normalization, {', '.join(f'''max(CASE WHEN criterion = '{c}' THEN average_precision END) AS {c}''' for c in C)} FROM ({ap(long, 'normalization, criterion')}) GROUP BY 1"
    sums = _cumulative(C)
    return f"SELECT normalization, '{method}' AS weighting, {', '.join(f'CASE WHEN abs({sums}) <= 1e-8 THEN {d(1)} / {len(C)} ELSE {c} / ({sums}) END AS {c}' for c in C)} FROM ({raw})"


def scored(method: str, source: str, keys: str, columns=None) -> str:
    """A query: the source's columns but criteria and weights, and score. source has criteria c and weights w_c."""
    columns = columns or C
    w = f"WINDOW w AS (PARTITION BY {keys})"
    gone = ", ".join([*columns, *[f"w_{c}" for c in columns]])
    clip = {c: f"least(greatest({c}, 1e-9), 1)" for c in columns}
    if method == "topsis":
        wide = f"SELECT *, {', '.join(f'max({c} * w_{c}) OVER w AS {c}_hi, min({c} * w_{c}) OVER w AS {c}_lo' for c in columns)} FROM ({source}) {w}"
        far = {n: "sqrt(" + _cumulative(f"({c} * w_{c} - {c}_{n}) * ({c} * w_{c} - {c}_{n})" for c in columns) + ")" for n in ("hi", "lo")}
        raw = f"SELECT *, {far['lo']} / greatest({far['hi']} + {far['lo']}, 1e-12) AS raw FROM ({wide})"
        gone += "".join(f", {c}_hi, {c}_lo" for c in columns)
    elif method == "vikor":
        wide = f"SELECT *, {', '.join(f'max({c}) OVER w AS {c}_hi, min({c}) OVER w AS {c}_lo' for c in columns)} FROM ({source}) {w}"
        regret = [f"w_{c} * ({c}_hi - {c}) / {_span(f'{c}_lo', f'{c}_hi')}" for c in columns]
        both = f"SELECT *, {_cumulative(regret)} AS s_, greatest({', '.join(regret)}) AS r_ FROM ({wide})"
        part = lambda x: f"({x} - min({x}) OVER w) / greatest(max({x}) OVER w - min({x}) OVER w, 1e-12)"
        raw = f"SELECT *, 1 - (0.5 * {part('s_')} + 0.5 * {part('r_')}) AS raw FROM ({both}) {w}"
        gone += ", s_, r_" + "".join(f", {c}_hi, {c}_lo" for c in columns)
    elif method == "edas":
        wide = f"SELECT *, {', '.join(f'greatest(avg({c}) OVER w, 1e-12) AS {c}_m' for c in columns)} FROM ({source}) {w}"
        off = lambda s: _cumulative(f"w_{c} * greatest({s} * ({c} - {c}_m), 0) / {c}_m" for c in columns)
        both = f"SELECT *, {off('1')} AS p_, {off('(-1)')} AS n_ FROM ({wide})"
        raw = f"SELECT *, 0.5 * (p_ / greatest(max(p_) OVER w, 1e-12) + 1 - n_ / greatest(max(n_) OVER w, 1e-12)) AS raw FROM ({both}) {w}"
        gone += ", p_, n_" + "".join(f", {c}_m" for c in columns)
    elif method == "cocoso":
        both = f"SELECT *, {_cumulative(f'{clip[c]} * w_{c}' for c in columns)} AS s_, {_cumulative(f'(CASE WHEN w_{c} > 0 THEN pow({clip[c]}, w_{c}) ELSE 0 END)' for c in columns)} AS p_ FROM ({source})"
        parts = f"""SELECT *, (s_ + p_) / greatest(sum(s_ + p_) OVER w, 1e-12) AS a_, s_ / greatest(min(s_) OVER w, 1e-12) + p_ / greatest(min(p_) OVER w, 1e-12) AS b_,
          (0.5 * s_ + 0.5 * p_) / greatest(0.5 * max(s_) OVER w + 0.5 * max(p_) OVER w, 1e-12) AS k_ FROM ({both}) {w}"""
        raw = f"SELECT *, cbrt(greatest(a_ * b_ * k_, 0)) + (a_ + b_ + k_) / 3 AS raw FROM ({parts})"
        gone += ", s_, p_, a_, b_, k_"
    else:
        raw = f"SELECT *, 0.5 * ({_cumulative(f'{clip[c]} * w_{c}' for c in columns)}) + 0.5 * ({' * '.join(f'pow({clip[c]}, w_{c})' for c in columns)}) AS raw FROM ({source})"
    return f"""SELECT * EXCLUDE (raw, lo, hi, {gone}), round((raw - lo) / {_span('lo', 'hi')}, 9) AS score FROM (
      SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM ({raw}) {w})"""


EQUAL_TEST = f"SELECT *, 'equal' AS weighting, {', '.join(f'{d(1)} / {len(C)} AS w_{c}' for c in C)} FROM norm"
TEST_MINMAX = normalized("SELECT * FROM crit WHERE split = 'test'", ["minmax"])
KEYS = "normalization, weighting"
RANKED = f"ranked AS ({scored('topsis', EQUAL_TEST, KEYS)})"
#: strategy, target, sample_row_id, y, score over test rows
LONG = f"""wide AS (SELECT c.*, r.score AS topsis FROM crit c JOIN ranked r USING (sample_row_id)),
long AS ({' UNION ALL '.join(
    f"SELECT '{n}' AS strategy, '{t}' AS target, sample_row_id, CAST({t} AS INT) AS y, round({e}, 9) AS score FROM wide"
    for n, e in (('raw', 'p_cri_high'), ('baseline', 'topsis'), ('consensus', 'risk_consensus_mean')) for t in ('y_cri_high', 'y_any_risk'))})"""
ON_LONG = (TEST_MINMAX, RANKED, LONG)
ST = "strategy, target"


def grid() -> tuple[str, ...]:
    """CTEs of the configurations' performance on validation rows."""
    learn = "learn AS (SELECT * FROM norm WHERE y_cri_high IS NOT NULL)"
    weights = "weights AS (" + " UNION ALL ".join(weight_query(m) for m in ("equal", "entropy", "critic", "validation_ap")) + ")"
    wide = f"wide AS (SELECT n.*, weighting, {', '.join(f'w.{c} AS w_{c}' for c in C)} FROM norm n JOIN weights w USING (normalization))"
    every = "every AS (" + " UNION ALL ".join(
        f"SELECT normalization, weighting, '{m}' AS method, sample_row_id, y_cri_high, y_any_risk, score FROM ({scored(m, 'SELECT * FROM wide', KEYS)})" for m in ("topsis", "vikor", "edas", "cocoso", "waspas")
    ) + ")"
    keys = "normalization, weighting, method"
    pieces, joins = [], []
    for t in ("y_cri_high", "y_any_risk"):
        source = f"SELECT {keys}, sample_row_id, {t} AS y, score FROM every"
        pieces += [f"ap_{t} AS ({ap(source, keys)})", f"best_{t} AS ({best_at(source, keys, RATES6)})"]
        joins += [f"ap_{t}", f"best_{t}"]
    score = "0.35 * best_y_cri_high.f1 + 0.25 * best_y_cri_high.ndcg + 0.20 * ap_y_cri_high.average_precision + 0.10 * best_y_any_risk.f1 + 0.10 * best_y_any_risk.ndcg"
    perf = f"""perf AS (SELECT {keys}, ap_y_cri_high.average_precision AS primary_ap, best_y_cri_high.rate AS primary_rate, best_y_cri_high.f1 AS primary_f1, best_y_cri_high.ndcg AS primary_ndcg,
      ap_y_any_risk.average_precision AS any_ap, best_y_any_risk.f1 AS any_f1, best_y_any_risk.ndcg AS any_ndcg, round({score}, 8) AS selection_score
      FROM {joins[0]} {' '.join(f'JOIN {j} USING ({keys})' for j in joins[1:])})"""
    return (normalized("SELECT * FROM crit WHERE split = 'val'"), learn, weights, wide, every, *pieces, perf)


def _mod(a, b, m) -> str:
    return f"((k * {a} + {b}) % {m})"


ARCHIVE = f"""
src AS (SELECT s_suppkey AS k, {d('s_nationkey')} AS nk, unnest(CASE WHEN s_suppkey % 10 = 0 THEN [0, 1] ELSE [0] END) AS dd FROM supplier),
archive AS (SELECT k * 2 + dd AS seq, (k + dd) % 5 AS algorithm, {d(_mod(37, 11, 101))} / 101 AS o1, {d(_mod(53, 7, 97))} / 97 AS o2,
   {d(_mod(37, 11, 101) + ' + ' + _mod(29, 3, 13))} / 114 AS o3, {d(_mod(53, 7, 97) + ' + ' + _mod(17, 5, 11))} / 108 AS o4,
   {d(0.01)} + {d(0.19)} * nk / 24 AS o5, {d('3 + k % 7')} / 9 AS o6 FROM src),
uniq AS (SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(f"format('{{:.5f}}', {o})" for o in O)} ORDER BY seq) AS z FROM archive) WHERE z = 1),
front AS (SELECT * FROM uniq a WHERE NOT EXISTS (SELECT 1 FROM uniq b WHERE {' AND '.join(f'b.{o} <= a.{o}' for o in O)} AND ({' OR '.join(f'b.{o} < a.{o}' for o in O)}))),
scaled AS (SELECT seq, algorithm, {', '.join(f'({o} - min({o}) OVER ()) / {_span(f"min({o}) OVER ()", f"max({o}) OVER ()")} AS {o}' for o in O)} FROM front)"""
TARGET = [0.30, 0.20, 0.20, 0.15, 0.10, 0.05]
_SUM_O = " + ".join(f"(1 - {o})" for o in O)
PSEUDO = f"pseudo AS (SELECT *, {', '.join(f'CASE WHEN {_SUM_O} = 0 THEN {d(1)} / 6 ELSE (1 - {o}) / ({_SUM_O}) END AS w_{o}' for o in O)} FROM scaled)"


def on_archive(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([ARCHIVE, *ctes]) + "\n" + select


def norm_of(terms) -> str:
    return "round(sqrt(" + " + ".join(f"({t}) * ({t})" for t in terms) + "), 9)"


def perturbed() -> list[tuple[str, list[float]]]:
    out = [("base", TARGET)]
    for i in range(6):
        for f in (0.5, 1.5):
            v = [w * (f if j == i else 1) for j, w in enumerate(TARGET)]
            out.append((f"o{i + 1}x{f}", [w / sum(v) for w in v]))
    return out


ROUNDED = lambda cs, n=9: ", ".join(f"round({c}, {n}) AS {c}" for c in cs)


def encoding(where: str, key: str) -> str:
    m, v = "(s / n)", "(s / n * (1 - s / n))"
    gm, gv = "(gs / gn)", "(gs / gn * (1 - gs / gn))"
    return f"""SELECT {key} AS key, CAST(n AS BIGINT) AS n, round(coalesce((n * {gv} * {m} + {v} * {gm}) / nullif(n * {gv} + {v}, 0), {gm}), 9) AS encoding, round({gm}, 9) AS global_mean
      FROM (SELECT {key}, {d('count(*)')} AS n, {d('sum(y_proc_high)')} AS s FROM ({where}) GROUP BY 1), (SELECT {d('count(*)')} AS gn, {d('sum(y_proc_high)')} AS gs FROM ({where}))"""


TRAIN = "SELECT *, CAST((lot_id * 31 + 17) % 5 AS INT) AS fold, coalesce(procedure_type, 'missing') || '||' || coalesce(buyer_type, 'missing') AS pair FROM marked WHERE split = 'train' AND y_proc_high IS NOT NULL"


def oof() -> str:
    m, v, gm, gv = "(s / n)", "(s / n * (1 - s / n))", "(gs / gn)", "(gs / gn * (1 - gs / gn))"
    return f"""SELECT fold, key, round(CASE WHEN n > 0 THEN coalesce((n * {gv} * {m} + {v} * {gm}) / nullif(n * {gv} + {v}, 0), {gm}) ELSE {gm} END, 9) AS encoding FROM (
      SELECT f.fold, k.key, {d('k.n - coalesce(c.n, 0)')} AS n, {d('k.s - coalesce(c.s, 0)')} AS s, {d('(SELECT count(*) FROM train) - f.n')} AS gn, {d('(SELECT sum(y_proc_high) FROM train) - f.s')} AS gs
      FROM (SELECT procedure_type AS key, count(*) AS n, sum(y_proc_high) AS s FROM train GROUP BY 1) k
      CROSS JOIN (SELECT fold, count(*) AS n, sum(y_proc_high) AS s FROM train GROUP BY 1) f
      LEFT JOIN (SELECT fold, procedure_type AS key, count(*) AS n, sum(y_proc_high) AS s FROM train GROUP BY 1, 2) c ON c.fold = f.fold AND c.key = k.key)"""


PAIRS = list(combinations(P, 2))
