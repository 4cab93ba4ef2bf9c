"""Feature preparation, exact LOF and the isolation forest as SQL, for tenders and the three portraits."""

from __future__ import annotations

from tendersift.operators.iforest import CUT_STEPS, FIXED, PRIME, Y_STEPS, height_of
from tendersift.plans.q_portraits import BUYER_SQL, PAIR_SQL, SUPPLIER_SQL
from tendersift.plans.rules_sql import level_sql
from tendersift.schemas import LOG_FEATURES, ML_FEATURES, SEED

KEYS = {"tender": ("tender_id",), "buyer": ("buyer_id",), "supplier": ("supplier_id",), "pair": ("buyer_id", "supplier_id"), "wide": ("tender_id",)}
_MEDIANS = ", cpv_m AS (SELECT main_cpv_2_digit AS cpv, median(award_value) AS md FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)"
_RATIO = "CASE WHEN md IS NOT NULL THEN coalesce(award_value, 0) / greatest(md, 1) END AS value_vs_cpv_median"
_OWN = [f for f in ML_FEATURES["tender"] if f != "value_vs_cpv_median"]
_TENDER = f", tender_p AS (SELECT tender_id, buyer_id, supplier_id, {', '.join(_OWN)}, {_RATIO} FROM tenders LEFT JOIN cpv_m ON main_cpv_2_digit = cpv)"
_OF_SUPPLIER = [f for f in ML_FEATURES["supplier"] if f not in ML_FEATURES["buyer"]]
WIDE_FEATURES = (*ML_FEATURES["tender"], *ML_FEATURES["buyer"], *_OF_SUPPLIER)
_WIDE = f""", wide_p AS (SELECT t.*, {', '.join(f'b.{f}' for f in ML_FEATURES['buyer'])}, {', '.join(f's.{f}' for f in _OF_SUPPLIER)}
FROM tender_p t LEFT JOIN buyer_p b ON t.buyer_id = b.buyer_id LEFT JOIN supplier_p s ON t.supplier_id = s.supplier_id)"""
#: Tables that features are taken from; portraits without a key of their own are left out.
SOURCES = {
    "buyer": (BUYER_SQL, "buyer_p WHERE buyer_id IS NOT NULL"), "supplier": (SUPPLIER_SQL, "supplier_p WHERE supplier_id IS NOT NULL"),
    "pair": (PAIR_SQL, "pair_p WHERE contracts_count >= 3 AND buyer_id IS NOT NULL AND supplier_id IS NOT NULL"),
    "tender": (_MEDIANS + _TENDER, "tender_p"), "wide": (_WIDE, "wide_p"),
}
FEATURES = {**ML_FEATURES, "wide": WIDE_FEATURES}


def _log(f: str) -> str:
    return f"ln(1 + greatest({f}, 0)::DOUBLE)" if f in LOG_FEATURES else f"{f}::DOUBLE"


def scaled_sql(level: str) -> str:
    """Continues a WITH clause that has the portrait: table z_<level> (id, keys, v list)."""
    keys, features = KEYS[level], FEATURES[level]
    scaled = ", ".join(f"({f} - {f}_q2) / CASE WHEN {f}_q3 = {f}_q1 THEN 1 ELSE {f}_q3 - {f}_q1 END" for f in features)
    return f""", lg0_{level} AS (SELECT {', '.join(keys)}, {', '.join(f'{_log(f)} AS {f}' for f in features)} FROM {SOURCES[level][1]})
, md_{level} AS (SELECT {', '.join(f'median({f}) AS {f}_m' for f in features)} FROM lg0_{level})
, lg_{level} AS (SELECT {', '.join(keys)}, {', '.join(f'coalesce({f}, {f}_m, 0) AS {f}' for f in features)} FROM lg0_{level}, md_{level})
, mq_{level} AS (SELECT {', '.join(f'quantile_cont({f}, {q}) AS {f}_q{i}' for f in features for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM lg_{level})
, z_{level} AS MATERIALIZED (SELECT {', '.join(keys)}, concat_ws('|', {', '.join(keys)}) AS name, {'concat_ws(chr(124), ' + ', '.join(keys) + ')' if len(keys) > 1 else keys[0]} AS id, [{scaled}] AS v FROM lg_{level}, mq_{level})
"""


def finished_sql(table: str, raw: str, keys: tuple[str, ...]) -> str:
    """<table>: keys, raw, score between the 1st and 99th percentile, label of the top 5 %, level."""
    return f""", {table}_q AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi, quantile_cont(raw, 0.95) AS lim FROM {raw})
, {table}_0 AS (SELECT {', '.join(keys)}, raw, (least(greatest(raw, lo), hi) - lo) / (hi - lo + 1e-10) AS score, cast(raw > lim AS INT) AS anomaly FROM {raw}, {table}_q)
, {table} AS MATERIALIZED (SELECT *, {level_sql("score", (0, 0.5, 0.75, 0.9, 1.01))} AS risk_level FROM {table}_0)
"""


def lof_sql(level: str, k: int = 20) -> str:
    """Table lof_<level>. Equal vectors go by their smallest id, as the operator keeps them once."""
    keys, n = KEYS[level], level
    named = ", ".join(f"any_value(z.{c}) AS {c}" for c in keys)
    return f""", lc_{n} AS (SELECT *, min(id) OVER (PARTITION BY v) AS cls FROM z_{n})
, nn_{n} AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM lc_{n} a JOIN lc_{n} b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.cls <> a.cls, b.cls, b.id) <= {k})
, kd_{n} AS (SELECT a, max(d) AS kdist FROM nn_{n} GROUP BY 1)
, lrd_{n} AS (SELECT nn_{n}.a, 1 / (avg(greatest(d, kd_{n}.kdist)) + 1e-10) AS lrd FROM nn_{n} JOIN kd_{n} ON nn_{n}.b = kd_{n}.a GROUP BY 1)
, lofr_{n} AS (SELECT {named}, avg(o.lrd) / max(s.lrd) AS raw FROM nn_{n} JOIN lrd_{n} o ON nn_{n}.b = o.a JOIN lrd_{n} s ON nn_{n}.a = s.a JOIN z_{n} z ON z.id = nn_{n}.a GROUP BY nn_{n}.a)
""" + finished_sql(f"lof_{n}", f"lofr_{n}", keys)


def _steps(table: str, k: str, t: str, out: str) -> str:
    """``table`` with a column ``out``: the draw, computed step by step."""
    return (f"SELECT * EXCLUDE (x_), (x_ * x_ + x_) % {PRIME} AS {out} FROM (SELECT * REPLACE ((x_ * 16807 + {t} * 31 + 11) % {PRIME} AS x_) FROM "
            f"(SELECT * REPLACE ((x_ * x_ + {k} % 1000003 + 7) % {PRIME} AS x_) FROM (SELECT *, ({k} % {PRIME} * 48271 + {t} * 69621 + {SEED}) % {PRIME} AS x_ FROM {table})))")


def _hex(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def forest_sql(level: str, n_trees: int = 100, sample: int = 256) -> str:
    """Tables fn_<level> (nodes) and if_<level> (scores of all rows), grown level by level."""
    n, m, height = level, len(FEATURES[level]), height_of(sample)
    lo, hi = (f"[{', '.join(f'{f}(v[{i + 1}])' for i in range(m))}]" for f in ("min", "max"))
    out = f""", fk_{n} AS MATERIALIZED ({_steps(f"(SELECT id, v, {_hex('name')} AS k, count(*) OVER () AS total FROM z_{n})", 'k', str(n_trees), 'y0')})
, fd_{n} AS (SELECT * FROM ({_steps(f"(SELECT f.k, f.total, f.v, (y0 % {Y_STEPS}) / {float(Y_STEPS)}::DOUBLE AS y, t FROM fk_{n} f, range({n_trees}) r(t))", 'k', 't', 'h')})
  WHERE h < trunc({PRIME} * least(1.0::DOUBLE, {6 * sample} / total::DOUBLE)))
, s0_{n} AS MATERIALIZED (SELECT t, y, v, 1::BIGINT AS node FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY h, k) AS rn FROM fd_{n}) WHERE rn <= least({sample}, total))
"""
    nodes = []
    for d in range(height + 1):
        f_number, u_number = (_hex(f"concat_ws('|', {SEED}, t, node, '{use}')") for use in "fu")
        feature = f"CASE WHEN {d} < (SELECT ceil(log2(greatest(least({sample}, count(*)), 2))) FROM z_{n}) AND n >= 2 AND len(op) > 0 THEN op[({f_number} % greatest(len(op), 1))::INT + 1] END"
        out += f""", g{d}_{n} AS (SELECT t, node, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, {lo} AS lo, {hi} AS hi FROM s{d}_{n} GROUP BY 1, 2)
, h{d}_{n} AS (SELECT *, list_filter(range({m}), lambda i: hi[i + 1] > lo[i + 1]) AS op FROM g{d}_{n})
, c{d}_{n} AS MATERIALIZED (SELECT *, lo[feature + 1] + (hi[feature + 1] - lo[feature + 1]) * (({u_number} % {CUT_STEPS}) / {float(CUT_STEPS)}::DOUBLE) AS cut FROM (SELECT *, {feature} AS feature FROM h{d}_{n}))
"""
        nodes.append(f"SELECT t, node, {d} AS depth, n, syy / n - (sy / n) * (sy / n) AS variance, feature, cut FROM c{d}_{n}")
        if d < height:
            out += f", s{d + 1}_{n} AS MATERIALIZED (SELECT s.t, y, v, 2 * s.node + (v[feature + 1] > cut)::BIGINT AS node FROM s{d}_{n} s JOIN c{d}_{n} c ON s.t = c.t AND s.node = c.node WHERE feature IS NOT NULL)\n"
    rest = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1) / n::DOUBLE WHEN n = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    out += f", fn_{n} AS MATERIALIZED ({' UNION ALL '.join(nodes)})\n"
    out += f", p0_{n} AS (SELECT id, t, 1::BIGINT AS node, v FROM z_{n}, range({n_trees}) r(t))\n"
    ends = []
    for d in range(height + 1):
        ends.append(f"SELECT id, {d} * {FIXED}::BIGINT + round({rest} * {FIXED})::BIGINT AS path FROM e{d}_{n} WHERE feature IS NULL")
        out += f", e{d}_{n} AS MATERIALIZED (SELECT p.id, p.t, p.node, p.v, n, feature, cut FROM p{d}_{n} p JOIN fn_{n} f ON p.t = f.t AND p.node = f.node)\n"
        if d < height:
            out += f", p{d + 1}_{n} AS (SELECT id, t, 2 * node + (v[feature + 1] > cut)::BIGINT AS node, v FROM e{d}_{n} WHERE feature IS NOT NULL)\n"
    out += f""", fp_{n} AS (SELECT id, sum(path) AS path FROM ({' UNION ALL '.join(ends)}) GROUP BY 1)
, fr_{n} AS (SELECT {', '.join('z.' + c for c in KEYS[level])}, pow(2.0::DOUBLE, -(path / {float(FIXED)}::DOUBLE) / (SELECT count(DISTINCT t) FROM fn_{n}) /
  (SELECT CASE WHEN r = 0 THEN 1 ELSE r END FROM (SELECT {rest} AS r FROM (SELECT max(n) AS n FROM fn_{n} WHERE node = 1)))) AS raw FROM fp_{n} JOIN z_{n} z USING (id))
"""
    return out + finished_sql(f"if_{n}", f"fr_{n}", KEYS[level])


def importance_sql(level: str) -> str:
    """Query text: feature and mean share of the variance that splits take away."""
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES[level]))
    return f""", gain AS (SELECT p.t, p.feature, p.n * p.variance - c.below AS gain FROM fn_{level} p
  JOIN (SELECT t, node // 2 AS node, sum(n * variance) AS below FROM fn_{level} GROUP BY 1, 2) c ON p.t = c.t AND p.node = c.node WHERE p.feature IS NOT NULL)
, per AS (SELECT t, feature, sum(gain) AS gain FROM gain GROUP BY 1, 2)
, share AS (SELECT feature, gain / nullif(sum(gain) OVER (PARTITION BY t), 0) AS share FROM per)
SELECT f.name AS feature, round(coalesce(sum(share), 0) / (SELECT count(DISTINCT t) FROM fn_{level}), 6) AS importance
FROM (VALUES {names}) f(i, name) LEFT JOIN share ON i = feature GROUP BY 1"""


BUYER_Z = BUYER_SQL + scaled_sql("buyer")
LOF = BUYER_Z + lof_sql("buyer") + ", lof AS (SELECT * FROM lof_buyer)\n"
SUPPLIER_LOF = SUPPLIER_SQL + scaled_sql("supplier") + lof_sql("supplier")
PAIR_LOF = PAIR_SQL + scaled_sql("pair") + lof_sql("pair")
FOREST = SOURCES["tender"][0] + scaled_sql("tender") + forest_sql("tender")
BUYER_FOREST = BUYER_Z + forest_sql("buyer")
SUPPLIER_FOREST = SUPPLIER_SQL + scaled_sql("supplier") + forest_sql("supplier")
PAIR_FOREST = PAIR_SQL + scaled_sql("pair") + forest_sql("pair")
WIDE_FOREST = SOURCES["tender"][0] + BUYER_SQL + SUPPLIER_SQL + _WIDE + scaled_sql("wide") + forest_sql("wide")
