"""Sequence and horizon window queries (F1-F13) on the prepared ragged panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..operators import windows as W
from ..plans.base import KEYS, TARGETS, VARS
from ..plans.prepare import prepare_sequence
from ..session import stored
from . import register
from .q_features import RP, RP_COLS, rp
from .sqlfrag import interp_select, lags_select, nn

PART = "PARTITION BY model, scenario, region ORDER BY year"
SPART = "PARTITION BY model, scenario, region ORDER BY step"
GRP = "PARTITION BY model, scenario, region"
K = "model, scenario, region"
PREV = [f"prev_{t}" for t in TARGETS]
PREV2 = [f"prev2_{t}" for t in TARGETS]
SEQ_DOUBLES = VARS + PREV + PREV2
L, OFF = 3, 1
X = ["promo", "small"]

SQ = RP + f""",
filled AS ({interp_select('rp', TARGETS, RP_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2),
kept AS (SELECT * FROM hist WHERE {nn(TARGETS)}),
sq AS (SELECT *, CAST(row_number() OVER ({PART}) - 1 AS BIGINT) AS step,
  CAST(coalesce(year - lag(year) OVER ({PART}), 0) AS INT) AS delta_years FROM kept)"""


def sq(spark, sf_dir):
    return prepare_sequence(rp(spark, sf_dir), TARGETS, KEYS, n_lags=2)


def _frame(n):
    return f"{PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


_SEQ_SQL = SQ + f""",
fm AS (SELECT * REPLACE ({', '.join(f'coalesce(CAST({x} AS DOUBLE), -1.0) AS {x}' for x in X)}) FROM sq),
b AS (SELECT *, row_number() OVER ({PART}) AS _rn, count(*) OVER ({GRP}) AS _n,
        ({' AND '.join(f'coalesce({x} <> -1.0, true)' for x in X)}) AS _valid FROM fm),
s AS (SELECT {K}, CAST(_rn - {L} AS BIGINT) AS start,
  {', '.join(f'list({x}) OVER ({_frame(L)}) AS x_{x}' for x in X)},
  {', '.join(f'list({t}) OVER ({_frame(L)}) AS hist_{t}' for t in TARGETS)},
  list(_valid) OVER ({_frame(L)}) AS mask,
  {', '.join(f'lead({t}, {OFF}) OVER ({PART}) AS y_{t}' for t in TARGETS)}, _rn, _n FROM b),
seqs AS (SELECT * EXCLUDE (_rn, _n) FROM s WHERE _rn >= {L} AND _rn + {OFF} <= _n)"""


def seqs(spark, sf_dir):
    filled = D.fill_mask(sq(spark, sf_dir), X)
    return W.sequences(filled, X, TARGETS, KEYS, "year", L, OFF)


@register("f1_sequences", _SEQ_SQL + " SELECT * FROM seqs", doubles=[f"y_{t}" for t in TARGETS],
          double_arrays=[f"x_{x}" for x in X] + [f"hist_{t}" for t in TARGETS])
def f1_sequences(spark, sf_dir):
    return seqs(spark, sf_dir)


@register("f2_previous_targets", _SEQ_SQL + f" SELECT {K}, start, "
          + ", ".join(f"hist_{t}" for t in TARGETS) + ", mask FROM seqs",
          double_arrays=[f"hist_{t}" for t in TARGETS])
def f2_previous_targets(spark, sf_dir):
    return seqs(spark, sf_dir).select(*KEYS, "start", *[f"hist_{t}" for t in TARGETS], "mask")


@register("f3_align_sequence_preds", _SEQ_SQL + f""",
pr AS (SELECT {K}, start + {L - 1 + OFF} AS _pos, {', '.join(f'list_sum(hist_{t}) / {L} AS pred_{t}' for t in TARGETS)} FROM seqs),
r AS (SELECT *, CAST(row_number() OVER ({PART}) - 1 AS BIGINT) AS _pos FROM sq)
SELECT r.* EXCLUDE (_pos), {', '.join(f'pr.pred_{t}' for t in TARGETS)} FROM r LEFT JOIN pr
  ON r.model = pr.model AND r.scenario = pr.scenario AND r.region = pr.region AND r._pos = pr._pos""",
          doubles=SEQ_DOUBLES + [f"pred_{t}" for t in TARGETS])
def f3_align_sequence_preds(spark, sf_dir):
    s = seqs(spark, sf_dir)
    preds = s.select(*KEYS, "start", *[(F.aggregate(f"hist_{t}", F.lit(0.0), lambda a, x: a + x) / L)
                                       .alias(f"pred_{t}") for t in TARGETS])
    return W.align_sequence_preds(sq(spark, sf_dir), preds, KEYS, "year", L, OFF,
                                  [f"pred_{t}" for t in TARGETS])


ENC, MAXDEC, MINDEC = 3, 12, 1
_EDB = f"""edb AS (SELECT {K}, year, economy, large, medium, row_number() OVER ({PART}) - 1 AS _j,
  count(*) OVER ({GRP}) AS _n FROM sq)"""
_ED_ALL = SQ + f""", {_EDB},
c AS (SELECT *, unnest(generate_series(_j - {MAXDEC - 1}, _j + {ENC})) AS _i FROM edb)
SELECT {K}, CAST(_i AS BIGINT) AS sample, CAST(_j - _i AS INT) AS rel, year, economy, large, medium FROM c
WHERE _i >= {ENC} AND _i < _n AND least({MAXDEC}, _n - _i) >= {MINDEC} AND _j <= _i + least({MAXDEC}, _n - _i) - 1"""
_ED_LAST_BODY = f"""SELECT {K}, CAST(_i AS BIGINT) AS sample, CAST(_j - _i AS INT) AS rel, year, economy, large, medium
FROM (SELECT *, _n - least({MAXDEC}, _n - {ENC}) AS _i FROM edb) c
WHERE _n - {ENC} >= {MINDEC} AND _j >= _i - {ENC}"""


@register("f4_encoder_decoder_windows", _ED_ALL, doubles=TARGETS)
def f4_encoder_decoder_windows(spark, sf_dir):
    return W.encoder_decoder_windows(sq(spark, sf_dir), KEYS, "year", TARGETS, ENC, MAXDEC, MINDEC, "all")


@register("f4_encoder_decoder_last", SQ + f", {_EDB} " + _ED_LAST_BODY, doubles=TARGETS)
def f4_encoder_decoder_last(spark, sf_dir):
    return W.encoder_decoder_windows(sq(spark, sf_dir), KEYS, "year", TARGETS, ENC, MAXDEC, MINDEC, "last")


_EARLY = f"""early AS (SELECT * EXCLUDE (_dr, _nd) FROM (SELECT *, max(_dr) OVER ({GRP}) AS _nd
  FROM (SELECT *, dense_rank() OVER ({SPART}) AS _dr FROM sq) a) b WHERE _dr <= 4 AND _nd >= 4)"""
_LATE = f"""late AS (SELECT * EXCLUDE (_m, _c) FROM (SELECT *, count(*) OVER ({GRP}) AS _c
  FROM (SELECT *, max(step) OVER ({GRP}) AS _m FROM sq) a WHERE step > _m - 4) b WHERE _c = 4)"""


@register("f5_early_window", SQ + f", {_EARLY} SELECT * FROM early", doubles=SEQ_DOUBLES)
def f5_early_window(spark, sf_dir):
    return W.early_window(sq(spark, sf_dir), KEYS, 4)


@register("f6_late_window", SQ + f", {_LATE} SELECT * FROM late", doubles=SEQ_DOUBLES)
def f6_late_window(spark, sf_dir):
    return W.late_window(sq(spark, sf_dir), KEYS, 4)


@register("f7_min_length", SQ + f" SELECT * EXCLUDE (_c) FROM (SELECT *, count(*) OVER ({GRP}) AS _c FROM sq) "
          "WHERE _c >= 6", doubles=SEQ_DOUBLES)
def f7_min_length(spark, sf_dir):
    return W.min_length(sq(spark, sf_dir), KEYS, 6)


PRED = [f"pred_{t}" for t in TARGETS]
_HZ = SQ + f""", {_EDB},
last AS ({_ED_LAST_BODY}),
smp AS (SELECT {K}, sample, {', '.join(f'max(CASE WHEN rel = -1 THEN {t} END) AS v_{t}' for t in TARGETS)},
  CAST(sum(CASE WHEN rel >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM last GROUP BY {K}, sample),
hz AS (SELECT {K}, CAST(sample + p AS BIGINT) AS step, {', '.join(f'v_{t} AS pred_{t}' for t in TARGETS)}
  FROM (SELECT *, unnest(generate_series(0, d - 1)) AS p FROM smp) x)"""


def horizon(spark, sf_dir, s=None):
    s = s if s is not None else sq(spark, sf_dir)
    last = W.encoder_decoder_windows(s, KEYS, "year", TARGETS, ENC, MAXDEC, MINDEC, "last")
    smp = last.groupBy(*KEYS, "sample").agg(
        *[F.max(F.when(F.col("rel") == -1, F.col(t))).alias(f"v_{t}") for t in TARGETS],
        F.sum(F.when(F.col("rel") >= 0, 1).otherwise(0)).alias("d"))
    arrays = smp.select(*KEYS, "sample", *[F.array_repeat(f"v_{t}", F.col("d").cast("int")).alias(f"a_{t}")
                                          for t in TARGETS])
    return W.expand_horizon(arrays, KEYS, "sample", {f"pred_{t}": f"a_{t}" for t in TARGETS})


@register("f8_expand_horizon", _HZ + " SELECT * FROM hz", doubles=PRED)
def f8_expand_horizon(spark, sf_dir):
    return horizon(spark, sf_dir)


_TRUTH_COLS = ["year"] + TARGETS + ["standard"]
_F9 = _HZ + f""", ht AS (SELECT hz.*, {', '.join(f'sq.{c}' for c in _TRUTH_COLS)} FROM hz LEFT JOIN sq
  ON hz.model = sq.model AND hz.scenario = sq.scenario AND hz.region = sq.region AND hz.step = sq.step)"""


def with_truth(spark, sf_dir):
    s = stored(sq(spark, sf_dir), "prepared")  # read more than once
    return W.attach_truth(horizon(spark, sf_dir, s), s, KEYS, _TRUTH_COLS)


@register("f9_attach_truth", _F9 + " SELECT * FROM ht", doubles=PRED + TARGETS + ["standard"])
def f9_attach_truth(spark, sf_dir):
    return with_truth(spark, sf_dir)


@register("f10_warm_start_filter", _F9 + " SELECT * FROM ht WHERE step >= 5", doubles=PRED + TARGETS + ["standard"])
def f10_warm_start_filter(spark, sf_dir):
    return W.warm_start_filter(with_truth(spark, sf_dir), 5)


_KEYJOIN = "e.model = l.model AND e.scenario = l.scenario AND e.region = l.region AND e.step = l.step"
_W = "CASE WHEN _on > 1 THEN 1.0 - CAST(step - _omin AS DOUBLE) / CAST(_omax - _omin AS DOUBLE) ELSE 0.5 END"


@register("f11_blend_windows", SQ + f", {_EARLY}, {_LATE}" + f""",
j AS (SELECT coalesce(e.model, l.model) AS model, coalesce(e.scenario, l.scenario) AS scenario,
        coalesce(e.region, l.region) AS region, coalesce(e.step, l.step) AS step,
        coalesce(e.year, l.year) AS year,
        {', '.join(f'e.prev_{t} AS e_{t}, l.prev2_{t} AS l_{t}' for t in TARGETS)},
        e.model IS NOT NULL AS _ie, l.model IS NOT NULL AS _il
      FROM early e FULL OUTER JOIN late l ON {_KEYJOIN}),
k AS (SELECT *, _ie AND _il AS _bo,
        min(CASE WHEN _ie AND _il THEN step END) OVER ({GRP}) AS _omin,
        max(CASE WHEN _ie AND _il THEN step END) OVER ({GRP}) AS _omax,
        count(CASE WHEN _ie AND _il THEN 1 END) OVER ({GRP}) AS _on FROM j)
SELECT model, scenario, region, step, year,
  {', '.join(f'CASE WHEN _bo THEN ({_W}) * e_{t} + (1.0 - ({_W})) * l_{t} WHEN _ie THEN e_{t} ELSE l_{t} END AS pred_{t}' for t in TARGETS)}
FROM k""", doubles=PRED)
def f11_blend_windows(spark, sf_dir):
    s = stored(sq(spark, sf_dir), "prepared")  # read more than once
    early = W.early_window(s, KEYS, 4).select(*KEYS, "step", "year",
                                              *[F.col(f"prev_{t}").alias(f"pred_{t}") for t in TARGETS])
    late = W.late_window(s, KEYS, 4).select(*KEYS, "step", "year",
                                            *[F.col(f"prev2_{t}").alias(f"pred_{t}") for t in TARGETS])
    return W.blend_windows(early, late, KEYS, PRED, carry=["year"])


@register("f12_with_fallback", _HZ + f", {_EARLY}" + f""",
prim AS (SELECT {K}, step, {', '.join(f'prev_{t} AS pred_{t}' for t in TARGETS)} FROM early)
SELECT * FROM prim UNION ALL
SELECT * FROM hz WHERE ({K}) NOT IN (SELECT ({K}) FROM prim)""", doubles=PRED)
def f12_with_fallback(spark, sf_dir):
    s = stored(sq(spark, sf_dir), "prepared")  # read more than once
    prim = W.early_window(s, KEYS, 4).select(*KEYS, "step",
                                             *[F.col(f"prev_{t}").alias(f"pred_{t}") for t in TARGETS])
    return W.with_fallback(prim, horizon(spark, sf_dir, s), KEYS)


@register("f13_coverage_report", _HZ + f"""
SELECT (SELECT count(*) FROM hz) AS horizon_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {K} FROM hz)) AS covered_series,
  (SELECT count(*) FROM (SELECT DISTINCT {K} FROM sq)) AS all_series,
  (SELECT count(*) FROM (SELECT DISTINCT {K} FROM sq EXCEPT SELECT DISTINCT {K} FROM hz)) AS dropped_series""")
def f13_coverage_report(spark, sf_dir):
    s = stored(sq(spark, sf_dir), "prepared")  # read more than once
    return W.coverage_report(horizon(spark, sf_dir, s), s, KEYS)


@register("f13_first_dropped", _HZ + f"""
SELECT * FROM (SELECT DISTINCT {K} FROM sq EXCEPT SELECT DISTINCT {K} FROM hz) ORDER BY {K} LIMIT 5""")
def f13_first_dropped(spark, sf_dir):
    s = stored(sq(spark, sf_dir), "prepared")  # read more than once
    return W.first_dropped(horizon(spark, sf_dir, s), s, KEYS, 5)


@register("f10_warm_start_report", _F9 + """ SELECT count(*) AS horizon_rows,
  CAST(sum(CASE WHEN step < 5 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_rows FROM ht""")
def f10_warm_start_report(spark, sf_dir):
    return W.warm_start_report(with_truth(spark, sf_dir), 5)
