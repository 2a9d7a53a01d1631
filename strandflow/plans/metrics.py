"""Queries of the metrics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import scores
from strandflow.operators import metrics as M
from strandflow.plans.inputs import FEATURES, PAIRS, VECTORS, features, pairs, vectors
from strandflow.plans.registry import Tables, query

_MASKED = f"WITH {PAIRS}, masked AS (SELECT * FROM pairs WHERE weight <> 0), grid AS (SELECT r.x AS ref, p.x AS pred FROM range(4) r(x), range(4) p(x)), cm AS (SELECT grid.ref, grid.pred, CAST(count(m.ref) AS BIGINT) AS n FROM grid LEFT JOIN masked m ON m.ref = grid.ref AND m.pred = grid.pred GROUP BY ALL)"


def _cm(t: Tables) -> DataFrame:
    return M.confusion(pairs(t).where("weight <> 0"), 4)


#: Conditions on (ref, pred) under which a base is a true positive, false positive or false negative of each score.
_CLASS = "{0}: ref = {1} AND pred = {1}; ref <> {1} AND pred = {1}; ref = {1} AND pred <> {1}"
_GENIC_SQL = [_CLASS.format(name, k) for k, name in enumerate(("ig", "utr", "exon", "intron"))]
_GENIC_COMPOSITES_SQL = [
    "legacy_cds: ref IN (2, 3) AND pred IN (2, 3); ref IN (0, 1) AND pred IN (2, 3); ref IN (2, 3) AND pred IN (0, 1)",
    "sub_genic: ref = pred AND ref IN (2, 3); ref <> pred AND pred IN (2, 3); ref <> pred AND ref IN (2, 3)",
    "genic: ref = pred AND ref > 0; ref <> pred AND pred > 0; ref <> pred AND ref > 0",
]
_PHASE_SQL = [_CLASS.format(name, k) for k, name in enumerate(("no_phase", "phase_0", "phase_1", "phase_2"))]
_PHASE_COMPOSITES_SQL = [
    "any_phase: ref > 0 AND pred > 0; ref = 0 AND pred > 0; ref > 0 AND pred = 0",
    "internal_phase: ref = pred AND ref > 0; ref <> pred AND ref > 0 AND pred > 0; ref <> pred AND ref > 0 AND pred > 0",
    "phase: ref = pred AND ref > 0; ref <> pred AND pred > 0; ref <> pred AND ref > 0",
]


def _sql_scores(rows: list[str]) -> str:
    each = []
    for row in rows:
        name, conditions = row.split(": ")
        counts = [f"CAST(coalesce(sum(n) FILTER (WHERE {c}), 0) AS BIGINT) AS {what}" for what, c in zip(("tp", "fp", "fn"), conditions.split("; "), strict=True)]
        each.append(f"SELECT '{name}' AS name, {', '.join(counts)} FROM cm")
    return f"""s AS ({" UNION ALL ".join(each)}),
      pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM s)
      SELECT name, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM pr"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("name", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("cm_counts", _MASKED + " SELECT ref, pred, n FROM cm")
def cm_counts(t: Tables) -> DataFrame:
    return _cm(t).select("ref", "pred", "n")


@query("cm_normalized", _MASKED + " SELECT ref, pred, n, round(n / nullif(sum(n) OVER (PARTITION BY ref), 0), 9) AS share FROM cm")
def cm_normalized(t: Tables) -> DataFrame:
    return M.normalized(_cm(t)).select("ref", "pred", "n", F.round("share", 9).alias("share"))


@query("class_prf", _MASKED + ", " + _sql_scores(_GENIC_SQL))
def class_prf(t: Tables) -> DataFrame:
    return _rounded(M.score(_cm(t), M.class_cells(M.GENIC)))


@query("composite_prf", _MASKED + ", " + _sql_scores(_GENIC_SQL + _GENIC_COMPOSITES_SQL))
def composite_prf(t: Tables) -> DataFrame:
    return _rounded(M.score(_cm(t), M.class_cells(M.GENIC) | M.genic_composites()))


@query("phase_prf", _MASKED + ", " + _sql_scores(_PHASE_SQL + _PHASE_COMPOSITES_SQL))
def phase_prf(t: Tables) -> DataFrame:
    return _rounded(M.score(_cm(t), M.class_cells(M.PHASES) | M.phase_composites()))


@query("total_accuracy", _MASKED + " SELECT round(sum(CASE WHEN ref = pred THEN n ELSE 0 END) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM cm")
def total_accuracy(t: Tables) -> DataFrame:
    return M.accuracy(_cm(t)).select(F.round("accuracy", 9).alias("accuracy"), "n")


@query("masked_accuracy", f"WITH {PAIRS} SELECT batch, count(*) AS n, round(avg(CASE WHEN ref = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pairs WHERE weight <> 0 GROUP BY batch")
def masked_accuracy(t: Tables) -> DataFrame:
    cm = M.confusion(pairs(t).where("weight <> 0"), 4, ["batch"])
    return M.accuracy(cm, ["batch"]).select("batch", "n", F.round("accuracy", 9).alias("accuracy"))


@query("class_counts", f"WITH {FEATURES} SELECT type, count(*) AS n FROM features GROUP BY type")
def class_counts(t: Tables) -> DataFrame:
    return features(t).groupBy("type").agg(F.count("*").alias("n"))




def _transitions():
    """Six flags of a base: from the month in which the stand-in row falls."""
    return F.array(*[F.when(F.month("l_shipdate") == k + 1, 1).otherwise(0) for k in range(6)])


@query(
    "cm_by_transition_filter",
    f"""WITH {PAIRS}, m AS (SELECT ref, pred, month(l_shipdate) AS k FROM pairs WHERE weight <> 0),
    f(filter, months) AS (VALUES ('all', [1,2,3,4,5,6,7,8,9,10,11,12]), ('any', [1,2,3,4,5,6]), ('transcript', [1,4]), ('coding', [2,5]), ('intron', [3,6])),
    grid AS (SELECT filter, r.x AS ref, p.x AS pred, months FROM f, range(4) r(x), range(4) p(x))
    SELECT grid.filter, grid.ref, grid.pred, CAST(count(m.ref) AS BIGINT) AS n FROM grid LEFT JOIN m ON m.ref = grid.ref AND m.pred = grid.pred AND list_contains(grid.months, m.k) GROUP BY ALL""",
)
def cm_by_transition_filter(t: Tables) -> DataFrame:
    rows = pairs(t).where("weight <> 0").withColumn("transitions", _transitions())
    return M.tagged_confusion(rows, 4, M.transition_filters(F.col("transitions"))).select("filter", "ref", "pred", "n")


@query(
    "cm_cds_phase",
    f"""WITH {PAIRS}, grid AS (SELECT r.x AS ref, p.x AS pred FROM range(3) r(x), range(3) p(x)),
    m AS (SELECT CAST(floor(l_tax * 100 + 0.5) AS BIGINT) % 3 AS ref, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) % 3 AS pred FROM pairs WHERE weight <> 0 AND ref = 2 AND pred = 2)
    SELECT grid.ref, grid.pred, CAST(count(m.ref) AS BIGINT) AS n FROM grid LEFT JOIN m ON m.ref = grid.ref AND m.pred = grid.pred GROUP BY ALL""",
)
def cm_cds_phase(t: Tables) -> DataFrame:
    third = lambda c: F.floor(F.col(c) * 100 + 0.5) % 3
    coding = pairs(t).where("weight <> 0 and ref = 2 and pred = 2").select(third("l_tax").alias("ref"), third("l_discount").alias("pred"))
    return M.confusion(coding, 3).select("ref", "pred", "n")


@query("flag_counts", "SELECT quality, count(*) AS n, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS n_toxic FROM labels GROUP BY quality")
def flag_counts(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("argmax_class", f"WITH {VECTORS} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS cls FROM vectors")
def argmax_class(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", scores.argmax(F.col("p")).cast("long").alias("cls"))


@query(
    "class_entropy",
    f"""WITH {VECTORS}, h AS (SELECT ref, batch, list_sum(list_transform(p, lambda x: -x * log2(x))) AS h FROM vectors),
    b AS (SELECT ref, batch, avg(h) AS h FROM h GROUP BY ALL) SELECT ref, round(avg(h) / 2, 9) AS h FROM b GROUP BY ref""",
)
def class_entropy(t: Tables) -> DataFrame:
    return M.class_entropy(vectors(t), 4).select("ref", F.round("h", 9).alias("h"))


@query("weighted_logloss", f"WITH {VECTORS} SELECT ref, count(*) AS n, round(avg(-ln(least(greatest(p[ref + 1], 1e-7), 1 - 1e-7)) * (CASE WHEN ref = 0 THEN 0.2 ELSE 0.8 END)), 9) AS loss FROM vectors GROUP BY ref")
def weighted_logloss(t: Tables) -> DataFrame:
    weight = F.when(F.col("ref") == 0, 0.2).otherwise(0.8)
    return vectors(t).groupBy("ref").agg(F.count("*").alias("n"), F.round(F.avg(scores.cross_entropy(F.col("p"), F.col("ref"), weight)), 9).alias("loss"))


@query(
    "summary_strip",
    f"""WITH {VECTORS}, e AS (SELECT vec_id // 25 AS bin, ref, list_transform([0, 1, 2, 3], lambda k: abs((CASE WHEN k = ref THEN 1 ELSE 0 END) - p[k + 1])) AS e FROM vectors)
    SELECT bin, bool_or(ref = 2) AS any_coding, round(avg(CASE WHEN ref <> 0 THEN e[ref + 1] END), 9) AS mean_error FROM e GROUP BY bin""",
)
def summary_strip(t: Tables) -> DataFrame:
    y = F.array(*[F.when(F.col("ref") == k, 1.0).otherwise(0.0) for k in range(4)])
    rows = vectors(t).select(F.floor(F.col("vec_id") / 25).alias("bin"), "ref", scores.pointwise_error(y, F.col("p")).alias("e"))
    return rows.groupBy("bin").agg(F.bool_or(F.col("ref") == 2).alias("any_coding"), F.round(F.avg(F.when(F.col("ref") != 0, F.get("e", F.col("ref").cast("int")))), 9).alias("mean_error"))


@query(
    "coverage_counter",
    f"""WITH {PAIRS}, m AS (SELECT ref, pred, l_tax * 1000 AS cov, l_discount * 500 AS scov FROM pairs), b(x) AS (VALUES (0), (1), (3), (9), (27), (81))
    SELECT m.ref, m.pred, b1.x AS min_first, b2.x AS min_second, count(*) AS n FROM m JOIN b b1 ON cov >= b1.x JOIN b b2 ON scov >= b2.x GROUP BY ALL""",
)
def coverage_counter(t: Tables) -> DataFrame:
    rows = pairs(t).select("ref", "pred", (F.col("l_tax") * 1000).alias("cov"), (F.col("l_discount") * 500).alias("scov"))
    return M.threshold_counts(rows, ["ref", "pred"], "cov", "scov", [0, 1, 3, 9, 27, 81])


@query("position_profile", f"WITH {PAIRS} SELECT CAST(off // 20 AS BIGINT) AS block, count(*) AS n, CAST(count(*) FILTER (WHERE ref = pred) AS BIGINT) AS n_right, round(count(*) FILTER (WHERE ref = pred) / count(*), 9) AS accuracy FROM pairs WHERE weight <> 0 GROUP BY ALL")
def position_profile(t: Tables) -> DataFrame:
    return M.position_profile(pairs(t).where("weight <> 0"), 20).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "support_consensus",
    f"""WITH {PAIRS} SELECT ref, round(coalesce(100 * count(*) FILTER (WHERE l_tax >= 0.04 AND ref = pred) / nullif(count(*) FILTER (WHERE l_tax >= 0.04), 0), -1), 9) AS high_pct,
    round(coalesce(100 * count(*) FILTER (WHERE l_tax < 0.04 AND ref = pred) / nullif(count(*) FILTER (WHERE l_tax < 0.04), 0), -1), 9) AS low_pct FROM pairs GROUP BY ref""",
)
def support_consensus(t: Tables) -> DataFrame:
    return M.support_consensus(pairs(t), 0.04, "l_tax").select("ref", F.round("high_pct", 9).alias("high_pct"), F.round("low_pct", 9).alias("low_pct"))


_EDGES = (0, 100, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000)


@query(
    "length_bins",
    f"""WITH e AS (SELECT unnest({list(_EDGES[:-1])}) AS lo, unnest({list(_EDGES[1:])}) AS hi)
    SELECT CAST(e.hi AS BIGINT) AS bin_end, round(avg(o_totalprice), 2) AS mean_value, count(*) AS n FROM orders LEFT JOIN e ON o_totalprice > lo AND o_totalprice <= hi GROUP BY ALL""",
)
def length_bins(t: Tables) -> DataFrame:
    return M.length_bins(t.orders, _EDGES, "o_totalprice", "o_totalprice").withColumn("mean_value", F.round("mean_value", 2))
