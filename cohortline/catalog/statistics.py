"""Queries for summaries, fences and contingency tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import rounded
from cohortline.catalog.registry import query
from cohortline.operators import stats
from cohortline.sources.io import load


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, folder):
    return stats.value_counts(load(spark, folder, "orders"), "o_orderpriority")


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def distinct_count(spark, folder):
    return stats.distinct_count(load(spark, folder, "lineitem"), "l_partkey")


def _long(rows: list[tuple[str, ...]], names: tuple[str, ...], source: str) -> str:
    parts = []
    for *labels, value in rows:
        cols = ", ".join(f"'{x}' AS {n}" for x, n in zip(labels, names))
        parts.append(f"SELECT {cols}, round(CAST({value} AS DOUBLE), 4) AS value FROM {source}")
    return " UNION ALL ".join(parts)


DESCRIBED = ("o_totalprice", "o_orderkey")
_STATS = (
    ("count", "count({c})"),
    ("mean", "avg({c})"),
    ("sd", "stddev_samp({c})"),
    ("min", "min({c})"),
    ("max", "max({c})"),
    ("p25", "quantile_cont({c}::DOUBLE, 0.25)"),
    ("p50", "quantile_cont({c}::DOUBLE, 0.5)"),
    ("p75", "quantile_cont({c}::DOUBLE, 0.75)"),
)


@query(
    "describe",
    _long([(c, n, e.format(c=c)) for c in DESCRIBED for n, e in _STATS], ("variable", "stat"), "orders"),
)
def describe(spark, folder):
    return rounded(stats.describe(load(spark, folder, "orders"), DESCRIBED), 4, "value")


@query(
    "null_report",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) FILTER ({t}) AS n_null, round(count(*) FILTER ({t})::DOUBLE / count(*), 6) AS share
FROM lineitem"""
        for n, t in (("l_discount", "l_discount = 0"), ("l_tax", "l_tax = 0"), ("l_quantity", "l_quantity IS NULL"))
    ),
)
def null_report(spark, folder):
    lines = load(spark, folder, "lineitem").select(
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_quantity"
    )
    return rounded(stats.null_report(lines), 6, "share")


@query(
    "iqr_fence",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
  quantile_cont(event_id::DOUBLE, 0.25) AS e1, quantile_cont(event_id::DOUBLE, 0.75) AS e3 FROM events)
SELECT event_id, value, COALESCE(value > v3 + 1.5 * (v3 - v1) OR value < v1 - 1.5 * (v3 - v1), FALSE) AS value_outlier,
  COALESCE(event_id > e3 + 1.5 * (e3 - e1) OR event_id < e1 - 1.5 * (e3 - e1), FALSE) AS event_id_outlier FROM events, q""",
)
def iqr_fence(spark, folder):
    return stats.iqr_fence(load(spark, folder, "events").select("event_id", "value"), ["value", "event_id"])


@query(
    "fence_values",
    _long(
        [
            (c, n, f"quantile_cont({c}, {p}) {s} 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")
            for c in ("l_extendedprice", "l_quantity")
            for n, p, s in (("low", 0.25, "-"), ("high", 0.75, "+"))
        ],
        ("variable", "fence"),
        "lineitem",
    ),
)
def fence_values(spark, folder):
    low_high = stats.fences(load(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])
    long = low_high.select(
        "variable",
        F.explode(
            F.array(
                F.struct(F.lit("low").alias("fence"), F.col("low").alias("value")),
                F.struct(F.lit("high").alias("fence"), F.col("high").alias("value")),
            )
        ).alias("f"),
    )
    return rounded(long.select("variable", "f.fence", "f.value"), 4, "value")


@query(
    "share",
    "SELECT round(avg(CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS prevalence FROM lineitem",
)
def share(spark, folder):
    test = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)
    return rounded(stats.share(load(spark, folder, "lineitem"), test, "prevalence"), 6, "prevalence")


@query(
    "table_one",
    _long(
        [
            ("n", "", "n", "count(*)"),
            ("c_acctbal", "", "mean", "avg(c_acctbal)"),
            ("c_acctbal", "", "sd", "stddev_samp(c_acctbal)"),
            ("spent", "", "p25", "quantile_cont(spent, 0.25)"),
            ("spent", "", "median", "quantile_cont(spent, 0.5)"),
            ("spent", "", "p75", "quantile_cont(spent, 0.75)"),
        ],
        ("variable", "level", "stat"),
        "cov",
    ).join(
        [
            """WITH cov AS (SELECT c.*, o.spent FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders
  GROUP BY 1) o ON o.o_custkey = c.c_custkey),
lv AS (SELECT 'c_mktsegment' AS variable, c_mktsegment AS level, count(*) AS n FROM cov GROUP BY 2
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM cov GROUP BY 2)
""",
            """ UNION ALL SELECT variable, level, 'n', CAST(n AS DOUBLE) FROM lv
UNION ALL SELECT variable, level, 'percent', round(100.0 * n / sum(n) OVER (PARTITION BY variable), 4) FROM lv""",
        ]
    ),
)
def table_one(spark, folder):
    spent = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    cov = load(spark, folder, "customer").join(spent, "c_custkey", "left")
    out = stats.table_one(cov, ["c_acctbal", "spent"], ["c_mktsegment", "c_nationkey"], nonnormal=["spent"])
    return rounded(out, 4, "value")


_RATIOS = """round(a / nullif(a + c, 0), 6) AS risk_exposed, round(b / nullif(b + d, 0), 6) AS risk_control,
  round(CASE WHEN b * c > 0 THEN a * d / (b * c) END, 6) AS odds_ratio,
  round(CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN exp(ln(a * d / (b * c)) - 1.96 * sqrt(1/a + 1/b + 1/c + 1/d)) END, 6) AS ci_low,
  round(CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN exp(ln(a * d / (b * c)) + 1.96 * sqrt(1/a + 1/b + 1/c + 1/d)) END, 6) AS ci_high,
  round(chi2, 6) AS chi2, round(2 * exp(-chi2 / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
    + t * (-1.821255978 + t * 1.330274429)))), 6) AS p_value
FROM (SELECT *, 1 / (1 + 0.2316419 * sqrt(chi2)) AS t FROM (SELECT *, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN
  (a + b + c + d) * power(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2 FROM n))"""

_COUNTS = """count(*) FILTER ({x} BETWEEN {l1} AND {h1} AND {y} = 1)::DOUBLE AS a, count(*) FILTER ({x} BETWEEN {l2} AND {h2} AND {y} = 1)::DOUBLE AS b,
  count(*) FILTER ({x} BETWEEN {l1} AND {h1} AND {y} = 0)::DOUBLE AS c, count(*) FILTER ({x} BETWEEN {l2} AND {h2} AND {y} = 0)::DOUBLE AS d"""

_RATIO_COLUMNS = ("risk_exposed", "risk_control", "odds_ratio", "ci_low", "ci_high", "chi2", "p_value")


def _documents(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("length"))
    return docs.join(load(spark, folder, "labels"), "doc_id")


@query(
    "odds_ratio",
    "WITH n AS (SELECT "
    + _COUNTS.format(x="n_chars", l1=0, h1=1000, l2=1000, h2=8000, y="toxic")
    + " FROM documents JOIN labels USING (doc_id)) SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, "
    + _RATIOS,
)
def odds_ratio(spark, folder):
    out = stats.odds_ratio(_documents(spark, folder), "n_chars", (0, 1000), (1000, 8000), "toxic")
    return rounded(out, 6, *_RATIO_COLUMNS)


_CRITERIA = {
    "all": "TRUE",
    "english": "lang = 'en'",
    "other": "lang <> 'en'",
    "good": "quality = 1",
    "poor": "quality = 0",
    "low_source": "source < 'src15'",
    "high_source": "source >= 'src15'",
    "long": "length(text) >= 900",
}
_METRICS = {
    "chars": ("n_chars", (0, 1000), (1000, 8000)),
    "chars_wide": ("n_chars", (0, 600), (600, 40000)),
    "length": ("length", (10, 700), (800, 3000)),
}


@query(
    "odds_ratio_table",
    "WITH j AS (SELECT *, length(text) AS length FROM documents JOIN labels USING (doc_id)), n AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS criterion, '{m}' AS metric, "
        + _COUNTS.format(x=col, l1=e[0], h1=e[1], l2=c[0], h2=c[1], y="toxic")
        + f" FROM j WHERE {test}"
        for n, test in _CRITERIA.items()
        for m, (col, e, c) in _METRICS.items()
    )
    + ") SELECT criterion, metric, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, "
    + _RATIOS,
)
def odds_ratio_table(spark, folder):
    c = F.col
    criteria = {
        "all": F.lit(True),
        "english": c("lang") == "en",
        "other": c("lang") != "en",
        "good": c("quality") == 1,
        "poor": c("quality") == 0,
        "low_source": c("source") < "src15",
        "high_source": c("source") >= "src15",
        "long": c("length") >= 900,
    }
    out = stats.odds_ratio_table(_documents(spark, folder), criteria, _METRICS, "toxic")
    return rounded(out, 6, *_RATIO_COLUMNS)
