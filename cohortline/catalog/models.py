"""Queries for encoding, imputation, smooth models and plateaus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import chained_sql, rounded
from cohortline.catalog.registry import query
from cohortline.functions.exprs import complement, logistic
from cohortline.operators import model
from cohortline.plans import optimal
from cohortline.sources.io import load

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS \"o_orderstatus_{s}\"" for s in "FOP")
    + ", "
    + ", ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + " FROM orders",
)
def one_hot(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return model.one_hot(orders, ["o_orderstatus", "o_orderpriority"])


LEVELS = """lv AS (SELECT 0 AS c, 'customer' AS "column", o_custkey::VARCHAR AS level FROM orders UNION
  SELECT 1, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'),
n AS (SELECT *, row_number() OVER (ORDER BY c, level) - 1 AS position FROM lv)"""


def _coded(spark, folder):
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority")
    return load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), priority)


@query("number_levels", f'WITH {LEVELS} SELECT "column", level, position FROM n')
def number_levels(spark, folder):
    """Positions of the levels of a column with one per customer and of one with a few and NULLs."""
    return model.number_levels(_coded(spark, folder), ["customer", "o_orderpriority"])


@query(
    "one_hot_sparse",
    f"""WITH {LEVELS} SELECT o_orderkey, a.position || COALESCE(',' || b.position, '') AS positions FROM orders
JOIN n a ON a.c = 0 AND a.level = o_custkey::VARCHAR LEFT JOIN n b ON b.c = 1 AND b.level = o_orderpriority""",
)
def one_hot_sparse(spark, folder):
    out = model.encode_levels(_coded(spark, folder), ["customer", "o_orderpriority"])
    return out.withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>")))


TWO_HOLES = """l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 997 END AS price,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 + l_tax) / 997 END AS charge FROM lineitem)"""


@query(
    "impute_two_targets",
    f"WITH {TWO_HOLES}, {chained_sql('l', 'price', 'charge', 'l_quantity', 3)} SELECT l_orderkey, l_linenumber, "
    "round(price_impute, 4) AS price_impute, round(charge_impute, 4) AS charge_impute FROM chained",
)
def impute_two_targets(spark, folder):
    """Three rounds over two targets that miss different rows and some of the same."""
    price = F.col("l_extendedprice") / 997  # no quotient has a tie at the fourth digit
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_linenumber") != 3, price).alias("price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") * (1 + F.col("l_tax")) / 997).alias("charge"),
    )
    out = model.impute_chained(lines, ["price", "charge"], ["l_quantity"], rounds=3, ridge=0.0)
    return rounded(out, 4, "price_impute", "charge_impute").select("l_orderkey", "l_linenumber", "price_impute", "charge_impute")


@query("impute_chained")
def impute_chained(spark, folder):
    """Prices and taxes masked on some lines, filled from the other columns by chained regressions."""
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_discount",
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("charge"),
    )
    return rounded(
        model.impute_chained(lines, ["price", "charge"], ["l_quantity", "l_discount"]), 4, "price_impute", "charge_impute"
    )


def _toxicity(spark, folder):
    docs = load(spark, folder, "documents").select(
        "doc_id", F.log1p("n_chars").alias("log_chars"), F.size(F.split("text", " ")).alias("words"), "lang"
    )
    labels = load(spark, folder, "labels")
    return docs.join(labels, "doc_id").withColumns(
        {"log_words": F.log1p("words"), "english": F.when(F.col("lang") == "en", 1).otherwise(0)}
    )


@query("smooth_logit_curve")
def smooth_logit_curve(spark, folder):
    """Smooth logistic model of a label on text length, and the curve over the observed lengths."""
    data = _toxicity(spark, folder)
    fit = model.fit_smooth_logit(data, "toxic", ["log_chars", "log_words"], ["english", "quality"])
    curve = model.effect_curve(fit, data, "log_chars", at={"english": 0})
    return rounded(curve, 6, "x", "fit", "se", "lcl", "prob", "ucl")


@query("smooth_logit_plateau")
def smooth_logit_plateau(spark, folder):
    """Where the fitted curve is flat: slope in percentage points per unit of log length."""
    data = _toxicity(spark, folder)
    fit = model.fit_smooth_logit(data, "toxic", ["log_chars"], ["english"])
    curve = model.effect_curve(fit, data, "log_chars", at={"english": 0})
    return model.plateau(model.curve_slope(curve, "x", "prob", step=0.25), 2.0, 2.0, 10.0)


# The curve: mean discounted price share by quantity, a point per distinct quantity.
CURVE = """c AS (SELECT l_quantity AS x, round(avg(l_extendedprice) / 100000, 6) AS y FROM lineitem GROUP BY 1),
g AS (SELECT min(x) AS x, arg_min(y, x) AS y FROM c
  UNION ALL
  SELECT n.x, n.y FROM (SELECT g.x AS a, min(c.x) AS x, arg_min(c.y, c.x) AS y FROM g JOIN c ON c.x >= g.x + 2.5 GROUP BY g.x) n),
s AS (SELECT x, lead(x) OVER (ORDER BY x) AS "right", 100 * (lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x) AS slope FROM g)"""


def _curve(spark, folder):
    lines = load(spark, folder, "lineitem").groupBy(F.col("l_quantity").alias("x"))
    return rounded(lines.agg((F.avg("l_extendedprice") / 100000).alias("y")), 6, "y")


@query("curve_slope", f"WITH RECURSIVE {CURVE} SELECT x, \"right\", round(slope, 6) + 0.0 AS slope FROM s WHERE slope IS NOT NULL")
def curve_slope(spark, folder):
    return rounded(model.curve_slope(_curve(spark, folder), "x", "y", step=2.5), 6, "slope")


# A dense curve: a point per price in units of 10, far closer than a 64th of a step.
PRICE_CURVE = """c AS (SELECT round(l_extendedprice / 1000, 2) AS x, max(l_tax) + min(l_discount) AS y FROM lineitem GROUP BY 1),
g AS (SELECT min(x) AS x, arg_min(y, x) AS y FROM c
  UNION ALL
  SELECT n.x, n.y FROM (SELECT g.x AS a, min(c.x) AS x, arg_min(c.y, c.x) AS y FROM g JOIN c ON c.x - g.x >= 1.5 GROUP BY g.x) n),
s AS (SELECT x, lead(x) OVER (ORDER BY x) AS "right", 100 * (lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x) AS slope FROM g)"""


@query("curve_slope_dense", f"WITH RECURSIVE {PRICE_CURVE} SELECT x, \"right\", round(slope, 6) + 0.0 AS slope FROM s WHERE slope IS NOT NULL")
def curve_slope_dense(spark, folder):
    lines = load(spark, folder, "lineitem").groupBy(F.round(F.col("l_extendedprice") / 1000, 2).alias("x"))
    curve = lines.agg((F.max("l_tax") + F.min("l_discount")).alias("y"))
    return rounded(model.curve_slope(curve, "x", "y", step=1.5), 6, "slope")


@query(
    "plateau_range",
    f"WITH RECURSIVE {CURVE} SELECT min(x) AS plateau_low, max(x) AS plateau_high FROM s WHERE abs(slope) < 0.25 AND x > 4 AND x < 45",
)
def plateau_range(spark, folder):
    return model.plateau(model.curve_slope(_curve(spark, folder), "x", "y", step=2.5), 0.25, 4, 45)


@query(
    "logistic_complement",
    """SELECT doc_id, round(1 / (1 + exp(-(n_chars - 1000) / 500.0)), 6) AS p,
  round(1 - 1 / (1 + exp(-(n_chars - 1000) / 500.0)), 6) AS q FROM documents""",
)
def logistic_complement(spark, folder):
    p = logistic((F.col("n_chars") - 1000) / 500.0)
    return load(spark, folder, "documents").select(
        "doc_id", F.round(p, 6).alias("p"), F.round(complement(p), 6).alias("q")
    )


def _study(spark, folder):
    """Customers with an outcome, an exposure and covariates."""
    orders = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("o_totalprice").alias("mean_price"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"),
        F.max(F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), 1).otherwise(0)).alias("died"),
    )
    people = load(spark, folder, "customer").join(orders, "c_custkey")
    return people.withColumns(
        {
            "map": F.round(F.col("mean_price") / 3000, 1),
            "age": F.round(F.col("c_acctbal") / 120, 0),
            "sex": F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(0),
        }
    )


@query("optimal_ranges")
def optimal_ranges(spark, folder):
    """Two outcomes on two exposures, adjusted, all fitted together; plateaus on both scales."""
    return rounded(
        optimal.optimal_ranges(
            _study(spark, folder), ["died", "urgent"], {"map": (60, 110), "age": (10, 80)}, [], ["sex"], {"sex": 0}, step=2.0
        ),
        4,
        "plateau_low",
        "plateau_high",
    )


@query("smooth_curves")
def smooth_curves(spark, folder):
    data = _study(spark, folder)
    fitted = model.fit_smooth_logits(data, optimal.formulas(["died", "urgent"], ["map"], ["age"], ["sex"]))
    return rounded(optimal.curves(data, fitted, {"sex": 0}), 6, "x", "fit", "se", "lcl", "prob", "ucl")


@query(
    "impute_regression",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price FROM lineitem),
f AS (SELECT regr_slope(price, l_quantity) AS b, regr_intercept(price, l_quantity) AS a FROM l)
SELECT l_orderkey, l_linenumber, l_quantity, price, round(COALESCE(price, a + b * l_quantity), 3) AS price_impute FROM l, f""",
)
def impute_regression(spark, folder):
    """One target and one feature: the chain is a single least-squares line."""
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price")
    )
    return rounded(model.impute_chained(lines, ["price"], ["l_quantity"], rounds=1, ridge=0.0), 3, "price_impute")


# Newton's method for the intercept and one slope, as a recursion over the whole table.
LOGIT = """d AS (SELECT toxic::DOUBLE AS y, ln(1 + n_chars) AS x FROM documents JOIN labels USING (doc_id)),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
  UNION ALL
  SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT b.i, b.b0, b.b1, sum(d.y - m) AS g0, sum((d.y - m) * d.x) AS g1, sum(m * (1 - m)) AS h00,
      sum(m * (1 - m) * d.x) AS h01, sum(m * (1 - m) * d.x * d.x) AS h11
    FROM b, (SELECT y, x FROM d) d, LATERAL (SELECT 1 / (1 + exp(-(b.b0 + b.b1 * d.x))) AS m) WHERE b.i < 12 GROUP BY ALL))"""


@query("logit_fit", f"WITH RECURSIVE {LOGIT} SELECT round(b0, 4) AS b0, round(b1, 4) AS b1 FROM b WHERE i = 12")
def logit_fit(spark, folder):
    """A model without smooth terms is the maximum-likelihood logistic regression."""
    fit = model.fit_smooth_logit(_toxicity(spark, folder), "toxic", [], ["log_chars"], tol=1e-12)
    beta = [round(float(b), 4) for b in fit.beta]
    return spark.createDataFrame([(beta[0], beta[1])], "b0 double, b1 double")


def _inverse_sql(name: str, matrix: str, k: int) -> str:
    """Gauss-Jordan elimination, a pivot per turn: ``<name>`` has the inverse ``m`` (a list of rows) of the matrix of table ``matrix``."""
    unit = f"[[CASE WHEN j <= {k} THEN m[i][j] WHEN j = i + {k} THEN 1.0 ELSE 0.0 END for j in range(1, {2 * k + 1})] for i in range(1, {k + 1})]"
    pivot = f"""[[CASE WHEN i = p THEN m[p][j] / m[p][p] ELSE m[i][j] - m[i][p] * m[p][j] / m[p][p] END for j in range(1, {2 * k + 1})]
    for i in range(1, {k + 1})]"""
    return f"""{name}_turns AS (SELECT 1 AS p, {unit} AS m FROM {matrix}
  UNION ALL SELECT p + 1, {pivot} FROM {name}_turns WHERE p <= {k}),
{name} AS (SELECT [m[i][{k + 1}:] for i in range(1, {k + 1})] AS m FROM {name}_turns WHERE p = {k + 1})"""


def _smooth_sql(segments: int, smoothing: float, turns: int) -> str:
    """Penalised maximum likelihood for one smooth and one linear term of table ``d`` (y, x, z), up to table ``curve`` (x, fit, se at z = 0).

    The basis comes from the closed form of a cubic B-spline on equal knots. The fit goes uphill with the largest possible
    curvature, a quarter of X'X plus the penalty, whose inverse is found once; the covariance is the inverse at the end.
    """
    basis, k = segments + 3, segments + 4
    spline = f"""[CASE i - seg WHEN 0 THEN (1 - u) ** 3 / 6 WHEN 1 THEN (3 * u ** 3 - 6 * u ** 2 + 4) / 6
    WHEN 2 THEN (3 * u - 3 * u ** 3 + 3 * u ** 2 + 1) / 6 WHEN 3 THEN u ** 3 / 6 ELSE 0 END for i in range({basis})]"""
    row = "list_concat(list_concat([1.0], [b[i] - c[i] for i in range(2, {0})]), [{1}])"
    bend = f"""list_sum([(CASE a - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END)
      * (CASE e - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END) for r in range({basis - 2})])"""
    smooth = f"a BETWEEN 1 AND {basis - 1} AND e BETWEEN 1 AND {basis - 1}"
    penalty = f"[[(CASE WHEN {smooth} THEN {smoothing} * {bend} ELSE 0 END) + (CASE WHEN a = e THEN 1e-8 ELSE 0 END) for e in range({k})] for a in range({k})]"

    def moments(weight: str) -> str:
        return "[" + ", ".join("[" + ", ".join(f"sum({weight} * r[{a}] * r[{e}])" for e in range(1, k + 1)) + "]" for a in range(1, k + 1)) + "]"

    def plus(m: str) -> str:
        return f"[[{m}[a][e] + pen[a][e] for e in range(1, {k + 1})] for a in range(1, {k + 1})]"

    uphill = ", ".join(f"sum((y - 1 / (1 + exp(-list_dot_product(r, beta)))) * r[{a}])" for a in range(1, k + 1))
    mu = "1 / (1 + exp(-list_dot_product(r, beta)))"
    return f"""ends AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
placed AS (SELECT y, x, z, least(floor((x - lo) / (hi - lo) * {segments}), {segments - 1})::INT AS seg,
  (x - lo) / (hi - lo) * {segments} - seg AS u FROM d, ends),
raw AS (SELECT y, x, z, {spline} AS b FROM placed),
centre AS (SELECT [{", ".join(f"avg(b[{i}])" for i in range(1, basis + 1))}] AS c FROM raw),
design AS (SELECT y, {row.format(basis + 1, "z")}::DOUBLE[] AS r FROM raw, centre),
pen AS (SELECT {penalty} AS pen),
steepest AS (SELECT {plus("g")} AS m FROM (SELECT {moments("0.25")} AS g FROM design), pen),
{_inverse_sql("reach", "steepest", k)},
climb AS (SELECT 0 AS i, [0.0 for a in range({k})]::DOUBLE[] AS beta
  UNION ALL
  SELECT i + 1, [beta[a] + list_dot_product(m[a], [up[e] - list_dot_product(pen[e], beta) for e in range(1, {k + 1})]) for a in range(1, {k + 1})]::DOUBLE[]
  FROM (SELECT i, any_value(beta) AS beta, [{uphill}] AS up FROM climb, design WHERE i < {turns} GROUP BY i), reach, pen),
beta AS (SELECT beta FROM climb WHERE i = {turns}),
curvature AS (SELECT {plus("g")} AS m FROM (SELECT {moments(f"({mu}) * (1 - {mu})")} AS g FROM design, beta), pen),
{_inverse_sql("cov", "curvature", k)},
points AS (SELECT DISTINCT x, {row.format(basis + 1, "0.0")}::DOUBLE[] AS r FROM raw, centre),
curve AS (SELECT x, list_dot_product(r, beta) AS fit, sqrt(list_dot_product(r, [list_dot_product(m[a], r) for a in range(1, {k + 1})]::DOUBLE[])) AS se
  FROM points, beta, cov)"""


STUDY = """d AS (SELECT urgent::DOUBLE AS y, round(mean_price / 3000, 0)::DOUBLE AS x, (c_nationkey % 2 = 0)::INT::DOUBLE AS z FROM customer
  JOIN (SELECT o_custkey, avg(o_totalprice) AS mean_price, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
        FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey)"""


def _held_curve(spark, folder):
    data = _study(spark, folder).withColumn("map", F.round(F.col("mean_price") / 3000, 0))
    fit = model.fit_smooth_logit(data, "urgent", ["map"], ["sex"], segments=5, smoothing=2.0, tol=1e-13, max_passes=60)
    return model.effect_curve(fit, data, "map", {"sex": 0})


@query("smooth_held_curve", f"WITH RECURSIVE {STUDY}, {_smooth_sql(5, 2.0, 400)} SELECT x, round(fit, 5) + 0.0 AS fit, round(se, 5) AS se FROM curve")
def smooth_held_curve(spark, folder):
    """A smooth model with a given roughness penalty: curve and standard error from a fit that SQL makes by itself."""
    return rounded(_held_curve(spark, folder), 5, "fit", "se").select("x", "fit", "se")


@query(
    "smooth_held_plateau",
    f"""WITH RECURSIVE {STUDY}, {_smooth_sql(5, 2.0, 400)},
c AS (SELECT x, 100 / (1 + exp(-fit)) AS y FROM curve),
g AS (SELECT min(x) AS x, arg_min(y, x) AS y FROM c
  UNION ALL
  SELECT n.x, n.y FROM (SELECT g.x AS a, min(c.x) AS x, arg_min(c.y, c.x) AS y FROM g JOIN c ON c.x - g.x >= 2 GROUP BY g.x) n),
s AS (SELECT x, (lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x) AS slope FROM g)
SELECT min(x) AS plateau_low, max(x) AS plateau_high FROM s WHERE abs(slope) < 0.4 AND x > 10 AND x < 120""",
)
def smooth_held_plateau(spark, folder):
    """Where the probability of that curve changes by less than 0.4 percentage points per unit."""
    return model.plateau(model.curve_slope(_held_curve(spark, folder), "x", "prob", 2.0), 0.4, 10, 120)


def _zeros(sizes) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS model, unnest(range({k}))::INT AS position, 0.0::DOUBLE AS score" for n, k in sizes.items())


@query("smooth_logit_scores", _zeros({"length": 23, "short": 12}))
def smooth_logit_scores(spark, folder):
    """The score equations of fitted smooth models hold: every one is zero at the solution."""
    data = _toxicity(spark, folder)
    formulas = {
        "length": model.Formula("toxic", ("log_chars", "log_words"), ("english", "quality")),
        "short": model.Formula("toxic", ("log_chars",), ("english",)),
    }
    fitted = model.fit_smooth_logits(data, formulas, tol=1e-10)
    scores = model.score_equations(data, fitted)
    return scores.withColumn("score", F.round("score", 5) + 0.0)


@query("smooth_curve_scores", _zeros({f"{o}~{e}": 12 for o in ("died", "urgent") for e in ("map", "age")}))
def smooth_curve_scores(spark, folder):
    """The same for the models behind the optimal ranges."""
    data = _study(spark, folder)
    fitted = model.fit_smooth_logits(data, optimal.formulas(["died", "urgent"], ["map", "age"], [], ["sex"]), tol=1e-10)
    return model.score_equations(data, fitted).withColumn("score", F.round("score", 5) + 0.0)
