"""Queries on vocabularies, codes, drugs, evidence and text predicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.catalog.frames import READINGS, in_turn, readings, rounded, with_items
from cohortline.catalog.registry import query
from cohortline.functions import vocab
from cohortline.functions.exprs import (
    INTEGER_TEXT,
    any_of,
    flag,
    is_numeric,
    like_any,
    mask_by_item,
    nullif_zero,
    starts_with_any,
    to_number,
)
from cohortline.operators.timeseries import complete_cases
from cohortline.plans import fluids, history, meds
from cohortline.plans.cleaning import apply_exclusions, ethnicity_group, set_where
from cohortline.sources.io import load

KEY = "patientunitstayid"


def recode(col: str, mapping: Mapping[str, object], otherwise: object = None) -> Column:
    out = None
    for k, v in mapping.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col(col) == k, value) if out is None else out.when(F.col(col) == k, value)
    return out.otherwise(F.lit(otherwise))


# --------------------------------------------------------------------------- evidence


def respcare(spark, folder):
    return load(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY),
        recode("o_orderpriority", {"1-URGENT": "Oral ETT", "2-HIGH": "Tracheostomy"}, "None").alias("airwaytype"),
        (F.floor(F.col("o_totalprice") / 10) - 10000).alias("respcarestatusoffset"),
    )


def respcharting(spark, folder):
    words = {"click": "on ventilator", "view": "BiPAP mask", "error": "room air", "signup": "mv 12"}
    return readings(spark, folder).select(
        F.col("user_id").alias(KEY),
        F.col("off").alias("respchartoffset"),
        recode("event_type", words, "nasal cannula").alias("respchartvalue"),
    )


def respiratory_treatment(spark, folder):
    treated = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(KEY),
        F.when(treated, in_turn(vocab.VENTILATION_TREATMENTS, "l_orderkey")).otherwise("surgery|other").alias("treatmentstring"),
        (F.col("l_quantity").cast("long") * 100 + F.col("l_partkey") - 3000).alias("treatmentoffset"),
    )


EVIDENCE = """rc AS (SELECT o_custkey AS id, CAST(floor(o_totalprice / 10) AS BIGINT) - 10000 AS off FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
rx AS (SELECT l_suppkey AS id, CAST(l_quantity AS BIGINT) * 100 + l_partkey - 3000 AS off FROM lineitem
  WHERE l_returnflag = 'R' AND l_linestatus = 'F')"""


@query(
    "evidence_any_source",
    with_items(READINGS, EVIDENCE)
    + """SELECT DISTINCT id AS patientunitstayid, 1 AS mechvent FROM (
  SELECT id FROM rc WHERE off BETWEEN -1440 AND 1440
  UNION ALL SELECT user_id FROM r WHERE event_type IN ('click', 'signup') AND off BETWEEN -1440 AND 1440
  UNION ALL SELECT id FROM rx WHERE off BETWEEN -1440 AND 1440)""",
)
def evidence_any_source(spark, folder):
    return meds.ventilated_stays(respcare(spark, folder), respcharting(spark, folder), respiratory_treatment(spark, folder))


@query(
    "evidence_loose_window",
    with_items(READINGS, EVIDENCE)
    + """SELECT DISTINCT id AS patientunitstayid, 1 AS mechvent FROM (
  SELECT id FROM rc WHERE off BETWEEN -1440 AND 1440
  UNION ALL SELECT user_id FROM r WHERE event_type IN ('click', 'signup')
  UNION ALL SELECT id FROM rx WHERE off BETWEEN -1440 AND 1440)""",
)
def evidence_loose_window(spark, folder):
    parts = respcare(spark, folder), respcharting(spark, folder), respiratory_treatment(spark, folder)
    return meds.ventilated_stays(*parts, loose_window=True)


@query(
    "evidence_by_time",
    with_items(READINGS, EVIDENCE)
    + """SELECT DISTINCT id AS patientunitstayid, off AS respcarestatusoffset, CAST(NULL AS BIGINT) AS respchartoffset,
  CAST(NULL AS BIGINT) AS treatmentoffset, 1 AS mechvent FROM rc WHERE off BETWEEN -1440 AND 1440
UNION ALL SELECT DISTINCT user_id, NULL, off, NULL, 1 FROM r
  WHERE event_type IN ('click', 'signup', 'view') AND off BETWEEN 0 AND 1440
UNION ALL SELECT DISTINCT id, NULL, NULL, off, 1 FROM rx WHERE off BETWEEN 0 AND 1440""",
)
def evidence_by_time(spark, folder):
    return meds.ventilation_evidence(
        respcare(spark, folder), respcharting(spark, folder), respiratory_treatment(spark, folder)
    )


# --------------------------------------------------------------------------- drugs


INFUSION_OF = {
    "click": "Dopamine (ml/hr)",
    "view": "Levophed (mcg/min)",
    "purchase": "DOBUTamine (mcg/kg/min)",
    "signup": "Heparin (units/hr)",
}


def infusions(spark, folder):
    return readings(spark, folder).select(
        F.col("user_id").alias(KEY),
        F.floor(F.col("off") / 60).alias("infusionoffset"),
        recode("event_type", INFUSION_OF, "Normal saline (ml/hr)").alias("drugname"),
    )


def _infusion_sql(keys: str) -> str:
    tests = {"dopamine": "click", "dobutamine": "purchase", "norepinephrine": "view", "heparin": "signup"}
    cols = ", ".join(
        f"CAST(max(CASE WHEN event_type = '{tests[d]}' THEN 1 ELSE 0 END) AS SMALLINT) AS {d}"
        if d in tests
        else f"CAST(0 AS SMALLINT) AS {d}"
        for d in vocab.INFUSION_DRUGS
    )
    return f"SELECT {keys}, {cols} FROM r WHERE event_type <> 'error' GROUP BY ALL"


@query(
    "infusion_flags",
    with_items(READINGS)
    + _infusion_sql("user_id AS patientunitstayid, CAST(floor(off / 60.0) AS BIGINT) AS chartoffset"),
)
def infusion_flags(spark, folder):
    return meds.infusion_flags(infusions(spark, folder))


@query("infusion_flags_per_stay", with_items(READINGS) + _infusion_sql("user_id AS patientunitstayid"))
def infusion_flags_per_stay(spark, folder):
    return meds.infusion_flags(infusions(spark, folder), per_stay=True)


@query(
    "vasopressor_stays",
    """SELECT DISTINCT l_orderkey AS patientunitstayid, CAST(1 AS SMALLINT) AS vasopressor FROM lineitem
WHERE l_returnflag = 'A' AND l_quantity > 45""",
)
def vasopressor_stays(spark, folder):
    given = (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)
    lines = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(KEY),
        F.when(given, in_turn(vocab.VASOPRESSOR_TREATMENTS, "l_partkey")).otherwise("renal|dialysis").alias("treatmentstring"),
    )
    return meds.vasopressor_stays(lines)


ORDERED_CODES = {1: 37410, 2: 37407, 3: 8777, 4: 2060, 5: 37028, 6: 38884, 7: 9744, 8: 39654, 9: 2812}
NAMES = {"STANDARD": "Levophed drip", "ECONOMY": "EPINEPHrine HCl", "MEDIUM": "Neosynephrine", "PROMO": "Coumadin 5 mg"}


def medication(spark, folder):
    part = load(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") <= 9, F.element_at(F.create_map(*[F.lit(x) for p in ORDERED_CODES.items() for x in p]), F.col("p_size")))
        .when(F.col("p_size") > 40, 99999)
        .alias("drughiclseqno"),
        recode("p_type", NAMES, "Saline").alias("drugname"),
    )
    lines = load(spark, folder, "lineitem").join(part, "l_partkey")
    start = F.col("l_quantity").cast("long") - 1
    return lines.select(
        F.col("l_orderkey").alias(KEY),
        (F.col("l_linenumber") - 1).cast("long").alias("drugorderoffset"),
        start.alias("drugstartoffset"),
        (start * F.col("l_linenumber")).alias("drugstopoffset"),
        "drughiclseqno",
        "drugname",
        F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).alias("dosage"),
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("drugordercancelled"),
    )


CODED = {"norepinephrine": 1, "epinephrine": 2, "dobutamine": 3, "dopamine": 4, "phenylephrine": 5}
CODED.update({"vasopressin": 6, "milrinone": 7, "heparin": 8, "warfarin": 9})
NAMED = {"norepinephrine": "STANDARD", "epinephrine": "ECONOMY", "phenylephrine": "MEDIUM", "warfarin": "PROMO"}

ORDERED = (
    """ordered AS (SELECT l_orderkey AS patientunitstayid, nullif(l_linenumber - 1, 0)::BIGINT AS drugorderoffset,
  CAST(l_quantity AS BIGINT) - 1 AS chartoffset,
  nullif((CAST(l_quantity AS BIGINT) - 1) * l_linenumber, 0) AS drugstopoffset, """
    + ", ".join(
        f"""CAST(max(CASE WHEN p_size = {CODED[d]}"""
        + (f" OR (p_size BETWEEN 10 AND 40 AND p_type = '{NAMED[d]}')" if d in NAMED else "")
        + f" THEN 1 ELSE 0 END) AS SMALLINT) AS {d}"
        for d in vocab.ORDER_DRUGS
    )
    + """
  FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_discount > 0 AND l_returnflag <> 'R' AND l_quantity <> 1 GROUP BY ALL)"""
)


@query("med_flags", with_items(ORDERED) + "SELECT * FROM ordered")
def med_flags(spark, folder):
    return meds.medication_flags(medication(spark, folder))


@query(
    "vasopressor_orders",
    with_items(ORDERED)
    + """SELECT patientunitstayid, chartoffset, drugstopoffset FROM ordered
WHERE norepinephrine + epinephrine + dopamine + phenylephrine + vasopressin > 0""",
)
def vasopressor_orders(spark, folder):
    return meds.vasopressor_orders(meds.medication_flags(medication(spark, folder)))


# --------------------------------------------------------------------------- text and code vocabularies

CELLS = {
    "STANDARD": vocab.URINE_PREFIX + "Urine",
    "ECONOMY": vocab.URINE_PREFIX + "Foley cath #2",
    "MEDIUM": vocab.URINE_PREFIX + "foley in OR",
    "PROMO": vocab.URINE_PREFIX + "Output #1 Urinary Catheter 16F",
    "LARGE": vocab.URINE_PREFIX + "Stool",
}


@query(
    "vocab_sum",
    """SELECT l_suppkey AS patientunitstayid, CAST(l_quantity AS BIGINT) AS chartoffset, max(l_extendedprice) AS outputtotal,
  round(sum(CASE WHEN l_discount > 0.02 THEN l_discount * 100 END), 4) AS urineoutput
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_type IN ('STANDARD', 'ECONOMY', 'PROMO') AND l_discount > 0.02 GROUP BY ALL""",
)
def vocab_sum(spark, folder):
    part = load(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), recode("p_type", CELLS, "flowsheet|other").alias("cellpath")
    )
    cells = load(spark, folder, "lineitem").join(part, "l_partkey")
    cells = cells.select(
        F.col("l_suppkey").alias(KEY),
        F.col("l_quantity").cast("long").alias("intakeoutputoffset"),
        F.col("l_extendedprice").alias("outputtotal"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100).alias("cellvaluenumeric"),
        "cellpath",
    )
    return rounded(meds.urine_output(cells), 4, "urineoutput")


GROUPS = (
    ("red plate", "Trauma", 1),
    ("hot plate", "Trauma", 2),
    ("hot ring", "Sepsis", 1),
    ("hot ring", "Other surgery", 9),
    ("old rod", "CVA", 1),
    ("blue ring", "GIBleed", 3),
)


@query(
    "dx_group",
    """SELECT p_partkey, p_name, CASE WHEN p_name IN ('red plate', 'hot plate') THEN 'Trauma' WHEN p_name = 'hot ring' THEN 'Sepsis'
  WHEN p_name = 'old rod' THEN 'CVA' WHEN p_name = 'blue ring' THEN 'GIBleed' ELSE 'Other' END AS apachedxgroup FROM part""",
)
def dx_group(spark, folder):
    rows = ", ".join(f"('{t}', '{c}', {p})" for t, c, p in GROUPS)
    mapping = spark.sql(f"SELECT * FROM VALUES {rows} AS m(text, category, priority)")
    return history.diagnosis_group(load(spark, folder, "part").select("p_partkey", "p_name"), "p_name", mapping)


_DIAGNOSES = [(t, g) for g, texts in vocab.DIAGNOSIS_GROUPS.items() for t in texts]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    "dx_vocabulary",
    f"""SELECT p_partkey, CASE WHEN p_partkey % {len(_DIAGNOSES) + 3} < {len(_DIAGNOSES)}
  THEN {_sql_list([t for t, _ in _DIAGNOSES])}[p_partkey % {len(_DIAGNOSES) + 3} + 1] ELSE p_name END AS dx,
  CASE WHEN p_partkey % {len(_DIAGNOSES) + 3} < {len(_DIAGNOSES)}
  THEN {_sql_list([g for _, g in _DIAGNOSES])}[p_partkey % {len(_DIAGNOSES) + 3} + 1] ELSE 'Other' END AS apachedxgroup FROM part""",
)
def dx_vocabulary(spark, folder):
    """Every text of the vocabulary in turn, and some that are in no group."""
    n = len(_DIAGNOSES)
    at = F.pmod(F.col("p_partkey"), F.lit(n + 3)).cast("int")
    dx = F.when(at < n, F.array(*[F.lit(t) for t, _ in _DIAGNOSES])[at]).otherwise(F.col("p_name"))
    return history.diagnosis_group(load(spark, folder, "part").select("p_partkey", dx.alias("dx")), "dx")


@query(
    "sepsis_flag",
    """SELECT DISTINCT p_partkey AS patientunitstayid,
  CASE WHEN lower(p_name) LIKE '%hot%' AND p_type = 'PROMO' THEN 1 ELSE 0 END AS sepsis_binary FROM part""",
)
def sepsis_flag(spark, folder):
    hot = F.lower("p_name").contains("hot") & (F.col("p_type") == "PROMO")
    dx = F.when(hot, F.concat(F.lit("Sepsis, "), F.col("p_name"))).otherwise(F.col("p_name"))
    return history.sepsis_flag(
        load(spark, folder, "part").select(F.col("p_partkey").alias(KEY), dx.alias("apacheadmissiondx"))
    )


@query(
    "category_prefix",
    """SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'ASIAN' WHEN p_name LIKE 'hot%' THEN 'WHITE'
  WHEN p_name LIKE 'old%' THEN 'HISPANIC' WHEN p_name LIKE 'blue%' THEN 'BLACK' ELSE 'OTHERS' END AS grp FROM part""",
)
def category_prefix(spark, folder):
    prefix = F.split(F.col("p_name"), " ")[0]
    text = F.create_map(*[F.lit(x) for p in (("red", "ASIAN"), ("hot", "WHITE"), ("old", "HISPANIC"), ("blue", "BLACK")) for x in p])
    named = F.concat(F.coalesce(F.try_element_at(text, prefix), F.lit("UNKNOWN")), F.lit(" - "), F.col("p_name"))
    parts = load(spark, folder, "part").select("p_partkey", named.alias("ethnicity"))
    return parts.select("p_partkey", ethnicity_group().alias("grp"))


@query(
    "like_any_flags",
    r"""SELECT doc_id, CASE WHEN text ILIKE '%license%' OR text ILIKE '%copyright%' THEN 1 ELSE 0 END AS legal,
  CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END AS has_at, CASE WHEN regexp_matches(text, '(?i)the\s+th') THEN 1 ELSE 0 END AS the_th,
  CASE WHEN starts_with(text, 'Th') OR starts_with(text, 'An') THEN 1 ELSE 0 END AS prefix,
  CASE WHEN regexp_matches(text, '^(Is|On|La)') THEN 1 ELSE 0 END AS similar_to,
  CASE WHEN lower(text) NOT LIKE '%ing%' THEN 1 ELSE 0 END AS no_ing FROM documents""",
)
def like_any_flags(spark, folder):
    text = F.col("text")
    return load(spark, folder, "documents").select(
        "doc_id",
        flag(like_any(text, ["%license%", "%copyright%"], ci=True)).alias("legal"),
        flag(like_any(text, ["%@%"])).alias("has_at"),
        flag(text.rlike(r"(?i)the\s+th")).alias("the_th"),
        flag(starts_with_any(text, ["Th", "An"])).alias("prefix"),
        flag(text.rlike("^(Is|On|La)")).alias("similar_to"),
        flag(~F.lower(text).like("%ing%")).alias("no_ing"),
    )


CODES = {"1-URGENT": "42731", "2-HIGH": "5855 ", "3-MEDIUM": "4111", "4-NOT SPECIFIED": "490  ", "5-LOW": "1745"}


@query(
    "code_prefix_flags",
    "SELECT o_custkey AS hadm_id, "
    + ", ".join(
        f"max(CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS {n}"
        for n, p in (("afib", "1-URGENT"), ("ckd", "2-HIGH"), ("ihd", "3-MEDIUM"), ("copd", "4-NOT SPECIFIED"), ("cancer", "5-LOW"))
    )
    + """, max(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 1 ELSE 0 END) AS cld,
  max(CASE WHEN o_orderstatus = 'P' AND o_totalprice <= 50000 THEN 1 ELSE 0 END) AS cereb
FROM orders GROUP BY o_custkey""",
)
def code_prefix_flags(spark, folder):
    code = (
        F.when(F.col("o_orderstatus") != "P", recode("o_orderpriority", CODES))
        .when(F.col("o_totalprice") > 250000, "5712 ")
        .when(F.col("o_totalprice") <= 50000, "43491")
        .otherwise("25000")
    )
    codes = load(spark, folder, "orders").select(F.col("o_custkey").alias("hadm_id"), code.alias("icd9_code"))
    return history.comorbidity_flags(codes)


FRAGMENTS = {"1-URGENT": "401.9, I10", "2-HIGH": "428.0, I50.9", "3-MEDIUM": "427.31, I48.91", "4-NOT SPECIFIED": "E11.9"}


@query(
    "history_flags",
    "SELECT o_custkey AS patientunitstayid, "
    + ", ".join(
        f"max(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS {n}" if p else f"0 AS {n}"
        for n, p in (
            ("hypertension", "1-URGENT"),
            ("atrial_fibrillation", "3-MEDIUM"),
            ("cancer", None),
            ("chf", "2-HIGH"),
            ("ckd", None),
            ("cld", None),
            ("copd", None),
            ("diabetes", "4-NOT SPECIFIED"),
            ("ihd", None),
            ("cebrovascular_accident", None),
        )
    )
    + " FROM orders GROUP BY o_custkey",
)
def history_flags(spark, folder):
    codes = load(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY), recode("o_orderpriority", FRAGMENTS).alias("icd9code")
    )
    return history.history_flags(codes)


@query(
    "flag_pivot",
    "SELECT user_id, "
    + ", ".join(
        f"max(CASE WHEN event_type = '{t}' AND value > 100 THEN 1 ELSE 0 END) AS {t}"
        for t in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events GROUP BY user_id",
)
def flag_pivot(spark, folder):
    tests = {
        t: (F.col("event_type") == t) & (F.col("value") > 100) for t in ("click", "error", "purchase", "signup", "view")
    }
    return history.flag_pivot(load(spark, folder, "events"), ["user_id"], tests)


@query(
    "any_flag_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_discount = 0.1 OR l_tax = 0.08 OR (l_quantity = 50 AND l_returnflag = 'N')""",
)
def any_flag_rows(spark, folder):
    tests = [
        F.col("l_discount") == 0.1,
        F.col("l_tax") == 0.08,
        (F.col("l_quantity") == 50) & (F.col("l_returnflag") == "N"),
    ]
    return load(spark, folder, "lineitem").filter(any_of(tests)).select("l_orderkey", "l_linenumber", "l_partkey")


# --------------------------------------------------------------------------- guards, masks, repairs

MIXED = """CASE WHEN p_size % 7 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN p_size || '.' WHEN p_size % 3 = 0 THEN '-' || p_size || '.5'
  WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END"""


@query(
    "numeric_guard",
    f"""SELECT p_partkey, t AS text, CASE WHEN regexp_full_match(t, '-?[0-9]+\\.?[0-9]*') THEN TRY_CAST(t AS DOUBLE) END AS number,
  CASE WHEN regexp_full_match(t, '[0-9]{{0,5}}') THEN TRY_CAST(t AS DOUBLE) END AS whole,
  regexp_full_match(t, '-?[0-9]+\\.?[0-9]*') AS passes FROM (SELECT p_partkey, {MIXED} AS t FROM part)""",
)
def numeric_guard(spark, folder):
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    mixed = (
        F.when(size % 7 == 0, F.col("p_brand"))
        .when(size % 5 == 0, F.concat(text, F.lit(".")))
        .when(size % 3 == 0, F.concat(F.lit("-"), text, F.lit(".5")))
        .when(size % 2 == 0, text)
        .otherwise("")
    )
    parts = load(spark, folder, "part").select("p_partkey", mixed.alias("text"))
    return parts.select(
        "p_partkey",
        "text",
        to_number("text").alias("number"),
        to_number("text", INTEGER_TEXT).alias("whole"),
        is_numeric("text").alias("passes"),
    )


@query(
    "numeric_audit",
    f"SELECT p_partkey, t AS text FROM (SELECT p_partkey, {MIXED} AS t FROM part) WHERE NOT regexp_full_match(t, '-?[0-9]+\\.?[0-9]*')",
)
def numeric_audit(spark, folder):
    return numeric_guard(spark, folder).filter(~F.col("passes")).select("p_partkey", "text")


@query(
    "mask_by_item",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value > 5 AND value < 60 THEN value
  WHEN event_type = 'view' AND value > 0.5 AND value < 20 THEN value END AS kept FROM events""",
)
def masked(spark, folder):
    kept = mask_by_item("event_type", "value", {"click": (5, 60), "view": (0.5, 20)})
    return load(spark, folder, "events").select("event_id", kept.alias("kept"))


@query(
    "zero_repair_fill",
    """SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS repaired, COALESCE(nullif(l_tax, 0), 0.21) AS filled,
  CASE WHEN l_quantity < 10 THEN 0.0 ELSE l_quantity END AS l_quantity FROM lineitem""".replace(
        "0.21)", "0.21::DOUBLE)"
    ).replace("THEN 0.0 ELSE", "THEN 0.0::DOUBLE ELSE"),
)
def zero_repair_fill(spark, folder):
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        nullif_zero("l_discount").alias("repaired"),
        nullif_zero("l_tax").alias("filled"),
        "l_quantity",
    )
    return set_where(lines.fillna(0.21, ["filled"]), F.col("l_quantity") < 10, "l_quantity", 0.0)


@query(
    "complete_cases",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0""",
)
def complete_rows(spark, folder):
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", nullif_zero("l_discount").alias("l_discount"), nullif_zero("l_tax").alias("l_tax")
    )
    return complete_cases(lines, ["l_discount", "l_tax"])


EXCLUDED = """c_acctbal < 0 OR c_mktsegment = 'MACHINERY' OR COALESCE(c_nationkey > 20, FALSE)"""


def _flagged(spark, folder):
    return load(spark, folder, "customer").select(
        "c_custkey",
        "c_mktsegment",
        (F.col("c_acctbal") < 0).alias("exclude_age"),
        F.when(F.col("c_mktsegment") == "MACHINERY", True).alias("exclude_gender"),
        (F.col("c_nationkey") > 20).alias("exclude_apache"),
    )


FLAGS = ["exclude_age", "exclude_gender", "exclude_apache"]


@query("exclusions", f"SELECT c_custkey, c_mktsegment FROM customer WHERE NOT ({EXCLUDED})")
def exclusions(spark, folder):
    return apply_exclusions(_flagged(spark, folder), FLAGS).select("c_custkey", "c_mktsegment")


@query("exclusions_complement", f"SELECT c_custkey, c_mktsegment FROM customer WHERE {EXCLUDED}")
def exclusions_complement(spark, folder):
    return apply_exclusions(_flagged(spark, folder), FLAGS, excluded=True).select("c_custkey", "c_mktsegment")


# --------------------------------------------------------------------------- fluids and body size


@query(
    "last_net_total",
    """SELECT l_suppkey AS patientunitstayid, l_extendedprice AS nettotal FROM (SELECT *, row_number() OVER (
  PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_extendedprice) AS n FROM lineitem) WHERE n = 1""",
)
def last_net_total(spark, folder):
    rows = load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_shipdate").alias("intakeoutputoffset"), F.col("l_extendedprice").alias("nettotal")
    )
    return fluids.last_net_total(rows)


@query(
    "fluid_balance",
    """WITH i AS (SELECT l_orderkey AS icustay_id, CASE WHEN l_returnflag = 'A' THEN l_extendedprice
      WHEN l_linestatus = 'F' THEN l_quantity * 1000 ELSE l_quantity END AS amount
  FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'O') OR (l_returnflag = 'N' AND l_quantity > 1)),
t AS (SELECT icustay_id, sum(amount) AS total_input FROM i GROUP BY 1),
o AS (SELECT l_orderkey, sum(l_extendedprice) AS total_output FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT icustay_id, round(total_input, 2) AS total_input, round(total_output, 2) AS total_output,
  round(total_input - total_output, 2) + 0.0 AS nettotal FROM t LEFT JOIN o ON l_orderkey = icustay_id""",
)
def fluid_balance(spark, folder):
    lines = load(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "icustay_id")
    bolus = lines.filter(F.col("l_returnflag") == "A").select(
        "icustay_id",
        in_turn(vocab.FLUID_ITEMS_BOLUS, "l_partkey").alias("itemid"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "mL").otherwise("units").alias("amountuom"),
    )
    rate = lines.filter(F.col("l_returnflag") == "N").select(
        "icustay_id",
        in_turn(vocab.FLUID_ITEMS_RATE, "l_partkey").alias("itemid"),
        F.col("l_quantity").alias("amount"),
        F.when(F.col("l_linestatus") == "F", "L").otherwise("ml").alias("amountuom"),
        F.lit(2).alias("starttime"),
        F.col("l_quantity").alias("endtime"),
    )
    urine = lines.filter(F.col("l_returnflag") == "R").select("icustay_id", F.col("l_extendedprice").alias("value"))
    return rounded(fluids.fluid_balance(bolus, rate, urine), 2, "total_input", "total_output", "nettotal")


# Events as height charts: clicks in inches, views in cm, errors marked as such; births 100 days before the first event
# make everything adult only for odd users.
def _people(spark, folder):
    events = load(spark, folder, "events")
    first = events.groupBy(F.col("user_id").alias("subject_id")).agg(F.min("ts").alias("intime"))
    born = F.when(F.col("subject_id") % 2 == 1, F.col("intime") - F.expr("INTERVAL '30' YEAR")).otherwise(
        F.col("intime") - F.expr("INTERVAL '100' DAY")
    )
    return first.select("subject_id", F.col("subject_id").alias("icustay_id"), "intime", born.alias("dob"))


def _heights(spark, folder):
    item = recode("event_type", {"click": 920, "view": 3485, "error": 4188}, 1)
    return load(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"),
        F.col("user_id").alias("icustay_id"),
        F.col("ts").alias("charttime"),
        item.alias("itemid"),
        F.col("value").alias("valuenum"),
        F.when(F.col("event_type") == "error", 1).alias("error"),
    )


CM = """h AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN value * 2.54 ELSE value END AS cm
  FROM events WHERE event_type IN ('click', 'view') AND value <> 0)"""


@query(
    "body_size",
    with_items(
        CM,
        """ok AS (SELECT user_id, ts, cm FROM h WHERE (user_id % 2 = 1 AND cm > 120 AND cm < 230) OR (user_id % 2 = 0 AND cm < 80))""",
        """hs AS (SELECT user_id, arg_min(cm, ts) AS f, arg_max(cm, ts) AS l, min(cm) AS mn, max(cm) AS mx FROM ok GROUP BY 1)""",
        """ws AS (SELECT user_id, arg_min(value, ts) AS f, arg_max(value, ts) AS l, min(value) AS mn, max(value) AS mx
  FROM events WHERE event_type = 'signup' GROUP BY 1)""",
    )
    + """SELECT e.user_id AS icustay_id, round(w.f, 2) AS weight_first, round(w.l, 2) AS weight_last, round(w.mn, 2) AS weight_min,
  round(w.mx, 2) AS weight_max, round(h.f, 2) AS height_first, round(h.l, 2) AS height_last, round(h.mn, 2) AS height_min,
  round(h.mx, 2) AS height_max FROM (SELECT DISTINCT user_id FROM events) e
LEFT JOIN ws w ON w.user_id = e.user_id LEFT JOIN hs h ON h.user_id = e.user_id""",
)
def body_size(spark, folder):
    weights = load(spark, folder, "events").filter(F.col("event_type") == "signup")
    weights = weights.select(
        F.col("user_id").alias("icustay_id"), F.col("ts").alias("starttime"), F.col("value").alias("weight")
    )
    people = _people(spark, folder)
    return fluids.body_size(people, weights, _heights(spark, folder), people)


@query(
    "admission_height",
    with_items(
        CM,
        "s AS (SELECT user_id, min(ts) AS intime FROM events GROUP BY 1)",
        """c AS (SELECT h.user_id, avg(cm) AS v FROM h JOIN s ON s.user_id = h.user_id
  AND h.ts > s.intime - INTERVAL 1 DAY AND h.ts <= s.intime + INTERVAL 1 DAY WHERE cm > 100 GROUP BY 1)""",
        """n AS (SELECT e.user_id, avg(value) * 2.54 AS v FROM events e JOIN s ON s.user_id = e.user_id
  AND e.ts < s.intime + INTERVAL 1 DAY WHERE e.event_type = 'signup' AND value * 2.54 > 100 GROUP BY 1)""",
    )
    + """SELECT s.user_id AS icustay_id, round(COALESCE(c.v, n.v), 6) AS height, round(c.v, 6) AS height_chart,
  round(n.v, 6) AS height_echo FROM s LEFT JOIN c ON c.user_id = s.user_id LEFT JOIN n ON n.user_id = s.user_id
WHERE s.user_id % 2 = 1""",
)
def admission_height(spark, folder):
    notes = load(spark, folder, "events").filter(F.col("event_type") == "signup")
    notes = notes.select(F.col("user_id").alias("subject_id"), F.col("ts").alias("charttime"), F.col("value").alias("height"))
    people = _people(spark, folder)
    out = fluids.admission_height(people, people, _heights(spark, folder), notes)
    return rounded(out, 6, "height", "height_chart", "height_echo")
