"""The driver's tables read as claims, statements, pairs and predictions; in Spark and as SQL.

Conversations are claims and their turns statements; what they lack is derived from conv_id and turn by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.labels import CLAIM_LABELS

from siltstone.sources.tables import table

ROLES = {"user": "insured_driver", "assistant": "third_party_driver", "system": "impartial_witness"}
VEHICLES = ("none", "Blue  sedan", "")
INCIDENTS = ("rear-end", "side  swipe", "Intersection crash")
#: Indicators by conv_id modulo 12: every branch of the label rules is met.
INDICATORS = (
    (), ("Damage inflation noted",), ("Physics mismatch", "right-of-way dispute"), ("No evidence of second vehicle",),
    (), ("Overly consistent story",), ("Coordinated  accounts",), ("suspiciously well told",),
    (), ("unclear motive",), ("unclear",), ("threat to rush the claim", " "),
)
#: Damages by conv_id modulo 5.
DAMAGES = (("Dent", "scratch", "dent"), ("glass  shatter",), (), ("lamp broken", "crack"), ("Scratch ",))


def _pick(number: Column, values: tuple) -> Column:
    one = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)
    return F.element_at(F.array(*map(one, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, claim_id, turn, role, vehicle, text."""
    role = F.col("role")
    for k, v in ROLES.items():
        role = F.when(F.col("role") == k, v).otherwise(role)
    return table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("C-"), F.col("conv_id").cast("string")).alias("claim_id"), "turn", role.alias("role"), _pick(F.col("conv_id") + F.col("turn"), VEHICLES).alias("vehicle"), "text")


def attributes(df: DataFrame) -> DataFrame:
    """df with conv_id -> the claim's label, location, incident_type, damages and indicators added."""
    n = F.col("conv_id")
    return df.withColumns({"label": _pick(n, CLAIM_LABELS), "location": F.concat(F.lit("City "), F.pmod(n, F.lit(7)).cast("string")), "incident_type": _pick(n, INCIDENTS), "damages": _pick(n, DAMAGES), "indicators": _pick(n, INDICATORS)})


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a claim, statements in order."""
    s = statements(spark, sf_dir).groupBy("conv_id", "claim_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "vehicle", "text"))), lambda x: F.struct(x["role"].alias("role"), x["vehicle"].alias("vehicle"), x["text"].alias("text"))).alias("statements"))
    return attributes(s)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gt, prob (null where not valid), pred, valid, label (of four)."""
    lab = table(spark, sf_dir, "labels")
    p = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0
    valid = F.pmod(F.col("doc_id"), F.lit(13)) != 0
    rows = lab.select("doc_id", F.when(F.col("quality") == 1, "true").otherwise("not_true").alias("gt"), F.when(valid, p).alias("prob"), valid.alias("valid"), _pick(F.col("doc_id"), CLAIM_LABELS).alias("label"))
    return rows.withColumn("pred", F.when(F.col("prob") >= 0.5, "true").when(F.col("prob") < 0.5, "not_true"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as pairs: id, label, inconsistency_type, role_a, role_b, claim_a, claim_b."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    kinds = ("damage_mismatch", "dynamics_mismatch", "phantom_vehicle")
    y = _pick(F.pmod(n * 7, F.lit(11)), ("supports", "neutral", "contradicts", "supports", "supports", "neutral", "contradicts", "neutral", "supports", "supports", "neutral"))
    roles = ("insured_driver", "third_party_driver", "impartial_witness")
    return d.select(n.alias("id"), y.alias("label"), F.when(y == "contradicts", _pick(n, kinds)).otherwise("none").alias("inconsistency_type"), _pick(n, roles).alias("role_a"), _pick(F.floor(n / 3).cast("long"), roles).alias("role_b"), F.concat(F.lit("C"), F.pmod(n, F.lit(61)).cast("string")).alias("claim_a"), F.concat(F.lit("C"), F.pmod(n * 5, F.lit(67)).cast("string")).alias("claim_b"))


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims of one statement: pos, id (repeats), location, incident_type, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.pmod("doc_id", F.lit(950)).cast("string").alias("id"), F.col("source").alias("location"), F.col("lang").alias("incident_type"), "text")


# The same as SQL.
def _lit(v: object) -> str:
    if isinstance(v, tuple):
        return "CAST([" + ", ".join(map(_lit, v)) + "] AS VARCHAR[])"
    return "'" + str(v).replace("'", "''") + "'"


def pick(number: str, values: tuple) -> str:
    return f"([{', '.join(map(_lit, values))}])[CAST(({number}) % {len(values)} AS INT) + 1]"


WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def ns(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def nt(x: str) -> str:
    return f"lower({ns(x)})"


def cw(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS BIGINT)"


S = "s AS (SELECT conv_id, 'C-' || conv_id AS claim_id, turn, CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + f" ELSE role END AS role, {pick('conv_id + turn', VEHICLES)} AS vehicle, text FROM conversations)"
C = f"c AS (SELECT conv_id, 'C-' || conv_id AS claim_id, {pick('conv_id', CLAIM_LABELS)} AS label, 'City ' || (conv_id % 7) AS location, {pick('conv_id', INCIDENTS)} AS incident_type, {pick('conv_id', DAMAGES)} AS damages, {pick('conv_id', INDICATORS)} AS indicators FROM (SELECT DISTINCT conv_id FROM conversations))"
P = f"p0 AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'not_true' END AS gt, CASE WHEN doc_id % 13 <> 0 THEN ((doc_id * 37) % 101) / 100.0::DOUBLE END AS prob, doc_id % 13 <> 0 AS valid, {pick('doc_id', CLAIM_LABELS)} AS label FROM labels), p AS (SELECT *, CASE WHEN prob >= 0.5 THEN 'true' WHEN prob < 0.5 THEN 'not_true' END AS pred FROM p0)"
_Y = pick("(doc_id * 7) % 11", ("supports", "neutral", "contradicts", "supports", "supports", "neutral", "contradicts", "neutral", "supports", "supports", "neutral"))
_R = ("insured_driver", "third_party_driver", "impartial_witness")
R = f"r AS (SELECT doc_id AS id, {_Y} AS label, CASE WHEN {_Y} = 'contradicts' THEN {pick('doc_id', ('damage_mismatch', 'dynamics_mismatch', 'phantom_vehicle'))} ELSE 'none' END AS inconsistency_type, {pick('doc_id', _R)} AS role_a, {pick('doc_id // 3', _R)} AS role_b, 'C' || (doc_id % 61) AS claim_a, 'C' || ((doc_id * 5) % 67) AS claim_b FROM documents)"
D = "d AS (SELECT doc_id AS pos, CAST(doc_id % 950 AS VARCHAR) AS id, source AS location, lang AS incident_type, text FROM documents)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def fingerprint(with_label: bool = False) -> str:
    return f"sha256({nt('location')} || '||' || {nt('incident_type')} || '||' || {chr(39) + 'genuine_accident||' + chr(39) + ' ||' if with_label else ''} '' || '||' || 'insured_driver::none::' || {nt('text')})"


