"""Labels derived from claims: fixed vocabularies and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import normalize_space, normalize_text, text

#: Claim labels and the two verdicts they collapse to.
CLAIM_LABELS = ("genuine_accident", "soft_fraud_exaggeration", "hard_fraud_staged", "hard_fraud_phantom_vehicle")
BINARY = {"genuine_accident": "true", "soft_fraud_exaggeration": "not_true", "hard_fraud_staged": "not_true", "hard_fraud_phantom_vehicle": "not_true"}
RELATION_IDS = {"supports": 0, "neutral": 1, "contradicts": 2}
INCONSISTENCY_IDS = {"none": 0, "damage_mismatch": 1, "dynamics_mismatch": 2, "phantom_vehicle": 3, "scripted_narrative": 4}
DAMAGE_CLASSES = ("crack", "dent", "glass shatter", "lamp broken", "scratch")
#: Indicator phrases of a supporting account.
SUPPORT_MARKERS = (
    "supporting insured driver",
    "supports the insured",
    "supports the insured driver",
    "supports the insured's narrative",
    "supporting insured driver’s narrative",
    "suspiciously well",
    "overly consistent",
    "coordinated",
    "scripted",
    "confirms sudden cut-in, supporting insured",
)
#: Indicator phrases by inconsistency, the first kind that hits counts.
INCONSISTENCY_MARKERS = {
    "phantom_vehicle": (
        "phantom",
        "no evidence of second vehicle",
        "missing vehicle evidence",
        "no_third_party_evidence",
        "no supporting evidence of second vehicle",
        "phantom vehicle evidence gap",
        "missing phantom vehicle",
    ),
    "damage_mismatch": (
        "missing from detected_damages",
        "damage mismatch",
        "damage_mismatch",
        "damage inflation",
        "damage_inflation",
        "class mismatch",
        "class_mismatch",
        "detected_damages mismatch",
        "inconsistent damage",
        "narrative claims more damage than detected",
    ),
    "dynamics_mismatch": (
        "physics mismatch",
        "physics_mismatch",
        "staged dynamic",
        "staged dynamics",
        "staged mechanics",
        "staged collision",
        "minor side scratch does not shatter glass",
        "right-of-way",
    ),
    "scripted_narrative": (
        "coordinated",
        "scripted",
        "suspiciously",
        "defensive scriptwriter",
        "impatient aggressor",
        "evasive opportunist",
        "overly controlled",
        "perfect account",
        "rush the claim",
        "threat",
    ),
}
#: What a claim's label says of the inconsistency when no phrase does.
INCONSISTENCY_DEFAULTS = {"hard_fraud_phantom_vehicle": "phantom_vehicle", "soft_fraud_exaggeration": "damage_mismatch", "hard_fraud_staged": "dynamics_mismatch"}
#: Words that an explanation of a kind of fraud is expected to use.
THEMES = {
    "soft_fraud_exaggeration": ("minor impact", "low-speed", "low speed", "disproportionate", "exaggerated", "severity", "injury", "compensation"),
    "hard_fraud_staged": ("staged", "coordinated", "scripted", "arranged", "pre-arranged", "sudden braking", "unusual narrative"),
    "hard_fraud_phantom_vehicle": ("phantom", "unknown vehicle", "unidentified vehicle", "vehicle disappeared", "no witness", "vanished", "missing vehicle"),
}
#: The target of a claim that no teacher has seen.
TEMPLATE_TARGETS = {
    "true": (0.85, "The narratives are coherent and the described damage aligns with the reported incident.", ()),
    "not_true": (0.15, "The claim contains inconsistencies or implausible elements compared to the reported damage.", ("Statement and damage description are not fully consistent.",)),
}


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def cycled(number: Column, names: tuple[str, ...] = CLAIM_LABELS) -> Column:
    """The label of the claim with this number, numbers from 1."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number - 1, F.lit(len(names))) + 1).cast("int"))


def binary_label(c: Column | str, strict: bool = True) -> Column:
    """true or not_true; an unknown label stops the query, or, not strict, counts as a fraud (1, else 0)."""
    if not strict:
        return F.when(text(c) == "genuine_accident", 0).otherwise(1)
    n = normalize_space(c)
    return F.when(n == "genuine_accident", "true").when(n.isin(*CLAIM_LABELS[1:]), "not_true").otherwise(F.raise_error(F.concat(F.lit("Unsupported claim label: "), n)))


def relation_label(label: Column | str, indicators: Column | str) -> Column:
    """supports, contradicts or null; indicator texts are searched as they are, but for case."""
    said = F.lower(F.array_join(indicators, " | "))
    name = F.trim(text(label))
    return F.when(name == "genuine_accident", "supports").when(any_of(said, SUPPORT_MARKERS), "supports").when(name.isin(*CLAIM_LABELS[1:]), "contradicts")


def inconsistency_type(label: Column | str, indicators: Column | str) -> Column:
    """The first kind of which a phrase is found in the normalised indicators, or the label's own."""
    said = F.array_join(F.filter(F.transform(F.col(indicators) if isinstance(indicators, str) else indicators, normalize_text), lambda x: x != ""), " | ")
    name = normalize_text(label)
    out = F.when(name == "genuine_accident", "none")
    for kind, phrases in INCONSISTENCY_MARKERS.items():
        out = out.when(any_of(said, phrases), kind)
    for own, kind in INCONSISTENCY_DEFAULTS.items():
        out = out.when(name == own, kind)
    return out.otherwise("none")


def theme_hit(c: Column | str, label: Column | str) -> Column:
    said, out = normalize_text(c), F.lit(False)
    for name, phrases in THEMES.items():
        out = out | ((F.col(label) if isinstance(label, str) else label).eqNullSafe(name) & any_of(said, phrases))
    return out


def name_id(c: Column | str, ids: dict[str, int]) -> Column:
    """A label's number; an unknown label stops the query."""
    n = F.lower(F.trim(text(c)))
    out = None
    for k, v in ids.items():
        out = F.when(n == k, v) if out is None else out.when(n == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("Unsupported label: "), n)))


def template_target(binary: Column | str) -> Column:
    b = F.col(binary) if isinstance(binary, str) else binary

    def one(name: str) -> Column:
        p, why, odd = TEMPLATE_TARGETS[name]
        return F.struct(F.lit(p).alias("probability_true"), F.lit(name).alias("verdict"), F.lit(why).alias("reasoning"), F.array(*map(F.lit, odd)).cast("array<string>").alias("incongruences"))

    return F.when(b == "true", one("true")).otherwise(one("not_true"))


def risk_band(p: Column) -> Column:
    """(band, confidence in percent) of a probability of fraud."""
    return F.struct(F.when(p >= 0.65, "critical").when(p >= 0.40, "review").otherwise("genuine").alias("band"), F.when(p >= 0.40, p * 100).otherwise((1 - p) * 100).alias("confidence"))


def normalize_verdict(c: Column | str) -> Column:
    v = F.trim(F.lower(F.col(c) if isinstance(c, str) else c))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(v.isin("true", "verdadeiro"), "true").when(v.isin("not_true", "false", "falso"), "not_true").when(F.contains(v, F.lit("not")) | F.contains(v, F.lit("false")), "not_true").otherwise("true")
