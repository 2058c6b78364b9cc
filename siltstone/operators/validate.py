"""Row validators: a reason (the first rule that fails, or 'ok') or a list of all errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.labels import CLAIM_LABELS, DAMAGE_CLASSES, INCONSISTENCY_IDS, RELATION_IDS
from siltstone.functions.text import SCENE_ROLES, count_words, normalize_space, normalize_text, text

#: Least words of the insured's statement, of others' and of the claim; good claims ask for more.
MIXED_WORDS, GOOD_WORDS, SINGLE_WORDS = (35, 20, 80), (45, 25, 85), 70
#: Annotations know no scripted narratives.
ANNOTATED_TYPES = tuple(k for k in INCONSISTENCY_IDS if k != "scripted_narrative")
#: Words that an answer must not give away.
LEAKS = (
    "ground_truth_label",
    "fraud_indicators",
    "genuine_accident",
    "soft_fraud_exaggeration",
    "hard_fraud_staged",
    "hard_fraud_phantom_vehicle",
    "teacher",
    "synthetic dataset",
    "binary_label",
)


def _first(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules])


def _says(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def clean_statements(statements: Column) -> Column:
    """Statements with a role, a vehicle and a text, normalised, with their words; the others are left out."""
    s = F.transform(statements, lambda x: F.struct(normalize_text(x["role"]).alias("role"), normalize_space(x["vehicle"]).alias("vehicle"), normalize_space(x["text"]).alias("text")))
    s = F.filter(s, lambda x: (x["role"] != "") & (x["vehicle"] != "") & (x["text"] != ""))
    return F.transform(s, lambda x: F.struct(x["role"].alias("role"), x["vehicle"].alias("vehicle"), x["text"].alias("text"), count_words(x["text"]).alias("words")))


def statement_fault(cleaned: Column, words: tuple[int, int, int]) -> Column:
    """The first statement's fault in order, or null."""
    def one(x: Column) -> Column:
        insured = x["role"] == "insured_driver"
        return _first(
            (~x["role"].isin(*SCENE_ROLES), _says("unsupported role: ", x["role"])),
            (insured & (x["words"] < words[0]), _says("insured_driver statement too short: ", x["words"].cast("string"), " words")),
            (~insured & (x["words"] < words[1]), _says(x["role"], " statement too short: ", x["words"].cast("string"), " words")),
        )

    return F.try_element_at(F.filter(F.transform(cleaned, one), lambda m: m.isNotNull()), F.lit(1))


def _damage_fault(damages: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(damages, lambda d: F.when(~normalize_text(d).isin(*DAMAGE_CLASSES), _says("unsupported damage: ", text(d)))), lambda m: m.isNotNull()), F.lit(1))


def claim_reason(c: dict[str, Column], expected_label: Column | None = None) -> Column:
    """Rules of a mixed claim; c: claim_id, label, location, incident_type, damages, indicators, statements, and cleaned
    (clean_statements of statements)."""
    label, words = normalize_space(c["label"]), MIXED_WORDS
    said = F.filter(F.transform(c["indicators"], normalize_space), lambda x: x != "")
    done = c["cleaned"]
    total = F.aggregate(done, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    genuine = label == "genuine_accident"
    return F.coalesce(_first(
        (normalize_space(c["claim_id"]) == "", "claim_id is empty"),
        (~label.isin(*CLAIM_LABELS), _says("invalid label: ", label)),
        *([(~expected_label.eqNullSafe(label), _says("unexpected label for ", normalize_space(c["claim_id"]), ": ", label))] if expected_label is not None else []),
        (normalize_space(c["location"]) == "", "location is empty"),
        (normalize_space(c["incident_type"]) == "", "incident_type is empty"),
        (F.coalesce(F.size(c["damages"]), F.lit(0)) <= 0, "detected_damages must be a non-empty list"),
    ), _damage_fault(c["damages"]), _first(
        (c["indicators"].isNull(), "fraud_indicators must be a list"),
        (genuine & (F.size(said) > 0), "genuine_accident must have empty fraud_indicators"),
        (~genuine & (F.size(said) == 0), "fraud labels must include fraud_indicators"),
        (c["statements"].isNull(), "statements must be a list"),
        (~F.size(c["statements"]).between(2, 3), "claims must contain 2 or 3 statements"),
    ), statement_fault(done, words), _first(
        (F.size(done) < 2, "not enough valid statements"),
        (~F.exists(done, lambda x: x["role"] == "insured_driver"), "missing insured_driver statement"),
        (~F.exists(done, lambda x: x["role"] != "insured_driver"), "missing non-insured statement"),
        (total < words[2], _says("claim total text too short: ", total.cast("string"), " words")),
    ), F.lit("ok"))


def good_claim_reason(c: dict[str, Column]) -> Column:
    """Rules of a genuine claim; longer texts, no indicators, one statement may do."""
    label, words, done = normalize_space(c["label"]), GOOD_WORDS, c["cleaned"]
    total = F.aggregate(done, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return F.coalesce(_first(
        (normalize_space(c["claim_id"]) == "", "claim_id is empty"),
        (normalize_space(c["location"]) == "", "location is empty"),
        (normalize_space(c["incident_type"]) == "", "incident_type is empty"),
        (label != "genuine_accident", _says("invalid label: ", label)),
        (F.coalesce(F.size(c["indicators"]), F.lit(-1)) != 0, "fraud_indicators must be []"),
        (F.coalesce(F.size(c["damages"]), F.lit(0)) <= 0, "detected_damages must be a non-empty list"),
    ), _damage_fault(c["damages"]), F.when(F.coalesce(F.size(c["statements"]), F.lit(0)) <= 0, "statements must be a non-empty list"), statement_fault(done, words), _first(
        (F.size(done) == 0, "no valid statements found"),
        (~F.exists(done, lambda x: x["role"] == "insured_driver"), "missing insured_driver statement"),
        ((F.size(done) == 1) & (total < SINGLE_WORDS), _says("single-statement claim too short: ", total.cast("string"), " words")),
        (total < words[2], _says("claim total text too short: ", total.cast("string"), " words")),
    ), F.lit("ok"))


def target_errors(probability: Column, verdict: Column, reasoning: Column, incongruences: Column, guard: bool = False) -> Column:
    """All errors of a model's answer; probability as text, as it may be quoted; NaN is out of range."""
    p = F.coalesce(probability.try_cast("double"), F.lit(-1.0))
    v, why = normalize_text(verdict), normalize_space(reasoning)
    inside = (p >= 0.0) & (p <= 1.0)
    checks = [
        (probability.try_cast("double").isNull(), F.lit("probability_true must be numeric")),
        (~inside, F.lit("probability_true must be between 0 and 1")),
        (~v.isin("true", "not_true"), F.lit("verdict must be true or not_true")),
        (why == "", F.lit("reasoning must be non-empty")),
        ((v == "true") & (p < 0.5), F.lit("verdict=true must have probability_true >= 0.5")),
        ((v == "not_true") & (p >= 0.5), F.lit("verdict=not_true must have probability_true < 0.5")),
    ]
    if guard:
        said = F.concat_ws("\n", F.lower(why), F.lower(F.array_join(F.coalesce(incongruences, F.array().cast("array<string>")), " ")))
        leak = _first(*[(F.contains(said, F.lit(t)), f"response leaked hidden supervision term: {t}") for t in LEAKS])
        checks.append(((why != "") & leak.isNotNull(), leak))
    return F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))


def _pair_rules(label: Column, kind: Column) -> list[tuple[Column, str]]:
    return [
        ((label != "contradicts") & (kind != "none"), "non-contradictory labels must use inconsistency_type=none"),
        ((label == "contradicts") & (kind == "none"), "contradicts must not use inconsistency_type=none"),
    ]


def annotation_reason(expected: Column, label: Column, kind: Column, rationale: Column, confidence: Column) -> Column:
    """A teacher's annotation; expected: its pair was asked for; confidence as text."""
    y, k, c = normalize_text(label), normalize_text(kind), confidence.try_cast("double")
    return F.coalesce(_first(
        (~F.coalesce(expected, F.lit(False)), "unexpected pair_id"),
        (~y.isin(*RELATION_IDS), _says("invalid label: ", y)),
        (~k.isin(*ANNOTATED_TYPES), _says("invalid inconsistency_type: ", k)),
        *_pair_rules(y, k),
        (normalize_space(rationale) == "", "rationale_short is empty"),
        (c.isNull(), _says("invalid confidence: ", F.coalesce(confidence, F.lit("None")))),
        (~((c >= 0.0) & (c <= 1.0)), "confidence out of range"),
    ), F.lit("ok"))


def gold_errors(c: dict[str, Column], allow_pending: bool) -> Column:
    """All errors of a gold record but those of its id; c: text_a, text_b, damages_a, damages_b, status, label, kind,
    rationale, annotator. A pending record, if allowed, is held to its texts and damages only."""
    y, k = normalize_text(c["label"]), normalize_text(c["kind"])
    base = [(normalize_space(c[f"text_{s}"]) == "", F.lit(f"text_{s} is empty")) for s in "ab"] + [(c[f"damages_{s}"].isNull(), F.lit(f"detected_damages_{s} must be a list")) for s in "ab"]
    rest = [
        (~y.isin(*RELATION_IDS), _says("invalid gold_label '", y, "'")),
        (~k.isin(*ANNOTATED_TYPES), _says("invalid gold_inconsistency_type '", k, "'")),
        (normalize_space(c["rationale"]) == "", F.lit("rationale_short is empty")),
        (normalize_space(c["annotator"]) == "", F.lit("annotator_id is empty")),
        (y.isin("supports", "neutral") & (k != "none"), _says("gold_inconsistency_type must be 'none' when gold_label is '", y, "'")),
        ((y == "contradicts") & (k == "none"), F.lit("gold_inconsistency_type cannot be 'none' when gold_label is 'contradicts'")),
    ]
    asked = F.lit(not allow_pending) | (normalize_text(c["status"]) != "pending")
    return F.array_compact(F.array(*[F.when(cond, m) for cond, m in base], *[F.when(asked & cond, m) for cond, m in rest]))


def pair_reason(pair_id: Column, text_a: Column, text_b: Column, label: Column, kind: Column | None = None) -> Column:
    """A pair record that a reader takes: no key missing, known label and, if there is one, known inconsistency type."""
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in (("pair_id", pair_id), ("text_a", text_a), ("text_b", text_b), ("label", label))]))
    return F.coalesce(_first(
        (F.size(missing) > 0, _says("Missing keys: ", F.array_join(missing, ", "))),
        (~normalize_text(label).isin(*RELATION_IDS), _says("Unknown label: ", label)),
        *([(kind.isNotNull() & ~normalize_text(kind).isin(*INCONSISTENCY_IDS), _says("Unknown inconsistency type: ", kind))] if kind is not None else []),
    ), F.lit("ok"))
