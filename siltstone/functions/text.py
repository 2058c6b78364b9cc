"""Text of claims and statements, as Column functions. Missing values count as empty texts throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pair texts' role tokens.
PAIR_ROLES = {"insured_driver": "<insured_driver>", "third_party_driver": "<third_party_driver>", "impartial_witness": "<witness>"}
#: The tokenizer corpus' role tokens.
CORPUS_ROLES = {
    "insured_driver": "<insured_driver>",
    "third_party_driver": "<third_party_driver>",
    "insurance_adjuster": "<insurance_adjuster>",
    "witness": "<witness>",
    "police_report": "<police_report>",
    "expert_report": "<expert_report>",
}
#: The roles that were on the scene.
SCENE_ROLES = ("insured_driver", "third_party_driver", "impartial_witness")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_space(c: Column | str) -> Column:
    """White space of any script becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def normalize_text(c: Column | str) -> Column:
    return F.lower(normalize_space(c))


def count_words(c: Column | str) -> Column:
    return F.regexp_count(text(c), F.lit(r"(?U)\b\w+\b")).cast("long")


def normalize_speed(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?i)\b(\d+(?:[.,]\d+)?)\s*km\s*/\s*h\b", "<speed> $1 kmh")


def _mapped(c: Column, names: dict[str, str], other: Column) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def role_token(c: Column | str) -> Column:
    """The pair texts' token; an empty role gives <none>, an unknown one itself in brackets."""
    r = F.trim(text(c))
    return _mapped(r, PAIR_ROLES | {"": "<none>"}, F.concat(F.lit("<"), r, F.lit(">")))


def normalize_role(c: Column | str) -> Column:
    """The tokenizer corpus' token."""
    r = text(c)
    return _mapped(r, CORPUS_ROLES | {"": "<none>"}, F.concat(F.lit("<"), F.replace(F.lower(F.trim(r)), F.lit(" "), F.lit("_")), F.lit(">")))


def format_damages(c: Column | str) -> Column:
    """Distinct normalised damages in order, joined by ', '."""
    items = F.filter(F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), normalize_text), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(items)), ", ")


def listed_damages(c: Column | str) -> Column:
    """The serving side's form: normalised, neither sorted nor distinct."""
    items = F.transform(F.split(text(c), ","), normalize_text)
    return F.array_join(F.filter(items, lambda x: x != ""), ", ")


def _joined(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def _labelled(name: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{name}: "), value)).otherwise("")


def statement_text(role: Column | str, body: Column | str, vehicle: Column | str | None = None, incident: Column | str | None = None, damages: Column | None = None) -> Column:
    """A statement as a pair's text; with a vehicle, incident and damages text, in its context."""
    token, words = role_token(role), normalize_space(body)
    if vehicle is None:
        return F.trim(F.concat(token, F.lit(" "), words))
    v = normalize_space(vehicle)
    return _joined(_labelled("incident_type", normalize_space(incident)), _labelled("detected_damages", damages), F.when(F.lower(v) == "none", "").otherwise(_labelled("vehicle", v)), token, words)


def claim_flat_text(damages: Column | str, statements: Column | str) -> Column:
    """Damages as given and the on-scene statements with a text, in one line."""
    d = F.coalesce(F.col(damages), F.array().cast("array<string>"))
    s = F.filter(F.col(statements), lambda x: x["role"].isin(*SCENE_ROLES) & (F.trim(text(x["text"]), F.lit(" \t\n\r\x0b\x0c")) != ""))
    lines = F.transform(s, lambda x: F.concat(x["role"], F.lit(": "), F.trim(text(x["text"]), F.lit(" \t\n\r\x0b\x0c"))))
    return F.concat(F.lit("detected_damages: "), F.when(F.size(d) > 0, F.array_join(d, ", ")).otherwise("none"), F.lit(" | "), F.array_join(lines, " | "))


def claim_corpus_text(c: dict[str, Column]) -> Column:
    """The tagged block for tokenizer training; c: claim_id, location, incident_type, label, indicators, statements."""
    told = F.transform(c["statements"], lambda x: F.concat_ws(" ", F.lit("<statement>"), normalize_role(x["role"]), F.lit("<vehicle>"), F.when(text(x["vehicle"]) == "", "none").otherwise(x["vehicle"]), normalize_speed(x["text"]), F.lit("<sep_stmt>")))
    return F.trim(F.concat_ws(
        " ", F.lit("<claim>"), text(c["claim_id"]), F.lit("<location>"), text(c["location"]), F.lit("<incident_type>"), text(c["incident_type"]),
        F.when(text(c["label"]) != "", F.concat(F.lit("<label> "), c["label"])), F.when(F.size(c["indicators"]) > 0, F.concat(F.lit("<fraud_indicators> "), F.array_join(c["indicators"], " ; "))), F.array_join(told, " "),
    ))


def claim_student_text(c: dict[str, Column]) -> Column:
    """The numbered text that a model reads; c: claim_id, location, incident_type, damages, statements."""
    def one(x: Column, i: Column) -> Column:
        v = normalize_space(x["vehicle"])
        return F.concat((i + 1).cast("string"), F.lit(". Role: "), normalize_space(x["role"]), F.lit("\n   Vehicle: "), F.when(v == "", "unknown").otherwise(v), F.lit("\n   Text: "), normalize_space(x["text"]), F.lit("\n\n"))

    d = F.when(F.size(c["damages"]) > 0, F.array_join(c["damages"], ", ")).otherwise("none")
    whole = F.concat(F.lit("Claim ID: "), normalize_space(c["claim_id"]), F.lit("\nLocation: "), normalize_space(c["location"]), F.lit("\nIncident type: "), normalize_space(c["incident_type"]), F.lit("\nDetected damages: "), d, F.lit("\n\nStatements:\n"), F.array_join(F.transform(c["statements"], one), ""))
    return F.trim(whole, F.lit(" \n"))


def strip_fences(c: Column | str) -> Column:
    """Without a leading and a trailing code fence."""
    trimmed = F.trim(text(c), F.lit(" \t\n\r\x0b\x0c"))
    return F.trim(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*|\s*```$", ""), F.lit(" \t\n\r\x0b\x0c"))


def id_number(c: Column | str) -> Column:
    """The number at an id's end, or null."""
    return F.regexp_extract(normalize_space(c), r"(\d+)$", 1).try_cast("long")


def keyword_hit(query: str, *columns: str) -> Column:
    """Any column contains the query, whatever the case; an empty query hits all."""
    out = F.lit(query == "")
    for c in columns:
        out = out | F.contains(F.lower(text(c)), F.lit(query.lower()))
    return out


def service_cut(c: Column | str) -> Column:
    """The text before the service's line of marks."""
    return F.trim(F.split_part(text(c), F.lit("=========="), F.lit(1)), F.lit(" \t\n\r"))
