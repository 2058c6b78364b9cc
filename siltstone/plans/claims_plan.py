"""Queries on texts, labels and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import chat, jsonx, labels, text
from siltstone.operators import validate
from siltstone.plans import bindings as b
from siltstone.plans.bindings import C, P, S, cw, ns, nt, pick, with_
from siltstone.sources.tables import table

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _st(spark, d):
    return b.statements(spark, d)


def _cols():
    return {k: F.col(k) for k in ("claim_id", "location", "incident_type", "label", "indicators", "damages", "statements")}


@query(f"SELECT conv_id, turn, {ns('text')} AS value FROM conversations")
def normalize_space(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize_space("text").alias("value"))


@query(f"SELECT doc_id, {nt('text')} AS value FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("value"))


@query(f"SELECT doc_id, {cw('text')} AS n FROM documents")
def count_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_words("text").alias("n"))


_SPEEDS = "'at ' || (doc_id % 90) || CASE doc_id % 3 WHEN 0 THEN ' KM/h, then' WHEN 1 THEN ',5 km / h' ELSE '.25km/H' END || ' and ' || doc_id || ' kmh'"


@query(f"SELECT doc_id, regexp_replace({_SPEEDS}, '(?i)\\b(\\d+(?:[.,]\\d+)?)\\s*km\\s*/\\s*h\\b', '<speed> \\1 kmh', 'g') AS value FROM documents")
def normalize_speed(spark, d):
    n = F.col("doc_id")
    said = F.concat(F.lit("at "), F.pmod(n, F.lit(90)).cast("string"), F.when(n % 3 == 0, " KM/h, then").when(n % 3 == 1, ",5 km / h").otherwise(".25km/H"), F.lit(" and "), n.cast("string"), F.lit(" kmh"))
    return table(spark, d, "documents").select("doc_id", text.normalize_speed(said).alias("value"))


_ANY_ROLE = ("insured_driver", "third_party_driver", "impartial_witness", "witness", "", "Tow Truck", "police_report")


@query(f"SELECT doc_id, CASE r WHEN '' THEN '<none>' WHEN 'impartial_witness' THEN '<witness>' ELSE '<' || r || '>' END AS value FROM (SELECT doc_id, {pick('doc_id', _ANY_ROLE)} AS r FROM documents)")
def role_token(spark, d):
    return table(spark, d, "documents").select("doc_id", text.role_token(b._pick(F.col("doc_id"), _ANY_ROLE)).alias("value"))


@query(f"SELECT doc_id, CASE r WHEN '' THEN '<none>' ELSE '<' || replace(lower(trim(r)), ' ', '_') || '>' END AS value FROM (SELECT doc_id, {pick('doc_id', _ANY_ROLE)} AS r FROM documents)")
def normalize_role(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_role(b._pick(F.col("doc_id"), _ANY_ROLE)).alias("value"))


def _fd(x: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform({x}, lambda z: {nt('z')}), lambda z: z <> ''))), ', '), '')"


@query(with_(C) + f"SELECT claim_id, {_fd('damages')} AS value FROM c")
def format_damages(spark, d):
    return b.claims(spark, d).select("claim_id", text.format_damages("damages").alias("value"))


_TOKEN = "CASE role WHEN '' THEN '<none>' WHEN 'impartial_witness' THEN '<witness>' ELSE '<' || role || '>' END"


@query(with_(S) + f"SELECT conv_id, turn, trim({_TOKEN} || ' ' || {ns('text')}) AS value FROM s")
def statement_text_plain(spark, d):
    return _st(spark, d).select("conv_id", "turn", text.statement_text("role", "text").alias("value"))


def _ctx(dam: str) -> str:
    return f"trim(concat_ws(' ', CASE WHEN {ns('incident_type')} <> '' THEN 'incident_type: ' || {ns('incident_type')} END, CASE WHEN {dam} <> '' THEN 'detected_damages: ' || {dam} END, CASE WHEN {ns('vehicle')} <> '' AND {nt('vehicle')} <> 'none' THEN 'vehicle: ' || {ns('vehicle')} END, {_TOKEN}, nullif({ns('text')}, '')))"


@query(with_(S, C) + f"SELECT s.conv_id, turn, {_ctx(_fd('damages'))} AS value FROM s JOIN c ON s.conv_id = c.conv_id")
def statement_text_contextual(spark, d):
    s = b.attributes(_st(spark, d))
    return s.select("conv_id", "turn", text.statement_text("role", "text", "vehicle", "incident_type", text.format_damages("damages")).alias("value"))


_LISTED = f"coalesce(array_to_string(list_filter(list_transform(string_split(array_to_string(damages, ','), ','), lambda z: {nt('z')}), lambda z: z <> ''), ', '), '')"


@query(with_(S, C) + f"SELECT s.conv_id, turn, {_ctx(_LISTED)} AS value FROM s JOIN c ON s.conv_id = c.conv_id")
def statement_text_serve(spark, d):
    s = b.attributes(_st(spark, d))
    return s.select("conv_id", "turn", text.statement_text("role", "text", "vehicle", "incident_type", text.listed_damages(F.array_join("damages", ","))).alias("value"))


@query(with_(S, C) + f"SELECT s.claim_id, turn, label AS ground_truth_label, incident_type, role, vehicle, {ns('text')} AS raw_text, trim({_TOKEN} || ' ' || {ns('text')}) AS text FROM s JOIN c ON s.conv_id = c.conv_id")
def statement_view(spark, d):
    return b.attributes(_st(spark, d)).select("claim_id", "turn", F.col("label").alias("ground_truth_label"), "incident_type", "role", "vehicle", text.normalize_space("text").alias("raw_text"), text.statement_text("role", "text").alias("text"))


@query(with_(S, C, f"f AS (SELECT conv_id, string_agg(role || ': ' || trim(text), ' | ' ORDER BY turn) AS x FROM s WHERE role IN ('insured_driver', 'third_party_driver', 'impartial_witness') AND trim(text) <> '' GROUP BY conv_id)") + "SELECT claim_id, 'detected_damages: ' || CASE WHEN len(damages) > 0 THEN array_to_string(damages, ', ') ELSE 'none' END || ' | ' || coalesce(x, '') AS value FROM c LEFT JOIN f ON c.conv_id = f.conv_id")
def claim_flat_text(spark, d):
    return b.claims(spark, d).select("claim_id", text.claim_flat_text("damages", "statements").alias("value"))


@query(with_(S, C, "f AS (SELECT conv_id, string_agg('<statement> <' || role || '> <vehicle> ' || CASE WHEN vehicle = '' THEN 'none' ELSE vehicle END || ' ' || text || ' <sep_stmt>', ' ' ORDER BY turn) AS x FROM s GROUP BY conv_id)") + "SELECT claim_id, trim('<claim> ' || claim_id || ' <location> ' || location || ' <incident_type> ' || incident_type || ' <label> ' || label || CASE WHEN len(indicators) > 0 THEN ' <fraud_indicators> ' || array_to_string(indicators, ' ; ') ELSE '' END || ' ' || x) AS value FROM c JOIN f ON c.conv_id = f.conv_id")
def claim_bpe_text(spark, d):
    return b.claims(spark, d).select("claim_id", text.claim_corpus_text(_cols()).alias("value"))


_STUDENT_F = f"f AS (SELECT conv_id, string_agg(i || '. Role: ' || {ns('role')} || chr(10) || '   Vehicle: ' || CASE WHEN {ns('vehicle')} = '' THEN 'unknown' ELSE {ns('vehicle')} END || chr(10) || '   Text: ' || {ns('text')}, chr(10) || chr(10) ORDER BY i) AS x FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM s) GROUP BY conv_id)"
_STUDENT = f"'Claim ID: ' || c.claim_id || chr(10) || 'Location: ' || {ns('location')} || chr(10) || 'Incident type: ' || {ns('incident_type')} || chr(10) || 'Detected damages: ' || CASE WHEN len(damages) > 0 THEN array_to_string(damages, ', ') ELSE 'none' END || chr(10) || chr(10) || 'Statements:' || chr(10) || x"


@query(with_(S, C, _STUDENT_F) + f"SELECT claim_id, {_STUDENT} AS value FROM c JOIN f ON c.conv_id = f.conv_id")
def claim_student_text(spark, d):
    return b.claims(spark, d).select("claim_id", text.claim_student_text(_cols()).alias("value"))


_JSON = "'{\"k\": ' || event_id || '}'"
_FENCED = f"CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || {_JSON} || chr(10) || '```' WHEN 1 THEN {_JSON} || ' x' WHEN 2 THEN 'Sure: ' || {_JSON} || ' done' WHEN 3 THEN '  ```JSON ' || {_JSON} || '```  ' ELSE '[1, 2]' END"


def _fenced():
    j, n = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}")), F.col("event_id") % 5
    return F.when(n == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(n == 1, F.concat(j, F.lit(" x"))).when(n == 2, F.concat(F.lit("Sure: "), j, F.lit(" done"))).when(n == 3, F.concat(F.lit("  ```JSON "), j, F.lit("```  "))).otherwise("[1, 2]")


@query(f"SELECT event_id, trim(regexp_replace(trim({_FENCED}), '(?i)^```(?:json)?\\s*|\\s*```$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS value FROM events")
def strip_fences(spark, d):
    return table(spark, d, "events").select("event_id", text.strip_fences(_fenced()).alias("value"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 < 4 THEN event_id END AS k FROM events")
def extract_json_object(spark, d):
    found = jsonx.extract_json_object(_fenced())
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("SELECT event_id, k FROM (SELECT event_id, unnest([event_id, event_id + 1]) AS k FROM events) UNION ALL SELECT event_id, 7 AS k FROM events WHERE event_id % 2 = 0")
def parse_fragments(spark, d):
    n = F.col("event_id")
    raw = F.concat(F.lit('junk [{"k": '), n.cast("string"), F.lit('}] , {"annotations": [{"k": '), (n + 1).cast("string"), F.lit("}]} "), F.when(n % 2 == 0, '{"k": 7} {bad').otherwise("} ["))
    return table(spark, d, "events").select("event_id", F.explode(jsonx.parse_fragments(raw)).alias("j")).select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS n, CASE event_id % 4 WHEN 0 THEN event_id + 1 WHEN 1 THEN event_id END AS k, CASE event_id % 4 WHEN 2 THEN 'no JSON value at ' || (length(CAST(event_id AS VARCHAR)) + 8) WHEN 3 THEN 'not all values are objects' END AS reason FROM events")
def parse_strictly(spark, d):
    n, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    raw = F.when(n == 0, F.concat(F.lit('so: {"k": '), e, F.lit('} and [{"k": 1}].'))).when(n == 1, F.concat(F.lit('{"annotations": [{"k": '), e, F.lit("}]}"))).when(n == 2, F.concat(F.lit('{"k": '), e, F.lit("} {bad"))).otherwise(F.concat(F.lit('[1, {"k": '), e, F.lit("}]")))
    x = table(spark, d, "events").select("event_id", jsonx.parse_strictly(raw).alias("p"))
    k = F.aggregate("p.objects", F.lit(0).cast("long"), lambda s, j: s + F.get_json_object(j, "$.k").cast("long"))
    return x.select("event_id", F.when(F.col("p.objects").isNotNull(), F.size("p.objects")).alias("n"), k.alias("k"), "p.reason")


@query("SELECT event_id, k FROM (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [event_id, 1] WHEN 1 THEN [event_id] ELSE [2, event_id] END) AS k FROM events)")
def list_unwrap(spark, d):
    n, e = F.col("event_id") % 3, F.col("event_id").cast("string")
    raw = F.when(n == 0, F.concat(F.lit('[{"k": '), e, F.lit('}, {"k": 1}]'))).when(n == 1, F.concat(F.lit('{"k": '), e, F.lit("}"))).otherwise(F.concat(F.lit('{"claims": [{"k": 2}, {"k": '), e, F.lit("}]}")))
    return table(spark, d, "events").select("event_id", F.explode(jsonx.parse_fragments(raw)).alias("j")).select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS p, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'true' END AS verdict FROM events")
def extract_json_regex(spark, d):
    n = F.col("event_id")
    p = (n % 100).cast("double") / 100
    body = F.concat(F.lit('{"probability_true": '), p.cast("string"), F.lit(', "verdict": "true"}'))
    raw = F.when(n % 4 == 0, F.concat(F.lit("thinking {x}\n"), body, F.lit(" end {y}"))).when(n % 4 == 1, body).when(n % 4 == 2, F.concat(F.lit("a "), F.lit('{"verdict": "true", "o": {}, "probability_true": '), p.cast("string"), F.lit("} b"))).otherwise("none")
    found = jsonx.flat_answer(raw)
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.probability_true").cast("double").alias("p"), F.get_json_object(found, "$.verdict").alias("verdict"))


_VERDICTS = ("true", " Verdadeiro", "FALSE", "falso", "not_true", "is not so", "falsey", "yes", "Not")


@query(f"SELECT doc_id, CASE WHEN v IN ('true', 'verdadeiro') THEN 'true' WHEN v IN ('not_true', 'false', 'falso') OR contains(v, 'not') OR contains(v, 'false') THEN 'not_true' ELSE 'true' END AS value FROM (SELECT doc_id, lower(trim({pick('doc_id', _VERDICTS)})) AS v FROM documents)")
def normalize_verdict(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.normalize_verdict(b._pick(F.col("doc_id"), _VERDICTS)).alias("value"))


@query("SELECT max(conv_id) + 1 AS next_number, 'PT-MIXD-2026-' || lpad(CAST(max(conv_id) + 1 AS VARCHAR), 6, '0') AS next_id FROM conversations")
def claim_id_seq(spark, d):
    n = F.coalesce(F.max(text.id_number("claim_id")), F.lit(0)) + 1
    return _st(spark, d).agg(n.alias("next_number")).withColumn("next_id", F.concat(F.lit("PT-MIXD-2026-"), F.lpad(F.col("next_number").cast("string"), 6, "0")))


@query(f"SELECT doc_id, {pick('doc_id', labels.CLAIM_LABELS)} AS label FROM documents")
def label_cycle(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.cycled(F.col("doc_id") + 1).alias("label"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), '#00000001') OR contains(lower(CAST(c_custkey AS VARCHAR)), '#00000001')")
def case_search(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    return c.where(text.keyword_hit("#00000001", "c_name", "c_mktsegment", "k")).select("c_custkey", "c_name")


@query()
def augment_text(spark, d):
    s = _st(spark, d).withColumn("said", F.concat(F.lit("I was driving home. It was a dent on the door. "), "text"))
    s = s.withColumn("new", jsonx.augment_text(F.col("said"), F.concat("claim_id", F.lit("-"), F.col("turn").cast("string"))))
    return s.select("conv_id", "turn", "new", (F.col("new") != F.col("said")).alias("changed"))


@query("SELECT o_orderkey, o_orderpriority AS value FROM orders")
def service_cut(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.service_cut(F.concat("o_orderpriority", F.lit("\n==========\nPrompt: 7 tokens"))).alias("value"))


@query(with_(C) + "SELECT claim_id, CASE WHEN label = 'genuine_accident' THEN 'true' ELSE 'not_true' END AS binary_label FROM c")
def binary_label(spark, d):
    return b.claims(spark, d).select("claim_id", labels.binary_label("label").alias("binary_label"))


@query(with_(C) + "SELECT claim_id, CASE WHEN label = 'genuine_accident' THEN 0 ELSE 1 END AS fraud FROM c")
def binary_label_lenient(spark, d):
    return b.claims(spark, d).select("claim_id", labels.binary_label("label", strict=False).alias("fraud"))


def _any(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {b._lit(p)})" for p in phrases) + ")"


_REL = "CASE WHEN label = 'genuine_accident' THEN 'supports' WHEN " + _any("lower(array_to_string(indicators, ' | '))", labels.SUPPORT_MARKERS) + " THEN 'supports' ELSE 'contradicts' END"
_SAID = f"coalesce(array_to_string(list_filter(list_transform(indicators, lambda z: {nt('z')}), lambda z: z <> ''), ' | '), '')"
_INC = "CASE WHEN label = 'genuine_accident' THEN 'none' " + " ".join(f"WHEN {_any(_SAID, ph)} THEN '{k}'" for k, ph in labels.INCONSISTENCY_MARKERS.items()) + " " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in labels.INCONSISTENCY_DEFAULTS.items()) + " ELSE 'none' END"


@query(with_(C) + f"SELECT claim_id, {_REL} AS relation FROM c")
def relation_label(spark, d):
    return b.claims(spark, d).select("claim_id", labels.relation_label("label", "indicators").alias("relation"))


@query(with_(C) + f"SELECT claim_id, {_INC} AS kind FROM c")
def inconsistency_type(spark, d):
    return b.claims(spark, d).select("claim_id", labels.inconsistency_type("label", "indicators").alias("kind"))


_EXPLAIN = ("Low-speed  contact", "the story looks STAGED", "Vehicle disappeared quickly", "nothing to say")


@query("SELECT doc_id, (" + " OR ".join(f"(l = '{k}' AND {_any('e', ph)})" for k, ph in labels.THEMES.items()) + f") AS hit FROM (SELECT doc_id, {pick('doc_id', labels.CLAIM_LABELS)} AS l, {nt(pick('doc_id // 2', _EXPLAIN))} AS e FROM documents)")
def theme_hit(spark, d):
    n = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", b._pick(n, labels.CLAIM_LABELS).alias("l"), b._pick(F.floor(n / 2).cast("long"), _EXPLAIN).alias("e"))
    return x.select("doc_id", labels.theme_hit("e", "l").alias("hit"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 = 0 THEN 'Missing keys: text_a, label' WHEN doc_id % 7 = 0 THEN 'Missing keys: text_a' WHEN doc_id % 5 = 0 THEN 'Missing keys: label' WHEN doc_id % 3 = 0 THEN 'Unknown label: maybe' WHEN doc_id % 11 = 0 THEN 'Unknown inconsistency type: odd' ELSE 'ok' END AS reason FROM documents")
def validate_pair(spark, d):
    n = F.col("doc_id")
    label = F.when(n % 5 != 0, F.when(n % 3 == 0, "maybe").otherwise(" Supports "))
    kind = F.when(n % 11 == 0, "odd").when(n % 2 == 0, "none")
    return table(spark, d, "documents").select("doc_id", validate.pair_reason(n.cast("string"), F.when(n % 7 != 0, F.col("text")), F.col("text"), label, kind).alias("reason"))


@query(with_(b.R) + "SELECT id, CASE label WHEN 'supports' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label_id, CASE inconsistency_type WHEN 'none' THEN 0 WHEN 'damage_mismatch' THEN 1 WHEN 'dynamics_mismatch' THEN 2 ELSE 3 END AS type_id FROM r")
def label_ids(spark, d):
    return b.relations(spark, d).select("id", labels.name_id(F.concat(F.lit(" "), F.upper("label")), labels.RELATION_IDS).alias("label_id"), labels.name_id("inconsistency_type", labels.INCONSISTENCY_IDS).alias("type_id"))


@query(with_(P) + "SELECT doc_id, CASE gt WHEN 'true' THEN 0.85::DOUBLE ELSE 0.15::DOUBLE END AS probability_true, gt AS verdict, CASE gt WHEN 'true' THEN " + ", ".join([]) + f"{b._lit(labels.TEMPLATE_TARGETS['true'][1])} ELSE {b._lit(labels.TEMPLATE_TARGETS['not_true'][1])} END AS reasoning, CASE gt WHEN 'true' THEN 0 ELSE 1 END AS n FROM p")
def template_target(spark, d):
    return b.predictions(spark, d).select("doc_id", labels.template_target("gt").alias("t")).select("doc_id", "t.probability_true", "t.verdict", "t.reasoning", F.size("t.incongruences").alias("n"))


@query(with_(P) + "SELECT doc_id, CASE WHEN prob >= 0.65 THEN 'critical' WHEN prob >= 0.40 THEN 'review' ELSE 'genuine' END AS band, round(CASE WHEN prob >= 0.40 THEN prob * 100 ELSE (1 - prob) * 100 END, 6) AS confidence FROM p WHERE prob IS NOT NULL")
def risk_band(spark, d):
    return b.predictions(spark, d).where("prob is not null").select("doc_id", labels.risk_band(F.col("prob")).alias("x")).select("doc_id", "x.band", F.round("x.confidence", 6).alias("confidence"))


# Validators: claims as they are, and with some faults.
_FAULTY = "v AS (SELECT conv_id, CASE WHEN conv_id % 23 = 0 THEN '  ' ELSE claim_id END AS claim_id, CASE WHEN conv_id % 19 = 0 THEN 'odd' ELSE label END AS label, CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE location END AS location, incident_type, CASE WHEN conv_id % 13 = 0 THEN CAST(['hail'] AS VARCHAR[]) WHEN len(damages) = 0 AND conv_id % 2 = 0 THEN CAST(['dent'] AS VARCHAR[]) ELSE damages END AS damages, indicators FROM c)"


def _faulty(spark, d):
    n = F.col("conv_id")
    x = b.claims(spark, d).withColumns({
        "claim_id": F.when(n % 23 == 0, "  ").otherwise(F.col("claim_id")), "label": F.when(n % 19 == 0, "odd").otherwise(F.col("label")), "location": F.when(n % 17 == 0, " ").otherwise(F.col("location")),
        "damages": F.when(n % 13 == 0, F.array(F.lit("hail"))).when((F.size("damages") == 0) & (n % 2 == 0), F.array(F.lit("dent"))).otherwise(F.col("damages")),
        "statements": F.transform("statements", lambda s: F.struct(s["role"].alias("role"), F.when(s["vehicle"] == "", "car").otherwise(s["vehicle"]).alias("vehicle"), s["text"].alias("text"))),
    })
    return x.withColumn("cleaned", validate.clean_statements(F.col("statements")))


def _statement_sql(words: tuple[int, int, int]) -> list[str]:
    return [
        f"t AS (SELECT conv_id, turn, role, {cw(ns('text'))} AS w FROM s WHERE {ns('text')} <> '')",
        f"f AS (SELECT conv_id, min_by(CASE WHEN role = 'insured_driver' THEN 'insured_driver' ELSE role END || ' statement too short: ' || w || ' words', turn) AS fault FROM t WHERE w < CASE WHEN role = 'insured_driver' THEN {words[0]} ELSE {words[1]} END GROUP BY conv_id)",
        "g AS (SELECT conv_id, count(*) AS k, count(*) FILTER (role = 'insured_driver') AS ki, count(*) FILTER (role <> 'insured_driver') AS ko, CAST(sum(w) AS BIGINT) AS total FROM t GROUP BY conv_id)",
        "h AS (SELECT conv_id, count(*) AS k0 FROM s GROUP BY conv_id)",
    ]


_SAID_N = f"len(list_filter(indicators, lambda z: {ns('z')} <> ''))"
_BAD_DAMAGE = f"list_filter(damages, lambda z: {nt('z')} NOT IN ('crack', 'dent', 'glass shatter', 'lamp broken', 'scratch'))"


@query(with_(S, C, _FAULTY, *_statement_sql(validate.MIXED_WORDS)) + f"""SELECT v.conv_id, CASE WHEN {ns('claim_id')} = '' THEN 'claim_id is empty' WHEN label = 'odd' THEN 'invalid label: odd' WHEN {ns('location')} = '' THEN 'location is empty'
WHEN len(damages) = 0 THEN 'detected_damages must be a non-empty list' WHEN len({_BAD_DAMAGE}) > 0 THEN 'unsupported damage: ' || ({_BAD_DAMAGE})[1]
WHEN label = 'genuine_accident' AND {_SAID_N} > 0 THEN 'genuine_accident must have empty fraud_indicators' WHEN label <> 'genuine_accident' AND {_SAID_N} = 0 THEN 'fraud labels must include fraud_indicators'
WHEN k0 NOT BETWEEN 2 AND 3 THEN 'claims must contain 2 or 3 statements' WHEN fault IS NOT NULL THEN fault WHEN coalesce(k, 0) < 2 THEN 'not enough valid statements' WHEN ki = 0 THEN 'missing insured_driver statement'
WHEN ko = 0 THEN 'missing non-insured statement' WHEN total < 80 THEN 'claim total text too short: ' || total || ' words' ELSE 'ok' END AS reason
FROM v LEFT JOIN f ON v.conv_id = f.conv_id LEFT JOIN g ON v.conv_id = g.conv_id LEFT JOIN h ON v.conv_id = h.conv_id""")
def validate_claim_mixed(spark, d):
    return _faulty(spark, d).select("conv_id", validate.claim_reason(_cols() | {"cleaned": F.col("cleaned")}).alias("reason"))


@query(with_(S, C, _FAULTY, *_statement_sql(validate.GOOD_WORDS)) + f"""SELECT v.conv_id, CASE WHEN {ns('claim_id')} = '' THEN 'claim_id is empty' WHEN {ns('location')} = '' THEN 'location is empty' WHEN label <> 'genuine_accident' THEN 'invalid label: ' || label
WHEN len(indicators) > 0 THEN 'fraud_indicators must be []' WHEN len(damages) = 0 THEN 'detected_damages must be a non-empty list' WHEN len({_BAD_DAMAGE}) > 0 THEN 'unsupported damage: ' || ({_BAD_DAMAGE})[1]
WHEN fault IS NOT NULL THEN fault WHEN coalesce(k, 0) = 0 THEN 'no valid statements found' WHEN ki = 0 THEN 'missing insured_driver statement' WHEN k = 1 AND total < 70 THEN 'single-statement claim too short: ' || total || ' words'
WHEN total < 85 THEN 'claim total text too short: ' || total || ' words' ELSE 'ok' END AS reason
FROM v LEFT JOIN f ON v.conv_id = f.conv_id LEFT JOIN g ON v.conv_id = g.conv_id LEFT JOIN h ON v.conv_id = h.conv_id""")
def validate_claim_good(spark, d):
    return _faulty(spark, d).select("conv_id", validate.good_claim_reason(_cols() | {"cleaned": F.col("cleaned")}).alias("reason"))


_PROBS = ("0.8", "0.2", "abc", "1.5", "-0.1", "0.5")
_VS = ("true", "not_true", " TRUE", "maybe")
_WHYS = ("fine", "", "the teacher said so", "uses binary_label")


@query(f"""SELECT doc_id, array_to_string(list_filter([
CASE WHEN try_cast(p AS DOUBLE) IS NULL THEN 'probability_true must be numeric' END, CASE WHEN NOT (coalesce(try_cast(p AS DOUBLE), -1) BETWEEN 0 AND 1) THEN 'probability_true must be between 0 and 1' END,
CASE WHEN v NOT IN ('true', 'not_true') THEN 'verdict must be true or not_true' END, CASE WHEN y = '' THEN 'reasoning must be non-empty' END,
CASE WHEN v = 'true' AND coalesce(try_cast(p AS DOUBLE), -1) < 0.5 THEN 'verdict=true must have probability_true >= 0.5' END, CASE WHEN v = 'not_true' AND coalesce(try_cast(p AS DOUBLE), -1) >= 0.5 THEN 'verdict=not_true must have probability_true < 0.5' END,
CASE WHEN contains(y, 'teacher') THEN 'response leaked hidden supervision term: teacher' WHEN contains(y, 'binary_label') THEN 'response leaked hidden supervision term: binary_label' END], lambda z: z IS NOT NULL), '; ') AS errors
FROM (SELECT doc_id, {pick('doc_id', _PROBS)} AS p, {nt(pick('doc_id // 2', _VS))} AS v, {ns(pick('doc_id // 3', _WHYS))} AS y FROM documents)""")
def validate_target(spark, d):
    n = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", b._pick(n, _PROBS).alias("p"), b._pick(F.floor(n / 2).cast("long"), _VS).alias("v"), b._pick(F.floor(n / 3).cast("long"), _WHYS).alias("y"))
    return x.select("doc_id", F.array_join(validate.target_errors(F.col("p"), F.col("v"), F.col("y"), F.array(F.lit("odd")), guard=True), "; ").alias("errors"))


_YS = ("supports", "neutral", "contradicts", "odd")
_KS = ("none", "damage_mismatch", "scripted_narrative")
_CS = ("0.9", "x", "1.2", "0")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unexpected pair_id' WHEN y = 'odd' THEN 'invalid label: odd' WHEN k = 'scripted_narrative' THEN 'invalid inconsistency_type: scripted_narrative' WHEN y <> 'contradicts' AND k <> 'none' THEN 'non-contradictory labels must use inconsistency_type=none'
WHEN y = 'contradicts' AND k = 'none' THEN 'contradicts must not use inconsistency_type=none' WHEN doc_id % 7 = 0 THEN 'rationale_short is empty' WHEN try_cast(c AS DOUBLE) IS NULL THEN 'invalid confidence: ' || c WHEN CAST(c AS DOUBLE) > 1 THEN 'confidence out of range' ELSE 'ok' END AS reason
FROM (SELECT doc_id, {pick('doc_id', _YS)} AS y, {pick('doc_id', _KS)} AS k, {pick('doc_id // 5', _CS)} AS c FROM documents)""")
def validate_silver(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", validate.annotation_reason(n % 11 != 0, b._pick(n, _YS), b._pick(n, _KS), F.when(n % 7 == 0, " ").otherwise("why"), b._pick(F.floor(n / 5).cast("long"), _CS)).alias("reason"))


def _gold_sql(pending: bool) -> str:
    ask = "(s <> 'pending') AND " if pending else ""
    return f"""array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'text_a is empty' END, CASE WHEN doc_id % 10 = 0 THEN 'detected_damages_b must be a list' END, CASE WHEN {ask} y = 'odd' THEN 'invalid gold_label ''odd''' END,
CASE WHEN {ask} k = 'scripted_narrative' THEN 'invalid gold_inconsistency_type ''scripted_narrative''' END, CASE WHEN {ask} doc_id % 7 = 0 THEN 'rationale_short is empty' END,
CASE WHEN {ask} y IN ('supports', 'neutral') AND k <> 'none' THEN 'gold_inconsistency_type must be ''none'' when gold_label is ''' || y || '''' END, CASE WHEN {ask} y = 'contradicts' AND k = 'none' THEN 'gold_inconsistency_type cannot be ''none'' when gold_label is ''contradicts''' END], lambda z: z IS NOT NULL), '; ')"""


_GOLD_X = f"x AS (SELECT doc_id, {pick('doc_id', _YS)} AS y, {pick('doc_id', _KS)} AS k, {pick('doc_id // 3', ('pending', 'complete'))} AS s, CAST(doc_id % 900 AS VARCHAR) AS g FROM documents)"


def _gold(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.pmod(n, F.lit(900)).cast("string").alias("g"), *[v.alias(k) for k, v in {
        "text_a": F.when(n % 9 == 0, " ").otherwise("a"), "text_b": F.lit("b"), "damages_a": F.array(F.lit("dent")), "damages_b": F.when(n % 10 != 0, F.array(F.lit("dent"))), "status": b._pick(F.floor(n / 3).cast("long"), ("pending", "complete")),
        "label": b._pick(n, _YS), "kind": b._pick(n, _KS), "rationale": F.when(n % 7 == 0, "").otherwise("why"), "annotator": F.lit("me"),
    }.items()])


@query(with_(_GOLD_X) + f"SELECT doc_id, {_gold_sql(True)} AS errors, row_number() OVER (PARTITION BY g ORDER BY doc_id) > 1 AS duplicate_id FROM x")
def validate_gold(spark, d):
    g = _gold(spark, d)
    first = g.groupBy("g").agg(F.min("doc_id").alias("f"))
    return g.join(first, "g").select("doc_id", F.array_join(validate.gold_errors({c: F.col(c) for c in g.columns}, allow_pending=True), "; ").alias("errors"), (F.col("doc_id") > F.col("f")).alias("duplicate_id"))


@query(with_(_GOLD_X) + f"SELECT doc_id AS pair_id, y AS label, k AS inconsistency_type, 'manual_annotation' AS gold_source FROM x WHERE s = 'complete' AND {_gold_sql(False)} = ''")
def gold_build(spark, d):
    g = _gold(spark, d).where(text.normalize_text("status") == "complete")
    g = g.where(F.size(validate.gold_errors({c: F.col(c) for c in g.columns}, allow_pending=False)) == 0)
    return g.select(F.col("doc_id").alias("pair_id"), text.normalize_text("label").alias("label"), text.normalize_text("kind").alias("inconsistency_type"), F.lit("manual_annotation").alias("gold_source"))


def _chats(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("SELECT conv_id, count(*) >= 2 AND count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AS ok FROM conversations GROUP BY conv_id")
def chat_record_check(spark, d):
    return _chats(spark, d).select("conv_id", chat.is_chat_record(F.col("messages")).alias("ok"))


@query("SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user' AND text <> ''), '') AS content FROM conversations GROUP BY conv_id")
def user_content(spark, d):
    return _chats(spark, d).select("conv_id", chat.user_content(F.col("messages")).alias("content"))


@query(with_(S, C, _STUDENT_F) + f"SELECT claim_id, 3 AS n, {b._lit(chat.SYSTEM_PROMPT)} AS first, {_STUDENT} AS second, 'ok' AS third FROM c JOIN f ON c.conv_id = f.conv_id")
def chat_messages(spark, d):
    m = b.claims(spark, d).select("claim_id", chat.chat_messages(text.claim_student_text(_cols()), F.lit("ok")).alias("m"))
    return m.select("claim_id", F.size("m").alias("n"), F.col("m")[0]["content"].alias("first"), F.col("m")[1]["content"].alias("second"), F.col("m")[2]["content"].alias("third"))


def _sql_text(x: str) -> str:
    return b._lit(x).replace("\n", "' || chr(10) || '")


@query("SELECT conv_id, turn, " + _sql_text(chat.SYSTEM_PROMPT + "\n\nClaim:\n") + " || text || " + _sql_text('\n\nRespond with a JSON object containing:\n- probability_true: a number between 0.0 and 1.0\n- verdict: "true" or "not_true"\n- reasoning: a brief explanation\n- incongruences: a list of suspicious elements (empty if genuine)\n\nJSON response:') + " AS completion, " + _sql_text("<|im_start|>system\n" + chat.SYSTEM_PROMPT + "<|im_end|>\n<|im_start|>user\n") + " || text || " + _sql_text("<|im_end|>\n<|im_start|>assistant\n") + " AS turned FROM conversations")
def prompt_builder(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", chat.completion_prompt(F.col("text")).alias("completion"), chat.turn_prompt(F.col("text")).alias("turned"))


_KINDS = [(i, s, p) for i, (s, p) in enumerate([(s, p) for s in chat.SYSTEM_VARIANTS for p in chat.USER_PREFIXES][:4], 1)]


@query("WITH v(i, sys, pre) AS (VALUES " + ", ".join(f"({i}, {b._lit(s)}, {_sql_text(p)})" for i, s, p in _KINDS) + ") SELECT conv_id || '::v' || i AS claim_id, i AS variant_id, string_agg(CASE role WHEN 'system' THEN sys WHEN 'user' THEN pre || text ELSE text END, '|' ORDER BY turn) AS said FROM conversations, v WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3) GROUP BY conv_id, i")
def style_jitter(spark, d):
    rows = _chats(spark, d).select(F.col("conv_id").cast("string").alias("claim_id"), "messages")
    return chat.style_jitter(rows).select("claim_id", "variant_id", F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("said"))


@query(with_(S, C, _STUDENT_F) + f"SELECT claim_id, {_STUDENT} AS input_text, CASE WHEN label = 'genuine_accident' THEN 'true' ELSE 'not_true' END AS binary_label, label AS original_label, {ns('location')} AS location, {ns('incident_type')} AS incident_type, array_to_string(list_transform(damages, lambda z: {ns('z')}), '|') AS damages, array_to_string(list_transform(indicators, lambda z: {ns('z')}), '|') AS indicators FROM c JOIN f ON c.conv_id = f.conv_id")
def source_record(spark, d):
    return b.claims(spark, d).select("claim_id", text.claim_student_text(_cols()).alias("input_text"), labels.binary_label("label").alias("binary_label"), F.col("label").alias("original_label"), text.normalize_space("location").alias("location"), text.normalize_space("incident_type").alias("incident_type"), F.array_join(F.transform("damages", text.normalize_space), "|").alias("damages"), F.array_join(F.transform("indicators", text.normalize_space), "|").alias("indicators"))


@query(with_(P) + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN gt WHEN prob IS NOT NULL THEN CASE WHEN prob >= 0.5 THEN 'true' ELSE 'not_true' END ELSE 'not_true' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN prob ELSE coalesce(prob, 0.5) END AS probability_true, CASE WHEN doc_id % 3 = 0 THEN 'verdict' WHEN prob IS NOT NULL THEN 'probability_fallback' ELSE 'invalid_default' END AS source FROM p")
def prediction_cascade(spark, d):
    return b.predictions(spark, d).select("doc_id", jsonx.cascade(F.col("doc_id") % 3 == 0, F.col("gt"), F.col("prob")).alias("x")).select("doc_id", "x.*")


@query(with_(P) + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN gt ELSE coalesce(pred, 'unknown') END AS verdict FROM p")
def analyse_update(spark, d):
    return b.predictions(spark, d).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("gt")), F.col("pred"), F.lit("unknown")).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 404 WHEN l_linenumber > 6 THEN 400 ELSE 200 END AS status FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) ON l_orderkey = o_orderkey")
def api_input_checks(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("o_orderkey").isNull(), 404).when(F.col("l_linenumber") > 6, 400).otherwise(200).alias("status"))
