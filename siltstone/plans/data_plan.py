"""Queries on sources, de-duplication, pairs, metrics, sampling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import labels, text
from siltstone.operators import dedup, encode, metrics, pairs, sampling, scoring, sketches, timeline
from siltstone.plans import bindings as b
from siltstone.plans.bindings import D, P, R, S, C, ns, nt, with_
from siltstone.plans.claims_plan import _INC, _REL
from siltstone.sources import tables
from siltstone.sources.tables import table

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# Sources and resuming.
@query("SELECT 'first' AS origin, count(*) AS n FROM customer UNION ALL SELECT 'second' AS origin, count(*) AS n FROM supplier")
def concat_sources(spark, d):
    both = tables.concat_sources({"first": table(spark, d, "customer").select("c_name"), "second": table(spark, d, "supplier").select(F.col("s_name").alias("c_name"), "s_acctbal")})
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lines' AS source, count(*) AS n, false AS skipped FROM documents UNION ALL VALUES ('missing', NULL, true), ('broken', NULL, true)")
def load_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    good, bad = tables.new_dir(spark, "lines"), tables.new_dir(spark, "broken")
    tables.write_jsonl(docs, good)
    docs.select(F.when(F.pmod("doc_id", F.lit(100)) == 42, '{"doc_id": ').otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value")).write.text(bad)
    read = lambda path: lambda: tables.read_jsonl(spark, path, docs.schema)
    rows, report = tables.load_sources(spark, {"lines": read(good), "missing": read(good + "-none"), "broken": read(bad)})
    counted = rows.groupBy(F.col("origin").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return report.select("source", F.col("reason").isNotNull().alias("skipped")).join(counted, "source", "left").select("source", "n", "skipped")


def _length_model(fails: bool):
    """A model for the query: refuses, or breaks down at, some documents in its first run."""

    def load():
        def call(rows: list[dict]) -> list:
            if fails and any(r["doc_id"] % 50 == 7 for r in rows):
                raise RuntimeError("overloaded")
            return [ValueError("refused") if fails and r["doc_id"] % 50 == 9 else {"score": len(r["text"] or "") % 97} for r in rows]

        return call

    return load


@query("SELECT doc_id, length(coalesce(text, '')) % 97 AS score, CASE WHEN doc_id % 50 IN (7, 9) THEN 2 ELSE 1 END AS run FROM documents")
def model_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    sink, dead = tables.new_dir(spark, "scores"), tables.new_dir(spark, "dead")
    for run in (1, 2):
        scoring.score_missing(docs, "doc_id", _length_model(run == 1), "score long", sink, dead, ["doc_id"], run)
    return scoring.read_scored(spark, sink, "doc_id long, score long, run int")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_array(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    at = tables.new_dir(spark, "json_array")
    tables.write_json_list(docs, at, "doc_id", "text", one_file=True)
    return tables.read_json_array(spark, at, docs.schema)


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_custkey % 4 <> 0)) WHERE n >= 5 AND n < 105")
def resume_anti_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("key"))
    done = table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").cast("string").alias("key"))
    return tables.unseen(c, done, "key", "c_custkey", start=5, most=100).select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) WHERE n >= 5 AND n < 105 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_custkey % 4 <> 0)")
def resume_slice_first(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    done = table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").cast("string").alias("key"))
    return tables.unseen(c, done, "key", "c_custkey", start=5, most=100, slice_first=True).select("c_custkey")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def batching(spark, d):
    return tables.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 8)


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def keyed_side_input(spark, d):
    return tables.last_by_key(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "value")


@query("""WITH o AS (SELECT doc_id // 8 AS batch, CASE doc_id % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'similar' ELSE 'accepted' END AS v FROM documents WHERE doc_id % 10 <> 9),
g AS (SELECT batch, count(*) FILTER (v = 'accepted') AS accepted, count(*) FILTER (v = 'rejected') AS rejected, count(*) FILTER (v = 'duplicate') AS duplicate, count(*) FILTER (v = 'similar') AS "similar", greatest(0, 8 - count(*)) AS missing FROM o GROUP BY batch),
t AS (SELECT *, CAST(sum(accepted) OVER (ORDER BY batch) AS BIGINT) - accepted AS before FROM g)
SELECT batch, accepted, rejected, duplicate, "similar", missing, least(accepted, 90 - before) AS kept FROM t WHERE before < 90""")
def generation_ledger(spark, d):
    n = F.col("doc_id")
    o = table(spark, d, "documents").where(n % 10 != 9).select(F.floor(n / 8).cast("long").alias("batch"), F.when(n % 6 == 0, "rejected").when(n % 6 == 1, "duplicate").when(n % 6 == 2, "similar").otherwise("accepted").alias("verdict"))
    return tables.ledger(o, asked=8, target=90)


# De-duplication.
_FP = f"sha256({nt('location')} || '||' || {nt('incident_type')} || '||' || '' || '||' || 'insured_driver::none::' || {nt('text')})"


def _doc_claims(spark, d):
    x = b.document_claims(spark, d)
    s = F.array(F.struct(F.lit("Insured_Driver").alias("role"), F.lit("none").alias("vehicle"), F.col("text").alias("text")))
    return x.withColumn("fp", dedup.claim_fingerprint("location", "incident_type", F.array().cast("array<string>"), s))


@query(with_(D) + f"SELECT pos, {_FP} AS fp FROM d")
def claim_fingerprint(spark, d):
    return _doc_claims(spark, d).select("pos", "fp")


@query(with_(D) + f"SELECT fp, min(pos) AS pos FROM (SELECT pos, {_FP} AS fp FROM d) GROUP BY fp")
def dedup_exact(spark, d):
    return dedup.first_by(_doc_claims(spark, d).select("pos", "fp"), "fp", "pos")


#: The greedy rule row by row: what was kept goes along in two lists.
_GREEDY = """c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS i, pos, id, location, %s AS fp FROM d),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS fps, CAST(NULL AS VARCHAR) AS outcome
UNION ALL SELECT x.i, CASE WHEN o = 'kept' THEN list_append(ids, x.id) ELSE ids END, CASE WHEN o = 'kept' THEN list_append(fps, x.fp) ELSE fps END, o
FROM (SELECT c.i, c.id, c.fp, g.ids, g.fps, CASE WHEN list_contains(g.ids, c.id) THEN 'id_duplicate' WHEN list_contains(g.fps, c.fp) THEN 'fp_duplicate' ELSE 'kept' END AS o FROM g JOIN c ON c.i = g.i + 1) x),
out AS (SELECT c.pos, c.location AS source, g.outcome FROM g JOIN c ON c.i = g.i)""" % _FP
_RECURSIVE = with_(D, _GREEDY).replace("WITH", "WITH RECURSIVE", 1)


@query(_RECURSIVE + "SELECT pos, outcome FROM out")
def clean_dedup(spark, d):
    return dedup.greedy_dedup(_doc_claims(spark, d))


@query(_RECURSIVE + "SELECT source, count(*) AS loaded, count(*) FILTER (outcome = 'id_duplicate') AS id_duplicates, count(*) FILTER (outcome = 'fp_duplicate') AS fp_duplicates, count(*) FILTER (outcome = 'kept') AS final FROM out GROUP BY source")
def cleaning_report(spark, d):
    out = dedup.greedy_dedup(_doc_claims(spark, d)).join(b.document_claims(spark, d).select("pos", F.col("location").alias("source")), "pos")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("outcome") == "id_duplicate").alias("id_duplicates"), F.count_if(F.col("outcome") == "fp_duplicate").alias("fp_duplicates"), F.count_if(F.col("outcome") == "kept").alias("final"))


@query(_RECURSIVE + "SELECT pos, outcome = 'kept' AS kept FROM out")
def dedup_any(spark, d):
    return dedup.greedy_dedup(_doc_claims(spark, d)).select("pos", (F.col("outcome") == "kept").alias("kept"))


_TOK = f"regexp_extract_all({nt('text')}, '[a-z0-9<>]+')"
_SH = f"k AS (SELECT doc_id, lang, {_TOK} AS t FROM documents), sh AS (SELECT doc_id, lang, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) END) AS sh FROM k)"


@query(with_(_SH) + "SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS digest FROM sh")
def shingles(spark, d):
    x = table(spark, d, "documents").select("doc_id", dedup.shingles("text").alias("sh"))
    return x.select("doc_id", F.size("sh").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("sh"), "|").cast("binary")).alias("digest"))


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.lower("text").alias("sh"))


_PAIRS = """cl AS (SELECT lang, min(doc_id) AS id, list_sort(sh) AS sh FROM sh WHERE len(sh) > 0 GROUP BY lang, list_sort(sh)),
e AS (SELECT lang, id, len(sh) AS n, unnest(sh) AS h FROM cl),
o AS (SELECT x.lang AS grp, x.id AS id_a, y.id AS id_b, x.n + y.n AS s, count(*) AS common FROM e x JOIN e y ON x.lang = y.lang AND x.h = y.h AND x.id < y.id AND least(x.n, y.n) >= 0.82::DOUBLE * greatest(x.n, y.n) - 1e-9::DOUBLE GROUP BY ALL)"""


@query(with_(_SH, _PAIRS) + "SELECT grp, id_a, id_b, common, s - common AS total FROM o WHERE common >= 0.82::DOUBLE * (s - common) - 1e-9::DOUBLE")
def jaccard_pairs(spark, d):
    return dedup.similar_sets(_texts(spark, d))


#: Classes in order of their first row; those before that are similar go along as a list.
_REJECT = """m AS MATERIALIZED (SELECT id_b AS id, list(id_a) AS before FROM o WHERE common >= 0.82::DOUBLE * (s - common) - 1e-9::DOUBLE GROUP BY id_b),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cl.id) AS i, cl.id, coalesce(m.before, CAST([] AS BIGINT[])) AS before FROM cl LEFT JOIN m ON m.id = cl.id),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS kept
UNION ALL SELECT c.i, c.id, CASE WHEN list_has_any(c.before, g.kept) THEN g.kept ELSE list_append(g.kept, c.id) END FROM g JOIN c ON c.i = g.i + 1),
last AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""


@query(with_(_SH, _PAIRS, _REJECT).replace("WITH", "WITH RECURSIVE", 1) + "SELECT doc_id, len(sh) = 0 OR doc_id IN (SELECT id FROM last) AS kept FROM sh")
def near_dup_reject(spark, d):
    return dedup.near_duplicates(_texts(spark, d)).select(F.col("id").alias("doc_id"), "kept")


_CLAIM_SETS = f"""t AS (SELECT conv_id, role, regexp_extract_all({nt('text')}, '[a-z0-9<>]+') AS t FROM s),
sh AS MATERIALIZED (SELECT row_number() OVER () AS i, conv_id, role, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) END) AS sh FROM t),
e AS (SELECT i, conv_id, role, len(sh) AS n, unnest(sh) AS h FROM sh),
x AS (SELECT x.conv_id AS a, y.conv_id AS b, x.n + y.n AS s, count(*) AS common FROM e x JOIN e y ON x.role = y.role AND x.h = y.h AND x.conv_id <> y.conv_id GROUP BY x.i, y.i, x.conv_id, y.conv_id, x.n, y.n),
m AS MATERIALIZED (SELECT b, list(DISTINCT a) AS near FROM x WHERE common >= 0.82::DOUBLE * (s - common) - 1e-9::DOUBLE GROUP BY b),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id) AS i, conv_id, coalesce(near, CAST([] AS BIGINT[])) AS near FROM (SELECT DISTINCT conv_id FROM sh WHERE conv_id % 7 <> 0) LEFT JOIN m ON b = conv_id),
g AS (SELECT CAST(0 AS BIGINT) AS i, list(DISTINCT conv_id) FILTER (conv_id % 7 = 0) AS kept FROM sh
UNION ALL SELECT c.i, CASE WHEN list_has_any(c.near, g.kept) THEN g.kept ELSE list_append(g.kept, c.conv_id) END FROM g JOIN c ON c.i = g.i + 1),
last AS (SELECT unnest(kept) AS conv_id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""


@query(with_(S, _CLAIM_SETS).replace("WITH", "WITH RECURSIVE", 1) + "SELECT DISTINCT conv_id, conv_id IN (SELECT conv_id FROM last) AS kept FROM sh")
def claim_reject(spark, d):
    s = b.statements(spark, d).select(F.col("conv_id").cast("long").alias("pos"), "role", "text", (F.col("conv_id") % 7 == 0).alias("before"))
    return dedup.claim_rejects(s).select(F.col("pos").alias("conv_id"), "kept")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dent,crack,' || (doc_id % 3) ELSE 'crack,' || (doc_id % 3) END AS value FROM documents")
def ordered_union_distinct(spark, d):
    n = F.pmod("doc_id", F.lit(3)).cast("string")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("dent"), F.lit("crack"))).otherwise(F.array(F.lit("crack"))), F.array(F.lit("crack"), n))), ",").alias("value"))


# Along a time line (extensions).
@query("SELECT x.event_id, x.user_id, e.event_id AS last_event_id, e.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') x ASOF LEFT JOIN (SELECT user_id, ts, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) e ON x.user_id = e.user_id AND x.ts >= e.ts")
def asof_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    others = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts", "value")
    return timeline.asof(bought, others, "user_id", "ts", "event_id").select("event_id", "user_id", "last_event_id", "last_value")


@query("SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    return timeline.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600)


@query("SELECT event_type, count(*) AS n, true AS distinct_near, true AS median_near FROM events GROUP BY event_type")
def sketch_states(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    days = tables.settle(sketches.states(e, ["event_type", "day"], "user_id", "value"), "states")
    found = sketches.estimates(sketches.merged(days, ["event_type"]), ["event_type"], [0.5], 3).select("event_type", F.col("rows").alias("n"), "distinct", F.col("quantiles")[0].alias("median"))
    exact = e.join(F.broadcast(found), "event_type").groupBy("event_type", "n", "distinct").agg(F.count_distinct("user_id").alias("exact"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("rank"))
    return exact.select("event_type", "n", (F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_near"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_near"))


@query(with_(R) + "SELECT grouping(label, inconsistency_type, role_a, role_b) AS grain, label, inconsistency_type, role_a, role_b, count(*) AS n, min(id) AS first FROM r GROUP BY GROUPING SETS ((label), (label, inconsistency_type), (role_a, role_b), (label, role_a), ())")
def multi_grain(spark, d):
    return metrics.grains(b.relations(spark, d), [["label"], ["label", "inconsistency_type"], ["role_a", "role_b"], ["label", "role_a"], []], ["label", "inconsistency_type", "role_a", "role_b"], F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


# Pairs and joins.
@query(with_(S, C, f"y AS (SELECT conv_id, {_REL} AS relation, {_INC} AS kind FROM c)", "j AS (SELECT a.conv_id, a.turn AS pos_a, b.turn AS pos_b, a.role AS role_a, b.role AS role_b, a.text AS ta, b.text AS tb FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.role = 'insured_driver' AND b.role <> 'insured_driver')") + f"SELECT 'PAIR-' || lpad(CAST(row_number() OVER (ORDER BY j.conv_id, pos_a, pos_b) AS VARCHAR), 6, '0') AS pair_id, j.conv_id, pos_a, pos_b, '<insured_driver> ' || {ns('ta')} AS text_a, CASE role_b WHEN 'impartial_witness' THEN '<witness> ' ELSE '<' || role_b || '> ' END || {ns('tb')} AS text_b, relation AS label, kind AS inconsistency_type FROM j JOIN y ON j.conv_id = y.conv_id")
def within_claim_pairs(spark, d):
    s = b.statements(spark, d).select("claim_id", "conv_id", F.col("turn").alias("pos"), "role", text.statement_text("role", "text").alias("text"))
    p = pairs.within_claims(s.select("claim_id", "conv_id", "pos", "role", "text")).drop("conv_id_b").withColumnRenamed("conv_id_a", "conv_id")
    p = pairs.with_ids(b.attributes(p), "conv_id", "pos_a", "pos_b")
    return p.select("pair_id", "conv_id", "pos_a", "pos_b", "text_a", "text_b", labels.relation_label("label", "indicators").alias("label"), labels.inconsistency_type("label", "indicators").alias("inconsistency_type"))


_POOL = f"w AS (SELECT conv_id || '-' || turn AS id, claim_id, role, {ns('text')} AS text FROM s), q AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS n FROM w WHERE text <> '' AND role <> '')"


@query(with_(S, _POOL, "z AS (SELECT count(*) AS size, CAST('0x' || substr(md5('42:shift'), 1, 8) AS BIGINT) AS shift FROM q)",
    "j AS (SELECT r * size + x.n AS t, x.id AS id_a, y.id AS id_b, x.claim_id AS claim_id_a, y.claim_id AS claim_id_b, least(x.text, y.text) AS u, greatest(x.text, y.text) AS v FROM q x, z, range(6) AS o(r), q y WHERE y.n = (x.n + 1 + (r + shift) % (size - 1)) % size AND x.claim_id <> y.claim_id AND r * size + x.n < greatest(50 * size, 1000))",
    "k AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY t) AS first FROM j)", "l AS (SELECT *, row_number() OVER (ORDER BY t) AS i FROM k WHERE first = 1)") + "SELECT 'NEUTRAL-' || lpad(CAST(i AS VARCHAR), 6, '0') AS pair_id, id_a, id_b, claim_id_a, claim_id_b FROM l, z WHERE i <= size")
def neutral_sample(spark, d):
    s = b.statements(spark, d).select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "claim_id", "role", text.normalize_space("text").alias("text"))
    n = s.where((F.col("text") != "") & (F.col("role") != "")).count()
    return pairs.neutral_sample(s, n).select("pair_id", "id_a", "id_b", "claim_id_a", "claim_id_b")


@query(with_(S, _POOL, "j AS (SELECT x.n, t.step, x.id AS id_a, y.id AS id_b, x.claim_id AS claim_id_a, y.claim_id AS claim_id_b, least(x.text, y.text) AS u, greatest(x.text, y.text) AS v FROM q x, (VALUES (1), (2), (3)) AS t(step), q y WHERE x.n + t.step = y.n AND x.claim_id <> y.claim_id)", "k AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY step, n) AS r FROM j)") + "SELECT id_a, id_b, claim_id_a, claim_id_b, step FROM k WHERE r = 1")
def neutral_pairs(spark, d):
    s = b.statements(spark, d).select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "claim_id", "role", text.normalize_space("text").alias("text"))
    return pairs.neutral(s).select("id_a", "id_b", "claim_id_a", "claim_id_b", "step")


def _annotated(spark, d):
    r = b.relations(spark, d).select(F.col("id").alias("pair_id"), F.floor(F.col("id") / 8).cast("long").alias("batch"), "label", "inconsistency_type")
    n = F.col("pair_id")
    a = r.where(n % 9 != 0).select("pair_id", F.when(n % 5 == 0, "neutral").otherwise(F.col("label")).alias("label"), F.when(n % 5 == 0, "none").otherwise(F.col("inconsistency_type")).alias("inconsistency_type"), (n % 7 != 0).alias("ok"))
    return r, a


def _merge_sql(ok: str) -> str:
    return with_(R, "m AS (SELECT id AS pair_id, id // 8 AS batch, label, inconsistency_type AS kind, id % 9 <> 0 AND id % 7 <> 0 AS ok0 FROM r)", f"o AS (SELECT *, {ok} AS ok FROM m)") + "SELECT pair_id, batch, label AS weak_label, kind AS weak_type, CASE WHEN ok AND pair_id % 5 = 0 THEN 'neutral' ELSE label END AS label, CASE WHEN ok AND pair_id % 5 = 0 THEN 'none' ELSE kind END AS inconsistency_type, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome, ok AND pair_id % 5 = 0 AND label <> 'neutral' AS changed_label, ok AND pair_id % 5 = 0 AND kind <> 'none' AS changed_type FROM o"


@query(_merge_sql("ok0"))
def teacher_merge(spark, d):
    return pairs.merge_teacher(*_annotated(spark, d))


@query(_merge_sql("bool_and(ok0) OVER (PARTITION BY batch)"))
def teacher_merge_batch(spark, d):
    return pairs.merge_teacher(*_annotated(spark, d), whole_batch=True)


@query("SELECT doc_id, quality, count(quality) OVER () AS attached FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def diagnostics_left_join(spark, d):
    side = tables.last_by_key(table(spark, d, "labels").select("doc_id", "quality", F.lit(0).alias("pos")), "doc_id", "pos").select("doc_id", "quality")
    out = table(spark, d, "documents").select("doc_id").join(side, "doc_id", "left")
    return out.join(F.broadcast(out.agg(F.count("quality").alias("attached"))))


@query("WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def case_nested(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    o = table(spark, d, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    x = F.coalesce("x", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>"))
    return o.select("o_orderkey", F.size(x).cast("long").alias("n"), F.array_join(F.transform(x, lambda i: F.concat(i["l_linenumber"].cast("string"), F.lit(":"), i["l_partkey"].cast("string"))), ",").alias("items"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def cases_recent(spark, d):
    return sampling.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 0, 50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 25")
def limit_offset(spark, d):
    return sampling.page(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 25, 40)


@query("SELECT conv_id, row_number() OVER (ORDER BY 'C-' || conv_id) AS place FROM (SELECT DISTINCT conv_id FROM conversations)")
def sort_by_claim(spark, d):
    c = b.statements(spark, d).select("conv_id", "claim_id").distinct()
    return tables.numbered(c, "claim_id", name="place", start=1).select("conv_id", "place")


# Metrics.
Y, REL = ("true", "not_true"), ("supports", "neutral", "contradicts")


@query("SELECT coalesce(trim(source), '') AS label, count(*) AS n FROM documents GROUP BY 1")
def label_distribution(spark, d):
    return metrics.distribution(table(spark, d, "documents"), text.normalize_space("source"))


@query(with_(R, "v(label) AS (VALUES ('none'), ('damage_mismatch'), ('dynamics_mismatch'), ('phantom_vehicle'), ('scripted_narrative'))") + "SELECT v.label, count(id) AS n FROM v LEFT JOIN r ON v.label = inconsistency_type GROUP BY v.label")
def label_distribution_filled(spark, d):
    return metrics.distribution(b.relations(spark, d), F.col("inconsistency_type"), tuple(labels.INCONSISTENCY_IDS))


@query(with_(R) + "SELECT label, inconsistency_type, count(*) AS n FROM r GROUP BY ALL")
def pairwise_stats(spark, d):
    return b.relations(spark, d).groupBy("label", "inconsistency_type").agg(F.count(F.lit(1)).alias("n"))


@query(with_(R) + "SELECT least(role_a, role_b) AS role_1, greatest(role_a, role_b) AS role_2, count(*) AS n FROM r GROUP BY ALL")
def role_pair_counts(spark, d):
    return b.relations(spark, d).groupBy(F.least("role_a", "role_b").alias("role_1"), F.greatest("role_a", "role_b").alias("role_2")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(R) + "SELECT label, CAST(sum(count(*)) OVER () AS DOUBLE) / (3 * count(*)) AS weight FROM r GROUP BY label")
def class_weights(spark, d):
    return metrics.class_weights(b.relations(spark, d), "label", REL)


_CELLS = "cells AS (SELECT g.x AS gold, q.x AS pred, count(doc_id) AS n FROM (VALUES ('true'), ('not_true')) g(x) CROSS JOIN (VALUES ('true'), ('not_true')) q(x) LEFT JOIN p ON p.gt = g.x AND p.pred = q.x GROUP BY ALL)"
_PRF = "prf AS (SELECT l AS label, coalesce(tp / nullif(pr, 0), 0.0)::DOUBLE AS precision, coalesce(tp / nullif(su, 0), 0.0)::DOUBLE AS recall, coalesce(2 * tp / nullif(pr + su, 0), 0.0)::DOUBLE AS f1, CAST(su AS BIGINT) AS support FROM (SELECT l, CAST(sum(n) FILTER (gold = l AND pred = l) AS DOUBLE) AS tp, sum(n) FILTER (gold = l) AS su, sum(n) FILTER (pred = l) AS pr FROM cells, (VALUES ('true'), ('not_true')) v(l) GROUP BY l))"


@query(with_(P, _CELLS) + "SELECT * FROM cells")
def confusion_matrix(spark, d):
    return metrics.confusion(b.predictions(spark, d), "gt", "pred", Y)


@query(with_(P, _CELLS, _PRF) + "SELECT * FROM prf")
def per_class_prf(spark, d):
    return metrics.per_class(metrics.confusion(b.predictions(spark, d), "gt", "pred", Y))


@query(with_(P, _CELLS, _PRF) + "SELECT (SELECT CAST(sum(n) FILTER (gold = pred) AS DOUBLE) / sum(n) FROM cells) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM prf")
def macro_metrics(spark, d):
    return metrics.macro(metrics.confusion(b.predictions(spark, d), "gt", "pred", Y))


def _rates_sql(valid: str) -> str:
    return f"total, valid, CAST({valid} AS DOUBLE) / total AS json_success, CAST(tp + tn AS DOUBLE) / valid AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS specificity, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp, tn, fp, fn"


_BIN = "g AS (SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (gt = 'true' AND pred = 'true') AS tp, count(*) FILTER (gt = 'not_true' AND pred = 'not_true') AS tn, count(*) FILTER (gt = 'not_true' AND pred = 'true') AS fp, count(*) FILTER (gt = 'true' AND pred = 'not_true') AS fn FROM p)"
_SWEEP = "t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) v(i)), g AS (SELECT threshold, count(*) AS total, count(prob) AS valid, count(*) FILTER (gt = 'true' AND prob >= threshold) AS tp, count(*) FILTER (gt = 'not_true' AND prob < threshold) AS tn, count(*) FILTER (gt = 'not_true' AND prob >= threshold) AS fp, count(*) FILTER (gt = 'true' AND prob < threshold) AS fn FROM p, t GROUP BY threshold)"
STEPS = [i / 100.0 for i in range(1, 100)]


@query(with_(P, _BIN) + f"SELECT {_rates_sql('valid')} FROM g")
def binary_metrics(spark, d):
    return metrics.binary_metrics(b.predictions(spark, d))


@query(with_(P, _SWEEP) + f"SELECT threshold, {_rates_sql('valid')} FROM g")
def threshold_sweep(spark, d):
    return metrics.sweep(b.predictions(spark, d), STEPS)


@query(with_(P, _SWEEP) + f"SELECT threshold, {_rates_sql('valid')} FROM g ORDER BY f1 DESC, threshold LIMIT 1")
def calibrate_threshold(spark, d):
    return metrics.best_threshold(metrics.sweep(b.predictions(spark, d), STEPS))


@query(with_(P, _SWEEP) + f"SELECT threshold, {_rates_sql('valid')} FROM g WHERE threshold = 0.66::DOUBLE")
def apply_threshold(spark, d):
    return metrics.sweep(b.predictions(spark, d), [0.66])


@query(with_(P, "z AS (SELECT CASE gt WHEN 'true' THEN 1 ELSE 0 END AS y, prob AS s FROM p WHERE prob IS NOT NULL)", "a AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM z)") + "SELECT CAST((sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS DOUBLE) AS roc_auc FROM a")
def roc_auc(spark, d):
    return metrics.roc_auc(b.predictions(spark, d).where("prob is not null").select(F.when(F.col("gt") == "true", 1).otherwise(0).alias("y"), F.col("prob").alias("score")))


@query(with_(P, "z AS (SELECT prob AS s, sum(CASE gt WHEN 'true' THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM p WHERE prob IS NOT NULL GROUP BY prob)", "a AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS nn FROM z WINDOW w AS (ORDER BY s DESC))") + "SELECT sum(CAST(pos AS DOUBLE) * tp / nn) / sum(pos) AS average_precision FROM a")
def average_precision(spark, d):
    return metrics.average_precision(b.predictions(spark, d).where("prob is not null").select(F.when(F.col("gt") == "true", 1).otherwise(0).alias("y"), F.col("prob").alias("score")))


@query(with_(P) + "SELECT avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS json_validity, avg(CASE WHEN prob BETWEEN 0 AND 1 THEN 1.0 ELSE 0.0 END) AS valid_probability, CAST(count(*) FILTER (gt = 'not_true' AND doc_id % 4 > 0) AS DOUBLE) / greatest(1, count(*) FILTER (gt = 'not_true')) AS incongruences_on_not_true, CAST(count(*) FILTER (gt = 'true' AND doc_id % 4 = 0) AS DOUBLE) / greatest(1, count(*) FILTER (gt = 'true')) AS none_on_true FROM p")
def quality_rates(spark, d):
    p, n = b.predictions(spark, d), F.pmod("doc_id", F.lit(4))
    share = lambda c, of: F.count_if(c & of) / F.greatest(F.lit(1), F.count_if(of))
    bad, good = F.col("gt") == "not_true", F.col("gt") == "true"
    return p.agg(F.avg(F.col("valid").cast("double")).alias("json_validity"), F.avg(F.coalesce(F.col("prob").between(0, 1), F.lit(False)).cast("double")).alias("valid_probability"), share(n > 0, bad).alias("incongruences_on_not_true"), share(n == 0, good).alias("none_on_true"))


@query(with_(P, "g AS (SELECT gt, count(*) FILTER (pred = gt) * 1.0::DOUBLE / count(*) AS tuned, count(*) FILTER ((prob >= 0.3) = (gt = 'true')) * 1.0::DOUBLE / count(*) AS base FROM p GROUP BY gt)") + "SELECT gt AS metric, base, tuned, tuned - base AS delta FROM g")
def model_delta(spark, d):
    p = b.predictions(spark, d)
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1))
    tuned = p.groupBy(F.col("gt").alias("metric")).agg(share(F.col("pred") == F.col("gt")).alias("tuned"))
    base = p.groupBy(F.col("gt").alias("metric")).agg(share((F.col("prob") >= 0.3) == (F.col("gt") == "true")).alias("base"))
    return base.join(tuned, "metric", "full").select("metric", "base", "tuned", (F.col("tuned") - F.col("base")).alias("delta"))


@query(with_(P, _CELLS) + "SELECT gold, CAST(sum(n) FILTER (gold = pred) AS BIGINT) AS correct, CAST(sum(n) FILTER (gold <> pred) AS BIGINT) AS incorrect FROM cells GROUP BY gold")
def outcomes_per_class(spark, d):
    same = F.col("gold") == F.col("pred")
    return metrics.confusion(b.predictions(spark, d), "gt", "pred", Y).groupBy("gold").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("correct"), F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("incorrect"))


@query("SELECT epoch, f1 FROM (SELECT doc_id AS epoch, (doc_id * 37 % 101) / 100.0::DOUBLE AS f1 FROM labels) ORDER BY f1 DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    h = table(spark, d, "labels").select(F.col("doc_id").alias("epoch"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("f1"))
    return h.orderBy(F.desc("f1"), "epoch").limit(1)


@query("WITH e AS (SELECT doc_id AS epoch, (doc_id * 37 % 101) / 100.0::DOUBLE AS a, (doc_id * 53 % 97) / 100.0::DOUBLE AS b FROM labels) SELECT epoch, 'train' AS split, 'loss' AS metric, a AS value FROM e UNION ALL SELECT epoch, 'train', 'accuracy', b FROM e UNION ALL SELECT epoch, 'validation', 'loss', b FROM e UNION ALL SELECT epoch, 'validation', 'accuracy', a FROM e")
def series_extraction(spark, d):
    a, c = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0, F.pmod(F.col("doc_id") * 53, F.lit(97)) / 100.0
    split = lambda x, y: F.struct(x.alias("loss"), y.alias("accuracy"))
    runs = table(spark, d, "labels").select(F.array(F.struct(F.col("doc_id").alias("epoch"), split(a, c).alias("train"), split(c, a).alias("validation"))).alias("history"))
    return metrics.series(runs, "history", {"train": ("loss", "accuracy"), "validation": ("loss", "accuracy")})


@query("SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS loss FROM lineitem")
def weighted_loss_mean(spark, d):
    return table(spark, d, "lineitem").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("loss"))


# Sampling.
_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM r)"


@query(with_(R, _RANK) + "SELECT id, label FROM k WHERE rk <= (SELECT min(n) FROM k)")
def balanced_sample(spark, d):
    return sampling.balanced(b.relations(spark, d).select("id", "label"), "label", "id")


@query(with_(R, _RANK) + "SELECT id, label, CASE WHEN rk <= least(greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM k")
def stratified_2way(spark, d):
    return sampling.two_way(b.relations(spark, d).select("id", "label"), "label", "id", 0.15)


@query(with_(R, _RANK) + "SELECT id, label, CASE WHEN rk <= CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) THEN 'train' WHEN rk <= CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) + CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM k")
def stratified_3way(spark, d):
    return sampling.three_way(b.relations(spark, d).select("id", "label"), "label", "id")


@query(with_(R, _RANK, """a AS (SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS t FROM r GROUP BY label), w AS (SELECT *, CAST(ceil(round(t * 0.2::DOUBLE, 6)) AS BIGINT) AS w FROM a),
l AS (SELECT *, CAST(floor(CAST(n * w AS DOUBLE) / t) AS BIGINT) AS low FROM w), m AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY round(CAST(n * w AS DOUBLE) / t - low, 9) DESC, label) <= w - CAST(sum(low) OVER () AS BIGINT) THEN 1 ELSE 0 END AS q, CAST(ceil(w / 2.0) AS BIGINT) AS w2 FROM l),
l2 AS (SELECT *, CAST(floor(CAST(q * w2 AS DOUBLE) / w) AS BIGINT) AS low2 FROM m), m2 AS (SELECT *, low2 + CASE WHEN row_number() OVER (ORDER BY round(CAST(q * w2 AS DOUBLE) / w - low2, 9) DESC, label) <= w2 - CAST(sum(low2) OVER () AS BIGINT) THEN 1 ELSE 0 END AS q2 FROM l2)""") + "SELECT id, k.label, CASE WHEN rk <= q2 THEN 'test' WHEN rk <= q THEN 'validation' ELSE 'train' END AS split FROM k JOIN m2 ON k.label = m2.label")
def sklearn_split(spark, d):
    return sampling.two_stage(b.relations(spark, d).select("id", "label"), "label", "id")


_RANK_S = "k AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY source) AS n FROM documents)"


@query(with_(_RANK_S) + "SELECT id, source, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM k")
def split_by_generator(spark, d):
    return sampling.by_group(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "source", "id")


@query("SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM documents")
def split_val_test(spark, d):
    return sampling.val_test(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


@query("WITH k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rnd FROM documents), t AS (SELECT source FROM k ORDER BY rnd, source LIMIT 100) SELECT s.source, count(t.source) AS quota FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN t ON s.source = t.source GROUP BY s.source")
def quota_round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("source"), "source", 100)


def _diversity(r):
    return r.withColumns({"bucket": F.concat_ws("|", F.least("role_a", "role_b"), F.greatest("role_a", "role_b")), "diversity": F.concat_ws("|", F.least("claim_a", "claim_b"), F.greatest("claim_a", "claim_b"), "label")})


def _drawn(k: str, where: str, total: int) -> tuple[str, ...]:
    """Diverse sampling row by row, as {k}o (id): quotas by turns over the buckets, then each bucket's rows in hash order,
    then all rows in another; what was taken goes along in lists."""
    return (
        f"{k}p AS MATERIALIZED (SELECT id, concat_ws('|', least(role_a, role_b), greatest(role_a, role_b)) AS bucket, concat_ws('|', least(claim_a, claim_b), greatest(claim_a, claim_b), label) AS diversity FROM r WHERE {where})",
        f"{k}n AS MATERIALIZED (SELECT bucket, count(*) AS n FROM {k}p GROUP BY bucket)",
        f"{k}t AS MATERIALIZED (SELECT t, full_ FROM (SELECT t, CAST(sum(least(n, t)) AS BIGINT) AS full_ FROM {k}n, range(0, {total + 2}) AS g(t) GROUP BY t) WHERE full_ <= {total} ORDER BY t DESC LIMIT 1)",
        f"{k}q AS MATERIALIZED (SELECT bucket, least(n, t) + CASE WHEN n > t AND sum(CASE WHEN n > t THEN 1 ELSE 0 END) OVER (ORDER BY bucket) <= {total} - full_ THEN 1 ELSE 0 END AS quota FROM {k}n, {k}t)",
        f"{k}s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY phase, bucket, h, id) AS i FROM (SELECT 1 AS phase, bucket, md5('42:' || id) AS h, id, diversity, quota FROM {k}p JOIN {k}q USING (bucket) UNION ALL SELECT 2, NULL, md5('43:' || id), id, diversity, NULL FROM {k}p))",
        f"""{k}g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS ids, CAST(NULL AS VARCHAR) AS bucket, CAST(0 AS BIGINT) AS c
UNION ALL SELECT i, CASE WHEN ok THEN list_append(seen, diversity) ELSE seen END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, bucket, CASE WHEN ok THEN c + 1 ELSE c END FROM (SELECT *, NOT list_contains(seen, diversity) AND len(ids) < {total} AND (phase = 2 OR c < quota) AS ok
FROM (SELECT s.i, s.phase, s.id, s.diversity, s.bucket, s.quota, g.seen, g.ids, CASE WHEN s.bucket IS DISTINCT FROM g.bucket THEN CAST(0 AS BIGINT) ELSE g.c END AS c FROM {k}g g JOIN {k}s s ON s.i = g.i + 1)))""",
        f"{k}o AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM {k}g ORDER BY i DESC LIMIT 1))",
    )


@query(with_(R, *_drawn("a_", "label = 'supports'", 60)).replace("WITH", "WITH RECURSIVE", 1) + "SELECT id, bucket, diversity FROM a_p JOIN a_o USING (id)")
def diverse_sample(spark, d):
    r = _diversity(b.relations(spark, d).where("label = 'supports'"))
    return sampling.diverse(r, "bucket", "diversity", "id", 60).select("id", "bucket", "diversity")


_GOLD_PARTS = [("supports", None, 20), ("neutral", None, 20), ("contradicts", "damage_mismatch", 7), ("contradicts", "dynamics_mismatch", 9), ("contradicts", "phantom_vehicle", 4)]
_GOLD_SQL = [_drawn(k, f"label = '{y}'" + (f" AND inconsistency_type = '{kind}'" if kind else ""), n) for k, (y, kind, n) in zip(("a_", "b_", "c_", "d_", "e_"), _GOLD_PARTS)]


@query(with_(R, *[x for one in _GOLD_SQL for x in one], "o AS (" + " UNION ALL ".join(f"SELECT id FROM {k}_o" for k in "abcde") + ")").replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT 'GOLD-' || lpad(CAST(row_number() OVER (ORDER BY md5('43:' || id), id) AS VARCHAR), 6, '0') AS gold_pair_id, id AS source_pair_id, label AS weak_label, inconsistency_type AS weak_inconsistency_type, 'pending' AS annotation_status FROM o JOIN r USING (id)")
def gold_candidates(spark, d):
    r = _diversity(b.relations(spark, d))
    out = None
    for y, kind, n in _GOLD_PARTS:
        pool = r.where(F.col("label") == y)
        one = sampling.diverse(pool if kind is None else pool.where(F.col("inconsistency_type") == kind), "bucket", "diversity", "id", n).select("id", F.col("label").alias("weak_label"), F.col("inconsistency_type").alias("weak_inconsistency_type"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("h", sampling.hash_order(43, "id"))
    return pairs.with_ids(out, "h", "id", prefix="GOLD-").select(F.col("pair_id").alias("gold_pair_id"), F.col("id").alias("source_pair_id"), "weak_label", "weak_inconsistency_type", F.lit("pending").alias("annotation_status"))


@query(with_(P, "k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY prob DESC, doc_id) AS rk FROM p WHERE prob IS NOT NULL AND label <> 'genuine_accident')") + "SELECT doc_id, label FROM k WHERE rk <= 3")
def topn_per_label(spark, d):
    p = b.predictions(spark, d).where("prob is not null and label <> 'genuine_accident'")
    return sampling.top_n(p, "label", [F.desc("prob"), "doc_id"], 3).select("doc_id", "label")


# Encoding.
_CHARS = "translate(lower(text), '!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34))"
_VOC = f"w AS (SELECT doc_id, list_filter(string_split({_CHARS}, ' '), lambda z: z <> '') AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS place FROM w), v AS (SELECT word, count(*) AS n, min(doc_id * 10000000 + place) AS first FROM e GROUP BY word), x AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, first) + 1 AS index FROM v)"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(with_(_VOC) + "SELECT word, n, index FROM x WHERE index < 5000")
def word_vocab(spark, d):
    return encode.word_vocab(_docs(spark, d), 5000)


@query(with_(_VOC, "y AS (SELECT doc_id, place, coalesce(x.index, 1) AS i FROM e LEFT JOIN (SELECT * FROM x WHERE index < 5000) x ON e.word = x.word WHERE place < 400)", "z AS (SELECT doc_id, list(i ORDER BY place) AS ids FROM y GROUP BY doc_id)") + "SELECT w.doc_id AS id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(0, 400 - len(coalesce(ids, []))), lambda q: 0)), ' ') AS ids FROM w LEFT JOIN z ON w.doc_id = z.doc_id")
def encode_pad(spark, d):
    docs = _docs(spark, d)
    return encode.encode_pad(docs, encode.word_vocab(docs, 5000)).select("id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query()
def bpe_encode(spark, d):
    docs = _docs(spark, d)
    return encode.bpe_encode(docs, encode.train_bpe(docs)).select("id", F.size("tokens").alias("n"), "tokens")


@query()
def bpe_train(spark, d):
    m = encode.train_bpe(_docs(spark, d))
    return spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(m)], "rank int, left_part string, right_part string")


_LEN = "SELECT doc_id, CAST(doc_id % 23 AS INT) AS la, CAST(doc_id % 17 AS INT) AS lb FROM documents"


@query(f"SELECT doc_id, CASE WHEN la + lb <= 20 THEN la ELSE least(la, greatest(20 - lb, 10)) END AS a, CASE WHEN la + lb <= 20 THEN lb ELSE least(lb, 20 - least(la, greatest(20 - lb, 10))) END AS b FROM ({_LEN})")
def truncate_pair(spark, d):
    n = F.col("doc_id")
    a, c = encode.truncated_lengths(F.pmod(n, F.lit(23)).cast("int"), F.pmod(n, F.lit(17)).cast("int"), 20)
    return table(spark, d, "documents").select("doc_id", a.alias("a"), c.alias("b"))


@query(f"WITH t AS ({_LEN}), u AS (SELECT doc_id, CASE WHEN la + lb <= 20 THEN la ELSE least(la, greatest(20 - lb, 10)) END AS a, CASE WHEN la + lb <= 20 THEN lb ELSE least(lb, 20 - least(la, greatest(20 - lb, 10))) END AS b FROM t) SELECT doc_id, a + b + 3 AS used, a + 2 AS first_segment, b + 1 AS second_segment, 23 AS length, 2 AS head, 3 AS sep FROM u")
def pair_encode(spark, d):
    n = F.col("doc_id")
    ids = lambda k: F.transform(F.slice(F.sequence(F.lit(0), F.lit(k)), F.lit(1), F.pmod(n, F.lit(k)).cast("int")), lambda x: x + 10)
    x = table(spark, d, "documents").select("doc_id", encode.pair_encode(ids(23), ids(17), 23).alias("e"))
    add = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    used = add(F.col("e.attention_mask"))
    return x.select("doc_id", used.alias("used"), (used - add(F.col("e.token_type_ids"))).alias("first_segment"), add(F.col("e.token_type_ids")).alias("second_segment"), F.size("e.input_ids").alias("length"), F.element_at("e.input_ids", 1).alias("head"), F.element_at("e.input_ids", used).alias("sep"))


@query("SELECT doc_id, array_to_string(list_transform(range(0, 12), lambda i: CASE WHEN i < doc_id % 7 THEN -100 ELSE i END), ' ') AS labels FROM documents")
def sft_mask(spark, d):
    ids = F.sequence(F.lit(0), F.lit(19))
    n = F.pmod("doc_id", F.lit(7)).cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(encode.sft_labels(F.slice(ids, F.lit(1), n), F.slice(ids, n + 1, 20 - n), 12), lambda x: x.cast("string")), " ").alias("labels"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"), F.slice("embedding", 17, 8).alias("c"))
    return e.withColumns({"vectors": F.array("a", "b", "c"), "mask": F.array(F.lit(1), F.pmod("vec_id", F.lit(2)).cast("int"), F.lit(0))})


_VEC = "e AS (SELECT vec_id, list_transform(embedding[1:8], lambda z: z::DOUBLE) AS a, list_transform(embedding[9:16], lambda z: z::DOUBLE) AS b, list_transform(embedding[17:24], lambda z: z::DOUBLE) AS c FROM embeddings)"


def _rounded(c):
    return F.transform(c, lambda x: F.round(x.cast("double"), 6) + F.lit(0.0))


def _wide(df, c: str):
    return df.select("vec_id", F.posexplode(c).alias("i", "value"))


@query(with_(_VEC) + "SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(list_zip(a, b), lambda z: CASE WHEN vec_id % 2 = 1 THEN (z[1] + z[2]) / 2 ELSE z[1] END)), 6) AS value FROM e")
def masked_mean_pool(spark, d):
    return _wide(_vectors(spark, d).select("vec_id", _rounded(encode.masked_mean(F.col("vectors"), F.col("mask"))).alias("v")), "v")


@query(with_(_VEC) + "SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(b), 6) AS value FROM e")
def segment_pool(spark, d):
    one = lambda *v: F.array(*map(F.lit, v))
    m = encode.segment_mask(one(1, 1, 1), one(0, 1, 1), one(1, 0, 1), 1)
    return _wide(_vectors(spark, d).select("vec_id", _rounded(encode.masked_mean(F.col("vectors"), m)).alias("v")), "v")


@query(with_(_VEC, "f AS (SELECT vec_id, list_concat(list_concat(list_concat(list_concat(a, b), c), list_transform(list_zip(b, c), lambda z: abs(z[1] - z[2]))), list_transform(list_zip(b, c), lambda z: z[1] * z[2])) AS v FROM e)") + "SELECT vec_id, unnest(range(0, 40)) AS i, round(unnest(v), 6) + 0.0 AS value FROM f")
def comparison_features(spark, d):
    dbl = lambda c: F.transform(c, lambda x: x.cast("double"))
    return _wide(_vectors(spark, d).select("vec_id", _rounded(encode.comparison(dbl("a"), dbl("b"), dbl("c"))).alias("v")), "v")


@query(with_(_VEC, "f AS (SELECT vec_id, a, list_sum(list_transform(a, lambda z: exp(z))) AS t FROM e)") + "SELECT vec_id, round(exp(list_max(a)) / t, 6) AS top, list_position(a, list_max(a)) - 1 AS label FROM f")
def softmax_argmax(spark, d):
    x = _vectors(spark, d).select("vec_id", encode.softmax(F.transform("a", lambda z: z.cast("double"))).alias("p"), "a")
    return x.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), encode.argmax(F.col("a")).cast("long").alias("label"))
