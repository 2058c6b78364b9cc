"""The operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe_automaton, chat_format, decontaminate, importance_resampling, jaccard_join, license_scan, lm_score, mixing, periodic_runs, quality_classifier, quality_rules, sharding, toxicity
from siltstone.llm.common import new_dir, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.audit(sharding.shard(read_table(spark, sf_dir, "documents"), new_dir(spark, "shards")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(read_table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.clean_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_turns(turns.unionByName(own))).drop("rewritten")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(read_table(spark, sf_dir, "documents"))


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs with the words from the a-th on made periodic in the texts whose crc32 of doc_id divides by 10."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(rf"regexp_extract_all(text, r'{SPACED}', 0)")))
    sized = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    sized = sized.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    planted = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1))), 1, n - a)), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_runs(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    found = found.withColumn("m", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.expr("(1000 * m.length) div -m.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_automaton.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_mix_sources, op4_shard, op5_ngram_jaccard, op6_quality_rules, op7_chat_format, op8_lm_score, op9_quality_rank, op10_toxicity, op11_importance_resampling, op12_periodic_runs, op13_bpe_automaton)}

SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lettered(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{LETTERED}')"


#: The table of CRC-32 and the CRC-32 of a list of bytes `b`, in SQL; `t` is the row with the table.
CRC_TABLE = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY n) AS t FROM range(256) AS r(n)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)])), 4294967295)"
#: The bytes of a string `s`, as numbers.
BYTES = "list_transform(range(CAST(strlen(s) AS BIGINT)), lambda i: CAST((strpos('0123456789ABCDEF', substr(hex(encode(s)), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(s)), 2 * i + 2, 1)) - 1 AS BIGINT))"

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_lettered("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_lettered("text")} AS w FROM benchmark),
iw AS (SELECT item, w[p:p + 9] AS g FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10)
       UNION SELECT item, w FROM i WHERE len(w) BETWEEN 1 AND 9),
k AS (SELECT DISTINCT len(g) AS k FROM iw),
dw AS (SELECT doc_id, p, k, w[p:p + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, p, k, item FROM dw JOIN iw USING (g)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id""",
    "op2_license_scan": f"""
WITH t(tid, license, bigram) AS (VALUES {", ".join(f"({i}, '{n}', '{b}')" for i, (n, bs) in enumerate(license_scan.template_bigrams()) for b in bs)}),
m AS (SELECT tid, count(*) AS m FROM t GROUP BY tid),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS x FROM documents),
parted AS (SELECT doc_id, string_split_regex(x, '\\n+') AS parts FROM d UNION ALL SELECT doc_id, string_split_regex(x, '\\n\\n+') AS parts FROM d),
u AS (SELECT DISTINCT doc_id, regexp_replace(u, '\\n+', ' ', 'g') AS u FROM (
      SELECT doc_id, array_to_string(parts[p:p + k - 1], ' ') AS u FROM (SELECT doc_id, parts, k, unnest(range(1, len(parts) - k + 2)) AS p FROM parted, range(1, {license_scan.RUNS + 1}) AS r(k) WHERE len(parts) >= k) UNION ALL SELECT doc_id, x AS u FROM d)),
w AS (SELECT doc_id, u, string_split(u, ' ') AS w FROM u),
c AS (SELECT DISTINCT doc_id, u, w[p] || ' ' || w[p + 1] AS bigram FROM (SELECT doc_id, u, w, unnest(range(1, len(w))) AS p FROM w WHERE len(w) >= 2)),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, u) AS n FROM c),
s AS (SELECT doc_id, u, n, license, m, count(*) AS shared FROM b JOIN t USING (bigram) JOIN m USING (tid) GROUP BY doc_id, u, n, tid, license, m),
g AS (SELECT doc_id, license, 2.0::DOUBLE * shared / (n + m) AS dice FROM s WHERE 200 * shared >= {license_scan.THRESHOLD_PERCENT} * (n + m)),
p AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice FROM g GROUP BY doc_id),
q AS (SELECT g.doc_id, min(license) AS best_license FROM g JOIN p ON g.doc_id = p.doc_id AND dice = best_dice GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, best_license, best_dice FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id""",
    "op3_mix_sources": f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
b AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM a),
c AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
      row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM b),
e AS (SELECT *, total - coalesce(CAST(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest_size,
      all_w - coalesce(CAST(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest_w FROM c),
l AS (SELECT rest_size AS ls, rest_w AS lw FROM e WHERE CAST(rest_size AS DOUBLE) * w / rest_w <= cap ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), CAST(ls AS DOUBLE) * w / lw), CAST(cap AS DOUBLE)) AS target FROM e LEFT JOIN l ON true),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS whole FROM t),
g AS (SELECT s.doc_id, s.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
      sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g""",
    "op4_shard": "SELECT doc_id, count(*) AS copies, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, true AS compacted FROM documents GROUP BY doc_id",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p:p + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)
      UNION SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM d),
m AS (SELECT doc_id, line, regexp_extract_all(line, '{SPACED}') AS w, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
      length(regexp_replace(line, '[^|>]', '', 'g')) AS pipes, length(regexp_replace(line, '[^!]', '', 'g')) AS shouts, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lower,
      regexp_matches(line, '{quality_rules.BOILERPLATE.pattern.decode()}') AS boilerplate, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l),
n AS (SELECT *, len(w) AS n, again AND len(w) > 0 AS dup FROM m),
f AS (SELECT *, n > 0 AND (symbols * 10 > greatest(chars, 1) OR (shouts * 4 > n AND shouts >= 4) OR (upper > 2 * lower AND upper >= 20) OR (pipes >= 2 AND pipes * 4 > n)
      OR (n <= 2 AND NOT regexp_matches(right(w[n], 1), '[.!?:;"'')\\]}}]|[^\\x00-\\x7F]')) OR (boilerplate AND n <= 40) OR dup) AS fails FROM n),
g AS (SELECT doc_id, CAST(sum(chars) AS BIGINT) AS word_chars, CAST(sum(symbols) AS BIGINT) AS n_symbols, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS lost_chars FROM f GROUP BY doc_id),
r AS (SELECT doc_id, ws[p:p + 7] AS g, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8)),
q AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id, g HAVING count(*) > 1),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS x FROM (SELECT doc_id, unnest(ps) AS p FROM q)) GROUP BY doc_id),
z AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words, n_failed_lines, lost_chars FROM d JOIN g ON d.doc_id = g.doc_id LEFT JOIN h ON d.doc_id = h.doc_id),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM z)
SELECT *, NOT base_failed AND lost_chars <= 0.4::DOUBLE * word_chars AS kept FROM y""",
    "op7_chat_format": """
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, """ + "length({0}) + 2 * 0".format("replace(" * 8 + "replace(text, '\\', '\\\\')" + "".join(f", '{x}', '{x[0]}\\{x[1:]}')" for x in chat_format.CONTROL)) + """ AS n,
      """ + "length({0})".format("replace(" * 8 + "replace(role, '\\', '\\\\')" + "".join(f", '{x}', '{x[0]}\\{x[1:]}')" for x in chat_format.CONTROL)) + """ AS nr FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 WHEN 'system' THEN 11 ELSE 17 + nr END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_importance_resampling": f"""
WITH c AS ({CRC_TABLE}),
w AS (SELECT false AS own, doc_id, {_lettered("text")} AS w FROM documents UNION ALL SELECT true, NULL, {_lettered("text")} FROM benchmark),
k AS (SELECT row_number() OVER () AS k, * FROM w),
f AS (SELECT k, own, unnest(w) AS f FROM k UNION ALL SELECT k, own, w[p] || ' ' || w[p + 1] FROM (SELECT k, own, w, unnest(range(1, len(w))) AS p FROM k WHERE len(w) >= 2)),
b AS (SELECT s, {CRC} % {importance_resampling.BUCKETS} AS bucket FROM (SELECT s, t, {BYTES} AS b FROM (SELECT DISTINCT f AS s FROM f), c)),
n AS (SELECT bucket, count(*) FILTER (NOT own) AS s, count(*) FILTER (own) AS t FROM f JOIN b ON f = s GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM n) + {importance_resampling.BUCKETS}.0::DOUBLE)) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM n) + {importance_resampling.BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain FROM n),
m AS (SELECT k, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b ON f = s JOIN g USING (bucket) WHERE NOT own GROUP BY k),
d AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
      CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM k LEFT JOIN m USING (k) WHERE NOT own),
e AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () * 25 // 100 AS drawn FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM r""",
    "op12_periodic_runs": f"""
WITH c AS ({CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, {CRC} AS h FROM (SELECT doc_id, text, t, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)) AS b FROM documents, c)),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS own, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 % 8 + 3 AS k FROM d),
p AS (SELECT doc_id, n, CASE WHEN own THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM a),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM p),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM l GROUP BY doc_id, s, len),
b AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN b USING (doc_id, i) GROUP BY doc_id),
v AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) AS k FROM r)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN t ON p.doc_id = t.doc_id LEFT JOIN v ON p.doc_id = v.doc_id LEFT JOIN z ON p.doc_id = z.doc_id AND z.k = 1""",
}
