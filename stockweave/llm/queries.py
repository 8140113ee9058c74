"""Registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockweave.llm import hosts, infill, knn_quality, maxscore, mixing, packing, quality_rules, secrets, setsketch, simhash, suffix_dedup, survival, token_files
from stockweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


OP4 = rf"""
WITH first AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS_SQL}))::BIGINT AS size,
                      CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place FROM documents),
turns AS (SELECT *, row_number() OVER (PARTITION BY source, place) - 1 AS turn FROM first),
sized AS (SELECT doc_id, source, size, CASE turn WHEN 0 THEN place ELSE CAST('0x' || substr(md5('mix:' || place || ':' || turn), 1, 15) AS BIGINT) END AS pos FROM turns),
sums AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
ranked AS (SELECT source, total, total * 2 AS most,
                  [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sums),
levels AS (SELECT *, (1.5::DOUBLE * sum(total) OVER ()::DOUBLE - coalesce(sum(most) OVER before, 0)::DOUBLE) / sum(w) OVER rest AS level FROM ranked
           WINDOW before AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  rest AS (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT (SELECT level FROM levels WHERE level * w < most ORDER BY most / w, source LIMIT 1) AS level),
goals AS (SELECT source, total, CASE WHEN level.level IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, level.level * w) END AS target FROM ranked, level),
cums AS (SELECT source, pos, size, sum(size) OVER (PARTITION BY source ORDER BY pos RANGE UNBOUNDED PRECEDING) AS cum FROM sized WHERE size > 0),
served AS (SELECT c.source, pos, size, p, floor((p * total + cum)::DOUBLE / target * 1125899906842624::DOUBLE)::BIGINT AS finish
           FROM cums c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) v(p)
           WHERE target > 0 AND p * total + cum - size < target),
timed AS (SELECT finish, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS through FROM served),
cut AS (SELECT coalesce(max(finish), -1) AS cut FROM timed WHERE through <= 1.5::DOUBLE * (SELECT sum(total) FROM goals)::DOUBLE),
upto AS (SELECT source, max(pos) FILTER (p = 0) AS p0, max(pos) FILTER (p = 1) AS p1 FROM served, cut WHERE finish <= cut GROUP BY source)
SELECT doc_id, size, total AS source_size, target, (size * ((pos <= coalesce(p0, -1))::INT + (pos <= coalesce(p1, -1))::INT))::BIGINT AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN upto u ON s.source IS NOT DISTINCT FROM u.source"""


@query("op4_fair_queue_mix", OP4)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.plan(table(spark, sf, "documents"))


OP5 = r"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
outcomes AS (SELECT *, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' END AS said FROM ruled),
hosts AS (SELECT host, count(rule) AS n, count(*) FILTER (said = 'block') AS bad,
                 CASE WHEN regexp_matches(host, '^[0-9.:\[\]]*$') THEN host ELSE regexp_extract(host, '[^.]*\.[^.]*$|^[^.]*$') END AS domain FROM outcomes GROUP BY host),
domains AS (SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
levels AS (SELECT 'h' AS l, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
sums AS (SELECT l, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS hits, sum(n::DOUBLE * n) AS squares, sum(bad::DOUBLE * bad / n) AS share
         FROM levels WHERE n > 0 GROUP BY l),
rhos AS (SELECT l, k, (total - squares / total - (k - 1)) * (hits / total) * (1 - hits / total) AS room,
                (share - hits * (hits / total)) - (k - 1) * (hits / total) * (1 - hits / total) AS over FROM sums),
strengths AS (SELECT l, CASE WHEN k < 2 OR room <= 0 OR over <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - over / room) / (over / room))) END AS m FROM rhos),
m AS (SELECT coalesce(max(m) FILTER (l = 'h'), 1000) AS mh, coalesce(max(m) FILTER (l = 'd'), 1000) AS md, coalesce(max(m) FILTER (l = 's'), 1000) AS ms FROM strengths),
whole AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS g FROM suffixes),
ps AS (SELECT suffix, (bad + ms * g) / (n + ms) AS ps FROM suffixes, m, whole),
pd AS (SELECT domain, (bad + md * ps) / (n + md) AS pd FROM domains JOIN ps USING (suffix), m),
ph AS (SELECT host, n + mh AS size, (bad + mh * pd) / (n + mh) AS rate FROM hosts JOIN pd USING (domain), m),
low AS (SELECT host, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (size + 1)) AS low FROM ph)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN low >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM outcomes JOIN low USING (host)"""


@query("op5_host_reputation", OP5)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.judge(table(spark, sf, "pages")).drop("rate", "low")


def _kind_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = "'" + re.sub(r"([*+?}])\+", r"\1", pattern).replace("'", "''") + "'"  # possessive or not gives the same matches
    return (f"SELECT blob, '{kind}' AS kind, {place} AS place, unnest(range(1, len(w) + 1)) AS i, w, k, s, {least} AS least FROM "
            f"(SELECT blob, regexp_extract_all(text, {p}, 0) AS w, regexp_extract_all(text, {p}, {group}) AS k, regexp_split_to_array(text, {p}) AS s FROM blobs) WHERE len(w) > 0")


OP10 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM docs GROUP BY blob),
matches AS ({" UNION ALL ".join(_kind_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES))}),
placed AS (SELECT blob, kind, place, length(k[i]) >= least AS counts, length(w[i]) AS chars,
                  list_sum(list_transform(w[1:i], lambda x: length(x))) + list_sum(list_transform(s[1:i], lambda x: length(x))) AS stop FROM matches),
spans AS (SELECT blob, kind, place, (stop - chars)::BIGINT AS start, kind || ':' || (stop - chars)::BIGINT || ':' || stop::BIGINT AS span FROM placed WHERE counts),
found AS (SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ('assign', 'access', 'hex')), '') AS base, string_agg(span, ',' ORDER BY start, place) AS spans
          FROM spans GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN found USING (blob)"""


@query("op10_blob_ledger", OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secrets.report(docs, secrets.scan(docs)[1])


OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') || chr(1) || coalesce('=' || source, '') AS k, coalesce('=' || lang, '') AS l, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT id, regexp_extract_all(text, {WORDS_SQL}) AS w FROM docs)),
windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM (SELECT id, i, w AS a, lead(w) OVER d AS b, lead(w, 2) OVER d AS c FROM tokens
            WINDOW d AS (PARTITION BY id ORDER BY i)) WHERE c IS NOT NULL),
covered AS (SELECT id, count(DISTINCT i + j) AS n FROM windows, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY id),
lines AS (SELECT id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, {WORDS_SQL}) GROUP BY id),
counts AS (SELECT id, doc_id, k, l, len(regexp_extract_all(text, {WORDS_SQL}))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n - d, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                  coalesce(lines.n, 0)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')))::BIGINT AS n_marks,
                  (length(text) - length(regexp_replace(text, '[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]', '', 'g')))::BIGINT AS n_upper
           FROM docs LEFT JOIN covered USING (id) LEFT JOIN lines USING (id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ratios AS (SELECT id, k, l, base_failed, unnest([0, 1, 2, 3, 4, 5]) AS r,
                  unnest([{", ".join(f"CASE WHEN {b} > 0 THEN {t}::DOUBLE / {b} ELSE 0.0::DOUBLE END" for t, b in
                                     (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_marks", "word_chars"), ("n_upper", "word_chars")))}]) AS x FROM base),
cells AS (SELECT k, l, r, CASE WHEN x > 0 THEN ceil(ln(x) / {quality_rules.STEP!r}::DOUBLE)::INT ELSE -100000 END AS b FROM ratios WHERE NOT base_failed),
{", ".join(f'''cum{n} AS (SELECT {keys} r, b, sum(count(*)) OVER (PARTITION BY {keys} r ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY {keys} r) AS n,
                  CASE WHEN b = -100000 THEN 0.0::DOUBLE ELSE exp(b * {quality_rules.STEP!r}::DOUBLE) * {2 / (1 + math.exp(quality_rules.STEP))!r}::DOUBLE END AS v FROM cells GROUP BY {keys} r, b),
q{n} AS (SELECT {keys} r, max(n) AS n, min(v) FILTER (upto > floor((n - 1) * 0.25)) AS q1, min(v) FILTER (upto > floor((n - 1) * 0.75)) AS q3 FROM cum{n} GROUP BY {keys} r),
f{n} AS (SELECT {keys} r, n::DOUBLE AS n, q1 - 3.0 * greatest(q3 - q1, {[r.floor for r in quality_rules.RATIOS]}[r + 1]::DOUBLE) AS low,
                q3 + 3.0 * greatest(q3 - q1, {[r.floor for r in quality_rules.RATIOS]}[r + 1]::DOUBLE) AS high FROM q{n})''' for n, keys in ((0, ""), (1, "l, "), (2, "k, l, ")))},
fences AS (SELECT k, r, (f2.n * f2.low + 50 * ((f1.n * f1.low + 50 * f0.low) / (f1.n + 50))) / (f2.n + 50) AS low,
                  (f2.n * f2.high + 50 * ((f1.n * f1.high + 50 * f0.high) / (f1.n + 50))) / (f2.n + 50) AS high FROM f2 JOIN f1 USING (l, r) JOIN f0 USING (r)),
inside AS (SELECT id, bool_and(coalesce(x <= high AND (r > 0 OR x >= low), false)) AS ok FROM ratios LEFT JOIN fences USING (k, r) GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM base JOIN inside USING (id)"""


@query("op1_adaptive_quality", OP1)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents")).drop("n_lines", "n_marks", "n_upper")


@query("op2_bin_completion")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query("op9_simhash_blocks")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op3_patched_frames")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf, "documents"))


@query("op8_maxscore_top20", """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_neighbour_vote")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return knn_quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf, "documents"), texts=False)


OP11 = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                      sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
               coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM cut"""


@query("op11_block_rotation", OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    out = infill.transform(table(spark, sf, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infill.restored(), 256).alias("restored_sha256"))


OP13 = rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS w FROM documents),
failed AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS f FROM words),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, f),
orders AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS before FROM (VALUES {", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))}) v(o), range(1, 6) r(step)),
each AS (SELECT part, o, step, own, n, good, toxic, contains(f, own) AS fails, f = own AS alone, length(translate(f, before, '')) < length(f) AS gone FROM docs, orders),
counts AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
                  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                  coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
           FROM each GROUP BY part, o, step, own)
SELECT part, o AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts"""


@query("op13_survival_words", OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return survival.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP12 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS_SQL}) AS w FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""


@query("op12_setsketch_bands", OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf, "documents")).drop("root")
