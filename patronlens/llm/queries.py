"""The registered queries over the corpus tables and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import byte_network, decontamination, filter_audit, language, lm_scoring, mixing, near_duplicates, packing, phrases, toxicity, url_filter, vector_graph, warc_fixity
from patronlens.llm.common import remainder, table
from patronlens.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
phrases AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM places),
found AS (SELECT doc_id, item_id, s, p.n FROM phrases p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY 1),
own AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN own o ON d.doc_id = o.doc_id
"""


@query("op2_decontamination", DECONTAMINATION_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.hit_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


NEAR_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS s FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM docs UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.id = links.a),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least ON d.doc_id = id
"""


@query("op3_near_duplicates", NEAR_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    placed = near_duplicates.components(table(spark, folder, "documents"), shingle=3, percent=85)
    return placed.withColumn("kept", near_duplicates.kept(F.col("doc_id"), F.col("component_id")))


MIXING_SQL = rf"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, sum(size) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM docs GROUP BY source),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS everything FROM sources),
levels AS (
    SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
fits AS (SELECT l.level, abs(sum(least(c.cap, l.level * c.weight)) - any_value(c.everything)) AS miss FROM levels l, caps c GROUP BY l.level),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, weight * (SELECT arg_min(level, miss) FROM fits)) AS target FROM levels),
groups AS (SELECT DISTINCT doc_id, source, size, md5(coalesce(CAST(doc_id AS VARCHAR), '~')) AS h FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(h, 1, 6) AS BIGINT) % 1024, h, doc_id) AS r FROM groups),
steps AS (
    SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
        CAST('0x' || substr(md5(coalesce(k.source, '~')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u
    FROM ranked k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(d.size * (floor(u + step * r) - floor(u + step * (r - 1))) AS BIGINT) AS taken
FROM docs d JOIN steps s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.source IS NOT DISTINCT FROM s.source AND d.size = s.size
"""


@query("op4_mixing", MIXING_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan(table(spark, folder, "documents"))
    each = planned.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "size", "source_size", "target", "taken")


_SQL_RECORD = """'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || e
    || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Length: ' || strlen(body) || e || e || body || e || e"""
#: The second replica of the audit: of every 97 page ids one payload is altered, one loses its end, and one record is absent.
ALTERED, SHORTENED, ABSENT, EVERY = 5, 17, 11, 97

FIXITY_SQL = f"""
WITH own AS (SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS e FROM pages),
a AS (SELECT page_id, url, strlen(r) AS length, sha256(r) AS digest FROM (SELECT page_id, url, {_SQL_RECORD} AS r FROM own)),
placed AS (SELECT *, page_id // 512 AS archive, coalesce(sum(length) OVER (PARTITION BY page_id // 512 ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM a),
damaged AS (SELECT page_id, url, e, CASE page_id % {EVERY} WHEN {ALTERED} THEN '#' || body ELSE substr(body, 1, length(body) // 2) END AS body FROM own WHERE page_id % {EVERY} IN ({ALTERED}, {SHORTENED})),
b AS (SELECT page_id, strlen(r) AS length, sha256(r) AS digest FROM (SELECT page_id, {_SQL_RECORD} AS r FROM damaged))
SELECT CAST(archive AS BIGINT) AS archive, CAST("offset" AS BIGINT) AS "offset", p.page_id AS record_id,
    CASE WHEN p.page_id % {EVERY} = {ABSENT} THEN 'missing' ELSE 'changed' END AS status,
    p.length AS length, b.length AS their_length, p.digest AS digest, b.digest AS their_digest
FROM placed p LEFT JOIN b ON p.page_id = b.page_id WHERE p.page_id % {EVERY} IN ({ALTERED}, {SHORTENED}, {ABSENT})
"""


@query("op6_warc_fixity", FIXITY_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    left = F.coalesce(F.pmod(F.col("page_id"), F.lit(EVERY)), F.lit(-1))
    body = F.coalesce("html", F.lit(""))
    html = F.when(left == ALTERED, F.concat(F.lit("#"), body)).when(left == SHORTENED, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).otherwise(body)
    ours = warc_fixity.archived(pages)
    theirs = warc_fixity.archived(pages.where(left != ABSENT).select("page_id", "url", html.alias("html")))
    return warc_fixity.audit(ours, theirs)


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), packing.read_vocabulary())


RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Hosts of these names stand for the pages a list keeper has reported; their canonical URLs are the list.
REPORTED_HOSTS = "casino|pills|bets"


def _sql_fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _sql_longest(pick) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r.host + r.path))
    return "CASE " + " ".join(f"WHEN {_sql_fits(r.host, r.path)} THEN '{pick(r)}'" for r in longest_first) + " END"


URL_SQL = rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), {A_TO_Z}) AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
        regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM cut),
keyed AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS k FROM parts),
listed AS (SELECT DISTINCT k FROM keyed WHERE regexp_matches(host, '{REPORTED_HOSTS}')),
ruled AS (SELECT *, {_sql_longest(lambda r: r.host + r.path)} AS rule, {_sql_longest(lambda r: r.verdict)} AS v FROM keyed)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, l.k IS NOT NULL AS listed,
    coalesce(v, CASE WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN listed l ON r.k = l.k
"""


@query("op9_url_filter", URL_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = pages.where(host.rlike(REPORTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(documents, ~held_out)
    return language.predict(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(documents, labels.where(remainder(F.col("doc_id"), 3) != 1))
    held_out = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return toxicity.score(documents.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted", "n_hits", "strongest")


@query("op5_lm_scoring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 10) == 0
    result = lm_scoring.scored(documents, ~held_out)
    return result.select("doc_id", held_out.alias("held_out"), *[c for c in result.columns if c != "doc_id"])


@query("op8_embedding_near_duplicates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    found = cut_lineage(vector_graph.near_duplicates(embeddings))
    recall, links = vector_graph.audit(embeddings, found)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"), F.lit(recall).cast("double").alias("audited_recall"), F.lit(links).cast("long").alias("audited_links"))


AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > least THEN 16 ELSE 0 END AS mask
    FROM docs d JOIN firsts USING (t) LEFT JOIN marks m ON d.doc_id = m.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY 1, 2),
letters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.b + q.b + r.b + s.b + t.b = 31 AND list_unique([p.b, q.b, r.b, s.b, t.b]) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM orders, range(1, 6) x(step)),
cells AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, (SELECT filter_order, CAST(step AS INT) AS step, CAST(own AS INT) AS own, CAST(before AS INT) AS before FROM steps) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM cells
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    flags = filter_audit.flagged(table(spark, folder, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(flags, table(spark, folder, "labels")))


PHRASES_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), {A_TO_Z}), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents),
grams AS (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM pieces, range(1, 4) x(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scores AS (
    SELECT c.lang, c.m, c.phrase, a, k, p.f AS l, q.f AS r, 1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f) AS score
    FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = x JOIN f q ON q.lang = c.lang AND q.phrase = y),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS around FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE m = 3) GROUP BY 1, 2),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE coalesce(100 * around < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT t.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked k JOIN totals t ON k.lang = t.lang WHERE rank <= 2000
"""


@query("op12_phrases", PHRASES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents")).withColumnRenamed("part", "lang")


@query("op13_quality")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = byte_network.fit(documents, labels.where(remainder(F.col("doc_id"), 5) != 0))
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return byte_network.score(documents.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted")
