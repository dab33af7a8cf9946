"""Queries ``opN_<name>`` over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm import decontaminate, disclosure, divergence, importance, mixing, parity_join, ppm, quality, secrets, toxicity, urlfilter, warc, wavelet
from taxolens.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: A page is on the list if the SHA-256 of host and path, in hex, begins with one of these.
LISTED_BY = "0123"


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list that stands in for a bought one: a table of a quarter of the crawl's pages,
    which grows with it."""
    key = urlfilter.page(*urlfilter.host_path("url"))
    return pages.select(key.alias("key")).distinct().where(F.substring(F.sha2("key", 256), 1, 1).isin(*LISTED_BY))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, listed_pages(pages), key=urlfilter.page).select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), into="s").select("doc_id", "s.*")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ppm.score(docs, docs.where(ppm.fold() != ppm.HELD_OUT))
    return scored.select("doc_id", (ppm.fold() == ppm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    revisit = F.col("answer.kind") == "revisit"
    return captures.select(
        "page_id", F.when(revisit, F.col("original.response_bytes")).otherwise(F.col("answer.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.response_digest")).otherwise(F.col("answer.payload_digest")).alias("payload_digest"),
        F.col("answer.kind").alias("record_type"), F.when(revisit, F.col("original.response_page")).alias("refers_to"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.assess(docs, model, into="score")
    return scored.select("doc_id", (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.tokenised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), into="m")
    ids = F.array_sort("m.items")
    return found.select(
        "doc_id", "m.n_words", F.size("m.hit").cast("long").alias("n_hit"), F.size("m.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("m.hit") > 0).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model, into="q").select("doc_id", "q.*")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weigh(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return importance.rank(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op12_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_url_filter": op2_url_filter,
        "op3_secret_scan": op3_secret_scan,
        "op4_lm_score": op4_lm_score,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_toxicity": op7_toxicity,
        "op8_token_shards": op8_token_shards,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
        "op11_importance_resample": op11_importance_resample,
        "op12_sanitise": op12_sanitise,
        "op13_source_divergence": op13_source_divergence,
    }


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REST = "CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RULES = sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1]))
OP2 = f"""WITH r AS (SELECT page_id, coalesce({REST}, '') AS rest FROM pages),
h AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RULES)}
  WHEN host <> '' AND sha256(host || path)[1:1] IN ({", ".join(f"'{x}'" for x in LISTED_BY)}) THEN 'block' ELSE 'allow' END AS verdict FROM h"""

OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT html, max(page_id) AS top FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (html)"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') || ' |' || len(ws) FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS low FROM reach GROUP BY 1) USING (doc_id)"""

_TERMS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS x
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i)),
sizes AS (SELECT DISTINCT size FROM win),
found AS (
  SELECT doc_id, i, win.size, item_id FROM (
    SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS x FROM d, sizes, LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i)) o JOIN win USING (size, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


OP13 = f"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tok AS (SELECT doc, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY 1, 2 HAVING count(DISTINCT doc) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS n FROM full_c GROUP BY 1, 2),
p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + 1000000000::HUGEINT * (f.n + 2) // (t.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (f.lang_n + 2) // (v.n + 2 * v.v) AS q
  FROM full_c f JOIN t ON t.lang = f.lang AND t.source = f.source JOIN v ON v.lang = f.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.MOST_TERMS}"""


def oracle_sql() -> dict[str, str]:
    """Models, tokenizers, random rounding and linked spans are beyond SQL; the tests
    compare those queries with brute force."""
    return {"op2_url_filter": OP2, "op5_warc": OP5, "op6_jaccard_join": OP6, "op9_decontaminate": OP9, "op13_source_divergence": OP13}
