"""DuckDB SQL for the catalogue, on the same Parquet tables."""

from __future__ import annotations

from taxolens.operators.split import STOP_WORDS

PREFIX = "https://openalex.org/"


MEMBERS = f"""members AS (
  SELECT DISTINCT '{PREFIX}T' || o_custkey AS topic_id, lower(concat_ws(' ', p_brand, p_name, p_type, p_size)) AS keyword
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


TOPICS = f"""topics AS (
  SELECT '{PREFIX}T' || c_custkey AS topic_id, c_name AS topic, coalesce(w.n, 0)::BIGINT AS works_count, coalesce(k.n, 0)::BIGINT AS keyword_count, c_mktsegment,
    '{PREFIX}subfields/' || n_nationkey AS subfield_id, n_name AS subfield_name, '{PREFIX}fields/' || n_regionkey AS field_id, r_name AS field_name,
    '{PREFIX}domains/' || (n_regionkey % 2) AS domain_id, 'Domain ' || (n_regionkey % 2) AS domain_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) w ON o_custkey = c_custkey
  LEFT JOIN (SELECT topic_id, count(*) AS n FROM members GROUP BY 1) k ON k.topic_id = '{PREFIX}T' || c_custkey)"""

NEAR = """sizes AS (SELECT topic_id, count(*) AS n FROM members GROUP BY 1),
pairs AS (SELECT a.topic_id AS src, b.topic_id AS dst, count(*) AS shared FROM members a JOIN members b ON a.keyword = b.keyword AND a.topic_id <> b.topic_id GROUP BY 1, 2),
near AS (
  SELECT * FROM (
    SELECT src, dst, shared, s.n + d.n - shared AS all_keywords, shared / (s.n + d.n - shared)::DOUBLE AS similarity,
      row_number() OVER (PARTITION BY src ORDER BY shared / (s.n + d.n - shared)::DOUBLE DESC, dst) AS place
    FROM pairs JOIN sizes s ON s.topic_id = src JOIN sizes d ON d.topic_id = dst) WHERE place <= 10)"""

AUDIT = f"WITH {MEMBERS}, {TOPICS}, {NEAR}"


def _shares(level: str) -> str:
    return f"""
  SELECT '{level}' AS level, topic_id, parent_id, share, count, own,
    row_number() OVER (PARTITION BY topic_id ORDER BY round(share, 12) DESC, own DESC, parent_id) AS place
  FROM (
    SELECT src AS topic_id, d.{level}_id AS parent_id, sum(similarity ORDER BY similarity) / any_value(total) AS share, count(*) AS count, d.{level}_id = any_value(s.{level}_id) AS own
    FROM near JOIN topics d ON d.topic_id = dst JOIN topics s ON s.topic_id = src
    JOIN (SELECT src, sum(similarity ORDER BY similarity) AS total FROM near GROUP BY 1) t USING (src)
    GROUP BY src, d.{level}_id
    UNION ALL
    SELECT topic_id, {level}_id, 0.0, 0, true FROM topics t WHERE NOT EXISTS (
      SELECT 1 FROM near JOIN topics d ON d.topic_id = dst WHERE src = t.topic_id AND d.{level}_id = t.{level}_id))"""


def _assessed(level: str) -> str:
    return f"""{AUDIT}, shares AS ({_shares(level)}),
best AS (
  SELECT topic_id, arg_min(parent_id, place) FILTER (count > 0) AS plurality_id, arg_min(share, place) FILTER (count > 0) AS plurality_share,
    arg_min(count, place) FILTER (count > 0) AS plurality_count, max(share) FILTER (own) AS stated_share FROM shares GROUP BY 1),
strong AS (SELECT src AS topic_id, sum(similarity ORDER BY similarity) / 10 AS strength, count(*) AS neighbour_count FROM near GROUP BY 1),
base AS (
  SELECT t.*, b.* EXCLUDE (topic_id), coalesce(strength, 0) AS strength, coalesce(neighbour_count, 0) AS neighbour_count,
    coalesce(greatest(0, round(plurality_share - stated_share, 12)), 0) AS margin
  FROM topics t LEFT JOIN best b USING (topic_id) LEFT JOIN strong USING (topic_id)),
judged AS (
  SELECT *, CASE WHEN neighbour_count < 3 OR (margin > 0 AND plurality_count < 2) THEN 'insufficient_evidence' WHEN margin > 0 THEN 'review' ELSE 'consistent' END AS status FROM base),
scored AS (SELECT *, round(CASE WHEN status = 'review' THEN round(margin * strength, 12) ELSE 0.0 END, 9) AS score FROM judged),
named AS (SELECT {level}_id AS id, any_value({level}_name) AS name FROM topics GROUP BY 1),
ranked AS (
  SELECT split_part(topic_id, '/', -1) AS topic_id, topic, works_count, status, score, round(margin, 9) AS margin, round(strength, 9) AS strength, neighbour_count,
    {level}_id AS stated_id, {level}_name AS stated_parent, round(stated_share, 9) AS stated_share, plurality_id, named.name AS plurality_parent, round(plurality_share, 9) AS plurality_share,
    row_number() OVER (ORDER BY score DESC, split_part(topic_id, '/', -1)) AS rank
  FROM scored LEFT JOIN named ON named.id = plurality_id)"""


WORKS = """works AS (
  SELECT 'W' || vec_id AS work_id, 'type' || (vec_id % 3) AS type, label, (label + 1 + vec_id % 9) % 10 AS second, embedding::DOUBLE[] AS vector,
    concat('0x', substr(sha256('42:W' || vec_id), 1, 8))::BIGINT / 4294967296.0 AS bucket FROM embeddings),
parted AS (SELECT *, CASE WHEN bucket < 0.6 THEN 'train' WHEN bucket < 0.8 THEN 'calibration' ELSE 'test' END AS partition FROM works)"""


def _centroids(level: str, divisor: int) -> str:
    return f"""c_{level} AS (
  SELECT option, list(m ORDER BY pos) AS s FROM (
    SELECT label // {divisor} AS option, pos, sum(v) AS m FROM (SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM parted WHERE partition = 'train') GROUP BY 1, 2) GROUP BY 1),
n_{level} AS (SELECT option, list_transform(s, lambda q: q / sqrt(list_dot_product(s, s))) AS centroid FROM c_{level})"""


def _probabilities(level: str, divisor: int, asked: str) -> str:
    """``asked``: a relation with work_id, vector, option."""
    return f"""l_{level} AS (SELECT work_id, o.option, 10 * list_dot_product(vector, centroid) AS logit FROM {asked} o JOIN n_{level} USING (option)),
p_{level} AS (
  SELECT work_id, option::VARCHAR AS option, exp(logit - max(logit) OVER (PARTITION BY work_id)) AS w FROM l_{level}),
r_{level} AS (
  SELECT work_id, option, w / sum(w) OVER (PARTITION BY work_id) AS p FROM p_{level})"""


FLAT = f"""WITH {WORKS}, {_centroids("subfield", 1)},
asked AS (SELECT work_id, vector, option FROM parted, (SELECT unnest(range(10)) AS option) WHERE partition <> 'train'),
{_probabilities("subfield", 1, "asked")},
top AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY round(p, 9) DESC, option) AS place FROM r_subfield),
flat AS (
  SELECT work_id, max(option) FILTER (place = 1) AS prediction, max(p) FILTER (place = 1) AS confidence, string_agg(option, ',' ORDER BY place) FILTER (place <= 3) AS candidates FROM top GROUP BY 1),
labelled AS (
  SELECT work_id, partition, type, prediction, confidence, candidates, label::VARCHAR AS true_primary,
    array_to_string(list_sort(list_distinct([label::VARCHAR, second::VARCHAR])), ',') AS true_any_topic,
    prediction = label::VARCHAR AS correct_primary, prediction IN (label::VARCHAR, second::VARCHAR) AS correct_any_topic,
    list_contains(string_split(candidates, ','), label::VARCHAR) AS primary_in_top3_predictions
  FROM flat JOIN parted USING (work_id)),
rounded AS (SELECT * REPLACE (round(confidence, 2) AS confidence) FROM labelled)"""

Z = "1.959963984540054"


def _wilson(s: str, n: str, sign: str) -> str:
    p = f"({s} / {n}::DOUBLE)"
    scale = f"(1 + {Z} * {Z} / {n})"
    centre = f"(({p} + {Z} * {Z} / (2 * {n})) / {scale})"
    radius = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n}::DOUBLE)) / {scale})"
    return f"greatest(0.0, {centre} - {radius})" if sign == "-" else f"least(1.0, {centre} + {radius})"


def _curve(reference: str) -> str:
    return f"""
  SELECT '{reference}' AS reference, threshold, sum(rows) OVER w AS accepted, sum(hits) OVER w AS correct FROM (
    SELECT confidence AS threshold, count(*) AS rows, count(*) FILTER (correct_{reference}) AS hits FROM rounded WHERE partition = 'calibration' GROUP BY 1)
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)"""


CURVES = f"""curves AS ({_curve("primary")} UNION ALL {_curve("any_topic")}),
cuts AS (SELECT *, correct / accepted::DOUBLE AS precision, {_wilson("correct", "accepted", "-")} AS low, {_wilson("correct", "accepted", "+")} AS high FROM curves)"""


def _fitted(target: float, minimum: int = 10) -> str:
    return f"""
  SELECT r.reference, {target}::DOUBLE AS target, b.threshold, coalesce(b.accepted, 0)::BIGINT AS accepted, coalesce(b.correct, 0)::BIGINT AS correct, b.precision, b.low, b.high,
    coalesce(b.accepted / (SELECT count(*) FROM rounded WHERE partition = 'calibration')::DOUBLE, 0.0) AS coverage
  FROM (SELECT unnest(['primary', 'any_topic']) AS reference) r LEFT JOIN (
    SELECT * FROM cuts WHERE accepted >= {minimum} AND low >= {target} QUALIFY row_number() OVER (PARTITION BY reference ORDER BY accepted DESC) = 1) b USING (reference)"""


def _measured(by: str) -> str:
    return f"""{FLAT}, {CURVES}, fitted AS ({_fitted(0.3)}),
test AS (
  SELECT f.reference, f.threshold, t.*, CASE WHEN f.reference = 'primary' THEN correct_primary ELSE correct_any_topic END AS hit, coalesce(confidence >= f.threshold, false) AS taken
  FROM rounded t, fitted f WHERE partition = 'test'),
measured AS (
  SELECT reference, threshold{by}, count(*) AS total, count(*) FILTER (taken) AS accepted, count(*) FILTER (taken AND hit) AS correct, avg(hit::INT::DOUBLE) AS accuracy FROM test GROUP BY ALL)"""


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = f"""docs AS (SELECT lang AS sink, 'D' || doc_id AS work_id, source AS cluster, text FROM documents),
words AS (SELECT sink, work_id, cluster, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda v: NOT list_contains([{STOPS}], v)) AS ws FROM docs),
terms AS (
  SELECT sink, work_id, cluster, unnest(ws) AS term FROM words
  UNION ALL SELECT sink, work_id, cluster, ws[i] || ' ' || ws[i + 1] FROM words, LATERAL (SELECT unnest(range(1, len(ws))) AS i)),
tfs AS (SELECT sink, work_id, cluster, term, count(*) AS tf FROM terms GROUP BY ALL),
vocabulary AS (
  SELECT t.sink, term, count(*) AS df, sum(tf)::BIGINT AS cf, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf
  FROM tfs t JOIN (SELECT sink, count(*) AS n FROM docs GROUP BY 1) USING (sink) GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n)
  QUALIFY row_number() OVER (PARTITION BY t.sink ORDER BY sum(tf) DESC, term) <= 10000)"""

VECTORS = """v AS (SELECT 'L' || label AS cluster, 'W' || vec_id AS work_id, list_transform(embedding::DOUBLE[], lambda q: q / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vector FROM embeddings),
flatv AS (SELECT cluster, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM v),
sums AS (SELECT cluster, max(n) AS n, list(s ORDER BY pos) AS s FROM (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM flatv GROUP BY 1, 2) GROUP BY 1),
coherent AS (SELECT cluster, n, CASE WHEN n >= 2 THEN greatest(-1.0, least(1.0, (list_dot_product(s, s) - n) / (n * (n - 1)))) END AS coherence FROM sums)"""

META = """meta AS (
  SELECT 'P' || p_partkey AS work_id, p_partkey AS n, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS title,
    CASE WHEN p_partkey % 5 = 0 AND p_size % 2 = 0 THEN '' ELSE p_brand END AS source, p_type AS type,
    CASE WHEN p_partkey % 5 = 0 THEN [' '] ELSE string_split(concat_ws(' ', p_name, p_type), ' ') END AS keywords FROM part)"""

FAMILY = """records AS (SELECT 'D' || doc_id AS id, concat_ws('-', source, n_chars) AS source_key, array_to_string(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS title_key FROM documents),
keys AS (
  SELECT id, 'source' AS kind, source_key AS key FROM records WHERE source_key <> '' UNION ALL SELECT id, 'title', title_key FROM records WHERE title_key <> '')"""

COMPONENTS = f"""WITH RECURSIVE {FAMILY},
edges AS (SELECT DISTINCT a.id AS u, b.id AS v FROM keys a JOIN keys b ON a.kind = b.kind AND a.key = b.key),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
family AS (SELECT id, least(id, coalesce((SELECT min(v) FROM reach WHERE u = id), id)) AS family FROM records)"""

ORACLE: dict[str, str] = {
    "coverage_by_year": """
WITH a AS (SELECT year(o_orderdate)::BIGINT AS publication_year, count(*) AS unassigned_works FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT year(o_orderdate)::BIGINT AS publication_year, count(*) AS total_works FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT publication_year, unassigned_works, total_works FROM a LEFT JOIN b USING (publication_year)""",
    "coverage_by_source": "SELECT event_type AS type, user_id AS source_id, count(*) AS unassigned_works FROM events GROUP BY 1, 2 HAVING count(*) >= 5",
    "topic_dims": f"""WITH {MEMBERS}, {TOPICS}
SELECT DISTINCT 'subfield' AS level, split_part(subfield_id, '/', -1) AS id, subfield_name AS name, split_part(field_id, '/', -1) AS parent_id FROM topics
UNION ALL SELECT DISTINCT 'field', split_part(field_id, '/', -1), field_name, split_part(domain_id, '/', -1) FROM topics
UNION ALL SELECT DISTINCT 'domain', split_part(domain_id, '/', -1), domain_name, NULL FROM topics""",
    "hierarchy_fd_violations": f"""WITH {MEMBERS}, {TOPICS}, t AS (SELECT * REPLACE ('f/' || c_mktsegment AS field_id, c_mktsegment AS field_name) FROM topics),
rows AS (
  SELECT 'subfield' AS level, subfield_id AS id, subfield_name || '#' || field_id || '|' || domain_id AS identity FROM t
  UNION ALL SELECT 'field', field_id, field_name || '#' || domain_id FROM t UNION ALL SELECT 'domain', domain_id, domain_name FROM t)
SELECT level, id, count(DISTINCT identity) AS versions FROM rows GROUP BY 1, 2 HAVING count(DISTINCT identity) > 1""",
    "topic_violations": """SELECT reason, count(*) AS topics FROM (
  SELECT unnest(list_concat(CASE WHEN c_custkey % 11 = 0 THEN ['topic id'] ELSE [] END, CASE WHEN c_custkey % 7 = 0 THEN ['display name'] ELSE [] END)) AS reason FROM customer) GROUP BY 1""",
    "duplicate_topics": f"WITH {MEMBERS}, {TOPICS} SELECT topic_id, 2::BIGINT AS rows FROM topics WHERE works_count > 15",
    "topic_csv_projection": f"""WITH {MEMBERS}, {TOPICS}
SELECT split_part(topic_id, '/', -1) AS topic_id, topic, split_part(subfield_id, '/', -1) AS subfield_id, subfield_name AS subfield, split_part(field_id, '/', -1) AS field_id, field_name AS field,
  split_part(domain_id, '/', -1) AS domain_id, domain_name AS domain, works_count, keyword_count FROM topics""",
    "keyword_memberships": f"WITH {MEMBERS} SELECT topic_id, keyword FROM members",
    "keyword_overlap": f"WITH {MEMBERS} SELECT a.topic_id AS src, b.topic_id AS dst, count(*) AS shared FROM members a JOIN members b ON a.keyword = b.keyword AND a.topic_id <> b.topic_id GROUP BY 1, 2",
    "keyword_overlap_counts": f"""WITH {MEMBERS}, pairs AS (SELECT a.topic_id AS src, b.topic_id AS dst, count(*) AS shared FROM members a JOIN members b ON a.keyword = b.keyword AND a.topic_id <> b.topic_id GROUP BY 1, 2)
SELECT shared, count(*) AS pairs FROM pairs GROUP BY 1""",
    "jaccard_topk": f"""{AUDIT}
SELECT src, dst, shared, all_keywords, round(similarity, 9) AS similarity, place,
  (SELECT string_agg(keyword, '; ' ORDER BY keyword) FROM (SELECT a.keyword FROM members a JOIN members b ON a.keyword = b.keyword WHERE a.topic_id = src AND b.topic_id = dst)) AS shared_keywords FROM near""",
    "parent_shares": f"""{AUDIT}, shares AS ({" UNION ALL ".join(f"SELECT * FROM ({_shares(v)})" for v in ("subfield", "field", "domain"))})
SELECT level, topic_id, parent_id, round(share, 9) AS share, count, own, place FROM shares""",
    "plurality_parent": f"""{_assessed("subfield")} SELECT topic_id, plurality_id, round(plurality_share, 9) AS plurality_share, plurality_count, round(stated_share, 9) AS stated_share FROM base""",
    **{f"audit_{v}": f"{_assessed(v)} SELECT * FROM ranked" for v in ("subfield", "field", "domain")},
    "audit_summary": f"""{_assessed("subfield")} SELECT s.status, count(r.status) AS topics FROM (SELECT unnest(['review', 'consistent', 'insufficient_evidence']) AS status) s LEFT JOIN ranked r USING (status) GROUP BY 1""",
    "audit_top50": f"""{_assessed("subfield")} SELECT rank, topic_id, status, score, stated_id, plurality_id FROM ranked WHERE rank <= 50""",
    "oversized_topics": f"""WITH {MEMBERS}, {TOPICS}, m AS (SELECT median(works_count)::DOUBLE AS median_topic_works FROM topics)
SELECT topic_id, works_count, median_topic_works FROM topics, m WHERE works_count > 1.6 * median_topic_works""",
    "seeded_sample": "SELECT 'O' || o_orderkey AS id, o_totalprice FROM orders ORDER BY sha256('42:O' || o_orderkey), 1 LIMIT 100",
    "sink_samples": "SELECT 'W' || vec_id AS work_id, 'T' || label AS sink_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256('42:W' || vec_id), 'W' || vec_id) <= 20",
    "feature_text": f"""WITH {META} SELECT work_id, 'Title: ' || substr(title, 1, 2000) || chr(10) || 'Source: ' || substr(source, 1, 300) || chr(10) || 'Type: ' || substr(type, 1, 100) || chr(10) || 'Keywords: ' ||
  array_to_string(list_transform(keywords[:20], lambda k: substr(k, 1, 100)), '; ') AS text FROM meta""",
    "split_text": f"WITH {META} SELECT work_id, substr(title, 1, 2000) || ' ' || array_to_string(list_transform(keywords[:20], lambda k: substr(k, 1, 100)), ' ') AS text FROM meta",
    "insufficient_metadata": f"WITH {META} SELECT work_id FROM meta WHERE trim(title) = '' AND trim(source) = '' AND len(list_filter(keywords, lambda k: trim(k) <> '')) = 0",
    "title_key": r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(concat_ws(' / ', p_name, p_type)), '[\p{L}\p{N}_]+'), ' ') AS title_key FROM part",
    "family_components": f"{COMPONENTS} SELECT id, family FROM family",
    "hash_partition": f"""{COMPONENTS}, h AS (SELECT id, sha256('42:' || family) AS split_group FROM family), b AS (SELECT *, concat('0x', substr(split_group, 1, 8))::BIGINT / 4294967296.0 AS bucket FROM h)
SELECT id, CASE WHEN bucket < 0.6 THEN 'train' WHEN bucket < 0.8 THEN 'calibration' ELSE 'test' END AS partition, split_group FROM b""",
    "partition_counts": f"WITH {WORKS} SELECT partition, count(*) AS works, count(DISTINCT label) AS labels FROM parted GROUP BY 1",
    "partition_leakage": f"""WITH {FAMILY}, h AS (SELECT id, sha256('42:' || id) AS d FROM records),
p AS (SELECT id, concat('0x', substr(d, 1, 8))::BIGINT / 4294967296.0 AS b FROM h),
q AS (SELECT id, CASE WHEN b < 0.6 THEN 'train' WHEN b < 0.8 THEN 'calibration' ELSE 'test' END AS partition FROM p)
SELECT kind, key, count(DISTINCT partition) AS partitions FROM keys JOIN q USING (id) GROUP BY 1, 2 HAVING count(DISTINCT partition) > 1""",
    "referential_misses": f"WITH {WORKS}, t AS (SELECT work_id, unnest([label, second]) AS l FROM works) SELECT work_id, 'T' || l AS topic_id FROM t WHERE l = 7",
    "foreign_sink_samples": f"WITH {WORKS} SELECT 'T3' AS sink_id, work_id FROM works WHERE label <> 3 AND second <> 3",
    "record_violations": f"""WITH {META}, r AS (SELECT unnest(list_concat(CASE WHEN n % 13 = 0 THEN ['id'] ELSE [] END, CASE WHEN n % 17 = 0 THEN ['title'] ELSE [] END)) AS reason FROM meta) SELECT reason, count(*) AS records FROM r GROUP BY 1""",
    "class_centroids": f"""WITH {WORKS}, u AS (SELECT 'T' || label AS primary_topic_id, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS pos FROM parted WHERE partition = 'train')
SELECT primary_topic_id, count(*) AS n, pos::BIGINT AS pos, round(sum(v) / count(*), 6) AS mean FROM u GROUP BY 1, 3""",
    "flat_predictions": f"{FLAT} SELECT work_id, prediction, round(confidence, 6) AS confidence, candidates FROM flat",
    "hierarchical_predictions": f"""WITH {WORKS}, {_centroids("domain", 4)}, {_centroids("field", 2)}, {_centroids("subfield", 1)},
a_domain AS (SELECT work_id, vector, option FROM parted, (SELECT unnest(range(3)) AS option) WHERE partition <> 'train'),
{_probabilities("domain", 4, "a_domain")},
b_domain AS (SELECT work_id, option::INT AS d, p AS pd FROM r_domain QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY round(p, 9) DESC, option) = 1),
a_field AS (SELECT work_id, vector, option FROM parted JOIN b_domain USING (work_id) JOIN (SELECT unnest(range(5)) AS option) ON option // 2 = d),
{_probabilities("field", 2, "a_field")},
b_field AS (SELECT work_id, option::INT AS f, p AS pf FROM r_field QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY round(p, 9) DESC, option) = 1),
a_subfield AS (SELECT work_id, vector, option FROM parted JOIN b_field USING (work_id) JOIN (SELECT unnest(range(10)) AS option) ON option // 2 = f),
{_probabilities("subfield", 1, "a_subfield")},
top AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY round(p * pd * pf, 9) DESC, option) AS place FROM r_subfield JOIN b_domain USING (work_id) JOIN b_field USING (work_id))
SELECT work_id, max(option) FILTER (place = 1) AS prediction, round(max(p * pd * pf) FILTER (place = 1), 6) AS confidence,
  any_value(d) || '>' || any_value(f) || '>' || max(option) FILTER (place = 1) AS route, string_agg(option, ',' ORDER BY place) FILTER (place <= 3) AS candidates FROM top GROUP BY 1""",
    "labelled_predictions": f"{FLAT} SELECT work_id, partition, prediction, true_primary, true_any_topic, correct_primary, correct_any_topic, primary_in_top3_predictions FROM labelled",
    "threshold_curve": f"{FLAT}, {CURVES} SELECT threshold, accepted::BIGINT AS accepted, correct::BIGINT AS correct, round(precision, 6) AS precision, round(low, 6) AS low, round(high, 6) AS high FROM cuts WHERE reference = 'primary'",
    "fitted_threshold": f"""{FLAT}, {CURVES}, fitted AS ({_fitted(0.3)} UNION ALL {_fitted(0.9)})
SELECT reference, target, threshold, accepted, correct, round(precision, 6) AS precision, round(low, 6) AS precision_low, round(high, 6) AS precision_high, round(coverage, 6) AS coverage FROM fitted""",
    "selective_metrics": f"""{_measured("")}
SELECT reference, threshold, total, accepted, correct, round(accepted / total::DOUBLE, 6) AS coverage, CASE WHEN accepted > 0 THEN round(correct / accepted::DOUBLE, 6) END AS precision,
  CASE WHEN accepted > 0 THEN round({_wilson("correct", "accepted", "-")}, 6) END AS precision_low, CASE WHEN accepted > 0 THEN round({_wilson("correct", "accepted", "+")}, 6) END AS precision_high, round(accuracy, 6) AS unthresholded_accuracy,
  CASE WHEN threshold IS NULL THEN 'abstain_all' WHEN accepted = 0 THEN 'no_test_acceptances' WHEN correct / accepted::DOUBLE >= 0.3 THEN 'target_met_on_test' ELSE 'target_not_met_on_test' END AS status FROM measured""",
    "metrics_by_type": f"""{_measured(", type")}
SELECT reference, type, total, accepted, correct, round(accepted / total::DOUBLE, 6) AS coverage, CASE WHEN accepted > 0 THEN round(correct / accepted::DOUBLE, 6) END AS precision FROM measured""",
    "metrics_by_level": f"""{_measured("")}, sets AS (
  SELECT reference, threshold, type, grouping(type) = 1 AS whole, count(*) AS total, count(*) FILTER (taken) AS accepted, count(*) FILTER (taken AND hit) AS correct, avg(hit::INT::DOUBLE) AS accuracy
  FROM test GROUP BY GROUPING SETS ((reference, threshold), (reference, threshold, type)))
SELECT reference, type, whole, total, accepted, correct, round(accepted / total::DOUBLE, 6) AS coverage, CASE WHEN accepted > 0 THEN round(correct / accepted::DOUBLE, 6) END AS precision, round(accuracy, 6) AS unthresholded_accuracy,
  CASE WHEN threshold IS NULL THEN 'abstain_all' WHEN accepted = 0 THEN 'no_test_acceptances' WHEN correct / accepted::DOUBLE >= 0.3 THEN 'target_met_on_test' ELSE 'target_not_met_on_test' END AS status FROM sets""",
    "lloyd_step": """WITH e AS (SELECT 'W' || vec_id AS work_id, label, embedding::DOUBLE[] AS raw FROM embeddings),
v AS (SELECT work_id, label, list_transform(raw, lambda q: q / sqrt(list_dot_product(raw, raw))) AS vec FROM e),
m AS (SELECT label, list(s ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS s FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY 1, 2) GROUP BY 1)
SELECT work_id, arg_min(m.label, list_dot_product(c, c) - 2 * list_dot_product(vec, c))::INTEGER AS cluster FROM v, m GROUP BY 1""",
    "label_texts": """SELECT p_partkey, translate(p_partkey || ': (' || p_brand || ') [' || p_type || '], ' || p_name, '()[]', ',') AS label FROM part""",
    "exact_sums": """SELECT l_suppkey, sum(round(l_extendedprice * 100)::HUGEINT * 128 + (1 << (7 - l_linenumber)::INT))::VARCHAR AS parts FROM lineitem GROUP BY 1""",
    "calibrated_status": f"""{FLAT}, {CURVES}, fitted AS ({_fitted(0.3)})
SELECT CASE WHEN confidence >= threshold THEN 'accepted' ELSE 'abstain' END AS status, count(*) AS works FROM rounded, fitted WHERE partition = 'test' AND reference = 'any_topic' GROUP BY 1""",
    "width_probe_accuracy": f"""WITH {WORKS}, {_centroids("domain", 4)}, {_centroids("field", 2)}, {_centroids("subfield", 1)},
first AS (SELECT * FROM parted WHERE partition = 'calibration' ORDER BY work_id LIMIT 12),
a AS (SELECT 'domain' AS level, 4 AS div, 3 AS options, work_id, label, second, option, list_dot_product(vector, centroid) AS cosine FROM first, n_domain
  UNION ALL SELECT 'field', 2, 5, work_id, label, second, option, list_dot_product(vector, centroid) FROM first, n_field
  UNION ALL SELECT 'subfield', 1, 10, work_id, label, second, option, list_dot_product(vector, centroid) FROM first, n_subfield),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY level, work_id ORDER BY round(cosine, 9) DESC, option::VARCHAR) = 1)
SELECT level, any_value(options)::BIGINT AS option_count, count(*) AS evaluated, round(avg((option = label // div)::INT::DOUBLE), 6) AS primary_accuracy,
  round(avg((option = label // div OR option = second // div)::INT::DOUBLE), 6) AS any_topic_accuracy FROM b GROUP BY 1""",
    "training_export": f"""WITH {WORKS}, first AS (SELECT *, sha256(work_id) AS digest FROM parted WHERE partition = 'train' ORDER BY sha256(work_id), work_id LIMIT 128)
SELECT work_id AS id, 'Type: ' || type AS state, digest, '0=domain 0,1=domain 1,2=domain 2|' || (label // 4) AS domain,
  (SELECT string_agg(o || '=field ' || o, ',' ORDER BY o::VARCHAR) FROM (SELECT unnest(range(5)) AS o) WHERE o // 2 = label // 4) || '|' || (label // 2) AS field,
  (SELECT string_agg(o || '=subfield ' || o, ',' ORDER BY o::VARCHAR) FROM (SELECT unnest(range(10)) AS o) WHERE o // 2 = label // 2) || '|' || label AS subfield FROM first""",
    "probability_contract": f"WITH {WORKS} SELECT work_id, 10::BIGINT AS options, 1.0::DOUBLE AS total FROM parted WHERE partition = 'test'",
    "cache_misses": """WITH k AS (SELECT p_type, p_brand, min(p_size) AS least FROM part GROUP BY 1, 2)
SELECT sha256('centroid' || chr(10) || p_type || chr(10) || p_brand) AS key, p_type, p_brand FROM k WHERE least > 25""",
    "tfidf_terms": f"WITH {TERMS} SELECT sink, term, df, cf, round(idf, 6) AS idf FROM vocabulary",
    "cluster_top_terms": f"""WITH {TERMS},
w AS (SELECT t.sink, work_id, cluster, term, (1 + ln(tf)) * idf AS w FROM tfs t JOIN vocabulary USING (sink, term)),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY sink, work_id)) AS weight FROM w),
m AS (SELECT sink, cluster, term, sum(weight) / any_value(n) AS mean FROM u JOIN (SELECT sink, cluster, count(*) AS n FROM docs GROUP BY 1, 2) USING (sink, cluster) GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY sink, cluster ORDER BY round(mean, 6) DESC, term) AS place FROM m)
SELECT sink, cluster, place, round(mean, 5) AS mean FROM p WHERE place <= 8""",
    "cluster_coherence": f"WITH {VECTORS} SELECT 'all' AS sink, cluster, n, round(coherence, 6) AS coherence FROM coherent",
    "sink_coherence": f"""WITH {VECTORS}, whole AS (SELECT list(s ORDER BY pos) AS s FROM (SELECT pos, sum(x) AS s FROM flatv GROUP BY 1))
SELECT 'all' AS sink, round(sum(coherence * n * (n - 1)) / sum(n * (n - 1)), 6) AS coherence,
  (SELECT round((list_dot_product(s, s) - (SELECT count(*) FROM v)) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) FROM whole) AS baseline FROM coherent""",
    "cosine_silhouette": f"""WITH {VECTORS},
d AS (SELECT work_id, v.cluster, s.cluster AS other, n, list_dot_product(vector, s) AS d FROM v, sums s),
m AS (SELECT work_id, max(CASE WHEN other = cluster AND n > 1 THEN 1 - (d - 1) / (n - 1) END) AS a, min(CASE WHEN other <> cluster THEN 1 - d / n END) AS b FROM d GROUP BY 1)
SELECT 'all' AS sink, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""",
    "cluster_representatives": f"""WITH {VECTORS}, c AS (SELECT cluster, work_id, list_dot_product(vector, s) / sqrt(list_dot_product(s, s)) AS cosine FROM v JOIN sums USING (cluster)),
p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(cosine, 9) DESC, work_id) AS place FROM c)
SELECT cluster, work_id, round(cosine, 6) AS cosine, place FROM p WHERE place <= 5""",
    "review_cover_check": f"""WITH {MEMBERS}, {TOPICS}, r AS (SELECT topic_id, row_number() OVER (ORDER BY works_count DESC, topic_id) AS n FROM topics QUALIFY n <= 60)
SELECT topic_id, 'not reviewed' AS reason FROM r WHERE n <= 5 UNION ALL SELECT topic_id, 'not in the top' FROM r WHERE n > 50
UNION ALL SELECT topic_id, CASE WHEN n % 20 = 0 THEN 'unknown judgment' ELSE 'no reason' END FROM r WHERE n > 5 AND (n % 20 = 0 OR n % 25 = 0)""",
    "judgment_counts": "SELECT ['placement_candidate', 'plausible_placement', 'unresolved'][c_custkey % 3 + 1] AS judgment, count(*) AS topics FROM customer GROUP BY 1",
}
ORACLE["keyword_overlap_salted"] = ORACLE["keyword_overlap"]
