"""SQL of the queries in ``pipeline``, in the dialect of DuckDB."""

from __future__ import annotations

from corpuscle.plans.pipeline import FIRST, PROMPT, SECOND, STATUSES
from corpuscle.plans.reference import K
from corpuscle.plans.reference_sql import (
    _FIELDS, _HASH, _PREFIX_KEYS, BM25, CORPUS, DOCS, KNOWN, LONG, MEAN, OUT, PAPERS, VALID, VECTORS, VEDGES, _labelled, cosines, gnn, lexical,
    metric_ctes, plain_id, tokens, top,
)
from corpuscle.plans.reference_sql import SQL as REFERENCE

P = "p AS (SELECT * FROM d WHERE source_type = 'paper')"
ISSUES = "i AS (SELECT DISTINCT ON (issue_key) * FROM issues_df ORDER BY issue_key)"
PAPER_IDS = f"{P}, pid AS (SELECT *, CAST(id AS BIGINT) AS corpusid, CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS VARCHAR) AS pno FROM p)"
CITED = f"""ct AS (SELECT corpusid, pno, unnest(explicit_related_ids) AS entry, generate_subscripts(explicit_related_ids, 1) AS pos FROM pid),
cr AS (SELECT a.corpusid, string_agg(b.pno, ' ' ORDER BY pos) AS related FROM ct a JOIN pid b ON b.corpusid = try_cast({plain_id('a.entry')} AS BIGINT) GROUP BY ALL)"""
QUERY_IDS = f"""gold AS (SELECT query_id AS id, list_sort(list(DISTINCT try_cast(candidate_id AS BIGINT)) FILTER (try_cast(candidate_id AS BIGINT) IS NOT NULL)) AS corpusids FROM long WHERE relation_type = 'corpusid_match' GROUP BY ALL),
qd AS (SELECT d.*, corpusids, CAST(1000000 + row_number() OVER (ORDER BY source_dataset, doc_id) AS VARCHAR) AS qno FROM d JOIN gold USING (id) WHERE source_type = 'query'),
gp AS (SELECT doc_id, unnest(corpusids) AS corpusid, generate_subscripts(corpusids, 1) AS pos FROM qd),
gr AS (SELECT gp.doc_id, string_agg(pno, ' ' ORDER BY pos) AS candidates FROM gp JOIN pid USING (corpusid) GROUP BY ALL)"""


def empty(c: str) -> str:
    return f"coalesce({c}, '')"


_prompt = "'" + PROMPT.replace("'", "''") + "'"
for _n, _v in (("title", empty("title")), ("abstract", empty("main_text")), ("affiliations", "coalesce(array_to_string(organizations, ';'), '')"), ("topics", "coalesce(array_to_string(topics, ';'), '')")):
    _prompt = f"replace({_prompt}, '{{{_n}}}', {_v})"
CHUNKED = f"{P}, mc AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 40 AS BIGINT) AS chunk FROM p), mb AS (SELECT chunk, count(*) AS n, [{', '.join(repr(s) for s in STATUSES)}][chunk % {len(STATUSES)} + 1] AS status FROM mc GROUP BY chunk)"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'comparison')"
_parts = ", ".join(f"'{c}: ' || {empty(c)}" for c in ("lang", "source", "source_type", "native_id", "source_dataset"))
WRAP = f"list_reduce([{_parts}], lambda s, x: s || CASE WHEN length(string_split(s, chr(10))[-1]) + 3 + length(x) <= 70 THEN ' | ' ELSE chr(10) END || x)"
HI = "coalesce(hierarchical, '{}')"
_object = f"json_type({HI}) = 'OBJECT'"


def _hierarchy(path: str) -> str:
    return f"CASE WHEN k < 4 AND {_object} THEN json_extract_string({HI}, '$.{path}') END"


_explicit = f"""ee AS (SELECT a.doc_id AS src, b.doc_id AS dst, CASE WHEN a.source_type = 'paper' THEN 'citation' ELSE 'linked_issue' END AS relation, CAST(count(*) AS DOUBLE) AS weight, a.source_type AS part
FROM (SELECT doc_id, source_type, {plain_id('entry')} AS id FROM (SELECT doc_id, source_type, unnest(explicit_related_ids) AS entry FROM d WHERE source_type IN ('paper', 'github_issue'))) a
JOIN d b USING (id) WHERE a.doc_id <> b.doc_id AND a.source_type = b.source_type AND a.doc_id IN (SELECT doc_id FROM node) AND b.doc_id IN (SELECT doc_id FROM node) GROUP BY ALL)"""


def _shared(keys: str, weight: float, x: str) -> str:
    """CTE ``e{x}`` of shared-value edges with their part, after DOCS and VALID."""
    return f"""k{x} AS (SELECT DISTINCT * FROM ({keys})), ok{x} AS (SELECT relation, value, part FROM k{x} GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
kk{x} AS (SELECT k{x}.* FROM k{x} JOIN ok{x} o ON k{x}.relation = o.relation AND k{x}.value IS NOT DISTINCT FROM o.value AND k{x}.part = o.part),
e{x} AS (SELECT a.doc_id AS src, b.doc_id AS dst, a.relation, CAST(count(*) * {weight} AS DOUBLE) AS weight, a.part FROM kk{x} a JOIN kk{x} b ON a.relation = b.relation AND a.value = b.value AND a.part = b.part
  WHERE a.doc_id <> b.doc_id AND a.doc_id IN (SELECT doc_id FROM node) AND b.doc_id IN (SELECT doc_id FROM node) GROUP BY a.doc_id, b.doc_id, a.relation, a.part)"""


GRAPH = f"{VALID}, {_explicit}, {_shared(_FIELDS, 0.5, 'f')}, {_shared(_PREFIX_KEYS, 0.75, 'h')}, e AS (SELECT * FROM ee UNION ALL SELECT * FROM ef UNION ALL SELECT * FROM eh)"
SAGE_DOCS = f"""WITH {CORPUS}, s AS (SELECT * FROM c WHERE coalesce(is_candidate, true) AND source_type IN ('paper', 'github_issue')), {GRAPH},
{lexical({'labelled': '1.0'}, 's', 2 * K, {'labelled': 1.0}, 'x')},
seed AS (SELECT x0.query_id, x0.doc_id, x0.score, s.source_type AS part FROM x0 JOIN s USING (doc_id)),
inc AS (SELECT * FROM (SELECT src AS doc_id, dst AS near, weight, part FROM e UNION ALL SELECT dst, src, weight, part FROM e) WHERE near IN (SELECT doc_id FROM s)),
tot AS (SELECT doc_id, part, sum(weight) + 1e-10 AS total FROM inc GROUP BY ALL),
add AS (SELECT s.query_id, i.near AS doc_id, 0.15 * s.score * (i.weight / total) * greatest(0, coalesce(n.score, 1)) AS score
  FROM seed s JOIN inc i USING (doc_id, part) JOIN tot USING (doc_id, part) LEFT JOIN seed n ON n.query_id = s.query_id AND n.doc_id = i.near AND n.part = s.part),
fin AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM (SELECT query_id, doc_id, score FROM seed UNION ALL SELECT * FROM add) GROUP BY ALL),
{top('fin', K)} {OUT}"""


def _attention(name: str, source: str, a_to: float, a_of: float) -> str:
    """CTE ``name`` (query_id, doc_id, m): one attention layer over numbers x of ``source``."""
    return f"""{name}s AS (SELECT query_id, doc_id, x AS sent FROM {source} UNION ALL SELECT f.query_id, e.dst, f.x FROM {source} f JOIN e ON e.src = f.doc_id),
{name}e AS (SELECT s.query_id, s.doc_id, sent, CASE WHEN {a_to!r} * f.x + {a_of!r} * sent > 0 THEN {a_to!r} * f.x + {a_of!r} * sent ELSE 0.2 * ({a_to!r} * f.x + {a_of!r} * sent) END AS z FROM {name}s s JOIN {source} f USING (query_id, doc_id)),
{name}m AS (SELECT query_id, doc_id, max(z) AS top FROM {name}e GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, sum(exp(z - top) * sent) / sum(exp(z - top)) AS m FROM {name}e JOIN {name}m USING (query_id, doc_id) GROUP BY ALL)"""


_to, _of = (sum(w * v for w, v in zip(FIRST["weight"], FIRST[k])) for k in ("to", "of"))
_hidden = " + ".join(f"CASE WHEN {w!r} * m > 0 THEN {w!r} * m ELSE 0.01 * ({w!r} * m) END * {u!r}" for w, u in zip(FIRST["weight"], SECOND["weight"]))
GAT = f"""WITH {VECTORS}, {cosines(True)}, {VEDGES}, f0 AS (SELECT query_id, doc_id, round(1 - score, 9) AS x FROM sc), {_attention('l1', 'f0', _to, _of)},
f1 AS (SELECT query_id, doc_id, {_hidden} AS x FROM l1), {_attention('l2', 'f1', SECOND['to'][0], SECOND['of'][0])},
fin AS (SELECT query_id, doc_id, round(-m, 9) AS score FROM l2), {top('fin', K)} {OUT}"""

DENSE_MEANS = f"""WITH {VECTORS}, {cosines(False)}, {top('sc', K + 1)},
known AS (SELECT q.doc_id AS query_id, v.doc_id FROM q JOIN v USING (label) WHERE q.doc_id <> v.doc_id), {metric_ctes()}, mean AS ({MEAN.format('m')})"""

SQL = {
    "source_issues": f"""WITH {ISSUES} SELECT CAST(issue_no AS VARCHAR) AS issue_no, repository || '#' || issue_no AS issue_key, issue_url, md5(issue_body) AS body_md5, repository, created_at, closed_at, coalesce(labels, '') AS labels FROM i""",
    "comment_assembly": f"""WITH {ISSUES} SELECT issue_key, md5({empty('comments')}) AS comments_md5, len(string_split({empty('comments')}, '|')) AS n_pieces, string_split({empty('comments')}, '|')[-1] AS last_piece FROM i""",
    "source_pulls": f"""WITH {ISSUES}, x AS (SELECT pull_url, arg_min(i.issue_key, i.issue_url) AS k FROM links l JOIN i ON i.issue_key = l.issue_key WHERE pull_url IS NOT NULL GROUP BY ALL)
SELECT pull_url, 'Pull of ' || k AS pull_title, string_split(k, '#')[1] AS repository FROM x""",
    "source_links": f"""WITH {ISSUES} SELECT i.issue_url, i.issue_key, pull_url, count(*) AS n FROM links l JOIN i ON i.issue_key = l.issue_key WHERE pull_url IS NOT NULL GROUP BY ALL""",
    "paper_documents": f"""WITH {DOCS}, {PAPER_IDS}, {CITED} SELECT pno AS id, CAST(corpusid AS VARCHAR) AS native_id, md5({empty('main_text')}) AS text_md5,
CAST(CASE WHEN length(secondary_texts[1]) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_secondary, coalesce(related, '') AS related, true AS is_candidate FROM pid LEFT JOIN cr USING (corpusid)""",
    "query_documents": f"""WITH {DOCS}, {LONG}, {PAPER_IDS}, {QUERY_IDS} SELECT qno AS id, source_dataset, md5({empty('main_text')}) AS text_md5, coalesce(json_extract_string(categorical, '$.specificity'), '') AS specificity,
coalesce(json_extract_string(categorical, '$.quality'), '') AS quality, false AS is_candidate FROM qd JOIN gr USING (doc_id)""",
    "query_qrels": f"WITH {DOCS}, {LONG}, {PAPER_IDS}, {QUERY_IDS} SELECT qno AS query_id, candidates, 'corpusid_match' AS relation_type FROM qd JOIN gr USING (doc_id)",
    "corpus_union": f"""WITH {DOCS}, {LONG}, {PAPER_IDS}, {QUERY_IDS}, {ISSUES} SELECT source_type, count(*) AS n, count(*) FILTER (is_candidate) AS n_candidates, CAST(sum(length({empty('t')})) AS BIGINT) AS n_chars FROM
(SELECT 'github_issue' AS source_type, true AS is_candidate, issue_body AS t FROM i UNION ALL SELECT 'paper', true, main_text FROM p UNION ALL SELECT 'query', false, main_text FROM qd JOIN gr USING (doc_id)) GROUP BY ALL""",
    "corpus_ids": f"WITH {DOCS} SELECT id AS value FROM d WHERE source_type = 'paper' AND id IS NOT NULL",
    "unprocessed_papers": f"""WITH {DOCS}, done AS (SELECT DISTINCT {plain_id('e')} AS id FROM (SELECT unnest(explicit_related_ids) AS e FROM d))
SELECT id, doc_id FROM d WHERE source_type = 'paper' AND id IS NOT NULL AND id NOT IN (SELECT id FROM done WHERE id IS NOT NULL) ORDER BY id LIMIT 100""",
    "jsonl_round_trip": f"""WITH {DOCS} SELECT id, md5(title) AS title_md5, md5({empty('main_text')}) AS text_md5, coalesce(len(people), 0) AS n_people, coalesce(hierarchical, '{{}}') AS hierarchical, is_queryable FROM d WHERE source_type = 'paper'""",
    "label_map_csv": "SELECT trim(raw_label) AS raw_label, arg_max(trim(normalized_path), line_no) AS normalized_path FROM label_mapping GROUP BY ALL",
    "graph_round_trip": REFERENCE["explicit_edges"],
    "results_round_trip": f"{DENSE_MEANS} SELECT 'dense' AS method, metric || coalesce('@' || k, '') || '_mean' AS metric, mean AS value FROM mean",
    "cache_append": f"WITH {DOCS} SELECT id, source_type, n_chars FROM d",
    "index_cache": f"""WITH {DOCS}, t AS (SELECT doc_id, {tokens("concat_ws(' ', nullif(title, ''), nullif(main_text, ''))")} AS ts FROM d) SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_terms FROM t""",
    "fetched_metadata": f"WITH {DOCS} SELECT id, 2 * CAST(id AS BIGINT) AS twice, true AS batch FROM d WHERE source_type = 'paper' AND coalesce(len(explicit_related_ids), 0) = 0",
    "environment_checks": "SELECT * FROM (VALUES ('numpy', true), ('pandas', true), ('pyarrow', true), ('pyspark', true), ('no_such_package', false), ('documents', true), ('qrels', true), ('no_such_table', false)) t(name, ok)",
    "paper_metadata": f"""WITH {DOCS}, {P}, x AS (SELECT *, coalesce(len(organizations), 0) > 0 AS listed FROM p) SELECT id, coalesce(array_to_string(people, '|'), '') AS people,
coalesce(array_to_string(CASE WHEN listed AND len(coalesce(people, [])) > 0 THEN list_sort(list_distinct(list_filter(organizations, lambda o: o IS NOT NULL))) WHEN listed THEN [] ELSE organizations END, '|'), '') AS organizations,
coalesce(array_to_string(topics, '|'), '') AS topics, json_extract_string(categorical, '$.venue_name') AS venue_name FROM x""",
    "hierarchy_repair": f"""WITH {DOCS}, {P}, x AS (SELECT *, length({empty('title')}) % 6 AS k FROM p WHERE id IS NOT NULL)
SELECT id, CASE WHEN k = 5 THEN 'missing_hierarchy_info' WHEN k = 4 THEN 'JSONDecodeError' ELSE {_hierarchy('errors[0]')} END AS errors, CASE WHEN k = 3 THEN 'm' END AS note_by,
{_hierarchy('field_of_study_path.field')} AS field_of_study_path_field, {_hierarchy('method_path.specific_method')} AS method_path_specific_method FROM x""",
    "enriched_counts": f"""WITH {DOCS}, {LONG}, {P}, c AS (SELECT * FROM p WHERE len(explicit_related_ids) > 0 ORDER BY {_HASH.format('id')}, id LIMIT 200),
q AS (SELECT relation_type FROM long UNION ALL SELECT 'citation' FROM (SELECT {plain_id('e')} AS e FROM (SELECT unnest(explicit_related_ids) AS e FROM c)) WHERE e IS NOT NULL)
SELECT relation_type, count(*) AS n, (SELECT count(*) FROM p) AS n_documents FROM q GROUP BY ALL""",
    "merged_maps": f"""WITH {DOCS} SELECT doc_id, len(list_distinct(list_concat(json_keys(coalesce(categorical, '{{}}')), ['journal', 'lang']))) AS n_keys, source_dataset AS journal, coalesce(lang, 'none') AS lang FROM d""",
    "relation_choices": f"""WITH {LONG} SELECT 'all' AS choice, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM long UNION ALL SELECT 'papers', count(*), count(DISTINCT query_id) FROM long WHERE relation_type IN ('citation', 'corpusid_match')
UNION ALL SELECT 'linked', count(*), count(DISTINCT query_id) FROM long WHERE relation_type = 'linked_issue'""",
    "training_queries": f"""WITH {DOCS}, {LONG}, k AS (SELECT query_id, bool_and(candidate_id IN (SELECT id FROM d WHERE id IS NOT NULL)) AS a, bool_or(candidate_id IN (SELECT id FROM d WHERE id IS NOT NULL)) AS o FROM long WHERE query_id IN (SELECT id FROM d) GROUP BY ALL)
SELECT query_id, true AS every FROM k WHERE a UNION ALL SELECT query_id, false FROM k WHERE o""",
    "babble_flags": f"""WITH {DOCS}, x AS (SELECT doc_id, source_type, main_text, contains({empty('main_text')}, '{{') AND contains({empty('main_text')}, '}}') AS o FROM d)
SELECT doc_id, source_type = 'paper' AND NOT o AS babble, o AS has_object FROM x""",
    "paper_requests": f"WITH {DOCS}, {P} SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS chunk, id, 'POST' AS method, 'mini' AS model, md5({_prompt}) AS input_md5 FROM p",
    "manifest_counts": f"""WITH {DOCS}, {CHUNKED} SELECT status, count(*) AS n, status IN ('validating', 'in_progress', 'finalizing') AS active, status IN ('completed', 'failed', 'cancelled', 'expired') AS finished,
(SELECT count(*) FROM mb) AS before, (SELECT count(*) FROM mb WHERE status <> 'failed') AS after FROM mb GROUP BY ALL""",
    "unsubmitted_papers": f"WITH {DOCS}, {CHUNKED} SELECT id FROM p JOIN mc USING (id) JOIN mb USING (chunk) WHERE status = 'failed' AND coalesce(len(topics), 0) > 0",
    "run_progress": f"""WITH {DOCS}, {CHUNKED}, g AS (SELECT chunk, row_number() OVER w AS done, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w AS failed, sum(CAST(n AS DOUBLE)) OVER w AS elapsed FROM mb WINDOW w AS (ORDER BY chunk))
SELECT chunk, done, CAST(failed AS BIGINT) AS failed, elapsed, round(elapsed / done * (1000 - done), 6) AS eta FROM g""",
    "batch_run": f"WITH {DOCS} SELECT id AS custom_id, md5({empty('title')}) AS answer FROM d WHERE source_type = 'paper'",
    "answer_texts": f"WITH {DOCS} SELECT doc_id, CASE WHEN source_type = 'paper' THEN title || chr(10) || {empty('lang')} ELSE title END AS answer FROM d WHERE title IS NOT NULL",
    "slugs": f"WITH {DOCS} SELECT doc_id, CASE WHEN length({SLUG}) > 80 THEN left({SLUG}, 70) || '-' || left(md5(title), 10) ELSE {SLUG} END AS slug, {WRAP} AS wrapped FROM d WHERE title IS NOT NULL",
    "metric_selection": f"{DENSE_MEANS} SELECT metric, k, mean, row_number() OVER (ORDER BY metric <> 'mrr', metric, k NULLS FIRST) AS place FROM mean WHERE metric = 'mrr' OR (metric IN ('ndcg', 'recall') AND k = 10)",
    "token_sample": f"""WITH {DOCS}, {P}, s AS (SELECT * FROM p ORDER BY {_HASH.format('id')}, id LIMIT 1000) SELECT count(*) AS n, round(avg(len({tokens("concat_ws(' ', nullif(title, ''), nullif(main_text, ''))")})), 6) AS avg_tokens FROM s""",
    "method_runs": f"""SELECT 'bm25' AS method, * FROM ({BM25}, {KNOWN}, {metric_ctes()} {MEAN.format('m')}) UNION ALL
SELECT 'dense_labels', * FROM (WITH {CORPUS}, {PAPERS}, {KNOWN}, {_labelled}, {metric_ctes('l')} {MEAN.format('m')})""",
    "config_block": "SELECT * FROM (VALUES ('baseline', 'bm25'), ('methods', '[''charm'', ''graph_sage'']'), ('ks', '[5, 10]'), ('sample', '100'), ('seed', '42'), ('trials', '20')) t(name, value)",
    "graph_nodes": f"WITH {DOCS}, {VALID} SELECT doc_id, source_type AS part, md5(title) AS title_md5, coalesce(array_to_string(people, '|'), '') AS people, CAST(len(topics) AS BIGINT) AS n_topics FROM d WHERE source_type IN ('paper', 'github_issue') AND doc_id IN (SELECT doc_id FROM node)",
    "document_graph_counts": f"WITH {DOCS}, {GRAPH} SELECT part, relation, count(*) AS n, sum(weight) AS weight FROM e GROUP BY ALL",
    "sage_documents_topk": SAGE_DOCS,
    "gat_net_topk": GAT,
    "graph_method_runs": f"SELECT *, 'graph_sage' AS method FROM ({REFERENCE['sage_topk']}) UNION ALL SELECT *, 'gnn_ret' FROM ({gnn()}) UNION ALL SELECT *, 'novel_gat' FROM ({REFERENCE['gat_base_topk']})",
}
