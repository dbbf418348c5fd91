"""SQL of the queries in ``reference``, in the dialect of DuckDB."""

from __future__ import annotations

from corpuscle.functions.structured import FIELD_PATH, METHOD_PATH
from corpuscle.functions.text import SPACE
from corpuscle.plans.reference import ALPHAS, GRID, PRICES, K

# building blocks

NUMBER = r"^[\s\p{Z}]*#?[\s\p{Z}]*0*([0-9]+?)(\.0*)?[\s\p{Z}]*$"


def plain_id(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '{NUMBER}', 1), ''), nullif(trim({c}), ''))"


LONG = f"""long AS (SELECT DISTINCT * FROM (SELECT {plain_id('query_id')} AS query_id, {plain_id('cid')} AS candidate_id, relation_type FROM
  (SELECT query_id, unnest(candidate_ids) AS cid, relation_type FROM qrels)) WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL)"""
DOCS = "d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1)"


def key(c: str, k: str) -> str:
    return f"json_extract({c}, '$.' || {k})"


def items(v: str) -> str:
    return f"list_transform(CAST({v} AS JSON[]), lambda x: x ->> '$')"


CATEGORICAL = f"""list_filter(flatten(list_transform(json_keys(categorical), lambda k: CASE json_type({key('categorical', 'k')})
  WHEN 'ARRAY' THEN {items(key('categorical', 'k'))} WHEN 'NULL' THEN CAST([] AS VARCHAR[]) ELSE [{key('categorical', 'k')} ->> '$'] END)), lambda x: x IS NOT NULL)"""
_SUB = f"""list_transform(json_keys({key('hierarchical', 'k')}), lambda j: json_extract({key('hierarchical', 'k')}, '$.' || j) ->> '$')"""
FLAT = f"""list_filter(CASE json_type(hierarchical) WHEN 'ARRAY' THEN {items('hierarchical')} WHEN 'OBJECT' THEN
  flatten(list_transform(json_keys(hierarchical), lambda k: CASE json_type({key('hierarchical', 'k')}) WHEN 'ARRAY' THEN {items(key('hierarchical', 'k'))}
  WHEN 'OBJECT' THEN {_SUB} WHEN 'NULL' THEN CAST([] AS VARCHAR[]) ELSE [{key('hierarchical', 'k')} ->> '$'] END)) END, lambda x: x IS NOT NULL AND x <> '')"""
META = f"array_to_string(list_concat(coalesce({CATEGORICAL}, []), coalesce({FLAT}, [])), ' ')"
STRUCTURED = f"(source_type = 'query' OR len(list_filter({CATEGORICAL}, lambda x: x <> '')) > 0 OR len(coalesce({FLAT}, [])) > 0)"
USELESS = f"""coalesce(len(json_keys(categorical)) > 0 AND len(list_filter(json_keys(categorical), lambda k: k NOT IN ('specificity', 'quality'))) = 0
  AND len(list_filter(json_keys(categorical), lambda k: trim(coalesce({key('categorical', 'k')} ->> '$', '')) = '')) = 0 AND len(coalesce({FLAT}, [])) = 0, false)"""


def tokens(t: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({t}, '')), '{SPACE}+'), lambda x: x <> '')"


def blank(t: str) -> str:
    return f"(regexp_replace(coalesce({t}, ''), '{SPACE}+', '', 'g') = '')"


TEXTS = f"""t AS (SELECT doc_id, id, source_type, is_candidate, {META} AS metadata, {USELESS} AS useless,
  coalesce(title, '') AS title, coalesce(main_text, '') AS main_text,
  concat_ws(' ', nullif(title, ''), nullif(main_text, '')) AS plain,
  concat_ws(' ', nullif(title, ''), nullif({META}, ''), nullif(main_text, '')) AS labelled, {STRUCTURED} AS has_structure FROM d)"""
TRUTH = f"""{LONG}, tr AS (SELECT DISTINCT q.doc_id AS query_id, c.doc_id FROM long l JOIN d q ON q.id = l.query_id JOIN d c ON c.id = l.candidate_id)"""
CORPUS = f"{DOCS}, {TEXTS}, {TRUTH}, c AS (SELECT * FROM t WHERE has_structure), q AS (SELECT * FROM c WHERE doc_id IN (SELECT query_id FROM tr))"
CANDIDATES = "s AS (SELECT * FROM c WHERE coalesce(is_candidate, true))"
PAPERS = "s AS (SELECT * FROM c WHERE source_type <> 'query')"


def top(scored: str, n: int, name: str = "r") -> str:
    """CTEs: the n best of ``scored`` (query_id, doc_id, score), without the query's own document."""
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM {scored} QUALIFY rk <= {n}),
{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rank FROM {name}0 WHERE doc_id <> query_id)"""


OUT = "SELECT query_id, doc_id, floor(score * 1000000 + 0.5) / 1000000 AS score, rank FROM r"

BM25 = f"""WITH {CORPUS}, {CANDIDATES},
l AS (SELECT doc_id, {tokens('plain')} AS ts FROM s), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM l), dl AS MATERIALIZED (SELECT doc_id, len(ts) AS len FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM l) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest({tokens('plain')}) AS term FROM q) GROUP BY ALL),
hit AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
asked AS (SELECT DISTINCT query_id FROM qt),
sc AS (SELECT a.query_id, s.doc_id, round(coalesce(score, 0), 9) AS score FROM asked a CROSS JOIN s LEFT JOIN hit USING (query_id, doc_id)),
{top('sc', K + 1)}"""


def lexical(weights: dict[str, str], docs: str, n: int, fields: dict[str, float], name: str = "r") -> str:
    """CTEs after CORPUS: cosine of lexical vectors. ``weights``: a query's weight of each field, as SQL."""
    def vec(alias: str, source: str, share: dict[str, str]) -> str:
        parts = " UNION ALL ".join(
            f"""SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) * share AS w FROM
 (SELECT doc_id, term, 1 + ln(count(*)) AS w, share FROM (SELECT doc_id, unnest({tokens(f)}) AS term, {x} AS share FROM {source}) GROUP BY ALL) WHERE share > 0"""
            for f, x in share.items()
        )
        return f"""{alias}0 AS (SELECT doc_id, term, sum(w) AS w FROM ({parts}) GROUP BY ALL),
{alias} AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {alias}0)"""

    dv = vec(f"dv{name}", docs, {f: str(w) for f, w in fields.items()})
    qv = vec(f"qv{name}", "q", weights)
    return f"""{dv}, {qv},
hit{name} AS (SELECT a.doc_id AS query_id, b.doc_id, sum(a.w * b.w) AS score FROM qv{name} a JOIN dv{name} b USING (term) GROUP BY ALL),
sc{name} AS (SELECT a.query_id, s.doc_id, round(coalesce(score, 0), 9) AS score
  FROM (SELECT DISTINCT doc_id AS query_id FROM qv{name}) a CROSS JOIN {docs} s LEFT JOIN hit{name} USING (query_id, doc_id)),
{top(f'sc{name}', n, name)}"""


def charm(f: dict[str, float], name: str = "r") -> str:
    use = f"NOT {blank('metadata')} AND NOT useless"
    share = {c: f"CASE WHEN {use} THEN {w} ELSE {1.0 if c == 'main_text' else 0.0} END" for c, w in f.items()}
    return lexical(share, "s", K + 1, f, name)


def metric_ctes(ranking: str = "r", truth: str = "known", name: str = "m", ks: tuple[int, ...] = (5, 10)) -> str:
    """CTE ``name`` (query_id, metric, k, value)."""
    rows = [f"SELECT query_id, 'mrr' AS metric, CAST(NULL AS BIGINT) AS k, round(coalesce(1.0 / first, 0), 6) AS value FROM {name}f"]
    per = []
    for k in ks:
        per.append(f"sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg{k}, sum(CASE WHEN rank <= {k} THEN hits / rank END) AS ap{k}, count(CASE WHEN rank <= {k} THEN 1 END) AS hit{k}")
        ideal = f"list_sum(list_transform(range(1, CAST(least(n, {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"
        for m, v in (("ndcg", f"coalesce(dcg{k}, 0) / {ideal}"), ("map", f"coalesce(ap{k}, 0) / n"), ("recall", f"coalesce(hit{k}, 0) / n"), ("precision", f"coalesce(hit{k}, 0) / {k}")):
            rows.append(f"SELECT query_id, '{m}', {k}, round({v}, 6) FROM {name}f")
    return f"""{name}h AS (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS hits FROM {ranking} r JOIN {truth} USING (query_id, doc_id)),
{name}f AS (SELECT * FROM (SELECT query_id, count(*) AS n FROM {truth} GROUP BY ALL) LEFT JOIN (SELECT query_id, min(rank) AS first, {', '.join(per)} FROM {name}h GROUP BY ALL) USING (query_id)),
{name} AS ({' UNION ALL '.join(rows)})"""


KNOWN = "known AS (SELECT * FROM tr WHERE query_id IN (SELECT doc_id FROM q))"
MEAN = "SELECT metric, k, round(avg(value), 6) AS mean FROM {} GROUP BY ALL"
_plain, _labelled = (lexical({x: "1.0"}, "s", K + 1, {x: 1.0}, x[0]) for x in ("plain", "labelled"))
COMPARED = f"""WITH {CORPUS}, {PAPERS}, {KNOWN}, {_plain}, {_labelled}, {metric_ctes('p', name='mp')}, {metric_ctes('l', name='ml')},
pm AS ({MEAN.format('mp')}), lm AS ({MEAN.format('ml')}),
cmp AS (SELECT lm.metric, lm.k, pm.mean AS base, lm.mean, round(CASE WHEN pm.mean <> 0 THEN (lm.mean - pm.mean) / pm.mean * 100 ELSE 0 END, 4) AS change
  FROM lm JOIN pm ON lm.metric = pm.metric AND lm.k IS NOT DISTINCT FROM pm.k)"""

_trials = ", ".join(f"{charm(f, f'x{i}_')}, {metric_ctes(f'x{i}_', name=f'y{i}_', ks=(K,))}" for i, f in enumerate(GRID))
_trial_rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS trial, round(avg(value), 6) AS ndcg FROM y{i}_ WHERE metric = 'ndcg'" for i in range(len(GRID)))

VECTORS = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE doc_id % 100 = 0)"


def cosines(epsilon: bool) -> str:
    norm = lambda a: f"sqrt(list_dot_product({a}.e, {a}.e))"
    down = f"({norm('q')} * {norm('v')} + {1e-10 if epsilon else 0.0:.10f})"
    return f"sc AS (SELECT q.doc_id AS query_id, v.doc_id, round(CASE WHEN {down} <> 0 THEN list_dot_product(q.e, v.e) / {down} ELSE 0 END, 9) AS score FROM q CROSS JOIN v)"


_BUCKET = "vb AS (SELECT doc_id, label, doc_id % CAST(ceil(count(*) OVER (PARTITION BY label) / 10) AS BIGINT) AS b FROM v), bk AS (SELECT label, b FROM vb GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50)"
VEDGES = f"{_BUCKET}, e AS (SELECT x.doc_id AS src, y.doc_id AS dst, 0.5 AS weight FROM vb x JOIN vb y USING (label, b) JOIN bk USING (label, b) WHERE x.doc_id <> y.doc_id)"

SAGE = f"""WITH {VECTORS}, {cosines(True)}, {VEDGES},
seed AS (SELECT query_id, doc_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {2 * K}),
inc AS (SELECT src AS doc_id, dst AS near, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
tot AS (SELECT doc_id, sum(weight) + 1e-10 AS total FROM inc GROUP BY ALL),
add AS (SELECT s.query_id, i.near AS doc_id, 0.15 * s.score * (i.weight / total) * greatest(0, coalesce(n.score, 1)) AS score
  FROM seed s JOIN inc i USING (doc_id) JOIN tot USING (doc_id) LEFT JOIN seed n ON n.query_id = s.query_id AND n.doc_id = i.near),
fin AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM (SELECT * FROM seed UNION ALL SELECT * FROM add) GROUP BY ALL),
{top('fin', K)} {OUT}"""


def gnn() -> str:
    rounds, last = [], "h0"
    for i, a in enumerate(ALPHAS, 1):
        rounds.append(f"""s{i} AS (SELECT * FROM {last} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h, doc_id) <= 5),
m{i} AS (SELECT query_id, dst AS doc_id, min(h) AS m FROM s{i} JOIN (SELECT DISTINCT src, dst FROM e) ON src = doc_id GROUP BY ALL),
h{i} AS (SELECT query_id, doc_id, CASE WHEN m IS NULL THEN h ELSE round({a} * h + (1 - {a}) * m, 9) END AS h FROM {last} LEFT JOIN m{i} USING (query_id, doc_id))""")
        last = f"h{i}"
    return f"""WITH {VECTORS}, {cosines(True)}, {VEDGES}, h0 AS (SELECT query_id, doc_id, round(1 - score, 9) AS h FROM sc), {', '.join(rounds)},
z AS (SELECT query_id, doc_id, 1 - h AS score, row_number() OVER (PARTITION BY query_id ORDER BY h, doc_id) AS rk FROM {last} QUALIFY rk <= {K}),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rank FROM z WHERE doc_id <> query_id) {OUT}"""


def split_values(a: str) -> str:
    return f"list_filter(flatten(list_transform(list_filter(coalesce({a}, []), lambda x: x IS NOT NULL), lambda x: list_transform(string_split(x, '|'), lambda y: trim(y)))), lambda x: x <> '')"


def field(name: str) -> str:
    v = f"json_extract(categorical, '$.{name}')"
    return split_values(f"CASE json_type({v}) WHEN 'ARRAY' THEN {items(v)} WHEN 'NULL' THEN CAST([] AS VARCHAR[]) ELSE [{v} ->> '$'] END")


VALID = f"node AS (SELECT doc_id FROM d WHERE NOT {blank('title')} AND NOT {blank('main_text')})"


def _keys(relation: str, values: str, kind: str) -> str:
    return f"SELECT '{relation}' AS relation, unnest({values}) AS value, doc_id, source_type AS part FROM d WHERE source_type = '{kind}'"


_FIELDS = " UNION ALL ".join([
    *[_keys(f"share {n}", field(n), "paper") for n in ("venue_name", "publication_types")],
    _keys("share authors", split_values("people"), "paper"),
    _keys("share source_dataset", "[source_dataset]", "github_issue"),
    *[_keys(f"share {n}", split_values(n), "github_issue") for n in ("projects", "people", "organizations", "topics")],
])


def shared(keys: str, weight: float) -> str:
    """CTE ``e`` of shared-value edges."""
    return f"""{DOCS}, {VALID}, k AS (SELECT DISTINCT * FROM ({keys})),
ok AS (SELECT relation, value, part FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
kk AS (SELECT k.* FROM k JOIN ok ON k.relation = ok.relation AND k.value IS NOT DISTINCT FROM ok.value AND k.part = ok.part),
e AS (SELECT a.doc_id AS src, b.doc_id AS dst, a.relation, count(*) * {weight} AS weight FROM kk a JOIN kk b ON a.relation = b.relation AND a.value = b.value AND a.part = b.part
  WHERE a.doc_id <> b.doc_id AND a.doc_id IN (SELECT doc_id FROM node) AND b.doc_id IN (SELECT doc_id FROM node) GROUP BY a.doc_id, b.doc_id, a.relation, a.part)"""


def _path(name: str, fields: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"trim(json_extract_string(hierarchical, '$.{name}.{f}'))" for f in fields) + "], lambda x: x IS NOT NULL AND x <> '')"


_ERRORS = f"list_filter(coalesce({items("json_extract(hierarchical, '$.errors')")}, []), lambda x: x IS NOT NULL AND x <> '')"
_LEVELS = "list_filter(list_transform(string_split(replace(s, chr(92), '/'), '/'), lambda y: trim(y)), lambda y: y <> '')"
PATHS = f"""list_filter(CASE json_type(hierarchical) WHEN 'OBJECT' THEN [{_path('field_of_study_path', FIELD_PATH)}, {_path('method_path', METHOD_PATH)}, {_ERRORS}]
  WHEN 'ARRAY' THEN list_transform(list_filter({items('hierarchical')}, lambda x: x IS NOT NULL), lambda s: {_LEVELS}) END, lambda p: len(p) > 0)"""
PREFIXES = "list_transform(range(1, len(p) + 1), lambda i: array_to_string(list_slice(p, 1, i), ' / '))"
_PREFIX_KEYS = f"""SELECT 'share hierarchical path' AS relation, unnest({PREFIXES}) AS value, doc_id, part FROM
  (SELECT doc_id, source_type AS part, unnest({PATHS}) AS p FROM d WHERE source_type IN ('paper', 'github_issue'))"""

DEGREES = """b AS (SELECT src AS doc_id, dst AS near FROM e UNION ALL SELECT dst, src FROM e),
g AS (SELECT doc_id, count(*) AS degree, count(DISTINCT near) AS neighbours FROM b GROUP BY ALL)"""

LABEL_MAP = "lm AS (SELECT trim(raw_label) AS raw, arg_max(trim(normalized_path), line_no) AS path FROM label_mapping GROUP BY ALL)"
NORMALISED = f"""{LABEL_MAP}, l AS (SELECT DISTINCT issue_key, trim(unnest(string_split(labels, '|'))) AS raw FROM issues_df),
n AS (SELECT issue_key, coalesce(f.normalized, '') AS normalized FROM (SELECT DISTINCT issue_key FROM issues_df) LEFT JOIN
  (SELECT issue_key, array_to_string(list_sort(list(DISTINCT path)), '|') AS normalized FROM l JOIN lm USING (raw) GROUP BY ALL) f USING (issue_key))"""
LINKED = """pr AS (SELECT DISTINCT issue_key, pull_url FROM links WHERE issue_key IS NOT NULL AND pull_url IS NOT NULL {known}),
sz AS (SELECT pull_url, count(*) AS n FROM pr GROUP BY ALL HAVING count(*) > 1),
pairs AS (SELECT a.issue_key, b.issue_key AS other, pull_url, n FROM pr a JOIN pr b USING (pull_url) JOIN sz USING (pull_url) WHERE a.issue_key <> b.issue_key),
rel AS (SELECT issue_key, list_sort(list(DISTINCT other)) AS related FROM pairs WHERE n <= 50 GROUP BY ALL),
hub AS (SELECT issue_key, list_sort(list(DISTINCT pull_url) FILTER (n > 50)) AS hubs, count(*) AS n_links FROM pairs GROUP BY ALL)"""
ISSUE_IDS = """ii AS (SELECT issue_key, any_value(repository) AS repository, any_value(comments) AS comments FROM issues_df GROUP BY issue_key),
ids AS (SELECT *, row_number() OVER (ORDER BY issue_key) AS id FROM ii)"""
KNOWN_LINKS = LINKED.format(known="AND issue_key IN (SELECT issue_key FROM issues_df)")
_HASH = "md5('42|' || {})"

_rules = [f"json_extract(hierarchical, '$.{k}') IS NULL" for k in ("affiliations", "field_of_study_path", "method_path")]
_names = [f"missing key {k}" for k in ("affiliations", "field_of_study_path", "method_path")]
_whole = "json_type(hierarchical, '$.field_of_study_path') = 'OBJECT' AND json_type(hierarchical, '$.method_path') = 'OBJECT'"
for _p, _fs in (("field_of_study_path", FIELD_PATH), ("method_path", METHOD_PATH)):
    for _f in _fs:
        _rules.append(f"{_whole} AND coalesce(json_extract_string(hierarchical, '$.{_p}.{_f}'), '') = ''")
        _names.append(f"missing {_f}")
for _p, _fs in (("field_of_study_path", FIELD_PATH), ("method_path", METHOD_PATH)):
    _l = "list_filter([" + ", ".join(f"lower(trim(json_extract_string(hierarchical, '$.{_p}.{_f}')))" for _f in _fs) + "], lambda x: x IS NOT NULL)"
    _rules.append(f"len(list_distinct({_l})) < len({_l})")
    _names.append(f"repeated label in {_p}")
    if _p == "field_of_study_path":
        _long = f"len(list_filter({_l}, lambda x: len(string_split_regex(x, '\\s+')) > 8)) > 0"
_rules.append(_long)
_names.append("label of more than 8 words")
SANITY = f"WITH {DOCS}, p AS (SELECT * FROM d WHERE source_type = 'paper') " + " UNION ALL ".join(
    f"SELECT '{n}' AS problem, count(*) AS n FROM p WHERE {r} HAVING count(*) > 0" for n, r in zip(_names, _rules)
)

SQL = {
    "bm25_topk": f"{BM25} {OUT}",
    "bm25_metrics": f"{BM25}, {KNOWN}, {metric_ctes()} SELECT query_id, metric, k, value FROM m",
    "bm25_metrics_mean": f"{BM25}, {KNOWN}, {metric_ctes()} {MEAN.format('m')}",
    "bm25_details": f"""{BM25}, {KNOWN} SELECT query_id, coalesce(retrieved, 0) AS retrieved, coalesce(top_retrieved, '') AS top_retrieved, coalesce(matched, 0) AS matched
FROM (SELECT DISTINCT query_id FROM known) LEFT JOIN (SELECT r.query_id, count(*) AS retrieved, string_agg(CAST(r.doc_id AS VARCHAR), ' ' ORDER BY rank) FILTER (rank <= 5) AS top_retrieved,
  count(known.doc_id) AS matched FROM r LEFT JOIN known ON r.query_id = known.query_id AND r.doc_id = known.doc_id GROUP BY ALL) USING (query_id)""",
    "lexical_topk": f"WITH {CORPUS}, {PAPERS}, {lexical({'plain': '1.0'}, 's', K + 1, {'plain': 1.0})} {OUT}",
    "lexical_labels_topk": f"WITH {CORPUS}, {PAPERS}, {lexical({'labelled': '1.0'}, 's', K + 1, {'labelled': 1.0})} {OUT}",
    "charm_topk": f"WITH {CORPUS}, {CANDIDATES}, {charm({'metadata': 1.0, 'title': 1.0, 'main_text': 2.0})} {OUT}",
    "charm_param_search": f"WITH {CORPUS}, {CANDIDATES}, {KNOWN}, {_trials} {_trial_rows}",
    "method_comparison": f"{COMPARED} SELECT * FROM cmp",
    "comparison_summary": f"""{COMPARED} SELECT count(*) FILTER (change > 0) AS improved, count(*) FILTER (change < 0) AS degraded,
round(coalesce(avg(change) FILTER (change > 0), 0), 4) AS avg_improvement, round(coalesce(avg(change) FILTER (change < 0), 0), 4) AS avg_degradation FROM cmp""",
    "dense_topk": f"WITH {VECTORS}, {cosines(False)}, {top('sc', K + 1)} {OUT}",
    "dense_metrics_mean": f"""WITH {VECTORS}, {cosines(False)}, {top('sc', K + 1)},
known AS (SELECT q.doc_id AS query_id, v.doc_id FROM q JOIN v USING (label) WHERE q.doc_id <> v.doc_id), {metric_ctes()} {MEAN.format('m')}""",
    "sage_topk": SAGE,
    "gnn_ret_topk": gnn(),
    "gat_base_topk": f"WITH {VECTORS}, {cosines(True)}, {top('sc', K)} {OUT}",
    "shared_field_edges": f"WITH {shared(_FIELDS, 0.5)} SELECT src, dst, relation, CAST(weight AS DOUBLE) AS weight FROM e",
    "hier_prefix_edges": f"WITH {shared(_PREFIX_KEYS, 0.75)} SELECT src, dst, relation, CAST(weight AS DOUBLE) AS weight FROM e",
    "entity_edges": f"""WITH {DOCS}, k AS (SELECT 'people' AS relation, unnest({split_values('people')}) AS value, doc_id FROM d UNION ALL
SELECT 'organizations', unnest({split_values('organizations')}), doc_id FROM d), ok AS (SELECT relation, value FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50)
SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS n FROM k a JOIN k b USING (relation, value) JOIN ok USING (relation, value) WHERE a.doc_id <> b.doc_id GROUP BY ALL""",
    "explicit_edges": f"""WITH {DOCS}, {VALID}, x AS (SELECT * FROM d WHERE source_type IN ('paper', 'github_issue'))
SELECT a.doc_id AS src, b.doc_id AS dst, CASE WHEN a.source_type = 'paper' THEN 'citation' ELSE 'linked_issue' END AS relation, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT doc_id, source_type, {plain_id('entry')} AS id FROM (SELECT doc_id, source_type, unnest(explicit_related_ids) AS entry FROM x)) a JOIN x b USING (id)
WHERE a.doc_id <> b.doc_id AND a.doc_id IN (SELECT doc_id FROM node) AND b.doc_id IN (SELECT doc_id FROM node) GROUP BY ALL""",
    "graph_degree_stats": f"""WITH {shared(_FIELDS, 0.5)}, {DEGREES} SELECT count(*) AS n_nodes, round(avg(neighbours), 6) AS avg_neighbours, max(neighbours) AS max_neighbours,
round(avg(degree), 6) AS avg_degree, round(quantile_cont(degree, 0.5), 6) AS median_degree, round(quantile_cont(degree, 0.95), 6) AS p95_degree,
round(quantile_cont(degree, 0.99), 6) AS p99_degree, max(degree) AS max_degree FROM g""",
    "graph_hub": f"WITH {shared(_FIELDS, 0.5)}, {DEGREES} SELECT * FROM g ORDER BY neighbours DESC, doc_id LIMIT 1",
    "graph_hub_relations": f"""WITH {shared(_FIELDS, 0.5)}, {DEGREES}, hb AS (SELECT doc_id FROM g ORDER BY neighbours DESC, doc_id LIMIT 1)
SELECT 'IN' AS direction, relation, count(*) AS n FROM e WHERE dst IN (SELECT doc_id FROM hb) GROUP BY ALL UNION ALL
SELECT 'OUT', relation, count(*) FROM e WHERE src IN (SELECT doc_id FROM hb) GROUP BY ALL""",
    "linked_issues": f"""WITH {LINKED.format(known='')} SELECT issue_key, coalesce(array_to_string(related, ' '), '') AS related, coalesce(array_to_string(hubs, ' '), '') AS hubs, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT issue_key FROM links WHERE issue_key IS NOT NULL) LEFT JOIN rel USING (issue_key) LEFT JOIN hub USING (issue_key)""",
    "issue_documents": f"""WITH {NORMALISED}, {KNOWN_LINKS}, {ISSUE_IDS},
rid AS (SELECT r.issue_key, string_agg(CAST(o.id AS VARCHAR), ' ' ORDER BY o.id) AS related FROM (SELECT issue_key, unnest(related) AS other FROM rel) r JOIN ids o ON o.issue_key = r.other GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS id, repository AS source_dataset, CAST(len(string_split(coalesce(comments, ''), '|')) AS INTEGER) AS n_comments, '["' || replace(normalized, '"', chr(92) || '"') || '"]' AS hierarchical,
coalesce(related, '') AS related, ids.issue_key AS native_id, coalesce(array_to_string(hubs, ' '), '') AS hubs, coalesce(n_links, 0) AS n_links
FROM ids JOIN n USING (issue_key) LEFT JOIN rid USING (issue_key) LEFT JOIN hub USING (issue_key)""",
    "issue_qrels": f"""WITH {KNOWN_LINKS}, {ISSUE_IDS} SELECT DISTINCT a.id AS query_id, b.id AS candidate_id, CAST(NULL AS VARCHAR) AS pull_url, CAST(NULL AS BIGINT) AS n
FROM pairs p JOIN ids a ON a.issue_key = p.issue_key JOIN ids b ON b.issue_key = p.other WHERE n <= 50
UNION ALL SELECT DISTINCT id, CAST(NULL AS BIGINT), pull_url, n FROM pairs JOIN ids USING (issue_key) WHERE n > 50""",
    "qrels_long": f"WITH {LONG} SELECT * FROM long",
    "qrels_valid": f"WITH {DOCS}, {LONG} SELECT * FROM long WHERE query_id IN (SELECT id FROM d) AND candidate_id IN (SELECT id FROM d)",
    "link_issue_keys": """SELECT l.issue_url, l.pull_url, i.issue_key FROM links l LEFT JOIN (SELECT issue_url, issue_key FROM issues_df WHERE issue_url IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY issue_url ORDER BY exported_at DESC NULLS LAST, issue_key DESC NULLS LAST) = 1) i USING (issue_url)""",
    "label_normalize": f"WITH {NORMALISED} SELECT * FROM n",
    "label_counts": f"WITH {NORMALISED}, x AS (SELECT unnest(string_split(normalized, '|')) AS path FROM n) SELECT path, count(*) AS n FROM x WHERE path <> '' GROUP BY ALL",
    "related_ids": f"""WITH {DOCS}, x AS (SELECT doc_id, {plain_id('entry')} AS id, pos FROM (SELECT doc_id, unnest(explicit_related_ids) AS entry, generate_subscripts(explicit_related_ids, 1) AS pos FROM d)),
f AS (SELECT x.doc_id, string_agg(CAST(d.doc_id AS VARCHAR), ' ' ORDER BY pos) AS related FROM x JOIN d USING (id) GROUP BY ALL)
SELECT doc_id, coalesce(related, '') AS related FROM (SELECT doc_id FROM d) LEFT JOIN f USING (doc_id)""",
    "id_assignment": f"""WITH {DOCS}, u AS (SELECT 0 AS part, CAST(doc_id AS VARCHAR) AS native, md5(text) AS content FROM d UNION ALL SELECT DISTINCT 1, issue_key, md5(issue_body) FROM issues_df)
SELECT part, native, content, row_number() OVER (ORDER BY part, native) AS id FROM u""",
    "chunking": f"""WITH {DOCS}, c AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 250 AS chunk FROM d)
SELECT chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM c GROUP BY ALL""",
    "struct_filter": f"WITH {DOCS} SELECT doc_id, source_type FROM d WHERE {STRUCTURED}",
    "metadata_text": f"WITH {DOCS} SELECT doc_id, {META} AS metadata FROM d",
    "prepared_text": f"WITH {DOCS}, {TEXTS} SELECT doc_id, md5(labelled) AS labelled_md5, CAST(len({tokens('plain')}) AS BIGINT) AS n_tokens FROM t",
    "hier_paths": f"WITH {DOCS}, h AS (SELECT unnest({PATHS}) AS p FROM d), x AS (SELECT unnest({PREFIXES}) AS prefix FROM h) SELECT prefix, count(*) AS n FROM x GROUP BY ALL",
    "hierarchy_parse": f"""WITH {DOCS} SELECT CASE WHEN hierarchical IS NULL OR trim(hierarchical) = '' THEN 'missing_hierarchy_info' WHEN NOT json_valid(hierarchical) THEN 'JSONDecodeError'
WHEN json_type(hierarchical) <> 'OBJECT' THEN 'hierarchy_info_not_dict' ELSE 'none' END AS error, count(*) AS n FROM d GROUP BY ALL""",
    "metadata_enrich": f"""WITH {DOCS} SELECT doc_id, native_id, created_at, issue_key IS NOT NULL AS found FROM (SELECT * FROM d WHERE source_type = 'github_issue') x LEFT JOIN
(SELECT issue_key, created_at FROM issues_df QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY exported_at DESC NULLS LAST, closed_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1) i ON x.native_id = i.issue_key""",
    "citation_queries": f"""WITH {DOCS} SELECT id AS query_id, CAST(len(explicit_related_ids) AS BIGINT) AS n_candidates, 'citation' AS relation_type FROM d
WHERE source_type = 'paper' AND len(explicit_related_ids) > 0 ORDER BY {_HASH.format('id')}, id LIMIT 200""",
    "doc_dedup": "SELECT md5(text) AS text_md5, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "duplicate_rows": "SELECT doc_id, id FROM documents QUALIFY count(*) OVER (PARTITION BY id) > 1",
    "missing_ids": "SELECT DISTINCT issue_key FROM issues_df i WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.issue_key = i.issue_key)",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "validation_counts": f"""WITH {LONG} SELECT * FROM (SELECT count(*) AS n_pairs, count(DISTINCT query_id) AS n_queries, count(DISTINCT candidate_id) AS n_candidates FROM long),
(SELECT count(*) AS n_rows, count(DISTINCT id) AS n_documents FROM documents)""",
    "sanity_rules": SANITY,
    "common_people": "SELECT value, count(*) AS n FROM (SELECT unnest(people) AS value FROM documents) WHERE value IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 30",
    "cost_estimate": "WITH " + DOCS + f", t AS (SELECT len({tokens("concat_ws(' ', nullif(title, ''), nullif(main_text, ''))")}) AS n FROM d WHERE source_type = 'paper') " + " UNION ALL ".join(
        f"SELECT '{m}' AS model, count(*) AS n_requests, round(avg(n), 6) AS avg_input_tokens, round((sum(n) * {a} + count(*) * 200.0 * {b}) / 1e6 * 0.5, 6) AS cost FROM t" for m, (a, b) in PRICES.items()
    ),
    "corpus_fingerprint": """WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(id, chr(0)), coalesce(title, chr(0)), coalesce(main_text, chr(0)))) AS h FROM documents)
SELECT count(*) AS n_rows, substr(md5(CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR)), 1, 12) AS fingerprint FROM h""",
    "train_split": f"""WITH u AS (SELECT query_id, CAST('0x' || substr({_HASH.format('query_id')}, 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL))
SELECT query_id, CASE WHEN u < 0.1 THEN 'train' WHEN u < 0.25 THEN 'val' ELSE 'test' END AS split FROM u""",
    "query_sample": f"SELECT query_id FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL) ORDER BY {_HASH.format('query_id')}, query_id LIMIT 100",
}
