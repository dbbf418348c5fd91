"""Worked examples and properties of the core operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import structured, text, vectors
from corpuscle.operators import align, bench, enrich, graph, metrics, retrieval, sampling, search, validate
from corpuscle.operators.components import components
from corpuscle.operators.search import dense_search
from corpuscle.sources import readers, sinks
from corpuscle.streaming import incremental


def values(spark, ranking, truth, ks):
    r = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranking, 1)], "query_id string, doc_id string, rank long")
    t = spark.createDataFrame([("q", d) for d in truth], "query_id string, doc_id string")
    return {(x.metric, x.k): x.value for x in metrics.evaluate(r, t, ks).collect()}


def test_metrics_of_worked_examples(spark):
    m = values(spark, ["a", "b", "c"], ["b", "d"], (3, 10))
    assert (m["ndcg", 3], m["map", 3], m["recall", 3], m["precision", 3], m["mrr", None]) == (0.386853, 0.25, 0.5, 0.333333, 0.5)
    assert m["precision", 10] == 0.1
    assert values(spark, ["a", "b", "c", "d"], ["d"], (3,))["mrr", None] == 0.25
    assert set(values(spark, [], ["d"], (3,)).values()) == {0.0}
    assert all(v == 1.0 for k, v in values(spark, ["b", "d", "a"], ["b", "d"], (2,)).items())


def test_bm25_of_worked_example(spark):
    texts = ["red bolt small bolt", "red ring", "blue widget red small thing", "green ring"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, plain string")
    q = spark.createDataFrame([(10, "red bolt"), (11, "red red"), (12, "ring")], "doc_id long, plain string")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in retrieval.bm25(d, q, 3).collect()}
    assert [got[10, i] for i in range(4)] == [1.22279, 0.12808, 0.085254, 0.0]
    assert [got[11, i] for i in range(3)] == [0.191897, 0.25616, 0.170509]
    assert [r.doc_id for r in retrieval.bm25(d, q, 3).where("query_id = 12").orderBy("rank").collect()] == [0, 1, 2, 3]


def test_expansion_of_worked_example(spark):
    seeds = spark.createDataFrame([(9, 1, 0.9, "p"), (9, 2, 0.6, "p")], "query_id long, doc_id long, score double, part string")
    edges = spark.createDataFrame([(1, 2, "c", 1.0, "p"), (1, 3, "s", 0.5, "p"), (3, 1, "s", 0.5, "p")], "src long, dst long, relation string, weight double, part string")
    index = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert [(r.doc_id, round(r.score, 4)) for r in retrieval.expand(seeds, edges, index, 5).orderBy("rank").collect()] == [(1, 0.981), (2, 0.6405), (3, 0.0675)]


def test_propagation_of_worked_example(spark):
    start = spark.createDataFrame([(9, i, 1 - h) for i, h in ((1, 0.1), (2, 0.5), (3, 0.9), (4, 0.7))], "query_id long, doc_id long, score double")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3, 4, 9)], "doc_id long, embedding array<double>")
    for seeds, order in ((1, [1, 2, 4, 3]), (2, [1, 2, 3, 4])):
        got = retrieval.propagate(start, edges, v, v.where("doc_id = 9"), 4, [0.5, 0.5], seeds)
        assert [r.doc_id for r in got.orderBy("rank").collect()] == order


def test_dense_search_is_deterministic_under_ties_and_partitioning(spark):
    d = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)] + [(99, [0.0, 0.0]), (98, None)], "doc_id long, embedding array<double>")
    q = d.where("doc_id in (0, 4)")
    a = dense_search(d.repartition(1), q, 7).orderBy("query_id", "rank").collect()
    assert a == dense_search(d.repartition(7), q, 7).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in a if r.query_id == 0] == [0, 3, 6, 9, 12, 15, 18]
    assert dense_search(d, d.where("false"), 3).count() == 0


def test_prefix_edges_and_cap(spark):
    d = spark.createDataFrame([(1, ["ML", "DL", "GNN"]), (2, ["ML", "DL", "CNN"])], "doc_id long, p array<string>")
    e = graph.shared_edges(graph.keys(d, "share", structured.prefixes(F.col("p"))), 0.75).collect()
    assert sorted((r.src, r.dst, r.weight) for r in e) == [(1, 2, 1.5), (2, 1, 1.5)]
    for n, kept in ((50, 50 * 49), (51, 0)):
        k = graph.keys(spark.range(n).select(F.col("id").alias("doc_id")), "r", F.array(F.lit("x")))
        assert graph.shared_edges(k, 0.5).count() == kept
    twice = graph.keys(spark.range(26).select(F.col("id").alias("doc_id")), "r", F.array(F.lit("x"), F.lit("x")))
    assert graph.repeated_edges(twice).count() == 0 and graph.shared_edges(twice, 0.5).count() == 26 * 25


def test_linked_issues(spark):
    rows = [("i1", "p1"), ("i2", "p1"), ("i2", "p2"), ("i3", "p2"), ("i4", None), ("i1", "p1"), (None, "p1")] + [(f"h{i}", "hub") for i in range(60)]
    got = {r.issue_key: (r.related, r.hubs, r.n_links) for r in graph.linked(spark.createDataFrame(rows, "issue_key string, pull_url string")).collect()}
    assert got["i1"] == (["i2"], [], 1) and got["i2"] == (["i1", "i3"], [], 2) and got["i4"] == ([], [], 0)
    assert got["h7"] == ([], ["hub"], 59)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[102] == 100 and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_label_normalisation(spark):
    i = spark.createDataFrame([("k", "bug|UI|zzz"), ("e", ""), ("n", None)], "issue_key string, labels string")
    m = spark.createDataFrame([(1, "bug", "old"), (2, "bug ", "type/defect/bug"), (3, "UI", " area/ui")], "line_no long, raw_label string, normalized_path string")
    assert {r.issue_key: r.normalized for r in align.normalised_labels(i, m).collect()} == {"k": "area/ui|type/defect/bug", "e": "", "n": ""}


@pytest.mark.parametrize(
    "raw,value,error",
    [
        ('{"a": {"b": 1}}', '{"a": {"b": 1}}', None), ('```json\n{"a": 1} // why\n```', '{"a": 1}', None),
        ('Sure! {"a": 1} Hope this helps', '{"a": 1}', None), ('{"a": {"x": 1}}, {"b": {"y": 2}}', {"a": '{"x":1}', "b": '{"y":2}'}, None),
        (None, None, "missing_hierarchy_info"), ("", None, "missing_hierarchy_info"), ("null", None, "hierarchy_info_not_dict"),
        ("not json", None, "JSONDecodeError"), ("[1,2]", None, "hierarchy_info_not_dict"),
    ],
)
def test_hierarchy_repair(spark, raw, value, error):
    r = spark.createDataFrame([(raw,)], "t string").select(structured.parse_hierarchy(F.col("t")).alias("p")).first().p
    assert r.error == error
    if isinstance(value, dict):
        assert json.loads(r.value).keys() == value.keys()
    else:
        assert r.value == value


def test_structured_functions_of_every_shape(spark):
    rows = [
        ("github_issue", "{}", '["area/ui|type/x"]', [["area", "ui|type", "x"]], "area/ui|type/x", True),
        ("github_issue", "{}", '[""]', [], "", False),
        ("paper", '{"venue_name": "V", "j": null, "f": ["a", null]}', '{"affiliations": [], "field_of_study_path": {"field": "F", "research_area": " R "}, "method_path": {}}', [["F", "R"]], "V a F  R ", True),
        ("paper", "{}", '{"errors": ["e"]}', [["e"]], "e", True),
        ("query", '{"specificity": "1", "quality": ""}', "{}", [], "1 ", True), ("paper", None, None, [], "", False), ("paper", "broken", "broken", [], "", False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, c string, h string")
    c, h = F.col("c"), F.col("h")
    got = df.select(structured.paths(h).alias("p"), structured.metadata_text(c, h).alias("m"), structured.has_structure(F.col("s"), c, h).alias("x")).collect()
    assert [(g.p, g.m, g.x) for g in got] == [r[3:] for r in rows]


def test_text_functions(spark):
    df = spark.createDataFrame([("Añ B\tC\x1fd", None), ("", "x" * 100), (None, "A b!")], "a string, b string")
    r = df.select(text.tokens(F.col("a")).alias("t"), text.slug(F.col("b")).alias("s"), text.blank(F.col("a")).alias("k")).collect()
    assert r[0].t == ["añ", "b", "c", "d"] and r[1].t == [] and r[2].t == []
    assert len(r[1].s) == 81 and r[2].s == "a-b" and [x.k for x in r] == [False, True, True]


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    x = r.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.norm(F.col("a")), vectors.weighted_mean([F.col("a"), F.col("b")], [1.0, 3.0])).first()
    assert math.isclose(x[0], 0.96) and x[1] is None and x[2] == 5.0 and x[3] == [3.75, 3.25]


def test_numbering_and_chunks(spark):
    rows = spark.createDataFrame([(f"k{i:03d}",) for i in range(103)], "k string").repartition(5)
    got = [(r.k, r.id) for r in align.numbered(rows, [F.col("k")], 7).orderBy("k").collect()]
    assert got == [(f"k{i:03d}", i + 8) for i in range(103)]
    assert {r.chunk: r["count"] for r in align.chunks(rows, [F.col("k")], 50).groupBy("chunk").count().collect()} == {0: 50, 1: 50, 2: 3}


def test_numbers_are_whole_with_any_other_columns(spark):
    n = 600_000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("k"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.array("id").alias("b"))
    rows = rows.repartition(7, "a")
    for _ in range(2):
        got = align.numbered(rows, [F.col("k")], out="no")
        r = got.agg(F.count_distinct("no"), F.min("no"), F.max("no"), F.count_if(F.col("no") != F.col("id") + 1)).first()
        assert tuple(r) == (n, 1, n, 0)
    two = spark.createDataFrame([(None, 2), (1, None), (1, 5), (0, 9), (None, 1)], "x int, y int")
    assert [(r.x, r.y) for r in align.numbered(two, [F.col("x"), F.col("y")]).orderBy("id").collect()] == [(None, 1), (None, 2), (0, 9), (1, None), (1, 5)]
    assert align.numbered(two.where("false"), [F.col("x")]).count() == 0


def test_ids_are_read_in_any_rendering(spark):
    q = spark.createDataFrame([(" 1", ["#2", "2.0", "x y", " ", None]), (None, ["3"])], "query_id string, candidate_ids array<string>").withColumn("relation_type", F.lit("citation"))
    assert sorted((r.query_id, r.candidate_id) for r in align.long_qrels(q).collect()) == [("1", "2"), ("1", "x y")]


def test_issue_qrels_keep_large_pulls_by_membership(spark):
    links = [("a", "p"), ("b", "p"), ("b", "p"), ("x", "p"), ("a", None)] + [(f"h{i}", "hub") for i in range(60)]
    ids = spark.createDataFrame([(k, n) for n, k in enumerate(["a", "b"] + [f"h{i}" for i in range(55)])], "issue_key string, id long")
    got = graph.issue_qrels(spark.createDataFrame(links, "issue_key string, pull_url string"), ids).collect()
    assert sorted((r.query_id, r.candidate_id) for r in got if r.pull_url is None) == [(0, 1), (1, 0)]
    assert sum(r.n == 55 for r in got) == 55


def test_search_in_several_blocks_equals_one(spark, monkeypatch):
    from corpuscle.operators import search

    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)] + [(60, None), (61, "")], "doc_id long, plain string")
    one = sorted(map(tuple, retrieval.bm25(d, d.where("doc_id < 20"), 5).collect()))
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)], "doc_id long, embedding array<double>")
    near = sorted(map(tuple, dense_search(v, v.where("doc_id < 9"), 4).collect()))
    monkeypatch.setattr(search, "ENTRIES", 9)
    assert sorted(map(tuple, retrieval.bm25(d, d.where("doc_id < 20"), 5).collect())) == one
    assert sorted(map(tuple, dense_search(v, v.where("doc_id < 9"), 4).collect())) == near


def by_brute_force(queries, texts, k):
    """The k best of each query, as search ranks them: rounded scores, ties to the smaller id."""
    out = set()
    for q, terms in queries.items():
        scored = sorted((-round(sum(w * t.get(x, 0.0) for x, w in terms.items()), 9) + 0.0, d) for d, t in texts.items())
        out |= {(q, d, place) for place, (_, d) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("seed", "sign"), [(1, 1), (2, 1), (3, -1)])
def test_grouped_scores_rank_as_brute_force(monkeypatch, seed, sign):
    import random

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "MEMBERS", 40)
    monkeypatch.setattr(search, "WIDTH", 30)
    r = random.Random(seed)
    kinds = [[f"{kind}{i}" for i in range(60)] for kind in "abc"]
    text = lambda n: {x: r.choice([0.5, 1.0, 1.25]) for x in r.sample(r.choice(kinds) + ["the", "of", f"rare{r.randrange(99)}"], n)}
    texts = {i: text(r.randrange(1, 12)) for i in range(900)} | {i: {"the": 1.0} for i in range(900, 960)} | {960 + i: {} for i in range(9)}
    queries = {i: {x: w * r.choice([sign, 1]) for x, w in text(r.randrange(1, 9)).items()} for i in range(700)} | {700: {"nowhere": 1.0}}
    rows = [(q, x, w) for q, t in queries.items() for x, w in t.items()]
    index = search.Index(pa.table({"query_id": [a for a, _, _ in rows], "term": [b for _, b, _ in rows], "weight": [c for _, _, c in rows]}))
    assert len(index.groups) > 8
    place, best, ids = {x: n for n, x in enumerate(index.terms.to_pylist())}, search.Best(index.queries, 7), list(texts)
    for lo in range(0, len(ids), 400):
        some = [(n, place[x], v) for n, d in enumerate(ids[lo : lo + 400]) for x, v in texts[d].items() if x in place]
        row, term, value = (np.array(c) for c in zip(*some))
        index.offer(best, np.array(ids[lo : lo + 400]), row, term, value)
    got = {(q, d, n) for q, docs in zip(index.queries.tolist(), best.doc.tolist()) for n, d in enumerate(docs)}
    assert got == by_brute_force(queries, texts, 7)


def test_search_keeps_k_rows_a_core(spark):
    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)], "doc_id long, plain string").repartition(24)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = search._searched(search.term_index(d, ["plain"]), retrieval.term_counts(search.term_index(d, ["plain"]), "plain"), 1, [{"plain": 1.0}], search.lexical_weights, False)
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lexical_search_tokenises_the_corpus_once(spark, monkeypatch):
    kept, own = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda x: kept.append(x.columns) or own(x))
    monkeypatch.setattr(search, "ENTRIES", 9)
    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(30)], "doc_id long, plain string")
    assert retrieval.lexical_dense(d, d.where("doc_id < 9"), 3).count() == 27
    assert ["doc_id", "plain", "plain_tf", "plain_len"] in kept


def test_trials_share_one_search_and_equal_single_ones(spark, monkeypatch):
    passes, own = [], search.blocks
    monkeypatch.setattr(search, "blocks", lambda *x: passes.append(x) or own(*x))
    rows = [(i, f"m{i % 3} x" if i % 4 else " ", i % 5 == 0, f"t{i % 6}" if i % 7 else "", f"w{i % 7} w{i % 5} t{i % 2} common" if i % 6 else "") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, metadata string, useless boolean, title string, main_text string")
    q, grid = d.where("doc_id < 25"), [{"metadata": 0.5, "title": 3.0, "main_text": 1.0}, {"metadata": 2.0, "title": 1.0, "main_text": 0.5}]
    got = retrieval.charm_trials(d, q, grid, 4).collect()
    assert len(passes) == 1
    for no, f in enumerate(grid):
        one = retrieval.charm(d, q, 4, f).collect()
        assert {(r.query_id, r.doc_id, round(r.score, 8), r.rank) for r in got if r.trial == no} == {(r.query_id, r.doc_id, round(r.score, 8), r.rank) for r in one}


def test_paper_queries_drop_those_without_gold(spark):
    papers = spark.createDataFrame([("p1", 1), ("p2", 2)], "id string, corpusid long")
    q = spark.createDataFrame([("q1", "s", "t", None, "2", [2, 9, 1]), ("q2", "s", "u", "1", None, [9])], "id string, query_set string, query string, specificity string, quality string, corpusids array<long>")
    docs, rel = align.query_documents(q, papers)
    assert [(r.query_id, r.candidate_ids) for r in rel.collect()] == [("q1", ["p2", "p1"])] and docs.count() == 1
    assert json.loads(docs.first().structured_fields.categorical) == {"specificity": "", "quality": "2"}


def test_metadata_and_hierarchy_enrichment(spark, tmp_path):
    cache = tmp_path / "m.json"
    cache.write_text(json.dumps({"7": {"corpusId": 7, "authors": [{"name": "A", "affiliations": ["z", "b"]}, {"name": "B", "affiliations": ["b"]}], "fieldsOfStudy": ["F"]}}))
    docs = spark.createDataFrame([("7", ["x"], ["y"], [], "{}", "{}"), ("8", ["x"], ["y"], [], "{}", '["a"]')], "native_id string, people array<string>, organizations array<string>, topics array<string>, categorical string, hierarchical string")
    got = {r.native_id: r for r in enrich.with_metadata(docs, readers.metadata_cache(spark, str(cache))).collect()}
    assert got["7"].people == ["A", "B"] and got["7"].organizations == ["b", "z"] and json.loads(got["7"].categorical)["fields_of_study"] == ["F"]
    assert got["8"].people == ["x"]
    h = spark.createDataFrame([("7", "junk"), ("8", '{"a": 1}')], "native_id string, hierarchy_info string")
    got = {r.native_id: r.hierarchical for r in enrich.with_hierarchy(docs, h).collect()}
    assert json.loads(got["7"]) == {"errors": ["JSONDecodeError"]} and got["8"] == '["a"]'
    with pytest.raises(ValueError):
        enrich.enriched(docs, [])


def test_sampling_and_splits(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    n = {r.split: r["count"] for r in sampling.split(ids, "id", {"a": 0.1, "b": 0.15, "c": 0.75}, 0).groupBy("split").count().collect()}
    assert abs(n["a"] - 200) < 60 and abs(n["c"] - 1500) < 100
    q = spark.createDataFrame([(str(i), str(i + 1)) for i in range(0, 100, 2)], "query_id string, candidate_id string")
    got = {r.id for r in sampling.grouped_sample(q, ids, 31).collect()}
    assert len(got) == 31 and sum(int(x) + 1 in map(int, got) for x in got if int(x) % 2 == 0 and int(x) < 100) >= 15


def test_validation(spark):
    assert [r.x for r in spark.createDataFrame([("I need the title", ), ("I need the title {}",), (None,)], "t string").select(validate.babble(F.col("t")).alias("x")).collect()] == [True, False, False]
    d = spark.createDataFrame([(1, None, 2), (2, None, 2), (3, "a", 2)], "doc_id long, a string, b int")
    assert {r.doc_id for r in validate.duplicates(d, ["a", "b"]).collect()} == {1, 2}
    assert validate.fingerprint(d.repartition(3), ["doc_id", "a"]).first() == validate.fingerprint(d.coalesce(1), ["doc_id", "a"]).first()
    with pytest.raises(ValueError):
        validate.checked_budget(spark.createDataFrame([("m", 5.0)], "model string, cost double"), 1.0)


def test_bench_registry_and_search(spark):
    d = spark.createDataFrame([(i, "paper", f"w{i} w{i + 1}", "", True) for i in range(12)], "doc_id long, source_type string, plain string, labelled string, is_candidate boolean")
    q, t = d.where("doc_id < 3"), spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "query_id long, doc_id long")
    got = bench.run(d, q, t, ["bm25", "dense"], (5,))
    assert got.where("metric = 'recall' and mean = 1.0").count() == 2
    trials = bench.search({"a": [1, 2], "b": [3]}, lambda s: metrics.evaluate(retrieval.bm25(d, q, 5), t, (5,)), 99, k=5)
    assert len(trials) == 2


def test_runs_search_only_queries_that_can_find_a_judged_document(spark, monkeypatch):
    import random

    rnd = random.Random(7)
    words = [" ".join(f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randint(3, 30))) for _ in range(400)]
    words[5], words[6], words[7], words[390] = "", words[8], words[9] + " w1", words[8]  # empty, copies, a near copy
    d = spark.createDataFrame([(i, "paper", w, f"{w} l{i % 7}", True) for i, w in enumerate(words)], "doc_id long, source_type string, plain string, labelled string, is_candidate boolean")
    near = [(8, 6), (8, 390), (6, 8), (9, 7), (7, 9), (5, 0), (20, 5), (21, 21), (22, 9999)]
    t = spark.createDataFrame(near + [(q, rnd.randrange(400)) for q in range(10, 90) for _ in range(2)], "query_id long, doc_id long").distinct()
    q = d.where("doc_id < 90")
    searched = []

    def spied(index, entries, *args, **kw):
        searched.append(entries.select("query_id").distinct().count())
        return search.sparse_search(index, entries, *args, **kw)

    for name, part in (("bm25", 100), ("dense_labels", 100), ("dense", 20_000)):
        monkeypatch.setattr(search, "FIRST", part)
        want = {tuple(r) for r in metrics.means(metrics.evaluate(bench.METHODS[name](d, q, 10), t)).collect()}
        with monkeypatch.context() as m:
            m.setattr(retrieval, "sparse_search", spied)
            got = {tuple(r)[1:] for r in bench.run(d, q, t, [name]).collect()}
        assert got == want and max(v for *_, v in want) > 0.02 and 5 <= searched[-1] < 45, (name, part, searched[-1])


def test_training_lowers_alphas_when_messages_help(spark):
    start = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.9), ("q", 3, 0.5)], "query_id string, doc_id long, h double")
    edges, t = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([("q", 2)], "query_id string, doc_id long")
    a = bench.train_alphas(start, edges, t, layers=1, seeds=1, epochs=2, rate=0.1)
    assert a[0] < 0.5
    assert bench.train_alphas(start, edges, t.where("false"), layers=1, epochs=1) == [0.5]


def test_manifest(spark):
    b = spark.createDataFrame([("b1", "completed", ["1"]), ("b2", "in_progress", ["2"]), ("b3", "failed", ["3"])], "batch_id string, status string, paper_ids array<string>")
    p, x = spark.createDataFrame([(c,) for c in "12345"], "id string"), spark.createDataFrame([("5",)], "id string")
    assert [r.id for r in bench.unsubmitted(p, bench.without_failed(b), x).orderBy("id").collect()] == ["3", "4"]
    assert bench.batch_slots(b) == 1 and bench.manifest_counts(b).where("active").count() == 1


def test_sources_and_sinks(spark, tmp_path):
    flat = spark.createDataFrame([("1", "d", "paper", None, "t")], "id string, source_dataset string, source_type string, title string, main_text string")
    sinks.json_lines(align.nest(flat), f"{tmp_path}/docs")
    assert readers.documents(spark, f"{tmp_path}/docs", "paper").first().retrieval_metadata.is_candidate is True
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "candidate_id": "2", "relation_type": "citation"}\n\n{"query_id": "2", "candidate_ids": ["3"]}\n')
    assert {r.query_id: r.candidate_ids for r in readers.qrels(spark, f"{tmp_path}/q.jsonl").collect()} == {"1": ["2"], "2": ["3"]}
    (tmp_path / "l.csv").write_text("raw_label,normalized_path\nbug,a\nbug,b\n")
    m = readers.label_map(spark, f"{tmp_path}/l.csv")
    assert align.label_map(m).first().normalized_path == "b"
    e = spark.createDataFrame([(1, 2, "r", 1.0)], "src long, dst long, relation string, weight double")
    sinks.graph(e, f"{tmp_path}/g")
    assert readers.graph(spark, f"{tmp_path}/g").count() == 1 and readers.graph(spark, f"{tmp_path}/none").count() == 0
    sinks.results(spark.createDataFrame([("bm25", "mrr", None, 0.5), ("bm25", "ndcg", 10, 0.25)], "method string, metric string, k long, mean double"), {"k": 10}, f"{tmp_path}/r.json")
    assert {(r.metric, r.value) for r in readers.results(spark, f"{tmp_path}/r.json").collect()} == {("mrr_mean", 0.5), ("ndcg@10_mean", 0.25)}
    sinks.requests(flat, f"{tmp_path}/req", "id")
    tries = []

    def failing():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert readers.with_backoff(failing, sleep=lambda s: None) == "ok"
    assert readers.raw_issues(spark, f"{tmp_path}/nothing") is None


def test_streaming_counts(spark, tmp_path):
    rows = [("1", ["2", "3"]), ("2", None), ("4", ["2"])]
    spark.createDataFrame(rows, "id string, explicit_related_ids array<string>").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, explicit_related_ids array<string>").parquet(f"{tmp_path}/in")
    c = incremental.OrphanCounts(spark, f"{tmp_path}/counts")
    c.start(incremental.reference_deltas(stream), f"{tmp_path}/cp").awaitTermination()
    assert [(r.key, r.refs) for r in incremental.orphans(c.counts()).collect()] == [("3", 1)]
    c.add(spark.createDataFrame([("3", 0, 1)], incremental.COUNTS), 7)
    c.add(spark.createDataFrame([("3", 0, 1)], incremental.COUNTS), 7)
    assert c.counts().where("key = '3'").first().there == 1 and incremental.orphans(c.counts()).count() == 0


def test_attention_layer_equals_brute_force(spark):
    x = {1: 0.2, 2: -0.5, 3: 0.9}
    edges = [(1, 2), (3, 2), (3, 2), (2, 1)]
    f = spark.createDataFrame([(9, i, v) for i, v in x.items()], "query_id long, doc_id long, x double")
    e = spark.createDataFrame(edges, "src long, dst long")
    w, to, of = [0.5, -1.0], [0.3, 0.2], [1.0, -0.4]
    got = {r.doc_id: r.out for r in retrieval.attention(f, e, w, to, of).collect()}
    for i in x:
        sent = [x[i]] + [x[s] for s, d in edges if d == i]
        score = [sum(p * q for p, q in zip(w, to)) * x[i] + sum(p * q for p, q in zip(w, of)) * s for s in sent]
        p = [math.exp(s if s > 0 else 0.2 * s) for s in score]
        m = sum(a * b for a, b in zip(p, sent)) / sum(p)
        assert all(math.isclose(a, b * m) for a, b in zip(got[i], w))
    net = {"weight": w, "to": to, "of": of}
    assert retrieval.attend(f, e, net, {"weight": [1.0, 1.0], "to": [0.1], "of": [0.2]}, 3).count() == 3


def test_judgment_selection(spark):
    long = spark.createDataFrame([("1", "2", "citation"), ("1", "9", "citation"), ("2", "1", "linked_issue"), ("8", "1", "citation")], "query_id string, candidate_id string, relation_type string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    assert align.of_relations(long, []).count() == 4 and align.of_relations(long, ["citation"]).count() == 3
    assert [r.query_id for r in align.of_relations(long, ["citation"], True).collect()] == ["2"]
    assert {r.query_id for r in align.trainable(long, ids).collect()} == {"2"}
    assert {r.query_id for r in align.trainable(long, ids, every=False).collect()} == {"1", "2"}
    assert align.valid_qrels(long, ids).count() == 2


def test_metric_choice_and_trials(spark):
    m = spark.createDataFrame([("ndcg", 10, 0.5), ("ndcg", 5, 0.4), ("mrr", None, 0.3), ("map", 10, 0.2)], "metric string, k long, mean double")
    assert [(r.metric, r.k, r.place) for r in metrics.selected(m, None, [10]).orderBy("place").collect()] == [("mrr", None, 1), ("map", 10, 2), ("ndcg", 10, 3)]
    assert [r.metric for r in metrics.selected(m, ["map"]).collect()] == ["map"]
    r = spark.createDataFrame([(0, "q", 1, 1), (1, "q", 2, 1), (1, "q", 1, 2)], "trial long, query_id string, doc_id long, rank long")
    t = spark.createDataFrame([("q", 1)], "query_id string, doc_id long")
    assert {x.trial: x.ndcg for x in bench.trial_means(r, t).collect()} == {0: 1.0, 1: round(1 / math.log2(3), 6)}
    assert len({str(s) for s in bench.settings({"a": [1, 2], "b": [3, 4]}, 99)}) == 4


def test_wrapping_slugs_and_answers(spark):
    df = spark.createDataFrame([(["a" * 30, "b" * 30, "c" * 20, "d" * 90],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(text.wrapped(F.col("p"))).collect()] == ["a" * 30 + " | " + "b" * 30 + "\n" + "c" * 20 + "\n" + "d" * 90, ""]
    a = [json.dumps({"output_text": "x"}), json.dumps({"output": [{"content": [{"type": "t", "text": "n"}, {"type": "output_text", "text": "y"}]}, {}]}), "{}", None, "broken"]
    got = spark.createDataFrame([(x,) for x in a], "r string").select(text.output_text(F.col("r"))).collect()
    assert [r[0] for r in got] == ["x", "y", "", "", ""]


def test_strict_lines_and_content_key(spark, tmp_path):
    from pyspark.errors import PySparkException

    from corpuscle import schema

    (tmp_path / "a.jsonl").write_text('{"query_id": "1"}\n\n{"query_id": "2"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/a.jsonl", schema.QREL).count() == 2
    with pytest.raises(PySparkException):
        readers.json_lines_strict(spark, f"{tmp_path}/a.jsonl", schema.QREL).collect()
    built = []

    def index(settings, rows):
        def build():
            built.append(1)
            return rows

        return readers.indexed(spark, f"{tmp_path}/i", rows, ["id"], settings, build)

    one = spark.range(3)
    assert index({"m": 1}, one).count() == index({"m": 1}, one).count() == 3 and len(built) == 1
    index({"m": 2}, one), index({"m": 1}, spark.range(4))
    assert len(built) == 3


def test_batches_go_on_after_failures_and_restarts(spark, tmp_path):
    class Service:
        def __init__(self):
            self.jobs = []

        def submit(self, path):
            self.jobs.append(path)
            return str(len(self.jobs) - 1)

        def status(self, batch_id):
            return "failed" if batch_id == "1" else "completed"

        def download(self, batch_id, path):
            asked = spark.read.text(self.jobs[int(batch_id)])
            said = F.struct(F.struct(F.upper(F.get_json_object("value", "$.q")).alias("output_text")).alias("body"))
            line = F.struct(F.get_json_object("value", "$.custom_id").alias("custom_id"), said.alias("response"))
            asked.select(F.to_json(line).alias("value")).write.text(path)

    rows = spark.createDataFrame([(f"{i}", json.dumps({"custom_id": f"{i}", "q": f"w{i}"})) for i in range(10)], "id string, value string")
    service = Service()
    b = bench.Batches(spark, str(tmp_path), service)
    b.prepare(rows, "id", 3)
    assert b.step() and len(service.jobs) == 2
    got = bench.Batches(spark, str(tmp_path), service).run(0.0)  # another process goes on
    assert {r.custom_id: r.answer for r in got.collect()} == {f"{i}": f"W{i}" for i in range(10)}
    assert len(service.jobs) == 5 and not b.step()


def test_backoff_tells_statuses_apart():
    calls = []

    def busy():
        calls.append(1)
        raise readers.Status(503 if len(calls) < 3 else 404)

    with pytest.raises(readers.Status):
        readers.with_backoff(busy, sleep=lambda s: None)
    assert len(calls) == 3


def test_fragments_keep_their_values(spark):
    raw = '{"a": {"x": [1, "b"]}}, {"n": 2.5, "t": "say \\"hi\\"", "u": null, "a": {"y": true}}'
    r = spark.createDataFrame([(raw,)], "t string").select(structured.parse_hierarchy(F.col("t")).alias("p")).first().p
    assert json.loads(r.value) == {"a": {"y": True}, "n": 2.5, "t": 'say "hi"', "u": None}


def test_requests(spark):
    from corpuscle.operators import requests

    p = spark.createDataFrame([("1", "T {x}", None, ["a", "b"], None)], "id string, title string, main_text string, organizations array<string>, topics array<string>")
    f = requests.paper_fields(p)
    assert f.first().affiliations == "a;b" and f.first().topics == ""
    line = requests.request_lines(f, "id", requests.prompt('{"t": "{title}"} {abstract}', "title", "abstract"), "m").first()
    assert json.loads(line.value)["body"] == {"model": "m", "input": '{"t": "T {x}"} '}
