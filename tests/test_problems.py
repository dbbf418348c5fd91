"""References, packed fields and nested records: worked cases, odd input and brute force."""

import ast
import datetime as dt
import json
import os
import random

import pytest

from corpuscle.operators import nested, packed, references
from corpuscle.streaming import incremental
from tests.oracle import DATA

T = dt.datetime


def orphans(spark, docs, qrels):
    d = spark.createDataFrame(docs, "id string, explicit_related_ids array<string>, ingested_at timestamp, removed_at timestamp, `at` string")
    q = spark.createDataFrame(qrels, "query_id string, candidate_ids array<string>, judged_at timestamp, key string")
    return sorted(tuple(r) for r in references.found(d, q).collect())


def test_references_follow_time(spark):
    docs = [
        ("1", ["2", "#3", " 4\n", "5.0", "n/a", "", None], T(2024, 1, 5), None, "x"),
        ("2", None, T(2024, 1, 1), T(2024, 1, 3), "x"),  # removed before
        ("3", [], T(2024, 1, 5), None, "x"),  # ingested at the very time
        ("4", [], T(2024, 1, 1), T(2024, 1, 5), "x"),  # removed at the very time
        ("6", [], T(2024, 1, 1), T(2024, 1, 2), "x"), ("6", [], T(2024, 1, 3), None, "x"),  # two periods
        ("7", [], T(2024, 1, 9), T(2024, 1, 3), "x"),  # ends before it begins
        (None, ["1"], None, None, "x"),
    ]
    qrels = [("1", ["6", "7"], T(2024, 2, 1), "k"), ("1", ["6", "6"], T(2024, 1, 2), "k"), ("9", None, T(2024, 1, 1), "k")]
    assert orphans(spark, docs, qrels) == [
        ("documents", "1", "2", "2024-01"), ("documents", "1", "4", "2024-01"), ("documents", "1", "5", "2024-01"),
        ("qrels", "1", "6", "2024-01"), ("qrels", "1", "7", "2024-02"),
    ]
    assert orphans(spark, [], []) == []


def test_orphans_gather_no_periods(spark):
    d = spark.createDataFrame([], "id string, explicit_related_ids array<string>, ingested_at timestamp, removed_at timestamp")
    q = spark.createDataFrame([], "query_id string, candidate_ids array<string>, judged_at timestamp")
    plan = references.found(d, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lead(" not in plan


def test_removals_leave_orphans(spark):
    d = spark.createDataFrame([("1", ["#2", " 3.0"], None), ("2", None, T(2024, 1, 2)), ("3", None, None)], "id string, explicit_related_ids array<string>, removed_at timestamp")
    counts = incremental.merge_counts(spark.createDataFrame([], incremental.COUNTS), incremental.reference_deltas(d))
    assert [tuple(r) for r in incremental.orphans(counts).collect()] == [("2", 1)]


def test_existence_of_a_hot_key_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(9000))
        rows.append(("hot", a, a + dt.timedelta(minutes=rng.randrange(1, 60)) if rng.random() < 0.98 else None))
    rows = [r for r in rows if r[2] is not None]
    df = spark.createDataFrame(rows, "id string, a timestamp, b timestamp")
    periods = [(r.opens, r.closes) for r in references.existence_periods(df, "id", "a", "b").collect()]
    for m in range(0, 9100, 7):
        t = T(2024, 1, 1) + dt.timedelta(minutes=m)
        assert any(a <= t < b for _, a, b in rows) == any(a <= t and (b is None or t < b) for a, b in periods)


@pytest.mark.parametrize(
    "cell,values",
    [
        (None, []), ("", []), (" | ", []), ("[]", []), ("a|b", ["a", "b"]), ("a||b|", ["a", "b"]),
        ('"api, public"; x', ["api, public", "x"]), ('"says ""later"""|y', ['says "later"', "y"]),
        ('["a", "the \\"big\\" one", null, " "]', ["a", 'the "big" one']), ("['x|y', 'z']", ["x|y", "z"]),
        ("won't happen, it", ["won't happen", "it"]), ("[not a list|b", ["[not a list", "b"]), ('"open|b', ['"open', "b"]),
        ("a\n\n b\tc", ["a", "b", "c"]),
    ],
)
def test_label_cells(cell, values):
    assert packed.split_cell(cell, packed.LABELS.pattern) == values


def test_comments_keep_commas_semicolons_and_line_breaks():
    split = lambda c: packed.split_cell(c, packed.COMMENTS.pattern)
    assert split("a, b; c\nd ;; e\n---\nf | g || h") == ["a, b; c\nd", "e", "f", "g", "h"]
    assert split('"a || b" || c') == ["a || b", "c"]


def test_known_values_protect_their_delimiters():
    known = packed.automaton(["api, public", "x|y"])
    p = packed.LABELS.pattern
    assert packed.split_cell("api, public, z|x|y", p, known) == ["api, public", "z", "x|y"]
    assert packed.split_cell("api, publicity", p, known) == ["api", "publicity"]


def test_learning_counts_cells_with_whole_values(spark):
    cells = [(f'"a, b"; c{i}',) for i in range(3)] + [('["a, b", "d|e"]',), ("plain, text",), (None,)]
    df = spark.createDataFrame(cells, "labels string")
    assert packed.gathered(packed.learn(df, "labels", packed.LABELS, support=4)) == ["a, b"]
    assert packed.gathered(packed.learn(df.where("false"), "labels", packed.LABELS)) == []


def values_of(df, most=packed.DICTIONARY_BYTES):
    styles = {"labels": packed.LABELS}
    got = packed.split_fields(df, "issue_key", styles, {"labels": packed.learn(df, "labels", packed.LABELS)}, most)
    return sorted(tuple(r) for r in got.collect())


def test_learnt_values_change_cells_and_unrelated_rows_do_not(spark):
    rows = [("1", '"api, public"|x'), ("2", '["api, public"]'), ("3", "api, public; y"), ("4", '"once, seen"'), ("5", "once, seen"), ("6", None), ("3", "api, public; y")]
    df = spark.createDataFrame(rows, "issue_key string, labels string")
    got = values_of(df)
    assert [r for r in got if r[0] == "3"] == [("3", "labels", 1, "api, public")] * 2 + [("3", "labels", 2, "y")] * 2
    assert [r[3] for r in got if r[0] == "5"] == ["once", "seen"]
    more = spark.createDataFrame([(f"u{i}", f'"w, {i % 7}", z{i}') for i in range(300)], "issue_key string, labels string")
    assert [r for r in values_of(df.union(more)) if not r[0].startswith("u")] == got
    assert values_of(df, most=3) == got  # a dictionary too large to be sent


def test_long_cell_round_trip():
    values = [f"v {i}, {i}" for i in range(3000)]
    assert packed.split_cell("|".join(json.dumps(v) for v in values), packed.LABELS.pattern) == values
    assert packed.split_cell(repr(values), packed.LABELS.pattern) == ast.literal_eval(repr(values))


def children(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads, 1)), "raw_id long, payload string").selectExpr("*", "'x' AS pos", "1 AS child")
    return sorted(tuple(r) for r in nested.issue_children(df).collect())


def test_issue_children_of_every_shape(spark):
    labels = {"edges": [{"node": {"label": "a"}}, None, {"node": None}, {"node": {"label": {"name": "b", "color": "f"}}}]}
    pulls = {"nodes": [{"pull_info": {"pull_url": "u1", "pull_no": 1}}, {}, {"pull_info": {"pull_url": None}}, {"pull_info": {"pull_url": "u4"}}]}
    got = children(spark, [
        json.dumps({"issue_labels": labels, "timelineItems": pulls}),
        "﻿" + json.dumps({"issue_labels": {"edges": {"node": {"label": "lone"}}}, "timelineItems": {"nodes": {"pull_info": {"pull_url": "u"}}}}),
        json.dumps(json.dumps({"issue_labels": ["x", None, "y"]})),
        json.dumps([{"issue_labels": json.dumps(labels), "timelineItems": None}]),
        json.dumps({"issue_labels": labels})[:-3], "", None, "[]", "null", "7",
    ])
    assert got == [
        (1, "label", 1, "a"), (1, "label", 4, "b"), (1, "pull", 1, "u1"), (1, "pull", 4, "u4"),
        (2, "label", 1, "lone"), (2, "pull", 1, "u"),
        (3, "label", 1, "x"), (3, "label", 3, "y"),
        (4, "label", 1, "a"), (4, "label", 4, "b"),
    ]
    assert children(spark, [None]) == []


def test_inlining_finds_repeated_shared_and_recursive_elements(spark):
    rows = [
        {"id": 1, "owner": {"place": {"city": "a", "zip": 1}}, "depot": {"place": {"city": "b", "zip": 2}}, "tags": ["x", "y"],
         "part": {"name": "p", "part": {"name": "q"}}},
        {"id": 2, "tags": "z"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "k long, j string")
    g = nested.analyse(df, "j")
    assert set(g.tables.values()) == {"place", "tags", "part"}
    s = nested.shred(df, "k", "j", g)
    places = nested.flat_table(s, g, "place", "k").orderBy("row_id").collect()
    assert [(p.node, p.city, p.zip) for p in places] == [("depot.place", "b", "2"), ("owner.place", "a", "1")]
    parts = nested.flat_table(s, g, "part", "k").orderBy("row_id").collect()
    assert [(p.name, p.parent_tbl, p.parent_id) for p in parts] == [("p", "", ""), ("q", "part", parts[0].row_id)]
    assert [(t.k, t.pos, t.value) for t in nested.flat_table(s, g, "tags", "k").orderBy("k", "pos").collect()] == [(0, 1, "x"), (0, 2, "y"), (1, 1, "z")]


def brute_children(raw_id, payload):
    try:
        o = json.loads((payload or "").lstrip("﻿"))
        o = json.loads(o) if isinstance(o, str) else o
    except ValueError:
        return
    for x in o if isinstance(o, list) else [o]:
        if not isinstance(x, dict):
            continue
        for field, child, name in (("issue_labels", "label", "edges"), ("timelineItems", "pull", "nodes")):
            v = x.get(field)
            v = json.loads(v) if isinstance(v, str) else v
            v = v.get(name) if isinstance(v, dict) else v
            for pos, e in enumerate([v] if isinstance(v, dict) else v or [], 1):
                if child == "label":
                    e = ((e or {}).get("node") or {}).get("label") if not isinstance(e, str) else e
                    e = e.get("name") if isinstance(e, dict) else e
                else:
                    e = ((e or {}).get("pull_info") or {}).get("pull_url")
                if e is not None:
                    yield raw_id, child, pos, e


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_issue_children_equal_brute_force(spark):
    raw = spark.read.parquet(f"{DATA}/issues_raw.parquet")
    expected = {x for r in raw.collect() for x in brute_children(r.raw_id, r.payload)}
    assert {tuple(r) for r in nested.issue_children(raw).collect()} == expected


def test_any_depth_of_nesting(spark):
    deep, lists = '{"a": ' * 1500 + "1" + "}" * 1500, "[" * 900 + "]" * 900
    many = {"x": 1}
    for i in range(300):
        many = {f"n{i}": many, "y": i}
    df = spark.createDataFrame([(1, deep), (2, '{"b": ' + lists + "}"), (3, json.dumps(many))], "raw_id long, payload string")
    rows = nested.shred(df, "raw_id", "payload").groupBy("raw_id").count().collect()
    assert {r.raw_id: r["count"] for r in rows}[1] == 1501
    assert nested.issue_children(df).count() == 0
    g = nested.analyse(df, "payload")
    assert len(nested.shred_record(many, g)[0][6]) == 301
    x = []
    for _ in range(100_000):
        x = [x]
    assert nested._text([x, {"k": "v"}]).endswith(', {"k": "v"}]')


def test_names_that_are_data_become_entries(spark):
    rows = [{"id": i, "by_user": {f"u{i}_{j}": {"n": j, "tags": ["t"]} for j in range(20)}} for i in range(50)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "k long, j string")
    g = nested.analyse(df, "j", most=100)
    assert g.maps == {"by_user"} and len(g.edges) < 20
    s = nested.shred(df, "k", "j", g)
    t = nested.flat_table(s, g, "by_user.*", "k")
    assert t.count() == 1000 and t.select("k", "name", "n").where("name = 'u7_3'").first()[:] == (7, "u7_3", "3")
    assert nested.flat_table(s, g, "by_user.*.tags", "k").select("row_id", "k").distinct().count() == 1000


def test_issue_links(spark):
    def node(u):
        return {"pull_info": {"pull_url": u}}

    full = {"issue_no": 7, "issue_url": "i", "issue_repository": {"nameWithOwner": "o/r"}, "timelineItems": {"nodes": [node("a"), {}, node("a")]}}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps({"timelineItems": {"nodes": node("b")}})), (3, None)], "raw_id long, payload string")
    got = sorted(tuple(r) for r in nested.issue_links(df).collect())
    assert got == [(1, 1, "i", "o/r#7", "a"), (1, 3, "i", "o/r#7", "a"), (2, 1, None, None, "b")]


def test_judgments_count_as_references_and_batches_are_folded(spark, tmp_path):
    c = incremental.OrphanCounts(spark, f"{tmp_path}/c", fold=3)
    q = spark.createDataFrame([("1", ["#5", "x", None, "6"])], "query_id string, candidate_ids array<string>")
    d = spark.createDataFrame([("5", [" 6 "], None)], "id string, explicit_related_ids array<string>, removed_at timestamp")
    for n, x in enumerate([incremental.judgment_deltas(q), incremental.reference_deltas(d), incremental.judgment_deltas(q), incremental.judgment_deltas(q)]):
        c.add(x, n)
        c.add(x, n)
    assert sorted((r.key, r.refs) for r in incremental.orphans(c.counts()).collect()) == [("6", 4)]
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")) == ["all2", "v3"]
