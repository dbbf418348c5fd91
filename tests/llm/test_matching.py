"""Canonical lists, near-duplicates and name variants against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import canon, names, neardup, queries


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


short = st.text(alphabet="abc", max_size=9)


@settings(max_examples=300, deadline=None)
@given(short, short)
def test_bit_parallel_distance(a, b):
    assert canon.levenshtein(a, b) == levenshtein(a, b)
    assert canon.typing_distance(a, b) <= levenshtein(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(short, max_size=40), short, st.integers(0, 4))
def test_tree_returns_every_key_within_the_threshold(keys, key, k):
    found = canon.BKTree(keys).within(key, k)
    assert sorted(found) == sorted((levenshtein(x, key), x) for x in set(keys) if levenshtein(x, key) <= k)


MAPPING = [
    (1, "build system", "topic/build "), (2, "needs reproduction", "stage/repro"), (3, "won't happen", "old"), (4, "won't happen", "outcome/no"),
    (5, "rank: low", "rank/low"), (6, "documentation", "topic/docs"), (7, "too slow", "kind/slow"), (8, " ", "none"), (9, None, "none"),
]
TYPED = {
    "build system": "topic/build", " BUILD System!": "topic/build", "system build": "topic/build", "buildsystem": "topic/build",
    "biuld sytem": "topic/build", "[build_system]": "topic/build", "ｂｕｉｌｄ ｓｙｓｔｅｍ": "topic/build", "needs rprdctn": "stage/repro",
    "needs repr.": "stage/repro", "wont happen": "outcome/no", "status/won't happen": "outcome/no", "rank: l0w": "rank/low",
    ":bug: rank: low": "rank/low", "documentatoins": "topic/docs", "d0cumentat1on": "topic/docs", "banana": "unmatched", "zx-42": "unmatched",
    "???": "unmatched", "Tóo slow": "kind/slow", "x" * 5000: "unmatched",
}


def test_mapping_of_typed_values(spark):
    m = spark.createDataFrame(MAPPING, "line_no long, raw_label string, normalized_path string")
    rows = [(i, v, "p") for i, v in enumerate(TYPED)] + [(100, None, "p"), (101, " \t", "p"), (0, list(TYPED)[0], "p")]
    t = spark.createDataFrame(rows, "typed_id long, raw_label string, normalized_path string")
    got = {r.typed_id: r.normalized_path for r in canon.map_rows(t, m).collect()}
    assert got == {i: p for i, p in enumerate(TYPED.values())}
    sharded = {r.value: r.normalized_path for r in canon.map_values(t, m, shard=3).collect()}
    assert sharded == TYPED
    assert {r.value for r in canon.unmatched(t, m).collect()} == {v for v, p in TYPED.items() if p == "unmatched"}
    assert {r.normalized_path for r in canon.map_rows(t, m.where("false")).collect()} == {"unmatched"}
    assert canon.map_rows(t.where("false"), m).count() == 0


def test_every_key_within_the_threshold_is_found():
    rng = random.Random(4)
    names_ = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 13))) for _ in range(150)]
    m = canon.Mapper([(i, n, n) for i, n in enumerate(names_)])
    keys = [k for k, v in m.keys.items() if any(x[3] != "broken" for x in v)]
    for n in names_:
        x = list(n)
        for _ in range(3):
            i = rng.randrange(len(x) - 1)
            x[i], x[i + 1] = x[i + 1], x[i]
        typed = "".join(x)
        got = {(d, k) for d, k, _ in m.near(typed, False)}
        if (0, typed) not in got:
            assert got == {(d, k) for k in keys if 0 < (d := canon.typing_distance(typed, k)) <= canon.threshold(min(len(k), len(typed)))}
    assert canon.Mapper([(1, "network", "n")]).best("entowrk")[2] == "n"


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sig = neardup.superminhash([np.unique(pool[:300]), np.unique(pool[100:]), np.unique(pool[:300])])
    assert (sig[0] == sig[2]).all() and abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    small = neardup.superminhash([pool[:1], pool[:2]])
    assert (small != neardup._EMPTY).all()


def shingle_set(title, text):
    w = neardup.words(title, text)
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 40 else None


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(45, 140))]
        for n in (0, 0, 2, 4, 6, 9)[: rng.randrange(1, 7)]:
            rows.append((len(rows), rng.choice([None, "", "A Title"]), " ".join(edited(rng, base, n))))
    rows += [(1000, None, None), (1001, "x", "too short"), (1002, "", ""), (1003, "Long", "word " * 50_000), (1004, "long", "WORD, " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, title string, main_text string").selectExpr("*", "1 AS rep", "'x' AS bands")
    near = neardup.NearDuplicates(df)
    got = {(r.doc_id_a, r.doc_id_b) for r in near.pairs().collect()}
    sets = {i: s for i, t, x in rows if (s := shingle_set(t, x)) is not None}
    ids = sorted(sets)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == expected and (1003, 1004) in got
    groups = {r.doc_id: r for r in near.groups().collect()}
    assert set(groups) == set(ids)
    assert {i: g.links for i, g in groups.items()} == {i: sum(i in p for p in expected) for i in ids}


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, None, " ".join(edited(rng, base, 1))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, title string, main_text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.NearDuplicates(df).pairs().collect()}
    sets = [shingle_set(None, x) for _, _, x in rows]
    assert got == {(a, b) for a in range(25) for b in range(a + 1, 25) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def crowd(rng, n, core, own):
    """Texts that share a run of words and have others of their own."""
    shared = [f"c{i}" for i in range(core)]
    return [" ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def test_boilerplate_brings_no_texts_together(spark):
    rng = random.Random(6)
    rows = [(i, None, x) for i, x in enumerate(crowd(rng, 400, 93, 58))]  # similarity 0.45
    rows += [(1000 + i, None, " ".join(edited(rng, rows[i][2].split(), 8))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, title string, main_text string")
    met = neardup.prefix_pairs(df, 0.6)
    sets = {i: shingle_set(None, x) for i, _, x in rows}
    ids = sorted(sets)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    found = [(r.a, r.b) for r in met.collect()]
    assert expected <= set(found) and len(expected) >= 50
    assert len(set(found)) < 400  # of 105,570 pairs


def test_prefixes_lose_no_pair_of_any_sizes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        base = crowd(random.Random(i // 12), 1, 20, 60)[0].split()
        rows.append((i, "", " ".join(edited(rng, base[: rng.randrange(45, 80)], rng.randrange(8)))))
    df = spark.createDataFrame(rows, "doc_id long, title string, main_text string")
    sets = {i: shingle_set(None, x) for i, _, x in rows}
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert len(expected) > 100
    for most in (0, 7, neardup.FREQUENT):
        frequent = neardup.frequent_shingles(df, most=most) if most else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        p = neardup.prefixes(df, 0.6, frequent)
        assert p.where("indexed and at > size").count() == 0
    assert expected <= {(r.a, r.b) for r in neardup.prefix_pairs(df, 0.6).collect()}


def test_groups_have_every_document(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, long), (2, "", long), (3, "A b", "c"), (4, "a", "B, c!"), (5, "a", "c b"), (6, None, None), (7, "", "..."), (8, "one", None), (9, "İx", "ß_y")]
    spark.createDataFrame(rows, "doc_id long, title string, main_text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.group_id, r.links) for r in queries.p3_groups(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 3, 1), 4: (3, 3, 1)} | {i: (i, i, 0) for i in (5, 6, 7, 8, 9)}


def test_near_duplicates_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, title string, main_text string")
    near = neardup.NearDuplicates(df)
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(7)
    strings = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(150)}
    df = spark.createDataFrame([("x", s) for s in strings] + [("y", next(iter(strings)))], "space string, s string")
    got = {(r.a, r.b) for r in names.near_pairs(df, 2).collect()}
    assert got == {(a, b) for a in strings for b in strings if a < b and levenshtein(a, b) <= 2}


PEOPLE = [
    ["Robert Matovabon", "Matovabon, Robert", "MATOVABON Robert", "Bob Matovabon", "Dr. Robert Matovabon", "R. Matovabon", "Robert K. Matovabon", "Robert Matóvabon", "Robert Mtaovabon", "R.K. Matovabon", "robert matovabon"],
    ["Ingrid Matovabon", "Matovabon, Ingrid"],
    ["Florian Syhorirul", "F. Syhorirul"], ["Fumiko Metazysan"], ["Felix Metazysan"],
    ["Z. Nemesisin", "Nemesisin, Z.", "Z. Nemesissin"],
]
ORGS = [
    ["University of Metitisen", "Univ. of Metitisen", "UNIVERSITY OF METITISEN", "U. of Metitisen", "University of Metiitisen"],
    ["Kymuzyham Research Laboratories", "Kymuzyham Res. Lab.", "Research Laboratories of Kymuzyham"], ["Metitisen Institute of Technology", "Institute of Technology, Metitisen", "Metitisen Instiute of Technology"],
    ["Nat'l Ctr. Sezolufil Studies", "National Centre for Sezolufil Studies"], ["Livazapit Foundation", "The Livazapit Foundation (non-profit)", "Livazapit Fdn."],
]


def test_name_variants(spark):
    rows = [(i, [n, None, "n/a", "et al.", ""], None) for i, n in enumerate(x for g in PEOPLE for x in g)] + [(99, ["F. Metazysan"], [])]
    rows += [(200 + i, None, [n, "unknown"]) for i, n in enumerate(x for g in ORGS for x in g)]
    docs = spark.createDataFrame(rows, "doc_id long, people array<string>, organizations array<string>").selectExpr("*", "'x' AS name", "1 AS entity")
    nick = spark.createDataFrame([("Robert", "Bob"), (None, "x")], "given_name string, nickname string")
    got = {tuple(r) for r in names.variant_pairs(docs, nick).collect()}
    expected = {(f, min(a, b), max(a, b)) for f, groups in (("people", PEOPLE), ("organizations", ORGS)) for g in groups for a in g for b in g if a != b}
    assert got == expected
    assert names.variant_pairs(docs.where("false"), nick).count() == 0


def test_abbreviations_are_learnt_beside_the_same_rest(spark):
    said = ["Institute of Foox Barx", "Inst. Foox Barx", "Ins Foox Barx", "Institution Nowhere", "Sol Research", "School of Foox", "Schl Foox", "Sol Nowhere", "Zedd Natl. Labs", "National Labs Zedd", None, ""]
    df = spark.createDataFrame([("organizations", n) for n in said if n is not None] + [("people", "Inst Person")], "field_name string, name string")
    assert names.abbreviations(df) == {"inst": "institute", "ins": "institute", "schl": "school", "natl": "national"}
    assert names.organisation("Sol Research", {}) == ("research", "sol") and names.organisation("Insitute of X", {}) == ("institute", "x")
    assert names.abbreviations(df.where("false")) == {}
    assert names.abbreviates("fdn", "foundation") and not names.abbreviates("foundation", "foundation") and not names.abbreviates("ndf", "foundation")
