"""Encoding, cutting, mixing and truncation."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import chunks, encode, mix, truncated

VOCABULARY = encode.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.load_ranks(VOCABULARY), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n'0🙏é\x1c ", max_size=200))
def test_encoding_equals_the_public_encoder(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    enc = encode.encoder(VOCABULARY)
    ids = enc.encode(text)
    assert ids == reference.encode_ordinary(text) and reference.decode(ids) == text and enc.count(text) == len(ids)


def test_merges_of_long_pieces(reference):
    rng = random.Random(2)
    for n in (1, 2, 3, 1000, 20_000):
        s = "".join(rng.choice("abcde") for _ in range(n))
        assert encode.merge_piece(s.encode(), encode.load_ranks(VOCABULARY)) == reference._core_bpe.encode_single_piece(s.encode())


def test_encoding_of_tables(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, "", 9), (3, None, 9), (3, None, 9), (4, "x" * 30_000, 9)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert got[1] == [64, 275] and got[2] == [] and got[3] == [] and len(got[4]) > 100
    assert encode.encode_corpus(df).count() == 5 and encode.encode_corpus(df.where("false")).count() == 0
    assert {r.doc_id: r.n for r in encode.encode_corpus(df, out_col="n", counts_only=True).collect()}[1] == 2


def check_pieces(text, limit, overlap):
    bodies = chunks.cut_text(text, limit, overlap)
    assert bodies[0][0] == 0 and bodies[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(bodies, bodies[1:]))
    pieces = [text[max(0, a - overlap) : b] for a, b in bodies]
    assert all(len(p) <= limit for p in pieces)
    for p, q in zip(pieces, pieces[1:]):
        assert q.startswith(p[-overlap:] if overlap else "")
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n。!", min_size=0, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_pieces_end_at_natural_boundaries():
    paragraphs = ["Some words here. " * 12 + "\n\n" for _ in range(30)]
    pieces = check_pieces("".join(paragraphs), 1000, 50)
    assert all(p.endswith("\n\n") for p in pieces)
    sentences = check_pieces("One two three four. " * 300, 1000, 50)
    assert all(p.endswith(". ") for p in sentences)
    words = check_pieces("word " * 2000, 1000, 50)
    assert all(p.endswith(" ") for p in words)
    check_pieces("x" * 100_000, 4000, 200)


def test_pieces_of_tables(spark):
    df = spark.createDataFrame([(1, "a " * 2000, "z"), (2, "a " * 2001, "z"), (2, "a " * 2001, "z"), (3, None, "z"), (4, "", "z"), (5, "🙏" * 4001, "z")], "doc_id long, main_text string, piece string")
    got = chunks.split_texts(df)
    assert {(r.doc_id, r["count"]) for r in got.groupBy("doc_id").count().collect()} == {(2, 4), (5, 2)}
    assert chunks.split_texts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chunks.split_texts(df, limit=100, overlap=100)


def test_mix_of_few_documents_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, str(i), s, None, " ".join(["word"] * rng.randrange(20, 200))) for i, s in enumerate("a" * 30 + "b" * 40 + "c" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, id string, source string, ingested_at timestamp, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 1)], "source string, target_share double, max_repeats int")
    for total in (8000.0, None):
        for r in mix.report(docs, targets, total).collect():
            assert abs(r.share_reached - r.target_share) < 0.01


def test_mix_reaches_its_shares(spark):
    rows = [(i, str(i), "big", f"some words number {i}", None) for i in range(3000)] + [(9000 + i, str(9000 + i), "small", f"a few words {i}", None) for i in range(300)]
    rows += [(9999, "9001", "small", "exported twice", None), (9998, "x", None, "no source", None), (9997, "y", "big", None, None), (9996, "z", "other", "not wanted", None)]
    docs = spark.createDataFrame(rows, "doc_id long, id string, source string, text string, ingested_at timestamp")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mix.mix(docs, targets).collect()
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(n for d, n in uses.items() if d >= 9000) <= 3 and max(n for d, n in uses.items() if d < 9000) == 1
    assert 9001 not in uses or 9999 not in uses
    assert sorted(got) == sorted(mix.mix(docs.repartition(7), targets).collect())
    report = {r.source: r for r in mix.report(docs, targets).collect()}
    assert abs(report["big"].share_reached - 5 / 9) < 0.02 and report["absent"].share_reached == 0.0
    assert sum(r.mixed_tokens for r in report.values()) == sum(r.n_tokens for r in got)
    capped = {r.source: r for r in mix.report(docs, targets, total_tokens=1e6).collect()}
    assert capped["small"].rate == 3.0 and capped["big"].rate == 1.0
    assert mix.mix(docs.where("false"), targets).count() == 0 and mix.mix(docs, targets.where("false")).count() == 0


WORDS = "system model reader parser engine buffer network window server record stream folder filter bridge vector signal".split()


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = [" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(6)]
        text = " ".join(s) + rng.choice(["", "", "\n\nBest regards", "\n\nVersion 1.2"])
        cut = i % 5 == 0
        if cut:
            text = text[: rng.randrange(60, 200)]
            while text[-1] in ". ":
                text = text[:-1]
            text = text[:-2] + rng.choice(["", "…", " [more]", "-"])
        out.append((i, "src", "en", None, text, text, cut))
    return out


def test_truncation_on_held_out_cases(spark):
    df = spark.createDataFrame(corpus(1500, 4), "doc_id long, source string, lang string, title string, main_text string, text string, cut boolean")
    found = {r.doc_id for r in truncated.found(df).collect()}
    true = {r.doc_id for r in df.where("cut").collect()}
    assert len(found & true) / len(true) > 0.8 and len(found & true) / len(found) > 0.9
    share = truncated.shares(df).first()
    assert share.texts == 1500 and share.cut_texts == len(found)


ROWS = "txt string, lang string, col string"


def known(model, text, lang="en"):
    """The orders of the contexts of this end that the model has."""
    codes = truncated._codes("\n" * (truncated.WIDE + 1) + text.casefold())
    seeds = np.full(len(codes), truncated._seed(lang, "main_text"), np.uint64)
    keys = truncated.context_keys(codes, seeds, np.array([len(codes) - 1]))
    return [n for n, k in zip(truncated.ORDERS, keys) if model._at(int(k[0])) is not None]


def test_short_contexts_are_kept_in_large_inputs(spark, monkeypatch):
    monkeypatch.setattr(truncated, "ONE_IN", 20)
    rows = [(f"Report {WORDS[i % 16]} {WORDS[i // 16]}", "en", "main_text") for i in range(200)] + [("The quick brown foxq", "en", "main_text")]
    model = truncated.Model(truncated.train(spark.createDataFrame(rows, ROWS)))
    assert known(model, "The quick brown foxq") == [2, 3]


def test_share_of_stops_is_by_language(spark, monkeypatch):
    monkeypatch.setattr(truncated, "ONE_IN", 20)
    rows = [(f"Report {i} of the {WORDS[i % 16]}", "en", "main_text") for i in range(400)]
    rows += [(f"{WORDS[i]} {WORDS[-i]}, mit freundlichen Gruessen", "de", "main_text") for i in range(8)]
    model = truncated.Model(truncated.train(spark.createDataFrame(rows, ROWS)))
    assert known(model, rows[-1][0], "de") == list(truncated.ORDERS)


def sentences(rng, n):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n))


def found_in(spark, texts):
    rows = [(i, "src", "en", None, t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, title string, main_text string, text string")
    return {r.doc_id for r in truncated.found(df).collect()}


@pytest.mark.parametrize("size", [1, 8])
def test_a_shared_closing_line_is_complete(spark, size):
    rng = random.Random(7)
    closing = "\n\n" + "sent by the reader of the stream folder and the record buffer " * size + "from the window"
    texts = [sentences(rng, 6) + (closing if i % 3 == 0 else "") for i in range(300)]
    assert found_in(spark, texts) == set()


def test_copies_of_a_cut_text_stay_cut(spark):
    rng = random.Random(8)
    texts = [sentences(rng, 6) for _ in range(300)]
    cut = sentences(rng, 6) + " Parser engine buffer network window server rec"
    near = [f"{w} {cut}" for w in WORDS[:6]]
    assert found_in(spark, texts + [cut] * 50 + near) == set(range(300, 356))


def test_copies_raise_neither_stops_nor_goings_on(spark):
    rng = random.Random(9)
    rows = [(sentences(rng, 3) + "\n\nBest regards", "en", "main_text") for _ in range(40)]
    once = truncated.Model(truncated.train(spark.createDataFrame(rows, ROWS)))
    often = truncated.Model(truncated.train(spark.createDataFrame(rows + rows[:1] * 60, ROWS)))
    assert (once.keys == often.keys).all() and (once.stop == often.stop).all() and (once.on == often.on).all()
    assert once.odds(rows[0][0], "en", "main_text", 1) > 0


def test_ends_are_read_as_in_training(spark):
    rows = [(f"{w} {v}\nItem {w} of the {v}, see https://a.example/{w}{v * 60}", "en", "main_text") for w in WORDS for v in WORDS[:6]]
    model = truncated.Model(truncated.train(spark.createDataFrame(rows, ROWS)))
    ends = [model.odds(f"Item window of the record, see https://a.example/{'x' * n}", "en", "main_text", 0) for n in (5, 300, 3000)]
    assert ends[0] is not None and ends[0] == ends[1] == ends[2]
    assert model.opens("First.\nItem " + "window " * 400, "en", "main_text") == model.opens("First.\nItem window", "en", "main_text") > 0.4
    code = "\n" + "word " * 30 + "`" + "c" * 70 + "` and `" + "d" * 30 + "` of the window"
    assert model.odds(code, "en", "main_text", 0) == model.odds("\nword `c` and `d` of the window", "en", "main_text", 0)


def test_whole_last_lines_reach_the_model(spark):
    texts = ["", "a", " \n ", "b\n" * 900 + "c" * 1500 + "\u2003\n" * 800, "a b\n" + "d" * 3000 + "\n" + "e" * 1200, "x\r\n" * 2000, None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", truncated.tail(F.col("x")).alias("t")).orderBy("i").collect()]
    for x, y in zip(texts, got):
        assert (x is None) == (y is None) and (x is None or x.rstrip().endswith(y) and len(y) >= min(truncated.END, len(x.rstrip())))
        assert x is None or y.rsplit("\n", 1)[-1] == x.rstrip().rsplit("\n", 1)[-1]
        assert x is None or len(y) == len(x.rstrip()) or x.rstrip()[-len(y) - 1] == "\n"


def test_blanks_after_a_cut_do_not_hide_it(spark):
    rng = random.Random(10)
    texts = [sentences(rng, 6) for _ in range(300)] + [sentences(rng, 6) + " Parser engine buffer network wind" + " \n" * 900]
    assert found_in(spark, texts) == {300}


def test_truncation_of_odd_tables(spark):
    schema = "doc_id long, source string, lang string, title string, main_text string, text string, is_cut int"
    df = spark.createDataFrame([(1, None, None, None, None, None, 0), (2, "s", "x", "", "", "", 0), (3, "s", "EN-x", "t", " ", "t", 0), (4, "s", "en", "t", "Done.", "t\n\nDone.", 0)], schema)
    assert truncated.found(df).count() == 0 and truncated.found(df.where("false")).count() == 0


def test_field_limits(spark):
    rows = [("s", "x" * (50 + i % 37)) for i in range(300)] + [("s", "x" * 200)] * 60 + [("s", "x" * 200 + " [more]")] * 3
    got = truncated.limits(spark.createDataFrame(rows, "source string, text string")).collect()
    assert {(r.unit, r.size) for r in got} == {("chars", 200), ("bytes", 200)}
