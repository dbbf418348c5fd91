"""Problem 4: linking the spellings of people's and organisations' names.

A spelling is folded and taken apart: of a person the surname, the given name (short forms replaced by the given name
they stand for) or its initial; of an organisation its kind (the words for institute, university, laboratories and so
on) and its proper name. How kinds are abbreviated is learnt: a shorter form of a kind's word is one if organisations have it in the
place of that word beside the same rest of a name. Candidates come from a segment join by the pigeonhole principle:
a string is cut into k+1 segments, so that any string within k edits holds one of them unchanged, shifted by at most k.
Segments go into an inverted index under (kind of index, length, number, text); the substrings of every string at the
allowed shifts are looked up in it, and a banded edit distance verifies what meets.

Full names are linked first and their connected components found. A name with an initial only then joins the one
component that has its surname (up to one typing error) and a given name with that initial; it joins none if several
have, unless exactly one has the surname unchanged. Names with initials only are linked among themselves where no
component has them. All is done on distinct spellings, so frequent names cost no more than rare ones.

Defined results: null, blank and placeholder entries are no names; order of parts, case, accents, titles and blanks do
not count; spellings that fold to nothing link to nothing; ties have no influence, as linking is symmetric; empty tables
give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.components import components
from corpuscle.session import cut

#: Entries that are no names (fixed values).
PLACEHOLDERS = (
    "", "-", "?", "n/a", "na", "none", "null", "nil", "unknown", "anonymous", "anon", "tbd", "various", "others",
    "et al", "et al.", "and others", "nobody", "no name", "not available", "unspecified", "undefined", "nan",
)
#: Words before or after a person's name (fixed values).
TITLES = ("dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "phd", "md", "msc", "bsc", "jr", "sr", "ii", "iii")
#: Words for a kind of organisation (fixed values); their abbreviations are learnt from the spellings.
KINDS = (
    "university", "institute", "technology", "research", "laboratory", "laboratories", "labs", "foundation", "national", "centre", "studies",
    "systems", "college", "school", "academy", "department", "society", "association",
)
#: Words of organisations that count for nothing (fixed values).
NOTHING = (
    "company", "co", "corporation", "corp", "incorporated", "inc", "limited", "ltd", "llc", "gmbh", "plc", "ag", "sa", "the", "of",
    "for", "and", "de", "at", "in", "non", "profit", "nonprofit", "l",
)
_WORD = re.compile(r"[^\W\d_]+")
_SAME = {"laboratories": "laboratory", "labs": "laboratory"}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L")
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"['’`´]", "", s.casefold()).strip()


def _near(a: str, b: str) -> bool:
    """Whether one typing error makes a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def abbreviates(w: str, long: str) -> bool:
    """Whether a word is a shorter form of another: its first letter and some of its others in their order."""
    letters = iter(long)
    return len(w) < len(long) and w[:1] == long[:1] and all(c in letters for c in w)


def _kind(w: str, learnt: dict[str, str]) -> str | None:
    """The kind that a word stands for, '' for nothing, None if it is part of a name."""
    if w in NOTHING:
        return ""
    if w in KINDS:
        return _SAME.get(w, w)
    if w in learnt:
        return learnt[w]
    if len(w) >= 5:
        near = next((x for x in KINDS if _near(w, x)), None)
        return near and _SAME.get(near, near)
    return None


def organisation(name: str, learnt: dict[str, str]) -> tuple[str, str] | None:
    """(kind, proper name) of an organisation's spelling."""
    s = fold(name)
    if s in PLACEHOLDERS:
        return None
    kinds, proper = set(), []
    for w in _WORD.findall(s):
        kind = _kind(w, learnt)
        if kind is None:
            proper.append(w)
        elif kind:
            kinds.add(kind)
    if not proper and not kinds:
        return None
    return " ".join(sorted(kinds)), "".join(proper) or " ".join(sorted(kinds))


def evidence(name: str) -> list[tuple[str, str, str]]:
    """(kind, rest, word) of a spelling: words that are a kind, or may abbreviate one, with the words that are neither.

    ``word`` is null for a kind that is written out.
    """
    ws = [w for w in _WORD.findall(fold(name)) if w not in NOTHING]
    maybe = {w: [k for k in KINDS if abbreviates(w, k)] for w in ws if w not in KINDS}
    rest = " ".join(sorted(w for w in ws if w not in KINDS and not maybe[w]))
    if not rest:
        return []
    return [(_SAME.get(w, w), rest, None) for w in ws if w in KINDS] + [(k, rest, w) for w, kinds in maybe.items() for k in dict.fromkeys(_SAME.get(k, k) for k in kinds)]


def abbreviations(names: DataFrame) -> dict[str, str]:
    """Word to kind: what organisations write in place of a kind, beside the same rest of a name; the kind with most such rests.

    The result is bounded: it holds shorter forms of the few ``KINDS`` only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for n in b.column(0) for r in evidence(n.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "rest", "w"])

    said = names.where("field_name = 'organizations'").select("name").mapInArrow(run, "kind string, rest string, w string").distinct()
    whole = said.where("w is null").select("kind", "rest")
    met = said.where("w is not null").join(whole, ["kind", "rest"], "left_semi").groupBy("w", "kind").agg(F.count("*").alias("n"))
    best = met.groupBy("w").agg(F.max(F.struct("n", "kind")).alias("b"))
    return {r["w"]: r["kind"] for r in best.select("w", "b.kind").collect()}


def person(name: str) -> tuple[list[str], list[str], str] | None:
    """(full words, initials, how) of a person's spelling; how: 'comma' (the surname stands first) or 'free'.

    A surname also stands first if it alone is in capitals.
    """
    s = fold(name)
    if s in PLACEHOLDERS:
        return None
    comma = s.find(",") > 0
    parts = [[w for w in _WORD.findall(p) if w not in TITLES] for p in (s.split(",", 1) if comma else [s])]
    ws = [w for p in parts for w in p]
    full = [w for w in ws if len(w) > 1]
    initials = [w for w in ws if len(w) == 1]
    if not full:
        return None
    comma = comma and bool(parts[0]) and len(parts[1]) > 0 and len(parts[0][-1]) > 1
    if comma:
        full = [w for w in parts[0] if len(w) > 1] + [w for w in parts[1] if len(w) > 1]
        # several words before the comma are one surname
        n = len([w for w in parts[0] if len(w) > 1])
        full = ["".join(full[:n]), *full[n:]]
    else:
        raw = [w for w in _WORD.findall(name) if len(w) > 1 and fold(w) not in TITLES]
        comma = len(raw) > 1 and raw[0].isupper() and not raw[-1].isupper()
    return full, initials, "comma" if comma else "free"


def segments(s: str, k: int) -> list[tuple[int, str]]:
    """(begin, text) of the k+1 segments of a string, as even as possible, the longer ones last."""
    n, out, at = len(s), [], 0
    base, longer = divmod(n, k + 1)
    for i in range(k + 1):
        size = base + (i >= k + 1 - longer)
        out.append((at, s[at : at + size]))
        at += size
    return out


def index_keys(s: str, k: int) -> list[str]:
    """Keys under which a string is found."""
    return [f"{len(s)}|{i}|{t}" for i, (_, t) in enumerate(segments(s, k)) if t]


def probe_keys(s: str, k: int) -> list[str]:
    """Keys by which a string finds every indexed string within k edits that is not longer."""
    out = set()
    for n in range(max(k + 1, len(s) - k), len(s) + 1):
        gap, base, longer, at = len(s) - n, *divmod(n, k + 1), 0
        for i in range(k + 1):
            size = base + (i >= k + 1 - longer)
            # multi-match-aware window: i errors at most before the segment, k-i after it
            low = max(0, at - i, at + gap - (k - i))
            high = min(len(s) - size, at + i, at + gap + (k - i))
            for b in range(low, high + 1):
                out.add(f"{n}|{i}|{s[b : b + size]}")
            at += size
    return sorted(out)


def near_pairs(strings: DataFrame, k: int = 2) -> DataFrame:
    """Distinct (space, a, b), a < b: strings of one space within k edits of each other.

    ``strings`` has (space, s), distinct. Strings of at most k characters are compared by equality only. One shuffle
    brings probes and index entries of a key together; a key is a segment of known length and place, and a space
    narrows it further.
    """
    schema = "space string, s string, k string, side boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            space, s, keys, side = [], [], [], []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(y) <= k:
                    continue
                for key in index_keys(y, k):
                    space.append(x), s.append(y), keys.append(key), side.append(True)
                for key in probe_keys(y, k):
                    space.append(x), s.append(y), keys.append(key), side.append(False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(space, pa.string()), pa.array(s, pa.string()), pa.array(keys, pa.string()), pa.array(side, pa.bool_())],
                names=["space", "s", "k", "side"],
            )

    keyed = strings.select("space", "s").mapInArrow(run, schema)
    left = keyed.where("side").select("space", "k", F.col("s").alias("x"))
    right = keyed.where("not side").select("space", "k", F.col("s").alias("y"))
    met = left.join(right, ["space", "k"]).where("x <> y").select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return met.distinct().where(F.levenshtein("a", "b", k) >= 0)


def one_error(a: Column, b: Column) -> Column:
    """At most one typing error: an edit, or two neighbouring characters changed over."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein(a, b, 2)
    swapped = (F.length(a) == F.length(b)) & (letters(a) == letters(b))
    return d.between(0, 1) | ((d == 2) & swapped)


def spellings(documents: DataFrame) -> DataFrame:
    """Distinct (field_name, name) of documents."""
    parts = [documents.select(F.lit(f).alias("field_name"), F.explode(f).alias("name")) for f in ("people", "organizations")]
    return parts[0].unionByName(parts[1]).where("name is not null").distinct()


def _parsed(names: DataFrame) -> DataFrame:
    names = cut(names)
    learnt = abbreviations(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f == "organizations":
                    if o := organisation(n, learnt):
                        rows.append((f, n, [o[1]], [], "", o[0]))
                elif p := person(n):
                    rows.append((f, n, p[0], p[1], p[2], ""))
            lists = pa.list_(pa.string())
            kinds = (pa.string(), pa.string(), lists, lists, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["field_name", "name", "words", "initials", "how", "kind"],
            )

    return names.mapInArrow(run, "field_name string, name string, words array<string>, initials array<string>, how string, kind string")


def people_parts(parsed: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name, surname, given, initial): given is null where only an initial is known.

    Which of two words is the surname is told by a comma or capitals, or else by the words' places in those spellings
    where it is told, and in those with one word and an initial; without any such evidence the last word is.
    """
    p = parsed.where("field_name = 'people'").select("name", "words", "initials", "how")
    word = p.select("name", "how", F.size("words").alias("n"), F.size("initials").alias("m"), F.posexplode("words").alias("at", "w"))
    first_place = (F.col("at") == 0) & ((F.col("how") == "comma") | ((F.col("n") == 1) & (F.col("m") > 0)))
    told = word.groupBy("w").agg(
        F.count_if(first_place).alias("s"), F.count_if((F.col("how") == "comma") & (F.col("at") > 0)).alias("g")
    )
    nick = nicknames.where("nickname is not null and given_name is not null").select(
        F.lower(F.trim("nickname")).alias("w"), F.lower(F.trim("given_name")).alias("long")
    )
    nick = nick.union(nick.select("long", "long")).groupBy("w").agg(F.min("long").alias("long"))
    lean = F.signum((F.col("g") - F.col("s")).cast("double")) + F.when(F.col("long").isNotNull(), 2).otherwise(0)
    known = word.join(told, "w").join(nick, "w", "left").withColumn("lean", lean)  # above 0: a given name
    ws = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "w", "lean", "long"))).alias("ws"))
    p = p.drop("words").join(ws, "name")
    one = F.size("ws") == 1
    first, last = F.col("ws")[0], F.element_at("ws", -1)
    reverse = (F.col("how") == "comma") | (
        F.when(last.lean != first.lean, last.lean > first.lean).otherwise(F.lit(False))
    )
    surname = F.when(one | reverse, first.w).otherwise(last.w)
    given = F.when(one, F.lit(None)).when(reverse, F.coalesce(F.col("ws")[1].long, F.col("ws")[1].w)).otherwise(F.coalesce(first.long, first.w))
    out = p.select("name", surname.alias("surname"), given.alias("given"), F.get("initials", F.lit(0)).alias("i"))
    return out.select("name", "surname", "given", F.coalesce(F.substring("given", 1, 1), "i").alias("initial"))


def _attach(full: DataFrame, short: DataFrame) -> DataFrame:
    """(name, entity) of names with initials only. ``full``: (surname, initial, entity), ``short``: (name, surname, initial)."""
    space = F.concat(F.lit("i"), F.col("initial"))
    # an initial and a surname; what the full names of a component have
    have = full.groupBy("initial", "surname", "entity").agg(F.count("*").alias("n")).drop("n")
    strings = have.select(space.alias("space"), F.col("surname").alias("s")).union(
        short.select(space.alias("space"), F.col("surname").alias("s"))
    ).distinct()
    near = cut(near_pairs(strings).where(one_error(F.col("a"), F.col("b"))))
    both = near.union(near.select("space", "b", "a")).union(strings.select("space", F.col("s").alias("a"), F.col("s").alias("b")))
    reach = both.join(have.select(space.alias("space"), F.col("surname").alias("b"), "entity"), ["space", "b"])
    same = F.when(F.col("a") == F.col("b"), F.col("entity"))
    # one entity if the least and the greatest are the same: no set of a common surname's entities is gathered
    reach = reach.groupBy("space", "a").agg(
        F.min("entity").alias("least"), F.max("entity").alias("most"), F.min(same).alias("same_least"), F.max(same).alias("same_most")
    )
    pick = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("same_least") == F.col("same_most"), F.col("same_least"))
    chosen = reach.select("space", F.col("a").alias("surname"), pick.alias("entity"), F.lit(True).alias("reached"))
    s = short.select("name", space.alias("space"), "surname")
    joined = s.join(chosen, ["space", "surname"], "left")
    taken = joined.where("entity is not null").select("name", "entity")
    alone = joined.where("reached is null").select("name", "space", "surname")
    # names that no component has: linked among themselves
    key = F.concat_ws("|", "space", "surname")
    left = alone.select("name", key.alias("node"))
    sure = alone.select("space", "surname").distinct()
    links = near.join(sure.withColumnRenamed("surname", "a"), ["space", "a"], "left_semi").join(
        sure.withColumnRenamed("surname", "b"), ["space", "b"], "left_semi"
    )
    links = links.select(F.concat_ws("|", "space", "a").alias("a"), F.concat_ws("|", "space", "b").alias("b"))
    comp = components(links, "a", "b")
    own = left.join(comp, "node", "left").select("name", F.concat(F.lit("s|"), F.coalesce("component", "node")).alias("entity"))
    return taken.union(own)


def people(parsed: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name, entity) of people's spellings."""
    parts = cut(people_parts(parsed, nicknames))
    full = parts.where("given is not null").select("name", "surname", "given", F.concat_ws(" ", "surname", "given").alias("s"), "initial")
    strings = full.select(F.lit("f").alias("space"), "s").distinct()
    near = near_pairs(strings).select("a", "b")
    sides = [full.select(F.col("s").alias(x), F.col("surname").alias(f"{x}_sur"), F.col("given").alias(f"{x}_giv")).distinct() for x in "ab"]
    near = near.join(sides[0], "a").join(sides[1], "b")
    same_given, same_sur = F.col("a_giv") == F.col("b_giv"), F.col("a_sur") == F.col("b_sur")
    sur, giv = one_error(F.col("a_sur"), F.col("b_sur")), one_error(F.col("a_giv"), F.col("b_giv"))
    long = F.least(F.length("a_sur"), F.length("b_sur")) >= 4
    ok = (same_given & sur & long) | (same_sur & giv & (F.least(F.length("a_giv"), F.length("b_giv")) >= 4)) | (
        sur & giv & long & (F.levenshtein("a", "b", 2) >= 0)
    )
    comp = components(near.where(ok).select("a", "b"), "a", "b")
    named = full.join(comp.withColumnRenamed("node", "s"), "s", "left")
    named = cut(named.select("name", "surname", "initial", F.concat(F.lit("f|"), F.coalesce("component", "s")).alias("entity")))
    short = parts.where("given is null and initial is not null").select("name", "surname", "initial")
    return named.select("name", "entity").union(_attach(named.select("surname", "initial", "entity"), short)).union(
        parts.where("given is null and initial is null").select("name", F.concat(F.lit("w|"), F.col("surname")).alias("entity"))
    )


def organisations(parsed: DataFrame) -> DataFrame:
    """(name, entity) of organisations' spellings."""
    o = parsed.where("field_name = 'organizations'").select("name", "kind", F.col("words")[0].alias("s"))
    strings = cut(o.select(F.col("kind").alias("space"), "s").distinct())
    near = near_pairs(strings).where(one_error(F.col("a"), F.col("b")) & (F.least(F.length("a"), F.length("b")) >= 5))
    node = lambda c: F.concat_ws("|", "space", c)
    comp = components(near.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    return o.select("name", F.concat_ws("|", "kind", "s").alias("node")).join(comp, "node", "left").select(
        "name", F.coalesce("component", "node").alias("entity")
    )


def entities(documents: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(field_name, name, entity): one row for each spelling that is a name."""
    parsed = cut(_parsed(spellings(documents)))
    p = people(parsed, nicknames).select(F.lit("people").alias("field_name"), "name", "entity")
    return p.unionByName(organisations(parsed).select(F.lit("organizations").alias("field_name"), "name", "entity"))


def variant_pairs(documents: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Distinct (field_name, name_a, name_b), name_a < name_b by code points: spellings of the same entity.

    Spark compares strings by their UTF-8 bytes, which is the order of code points.
    """
    e = cut(entities(documents, nicknames))
    other = e.select("field_name", "entity", F.col("name").alias("name_b"))
    pairs = e.withColumnRenamed("name", "name_a").join(other, ["field_name", "entity"])
    return pairs.where("name_a < name_b").select("field_name", "name_a", "name_b").distinct()
