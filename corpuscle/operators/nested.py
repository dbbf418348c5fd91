"""Deeply nested records to related flat tables (problem 2), by shared inlining.

After Shanmugasundaram et al., "Relational Databases for Querying XML Documents": the schema graph of all records is
analysed first, then

* an element that occurs at most once in its parent is inlined into the parent's table,
* an element that is repeated anywhere (a JSON array in any record), that is shared (the same name with the same
  structure below it under several parents), or recursive (contains its own name) gets a table of its own,
* every row of such a table holds its own id, its parent's table and id, and its place in the array.

The data's looseness is settled while reading: byte order marks are dropped, JSON that was wrapped in a JSON string is
unwrapped (at the root, or where other records have an object or array), a lone object stands for an array of one, a
record in an array of records is taken out of it. Entries that hold nothing still take a place.

Defined results: null, empty and broken payloads, and payloads that are no object, give no rows; null and absent values
give null columns; scalars become strings as JSON writes them; repeated records each give their rows.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOT = ""
#: Most distinct (path, kind) pairs of a schema graph, which is gathered on the driver; beyond, names are taken as data.
MOST_PATHS = 20_000


def parse(payload: str | None):
    """The value of a payload; None if it is null, empty or broken."""
    if payload is None:
        return None
    try:
        value = json.loads(payload.lstrip("﻿ \t\r\n"))
        for _ in range(3):
            if not isinstance(value, str):
                break
            value = json.loads(value.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return value


def unwrap(value):
    """An object or array that was written as a string; other values as they are."""
    if isinstance(value, str) and value[:1].strip() in ("{", "[") and value[:1]:
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def records(payload: str | None) -> Iterator[dict]:
    value = parse(payload)
    for x in value if isinstance(value, list) else [value]:
        x = unwrap(x)
        if isinstance(x, dict):
            yield x


#: The name of all entries of an object whose names are data.
ENTRY = "*"


def _step(path: str, name: str, maps: frozenset[str] = frozenset()) -> str:
    """The node of the schema graph for a child; a name met before on the way is the same, recursive node.

    All entries of a node in ``maps`` are one node.
    """
    name = ENTRY if path in maps else name.replace(".", "_")
    parts = path.split(".") if path else []
    if name != ENTRY and name in parts:
        return ".".join(parts[: parts.index(name) + 1])
    return f"{path}.{name}" if path else name


def _edges(record: dict, out: set[tuple[str, str, str]], maps: frozenset[str]) -> None:
    """(parent node, node, kind) of everything in a record; kind: scalar, object or array. Any depth."""
    todo = [(record, ROOT)]
    while todo:
        value, path = todo.pop()
        for name, v in value.items():
            child = _step(path, name, maps)
            v = unwrap(v)
            many = isinstance(v, list)
            if many or child.endswith("." + ENTRY) or child == ENTRY:
                out.add((path, child, "array"))
            for x in v if many else [v]:
                x = unwrap(x)
                if isinstance(x, dict):
                    out.add((path, child, "object"))
                    todo.append((x, child))
                elif x is not None:
                    out.add((path, child, "scalar"))


@dataclass
class Graph:
    """The schema graph of a collection."""

    edges: set[tuple[str, str, str]]
    maps: frozenset[str] = frozenset()  # nodes whose names are data
    tables: dict[str, str] = field(default_factory=dict)  # node -> table
    columns: dict[str, list[str]] = field(default_factory=dict)  # table -> inlined columns

    def __post_init__(self):
        kinds, parents = defaultdict(set), defaultdict(set)
        for p, c, k in self.edges:
            kinds[c].add(k)
            parents[c].add(p)
        below = {c: frozenset(x[len(c) + 1 :] for x in kinds if x.startswith(c + ".")) for c in kinds}
        alike = defaultdict(set)
        for c in kinds:
            if "object" in kinds[c]:
                alike[c.rpartition(".")[2], below[c]].add(c)
        own = {c for c in kinds if "array" in kinds[c]}
        own |= {c for c in kinds if any(p == c or p.startswith(c + ".") for p in parents[c])}
        self.tables = {c: c for c in own}
        for (name, _), same in alike.items():
            if len(same) > 1:
                for c in same:
                    self.tables[c] = name if name not in kinds else f"{name}*"
        self.kinds = dict(kinds)
        columns = defaultdict(set)
        for c in kinds:
            if "scalar" in kinds[c]:
                home = c
                while home and home not in self.tables:
                    home = home.rpartition(".")[0]
                columns[self.tables.get(home, ROOT)].add(c[len(home) + 1 :] if home and c != home else ("value" if c == home else c))
        for c in kinds:
            if c.rpartition(".")[2] == ENTRY:
                columns[self.tables[c]].add("name")
        self.columns = {t: sorted(v) for t, v in columns.items()}
        for t in {ROOT, *self.tables.values()}:
            self.columns.setdefault(t, [])


def analyse(df: DataFrame, payload: str, most: int = MOST_PATHS) -> Graph:
    """The schema graph of all records of a column.

    Nodes with so many different names below them that the graph would have more than ``most`` edges hold data as names: they
    become tables of entries with their name, so the graph stays small and nothing is lost. They are found on the cluster.
    """
    maps: frozenset[str] = frozenset()

    def edges() -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch], maps=maps) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: set[tuple[str, str, str]] = set()
                for p in b.column(0):
                    for r in records(p.as_py()):
                        _edges(r, seen, maps)
                rows = sorted(seen)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(3)], names=["p", "c", "k"])

        return df.select(payload).mapInArrow(run, "p string, c string, k string").distinct()

    while True:
        found = edges()
        rows = found.limit(most + 1).collect()
        if len(rows) <= most:
            return Graph({(r["p"], r["c"], r["k"]) for r in rows}, maps)
        # the widest nodes, outermost first; what is below them is seen again in the next round
        wide = found.groupBy("p").agg(F.count_distinct("c").alias("n")).orderBy(F.desc("n"), F.length("p"), "p").limit(100).collect()
        top = [r["p"] for r in wide if r["n"] * 10 >= wide[0]["n"] and r["p"] not in maps]
        maps |= {p for p in top if not any(p != q and (q == ROOT or p.startswith(q + ".")) for q in top)}


def _text(x) -> str | None:
    """A scalar or array as text; deeper than the encoder goes, by parts."""
    if x is None or isinstance(x, str):
        return x
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [x]
        while todo:
            v = todo.pop()
            if isinstance(v, _Raw):
                out.append(v.text)
            elif isinstance(v, list):
                parts = [p for y in v for p in (_Raw(", "), y)][1:]
                todo += reversed([_Raw("["), *parts, _Raw("]")])
            elif isinstance(v, dict):
                parts = [p for k, y in v.items() for p in (_Raw(", "), _Raw(json.dumps(k, ensure_ascii=False) + ": "), y)][1:]
                todo += reversed([_Raw("{"), *parts, _Raw("}")])
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


@dataclass
class _Raw:
    text: str


def shred_record(record: dict, graph: Graph) -> list[tuple[str, str, str | None, str | None, str, int, dict[str, str]]]:
    """Rows (table, row id, parent's table, parent's row id, node, pos, columns) of one record of any depth."""
    root: dict[str, str] = {}
    out: list = [(ROOT, "", None, None, ROOT, 1, root)]
    todo: deque = deque([(record, ROOT, "", ROOT, "", root)])
    while todo:
        value, path, prefix, table, row, cols = todo.popleft()
        for place, (name, v) in enumerate(value.items(), 1):
            child = _step(path, name, graph.maps)
            entry = path in graph.maps
            kinds = graph.kinds.get(child, set())
            v = unwrap(v) if kinds & {"object", "array"} else v
            step = ENTRY if entry else name.replace(".", "_")
            short = f"{prefix}.{step}" if prefix else step
            if child not in graph.tables:
                if isinstance(v, dict):
                    todo.append((v, child, short, table, row, cols))
                elif v is not None:
                    cols[short] = _text(v)
                continue
            for pos, x in enumerate(v if isinstance(v, list) else [] if v is None and not entry else [v], 1):
                x = unwrap(x) if "object" in kinds else x
                own = graph.tables[child]
                rid = f"{row}/{short}.{f'{place}.' if entry else ''}{pos}"
                new: dict[str, str] = {"name": name} if entry else {}
                out.append((own, rid, table, row, child, pos, new))
                if isinstance(x, dict):
                    todo.append((x, child, "", own, rid, new))
                elif x is not None:
                    new["value"] = _text(x)
    return out


def shred(df: DataFrame, key: str, payload: str, graph: Graph | None = None) -> DataFrame:
    """(key, record_no, tbl, row_id, parent_tbl, parent_id, node, pos, cols): the rows of all tables; no shuffle.

    ``row_id`` is unique within (key, record_no); a row without parent is a root row.
    """
    g = graph or analyse(df, payload)
    picked = df.select(F.col(key).alias("__key"), F.col(payload).alias("__payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            for i, p in enumerate(b.column(1)):
                for no, r in enumerate(records(p.as_py()), 1):
                    for x in shred_record(r, g):
                        place.append(i)
                        rows.append((no, *x))
            text = lambda k: pa.array([r[k] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(place, pa.int64())), pa.array([r[0] for r in rows], pa.int64()),
                    text(1), text(2), text(3), text(4), text(5), pa.array([r[6] for r in rows], pa.int64()),
                    pa.array([list(r[7].items()) for r in rows], pa.map_(pa.string(), pa.string())),
                ],
                names=[key, "record_no", "tbl", "row_id", "parent_tbl", "parent_id", "node", "pos", "cols"],
            )

    kind = picked.schema["__key"].dataType.simpleString()
    return picked.mapInArrow(
        run,
        f"`{key}` {kind}, record_no long, tbl string, row_id string, parent_tbl string, parent_id string, node string, "
        "pos long, cols map<string,string>",
    )


def flat_table(shredded: DataFrame, graph: Graph, name: str, key: str) -> DataFrame:
    """One of the tables, with a column for each inlined descendant (dots become underscores)."""
    cols = [F.col("cols")[c].alias(c.replace(".", "_")) for c in graph.columns.get(name, [])]
    return shredded.where(F.col("tbl") == name).select(key, "record_no", "row_id", "parent_tbl", "parent_id", "node", "pos", *cols)


def _first(names: list[str]):
    return F.coalesce(*[F.col("cols")[n] for n in names])


#: The nodes under which labels and pulls occur, whatever was wrapped around them, and the columns with their values.
LABELS = ("issue_labels", "issue_labels.edges", "issue_labels.nodes", "issue_labels.edges.node")
PULLS = ("timelineItems", "timelineItems.nodes", "timelineItems.edges", "timelineItems.nodes.pull_info")
LABEL_TEXTS = ["node.label", "node.label.name", "label", "label.name", "name", "value"]
PULL_URLS = ["pull_info.pull_url", "node.pull_info.pull_url", "pull_url"]


def issue_children(raw: DataFrame) -> DataFrame:
    """Distinct (raw_id, child, pos, child_key): labels and pull requests of raw issues."""
    rows = shred(raw, "raw_id", "payload")
    label, pull = F.col("node").isin(*LABELS), F.col("node").isin(*PULLS)
    found = rows.where(label | pull).select(
        "raw_id", F.when(label, "label").otherwise("pull").alias("child"), "pos",
        F.when(label, _first(LABEL_TEXTS)).otherwise(_first(PULL_URLS)).alias("child_key"),
    )
    return found.where("child_key is not null").distinct()


def issue_links(raw: DataFrame) -> DataFrame:
    """(raw_id, pos, issue_url, issue_key, pull_url): a row for each pull request of a raw issue's timeline, repetitions kept.

    The key is the repository's name and the issue's number; null where the record lacks one.
    """
    rows = shred(raw, "raw_id", "payload")
    pull, root = F.col("node").isin(*PULLS), F.col("tbl") == ROOT
    repository = _first(["issue_repository.nameWithOwner", "issue_repository", "repository.nameWithOwner", "repository"])
    picked = rows.where(pull | root).select(
        "raw_id", "record_no", "pos", root.alias("root"), F.when(pull, _first(PULL_URLS)).alias("pull_url"),
        F.when(root, F.col("cols")["issue_url"]).alias("u"), F.when(root, F.concat(repository, F.lit("#"), F.col("cols")["issue_no"])).alias("k"),
    )
    one = W.partitionBy("raw_id", "record_no")
    return picked.select("raw_id", "pos", F.max("u").over(one).alias("issue_url"), F.max("k").over(one).alias("issue_key"), "pull_url", "root").where(
        "not root and pull_url is not null"
    ).drop("root")
