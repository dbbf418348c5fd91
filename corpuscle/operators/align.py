"""Alignment of raw issues and papers to canonical documents and relevance judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.operators.references import spelled_number
from corpuscle.session import spread

_TEXTS = "array<string>"


def none() -> Column:
    return F.array().cast(_TEXTS)


def document(**c: Column) -> list[Column]:
    """The canonical nested document from flat columns; missing lists become empty ones."""
    lists = lambda name: F.coalesce(c.get(name, F.lit(None).cast(_TEXTS)), none()).alias(name)
    text = lambda name, default=None: c.get(name, F.lit(default).cast("string")).alias(name)
    return [
        text("id"), text("source_dataset"), text("source_type"), text("title"),
        F.coalesce(text("main_text"), F.lit("")).alias("main_text"), lists("secondary_texts"),
        F.struct(
            F.coalesce(c.get("categorical", F.lit(None).cast("string")), F.lit("{}")).alias("categorical"),
            F.coalesce(c.get("hierarchical", F.lit(None).cast("string")), F.lit("{}")).alias("hierarchical"),
        ).alias("structured_fields"),
        F.struct(*[lists(n) for n in ("people", "organizations", "projects", "topics")]).alias("entities"),
        F.struct(lists("explicit_related_ids")).alias("relations"),
        F.struct(
            c.get("is_queryable", F.lit(False)).alias("is_queryable"), c.get("is_candidate", F.lit(True)).alias("is_candidate")
        ).alias("retrieval_metadata"),
        F.struct(text("native_id"), text("url")).alias("raw_source"),
    ]


def qrel(query: Column, candidates: Column, kind: str) -> list[Column]:
    return [query.alias("query_id"), candidates.alias("candidate_ids"), F.lit(kind).alias("relation_type")]


def nest(flat: DataFrame) -> DataFrame:
    """Flattened documents to the canonical nested form."""
    return flat.select(*document(**{c: F.col(c) for c in flat.columns}))


def flat_issues(raw: DataFrame) -> DataFrame:
    """Issues of the nominal raw shape: labels joined by bars, comments by bars in blanks; exact duplicates removed."""
    labels = F.concat_ws("|", F.transform(F.col("issue_labels.edges"), lambda x: x.node.label))
    comments = F.concat_ws(" | ", F.transform(F.col("issue_comments.edges"), lambda x: x.node.comment_body))
    repo = F.col("issue_repository.nameWithOwner")
    return raw.select(
        "issue_no", F.concat(repo, F.lit("#"), F.col("issue_no")).alias("issue_key"), "issue_url", "issue_title", "issue_body",
        repo.alias("repository"), "created_at", "closed_at", labels.alias("labels"), comments.alias("comments"),
    ).dropDuplicates()


def flat_pulls(raw: DataFrame, order: str) -> DataFrame:
    """Pull requests of raw issues, one row for each url; the first by ``order`` and place holds. A hot url is pre-aggregated."""
    pulls = raw.select(F.col(order).alias("o"), F.posexplode("timelineItems.nodes").alias("p", "node")).where("node.pull_info.pull_url is not null")
    info = F.struct("o", "p", "node.pull_info")
    first = pulls.groupBy(F.col("node.pull_info.pull_url").alias("url")).agg(F.min_by(info, F.struct("o", "p")).alias("x"))
    return first.select(
        "x.pull_info.pull_no", "x.pull_info.pull_url", "x.pull_info.pull_title", "x.pull_info.pull_body",
        F.col("x.pull_info.repository.nameWithOwner").alias("repository"), "x.pull_info.createdAt", "x.pull_info.closedAt",
    )


def flat_links(raw: DataFrame) -> DataFrame:
    """One row for each issue and pull request of its timeline, repetitions kept."""
    key = F.concat("issue_repository.nameWithOwner", F.lit("#"), F.col("issue_no"))
    return raw.select("issue_url", key.alias("issue_key"), F.explode("timelineItems.nodes").alias("n")).select(
        "issue_url", "issue_key", F.col("n.pull_info.pull_url").alias("pull_url")
    ).where("pull_url is not null")


def label_map(mapping: DataFrame, line: str = "line_no") -> DataFrame:
    """(raw_label, normalized_path), trimmed; the last line of a repeated label holds."""
    m = mapping.select(F.trim("raw_label").alias("raw_label"), F.trim("normalized_path").alias("normalized_path"), F.col(line).alias("line"))
    return m.groupBy("raw_label").agg(F.max_by("normalized_path", "line").alias("normalized_path"))


def normalised_labels(issues: DataFrame, mapping: DataFrame, key: str = "issue_key", labels: str = "labels") -> DataFrame:
    """(key, normalized): the sorted distinct paths of an issue's bar-joined labels, joined by bars; '' if none is mapped."""
    each = issues.select(key, F.explode(F.split(labels, "[|]")).alias("l")).select(key, F.trim("l").alias("raw_label"))
    found = each.join(label_map(mapping), "raw_label").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("normalized_path")), "|").alias("n"))
    return issues.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit("")).alias("normalized"))


def with_issue_key(links: DataFrame, issues: DataFrame) -> DataFrame:
    """Links with the issue key of their url; of repeated urls the last export holds, unknown urls give null."""
    keys = issues.where("issue_url is not null").groupBy("issue_url").agg(F.max(F.struct("exported_at", "issue_key")).alias("k"))
    return links.select("issue_url", "pull_url").join(keys, "issue_url", "left").select("issue_url", "pull_url", F.col("k.issue_key").alias("issue_key"))


def numbered(rows: DataFrame, order: list[Column], offset: int = 0, out: str = "id") -> DataFrame:
    """Rows with a running number from 1 + offset by ``order``, which should be total; ascending, nulls first.

    Ranges of the order are fixed first, from a sample of its keys by hash, so that every use of them sees the same ones
    whatever other columns it reads. Every range numbers its own rows after the sizes of the ranges before it: one shuffle of
    the rows, and no task ever holds all of them.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order)))
    parts = spread(rows)
    sample = keyed.select(*keys).orderBy(F.xxhash64(*keys)).limit(20 * parts).orderBy(*keys).collect()
    bounds = list(dict.fromkeys(tuple(sample[i * len(sample) // parts]) for i in range(1, parts))) if sample else []
    kinds = [keyed.schema[k].dataType for k in keys]
    limits = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, one, kinds)]) for one in bounds]
    at = F.struct(*keys)

    def place(low: int, high: int) -> Column:
        """How many bounds are not above the key, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(at < limits[mid], place(low, mid)).otherwise(place(mid + 1, high))

    ranged = keyed.withColumn("__p", place(0, len(limits)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = ranged.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*keys)))
    return local.join(F.broadcast(before), "__p").withColumn(out, (F.col("__r") + F.col("__b") + offset).cast("long")).drop("__p", "__r", "__b", *keys)


def chunks(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows, from 0."""
    return numbered(rows, order, 0, "__no").withColumn("chunk", F.floor((F.col("__no") - 1) / size)).drop("__no")


def resolved(rows: DataFrame, key: str, listed: str, ids: DataFrame, native: str, out: str) -> DataFrame:
    """(key, out): listed native ids, rendered plainly, replaced by ids, order and repetitions kept, unknown ones dropped; empty if none."""
    each = rows.select(key, F.posexplode(listed).alias("pos", "entry")).select(key, "pos", plain_id(F.col("entry")).alias(native))
    found = each.join(ids, native).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias(out))
    kind = dict(ids.dtypes)["id"]
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce(out, F.array().cast(f"array<{kind}>")).alias(out))


def issue_documents(issues: DataFrame, normalised: DataFrame, related: DataFrame) -> DataFrame:
    """Canonical documents of issues. ``related``: (issue_key, related); comments are cut at every bar."""
    d = issues.join(normalised, "issue_key", "left").join(related, "issue_key", "left")
    return d.select(*document(
        id=F.col("id"), source_dataset=F.col("repository"), source_type=F.lit("github_issue"), title=F.col("issue_title"),
        main_text=F.col("issue_body"), secondary_texts=F.split(F.coalesce("comments", F.lit("")), "[|]"),
        hierarchical=F.to_json(F.array(F.coalesce("normalized", F.lit("")))), projects=F.array("repository"),
        explicit_related_ids=F.col("related"), is_queryable=F.lit(True), native_id=F.col("issue_key"), url=F.col("issue_url"),
    ))


def paper_documents(papers: DataFrame, cited: DataFrame) -> DataFrame:
    """Canonical documents of papers with id. ``cited``: (corpusid, related)."""
    d = papers.join(cited, "corpusid", "left")
    full = F.when(F.length("full_paper") > 0, F.array("full_paper"))
    return d.select(*document(
        id=F.col("id"), source_dataset=F.lit("papers"), source_type=F.lit("paper"), title=F.col("title"), main_text=F.col("abstract"),
        secondary_texts=full, explicit_related_ids=F.col("related"), native_id=F.col("corpusid").cast("string"),
    ))


def query_documents(queries: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, qrels) of paper queries with id; queries without any known gold paper are dropped."""
    ids = papers.select(F.col("corpusid").alias("c"), F.col("id").alias("paper_id"))
    each = queries.select("id", F.posexplode("corpusids").alias("pos", "c")).join(ids, "c")
    gold = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper_id"))), lambda x: x.paper_id).alias("gold"))
    q = queries.join(gold, "id")
    rating = F.to_json(F.struct(F.coalesce("specificity", F.lit("")).alias("specificity"), F.coalesce("quality", F.lit("")).alias("quality")))
    docs = q.select(*document(
        id=F.col("id"), source_dataset=F.col("query_set"), source_type=F.lit("query"), main_text=F.col("query"), categorical=rating,
        is_queryable=F.lit(True), is_candidate=F.lit(False),
    ))
    return docs, q.select(*qrel(F.col("id"), F.col("gold"), "corpusid_match"))


def plain_id(entry: Column) -> Column:
    """An id as documents have it: the number it spells in plain digits, or else the trimmed text; null if blank."""
    return F.coalesce(spelled_number(entry), F.nullif(F.trim(entry), F.lit("")))


def long_qrels(qrels: DataFrame) -> DataFrame:
    """(query_id, candidate_id, relation_type), distinct; lists or single candidates, ids rendered plainly, blank ones dropped."""
    one = F.array("candidate_id") if "candidate_id" in qrels.columns else F.lit(None).cast(_TEXTS)
    each = qrels.select("query_id", F.explode(F.coalesce("candidate_ids", one)).alias("c"), "relation_type")
    each = each.select(plain_id(F.col("query_id")).alias("query_id"), plain_id(F.col("c")).alias("candidate_id"), "relation_type")
    return each.where("query_id is not null and candidate_id is not null").distinct()


def valid_qrels(long: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgments whose query and candidate are both documents (``ids``: id)."""
    return long.join(ids.withColumnRenamed("id", "query_id"), "query_id", "left_semi").join(
        ids.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi"
    )


def of_relations(long: DataFrame, relations: list[str], only_linked: bool = False) -> DataFrame:
    """Judgments of some relation types, or with ``only_linked`` of linked issues only; all if none is named."""
    kinds = ["linked_issue"] if only_linked else relations
    return long.where(F.col("relation_type").isin(*kinds)) if kinds else long


def trainable(long: DataFrame, ids: DataFrame, every: bool = True) -> DataFrame:
    """(query_id) of known queries whose candidates are all known, or with ``every`` off at least one of them."""
    known = ids.withColumnRenamed("id", "candidate_id").withColumn("known", F.lit(True)).distinct()
    q = long.join(ids.withColumnRenamed("id", "query_id"), "query_id", "left_semi").join(known, "candidate_id", "left")
    fold = F.bool_and if every else F.bool_or
    return q.groupBy("query_id").agg(fold(F.coalesce("known", F.lit(False))).alias("ok")).where("ok").select("query_id")


def united(parts: list[DataFrame]) -> DataFrame:
    """One corpus of several kinds of canonical documents, rows kept; or one table of judgments."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
