"""Queries of the sources, sinks, row constructors, enrichment, requests, batches and utilities over the test tables.

Sources and sinks are run as round trips: what a sink writes into the session's shared folder, the reader of that form reads
back. Inputs of a form the tables lack (raw issues, papers, caches, model answers) are made from the tables first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import structured, text
from corpuscle.operators import align, bench, enrich, graph, metrics, requests, retrieval, sampling, search, validate
from corpuscle.plans.reference import K, _dense, _fields, asked, corpus, docs, explicit_edges, out, truth, vector_edges
from corpuscle.session import checkpoint_dir, cut, table
from corpuscle.sources import readers, sinks

#: Packages the engine needs, and one that no machine has.
PACKAGES = ["numpy", "pandas", "pyarrow", "pyspark", "no_such_package"]
#: A small attention network: hidden numbers, and the attention vectors of receiver and sender.
FIRST = {"weight": [0.8, -0.5], "to": [0.3, 0.2], "of": [0.6, -0.4]}
SECOND = {"weight": [1.1, 0.7], "to": [0.4], "of": [0.5]}
PROMPT = "Place this paper: {title}\nAbstract: {abstract}\nBy: {affiliations}\nAbout: {topics}"
STATUSES = ("completed", "in_progress", "failed", "validating", "expired")


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"


def no_texts() -> Column:
    return F.array().cast("array<string>")


def joined(c: str) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)


# sources of raw data


def raw_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues and the pulls of their links as raw nested records, written as JSON arrays and read back."""
    issues = table(spark, d, "issues_df").dropDuplicates(["issue_key"])
    pull = F.struct(
        F.col("pull_url"), F.concat(F.lit("Pull of "), "issue_key").alias("pull_title"),
        F.struct(F.substring_index("issue_key", "#", 1).alias("nameWithOwner")).alias("repository"),
    )
    nodes = table(spark, d, "links").where("issue_key is not null").groupBy("issue_key").agg(
        F.array_sort(F.collect_list(F.struct(pull.alias("pull_info")))).alias("nodes")
    )
    label = F.transform(F.split("labels", "[|]"), lambda x: F.struct(F.struct(x.alias("label")).alias("node")))
    comment = F.transform(F.split("comments", r" \| "), lambda x: F.struct(F.struct(x.alias("comment_body")).alias("node")))
    raw = issues.join(nodes, "issue_key", "left").select(
        F.col("issue_no").cast("string").alias("issue_no"), "issue_url", "issue_title", "issue_body", "created_at", "closed_at",
        F.struct(F.col("repository").alias("nameWithOwner")).alias("issue_repository"), F.struct(label.alias("edges")).alias("issue_labels"),
        F.struct(comment.alias("edges")).alias("issue_comments"), F.struct("nodes").alias("timelineItems"),
    )
    path = folder(spark)
    sinks.json_arrays(raw, path, "issue_url", 300)
    return readers.raw_issues(spark, path)


def source_issues(spark: SparkSession, d: str) -> DataFrame:
    got = align.flat_issues(raw_issues(spark, d))
    return got.select("issue_no", "issue_key", "issue_url", F.md5("issue_body").alias("body_md5"), "repository", "created_at", "closed_at", "labels")


def comment_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Comments joined for an issue, and cut again at every bar for its document."""
    got = align.flat_issues(raw_issues(spark, d)).select("issue_key", "comments", F.split("comments", "[|]").alias("c"))
    return got.select("issue_key", F.md5("comments").alias("comments_md5"), F.size("c").cast("long").alias("n_pieces"), F.element_at("c", -1).alias("last_piece"))


def source_pulls(spark: SparkSession, d: str) -> DataFrame:
    return align.flat_pulls(raw_issues(spark, d), "issue_url").select("pull_url", "pull_title", "repository")


def source_links(spark: SparkSession, d: str) -> DataFrame:
    return align.flat_links(raw_issues(spark, d)).groupBy("issue_url", "issue_key", "pull_url").agg(F.count("*").alias("n"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers of the documents as a paper corpus in parquet, with running ids."""
    x = docs(spark, d).where("source_type = 'paper'")
    cited = F.transform(F.coalesce("explicit_related_ids", no_texts()), lambda e: align.plain_id(e).try_cast("bigint"))
    raw = x.select(F.col("id").cast("long").alias("corpusid"), "title", F.col("main_text").alias("abstract"), cited.alias("citations"), F.get("secondary_texts", F.lit(0)).alias("full_paper"))
    path = folder(spark)
    raw.write.parquet(path)
    return align.numbered(readers.papers(spark, path), [F.col("corpusid")]).withColumn("id", F.col("id").cast("string"))


def paper_documents(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    ids = cut(p.select(F.col("corpusid").cast("string").alias("native"), "id"))
    cites = p.select("corpusid", F.transform("citations", lambda c: c.cast("string")).alias("citations"))
    x = align.paper_documents(p, align.resolved(cites, "corpusid", "citations", ids, "native", "related"))
    return x.select(
        "id", F.col("raw_source.native_id").alias("native_id"), F.md5("main_text").alias("text_md5"), F.size("secondary_texts").cast("long").alias("n_secondary"),
        F.array_join("relations.explicit_related_ids", " ").alias("related"), F.col("retrieval_metadata.is_candidate").alias("is_candidate"),
    )


def _paper_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = docs(spark, d).where("source_type = 'query'")
    rating = lambda k: F.get_json_object("categorical", f"$.{k}")
    gold = align.long_qrels(table(spark, d, "qrels")).where("relation_type = 'corpusid_match'").groupBy(F.col("query_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.col("candidate_id").try_cast("bigint"))).alias("corpusids")
    )
    raw = x.join(gold, "id").select("doc_id", F.col("source_dataset").alias("query_set"), F.col("main_text").alias("query"), rating("specificity").alias("specificity"), rating("quality").alias("quality"), "corpusids")
    path = folder(spark)
    raw.write.parquet(path)
    numbered = align.numbered(spark.read.parquet(path), [F.col("query_set"), F.col("doc_id")], 1_000_000).withColumn("id", F.col("id").cast("string"))
    return align.query_documents(numbered, papers(spark, d))


def query_documents(spark: SparkSession, d: str) -> DataFrame:
    x = _paper_queries(spark, d)[0]
    rating = lambda k: F.get_json_object("structured_fields.categorical", f"$.{k}").alias(k)
    return x.select("id", "source_dataset", F.md5("main_text").alias("text_md5"), rating("specificity"), rating("quality"), F.col("retrieval_metadata.is_candidate").alias("is_candidate"))


def query_qrels(spark: SparkSession, d: str) -> DataFrame:
    return _paper_queries(spark, d)[1].select("query_id", F.array_join("candidate_ids", " ").alias("candidates"), "relation_type")


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Issues, papers and queries as one corpus of canonical documents, counted by kind."""
    issues = table(spark, d, "issues_df").dropDuplicates(["issue_key"]).withColumn("id", F.col("issue_key"))
    nothing = spark.createDataFrame([], "issue_key string, related array<string>")
    a = align.issue_documents(issues, align.normalised_labels(issues, table(spark, d, "label_mapping")), nothing)
    p = papers(spark, d)
    b = align.paper_documents(p, spark.createDataFrame([], "corpusid long, related array<string>"))
    every = align.united([a, b, _paper_queries(spark, d)[0]])
    return every.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if("retrieval_metadata.is_candidate").alias("n_candidates"), F.sum(F.length("main_text")).alias("n_chars"))


def corpus_ids(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    sinks.ids(docs(spark, d).where("source_type = 'paper'"), "id", path)
    return readers.lines(spark, path)


def unprocessed_papers(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 papers that nothing cites, those being taken as processed."""
    x = docs(spark, d)
    done = x.select(F.explode("explicit_related_ids").alias("e")).select(align.plain_id(F.col("e")).alias("id")).where("id is not null").distinct()
    return readers.unprocessed(x, done, 100).select("id", "doc_id")


# round trips of other forms


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Canonical papers through JSON lines."""
    path = folder(spark)
    flat = docs(spark, d).drop("doc_id", "ingested_at", "removed_at", "text", "lang", "source", "n_chars")
    sinks.json_lines(align.nest(flat), path)
    x = readers.documents(spark, path, "paper")
    return x.select(
        "id", F.md5("title").alias("title_md5"), F.md5("main_text").alias("text_md5"), F.size("entities.people").cast("long").alias("n_people"),
        F.col("structured_fields.hierarchical").alias("hierarchical"), F.col("retrieval_metadata.is_queryable").alias("is_queryable"),
    )


def label_map_csv(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    sinks.csv(table(spark, d, "label_mapping").orderBy("line_no").coalesce(1).select("raw_label", "normalized_path"), path)
    return align.label_map(readers.label_map(spark, path))


def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    sinks.graph(explicit_edges(spark, d), path)
    return readers.graph(spark, path).unionByName(readers.graph(spark, f"{path}-missing")).select("src", "dst", "relation", "weight")


def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Means of a method through a results file."""
    v, q, same = _dense(spark, d)
    means = metrics.means(metrics.evaluate(retrieval.dense(v, q, K), same)).select(F.lit("dense").alias("method"), "metric", "k", "mean")
    path = folder(spark)
    local = path.removeprefix("file://").removeprefix("file:")
    sinks.results(means, bench.Config().block(), f"{local}/results.json")
    return readers.results(spark, f"{path}/results.json")


def cache_append(spark: SparkSession, d: str) -> DataFrame:
    """A cache written in two parts and read as one."""
    path, x = folder(spark), docs(spark, d).select("id", "source_type", "n_chars")
    for part in (x.where("source_type = 'paper'"), x.where("source_type <> 'paper'")):
        sinks.cache(part, path)
    return spark.read.parquet(path)


def index_cache(spark: SparkSession, d: str) -> DataFrame:
    """The token table from a cache keyed by content; the second reading builds nothing."""
    x, path = retrieval.with_texts(docs(spark, d)), folder(spark)

    def build() -> DataFrame:
        return search.term_index(x, ["plain"])

    def never() -> DataFrame:
        raise AssertionError("an index of this content is there")

    for make in (build, never):
        got = readers.indexed(spark, path, x, ["doc_id", "plain"], {"method": "lexical", "text": "plain"}, make)
    return got.select("doc_id", F.col("plain_len").alias("n_tokens"), F.size("plain").cast("long").alias("n_terms"))


def fetched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Papers asked of a service in batches, which fails at first; those of an earlier run are not asked for again."""
    x = docs(spark, d).where("source_type = 'paper'")
    done = x.where(F.size("explicit_related_ids") > 0).select("id")

    def service(ids: list[str]) -> list[dict]:
        return [{"id": i, "twice": 2 * int(i), "batch": len(ids) <= 50} for i in ids]

    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("twice", T.LongType()), T.StructField("batch", T.BooleanType())])
    return readers.fetched(x.select("id"), "id", service, kind, 50, 4, done)


def environment_checks(spark: SparkSession, d: str) -> DataFrame:
    """(name, ok): packages and inputs that a run needs."""
    missing = set(readers.missing_packages(PACKAGES))
    rows = [(n, n not in missing) for n in PACKAGES] + [(n, readers._exists(spark, f"{d}/{n}.parquet")) for n in ("documents", "qrels", "no_such_table")]
    return spark.createDataFrame(rows, "name string, ok boolean")


# enrichment


def _metadata_stage(spark: SparkSession, x: DataFrame) -> DataFrame:
    """Papers with the metadata of a cache file; what has no organizations is not in it."""
    author = F.transform(F.coalesce("people", no_texts()), lambda p: F.struct(p.alias("name"), F.array_compact("organizations").alias("affiliations")))
    value = lambda k: F.get_json_object("categorical", f"$.{k}")
    meta = F.struct(
        F.col("doc_id").alias("corpusId"), F.struct(value("venue_name").alias("name"), value("venue_type").alias("type")).alias("publicationVenue"),
        F.col("topics").alias("fieldsOfStudy"), structured.field_values(F.col("categorical"), "publication_types").alias("publicationTypes"),
        F.struct(value("journal").alias("name"), value("journal_volume").alias("volume")).alias("journal"), author.alias("authors"),
    )
    path = folder(spark)
    some = x.where((F.col("source_type") == "paper") & (F.size("organizations") > 0))
    sinks.json_objects(some.select(F.col("id").alias("key"), meta.alias("meta")), path, "key", "meta", 200)
    papers_ = x.where("source_type = 'paper'").drop("native_id").withColumnRenamed("id", "native_id")
    return enrich.with_metadata(papers_, readers.metadata_cache(spark, path)).withColumnRenamed("native_id", "id")


def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    got = _metadata_stage(spark, docs(spark, d))
    return got.select(
        "id", joined("people"), joined("organizations"), joined("topics"),
        F.get_json_object("categorical", "$.venue_name").alias("venue_name"),
    )


def hierarchy_repair(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchies as models write them (bare, fenced with comments, in prose, as fragments, broken, missing), repaired from a cache."""
    x = docs(spark, d).where("source_type = 'paper' and id is not null")
    h, kind = F.coalesce("hierarchical", F.lit("{}")), F.length(F.coalesce("title", F.lit(""))) % 6
    said = (
        F.when(kind == 0, h).when(kind == 1, F.concat(F.lit("```json\n/* as asked */ "), h, F.lit("\n```\n// done")))
        .when(kind == 2, F.concat(F.lit("Sure, here it is: "), h, F.lit(" Hope that helps.")))
        .when(kind == 3, F.concat(F.lit('{"note": {"by": "m"}}, '), h)).when(kind == 4, F.concat(F.lit("no json "), "id"))
    )
    path = folder(spark)
    sinks.json_objects(x.select(F.col("id").alias("key"), F.struct(said.alias("hierarchy_info")).alias("v")), path, "key", "v", 200)
    cache = readers.hierarchy_cache(spark, path).select("native_id", "hierarchy_info")
    bare = x.drop("native_id").withColumnRenamed("id", "native_id").withColumn("hierarchical", F.lit("{}"))
    got, at = enrich.with_hierarchy(bare, cache), F.col("hierarchical")
    value = lambda k: F.get_json_object(at, f"$.{k}").alias(k.replace(".", "_").replace("[0]", ""))
    return got.select(F.col("native_id").alias("id"), value("errors[0]"), value("note.by"), value("field_of_study_path.field"), value("method_path.specific_method"))


def enriched_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two dataset stages in turn: documents pass, judgments grow by citation queries."""
    x = docs(spark, d).where("source_type = 'paper'")
    long = align.long_qrels(table(spark, d, "qrels"))

    def metadata(a: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
        return enrich.enriched(a, [lambda y: _metadata_stage(spark, y)]), q

    def citations(a: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = enrich.citation_queries(x).select("query_id", F.explode("candidate_ids").alias("c"), "relation_type")
        new = new.select("query_id", align.plain_id(F.col("c")).alias("candidate_id"), "relation_type").where("candidate_id is not null")
        return a, align.united([q, new])

    a, q = enrich.enriched_dataset(x, long, [metadata, citations])
    return q.groupBy("relation_type").agg(F.count("*").alias("n")).crossJoin(a.agg(F.count("*").alias("n_documents")))


def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Categorical fields with two keys written over them; the later value holds."""
    m = structured.json_map(F.coalesce("categorical", F.lit("{}")))
    new = F.create_map(F.lit("journal"), F.col("source_dataset"), F.lit("lang"), F.coalesce("lang", F.lit("none")))
    got = docs(spark, d).select("doc_id", structured.last_wins(F.coalesce(m, F.create_map().cast("map<string,string>")), new).alias("m"))
    return got.select("doc_id", F.size("m").cast("long").alias("n_keys"), F.col("m")["journal"].alias("journal"), F.col("m")["lang"].alias("lang"))


# judgments, requests, batches


def relation_choices(spark: SparkSession, d: str) -> DataFrame:
    long = align.long_qrels(table(spark, d, "qrels"))
    every = [("all", [], False), ("papers", ["citation", "corpusid_match"], False), ("linked", ["citation"], True)]
    parts = [align.of_relations(long, kinds, linked).agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_queries")).select(F.lit(name).alias("choice"), "n", "n_queries") for name, kinds, linked in every]
    return align.united(parts)


def training_queries(spark: SparkSession, d: str) -> DataFrame:
    long, ids = align.long_qrels(table(spark, d, "qrels")), docs(spark, d).select("id")
    parts = [align.trainable(long, ids, e).select("query_id", F.lit(e).alias("every")) for e in (True, False)]
    return parts[0].union(parts[1])


def babble_flags(spark: SparkSession, d: str) -> DataFrame:
    """Answers that only ask for metadata; with an object in them they are none."""
    answer = F.when(F.col("source_type") == "paper", F.concat(F.lit("I need the title: "), F.coalesce("main_text", F.lit("")))).otherwise(F.col("main_text"))
    x = docs(spark, d).select("doc_id", answer.alias("a"))
    return x.select("doc_id", validate.babble(F.col("a")).alias("babble"), text.has_json_object(F.col("a")).alias("has_object"))


def paper_requests(spark: SparkSession, d: str) -> DataFrame:
    """Request lines in chunks of 100, written and read back."""
    f = requests.paper_fields(docs(spark, d).where("source_type = 'paper'"))
    lines = requests.request_lines(f, "id", requests.prompt(PROMPT, "title", "abstract", "affiliations", "topics"), "mini").select("id", "value")
    path = folder(spark)
    sinks.requests(lines, path, "id", 100)
    got = spark.read.text(path).select("chunk", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.value").alias("v"))
    value = lambda p: F.get_json_object("v", p)
    return got.select(F.col("chunk").cast("long").alias("chunk"), "id", value("$.method").alias("method"), value("$.body.model").alias("model"), F.md5(value("$.body.input")).alias("input_md5"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 40 papers with a status each."""
    c = align.chunks(docs(spark, d).where("source_type = 'paper'").select("id"), [F.col("id")], 40)
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("chunk") % len(STATUSES) + 1).cast("int"))
    return c.groupBy("chunk").agg(F.collect_list("id").alias("paper_ids")).select("chunk", status.alias("status"), "paper_ids")


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    b = manifest(spark, d)
    return bench.manifest_counts(b).crossJoin(bench.failed_counts(b))


def unsubmitted_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers in no batch that did not fail, without those that have no topics."""
    x = docs(spark, d).where("source_type = 'paper'")
    none = x.where(F.coalesce(F.size("topics"), F.lit(0)) <= 0).select("id")
    return bench.unsubmitted(x, bench.without_failed(manifest(spark, d)), none)


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    b = manifest(spark, d)
    steps = b.select("chunk", (F.col("status") != "failed").alias("ok"), F.size("paper_ids").cast("double").alias("seconds"))
    return bench.progress(steps, "chunk", 1000)


class Echo:
    """A service that answers every request with a line from its text; each batch is done at the second look."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.looks = spark, {}, {}

    def submit(self, path: str) -> str:
        name = f"b{len(self.paths)}"
        self.paths[name], self.looks[name] = path, 0
        return name

    def status(self, batch_id: str) -> str:
        self.looks[batch_id] += 1
        return "in_progress" if self.looks[batch_id] < 2 else "completed"

    def download(self, batch_id: str, path: str) -> None:
        asked = self.spark.read.text(self.paths[batch_id])
        said = F.struct(F.lit("output_text").alias("type"), F.md5(F.get_json_object("value", "$.body.input")).alias("text"))
        thought = F.struct(F.lit("reasoning").alias("type"), F.lit("hm").alias("text"))
        body = F.struct(F.array(F.struct(F.array(thought, said).alias("content"))).alias("output"))
        line = F.struct(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.struct(body.alias("body")).alias("response"))
        asked.select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)


def batch_run(spark: SparkSession, d: str) -> DataFrame:
    """All papers through a batch service, two batches at a time."""
    x = docs(spark, d).where("source_type = 'paper'")
    lines = requests.request_lines(x, "id", requests.prompt("{title}", "title"), "nano").select("id", "value")
    b = bench.Batches(spark, folder(spark), Echo(spark))
    b.prepare(lines, "id", max(100, -(-lines.count() // 6)))
    return b.run(0.0).select("custom_id", "answer")


def answer_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of nested answers: parts of other types do not count."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    content = lambda *p: F.struct(F.array(*p).alias("content"))
    nested = F.to_json(F.struct(F.array(content(part("reasoning", F.col("id")), part("output_text", F.col("title"))), content(part("output_text", F.col("lang")))).alias("output")))
    plain = F.to_json(F.struct(F.col("title").alias("output_text")))
    x = docs(spark, d).where("title is not null").select("doc_id", F.when(F.col("source_type") == "paper", nested).otherwise(plain).alias("r"))
    return x.select("doc_id", text.output_text(F.col("r")).alias("answer"))


# texts, metrics, samples


def slugs(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("title is not null")
    named = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("")))
    parts = F.array(*[named(c) for c in ("lang", "source", "source_type", "native_id", "source_dataset")])
    return x.select("doc_id", text.slug(F.col("title")).alias("slug"), text.wrapped(parts).alias("wrapped"))


def metric_selection(spark: SparkSession, d: str) -> DataFrame:
    v, q, same = _dense(spark, d)
    return metrics.selected(metrics.means(metrics.evaluate(retrieval.dense(v, q, K), same)), ["mrr", "ndcg", "recall"], [10])


def token_sample(spark: SparkSession, d: str) -> DataFrame:
    """Mean length of a sample of 1,000 papers, for an estimate of costs."""
    x = docs(spark, d).where("source_type = 'paper'")
    n = F.size(text.tokens(text.prepared(F.col("title"), None, F.col("main_text"))))
    return sampling.sample(x, "id", 1000).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avg_tokens"))


def method_runs(spark: SparkSession, d: str) -> DataFrame:
    """Registered methods against the same judgments."""
    t = cut(truth(spark, d))
    c = corpus(spark, d)
    q = asked(c, t)
    known = t.join(q.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    return bench.run(c, q, known, ["bm25", "dense_labels"])


def config_block(spark: SparkSession, d: str) -> DataFrame:
    c = bench.parse(["--baseline", "bm25", "--methods", "charm", "graph_sage", "--ks", "5", "10", "--sample", "100"]).block()
    return spark.createDataFrame([(k, str(c[k])) for k in ("baseline", "methods", "ks", "sample", "seed", "trials")], "name string, value string")


# graphs


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the document graph with their attributes."""
    return graph.attributes(docs(spark, d)).select("doc_id", "part", F.md5("title").alias("title_md5"), joined("people"), F.size("topics").cast("long").alias("n_topics"))


def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation, weight, part): explicit links, shared fields and shared path prefixes of papers and of issues."""
    x = docs(spark, d).where("source_type in ('paper', 'github_issue')")
    nodes = graph.valid_nodes(x)
    relation = F.when(F.col("source_type") == "paper", "citation").otherwise("linked_issue")
    prefixes = F.flatten(F.transform(structured.paths(F.col("hierarchical")), structured.prefixes))
    part = nodes.select(F.col("doc_id").alias("src"), F.col("source_type").alias("part"))
    explicit = graph.explicit_edges(x, relation, nodes).join(part, "src")
    # links lead from one kind to the other too; a graph has only its own kind
    explicit = explicit.join(part.withColumnRenamed("src", "dst"), ["dst", "part"])
    edges = [
        explicit, graph.shared_edges(_fields(x), 0.5, nodes), graph.shared_edges(graph.keys(x, "share hierarchical path", prefixes, F.col("source_type")), 0.75, nodes)
    ]
    return align.united([e.select("src", "dst", "relation", "weight", "part") for e in edges])


def document_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return document_graph(spark, d).groupBy("part", "relation").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def sage_documents_topk(spark: SparkSession, d: str) -> DataFrame:
    """Graph expansion over the graphs of papers and issues, from the lexical shortlist of labelled texts."""
    c, t = corpus(spark, d), cut(truth(spark, d))
    index = cut(retrieval.candidates(c).where("source_type in ('paper', 'github_issue')").select("doc_id", "labelled", F.col("source_type").alias("part")))
    entries = retrieval.lexical_entries(search.term_index(asked(c, t), ["labelled"]), {"labelled": F.lit(1.0)})
    seeds = cut(search.sparse_search(search.term_index(index, ["labelled"]), entries, 2 * K, {"labelled": 1.0}, search.lexical_weights))
    return out(retrieval.expand(seeds.join(index.select("doc_id", "part"), "doc_id"), cut(document_graph(spark, d)), index, K))


def gat_net_topk(spark: SparkSession, d: str) -> DataFrame:
    """The attention network over distances to every vector, with given weights."""
    v, q, _ = _dense(spark, d)
    features = search.dense_scores(v, q, epsilon=1e-10).select("query_id", "doc_id", F.round(1 - F.col("score"), 9).alias("x"))
    return out(retrieval.attend(cut(features), cut(vector_edges(v)), FIRST, SECOND, K))


def gnn_training(spark: SparkSession, d: str) -> DataFrame:
    """(layer, alpha): weights of the propagation rounds trained on the training part of the queries, two epochs."""
    v, q, same = _dense(spark, d)
    mine = bench.split_queries(same, 0.5)
    start = search.dense_scores(v, q, epsilon=1e-10).join(mine, "query_id", "left_semi").select("query_id", "doc_id", F.round(1 - F.col("score"), 9).alias("h"))
    alphas = bench.train_alphas(start, vector_edges(v), same.join(mine, "query_id", "left_semi"), layers=2, epochs=2)
    return spark.createDataFrame(list(enumerate(alphas)), "layer long, alpha double")


def graph_method_runs(spark: SparkSession, d: str) -> DataFrame:
    """The graph methods through the registry's form."""
    v, q, _ = _dense(spark, d)
    methods = bench.graph_methods(vector_edges(v), lambda x: x.select("doc_id", F.lit("v").alias("part")))
    return align.united([out(m(v, q, K)).withColumn("method", F.lit(n)) for n, m in methods.items()])


QUERIES = {
    f.__name__: f
    for f in (
        source_issues, comment_assembly, source_pulls, source_links, paper_documents, query_documents, query_qrels, corpus_union, corpus_ids, unprocessed_papers,
        jsonl_round_trip, label_map_csv, graph_round_trip, results_round_trip, cache_append, index_cache, fetched_metadata, environment_checks,
        paper_metadata, hierarchy_repair, enriched_counts, merged_maps, relation_choices, training_queries, babble_flags, paper_requests,
        manifest_counts, unsubmitted_papers, run_progress, batch_run, answer_texts, slugs, metric_selection, token_sample, method_runs, config_block,
        graph_nodes, document_graph_counts, sage_documents_topk, gat_net_topk, gnn_training, graph_method_runs,
    )
}
