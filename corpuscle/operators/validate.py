"""Checks of documents and caches that report instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.structured import FIELD_PATH, METHOD_PATH
from corpuscle.functions.text import has_json_object

#: Phrases by which a model says that it has no metadata (fixed values).
BABBLE = (
    "i don't have the actual title", "i don’t have the actual title", "i need:", "please supply the missing metadata",
    "please provide the missing metadata", "to fill the schema correctly", "title, abstract, affiliations",
    "i cannot fill the schema", "i need the title", "i need the abstract",
)
#: Sectors an affiliation may have (fixed values).
SECTORS = ("Academic", "Industry", "Government", "Healthcare", "Nonprofit", "Independent")


def babble(text: Column) -> Column:
    """Whether a model's text only says that metadata are missing."""
    low = F.lower(text)
    said = F.lit(False)
    for p in BABBLE:
        said = said | low.contains(p)
    return F.coalesce(said & ~has_json_object(text), F.lit(False))


def problems(docs: DataFrame) -> DataFrame:
    """(doc_id, problem): what is wrong with the hierarchies of papers; affiliation problems once for each affiliation."""
    h = F.col("hierarchical")
    get = lambda p: F.get_json_object(h, f"$.{p}")
    part = lambda name: F.from_json(get(name), "map<string,string>")
    clean = lambda fields, name: F.filter(
        F.array(*[F.lower(F.trim(get(f"{name}.{f}"))) for f in fields]), lambda x: x.isNotNull()
    )
    field_labels, method_labels = clean(FIELD_PATH, "field_of_study_path"), clean(METHOD_PATH, "method_path")
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    rules = [(f"missing key {k}", get(k).isNull()) for k in ("affiliations", "field_of_study_path", "method_path")]
    whole = part("field_of_study_path").isNotNull() & part("method_path").isNotNull()
    rules += [(f"missing {f}", whole & missing(get(f"field_of_study_path.{f}"))) for f in FIELD_PATH]
    rules += [(f"missing {f}", whole & missing(get(f"method_path.{f}"))) for f in METHOD_PATH]
    rules += [
        ("repeated label in field_of_study_path", repeated(field_labels)), ("repeated label in method_path", repeated(method_labels)),
        ("label of more than 8 words", F.exists(field_labels, lambda x: F.size(F.split(x, r"\s+")) > 8)),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]))
    each = F.from_json(get("affiliations"), "array<struct<organization:string,country:string,sector:string>>")
    of_one = lambda a: F.array_compact(F.array(
        F.when(missing(a.organization), "affiliation without organization"), F.when(missing(a.country), "affiliation without country"),
        F.when(~missing(a.sector) & ~a.sector.isin(*SECTORS), "unknown sector"),
    ))
    more = F.coalesce(F.flatten(F.transform(each, of_one)), F.array().cast("array<string>"))
    return docs.where(F.col("source_type") == "paper").select("doc_id", F.explode(F.concat(found, more)).alias("problem"))


def most_common(rows: DataFrame, value: Column, n: int = 20) -> DataFrame:
    """(value, n) of the n most frequent values, ties by value."""
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def duplicates(rows: DataFrame, on: list[str]) -> DataFrame:
    """All rows whose values of ``on`` occur more than once."""
    often = rows.groupBy(*on).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    same = None
    for c in on:
        one = rows[c].eqNullSafe(often[c])
        same = one if same is None else same & one
    return rows.join(often, same, "left_semi")


def fingerprint(rows: DataFrame, columns: list[str], digits: int = 12) -> DataFrame:
    """One row (n_rows, fingerprint): a hash of all rows that does not depend on their order.

    The rows' SHA-256 are cut to 60 bits and summed exactly, so there is neither a sort nor one long string.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.sum(part).alias("s")).select("n_rows", F.substring(F.md5(F.col("s").cast("string")), 1, digits).alias("fingerprint"))


def costs(tokens: DataFrame, prices: dict[str, tuple[float, float]], output_tokens: float, batch: bool = False) -> DataFrame:
    """(model, n_requests, avg_input_tokens, cost) of a run; prices are for a million input and output tokens."""
    s = tokens.agg(F.count("*").alias("n_requests"), F.avg("n_tokens").alias("avg_input_tokens"), F.sum("n_tokens").alias("t"))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, (a, b) in prices.items()])
    cost = (F.col("t") * F.col("p.a") + F.col("n_requests") * output_tokens * F.col("p.b")) / 1e6 * (0.5 if batch else 1.0)
    return s.withColumn("p", F.explode(rows)).select("p.model", "n_requests", F.round("avg_input_tokens", 6).alias("avg_input_tokens"), F.round(cost, 6).alias("cost"))


def checked_budget(estimated: DataFrame, budget: float) -> DataFrame:
    """The estimate, or a ValueError if a model's cost is above the budget."""
    over = estimated.where(F.col("cost") > budget).limit(1).collect()
    if over:
        raise ValueError(f"{over[0]['model']} would cost {over[0]['cost']}, more than {budget}")
    return estimated
