"""Functions on the polymorphic JSON fields ``categorical`` and ``hierarchical``.

Their shapes are told apart by the first character; each is read with a schema whose fields stand in canonical order,
since paths depend on that order. Whatever fits no shape counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORICAL_KEYS = (
    "venue_name", "venue_type", "journal", "journal_volume", "fields_of_study", "publication_types", "specificity", "quality",
)
#: The fields of the nested hierarchy, in canonical order (fixed values).
FIELD_PATH = ("field", "research_area", "topic_family", "specific_topic")
METHOD_PATH = ("method_family", "method_category", "specific_method")
_TEXTS = "array<string>"


def shape(c: Column) -> Column:
    """'list', 'dict' or 'none'."""
    first = F.substring(F.trim(c), 1, 1)
    return F.when(first == "[", "list").when(first == "{", "dict").otherwise("none")


def json_map(c: Column) -> Column:
    """Top-level keys to raw values, in the order of the text; null for other shapes."""
    return F.from_json(F.when(shape(c) == "dict", c), "map<string,string>")


def values_of(raw: Column) -> Column:
    """The values of one raw entry: a list's non-null items, a scalar alone, nothing for null."""
    return F.when(raw.startswith("["), F.from_json(raw, _TEXTS)).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast(_TEXTS))


def nonempty(a: Column) -> Column:
    return F.filter(F.coalesce(a, F.array().cast(_TEXTS)), lambda x: x.isNotNull() & (x != ""))


def categorical_values(c: Column) -> Column:
    """Values of all categorical entries, lists spread; nulls left out, empty strings kept."""
    vals = F.map_values(F.coalesce(json_map(c), F.create_map().cast("map<string,string>")))
    return F.filter(F.flatten(F.transform(vals, values_of)), lambda x: x.isNotNull())


def field_values(c: Column, key: str) -> Column:
    """The non-blank values of one categorical key; values with bars are split."""
    raw = values_of(F.try_element_at(json_map(c), F.lit(key)))
    return split_values(raw)


def split_values(a: Column) -> Column:
    """Values trimmed, those with bars split at them, blank ones dropped."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(a, F.array().cast(_TEXTS)), lambda x: x.isNotNull()), lambda s: F.split(s, "[|]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _path(c: Column, name: str, fields: tuple[str, ...]) -> Column:
    parts = [F.get_json_object(c, f"$.{name}.{f}") for f in fields]
    return nonempty(F.transform(F.array(*parts), lambda x: F.trim(x)))


def flattened(c: Column) -> Column:
    """A hierarchical field as a flat list: a list's filled items, or of an object the values one level down."""
    as_list = F.from_json(F.when(shape(c) == "list", c), _TEXTS)
    m = json_map(c)

    def one(raw: Column) -> Column:
        inner = F.map_values(F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>"))
        return F.when(raw.startswith("{"), inner).otherwise(values_of(raw))

    spread = F.flatten(F.transform(F.map_values(m), one))
    return nonempty(F.coalesce(as_list, spread, F.array().cast(_TEXTS)))


def metadata_text(categorical: Column, hierarchical: Column) -> Column:
    """Categorical values and the flattened hierarchy, joined by blanks."""
    return F.array_join(F.concat(categorical_values(categorical), flattened(hierarchical)), " ")


def paths(c: Column) -> Column:
    """The level lists of a hierarchical field.

    An object gives the field path, the method path and its error list; a list gives one path for each item, cut at
    slashes. Levels are trimmed, blank ones dropped, empty paths left out; affiliations are no paths.
    """
    errors = nonempty(F.from_json(F.get_json_object(c, "$.errors"), _TEXTS))
    of_dict = F.array(_path(c, "field_of_study_path", FIELD_PATH), _path(c, "method_path", METHOD_PATH), errors)
    level = lambda s: nonempty(F.transform(F.split(F.replace(s, F.lit("\\"), F.lit("/")), "/"), lambda x: F.trim(x)))
    items = F.filter(F.from_json(F.when(shape(c) == "list", c), _TEXTS), lambda x: x.isNotNull())
    of_list = F.transform(items, level)
    found = F.when(shape(c) == "dict", of_dict).when(shape(c) == "list", of_list).otherwise(F.array().cast("array<array<string>>"))
    return F.filter(found, lambda p: F.size(p) > 0)


def prefixes(path: Column) -> Column:
    """All prefixes of a path, levels joined by ' / '."""
    steps = F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1)))
    return F.when(F.size(path) > 0, F.transform(steps, lambda i: F.array_join(F.slice(path, F.lit(1), i), " / "))).otherwise(F.array().cast(_TEXTS))


def has_structure(source_type: Column, categorical: Column, hierarchical: Column) -> Column:
    """Whether a document has structured content; queries always count."""
    some = F.exists(categorical_values(categorical), lambda x: x != "")
    return (source_type == "query") | F.coalesce(some, F.lit(False)) | (F.size(flattened(hierarchical)) > 0)


def useless_metadata(categorical: Column, hierarchical: Column) -> Column:
    """Only ratings (specificity, quality), all filled, and no hierarchy."""
    m = json_map(categorical)
    keys = F.map_keys(m)
    only = (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(F.lit("specificity"), F.lit("quality")))) == 0)
    ok = F.forall(F.map_values(m), lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.coalesce(only & ok & (F.size(flattened(hierarchical)) == 0), F.lit(False))


def last_wins(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, the second map's value holds."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def json_object(m: Column) -> Column:
    """A map of raw values as a JSON object: nested values, numbers and literals as they are, other texts quoted."""
    bare = r"^(?:[\[{].*|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)$"
    one = lambda e: F.concat(_quoted(e.key), F.lit(":"), F.when(e.value.isNull(), F.lit("null")).when(e.value.rlike("(?s)" + bare), e.value).otherwise(_quoted(e.value)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), one), ","), F.lit("}"))


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def repaired(raw: Column) -> Column:
    """Model output made JSON: comments and fences dropped, cut from the first brace to the last."""
    s = F.regexp_replace(raw, r"(?m)//.*?$", "")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", "")
    s = F.trim(F.regexp_replace(s, r"```(?:json)?", ""))
    body = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(s)


def parse_hierarchy(raw: Column) -> Column:
    """(value, error) of a model's hierarchy text.

    Tried in order: the text itself; the repaired text; the repaired text as a list of fragments, whose objects are
    merged (later keys win) and whose lists become affiliations. Errors: missing_hierarchy_info, JSONDecodeError,
    hierarchy_info_not_dict.
    """
    text, fixed = F.trim(raw), repaired(raw)
    # a text is one JSON value if, in brackets, it is an array of one
    within = lambda s: F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")
    first, second = (F.coalesce(F.size(within(s)) == 1, F.lit(False)) for s in (text, fixed))
    fragments = within(fixed)
    several = F.size(fragments) > 1
    merged = json_object(
        F.aggregate(
            fragments, F.create_map().cast("map<string,string>"),
            lambda acc, x: F.when(x.startswith("{"), last_wins(acc, F.from_json(x, "map<string,string>")))
            .when(x.startswith("["), last_wins(acc, F.create_map(F.lit("affiliations"), x)))
            .otherwise(acc),
        )
    )
    kind = lambda s: F.substring(F.trim(s), 1, 1)
    not_dict = F.struct(F.lit(None).cast("string").alias("value"), F.lit("hierarchy_info_not_dict").alias("error"))
    good = lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("error"))
    bad = lambda e: F.struct(F.lit(None).cast("string").alias("value"), F.lit(e).alias("error"))
    return (
        F.when(raw.isNull() | (text == ""), bad("missing_hierarchy_info"))
        .when(first, F.when(kind(text) == "{", good(text)).otherwise(not_dict))
        .when(second, F.when(kind(fixed) == "{", good(fixed)).otherwise(not_dict))
        .when(several, good(merged))
        .otherwise(bad("JSONDecodeError"))
    )
