"""Text functions on columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, spelled out so that every regular expression engine agrees.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def filled(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def blank(c: Column) -> Column:
    """Whether a text is null or white space only."""
    return F.coalesce(F.regexp_replace(c, f"{SPACE}+", "") == "", F.lit(True))


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space; punctuation stays. Null gives an empty list."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+")
    return F.filter(parts, lambda t: t != "")


def prepared(title: Column, labels: Column | None, main: Column) -> Column:
    """Title, labels and main text joined by blanks; empty ones left out, labels behind the title."""
    return F.concat_ws(" ", filled(title), *([] if labels is None else [filled(labels)]), filled(main))


def slug(c: Column, longest: int = 80, kept: int = 70) -> Column:
    """Lower case, runs of other characters than letters, digits, ``_.-`` to a hyphen; a long slug is cut and gets the start of its MD5."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_.-]+", "-"), "^-+|-+$", "")
    s = F.coalesce(F.nullif(s, F.lit("")), F.lit("comparison"))
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, kept), F.lit("-"), F.substring(F.md5(c), 1, 10))).otherwise(s)


def wrapped(parts: Column, longest: int = 70, between: str = " | ") -> Column:
    """Parts joined into lines of at most ``longest`` characters where they fit; a longer part has a line of its own."""
    last = lambda s: F.length(F.substring_index(s, "\n", -1))
    fits = lambda s, p: last(s) + len(between) + F.length(p) <= longest
    joined = lambda s, p: F.when(s == "", p).otherwise(F.concat(s, F.when(fits(s, p), F.lit(between)).otherwise(F.lit("\n")), p))
    return F.aggregate(parts, F.lit(""), joined)


def percent_change(value: Column, base: Column) -> Column:
    """Change against a baseline in percent; 0 where the baseline is 0."""
    return F.when(base != 0, (value - base) / base * 100).otherwise(F.lit(0.0))


def has_json_object(c: Column) -> Column:
    return F.coalesce(c.contains("{") & c.contains("}"), F.lit(False))


_RESPONSE = "struct<output_text:string,output:array<struct<content:array<struct<type:string,text:string>>>>>"


def output_text(response: Column) -> Column:
    """The text of a model response: ``output_text``, or else the nested parts of that type joined by line breaks."""
    r = F.from_json(response, _RESPONSE)
    contents = F.flatten(F.transform(F.coalesce(r.output, F.array().cast("array<struct<content:array<struct<type:string,text:string>>>>")), lambda o: F.coalesce(o.content, F.array().cast("array<struct<type:string,text:string>>"))))
    parts = F.transform(F.filter(contents, lambda c: c.type == "output_text"), lambda c: F.coalesce(c.text, F.lit("")))
    return F.coalesce(r.output_text, F.array_join(parts, "\n"))
