"""Text functions as Column expressions. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script, also where \\w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
MASK = "[MASKED]"
# Words that long-document queries leave out.
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to what when where why with".split()


def tokens(text: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_tokens(query: str | None) -> list[str]:
    """H01 for a query that is a parameter."""
    return re.findall(r"\w+", (query or "").lower())


def ascii_tokens(text: Column, least: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 in first-seen order, without short ones and stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS)))


def match_form(text: Column) -> Column:
    """Runs of a-z and 0-9 with one space between them."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def keyword_hit(text: Column, keyword: str) -> Column:
    """The keyword occurs; null text is empty; an underscore stands for any character."""
    return F.lower(F.coalesce(text, F.lit(""))).like(f"%{keyword}%")


def literal(keyword: Column) -> Column:
    """A pattern that matches the keyword itself."""
    return F.regexp_replace(keyword, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")


def masked(text: Column, keywords: Column) -> Column:
    """Each keyword of an array in turn, in any case, replaced; a null array leaves the text."""
    out = F.aggregate(keywords, text, lambda t, k: F.when(F.length(k) > 0, F.regexp_replace(t, F.concat(F.lit("(?iu)"), literal(k)), F.lit(MASK))).otherwise(t))
    return F.when(keywords.isNull(), text).otherwise(out)


def masked_json(document: Column, keys: Column) -> Column:
    """Values of the object's own fields whose names are in keys (in any case); text that is no object stays."""
    low = F.transform(keys, F.lower)
    fields = F.from_json(document, "map<string,string>")
    out = F.to_json(F.transform_values(fields, lambda k, v: F.when(F.array_contains(low, F.lower(k)), F.lit(MASK)).otherwise(v)))
    return F.when(fields.isNull() | keys.isNull(), document).otherwise(out)


def level0(text: Column, kind: Column) -> Column:
    """The short form of a content; of a skill its first line, if that has text."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.left(F.when((kind == "skill") & (line != ""), line).otherwise(text), F.lit(80))


def level1(text: Column) -> Column:
    return F.left(text, F.lit(300))


def summary(text: Column, fallback: Column) -> Column:
    """White space as one space, 200 characters at most, or the fallback."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.coalesce(flat, F.lit("")) == "", fallback).otherwise(F.left(flat, F.lit(200)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(text: Column, words: list[str]) -> Column:
    """Where any of some literal words begins (from 0), overlapping ones too: the text is cut before each of them, in one pass."""
    if not words:
        return F.array().cast("array<int>")
    any_of = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, piece: F.struct((s["at"] + F.length(piece)).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    cuts = F.aggregate(F.split(text, f"(?={any_of})"), begin, step, lambda s: s["out"])
    return F.slice(cuts, F.when(text.rlike(f"^(?:{any_of})"), 1).otherwise(2), F.lit(2**30))


def occurrences(text: Column, keyword: str) -> Column:
    """Where a keyword begins (from 0), overlapping ones too; none for an empty keyword."""
    return F.coalesce(positions(text, [keyword] if keyword else []), F.array().cast("array<int>"))


def last_segment(uri: Column) -> Column:
    """H10."""
    return F.element_at(F.split(uri, "/"), -1)


def child_segment(uri: Column, prefix: str) -> Column:
    """The path segment after a prefix."""
    return F.element_at(F.split(F.substring(uri, len(prefix) + 1, 1 << 30), "/"), 1)


def directory_key(account: Column, uri: Column) -> Column:
    """16 hex digits for a document's folder."""
    return F.left(F.sha2(F.concat(account, F.char(F.lit(0)), uri), 256), F.lit(16))


def lock_key(text: Column) -> Column:
    """The first 64 bits of the SHA-256 as a signed number."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(16)), 16, -10).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; null is empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def token_count(length: Column) -> Column:
    """H37."""
    return F.greatest(F.lit(1), F.floor(length / 4)).cast("int")


def first_object(text: Column) -> Column:
    """The JSON object in a text, fenced or from its first to its last brace; null if there is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def keyword_groups(text: Column) -> Column:
    """An array of arrays of keywords in a text: trimmed, lower-cased, two characters at least, each group once."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<array<string>>")
    groups = F.transform(parsed, lambda g: F.filter(F.transform(g, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 2))
    return F.coalesce(F.array_distinct(F.filter(groups, lambda g: F.size(g) > 0)), F.array().cast("array<array<string>>"))


def flag(metadata: Column, key: str) -> Column:
    """A flag in metadata that is JSON text; false where it is missing or no JSON."""
    return F.coalesce(F.get_json_object(metadata, f"$.{key}") == "true", F.lit(False))


def iso8601(ts: Column) -> Column:
    """A time in the session's zone with its offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def holds_all(whole: Column, part: Column) -> Column:
    """Every element of part is in whole."""
    return F.size(F.array_except(part, whole)) == 0
