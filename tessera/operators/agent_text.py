"""Agents' messages: recall queries, facts to keep, token budgets. Conversations are (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

LONG, RECALL_CHARS = 200, 200
MIN_CAPTURE, SEGMENT, MAX_SEGMENTS, MAX_CAPTURE = 80, (24, 240), 3, 600
MESSAGE_TOKENS = 4
# What makes a sentence worth keeping, and beginnings of sentences that are not.
MARKERS = ("`", "/api/", "ctx://", "http://", "https://", "mem://", "skill://", "x-")
HINTS = ("always", "endpoint", "header", "must", "never", "path", "requires", "return ", "returns", "token", "uri", "use ", "version")
SKIPPED = ("here is", "here's", "i can", "let me know", "we can")
_SPACE = r"(?U)\s"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_SPACE}+\z|\A{_SPACE}+", "")


def last_message(turns: DataFrame, role: str, filled: bool) -> DataFrame:
    """conv_id, text of the last message of a role; filled: the last that is not blank."""
    rows = turns.filter(F.col("role") == role).withColumn("text", stripped(F.coalesce("text", F.lit(""))))
    return (rows.filter("text <> ''") if filled else rows).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def question(body: Column) -> Column:
    """A short message itself; of a long one its last line that ends with a question mark, or its last question, or its last line of
    some length, or its end."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), stripped)
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, F.greatest(F.size(a), F.lit(1))))
    asked = last(F.filter(lines, lambda x: x.endswith("?") & (F.length(x) > 10)))
    sentence = stripped(last(F.regexp_extract_all(body, F.lit(r"[^.!?\n]{10,}\?"), F.lit(0))))
    found = F.coalesce(asked, F.when(F.length(sentence) > 10, sentence), last(F.filter(lines, lambda x: F.length(x) > 10)), F.right(body, F.lit(LONG)))
    return F.when(F.length(body) <= LONG, body).otherwise(F.left(found, F.lit(RECALL_CHARS)))


def recall_queries(turns: DataFrame) -> DataFrame:
    """conv_id, query: from the last user message with text."""
    return last_message(turns, "user", True).select("conv_id", question(F.col("text")).alias("query"))


def captured(body: Column) -> Column:
    """Up to three sentences worth keeping, one a line; null if there is none."""
    plain = F.regexp_replace(body, "(?s)```.*?```", " ")
    segments = F.transform(F.split(plain, rf"(?<=[.!?]){_SPACE}+|\n+"), lambda s: F.regexp_replace(stripped(F.regexp_replace(stripped(s), r"^[-*0-9. ]+", "")), rf"{_SPACE}+", " "))
    any_of = lambda s, words: F.lower(s).rlike("|".join(w.replace("`", "\\`") for w in words))
    keep = lambda s: F.length(s).between(*SEGMENT) & ~F.lower(s).rlike("^(" + "|".join(SKIPPED) + ")") & any_of(s, MARKERS + HINTS)
    kept = F.slice(F.array_distinct(F.filter(segments, keep)), 1, MAX_SEGMENTS)
    out = F.regexp_replace(F.left(F.array_join(kept, "\n"), F.lit(MAX_CAPTURE)), rf"{_SPACE}+\z", "")
    return F.when((F.length(body) >= MIN_CAPTURE) & (F.size(kept) > 0), out)


def captures(turns: DataFrame) -> DataFrame:
    """conv_id, memory: from the last assistant message; conversations without one to keep are left out."""
    return last_message(turns, "assistant", False).select("conv_id", captured(F.col("text")).alias("memory")).filter("memory is not null")


def message_tokens(turns: DataFrame) -> DataFrame:
    """conv_id, tokens."""
    return turns.groupBy("conv_id").agg(F.sum(text.token_estimate(F.col("text")) + MESSAGE_TOKENS).cast("long").alias("tokens"))


def recall_block(results: DataFrame, budget: int, header: str = "## Recalled context") -> DataFrame:
    """One text of search results (place, uri, l1_content, l0_content), blank ones left out, cut to a token budget."""
    body = stripped(F.coalesce("l1_content", "l0_content", F.lit("")))
    lines = results.withColumn("body", body).filter((F.col("body") != "") & (F.col("body") != F.col("uri"))).select("place", F.concat(F.lit("- ["), "uri", F.lit("] "), "body").alias("line"))
    joined = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("b"))
    return joined.select(F.left(F.concat(F.lit(header + "\n"), "b"), F.lit(max(0, budget) * 4)).alias("block"))


def budgets(turns: DataFrame, token_budget: int, guide: str) -> DataFrame:
    """conv_id, tokens of messages and guide, room for a recall block (0 at least)."""
    guide_tokens = -(-len(guide) // 4)
    used = message_tokens(turns).withColumn("tokens", F.col("tokens") + guide_tokens)
    return used.withColumn("room", F.greatest(F.lit(0), token_budget - F.col("tokens")))
