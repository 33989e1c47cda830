"""Operator 6: URL filters by rules of hosts and paths, and by a weighted vocabulary.

An Aho-Corasick automaton finds the terms of the vocabulary in the lower-cased url. A term counts where no letter or digit
stands directly before or after it. A url is rejected on one strict term or on SOFT_HITS distinct soft ones. A rule, where one
fits, decides instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Own vocabulary: a strict term rejects alone, soft ones only together.
STRICT = ("porn", "xxx", "casino", "viagra", "malware", "phishing", "spam-farm", "cheap-pills", "warez", "escort")
SOFT = ("adult", "bet", "betting", "bonus", "cheap", "click", "dating", "discount", "farm", "free", "hot", "loan", "payday", "pills", "poker", "prize", "sex", "spam", "torrent", "win", "winner")
SOFT_HITS = 2


class UrlVocabulary:
    def __init__(self, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS):
        import ahocorasick

        self.soft_hits, self.automaton = soft_hits, ahocorasick.Automaton()
        for weight, terms in ((1, soft), (soft_hits, strict)):  # a strict term has the weight that rejects
            for term in terms:
                self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def rejects(self, url: str) -> bool:
        low, found = url.lower(), {}
        for end, (term, weight) in self.automaton.iter(low):
            start = end - len(term)
            if (start < 0 or not low[start].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                found[term] = weight
        return sum(found.values()) >= self.soft_hits


def _judge(batches, strict, soft, soft_hits: int):
    words = UrlVocabulary(strict, soft, soft_hits)
    for batch in batches:
        by_words = ["block" if u and words.rejects(u) else "allow" for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(by_words, pa.string())], names=[*batch.schema.names, "by_words"])


def url_verdicts(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages, other columns are not read.

    Null and `://`-less urls have an empty host and path; no rule fits them, and the vocabulary judges what text there is
    (a null url is allowed). A url without a path fits no rule, since every rule has one.
    Repeated rows are judged each, an empty table gives no rows, other columns are not read.
    """
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = rows.mapInArrow(lambda it: _judge(it, strict, soft, soft_hits), rows.select("*", F.lit("").alias("by_words")).schema)
    judged = judged.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.col("by_words")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        name, slash, tail = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _alternatives(terms) -> str:
    return "|".join(sorted(terms))


ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id, url, lower(coalesce(url, '')) AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), w AS (
  SELECT *, regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}])({_alternatives(STRICT)})([^\\p{{L}}\\p{{N}}]|$)')
    OR {" + ".join(f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)')::INT" for t in SOFT)} >= {SOFT_HITS} AS bad FROM p
), r AS (
  SELECT w.page_id, w.host, w.path, w.bad, x.rule, x.verdict, row_number() OVER (PARTITION BY w.page_id ORDER BY length(x.rule) DESC NULLS LAST) AS rn
  FROM w LEFT JOIN (VALUES {", ".join(f"('{a}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for a, t in RULES)}) AS x(verdict, rule, h, start)
    ON (w.host = x.h OR ends_with(w.host, '.' || x.h)) AND starts_with(w.path, x.start)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM r WHERE rn = 1
"""
