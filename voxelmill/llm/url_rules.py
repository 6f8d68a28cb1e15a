"""Url filter by wildcard rules that are indexed by their rarest literal token.

A rule is (rule, pattern, verdict). In a pattern ``*`` stands for any text, ``^`` for the end of the
url or a character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, a leading ``||`` for the
start of a host name or of one of its parent domains; all else is literal. A pattern is matched
against host and path, without scheme, query and fragment.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_regex(pattern: str) -> str:
    """The regular expression of a pattern."""
    head = r"\A(?:[^/]*\.)?" if pattern.startswith("||") else ""
    parts = re.split(r"([*^])", pattern.removeprefix("||"))
    meaning = {"*": r"(?s:.*)", "^": r"(?:[^A-Za-z0-9_.%-]|\z)"}
    return head + "".join(meaning.get(p) or re.sub(r"([^A-Za-z0-9_/\x80-\U0010ffff])", r"\\\1", p) for p in parts)


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that stand whole in every url the pattern matches: a run counts
    only if the pattern itself ends it on both sides."""
    body = pattern.removeprefix("||")
    out = set()
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = pattern.startswith("||") if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            out.add(m[0])
    return sorted(out)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, regex, tokens, weight, verdict) from (rule, pattern, verdict). Longer rules weigh more."""
    rows = [(r, rule_regex(p), literal_tokens(p), len(p.removeprefix("||")), v) for r, p, v in rules]
    return spark.createDataFrame(rows, "rule string, regex string, tokens array<string>, weight int, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest matching rule decides; of equally long ones the one whose verdict, then name comes
    last in order (``block`` beats ``allow``). Without a rule ``rule`` is null and the verdict is
    ``default``. Null urls and urls without ``://`` have empty host and path. Repeated rows are each
    judged; an empty table gives no rows; other columns are ignored.

    Every distinct url fetches candidate rules by its tokens (rules without a token of their own by
    the empty one); only those are matched. The rarest token of a rule is the one in the fewest urls
    of the whole table. Neither side is broadcast unless Spark finds it small.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = pages.filter("url is not null").select("url").distinct().select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("target"))
    tokens = F.array_distinct(F.concat(F.split("target", "[^A-Za-z0-9]+"), F.array(F.lit(""))))
    url_tokens = urls.select("url", "target", F.explode(tokens).alias("token"))

    rule_tokens = rules.select("rule", F.explode_outer("tokens").alias("token")).fillna("", ["token"])
    used = url_tokens.join(rule_tokens.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (rule_tokens.join(used, "token", "left").groupBy("rule")
              .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    index = rules.join(rarest, "rule").select("token", "rule", "regex", "weight", "verdict")

    found = url_tokens.join(index, "token").filter(F.expr("regexp_like(target, regex)"))
    best = found.groupBy("url").agg(F.max(F.struct("weight", "verdict", "rule")).alias("best"))
    return pages.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
