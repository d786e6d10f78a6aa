"""URL filters: rules indexed by their rarest literal token, so that few rules meet a URL.

A rule is a pattern over host and path. Its literal tokens (runs of letters and digits that
the pattern closes on both sides) must all be among the tokens of any URL it fits, so it is
filed under the one that the fewest URLs hold. A URL's tokens fetch the rules filed under
them; only those run their regular expression. Main path in DataFrame functions only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists of up to so many bytes are sent to every executor; longer ones are joined by shuffling.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """``kind`` is "host" (a host and the start of a path) or "pattern"; ``action`` "allow" or "block".

    In a pattern ``||`` stands for the start of a host or of a subdomain's parent, ``|`` at an
    end for the URL's end, ``*`` for anything and ``^`` for a separator or the end.
    """

    kind: str
    action: str
    text: str

    def regex(self) -> str:
        if self.kind == "host":
            return r"^(?:[^/]*\.)?" + re.escape(self.text)
        body, out = self.text, ""
        if body.startswith("||"):
            out, body = r"^(?:[^/]*\.)?", body[2:]
        elif body.startswith("|"):
            out, body = "^", body[1:]
        tail = "$" if body.endswith("|") else ""
        for c in body.removesuffix("|"):
            out += {"*": ".*", "^": "(?:[^0-9A-Za-z._%-]|$)"}.get(c, re.escape(c))
        return out + tail

    def tokens(self) -> list[str]:
        """Literal tokens, lower-cased, that stand whole in every URL the rule fits."""
        body, closed_left = self.text, self.kind == "host"
        if self.kind == "pattern":
            closed_left = body.startswith("|")
            body = body.lstrip("|")
        closed_right = body.endswith("|")
        body = body.removesuffix("|")
        found = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = body[m.start() - 1] if m.start() else ("^" if closed_left else "*")
            right = body[m.end()] if m.end() < len(body) else ("^" if closed_right else "*")
            if "*" not in (left, right):
                found.append(m.group().lower())
        return found


#: Host rules of the contract.
HOST_RULES = [
    Rule("host", "allow", "org/"),
    Rule("host", "block", "example.org/es/"),
    Rule("host", "block", "example.org/en/1"),
    Rule("host", "allow", "com/fr/"),
    Rule("host", "block", "com/de/"),
]
#: Patterns that decide where no host rule fits; without any, a URL is allowed.
PATTERN_RULES = [
    Rule("pattern", "block", t)
    for t in ("||spam-farm.", "||ads.*^", "||doubleclick.net^", "||casino.", "-casino.", "/casino/", "/porn/", "/adult/", "/wp-login.php|", "/banner*/ads/")
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    after = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(address, UPPER, LOWER), F.lit("([a-z0-9]+)")))


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, url, host, path, rule, pattern, verdict)``, a row for each row of ``pages``.

    rule is the longest host rule that fits (null if none), pattern the longest pattern that
    fits; the verdict is the rule's action, else the pattern's, else ``default``. A null URL or
    one without ``://`` has an empty host and path, which only a rule without tokens can
    fit. Repeated rows are judged once and keep their number; an empty table gives no rows.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    tokens = url_tokens(F.concat("host", "path"))

    asked = sorted({t for r in rules for t in r.tokens()})
    sized = (lambda df: F.broadcast(df)) if sum(len(r.regex().encode()) + 100 for r in rules) <= BROADCAST_BYTES else (lambda df: df)
    wanted = _literal(spark, [{"token": t} for t in asked], "token:string")
    counts = urls.select(F.explode(tokens).alias("token")).join(sized(wanted), "token").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()}  # a row for each token of the rule list at most

    # ranks: patterns below host rules, then shorter below longer; the highest that fits wins
    ranked = sorted(set(rules), key=lambda r: (r.kind == "host", len(r.text), r.text, r.action))
    listed, filed = [], {}
    for rank, rule in enumerate(ranked):
        token = min(rule.tokens(), key=lambda t: (seen.get(t, 0), t), default="")
        filed[token] = filed.get(token, 0) + 1
        listed.append({"token": token, "rank": rank, "regex": rule.regex(), "nth": filed[token], "kind": rule.kind, "action": rule.action, "text": rule.text})
    index = _literal(spark, listed, "token:string,rank:int,regex:string,nth:int,kind:string,action:string,text:string")

    looked = urls.select("*", F.posexplode(F.concat(F.array(F.lit("")), tokens)).alias("pos", "token"))
    met = looked.join(sized(index.select("token", "rank", "regex", "nth")), "token", "left")
    fits = F.col("rank").isNotNull() & F.rlike(F.concat("host", "path"), F.col("regex"))
    host_ranks = sum(r.kind == "pattern" for r in ranked)
    best = met.groupBy("page_id", "url", "host", "path").agg(
        F.max(F.when((F.col("rank") >= host_ranks) & fits, F.col("rank"))).alias("host_rank"),
        F.max(F.when((F.col("rank") < host_ranks) & fits, F.col("rank"))).alias("pattern_rank"),
        F.sum(F.when((F.col("pos") == 0) & (F.coalesce("nth", F.lit(1)) == 1), 1).otherwise(0)).alias("copies"),
    )
    names = lambda p: index.select(F.col("rank").alias(f"{p}_rank"), F.col("text").alias(f"{p}_text"), F.col("action").alias(f"{p}_action"))
    named = best.join(sized(names("host")), "host_rank", "left").join(sized(names("pattern")), "pattern_rank", "left")
    named = named.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    verdict = F.coalesce("host_action", "pattern_action", F.lit(default))
    return named.select("page_id", "url", "host", "path", F.col("host_text").alias("rule"), F.col("pattern_text").alias("pattern"), verdict.alias("verdict"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)
    return found.select("page_id", "host", "path", "rule", "pattern", "verdict")


def _values(kind: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(r.text)}, {quote(r.action)}, {quote(r.regex())})" for r in HOST_RULES + PATTERN_RULES if r.kind == kind)


OP10_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
host_rules(text, action, regex) AS (VALUES {_values("host")}),
patterns(text, action, regex) AS (VALUES {_values("pattern")}),
by_host AS (SELECT n, max_by(text, length(text)) AS text, max_by(action, length(text)) AS action FROM urls, host_rules WHERE regexp_matches(host || path, regex) GROUP BY n),
by_pattern AS (SELECT n, max_by(text, (length(text), text)) AS text, max_by(action, (length(text), text)) AS action FROM urls, patterns WHERE regexp_matches(host || path, regex) GROUP BY n)
SELECT page_id, host, path, h.text AS rule, p.text AS pattern, coalesce(h.action, p.action, 'allow') AS verdict
FROM urls LEFT JOIN by_host h USING (n) LEFT JOIN by_pattern p USING (n)
"""
