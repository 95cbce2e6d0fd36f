"""URL verdicts from pattern rules, each indexed by its rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import ascii_lower, free_name, set_aside, table

TOKEN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many rules travel as literals; more are a table, and are joined (judge_by_table).
MOST_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """pattern is matched against host + path; a URL that matches holds every one of tokens as a whole token."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Host and path rules outrank free patterns.
    base: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and the paths that begin with path (which starts with a slash)."""
    whole = re.split(TOKEN_GAP, (host + path[: path.rfind("/") + 1]).lower())
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})", tuple(t for t in whole if t), True)


HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: Free patterns of the method itself: (name, verdict, pattern, literal tokens).
PATTERN_RULES = (
    Rule("spam-farm", "block", r"(?:^|[./-])spam-farm(?:[./-]|$)", ("spam", "farm")),
    Rule("cheap-pills", "block", r"(?:^|[./-])cheap-pills(?:[./-]|$)", ("cheap", "pills")),
    Rule("link-exchange", "block", r"(?:^|[./-])link-exchange(?:[./-]|$)", ("link", "exchange")),
    Rule("online-casino", "block", r"(?:^|[./-])online-casino(?:[./-]|$)", ("online", "casino")),
    Rule("adult-content", "block", r"(?:^|[./-])adult-content(?:[./-]|$)", ("adult", "content")),
    Rule("tracking-click", "block", r"/click/track(?:/|$)", ("click", "track")),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.
    Null, or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """pages with host, path, rule and verdict.

    Each rule is indexed under the rarest of its literal tokens, by the number of URLs of this table that hold the
    token (a count over all URLs, for the rules' tokens only). A URL's tokens fetch their rules, and only those
    rules' patterns run. Host rules outrank free patterns; among equals the longest name wins. rule is the winning
    host rule's name, else null; verdict is the winner's, else allow. No shuffle but the small count.

    A null, empty or odd URL fetches nothing and is allowed; long ones are looked at whole. Repeated rows are judged alike;
    an empty table stays so. Columns named host, path, rule or verdict are replaced; others stay. A rule needs a token.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs at least one literal token, under which it is indexed")
    if len(rules) > MOST_RULES:
        table_of = [(r.name, r.verdict, r.pattern, list(r.tokens), r.base) for r in rules]
        return judge_by_table(pages, pages.sparkSession.createDataFrame(table_of, RULE_FIELDS), url_col)
    pages, back = set_aside(pages, {"_fetched", "_hit", *({"host", "path", "rule", "verdict"} & {url_col})})
    url_col = next((n for n, c in back.items() if c == url_col), url_col)
    back = {n: c for n, c in back.items() if c not in ("host", "path", "rule", "verdict")}
    url = pages[url_col]
    host, path = host_and_path(url)
    work = pages.withColumns({"host": host, "path": path})
    tokens = F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), TOKEN_GAP, -1))
    vocabulary = sorted({t for r in rules for t in r.tokens})
    counted = work.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, vocabulary)))).alias("t")).groupBy("t").count()
    seen = {r["t"]: r["count"] for r in counted.collect()}  # the rules' tokens at most
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(rule)

    def entry(r: Rule) -> Column:
        return F.struct(F.lit(r.base).alias("base"), F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))

    by_token = F.create_map(*[c for t, rs in sorted(index.items()) for c in (F.lit(t), F.array(*map(entry, rs)))])
    held = F.array_intersect(tokens, F.array(*[F.lit(t) for t in sorted(index)]))
    work = work.withColumn("_fetched", F.flatten(F.transform(held, lambda t: F.element_at(by_token, t))))
    target = F.concat("host", "path")
    work = work.withColumn("_hit", F.array_max(F.filter("_fetched", lambda r: F.rlike(target, r["pattern"]))))
    return work.withColumns({
        "rule": F.when(F.col("_hit.base"), F.col("_hit.name")),
        "verdict": F.coalesce("_hit.verdict", F.lit("allow")),
    }).drop("_fetched", "_hit").withColumnsRenamed(back)


RULE_FIELDS = "name string, verdict string, pattern string, tokens array<string>, base boolean"


def judge_by_table(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """As judge, for a table of rules (RULE_FIELDS) of any size: tokens of distinct host + path meet rules in an equality
    join on each rule's rarest token, and only the rules that a URL fetches run their patterns.

    Null URLs and URLs without :// have an empty host and path, and are allowed. A rule without tokens could never be fetched: it
    is an error, when the rows are read. Of equal rules (base, length of the name, name) the greater verdict and pattern
    counts; repeated pages are judged alike; without rules all are allowed, and no pages give no rows. Columns named host,
    path, rule or verdict are replaced; others stay."""
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url_col}))
    host, path = host_and_path(pages[url_col])
    judged = {"host": host, "path": path}
    at = free_name(pages, "_at")
    work = pages.withColumn(at, F.concat(host, path))
    targets = work.select(F.col(at).alias("t")).where("t != ''").distinct()
    tokens = targets.select("t", F.explode(F.array_distinct(F.split(ascii_lower(F.col("t")), TOKEN_GAP, -1))).alias("token"))
    none = F.raise_error(F.concat(F.lit("a rule without a token: "), F.coalesce("name", F.lit("null")))).cast("array<string>")
    named = F.when(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) > 0, F.col("tokens")).otherwise(none)
    literal = rules.select(F.struct("base", F.length("name").alias("n"), "name", "verdict", "pattern").alias("r"), F.explode(named).alias("token"))
    seen = tokens.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    rarest = literal.join(seen, "token", "left").groupBy("r").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("_m")).select("r", F.col("_m.token").alias("token"))
    hits = tokens.join(rarest, "token").where(F.rlike(F.col("t"), F.col("r.pattern"))).groupBy("t").agg(F.max("r").alias("r"))
    won = free_name(work, "_won")
    out = work.join(hits.select(F.col("t").alias(f"{at}t"), F.col("r").alias(won)), F.col(at) == F.col(f"{at}t"), "left")
    judged |= {"rule": F.when(F.col(f"{won}.base"), F.col(f"{won}.name")), "verdict": F.coalesce(F.col(f"{won}.verdict"), F.lit("allow"))}
    return out.withColumns(judged).drop(at, f"{at}t", won)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
