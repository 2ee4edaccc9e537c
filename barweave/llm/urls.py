"""URL filter: pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Up to so many rules the index is a literal in the plan; more are joined.
LITERAL_RULES = 1_000
#: Between host and path in what patterns read: a sign that neither can hold.
BORDER = "#"


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads host, BORDER, path. ``literals`` are whole lower-case tokens that every
    match has. ``name`` is set for host and path rules; the longest one that fits wins over all patterns."""

    action: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None


def host_rule(action: str, text: str) -> Rule:
    """A rule like ``example.com/en/7``: the host and its subdomains, paths that start so."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = path[: path.rfind("/") + 1]  # what comes after may be part of a longer token
    literals = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+", whole.lower() if whole.isascii() else "")
    return Rule(action, rf"^(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}", tuple(dict.fromkeys(literals)), text)


def host_words(*words: str) -> Rule:
    """Blocks hosts that have all these words side by side between dots or hyphens."""
    return Rule("block", rf"^(?:[^#]*[.-])?{'[.-]'.join(words)}(?:[.-][^#]*)?#", words)


def path_words(*words: str) -> Rule:
    """Blocks paths with these segments in a row."""
    return Rule("block", rf"#(?:/[^#]*)?/{'/'.join(words)}/", words)


#: The host and path rules of the contract.
HOST_RULES = (host_rule("block", "com/en/"), host_rule("allow", "example.com/en/7"), host_rule("allow", "net/de/"), host_rule("block", "example.net/de/8"), host_rule("block", "org/es/"))
#: Hosts and paths that no training corpus wants.
PATTERN_RULES = (
    host_words("ads", "track"), host_words("adserver"), host_words("adclick"), host_words("doubleclick"), host_words("adult", "x"), host_words("adult"), host_words("porn"), host_words("xxx"),
    host_words("casino"), host_words("casino", "win"), host_words("free", "bets"), host_words("bets"), host_words("betting"), host_words("poker"), host_words("cheap", "pills"), host_words("pills"), host_words("viagra"),
    host_words("spam", "farm"), host_words("spam"), host_words("link", "farm"), host_words("warez"), host_words("malware"), host_words("phishing"),
    path_words("ads"), path_words("adserver"), path_words("banners"), path_words("wp", "login"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path and the distinct tokens of both."""
    url = F.col(url_col).cast("string")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id", _lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")
    )
    return rows.withColumn("tokens", F.array_distinct(F.split(_lower(F.concat_ws(" ", "host", "path")), "[^a-z0-9]+")))


def rarest_tokens(rows: DataFrame, rules: tuple[Rule, ...]) -> list[str | None]:
    """For each rule its literal that the fewest urls have, over all rows (None: a rule without literals)."""
    wanted = sorted({t for r in rules for t in r.literals})
    spark = rows.sparkSession
    if len(wanted) <= LITERAL_RULES:
        listed = F.array_intersect("tokens", F.array(*map(F.lit, wanted)).cast("array<string>"))
        found = rows.select(F.explode(listed).alias("token"))
    else:
        tokens = spark.createDataFrame([(t,) for t in wanted], "token string")
        found = rows.select(F.explode("tokens").alias("token")).join(tokens, "token", "left_semi")
    counts = dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}  # at most the rules' literals
    return [min(r.literals, key=lambda t: (counts[t], t), default=None) for r in rules]


_FIT = "struct<size:int,rule:string,action:string>"
_ENTRY = "struct<size:int,rule:string,action:string,pattern:string>"


def _subject() -> Column:
    return F.concat_ws(BORDER, "host", "path")


def _fetch_literal(rows: DataFrame, rules: tuple[Rule, ...], tokens: list[str | None]) -> DataFrame:
    """``rows`` with n_candidates and fits: the index is a map in the plan."""
    shelf: dict[str, list[Rule]] = {}
    for rule, token in zip(rules, tokens):
        shelf.setdefault(token or "", []).append(rule)

    def entry(rule: Rule) -> Column:
        return F.struct(F.lit(len(rule.name) if rule.name else 0).alias("size"), F.lit(rule.name).cast("string").alias("rule"), F.lit(rule.action).alias("action"), F.lit(rule.pattern).alias("pattern"))

    listed = F.array(*map(entry, shelf.pop("", []))).cast(f"array<{_ENTRY}>")
    if shelf:
        index = F.create_map(*[x for token, found in sorted(shelf.items()) for x in (F.lit(token), F.array(*map(entry, found)).cast(f"array<{_ENTRY}>"))])
        keys = F.array(*map(F.lit, sorted(shelf)))
        listed = F.concat(listed, F.flatten(F.transform(F.array_intersect("tokens", keys), lambda t: index[t])))
    fits = F.filter("fetched", lambda r: F.regexp_like(_subject(), r["pattern"]))
    judged = rows.withColumn("fetched", listed)
    return judged.withColumn("n_candidates", F.size("fetched").cast("long")).withColumn("fits", F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))


def _fetch_joined(rows: DataFrame, rules: tuple[Rule, ...], tokens: list[str | None]) -> DataFrame:
    """The same for any number of rules: each different url is joined with the index by its tokens; rules without a
    literal are filed under a token that every url has. Spark broadcasts the index if it is small, else it shuffles."""
    spark = rows.sparkSession
    index = spark.createDataFrame([(t or "", len(r.name) if r.name else 0, r.name, r.action, r.pattern) for r, t in zip(rules, tokens)], "token string, size int, rule string, action string, pattern string")
    urls = rows.select("host", "path", "tokens").groupBy("host", "path").agg(F.any_value("tokens").alias("tokens"))
    asked = urls.select("host", "path", F.explode(F.array_union("tokens", F.array(F.lit("")))).alias("token"))
    fetched = asked.join(stored(index), "token").withColumn("fits", F.regexp_like(_subject(), F.col("pattern")))
    # Of the rules that fit, the best one of all and the best with a name are enough.
    fit = F.struct("size", "rule", "action")
    best = fetched.groupBy("host", "path").agg(F.count("*").alias("n_candidates"), F.max(F.when(F.col("fits"), fit)).alias("a"), F.max(F.when(F.col("fits") & F.col("rule").isNotNull(), fit)).alias("b"))
    fits = F.filter(F.array("a", "b"), lambda x: x.isNotNull()).alias("fits")
    joined = rows.join(best.select("host", "path", "n_candidates", fits), ["host", "path"], "left")
    return joined.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long"))).withColumn("fits", F.coalesce("fits", F.array().cast(f"array<{_FIT}>")))


def filter_urls(pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, n_candidates (rules whose pattern was run).

    Each rule is filed under its rarest literal token, counted over all rows. A url's tokens fetch candidate
    rules, and only those run their regular expressions. The longest host rule that fits gives ``rule`` and
    the verdict (among equally long ones, the last by name); without one, ``block`` if any pattern rule
    fits, else ``allow``. A url that is null or lacks ``://`` has an empty host and path and is allowed.
    Urls of any length are read whole; repeated rows each give a row; a null id is kept; other columns are ignored; an
    empty table gives no rows. Up to ``literal_rules`` rules only token counts are shuffled; more rules are joined."""
    rules = (*host_rules, *pattern_rules)
    rows = url_parts(pages, id_col, url_col)
    fetch = _fetch_literal if len(rules) <= literal_rules else _fetch_joined
    judged = fetch(rows, rules, rarest_tokens(rows, rules)).withColumn("best", F.array_max(F.filter("fits", lambda r: r["rule"].isNotNull())))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.action")).when(F.size("fits") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "n_candidates")
