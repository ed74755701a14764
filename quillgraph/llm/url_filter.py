"""URL verdicts by rules that are indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over host + path with the literal tokens (runs of letters and digits) that any URL it fits
must hold; rules are a parameter, a list or a table of them (columns of RULE). How often their tokens occur is counted over all URLs;
a rule is filed under its rarest one. A URL's tokens fetch the rules filed under them, and only these run their expression;
a rule without a token is fetched by all. Up to `most` rules the index is a hash table of `slots` lists that is one literal of
the plan: no shuffle, rows with the same id and rows of a hot host are judged where they are. More rules are a table that
the tokens of the distinct places (host, path) are joined with; both ways give the same rows.

Prefix rules (host, path) fit the host and its subdomains where the URL's path starts with the rule's; the longest that
fits decides. A URL that no prefix rule fits is blocked if one of the pattern rules fits it and no pattern rule that allows
does, else allowed.

Rules can also be read from the lines of filter lists (filter_rules): domain anchors, separators, wildcards, ends, exceptions,
regular expressions; their tokens are found in the lines.

The pattern rules in force come from word lists of this module and from no table: names of gambling, adult, drug, spam and
tracking sites, words that only together make one ("cheap" with "pills", "ads" with "track"; every pair in both orders), and
names of paths that are only called by adverts or attacks.

Defined results: host is what follows the first :// up to /, ?, # or the end, A-Z in lower case, path what follows up to
?, # or the end; a null URL or one without :// has both empty, no rule, and is allowed; repeated rows give repeated rows;
other columns are not read; no rules allow everything; of two prefix rules of one host and path that differ in verdict, block holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import meet

#: Rules that are a literal of the plan at most, and its slots.
MOST_RULES, SLOTS = 20_000, 1024
RULE = "pattern string, tokens array<string>, verdict string, prefix string"


@dataclass(frozen=True)
class Rule:
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    prefix: str | None = None


def words(text: str) -> tuple[str, ...]:
    """Runs of ASCII letters and digits."""
    return tuple("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    plain = lambda x: "".join(c if c.isascii() and (c.isalnum() or c in "/-_") else f"\\{c}" for c in x)
    # The last token of the path may go on in the URL, so only those before it, and the host's, are sure to be tokens of it.
    inner = words(path) if path.endswith("/") else words(path)[:-1]
    return Rule(f"^(?:[^/?#]*\\.)?{plain(host)}{plain(path)}", words(host) + inner, verdict, host + path)


def site_rule(*names: str) -> Rule:
    """Blocks hosts with a label that holds these words in this order, parted by hyphens from each other and from the rest."""
    return Rule(f"^(?:[^/]*[.-])?{'(?:-[^./:]*)?-'.join(names)}(?:[.:-][^/]*)?(?:/|$)", names, "block")


def path_rule(*names: str) -> Rule:
    """Blocks URLs whose path has a segment made of these words, hyphens between them, with or without an extension."""
    return Rule(f"/{'-'.join(names)}(?:[.][a-z]+)?(?:/|$)", names, "block")


#: The prefix rules in force.
PREFIX_RULES = (
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
)
# Words in names of hosts and paths.
GAMBLING = tuple("bets betting blackjack bookmaker bookmakers casino casinos gambling jackpot lottery poker roulette slots sportsbook wager".split())
ADULT = tuple("adult adults camgirls erotic escort escorts hentai milf nude nudes porn porno sex sexy xxx".split())
DRUGS = tuple("cialis levitra tramadol viagra xanax".split())
SPAM = tuple("spam spambot spammer spammers".split())
ADVERTS = tuple("adserv adserver adservers adsystem doubleclick popads popunder".split())
PATHS = (("adclick",), ("adserver",), ("popunder",), ("xmlrpc",), ("wp", "login"), ("cgi", "bin"))
#: Words that make such a site together with one of the words beside them.
BAITS = tuple("bargain best bonus bulk buy cheap discount easy fake fast free generic instant online order quick secret wholesale".split())
GOODS = tuple(
    "backlinks cash cheats credits cracks diplomas drugs followers giveaways handbags iphones keygens keys likes loan loans meds money offers "
    "pharma pharmacy pills prescriptions prizes replica replicas rolex rx serials steroids supplements torrents traffic warez watches".split()
)
CLICKS = tuple("ad ads adverts affiliate banner banners click clicks pixel pixels popup popups".split())
TRACKERS = tuple("beacon collect count counter exchange metrics network serve server servers stats sync track tracker trackers tracking".split())


def pairs(one: tuple[str, ...], two: tuple[str, ...]) -> list[tuple[str, str]]:
    return [*product(one, two), *product(two, one)]


PATTERN_RULES = (
    *(site_rule(name) for name in (*GAMBLING, *ADULT, *DRUGS, *SPAM, *ADVERTS)),
    *(site_rule(*pair) for pair in (*pairs(BAITS, GOODS), *pairs(CLICKS, TRACKERS))),
    *(path_rule(*names) for names in PATHS),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit("[A-Za-z0-9]+"), 0))


def rule_table(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.pattern, list(r.tokens), r.verdict, r.prefix) for r in rules], RULE)


def filter_rules(lines: DataFrame) -> DataFrame:
    """A table of rules from the lines (value) of filter lists. ||name^ fits a host, its subdomains and what follows a
    separator, | the beginning or end, * anything, ^ a separator or the end, /.../ is a regular expression, @@ an exception;
    letters fit in any case. Comments, headers, rules on elements and blank lines are none; nor are rules whose options ask
    for more than a URL tells (domains, parties), other options are left out.

    A token must be a whole one of every URL that fits: a run of letters and digits between signs (not beside a * or an open
    end), and in the host, where case is known. Rules without one are fetched by all URLs."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = lines.select(line.alias("line")).where(~F.col("line").rlike(r"^$|^!|^\[|#[@?$]*#"))
    rows = rows.select(F.when(F.col("line").startswith("@@"), "allow").otherwise("block").alias("verdict"), F.regexp_replace("line", "^@@", "").alias("line"))
    options = F.regexp_extract("line", r"\$([A-Za-z~][^/$]*)$", 1)
    rows = rows.select("verdict", options.alias("options"), F.regexp_replace("line", r"\$[A-Za-z~][^/$]*$", "").alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("options").rlike(r"(^|,)~?(domain=|third-party|first-party|3p|1p|from=|to=)"))
    raw = F.col("line").rlike("^/.+/$")
    plain = F.regexp_replace(F.regexp_replace("line", r"^\|\|", ""), r"^\|?(?:[A-Za-z*]+://)?|\|$", "")
    escaped = F.regexp_replace(plain, r"([^A-Za-z0-9*^_/%~-])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\^", "(?:[^A-Za-z0-9_.%-]|\\$)")
    begin = F.when(F.col("line").startswith("||"), r"^(?:[^/?#]*\.)?").when(F.col("line").rlike(r"^\|"), "^").otherwise("")
    end = F.when(F.col("line").rlike(r"[^|]\|$"), "$").otherwise("")
    pattern = F.concat(F.lit("(?i)"), F.when(raw, F.regexp_replace("line", "^/|/$", "")).otherwise(F.concat(begin, body, end)))
    # The host part of a rule with a domain anchor, up to its first * or sign of a path; an open end may go on.
    host = F.regexp_extract("line", r"^\|\|([A-Za-z0-9.-]*)([/^:?|]?)", 1)
    shut = F.regexp_extract("line", r"^\|\|([A-Za-z0-9.-]*)([/^:?|]?)", 2) != ""
    runs = F.regexp_extract_all(F.lower(F.when(shut, host).otherwise(F.regexp_replace(host, "[A-Za-z0-9]+$", ""))), F.lit("[a-z0-9]+"), 0)
    return rows.select(pattern.alias("pattern"), F.when(raw, F.array().cast("array<string>")).otherwise(runs).alias("tokens"), "verdict", F.lit(None).cast("string").alias("prefix")).distinct()


def filed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with their rarest token (null without one), by the number of URLs that hold it."""
    place = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    seen = pages.select(F.explode(tokens_of(place)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    own = rules.select("*", F.explode_outer("tokens").alias("token"))
    known = own.select("token").distinct().join(seen, "token", "left")
    rated = own.join(known, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
    return rated.groupBy("pattern", "verdict", "prefix").agg(rarest.alias("token"))


RULES_KIND = "array<struct<token: string, pattern: string, verdict: string, prefix: string>>"


def index(rows: list, slots: int) -> Column:
    """The filed rules by the slot of their token, as one literal; the last slot holds those without a token."""
    lists: list[list[dict]] = [[] for _ in range(slots + 1)]
    for row in sorted(rows, key=lambda r: (r["pattern"], r["verdict"], r["prefix"] or "")):
        lists[slots if row["token"] is None else row["slot"]].append({k: row[k] for k in ("token", "pattern", "verdict", "prefix")})
    return F.from_json(F.lit(json.dumps(lists)), f"array<{RULES_KIND}>")


def decided(place: DataFrame, fetched: Column, *columns: str) -> DataFrame:
    """The columns, then rule, verdict, candidates, matched by the fetched rules (an array)."""
    judged = place.withColumn("fetched", fetched).withColumn("fits", F.filter("fetched", lambda r: F.rlike(F.concat("host", "path"), r["pattern"])))
    prefixes = F.filter("fits", lambda r: r["prefix"].isNotNull())
    best = F.array_max(F.transform(prefixes, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["prefix"].alias("prefix"), r["verdict"].alias("verdict"))))
    says = lambda verdict: F.exists("fits", lambda r: r["prefix"].isNull() & (r["verdict"] == verdict))
    blocked = says("block") & ~says("allow")
    return judged.withColumn("best", best).select(
        *columns, F.col("best.prefix").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.size("fetched").cast("long").alias("candidates"), F.size("fits").cast("long").alias("matched"),
    )


def judge(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] | list[Rule] = PREFIX_RULES + PATTERN_RULES, slots: int = SLOTS, most: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; then candidates (rules fetched) and matched (patterns that fit)."""
    rules = (rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)).dropDuplicates(["pattern", "verdict", "prefix"])
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    placed = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = filed(urls, rules)
    slot = lambda token: F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")
    rows = found.withColumn("slot", slot("token")).limit(most + 1).collect()  # at most most + 1 rules
    tokens = tokens_of(F.concat("host", "path"))
    if len(rows) <= most:
        table = index(rows, slots)
        own = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(table, slot(t)), lambda r: r["token"] == t)))
        return decided(placed, F.concat(own, F.get(table, F.lit(slots))), "page_id", "host", "path")
    # Beyond: the distinct places' tokens meet the rules by token, '' standing for none.
    asking = placed.select("host", "path").distinct().withColumn("token", F.explode(F.array_append(tokens, F.lit(""))))
    both = meet(asking, found.withColumn("token", F.coalesce("token", F.lit(""))), ["token"], "path")
    both = both.withColumn("fits", F.rlike(F.concat("host", "path"), F.col("pattern")))
    prefix = F.when(F.col("fits") & F.col("prefix").isNotNull(), F.struct(F.length("prefix").alias("n"), "prefix", "verdict"))
    blocked = F.min(F.when(F.col("fits") & F.col("prefix").isNull(), F.col("verdict")))  # allow before block
    whole = both.groupBy("host", "path").agg(F.max(prefix).alias("best"), blocked.alias("blocked"), F.count(F.lit(1)).alias("candidates"), F.count_if("fits").alias("matched"))
    return meet(placed, whole, ["host", "path"], "page_id", "left").select(
        "page_id", "host", "path", F.col("best.prefix").alias("rule"), F.coalesce(F.col("best.verdict"), F.col("blocked"), F.lit("allow")).alias("verdict"),
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


def _any(names: tuple[str, ...]) -> str:
    return "|".join(names)


SQL = rf"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(n, rule, rhost, rpath, v) AS (VALUES (1, 'org/', 'org', '/', 'allow'), (2, 'example.org/es/', 'example.org', '/es/', 'block'),
  (3, 'example.org/en/1', 'example.org', '/en/1', 'block'), (4, 'com/fr/', 'com', '/fr/', 'allow'), (5, 'com/de/', 'com', '/de/', 'block')),
best AS (
  SELECT u.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.v, length(r.rule)) AS v, count(*) AS n
  FROM u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath) GROUP BY u.page_id),
l AS (
  SELECT page_id, string_split(label, '-') AS ws
  FROM (SELECT page_id, unnest(string_split(regexp_replace(host, ':.*$', '', 's'), '.')) AS label FROM u)),
one AS (SELECT DISTINCT page_id FROM (SELECT page_id, unnest(ws) AS w FROM l) WHERE regexp_full_match(w, '{_any(GAMBLING + ADULT + DRUGS + SPAM + ADVERTS)}')),
two AS (
  SELECT DISTINCT page_id FROM l WHERE len(ws) > 1 AND (
    list_has_any(ws, {list(BAITS)}) AND list_has_any(ws, {list(GOODS)}) OR list_has_any(ws, {list(CLICKS)}) AND list_has_any(ws, {list(TRACKERS)}))),
p AS (
  SELECT page_id, host, path,
         cast(page_id IN (SELECT page_id FROM one) OR page_id IN (SELECT page_id FROM two)
              OR regexp_matches(path, '/(?:{_any(tuple("-".join(x) for x in PATHS))})(?:[.][a-z]+)?(?:/|$)') AS BIGINT) AS m
  FROM u)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.v, CASE WHEN p.m = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""
