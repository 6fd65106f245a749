"""URL filters: many patterns, of which few are tried for a url.

A rule is a regular expression over host and path with a verdict. Each rule is indexed by the
rarest of its literal tokens (runs of a-z and 0-9 with a fixed delimiter on both sides), rarest
by the count of urls over the whole table. A url's own tokens fetch candidate rules, and only
those expressions run. The longest fitting host-and-path rule decides; failing that, a fitting
method rule blocks; else the url is allowed. Of rules of one length the later text wins.

Up to ``IN_PLAN`` rules are part of the plan, and no row is shuffled. Any larger number is a table:
urls and rules are joined on the token, and each url takes the best of the rules that fit. Both ways
give the same rows.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty. Rows are
judged one by one, so repeated rows and null ids need no care; an empty table gives no rows. Extra
columns pass through; input columns named host, path, rule, method_rule or verdict give way to the
results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import materialize, numbered

#: Up to so many rules stand in the plan; more are joined as a table.
IN_PLAN = 200

# The host-and-path rules of the contract, and the words of the method's own rules.
HOST_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SPAM_WORDS = ("adserver", "casino", "doubleclick", "escort", "gambling", "lottery", "poker", "porn", "replica", "viagra", "xxx")
SPAM_PAIRS = (("casino", "win"), ("cheap", "pills"), ("spam", "farm"), ("free", "loan"), ("click", "bet"))


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Host-and-path rules outrank the method's rules.
    explicit: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    literal = "." + host + path
    # The text's last token may go on in a url, so it is no whole token there.
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", literal)
    return Rule(host + path, verdict, r"^([^/]*\.)?" + re.escape(host) + "(?=/)" + re.escape(path), tuple(tokens), True)


def word_rule(*words: str) -> Rule:
    """Blocks hosts with a label in which these words stand together, joined by hyphens."""
    return Rule("-".join(words), "block", r"^([^/]*[.-])?" + "-".join(words) + r"([.-][^/]*)?(/|$)", words, False)


RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(word_rule(*p) for p in SPAM_PAIRS) + tuple(word_rule(w) for w in SPAM_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with one more column, a struct: where (host and path), host, path and the distinct tokens."""
    host, path = host_and_path(F.col("url"))
    where = F.concat(host, path)
    return pages.withColumn(_name(pages), F.struct(host.alias("host"), path.alias("path"), where.alias("where"), F.array_distinct(F.split(F.lower(where), "[^a-z0-9]+")).alias("tokens")))


def _name(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"url_parts{i or ''}") not in taken)


def rarest_tokens(tokens: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """token -> rules indexed by it. Counts every url; as many counts as the rules have tokens reach the driver."""
    known = sorted({t for r in rules for t in r.tokens})
    counts = {r["t"]: r["n"] for r in tokens.select(F.explode(F.array_intersect("tokens", F.lit(known))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return index


def _best(fits: Column, explicit: bool) -> Column:
    chosen = F.filter(fits, lambda r: r["e"] if explicit else ~r["e"])
    return F.array_max(F.transform(chosen, lambda r: F.struct(r["n"].alias("n"), r["t"].alias("t"), r["v"].alias("v"))))


def fetched_in_plan(parts: Column, index: dict[str, list[int]], rules: tuple[Rule, ...]) -> Column:
    """The rules that a url's own tokens fetch, as an array of structs; no others are tried."""
    fetched = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.array(*[F.lit(i) for i in at])) for t, at in sorted(index.items())]))
    shared = F.array_intersect(parts["tokens"], F.lit(sorted(index)))
    numbers = F.array_sort(F.flatten(F.transform(shared, lambda t: F.element_at(fetched, t))))
    table = F.array(*[F.struct(F.lit(r.pattern).alias("p"), F.lit(r.text).alias("t"), F.lit(r.verdict).alias("v"), F.lit(r.explicit).alias("e"), F.lit(len(r.text)).alias("n")) for r in rules])
    return F.transform(numbers, lambda i: F.element_at(table, i + 1))


def rule_table(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table (p, t, v, e, n) with ``token``, the rarest of each by the count of ``pages``' urls."""
    rows = [(i, r.pattern, r.text, r.verdict, r.explicit, len(r.text), list(dict.fromkeys(r.tokens))) for i, r in enumerate(rules)]
    table = materialize(pages.sparkSession.createDataFrame(rows, "i int, p string, t string, v string, e boolean, n int, tokens array<string>"), "rules")
    wanted = table.select("i", F.explode("tokens").alias("token"))
    counts = pages.select(F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    index = wanted.join(counts, "token", "left").groupBy("i").agg(F.min_by("token", F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token")).alias("token"))
    return table.drop("tokens").join(index, "i").drop("i")


def fetched_by_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows(_row, where, tokens)`` with each rule that one of a url's tokens fetches."""
    return rows.select("_row", "where", F.explode("tokens").alias("token")).join(table, "token")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, in_plan: int = IN_PLAN) -> DataFrame:
    """``pages`` with host, path, rule, method_rule and verdict added."""
    if not all(r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "method_rule", "verdict")]
    if not rules or len(rules) <= in_plan:
        own = parsed(pages)
        parts = F.col(own.columns[-1])
        if rules:
            fits = F.filter(fetched_in_plan(parts, rarest_tokens(own.select(parts["tokens"].alias("tokens")), rules), rules), lambda r: F.rlike(parts["where"], r["p"]))
            found = F.struct(_best(fits, True).alias("best"), _best(fits, False).alias("other"))
        else:
            none = F.lit(None).cast("struct<n:int,t:string,v:string>")
            found = F.struct(none.alias("best"), none.alias("other"))
        # A struct of its own, so that the expressions run once.
        judged = own.withColumn(own.columns[-1], F.struct(parts["host"].alias("host"), parts["path"].alias("path"), found.alias("found")))
        parts = F.col(judged.columns[-1])
        return _judged(judged, kept, parts["host"], parts["path"], parts["found"]["best"], parts["found"]["other"])
    # Each url once: the whole rows take part in one join at the end only.
    urls = numbered(pages.select("url").distinct())
    own = parsed(urls)
    slim = own.select("_row", "url", f"{own.columns[-1]}.*")
    fits = fetched_by_join(slim, rule_table(slim, rules)).where(F.rlike(F.col("where"), F.col("p")))
    one = F.struct("n", "t", "v")
    best = fits.groupBy("_row").agg(F.max(F.when(F.col("e"), one)).alias("best"), F.max(F.when(~F.col("e"), one)).alias("other"))
    by_url = slim.join(best, "_row", "left").select(F.col("url").alias("key"), F.struct("host", "path", "best", "other").alias("judged"))
    joined = pages.join(by_url, pages["url"].eqNullSafe(by_url["key"]))
    j = by_url["judged"]
    return _judged(joined, [pages[c] for c in kept], j["host"], j["path"], j["best"], j["other"])


def _judged(df: DataFrame, kept: list, host: Column, path: Column, best: Column, other: Column) -> DataFrame:
    return df.select(*kept, host.alias("host"), path.alias("path"), best["t"].alias("rule"), other["t"].alias("method_rule"), F.coalesce(best["v"], other["v"], F.lit("allow")).alias("verdict"))


def _sql() -> str:
    explicit = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for v, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in HOST_RULES)
    method = sorted((r for r in RULES if not r.explicit), key=lambda r: (-len(r.text), r.text))
    own = " ".join(f"WHEN regexp_matches(host, '(^|[.-]){r.text}($|[.-])') THEN '{r.text}'" for r in reversed(sorted(method, key=lambda r: (len(r.text), r.text))))
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE {explicit} END AS rule, CASE {own} END AS method_rule FROM parts
)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


SQL = _sql()
