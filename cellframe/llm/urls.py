"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression with literal tokens that every URL it fits must have. The rule is listed under the one
of them that the fewest URLs of the table have. A URL looks up its own tokens, and only the rules that it fetches run
their expressions on it. The index is a literal of the plan, so nothing is shuffled, and neither a frequent token nor a
repeated URL brings rows together.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellframe.llm.frames import quoted, table
from cellframe.llm.registry import query

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"
_ENTRIES = "array<struct<n:int,rule:string,verdict:string,site:boolean,pattern:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression; ``site`` rules run on host and path put together, others on the URL in
    lower case. ``tokens`` are those that each fitting URL has.
    """

    rule: str
    verdict: str
    site: bool
    pattern: str
    tokens: frozenset[str]


def _literal(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _lower(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _tokens(text: str, closed_left: bool, closed_right: bool) -> set[str]:
    """Tokens of a literal part of a rule that are whole tokens of any URL with that part."""
    return {
        m.group()
        for m in re.finditer(_TOKEN, _lower(text))
        if (m.start() > 0 or closed_left) and (m.end() < len(text) or closed_right)
    }


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, and paths that start with ``path``."""
    host = _lower(host)
    end = "" if path else "(?:/|$)"
    tokens = _tokens(host, True, True) | _tokens(path, True, False)
    return Rule(host + path, verdict, True, rf"^(?:[^/]*\.)?{_literal(host)}{end}{_literal(path)}", frozenset(tokens))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A pattern on the URL in lower case: ``*`` is any text, ``^`` one separator or the end, ``||`` at the start a host
    or a subdomain of one, ``|`` the start or the end of the URL.
    """
    rest, start, end = _lower(text), "", ""
    closed = rest.startswith("|")
    if rest.startswith("||"):
        rest, start = rest[2:], r"^(?:(?!:\/\/)[\s\S])*:\/\/(?:[^/?#]*\.)?"
    elif closed:
        rest, start = rest[1:], "^"
    if rest.endswith("|"):
        rest, end = rest[:-1], r"\z"
    out, tokens = start, set()
    parts = re.split(r"([*^])", rest)
    for k, part in enumerate(parts):
        if k % 2:
            out += r"[\s\S]*" if part == "*" else r"(?:[^a-z0-9_.%-]|\z)"
            continue
        out += _literal(part)
        tokens |= _tokens(part, closed if k == 0 else parts[k - 1] == "^", bool(end) if k == len(parts) - 1 else parts[k + 1] == "^")
    return Rule(text, verdict, False, out + end, frozenset(tokens))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, and then the path up to
    ``?``, ``#`` or the end; both empty for null and where there is no ``://``.
    """
    part = lambda k: F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _lookup(entries: Mapping[str, object], kind: str) -> tuple[Column, int]:
    """``entries`` as a literal: an array of small maps by the CRC-32 of the key, since Spark reads a map from its start."""
    count = max(1, len(entries))
    buckets: list[dict[str, object]] = [{} for _ in range(count)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % count][key] = value
    return F.from_json(F.lit(json.dumps(buckets)), kind), count


def _found(lookup: tuple[Column, int], key: Column) -> Column:
    index, count = lookup
    return F.get(index, (F.crc32(key) % count).cast("int"))[key]


def _url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), F.lit(_TOKEN), F.lit(0)))


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """URLs of ``pages`` with each token of ``rules``, counted over all rows; as large as the rules, not as the table."""
    wanted = {t: 0 for r in rules for t in r.tokens}
    if not wanted:
        return {}
    known = _lookup({t: 1 for t in wanted}, "array<map<string,int>>")
    tokens = F.filter(_url_tokens(F.col(url)), lambda t: _found(known, t).isNotNull())
    counted = pages.select(F.explode(tokens).alias("token")).groupBy("token").count().collect()
    return wanted | {r["token"]: r["count"] for r in counted}


def index(rules: Sequence[Rule], counts: Mapping[str, int]) -> tuple[dict[str, list[dict]], list[dict]]:
    """Rules by the token that the fewest URLs have (ties: the smaller one), and those without a token."""
    listed: dict[str, list[dict]] = {}
    bare = []
    for n, r in enumerate(rules):
        entry = {"n": n, "rule": r.rule, "verdict": r.verdict, "site": r.site, "pattern": r.pattern}
        if r.tokens:
            listed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
        else:
            bare.append(entry)
    return listed, bare


def with_verdicts(pages: DataFrame, rules: Sequence[Rule], url: str = "url", prefix: str = "") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest site rule that fits, else null), ``verdict`` (that
    rule's; else allow if an allowing pattern fits, block if only blocking ones do, allow if none does) and
    ``candidates`` (expressions run).

    Of site rules of one length the smaller in code points wins, of equal ones the first given. Null, empty and very
    long URLs are judged like others: a null one, or one without ``://``, has no host, so only patterns can fit it.
    ``rules`` travel with the plan; their number is the caller's and no row's. A rule without a whole literal token
    runs on every URL. Rows and repeats stay as they are; columns that have the names of the results, before which
    ``prefix`` is put, are replaced.
    """
    names = [prefix + n for n in ("host", "path", "rule", "verdict", "candidates")]
    kept = [c for c in pages.columns if c not in names]
    listed, bare = index(rules, token_counts(pages, rules, url))
    by_token = _lookup(listed, f"array<map<string,{_ENTRIES}>>")
    none, always = (F.from_json(F.lit(json.dumps(entries)), _ENTRIES) for entries in ([], bare))
    given = F.col("`" + url.replace("`", "``") + "`")
    lowered = F.translate(F.coalesce(given, F.lit("")), _UPPER, _LOWER)
    host, path = host_and_path(given)
    fetched = F.concat(F.flatten(F.transform(_url_tokens(given), lambda t: F.coalesce(_found(by_token, t), none))), always)
    rows = pages.select(*quoted(kept), F.struct(host.alias("host"), path.alias("path"), lowered.alias("lowered"), fetched.alias("fetched")).alias("url!"))
    site = F.concat(F.col("url!.host"), F.col("url!.path"))
    fits = F.filter(F.col("url!.fetched"), lambda r: F.regexp_like(F.when(r["site"], site).otherwise(F.col("url!.lowered")), r["pattern"]))
    rows = rows.select(*quoted(kept), "url!", fits.alias("fits!"))
    of_site = F.transform(F.filter("fits!", lambda r: r["site"]), lambda r: F.struct((-F.length(r["rule"])).alias("shorter"), r["rule"].alias("rule"), r["n"].alias("n"), r["verdict"].alias("verdict")))
    best = F.array_min(of_site)
    others = F.transform(F.filter("fits!", lambda r: ~r["site"]), lambda r: r["verdict"])
    by_pattern = F.when(F.array_contains(others, "allow"), "allow").when(F.array_contains(others, "block"), "block").otherwise("allow")
    found = (F.col("url!.host"), F.col("url!.path"), best["rule"], F.coalesce(best["verdict"], by_pattern), F.size("url!.fetched"))
    return rows.select(*quoted(kept), *(c.alias(n) for c, n in zip(found, names)))


SITES = [
    site_rule("com", "/", "allow"),
    site_rule("example.com", "/en/", "block"),
    site_rule("www.example.com", "/en/", "allow"),
    site_rule("net", "/es/", "block"),
    site_rule("net", "/fr/", "block"),
]
#: Hosts of advertising, gambling, adult and junk pages by the words that their labels are made of.
PATTERNS = [
    pattern_rule(p)
    for p in (
        "||ads-", "||ads.", "||adult-", "||casino-", "||cheap-pills", "||free-bets.", "||spam-", "-casino.", "-porn.",
        "||free-pills.", "-farm.example.", "|*://*/banners/", "/popunder^",
    )
] + [pattern_rule("||ads-help.", "allow")]

#: Every rule is asked about every URL here, in words of its own.
SQL = r"""with split as (select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
  ruled as (select *, '.' || host as h, case
      when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
      when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
      when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
      when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
      when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/' end as rule from split)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when contains(h, '.ads-help.') then 'allow'
    when contains(h, '.ads-') or contains(h, '.ads.') or contains(h, '.adult-') or contains(h, '.casino-') or contains(h, '.cheap-pills')
      or contains(h, '.free-bets.') or contains(h, '.spam-') or contains(lowered, '-casino.') or contains(lowered, '-porn.') or contains(h, '.free-pills.')
      or contains(lowered, '-farm.example.') or regexp_matches(lowered, '://.*/banners/') or regexp_matches(lowered, '/popunder([^a-z0-9_.%-]|$)') then 'block'
    else 'allow' end as verdict
from ruled"""


@query("op13_url_rules", SQL)
def op13_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return with_verdicts(pages, SITES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")
