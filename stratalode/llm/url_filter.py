"""URL filtering with rules indexed by their rarest literal token.

Every rule is a regular expression plus the literal tokens that any url it
fits must hold whole. A rule is filed under the one of its tokens that the url
corpus holds least often; one with alternatives under one token for each of them.
A url is cut into tokens once; its tokens fetch the few candidate rules, and only
those run their regular expression. Everything is built from SQL functions: no
Python runs on the executors.

The index is one constant of the plan: an array of maps that a token's CRC-32 picks
from, so a look-up costs the same for ten rules as for a hundred thousand. Rule lists
are parameters held by the driver; an index of more than ``MOST_BYTES`` is an error.
Token counts come back to the driver for the tokens of the rules only.

Edge cases: a null url, or one without ``://``, has empty host and path and no
tokens of either; it fits no host rule. Rules without a usable token are
candidates for every url. Repeated rows are judged one by one; an empty table
gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
import re._constants as C
import re._parser as parser
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_GAP = "[^0-9a-z]+"
#: Of the index as text.
MOST_BYTES = 64 << 20

#: Host and path prefixes with their verdicts.
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Patterns over lower-cased urls, for urls that no host rule fits.
BLOCK_PATTERNS = [
    r"\bporn\b",
    r"\bxxx\b",
    r"\bcasino\b",
    r"\bviagra\b",
    r"\btorrent\b",
    r"/wp-login\.php",
    r"/doubleclick/",
]


@dataclass(frozen=True)
class Rule:
    """``regex`` is matched against ``scheme-less`` text ``host + path`` (host rules)
    or the lower-cased url (patterns); ``tokens`` has for each way to fit the literals
    that a url holds as whole tokens then; ``size`` ranks rules, longest first."""

    name: str
    regex: str
    tokens: tuple[tuple[str, ...], ...]
    verdict: str
    size: int
    on_host: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """The rule for a host, its subdomains, and paths that start with ``path``."""
    whole = [t for t in re.split(TOKEN_GAP, host) if t]
    # the last piece of the path may go on in the url, so it is no whole token; upper case meets no lower-cased token
    whole += [t for t in re.split(TOKEN_GAP, path.translate(_ASCII_LOWER))[:-1] if t]
    regex = rf"(?s)^(?:[^/]*\.)?\Q{host}\E\x00\Q{path}\E.*$"
    return Rule(f"{host}{path}", regex, (tuple(whole),), verdict, len(host) + len(path), True)


_ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: What a part of a pattern may be beside a character: a place where a token ends, or anything.
EDGE, ANY = "edge", "any"
#: Ways to fit that are followed before a pattern counts as having no tokens.
MOST_WAYS = 64


def ways_to_fit(pattern: str) -> list[list[str]] | None:
    """For each combination of a pattern's alternatives the characters every match holds in this
    order, with EDGE and ANY between; None if the pattern isn't understood. What may be missing is ANY."""
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    flags = tree.state.flags
    if flags & ~(re.IGNORECASE | re.DOTALL | re.MULTILINE | re.UNICODE) or "&&" in pattern:
        return None
    ways = _ways(tree, bool(flags & re.IGNORECASE))
    return ways if len(ways) <= MOST_WAYS else None


def _ways(tree: Iterable[tuple[object, object]], folded: bool) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for kind, value in tree:
        options = [[ANY]]
        if kind is C.LITERAL:
            options = [[chr(value).translate(_ASCII_LOWER) if folded else chr(value)]]
        elif kind is C.AT and value is not C.AT_NON_BOUNDARY:
            options = [[EDGE]]
        elif kind is C.IN and all(k is C.LITERAL and not re.fullmatch("[0-9A-Za-z]", chr(v)) for k, v in value):
            options = [[EDGE]]  # one of some characters of which none belongs to a token
        elif kind is C.SUBPATTERN and not value[1] and not value[2]:
            options = _ways(value[3], folded)
        elif kind is C.BRANCH:
            options = [w for branch in value[1] for w in _ways(branch, folded)]
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            options = [[*w, ANY] for w in _ways(value[2], folded)] if value[1] > 1 else _ways(value[2], folded)
        out = [[*w, *o] for w in out for o in options]
        if len(out) > MOST_WAYS:
            return out
    return out


def whole_tokens(way: list[str]) -> tuple[str, ...]:
    """Runs of letters and digits that something else stands before and after."""
    found, run, bounded = [], "", False
    for part in [*way, ANY]:
        if len(part) == 1 and re.fullmatch("[0-9a-z]", part):
            run += part
            continue
        if run and bounded and part != ANY:
            found.append(run)
        run, bounded = "", part != ANY
    return tuple(found)


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """The rule for a regular expression."""
    ways = ways_to_fit(pattern)
    return Rule(pattern, pattern, tuple(map(whole_tokens, ways)) if ways else ((),), verdict, len(pattern), False)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    empty = F.lit("")
    return F.coalesce(ascii_lower(F.regexp_extract(url, shape, 1)), empty), F.coalesce(F.regexp_extract(url, shape, 2), empty)


def url_tokens(url: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(url, F.lit(""))), TOKEN_GAP)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """How many urls hold each of ``tokens``: at most ``len(tokens)`` rows are fetched."""
    if not tokens:
        return {}
    if sum(map(len, tokens)) > MOST_BYTES:
        raise ValueError("the rules' tokens are more than an index may hold")
    wanted = urls.sparkSession.range(1).select(F.explode(_constant(sorted(tokens), "array<string>")).alias("token"))
    found = urls.select(F.explode(url_tokens(F.col(url_col))).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token of each way to fit; those with a way without one are under the empty string."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        filed = {min(way, key=lambda t: (counts.get(t, 0), t), default="") for way in r.tokens}
        for token in sorted(filed) if "" not in filed else [""]:
            index.setdefault(token, []).append(r)
    return index


ENTRY = "array<struct<size:int,name:string,regex:string,verdict:string,on_host:boolean>>"


def _listed(rules: list[Rule]) -> list[dict[str, object]]:
    return [{"size": r.size, "name": r.name, "regex": r.regex, "verdict": r.verdict, "on_host": r.on_host} for r in rules]


def _constant(value: object, kind: str) -> Column:
    """A value as one constant: the optimizer reads the text once."""
    text = json.dumps(value)
    if len(text) > MOST_BYTES:
        raise ValueError(f"the rules make an index of {len(text)} bytes; {MOST_BYTES} are the most")
    return F.from_json(F.lit(text), kind)


def fetched(index: dict[str, list[Rule]], tokens: Column) -> Column:
    """The rules filed under any of a url's tokens."""
    slots: list[dict[str, list[dict[str, object]]]] = [{} for _ in range(max(1, len(index) // 2))]
    for token, rules in index.items():
        slots[zlib.crc32(token.encode()) % len(slots)][token] = _listed(rules)
    table = _constant(slots, f"array<map<string,{ENTRY}>>")
    found = F.transform(tokens, lambda t: F.try_element_at(F.get(table, (F.crc32(t.cast("binary")) % len(slots)).cast("int")), t))
    return F.array_distinct(F.flatten(F.filter(found, lambda rules: rules.isNotNull())))


def filter_urls(
    urls: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    patterns: list[str] = BLOCK_PATTERNS,
    otherwise: str = "allow",
) -> DataFrame:
    """One row per url: id, host, path, rule (the longest fitting host rule, else
    null), verdict (that rule's; else ``block`` if a pattern fits, else
    ``otherwise``), pattern (the pattern that decided, else null) and
    n_candidates (rules whose regular expressions ran)."""
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(p) for p in patterns]
    index = index_rules(rules, token_counts(urls, url_col, {t for r in rules for way in r.tokens for t in way}))
    always = _constant(_listed(index.pop("", [])), ENTRY)
    host, path = split_url(F.col(url_col))
    cut = urls.select(
        F.col(id_col), host.alias("host"), path.alias("path"),
        ascii_lower(F.coalesce(F.col(url_col), F.lit(""))).alias("_url"), url_tokens(F.col(url_col)).alias("_tokens"),
    )
    candidates = F.concat(always, fetched(index, F.col("_tokens"))) if index else always
    target = F.concat(F.col("host"), F.lit("\0"), F.col("path"))
    cut = cut.withColumn("_candidates", candidates)
    fits = F.filter(F.col("_candidates"), lambda r: F.rlike(F.when(r["on_host"], target).otherwise(F.col("_url")), r["regex"]))
    best = F.sort_array(F.col("_fits"), asc=False)  # size, then name, highest first
    on_host = F.get(F.filter(best, lambda r: r["on_host"]), F.lit(0))
    by_pattern = F.get(F.filter(best, lambda r: ~r["on_host"]), F.lit(0))
    judged = cut.withColumn("_fits", fits).withColumns({"_rule": on_host, "_pattern": by_pattern})
    return judged.select(
        id_col, "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.col("_pattern.verdict"), F.lit(otherwise)).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_pattern.name")).alias("pattern"),
        F.size("_candidates").alias("n_candidates"),
    )
