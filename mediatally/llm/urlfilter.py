r"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression; the literal tokens that any url it fits must hold are read off its parse tree. Rules
are given as a tuple or as a table (rules_of). A first pass over the urls
counts how many hold each of these tokens; a rule is filed under its rarest one (a rule without a token under none). The
second pass cuts each url into tokens, fetches the rules filed under them, and runs the regular expressions of those
only. Host rules come first: of those that fit, the longest decides. Then the pattern rules: a block rule decides
before an allow rule. A url that no rule fits is allowed.

The index is part of the task, so its size depends on the rules and not on the urls; a table of rules is read up to
`most` of them, beyond which it is refused, never cut. Rules beyond RULES_AT_ONCE are
judged in further passes of that size, so what each task holds stays bounded. Nothing is shuffled but the token counts.

Defined results: a null url, or one without `://`, has an empty host and path and is judged by the pattern rules alone
(a null url by none: allow); rows that repeat are judged each; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import table

RULES_AT_ONCE = 200_000
TOKEN = re.compile(r"[a-z0-9]+")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # on host and path for a host rule, on the lower-cased url for a pattern rule
    tokens: tuple[str, ...]  # each stands whole in every url that fits
    weight: int  # length of a host rule; 0 for a pattern rule


def host_rule(verdict: str, rule: str) -> Rule:
    """`example.com/de/`: the host and its subdomains, and paths that start with /de/."""
    host, slash, path = rule.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # The last token of a path that doesn't end in a separator may go on in the url.
    closed = rule if not rule or not rule[-1].isalnum() else rule[: len(rule) - len(re.search(r"[A-Za-z0-9]+$", rule)[0])]
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys(TOKEN.findall(closed.lower()))), len(rule))


def _edge(item: tuple, right: bool) -> tuple[bool, bool]:
    """Of what a part of a pattern matches: is its first (right) or last (left) character surely outside tokens or an end
    of the url, and can the part be empty. A part that is not understood is taken to touch the token."""
    op, arg = item
    if op is K.LITERAL:
        return not TOKEN.match(chr(arg).lower()), False
    if op is K.IN:
        known = all(o in (K.LITERAL, K.RANGE) for o, _ in arg)
        spans = [(v, v) if o is K.LITERAL else v for o, v in arg] if known else []
        return known and not any(TOKEN.match(chr(c).lower()) for lo, hi in spans for c in range(lo, min(hi, 127) + 1)), False
    if op is K.AT:
        ends = (K.AT_END, K.AT_END_STRING) if right else (K.AT_BEGINNING, K.AT_BEGINNING_STRING)
        return arg in (*ends, K.AT_BOUNDARY), False
    if op is K.SUBPATTERN:
        return _edges(list(arg[3]), right)
    if op is K.BRANCH:
        each = [_edges(list(branch), right) for branch in arg[1]]
        return all(closes for closes, _ in each), any(empty for _, empty in each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        closes, empty = _edges(list(arg[2]), right)
        return closes, empty or arg[0] == 0
    return False, False


def _edges(items: list[tuple], right: bool) -> tuple[bool, bool]:
    for item in items if right else reversed(items):
        closes, empty = _edge(item, right)
        if not closes or not empty:
            return closes, False
    return True, True


def _flat(items: Iterator[tuple]) -> list[tuple]:
    """The parts that every match goes through in order, groups opened."""
    return [inner for op, arg in items for inner in (_flat(arg[3]) if op is K.SUBPATTERN and not arg[1] else [(op, arg)])]


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that stand whole in every text the pattern fits: runs of literal letters and digits that nothing else can
    lengthen on either side. None from parts that may be missing, nor from patterns that ignore case."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    items = _flat(iter(parsed))
    inside = [op is K.LITERAL and TOKEN.match(chr(arg).lower()) is not None for op, arg in items]
    tokens, at = [], 0
    while at < len(items):
        end = at
        while end < len(items) and inside[end]:
            end += 1
        if end > at and all(_edges(side, right) == (True, False) for side, right in ((items[:at], False), (items[end:], True))):
            tokens.append("".join(chr(arg) for _, arg in items[at:end]).lower())
        at = max(end, at + 1)
    return tuple(dict.fromkeys(tokens))


def pattern_rule(name: str, verdict: str, pattern: str) -> Rule:
    return Rule(name, verdict, pattern, literal_tokens(pattern), 0)


def rules_of(table: DataFrame, most: int = 2_000_000) -> tuple[Rule, ...]:
    """The rules of a table (verdict, host, name, pattern): a host rule where `host` is given (`example.com/de/`), else a
    pattern rule. Null or unknown verdicts, rows with neither, broken patterns and tables of more than `most` rows are errors."""
    rows = table.select("verdict", "host", "name", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules; raise `most` if the driver and the tasks can hold them")
    wrong = [r for r in rows if r.verdict not in ("block", "allow") or (r.host is None) == (r.pattern is None)]
    if wrong:
        raise ValueError(f"a rule has the verdict block or allow, and either a host or a pattern: {wrong[0]}")
    return tuple(host_rule(r.verdict, r.host) if r.host is not None else pattern_rule(r.name or r.pattern, r.verdict, r.pattern) for r in rows)


# The host rules of the contract.
HOST_RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)

# The method's own rules, on the lower-cased url: pages that hold no prose, or prose nobody should train on.
PATTERN_RULES = (
    pattern_rule("login page", "block", r"/login(?:[/?#.]|$)"),
    pattern_rule("shopping cart", "block", r"/cart/checkout(?:[/?#]|$)"),
    pattern_rule("ad server", "block", r"://(?:[^/?#]*\.)?adserver\."),
    pattern_rule("gambling host", "block", r"://(?:[^/?#]*[.-])?casino[.-]"),
    pattern_rule("adult host", "block", r"://(?:[^/?#]*[.-])?xxx(?:[./?#-]|$)"),
    pattern_rule("raw address", "block", r"://[0-9]+(?:\.[0-9]+)+(?:[:/?#]|$)"),
    pattern_rule("encyclopaedia", "allow", r"/wiki/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, CAPITALS, SMALL), path


def tokens_of(url: str) -> set[str]:
    return set(TOKEN.findall(url.lower()))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many urls each token of the rules stands; one row per task and token is shuffled."""
    wanted = {t for r in rules for t in r.tokens}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                n.update(tokens_of(url or "") & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    counted = urls.select("url").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict(Counter({t: 0 for t in wanted}) | {r.token: r.n for r in counted.collect()})  # a row per token of the rules


def filed(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; ties go to the longer, then the alphabetically first."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")].append(rule)
    return dict(index)


def judged(urls: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """One pass: the better of the rule found so far and the best among the rules the tokens fetch."""

    def better(rule: Rule) -> tuple[bool, int, bool, str]:
        return rule.weight > 0, rule.weight, rule.verdict == "block", rule.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {t: [(r, re.compile(r.pattern)) for r in rules] for t, rules in index.items()}
        always = ready.pop("", [])
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("url", "host", "path", "found", "weight", "blocks")}
            names, weights, blocks = [], [], []
            for url, host, path, *before in zip(*(batch.column(at[n]).to_pylist() for n in at)):
                best = Rule(before[0], "block" if before[2] else "allow", "", (), before[1]) if before[0] is not None else None
                whole, low = host + path, (url or "").lower()
                fetched = (x for t in tokens_of(url or "") if t in ready for x in ready[t])
                for rule, pattern in (*always, *fetched):
                    if pattern.search(whole if rule.weight else low) and (best is None or better(rule) > better(best)):
                        best = rule
                names.append(best and best.name)
                weights.append(best.weight if best else 0)
                blocks.append(bool(best and best.verdict == "block"))
            new = {"found": pa.array(names, pa.string()), "weight": pa.array(weights, pa.int32()), "blocks": pa.array(blocks, pa.bool_())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], batch.schema.names)

    return urls.mapInArrow(run, urls.schema)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the host rule that decided), verdict, pattern (the pattern rule that decided)."""
    urls = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    counts = token_counts(urls, rules)
    host, path = url_parts(F.col("url"))
    found = urls.select(
        "page_id", "url", host.alias("host"), path.alias("path"),
        F.lit(None).cast("string").alias("found"), F.lit(0).cast("int").alias("weight"), F.lit(False).alias("blocks"),
    )
    for at in range(0, len(rules), RULES_AT_ONCE):
        found = judged(found, filed(rules[at : at + RULES_AT_ONCE], counts))
    return found.select(
        "page_id", "host", "path", F.when(F.col("weight") > 0, F.col("found")).alias("rule"),
        F.when(F.col("blocks"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("weight") == 0, F.col("found")).alias("pattern"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
with u as (
  select page_id, coalesce(lower(url), '') as low,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), s as (
  select page_id, low, rest, regexp_extract(rest, '^[^/?#]*', 0) as h from u
), p as (
  select page_id, low, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) as path from s
), r as (
  select *,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
    case when regexp_matches(low, '/cart/checkout(?:[/?#]|$)') then 'shopping cart'
         when regexp_matches(low, '://[0-9]+(?:\.[0-9]+)+(?:[:/?#]|$)') then 'raw address'
         when regexp_matches(low, '/login(?:[/?#.]|$)') then 'login page'
         when regexp_matches(low, '://(?:[^/?#]*[.-])?casino[.-]') then 'gambling host'
         when regexp_matches(low, '://(?:[^/?#]*[.-])?xxx(?:[./?#-]|$)') then 'adult host'
         when regexp_matches(low, '://(?:[^/?#]*\.)?adserver\.') then 'ad server'
         when regexp_matches(low, '/wiki/') then 'encyclopaedia' end as ruled
  from p
)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when ruled is null or ruled = 'encyclopaedia' then 'allow' else 'block' end as verdict,
       case when rule is null then ruled end as pattern
from r
"""
