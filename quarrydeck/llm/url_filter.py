"""URL filters: rules for hosts and paths first, then a weighted vocabulary matched by Aho-Corasick.

The vocabulary is a table (term, kind, weight) of strict terms and weighted soft terms. One pass of the automaton over the
URL, percent-decoded and with A-Z lower-cased, finds them; a hit counts only if no letter a-z or digit touches it on either
side. A URL is blocked on one strict hit, or when at least ``soft_least`` distinct soft terms hit and together weigh
``soft_limit`` or more: two everyday words ("farm", "free") do not reach it, one of them beside a telling one does, and one
soft term alone never blocks.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with the rule's; the
longest fitting rule decides.

Cases: a null URL, or one without ``://``, has an empty host and path and can still hit terms; an empty vocabulary
allows everything; a term with a null or no text is no term, and among equal terms strict wins, then the largest weight;
rules of equal length: the first given; very long URLs are read whole; repeated rows stay rows; an empty table gives an
empty one; other columns pass through, but one that is called like a made column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map

#: Terms that block a URL alone.
STRICT = (
    "bestiality", "blowjob", "camgirls", "camsex", "carding", "casino", "casinos", "crackz", "cumshot", "escort", "escorts", "fakeid", "gangbang", "hardcoresex", "hentai", "jackpot", "keygen", "livesex",
    "malware", "milf", "nudes", "onlinecasino", "phishing", "porn", "porno", "pornstar", "ransomware", "roulette", "sexcam", "sexshop", "slotmachine", "spyware", "sportsbook", "stealer", "torrent", "torrents",
    "viagra", "cialis", "warez", "xxx", "xnxx",
)
#: Soft terms by weight: telling ones, then doubtful ones, then everyday words that count beside a telling one only.
TELLING = ("adult", "ads", "adserver", "bet", "bets", "betting", "clickbait", "dating", "doorway", "gambling", "hookup", "lottery", "naked", "nude", "payday", "pharma", "pills", "poker", "replica", "sex", "sexy", "slots", "spam", "stripper", "swinger")
DOUBTFUL = ("astrology", "bingo", "bonus", "botox", "coupon", "credit", "crypto", "diet", "drugs", "erotic", "forex", "hack", "hacked", "loan", "loans", "proxy", "seo", "singles", "steroids", "tarot", "tracker", "weightloss")
EVERYDAY = ("best", "bulk", "buy", "cash", "cheap", "click", "deal", "deals", "discount", "download", "earn", "easy", "farm", "fast", "free", "guaranteed", "hot", "instant", "link", "links", "lucky", "money", "offer", "offers", "online", "prize", "promo", "rich", "secret", "track", "traffic", "vip", "win", "winner")
SOFT = {**dict.fromkeys(TELLING, 0.75), **dict.fromkeys(DOUBTFUL, 0.5), **dict.fromkeys(EVERYDAY, 0.25)}
SOFT_LIMIT, SOFT_LEAST = 1.0, 2
#: The rules of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
ALNUM = frozenset(LOWER + "0123456789")
PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    found = PARTS.search(url or "")
    return (found[1].translate(FOLD), found[2]) if found else ("", "")


@lru_cache(8)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    if not terms:
        return None
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(url: str, finder: ahocorasick.Automaton | None) -> set[str]:
    """The distinct terms in the percent-decoded URL with a boundary on both sides."""
    if finder is None:
        return set()
    text = (unquote(url, errors="replace") if "%" in url else url).translate(FOLD)
    return {term for end, term in finder.iter(text) if (end + 1 == len(text) or text[end + 1] not in ALNUM) and (end < len(term) or text[end - len(term)] not in ALNUM)}


def fitting_rule(host: str, path: str, rules: Mapping[str, Sequence[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule; ``rules`` has each host's (path, verdict), so a host costs one lookup a label."""
    best, rest = None, host
    while True:
        for start, verdict in rules.get(rest, ()):
            if path.startswith(start) and (best is None or len(rest + start) > len(best[0])):
                best = (rest + start, verdict)
        if "." not in rest:
            return best
        rest = rest.split(".", 1)[1]


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """The vocabulary of this module as a table (term, kind, weight)."""
    rows = [(t, "strict", None) for t in STRICT] + [(t, "soft", w) for t, w in SOFT.items()]
    return spark.createDataFrame(rows, "term string, kind string, weight double")


def read_vocabulary(vocabulary: DataFrame, most_terms: int) -> tuple[frozenset[str], dict[str, float]]:
    """Strict terms, and soft terms with their weights. A vocabulary above ``most_terms`` is an error, as it goes to all tasks."""
    rows = vocabulary.select(F.translate("term", UPPER, LOWER).alias("term"), "kind", F.col("weight").cast("double").alias("weight")).where("term != ''").limit(most_terms + 1).collect()
    if len(rows) > most_terms:
        raise ValueError(f"a vocabulary of more than {most_terms} terms")
    strict, soft = frozenset(r.term for r in rows if r.kind == "strict"), {}
    for r in rows:
        if r.term not in strict:
            soft[r.term] = max(soft.get(r.term, 0.0), r.weight or 0.0)
    return strict, soft


def judge_urls(pages: DataFrame, *, url_col: str = "url", vocabulary: DataFrame | None = None, soft_limit: float = SOFT_LIMIT, soft_least: int = SOFT_LEAST, rules: Sequence[tuple[str, str, str]] = (), most_terms: int = 1_000_000) -> DataFrame:
    """Add host, path, rule, verdict, strict_hits (distinct), soft_hits (distinct) and soft_weight."""
    strict, soft = (frozenset(STRICT), SOFT) if vocabulary is None else read_vocabulary(vocabulary, most_terms)
    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")
    kept = [c for c in pages.columns if c not in made]
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    terms, banned = tuple(sorted({*strict, *soft})), strict

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(terms)
        for batch in batches:
            rows = []
            for url in batch.column(len(kept)).to_pylist():
                host, path = split_url(url)
                found = hits(url or "", finder)
                hard, mild = found & banned, found - banned
                weight = float(sum(soft[t] for t in sorted(mild)))
                rule = fitting_rule(host, path, by_host)
                verdict = rule[1] if rule else "block" if hard or (len(mild) >= soft_least and weight >= soft_limit) else "allow"
                rows.append((host, path, rule and rule[0], verdict, len(hard), len(mild), weight))
            own = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (pa.string(),) * 4 + (pa.int32(),) * 2 + (pa.float64(),))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *own], names=[*kept, *made])

    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{url_col}`").alias("__url"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"])
    return arrow_map(rows, judged, schema)


def oracle() -> str:
    """The registered query in DuckDB SQL."""

    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)')"

    hard = " + ".join(f"{hit(t)}::INT" for t in STRICT)
    mild = " + ".join(f"{hit(t)}::INT" for t in SOFT)
    weight = " + ".join(f"{hit(t)}::INT * {w}::DOUBLE" for t, w in SOFT.items())
    fits = [f"('{h}{p}', '{v}', (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, v in RULES]
    return f"""
WITH parts AS (SELECT page_id, translate(CASE WHEN contains(url, '%') THEN url_decode(url) ELSE coalesce(url, '') END, '{UPPER}', '{LOWER}') AS u, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
counted AS (SELECT *, {hard} AS strict_hits, {mild} AS soft_hits, {weight} AS soft_weight,
  list_sort(list_filter([{", ".join(f"{{'n': -length({f.split(',')[0][1:]}), 'rule': {f.split(',')[0][1:]}, 'verdict': {f.split(', ')[1]}, 'fits': {f.split(', ', 2)[2][:-1]}}}" for f in fits)}], lambda r: r.fits))[1] AS best FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN strict_hits > 0 OR (soft_hits >= {SOFT_LEAST} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict, strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits, soft_weight FROM counted
"""
