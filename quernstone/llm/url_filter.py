"""URL filter: host/path rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

A vocabulary has strict and soft terms. A term is one or several words, each with its regular plural; a word counts where it stands in the URL
with no letter or digit beside it, or where the whole run of letters and digits that it stands in is made of the vocabulary's words and of JOINING ones (``bestcasino``). Escapes are decoded first (``%20`` is a blank, ``%63`` a letter), and those of non-ASCII bytes are blanks.
One strict term rejects a URL; so do soft terms that together weigh ``BLOCK_TENTHS`` or more. A soft term weighs less than that, and each
counts once, so that it takes several different ones; words of reference and advice take weight away. Vocabularies are parameters, and can be read from a table.

Every URL is one narrow map: no shuffle, no state, so a third of all rows under
one host costs no more than any other third. The vocabulary is broadcast with the function, and bounded by ``MOST_TERMS``.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged on its whole text (null: no hits, allowed). Repeated rows get
the same verdict each. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: Strict terms, words of a term apart by a slash: one is enough to reject a URL.
STRICT = (
    "porn/porno/pornography xxx hentai milf bdsm camgirl camsex sexcam erotica gangbang blowjob cumshot incest upskirt callgirl stripclub "
    "casino roulette blackjack baccarat sportsbook bookmaker bookie slotmachine videopoker "
    "viagra cialis levitra tramadol xanax oxycodone phentermine modafinil "
    "warez serialz crackz nulled camrip"
)

#: Soft terms, with their weights in tenths. Words that are as much a topic as an offer are soft.
SOFT = {
    7: "bet/betting/bettor poker gambling/gamble/gambler lottery/lotto jackpot sex/sexy/sexual nude/naked adult fetish pill/tablet/capsule spam/spammer/spamming crack/cracked/cracker payday replica counterfeit escort torrent malware phishing spyware ransomware botnet scareware adware",
    5: "ad/advert/advertising/advertisement banner popup/popunder track/tracker/tracking affiliate redirect/redirector clickbait doorway loan/lender forex bonus/bonuses prize sweepstake pharmacy/pharma steroid prescription dating/hookup webcam hack/hacked hacker trojan keylogger backlink linkbuilding darknet",
    4: "free/freebie cheap/cheapest giveaway win/winner/winning promo massage weightloss anabolic seo exploit drug slot odds wager stake",
    3: "download click offer discount coupon miracle diet detox crypto bitcoin single chat cam virus farm casting vip hot girl",
    2: "buy deal sale order credit cash money earn rich instant guaranteed limited exclusive",
    -3: "card bank review report school garden museum library range egg recipe",
    -5: "education/educational research analysis/analyses science history wiki wikipedia university hospital vaccine/vaccination prevention awareness safety linux ubuntu debian encyclopedia",
}
#: Words that terms are joined to in one run.
JOINING = frozenset("a the my your our best top new big real live online play site web world zone club hub house home shop store now go get for and to of 1 24 365 7 777".split())
BLOCK_TENTHS, MOST_TERMS = 10, 20_000


def plural(word: str) -> str:
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")


@dataclass(frozen=True)
class Term:
    """A vocabulary term: its words, and its weight in tenths; a strict term has BLOCK_TENTHS."""

    words: tuple[str, ...]
    tenths: int

    @property
    def strict(self) -> bool:
        return self.tenths >= BLOCK_TENTHS

    @property
    def forms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for w in self.words for f in (w, plural(w))))


def vocabulary(strict: str = STRICT, soft: dict[int, str] = SOFT) -> tuple[Term, ...]:
    """The terms of the lists above, or of others written like them."""
    return (*(Term(tuple(t.split("/")), BLOCK_TENTHS) for t in strict.split()), *(Term(tuple(t.split("/")), n) for n, line in sorted(soft.items(), reverse=True) for t in line.split()))


def read_vocabulary(table: DataFrame) -> tuple[Term, ...]:
    """The terms of a table (term string, words apart by a slash; tenths int); at most MOST_TERMS, beyond it a ValueError."""
    rows = table.select("term", "tenths").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return tuple(Term(tuple(r["term"].lower().split("/")), r["tenths"]) for r in sorted(rows))


def _lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; path: from there to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = _lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is applied last
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


@functools.lru_cache(maxsize=8)
def _automaton(terms: tuple[Term, ...]):
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for k, term in enumerate(terms):
        for form in term.forms:
            numbers.setdefault(form, []).append(k)
    for word in JOINING:
        numbers.setdefault(word, [])
    found = ahocorasick.Automaton()
    for form, of in numbers.items():
        found.add_word(form, (of, len(form)))
    found.make_automaton()
    return found


_RUN = re.compile("[a-z0-9]+")
_BLANKS, _ESCAPE, _SMALL = re.compile("%[89A-Fa-f][0-9A-Fa-f]"), re.compile("%([0-7][0-9A-Fa-f])"), str.maketrans(UPPER, LOWER)


def plain(url: str) -> str:
    """The URL with escapes decoded and A-Z lower-cased."""
    if "%" in url:
        url = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), _BLANKS.sub(" ", url))
    return url.translate(_SMALL)


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def distinct_hits(url: str, terms: tuple[Term, ...]) -> set[int]:
    """Numbers of the terms with a word in the plain URL that stands alone, or in a run that is made of words alone."""
    hits: set[int] = set()
    if not terms:
        return hits
    joined: dict[int, list[tuple[int, list[int]]]] = {}  # of words in runs: (end, terms) by begin
    for end, (of, length) in _automaton(terms).iter(url):
        start, end = end - length + 1, end + 1
        before, after = start > 0 and _inside(url[start - 1]), end < len(url) and _inside(url[end])
        if not before and not after:
            hits.update(of)
        else:
            joined.setdefault(start, []).append((end, of))
    if any(of for words in joined.values() for _, of in words):
        for run in _RUN.finditer(url):
            _add_joined(run.start(), run.end(), joined, hits)
    return hits


def _add_joined(begin: int, end: int, words: dict[int, list[tuple[int, list[int]]]], hits: set[int]) -> None:
    """Adds the terms of all words that take part in some way to make up the run from ``begin`` to ``end`` of words."""
    from_begin, to_end = {begin}, {end}
    for at in range(begin, end):
        if at in from_begin:
            from_begin.update(e for e, _ in words.get(at, ()) if e <= end)
    if end not in from_begin:
        return
    for at in range(end - 1, begin - 1, -1):
        if any(e in to_end for e, _ in words.get(at, ())):
            to_end.add(at)
    for at in from_begin:
        for e, of in words.get(at, ()):
            if e in to_end:
                hits.update(of)


def vocabulary_hits(terms: tuple[Term, ...]):
    """A pandas UDF on URLs: distinct strict and soft terms, and the soft weights' sum in tenths."""

    @F.pandas_udf("strict_hits int, soft_hits int, tenths int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            found = [terms[k] for k in distinct_hits(plain(url), terms)] if url else []
            soft = [t.tenths for t in found if not t.strict]
            rows.append((len(found) - len(soft), sum(n > 0 for n in soft), sum(soft)))
        return pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "tenths"])

    return hits


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, terms: tuple[Term, ...] | None = None, block_tenths: int = BLOCK_TENTHS) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits, weight) for every row; columns beyond the two named are not read."""
    host, path = host_and_path(F.col("u"))
    rows = df.select(F.col(id_col).alias("i"), F.col(url_col).alias("u")).select("i", host.alias("host"), path.alias("path"), vocabulary_hits(vocabulary() if terms is None else terms)(F.col("u")).alias("v"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("v.strict_hits") > 0) | (F.col("v.tenths") >= block_tenths), "block").otherwise("allow")
    return rows.select(F.col("i").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("v.strict_hits").alias("strict_hits"), F.col("v.soft_hits").alias("soft_hits"), (F.col("v.tenths") / 10).alias("weight"))


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _term(term: Term, words: str) -> str:
    return f"CAST(regexp_matches(u, '(^|[^a-z0-9])({words})*({'|'.join(term.forms)})({words})*([^a-z0-9]|$)') AS INTEGER)"


def oracle(rules: tuple[Rule, ...] = RULES, terms: tuple[Term, ...] | None = None, block_tenths: int = BLOCK_TENTHS) -> str:
    terms = vocabulary() if terms is None else terms
    strict, soft = [t for t in terms if t.strict], [t for t in terms if not t.strict]
    words = "|".join(sorted(JOINING | {f for t in terms for f in t.forms}))
    hit = {t: _term(t, words) for t in terms}
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ordered]
    return f"""
WITH cut AS (
  SELECT page_id, translate(url_decode(regexp_replace(coalesce(url, ''), '%[89A-Fa-f][0-9A-Fa-f]', ' ', 'g')), '{UPPER}', '{LOWER}') AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
hits AS (
  SELECT page_id, host, path, {" + ".join(hit[t] for t in strict)} AS strict_hits, {" + ".join(hit[t] for t in soft if t.tenths > 0)} AS soft_hits,
         {" + ".join(f"{t.tenths} * {hit[t]}" for t in soft)} AS tenths
  FROM parts)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r.name}'" for f, r in fits)} END AS rule,
       coalesce(CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits)} END,
                CASE WHEN strict_hits > 0 OR tenths >= {block_tenths} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, tenths / 10 AS weight
FROM hits"""


QUERIES = {"op7_url_vocabulary": op7_url_vocabulary}
ORACLE = {"op7_url_vocabulary": oracle()}
