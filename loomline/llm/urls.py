"""URL filters with a weighted vocabulary (operator 9).

An Aho-Corasick automaton finds every vocabulary term in a lower-cased URL. A term
counts where no letter or digit touches it. One strict term rejects; so do
SOFT_NEEDED different soft terms. Host and path rules go before the vocabulary. The
vocabulary is a parameter; ``read_terms`` reads one from files of "strict|soft, tab, term".

Defined cases: a null URL, or one without "://", has empty host and path, meets no
rule, and is judged by its own text (null: allow). Rules that tie in length go by the
later of them; a term in both lists is strict; a term counts once however often it
occurs; URLs are read whole, however long; repeated rows are judged alike. Extra
columns are kept; host, path, rule, verdict, strict_terms and soft_terms replace theirs.
"""

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import column, fresh, table

#: Terms that reject alone.
STRICT_TERMS = (
    "bestiality", "bitchute", "blackjack", "blowjob", "bukkake", "camgirl", "camgirls", "casino", "casinos", "crackz", "creampie", "cumshot", "cybersex", "deepfake", "dildo",
    "escort", "escorts", "fentanyl", "gambling", "gangbang", "hardcore", "hentai", "horny", "incest", "keygen", "keygens", "lolita", "malware", "masturbation", "milf", "nsfw",
    "nudes", "onlyfans", "orgasm", "orgy", "phishing", "poker", "porn", "porno", "pornhub", "pornstar", "ransomware", "redtube", "roulette", "sportsbook", "spyware", "striptease",
    "swingers", "tramadol", "viagra", "voyeur", "warez", "webcamsex", "whore", "xanax", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Terms of which SOFT_NEEDED different ones reject.
SOFT_TERMS = (
    "ad", "ads", "adult", "adults", "amateur", "babe", "babes", "bet", "bets", "betting", "bikini", "bonus", "bonuses", "cheap", "cialis", "cigarettes", "click", "crack", "cracked", "dating", "deals", "download",
    "erotic", "exploit", "fetish", "free", "gay", "girls", "hack", "hacked", "hacks", "hookup", "hot", "jackpot", "kinky", "lesbian", "lingerie", "live", "loan", "loans", "lottery",
    "naked", "nude", "odds", "payday", "pharmacy", "pills", "pirate", "pirated", "replica", "sex", "sexy", "singles", "slot", "slots", "spins", "stream", "strip", "teen", "teens",
    "torrent", "torrents", "tube", "vape", "weed", "win", "winner", "xx",
)
SOFT_NEEDED = 2
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once in a Python worker for a vocabulary."""
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (SOFT_NEEDED, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def read_terms(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) of a vocabulary in text files, a line "strict<tab>term" or "soft<tab>term" each; terms are lower-cased.

    A vocabulary goes to every task, so it is held by the driver too.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(F.lower(F.trim(parts[0])).alias("kind"), F.lower(F.trim(F.try_element_at(parts, F.lit(2)))).alias("term"))
    found = lines.where("kind in ('strict', 'soft') and term <> ''").distinct().orderBy("term").collect()
    return tuple(r.term for r in found if r.kind == "strict"), tuple(r.term for r in found if r.kind == "soft")


def touches(url: str, at: int) -> bool:
    return 0 <= at < len(url) and url[at].isascii() and url[at].isalnum()


def count_terms(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Different strict and soft terms of a lower-cased URL."""
    hits = {hit for end, hit in terms.iter(url) if not touches(url, end + 1) and not touches(url, end - len(hit[0]))}
    return sum(w > 1 for _, w in hits), sum(w == 1 for _, w in hits)


def terms_udf(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS):
    strict, soft = tuple(strict), tuple(soft)

    @F.arrow_udf("struct<strict:int,soft:int>")
    def counts(urls: pa.Array) -> pa.Array:
        terms = automaton(strict, soft)
        found = [count_terms(u, terms) if u else (0, 0) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["strict", "soft"])

    return counts


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    head = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    return F.coalesce(ascii_lower(head), F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2), F.lit(""))


def judge(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_needed=SOFT_NEEDED) -> DataFrame:
    """The pages with host, path, rule, strict_terms, soft_terms and verdict."""
    made = ("host", "path", "rule", "verdict", "strict_terms", "soft_terms")
    (own, terms) = fresh(pages, "judged_url", "judged_terms")
    df = pages.withColumn(own, column(url))
    df = df.select(*[column(c) for c in df.columns if c.lower() not in made])
    host, path = host_and_path(F.col(own))
    df = df.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for said, of, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(of + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    df = df.withColumn(terms, terms_udf(strict, soft)(ascii_lower(F.col(own))))
    by_terms = F.when((F.col(terms)["strict"] > 0) | (F.col(terms)["soft"] >= soft_needed), "block").otherwise("allow")
    return df.withColumns(
        {"rule": rule, "strict_terms": F.col(terms)["strict"], "soft_terms": F.col(terms)["soft"], "verdict": F.coalesce(verdict, by_terms)}
    ).drop(own, terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _hit(term: str) -> str:
    return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)"


SQL = f"""
WITH t AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, u,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM t),
r AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
    {' + '.join(map(_hit, STRICT_TERMS))} AS n_strict,
    {' + '.join(map(_hit, SOFT_TERMS))} AS n_soft
  FROM h)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN n_strict > 0 OR n_soft >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
