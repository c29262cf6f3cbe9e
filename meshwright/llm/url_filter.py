"""URL filter: pattern rules indexed by their rarest literal token.

A rule is an anchor pattern ``host/path`` (the host and its subdomains, paths that begin with the rule's) or a
free pattern in which ``*`` stands for any characters. Each rule is filed under that one of its whole literal tokens
which fewest urls of the table hold. A url looks up its own tokens; only the rules found there run their regular
expressions. All of it is DataFrame functions: the index is a literal of hash buckets, so a row never leaves its
partition, and rows that repeat keep their own results.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and their verdict is ``default``.
Of fitting rules of one length the last by name counts. Urls of any length are read whole.
An empty table gives an empty result. Columns of the input named as an output column are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one pass over the table looks up; more rules take more passes over the same row.
RULES_A_PASS = 20_000


@dataclass(frozen=True)
class Rule:
    text: str
    action: str

    @property
    def anchored(self) -> bool:
        return "*" not in self.text

    @property
    def regex(self) -> str:
        """Over host + path; an anchored rule's host ends at a label boundary."""
        body = ".*".join(re.escape(x) for x in self.text.split("*"))
        return f"^(?:[^/]*\\.)?{body}" if self.anchored else f"(?s){body}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that any fitting url has whole."""
        text = ("." if self.anchored else "*") + self.text + "*"
        return [m[1].lower() for m in re.finditer(r"(?<=[^0-9A-Za-z*])([0-9A-Za-z]+)(?=[^0-9A-Za-z*])", text)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.split(F.translate(address, UPPER, LOWER), "[^0-9a-z]+"))


def _literal(rules: list[tuple[int, Rule]], home: dict[int, str]) -> tuple[Column, int]:
    """Buckets of (token, rule) structs, as one constant array."""
    n = 1 << max(0, math.ceil(math.log2(max(1, len(rules)))))
    from zlib import crc32

    buckets: list[list[Column]] = [[] for _ in range(n)]
    for i, r in rules:
        buckets[crc32(home[i].encode()) % n].append(
            F.struct(F.lit(home[i]).alias("token"), F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))
        )
    none = F.lit(None).cast("array<struct<token:string,size:int,rule:string,action:string,regex:string>>")
    return F.array(*(F.array(*b) if b else none for b in buckets)), n


def rarest_tokens(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[int, str]:
    """For each rule its literal token that fewest rows hold (then the first by name); counts are over the whole table."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = parts(F.col(url))
    counts: dict[str, int] = {}
    if wanted:
        held = pages.select(F.explode(F.array_intersect(tokens_of(F.concat(host, path)), F.array(*map(F.lit, wanted)))).alias("token"))
        counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most one row a rule token
    return {i: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for i, r in enumerate(rules)}


def filter_urls(pages: DataFrame, rules: list[Rule], method_rules: list[Rule] = (), url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the longest of ``rules`` that fits, else null) and verdict.

    Where no rule fits, the verdict is that of the longest fitting one of ``method_rules``, else ``default``.
    """
    every = [*rules, *method_rules]
    home = rarest_tokens(pages, every, url)
    host, path = parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    address = F.concat(F.col("host"), F.col("path"))
    tokens = tokens_of(address)

    def best(which: list[tuple[int, Rule]]) -> Column:
        found = []
        for k in range(0, len(which), RULES_A_PASS):
            index, n = _literal(which[k : k + RULES_A_PASS], home)
            # rules without a whole literal token are filed under "", which every url looks up
            looked = F.transform(F.array_union(tokens, F.array(F.lit(""))), lambda t: F.filter(F.coalesce(F.get(index, F.pmod(F.crc32(F.encode(t, "utf-8")), F.lit(n)).cast("int")), F.array().cast("array<struct<token:string,size:int,rule:string,action:string,regex:string>>")), lambda r: r["token"] == t))
            fits = F.filter(F.flatten(looked), lambda r: F.rlike(address, r["regex"]))
            found.append(F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["action"].alias("action")))))
        return found[0] if len(found) == 1 else F.greatest(*found)

    stated, own = list(enumerate(rules)), list(enumerate(every))[len(rules) :]
    out = out.withColumn("_hit", best(stated) if stated else F.lit(None).cast("struct<size:int,rule:string,action:string>"))
    out = out.withColumn("_own", best(own) if own else F.lit(None).cast("struct<size:int,rule:string,action:string>"))
    return out.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce(F.col("_hit.action"), F.col("_own.action"), F.lit(default))}).drop("_hit", "_own")


#: The rules that the contract states (fixed values).
STATED = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
#: Words of hosts that sell, bet or track; domains that serve advertisements, trackers and link spam (fixed values).
SPAM_HOSTS = ("spam-farm.", "cheap-pills.", "adult-x.", "free-bets.", "ads-track.", "-pills.")
SPAM_LABELS = "casino poker roulette slots bingo sportsbet payday-loans quick-loan viagra cialis replica-watches free-ringtones warez keygen xxx adserver adservice clickbank popunder".split()
SPAM_DOMAINS = """doubleclick.net googlesyndication.com googleadservices.com adnxs.com adsrvr.org rubiconproject.com pubmatic.com openx.net criteo.com criteo.net taboola.com outbrain.com
scorecardresearch.com quantserve.com advertising.com adform.net smartadserver.com casalemedia.com contextweb.com indexww.com sharethrough.com spotxchange.com teads.tv bidswitch.net mathtag.com
moatads.com adsafeprotected.com doubleverify.com serving-sys.com flashtalking.com zedo.com popads.net popcash.net propellerads.com adcash.com exoclick.com juicyads.com trafficjunky.net trafficfactory.biz
revcontent.com mgid.com adblade.com zergnet.com chartbeat.com hotjar.com mouseflow.com crazyegg.com mixpanel.com amplitude.com bluekai.com demdex.net krxd.net exelator.com rlcdn.com tapad.com agkn.com
media.net yieldmo.com gumgum.com undertone.com tribalfusion.com conversantmedia.com buysellads.com carbonads.net adroll.com perfectaudience.com steelhousemedia.com simpli.fi turn.com rocketfuel.com
semasio.net weborama.fr adition.com yieldlab.net stroeerdigitalgroup.de ligatus.com plista.com emetriq.de meetrics.net ioam.de adspirit.de adscale.de affili.net zanox.com awin1.com tradedoubler.com""".split()
METHOD = [Rule(f"*{x}*", "block") for x in SPAM_HOSTS] + [Rule(f"*.{x}.*", "block") for x in SPAM_LABELS] + [Rule(f"{x}/", "block") for x in SPAM_DOMAINS]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, STATED, METHOD).select("page_id", "host", "path", "rule", "verdict")


_FREE = "|".join([*(x.replace(".", r"\.") for x in SPAM_HOSTS), *(rf"\.{x}\." for x in SPAM_LABELS)])
_DOMAINS = "|".join(x.replace(".", r"\.") for x in SPAM_DOMAINS)
OP6_SQL = r"""
WITH a AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, rhost, rpath, action)),
m AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM (
  SELECT b.*, r.rule, r.action FROM b LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host || path, '{free}', 's') OR regexp_matches(host || path, '^([^/]*\.)?({domains})/') THEN 'block' ELSE 'allow' END) AS verdict FROM m
""".replace("{free}", _FREE).replace("{domains}", _DOMAINS)
