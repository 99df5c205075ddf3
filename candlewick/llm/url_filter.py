"""Operator 5, URL filters: host and path rules, and a logistic model for the urls that no rule fits.

Built-in functions only. The model is a logistic regression on hashed character trigrams of host and
path. It is fitted on the driver to a small labelled table of urls (its size is fixed by this file: lists of words and
a rule that makes hosts and paths of them; what surrounds the names is drawn alike for both labels, so that only the names
tell) and becomes a literal array of BUCKETS whole weights, so scoring is one expression in the scan's stage: nothing is
shuffled or joined.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits and the
model allows; repeated rows are judged alike; urls are judged whole, however long; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick.llm.common import LOWER, UPPER, table

BUCKETS = 8192
SCALE = 1000  # weights are whole numbers of 1/SCALE, so that sums are exact
EPOCHS, BIAS_RATE, DECAY, BALANCE = 300, 1.2, 1e-3, 1.5
#: (host, path, verdict); at most a few hundred, since they become one expression.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# Words of host names; WITH_GOOD and WITH_BAD are joined to them.
GOOD = """academy adoption adventure alphabet animals archive arsenal artmuseum astronomy bakery balance ballet banking baseball
basketball bettertogether bicycle biology bookshop botany bridges budapest budget cambridge carpentry cathedral
charity chemistry chess chicago cinema citycouncil classics clinic coffee college comedy compass concert cooking
council cricket culture cycling debate denmark dentist design dinner docs drawing dublin earth economics education
energy engineering essex explorer express fairtrade family farmersmarket fashion festival finance firefighters
firewall football forest foundation freedom freelance garden geography github glacier glasgow grammar handbook harvest
health helpdesk highschool hiking history hospital housing ideas insects institute insurance journal juniors justice
kitchen knitting language laptop laptops lawyers learning letters library linguistics literature london lyrics
magazine mail maps marathon markets mathematics meadow medicine melbourne memory meteo mining moneymuseum mountains
museum music nature neighbour networks newspaper notebook novels nursery nutrition observatory ocean opera orchard
orchestra painting pancakes parcel parliament pharmacology pharmacyschool philosophy photos physics pillars pilots
planets plants playground poetry pottery prague printing pumpkin python quantum quiltmakers radio railway rainfall
recipes recycling research rivers robotics rowing sailing science sculpture seminar sexology shakespeare shipping
sketches soccer software songs spaceflight spanish standards statistics stockholm students sussex swimming tennis
textiles theatre tracing trackandfield tracker trains translate transport travel tutorial university vegetables
village violin volcano volunteers voting weather wedding wikipages wildlife winchester windows winter wisconsin
woodwork writers zoology""".split()
WITH_GOOD = """daily north city house open our modern local green news guide forum review project society notes lab today old world""".split()
BAD = """casino poker slot bet jackpot roulette lottery gambling bingo blackjack wager viagra cialis pill pharmacy steroid
xanax tramadol adult xxx porn sex cam escort nude girl milf hookup dating ads adserver adclick popup banner tracking
pixel spam linkfarm seo backlink phishing login-verify account-update malware crack keygen warez torrent serial pirate
nulled payday loan debt credit-fix crypto bitcoin forex doubler airdrop profit diet weightloss slimming fatburn
replica fake-id watches essay prize giveaway survey coupon clickbait""".split()
WITH_BAD = "win bonus free best cheap online hot vip live club 24 777 deals buy cash money".split()
JOINED_GOOD, JOINED_BAD, JOINTS = 2, 6, ["{a}{b}", "{b}-{a}", "{a}-{b}", "{b}{a}", "{a}s-{b}"]
#: Names without a meaning: two to four of these consonants, each before a vowel.
CONSONANTS, VOWELS, INVENTED = "b d f g k l m n p r s t v z br st".split(), "aeiou", 150
#: What surrounds a name, drawn alike for both labels, so that it tells nothing.
FIRST, SECOND, ZONES = ["", "", "", "www.", "m.", "blog.", "shop.", "news."], ["", ".example"], "com net org info io co".split()
PLACES = ["", "/", "/index.html", "/{n}", "/a-{n}", "/2019/{n}", "/p/{n}.html", "/view/{n}/", "/en/{n}", "/es/{n}", "/fr/{n}.html", "/de/{n}/"]
URLS = 2  # of each name


def labelled() -> list[tuple[str, int, str]]:
    """(url, 1 for bad, group): urls of one group have a word in common, and are held out together."""
    names = []
    for words, joined, count, bad in ((GOOD, WITH_GOOD, JOINED_GOOD, 0), (BAD, WITH_BAD, JOINED_BAD, 1)):
        for i, a in enumerate(words):
            names += [] if bad else [(a, 0, a)]
            for j in range(count):
                b = joined[((5 if bad else 3) * i + 7 * j) % len(joined)]
                names.append((JOINTS[(i + j) % len(JOINTS)].format(a=a, b=b), bad, a))
    for k in range(INVENTED):
        name = "".join(CONSONANTS[(k * (3 + j) + 5 * j) % len(CONSONANTS)] + VOWELS[(k * (2 + j) + j * j) % len(VOWELS)] for j in range(2 + k % 3))
        names.append((name, 0, name))
    draw, out = random.Random(5), {}
    for name, bad, group in names:
        for _ in range(URLS):
            host = draw.choice(FIRST) + name + draw.choice(SECOND) + "." + draw.choice(ZONES)
            out.setdefault("https://" + host + draw.choice(PLACES).format(n=draw.randrange(10_000)), (bad, group))
    return [(u, *rest) for u, rest in out.items()]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the rules of this operator, for the labelled table."""
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def buckets(host: str, path: str) -> list[int]:
    """Hashed trigrams of host and path; :func:`_score` has the same in SQL functions."""
    codes = [ord(c) for c in f"^{host}${path}$"]
    return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def train(urls: list[str], bad: list[int]) -> tuple[list[int], int]:
    """Weights and bias of labelled urls, in whole units of 1/SCALE.

    Logistic regression on counts of trigrams, bad urls weighing BALANCE times the good ones as a whole, by accelerated
    gradient steps. Weights are sums of the urls' counts, so the steps are taken on one number a url.
    """
    x = np.zeros((len(urls), BUCKETS), dtype=np.float32)
    for row, u in zip(x, urls, strict=True):
        np.add.at(row, buckets(*split_url(u)), 1)
    alike = (x @ x.T).astype(float)
    y, n = np.array(bad, dtype=float), len(urls)
    weigh = np.where(y > 0, BALANCE * n / (2 * max(y.sum(), 1)), n / (2 * max(n - y.sum(), 1)))
    steep = alike.sum(axis=1).max() / 4 * weigh.max() + DECAY * n
    a, bias = np.zeros(n), 0.0
    ahead, bias_ahead = a, bias
    for k in range(EPOCHS):
        miss = weigh * (y - 1 / (1 + np.exp(-np.clip(alike @ ahead + bias_ahead, -30, 30))))
        a_new, bias_new = ahead + (miss - DECAY * n * ahead) / steep, bias_ahead + BIAS_RATE * miss.sum() / (n * weigh.max())
        ahead, bias_ahead = a_new + k / (k + 3) * (a_new - a), bias_new + k / (k + 3) * (bias_new - bias)
        a, bias = a_new, bias_new
    return [int(v) for v in np.rint(x.T @ a * SCALE)], int(np.rint(bias * SCALE))


@lru_cache
def model() -> tuple[list[int], int]:
    """Weights and bias from the whole labelled table."""
    rows = labelled()
    return train([u for u, *_ in rows], [b for _, b, _ in rows])


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    fit = none
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        here = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        fit = F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _score(host: Column, path: Column, weights: list[int], bias: int) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), ""), lambda c: F.ascii(c))

    def summed(c: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: (F.get(c, i) * 961 + F.get(c, i + 1) * 31 + F.get(c, i + 2)) % BUCKETS)
        known = F.lit(weights)
        return F.aggregate(grams, F.lit(bias).cast("long"), lambda acc, g: acc + F.coalesce(F.get(known, g), F.lit(0)))

    return F.element_at(F.transform(F.array(codes), summed), 1)


def judge(pages, rules=None, fitted: tuple[list[int], int] | None = None):
    """page_id, host, path, rule, verdict and the model's score (positive: block) for every row of pages.

    fitted: weights and bias of another labelled table, from :func:`train`.
    """
    weights, bias = fitted or model()
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("fit", rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules))
        .withColumn("score", F.when(F.concat("host", "path") == "", F.lit(0).cast("long")).otherwise(_score(F.col("host"), F.col("path"), weights, bias)))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
    )


def op5_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    weights, bias = model()
    at = "[" + ",".join(map(str, weights)) + "]"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True))
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (SELECT *, CASE {fits} END AS fit, list_transform(string_split('^' || host || '$' || path || '$', ''), lambda c: unicode(c)) AS c FROM hp),
    s AS (SELECT *, CASE WHEN host || path = '' THEN 0 ELSE {bias} + list_sum(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: ({at})[1 + (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % {BUCKETS}])) END AS score FROM f)
    SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, coalesce(split_part(fit, '|', 2), CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score::BIGINT AS score FROM s
    """
