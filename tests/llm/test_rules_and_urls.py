import random
import re
from collections import Counter

import pytest

from candlewick.llm import quality_rules as Q
from candlewick.llm import url_filter as U

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_and_host_verdicts(spark):
    good = " ".join(f"w{i}é" for i in range(60))
    texts = [None, "", " \n\t", "a b c a b c x", "# one\n# one\n \n\n# one", good, good + "\n" + good, "x " * 80, "a\x0bb c " * 30, "one two"]
    rows = [(i, t, "mixed", "k") for i, t in enumerate(texts)]
    rows += [(100 + i, "short", "bad", "k") for i in range(40)] + [(150, good, "bad", "k"), (151, good, None, "k"), (None, good, "fine", "k"), (5, good, "mixed", "k")]
    rows += [(200 + i, good, "fine", "k") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = Q.judge(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), *brute(t)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), *(r[m] for m in Q.MEASURES), r.base_failed) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[150] and kept[151] and kept[200] and kept[None]  # a host of failures takes its one good document along
    out = Q.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in got)
    assert Q.judge(docs.limit(0)).count() == 0


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(Q.F, "xxhash64", lambda *a: Q.F.lit(7).cast("long"))  # all collide
    texts = ["a b c d a b c e", "q w e r t y u", "a a a a", "x y z x y z x", "m n m n m n o p q o p q"]
    got = Q.measures(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")).collect()
    assert {r.doc.doc_id: r.n_repeat_words for r in got} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_prior():
    assert Q.beta_prior(0, None, None) == (1.0, 1.0)
    a, b = Q.beta_prior(3, 0.2, 0.01)
    assert a / (a + b) == pytest.approx(0.2) and a + b == pytest.approx(15)


def test_urls(spark):
    rows = [
        (1, "https://A.Example.ORG/es/1?x#y", "example.org/es/", "block"),
        (2, "http://example.org/en/19", "example.org/en/1", "block"),
        (3, "http://www.x.org/", "org/", "allow"),
        (4, "http://x.com/fr/1", "com/fr/", "allow"),
        (5, "http://casino-win.example.com/de/", "com/de/", "block"),
        (6, "http://www.free-casino-bets.example.net/en/7", None, "block"),
        (7, "http://library.example.net/en/7", None, "allow"),
        (8, None, None, "allow"),
        (9, "no scheme", None, "allow"),
        (10, "http://org?x", None, "allow"),
        (11, "http://notexample.com", None, "allow"),
        (1, "https://A.Example.ORG/es/1?x#y", "example.org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u, *_ in rows], "page_id long, url string, host int")
    got = U.judge(pages).collect()
    key = lambda r: (r[0], str(r[1]), r[2])
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got), key=key)[:9] == sorted(((i, r, v) for i, _, r, v in rows), key=key)[:9]
    for r in got:
        assert (r.host, r.path) == U.split_url(next(u for i, u, *_ in rows if i == r.page_id))
    assert U.judge(pages.limit(0)).count() == 0


# Urls of hosts that the labelled table has not.
UNSEEN = """https://m.thinand.example.net/en/7000 https://eron.example.net/en/55 http://www.orchard.example.net/en/trees
https://blog.ouritha.example.net/es/9 https://stand.example.net/de/81 https://thisha.example.com/en/4"""
UNSEEN_BAD = """https://mega-casino.example.net/en/3 http://www.spam-king.example.net/en/9 https://ads-net.example.net/en/31
https://cheap-bets.example.net/en/4 https://pills-online.example.net/es/8 https://m.adult-chat.example.com/en/2"""


def test_unseen_urls():
    w, b = U.model()
    score = lambda u: b + sum(w[i] for i in U.buckets(*U.split_url(u)))
    assert sum(score(u) <= 0 for u in UNSEEN.split()) + sum(score(u) > 0 for u in UNSEEN_BAD.split()) >= 9


def test_held_out_hosts():
    """Five folds: of names, and of words, whose names are then all unseen."""
    rows = U.labelled()
    assert len({u for u, *_ in rows}) == len(rows) > 400
    for held_by, least in ((lambda u, g: U.split_url(u)[0], 0.9), (lambda u, g: g, 0.72)):
        names = sorted({held_by(u, g) for u, _, g in rows})
        random.Random(1).shuffle(names)
        right = 0
        for k in range(5):
            out = set(names[k::5])
            w, b = U.train([u for u, _, g in rows if held_by(u, g) not in out], [y for u, y, g in rows if held_by(u, g) not in out])
            right += sum((b + sum(w[i] for i in U.buckets(*U.split_url(u))) > 0) == bool(y) for u, y, g in rows if held_by(u, g) in out)
        assert right >= least * len(rows), right


# Names that are in no list of the labelled table, written before any model had seen them.
FRESH_BAD = """megaspins-palace vegasnights99 texasholdem-room sportsbook-odds baccarat-vip cheaprx-store genericmeds-online
hgh-supplies kamagra-now valium-noscript hotwebcams-live sexdates-tonight naughty-singles xvideos-free striptease-club
clickads-network popunder-media trackpixel-cdn mailblast-leads rankbooster-links paypal-verify-login secure-bank-update
free-keygens crackedgames-download moviestorrents-hd quickloans-today bitcoin-doubler-pro forexsignals-vip lose-fat-quick
rolex-replicas-outlet"""
FRESH_GOOD = """gardeners-world physicsforums oldmaps-online bookclub-guide freesoftware-foundation openlibrary betterhomes
essays-in-history cashmere-knits livingmuseum winterhiking-notes slottedspoon-recipes campingtrails adoptapet payroll-help
scunthorpe-news middlesex-council cocktail-recipes analysis-lab therapists-directory debating-society adjustable-desks
porcelain-museum betony-herbs citizen-science hotsprings-park clubrunners-review nonprofit-law orchid-growers cartracker"""


def fresh():
    w, b = U.model()
    blocked = lambda name: b + sum(w[i] for i in U.buckets(*U.split_url(f"https://{name}.org/a/1"))) > 0
    return [x for x in FRESH_BAD.split() if not blocked(x)], [x for x in FRESH_GOOD.split() if blocked(x)]


def test_fresh_names():
    """What the model does on names of nobody's list: half of the bad ones at least, and most of the good ones."""
    missed, wrong = fresh()
    assert len(missed) <= 15 and len(wrong) <= 6
