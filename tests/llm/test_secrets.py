import re

from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import secrets

#: Rules of the base as plain patterns, with the check on what they match.
PLAIN = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
PIECES = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", " ", "=", ":", "==", '"', "'", "abc", "abcdef0123456789", "AKIA", "ABCDEFGHIJ0123456", "é", "\n", "-", "x" * 5, "0123456789abcdef01234567"]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m)]
    return sorted(found, key=lambda x: (x[0], list(PLAIN).index(x[1])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    data = text.encode()
    a = secrets.automaton(tuple(secrets.RULES))
    got = [(x["start"], x["kind"], x["end"]) for x in secrets.in_characters(data, a.spans(data), secrets.RULES) if x["kind"] in secrets.BASE]
    assert got == brute(text)


def test_a_dropped_match_keeps_its_text():
    a = secrets.automaton(tuple(secrets.RULES))
    assert a.spans(b"secret=token:abcdef") == []  # secret=token takes the keyword


def test_other_kinds_and_masks(spark):
    rows = [(1, "x ghp_" + "aZ" * 20 + " y", 9), (2, None, None), (3, "", 0), (4, "é password=hunter22 é", 21), (4, "é password=hunter22 é", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    got = {(r.doc.doc_id): [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(docs).collect()}
    assert got == {1: [("github", 2, 46)], 2: [], 3: [], 4: [("assign", 2, 19)]}
    out = secrets.stage(spark, docs, "").collect()
    assert sorted("-" if r.text is None else r.text for r in out) == sorted(["x [github] y", "-", "", "é [assign] é", "é [assign] é"])
    assert secrets.find_secrets(docs.limit(0)).count() == 0
