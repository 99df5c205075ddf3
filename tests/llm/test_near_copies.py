import random

import corpus_pipeline
from candlewick.llm import near_copies


def brute_kept(rows):
    """Smallest ids of the components of texts with a Jaccard similarity of at least 0.8 over five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    group = {}
    for r, (d, _) in zip(root, rows, strict=True):
        group.setdefault(r, []).append(d)
    return sorted(min(g) for g in group.values())


def made_rows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6)))
    line = [word() for _ in range(14)]
    ids = iter(draw.sample(range(10_000), 400))
    rows = []
    for g in range(14):
        base = [word() for _ in range(draw.choice([3, 8, 40, 90, 300]))]
        for _ in range(12):
            text = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 30)):
                text[draw.randrange(len(text))] = word()
            text = text[: len(text) - draw.choice([0, 0, len(text) // 8])]
            rows.append((next(ids), " ".join([*text, *line] if g % 3 == 0 else text)))
    return rows + [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "ONE "), (20_004, rows[0][1]), (rows[0][0], rows[0][1])]


def test_pipeline_stage_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 4)
    rows = made_rows()
    stage = corpus_pipeline.STAGES[1][1]
    got = sorted(r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    want = brute_kept(rows)
    assert got == want and 20 < len(want) < 150
