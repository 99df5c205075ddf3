import random

import numpy as np

from candlewick.llm import ordinal


def made(draw, grade):
    words = [draw.choice("abcdefghijklmnop") * draw.randint(1, 5) for _ in range(60)]
    if grade == 0:
        words[draw.randrange(60)] = draw.choice(["idiot", "stupid"])
    if grade == 1:
        words = words[:5] * 6
    return " ".join(words)


def test_held_out_grades():
    draw = random.Random(2)
    grades = [draw.choice([0, 1, 2, 2, 2, 2]) for _ in range(1200)]
    rows = [np.array(ordinal.text_features(made(draw, g))) for g in grades]
    w, cuts = ordinal.fit(rows[:800], grades[:800])
    assert cuts == sorted(cuts)
    tails = [ordinal.chances(float(w[x].sum()), cuts)[1] >= 0.5 for x in rows[800:]]
    assert sum(t == (g == 2) for t, g in zip(tails, grades[800:], strict=True)) >= 0.95 * 400
    assert (ordinal.fit(rows[:800], grades[:800])[0] == w).all()


def test_rows(spark):
    draw = random.Random(3)
    rows = [(i, made(draw, [2, 2, 2, 1, 0][i % 5]), 1) for i in range(300)] + [(900, None, 1), (901, "", 1), (None, "a b", 1), (4, "x idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = [(i, int(i % 5 != 3), int(i % 5 == 4)) for i in range(250)] + [(None, 1, 0), (7, None, None), (8, 1, None), (99999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = ordinal.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    held = {r.doc_id: r.kept for r in got if r.doc_id is not None and 250 <= r.doc_id < 300}
    assert sum(k == (i % 5 < 3) for i, k in held.items()) >= 47
    assert all(r.kept and r.tail == 1 for r in ordinal.judge(docs, labels.limit(0)).collect())
    assert ordinal.judge(docs.limit(0), labels).count() == 0


def test_repeated_rows_of_a_rated_id_change_nothing(spark):
    draw = random.Random(5)
    rows = [(i, made(draw, [2, 2, 1, 0][i % 4])) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 != 2), int(i % 4 == 3)) for i in range(80)] * 2, "doc_id long, quality int, toxic int")
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    w, cuts = ordinal.train(docs(rows), labels)
    more = [*rows, *rows[:5] * 300]
    draw.shuffle(more)
    again = ordinal.train(docs(more).repartition(7), labels)
    assert (again[0] == w).all() and again[1] == cuts


def plain_fit(rows, grades, steps=4000, rate=0.5, ridge=1e-3):
    """Full likelihood by plain gradient steps on a dense table: no lasso, no sampling, no weights of grades."""
    names = sorted({int(k) for r in rows for k in r})
    at = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[int(k)] for k in r]] = 1
    y, w, cuts = np.array(grades), np.zeros(len(names)), np.array([-1.0, 0.0])
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    scale = np.sqrt((x * x).sum(axis=1).mean())
    for _ in range(steps):
        s = x @ w / scale
        above = np.stack([np.ones(len(y)), *(logistic(s - c) for c in cuts), np.zeros(len(y))])
        p = np.maximum(above[y, range(len(y))] - above[y + 1, range(len(y))], 1e-9)
        slope = above * (1 - above)
        up, down = slope[y, range(len(y))] / p, slope[y + 1, range(len(y))] / p
        w += rate * (x.T @ (up - down) / scale / len(y) - ridge * w)
        for k in (0, 1):
            cuts[k] += rate * (np.where(y == k, down, 0).sum() - np.where(y == k + 1, up, 0).sum()) / len(y)
    weight = np.zeros(1 << ordinal.BITS)
    weight[names] = w / scale
    return weight, cuts.tolist()


def likelihood(rows, grades, w, cuts):
    total = 0.0
    for r, g in zip(rows, grades, strict=True):
        above = [1.0, *ordinal.chances(float(w[r].sum()), cuts), 0.0]
        total += np.log(max(above[g] - above[g + 1], 1e-9))
    return total / len(rows)


def test_fit_beside_the_full_likelihood():
    draw = random.Random(8)
    grades = [draw.choice([0, 1, 2, 2, 2]) for _ in range(900)]
    rows = [np.array(ordinal.text_features(made(draw, g))) for g in grades]
    (w, cuts), (plain, plain_cuts) = ordinal.fit(rows[:600], grades[:600]), plain_fit(rows[:600], grades[:600])
    assert plain_cuts == sorted(plain_cuts)
    kept = lambda w, cuts: [ordinal.chances(float(w[r].sum()), cuts)[1] >= 0.5 for r in rows[600:]]
    same = sum(a == b for a, b in zip(kept(w, cuts), kept(plain, plain_cuts), strict=True))
    assert same >= 0.95 * 300
    # on held-out ratings as likely as the plain fit, or more, and far more than the grades' shares alone
    shares = [np.log(grades[:600].count(g) / 600) for g in grades[600:]]
    assert likelihood(rows[600:], grades[600:], w, cuts) >= likelihood(rows[600:], grades[600:], plain, plain_cuts) - 0.05
    assert likelihood(rows[600:], grades[600:], w, cuts) >= 0.5 * sum(shares) / 300


def test_query_scores_as_a_plain_sum(spark):
    """The whole table, scored by the definition with the fitted weights."""
    from tests.conftest import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    w, cuts = ordinal.train(docs, labels)
    want = []
    for r in docs.collect():
        s = sum(float(w[k]) for k in ordinal.text_features(r.text or ""))
        p = [1 / (1 + np.exp(-(s - c))) for c in cuts]
        want.append((r.doc_id, p[0] + p[1], p[1], p[1] >= 0.5))
    got = sorted(map(tuple, ordinal.op6_ordinal_quality(spark, SF).collect()))
    for g, x in zip(got, sorted(want), strict=True):
        assert g[0] == x[0] and g[3] == x[3] and abs(g[1] - x[1]) < 1e-9 and abs(g[2] - x[2]) < 1e-9
