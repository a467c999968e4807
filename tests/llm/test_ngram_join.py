import random

from treeloom.llm import ngram_join
from treeloom.llm.components import connected_components, star_contraction
from treeloom.llm.ngram_join import jaccard_components


def brute(rows, width=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    todo = True
    while todo:
        todo = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    todo = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_matches_all_pairs(docs, texts):
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs).collect()}
    assert got == brute(texts)


def test_other_width_and_threshold(docs, texts):
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs, 5, 80, 100).collect()}
    assert got == brute(texts, 5, 80, 100)


def test_chain_of_links(spark):
    # each differs from the next in a few words; the ends are not similar
    w = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(w)))
        for j in range(5):
            w[(k * 5 + j) % 200] = f"x{k}_{j}"
    rows += [(50, None), (51, "")]
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_nulls_and_repeated_rows(spark, nothing):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None)]
    got = sorted(jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=str)
    assert sorted((r[0], r[2]) for r in got if r[0] is not None) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert len(got) == 5
    assert jaccard_components(nothing).count() == 0


def by_row(rows, width=4, num=85, den=100):
    """Brute force over rows: those of one doc_id are linked, a null doc_id is a document of its own."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    low = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                same = rows[a][0] is not None and rows[a][0] == rows[b][0]
                if sets[a] and sets[b] and (same or den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])):
                    low[a] = low[b] = min(low[a], low[b])
    least = lambda k: min((i for (i, _), c in zip(rows, low) if c == low[k] and i is not None), default=None)
    return sorted(((i, len(sets[k]), least(k) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def test_links_pass_through_repeated_and_null_ids(spark):
    w = [f"w{k}" for k in range(120)]
    at = lambda k: " ".join(w[3 * k :] + [f"y{j}" for j in range(3 * k)])  # noqa: E731  links with the next, not with the one after it
    x, c = " ".join(f"x{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    rows = [(1, x), (1, c), (8, c + " z"), (8, c + " z"), (20, at(0)), (None, at(1)), (21, at(2)), (None, "alone in the world of words"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id bigint, text string, key string").repartition(3)
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_components(docs).collect()), key=repr)
    assert got == by_row(rows)
    assert (8, 38, 1) in got


def test_long_lists(spark, monkeypatch):
    # near copies that resemble their base but not each other, and a ring of near copies without a base
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 90):
        w = list(base)
        for j in rng.sample(range(100), 2):
            w[j] = f"n{k}_{j}"
        rows.append((k, " ".join(w)))
    ring = [f"r{k}" for k in range(100)]
    for k in range(100, 190):
        w = list(ring)
        for j in (k - 100, (k - 99) % 90):
            w[j] = f"m{j}"
        rows.append((k, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(ngram_join, "FULL", 1)
    monkeypatch.setattr(ngram_join, "SALTED", 7)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_lists_no_longer_than_a_bucket(spark, monkeypatch):
    # pairs that cost more than FULL for each row, in lists that no round takes: rounds over them never ended
    rng = random.Random(5)
    rows = []
    for k in range(30):
        w = [f"s{j}" for j in range(100)]
        for j in rng.sample(range(100), 4):
            w[j] = f"n{k}_{j}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BUCKET", 64)
    rounds, sampled = [], ngram_join._sampled

    def counted(*args):
        rounds.append(len(rounds))
        assert len(rounds) < 5
        return sampled(*args)

    monkeypatch.setattr(ngram_join, "_sampled", counted)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_bitmaps_go_by_set_through_the_rounds(spark, monkeypatch):
    # rounds carried a bitmap for each (token, set) row, and wrote and joined all of these rows again in every round
    rng = random.Random(7)
    rows = []
    for k in range(70):
        w = [f"s{j}" for j in range(80)]
        for j in rng.sample(range(80), 2):
            w[j] = f"n{k}_{j}"
        rows.append((k, " ".join(w)))
    wide, plain = [], ngram_join.stash

    def watched(df, tag, files=None):
        out = plain(df, tag, files)
        if "x0" in df.columns:
            wide.append((tag, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stash", watched)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute(rows)
    assert "long" in [tag for tag, _ in wide]
    assert all(n <= len(rows) for tag, n in wide if tag != "mixed")
    assert [tag for tag, _ in wide].count("mixed") == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (3, 9), (9, 20), (20, 21)]
    e = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    want = {1: 1, 2: 1, 3: 1, 9: 1, 20: 1, 21: 1, 10: 10, 11: 10, 12: 10}
    assert {r[0]: r[1] for r in connected_components(e).collect()} == want
    assert {r[0]: r[1] for r in star_contraction(e).collect()} == want
