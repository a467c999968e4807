import random
import zlib

from treeloom.llm.toxicity import Grammar, fit, labelled_sample, score_documents


def corpus(n=600):
    rng = random.Random(9)
    plain = "the house near river stands and wind moves over grey hills while people walk home slowly".split()
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grobbing", "grobber", "snarfle"]))
        rows.append((k, " ".join(w) + "."))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_documents(docs, fit(docs, lab)).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k] >= 0.5) == bool(y) for k, y in labels if k in held)
    assert right >= 0.95 * len(held)
    assert not [r for r in labelled_sample(docs, lab).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]


def test_capped_classes_keep_their_ratio(spark):
    # all 100 toxic and 220 of 900 other documents hold the word: less than half of those with it are toxic
    rows = [(k, f"plain words stand here, you {'idiot' if k % 10 == 0 or k % 4 == 1 else 'friend'}.") for k in range(1000)]
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k, int(k % 10 == 0)) for k, _ in rows], "doc_id bigint, toxic int")
    whole, capped = (fit(docs, lab, most).score("plain words stand here, you idiot.") for most in (8000, 60))
    assert whole < 0.5 and capped < 0.5 and abs(whole - capped) < 0.15


def test_grammar():
    g = Grammar({"idiot$": 1.0}, [-3, 2, -1, -1, 1, 2, -1, 1, 1, 0, 0])
    plain, negated, reported, threat = map(g.score, ("you idiot.", "this is not an idiot.", "she said idiot things.", "i will kill you."))
    assert plain > 0.5 > negated and plain > reported and threat > g.score("i will walk.")
    assert g.score(None) == g.score("") == g.score("nothing here")


def test_edges(spark, nothing):
    lab = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert score_documents(nothing, fit(nothing, lab)).count() == 0
    d = spark.createDataFrame([(None, "you idiot."), (1, None), (1, "fine")], "doc_id bigint, text string")
    got = score_documents(d, fit(d, lab)).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)


def test_composition_against_the_transducers_one_by_one():
    """Every transducer runs alone over the stream; outputs follow from the states before each symbol."""
    import random

    from treeloom.llm import toxicity as tx

    rng = random.Random(8)
    for _ in range(500):
        stream = [rng.choice(tx.SYMBOLS) for _ in range(rng.randint(1, 25))]
        alone = dict.fromkeys(tx.TRANSDUCERS, 0)
        state = tx.START
        for s in stream:
            want = []
            if s == "T" and alone["threat"]:
                want.append(("threat_negated", 0.3) if alone["negation"] else ("threat", 1.0))
            if s == "T" and alone["insult"]:
                want.append(("targeted", 1.0))
            if s == "H" and alone["target"]:
                want.append(("threat_negated", 0.3) if alone["negation"] else ("threat", 1.0))
            if s == "I":
                want.append(("negated", 0.3) if alone["negation"] else ("reported", 0.3) if alone["reported"] else ("insult", 1.0))
                if alone["target"]:
                    want.append(("targeted", 1.0))
            state, out = tx.PRODUCT[state, s]
            assert sorted(out) == sorted(want)
            near = alone["target"]
            for k, table in tx.TRANSDUCERS.items():
                alone[k] = table[alone[k]].get(s, alone[k])
            if s == "I" and near:
                alone["insult"] = 0
            assert state == tuple(alone.values())


def test_a_column_called_score(spark):
    from treeloom.llm.toxicity import Grammar, score_documents

    d = spark.createDataFrame([(1, "you idiot", 7.0), (1, "you idiot", 8.0), (None, None, 9.0)], "doc_id bigint, text string, score double")
    rows = score_documents(d, Grammar({"idiot$": 1.0}), "toxicity").collect()
    assert sorted(r["score"] for r in rows) == [7.0, 8.0, 9.0] and all(0 <= r["toxicity"] <= 1 for r in rows)
