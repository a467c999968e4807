import random
import re

from treeloom.llm.decontaminate import phrase_hits, proximity_hits

PAT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PAT.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            n = min(10, len(v))
            for s in range(max(1, len(v) - 9) if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs, texts):
    rng = random.Random(4)
    by = dict(texts)
    items = [(1, " ".join(by[300].split()[8:40])), (2, "one two three"), (3, "ONE, two; Three!"), (4, None), (5, "..."), (6, " ".join(by[5].split()[:9])), (7, "never seen words at all in any of these documents here now"), (17, " ".join(by[408].split()[100:140])), (8, " ".join(by[200].split()[3:15]))]
    items += [(9, " ".join(rng.choice(["ta", "li", "mo"]) for _ in range(12))), (2, "one two three")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in phrase_hits(docs.select("doc_id", "text"), b).collect()), key=str)
    assert got == brute(texts, items)


def test_edges(spark, nothing):
    b = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert phrase_hits(nothing, b).count() == 0
    d = spark.createDataFrame([(None, "x a b c y"), (2, "a b c"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in phrase_hits(d, b).collect()), key=str)
    assert got == sorted([(None, 5, 3), (2, 3, 3), (2, 2, 0), (3, 0, 0)], key=str)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert phrase_hits(d, empty).where("n_hit > 0").count() == 0


def test_long_items_and_clashing_columns(spark):
    long = [f"w{k % 700}x{k // 700}" for k in range(20_000)]
    rows = [(1, " ".join(long), "a", 1), (2, "start " + " ".join(long[5000:5050]) + " end", "b", 2), (3, " ".join(long[k] for k in range(0, 200, 2)), "c", 3), (None, " ".join(long[-12:]), "d", 4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, pos int")
    b = spark.createDataFrame([(5, " ".join(long), 1), (6, " ".join(long), 2)], "item_id bigint, text string, doc_id int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in phrase_hits(d, b).collect()}
    assert got == {1: (20_000, 20_000, ["5", "6"]), 2: (52, 50, ["5", "6"]), 3: (100, 0, []), None: (12, 12, ["5", "6"])}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "rare x x odd"), (2, "rare x x x x x x x x odd"), (3, "odd rare"), (4, "rare"), (4, "odd"), (None, "rare"), (None, "odd")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "rare odd")], "item_id bigint, text string")
    assert {r["doc_id"] for r in proximity_hits(d, b, 4).collect()} == {1, 3}


def test_no_python_in_the_plan(spark, docs):
    b = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = phrase_hits(docs.select("doc_id", "text"), b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
