import itertools
import random

import numpy as np
import pytest

from treeloom.llm import chat, masked_lm
from treeloom.llm.language import declared_language, fit_text, identify_languages, page_text
from treeloom.llm.licenses import TEMPLATES, scan_licenses


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the and with house of that this there".split(), "de": "und der die das nicht ein mit haus".split(), "fr": "le la les et est une maison avec".split()}
    make = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    docs = spark.createDataFrame([(k, make(l, 60), l) for k, l in enumerate("en de fr".split() * 20)], "doc_id bigint, text string, lang string")
    pages = [(k, f"http://h{l}.example.{'com' if l == 'en' else l}/x", f"<html lang='{l}'><script>und der</script><p>{make(l, 40)}</p></html>") for k, l in enumerate("en de fr".split() * 10)]
    # no text at all: the host and the suffix decide; nulls anywhere
    pages += [(100, "http://hde.example.de/y", ""), (101, "http://hfr.example.fr/z", None), (102, None, None), (None, "bad url", "<p>the and with that")]
    got = {r["page_id"]: r for r in identify_languages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), docs).collect()}
    assert len(got) == len(pages)
    assert all(got[k]["lang"] == l for k, l in enumerate("en de fr".split() * 10))
    assert got[100]["lang"] == "de" and got[101]["lang"] == "fr"
    assert all(0 < r["confidence"] <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.createDataFrame([(k, f"word{k} le la", f"l{k % 70:02d}", "x") for k in range(140)] + [(1, None, "de", "x"), (None, "text", None, "x")], "doc_id bigint, text string, lang string, host string")
    langs, table = fit_text(docs)
    assert len(langs) == 70 and table.shape[0] == 70
    no_docs, no_pages = spark.createDataFrame([], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "page_id bigint, url string, html string")
    assert identify_languages(no_pages, docs).count() == 0
    page = (1, "http://a.b/c", "<html lang=de>" + "<script " * 60_000 + "<" * 300_000)
    got = identify_languages(spark.createDataFrame([page, page, (None, None, None)], no_pages.schema), no_docs).collect()
    assert sorted((str(r["page_id"]), r["lang"]) for r in got) == [("1", "und"), ("1", "und"), ("None", "und")]
    # a tie of all evidence goes to the first language by name
    even = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], docs.select("doc_id", "text", "lang").schema)
    assert identify_languages(spark.createDataFrame([(1, None, None)], no_pages.schema), even).first()["lang"] == "a"


def test_visible_text():
    assert page_text("<p>a<style>x</STYLE >b<!-- <p> -->c<script>open").split() == ["a", "b", "c", "open"]
    assert page_text(None) == "" and page_text("a < b > c").split() == ["a", "c"]
    assert declared_language("<html class=x lang='DE'>") == "de" and declared_language("<meta http-equiv=content-language content=fr>") == "fr"
    assert declared_language("<html><html lang=de>") == declared_language(None) == "none"


def brute_cost(roles):
    """Cheapest repair by trying every sequence of moves."""
    best = float("inf")
    for way in itertools.product(range(64), repeat=len(roles)):
        state, cost = chat.START, 0.0
        for r, w in zip(roles, way):
            moves = chat.MOVES[chat._own(r)]
            if w >= len(moves) or moves[w][0] != state:
                break
            state, cost = moves[w][1], cost + moves[w][2]
        else:
            best = min(best, cost)
    return best


def test_repair_is_cheapest():
    for roles in (["assistant"], ["user", "user"], ["system", "system", "user"], ["bot", "assistant"], ["user", "system"]):
        assert chat.repair(roles)[0] == min(chat.matrix(roles)[chat.START]), roles
    for roles in (["assistant"], ["user", "user"], ["user", "system"]):
        assert chat.repair(roles)[0] == brute_cost(roles)


def test_chat_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "FAN", 3)
    monkeypatch.setattr(chat, "CHUNK", 2)
    rng = random.Random(2)
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yes <|im_end|>"), (2, 0, "assistant", "first"), (3, None, None, None), (None, 0, "user", "x"), (1, 0, "user", "hi")]
    rows += [(9, k, rng.choice(["user", "assistant", "system", "tool"]), f"t{k}") for k in range(60)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(out) == 66
    one = "".join(r["rendered"] for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["turn"]))
    assert one == "<|im_start|>user\nhi\nthere<|im_end|>\n<|im_start|>assistant\nyes <​|im_end|><|im_end|>\n"
    long = sorted((r for r in out if r["conv_id"] == 9), key=lambda r: r["turn"])
    price = {"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "insert": chat.INSERT}
    roles = [r[2] for r in sorted((r for r in rows if r[0] == 9), key=lambda r: r[1])]
    cost = sum(price[r["action"]] + (chat.RELABEL if r["action"] in ("merge", "insert") and r["role"] != o else 0) for r, o in zip(long, roles))
    assert cost == chat.repair(roles)[0]


def test_licenses(spark):
    t = TEMPLATES
    changed = t["isc"].replace("distribute", "share").replace("software", "program")
    rows = [(1, "x y. " + t["mit"] + " z"), (2, "intro\n" + changed + "\nend"), (3, "no license here, the license is not named"), (4, None), (5, ""), (6, t["apache-2.0"] + " and " + t["apache-2.0"]), (None, t["gpl-3.0"].upper())]
    got = [tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    found = {(r[0], r[1]) for r in got}
    assert {(1, "mit"), (2, "isc"), (6, "apache-2.0"), (None, "gpl-3.0")} <= found and not {3, 4, 5} & {r[0] for r in got}
    one = next(r for r in got if r[0] == 1)
    assert rows[0][1][one[3] : one[4]] == "Released under the MIT License" and one[2] == 1.0
    assert sum(r[0] == 6 and r[1] == "apache-2.0" for r in got) == 2
    assert 0.7 <= next(r[2] for r in got if r[:2] == (2, "isc")) < 1


def test_short_notice_in_any_words(spark):
    rows = [(k, f"word{k} before{k} All rights reserved. after{k} it{k}") for k in range(40)]
    got = sorted(tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [r[:2] for r in got] == [(k, "all-rights-reserved") for k in range(40)]
    assert all(rows[k][1][a:b] == "All rights reserved" for k, _, _, a, b in got)


def test_notices_close_together(spark):
    t = TEMPLATES
    stray = "permission notice shall be included in all copies or " + t["mit-grant"]
    rows = [(1, "\n".join([t["all-rights-reserved"]] * 9)), (2, "\n".join([t["mit"]] * 4)), (3, "Released under the MIT Licence.\n" + t["mit"] + " end"), (4, "under the MIT " + t["mit"]), (5, stray)]
    got = sorted(tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    text = dict(rows)
    of = lambda k, name: sorted((a, b, c) for i, n, c, a, b in got if (i, n) == (k, name))
    assert [text[1][a:b] for a, b, _ in of(1, "all-rights-reserved")] == ["All rights reserved"] * 9
    assert [text[2][a:b] for a, b, _ in of(2, "mit")] == [t["mit"][:-1]] * 4
    assert [(text[3][a:b], c) for a, b, c in of(3, "mit")] == [("Released under the MIT", 0.8), (t["mit"][:-1], 1.0)]
    assert [text[4][a:b] for a, b, _ in of(4, "mit")] == [t["mit"][:-1]]
    assert [(text[5][a:b], c) for a, b, c in of(5, "mit-grant")] == [(t["mit-grant"][:-1], 1.0)]


def test_every_position_is_trained(monkeypatch):
    import pyarrow as pa

    words, trained = 5000, []
    monkeypatch.setattr(masked_lm.Network, "train", lambda self, context, target: trained.append(len(target)))
    batch = pa.record_batch([pa.array([" ".join(f"w{k % 97}" for k in range(words // 10))] * 10)], names=["text"])
    for turn in range(masked_lm.ROUNDS):
        list(masked_lm._train(masked_lm.Network().flat, turn)([batch]))
    assert sum(trained) == words


def test_masked_lm(spark, nothing):
    rng = random.Random(4)
    chain = {f"w{k}": f"w{(k * 7 + 3) % 20}" for k in range(20)}
    rows = []
    for i in range(2000):
        w = [f"w{rng.randrange(20)}"]
        while len(w) < 60:
            w.append(chain[w[-1]])
        if i >= 1900:
            rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [(9000, None), (9001, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r for r in masked_lm.score(d, masked_lm.fit(d)).collect()}
    ordered = np.mean([got[k]["per_word"] for k in range(1900)])
    shuffled = np.mean([got[k]["per_word"] for k in range(1900, 2000)])
    assert ordered > shuffled + 0.2
    assert got[9000]["n_words"] == 0 and got[9000]["per_word"] is None and got[9001]["log_likelihood"] == 0
    assert masked_lm.score(nothing, masked_lm.fit(nothing)).count() == 0


@pytest.mark.parametrize("head", [1 << 17, 20, 1])
def test_masked_lm_scores_by_plain_sums(spark, monkeypatch, head):
    """Word by word: the network's class probability times the word's exact share of its class."""
    monkeypatch.setattr(masked_lm, "HEAD", head)
    import pyarrow as pa

    from treeloom.llm.common import utf8_buffer, word_hashes

    rng = random.Random(9)
    rows = [(k, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(1, 30)))) for k in range(40)]
    rows += [(1, rows[1][1]), (1, "another text of one id"), (None, rows[2][1]), (None, rows[2][1]), (None, None), (7, "")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, word string").repartition(3)
    model = masked_lm.fit(d)
    got = sorted(((r["doc_id"], r["n_words"], round(r["log_likelihood"], 6)) for r in masked_lm.score(d, model).collect()), key=repr)
    of = lambda t: word_hashes(*utf8_buffer(pa.array([t or ""])))[0].tolist()
    counts = {}
    for _, t in rows:
        for w in of(t):
            counts[w] = counts.get(w, 0) + 1
    assert {r["word"] % (1 << 64): r["count"] for r in model.vocabulary.collect()} == counts
    of_class = {}
    for w, n in counts.items():
        of_class[w % masked_lm.CLASSES] = of_class.get(w % masked_lm.CLASSES, 0) + n
    net, want = masked_lm.Network(model.flat), []
    for i, t in rows:
        words, total = of(t), 0.0
        c = [masked_lm.CLASSES] * masked_lm.SIDE + [w % masked_lm.CLASSES for w in words] + [masked_lm.CLASSES] * masked_lm.SIDE
        for k, w in enumerate(words):
            near = [c[k + masked_lm.SIDE + j] for j in (-2, -1, 1, 2)]
            z = np.tanh(sum(net.embed[j][x] for j, x in enumerate(near))) @ net.out + net.bias
            total += float(z[w % masked_lm.CLASSES] - np.log(np.exp(z).sum())) + np.log(counts[w] / of_class[w % masked_lm.CLASSES])
        want.append((i, len(words), total))
    want.sort(key=lambda r: repr((r[0], r[1], round(r[2], 6))))
    assert [(i, n) for i, n, _ in got] == [(i, n) for i, n, _ in want]
    assert np.allclose([x for _, _, x in got], [x for _, _, x in want], atol=1e-3)


def test_alignment_is_the_longest_in_the_band():
    """Against every table entry of a plain longest common subsequence, limited to the band."""
    from treeloom.llm.licenses import BAND, align

    rng = random.Random(6)
    for _ in range(300):
        template = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        words = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        d = rng.randint(-3, len(words))
        table = {}
        for i in range(len(template) + 1):
            for j in range(-1, len(words) + 1):
                if i == 0 or j <= 0:
                    table[i, j] = 0
                    continue
                best = max(table[i - 1, j], table[i, j - 1])
                if template[i - 1] == words[j - 1] and abs((j - 1) - (d + i - 1)) <= BAND:
                    best = max(best, table[i - 1, j - 1] + 1)
                table[i, j] = best
        matched, x, y = align(template, words, d)
        assert matched == max(table.values())
        if matched:
            assert 0 <= x <= y < len(words) and words[x] in template and words[y] in template


def test_planted_notices_are_found(spark):
    rng = random.Random(12)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    names = list(TEMPLATES)
    for k in range(300):
        name = names[k % len(names)]
        rows.append((k, f"{fill(rng.randint(0, 30))} {TEMPLATES[name]} {fill(rng.randint(0, 30))}"))
        want[k] = name
    rows += [(400, None), (401, ""), (402, fill(5000)), (403, TEMPLATES["mit"]), (403, TEMPLATES["mit"]), (None, TEMPLATES["isc"])]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, coverage double").repartition(3)
    got = scan_licenses(d).collect()
    found = {(r["doc_id"], r["template"]) for r in got}
    assert all((k, n) in found for k, n in want.items())
    assert not {400, 401, 402} & {r["doc_id"] for r in got} and sum(r["doc_id"] == 403 for r in got) == 2 and (None, "isc") in found
    assert scan_licenses(d.limit(0)).count() == 0


def test_chat_edges(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(none).count() == 0
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b <|im_end|>"), (1, None, None, None), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 3, "assistant", "y")]
    got = chat.format_conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk string")).collect()
    assert len(got) == 5 and sum(r["conv_id"] is None for r in got) == 2
    text = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] is None), key=lambda r: r["turn"]))
    assert text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb <\u200b|im_end|><|im_end|>\n"
