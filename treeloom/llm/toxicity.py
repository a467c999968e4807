"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers (insult, threat, target, negation, reported speech) stand as tables with weighted arcs; ``compose``
builds their product, which reads the stream of word classes once and puts out what matched in a clause: plain,
negated, reported or targeted insults and threats.
A document's score is a logistic function of the matched clauses, never of isolated words alone.

Which words and word beginnings are insults is learned.  ``fit`` takes at most ``SAMPLE`` toxic and ``SAMPLE`` other
labelled rows in hash order (the documented bound; their texts are read whole), counts word beginnings in one half
of them and fits the grammar's weights on the other half, each row weighted by how many labelled rows of its class it
stands for, so that the classes weigh as in all labelled rows at any size.  Rows whose crc32(doc_id as text) mod 5 is 0 are never
used.  Scoring reads every row and every whole text; language, source, labels and ids are no inputs.

Null and empty texts match nothing and get the score of an unmatched document.  A null label is no label; a doc_id
labelled twice counts as toxic if any of its labels says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import discard, prepare, stash, tidy

#: Labelled rows of either class that the fit may see.
SAMPLE = 8000
#: Entries of the learned lexicon; evidence an entry needs (log lift times the root of its toxic documents).
LEXICON, EVIDENCE = 3000, 6.0

# Closed word classes of the grammar.
NEGATION = "not no never neither nor cannot isn aren wasn don didn doesn nicht kein keine keinen niemals nie ne pas jamais aucun aucune ni nunca jamás tampoco".split()
REPORT = "said says saying claimed claims wrote writes quoted quote called reported reports asked replied sagte sagt schrieb behauptete zitierte nannte disait écrit affirme répondit cité dijo dice escribió afirmó citó llamó".split()
TARGET = "you your yours yourself they them their he him she her people everyone du dich dir euch ihr sie tu toi vous ton votre ils elles tú usted ustedes ellos ellas vosotros".split()
THREAT = "kill hurt destroy beat punch shoot stab burn smash töten schlagen zerstören verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split()
INSULT_SEED = "idiot stupid moron loser scum trash pathetic worthless disgusting dumb".split()

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
#: Words between two class words from which they no longer stand together.
NEAR = 4


#: Symbols of the stream: clause end, gap, negation, reported speech, target, threat, insult.
SYMBOLS = "PXNRTHI"
#: The five transducers, each open (1) or not (0) after a symbol; symbols that a state does not name leave it as it is.
#: An insult is open only while no target stands near: it waits for one.
TRANSDUCERS = {
    "negation": {0: {"N": 1}, 1: {"P": 0, "X": 0}},
    "reported": {0: {"R": 1}, 1: {"P": 0}},
    "target": {0: {"T": 1}, 1: {"P": 0, "X": 0}},
    "threat": {0: {"H": 1}, 1: {"P": 0, "X": 0, "T": 0}},
    "insult": {0: {"I": 1}, 1: {"P": 0, "X": 0, "T": 0}},
}
#: What an arc of the composition puts out: symbol, states that the transducers are in before it, output, weight in the
#: score of its clause (matches that are negated or reported weigh less).
ARCS = (
    ("T", {"threat": 1, "negation": 0}, "threat", 1.0),
    ("T", {"threat": 1, "negation": 1}, "threat_negated", 0.3),
    ("T", {"insult": 1}, "targeted", 1.0),
    ("H", {"target": 1, "negation": 0}, "threat", 1.0),
    ("H", {"target": 1, "negation": 1}, "threat_negated", 0.3),
    ("I", {"negation": 1}, "negated", 0.3),
    ("I", {"negation": 0, "reported": 1}, "reported", 0.3),
    ("I", {"negation": 0, "reported": 0}, "insult", 1.0),
    ("I", {"target": 1}, "targeted", 1.0),
)
OUTPUTS = ("insult", "negated", "reported", "targeted", "threat", "threat_negated")
START = (0,) * len(TRANSDUCERS)


def compose() -> dict[tuple, tuple]:
    """(state of all five, symbol) -> (next state, ((output, weight), ...)), for every state that can be reached."""
    names, table, todo = list(TRANSDUCERS), {}, [START]
    while todo:
        state = todo.pop()
        if (state, "P") in table:
            continue
        now = dict(zip(names, state))
        for symbol in SYMBOLS:
            then = {k: TRANSDUCERS[k][now[k]].get(symbol, now[k]) for k in names}
            if symbol == "I" and now["target"]:
                then["insult"] = 0  # it has its target already
            out = tuple((output, weight) for s, given, output, weight in ARCS if s == symbol and all(now[k] == v for k, v in given.items()))
            table[state, symbol] = (tuple(then[k] for k in names), out)
            todo.append(table[state, symbol][0])
    return table


PRODUCT = compose()
FEATURES = ("bias", *OUTPUTS, "clauses", "strongest", "kinds", "density")


@dataclass
class Grammar:
    """What scoring needs: lexicon with weights, logistic weights, length range of its word beginnings."""

    lexicon: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    shortest: int = 3
    longest: int = 8

    def __post_init__(self):
        self.closed = {**dict.fromkeys(NEGATION, ("N", 0.0)), **dict.fromkeys(REPORT, ("R", 0.0)), **dict.fromkeys(TARGET, ("T", 0.0)), **dict.fromkeys(THREAT, ("H", 1.0)), **dict.fromkeys(".!?;:\n", ("P", 0.0))}
        self.known: dict = {}

    def classify(self, word: str):
        weight = self.lexicon.get(word + "$", 0.0)
        for k in range(self.shortest, min(self.longest, len(word)) + 1):
            weight = max(weight, self.lexicon.get(word[:k], 0.0))
        return ("I", weight) if weight else self.closed.get(word)

    def features(self, text: str | None) -> list[float] | None:
        """Sums over matched clauses, None if nothing matched."""
        tokens = TOKEN.findall((text or "").lower())
        known = self.known
        if len(known) > 100_000:
            known.clear()
        hits = []
        for i, w in enumerate(tokens):
            try:
                c = known[w]
            except KeyError:
                c = known[w] = self.classify(w)
            if c:
                hits.append((i, w, c))
        if not any(c[0] in "IH" for _, _, c in hits):
            return None
        total = dict.fromkeys(OUTPUTS, 0.0)
        state, last, clause, strongest, matched, kinds = START, -NEAR, 0.0, 0.0, 0, set()
        for i, w, (symbol, weight) in hits:
            symbols = ("X", symbol) if i - last > NEAR and symbol != "P" else (symbol,)
            for s in symbols:
                state, out = PRODUCT[state, s]
                for o, share in out:
                    gain = weight or 1.0
                    total[o] += gain
                    clause += share * gain
            if symbol == "I":
                kinds.add(w)
            if symbol == "P" and clause:
                strongest, matched, clause = max(strongest, clause), matched + 1, 0.0
            last = i
        if clause:
            strongest, matched = max(strongest, clause), matched + 1
        if not matched:
            return None
        return [1.0, *(math.log1p(total[o]) for o in OUTPUTS), math.log1p(matched), math.log1p(strongest), math.log1p(len(kinds)), math.log1p(100 * matched / max(1, len(tokens)))]

    def score(self, text: str | None) -> float:
        f = self.features(text) or [1.0] + [0.0] * (len(FEATURES) - 1)
        z = sum(a * b for a, b in zip(self.weights, f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _beginnings(batches):
    """Word beginnings of each sampled text, counted by label."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(TOKEN.findall((text or "").lower()))
            found = {w + "$" for w in words if w[0].isalpha()}
            for k in range(3, 9):
                found.update(w[:k] for w in words if len(w) >= k)
            (toxic if y else clean).update(found)
        if len(toxic) + len(clean) > 300_000:
            yield _counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    keys = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["part", "toxic", "clean"])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, weight, half): at most ``most`` rows of either class, in hash order of doc_id; none held out.

    weight: labels of the class for each that is chosen.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    total = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}  # two rows
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, total.get(y, 0) / most)))
    chosen = stash(pick(1).unionByName(pick(0)), "labelled")  # 2 * most rows: a proven bound
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.xxhash64("doc_id", F.lit(7)) % 2 == 0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Grammar:
    prepare(docs.sparkSession)
    rows = stash(labelled_sample(docs, labels, most), "sample")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    lexicon = dict.fromkeys((w + "$" for w in INSULT_SEED), 1.0)
    if n1 and n0:
        counts = rows.where("half").select("text", "toxic").mapInArrow(tidy(_beginnings), "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        least = max(3, n1 // 400)
        lift = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
        best = counts.where(F.col("toxic") >= least).withColumn("lift", lift).where(f"lift > 1.2 and lift * sqrt(toxic) >= {EVIDENCE}").orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "part").limit(LEXICON).collect()
        for r in sorted(best, key=lambda r: (len(r["part"]), r["part"])):
            part, weight = r["part"], min(1.0, r["lift"] / 4)
            shorter = max((lexicon.get(part[:k], 0.0) for k in range(3, len(part))), default=0.0)
            if weight > shorter + 0.1:
                lexicon[part] = max(weight, lexicon.get(part, 0.0))
    grammar = Grammar(lexicon)

    def features(batches):
        for batch in batches:
            f = [grammar.features(t) or [1.0] + [0.0] * (len(FEATURES) - 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1).cast(pa.int32()), batch.column(2)], names=["f", "y", "weight"])

    seen = rows.where("not half").select("text", "toxic", "weight").mapInArrow(features, "f array<double>, y int, weight double").collect()  # 2 * most rows of twelve numbers
    if seen:
        grammar.weights = _logistic(np.array([r["f"] for r in seen]), np.array([r["y"] for r in seen], float), np.array([r["weight"] for r in seen]))
    else:
        grammar.weights = [-3.0, 2.0, 0.5, 0.5, 1.0, 2.0, 0.5, 1.0, 1.0, 0.0, 0.0]
    discard(rows)
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Ridge logistic regression of weighted rows by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score_documents(docs: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """docs with one more column ``name``; one row for each row of docs."""

    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = pa.array([grammar.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    schema = type(docs.schema)(list(docs.schema.fields)).add(name, "double")
    prepare(docs.sparkSession)
    return docs.mapInArrow(tidy(run), schema)
