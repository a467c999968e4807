"""Document scores by masked pseudo-likelihood: a bidirectional window network, trained in numpy over the corpus.

Words fall into ``CLASSES`` classes by hash.  The network predicts a masked word's class from the classes of two words
on either side: position-wise embeddings are added, squashed, and read out by a softmax.  The word itself is then
predicted within its class by its exact share of the corpus: a table with one count for each distinct word, which
grows with the input.  Counts of the ``HEAD`` most frequent words go to every task, so that words which all documents
share are no keys of a join; the others are joined back.  A document's score is the sum of the logs of both, over all its words, each
predicted from both sides.

Training gathers from the whole corpus.  In each round every task starts from the same network, goes once through the
masked positions of all its documents (one in ``ROUNDS``, by hash of the word and its place in the document: every
position is a target in exactly one of the rounds), and hands on its network; the mean, weighted by words, starts the
next round.  What is sent grows with the number of tasks; sums are streamed in two steps, so no task or driver holds
more than a few networks.  With the tasks' share of the data the means differ a little, so scores depend slightly on
how the input is split.

Nulls and empty texts have no words: n_words 0, log_likelihood 0, per_word null.  Every row gets a row, repeated and
null ids too; equal rows have equal scores.  A word that the model has not seen counts as seen once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import at_exit, maybe_broadcast, mix, prepare, row_slices, stash, tidy, utf8_buffer, word_hashes

CLASSES, HIDDEN, SIDE = 128, 24, 2
#: Distinct words a task counts before it hands them on; most frequent words whose counts every task has (16 bytes each).
COUNTED, HEAD = 200_000, 1 << 17
ROUNDS, STEP, SUMS = 2, 0.15, 16
#: Words in one step of training, words scored at once.
TRAINED, BATCH = 512, 512


class Network:
    """Embeddings of each context position (class CLASSES: beyond the text), softmax weights and biases."""

    def __init__(self, flat: np.ndarray | None = None):
        rng = np.random.default_rng(5)
        self.shapes = [(2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN, CLASSES), (CLASSES,)]
        if flat is None:
            flat = np.concatenate([(rng.standard_normal(np.prod(s)) * 0.1).ravel() for s in self.shapes])
            flat[-CLASSES:] = 0
        self.flat = flat.astype(np.float32).copy()
        parts, at = [], 0
        for s in self.shapes:
            parts.append(self.flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        self.embed, self.out, self.bias = parts
        self.seen = np.full_like(self.flat, 1e-2)

    def forward(self, context: np.ndarray):
        h = self.embed[0].take(context[0], 0)
        for k in range(1, len(context)):
            h += self.embed[k].take(context[k], 0)
        np.tanh(h, out=h)
        z = h @ self.out
        z += self.bias
        if z.max() > 60:  # else the sum of exponentials is safe as it is
            z -= z.max(1, keepdims=True)
        return h, z, np.log(np.exp(z).sum(1))

    def train(self, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        n = len(target)
        h, z, norm = self.forward(context)
        p = np.exp(z - norm[:, None])
        p[np.arange(n), target] -= 1
        p /= n
        grad = np.zeros_like(self.flat)
        at = int(np.prod(self.shapes[0]))
        grad[at : at + HIDDEN * CLASSES] = (h.T @ p).ravel()
        grad[-CLASSES:] = p.sum(0)
        back = (p @ self.out.T) * (1 - h * h)
        tables = grad[:at].reshape(self.shapes[0])
        for k in range(len(context)):
            order = np.argsort(context[k], kind="stable")
            c = context[k][order]
            starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            tables[k][c[starts]] = np.add.reduceat(back[order], starts, axis=0)
        self.seen += grad * grad
        self.flat -= (STEP * grad / np.sqrt(self.seen)).astype(np.float32)


def _contexts(cls: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Classes of the neighbours of each word, CLASSES beyond its document."""
    out = np.full((2 * SIDE, len(cls)), CLASSES, np.int16)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        if len(cls) > abs(d):
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            same = rows[a] == rows[b]
            out[k, a] = np.where(same, cls[b], CLASSES)
    return out


def _words(column):
    """For slices of an Arrow text column: first row, rows, row of each word, class, hash, place in its document."""
    data, offsets = utf8_buffer(column)
    for i, j in row_slices(offsets):
        h, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts = np.searchsorted(rows, np.arange(j - i))
        yield i, j - i, rows, (h % np.uint64(CLASSES)).astype(np.int16), h, np.arange(len(h)) - starts[rows]


def masked(h: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    """Whether a word is a target in this round."""
    return mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ROUNDS) == turn


def _train(flat: np.ndarray, turn: int):
    def run(batches):
        net = Network(flat)
        words, held, size = 0, [], 0

        def step(least):
            nonlocal held, size
            if not held:
                return
            context, target = np.concatenate([c for c, _ in held], 1), np.concatenate([t for _, t in held])
            k = 0
            while len(target) - k >= least:
                net.train(context[:, k : k + TRAINED], target[k : k + TRAINED])
                k += TRAINED
            held, size = ([(context[:, k:], target[k:])], len(target) - k) if k < len(target) else ([], 0)

        for batch in batches:
            for _, _, rows, cls, h, place in _words(batch.column(0)):
                if not len(cls):
                    continue
                words += len(cls)
                which = np.flatnonzero(masked(h, place, turn))
                held.append((_contexts(cls, rows)[:, which], cls[which].astype(np.int64)))
                size += len(which)
                if size >= 16 * TRAINED:
                    step(TRAINED)
        step(1)
        if words:
            yield _state(words, net.flat.astype(np.float64) * words)

    return run


_STATE = "words long, net binary"


def _state(words, flat):
    return pa.RecordBatch.from_pydict({"words": [int(words)], "net": [np.asarray(flat, np.float64).tobytes()]}, schema=pa.schema([("words", pa.int64()), ("net", pa.binary())]))


def _add(batches):
    """Streams the sum of states."""
    words, flat = 0, 0.0
    for batch in batches:
        for w, f in zip(*(batch.column(k).to_pylist() for k in range(2))):
            words, flat = words + w, flat + np.frombuffer(f)
    if words:
        yield _state(words, flat)


def _count(batches):
    """(word, count), summed over a task's blocks."""
    held, total = [], 0

    def summed():
        words, counts = np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held])
        words, at = np.unique(words, return_inverse=True)
        return words, np.bincount(at, counts).astype(np.int64)

    batch_of = lambda w, c: pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["word", "count"])
    for batch in batches:
        for _, _, _, _, h, _ in _words(batch.column(0)):
            words, counts = np.unique(h, return_counts=True)
            held.append((words, counts))
            total += len(words)
            if total >= COUNTED:
                held = [summed()]
                total = len(held[0][0])
                if total >= COUNTED // 2:
                    yield batch_of(*held[0])
                    held, total = [], 0
    if held:
        yield batch_of(*summed())


@dataclass
class Model:
    flat: np.ndarray  # the network
    vocabulary: DataFrame  # word (hash), count: a written stage
    classes: np.ndarray  # words of each class in the corpus
    head: tuple[np.ndarray, np.ndarray]  # the most frequent words, sorted, and the logs of their counts


def fit(docs: DataFrame) -> Model:
    """Network and word counts over all documents."""
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select("text")
    flat = Network().flat
    first = max(SUMS, math.isqrt(text.rdd.getNumPartitions()))
    for turn in range(ROUNDS):
        trained = text.mapInArrow(tidy(_train(flat, turn)), _STATE)
        if first > SUMS:
            trained = trained.repartition(first).mapInArrow(_add, _STATE)
        rows = trained.repartition(SUMS).mapInArrow(_add, _STATE).collect()  # SUMS rows of one network each
        words = sum(r["words"] for r in rows)
        if not words:
            break
        flat = (sum(np.frombuffer(r["net"]) for r in rows) / words).astype(np.float32)
    vocabulary = stash(text.mapInArrow(tidy(_count), "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "vocabulary")
    at_exit(spark, vocabulary._stash_path)
    classes = np.ones(CLASSES)
    for r in vocabulary.groupBy(F.col("word").bitwiseAND(F.lit(CLASSES - 1)).alias("c")).agg(F.sum("count").alias("n")).collect():  # CLASSES rows; a power of two, so low bits are the remainder
        classes[r["c"]] = r["n"]
    top = vocabulary.orderBy(F.desc("count"), "word").limit(HEAD).toArrow()  # HEAD rows at most
    words, counts = top.column("word").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(words)
    return Model(flat, vocabulary, classes, (words[order], np.log(np.maximum(counts[order], 1))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word); one row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.flat, np.log(model.classes), *model.head))  # of bounded size

    def run(batches):
        """For each document its rarer words; the first row carries what is known here: classes, frequent words."""
        weights, per_class, head_words, head_logs = shared.value
        net = Network(weights)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(2)
            text_hash = texts.to_numpy()
            for i, size, rows, cls, h, _ in _words(batch.column(1)):
                total, n, rare = np.zeros(size), np.bincount(rows, minlength=size), np.zeros(len(h), bool)
                if len(cls):
                    context = _contexts(cls, rows)
                    logs = -per_class[cls]
                    for k in range(0, len(cls), BATCH):
                        _, z, norm = net.forward(context[:, k : k + BATCH])
                        logs[k : k + BATCH] += z[np.arange(len(z)), cls[k : k + BATCH]] - norm
                    rare = np.ones(len(h), bool)
                    if len(head_words):
                        place = np.minimum(np.searchsorted(head_words, h), len(head_words) - 1)
                        rare = head_words[place] != h
                        logs += np.where(rare, 0.0, head_logs[place])
                    total = np.bincount(rows, logs, minlength=size)
                r, w = rows[rare], h[rare]
                order = np.lexsort((w, r))
                r, w = r[order], w[order]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])][: len(r)])
                alone = np.flatnonzero(np.bincount(r, minlength=size) == 0)  # their row has no word, and a key that is like no other's
                row = np.r_[r[new], alone]
                head = np.r_[True, row[1:] != row[:-1]][: len(row)]
                times = np.r_[np.diff(np.r_[new, len(r)]), np.zeros(len(alone), np.int64)]
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([ids.take(at), texts.take(at), pa.array(np.r_[w[new].view(np.int64), text_hash[alone + i]]), pa.array(times), pa.array(np.where(head, total[row], 0.0)), pa.array(np.where(head, n[row], 0)), pa.array(head.astype(np.int64))], names=["doc_id", "text_hash", "word", "times", "classes", "n_words", "rows"])

    schema = "doc_id long, text_hash long, word long, times long, classes double, n_words long, rows long"
    parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(run), schema)
    counted = parts.join(maybe_broadcast(model.vocabulary), "word", "left")
    within = F.when(F.col("times") > 0, F.col("times") * F.log(F.coalesce("count", F.lit(1)))).otherwise(0.0)
    each = counted.groupBy("doc_id", "text_hash").agg(F.sum("rows").alias("rows"), F.sum("n_words").alias("n"), F.sum(F.col("classes") + within).alias("total"))
    n = (F.col("n") / F.col("rows")).cast("long")
    # equal rows were summed together: their mean, once for each
    whole = each.select("doc_id", n.alias("n_words"), (F.col("total") / F.col("rows")).alias("log_likelihood"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    return whole.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))
