"""Similarity self-join on word n-grams: multiple-global-order filtering, exact links, connected components.

``jaccard_components`` finds the groups of documents linked by a Jaccard similarity of their distinct word n-grams
of at least num/den.  What it does with all rows:

1. *Equal sets collapse.*  Each set has a 64-bit signature; one row per signature goes on with its text.
2. *Repeated-token filter* (exact).  A document with a partner shares ceil(t*n) tokens with it, so that many of
   its tokens must occur in two different sets.  Token postings go, packed and cut by hash range, to reducers that
   count in how many sets a token lies; a document keeps its number of repeated tokens and nothing else comes back.
3. *Global orders.*  For the rest, tokens are ordered by (document frequency, hash), by (document frequency bucket,
   another hash) and by a third hash alone.  Under every order two linked sets share a token of their prefixes of
   n - ceil(t*n) + 1 tokens.  Lists of the first order make candidates; those that share no prefix token under the
   other two orders are dropped before any set is read.
   A further exact filter stands in the join itself: each set has a bitmap in which every token flips one of ``BITS``
   bits; two bitmaps differ in no more bits than the sets differ in tokens, and links bound that number.
4. *Groups contract, then lists are joined.*  Rounds go over the sets, one row each: a set's key is the least hash of
   its third order's prefix tokens (another hash in every round), which near copies mostly share.  In a group of one key
   every set is compared with the sets of a random bucket, and with the set of most links (near copies of one base all
   link to it).  Linked sets are one component.  Rounds go on while they link enough, groups are longer than a bucket and
   cost more than a few comparisons a set.  Then every list (all sets with one prefix token) is joined in full, but for
   the pairs within a component: each set outside its list's largest component against all others.  No link between
   components is lost, whatever the rounds have found.

Nulls and empty texts have no set: n_shingles 0, a component of their own.  A doc_id on several rows is one document:
those of its rows that have a set have one component, whatever their texts.  A row without doc_id is a document of its own, links pass through
it, and its component_id is the smallest doc_id it reaches, null if there is none.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import at_exit, discard, file_count, maybe_broadcast, mix, prepare, release, row_slices, stash, text_size, tidy, utf8_buffer, word_hashes
from treeloom.llm.components import connected_components

#: Tokens gathered before a map task hands a block on; bounds its memory.
BLOCK_TOKENS = 500_000
#: Bits of a set's parity bitmap.
BITS = 1024
WORDS = [f"x{k}" for k in range(BITS // 64)]
#: Sets of a bucket; comparisons for each set of the groups up to which lists are joined at once; links for each set of
#: the long groups that a round must find to be worth another one.
BUCKET, FULL, WORTH = 16, 4, 0.02
#: Sets of a list that one key of the full join stands for.
SALTED = 2048


def _need(n, num, den):
    """Tokens that two linked sets share at least, one of them having n."""
    return -(-n * num // den)


def shingle_sets(column, width: int):
    """For each row of an Arrow text column: the sorted distinct hashes of its word n-grams."""
    data, offsets = utf8_buffer(column)
    odd = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    mult = [odd[k % 8] + np.uint64(2 * (k // 8)) for k in range(width)]
    for i, j in row_slices(offsets):
        h, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.bincount(rows, minlength=j - i)
        ends = np.cumsum(count)
        if len(h) >= width:
            m = len(h) - width + 1
            grams = np.zeros(m, np.uint64)
            for k in range(width):
                grams += mix(h[k : k + m] * mult[k])
            grams = mix(grams)
        for r in range(j - i):
            a, b = int(ends[r] - count[r]), int(ends[r])
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mix(short * mult[0] + h[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)


_POSTING = pa.schema([("p", pa.int32()), ("batch", pa.string()), ("tokens", pa.binary()), ("idx", pa.binary()), ("used", pa.binary()), ("sigs", pa.binary()), ("docs", pa.binary())])
_COUNTED = pa.schema([("batch", pa.string()), ("used", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
_PER_DOC = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("repeated", pa.int64())])
_DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("text", "<i8"), ("n", "<i4"), ("sig", "<i8"), ("set", "<u2")])


def _signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _emit_postings(width: int, parts: int):
    """Map side: blocks of postings, cut by hash range.  A posting: five bytes of token hash, number of its set.

    A range gets the signatures of the sets that have a token in it, and one of the ranges the block's documents.
    """

    def run(batches):
        docs, sigs, seen, tokens, held = [], [], {}, [], 0

        def flush():
            nonlocal docs, sigs, seen, tokens, held
            name = uuid.uuid4().hex
            header, sig = np.array(docs, _DOC).tobytes(), np.array(sigs, np.int64)
            rows = {k: [] for k in _POSTING.names}
            t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            x = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(a) for a in tokens])
            p = ((t >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(p, kind="stable")
            t, x, p = t[order], x[order], p[order]
            cut = np.searchsorted(p, np.arange(parts + 1))
            five = t.view(np.uint8).reshape(-1, 8)[:, :5]
            home = int(name[:6], 16) % parts
            for q in range(parts):
                a, b = cut[q], cut[q + 1]
                if b > a or q == home:
                    used, local = np.unique(x[a:b], return_inverse=True)
                    for k, v in zip(_POSTING.names, (q, name, five[a:b].tobytes(), local.astype(np.uint16).tobytes(), used.tobytes(), sig[used].tobytes(), header if q == home else None)):
                        rows[k].append(v)
            docs, sigs, seen, tokens, held = [], [], {}, [], 0
            return pa.RecordBatch.from_pydict(rows, schema=_POSTING)

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, s in zip(ids, hashes, shingle_sets(batch.column(1), width)):
                sig = _signature(s)
                if len(s) and sig not in seen:
                    seen[sig] = len(tokens)
                    sigs.append(sig)
                    tokens.append(s)
                    held += len(s)
                docs.append((doc or 0, doc is None, text, len(s), sig, seen.get(sig, 0)))
                if held >= BLOCK_TOKENS or len(tokens) >= 60_000 or len(docs) >= 100_000:
                    yield flush()
        if docs:
            yield flush()

    return run


def _count_repeated(key, group):
    """Reducer of one hash range: for each set of each block, how many of its tokens lie in two different sets."""
    column = lambda k, kind: [np.frombuffer(v.as_buffer(), kind) for v in group.column(k)]
    tokens, sigs, owner, spans, at = [], [], [], [], 0
    for five, x, s in zip(column("tokens", np.uint8), column("idx", np.uint16), column("sigs", np.int64)):
        t = np.zeros((len(five) // 5, 8), np.uint8)
        t[:, :5] = five.reshape(-1, 5)
        tokens.append(t.view(np.uint64).ravel())
        sigs.append(s[x])
        owner.append(x.astype(np.int32) + at)
        spans.append((at, at + len(s)))
        at += len(s)
    t, s, o = (np.concatenate(a) for a in (tokens, sigs, owner))
    counts = np.zeros(at, np.int64)
    if len(t):
        order = np.argsort(t, kind="stable")
        t, s, o = t[order], s[order], o[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        shared = np.minimum.reduceat(s, starts) != np.maximum.reduceat(s, starts)
        counts = np.bincount(o[np.repeat(shared, np.diff(np.r_[starts, len(t)]))], minlength=at)
    out = {k: [] for k in _COUNTED.names}
    for name, used, docs, (a, b) in zip(group.column("batch"), column("used", np.uint16), group.column("docs"), spans):
        some = counts[a:b] > 0
        if some.any() or docs.is_valid:
            for k, v in zip(_COUNTED.names, (name.as_py(), used[some].tobytes(), counts[a:b][some].astype(np.uint32).tobytes(), docs.as_py())):
                out[k].append(v)
    return pa.table(out, schema=_COUNTED)


def _per_document(key, group):
    """Adds up a block's counts over the hash ranges."""
    total, docs = np.zeros(1 << 16, np.int64), None
    for used, counts, header in zip(group.column("used"), group.column("counts"), group.column("docs")):
        total[np.frombuffer(used.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        if header.is_valid:
            docs = np.frombuffer(header.as_buffer(), _DOC)
    repeated = np.where(docs["n"] > 0, total[docs["set"]], 0)
    return pa.table({"doc_id": pa.array(docs["doc"], mask=docs["null"].astype(bool)), "text_hash": docs["text"].copy(), "n_shingles": docs["n"].astype(np.int64), "sig": docs["sig"].copy(), "repeated": repeated}, schema=_PER_DOC)


def _sets(width: int):
    schema_names = ("sig", "n", "tokens")

    def run(batches):
        for batch in batches:
            sig, n, tokens = [], [], []
            for g, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                sig.append(g)
                n.append(len(s))
                tokens.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=schema_names)

    return run


def _orders(num: int, den: int):
    """Prefixes of a set under the three global orders; only tokens that another set has."""
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64())), ("third", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            out = {k: [] for k in schema.names}
            all_tokens, all_df = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            cuts = batch.column(1).offsets.to_numpy()
            cuts = cuts - cuts[0]
            for k, sig in enumerate(batch.column(0).to_pylist()):
                t, df = all_tokens[cuts[k] : cuts[k + 1]], all_df[cuts[k] : cuts[k + 1]]
                u = t.view(np.uint64)
                size = len(t) - _need(len(t), num, den) + 1
                one = np.lexsort((u, df))[:size]
                two = np.lexsort((mix(u ^ np.uint64(0x5851F42D4C957F2D)), np.log2(df).astype(np.int64)))[:size]
                three = np.argsort(mix(u ^ np.uint64(0x14057B7EF767814F)))[:size]
                parity = np.bincount((mix(u ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                for name, v in zip(schema.names, (sig, len(t), *(t[x][df[x] > 1] for x in (one, two, three)), np.packbits(parity.astype(np.uint8)).view(np.int64))):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _linked(pairs: DataFrame, orders: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set signatures that are linked: first the filters of the other orders, then the sets."""
    side = lambda x: orders.select(F.col("sig").alias(x), F.col("second").alias("second_" + x), F.col("third").alias("third_" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    side = lambda x: sets.select(F.col("sig").alias(x), F.col("tokens").alias("tokens_" + x))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.join(side("a"), "a").join(side("b"), "b").where(shared * den >= (F.size("tokens_a") + F.size("tokens_b") - shared) * num).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    size, rows = text_size(docs)
    parts, files = max(64, size >> 24), file_count(rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    postings = docs.mapInArrow(tidy(_emit_postings(width, parts)), "p int, batch string, tokens binary, idx binary, used binary, sigs binary, docs binary")
    counted = postings.groupBy("p").applyInArrow(_count_repeated, "batch string, used binary, counts binary, docs binary")
    per_doc = stash(counted.groupBy("batch").applyInArrow(_per_document, "doc_id long, text_hash long, n_shingles long, sig long, repeated long"), "sets", files)
    at_exit(docs.sparkSession, per_doc._stash_path)
    del postings, counted
    release(docs.sparkSession)
    known = per_doc.where("n_shingles > 0")
    key = lambda df: df.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    reps = key(known).groupBy("sig").agg(F.min(F.struct("key", "text_hash")).alias("row"), F.max("n_shingles").alias("n"), F.max("repeated").alias("repeated"))
    alive = stash(reps.where(f"repeated * {den} >= n * {num}").select("row.key", "row.text_hash", "sig"), "alive", files)
    texts = key(docs).join(maybe_broadcast(alive), ["key", "text_hash"]).select("sig", "text")
    sets = stash(texts.mapInArrow(tidy(_sets(width)), "sig long, n int, tokens array<long>").dropDuplicates(["sig"]), "tokens", files)
    exploded = sets.select("sig", F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    with_df = exploded.join(df, "token", "left").groupBy("sig").agg(F.collect_list(F.struct("token", F.coalesce("df", F.lit(1)).alias("df"))).alias("s")).select("sig", F.col("s.token").alias("tokens"), F.col("s.df").alias("dfs"))
    orders = stash(with_df.mapInArrow(tidy(_orders(num, den)), "sig long, n int, first array<long>, second array<long>, third array<long>, parity array<long>"), "orders")
    discard(alive)
    del texts, exploded, df, with_df
    release(docs.sparkSession)
    # rows of one doc_id are one document
    one_id = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("b"), F.max("sig").alias("high")).where("b < high").select("doc_id", "b")
    same = stash(known.join(one_id, "doc_id").where("sig <> b").select(F.col("sig").alias("a"), "b").distinct(), "same", files)
    labels = _contract(orders, sets, same, num, den, files)
    reps = known.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    of_sig = reps.join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = of_sig.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_sig = stash(of_sig.join(smallest, "component").select("sig", "component_id"), "components", files)
    at_exit(docs.sparkSession, of_sig._stash_path)
    discard(sets, orders, labels, same)
    release(docs.sparkSession)
    found = known.join(of_sig, "sig", "left").select("doc_id", "n_shingles", "component_id")
    alone = per_doc.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def _contract(orders: DataFrame, sets: DataFrame, same: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """(sig, component) over ``same`` and the links among the sets of each list."""
    differ = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in WORDS)
    fits = f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num} and ({differ}) * {den + num} <= (n_a + n_b) * {den - num}"
    named = lambda df, x, *more: df.select(*more, F.col("sig").alias(x), F.col("component").alias("c_" + x), F.col("n").alias("n_" + x), *(F.col(w).alias(f"{w}_{x}") for w in WORDS))
    parts = [F.col("parity")[k].alias(w) for k, w in enumerate(WORDS)]
    in_component = lambda df, labels: df.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    links, labels, turn = [same], _labels(same), 0
    while True:
        key = F.array_min(F.transform("third", lambda t: F.xxhash64(t, F.lit(turn)))).alias("key")
        keyed = stash(in_component(orders.select("sig", "n", key, *parts).where("key is not null"), labels), "keyed", files)
        heads = _heads(keyed, "key", files)
        cost, rows, longest = heads.agg(F.sum(F.col("q") * F.col("m")), F.sum("m"), F.max("m")).first()
        if not rows or cost <= FULL * rows or longest <= BUCKET:
            discard(keyed, heads)
            break
        pairs, used = _sampled(keyed, heads, links, turn, named, fits)
        found = _checked(pairs, orders, sets, num, den, files)
        worth = found.count() >= WORTH * used.count()
        links.append(found)
        old, labels = labels, _labels(_all(links))
        discard(used, keyed, heads, old)
        turn += 1
        if not worth:
            break
    # bitmaps are joined by set to the lists of several components only
    lists = stash(in_component(orders.select("sig", "first"), labels).select("sig", "component", F.explode("first").alias("token")), "lists", files)
    heads = _heads(lists, "token", files)
    salts = F.ceil(F.col("m") / SALTED).cast("int").alias("salts")
    mixed = lists.join(heads.select("token", "largest", salts), "token")
    both = stash(mixed.join(orders.select("sig", "n", *parts), "sig"), "mixed", files)
    x = named(both.where("component <> largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "a", "token", "salt", "largest")
    y = named(both.withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int")), "b", "token", "salt")
    # a pair of two sets outside the largest component is met from both sides: once is enough
    pairs = x.join(y, ["token", "salt"]).where("c_a <> c_b and (a < b or c_b = largest)").where(fits).select("a", "b")
    links.append(_checked(pairs, orders, sets, num, den, files))
    old, labels = labels, _labels(_all(links))
    discard(lists, heads, both, old, *links[1:])
    out = labels.withColumnRenamed("node", "sig")
    out._stash_path = labels._stash_path
    return out


def _heads(rows: DataFrame, key: str, files: int) -> DataFrame:
    """Of each key with sets of several components: its m sets, the largest component, the q sets outside it."""
    heads = rows.groupBy(key, "component").agg(F.count("*").alias("k")).groupBy(key).agg(F.sum("k").alias("m"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return stash(heads.select(key, "m", F.col("top.component").alias("largest"), (F.col("m") - F.col("top.k")).alias("q")), "heads", files)


def _checked(pairs: DataFrame, orders: DataFrame, sets: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), written, each once."""
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", files)
    links = stash(_linked(pairs, orders, sets, num, den), "links", files)
    discard(pairs)
    return links


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _labels(edges: DataFrame) -> DataFrame:
    """(node, component), written."""
    found = connected_components(edges)
    out = stash(found, "labels")
    discard(found)
    return out


def _sampled(keyed: DataFrame, heads: DataFrame, links: list[DataFrame], turn: int, named, fits: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) of one round over the long groups, as many as they have sets times a constant; a stage they read."""
    rows = stash(keyed.join(heads.where(f"m > {BUCKET}").select("key", "m"), "key"), "long")
    buckets = F.ceil(F.col("m") / BUCKET).cast("long")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("sig", F.lit(turn)), buckets))
    pairs = named(dealt, "a", "key", "bucket").join(named(dealt, "b", "key", "bucket"), ["key", "bucket"]).where("a < b and c_a <> c_b").where(fits).select("a", "b")
    degree = _all(links).select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("degree"))
    hubs = rows.join(degree, "sig").groupBy("key").agg(F.max(F.struct("degree", "sig", "n", "component", *WORDS)).alias("hub")).select("key", "hub.*")
    to_hub = named(rows, "a", "key").join(named(hubs, "b", "key"), "key").where("c_a <> c_b").where(fits).select("a", "b")
    return pairs.unionByName(to_hub), rows
