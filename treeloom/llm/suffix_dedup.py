"""Removal of repeated byte strings by suffix arrays over shards, each sorted by external induction.

``repeated_spans`` finds every byte covered by a string of ``size`` bytes (100) that also starts earlier, in a document
of smaller doc_id or earlier in the same one.  Matches lie within one document; strings are judged on the input.

1. *Units.*  Each window of 100 bytes has an anchor: its 36-byte substring of smallest hash, which depends on the
   window alone, so equal windows have equal anchors.  Successive windows with one anchor are a unit.  No byte of text
   moves: units go to the reducer of their anchor as hashes, without those that repeat within the map task's block.
2. *Candidates.*  A reducer sees all units of an anchor.  Units equal as a whole keep their first; the rest are repeats
   (pre-aggregation, so a passage that a third of the documents hold is one unit).  An anchor with one unit left has
   no other windows to share; units of the others go on to step 3, with their text.
3. *Suffix sorting.*  Units are dealt by anchor to shards.  Each shard writes its text to scratch disk and sorts it by
   external induced sorting with common-prefix values, in bounded memory.  Suffixes that share 100 bytes or more are
   neighbours; all but the first of a run are repeats.  An anchor with more than ``HOT`` units is split by 90-byte
   anchors into several before it is dealt.
4. The spans of a document are united and cut out.

Nulls and empty texts have no bytes, nothing is removed.  Every row has a key of its own: its doc_id if no doc_id
repeats, else its place in the order of (doc_id, text), so rows of a repeated doc_id are judged in the order of their
text, and of equal rows one keeps its bytes; a null doc_id sorts before all others.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import _BYTE, _powers, at_exit, bucket_count, discard, mix, prepare, release, row_slices, stash, text_size, tidy, utf8_buffer, write_rows
from treeloom.llm.induced_sort import sort_suffixes

GRAM, FINE_GRAM = 36, 90
#: Distinct units of one anchor from which it is split.
HOT = 3000
#: Units of one map block; text of one shard.
BLOCK_UNITS = 200_000
SHARD_BYTES = 1 << 20
#: Bytes hashed at once by a map task.
SLICE_BYTES = 1 << 18


class Hashed:
    """Prefix hashes of a byte buffer: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def units(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """(row, first window, windows, anchor hash, unit hash) of all units of a batch; windows counted from the row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = Hashed(data)
    g = np.arange(n - gram + 1)
    grams = hashed.of(g, g + gram)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    value = (grams >> bits << bits) | g.astype(np.uint64)
    width, have = size - gram + 1, 1
    low = value
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a, r = anchor[p], row[p]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    first, last = p[new], p[np.r_[new[1:] - 1, len(p) - 1]]
    return row[first], first - offsets[row[first]], last - first + 1, grams[a[new]], hashed.of(first, last + size)


_BLOCK = np.dtype([("anchor", "<u8"), ("unit", "<u8"), ("row", "<u2"), ("start", "<u4"), ("count", "u1")])
_FOUND = "__row long, start int, stop int, anchor long, hot boolean, repeat boolean"
_LOCAL = np.dtype([("row", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def _pack(parts: int, size: int):
    """Map side: blocks of units cut by anchor; what repeats within the block is known to be a repeat at once."""

    def run(batches):
        keys, blocks, held = [], [], 0

        def flush():
            nonlocal keys, blocks, held
            ids = np.concatenate(keys)
            u = np.concatenate(blocks)
            order = np.lexsort((u["start"], ids[u["row"]], u["unit"], u["anchor"]))
            u = u[order]
            again = np.r_[False, (u["anchor"][1:] == u["anchor"][:-1]) & (u["unit"][1:] == u["unit"][:-1])][: len(u)]
            local, u = _joined(ids, u[again], size), u[~again]
            part = (u["anchor"] >> np.uint64(20)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            u, part = u[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            share = np.array_split(local, parts)
            out = {"p": [], "docs": [], "units": [], "local": []}
            for q in range(parts):
                if cut[q + 1] > cut[q] or len(share[q]):
                    mine = u[cut[q] : cut[q + 1]]
                    used, mine["row"] = np.unique(mine["row"], return_inverse=True)
                    for k, v in (("p", q), ("docs", ids[used].tobytes()), ("units", mine.tobytes()), ("local", share[q].tobytes())):
                        out[k].append(v)
            keys, blocks, held = [], [], 0
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("p", pa.int32()), ("docs", pa.binary()), ("units", pa.binary()), ("local", pa.binary())]))

        rows = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = utf8_buffer(batch.column(1))
            for i, j in row_slices(offsets, SLICE_BYTES):
                for i2 in range(i, j, 30_000):
                    j2 = min(j, i2 + 30_000)
                    if keys and (held >= BLOCK_UNITS or rows + j2 - i2 > 65_000):
                        yield flush()
                        rows = 0
                    row, start, count, anchor, unit = units(data[offsets[i2] : offsets[j2]], offsets[i2 : j2 + 1] - offsets[i2], size, GRAM)
                    u = np.zeros(len(row), _BLOCK)
                    u["anchor"], u["unit"], u["row"], u["start"], u["count"] = anchor, unit, row + rows, start, count
                    blocks.append(u)
                    keys.append(ids[i2:j2])
                    rows += j2 - i2
                    held += len(u)
        if keys:
            yield flush()

    return run


def _joined(ids: np.ndarray, u: np.ndarray, size: int) -> np.ndarray:
    """Repeated units as spans, those of a row that overlap as one."""
    u = u[np.lexsort((u["start"], u["row"]))]
    stop = u["start"].astype(np.int64) + u["count"] - 1 + size
    new = np.flatnonzero(np.r_[True, (u["row"][1:] != u["row"][:-1]) | (u["start"][1:] > stop[:-1])][: len(u)])
    out = np.zeros(len(new), _LOCAL)
    if len(new):
        out["row"], out["start"], out["stop"] = ids[u["row"][new]], u["start"][new], stop[np.r_[new[1:] - 1, len(u) - 1]]  # units follow each other: stops rise
    return out


def _spans(row, start, stop, anchor=None, hot=None, repeat=True) -> pa.Table:
    n = len(row)
    return pa.table({"__row": pa.array(row, pa.int64()), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "anchor": pa.array(anchor, pa.int64()) if anchor is not None else pa.nulls(n, pa.int64()), "hot": pa.array(hot, pa.bool_()) if hot is not None else pa.array(np.zeros(n, bool)), "repeat": pa.array(np.full(n, repeat))})


def _match(size: int):
    """Reducer of an anchor range: whole units that repeat, and units that need their text compared."""

    def run(key, group):
        docs, us, local = [], [], []
        for d, u, s in zip(group.column("docs"), group.column("units"), group.column("local")):
            u = np.frombuffer(u.as_buffer(), _BLOCK)
            us.append(u)
            docs.append(np.frombuffer(d.as_buffer(), np.int64)[u["row"]])
            local.append(np.frombuffer(s.as_buffer(), _LOCAL))
        u, doc, spans = np.concatenate(us), np.concatenate(docs), np.concatenate(local)
        order = np.lexsort((u["start"], doc, u["unit"], u["anchor"]))
        u, doc = u[order], doc[order]
        same = u["anchor"][1:] == u["anchor"][:-1]
        again = np.r_[False, same & (u["unit"][1:] == u["unit"][:-1])][: len(u)]
        start, stop = u["start"].astype(np.int64), u["start"].astype(np.int64) + u["count"] - 1 + size
        out = [_spans(spans["row"], spans["start"], spans["stop"]), _spans(doc[again], start[again], stop[again])]
        first = ~again
        anchor, doc, start, stop = u["anchor"][first], doc[first], start[first], stop[first]
        if len(anchor):
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            many = np.repeat(np.diff(np.r_[cuts, len(anchor)]), np.diff(np.r_[cuts, len(anchor)]))
            go = many > 1
            out.append(_spans(doc[go], start[go], stop[go], anchor[go].view(np.int64), many[go] > HOT, False))
        return pa.concat_tables(out)

    return run


def _texts(size: int):
    """Text of the wanted units; those of hot anchors in finer units."""

    def run(batches):
        for batch in batches:
            out = {"shard_key": [], "__row": [], "start": [], "unit": []}
            for doc, text, wanted in zip(*(batch.column(k) for k in range(3))):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                doc = doc.as_py()
                for w in wanted.as_py():
                    a, b = w["start"], w["stop"]
                    if w["hot"]:
                        part = raw[a:b]
                        _, first, count, fine, _ = units(part, np.array([0, len(part)]), size, FINE_GRAM)
                        pieces = zip(fine.view(np.int64).tolist(), (a + first).tolist(), (a + first + count - 1 + size).tolist())
                    else:
                        pieces = ((w["anchor"], a, b),)
                    for k, x, y in pieces:
                        for name, v in (("shard_key", k), ("__row", doc), ("start", x), ("unit", raw[x:y].tobytes())):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard_key", pa.int64()), ("__row", pa.int64()), ("start", pa.int64()), ("unit", pa.binary())]))

    return run


def _sort_shard(size: int):
    """Sorts the suffixes of one shard on scratch disk and puts out the windows that start elsewhere earlier."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            begins, docs, starts, at = [], [], [], 0
            with open(f"{folder}/text", "wb") as out:
                for batch in batches:
                    for doc, start, unit in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                        # one symbol a byte, 1 to 256; 0 ends a unit
                        out.write(np.r_[np.frombuffer(unit, np.uint8).astype(np.uint16) + 1, np.uint16(0)].astype(np.uint16).tobytes())
                        begins.append(at)
                        docs.append(doc)
                        starts.append(start)
                        at += len(unit) + 1
            if not at:
                return
            text = np.memmap(f"{folder}/text", np.uint16, "r")
            begins, docs, starts = (np.array(x, np.int64) for x in (begins, docs, starts))
            ends = np.r_[begins[1:], at] - 1
            kept = None  # (document, place) of the first window of the run that is still open
            for suffixes, common in sort_suffixes(text, folder, size):
                u = np.searchsorted(begins, suffixes, "right") - 1
                whole = suffixes + size <= ends[u]
                doc, place = docs[u], starts[u] + suffixes - begins[u]
                cont = common >= size
                if kept is not None and cont[0] and whole[0]:
                    doc, place, whole, cont = np.r_[kept[0], doc], np.r_[kept[1], place], np.r_[True, whole], np.r_[False, cont]
                run_of = np.cumsum(~cont)
                doc, place, run_of = doc[whole], place[whole], run_of[whole]
                if not len(doc):
                    kept = None
                    continue
                order = np.lexsort((place, doc, run_of))
                doc, place, r = doc[order], place[order], run_of[order]
                first = np.r_[True, r[1:] != r[:-1]]
                # the open run's first goes on to the next block; a window equal to it is the same one in two units
                k = np.flatnonzero(first)[-1]
                kept = (doc[k], place[k]) if whole[-1] else None
                head = np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(r)]))
                repeat = ~first & ~((doc == doc[head]) & (place == place[head]))
                if repeat.any():
                    t = _spans(doc[repeat], place[repeat], place[repeat] + size)
                    yield from _merged(t).to_batches()
            del text

    return run


def _merged(t: pa.Table) -> pa.Table:
    """Overlapping spans of a document as one."""
    doc, start, stop = (t.column(k).to_numpy() for k in ("__row", "start", "stop"))
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])  # equal lengths: stops are sorted too
    return _spans(doc[new], start[new], stop[np.r_[new[1:] - 1, len(doc) - 1]])


def _key():
    """Key of a row whose doc_id no other row has."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two rows have one doc_id; null and the least long count as one, as both would have the same key."""
    return not docs.select(_key().alias("k")).groupBy("k").count().where("count > 1").isEmpty()


def keyed(docs: DataFrame, repeat: bool) -> DataFrame:
    """docs with __row, the key of the row: the same for the same rows, whatever their partitions.

    With repeated ids the rows are written once in the order of (doc_id, text).  Equal rows are interchangeable; they
    are dealt out by where they come from, so that many of them do not land in one task.
    """
    if not repeat:
        return docs.withColumn("__row", _key())
    order = docs.withColumn("__from", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first(F.col("doc_id").cast("long")), F.asc_nulls_first("text"), "__from").drop("__from")
    rows = stash(order.withColumn("__at", F.monotonically_increasing_id()), "rows")  # partition above bit 33, place below
    part = F.shiftright("__at", 33)
    first, at = [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        first.append((r["part"], at))
        at += r["count"]
    first = docs.sparkSession.createDataFrame(first, "__part long, __first long")
    out = rows.join(F.broadcast(first), part == F.col("__part")).withColumn("__row", F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__first")
    out._stash_path = rows._stash_path
    return out


def row_table(docs: DataFrame) -> DataFrame:
    """docs with the column __row, written once in buckets of it: the only time that whole texts are shuffled."""
    prepare(docs.sparkSession)
    rows = keyed(docs, ids_repeat(docs))
    out = write_rows(rows, "__row", bucket_count(docs.sparkSession, text_size(docs)[0]), "texts")
    discard(rows)
    release(docs.sparkSession)
    return out


def repeated_spans(rows: DataFrame, size: int = 100) -> DataFrame:
    """(__row, start, stop) over ``row_table`` rows: byte spans to remove; they may overlap."""
    spark = rows.sparkSession
    prepare(spark)
    bytes_ = text_size(rows)[0]
    packed = rows.select("__row", "text").mapInArrow(tidy(_pack(max(64, bytes_ >> 24), size)), "p int, docs binary, units binary, local binary")
    found = stash(packed.groupBy("p").applyInArrow(_match(size), _FOUND), "units")
    del packed
    release(spark)
    open_ = found.where("not repeat")
    n = open_.count()
    pieces = rows.select("__row", "text").join(_of_row(open_, bytes_, "start", "stop", "anchor", "hot"), "__row").select("__row", "text", "__list").mapInArrow(tidy(_texts(size)), "shard_key long, __row long, start long, unit binary")
    shards = max(24, n * 160 // SHARD_BYTES)
    spans = pieces.repartition(shards, "shard_key").mapInArrow(tidy(_sort_shard(size)), _FOUND)
    spans = stash(spans.where("repeat").select("__row", "start", "stop"), "sorted")
    del pieces, open_
    release(spark)
    at_exit(spark, found._stash_path)
    at_exit(spark, spans._stash_path)
    return found.where("repeat").select("__row", "start", "stop").unionByName(spans)


def _of_row(spans: DataFrame, bytes_: int, *columns: str) -> DataFrame:
    """The spans of each row as a list, dealt out as ``row_table`` is; a list is bounded by its text."""
    dealt = spans.repartition(bucket_count(spans.sparkSession, bytes_), "__row")
    return dealt.groupBy("__row").agg(F.collect_list(F.struct(*columns)).alias("__list")).hint("shuffle_hash")


def _cut(names: list[str]):
    """Unites a document's spans and cuts them out."""

    def run(batches):
        for batch in batches:
            n_bytes, removed, spans, kept, had = [], [], [], [], []
            for text, where in zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n_bytes.append(len(raw))
                had.append(text.is_valid)
                pieces, at, gone, runs, reach = [], 0, 0, 0, -1
                for a, b in sorted((w["start"], w["stop"]) for w in where or ()):
                    if a > reach:
                        runs += 1
                        pieces.append(raw[at:a])
                        gone += b - a
                    elif b > reach:
                        gone += b - reach
                    reach = max(reach, b)
                    at = max(at, b)
                pieces.append(raw[at:])
                removed.append(gone)
                spans.append(runs)
                kept.append(b"".join(pieces))
            cols = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(had, pa.bool_())], names=[*names, "__n_bytes", "__n_removed", "__n_spans", "__kept", "__text", "__had_text"])

    return run


def cut_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows without __row and text, with __n_bytes, __n_removed, __n_spans, __kept (the bytes that stay), __text (their whole characters), __had_text."""
    fields = [f for f in rows.schema if f.name not in ("text", "__row")]
    names = [f.name for f in fields]
    both = rows.join(_of_row(spans, text_size(rows)[0], "start", "stop"), "__row", "left").select(*(F.col(f"`{k}`") for k in names), "text", "__list")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "__n_bytes long, __n_removed long, __n_spans long, __kept binary, __text string, __had_text boolean"])
    return both.mapInArrow(tidy(_cut(names)), schema)


def cut_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """``cut_spans`` of all strings of ``size`` bytes that docs (doc_id, text, ...) repeat."""
    rows = row_table(docs)
    return cut_spans(rows, repeated_spans(rows, size))
