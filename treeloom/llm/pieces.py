"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes " " + text with spaces written as U+2581.  No piece of the vocabulary holds that mark after another
character, so texts fall apart into segments (spaces, then other characters) that are encoded once each.

For the segments that a task has not met before, as one batch:

1. the segments are joined to one text and the suffixes of that text are sorted (first sixteen characters, the
   longest piece);
2. every piece is searched in the suffix array; its occurrences are one range;
3. the occurrences are edges (from, to, rank), placed by position;
4. the edges are relaxed: in each round the segment's best edge over two neighbouring symbols, leftmost among equals,
   makes them one symbol, until no edge is left.  This is the order of merges of a byte-pair model, so ids equal the
   library's; a best-sum path over the same edges would not give the model's ids.

Characters that no piece covers become byte pieces.  A segment of more than ``LONG`` characters has its edges from the
same suffix array but relaxes them from a heap, in the same order, instead of in rounds that all segments share; one of
more than a batch is sorted in blocks and takes some hundred bytes a character.  Nulls encode as nothing, like empty texts.  Rows of a repeated doc_id
are encoded each.  Vocabulary files are read, never trained or copied.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import prepare, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG = 40
#: Characters of new segments sorted at once; characters of the segments that a worker remembers of a generation.
BATCH_CHARS, REMEMBERED = 300_000, 2_000_000


class Vocabulary:
    """Pieces in order of rank, byte pieces, and the maps that matching needs."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        normal.sort(key=lambda i: (-model.get_score(i), i))
        self.ids = np.array(normal, np.int32)
        bare = {self.text[i] for i in normal}
        assert all(MARK not in p.lstrip(MARK) for p in bare), "pieces must not span segments"
        self.rank = {self.text[i]: r for r, i in enumerate(normal)}
        self.unknown = model.unk_id()
        self.bytes_of = [b""] * n
        for i in normal:
            self.bytes_of[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self._searchable()

    def _searchable(self) -> None:
        chars = sorted({c for p in self.rank for c in p})
        self.wide = max(map(len, self.rank))
        self.codes = np.full(0x110000, 0xFFFE, np.uint16)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        order = list(self.rank)
        self.lengths = np.array([len(p) for p in order])
        table = np.zeros((len(order), self.wide), np.uint16)
        for r, p in enumerate(order):
            table[r, : len(p)] = self.codes[[ord(c) for c in p]]
        self.table = table

    # -------------------------------------------------------- encoding

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each segment."""
        out: list[bytes | None] = [None] * len(segments)
        fits = [k for k, s in enumerate(segments) if len(s) <= BATCH_CHARS]
        at = 0
        while at < len(fits):
            take, size = at, 0
            while take < len(fits) and size < BATCH_CHARS:
                size += len(segments[fits[take]])
                take += 1
            for k, ids in zip(fits[at:take], self._relax([segments[k] for k in fits[at:take]])):
                out[k] = ids
            at = take
        for k, s in enumerate(segments):
            if out[k] is None:
                out[k] = self._long(s)
        return out

    def _edges(self, code: np.ndarray, n: int) -> np.ndarray:
        """edges[position, length]: rank of the piece that occurs there, from ranges of the suffix array."""
        # an alphabet of the batch's own: one byte a character where it has few of them, as most batches do
        alphabet = np.unique(code)
        kind, top = (np.uint8, 0xFF) if len(alphabet) < 0xFF else (np.dtype(">u2"), 0xFFFF)
        local = np.zeros(0x10000, np.int64)
        local[alphabet] = np.arange(len(alphabet))  # code 0 ends a segment and comes first
        padded = np.zeros(n + self.wide, kind)
        padded[:n] = local[code]
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.wide)[:n])
        keys = rows.view(f"S{rows.itemsize * self.wide}").ravel()
        words = rows.view(">u8").astype(np.uint64).reshape(n, -1)
        suffixes = np.lexsort(words.T[::-1])
        keys = keys[suffixes]
        low = local[self.table].astype(kind)
        inside = np.arange(self.wide)[None, :] < self.lengths[:, None]
        can = ((low != 0) | ~inside).all(1)  # pieces with a character that the batch lacks do not occur
        high = np.where(inside, low, top).astype(kind)
        first = np.searchsorted(keys, low.view(keys.dtype).ravel(), "left")
        last = np.where(can, np.searchsorted(keys, high.view(keys.dtype).ravel(), "right"), first)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        place = suffixes[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        edges = np.full((n, self.wide + 1), 1 << 30, np.int32)
        edges[place, self.lengths[piece]] = piece
        return edges

    def _relax(self, segments: list[str]) -> list[bytes]:
        joined = "\n".join(segments) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(s) for s in segments])
        code = self.codes[points]
        begin = np.cumsum(size + 1) - size - 1
        code[begin + size] = 0
        n = len(code)
        edges = self._edges(code, n)
        symbol = np.flatnonzero(np.isin(np.arange(n), begin + size, invert=True))
        owner = np.repeat(np.arange(len(segments)), size)
        long = np.flatnonzero(size > LONG)
        if len(long):
            short = (size <= LONG)[owner]
            symbol, owner = symbol[short], owner[short]
        stop = begin + size
        done_symbol, done_owner, done_end = [], [], []
        while len(symbol):  # every round: each segment's best edge
            following = np.r_[symbol[1:], n]
            same = np.r_[owner[1:] == owner[:-1], False]
            end = np.where(same, following, stop[owner])
            after = np.r_[end[1:], 0]
            length = after - symbol
            ok = same & (length <= self.wide)
            rank = np.full(len(symbol), 1 << 30, np.int64)
            rank[ok] = edges[symbol[ok], length[ok]]
            key = (rank << 32) | np.arange(len(symbol))
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(key, heads)
            merge = (best >> 32) < (1 << 30)
            spans = np.diff(np.r_[heads, len(symbol)])
            going = np.repeat(merge, spans)
            rest = ~going
            done_symbol.append(symbol[rest]), done_owner.append(owner[rest]), done_end.append(end[rest])
            going[(best[merge] & 0xFFFFFFFF) + 1] = False
            symbol, owner = symbol[going], owner[going]
        symbol, owner, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (done_symbol, done_owner, done_end))
        order = np.argsort(symbol)
        symbol, owner, end = symbol[order], owner[order], end[order]
        rank = edges[symbol, end - symbol]
        known = rank < (1 << 30)
        ids = np.where(known, self.ids[np.where(known, rank, 0)], -1).astype(np.int32)
        if not known.all():
            ids, owner = self._byte_pieces(ids, owner, points[symbol])
        cuts = np.searchsorted(owner, np.arange(len(segments) + 1)) * 4
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in long.tolist():
            out[k] = self._heap(segments[k], edges[begin[k] : begin[k] + size[k]])
        return out

    def _byte_pieces(self, ids: np.ndarray, owner: np.ndarray, points: np.ndarray):
        """Characters without a piece, as the pieces of their bytes."""
        new_ids, new_owner = [], []
        for i, o, p in zip(ids.tolist(), owner.tolist(), points.tolist()):
            for x in (i,) if i >= 0 else (self.byte_ids[b] for b in chr(p).encode()):
                new_ids.append(x)
                new_owner.append(o)
        return np.array(new_ids, np.int32), np.array(new_owner)

    def _long(self, s: str) -> bytes:
        """A segment that fills more than one batch: its edges block by block."""
        n = len(s)
        code = self.codes[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges = np.concatenate([self._edges(np.r_[code[a : a + BATCH_CHARS + self.wide], np.uint16(0)], min(BATCH_CHARS + self.wide, n - a) + 1)[: min(BATCH_CHARS, n - a)] for a in range(0, n, BATCH_CHARS)])
        return self._heap(s, edges)

    def _heap(self, s: str, edges: np.ndarray) -> bytes:
        """Relaxes a segment's edges from a heap: best edge first, leftmost among equals."""
        n, none = len(s), 1 << 30
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and end[j] - i <= self.wide:
                r = int(edges[i, end[j] - i])
                if r < none:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, k = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < n:
                left[k] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            r = int(edges[i, end[i] - i])
            out.extend([int(self.ids[r])] if r < none else (self.byte_ids[b] for b in s[i : end[i]].encode()))
            i = end[i]
        return np.array(out, np.int32).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids."""
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return out[1:] if out[:1] == b" " else out


_memory: dict = {}
_older: dict = {}
_held = 0


def encode_rows(vocabulary: Vocabulary, texts: list[str | None]) -> list[bytes]:
    """Ids of each text; new segments of all texts are matched together.

    A worker remembers two generations of segments, each bounded in characters: one that is met again moves to the
    younger, so the frequent ones stay.
    """
    global _memory, _older, _held
    split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else () for t in texts]
    if _held > REMEMBERED:
        _memory, _older, _held = {}, _memory, 0
    fresh = []
    for s in set().union(*split) - _memory.keys():
        old = _older.get(s)
        if old is None:
            fresh.append(s)
        else:
            _memory[s] = old
            _held += len(s)
    _memory.update(zip(fresh, vocabulary.encode_segments(fresh)))
    _held += sum(map(len, fresh))
    get = _memory.__getitem__
    return [b"".join(map(get, segments)) for segments in split]


def encode_documents(docs: DataFrame, model: str = MODEL, rows_at_once: int = 800) -> DataFrame:
    """docs with __ids (int32 bytes) and __decoded (the UTF-8 text that the ids decode to); one row for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(model))  # a vocabulary: of fixed size
    at = docs.columns.index("text")

    def run(batches):
        vocabulary = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(k, rows_at_once)
                ids = encode_rows(vocabulary, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([vocabulary.decode(x) for x in ids], pa.binary())], names=[*batch.schema.names, "__ids", "__decoded"])

    prepare(spark)
    return docs.mapInArrow(tidy(run), type(docs.schema)(list(docs.schema.fields)).add("__ids", "binary").add("__decoded", "binary"))
