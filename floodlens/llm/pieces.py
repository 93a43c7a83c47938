"""SentencePiece encoding and decoding by matching every piece in a suffix array.

The distinct space-led chunks of a batch are joined and indexed by a suffix array (prefix doubling, as deep as the
longest piece). Every piece's occurrences are a range of it, found by binary search; the ranges give edges (start, end,
piece), sorted by start and relaxed in that order. For byte-pair models an edge extends the path that ends at its
start only if the two pieces stand together, that is, if merging their joined text gives these two pieces again: a
sequence whose neighbours all stand together is the one the merges give, so exactly one edge reaches each position.
For unigram models the edge of the highest path score is kept.

Nulls, empties, ties: a null or empty text has no tokens and decodes to the empty text; unknown characters become byte
pieces (or the unknown piece); a literal U+2581 in a text is read as a space. Equal unigram scores keep the shorter
last piece. Long texts are cut at spaces only where no piece crosses, so results do not depend on batches. Columns of
the input are kept; result columns replace those of the same name.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNIGRAM, BPE = 1, 2, 3, 4, 6, 1, 2
#: Chunks whose encoding a Python worker remembers between batches, at most; beyond, the third used most is kept.
REMEMBERED = 300_000
#: Texts that are matched at a time.
ROWS = 500
_START = -1


class PieceModel:
    """A piece vocabulary: matching, encoding and decoding."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or any(
                p.type == USER for p in proto.pieces) or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normaliser and without own symbols are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == BPE
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.crosses = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        kinds = [p.type for p in proto.pieces]
        self.out = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
                    else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds)]
        spelled = [(t.encode(), i) for t, i in self.ids.items()]
        self.width = -(-max(len(t) for t, _ in spelled) // 8)
        self.piece = np.array([i for _, i in spelled], np.int64)
        self.length = np.array([len(t) for t, _ in spelled], np.int64)
        padded = np.frombuffer(b"".join(t.ljust(8 * self.width, b"\0") for t, _ in spelled), ">u8").reshape(-1, self.width)
        self.word = padded.astype(np.uint64)
        left = np.clip(self.length[:, None] - 8 * np.arange(self.width), 0, 8)
        self.mask = np.array([0] + [((1 << 8 * n) - 1) << (64 - 8 * n) for n in range(1, 9)], np.uint64)[left]
        self.stand: dict[int, bool] = {}
        self.strange: dict[str, int] = {}
        self.named = list(self.text)
        self.forget()

    def forget(self):
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.counts, self.uses = (np.zeros(0, np.int64) for _ in range(4))

    def _thin(self):
        """Keeps the third of the remembered chunks that was used most."""
        kept = np.sort(np.argsort(self.uses)[-(REMEMBERED // 3):]) if REMEMBERED >= 3 else np.zeros(0, np.int64)
        names = list(self.place)  # in the order of their numbers
        self.place = {names[i]: j for j, i in enumerate(kept.tolist())}
        n = self.counts[kept]
        self.flat = self.flat[np.repeat(self.starts[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.starts, self.counts, self.uses = np.cumsum(n) - n, n, self.uses[kept]
        if len(self.stand) > 4 * REMEMBERED:
            self.stand.clear()

    # merging -----------------------------------------------------------------------------------------------------
    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, pair: int) -> bool:
        """Whether merging two pieces' text gives the two again; the pair holds (first + 1, or 0 for the start) and second."""
        first, second = (pair >> 32) - 1, pair & 0xFFFFFFFF
        names = [self.named[second]] if first == _START else [self.named[first], self.named[second]]
        self.stand[pair] = self._merged("".join(names)) == names
        return self.stand[pair]

    # matching ----------------------------------------------------------------------------------------------------
    def _suffixes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bytes at every position as a number, and the positions sorted by their next 8 * width bytes or more."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8 * self.width + 8, np.uint8)])
        eight = np.zeros(n + 8 * self.width, np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | padded[i:i + len(eight)]
        order = np.argsort(eight[:n])
        rank, slots, keys, reach = np.empty(n, np.int64), np.arange(n), eight[:n][order], 8
        while True:  # only suffixes that still tie are sorted again, inside the slots they fill
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))] if n else slots
            rank[order[slots]] = group
            tied = ~first
            tied[:-1] |= ~first[1:]
            slots = slots[tied]
            if reach >= 8 * self.width or not len(slots):
                break
            own = order[slots]
            ahead = np.where(own + reach < n, rank[np.minimum(own + reach, n - 1)] + 1, 0)
            keys = rank[own] * (n + 1) + ahead
            sort = np.argsort(keys)
            order[slots], keys, reach = own[sort], keys[sort], 2 * reach
        return eight, order

    def _ranges(self, eight: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array that every piece's occurrences fill."""
        first = eight[order]
        low = np.searchsorted(first, self.word[:, 0], "left")
        high = np.searchsorted(first, self.word[:, 0] | ~self.mask[:, 0], "right")
        deep = np.flatnonzero((self.length > 8) & (low < high))
        for upper in (False, True):
            a, b = low[deep].copy(), high[deep].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = order[np.minimum(mid, len(order) - 1)]
                less, same = np.zeros(len(deep), bool), np.ones(len(deep), bool)
                for j in range(self.width):
                    there, here = eight[at + 8 * j] & self.mask[deep, j], self.word[deep, j]
                    less |= same & (there < here)
                    same &= there == here
                right = less | same if upper else less
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            (low, high)[upper][deep] = a
        return low, high

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not remembered yet."""
        spelled = [c.encode("utf-8", "replace") for c in chunks]
        data = np.frombuffer(b"\xff" + b"\xff".join(spelled) + b"\xff", np.uint8)
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        begins = np.cumsum(np.concatenate([[0], sizes[:-1] + 1])) + 1
        eight, order = self._suffixes(data)
        low, high = self._ranges(eight, order)
        n = high - low
        start = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        end, piece = start + np.repeat(self.length, n), np.repeat(self.piece, n)
        start, end, piece = (np.concatenate(x) for x in zip((start, end, piece), self._strangers(data, start, end)))
        offset = np.arange(len(data)) - np.append(np.repeat(begins, sizes + 1), len(data))
        by_offset = np.argsort(offset[start])
        last_start, last_piece = self._relaxed(len(data), begins, offset[start[by_offset]], start[by_offset], end[by_offset], piece[by_offset])
        flat, counts = self._traced(begins, begins + sizes, last_start, last_piece)
        self.place.update(zip(chunks, range(len(self.counts), len(self.counts) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.uses = np.concatenate([self.uses, np.zeros_like(counts)])
        self.flat = np.concatenate([self.flat, flat])

    def _traced(self, begins, at, last_start, last_piece) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' ids in a row, followed back from their ends, and how many each has."""
        owners, ranks, found = [], [], []
        chunk, step = np.flatnonzero(at > begins), 0
        at = at.copy()
        while len(chunk):
            here = last_piece[at[chunk]]
            owners.append(chunk)
            ranks.append(np.full(len(chunk), -step))
            found.append(here)
            at[chunk] = last_start[at[chunk]]
            chunk, step = chunk[at[chunk] > begins[chunk]], step + 1
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(begins), np.int64)
        owner, rank, found = map(np.concatenate, (owners, ranks, found))
        order = np.lexsort((rank, owner))
        owner, found = owner[order], found[order]
        if (strange := found >= len(self.text)).any():
            spelled = {p: [self.bytes[b] for b in self.named[p].encode()] if self.bytes else [self.unknown]
                       for p in np.unique(found[strange]).tolist()}
            n = np.ones(len(found), np.int64)
            n[strange] = [len(spelled[p]) for p in found[strange].tolist()]
            where = np.repeat(strange, n)
            owner, found = np.repeat(owner, n), np.repeat(found, n)
            found[where] = np.concatenate([spelled[p] for p in self._runs(found[where], n[strange])])
        return found, np.bincount(owner, minlength=len(begins))

    @staticmethod
    def _runs(values: np.ndarray, sizes: np.ndarray) -> list[int]:
        return values[np.cumsum(sizes) - sizes].tolist()

    def _strangers(self, data, start, end):
        """Edges for characters that no piece of one character spells."""
        lead = np.flatnonzero((data < 0x80) | (data >= 0xC0))
        lead = lead[data[lead] != 0xFF]
        size = 1 + (data[lead] >= 0xC0).astype(np.int64) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        mark = np.zeros(len(data), np.int64)
        mark[lead] = size
        met = np.zeros(len(data), bool)
        met[start[end - start == mark[start]]] = True
        rest = lead[~met[lead]]
        names = []
        for at, n in zip(rest.tolist(), mark[rest].tolist()):
            c = data[at:at + n].tobytes().decode()
            if c not in self.strange:
                self.strange[c] = len(self.named)
                self.named.append(c)
            names.append(self.strange[c])
        return rest, rest + mark[rest], np.array(names, np.int64)

    def _relaxed(self, size, begins, offset, start, end, piece):
        """The last edge (start, piece) of the path to every position that one reaches.

        Edges that start equally far into their chunks are relaxed together: no two of them share an end, and all
        edges into their starts have been relaxed before.
        """
        last_start, last_piece = np.zeros(size + 1, np.int64), np.full(size + 1, _START - 1)
        last_piece[begins] = _START
        best = np.full(size + 1, -np.inf)
        best[begins] = 0.0
        score = np.array(self.score + [min(self.score) - 10.0] * (len(self.named) - len(self.text)))
        bounds = np.searchsorted(offset, np.arange((offset[-1] if len(offset) else -1) + 2)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            reached = np.flatnonzero(last_piece[s] >= _START)
            s, e, p = s[reached], e[reached], p[reached]
            if self.bpe:
                pairs, where = np.unique((last_piece[s] + 1 << 32) | p, return_inverse=True)
                known = self.stand
                good = np.array([x if (x := known.get(k)) is not None else self.stands(k) for k in pairs.tolist()], bool)[where]
            else:
                total = best[s] + score[p]
                good = total >= best[e]
                best[e[good]] = total[good]
            last_start[e[good]], last_piece[e[good]] = s[good], p[good]
        return last_start, last_piece

    # whole texts -------------------------------------------------------------------------------------------------
    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' token ids in a row, and where each text's begin (and the last ends)."""
        chunks, ends, find = [], [0], re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        for x in texts:
            if x:
                spaced = (SPACE if self.prefix else "") + x.replace(" ", SPACE)
                chunks.extend([spaced] if self.crosses else find(spaced))
            ends.append(len(chunks))
        if len(self.place) > REMEMBERED:
            self._thin()
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.place]
        if fresh:
            self.learn(fresh)
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        flat, starts, counts = self.flat, self.starts, self.counts
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        self.uses += np.bincount(at, minlength=len(counts))
        n = counts[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - total[:-1], n) + np.arange(total[-1])].astype(np.int32)
        return ids, total[np.array(ends)]

    def decode(self, ids) -> str:
        out = b"".join([self.out[i] for i in ids])
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


_models: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """The worker's model, kept with what it remembers from one task to the next."""
    if hash(data) not in _models:
        _models[hash(data)] = PieceModel(data)
    return _models[hash(data)]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, rows: int = ROWS) -> DataFrame:
    """`docs` with token_ids (array of int) and n_tokens; `model` holds the bytes of a model file."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: its size is fixed
    kept = docs.drop("token_ids", "n_tokens")
    schema = StructType([*kept.schema.fields, StructField("token_ids", ArrayType(IntegerType(), False)), StructField("n_tokens", LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, ends = own.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(ends))], [*part.schema.names, "token_ids", "n_tokens"])
    return kept.mapInArrow(encode, schema)


def decode_column(ids: Column, model: bytes) -> Column:
    """The text of each array of token ids."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _model(model)
        for batch in batches:
            yield pd.Series([own.decode(x.tolist()) if x is not None else None for x in batch])
    return decode(ids)


def encode_and_decode(docs: DataFrame, model: bytes, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): whether decoding gives the text back (null as empty).

    Both steps run in the same worker, so the ids do not travel in between.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: its size is fixed
    kept = docs.select("doc_id", "text")
    schema = StructType([kept.schema["doc_id"], StructField("n_tokens", LongType()),
                         StructField("token_ids", ArrayType(IntegerType(), False)), StructField("round_trip", BooleanType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column("text").to_pylist()
                ids, ends = own.encode(texts)
                same = [own.decode(ids[a:b].tolist()) == (x or "") for x, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                     pa.array(same)], schema.names)
    return kept.mapInArrow(both, schema)
