"""SentencePiece BPE with seeded merge-dropout, and its lossless inverse.

Pieces merge by the agenda of the model: the best-scored adjacent pair first, the leftmost of
equals. Each candidate that comes to its turn is skipped for good with probability ``dropout``,
decided by a hash keyed with seed, document, copy, the segment's place in the text, and the
candidate's place and piece; so reruns agree, and every occurrence of a word has its own
segmentation. Characters without a piece become byte pieces, and U+2581 itself too, so that every
text comes back exactly.

Each distinct segment (a run of spaces with what follows it) is merged once without dropout, and
the candidates of that walk are kept. An occurrence that skips none of them has that segmentation;
only the others are merged anew, each under its own key. Many segments are merged at once, as rows
of a matrix; longer ones walk a heap with the same agenda.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import lean

SPACE = "▁"
#: Segments of up to this many characters are merged in matrices.
WIDE = 32
#: Segments in one matrix, and bytes of text encoded at once, about.
ROWS, TEXT_BYTES = 8_000, 500_000
_NEVER = np.int32(2**31 - 1)
_OTHER_SPACE = np.zeros(256, bool)
_OTHER_SPACE[[9, 10, 11, 12, 13]] = True


@dataclass
class PieceModel:
    """pieces, their scores, the ids of the 256 byte pieces, and which pieces are ordinary."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    ordinary: list[bool]

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a SentencePiece model file with byte fallback."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [-1] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:-1], 16)] = i
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces")
        return PieceModel(pieces, [sp.get_score(i) for i in range(n)], byte_ids, [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)])


class MergeEncoder:
    def __init__(self, model: PieceModel, dropout: float, seed: int):
        self.model, self.dropout, self.seed = model, dropout, seed
        ids = {p: i for i, p in enumerate(model.pieces) if model.ordinary[i]}
        order = sorted(ids.values(), key=lambda i: (-model.scores[i], i))
        self.rank = np.full(len(model.pieces), _NEVER, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.of_rank = np.array(order, np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        left, right, made = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(self.rank[i])
        key = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        self._hash(key, np.array(made, np.int32))
        byte_of = {i: b for b, i in enumerate(model.byte_ids)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))

    def _hash(self, key: np.ndarray, value: np.ndarray) -> None:
        """An open-addressing table for many lookups at once."""
        self.bits = 20
        size = 1 << self.bits
        self.table, self.value, self.probes = np.full(size + 64, -1, np.int64), np.full(size + 64, _NEVER, np.int32), 1
        for k, v, slot in zip(key.tolist(), value.tolist(), self._slot(key).tolist(), strict=True):
            depth = 1
            while self.table[slot] >= 0:
                slot, depth = slot + 1, depth + 1
            self.table[slot], self.value[slot] = k, v
            self.probes = max(self.probes, depth)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes, or _NEVER."""
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.full(len(key), _NEVER, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            seen = self.table[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            if not len(todo):
                break
            slot[todo] += 1
        return out

    def find(self, left: int, right: int) -> int | None:
        """The rank of the piece that one pair makes."""
        key = (left << 20) | right
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (seen := self.table[slot]) >= 0:
            if seen == key:
                return int(self.value[slot])
            slot += 1
        return None

    def skipped(self, key: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether a candidate is dropped. key: the segment's keyed hash."""
        if not self.dropout:
            return np.zeros(len(key), bool)
        with np.errstate(over="ignore"):
            return W.mix(key ^ W.mix((place.astype(np.uint64) << np.uint64(32)) | rank.astype(np.uint64))) < self.limit

    def keyed(self, text_key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The key of a segment from its text's key and its place in the text."""
        with np.errstate(over="ignore"):
            return W.mix(text_key + W.mix(place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(self.seed)))

    def agenda(self, symbols: list[int], key: int | None, path: list[tuple[int, int]] | None = None) -> list[int]:
        """One segment by a heap; without a key nothing is dropped. path: gets the candidates
        (place, rank) that came to their turn."""
        n = len(symbols)
        sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(p: int) -> None:
            q = nxt[p]
            if q < n and sym[p] >= 0 and sym[q] >= 0 and (r := self.find(sym[p], sym[q])) is not None:
                heapq.heappush(heap, (r, p, sym[p], sym[q]))

        for p in range(n - 1):
            offer(p)
        k = np.array([key or 0], np.uint64)
        alive = [True] * n
        while heap:
            r, p, a, b = heapq.heappop(heap)
            if not alive[p] or sym[p] != a or nxt[p] >= n or sym[nxt[p]] != b:
                continue
            if key is not None and self.skipped(k, np.array([p]), np.array([r]))[0]:
                continue
            if path is not None:
                path.append((p, r))
            q = nxt[p]
            sym[p], nxt[p], alive[q] = int(self.of_rank[r]), nxt[q], False
            if nxt[p] < n:
                prv[nxt[p]] = p
            offer(p)
            if prv[p] >= 0:
                offer(prv[p])
        return [sym[p] for p in range(n) if alive[p]]

    def matrices(self, sym: np.ndarray, key: np.ndarray | None, path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Rows of symbols, padded with -2, merged; what was merged away is -2. Without keys nothing
        is dropped. path: gets the candidates (row, place, rank) that came to their turn."""
        n, width = sym.shape
        sym = sym.copy()
        nxt = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), sym.shape).copy()
        prv = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int16), sym.shape).copy()
        rank = np.full((n, width), _NEVER, np.int32)
        if width > 1:
            rank[:, :-1] = self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while len(rows):
            sub = rank[rows]
            at = sub.argmin(1)
            best = sub[np.arange(len(rows)), at]
            go = best < _NEVER
            rows, at, best = rows[go], at[go], best[go]
            if not len(rows):
                break
            if path is not None:
                path.append((rows, at, best))
            r, p, b = rows, at, best
            if key is not None:
                drop = self.skipped(key[rows], at, best)
                rank[rows[drop], at[drop]] = _NEVER
                r, p, b = rows[~drop], at[~drop], best[~drop]
            q = nxt[r, p]
            sym[r, p] = self.of_rank[b]
            sym[r, q] = -2
            rank[r, q] = _NEVER
            after = nxt[r, q]
            nxt[r, p] = after
            ok = after < width
            prv[r[ok], after[ok]] = p[ok]
            rank[r, p] = _NEVER
            rank[r[ok], p[ok]] = self.lookup(sym[r[ok], p[ok]], sym[r[ok], after[ok]])
            before = prv[r, p]
            ok = before >= 0
            rank[r[ok], before[ok]] = self.lookup(sym[r[ok], before[ok]], sym[r[ok], p[ok]])
        return sym

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, segments per text) of texts, each with a space put before it."""
        data, off = W.raw(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string())))
        space, other = data == 32, _OTHER_SPACE[data]
        before_space, before_other = np.zeros_like(space), np.zeros_like(other)
        before_space[1:], before_other[1:] = space[:-1], other[:-1]
        first = (space & ~before_space) | other | (before_other & ~other)
        first[off[:-1]] = True
        starts = np.flatnonzero(first)
        return data, starts, np.append(starts[1:], len(data)), np.diff(np.searchsorted(starts, off))

    def encode(self, texts: pa.Array, text_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text). Nulls must be filled. text_key: a 64-bit key of each
        text, without effect where there is no dropout."""
        data, starts, ends, per = self.segments(texts)
        if not len(starts):
            return np.zeros(0, np.int32), per
        length = ends - starts
        place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, length)
        with np.errstate(over="ignore"):
            h = W.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * W._powers(int(length.max()))[place], starts) + length.astype(np.uint64))
        del place
        _, some, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, count, path = self._merge(data, starts[some], ends[some], None)
        first, take = (np.cumsum(count) - count)[inverse], count[inverse]
        if self.dropout:
            nth = np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
            key = self.keyed(np.repeat(text_key.astype(np.uint64), per), nth)
            touched = self._touched(key, inverse, path)
            again, n, _ = self._merge(data, starts[touched], ends[touched], key[touched])
            first[touched], take[touched] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, again])
        at = np.repeat(first - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        return ids[at], np.bincount(np.repeat(np.arange(len(per)), per), take, minlength=len(per)).astype(np.int64)

    def _touched(self, key: np.ndarray, kind: np.ndarray, path: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The segments that skip a candidate of their kind's walk without dropout."""
        of, place, rank = path
        order = np.argsort(of, kind="stable")
        place, rank = place[order], rank[order]
        m = np.bincount(of, minlength=int(kind.max()) + 1)
        first = np.cumsum(m) - m
        out = []
        for a in range(0, len(key), 50_000):
            k = kind[a : a + 50_000]
            at = np.repeat(first[k] - (np.cumsum(m[k]) - m[k]), m[k]) + np.arange(int(m[k].sum()))
            owner = np.repeat(np.arange(a, a + len(k)), m[k])
            out.append(np.unique(owner[self.skipped(key[owner], place[at], rank[at])]))
        return np.concatenate(out)

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, ids per segment, candidates met as segment, place and rank) of segments; without
        keys nothing is dropped, and only then candidates are kept."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3
        length = ends - starts
        at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        flat = data[at]
        code = np.frombuffer(flat.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = (flat & 0xC0) != 0x80
        chars = np.add.reduceat(lead.astype(np.int64), np.cumsum(length) - length)
        if int(chars.sum()) != len(code):  # not UTF-8: every byte stands alone
            code, chars = flat.astype(np.uint32) + np.uint32(0xDC00) * (flat > 127), length
        sym = self.char[np.minimum(code, 0x10FFFF)]
        sym[code == 32] = self.char[ord(SPACE)]
        sym[code == ord(SPACE)] = -1
        # A character without a piece is -(code point) - 10 until the merges are done.
        sym = np.where(sym < 0, -(code.astype(np.int32)) - 10, sym)
        first = np.cumsum(chars) - chars
        out_sym, out_row, out_at = [], [], []
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        narrow = np.flatnonzero(chars <= WIDE)
        by = narrow[np.argsort(chars[narrow], kind="stable")]
        for part in np.array_split(by, max(1, -(-len(by) // ROWS))):
            if not len(part):
                continue
            width = int(chars[part].max())
            inside = np.arange(width) < chars[part][:, None]
            m = np.full((len(part), width), -2, np.int32)
            m[inside] = sym[np.repeat(first[part], chars[part]) + (np.arange(int(chars[part].sum())) - np.repeat(np.cumsum(chars[part]) - chars[part], chars[part]))]
            path = [] if key is None else None
            done = self.matrices(m, None if key is None else key[part], path)
            met += [(part[r], p, b) for r, p, b in path or ()]
            row, col = np.nonzero(done != -2)
            out_sym.append(done[row, col])
            out_row.append(part[row])
            out_at.append(col)
        for i in np.flatnonzero(chars > WIDE):
            walk: list[tuple[int, int]] | None = [] if key is None else None
            got = self.agenda(sym[first[i] : first[i] + chars[i]].tolist(), None if key is None else int(key[i]), walk)
            if walk:
                met.append((np.full(len(walk), i), *np.array(walk).T))
            out_sym.append(np.array(got, np.int32))
            out_row.append(np.full(len(got), i))
            out_at.append(np.arange(len(got)))
        s, r, a = np.concatenate(out_sym), np.concatenate(out_row), np.concatenate(out_at)
        order = np.lexsort((a, r))
        s, r = s[order], r[order]
        if (s < 0).any():
            parts = [[int(x)] if x >= 0 else [self.model.byte_ids[b] for b in _bytes(-int(x) - 10)] for x in s[s < 0]]
            n = np.ones(len(s), np.int64)
            n[s < 0] = [len(p) for p in parts]
            grown = np.repeat(s, n)
            grown[np.repeat(s < 0, n)] = [b for p in parts for b in p]
            s, r = grown, np.repeat(r, n)
        every = tuple(np.concatenate([x[i] for x in met]) if met else np.zeros(0, np.int64) for i in range(3))
        return s.astype(np.int32), np.bincount(r, minlength=len(starts)).astype(np.int64), every

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.raw[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogateescape")


def _bytes(code: int) -> bytes:
    return bytes([code - 0xDC00]) if 0xDC80 <= code <= 0xDCFF else chr(code).encode("utf-8", "surrogatepass")


def _coder(shared, dropout: float, seed: int, names: list[str]):
    """All columns but the last three, the copy, the text and its key, with n_pieces, ids and lossless after them."""
    encoders: list[MergeEncoder] = []

    def run(batches) -> Iterator[pa.RecordBatch]:
        if not encoders:
            encoders.append(MergeEncoder(shared.value, dropout, seed))
        enc = encoders[0]
        for batch in batches:
            text = batch.column(batch.num_columns - 2).cast(pa.large_string()).fill_null("")
            key, copy = (batch.column(batch.num_columns - i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (1, 3))
            with np.errstate(over="ignore"):
                key = W.mix(key + W.mix(copy))
            for part in W.chunks(text, TEXT_BYTES):
                ids, n = enc.encode(text[part], key[part])
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = ids.tolist()
                same = [enc.decode(flat[a:b]) == t for a, b, t in zip(ends[:-1], ends[1:], text[part].to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                piece = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-3], pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], names=names)

    return lean(run)


RESULTS = ("n_pieces", "ids", "lossless")


def encode_documents(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 0, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", copy_col: str | None = None, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """``keep`` columns, n_pieces, ids and lossless (whether the ids decode to the text) of each row.

    The segmentation depends on seed, id, text and the number in ``copy_col`` alone; without such a
    column, rows of equal id and text are split alike. A null number counts as 0.
    Nulls: a null or empty text has the one piece of the space put before it, and decodes to "";
    null ids count as one id. Columns of any names may be kept; a kept column that has the name of
    one of ``results`` is an error, so choose others then. The model file is read on the driver only.
    """
    if set(results) & set(keep):
        raise ValueError("a kept column has the name of a result")
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_file))
    key = F.coalesce(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.lit(0)).cast("long")
    copy = F.coalesce(F.col(f"`{copy_col}`").cast("long"), F.lit(0)) if copy_col else F.lit(0)
    names = [*(f"c{i}" for i in range(len(keep))), *RESULTS]
    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=False)), copy.cast("long").alias("copy"), F.col("text").cast("string").alias("text"), key.alias("key"))
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=False))
    out = chosen.mapInArrow(_coder(shared, dropout, seed, names), f"{fields}n_pieces long, ids array<int>, lossless boolean")
    return out.toDF(*keep, *results)


def decode_documents(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column text decoded from its ids; null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_file))

    @F.pandas_udf("string")
    def decode(column):
        enc = MergeEncoder(shared.value, 0.0, 0)
        return column.map(lambda x: None if x is None else enc.decode(list(x)))

    return encoded.withColumn("text", decode(F.col(ids_col)))
