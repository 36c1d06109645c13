"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import chunks, in_arrow, mix64, plus, seeds

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes sampled at once, and lattice edges kept between chunks.
CHUNK_BYTES, KEPT_EDGES = 250_000, 500_000

_SPACE = "▁"
#: Where units may end: words of letters apart from other marks, or, if pieces of the model mix these, at spaces only.
_UNITS = (re.compile(r" *[^\W\d_¹²³]+| *(?:[^\w \n]|[\d_¹²³])+| +|\n"), re.compile(r" *[^ \n]+| +|\n"))
#: Weight of a character that has no piece, and a factor a character that keeps products in range.
BYTES_WEIGHT, SCALE = 1e-6, 1e3
_TOP_BITS = 12
#: Characters of a unit that are taken for all units at once; the rest of a longer one follows edge by edge.
_HEAD = 64
#: Units left at which sampling goes on with one after the other.
_FEW = 4
_MASK = (1 << 64) - 1
_STEP, _PLACE = seeds(2, 53), seeds(64, 71)


@dataclass(frozen=True)
class Pieces:
    """Surface (spaces as spaces) to id and weight, the 256 byte pieces' ids, and each id's bytes."""

    ids: dict[str, int]
    weight: dict[str, float]
    byte_ids: tuple[int, ...]
    raw: tuple[bytes, ...]
    longest: int
    unit: re.Pattern[str]


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Read a SentencePiece model with byte fallback.

    A unigram model's scores are log probabilities. A BPE model's are merge ranks, so its pieces get Zipf's
    probabilities: 1 / (rank + 2.7). Raises ValueError if a piece crosses the ends of units, which are at spaces at
    the latest, or if the model has no byte pieces.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, score, byte_ids, raw = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            surface = piece.replace(_SPACE, " ")
            ids[surface], score[surface] = i, model.get_score(i)
            raw.append(surface.encode())
    if len(set(byte_ids)) != 256:
        raise ValueError("the model has no byte fallback")
    unit = next((u for u in _UNITS if all(len(u.findall(s)) == 1 for s in ids)), None)
    if unit is None or max(map(len, ids)) > len(_PLACE):
        raise ValueError("pieces cross units")
    ranked = all(x == int(x) for x in score.values())
    first = min(ids.values())
    weight = {s: 1 / (ids[s] - first + 2.7) if ranked else float(np.exp(x)) for s, x in score.items()}
    return Pieces(ids, weight, tuple(byte_ids), tuple(raw), max(map(len, ids)), unit)


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            room = np.zeros(2 * (self.n + len(x)), self.room.dtype)
            room[: self.n] = self.view()
            self.room = room
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    def view(self) -> np.ndarray:
        return self.room[: self.n]


class Lattice:
    """Edges into each inner position of the units seen so far, with their backward sampling probabilities.

    A node is the end of a unit's prefix, one a character. Its edges are consecutive and end at last[node]: cum holds
    node + cumulative probability, before the node at the edge's start (-1 at the unit's start), code the piece id, or
    -1 - code point for byte fallback.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.unit, self.longest, self.byte_ids = pieces.unit, pieces.longest, np.array(pieces.byte_ids, np.int32)
        self.tables = []  # by length: hashes of prefixes, ids or -1, weights, where hashes with the same top bits start, most of these
        for n in range(1, pieces.longest + 1):
            known = {s[:n]: -1 for s in pieces.ids if len(s) >= n} | {s: i for s, i in pieces.ids.items() if len(s) == n}
            points = np.array([[ord(c) for c in s] for s in known], np.uint64)
            h = (points * _PLACE[:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            ids = np.array(list(known.values()), np.int32)[order]
            weights = np.array([pieces.weight[s] * SCALE**n if i >= 0 else 0.0 for s, i in known.items()])[order]
            starts = np.searchsorted(h[order] >> np.uint64(64 - _TOP_BITS), np.arange((1 << _TOP_BITS) + 1, dtype=np.uint64)).astype(np.int32)
            self.tables.append((h[order], ids, weights, starts, int(np.diff(starts).max())))
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.last, self.before, self.code, self.cum = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32), _Grown(np.float64)

    def add(self, units: list[str]) -> None:
        """Forward filtering over new units: alpha of a position sums alpha at each edge's start times its weight."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - np.repeat(firsts, sizes)
        left = np.repeat(sizes, sizes) - place  # characters from here to the unit's end
        at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        found = []
        for n, (table, ids, weights, starts, most) in enumerate(self.tables, 1):
            h = h + points[at + n - 1] * _PLACE[n - 1]
            i = np.minimum(starts[(h >> np.uint64(64 - _TOP_BITS)).astype(np.int64)], len(table) - 1)
            for _ in range(most - 1):
                i = np.minimum(i + (table[i] < h), len(table) - 1)
            known = table[i] == h
            if n == 1:
                alone = at[~known | (ids[i] < 0)]
                found.append((alone, alone, (-1 - points[alone].astype(np.int64)).astype(np.int32), np.full(len(alone), BYTES_WEIGHT * SCALE)))
            hit = known & (ids[i] >= 0)
            found.append((at[hit], at[hit] + n - 1, ids[i[hit]], weights[i[hit]]))
            on = known & (left[at] > n)
            at, h = at[on], h[on]
        start, end, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        start, end, code, weight = start[order], end[order], code[order], weight[order]
        inner = place[start] > 0
        alpha, share = np.ones(len(points)), np.empty(len(end))
        by_place = np.argsort(place[end], kind="stable")
        bounds = np.searchsorted(place[end][by_place], np.arange(min(_HEAD, int(sizes.max())) + 1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e = by_place[lo:hi]
            w = np.where(inner[e], alpha[start[e] - 1], 1.0) * weight[e]
            node = end[e]
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            total = np.add.reduceat(w, head)
            share[e] = w / np.repeat(total, np.diff(np.append(head, len(e))))
            if lo and (total.min() < 1e-200 or total.max() > 1e200):
                total = self._rescaled(alpha, node[head], place, total)
            alpha[node[head]] = total
        if len(rest := np.flatnonzero(place[end] >= _HEAD)):
            share[rest] = self._onward(alpha, start[rest], end[rest], weight[rest])
        stop = np.searchsorted(end, np.arange(len(points)), side="right") - 1
        sums = np.cumsum(share)
        within = sums - np.repeat(np.concatenate([[0.0], sums[stop[:-1]]]), np.diff(np.concatenate([[-1], stop])))
        within[stop] = 1.0
        node0, edge0 = self.last.n, self.code.n
        self.before.extend(np.where(inner, start - 1 + node0, -1))
        self.code.extend(code)
        self.cum.extend(end + node0 + within)
        self.last.extend(stop + edge0)
        self.ends.update(zip(units, (firsts + sizes - 1 + node0).tolist(), strict=True))

    def _rescaled(self, alpha: np.ndarray, nodes: np.ndarray, place: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Divide the last values of each unit by the newest: only their ratios count from here on."""
        for back in range(1, self.longest):
            on = place[nodes] >= back
            alpha[nodes[on] - back] /= total[on]
        return np.ones(len(total))

    def _onward(self, alpha: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> array:
        """The shares of the edges that end _HEAD characters or more into a unit: all of them start after its first."""
        a, starts, ends, out = array("d", alpha.tobytes()), array("q", start.tobytes()), array("q", end.tobytes()), array("d", weight.tobytes())
        i, n = 0, len(ends)
        while i < n:
            node, j, total = ends[i], i, 0.0
            while j < n and ends[j] == node:
                out[j] *= a[starts[j] - 1]
                total += out[j]
                j += 1
            for k in range(i, j):
                out[k] /= total
            a[node] = total
            if not 1e-200 < total < 1e200:
                for back in range(self.longest):
                    a[node - back] /= total
            i = j
        return out

    def sample(self, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units in text order, and each unit's number of codes; keys seed each unit."""
        last, before, code, cum = self.last.view(), self.before.view(), self.code.view(), self.cum.view()
        unit, node, steps = np.arange(len(ends)), ends, []
        many = np.zeros(len(ends), np.int64)
        while len(node) > _FEW:
            u = (mix64(keys[unit] + np.full(1, len(steps), np.uint64) * _STEP[0]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, stop, want = np.where(node > 0, last[node - 1] + 1, 0), last[node], node + u
            on = np.flatnonzero((cum[edge] <= want) & (edge < stop))
            while len(on):
                edge[on] += 1
                on = on[(cum[edge[on]] <= want[on]) & (edge[on] < stop[on])]
            steps.append((unit, code[edge]))
            many[unit] += 1
            node = before[edge]
            more = node >= 0
            unit, node = unit[more], node[more]
        rest = []
        for i, n in zip(unit.tolist(), node.tolist(), strict=True):
            key, codes = int(keys[i]), []
            while n >= 0:
                want = n + _draw(key, len(steps) + len(codes))
                e, stop = int(last[n - 1]) + 1 if n else 0, int(last[n])
                while e < stop and cum[e] <= want:
                    e += 1
                codes.append(code[e])
                n = int(before[e])
            many[i] += len(codes)
            rest.append((i, codes))
        at = np.cumsum(many)
        out = np.zeros(at[-1] if len(at) else 0, np.int32)
        for t, (unit, found) in enumerate(steps):
            out[at[unit] - 1 - t] = found
        for i, codes in rest:
            out[at[i] - many[i] : at[i] - len(steps)] = codes[::-1]
        return out, many


def _draw(key: int, step: int) -> float:
    """As in sample for one unit: a number in 0..1 by the unit's key and the step."""
    x = (key + step * int(_STEP[0])) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & _MASK
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


def row_key(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'' if key is None else key}".encode(), digest_size=8).digest(), "little")


def encode_rows(lattice: Lattice, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows and the n + 1 offsets of the rows."""
    units, find = [], lattice.unit.findall
    rows = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        units += find(t)
        rows[i + 1] = len(units)
    if lattice.code.n > KEPT_EDGES:
        lattice.clear()
    if new := list(set(units) - lattice.ends.keys()):
        lattice.add(new)
    ends = np.fromiter(map(lattice.ends.__getitem__, units), np.int64, len(units))
    n = np.diff(rows)
    place = np.arange(len(units)) - np.repeat(rows[:-1], n)
    unit_keys = mix64(np.repeat(np.array(keys, np.uint64), n) + place.astype(np.uint64) * _STEP[1])
    out, many = lattice.sample(ends, unit_keys)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])[rows]
    if len(out) and out.min() < 0:
        low = np.flatnonzero(out < 0)
        raw = [chr(-1 - c).encode() for c in out[low].tolist()]
        wide = np.ones(len(out), np.int64)
        wide[low] = [len(x) for x in raw]
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(wide)])
        full = np.repeat(out, wide)
        table = lattice.byte_ids
        for at, x in zip(begin[low].tolist(), raw, strict=True):
            full[at : at + len(x)] = table[list(x)]
        out, offsets = full, begin[offsets]
    return out, offsets


def encode(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", model: str = DEFAULT_MODEL, seed: int = 0, check: bool = False) -> DataFrame:
    """Add piece_ids array<int>: a segmentation sampled in proportion to its probability, fixed by key and seed.

    With check, also lossless boolean: whether decoding gives the text back (for a null one, the empty text).

    Forward filtering sums, for every position, the weights of all ways there; backward sampling draws each piece
    from the end in proportion to its share. Draws depend on the row's key, the unit's place and the step alone, so
    reruns and other partitionings agree, and rows with equal key and text are segmented alike. Characters without a
    piece become byte pieces. A null or empty text has no pieces. A column named piece_ids is replaced.
    The lattice's tables (of fixed size, by the vocabulary) are built on the driver, where the model's path is read, and
    go to the tasks with the function. An unbroken run of letters is one unit, sampled in time linear in its length.
    """
    pieces = load(model)
    lattice, raw = Lattice(pieces), pieces.raw if check else ()
    df = df.drop("piece_ids", *(["lossless"] if check else []))
    names = df.columns
    place, key_place = names.index(text_col), names.index(key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names[place], CHUNK_BYTES):
            keys = [row_key(k, seed) for k in batch.column(key_place).to_pylist()]
            texts = [t or "" for t in batch.column(place).to_pylist()]
            ids, offsets = encode_rows(lattice, texts, keys)
            more = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))]
            if check:
                more.append(pa.array([_decoded(raw, ids[a:b]) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "piece_ids", "lossless"][: len(names) + len(more)])
        lattice.clear()

    return in_arrow(df, run, plus(df, piece_ids="array<int>", **({"lossless": "boolean"} if check else {})))


def _decoded(raw: tuple[bytes, ...], ids: np.ndarray) -> str:
    return b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(df: DataFrame, ids_col: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """Add decoded string: the bytes of the pieces end to end; null ids give null, no ids the empty text; an empty table gives an empty one. A column named decoded is replaced."""
    raw = load(model).raw
    df = df.drop("decoded")
    names = df.columns
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = ceil(batch.column(place).nbytes / 4 / CHUNK_BYTES) or 1
            step = ceil(batch.num_rows / parts) or 1
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [None if x is None else _decoded(raw, x) for x in (s.values.to_numpy(zero_copy_only=False) if s.is_valid else None for s in part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return in_arrow(df, run, plus(df, decoded="string"))
