"""Best-fit packing by length patterns (non-negative least squares).

Documents become token sequences (byte BPE ids, then the end id); sequences
longer than ``limit`` are cut into ``limit``-token pieces of which the first
may be shorter.  The pieces' length histogram (at most ``limit`` counts, so
bounded whatever the corpus size) is all that the plan needs: patterns of two
to four lengths that fill a sequence are enumerated on a coarse grid, their
repeat counts are fitted to the histogram by non-negative least squares and
rounded down, the patterns are filled with exact lengths, and the residual
pieces are packed best-fit into the left-over room or new sequences.  Pieces
then get their places by rank within length, which is counted in parallel.

Edge cases: a null or empty text is the end id alone (one piece of length 1);
an empty table gives an empty result; repeated rows are packed each on its own;
extra columns are ignored by ``token_pieces`` and kept by ``place``.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, shuffle_width

LIMIT = 2048
END_ID = 0
GRID = 8  # lengths are rounded up to a multiple of limit / 256 while patterns are fitted
# Fixed value: the token that the vocabulary's file adds to the ranks, wherever its literal stands.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
CACHE = 200_000  # words whose ids a worker keeps
PIECE_SCHEMA = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}

# A space between two characters that are not white space always starts a token of
# its own, so the parts around such spaces can be encoded one by one and remembered.


class Encoder:
    """Byte-BPE ids of texts as little-endian 32-bit bytes; the same ids as the
    ``tokenizers`` file of that vocabulary, from its rank file."""

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode many words at once: their ids split where the token bytes add up to
        a word.  Words with white space at an end (or none at all) are marked None."""
        whole = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.known.update(dict.fromkeys(words))
        ids = np.array(self.core.encode_ordinary("".join([" " + w for w in whole])), np.uint32)
        ends = np.cumsum(self.n_bytes[ids])
        cuts = 4 * (np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in whole])) + 1)
        raw, at = ids.tobytes(), 0
        for word, to in zip(whole, cuts.tolist()):
            self.known[word] = raw[at:to]
            at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        if any(SPECIAL in t for t in texts if t):
            return self._with_special(texts)
        parts = [(t or "").split(" ") for t in texts]
        words: set[str] = set()
        for p in parts:
            words.update(p)
        self._learn(list(words - self.known.keys()))
        out, known = [], self.known.__getitem__
        for p, t in zip(parts, texts):
            try:
                first = self._ids(p[0])
                out.append(b"".join([first, *map(known, p[1:])]) if known(p[0]) is not None else self._ids(t or ""))
            except TypeError:  # a part that can't stand alone
                out.append(self._ids(t or ""))
        return out


    def _with_special(self, texts: list[str | None]) -> list[bytes]:
        """The texts between the literals are encoded by themselves."""
        split = [(t or "").split(SPECIAL) for t in texts]
        done = iter(self.encode([x for parts in split for x in parts]))
        mark = SPECIAL_ID.to_bytes(4, "little")
        return [mark.join([next(done) for _ in parts]) for parts in split]


_ENCODER: list[Encoder] = []


def encoder() -> Encoder:
    if not _ENCODER:
        _ENCODER.append(Encoder())
    return _ENCODER[0]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an ``n``-token document."""
    first = n % limit or limit
    return [(0, min(first, n))] + [(at, limit) for at in range(first, n, limit)]


def token_pieces(docs: DataFrame, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = PIECE_SCHEMA | ({"ids": "array<int>"} if with_ids else {})

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out = defaultdict(list)
        end = END_ID.to_bytes(4, "little")
        for doc_id, raw in zip(cols["doc_id"], encoder().encode(cols["text"])):
            raw += end
            for piece, (start, length) in enumerate(cut(len(raw) // 4, limit)):
                part = raw[4 * start : 4 * (start + length)]
                for k, v in zip(PIECE_SCHEMA, (doc_id, piece, start, length, zlib.crc32(part))):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, np.int32))
        return {k: out[k] for k in schema}

    return map_batches(docs.select("doc_id", "text"), schema, rows)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min ||a x - b|| with x >= 0, by the active-set method of Lawson and Hanson.
    Its solutions have at most as many positive counts as ``a`` has rows."""
    n = a.shape[1]
    gram, ab = a.T @ a if n <= 2000 else None, a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    floor = 1e-9 * max(1.0, float(np.abs(ab).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        grad = ab - (gram @ x if gram is not None else a.T @ (a @ x))
        grad[active] = -np.inf
        best = int(np.argmax(grad))
        if grad[best] <= floor:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            sub = a[:, on]
            z = np.linalg.solve(sub.T @ sub + 1e-9 * np.eye(len(on)), sub.T @ b) if len(on) else np.zeros(0)
            if len(z) == 0 or z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            bad = z <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - z[bad], 1e-300))
            x[on] += step * (z - x[on])
            gone = on[bad & (x[on] <= 1e-9)]
            if not len(gone):
                gone = on[[int(np.argmin(z))]]
            x[gone] = 0
            active[gone] = False
    return x


def coarse_patterns(cells: int, depth: int = 4) -> list[tuple[int, ...]]:
    """Multisets of two to ``depth`` cells (ascending) that fill ``cells`` exactly;
    four-part patterns on every eighth cell only, which keeps the list short."""
    out = [(a, cells - a) for a in range(1, cells // 2 + 1)]
    if depth >= 3:
        out += [(a, b, cells - a - b) for a in range(1, cells // 3 + 1) for b in range(a, (cells - a) // 2 + 1)]
    if depth >= 4:
        q = cells // 8
        out += [
            (8 * a, 8 * b, 8 * c, cells - 8 * (a + b + c))
            for a in range(1, q // 4 + 1) for b in range(a, (q - a) // 3 + 1) for c in range(b, (q - a - b) // 2 + 1)
        ]
    return out


def plan(hist: dict[int, int], limit: int = LIMIT, grid: int = GRID) -> list[tuple[int, tuple[int, ...]]]:
    """(repeat count, lengths) patterns that use up the histogram exactly."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[limit]:
        out.append((int(left[limit]), (limit,)))
        left[limit] = 0
    grid = max(1, min(grid, limit // 8))
    cells = limit // grid
    cell_of = -(-np.arange(limit + 1) // grid)
    coarse = np.bincount(cell_of, weights=left, minlength=cells + 1)[: cells + 1]
    patterns = [p for p in coarse_patterns(cells) if all(coarse[list(p)] > 0)]
    if patterns:
        a = np.zeros((cells + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for cell in p:
                a[cell, j] += 1
        counts = nnls(a[1:], coarse[1:])
        stock = {cell: [n for n in range((cell - 1) * grid + 1, min(cell * grid, limit) + 1) if left[n]] for cell in range(1, cells + 1)}
        for j in np.argsort(-counts, kind="stable"):
            repeat = int(counts[j] + 1e-6)
            while repeat > 0:
                # the exact lengths that stand for this pattern now: the largest of each cell
                take: list[int] = []
                for cell in patterns[j]:
                    free = [n for n in stock[cell] if left[n] > take.count(n)]
                    if not free:
                        break
                    take.append(free[-1])
                if len(take) < len(patterns[j]):
                    break
                k = min(repeat, *(int(left[n]) // take.count(n) for n in take))
                for n in take:
                    left[n] -= k
                repeat -= k
                out.append((k, tuple(take)))
    return _best_fit(out, left, limit)


def _best_fit(done: list[tuple[int, tuple[int, ...]]], left: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put the residual lengths, longest first and in bulk, into the fullest open
    pattern with room for them, or into new sequences."""
    room: dict[int, list] = defaultdict(list)  # free tokens -> [count, lengths] of open patterns
    free = np.zeros(limit + 1, bool)
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(k: int, lengths: tuple[int, ...]) -> None:
        gap = limit - sum(lengths)
        if gap:
            room[gap].append((k, lengths))
            free[gap] = True
        else:
            full.append((k, lengths))

    for k, lengths in done:
        put(k, lengths)
    for n in range(limit, 0, -1):
        while left[n]:
            gaps = np.flatnonzero(free[n:])
            if len(gaps):
                gap = n + int(gaps[0])
                k, lengths = room[gap].pop()
                free[gap] = bool(room[gap])
                per = gap // n  # as many copies of this length as the room holds
                use = min(k, max(1, int(left[n]) // per))
                per = min(per, int(left[n]) // use)
                left[n] -= use * per
                put(use, lengths + (n,) * per)
                if k > use:
                    put(k - use, lengths)
            else:
                per = limit // n
                k = max(1, int(left[n]) // per)
                per = min(per, int(left[n]))
                left[n] -= k * per
                put(k, (n,) * per)
    return full + [x for open_ in room.values() for x in open_]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequence ids and offsets of the runs of places.
    Rank r of a length in the run that starts at rank f goes to sequence id + r - f."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for k, lengths in patterns:
        at = 0
        for n in lengths:
            runs[n].append((used[n], base, at))
            used[n] += k
            at += n
        base += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def place(pieces: DataFrame, limit: int = LIMIT, grid: int = GRID) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (a column ``length``
    of 1 to ``limit`` and the identifying columns doc_id and piece).

    Ranks within a length are counted in ``bucket`` parts of a bounded size, so a
    length that a third of all pieces have is spread over many tasks."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = slots(plan(hist, limit, grid))
    parts = max(shuffle_width(pieces.sparkSession), sum(hist.values()) // 50_000)
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(order) - 1)
        .join(before, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_before", "_part")
    )

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for value in np.unique(n):
            on = n == value
            first, base, at = runs[int(value)]
            run = np.searchsorted(first, r[on], side="right") - 1
            seq[on], off[on] = base[run] + r[on] - first[run], at[run]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_at", locate("length", "_rank")).select(
        *pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def pack(docs: DataFrame, limit: int = LIMIT, grid: int = GRID) -> DataFrame:
    """All pieces of ``docs`` (doc_id, text) with their places."""
    return place(materialise(token_pieces(docs, limit)), limit, grid)


def packed_sequences(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most ``limit`` a row)."""
    placed = place(materialise(token_pieces(docs, limit, with_ids=True)), limit)
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
