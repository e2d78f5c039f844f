"""Periodic runs of words by a descending-LCP Kruskal.

Every suffix of a document's word sequence is a class of its own at first.  Suffixes
that are neighbours in suffix order are edges weighted by their longest common
prefix (LCP); taken by decreasing LCP, they unite classes in a union-find whose
classes are ordered position sets, the smaller set merged into the larger.  Two
positions that become neighbours across such a merge share exactly the merge's LCP;
where their distance is no more than that, the words between them repeat at once,
and the pair seeds a run: it starts at the first position if the words before the
two differ, its period is the distance, and its length is distance plus LCP.  (A
position between them would have been in one of the two sets already, so the period
is the smallest one.)

A run of length at least ``max(MIN_LENGTH, 2 * period)`` has an LCP of at least half
of ``MIN_LENGTH``, so documents in which no sequence of that many words occurs twice
have none and skip the sort, and edges below it are left out.

Documents are independent: there is no shuffle.  A batch of a few MB is sorted at
once, with words of different documents kept apart.

Edge cases: null, empty and blank texts have no words and no runs; rows that repeat a
document give equal rows; a null doc_id counts as one whose words aren't replaced;
whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, map_batches, mix

MIN_LENGTH = 12


def planted(words: list, doc_id: int | None) -> list:
    """The words with the tail of every tenth document (by checksum of its id) made periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def _gram_repeats(symbols: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Whether a sequence of ``width`` symbols (within one owner) begins here that begins
    elsewhere as well."""
    n = len(symbols) - width + 1
    out = np.zeros(len(symbols), bool)
    if n <= 1:
        return out
    total = np.zeros(n, U64)
    for i in range(width):
        total = mix(total * U64(0xE7037ED1A0B428DB) + symbols[i : i + n])
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = whole[np.argsort(total[whole], kind="stable")]
    same = total[order[1:]] == total[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def suffix_edges(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes (i, j) in suffix order whose LCP is at least ``least``, and
    that LCP, by prefix doubling.  ``symbols`` are whole numbers >= 0."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, width = [rank.astype(np.int64)], 1
    while True:
        # a suffix that ends within ``width`` words comes first, and equals no other
        rest = np.full(n, -1, np.int64)
        rest[: max(n - width, 0)] = ranks[-1][width:]
        both = ranks[-1] * (n + 2) + (rest + 1)
        order = np.argsort(both, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = (both[order[1:]] != both[order[:-1]]) | (rest[order[1:]] < 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step) - 1
        width *= 2
        ranks.append(rank)
        if step.all():
            break
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        lcp[same] += 1 << k
    keep = lcp >= least
    return i[keep], j[keep], lcp[keep]


def kruskal_runs(symbols: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``least`` symbols, in order
    of start and period.  No two symbols of different documents may be equal."""
    half = (least + 1) // 2
    at, to, lcps = suffix_edges(symbols, half)
    order = np.argsort(-lcps, kind="stable")
    edges = zip(at[order].tolist(), to[order].tolist(), lcps[order].tolist())
    before = np.concatenate(([-1], symbols[:-1])).tolist()
    parent: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    runs: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i: int, j: int, lcp: int) -> None:
        d = j - i
        if d <= lcp and d + lcp >= least and (i == 0 or before[i] != before[j]):
            runs.append((i, d + lcp, d))

    for x, y, lcp in edges:
        a, b = root(x), root(y)
        if a == b:
            continue
        large, small = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        places = [bisect_left(large, s) for s in small]
        last = len(small) - 1
        for k, (s, p) in enumerate(zip(small, places)):
            # only pairs that nothing of either set lies between
            if p and (k == 0 or places[k - 1] != p):
                seed(large[p - 1], s, lcp)
            if p < len(large) and (k == last or places[k + 1] != p):
                seed(s, large[p], lcp)
        if len(small) * 32 < len(large):
            for shift, (s, p) in enumerate(zip(small, places)):
                large.insert(p + shift, s)
        else:
            large.extend(small)
            large.sort()
        parent[b] = a
        sets[a] = large
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(documents: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs of each word sequence."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    owner = np.repeat(np.arange(len(documents)), sizes)
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in documents for w in d), np.int64, int(sizes.sum()))
    repeats = _gram_repeats(ids.astype(U64) + owner.astype(U64) * U64(len(number)), owner, MIN_LENGTH // 2)
    chosen = np.flatnonzero(np.bincount(owner[repeats], minlength=len(documents)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    if not len(chosen):
        return out
    symbols = np.concatenate([ids[first[k] : first[k + 1]] + k * len(number) for k in chosen.tolist()])
    begin = np.concatenate(([0], np.cumsum(sizes[chosen])))
    for start, length, period in kruskal_runs(symbols):
        k = int(np.searchsorted(begin, start, side="right")) - 1
        out[chosen[k]].append((start - int(begin[k]), length, period))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(change).tolist()) if c <= 0]


SCHEMA = {
    "doc_id": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
    "runs_sha256": "string", "collapsed_sha256": "string",
}


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its runs counted and digested, the longest one, and the digest
    of the text without repetitions."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        words = [planted((t or "").encode("utf-8", "surrogatepass").split(), d) for d, t in zip(cols["doc_id"], cols["text"])]
        out: dict[str, list] = {k: [] for k in SCHEMA}
        for doc_id, ws, runs in zip(cols["doc_id"], words, runs_of(words)):
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            kept = b" ".join(collapse(ws, runs))
            row = (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
            for k, v in zip(SCHEMA, row):
                out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "text"), SCHEMA, rows)
