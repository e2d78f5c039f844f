"""Whitening, repeated substrings and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from engram.llm import substring_dedup, whitening
from engram.llm.fm_index import FMIndex
from engram.llm.periodic_runs import find_runs, runs_of
from engram.llm.substring_dedup import remove_repeats, segments, shard_spans, word_hashes

from .conftest import SF


def sha(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


# -- whitening ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "singular", "close", "diagonal"])
def test_components_are_eigenvectors(kind):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 40):
        e = {
            "random": rng.random(n), "graded": 10.0 ** rng.uniform(-12, 3, n), "equal": np.ones(n), "pairs": np.repeat(rng.random(n), 2)[:n],
            "singular": np.where(np.arange(n) % 2, 0, rng.random(n)), "close": 1 + 1e-9 * rng.random(n), "diagonal": rng.random(n),
        }[kind]
        q = np.eye(n) if kind == "diagonal" else np.linalg.qr(rng.standard_normal((n, n)))[0]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        values, unit = whitening.components(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        want = want[want > n * 2.3e-16 * np.trace(v)][:16]
        assert len(values) == len(want)
        top = max(want)
        assert np.abs(values - want).max() < 1e-12 * top
        assert np.abs(v @ unit - unit * values).max() < 1e-12 * top
        assert np.abs(unit.T @ unit - np.eye(len(values))).max() < 1e-12


def plain_whitening(rows: list[tuple]) -> dict:
    """By exact sums in Python numbers and numpy's own eigenvalues."""
    xs = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return {"n": n, "v": v, "e": e, "u": u, "deviation": {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs}, "z": {i: np.array([(n * a - s) / n for a, s in zip(x, sums)]) for i, x in xs}}


def check_whitening(out: list, rows: list[tuple], top: int) -> None:
    want = plain_whitening(rows)
    assert sorted((r["vec_id"], r["component"]) for r in out) == sorted((i, k) for i, _ in rows for k in range(1, top + 1))
    signs = {}
    for r in out:
        i, k = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (want["n"], want["deviation"][i])
        assert r["explained"] == pytest.approx(want["e"][k] / np.trace(want["v"]), rel=1e-9)
        assert r["identity_error"] < 1e-9
        plain = float(want["z"][i] @ want["u"][:, k] / np.sqrt(want["e"][k]))
        if abs(plain) > 0.1:
            signs.setdefault(k, r["whitened"] * plain > 0)
            assert signs[k] == (r["whitened"] * plain > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(plain), abs=1e-7)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(table).collect(), [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()], 16)


def test_whitening_edges(spark):
    rng = random.Random(4)
    good = [(k, [rng.uniform(-3, 3) for _ in range(3)]) for k in range(40)]
    good += [(100, good[0][1]), (101, good[0][1]), (77, [1e7, -1e7, 0.5])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [1.0, float("inf"), 0.0]), (204, []), (205, [1.0])]
    rows = [(i, v, "a", 1.0, "b") for i, v in good + bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened double, component string")
    out = whitening.whiten(table).collect()
    assert {r["vec_id"] for r in out} == {i for i, _ in good}
    want = plain_whitening([g for g in good])
    assert {(r["vec_id"], r["deviation"]) for r in out if r["vec_id"] != 77} == {(i, d) for i, d in want["deviation"].items() if i != 77 and d < 1 << 63}
    assert {r["deviation"] for r in out if r["vec_id"] == 77} == {None}  # needs more than a long
    assert {r["n"] for r in out} == {41}
    check_whitening(whitening.whiten(table.filter("vec_id <> 77")).collect(), [g for g in good if g[0] != 77], 3)
    # no variance, no components; and no rows at all
    assert whitening.whiten(table.filter("vec_id in (0, 100)")).count() == 0
    assert whitening.whiten(table.limit(0)).columns == whitening.whiten(table).columns
    assert whitening.whiten(table.limit(0)).count() == 0
    # two equal dimensions: one component less
    flat = spark.createDataFrame([(k, [float(k), float(k), float(k * k)]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1, 2}


# -- repeated substrings -----------------------------------------------------------------


def plain_removal(documents: list[tuple], width: int = 20) -> dict:
    """(doc_id, text) -> (n_words, n_removed, digest), by a table of all windows; documents
    in order of their ids, nulls last, then MD5."""
    first: dict = {}
    order = sorted(set(documents), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = {}
    for doc_id, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in first:
                gone[s : s + width] = [True] * width
            first.setdefault(window, 1)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id, text] = (len(words), len(words) - len(kept), sha(kept))
    return out


def removal(docs) -> list:
    return [((r["doc_id"], r["text"]), (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in docs.collect()]


def test_backward_search_counts_patterns():
    rng = np.random.default_rng(2)
    for width in (2, 3, 7, 16, 20):
        text = rng.integers(1, 4, 300)
        index = FMIndex(np.append(text, 0), 4, width)
        for _ in range(60):
            m = int(rng.integers(1, width + 1))
            pattern = text[(a := int(rng.integers(0, 300 - m))) : a + m] if rng.random() < 0.7 else rng.integers(1, 4, m)
            low, high = np.zeros(1, np.int64), np.full(1, 301)
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            found = [i for i in range(300 - m + 1) if (text[i : i + m] == pattern).all()]
            assert sorted(index.suffixes[low[0] : high[0]].tolist()) == found


def test_shard_search_against_all_windows():
    rng = random.Random(3)
    for _ in range(60):
        width = rng.choice([4, 8, 9, 20])
        base = [rng.randrange(50) for _ in range(200)]
        documents = []
        for _ in range(10):
            words = []
            for _ in range(rng.randint(0, 4)):
                a = rng.randrange(150)
                words += base[a : a + rng.randint(0, 60)] + [rng.randrange(50) for _ in range(rng.randint(0, 6))]
            documents.append(words + [7, 8, 9][: rng.randint(1, 3)] * rng.choice([0, 0, 0, 30]))
        texts = [" ".join(map(str, w)) for w in documents]
        words, first = word_hashes(texts)
        owner, start, size, _, _ = segments(words, first, width)
        gone = [[False] * len(w) for w in documents]
        if len(owner):
            content = np.concatenate([words[first[o] + s : first[o] + s + n] for o, s, n in zip(owner, start, size)])
            for k, at, n in zip(*shard_spans(owner, start, size, content, width)):
                gone[owner[k]][start[k] + at : start[k] + at + n] = [True] * n
        want = plain_removal(list(enumerate(texts)), width)
        assert [sha([w.encode() for w, g in zip(t.split(), x) if not g]) for t, x in zip(texts, gone)] == [want[r][2] for r in enumerate(texts)]


def test_removal_of_the_table_and_edges(docs, texts):
    kept = remove_repeats(docs)
    want = plain_removal(texts)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in kept.collect())
    assert got == sorted((str(d), *want[d, t], want[d, t][2]) for d, t in texts)
    assert sum(r[2] for r in got) > 0


def test_removal_of_hot_and_planted_passages(spark, monkeypatch):
    """A passage in half of all documents, whose edges would fill a shard; near copies;
    several texts under one id and without one."""
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2000)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [f"p{k}" for k in range(55)]
    base = [word() for _ in range(300)]
    rows = []
    for k in range(120):
        words = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if k % 5 == 0:
            near = list(base)
            near[rng.randrange(300)] = word()
            words = near
        rows.append((None if k % 17 == 3 else k // 2, " ".join(words)))
    rows += [(999, "a " * 500), (998, "a " * 19), (1000, "a " * 25), (2, rows[9][1]), (2, rows[9][1])]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain_removal(rows)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(frame).collect())
    assert got == sorted((str(d), *want[d, t]) for d, t in rows)


def test_removal_of_nothing(empty):
    assert remove_repeats(empty).count() == 0


# -- periodic runs -----------------------------------------------------------------------


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """By comparing the words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                run = words[i : i + size]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_distances():
    rng = random.Random(1)
    for _ in range(600):
        words = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.4 and len(words) > 20:
            a, p = rng.randrange(len(words) // 2), rng.randint(1, 12)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        both = [words, [rng.randrange(2) for _ in range(30)], words]
        assert runs_of(both) == [plain_runs(w) for w in both]


def plain_row(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(),
        sha([w for i, w in enumerate(words) if i not in gone]),
    )


def test_runs_of_the_table_and_edges(docs, spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in table if len((r[1] or "").split()) <= 600]
    assert len(short) > 100
    extra = [(30, "a b " * 40 + "c"), (31, "x " * 11), (32, "x " * 12), (33, ""), (34, None), (None, "q r s " * 9), (35, " \n "), (30, "a b " * 40 + "c")]
    rows = short + extra
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_runs int, period string").repartition(3)
    got = sorted(map(str, map(tuple, find_runs(frame).collect())))
    assert got == sorted(str(plain_row(*r)) for r in rows)
    assert find_runs(docs).count() == docs.count()
    assert find_runs(docs.limit(0)).count() == 0


def test_long_periodic_texts(spark):
    """Texts that repeat from end to end, or hardly."""
    rng = random.Random(6)
    texts = ["a " * 30000, " ".join(f"w{k % 700}" for k in range(30000)), " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(30000))]
    rows = {r["doc_id"]: r for r in find_runs(spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert (rows[1]["n_runs"], rows[1]["start"], rows[1]["length"], rows[1]["period"], rows[1]["exponent_milli"]) == (1, 0, 30000, 1, 30000000)
    assert (rows[2]["n_runs"], rows[2]["length"], rows[2]["period"]) == (1, 30000, 700)
    assert rows[3]["n_runs"] == 0
    assert not any(zlib.crc32(str(k).encode()) % 10 == 0 for k in (1, 2, 3))
