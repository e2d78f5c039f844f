"""Toxicity score: counterfactual-regularised logistic regression.

Features are the distinct lower-cased words of a text and their beginnings of 4,
5 and 6 bytes, hashed.  The classifier is fitted on a bounded sample of labelled
rows (at most ``MAX_TOXIC`` and ``MAX_CLEAN``, those with the least hash of their
doc_id; of rows that repeat a doc_id the one with the least text).  Wherever a labelled sentence names a group, the name is swapped for the
others of its list, and the squared change of the score is penalised: what a
group name alone adds to the score vanishes, so neutral mentions aren't flagged.

Edge cases: null, empty and wordless texts get the score of no evidence; whole
texts are read; without labelled rows of both kinds every score is the share of
toxic ones (0 without labels); a doc_id labelled twice is toxic if any label
says so; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, map_batches, materialise, separators, span_hashes, word_spans

BITS = 20
PREFIXES = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 2500, 5000
FEATURES = 1024
MIN_DOCS = 4
MIN_Z = 3.0  # standard deviations from chance
THRESHOLD = 0.7
RIDGE = 1e-4
COUNTERFACTUAL = 1.0

# Group names that may stand for each other in a sentence.
GROUPS = tuple(tuple(line.split()) for line in (
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "gay straight lesbian bisexual queer heterosexual",
    "women men girls boys",
    "woman man girl boy transgender",
    "black white asian latino african european american arab",
    "immigrants refugees foreigners natives citizens",
    "blind deaf disabled elderly young old",
    "frauen männer mädchen jungen", "muslime christen juden", "ausländer flüchtlinge einwanderer",
    "mujeres hombres niñas niños", "musulmanes cristianos judíos", "inmigrantes refugiados extranjeros",
    "femmes hommes filles garçons", "musulmans chrétiens juifs", "immigrés réfugiés étrangers",
))
_BREAKS = separators(bytes(c for c in range(128) if not 97 <= c < 123))


def _raw_ids(text: str | None) -> np.ndarray:
    raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = word_spans(raw, _BREAKS)
    hashes = span_hashes(raw, starts, ends, PREFIXES)
    size = ends - starts
    parts = [hashes[0]] + [hashes[k][size > n] ^ U64(k << 44) for k, n in enumerate(PREFIXES, 1)]
    return (np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64)


def feature_ids(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a text."""
    return np.unique(_raw_ids(text))


def swaps(text: str | None, groups=GROUPS) -> list[tuple[str, str]]:
    """(name, other name) for every group name in a sentence of the text."""
    names = {n: g for g in groups for n in g}
    out = []
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        here = {w for w in re.findall(r"[^\W\d_]+", sentence) if w in names}
        out += [(w, o) for w in here for o in names[w] if o != w and o not in here]
    return out


class Model:
    """Weights of the chosen features and the bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.ids, self.weights, self.bias = ids, weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def _constant(share: float, n: int) -> Model:
    """Without rows of both kinds every score is the share of toxic ones."""
    return Model(np.zeros(0, np.int64), np.zeros(0), 12.0 * (share > 0) - 6.0 if n else -np.inf)


def _choose(n_all: np.ndarray, n_pos: np.ndarray, share: float, kinds: dict[tuple[str, str], int]) -> np.ndarray:
    """The at most FEATURES features to fit, ascending: those of swapped names, and those whose
    share of toxic documents lies farthest from the overall one."""
    z = np.abs(n_pos - n_all * share) / np.sqrt(n_all * share * (1 - share) + 1)
    z[(n_all < MIN_DOCS) | (z < MIN_Z)] = -1
    for pair in kinds:
        for name in pair:
            z[feature_ids(name)] = np.inf
    ids = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    return ids[z[ids] > 0]


def fit(texts: list[str | None], toxic: list[int], groups=GROUPS, strength: float = COUNTERFACTUAL, rounds: int = 1000) -> Model:
    """Fit on the given rows."""
    y = np.array(toxic, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return _constant(share, len(y))
    rows = [feature_ids(t).astype(np.int32) for t in texts]
    n_pos, n_all = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for ids, mark in zip(rows, y):  # the numbers of a row are distinct
        n_all[ids] += 1
        n_pos[ids] += mark
    kinds: dict[tuple[str, str], int] = {}
    for t in texts:
        for p in swaps(t, groups):
            kinds[p] = kinds.get(p, 0) + 1
    return _descend(_choose(n_all, n_pos, share, kinds), n_all, n_pos, rows, y, kinds, strength, rounds)


def _descend(ids: np.ndarray, n_all: np.ndarray, n_pos: np.ndarray, rows: list[np.ndarray], y: np.ndarray, kinds: dict[tuple[str, str], int],
             strength: float, rounds: int) -> Model:
    """Gradient descent with momentum on the sparse matrix of the chosen features.  ``kinds``
    has each kind of swap with its count."""
    share = float(y.mean())
    named = {n: feature_ids(n) for p in kinds for n in p}
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    # log count ratios scale the features: rare ones move the score less
    ratio = np.log((n_pos[ids] + 1) / (y.sum() + 2)) - np.log((n_all[ids] - n_pos[ids] + 1) / ((1 - y).sum() + 2))
    cols = [place[r][place[r] >= 0] for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)
    # differences of counterfactual sentences: one row per kind of swap
    diff = np.zeros((len(kinds), len(ids))) if kinds else None
    times = np.array(list(kinds.values()), np.float64)
    for k, (a, b) in enumerate(kinds):
        for name, sign in ((a, 1.0), (b, -1.0)):
            at = place[named[name]]
            diff[k, at[at >= 0]] += sign * ratio[at[at >= 0]]
    weights, bias = np.zeros(len(ids)), float(np.log(share / (1 - share)))
    push, push_bias = np.zeros(len(ids)), 0.0
    # each class weighs half, and steps are scaled by a bound of the curvature
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    value = ratio[col]
    most = max(1, np.bincount(row).max(initial=1))
    curve = np.bincount(col, weights=each[row] * value**2, minlength=len(ids)) * 0.25 * min(most, 40) + RIDGE
    if kinds:
        curve = curve + 2 * strength * (times / times.sum()) @ np.abs(diff) * np.abs(diff).sum(1).max()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=weights[col] * value, minlength=len(rows)), -30, 30)))
        error = (p - y) * each
        grad = np.bincount(col, weights=error[row] * value, minlength=len(ids)) + RIDGE * weights
        if kinds:
            grad = grad + strength * diff.T @ (times / times.sum() * (diff @ weights))
        push = 0.9 * push - 0.3 * grad / curve
        push_bias = 0.9 * push_bias - 0.3 * error.sum() / 0.25
        weights, bias = weights + push, bias + push_bias
    return Model(ids, weights * ratio, bias)


def _bounded(labelled: DataFrame, kind: int, most: int) -> DataFrame:
    return labelled.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, groups=GROUPS, strength: float = COUNTERFACTUAL) -> Model:
    """Fit on the labelled documents for which ``usable`` (a condition on doc_id) holds."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(usable) if usable is not None else known
    chosen = _bounded(known, 1, MAX_TOXIC).unionByName(_bounded(known, 0, MAX_CLEAN))
    # at most MAX_TOXIC + MAX_CLEAN ids: broadcast, so that the documents stay where they are
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def features(cols: dict[str, list]) -> dict[str, list]:
        named = ["\n".join(f"{a} {b}" for a, b in swaps(t, groups)) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "toxic": cols["toxic"], "ids": [feature_ids(t) for t in cols["text"]], "swaps": named}

    rows = materialise(map_batches(sample, {"doc_id": "long", "toxic": "int", "ids": "array<int>", "swaps": "string"}, features))
    # texts stay in the tasks: counts by feature (2**BITS at most), kinds of swaps (pairs of the
    # lists) and the chosen features of each row (FEATURES at most) come to the driver
    marks = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in marks)
    share = sum(r["n"] for r in marks if r["toxic"]) / total if total else 0.0
    if not 0 < share < 1:
        return _constant(share, total)
    counts = rows.select(F.explode("ids").alias("id"), "toxic").groupBy("id").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).toPandas()
    n_all, n_pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    n_all[counts["id"]], n_pos[counts["id"]] = counts["n"], counts["k"]
    pairs = rows.filter("swaps <> ''").select(F.explode(F.split("swaps", "\n")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    kinds = {tuple(r["p"].split(" ")): r["n"] for r in pairs.sort("p").collect()}
    ids = _choose(n_all, n_pos, share, kinds)
    wanted = F.array(*[F.lit(int(i)) for i in ids]) if len(ids) else F.array().cast("array<int>")
    few = rows.select("doc_id", "toxic", F.array_intersect("ids", wanted).alias("ids")).sort("doc_id").toPandas()
    return _descend(ids, n_all, n_pos, [np.array(x, np.int32) for x in few["ids"]], few["toxic"].to_numpy(np.float64), kinds, strength, 1000)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the score of every row."""
    table = docs.sparkSession.sparkContext.broadcast((model.table(), float(model.bias)))  # 4 MB whatever the data

    @F.pandas_udf("double")
    def value(text):
        import pandas as pd

        weights, bias = table.value
        out = []
        for t in text:
            ids = _raw_ids(t)
            out.append(bias + float(weights[np.unique(ids[weights[ids] != 0])].sum()))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500))))

    return docs.select(*keep, value("text").alias("score"))


def held_out() -> Column:
    """The rows that no model may learn from: crc32 of the doc_id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = train(docs, labels, ~held_out())
    return score(docs, model, ("doc_id",)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
