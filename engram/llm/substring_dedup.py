"""Removal of repeated word sequences by FM-indexes of shards.

A window is ``width`` words in a row.  Every word goes that some window covers whose
sequence also starts earlier: in a document of a smaller doc_id, or before in its own.

Windows that may be equal must meet in one shard, so documents are cut by content: each
window goes by the least hash of its ``GRAM``-word grams, and windows in a row around the
same gram are a segment, of ``2 * width - GRAM`` words at most.  Equal windows have it at
the same place, so they are in different segments of one gram; segments whose gram is in
no other one drop out.  Equal segments are merged before anything is gathered: all but the first lose their
words, so a passage in many documents is indexed once.  What is left, different segments
with a common gram, is dealt to shards by gram.  Each shard builds a compressed FM-index
(suffix order, wavelet matrix) of its segments and streams them from right to left
through backward search: a step drops the last word of the window and puts the next one
before it.  The interval of a full window holds all places of it; where the least of
them lies before the window's own, the window is reported, and windows in a row are one
span.

Grams with more than ``HOT`` different segments (say, the edges of a passage in a third
of all documents) would fill one shard: their windows are cut once more, by all of their
words, and merged in the same way as equal segments, which settles them.

Words go by 64-bit hashes, segments by 128 bits, and rows by doc_id and 64 bits of the
text's MD5.

Edge cases: null, empty and blank texts have no words, texts below ``width`` words no
windows; rows equal in doc_id and text are one document listed twice and are edited
alike; different texts under one doc_id come in the order of their MD5; null doc_ids come
last; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _POWERS, SPACES, U64, discard, map_batches, materialise, mix, ship_package, span_hashes, store, word_spans
from .fm_index import FMIndex

WIDTH = 20
GRAM = 8
HOT = 1024  # different segments of a gram in a shard
SHARD_WORDS = 1 << 19
NO_ID = (1 << 63) - 1
_SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Runs:
    """Hashes of word runs from prefix sums over word hashes."""

    def __init__(self, words: np.ndarray, salt: int) -> None:
        n = len(words)
        _POWERS.grow(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(mix(words + U64(salt)) * _POWERS.up[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mix((self.sums[to] - self.sums[at]) * _POWERS.down[at] + (to - at).astype(U64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of the first word of each text
    (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends = word_spans(raw, SPACES)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    return span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, U64), np.searchsorted(starts, offsets)


def segments(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of the texts' segments: text number, first word in the text, number of words, gram
    hash and run hash."""
    n = len(words) - width + 1
    empty = np.zeros(0, np.int64)
    if n < 1:
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    gram = min(GRAM, width)
    each = np.arange(len(words) - gram + 1)
    # the leftmost least of ``width - gram + 1`` grams, by doubling
    value = _Runs(words, _SALTS[0]).of(each, each + gram)

    def meet(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(value[left] <= value[right], left, right)

    least, span, want = each, 1, width - gram + 1
    while span * 2 <= want:
        least, span = meet(least[: len(least) - span], least[span:]), span * 2
    if span < want:
        least = meet(least[: len(least) - (want - span)], least[want - span :])
    owner = np.searchsorted(first, np.arange(n), side="right") - 1
    at = np.flatnonzero(np.arange(n) + width <= first[owner + 1])
    if not len(at):
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    begin = np.flatnonzero(np.concatenate(([True], (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]))))
    start = at[begin]
    size = np.diff(np.concatenate((begin, [len(at)]))) + width - 1
    return owner[start], start - first[owner[start]], size, value[least[start]], _Runs(words, _SALTS[1]).of(start, start + size)


def shard_spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first word in it, number of words) of the spans of segments to remove.
    ``doc`` numbers the segments' documents in order, ``start`` is their place there, and
    ``words`` holds their words' hashes one after the other."""
    k = len(size)
    _, number = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + k, np.int64)  # 0 ends a segment
    owner = np.repeat(np.arange(k), size)
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    place = np.arange(len(words)) + owner
    text[place] = number + 1
    index = FMIndex(text, int(number.max()) + 2, width)
    # the least place of each full window, by groups of equal windows
    far = np.iinfo(np.int64).max
    reach = int(start.max() + size.max()) + 1
    own = np.full(len(text), far)
    own[place] = doc[owner] * reach + start[owner] + (place - first[owner])
    groups = np.flatnonzero(np.concatenate(([True], np.diff(index.group) != 0)))
    least = np.minimum.reduceat(own[index.suffixes], groups)[index.group]
    # all segments together, one word to the left at a time, the longest ones first
    order = np.argsort(-size, kind="stable")
    low, high = np.zeros(k, np.int64), np.full(k, len(text))
    later = np.zeros(len(text), bool)
    for step in range(int(size.max())):
        live = int(np.searchsorted(-size[order], -step, side="left"))
        who = order[:live]
        at = first[who] + size[who] - 1 - step
        if step >= width:
            low[:live], high[:live] = index.shorten(low[:live])
        low[:live], high[:live] = index.extend(text[at], low[:live], high[:live])
        if step >= width - 1:
            later[at] = least[low[:live]] < own[at]
    hit = np.flatnonzero(later)
    if not len(hit):
        return hit, hit, hit
    begin = np.concatenate(([True], np.diff(hit) != 1))
    head = hit[begin]
    tail = hit[np.concatenate((begin[1:], [True]))]
    which = np.searchsorted(first, head, side="right") - 1
    return which, head - first[which], tail - head + width


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(F.md5(F.coalesce("text", F.lit("")))).alias("t"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "d", F.coalesce("doc_id", F.lit(NO_ID))
    )


_LIGHT = {"m": "long", "a": "long", "d": "long", "t": "long", "start": "int", "size": "int"}


def _cut(keyed: DataFrame, width: int) -> DataFrame:
    """One row per segment: gram, run hash, place, number of words."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        owner, start, size, m, a = segments(*word_hashes(cols["text"]), width)
        d, t = np.array(cols["d"], np.int64), np.array(cols["t"], np.int64)
        return {"m": m.view(np.int64), "a": a.view(np.int64), "d": d[owner], "t": t[owner], "start": start, "size": size}

    return map_batches(keyed.select("d", "t", "text"), _LIGHT, rows)


def _merge(places: DataFrame) -> DataFrame:
    """One row per different segment, with its first place; ``many`` if it has others."""
    place = F.struct("d", "t", "start")
    merged = places.groupBy("m", "a").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.first("size").alias("size"))
    return merged.select("m", "a", "p", "size", (F.col("p") != F.col("q")).alias("many"))


def _not_first(places: DataFrame, merged: DataFrame) -> DataFrame:
    """The places of segments that have an earlier one."""
    return places.join(merged.filter("many").select("m", "a", "p"), ["m", "a"]).filter(F.struct("d", "t", "start") != F.col("p")).select("d", "t", "start", "size")


def _unique_texts(keyed: DataFrame) -> DataFrame:
    return keyed.select("d", "t", "text").dropDuplicates(["d", "t"])


_CONTENT = _LIGHT | {"words": "binary"}


def _contents(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The words of the wanted segments (d, t, start, size, m, hot); of hot ones each
    window instead, as a segment of its own that goes by all of its words."""
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("start", "size", "m", "hot")).alias("k"))

    def rows(cols: dict[str, list]) -> dict[str, list]:
        words, first = word_hashes(cols["text"])
        one, two = _Runs(words, _SALTS[0]), _Runs(words, _SALTS[1])
        out: dict[str, list] = {k: [] for k in _CONTENT}
        for d, t, base, segs in zip(cols["d"], cols["t"], first.tolist(), cols["k"]):
            for s in segs:
                at, size = base + s["start"], s["size"]
                if not s["hot"]:
                    found = [(s["m"], 0, s["start"], size, words[at : at + size].tobytes())]
                else:
                    w = np.arange(at, at + size - width + 1)
                    keys = (r.of(w, w + width).view(np.int64).tolist() for r in (one, two))
                    found = [(m, a, x - base, width, None) for m, a, x in zip(*keys, w.tolist())]
                for m, a, start, n, content in found:
                    for k, v in zip(_CONTENT, (m, a, d, t, start, n, content)):
                        out[k].append(v)
        return out

    return map_batches(texts.join(lists, ["d", "t"]), _CONTENT, rows)


def _search(contents: DataFrame, width: int) -> DataFrame:
    """The spans to remove of segments whose windows are found earlier in their shard."""
    ship_package(contents.sparkSession)
    total = contents.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = contents.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(total // SHARD_WORDS + 1)))
    fields = [("d", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("size", pa.int32())]

    def run(table: pa.Table) -> pa.Table:
        d, t, start, size = (table.column(c).to_numpy() for c in ("d", "t", "start", "size"))
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), U64)
        order = np.lexsort((t, d))
        doc = np.empty(len(d), np.int64)
        doc[order] = np.concatenate(([0], np.cumsum((np.diff(d[order]) != 0) | (np.diff(t[order]) != 0))))
        which, at, n = shard_spans(doc, start.astype(np.int64), size.astype(np.int64), words, width)
        cols = (d[which], t[which], start[which] + at, n)
        return pa.table({k: pa.array(v, ty) for (k, ty), v in zip(fields, cols)})

    return shards.select("shard", "d", "t", "start", "size", "words").groupBy("shard").applyInArrow(run, "d long, t long, start int, size int")


def repeated_spans(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(d, t, spans): for each document (d, t) with repeated windows, the word spans (start,
    size) that they cover; spans may overlap."""
    every, folder = store(_cut(keyed, width))
    # stored before it is joined: a plain join of two tables can split a hot gram
    shared = materialise(every.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"))
    places = materialise(every.join(shared, "m", "left_semi"))
    discard(keyed.sparkSession, folder)  # the largest intermediate table
    merged = materialise(_merge(places))
    per_gram = merged.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1")
    wanted = merged.join(per_gram, "m").select("p.d", "p.t", "p.start", "size", "m", (F.col("c") > HOT).alias("hot"))
    contents = materialise(_contents(_unique_texts(keyed), wanted, width))
    windows = contents.filter("words is null").drop("words")
    found = _search(contents.filter("words is not null"), width)
    gone = _not_first(places, merged).unionByName(_not_first(windows, _merge(windows))).unionByName(found)
    return gone.groupBy("d", "t").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def _kept(words: list, spans: list) -> list:
    if not spans:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[s["start"] + s["size"]] -= 1
    return [w for w, c in zip(words, np.cumsum(change).tolist()) if c <= 0]


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by one
    space) of every row of ``docs`` (doc_id, text)."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, width)
    schema = {"d": "long", "t": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "binary"}

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema}
        for d, t, text, gone in zip(cols["d"], cols["t"], cols["text"], cols["spans"]):
            words = text.encode("utf-8", "surrogatepass").split()
            kept = _kept(words, gone)
            joined = b" ".join(kept)
            for k, v in zip(schema, (d, t, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined)):
                out[k].append(v)
        return out

    edited = map_batches(_unique_texts(keyed).join(spans, ["d", "t"], "left"), schema, rows)
    return keyed.select("doc_id", "d", "t").join(edited, ["d", "t"]).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"))
