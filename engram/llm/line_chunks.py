"""Removal of repeated passages by content-defined chunks of lines.

Boundaries depend on the lines around them alone, so they shift with the text: a line of
``WINDOW`` words or more has one before and one after it; among shorter lines, every
window of ``WINDOW`` words has one where a rolling hash over the hashes of two lines is
least.  A chunk is the shortest run from a boundary to another that has two or more
lines and ``MIN_WORDS`` words, or one line of ``HEAVY`` words.

Chunks that occur more than once anywhere are kept where they come first (by doc_id, text
digest and position) and removed elsewhere: neighbouring chunks with neighbouring first
places are joined, their bytes must equal those kept, and then the run grows line by line
both ways as long as the lines are equal, to the ends of the passage.  Each line removed
has its equal at an earlier place, so nothing vanishes altogether.

Edge cases: null and empty texts stay as they are; a document whose chunks all
occur earlier ends up empty, not dropped; rows equal in doc_id and text are one
document listed twice and are edited alike; a chunk that overlaps its own first
place in a document (lines repeated at once) stays; null doc_ids come last; extra
columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _POWERS, U64, map_batches, materialise, mix, span_hashes

HEAVY = 30
MIN_WORDS = 20
WINDOW = 10
GROW_WORDS, GROW_LINES = 40, 60  # how far beyond a run lines are compared; another chunk lies nearer


def boundaries(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The lines (or the end) before which a chunk may begin or end, ascending, from the
    lines' hashes and numbers of words."""
    n = len(h)
    cut = np.zeros(n + 1, bool)
    big = words >= WINDOW
    cut[:-1] |= big
    cut[1:] |= big
    if not big.all():
        rolled = mix(h * U64(0xE7037ED1A0B428DB) + np.append(h[1:], U64(0))).tolist()
        total = np.concatenate(([0], np.cumsum(words)))
        last = np.searchsorted(total, total[:-1] + WINDOW) - 1  # the line that fills the window
        for i in np.flatnonzero((last < n - 1) & ~big).tolist():  # the hash takes in the next line
            at = range(i, int(last[i]) + 1)
            if not big[i : at.stop].any():
                cut[min(at, key=rolled.__getitem__)] = True
    return np.flatnonzero(cut)


def chunk_lines(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunks of a text, by their lines: first lines, ends (one past the last line),
    and 128-bit hashes (two columns; zeros for those that overlap their first place)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    n = len(lines)
    raw = np.frombuffer(b"\n".join(lines), np.uint8)
    size = np.array([len(x) for x in lines])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    words = np.array([len(x.split()) for x in lines])
    h = span_hashes(raw, start, start + size) if len(raw) else np.zeros(n, U64)
    total = np.concatenate(([0], np.cumsum(words)))
    marks = boundaries(h, words)
    at = marks[marks < n]
    # the first boundary that gives two lines and enough words, or a heavy line alone
    least = np.maximum(at + 2, np.searchsorted(total, total[at] + MIN_WORDS))
    where = np.searchsorted(marks, np.where(words[at] >= HEAVY, at + 1, least))
    at, to = at[where < len(marks)], marks[where[where < len(marks)]]
    # a run's hash is a difference of prefix sums, scaled back to its first line
    _POWERS.grow(n + 1)
    keys = np.zeros((len(at), 2), U64)
    for k, salt in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix(h + U64(salt)) * _POWERS.up[:n], out=sums[1:])
        keys[:, k] = mix((sums[to] - sums[at]) * _POWERS.down[at] + (to - at).astype(U64) * U64(salt))
    if len(at):
        _, first, same = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        first = first[same]
        keys[(np.arange(len(at)) > first) & (at < to[first])] = 0
    return at, to, keys


def _reach(lines: list[str], at: int, step: int) -> int:
    """The line up to which a run that ends at line ``at`` may grow."""
    words = 0
    for _ in range(GROW_LINES):
        if words > GROW_WORDS or not 0 <= at + step < len(lines):
            break
        at += step
        words += len(lines[at].split())
    return at


def _same(lines: list[str], a: int, b: int, kept: list[str], ahead: int) -> range:
    """The lines around the run a to b that equal the kept ones (``kept`` has ``ahead`` lines
    before the run); none if the run itself differs."""
    if lines[a:b] != kept[ahead : ahead + b - a]:
        return range(0)
    to = ahead + b - a
    while a and ahead and lines[a - 1] == kept[ahead - 1]:
        a, ahead = a - 1, ahead - 1
    while b < len(lines) and to < len(kept) and lines[b] == kept[to]:
        b, to = b + 1, to + 1
    return range(a, b)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the rest of the caller's row as one column, so that none of its names
    can meet one of ours; _td and _id name the document."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    named = docs.select("doc_id", "text", row).withColumn("_td", F.unhex(F.md5("text")))
    return named.withColumn("_id", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("_td")))))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with edited text, and n_lines, n_removed (lines); a caller's columns of these
    two names give way to them."""
    done = edit_rows(docs)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c == "text" or c in rest], "n_lines", "n_removed")


def edit_rows(docs: DataFrame) -> DataFrame:
    """row (the caller's columns but text), text (edited), n_lines, n_removed."""
    named = _identified(docs)

    def split(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_id": [], "doc_id": [], "pos": [], "end": [], "key": []}
        for uid, doc_id, text in zip(cols["_id"], cols["doc_id"], cols["text"]):
            if text:
                at, to, keys = chunk_lines(text)
                for i in np.flatnonzero(keys.any(axis=1)):
                    for k, v in zip(out, (uid, doc_id, int(at[i]), int(to[i]), keys[i].tobytes())):
                        out[k].append(v)
        return out

    schema = {"_id": "binary", "doc_id": "long", "pos": "int", "end": "int", "key": "binary"}
    chunks = materialise(map_batches(named.select("_id", "doc_id", "text"), schema, split))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("_id").alias("u"), F.col("pos").alias("p"))
    # rows that repeat a document have the same places
    repeated = chunks.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last")
    later = chunks.join(repeated, "key").filter((F.col("_id") != F.col("first.u")) | (F.col("pos") != F.col("first.p")))
    # chunks that meet or overlap, and do so where they come first, are one run
    near = Window.partitionBy("_id", "u", "shift").orderBy("pos", "end")
    so_far = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    later = later.select("_id", "pos", "end", F.col("first.u").alias("u"), (F.col("first.p") - F.col("pos")).alias("shift"))
    later = later.withColumn("new", F.coalesce((F.col("pos") > so_far).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(near))
    runs = later.groupBy("_id", "u", "shift", "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    runs = materialise(runs.select("_id", "u", "pos", "end", (F.col("pos") + F.col("shift")).alias("p"), (F.col("end") + F.col("shift")).alias("e")))
    # the bytes that are kept: read again from the documents that have them
    keepers = runs.select("u", "p", "e").distinct().groupBy(F.col("u").alias("_id")).agg(F.collect_list(F.struct("p", "e")).alias("k"))

    def kept(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"u": [], "p": [], "e": [], "ahead": [], "bytes": []}
        for uid, text, wanted in zip(cols["_id"], cols["text"], cols["k"]):
            lines = text.split("\n")
            for x in wanted:
                a, b = _reach(lines, x["p"], -1), _reach(lines, x["e"] - 1, 1) + 1
                for k, v in zip(out, (uid, x["p"], x["e"], x["p"] - a, "\n".join(lines[a:b]).encode("utf-8", "surrogatepass"))):
                    out[k].append(v)
        return out

    first_text = named.join(keepers, "_id").dropDuplicates(["_id"]).select("_id", "text", "k")
    originals = materialise(map_batches(first_text, {"u": "binary", "p": "int", "e": "int", "ahead": "int", "bytes": "binary"}, kept))
    later = runs.join(originals, ["u", "p", "e"]).groupBy("_id").agg(F.collect_list(F.struct("pos", "end", "ahead", "bytes")).alias("_later"))
    edited = named.join(later, "_id", "left")

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def edit(text, later):
        import pandas as pd

        out = []
        for t, gone in zip(text, later):
            if t is None:
                out.append((None, 0, 0))
                continue
            lines = t.split("\n")
            drop: set[int] = set()
            if gone is not None and len(gone):
                for x in gone:
                    drop.update(_same(lines, x["pos"], x["end"], bytes(x["bytes"]).decode("utf-8", "surrogatepass").split("\n"), x["ahead"]))
            out.append((t if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    return edited.withColumn("_e", edit("text", "_later")).select("row", "_e.text", "_e.n_lines", "_e.n_removed")
