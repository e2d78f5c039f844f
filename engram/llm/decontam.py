"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased; ASCII letters and digits and all
characters beyond ASCII make words).  The windows of the benchmark (ten
consecutive words of an item; a shorter item whole) go into one automaton over
words: each word of the benchmark is one whole number, any other word is a number that
no window holds.  One pass over a document finds every occurrence; the hit words
map back to character spans of the original text.

The automaton is built in each worker from the items, whose size is checked:
above ``ITEM_BYTES`` of benchmark text, the items are dealt into slices of about
that size.  The driver holds one slice at a time and broadcasts it; the hits of
each are stored before the next, and united per document.

Edge cases: null, empty or wordless texts and items have no words, windows or
hits; a hit of an item without an id counts, but names no item (as in the SQL); overlapping and repeated windows count a word once; items with equal
windows are all reported; rows that repeat a doc_id and text agree; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

WINDOW = 10
ITEM_BYTES = 3 << 20  # a few hundred MB of automaton in each worker
_ASCII = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_OTHER = 0


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Windows:
    """The automaton of the items' windows and which items have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW) -> None:
        import ahocorasick

        self.symbol: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            coded = tuple([self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)])
            for i in range(max(1, len(coded) - width + 1) if coded else 0):
                windows.setdefault(coded[i : i + width], set()).update([] if item is None else [item])
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, met in windows.items():
            self.machine.add_word(w, (len(w), met))
        self.empty = not windows
        if windows:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges (united, ascending), items met."""
        line = words(text)
        get = self.symbol.get
        spans: list[tuple[int, int]] = []
        met: set[str] = set()
        if line and not self.empty:
            for last, (size, items) in self.machine.iter(tuple([get(x, _OTHER) for x in line])):
                spans.append((last - size + 1, last + 1))
                met |= items
        return len(line), unite(spans), met


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(lower_ascii(text))] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def item_hash(met: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The distinct items in lists of about ``limit`` bytes (texts and ids), one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("item", "text"))
    n = -(-(items.agg(F.sum(size)).first()[0] or 0) // limit)
    if n <= 1:
        yield [tuple(r) for r in items.collect()]
        return
    items = materialise(items.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(n))))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.col("slice") == k).select("item", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = ITEM_BYTES) -> DataFrame:
    """doc_id, td (MD5 of the text), n_words, hits (flat word ranges), items of every row."""
    schema = {"doc_id": "long", "td": "binary", "n_words": "long", "hits": "array<long>", "items": "string"}
    source = docs.select("doc_id", F.unhex(F.md5("text")).alias("td"), "text")

    def one(items: list[tuple[str | None, str | None]]) -> DataFrame:
        built: list[Windows] = []
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def rows(cols: dict[str, list]) -> dict[str, list]:
            if not built:
                built.append(Windows(shared.value, width))
            found = [built[0].scan(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "td": cols["td"], "n_words": [n for n, _, _ in found],
                "hits": [[x for s in spans for x in s] for _, spans, _ in found],
                "items": ["\x00".join(sorted(met)) for _, _, met in found],
            }

        return map_batches(source, schema, rows)

    slices = _slices(benchmark, limit)
    first, second = next(slices), next(slices, None)
    if second is None:
        return one(first)
    parts = [materialise(one(items)) for items in chain([first, second], slices)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # rows that repeat (doc_id, text) meet as many times in each slice; their hits agree
    copies = F.count("*") / F.lit(len(parts))
    together = every.groupBy("doc_id", "td").agg(
        copies.cast("int").alias("k"), F.first("n_words").alias("n_words"), F.collect_set("hits").alias("h"), F.collect_set("items").alias("i")
    )
    merged = together.select(
        "doc_id", "td", "n_words", F.flatten("h").alias("hits"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("i", lambda x: F.filter(F.split(x, "\x00"), lambda y: y != ""))))), "\x00").alias("items"),
        F.explode(F.array_repeat(F.lit(0), F.col("k"))).alias("_copy"),
    )

    def flat(cols: dict[str, list]) -> dict[str, list]:
        ranges = [unite(list(zip(h[::2], h[1::2]))) for h in cols["hits"]]
        return cols | {"hits": [[x for s in r for x in s] for r in ranges]}

    return map_batches(merged.drop("_copy"), schema, flat)


def report(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``find_leaks``."""
    item = F.filter(F.split("items", "\x00"), lambda x: x != "")
    pair = F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1)
    n_hit = F.when(F.size("hits") > 0, F.aggregate(pair, F.lit(0).cast("long"), lambda s, i: s + F.get("hits", 2 * i + 1) - F.get("hits", 2 * i))).otherwise(F.lit(0).cast("long"))
    # items are in code point order already, which is their order as strings
    return leaks.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(item).cast("long").alias("n_items"), F.sha2(F.array_join(item, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )


def oracle(width: int = WINDOW) -> str:
    """The report as DuckDB SQL over ``documents`` and ``benchmark``."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {width}) AS k, array_to_string(w[p : p + {width} - 1], ' ') AS s
  FROM b, unnest(generate_series(1, greatest(1, len(w) - {width} - -1))) AS g(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT i, p, x.k, item_id
  FROM (SELECT i, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
        FROM d, lens, unnest(generate_series(1, len(w) - k + 1)) AS g(p) WHERE len(w) >= k) x
  JOIN win ON win.k = x.k AND win.s = x.s),
hit AS (SELECT i, count(DISTINCT q) AS n_hit FROM occ, unnest(generate_series(p, p + k - 1)) AS g(q) GROUP BY i),
it AS (SELECT i, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (i) LEFT JOIN it USING (i)"""
