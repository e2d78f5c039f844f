"""Near-duplicate join on word shingles by parity sketches.

Every shingle of a document's set flips one bit of a very wide bit sketch (kept
sparse), so two sketches differ in at most as many bits as the sets differ in
elements: the Hamming distance is a lower bound of the symmetric difference.
Documents are put into bands by set size (powers of two).  In a band the sketch
is split into blocks; linked documents must agree on all but a few blocks, so by
the pigeonhole principle they agree on one of any ``t + 1`` blocks of either.
Each document therefore only looks for partners by its ``t + 1`` rarest blocks,
and one whose blocks are mostly its own has no partner at all.  Candidates whose
folded sketches are too far apart fall out; the rest are verified on the texts.

Sizes below 64 use one block per shingle and an exact ``t``.  Above, the sketch
covers a hash-sample of 32 to 64 expected shingles and ``t`` lies 5.5 standard
deviations above the expected number of differing blocks of a pair that only
just links, a chance of about 1e-7 of missing any one such pair.

Equal sets are one class from the start, so copies meet no one.  Only
connectivity is wanted, so classes that share a block are tested against a few
pivots first, and pairs inside a component that is already known are never
formed; what then remains across components is tested exhaustively.

Edge cases: null, empty and blank texts have an empty set and link with nothing
(their component is their own doc_id); rows that repeat a doc_id are one node
each per text and share components through equal sets; a null doc_id never names
a component unless all its members' ids are null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.components import connected_components

from .common import SPACES, U64, lower_words, map_batches, materialise, mix

WORDS = 5
SMALL = 64  # set sizes below it are sketched whole
BLOCKS = 256
DEVIATIONS = 5.5
FOLD = 1024  # bits of the folded sketch
PIVOTS = 4
_SHINGLE = [U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _times(k: int, by: np.uint64) -> np.uint64:
    return U64(k * int(by) & 0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence when short."""
    words = lower_words(text, SPACES)
    if not len(words):
        return words
    short = len(words) < width
    n = 1 if short else len(words) - width + 1
    total = np.zeros(n, U64)
    for i in range(len(words) if short else width):
        total = mix(total * U64(0xE7037ED1A0B428DB) + words[i : i + n] * _SHINGLE[i % len(_SHINGLE)] + U64(i + 1))
    return np.unique(mix(total + _times(len(words) if short else 0, _SHINGLE[0])))


def sketch_blocks(items: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Block tokens of a set in a size band, and the number of them in which a
    linked set of the band may differ."""
    n = len(items)
    salt = _times(band, _SHINGLE[1])
    if band == 0:
        return mix(items ^ salt), n // 4
    coded = mix(items ^ _SHINGLE[2])
    coded = coded[coded < U64(1 << (64 - (band - 5)))]  # rate 64 / 2**(band + 1)
    block = (coded & U64(BLOCKS - 1)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, bits = block[order], mix(coded[order] ^ salt)
    at = np.flatnonzero(np.diff(block, prepend=-1))
    if not len(at):
        return np.zeros(0, U64), 0
    size = np.diff(at, append=len(block))
    # a linked set lacks at most a quarter of this one's shingles, or has at most a third
    # more; of the mixtures of both, the extremes hit most blocks
    differ = np.maximum(1 - 0.75**size, 1 - np.exp(-n / 3 * 2.0 ** (5 - band) / BLOCKS))
    t = int(np.ceil(differ.sum() + DEVIATIONS * np.sqrt((differ * (1 - differ)).sum()) + 1))
    tokens = mix(np.bitwise_xor.reduceat(bits, at) + block[at].astype(U64) * _SHINGLE[3])
    return tokens, min(t, len(tokens) - 1)


def bands(n: int) -> list[int]:
    """The band of a set size, and the next one when partners may lie there."""
    own = 0 if n < SMALL else n.bit_length() - 1
    above = SMALL if own == 0 else 1 << (own + 1)
    return [own] + ([above.bit_length() - 1] if 4 * n >= 3 * above else [])


def fold(items: np.ndarray) -> np.ndarray:
    """The sketch folded to FOLD bits (parities add up, so the bound still holds)."""
    odd = (np.bincount((items & U64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


FEATURES = {
    "doc_id": "long", "td": "binary", "n": "long", "sk": "binary", "fold": "array<long>",
    "own": "array<long>", "own_t": "int", "up": "array<long>", "up_t": "int",
}


def features(docs: DataFrame) -> DataFrame:
    """One row per document: set size, text digest, set digest, folded sketch, blocks."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in FEATURES}
        for doc_id, td, text in zip(cols["doc_id"], cols["td"], cols["text"]):
            items = shingles(text)
            row = [doc_id, td, len(items), None, None, None, 0, None, 0]
            if len(items):
                with np.errstate(over="ignore"):
                    a, b = mix(items ^ _SHINGLE[3]).sum(), np.bitwise_xor.reduce(mix(items + _SHINGLE[4]))
                row[3:5] = np.array([a, b], U64).tobytes(), fold(items)
                for i, band in enumerate(bands(len(items))):
                    tokens, row[6 + 2 * i] = sketch_blocks(items, band)
                    row[5 + 2 * i] = tokens.view(np.int64)
            for k, v in zip(FEATURES, row):
                out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", F.unhex(F.md5("text")).alias("td"), "text"), FEATURES, rows)


def candidate_blocks(classes: DataFrame) -> DataFrame:
    """(node, tok, score): the shared ones among the rarest blocks by which a class looks
    for partners; score is the number of its shared blocks."""
    # a class has a seat in each of its bands; ``spare`` is t + 1 less all of its blocks there
    sides = [
        classes.filter(F.col(k).isNotNull()).select((2 * F.col("node") + i).alias("seat"), (F.col(f"{k}_t") + 1 - F.size(k)).alias("spare"), F.explode(k).alias("tok"))
        for i, k in enumerate(("own", "up"))
    ]
    blocks = sides[0].unionByName(sides[1])
    count = blocks.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1")
    mine = Window.partitionBy("seat")
    rare = (
        blocks.join(count, "tok")
        .withColumn("score", F.count("*").over(mine))
        .withColumn("rn", F.row_number().over(mine.orderBy("c", "tok")))
        .filter("rn <= spare + score")
    )
    return materialise(rare.select(F.floor(F.col("seat") / 2).cast("long").alias("node"), "tok", "score"))


def _distance(a: str, b: str) -> Column:
    """Hamming distance of two folded sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _near(percent: int) -> Column:
    """Whether sizes n, m and sketch distance d leave a link possible:
    |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|) holds for every link."""
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("d") * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, la, lb: nodes and their labels) of nodes whose sets are similar
    enough, by their texts."""
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    rows_in = pairs.select("a", "b", "la", "lb").join(text("a"), "a").join(text("b"), "b")

    def rows(cols: dict[str, list]) -> dict[str, list]:
        keep: dict[str, list] = {"a": [], "b": [], "la": [], "lb": []}
        known: dict[int, np.ndarray] = {}
        for a, b, la, lb, ta, tb in zip(*(cols[k] for k in (*keep, "ta", "tb"))):
            for key, t in ((a, ta), (b, tb)):
                if key not in known:
                    known[key] = shingles(t)
            both = len(np.intersect1d(known[a], known[b], assume_unique=True))
            if 100 * both >= percent * (len(known[a]) + len(known[b]) - both):
                for k, v in zip(keep, (a, b, la, lb)):
                    keep[k].append(v)
        return keep

    return map_batches(rows_in, {k: "long" for k in ("a", "b", "la", "lb")}, rows)


def class_links(cand: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the linked classes; None when no two classes share a block."""
    links, turn, few = None, 0, False
    nodes = sizes.count()
    now = cand.withColumn("label", F.col("node"))
    while True:
        # per block: whether it holds several labels, and a pivot with its sketch
        rank = F.col("score").cast("long") if turn == 0 else F.xxhash64("node", "tok", F.lit(turn))
        blocks = now.groupBy("tok").agg(
            F.count("*").cast("double").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"),
            F.max(F.struct(rank.alias("rank"), F.col("node").alias("o"), F.col("label").alias("l"))).alias("p"))
        sketch = sizes.select(F.col("node").alias("o"), F.col("n").alias("m"), F.col("fold").alias("g"))
        blocks = materialise(blocks.filter("low < high").select("tok", "c", "p.o", "p.l").join(sketch, "o"))
        most = blocks.agg(F.sum(F.col("c") * (F.col("c") - 1)) / 2).first()[0]
        if most is None:
            break
        live = now.join(blocks, "tok")  # a block within one label stays so
        # pivots go on while they connect more than a few classes; hardly any link is left then
        final = few or most <= 8 * nodes
        if final:  # every pair that shares a block and isn't known to be connected
            mine = live.select("tok", "node", "label").join(sizes.select("node", "n", "fold"), "node")
            other = mine.select("tok", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("m"), F.col("fold").alias("g"))
            met = mine.join(other, "tok").filter("label != lb and node < b").withColumn("d", _distance("fold", "g")).filter(_near(percent))
            pairs = materialise(met.select(F.col("node").alias("a"), "b", F.col("label").alias("la"), "lb").distinct())
        else:  # each class against the PIVOTS nearest among the pivots of its blocks
            met = live.filter("label != l").join(sizes.select("node", "n", "fold"), "node").withColumn("d", _distance("fold", "g")).filter(_near(percent))
            met = met.select(F.col("node").alias("a"), F.col("o").alias("b"), F.col("label").alias("la"), F.col("l").alias("lb"), "d").distinct()
            best = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
            # stored: a small table of pairs goes to the texts and not the texts to it
            pairs = materialise(met.withColumn("rn", best).filter(F.col("rn") <= PIVOTS).select("a", "b", "la", "lb"))
        found = materialise(linked(pairs, texts, percent))
        links = found if links is None else links.unionByName(found)
        if final:
            break
        # labels that met take the lesser one; longer paths shrink in later turns
        ends = found.select(F.col("la").alias("label"), F.col("lb").alias("to")).unionByName(found.select(F.col("lb").alias("label"), F.col("la").alias("to")))
        root = ends.groupBy("label").agg(F.min("to").alias("to"))
        now = live.select("tok", "node", "score", "label").join(root, "label", "left")
        now = materialise(now.select("tok", "node", "score", F.least("label", F.coalesce("to", "label")).alias("label")))
        turn, few = turn + 1, found.count() * 200 < nodes
    return None if links is None else materialise(connected_components(links.select("a", "b"), materialise))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, td, n_shingles, component_id, component) for every row of ``docs`` (doc_id,
    text); td is the MD5 of the text.  ``component`` numbers the component itself (null without
    words): unlike component_id it is its own where ids are null or shared.  ``percent`` (at
    least 75) is the least similarity."""
    feats = materialise(features(docs))
    classes = feats.filter("n > 0").groupBy("sk").agg(
        F.min("doc_id").alias("rep"), F.min("td").alias("td"), *(F.first(c).alias(c) for c in list(FEATURES) if c not in ("doc_id", "td", "sk"))
    )
    # numbers are given once: the table is stored before anything reads them
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    cand = candidate_blocks(classes)
    sizes = materialise(classes.join(cand.select("node").distinct(), "node", "left_semi").select("node", "td", "n", "fold"))
    texts = docs.select(F.unhex(F.md5("text")).alias("td"), "text").join(sizes.select("td", "node"), "td")
    texts = materialise(texts.groupBy("node").agg(F.min("text").alias("text")))
    labels = class_links(cand, sizes, texts, percent)
    member = classes.select("sk", "node", "rep")
    if labels is not None:
        joined = member.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        member = joined.join(least, "component")
    else:
        member = member.withColumnRenamed("rep", "component_id").withColumnRenamed("node", "component")
    return feats.select("doc_id", "td", F.col("n").alias("n_shingles"), "sk").join(member.select("sk", "component_id", "component"), "sk", "left").select(
        "doc_id", "td", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component"
    )
