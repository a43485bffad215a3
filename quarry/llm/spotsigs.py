"""Document fingerprints by SpotSigs.

Words are runs of letters and digits.  An anchor is an occurrence of a common
word; its signature is the anchor with the next three content words (words that
aren't common) behind it.  Every word adds a chain of its own with the word
behind it, in all texts alike, so that short texts and texts with few anchors
have signatures, too, and no edit changes the scheme.  A text's fingerprint is the multiset of its
signatures, a repeated one marked by how often it came before, as sorted 32-bit
hashes; so fingerprints compare by Jaccard similarity without their texts.

Two fingerprints are compared by likeness(), which skips pairs whose lengths rule
a threshold out: sets of sizes m <= n can't be more alike than m / n.  There is no
comparison of all pairs by length classes here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow_map import bounded_batches, slices
from quarry.llm.ranges import MOST_RANGES, range_of, splitters, weighted_sample
from quarry.llm.shingles import mixed, word_hashes
from quarry.llm.storage import text_or_empty

# Common words of English, German, French and Spanish.
COMMON = """a an and are as at be been but by can did do does for from had has have he her his if in into is it its no
not of on or our said she so that the their there they this to was we were what which who will with would you
aber als am auf aus bei bin bis da das dem den der des die durch ein eine einem einen einer es für hat ich ihr im
ist man mit nach nicht noch oder sein sich sie sind und von vor war was werden wie wir zu zum zur
au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que
qui sa sans se ses son sont sur un une vous
al con como del el ella ellos era es esta este esto fue ha hay las lo los más me mi muy para pero por porque
según ser si sin sobre su sus también tiene todo una uno y ya""".split()
CHAIN = 3
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ANCHORS = np.unique(np.concatenate(list(word_hashes([w.encode() for w in COMMON], BETWEEN))))
FACTORS = np.random.default_rng(4).integers(1, 1 << 63, CHAIN + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text's word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    at = np.minimum(np.searchsorted(ANCHORS, words), len(ANCHORS) - 1)
    common = ANCHORS[at] == words
    content, anchors = np.flatnonzero(~common), np.flatnonzero(common)
    first = np.searchsorted(content, anchors)
    fits = first + CHAIN <= len(content)
    anchors, first = anchors[fits], first[fits]
    chains = words[anchors] * FACTORS[0]
    for k in range(CHAIN):
        chains += words[content[first + k]] * FACTORS[k + 1]
    every = words[:-1] * FACTORS[CHAIN + 1] + words[1:] * FACTORS[CHAIN + 2] if n > 1 else words * FACTORS[CHAIN + 1]
    chains = np.concatenate((chains, every))
    chains.sort()
    before = np.arange(len(chains)) - np.searchsorted(chains, chains)
    return np.unique((mixed(chains + before.astype(np.uint64) * FACTORS[CHAIN + 3]) >> np.uint64(32)).astype(np.uint32))


def encoded(signs: np.ndarray) -> str:
    return base64.b64encode(signs.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(one: np.ndarray, two: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sets; 0 without comparing if their lengths rule out ``least``.

    Two empty sets are alike, an empty and another one aren't.
    """
    short, long = sorted((len(one), len(two)))
    if not long:
        return 1.0
    if not short or short < least * long:
        return 0.0
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (short + long - shared)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


LOWEST = -(1 << 63)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_followers(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """Rows (doc_id, text, part, borrowed) in descending order of id within tasks.

    The rows are dealt to ranges of ids by sampled splitters.  The row that
    follows a range's last one is its neighbour's first row, which is borrowed
    as an additional last row: one for each range.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("place", F.coalesce("doc_id", F.lit(LOWEST)))
    sized = base.select("place", (F.octet_length("text") + 1).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = min(max(1, -(-total // part_bytes)), MOST_RANGES)
    bounds = splitters(weighted_sample(sized, ["place"], "size", 32 * parts), parts)
    placed = base.withColumn("part", range_of([F.col("place")], bounds))
    # A row for each range: MOST_RANGES at most.
    tops = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.max("place")).collect())
    # A range lends its first row to the next higher one, the highest to the lowest.
    borrowers = [(*top, tops[(i + 1) % len(tops)][0]) for i, top in enumerate(tops)]
    lenders = F.broadcast(docs.sparkSession.createDataFrame(borrowers, "part int, place long, borrower int"))
    lent = placed.join(lenders, ["part", "place"]).groupBy("borrower", "place").agg(F.min("text").alias("text"))
    extra = lent.select(F.lit(None).cast("long").alias("doc_id"), "text", "place", F.col("borrower").alias("part"), F.lit(1).alias("borrowed"))
    rows = placed.withColumn("borrowed", F.lit(0)).unionByName(extra)
    dealt = rows.repartitionById(len(bounds) + 1, "part")
    return dealt.sortWithinPartitions("part", "borrowed", F.desc("place"), "text").select("doc_id", "text", "part", "borrowed")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, part_bytes: int = 24 << 20
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The next document is the one before it in ascending order of id; null ids
    count as the smallest, rows of one id stand in the order of their texts, and
    the last row's next is the first (in a table of one row, itself).  The edited
    text is edited(text, next text).  Null counts as empty; a text without words
    has the empty fingerprint.  An empty table gives no rows.  Very long texts are
    read whole; other columns, whatever their names, are not read.
    """
    rows = with_followers(docs, id_col, text_col, part_bytes)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one that follows: (doc_id, text, part, borrowed, signs)
        for batch in batches:
            for part in slices(batch):
                got = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                signs = [signatures(w) for w in word_hashes([r[1].encode() for r in got], BETWEEN)]
                chain = [held] * (held is not None) + [(*r, s) for r, s in zip(got, signs, strict=True)]
                pairs = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if not x[3]]
                texts = [edited(x[1], y[1]).encode() for x, y in pairs]
                changed = [signatures(w) for w in word_hashes(texts, BETWEEN)]
                held = chain[-1]
                out = [
                    (
                        x[0],
                        len(x[1]),
                        hashlib.sha256(t).hexdigest(),
                        encoded(x[4]),
                        encoded(c),
                        likeness(x[4], c),
                        likeness(x[4], y[4]),
                    )
                    for (x, y), t, c in zip(pairs, texts, changed, strict=True)
                ]
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, SCHEMA)
