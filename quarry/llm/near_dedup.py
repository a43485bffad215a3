"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. A document is the set of its five-word shingles.  Documents of one set form a
   class, found by a digest of the set; all later steps see one document of each
   class.
2. 160 MinHash samples give 40 band keys of 4 samples.  Two documents with a
   Jaccard similarity of 0.75 share no key with a probability of 3e-7.
3. Finer MinHash samples, the least shingle hash in each of 2048 bins, are folded
   into an odd sketch, a bitmap of 1024 parities.  The population count of two
   sketches' XOR tells how many samples differ.  Pairs for which it is 5.5
   standard errors above what a similarity of 0.75 would give are dropped; that
   is about 0.67 for sets of a few hundred shingles.
4. Pairs that are left are confirmed on their full shingle sets.

Not all pairs of a bucket are formed.  First each bucket's members are paired
with its smallest and largest member, confirmed, and joined to components.  Where
a bucket still holds several components, its documents meet, whatever components
they are in:

* In a bucket of a few documents, those of different components are paired by a join.
* Larger buckets are gathered into cells, as those of one common passage hold much
  the same documents.  A document goes to each cell of its buckets once, so to 40
  at most, however many documents and components it meets there.

The documents of a cell meet inside tasks, by blocks of bounded text, through an
index of the block's shingles; a task emits links that join what was apart, not
pairs.  Every two documents of a bucket are thus in one component or were compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow_map import map_batches
from quarry.llm.components import components
from quarry.llm.row_verdicts import drop_lost
from quarry.llm.shingles import mixed, shingle_set, word_hashes
from quarry.llm.storage import materialize, small, text_or_empty

BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, BINS = 1024, 2048
WORDS = SKETCH_BITS // 64
#: Standard errors above the count that is expected at the least similarity, up to which pairs are confirmed.
MARGIN = 5.5
#: Documents of a block of a cell, and bytes of their texts, at most about; one or two blocks meet in a task.
BLOCK, BLOCK_BYTES = 4096, 6 << 20
#: Documents of a bucket that are paired by a join; more of them meet in a cell.
FEW = 48
_random = np.random.default_rng(160)
FACTORS = _random.integers(0, 1 << 31, (SAMPLES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint32)
BAND_FACTORS = _random.integers(1, 1 << 63, (1, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALT = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of SAMPLES permutations over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[None, at : at + 2048] * FACTORS + SHIFTS).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Keys of all bands for rows of samples."""
    bands = samples.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return mixed((bands * BAND_FACTORS).sum(axis=2, dtype=np.uint64) + BAND_SALT).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """Parity bitmap of the least hash of each bin, as WORDS 64-bit numbers, and the number of bins used."""
    least = np.full(BINS, -1, dtype=np.int64)
    places = (shingles & np.uint64(BINS - 1)).astype(np.int64)
    least[places[::-1]] = np.arange(len(shingles) - 1, -1, -1)  # sets are sorted: the first of a bin is its least
    samples = shingles[least[least >= 0]]
    bit = (mixed(samples) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    parity = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64), len(samples)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, keys, bins, s0..s15) of each document; digest and keys are null without words."""
    names = [f"s{i}" for i in range(WORDS)]

    def task():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(w) for w in word_hashes(batch.column(1).cast(pa.binary()).to_pylist())]
            samples = np.array([min_hashes(s) for s in sets]).reshape(-1, SAMPLES)
            keys, sketches = band_keys(samples), [odd_sketch(s) for s in sets]
            words = np.array([w for w, _ in sketches]).reshape(-1, WORDS)
            full = [len(s) > 0 for s in sets]
            out = {
                "doc_id": batch.column(0),
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s, digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)],
                "keys": [k if f else None for k, f in zip(keys, full, strict=True)],
            }
            out["bins"] = [b for _, b in sketches]
            return out | {c: words[:, i] for i, c in enumerate(names)}

        return work

    schema = "doc_id long, n long, digest binary, keys array<long>, bins int, " + ", ".join(f"{c} long" for c in names)
    return map_batches(docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)), schema, task)


def allowed_bits(n1, n2, bins1, bins2, percent: int, exp, sqrt, larger):
    """Most differing parities that leave a similarity of ``percent`` possible, for columns or arrays.

    At similarity j the union has u = (n1 + n2) / (1 + j) shingles, which use about
    b = BINS (1 - exp(-u / BINS)) bins; in j b of them both sets have one sample.
    The other samples, d in number, set about m/2 (1 - exp(-2 d / m)) of m parities.
    """
    j, m = percent / 100, float(SKETCH_BITS)
    union = (n1 + n2) / (1 + j)
    bins = (1 - exp(-union / BINS)) * BINS
    spread = 4 * j * (1 - j) * bins * (1 - bins / union) + union * union / (6 * BINS)
    differ = larger(bins1 + bins2 - 2 * j * bins) + MARGIN * sqrt(larger(spread)) + 2
    folded = (1 - exp(differ * (-2 / m))) * (m / 2)
    noise = (1 - exp(differ * (-4 / m)) * (1 + differ * (4 / m))) * (m / 4)
    return folded + MARGIN * sqrt(noise)


def may_be_similar(left: str, right: str, percent: int) -> Column:
    """Whether lengths and odd sketches of two rows leave a similarity of ``percent`` possible."""
    x, y = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    counts = [F.bit_count(x(f"s{i}").bitwiseXOR(y(f"s{i}"))) for i in range(WORDS)]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    bits = allowed_bits(x("n"), y("n"), x("bins"), y("bins"), percent, F.exp, F.sqrt, lambda c: F.greatest(F.lit(0.0), c))
    return sizes & (total <= bits)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


class Members:
    """Documents of a block: their sketches, and an index of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        made = [odd_sketch(s) for s in sets]
        self.bits = np.array([w for w, _ in made]).view(np.uint64).reshape(-1, WORDS)
        self.used = np.array([b for _, b in made], dtype=float)
        self.size = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners = shingles[order], owners[order]

    def like(self, probe: np.ndarray, percent: int, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the members (``among`` some) that are similar to a set: those that lengths and sketches leave, counted exactly."""
        word, used = odd_sketch(probe)
        n = len(probe)
        near = 100 * np.minimum(n, self.size) >= percent * np.maximum(n, self.size)
        near = np.flatnonzero(near if among is None else near & among)
        differ = np.bitwise_count(self.bits[near] ^ word.view(np.uint64)).sum(axis=1)
        bits = allowed_bits(n, self.size[near], used, self.used[near], percent, np.exp, np.sqrt, lambda v: np.maximum(v, 0.0))
        near = near[differ <= bits]
        if not len(near):
            return near
        low, high = (np.searchsorted(self.shingles, probe, side) for side in ("left", "right"))
        each = high - low
        upto = np.cumsum(each)
        found = self.owners[np.repeat(low - upto + each, each) + np.arange(upto[-1])]
        shared = np.bincount(found, minlength=len(self.size))[near]
        return near[100 * shared >= percent * (n + self.size[near] - shared)]


def links_in_block(probes: list[np.ndarray], members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A link of each probe to a member, if it has any."""
    block = Members(members)
    found = ((i, block.like(p, percent)) for i, p in enumerate(probes))
    return [(i, int(k[0])) for i, k in found if len(k)]


def joining_links(
    probes: list[np.ndarray], members: list[np.ndarray], percent: int, names: list[list], known: list[list] | None = None
) -> list[tuple[int, int]]:
    """Links of probes to members that join what no earlier one does.

    ``names`` tell who is who on both sides, ``known`` the components they are in
    already.  If both sides are one list, each two of it meet once.
    """
    block = Members(members)
    own, of = (np.array(side) for side in known or names)
    numbers = np.arange(len(members))
    out = []
    for i, probe in enumerate(probes):
        apart = of != own[i]
        if probes is members:
            apart &= numbers > i
        for k in block.like(probe, percent, apart).tolist():
            a, b = own[i], of[k]
            if a != b:
                own[own == b] = a
                of[of == b] = a
                out.append((i, k))
    return out


def meeting_cells(crowded: DataFrame) -> DataFrame:
    """Cells (cell, rep, of) for the documents (key, rep, of, held) of large buckets, in component ``of``; ``held`` is the bucket's size.

    A document's home is the largest of its buckets.  A bucket goes to the cell of
    the home that most of its documents have, if half of them have it, and is a
    cell of its own otherwise.  So documents that share a bucket share a cell, none
    has more cells than buckets, and a cell has 41 times the documents of its home at most.
    """
    homes = crowded.groupBy("rep").agg(F.max(F.struct("held", "key")).getField("key").alias("home"))
    shares = crowded.join(homes, "rep").groupBy("key", "held", "home").agg(F.count(F.lit(1)).alias("share"))
    cells = shares.groupBy("key", "held").agg(F.max(F.struct("share", "home")).alias("most"))
    cells = cells.select("key", F.when(2 * F.col("most.share") >= F.col("held"), F.col("most.home")).otherwise(F.col("key")).alias("cell"))
    cells = materialize(cells, "cells")
    return crowded.join(small(cells, cells.count()), "key").select("cell", "rep", "of").distinct()


def cell_links(places: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links (a, b), a > b, that join documents (cell, rep, of) of a cell which the components ``of`` don't join yet."""
    places = materialize(places, "places")
    ids = materialize(places.select("rep").distinct(), "ids")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).alias("text"))
    rows = materialize(places.join(texts.join(small(ids, ids.count()), "rep", "left_semi"), "rep"), "met")
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int")
    counts = materialize(rows.groupBy("cell").agg(n_blocks.alias("blocks")), "blocks")
    placed = rows.join(small(counts, counts.count()), "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A row for each block of the cell: one, but in cells of more than a block.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def check(block: pd.DataFrame) -> pd.DataFrame:
        within = block["low"].iat[0] == block["high"].iat[0]
        split = [block] if within else [block[block["own"] == block[end]] for end in ("low", "high")]
        names, known = ([side[c].to_list() for side in split] for c in ("rep", "of"))
        sets = [[shingle_set(w) for w in word_hashes([t.encode() for t in side["text"]])] for side in split]
        found = []
        if all(sets):
            found = joining_links(sets[0], sets[-1], percent, [names[0], names[-1]], [known[0], known[-1]])
        linked = [(names[0][i], names[-1][k]) for i, k in found]
        return pd.DataFrame({"a": [max(x) for x in linked], "b": [min(x) for x in linked]}, dtype="int64")

    placed = placed.select("cell", "low", "high", "own", "rep", "of", "text")
    return materialize(placed.groupBy("cell", "low", "high").applyInPandas(check, "a long, b long"), "more")


def component_links(probes: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links (a, b) that join probes (rep, component) to members (node, component) of their components, each component a cell."""
    wanted = probes.select("component").distinct()
    members = labels.join(small(wanted, wanted.count()), "component", "left_semi")
    members = members.select(F.col("component").alias("cell"), F.col("node").alias("rep"), F.col("component").alias("of"))
    places = members.unionByName(probes.select(F.col("component").alias("cell"), "rep", F.col("rep").alias("of")))
    return cell_links(places, docs, id_col, text_col, percent)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "paired")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.join(small(ids, ids.count()), "id", "left_semi")
    # Only texts that are in some pair are shuffled.
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def task():
        def work(batch: pa.RecordBatch) -> dict:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known: dict[int, np.ndarray] = {}
            linked = ([], [])
            for ids_, texts_ in ((a, 2), (b, 3)):
                column = batch.column(texts_).cast(pa.binary()).to_pylist()
                new = {(i, t) for i, t in zip(ids_, column, strict=True) if i not in known}
                new = dict(new)
                known.update(zip(new, (shingle_set(w) for w in word_hashes(list(new.values()))), strict=True))
            for i, j in zip(a, b, strict=True):
                if similar(known[i], known[j], percent):
                    linked[0].append(i)
                    linked[1].append(j)
            return {"a": linked[0], "b": linked[1]}

        return work

    return materialize(map_batches(both, "a long, b long", task), "confirmed")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Documents are linked if ``100 * intersection >= percent * union`` of their
    distinct five-word shingles (fewer words: the whole sequence is the one
    shingle).  ``component_id`` is the smallest id that links reach.  Null, empty
    and blank texts have no shingles and are linked with nothing.  Rows with one
    id are taken for one document.  A row without an id has the component of
    its class, null if it is alone, and isn't kept.  An empty table gives no rows.
    Very long texts are compared whole.  Other columns, whatever their names, are not read.
    """
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    with_id = signed.filter("digest is not null and doc_id is not null")
    classes = with_id.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    repeated = classes.filter("copies > 1").select("digest", "rep")
    n_repeated = repeated.count()
    as_class = signed.select("doc_id", "n", "digest").join(small(repeated, n_repeated), "digest", "left")
    as_class = as_class.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    # One document of each class: those that lost to a smaller id in theirs go.
    others = as_class.filter("rep < doc_id").select(F.col("doc_id").alias("other"))
    n_others = others.count()
    reps = with_id.join(small(others, n_others), F.col("doc_id") == F.col("other"), "left_anti").dropDuplicates(["doc_id"])
    sketches = ["n", "bins", *(f"s{i}" for i in range(WORDS))]
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "keys", *sketches), "representatives")

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    ends = materialize(ends, "buckets")
    n_ends = ends.count()
    members = materialize(keyed.join(small(ends, n_ends), "key"), "members")
    stars = members.select("rep", F.explode(F.array("low", "high")).alias("end")).filter("rep <> end")
    stars = stars.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    marks = reps.select("rep", *sketches)
    likely = (
        stars.join(marks.withColumnRenamed("rep", "a").alias("x"), "a")
        .join(marks.withColumnRenamed("rep", "b").alias("y"), "b")
        .filter(may_be_similar("x", "y", percent))
        .select("a", "b")
    )
    links = confirmed(materialize(likely, "likely"), docs, id_col, text_col, percent)
    labels = materialize(components(links), "labels")
    n_labels = labels.count()

    # Buckets that still hold several components.
    labelled = members.select("key", "rep").join(small(labels, n_labels), F.col("rep") == F.col("node"), "left")
    labelled = materialize(labelled.select("key", "rep", F.coalesce("component", "rep").alias("of")), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.count(F.lit(1)).alias("held"))
    open_keys = materialize(open_keys.filter("least < most").select("key", "held"), "open")
    meeting = materialize(labelled.join(small(open_keys, open_keys.count()), "key"), "meeting")
    few = materialize(meeting.filter(F.col("held") <= FEW).select("key", "rep", "of").join(marks, "rep"), "few")
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.of") != F.col("y.of"))
    single = x.join(y, apart & may_be_similar("x", "y", percent))
    single = single.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    single = materialize(single.join(stars, ["a", "b"], "left_anti"), "single")
    more = confirmed(single, docs, id_col, text_col, percent)
    crowded = meeting.filter(F.col("held") > FEW)
    if not crowded.isEmpty():
        more = more.unionByName(cell_links(meeting_cells(crowded), docs, id_col, text_col, percent))
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "labels")
        n_labels = labels.count()
    out = as_class.join(small(labels, n_labels), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    Rows of one id with different texts, and rows without an id, are documents of
    their own; rows of equal id and text are one.  Of a group the smallest id stays,
    null after all others; of one id's texts the first by digest.  Null, empty and
    blank texts are in no group and stay.  An empty table gives no rows.  Columns of any name pass.
    """

    def lost(rows: DataFrame, ids: str, texts: str) -> DataFrame:
        return near_groups(rows, ids, texts, percent=percent).filter("not kept").select("doc_id")

    return drop_lost(docs, id_col, text_col, lost)
