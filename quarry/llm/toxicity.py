"""Toxicity by boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings of 3 to 8 letters that toxic
training texts have far more often than others, each weighted by its log odds.
Features are densities of the lexicon, how near its hits are to second-person
pronouns, and rates of capitals, punctuation and obfuscated spelling.  Lexicon,
trees and calibration are fitted on a bounded sample of the labelled rows: four
folds, so that a training row's features never come from a lexicon that has seen
its label, nor its calibration score from trees that have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow_map import bounded_batches, let_go, map_batches, slices
from quarry.llm.boosting import Boosted, Isotonic, fit, isotonic
from quarry.llm.storage import materialize, text_or_empty

#: Labelled rows that the classifier is fitted on, at most about.
TRAINING_ROWS = 12_000
FOLDS = 4
BEGINNINGS = range(3, 9)
#: Lexicon entries, at most; the strongest stay.
LEXICON_ENTRIES = 20_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MASKED = re.compile(r"[^\W\d_][\d@$!*#+]+[^\W\d_]")
SPACED_OUT = re.compile(r"(?:(?<!\w)[^\W\d_][.\-* ]){3,}[^\W\d_](?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
# Second-person pronouns in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    """you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous
    votre vos ti contigo tuyo tuya usted ustedes vosotros""".split()
)
NEAR = 6
#: Words that a task remembers, about 150 bytes each.
MEMO_WORDS = 150_000
NOTHING = (0.0, False)


def grams_of(word: str) -> list[str]:
    """What the lexicon knows a word by: itself and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


class Lexicon:
    """Log odds of grams, with a memo of words."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.memo: dict[str, tuple[float, bool]] = {}

    def look_up(self, word: str) -> tuple[float, bool]:
        """A lower-case word's weight, and whether a letter is stretched in it."""
        if (found := self.memo.get(word)) is None:
            odds = self.odds
            found = max(odds.get(g, 0.0) for g in grams_of(word)), STRETCHED.search(word) is not None
            found = NOTHING if found == NOTHING else found  # one object for most words
            if len(self.memo) < MEMO_WORDS:
                self.memo[word] = found
        return found


def learned(counts: dict[str, np.ndarray], totals: np.ndarray, fold: int | None) -> dict[str, float]:
    """Lexicon from counts by (fold, label) of all folds but ``fold``."""
    use = [f for f in range(FOLDS) if f != fold]
    clean, toxic = totals[use].sum(axis=0)
    out = {}
    for gram, by in counts.items():
        c, t = by[use].sum(axis=0)
        odds = np.log((t + 0.1) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t >= max(2, 0.004 * toxic) and odds > 1.6:
            out[gram] = float(odds) * min(1.0, t / 4)
    return out


FEATURES = 18


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text)
    n = len(words)
    known = [lexicon.look_up(w) for w in map(str.lower, words)]
    hits = [i for i, (w, _) in enumerate(known) if w]
    found = [known[i][0] for i in hits]
    kinds = {words[i].lower() for i in hits}
    you = [i for i, w in enumerate(words) if len(w) < 12 and w.lower() in SECOND_PERSON] if hits else []
    near = int(sum(1 for i in hits if _nearest(you, i) <= NEAR)) if you else 0
    chars = max(1, len(text))
    letters = sum(map(len, words))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marks = text.count("!") + text.count("?")
    stops = text.count(".") + text.count(",") + text.count(";") + text.count(":")
    masked = len(MASKED.findall(text)) + len(SPACED_OUT.findall(text))
    stretched = sum(s for _, s in known)
    each = 1 / max(1, n)
    return [
        len(hits) * each,
        float(len(hits)),
        sum(found) * each,
        sum(found),
        max(found, default=0.0),
        sorted(found)[-2] if len(found) > 1 else 0.0,
        float(len(kinds)),
        sum(sorted(found)[-5:]),
        near * each,
        float(near),
        len(you) * each,
        upper * each,
        marks / chars,
        stops / chars,
        (chars - letters) / chars,
        masked * each,
        stretched * each,
        float(np.log1p(n)),
    ]


def _nearest(places: list[int], at: int) -> int:
    from bisect import bisect_left

    k = bisect_left(places, at)
    return min((abs(places[j] - at) for j in (k - 1, k) if 0 <= j < len(places)), default=1 << 30)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(FOLDS)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, fold, label) of about ``rows`` labelled rows, drawn by a hash of their ids."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = materialize(known.groupBy("id").agg(F.max("label").alias("label")), "labels")
    part = min(1.0, rows / max(1, known.count()))
    dice = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.filter(dice < part)  # about ``rows``: a bounded side
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(drawn), "id")
    return materialize(joined.select("text", fold_of(F.col("id")).alias("fold"), "label"), "training")


def gram_counts(train: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Texts by (fold, label) that have a gram, for grams that lean to label 1; and all texts by (fold, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text, fold, label in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = {g for w in {w.lower() for w in WORD.findall(text)} for g in grams_of(w)}
                    seen.update((g, 2 * fold + label) for g in own)
                if len(seen) > 500_000:
                    yield _rows_of(seen)
                    seen = Counter()
        yield _rows_of(seen)

    parts = train.repartition(train.sparkSession.sparkContext.defaultParallelism)
    cells = parts.mapInArrow(count, "gram string, cell int, n long").groupBy("gram")
    columns = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(2 * FOLDS)]
    sums = cells.agg(*columns)
    toxic = sum((F.col(f"n{c}") for c in range(3, 2 * FOLDS, 2)), F.col("n1"))
    clean = sum((F.col(f"n{c}") for c in range(2, 2 * FOLDS, 2)), F.col("n0"))
    total = np.zeros((FOLDS, 2))
    for fold, label, n in train.groupBy("fold", "label").count().collect():
        total[fold, label] = n
    ratio = float((total[:, 1].sum() + 1) / (total[:, 0].sum() + 1))
    leaning = sums.filter((toxic >= 2) & (toxic / (clean + 0.5) > 4 * ratio))
    top = leaning.orderBy(F.desc(toxic), F.asc(clean), "gram").limit(LEXICON_ENTRIES).collect()
    return {r[0]: np.array(r[1:], dtype=float).reshape(FOLDS, 2) for r in top}, total


def _rows_of(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g for g, _ in seen], pa.string()),
            pa.array([c for _, c in seen], pa.int32()),
            pa.array(list(seen.values()), pa.int64()),
        ],
        ["gram", "cell", "n"],
    )


class Model:
    """Lexicon, trees and calibration; a few MB at most."""

    def __init__(self, odds: dict[str, float], trees: Boosted, calibration: Isotonic):
        self.odds, self.trees, self.calibration = odds, trees, calibration

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        x = np.array([features(t, lexicon) for t in texts]).reshape(-1, FEATURES)
        return self.calibration(self.trees.raw(x))


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    rows: int = TRAINING_ROWS,
) -> Model:
    """Fit on about ``rows`` labelled rows that are not held out."""
    train = training_rows(docs, labels, id_col, text_col, label_col, rows)
    counts, totals = gram_counts(train)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([learned(counts, totals, f) for f in range(FOLDS)])

    def task():
        lexicons = [Lexicon(o) for o in sent.value]

        def work(batch: pa.RecordBatch) -> dict:
            texts, folds, known = (c.to_pylist() for c in batch.columns)
            x = [features(t, lexicons[f]) for t, f in zip(texts, folds, strict=True)]
            return {"fold": folds, "label": known, "x": x}

        return work

    got = map_batches(train, "fold int, label int, x array<double>", task).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, FEATURES)
    y, fold = got["label"].to_numpy(dtype=float), got["fold"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same model whatever the order in which tasks end
    x, y, fold = x[order], y[order], fold[order]
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        if (own := fold == f).any() and not own.all():
            raw[own] = fit(x[~own], y[~own]).raw(x[own])
    return Model(learned(counts, totals, None), fit(x, y), isotonic(raw, y))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    threshold: float = 0.7,
    rows: int = TRAINING_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    ``labels`` has ids and a 0/1 label; other values and null ids are ignored, and
    of several labels of an id the larger counts.  Rows with crc32(id as text)
    mod 3 = 1 are held out: their labels are never read.  A score depends on the
    text alone, so equal texts score alike; null counts as empty.  Without usable
    labels every score is 0.5.  A null id isn't held out.  An empty table gives no rows.
    Very long texts are scored whole; other columns, whatever their names, are not read.
    """
    model = train_model(docs, labels, id_col, text_col, label_col, rows=rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        fitted = sent.value
        lexicon = Lexicon(fitted.odds)

        def work(batch: pa.RecordBatch) -> dict:
            score = fitted.scores(batch.column(2).to_pylist(), lexicon)
            return {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "score": score,
                "predicted": (score >= threshold).astype(np.int32),
            }

        return work

    doc_id = F.col(id_col).cast("long")
    picked = docs.select(doc_id, held_out(doc_id), text_or_empty(text_col))
    return map_batches(picked, "doc_id long, held_out boolean, score double, predicted int", task)


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    threshold: float = 0.7,
    rows: int = TRAINING_ROWS,
) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns kept, nothing shuffled.

    A row is judged by its text alone, as in score_toxicity(): null counts as
    empty, ids and repeated rows change nothing, and without usable labels all
    rows stay.  Very long texts are scored whole.  An empty table gives no rows.
    Columns of any name pass.
    """
    model = train_model(docs, labels, id_col, text_col, label_col, rows=rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        fitted = sent.value
        lexicon = Lexicon(fitted.odds)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(at).cast(pa.string()).to_pylist()]
                yield part.filter(pa.array(fitted.scores(texts, lexicon) < threshold))

    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(keep, schema)
