"""URL filter: prefix rules, then boosted trees on lexical features.

A rule names a host with its subdomains and a path prefix; the longest rule that
fits decides.  All other URLs are judged by gradient-boosted trees over lexical
features.  The trees learn from labelled URLs: a bounded sample of the table's
own, labelled by a list of words of unwanted hosts, beside a fixed list of
examples, so that even a table without unwanted hosts gives both labels.  The
examples have hosts of all shapes in both classes; what tells the classes apart
are rates of letter triples in host names, which trees see from other folds only.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow_map import map_batches
from quarry.llm.boosting import fit

#: URLs that the trees are fitted on, at most about.
TRAINING_URLS = 20_000
# Words in the names of hosts that are to be blocked.
UNWANTED = """adult ads adserver bet bets betting casino cheap clickbait gambling jackpot loans lottery malware phish
pharma pills poker popads porn replica scam sex slots spam torrent track tracker viagra warez win xxx""".split()
# Words that names join with others, in hosts of both kinds.
COMPANIONS = """best big city club daily deals direct farm fast first free fun global home hot hub king land live my
network new now online open page place plus point portal pro real site star store super the time top village web
world x zone""".split()
PLAIN = """archive art bakery bike birds books bridge bus castle chess choir cinema coffee college cooking dance doctor
energy family farmers flowers forest garden glass guide health history house insurance job journal kitchen lake
law library light maps market math medicine mountain museum music nature news ocean paint paper park physics
poetry radio recipes river sailing school science sport station stone street tea theatre trade traffic train
travel university valley water weather wiki wind window winter wood""".split()
DOMAINS = ("com", "net", "org", "de", "fr", "info", "blog.com", "pages.net", "hosting.org", "cdn.io")
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for hosts that are or end in ``.host``, if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(line: str) -> Rule:
    """Parse ``allow host/path`` or ``block host/path``."""
    verdict, _, place = line.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(text, pattern, 2)


TOKEN = re.compile(r"[a-z]+")


def unwanted(host: str) -> bool:
    """The training label of a host: whether one of its words, alone or joined to others, is on the list."""
    return any(t in _UNWANTED or joins_unwanted(t) for t in TOKEN.findall(host))


def joins_unwanted(name: str) -> bool:
    """Whether known words, one of them on the list, make up all of ``name``: casinowin, but not winter."""
    reached = {0: {False}}  # by length: whether a word on the list is among those before
    for end in range(1, len(name) + 1):
        for start in list(reached):
            word = name[start:end]
            if word in _KNOWN:
                reached.setdefault(end, set()).update(bad or word in _UNWANTED for bad in reached[start])
    return True in reached.get(len(name), set()) and name not in PLAIN


_UNWANTED = frozenset(UNWANTED)
_KNOWN = _UNWANTED | frozenset(COMPANIONS) | frozenset(PLAIN)


def triples(host: str) -> set[str]:
    """Letter triples of a host's words, their ends marked; the last label says nothing of the name."""
    return {w[i : i + 3] for t in TOKEN.findall(host.rpartition(".")[0] or host) for w in (f"^{t}$",) for i in range(len(w) - 2)}


def fold_of(host: str) -> int:
    return zlib.crc32(host.encode()) % FOLDS


class Triples:
    """Log odds of letter triples among labelled hosts, each host counted once."""

    def __init__(self, labels: dict[str, float]):
        self.sizes = [sum(1 for v in labels.values() if v == k) for k in (0.0, 1.0)]
        self.counts: dict[str, list[int]] = {}
        for host, label in labels.items():
            for t in triples(host):
                self.counts.setdefault(t, [0, 0])[int(label)] += 1

    def odds(self, host: str) -> list[float]:
        """Sum, mean and greatest of a host's log odds, and the sum of its three greatest."""
        known = (self.counts[t] for t in triples(host) if t in self.counts)
        clean, bad = (n + 1.0 for n in self.sizes)
        each = sorted((math.log((b + 0.5) / bad) - math.log((c + 0.5) / clean) for c, b in known), reverse=True)
        return [sum(each), sum(each) / len(each), each[0], sum(each[:3])] if each else [0.0] * 4


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def lexical(url: str, host: str, path: str, suffix_rates: dict[str, float], odds: Triples) -> list[float]:
    """Lengths, depth, digit ratio, entropy, parameter counts, and statistics of suffixes and letter triples."""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    suffix = labels[-1]
    words = TOKEN.findall(host)
    name = ".".join(labels[:-2]) or host
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(path.count("/")),
        float(len(labels)),
        sum(c.isdigit() for c in url) / max(1, len(url)),
        sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy(url),
        entropy(name),
        float(len(query.split("&")) if query else 0),
        float(len(query)),
        float(host.count("-")),
        float(max(map(len, labels))),
        len(words) / max(1, len(labels)),
        sum(c in "aeiou" for c in name) / max(1, len(name)),
        len(set(name)) / max(1, len(name)),
        float(len(suffix)),
        suffix_rates.get(suffix, suffix_rates.get("", 0.0)),
        float(not host),
        float("@" in url or "%" in host or host[:1].isdigit()),
        *odds.odds(host),
    ]


def examples(seed: int = 5, domains: Sequence[str] = DOMAINS, names: int = 2000) -> list[str]:
    """Generated labelled URLs; their labels follow from their hosts, as those of the table do.

    Names of both classes get schemes, hyphens, prefixes, domains and paths by the same dice.
    """
    r = random.Random(seed)
    out = []
    for words in (UNWANTED, PLAIN):
        for _ in range(names):
            pair = [r.choice(words), r.choice([*words, *COMPANIONS])]
            r.shuffle(pair)
            name = r.choice(("", "-")).join(pair[: r.choice((1, 2, 2, 2))] if pair[0] in words else pair)
            scheme, prefix = r.choice(("http", "https")), r.choice(("", "", "www.", "blog.", "m."))
            path = r.choice(("", "en/", "de/", "2024/")) + r.choice(("", "index", "item-4", "7", "a.html", "a?x=1&y=2"))
            out.append(f"{scheme}://{prefix}{name}.{r.choice(domains)}/{path}")
    return out


def judge_urls(
    pages: DataFrame,
    rules: Sequence[str],
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    rows: int = TRAINING_URLS,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict, score).

    ``rule`` is the longest rule that fits, or null; ``verdict`` is that rule's, or
    else ``block`` where the trees' ``score`` is ``threshold`` or more.  Null URLs
    and such without ``://`` have an empty host and path, fit no rule, and are
    scored like others.  Very long URLs are read whole.  Repeated rows are judged
    alike.  An empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    parsed = sorted(map(rule, rules), key=lambda r: (-len(r.text), r.text))
    host, path = host_and_path(F.col(url_col))
    picked = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    part = min(1.0, rows / max(1, pages.count()))
    dice = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = picked.filter(dice < part).select("url", "host", "path").toPandas()  # about ``rows`` at most
    fixed = [(u, u.split("/")[2], "/" + u.split("/", 3)[3].partition("?")[0]) for u in examples()]
    train = sorted(set(drawn.itertuples(index=False, name=None))) + fixed
    y = np.array([float(unwanted(h)) for _, h, _ in train])
    by_suffix: dict[str, list[float]] = {}
    for (_, h, _), label in zip(train, y, strict=True):
        by_suffix.setdefault(h.rpartition(".")[2], []).append(label)
    rates = {s: (sum(v) + y.mean()) / (len(v) + 1) for s, v in by_suffix.items() if len(v) >= 20} | {"": float(y.mean())}
    by_host = {h: label for (_, h, _), label in zip(train, y, strict=True)}
    others = [Triples({h: v for h, v in by_host.items() if fold_of(h) != k}) for k in range(FOLDS)]
    trees = fit(np.array([lexical(*t, rates, others[fold_of(t[1])]) for t in train]), y, trees=80, depth=4)
    sent = pages.sparkSession.sparkContext.broadcast((trees, rates, Triples(by_host)))

    def task():
        fitted, known, odds = sent.value

        def work(batch: pa.RecordBatch) -> dict:
            x = [lexical(*r, known, odds) for r in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True)]
            return {c: batch.column(c) for c in ("page_id", "host", "path")} | {"score": fitted.probability(np.array(x).reshape(len(x), -1))}

        return work

    kind = picked.schema["page_id"].dataType.simpleString()
    scored = map_batches(picked, f"page_id {kind}, host string, path string, score double", task)
    fitting = F.coalesce(*[F.when(r.fits(F.col("host"), F.col("path")), F.lit(i)) for i, r in enumerate(parsed)], F.lit(None))
    scored = scored.withColumn("n", fitting.cast("int"))
    texts, verdicts = (F.array(*[F.lit(getattr(r, k)) for r in parsed]).cast("array<string>") for k in ("text", "verdict"))
    by_score = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.get(texts, "n").alias("rule"), F.coalesce(F.get(verdicts, "n"), by_score).alias("verdict"), "score"
    )
