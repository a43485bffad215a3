"""Token ids of whole texts through the tokenizers library, with a piece cache.

Both kinds of tokenizer that are known here never merge across certain white
space, so a text is cut there into pieces, each distinct piece is encoded by
the library once, and a text's ids are its pieces' ids put together.  What kind
a tokenizer is follows from its own settings; any other kind encodes whole
texts.  Texts with the rare white space for which cutting would change the ids
are encoded whole, too, and so are texts that hold the string of an added token.  That
string is ordinary text, or with ``special_tokens`` the one id that the library's
plain call gives it.

Pieces are cut, counted and put together a column at a time; Python sees each
distinct piece of a column once.  New words go to the library many in one call.

Ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.arrow_map import held

#: Memory for the pieces that a worker remembers; further pieces are encoded anew in each column.
CACHE_BYTES = 48 << 20
#: Of a remembered piece, beside its bytes and its ids' bytes: two objects and a place in a table.
ENTRY_BYTES = 180
#: White space or the end after a space: the run of white space would span two pieces.
OPEN_RUN = r" (?:[ \t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\z)"
#: Words that go to the library as one string, and strings in one call.
TOGETHER, STRINGS = 32, 256
LETTER, MARK = 1, 2


def byte_signs() -> dict[int, str]:
    """The printable character by which byte-level tokenizers name each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in shown}
    return signs | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in signs)}


SIGNS = byte_signs()


def kind_of(settings: dict) -> str:
    """How texts may be cut: ``spaced`` (before a space), ``words`` (at white space) or ``whole``."""
    first, before = settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if settings.get("truncation") or settings.get("padding"):
        return "whole"
    if first is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "spaced"
    steps = [n.get("type") for n in (first or {}).get("normalizers", [])]
    cuts = before.get("pretokenizers") or [{}]
    pattern = (cuts[0].get("pattern") or {}).get("Regex", "")
    if steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" and "[^\\s" in pattern:
        return "words"
    return "whole"


BYTES = {sign: byte for byte, sign in SIGNS.items()}


def among_words(token: str) -> bool:
    """Whether a byte-level token may lie within words of letters with spaces or line feeds between them."""
    try:
        text = bytes(BYTES[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return True
    return all(c.isalpha() or c in " \n" for c in text)


class WordsTogether:
    """Encodes many words in one string by a tokenizer's model alone, where its vocabulary allows that.

    In ``spaced`` tokenizers words follow a space or, without one, a line feed; in no
    token may such a sign come after a letter, or a line feed before one.  In ``words``
    tokenizers the token that ends a word has a suffix.
    """

    def __init__(self, model, kind: str, vocabulary: dict[str, int]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.kind, self.usable = kind, True
        self.tokenizer = Tokenizer(model)
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.marked = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if kind == "spaced":
            space, feed = SIGNS[32], SIGNS[10]
            crossing = re.compile(f"[^{space}{feed}][{space}{feed}]|{feed}[^{space}{feed}]")
            self.usable = feed in vocabulary and not any(crossing.search(t) and among_words(t) for t in vocabulary)
            self.feed = vocabulary.get(feed, 0)
            self.tokenizer.pre_tokenizer = signs
            marked = (i for t, i in vocabulary.items() if t.startswith(space))
        else:
            suffix = model.end_of_word_suffix
            self.usable = bool(suffix)
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), signs])
            marked = (i for t, i in vocabulary.items() if suffix and t.endswith(suffix))
        self.marked[list(marked)] = True

    def encode(self, words: list[bytes], lead: str) -> list[bytes] | None:
        """Ids of each word, or None if they can't be told apart."""
        spaced, out = self.kind == "spaced", []
        between = b"\n" if spaced and not lead else b" "
        strings = [lead + between.join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        for at in range(0, len(strings), STRINGS):
            for found in self.tokenizer.encode_batch_fast(strings[at : at + STRINGS], add_special_tokens=False):
                ids = np.array(found.ids, "<u4")
                if spaced and not lead:
                    feeds = np.flatnonzero(ids == self.feed)
                    starts, ends = [0, *(feeds + 1).tolist()], [*feeds.tolist(), len(ids)]
                elif spaced:
                    starts = np.flatnonzero(self.marked[ids]).tolist()
                    ends = [*starts[1:], len(ids)]
                else:
                    ends = (np.flatnonzero(self.marked[ids]) + 1).tolist()
                    starts = [0, *ends[:-1]]
                data = ids.tobytes()
                out += [data[4 * s : 4 * e] for s, e in zip(starts, ends, strict=True)]
        return out if len(out) == len(words) and all(out) else None


class Cutter:
    """Cuts texts into pieces whose ids don't depend on what stands around them.

    A piece starts at each space; where letters and then punctuation make up all
    of it, the punctuation is a piece of its own.  A line feed between two words
    is one, too; in ``words`` tokenizers so is any other white space.
    """

    def __init__(self, kind: str):
        self.kind = kind
        #: LETTER for ASCII letters, the space, and the bytes of U+00C0 to U+024F; MARK for ASCII punctuation.
        self.classes = np.zeros(256, dtype=np.uint8)
        self.classes[[32, *range(65, 91), *range(97, 123), *range(0x80, 0xC0)]] = LETTER
        self.classes[0xC3 : 0xC4 if kind == "words" else 0xCA] = LETTER
        self.classes[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
        # Multiplication and division signs; for lower-casing tokenizers capitals, too.
        self.seconds = np.array([0x97, 0xB7, *(range(0x80, 0x9F) if kind == "words" else ())], dtype=np.uint8)
        #: Bytes that don't end, or begin, a white space character.
        self.safe = np.ones((2, 256), dtype=bool)
        self.safe[:, :33] = False
        self.safe[0, [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
        self.safe[1, [0xC2, 0xE1, 0xE2, 0xE3]] = False

    def cut(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Starts of the pieces in ``data``; ``texts`` are the starts of the texts and the end."""
        n = len(data)
        begins = data == 32
        begins[texts[:-1][texts[:-1] < n]] = True
        if self.kind == "words":
            apart = np.flatnonzero((data > 8) & (data < 14))
        else:
            apart = np.flatnonzero(data[1:-1] == 10) + 1
            apart = apart[self.safe[0][data[apart - 1]] & self.safe[1][data[apart + 1]]]
            edge = np.zeros(n + 1, dtype=bool)
            edge[texts] = True
            apart = apart[~(edge[apart] | edge[apart + 1])]
        begins[apart] = True
        begins[apart[apart + 1 < n] + 1] = True
        classes = self.classes[data]
        doubtful = np.flatnonzero(data[:-1] == 0xC3)
        classes[doubtful[np.isin(data[doubtful + 1], self.seconds)]] = 0
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        others, odd = np.flatnonzero(classes != LETTER), np.flatnonzero(classes == 0)
        at, at_odd = (np.searchsorted(x, np.append(starts, n)) for x in (others, odd))
        first = np.minimum(np.append(others, n)[at[:-1]], ends)
        parted = (first < ends) & (first > starts + (data[starts] == 32)) & (np.diff(at_odd) == 0) & (ends - first == np.diff(at))
        begins[first[parted]] = True
        return np.flatnonzero(begins)


class Pieces:
    """A tokenizer with the ids of the pieces that it has met."""

    def __init__(self, source: str, special_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = not special_tokens  # True: their strings in a text are ordinary text
        settings = json.loads(source)
        added = settings.get("added_tokens") or []
        #: Strings of tokens that the library looks for before it cuts a text.
        self.added = [t["content"] for t in added if special_tokens or not t.get("special")]
        self.kind = "whole" if any(t.get("normalized") for t in added) else kind_of(settings)
        #: Ids of pieces, and the memory that they take, about.
        self.known: dict[bytes, bytes] = {}
        self.held_bytes = 0
        self.together = None
        if self.kind != "whole":
            self.cutter = Cutter(self.kind)
            trial = WordsTogether(self.tokenizer.model, self.kind, settings["model"]["vocab"])
            words = ["the", "tionstandable", "zqxjkv", "ñandú", "größe", "a"]
            leads = ("", " ") if self.kind == "spaced" else ("",)
            if trial.usable and all(
                trial.encode([w.encode() for w in words], lead) == [self.whole(lead + w) for w in words] for lead in leads
            ):
                self.together = trial

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def is_word(self, word: bytes) -> bool:
        """Whether all of it is letters, and such as the tokenizer leaves alone if it normalises."""
        if not self.together or (word.isascii() and not word.isalpha()):
            return False
        if word.isascii():
            return True
        text = word.decode()
        return text.isalpha() and (self.kind == "spaced" or (max(text) < "\u0250" and text == text.lower()))

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces that are not known; those that fit are remembered."""
        spaced = self.kind == "spaced"
        out: list[bytes] = [b""] * len(pieces)
        groups: tuple[list[int], ...] = ([], [], [], [])  # words after a space, other words, the rest after a space, the rest
        for i, piece in enumerate(pieces):
            lead = piece[:1] == b" "
            word = piece[1:] if lead else piece
            groups[(0 if self.is_word(word) else 2) + (not lead)].append(i)
        for lead, own in ((" ", groups[0]), ("", groups[1])):
            if own:
                words = [pieces[i][1:] if lead else pieces[i] for i in own]
                ids = self.together.encode(words, lead if spaced else "")
                for i, found in zip(own, ids or [self.whole(pieces[i].decode()) for i in own], strict=True):
                    out[i] = found
        for start in range(0, len(groups[2]), 400):
            own = groups[2][start : start + 400]
            for i, found in zip(own, self.joined([pieces[i] for i in own]), strict=True):
                out[i] = found
        for i in groups[3]:
            out[i] = self.whole(pieces[i].decode())
        for piece, ids in zip(pieces, out, strict=True):
            if self.held_bytes >= CACHE_BYTES:
                break
            self.known[piece] = ids
            self.held_bytes += len(piece) + len(ids) + ENTRY_BYTES
        return out

    def joined(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that start with a space, from one call: tokens go to the piece in which they start."""
        texts = [p.decode() for p in pieces]
        starts = np.cumsum([0, *map(len, texts)])
        found = self.tokenizer.encode("".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = np.searchsorted(np.array([o[0] for o in found.offsets], "i8"), starts, "left")
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def to_encode_whole(self, texts: pa.Array) -> np.ndarray:
        """Numbers of the texts that can't be cut."""
        flags = [pc.match_substring(texts, a) for a in self.added]
        if self.kind == "words":
            flags += [pc.match_substring(pc.ascii_lower(texts), a) for a in self.added]
        else:
            flags.append(pc.match_substring_regex(texts, OPEN_RUN))
        out = np.zeros(len(texts), dtype=bool)
        for f in flags:
            out |= f.to_numpy(zero_copy_only=False)
        return np.flatnonzero(out)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of strings without nulls, one text after the other, and where each text's begin."""
        if self.kind == "whole":
            return put_together([self.whole(t) for t in texts.to_pylist()], np.arange(len(texts)), np.arange(len(texts) + 1))
        apart = self.to_encode_whole(texts)
        wholes = [self.whole(texts[int(i)].as_py()) for i in apart]
        if self.kind == "words":
            texts = pc.ascii_lower(texts)
        if len(apart):
            mask = np.zeros(len(texts), dtype=bool)
            mask[apart] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        texts = pa.concat_arrays([texts])  # a slice with its own buffers
        at = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)
        at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or at[0] == at[-1]:
            which, pieces, places = np.zeros(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
        else:
            data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
            at -= at[0]
            starts = self.cutter.cut(data, at)
            offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
            cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)])
            cut = cut.dictionary_encode()
            which, pieces = cut.indices.to_numpy().astype(np.int64), cut.dictionary.to_pylist()
            places = np.searchsorted(starts, at)
            del cut, offsets
        table: list[bytes | None] = [self.known.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(table) if ids is None]
        if missing:
            for i, ids in zip(missing, self.learn([pieces[i] for i in missing]), strict=True):
                table[i] = ids
        if len(apart):
            which = np.insert(which, places[apart], len(table) + np.arange(len(apart)))
            places = places + np.searchsorted(apart, np.arange(len(places)))
            table += wholes
        return put_together(table, which, places)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text."""
        ids, starts = self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def put_together(table: list[bytes], which: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``table[w]`` for w in ``which`` one after the other, and where those from each place on begin."""
    pool = np.frombuffer(b"".join(table), "<u4")
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    first = np.concatenate(([0], np.cumsum(lengths)))
    each = lengths[which]
    upto = np.concatenate(([0], np.cumsum(each)))
    source = np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1])
    return pool[source], upto[places]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and starts as of encode_column(), with ``end_id`` after each text."""
    starts = starts + np.arange(len(starts))
    out = np.empty(starts[-1], "<u4")
    ends = np.zeros(len(out), dtype=bool)
    ends[starts[1:] - 1] = True
    out[ends] = end_id
    out[~ends] = ids
    return out, starts


def pieces_for(source: str, special_tokens: bool = False) -> Pieces:
    """The worker's own Pieces for a tokenizer file's content, kept between tasks until others hold something."""
    return held(("tokens", hash(source), special_tokens), lambda: Pieces(source, special_tokens))


def read_tokenizer(path: str) -> str:
    """Content of a tokenizer file, to be sent to the executors (a vocabulary: a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
