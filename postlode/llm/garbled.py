"""Text decoded with the wrong character encoding: finding it and restoring it by noisy-channel decoding.

A damaged text is what somebody meant (drawn from the words of the corpus) after a channel: encoded with one code page and
decoded with another, possibly twice, with letter case changed afterwards, cut off within a character, or with bytes lost for
good. For each token the channels are run backwards. Where that gives definite bytes, each reading is one path; where bytes are
lost (U+FFFD, a lead byte whose continuation is gone) the reading is a lattice of slots, and a Viterbi beam finds its best path.
Paths are weighed by corpus word frequencies, backed off to characters in context, against the hypothesis that the token is as
meant.

The corpus model is a set of count sketches whose size is fixed by parameters, whatever the corpus: word counts (count-min) and
counts of 1 to 3 characters in hashed cells. They are trained on all tokens of all rows by summing partial sketches, so what the
driver receives and broadcasts is bounded (CELLS). Tokens are counted and judged once each, not once per row.

Defined results for odd input
-----------------------------
* Null, empty and pure ASCII values are intact. U+FFFD and C1 control characters always are damage, restored or not, as intact
  text has none of them.
* Of lost bytes only what stands out is restored: the best reading must have SETTLED of the weight of all, and a word lost as a
  whole has none. Copies of a damaged value are no evidence that it is intact where it reads as UTF-8 and has a sign in a word; a
  value read with the wrong single-byte page that has more copies than its right form can still pass for intact.
* Digits fold to 0 before decoding, so four-byte sequences of GB18030 are not inverted. Pairs of bytes read as wide characters are
  weighed by kinds of ASCII characters, since the corpus model holds no ASCII words.
* A row delivered again counts once. Rows with a null store_id or seq are kept and reported like others.
* A value whose lost bytes can't be settled has a null restoration. Long texts are tokens like short ones; a token over
  LONGEST characters is judged in pieces of at most that length. They are cut where no likely reading has a character parted; a
  double-byte page without a single ASCII character may still have one parted at a cut.
* Further columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlode.llm import bloom
from postlode.session import checkpointed

#: Code pages that text may have been read with (WRONG) or written in (RIGHT).
WRONG_SINGLE = ["cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15"]
WRONG_MULTI = ["gbk", "cp932", "big5", "euc_kr"]
RIGHT_SINGLE = ["cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9"]
RIGHT_MULTI = ["gb18030", "cp932", "euc_jp", "big5", "euc_kr"]
_CASE_BY_32 = {"cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_7", "iso8859_15"}

#: Sizes of the sketches: cells for words (by four hashes), three, two and one characters.
CELLS = {"w0": 1 << 20, "w1": 1 << 20, "w2": 1 << 20, "w3": 1 << 20, "3": 1 << 20, "2": 1 << 18, "1": 1 << 16}
_WORDS = ["w0", "w1", "w2", "w3"]
#: Most tasks that count the vocabulary into sketches.
TRAIN_TASKS = 256
#: Damaged tokens that may be broadcast, about 200 bytes each; more are joined.
BROADCAST_TOKENS = 200_000
LONGEST = 400
#: Characters of tokens whose readings are held at once.
AT_ONCE = 20_000
#: Log prior odds of damage, by kind of channel: text that happens to be valid UTF-8 in another reading is strong evidence itself.
PRIOR = {"utf8": 6.0, "utf16": -4.0, "mixed": 2.0, "cut": -1.5, "multi": -2.0, "single": -2.0, "lattice": -4.0}
#: Further log odds by the token's length where only a single-byte or multi-byte page says so: one or two characters prove little.
SHORT = {1: -3.5, 2: -0.5}
#: Share of a token's probability that comes from its own count; the rest is spelled by characters.
OWN = 0.7
BEAM = 48
LOST = "lost bytes"
#: Classes of characters that lost bytes may have been.
CLASSES = ("single", "two", "three")
#: Least share of the best reading among all readings with lost characters for it to be a restoration.
SETTLED = 0.4
_START, _END = "\x02", "\x03"

#: Runs of characters from @ upwards and digits that hold a character beyond ASCII. Space and ASCII punctuation never are part of a
#: multi-byte sequence, so damage never spans two tokens. Digits fold to one 0.
TOKENS = r"regexp_extract_all(regexp_replace(value, '[0-9]+', '0'), '[^\\x00-\\x2F\\x3A-\\x3F]*[^\\x00-\\x7F][^\\x00-\\x2F\\x3A-\\x3F]*', 0)"


# --- the corpus model ---------------------------------------------------------------------------------------------------


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each with start and end marks, as one array, and where each text starts in it."""
    joined = "".join(f"{_START}{_START}{t}{_END}" for t in texts)
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _cell3(a, b, c):
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) % 0xFFFFFFFB & (CELLS["3"] - 1)


def _cell2(b, c):
    return ((b * 0x9E3779B1) ^ (c * 0x85EBCA77)) % 0xFFFFFFFB & (CELLS["2"] - 1)


def _word_cells(texts: list[str]) -> np.ndarray:
    """A row of cells for each of the four word sketches: 20 bits each of one 128-bit hash."""
    raw = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    return (np.frombuffer(raw, np.uint32).reshape(-1, 4).T & (CELLS["w0"] - 1)).astype(np.int64)


class Model:
    """Log probabilities of tokens under the sketches. All lookups are of the lower-case form."""

    def __init__(self, cells: dict[str, np.ndarray]):
        self.cells = cells
        self.words = max(1.0, float(cells["w0"].sum()))
        self.chars = max(1.0, float(cells["1"].sum()))

    def spelled(self, last2, last1, nxt):
        """Log probability of nxt after two characters, interpolated from three, two and one characters in context."""
        n3, n2, n1 = self.cells["3"][_cell3(last2, last1, nxt)], self.cells["2"][_cell2(last1, nxt)], self.cells["1"][nxt & (CELLS["1"] - 1)]
        c2, c1 = self.cells["2"][_cell2(last2, last1)], self.cells["1"][last1 & (CELLS["1"] - 1)]
        # a context seen seldom says little: its weight falls with its count
        w3, w2 = c2 / (c2 + 8.0), c1 / (c1 + 20.0)
        low = 0.98 * n1 / self.chars + 0.02 / 40_000
        mid = w2 * np.minimum(n2, c1) / (c1 + 1e-9) + (1 - w2) * low
        return np.log(0.995 * (w3 * np.minimum(n3, c2) / (c2 + 1e-9) + (1 - w3) * mid) + 0.005 * low)

    def score(self, tokens: list[str], open_end: list[bool] | None = None) -> np.ndarray:
        """Log probability of each token. Where open_end is true the token is cut off, so that it needn't end there."""
        if not tokens:
            return np.zeros(0)
        low = [t.lower() for t in tokens]
        codes, starts = _codes(low)
        each = np.zeros(len(codes))
        each[2:] = self.spelled(codes[:-2], codes[1:-1], codes[2:])
        each[starts] = 0.0
        each[starts + 1] = 0.0
        if open_end is not None:
            ends = np.append(starts[1:], len(codes)) - 1
            each[ends[np.array(open_end, bool)]] = 0.0
        spelled = np.add.reduceat(each, starts)
        own = np.min([self.cells[k][at] for k, at in zip(_WORDS, _word_cells(low), strict=True)], axis=0).astype(float) / self.words
        return np.logaddexp(np.log(OWN * own + 1e-300), math.log(1 - OWN) + spelled)

    def options(self, kind: str) -> np.ndarray:
        """The characters beyond ASCII that the corpus has and that a slot may hold: those of two or of three bytes in UTF-8, or those of
        a single-byte page."""
        if not hasattr(self, "_by_kind"):
            seen = np.nonzero(self.cells["1"])[0]
            seen = seen[(seen > 0xA0) & (seen != 0xFFFD) & ~((seen >= 0xD800) & (seen < 0xF900)) & (seen < 0xFFF0)].astype(np.uint64)
            pages = np.array(sorted({ord(c) for name in RIGHT_SINGLE for c in _page(name)}), np.uint64)
            self._by_kind = {"two": seen[seen < 0x800], "three": seen[seen >= 0x800], "single": seen[np.isin(seen, pages)]}
        return self._by_kind[kind]

    def lowered(self, options: np.ndarray) -> np.ndarray:
        """The lower-case form of each of the characters."""
        if not hasattr(self, "_low"):
            self._low: dict[bytes, np.ndarray] = {}
        key = options.tobytes()
        if key not in self._low:
            self._low[key] = np.array([ord(chr(int(c)).lower()[:1]) for c in options], np.uint64)
        return self._low[key]


def train(vocabulary: DataFrame) -> Model:
    """The model of (token, n): every partition counts into sketches of fixed size, whose non-zero cells are summed by Spark."""

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = {k: np.zeros(n) for k, n in CELLS.items()}
        for frame in frames:
            low, n = [t.lower() for t in frame["token"]], frame["n"].to_numpy(np.float64)
            if not low:
                continue
            for k, at in zip(_WORDS, _word_cells(low), strict=True):
                np.add.at(cells[k], at, n)
            codes, starts = _codes(low)
            weight = np.repeat(n, np.diff(np.append(starts, len(codes))))
            real = np.ones(len(codes), bool)
            real[starts] = False
            first = real.copy()
            first[starts + 1] = False
            at = np.nonzero(first)[0]  # every character but the start marks, and the end mark
            np.add.at(cells["3"], _cell3(codes[at - 2], codes[at - 1], codes[at]), weight[at])
            np.add.at(cells["2"], _cell2(codes[at - 1], codes[at]), weight[at])
            np.add.at(cells["2"], _cell2(codes[starts], codes[starts + 1]), weight[starts])
            np.add.at(cells["1"], (codes[at] & (CELLS["1"] - 1)).astype(np.int64), weight[at])
            np.add.at(cells["1"], (codes[starts + 1] & (CELLS["1"] - 1)).astype(np.int64), weight[starts])
        every = np.concatenate([cells[k] for k in CELLS])
        at = np.nonzero(every)[0]
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": every[at]})

    # at most TRAIN_TASKS times sum(CELLS) rows are added up, and sum(CELLS) rows of 12 bytes reach the driver
    summed = vocabulary.select("token", "n").coalesce(TRAIN_TASKS).mapInPandas(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros(sum(CELLS.values()), np.float32)
    every[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    ends = np.cumsum(list(CELLS.values()))
    return Model({k: every[end - n : end] for (k, n), end in zip(CELLS.items(), ends, strict=True)})


# --- the channels, backwards --------------------------------------------------------------------------------------------


@cache
def _page(name: str) -> str:
    """The 256 characters of a single-byte code page; bytes it leaves open stand for the C1 control of their number, as readers do."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@cache
def _encoders() -> list[tuple[str, object]]:
    """(name, function from text to bytes) of every wrong reading. Windows-1252 also takes the C1 controls of Latin-1."""
    found = []
    for name in WRONG_SINGLE:
        page = _page(name)
        table = {ord(c): bytes([b]) for b, c in enumerate(page)}
        if name == "cp1252":
            table |= {b: bytes([b]) for b in range(128, 160)}
        whole = {k: v[0] for k, v in table.items()}
        found.append((name, lambda s, t=whole: codecs.charmap_encode(s, "strict", t)[0]))
    return found + [(name, lambda s, n=name: s.encode(n)) for name in WRONG_MULTI]


@cache
def _decoders() -> list[tuple[str, object]]:
    multi = [(name, lambda b, f=codecs.getincrementaldecoder(name): _whole(f(), b)) for name in RIGHT_MULTI]
    return [(name, lambda b, p=_page(name): codecs.charmap_decode(b, "strict", p)[0]) for name in RIGHT_SINGLE] + multi


def _whole(decoder: codecs.IncrementalDecoder, data: bytes) -> str:
    """Decoded text; a character cut off at the end is a lost one."""
    text = decoder.decode(data)
    return text + "�" if decoder.getstate()[0] else text


def _utf8(data: bytes) -> str:
    text, used = codecs.utf_8_decode(data, "strict", False)
    return text if used == len(data) else text + "�"


def _recased_utf8(data: bytes, lowered: bool = False) -> str:
    """UTF-8 whose bytes were letters of a code page when letter case was changed: there, case is 32 apart, so a lead byte may be 32
    off; 0xFF stands for 0x9F. As bytes are they are preferred; with lowered, continuations are put back to capitals too.
    ValueError where no reading is valid."""
    out, i, n = [], 0, len(data)
    cont = [0x9F if b == 0xFF else b - 16 if lowered and b in (0x9A, 0x9C, 0x9E) else b if 0x80 <= b < 0xC0 else 0 for b in data]
    while i < n:
        b = data[i]
        if b < 0x80:
            out.append(chr(b))
            i += 1
            continue
        sizes = [(lead, 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0) for lead in (b, b - 32, b + 32)]
        for lead, size in sizes:
            if size and i + size <= n and all(cont[i + 1 : i + size]):
                try:
                    out.append(bytes([lead, *cont[i + 1 : i + size]]).decode("utf-8"))
                except ValueError:
                    continue
                i += size
                break
        else:
            if not any(size and i + size > n and all(cont[i + 1 : n]) for _, size in sizes):
                raise ValueError("no sequence")
            out.append("�")
            i = n
    return "".join(out)


_CONTINUATIONS = bytes(range(0x80, 0xC0))
#: Fixed value: signs of text that start with the byte E2.
_SIGNS = "–—‘’‚“”„†‡•…‰‹›€™"


@cache
def _bytes_of(name: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_page(name))}


def _tails(data: bytes) -> list[str]:
    """What the sequence that is cut off at the end of data may have been: all that its lead allows if only one byte is lost; the
    signs of text after a lone E2; nothing where that leaves thousands."""
    for size in (1, 2, 3):
        tail = data[-size:]
        if len(tail) == size and 0xC2 <= tail[0] <= 0xEF and all(0x80 <= b < 0xC0 for b in tail[1:]):
            need = 2 if tail[0] < 0xE0 else 3
            if need == size + 1:
                return [c for last in range(0x80, 0xC0) if (c := (tail + bytes([last])).decode("utf-8", "ignore")) and c >= "\xa0"]
            return list(_SIGNS) if tail == b"\xe2" else []
    return []


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _part_utf8(data: bytes, text: str) -> str:
    """text, whose characters are the bytes of data, with the UTF-8 sequences in it decoded and all else as it is: only a part of it
    was damaged. ValueError without any."""
    out, at = [], 0
    for m in _SEQUENCE.finditer(data):
        out += [text[at : m.start()], m[0].decode("utf-8")]  # ValueError for surrogates and overlong forms
        at = m.end()
    if not at:
        raise ValueError("no sequence")
    return "".join(out) + text[at:]


def _lowered_utf8(data: bytes) -> str:
    return _recased_utf8(data, lowered=True)


#: Marks a reading that goes on beyond the end of the token.
_OPEN = "\ufffc"
_BAD = {c for c in range(0x80, 0xA0)} | {c for c in range(0x20)} | {0x7F}


def _plausible(text: str) -> bool:
    return not any(ord(c) in _BAD for c in text)


def readings(token: str) -> dict[str, tuple[str, str]]:
    """What the token may have meant: {text: (kind, channel)}. Texts that end in U+FFFD are cut off within a character."""
    found: dict[str, tuple[str, str]] = {}
    layer = [(token, "")]
    for _ in range(3):  # text damaged on damaged text
        nxt = []
        for text, by in layer:
            for name, encode in _encoders():
                try:
                    data = encode(text)
                except ValueError:
                    continue
                for read in (_utf8, _recased_utf8, _lowered_utf8):
                    if read is not _utf8 and name not in _CASE_BY_32:
                        break
                    try:
                        meant = read(data)
                    except ValueError:
                        continue
                    channel = f"utf-8>{name}{by and ' '}{by}"
                    if meant.endswith("�"):  # cut within a character: what it may have been, and that the text went on
                        bare = meant[:-1].isascii()
                        if len(token) > 1 or name == "cp1252":
                            for c in _tails(data):
                                found.setdefault(f"{meant[:-1]}{c}{_OPEN}", ("cut" if bare else "utf8", channel))
                        if bare:
                            meant = "�"
                    if meant not in found and meant not in (token, text) and meant.strip("�"):
                        found[meant] = ("multi" if len(token) == 1 else "utf8", channel)
                        nxt.append((meant, channel))
                    if read is _utf8 and text != text.lower():
                        break
                if len(data) == len(text):
                    head = len(data) - len(data.lstrip(_CONTINUATIONS))
                    try:
                        # the first bytes of its first character are lost; Windows-1252 has no letters there but Š, Œ, Ž, š, œ, ž and Ÿ
                        if 0 < head < 4 and name == "cp1252" and not data[head:].isascii() and not (rest := _utf8(data[head:])).endswith("�"):
                            found.setdefault("�" + rest, ("utf8", f"utf-8>{name} from within a character"))
                        found.setdefault(_part_utf8(data, text), ("mixed", f"utf-8>{name} in part{by and ' '}{by}"))
                    except ValueError:
                        continue
        layer = nxt
        if not layer:
            break
    if "_" in token:  # parts of a token that no code page holds whole
        for name in WRONG_SINGLE:
            table = _bytes_of(name)
            try:
                found.setdefault(_part_utf8(bytes(table.get(c, 0) for c in token), token), ("mixed", f"utf-8>{name} in part"))
            except ValueError:
                continue
    if len(token) > 2 and not any("@" <= c < "\x80" for c in token):
        for name in ("utf-16-le", "utf-16-be"):
            try:
                meant = token.encode(name).decode("utf-8")
            except ValueError:
                continue
            if meant.isprintable():
                found.setdefault(meant, ("utf16", f"utf-8>{name}"))
    low = token.lower()
    for name, encode in _encoders():
        try:
            data = encode(token)
        except ValueError:
            continue
        for right, decode in _decoders():
            if right == name:
                continue
            try:
                meant = decode(data)
            except ValueError:
                continue
            if meant not in found and meant.lower() != low and not (meant.endswith("�") and meant[:-1].isascii()):
                found[meant] = ("single" if right in RIGHT_SINGLE else "multi", f"{right}>{name}")
    return {t: v for t, v in found.items() if _plausible(t)}


# --- pieces of long tokens ----------------------------------------------------------------------------------------------


#: Where a piece may end: so many characters before LONGEST. More than the bytes of two characters in any reading, twice damaged.
_ROOM = 64
#: A lead byte, or one whose letter case was changed, with its continuations.
_LOOSE = re.compile(rb"[\xc2-\xfe][\x80-\xbf]{1,3}")


def _inside(chars: list[str], ends: list[int], depth: int = 3) -> dict[int, float]:
    """{place: weight of the readings as UTF-8 in which a cut there parts a character}. chars[i] ends at place ends[i]. A reading
    weighs much if nearly all characters beyond ASCII are in sequences, which chance doesn't give."""
    parted: dict[int, float] = {}
    wide = max(1, sum(c > "\x7f" for c in chars))
    for name, encode in _encoders():
        data, at = [], {0: 0}  # at: byte offset -> number of characters before it
        size = 0
        for i, c in enumerate(chars):
            try:
                b = encode(c)
            except ValueError:
                b = b"\0"
            data.append(b)
            size += len(b)
            at[size] = i + 1
        joined = b"".join(data)
        spans = [m.span() for m in (_LOOSE if name in WRONG_SINGLE else _SEQUENCE).finditer(joined)]
        weight = 10 * min(1.0, sum(a in at for s, e in spans for a in range(s + 1, e + 1)) / wide) ** 4
        for s, e in spans:
            for k in range(s + 1, e):
                if k in at:
                    parted[ends[at[k] - 1]] = parted.get(ends[at[k] - 1], 0.0) + weight
        if depth > 1 and weight > 0.5 and name in WRONG_SINGLE:  # text damaged on damaged text
            read, stops, i = [], [], 0
            for m in _SEQUENCE.finditer(joined):
                read += chars[i : m.start()] + [m[0].decode("utf-8", "replace")[0]]
                stops += ends[i : m.start()] + [ends[m.end() - 1]]
                i = m.end()
            if i:
                for place, n in _inside(read + chars[i:], stops + ends[i:], depth - 1).items():
                    parted[place] = parted.get(place, 0.0) + n * weight / 40
    return parted


def _between(text: str) -> dict[int, float]:
    """{place: weight of the readings of text, from its start, in multi-byte pages in which a cut there parts a character}. They take
    nearly any bytes, so they weigh little."""
    parted: dict[int, float] = {}
    for name, encode in _encoders():
        if name in WRONG_MULTI:
            continue
        try:
            data = encode(text)
        except ValueError:
            continue
        for right in RIGHT_MULTI:
            decoder, places = codecs.getincrementaldecoder(right)(), []
            try:
                for i in range(len(data)):
                    decoder.decode(data[i : i + 1])
                    if decoder.getstate()[0]:
                        places.append(i + 1)
            except ValueError:
                continue
            for place in places:
                parted[place] = parted.get(place, 0.0) + 0.1
    return parted


def pieces(token: str) -> list[str]:
    """token in successive pieces of at most LONGEST characters, cut where the least weight of readings has a character or a run of
    lost bytes parted, best of all after an underscore."""
    found, start = [], 0
    while len(token) - start > LONGEST:
        least, most = start + LONGEST - _ROOM, start + LONGEST
        # UTF-8 is told from the bytes around; other pages only from where the text starts
        near = token[least - _ROOM : most + _ROOM]
        parted = {least - _ROOM + k: n for k, n in _inside(list(near), list(range(1, len(near) + 1))).items()}
        for k, n in _between(token[start:most]).items():
            parted[start + k] = parted.get(start + k, 0.0) + n
        for k in range(least, most + 1):
            if token[k - 1 : k + 1] == "��":
                parted[k] = parted.get(k, 0.0) + 1000
        end = min(range(least, most + 1), key=lambda k: (parted.get(k, 0.0), token[k - 1] != "_", -k))
        found.append(token[start:end])
        start = end
    return [*found, token[start:]]


# --- lattices -----------------------------------------------------------------------------------------------------------


#: Edges from each place of a token: (place they lead to, a text, an array of the characters that may stand there, or the name of a
#: class of them, see Model.options).
Lattice = list[list[tuple[int, "str | np.ndarray"]]]


def lattices(token: str) -> list[Lattice]:
    """Readings with lost bytes as lattices over the places of the token. U+FFFD stands for a lost byte: of UTF-8, so that two or three
    of them are a character of that length, or of a single-byte page."""
    found: list[Lattice] = []
    n = len(token)
    if "�" in token:
        lost = [c == "�" for c in token] + [False] * 3
        literal = lambda i: [(i + 1, token[i])]
        found.append([[(i + 1, "single")] if lost[i] else literal(i) for i in range(n)])
        found.append([[(i + k, name) for k, name in ((2, "two"), (3, "three")) if all(lost[i : i + k])] if lost[i] else literal(i) for i in range(n)])
    for name in WRONG_SINGLE:  # lead bytes of UTF-8 whose continuations, or the last of them, were dropped
        table = _bytes_of(name)
        data = [table.get(c, ord(c) if 0x80 <= ord(c) < 0xA0 else -1) for c in token]
        if -1 in data and name != "cp1252":
            continue
        edges: Lattice = [[] for _ in token]
        whole, lost_ones, i, possible = 0, 0, 0, True
        while i < n:
            b = data[i]
            need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 0
            have = 0
            while have < need and i + have + 1 < n and 0x80 <= data[i + have + 1] < 0xC0:
                have += 1
            if need and have == need:
                edges[i].append((i + need + 1, bytes(data[i : i + need + 1]).decode("utf-8", "replace")))
                whole += 1
            elif need and need - have == 1:
                edges[i].append((i + have + 1, _options(bytes(data[i : i + have + 1]))))
                lost_ones += 1
                possible &= len(edges[i][0][1]) > 0
            else:
                edges[i].append((i + 1, token[i]))
                have = 0
            i += have + 1
        # elsewhere than in Windows-1252 lead bytes are everyday letters, so that sequences that are whole must bear the reading out
        if lost_ones and possible and (name == "cp1252" or whole >= 2 * lost_ones):
            found.append(edges)
    return found


@cache
def _options(start: bytes) -> np.ndarray:
    """The characters whose UTF-8 is start and one more byte."""
    texts = ((start + bytes([last])).decode("utf-8", "ignore") for last in range(0x80, 0xC0))
    return np.array([ord(t) for t in texts if len(t) == 1 and t >= "\xa0"], np.uint64)


def viterbi(lattice: Lattice, model: Model) -> list[str]:
    """The best texts through a lattice: at each place a beam over the two last characters, weighed by characters in context; the paths
    that remain are put in the order of their token probability."""
    low = lambda c: ord(c.lower()[:1])
    beams: list[list[tuple[float, str]]] = [[] for _ in range(len(lattice) + 1)]
    beams[0] = [(0.0, _START + _START)]
    for place, edges in enumerate(lattice):
        beam = sorted(beams[place], key=lambda x: (-x[0], x[1]))[:BEAM]
        beams[place] = []
        if not beam:
            continue
        for to, what in edges:
            options = model.options(what) if isinstance(what, str) and what in CLASSES else what
            if isinstance(options, str):
                grown = beam
                for ch in options:
                    step = model.spelled(np.array([low(p[-2]) for _, p in grown], np.uint64), np.array([low(p[-1]) for _, p in grown], np.uint64), np.uint64(low(ch)))
                    grown = [(s + float(x), p + ch) for (s, p), x in zip(grown, step, strict=True)]
                beams[to] += grown
            elif len(options):
                before = np.array([[low(p[-2]), low(p[-1])] for _, p in beam], np.uint64)
                total = np.array([s for s, _ in beam])[:, None] + model.spelled(before[:, :1], before[:, 1:], model.lowered(options)[None, :])
                best = np.argpartition(-total, BEAM, axis=None)[:BEAM] if total.size > BEAM else range(total.size)
                beams[to] += [(float(total.flat[k]), beam[k // len(options)][1] + chr(int(options[k % len(options)]))) for k in map(int, best)]
    texts = sorted({p[2:] for _, p in sorted(beams[-1], key=lambda x: (-x[0], x[1]))[:BEAM]})
    order = np.argsort(-model.score(texts), kind="stable")
    return [texts[i] for i in order]


# --- verdicts -----------------------------------------------------------------------------------------------------------


#: Log probability of a wide character drawn by chance.
_WIDE = -9.9


#: Log odds per character against a token of intact text with a sign within a word, see _torn.
_RARE = 4.5


def _torn(token: str) -> bool:
    """Whether a letter beyond ASCII has a sign beyond ASCII right after it. In a word of intact text that hardly occurs, however often
    the token does: where such a token reads as UTF-8, its own copies are no evidence that it is intact."""
    return any(a > "\xbf" and a.isalpha() and "\x7f" < b and not b.isalpha() for a, b in zip(token, token[1:], strict=False))


def _ascii_score(text: str) -> float:
    """Log probability of ASCII text by the kinds of its characters; small letters before capitals are rare in it. Text that isn't
    mostly letters, as kana give when taken apart, has none."""
    each = {"a": -2.9, "A": -5.0, "0": -4.5, " ": -1.9, ".": -6.5}
    text = text.lower() if text == text.upper() else text
    kinds = ["a" if c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c if c == " " else "." for c in text]
    if sum(k in "aA " for k in kinds) < 0.6 * len(kinds):
        return -math.inf
    return sum(each[k] for k in kinds) - 4.0 * sum(a == "a" and b == "A" for a, b in zip(kinds, kinds[1:], strict=False))


def judge(tokens: list[str], model: Model) -> list[tuple[float, str | None, str | None]]:
    """For each token (gain, channel, restoration): gain is the log odds that it is damaged, above 0 if it is; the restoration is
    null where lost characters can't be settled. A token over LONGEST is judged in pieces, each by itself: it is damaged if one of
    them is, and its restoration is theirs, joined."""
    cut = [pieces(t) for t in tokens]
    flat = [(p, len(ps) > 1 and k > 0, k + 1 < len(ps)) for ps in cut for k, p in enumerate(ps)]
    done: list[tuple[float, str | None, str | None]] = []
    start = size = 0
    for i, (piece, _, _) in enumerate(flat):  # readings are many times their piece, so only so many characters are read at once
        size += len(piece)
        if size >= AT_ONCE or i + 1 == len(flat):
            done += _judge(flat[start : i + 1], model)
            start, size = i + 1, 0
    out, at = [], 0
    for ps in cut:
        each = done[at : at + len(ps)]
        at += len(ps)
        if len(ps) == 1:
            out += each
            continue
        texts = [text if gain > 0 else p for p, (gain, _, text) in zip(ps, each, strict=True)]
        channels = sorted({c for gain, c, _ in each if gain > 0 and c})
        out.append((max(e[0] for e in each), ", ".join(channels) or None, None if None in texts else "".join(texts)))
    return out


def _judge(parts: list[tuple[str, bool, bool]], model: Model) -> list[tuple[float, str | None, str | None]]:
    """judge() for pieces of at most LONGEST characters: (text, whether more stands before it, whether more follows)."""
    cands: list[str] = []
    kinds: list[tuple[str, str]] = []
    spans: list[tuple[int, int]] = []
    for token, before, after in parts:
        start = len(cands)
        if not token.isascii():
            for text, kind in readings(token).items():
                # a piece was cut by us, between characters: there it has lost nothing
                if after and text.endswith(("�", _OPEN)) and not token.endswith("�") or before and text.startswith("�") and not token.startswith("�"):
                    continue
                cands.append(text)
                kinds.append(kind)
        if "�" in token or any(c in _LEADS for c in token):
            for lattice in lattices(token):
                for text in viterbi(lattice, model):
                    cands.append(text)
                    kinds.append(("lattice", LOST))
        spans.append((start, len(cands)))
    # intact text never has U+FFFD or C1 controls: the hypothesis that a token with one is as meant has none to speak of
    lost = ["�" in t or any("\x80" <= c < "\xa0" for c in t) for t, _, _ in parts]
    plain = np.where(lost, -1e5, model.score([t for t, _, _ in parts]))
    scores = model.score([c.strip("�" + _OPEN) for c in cands], [c.endswith(("�", _OPEN)) for c in cands])
    out = []
    for (token, _, _), own, certain, (start, end) in zip(parts, plain, lost, spans, strict=True):
        best, weights = None, []
        torn = max(0.0, own + _RARE * len(token)) if _torn(token) else 0.0
        for i in range(start, end):
            kind = kinds[i][0]
            # pairs of bytes taken for wide characters: the value is a token by itself, so its count says nothing, and its text is ASCII,
            # which the model has none of; as letters in a row it is weighed against characters drawn by chance
            odds = PRIOR[kind] + (SHORT.get(len(token), 0.0) if kind in ("single", "multi") else torn if kind == "utf8" else 0.0)
            g = odds + (_ascii_score(cands[i]) - _WIDE * len(token) + own if kind == "utf16" else scores[i])
            weights.append(g)
            if best is None or g > weights[best - start]:
                best = i
        gain = weights[best - start] - own if weights else 1e5 if certain else -math.inf
        text = cands[best].rstrip(_OPEN) if best is not None else None
        # of a word that is lost as a whole only the length is known
        if text is not None and ("�" in text or not token.strip("�") and any(map(str.isalnum, text))):
            text = None
        if text is not None and kinds[best][0] == "lattice":  # several readings of the same text are one
            same = [w for i, w in zip(range(start, end), weights, strict=True) if cands[i].rstrip(_OPEN) == text]
            if np.logaddexp.reduce(same) - np.logaddexp.reduce(weights) < math.log(SETTLED):
                text = None
        out.append((float(gain), kinds[best][1] if best is not None else None, text))
    return out


#: What lead bytes of UTF-8 read as in one of the wrong pages.
_LEADS = {c for name in WRONG_SINGLE for c in _page(name)[0xC2:0xF0]}


def verdicts(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(token, gain, channel, restored) of the damaged tokens."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model.cells)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(shared.value)
        for frame in frames:
            tokens = frame["token"].tolist()
            rows = [(t, *v) for t, v in zip(tokens, judge(tokens, own), strict=True) if v[0] > 0]
            yield pd.DataFrame(rows, columns=["token", "gain", "channel", "restored"])

    # a vocabulary is small in bytes and dear in time, so it is spread further than its bytes ask for
    parts = 3 * vocabulary.sparkSession.sparkContext.defaultParallelism
    return vocabulary.select("token").repartition(parts, "token").mapInPandas(run, "token string, gain double, channel string, restored string")


def suspects(rows: DataFrame) -> DataFrame:
    """Rows (any keys, value) whose value has a character beyond ASCII, with their distinct tokens."""
    return rows.where(F.col("value").rlike(r"[^\x00-\x7F]")).withColumn("tokens", F.array_distinct(F.expr(TOKENS)))


def damaged(rows: DataFrame, keys: list[str], salts: int = 8, broadcast: int = BROADCAST_TOKENS) -> DataFrame:
    """The rows (keys, value) with damaged tokens, once per key: keys, value and fixes, an array of (token, channel, restored).

    Damaged tokens are broadcast once they are counted and no more than ``broadcast``; then no row is shuffled but those that have
    some. Beyond it they are joined: a token may be in a third of all rows, so the rows of a token are spread over salts tasks and
    the verdicts, which are one row per damaged token, are repeated. A Bloom filter of fixed size keeps most rows from that shuffle.
    """
    tokens = suspects(rows).select(*keys, "value", F.explode("tokens").alias("token"))
    vocabulary = checkpointed(tokens.groupBy("token").agg(F.count("*").alias("n")))
    found = checkpointed(verdicts(vocabulary, train(vocabulary)))
    if found.count() <= broadcast:
        hit = tokens.join(F.broadcast(found), "token")
    else:
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = _maybe(tokens, found, "token").withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).join(spread, ["token", "salt"])
    return hit.groupBy(*keys).agg(F.first("value").alias("value"), F.collect_set(F.struct("token", "channel", "restored")).alias("fixes"))


def _maybe(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be one of those of ``of``, by a Bloom filter of fixed size."""
    table = bloom.built(of.select(F.xxhash64(key).alias("h")), "h")
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.passes(shared.value, h.to_numpy()))

    return rows.where(passes(F.xxhash64(key)))


def _restored(value: str, fixes: Iterable) -> str | None:
    """value with each damaged token put right, digits as they were; null if one of them can't be. Lost characters are found in small
    letters: they are capitals in a token of capitals, and at the start of a token that starts the value or stands among others
    that all start with one."""
    by = {f["token"]: f["restored"] for f in fixes}
    if any(v is None for v in by.values()):
        return None
    lost = {f["token"] for f in fixes if "channel" in f and f["channel"] == LOST}
    titled = all(w[0].isupper() for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"\S*�\S*|\.\w+$", "", value)))

    def right(m: re.Match) -> str:
        token = re.sub("[0-9]+", "0", m[0])
        fixed = by.get(token)
        if fixed is None:
            return m[0]
        if token in lost:
            kept = [c for c in token if c.isalpha()]
            if len(kept) > 1 and all(map(str.isupper, kept)):
                fixed = fixed.upper()
            elif token[0] == "�" and (m.start() == 0 or titled):
                fixed = fixed[:1].upper() + fixed[1:]
        digits = re.findall("[0-9]+", m[0])
        parts = fixed.split("0")
        return "".join(x for pair in zip(parts, [*digits, ""], strict=True) for x in pair) if len(parts) == len(digits) + 1 else fixed

    return re.sub(r"[^\x00-\x2F\x3A-\x3F]*[^\x00-\x7F][^\x00-\x2F\x3A-\x3F]*", right, value)


def restored(found: DataFrame) -> DataFrame:
    """damaged() with the value as it was meant (null if it can't be settled) in place of the fixes."""

    @F.pandas_udf("string")
    def put_right(value: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([_restored(v, f) for v, f in zip(value, fixes, strict=True)], dtype=object)

    return found.withColumn("restored", put_right("value", "fixes")).withColumn("channels", F.array_join(F.array_sort(F.array_distinct(F.col("fixes.channel"))), ", ")).drop("fixes")
