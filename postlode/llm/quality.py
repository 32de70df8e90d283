"""Statistics of a text that tell prose from lists, tables and junk, and boosted trees over them.

A text is cut into units: its lines, and stretches of UNIT_WORDS words of longer ones. Quote marks at line starts, a greeting and
a closing are set aside. Each unit has a shape (bullet, table, field, log, code, encoded, signs or plain); plain units are placed
by how many of their words only clauses have (verbs, pronouns, conjunctions) and how many are frequent words at all. The
statistics of a document are shares of its visible characters over these, beside plain counts. None of them is a verdict: what
the shares mean together is learnt.

The weak labels look at whole blocks of a text, not at its statistics, and speak only of pure documents: nothing but structure, or
nothing but sentences. What lies between is learnt from texts put together from a pure one of each kind, of which it is known how
many characters belong to which.

Defined results for odd input
-----------------------------
* Null texts give null statistics, blank ones zeros; neither is ever junk. Whole texts are read, whatever their length.
* A word is a run of letters and digits, a symbol a visible character that is neither, a line ends in punctuation if its last
  visible character is one of . ! ? : ; … or a closing quote or bracket after one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import numpy as np

#: Words of clauses (verbs, pronouns, conjunctions) that noun phrases and labels do without, by language.
CLAUSAL = {
    "en": """after again am are before kindly be because been being but can could cannot did do does don t doesn didn else ever had has have he here how i if is isn
        it let may me might must neither never nobody nor not nothing one or please shall she should since so such than thank thanks that
        them then there they though although to unless until us was wasn we were what whatever when whenever where whether which while
        who whoever whom whose why will with within without would yet you and as by him seems hold holds told said asked need needs
        want wants wanted know knows think thought""",
    "de": """aber als auch bitte damit dann dass daß denn dich die du durch ein er es euch haben habe hat hatte hatten hätte ich ihm ihn ihnen
        ist kann kannst können könnte man mich mir mit muss müssen nicht nichts noch ob oder sehr sich sie sind soll sollen sondern um und
        uns war warum waren was weil wenn wer werde werden wie wir wird wo wurde wurden zu bleibt bleiben""",
    "fr": """ai ait après avant avec avez avons avait c car ce cela comme d depuis dont elle elles encore est et était étaient être faut faudrait
        il ils j je l leur lui m mais merci moi n ne nous ont ou où parce pas peut pouvez pour pourquoi pendant qu quand que qui s sa se
        sera si sommes son sont suis t trop tu vous y reste restent""",
    "es": """al antes aunque con cuando de desde donde durante el ella ellos en era eran es está están estaba favor fue ha había han has hay he la
        lo me mi muy ni no nos o para pero por porque puede puedes pueden que qué se ser si sí sido son su también tan te tenemos tiene tienen
        tú un una y ya yo quedan queda sabemos cómo""",
}
#: Frequent words of each language, articles and prepositions included.
COMMON = {
    "en": "the of and a to in is it you that he was for on are with as his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no than been its who now my over down only after most other any very just where much before too also our back her first because",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr bitte wenn kann mir uns",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son je nous vous mais on cette si leur y sans dont tout aux fait être même après été sa où ces avant encore pourquoi faut",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos",
}
#: How greetings and closings begin.
GREETING = r"(?:dear|hello|hi|hey|good (?:morning|afternoon|evening)|greetings|to whom|sehr geehrte\w*|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|bonjour|bonsoir|salut|cher|chère|madame|monsieur|hola|estimad[oa]s?|querid[oa]s?|buenos días|buenas tardes)\b"
CLOSING = r"(?:(?:kind|best|warm|many)?\s*regards|best(?: wishes)?|thanks|thank you|many thanks|cheers|sincerely|yours|cordially|all the best|see you|viele grüße|mit freundlichen grüßen|freundliche grüße|beste grüße|liebe grüße|gruß|grüße|danke|cordialement|bien à vous|merci|à bientôt|amicalement|salutations|saludos|un saludo|atentamente|gracias|un abrazo|hasta pronto)\b"

UNIT_WORDS = 24
SHAPES = ("plain", "bullet", "table", "field", "log", "code", "encoded", "signs")

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_CLAUSAL = {w for words in CLAUSAL.values() for w in words.split()} - {"die", "d", "de", "la", "el", "en", "un", "una", "al", "l", "su", "son", "sa", "mi", "ein", "one", "with", "by", "within", "without", "con", "mit", "avec", "para", "pour", "durch", "t", "s", "m", "n", "c", "o", "y"}
_COMMON = {k: set(v.split()) for k, v in COMMON.items()}
_ANY_COMMON = set().union(*_COMMON.values())
_KNOWN = _CLAUSAL | _ANY_COMMON
_WORD = re.compile(r"[^\W_]+")
_QUOTE = re.compile(r"^(?:\s*>)+ ?")
_GREETING = re.compile(rf"^\W*{GREETING}[^.?!]{{0,40}}[,:!.]?\s*$", re.I)
_CLOSING = re.compile(rf"^\W*{CLOSING}[^.?!]{{0,30}}[,.!]?\s*$", re.I)
_BULLET = re.compile(r"^\s*(?:[-*+•◦▪●○‣·–—»→]|[├└│─ ]*[├└]─+|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+\S|^\t+\S")
_LOG = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d\d:\d\d:\d\d|\w{3} +\d{1,2} \d\d:\d\d)|^\W{0,2}(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b", re.I)
_IDS = re.compile(r"\b(?:0x[0-9a-f]{4,}|[0-9a-f]{8}-[0-9a-f]{4}-)", re.I)
_FIELD = re.compile(r"^\W{0,2}[^\W\d_][\w /.\-]{0,28}\s*[:=]\s*\S")
_CODE = re.compile(r"""^\s*[{\[<}\]]|["']?\w+["']?\s*[:=]\s*["'{\[\d].*[,;{}]\s*$|[{}]|\w+=\S+.*\w+=\S+|</?\w+[^>]*>.*</?\w+|^\s*(?:def|class|import|from|var|let|const|function|SELECT|INSERT|UPDATE)\s.*[(;{=]""")
_TABLE = re.compile(r"\|.*\||\S\t+\S|\S {3,}\S.* {3,}\S|(?:[^;]{0,30};){3,}|(?:[^,.?! ]+,){3,}")
_HEX = re.compile(r"^(?:[0-9a-f]{4,8}[:\s]\s*)?(?:[0-9a-f]{2}[ :]){6,}|^[0-9A-Fa-f]{16,}$")
_LONG = re.compile(r"[A-Za-z0-9+/=_\-]{28,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_STOPS, _CLOSERS = ".!?:;…。！？", "\"'”’»)]"
_STOP_SET = set(_STOPS)
_SENTENCE = re.compile(r"[.!?…。！？]+(?:[\"'”’»)\]]*)(?:\s|$)")


def _shape(line: str, words: list[str], visible: int) -> str:
    """The shape of a unit. Each pattern is tried only where a character it needs is there."""
    letters = sum(map(len, words))
    if words and max(map(len, words)) >= 16 or letters >= 12 and len(words) > 5 and _HEX.match(line.strip()):
        if _HEX.match(line.strip()):
            return "encoded"
        longest = _LONG.search(line)
        if longest and len(longest[0]) > 0.4 * visible and not (longest[0].isalpha() and longest[0].islower()):
            return "encoded"
    pipes = line.count("|")
    if letters < 0.5 * visible:
        return "table" if pipes > 1 else "signs"
    if pipes > 1 or "\t" in line or "   " in line or line.count(",") > 2 or line.count(";") > 2:
        if pipes > 1 or _TABLE.search(line):
            return "table"
    first = line.lstrip()[:1]
    if (first.isdigit() or not first.isalpha() or first.isupper()) and _LOG.match(line) or "0x" in line or "-" in line and _IDS.search(line):
        if _LOG.match(line) or _IDS.search(line):
            return "log"
    if ("{" in line or "}" in line or "=" in line or "<" in line or "[" in line or ";" in line or first in "\"'") and _CODE.search(line):
        return "code"
    if (not first.isalpha() or line[:1] == "\t" or line[1:3].strip()[:1] in (".", ")")) and _BULLET.match(line):
        return "bullet"
    if (":" in line or "=" in line) and len(words) <= 16 and _FIELD.match(line) and not _SENTENCE.search(line.rstrip()[:-1] + " "):
        return "field"
    return "plain"


def units(text: str) -> tuple[list[tuple[str, int, list[str], int, bool]], list[str]]:
    """(shape, visible characters, words in lower case, block, whether it holds the end of a sentence) of each unit but greeting and
    closing; blank lines part blocks. The second list holds the words of greeting and closing."""
    lines = text.splitlines()
    if ">" in text:
        lines = [_QUOTE.sub("", x) for x in lines]
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    aside: list[str] = []
    if len(full) > 1 and len(lines[full[0]]) < 80 and _GREETING.match(lines[full[0]]):
        aside += _WORD.findall(lines[full[0]].lower())
        lines[full[0]] = ""
    for back in (1, 2, 3):
        if len(full) > back and len(lines[full[-back]]) < 60 and _CLOSING.match(lines[full[-back]]) and all(len(lines[i].strip()) <= 40 for i in full[-back:]):
            for i in full[-back:]:
                aside += _WORD.findall(lines[i].lower())
                lines[i] = ""
            break
    out, block = [], 0
    for line in lines:
        if not line or line.isspace():
            block += 1
            continue
        if len(line) < 240:
            words = _WORD.findall(line.lower())
            visible = len(line) - line.count(" ") - line.count("\t")
            out.append((_shape(line, words, visible), visible, words, block, line.rstrip()[-1] in ".?!"))
            continue
        parts = line.split(" ")
        for k in range(0, len(parts), UNIT_WORDS):
            piece = " ".join(parts[k : k + UNIT_WORDS])
            words = _WORD.findall(piece.lower())
            visible = len(piece) - piece.count(" ") - piece.count("\t")
            if visible:
                shape = _shape(piece, words, visible)
                out.append(("plain" if k and shape in ("bullet", "field") else shape, visible, words, block, ". " in piece or "? " in piece or piece.rstrip()[-1:] in (".", "?", "!")))
    return out, aside


#: Places of a plain unit by its rate of clausal words (steps of 0.02), and by its share of frequent words.
CLAUSE_STEPS = 7
KNOWN_STEPS = (0.1, 0.2, 0.35, 0.8, 0.93)

#: The statistics, in order; all but the first, as length is no evidence, are what the trees see. The first five are those asked for; the rest serve the classifier.
NAMES = (
    ["n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share"]
    + [f"share_{s}" for s in SHAPES]
    + [f"clause_{k}" for k in range(CLAUSE_STEPS)]
    + [f"known_{k}" for k in range(len(KNOWN_STEPS) + 1)]
    + ["repeated", "comma_rate", "sentence_rate", "digit_ratio", "upper_ratio", "long_word_share", "short_line_share", "unit_words", "any_common", "vowel_ratio"]
)


def _plain(text: str) -> str:
    """The text without tags and invisible characters, compatibility forms unified."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _TAG.sub(" ", text) if "<" in text else text


def statistics(text: str | None, lang: str | None = None) -> list[float] | None:
    """The values of NAMES for a text; None for null."""
    if text is None:
        return None
    text = _plain(text)
    stripped = [x.strip() for x in text.splitlines()]
    stripped = [x for x in stripped if x]
    visible = sum(len(x) for x in stripped) - sum(x.count(" ") + x.count("\t") for x in stripped)
    if not visible:
        return [0.0] * len(NAMES)
    low = text.lower()
    parts, counted = units(text)
    for _, _, ws, _, _ in parts:
        counted += ws
    n = len(counted)
    letters = sum(map(len, counted))
    counts = Counter(counted)
    best = _COMMON.get((lang or "")[:2].lower())
    in_lang = max(sum(map(counts.__getitem__, counts.keys() & s)) for s in ([best] if best else _COMMON.values()))
    total = sum(p[1] for p in parts) or 1
    share = dict.fromkeys(SHAPES, 0)
    clause, known, repeated = [0] * CLAUSE_STEPS, [0] * (len(KNOWN_STEPS) + 1), 0
    clausal = [sum(map(_CLAUSAL.__contains__, ws)) for _, _, ws, _, _ in parts]
    for i, (shape, v, ws, block, _) in enumerate(parts):
        share[shape] += v
        if shape != "plain":
            continue
        # a wrapped sentence is placed with the plain lines beside it
        size = own = len(ws)
        hits = clausal[i]
        rate = hits / size if size > 6 else 0.0
        if rate < 0.12:
            for j in (i - 1, i + 1):
                if 0 <= j < len(parts) and parts[j][0] == "plain" and parts[j][3] == block:
                    size += len(parts[j][2])
                    hits += clausal[j]
            rate = max(rate, hits / (size or 1))
        clause[min(CLAUSE_STEPS - 1, int(rate * 50))] += v
        if own > 4:
            known[bisect_right(KNOWN_STEPS, sum(map(_KNOWN.__contains__, ws)) / own)] += v
            if own > 7 and len(set(ws)) < 0.5 * own:
                repeated += v
    return [
        float(n),
        letters / n if n else 0.0,
        (visible - letters) / visible,
        sum(x[-1] in _STOPS or x[-1] in _CLOSERS and x.rstrip(_CLOSERS)[-1:] in _STOP_SET for x in stripped) / len(stripped),
        in_lang / n if n else 0.0,
        *(share[s] / total for s in SHAPES),
        *(x / total for x in clause),
        *(x / total for x in known),
        repeated / total,
        text.count(",") / (n or 1),
        sum(map(text.count, (". ", "! ", "? ", ".\n", "!\n", "?\n", "… "))) / (n or 1),
        sum(map(text.count, "0123456789")) / visible,
        len(_UPPER.findall(text)) / visible,
        sum(counts[w] for w in counts if len(w) > 14) / (n or 1),
        sum(len(x) < 40 for x in stripped) / len(stripped),
        math.log1p(n / len(parts)) if parts else 0.0,
        sum(map(counts.__getitem__, counts.keys() & _ANY_COMMON)) / (n or 1),
        sum(map(low.count, "aeiouäöüáéíóúàèêô")) / (letters or 1),
    ]


# --- weak labels --------------------------------------------------------------------------------------------------------

#: Least share of a text's characters that must be of one kind for a weak label.
PURE = 0.95
#: A block of more words is looked at in stretches of about so many.
BLOCK_WORDS = 40


def weak_label(text: str | None) -> tuple[float | None, int]:
    """(1 for junk, 0 for prose, None for neither or both; visible characters). Plain lines are looked at by blocks: a block reads if
    it has clausal words and others beside them, is a list if its lines are short and have none, and is a meaningless string if
    nearly all its words are unknown, or none of them means anything by itself, or they are always the same."""
    parts, _ = units(_plain(text or ""))
    total = sum(p[1] for p in parts)
    junk = reads = 0
    blocks: list[list] = []
    before, held = None, 0
    for p in parts:
        if p[0] != "plain":
            junk += p[1]
            continue
        if p[3] != before or held > BLOCK_WORDS:
            blocks.append([])
            before, held = p[3], 0
        blocks[-1].append(p)
        held += len(p[2])
    for lines in blocks:
        ws = [w for p in lines for w in p[2]]
        size, n = sum(p[1] for p in lines), len(ws) or 1
        hits, known, varied = sum(map(_CLAUSAL.__contains__, ws)) / n, sum(map(_KNOWN.__contains__, ws)) / n, len(set(ws)) / n
        if n > 7 and (known < 0.08 or known > 0.93 or varied < 0.3) or hits == 0 and n / len(lines) <= 6:
            junk += size
        elif n > 5 and hits > 0.09 and 0.25 < known < 0.85 and varied > 0.35:
            reads += size
    if not total:
        return None, 0
    return (1.0 if junk >= PURE * total else 0.0 if reads >= PURE * total else None), total


#: How many times as much junk as prose the texts put together shall hold, in turn.
MIXTURES = (0.2, 0.45, 0.7, 1.45, 2.2, 5.0)


def examples(texts: list[str]) -> list[tuple[list[float], float]]:
    """(statistics, label) of the pure ones among texts, and of texts put together from a pure one of each kind, labelled by which has
    more characters. Each text of prose meets the junk whose size comes nearest to the next of MIXTURES."""
    kinds: dict[float, list[tuple[int, str]]] = {0.0: [], 1.0: []}
    for t in texts:
        label, size = weak_label(t)
        if label is not None:
            kinds[label].append((size, t))
    out = [(statistics(t), label) for label, of in kinds.items() for _, t in of]
    junk = sorted(kinds[1.0])
    sizes = [size for size, _ in junk]
    for k, (size, t) in enumerate(sorted(kinds[0.0]) if junk else []):
        at = bisect_right(sizes, MIXTURES[k % len(MIXTURES)] * size)
        more, other = junk[min(len(junk) - 1, max(0, at - k % 2))]
        if not 0.87 < more / size < 1.15:  # too near for the label to be sure
            whole = f"{t}\n\n{other}" if k // len(MIXTURES) % 2 else f"{other}\n\n{t}"
            out.append((statistics(whole), float(more > size)))
    return out


# --- gradient-boosted trees ---------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees for log loss over binned features, and a logistic calibration of their sum."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 8.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.a, self.b = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """y are labels of 0 and 1; with one kind alone nothing is learnt, and all probabilities are alike."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        z = self._binned(x)
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        self.forest: list[list[tuple]] = []
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            tree = self._tree(z, y - q, q * (1 - q))
            self.forest.append(tree)
            score += self._walk(tree, z)
        return self

    def _tree(self, z: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes as (feature, bin, left, right) or (None, value); the rows of a node go left if their bin is at most its bin."""
        nodes: list[tuple] = [()]
        todo = [(0, np.arange(len(g)), 0)]
        width = self.bins + 1
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best, where = 1e-6, None
            if depth < self.depth and len(rows) > 1:
                # sums below each bin of all features at once: a feature's bins are a stretch of width cells
                cells = (z[rows] + np.arange(z.shape[1]) * width).ravel()
                below = lambda v, cells=cells: np.cumsum(np.bincount(cells, v, z.shape[1] * width).reshape(-1, width), axis=1)[:, :-1]
                gl, hl, n = below(np.repeat(g[rows], z.shape[1])), below(np.repeat(h[rows], z.shape[1])), below(None)
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                at_most = int(np.argmax(gain))
                if gain.flat[at_most] > best:
                    where = divmod(at_most, width - 1)
            if where is None:
                nodes[at] = (None, self.rate * gs / (hs + 1))
                continue
            left = z[rows, where[0]] <= where[1]
            nodes[at] = (*where, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
            nodes += [(), ()]
        return nodes

    @staticmethod
    def _walk(tree: list[tuple], z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(z))
        todo = [(0, np.arange(len(z)))]
        while todo:
            at, rows = todo.pop()
            node = tree[at]
            if node[0] is None:
                out[rows] = node[1]
                continue
            left = z[rows, node[0]] <= node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = self._binned(x)
        return self.base + sum((self._walk(t, z) for t in self.forest), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Fits probability = logistic(a * margin + b) on held-out rows by Newton steps, drawn lightly towards a = 1, b = 0."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((y - p) * m).sum() - (a - 1), (y - p).sum() - b])
            hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
            da, db = np.linalg.solve(hess, grad)
            a, b = max(0.05, a + float(np.clip(da, -0.5, 0.5))), b + float(np.clip(db, -0.5, 0.5))
            if abs(da) + abs(db) < 1e-8:
                break
        self.a, self.b = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))
