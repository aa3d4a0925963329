"""Per-document text statistics, and the structural form of a text by its distance from language profiles."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut

# ---------------------------------------------------------------- basic counts


def text_counts(df: DataFrame, text: str, keep: list[str], common_words: list[str]) -> DataFrame:
    """Basic statistics of each text, all from built-in functions, without a shuffle.

    ``n_chars``; ``n_words`` (runs of letters), ``mean_word_length``, ``common_share`` (words among ``common_words``); ``symbol_ratio`` (characters that are neither letters, digits
    nor white space); ``n_lines`` (not blank) and ``punctuated_share`` (lines that end in punctuation of a sentence).

    Defined cases: a null text has null counts; ratios of a text without words, characters or lines are null; other columns are ignored.
    """
    t = df[text].cast("string")
    src = df.select(*[df[k] for k in keep], t.alias("_text"))
    words = F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{M}]+"), 0)
    lines = F.filter(F.split("_text", r"\r\n|\r|\n", -1), lambda x: F.btrim(x, F.lit(" \t")) != "")
    src = src.select(*keep, "_text", words.alias("_words"), lines.alias("_lines"))
    known = F.filter("_words", lambda w: w.isin(common_words)) if common_words else F.array()
    ends = F.filter("_lines", lambda x: x.rlike(r"[.!?…。！？][\"')\]»”’]*[ \t]*$"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    n_chars, n_words, n_lines = F.char_length("_text"), F.size("_words"), F.size("_lines")
    symbols = F.char_length(F.regexp_replace("_text", r"[\p{L}\p{M}\p{N}\s]+", ""))
    return src.select(
        *keep,
        n_chars.alias("n_chars"),
        F.when(F.col("_text").isNotNull(), n_words).alias("n_words"),
        share(F.char_length(F.array_join("_words", "")), n_words).alias("mean_word_length"),
        share(F.size(known), n_words).alias("common_share"),
        share(symbols, n_chars).alias("symbol_ratio"),
        F.when(F.col("_text").isNotNull(), n_lines).alias("n_lines"),
        share(F.size(ends), n_lines).alias("punctuated_share"),
    )


# ---------------------------------------------------------------- tokens of a line by class

#: Classes: function word, known word, unknown word, unreadable run, number, cell divider, item mark, sentence punctuation, symbol, short line, said before in the text.
CLASSES = "FKXUNDBPSLR"

# Expected mixtures of classes (in hundredths) of lines that aren't prose, several for each form.
STRUCTURES = {
    "list": (
        {"B": 30, "K": 30, "X": 20, "F": 6, "N": 6, "P": 8},
        {"B": 20, "L": 20, "K": 30, "X": 16, "F": 6, "N": 4, "P": 4},
        {"L": 34, "K": 32, "X": 26, "F": 4, "N": 4},
    ),
    "table": (
        {"D": 44, "N": 30, "K": 14, "X": 10, "F": 2},
        {"D": 40, "K": 30, "X": 30},
        {"D": 90, "S": 10},
    ),
    "junk": (
        {"S": 90, "U": 10},
        {"U": 84, "S": 8, "N": 8},
        {"X": 88, "P": 8, "F": 4},
        {"S": 56, "X": 14, "U": 16, "F": 6, "N": 8},
        {"N": 96, "X": 4},
        {"R": 84, "K": 8, "X": 4, "F": 4},
    ),
}
#: Prose of a language of which nothing was learnt.
PLAIN_PROSE = {"F": 34, "K": 52, "X": 2, "N": 3, "P": 9}

# Spellings of an empty cell, and the tags that divide cells.
EMPTY_CELLS = {"n/a", "na", "-", "--", "–", "—", "ok"}
_TOKEN = re.compile(
    r"(?P<cell></?(?:td|th|tr|table|tbody|thead)\b[^<>]*>)|(?P<item></?(?:li|ul|ol)\b[^<>]*>)|(?P<tag></?[a-zA-Z][^<>\s]*>)"
    r"|(?P<broken>(?:[ÂÃÅÎÏÐÑâãð][\u0080-¿]+)+|[�\u0000-\u0008\u0080-\u009f]+)"
    r"|(?P<na>\bn/a\b)"
    r"|(?P<kana>[぀-ヿ㐀-鿿\uf900-﫿々]+)"
    r"|(?P<word>[^\W_぀-ヿ㐀-鿿\uf900-﫿々]+(?:['’\-][^\W\d_぀-ヿ㐀-鿿]+)*)"
    r"|(?P<end>[.!?…。！？,、:;：；\"'’“”«»„()（）「」¿¡]+)"
    r"|(?P<sign>[^\w\s]|_)",
    re.I,
)
_MARK = re.compile(
    r"\s*(?:\[[ xX✓✗]?\]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]\s+|\d{1,3}\s?[x×]\s+|[-+*•·∙◦○●▪■□☐☑☒✓✔✗✘►▶→»›–—~#o]\s+|[•·∙◦▪■□☐☑☒✓✔✗✘►▶][^\S\n]*(?=\w)|[☀-➿\U0001f300-\U0001faff][️\U0001f3fb-\U0001f3ff]*\s+)(?=\S)"
)
_RULE = re.compile(r"\s*[|+][-=+|: ]{2,}\s*$|\s*[-=_]{3,}(?:\s+[-=_]{3,})*\s*$")
_NUMBER = re.compile(r"\d[\d.,:]*")
_DIVIDERS = (re.compile(r"\|"), re.compile(r"\t"), re.compile(r";"), re.compile(r",(?=\S)"), re.compile(r"(?<=\S) / (?=\S)"), re.compile(r"(?<=\S) {2,}(?=\S)"))
_SENTENCE = re.compile(r"[.!?…。！？]")
_ENDS = re.compile(r"[.!?…。！？][\"')»”’]*\s*$")
_LINES = re.compile(r"[\r\n  ]+")


#: Words that a mark at the beginning of a line, or a divider of cells, weighs as much as.
MARK, DIVIDER = 2.0, 1.5
#: Words of a short line at most, and the evidence of a list in the shortest.
SHORT, LISTED = 5, 5.0


#: Pieces of text that are kept with their classes; texts are judged together up to so many characters.
REMEMBERED, TOGETHER = 50_000, 2_000_000


@lru_cache(REMEMBERED)
def script(letter: str) -> str:
    """The script of a letter, as Unicode's name of the letter begins; one for all of Japanese."""
    name = unicodedata.name(letter, "").partition(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else name


@dataclass
class Language:
    """What is known of a language: its function words, its words in prose, and the classes of its prose."""

    function: frozenset = frozenset()
    words: frozenset = frozenset()
    prose: dict = field(default_factory=lambda: dict(PLAIN_PROSE))
    #: Where given, words of other scripts than these count as known, by their length where they are endless.
    scripts: frozenset | None = None
    pieces: dict = field(default_factory=dict, repr=False, compare=False)

    def word(self, token: str) -> tuple[str, float]:
        """The class and weight of a run of letters and digits."""
        low = token.lower()
        if _NUMBER.fullmatch(token):
            return "N", max(1.0, len(token) / 4)
        if low in self.function:
            return "F", 1.0
        if low in self.words:
            return "K", 1.0
        if self.scripts is not None and script(token[0]) not in self.scripts:
            return "U" if _shape(token[:28]) else "K", max(1.0, len(token) / 6)
        return ("U", max(1.0, len(token) / 6)) if _shape(token) else ("X", 1.0)


def _may_divide(line: str) -> bool:
    """Whether a line has anything of which dividers of cells are made; nearly no prose has."""
    return "|" in line or "\t" in line or ";" in line or "  " in line or " / " in line or "," in line and line.count(",") != line.count(", ")


def _divider(line: str) -> tuple[int, int]:
    """How many dividers of cells a line has (0 if fewer than two of a kind divide it, or it reads on), and which kind."""
    if not _may_divide(line):
        return 0, -1
    for k, divider in enumerate(_DIVIDERS):
        n = len(divider.findall(line))
        if n < 2 - (k in (1,)):
            continue
        if k == 5 and not re.search(r"\S {3,}\S", line):
            continue
        cells = [c.strip() for c in divider.split(line) if c.strip()]
        if cells and np.mean([len(c.split()) for c in cells]) <= 3:
            return n, k
    return 0, -1


def _shape(word: str) -> bool:
    """Whether a run of letters and digits can't be read as a word: letters and digits mixed, capitals inside, or endless."""
    if len(word) > 28:
        return True
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return False
    if len(letters) < len(word.replace("-", "").replace("'", "").replace("’", "")):
        return len(word) > 3
    inner = word[1:]
    return len(word) > 3 and not word.isupper() and sum(c.isupper() for c in inner) * 4 > len(word)


def _tokens(text: str, language: Language, out: dict[str, float], divided: bool) -> float:
    """Add the weights of the classes of a text's tokens to ``out``; gives its words. ``divided``: the text has cells."""
    words = 0.0
    for m in _TOKEN.finditer(text):
        token, what = m[0], m.lastgroup
        if what == "word":
            kind, weight = language.word(token)
            if divided and kind == "X" and token.lower() in EMPTY_CELLS:
                kind = "N"
            out[kind] += weight
            words += kind in "FKX"
        elif what == "kana":
            particles = sum(c in language.function for c in token)
            out["F"] += particles / 2
            out["K"] += (len(token) - particles) / 2
            words += len(token) / 3
        elif what == "end":
            out["P"] += 1
            out["S"] += max(0, len(token) - 3) / 2
        elif what == "cell":
            out["D"] += 1
        elif what == "item":
            out["B"] += 1
        elif what == "na" or (divided and token in EMPTY_CELLS):
            out["N"] += 1
        elif what == "broken":
            out["U"] += max(1.0, len(token) / 3)
        else:
            out["S"] += 0.75
    return words


def line_classes(line: str, language: Language) -> dict[str, float]:
    """Weights of the classes of the tokens of a line. Runs that aren't words count by their length."""
    out: dict[str, float] = dict.fromkeys(CLASSES, 0.0)
    if _RULE.match(line):
        out["D"] = 4.0
        return out
    mark = _MARK.match(line)
    if mark:
        out["B"] += MARK
        line = line[mark.end() :]
    n, kind = _divider(line)
    if n:
        out["D"] += n * DIVIDER
        line = _DIVIDERS[kind].sub(" " if kind != 3 else "  ", line)
    words = 0.0
    if n or "<" in line:
        words += _tokens(line, language, out, n > 0)
    else:
        # No token but a tag holds white space, so pieces between white space are counted for themselves, and most have been before.
        for piece in line.split():
            own = language.pieces.get(piece)
            if own is None:
                counts = dict.fromkeys(CLASSES, 0.0)
                own = _tokens(piece, language, counts, False), [x for x in counts.items() if x[1]]
                if len(piece) <= 32:
                    if len(language.pieces) >= REMEMBERED:
                        language.pieces.clear()
                    language.pieces[piece] = own
            words += own[0]
            for kind, weight in own[1]:
                out[kind] += weight
    if 0 < words <= SHORT and not out["D"] and out["P"] <= 1 and not _ENDS.search(line):
        # Only counts where several such lines follow one another.
        out["L"] = LISTED * (1 - words / (SHORT + 1)) + 0.5 * out["X"]
    return out


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (in bits) of each row of ``p`` from each row of ``q``."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        right = np.where(b > 0, b * np.log2(b / m), 0).sum(-1)
    return (left + right) / 2


def _vector(weights: dict[str, float]) -> np.ndarray:
    v = np.array([weights.get(c, 0.0) for c in CLASSES], float)
    return v / v.sum() if v.sum() else v


def _words(text: str) -> list[str]:
    """Words, and for scripts without spaces between words their characters."""
    return re.findall(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+", text.lower())


def _clean(text: str) -> str:
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return html.unescape(text) if "&" in text else text


def repeated_share(words: list[str]) -> float:
    """The share of runs of three words that occurred before in the text."""
    runs = list(zip(words, words[1:], words[2:]))
    return 1 - len(set(runs)) / len(runs) if runs else 0.0


#: Of texts in words, and of texts mostly in characters: tokens of a run, tokens back that are near, and tokens from which a text can say the same over and over.
OVER = {False: (3, 300, 8), True: (9, 900, 10)}
#: Share of the tokens from which on they are said again: four rounds of the same.
OVER_SHARE = 0.75


def fresh_runs(words: list[str], run: int, near: int) -> int:
    """How many runs of words weren't said before: neither among the last ``near`` runs nor, for rounds longer than that, the same number of runs before as most."""
    runs = list(zip(*(words[i:] for i in range(run))))
    last: dict = {}
    far: Counter = Counter()
    said = [False] * len(runs)
    for i, r in enumerate(runs):
        back = i - last.get(r, i)
        if back > near:
            far[back] += 1
        else:
            said[i] = back > 0
        last[r] = i
    if far:
        round_ = far.most_common(1)[0][0]
        for i in range(round_, len(runs)):
            said[i] = said[i] or runs[i] == runs[i - round_]
    return len(runs) - sum(said)


def _is_character(word: str) -> bool:
    return len(word) == 1 and ("\u3040" <= word <= "\u30ff" or "\u3400" <= word <= "\u9fff")


def _may_say_again(n: np.ndarray, distinct: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """Where :func:`said_again` has to look: a word begins a fresh run where it first occurs, but for the last few."""
    run = np.where(characters * 2 > n, OVER[True][0], OVER[False][0])
    return (n >= OVER[False][2]) & (distinct - run + 1 <= (1 - OVER_SHARE) * n)


def said_again(words: list[str]) -> float:
    """The share of a text that is said again if it says the same over and over, in four rounds or more, else 0. Only what is near, or comes in rounds, counts, so that
    prose of any length, which says many a thing again, doesn't."""
    n, characters = len(words), sum(map(_is_character, words))
    if not _may_say_again(n, len(set(words)), characters):
        return 0.0
    run, near, least = OVER[characters * 2 > n]
    fresh = fresh_runs(words, min(run, n // 3), near)
    return 1 - fresh / n if n >= least and fresh <= (1 - OVER_SHARE) * n else 0.0


class _Numbers(dict):
    """Numbers of things, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _more(table: np.ndarray, n: int) -> np.ndarray:
    """A table with room for n rows."""
    if len(table) >= n:
        return table
    out = np.zeros((max(n, 2 * len(table)), *table.shape[1:]), table.dtype)
    out[: len(table)] = table
    return out


class Pieces:
    """Numbers of the pieces of texts between white space, and what is known of each: its words, the languages that these speak for, and by language the weights of its tokens.

    No token but a tag holds white space, so pieces are looked at for themselves, each once however often it occurs; what lines and texts are made of are sums over pieces.
    """

    def __init__(self, languages: dict[str, Language]) -> None:
        self.languages, self.names = languages, sorted(languages)
        self.speaks: dict[str, list[tuple[int, int]]] = {}  # a word: twice for a language as a function word, once as a known word
        for i, name in enumerate(self.names):
            own = languages[name]
            for w in own.function | own.words:
                self.speaks.setdefault(w, []).append((i, 2 * (w in own.function) + (w in own.words)))
        self.scripts = frozenset({"CJK", *(script(w[0]) for x in languages.values() for w in x.function if w)})
        self.forget()

    def forget(self) -> None:
        self.numbers, self.words = _Numbers(), _Numbers()
        self.pieces: list[str] = []
        self.word_list: list[str] = []
        self.first, self.of_piece, self.n_of = np.zeros(1025, np.int64), np.zeros(1024, np.int64), 0
        self.votes, self.function = np.zeros((1024, len(self.names))), np.zeros((1024, len(self.names)), bool)
        self.strange, self.character = np.zeros(1024, bool), np.zeros(1024, bool)
        self.known: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def number(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces. Earlier numbers are void if too many are known by then."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        old = len(self.numbers)
        out = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        new = list(islice(self.numbers, old, None))
        self.pieces += new
        found = list(map(_words, new))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + self.n_of
        self.first = _more(self.first, old + len(new) + 1)
        self.first[old + 1 : old + len(new) + 1] = ends
        flat = list(chain.from_iterable(found))
        self.of_piece = _more(self.of_piece, self.n_of + len(flat))
        was = len(self.words)
        self.of_piece[self.n_of : self.n_of + len(flat)] = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        self.n_of += len(flat)
        fresh = list(islice(self.words, was, None))
        self.word_list += fresh
        self.votes, self.function, self.strange, self.character = (_more(t, was + len(fresh)) for t in (self.votes, self.function, self.strange, self.character))
        for k, w in enumerate(fresh, was):
            for i, n in self.speaks.get(w, ()):
                self.votes[k, i] = n
                self.function[k, i] = n > 1
            self.strange[k] = script(w[0]) not in self.scripts
            self.character[k] = _is_character(w)
        return out

    def words_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of pieces one after the other, by number, and how many each piece has."""
        begin, end = self.first[numbers], self.first[numbers + 1]
        n = end - begin
        return self.of_piece[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def best(self, words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """The language with the most voices among the words of each group; -1 where there is none."""
        votes = self.totals(self.votes, words, group, groups)
        if not len(self.names):
            return np.full(groups, -1)
        top = len(self.names) - 1 - votes[:, ::-1].argmax(1)
        return np.where(votes.max(1) > 0, top, -1)

    def totals(self, table: np.ndarray, words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        return np.array([np.bincount(group, table[words, i], groups) for i in range(len(self.names))]).T.reshape(groups, len(self.names))

    def weights(self, numbers: np.ndarray, name: str | None, language: Language) -> np.ndarray:
        """The weights of the classes of each piece in a language, and last its words."""
        table, done = self.known.get(name, (np.zeros((1024, len(CLASSES) + 1)), np.zeros(1024, bool)))
        table, done = _more(table, len(self.numbers)), _more(done, len(self.numbers))
        self.known[name] = table, done
        for k in np.unique(numbers[~done[numbers]]).tolist():
            counts = dict.fromkeys(CLASSES, 0.0)
            words = _tokens(self.pieces[k], language, counts, False)
            table[k] = [*counts.values(), words]
        done[numbers] = True
        return table[numbers]


def _distinct(words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How many different words each group has."""
    if not len(words):
        return np.zeros(groups, np.int64)
    pairs = np.sort(group * (int(words.max()) + 1) + words)
    fresh = np.append(True, pairs[1:] != pairs[:-1])
    return np.bincount(pairs[fresh] // (int(words.max()) + 1), minlength=groups)


def _plain(line: str) -> bool:
    """Whether a line is the sum of its pieces: without tags, dividers of cells and marks."""
    return not (_may_divide(line) or "<" in line or _MARK.match(line) or _RULE.match(line))


#: Tokens' worth of prose that is added to a line, so that a word or two decide nothing.
PRIOR = 3.0
#: The name of what is written in a script of no known language.
FOREIGN = "\0foreign"
#: Words of a line that is too long for an item of a list.
LONG_LINE = 10


class Judge:
    """Tells the form of texts by the profiles of languages and of other structures."""

    def __init__(self, languages: dict[str, Language]) -> None:
        self.languages, self.pieces = languages, Pieces(languages)
        self.any = Language(frozenset(), frozenset().union(*(x.words for x in languages.values())))
        self.foreign = Language(frozenset(), self.any.words, scripts=self.pieces.scripts)
        self.all = {**languages, None: self.any, FOREIGN: self.foreign}
        self.forms = ["prose", *(f for f, profiles in STRUCTURES.items() for _ in profiles)]
        others = [_vector(p) for profiles in STRUCTURES.values() for p in profiles]
        self.profiles = {name: np.vstack([_vector(x.prose), *others]) for name, x in self.all.items()}

    def is_foreign(self, words: list[str]) -> bool:
        """Whether more than half of the words are in one script that no known language has."""
        found = Counter([x for x in map(script, [w[0] for w in words]) if x not in self.pieces.scripts])
        return bool(found) and max(found.values()) * 2 > len(words)

    def __call__(self, text: str | None) -> tuple[str, int, int, float, float]:
        """The form of a text: ``prose``, ``list``, ``table``, ``junk`` or ``blank``; lines, lines that aren't prose, and the mean divergence of its
        lines from prose and from the nearest other structure."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[str, int, int, float, float]]:
        """The forms of texts, a few million characters at a time."""
        out: list = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= TOGETHER):
                size += len(texts[end] or "")
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _away(self, weights: np.ndarray, name: str | None) -> np.ndarray:
        """The divergence of each line from each profile."""
        seen = weights + PRIOR * self.profiles[name][0]
        seen /= seen.sum(1, keepdims=True)
        return np.concatenate([_divergence(seen[k : k + 20_000], self.profiles[name]) for k in range(0, len(seen), 20_000)])

    def _some(self, texts: list[str | None]) -> list[tuple[str, int, int, float, float]]:
        out: list = [("blank", 0, 0, 0.0, 0.0)] * len(texts)
        lines: list[str] = []
        read, sizes = [], []
        for i, text in enumerate(texts):
            own = [x for x in _LINES.split(_clean(text)) if x.strip()] if text else []
            if own:
                lines += own
                read.append(i)
                sizes.append(len(own))
        if not read:
            return out
        n_texts, n_lines = len(read), np.array(sizes)
        text_of = np.repeat(np.arange(n_texts), n_lines)
        begin = np.cumsum(n_lines) - n_lines
        split = list(map(str.split, lines))
        in_line = np.fromiter(map(len, split), np.int64, len(split))
        numbers = self.pieces.number(list(chain.from_iterable(split)))
        line_of = np.repeat(np.arange(len(lines)), in_line)
        words, in_piece = self.pieces.words_of(numbers)
        word_text = np.repeat(text_of[line_of], in_piece)
        n_words = np.bincount(word_text, minlength=n_texts)
        word_at = np.cumsum(n_words) - n_words

        def words_of(t: int) -> list[str]:
            return [self.pieces.word_list[w] for w in words[word_at[t] : word_at[t] + n_words[t]].tolist()]

        names = [*self.pieces.names, None]
        language = [names[k] for k in self.pieces.best(words, word_text, n_texts).tolist()]
        strange = np.bincount(word_text, self.pieces.strange[words], n_texts) * 2 > n_words
        for t in np.flatnonzero(strange).tolist():
            if self.is_foreign(words_of(t)):
                language[t] = FOREIGN
        weights = self._weigh(lines, text_of, language, numbers, line_of)

        away = np.zeros((len(lines), len(self.forms)))
        of_line = np.array([list(self.all).index(n) for n in language])[text_of]
        for k, name in enumerate(self.all):
            if (some := np.flatnonzero(of_line == k)).size:
                away[some] = self._away(weights[some], name)
        kinds = ["prose", "table", "list", "junk"]  # of as many lines, a table goes before a list, and that before junk
        nearest = np.array([kinds.index(f) for f in self.forms])[away.argmin(1)]
        counts = np.bincount(text_of * 4 + nearest, minlength=4 * n_texts).reshape(-1, 4)
        off = counts[:, 1:].sum(1)
        form = np.where(off * 2 > n_lines, counts[:, 1:].argmax(1) + 1, 0)
        far, near = np.add.reduceat(away[:, 0], begin) / n_lines, np.add.reduceat(away[:, 1:].min(1), begin) / n_lines

        for t in np.flatnonzero(((form == 0) | (form == 2)) & _may_say_again(n_words, _distinct(words, word_text, n_texts), np.bincount(word_text, self.pieces.character[words], n_texts))).tolist():
            again = said_again(words_of(t))
            if not again:
                continue
            own = slice(begin[t], begin[t] + n_lines[t])
            marked = (weights[own, CLASSES.index("B")] > 0).sum() * 2 > n_lines[t]
            if form[t] == 2 and (marked or max(len(_words(x)) for x in lines[own]) < LONG_LINE):
                continue
            # What is said again is a class of its own, in all lines alike.
            told = weights[own] * (1 - again)
            told[:, CLASSES.index("R")] = again * weights[own].sum(1)
            away_again = self._away(told, language[t])
            nearest = [self.forms[k] for k in away_again.argmin(1).tolist()]
            if nearest.count("junk") * 2 > n_lines[t]:
                form[t], off[t], far[t], near[t] = 3, nearest.count("junk"), away_again[:, 0].mean(), away_again[:, 1:].min(1).mean()
        for t, row in enumerate(zip(form.tolist(), n_lines.tolist(), off.tolist(), far.tolist(), near.tolist())):
            out[read[t]] = (kinds[row[0]], *row[1:])
        return out

    def _weigh(self, lines: list[str], text_of: np.ndarray, language: list, numbers: np.ndarray, line_of: np.ndarray) -> np.ndarray:
        """Weights of the classes of each line. A run of short or marked lines is evidence of a list, a short line by itself isn't."""
        weights = np.zeros((len(lines), len(CLASSES) + 1))
        foreign = np.array([n == FOREIGN for n in language])
        plain = np.fromiter(map(_plain, lines), bool, len(lines)) & ~foreign[text_of]
        index = {name: k for k, name in enumerate(self.all)}
        of_line = np.array([index[n] for n in language])[text_of]
        in_plain = plain[line_of]
        of_piece = of_line[line_of]
        for name, k in index.items():
            some = np.flatnonzero(in_plain & (of_piece == k))
            if some.size:
                found = self.pieces.weights(numbers[some], name, self.all[name])
                starts = np.flatnonzero(np.append(True, line_of[some][1:] != line_of[some][:-1]))
                weights[line_of[some][starts]] = np.add.reduceat(found, starts)
        at = {c: i for i, c in enumerate(CLASSES)}
        words = weights[:, -1]
        for i in np.flatnonzero(plain & (words > 0) & (words <= SHORT) & (weights[:, at["P"]] <= 1)).tolist():
            if not _ENDS.search(lines[i]):
                weights[i, at["L"]] = LISTED * (1 - words[i] / (SHORT + 1)) + 0.5 * weights[i, at["X"]]
        for i in np.flatnonzero(~plain).tolist():
            name = language[text_of[i]]
            # Marks of letters are parts of words, but not in the pattern of tokens.
            line = "".join([c for c in lines[i] if unicodedata.category(c)[0] != "M"]) if name == FOREIGN else lines[i]
            weights[i, :-1] = list(line_classes(line, self.all[name]).values())
        short = (weights[:, at["L"]] > 0) | (weights[:, at["B"]] > 0)
        run = np.cumsum(np.append(True, (text_of[1:] != text_of[:-1]) | (short[1:] != short[:-1]))) - 1
        weights[np.bincount(run)[run] < 3, at["L"]] = 0.0
        return weights[:, :-1]


# ---------------------------------------------------------------- learning of the languages' prose

#: Share of a language's lines of prose in which a word must occur to be known, at least in FEWEST lines: in fewer, a text would vouch for its own words.
#: The share bounds the words known: no more than the mean words of a line / RARE.
RARE, FEWEST = 5e-5, 3
#: A line teaches if it has so many words, such a share of function words, and ends a sentence.
TEACH_WORDS, TEACH_SHARE = 6, 0.12


def _teach(batches: Iterator[pa.RecordBatch], function: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    """Counts over lines that are surely prose: (language, kind, item, weight)."""
    languages = {n: Language(frozenset(w)) for n, w in function.items()}
    pieces = Pieces(languages)
    found = {n: (Counter(), Counter()) for n in languages}  # words; lines and classes

    def flush() -> pa.RecordBatch:
        rows = [(n, kind, item, float(weight)) for n, (words, rest) in found.items() for kind, part in (("word", words), ("rest", rest)) for item, weight in part.items()]
        for words, rest in found.values():
            words.clear()
            rest.clear()
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["lang", "kind", "item", "weight"])

    def read(lines: list[str]) -> None:
        split = list(map(str.split, lines))
        in_line = np.fromiter(map(len, split), np.int64, len(split))
        numbers = pieces.number(list(chain.from_iterable(split)))
        line_of = np.repeat(np.arange(len(lines)), in_line)
        words, in_piece = pieces.words_of(numbers)
        word_line = np.repeat(line_of, in_piece)
        n_words = np.bincount(word_line, minlength=len(lines))
        best = pieces.best(words, word_line, len(lines))
        functions = pieces.totals(pieces.function, words, word_line, len(lines))[np.arange(len(lines)), best] if languages else n_words * 0
        good = (best >= 0) & (n_words >= TEACH_WORDS) & (functions >= TEACH_SHARE * n_words)
        again = _may_say_again(n_words, _distinct(words, word_line, len(lines)), np.bincount(word_line, pieces.character[words], len(lines)))
        at = np.cumsum(n_words) - n_words
        for i in np.flatnonzero(good).tolist():
            line = lines[i]
            good[i] = bool(_SENTENCE.search(line)) and not _MARK.match(line) and not _divider(line)[0]
            if good[i] and again[i]:
                good[i] = not said_again([pieces.word_list[w] for w in words[at[i] : at[i] + n_words[i]].tolist()])
        whole = good & np.fromiter(("<" not in x for x in lines), bool, len(lines))
        for k, name in enumerate(pieces.names):
            own = best == k
            known, rest = found[name]
            mine = (good & own)[word_line]
            if not mine.any():
                continue
            pairs = np.unique(word_line[mine] * len(pieces.word_list) + words[mine]) % len(pieces.word_list)
            which, n = np.unique(pairs, return_counts=True)
            known.update(dict(zip([pieces.word_list[w] for w in which.tolist()], n.tolist())))
            rest["lines"] += int((good & own).sum())
            sums = pieces.weights(numbers[(whole & own)[line_of]], name, languages[name]).sum(0)[:-1]
            for i in np.flatnonzero(good & own & ~whole).tolist():
                sums = sums + np.array(list(line_classes(lines[i], languages[name]).values()))
            for c, x in zip(CLASSES, sums.tolist()):
                if x and c != "L":
                    rest[c] += x

    for batch in batches:
        lines: list[str] = []
        size = 0
        for text in batch.column(0).to_pylist():
            for line in _LINES.split(_clean(text or "")):
                if line.strip():
                    lines.append(line)
                    size += len(line)
            if size > TOGETHER:
                read(lines)
                lines, size = [], 0
        if lines:
            read(lines)
        if sum(len(words) for words, _ in found.values()) > 200_000:
            yield flush()
    yield flush()


def learn_languages(df: DataFrame, text: str, function: dict[str, list[str]]) -> dict[str, Language]:
    """Prose profiles of languages, from all texts: which classes of tokens their prose has, and the words that occur in it.

    ``function`` has the function words of each language. Counts are made in the tasks that read the texts and summed by key; the driver gets all
    words that occur in the share RARE of the lines and in FEWEST of them; below FEWEST / RARE = 60,000 lines the latter asks for more.
    """
    src = df.select(df[text].cast("string").alias("_text")).where(F.col("_text").isNotNull())
    counts = src.mapInArrow(partial(_teach, function=function), "lang string, kind string, item string, weight double")
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("weight").alias("weight"))
    counts = cut(counts.where((F.col("kind") != "word") | (F.col("weight") >= FEWEST)))
    base = counts.where("kind = 'rest'").collect()
    lines = {r["lang"]: r["weight"] for r in base if r["item"] == "lines"}
    words: dict[str, list[str]] = {}
    least = F.lit(None).cast("double")
    for name, n in lines.items():
        least = F.when(F.col("lang") == name, max(FEWEST, RARE * n)).otherwise(least)
    for r in counts.where((F.col("kind") == "word") & (F.col("weight") >= least)).select("lang", "item").collect():
        words.setdefault(r["lang"], []).append(r["item"])
    out = {}
    for name, known in function.items():
        seen = {r["item"]: r["weight"] for r in base if r["lang"] == name and r["item"] != "lines"}
        if seen:
            # No words were known while counting, so all words but function words came out as unknown.
            seen["K"] = seen.get("K", 0.0) + 0.97 * seen.get("X", 0.0)
            seen["X"] = 0.03 * seen.get("X", 0.0)
        out[name] = Language(frozenset(known), frozenset(words.get(name, ())), seen or dict(PLAIN_PROSE))
    return out


def _judge_batches(batches: Iterator[pa.RecordBatch], languages: dict[str, Language], names: list[str]) -> Iterator[pa.RecordBatch]:
    judge = Judge(languages)
    for batch in batches:
        rows = judge.many(batch.column(batch.num_columns - 1).to_pylist())
        columns = list(zip(*rows)) or [[]] * 5
        own = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=names)


def text_forms(df: DataFrame, text: str, keep: list[str], function: dict[str, list[str]], languages: dict[str, Language] | None = None) -> DataFrame:
    """The structural form of each text: ``keep``, ``form``, ``n_lines``, ``n_other`` (lines that aren't prose), ``from_prose`` and ``from_structure``.

    The tokens of each line fall into classes (CLASSES). The line belongs to the profile whose distribution of classes is nearest by Jensen-Shannon divergence: the prose of
    the text's language, learnt from all texts (:func:`learn_languages`), or one of STRUCTURES. A text of which more than half of the lines that aren't blank are nearest to other
    structures has the most frequent of their forms, ``list``, ``table`` or ``junk``; all others are ``prose``. A text that says the same over and over (:func:`says_again`: four rounds, whatever
    its length) is ``junk``.

    A text in a script that no language of ``function`` has (Greek or Korean, where they aren't there) is judged by its shape alone: lists, tables, symbols, mixtures of letters
    and digits and repetition are seen, its words count as known. A language without function words in a script that another has (Polish beside English) can't be told from
    made-up words; its texts may come out as ``junk``, so its function words have to be given.

    Defined cases: null, empty and blank texts are ``blank``; texts are read whole, whatever their length; repeated rows are judged alike; other columns are ignored.
    """
    languages = learn_languages(df, text, function) if languages is None else languages
    src = df.select(*[df[k] for k in keep], df[text].cast("string").alias("_text"))
    own = [("form", T.StringType()), ("n_lines", T.IntegerType()), ("n_other", T.IntegerType()), ("from_prose", T.DoubleType()), ("from_structure", T.DoubleType())]
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(*x) for x in own)])
    return src.mapInArrow(partial(_judge_batches, languages=languages, names=[*keep, *(n for n, _ in own)]), schema)
