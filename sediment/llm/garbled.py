"""Texts decoded with the wrong encoding: found and restored span by span.

The garbled sequence of every character under every pair (UTF-8, wrong encoding), and of every frequent word under
every pair of single-byte encodings, is computed in advance and put into a multi-pattern automaton. One pass over a text finds all of
them; only matched spans are replaced, so correct text beside them stays as it is. A text garbled twice is taken
through again. Characters that are lost for good (U+FFFD) can't be restored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.runtime import cut, spread

#: Encodings that UTF-8 is often mistaken for; "web" is Windows-1252; Windows encodings have the C1 controls at their undefined bytes.
WRONG_FOR_UTF8 = ("web", "latin-1", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-15")
#: (true encoding, wrong encoding) of texts in one byte a character.
SINGLE_BYTE = tuple(
    (a, b)
    for a, wrong in (
        ("cp1251", ("web", "latin-1", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "iso8859-5", "mac_cyrillic")),
        ("koi8-u", ("web", "latin-1", "cp1251", "cp866", "mac_roman", "iso8859-5")),
        ("cp866", ("web", "latin-1", "cp1251", "koi8-r", "mac_roman", "cp437")),
        ("iso8859-5", ("web", "cp1251", "koi8-r", "cp866")),
        ("mac_cyrillic", ("web", "cp1251")),
        ("web", ("latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp852", "koi8-r")),
        ("cp1250", ("web", "latin-1", "cp437", "cp850", "cp852", "mac_roman", "cp1251")),
        ("iso8859-2", ("web", "cp1250")),
        ("cp437", ("web", "mac_roman", "cp1251")),
        ("cp850", ("web", "mac_roman", "cp1250", "cp1251")),
        ("cp852", ("web", "cp1250")),
        ("mac_roman", ("web", "cp437", "cp850", "cp1251")),
    )
    for b in wrong
)
#: Blocks whose characters get sequences: first and last code point.
BLOCKS = ((0x80, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2DD), (0x384, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x621, 0x652), (0x660, 0x669), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2000, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0x1F000, 0x1FAFF), (0x13000, 0x1302F), (0x1D400, 0x1D7FF))
#: Frequent words kept for the single-byte pairs, and the documents that must hold each.
WORDS, WORD_DOCS = 6_000, 3
#: A letter is ordinary if the frequent words that hold it stand in so many documents together.
CHAR_DOCS = 20
#: A word counts as garbled only if its restored form is so many times as frequent as it is itself, or of another script (`foreign`).
ODDS = 3
#: For words without a pattern: a restored form is taken if its letters are so many nats likelier in all than those that stand there, and so
#: many on average; where trigrams are counted in fewer than RARE of the texts, their number hardly matters.
LETTER_NATS, LETTER_MEAN, RARE = 8.0, 2.5, 1e-4
#: A letter that stands alone in at most this share of the texts that the commonest trigram has may be a garbled dash.
LONE = 0.01
#: Tokens that a worker keeps weighed.
KEEP = 200_000
#: A text can be garbled so many times over.
ROUNDS = 4
#: Punctuation and signs that ordinary texts hold (a fixed list).
SIGNS = set("“”‘’„‚–—…°±×µ§€£½¼¾²³≤≥≠«»‹›•→©®™№¿¡ ­")
#: A word with letters or apostrophes outside ASCII. It starts at a word's start and its parts are bounded, so that long runs
#: of letters take linear time; longer words aren't frequent ones.
_WORD = r"(?<![\p{L}\p{M}'’])[\p{L}\p{M}]{0,30}(?:['’]?[^\x00-\x7f\P{L}]|’\p{L})(?:[\p{L}\p{M}]|['’]\p{L}){0,30}"


def decode_byte(b: int, encoding: str) -> str | None:
    if encoding == "web":
        try:
            return bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(b)
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b) if encoding in ("cp1250", "cp1251") else None


_high: dict[str, tuple[dict[int, str], dict[str, int]]] = {}


def tables(encoding: str) -> tuple[dict[int, str], dict[str, int]]:
    """byte -> character and back, of the upper half."""
    if encoding not in _high:
        to = {b: c for b in range(128, 256) if (c := decode_byte(b, encoding)) is not None}
        _high[encoding] = to, {c: b for b, c in to.items()}
    return _high[encoding]


def swap(text: str, have: str, want: str) -> str | None:
    """text, whose characters are the bytes' under `have`, with the characters of those bytes under `want`; None if it can't be."""
    back, to = tables(have)[1], tables(want)[0]
    out = []
    for c in text:
        if ord(c) < 128:
            out.append(c)
        elif (b := back.get(c)) is None or (d := to.get(b)) is None:
            return None
        else:
            out.append(d)
    return "".join(out)


def utf8_patterns() -> dict[str, list[tuple[str, str]]]:
    """garbled sequence -> [(wrong encoding, character)]; without letters whose sequence is three Cyrillic letters, which right texts hold."""
    out: dict[str, list[tuple[str, str]]] = {}
    # signs of the wrong encodings themselves, which texts garbled twice hold
    twice = SIGNS | {c for x in ("web", "cp1251", "cp866", "koi8-r") for c in tables(x)[1] if not c.isalpha()}
    for x in WRONG_FOR_UTF8:
        to = tables(x)[0]
        for first, last in BLOCKS:
            for point in range(first, last + 1):
                seq = [to.get(b) for b in chr(point).encode()]
                if seq[-1] == "\xa0" and len(seq) == 2 and seq[0].isalpha():
                    # the fixed space of a garbled letter often ends as a plain one; before another space nothing else can stand there
                    out.setdefault(seq[0] + "  ", []).append((x, chr(point) + " "))
                if None not in seq and not (len(seq) > 2 and chr(point) not in twice and all("Ѐ" <= c <= "ӿ" for c in seq)):
                    out.setdefault("".join(seq), []).append((x, chr(point)))
    return out


def _scripts(word: str) -> set[str]:
    """Latin, Cyrillic and so on of a word's letters, by block."""
    return {"latin" if c < "\u0370" or "\u1e00" <= c <= "\u1eff" or "\u2071" <= c <= "\u209c" else "cyrillic" if "\u0400" <= c <= "\u052f" else "other" for c in word if c.isalpha()}


def foreign(form: str, word: str) -> bool:
    """Whether a form can't be right beside the word it decodes to, however frequent it is.

    It mixes scripts and the word doesn't, or a word of Cyrillic letters alone has become one of signs and letters outside ASCII.
    """
    f, w = _scripts(form), _scripts(word)
    return len(w) == 1 and (len(f) > 1 or (w == {"cyrillic"} and f <= {"latin"} and not any("a" <= c <= "z" for c in form.lower())))


def word_patterns(counts: dict[str, int]) -> dict[str, list[tuple[str, str, str]]]:
    """garbled word -> [(true encoding, wrong encoding, word)], for words of three letters or more.

    A form that is plain but for signs at its ends could be a right word in quotes and is left out.
    """
    out: dict[str, list[tuple[str, str, str]]] = {}
    for true, wrong in SINGLE_BYTE:
        for w, n in counts.items():
            if len(w) < 3:
                continue
            g = swap(w, true, wrong)
            if g is None or g == w or g.strip(_EDGES).isascii():
                continue
            held = max(counts.get(g, 0), counts.get(g.lower(), 0))
            if held and foreign(w, g):  # w itself is the garbled one
                continue
            if foreign(g, w) or n >= ODDS * held:
                out.setdefault(g, []).append((true, wrong, w))
    return out


class Restorer:
    def __init__(self, counts: dict[str, int], letters: dict[str, int] | None = None):
        """letters: trigrams around letters outside ASCII with their numbers of texts (`letter_counts`); without them only patterns are used."""
        self.counts, self.letters = counts, letters or {}
        self._weighed: dict[str, dict[int, float]] = {}
        self.floor = 0.5 + RARE * self.letters.get("", 0)
        held: Counter = Counter()
        for w, n in counts.items():
            held.update(dict.fromkeys(w, n))
        self.chars = {c for c, n in held.items() if n >= CHAR_DOCS} | {c.upper() for c, n in held.items() if n >= CHAR_DOCS} | SIGNS
        self.likely = self.chars | set(tables("web")[1]) | _LINES | {chr(i) for i in range(0x80, 0xA0)} | {c for x in WRONG_FOR_UTF8 for c in tables(x)[1] if not c.isalpha()}
        self.utf8 = self._automaton(utf8_patterns())
        self.words = self._automaton(word_patterns(counts))

    @staticmethod
    def _automaton(patterns: dict):
        a = ahocorasick.Automaton()
        for k, v in patterns.items():
            a.add_word(k, (k, v))
        if len(a):
            a.make_automaton()
        return a

    # -- UTF-8 read as something else -------------------------------------------------------------------------------

    def _spans(self, text: str) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The wrong encoding that explains most of the matches, and its spans (start, end, character), longest first at each place."""
        found: dict[str, dict[int, tuple[int, str]]] = {}
        for end, (seq, values) in self.utf8.iter(text):
            start = end - len(seq) + 1
            for x, c in values:
                if (c not in self.likely and seq.isalpha()) or (seq[-1] == " " and text[start - 1 : start].isalpha()):
                    continue
                mine = found.setdefault(x, {})
                if start not in mine or mine[start][0] < end + 1:
                    mine[start] = (end + 1, c)
        best, spans = None, []
        for x in WRONG_FOR_UTF8:
            mine, at = [], 0
            for start in sorted(found.get(x, ())):
                end, c = found[x][start]
                if start >= at:
                    mine.append((start, end, c))
                    at = end
            if sum(e - s for s, e, _ in mine) > sum(e - s for s, e, _ in spans):
                best, spans = x, mine
        return best, spans

    def _shown(self, text: str, runs: list[tuple[int, int, str]], k: int) -> bool:
        """Whether a run of sequences is only shown: in quotes by itself, or a letter that stands alone where the text around is plain."""
        s, e, c = runs[k]
        before, after = text[s - 1 : s], text[e : e + 1]
        if before in _OPEN and after in _CLOSE and before and after:
            return True
        if _SHOWS.search(text[max(0, s - 60) : s]) and not after.isalnum():
            return True
        letter = all(x.isalpha() for x in c) and len(c) == 1
        alone = (not before or not before.isalnum()) and (not after or not after.isalnum())
        if letter and alone and not (set(text[max(0, s - 60) : s] + text[e : e + 60]) - _ASCII):
            return c.lower() not in _WORD_LETTERS
        return False

    @staticmethod
    def _inside_word(text: str, s: int, e: int, c: str) -> bool:
        """Whether letters of a script other than Latin would come to stand inside a word of other letters."""
        other = [x for x in c if x.isalpha() and ord(x) > 0x2AF]
        around = text[s - 1 : s] + text[e : e + 1]
        return bool(other) and any(x.isalpha() and ord(x) > 127 for x in around)

    def _box(self, text: str, s: int, e: int, c: str, beside: bool = False) -> bool:
        """Whether a run of box-drawing characters is a drawing: not a word, nor an ordinary letter inside one or a Cyrillic one alone.
        beside: the text holds other garbled spans, so that signs count too unless drawn lines go on before or after."""
        if not all("─" <= x <= "▟" for x in text[s:e]):
            return False
        if not set(c) <= self.chars:
            return True
        if beside and not any("─" <= x <= "▟" for x in text[s - 1 : s] + text[e : e + 1]):
            return False
        if text[s - 1 : s].isalpha() or text[e : e + 1].isalpha():
            return False
        return not (c.isalpha() and (len(c) > 1 or c >= "Ѐ"))

    def _from_utf8(self, text: str) -> tuple[str, bool]:
        x, spans = self._spans(text)
        if not spans:
            return text, False
        runs: list[tuple[int, int, str]] = []
        for s, e, c in spans:
            if runs and runs[-1][1] == s:
                runs[-1] = (runs[-1][0], e, runs[-1][2] + c)
            else:
                runs.append((s, e, c))
        runs = [r for r in runs if not self._inside_word(text, *r)]
        shown = [self._shown(text, runs, k) for k in range(len(runs))]
        # two Cyrillic letters also stand in right texts, as do a quote and a letter that would make one: they need a longer run in the text
        shown = [sh or self._box(text, *run) for sh, run in zip(shown, runs, strict=True)]
        strong = [not sh and c[-1] != " " and (len(c) > 1 or not all("Ѐ" <= x <= "ӿ" for x in text[s:e])) and (len(c) > 1 or not "Ѐ" <= c <= "ӿ" or x in ("web", "latin-1")) for sh, (s, e, c) in zip(shown, runs, strict=True)]
        if not any(strong):
            return text, False
        # beside truly garbled spans, one in quotes is garbled too, unless the text says that it shows it
        shown = [sh and (self._box(text, *run, beside=True) or bool(_SHOWS.search(text[max(0, run[0] - 60) : run[0]]))) for sh, run in zip(shown, runs, strict=True)]
        out, at = [], 0
        for (s, e, c), sh in zip(runs, shown, strict=True):
            if not sh:
                out += [text[at:s], c]
                at = e
        out.append(text[at:])
        return "".join(out), True

    # -- one byte a character ---------------------------------------------------------------------------------------

    def _known(self, token: str, of=max) -> int:
        return of((self.counts.get(w.lower(), 0) for w in _WORDS.findall(token) if len(w) > 1 or w.lower() in _WORD_LETTERS), default=0)

    def _dash(self, token: str, turned: str) -> bool:
        """Whether a letter that stands alone, and in few texts does, would be a dash."""
        return len(token) == 1 and token.isalpha() and turned in _DASHES and self.counts.get(token.lower(), 0) <= LONE * self.letters.get("", 0)

    def _from_bytes(self, text: str) -> tuple[str, bool]:
        votes: Counter = Counter()
        hits: dict[tuple[str, str], list[int]] = {}
        if len(self.words):
            for end, (seq, values) in self.words.iter(text):
                start = end - len(seq) + 1
                before, after = text[start - 1 : start], text[end + 1 : end + 2]
                if before.isalpha() or after.isalpha():
                    continue
                for true, wrong, _ in values:
                    votes[true, wrong] += len(seq)
                    hits.setdefault((true, wrong), []).append(start)
        for m in _IN_SIGNS.finditer(text):
            for true, wrong in SINGLE_BYTE if m[1] + m[2] not in _PAIRED else ():
                if swap(m[1] + m[2], wrong, true) in _PAIRED:
                    votes[true, wrong] += 2
                    hits.setdefault((true, wrong), []).append(m.start())
        if not votes:
            return text, False
        top = [p for p in SINGLE_BYTE if votes[p] == max(votes.values())]
        high = {c for c in text if ord(c) > 127}
        true, wrong = max(top, key=lambda p: (sum(c in tables(p[1])[1] for c in high), -SINGLE_BYTE.index(p)))
        places = hits[true, wrong]
        out, at, changed, k = [], 0, False, 0
        places.sort()
        units = []
        for m in _UNIT.finditer(text):
            n = 0
            while k < len(places) and places[k] < m.end():
                n += 1
                k += 1
            units.append((m.start(), m.end(), n))
        for s, e, n in units:
            unit = text[s:e]
            if unit.isascii():
                continue
            tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(unit) if not m[0].isascii()]
            turned = [swap(t, wrong, true) for _, _, t in tokens]
            if not n and not all(v is not None and (foreign(t, v) or self._dash(t, v) or not self._known(t, min)) and (self._known(v) or set(v) - _ASCII <= self.chars) and v != t for v, (_, _, t) in zip(turned, tokens, strict=True)):
                continue
            for v, (a, b, t) in zip(turned, tokens, strict=True):
                if v is None or v == t:
                    continue
                if not self._dash(t, v) and ((self._known(t, min) > self._known(v) and not foreign(t, v)) or (self._known(t, min) and foreign(v, t))):
                    continue
                # signs alone prove nothing, but one sign for a line inside a token of a garbled sentence isn't a drawing
                sign = n and set(v) - _ASCII <= SIGNS and set(t) & _ASCII and len(set(t) - _ASCII) == 1
                if (set(t) - _ASCII <= SIGNS or set(t) - _ASCII <= _LINES) and not sign and not (_LATIN.search(t) and self._known(v)) and not any(s + a <= p < s + b for p in places):
                    continue
                if not self._known(v) and not set(v) - _ASCII <= self.chars:
                    continue
                out += [text[at : s + a], v]
                at, changed = s + b, True
        out.append(text[at:])
        return "".join(out), changed

    # -- words without a pattern ------------------------------------------------------------------------------------

    def _weight(self, token: str, i: int) -> float:
        """Log of how often the character stands between its neighbours; signs inside a word never do."""
        near = lambda k: c if 0 <= k < len(token) and (c := token[k].lower()).isalpha() else " "
        return math.log(self.letters.get(near(i - 1) + token[i].lower() + near(i + 1), 0) + self.floor)

    def _odd(self, token: str) -> list[int]:
        """The places outside ASCII that speak for or against a token: letters, and signs between letters."""
        return [i for i, c in enumerate(token) if ord(c) > 127 and (c.isalpha() or (0 < i < len(token) - 1 and token[i - 1].isalpha() and token[i + 1].isalpha() and c not in _JOINS))]

    def _weights(self, token: str) -> dict[int, float]:
        """The weight of each of a token's odd places; a worker weighs each token once."""
        if (known := self._weighed.get(token)) is None:
            if len(self._weighed) >= KEEP:
                self._weighed.clear()
            known = self._weighed[token] = {i: self._weight(token, i) for i in self._odd(token)}
        return known

    def _from_letters(self, text: str) -> tuple[str, bool]:
        """Sentences turned back under the pair that makes their letters so much likelier that chance is ruled out."""
        if not self.letters:
            return text, False
        rare = math.log(2 * self.floor + 2)
        out, at, changed = [], 0, False
        for m in _UNIT.finditer(text):
            unit = m[0]
            if unit.isascii():
                continue
            tokens = []
            for x in _PIECE.finditer(unit):
                t = x[0]
                have = self._weights(t)
                # most pieces end here: nothing in them is rare
                if not have or min(have.values()) > rare or (t[0] in _OPEN and t.rstrip(".,;:!?")[-1:] in _CLOSE) or _SHOWS.search(unit[max(0, x.start() - 60) : x.start()]):
                    continue
                tokens.append((x.start(), x.end(), t, have))
            best: tuple[float, list[tuple[int, int, str]]] = (0.0, [])
            for true, wrong in SINGLE_BYTE if tokens else ():
                gain, places, turned = 0.0, 0, []
                for a, b, t, have in tokens:
                    v = swap(t, wrong, true)
                    if v is None or v == t or any(not v[i].isalpha() for i in have):
                        continue
                    gains = [self._weight(v, i) - w for i, w in have.items()]
                    if sum(gains) > 0 and sum(gains) >= LETTER_MEAN * len(gains):
                        gain, places = gain + sum(gains), places + len(gains)
                        turned.append((a, b, v))
                if gain > best[0] and gain >= LETTER_NATS and places > 1:
                    best = gain, turned
            for a, b, v in best[1]:
                out += [text[at : m.start() + a], v]
                at, changed = m.start() + b, True
        out.append(text[at:])
        return "".join(out), changed

    def restore(self, text: str) -> tuple[str, bool, bool]:
        """(restored text, whether anything was garbled, whether characters are lost for good)."""
        if text.isascii():
            return text, False, False
        lost = any(not _quoted(text, m.start(), m.end()) for m in _LOST.finditer(text))
        garbled = lost
        for _ in range(ROUNDS):
            text, a = self._from_utf8(text)
            b = False
            if not a:
                text, b = self._from_bytes(text)
            if not a and not b:
                text, b = self._from_letters(text)
            if not a and not b:
                break
            garbled = True
        return text, garbled, lost


_ASCII = {chr(i) for i in range(128)}
_LINES = {chr(i) for i in range(0x2500, 0x2580)}
_EDGES = "".join(SIGNS | {chr(i) for i in range(128) if not chr(i).isalnum()})
_LATIN = re.compile("[A-Za-z]")
#: Signs that open and close a quotation together, and dashes (fixed lists).
_PAIRED, _DASHES = {"“”", "‘’", "„“", "‚‘", "«»", "‹›", "„”", "”“"}, {"–", "—"}
#: A piece of ASCII between two other characters, as garbled quotation marks leave it.
_IN_SIGNS = re.compile(r"(?<![^\s(])([^\x00-\x7f])(?=[\x21-\x7e]*?[A-Za-z0-9])[\x21-\x7e]++([^\x00-\x7f])(?=[\s.,;:!?)]|$)")
_OPEN, _CLOSE = set("“\"‘'«„`‹"), set("”\"’'»“`›")
#: Letters that are words by themselves in some language (a fixed list).
_WORD_LETTERS = set("àáéèêóòôíìåöäüúùßияівокусєї")
_SHOWS = re.compile(r"\b(?:give|gives|shows?|shown|reads?|means?|become|becomes|prints?|see)\s*(?:as\s*)?[:“\"'‘(]?$", re.IGNORECASE)
#: Signs that stand between letters in right texts (a fixed list).
_JOINS = set("’‘–—…·-­/→×«»“”„‐‑−@&+=|_¬•‹›")
_LOST = re.compile("�+")
_UNIT = re.compile(r"[^\n]*?(?:[.!?…](?=\s)|\n|$)\s*|[^\n]+")
_TOKEN = re.compile(r"[^\s]+")
#: Pieces with characters outside ASCII, parted by plain white space only: a fixed space may be a garbled letter.
_PIECE = re.compile(r"(?<![^ \t\r\n\f\v])[^ \t\r\n\f\v\x80-\U0010ffff]*+[^\x00-\x7f][^ \t\r\n\f\v]*")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _quoted(text: str, s: int, e: int) -> bool:
    return bool(text[s - 1 : s]) and text[s - 1 : s] in _OPEN and text[e : e + 1] in _CLOSE and bool(text[e : e + 1])


def frequent_words(df: DataFrame, text: str, words: int = WORDS, docs: int = WORD_DOCS) -> dict[str, int]:
    """The words with letters or apostrophes outside ASCII that most texts hold, with their numbers of texts; counted over all texts, equal ones once.

    Collected to the driver: at most `words` of them.
    """
    return _most(word_counts(df, text), words, docs)


def _most(counted: DataFrame, words: int = WORDS, docs: int = WORD_DOCS) -> dict[str, int]:
    return {r["w"]: r["count"] for r in counted.filter(F.col("count") >= docs).orderBy(F.desc("count"), "w").limit(words).collect()}


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(w, count) of all words with letters or apostrophes outside ASCII."""
    # a text's copies would outweigh what other texts hold; they are told by the hash, so that no text is shuffled
    found = df.select(F.md5(F.col(text)).alias("h"), F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({_WORD})"), F.lit(1)), lambda w: F.lower(w))).alias("w")).filter(F.size("w") > 0).distinct()
    return found.select(F.explode("w").alias("w")).groupBy("w").count()


def letter_counts(counted: DataFrame) -> dict[str, int]:
    """Trigrams around the letters outside ASCII of all words, with their numbers of texts, word by word; at '' the largest number.

    Only letters that one of the single-byte encodings has, so their number is bounded by the alphabets whatever the data.
    """
    known = "".join(sorted({c for p in SINGLE_BYTE for x in p for c in tables(x)[1] if c.isalpha()} | {c.lower() for p in SINGLE_BYTE for x in p for c in tables(x)[1] if c.isalpha()}))
    padded = F.concat(F.lit(" "), F.regexp_replace("w", "[^\\p{L}]", " "), F.lit(" "))
    rows = counted.select("count", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))).alias("t"))
    # neighbours outside those alphabets can't be told apart from none
    rows = rows.filter(F.col("t").rlike(f"^[a-z {known}][{known}][a-z {known}]$"))
    found = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.sum("count").alias("n")).collect()}
    return found | {"": max(found.values(), default=0)} if found else {}


_restorers: dict[int, Restorer] = {}


def restorer_of(counts: dict[str, int], letters: dict[str, int] | None = None) -> Restorer:
    key = hash((frozenset(counts.items()), frozenset((letters or {}).items())))
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(counts, letters)
    return _restorers[key]


def restore(df: DataFrame, key: str, text: str, counts: dict[str, int] | None = None, keep_text: bool = False) -> DataFrame:
    """(key, restored_md5[, restored]) of each row whose text is garbled, wholly or in part.

    restored_md5 is the MD5 of the whole restored text, empty where characters are lost. Null, empty and right texts give no
    row, nor do texts that only quote garbled characters; whole texts are read, however long. Equal rows each give a row;
    an empty table gives none. counts: word counts to go by, by default those of df itself,
    with which words that have no pattern are told by their letters.
    """
    letters: dict[str, int] = {}
    if counts is None:
        counted = cut(word_counts(df, text))
        counts, letters = _most(counted), letter_counts(counted)
    shared = df.sparkSession.sparkContext.broadcast((counts, letters))
    kind = dict(df.dtypes)[key]
    rows = df.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))

    rows = spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer_of(*shared.value)
        for batch in batches:
            at, sums, texts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                out, garbled, lost = r.restore(t)
                if garbled:
                    at.append(i)
                    sums.append("" if lost else hashlib.md5(out.encode()).hexdigest())
                    texts.append(None if lost else out)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * keep_text, names=[key, "restored_md5"] + ["restored"] * keep_text)

    return rows.mapInArrow(run, f"`{key}` {kind}, restored_md5 string" + ", restored string" * keep_text)
