"""The language of each text and of each sentence of a mixed text, with a confidence.

Words first: a known word scores its log frequency in each language. An unknown one backs off to character n-grams,
the longest known one at each place, ever shorter down to single letters. The model is fitted on a bounded sample of labelled
rows of each language, drawn by a hash of the text; as labels may be wrong, the sample's sentences are then classified and its words
counted once more by what was found. The model is built once on the driver; every text is then read once, in batches of sentences.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.runtime import cut, spread

#: Two-letter code, three-letter codes, English name, own name.
LANGUAGES = """
en eng english|de deu ger german deutsch|fr fra fre french français francais|es spa spanish castilian español espanol castellano
pt por portuguese português portugues|it ita italian italiano|nl nld dut dutch nederlands flemish vlaams|sv swe swedish svenska
da dan danish dansk|no nor norwegian norsk nb nob bokmål nn nno nynorsk|fi fin finnish suomi|is isl ice icelandic íslenska
pl pol polish polski|cs ces cze czech čeština česky|sk slk slo slovak slovenčina|sl slv slovenian slovene slovenščina
hr hrv croatian hrvatski|sr srp serbian srpski српски|bs bos bosnian bosanski|hu hun hungarian magyar|ro ron rum romanian română
bg bul bulgarian български|mk mkd mac macedonian македонски|ru rus russian русский|uk ukr ukrainian українська|be bel belarusian беларуская
el ell gre greek ελληνικά|tr tur turkish türkçe|ar ara arabic العربية|he heb hebrew עברית|fa fas per persian فارسی|hi hin hindi हिन्दी
th tha thai ไทย|vi vie vietnamese tiếng việt|id ind indonesian|ms msa may malay|ja jpn japanese 日本語|ko kor korean 한국어
zh zho chi chinese 中文 mandarin|et est estonian eesti|lv lav latvian latviešu|lt lit lithuanian lietuvių|ca cat catalan català
gl glg galician galego|eu eus baq basque euskara|ga gle irish gaeilge|cy cym wel welsh cymraeg|la lat latin latina
""".strip().replace("\n", "|")
#: Code or name, in lower case -> two-letter code.
NAMES = {name.replace(" ", " "): group.split(" ")[0] for group in LANGUAGES.split("|") for name in group.split(" ")}
#: Labelled texts of each language that the model is fitted on, about; every text of a language with fewer.
SAMPLE = 2_000
#: Words per language that the model keeps at most, the most frequent first; others are scored by their n-grams.
WORDS = 30_000
#: A word or n-gram seen less often than this in all is unknown.
LEAST = 2
GRAM = 5
#: Weight of an unknown word against a known one.
UNKNOWN = 0.35
#: A sentence has a language of its own if so many of its known words don't begin with a capital, and with this confidence.
SENTENCE_WORDS, SENTENCE_SURE = 3, 0.95
#: Unknown words that a worker keeps scored.
KEEP = 100_000
#: Words scored at once, and sentences gathered for that.
AT_ONCE, SENTENCES = 50_000, 2_000

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_CUE = re.compile(rf"^\s*(?:{_TIME})\s*-->\s*(?:{_TIME}).*$")
_NUMBER = re.compile(r"^\s*\d+\s*$")
_STAMP = re.compile(rf"[\[(<]?\s*(?:(?<![\d:]){_TIME}(?![\d:])|(?<![\d.])\d+(?:\.\d+)?s\b)\s*[\])>]?")
#: Sound notes: in brackets, parentheses, asterisks or between notes, of letters and times only.
NOTE = regex.compile(r"\[[^\[\]\n]{0,60}\]|\((?![^()\n]*\d)[\p{L} '’.-]{1,40}(?:\d\d?:\d\d(?::\d\d)?)?\)|\*[^*\n]{1,40}\*|♪[^♪\n]{0,40}♪|<[^<>\n]{1,60}>")
_QUOTED = regex.compile(r"“[^“”\n]{1,80}”|«[^«»\n]{1,80}»|„[^„“”\n]{1,80}[“”]|\"[^\"\n]{1,80}\"")
_QUOTES = re.compile('[“«„"]')
_NOTED = re.compile(r"[\[(*♪<]")
_TIMED = re.compile(r"\d:\d\d|\ds\b")
_END = regex.compile(r"(?<=[.!?…])[\"”’»)]*\s+|\n+")


def code_of(label: str | None) -> str | None:
    """The two-letter code that a label names, in any usual code or name, with or without a region; None if it names none."""
    if not label:
        return None
    t = label.strip().lower()
    return NAMES.get(t) or NAMES.get(re.split(r"[-_.@ (/]", t, maxsplit=1)[0])


def code_column(label: Column) -> Column:
    """code_of as a column expression."""
    t = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, t), F.try_element_at(names, F.regexp_extract(t, r"^([^-_.@ (/]*)", 1)))


def sentences(content: str | None, kind: str | None) -> list[str]:
    """The sentences of a content, without cue numbers, times, sound notes and quoted titles.

    Lines inside a cue belong together, as do all lines of recognised pages; else a line ends a sentence.
    """
    if not content:
        return []
    if kind == "ocr":
        text = re.sub(r"(?<=\w)-\n(?=\w)", "", content).replace("\n", " ")
    elif "-->" in content:
        cues: list[str] = []
        fresh = True
        for line in content.splitlines():
            if not line.strip() or _CUE.match(line) or _NUMBER.match(line) or line.startswith("WEBVTT"):
                fresh = True
            elif fresh:
                cues.append(line)
                fresh = False
            else:
                cues[-1] += " " + line
        text = "\n".join(cues)
    else:
        text = content
    # most texts hold neither notes nor times, so the costly patterns are tried only where they can match
    if _NOTED.search(text):
        text = NOTE.sub(" ", text).replace("♪", " ")
    if _TIMED.search(text):
        text = _STAMP.sub(" ", text)
    out = []
    for s in _END.split(text):
        if _QUOTES.search(s):
            bare = _QUOTED.sub(" ", s)
            s = bare if len(_WORD.findall(bare)) >= SENTENCE_WORDS else s
        if s and not s.isspace():
            out.append(s)
    return out


@dataclass(frozen=True)
class Counts:
    """language -> word -> count, of the most frequent words; and the words counted in each language."""

    words: dict[str, dict[str, int]]
    totals: dict[str, int]


class Model:
    """Built once, on the driver; what it holds is bounded by WORDS and the languages, so it can be broadcast."""

    def __init__(self, counts: Counts):
        self.languages = sorted(k for k, v in counts.totals.items() if v)
        n = len(self.languages)
        sums: Counter = Counter()
        for x in self.languages:
            sums.update(counts.words[x])
        known = [w for w, c in sums.items() if c >= LEAST]
        self._rows = {w: i for i, w in enumerate(known)}
        table = np.full((len(known), n), 0.5)
        grams: dict[str, list[float]] = {}
        for j, x in enumerate(self.languages):
            for w, c in counts.words[x].items():
                if (i := self._rows.get(w)) is not None:
                    table[i, j] += c
                weight = min(c, 20)
                padded = f"^{w}$"
                for k in range(1, GRAM + 1):
                    for a in range(len(padded) - k + 1):
                        g = padded[a : a + k]
                        if (v := grams.get(g)) is None:
                            v = grams[g] = [0.5] * n
                        v[j] += weight
        totals = np.array([counts.totals[x] + 0.5 * len(known) for x in self.languages], float)
        table = np.log(table / totals) if len(known) else np.zeros((0, n))
        # what a word says is how much likelier it is in a language than on average, so that its rarity says nothing
        self._table = table - np.log(np.exp(table).mean(axis=1, keepdims=True)) if len(known) else table
        spread_ = np.ones(n)
        for g, v in grams.items():
            if len(g) == 1:
                spread_ += v
        kept = [g for g, v in grams.items() if sum(v) >= LEAST + 0.5 * n]
        self._gram_rows = {g: i for i, g in enumerate(kept)}
        held = np.log(np.array([grams[g] for g in kept]).reshape(len(kept), n) / spread_)
        self._grams = (held - np.log(np.exp(held).mean(axis=1, keepdims=True))).astype(np.float32) if len(kept) else held
        self._forget()

    def _forget(self) -> None:
        """The scores of unknown words met so far start anew, behind those of the known words."""
        self._ids = dict(self._rows)
        self._scores = np.vstack([self._table, np.zeros((1024, len(self.languages)))])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_ids", "_scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _back_off(self, word: str) -> np.ndarray:
        """Sum over the places of the word of the longest known n-gram that starts there and isn't inside the last one."""
        out, at, end = np.zeros(len(self.languages)), 0, 0
        padded = f"^{word}$"
        while at < len(padded):
            for k in range(min(GRAM, len(padded) - at), 0, -1):
                i = self._gram_rows.get(padded[at : at + k])
                if i is not None and at + k > end:
                    out += self._grams[i] * (k / GRAM)
                    end = at + k
                    break
            at += 1
        return out * UNKNOWN

    def ids(self, words: list[str]) -> np.ndarray:
        """The row of scores of each word, in lower case; known words stand before len(self._rows)."""
        get = self._ids.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (out < 0).any():
            if len(self._ids) - len(self._rows) > KEEP:
                self._forget()
                return self.ids(words)
            for i in np.flatnonzero(out < 0):
                w = words[i]
                if (k := self._ids.get(w)) is None:
                    k = self._ids[w] = len(self._ids)
                    if k >= len(self._scores):
                        self._scores = np.vstack([self._scores, np.zeros_like(self._scores[: max(1024, len(self._scores) // 2)])])
                    self._scores[k] = self._back_off(w)
                out[i] = k
        return out

    def classify_all(self, texts: list[str]) -> list[tuple[str | None, float, int, int]]:
        """(language, confidence, words, plain words) of each text; plain words are known and don't begin with a capital, so can't be names."""
        if not self.languages:
            return [(None, 0.0, 0, 0)] * len(texts)
        found = [_WORD.findall(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        sums, plain = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            # so many texts at once that their words' scores fit; of a longer text its words in pieces
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), AT_ONCE, side="right")) + at)
            words = [w for ws in found[at:end] for w in ws]
            owner = np.repeat(np.arange(at, end), sizes[at:end])
            for a in range(0, len(words), AT_ONCE):
                some, who = words[a : a + AT_ONCE], owner[a : a + AT_ONCE]
                low = [w.lower() for w in some]
                ids = self.ids(low)
                starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                sums[who[starts]] += np.add.reduceat(self._scores[ids], starts, axis=0)
                small = np.fromiter(map(operator.eq, some, low), bool, len(some)) & (ids < len(self._rows))
                plain += np.bincount(who, small, len(texts)).astype(np.int64)
            at = end
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        sure = p[np.arange(len(p)), best] / p.sum(axis=1)
        return [(self.languages[b], c, n, k) if n else (None, 0.0, 0, 0) for b, c, n, k in zip(best.tolist(), sure.tolist(), sizes.tolist(), plain.tolist(), strict=True)]

    def classify(self, text: str) -> tuple[str | None, float, int]:
        """(language, confidence, words); no language for a text without words."""
        return self.classify_all([text])[0][:3]


def batched(model: Model, texts: Iterator[tuple[object, list[str]]]) -> Iterator[tuple[object, list[str], list[tuple[str | None, float, int, int]]]]:
    """(what, its sentences, their classes) in order; sentences of many texts are classified at once."""
    held: list[tuple[object, list[str]]] = []
    n = 0

    def flush() -> Iterator[tuple[object, list[str], list]]:
        classes = iter(model.classify_all([s for _, ss in held for s in ss]))
        for what, ss in held:
            yield what, ss, [next(classes) for _ in ss]

    for what, ss in texts:
        held.append((what, ss))
        n += len(ss)
        if n >= SENTENCES:
            yield from flush()
            held, n = [], 0
    yield from flush()


def segments_of(model: Model, ss: list[str], classes: list[tuple[str | None, float, int, int]]) -> list[tuple[int, str, float, str]]:
    """(ordinal, language, confidence, text) of runs of sentences in one language; a sentence too short or unsure joins its neighbours'."""
    found = [(s, *c) for s, c in zip(ss, classes, strict=True) if c[2]]
    if not found:
        return []
    sure = [lang if n >= SENTENCE_WORDS and p >= SENTENCE_SURE and plain >= SENTENCE_WORDS else None for _, lang, p, n, plain in found]
    if not any(sure):
        lang, p, _ = model.classify(" ".join(f[0] for f in found))
        return [(0, lang, p, " ".join(f[0].strip() for f in found))]
    last = next(x for x in sure if x)
    out: list[list] = []
    for x, (s, _, p, _, _) in zip(sure, found, strict=True):
        last = x or last
        if out and out[-1][0] == last:
            out[-1][1].append(s.strip())
            out[-1][2].append(p if x else 0.5)
        else:
            out.append([last, [s.strip()], [p if x else 0.5]])
    return [(i, lang, sum(p) / len(p), " ".join(texts)) for i, (lang, texts, p) in enumerate(out)]


def sample_of(df: DataFrame, content: str, kind: Column, label: Column, size: int = SAMPLE) -> DataFrame:
    """(content, kind, label): about `size` texts of each label, equal ones once, those with the smallest hashes; in the checkpoint folder.

    Labels are codes, so that there are at most as many as known languages. The labels are counted, then each has its own threshold
    of the hash: neither a sort nor a shuffle of other texts.
    """
    rows = df.select(F.col(content).cast("string").alias("content"), kind.alias("kind"), label.alias("label")).filter("content is not null and label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return cut(rows)
    most = 1 << 30
    limits = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(most, most * size // n + 1))])
    return cut(rows.filter(F.pmod(F.xxhash64("content"), F.lit(most)) < F.try_element_at(limits, F.col("label"))).dropDuplicates())


def _collect(counted: DataFrame, words: int) -> Counts:
    """The most frequent words of each language, at most `words` each, collected. Which counts are frequent enough is read off a
    histogram of powers of two in eighths, so no language's vocabulary is sorted in one task; words at the edge are left out."""
    counted = cut(counted)
    steps: dict[str, dict[int, int]] = {}
    totals: dict[str, int] = {}
    for r in counted.groupBy("lang", F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).collect():
        steps.setdefault(r["lang"], {})[r["step"]] = r["n"]
        totals[r["lang"]] = totals.get(r["lang"], 0) + int(r["t"])
    lowest = {}
    for lang, held in steps.items():
        n, lowest[lang] = 0, 1 << 40
        for step in sorted(held, reverse=True):
            n += held[step]
            if n > words:
                break
            lowest[lang] = step
    out: dict[str, dict[str, int]] = {x: {} for x in totals}
    if lowest:
        edges = F.create_map(*[F.lit(x) for pair in lowest.items() for x in pair])
        for r in counted.filter(F.floor(F.log2("c") * 8) >= F.try_element_at(edges, F.col("lang"))).collect():
            out[r["lang"]][r["w"]] = int(r["c"])
    return Counts(out, totals)


def _counted_by(sample: DataFrame, model: Model | None) -> DataFrame:
    """(lang, w, c): words by the label, or by the language found sentence by sentence. Counted in each batch before the shuffle."""
    shared = None if model is None else sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        texts = ((lang, sentences(text, kind)) for batch in batches for text, kind, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for lang, ss, classes in batched(shared.value, texts) if shared else ((lang, ss, None) for lang, ss in texts):
            for i, s in enumerate(ss):
                found = lang
                if classes:
                    found, p, n, _ = classes[i]
                    if n < SENTENCE_WORDS or p < SENTENCE_SURE:
                        continue
                # once a sentence, so that a long text of one word doesn't outweigh a language
                held.update((found, w) for w in {w.lower() for w in _WORD.findall(s)})
            if len(held) > 200_000:
                yield _batch(held)
                held.clear()
        if held:
            yield _batch(held)

    def _batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array(list(held.values()), pa.int64())], names=["lang", "w", "c"])

    return spread(sample).mapInArrow(run, "lang string, w string, c bigint").groupBy("lang", "w").agg(F.sum("c").alias("c"))


def train(df: DataFrame, content: str, label: str, kind: str | None = None, words: int = WORDS, size: int = SAMPLE) -> Model:
    """The model of a bounded sample: its words are counted once by their labels, once by the languages then found."""
    sample = sample_of(df, content, F.col(kind) if kind else F.lit(None).cast("string"), code_column(F.col(label)), size)
    first = Model(_collect(_counted_by(sample, None), words))
    return Model(_collect(_counted_by(sample, first), words))


def languages(df: DataFrame, keys: list[str], content: str, label: str, kind: str | None = None, model: Model | None = None, segments: bool = False) -> DataFrame:
    """One row per row of df and language of its content: (*keys, label_code, lang, confidence, n_langs, named).

    named tells whether the label names that language. With segments: (*keys, segment, lang, confidence, text) in order. A
    content that is null, empty or has no words of its own gives no rows; whole contents are read, however long; equal
    rows give equal rows. Without any labelled row there is no language to name and the result is empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or train(df, content, label, kind))
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(content).cast("string").alias("content"), (F.col(kind) if kind else F.lit(None)).cast("string").alias("kind"), F.col(label).cast("string").alias("label")).filter("content is not null")
    rows = spread(rows)
    head = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names, strict=True))
    m = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at, out = [], []
            labels = batch.column(m + 2).to_pylist()
            texts = ((i, sentences(*x)) for i, x in enumerate(zip(batch.column(m).to_pylist(), batch.column(m + 1).to_pylist(), strict=True)))
            for i, ss, classes in batched(model, texts):
                found = segments_of(model, ss, classes)
                if segments:
                    at += [i] * len(found)
                    out += found
                    continue
                held: dict[str, list[float]] = {}
                for _, lang, p, _ in found:
                    held.setdefault(lang, []).append(p)
                code = code_of(labels[i])
                for lang, ps in held.items():
                    at.append(i)
                    out.append((code, lang, sum(ps) / len(ps), len(held), lang == code))
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(m)]
            types = (pa.int32(), pa.string(), pa.float64(), pa.string()) if segments else (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            tail = [pa.array([o[j] for o in out], t) for j, t in enumerate(types)]
            more = ["segment", "lang", "confidence", "text"] if segments else ["label_code", "lang", "confidence", "n_langs", "named"]
            yield pa.RecordBatch.from_arrays(columns + tail, names=names + more)

    tail = "segment int, lang string, confidence double, text string" if segments else "label_code string, lang string, confidence double, n_langs int, named boolean"
    result = rows.mapInArrow(run, f"{head}, {tail}")
    return result.withColumnsRenamed(dict(zip(names, keys, strict=True)))
