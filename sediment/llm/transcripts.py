"""Transcripts into clean, ordered speaker turns.

A content is cut into segments with a time, a label and text, whatever its layout. Within a transcript the written labels are
unified to persons. Boosted trees decide from labels, gaps and context whether a segment starts a new turn against the one
before; they are fitted on transcripts whose full names have been shortened or misspelt, so that what is true comes from what
they don't see. Other trees decide which tokens are hesitation sounds, by how forms are spread over speech and written texts;
they are fitted on tokens beside a pause against tokens of written texts and names. Both kinds, and the language model, are fitted on
bounded samples or counts; the counts of forms are of all rows.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import boost
from sediment.llm.language import NOTE, Model, batched, sentences, train
from sediment.runtime import cut, spread

#: Transcripts that the boundary trees are fitted on, about, drawn by a hash of the content; and the most characters of one.
SAMPLE, SAMPLE_CHARS = 1_500, 100_000
#: Least share of a language's spoken tokens that a form must have to be a hesitation sound; so at most the inverse number of forms a
#: language is looked at. And the most letters of one.
FORM_SHARE, FORM_LETTERS = 1e-5, 7
#: Most weight that a form's tokens have for or against; the side with fewer tokens keeps its part, so more data don't make both alike.
FORM_WEIGHT = 50
#: Tokens whose form a worker keeps.
KEEP = 200_000

_CLOCK = r"(?:\d{1,2}:)?\d{1,3}:\d{2}(?:[.,]\d{1,3})?"
_SECONDS = r"\d+(?:\.\d+)?s"
_AT = rf"(?:{_CLOCK}|{_SECONDS})"
_CUE = re.compile(rf"^\s*({_CLOCK})\s*-->\s*{_CLOCK}")
_ALONE = re.compile(rf"^\s*[\[(]?({_AT})[\])]?\s*$")
#: A time without brackets before a sound note.
_NOTED = re.compile(rf"^\s*({_AT})\s+(?=[\[(*♪<])")
_LEAD = re.compile(rf"^\s*(?:[\[(<]({_AT})[\])>]\s*|({_AT})\s+-\s+)")
_VOICE = re.compile(r"^\s*<v(?:\.[^ >]*)?\s+([^>]+)>\s*")
_INDEX = re.compile(r"^\s*\d+\s*$")
_ARROWS = re.compile(r"^\s*>>+\s*")
_LABEL = re.compile(rf"^\s*([^:\n]{{1,60}}?)\s*(?:[\[(]({_AT})[\])])?\s*:(?:\s+|$)")
_DASHED = re.compile(r"^\s*([^:\n]{1,60}?)\s+[-–—]\s+")
_ASIDE = re.compile(r"\s*[\[(][^\])]*[\])]\s*")
_NUMBERED = regex.compile(r"^(?:(?:\p{L}+)[ _-]?)?#?0*(\d{1,3})$")
_NAME = regex.compile(r"^(?:(?:\p{Lu}[\p{L}\p{M}'’-]*|\p{Lu}\.|(?:de|da|di|do|dos|del|van|von|der|den|la|le|el)\b)\.?(?:\s+|$)){1,4}$")
_TITLE = regex.compile(r"^(?:dr|prof|mr|mrs|ms|sr|sra|herr|frau|m|mme|д-р|проф)\.?\s+(?=\p{L}{2})", regex.IGNORECASE)
_SPLIT = re.compile(r"(?<![.…])(?<=[.!?])\s+|\n+")
#: A line's end that doesn't end a sentence.
_WRAPPED = re.compile(r"(?<![.!?…\n])\n(?!\n)")
_HAS_WORD = regex.compile(r"[\p{L}\p{N}]")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_LETTERS = regex.compile(r"^[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*$")


@dataclass
class Segment:
    time: float | None
    label: str | None
    text: str
    arrows: bool = False


def seconds(text: str) -> float:
    if text.endswith("s"):
        return float(text[:-1])
    out = 0.0
    for part in text.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def is_label(text: str) -> bool:
    """Whether text names a speaker: a numbered speaker, or up to four capitalised words or initials."""
    bare = _ASIDE.sub(" ", text).strip()
    if not bare or len(bare) > 45:
        return False
    return bool(_NUMBERED.match(bare) and not bare.isdigit()) or bool(_NAME.match(bare))


def parse(content: str) -> list[Segment]:
    """The segments in order of time where times are given, else of lines; lines without time or label go with the line before."""
    out: list[Segment] = []
    time: float | None = None
    fresh = True
    lines = content.splitlines()
    for i, line in enumerate(lines):
        if not line.strip() or line.startswith("WEBVTT"):
            continue
        if m := _CUE.match(line):
            time, fresh = seconds(m[1]), True
            continue
        if _INDEX.match(line) and i + 1 < len(lines) and _CUE.match(lines[i + 1]):
            continue
        if (m := _ALONE.match(line)) or ((m := _NOTED.match(line)) and not NOTE.sub(" ", line[m.end() :]).strip()):
            time, fresh = seconds(m[1]), True
            continue
        label, dashed = None, False
        if m := _LEAD.match(line):
            time, fresh, dashed = seconds(m[1] or m[2]), True, bool(m[2])
            line = line[m.end() :]
        arrows = False
        if m := _ARROWS.match(line):
            arrows = True
            line = line[m.end() :]
        if m := _VOICE.match(line):
            label, line = m[1], line[m.end() :].replace("</v>", " ")
        elif dashed and (m := _DASHED.match(line)) and is_label(m[1]):
            label, line = m[1], line[m.end() :]
        elif (m := _LABEL.match(line)) and is_label(m[1]):
            label = m[1]
            if m[2]:
                time, fresh = seconds(m[2]), True
            line = line[m.end() :]
        if label is None and not fresh and out:
            out[-1].text += "\n" + line
            continue
        out.append(Segment(time, label, line, arrows))
        fresh = False
    if any(s.time is not None for s in out):
        last = -1.0
        for s in out:
            if s.time is None:
                s.time = last
            last = s.time
        out.sort(key=lambda s: s.time)
    return out


# -- persons ---------------------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """Equal, or one letter changed, missing, added or swapped with the next one, in words of four letters or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def name_parts(label: str) -> tuple[str, ...]:
    """The words of a label in lower case, without title and aside; a numbered speaker gives ('#', number)."""
    bare = _ASIDE.sub(" ", label).strip()
    if (m := _NUMBERED.match(bare)) and not _NAME.match(bare):
        return "#", m[1]
    bare = _TITLE.sub("", bare)
    return tuple(p for p in bare.casefold().replace(".", ". ").split() if p)


def _fits(form: tuple[str, ...], person: tuple[str, ...], exact: bool) -> bool:
    same = (lambda a, b: a == b) if exact else near
    if "#" in (form[0], person[0]):
        return form == person
    if len(form) == 1 and len(person) == 1:
        return same(form[0], person[0])
    if len(form) == 1:
        f = form[0].rstrip(".")
        initials = "".join(p[0] for p in person)
        return f == initials or any(same(f, p) for p in person if not p.endswith("."))
    if len(person) == 1:
        return _fits(person, form, exact)
    if len(form) != len(person):
        short, long = sorted((form, person), key=len)
        return short[0] == long[0] and same(short[-1], long[-1])
    return all(p[0] == f[0] if f.endswith(".") or p.endswith(".") else same(f, p) for f, p in zip(form, person, strict=True))


@dataclass
class People:
    """The persons of a transcript: the forms that name each, and which persons each form fits, exactly if it can."""

    aliases: list[list[tuple[str, ...]]] = field(default_factory=list)
    fits: dict[tuple[str, ...], list[int]] = field(default_factory=dict)

    def grade(self, form: tuple[str, ...] | None, person: int | None) -> int:
        """How well a form names a person: 3 one of its forms, 2 fits one exactly, 1 but for a letter, 0 not."""
        if form is None or person is None or person not in self.fits[form]:
            return 0
        mine = self.aliases[person]
        return 3 if form in mine else 2 if any(_fits(form, a, True) for a in mine) else 1


def people_of(forms: list[tuple[str, ...] | None]) -> People:
    """Persons by their forms: fuller forms are taken first, more frequent ones before rarer ones, so a misspelt name falls to the
    right one. A form that fits one person alone becomes one of its forms, which later forms may fit."""
    counts = Counter(f for f in forms if f)

    def fullness(f: tuple[str, ...]) -> int:
        return 4 if f[0] == "#" else sum(2 if len(p.rstrip(".")) > 1 else 1 for p in f) + (len(f) > 1) - (len(f) == 1 and len(f[0]) <= 3)

    out = People()
    for f in sorted(counts, key=lambda f: (-fullness(f), -counts[f], f)):
        mine: list[int] = []
        for exact in (True, False):
            mine = mine or [i for i, forms_ in enumerate(out.aliases) if any(_fits(f, a, exact) for a in forms_)]
        if not mine:
            out.aliases.append([])
            mine = [len(out.aliases) - 1]
        if len(mine) == 1:
            out.aliases[mine[0]].append(f)
        out.fits[f] = mine
    return out


def persons(labels: list[str | None]) -> list[int | None]:
    """The person of each label, as a number, however written; of several that it fits the one named last before counts."""
    forms = [None if x is None else name_parts(x) for x in labels]
    return _named(forms, people_of(forms))


def _named(forms: list[tuple[str, ...] | None], people: People) -> list[int | None]:
    out: list[int | None] = []
    last: dict[int, int] = {}
    for at, f in enumerate(forms):
        who = None if not f else max(people.fits[f], key=lambda i: (people.grade(f, i), last.get(i, -1), -i))
        if who is not None:
            last[who] = at
        out.append(who)
    return out


# -- turns -----------------------------------------------------------------------------------------------------------


def boundary_rows(segments: list[Segment], forms: list[tuple[str, ...] | None]) -> tuple[list[tuple], list[tuple[int | None, int | None]]]:
    """For each segment its features against the last labelled one before it, and (person by the label alone, best other person than the last).

    Features: label missing, how well it names the last person, how well the best other, how many others so well, numbered, of one
    word; gap, arrows, first, end of a sentence before, small letter, length, segments since the best other was named.
    """
    people = people_of(forms)
    who = _named(forms, people)
    rows, choices = [], []
    last: int | None = None
    named: dict[int, int] = {}
    for i, (s, f, p) in enumerate(zip(segments, forms, who, strict=True)):
        before = segments[i - 1] if i else None
        gap = s.time - before.time if before and s.time is not None and before.time is not None else -1.0
        others = sorted(((people.grade(f, x), named.get(x, -1), -x) for x in people.fits[f] if x != last), reverse=True) if f else []
        best = others[0] if others else (0, -1, 1)
        rows.append(
            (
                f is None, people.grade(f, last), best[0], sum(o[0] == best[0] for o in others), bool(f) and f[0] == "#", bool(f) and len(f) == 1,
                min(gap, 600.0), s.arrows, last is None, bool(before and before.text.rstrip()[-1:] in ".!?…"), s.text.lstrip()[:1].islower(), min(len(s.text), 500),
                min(i - best[1], 50) if best[1] >= 0 else -1,
            )
        )
        choices.append((p, -best[2] if others else None))
        if p is not None:
            last = p
            named[p] = i
    return rows, choices


def weakened(form: tuple[str, ...], rnd: random.Random) -> tuple[str, ...]:
    """Another way to write a name of two or more words: initials, one of the words, a letter swapped; or as it is."""
    first, rest = form[0], form[-1]
    swap = rnd.randrange(max(1, len(rest) - 2)) + 1
    ways = [form, (first[0] + ".", rest), (first, rest[0] + "."), (first,), (rest,), (first[0] + rest[0],), (*form[:-1], rest[:swap] + rest[swap : swap + 2][::-1] + rest[swap + 2 :])]
    return rnd.choice(ways)


def training_rows(content: str) -> tuple[list[tuple], list[int], list[int]]:
    """(features, whether a turn truly starts, what the labels alone say) of the segments of a transcript some of whose names are weakened.

    What is true comes from the full names and numbers as written; a segment without a label continues, by definition. Only segments
    that are certain count: with a full name or number and such a one before.
    """
    rnd = random.Random(zlib.crc32(content.encode()))
    segments = parse(content)
    true = [name_parts(s.label) if s.label else None for s in segments]
    full = [f is not None and (f[0] == "#" or (len(f) > 1 and all(len(p.rstrip(".")) > 2 for p in f))) for f in true]
    forms = [weakened(f, rnd) if ok and f[0] != "#" and rnd.random() < 0.6 else f for f, ok in zip(true, full, strict=True)]
    rows, choices = boundary_rows(segments, forms)
    xs, ys, plain = [], [], []
    last: tuple[str, ...] | None = None
    sure, seen = False, None
    for f, ok, row, (p, _) in zip(true, full, rows, choices, strict=True):
        if f is None or (ok and sure and (f == last or not _fits(f, last, False))):
            xs.append(row)
            ys.append(int(f is not None and f != last))
            plain.append(int(p is not None and p != seen))
        if f is not None:
            last, sure, seen = f, ok, p
    return xs, ys, plain


def boundary_quality(trees: boost.Trees, contents: list[str]) -> dict[str, tuple[float, float, float]]:
    """(accuracy, precision, recall) of the starts of turns on weakened transcripts: by the trees, and by the labels alone."""
    xs, ys, plain = [], [], []
    for c in contents:
        for held, more in zip((xs, ys, plain), training_rows(c), strict=True):
            held += more
    y = np.array(ys, bool)
    out = {}
    for name, said in (("trees", trees.probability(np.array(xs, float)) > 0.5), ("labels", np.array(plain, bool))):
        both = int((y & said).sum())
        out[name] = float((y == said).mean()), both / max(1, int(said.sum())), both / max(1, int(y.sum()))
    return out


def squeezed(core: str) -> str:
    """Lower case with runs of one letter made single."""
    return re.sub(r"(.)\1+", r"\1", core.casefold())


@dataclass
class Fitted:
    language: Model
    #: Language -> forms that are hesitation sounds.
    fillers: dict[str, set[str]]
    #: (language, form) of those forms of any language that its written texts hold, beyond a stray one.
    written: set[tuple[str, str]]
    boundary: boost.Trees


class Cleaner:
    def __init__(self, fitted: Fitted):
        self.fitted, self.model = fitted, fitted.language
        self.any = set().union(*fitted.fillers.values())
        self._tokens: dict[str, tuple[str, bool]] = {}

    def token(self, t: str) -> tuple[str, bool]:
        """(form that could be a hesitation sound or '', whether it holds a letter or digit); a worker looks at each token once."""
        if (known := self._tokens.get(t)) is None:
            if len(self._tokens) >= KEEP:
                self._tokens.clear()
            known = self._tokens[t] = form_of(t), bool(_HAS_WORD.search(t))
        return known

    def words(self, sentence: str, lang: str | None, sure: bool) -> tuple[int, list[str]]:
        """(pieces with a letter or digit, pieces) of a sentence without hesitation sounds. Where the sentence is too short to tell its
        language, a sound of any language counts that isn't a written word of the one spoken before."""
        mine = self.fitted.fillers.get(lang, ())
        n, kept = 0, []
        for t in sentence.split():
            form, word = self.token(t)
            if form in self.any and (form in mine or (not sure and (lang, form) not in self.fitted.written)):
                continue
            n += word
            kept.append(t)
        return n, kept

    def turns_of(self, contents: Iterator[tuple[object, str]]) -> Iterator[tuple[object, list[tuple[int, int, int, float | None, str]]]]:
        """(what, [(turn, speaker, words, start, text)] in order) of each content; boundaries and languages are decided for many at once."""
        held: list[tuple] = []
        rows: list[tuple] = []
        for what, content in contents:
            segments = parse(content)
            more, choices = boundary_rows(segments, [name_parts(s.label) if s.label else None for s in segments])
            held.append((what, segments, choices))
            rows += more
            if len(rows) >= 2_000:
                yield from self._flush(held, rows)
                held, rows = [], []
        if held:
            yield from self._flush(held, rows)

    def _flush(self, held: list[tuple], rows: list[tuple]) -> Iterator[tuple[object, list[tuple]]]:
        starts = iter(self.fitted.boundary.probability(np.array(rows, float)) > 0.5 if rows else ())
        texts = ((k, [x for s in segments for x in speech(s.text)]) for k, (_, segments, _) in enumerate(held))
        for k, _, classes in batched(self.model, texts):
            what, segments, choices = held[k]
            classes = iter(classes)
            out: list[list] = []
            numbers: dict[int, int] = {}
            speaker, lang = -1, None
            for s, (person, other) in zip(segments, choices, strict=True):
                if next(starts) and person is not None:
                    speaker = person if person != speaker or other is None else other
                n, kept = 0, []
                for x in speech(s.text):
                    found, p, count, _ = next(classes)
                    sure = count >= 3 and p > 0.8
                    lang = found if sure else lang or found
                    more, pieces = self.words(x, lang, sure)
                    n += more
                    kept += pieces
                if not n:
                    continue
                if out and out[-1][0] == speaker:
                    out[-1][1] += n
                    out[-1][3] += kept
                else:
                    numbers.setdefault(speaker, len(numbers) + 1)
                    out.append([speaker, n, s.time, kept])
            yield what, [(i + 1, numbers[who], n, time, " ".join(kept)) for i, (who, n, time, kept) in enumerate(out)]


def form_of(token: str) -> str:
    """The form by which a token could be a hesitation sound: few letters, no digits, repeated letters once; else ''."""
    core = _EDGE.sub("", token)
    if not core or not _LETTERS.match(core):
        return ""
    form = squeezed(core)
    return form if len(form) <= FORM_LETTERS else ""


def speech(text: str) -> list[str]:
    """The sentences of a segment's text without notes; a line that doesn't end a sentence goes on in the next one."""
    bare = NOTE.sub(" ", _WRAPPED.sub(" ", text))
    return [s for s in _SPLIT.split(bare) if s and not s.isspace()]


def _form_counts(df: DataFrame, content: str, kind: str, spoken: str, model: Model) -> DataFrame:
    """(lang, form, a, b, p, k): counts of short forms in transcripts and in other texts, in transcripts beside a pause, and there with a capital
    inside a sentence; form '' counts all tokens (not k). Over all rows, counted per batch before the shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(content).cast("string").alias("c"), F.col(kind).alias("k")).filter("c is not null")
    rows = spread(rows)

    def _batch(tokens: dict[tuple[str, str], Counter]) -> pa.RecordBatch:
        """Counts of tokens as counts of their forms; of all tokens under form ''."""
        held: Counter = Counter()
        for (lang, what), counter in tokens.items():
            for t, c in counter.items():
                if what in "abp":
                    held[lang, "", what] += c
                if form := form_of(t):
                    held[lang, form, what] += c
        columns = [[k[j] for k in held] for j in range(3)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(held.values()), pa.int64())], names=["lang", "form", "what", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        n = 0
        texts = ((kind_ == spoken, [x for s in parse(text) for x in speech(s.text)] if kind_ == spoken else sentences(text, kind_)) for batch in batches for text, kind_ in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for talk, ss, classes in batched(shared.value, texts):
            for s, (lang, p, count, _) in zip(ss, classes, strict=True):
                if count < 3 or p < 0.9:
                    continue
                tokens = s.split()
                n += len(tokens)
                held[lang, "a" if talk else "b"].update(tokens)
                if not talk:
                    continue
                paused = [i for i, t in enumerate(tokens) if t.endswith(("...", "…")) or (t in "–—-" and i + 2 < len(tokens) and tokens[i + 2] in "–—-")] if "..." in s or "…" in s or "–" in s or "—" in s or " - " in s else []
                paused = {i + 1 if tokens[i] in "–—-" else i for i in paused}
                held[lang, "p"].update([tokens[i] for i in paused])
                held[lang, "k"].update([t for i, t in enumerate(tokens) if i and t[0].isupper() and i not in paused])
            if n > 1_000_000:
                yield _batch(held)
                held.clear()
                n = 0
        if held:
            yield _batch(held)

    counted = rows.mapInArrow(run, "lang string, form string, what string, c bigint").groupBy("lang", "form")
    return counted.agg(*[F.sum(F.when(F.col("what") == x, F.col("c")).otherwise(0)).alias(x) for x in "abpk"])


def _fillers(counted: DataFrame) -> tuple[dict[str, set[str]], set[tuple[str, str]]]:
    """The hesitation sounds of each language, and those of any language that a language's written texts hold.

    Trees are fitted on tokens: beside a pause they count for, in written texts or with a capital inside a sentence against. The features tell
    how much commoner a form is in speech, how common, how long and of how many letters; a sound must stand beside a pause more often
    than the language's tokens do on average, as with enough data every word has stood there once. All is told by shares of the counts,
    so that the same sounds are found whatever the size.
    """
    totals = {r["lang"]: (r["a"], r["b"], r["p"]) for r in counted.filter("form = ''").collect()}
    if not totals:
        return {}, set()
    least = F.create_map(*[F.lit(x) for lang, (a, _, _) in totals.items() for x in (lang, float(a) * FORM_SHARE)])
    held = counted.filter("form <> '' and a > 0").filter(F.col("a") >= F.try_element_at(least, F.col("lang"))).collect()  # at most 1 / FORM_SHARE a language
    if not held:
        return {}, set()

    def features(r) -> tuple[float, ...]:
        a, b, _ = totals[r["lang"]]
        here, there = (r["a"] + 0.5) / (a + 100), (r["b"] + 0.5) / (b + 100)
        return math.log(here / there), math.log(here), len(r["form"]), len(set(r["form"]))

    x = np.array([features(r) for r in held], float)
    paused = np.array([r["p"] * totals[r["lang"]][0] > r["a"] * totals[r["lang"]][2] for r in held])
    yes, no = np.array([r["p"] for r in held], float) * paused, np.array([r["b"] + r["k"] for r in held], float)
    scale = FORM_WEIGHT / np.maximum(FORM_WEIGHT, np.maximum(yes, no))
    yes, no = yes * scale, no * scale
    trees = boost.fit(np.vstack([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), weight=np.concatenate([yes, no]))
    fillers: dict[str, set[str]] = {}
    for r, p, ok in zip(held, trees.probability(x), paused, strict=True):
        if p > 0.5 and ok:
            fillers.setdefault(r["lang"], set()).add(r["form"])
    every = sorted(set().union(*fillers.values()))
    found = counted.filter(F.col("form").isin(every) & (F.col("b") > 0)).collect() if every else []
    written = {(r["lang"], r["form"]) for r in found if r["b"] >= totals[r["lang"]][1] * FORM_SHARE}
    return fillers, written


def fit(df: DataFrame, keys: list[str], content: str, label: str, kind: str, spoken: str = "transcript", sample: int = SAMPLE) -> Fitted:
    """Everything that is learnt: the language model, hesitation sounds by counts of all rows, boundary trees on a bounded sample."""
    language = train(df, content, label, kind)
    fillers, written = _fillers(cut(_form_counts(df, content, kind, spoken, language)))
    talks = df.filter(F.col(kind) == spoken)
    # about `sample` contents by a threshold of their hash, equal ones once, so that copies of one transcript don't fill the sample
    most = 1 << 30
    edge = min(most, most * sample // max(1, talks.count()) + 1)
    some = sorted(talks.filter((F.pmod(F.xxhash64(content), F.lit(most)) < edge) & (F.length(content) <= SAMPLE_CHARS)).select(content).distinct().collect())
    xs: list[tuple] = []
    ys: list[int] = []
    for (text,) in some:
        more, starts, _ = training_rows(text)
        xs += more
        ys += starts
    return Fitted(language, fillers, written, boost.fit(np.array(xs, float), np.array(ys)) if xs else boost.Trees(9.0))


def turns(df: DataFrame, keys: list[str], content: str, label: str, kind: str, spoken: str = "transcript", fitted: Fitted | None = None, with_text: bool = False) -> DataFrame:
    """(*keys, turn, speaker, words[, start, text]): one row per turn of each row whose kind is `spoken`.

    Turns and speakers are numbered from 1. A content that is null, empty or without words gives no rows; speech before any
    label is a person's of its own; rows delivered twice give their turns once; whole contents are read, however long.
    """
    fitted = fitted or fit(df, keys, content, label, kind, spoken)
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(kind) == spoken).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(content).cast("string").alias("content")).filter("content is not null")
    rows = spread(rows)
    m = len(keys)
    head = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner = Cleaner(shared.value)
        for batch in batches:
            at, out = [], []
            for i, found in cleaner.turns_of(enumerate(batch.column(m).to_pylist())):
                at += [i] * len(found)
                out += found
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(m)]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())[: 5 if with_text else 3]
            more = ["turn", "speaker", "words", "start", "text"][: len(types)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=names + more)

    result = rows.mapInArrow(run, f"{head}, turn int, speaker int, words int" + ", start double, text string" * with_text)
    return result.withColumnsRenamed(dict(zip(names, keys, strict=True))).distinct()
