"""Full-text search with BM25 over DataFrames: tokens, kept postings, boolean and phrase queries, weighted fields.

A search looks at the postings of its own words only. They come from a kept index, sorted by word, or from one pass over the
texts that tokenizes each once; phrases are counted by an equi-aggregation on (row, column, place where the phrase would start).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.runtime import cut
from sediment.sources.lake import Lake, Table, UnsupportedError

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
#: Letters folded to several, and letters without a decomposition folded to one.
MULTI = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
SINGLE = {"ð": "d", "đ": "d", "ħ": "h", "ı": "i", "ŀ": "l", "ł": "l", "ŉ": "n", "ø": "o", "ŧ": "t"}
#: Blocks whose small letters lose their marks: Latin with marks, and Greek with accents.
FOLDED = (*range(0xDF, 0x180), ord("ǎ"), ord("ș"), ord("ț"), *range(0x384, 0x3CF), ord("ᾶ"))
#: Buckets of words in a kept index.
BUCKETS = 64


def _fold_table() -> dict[str, str]:
    out = dict(SINGLE)
    for c in map(chr, FOLDED):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isalpha() and c == c.lower():
            out.setdefault(c, base)
    return out


#: One table for texts and queries.
FOLD = _fold_table()


def folded(text: Column) -> Column:
    """Lower case with Latin and Greek letters without their marks, and a few letters written out."""
    t = F.lower(text)
    for a, b in MULTI.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, "".join(FOLD), "".join(FOLD.values()))


def folded_text(text: str) -> str:
    """folded() of a query's text, on the driver."""
    return text.lower().translate(str.maketrans(FOLD | MULTI))


def tokens(text: Column, longest: int | None = None) -> Column:
    found = F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) <= longest) if longest else found


def words_of(text: str) -> list[str]:
    """tokens() of a query's text, on the driver."""
    out, word = [], ""
    for c in folded_text(text) + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


# -- queries ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A phrase of words, each whole or the start of one; columns: the only ones it may stand in; first: at their start."""

    words: tuple[tuple[str, bool], ...]
    columns: tuple[str, ...] | None = None
    first: bool = False


_PIECE = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:^+*,-])|([^\s"(){}:^+*,.\-!#$%&\'/;<=>?@\[\\\]`|~]+))')


def joined(how: str, a: tuple | None, b: tuple | None) -> tuple | None:
    """Two sides of an operator; one without words says nothing."""
    return (how, a, b) if a and b else a if how == "not" else a or b


class _Parser:
    """Words that follow each other are joined tightest, then NOT, then AND, then OR."""

    def __init__(self, query: str, columns: list[str]):
        self.columns, self.at, self.items = columns, 0, []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _PIECE.match(query, at)
            if m is None:
                raise ValueError(f"fts: syntax error near {query[at:].strip()[:20]!r}")
            kind = "text" if m[1] is not None else "sign" if m[2] else "word"
            self.items.append((kind, (m[1].replace('""', '"') if m[1] is not None else m[2] or m[3])))
            at = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, value: str) -> bool:
        if self.peek() == ("sign", value) or self.peek() == ("word", value):
            self.at += 1
            return True
        return False

    def fail(self) -> ValueError:
        return ValueError(f"fts: syntax error near {self.peek()[1]!r}")

    def chain(self, word: str, below, within) -> tuple | None:
        left = below(within)
        while self.peek() == ("word", word):
            self.at += 1
            left = joined(word.lower(), left, below(within))
        return left

    def either(self, within=None) -> tuple | None:
        return self.chain("OR", lambda w: self.chain("AND", lambda v: self.chain("NOT", self.sequence, v), w), within)

    def sequence(self, within) -> tuple | None:
        left = self.primary(within)
        while self.peek() not in (("end", ""), ("sign", ")"), ("word", "OR"), ("word", "AND"), ("word", "NOT")):
            left = joined("and", left, self.primary(within))
        return left

    def names(self) -> list[str]:
        if self.take("{"):
            out = []
            while not self.take("}"):
                kind, name = self.peek()
                if kind not in ("word", "text"):
                    raise self.fail()
                out.append(name)
                self.at += 1
            return out
        kind, name = self.peek()
        if kind not in ("word", "text"):
            raise self.fail()
        self.at += 1
        return [name]

    def filter_ahead(self) -> bool:
        k = 1 if self.peek() == ("sign", "-") else 0
        return self.peek(k) == ("sign", "{") or (self.peek(k)[0] in ("word", "text") and self.peek(k + 1) == ("sign", ":"))

    def primary(self, within) -> tuple | None:
        if self.filter_ahead():
            without = self.take("-")
            chosen = []
            for n in self.names():
                found = next((c for c in self.columns if c.lower() == n.lower()), None)
                if found is None:
                    raise ValueError(f"fts: no such column: {n}")
                chosen.append(found)
            if not self.take(":"):
                raise self.fail()
            chosen = tuple(c for c in self.columns if (c in chosen) != without and (within is None or c in within))
            return self.primary(chosen)
        if self.take("("):
            out = self.either(within)
            if not self.take(")"):
                raise self.fail()
            return out
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            raise UnsupportedError("fts: NEAR")
        first = self.take("^")
        words: list[tuple[str, bool]] = []
        while True:
            kind, text = self.peek()
            if kind not in ("word", "text") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise self.fail()
            self.at += 1
            more = [(w, False) for w in words_of(text)]
            if self.take("*") and more:
                more[-1] = more[-1][0], True
            words += more
            if not self.take("+"):
                return ("term", Term(tuple(words), within, first)) if words else None


def parse(query: str, columns: list[str]) -> tuple | None:
    """('and'|'or'|'not', left, right) or ('term', Term) of words, "phrases", pre*, a + b, ^first, AND, OR, NOT, parentheses and the
    column filters a:, {a b}:, -a:. NEAR and unknown columns are errors; a query without words is None."""
    p = _Parser(query, columns)
    out = p.either() if p.items else None
    if p.at < len(p.items):
        raise p.fail()
    return out


# -- postings --------------------------------------------------------------------------------------------------------


def _wanted(terms: list[Term], token: Column) -> Column:
    """Whether a word is one that the terms ask for; equalities and ranges, which reach the scan."""
    plain = sorted({w for t in terms for w, start in t.words if not start})
    out = token.isin(plain) if plain else F.lit(False)
    for w in sorted({w for t in terms for w, start in t.words if start}):
        out = out | token.startswith(w)
    return out


def _places(i: int) -> Column:
    """(token, column, position) of the words of column i, split in t{i}."""
    return F.transform(f"t{i}", lambda w, p: F.struct(w.alias("token"), F.lit(i).alias("column"), p.alias("position")))


def _hits(docs: DataFrame, key: str, columns: list[str], terms: list[Term]) -> tuple[DataFrame, DataFrame]:
    """(documents with their length, postings of the terms' words), from one pass that tokenizes each text once."""
    split = docs.select(F.col(key).alias("key"), *[tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    mine = [F.filter(_places(i), lambda x: _wanted(terms, x["token"])) for i in range(len(columns))]
    held = cut(split.select("key", sum((F.size(f"t{i}") for i in range(len(columns))), F.lit(0)).alias("length"), F.concat(*mine).alias("hits")))
    return held.select("key", "length"), held.select("key", F.explode("hits").alias("h")).select("key", "h.*")


def _phrases(postings: DataFrame, columns: list[str], terms: list[Term]) -> DataFrame:
    """(key, term, n): how often each phrase stands in each document. A word at its slot votes for the place where the phrase starts."""
    options = []
    for k, t in enumerate(terms):
        allowed = [columns.index(c) for c in (columns if t.columns is None else t.columns)]
        for i, (w, start) in enumerate(t.words):
            same = F.col("token").startswith(w) if start else F.col("token") == w
            fits = same & F.col("column").isin(allowed) & (F.col("position") >= i)
            if t.first:
                fits = fits & (F.col("position") == i)
            options.append(F.when(fits, F.struct(F.lit(k).alias("term"), F.lit(i).alias("slot"))))
    slots = F.filter(F.array(*options), lambda x: x.isNotNull()) if options else F.array().cast("array<struct<term:int,slot:int>>")
    votes = postings.select("key", "column", "position", F.explode(slots).alias("s")).select("key", "column", F.col("s.term").alias("term"), (F.col("position") - F.col("s.slot")).alias("start"), F.col("s.slot").alias("slot"))
    sizes = F.element_at(F.array(*[F.lit(len(t.words)) for t in terms]), F.col("term") + 1)
    whole = votes.groupBy("key", "column", "term", "start").agg(F.count_distinct("slot").alias("n")) if any(len(t.words) > 1 for t in terms) else votes.withColumn("n", F.lit(1))
    return whole.filter(F.col("n") == sizes).groupBy("key", "term").agg(F.count("*").alias("n"))


def _terms(tree: tuple | None) -> list[Term]:
    """The phrases of a query, one as often as it stands there."""
    if tree is None:
        return []
    return [tree[1]] if tree[0] == "term" else _terms(tree[1]) + _terms(tree[2])


def _scored(tree: tuple | None, documents: DataFrame, postings: DataFrame, columns: list[str], key: str) -> DataFrame:
    if tree is None:
        return documents.filter("false").select(F.col("key").alias(key), F.lit(0.0).alias("score"))
    often = Counter(_terms(tree))
    terms = list(often)
    counted = _phrases(postings, columns, terms)
    rows = counted.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("term") == i, F.col("n"))), F.lit(0)).alias(f"f{i}") for i in range(len(terms))])
    stats = documents.agg(F.count("*").alias("docs"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("average"))  # one row
    held = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])  # one row

    def match(node: tuple) -> Column:
        if node[0] == "term":
            return F.col(f"f{terms.index(node[1])}") > 0
        a, b = match(node[1]), match(node[2])
        return a & b if node[0] == "and" else a | b if node[0] == "or" else a & ~b

    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"f{i}").cast("double"), F.col(f"d{i}").cast("double")
        raw = F.log((F.col("docs") - d + 0.5) / (d + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + often[terms[i]] * idf * (f * (K1 + 1.0)) / (f + K1 * (1 - B + B * F.col("length") / F.col("average")))
    found = rows.filter(match(tree)).join(documents, "key").join(F.broadcast(stats)).join(F.broadcast(held))
    return found.select(F.col("key").alias(key), (-score).alias("score"))


def search(docs: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """(key, score) of the rows that match, score being the negated BM25 sum over every phrase of the query, best lowest.

    key is unique. Each text is tokenized once; only the words of the query leave the scan. Rows with a null key or no tokens count as
    documents but don't match; an empty table or query gives no rows.
    """
    tree = parse(query, columns)
    documents, postings = _hits(docs, key, columns, list(dict.fromkeys(_terms(tree))))
    return _scored(tree, documents, postings.filter("key is not null"), columns, key)


class TextIndex:
    """A kept index on a lake: words of each column with their places, in files by bucket and sorted by word, and the documents' lengths.

    Columns that aren't indexed are kept with the documents and answer equality.
    """

    def __init__(self, lake: Lake, name: str, key: str = "", columns: list[str] | None = None, unindexed: tuple[str, ...] = (), key_type: str = "bigint", buckets: int = BUCKETS):
        self.lake, self.name = lake, name
        if f"{name}.documents" not in lake.tables():
            plain = "".join(f", `{c}` string" for c in unindexed)
            options = {"key": key, "columns": columns, "unindexed": list(unindexed), "buckets": buckets}
            with lake._transaction(f"create index {name}"):
                lake.create(f"{name}.documents", Table(f"key {key_type}, length bigint{plain}", kind="fts", options=options))
                lake.create(f"{name}.postings", Table(f"key {key_type}, token string, column int, position int, bucket int", kind="fts", options={"partition": "bucket"}))
        o = lake._entry(f"{name}.documents")["options"]
        self.key, self.columns, self.unindexed, self.buckets = o["key"], o["columns"], o["unindexed"], o["buckets"]

    def add(self, docs: DataFrame) -> None:
        """More documents, in one generation; their keys must be new."""
        split = docs.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), *[F.col(c).cast("string").alias(c) for c in self.unindexed], *[tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(self.columns)])
        places = F.concat(*[_places(i) for i in range(len(self.columns))])
        rows = split.select("key", F.explode(places).alias("x")).select("key", "x.*").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))
        # a frequent word's bucket is written by several tasks, each sorted by word
        placed = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "token", "key")
        documents = split.select("key", sum((F.size(f"t{i}") for i in range(len(self.columns))), F.lit(0)).cast("bigint").alias("length"), *self.unindexed)
        lake = self.lake
        with lake._transaction(f"add to {self.name}") as staged:
            for table, df, parts in ((f"{self.name}.documents", documents, None), (f"{self.name}.postings", placed, ["bucket"])):
                e = lake._entry(table)
                staged[table] = e | {"paths": [*e["paths"], lake._write(df, parts)]}

    def search(self, query: str, equal: dict[str, str] | None = None, n: int | None = None) -> DataFrame:
        """(key, score), best lowest: only buckets and files of the query's words are read. n keeps the best n, ties by key."""
        tree = parse(query, self.columns)
        terms = _terms(tree)
        postings = self.lake.read(f"{self.name}.postings").filter(_wanted(terms, F.col("token")))
        if not any(start for t in terms for _, start in t.words):
            words = sorted({w for t in terms for w, _ in t.words})
            hashed = postings.sparkSession.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(self.buckets)).cast("int") for w in words])).first()[0] if words else []
            postings = postings.filter(F.col("bucket").isin(hashed))
        out = _scored(tree, self.lake.read(f"{self.name}.documents").select("key", "length"), postings, self.columns, self.key)
        for c, v in (equal or {}).items():
            if c not in self.unindexed:
                raise ValueError(f"fts: {c} isn't kept")
            mine = self.lake.read(f"{self.name}.documents").filter(F.col(c) == v).select(F.col("key").alias(self.key))
            out = out.join(mine, self.key, "left_semi")
        return out.orderBy("score", self.key).limit(n) if n else out


def weighted_search(docs: DataFrame, key: str, weights: dict[str, float], words: list[str], n: int | None = None) -> DataFrame:
    """(key, score): sum over fields of weight times BM25 with an IDF that stays positive; every word must occur in some field.

    A word that ends in * matches by its start. Highest first, ties by key; n keeps the top n.
    """
    fields = list(weights)
    parsed = [(folded_text(w.rstrip("*")), w.endswith("*")) for w in words]
    held = docs.select(F.col(key).alias("__key"), *[tokens(F.coalesce(F.col(c), F.lit("")), 64).alias(f"__t_{c}") for c in fields])

    def count(c: str, w: str, prefix: bool) -> Column:
        return F.size(F.filter(F.col(f"__t_{c}"), (lambda x: x.startswith(w)) if prefix else (lambda x: x == w)))

    counted = held.select("__key", *[F.size(f"__t_{c}").alias(f"__l_{c}") for c in fields], *[count(c, w, p).alias(f"__f_{c}_{i}") for c in fields for i, (w, p) in enumerate(parsed)])
    counted = cut(counted)  # so that each text is tokenized once
    stats = counted.agg(
        F.count("*").alias("__n"),
        *[F.avg(F.when(F.col(f"__l_{c}") > 0, F.col(f"__l_{c}"))).alias(f"__a_{c}") for c in fields],
        *[F.count_if(F.col(f"__f_{c}_{i}") > 0).alias(f"__d_{c}_{i}") for c in fields for i in range(len(parsed))],
    )
    score, need = F.lit(0.0), F.lit(True)
    for i in range(len(parsed)):
        need = need & (sum((F.col(f"__f_{c}_{i}") for c in fields), F.lit(0)) > 0)
        for c, weight in weights.items():
            f, d = F.col(f"__f_{c}_{i}").cast("double"), F.col(f"__d_{c}_{i}")
            idf = F.log(1 + (F.col("__n") - d + 0.5) / (d + 0.5))
            part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(f"__l_{c}") / F.col(f"__a_{c}")))
            score = score + F.lit(weight) * F.when(f > 0, part).otherwise(0.0)
    out = counted.filter(need).join(F.broadcast(stats)).select(F.col("__key").alias(key), score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(n) if n else out


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key, column, position) of every token, for a kept index."""
    parts = [docs.select(F.col(key), F.lit(c).alias("column"), F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("position", "token")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("token", key, "column", "position")


def plural_stem(token: Column) -> Column:
    """Light plural stemmer for words of more than three letters: -ies to -y (more than four), -sses to -ss, and -s dropped but after s, u, i."""
    n = F.length(token)
    cut_ = lambda k: F.substr(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token).when(token.endswith("ies") & (n > 4), F.concat(cut_(3), F.lit("y"))).when(token.endswith("sses"), cut_(2))
        .when(token.endswith("s") & ~token.rlike("[sui]s$"), cut_(1)).otherwise(token)
    )


def clean_subtitles(text: Column) -> Column:
    """Subtitle text without cue numbers, times and tags."""
    t = F.regexp_replace(text, r"(?m)^(?:WEBVTT.*|\d+\s*|[\d:.,]+\s*-->.*)$\R?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>|\{\\[^}]*\}", ""), r"\s+", " "))
