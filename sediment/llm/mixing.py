"""Mixing sources to target weights: raking of token weights, then calibrated sampling of documents.

Token sums of the cells (source, language, topic) are raked to the targets of the sources and to the corpus's marginals of languages
and topics, never above a source's cap of repeats. A cell's weight a token is the number of copies that each of its
documents should have: its whole part is given to all, its rest decides the order in which documents of a source, each
with a fixed random number, get one copy more until the source's token target is reached.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.language import code_column
from sediment.llm.tokenizer import encode
from sediment.runtime import cut

#: Topics that the marginals tell apart, those with most tokens; documents of the others are raked as one topic. Likewise languages.
#: No document is left out by them.
TOPICS, LANGS = 20, 30
#: Targets that a mixture can have; more are refused.
TARGETS = 100_000
ITERATIONS = 60
#: Bins of the sampling order a source, and of the bin that the target falls into; only the bin of a bin is then ordered exactly, one
#: row in sixteen million of a source.
BINS = 4096


def source_name(source: Column) -> Column:
    """Sources spelt unevenly are one: case and surrounding white space don't count; empty is null."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def topic_name(path: Column) -> Column:
    """The folder below the archive or collection, in lower case."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(path, r"^[^/]*/([^/]+)/", 1), F.lit(""))), F.lit("none"))


def rake(tokens: np.ndarray, source: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], want: np.ndarray, cap: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Token weights of cells, fitted in turn to the other marginals and to want, the tokens of each source.

    others: (index of each cell, target shares) a marginal. cap: most weight a token of each source. The last step is the
    sources', so they are met exactly wherever want is at most cap times the source's tokens.
    """
    x = tokens.astype(float).copy()
    top = tokens * cap[source]

    def to_sources() -> None:
        free = np.ones(len(x), bool)
        for _ in range(len(x)):
            held = np.bincount(source, np.where(free, 0, top), len(want))
            mine = np.bincount(source, np.where(free, x, 0), len(want))
            factor = np.divide(np.maximum(want - held, 0), mine, out=np.zeros(len(want)), where=mine > 0)
            x[free] *= factor[source][free]
            over = free & (x > top * (1 + 1e-12))
            if not over.any():
                break
            x[over] = top[over]
            free &= ~over
        np.minimum(x, top, out=x)

    to_sources()
    for _ in range(iterations):
        for index, share in others:
            sums = np.bincount(index, x, len(share))
            x *= np.divide(share * x.sum(), sums, out=np.ones(len(share)), where=sums > 0)[index]
        # a cell that holds tokens never dies out, so that it can still take what others can't
        x = np.maximum(x, tokens * 1e-9)
        to_sources()
    return x


def sized(docs: DataFrame, key: str, text: str, source: str, lang: str, path: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(doc, source, lang, topic, tokens) of every row, written to the checkpoint folder."""
    named = docs.select(F.col(key).alias("doc"), F.col(text).alias("__t"), source_name(F.col(source)).alias("source"), F.coalesce(code_column(F.col(lang)), F.lit("und")).alias("lang"), topic_name(F.col(path)).alias("topic"))
    return cut(encode(named, "doc", "__t", tokenizer, folder, counts_only=True, carry=("source", "lang", "topic")).withColumnRenamed("n_tokens", "tokens"))


def mixture(docs: DataFrame, targets: DataFrame, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of sized documents (doc, source, lang, topic, tokens) and targets (source, target_share, max_repeats).

    mix: (doc, source, tokens, copies), copies from 1 to max_repeats. report: (source, target_share, actual_share, tokens, documents,
    max_copies, available). size: tokens of the mixture, by default and at most what the scarcest source allows.
    Documents without tokens, with a null source or one that has no target aren't used; a target whose source
    has no documents can't be met: the others share out its part in proportion, and the report shows it with 0. Targets
    with a null or non-positive share or repeats count as not given; of two targets of one source the larger counts.
    Documents with one key and equal content are drawn alike. Empty documents or targets give an empty mixture.
    """
    given = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).filter(
        "source is not null and target_share > 0 and max_repeats > 0"
    )
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in given.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(TARGETS + 1).collect()}
    if len(goal) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    spark = docs.sparkSession
    names = sorted(goal)
    usable = docs.filter(F.col("source").isin(names) & (F.col("tokens") > 0))
    top = {c: [r[c] for r in usable.groupBy(c).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), c).limit(n).collect()] for c, n in (("topic", TOPICS), ("lang", LANGS))}
    usable = usable.withColumns({c: F.when(F.col(c).isin(v), F.col(c)).otherwise("other") for c, v in top.items()})
    rows = usable.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")).collect()  # at most sources x LANGS x TOPICS
    have = sorted({r["source"] for r in rows})
    report_schema = "source string, target_share double, max_repeats int"
    asked = spark.createDataFrame([(s, *goal[s]) for s in names], report_schema)
    if rows:
        tokens = np.array([r["t"] for r in rows], float)
        source = np.array([have.index(r["source"]) for r in rows])
        share = np.array([goal[s][0] for s in have])
        share /= share.sum()
        cap = np.array([goal[s][1] for s in have], float)
        room = np.bincount(source, tokens, len(have)) * cap
        most = float((room / share).min())
        total = most if size is None else min(size, most)
        others = []
        for c in ("lang", "topic"):
            values = sorted({r[c] for r in rows})
            index = np.array([values.index(r[c]) for r in rows])
            others.append((index, np.bincount(index, tokens, len(values)) / tokens.sum()))
        want = share * total
        rate = np.minimum(rake(tokens, source, others, want, cap) / tokens, cap[source])
        rate = np.where(np.abs(rate - np.rint(rate)) < 1e-6, np.rint(rate), rate)
        cells = [(r["source"], r["lang"], r["topic"], int(np.floor(x)), float(x - np.floor(x))) for r, x in zip(rows, rate, strict=True)]
        rest = want - np.bincount(source, tokens * np.floor(rate), len(have))
        wanted = dict(zip(have, rest.tolist(), strict=True))
    else:
        cells, wanted = [], {}
    rates = F.broadcast(spark.createDataFrame(cells, "source string, lang string, topic string, base int, part double"))  # one row a cell
    # a fixed random number in (0, 1] for each document, against the part of a copy it is due
    u = (F.pmod(F.xxhash64("doc"), F.lit(1 << 40)).cast("double") + 1) / float(1 << 40)
    ranked = usable.join(rates, ["source", "lang", "topic"]).withColumn("order", F.when(F.col("part") > 0, u / F.col("part")))
    place = F.col("order") / (1 + F.col("order")) * BINS
    ranked = ranked.withColumn("bin", F.floor(place).cast("int")).withColumn("inner", F.floor((place - F.col("bin")) * BINS).cast("int"))

    def reached(rows: DataFrame, column: str, budget: dict[str, float]) -> dict[str, tuple[int, float]]:
        """The bin of each source in which its budget ends, and what is left of it there; at most sources x BINS rows are collected."""
        held: dict[str, list[tuple[int, int]]] = {}
        for r in rows.groupBy("source", column).agg(F.sum("tokens").alias("t")).collect():
            held.setdefault(r["source"], []).append((r[column], r["t"]))
        out = {}
        for s in have:
            left, at = budget.get(s, 0.0), 0
            for b, t in sorted(held.get(s, ())):
                if t > left:
                    at = b
                    break
                left -= t
                at = b + 1
            out[s] = (at, left)
        return out

    edge = reached(ranked.filter("order is not null"), "bin", wanted)
    edges = F.broadcast(spark.createDataFrame([(s, *edge[s]) for s in have], "source string, edge int, budget double"))  # one row a source
    at_bin = ranked.join(edges.drop("budget"), "source").filter("bin = edge")
    inner = reached(at_bin, "inner", {s: left for s, (_, left) in edge.items()})
    edges = F.broadcast(spark.createDataFrame([(s, edge[s][0], *inner[s]) for s in have], "source string, edge int, inner_edge int, budget double"))
    placed = ranked.join(edges, "source").withColumn("at_edge", F.coalesce((F.col("bin") == F.col("edge")) & (F.col("inner") == F.col("inner_edge")), F.lit(False)))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("order", "doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the document that crosses the target is taken if that brings the source nearer to it
    at_edge = placed.filter("at_edge").withColumn("extra", (before + F.col("tokens") / 2 <= F.col("budget")).cast("int"))
    taken = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("inner") < F.col("inner_edge")))
    others_ = placed.filter("not at_edge").withColumn("extra", F.when(taken, 1).otherwise(0))
    mix = others_.unionByName(at_edge).select("doc", "source", "tokens", (F.col("base") + F.col("extra")).alias("copies")).filter("copies > 0")
    sums = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("max_copies"))
    available = usable.groupBy("source").agg(F.sum("tokens").alias("available"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    report = (
        F.broadcast(asked).join(sums, "source", "left").join(available, "source", "left").na.fill(0, ["tokens", "documents", "max_copies", "available"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0)))
        .select("source", "target_share", "actual_share", "tokens", "documents", "max_repeats", "max_copies", "available")
    )
    return mix, report
