"""Queries of the training-data operators, by name: each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import garbled, language, mixing, seen, tokenizer, transcripts
from sediment.runtime import table


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Every layer once; a layer delivered twice with the same content, label and kind is one."""
    rows = table(spark, d, "zx_layers").select("sha256", "n", "kind", "language", "content")
    return rows.filter("sha256 is not null and n is not null").withColumn("sha256", F.lower(F.hex("sha256")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.languages(_layers(spark, d), ["sha256", "n"], "content", "language", "kind")
    return found.filter("n_langs > 1 or not coalesce(named, false)").select("sha256", "n", "lang").distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(_layers(spark, d), ["sha256", "n"], "content", "language", "kind", segments=True).withColumn("confidence", F.round("confidence", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(_layers(spark, d), ["sha256", "n"], "content", "language", "kind").select("sha256", "n", "turn", "speaker", "words")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(_layers(spark, d), ["sha256", "n"], "content", "language", "kind", with_text=True)


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    incoming = table(spark, d, "zx_incoming").select("seq", seen.digest_key(F.col("sha256")).alias("key")).filter("seq is not null")
    return seen.seen_before(table(spark, d, "zx_files").select("sha256"), "sha256", incoming, "key", "seq")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)[0].distinct()


def p4_rate(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "zx_files").select("sha256")
    return seen.wrong_answers(_seen(spark, d)[1], files.count())


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decode(p6_ids(spark, d), "doc_id", "ids")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.sized(table(spark, d, "documents"), "doc_id", "text", "source", "lang", "path")
    return mixing.mixture(docs, table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(table(spark, d, "documents"), "doc_id", "text").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_segments, p2_found, p2_turns, p4_found, p4_rate, p6_ids, p6_decoded, p7_mixture, p7_shares, p8_found)
    return {f.__name__: f for f in found}


#: The digest of an incoming record as hex, written out for the oracle.
_DIGEST = r"""
with t as (select seq, trim(sha256, chr(32) || chr(9) || chr(10) || chr(13)) as t from zx_incoming),
b as (select seq, t, regexp_replace(t, '^(sha-?256\s*[:=]\s*|\\x|0x)', '', 'i') as b from t),
k as (select seq, case
    when regexp_full_match(b, '[0-9A-Fa-f]{64}') then lower(b)
    when regexp_full_match(b, '[0-9A-Fa-f]{2,32}([ :._-][0-9A-Fa-f]{2,32})+') and regexp_full_match(regexp_replace(b, '[ :._-]', '', 'g'), '[0-9A-Fa-f]{64}')
      then lower(regexp_replace(b, '[ :._-]', '', 'g'))
    when regexp_full_match(t, 'sha256-[A-Za-z0-9+/]{43}=') then lower(hex(from_base64(t[8:])))
  end as k from b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _DIGEST
        + """, f as (select distinct lower(hex(sha256)) as k from zx_files where sha256 is not null),
        m as (select k, min(seq) as first from k where k is not null group by k)
        select k.seq from k join m using (k) left join f using (k) where f.k is not null or k.seq > m.first""",
        "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
