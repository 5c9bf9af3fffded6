"""Queries of the general training-data operators: changes between snapshots and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators.nested import GROUP, flat_table, nodes, triples
from sediment.operators.snapshot_diff import snapshot_changes
from sediment.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "zx_files").select("archive", "generation", "path", "loaded_at", "size", "sha256")
    return snapshot_changes(files, "archive", "generation", "path", "loaded_at", "size", "sha256")


def _manifests(spark: SparkSession, d: str, things_only: bool = False) -> DataFrame:
    return triples(table(spark, d, "arca_manifests").filter("manifest_id is not null"), "manifest_id", "body", things_only=things_only)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nodes(_manifests(spark, d, things_only=True)).withColumnRenamed("record", "manifest_id")


def p5_layers(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(_manifests(spark, d), "layer", ["type", "file", "language", "origin", "tool"]).withColumnRenamed("record", "manifest_id")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(_manifests(spark, d), "segment", ["start", "end", "text"]).withColumnRenamed("record", "manifest_id")


def p5_words(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(_manifests(spark, d), "word", ["c"]).withColumnRenamed("record", "manifest_id")


def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(_manifests(spark, d), "tag", ["by"]).withColumnRenamed("record", "manifest_id")


def p5_tag_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of tags; a tag of p5_tags belongs to the group whose node, followed by /items, its own begins with."""
    return flat_table(_manifests(spark, d), "tag" + GROUP, ["group"], other=True).withColumnRenamed("record", "manifest_id")


def p5_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(_manifests(spark, d), "description", []).withColumnRenamed("record", "manifest_id")


def p5_manifests(spark: SparkSession, d: str) -> DataFrame:
    """One row per manifest; fields without a column of their own are in other."""
    fields = ["file", "title", "mime", "format", "size", "added", "sha256", "sha1"]
    return flat_table(_manifests(spark, d), "root", fields, other=True).drop("node", "parent", "ordinal", "value").withColumnRenamed("record", "manifest_id")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_layers, p5_segments, p5_words, p5_tags, p5_tag_groups, p5_descriptions, p5_manifests)}

ORACLE = {
    "p3_found": """
with r as (
  select archive, generation, path, size, sha256, row_number() over (partition by archive, generation, path order by loaded_at desc nulls last) as rn
  from zx_files where path is not null and archive is not null and generation is not null),
l as (select archive, generation, path, size, sha256 from r where rn = 1),
g as (select archive, generation, lag(generation) over (partition by archive order by generation) as p from (select distinct archive, generation from l)),
n as (select l.*, g.p from l join g using (archive, generation) where g.p is not null),
o as (select l.archive, g.generation, l.path, l.size, l.sha256 from l join g on l.archive = g.archive and l.generation = g.p),
c as (select coalesce(n.archive, o.archive) as archive, coalesce(n.generation, o.generation) as generation, coalesce(n.path, o.path) as path,
  case when o.path is null then 'added' when n.path is null then 'removed'
       when n.sha256 is not null and o.sha256 is not null then case when n.sha256 <> o.sha256 then 'changed' end
       when n.size <> o.size then 'changed' end as op
  from n full join o on n.archive = o.archive and n.generation = o.generation and n.path = o.path)
select archive, generation, path, op from c where op is not null""",
}
