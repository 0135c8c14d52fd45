"""The thin queries over the operators of this subpackage, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import is_contaminated, scan_contamination

    found = scan_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .quality import fit_from, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod("id", 4) == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base", "found"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "score",
    )


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import shared_folder
    from .packed_ids import read_ids, write_ids

    path = shared_folder(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .toxicity import fit_from, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod("id", 5) == 0, F.lit(False))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_text": op2_html_text,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_ann": op6_ann,
    "op7_near_dedup": op7_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_packed_ids": op9_packed_ids,
    "op10_toxicity": op10_toxicity,
}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
       from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.g = bw.g and dw.n = bw.n),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(item, ',' order by item) as items
       from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cov using (doc_id) left join it using (doc_id)
"""



def _op8_sql() -> str:
    from .license_scan import PHRASES, TEMPLATES, needed

    phrases = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES)
    sets = [(label, sorted(set(t.split()))) for label, t in TEMPLATES]
    templates = ", ".join(f"({words!r}, '{label}', {needed(len(words))})" for label, words in sets)
    return rf"""
with d as (select doc_id, {_WORDS} as w, string_split(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), chr(10)) as ls from documents),
p(pw, label) as (values {phrases}),
places as (select doc_id, label, i - 1 as i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), p where w[i : i + len(pw) - 1] = pw),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word from places group by doc_id),
t(tw, label, need) as (values {templates}),
b as (select doc_id, list_distinct(regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as bw from (select doc_id, unnest(ls) as l from d)),
f as (select doc_id, label, len(list_intersect(bw, tw)) / len(tw) as share from b, t where len(list_intersect(bw, tw)) >= need),
best as (select doc_id, max(share) as share from f group by doc_id),
bl as (select doc_id, string_agg(label, ',' order by label) as base_labels from (select distinct doc_id, label from places) group by doc_id),
al as (select doc_id, string_agg(label, ',' order by label) as labels from (select doc_id, label from places union select doc_id, label from f) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
       cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(share, 0)::double end as score
from d left join base using (doc_id) left join best using (doc_id) left join bl using (doc_id) left join al using (doc_id)
"""


ORACLE: dict[str, str] = {"op5_decontamination": _OP5, "op8_license_scan": _op8_sql()}
