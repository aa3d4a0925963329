"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.mixing import Mix, mix_sources
from millrace.llm.percentiles import merge_sketches, percentiles, sketch_columns
from millrace.llm.text_quality import text_counts, text_forms
from millrace.llm.tokenization import decode_ids, encode_texts
from millrace.llm.top_items import top_items
from millrace.queries import Query, table
from millrace.session import cut

SHARES = {"p0_1": 0.001, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
#: Rank error of p1, as a share of the rows beyond the percentile on its nearer side, at three standard deviations.
EPS = 0.01


def _day_sketches(spark: SparkSession, folder: str) -> DataFrame:
    small = table(spark, folder, "small").withColumn("load_day", F.to_date("loaded_at"))
    return sketch_columns(small, ["load_day", "chrom"], ["count", "density"], EPS)


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """By chromosome and load day, and, with a null ``load_day``, over all days: the days' sketches put together. ``eps`` states the error."""
    days = cut(_day_sketches(spark, folder))
    whole = percentiles(merge_sketches(days, ["chrom"]), ["chrom"], SHARES).withColumn("load_day", F.lit(None).cast("date"))
    return percentiles(days, ["load_day", "chrom"], SHARES).unionByName(whole).withColumn("eps", F.lit(EPS))


def p1_day_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches themselves, as they would be stored for each day."""
    return _day_sketches(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items(table(spark, folder, "ex1_golden"), "bed_featname", "bc_bin_z_score", "row_id", 3).select("bed_featname", "rank_no", "row_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "text", ["doc_id"])


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts read back from their ids."""
    return decode_ids(p6_ids(spark, folder), "ids", ["doc_id"])


def _mix(spark: SparkSession, folder: str) -> Mix:
    sized = encode_texts(table(spark, folder, "documents"), "text", ["doc_id", "source"], count=True)
    return mix_sources(sized, "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).draws


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report


def _function_words(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The common words of each language: a fixed table of a few words a language."""
    out: dict[str, list[str]] = {}
    for r in table(spark, folder, "common_words").where("lang is not null and word is not null").orderBy("lang", "word_rank").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The form of every text, and how far its lines are from prose and from the nearest other structure."""
    return text_forms(table(spark, folder, "documents"), "text", ["doc_id"], _function_words(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_forms(spark, folder).where(F.col("form").isin("list", "table", "junk")).select("doc_id", "form")


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = sorted({w for own in _function_words(spark, folder).values() for w in own})
    return text_counts(table(spark, folder, "documents"), "text", ["doc_id"], words)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_percentiles, p1_day_sketches, p3_found, p6_ids, p6_round_trip, p7_mix, p7_shares, p8_found, p8_forms, p8_counts)
}

ORACLES: dict[str, str] = {
    "p3_found": """
select bed_featname, cast(row_number() over (partition by bed_featname order by bc_bin_z_score desc, row_id) as integer) as rank_no, row_id
from ex1_golden where bed_featname is not null and bc_bin_z_score is not null and not isnan(bc_bin_z_score)
qualify row_number() over (partition by bed_featname order by bc_bin_z_score desc, row_id) <= 3""",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p8_counts": r"""
with common as (select list(distinct word) as known from common_words), t as (
  select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') as words,
    [x for x in regexp_split_to_array(text, '\r\n|\r|\n') if trim(x, ' ' || chr(9)) <> ''] as lines from documents
)
select doc_id, length(text) as n_chars, len(words) as n_words,
  case when len(words) > 0 then length(array_to_string(words, '')) / len(words) end as mean_word_length,
  case when len(words) > 0 then len([w for w in words if list_contains(known, w)]) / len(words) end as common_share,
  case when length(text) > 0 then length(regexp_replace(text, '[\p{L}\p{M}\p{N}\s]+', '', 'g')) / length(text) end as symbol_ratio,
  len(lines) as n_lines,
  case when len(lines) > 0 then len([x for x in lines if regexp_matches(x, '[.!?…。！？]["'')\]»”’]*[ \t]*$')]) / len(lines) end as punctuated_share
from t, common""",
}
