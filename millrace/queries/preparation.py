"""Queries of the general data-preparation operators: line parsing, periods and gaps, load profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.line_parsing import NA_SPELLINGS, ParsedLines, lab_rules, parse_lines
from millrace.operators.load_profile import load_changes, load_findings, profile_loads
from millrace.operators.periods import periods_and_gaps
from millrace.queries import Query, table

RANGES = {"cf": (0, 1), "depth": (1, 100_000), "error_rate": (0, 1)}
PATTERNS = {"sample": r"\AP[A-Z0-9]{6}\z"}


def _parsed(spark: SparkSession, folder: str) -> ParsedLines:
    return parse_lines(table(spark, folder, "raw_lines"), lab_rules(), "raw_id", "table_name", "line", skip=F.col("line_no") == 1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).rejected.select(F.col("line_id").alias("raw_id"), "reason")


def p2_typed_small(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).typed("small").withColumnRenamed("line_id", "raw_id")


def p2_typed_conta(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).typed("conta").withColumnRenamed("line_id", "raw_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    small, golden = table(spark, folder, "small"), table(spark, folder, "ex1_golden")
    both = small.select(F.lit("small").alias("source_table"), "run_id", "chrom", "start", "end").unionByName(
        golden.select(F.lit("ex1_golden").alias("source_table"), "run_id", F.col("bed_chrom").alias("chrom"), F.col("bed_start").alias("start"), F.col("bed_end").alias("end"))
    )
    return periods_and_gaps(both, ["source_table", "run_id", "chrom"], "start", "end")


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile_loads(table(spark, folder, "conta"), "instrument", "load_no", "row_id", RANGES, PATTERNS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_findings(p5_profile(spark, folder), "instrument", "load_no").select("instrument", "load_no", "column_name", "finding")


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What the classifier sees, whatever the rules of the findings say."""
    return load_changes(p5_profile(spark, folder), "instrument", "load_no")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_typed_small, p2_typed_conta, p4_found, p5_found, p5_profile, p5_changes)}

_FIELD = r'("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINES = rf"""
with lines as (
  select raw_id, table_name, regexp_replace(line, '\r\z', '') as line from raw_lines
  where line_no <> 1 and table_name in ('small', 'conta')
), split as (
  select raw_id, table_name, case table_name when 'small' then 7 else 26 end as width,
    regexp_full_match(line, '{_FIELD}(\t{_FIELD})*', 's') as whole,
    regexp_extract_all(line || chr(9), '{_FIELD}\t', 1, 's') as fields
  from lines where not starts_with(line, '#') and regexp_matches(line, '[^ ]', 's')
), cells as (
  select raw_id, table_name, unnest(fields) as field, generate_subscripts(fields, 1) as pos
  from split where whole and len(fields) = width
), read as (
  select raw_id, table_name, pos,
    trim(case when field[1] = '"' then replace(field[2:-2], '""', '"') else field end, ' ') as v,
    case when table_name = 'small' then case pos when 1 then 'name' when 7 then 'double' else 'int' end
      else case when pos = 1 then 'sample' when pos = 2 then 'bool' when pos = 12 then 'any' when pos in (6, 7, 13) then 'int' else 'double' end end as kind,
    pos > 3 or (table_name = 'conta' and pos > 1) as may_be_na
  from cells
), bad as (
  select raw_id, table_name, pos, v from read where not (
    (may_be_na and v in ({", ".join(f"'{x}'" for x in NA_SPELLINGS)})) or
    case kind when 'name' then v <> '' when 'any' then true
      when 'sample' then regexp_full_match(v, 'P[A-Z0-9]{{6}}')
      when 'bool' then lower(v) in ('true', 'false')
      when 'int' then regexp_full_match(v, '[0-9]+') and coalesce(try_cast(v as hugeint) <= 9223372036854775807, false)
      else regexp_full_match(v, '-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?') end)
)"""


def _typed_sql(name: str) -> str:
    out = []
    for i, r in enumerate(lab_rules()[name], 1):
        value = f"max(v) filter (pos = {i})"
        kind = {"int": "bigint", "double": "double", "bool": "boolean"}.get(r.kind, "varchar")
        if r.nullable:
            value = f"case when {value} not in ({', '.join(repr(x) for x in NA_SPELLINGS)}) then {value} end"
        out.append(f'cast({value} as {kind}) as "{r.column}"')
    return f"{_LINES} select raw_id, {', '.join(out)} from read where table_name = '{name}' and raw_id not in (select raw_id from bad) group by raw_id"


def _measured() -> str:
    cells = " union all ".join(f"select instrument, load_no, '{c}' as column_name, case when isnan({c}) then null else {c} end as v, {lo} as lo, {hi} as hi from conta" for c, (lo, hi) in RANGES.items())
    return f"""
with cells as ({cells}), measured as (
  select instrument, load_no, column_name, count(*) as n, count(v) as k, count(distinct v) as d,
    median(v) filter (v between lo and hi) as mid, count(*) filter (v not between lo and hi) as outside
  from cells group by all
), pairs as (
  select a.*, p.n as pn, p.k as pk, p.d as pd, p.mid as pmid from measured a
  left join measured p on a.instrument = p.instrument and a.column_name = p.column_name and a.load_no = p.load_no + 1
)"""


ORACLES: dict[str, str] = {
    "p2_found": _LINES
    + """ select raw_id, 'quoting' as reason from split where not whole
      union all select raw_id, 'column_count' from split where whole and len(fields) <> width
      union all select distinct raw_id, 'value' from bad""",
    "p2_typed_small": _typed_sql("small"),
    "p2_typed_conta": _typed_sql("conta"),
    "p4_found": """
with rows as (
  select 'small' as source_table, run_id, chrom, "start" as s, "end" as e from small
  union all select 'ex1_golden', run_id, bed_chrom, bed_start, bed_end from ex1_golden
), seen as (
  select *, max(e) over (partition by source_table, run_id, chrom order by s, e rows between unbounded preceding and 1 preceding) as before
  from rows where run_id is not null and chrom is not null and e > s
), islands as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by source_table, run_id, chrom order by s, e rows unbounded preceding) as island from seen
)
select source_table, run_id, chrom, 'period' as kind, min(s) as span_start, max(e) as span_end from islands group by source_table, run_id, chrom, island
union all select source_table, run_id, chrom, 'gap', before, s from islands where s > before""",
    "p5_found": _measured()
    + """
select instrument, load_no, column_name, 'range' as finding from pairs where outside > 0
union all select instrument, load_no, column_name, 'null_rate' from pairs where abs(k / n - pk / pn) > 0.25
union all select instrument, load_no, column_name, 'distinct' from pairs where 4 * d < pd
union all select instrument, load_no, column_name, 'shift' from pairs where mid > 2 * pmid or pmid > 2 * mid
union all select distinct instrument, load_no, 'sample', 'pattern' from conta where not regexp_full_match(sample, 'P[A-Z0-9]{6}')""",
}
