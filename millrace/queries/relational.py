"""Queries of the language's operators over the test tables: a program of the language and the SQL that gives the same rows."""

from __future__ import annotations

import bz2
import gzip
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rows import dense_order
from millrace.plans.engine import Engine
from millrace.queries import Query, table
from millrace.session import shared_dir
from millrace.sources import bam, registry
from millrace.sources.tsv import read_tsv

TABLES = "region nation customer supplier part orders lineitem events documents small ex1_golden conta cancer_genes items".split()


def engine_for(spark: SparkSession, folder: str, program: str, overwrite: bool = False) -> Engine:
    """An engine that knows the test tables that a program names."""
    engine = Engine(spark, overwrite=overwrite)
    for name in TABLES:
        if re.search(rf"\b{name}\b", program):
            engine.set_global(name, table(spark, folder, name))
    return engine


def run(program: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return engine_for(spark, folder, program).eval_text(program)

    return query


PROGRAMS: dict[str, tuple[str, str | None]] = {
    # -------------------------------------------------------------- projection and selection
    "map_project": (
        "lineitem | map({&l_orderkey, &l_linenumber, revenue: &l_extendedprice * (1.0 - &l_discount)})",
        "select l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) as revenue from lineitem",
    ),
    "filter_conjunction": (
        "lineitem | filter(&l_quantity > 45.0 && &l_returnflag == `R`) | map({&l_orderkey, &l_partkey, &l_quantity})",
        "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45 and l_returnflag = 'R'",
    ),
    "map_with_filter": (
        "events | map({&event_id, v: &value * 2.0}, filter:=&event_type == `click` || &event_type == `view`)",
        "select event_id, value * 2.0 as v from events where event_type in ('click', 'view')",
    ),
    "filter_with_map": (
        "orders | filter(&o_orderdate >= 1997-01-01T00:00:00Z, map:={&o_orderkey, &o_custkey}, shards:=4)",
        "select o_orderkey, o_custkey from orders where o_orderdate >= timestamp '1997-01-01'",
    ),
    "map_several_outputs": (
        "nation | map({k: &n_nationkey, t: &n_name}, {k: &n_regionkey + 1000, t: &n_name + `!`})",
        "select n_nationkey as k, n_name as t from nation union all select n_regionkey + 1000, n_name || '!' from nation",
    ),
    "filter_missing_is_greatest": (
        "conta | filter(&depth > 100) | map({&row_id, &depth, last: isnull(&depth)})",
        "select row_id, depth, depth is null as last from conta where depth > 100 or depth is null",
    ),
    "missing_predicates": (
        """small | map({&row_id, e: &gc == NA, n: &gc != 5, g: &gc > &count, h: &gc >= &count, l: &gc < &count,
           a: &gc ==? &count, b: &gc ?== &count, c: &gc ?==? &count, x: max(&gc, &count), y: min(&gc, &count), i: int(&gc), f: float(&count)})""",
        """select row_id, gc is null as e, gc is distinct from 5 as n, coalesce(gc > count, gc is null and count is not null) as g, coalesce(gc >= count, gc is null) as h,
           coalesce(count > gc, count is null and gc is not null) as l, gc is not null and (count is null or gc = count) as a,
           count is not null and (gc is null or gc = count) as b, gc is null or count is null or gc = count as c,
           case when gc is not null and count is not null then greatest(gc, count) end as x, least(gc, count) as y, coalesce(gc, 0) as i, cast(coalesce(count, 0) as double) as f from small""",
    ),
    "row_fields_by_pattern": ("supplier | map({/^s_(name|nationkey)$/})", "select s_name, s_nationkey from supplier"),
    "row_functions": (
        "region | map(unionrow({&r_name, &r_regionkey}, {r_regionkey: &r_regionkey + 1, o: optionalfield(_, nope, default:=12), c: contains(_, `r_name`)}))",
        "select r_name, r_regionkey + 1 as r_regionkey, 12 as o, true as c from region",
    ),
    "conditional": (
        "customer | map({&c_custkey, level: if &c_acctbal > 5000.0 `high` else if &c_acctbal > 0.0 `some` else `none`, d: cond(&c_custkey % 2 == 0, 1, 0)})",
        "select c_custkey, case when c_acctbal > 5000 then 'high' when c_acctbal > 0 then 'some' else 'none' end as level, case when c_custkey % 2 = 0 then 1 else 0 end as d from customer",
    ),
    "functions_and_blocks": (
        "func scaled(x, by) {y := x * by; y + 1.0}; twice := |f, x| f(f(x, 2.0), 2.0); part | map({&p_partkey, v: twice(scaled, &p_retailprice)})",
        "select p_partkey, (p_retailprice * 2.0 + 1.0) * 2.0 + 1.0 as v from part",
    ),
    # -------------------------------------------------------------- order
    "firstn_of_sorted": (
        "orders | sort({-&o_totalprice, &o_orderkey}) | firstn(25)",
        "select * from orders order by o_totalprice desc, o_orderkey limit 25",
    ),
    "minn_smallest": ("orders | minn(40, {&o_totalprice, &o_orderkey})", "select * from orders order by o_totalprice, o_orderkey limit 40"),
    "minn_descending_strings": (
        "part | minn(30, {-&p_brand, &p_name, &p_partkey}) | map({&p_brand, &p_name, &p_partkey})",
        "select p_brand, p_name, p_partkey from part order by p_brand desc, p_name, p_partkey limit 30",
    ),
    "minn_missing_first": (
        "conta | minn(50, {-&cf, &row_id}) | map({&row_id, &cf})",
        "select row_id, cf from conta order by cf desc nulls first, row_id limit 50",
    ),
    "pick_first": (
        "table(orders | sort(&o_orderkey) | pick(&o_totalprice > 100000.0))",
        "select * from orders where o_totalprice > 100000 order by o_orderkey limit 1",
    ),
    "count_rows": (
        "table({n: lineitem | filter(&l_discount > 0.05) | count(), all: count(lineitem)})",
        "select count(*) filter (l_discount > 0.05) as n, count(*) as \"all\" from lineitem",
    ),
    # -------------------------------------------------------------- folds and groups
    "reduce_sum": (
        "lineitem | reduce(&l_returnflag, |a,b| a+b, map:=int(&l_quantity)) | map({&key, &value})",
        "select l_returnflag as key, sum(cast(l_quantity as bigint)) as value from lineitem group by 1",
    ),
    "reduce_count": ("events | reduce(&event_type, _acc+_val, map:=1)", "select event_type as key, count(*) as value from events group by 1"),
    "reduce_greatest": (
        "conta | reduce(&instrument, |a,b| max(a,b), map:=&depth)",
        "select instrument as key, case when count(*) = count(depth) then max(depth) end as value from conta group by 1",
    ),
    "reduce_struct_key": (
        "lineitem | reduce({&l_returnflag, &l_linestatus}, |a,b| min(a,b), map:=&l_extendedprice) | map({key.l_returnflag, key.l_linestatus, &value}, row:=_)"
        .replace("key.", "_.key."),
        "select l_returnflag, l_linestatus, min(l_extendedprice) as value from lineitem group by 1, 2",
    ),
    "reduce_struct_values": (
        "orders | reduce(&o_custkey, |a,b| {n: a.n+b.n, most: max(a.most,b.most), open: a.open||b.open}, map:={n: 1, most: &o_totalprice, open: &o_orderstatus == `O`}) | map({&key, _.value.n, _.value.most, _.value.open})",
        "select o_custkey as key, count(*) as n, max(o_totalprice) as most, bool_or(o_orderstatus = 'O') as open from orders group by 1",
    ),
    "reduce_own_fold": (
        "events | reduce(&user_id, |a,b| if a.v > b.v || (a.v == b.v && a.id < b.id) a else b, map:={v: &value, id: &event_id}) | map({&key, _.value.id})",
        "select user_id as key, (list(event_id order by value desc, event_id))[1] as id from events group by 1",
    ),
    "reduce_everything": (
        "table((orders | reduce(0, _acc+_val, map:=int(&o_totalprice)) | pick(true)).value) | map({total: _})",
        "select sum(trunc(o_totalprice)::bigint) as total from orders",
    ),
    "cogroup_count": (
        "lineitem | cogroup({&l_returnflag}) | map({_.key.l_returnflag, n: count(&value)})",
        "select l_returnflag, count(*) as n from lineitem group by 1",
    ),
    "cogroup_nested": (
        """orders | cogroup(&o_custkey, map:={&o_orderkey, &o_totalprice}) | map({&key, n: count(&value), big: &value | filter(|o| o.o_totalprice > 100000.0) | count(),
           best: (sort(&value, {-&o_totalprice, &o_orderkey}) | pick(true)).o_orderkey})""",
        """select o_custkey as key, count(*) as n, count(*) filter (o_totalprice > 100000) as big, (list(o_orderkey order by o_totalprice desc, o_orderkey))[1] as best
           from orders group by 1""",
    ),
    "cogroup_flatten": (
        "events | cogroup(&event_type) | map(&value | map(|e| {e.event_id, e.event_type})) | flatten()",
        "select event_id, event_type from events",
    ),
    # -------------------------------------------------------------- joins
    "join_inner": (
        "join({o: orders, c: customer}, o.o_custkey == c.c_custkey, map:={o.o_orderkey, c.c_name})",
        "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    ),
    "join_inner_missing_equal": (
        "A := customer | map({&c_custkey, k: if &c_nationkey < 3 NA else &c_nationkey}); B := nation | map({&n_name, k: if &n_nationkey < 5 NA else &n_nationkey}); join({a: A, b: B}, a.k == b.k, map:={a.c_custkey, b.n_name})",
        """select c_custkey, n_name from customer join nation on
           (case when c_nationkey >= 3 then c_nationkey end) is not distinct from (case when n_nationkey >= 5 then n_nationkey end)""",
    ),
    "join_left": (
        "A := nation | map({&n_name, k: if &n_nationkey > 20 NA else &n_nationkey}); B := supplier | filter(&s_nationkey % 2 == 0); join({a: A, b: B}, a.k ==? b.s_nationkey, map:={a.n_name, b.s_name})",
        "select n_name, s_name from nation left join (select * from supplier where s_nationkey % 2 = 0) on n_nationkey = s_nationkey where n_nationkey <= 20",
    ),
    "join_right": (
        "A := nation | filter(&n_regionkey == 1); join({a: A, b: supplier}, a.n_nationkey ?== b.s_nationkey, map:={a.n_name, b.s_name})",
        "select n_name, s_name from (select * from nation where n_regionkey = 1) right join supplier on n_nationkey = s_nationkey",
    ),
    "join_full": (
        "A := nation | filter(&n_nationkey < 15) | map({&n_name, k: &n_nationkey}); B := supplier | map({&s_name, k: if &s_nationkey < 3 NA else &s_nationkey}); join({a: A, b: B}, a.k ?==? b.k, map:={a.n_name, b.s_name})",
        "select n_name, s_name from (select * from nation where n_nationkey < 15) full join (select s_name, case when s_nationkey >= 3 then s_nationkey end as k from supplier) on n_nationkey = k",
    ),
    "join_anti": (
        "join({a: nation, b: supplier | filter(&s_acctbal > 5000.0)}, a.n_nationkey ==? b.s_nationkey && isnull(b.s_suppkey), map:={a.n_name})",
        "select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)",
    ),
    "join_anti_by_key": (
        "join({a: customer, b: orders | filter(&o_totalprice > 300000.0)}, a.c_custkey ==? b.o_custkey && isnull(b.o_custkey), map:={a.c_custkey, b.o_orderkey})",
        "select c_custkey, null as o_orderkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)",
    ),
    "join_three": (
        "join({c: customer, n: nation, r: region}, c.c_nationkey == n.n_nationkey && n.n_regionkey == r.r_regionkey && c.c_acctbal > 1000.0, map:={c.c_custkey, n.n_name, r.r_name})",
        "select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and c_acctbal > 1000",
    ),
    "join_four": (
        "join({l: lineitem, o: orders, c: customer, n: nation}, l.l_orderkey == o.o_orderkey && o.o_custkey == c.c_custkey && c.c_nationkey == n.n_nationkey, map:={n.n_name, v: l.l_quantity}) | reduce(&n_name, |a,b| a+b, map:=int(&v))",
        "select n_name as key, sum(l_quantity::bigint) as value from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey group by 1",
    ),
    "join_theta": (
        "join({a: nation, b: region}, a.n_regionkey < b.r_regionkey, map:={a.n_name, b.r_name})",
        "select n_name, r_name from nation, region where n_regionkey < r_regionkey",
    ),
    "join_self_all_columns": (
        "join({x: region, y: region}, x.r_regionkey == y.r_regionkey)",
        "select x.r_regionkey as x_r_regionkey, x.r_name as x_r_name, y.r_regionkey as y_r_regionkey, y.r_name as y_r_name from region x join region y using (r_regionkey)",
    ),
    "join_chained_outer": (
        "join({r: region, n: nation | filter(&n_nationkey < 12), s: supplier}, r.r_regionkey ==? n.n_regionkey && n.n_nationkey ==? s.s_nationkey, map:={r.r_name, n.n_name, s.s_suppkey})",
        "select r_name, n_name, s_suppkey from region join (select * from nation where n_nationkey < 12) on r_regionkey = n_regionkey left join supplier on n_nationkey = s_nationkey",
    ),
    "interval_join_rows": (
        "small | joinbed(cancer_genes) | map({&row_id})",
        'select row_id from small s where s."end" > s.start and exists (select 1 from cancer_genes g where g.chrom = s.chrom and g.start < s."end" and g."end" > s.start and g."end" > g.start)',
    ),
    "interval_join_features": (
        "ex1_golden | joinbed(cancer_genes, chrom:=&bed_chrom, start:=&bed_start, end:=&bed_end, map:=|r,feat| {r.row_id, feat.featname})",
        'select distinct row_id, featname from ex1_golden e join cancer_genes g on g.chrom = e.bed_chrom and g.start < e.bed_end and g."end" > e.bed_start and g."end" > g.start where e.bed_end > e.bed_start',
    ),
    # -------------------------------------------------------------- unions and reshaping
    "concat_tables": (
        "concat(region | map({k: &r_regionkey, t: &r_name}), nation | map({k: &n_nationkey, u: &n_name}))",
        "select r_regionkey as k, r_name as t, null as u from region union all select n_nationkey, null, n_name from nation",
    ),
    "flatten_tables": (
        "table(nation | filter(&n_regionkey == 0), nation | filter(&n_regionkey == 2)) | flatten(subshard:=true)",
        "select * from nation where n_regionkey in (0, 2)",
    ),
    "gather_columns": (
        "small | map({&row_id, &gc, &count, &length}) | gather(`gc`, `count`, `length`, key:=`measure`, value:=`v`)",
        "select row_id, 'gc' as measure, gc as v from small union all select row_id, 'count', count from small union all select row_id, 'length', length from small",
    ),
    "spread_column": (
        "nation | spread(key:=`n_regionkey`, value:=`n_name`)",
        "select n_nationkey, " + ", ".join(f'case when n_regionkey = {i} then n_name end as "{i}"' for i in range(5)) + " from nation",
    ),
    "gather_spread_collapse": (
        "supplier | map({&s_suppkey, &s_nationkey, &s_acctbal}) | gather(`s_nationkey`, `s_acctbal`, key:=`k`, value:=`v`) | spread(key:=`k`, value:=`v`) | collapse(`s_nationkey`, `s_acctbal`)",
        "select s_suppkey, cast(s_nationkey as double) as s_nationkey, s_acctbal from supplier",
    ),
    "transpose_cells": (
        "nation | cogroup({&n_regionkey}, map:={p: &n_nationkey % 3, n: 1}) | map({&key, value: reduce(&value, &p, |a,b| a+b, map:=&n)}) | transpose({_.key.n_regionkey}, {n: &key, &value})",
        "select n_regionkey, nullif(count(*) filter (n_nationkey % 3 = 0), 0) as \"0\", nullif(count(*) filter (n_nationkey % 3 = 1), 0) as \"1\", nullif(count(*) filter (n_nationkey % 3 = 2), 0) as \"2\" from nation group by 1",
    ),
    # -------------------------------------------------------------- scalar functions
    "string_functions": (
        r"""documents | map({&doc_id, bytes: string_len(string(&text)), part: substring(string(&lang) + `-----`, 1, 4), r: string_replace(string(&lang), `e`, `_`), p: string_has_prefix(string(&lang), `e`),
           s: string_has_suffix(string(&lang), `s`), c: string_count(string(&text), `e`), m: regexp_match(string(&text), `[0-9]+ (weeks|days)`), t: `<` + string(&lang) + `>`})""",
        r"""select doc_id, strlen(coalesce(text, '')) as bytes, (coalesce(lang, '') || '-----')[2:4] as part, replace(coalesce(lang, ''), 'e', '_') as r,
           starts_with(coalesce(lang, ''), 'e') as p, ends_with(coalesce(lang, ''), 's') as s, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) as c,
           regexp_matches(coalesce(text, ''), '[0-9]+ (weeks|days)') as m, '<' || coalesce(lang, '') || '>' as t from documents""",
    ),
    "substring_in_bytes": (
        "nation | map({&n_nationkey, a: substring(`äöü-` + &n_name, 2, 4), b: substring(&n_name, 3)})",
        "select n_nationkey, 'ö' as a, n_name[4:] as b from nation",
    ),
    "regexp_replace_groups": (
        r"customer | map({&c_custkey, a: regexp_replace(&c_name, `^([A-Za-z]+)#0*([0-9]+)$`, `${2}:${1}x`), b: regexp_replace(&c_name, `[0-9]`, `$1y`)})",
        r"select c_custkey, regexp_replace(c_name, '^([A-Za-z]+)#0*([0-9]+)$', '\2:\1x') as a, regexp_replace(c_name, '[0-9]', '', 'g') as b from customer",
    ),
    "formatting": (
        "orders | map({&o_orderkey, a: sprintf(`%d|%s|%.2f|%v`, &o_orderkey, &o_orderpriority, &o_totalprice, &o_custkey), b: string(&o_custkey), c: string(&o_orderkey % 5 == 0)})",
        "select o_orderkey, printf('%d|%s|%.2f|%d', o_orderkey, o_orderpriority, o_totalprice, o_custkey) as a, o_custkey::varchar as b, (o_orderkey % 5 = 0)::varchar as c from orders",
    ),
    "arithmetic": (
        "lineitem | map({&l_orderkey, &l_linenumber, a: &l_partkey / 7, b: &l_partkey % 7, c: -&l_linenumber, d: &l_tax / &l_quantity, e: int(&l_extendedprice), f: float(&l_partkey) * 0.5, g: &l_suppkey - &l_partkey})",
        "select l_orderkey, l_linenumber, l_partkey // 7 as a, l_partkey % 7 as b, -l_linenumber as c, l_tax / l_quantity as d, trunc(l_extendedprice)::bigint as e, l_partkey * 0.5::double as f, l_suppkey - l_partkey as g from lineitem",
    ),
    "bits": (
        "part | map({&p_partkey, a: land(&p_partkey, 0xff), o: lor(&p_partkey, 0x10), s: isset(&p_partkey, 3)})",
        "select p_partkey, p_partkey & 255 as a, p_partkey | 16 as o, (p_partkey & 3) = 3 as s from part",
    ),
    "dates_and_durations": (
        "orders | map({&o_orderkey, late: &o_orderdate > 1996-06-01T00:00:00Z, day: &o_orderdate >= 1997-01-01T00:00:00Z && &o_orderdate < 1998-01-01T00:00:00Z, sec: int(&o_orderdate), span: int(3h + 1s) / 1000000, longer: 3h1s > 3h})",
        "select o_orderkey, o_orderdate > timestamp '1996-06-01' as late, o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' as day, epoch(o_orderdate)::bigint as sec, 10801000::bigint as span, true as longer from orders",
    ),
    "hash_sample": ("events | sample(10) | map({&event_id})", None),
    "hash_and_sample": (
        "table({whole: events | sample(1) | count(), off: (events | sample(10) | count()) - (events | filter(hash64(_) % 10 == 0) | count()), odd: events | filter(hash64(&event_id) < 0 || hash64(&event_id) != hash64(&event_id)) | count()})",
        "select count(*) as whole, 0 as off, 0 as odd from events",
    ),
    "hash_of_keys": ("orders | reduce(hash64(&o_custkey), _acc+_val, map:=1) | map({n: &value})", "select count(*) as n from orders group by o_custkey"),
    "kinds_of_values": (
        "nation | map({&n_nationkey, s: isstruct(_), t: isstruct(&n_name), u: istable(_), v: isstruct({k: &n_name}), w: istable(table(1, 2))})",
        "select n_nationkey, true as s, false as t, false as u, true as v, true as w from nation",
    ),
    "base_names": ("supplier | map({&s_suppkey, b: basename(`/x/` + &s_name + `/y.` + string(&s_suppkey))})", "select s_suppkey, 'y.' || s_suppkey as b from supplier"),
    "dollar_columns": ("nation | map({k: $n_nationkey + 1, $n_name})", "select n_nationkey + 1 as k, n_name from nation"),
    "forced_table": (
        "big := force(orders | filter(&o_totalprice > 200000.0)); table({n: count(big), m: big | filter(&o_orderstatus == `F`) | count()})",
        "select count(*) as n, count(*) filter (o_orderstatus = 'F') as m from orders where o_totalprice > 200000",
    ),
    "nan_in_filters": (
        "small | filter(&density > 0.002) | map({&row_id, le: &density <= 0.5})",
        "select row_id, not isnan(density) and density <= 0.5 and density is not null as le from small where density is null or (density > 0.002 and not isnan(density))",
    ),
    "cogroup_fused": (
        """lineitem | cogroup(&l_returnflag, map:={&l_orderkey, &l_linenumber, &l_quantity}) | map({&key, last: (sort(&value, {-&l_orderkey, -&l_linenumber}) | pick(true)).l_orderkey,
           total: (reduce(&value, 0, |a,b| a+b, map:=int(&l_quantity)) | pick(true)).value, few: &value | filter(&l_quantity < 5.0) | count(), least: (sort(&value | filter(&l_quantity > 10.0), &l_orderkey) | pick(true)).l_orderkey})""",
        """select l_returnflag as key, max(l_orderkey) as last, sum(l_quantity::bigint) as total, count(*) filter (l_quantity < 5) as few, min(l_orderkey) filter (l_quantity > 10) as least
           from lineitem group by 1""",
    ),
    "join_three_missing": (
        """A := nation | map({&n_name, k: if &n_nationkey < 4 NA else &n_nationkey}); B := supplier | map({&s_suppkey, k: &s_nationkey, r: if &s_suppkey % 7 == 0 NA else &s_nationkey % 5}); C := region | map({&r_name, r: &r_regionkey});
           join({a: A, b: B, c: C}, a.k == b.k && b.r == c.r, map:={a.n_name, b.s_suppkey, c.r_name})""",
        """with a as (select n_name, case when n_nationkey >= 4 then n_nationkey end as k from nation),
           b as (select s_suppkey, s_nationkey as k, case when s_suppkey % 7 <> 0 then s_nationkey % 5 end as r from supplier),
           m as (select n_name, a.k as ak, b.k as bk, s_suppkey, r from a full join b on a.k is not distinct from b.k)
           select n_name, s_suppkey, r_name from m full join region on r is not distinct from r_regionkey where ak is not distinct from bk and r is not distinct from r_regionkey""",
    ),
    "interval_join_length": (
        "small | joinbed(cancer_genes, chrom:=&chrom, start:=&start, length:=&end - &start, map:=|r,feat| {r.row_id, feat.start})",
        'select distinct row_id, g.start from small s join cancer_genes g on g.chrom = s.chrom and g.start < s."end" and g."end" > s.start and g."end" > g.start where s."end" > s.start',
    ),
    "interval_join_endless": (
        "table({chrom: `chr1`, start: 0, end: 4611686018427387904}, {chrom: `chr2`, start: -5, end: 9}) | joinbed(cancer_genes, map:=|r,feat| {r.end, feat.start})",
        'select distinct 4611686018427387904 as "end", start from cancer_genes where chrom = \'chr1\' and "end" > greatest(start, 0) union select 9, start from cancer_genes where chrom = \'chr2\' and start < 9 and "end" > start',
    ),
    "collapse_pairs": (
        "concat(orders | map({k: &o_orderkey, a: &o_custkey, b: NA}), orders | map({k: &o_orderkey, a: NA, b: &o_orderstatus})) | sort(&k) | collapse(`a`, `b`)",
        "select o_orderkey as k, o_custkey as a, o_orderstatus as b from orders",
    ),
    "reshaping_in_cells": (
        "nation | cogroup(&n_regionkey, map:={&n_name, &n_nationkey, twice: &n_nationkey * 2}) | map({&key, t: &value | gather(`n_nationkey`, `twice`, key:=`what`, value:=`v`) | filter(&v > 20)}) | map(&t) | flatten()",
        "select n_name, 'n_nationkey' as what, n_nationkey as v from nation where n_nationkey > 20 union all select n_name, 'twice', n_nationkey * 2 from nation where n_nationkey > 10",
    ),
}


def tsv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as a tab-separated table, and read again with voted types."""
    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}.tsv"
    program = f"write(customer | map({{&c_custkey, &c_name, &c_acctbal, d: if &c_custkey % 3 == 0 NA else &c_nationkey}}), `{path}`, shards:=3)"
    engine_for(spark, folder, program).run(program)
    return Engine(spark).eval_text(f"read(`{path}`)")


def bed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/bed-{uuid.uuid4().hex}.bed"
    program = f"write(cancer_genes, `{path}`)"
    engine_for(spark, folder, program).run(program)
    return Engine(spark).eval_text(f"read(`{path}`)")


def native_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested tables written in the native format, and read again."""
    path = f"{shared_dir(spark)}/native-{uuid.uuid4().hex}.btsv"
    program = f"write(nation | cogroup(&n_regionkey), `{path}`, shards:=2)"
    engine_for(spark, folder, program).run(program)
    return Engine(spark).eval_text(f"read(`{path}`) | map(&value) | flatten()")


def column_files(spark: SparkSession, folder: str) -> DataFrame:
    """One table for each column; all of them read again."""
    path = f"{shared_dir(spark)}/cols-{uuid.uuid4().hex}"
    program = f"writecols(nation, `{path}/{{{{.Name}}}}-{{{{.Number}}}}.tsv`)"
    engine_for(spark, folder, program).run(program)
    names = ("n_nationkey", "n_name", "n_regionkey")
    return Engine(spark).eval_text("concat(" + ", ".join(f"read(`{path}/{n}-{i}.tsv`)" for i, n in enumerate(names)) + ")")


FILES = {f.__name__: f for f in (tsv_roundtrip, bed_roundtrip, native_roundtrip, column_files)}
QUERIES: dict[str, Query] = {name: run(program) for name, (program, _) in PROGRAMS.items()} | FILES
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PROGRAMS.items() if sql} | {
    "tsv_roundtrip": "select c_custkey, c_name, c_acctbal, case when c_custkey % 3 <> 0 then c_nationkey end as d from customer",
    "bed_roundtrip": "select * from cancer_genes",
    "native_roundtrip": "select * from nation",
    "column_files": "select n_nationkey, null as n_name, null as n_regionkey from nation union all select null, n_name, null from nation union all select null, null, n_regionkey from nation",
}


def sort_all(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted, with the place of each row."""
    program = "nation | sort({&n_regionkey, -&n_name})"
    return dense_order(engine_for(spark, folder, program).eval_text(program), "place")


def printed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What ``print`` shows, line by line."""
    program = "print(customer | map({&c_custkey, &c_name}))"
    engine = engine_for(spark, folder, program)
    engine.out = (lines := []).append
    engine.run(program)
    return spark.createDataFrame([(x,) for x in lines], "line string")


def files_in_a_folder(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/dir-{uuid.uuid4().hex}"
    for name in ("a.tsv", "sub/b.x.bed"):
        registry.put(spark, f"{path}/{name}", b"k\n1\n")
    return Engine(spark).eval_text(f"d := readdir(`{path}`); table({{a: contains(d, `a_tsv`), b: basename(d.sub_b_x_bed), c: contains(d, `b`), n: read(d.a_tsv) | count()}})")


def attributes_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark).eval_text(f"T := read(`{folder}/nation.parquet`); table({{n: table_attrs(T).name, p: basename(table_attrs(T).path)}})")


def loaded_functions(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lib-{uuid.uuid4().hex}"
    registry.put(spark, f"{path}/more.q", b"func twice(x) x * 2")
    registry.put(spark, f"{path}/lib.q", b"load `more.q`; func eight(x) twice(twice(twice(x)))")
    program = f"load `{path}/lib.q`; nation | map({{k: eight(&n_nationkey)}})"
    return engine_for(spark, folder, program).eval_text(program)


def own_functions_and_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A function of Python and a format of one's own, used by a program."""
    registry.register("ids", r"\.ids$", lambda s, path: s.range(int(path.rpartition("/")[2].split(".")[0])))
    engine = Engine(spark)
    engine.register("shouted", lambda x: F.upper(x), "string")
    return engine.eval_text("read(`12.ids`) | map({&id, t: shouted(`n` + string(&id))})")


def tables_by_path(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that are cells, each read as a table."""
    return Engine(spark).eval_text(f"table({{p: `{folder}/nation.parquet`}}, {{p: `{folder}/nation.parquet`}}) | map(read(&p)) | flatten()")


def _compressed(end: str, pack: Callable[[bytes], bytes]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """A compressed table, one of whose lines is like the header."""
        rows = table(spark, folder, "nation").orderBy("n_nationkey").collect()
        lines = ["name\tregion", "name\tregion", "# a note", *(f"{r.n_name}\t{r.n_regionkey}" for r in rows)]
        path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}.tsv{end}"
        registry.put(spark, path, pack(("\n".join(lines) + "\n").encode()))
        return read_tsv(spark, path, {"name": "string", "region": "string"})

    return query


def _zst(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment files made of the orders by the tasks that have them, in many blocks, each read by several tasks."""
    reads = table(spark, folder, "orders").orderBy("o_orderkey").select(F.concat(F.lit("r"), "o_orderkey"), F.lit(0), "o_custkey", F.expr("substring('ACGT', 1, 1 + o_custkey % 4)"))
    found = bam.write_packed(reads, f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}", [("chr1", 10**9)], block=4_000)
    return bam.read_alignments(spark, found, split=16_384).select("name", "reference", "pos", "cigar", "seq")


FILES |= {f.__name__: f for f in (sort_all, printed_rows, files_in_a_folder, attributes_of_tables, loaded_functions, own_functions_and_formats, tables_by_path, alignments)}
FILES |= {f"tsv_{end}_lines": _compressed(f".{end}", pack) for end, pack in (("gz", gzip.compress), ("bz2", bz2.compress), ("zst", _zst))}
QUERIES |= FILES
ORACLES |= {f"tsv_{end}_lines": "select 'name' as name, 'region' as region union all select n_name, n_regionkey::varchar from nation" for end in ("gz", "bz2", "zst")} | {
    "sort_all": "select *, row_number() over (order by n_regionkey, n_name desc) - 1 as place from nation",
    "printed_rows": "select '{c_custkey:' || c_custkey || ',c_name:' || c_name || '}' as line from customer",
    "files_in_a_folder": "select true as a, 'b.x.bed' as b, false as c, 1 as n",
    "attributes_of_tables": "select 'parquet' as n, 'nation.parquet' as p",
    "loaded_functions": "select n_nationkey * 8 as k from nation",
    "own_functions_and_formats": "select range as id, 'N' || range as t from range(12)",
    "tables_by_path": "select * from nation union all select * from nation",
    "alignments": "select 'r' || o_orderkey as name, 'chr1' as reference, o_custkey + 1 as pos, (1 + o_custkey % 4) || 'M' as cigar, 'ACGT'[1:1 + o_custkey % 4] as seq from orders",
}


def stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A program over a stream of the events' file: filter, project and fold, with all state kept."""
    from millrace.streaming.programs import drain, over_stream

    name = f"events_{uuid.uuid4().hex}"
    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = over_stream(Engine(spark), "stream", source, "stream | filter(&value > 10.0) | reduce(&event_type, |a,b| a+b, map:=1)")
    drain(out, name, f"{shared_dir(spark)}/{name}", "complete")
    return spark.table(name)


QUERIES["stream_fold"] = stream_fold
ORACLES["stream_fold"] = "select event_type as key, count(*) as value from events where value > 10 or value is null group by 1"
