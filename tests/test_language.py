"""Programs of the language and their results."""

from __future__ import annotations

from datetime import timedelta

import pytest

from millrace.plans.engine import Engine, EvalProblem, table_text
from millrace.plans.syntax import SyntaxProblem

BOXES = "Boxes := table({size:4, tag:`oak`}, {size:7, tag:`elm`}, {size:9, tag:`fir`})"


@pytest.fixture
def engine(spark):
    return Engine(spark)


def rows(engine, text, keep_order=True):
    out = [x.replace(",b:NA", "") for x in table_text(engine.eval_text(text))]
    return out if keep_order else sorted(out)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("8 + 31", 39), ("false || true", True), ("false && true", False), ("!false", True), ("77 /* a note */ + 1", 78), ("-42", -42), ("-2.25", -2.25),
        ("2.5e3", 2500.0), ("-2h", timedelta(hours=-2)), ("5h7s250µs", timedelta(hours=5, seconds=7, microseconds=250)), ("2h == 2h0m", True), ("2h == 2h9s", False),
        ("4+int(`6`)", 10), ("4+int(6.9)", 10), ("int('c')+1", 100), ("2+7*4", 30), ("(2+7)*4", 36), ("20-6-5", 9), ("17 / 5", 3), ("-17 / 5", -3), ("17 % 5", 2), ("-9 % 4", -1),
        ("land(0xc, 0x6)", 4), ("lor(0xc, 0x6)", 14), ("int(2s)", 2 * 10**9), ("0.5+float(3)", 3.5), ("9.0 / 4.5", 2.0), ("3.0 / float(4)", 0.75), ("float(90s)", 90.0),
        ("2h+15s", timedelta(hours=2, seconds=15)), ("2h-15s", timedelta(hours=2, seconds=-15)), ("max(5,8,6)*2", 16), ("min(5,8,6)*2", 10), ('max("pa","pan","pc")', "pc"),
        ("max(2h,2h9s)", timedelta(hours=2, seconds=9)), ("max(6,NA)", None), ("min(6,NA)", 6), ("string(907)", "907"), ("string(64.0)", "64"), ("`to` + `ad`", "toad"), ("string(NA)", ""),
        ("int(NA)", 0), ("float(NA)", 0.0), ('sprintf("%s has %d of %.2f", "jar", 12, 2.75)', "jar has 12 of 2.75"), ("isnull(NA)", True), ("isnull(-NA)", True), ("isnull(0)", False),
        ("NA==NA", True), ("NA==-NA", False), ("7==NA", False), ("NA!=7", True), ("NA>7", True), ("7>NA", False), ("NA>NA", False), ("NA>=7", True), ("7>=NA", False), ("7<NA", True),
        ("6>6", False), ("7>6", True), ("7<=6", False), ("`tree`>`tre`", True), ("isset(0x2d, 0xc)", True), ("isset(0xc, 0x2d)", False), ("isset(0x30, 0x10)", True),
        ("NA ==? 5", False), ("5 ==? NA", True), ("5 ==? 5", True), ("5 ==? 6", False), ("NA ?== 5", True), ("5 ?== NA", False), ("5 ?==? NA", True), ("5 ?==? 6", False),
        ("2021-03-04 > 2021-03-03", True), ("2021-03-04 == 2021-03-05", False), ("2021-03-04T23:30:00-0500 == 2021-03-05T04:30:00Z", True),
        ("if 5>4 `up` else `down`", "up"), ("if 4>5 {k:=2; k+k} else {k:=7;k*k}", 49), ("if 4>5 1 else if 4>3 2 else 3", 2), ("cond(4>5, `p`, `q`)", "q"),
        ("string_len(`zürs`)", 5), ('substring("marble", 2, 5)', "rbl"), ('substring("marble", 3)', "ble"), ('substring("marble", 4, 60)', "le"), ("string_replace(`w-o-w`,`-`,`..`)", "w..o..w"),
        ("string_has_prefix(`lantern`,`lan`)", True), ("string_has_suffix(`lantern`,`lan`)", False), ("string_count(`banana`,`an`)", 2), ("string_count(`kiwi`,``)", 5),
        ("regexp_match(`heron`,`e.o`)", True), ("regexp_match(`heron`,`^e`)", False), (r"regexp_replace(`heron`,`(r\S+)`,`<${1}>`)", "he<ron>"), ("regexp_replace(`heron`,`(r)`,`$1z`)", "heon"),
        ("basename(`/var/notes/may.md`)", "may.md"), ("isstruct({w:5})", True), ("istable(table(6))", True), ("isstruct(5)", False), ("contains({w:5},`w`)", True), ("contains({w:5},`h`)", False),
        ("optionalfield({w:5}, w)", 5), ("optionalfield({w:5}, h, default:=-1)", -1), ("optionalfield({w:5}, h)", None), ("hash64(`pear`) >= 0", True), ("2.0/0.0 > 1e300", True),
        ("count(table(8,6,7))", 3), ("table(8,6,7,9) | filter(_>6) | count()", 3), ("table(table(8,6), table(7), table(9)) | flatten() | count()", 4),
        ("pick(table(14,25,36,47), _%9==0)", 36), ("pick(table(14,25), false)", None), ("(|u|u-3)(10)", 7), ("18/3", 6), ("0.0/0.0 > 1.0", False), ("1.0 > 0.0/0.0", False),
    ],
)
def test_values(engine, text, value):
    assert engine.eval_text(text) == value


def test_globals_and_functions(engine):
    engine.run("width := 6 + 4; area := width * 7")
    assert engine.eval_text("area - 1") == 69
    engine.run("func cube(n) n*n*n; half := func(n) {n/2}; mix := |p,q|{both:=p-q; both*10}; scale := 3; grown := func(n) { scale := scale + n; scale * 2 }")
    assert [engine.eval_text(t) for t in ("cube(3)", "half(9)", "mix(7,4)", "grown(4)", "scale")] == [27, 4, 30, 14, 3]
    engine.run("Pets := table({kind:`cat`, legs:4}); func legs_of(pet) pet.legs")
    assert engine.eval_text("legs_of(pick(Pets,true))") == 4
    engine.run("adder := func(by) {func(n) { n + by }}; plus_five := adder(5)")
    assert rows(engine, "table(10,20) | map(plus_five(_), shards:=2)") == ["15", "25"]


def test_structs(engine):
    engine.run("depth := 3; Well := {top: 90, rim: 12}; Map := {north1:5,north2:6,south1:`sea`}")
    assert engine.eval_text("{depth,Well.rim,7}").asDict() == {"depth": 3, "rim": 12, "f2": 7}
    assert engine.eval_text("{Map./.*1$/}").asDict() == {"north1": 5, "south1": "sea"}
    assert rows(engine, "table(Map) | map({/north/})") == ["{north1:5,north2:6}"]
    assert engine.eval_text("unionrow({p:1,q:2}, {q:3,r:4})").asDict() == {"p": 1, "q": 3, "r": 4}
    assert rows(engine, "table(Well, {top:Well.top-9, Well.rim})") == ["{top:90,rim:12}", "{top:81,rim:12}"]


def test_map_and_filter(engine):
    engine.run(BOXES)
    assert rows(engine, "Boxes | map({&size}) | map({twice:&size*2})") == ["{twice:8}", "{twice:14}", "{twice:18}"]
    assert rows(engine, "Boxes | map({t:box.tag}, row:=box)") == ["{t:oak}", "{t:elm}", "{t:fir}"]
    assert rows(engine, "Boxes | map($size-&size%3)") == ["3", "6", "9"]
    assert rows(engine, "Boxes | map({size:&size-4, tag:`old `+&tag})") == ["{size:0,tag:old oak}", "{size:3,tag:old elm}", "{size:5,tag:old fir}"]
    assert rows(engine, "map(Boxes, {n:&size}, {n:-&size})") == ["{n:4}", "{n:-4}", "{n:7}", "{n:-7}", "{n:9}", "{n:-9}"]
    assert rows(engine, "map(Boxes, {t:&tag}, {t:string(&size)}, filter:=&size<8)") == ["{t:oak}", "{t:4}", "{t:elm}", "{t:7}"]
    assert rows(engine, "filter(Boxes, &size!=7, map:={&tag})") == ["{tag:oak}", "{tag:fir}"]
    assert rows(engine, "filter(table(3,8,12,21), n%4==0, row:=n)") == ["8", "12"]
    assert rows(engine, "firstn(Boxes, 1) | map(&tag)") == ["oak"]
    assert rows(engine, "map(table(2,5), _+_*10)") == ["22", "55"]
    assert rows(engine, "table()") == []


def test_nested_tables(engine):
    engine.run("East := table({km:12, town:`Ems`}); West := table({km:30, town:`Ulm`},{km:8, town:`Au`}); Trips := table({stops: West, no: 5}, {stops: East, no: 6})")
    assert rows(engine, "Trips | map({far: &stops | filter(|stop|stop.km > 20)})") == ["{far:[{km:30,town:Ulm}]}", "{far:[]}"]
    assert rows(engine, "Trips | map(|trip|(trip.stops | map(|stop|{trip.no, m:stop.km*1000, at:`in `+stop.town})))") == ["[{no:5,m:30000,at:in Ulm},{no:5,m:8000,at:in Au}]", "[{no:6,m:12000,at:in Ems}]"]
    assert rows(engine, "Trips | map({&no, n:count(&stops), p:pick(&stops, &km<10), s:sort(&stops, -&km) | map(&km)})")[0] == "{no:5,n:2,p:{km:8,town:Au},s:[30,8]}"
    assert rows(engine, "Trips | map(&stops) | flatten() | map(&town)") == ["Ulm", "Au", "Ems"]
    assert rows(engine, "table({t:table(9,4,6)}) | map({up:sort(&t,_), two:minn(&t,2,-_), one:firstn(&t,1)})") == ["{up:[4,6,9],two:[9,6],one:[9]}"]
    assert rows(engine, "table({t:table({k:`p`,v:4},{k:`q`,v:1},{k:`p`,v:8})}) | map({r: reduce(&t, &k, |x,y|x+y, map:=&v)})") == ["{r:[{key:p,value:12},{key:q,value:1}]}"]


def test_joins_and_groups_in_cells(engine):
    engine.run("T := table({x:table({k:1,a:`p`},{k:2,a:`q`}), y:table({k:2,b:`r`},{k:3,b:`s`})})")
    assert rows(engine, "T | map(join({l:&x, r:&y}, l.k==r.k)) | flatten()") == ["{l_k:2,l_a:q,r_k:2,r_b:r}"]
    assert rows(engine, "T | map(join({l:&x, r:&y}, l.k==?r.k, map:={l.a, c:r.b})) | flatten()") == ["{a:p,c:NA}", "{a:q,c:r}"]
    assert rows(engine, "T | map(join({l:&x, r:&y}, l.k?==?r.k, map:={l.k, c:r.b})) | flatten()", False) == ["{k:1,c:NA}", "{k:2,c:r}", "{k:NA,c:s}"]
    assert rows(engine, "T | map(join({l:&x, r:&y}, l.k<r.k, map:=|l,r|{l.k, c:r.k})) | flatten()") == ["{k:1,c:2}", "{k:1,c:3}", "{k:2,c:3}"]
    engine.run("G := table({t:table({k:1,v:2},{k:2,v:5},{k:1,v:3})})")
    assert rows(engine, "G | map(cogroup(&t, &k, map:=&v)) | flatten()") == ["{key:1,value:[2,3]}", "{key:2,value:[5]}"]
    engine.run("R := table({id:1, reads:table({chrom:`c`,start:0,end:5},{chrom:`c`,start:50,end:60})}); B := table({chrom:`c`,start:4,end:9,f:`one`},{chrom:`d`,start:0,end:99,f:`two`})")
    assert rows(engine, "R | map({&id, n: &reads | joinbed(B) | count()})") == ["{id:1,n:1}"]
    assert rows(engine, "R | map(&reads | joinbed(B, map:=|r,feat|{r.start, feat.f})) | flatten()") == ["{start:0,f:one}"]


def test_concat_and_flatten(engine):
    engine.run("May := table({day:3, rain:`little`}, {day:9, rain:`much`}); June := table({day:2, rain:`none`}); July := table({day:30})")
    assert rows(engine, "table(May, June) | flatten(subshard:=true)") == ["{day:3,rain:little}", "{day:9,rain:much}", "{day:2,rain:none}"]
    assert rows(engine, "concat(flatten(table(June, May)), July)")[-1] == "{day:30,rain:NA}"


def test_sort_and_missing_values(engine):
    engine.run("T := table({a:2,b:`x`},{a:NA,b:`y`},{a:1,b:`xy`})")
    assert rows(engine, "T | sort(&a) | map(&a)") == ["1", "2", "NA"]
    assert rows(engine, "T | sort(-&a) | map(&a)") == ["NA", "2", "1"]
    assert rows(engine, "T | sort({-&b, &a}) | map(&b)") == ["y", "xy", "x"]
    assert rows(engine, "minn(T, 2, &a) | map(&a)") == ["1", "2"]
    assert rows(engine, "T | filter(&a>1) | map(&b)") == ["x", "y"]
    assert rows(engine, "T | filter(!(&a>1)) | map(&b)") == ["xy"]
    assert rows(engine, "T | filter(&a<2) | map(&b)") == ["xy"]
    assert rows(engine, "T | filter(&a==NA) | map(&b)") == ["y"]
    assert engine.eval_text("(-`bb`) < (-`b`)") and not engine.eval_text("(-`a`) < (-`b`)")


def test_reduce_and_cogroup(engine):
    engine.run("T := table({i:0,s:`a`},{i:1,s:`b`},{i:3,s:`c`},{i:0,s:`d`},{i:1,s:`e`})")
    engine.run("N := table({k:0,v:1},{k:1,v:2},{k:3,v:6},{k:0,v:3},{k:1,v:3})")
    assert rows(engine, "N | reduce(&k, |a,b|(a+b), map:=&v)", False) == ["{key:0,value:4}", "{key:1,value:5}", "{key:3,value:6}"]
    assert rows(engine, "N | reduce(&k, _acc+_val, map:=1)", False) == ["{key:0,value:2}", "{key:1,value:2}", "{key:3,value:1}"]
    assert rows(engine, "N | reduce(&k, |a,b|max(a,b), map:=&v)", False) == ["{key:0,value:3}", "{key:1,value:3}", "{key:3,value:6}"]
    assert rows(engine, "N | reduce({&k}, |a,b|{n:a.n+b.n, m:min(a.m,b.m)}, map:={n:1, m:&v})", False)[0] == "{key:{k:0},value:{n:2,m:1}}"
    assert rows(engine, "N | reduce(&k, |a,b|if a>b a*10 else b*10, map:=&v)", False) == ["{key:0,value:30}", "{key:1,value:30}", "{key:3,value:6}"]
    assert rows(engine, "T | cogroup(&i, map:=&s)", False) == ["{key:0,value:[a,d]}", "{key:1,value:[b,e]}", "{key:3,value:[c]}"]
    fused = engine.eval_text("T | cogroup({&i}) | map({&key, count: count(&value)})")
    assert sorted(table_text(fused)) == ["{key:{i:0},count:2}", "{key:{i:1},count:2}", "{key:{i:3},count:1}"]
    assert "collect_list" not in fused._jdf.queryExecution().toString()
    assert rows(engine, "T | cogroup(&i) | map({&key, s: &value | map(&s)})", False)[0] == "{key:0,s:[a,d]}"
    deep = engine.eval_text("""T | cogroup(&i) | map({&key, n: &value | filter(&s > `a`) | count(), last: (sort(&value, -&s) | pick(true)).s, some: sort(&value, &s) | map(&s) | pick(_ > `b`),
      total: (reduce(&value, 0, |a,b|a+b, map:=string_len(&s)) | pick(true)).value, most: reduce(&value | filter(&s > `d`), 1, |a,b|max(a,b), map:=&s)})""")
    assert sorted(table_text(deep)) == [
        "{key:0,n:1,last:d,some:d,total:2,most:[]}", "{key:1,n:2,last:e,some:e,total:2,most:[{key:1,value:e}]}", "{key:3,n:1,last:c,some:c,total:1,most:[]}",
    ]
    assert "collect_list" not in deep._jdf.queryExecution().toString()


def test_joins(engine):
    engine.run("A := table({x:0,s:`a0`},{x:1,s:`a1`},{x:2,s:`a2`}); B := table({y:1,s:`b1`},{y:2,s:`b2`},{y:4,s:`b4`})")

    def got(text):
        return rows(engine, text, False)

    assert got("join({a:A,b:B}, a.x==b.y)") == ["{a_x:1,a_s:a1,b_y:1,b_s:b1}", "{a_x:2,a_s:a2,b_y:2,b_s:b2}"]
    assert got("join({a:A,b:B}, a.x==?b.y, map:={x:a.x, y:b.y})") == ["{x:0,y:NA}", "{x:1,y:1}", "{x:2,y:2}"]
    assert got("join({a:A,b:B}, a.x?==b.y, map:={x:a.x, y:b.y})") == ["{x:1,y:1}", "{x:2,y:2}", "{x:NA,y:4}"]
    assert got("join({a:A,b:B}, a.x?==?b.y, map:={x:a.x, y:b.y})") == ["{x:0,y:NA}", "{x:1,y:1}", "{x:2,y:2}", "{x:NA,y:4}"]
    assert got("join({a:A,b:B}, a.x==?b.y && isnull(b.y), map:={x:a.x})") == ["{x:0}"]
    lost = engine.eval_text("join({a:A,b:B}, a.x?==b.y && isnull(a.x))")
    assert table_text(lost) == ["{a_x:NA,a_s:NA,b_y:4,b_s:b4}"] and "LeftAnti" in lost._jdf.queryExecution().optimizedPlan().toString()
    assert got("join({a:A,b:B}, a.x>b.y, map:=|a,b|{a.x,b.y})") == ["{x:2,y:1}"]
    engine.run("C := table({z:2,t:`c`})")
    assert got("join({a:A,b:B,c:C}, a.x==b.y && b.y==c.z, map:={a.x,c.t})") == ["{x:2,t:c}"]
    assert got("join({a:A,b:B,c:C}, b.y==c.z && a.x==b.y, map:={a.x,c.t})") == ["{x:2,t:c}"]
    assert got("join({a:table(1,2),b:table(2,3)}, a==b)") == ["{a:2,b:2}"]


def test_joins_with_missing_keys(engine):
    engine.run("A := table({x:1},{x:NA}); B := table({y:1,t:`u`},{y:NA,t:`v`}); C := table({y:1,t:`u`})")
    assert rows(engine, "join({a:A,b:B}, a.x==b.y, map:={a.x,b.t})", False) == ["{x:1,t:u}", "{x:NA,t:v}"]
    assert rows(engine, "join({a:A,b:C}, a.x==b.y, map:={a.x,b.t})", False) == ["{x:1,t:u}", "{x:NA,t:NA}"]
    assert rows(engine, "join({a:A,b:B}, a.x==?b.y, map:={a.x,b.t})", False) == ["{x:1,t:u}"]
    strict = Engine(engine.spark, compat_na_join=False)
    assert rows(strict, "join({a:table({x:1},{x:NA}),b:table({y:1})}, a.x==b.y, map:={a.x})", False) == ["{x:1}"]


def test_interval_join(engine):
    engine.run("Reads := table({chrom:`x`,start:40,end:90,n:1},{chrom:`x`,start:500,end:501,n:2},{chrom:`x`,start:900,end:5000000,n:3},{chrom:`y`,start:40,end:90,n:4})")
    engine.run("Genes := table({chrom:`x`,start:0,end:41,f:`alpha`},{chrom:`x`,start:89,end:500,f:`beta`},{chrom:`x`,start:4000000,end:4000001,f:`gamma`},{chrom:`y`,start:90,end:99,f:`delta`})")
    assert rows(engine, "Reads | joinbed(Genes) | map(&n)", False) == ["1", "3"]
    assert rows(engine, "Reads | joinbed(Genes, map:=|r,feat|{r.n,feat.f})", False) == ["{n:1,f:alpha}", "{n:1,f:beta}", "{n:3,f:gamma}"]
    assert rows(engine, "Reads | joinbed(Genes, start:=&start+10, length:=60, map:={_.n, feat.f})", False) == ["{n:1,f:beta}", "{n:4,f:delta}"]
    assert rows(engine, "Reads | joinbed(Genes, map:=|r,feat|{r.n})", False) == ["{n:1}", "{n:3}"]


def test_reshaping(engine):
    engine.run("Rooms := table({room:`hall`,may:6,june:8},{room:`loft`,may:5,june:NA})")
    assert rows(engine, "Rooms | gather(`may`,`june`,key:=`month`,value:=`heat`)") == ["{room:hall,month:may,heat:6}", "{room:hall,month:june,heat:8}", "{room:loft,month:may,heat:5}", "{room:loft,month:june,heat:NA}"]
    assert rows(engine, "Rooms | gather(`may`,`june`,key:=`month`,value:=`heat`) | spread(key:=`month`,value:=`heat`) | collapse(`may`,`june`)") == ["{room:hall,may:6,june:8}", "{room:loft,may:5,june:NA}"]
    half = "table({shelf:1,left:5,right:NA},{shelf:1,left:NA,right:6},{shelf:1,left:7,right:NA},{shelf:2,left:NA,right:8},{shelf:2,left:NA,right:9})"
    assert rows(engine, half + " | collapse(`left`,`right`)") == ["{shelf:1,left:5,right:6}", "{shelf:1,left:7,right:NA}", "{shelf:2,left:NA,right:8}", "{shelf:2,left:NA,right:9}"]
    assert rows(engine, "table({shelf:1,left:5},{shelf:2,left:5},{shelf:1,left:NA}) | collapse(`left`)") == ["{shelf:1,left:5}", "{shelf:2,left:5}", "{shelf:1,left:NA}"]
    engine.run("Flat := table({no:1, rooms:table({r:`a`,m:1,j:2},{r:`b`,m:3,j:NA})})")
    assert rows(engine, "Flat | map({&no, t: &rooms | gather(`m`,`j`,key:=`k`,value:=`v`) | filter(&v < 3) | map({&r, &k})})") == ["{no:1,t:[{r:a,k:m},{r:a,k:j}]}"]
    assert rows(engine, f"table({{t: {half}}}) | map(&t | collapse(`left`,`right`)) | flatten()") == rows(engine, half + " | collapse(`left`,`right`)")
    engine.run("Farms := table({farm:`a`, yields:table({crop:`rye`, year:1, tons:30}, {crop:`oat`, year:2, tons:41})}, {farm:`b`, yields:table({crop:`rye`, year:2, tons:52})})")
    assert rows(engine, "transpose(Farms, {&farm}, {&crop,&year,&tons})") == ["{farm:a,oat_2:41,rye_1:30,rye_2:NA}", "{farm:b,oat_2:NA,rye_1:NA,rye_2:52}"]
    assert rows(engine, "transpose(Farms, {&farm}, |key,val|{val.crop,key.farm+string(val.year)})")[0] == "{farm:a,oat:a2,rye:a1}"


def test_files(engine, tmp_path):
    data = tmp_path / "data.tsv"
    data.write_text("A\tB\tC\tD\tE\n31\tfig\tq 1\t2.5\tend\n# note\n44\tplum\tq 1\t8\tend\n\nNA\tplum\tNA\tNA\tend\n")
    assert rows(engine, f"read(`{data}`)") == ["{A:31,B:fig,C:q 1,D:2.5,E:end}", "{A:44,B:plum,C:q 1,D:8,E:end}", "{A:NA,B:plum,C:NA,D:NA,E:end}"]
    engine.run(f"D := read(`{data}`)")
    assert engine.eval_text("table_attrs(D).name") == "tsv" and engine.eval_text("table_attrs(D).path").endswith("/data.tsv")
    for name in ("o.tsv", "o.btsv", "o.parquet"):
        assert engine.eval_text(f"write(D, `{tmp_path}/{name}`)") is True
        assert rows(engine, f"read(`{tmp_path}/{name}`)")[0] == "{A:31,B:fig,C:q 1,D:2.5,E:end}"
    assert engine.eval_text(f"write(firstn(D,1), `{tmp_path}/o.tsv`)") is True
    assert engine.eval_text(f"read(`{tmp_path}/o.tsv`) | count()") == 3
    assert Engine(engine.spark, overwrite=True).eval_text(f"write(table({{A:7}}), `{tmp_path}/o.tsv`)") is True
    assert rows(engine, f"read(`{tmp_path}/o.tsv`)") == ["{A:7}"]
    engine.run(f"write(table({{chrom:`chr1`,start:10,end:20}}), `{tmp_path}/b.bed`)")
    assert rows(engine, f"read(`{tmp_path}/b.bed`)") == ["{chrom:chr1,start:10,end:20,featname:NA}"]
    assert rows(engine, f"read(`{data}`, type:=`tsv`) | map(_, shards:=5) | map(&B)")[0] == "fig"
    assert rows(engine, f"table({{p:`{data}`}},{{p:`{data}`}}) | map(read(&p)) | flatten() | map(&E)") == ["end"] * 6
    (tmp_path / "lib.q").write_text("func twice(x) x*2")
    assert engine.eval_text(f"load `{tmp_path}/lib.q`; twice(4)") == 8
    engine.run(f"writecols(D, `{tmp_path}/col-{{{{.Name}}}}-{{{{.Number}}}}.tsv`)")
    assert rows(engine, f"read(`{tmp_path}/col-B-1.tsv`)") == ["{B:fig}", "{B:plum}", "{B:plum}"]
    assert "data_tsv" in engine.eval_text(f"readdir(`{tmp_path}`)").asDict()
    assert engine.eval_text("force(D) | count()") == 3
    engine.out = (said := []).append
    assert engine.eval_text("print(D, mode:=`compact`)") is True and said[0].startswith("{A:31") and len(said) == 3


def test_sample_and_native_functions(engine):
    assert engine.eval_text("table(1,2,3,4,5,6,7,8) | sample(1) | count()") == 8
    from pyspark.sql import functions as F

    engine.register("upper", F.upper, "string")
    engine.set_global("G", engine.spark.createDataFrame([("a",)], "n string"))
    assert rows(engine, "G | map({u:upper(&n)})") == ["{u:A}"]


@pytest.mark.parametrize(
    ("text", "error", "message"),
    [
        ("foo bar", SyntaxProblem, "syntax error"), ("table(1", SyntaxProblem, "syntax error"), ("nosuch", EvalProblem, "isn't defined"), ("x := 1; x := 2", EvalProblem, "already"),
        ("map := 1", EvalProblem, "function of the language"), ("1 + `a`", EvalProblem, "doesn't take"), ("1 > `a`", EvalProblem, "compared"), ("1 && true", EvalProblem, "bool"),
        ("table({a:1}) | map(&b)", EvalProblem, "no column b"), ("count(1)", EvalProblem, "takes a table"), ("table(1) | sort()", EvalProblem, "takes 2 arguments"),
        ("table({a:1}) | gather(`z`,key:=`k`,value:=`v`)", ValueError, "no such columns"), ("read(`a.xyz`)", ValueError, "no format"), ("(|x|x)(1,2)", EvalProblem, "takes 1 arguments"),
        ("map(table(1), _, nope:=1)", EvalProblem, "no argument nope"),
    ],
)
def test_errors(engine, text, error, message):
    with pytest.raises(error, match=message):
        engine.eval_text(text)


def test_filters_reach_the_scan(engine, tmp_path):
    engine.spark.range(100).selectExpr("id as a", "id as b").write.parquet(f"{tmp_path}/t.parquet")
    plan = engine.eval_text(f"read(`{tmp_path}/t.parquet`) | filter(&a>5) | map({{&a}})")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(a,5),IsNull(a))]" in plan and "ReadSchema: struct<a:bigint>" in plan


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_a_zone_are_utc(engine, tmp_path, zone):
    spark = engine.spark
    spark.sql("select timestamp_ntz'1996-06-01 00:30:00' as t, 1 as n union all select timestamp_ntz'1969-12-31 23:59:59.5', 2").write.parquet(f"{tmp_path}/t.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = engine.eval_text(f"read(`{tmp_path}/t.parquet`) | filter(&t > 1996-06-01T00:00:00Z) | map({{&n, s: int(&t)}})")
        assert [tuple(r) for r in df.collect()] == [(1, 833589000)]
        assert "GreaterThan(t,1996-06-01T00:00)" in df._jdf.queryExecution().executedPlan().toString()
        assert engine.eval_text(f"(read(`{tmp_path}/t.parquet`) | filter(&n == 2) | map({{f: float(&t)}}) | pick(true)).f") == -0.5
        assert engine.eval_text(f"read(`{tmp_path}/t.parquet`) | filter(&t <= 1996-05-31T20:30:00-0400) | count()") == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
