"""Results don't depend on the number of partitions, adaptive execution or broadcasts."""

from __future__ import annotations

import pytest

from millrace.plans.engine import BUILTINS, Engine, table_text
from millrace.plans.usage import USAGE

PROGRAMS = [
    "N | reduce(&k % 7, |a,b| a+b, map:=&v)",
    "N | reduce(&k % 7, |a,b| if a > b a else b, map:=&v)",
    "N | cogroup(&k % 5, map:=&v) | map({&key, n: count(&value)})",
    "N | cogroup(&k % 5) | map({&key, s: &value | map(&v) | sort(_) | firstn(3)})",
    "join({a: N, b: N | filter(&v % 3 == 0)}, a.k ==? b.v, map:={a.k, b.v})",
    "join({a: N, b: N | map({k: &k + 20})}, a.k ?==? b.k, map:={x: a.k, y: b.k})",
    "N | sort({-&v, &k}) | firstn(9)",
    "N | map({g: &k % 4, x: if &k % 2 == 0 &v else NA, y: if &k % 2 == 1 &v else NA}) | sort({&g, &x, &y}) | collapse(`x`, `y`) | map({&g})",
]
CONFS = [("1", "true", "10m"), ("7", "false", "-1"), ("3", "true", "-1")]


@pytest.mark.parametrize("program", PROGRAMS)
def test_same_rows(spark, program):
    found = []
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for conf in CONFS:
            for n, v in zip(names, conf):
                spark.conf.set(n, v)
            engine = Engine(spark)
            engine.set_global("N", spark.range(0, 200, 1, int(conf[0])).selectExpr("id as k", "pmod(id * 37, 101) as v"))
            found.append(sorted(table_text(engine.eval_text(program))))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert found[0] == found[1] == found[2] and found[0]


def test_every_function_is_described():
    assert set(USAGE) == set(BUILTINS)
