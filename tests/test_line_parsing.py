from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.line_parsing import Rule, lab_rules, parse_lines

SCHEMA = "id long, t string, line string, _cells string, reason string, line_id long"
RULES = {"two": [Rule("a", "int", False), Rule("b", "double")], "three": [Rule("a", "any"), Rule("b", "bool"), Rule("c", "name", False)]}


def parsed(spark, lines):
    rows = [(i, t, x, "other", "columns", -1) for i, (t, x) in enumerate(lines)]
    return parse_lines(spark.createDataFrame(rows, SCHEMA), RULES, "id", "t", "line")


def reasons(spark, lines):
    return {r.line_id: r.reason for r in parsed(spark, lines).rejected.collect()}


def split(line):
    """Fields, character by character; null if the quoting is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def test_quoting_against_brute_force(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice('""\t\ta1\n ') for _ in range(rng.randint(1, 12))) + "x" for _ in range(3000)]
    rules = {"t": [Rule(f"c{i}", "any") for i in range(3)]}
    df = spark.createDataFrame([(i, "t", x) for i, x in enumerate(lines)], "id long, t string, line string")
    got = parse_lines(df, rules, "id", "t", "line")
    bad = {r.line_id: r.reason for r in got.rejected.collect()}
    good = {r.line_id: list(r)[1:] for r in got.typed("t").collect()}
    for i, x in enumerate(lines):
        fields = split(x)
        if x.startswith("#") or not x.strip(" "):
            assert i not in bad and i not in good
        elif fields is None:
            assert bad[i] == "quoting", x
        elif len(fields) != 3:
            assert bad[i] == "column_count", x
        else:
            assert good[i] == [None if f.strip(" ") == "" else f.strip(" ") for f in fields], x
    assert len(bad) + len(good) == sum(bool(x.strip(" ")) for x in lines)


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("1\t2", None), ("1\t2\r", None), (" 1 \t 2 ", None), ('"1"\t"2.5e-3"', None), ("1\tNA", None), ("1\t", None), ("1\t-1.#IND", None), ("9223372036854775807\t1", None),
        ("00009223372036854775807\t1.", None), ("1\t1e5", None), ("1\t1E+05", None),
        ("9223372036854775808\t1", "value"), ("-1\t1", "value"), ("+1\t1", "value"), ("NA\t1", "value"), ("\t1", "value"), ("1\t1\xa0", "value"), ("１\t1", "value"), ("1\n\t1", "value"),
        ("1\t.5", "value"), ("1\tinf", "value"), ("1\tna", "value"), ("1\t+1", "value"), ("1\t1,5", "value"), ("1\t0x1", "value"), ("1\t2\r\r", "value"),
        ("1", "column_count"), ("1\t2\t3", "column_count"), ("1\t2\t", "column_count"), ("\t\t\t\t\t\t", "column_count"), ('1\t"2\t', "quoting"), ('"1"x\t2', "quoting"), ('"1" \t2', "quoting"),
        ('1\t2"', "value"), ('"1\t2"', "column_count"), ('""1""\t2', "quoting"), ('"""1"""\t2', "value"),
    ],
)
def test_reasons(spark, line, reason):
    assert reasons(spark, [("two", line)]) == ({0: reason} if reason else {})


def test_blank_lines_comments_and_tables(spark):
    assert reasons(spark, [("two", None), ("two", ""), ("two", "   "), ("two", "\r"), ("two", "# 1"), ("two", "#")]) == {}
    assert reasons(spark, [("other", "1\t2"), (None, "1\t2")]) == {0: "unknown_table", 1: "unknown_table"}
    assert reasons(spark, []) == {} and parsed(spark, []).typed("two").count() == 0


def test_typed_rows_and_errors(spark):
    p = parsed(spark, [("three", 'yes\t37\tTrue"\tx'), ("three", "\tTRUE\t z "), ("three", '"a\tb"\tfalse\t"c ""d"""'), ("three", "x\tmaybe\t"), ("two", "1\t2")])
    assert [tuple(r) for r in p.typed("three").orderBy("line_id").collect()] == [(1, None, True, "z"), (2, "a\tb", False, 'c "d"')]
    assert [(r.line_id, r.reason, r.first_column, r.n_errors) for r in p.rejected.orderBy("line_id").collect()] == [(0, "column_count", None, 0), (3, "value", "b", 2)]


def test_repeated_and_null_ids(spark):
    rows = [(None, "two", "x\t1"), (None, "two", "1\t1"), (7, "two", "x\ty"), (7, "two", "x\ty"), (7, "two", "1\t1")]
    got = parse_lines(spark.createDataFrame(rows, "id long, t string, line string"), RULES, "id", "t", "line")
    assert sorted(str(r.line_id) for r in got.rejected.collect()) == ["7", "7", "None"]
    assert sorted(str(r.line_id) for r in got.typed("two").collect()) == ["7", "None"]


def test_long_lines(spark):
    lines = [("two", "1\t" * 300_000), ("two", '"' + "\t" * 50_000), ("two", '"' + '""' * 200_000 + '"\t1'), ("two", "1\t" + "1" * 1_000_000)]
    assert reasons(spark, lines) == {0: "column_count", 1: "quoting", 2: "value"}


def test_lab_rules():
    rules = lab_rules()
    assert [len(rules[t]) for t in ("small", "conta")] == [7, 26] and rules["conta"][-1].column == "G>C"
    assert F is not None
