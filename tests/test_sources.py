from __future__ import annotations

import gzip
import struct
import zlib

import pytest
import zstandard

from millrace.cli import argument, main, prompt
from millrace.plans.engine import Engine
from millrace.queries import relational
from millrace.sources import bam, registry, tsv


@pytest.mark.parametrize(
    ("cells", "kind"),
    [
        (["1", "2", "0x10", "045"], "int"), (["1", "2.5", "3"], "int"), (["1", "2.5"], "float"), (["1e3", "2"], "float"), (["a", "1"], "string"), (["true", "FALSE", "NA"], "bool"),
        (["NA", "", "NaN", None], "string"), ([], "string"), (["1"] * 70 + ["x"] * 500, "int"), (["null"], "string"), (["2018-01-01"], "string"),
    ],
)
def test_vote(cells, kind):
    assert tsv.vote(cells) == kind


TEXT = "A\tB\tC\tD\n0x10\t1.5\ttrue\tx y\n# note\n010\tNA\tFALSE\t\n\n-7\t2\tNA\tNULL\n"
ROWS = [(16, 1.5, True, "x y"), (8, None, False, None), (-7, 2.0, None, None)]


@pytest.mark.parametrize("end", ["", ".gz", ".zst"])
def test_read_tsv(spark, tmp_path, end):
    path = tmp_path / f"t.tsv{end}"
    data = TEXT.encode()
    path.write_bytes({"": data, ".gz": gzip.compress(data), ".zst": zstandard.compress(data)}[end])
    assert [tuple(r) for r in registry.read(spark, str(path)).collect()] == ROWS


def test_compressed_lines_like_the_header(spark, tmp_path):
    text = b'A\tB\nA\tB\n# n\n\n2\t"q\n#y\tz"\n'
    (tmp_path / "t.tsv").write_bytes(text)
    (tmp_path / "t.tsv.zst").write_bytes(zstandard.compress(text[:10]) + zstandard.compress(text[10:]))
    want = [("A", "B"), ("2", "q\n#y\tz")]
    assert [tuple(r) for r in tsv.read_tsv(spark, f"{tmp_path}/t.tsv.zst", {"A": "string"}).collect()] == want
    (tmp_path / "d.tsv.zst").mkdir()
    for i in (1, 2):
        (tmp_path / f"d.tsv.zst/{i}.zst").write_bytes(zstandard.compress(b"A\tB\n%d\tx\n" % i))
    assert sorted(r.A for r in tsv.read_tsv(spark, f"{tmp_path}/d.tsv.zst").collect()) == [1, 2]
    (tmp_path / "u.tsv.zst").write_bytes(zstandard.compress(b"A\tB\n1\n"))
    with pytest.raises(Exception, match="malformed record"):
        registry.read(spark, f"{tmp_path}/u.tsv.zst").count()


def test_writing_keeps_partitions(spark, tmp_path):
    df = spark.range(0, 100, 1, 5)
    registry.write(df, f"{tmp_path}/a.tsv")
    registry.write(df, f"{tmp_path}/b.tsv", shards=2)
    assert [len(list((tmp_path / n).glob("part-*"))) for n in ("a.tsv", "b.tsv")] == [5, 2]


def test_spaces_and_empty_cells_stay(spark, tmp_path):
    rows = [(" a ", "", '"q"'), ("", "\\", "x, y"), ("end", " ", "é")]
    registry.write(spark.createDataFrame(rows, "a string, b string, c string"), f"{tmp_path}/o.tsv")
    lines = sorted(x for p in (tmp_path / "o.tsv").glob("part-*") for x in p.read_text().split("\n") if x)
    assert sorted({*lines} - {"a\tb\tc"}) == sorted("\t".join(r) for r in rows)
    df = spark.createDataFrame([("", ""), ("", "")], "a string, b string").coalesce(1)
    registry.write(df, f"{tmp_path}/e.tsv")
    assert [p.read_text() for p in (tmp_path / "e.tsv").glob("part-*")] == ["a\tb\n\t\n\t\n"]


def test_stray_cells(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("A\n1\n2\n3.7\n")
    assert [r.A for r in registry.read(spark, str(tmp_path / "t.tsv")).collect()] == [1, 2, 3]
    (tmp_path / "u.tsv").write_text("A\tB\n1\t2\n1\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        registry.read(spark, str(tmp_path / "u.tsv")).collect()
    (tmp_path / "e.tsv").write_text("")
    assert registry.read(spark, str(tmp_path / "e.tsv")).count() == 0


def test_odd_names_and_writing(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", None, 0.5, [1, 2]), ("", 2, 3.0, None)], "`T>A` string, n long, f double, l array<int>")
    registry.write(df, f"{tmp_path}/o.tsv", shards=2)
    text = sorted("".join(p.read_text() for p in (tmp_path / "o.tsv").glob("part-*")).split("\n"))
    assert "a b\tNA\t0.5\t[1,2]" in text and "\t2\t3\tNA" in text and "T>A\tn\tf\tl" in text
    with pytest.raises(ValueError, match="Name"):
        tsv.write_columns(df, "x.tsv")


def test_bed(spark, tmp_path):
    (tmp_path / "three.bed").write_text("chr1\t5\t85\nchr2\t300\t382\n")
    (tmp_path / "four.bed").write_text("chr1\t5\t85\tr1\n")
    assert [tuple(r) for r in registry.read(spark, f"{tmp_path}/three.bed").collect()] == [("chr1", 5, 85, None), ("chr2", 300, 382, None)]
    assert [tuple(r) for r in registry.read(spark, f"{tmp_path}/four.bed").collect()] == [("chr1", 5, 85, "r1")]
    registry.write(spark.createDataFrame([("chr1", 1, 2, None), ("chr1", 3, 4, "b")], "chrom string, start long, end long, featname string"), f"{tmp_path}/o.bed")
    assert sorted(tuple(r)[1:] for r in registry.read(spark, f"{tmp_path}/o.bed").collect()) == [(1, 2, None), (3, 4, "b")]
    (tmp_path / "odd.bed").write_text("chr1\tx\t85\n")
    with pytest.raises(Exception, match="malformed"):
        registry.read(spark, f"{tmp_path}/odd.bed").collect()


def alignment(name, ref, pos, cigar, seq, qual, tags):
    packed = bytearray()
    for i in range(0, len(seq), 2):
        pair = ["=ACMGRSVTWYHKDBN".index(c) for c in seq[i : i + 2]] + [0]
        packed.append(pair[0] << 4 | pair[1])
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), 99, len(seq), ref, pos + 10, 30)
    body += name.encode() + b"\0" + ops + bytes(packed) + bytes(q - 33 for q in qual.encode()) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    """A member of a blocked gzip file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_alignments(spark, tmp_path):
    data = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data += alignment("r1", 0, 99, [(4, "S"), (3, "M")], "ACGTNAC", "IIIIIII", b"NMC\x02MDZ5A0\0XBBs" + struct.pack("<ihh", 2, -1, 7))
    data += alignment("r2", -1, -1, [], "", "", b"")
    (tmp_path / "a.bam").write_bytes(block(data[:40]) + block(data[40:]) + block(b""))
    got = [tuple(r) for r in registry.read(spark, f"{tmp_path}/a.bam").collect()]
    assert got[0] == ("r1", "chr1", 100, 60, "4S3M", 99, "=", 110, 30, "ACGTNAC", "IIIIIII", {"NM": "2", "MD": "5A0", "XB": "-1,7"})
    assert got[1][:5] == ("r2", "*", 0, 60, "*") and got[1][9:] == ("*", "*", {})
    with pytest.raises(ValueError, match="can't be written"):
        registry.write(spark.range(1), f"{tmp_path}/b.bam")


@pytest.mark.parametrize(("block", "split"), [(60_000, 4_000), (500, 1_000), (97, 300), (60_000, 10**9)])
def test_alignments_are_split_over_tasks(spark, tmp_path, block, split):
    reads = [(f"r{i}", i % 2, i * 7 % 900, "ACGTNACGT"[: 1 + i % 9] * (1 + (i % 50 == 0) * 300)) for i in range(3000)]
    (tmp_path / "a.bam").write_bytes(bam.packed([("c1", 1000), ("c2", 1000)], reads, block))
    df = bam.read_alignments(spark, f"{tmp_path}/a.bam", split)
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.bam").stat().st_size // split)
    assert [(r.name, ["c1", "c2"].index(r.reference), r.pos - 1, r.seq) for r in df.collect()] == reads


def test_alignments_are_packed_by_tasks(spark, tmp_path, monkeypatch):
    spark.range(0, 3000, 1, 3).selectExpr("(id * 7) % 3000 as o_orderkey", "id as o_custkey", "'O' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    frame, seen = type(spark.range(1)), []
    collect = frame.collect

    def counted(df):
        seen.append(len(rows := collect(df)))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    df = relational.QUERIES["alignments"](spark, str(tmp_path))
    assert sum(seen) <= 16  # no rows of the table come to the driver, only names of files
    want = sorted((f"r{i * 7 % 3000}", "chr1", i + 1, f"{1 + i % 4}M", "ACGT"[: 1 + i % 4]) for i in range(3000))
    assert sorted(map(tuple, collect(df))) == want and df.rdd.getNumPartitions() > 1


def test_packed_files_follow_partitions(spark, tmp_path):
    cols, refs = ["'r' || id", "0", "id", "'ACGT'"], [("c1", 1000)]
    df = spark.range(0, 10, 1, 5)
    for name, rows, n in (("a", df.where("id < 2 or id > 5"), 5), ("b", df.where("id > 99"), 5), ("c", df.where("1 = 0"), 1)):
        found = bam.write_packed(rows.selectExpr(*cols), f"{tmp_path}/{name}", refs, 97)
        assert len(list((tmp_path / name).glob("part-*"))) == n
        assert [(r.name, r.pos, r.seq) for r in bam.read_alignments(spark, found, 60).collect()] == [(f"r{r.id}", r.id + 1, "ACGT") for r in rows.collect()]
    reads = [(f"r{i}", 0, i, "ACGTN" * (i % 60)) for i in range(300)]
    files = [b"".join(bam.packed_blocks(refs, iter(reads), 97)), bam.packed(refs, reads, 97)]
    assert files[0] == files[1] and (tmp_path / "d.bam").write_bytes(files[0]) == len(files[0])
    assert [(r[0], r[2] - 1, r[9].replace("*", "")) for r in bam.read_records(f"{tmp_path}/d.bam")] == [(n, i, s) for n, _, i, s in reads]


def test_formats(spark, tmp_path):
    assert registry.find("x.bed.count").name == "bed" and registry.find("a/b.tsv.gz").name == "tsv" and registry.find("q", "tsv").name == "tsv"
    with pytest.raises(ValueError, match="no such format"):
        registry.find("q", "none")
    registry.register("ids", r"\.ids$", lambda s, path: s.range(int(path.split(".")[0])))
    assert Engine(spark).eval_text("read(`12.ids`) | count()") == 12
    folder = tmp_path / "S1"
    (folder / "sub").mkdir(parents=True)
    (folder / "S1.depth.tsv").write_text("")
    (folder / "sub/S1_x.bed").write_text("")
    assert set(registry.list_files(spark, str(folder))) == {"depth_tsv", "sub_x_bed"}


def test_command_line(spark, tmp_path, capsys):
    assert [argument(x) for x in ("true", "3", "1.5", "a")] == [True, 3, 1.5, "a"]
    assert main(["--eval", "n + 1", "n=4"]) == 0 and "5" in capsys.readouterr().out
    script = tmp_path / "s.q"
    script.write_text("table({a:1},{a:2}) | filter(&a > least)")
    assert main([str(script), "least=1"]) == 0 and "{a:2}" in capsys.readouterr().out
    assert main(["--output", f"{tmp_path}/o.tsv", str(script), "least=0"]) == 0 and registry.read(spark, f"{tmp_path}/o.tsv").count() == 2
    assert main(["--eval", "nosuch"]) == 1


def test_prompt(spark, tmp_path):
    lines, said = iter(["x := 3;", "table(1,", "x)", "x + y", f"x + 1 > {tmp_path}/out.txt", "help map", "help", "history", "quit"]), []
    prompt(Engine(spark), lambda _: next(lines), said.append)
    assert said[:3] == ["3", "1", "3"] and any("y isn't defined" in x for x in said) and (tmp_path / "out.txt").read_text() == "4\n"
    assert any(x.startswith("map(tbl") for x in said) and any(x.startswith("functions:") for x in said)
