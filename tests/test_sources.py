"""Readers on small files with every rule that shipped data leaves out."""

import pytest

from larkspur.sources import files


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_arff(spark, tmp_path):
    text = "% a comment\n\n@relation r\n@attribute x real\n@attribute 'the n' integer\n@attribute kind {a, 'b', c}\n@attribute ok {YES,no}\n@data\n1.5, 2, a, yes\n?,?,b,no\n1,2\nz,1,a,no\n{0 2.5, 2 c}\n"
    rows = files.read_arff(spark, put(tmp_path, "a.arff", text)).collect()
    assert [tuple(r) for r in rows[:2]] == [(1.5, 2, "a", True, None), (None, None, "b", False, None)]
    assert rows[2]._corrupt == "1,2" and rows[2].x is None and rows[3]._corrupt == "z,1,a,no"
    assert rows[4].x == 2.5 and rows[4].kind == "c"


def test_arff_errors(spark, tmp_path):
    with pytest.raises(files.FormatError, match="@relation after"):
        files.read_arff(spark, put(tmp_path, "b.arff", "@attribute x real\n@relation r\n@data\n"))
    with pytest.raises(files.FormatError, match="two attributes"):
        files.read_arff(spark, put(tmp_path, "c.arff", "@relation r\n@attribute x real\n@data\n"))
    with pytest.raises(files.FormatError, match="no @data"):
        files.read_arff(spark, put(tmp_path, "d.arff", "@relation r\n"))


def test_jdb_and_dictionary(spark, tmp_path):
    df = files.read_jdb(spark, put(tmp_path, "a.jdb", "; c\nname\nx numerical s SYMBOLIC\n1.5 red\n2 blue\n3 red\n"))
    assert [tuple(r) for r in df.collect()] == [(1.5, "red"), (2.0, "blue"), (3.0, "red")]
    assert {r.value: r.code for r in files.dictionary(df, "s", "x").collect()} == {"red": 0, "blue": 1}


def test_libsvm_front_text_and_choice(spark, tmp_path):
    r = files.read(spark, put(tmp_path, "a.libsvm", "+1 3:1 7:0.5\n-1\n")).collect()
    assert r[0].label == 1.0 and r[0].features == {3: 1.0, 7: 0.5} and r[1].features == {}
    assert [(x.f1, x.f2) for x in files.read(spark, put(tmp_path, "a.pf", "1 2\n3 4\n"), 2).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    assert files.read(spark, put(tmp_path, "a.txt", "a\nb")).first().value == "a\nb"
    with pytest.raises(files.FormatError):
        files.read(spark, "x.unknown")
    assert files.looks_like_text(b"a\tb\n") and not files.looks_like_text(b"a\x00")
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 1


def test_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    files.write(df, str(tmp_path / "x.xml"))
    assert {(r.k, r.v) for r in files.read_xml(spark, str(tmp_path / "x.xml"), "row").collect()} == {(1, "a"), (2, "b")}


def test_types_widen():
    assert files.widest(["int", "double"]) == "double" and files.widest(["boolean", "int"]) == "string"
