"""File checks against a literal reading of the rules, on files with every edge."""

import random

import pytest

from coterie.functions import fixed
from coterie.operators.profile import check_shape, metadata, profile_files
from coterie.plans.intake import catalog_events, intake_files
from coterie.operators.runs import DATASET_EVENTS_SCHEMA, dataset_catalog
from coterie.sources.csv import read_csv, write_csv
from coterie.sources.files import read_file_sizes, read_lines
from pyspark.errors import PySparkException

FILES = {
    "good.csv": "a,b\n1,2\n3,4\n",
    "no_newline.csv": "a,b\n1,2",
    "blank_middle.csv": "a,b\n1,2\n\n3,4\n",
    "blank_then_bad.csv": "a,b\n1,2\n\n   \n3,4\n5\n6,7,8\n",
    "crlf.csv": "a,b\r\n1,2\r\n3,4\r\n",
    "lone_return.csv": "a,b\n1\r1,2\n",
    "surplus.csv": "a,b\n1,2,3\n",
    "missing.csv": "a,b\n1,2\n3\n",
    "empty.csv": "",
    "header_only.csv": "a,b",
    "white.csv": "  \n\t\n",
    "newline.csv": "\n",
    "quoted.csv": 'a,b\n"1,2",3\n',
    "blank_header.csv": "\na\nb\n",
    "blank_header_bad.csv": "\na\n\nb,c\n",
    "trailing_comma.csv": "a,b,\n1,2,3\n1,2\n",
    "one_column.csv": "a\n1\n\n2\n",
    "upper.CSV": "a,b\n1,2\n",
    "wrong.txt": "a,b\n1,2\n",
}


def expected_bad_line(text):
    lines = [line.strip() for line in text.split("\n")]
    width = len(lines[0].split(","))
    number = 1
    for line in lines[1:]:
        if line:
            number += 1
            if len(line.split(",")) != width:
                return number
    return None


def expected(name, text):
    if not name.lower().endswith(".csv"):
        return fixed.FILE_TYPE
    if not text.strip():
        return fixed.FILE_EMPTY
    bad = expected_bad_line(text)
    return None if bad is None else f"{fixed.FILE_SHAPE}{bad}"


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_every_edge(spark, folder):
    profiled = profile_files(
        read_file_sizes(spark, str(folder)), read_lines(spark, str(folder))
    ).collect()
    assert {row["filename"] for row in profiled} == set(FILES)
    for row in profiled:
        name, text = row["filename"], FILES[row["filename"]]
        filled = [line.strip() for line in text.split("\n") if line.strip()]
        assert row["error"] == expected(name, text), name
        assert row["size"] == len(text.encode()), name
        if filled:
            assert row["lines"] == len(filled) - 1, name
            assert row["headers"] == filled[0].split(","), name
        else:
            assert row["lines"] is None, name


@pytest.mark.parametrize("split_bytes", [64, 1000])
def test_files_cut_into_many_splits(spark, tmp_path, split_bytes):
    draw = random.Random(5)
    texts = {}
    for i in range(12):
        lines = ["h1,h2,h3"]
        for _ in range(draw.randint(1, 120)):
            kind = draw.random()
            if kind < 0.2:
                lines.append(draw.choice(["", "  ", "\t"]))
            elif kind > 0.995 - 0.02 * (i % 3):
                lines.append(draw.choice(["x", "x,y,z,w"]))
            else:
                lines.append(f"{draw.randint(0, 9)},{'v' * draw.randint(0, 9)},1")
        texts[f"f{i}.csv"] = "\n".join(lines)
    texts["blank_blocks.csv"] = "a,b\n" + "\n" * 300 + "1,2\n" + "\n" * 200 + "3\n"
    texts["late_header.csv"] = "\n" * 200 + "a,b\n" + "1,2\n" * 50 + "x\n"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > len(texts)
        shapes = {r["path"].split("/")[-1]: r["bad_line"] for r in check_shape(lines).collect()}
        profiles = {r["path"].split("/")[-1]: r for r in metadata(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        filled = [line.strip() for line in text.split("\n") if line.strip()]
        assert shapes[name] == expected_bad_line(text), name
        assert profiles[name]["lines"] == len(filled) - 1, name
        assert profiles[name]["headers"] == filled[0].split(","), name


def test_intake_and_catalog(spark, folder):
    paths = {r["filename"]: r["path"] for r in read_file_sizes(spark, str(folder)).collect()}
    uploads = spark.createDataFrame(
        [
            (0, "ann", "first", paths["good.csv"]),
            (1, "ann", "taken", paths["crlf.csv"]),
            (2, "bob", "taken", paths["crlf.csv"]),
            (3, "bob", "bad name", paths["missing.csv"]),
            (4, "bob", "short", paths["missing.csv"]),
            (5, "bob", "nothing", paths["empty.csv"]),
            (6, "bob", "white", paths["white.csv"]),
            (7, "bob", "text", paths["wrong.txt"]),
            (8, "bob", "gone", paths["good.csv"].replace("good", "gone")),
            (9, "cat", "plain", str(folder / "good.csv")),
            (10, "cat", "slashes", f"file://{folder}/upper.CSV"),
            (12, "cat", "twice", paths["good.csv"]),
            (11, "cat", "twice", paths["missing.csv"]),
            (13, "cat", "twice", paths["crlf.csv"]),
        ],
        "seq int, user string, label string, path string",
    )
    known = spark.createDataFrame([("ann", "taken")], "user string, label string")
    result = intake_files(spark, uploads, str(folder), known)
    assert {r["seq"]: r["error"] for r in result.collect()} == {
        0: None,
        1: fixed.LABEL_TAKEN,
        2: None,
        3: fixed.LABEL_SPACES,
        4: f"{fixed.FILE_SHAPE}3",
        5: fixed.FILE_EMPTY,
        6: fixed.FILE_EMPTY,
        7: fixed.FILE_TYPE,
        8: fixed.FILE_MISSING,
        9: None,
        10: None,
        11: f"{fixed.FILE_SHAPE}3",  # is wrong, so it takes nothing
        12: None,
        13: fixed.LABEL_TAKEN,
    }
    events = catalog_events(result)
    assert set(events.columns) == {
        f.name for f in spark.createDataFrame([], DATASET_EVENTS_SCHEMA).schema
    }
    catalog = {(r["user"], r["label"]): r for r in dataset_catalog(events).collect()}
    assert {r["seq"] for r in events.collect()} == {0, 2, 9, 10, 12}
    assert {label for _, label in catalog} == {"first", "taken", "plain", "slashes", "twice"}
    assert catalog["ann", "first"]["lines"] == 2
    assert catalog["bob", "taken"]["headers"] == ["a", "b"]


def test_sizes_of_files_without_bytes_and_odd_names(spark, tmp_path):
    folder = tmp_path / "a b+c%20"
    (folder / "deep=1").mkdir(parents=True)
    for name, text in {"x.csv": "12", "empty.csv": "", "é +%41.csv": "123", "deep=1/y.csv": "1", "_hidden": "1", ".z": "1"}.items():
        (folder / name).write_text(text)
    wanted = {"x.csv": 2, "empty.csv": 0, "é +%41.csv": 3, "y.csv": 1}
    found = read_file_sizes(spark, [str(folder), str(tmp_path / "nothing")]).collect()
    assert {r.filename: r.size for r in found} == wanted and len(found) == 4
    assert {r.path for r in found if r.filename != "y.csv"} == {
        f"file:{folder}/{name}" for name in wanted if name != "y.csv"
    }
    assert [tuple(r)[1:] for r in read_file_sizes(spark, str(folder / "empty.csv")).collect()] == [("empty.csv", 0)]
    assert read_file_sizes(spark, str(tmp_path / "nothing")).collect() == []


def test_csv_types_and_spaces(spark, tmp_path):
    (tmp_path / "people.csv").write_text("name,age,score\nann, 42,1.5\nbob,23, 2\n")
    df = read_csv(spark, str(tmp_path / "people.csv"))
    assert dict(df.dtypes) == {"name": "string", "age": "int", "score": "double"}
    adults = df.filter("age > 30").select("name", "age")
    write_csv(adults, str(tmp_path / "out"))
    write_csv(adults, str(tmp_path / "out"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()] == [("ann", 42)]


def test_shape_does_not_depend_on_how_the_scan_is_split(spark, tmp_path):
    """The splits may change between planning and reading, and from one scan to another."""
    for name in "ab":
        lines = ["x,y"] + [["1,2", "", "  "][k % 3] for k in range(400)] + ["3"]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    wanted = expected_bad_line((tmp_path / "a.csv").read_text())
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", 4)
        shapes = check_shape(read_lines(spark, str(tmp_path)))
        spark.conf.set("spark.sql.files.minPartitionNum", 7)
        assert [r["bad_line"] for r in shapes.collect()] == [wanted] * 2
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_csv_keeps_texts(spark, tmp_path):
    rows = [(1, " a ", 'x "y" z'), (2, "", "q,r"), (3, None, '\\ back"'), (4, "\t", '""')]
    frame = spark.createDataFrame(rows, "i int, t string, u string")
    path = str(tmp_path / "texts")
    write_csv(frame, path)
    assert sorted(map(tuple, read_csv(spark, path).collect())) == rows
    broken = spark.createDataFrame([(1, "a\nb"), (2, 'c\r\n"d"')], "i int, t string")
    with pytest.raises(PySparkException, match="line break"):
        write_csv(broken, path)
    write_csv(broken, path, multi_line=True)
    assert sorted(map(tuple, read_csv(spark, path, multi_line=True).collect())) == [(1, "a\nb"), (2, 'c\r\n"d"')]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3,4,5\n", "a,b\n1,2\n3\n"])
def test_malformed_rows_are_refused(spark, tmp_path, text):
    (tmp_path / "m.csv").write_text(text)
    for schema in (None, "a int, b int"):
        with pytest.raises(Exception, match="m.csv"):
            read_csv(spark, str(tmp_path / "m.csv"), schema).collect()


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(PySparkException):
        read_csv(spark, str(tmp_path / "nothing"))
