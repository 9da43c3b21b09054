import json

import pytest

from kgweave.sources import readers, writers
from kgweave.streaming import ingest


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b & c", None)], "id bigint, name string, tags array<string>")
    writers.parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.json_lines(df, str(tmp_path / "j"))
    writers.json_lines(df, str(tmp_path / "j"), append=True)
    back = readers.json_lines(spark, str(tmp_path / "j"), "id bigint, name string, tags array<string>")
    assert back.count() == 4
    assert writers.json_lines_to_parquet(spark, str(tmp_path / "j"), str(tmp_path / "q")).count() == 4
    writers.csv_report(writers.flat(df), str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), ["id", "name"]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        readers.csv(spark, str(tmp_path / "c"), ["nothing"])


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "entity_name": "x"}, {"id": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"id": 3}))
    assert readers.json_array(spark, str(tmp_path), readers.NODE).count() == 3
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl"), "id bigint").count() == 2
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl"), "id bigint", bad="PERMISSIVE").count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# A\nb")
    (tmp_path / "d" / "x.pdf").write_bytes(b"%PDF")
    assert [tuple(r) for r in readers.markdown(spark, str(tmp_path / "d")).collect()] == [("x.md", "# A\nb")]
    assert readers.binary(spark, str(tmp_path / "d")).first()["length"] == 4


def test_graphml(spark):
    import xml.dom.minidom

    v = spark.createDataFrame([("a<b", ["t"]), ("c", None)], "name string, types array<string>")
    e = spark.createDataFrame([("a<b", "c", 1.5)], "a string, b string, w double")
    lines = [r["line"] for r in writers.graphml_lines(v, e).orderBy("part").collect()]
    doc = xml.dom.minidom.parseString("".join(lines))
    assert len(doc.getElementsByTagName("node")) == 2 and doc.getElementsByTagName("edge")[0].getAttribute("source") == "a<b"


def test_incremental(spark, tmp_path):
    schema = "entity_name string, entity_types array<string>, descriptions array<string>, source_chunks array<string>"
    files, out, checkpoint = (str(tmp_path / x) for x in ("files", "out", "checkpoint"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        ingest.run_groups(ingest.new_files(spark, files, schema), out, checkpoint).awaitTermination()
        return {r["name"]: (r["n"], r["types"]) for r in ingest.merged_groups(spark.read.parquet(out)).collect()}

    assert add([("a", ["x"], None, None), (" A ", ["y"], ["d"], ["c"])]) == {"A": (2, ["x", "y"])}
    assert add([("a", ["z"], None, None), ("b", None, None, None)]) == {"A": (3, ["x", "y", "z"]), "B": (1, None)}


def test_json_array_file(spark, tmp_path):
    import glob
    import json

    from kgweave.sources import writers

    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "n int, s string, l array<int>")
    writers.json_array(df, str(tmp_path / "j"))
    read = lambda d: json.loads("".join(open(f).read() for f in glob.glob(f"{tmp_path}/{d}/part*")))
    assert read("j") == [{"n": 1, "s": "a", "l": [1, 2]}, {"n": 2, "s": None, "l": []}]
    writers.json_array(df.limit(0), str(tmp_path / "e"))
    assert read("e") == []
    try:
        writers.json_array(df, str(tmp_path / "x"), most_rows=1)
    except ValueError:
        return
    raise AssertionError


def test_rules_from_a_file(spark, tmp_path):
    from kgweave.operators.records import rules_from

    (tmp_path / "r.json").write_text('[["a+", "b"], ["b", "c"]]')
    (tmp_path / "d.json").write_text('{"x": "y", "é": ""}')
    assert rules_from(spark, str(tmp_path / "r.json")) == [("a+", "b"), ("b", "c")] and rules_from(spark, str(tmp_path / "d.json")) == [("x", "y"), ("é", "")]
