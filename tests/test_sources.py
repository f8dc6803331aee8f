import json

from pyspark.sql import types as T

from aliasmith.operators.aliases import clean_table
from aliasmith.sources import files, kafka
from aliasmith.session import scratch_folder


def test_delimited_round_trip_keeps_null_and_empty(spark, tmp_path):
    rows = [("1", "a,b", None, "", "x;y", None, "z")]
    df = spark.createDataFrame(rows, files.WATCH_LIST)
    path = str(tmp_path / "list")
    files.write_delimited(df, path, null_mark="null")
    assert [tuple(r) for r in files.read_delimited(spark, path, files.WATCH_LIST, null_mark="null").collect()] == rows


def test_malformed_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n;s\n1;a\nx;b\n")
    schema = T.StructType.fromDDL("n int, s string")
    df = files.read_delimited(spark, str(tmp_path / "t.csv"), schema, separator=";", keep_corrupt=True).cache()
    assert [tuple(r) for r in df.orderBy("s").collect()] == [(1, "a", None), (None, "b", "x;b")]


def test_header_is_optional_and_encoding_is_honoured(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("é|b\n".encode("iso-8859-1"))
    schema = T.StructType.fromDDL("a string, b string")
    df = files.read_delimited(spark, str(tmp_path / "t.csv"), schema, header=False, encoding="ISO-8859-1")
    assert tuple(df.first()) == ("é", "b")


def test_alias_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("john smith|jon smyth\nsingle\n")
    assert [r.aliases for r in files.read_alias_lines(spark, str(tmp_path)).collect()] == [
        ["john smith", "jon smyth"],
        ["single"],
    ]


def test_raw_fields_in_latin_1(spark, tmp_path):
    (tmp_path / "raw.txt").write_bytes('Zoë "Z"|Müller, X|"q\n'.encode("iso-8859-1"))
    assert files.read_raw_fields(spark, str(tmp_path)).first().fields == ['Zoë "Z"', "Müller, X", '"q']


def test_pair_files_are_labelled_by_name(spark, tmp_path):
    folder = tmp_path / "true-or-false"
    folder.mkdir()
    (folder / "aliases-true.txt").write_text("a : b\n")
    (folder / "false-aliases.txt").write_text("c : d\n")
    (folder / "notes.txt").write_text("e\n")
    found = files.read_pair_files(spark, str(folder)).collect()
    assert sorted(tuple(r) for r in found) == [("a : b", 1.0), ("c : d", 0.0)]


def test_json_values_are_flattened(spark):
    schema = T.StructType.fromDDL("id int, who struct<name: string>")
    df = spark.createDataFrame([('{"id": 1, "who": {"name": "x"}}',), ("broken",)], "value string")
    flat = kafka.json_values(df, schema)
    assert flat.columns == ["id", "who_name"] and [tuple(r) for r in flat.collect()] == [(1, "x"), (None, None)]


def test_message_options():
    options = kafka.connector_options({"bootstrap.servers": "a:1", "kafka.group.id": 7})
    assert options == {"kafka.bootstrap.servers": "a:1", "kafka.group.id": "7"}
    ranges = kafka.offset_ranges("t", [(0, 10), (3, 5)])
    assert json.loads(ranges["assign"]) == {"t": [0, 3]} and "subscribe" not in ranges
    assert json.loads(ranges["startingOffsets"]) == {"t": {"0": 0, "3": 0}}
    assert json.loads(ranges["endingOffsets"]) == {"t": {"0": 10, "3": 5}}


def test_client_settings_that_the_connector_refuses():
    params = {
        "bootstrap.servers": "a:1",
        "key.deserializer": "x",
        "value.deserializer": "x",
        "group.id": "g",
        "auto.offset.reset": "latest",
        "enable.auto.commit": False,
    }
    assert kafka.connector_options(params) == {"kafka.bootstrap.servers": "a:1", "kafka.group.id": "g"}
    assert kafka.starting_offsets(params) == {"startingOffsets": "latest"}
    assert kafka.starting_offsets({}) == {}


def test_pair_files_are_labelled_below_their_folder_only(spark, tmp_path):
    folder = tmp_path / "true-run 1+2" / "my pairs"
    folder.mkdir(parents=True)
    (folder / "false-%41 a.txt").write_text("a : b\n")
    (folder / "true.txt").write_text("c : d\n")
    (folder / "notes.txt").write_text("e : f\n")
    (folder / "my pairs").mkdir()
    (folder / "my pairs" / "false.txt").write_text("g : h\n")
    found = {tuple(r) for r in files.read_pair_files(spark, str(folder)).collect()}
    assert found == {("a : b", 0.0), ("c : d", 1.0), ("g : h", 0.0)}


def test_raw_fields_are_cleaned_and_written_back(spark, tmp_path):
    (tmp_path / "raw").write_bytes("É-a|B|\nc|Ø d\n".encode("iso-8859-1"))
    cleaned = clean_table(files.read_raw_fields(spark, str(tmp_path / "raw")))
    files.write_raw_fields(cleaned, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["c| d", "ea|b|"]


def test_stopword_files(spark, tmp_path):
    (tmp_path / "stop").write_text("the\n\n of \n")
    assert sorted(r.word for r in files.read_stopwords(spark, str(tmp_path / "stop")).collect()) == ["of", "the"]


def test_message_text(spark):
    df = spark.createDataFrame([(bytearray(b"a;b"),)], "value binary")
    assert kafka.message_text(df).first().value == "a;b"


def test_scratch_folders_differ(spark):
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")
