import os

import pytest

from lithograin import verbs
from lithograin.operators import profile
from lithograin.sources import archive
from lithograin.streaming.profile import stream_facts

DIR = "/root/testdata/sf0.001"


def put(tmp_path, data, name="a.csv"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(
    "data,strategies,uniques,lengths",
    [
        (b"count,bird,seen\n10,heron,yes\n20,coot,yes\n30,grebe,no\n40,teal,yes\n", ["delta_candidate", "plain", "dictionary"], [4, 4, 2], [2.0, 4.5, 2.8]),
        (b'price,label\n5,"a,b"\n6,"a,b"\n7,"c,d,e"\n8,"a,b"\n9,"a,b"\n', ["delta_candidate", "dictionary"], [5, 2], [1.0, 5.4]),
        ("qty,stadt,etwas\n7,Köln,\n8,Köln,\n9,Köln,é\n".encode(), ["delta_candidate", "dictionary", "dictionary"], [3, 1, 2], [1.0, 5.0, 0.7]),
    ],
)
def test_analyze(spark, tmp_path, data, strategies, uniques, lengths):
    rows = verbs.analyze(spark, put(tmp_path, data)).plan.orderBy("column_index").collect()
    assert [r.strategy for r in rows] == strategies
    assert [r.cardinality_value for r in rows] == uniques
    assert [round(r.mean_len, 1) for r in rows] == lengths


@pytest.mark.parametrize("data", [b"", b"a,b\n1,2\n3,4,5\n", b"alpha\nbeta\n", b"a,b|c\n1,2|3\n"])
def test_analyze_refuses(spark, tmp_path, data):
    with pytest.raises(verbs.BadInput):
        verbs.analyze(spark, put(tmp_path, data))


@pytest.mark.parametrize("n", [0, 1, 64, 5000])
def test_archive_round_trip(spark, tmp_path, n):
    data = os.urandom(n // 2) + b"x" * (n - n // 2)
    source, packed, back = put(tmp_path, data), str(tmp_path / "a.pack"), str(tmp_path / "b")
    report = verbs.compress(spark, source, packed, chunk=64)
    assert open(packed, "rb").read() == archive.pack(data, 64) and report["archive_bytes"] == os.path.getsize(packed)
    verbs.decompress(spark, packed, back)
    assert open(back, "rb").read() == data
    got = verbs.validate(spark, packed, against=source)
    assert got["valid"] and got["against"] and set(got["checks"].values()) == {"passed"}
    with pytest.raises(FileExistsError):
        verbs.compress(spark, source, packed)


def test_validate_names_the_failing_check(spark, tmp_path):
    data = archive.pack(b"abc" * 500, 64)
    for name, broken, check in (
        ("magic", b"X" + data[1:], "header"),
        ("tail", data + b"!", "trailing_data"),
        ("digest", data[:16] + bytes(32) + data[48:], "global_sha256"),
        ("chunk", data[: archive.HEAD + 45] + bytes(32) + data[archive.HEAD + 77 :], "per_chunk_sha256"),
    ):
        got = verbs.validate(spark, put(tmp_path, broken, name))
        assert not got["valid"] and [c for c, s in got["checks"].items() if s == "failed"] == [check]
        with pytest.raises(Exception):
            verbs.decompress(spark, str(tmp_path / name), str(tmp_path / "out"))
        assert not any(p.name.startswith("out") for p in tmp_path.iterdir())


def test_compare(spark, tmp_path):
    got = verbs.compare(spark, put(tmp_path, b"a,b\n1,2\n" * 2000), str(tmp_path), runs=2, chunk=4096)
    assert got["winners"]["bytes"] in ("archive", "zstd", "tie") and [p.name for p in tmp_path.iterdir()] == ["a.csv"]


def test_stream_facts_equal_the_batch(spark, tmp_path):
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    orders.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_facts(stream).writeStream.format("memory").queryName("facts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(100)
    columns = ["column_index", "observed_values", "empty_values", "numeric_values", "min_len", "max_len", "total_bytes"]
    assert sorted(map(tuple, spark.table("facts").select(*columns).collect())) == sorted(map(tuple, profile.column_facts(orders, "orders").select(*columns).collect()))


def test_output_keeps_the_previous_file_on_failure(spark, tmp_path):
    target = put(tmp_path, b"old", "out")
    with pytest.raises(RuntimeError), verbs._output(target, True) as f:
        f.write(b"half")
        raise RuntimeError
    assert open(target, "rb").read() == b"old"
    with verbs._output(target, True) as f:
        f.write(b"new")
    assert open(target, "rb").read() == b"new" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_snapshot(tmp_path):
    source = put(tmp_path, b"0123456789")
    whole, cut = verbs.snapshot(source, str(tmp_path))
    assert open(whole, "rb").read() == b"0123456789" and not cut
    part, cut = verbs.snapshot(source, str(tmp_path), 4)
    assert open(part, "rb").read() == b"0123" and cut


def test_chunk_options(spark, tmp_path):
    data = os.urandom(500) + b"y" * 500
    source, packed = put(tmp_path, data), str(tmp_path / "p")
    got = verbs.compress(spark, source, packed, chunk=100, in_flight=2, backend="zstd-mt-experimental", threads=2)
    assert got["chunks"] == 10 and 0 <= got["chunk_seconds"]["least"] <= got["chunk_seconds"]["average"] <= got["chunk_seconds"]["most"]
    assert verbs.decompress(spark, packed, str(tmp_path / "b"), verify=False)["sha256"] is None and open(tmp_path / "b", "rb").read() == data
    for bad in ({"in_flight": 0}, {"backend": "other"}, {"in_flight": 3, "max_memory": 299}):
        with pytest.raises(verbs.BadOption):
            verbs.compress(spark, source, str(tmp_path / "q"), chunk=100, **bad)


def test_analyze_bytes(spark):
    got = verbs.analyze_bytes(spark, "a.csv", b"name,kind\r\n7,red\r\n7,red\r\n9,blue\r\n")
    assert got["file_type"] == "csv" and got["original_size"] == 33 and got["txt"] is None
    csv = got["csv"]
    assert (csv["delimiter"], csv["has_header"], csv["newline"], csv["rows"]) == ("comma", True, "crlf", 3)
    assert [(c["column_name"], c["unique_values"], c["repeated_values"], c["all_numeric"]) for c in csv["columns"]] == [("name", 2, 1, True), ("kind", 2, 1, False)]
    got = verbs.analyze_bytes(spark, "a.log", b"one two three\none two three\nelse\n")
    assert got["file_type"] == "txt" and got["txt"]["lines"] == 3 and got["txt"]["phrases"] == [{"phrase": "one two three", "n": 2}]
    assert verbs.analyze_bytes(spark, "a.csv", b"")["csv"]["columns"] == []


def test_stored_reason():
    from lithograin.plans import policy

    assert policy.stored_reason("x" * 130) == "x" * 120 and policy.stored_reason("é" * 61) == "é" * 60 and policy.stored_reason("x" + "é" * 60) == "x" + "é" * 59
