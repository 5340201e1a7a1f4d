"""Frozen planner cases, lexer edges, codec round trips and corrupted archives."""

import random

import pytest

from lithograin.operators import codec, profile
from lithograin.plans import policy
from lithograin.sources import archive, delimited


def planned(spark, header, rows):
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    return {r.column_name: r for r in policy.column_plan(profile.column_facts(df, "t")).collect()}


def test_quoted_fields_plan(spark):
    plan = planned(spark, ["id", "note", "status"], [("1", '"hello, world"', "open"), ("2", '"hello, world"', "open"), ("3", "plain", "closed")])
    assert [(plan[c].encoded_bytes, plan[c].raw_bytes) for c in ("id", "note", "status")] == [(18, 6), (33, 36), (21, 17)]


def test_unfavourable_plan(spark):
    plan = planned(spark, ["id", "value"], [(str(i), v) for i, v in enumerate(["alpha", "beta", "gamma", "delta"], 1)])
    assert (plan["id"].strategy, plan["value"].strategy) == ("delta_candidate", "plain")


def test_repetitive_plan_saves(spark):
    df = spark.createDataFrame([("AA", "repeated-message")] * 4, "code string, message string")
    row = policy.table_plan(policy.column_plan(profile.column_facts(df, "t"))).first()
    assert row.mode == "csv_columnar_dictionary" and row.savings_percent == 57.5 and row.reason == "High repetition detected in 2/2 columns."


def test_numeric_grammar(spark):
    values = [("1", 1), ("-1.5e3", 1), (".5", 1), ("5.", 1), ("inf", 1), ("-NaN", 1), ("1d", 0), (" 1", 0), ("1_0", 0), ("", 0), ("0x10", 0), (".", 0), ("1\n", 0)]
    from lithograin.functions.fields import is_numeric
    from pyspark.sql import functions as F

    df = spark.createDataFrame(values, "v string, want int")
    assert df.filter(is_numeric(F.col("v")).cast("int") != F.col("want")).count() == 0


def test_lexer():
    assert delimited.records(b'a|b\n1|"x|y\nz"\r\n2|"a ""q"" b"', b"|") == [[b"a", b"b"], [b"1", b'"x|y\nz"'], [b"2", b'"a ""q"" b"']]
    assert delimited.records(b"") == [] and delimited.records(b"a,\n") == [[b"a", b""]] and delimited.records(b"a,") == [[b"a", b""]]
    with pytest.raises(delimited.Malformed):
        delimited.records(b'a,"b')
    assert delimited.detect(b"id,note|tag\n1,foo\n2,bar\n") == ("detected", b",")
    assert delimited.detect(b"a,b|c\n1,2|3\n") == ("ambiguous", None)
    assert delimited.detect(b"alpha\nbeta\n") == ("undetected", None)
    assert delimited.split_legacy('a,"b,c",d') == ["a", '"b,c"', "d"]


def test_payload_round_trip():
    rnd = random.Random(1)
    for _ in range(50):
        width = rnd.randint(1, 5)
        rows = [[bytes(rnd.choice(b"ab,\xc3\xa9") for _ in range(rnd.randint(0, 4))) for _ in range(width)] for _ in range(rnd.randint(1, 300))]
        data = codec.write_payload(rows, [rnd.choice(["plain", "dictionary"]) for _ in range(width)], b";", b"\r\n", True)
        text = b"\r\n".join(b";".join(r) for r in rows) + b"\r\n"
        assert codec.read_payload(data, len(text)) == text
        with pytest.raises(ValueError):
            codec.read_payload(data[:-1], len(text))


def test_archive(spark, tmp_path):
    data = random.Random(2).randbytes(5000) + b"x" * 5000
    packed = archive.pack(data, 700)
    assert archive.unpack(packed) == data and archive.unpack(archive.pack(b"", 10)) == b""
    for at in (0, 5, 7, 10, 20, 50, 58, 64, 72, 80, 96, 105, 110, 142, len(packed) - 3):
        broken = bytearray(packed)
        broken[at] ^= 0xFF
        with pytest.raises(archive.InvalidArchive):
            archive.unpack(bytes(broken))
    for broken in (packed[:-1], packed + b"x", packed[:40]):
        with pytest.raises(archive.InvalidArchive):
            archive.unpack(broken)
    path = str(tmp_path / "a.bin")
    archive.write_file(path, packed)
    with pytest.raises(FileExistsError):
        archive.write_file(path, packed)
    spark.dataSource.register(archive.ArchiveSource)
    rows = spark.read.format("lithograin-archive").load(path).orderBy("chunk_id").collect()
    assert b"".join(r.data for r in rows) == data and len(rows) == 15


def test_entry_imports(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 11
