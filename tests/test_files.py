"""Version-1 archives, bounded samples, growing detection, trials, progress, failures and the command line."""

import io
import json
import os

import pytest

from lithograin import cli, errors, progress, trials, verbs
from lithograin.sources import archive, archive_v1, bounded, delimited

CSV = b"code,message\r\n" + b"AA,repeated-message\r\n" * 400
UNIQUE = b"value,tag\n" + b"".join(b"v%d,%d\n" % (i, i * i) for i in range(300))


def put(tmp_path, data, name="a.csv"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_v1_head_layout():
    head = archive_v1.head_bytes("csv", 810, "csv_columnar_dictionary")
    assert head[:5] == b"DPACK" and head[5:7] == b"\1\0" and head[7] == 1 and len(head) == 16 + int.from_bytes(head[8:16], "little")
    got = archive_v1.read_head(io.BytesIO(head))
    assert (got.file_type, got.original_size, got.payload, got.payload_offset) == ("csv", 810, "csv_columnar_dictionary", len(head))
    for broken, stage in ((b"X" + head[1:], "header"), (head[:7] + b"\7" + head[8:], "header"), (head[:-1], "metadata"), (head[:16] + b"\2" + head[17:], "metadata")):
        with pytest.raises(archive.InvalidArchive) as e:
            archive_v1.read_head(io.BytesIO(broken))
        assert e.value.stage == stage


@pytest.mark.parametrize("data,mode", [(CSV, "csv_columnar_dictionary"), (UNIQUE, "raw_zstd"), (b"no table here\n", "raw_zstd"), (b"a,b\n1,2\n3\n", "raw_zstd")])
def test_v1_round_trip(spark, tmp_path, data, mode):
    source, packed, back = put(tmp_path, data), str(tmp_path / "p"), str(tmp_path / "b")
    assert verbs.compress_v1(spark, source, packed)["selected_mode"] == mode
    assert verbs.decompress(spark, packed, back)["archive_version"] == 1 and open(back, "rb").read() == data
    got = verbs.validate(spark, packed, against=source)
    assert got["valid"] and got["against"] and got["checks"]["chunk_table"] == "not_applicable" and got["checks"]["global_sha256"] == "not_available"
    whole = open(packed, "rb").read()
    for broken, code in ((whole[:-3], "V1_PAYLOAD_INVALID"), (whole + b"!", "V1_PAYLOAD_INVALID"), (whole[:20], "V1_HEADER_OR_METADATA_INVALID")):
        got = verbs.validate(spark, put(tmp_path, broken, "x"))
        assert not got["valid"] and got["diagnostics"] == [code]


def test_v1_best_keeps_the_smaller(spark, tmp_path):
    for data in (CSV, UNIQUE):
        got = verbs.compress_v1(spark, put(tmp_path, data), str(tmp_path / "p"), verify_best=True, overwrite=True)
        raw = len(archive_v1.pack_raw(data, "csv"))
        assert got["archive_bytes"] <= raw


def test_limits_on_reading(spark, tmp_path):
    source, packed = put(tmp_path, CSV), str(tmp_path / "p")
    verbs.compress(spark, source, packed, chunk=64)
    got = verbs.validate(spark, packed, limits=verbs.ArchiveLimits(chunks=3))
    assert not got["valid"] and got["diagnostics"] == ["CHUNK_COUNT_LIMIT_REACHED"] and got["checks"]["decompression"] == "not_completed"
    with pytest.raises(verbs.LimitReached):
        verbs.decompress(spark, packed, str(tmp_path / "b"), limits=verbs.ArchiveLimits(output_bytes=10))
    assert not os.path.exists(tmp_path / "b")


def test_sample_stops_at_rows_and_scales(spark, tmp_path):
    data = b"id,kind\n" + b"".join(b"%05d,%s\n" % (i, b"ab"[i % 2 : i % 2 + 1]) for i in range(5000))
    seen = verbs.analyze(spark, put(tmp_path, data), sample=bounded.Sample(1, 1000))
    assert seen.sampling["limit_reached"] == "record_limit" and seen.sampling["records"] == 1000 and seen.sampling["scope"] == "sampled"
    rows = {r.column_name: r for r in seen.plan.collect()}
    assert rows["id"].observed_values == 1000 and 4990 <= rows["id"].projected_rows <= 5010
    assert [r.code for r in seen.diagnostics.collect()] == ["SAMPLE_RECORD_LIMIT_REACHED"]
    whole = verbs.analyze(spark, put(tmp_path, data))
    assert whole.sampling["completeness"] == "complete" and whole.facts.first().observed_values == 5000


def test_limits_of_analysis(tmp_path):
    path = put(tmp_path, b"a,b\n1,2\n" + b"x" * 500 + b",2\n3,4\n")
    seen = bounded.look(path, b",", limits=bounded.Limits(record_bytes=100))
    assert seen.limitations == ["RECORD_BYTE_LIMIT_REACHED"] and seen.rows == [["1", "2"]]
    assert bounded.look(path, b",", limits=bounded.Limits(header_bytes=2)).limitations == ["HEADER_BYTE_LIMIT_REACHED"]
    assert bounded.look(path, b",", limits=bounded.Limits(columns=1)).limitations == ["COLUMN_LIMIT_REACHED"]
    assert bounded.look(path, b",", limits=bounded.Limits(memory_bytes=1)).limitations == ["ANALYSIS_MEMORY_LIMIT_REACHED"]
    assert bounded.look(path, b",", scope=2).limitations == ["INCOMPLETE_HEADER_SAMPLE"]


def test_logical_records_hold_newlines(spark, tmp_path):
    data = b'id|note\n1|"left|right\nup|down"\n2|"a ""quoted"" value"\n'
    path = put(tmp_path, data, "a.psv")
    assert bounded.look(path, b"|").rows == [["1", '"left|right\nup|down"'], ["2", '"a ""quoted"" value"']]
    for sample in (None, bounded.Sample()):
        seen = verbs.analyze(spark, path, sample=sample)
        assert seen.delimiter == b"|" and [r.cardinality_value for r in seen.facts.orderBy("column_index").collect()] == [2, 2]


def test_tabs_crlf_and_no_final_newline(spark, tmp_path):
    path = put(tmp_path, "id\tcity\tnote\r\n1\t東京\t\r\n2\t\tvacío".encode(), "a.tsv")
    seen = verbs.analyze(spark, path, sample=bounded.Sample())
    assert seen.delimiter == b"\t" and seen.sampling["final_newline"] is False and [r.empty_values for r in seen.facts.orderBy("column_index").collect()] == [0, 1, 1]
    assert [r.empty_values for r in verbs.analyze(spark, path).facts.orderBy("column_index").collect()] == [0, 1, 1]


def test_header_is_read_once_over_many_splits(spark, tmp_path):
    data = b"id,x\n" + b"".join(b"%d,y\n" % i for i in range(20000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = verbs.analyze(spark, put(tmp_path, data)).facts.orderBy("column_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows[0].observed_values == 20000 and rows[0].numeric_values == 20000


def growing(data, **k):
    return delimited.detect_growing(iter(data.splitlines(keepends=True)), **k)[:2]


def test_growing_detection():
    assert growing(b"a|b\n1|2\n") == ("detected", b"|")
    assert growing(b"a,b|c\n1,2|3\n")[0] == "ambiguous" and growing(b"alpha\nbeta\n")[0] == "undetected"
    assert growing(b'a;b\n1;"open\n') == ("detected", b";")
    assert growing(b'"open\n') == ("legacy", b",")
    assert growing(b"x" * 50 + b"\n", max_bytes=20)[0] == "limited" and growing(b"a,b" + b"x" * 50 + b"\n", max_bytes=20) == ("detected", b",")
    with pytest.raises(delimited.Malformed):
        delimited.detect(b"a,b\n1,2\r3,4\n")


def test_safety(tmp_path):
    for data, want in ((b"a,b\n1,2\n", "simple"), (b'a,b\n"1",2\n', "requires_rfc4180"), (b"a,b\n1\n", "unsupported"), (b'a,b\n"1,2\n', "unsupported")):
        assert bounded.safety(put(tmp_path, data), b",") == want


def test_progress_and_cancellation(spark, tmp_path):
    seen = []
    source = put(tmp_path, CSV)
    verbs.compress(spark, source, str(tmp_path / "p"), chunk=1000, op=progress.Operation("compress", seen.append))
    assert seen[-1].is_success and all(0 <= (e.percentage or 0) <= 100 for e in seen)
    states = [(e.phase, e.state) for e in seen]
    assert states.index(("compressing", "started")) < states.index(("compressing", "completed")) < states.index(("writing_archive", "started"))
    token = progress.Token()

    def stop(event):
        if event.phase == "writing_archive":
            token.cancel()

    with pytest.raises(errors.Cancelled):
        verbs.compress(spark, source, str(tmp_path / "q"), chunk=1000, op=progress.Operation("compress", stop, token))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "p"]
    empty, half = progress.Count(0, 0), progress.Count(5, 10)
    assert progress.Event("x", "y", "completed", empty).percentage == 100 and progress.Event("x", "y", "started", empty).percentage is None
    assert progress.Event("x", "y", "advanced", half).percentage == 50 and progress.Event("x", "y", "completed").percentage is None


def test_benchmark(spark, tmp_path):
    source = put(tmp_path, CSV)
    got = trials.benchmark(spark, source, trials.Options(runs=1, chunked=True))
    assert got["benchmark_scope"] == "full" and got["validation_status"] == "validated" and {"planned", "raw", "chunked", "zstd"} <= set(got) and isinstance(got["plan_was_correct"], bool)
    got = trials.benchmark(spark, source, trials.Options(runs=1, no_roundtrip=True, no_baseline=True))
    assert got["benchmark_scope"] == "partial" and got["validation_status"] == "not_validated" and len(got["partial_reasons"]) == 2 and "zstd" not in got
    assert "planned" not in trials.benchmark(spark, source, trials.Options(estimate_only=True))
    assert os.listdir(tmp_path) == ["a.csv"]


def test_tune(spark, tmp_path):
    got = trials.tune(spark, put(tmp_path, CSV), chunk_sizes_mb=(1, 2), threads=(2, 1, 2), runs=2)
    lines = open(got["output"]).read().splitlines()
    assert len(trials.COLUMNS) == 32 and lines[0].split(",") == trials.COLUMNS and len(lines) == 9 and set(got["recommendations"]) == {"throughput", "ratio", "balanced"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "a_tune.csv"]


def test_command_line(spark, tmp_path, capsys):
    source, packed, back = put(tmp_path, CSV), str(tmp_path / "p"), str(tmp_path / "b")
    run = lambda *a: cli.main(list(a), spark)
    assert run("analyze", source, "--json") == 0
    report = json.loads(capsys.readouterr().out)
    assert report["planner"]["table"]["mode"] == "csv_columnar_dictionary" and [c["strategy"] for c in report["planner"]["columns"]] == ["dictionary", "dictionary"]
    assert run("advisor", source, "--json") == 0 and json.loads(capsys.readouterr().out)["recommendations"][0]["code"] == "STRUCTURED_COMPRESSION_RECOMMENDED"
    assert run("compress", source, packed) == 0 and run("decompress", packed, back) == 0 and open(back, "rb").read() == CSV
    assert run("compress", source, packed) == 2 and "output_not_writable" in capsys.readouterr().err
    assert run("compress", source, packed, "--force", "--chunk-size-mb", "1") == 0 and run("validate", packed, "--against", source) == 0
    assert run("generate-test-data", "repetitive", str(tmp_path / "g.csv"), "--rows", "50", "--seed", "42") == 0
    assert run("generate-test-data", "none", str(tmp_path / "h.csv")) == 1 and run("generate-test-data", "random", str(tmp_path / "h.csv"), "--rows", "0") == 3
    assert run("analyze", put(tmp_path, b"", "e.csv")) == 2 and run("analyze", str(tmp_path / "missing.csv")) == 1


def test_version_1_with_analysis_blocks(spark, tmp_path):
    import struct

    data = CSV
    text = lambda x: struct.pack("<Q", len(x.encode())) + x.encode()
    column = text("Größe") + struct.pack("<QQQdI", 9, 3, 6, 1.5, 3)
    preview = text("x") + struct.pack("<QQ", 2, 2) + text("a") + text("é") + struct.pack("<QIII", 3, 0, 1, 0)
    csv = b"," + struct.pack("<IBQ", 1, 1, 9) + struct.pack("<Q", 2) + column * 2 + struct.pack("<Q", 1) + preview
    txt = struct.pack("<QQQ", 5, 1, 1) + text("one two three") + struct.pack("<Q", 2) + text("note")
    packed = archive_v1.pack_raw(data, "csv")
    head = archive_v1.FIXED
    length = struct.unpack("<Q", packed[head - 8 : head])[0]
    meta, payload = packed[head : head + length], packed[head + length :]
    assert meta[18:20] == b"\0\0"
    for blocks, good in ((b"\1" + csv + b"\1" + txt, True), (b"\1" + csv + b"\0", True), (b"\0\1" + txt, True), (b"\1" + csv[:-3] + b"\0", False), (b"\2\0", False), (b"\1" + csv.replace(b"\xc3\xa9", b"\xff\xff") + b"\0", False)):
        full = meta[:18] + blocks + meta[20:]
        whole = packed[: head - 8] + struct.pack("<Q", len(full)) + full + payload
        source, back = put(tmp_path, whole, "blocks"), str(tmp_path / "back")
        if good:
            verbs.decompress(spark, source, back, overwrite=True)
            assert open(back, "rb").read() == data
        else:
            with pytest.raises(Exception):
                verbs.decompress(spark, source, back, overwrite=True)
