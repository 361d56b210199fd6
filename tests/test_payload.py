"""Batch payloads: golden lines and refused shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tableferry.sources.payload import parse_payloads, payload_rows, write_payloads

# Six rows of six columns with escapes, empty texts and NULLs.
GOLDEN = [
    ["12345678901234567890123456789012345678", "张三", 'he said "hi" \\ done', "", "2026-08-13 09:15:30", None],
    ["0.5", "李四", "tab\there", "", "2026-01-01 00:00:00", "7"],
    ["-0.01", "中文测试值", "", "", "2026-12-31 23:59:59", None],
    ["0", None, "", "", "2026-08-13 00:00:00", "0"],
    ["1.23", "", '\\"', "", "2028-02-29 12:00:00", "-42"],
    [None, "混合 mixed 值", "line1\nline2", "", "2026-08-13 23:59:59", None],
]


def parsed(spark, line, width=2):
    return parse_payloads(spark.createDataFrame([(line,)], "value string"), width).first()


def test_golden_payload_round_trip(spark):
    line = json.dumps({"seq": 1, "rows": GOLDEN}, ensure_ascii=False)
    df = parse_payloads(spark.createDataFrame([(line,)], "value string"), 6)
    row = df.first()
    assert (row["seq"], row["reason"], row["rows"]) == (1, None, GOLDEN)
    names = [f"c{i}" for i in range(6)]
    back = payload_rows(df, names)
    sent = write_payloads(back, F.array(*names)).first()
    assert json.loads(sent["payload"]) == {"seq": 1, "rows": GOLDEN}
    assert sent["payload"] == json.dumps({"seq": 1, "rows": GOLDEN}, ensure_ascii=False, separators=(",", ":"))
    assert (sent["rows"], sent["bytes"]) == (6, len(sent["payload"].encode()))


@pytest.mark.parametrize(
    "line",
    [
        '{"seq":1,"rows":[["a",1]]}', '{"seq":1,"rows":[["a",true]]}', '{"seq":1,"rows":[["a",["b"]]]}',
        '{"seq":1,"rows":[["a","b"]],"x":1}', '{"rows":[["a","b"]]}', '{"seq":1}', '{"seq":"1","rows":[["a","b"]]}',
        '{"seq":1.5,"rows":[["a","b"]]}', '{"seq":-1,"rows":[["a","b"]]}', '{"seq":1,"rows":[null]}', '{"seq":1,"rows":null}',
        '{"seq":null,"rows":[]}', '{"seq":1,"rows":[["a","b"]', "", "[]", "null", '{"seq":1,"seq":2,"rows":[]}',
        '{"seq":1,"rows":[["a",null],["b",2]]}', '{"seq":1,"rows":[["a","b"]]} trailing', '{"seq":1,"rows":[]}{"seq":2,"rows":[]}',
        '{"seq":1,"rows":[]},{"seq":2,"rows":[]}', '{"seq":1,"rows":[]}],[1', '{"seq":1,"rows":[]}},{"p":1', '{"seq":1,"rows":[]},"q":1',
    ],
)
def test_refused_shapes(spark, line):
    assert parsed(spark, line)["reason"] == "BAD_SHAPE"


@pytest.mark.parametrize("line", ['{"seq":1,"rows":[["a"]]}', '{"seq":1,"rows":[["a","b"],["a","b","c"]]}', '{"seq":1,"rows":[[]]}'])
def test_wrong_width(spark, line):
    assert parsed(spark, line)["reason"] == "BAD_WIDTH"


@pytest.mark.parametrize("line, rows", [('{"seq":1,"rows":[]}', []), ('{"seq":1,"rows":[[null,null]]}', [[None, None]]), (' {"rows":[["",null]],"seq":7} ', [["", None]])])
def test_accepted_edges(spark, line, rows):
    row = parsed(spark, line)
    assert (row["reason"], row["rows"]) == (None, rows)


def test_payload_over_the_byte_budget(spark):
    """A long payload is parsed whole."""
    line = json.dumps({"seq": 3, "rows": [["x" * 1000, None]] * 20000})
    row = parse_payloads(spark.createDataFrame([(line,)], "value string"), 2).select("reason", F.size("rows").alias("n")).first()
    assert (row["reason"], row["n"]) == (None, 20000)
