import base64
import hashlib

import pytest

from pdpspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    holder = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            holder[b] = max(holder.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = holder.get(b)
        revisit = own is not None and own != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", own if revisit else None, True))
    return sorted(out, key=repr)


FORGED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a.example/x y\r\n", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "u", "\r\n\r\n"), (5, "u", "a\r\n"), (6, "u", "\r\na\r\n\r\n\r\nb"),
    (7, "u", FORGED), (8, "u", FORGED * 40 + "é" * 500), (9, "u", "<p>one</p>"), (9, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "alone"),
    (10, "u", "x" * 5000), (11, "u", "\r\n\r\n".join("y" * 300 for _ in range(40))), (12, "u", "WARC/1.1\r\n"), (13, "u", "tail WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 900"),
]


@pytest.mark.parametrize("split", ["700", "4096", "128m"])
def test_records_come_back_whole(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA), 100).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS, 100)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
