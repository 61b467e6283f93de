"""Archives: who is the response, null ids, repeated rows, payloads that many rows share, streams and their ends."""

import base64
import collections
import hashlib
import random

from lumenfield.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, hex string"


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, by lists."""
    groups = collections.defaultdict(list)
    for page, url, html in rows:
        groups[(html or "").encode()].append((page, url))
    out = []
    for raw, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        named = [m for m in members if m[0] is not None]
        if len(members) == 1 or not named or len(raw) < least:
            out += [(page, len(raw), digest, "response", None) for page, _ in members]
            continue
        first = min(named, key=lambda m: (m[0], m[1] is not None, m[1] or ""))
        out.append((first[0], len(raw), digest, "response", None))
        members.remove(first)
        out += [(page, len(raw), digest, "revisit", first[0]) for page, _ in members]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA)
    return sorted(map(tuple, warc.read(warc.archive(df, **more)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_null_ids_and_repeated_rows(spark):
    rows = [
        (None, "u", "twice"), (None, "v", "twice"), (None, "u", "named too"), (9, "u", "named too"), (None, None, None), (3, "a", ""),
        (5, "b", "again"), (5, "b", "again"), (5, "b", "again"), (7, "b", "again"), (6, "z", "urls"), (6, "y", "urls"), (6, None, "urls"), (8, None, "pair"), (8, None, "pair"), (1, "x", "alone"),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, least_bytes=5) == expected(rows, 5)
    assert found(spark, []) == []


def test_a_payload_that_most_rows_share(spark):
    rng = random.Random(1)
    rows = [(i, f"u{i % 5}", "hot " * 500 if rng.random() < 0.7 else f"page {rng.randrange(300)}") for i in rng.sample(range(10**6), 2000)]
    rows += rng.sample(rows, 100)
    assert found(spark, rows) == expected(rows)
