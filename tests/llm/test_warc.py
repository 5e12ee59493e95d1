import base64
import hashlib
import random

from mediatally.llm import warc as W
from mediatally.session import new_stage

INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        own = first.setdefault(payload, i) if len(payload) >= least else i
        out.append((i, len(payload), digest(payload), "response" if own == i else "revisit", None if own == i else own))
    return sorted(out, key=repr)


def there_and_back(spark, rows, least=0, parts=2):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(parts)
    folder = new_stage(spark, "warc-test")
    W.write_archives(df, folder, least)
    found = W.read_archives(spark, folder).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)


def test_magic_inside_payloads_and_small_byte_ranges(spark):
    rng = random.Random(3)
    rows = []
    for i in range(250):
        html = [
            "x" * rng.randrange(300), INNER * rng.randrange(1, 4), "ab WARC/1.0", "WARC/1.0\r\n", "", None, "dup", f"é\r\n\r\nWARC/1.0\r\nfoo{INNER}",
            "WARC/1.0\r\n" * rng.randrange(1, 80) + "z" * rng.randrange(4000),
        ][rng.randrange(9)]
        rows.append((i, rng.choice([None, "http://x/WARC/1.0", "http://y\r\nContent-Length: 3", "u"]), html))
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert there_and_back(spark, rows) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_payload_repeats_nulls_and_least(spark):
    rows = [(i, "u", "same everywhere") for i in range(200)] + [(500, "u", "x"), (501, "u", "x"), (502, None, None), (503, "u", "")]
    assert there_and_back(spark, rows) == expected(rows)
    assert there_and_back(spark, rows, least=5) == expected(rows, least=5)
    again = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "b")]
    found = there_and_back(spark, again)
    assert [r[3:] for r in found if r[0] == 1] == [("response", None)] * 2 and (2, 1, digest(b"a"), "revisit", 1) in found
    assert there_and_back(spark, []) == []


def test_urls_cannot_break_a_header(spark):
    folder = new_stage(spark, "warc-test")
    W.write_archives(spark.createDataFrame([(1, "http://a/\r\nX: 1", "p"), (2, "WARC/1.0", "q")], "page_id long, url string, html string"), folder)
    assert {r.url for r in W.read_archives(spark, folder).collect()} == {"http://a/%0D%0AX: 1", "WARC%2F1.0"}


def test_long_url_in_the_middle_of_an_archive(spark):
    rows = [(i, "http://x/" + ("y" * 100_000 if i == 5 else ""), f"page {i}") for i in range(10)]
    folder = new_stage(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    assert {(r.page_id, r.url) for r in W.read_archives(spark, folder).collect()} == {r[:2] for r in rows}


def test_damaged_archive_ends_there(spark, tmp_path):
    whole = INNER.replace("99999", "1")
    (tmp_path / "a.warc").write_bytes((whole + INNER.replace("99999", "2").replace("Length: 5", "Length: 50") + whole).encode())
    assert [r.page_id for r in W.read_archives(spark, str(tmp_path)).collect()] in ([1], [1, 2])
