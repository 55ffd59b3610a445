import hashlib

from llm_helpers import rows_of

from tallyward.llm import warc

PAGES = "page_id BIGINT, url STRING, html STRING, archive STRING, record STRING"
CASES = [(i, f"http://x/{i}", f"<p>page {i}\r\n\r\n</p>" * (1 + i % 50)) for i in range(300)] + [(7000, None, None), (7001, "u", ""), (None, "n", "text"), (7002, "long", "é" * 200_000)]


def pages(spark, cases=CASES):
    return spark.createDataFrame([(*c, "a", "r") for c in cases], PAGES)


def leaves(spark, rows):
    return spark.createDataFrame(rows, "archive BIGINT, record_offset BIGINT, record_length BIGINT, record_id BIGINT, record_sha256 STRING")


def brute_force(a, b):
    places = {r[:2] for r in a + b}
    out = []
    for place in places:
        mine, other = (sorted((r[4], r[2]) for r in rows if r[:2] == place) for rows in (a, b))
        if mine != other:
            fault = "missing" if not other else "added" if not mine else "changed"
            out.append((*place, fault))
    return sorted(out)


def audited(spark, a, b):
    return sorted((r.archive, r.record_offset, r.fault) for r in warc.audit(leaves(spark, a), leaves(spark, b)).collect())


def test_files_round_trip(spark, tmp_path):
    records = warc.with_offsets(warc.warc_records(pages(spark)))
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w" / "*"))
    assert rows_of(back, "record_id", "url", "html") == sorted(((i, u or "", h or "") for i, u, h in CASES), key=lambda r: __import__("json").dumps(r, default=str))


def test_offsets_and_hashes(spark):
    ends = {}
    for r in sorted(warc.with_offsets(warc.warc_records(pages(spark))).collect(), key=lambda r: (r.archive, r.record_offset)):
        assert r.record_offset == ends.get(r.archive, 0)
        ends[r.archive] = r.record_offset + r.record_length
        assert r.record_sha256 == hashlib.sha256(r.record.encode()).hexdigest() and r.record_length == len(r.record.encode())


def test_audit_against_brute_force(spark):
    a = [(n, i * 5000, 5000, i, f"h{i}") for n in range(3) for i in range(400)]
    b = [r for r in a if r[:2] not in {(0, 0), (1, 1_995_000)}]
    b = [(*r[:4], "bad") if r[:2] in {(0, 15_000), (2, 990_000)} else r for r in b]
    b += [(1, 2_500, 10, 77, "new"), (2, 5000, 5000, 1, "h1"), (9, 0, 4, 1, "alone")]
    assert audited(spark, a, b) == brute_force(a, b)
    assert audited(spark, b, a) == brute_force(b, a)


def test_equal_and_empty(spark):
    a = [(1, 0, 5, 1, "x"), (1, 5, 5, 2, "y")]
    assert audited(spark, a, a) == [] and audited(spark, [], []) == []
    assert audited(spark, a, []) == brute_force(a, [])


def test_only_differing_branches_are_read(spark):
    a = [(1, i * 70_000, 70_000, i, f"h{i}") for i in range(200)]
    trees = [warc.merkle_levels(leaves(spark, rows), warc.level_count(leaves(spark, a))) for rows in (a, a[:50] + [(*a[50][:4], "bad")] + a[51:])]
    assert [level.count() for level in trees[0]] == [200, 14, 1]
    assert [warc._differing(x, y).count() for x, y in zip(*trees)] == [1, 1, 1]
