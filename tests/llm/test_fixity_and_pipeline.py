import hashlib

import corpus_pipeline
from loomgraph.llm import fixity, queries

PAGE = "page_id long, url string, html string"


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(n)], PAGE).selectExpr("*", "1 AS file", "2 AS node")


def test_audit_locates_damage(spark):
    a = fixity.archive(pages(spark, 300), 100)
    rows = [tuple(r) for r in a.collect()]
    bad = [(f, o, n, "0" * 64 if p in (7, 150, 151) else d, p) for f, o, n, d, p in rows if p != 250] + [(9, 0, 5, "e" * 64, 999)]
    b = spark.createDataFrame(bad, a.schema)
    found = {(r.file, r.offset, r.kind) for r in fixity.audit(a, b).collect()}
    at = {p: (f, o) for f, o, _, _, p in rows}
    assert found == {(*at[7], "corrupt"), (*at[150], "corrupt"), (*at[151], "corrupt"), (*at[250], "missing"), (9, 0, "extra")}
    assert fixity.audit(a, a).count() == 0


def test_audit_finds_shifted_records_and_other_lengths(spark):
    a = fixity.archive(pages(spark, 40), 20)
    shifted = a.selectExpr("file", "if(file = 1, offset + 7, offset) AS offset", "if(page_id = 3, length + 1, length) AS length", "digest", "page_id")
    found = [(r.file, r.kind) for r in fixity.audit(a, shifted).collect()]
    assert sorted(found) == [(0, "corrupt")] + [(1, "extra")] * 20 + [(1, "missing")] * 20


def test_record_digests_and_offsets(spark):
    html = "é<b>"
    row = fixity.archive(spark.createDataFrame([(3, "http://u", html), (None, None, None)], PAGE)).orderBy("page_id").collect()
    body = html.encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: http://u\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    assert row[1].digest == hashlib.sha256(head + body + b"\r\n\r\n").hexdigest() and row[1].length == len(head) + len(body) + 4 and row[0].length > 0


def test_audit_rows(spark):
    schema = "file long, offset long, length long, digest string, page_id long"
    a = spark.createDataFrame([(1, 0, 5, "a", 1), (1, 0, 5, "b", 1), (None, 0, 5, "c", 2), (1, 9, 5, None, 3)], schema)
    empty = spark.createDataFrame([], schema)
    assert sorted(r.kind for r in fixity.audit(a, empty).collect()) == ["missing", "unplaced", "unplaced"]
    assert fixity.audit(empty, empty).count() == 0 and sorted(r.kind for r in fixity.audit(empty, a).collect()) == ["extra", "unplaced", "unplaced"]


def test_root_is_the_hash_of_ordered_children(spark):
    a = fixity.archive(pages(spark, 20), 100)
    levels = fixity.trees(a, a, 4, 1024)
    seal = lambda x: hashlib.sha256(x.encode()).hexdigest()
    below = {r.offset: seal(f"{r.offset}|{r.length}|{r.digest}") for r in a.collect()}
    assert {r["at"]: r.mine.seal for r in levels[0].collect()} == below
    for width, level in zip([1024, 4, 4, 4], levels[1:]):
        up = {}
        for at in sorted(below):
            up[at // width] = up.get(at // width, "") + below[at]
        below = {at: seal(x) for at, x in up.items()}
        assert {r["at"]: r.mine for r in level.collect()} == below and level.filter("mine <> theirs").count() == 0
    assert len(below) == 1


def test_equal_digests_at_other_offsets(spark):
    schema = "file long, offset long, length long, digest string"
    a = spark.createDataFrame([(1, 0, 9, "d"), (1, 10, 9, "d"), (1, 20, 9, "d")], schema)
    b = spark.createDataFrame([(1, 0, 9, "d"), (1, 10, 9, "d"), (1, 30, 9, "d")], schema)
    assert sorted((r.offset, r.kind) for r in fixity.audit(a, b).collect()) == [(20, "missing"), (30, "extra")]


def test_a_lost_record_opens_its_own_branch_only(spark):
    a = fixity.archive(pages(spark, 256), 1000)
    lost = a.filter("page_id <> 9")
    levels = fixity.trees(a, lost, 4, 1024)
    opened = [x.count() for x in fixity.descend(levels, 4, 1024)]
    assert levels[1].count() > 30 and opened == [1] * len(levels)


def test_stages_equal_the_operators_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "bpe_encoding"]
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        new = spark.createDataFrame(stage(spark, last, sf).collect(), stage(spark, last, sf).schema)
        if name != "bpe_encoding":
            assert new.columns == columns and new.count() <= last.count()
        if name == "line_dedup":
            assert new.filter("n_chars <> length(text)").count() == last.filter("n_chars <> length(text)").count() and new.count() == last.count()
        last = new
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.collect())) and run.filter("not round_trip").count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
