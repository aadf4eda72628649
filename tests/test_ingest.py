"""Indexing runs, versions, files and status rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fjelldoc.operators import embed, ingest
from fjelldoc.sources import files

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
DOCS = (
    "source_blob string, title string, content string, embedding array<float>, last_modified timestamp, file_hash string, indexing_status string, "
    "indexed_at timestamp, error_message string, created_at timestamp, updated_at timestamp"
)
CHUNKS = "document_id string, chunk_index int, text string, embedding array<float>"


def now():
    return F.lit(NOW)


@pytest.mark.parametrize("total, embedded, want", [(3, 3, "ready"), (3, 1, "partial"), (3, 0, "partial"), (0, 0, "partial"), (1, 1, "ready")])
def test_outcome(spark, total, embedded, want):
    df = spark.createDataFrame([(total, embedded)], "t int, e int")
    assert df.select(ingest.outcome_status(F.col("t"), F.col("e"))).first()[0] == want


def run(spark, docs, chunks, blobs, blocks, embedder=None, **options):
    return ingest.index_run(docs, chunks, blobs, blocks, embedder or embed.hashing_embedder(8), 8, now(), **options)


@pytest.fixture(scope="module")
def corpus(spark):
    stamp = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    blobs = spark.createDataFrame([("a/x.pdf", stamp, "h1"), ("a/y.v2.pdf", stamp, "h2"), ("a/empty.pdf", stamp, "h3")], "name string, last_modified timestamp, file_hash string")
    rows = [("a/x.pdf", 0, "1 Metode", 1, 11.0, False), ("a/x.pdf", 1, "noe tekst", 1, 11.0, False), ("a/x.pdf", 2, "2 Kilder", 2, 11.0, False),
            ("a/y.v2.pdf", 0, "bare tekst her", 1, 11.0, False), ("a/empty.pdf", 0, "  ", 1, 11.0, False)]
    blocks = spark.createDataFrame(rows, "doc_id string, block_ix int, text string, page int, font_size double, is_bold boolean")
    return blobs, blocks


def test_first_and_second_run(spark, corpus):
    blobs, blocks = corpus
    docs, chunks = spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS)
    first = run(spark, docs, chunks, blobs, blocks)
    assert {r.name: r.status for r in first.outcomes.collect()} == {"a/x.pdf": "ok", "a/y.v2.pdf": "ok", "a/empty.pdf": "error"}
    state = {r.source_blob: r for r in first.docs.collect()}
    assert state["a/y.v2.pdf"].title == "y.v2" and state["a/empty.pdf"].error_message == ingest.NO_TEXT
    calls = []

    def counting(texts):
        calls.extend(texts)
        return embed.hashing_embedder(8)(texts)

    again = run(spark, first.docs, first.chunks, blobs, blocks, counting, retry_failed=False)
    assert {r.status for r in again.outcomes.collect()} == {"skipped"}
    assert again.chunks.count() == first.chunks.count() and not calls


def test_forced_run_reuses_vectors(spark, corpus):
    blobs, blocks = corpus
    first = run(spark, spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS), blobs, blocks)

    def broken(texts):
        raise RuntimeError("no model")

    forced = run(spark, first.docs, first.chunks, blobs, blocks, broken, force=True)
    assert {r.name: r.status for r in forced.outcomes.collect()}["a/x.pdf"] == "ok"


def test_failing_embedder_gives_partial(spark, corpus):
    blobs, blocks = corpus

    def broken(texts):
        raise RuntimeError("no model")

    got = run(spark, spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS), blobs, blocks, broken)
    assert {r.name: r.status for r in got.outcomes.collect()} == {"a/x.pdf": "partial", "a/y.v2.pdf": "partial", "a/empty.pdf": "error"}
    assert got.chunks.filter("embedding IS NOT NULL").count() == 0


def test_stale_rows_are_claimed_again(spark, corpus):
    blobs, _ = corpus
    old, fresh = NOW - dt.timedelta(minutes=31), NOW - dt.timedelta(minutes=29)
    rows = [("a/x.pdf", "t", "", None, None, "h1", "processing", None, None, old, old), ("a/y.v2.pdf", "t", "", None, None, "h2", "processing", None, None, old, fresh)]
    docs = ingest.reclaim_stale(spark.createDataFrame(rows, DOCS), now())
    assert {r.name for r in ingest.claim(blobs, docs).collect()} == {"a/x.pdf", "a/empty.pdf"}


def test_files_are_listed_and_streamed_once(spark, tmp_path):
    from fjelldoc.streaming.files import index_new_files

    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.pdf", "b.PDF", "c.Pdf", "d.txt"):
        (folder / name).write_bytes(name.encode())
    listed = files.discover(spark, str(folder)).collect()
    assert sorted(r.name.rsplit("/", 1)[-1] for r in listed) == ["a.pdf", "b.PDF"]
    out, seen = str(tmp_path / "seen"), lambda df, batch: df.select("name").write.mode("append").parquet(str(tmp_path / "seen"))
    point = str(tmp_path / "point")
    index_new_files(spark, str(folder), seen, point).awaitTermination(60)
    (folder / "e.pdf").write_bytes(b"new")
    index_new_files(spark, str(folder), seen, point).awaitTermination(60)
    assert sorted(r.name.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect()) == ["a.pdf", "b.PDF", "e.pdf"]


def test_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    files.write_version(spark.range(3), table, 1)
    files.write_version(spark.range(5), table, 2)
    assert files.current_version(spark, table) == 2
    assert files.read_version(spark, table).count() == 5 and files.read_version(spark, table, 1).count() == 3


def test_two_writers_never_share_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: files.write_version(spark.range(n), table), range(1, 5)))
    assert sorted(numbers) == [1, 2, 3, 4]
    assert sorted(files.read_version(spark, table, v).count() for v in numbers) == [1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        files.write_version(spark.range(9), table, 2)
    assert 9 not in {files.read_version(spark, table, v).count() for v in numbers}


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    import os

    from fjelldoc.streaming.files import index_changes

    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    for name in ("a.pdf", "b.PDF", "c.pdf", "d.txt"):
        (folder / name).write_bytes(name.encode())
    read = []
    load = files.read_files
    monkeypatch.setattr(files, "read_files", lambda spark, names, out: (read.append(names.count()), load(spark, names, out))[1])

    def step():
        counts = index_changes(spark, f"file://{folder}", state, lambda rows, gone: seen.append(({r.name[-5:]: r.change for r in rows.collect()}, [r.name[-5:] for r in gone.collect()])))
        return counts

    assert step() == {"new": 3} and seen[-1][0] == {"a.pdf": "new", "b.PDF": "new", "c.pdf": "new"}
    assert step() == {"same": 3} and seen[-1] == ({}, [])
    (folder / "a.pdf").write_bytes(b"other")  # as long as before
    os.utime(folder / "a.pdf", (1_000_000_000,) * 2)  # and older
    os.utime(folder / "b.PDF", (1_100_000_000,) * 2)  # only its time
    (folder / "c.pdf").unlink()
    (folder / "old.pdf").write_bytes(b"old")
    os.utime(folder / "old.pdf", (900_000_000,) * 2)
    assert step() == {"changed": 1, "touched": 1, "new": 1, "removed": 1}
    assert seen[-1] == ({"a.pdf": "changed", "b.PDF": "touched", "d.pdf": "new"}, ["c.pdf"]) and read == [3, 0, 3]

    def fails(rows, gone):
        raise RuntimeError("down")

    (folder / "old.pdf").unlink()
    with pytest.raises(RuntimeError):
        index_changes(spark, f"file://{folder}", state, fails)
    assert step() == {"same": 2, "removed": 1}


def test_html_blocks(spark):
    html = "<html><script>x</p></script><h1>Title &amp; more</h1><p><b>Bold</b> text</p><ul><li>one</li><li>two</li></ul></html>"
    got = files.blocks_from_html(spark.createDataFrame([("d", html)], "doc_id string, html string")).orderBy("block_ix").collect()
    assert [r.text for r in got] == ["Title & more", "Bold text", "one", "two"]
    assert got[0].font_size == 14.0 and got[1].is_bold and not got[2].is_bold


def test_html_text_of_any_tag_is_kept(spark):
    html = "loose &aring;&#229;&#xE5;&none;<h2>Sub</h2><div class='ad'>an <i>ad</i></div><table><tr><td>cell</td><th>head</th></tr></table><pre>code</pre>" + "long " * 50_000 + "<p>last &amp;lt; unclosed"
    got = files.blocks_from_html(spark.createDataFrame([("d", html), ("e", None), ("f", "")], "doc_id string, html string")).orderBy("block_ix").collect()
    assert [r.text[:30] for r in got] == ["loose ååå&none;", "Sub", "an ad", "cell", "head", "code", ("long " * 6), "last &lt; unclosed"]
    assert [r.font_size for r in got][:3] == [11.0, 14.0, 11.0] and len(got[6].text) == 249_999


def test_old_files_are_delivered(spark, tmp_path):
    import os

    from fjelldoc.streaming.files import index_new_files

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "new.pdf").write_bytes(b"new")
    run = lambda df, batch: df.select("name").write.mode("append").parquet(str(tmp_path / "seen"))
    index_new_files(spark, str(folder), run).awaitTermination(60)
    (folder / "old.pdf").write_bytes(b"old")
    os.utime(folder / "old.pdf", (1_000_000_000,) * 2)
    index_new_files(spark, str(folder), run).awaitTermination(60)
    assert sorted(r.name[-7:] for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == ["new.pdf", "old.pdf"]


def test_adhoc_statement_is_a_subquery(spark):
    from pyspark.errors import ParseException

    from fjelldoc.operators.catalogue import capped_query

    rows = spark.range(500)
    assert capped_query(spark, "SELECT * FROM {rows};", rows=rows).count() == 200
    with pytest.raises(ParseException):
        capped_query(spark, "CREATE TEMPORARY VIEW made AS SELECT 1")
