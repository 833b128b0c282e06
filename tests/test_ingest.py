"""Files to stored chunks: parsing, numbering, repeated runs, streaming."""

import json
import re

import pytest
from pyspark.sql import functions as F

from recallspark.plans.ingest import Store, ingest_all
from recallspark.runtime import Stage
from recallspark.settings import Settings
from recallspark.sources.transcripts import (
    list_transcripts,
    messages_of,
    parse_lines,
    read_lines,
    read_messages,
    rejects_of,
)
from recallspark.streaming.pickup import ingest_stream


def line(content, type="user", role="user", **rest):
    return json.dumps({"type": type, "message": {"role": role, "content": content}, **rest})


CASES = [  # line, message or None, reject or None
    (line("  hello  ", timestamp="t1"), ("user", "hello", "t1"), None),
    (line([{"type": "text", "text": "a"}, {"type": "tool_use", "text": "x"}, "b", {"type": "text"}, 7, ["c"],
           {"text": "no type"}], type="assistant", role="assistant"), ("assistant", "a\nb", ""), None),
    (line('["looks", "like", "an array"]'), ("user", '["looks", "like", "an array"]', ""), None),
    (line("kept", role="tool", timestamp=None), ("tool", "kept", None), None),
    (line("x", type="system"), None, None),
    (line(5), None, None),
    (line([]), None, None),
    (line({"type": "text", "text": "x"}), None, None),
    (line("   \n"), None, None),
    (line("x", role=""), None, None),
    ('{"type":"user","message":{"content":"no role"}}', None, None),
    ('{"type":"user","message":{}}', None, None),
    ('{"type":"user","message":null}', None, None),
    ('{"type":"user","message":""}', None, None),
    ('{"type":"user","message":[]}', None, None),
    ('{"type":"user"}', None, None),
    ('{"message":{"role":"user","content":"no type"}}', None, None),
    ('{"type":["user"],"message":{"role":"user","content":"x"}}', None, None),
    ("", None, None),
    (" \t  ", None, None),
    ("{broken", None, "malformed line"),
    ("[1,2]", None, "line is not an object"),
    ('"text"', None, "line is not an object"),
    ('{"type":"user","message":"text"}', None, "message is not an object"),
    ('{"type":"user","message":[1]}', None, "message is not an object"),
    (line([{"type": "text", "text": 5}]), None, "text block without text"),
    ('{"type":"system","type":"user","message":{"role":"user","content":"last key counts"}}',
     ("user", "last key counts", ""), None),
]


def test_line_shapes(spark):
    lines = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "n int, value string")
    parsed = parse_lines(lines)
    messages = {r.n: (r.role, r.content, r.timestamp) for r in messages_of(parsed).collect()}
    rejects = {r.n: r.reject_reason for r in rejects_of(parsed).collect()}
    assert messages == {i: c[1] for i, c in enumerate(CASES) if c[1]}
    assert rejects == {i: c[2] for i, c in enumerate(CASES) if c[2]}


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_parsing_leaves_the_session_as_it_was(spark, before):
    name = "spark.sql.variant.allowDuplicateKeys"
    if before is not None:
        spark.conf.set(name, before)
    try:
        lines = spark.createDataFrame([(CASES[-1][0],), (CASES[0][0],)], "value string")
        parsed = parse_lines(lines)
        assert spark.conf.get(name) == (before or "false")
        assert {r.content for r in messages_of(parsed).filter("role <> ''").collect()} == {"last key counts", "hello"}
    finally:
        spark.conf.unset(name)


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "sub").mkdir()
    (path / "sub" / "hidden.jsonl").write_text(line("not read"))
    (path / "notes.txt").write_text(line("not read"))
    (path / "a b+c%41[x].jsonl").write_bytes(
        b"\r\n".join([line("first AKIA" + "B" * 16, timestamp="1").encode(), b'{"type":"user\xff"}', line("second. " * 300).encode()])
    )
    (path / "long.v2.jsonl").write_text("\n".join(line(f"message {i}") for i in range(5000)))
    (path / "bad.jsonl").write_text(line("\x00" * 50) + "\n" + line("y" * 10001) + "\n")
    (path / "none.jsonl").write_text("nothing here\n")
    return path


def test_listing(spark, folder):
    rows = {r.conversation_id: r for r in list_transcripts(spark, str(folder)).collect()}
    assert set(rows) == {"a b+c%41[x]", "long.v2", "bad", "none"}
    for stem, row in rows.items():
        assert row.file_path.endswith(f"/in/{stem}.jsonl")
        assert row.file_size == (folder / f"{stem}.jsonl").stat().st_size


def test_message_order_over_many_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with Stage(spark) as stage:
            found = read_messages(spark, str(folder), stage).filter("conversation_id = 'long.v2'")
            rows = found.orderBy("msg_index").select("msg_index", "content").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == [(i, f"message {i}") for i in range(5000)]


def stored(spark, root):
    return {
        (r.conversation_id, r.chunk_index): r.content
        for r in Store(spark, root).read("chunks").collect()
    }


@pytest.mark.parametrize("wave", [100, 2])
def test_ingest_twice(spark, folder, tmp_path, wave):
    root, settings = str(tmp_path / "store"), Settings(files_per_wave=wave)
    first = ingest_all(spark, str(folder), root, settings=settings)
    chunks = stored(spark, root)
    assert (first.files_processed, first.skipped, first.lines_rejected) == (4, 0, 2)
    assert (first.chunks_rejected, first.chunks_warned) == (2, 1)
    warning = Store(spark, root).read("chunk_warnings").first()
    assert (warning.conversation_id, warning.chunk_index) == ("a b+c%41[x]", 0) and "AKIA" in warning.warning
    assert first.total_chunks == first.chunks_inserted == len(chunks) == 5000 + 1 + 3
    assert chunks[("a b+c%41[x]", 0)] == "first [REDACTED_SECRET]"
    assert [chunks[("long.v2", i)] for i in (0, 77, 4999)] == ["message 0", "message 77", "message 4999"]
    assert all(len(c) <= 1000 for c in chunks.values())
    rejects = Store(spark, root).read("chunk_rejects").orderBy("chunk_index").collect()
    assert [(r.conversation_id, r.chunk_index, r.reject_reason) for r in rejects] == [
        ("bad", 0, "Content is mostly non-printable (0% printable)"),
        ("bad", 1, "Content exceeds maximum length (10001 > 10000)"),
    ]
    log = {r.file_path.rsplit("/", 1)[1]: r.chunks_created for r in Store(spark, root).read("ingestion_log").collect()}
    assert log == {"a b+c%41[x].jsonl": 4, "long.v2.jsonl": 5000}

    # A grown file is not read again; files without a chunk are.
    with open(folder / "long.v2.jsonl", "a") as f:
        f.write("\n" + line("late"))
    (folder / "new.jsonl").write_text(line("new"))
    second = ingest_all(spark, str(folder), root, settings=settings)
    assert (second.files_processed, second.skipped, second.chunks_inserted) == (3, 2, 1)
    assert stored(spark, root) == chunks | {("new", 0): "new"}
    vectors = Store(spark, root).read("chunks").select(F.size("embedding").alias("n"), "id", "created_at")
    assert vectors.filter("n <> 384 OR id IS NULL OR created_at IS NULL").count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_stems_keep_the_first(spark, tmp_path, broadcast):
    root = str(tmp_path / "store")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, texts in (("one", ["a0", "a1"]), ("two", ["b0", "b1", "b2"])):
            (tmp_path / name).mkdir()
            (tmp_path / name / "same.jsonl").write_text("\n".join(map(line, texts)))
            ingest_all(spark, str(tmp_path / name), root)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored(spark, root) == {("same", 0): "a0", ("same", 1): "a1", ("same", 2): "b2"}


def test_equal_stems_in_one_wave(spark, tmp_path):
    import os

    from recallspark.plans.ingest import ingest_wave

    for name, when, texts in (("x", 2_000_000_000, ["a0"]), ("y", 1_000_000_000, ["b0", "b1"])):
        (tmp_path / name).mkdir()
        file = tmp_path / name / "same.jsonl"
        file.write_text("\n".join(map(line, texts)))
        os.utime(file, (when, when))
    store = Store(spark, str(tmp_path / "store")).create()
    lines = read_lines(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    done = ingest_wave(lines, store)
    assert (done.total_chunks, done.chunks_inserted) == (3, 2)
    assert stored(spark, store.root) == {("same", 0): "b0", ("same", 1): "b1"}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    result = ingest_all(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    assert (result.files_processed, result.total_chunks, result.skipped) == (0, 0, 0)


def test_stream_equals_batch(spark, folder, tmp_path):
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    ingest_all(spark, str(folder), batch)
    few = Settings(files_per_wave=2)

    def pick_up():
        query = ingest_stream(spark, str(folder), stream, str(tmp_path / "progress"), settings=few)
        query.awaitTermination()

    pick_up()
    assert stored(spark, stream) == stored(spark, batch)
    (folder / "new.jsonl").write_text(line("new"))
    pick_up()
    assert stored(spark, stream) == stored(spark, batch) | {("new", 0): "new"}
    assert Store(spark, stream).read("ingestion_log").count() == 3


def test_rejects_are_stored_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    record = {"type": "user", "timestamp": "1", "message": {"role": "user", "content": "\x01" * 50}}
    (source / "bad.jsonl").write_text(json.dumps(record) + "\n")
    for _ in range(3):
        ingest_all(spark, str(source), str(tmp_path / "store"))
    assert Store(spark, str(tmp_path / "store")).read("chunk_rejects").count() == 1


def test_third_run_adds_no_row(spark, folder, tmp_path):
    root = str(tmp_path / "store")
    sizes = []
    for _ in range(3):
        ingest_all(spark, str(folder), root)
        sizes.append([Store(spark, root).read(t).count() for t in ("chunks", "ingestion_log", "chunk_rejects", "chunk_warnings")])
    assert sizes[0] == sizes[1] == sizes[2] == [5004, 2, 2, 1]
    assert spark.read.parquet(f"{root}/chunks").count() == 5004


def test_wave_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    """Many conversations are stored; a wave of one is compared with one folder of them."""
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for i in range(12):
        (source / f"c{i}.jsonl").write_text(line(f"text {i}"))
    ingest_all(spark, str(source), root)
    (source / "late.jsonl").write_text(line("late"))
    read, plans = Store.read, []

    def watched(self, table, buckets=None):
        rows = read(self, table, buckets)
        plans.append((table, buckets, rows._jdf.queryExecution().executedPlan().toString()))
        return rows

    monkeypatch.setattr(Store, "read", watched)
    assert ingest_all(spark, str(source), root).chunks_inserted == 1
    own = [(b, p) for t, b, p in plans if t == "chunks"]
    assert own and all(len(b) == 1 for b, _ in own)
    for (bucket,), plan in own:
        assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}", plan)


@pytest.mark.parametrize("broken", ["ingestion_log", "commit"])
def test_no_half_batch_is_seen(spark, folder, tmp_path, monkeypatch, broken):
    """A run that breaks after the chunks, or right before the commit, has stored nothing; the next stores all once."""
    root = str(tmp_path / "store")
    append = Store.append

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken == "commit":
            m.setattr(Store, "commit", fail)
        else:
            m.setattr(Store, "append", lambda self, df, table, batch: fail() if table == broken else append(self, df, table, batch))
        with pytest.raises(OSError, match="lost"):
            ingest_all(spark, str(folder), root)
    assert spark.read.parquet(f"{root}/chunks").count() == 5004
    for table in ("chunks", "ingestion_log", "chunk_rejects", "chunk_warnings"):
        assert Store(spark, root).read(table).count() == 0
    again = ingest_all(spark, str(folder), root)
    assert (again.skipped, again.chunks_inserted, again.repeated_keys) == (0, 5004, 0)
    assert len(stored(spark, root)) == 5004 and Store(spark, root).read("ingestion_log").count() == 2


def test_repeated_keys_are_reported_by_bucket(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    ingest_all(spark, str(folder), store.root)
    assert store.repeats("chunks").count() == 0
    planted = store.read("chunks").filter("conversation_id = 'long.v2' AND chunk_index IN (3, 4)")
    store.append(planted.unionByName(planted.filter("chunk_index = 4")), "chunks", "planted")
    assert store.repeats("chunks").count() == 0  # not committed yet
    store.commit("planted")
    found = {(r.conversation_id, r.chunk_index): r.n for r in store.repeats("chunks").collect()}
    assert found == {("long.v2", 3): 2, ("long.v2", 4): 3}
    (own,) = store.buckets_of(planted, "chunks")
    assert store.repeats("chunks", [own]).count() == 2 and store.repeats("chunks", [own + 1]).count() == 0


def test_buckets_stay_as_created(spark, tmp_path):
    root = str(tmp_path / "store")
    Store(spark, root, Settings(store_buckets=3)).create()
    assert Store(spark, root, Settings(store_buckets=50)).create().buckets == 3


def test_waves_grow(spark):
    """The number of waves grows with the logarithm of the files, and each file is in one of them."""
    from recallspark.plans.ingest import waves

    files = spark.range(100).selectExpr("lpad(id, 3, '0') AS file_path", "timestamp_seconds(id div 3) AS modified_at")
    got = list(waves(files, 2, 32))
    assert [len(w) for w in got] == [2, 4, 8, 16, 32, 32, 6]
    assert [p for w in got for p in w] == [f"{i:03d}" for i in range(100)]
    assert [len(w) for w in waves(files, 60)] == [60, 40]
