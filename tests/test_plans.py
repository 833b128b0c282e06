"""Physical plans that must hold at any size."""

import re

from pyspark.sql import functions as F

from recallspark.operators.chunking import chunk_messages, chunk_texts
from recallspark.operators.embedding import embed
from recallspark.operators.search import nearest, nearest_to
from recallspark.plans.ingest import new_files, prepare_chunks
from recallspark.sources.transcripts import list_transcripts, parse_lines, read_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_to_chunks_is_one_narrow_jvm_stage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}")
    plan = plan_of(prepare_chunks(parse_lines(read_lines(spark, str(tmp_path)))))
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("try_parse_json") + plan.count("parseJson") == 1


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}")
    plan = plan_of(list_transcripts(spark, str(tmp_path)))
    assert re.search(r"ReadSchema: struct<>", plan)


def test_chunk_numbers_take_one_shuffle_by_block(spark):
    df = spark.range(10).selectExpr("string(id % 3) AS conversation_id", "id AS msg_index", "'u' AS role", "'text' AS content")
    plan = plan_of(chunk_messages(df))
    assert plan.count("Exchange") == 1
    assert re.search(r"hashpartitioning\(conversation_id\S*, _block", plan)
    assert "Exchange" not in plan_of(chunk_texts(df, "content"))


def test_search_reads_key_and_vector_only(spark, stage, tmp_path):
    rows = spark.range(5).selectExpr("string(id) AS conversation_id", "id AS chunk_index", "'long text' AS content")
    embed(rows, "content").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    questions = embed(spark.createDataFrame([(1, "text")], "query_id int, question string"), "question")
    nearest(chunks, questions, ["conversation_id", "chunk_index"], stage)
    plan = stage.plans[-1]
    assert "ReadSchema: struct<conversation_id:string,chunk_index:bigint,embedding:array<float>>" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_known_files_are_left_out_by_path(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, file_size long")
    log = spark.createDataFrame([("a",)], "file_path string")
    left = new_files(listing, log)
    assert [r.file_path for r in left.collect()] == ["b"]
    assert "LeftAnti" in plan_of(left)
    assert left.filter(F.col("file_size") < 0).count() == 0


def test_stage_lives_in_the_named_folder(spark):
    from recallspark.runtime import Stage, path_exists

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    with Stage(spark) as stage:
        assert stage.root.startswith(named + "/")
        written, n = stage.write_counted(spark.range(7).toDF("id"), "numbers")
        assert n == written.count() == 7
        assert path_exists(spark, stage.root)
        again = stage.write(spark.range(3).toDF("id"), "numbers")
        assert (again.count(), written.count()) == (3, 7)
    assert not path_exists(spark, stage.root)


def test_model_runs_once_a_text(spark, stage):
    chunks = embed(spark.range(50).selectExpr("id AS chunk_index", "string(id) AS content"), "content")
    assert plan_of(nearest_to(chunks, [1.0] * 384, ["chunk_index"])).count("ArrowEvalPython") <= 2
    questions = embed(spark.createDataFrame([(1, "7")], "query_id int, question string"), "question")
    nearest(chunks, questions, ["chunk_index"], stage)
    assert stage.plans[-1].count("ArrowEvalPython") == 1
