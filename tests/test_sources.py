import os
import uuid

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from inkwell import session
from inkwell.operators import responses
from inkwell.session import fresh_path, stage, work_dir
from inkwell.sources import reports, schema, tables, vectors
from inkwell.sources.cache import compute_or_reuse, missing_from_cache, one_per_key

CONFIG = [
    {"Column_Name": "Id", "Column_Type": "Integer", "Primary_Key": True, "Source_Exclude": True, "New_Name": "Id"},
    {"Column_Name": "when", "Column_Type": "Datetime", "New_Name": "Day"},
    {"Column_Name": "x", "Column_Type": "Float", "New_Name": "X"},
    {"Column_Name": "y", "Column_Type": "Anything", "New_Name": "Y"},
]


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    tables.create_table(spark, name, CONFIG, location=fresh_path(spark, "t"))
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_schema():
    assert schema.read_schema(CONFIG).simpleString() == "struct<when:timestamp_ntz,x:double,y:string>"
    assert schema.table_schema(CONFIG).simpleString() == "struct<Id:bigint,Day:date,X:double,Y:string>"
    assert schema.rename_map(CONFIG) == {"when": "Day", "x": "X", "y": "Y"} and schema.key_columns(CONFIG) == ["Id"]


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("y").alias("Y"), F.col("id").alias("Id"), F.lit(1.5).alias("X"), F.current_date().alias("Day"))


def test_load(spark, table):
    tables.load(spark, rows(spark, 5), table, keys=["Id"])
    tables.load(spark, rows(spark, 3), table, keys=["Id"])
    assert spark.table(table).count() == 3
    tables.load(spark, rows(spark, 3, 10), table, overwrite=False, keys=["Id"])
    with pytest.raises(ValueError):
        tables.load(spark, rows(spark, 1, 12), table, overwrite=False, keys=["Id"])
    with pytest.raises(ValueError):
        tables.load(spark, rows(spark, 1).withColumn("Id", F.lit(None).cast("long")), table, overwrite=False, keys=["Id"])
    assert spark.table(table).count() == 6
    assert tables.max_id(spark.table(table), "Id").first()[0] == 12
    tables.create_table(spark, table, CONFIG)
    assert spark.table(table).count() == 6
    assert tables.read_columns(spark, table, ["Y", "Id"]).columns == ["Y", "Id"]


def test_empty_table(spark, table):
    assert tables.max_id(spark.table(table), "Id").first()[0] == 0
    assert schema.key_violations(spark.table(table), ["Id"]).count() == 0


def test_delete_and_replace(spark, table):
    tables.load(spark, rows(spark, 4).withColumn("X", F.when(F.col("Id") > 0, F.col("Id").cast("double"))), table)
    tables.replace_after_delete(spark, table, F.col("X") > 1, rows(spark, 1, 100))
    assert sorted(r["Id"] for r in spark.table(table).collect()) == [0, 1, 100]


def test_statements():
    script = "-- a; b\nSELECT 'x;y', \"a;b\", `c;d` /* ; */ FROM t;\n\n;SELECT 'it''s; fine' -- end;\n; -- last"
    assert tables.split_statements(script) == ["SELECT 'x;y', \"a;b\", `c;d`   FROM t", "SELECT 'it''s; fine'"]


def test_bound_query(spark):
    frame = spark.range(5)
    text = "it's"
    assert tables.sql_query(spark, "SELECT id, :t AS t FROM {f} WHERE id > :low", {"t": text, "low": 2}, f=frame).collect() == [(3, text), (4, text)]


def test_reports(spark):
    path = fresh_path(spark, "reports")
    texts = ["plain", "two\nlines\r\nhere", "sep \x1e inside", "back\\slash \\s \\b \\\\", "Question: nested", "rule =============== inside"]
    frame = spark.createDataFrame([("r1", t, f"answer {i}\x1e") for i, t in enumerate(texts)], "run string, q string, a string")
    reports.write_reports(frame, path, "run", "q", "a")
    back = reports.read_reports(spark, path)
    expected = sorted(f"Question: {t}\n===============\nAnswer: answer {i}\x1e\n\n" for i, t in enumerate(texts))
    assert sorted(r["value"] for r in back.collect()) == expected
    questions = sorted(r[0] for r in back.select(reports.report_question(F.col("value"))).collect())
    assert questions == sorted(e.split("===============")[0].replace("Question: ", "") for e in expected)


def test_report_files(spark, tmp_path):
    (tmp_path / "Question_1.txt").write_text("Question: a\nb\n===============\nAnswer: c\n\n")
    back = reports.read_report_files(spark, str(tmp_path))
    assert back.select(reports.report_question(F.col("value"))).first()[0] == "a\nb\n"


def test_upsert(spark):
    stored = spark.createDataFrame([("a", [1.0], {"v": "0"}), ("b", [2.0], {"v": "0"})], "id string, values array<float>, metadata map<string,string>")
    batch = spark.createDataFrame(
        [("b", [3.0], {"v": "1"}, 1), ("b", [4.0], {"v": "2"}, 2), ("c", [5.0], {"v": "1"}, 1)], "id string, values array<float>, metadata map<string,string>, seq int"
    )
    once = vectors.upsert(stored, batch, "seq")
    twice = vectors.upsert(once, batch, "seq")
    expected = [("a", [1.0], {"v": "0"}), ("b", [4.0], {"v": "2"}), ("c", [5.0], {"v": "1"})]
    assert sorted(map(tuple, once.collect())) == expected == sorted(map(tuple, twice.collect()))


def test_dimension(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "id int, values array<float>")
    assert sorted(r["id"] for r in vectors.wrong_dimension(frame, 2).collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        vectors.rebuild_vectors(frame, fresh_path(spark, "v"), 2)
    path = fresh_path(spark, "v")
    vectors.rebuild_vectors(frame.filter("id = 1"), path, 2)
    assert spark.read.parquet(path).count() == 1


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in frame.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


def test_cache_computes_missing_once(spark):
    path = fresh_path(spark, "cache")
    asked = spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(size=batch["text"].str.len())[["content_key", "size"]]

        return df.mapInPandas(run, "content_key string, size long")

    texts = ["aa"] * 50 + ["b", "cccc", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for _ in range(2):
        out = compute_or_reuse(frame, "text", path, compute, hot_rows=10).collect()
        assert sorted((r["id"], r["size"]) for r in out) == [(i, len(t) if t else None) for i, t in enumerate(texts)]
        assert asked.value == 3
    cache = spark.read.parquet(path)
    assert missing_from_cache(frame.limit(0), cache, "text").count() == 0


def test_client_retries_and_repeats(spark):
    def make():
        state = {"calls": 0}

        def client(prompts):
            state["calls"] += 1
            if state["calls"] == 1:
                raise responses.RetryLater()
            return [p.upper() for p in prompts]

        return client

    frame = spark.createDataFrame([(i, "same" if i < 20 else f"p{i}") for i in range(30)], "id int, prompt string")
    store = fresh_path(spark, "store")
    out = responses.call_client(frame.select(F.md5("prompt").alias("content_key"), "prompt").distinct(), "prompt", make, first_wait=0.01)
    assert out.count() == 11
    answered = responses.attach_responses(frame, "prompt", store, lambda: lambda prompts: [p.upper() for p in prompts], hot_rows=5)
    assert all(r["response"] == r["prompt"].upper() for r in answered.collect()) and answered.count() == 30
    known = spark.read.parquet(store)
    partly = responses.recorded_responses(frame, "prompt", known.filter("response <> 'SAME'"), hot_rows=5)
    assert partly.filter("response IS NULL").count() == 20 and partly.count() == 30


def test_every_prompt_is_asked_once_in_many_tasks(spark, tmp_path):
    def make():
        task = TaskContext.get().partitionId()

        def client(prompts):
            with open(tmp_path / f"task-{task}-{uuid.uuid4().hex}", "w") as file:
                file.write("\n".join(prompts))
            return [p.upper() for p in prompts]

        return client

    frame = spark.range(30_000).select("id", F.concat(F.lit("p"), (F.col("id") % 20_000).cast("string")).alias("prompt"))
    out = responses.attach_responses(frame, "prompt", fresh_path(spark, "store"), make, hot_rows=100)
    assert out.filter("response = upper(prompt)").count() == 30_000 and out.count() == 30_000
    asked = [line for file in tmp_path.iterdir() for line in file.read_text().split("\n")]
    assert len(asked) == len(set(asked)) == 20_000
    assert len({file.name.split("-")[1] for file in tmp_path.iterdir()}) > 1


def test_a_key_stored_twice_gives_one_row(spark):
    cache = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", None)], "content_key string, response string")
    assert sorted(map(tuple, one_per_key(cache).collect())) == [("k", "a"), ("m", None)]


def test_null_order_comes_first_and_ties_are_settled(spark):
    kind = "id string, values array<float>, metadata map<string,string>, seq int"
    batch = spark.createDataFrame([("a", [1.0], {"v": "x"}, None), ("a", [2.0], {"v": "y"}, 1), ("b", [3.0], {"v": "z"}, None), ("c", [4.0], {}, 5), ("c", [5.0], {}, 5)], kind)
    found = [sorted((r["id"], r["values"]) for r in vectors.latest_per_id(f, "seq").collect()) for f in (batch, batch.orderBy(F.rand(1)).repartition(3))]
    assert found[0] == found[1] and found[0][:2] == [("a", [2.0]), ("b", [3.0])]


def test_upsert_writes_the_next_version(spark):
    name, path = f"t_{uuid.uuid4().hex}", fresh_path(spark, "vectors")
    kind = "id string, values array<float>, metadata map<string,string>"
    spark.sql(f"CREATE TABLE {name} (id STRING, values ARRAY<FLOAT>, metadata MAP<STRING, STRING>) USING parquet LOCATION '{path}'")
    spark.createDataFrame([("a", [1.0], {}), ("b", [2.0], {})], kind).write.insertInto(name)
    batch = spark.createDataFrame([("b", [3.0], {}, 1)], kind + ", seq int")
    for _ in range(2):
        vectors.upsert_table(spark, name, batch, "seq")
        assert sorted((r["id"], r["values"]) for r in spark.table(name).collect()) == [("a", [1.0]), ("b", [3.0])]
    assert spark.read.parquet(path).count() == 2  # the old version is still whole


def test_run_names_stay_text(spark):
    path = fresh_path(spark, "reports")
    reports.write_reports(spark.createDataFrame([("001", "q", "a"), ("2", "q", "a")], "run string, q string, a string"), path, "run", "q", "a")
    assert sorted(r["run"] for r in reports.read_reports(spark, path).collect()) == ["001", "2"]


def test_stage_lives_in_the_shared_folder(spark):
    staged = stage(spark.range(3), "x")
    assert all(work_dir(spark) in f for f in staged.inputFiles())


def test_staged_folders_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_PATHS", [])
    staged = stage(spark.range(3), "gone")
    path = staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and session.drop_staged(spark) == 1 and not os.path.exists(path)


def test_zstd(spark):
    path = fresh_path(spark, "z")
    tables.write_parquet(spark.range(10), path, 3)
    assert spark.read.parquet(path).count() == 10 and all(f.endswith(".zstd.parquet") for f in spark.read.parquet(path).inputFiles())
