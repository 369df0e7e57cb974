import pytest

from tessella.functions import clean as C
from tessella.operators import corpus
from tessella.sources import files, sinks
from tessella.streaming import stateless


@pytest.fixture
def at(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_csv_and_lines(spark, at):
    path = at("a.csv", 'id,translit_text,English\n1,"a ""b""\nc",x\n2,,nan\n3,  d ,y\n')
    assert [tuple(x) for x in files.read_csv(spark, path).collect()] == [("1", 'a "b"\nc', "x"), ("2", None, None), ("3", "  d ", "y")]
    assert [x.text for x in files.read_texts(spark, path, "translit_text").collect()] == ['a "b"\nc', "", "d"]
    assert [tuple(x) for x in files.read_corpus(spark, path).collect()] == [('a "b"\nc', "x"), ("  d ", "y")]
    with pytest.raises(ValueError):
        files.read_texts(spark, path)
    with pytest.raises(ValueError):
        files.read_column(spark, path, "none")
    lines = at("b.txt", "one \n\n \n two\n")
    assert [x.text for x in files.read_texts(spark, lines).collect()] == ["one", "two"]
    assert files.read_first(spark, [at("x", "")[:-1] + "missing", path]).count() == 3 and files.read_first(spark, [path + "none"]) is None


def test_parallel_files_end_with_the_shorter(spark, at):
    src = at("t.tr", "\n".join(f"source line {i}" for i in range(500)))
    tgt = at("t.en", "\n".join(f"target line {i}" if i % 7 else "x" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {x.ord: (x.src, x.tgt) for x in files.read_parallel(spark, src, tgt).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: (f"source line {i}", f"target line {i}") for i in range(400) if i % 7}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'é "q"\nz'), ("x", " "), ("3", None)], "id string, translation string")
    fixed = sinks.repaired(df)
    assert sorted(map(tuple, fixed.collect()), key=str) == [(1, 'e "q" z'), (3, "broken text"), (None, "broken text")]
    sinks.write_csv(fixed, str(tmp_path / "out"), one_file=True)
    assert files.read_csv(spark, str(tmp_path / "out"), "id long, translation string").count() == 3
    split = corpus.hash_split(spark.range(10), "id", 0.3)
    sinks.write_split(split, str(tmp_path / "a"), str(tmp_path / "b"))
    assert files.read_csv(spark, str(tmp_path / "a")).count() == 7 and files.read_csv(spark, str(tmp_path / "b")).count() == 3
    assert sinks.result_table(df, ["id"], ["none", "translation"]).columns == ["id", "translation"]
    assert sinks.report_json(spark.range(1)).first()[0] == '{"id":0}'


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a-na"), (2, "the the ... tablet"), (3, "long key here")], "id int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    memory = spark.createDataFrame([("long key here", "known")], "key string, value string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    work = lambda df: stateless.looked_up(stateless.cleaned(df), memory, C.retrieval_key)
    stateless.run_once(work(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, work(rows).collect()))
    assert {x.id: x.answer for x in got.select("id", "answer").collect()} == {1: "To", 2: None, 3: "known"}
