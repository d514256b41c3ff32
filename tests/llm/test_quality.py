import duckdb
from pyspark.sql import functions as F

from galley.llm.quality import QUALITY_SQL, quality
from tests.llm.helpers import no_documents, odd_documents


def test_odd_rows_equal_sql(spark):
    sentence = "the cat and the dog of this house are in a good place to be for all the time that is left "
    extra = [
        (20, sentence * 4), (21, sentence + "\n" + sentence), (22, "spam spam spam " * 40), (23, "### $$$ *** " * 30),
        (24, "a b c d a b c d " + " ".join(f"w{k}" for k in range(60))), (25, "a b a b a b"), (26, "x x"), (27, "x x x x"),
        (28, "line one here\nline one here\r\nline one here\n \n \n"), (29, "<a> | <b> " + sentence * 3),
    ]
    frame, texts = odd_documents(spark, extra)
    numbered = [(k, text) for k, (_, text) in enumerate(texts)]
    rows = quality(spark.createDataFrame(numbered, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", numbered)
    columns = ", ".join(rows[0].__fields__)
    expected = con.execute(f"SELECT {columns} FROM ({QUALITY_SQL}) ORDER BY doc_id").fetchall()
    assert sorted(tuple(r) for r in rows) == expected
    assert quality(frame).count() == len(texts) and quality(no_documents(spark)).count() == 0


def test_verdicts_follow_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    by = {r.quality: (r.kept, r.n) for r in rows.filter("n_words >= 50").groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert by[0][0] <= 0.05 * by[0][1] and by[1][0] >= 0.97 * by[1][1]


def test_no_python_in_the_plan(spark):
    plan = quality(odd_documents(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
