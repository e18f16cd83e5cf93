"""Line dedup of texts of very many lines."""

import time

from pyspark.sql import functions as F

from blockloom.llm import lines


def test_texts_of_200000_lines_take_linear_time(spark):
    n = 200_000
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("line "), (i % 50).cast("string"))), "\n")
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.concat(text, F.lit("\nown "), "id").alias("text"))
    began = time.monotonic()
    got = {r.doc_id: r for r in lines.remove_boilerplate(docs).collect()}
    assert time.monotonic() - began < 100  # hours where a text is hashed once a line
    first = "\n".join(f"line {i}" for i in range(50))
    assert got[0].text == f"{first}\nown 0" and (got[0].n_lines, got[0].n_removed) == (n + 1, n - 50)
    assert all(got[i].text == f"own {i}" and got[i].n_removed == n for i in range(1, 12))


def test_a_text_is_hashed_below_the_generator(spark, odd_docs):
    plan = lines.lines_of(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "xxhash64(coalesce" not in above and "text" not in above
