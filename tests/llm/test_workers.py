"""Workers that don't have the package on their path, and training rows that the sample must not miss."""

import os
import subprocess
import sys
import textwrap

from tideglass.llm import language_id

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_on_workers_without_the_package(tmp_path):
    """A driver in another folder that has the package by sys.path alone: its workers inherit neither."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__
        queries = __spark_entry__.queries()
        for name in ("op6_language_id", "op8_packing", "op9_url_filter", "op11_spelling", "op13_importance", "g01_knn", "g01_knn_indexed", "b02_louvain", "g11_chunks", "m15_phrases"):
            if name in queries:
                assert queries[name](spark, "/root/testdata/sf0.001").count() >= 0, name
                print("ran", name)
    """)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran") == 10, done.stderr[-3000:]


def test_rows_without_ids_are_learned_from(spark):
    """Many rows of one (null) id: the draw looks at texts as well."""
    words = {"en": "the house and the garden of a friend", "de": "das haus und der garten von einem freund", "fr": "la maison et le jardin de mon ami"}
    rows = [(None, f"{w} {i} {w[i % 20 :]} {chr(97 + i % 26)}", lang) for lang, w in words.items() for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language_id.train(docs, sample=300)
    assert model.langs == ("de", "en", "fr") and abs(model.weights).sum() > 0
    found = language_id.predict(docs, model).where("lang = lang_pred").count()
    assert found == len(rows)


def test_many_labels_are_bounded(spark):
    """Of a thousand labels the most frequent ones are learned; others are never predicted."""
    rows = [(i, f"label number {i % 1000} text", f"l{i % 1000:03d}") for i in range(2000)] + [(5000 + i, "ein deutscher satz mit wörtern", "de") for i in range(50)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=10)
    assert len(model.langs) == language_id.MOST_LANGS and "de" in model.langs and model.weights.shape == (1024, language_id.MOST_LANGS)
