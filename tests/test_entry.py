"""The entry file must import and run from any folder, with no package on the
workers' path, no Spark files to read, and with or without the optional subpackage."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = textwrap.dedent("""
    import glob, sys, zipfile
    def refuse(*a, **k):
        raise AssertionError("Spark's jars must not be read")
    zipfile.ZipFile.__init__ = refuse
    sys.path.insert(0, {repo!r})
    if {without}:
        class Missing:
            def find_spec(self, name, path=None, target=None):
                if name.split(".")[0] == "corpus_pipeline" or name.startswith("vellum.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Missing())
    import __spark_entry__ as e
    sql = e.oracle_sql()
    assert set(sql) <= set(e.queries())
    print("QUERIES", len(e.queries()), "SQL", len(sql), any(q.startswith("op") for q in e.queries()))
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "2").getOrCreate())
    for q in ("ingest_rdf", "language_routed"):
        print(q, e.queries()[q](spark, "/root/testdata/sf0.001").count())
""")


def run(tmp_path, without):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    p = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=REPO, without=without)], cwd=tmp_path, env=env,
                       capture_output=True, text=True, timeout=300)
    assert p.returncode == 0, p.stderr[-2000:]
    return p.stdout


def test_entry_from_a_foreign_folder(tmp_path):
    out = run(tmp_path, True)
    assert "QUERIES" in out and out.rstrip().endswith("language_routed 200") and "False" in out


def test_entry_with_the_optional_subpackage(tmp_path):
    if os.path.exists(os.path.join(REPO, "corpus_pipeline.py")):
        assert "True" in run(tmp_path, False)
