"""The stages in order, each against what it must do to its own input."""

import random

import corpus_pipeline as pipeline
import duckdb
from helpers import classes
from pyspark.sql import functions as F

from candlewright.llm import common, quality_rules, secret_scan
from candlewright.llm.registry import SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    bench = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    inputs = [docs]
    for _, stage in pipeline.STAGES:
        inputs.append(common.stored(stage(spark, inputs[-1], SF)))
    rows = [{r.doc_id: r for r in d.collect()} for d in inputs]
    assert all(d.columns == names for d in inputs[:-1]) and inputs[-1].columns == [*names, "input_ids"]
    kept = {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}
    assert set(rows[1]) == kept
    found = classes([(d, r.text) for d, r in rows[1].items()])
    assert set(rows[2]) == {c for c, _ in found.values()}
    assert set(rows[3]) == {d for d, r in rows[2].items() if not any(b in r.text for b in bench)}
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    limits = secret_scan.false_find_limits(inputs[3])
    assert all(r.text == secret_scan.redacted(rows[3][d].text, limits=limits) and r.n_chars == len(r.text) for d, r in rows[4].items())
    assert all(r.input_ids for r in rows[5].values())


def test_op3_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(SQL["op3_quality_rules"])
    got = quality_rules.op3_quality_rules(spark, SF)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and blank texts, very long ones, repeated rows, clashing columns, an empty table."""
    rng = random.Random(30)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b = prose(60), prose(60)
    item = common.table(spark, SF, "benchmark").first().text
    rows = [(1, a, "en", "s", len(a)), (1, a, "en", "s", len(a)), (None, b, None, None, None), (2, b, None, "s", None), (3, None, "en", None, None), (4, "", "", "", 0), (5, " \n", None, None, 2)]
    rows += [(6, prose(20_000), "en", "s", 9), (7, f"{prose(40)} {item} {prose(40)}", "en", "s", 9), (8, prose(8_000) + " password=abcdefgh1 " + "x" * 50_000, "en", "s", 9), (9, prose(40), None, None, None), (9, prose(40), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"sid": F.lit(1), "root": F.lit(2), "words": F.lit(3), "input_": F.lit(4)}).withColumnRenamed("input_", "a.b")
    for start, kept in ((docs, [1, 2, 6, 8, 9, 9]), (docs.limit(0), [])):
        now = start
        for _, stage in pipeline.STAGES:
            now = common.stored(stage(spark, now, SF))
        out = now.collect()
        assert now.columns == [*docs.columns, "input_ids"]
        assert sorted(r.doc_id for r in out) == kept
        assert all(r["a.b"] == 4 and r.sid == 1 and r.input_ids for r in out)
        assert all("[SECRET]" in r.text and "password" not in r.text for r in out if r.doc_id == 8)
