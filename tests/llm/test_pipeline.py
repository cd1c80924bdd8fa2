"""The pipeline stage by stage against plain Python on a small table."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pricemesh.llm import queries, quality_model
from tests.llm import cases
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_runs import brute as line_cuts
from tests.llm.test_simhash import classes, slow_fingerprint

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture
def folder(spark, tmp_path):
    junk = [(500 + k, " ".join(f"{w.upper()}%%%" for w in cases.prose(k, 60).split()), "en", "src0", 1) for k in range(5)]
    clean = [(600 + k, cases.prose(2000 + k, 40 + k % 40), "en", f"src{k % 4}", 1) for k in range(300)]
    rows = [r for r in cases.rows() if r[0] is not None] + junk + clean
    bench = [(1, clean[7][1][:400]), (2, "never seen words here at all to be found in any text of this table today")]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, 0) for r in clean[:240]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "mix"]
    verdict = {r.doc_id: r.kept for r in quality_model.judge(docs, queries.trusted_rows(spark, folder)).collect()}
    assert not any(verdict[500 + k] for k in range(5)) and all(verdict[600 + k] for k in range(300))
    now = sorted((r.doc_id, r.text or "") for r in docs.collect() if verdict[r.doc_id])

    cut = line_cuts([(k, t) for k, t in now if len(t) < 50_000], 50)
    cut = {k: v for k, v in cut.items() if v}
    after = [(k, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut.get(k, ()))) for k, t in now]
    after = [(k, t) for k, t in after if t.split() or k not in cut]
    prints = [slow_fingerprint(t) for _, t in after]
    roots = classes(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    unique = [after[i] for i in sorted(set(roots))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [(k, t) for k, t in unique if not (h := contaminated(t, items))[1] or 20 * h[1] < h[0]]
    assert len(now) > len(after) > len(unique) > len(clean)

    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        stages[name] = docs
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted({(r.doc_id, r.text or "") for r in stages["quality"].collect()}) == sorted(set(now))
    assert sorted({(r.doc_id, r.text or "") for r in stages["line_dedup"].collect()}) == sorted(set(after))
    assert sorted((r.doc_id, r.text or "") for r in stages["near_dedup"].collect()) == sorted(set(unique))
    assert sorted((r.doc_id, r.text or "") for r in stages["decontamination"].collect()) == sorted(set(clean))
    mixed = sorted(map(str, stages["mix"].collect()))
    assert 0 < len(mixed) <= len(set(clean)) and mixed == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_every_operator_is_registered():
    known = entry.queries()
    assert "pipeline" in known and all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 11))


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(TABLES))
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == want


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_cover_their_tables(spark, name):
    source = {"op2": "conversations", "op3": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{TABLES}/{source}.parquet")
    want = rows.select(F.countDistinct("conv_id") + 1).first()[0] if source == "conversations" else rows.count()
    got = queries.QUERIES[name](spark, str(TABLES))
    # Packing returns a row per piece; every document has a first one.
    got = got.where("piece = 0") if "piece" in got.columns else got
    assert got.count() == want


def test_quality_stage_scores_by_a_join(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def refuse(*_):
        raise AssertionError("the table of probabilities is broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert kept.isdisjoint(range(500, 505)) and kept.issuperset(range(600, 900))


def test_quality_stage_grants_nothing_beyond_the_quantile(spark, tmp_path):
    clean = [(k, cases.prose(k, 60), "en", "src0", 1) for k in range(1000)]
    marked = []
    for k in range(2020, 2030):
        split = cases.prose(3000 + k, 60).split()
        split[4] = split[13] = "%"
        marked.append((k, " ".join(split), "en", "src0", 1))
    spark.createDataFrame([(r[0], 1, 0) for r in clean], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(clean + marked, cases.SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(1000))
