"""The registered queries against DuckDB, and the pipeline against its brute-force form."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm.queries import ORACLE_SQL, QUERIES
from pagewright.llm import packing
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


def test_pipeline(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    verdict = {r.doc_id: r.kept for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    kept = {d: t for d, t in docs.items() if verdict[d]}
    kept = brute.dedup_lines(sorted(kept.items()))
    root = brute.components({d: brute.fingerprint(t) for d, t in kept.items()})
    kept = {d: t for d, t in kept.items() if root[d] == d}
    bad = {d for d, *_ in brute.contaminated(kept.items(), items)}
    expected = set()
    for d, t in kept.items():
        if d not in bad:
            ids, start = brute.token_ids(t, 0), 0
            for n in packing.piece_lengths(len(ids)):
                expected.add((d, start, n, brute.ids_crc(ids[start : start + n])))
                start += n
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Null and repeated ids, repeated rows, null texts and clashing columns through all stages; then an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id") % 10
    odd = docs.withColumn("doc_id", F.when(k == 3, None).when(k == 4, 7).otherwise(F.col("doc_id")))
    odd = odd.unionByName(docs.filter(k == 5)).unionByName(docs.filter(k == 5)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    odd = odd.withColumns({c: F.lit("x") for c in ("_row", "th", "fp", "kept", "n_words", "_drop", "length", "item_id")})
    got = odd
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        (tmp_path / name).mkdir()
        stage(spark, got, sf_dir).write.parquet(str(tmp_path / name / "out"))
        got = spark.read.parquet(str(tmp_path / name / "out"))
        kept.append(got.collect())
        if name != "packing":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, lines, single, clean, pieces = kept
    assert any(r.doc_id is None for r in clean) and sum(r.doc_id == 7 for r in clean) > 1
    assert all(r.text for r in good) and len(lines) == len(good) < odd.count()
    linked = lambda rows: len(set(brute.components({i: brute.fingerprint(r.text) for i, r in enumerate(rows)}).values()))
    assert len(single) == linked(single) == linked(lines)
    expected = []
    for r in clean:
        ids, start = brute.token_ids(r.text, 0), 0
        for n in packing.piece_lengths(len(ids)):
            expected.append((r.doc_id, start, n, brute.ids_crc(ids[start : start + n])))
            start += n
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces), key=repr) == sorted(expected, key=repr)
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))
    (tmp_path / "none").mkdir()
    odd.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
