"""The pipeline: each stage's decisions against the operators' own, and what passes from stage to stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from chorale.llm import mixing, neardup, quality


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name == "best_fit_packing":
            assert set(ids(out)) == set(ids(docs))
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name == "language_id":
            assert out.count() >= 0.95 * docs.count()
        if name == "quality_rules":
            assert ids(out) == sorted(r["doc_id"] for r in quality.measure(docs).filter("kept").collect())
        if name == "near_dedup":
            assert ids(out) == sorted(r["doc_id"] for r in neardup.near_duplicates(docs, percent=80).filter("kept").collect())
        if name == "source_mix":
            want = Counter()
            for r in mixing.mix(docs).collect():
                want[r["doc_id"]] += r["copies"]
            assert Counter(ids(out)) == +want
        docs = out


def test_source_mix_of_null_and_repeated_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    docs = docs.selectExpr("case when doc_id < 40 then null when doc_id < 50 then 7 else doc_id end doc_id", "text", "lang", "source", "n_chars")
    planned = mixing.mix(docs).collect()
    out = corpus_pipeline.source_mix(spark, docs, sf_dir)
    assert out.count() == sum(r["copies"] for r in planned)
    assert out.filter("doc_id is null").count() == sum(r["copies"] for r in planned if r["doc_id"] is None)


CLASHES = ("_id", "_copies", "_copy", "_gone", "_host", "_bad", "_failed", "_lang_found", "kept", "size", "copies", "component_id", "rank", "Lang_Pred")


def test_stages_bear_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.filter("doc_id = 0").selectExpr("cast(null as bigint) doc_id", "text", "lang", "cast(null as string) source", "n_chars")
    odd = odd.union(docs.filter("doc_id < 3").selectExpr("doc_id + 900000", "case doc_id when 0 then null when 1 then '' else ' ' end", "cast(null as string)", "source", "n_chars"))
    full = docs.union(odd).union(docs.filter("doc_id = 5")).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES])
    for empty in (False, True):
        rows = full.limit(0) if empty else full
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name == "best_fit_packing":
                assert empty == out.isEmpty()
                break
            assert out.columns == full.columns
            got = out.collect()
            assert bool(got) != empty
            for r in got:
                assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in CLASHES)
            rows = spark.createDataFrame(got, full.schema)
