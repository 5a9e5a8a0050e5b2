"""The corpus pipeline against a plain Python version of its stages."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ALNUM, LOW, WORD

from tidespan.llm import common

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_masking", "best_fit_packing"]
    items = [grams(ALNUM.findall(r["text"].translate(LOW))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        path = str(tmp_path / name)
        df.write.parquet(path)
        df = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert df.columns == COLUMNS
        got = {r["doc_id"]: r.asDict() for r in df.collect()}
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", r["text"]) for r in got.values())
            assert len(got) >= 0.95 * len(kept)
            kept = got
        elif name == "near_dedup":
            sets = {d: grams(WORD.findall(r["text"].translate(LOW))) for d, r in kept.items()}
            root = {d: d for d in kept}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            ids = sorted(kept)
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    n = len(sets[a] & sets[b])
                    if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            kept = {d: r for d, r in kept.items() if find(d) == d}
            assert got == kept
        elif name == "decontamination":
            own = {d: grams(ALNUM.findall(r["text"].translate(LOW))) for d, r in kept.items()}
            kept = {d: r for d, r in kept.items() if not any(i and len(i & own[d]) >= 0.8 * len(i) for i in items)}
            assert got == kept
        elif name == "secret_masking":
            assert set(got) == set(kept)
            for d, r in got.items():
                if r["text"] != kept[d]["text"]:
                    assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
                else:
                    assert r == kept[d]
            assert not any(re.search(r"AKIA[A-Z0-9]{12,}", r["text"]) for r in got.values())
            kept = got
        else:
            assert set(got) == set(kept)


def staged(spark, docs, sf, tmp_path):
    """docs after each stage but the last, and the last one's rows."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_pipeline_on_awkward_rows(spark, sf, tmp_path, nasty):
    """Nulls in every column, empty and long texts, repeated rows and columns that clash: no crash, columns kept."""
    docs = nasty.withColumn("n_chars", F.char_length("text").cast("long"))
    *kept, packed = staged(spark, docs, sf, tmp_path)
    assert all(k.columns == docs.columns for k in kept)
    ids = [sorted(str(r["doc_id"]) for r in k.select("doc_id").collect()) for k in kept]
    assert not {"3", "4", "5"} & set(ids[0])  # no text, no letters
    assert ids[0].count("None") == 1 and ids[3].count("None") == 1  # without id, a row stays
    assert ids[0].count("2") == 2 and not {"2", "8"} & set(ids[1])  # copies of 1 and 7
    assert {str(r["doc_id"]) for r in packed.collect()} == set(ids[3])


def test_pipeline_on_an_empty_table(spark, sf, tmp_path, empty):
    *kept, packed = staged(spark, empty.withColumn("n_chars", F.lit(None).cast("long")), sf, tmp_path)
    assert all(k.count() == 0 for k in kept) and packed.count() == 0


def test_pipeline_run_leaves_its_result_alone(spark, sf):
    before = set(common._live)
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and set(common._live) - before == {got.stored_at}


def test_pipeline_moves_no_texts_to_drop_a_few(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("near_dedup", "decontamination"):
        plan = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def full_collections(spark):
    """Full collections of the JVM so far (in local mode the driver's is the executor's)."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_pipeline_stages_begin_with_heap_given_back(spark, sf, empty):
    docs = empty.withColumn("n_chars", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        before = full_collections(spark)
        stage(spark, docs, sf)
        assert full_collections(spark) > before, name


def test_packing_takes_no_second_kind_of_python_workers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
