"""The corpus pipeline, stage by stage, on the smallest tables; and the queries against their SQL."""

import collections

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import decontaminate, mixing, near_dedup, packing, quality
from maskwright.llm import queries as llm
from maskwright.llm.tokenizers_io import Encoder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = tables["documents"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    marks = {r["doc_id"]: r for r in tables["labels"].collect()}
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["quality", "near_dedup", "decontaminate", "mixing", "pack"]

    good = names["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    left = set(ids(good))
    known = [d for d in marks if d in texts]
    assert np.mean([(d in left) == bool(marks[d]["quality"]) for d in known]) > 0.95

    single = names["near_dedup"](spark, docs, SF)
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := t.lower().split())}
    kept = set(ids(single))
    for a in kept & set(shingles):
        for b in kept & set(shingles):
            assert a == b or 100 * len(shingles[a] & shingles[b]) < 75 * len(shingles[a] | shingles[b])

    clean = set(ids(names["decontaminate"](spark, docs, SF)))
    items = [" ".join(r["text"].lower().split()) for r in tables["benchmark"].collect()]
    for d, t in texts.items():
        if any(i in " ".join(t.lower().split()) for i in items):
            assert d not in clean
    assert len(clean) > 0.9 * len(texts)

    mixture = names["mixing"](spark, docs, SF)
    assert mixture.columns == docs.columns

    # packed rows give back the tokens of every document, in order
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    parts = collections.defaultdict(list)
    for r in names["pack"](spark, docs, SF).collect():
        assert r["n_tokens"] <= 2048 and r["position_resets"] == r["cu_seqlens"][:-1]
        matrix = np.frombuffer(r["ids"], "<u2")
        for d, at, a, b in zip(r["doc_ids"], r["token_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts[d].append((at, matrix[a:b].tolist()))
    for d, t in texts.items():
        assert [i for _, p in sorted(parts[d]) for i in p] == list(encode(t or ""))


def odd_rows():
    item = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and then it rests for a while"
    return [
        (1, plain), (1, plain), (2, plain), (None, plain), (None, plain), (3, None), (3, ""), (None, None), (4, f"before {item} after"), (None, f"other {item} words"),
        (5, long), (6, long + " end"), (7, "two words"), (7, "another text of the same id that is longer than five words"), (8, " \t\n"),
    ]


def test_stages_on_odd_tables(spark):
    """Null ids and texts, empty and very long ones, repeated rows and ids, clashing columns, empty tables."""
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("near_key", "leak_key", "mixing_key", "mixing_rate", "score", "id", "key", "n", "component_id", "kept", "row"):
        table = table.withColumn(clash, F.lit("x"))
    bench = spark.createDataFrame([(0, " ".join(f"word{i}" for i in range(30)))], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def kept(df):
        assert df.columns == table.columns
        return collections.Counter((r["doc_id"], (r["text"] or "")[:30]) for r in df.collect())

    rows = collections.Counter((i, (t or "")[:30]) for i, t in odd_rows())
    single = kept(near_dedup.one_of_each(table))
    plain = odd_rows()[0][1][:30]
    # one of all that share a text, though three rows have no id; ids with several texts leave one; rows without words all stay
    assert single[1, plain] == 1 and not single[2, plain] and not single[None, plain] and sum(single[7, x[:30]] for x in ("two words", "another text of the same id th")) == 1
    assert single[3, ""] == 2 and single[None, ""] == 1 and single[5, odd_rows()[10][1][:30]] == 1 and not single[6, odd_rows()[11][1][:30]]
    clean = kept(decontaminate.without_leaks(table, bench))
    assert clean == collections.Counter({k: n for k, n in rows.items() if "before word0" not in k[1] and "other word0" not in k[1]})
    assert kept(quality.accepted(table, labels)) == rows
    assert set(kept(mixing.mixed(table, labels))) <= set(rows)
    for stage in (near_dedup.one_of_each, lambda d: decontaminate.without_leaks(d, bench), lambda d: decontaminate.without_leaks(d, bench.limit(0)), lambda d: quality.accepted(d, labels), lambda d: mixing.mixed(d, labels)):
        assert not kept(stage(table.limit(0)))
    assert packing.pack_tokens(table, public_tokenizers.path("byte_bpe_50k.json")).count() > 0 and packing.pack_tokens(table.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"ids", "cu_seqlens", "position_resets"}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    rows = llm.queries()[name](spark, SF)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in rows.select(names).collect())


def test_names():
    names = [n for n in llm.queries() if not n.startswith("check_")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert all(n in llm.oracle_sql() for n in llm.queries() if n.startswith("check_"))
