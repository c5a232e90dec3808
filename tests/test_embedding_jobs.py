import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.operators import embedding_jobs as jobs
from postscope.operators import next_fit
from postscope.plans import embed
from postscope.sources import vectors as files


def test_text_preparation(spark):
    rows = [(1, "  \n\t "), (2, None), (3, " a\tb\nc "), (4, "w " * 9), (5, "w " * 5)]
    posts = spark.createDataFrame(rows, "post_id bigint, text_col string")
    found = {r.post_id: (r.text, r.n_tokens) for r in
             jobs.prepare_embedding_text(posts, max_tokens=5).collect()}
    assert found == {
        1: (fv.NO_CONTENT, 1),
        2: (fv.NO_CONTENT, 1),
        3: ("a b c", 3),
        4: ("w w w w w", 5),
        5: ("w w w w w", 5),
    }


def brute_force(sizes, budget):
    numbers, batch, used = [], 0, 0
    for size in sizes:
        if used and used + size > budget:
            batch, used = batch + 1, 0
        numbers.append(batch)
        used += size
    return numbers


@pytest.mark.parametrize("parts, bits", [(1, 16), (8, 5), (200, 3)])
def test_batches_are_those_of_one_pass(spark, parts, bits):
    """One block, some, and hundreds in two levels of ranges, from any layout."""
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) if i % 900 > 300 else 1 for i in range(5000)]
    rows = [(3 * i, f"t{i}", size) for i, size in enumerate(sizes)]
    rng.shuffle(rows)
    prepared = spark.createDataFrame(rows, "post_id bigint, text string, n_tokens int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = jobs.token_budget_batches(prepared, 50, bits).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found.sort(key=lambda r: r.post_id)
    assert [(r.post_id, r.n_tokens) for r in found] == [(3 * i, size) for i, size in enumerate(sizes)]
    assert [r.batch for r in found] == brute_force(sizes, 50)


def test_batches_by_two_levels_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(next_fit, "RANGE_BITS", 1)
    sizes = [1 + i * 7 % 40 for i in range(3000)]
    prepared = spark.createDataFrame(list(enumerate(sizes)), "post_id bigint, n_tokens int").repartition(8)
    found = sorted(jobs.token_budget_batches(prepared, 40, 4).collect(), key=lambda r: r.post_id)
    assert [r.batch for r in found] == brute_force(sizes, 40)
    assert max(Counter(r.batch for r in found).values()) > 1


def test_transfer_functions_and_their_composition():
    rng = np.random.default_rng(1)
    for t in range(400):
        budget, n = int(rng.integers(1, 30)), int(rng.integers(2, 25))
        sizes = rng.integers(t % 2, min([1, 3, budget][t % 3], budget) + 1, n)
        cut = int(rng.integers(1, n))
        whole = next_fit.transfer_of(sizes, budget)
        parts = [next_fit.transfer_of(x, budget) for x in (sizes[:cut], sizes[cut:])]
        both = next_fit.compose(*parts, budget)
        for used in range(budget + 1):
            wanted = brute_force([used, *sizes], budget)[1:]
            end = sum(s for s, b in zip([used, *sizes], [0, *wanted]) if b == wanted[-1])
            assert whole.at(used, budget) == both.at(used, budget) == (wanted[-1], end)
            assert next_fit.batch_numbers(sizes, budget, 0, used).tolist() == wanted
        assert len(whole.first) <= budget + 1 and len(both.first) <= budget + 1


def test_budget_holds_and_no_post_is_lost(spark):
    posts = spark.range(3000).select(
        F.col("id").alias("post_id"),
        F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text_col"),
    )
    prepared = jobs.prepare_embedding_text(posts, 40)
    batches = jobs.token_budget_batches(prepared, budget=40)
    sums = batches.groupBy("batch").agg(F.sum("n_tokens").alias("n"))
    assert sums.agg(F.max("n")).first()[0] == 40  # the exact fit is used
    assert batches.select("post_id").distinct().count() == 3000
    assert jobs.token_budget_batches(prepared.where("false")).collect() == []


def test_tokens_as_python_sees_them():
    """Every white-space character of Python, whole texts, null and cut texts in one batch."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{s}bé{s}{s}日c" for s in spaces] + ["", None, " ", "x", " x\u2003", "\u3000", "\u0085\u00a0é", "à" * 9, "\u200b \ufeff y"]
    texts = texts + ["".join(random.Random(i).choices([*spaces, "a", "é", "日", "\U0001f600"], k=60)) for i in range(300)]
    for limit in (0, 1, 3, 100):
        found = jobs.token_sizes(pa.array(["cut off", *texts]).slice(1), limit).to_pylist()
        for text, row in zip(texts, found):
            tokens = (text or "").split()
            assert row["count"] == len(tokens)
            if len(tokens) > limit:
                kept = text[: row["cut"]]
                assert kept.split() == tokens[:limit] and kept == kept.rstrip()
            else:
                assert row["cut"] is None
    assert len(jobs.token_sizes(pa.array([], pa.string()), 5)) == 0


def test_mismatches_both_ways_and_repeats(spark):
    posts = spark.createDataFrame([(1,), (2,), (3,)], "post_id bigint")
    vectors = spark.createDataFrame([(2,), (3,), (3,), (4,)], "post_id bigint")
    rows = {tuple(r) for r in files.vector_mismatches(posts, vectors).collect()}
    assert rows == {(1, 1, 0), (3, 1, 2), (4, 0, 1)}


def test_write_and_load_check_the_match(spark, tmp_path):
    records = spark.createDataFrame(
        [(1, "a"), (2, "b")], "post_id bigint, title string"
    ).select(F.struct("*").alias("data"))
    assert embed.embedding_batches(records, budget=10).count() == 2
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "post_id bigint, embedding array<float>")
    path = str(tmp_path / "vectors")
    embed.store_vectors(vectors, records, path)
    flat = records.select("data.*")
    assert files.load_embeddings(spark, path, flat).count() == 2
    with pytest.raises(ValueError, match="one to one"):
        files.load_embeddings(spark, path, flat.filter("post_id = 1"))
    with pytest.raises(ValueError):
        embed.store_vectors(vectors.limit(1), records, str(tmp_path / "other"))


def test_white_space_of_all_kinds_and_exact_prefixes(spark):
    rows = [(1, "\r\r"), (2, "\u00a0\u2003\x1f"), (3, "\r\nhello"), (4, "\x0b hi there"), (5, "a  b\u00a0 c c d"), (6, "a  b c")]
    posts = spark.createDataFrame(rows, "post_id bigint, text_col string")
    found = {r.post_id: (r.text, r.n_tokens) for r in jobs.prepare_embedding_text(posts, max_tokens=3).collect()}
    none = (fv.NO_CONTENT, 1)
    assert found == {1: none, 2: none, 3: ("hello", 1), 4: ("hi there", 2), 5: ("a  b\u00a0 c", 3), 6: ("a  b c", 3)}


def test_a_text_beyond_the_budget_is_an_error(spark):
    prepared = spark.createDataFrame([(1, 5), (7, 300)], "post_id bigint, n_tokens int")
    with pytest.raises(Exception, match="larger than the budget: post 7"):
        jobs.token_budget_batches(prepared, budget=100).collect()


def test_texts_are_not_translated_by_character(spark):
    posts = spark.createDataFrame([(1, " a\tb\n\nc\n")], "post_id int, text_col string")
    prepared = jobs.prepare_embedding_text(posts)
    assert "translate" not in prepared._jdf.queryExecution().optimizedPlan().toString()
    assert prepared.first().text == "a b  c"
