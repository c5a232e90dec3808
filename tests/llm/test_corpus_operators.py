"""Corpus operators against plain Python on a small corpus with hard rows, and on empty tables."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from postscope.llm import jaccard, langid, mixing, packing, quality, repeats, vectors, warc  # noqa: E402
from postscope.llm.jaccard import jaccard_components, one_of_each  # noqa: E402
from postscope.llm.mixing import fill_targets, mix_sources, mixed_documents  # noqa: E402
from postscope.llm.packing import best_fit_rows, pack_tokens, row_positions  # noqa: E402
from postscope.llm.pieces import ChunkTable, encode_pieces, piece_digests  # noqa: E402
from postscope.llm.quality import clean_documents, quality_rules  # noqa: E402
from postscope.llm.queries import QUERIES, byte_ranks, piece_model  # noqa: E402
from postscope.llm.radix import remove_repeated_bytes  # noqa: E402
from postscope.llm.shared import BATCH_BYTES, BATCH_SETTING, components, written  # noqa: E402
from postscope.llm.suffix_trees import documents_without_repeats, remove_repeated_words  # noqa: E402
from postscope.llm.vectors import near_vectors, tables_for  # noqa: E402

ROWS = brute.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.DOC_SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.DOC_SCHEMA)


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def texts():
    return [(r[0], r[1]) for r in ROWS]


def test_quality_rules(docs):
    wanted = brute.quality([(r[0], r[1], r[3]) for r in ROWS])
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    verdict = quality_rules(docs)
    assert rows_of(verdict, *names) == sorted(((d, *c, f, k) for d, c, f, k, _ in wanted), key=repr)
    assert any(t != r[1] for (*_, t), r in zip(wanted, ROWS))
    out = clean_documents(docs, verdict)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id", "text") == sorted(((d, t) for d, _, _, k, t in wanted if k), key=repr)


def test_quality_rules_reject_depleted_documents(spark):
    line = "one line of seven words is here"
    rows = [(i, "\n".join([line + str(k) for k in range(6)]), "h") for i in range(20)]
    rows += [(100 + i, " ".join(f"w{i}x{k}" for k in range(30)), "h") for i in range(30)]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sorted(d for d, k in kept.items() if not k) == list(range(1, 20))


def test_quality_rules_remove_lines_of_a_hot_source(spark):
    """A line in 1,400 of 150,000 documents, less than one per cent of its source."""
    rows = spark.range(0, 150_000, 1, 8).selectExpr(
        "id AS doc_id", "concat('own', id, if(id < 1400, '\\na line of the site', '')) AS text", "'hot' AS source"
    )
    removed = quality_rules(rows).where("removed_words > 0").select("doc_id", "removed_words").collect()
    assert sorted(removed) == [(i, 5) for i in range(1, 1400)]


def test_jaccard_components(docs):
    wanted = brute.jaccard(texts())
    found = {brute.no_null(r.doc_id): (r.n_shingles, brute.no_null(r.component_id)) for r in jaccard_components(docs).collect()}
    assert found == wanted
    kept = one_of_each(docs, jaccard_components(docs, 5, 80))
    assert kept.columns == docs.columns
    wanted = brute.jaccard(texts(), 5, 80)
    wanted = {(r[0], r[1]) for r in ROWS if wanted[brute.no_null(r[0])][1] == brute.no_null(r[0])}
    assert rows_of(kept, "doc_id", "text") == sorted(wanted, key=repr) and (None, ROWS[0][1]) not in wanted


def test_jaccard_links_every_text_of_an_id(spark):
    """Near copies of the smaller of two texts with one id, and of rows without an id."""
    rng = np.random.default_rng(4)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    small, large, lost, other, far = text(100), text(300), text(120), text(200), text(90)
    rows = [(5, small), (5, large), (9, [*small, "x"]), (8, [*large, "y"]), (12, far), (13, [*far, "z"])]
    rows += [(None, lost), (None, other), (20, ["q", *lost]), (21, [*other, "r"]), (None, lost)]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame).collect()}
    assert found == {
        5: (297, 5), 9: (98, 5), 8: (298, 5), 12: (87, 12), 13: (88, 12), None: (197, None), 20: (118, None), 21: (198, None)
    }


def test_stars_hold_each_set_once_per_key():
    """Repeated rows and keys that go on in the next batch."""
    rows = [(1, 4), (1, 4), (1, 6), (1, 6), (1, 7), (2, 3), (2, 3), (3, 1), (3, 2)]
    for size in (1, 2, 3, 9):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*p)], names=["key", "set_id"]) for p in parts]
        found = [tuple(r.values()) for b in jaccard._stars(iter(batches)) for r in b.to_pylist()]
        assert sorted(found) == [(1, 4, 4), (1, 4, 6), (1, 4, 7), (3, 1, 1), (3, 1, 2)]


def test_jaccard_in_small_blocks_with_chains(spark, monkeypatch):
    """Texts of which each links with its neighbours only, compared in blocks of four."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"w{i}" for i in range(400)]
    rows = [(99 - k if k % 2 else k, " ".join(base[k * 8 : k * 8 + 200])) for k in range(25)]
    rows += [(200 + k, " ".join(base[:60] + [f"v{k}x{i}" for i in range(40)])) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame).collect()}
    assert found == brute.jaccard(rows)
    assert len({c for d, (_, c) in found.items() if d < 200}) < 25


@pytest.mark.parametrize("nearest", [True, False])
def test_blocks_hold_the_pairs_of_one_turn(nearest):
    """4,000 sets of one key that are all close and all apart: eight million pairs."""
    n, rng = 4000, np.random.default_rng(7)
    flips = [np.packbits(row, bitorder="little").tobytes() for row in (rng.random((n, 64)) < 0.05).astype(np.uint8)]
    zero, one = np.zeros(n, np.int64), np.ones(n, np.int64)
    columns = [zero, zero, zero, np.arange(n), np.arange(n), 60 * one, pa.array(flips, pa.binary()), zero]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("klhscnxd"))
    tracemalloc.start()
    found = set()
    for batch in jaccard._blocks(80, nearest)(iter([rows])):
        if nearest:
            found |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    if nearest:
        bits = np.unpackbits(np.frombuffer(b"".join(flips), np.uint8).reshape(n, 8), axis=1).astype(np.int16)
        wanted = set()
        for i in range(n):
            apart = np.abs(bits - bits[i]).sum(axis=1)
            apart[i] = 99
            j = int(apart.argmin())  # of equals the smallest id
            if apart[j] <= 20 * 120 // 180:
                wanted.add((min(i, j), max(i, j)))
        assert found == wanted


def test_lines_are_cut_some_rows_at_a_time():
    """A batch of 16 MB leaves as batches of about one, with the same rows."""
    texts = [f"keep {i}\ngone\n" + "x" * 4000 for i in range(4000)] + [None, ""]
    gone = [[quality.line_key("h", b"gone")] if i % 3 else None for i in range(len(texts))]
    columns = [pa.array(texts), pa.array(["h"] * len(texts)), pa.array(gone, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["text", "source", "keys"])
    out = list(quality._cut_lines(0, 1, 2)(iter([batch])))
    assert max(sum(len(t or "") for t in b.column(0).to_pylist()) for b in out) <= 1 << 20
    found = [t for b in out for t in b.column(0).to_pylist()]
    assert found == [t.replace("gone\n", "") if t and g else t for t, g in zip(texts, gone)]


def test_long_rows_reach_python_tasks_in_small_batches(spark):
    """2,000 texts of 20 KB in one task came as one batch of 40 MB; a bound of the session's own holds."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 20000) AS text")
    try:
        for given, most in ((None, BATCH_BYTES + (1 << 20)), (str(16 << 20), 17 << 20)):
            spark.conf.unset(BATCH_SETTING) if given is None else spark.conf.set(BATCH_SETTING, given)
            found = written(rows.mapInArrow(sizes, "n long, b long"), "sizes").collect()
            assert sum(r.n for r in found) == 2000
            assert most / 2 < max(r.b for r in found) < most
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_sets_of_a_batch_are_made_some_texts_at_a_time():
    """A batch of 8 MB: arrays of 8 bytes for each of its bytes are held for some texts only."""
    texts = [" ".join(f"w{(i * 7 + k) % 9973}" for k in range(700)) for i in range(2000)]
    numbers = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts)], names=["doc_id", "text_hash", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in jaccard._sets(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts)
    assert peak < 32 << 20


def test_chunk_table_holds_surfaces_that_differ_only():
    table = ChunkTable(piece_model())
    texts = [r[1] for r in ROWS] + ["plain words of a text", "ﬁne ½ wide\u3000blank\ttab\x01"]
    rows = table.codec_rows(texts)
    assert len(table.surface) < len(table.ids) / 2
    assert all(chunk != shown for chunk, shown in table.surface.items())
    codec = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    for text, (ids, decoded) in zip(texts, rows):
        wanted = codec.encode(text or "", add_eos=True)
        assert (ids, decoded) == (" ".join(map(str, wanted)), codec.decode(wanted))


def test_piece_keys_always_meet():
    """Random sets at the threshold share a key, whatever their size."""
    rng = np.random.default_rng(5)
    for n in [1, 2, 5, 6, 7, 8, 13, 20, 21, 50, 123, 400, 1500]:
        for _ in range(40 if n < 200 else 5):
            d = jaccard.most_different(2 * n, jaccard.PERCENT) // 2
            pool = rng.integers(1, 1 << 63, n + d, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - d], pool[n:]]))
            assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
            assert len(np.intersect1d(jaccard.piece_keys(a), jaccard.piece_keys(b)))
            x, y = (np.frombuffer(jaccard.parity_sketch(s), np.uint8) for s in (a, b))
            size = min(len(x), len(y))
            apart = np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum()
            assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    frame = spark.createDataFrame(links + links[:5], "u long, v long")
    wanted = brute.smallest({x for e in links for x in e}, links)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert dict(rows_of(components(frame), "id", "component_id")) == {k: v for k, v in wanted.items() if k not in loops}


@pytest.mark.parametrize("hot", [repeats.GROUP_ROWS, 1])
def test_repeated_bytes(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "GROUP_ROWS", hot)
    out = remove_repeated_bytes(docs)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.removed_bytes(texts()), key=repr)


@pytest.mark.parametrize("hot", [repeats.GROUP_ROWS, 1])
def test_repeated_words(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "GROUP_ROWS", hot)
    out = remove_repeated_words(docs)
    wanted = brute.removed_words(texts())
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept") == sorted(wanted, key=repr)
    assert sum(w[2] for w in wanted) > 500
    cut = documents_without_repeats(docs, out)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)


@pytest.mark.parametrize("remove, wanted_of, columns", [
    (remove_repeated_bytes, brute.removed_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    (remove_repeated_words, brute.removed_words, ["doc_id", "n_words", "n_removed", "kept"]),
])
def test_repeats_whose_prefixes_span_batches_and_copies_of_rows(spark, docs, remove, wanted_of, columns):
    unit = "one two three four five six seven "
    rows = texts() + [(2000, unit * 40), (2001, "x " + unit * 30 + "y"), (None, unit * 20)] + texts()[:9] * 3
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        found = rows_of(remove(frame), *columns)
    finally:
        spark.conf.set(name, before)
    assert found == sorted(wanted_of([r[:2] for r in rows]), key=repr)


def test_open_rows_of_one_class_do_not_wait_in_memory():
    def batch(prefix, around, doc, places):
        n = len(places)
        columns = [[prefix] * n, [around] * n, [doc] * n, places]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["prefix", "around", "doc_id", "place"])

    one_class = [batch(1, 5, 3, list(range(k * 100, k * 100 + 100))) for k in range(20)]
    read = []
    stream = repeats._settle(b for b in one_class if read.append(b) is None)
    for seen, out in enumerate(stream, 1):
        assert len(read) == seen and out.num_rows == 100 and out.column(0).null_count == 100
    assert seen == 20
    mixed = one_class + [batch(1, 6, 9, [7]), batch(1, 6, 9, [8]), batch(2, 1, 1, [1])]
    states = [r for b in repeats._settle(iter(mixed)) for r in b.to_pylist()]
    assert [(r["settled"], r["prefix"], r["doc_id"], r["place"]) for r in states[2000:]] == [
        (False, 1, 9, 7), (False, 1, 9, 8), (None, 2, 1, 1)]


def test_rows_of_one_id_keep_their_own_verdicts_and_texts(spark):
    def own(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    passage = own("p", 60)
    rows = [(1, passage), (5, own("a", 30) + " " + passage), (5, own("b", 40)), (5, passage + " " + own("c", 25))]
    rows += [(None, own("d", 30)), (None, "short"), (7, own("e", 30)), (7, "short"), (7, None)]
    frame = spark.createDataFrame([(d, t, "s", len(t or "")) for d, t in rows], "doc_id long, text string, source string, n_chars int")
    kept = clean_documents(frame, quality_rules(frame))
    assert rows_of(kept, "doc_id", "text") == sorted((r for r in rows if r[1] not in ("short", None)), key=repr)
    out = documents_without_repeats(frame, remove_repeated_words(frame))
    wanted = [(d, t if d == 1 or t is None else t.replace(passage, "").strip()) for d, t in rows]
    assert rows_of(out, "doc_id", "text", "n_chars") == sorted(((d, t, len(t or "")) for d, t in wanted), key=repr)


def test_mix_sources(docs):
    wanted = brute.mix([(r[0], r[1], r[3]) for r in ROWS])
    mix = mix_sources(docs)
    assert rows_of(mix, "doc_id", "size", "source_size", "copies") == sorted(((*w[:3], w[4]) for w in wanted), key=repr)
    assert sorted(r.target for r in mix.collect()) == pytest.approx(sorted(w[3] for w in wanted))
    assert rows_of(mix, "doc_id", "taken") == sorted(((d, n * c) for d, n, _, _, c in wanted), key=repr)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id", "text") == sorted(((r[0], r[1]) for r, w in zip(ROWS, wanted) for _ in range(w[4])), key=repr)


@pytest.mark.parametrize("share, most", [(1.5, 2), (2.5, 2), (0.3, 1), (0.0, 2)])
def test_mix_of_more_sources_than_a_list_holds(spark, docs, monkeypatch, share, most):
    """Planned as tables, a mix is the same as one planned as a list."""
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s\u00e9"), F.col("doc_id") % 17)).otherwise(F.col("source"))
    frame = docs.withColumn("source", own).persist()
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    wanted = rows_of(mix_sources(frame, share=share, most=most), *names)
    wanted_rows = rows_of(mixed_documents(frame, share=share, most=most), "doc_id", "text")
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert rows_of(mix_sources(frame, share=share, most=most), *names) == wanted
    assert rows_of(mixed_documents(frame, share=share, most=most), "doc_id", "text") == wanted_rows



def test_mixed_rows_of_one_id_are_copied_as_reported(spark):
    """Rows without an id, or with one id, in sources with different copies."""
    rows = [(None, "a " * 40, "a"), (None, "b " * 40, "b"), (None, "c " * 400, "c"), (5, "x", "a"), (5, "y y", "c"), (5, "y y", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    reported = mix_sources(frame).collect()
    out = mixed_documents(frame).collect()
    assert sum(r.taken for r in reported) == sum(len(r.text.split()) for r in out)
    wanted = [row for row, m in zip(rows, brute.mix(rows)) for _ in range(m[4])]
    assert sorted(map(tuple, out), key=repr) == sorted(wanted, key=repr)


def test_rows_without_an_id_in_one_source_are_not_taken_alike(spark):
    """A source of which no row has an id comes near its target."""
    rows = [(None, f"word{i} " * 20, "only") for i in range(400)]
    mix = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert abs(sum(r.taken for r in mix) - mix[0].target) <= 20 and {r.copies for r in mix} == {1, 2}


def test_lines_are_counted_in_documents_and_stay_in_one(spark):
    """One document twelve times is one document; of rows without an id one keeps the line."""
    line = "this line of eight words is shared here"
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    few = [(1, f"{own(1)}\n{line}", "s")] * 12 + [(2, f"{own(2)}\n{line}", "s")]
    none = [(None, f"{own(100 + i)}\n{line}", "t") for i in range(40)] + [(None, f"{own(100)}\n{line}", "t")]
    frame = spark.createDataFrame(few + none, "doc_id long, text string, source string").repartition(3)
    found = quality_rules(frame)
    assert found.where("doc_id IS NOT NULL AND removed_words > 0").count() == 0
    left = clean_documents(frame, found).where("doc_id IS NULL").collect()
    assert len(left) == 41 and len({r.text for r in left if line in r.text}) == 1


def test_targets_share_the_excess():
    assert fill_targets([100, 100, 100], [5, 2, 1]) == [200.0, 250 * 2 / 3, 250 / 3]
    assert fill_targets([10, 0, 1000], [5, 2, 1]) == [20.0, 0.0, 1495.0]
    assert fill_targets([], []) == []


def test_pieces(docs):
    model = piece_model()
    codec = sentencepiece.SentencePieceProcessor(model_proto=model)
    wanted = [(d, codec.encode(t or "", add_eos=True)) for d, t in texts()]
    found = encode_pieces(docs, model)
    assert rows_of(found, "doc_id", "ids", "decoded") == sorted(((d, i, codec.decode(i)) for d, i in wanted), key=repr)
    digests = [
        (d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(codec.decode(i).encode()).hexdigest())
        for d, i in wanted
    ]
    assert rows_of(piece_digests(docs, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(digests, key=repr)


def test_language(spark, docs):
    out = langid.identify_language(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "und"}
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {r[0] for r in ROWS if r[1] in (None, "", "12 34 !!")}
    unlabelled = docs.withColumn("lang", docs["lang"].substr(10, 1).eqNullSafe("x").cast("string").substr(9, 1)).where("false")
    assert langid.identify_language(unlabelled).count() == 0


def test_language_of_repeated_rows(spark):
    """Each row three times, one id a hundred times: every language is learned from, by one row per id."""
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    rows = [
        (i * 4 + k, " ".join(letters[lang][(i + j) % 5] * (1 + j % 3) for j in range(12)), lang)
        for i in range(30)
        for k, lang in enumerate(letters)
    ]
    frame = spark.createDataFrame(rows * 3 + rows[:1] * 100, "doc_id long, text string, lang string").repartition(4)
    bits, labels = langid.training_rows(frame, 40)
    assert len(bits) == len(labels) and {x: labels.count(x) for x in letters} == dict.fromkeys(letters, 10)
    truth = {r[0]: r[2] for r in rows}
    found = langid.identify_language(frame, 40).collect()
    assert len(found) == len(rows) * 3 + 100 and all(r.lang_pred == truth[r.doc_id] for r in found)


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_languages(spark, size):
    path = f"/root/testdata/{size}"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, path).collect() if r.held_out]
    assert len(held) > 100 and sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held)


PAGES = [
    (3, "http://a/3", "x" * 100), (1, "http://a/1", "x" * 100), (2, None, "x" * 99), (4, "u\r\nv", "x" * 99),
    (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7", "é\r\n\r\nWARC/1.1\r\n" * 5000), (8, "", "é" * 50),
    (9, "http://a/9", "é" * 50), (10, "http://a/10", "x" * 100), (10, "http://a/10", "x" * 100), (None, None, "n" * 200),
    (1, "http://a/1", "x" * 100),
]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_warc(pages, f"file://{tmp_path}")
    records = warc.read_warc(index).collect()
    assert len(records) == len(PAGES)
    payloads = {(p[0], (p[2] or "").encode()) for p in PAGES}
    for r in records:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload)) in payloads and len(r.payload) == r.payload_bytes
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    first = hashlib.sha256(b"x" * 100).hexdigest()
    found = sorted((r.page_id, r.record_type, r.refers_to) for r in records if r.payload_digest == first)
    assert found == [(1, "response", None), (1, "response", None), (3, "revisit", 1), (10, "revisit", 1), (10, "revisit", 1)]
    assert [(r.page_id, r.refers_to) for r in records if r.record_type == "revisit" and r.payload_digest != first] == [(9, 8)]
    some = warc.read_warc(index.where("page_id IN (7, 9)")).collect()
    assert sorted(r.page_id for r in some) == [7, 9]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def test_warc_pages_without_id(spark, tmp_path):
    rows = [(None, "u", "p" * 200), (3, "v", "p" * 200), (4, "w", "p" * 200), (None, None, "q" * 200), (None, "x", "q" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_warc(pages, f"file://{tmp_path}")
    found = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(index).collect()]
    expected = [(3, "response", None), (4, "revisit", 3), (None, "revisit", 3), (None, "response", None), (None, "response", None)]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_warc_is_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(0, 400, 1, 10).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 50).alias("html")
    )
    records = warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}"))
    assert records.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert records.count() == 400


def test_language_scores_are_kernel_ridge(spark):
    """With every row a landmark the scores are those of the direct kernel matrix, and cells stand for n-grams."""
    rng = np.random.default_rng(5)
    letters = {"aa": "abcdefg ", "bb": "cdefghi ", "cc": "uvwxyz "}
    labels = [lang for lang in letters for _ in range(12)]
    texts = ["".join(rng.choice(list(letters[lang]), 20 + 5 * i)) for i, lang in enumerate(labels)]

    def grams(text: str) -> set:
        return {text[i : i + n] for n in langid.ORDERS for i in range(len(text) - n + 1)}

    sets = [grams(t) for t in texts]
    cells = np.zeros((len(texts), langid.CELLS), np.float32)
    counts = langid.presence(texts, cells)
    assert (cells.max(axis=0) > 0).sum() > 0.9 * len(set.union(*sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):  # n-grams in common, but for those that share a cell
            collisions = len(a | b) - np.maximum(cells[i], cells[j]).sum()
            assert abs(cells[i] @ cells[j] - len(a & b)) <= collisions
    hashed = cells @ cells.T / np.sqrt(np.outer(counts, counts))
    train = np.arange(len(texts)) % 3 > 0
    model = langid.fit(np.packbits(cells[train] > 0, axis=1), [x for x, t in zip(labels, train) if t], landmarks=10**6)
    n = int(train.sum())
    inner = hashed[np.ix_(train, train)].astype(np.float64)
    middle = np.eye(n) - 1 / n
    target = np.array([[x == lang for lang in letters] for x, t in zip(labels, train) if t], float)
    dual = np.linalg.solve(middle @ inner @ middle + langid.RIDGE * n * np.eye(n), target - target.mean(axis=0))
    direct = (hashed[:, train] - inner.mean(axis=0)) @ middle @ dual + target.mean(axis=0)
    assert np.abs(model.scores(cells, counts) - direct).max() < 1e-3


def test_languages_are_learned_from_texts_with_letters(spark):
    rows = [(i, None if i < 300 else "zz yy xx", "zz") for i in range(330)] + [(1000 + i, "aa bb cc", "aa") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits, labels = langid.training_rows(docs, train_rows=20)
    assert labels.count("zz") == labels.count("aa") == 10


def vectors_with_links() -> list[tuple]:
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 16))
    rows = [(i, base[i % 12] + rng.standard_normal(16) * (0.22 if i % 3 else 0.1)) for i in range(150)]
    out: list[tuple] = [(i * 2, [float(x) for x in v]) for i, v in rows]
    out += [(1000 + i, out[0][1]) for i in range(5)] + [(1010, [3 * x for x in out[1][1]]), (1011, [-x for x in out[1][1]])]
    out += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [math.nan] + [1.0] * 15)]
    out += [(2005, [math.inf] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [1.0, 2.0]), (2008, [2.0, 4.1]), (2009, [1e-300] * 16)]
    return out


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows = vectors_with_links()
    ok = {i: np.array(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    root = brute.smallest([i for i, _ in rows], links)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, digest string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame.repartition(4)).collect()}
    counts = {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert len(links) > 300
    assert found == {i: (counts[i], root[i], root[i] == i) for i, _ in rows}
    assert near_vectors(frame.where("false")).count() == 0


def test_near_vectors_of_equal_and_null_ids(spark):
    """Links and components belong to vectors, whatever their ids."""
    a = [1.0, 0.0, 0.0, 0.0]
    near = lambda x: [1.0, x, 0.0, 0.0]
    rows = [(9, near(0.01)), (None, near(0.02)), (None, near(0.03)), (5, a), (5, [0.0, 0.0, 0.0, 1.0]), (6, near(0.04)), (7, near(0.05))]
    rows += [(None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.01]), (None, None)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr)
    wanted = [(9, 5, 5, False), (None, 5, 5, False), (None, 5, 5, False), (5, 5, 5, True), (5, 0, 5, True), (6, 5, 5, False), (7, 5, 5, False)]
    wanted += [(None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert got == sorted(wanted, key=repr)


def test_tables_keep_their_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = tables_for(n)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.9999


def test_recall_of_links_among_six_thousand_vectors(spark):
    """Nine bits and more tables than small inputs take; every link of brute force but 1 in 1,000 is found."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2000, 32))
    others = [base + rng.standard_normal(base.shape) * np.linspace(0.2, 0.4, 2000)[:, None] for _ in range(2)]
    x = np.concatenate([base, *others])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert tables_for(6000)[0] == 9 and 1500 < wanted.sum() < 11_000
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = dict(rows_of(near_vectors(frame.repartition(4)), "vec_id", "n_links"))
    found = np.array([found[i] for i in range(len(x))])
    assert (found <= wanted).all() and found.sum() >= 0.999 * wanted.sum()


def test_packing(docs):
    import base64

    import tiktoken

    ranks, pattern = byte_ranks()
    merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
    codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    rows = pack_tokens(docs, ranks, pattern, row_ids=128).collect()
    pieces = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 128 and r.cumulative[-1] == r.n_ids and (ids[r.n_ids :] == 50256).all()
        assert r.resets == r.cumulative[:-1] and (row_positions(r.cumulative, 128)[r.resets] == 0).all()
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cumulative[:-1], r.cumulative[1:]):
            pieces.setdefault((d, p), []).append(ids[a:b].tolist())
    for d, t in set(texts()):
        wanted = [*codec.encode_ordinary(t or ""), 50256]
        cut = [wanted[i : i + 128] for i in range(0, len(wanted), 128)]
        times = texts().count((d, t))
        assert [pieces[d, k] for k in range(len(cut))] == [[c] * times for c in cut]
    assert sum(map(len, pieces.values())) == sum(len(r.doc_ids) for r in rows)


def test_packing_deals_rows_without_an_id(spark, monkeypatch):
    """A third of the rows without an id, a third one repeated row: shards stay near their size."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 4000)
    rows = [(None, f"no id {i} " + "x " * 20) for i in range(400)] + [(7, "again " * 8)] * 400
    rows += [(100 + i, f"id {i} " + "y " * 20) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, held = {}, []
    for r in pack_tokens(frame, *byte_ranks(), row_ids=128).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.doc_ids)
        held += r.doc_ids
    assert sorted(held, key=repr) == sorted((r[0] for r in rows), key=repr)
    assert len(sizes) > 8 and max(sizes.values()) < 3 * len(rows) / len(sizes)


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for most in (1, 7, 64, 100):
        sizes = sorted(rng.integers(1, most + 1, 200).tolist(), reverse=True)
        gaps, wanted = [], []
        for i, s in enumerate(sizes):
            fit = [(g, k) for k, g in enumerate(gaps) if g >= s]
            if fit:
                k = min(fit)[1]
                gaps[k] -= s
                wanted[k].append(i)
            else:
                gaps.append(most - s)
                wanted.append([i])
        assert best_fit_rows(sizes, most) == wanted


def test_empty_tables(spark, empty):
    model = piece_model()
    for frame in (
        quality_rules(empty), clean_documents(empty, quality_rules(empty)), jaccard_components(empty), mix_sources(empty),
        remove_repeated_bytes(empty), remove_repeated_words(empty), piece_digests(empty, model), encode_pieces(empty, model),
        langid.identify_language(empty), pack_tokens(empty, *byte_ranks()), mixed_documents(empty),
        one_of_each(empty, jaccard_components(empty)), documents_without_repeats(empty, remove_repeated_words(empty)),
    ):
        assert frame.collect() == []


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    verdict = brute.quality(rows)
    ok = {d for d, _, _, k, _ in verdict if k}
    rows = [(d, t, s) for (d, _, s), (*_, t) in zip(rows, verdict) if d in ok]
    near = brute.jaccard([(d, t) for d, t, _ in rows], 5, 80)
    rows = sorted({(d, t, s) for d, t, s in rows if near[brute.no_null(d)][1] == brute.no_null(d)}, key=repr)
    left = brute.removed_words([(d, t) for d, t, _ in rows])
    rows = [(d, kept if n else t, s) for (d, t, s), (_, _, n, kept) in zip(rows, left)]
    codec = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for (d, t, _), m in zip(rows, brute.mix(rows)):
        ids = codec.encode(t or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), codec.decode(ids))]
        wanted += [(d, len(ids), *sha)] * m[4]
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)
    assert wanted
