"""The stages of the pipeline, each on its own input, against brute force; and the pipeline as a whole."""

import collections
import random

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_kept, brute_labels, brute_verdict, rows, sentence, words_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    items = [(1, rows()[3][1]), (2, sentence(rng, 30)), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def texts(frame):
    return collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_names_and_columns(spark, docs, sf_dir):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_quality_stage(spark, docs, sf_dir):
    assert texts(STAGES["quality_rules"](spark, docs, sf_dir)) == collections.Counter((i, t) for i, t in rows() if brute_verdict(t))


def test_near_duplicate_stage(spark, docs, sf_dir):
    """One row of each component with words, of its least id (null where it has no other), and all texts without words."""
    got = texts(STAGES["minhash_near_dedup"](spark, docs, sf_dir))
    members = collections.defaultdict(list)
    for row, label in zip(rows(), brute_labels(rows(), 80)):
        members[label].append(row)
    least = lambda found: min((i is None, i or 0) for i, _ in found)
    bare = {row for row in rows() if not words_of(row[1])}
    for found in members.values():
        if found[0] not in bare:
            stayed = [row for row in set(found) if got[row]]
            assert len(stayed) == 1 and got[stayed[0]] == 1 and least(stayed) == least(found)
    assert all(got[row] == 1 for row in bare) and set(got) <= set(rows())


def test_suffix_stage(spark, docs, sf_dir):
    got = STAGES["suffix_array_dedup"](spark, docs, sf_dir).collect()
    assert len(got) == len(rows()) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    # of a character that is cut in part the rest goes too
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in got) == collections.Counter((i, kept.decode("utf-8", "ignore")) for i, kept in brute_kept(rows()))


def test_decontamination_stage(spark, docs, sf_dir):
    held = rows()[3][1]
    got = texts(STAGES["benchmark_decontamination"](spark, docs, sf_dir))
    assert got == collections.Counter((i, t) for i, t in rows() if t != held)


def test_last_stage_and_run(spark, docs, sf_dir):
    got = STAGES["byte_level_bpe"](spark, docs, sf_dir)
    assert got.count() == len(rows()) and {"ids", "n_tokens", "lang", "source"} <= set(got.columns)
    out = corpus_pipeline.run(spark, sf_dir)
    found = [(r["doc_id"], r["ids_sha256"]) for r in out.collect()]
    ids = {i for i, _ in found}
    assert len(set(found)) == len(found) and 132 in ids and not {121, 130, 133} & ids


def test_clashing_columns(spark, sf_dir):
    """Columns with the names the stages use for themselves come through unchanged, but for the two the last stage makes."""
    names = ["id", "code", "row", "row_key", "text_code", "component", "node", "ids", "n_tokens", "a.b", "spans", "at", "kept"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows()], schema).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf_dir)
        kept = [n for n in names if name != "byte_level_bpe" or n not in ("ids", "n_tokens")]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in kept), name
        assert out.columns == frame.columns if name != "byte_level_bpe" else sorted(out.columns) == sorted(["doc_id", *names])
        assert stage(spark, frame.limit(0), sf_dir).count() == 0


def test_stages_may_be_read_late(spark, docs, sf_dir):
    """A stage's frame is whole when it is read after other stages and another pipeline have run."""
    first = STAGES["minhash_near_dedup"](spark, docs, sf_dir)
    STAGES["quality_rules"](spark, docs, sf_dir).count()
    corpus_pipeline.run(spark, sf_dir).count()
    again = STAGES["minhash_near_dedup"](spark, docs, sf_dir)
    assert texts(first) == texts(again)
