"""The pipeline and each of its stages against plain versions, with nulls, empty and repeated rows."""

import collections
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectorloom.llm import para_minhash, quality_mcd, vector_pack

from . import test_brute as plain
from .test_whole import WORD, plain_runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} of a very long text" for i in range(8000))


def odd_rows():
    r = np.random.default_rng(3)
    prose = " ".join(r.choice(["stone", "river", "cloud", "meadow", "harbour", "winter", "letter", "garden"], 90)) + " end"
    words = prose.split()
    return [
        (9000, None, "en", "s", None), (9001, "", None, None, 0), (9002, " \t\n ", "en", None, 4), (9003, prose, None, "s", None),
        (9004, prose, "en", "s", 1), (9004, prose, "en", "s", 1), (None, prose, "en", "s", 1), (9005, LONG, "en", "s", 1),
        (9006, " ".join([*words[:40], "other", *words[41:]]), "en", "s", 1), (9007, prose + "\npassword = hunter2222", "en", "s", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return own.unionByName(spark.createDataFrame(odd_rows(), SCHEMA)).persist()


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=repr)


def plain_quality_stage(rows):
    vectors = {}
    for n, (_, t, lang, source) in enumerate(rows):
        w, c, s, d, a = plain.plain_quality(t or "")
        if not (w < 50 or 100 * a > 50 * w):
            vectors[n] = (lang, source), (np.log(max(c / w, 0.1)), np.log1p(20 * s / w), (a / w) ** 0.5, (d / w) ** 0.5)
    groups = collections.defaultdict(set)
    for g, v in vectors.values():
        groups[g].add(v)
    pool = lambda keys: np.array([v for k in keys for v in sorted(groups[k])])
    whole, kept = plain.plain_robust(pool(groups)), []
    for n, (g, v) in vectors.items():
        wide = pool([k for k in groups if k[0] == g[0]])
        lang = plain.plain_pooled(len(wide), plain.plain_robust(wide), whole)
        own = plain.plain_robust(pool([g]))
        fit = plain.plain_pooled(len(groups[g]), own, lang) if plain.plain_distance(own[0], lang) <= quality_mcd.limit_of() else lang
        if plain.plain_distance(np.array(v), fit) <= quality_mcd.limit_of():
            kept.append(rows[n])
    return kept


def plain_near_stage(rows):
    sets = {r[0]: plain.shingled(r[1] or "", 5) for r in rows if r[0] is not None}
    root = plain.plain_components(sets, 80)
    return [r for r in rows if r[0] is None or root[r[0]] == r[0]]


def plain_passage_stage(rows):
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    places = [(k, i, plain.shingled(x, 5)) for k in sorted(texts) for i, x in enumerate(texts[k].split("\n")) if len(x.split()) >= para_minhash.MIN_WORDS]
    label = plain.plain_components({n: s for n, (_, _, s) in enumerate(places)}, 80)
    gone = {(places[n][0], places[n][1]) for n in label if label[n] != n}
    lines = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in texts.items()}
    touched = {k for k, _ in gone}
    lines = {k: t for k, t in lines.items() if k not in touched or WORD.search(t)}
    stay = plain_runs(lines, para_minhash.RUN)
    return {k: w for k, w in stay.items() if w or not WORD.search(lines[k])}


def words_of(df):
    return {r.doc_id: WORD.findall(r.text or "") for r in df.collect() if r.doc_id is not None}


def test_each_stage_and_the_whole_against_plain_versions(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    path, now = str(tmp_path), docs
    kept = corpus_pipeline.quality(spark, now, SF)
    assert rows_of(kept) == sorted(plain_quality_stage(rows_of(now)), key=repr) and kept.columns == docs.columns
    now = kept.persist()
    near = corpus_pipeline.near_duplicates(spark, now, SF)
    assert rows_of(near) == sorted(plain_near_stage(rows_of(now)), key=repr) and near.count() < now.count()
    assert {r.doc_id for r in near.where("doc_id > 8999").collect()} == {9003}  # the long text repeats itself
    now = near.persist()
    left = corpus_pipeline.passages(spark, now, SF).persist()
    assert words_of(left) == plain_passage_stage(rows_of(now))
    assert [r.n_chars for r in left.orderBy("doc_id").collect()] == [r.text and len(r.text) for r in left.orderBy("doc_id").collect()]
    clean = corpus_pipeline.secrets(spark, left, SF)
    before, after = {r.doc_id: r.text for r in left.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert set(before) == set(after) and all((before[k] == after[k]) == (not plain.plain_secrets(before[k] or "")) for k in before)
    assert not any(plain.plain_secrets(t or "") for t in after.values())
    packed = corpus_pipeline.packing(spark, clean, SF)
    encode = vector_pack.encoder(P.path("byte_bpe_50k.json"))
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {k: len(encode(t or "")) + 1 for k, t in after.items()}
    # The whole run, from a table of files, gives what the stages give one after the other.
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    whole = {r.doc_id: r.n for r in corpus_pipeline.run(spark, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert whole == total


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_rows_of_nulls(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    none = spark.createDataFrame([], SCHEMA)
    assert f(spark, none, SF).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, None, None, None, None)], SCHEMA)
    got = f(spark, nulls, SF)
    assert got.count() == (0 if name == "quality rules" else 3), name
    if name != "packing":
        assert got.columns == none.columns


def test_stages_with_repeated_rows_empty_texts_and_columns_of_our_names(spark):
    r = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in r.integers(0, 10_000, 200))
    own = " ".join(f"v{i}" for i in r.integers(0, 10_000, 200))
    rows = [(1, text), (1, text), (2, text), (3, ""), (3, ""), (4, None), (None, own)]
    names = ["kept", "stay", "__k", "component_id", "fp", "places"]
    df = spark.createDataFrame([(*row, "en", "s", 9, *names) for row in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    want = {"quality rules": [None, 1, 1, 2], "n-gram Jaccard join": [None, 1, 1, 3, 3, 4], "substring dedup": [None, 1, 1, 3, 3, 4], "secret scans": [None, 1, 1, 2, 3, 3, 4], "packing": [None, 1, 1, 2, 3, 3, 4]}
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, df, SF)
        rows_of_pieces = got.where("start = 0") if name == "packing" else got
        assert sorted((x.doc_id for x in rows_of_pieces.collect()), key=lambda k: -1 if k is None else k) == want[name], name
        assert name == "packing" or got.columns == corpus_pipeline.COLUMNS


def test_secrets_of_the_pipeline_leave_clean_documents(spark, docs):
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    for r in docs.collect():
        if r.doc_id is not None and not plain.plain_secrets(r.text or ""):
            assert got[r.doc_id] == r.text
    assert re.search("<secret>", got[9007])
