"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns of clashing names."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import bpe_words, chroma_audio, langid_kn, para_minhash, pfp_dedup, pii_boost, quality_mcd, secret_random, sigtree_join, vector_pack

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the silent river bank and count stars"
LONG = " ".join(f"word{i} of a very long text" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, n_words int, kept string, pii string, places string, first string, secret_base string, fp string, score string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE), (2, None), (3, ""), (4, "  \t\n "), (5, PROSE), (5, PROSE), (None, PROSE), (None, None), (7, LONG), (8, LONG), (9, "é中\U0001f600 mixed \u0000 text"), (10, "1" * 50_000), (11, " " * 50_000), (12, "+" * 20_000 + "@" * 2_000)]
    rest = ("x",) * 11
    return spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 3 else "s", None, "g", "id", 3, *rest[:8]) for i, t in rows], SCHEMA).repartition(3).persist()


OPERATORS = {
    "pii": lambda d: pii_boost.digest(pii_boost.find(d, pii_boost.fit(d.sparkSession))),
    "redact": lambda d: pii_boost.redact(d, pii_boost.fit(d.sparkSession)),
    "quality": quality_mcd.judge,
    "pfp": pfp_dedup.dedup,
    "secrets": lambda d: secret_random.digest(secret_random.find(d)),
    "hide": secret_random.redact,
    "bpe": lambda d: bpe_words.digest(d, P.path("byte_bpe_50k.tiktoken")),
    "lang": langid_kn.predict,
    "join": sigtree_join.join,
    "paragraphs": para_minhash.digest,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_packing_of_the_same_rows(docs):
    got = vector_pack.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert vector_pack.pack_documents(docs.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_quality_of_odd_rows(docs):
    got = {r.doc_id: r for r in quality_mcd.judge(docs).where("doc_id is not null").collect()}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[10].n_words == 1 and got[7].n_words == 180_000 and got[7].g == "g"


def test_repeated_ids_do_not_remove_each_other(docs):
    got = [r.n_removed for r in pfp_dedup.dedup(docs.where("doc_id = 5")).collect()]
    assert got == [0, 0]


def test_null_ids_take_no_part(docs):
    some = docs.where("doc_id is null or doc_id = 1")
    assert all(r.n_removed == 0 for r in pfp_dedup.dedup(some).collect())
    assert {r.component_id for r in sigtree_join.join(some).collect()} == {None, 1}


def test_links_of_odd_rows(docs):
    got = {(r.doc_id, r.component_id) for r in sigtree_join.join(docs).collect()}
    assert {(5, 1), (8, 7), (2, 2), (3, 3), (4, 4)} <= got


def test_audio_that_cannot_be_read(spark):
    df = spark.createDataFrame([(100, None, "a"), (1, bytearray(b"no"), "b"), (200, bytearray(chroma_audio.sounded([0.1 * i for i in range(64)])), "c"), (2, bytearray(chroma_audio.sounded([0.1 * i for i in range(64)])), "d")], "vec_id long, audio binary, fp string")
    got = chroma_audio.align(chroma_audio.fingerprints(df), "vec_id", F.col("vec_id") % 100 == 0).collect()
    assert {(r.vec_id, r.class_id, r.match_class) for r in got} == {(100, 100, None), (1, 1, None), (200, 2, 2), (2, 2, None)}
    empty = chroma_audio.align(chroma_audio.fingerprints(df.where("false")), "vec_id", F.col("vec_id") % 100 == 0)
    assert empty.count() == 0


def test_languages_without_lessons(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid_kn.predict(df).collect()} == {"und"}


def test_digest_of_no_spans_is_that_of_the_empty_string(docs):
    none = hashlib.sha256(b"").hexdigest()
    got = pii_boost.digest(pii_boost.find(docs, pii_boost.fit(docs.sparkSession))).where("doc_id = 2").first()
    assert (got.base_sha256, got.spans) == (none, "")


def test_columns_of_our_names_pass_through_passages(spark):
    line = " ".join(f"w{i}" for i in range(60))
    names = ["first", "From", "stay", "__k", "places", "__own0", "n_gone", "__gone"]
    rows = [(i, f"{line}\n{i} own words", *(f"{n}{i}" for n in names)) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for f in (para_minhash.dedup, para_minhash.dedup_runs):
        got = {r.doc_id: r for r in f(df).collect()}
        assert list(got[2].__fields__) == df.columns and tuple(got[2])[2:] == rows[1][2:]
        assert got[1].text == rows[0][1] and got[2].text.strip() == "2 own words"
