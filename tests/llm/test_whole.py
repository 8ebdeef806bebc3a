"""Inputs on which an operator once did less than its whole job."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectorloom.llm import chroma_audio, langid_kn, para_minhash, pii_boost, quality_mcd, queries, secret_random, vector_pack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(texts, n):
    """The words that stay, by windows of n words of documents of smaller ids."""
    first, out = {}, {}
    for k in sorted(texts):
        w = [x.lower() for x in WORD.findall(texts[k])]
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), k) < k:
                gone[i : i + n] = [True] * n
        out[k] = [x for x, g in zip(WORD.findall(texts[k]), gone, strict=True) if not g]
    return out


def test_runs_inside_and_over_lines_go(spark):
    r = np.random.default_rng(5)
    words = lambda n: [f"w{i}" for i in r.integers(0, 5000, n)]
    line, wrapped = words(70), words(60)
    rows = {1: " ".join(words(40) + line + words(40)), 2: " ".join(wrapped[:20]) + "\n" + " ".join(wrapped[20:])}
    rows[3] = " ".join(words(100) + line + words(100)) + "\nlast line"  # inside a longer, otherwise different line
    rows[4] = "head\n" + "\n".join(" ".join(wrapped[i : i + 7]).upper() for i in range(0, 60, 7)) + "\ntail"  # over lines of under 30 words
    rows[5] = " ".join(words(30) + line[:49] + words(30))  # a word less than a run
    rows[6] = " ".join(words(30) + line[:50] + words(30))
    rows[7] = " ".join(wrapped[:50])
    df = spark.createDataFrame([*((k, t, "en", "s", 0) for k, t in rows.items()), (8, None, "en", "s", 0), (None, rows[3], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, df, "").collect()}
    want = plain_runs(rows, para_minhash.RUN)
    assert {k: WORD.findall(t) for k, t in got.items() if k in rows} == {k: w for k, w in want.items() if w}
    assert len(WORD.findall(got[3])) == 202 and got[4] == "head\ntail" and got[5] == rows[5] and len(WORD.findall(got[6])) == 60 and 7 not in got
    assert got[8] is None and got[None] == rows[3]


def test_runs_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = plain_runs(texts, para_minhash.RUN)
    got = {r.doc_id: WORD.findall(r.text or "") for r in para_minhash.dedup_runs(docs).collect()}
    assert got == {k: w for k, w in want.items() if w or not texts[k]}
    assert sum(map(len, got.values())) < sum(len(WORD.findall(t)) for t in texts.values())


def test_junk_of_a_third_of_a_source_or_language_is_rejected(spark):
    r = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("th", "on", "re", "an", "est") for b in ("er", "ing", "ed", "ion", "al", "e")]
    prose = lambda: " ".join(r.choice(words, 120)) + "."
    junk = lambda: " ".join(f"{w}#&$&#*" for w in r.choice(words, 120))
    copy, rows = junk(), []
    for lang, source, good, bad, text in (("en", "clean", 1400, 0, junk), ("en", "third", 264, 136, junk), ("en", "most", 80, 150, junk), ("de", "a", 264, 136, lambda: copy)):
        rows += [(len(rows) + i, prose() if i < good else text(), lang, source, i < good) for i in range(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, good boolean")
    got = quality_mcd.judge(df).where("not base_failed").groupBy("lang", "source", "good").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert {(r.lang, r.source, r.good): r.kept for r in got} == {("en", "clean", True): 1, ("en", "third", True): 1, ("en", "third", False): 0, ("en", "most", True): 1, ("en", "most", False): 0, ("de", "a", True): 1, ("de", "a", False): 0}


def plain_kneser_ney(words, rare=0.0):
    """A plain interpolated Kneser-Ney model of character 4-grams: {gram: probability} as a function. ``rare``: the least share of counts to be kept."""
    level = collections.Counter(p[i - 3 : i + 1] for w in words for p in ["\1\1\1" + w + "\2"] for i in range(3, len(p)))
    orders = []
    for _ in range(4):
        ones, twos = (sum(v == k for v in level.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total, kinds = collections.Counter(), collections.Counter()
        least = rare * sum(level.values())
        for g, v in level.items():
            total[g[:-1]] += v
        rest = {c: 1 - sum((v - d) / total[c] for g, v in level.items() if g[:-1] == c and v >= least) for c, v in total.items() if v >= least} if rare else {}
        for g in level:
            kinds[g[:-1]] += 1
        orders.append((level, d, total, kinds, rest, least))
        level = collections.Counter(g[1:] for g in level)

    def p(gram):
        out = 1 / (1 << 16)
        for size, (level, d, total, kinds, rest, least) in zip((1, 2, 3, 4), reversed(orders), strict=True):
            g = gram[4 - size :]
            if rare:
                out = out * rest.get(g[:-1], 1) + ((level[g] - d) / total[g[:-1]] if level.get(g, 0) >= least else 0)
            elif total[g[:-1]]:
                out = out * d * kinds[g[:-1]] / total[g[:-1]] + (max(0, level[g] - d) / total[g[:-1]] if g in level else 0)
        return out

    return p, orders[0][0]


def test_more_than_200000_grams_of_a_language_are_all_kept(spark):
    r = np.random.default_rng(2)
    words = ["".join(map(chr, x)) for x in 0x4E00 + (3000 * r.random((45_000, 5)) ** 2).astype(int)]
    rows = [(" ".join(words[i : i + 500]), "zh") for i in range(0, len(words), 500)]
    model = langid_kn.fit(spark.createDataFrame([*rows, ("some plain words", "en")], "text string, lang string"))
    p, known = plain_kneser_ney(words)
    assert len(known) > 200_000
    some = sorted(known)[::97] + ["\x01\x01\x01" + c for c in "xyz"]
    codes = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g)) for g in some], np.uint64)
    assert np.allclose(model.log_prob(codes)[:, model.langs.index("zh")], np.log([p(g) for g in some]))


def test_rare_grams_give_their_mass_to_shorter_ones(spark, monkeypatch):
    monkeypatch.setattr(langid_kn, "RARE", 2e-3)
    r = np.random.default_rng(4)
    words = ["".join(chr(97 + int(26 * x**3)) for x in r.random(int(r.integers(1, 6)))) for _ in range(3000)]
    model = langid_kn.fit(spark.createDataFrame([(" ".join(words), "a")], "text string, lang string"))
    p, known = plain_kneser_ney(words, 2e-3)
    assert sum(len(t[0]) for t in model.tables[0]) < len(known)
    code = lambda g: sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g))
    some = sorted(known)[::7]
    assert np.allclose(model.log_prob(np.array([code(g) for g in some], np.uint64))[:, 0], np.log([p(g) for g in some]))
    for context in ("\x01\x01\x01", "\x01aa", "zzz"):
        every = np.exp(model.log_prob(np.array([code(context + chr(x)) for x in range(1 << 16)], np.uint64))[:, 0])
        assert abs(every.sum() - 1) < 1e-9


def test_grams_of_any_rarity_are_kept(spark):
    r = np.random.default_rng(6)
    common = " ".join(["abcd"] * 100) + " "
    rare = ["".join(chr(0x4E00 + int(x)) for x in r.integers(0, 2000, 4)) for _ in range(300)]
    rows = [(common * 200, "a")] * 60 + [(" ".join(rare), "a")]  # a rare n-gram is one of six million
    model = langid_kn.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    codes = langid_kn._grams(rare)[0]
    assert np.isin(codes, model.tables[0][3][0]).all()


def test_a_model_in_tables_gives_what_a_broadcast_one_does(spark):
    r = np.random.default_rng(7)
    word = lambda k: "".join(chr(97 + (int(x) * (k + 1)) % 26) for x in r.integers(0, 12, int(r.integers(1, 8))))
    rows = [(i, " ".join(word(i % 3) for _ in range(40)), "abc"[i % 3], i) for i in range(60)] + [(99, None, "a", 1), (98, "", "a", 2), (97, "123 456", None, 3), (96, "𠀀一 z", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, block long").repartition(4)
    small, wide = (langid_kn.fit(df, limit=n) for n in (1 << 22, 10))
    assert isinstance(wide, langid_kn.Wide) and np.allclose(small.reject, wide.reject)
    a, b = ({x.doc_id: x for x in langid_kn.score(df, m).collect()} for m in (small, wide))
    assert len(a) == len(b) == len(rows)
    for k, x in a.items():
        assert (x.lang_pred, x.rejected, x.block) == (b[k].lang_pred, b[k].rejected, b[k].block)
        assert np.isclose(x.score, b[k].score) and (x.entropy is None) == (b[k].entropy is None)
    assert langid_kn.predict(df.where("false"), limit=10).count() == 0


def test_characters_beyond_16_bits_are_not_those_of_their_lower_bits():
    far, near = (langid_kn._grams([w])[0] for w in ("\U00010041bc", "Abc"))
    assert (far != near).any()


def test_every_language_has_a_model(spark):
    r = np.random.default_rng(3)
    word = lambda k: "".join(chr(0x4E00 + 12 * k + int(i)) for i in r.integers(0, 12, 4))
    rows = [(f"lang{k}", " ".join(word(k) for _ in range(10 if k == 69 else 60))) for k in range(70) for _ in range(2)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {(r.lang, r.lang_pred) for r in langid_kn.score(df, langid_kn.fit(df)).collect()} == {(f"lang{k}", f"lang{k}") for k in range(70)}


def _wav(x):
    import io
    import wave

    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(chroma_audio.RATE)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return bytearray(sink.getvalue())


def test_noisy_and_short_recordings_are_found(spark):
    r = np.random.default_rng(7)
    rows, truth = [], {}
    for i in range(20):
        x, _ = chroma_audio.read(chroma_audio.sounded(list(r.standard_normal(64) * 0.3)))
        rows.append((100 * (i + 1), _wav(x)))
        for j, noise in enumerate((0.05, 0.1, 0.15, 0.2, 0.3), 1):
            y = _wav(x + r.standard_normal(len(x)) * noise)
            a, b = (chroma_audio.fingerprint(chroma_audio.chroma(*chroma_audio.read(z))) for z in (rows[-j][1], y))
            rows.append((100 * (i + 1) + j, y))
            truth[100 * (i + 1), 100 * (i + 1) + j] = chroma_audio.errors(a, b, 0)[1]
    short, _ = chroma_audio.read(chroma_audio.sounded(list(r.standard_normal(12) * 0.3)))
    rows += [(5000, _wav(short)), (5001, _wav(np.append(short[:-384], r.standard_normal(384) * 0.5)))]  # the last three of its integers may differ
    df = spark.createDataFrame(rows, "id long, audio binary")
    got = {(m.id, m.match_class) for m in chroma_audio.align(chroma_audio.fingerprints(df), "id", F.col("id") % 100 == 0).collect() if m.offset == 0}
    near = [k for k, e in truth.items() if e < 0.15]
    assert len(near) >= 10 and sum(k in got for k in near) >= 0.98 * len(near)
    assert len(chroma_audio.fingerprint(chroma_audio.chroma(short, chroma_audio.RATE))) <= 8 and (5000, 5001) in got


def _pcm(x, rate, width=2, channels=1):
    import io
    import wave

    raw = np.round(np.clip(x, -1, 1) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    raw = (raw + 128 if width == 1 else raw).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.repeat(raw, channels, 0).tobytes())
    return bytearray(sink.getvalue())


def _tune(seed, rate, notes=60):
    pitch = 220 * 2 ** (np.random.default_rng(seed).integers(0, 24, notes) / 12)
    t = np.arange(rate // 8) / rate
    return (0.5 * np.sin(2 * np.pi * pitch[:, None] * t) * np.hanning(len(t))).ravel()


def test_recordings_of_any_rate_and_width_match(spark):
    forms = [(4000, 2, 1), (8000, 2, 1), (11025, 1, 1), (22050, 3, 2), (44100, 4, 2)]
    rows = [(100 * (s + 1) + k, _pcm(_tune(s, f[0]), *f)) for s in range(3) for k, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "id long, audio binary")
    got = {(m.id, m.match_class) for m in chroma_audio.align(chroma_audio.fingerprints(df), "id", F.col("id") % 100 == 0).collect()}
    assert got == {(q, q + k) for q in (100, 200, 300) for k in range(5)} | {(i, None) for i, _ in rows if i % 100}


def test_long_recordings_are_read_in_blocks(monkeypatch):
    x = _pcm(_tune(5, 11025, 400), 11025)
    whole, _ = chroma_audio.read(x)
    prints = chroma_audio.fingerprint(chroma_audio.chroma(whole))
    monkeypatch.setattr(chroma_audio, "BLOCK", 5000)
    assert np.allclose(chroma_audio.read(x)[0], whole, atol=1e-6)
    assert (chroma_audio.fingerprint(chroma_audio.chroma(whole)) == prints).all()


def test_silence_gives_no_votes(spark):
    still = np.zeros(40_000)
    rows = [(100, _pcm(np.concatenate([_tune(1, 4000), still]), 4000)), (1, _pcm(np.concatenate([_tune(2, 4000), still]), 4000)), (2, _pcm(still, 4000)), (200, _pcm(np.concatenate([still, _tune(2, 4000)]), 4000))]
    prints = chroma_audio.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))
    assert {x for r in prints.where("id = 2").collect() for x in r.fp} == {chroma_audio.FLAT}
    got = {(m.id, m.match_class) for m in chroma_audio.align(prints, "id", F.col("id") % 100 == 0).collect() if m.match_class is not None}
    assert got == {(100, 100), (200, 200), (200, 1)}


#: Sentences that no template makes: (text, kind of the added span or none).
WORDED = [
    ("Ring me on 415-555-0132 after six.", "phone"), ("You can text (212) 555 0147 any time", "phone"), ("Her cell: 646.555.0199", "phone"),
    ("WhatsApp 07911 123456", "phone"), ("Office 030/1234567 ext 4", "phone"), ("our hotline is 0800 1234567, free of charge", "phone"), ("the front desk (617) 555-0199 knows", "phone"),
    ("reach jane [at] example [dot] org", "email"), ("e-mail me: bob (at) site.co.uk", "email"), ("ann at mail dot net is my address", "email"),
    ("SSN 078-05-1120 on file", "ssn"), ("social security number: 219-09-9999", "ssn"), ("my social is 457-55-5462", "ssn"),
    ("IBAN DE89 3704 0044 0532 0130 00", "iban"), ("pay to account GB29 NWBK 6016 1331 9268 19", "iban"), ("send it to ES91 2100 0418 4502 0005 1332 please", "iban"),
    ("amex 378282246310005 exp 12/26", "card"), ("card no 3714 496353 98431", "card"),
    ("between 2019-2020 and 2021-2022", None), ("ISBN 978-3-16-148410-0 is out", None), ("it cost 1 234 567 pounds", None), ("ratio 10:20:30 at 12:30", None),
    ("the years 1999 2000 2001", None), ("tracking 1234567890123456789", None), ("serial 123-45-678 was lost", None), ("flight 415 555 0132", None), ("score 3-2, 4-1, 10-9", None),
    ("lot 123 456 7890 items", None), ("pi is 3.14159265358979", None), ("sealed DE12 3456 7890 1234 5678 90 crates", None), ("opening 0123 456789 crates took long", None), ("rev. 2.14.3 of 2024-05-06", None),
]


def test_boosted_candidates_on_other_words_than_the_templates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDED)], "doc_id long, text string")
    got = {r.doc_id: [x.kind for x in r.pii_more] for r in pii_boost.find(df, pii_boost.fit(spark)).collect()}
    planted = [i for i, (_, k) in enumerate(WORDED) if k]
    assert sum(WORDED[i][1] in got[i] for i in planted) >= 0.9 * len(planted)
    assert sum(bool(got[i]) for i, (_, k) in enumerate(WORDED) if not k) <= 1


def _token(r, letters, n):
    return "".join(r.choice(list(letters), n))


def test_random_tokens_of_every_alphabet_are_found_and_text_is_not(spark):
    r = np.random.default_rng(12)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base62": upper + lower + digits, "letters": upper + lower, "base64": upper + lower + digits + "+/", "url": upper + lower + digits + "-_", "mixed": upper + lower + digits + "+/-_", "base32": upper + "234567"}
    rows, kind = [], {}
    for name, letters in alphabets.items():
        for n in (24, 32, 48):
            for _ in range(20):
                kind[len(rows)] = (name, n)
                rows.append((len(rows), f"see {_token(r, letters, n)} there"))
    prose = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").collect()]
    words = sorted({w for t in prose for w in re.findall("[A-Za-z]{3,}", t)})
    plain = []
    for k in range(600):
        some = [str(x) for x in r.choice(words, int(r.integers(4, 9)))]
        plain.append(("-" if k % 3 == 0 else "_" if k % 3 == 1 else "").join(some if k % 3 < 2 else [w.capitalize() for w in some]))
    rows += [(10_000 + k, f"the {t} file and 31415926535897932384626433 more") for k, t in enumerate(plain)]
    rows += [(20_000 + k, t) for k, t in enumerate(prose)]  # text, whose letters the operator counts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_more for x in secret_random.digest(secret_random.find(df)).collect()}
    found = collections.Counter((name, n) for i, (name, n) in kind.items() if got[i])
    # Base 32, and letters alone, tell themselves from text only in longer tokens.
    assert all(found[name, n] >= least for name in alphabets if name not in ("base32", "letters") for n, least in ((32, 12), (48, 18))) and found["letters", 48] >= 15, found
    assert sum(bool(got[i]) for i in got if 10_000 <= i < 20_000) <= 0.03 * sum(found.values())


@pytest.mark.parametrize("limits", [vector_pack.CHAT, (64, 2, 20)])
def test_conversations_keep_three_limits(spark, limits):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").unionByName(spark.createDataFrame([(None, 0, "assistant", "of no conversation"), (9000, 0, None, None), (9000, 1, "assistant", ""), (9001, 0, "user", "word " * 5000), (9001, 1, "assistant", "answer " * 3000)], "conv_id long, turn long, role string, text string"))
    encode = vector_pack.encoder(path)
    want = {(r.conv_id, r.turn): (len(encode(r.text or "")) + 1, r.role == "assistant") for r in turns.collect()}
    got = vector_pack.pack_conversations(turns, path, limits=limits).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.conv_id, r.turn].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(want)
    for k, rows in by.items():
        rows.sort(key=lambda r: r.start)
        n, bears = want[k]
        assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) == n
        assert all(r.bears == bears for r in rows)
        assert len(rows) == 1 or n > min(limits[0], limits[2] if bears else limits[0])
    for rows in seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.length for r in rows) <= limits[0] and len({r.run for r in rows}) <= limits[1] and sum(r.length for r in rows if r.bears) <= limits[2]
    assert vector_pack.pack_conversations(turns.where("false"), path).count() == 0


def test_packed_conversations_of_the_table_leave_little_room(spark):
    got = queries.op10_chat_pack(spark, "/root/testdata/sf0.01")
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("bears"), F.col("length")).otherwise(0)).alias("loss"), (F.max("run") + 1).alias("runs")).collect()
    full = [max(r.n / vector_pack.CHAT[0], r.loss / vector_pack.CHAT[2], r.runs / vector_pack.CHAT[1]) for r in per]
    assert np.mean(full) > 0.8
