"""The parts of personal-data and secret scans that a model decides: against plain versions, and on planted texts."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import boost, pii_boost, secret_random

SF = "/root/testdata/sf0.001"

#: Surroundings in four languages, none of them a template that the trees learn from: "{}" stands for the planted value.
FRAMES = {
    "phone": ("If the lift is stuck, call {} and wait.", "The surgery's new phone {} is answered until noon.", "Ask for Maria, mobile {}, after the concert.", "Bitte rufen Sie uns an: Telefon {}, werktags.", "Sous l'escalier on lit encore tel. {} en rouge.", "Para reservas, whatsapp {} o en la puerta.", "Texts welcome, dial {} from abroad.", "Rückfragen an das Office {} oder persönlich."),
    "email": ("Letters go to the editor, mail {} , before Friday.", "Contact {} if the parcel is late.", "Wer mitsingen will, schreibt an mail {} , sagt der Chor.", "Écrivez sans attendre : e-mail {} , merci.", "Escriba a mail {} , por favor.", "Write to {} , she answers everything."),
    "ssn": ("The form asked for my SSN {} twice.", "Her social security no {} was misread.", "Under tax id {} nothing was filed.", "He typed ssn: {} into the wrong box."),
    "iban": ("Rent is due on IBAN {} by the third.", "Bitte überweisen Sie auf das Konto {}, danke.", "Merci de payer sur le compte IBAN {} avant mardi.", "La fianza va a la cuenta {} del club.", "Donations: account {}, any amount."),
}
CLEAN = ("The edition of {} sold badly.", "Flug {} wurde gestrichen.", "Le lot {} est resté sur le quai.", "El pedido {} llegó roto.", "Build {} fixes the crash.", "Between shelves {} lies the atlas.", "Invoice {} was paid in cash.", "Die Seriennummer {} ist verkratzt.")


def planted(n, seed):
    """(text, kind or none, value): every frame with drawn values."""
    r = np.random.default_rng(seed)
    some = lambda k: "".join(map(str, r.integers(0, 10, k)))
    name = lambda: "".join(r.choice(list("abdeiklmnorstu"), int(r.integers(4, 9))))

    def account():
        land, body = str(r.choice(["DE", "FR", "ES", "GB", "IT"])), some(4 * int(r.integers(3, 6)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land) + "00") % 97
        whole = f"{land}{check:02d}{body}"
        return whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    values = {
        "phone": lambda: str(r.choice([f"({some(3)}) {some(3)}-{some(4)}", f"{some(3)}-{some(3)}-{some(4)}", f"{some(3)}.{some(3)}.{some(4)}", f"0{some(4)} {some(6)}", f"0{some(2)}/{some(7)}"])),
        "email": lambda: str(r.choice([f"{name()} [at] {name()} [dot] net", f"{name()} (at) {name()}.org", f"{name()} at {name()} dot com"])),
        "ssn": lambda: f"{some(3)}-{some(2)}-{some(4)}",
        "iban": account,
    }
    plain = (lambda: f"20{some(2)}-11-{some(2)}", lambda: some(9), lambda: some(12), lambda: f"{some(2)}.{some(2)}.{some(4)}", lambda: f"{some(2)}:{some(2)}:{some(2)} {some(2)}", lambda: f"978-{some(1)}-{some(4)}-{some(4)}-{some(1)}")
    out = []
    for k in range(n):
        kind = list(values)[k % 4]
        value = values[kind]()
        out.append((FRAMES[kind][(k // 4) % len(FRAMES[kind])].format(value), kind, value))
        value = plain[k % len(plain)]()
        out.append((CLEAN[k % len(CLEAN)].format(value), None, value))
    return out


def test_planted_personal_data_in_four_languages(spark):
    rows = planted(400, 21)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [(x.kind, r.text[x.s : x.e]) for x in r.pii_more] for r in pii_boost.find(df, pii_boost.fit(spark)).collect()}
    hits, all_of, wrong = collections.Counter(), collections.Counter(), 0
    for i, (_, kind, value) in enumerate(rows):
        if kind:
            all_of[kind] += 1
            hits[kind] += any(k == kind and value in v for k, v in got[i])
        wrong += sum(not kind or value not in v for _, v in got[i])
    precision = sum(hits.values()) / (sum(hits.values()) + wrong)
    print({k: (hits[k], all_of[k]) for k in all_of}, precision)
    assert precision >= 0.97 and sum(hits.values()) >= 0.8 * sum(all_of.values())


def plain_candidates(t):
    """(generator, start, end, match) by Python's own matching."""
    for g, p in enumerate(pii_boost.GENERATORS.values()):
        for m in re.finditer(p, t):
            if g != 1 or 7 <= len(re.sub("[^0-9]", "", m[0])) <= 22:
                yield g, m.start(), m.end(), m[0]


def plain_features(t, g, s, m):
    before = t[max(0, s - pii_boost.CONTEXT) : s].lower()
    d = re.sub("[^0-9]", "", m)
    check = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    bare = m.replace(" ", "")
    ends = lambda words, tail: bool(re.search(rf"(?:{words}){tail}$", before, re.A))
    far = r"\W{0,4}(?:\w{1,8}\W{1,3}){0,2}"
    return [
        g, len(m), len(d), m.count(" "), m.count("-"), m.count("."), sum(c in "/:" for c in m), sum(c in "()" for c in m), len(re.findall("[A-Za-z]", m)),
        12 <= len(d) <= 19 and check,
        bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m)),
        bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", m)),
        bool(re.search(r"^(?:19|20)[0-9]{2}[-/.]|[-/.](?:19|20)[0-9]{2}$", m)),
        bool(re.search(r"[\[(](?:at|dot)[\])]| at .* dot ", m)),
        ends("phone|tel|tél|telefon|mobile|cell|call|fax|whatsapp|number|ring|text|dial|office|desk|hotline|reach", far),
        ends("ssn|social|tax id|passport", far),
        ends("card|visa|mastercard|amex|iban|account|pay|wire", far),
        ends("mail|contact|write to|reach", r"\W{0,4}(?:\w{1,8}\W{1,3})?"),
        ends("version|order|isbn|invoice|page|chapter|build|part|id|no|nr|date|since|flight|lot|tracking|serial", r"\W{0,4}(?:number\W{0,3})?"),
        bool(re.fullmatch(r"0[0-9]{2,4}[ /-][0-9]{6,8}", m)),
        g == 2 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1,
    ]


def test_trees_of_candidates_against_a_plain_version(spark):
    model = pii_boost.fit(spark)
    texts = [t for t, _, _ in planted(60, 4)] + ["tel. 040/1234567, fax 040/1234568; mail x [at] y [dot] de or z at w dot org", "é card 4111-1111 11111 11 and 12 34 56 78 90", "", "IBAN DE89370400440532013000 DE89 3704 0044 0532 0130 01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(x.kind, x.s, x.e): x.score for x in r.pii_more} for r in pii_boost.find(df, model).collect()}
    base = {r.doc_id: [(x.s, x.e) for k in pii_boost.KINDS for x in r.pii[k]] for r in pii_boost.find(df, model).collect()}
    for i, t in enumerate(texts):
        scored = []
        for g, s, e, m in plain_candidates(t):
            f = np.array([plain_features(t, g, s, m)], float)
            margin = float(sum(boost._apply(tree, f) for tree in model["trees"])[0])
            if margin >= boost.logit(model["cuts"][g]) and not any(a < e and s < b for a, b in base[i]):
                kind = "email" if g == 0 else "iban" if g == 2 else "ssn" if f[0, 10] else "card" if f[0, 2] >= 13 else "phone"
                scored.append((-margin, s, -e, kind))
        want, taken = {}, []
        for margin, s, e, kind in sorted(scored):
            if not any(a < -e and s < b for a, b in taken):
                want[kind, s, -e] = -margin
            taken.append((s, -e))
        assert set(got[i]) == set(want) and all(math.isclose(got[i][k], want[k], abs_tol=1e-9) for k in want), t


def normal_above(z):
    return math.erfc(z / math.sqrt(2)) / 2


def plain_random_tokens(texts):
    """{row: spans of tokens that the battery and the false-discovery control accept}, base spans not yet taken away."""
    letters = collections.Counter(c for t in texts for c in re.sub(r"[A-Za-z0-9+/_=-]{20,}", "", t) if ord(c) < 128)
    tried = []
    for row, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            if not re.search("[A-Za-z]", m[0]):
                continue
            for name, _, symbols in secret_random.ENCODINGS:
                pad = name in ("base32", "base64", "base64url")
                if set(m[0].rstrip("=") if pad else m[0]) <= set(symbols) and m[0].strip("="):
                    break
            x = np.array([symbols.index(c) for c in m[0] if c in symbols])
            n, k = len(x), len(symbols)
            bins = min(16, max(4, n // 3))
            share = np.bincount(np.arange(k) * bins // k, minlength=bins) / k
            held = np.bincount(x * bins // k, minlength=bins)
            chi = ((held - n * share) ** 2 / (n * share)).sum()
            text = np.zeros(bins)
            for v, c in enumerate(symbols):
                text[v * bins // k] += letters[c]
            shift = max(0.3, float(((text / text.sum() - share) ** 2 / share).sum()) if text.sum() else 0)
            free = bins - 1
            p_chi = normal_above(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
            high = x >= k // 2
            a, b = int(high.sum()), int((~high).sum())
            p_runs = p_serial = 1e-12
            if a and b and 2 * a * b > n:
                mean = 1 + 2 * a * b / n
                p_runs = 2 * normal_above(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1))))
            z = x - x.mean()
            if (z**2).sum():
                p_serial = 2 * normal_above(abs((z[1:] * z[:-1]).sum() / (z**2).sum() + 1 / n) * math.sqrt(n))
            fisher = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
            p_random = math.exp(-fisher) * (1 + fisher + fisher**2 / 2) if fisher < 600 else 0
            p_text = normal_above((free + n * shift - chi) / math.sqrt(2 * free + 4 * n * shift))
            size = len(m[0])
            tried.append((row, m.start(), m.end(), (size >= 32) + (size >= 64), p_random, min(300, int(-math.log10(max(p_text, 1e-300)) * 10 + 1e-9))))
    out = collections.defaultdict(set)
    for stratum in range(3):
        some = [c for c in tried if c[3] == stratum]
        # The least p-values first: the last of them that stays below its share of the bound, and all before.
        good = [b for b in {c[5] for c in some} if 10 ** (-b / 10) <= 0.01 * sum(c[5] >= b for c in some) / len(some)]
        for c in some:
            if good and c[5] >= min(good) and c[4] >= 1e-3:
                out[c[0]].add((c[1], c[2]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_battery_and_false_discoveries_against_a_plain_version(spark, seed):
    r = np.random.default_rng(seed)
    texts = [x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    for name, _, symbols in secret_random.ENCODINGS:
        for n in (20, 31, 32, 40, 64, 90):
            for _ in range(4):
                texts.append(f"see {''.join(r.choice(list(symbols), n))} there")
    texts += ["a" * 40, "=" * 30, "abab" * 12, "camelCaseWordsThatGoOnAndOnForever", "some-dashed-words-that-go-on-and-on", "é" + "Zz9" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_random_tokens(texts)
    for x in secret_random.find(df).select("doc_id", "secret_base", F.col("secret_more")).collect():
        base = [(b.s, b.e) for b in x.secret_base]
        free = {(s, e) for s, e in want[x.doc_id] if not any(a < e and s < b for a, b in base)}
        assert {(m.s, m.e) for m in x.secret_more} == free, texts[x.doc_id][:200]
    assert sum(map(len, want.values())) > 60
