"""Personal data: base patterns plus boosted candidates, as column expressions only.

High-recall generators propose overlapping spans; boosted trees score each from its format and its
context; a threshold calibrated on held-out rows per generator selects what is redacted. The trees are
fitted on a bounded sample (``rows`` templated examples, labelled by construction) whose features are
computed by the same expressions as those of real text.

Defined results: null text is empty text and has no spans; empty tables give empty tables; repeated rows
and tied ids are each scanned for themselves; other columns pass through (a column of a result's name gives way); texts are scanned
whole and every pattern is linear in the text's length.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost, spans
from .common import clear

KINDS = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn")

# Possessive forms: the same leftmost matches as the plain ones, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test without which a text has no match that could pass.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
GENERATORS = {
    "at": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[ ().:/-]{0,2}[0-9])++(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
PROPOSES = {
    "at": lambda t: t.rlike(r"@|[\[(](?:at|dot)[\])]| dot "),
    "number": lambda t: t.rlike(r"[0-9](?:[ ().:/-]{0,2}[0-9]){6}"),
    "account": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
}
CONTEXT = 28
FEATURES = 21
SAMPLE = 3600
PRECISION = 0.995


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(m, r"\.", -1), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= F.lit("255"))))
    if kind == "card":
        d = spans.digits(m)
        return F.when(F.length(d).between(16, 19), spans.luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(spans.digits(m)).between(8, 15)
    return F.lit(True)


def _base(kind: str) -> Column:
    return F.filter(spans.placed(F.col(f"__g_{kind}"), F.col(f"__m_{kind}")), lambda x: _passes(kind, x.m))


def _features(text: Column, s: Column, e: Column, m: Column, generator: int) -> list[Column]:
    """Format and context of one candidate; the order is that of the fitted trees."""
    number = lambda c: c.cast("double")
    many = lambda p: number(F.length(F.regexp_replace(m, f"[^{p}]", "")))
    # A window of the text by code points; both sides have a bounded length.
    before = F.lower(F.substr(text, F.greatest(s - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s, F.lit(CONTEXT)).cast("int")))
    d = spans.digits(m)
    near = lambda words: number(before.rlike(words))
    return [
        F.lit(float(generator)),
        number(F.length(m)),
        number(F.length(d)),
        many(" "), many("-"), many("."), many("/:"), many("()"), many("A-Za-z"),
        number(F.when(F.length(d).between(12, 19), spans.luhn(d)).otherwise(F.lit(False))),
        number(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        number(m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
        number(m.rlike(r"^(?:19|20)[0-9]{2}[-/.]|[-/.](?:19|20)[0-9]{2}$")),
        number(m.rlike(r"[\[(](?:at|dot)[\])]| at .* dot ")),
        near(r"(?:phone|tel|tél|telefon|mobile|cell|call|fax|whatsapp|number|ring|text|dial|office|desk|hotline|reach)\W{0,4}(?:\w{1,8}\W{1,3}){0,2}$"),
        near(r"(?:ssn|social|tax id|passport)\W{0,4}(?:\w{1,8}\W{1,3}){0,2}$"),
        near(r"(?:card|visa|mastercard|amex|iban|account|pay|wire)\W{0,4}(?:\w{1,8}\W{1,3}){0,2}$"),
        near(r"(?:mail|contact|write to|reach)\W{0,4}(?:\w{1,8}\W{1,3})?$"),
        near(r"(?:version|order|isbn|invoice|page|chapter|build|part|id|no|nr|date|since|flight|lot|tracking|serial)\W{0,4}(?:number\W{0,3})?$"),
        number(m.rlike(r"^0[0-9]{2,4}[ /-][0-9]{6,8}$")),
        number(F.when(F.lit(generator == 2), _checked(m)).otherwise(F.lit(False))),
    ]


def _checked(m: Column) -> Column:
    """Whether an account number's letters and digits, the first four moved to the end, leave 1 modulo 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    return rest == 1


def _candidates(text: Column, gap: Column, match: Column, generator: int) -> Column:
    got = F.filter(spans.placed(gap, match), lambda x: F.length(spans.digits(x.m)).between(7, 22) if generator == 1 else F.lit(True))
    return F.transform(got, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), F.array(*_features(text, x.s, x.e, x.m, generator)).alias("f")))


#: Words before a candidate: of the examples that trees learn from, and of those that set thresholds.
LEADS = (
    {"phone": ("phone: ", "call ", "tel. ", "mobile ", "fax ", "my number is ", "text me at ", "ring "), "ssn": ("ssn ", "social security no. ", "SSN: ", "tax id "), "card": ("card ", "visa ", "amex no. "), "mail": ("mail ", "contact ", "write to ", ""), "iban": ("iban ", "account ", "IBAN: ", ""), "date": ("", "on ", "date ", "since "), "order": ("order ", "invoice ", "id ", "order number ", "")},
    {"phone": ("cell: ", "reach me on ", "telefon ", "office ", "whatsapp ", "dial ", "you can text ", "number: "), "ssn": ("my social is ", "SSN is ", "passport or tax id "), "card": ("mastercard: ", "pay by card no ", "amex "), "mail": ("e-mail ", "reach ", "my mail is "), "iban": ("pay to ", "wire to ", "the account is "), "date": ("at ", "until ", ""), "order": ("tracking ", "serial ", "lot ", "flight ", "part number ")},
)


def _examples(rows: int, family: int = 0) -> list[tuple[str, int]]:
    """Templated texts of one candidate each, labelled by construction; deterministic."""
    r, lead = random.Random(11 + family), LEADS[family]
    some = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ion", "sch", "ción", "eau")) for _ in range(r.randint(1, 4)))

    def card(n: int) -> str:
        d = "4" + some(n - 2)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return d + str(-total % 10)

    def account() -> str:
        code, body = r.choice(("DE", "FR", "ES", "GB")), r.choice(("", "NWBK")) + some(4 * r.randint(3, 5))
        value = "".join(str(int(x, 36)) for x in body + code)
        whole = f"{code}{98 - int(value + '00') % 97:02d}{body}"
        return r.choice((whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))))

    phones = (lambda: f"({some(3)}) {some(3)}-{some(4)}", lambda: f"({some(3)}) {some(3)} {some(4)}", lambda: f"{some(3)}-{some(3)}-{some(4)}", lambda: f"{some(3)}.{some(3)}.{some(4)}", lambda: f"0{some(3)} {some(r.choice((6, 7)))}", lambda: f"0{some(2)}/{some(7)}", lambda: f"0{some(4)} {some(6)}")
    good = (
        lambda: (r.choice(lead["phone"]), r.choice(phones)()),
        lambda: (r.choice(lead["ssn"]), f"{some(3)}-{some(2)}-{some(4)}"),
        lambda: (r.choice(lead["phone"]), r.choice(phones)()),
        lambda: (r.choice(lead["card"]), card(r.choice((13, 14, 15)))),
        lambda: (r.choice(lead["mail"]), r.choice((f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.org", f"{word()} at {word()} dot com"))),
        lambda: (r.choice(lead["iban"]), account()),
    )
    bad = (
        lambda: (r.choice(lead["date"]), f"20{some(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        lambda: (r.choice(lead["date"]), f"{r.randint(10, 28)}/{r.randint(10, 12)}/20{some(2)} {r.randint(10, 23)}:{some(2)}"),
        lambda: (r.choice(("version ", "build ", "")), f"{some(2)}.{some(3)}.{some(4)}"),
        lambda: (r.choice(lead["order"]), some(r.randint(7, 20))),
        lambda: (r.choice(lead["order"]), r.choice(phones)()),
        lambda: (r.choice(("isbn ", "")), f"978-{some(1)}-{some(4)}-{some(4)}-{some(1)}"),
        lambda: (f"{word()} ", some(16)),
        lambda: (f"{word()} ", some(r.choice((13, 14, 15)))),
        lambda: (f"{word()} ", r.choice(phones)()),
        lambda: (f"{word()} ", f"{some(3)}-{some(2)}-{some(4)}"),
        lambda: (r.choice(("part ", "number ", "")), f"{r.choice(('AB', 'DE', 'XK'))}{some(2)} {some(4)} {some(4)} {some(4)}"),
        lambda: (f"{word()} ", f"{word()}@{word()}.{word()}"),
        lambda: (f"{word()} number ", some(r.choice((8, 9, 12)))),
    )
    out = []
    for k in range(rows):
        pool = good if k % 2 else bad
        before, m = pool[(k // 2) % len(pool)]()
        out.append((f"{word()} {word()} {before}{m}, {word()} {word()}.", k % 2))
    return out


#: Fitted models by (rows, precision); they depend on nothing else.
_FITTED: dict[tuple, dict] = {}


def fit(spark: SparkSession, rows: int = SAMPLE, precision: float = PRECISION) -> dict:
    """Trees and one calibrated threshold per generator, from ``rows`` examples at most (fitted once a process).

    Two thirds of the examples teach; the others, whose contexts are worded differently, set the thresholds.
    """
    kept = _FITTED.setdefault((rows, precision), {})
    if not kept:
        text = "\n".join(f"{y}{family}{t}" for family, share in ((0, rows - rows // 3), (1, rows // 3)) for t, y in _examples(share, family))
        line = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("l"))
        docs = line.select(F.substr("l", F.lit(1), F.lit(1)).cast("int").alias("y"), F.substr("l", F.lit(2), F.lit(1)).cast("int").alias("family"), F.substr("l", F.lit(3)).alias("t"))
        found = docs.select("y", "family", F.flatten(F.array(*(_candidates(F.col("t"), spans.gaps(F.col("t"), p), spans.found(F.col("t"), p), i) for i, p in enumerate(GENERATORS.values())))).alias("c"))
        got = found.select("y", "family", F.explode("c").alias("c")).select("y", "family", "c.f").collect()  # a bounded sample, a few hundred KB
        x, y = np.array([g.f for g in got]), np.array([float(g.y) for g in got])
        learn = np.array([g.family == 0 for g in got])
        trees = boost.fit(x[learn], y[learn])
        p = boost.predict(trees, x[~learn])
        cuts = [boost.threshold(p[x[~learn][:, 0] == i], y[~learn][x[~learn][:, 0] == i], precision) for i in range(len(GENERATORS))]
        kept |= {"trees": trees, "cuts": cuts, "held": (p, y[~learn], x[~learn][:, 0])}
    return kept


def find(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: base spans per kind, ``pii_more``: selected spans ``(kind, s, e, m, score)``.

    A selected span never overlaps a base span; of overlapping selected ones the best stays
    (ties: the earlier start, then the longer).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<string>")
    docs = clear(docs, "pii", "pii_more")
    own = docs.columns
    guarded = docs.select("*", *(c for k in KINDS for c in (F.when(GUARDS[k](t), spans.gaps(t, PATTERNS[k])).otherwise(empty).alias(f"__g_{k}"), F.when(GUARDS[k](t), spans.found(t, PATTERNS[k])).otherwise(empty).alias(f"__m_{k}"))),
                          *(c for k, p in GENERATORS.items() for c in (F.when(PROPOSES[k](t), spans.gaps(t, p)).otherwise(empty).alias(f"__g_{k}"), F.when(PROPOSES[k](t), spans.found(t, p)).otherwise(empty).alias(f"__m_{k}"))))
    base = guarded.select(*own, *(_base(k).alias(f"__b_{k}") for k in KINDS),
                          F.flatten(F.array(*(_candidates(t, F.col(f"__g_{k}"), F.col(f"__m_{k}"), i) for i, k in enumerate(GENERATORS)))).alias("__c"))
    scored = base.select(*own, *(f"__b_{k}" for k in KINDS), F.concat(*(f"__b_{k}" for k in KINDS)).alias("__all"), F.transform("__c", lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c.m.alias("m"), c.f.alias("f"), boost.column(model["trees"], [c.f[i] for i in range(FEATURES)]).alias("score"))).alias("__c"))
    cut = lambda g: F.when(g == 0, F.lit(boost.logit(model["cuts"][0]))).when(g == 1, F.lit(boost.logit(model["cuts"][1]))).otherwise(F.lit(boost.logit(model["cuts"][2])))
    kind = lambda f: F.when(f[0] == 0, F.lit("email")).when(f[0] == 2, F.lit("iban")).when(f[10] == 1, F.lit("ssn")).when(f[2] >= 13, F.lit("card")).otherwise(F.lit("phone"))
    taken = F.filter("__c", lambda c: c.score >= cut(c.f[0]))
    chosen = scored.select(*own, *(f"__b_{k}" for k in KINDS), "__all", F.transform(taken, lambda c: F.struct(kind(c.f).alias("kind"), c.s.alias("s"), c.e.alias("e"), c.m.alias("m"), c.score.alias("score"))).alias("__c"))
    free = F.filter("__c", lambda c: ~F.exists("__all", lambda b: (b.s < c.e) & (c.s < b.e)))
    apart = chosen.withColumn("__c", free)
    better = lambda a, c: (a.score > c.score) | ((a.score == c.score) & ((a.s < c.s) | ((a.s == c.s) & (a.e > c.e))))
    alone = F.array_distinct(F.filter("__c", lambda c: ~F.exists("__c", lambda a: (a.s < c.e) & (c.s < a.e) & better(a, c))))
    return apart.select(*own, F.struct(*(F.col(f"__b_{k}").alias(k) for k in KINDS)).alias("pii"), alone.alias("pii_more"))


def _marked(kind: str) -> Column:
    return F.transform(f"pii.{kind}", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(kind).alias("kind")))


def redact(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets (overlapping ones by one mark)."""
    got = find(docs, model, text)
    t = F.coalesce(F.col(text), F.lit(""))
    each = F.array_sort(F.concat(*(_marked(k) for k in KINDS), F.transform("pii_more", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind")))))
    start = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit("").alias("o"))

    def put(a: Column, x: Column) -> Column:
        piece = F.when(x.s < a.p, F.lit("")).otherwise(F.concat(F.substr(t, (a.p + 1).cast("int"), (x.s - a.p).cast("int")), F.lit("<"), x.kind, F.lit(">")))
        return F.struct(F.greatest(a.p, x.e).alias("p"), F.concat(a.o, piece).alias("o"))

    done = F.aggregate(each, start, put, lambda a: F.concat(a.o, F.substr(t, (a.p + 1).cast("int"), F.length(t))))
    return got.withColumn(text, F.when(F.col(text).isNull(), F.lit(None)).otherwise(done)).drop("pii", "pii_more")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The per-document digest of ``find``."""
    base = F.concat(*(spans.written(k, F.col(f"pii.{k}")) for k in KINDS))
    more = lambda kind: F.filter("pii_more", lambda x: x.kind == kind)
    line = lambda k, spans_: F.transform(F.array_sort(spans_), lambda x: F.concat(F.lit(f"{k}:"), x.s.cast("string"), F.lit(":"), x.e.cast("string")))
    pair = lambda a: F.transform(a, lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))
    every = F.concat(*(line(k, F.concat(pair(F.col(f"pii.{k}")), pair(more(k)))) for k in KINDS), *(line(k, pair(more(k))) for k in MORE))
    return found.select(key, *(F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size("pii_more").cast("long").alias("n_more"))
