"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Words (maximal runs without ASCII space, lower-cased) are padded with ``ORDER - 1`` start marks and an end
mark; a model predicts each character from the ``ORDER - 1`` before it. Counts of the longest n-grams come
from *all* learning rows: each task sums its distinct words, an aggregate sums tasks; lower orders are
continuation counts of these. Counts, discounts and probabilities are aggregates over all n-grams, and every
language of the learning rows has a model of all of its n-grams. Up to ``LIMIT`` entries the models are broadcast, in
sorted arrays by language and order. Larger ones stay tables: documents go to blocks, the distinct n-grams of all
blocks get their probabilities by joins, order by order, and each block gets those it asks for; nothing
larger than a block then lies in a task, and results are the same. The language of lowest cross-entropy per character
wins; ``rejected`` marks texts whose entropy exceeds the ``REJECT`` quantile of learning rows of the same language.

Defined results: null text, or one without a letter, is ``und`` with score 0; rows with null lang teach
nothing; empty tables give empty tables; without any learning row all is ``und``; ties go to the language
first in the alphabet; other columns don't take part. Code points over U+FFFF share the codes of the private use area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import clear, cut, discard, pieces

ORDER = 4
REJECT = 0.999
#: Least share of an order's counts for an n-gram to be kept: all are, unless a smaller model is wanted (the mass of others goes to shorter ones).
RARE = 0.0
#: N-grams and contexts of all languages and orders up to which models are broadcast, 16 bytes each.
LIMIT = 1 << 22
SHIFT = 16  # bits of a character in a code


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the distinct word of each occurrence, the row of each occurrence)."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = pc.list_flatten(lists)
    rows = np.asarray(pc.list_parent_indices(lists))
    coded = flat.dictionary_encode() if not isinstance(flat, pa.ChunkedArray) else flat.combine_chunks().dictionary_encode()
    index, words = np.asarray(coded.indices), coded.dictionary
    full = np.asarray(pc.binary_length(words)) > 0
    keep = full[index] if len(index) else np.zeros(0, bool)
    return words, index[keep], rows[keep]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of the longest n-gram at each position, the word it is of) with padding; marks are 1 and 2."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = "\x01" * (ORDER - 1)
    text = "".join(f"{pad}{w}\x02" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    far = points >> np.uint64(SHIFT) > 0
    points[far] = np.uint64(0xE000) + points[far] * np.uint64(2654435761) % np.uint64(6400)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + ORDER)
    code = points.copy()
    for k in range(1, ORDER):
        code[k:] |= points[:-k] << np.uint64(SHIFT * k)
    mask = np.ones(len(points), bool)
    first = ends - sizes - ORDER
    for k in range(ORDER - 1):
        mask[first + k] = False
    return code[mask], np.repeat(np.arange(len(words)), sizes + 1)


def counts(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, code, n)``: n-gram counts of the highest order; codes are 64 bits, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            names = batch.column(1).dictionary_encode()
            of = np.asarray(names.indices)
            words, index, row = _words(batch.column(0))
            code, word = _grams(words.to_pylist())
            for k, name in enumerate(names.dictionary.to_pylist()):
                times = np.bincount(index[of[row] == k], minlength=len(words))[word]
                use = times > 0
                grams, back = np.unique(code[use], return_inverse=True)
                n = np.bincount(back, times[use]).astype(np.int64) if len(grams) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return rows.select(text, lang).mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]  # per language and order: sorted codes, probabilities, sorted contexts, back-off weights
    reject: list[float]

    def log_prob_in(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of the last character of each code in language k."""
        p = np.full(len(codes), 1.0 / (1 << SHIFT))
        for order, (known, prob, contexts, weight) in enumerate(self.tables[k], 1):
            gram = codes & np.uint64((1 << (SHIFT * order)) - 1) if order < 4 else codes
            context = gram >> np.uint64(SHIFT)
            if len(contexts):
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                p = np.where(contexts[at] == context, weight[at], 1.0) * p
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                p += np.where(known[at] == gram, prob[at], 0.0)
        return np.log(p)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of the last character of each code, by language."""
        return np.stack([self.log_prob_in(k, codes) for k in range(len(self.langs))], 1)


@dataclass
class Wide:
    """A model that is too large for a broadcast: for each order n-grams and contexts as tables ``(code, x)``, x: values by place of the language."""

    langs: list[str]
    levels: list[tuple[DataFrame, DataFrame]]
    reject: list[float]


def _arrays(table: DataFrame, value: str, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per language the sorted codes and their values. ``table``: (lang, code, value), of at most ``LIMIT`` rows."""
    got = table.select("lang", "code", value).toArrow().combine_chunks()
    lang = np.asarray(pc.index_in(got.column("lang").combine_chunks(), pa.array(langs))) if got.num_rows else np.zeros(0, np.int64)
    code, x = np.asarray(got.column("code")).astype(np.int64).view(np.uint64), np.asarray(got.column(value)).astype(float)
    order = np.lexsort((code, lang))
    lang, code, x = lang[order], code[order], x[order]
    at = np.searchsorted(lang, np.arange(len(langs) + 1))
    return [(code[s:e], x[s:e]) for s, e in zip(at, at[1:], strict=False)]


def _tables(table: DataFrame, value: str, langs: list[str]) -> DataFrame:
    """``(code, x)``, written: the values of a code by place of the language."""
    place = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")) - 1
    return cut(table.groupBy("code").agg(F.collect_list(F.struct(place.cast("int").alias("k"), F.col(value).alias("v"))).alias("x")), "model")


def _smooth(grams: DataFrame, limit: int = LIMIT) -> Model | Wide | None:
    """Interpolated Kneser-Ney tables of all orders from counts of the highest. ``grams``: (lang, code, n)."""
    levels, langs, entries = [], None, 0
    for order in range(ORDER, 0, -1):
        number = lambda k: F.sum((F.col("n") == k).cast("long"))
        ones, twos = number(1), number(2)
        stats = grams.groupBy("lang").agg(F.sum("n").cast("double").alias("all"), F.when(ones + twos > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5).alias("d"))
        if langs is None:
            langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
            if not langs:
                return None
        held = grams.withColumn("context", F.shiftrightunsigned("code", SHIFT))
        total = held.groupBy("lang", "context").agg(F.sum("n").alias("total"))
        known = cut(held.join(stats, "lang").join(total.hint("merge"), ["lang", "context"]).select("lang", "code", "context", "n", "all", "total", ((F.col("n") - F.col("d")) / F.col("total")).alias("prob"), (F.col("n") >= F.lit(RARE) * F.col("all")).alias("keep")), "smoothed")
        shorter = cut(grams.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << (SHIFT * (order - 1))) - 1)).alias("code")).agg(F.count("*").alias("n")), "shorter") if order > 1 else None
        weights = known.groupBy("lang", F.col("context").alias("code")).agg((1 - F.sum(F.when(F.col("keep"), F.col("prob")).otherwise(0.0))).alias("weight"), F.first("total").alias("total"), F.first("all").alias("all")).where(F.col("total") >= F.lit(RARE) * F.col("all"))
        probs, weights = cut(known.where("keep").select("lang", "code", "prob"), "probs"), cut(weights.select("lang", "code", "weight"), "weights")
        entries += probs.count() + weights.count()
        levels.append((probs, weights))
        discard(known, grams)
        grams = shorter
    levels.reverse()
    if entries > limit:
        model = Wide(langs, [(_tables(a, "prob", langs), _tables(b, "weight", langs)) for a, b in levels], [])
    else:
        arrays = [[(*a, *b) for a, b in zip(_arrays(a, "prob", langs), _arrays(b, "weight", langs), strict=True)] for a, b in levels]
        model = Model(langs, [list(x) for x in zip(*arrays, strict=True)], [])
    discard(*(t for level in levels for t in level))
    return model


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", limit: int = LIMIT) -> Model | Wide | None:
    """A model from all rows with text and lang; none if there are none. ``limit``: entries up to which it is broadcast."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    model = _smooth(cut(counts(rows, text, lang), "grams"), limit)
    if model is None:
        return None
    # Rejection: a quantile of the entropy of learning rows, by approximate percentiles (bounded state).
    scored = score(rows.select(text, lang), model, text)
    cuts = {r.lang_pred: r.q for r in scored.where(F.col("lang_pred") == F.col(lang)).groupBy("lang_pred").agg(F.percentile_approx("entropy", REJECT, 10000).alias("q")).collect()}
    model.reject = [cuts.get(name, float("inf")) for name in model.langs]
    return model


def score(docs: DataFrame, model: Model | Wide | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), entropy (nats a character) and rejected."""
    from pyspark.sql import types as T

    docs = clear(docs, "lang_pred", "score", "entropy", "rejected")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    if isinstance(model, Wide):
        return _score_blocks(docs, model, at, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LIMIT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, at):
            yield _judged(batch, at, m.langs if m else [], m.reject if m else [], m.log_prob_in if m else None, schema.names)

    return docs.mapInArrow(run, schema)


def _judged(batch: pa.RecordBatch, at: int, langs: list[str], reject: list[float], log_prob_in: Callable[[int, np.ndarray], np.ndarray] | None, names: list[str]) -> pa.RecordBatch:
    """A batch with its verdicts. ``log_prob_in``: log probabilities of sorted, distinct codes in a language."""
    texts = batch.column(at)
    n = len(texts)
    letter = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    pred, value, entropy, out = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
    if langs and n:
        words, index, row = _words(texts)
        code, word = _grams(words.to_pylist())
        grams, back = np.unique(code, return_inverse=True)
        size = np.bincount(word, minlength=len(words))[index]
        length = np.maximum(1, np.bincount(row, size, n))
        cross = np.stack([-np.bincount(row, np.bincount(word, log_prob_in(k, grams)[back], len(words))[index], n) / length for k in range(len(langs))], 1) if len(index) else np.zeros((n, len(langs)))
        best = np.argmin(cross, 1)
        # Posterior of the winner, tempered by what a short text can tell.
        gap = np.exp(-np.minimum(50.0, (cross - cross.min(1, keepdims=True)) * np.minimum(length, 200.0)[:, None]))
        share = 1 / gap.sum(1)
        for i in np.nonzero(letter)[0]:
            pred[i], value[i], entropy[i] = langs[best[i]], share[i], cross[i, best[i]]
            out[i] = bool(reject) and entropy[i] > reject[best[i]]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.clip(value, 0, 1)), pa.array(entropy, pa.float64(), mask=np.isnan(entropy)), pa.array(out)], names=names)


def _score_blocks(docs: DataFrame, model: Wide, at: int, schema) -> DataFrame:
    """The same against tables: blocks of documents ask for the log probabilities of their distinct n-grams."""
    langs, reject, names = model.langs, model.reject, schema.names

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(pieces(batches, at)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + i], pa.int64()), "blob": pa.array([blocks.put(batch)], pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, *_ = _words(blocks.take([blob]).column(at).combine_chunks())
                codes = np.unique(_grams(words.to_pylist())[0])
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(codes), block)), "code": pa.array(codes.view(np.int64))})

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.full((batch.num_rows, len(langs)), 1.0 / (1 << SHIFT))
            for order in range(1, ORDER + 1):
                p = p * _dense(batch.column(f"w{order}"), len(langs), 1.0) + _dense(batch.column(f"p{order}"), len(langs), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(np.log(p).reshape(-1)), len(langs)).cast(pa.list_(pa.float64()))], names=["code", "logs"])

    def judge(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        codes = np.asarray(answers.column("code")).view(np.uint64)
        order = np.argsort(codes, kind="stable")
        codes, table = codes[order], np.asarray(answers.column("logs").combine_chunks().flatten()).reshape(len(order), -1)[order]
        body = blocks.take(bodies.column("blob").to_pylist()).combine_chunks().to_batches()
        return pa.Table.from_batches([_judged(b, at, langs, reject, lambda k, grams: table[np.searchsorted(codes, grams), k], names) for b in body])

    packed = cut(docs.mapInArrow(pack, "block bigint, blob binary"), "blocks")
    asked = cut(packed.mapInArrow(ask, "block bigint, code bigint"), "asked")
    known = asked.select("code").distinct()
    for order, (probs, weights) in enumerate(model.levels, 1):
        gram = F.col("code").bitwiseAND(F.lit((1 << (SHIFT * order)) - 1)) if order < ORDER else F.col("code")
        known = known.withColumn("g", gram).withColumn("c", F.shiftrightunsigned("g", SHIFT))
        known = known.join(probs.select(F.col("code").alias("g"), F.col("x").alias(f"p{order}")), "g", "left").join(weights.select(F.col("code").alias("c"), F.col("x").alias(f"w{order}")), "c", "left").drop("g", "c")
    table = cut(known.mapInArrow(logs, "code bigint, logs array<double>"), "logs")
    got = asked.join(table, "code")
    return packed.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(judge, schema)


def _dense(column: pa.Array, width: int, other: float) -> np.ndarray:
    """Rows of ``(k, v)`` lists as a matrix; ``other`` where there is none."""
    out = np.full((len(column), width), other)
    at, each = np.asarray(pc.list_parent_indices(column)), pc.list_flatten(column)
    out[at, np.asarray(each.field("k"))] = np.asarray(each.field("v"))
    return out


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = LIMIT) -> DataFrame:
    """Learn from rows that aren't held out; predict all from the text alone."""
    model = fit(docs.where(~held_out(key) | F.col(key).isNull()).select(text, lang), text, lang, limit)
    got = score(docs.select(key, text), model, text)
    return got.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
