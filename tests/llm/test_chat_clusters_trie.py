"""Chat formatting, centroid clustering and the prefix trie against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom.llm import chat_render, drake_cluster, prefix_trie
from vectorloom.llm.chat_render import Reader, Rendering, marked

# --- chat formatting

PARTS = st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "</turn>\n", "###", "### assistant: ", ":", "\n", "a", "é", "<", "/"]), max_size=8).map("".join)


def plain(turns):
    return "".join(f"[{r}]{t}\n" for r, t in turns)


def forgetful(turns):
    """A template that drops the reasoning of all turns but the last."""
    cut = lambda t: re.sub(r"<think>.*?</think>", "", t)
    return "".join(f"[{r}]{cut(t) if i < len(turns) - 1 else t}\n" for i, (r, t) in enumerate(turns))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PARTS), PARTS), max_size=6), st.integers(1, 7))
def test_marked_text_is_read_back(turns, step):
    out, reader, got = marked(turns), Reader(), []
    for i in range(0, len(out), step):
        got += reader.feed(out[i : i + step])
    assert got == turns and not reader.rest


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), PARTS), max_size=12), st.integers(1, 4))
def test_a_window_changes_nothing(turns, window):
    whole, part = Rendering(marked), Rendering(marked, context=1, window=window)
    assert [whole.feed(*t) for t in turns] == [part.feed(*t) for t in turns]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), PARTS), max_size=8))
def test_loss_covers_each_answer_once(turns):
    r, rows = Rendering(marked), []
    for t in turns:
        rows.append(r.feed(*t))
    text = "".join(x[3] for x in rows)
    assert text == marked(turns)
    assert [chat_render.unescaped(text[x[5] : x[6]]) for x in rows if x[5] is not None] == [t for who, t in turns if who == "assistant"]


def test_a_template_that_rewrites_history_begins_samples():
    turns = [("user", "q"), ("assistant", "<think>x</think>one"), ("user", "r"), ("assistant", "<think>y</think>two"), ("user", "s")]
    r = Rendering(forgetful)
    rows = [r.feed(*t) for t in turns]
    assert [x[7] for x in rows] == [False, False, True, False, True] and [x[1] for x in rows] == [0, 0, 1, 1, 2]
    samples = {}
    for x in rows:
        samples[x[1]] = samples.get(x[1], "") + x[3]
    assert samples == {0: forgetful(turns[:2]), 1: forgetful(turns[:4]), 2: forgetful(turns)}
    assert [samples[x[1]][x[5] : x[6]] for x in rows if x[5] is not None] == ["<think>x</think>one", "<think>y</think>two"]


def test_a_template_that_looks_back_further_than_it_says_is_kept_whole():
    def counted(turns):
        return "".join(f"{i}[{r}]{t}\n" for i, (r, t) in enumerate(turns))

    turns = [("user", str(i)) for i in range(9)]
    r = Rendering(counted, context=1, window=3)
    assert "".join(r.feed(*t)[3] for t in turns) == counted(turns)


def test_a_template_that_frames_by_the_text_is_refused():
    with pytest.raises(ValueError, match="frames"):
        Rendering(lambda turns: "".join(f"{len(t)}:{t};" for _, t in turns)).feed("assistant", "twelve chars")


def test_odd_conversations(spark):
    rows = [(1, 2, "assistant", None), (1, None, "user", "first"), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "user", "a"), (None, 1, "assistant", "b\\<turn>"), (2, 0, "assistant", "long " * 100_000), (3, 0, "", "")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, pos int")
    got = {r.conv_id: r for r in chat_render.digest(chat_render.render(df, context=1)).collect()}
    want = {1: [("user", "first"), ("", "x"), ("", "x"), ("assistant", "")], None: [("user", "a"), ("assistant", "b\\<turn>")], 2: [("assistant", "long " * 100_000)], 3: [("", "")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        answers = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].formatted_chars == len(marked(turns)) and got[k].loss_chars == len(answers)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(answers.encode()).hexdigest()
    whole = {(r.conv_id, r["sample"]): r for r in chat_render.texts(chat_render.render(df, plain)).collect()}
    assert whole[1, 0].text == plain(want[1]) and [tuple(x) for x in whole[1, 0].loss] == [(len(plain(want[1])) - 1,) * 2]
    assert chat_render.digest(chat_render.render(df.where("false"))).count() == 0


# --- centroid clustering


def lloyd(rows, dim, k, rounds, seed=1, scale=64):
    """Rows ``(id, floats)``; plain integers throughout."""
    kept = [(i, [int(np.floor(scale * float(x))) if abs(x) < 1e15 else int(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    of = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [of(v)[1] for _, v in kept]
        cs = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else c for j, c in enumerate(cs)]
    return sorted((i, *reversed(of(v))) for i, v in kept), cs


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v double").repartition(3)
    got, cs = drake_cluster.cluster(df, dim=options.pop("dim"), **options)
    return got, cs


@pytest.mark.parametrize("k, keep", [(16, None), (5, None), (1, None), (3, None)])
def test_clusters_against_plain_integers(spark, k, keep):
    rng = np.random.default_rng(k)
    base = rng.standard_normal((400, 8)) + 3 * rng.integers(0, 4, (400, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(base * 2) / 2)]  # coarse: many ties
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    got, cs = clustered(spark, rows, dim=8, k=k, rounds=4, scale=2)
    want, plain_cs = lloyd(rows, 8, k, 4, scale=2)
    assert cs == plain_cs and sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(6) / 8 + 4 * np.eye(6)[i % 6]]) for i in range(600)]
    got, _ = clustered(spark, rows, dim=6, k=6, rounds=6)
    assert got.where("scans = 1").count() > 300


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [0.5, 1.0]), (8, [2.0, 1.0]), (9, [1e30, -3.0])]
    got, cs = clustered(spark, rows, dim=2, k=4)
    want, plain_cs = lloyd(rows, 2, 4, 3)
    assert cs == plain_cs and sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    few, one = clustered(spark, rows[:1], dim=2, k=4)
    assert [(r.cluster, r.distance) for r in few.collect()] == [(0, 0)] and one == [[32, 64]]
    none, no = clustered(spark, rows[1:3], dim=2)
    assert none.count() == 0 and no == []
    nulls, _ = clustered(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [0.0, 0.0])], dim=2, k=2)
    assert sorted((r.vec_id is None, r.cluster) for r in nulls.collect()) == [(False, 0), (True, 1), (True, 1)]


def test_digest_of_clusters(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, cs = lloyd(rows, 2, 16, 3)
    sums = {c: sum(d for _, j, d in want if j == c) for _, c, _ in want}
    for r in drake_cluster.digest(df, dim=2).collect():
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


# --- prefix trie


def brute(rows, mixed):
    """Nodes ``{(conv_id, depth): row}`` of rows ``(conv, turn, role, text)``."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            dig = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, dig, text))
    paths = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    if mixed:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in paths}
        base = lambda c: c - (c % 100 if c >= 0 else -(-c % 100))
        paths = {c: paths.get(base(c), [])[: h[c]] + own[h[c] :] for c, own in paths.items()}
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(children), leaves, saved, ends)
    return out


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    rows = []
    for c in [*range(-205, -195), *range(95, 130), 200, 300, 301, 307]:
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "éé\U0001f600"])) for t in range(r.randint(1, 7))]
    for c in (400, 401, 499):  # long ones: several runs of turns
        rows += [(c, t, "user", str(t % 3)) for t in range(150 if c != 499 else 331)]
    rows += [(500, None, None, None), (500, None, "user", "x"), (500, 0, "user", None), (500, 0, "user", None), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("mixed", [True, False])
def test_trie_against_brute_force(spark, talks, mixed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    df = spark.createDataFrame([(*t, "k", 1) for t in talks], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.conversations(df, mixed=mixed).collect()}
    want = brute(talks, mixed)
    assert got == want


def test_one_large_conversation_lies_in_many_partitions(spark):
    df = spark.range(1000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = prefix_trie.ordered(df.repartition(5)).collect()
    assert sorted((r.pos, r.dig) for r in got) == [(i, hashlib.md5(f"4:user{i}".encode()).hexdigest()) for i in range(1000)]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversations(df, mixed=True).count() == 0
    only = spark.createDataFrame([(157, 0, "user", "a")], df.schema)
    assert zlib.crc32(b"157") % 6 > 0
    got = prefix_trie.conversations(only, mixed=True).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in got] == [(157, 0, 1, 1)] and got[0].ends_sha256 == hashlib.sha256(b"157").hexdigest()
