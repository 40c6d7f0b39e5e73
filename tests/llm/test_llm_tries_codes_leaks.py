"""Vector codes, the trie of conversations and benchmark passages against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tools import SCHEMA, edge_rows, prose, table

from wayfare.llm import conversation_trie, decontamination, vector_codes

# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(id, vector) rows, usable ones only: codes, errors and the final entries by all distances."""
    whole = [[int(np.floor(4096 * x)) for x in v] for _, v in rows]
    size = len(whole[0])
    cuts = [(s.start, s.stop) for s in vector_codes.part_slices(size, parts)]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))[:entries]
    books = [[whole[k][a:b] for k in first] for a, b in cuts]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            won = defaultdict(list)
            for v in whole:
                won[nearest(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(won[e]) for c in zip(*won[e])] if won[e] else old for e, old in enumerate(books[p])]
    found = [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)] for v in whole]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(d for d, _ in f) for f in found], digest


@pytest.mark.parametrize("size, parts, entries, rounds", [(16, 8, 16, 6), (10, 4, 12, 9), (6, 3, 5, 4)])
def test_codes_are_those_of_all_distances(spark, size, parts, entries, rounds):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(20, size))
    rows = [(int(i) if i % 29 else None, (centres[i % 20] + rng.normal(size=size) * 0.3).round(3).tolist(), [None, "a", "b"][i % 3]) for i in range(1, 400)]
    rows += [(i, rows[0][1], "a") for i in range(1_000, 1_100)] + [(7, rows[3][1], None), (2_000, [1e30] + [0.0] * (size - 1), "b")]
    faulty = [(1, None, "a"), (2, [None] * size, "a"), (3, [float("nan")] * size, "b"), (4, [float("inf")] * size, None), (9_000, [0.5] * (size + 1), "a")]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows + faulty], "vec_id long, embedding array<double>, label string, code_whole string, error string").repartition(5)
    found = vector_codes.encode_vectors(frame, parts=parts, entries=entries, rounds=rounds)
    assert set(found.columns) == {"vec_id", "embedding", "label", "code_whole", *vector_codes.ADDED}
    limit = vector_codes._limit(size) / 4096
    codes, errors, digest = plain_codes([(i, [max(-limit, min(limit, x)) for x in v]) for i, v, _ in rows], parts, entries, rounds)
    by_label = Counter()
    for (_, _, label), error in zip(rows, errors):
        by_label[label] += error
    expected = Counter((i, tuple(v), label, code, error, by_label[label] if by_label[label] < 2**63 else None, digest) for (i, v, label), code, error in zip(rows, codes, errors))
    assert Counter((r.vec_id, tuple(r.embedding), r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()) == expected


def test_codes_of_few_rows_and_of_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.encode_vectors(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.encode_vectors(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    found = vector_codes.encode_vectors(spark.createDataFrame([(5, [0.0] * 8, None), (4, [1.0] * 8, None), (6, [1.0] * 8, 2)], kind)).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in found} == {(4, "00" * 8, 0, 0), (5, "01" * 8, 0, 0), (6, "00" * 8, 0, 0)}
    assert {(r.vec_id, r.code) for r in vector_codes.encode_vectors(spark.createDataFrame([(1, [], 1)], kind)).collect()} == {(1, "00" * 8)}


@given(st.lists(st.lists(st.integers(-40, 40), min_size=2, max_size=2), min_size=6, max_size=40), st.lists(st.integers(1, 6), min_size=5, max_size=5))
@settings(max_examples=200, deadline=None)
def test_lists_settle_like_all_distances(points, lengths):
    """Entries wander at random, lists grow and shrink: every round gives the nearest entry, and bounds hold."""
    x, rng = np.array(points, np.int64), np.random.default_rng(len(points))
    entries = x[:6].copy()
    lists = vector_codes.Lists.unknown(len(x), min(lengths[0], 6))
    for b in lengths:
        best, _ = lists.assign(x, entries)
        d = vector_codes.squared(x, entries)
        assert (lists.near[:, 0] == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        for row, (near, bound) in enumerate(zip(lists.near, lists.bound)):
            for j in range(len(bound)):
                rest = [e for e in range(6) if e not in near[: j + 1].tolist()]
                assert all(np.sqrt(d[row, e]) >= bound[j] for e in rest)
        lists = vector_codes.Lists(lists.near, (lists.bound * (1 - vector_codes.ROOM32)).astype(np.float32).astype(np.float64))
        moved = entries + rng.integers(-4, 5, entries.shape) * (rng.random((6, 1)) < 0.5)
        lists.moved(vector_codes._above(((moved - entries) ** 2).sum(axis=1)))
        entries, lists = moved, lists.resized(b)


def test_length_of_lists_adapts():
    assert vector_codes.next_b(4, [900, 0, 99, 1, 0, 0], 16) == 2
    assert vector_codes.next_b(4, [900, 0, 50, 20, 30, 0], 16) == 4
    assert vector_codes.next_b(4, [900, 0, 10, 0, 0, 90], 16) == 8
    assert vector_codes.next_b(4, [0] * 6, 16) == 4


# ---------------------------------------------------------------- conversations


def plain_trie(rows):
    """(conv, turn, role, text) rows to the node rows, without Spark."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if built[c] == node)
        parent = members[node[:-1]][0] if node else None
        out[(convs[0], len(node), parent, len(convs), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("band, block", [(16, 1 << 15), (2, 3), (3, 1 << 15)])
def test_trie_is_that_of_plain_python(spark, monkeypatch, band, block):
    monkeypatch.setattr(conversation_trie, "BAND", band)
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    random.seed(band)
    rows = [(c, t, random.choice(["user", "user", None]), random.choice(["hi", "hé", "", None, prose(1, 3)])) for c in range(40, 160) for t in range(random.randint(1, 7))]
    rows += [(c, t, "user", f"t{t}") for c in (5, 6, 8, 205) for t in range(37)] + [(300, t, "a", "x") for t in range(60)]
    rows += [(c, 0, "user", "hi") for c in range(1_000, 1_040)] + [(1_000, 0, "user", "hi"), (7, None, "z", "first"), (7, 0, None, None), (None, 1, "u", "t")]
    rows += [(501, t, "u", "short") for t in range(2)] + [(506, None, None, None), (511, 0, "user", prose(9, 30_000)), (512, 0, "user", prose(9, 30_000))]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    found = conversation_trie.conversation_trie(frame).select(*conversation_trie.COLUMNS)
    assert Counter(map(tuple, found.collect())) == plain_trie(rows)
    assert found.where("depth > 36").count() > 20


def test_turns_of_equal_number_have_one_order(spark):
    rows = [(c, 1, "u", text) for c in (10, 15) for text in ("one", "two", "three")]
    kind = "conv_id long, turn long, role string, text string"
    results = [conversation_trie.conversation_trie(spark.createDataFrame(r, kind)).collect() for r in (rows, rows[::-1])]
    assert all(len(r) == 4 and {x.n_convs for x in r} == {2} for r in results)


def test_trie_without_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie.conversation_trie(spark.createDataFrame([], kind)).count() == 0
    assert conversation_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    turnless = [c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0]
    found = conversation_trie.conversation_trie(spark.createDataFrame([(c, 1, "a", "b") for c in turnless], kind)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in found] == [(turnless[0], 0, len(turnless), 1)]


# ---------------------------------------------------------------- benchmark passages


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items, window=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, other in items:
        w = plain_words(other)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            run = w[i : i + window]
            for k in range(len(words) - len(run) + 1):
                if words[k : k + len(run)] == run:
                    hit |= set(range(k, k + len(run)))
                    found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6),
    st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5), st.integers(1, 7),
)
@settings(max_examples=500, deadline=None)
def test_automaton_finds_every_window(items, words, window, piece):
    size = decontamination.PIECE
    decontamination.PIECE = piece
    try:
        machine = decontamination.Automaton([(str(i), [w.encode() for w in words]) for i, words in enumerate(items)], window)
        n, runs, found = machine.scan(" ".join(words).encode())
    finally:
        decontamination.PIECE = size
    assert (n, sum(b - a for a, b in runs), sorted(found)) == plain_leaks(" ".join(words), [(i, " ".join(t)) for i, t in enumerate(items)], window)
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


LONG_ITEM = prose(50, 400)
ITEMS = [
    (1, prose(21, 30)), (2, "Ünïcode 12 words"), (3, None), (4, " .,; "), (2, "one more text of two"), (None, prose(22, 14)), (5, LONG_ITEM), (6, prose(21, 12)), (7, "one")
]


def leaky_rows():
    cut = LONG_ITEM.split()
    return edge_rows() + [
        (20, f"Before {prose(21, 30).upper()} after", "a"), (21, "so ÜNÏcode, no; Ünïcode--12/words!", "b"), (22, " ".join(cut[93:108]), "a"), (23, " ".join(cut[93:102]), None),
        (24, prose(22, 14) + "\n" + prose(22, 14), "c"), (25, " ".join(cut), "c"),
    ]


@pytest.mark.parametrize("shard", [decontamination.SHARD_WORDS, 40])
def test_leaks_are_those_of_all_windows(spark, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    docs = table(spark, leaky_rows())
    items = spark.createDataFrame([(*i, "own") for i in ITEMS], "item_id long, text string, shard string")
    found = decontamination.decontaminate(docs, items, coverage=0.9)
    assert set(found.columns) == set(docs.columns) | set(decontamination.ADDED)
    rows = found.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(leaky_rows())
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == plain_leaks(r.text, ITEMS), r.doc_id
        gone = [(r.text or "")[s.start : s.end] for s in r.spans]
        assert sum(len(plain_words(g)) for g in gone) == r.n_hit
        assert len(r.clean_text) + sum(map(len, gone)) == len(r.text or "")
        assert r.rejected == (r.n_hit > 0.9 * r.n_words)
    assert {r.doc_id for r in rows if r.rejected} == {9, 20, 22, 24, 25}
    assert [r.clean_text for r in rows if r.doc_id == 20] == ["Before  after"]
    assert [r.clean_text for r in rows if r.doc_id == 21] == ["so ÜNÏcode, no; !"]


def test_leaks_without_items_or_documents(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert all(r.n_hit == 0 and r.clean_text == (r.text or "") for r in decontamination.decontaminate(table(spark, edge_rows()), nothing).collect())
    assert decontamination.decontaminate(spark.createDataFrame([], SCHEMA), items).count() == 0


def test_automaton_is_linear():
    machine = decontamination.Automaton([("a", [b"a"] * 5_000), ("b", [b"a", b"b"] * 2_500)], 10)
    assert len(machine.link) <= 2 * 10_000
    n, runs, items = machine.scan(b"a " * 200_000 + b"b a " * 100_000)
    assert (n, items) == (400_000, {"a", "b"}) and runs[0][0] == 0
