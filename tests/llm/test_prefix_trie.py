"""The prefix trie against a trie built top-down, on random and odd conversations."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rewrite_lake.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def in_order(rows):
    """conv_id -> its turns in order."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs, group=5, heads=9):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = convs.get(c - int(c % group if c >= 0 else -(-c % group)), [])[:h] + own[h:]
    return out


def top_down(members):
    """Rows of every node, from (id, turns) pairs."""
    by = defaultdict(list)
    for c, turns in members:
        for d in range(len(turns) + 1):
            by[tuple(turns[:d])].append((c, len(turns) == d))
    kids = defaultdict(set)
    for p in by:
        if p:
            kids[p[:-1]].add(p)

    def below(p):
        out = [p]
        for q in out:
            out += kids[q]
        return out
    rows = []
    for p, ms in by.items():
        under = below(p)
        ends = ",".join(map(str, sorted(c for c, last in ms if last)))
        rows.append((min(c for c, _ in ms), len(p), min(c for c, _ in by[p[:-1]]) if p else None, len(ms), len(kids[p]), sum(not kids[q] for q in under),
                     sum((len(by[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()], key=str)


def table(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        hot = rng.random() < 0.3
        for t in range(3 if hot else rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "é", "hot" * t if hot else rng.choice(["a", "b", "", None, "longer é text"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("runs", [None, 1, 2, 7, 40])
def test_equals_a_trie_built_top_down(spark, runs):
    rows = table(runs or 0)
    seqs = T.with_shared_heads(T.sequences(spark.createDataFrame(rows, SCHEMA)))
    assert found(T.prefix_trie(seqs, runs=runs)) == top_down(list(rebuilt(in_order(rows)).items()))


def test_a_group_of_copies_spans_runs(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    rows = [(c, t, "u", f"t{t}") for c in range(300) for t in range(2)] + [(c, t, "u", f"t{t}") for c in range(300, 420) for t in range(4)]
    rows += [(500, 0, "u", "t0"), (501, 0, "v", "x")]
    got = found(T.prefix_trie(T.sequences(spark.createDataFrame(rows, SCHEMA)), runs=30))
    assert got == top_down(list(in_order(rows).items()))


def test_order_of_turns_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, "b", "x"), (1, None, "a", None), (1, 3, None, "y"), (1, 3, None, "y"), (1, -2, "z", ""), (None, 0, "a", "lost"), (2, None, "a", "")]
    df = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA + ", seq string")
    assert found(T.prefix_trie(T.sequences(df))) == top_down(list(in_order(rows).items()))
    assert in_order(rows)[1][0] == ("a", "")


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(1, 0, "u", "x"), (6, 0, "u", "y"), (7, 0, "u", "z")]  # no first conversation in either group
    seqs = T.with_shared_heads(T.sequences(spark.createDataFrame(rows, SCHEMA)))
    want = top_down(list(rebuilt(in_order(rows)).items()))
    assert found(T.prefix_trie(seqs, runs=3)) == want and any(r[1] == 0 for r in want)
    assert found(T.prefix_trie(T.sequences(spark.createDataFrame([], SCHEMA)))) == []


def test_repeated_ids_are_members_each(spark):
    df = spark.createDataFrame([(1, b"a" * 16, [3]), (1, b"a" * 16, [3]), (2, b"a" * 32, [3, 4])], "conv_id long, seq binary, sizes array<int>")
    got = {r[1]: r for r in found(T.prefix_trie(df, runs=2))}
    assert got[1][3] == 3 and got[1][7] == hashlib.sha256(b"1,1").hexdigest() and got[0][6] == 6


def test_a_long_conversation(spark):
    rows = [(c, t, "u", f"{t % 7}" * 50) for c in (5, 6) for t in range(4000 + c)]
    got = found(T.prefix_trie(T.sequences(spark.createDataFrame(rows, SCHEMA)), runs=2))
    assert len(got) == 4007 and {r[3] for r in got if r[1] <= 4005} == {2} and [r[0] for r in got if r[1] == 4006] == [6]
