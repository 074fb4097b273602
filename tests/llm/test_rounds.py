"""Exact copies, hard negatives and repaired conversations: odd rows, small bounds, brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, exact, negatives, queries


# exact copies


def test_merged_by_definition():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(bytes([rng.choice((0, 7))]) * 8 + bytes([rng.randrange(3)]) * 40, rng.randrange(2), rng.randrange(-3, 3), rng.randrange(1000), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 30))]
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        runs = [np.array(sorted(rows[a:b]), exact.ENTRY) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        want = []
        for key in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == key]
            want.append((key, *min(r[1:4] for r in own), sum(r[4] for r in own)))
        got = exact.merged(runs)
        assert [(bytes(x["key"]).ljust(48, b"\0"), x["missing"], x["order"], x["place"], x["n"]) for x in got] == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_tree_of_small_pieces(spark, rounds):
    """Pieces of two entries and up to three rounds give the groups that counting gives; one text has a third of all rows."""
    rng = random.Random(rounds)
    texts = ["hot" if rng.random() < 0.33 else f"text {rng.randrange(150)}" for _ in range(600)]
    rows = [(i, t, None if rng.random() < 0.1 else rng.randrange(-50, 50)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "place long, text string, order long").repartition(7).withColumn("key", exact.text_key(F.col("text")))
    got = {(bytes(r.of), r.best, r.stays, r.n) for r in exact.tree_merge(df, rounds, size=2).collect()}
    want = set()
    for text in set(texts):
        own = [r for r in rows if r[1] == text]
        if len(own) > 1:
            first = min(own, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
            data = text.encode()
            want.add((hashlib.sha256(data).digest() + len(data).to_bytes(8, "big"), first[2], first[0], len(own)))
    assert {(k[:40], *x) for k, *x in got} == want and len(got) == len(want)


def test_rounds_follow_the_rows():
    assert [exact.rounds_for(n, 100) for n in (0, 6_400, 6_401, 51_200, 51_201)] == [2, 2, 3, 3, 4]


def test_exact_of_odd_rows(spark):
    long = "word " * 100_000
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, long), (6, long + "x"), (7, long), (None, "b"), (None, "b"), (-(2**63), "c"), (2**63 - 1, "c"), (8, "A")]
    rows = [(*r, "k", 1, b"x", 2, "z") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long, of binary, place int, order string").repartition(4)
    got = sorted((exact.exact_duplicates(docs).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter(
        [(1, 2, 4, False, sha("a")), (2, 2, 4, True, sha("a")), (2, 2, 4, False, sha("a")), (None, 2, 4, False, sha("a")), (3, 4, 2, False, sha("")), (4, 4, 2, True, sha(""))]
        + [(5, 7, 2, False, sha(long)), (7, 7, 2, True, sha(long)), (6, 6, 1, True, sha(long + "x")), (None, None, 2, True, sha("b")), (None, None, 2, False, sha("b"))]
        + [(-(2**63), 2**63 - 1, 2, False, sha("c")), (2**63 - 1, 2**63 - 1, 2, True, sha("c")), (8, 8, 1, True, sha("A"))]
    )
    assert Counter(tuple(r) for r in got) == want
    least = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_duplicates(docs, "smallest").where("doc_id is not null").collect()}
    assert least[7] == (5, False) and least[5] == (5, True) and least[2**63 - 1] == (-(2**63), False) and least[1] == (1, True)
    folded = {r.doc_id: r.keep_id for r in exact.exact_duplicates(docs, normal=F.lower).where("doc_id is not null").collect()}
    assert folded[1] == 8 == folded[8]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact.exact_duplicates(docs, "first")


def test_heavy_and_light_copies(spark, monkeypatch):
    """Copies that are broadcast and copies that meet their rows by key give the same results."""
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i % 12}") for i in range(300)], "doc_id long, text string")
    whole = {tuple(r) for r in exact.exact_duplicates(docs).collect()}
    monkeypatch.setattr(exact, "HEAVY", 1)
    assert {tuple(r) for r in exact.exact_duplicates(docs).collect()} == whole
    assert {(r[1], r[2]) for r in whole if r[3]} == {(299, 200), (297, 25), (294, 25), (291, 25), (288, 25)}


# hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, v)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, (anchor, label, v) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-dot(v, x), c, k, lab == label) for k, (c, lab, x) in enumerate(rows) if k != i and len(x) == len(v)))
        for s, positive, _, _ in [x for x in scored if x[3]][:positives]:
            found = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(anchor, positive, rank, x[1], -s, -x[0]) for rank, x in enumerate(found, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0, "y") for r in rows], "vec_id long, label int, v array<bigint>, items string, a int, norm double, k string").repartition(3)


@pytest.mark.parametrize("bucket,block", [(3, 2), (4096, 256)])
def test_negatives_by_brute_force(spark, bucket, block):
    """Uneven norms, many ties, one vector of a third of all rows, repeated rows, several lengths."""
    rng = random.Random(bucket)
    rows = []
    for i in range(90):
        scale = rng.choice((0, 1, 3, 20, 200))
        v = [4, -2, 1] if rng.random() < 0.33 else [scale * rng.randrange(-3, 4) for _ in range(rng.choice((3, 3, 3, 2)))]
        rows.append((i, rng.randrange(4), v))
    rows += [rows[20], rows[21], (200, 1, []), (201, 2, []), (202, 1, [])]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, bucket=bucket, block=block)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_large_scores_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.randrange(-(10**8), 10**8) for _ in range(8)]) for i in range(40)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0, low=0)
    want = brute_negatives(rows, lambda i: i % 5 == 0, low=0)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(want.values()) > 50
    a, x = np.array([[2**31 - 1, -(2**31)]], np.int32), np.array([[2**30, 3]], np.int32)
    assert negatives.products(a, x, 2.0**62).tolist() == [[(2**31 - 1) * 2**30 - 3 * 2**31]]


def test_pruning_skips_buckets(spark, monkeypatch):
    """An anchor whose windows are full meets no bucket that its bars rule out."""
    rows = [(i, i % 2, [1000 if i < 20 else 1, 0]) for i in range(200)]
    items = vectors(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v"))
    items = items.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.element_at("v", 1).cast("double") * F.element_at("v", 1)), "item": F.col("vec_id")})
    anchors = items.where("vec_id = 0")
    windows = anchors.select(F.col("item").alias("a"), F.lit(0).alias("w"), F.lit(-5).cast("long").alias("lo"), F.lit(10**12).alias("hi"))
    seen = []
    original = negatives.wave_pairs
    monkeypatch.setattr(negatives, "wave_pairs", lambda *a: (seen.append(original(*a).count()), original(*a))[1])
    best = negatives.search(anchors, windows, items, 5, False, bucket=10, block=4).collect()
    assert sorted((r.score, r.id) for r in best) == [(10**6, i) for i in (1, 3, 5, 7, 9)]
    assert sum(seen) <= 3  # of 20 buckets or more; those of equal norms may hold ties


def test_vectors_that_take_no_part(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, None, [9.0, 9.0]), (4, 1, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    left = negatives.usable(df)
    assert sorted(r.vec_id for r in left.collect()) == [0, 1, 2]
    whole = left.select("vec_id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    got = negatives.hard_negatives(whole, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256 + 128 * 128, 256 * 128 + 128 * 128)]
    assert negatives.hard_negatives(whole.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(whole, F.col("vec_id") > 100).count() == 0


# conversations

MOVES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(rows):
    """rows: (initial, fault) with fault in "", "blank", "duplicate", "truncated". All edits, from the end, with no queue and no heuristic."""
    n = len(rows)
    best = [dict() for _ in range(n + 1)]
    best[n] = {"": (0, ""), "a": (0, "")}
    for i in range(n, -1, -1):
        if i < n:
            initial, fault = rows[i]
            for state, moves in MOVES.items():
                ways = [(best[i + 1][state][0] + 4, "D" + best[i + 1][state][1])] if state in best[i + 1] else []
                if fault in ("", "truncated"):
                    charge = 3 if fault else 0
                    ways += [(best[i + 1][to][0] + 3 + charge, "R" + best[i + 1][to][1]) for role, to in moves.items() if role in "ua" and to in best[i + 1]]
                    if initial in moves and moves[initial] in best[i + 1]:
                        ways.append((best[i + 1][moves[initial]][0] + charge, "K" + best[i + 1][moves[initial]][1]))
                if ways:
                    best[i][state] = min(ways)
        for _ in range(4):  # insertions lead from state to state at one place
            for state, moves in MOVES.items():
                ways = [best[i][state]] if state in best[i] else []
                ways += [(best[i][to][0] + 3, "I" + best[i][to][1]) for role, to in moves.items() if role in "ua" and to in best[i]]
                if ways:
                    best[i][state] = min(ways)
    return best[0][""]


FAULTS = ("", "blank", "duplicate", "truncated")


def repaired_by_brute_force(rows):
    """rows: (conv_id, turn, role, text), damaged already or not; conv_id -> the row of the result."""
    spaces, groups = " \t\n\x0b\x0c\r", defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, coded = set(), []
        for _, role, text in own:
            core = text.strip(spaces)
            coded.append((role[:1], "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute_repair(coded)
        state, texts, k = "", [], 0
        for edit in audit:
            if edit in "IR":
                state = "a" if state == "u" else "u"
                texts.append(("user:" if state == "u" else "assistant:") + (own[k][2] if edit == "R" else ""))
            elif edit == "K":
                state = own[k][1][0]
                texts.append(f"{own[k][1]}:{own[k][2]}")
            k += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in texts))
        counts = [sum(f == x for _, f in coded) for x in FAULTS[1:]]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        fault = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


@pytest.mark.parametrize("segment", [1, 2, 5, 256])
def test_search_by_brute_force(segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    conversations._cheapest_short.cache_clear()
    rng = random.Random(segment)
    for _ in range(1500):
        rows = [(rng.choice("suuuaaax"), rng.choice(("", "", "", *FAULTS[1:]))) for _ in range(rng.randrange(12))]
        codes = bytes("suax".index(a) * 4 + FAULTS.index(f) for a, f in rows)
        assert conversations.cheapest(codes) == brute_repair(rows), rows
    conversations._cheapest_short.cache_clear()


def test_long_conversations():
    rng = random.Random(4)
    for rows in ([("u", "")] * 3000, [("a", "truncated")] * 3000, [(rng.choice("uas"), rng.choice(("", "", "truncated", "blank"))) for _ in range(3000)]):
        assert conversations.cheapest(bytes("suax".index(a) * 4 + FAULTS.index(f) for a, f in rows)) == brute_repair(rows)
    cost, audit = conversations.cheapest(b"\x04" * 300_000)
    assert cost == 450_000 and audit == "KR" * 150_000


def test_repair_of_odd_rows(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 5, "user", "Bye"), (1, None, "user", "First."), (1, None, None, "Second.")]
    rows += [(2, 3, "user", None), (2, 4, "", "no role."), (2, 5, "tool", "?"), (2, 5, "tool", " \x0b\n"), (None, 1, "user", "a."), (None, 2, "assistant", "b. "), (3, -4, "assistant", long), (3, 9, "user", long), (3, 10, "assistant", long)]
    rows += [(4, i, "user" if i % 3 else "assistant", "Same." if i % 4 else f"Other {i}.") for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "z", 2, b"d") for r in rows], "conv_id long, turn long, role string, text string, code int, digest string, n long, audit binary").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df).collect()}
    assert got == repaired_by_brute_force(rows)
    assert conversations.repaired(df.limit(0)).count() == 0
    ids = spark.createDataFrame([(1,), (99,), (99,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df.where("conv_id = 1"), ids).collect()}
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(got) == {1, 99}
    named = df.where("conv_id = 1").withColumn("conv_id", F.lit("c"))
    assert tuple(conversations.repaired(named).first())[1:] == got[1]


def test_damage_by_definition(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "A. B! C?"), ("assistant", None), (None, "D")] * 12)] + [(1, None, "user", "E."), (1, 3, "user", "A. B! C?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in conversations.damaged(df).collect()) == Counter(damage(rows))


def test_query_of_conversations_by_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = repaired_by_brute_force(damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversations(spark, data).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == want.get(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


# spot signatures: the search


def test_linked_documents_by_brute_force(spark, data):
    """Every pair of the table's documents compared: no link is lost, none is made up."""
    from tidemark.llm import spotsigs

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(6)
    words = lambda t: t.split(" ")
    for i, (_, text) in enumerate(rows[:60]):  # near copies of several degrees
        cut = words(text or "")
        for _ in range(rng.randrange(1, 8)):
            if cut:
                cut[rng.randrange(len(cut))] = rng.choice(("lantern", "the", "river"))
        rows.append((100_000 + i, " ".join(cut)))
    got = {r.doc_id: r for r in spotsigs.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    sets = {i: spotsigs.spot_set(t or "") for i, t in rows}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s.tobytes()].append(i)
    reps = {min(v): sets[min(v)] for v in classes.values()}
    root, links = {r: r for r in reps}, Counter()
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(reps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = reps[a], reps[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared / (len(x) + len(y) - shared) >= 0.8:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sum(links.values()) > 20 and len(got) == len(rows)
    for members in classes.values():
        rep = min(members)
        for i in members:
            assert (got[i].class_id, got[i].component_id, got[i].links, got[i].n_spots) == (rep, find(rep), links[rep], len(reps[rep]))
