"""Each stage of the pipeline does to its own input what it says."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import minhash, quality


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    steps = dict(P.STAGES)
    good = steps["quality"](spark, docs, data)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.scored(docs, ["doc_id", "text"]).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    single = steps["near_duplicates"](spark, good, data)
    groups = minhash.near_duplicate_groups(good, 5, 80).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    clean = steps["secrets"](spark, single, data)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {r.doc_id for r in single.collect()} and not any("token = \"" in (t or "") and "[SECRET]" not in t for t in texts.values())
    mixed = steps["mixing"](spark, clean, data)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= set(texts) and max(times.values()) <= 3
    packed = steps["packing"](spark, mixed, data).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times


def test_run_and_odd_rows(spark, data, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", None, 150_000), (3, "word " * 30_000, "en", None, 150_000), (None, "A small note on the river and the lantern in the window of a house.", "en", "b", 67)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = P.run(spark, f"{tmp_path}/{name}")
        assert got.columns[:2] == ["doc_id", "piece"] and {r.doc_id for r in got.collect()} <= {r[0] for r in some}
    docs, steps = spark.createDataFrame(rows, schema).withColumn("text2", F.lit(1)).withColumn("size", F.lit("x")), dict(P.STAGES)
    tuples = lambda df: Counter(tuple(r) for r in df.collect())
    assert set(tuples(steps["quality"](spark, docs, data))) <= set(rows)
    assert tuples(steps["near_duplicates"](spark, docs, data)) == Counter(set(rows))
    assert tuples(steps["secrets"](spark, docs, data)) == Counter(rows)
    mixed = tuples(steps["mixing"](spark, docs, data))
    assert set(mixed) <= {r for r in rows if r[1]} and max(mixed.values()) <= 6  # three times, of a row that is there twice
    assert Counter(r.doc_id for r in steps["packing"](spark, docs, data).collect() if r.piece == 0) == Counter(r[0] for r in rows)


def test_stages_by_brute_force(spark, data):
    """Each stage's rows from plain loops over its input, not from the operator that it calls."""
    import random
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidemark.llm import secrets
    from tidemark.llm.queries import tokenizer_file

    steps = dict(P.STAGES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*P.COLUMNS).collect()]
    rng = random.Random(3)
    base = [r for r in rows if r[1] and len(r[1].split()) > 40][:30]
    for k, r in enumerate(base):  # near copies: some words changed; farther ones; exact ones
        words = r[1].split()
        for _ in range(rng.choice([0, 1, 2, 12])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100_000 + k, " ".join(words), *r[2:]))
    rows += [(200_000, None, "en", "a", 0), (200_001, "", "en", None, 0), (200_002, 'key password = "abcdefgh12345678" end of it', "en", "a", 40)]
    docs = spark.createDataFrame(rows, docs.select(*P.COLUMNS).schema)

    single = steps["near_duplicates"](spark, docs, data)
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in single.collect()) == sorted({find(i) for i in ids})

    clean = {r.doc_id: r for r in steps["secrets"](spark, single, data).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert set(clean) == set(before)
    for i, t in before.items():
        found = [m.span() for m in re.finditer(secrets.ASSIGN, t or "") if len(m[2]) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", t or "")]
        assert (clean[i].text == t) or "[SECRET]" in clean[i].text
        assert not found or all((t or "")[a:b] not in clean[i].text for a, b in found)
        assert clean[i].n_chars == (len(clean[i].text) if t is not None else 0)
    assert clean[200_002].text == "key [SECRET]\" end of it"

    kept = spark.createDataFrame(list(clean.values()), docs.schema)
    mixed = [r for r in steps["mixing"](spark, kept, data).collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in clean.items()}
    per = Counter()
    for i, r in clean.items():
        per[r.source] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(per)
    while free:
        left, total = sum(per.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * per[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3 * per[s] for s in over}
        free -= over
    taken, most = Counter(), Counter()
    for r in mixed:
        taken[r.source] += size[r.doc_id]
        most[r.source] = max(most[r.source], size[r.doc_id])
    assert all(n <= 3 for n in Counter(r.doc_id for r in mixed).values())
    assert all(abs(taken[s] - target[s]) <= max((size[i] for i, r in clean.items() if r.source == s), default=0) for s in per)

    packed = steps["packing"](spark, spark.createDataFrame(mixed, docs.schema), data).collect()
    plain = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for r in mixed:
        tokens = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(tokens), 2048)):
            part = tokens[at : at + 2048]
            want[r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
