"""Near and exact deduplication, decontamination: against brute force on small tables."""

import hashlib
import itertools
import os
import random
import subprocess
import sys
import time
from collections import Counter

import xxhash

from cubewright.llm import decontaminate, exactdedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest int, key string"


def documents(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", "s", len(t or ""), "clash", 7, None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint); smallest reachable doc_id by trying all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(rows))]


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 400]))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c).upper())
    return [*texts, None, "", " \t\n", texts[0], texts[0], "É x y", "word " * 70_000]


def test_near_duplicates(spark):
    texts = near_texts()
    ids = [1000 - i for i in range(len(texts))]
    ids[3] = None
    ids[5] = ids[4]
    got = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    made = [(i, brute_fingerprint(t)) for i, t in zip(ids, texts)]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(made, brute_components(made))]
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted(want, key=repr)
    distinct = {f for _, f in made}
    assert all(r["n_links"] == sum(0 < bin(int(r["fingerprint"], 16) ^ f).count("1") <= 2 for f in distinct) for r in got)


def test_links_within_two_bits(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:25]:
        fps |= {f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), f ^ 0b111}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_near_stage(spark):
    texts = near_texts()
    docs = documents(spark, texts)
    kept = simhash.one_of_each(docs)
    want = {c for c in brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)])}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert simhash.one_of_each(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def sha(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return hashlib.sha256(low.encode()).hexdigest()


def test_exact_duplicates(spark):
    texts = ["a b", "A B", "É", "é", None, "", "x", "x", "x" * 100_000, "straße İ", "STRASSE", "x"]
    ids = list(range(len(texts) - 1)) + [7]  # the last repeats a row
    index = exactdedup.new_index(spark)
    got = exactdedup.exact_duplicates(documents(spark, texts, ids), index).collect()
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(sha(t), []).append(i)
    assert len(got) == len(texts)
    for r in got:
        own = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (max(own), len(own)) and r["doc_id"] in own
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(max(g) for g in groups.values())
    # A later batch: what the index holds is a copy, the rest is new.
    later = exactdedup.without_copies(documents(spark, ["a B", "new", "NEW"], [50, 51, 52]), index)
    assert [r["doc_id"] for r in later.collect()] == [52]
    assert index.read().count() == len(groups) + 1
    kept = exactdedup.without_copies(documents(spark, texts, ids), exactdedup.new_index(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exactdedup.exact_duplicates(documents(spark, ["x"]).limit(0), exactdedup.new_index(spark)).count() == 0
    null_id = exactdedup.exact_duplicates(documents(spark, ["q", "q"], [None, 3]), exactdedup.new_index(spark)).collect()
    assert {(r["doc_id"], r["kept"]) for r in null_id} == {(None, False), (3, True)}
    index.drop()


def test_null_and_repeated_ids_lose_no_text(spark):
    """One row of each text stays, of each component one, whatever the ids."""
    long = [" ".join(f"{p}{k}" for k in range(60)) for p in "abcde"]
    texts, ids = [*long, long[0], long[1], long[3], long[0].upper(), long[3]], [None, None, 7, 7, 3, None, 5, 7, None, 9]
    for stage in (lambda d: exactdedup.without_copies(d, exactdedup.new_index(spark)), simhash.one_of_each):
        out = stage(documents(spark, texts, ids))
        got = {(r["doc_id"], r["text"].lower()) for r in out.collect()}
        last = 9 if stage is not simhash.one_of_each else 7
        assert out.count() == 5 and got == {(None, long[0]), (5, long[1]), (7, long[2]), (last, long[3]), (3, long[4])}
        assert out.columns == documents(spark, texts, ids).columns


def test_index_is_bucketed(spark):
    index = exactdedup.new_index(spark)
    groups = spark.createDataFrame([(b"a", 1, 1)], index.SCHEMA)
    plan = index.lookup(groups)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and plan.count("Exchange") == 1


def brute_overlaps(docs, items):
    """(doc_id, item_id) -> matched, stretch, near_word: every way to lay an item over a document, no seeds."""
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out, items = {}, [(i, words(t)) for i, t in items]
    for d, text in docs:
        h = words(text)
        places = {}
        for at, w in enumerate(h):
            places.setdefault(w, []).append(at)
        for i, b in items:
            need = min(len(b), 13)
            shifts = Counter(at - p for p, w in enumerate(b) for at in places.get(w, ()))
            for shift in [x for x, n in shifts.items() if 5 * n >= 4 * need]:
                for j in range(max(0, -shift), min(len(b), len(h) - shift) - need + 1):
                    got = sum(h[k + shift] == b[k] for k in range(j, j + need))
                    if 5 * got >= 4 * need:
                        old = out.get((d, i), (0, need, 1 << 40))
                        out[d, i] = (max(old[0], got), need, min(old[2], j + shift))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 9, 13, 20, 45])))) for i in range(15)] + [(15, None), (16, ""), (None, " ".join(word() for _ in range(20)))]
    docs = [(d, " ".join(word() for _ in range(rng.choice([0, 5, 60, 300])))) for d in range(40)]
    for d, (i, item) in enumerate(items[:15]):
        w = item.split()
        every = 5 + d % 4
        leaked = [("zz" if k % every == 4 else x.upper()) for k, x in enumerate(w)]
        docs.append((100 + d, " ".join([word() for _ in range(10)] + leaked + ["end."])))
        docs.append((200 + d, " ".join(w[:14])))
    docs += [(300, None), (301, items[4][1]), (301, items[4][1]), (302, "tail " * 50_000 + items[3][1])]
    table = documents(spark, [t for _, t in docs], [d for d, _ in docs])
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(docs, items)
    for most in (decontaminate.MAX_BROADCAST, 5):
        assert {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.overlaps(table, tests, most).collect()} == want
        kept = decontaminate.decontaminated(table, tests, most)
        assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    long_items = {i for i, t in items[:15] if len(t.split()) >= 9}
    assert {(100 + i, i) for i in long_items} <= set(want)
    assert decontaminate.overlaps(table.limit(0), tests).count() == 0 and decontaminate.overlaps(table, tests.limit(0)).count() == 0


def test_every_accepted_pattern_has_a_seed(spark):
    """All patterns of up to three replaced words, in items of 1 to 16 words, against brute force."""
    items, docs, want = [], [], set()
    for n in range(1, 17):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        need = min(n, decontaminate.STRETCH)
        for count in range(min(n, 3) + 1):
            for gone in itertools.combinations(range(n), count):
                equal = [k not in gone for k in range(n)]
                if any(5 * sum(equal[j : j + need]) >= 4 * need for j in range(n - need + 1)):
                    want.add((len(docs), n))
                docs.append("a b " + " ".join(w if e else "zz" for w, e in zip(words, equal)) + " c d")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MAX_BROADCAST, 5):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(documents(spark, docs), tests, most).collect()} == want


def test_leaks_are_told_by_row(spark):
    """Null and repeated ids: each row is judged by its own text."""
    item = " ".join(f"q{k}" for k in range(20))
    texts, ids = ["clean " * 20, item, item + " x", "clean", item, None], [1, 1, None, None, 2, 2]
    tests = spark.createDataFrame([(1, item), (1, "other " * 13), (None, item)], "item_id long, text string")
    for most in (decontaminate.MAX_BROADCAST, 3):
        kept = decontaminate.decontaminated(documents(spark, texts, ids), tests, most).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("1", texts[0]), ("None", "clean")] and len(kept) == 3
        got = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(documents(spark, texts, ids), tests, most).collect()}
        assert got == {(d, i, 13) for d in (1, None, 2) for i in (1, None)}


def test_long_texts_take_linear_time(spark):
    """Every word of the text begins a hit; twice the words take about twice as long."""
    item = " ".join(["same"] * 20)
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    took = []
    for n in (20_000, 20_000, 80_000):
        began = time.time()
        assert decontaminate.overlaps(documents(spark, ["same " * n]), tests).count() == 1
        took.append(time.time() - began)
    assert took[2] < 3 + 8 * took[1]


def test_index_outlives_a_session(spark, tmp_path):
    """A second process opens the index by its path, without the first one's catalog."""
    at = f"file://{tmp_path}/index"
    first = exactdedup.without_copies(documents(spark, ["a", "B", "b"], [1, 2, 3]), exactdedup.DigestIndex(spark, at, 3))
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3]
    code = f"""
from pyspark.sql import SparkSession
from cubewright.llm import exactdedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/w").getOrCreate()
index = exactdedup.DigestIndex(spark, "{at}")
docs = spark.createDataFrame([(7, "A"), (8, "new"), (9, None)], "doc_id long, text string")
print("GOT", index.buckets, sorted(r["doc_id"] for r in exactdedup.without_copies(docs, index).collect()), index.read().count())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, timeout=170)
    assert "GOT 3 [8, 9] 4" in said.stdout, said.stderr[-2000:]
    again = exactdedup.DigestIndex(spark, at)
    assert again.read().count() == 4 and "Bucketed: true" in again.lookup(again.read())._jdf.queryExecution().executedPlan().toString()
    # The same batch once more: the same rows stay.
    assert sorted(r["doc_id"] for r in exactdedup.without_copies(documents(spark, ["a", "B", "b"], [1, 2, 3]), again).collect()) == [1, 3]
    again.drop()
    assert not (tmp_path / "index").exists()


def test_native_plans(spark):
    table = documents(spark, ["a b c d e f g h i j", "a"])
    tests = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for df in (exactdedup.exact_duplicates(table, exactdedup.new_index(spark)), decontaminate.overlaps(table, tests)):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "MapInArrow", "Cartesian"))
