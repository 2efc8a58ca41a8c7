"""Spelling groups, hard negatives and similarity hashes against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from brookwatch.llm import hard_negatives, simhash, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def make_docs(spark, texts, extra=""):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "en", "s", None) for r in rows], DOCS)
    return docs.withColumns({c.split()[0]: F.lit(7).cast(c.split()[1]) for c in extra.split(", ") if c})


# ---- spelling -----------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped_by_hand(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def grouped(words, **kw):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_spellings(words, **kw).collect()}


def variants(seed, roots, n):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        w = list(rng.choice(roots))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "ab"[:1]])
        if w:
            out["".join(w)] = rng.choice([2, 3, 30, 31, 400, 5000])
    return out


@pytest.mark.parametrize("limit", [4096, 8])
def test_spelling_groups_equal_brute_force_also_in_split_blocks(spark, limit):
    counts = variants(5, ["anderson", "andersonville", "aaaaaaaa", "abababab", "éclairage", "b"], 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert grouped(words, limit=limit) == grouped_by_hand(counts)


def test_word_counts_plant_misspellings_and_count_rows_again(spark):
    texts = [None, "", "Étoiles ÉTOILES étoiles", "straße÷straßen x" * 50, "Anderson, ANDERSON; anderson's andersen " * 9,
             (7, "Anderson anderson repeated"), (7, "Anderson anderson repeated"), (None, "Anderson repeated"), "word" * 40_000 + " word"]
    docs = make_docs(spark, texts, "word string, n int")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        runs, run = [], ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                runs.append(run.translate(low))
                run = ""
        for r in runs:
            h = zlib.crc32(f"{'' if key is None else key}:{r}".encode())
            if h % 3 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            counts[r] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, spoilt=3).collect()}
    assert got == want


def test_spelling_ties_chains_and_empty_tables(spark):
    words = spark.createDataFrame([("abcdefg", 2000), ("abcdefgh", 200), ("abcdefghi", 20), ("abcdefghij", 2), ("zzzzzzz", 5)],
                                  "word string, n long")
    got = grouped(words)
    assert got["abcdefghij"][:2] == ("abcdefghi", "abcdefg")
    assert got["abcdefgh"] == ("abcdefg", "abcdefg", 200, 2, 2000)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 5, 0, None)
    assert grouped(words.limit(0)) == {}
    assert grouped(spark.createDataFrame([("abcdefg", 2), ("abcdefx", 20), ("abcdefa", 20)], "word string, n long"))["abcdefg"] == (
        "abcdefa", "abcdefa", 2, 2, 20)


# ---- hard negatives -----------------------------------------------------

def mined_by_hand(rows, every=100):
    kept = {}
    for key, vector, label in rows:
        if key is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = (label, [math.floor(256 * x) for x in vector])
        kept[key] = min(kept.get(key, whole), whole)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, u, strict=False)) for b, (_, u) in kept.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if kept[b][0] == label][:5]:
            fits = [b for b in order if kept[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out |= {(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(fits)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, planes string, rank int"


def mined(spark, rows, **kw):
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    return {tuple(r) for r in hard_negatives.mine(vectors, **kw).collect()}


@pytest.mark.parametrize("block", [(1024, 8192), (3, 7)])
def test_hard_negatives_equal_brute_force_also_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", block[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATES", block[1])
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(rng.choice([11, 12]))], i % 3) for i in range(120)]
    rows += [(None, [1.0], 1), (200, None, 1), (201, [1.0, None], 1), (202, [math.nan], 1), (203, [math.inf], 0), (204, [1.0], None),
             (205, [], 1), rows[5], (6, rows[9][1], 0)]
    want = mined_by_hand(rows, 10)
    assert len(want) > 100 and mined(spark, rows, every=10) == want


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    rows = [(0, [3e5, -2e5], 1), (1, [2e5, 1e5], 1), (2, [1.0, 2.0], 2), (3, [9e4, 1e4], 2), (4, [1e5, -3e5], 2)]
    assert mined(spark, rows) == mined_by_hand(rows) != set()
    assert mined(spark, [(0, [1e30, -1e30], 1), (1, [1e30, 1.0], 1), (2, [1.0, 1e30], 2)]) is not None
    assert mined(spark, []) == set() == mined(spark, [(0, [1.0], 1)]) == mined(spark, [(0, [1.0], 1), (1, [1.0], 2)])


def test_a_score_is_the_sum_of_looked_up_subsets(spark):
    rng = hard_negatives.np.random.default_rng(1)
    anchors, rows = rng.integers(-300, 300, (5, 24)), rng.integers(-300, 300, (40, 24))
    got = hard_negatives.scores(hard_negatives.subset_sums(anchors, hard_negatives.np.int32), hard_negatives.packed_planes(rows, 10))
    assert (got == rows @ anchors.T).all()


# ---- similarity hashes --------------------------------------------------

def fingerprint_by_hand(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(keys, values, radius=2):
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            parent[top(j)] = top(i)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(top(i), []).append(k)
    return [min((k for k in least[top(i)] if k is not None), default=None) for i in range(len(values))]


def test_simhash_groups_equal_brute_force(spark):
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = [None, "", " \t", "One", "one", "one two", "\x1cA b\x85 c", *base, *(t + " More words" for t in base[:20]),
             *(t.upper() for t in base[:9]), "A b c d " * 30_000, base[0] + " x" * 70_000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "other text of id six"), (None, base[1]), (None, "alone and without id")]
    got = simhash.near_duplicates(make_docs(spark, rows, "bits string, component string")).collect()
    values = [fingerprint_by_hand(t) for _, t in rows]
    groups = groups_by_hand([k for k, _ in rows], values)
    want = Counter((k, f"{v:016x}", g) for (k, _), v, g in zip(rows, values, groups, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert sum(g != k for (k, _), g in zip(rows, groups, strict=True)) > 10


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_carry_save_counters_equal_bit_counts(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for _ in range(150)]
    places = list(range(64))
    planes, every = simhash.bit_planes(values, places), (1 << len(values)) - 1
    for v in values[:40]:
        got = simhash.within(planes, [v >> b & 1 for b in places], every, 0, radius)
        assert got == sum(1 << j for j, u in enumerate(values) if (u ^ v).bit_count() <= radius)


@pytest.mark.parametrize("limit", [4096, 4])
def test_blocks_lose_no_link(spark, limit):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)] + [rng.getrandbits(16) for _ in range(40)]
    values = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(500)})
    classes = spark.createDataFrame([(simhash.signed(v),) for v in values], "bits long")
    links = [(r["a"] & simhash.ALL, r["b"] & simhash.ALL) for r in simhash.near_classes(classes, 2, limit).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    place = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[top(place[a])] = top(place[b])
    want = groups_by_hand(values, values)
    joined = {}
    for v in values:
        joined.setdefault(top(place[v]), []).append(v)
    assert [min(joined[top(place[v])]) for v in values] == want


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(make_docs(spark, [])).collect() == []
