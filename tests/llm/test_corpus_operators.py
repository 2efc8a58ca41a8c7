"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from brookwatch.llm import (bottomk, bpe, common, components, iblt, lang_id, license_scan, rlz, secrets, tiling, toxicity,
                            warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def make_docs(spark, texts, extra=""):
    """Documents with running ids; a pair gives the id too."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "en", "s", None) for r in rows], DOCS)
    return docs.withColumns({c.split()[0]: F.lit(7).cast(c.split()[1]) for c in extra.split(", ") if c})


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def prose(seed, n, vocabulary=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["w", "x", "Y"]) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- byte-level BPE -----------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)


def test_perfect_hash_is_minimal(codec):
    found = codec.perfect.find(codec.vocabulary)
    assert found.tolist() == list(range(len(codec.vocabulary)))


def test_bpe_equals_tiktoken_and_decodes(spark, codec, documents):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(codec.vocabulary)})
    odd = [None, "", " ", "  a  b", "a\n b\n\nc \n", "a\x1cb \x85c", "'ll don't I'VE", "ab" * 4000, "é́ ５ ½ 😀‍😀",
           "<|endoftext|> x", "　x  y", prose(1, 3000)]
    texts = odd + [r["text"] for r in documents.limit(60).collect()]
    got = by_id(bpe.round_trip(make_docs(spark, texts, ", ids int"), codec, with_ids=True))
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        assert got[i]["ids"] == ids
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(make_docs(spark, texts), codec)
    decoded = by_id(bpe.decode_documents(encoded, codec))
    assert [bytes(decoded[i]["decoded"]).decode() for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.round_trip(make_docs(spark, []), codec).count() == 0


# ---- WARC ---------------------------------------------------------------

def test_warc_round_trip(spark):
    pages = [(0, "http://a/", "same"), (1, "http://b/\r\nx", "same"), (2, None, None), (3, "u", ""), (4, "u", "é" * 70_000),
             (4, "u", "é" * 70_000), (5, "u", "a\r\n\r\nb"), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    got = warc.warc_round_trip(df).collect()
    assert len(got) == len(pages) and all(r["valid"] and r["error"] is None for r in got)
    rows = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for key, _, text in pages:
        if key is not None:
            raw = (text or "").encode()
            assert rows[key]["payload_bytes"] == len(raw)
            assert rows[key]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {
        0: ("response", None), 1: ("revisit", 0), 2: ("response", None), 3: ("revisit", 2), 4: ("response", None),
        5: ("response", None)}
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("response", None), ("revisit", 0)]
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.warc_round_trip(df.where("page_id < 2"), min_bytes=5).collect()} == {"response"}


def test_warc_payload_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", prose(i, 3000)) for i in range(6)], "page_id long, url string, html string")
    listed = warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w", archive_bytes=1 << 14)
    assert listed.agg(F.sum("records")).first()[0] == 6 and listed.count() > 1
    read = warc.read_warc(spark, listed)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.collect()} == {i: prose(i, 3000) for i in range(6)}
    path = listed.first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    assert data[:2] == b"\x1f\x8b" and zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")
    cut = tmp_path / "cut.warc.gz"
    cut.write_bytes(data[:-9])
    wrong = tmp_path / "wrong.warc.gz"
    wrong.write_bytes(warc.member(zlib.decompressobj(31).decompress(data).replace(b"w1", b"w2")))
    broken = spark.createDataFrame([(f"file://{p}",) for p in (cut, wrong)], "path string")
    bad = {r["archive"][-12:]: r for r in warc.read_warc(spark, broken).collect()}
    assert not any(r["valid"] for r in bad.values()) and any(r["error"] for r in bad.values())


# ---- substring dedup ----------------------------------------------------

def brute_repeats(texts, window):
    """Kept words of each (id, text)."""
    first = {}
    split = [(k, (t or "").encode().split()) for k, t in texts]
    for k, w in split:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), set()).add(k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and any(o is not None and o < k for o in first[tuple(w[i:i + window])]):
                gone.update(range(i, i + window))
        out.append((k, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    base = [prose(100 + i, 90) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [rng.choice(base) for _ in range(rng.randrange(4))] + [prose(i, rng.randrange(60))]
        words = " ".join(rng.sample(parts, len(parts))).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words) or 1):][:1] = ["edit"] if words else []
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"edit{i}"
        texts.append((i, " ".join(words)))
    texts += [(70, None), (71, ""), (72, base[0].replace(" ", "\t\n ")), (73, "a " * 500), (74, "a " * 400), (75, base[1]),
              (75, base[1]), (75, base[2]), (80, " ".join(base) * 20)]
    got = rlz.remove_repeats(make_docs(spark, texts, ", version long"))
    rows = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in got.collect())
    assert rows == sorted(brute_repeats(texts, 50))
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest() and
               r["n_removed"] == r["n_words"] - len(r["kept"].split()) for r in got.collect())
    assert any(r["factors"] for r in got.collect())
    assert rlz.remove_repeats(make_docs(spark, [])).count() == 0


def test_null_ids_are_no_references(spark):
    texts = [(None, prose(1, 80)), (3, prose(1, 80)), (None, prose(1, 80))]
    assert all(r["n_removed"] == 0 for r in rlz.remove_repeats(make_docs(spark, texts)).collect())


# ---- near duplicates ----------------------------------------------------

def brute_groups(texts, shingle, percent):
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(common.LOWER_ASCII))
        n = min(shingle, len(w))
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_groups_equal_brute_force(spark, shingle):
    rng = random.Random(shingle)
    texts = []
    for i in range(150):
        kind = i % 5
        words = prose(i % 12 if kind < 3 else 900 + i, rng.choice([1, 3, 5, 6, 9, 30, 200]) if kind == 4 else 40 + 20 * (i % 12)).split()
        for _ in range(rng.randrange(8) if kind < 3 else 0):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        texts.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    texts += [(200, None), (201, " \n"), (202, ""), (203, "one"), (204, "ONE"), (205, "a b"), (206, "A\tB"), (207, "b a"),
              (208, "a b c d e f"), (209, "a b c d e"), (210, prose(1, 9000)), (211, prose(1, 9000) + " end")]
    got = bottomk.near_duplicates(make_docs(spark, texts, ", component_id long"), shingle=shingle).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_groups(texts, shingle, 80)


def test_group_edge_cases(spark):
    assert bottomk.near_duplicates(make_docs(spark, [])).count() == 0
    same = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (9, "a b c d e f g"), (None, "x")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"])
                 for r in bottomk.near_duplicates(make_docs(spark, same)).collect())
    assert got == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# ---- decontamination ----------------------------------------------------

def test_tiling_finds_moved_passages(spark):
    item = prose(1, 40, 5000).split()
    moved = " ".join(item[20:] + ["between"] + item[:20])
    texts = [prose(2, 50, 5000) + " " + " ".join(item).upper() + "!", "x " + moved + " y", prose(3, 300, 5000), None, "",
             " ".join(item[:18]), " ".join(item[:22]), " ".join(w for x in item for w in (x, "gap"))]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, "too short item", 1), (9, None, 1)],
                                  "item_id long, text string, doc_id long")
    got = {r["doc_id"]: r for r in tiling.contaminated(make_docs(spark, texts, ", version int"), bench).collect()}
    assert set(got) == {0, 1, 6} and {r["item_id"] for r in got.values()} == {7}
    assert got[0]["coverage"] == 1.0 and got[1]["n_tiles"] == 2 and got[6]["n_covered"] == 22
    assert tiling.contaminated(make_docs(spark, texts), bench.limit(0)).count() == 0
    assert tiling.contaminated(make_docs(spark, []), bench).count() == 0


def test_items_that_repeat_themselves_are_tiled(spark):
    """Few distinct seeds, each of which covers several places of the item."""
    phrase, line = ["red", "green", "blue"] * 20, "one two three four five six".split()
    others = prose(4, 15, 5000).split()
    item = [w for k in range(3) for w in line + others[4 * k:4 * k + 4]]
    texts = [f"{prose(5, 30, 5000)} {' '.join(phrase)} {prose(6, 30, 5000)}",
             " ".join(f"{prose(k, 20, 5000)} {' '.join(line)}" for k in (7, 8, 9)), prose(3, 300, 5000), " ".join(line)]
    bench = spark.createDataFrame([(1, " ".join(phrase)), (2, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in tiling.contaminated(make_docs(spark, texts), bench).collect()}
    assert len(item) == 30 and got == {(0, 1): 60, (1, 2): 18}


def test_tiles_are_longest_first_and_apart():
    tiles = tiling.Tiling("a b c d e f g h".split(), ["a b c d e x d e f g h".split()], 3).mark()
    assert tiles == [(0, 0, 5), (5, 8, 3)]
    assert tiling.Tiling(["a"] * 9, [["a"] * 5, ["a"] * 4], 2).mark() == [(0, 0, 5), (5, 6, 4)]


# ---- secrets ------------------------------------------------------------

def brute_secrets(text):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(x for *_, x in sorted(out))


def test_base_findings_equal_brute_force(spark, documents):
    texts = ["token = short", "toKen:token:abcdefgh1", "password='AKIA" + "A" * 20 + "'", "ſecret=abcdefgh", "toKen=abcdefgh",
             "API_KEY : \"" + "ab12" * 10 + "\"", "AKIAAKIA" + "B" * 12 + " AKIA123", "é😀 secret= " + "0f" * 16, None, "",
             "token=" * 3000, "f" * 50_000] + [r["text"] for r in documents.collect()]
    got = by_id(secrets.find_secrets(make_docs(spark, texts, ", spans string")))
    for i, t in enumerate(texts):
        known = brute_secrets(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(known.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.STRONG] == [known.count(k + ":") for k in secrets.STRONG]
        assert set(filter(None, known.split(","))) <= set(got[i]["spans"].split(","))
    assert secrets.find_secrets(make_docs(spark, [])).count() == 0


def test_weak_parts_count_only_together():
    word, user, where = "Zq8LmT2xWv9RkB4nHc7D", "client_id = billing-app", "https://vault.example.com/v1"
    kinds = lambda t: [k for *_, k in secrets.scan(t)[1]]
    assert kinds(word) == kinds(user) == kinds(where) == kinds(f"{word} {where}") == kinds(f"{user} {where}") == []
    assert kinds(f"{user} {word} {where}") == ["weak_id", "weak_secret", "endpoint"]
    assert kinds(f"{user}\n\n{word} {where}") == []  # another scope
    assert kinds(f"{user}{' x' * 400} {word}") == []  # out of reach
    assert kinds(f"AKIA{'A' * 16} {word}") == ["access", "weak_secret"]
    text = f"{user} {word} {where}"
    assert secrets.mask(text, secrets.scan(text)[1]) == "client_id = [secret] [secret] [secret]"


@pytest.mark.parametrize("word", ["q7w2k9zx4m1v8t3bd6", "JBSWY3DPEHPK3PXPQ4TN7ZLA", "3f2b8c1e-7d46-4a09-b5e3-91c0d8f2a67b",
                                  "kqwzjxvbnmtrplshgd", "KqWzJxVbNmTrPlShGd"])
def test_weak_secrets_of_any_shape(word):
    """Lower case with digits, base32, a dashed hex key, letters alone."""
    user, where = "client_id = billing-app", "https://vault.example.com/v1"
    kinds = lambda t: [k for *_, k in secrets.scan(t)[1]]
    assert kinds(f"{user} {word} {where}") == ["weak_id", "weak_secret", "endpoint"]
    assert kinds(f"{word} {where}") == kinds(f"{user}\n\n{word} {where}") == kinds(f"{user} {'a' * 20}") == []
    assert secrets.mask(f"{user} {word}", secrets.scan(f"{user} {word}")[1]) == "client_id = [secret] [secret]"


def test_identifiers_and_paths_are_no_secrets():
    kinds = lambda t: [k for *_, k in secrets.scan(t)[1]]
    assert kinds("user=bob client_id=billing-application") == []
    assert kinds("account_id = 3f2b8c1e-7d46-4a09-b5e3-91c0d8f2a67b user: bob") == []
    assert kinds("user: bob https://example.com/documentation/getting-started") == []
    assert kinds("user: bob https://example.com/hooks/q7w2k9zx4m1v8t3bd6") == ["weak_id", "endpoint", "weak_secret"]


# ---- toxicity -----------------------------------------------------------

def test_machine_learns_an_interaction(spark):
    """Neither word alone is toxic, both together are."""
    rng, texts, labels = random.Random(3), [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = prose(i, 6, 3000).split() + ["grumblefoot"] * insult + ["hillfolk"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(insult and group)))
    docs = make_docs(spark, [*texts, None, ""], ", score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, known)))
    for i, label in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i]["predicted"], label) for i, label in labels if got[i]["held_out"]]
    assert sum(p == label for p, label in held) >= 0.97 * len(held)
    assert got[1600]["score"] == got[1601]["score"] and 0 <= got[1600]["score"] <= 1
    none = toxicity.train(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_machine_learns_words_without_an_effect_alone(spark):
    """Each of two words is as frequent in toxic as in clean rows; both or neither is toxic."""
    rng, texts, labels = random.Random(3), [], []
    for i in range(1600):
        insult, group = i // 2 % 2, i % 2
        words = [rng.choice("wxy") + "".join(rng.choices("abcdefghij", k=3)) for _ in range(6)]
        words += ["grumblefoot"] * insult + ["hillfolk"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(insult == group)))
    docs, known = make_docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, known)))
    held = [(got[i]["predicted"], label) for i, label in labels if got[i]["held_out"]]
    assert sum(p == label for p, label in held) >= 0.97 * len(held)
    assert sum(p for p, label in held if label) >= 0.95 * sum(label for _, label in held)


# ---- fingerprints -------------------------------------------------------

def brute_paragraphs(text):
    return set(re.findall(iblt.PARAGRAPH, text))


def test_fingerprints_equal_brute_force(spark):
    texts = [(3 * i, ". ".join(prose(50 * i + j, 9) for j in range(i % 17)) + "\n" + prose(i, 4)) for i in range(40)]
    texts += [(200, None), (201, ""), (202, "😀é" * 90), (203, texts[5][1]), (204, texts[5][1]), (204, texts[5][1])]
    got = by_id(iblt.document_fingerprints(make_docs(spark, texts, ", near_next double, version int")))
    rows = sorted({k: t or "" for k, t in texts}.items())
    assert sorted(got) == [k for k, _ in rows]

    def alike(a, b):
        a, b = brute_paragraphs(a), brute_paragraphs(b)
        return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for (k, t), (_, follow) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        edited = t[:len(t) - cut] + follow[:cut]
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["near_edited"] == pytest.approx(alike(t, edited))
        assert got[k]["near_next"] == pytest.approx(alike(t, follow))
    assert got[203]["fingerprint"] == got[204]["fingerprint"] == got[15]["fingerprint"]
    assert iblt.document_fingerprints(make_docs(spark, [])).count() == 0
    alone = iblt.document_fingerprints(make_docs(spark, [(5, "abcdefgh"), (None, "x")])).collect()
    assert [(r["doc_id"], r["edited_sha256"]) for r in alone] == [(5, hashlib.sha256(b"abcdefab").hexdigest())]


# ---- language -----------------------------------------------------------

def test_language_of_documents_and_weak_pages(spark, documents):
    model = lang_id.train(documents)
    held = [r for r in documents.collect() if len(r["text"]) > 200]
    right = 0
    for r in held:
        logs = model.evidence(r["text"])
        right += model.languages[logs.index(max(logs))] == r["lang"]
    assert right >= 0.9 * len(held)
    french = next(r["text"] for r in held if r["lang"] == "fr")
    german = next(r["text"] for r in held if r["lang"] == "de")
    page = lambda lang, text: f"<html lang='{lang}'><p>{text}</p></html>"
    rows = [(i, f"http://h{i % 3}.example.fr/x", page("fr", french)) for i in range(30)]
    rows += [(30 + i, "http://g.example.de/x", page("de", german)) for i in range(30)]
    rows += [(100, "http://h0.example.fr/y", page("fr", "")), (101, "http://g.example.de/", ""), (102, None, None),
             (103, "http://h0.example.fr/z", page("fr", german)), (102, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = lang_id.identify(df, model).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and {got[i]["lang"] for i in range(30)} == {"fr"}
    assert got[100]["lang"] == "fr" and got[101]["lang"] == "de" and got[103]["lang"] == "de"
    assert all(0 <= r["probability"] <= 1 for r in found)
    assert lang_id.identify(df.limit(0), model).count() == 0
    nothing = lang_id.train(documents.limit(0))
    assert {r["lang"] for r in lang_id.identify(df, nothing).collect()} == {None}


# ---- licenses -----------------------------------------------------------

def test_rising_is_a_longest_subsequence():
    rng = random.Random(1)
    for n in range(9):
        seconds = rng.sample(range(20), n)
        pairs = list(enumerate(seconds))
        best = max((sum(1 for _ in s) for s in _rising_subsets(seconds)), default=0)
        got = license_scan.rising(pairs)
        assert len(got) == best and got == sorted(got) and [b for _, b in got] == sorted(b for _, b in got)


def _rising_subsets(seconds):
    for mask in range(1 << len(seconds)):
        chosen = [x for i, x in enumerate(seconds) if mask >> i & 1]
        if chosen == sorted(chosen):
            yield chosen


def test_licenses_found_whole_changed_and_repeated(spark):
    mit = license_scan.TEMPLATES["mit-text"]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    note = "Released under the MIT License."
    texts = [f"{prose(1, 50)} {note} {prose(2, 50)} {note}", mit, changed, "license under", None, "", prose(3, 20_000),
             license_scan.TEMPLATES["apache-2.0-header"]]
    got = license_scan.find_licenses(make_docs(spark, texts, ", license string")).collect()
    found = sorted((r["doc_id"], r["license"]) for r in got)
    assert found == [(0, "mit"), (0, "mit"), (1, "mit-text"), (2, "mit-text"), (7, "apache-2.0-header")]
    assert {r["coverage"] for r in got if r["doc_id"] in (0, 1, 7)} == {1.0}
    assert license_scan.find_licenses(make_docs(spark, [])).count() == 0


def test_edited_notices_down_to_the_threshold():
    """Changed words that stand once in the template cost a kind each, yet only a word of its coverage."""
    known = [license_scan.Template(n, t) for n, t in sorted(license_scan.TEMPLATES.items())]
    for name, n, part in (("mit-grant", 12, 0.86), ("apache-2.0-header", 12, 0.85), ("bsd-2-clause-conditions", 8, 0.88)):
        notice = license_scan.words(license_scan.TEMPLATES[name])
        single = [i for i, w in enumerate(notice) if notice.count(w) == 1]
        for i in single[len(single) // n // 2::len(single) // n][:n]:
            notice[i] = f"changed{i}"
        (got,) = license_scan.scan(f"{prose(1, 40)} {' '.join(notice)} {prose(2, 40)}", known, 0.8)
        assert got["license"] == name and part <= got["coverage"] < part + 0.01


COMMON = ("the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were all "
          "we there been their one if so no when what more out up who would do can will has about only other new some could time "
          "these may then first any our over such into like its than also after used many most must through before same right "
          "well way even because each use work part made where both between under system program data file code version software "
          "computer network user source license copy terms provided without").split()


def ordinary_prose(seed, n):
    return " ".join(random.Random(seed).choices(COMMON, weights=[1 / (i + 2) for i in range(len(COMMON))], k=n))


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_a_notice_within_ordinary_prose_is_found_whole_by_its_own_name(name):
    known = [license_scan.Template(n, t) for n, t in sorted(license_scan.TEMPLATES.items())]
    size = len(license_scan.words(license_scan.TEMPLATES[name]))
    for i, before in enumerate((0, 59, 325, 591, 650)):
        text = f"{ordinary_prose(i, before)} {license_scan.TEMPLATES[name]} {ordinary_prose(i + 50, 650 - before)}"
        (got,) = license_scan.scan(text, known, 0.8)
        assert got == {"license": name, "coverage": 1.0, "start": before, "end": before + size}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_edited_notices_in_prose_equal_the_best_alignment_of_all_windows():
    """Coverage comes within a word or two of the best of all windows, found by brute force."""
    rng, letters = random.Random(9), [f"w{i}" for i in range(40)]
    for case in range(25):
        template = rng.choices(letters, k=30)
        notice = [w for w in template if rng.random() > 0.06]
        text = [*rng.choices(letters, k=rng.randrange(60)), *notice, *rng.choices(letters, k=rng.randrange(60))]
        best = max(longest_common(text[i:i + 60], template) for i in range(len(text)))
        held = license_scan.Template("own", " ".join(template))
        got = license_scan.scan(" ".join(text), [held], 0.7)
        assert got and max(g["coverage"] for g in got) * 30 >= best - 3 and max(g["coverage"] for g in got) * 30 <= best + 1e-9


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_is_found_under_its_name(name):
    known = [license_scan.Template(n, t) for n, t in sorted(license_scan.TEMPLATES.items())]
    text = license_scan.TEMPLATES[name]
    (got,) = license_scan.scan(f"{prose(1, 30)} {text} {prose(2, 30)}", known, 0.8)
    assert (got["license"], got["coverage"], got["start"]) == (name, 1.0, 30)


def test_common_licenses_are_known_whole():
    text = license_scan.TEMPLATES
    assert text["mit-text"].endswith("DEALINGS IN THE SOFTWARE.") and text["bsd-2-clause"].endswith("POSSIBILITY OF SUCH DAMAGE.")
    assert {"bsd-3-clause", "mpl-2.0-header", "lgpl-2.1-header", "gpl-2.0-header"} <= set(text)
