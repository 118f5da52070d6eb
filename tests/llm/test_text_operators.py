import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from aeonframe.llm import baseline_jpeg, bitplanes, compact_windows, covering_simhash, decontamination, license_scan, near_copies, prefix_bpe, quality
from aeonframe.llm.components import components

WORDS = "the of and to in a is that it was for on are as with his they at be this have from or one had by".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ly", ","]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, and a column whose name an operator uses itself."""
    rng = random.Random(3)
    rows = [(1, None, "x"), (None, "no id", "y"), (2, "", None), (3, " \n\t ", "z"), (4, "one", "q"), (4, "one", "q"), (5, prose(rng, 30_000), "long"), (6, "é" * 500 + " 中文  🙂 x \n y", "u"), (7, "MIT License, the apache license", "l")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


# -- 2: token files -----------------------------------------------------------------------------------------
def expected_ids(rows):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in rows]


def test_token_files(odd, empty):
    path = P.path("byte_bpe_50k.json")
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(bitplanes.token_files(odd, path).collect(), key=lambda r: r["start"])
    at = 0
    for row, ids, g in zip(rows, expected_ids([r["text"] for r in rows]), got, strict=True):
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert bitplanes.token_files(empty, path).count() == 0


def test_special_tokens_are_what_the_library_makes_of_them(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", " <|endoftext|><|endoftext|>  a<|endoftext|>b ", "a <|endo ftext|>", "é <|endoftext|>\n <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in bitplanes.token_files(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(expected_ids(texts))} and got[0][0] == 5


@pytest.mark.parametrize("bits", [False, True])
def test_segments(bits):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 20, 1000).astype(np.uint32)
    s = bitplanes.Segment(bitplanes.encode_segment(ids, [5, None, 7], [400, 0, 600], bits, block=64))
    assert s.doc_ids == [5, None, 7] and s.lengths.tolist() == [400, 0, 600] and (s.ids() == ids).all()
    assert (s.read_block(7) == ids[448:512]).all()
    assert bitplanes.Segment(bitplanes.encode_segment(ids[:0], [], [], bits)).ids().size == 0
    with pytest.raises(ValueError):
        bitplanes.Segment(b"x" * 40)


# -- 6: prefix BPE ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoders():
    ranks = prefix_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return prefix_bpe.PrefixBpe(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_bpe_digests(odd, empty, encoders):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = collections.Counter(tuple(r) for r in prefix_bpe.bpe_digests(odd, path, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for r in odd.collect():
        ids = encoders[1].encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())] += 1
    assert got == want and prefix_bpe.bpe_digests(empty, path, P.PATTERN).count() == 0
    ids = prefix_bpe.bpe_ids(odd.where("doc_id = 6"), path, P.PATTERN).first()["ids"]
    assert ids == encoders[1].encode_ordinary(odd.where("doc_id = 6").first()["text"])


def test_edits_encode_as_the_whole(encoders):
    bpe, ours = encoders
    rng, letters = random.Random(4), "ab eé's'tll re\n\t 12中🙂.!,"
    te = prefix_bpe.TextEncoder(bpe, P.PATTERN)
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for _ in range(500):
        text, new = make(40), make(5)
        b = rng.randrange(len(text) + 1)
        e = rng.randrange(b, len(text) + 1)
        assert [i for _, x in te.edit(te.pieces(text), b, e, new) for i in x] == ours.encode_ordinary(text[:b] + new + text[e:])
    state = prefix_bpe.PrefixState(bpe)
    word = "internationalization"
    for k, c in enumerate(word):
        state.append(c.encode())
        assert state.ids() == ours.encode_ordinary(word[: k + 1])
    state.replace(5, 8, b"zz")
    assert state.ids() == ours.encode_ordinary(word[:5] + "zz" + word[8:])


# -- 1: quality ---------------------------------------------------------------------------------------------

def test_features_of_many_tokens_at_once():
    tokens = ["a", "word", "\u00e9t\u00e9", "\u65e5\u672c\u8a9e", "\U0001f600x\U0001f600", "y" * 300, "\u0000", "<>"]
    hashes, buckets, places = quality.all_features(tokens)
    for k, token in enumerate(tokens):
        assert sorted(buckets[places == k].tolist()) == sorted(quality.features(token))
        assert hashes[k] == quality.word_hash(token)


def test_classifier_scores_are_the_plain_sum_over_whole_texts(spark):
    odds = np.random.default_rng(3).normal(0, 3, quality.BUCKETS).astype(np.float32)
    texts = ["", " \t ", "a", "a a a b", "\u00e9t\u00e9 x", "one two " * 150_000, "z" * 300_000, None, "one  two\nthree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.Model(odds, 0.3, -0.2)).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        hashes = [quality.word_hash(w) for w in words]
        total, n = 0.0, 0
        for w in words:
            own = quality.features(w)
            total, n = total + sum(odds[own].tolist()), n + len(own)
        for a, b in zip(hashes, hashes[1:]):
            mixed = (a * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93) % 2**64 >> 46
            own = [mixed, quality.AGAIN] if a == b else [mixed]
            total, n = total + sum(odds[own].tolist()), n + len(own)
        z = 0.3 + (total - 0.2 * quality.PRIOR) / (n + quality.PRIOR)
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9, k


def test_quality_learns_and_leaves_the_fold_alone(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = prose(rng, 60)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        # the held-out fold is mislabelled: a model that looked at it would fail below
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(good) if not held else int(not good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in got) >= 235 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_edges(spark, odd, empty):
    marks = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (7, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.classify(odd, marks, ("doc_id", "key")).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty, marks).count() == 0
    assert {round(r["score"], 6) for r in quality.classify(odd, marks.limit(0)).collect()} == {0.5}
    folds = {r["doc_id"]: r["h"] for r in odd.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h in folds.items())


# -- 5: SimHash ---------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair_within_the_radius():
    tables = covering_simhash.masks()
    rng = random.Random(1)
    assert len(tables) == 15
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not d & m for m in tables)


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(2)
    base = [prose(rng, 300) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t.replace("the", "The", 1)) for k, t in enumerate(base)] + [(200 + k, t + " end") for k, t in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {i: (f, rows[c][0]) for (i, _), f, c in zip(rows, fps, classes(fps))}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in covering_simhash.near_duplicates(docs).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(rows)
    assert {r["doc_id"] for r in covering_simhash.representatives(docs).collect()} == {c for _, c in got.values()}
    edge = covering_simhash.near_duplicates(odd).collect()
    assert len(edge) == 9 and {r["component_id"] for r in edge if r["fp"] == 0} == {1}
    kept = covering_simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id in (1, 2, 3)").count() == 1
    assert covering_simhash.near_duplicates(empty).count() == 0


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(1)
    center = 12345678901
    fps = sorted({center ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 9), replace=False)) for _ in range(900)})
    want = classes(fps)
    assert len(fps) > covering_simhash.DIRECT
    pairs = covering_simhash._forest(np.array(fps, np.uint64), 3)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want
    monkeypatch.setattr(covering_simhash, "IN_TASK", 50)
    found = components(covering_simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    sizes = collections.Counter(want)
    assert len(found) == len(fps) - len(sizes) and len({r["root"] for r in found}) == sum(n > 1 for n in sizes.values())


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 1000 for k in range(1001, 1200)}}


# -- the near-duplicate stage -------------------------------------------------------------------------------
def jaccard(a, b):
    x, y = (set(zip(*[t.lower().split()[k:] for k in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_tables_cover_every_pair_within_three_coordinates():
    tables = near_copies.blocks()
    assert len(tables) == 14 and all(len(t) == 4 for t in tables)
    assert all(any(not set(t) & {a, b, c} for t in tables) for a in range(8) for b in range(a) for c in range(b))


def test_near_copies_against_brute_force(spark, odd, empty):
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            own = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [texts[0].upper(), texts[3]]
    good = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first = {r["doc"]: r["first_doc"] for r in near_copies.classes(docs).collect()}
    assert set(first) == set(range(len(texts)))
    assert sum(first[a] == first[b] for a, b in good) >= 0.97 * len(good) > 20
    root = list(range(len(texts)))
    for a, b in sorted(good):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    assert all(root[k] == root[f] for k, f in first.items())  # nothing beyond what brute force connects
    assert {r["doc_id"] for r in near_copies.representatives(docs).collect()} == set(first.values())
    kept = near_copies.representatives(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert near_copies.representatives(empty).count() == 0 and near_copies.representatives(empty).columns == empty.columns


def test_large_groups_are_compared_with_neighbours(monkeypatch):
    monkeypatch.setattr(compact_windows, "IN_GROUP", 50)
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 1 << 62, (2, 200))
    sketch[:, 120:] = sketch[:, 40:120] ^ (1 << rng.integers(0, 40, 80))
    rows = np.concatenate([np.zeros((1, 200), np.int64), sketch, [np.arange(200)], [np.arange(200) + 7], np.zeros((1, 200), np.int64)]).astype(np.int64)
    found = {tuple(x) for x in compact_windows._sources(rows, 2, 60, 42).T.tolist()}
    assert sum((k - 80, k) in found for k in range(120, 200)) >= 78 and all(a < b for a, b in found)


def test_near_copies_beyond_the_best_of_a_bucket(spark):
    """A text whose best partners by sketch fail is still compared with the rest of its buckets."""
    rng, texts = random.Random(41), []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for edits in [4] + [5] * 80 + [0]:
            own = list(base)
            for k in range(edits):
                own[10 + 20 * k + rng.randrange(10)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "sha": [str(k) for k in range(len(texts))], "text": texts})
    rows = pa.Table.from_batches(near_copies._sketches_of(iter([batch]))).to_pydict()
    sketch = np.array([[0] * len(texts), rows["ahead"], rows["behind"]], np.int64)
    buckets = collections.defaultdict(list)
    for k, keys in enumerate(rows["keys"]):
        for key in keys:
            buckets[key].append(k)
    tried = {(a, b) for g in buckets.values() for b in g for a in g if a < b and compact_windows._agreement(sketch, np.array([a]), np.array([b]))[0] >= near_copies.LEAST_AGREE}
    root = list(range(len(texts)))
    for a, b in sorted(tried):
        if jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc"]: r["first_doc"] for r in near_copies.classes(docs).collect()} == dict(enumerate(root))


def test_a_bucket_leaves_its_rows_not_its_pairs():
    """Of one bucket at most a row for each text and a link for each group that is joined come out; the groups are those of all pairs."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)) for _ in range(3)]
    sets = [base[60 * (k // 2 % 3) :][: 60 + k // 6] for base in sets for k in range(60)]
    n = len(sets)
    rows = np.stack([np.zeros(n), np.zeros(n), np.zeros(n), np.arange(n), np.arange(n) + 500, np.arange(n) // 2 + 500]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["gkey", "ahead", "behind", "doc", "tk", "root"])
    assert sum(b.num_rows for b in near_copies._crossing(iter([batch.slice(0, 70), batch.slice(70)]))) <= n
    links = list(near_copies.joining(rows, sets))
    assert 0 < len(links) < len(set(rows[5].tolist()))

    def classes(pairs):
        root = rows[5].copy()
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}

    alike = [(a, b) for b in range(n) for a in range(b) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    assert classes(links) == classes(alike) and 3 < len(classes(links)) < n // 2


# -- 8: compact windows -------------------------------------------------------------------------------------
def test_windows_against_the_definition():
    rng = random.Random(5)
    for _ in range(400):
        n, least = rng.randrange(60), rng.randrange(1, 12)
        h = np.array([rng.randrange(rng.choice([5, 1000])) for _ in range(n)], np.uint64)
        want = set()

        def cut(a, b):
            if b - a + 1 >= least:
                c = min(range(a, b + 1), key=lambda i: (h[i], i))
                want.add((a, c, b))
                cut(a, c - 1)
                cut(c + 1, b)

        cut(0, n - 1)
        assert set(map(tuple, compact_windows.compact_windows(h, least).T.tolist())) == want


def test_links_of_a_group_do_not_depend_on_its_size(monkeypatch):
    """Nothing switches at IN_GROUP: each sketch is compared with all earlier ones, whatever block it falls in."""
    rng = np.random.default_rng(8)
    n = 300
    sketch = rng.integers(-(1 << 62), 1 << 62, (2, n))
    sketch[:, 250:] = sketch[:, :50]
    sketch[0, 250:] ^= rng.integers(0, 1 << 9, 50) << 3  # a few fields apart, among many that lie between
    text = np.arange(n) + 7
    text[100:110] = text[90:100]
    sketch[:, 105:110] = sketch[:, 95:100]  # a text's second place with a sketch
    sketch[:, 60:65] = sketch[:, 95:100] ^ 1
    rows = np.stack([np.zeros(n, np.int64), *sketch, np.arange(n), text, np.zeros(n, np.int64)]).astype(np.int64)
    found = []
    for size in (7, 64, 1 << 13):
        monkeypatch.setattr(compact_windows, "IN_GROUP", size)
        found.append({tuple(x) for x in compact_windows._sources(rows, 2, 60, 42).T.tolist()})
    assert found[0] == found[1] == found[2]
    apart = lambda a, b: sum((int(x) ^ int(y)) >> 2 * k & 3 != 0 for x, y in zip(sketch[:, a], sketch[:, b]) for k in range(32))
    for b in range(n):
        good = sorted((apart(a, b), a) for a in range(b) if text[a] != text[b] and apart(a, b) <= 22)
        want = good[:1] if good and good[0][0] <= 4 else good[:2]
        assert {a for a, c in found[0] if c == b} == {a for _, a in want}, b


def test_windows_of_a_repetitive_text_are_one_row():
    rng = random.Random(17)
    texts = [f"{prose(rng, 60)} {'big apple ' * 300}{prose(rng, 60)}" for _ in range(30)]
    docs = np.arange(30, dtype=np.int64)
    rows = compact_windows._windows(docs, docs, texts)
    assert rows.shape[1] < 30 * 120
    batch = compact_windows._collapsed(rows)
    rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
    rows = rows[:, np.lexsort((rows[5], rows[4], rows[3], rows[0]))]
    first, low, high = compact_windows._ends(rows[5])
    for k in range(1, 30):  # the whole stretch of 600 words is in the regions that are linked to earlier texts
        pairs = [b for a, b in compact_windows._sources(rows).T.tolist() if rows[4, b] == k > rows[4, a]]
        assert min(low[pairs]) <= 60 and max(high[pairs]) >= 60 + 600 - 5
    # runs longer than a span's bits are cut
    long = compact_windows._windows(docs[:1], docs[:1], ["big apple " * 40_000])
    first, low, high = compact_windows._ends(long[5])
    assert long.shape[1] < 400 and min(low) == 0 and max(high) >= 80_000 - 6 and (low <= first).all()


def test_repeats_and_their_removal(spark, odd, empty):
    rng = random.Random(6)
    passage, other = prose(rng, 60).split(), prose(rng, 80).split()
    changed = [*other[:40], "changed", *other[41:]]
    body = lambda: prose(rng, 90).split()
    texts = {1: [*body(), *passage, *body()], 2: [*body(), *passage], 3: [*passage, *body()], 4: body(), 5: [*body(), *other], 6: [*changed, *body()], 7: body() * 2}
    texts[8] = texts[4]
    docs = spark.createDataFrame([(k, " ".join(t), k) for k, t in texts.items()], "doc_id long, text string, n_chars long")
    found = compact_windows.repeats(docs).collect()
    assert {r["doc_id"] for r in found} == {2, 3, 6, 8}
    spans = {(r["doc_id"], r["source_doc_id"]): (r["start_word"], r["end_word"]) for r in found}
    assert spans[8, 4] == (0, 90) and spans[6, 5] == (0, 80)
    left = {r["doc_id"]: r for r in compact_windows.without_repeats(docs).collect()}
    assert set(left) == {1, 2, 3, 4, 5, 6, 7} and all(left[k]["text"] == " ".join(texts[k]) for k in (1, 4, 5, 7))
    assert left[2]["text"] == " ".join(texts[2][:90]) and left[3]["text"] == " ".join(texts[3][60:]) and left[3]["n_chars"] == len(left[3]["text"])
    assert compact_windows.without_repeats(odd).count() == 9 and compact_windows.repeats(odd).count() == 0
    assert compact_windows.repeats(empty).count() == 0 and compact_windows.without_repeats(empty).columns == empty.columns


def test_every_exact_repeat_is_found(spark):
    rng = random.Random(9)
    parts = [prose(rng, 50).split() for _ in range(12)]
    texts = {k: [*prose(rng, rng.randrange(70)).split(), *parts[k % 12], *prose(rng, rng.randrange(70)).split()] for k in range(48)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in compact_windows.repeats(docs).collect()} == set(range(12, 48))


def test_groups_of_near_copies(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    line, texts = [word() for _ in range(20)], []
    for size in (20, 100):
        passage = [word() for _ in range(60)]
        for k in range(size):
            own = list(passage)
            if k != size // 3:
                own[rng.randrange(60)] = word()
            texts.append([*[word() for _ in range(30)], *own, *[word() for _ in range(30)]])
    passage = [*[word() for _ in range(25)], *line, *[word() for _ in range(25)]]
    for k in range(60):  # a frequent line, which in two documents lies in a shared passage
        texts.append([word(), *(passage if k in (7, 50) else [*[word() for _ in range(25)], *line, *[word() for _ in range(25)]])])
    hashed = [compact_windows.word_hashes(" ".join(t)) for t in texts]
    groups = [range(20), range(20, 120), range(120, 180)]
    want = {b for g in groups for b in g if any(compact_windows.verified(hashed[a], hashed[b]) for a in g if a < b)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in compact_windows.repeats(docs).collect()}
    assert got <= want and 170 in got and len(got) >= 0.97 * len(want) and len(want) > 100


def test_windows_beyond_the_best_of_a_group(spark):
    """Windows whose best partners by sketch fail are still verified with the rest of their group."""
    rng, texts = random.Random(43), []
    word = lambda: f"w{rng.randrange(10**6)}"
    some = lambda: [word() for _ in range(30)]
    for _ in range(8):
        passage = [word() for _ in range(60)]
        texts.append([*some(), *passage[:30], word(), *passage[30:], *some()])
        texts += [[*some(), *passage[8:53], *some()] for _ in range(30)]  # too short to be a passage
        texts.append([*some(), *passage, *some()])
    texts = [" ".join(t) for t in texts]
    hashed = [compact_windows.word_hashes(t) for t in texts]
    rows = compact_windows._windows(np.arange(len(texts)), np.arange(len(texts)), texts)
    members = collections.defaultdict(set)
    for group, text in zip(rows[0].tolist(), rows[4].tolist()):
        members[group].add(text)
    pairs = {(a, b) for g in members.values() for a in g for b in g if a < b}
    want = {b for a, b in pairs if compact_windows.verified(hashed[a], hashed[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in compact_windows.repeats(docs).collect()} == want and len(want) >= 6


def test_pairs_that_can_add_nothing_are_not_verified(monkeypatch):
    """Of a group whose common passage is found, pairs that share a few words beyond it, too few for a passage, are passed over."""
    rng, n, calls = np.random.default_rng(44), 40, []
    fresh = lambda k: rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    passage, line, junk = fresh(50), fresh(5), fresh(2)
    words = [np.concatenate([passage, fresh(4), line, fresh(30)]) for _ in range(n)]
    found = [np.arange(89) < 50 for _ in range(n)]
    for name in ("alike_spans", "_spans"):
        if hasattr(compact_windows, name):
            was = getattr(compact_windows, name)
            monkeypatch.setattr(compact_windows, name, lambda *x, was=was: calls.append(1) or was(*x))
    assert list(compact_windows.settled(list(range(n)), words, found, [(20, 20)] * n)) == [] and len(calls) <= n
    # a stretch that many texts have word by word is tried once, also where its words repeat
    calls.clear()
    words = [*[np.concatenate([np.tile(junk, 40), fresh(5)])] * n, np.concatenate([np.tile(junk, 20), fresh(50)])]
    got = list(compact_windows.settled(list(range(n + 1)), words, [np.zeros(len(w), bool) for w in words], [(2, 2)] * (n + 1)))
    assert {b for _, b, *_ in got} == set(range(1, n)) and len(calls) <= 4 * n


def test_what_is_not_verified_holds_no_passage():
    """Whatever pairs are passed over: each passage that holds the anchors of both stretches has no shared shingle left that is not found."""
    rng, passages = np.random.default_rng(45), 0
    for _ in range(60):
        size = int(rng.choice([12, 60, 1 << 31]))
        core = rng.integers(0, size, 60).astype(np.uint32)
        words, anchors, found = [], [], []
        for _ in range(12):
            own, sides = core.copy(), [rng.integers(0, size, rng.integers(0, 40)).astype(np.uint32) for _ in range(2)]
            places = rng.choice(np.r_[0:25, 35:60], rng.integers(0, 4), replace=False)
            own[places] = rng.integers(0, size, len(places))
            words.append(np.concatenate([sides[0], own, sides[1]]))
            anchors.append((len(sides[0]) + 27,) * 2)
            found.append((np.arange(len(words[-1])) < rng.integers(0, 80)) & (rng.random() < 0.5))
        texts, seen = (np.arange(12) // 2 * 2 + rng.integers(0, 2, 12)).tolist(), [f.copy() for f in found]
        for a, b, x0, x1, y0, y1, share in compact_windows.settled(texts, words, found, anchors):
            assert a < b and texts[a] != texts[b] and share >= 0.8 and (x0, x1, y0, y1, share) in compact_windows.verified(*(words[k].astype(np.uint64) for k in (a, b)))
            assert not seen[b][y0:y1].all()
            seen[b][y0:y1] = True
        for a, b in [(a, b) for b in range(12) for a in range(b) if texts[a] != texts[b]]:
            s, t = (compact_windows.shingle_hashes(words[k].astype(np.uint64)) for k in (a, b))
            for x0, x1, y0, y1, _ in compact_windows.alike_spans(s, t):
                if x0 <= anchors[a][0] < x1 - 4 and y0 <= anchors[b][0] < y1 - 4:
                    passages += 1
                    assert all(seen[b][k : k + 5].all() for k in range(y0, y1 - 4) if t[k] in s[x0 : x1 - 4])
    assert passages > 500


def test_recall_of_changed_passages(spark):
    """Pairs of passages with changed words: what brute force verifies is found for nine of ten at least."""
    rng = random.Random(31)
    texts = []
    for _ in range(120):
        n = rng.randrange(60, 201)
        passage = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        own = list(passage)
        for k in rng.sample(range(8, n - 8), max(1, n // 60)):
            own[k] = f"x{rng.randrange(10**6)}"
        for p in (passage, own):
            texts.append([*[f"y{rng.randrange(10**6)}" for _ in range(30)], *p, *[f"z{rng.randrange(10**6)}" for _ in range(30)]])
    hashed = [compact_windows.word_hashes(" ".join(t)) for t in texts]
    want = {b for b in range(1, len(texts), 2) if compact_windows.verified(hashed[b - 1], hashed[b])}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in compact_windows.repeats(docs).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 90


def test_copies_do_not_multiply_the_work(spark):
    rng = random.Random(33)
    passage = prose(rng, 70)
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(6)]
    rows = lambda n: spark.createDataFrame([(k, t) for k, t in enumerate(texts * n)], "doc_id long, text string").repartition(4)
    few, many = (compact_windows.passages(rows(n)).count() for n in (1, 20))
    assert few == many and compact_windows.repeats(rows(20)).count() == few + 6 * 19


def test_copies_in_different_partitions_keep_the_first_place(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    x, y = f"{prose(rng, 60)} {passage}", f"{passage} {prose(rng, 60)}"
    parts = [spark.createDataFrame([row], "doc_id long, text string") for row in ((5, x), (600, y), (900, x))]
    docs = parts[0].union(parts[1]).union(parts[2])
    assert {(r["doc_id"], r["source_doc_id"]) for r in compact_windows.repeats(docs).collect()} == {(600, 5), (900, 5)}
    left = {r["doc_id"]: r["text"] for r in compact_windows.without_repeats(docs).collect()}
    assert set(left) == {5, 600} and left[5] == x and passage not in left[600]


# -- 4: decontamination -------------------------------------------------------------------------------------
def test_decontamination_against_brute_force(spark, odd, empty):
    rng = random.Random(10)
    items = {k: prose(rng, rng.choice([3, 20, 60])) for k in range(12)}
    items[50] = None
    rows = []
    for k in range(40):
        item = (items[k % 12] or "").split()
        if k % 3 == 1 and len(item) > 50:
            item[rng.randrange(5, 50)] = "changed"
        rows.append((k, " ".join([prose(rng, 50), *(item if k % 4 else []), prose(rng, 20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for i, text in rows:
        w = tok(text)
        for j, it in items.items():
            x = tok(it)
            if x:
                k = min(5, len(x))
                g = shingles(x, k)
                for b in range(len(w) - len(x) + 1):
                    h = shingles(w[b : b + len(x)], k)
                    both = sum((g & h).values())
                    s = both / (sum(g.values()) + sum(h.values()) - both)
                    if s >= 0.8 and s > want.get((i, j), (0, 0))[0]:
                        want[i, j] = (s, b)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == want and any(0.8 <= s < 1 for s, _ in got.values())
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.clean(odd, bench).count() == 9 and decontamination.clean(odd, bench.limit(0)).count() == 9
    assert decontamination.contamination(empty, bench).count() == 0


def test_texts_without_a_window_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(12)
    item = prose(rng, 30)
    rows = [(k, " ".join([prose(rng, 30), *([item] if k % 80 == 0 else [])])) for k in range(400)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept, written = decontamination.materialize, []

    def records(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return records(plan.executedPlan())
        inner = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(k) for k in range(plan.children().size())]
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        return own + sum(map(records, inner))

    def spy(session, df, name):
        if name == "windows":
            df.collect()
            written.append(records(df._jdf.queryExecution().executedPlan()))
        return kept(session, df, name)

    monkeypatch.setattr(decontamination, "materialize", spy)
    got = decontamination.contamination(docs, bench).collect()
    assert {r["doc_id"] for r in got} == {0, 80, 160, 240, 320}
    assert len(written) == 1 and written[0] < 100


def test_native_plans_have_no_python(spark, odd):
    bench = spark.sql("select 1L as item_id, 'a b c d e f' as text")
    docs = spark.sql("select 1L as doc_id, 'a b c d e f' as text")
    for df in (decontamination.contamination(docs, bench), license_scan.scan(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# -- 7: licenses --------------------------------------------------------------------------------------------
def test_licenses_against_brute_force(spark, odd, empty):
    texts = ["CC BY cc-by CC BY", "Released under the MIT License.", "GNU General\nPublic License; GNU General Public", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files", "Kelvin MİT license mit license", "apache license apache license", None, "é mit licensé"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = collections.Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"]))
        at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want[r["doc_id"], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = license_scan.scan(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[101] == "mit" and labels[103] == "mit" and labels[102] == "gpl"
    assert all(0 <= r["score"] <= 1 and (r["score"] == 1 if r["n_base"] else True) for r in got)
    assert license_scan.scan(empty).count() == 0


# -- 9: JPEG ------------------------------------------------------------------------------------------------
def test_payloads_come_back(odd, empty):
    media = baseline_jpeg.stored(baseline_jpeg.media_of_texts(odd))
    assert media.inputFiles()
    got = baseline_jpeg.media_features(media).collect()
    want = collections.Counter()
    for r in odd.collect():
        plain = (r["text"] or "").encode()
        p = plain + bytes(-len(plain) % 64 or (0 if plain else 64))
        want[r["doc_id"], len(plain), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert baseline_jpeg.media_features(baseline_jpeg.stored(baseline_jpeg.media_of_texts(empty))).count() == 0


def test_hashes_average_whole_cells():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (3, 64), (8, 9), (30, 64), (100, 7)):
        grey = rng.integers(0, 256, shape).astype(np.uint8)
        cuts = [[(i * n // k, max(i * n // k + 1, (i + 1) * n // k)) for i in range(k)] for n, k in zip(shape, (8, 9))]
        means = [[Fraction(int(grey[a:b, c:d].sum()), (b - a) * (d - c)) for c, d in cuts[1]] for a, b in cuts[0]]
        mean = sum(sum(m[:8]) for m in means) / 64
        bits = lambda rows: f"{int(''.join(str(int(x)) for r in rows for x in r), 2):016x}"
        assert baseline_jpeg.hashes(grey) == (bits([[x > mean for x in m[:8]] for m in means]), bits([[y > x for x, y in zip(m, m[1:])] for m in means]))


def test_several_images_and_any_bytes():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 9, baseline_jpeg.ROWS + 3)]
    media = baseline_jpeg.encode_payloads(payloads)
    back = baseline_jpeg.thumbnails_of(media)
    assert [b"".join(g.tobytes() for _, _, g in own) for own in back] == payloads and [len(x) for x in back] == [1, 1, 2]


def plain_dc(data):
    """A second, sequential reader of the same subset, for colour images with subsampling and without restarts."""
    image = baseline_jpeg._Image(data)
    raw = data[image.begin : image.end].replace(b"\xff\x00", b"\xff")
    bits, at = "".join(f"{b:08b}" for b in raw), 0

    def codes(table):
        out, code, k = {}, 0, 0
        for n, count in enumerate(table[0], 1):
            for _ in range(count):
                out[f"{code:0{n}b}"] = table[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def symbol(table):
        nonlocal at
        for n in range(1, 17):
            if bits[at : at + n] in table:
                at += n
                return table[bits[at - n : at]]
        raise AssertionError

    before, out = collections.Counter(), []
    for _ in range(image.across * image.down):
        for part, dc, ac in image.units:
            size = symbol(codes(dc))
            value = int(bits[at : at + size] or "0", 2)
            at += size
            before[part] += value if not size or value >= 1 << (size - 1) else value - (1 << size) + 1
            if part == 0:
                out.append(before[0])
            k = 1
            while k < 64:
                s = symbol(codes(ac))
                if s == 0:
                    break
                k += (s >> 4) + 1
                at += s & 15
    return out


def test_a_colour_image_with_coefficients(spark):
    """4:2:0, two MCUs, AC runs, no restarts: built bit by bit."""
    rng = random.Random(3)
    dc, ac = {k: 4 for k in range(9)}, {0x00: 2, 0x01: 3, 0x12: 4, 0xF0: 4, 0x21: 5}
    codes = [baseline_jpeg._codes(t) for t in (dc, ac)]
    bits = ""
    put = lambda t, s: f"{codes[t][s][0]:0{codes[t][s][1]}b}"
    for _ in range(2):
        for _ in range(6):
            size = rng.randrange(6)
            bits += put(0, size) + "".join(rng.choice("01") for _ in range(size))
            for s in rng.choice([[], [0x01], [0x12, 0x21], [0xF0, 0x01]]):
                bits += put(1, s) + "".join(rng.choice("01") for _ in range(s & 15))
            bits += put(1, 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    m = baseline_jpeg._marker
    data = b"".join([
        b"\xff\xd8", m(0xDB, bytes([0] + [8] * 64)), m(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        m(0xC4, baseline_jpeg._table_segment(0, dc) + baseline_jpeg._table_segment(0x10, ac)), m(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), scan, b"\xff\xd9",
    ])
    (width, height, grey), = baseline_jpeg.thumbnails_of([data])[0]
    want = plain_dc(data)
    blocks = [[want[0], want[1], want[4], want[5]], [want[2], want[3], want[6], want[7]]]
    assert (width, height) == (30, 16) and grey.tolist() == [[min(255, max(0, x + 128)) for x in row] for row in blocks]
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no image")), (4, bytearray(data[:60]))], "doc_id long, media binary")
    got = {r["doc_id"]: r["width"] for r in baseline_jpeg.thumbnails(df).collect()}
    assert got == {1: 30, 2: None, 3: None, 4: None}
