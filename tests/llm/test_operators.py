"""The corpus operators against plain versions, and on awkward rows."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.llm import bwt_dedup, common, decontam, exact_dedup, exchange, hashing, html_extract, jaccard_join, langid, lm, packing, quality, repeats, substring_tree
from gatherline.llm.common import lower_ascii
from gatherline.llm.exact_dedup import exact_duplicates, without_duplicates
from gatherline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, payload string, fp int, rid int, node int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, long = words(rng, 60), words(rng, 3000)
    rows = [(i, words(rng, rng.randrange(20, 200))) for i in range(30)]
    rows += [(100 + i, f"{words(rng, 30)} {passage} {words(rng, 25)}") for i in range(8)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[4][1] + " tail"), (203, "a b " * 80), (204, "é" * 300), (205, long), (206, long[500:2500])]
    return [*rows, (300, None), (301, ""), (302, " \n\t "), (303, "x"), (None, "null id"), (rows[5][0], rows[5][1]), (None, rows[7][1]), (-1, rows[7][1]), (-1, rows[9][1])]


def covered(rows, units, window):
    """Brute force: each text's units and which of them a repeated window covers; every row counts."""
    seen = collections.Counter()
    for _, t in rows:
        u = units(t or "")
        seen.update(u[s : s + window] for s in range(len(u) - window + 1))
    out = {}
    for i, t in rows:
        u = units(t or "")
        mask = np.zeros(len(u), bool)
        for s in range(len(u) - window + 1):
            if seen[u[s : s + window]] > 1:
                mask[s : s + window] = True
        out[i, t or ""] = (u, mask)
    return out


@pytest.mark.parametrize("hot", [1, 3, 2000])
def test_words_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_tree.remove_repeated_words(spark, frame(spark, corpus)).collect())
    want = collections.Counter()
    brute = covered(corpus, lambda t: tuple(t.encode().split()), 35)
    for i, t in corpus:
        u, mask = brute[i, t or ""]
        want[i, len(u), int(mask.sum()), hashlib.sha256(b" ".join(w for w, m in zip(u, mask, strict=True) if not m)).hexdigest()] += 1
    assert got == want and sum(x[2] for x in want) > 500


@pytest.mark.parametrize("hot", [3, 2000])
def test_bytes_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.remove_repeated_bytes(spark, frame(spark, corpus)).collect())
    want = collections.Counter()
    brute = covered(corpus, lambda t: t.encode(), 200)
    for i, t in corpus:
        u, mask = brute[i, t or ""]
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        want[i, len(u), int(mask.sum()), runs, hashlib.sha256(bytes(b for b, m in zip(u, mask, strict=True) if not m)).hexdigest()] += 1
    assert got == want and sum(x[2] for x in want) > 5000


def test_kept_text(spark):
    t = " ".join(map(str, range(40)))
    df = frame(spark, [(1, t + " one"), (2, "two " + t), (3, "three")])
    got = {r.doc_id: r.kept_text for r in substring_tree.remove_repeated_words(spark, df, with_text=True).collect()}
    assert got == {1: "one", 2: "two", 3: "three"}
    got = {r.doc_id: bytes(r.kept) for r in bwt_dedup.remove_repeated_bytes(spark, df, window=50, k=16, with_text=True).collect()}
    assert got[3] == b"three" and len(got[1]) < 10


@pytest.mark.parametrize("fn", [
    lambda s, d: exact_duplicates(s, d), lambda s, d: substring_tree.remove_repeated_words(s, d), lambda s, d: bwt_dedup.remove_repeated_bytes(s, d), lambda s, d: langid.identify(s, d),
    lambda s, d: jaccard_join.similar_components(s, d), lambda s, d: lm.score_documents(s, d), lambda s, d: packing.pack_documents(s, d, tokenizer_path()),
    lambda s, d: quality.score_quality(s, d, s.createDataFrame([], "doc_id long, quality int")), lambda s, d: decontam.contaminated(s, d, s.createDataFrame([], "item_id long, text string")),
])
def test_empty_table_and_empty_texts(spark, fn):
    assert fn(spark, frame(spark, []).where("false")).count() == 0
    fn(spark, frame(spark, [(1, None), (None, ""), (2, "")])).collect()


def test_exact_against_brute_force(spark, corpus):
    got = collections.Counter(tuple(r) for r in exact_duplicates(spark, frame(spark, corpus)).collect())
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[lower_ascii((t or "").encode())].append(i)
    want, done = collections.Counter(), set()
    for i, t in corpus:
        key = lower_ascii((t or "").encode())
        best = max((x for x in groups[key] if x is not None), default=None)
        kept = i == best and key not in done
        done |= {key} if kept else set()
        want[i, best, len(groups[key]), kept, hashlib.sha256(key).hexdigest()] += 1
    assert got == want
    left = without_duplicates(spark, frame(spark, corpus))
    assert left.count() == len(groups) and left.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_one_of_equal_rows_stays(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PORTION", 3)
    rows = [(5, "ABC"), (5, "abc"), (5, "abc"), (4, "abc"), (None, "x")] + [(7, "many")] * 8 + [(None, "none")] * 7 + [(-1, "none"), (None, None), (None, ""), (3, "y")]
    got = exact_duplicates(spark, frame(spark, rows)).collect()
    kept = collections.Counter((r.doc_id, r.text_sha256) for r in got if r.kept)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(rows) and kept == collections.Counter([(5, sha("abc")), (None, sha("x")), (7, sha("many")), (-1, sha("none")), (None, sha("")), (3, sha("y"))])
    assert {(r.doc_id, r.group_size) for r in got if r.text_sha256 == sha("many")} == {(7, 8)}
    left = [(r.doc_id, r.text) for r in without_duplicates(spark, frame(spark, rows)).collect()]
    assert sorted((str(i), (t or "").lower()) for i, t in left) == [("-1", "none"), ("3", "y"), ("5", "abc"), ("7", "many"), ("None", ""), ("None", "x")]


def test_intermediate_tables_can_be_dropped(spark):
    got = exact_duplicates(spark, frame(spark, [(1, "a"), (2, "a")]))
    assert got.count() == 2
    folder = f"{common.shared_dir(spark).removeprefix('file://')}/gatherline/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    common.drop_intermediate(spark)
    assert not os.path.exists(folder)


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1 << 63), (2, 4), (1000, 1 << 20), (5000, 1 << 63)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (exchange.golomb_decode(exchange.golomb_encode(keys)) == keys).all()
    assert len(exchange.golomb_decode(b"")) == 0
    ends = np.array([0, 1, 2**64 - 1], np.uint64)
    assert (exchange.golomb_decode(exchange.golomb_encode(ends)) == ends).all()


def test_anchors_follow_the_content():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    values[1500:1900] = values[200:600]
    grams = hashing.gram_hash(values, 8)
    place, first, last = hashing.anchors(grams, np.ones(len(values) - 34, bool), 35, 8)
    of = {s: p for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)}
    assert sorted(of) == list(range(len(values) - 34)) and all(s <= p <= s + 27 for s, p in of.items())
    assert all(of[s + 1300] - of[s] == 1300 for s in range(200, 600 - 34))


def test_bwt_merge_equals_building_at_once():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (30, 40)).astype(np.uint16)
    rows[17, 5:30] = rows[3, 5:30]
    parts = [rows[:10], rows[10:11], rows[11:]]
    got = bwt_dedup.merge([bwt_dedup.build(np.ascontiguousarray(p.T)) for p in parts], 6, np.zeros(30, bool))
    want = np.zeros((30, 40), bool)
    for c in range(5, 40):
        seen = collections.Counter(bytes(r[c - 5 : c + 1].astype(np.uint8)) for r in rows)
        want[:, c] = [seen[bytes(r[c - 5 : c + 1].astype(np.uint8))] > 1 for r in rows]
    assert (got == want).all()


def jaccard_components(rows, n, share):
    """Brute force: (doc_id, size of the set, least id of the component) of each row."""
    sets = []
    for _, t in rows:
        w = lower_ascii((t or "").encode()).split()
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for k in range(len(rows)):
        least[root(k)].append(rows[k][0])
    return sorted(((i, len(sets[k]), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


def edited(rng, words_of, share, kinds=("change", "cut", "add")):
    """A copy with some words changed, cut off at an end or added in one place."""
    v, many = list(words_of), max(1, int(len(words_of) * share))
    kind = rng.choice(kinds)
    if kind == "change":
        for _ in range(max(1, many // 4)):
            v[rng.randrange(len(v))] = f"new{rng.randrange(40)}"
    elif kind == "cut":
        v = v[many:] if rng.random() < 0.5 else v[:-many] or v
    else:
        at = rng.randrange(len(v))
        v[at:at] = [f"add{rng.randrange(10**6)}" for _ in range(many)]
    return v


@pytest.mark.parametrize("most, rounds, n, share", [(1000, 6, 4, 85), (3, 6, 4, 85), (3, 1, 5, 80), (8, 0, 5, 80)])  # clusters in tasks, by stars, and by blocks
def test_jaccard_against_brute_force(spark, monkeypatch, most, rounds, n, share):
    monkeypatch.setattr(jaccard_join, "CLUSTER_NODES", most)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rng = random.Random(3)
    base = [words(rng, k, 5000).split() for k in (6, 12, 30, 60, 60, 150, 400)]
    rows = []
    for b in base:
        rows.append((len(rows), " ".join(b)))
        for _ in range(20):
            rows.append((len(rows), " ".join(edited(rng, b, rng.choice([0.01, 0.05, 0.1, 0.2, 0.3])))))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c"), (905, " \n"), (3, rows[3][1]), (None, "a b")]
    got = sorted((tuple(r) for r in jaccard_join.similar_components(spark, frame(spark, rows), n, share).collect()), key=str)
    assert got == jaccard_components(rows, n, share)


@pytest.mark.parametrize("share", [80, 85])
def test_similar_sets_share_a_signature(share):
    rng = np.random.default_rng(share)
    for size in [*range(1, 60), 75, 100, 150, 300]:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        sets = []
        for _ in range(30):  # pairs at the limit, with elements lacking, added and changed
            union = -(-size * 100 // share)
            gone = int(rng.integers(0, size - share * size // 100 + 1))
            more = max(0, (size - gone) * 100 // share - size)
            b = np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= share * (len(a) + len(b) - both):
                sets.append(np.unique(b))
            assert union >= size
        every = [a, *sets]
        keys, text, sizes = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every]), np.array([len(x) for x in every])
        sig, of = jaccard_join.signatures(keys, text, sizes, share)
        mine = set(sig[of == 0].tolist())
        assert len(sets) > 5 and all(mine & set(sig[of == i].tolist()) for i in range(1, len(every)))


@pytest.mark.parametrize("share", [80, 85])
def test_unrelated_sets_share_next_to_nothing(share):
    rng = np.random.default_rng(1)
    sizes = rng.integers(10, 200, 20_000)
    keys, text = rng.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    sig, of = jaccard_join.signatures(keys, text, sizes, share)
    _, times = np.unique(sig, return_counts=True)
    assert (times * (times - 1) // 2).sum() < 200 and len(sig) < 0.5 * sizes.sum()


def test_instances_hold_every_pair():
    for share in (80, 85, 95):
        spans = jaccard_join.instances(5000, share)
        for b in [*range(1, 400), 1000, 4999]:
            a = -(-share * b // 100)
            assert any(low <= a and b <= high for low, high, _, _ in spans)


def check_packing(docs, got, window, repeated=None):
    """Each id once, CRCs right, sequences without gaps, and padded to 2 percent at most; a row may stand twice."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        held = np.zeros(len(ids[i]), int)
        for r in parts:
            held[r.start : r.start + r.length] += 1
        assert (held == (2 if i == repeated else 1)).all()
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    assert padding <= 0.02 * sum(r.length for r in got)
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing(spark, corpus):
    docs = [(i, t) for i, t in dict(corpus).items() if i is not None]  # ids tell the documents apart here
    docs += [(400, "it's we'll ''s <|endoftext|> İstanbul 漢字12ab ½ ² x² a_b \x1c \x01"), (401, words(random.Random(1), 9000))]
    check_packing(docs, packing.pack_documents(spark, frame(spark, docs), tokenizer_path()).collect(), 4096)


def test_token_ids_of_each_letter_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    marks = "Σσς\u0130\u0131\u1e9e\u0345\u01c5\u1f88\u03f4\u2126"
    texts = ["ΟΔΟΣ", "Σ", "ΑΣ ΣΑ ΣΣ", "ΟΔΟΣ, ΟΔΟΣ.", "ΟΔΟΣ2 ΟΔΟΣabc ABCΣ aΣ-b Σ_", "Σ'Σ İΣ", *(f"A{c}B {c}A B{c} Σ{c}Σ {c}" for c in [*marks, *map(chr, range(0x370, 0x530))])]
    rng = random.Random(2)
    pool = [*"abzAZ09''-.,<|>_\t\n \x1c\x01", *"sStTmMdDrReEvVlL", *"ÀÖ×ØßàþÿÞ÷ªµº½", "é", "e\u0301", "\u00a0", "\u0085", "क़", "İ", "漢", "“", "<|endoftext|>"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["it's", "'s", "x's's", "''s", "-'s", "'re've'll", "l'eau d'été", "'sabc", "a'", "'", "1's2", "<|", "x<|startoftext|>y", "STRASSE'S ÀÉß", "क़ क़"]
    got = packing.token_ids([t.encode() for t in texts], tokenizer_path())
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("mix", ["spread", "ones", "seventeen", "short", "halves", "more", "long", "few", "none"])
def test_plan_uses_all_pieces_and_pads_little(mix):
    rng = np.random.default_rng(3)
    drawn = {
        "spread": rng.integers(1, 4097, 3000), "ones": np.ones(5000, int), "seventeen": np.full(4000, 17), "short": rng.integers(1, 61, 5000), "halves": np.full(1000, 2100),
        "more": np.full(1000, 2501), "long": rng.integers(2100, 4001, 2000), "few": np.array([4095, 3, 900]), "none": np.zeros(0, int),
    }[mix]
    lengths = np.bincount(drawn, minlength=4097)
    sequences, tape = packing.plan(lengths)
    queues = {b: np.concatenate([np.full(lengths[n], n) for n in range(min(16 * b, 4096), 16 * (b - 1), -1)]) for b in range(1, 257)}
    seen, room, count = collections.defaultdict(list), 0, 0
    for parts, times in sequences:
        totals = np.zeros(times, int)
        for b, low, many in parts:
            seen[b] += range(low, low + many * times)
            totals += queues[b][low : low + many * times].reshape(times, many).sum(1)
        assert (totals <= 4096).all()
        room, count = room + int(np.where((totals & (totals - 1)) == 0, 0, 4096 - totals).sum()), count + times
    for n, low, many in tape:
        b = -(-n // 16)
        seen[b] += range(low, low + many)
        assert (queues[b][low : low + many] == n).all()
    assert all(sorted(seen[b]) == list(range(len(q))) for b, q in queues.items())
    # the tape is not padded: its last sequences are powers of two
    assert room <= 0.02 * max(drawn.sum(), 1)


def test_the_end_of_a_tape_is_cut_into_powers_of_two():
    assert packing.tape_ends(4096 + 904, 4096).tolist() == [4096 + 512, 4096 + 768, 4096 + 896, 4096 + 904]
    assert packing.tape_ends(8192, 4096).tolist() == [] and packing.tape_ends(1, 4096).tolist() == [1]


@pytest.mark.parametrize("sizes", [[700] * 30, [0] * 90, [2600, 40, 1] * 6])
def test_cut_pieces_hold_all_ids_and_pad_little(spark, sizes):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate(sizes)]
    check_packing(docs + docs[:1], packing.pack_documents(spark, frame(spark, docs + docs[:1]), tokenizer_path(), window=1024).collect(), 1024, repeated=0)


def test_least_squares_is_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-5 and np.abs(slope[x > 0]).max() < 1e-5


def test_masks_tolerate_two_substitutions():
    for wrong in itertools.combinations(range(13), 2):
        assert any(all(not (c == "1" and p + j in wrong) for j, c in enumerate(m)) for m in decontam.MASKS for p in range(13 - len(m) + 1))


@pytest.mark.parametrize("length, wrong", [(16, 3), (20, 4), (25, 5), (30, 6)])  # any longer stretch holds one of these, or 13 tokens with two
def test_masks_hit_every_stretch_within_the_limits(length, wrong):
    pattern = (1 << np.array(list(itertools.combinations(range(length), wrong)), np.int64)).sum(axis=1)
    for shorter, most in ((16, 3), (20, 4), (25, 5)):
        for p in range(length - shorter + 1 if shorter < length else 0):
            pattern = pattern[np.bitwise_count(pattern & np.int64(((1 << shorter) - 1) << p)) > most]
    for m in decontam.MASKS:
        for p in range(length - len(m) + 1):
            pattern = pattern[(pattern & np.int64(sum(1 << p + j for j, c in enumerate(m) if c == "1"))) != 0]
    assert not len(pattern)


def test_overlaps_with_substitutions_at_any_place():
    for n in range(13, 26):
        item = [f"t{j}" for j in range(n)]
        index = decontam._index([(n, " ".join(item).encode())], decontam.MASKS)
        placings = [w for k in (0, 1, 2) for w in itertools.combinations(range(n), k)]
        texts = [" ".join(["before", *("other" if j in w else x for j, x in enumerate(item)), "after"]).encode() for w in placings]
        got = {r[0]: r[2] for r in decontam._overlaps(texts, index, decontam.MASKS, 13, 0.8)}
        assert got == {i: n - len(w) for i, w in enumerate(placings) if n - len(w) >= 13}


def test_short_items_are_looked_for_whole():
    items = [(n, " ".join(f"t{n}x{j}" for j in range(n))) for n in range(1, 13)] + [(20, "t3x0 t3x1 t3x2"), (21, "!"), (22, "t2x1 t2x0")]
    index = decontam._index([(i, t.encode()) for i, t in items], decontam.MASKS)
    texts = [f"before {t}, after {t}" for _, t in items[:12]] + [t.rsplit(" ", 1)[0] + " other" for _, t in items[1:12]] + ["", "t2x0", "t2x1 and t2x0"]
    got = sorted(decontam._overlaps([t.encode() for t in texts], index, decontam.MASKS, 13, 0.8))
    assert got == sorted([(n - 1, n, n, n, 1, 0) for n in range(1, 13)] + [(2, 20, 3, 3, 1, 0)])
    assert decontam._overlaps([b"t2x0", b"t2x1"], index, decontam.MASKS, 13, 0.8) == []


def test_best_stretch_against_brute_force():
    rng = np.random.default_rng(6)
    share = decontam.Fraction("0.8")
    for _ in range(300):
        equal = rng.random(rng.integers(1, 30)) < rng.choice([0.3, 0.7, 0.9])
        fits = [int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)]
        begin, end, matched = decontam.best_stretch(equal, share)
        assert matched == equal[begin:end].sum() == max(fits) and 5 * matched >= 4 * (end - begin)
        assert not matched or (equal[begin] and equal[end - 1])


def aligned(doc, item):
    """Brute force: the most equal tokens that any stretch of any diagonal has within the limits, or None."""
    tokens_of = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", lower_ascii((t or "").encode()))
    a, b = tokens_of(doc), tokens_of(item)
    need, best = min(13, len(b)), 0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
        for i in range(len(b)):
            for j in range(i + need, len(b) + 1):
                m = sum(same[i:j])
                if m >= need and 5 * m >= 4 * (j - i):
                    best = max(best, m)
    return best if b and best else None


@pytest.mark.parametrize("block", [10, decontam.BLOCK_TOKENS])  # hashes joined by shuffle, and broadcast
def test_overlaps_against_an_exhaustive_aligner(spark, block):
    rng = random.Random(31)
    items = [(i, words(rng, rng.choice([2, 4, 7, 12, 15, 20, 28]), 30 if i % 2 else 3000)) for i in range(14)] + [(3, "w1 w2"), (None, "only w1 here"), (50, None), (51, " "), (52, "w5 w5 w5 w5 w5 w5 w5 w5")]
    docs = []
    for i in range(60):
        t = (items[rng.randrange(14)][1] + " " + words(rng, rng.randrange(8), 30)).split()
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = "other"
        docs.append((i, f"{words(rng, rng.randrange(12), 30)} {' '.join(t)}, {words(rng, rng.randrange(12), 30)}"))
    docs += [(70, None), (71, ""), (5, docs[5][1]), (None, docs[6][1]), (-1, docs[6][1]), (72, "w5 " * 200), (73, words(rng, 6000) + " " + items[5][1])]
    df, tests = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.n_matched) for r in decontam.contaminated(spark, df, tests, block_tokens=block).collect())
    want = collections.Counter()
    for i, t in docs[:-1]:
        want.update((i, k, m) for k, x in items if (m := aligned(t, x)) is not None)
    late = {x[0] for x in want} | {73}
    assert collections.Counter({x: n for x, n in got.items() if x[0] != 73}) == want and any(x[0] == 73 for x in got) and len(want) > 30
    assert collections.Counter(r.doc_id for r in decontam.without_overlap(spark, df, tests, block_tokens=block).collect()) == collections.Counter(i for i, _ in docs if i not in late)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, words(rng, 20, 3000)) for i in range(5)]
    changed = items[2][1].split()
    changed[4], changed[11] = "other", "words"
    docs = [(1, f"{words(rng, 40)} {items[0][1].upper()}. {words(rng, 40)}"), (2, f"x, {' '.join(changed)}!"), (3, words(rng, 200)), (4, items[3][1].split(" ", 9)[9]), (5, None), (6, "")]
    df, tests = frame(spark, docs), spark.createDataFrame([*items, (9, None), (10, ""), (11, items[0][1])], "item_id long, text string")
    want = {(1, 0, 20), (1, 11, 20), (2, 2, 18)}
    for block in (10, decontam.BLOCK_TOKENS):  # in passes, and at once
        got = {(r.doc_id, r.item_id, r.n_matched) for r in decontam.contaminated(spark, df, tests, block_tokens=block).collect()}
        assert got == want
    assert {r.doc_id for r in decontam.without_overlap(spark, df, tests).collect()} == {3, 4, 5, 6}


def test_decontamination_drops_rows_not_ids(spark):
    rng = random.Random(17)
    item, clean = words(rng, 20, 3000), [words(rng, 50) for _ in range(4)]
    rows = [(None, f"x {item}"), (None, clean[0]), (None, None), (7, f"{item} y"), (7, clean[1]), (7, clean[1]), (-1, clean[2]), (8, clean[3]), (8, f"x {item}")]
    left = decontam.without_overlap(spark, frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter(r for r in rows if item not in (r[1] or ""))
    assert left.columns == frame(spark, rows).columns


def test_one_row_of_each_component(spark):
    rng = random.Random(18)
    base = [words(rng, 80, 5000) for _ in range(7)]
    near = [f"{b} tail" for b in base]
    rows = [(None, base[0]), (None, near[0]), (1, base[1]), (1, near[1]), (1, base[2]), (2, near[2]), (None, base[3]), (5, near[3])]
    rows += [(6, base[4]), (6, base[4]), (9, near[4]), (None, base[5]), (-1, base[5]), (None, base[6])]
    blank = [(None, None), (None, None), (1, ""), (1, ""), (6, " ")]
    left = collections.Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(spark, frame(spark, rows + blank)).collect())
    assert left - collections.Counter(blank) == left - collections.Counter(x for x in left.elements() if x in blank)
    assert sum(left[x] for x in set(blank)) == len(blank)
    kept = [x for x in left.elements() if x not in blank]
    of = lambda k: [x for x in kept if x[1] in (base[k], near[k])]
    assert [len(of(k)) for k in range(7)] == [1] * 7 and len(kept) == 7
    assert [of(k)[0][0] for k in range(7)] == [None, 1, 1, 5, 6, -1, None]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_against_plain_version(spark, corpus, order):
    docs = [*corpus, (401, "w1 " * 400), (402, "w1 w2 w1 w3 " * 90), (410, "unheard of words w1 w2")]  # w1 has a large share, repeated rows count
    got = collections.defaultdict(list)
    for r in lm.score_documents(spark, frame(spark, docs), order=order).collect():
        got[r.doc_id].append(r)
    pad = ("begin",) * (order - 1)
    tokens = [(i, [*pad, *lower_ascii((t or "").encode()).split(), b"\0end"]) for i, t in docs]
    train = [w for i, w in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0]
    counts = {order: collections.Counter(tuple(w[j - order + 1 : j + 1]) for w in train for j in range(order - 1, len(w)))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    c1 = collections.Counter(x for w in train for x in w[order - 1 :])
    times = lambda v: [sum(x == k for x in v) for k in (1, 2, 3, 4)]
    d = {k: [0.0, *lm.discounts(times(list(c.values())))] for k, c in counts.items()}
    total, spare = {}, {}
    for k, c in counts.items():
        total[k], spare[k] = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[k][g[:-1]] += n
            spare[k][g[:-1]] += d[k][min(n, 3)]

    def p(g):
        k, low = len(g), p(g[1:]) if len(g) > 1 else 1 / (len(c1) + 1)
        n, h = counts[k][g], g[:-1]
        return ((n - d[k][min(n, 3)] if n else 0) + spare[k][h] * low) / total[k][h] if total[k][h] else low

    n = sum(c1.values())
    for i, w in tokens:
        body = w[order - 1 :]
        want = (len(body), sum(c1[x] > 0 for x in body), n, sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (len(c1) + 1))) for x in body), sum(math.log10(p(tuple(w[j - order + 1 : j + 1]))) for j in range(order - 1, len(w))))
        assert any(tuple(r[2:7]) == pytest.approx(want) for r in got[i]), i
    assert sum(map(len, got.values())) == len(docs)
    for h in ((b"w1",) * (order - 1), pad, (b"w2", b"w1", b"w3")[-order + 1 :]):
        assert sum(p((*h, x)) for x in c1) + p((*h, b"never seen")) == pytest.approx(1)


def test_hash_arrays_find_what_they_hold():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 8, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        values = rng.integers(1, 400, (len(keys), 3))
        array = lm.hash_array(keys, values)
        asked = np.concatenate((keys, rng.integers(0, 1 << 63, 2000, dtype=np.uint64)))
        got = lm.find(array, asked, 3)
        assert (got[: len(keys)] == values).all() and not got[len(keys) :][~np.isin(asked[len(keys) :], keys)].any()


def test_grams_round_trip():
    rng = np.random.default_rng(9)
    columns = [rng.integers(0, 50 if j else 1 << 33, 4000) for j in range(3)]
    by = np.lexsort((columns[0], columns[2], columns[1]))
    columns, times = [c[by] for c in columns], rng.integers(1, 300, 4000)
    got, n = lm.decode_grams(lm.encode_grams(columns, times))
    assert all((a == b).all() for a, b in zip(got, columns, strict=True)) and (n == times).all()


def test_language_identification(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 8))) for _ in range(40))
    rows = [(i, text(kinds[k]), k) for i, k in enumerate(list(kinds) * 40)] + [(500, None, "aa"), (501, "12 !?", "bb"), (502, text("αβγδε") * 2, None), (503, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(spark, df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120]) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[503].lang_pred == "aa"
    assert {i for i, r in got.items() if r.rejected} == {500, 501, 502}
    assert langid.in_known_language(spark, df).count() == 121
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)


def test_character_model_sums_to_one():
    counts = collections.Counter()
    for w in ("abab", "abba", "ba", "b"):
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            counts[s[max(0, i - 4) : i + 1]] += 1
    m = langid.Model({"x": counts})
    after = lambda w, c: math.exp(m.score_words([w + c])[0, 0] - m.score_words([w])[0, 0]) if c else 0
    total = 0.0
    for c in "ab\x03":
        strings = ["\x02ab" + c]
        total += _last_probability(m, strings[0])
    assert total == pytest.approx(1 - 998 * _last_probability(m, "\x02abq"), abs=0.02) and after("a", "b") > 0


def _last_probability(m, s):
    """P of the last character of s, by the model's arrays."""
    p = float(m.base[0])
    keys = {int(k): i for i, k in enumerate(m.keys)}
    for n in range(1, min(5, len(s)) + 1):
        gram, context = s[len(s) - n :], s[len(s) - n : -1]
        a = m.alpha[keys.get(int(langid._hashes([gram])[0]), len(m.keys)), 0]
        b = m.back[keys.get(int(langid._hashes([context])[0]), len(m.keys)), 0] if context else 1.0
        p = a + b * p
    return p


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: words(rng, 60)
    bad = lambda: " ".join(w + "$$$" for w in words(rng, 60).split())
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (900, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(spark, frame(spark, rows), labels).collect()}
    held = [(i, r) for i, r in got.items() if r.held_out and i < 300]
    assert len(held) > 40 and sum(r.predicted == int(i % 3 > 0) for i, r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 302


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out_accuracy(spark):
    """On rows that neither model has learned from; the most frequent label alone would reach 0.80 and 0.61."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    scored = quality.score_quality(spark, docs, labels).where("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    found = langid.identify(spark, docs).where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, rejected = found.where("lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.98 and rejected < 0.01


def test_only_letters_are_letters():
    assert langid.letters("²½Ⅷ①٣3_ äß ªº naïve x2y Ωж漢".encode()) == ["äß", "ªº", "naïve", "x", "y", "ωж漢"]


PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div><div class="layout"><div class="{cls}"><h1>Head  &amp;
line</h1><p>First <b>bold<br>text</b> &lt;x&gt;.<p>Second&nbsp;one <a href="x">link</a>, long enough to count as the main text of this page, by far.</p><div class="ad">Buy</div>
<form>Form</form></div><aside>Side</aside><section class="comments"><p>A comment that is quite long but still from a reader of the page.</p></section></div><footer>Foot</footer></body></html>"""
TEXT = "Head & line\nFirst bold text <x>.\nSecond one link, long enough to count as the main text of this page, by far."


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(cls=f"post-body post-{i}")) for i in range(5)]
    rows += [(10, "https://h.example/odd", "<html><body><article><p>Only this"), (11, None, None), (12, "::bad", ""), (13, "https://z.example", "plain text"), (0, rows[0][1], rows[0][2])]
    got = html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[i] == TEXT for i in range(5))
    assert text[10] == "Only this" and text[11] == "" and text[12] == "" and text[13] == "plain text"


def test_pages_keep_text_beside_the_largest_container(spark):
    body, lead, nav = "<p>" + "body text " * 30 + "</p>", "<p>" + "lead text " * 10 + "</p>", "<ul><li><a href=/>one</a> | <a href=/>two</a></li></ul>"
    pages = {
        0: f"<article><h1><a href=/>Head</a></h1>{lead}<div class=body>{body}</div></article>{nav}",
        1: f"<main>{lead * 4}<article>{body}</article></main>{nav}",
        2: f"<article><div class=body>{body}</div></article>{nav}",
        3: f"{nav}<div class=body>{body}</div><div>{lead}</div>",
        4: f"<article><div class=body>{body}</div><div class=body>{body}</div></article>{nav}",
        5: nav,
    }
    # most pages of the host have nothing beside the container, so that its path wins
    rows = [(i, "https://h.example/x", p) for i, p in pages.items()] + [(100 + i, "https://h.example/y", pages[2]) for i in range(20)]
    text = {r.page_id: r.text for r in html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    b, le = ("body text " * 30).strip(), ("lead text " * 10).strip()
    assert text[0] == f"Head\n{le}\n{b}" and text[1] == "\n".join([le] * 4 + [b])
    assert text[2] == text[100] == b and text[4] == f"{b}\n{b}"
    assert b in text[3] and le in text[3] and text[5] == ""


def test_hostile_pages_take_linear_time():
    for s in ("<a " * 20_000, '<a href="' * 7000, '<a href="x>' * 7000, "<" * 60_000, "<!--" * 20_000, "<div>" * 20_000, "<p>" * 20_000, "<b><div>" + "<i>" * 9000 + "</b>" * 9000, "<td><p>t" * 9000, "&" * 60_000):
        began = time.process_time()
        html_extract.extract(html_extract.parse(s), [])
        assert time.process_time() - began < 2, s[:10]


def test_pieces_of_odd_markup():
    got = list(html_extract.pieces("a<b t=don't>c</b><!-- <i> -->d<script>x<y</script >e<![CDATA[f<g]]><p a='>' b=\"<\">h < i<q k='1>j"))
    assert got == [("text", "", "a"), ("open", "b", " t=don't"), ("text", "", "c"), ("close", "b", ""), ("text", "", "d"), ("text", "", "e"), ("cdata", "", "f<g"),
                   ("open", "p", " a='>' b=\"<\""), ("text", "", "h < i"), ("open", "q", " k='1"), ("text", "", "j")]


def test_pages_of_random_structure(spark):
    """Pages built from known article blocks, in containers of any depth, with what is no article text around."""
    rng = random.Random(21)
    rows, want = [], {}

    def inner(depth):
        out, texts = [], []
        for _ in range(rng.randrange(1, 5)):
            if depth and rng.random() < 0.4:
                more, t = inner(depth - 1)
                tag = rng.choice(["div", "section", "div class='x y2'", "blockquote", "td"])
                out.append(f"<{tag}>{more}</{tag.split()[0]}>")
                texts += t
            else:
                t = words(rng, rng.randrange(3, 40))
                out.append(rng.choice([f"<p>{t}</p>", f"<h2>{t}</h2>", f"<ul><li>{t}</li></ul>", f"<p>{t}", f"<div>{t}</div>", f"<p><b>{t}</b></p>"]))
                texts.append(t)
        return "".join(out), texts

    for i in range(60):
        body, texts = inner(3)
        junk = lambda: rng.choice(["<nav><a href=/>menu item</a></nav>", "<aside><p>side text of some length</p></aside>", "<form>form</form>", "<script>var x = '<p>no';</script>", "<div class='ad-box'>buy this now</div>", "<!-- <p>comment -->"])
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body>{junk()}<div class='page'>{junk()}<article class='post-{i}'>{body}</article>{junk()}</div>{junk()}<footer>foot</footer></body></html>", "x", "x", 1))
        want[i] = "\n".join(texts)
    long = "".join(f"<p>{words(rng, 20)}</p>" for _ in range(9000))
    rows += [(100, "http://h0.example/l", f"<div>{long}</div>", "x", "x", 1), (None, None, "<p>two of</p>", "x", "x", 1), (None, None, "<p>two of</p>", "x", "x", 1)]
    want |= {100: re.sub("<p>", "", long).replace("</p>", "\n").strip(), None: "two of"}
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, paths int")
    got = html_extract.main_text(spark, frame_).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(spark, frame_.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = [words(rng, 120) for _ in range(6)]
    item = words(rng, 30, 3000)
    rows = list(enumerate(base)) + [(50, base[0]), (51, base[1].replace(base[1].split()[60], "changed", 1)), (52, f"{words(rng, 50)} {item} {words(rng, 50)}"), (53, None), (54, "123")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
        assert name == "pack" or docs.columns == columns
    assert left["language"] == {0, 1, 2, 3, 4, 5, 50, 51, 52}
    assert left["exact_dedup"] == {1, 2, 3, 4, 5, 50, 51, 52}
    assert left["near_dedup"] == {1, 2, 3, 4, 5, 50, 52}
    assert left["decontaminate"] == left["pack"] == {1, 2, 3, 4, 5, 50}
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in packed)
