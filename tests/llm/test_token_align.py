"""Operator 13 against tokenizing each whole text and pairing overlapping tokens one by one."""

import collections
import hashlib
import random

import pytest

from gatherline.llm import token_align
from gatherline.llm.queries import tokenizer_path
from gatherline.llm.token_align import align_tokens, pair_counts

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk int, place int, n_a string, pair int"


def texts():
    rng = random.Random(13)
    alphabet = ["a", "b", "the", "Wort", "é", "ß", " ", "  ", "\n", "\t", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "1", "23", ".", "'s", "—", "日本", "🙂", "́", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "<unk>", "▁", "ﬁ", "\x00", "{\r"]
    rows = ["plain words and more words", " leading", "trailing ", "  two  spaces   three\n\n lines \n", "tab\there", "\n", " ", "x", "▁▁", "<|endoftext|> <s> text </s>", "é", "ﬁne", "word " * 300, "日本語のテキスト", "a" * 5000, "{\r\n  }\r\n"]
    rows += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(250)]
    rows += [" ".join(rng.choice(["alpha", "beta", "gämma", "12,5", "(delta)", "don't"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    return rows


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    bytes_a, bytes_b = token_align.byte_level_tokens(PATHS[0]), token_align.piece_tokens(b_of)
    found, count = [], collections.Counter()
    for text in rows:
        a, b = [], []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            whole = (" " + text).encode()
            if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
                a, b = [], []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = ["|".join(",".join(str(i) for i, _, e in s if low < e <= high) for s in spans) for low, high in zip([0, *cuts], cuts)]
        count.update(links)
        found.append((len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, len(g), len(l), sum(count[p] == best[p[1]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for n_a, n_b, l, g in found], count


@pytest.mark.parametrize("chunk_links,block_bytes", [(2_000_000, 1 << 20), (300, 500)])
def test_against_pairing_all_tokens(spark, chunk_links, block_bytes):
    rows = [*enumerate(texts()), (7, None), (None, ""), (None, "null id"), (3, "the id again"), (3, "the id again")]
    want, count = plain([t or "" for _, t in rows])
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter(tuple(r) for r in align_tokens(spark, df, *PATHS, chunk_links=chunk_links, block_bytes=block_bytes).collect())
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[3] for w in want) > 5000 and sum(not w[0] for w in want) < len(want) / 2
    pairs = {(r.a, r.b): (r.total, r.best) for r in pair_counts(spark, df, *PATHS).collect()}
    assert {k: v[0] for k, v in pairs.items()} == dict(count)


def test_whole_texts_that_neither_side_takes_apart(spark, monkeypatch):
    monkeypatch.setattr(token_align, "CACHE_UNITS", 5)  # a worker forgets all the time
    tok = token_align.Tokenizers(*PATHS)
    for t in texts()[:80]:
        a, b = tok.lists([t.encode(), b"", t.encode() + b" again"])
        assert len(a) == 3 and a[1].as_py() == [] == b[1].as_py()


def test_empty_tables_and_texts(spark):
    assert align_tokens(spark, spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
    got = align_tokens(spark, spark.createDataFrame([(1, None, 1, 1, "", 1), (None, "", 1, 1, "", 1)], SCHEMA), *PATHS).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
