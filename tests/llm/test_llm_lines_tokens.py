import hashlib
import random
import string
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relweave.llm import bpe, linededup, tokencount
from relweave.llm.cuckoo import CuckooFilter

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, least=10):
    key = lambda x: x.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})
    order = lambda d: float("inf") if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _lines(n, seed):
    rng = random.Random(seed)
    pool = ["Short", "A line that repeats", " a LINE that repeats\t", "", "   ", "exactly10!", "exactly10! ", "Éxactly10é", "éxactly10é", "another common line"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < .5 else f"own line number {rng.randrange(40)} of it" for _ in range(rng.randint(0, 8)))) for i in range(n)]


@pytest.mark.parametrize("per_shard, piece_rows", [(1 << 12, 1 << 14), (4, 3), (64, 10)])
def test_line_dedup_against_brute_force(spark, per_shard, piece_rows):
    rows = _lines(150, 1)
    random.Random(4).shuffle(rows)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_shard=per_shard, piece_rows=piece_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = linededup.dedup_lines(odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert linededup.dedup_lines(no_docs).count() == 0
    kept = linededup.dedup_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 3").count() == 1


@pytest.mark.parametrize("per_shard", [1 << 12, 6])
def test_index_inserts_and_deletes_are_reversible(spark, per_shard):
    """With few keys a shard the second insertion doubles the shards."""
    rows = _lines(60, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = df.where("doc_id < 40"), df.where("doc_id >= 40")
    one = linededup.LineIndex.empty(spark, per_shard=per_shard).insert(first)
    both = one.insert(second)
    assert sorted(map(tuple, linededup.dedup_lines(df, index=both).collect()), key=str) == brute_lines(rows)
    back = both.delete(second.select("doc_id"))
    assert sorted(map(tuple, linededup.dedup_lines(first, index=back).collect()), key=str) == brute_lines(rows[:40])
    # the smallest holder goes: the next one keeps the line
    less = both.delete(df.where("doc_id < 20").select("doc_id"))
    assert sorted(map(tuple, linededup.dedup_lines(df.where("doc_id >= 20"), index=less).collect()), key=str) == brute_lines(rows[20:])
    for name in ("holds", "refs"):
        assert sorted(map(tuple, getattr(back, name).collect())) == sorted(map(tuple, getattr(one, name).collect()))
    for state in (one, both, back, less):
        want = defaultdict(list)
        for r in state.holds.collect():
            want[r.k1, r.k2].append(r.doc)
        assert {(r.k1, r.k2): (r.refs, r.owner, r.last) for r in state.refs.collect()} == {k: (len(d), min(d), max(d)) for k, d in want.items()}
        filters = {r.shard: (CuckooFilter.load(bytes(r.held)), CuckooFilter.load(bytes(r.shared)), r.n) for r in state.filters.collect()}
        # filters show every key that is held or shared, and hold as many marks
        keys = np.array([k for k, _ in want])
        of = (keys.view(np.uint64) >> np.uint64(64 - state.bits)).astype(int) if state.bits else np.zeros(len(keys), int)
        many = np.array([min(d) < max(d) for d in want.values()])
        for s, (held, shared, n) in filters.items():
            mine = of == s
            assert held.contains(keys[mine]).all() and shared.contains(keys[mine & many]).all()
            assert n == mine.sum() == (held.table != 0).sum() and (mine & many).sum() == (shared.table != 0).sum()
        assert sum(n for _, _, n in filters.values()) == len(keys) == state.keys
    assert per_shard > 6 or both.bits > one.bits > 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and len(f.dump()) < 8 * len(keys)
    assert f.contains(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)).mean() < 0.01
    f = CuckooFilter.load(f.dump())
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    assert not CuckooFilter(4).insert(keys[:100]) and not CuckooFilter(4).contains(keys[:5]).any()
    assert CuckooFilter.of(keys[:0]).contains(keys[:3]).sum() == 0


def _texts():
    rng = random.Random(11)
    parts = ["don't", "I'LL", "'s", "  ", "\n\n", "\t", " 123", "4567", "<|endoftext|>", "<|startoftext|>", "naïve", "ÉCOLE", "é", "Straße", "中文字", "日本語テキスト", "😀😃", "Σίσυφος", "ΟΔΟΣ", "İI",
             "½", "²", "x_y", "...", "!!!", " ", " ", "\x1c", "\x85", "a‍b", "٣٤", "नमस्ते", "​", "'", "''", "<|", "|>", "endoftext", " the", "The", "zzzzzzzzzzzz"]
    out = ["".join(rng.choice(parts + list(string.printable)) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return out + ["", " ", "a" * 3000, " " * 500, "ab" * 2000 + "é" * 500, "<|endoftext|>" * 3]


def test_bpe_equals_the_library_and_round_trips(spark):
    texts, tok = _texts(), Tokenizer.from_file(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (50, 5000):  # few and many words in the lexicon
        got = {r.doc_id: r for r in bpe.encode_documents(df, BYTE, public_tokenizers.PATTERN, lexicon_size=size).collect()}
        for i, t in enumerate(texts):
            e = tok.encode(t, add_special_tokens=False).ids
            assert got[i].ids == e and got[i].n_tokens == len(e)
            assert got[i].decoded == tok.decode(e, skip_special_tokens=False) == t


def test_lexicon_is_a_minimal_transducer():
    words = {w.encode(): (n, n + 1) for n, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "été", "a", "ab"])}
    data = bpe.compile_lexicon(words)
    lex = bpe.Lexicon(data)
    asked = [*words, b"ta", b"tapss", b"", b"zz", "ét".encode()]
    ranks = lex.ranks(asked)
    assert sorted(ranks[:len(words)].tolist()) == list(range(len(words))) and (ranks[len(words):] == -1).all()
    for w, r in zip(asked, ranks):
        if r >= 0:
            assert tuple(lex.ids[lex.ends[r]:lex.ends[r + 1]]) == words[w]
    # equal suffixes are one state: no two states have the same finality and arcs
    arcs = defaultdict(list)
    for k, to in zip(lex.keys.tolist(), lex.targets.tolist()):
        arcs[k >> 8].append((k & 255, to))
    seen = [(int(lex.final[s]), tuple(arcs[s])) for s in range(len(lex.final))]
    assert len(set(seen)) == len(seen)
    assert (bpe.Lexicon(bpe.compile_lexicon({})).ranks([b"x"]) == -1).all()


def test_bpe_of_odd_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(BYTE)
    rows = odd_docs.select("doc_id", "text").collect()
    got = bpe.token_digests(odd_docs, BYTE, public_tokenizers.PATTERN).collect()
    want = []
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.token_digests(no_docs, BYTE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("block", [64 << 20, 200])
def test_token_counts_equal_the_library(spark, block):
    texts, tok = _texts(), Tokenizer.from_file(WORD)
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (0, texts[0])], "doc_id long, text string").repartition(3)
    got = tokencount.token_counts(df, WORD, limit=20, block_bytes=block).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] if r.doc_id >= 0 else ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 20), (t,)


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORD)
    got = tokencount.token_counts(odd_docs, WORD).select("doc_id", "n_tokens").collect()
    want = [(r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(no_docs, WORD).count() == 0
