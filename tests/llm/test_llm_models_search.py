import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pytest

from relweave.llm import ann, chat, decontam, langid, quality

WORDS = {"aa": ["alpha", "banda", "carta", "danza", "malta"], "ee": ["elema", "tereb", "gleeb", "swepe", "kretz"], "oo": ["osto", "moloko", "gorod", "okno", "slovo"]}


def _sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# ---------------------------------------------------------------- language id

@pytest.fixture(scope="module")
def lang_rows():
    rng = random.Random(1)
    return [(i, _sentence(rng, WORDS[x], rng.randint(3, 60)), x) for i, x in enumerate(rng.choice(list(WORDS)) for _ in range(240))]


def test_language_id_held_out(spark, lang_rows):
    df = spark.createDataFrame(lang_rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df.where("doc_id % 5 != 0"), sample_rows=100)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(i, x) for i, _, x in lang_rows if i % 5 == 0]
    assert sum(got[i].lang_pred == x for i, x in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 !?"), (3, "zzqx wqxz xqzw zqwx qqqq"), (None, "alpha banda"), (5, "alpha " * 30_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and out[0].score == 0
    assert out[3].rejected and not out[5].rejected and out[5].lang_pred == out[None].lang_pred == "aa"
    assert langid.predict(odd.where("doc_id = 77"), model).count() == 0


def test_models_are_probabilities(spark, lang_rows):
    """Over all characters the interpolated probabilities after a context add up to one."""
    df = spark.createDataFrame(lang_rows, "doc_id long, text string, lang string")
    m = langid.fit(df, order=3, sample_rows=10)
    for lang in m.langs:
        chars = sorted({c for _, t, x in lang_rows if x == lang for c in t})
        for head in ("a", "ab", "", "zz"):
            c0, _ = langid.codes_of([head], 3)
            total = 0.0
            for ch in [*chars, "Ж"]:
                joined, starts = langid.codes_of([head + ch], 3)
                h1 = m.entropies([head + ch])[0, m.langs.index(lang)] * (len(joined) - 2)
                h0 = m.entropies([head])[0, m.langs.index(lang)] * (len(c0) - 2) if head else 0.0
                total += float(np.exp(h0 - h1))
            assert 0.98 < total < 1.02, (lang, head, total)


def _brute_entropy(texts, text, order, discount=0.75):
    """Mean cross-entropy of ``text`` under interpolated Kneser-Ney over dictionaries of whole grams."""
    pad = "\x02" * (order - 1)
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        t = pad + t
        for i in range(order - 1, len(t)):
            g = t[i - order + 1:i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    sums = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            total, kinds = sums[k].get(g[:-1], (0, 0))
            sums[k][g[:-1]] = (total + c, kinds + 1)

    def p(g):
        if not g:
            return 1 / (sums[1][""][1] + 1)
        total, kinds = sums[len(g)].get(g[:-1], (0, 0))
        return p(g[1:]) if not total else (max(counts[len(g)].get(g, 0) - discount, 0) + discount * kinds * p(g[1:])) / total

    t = pad + text
    return -sum(np.log(p(t[i - order + 1:i + 1])) for i in range(order - 1, len(t))) / len(text)


@pytest.mark.parametrize("shard_entries", [1 << 18, 50])
def test_every_gram_is_kept(spark, shard_entries):
    """Many different grams, so that keys cut to fewer bits would meet; in one shard and in many."""
    rng = random.Random(9)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(n))
    rows = [(i, han(200), "zh" if i % 2 else "ja") for i in range(40 if shard_entries == 50 else 600)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), shard_entries=shard_entries, sample_rows=10)
    tests = [rows[0][1], rows[1][1], han(50), rows[3][1][:20] + han(20), "abc"]
    got = m.entropies(tests)
    for j, lang in enumerate(m.langs):
        mine = [t for _, t, x in rows if x == lang]
        assert np.allclose(got[:, j], [_brute_entropy(mine, t, 4) for t in tests], rtol=1e-9), lang


def test_rejection_cut_comes_from_all_rows(spark):
    """More texts than any sample: each language's cut is the quantile over all its own texts."""
    rng = random.Random(5)
    rows = [(i, _sentence(rng, WORDS[x], rng.randint(2, 5)), x) for i, x in enumerate(rng.choice(["aa", "oo"]) for _ in range(5000))]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), reject_share=0.01)
    for j, lang in enumerate(m.langs):
        own = m.entropies([t for _, t, x in rows if x == lang])[:, j]
        q = np.quantile(own, 0.99)
        assert m.cut[lang] == pytest.approx(q + (q - np.median(own)), rel=1e-9)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    sets = {"one": [2.5], "two": [1.0, 4.0], "same": [3.0] * 50, "many": rng.normal(size=777).tolist()}
    df = spark.createDataFrame([(g, v) for g, x in sets.items() for v in x], "g string, v double").repartition(5)
    got = langid.quantiles(df, "g", "v", (0.999, 0.5, 0.0, 1.0))
    assert {g: pytest.approx(np.quantile(x, [0.999, 0.5, 0, 1]).tolist()) for g, x in sets.items()} == {g: list(v) for g, v in got.items()}
    assert langid.quantiles(df.where("false"), "g", "v", (0.5,)) == {}


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert [r.lang_pred for r in langid.predict(df, model).collect()] == ["und", "und"]


def test_language_id_of_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing columns: an answer for each row."""
    model = langid.fit(odd_docs, sample_rows=100)
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    texts = {}
    for r in odd_docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, r.text)
    for r in rows:
        if r.doc_id is not None:
            letters = any(ch.isalpha() for ch in texts[r.doc_id] or "")
            assert (r.lang_pred, r.score) == (("en", 1.0) if letters else ("und", 0.0))
    assert len({(r.lang_pred, r.score, r.rejected) for r in rows if r.doc_id == 4}) == 1
    assert langid.predict(no_docs, model).count() == 0
    assert [r.lang_pred for r in langid.predict(odd_docs.where("doc_id = 9"), langid.fit(no_docs)).collect()] == ["und"]


# ---------------------------------------------------------------- quality

def _doc(rng, good):
    lines = [" ".join(rng.choice(["plain", "words", "of", "text", "here"]) for _ in range(rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(1, 9))]
    if not good:
        at = rng.sample(range(len(lines)), max(1, len(lines) * 2 // 3))
        for k in at:
            lines[k] = rng.choice([lines[k].upper() + "!!", "spam " * 20, lines[k].replace(" ", "### "), " | ".join(lines[k].split())])
    return "\n".join(lines)


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows = [(i, _doc(rng, i % 4 != 0), int(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality.fit(df.select("doc_id", "text"), df.where("doc_id % 3 != 1").select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.score(df, field).collect()}
    held = [(i, q) for i, _, q in rows if i % 3 == 1]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    kept = quality.keep_good(df, field)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted == 1}


def test_lines_of_a_mixed_document_are_told_apart(spark):
    rng = random.Random(6)
    rows = [(i, _doc(rng, i % 2 == 0), int(i % 2 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    fine = [x for _ in range(40) for x in _doc(rng, True).split("\n")][:60]
    poor = [x.upper() + "!!" for x in fine[:30]]
    own, _, per = quality.line_features(["\n".join(fine[:30] + poor + fine[30:])])
    p = field.marginals(own, per)
    assert np.median(p[:30]) > 0.8 and np.median(p[30:60]) < 0.2 and np.median(p[60:]) > 0.8


def test_one_row_of_an_id_counts(spark):
    rng = random.Random(9)
    rows = [(i, _doc(rng, i % 2 == 0), int(i % 2 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality")
    one = quality.fit(df.select("doc_id", "text"), labels)
    many = quality.fit(df.select("doc_id", "text").union(df.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text")).repartition(7), labels)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.moves, many.moves)


def _plain_features(text):
    """The features of each line, character by character."""
    lines = text.split("\n")
    out = []
    for line in lines:
        raw = line.encode()
        n = max(1, len(raw))
        words = [w.encode() for w in re.findall(r"[^\x20\x09\x0b-\x0d]+", line)]
        many = max(1, len(words))
        of = lambda chars: sum(c in chars for c in raw)
        upper, lower, space = of(string.ascii_uppercase.encode()), of(string.ascii_lowercase.encode()), of(b" \t\r\x0b\x0c")
        symbols = b"#$%&*@=+<>^~\\{}[]_/"
        out.append([math.log1p(len(raw)), upper / max(1, upper + lower), of(b"0123456789") / n, of(symbols) / n, of(b"|") / n, of(b"!?") / n, of(b".,;:") / n, space / n,
                    sum(c > 127 for c in raw) / n, math.log1p(len(words)), (len(raw) - space) / many, sum(x == y for x, y in zip(words, words[1:])) / many,
                    len(set(words)) / many, sum(w[-1] in symbols + b"!?" for w in words) / many, len(raw) > 0 and lines.count(line) > 1, not raw])
    return np.array(out, float)


def test_score_equals_brute_force():
    rng = np.random.default_rng(4)
    n = quality.N_OWN
    field = quality.LineField(rng.normal(size=n), rng.uniform(0.5, 2, n), rng.normal(size=3 * n + 1) / 4, rng.normal(size=(2, 2)))
    texts = ["One line.", "", "a a b\n\nA|B | 12!?\na a b", "naïve  été\tx_y {z}\r\nEND!! the the\n  \n#1 #1", "x\n" * 6]
    for text, got in zip(texts, field.scores(texts)):
        own = (_plain_features(text) - field.mean) / field.scale
        pad = np.zeros((1, n))
        x = np.concatenate([own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad]), np.ones((len(own), 1))], 1)
        s, total, ones = x @ field.weights, 0.0, 0.0
        for bits in itertools.product([0, 1], repeat=len(s)):
            w = np.exp(sum(v for v, y in zip(s, bits) if y) + sum(field.moves[i, j] for i, j in zip(bits, bits[1:])))
            total, ones = total + w, ones + w * np.array(bits)
        length = np.array([len(line.encode()) + 1 for line in text.split("\n")])
        assert abs((ones / total * length).sum() / length.sum() - got) < 1e-5, text


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    per = np.array([4, 1, 6, 2])
    s, a = rng.normal(size=per.sum()), rng.normal(size=(2, 2))
    m, b = quality.messages(s, a, per)
    p = 1 / (1 + np.exp(-(m + b)))
    at = 0
    for n in per:
        total, ones = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(s[at + k] for k in range(n) if y[k]) + sum(a[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(p[at:at + n], ones / total)
        at += n


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (None, 1), (3, None), (777, 1)], "doc_id long, quality int")
    field = quality.fit(odd_docs, labels)
    rows = quality.score(odd_docs, field).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    same = [r.score for r in rows if r.doc_id == 4]
    assert same[0] == same[1]
    assert quality.score(no_docs, field).count() == 0
    bare = quality.fit(no_docs, labels)
    assert {r.score for r in quality.score(odd_docs, bare).collect()} == {0.5}


# ---------------------------------------------------------------- decontamination

def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _best(item, doc):
    """Edits of the nearest part of a document, by trying them all."""
    n = len(item)
    return min((_levenshtein(item, doc[i:j]) for i in range(len(doc) + 1) for j in range(i, min(len(doc), i + 2 * n) + 1)), default=n)


def test_edits_within_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        item, text = rng.integers(1, 5, rng.integers(1, 7)), rng.integers(0, 5, rng.integers(0, 12))
        best = _best(item.tolist(), text.tolist())
        got = decontam.edits_within(item, text, len(item))
        assert got[0] == best and _levenshtein(item.tolist(), text[got[1]:got[2]].tolist()) == best
        assert best == 0 or decontam.edits_within(item, text, best - 1) is None


def _prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnprst") * rng.randint(0, 2) for _ in range(n)]


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(8)
    items = [(k, _prose(rng, rng.choice([6, 14, 15, 30, 55]))) for k in range(60)]
    docs, exact, edited = [], set(), set()
    for d in range(300):
        body = _prose(rng, rng.randint(0, 150))
        if d % 3 == 0:
            k, w = rng.choice(items)
            w = list(w)
            if d % 2:
                for p in rng.sample(range(len(w)), len(w) // 10):
                    w[p] = "qqq"
                edited.add((d, k))
            else:
                exact.add((d, k))
            at = rng.randint(0, len(body))
            body = body[:at] + w + body[at:]
        docs.append((d, (", " if d % 4 else "\n").join(body).upper() if d % 5 == 0 else " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in items], "item_id long, text string")
    rows = decontam.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert exact <= got and len(edited - got) <= 0.05 * len(edited)
    words = {d: [x.decode() for x in decontam.words_of(t)] for d, t in docs}
    for r in rows:  # exact verification, spans included
        w = dict(items)[r.item_id]
        part = words[r.doc_id][r.first_word:r.first_word + r.n_words]
        assert _levenshtein(w, part) == r.edits <= 0.2 * len(w)
    assert all(_best(dict(items)[k], words[d]) <= 0.2 * len(dict(items)[k]) for d, k in got - exact - edited)
    kept = {r.doc_id for r in decontam.clean_rows(df, bench).collect()}
    assert kept == set(words) - {d for d, _ in got}
    # small blocks of the benchmark give the same
    more = decontam.contaminated(df, bench, block_bytes=1500).collect()
    assert exact <= {(r.doc_id, r.item_id) for r in more}


@pytest.mark.parametrize("rate", [0.15, 0.2])
def test_recall_at_the_most_edits(rate):
    """Every length, with edits up to the highest rate that counts."""
    rng = random.Random(31)
    items = [(k, _prose(rng, n)) for k, n in enumerate(n for n in (10, 20, 45, 60) for _ in range(60))]
    text = {k: " ".join(w) for k, w in items}
    for rounds in (64, 1):  # after one round the items still missed are looked up exactly
        search = decontam.Searcher(list(text.items()), most_rounds=rounds)
        found = {n: [] for n in (10, 20, 45, 60)}
        for k, w in items:
            for _ in range(3):
                new = [[x] for x in w]
                for p in rng.sample(range(len(w)), int(rate * len(w) + 1e-9)):
                    x = rng.choice(["qqq", *_prose(rng, 1)])
                    new[p] = rng.choice([[], [x], [x, *new[p]]])
                body = [*_prose(rng, 30), *(x for y in new for x in y), *_prose(rng, 30)]
                found[len(w)].append(k in {x[1] for x in search.find([" ".join(body)])})
        assert all(np.mean(x) >= 0.93 for x in found.values()), (rounds, {n: np.mean(x) for n, x in found.items()})


def test_short_trimmed_texts_are_found_in_any_batch():
    """A text that is an item without its first and last words, alone and between others."""
    rng = random.Random(12)
    items = [(k, _prose(rng, rng.choice([10, 20, 30, 45]))) for k in range(25)]
    search = decontam.Searcher([(k, " ".join(w)) for k, w in items])
    texts = []
    for _, w in items:
        most = len(w) // 5
        for s in range(most + 1):
            texts += [" ".join(w[s:len(w) - (most - s)]), " ".join(_prose(rng, rng.randint(0, 6))), ""]
    alone = {(d, *x[1:]) for d, t in enumerate(texts) for x in search.find([t])}
    assert set(search.find(texts)) == alone
    trimmed = [(d, k) for d, t in enumerate(texts) for k, w in items if len(t.split()) >= 0.8 * len(w) and t in " ".join(w)]
    assert len(trimmed) > 100 and len(set(trimmed) - {x[:2] for x in alone}) <= 0.05 * len(trimmed)
    for d, i, edits, *_ in alone:
        assert edits == _best(dict(items)[i], texts[d].split()) <= 0.2 * len(dict(items)[i])


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same line here and there"), (1, "same line here and there"), (2, None), (3, ""), (None, "ok"), (5, "!!")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(odd_docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (4, 1), (4, 1), (None, 1), (9, None)], key=str)
    assert decontam.contaminated(no_docs, bench).count() == 0
    kept = decontam.clean_rows(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 15 - 5 and kept.where("doc_id IS NULL").count() == 1
    assert decontam.contaminated(odd_docs, bench.where("item_id = 99")).count() == 0
    loops = spark.createDataFrame([(1, "the " * 50_000)], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two the the the the the the six seven eight nine ten end of it")], "item_id long, text string")
    assert decontam.contaminated(loops, item).count() == 0


# ---------------------------------------------------------------- chat

def brute_turns(rows):
    """By conversation: turns hash, loss hash and sizes straight from the source."""
    by = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    out = {}
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["[INST ", "[INST] ", "[/INST]", "<s>", "</s>", "\\", "]", "*", "\n", "hello ", "é", "[", "<", "\\l", ""]
    text = lambda k: "".join(rng.choice(bits) for _ in range(rng.randint(0, k)))
    rows = [(rng.randint(0, 40), n % 9, rng.choice(["user", "assistant", "system", "as]s*", "x*", "x\\", None]), rng.choice([None, text(9), text(3)])) for n in range(600)]
    rows += [(None, None, None, None), (7, 3, "user", "same"), (7, 3, "user", "same"), (99, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(5)
    pieces = chat.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces).collect()}
    assert got == brute_turns(rows)
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
    for c, s in whole.items():
        assert len(chat.parse(s)) == got[c][0]
    chars = {r.conv_id: r.formatted_chars for r in chat.read_back(pieces).collect()}
    assert chars == {c: len(s) for c, s in whole.items()}
    assert chat.read_back(chat.format_turns(df.where("conv_id = 12345"))).count() == 0


def test_plain_turns_stay_plain_and_bad_text_is_refused():
    assert chat.write_turn("user", "hello [1] <b> \\n")[0] == "[INST user]hello [1] <b> \\n[/INST]"
    for bad in ("", "<s>", "<s>[INST user]x</s>", "<s>[INST user]x[/INST]", "<s>[INST user]x[/INST]</s>y"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


# ---------------------------------------------------------------- nearest neighbours

def _exact(rows, k):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float32).astype(float)
    n = np.sqrt((v * v).sum(1))
    out = {}
    for p, i in enumerate(ids):
        if i % 50 == 0:
            s = (v * v[p]).sum(1) / (n * n[p])
            order = [q for q in np.lexsort((ids, -s)) if ids[q] != i][:k]
            out[i] = [(ids[q], s[q]) for q in order]
    return out


@pytest.mark.parametrize("block", [16_384, 300])
def test_nearest_recall_and_exact_scores(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(size=24) * 0.7).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[50][1]) for i in range(400)]  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = _exact(rows, 5)
    got = {}
    for r in sorted(ann.nearest(df, block_rows=block).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    assert sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    for q in want:
        exact = {x: s for x, s in _exact([r for r in rows if r[0] == q or r[0] in {x for x, _ in got[q]}], 5)[q]}
        assert all(abs(exact[x] - s) < 1e-12 for x, s in got[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
    assert [x for x, _ in got[50]] == [5000, 5001, 5002, 5003, 5004]  # ties: smaller ids


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, []),
            (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect()]
    assert sorted(got) == [(0, 1, 1, 0.707107), (0, 2, 2, -1.0)]
    assert ann.nearest(df.where("vec_id = 12345")).count() == 0


def _verified(v: np.ndarray, asked: np.ndarray, k: int = 5, dims: int = 12):
    """Recall of a shard's search and the share of pairs it verified."""
    axes = np.random.default_rng(1).standard_normal((dims, v.shape[1]))
    shard = ann.Shard(np.arange(len(v)), v, axes)
    who, vec, _, verified = shard.search(asked, v[asked], np.full(len(asked), -np.inf), k, ann.chi_square_quantile(0.97, dims))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit[asked] @ unit.T
    cos[np.arange(len(asked)), asked] = -2
    best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    found = {(q, x) for q, x in zip(who.tolist(), vec.tolist())}
    return sum((i, x) in found for i, row in enumerate(best.tolist()) for x in row) / best.size, verified / (len(v) * len(asked))


def test_stopping_test_skips_vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    recall, share = _verified(centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 64)) * 0.2, np.arange(0, 6000, 50))
    assert recall >= 0.95 and share < 0.1
    # vectors without any structure: what lies beyond the reach is still left out
    recall, share = _verified(rng.normal(size=(6000, 64)), np.arange(0, 6000, 50))
    assert recall >= 0.9 and share < 0.9


def test_nearest_of_routed_cells(spark):
    """Far clusters lie in cells of their own, which other queries' tests close."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(16, 16))
    rows = [(i, (centres[i % 16] + rng.normal(size=16) * 0.1).tolist()) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, block_rows=200, max_cells=16).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r["rank"]))
    want = _exact(rows, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_nearest_of_huge_and_tiny_components(spark):
    df = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [-3e-310, -3e-310]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6)) for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"])]
    assert got == [(3, 1.0), (1, 0.707107), (2, -1.0)]


def test_chi_square_quantile():
    for dims, p, want in [(1, 0.95, 3.841459), (2, 0.5, 1.386294), (6, 0.95, 12.591587), (10, 0.99, 23.209251)]:
        assert abs(ann.chi_square_quantile(p, dims) - want) < 1e-5
