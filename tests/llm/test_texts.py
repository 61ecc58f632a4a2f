"""Leaked passages, source mixing and splitting."""

import random

import numpy as np
import pytest

from nearfold.llm import leaks, mixing, splitting, tokens
from nearfold.llm.words import Hasher, word_blocks, words

PATH = tokens.default_path()
VOCABULARY = [f"wort{i}" for i in range(60)] + ["Ünder", "ｆｕｌｌ", "ﬁne", "日本語", "x²"]


def test_words():
    assert words("ＡＢ c_d,é ﬁ２") == ["ab", "c", "d", "é", "fi2"] and words(None) == words("") == words(" _ ") == []


def test_word_blocks():
    t = " ".join(f"w{i}" for i in range(25))
    got = list(word_blocks(t, 10, 3))
    assert got[0] == words(t)[:10] and got[1] == words(t)[7:20] and got[2] == words(t)[17:] and len(got) == 3
    assert list(word_blocks("", 10, 3)) == [] and [len(b) for b in word_blocks(t, 25, 3)] == [25]


def brute_leaks(docs, items, n):
    index = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + n]), ()) if d is not None}
    return out


def texts(seed):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, sentence(rng.randint(3, 40))) for i in range(30)] + [(30, None), (31, ""), (32, "too short")]
    docs = []
    for d in range(200):
        t = sentence(rng.randint(0, 60))
        if rng.random() < 0.4:
            w = items[rng.randrange(30)][1].split()
            k, n = rng.randrange(len(w)), rng.randint(1, 30)
            t += rng.choice([" ", "\n\n", ", "]) + " ".join(w[k : k + n]).upper() + ". " + sentence(5)
        docs.append((d, t))
    long = sentence(50_000) + " " + items[0][1]
    return [*docs, docs[0], (500, None), (501, " "), (None, items[0][1]), (502, long)], items


@pytest.mark.parametrize("window", [1, 5, 12])
def test_leaks_equal_brute_force(spark, window, monkeypatch):
    docs, items = texts(window)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for chars in (leaks.BROADCAST_CHARS, 500):
        got = leaks.leaked(d, i, window=window, broadcast_chars=chars)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items, window)
    assert got.filter("edits > 0").count() == 0
    # Long texts in small blocks: the same pairs and as many windows.
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    again = leaks.leaked(d, i, window=window)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert leaks.leaked(d.filter("false"), i, window=window).count() == leaks.leaked(d, i.filter("false"), window=window).count() == 0


def test_edited_passages_are_found(spark):
    rng = random.Random(3)
    words_ = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words_, 16))) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split()
        k = rng.randrange(1, 15)
        w = [w[:k] + ["other"] + w[k + 1 :], w[:k] + ["other"] + w[k:], w[:k] + w[k + 1 :]][i % 3]
        docs.append((i, " ".join(rng.sample(words_, 20) + w + rng.sample(words_, 20))))
    df = lambda x, n: spark.createDataFrame(x, f"{n} long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.leaked(df(docs, "doc_id"), df(items, "item_id"), window=16, max_edits=1).collect()}
    assert all(e == 1 for e in got.values()) and all(d == i for d, i in got)
    for kind in range(3):
        must = [i for i, _ in items if i % 3 == kind]
        assert sum((i, i) in got for i in must) / len(must) >= 0.95


@pytest.mark.parametrize("block, chars", [(leaks.BLOCK_WORDS, leaks.BROADCAST_CHARS), (40, leaks.BROADCAST_CHARS), (40, 100)])
def test_changed_added_and_dropped_words_are_found(spark, block, chars, monkeypatch):
    """Each kind of edit at the target recall, anywhere in the passage, also over the ends of blocks and in a text of the passage alone."""
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words_, 16))) for i in range(180)]
    docs = []
    for i, t in items:
        w, k = t.split(), rng.randrange(16)
        w = [w[:k] + ["other"] + w[k + 1 :], w[:k] + ["other"] + w[k:], w[:k] + w[k + 1 :]][i % 3]
        n = rng.choice([0, 20, 30])
        docs.append((i, " ".join(rng.sample(words_, n) + w + rng.sample(words_, n))))
    df = lambda x, n: spark.createDataFrame(x, f"{n} long, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    rows = leaks.leaked(df(docs, "doc_id"), df(items, "item_id"), window=16, max_edits=1, broadcast_chars=chars).collect()
    assert all(r.doc_id == r.item_id and r.edits <= 1 and 1 <= r.windows <= 3 for r in rows)
    found = {r.doc_id for r in rows}
    for kind in range(3):
        assert np.mean([i in found for i in range(kind, 180, 3)]) >= 0.95


def test_edit_distance():
    a = "a b c d e".split()
    assert leaks.edit_distance(a, a, 0) == 0 and leaks.edit_distance(a, "a b x d e".split(), 1) == 1
    assert leaks.edit_distance(a, "b c d e f".split(), 2) == 2 and leaks.edit_distance(a, "v w x y z".split(), 2) == 3


def test_equal_windows_embed_alike():
    h = Hasher()(["a", "b", "c", "d"] * 5 + [f"w{i}" for i in range(40)])
    for r in range(3):
        x = leaks.embed_hashes(h, np.arange(50), 8, r, 6, 16)
        assert x[0] == x[4] == x[8] and len({x[20], x[30], x[40]}) == 3


def test_an_edit_in_one_half_leaves_the_track_from_the_other_end():
    h = Hasher()([f"w{i}" for i in range(16)])
    other = h.copy()
    other[13] = 7
    back = lambda x, r: leaks.embed_hashes(x[::-1], np.array([0]), 16, r, 5, 16)[0]
    front = lambda x, r: leaks.embed_hashes(x, np.array([0]), 16, r, 5, 16)[0]
    assert np.mean([front(h, r) == front(other, r) for r in range(40)]) > 0.9
    assert np.mean([back(h, r) == back(other, r) for r in range(40)]) < 0.5


SOURCES = "doc_id long, source string, text string, rate string, tokens int"
TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.15, 2), ("none", 0.05, 9)]


def mixture(spark):
    docs = [(i, "big", "ten words are in this text and some more here", "", 0) for i in range(600)]
    docs += [(1000 + i, "small", "ten words are in this text and some more here", "", 0) for i in range(150)]
    docs += [(2000 + i, "tiny", "few words", "", 0) for i in range(40)]
    docs += [(3000, None, "x y", "", 0), (3001, "unlisted", "x y", "", 0), (3002, "big", None, "", 0), (3003, "big", "", "", 0)]
    sized = mixing.sized_documents(spark.createDataFrame(docs, SOURCES))
    return docs, sized, mixing.rates(mixing.source_sizes(sized, spark.createDataFrame([*TARGETS, (None, 0.1, 1)], "source string, target_share double, max_repeats int")))


def test_mix_follows_targets_and_caps(spark):
    docs, sized, rated = mixture(spark)
    size = {}
    for _, s, t, *_ in docs:
        size[s] = size.get(s, 0) + tokens.count(t, PATH)
    total = sum(size.get(s, 0) for s, *_ in TARGETS)
    by = {r.source: r for r in rated.collect()}
    assert set(by) == {s for s, *_ in TARGETS}
    for s, share, cap in TARGETS:
        assert by[s].tokens == size.get(s, 0) and by[s].short == (cap * size.get(s, 0) < share * total)
        assert abs(by[s].rate - (min(cap, share * total / size[s]) if size.get(s) else 0)) < 1e-9
    mixed = mixing.mix(sized, rated, 5)
    rows = sorted((r.doc_id, r.copy_no) for r in mixed.collect())
    assert rows == sorted((r.doc_id, r.copy_no) for r in mixing.mix(sized.repartition(3), rated, 5).collect())
    per = {}
    for r in mixed.collect():
        per[r.source, r.doc_id] = per.get((r.source, r.doc_id), 0) + 1
    cap = {s: c for s, _, c in TARGETS}
    assert all(n <= cap[s] for (s, _), n in per.items()) and {s for s, _ in per} == {"big", "small", "tiny"}
    for s in ("big", "small"):
        used = sum(n * tokens.count(docs_text(docs, d), PATH) for (x, d), n in per.items() if x == s)
        assert abs(used / total - by[s].rate * size[s] / total) < 0.05
    report = {r.source: r for r in mixing.mix_report(rated, mixed).collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["none"].used_tokens == 0


def test_the_closest_total_reaches_the_targets(spark):
    docs, sized, _ = mixture(spark)
    sizes = mixing.source_sizes(sized, spark.createDataFrame(TARGETS[:3], "source string, target_share double, max_repeats int"))
    rated = mixing.rates(sizes, "closest")
    report = {r.source: r for r in mixing.mix_report(rated, mixing.mix(sized, rated, 5)).collect()}
    best = {r.source: r for r in mixing.mix_report(mixing.rates(sizes), mixing.mix(sized, mixing.rates(sizes), 5)).collect()}
    off = lambda x: sum(abs(x[s].actual_share - t / 0.95) for s, t, _ in TARGETS[:3])
    assert off(report) < 0.2 < off(best) and [s for s, r in report.items() if r.short] == [s for s, r in best.items() if r.short]
    assert mixing.closest_total(sizes.filter("false")) == 0


def docs_text(docs, doc_id):
    return next(t for i, _, t, *_ in docs if i == doc_id)


def test_mix_of_nothing(spark):
    _, sized, rated = mixture(spark)
    assert mixing.mix(sized.filter("false"), rated).count() == mixing.mix(sized, rated.filter("false")).count() == 0


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        kind = rng.random()
        w = " ".join(rng.choice(["alpha", "über", "naïve", "don't", "42", "x_1", "日本"]) for _ in range(rng.randint(3, 25)))
        out.append(w + rng.choice([". ", "! ", "?\n", "\n\n", " ", "。"]) if kind < 0.95 else "\t\t  " + w + "   \n \n")
    return "".join(out)


def odd_texts():
    return {
        1: prose(1, 9_000), 2: prose(2, 300_000), 3: "short", 4: "", 5: None, 6: "a" * 20_000, 7: "日本語の文章。" * 3_000, 8: " " * 30_000,
        9: "\n\n".join(prose(i, 200) for i in range(100)), 10: "🙂" * 5_000, 11: "word " * 1024, 12: "word " * 1000,
    }


def by_doc(pieces):
    got = {}
    for r in pieces.orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    return got


@pytest.mark.parametrize("size", [65_536, 5_000])
def test_pieces_cover_overlap_and_fit(spark, size):
    all_ = odd_texts()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in all_.items()] + [(None, "x " * 3000, 1, 2)], "doc_id long, text string, start int, piece_no int")
    got = by_doc(splitting.split_oversized(d, range_chars=size))
    assert set(got) == {i for i, t in all_.items() if tokens.count(t, PATH) > 1024}
    for i, pieces in got.items():
        t = all_[i]
        assert [p.piece_no for p in pieces] == list(range(len(pieces))) and pieces[0].start == 0 and pieces[-1].end == len(t)
        for p in pieces:
            assert t[p.start : p.end] == p.text and p.tokens <= 1024
            assert tokens.count(p.text, PATH) <= 1024 + 8 * (i in (6, 8, 10))
        for a, b in zip(pieces, pieces[1:]):
            assert a.start < b.start < a.end < b.end
            if i in (1, 2, 9):
                assert 60 <= tokens.count(t[b.start : a.end], PATH) <= 70
    kinds = [splitting.boundary(all_[i], p.end) for i in (1, 2, 9) for p in got[i]]
    assert min(kinds) >= 1 and np.mean([k >= 3 for k in kinds]) > 0.95


def test_ranges_do_not_change_the_pieces(spark):
    """Also for text without spaces, and for runs of one class that are longer than a range."""
    texts_ = {1: prose(4, 60_000), 2: "".join(random.Random(1).choice(["日本語", "文章", "、", "です。"]) for _ in range(20_000)), 3: "ab" * 9_000 + " end. " + prose(5, 20_000)}
    d = spark.createDataFrame(list(texts_.items()), "doc_id long, text string")
    whole = by_doc(splitting.split_oversized(d, range_chars=1_000_000))
    assert set(whole) == {1, 2, 3}
    for size in (9_000, 3_333):
        assert by_doc(splitting.split_oversized(d, range_chars=size)) == whole
    with pytest.raises(ValueError):
        splitting.split_oversized(d, limit=300, overlap=64)


def test_a_cut_further_back_at_a_sentence_wins_over_a_word_end(spark):
    t = " ".join(f"w{i}" for i in range(300)) + ". " + " ".join(f"v{i}" for i in range(500))
    first = splitting.split_oversized(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("piece_no").first()
    assert first.text.rstrip().endswith(".")


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    """A file as a cell of the same text, whatever the ranges; empty and short files give nothing."""
    t = prose(7, 200_000)
    (tmp_path / "a.txt").write_text(t, newline="")
    (tmp_path / "b.txt").write_text("short", newline="")
    (tmp_path / "c.txt").write_text("", newline="")
    raw = t.encode()
    results = []
    for size in (1 << 20, 30_001, 7_777):
        got = splitting.split_files(spark, str(tmp_path), range_bytes=size).orderBy("piece_no").collect()
        assert all(r.path.endswith("a.txt") and raw[r.start : r.end].decode() == r.text and r.tokens <= 1024 for r in got)
        assert got[0].start == 0 and got[-1].end == len(raw) and all(a.start < b.start < a.end < b.end for a, b in zip(got, got[1:]))
        results.append([(r.start, r.end) for r in got])
    assert results[0] == results[1] == results[2] and len(results[0]) > 20


def test_a_large_file_needs_no_task_that_holds_it(spark, tmp_path):
    """24 MB in ranges of 1 MB: no range and no piece is read with more than a few of them."""
    one = prose(8, 400_000)
    with open(tmp_path / "big.txt", "w", newline="") as f:
        for _ in range(60):
            f.write(one)
    got = splitting.split_files(spark, str(tmp_path / "big.txt"))
    row = got.selectExpr("count(*) n", "max(tokens) m", "max(`end`) e", "sum(tokens) t").first()
    size = (tmp_path / "big.txt").stat().st_size
    assert row.e == size and row.m <= 1024 and row.n > 5_000
    with splitting.FileText(f"file://{tmp_path}/big.txt") as f:
        assert f.size == size and f.safe_place(size // 2) - size // 2 < 100 and len(f.text(0, 10).encode()) == 10


def test_safe_places_are_where_the_tokenizer_cuts():
    """Tokens of the parts are the tokens of the whole, at every safe place."""
    rng = random.Random(9)
    for t in (prose(6, 3_000), "".join(rng.choice("ab1 2.,'\n日本。sd'") for _ in range(3_000))):
        n = tokens.count(t, PATH)
        at = 0
        while (at := splitting.safe_place(t, at + 1)) < len(t):
            assert tokens.count(t[:at], PATH) + tokens.count(t[at:], PATH) == n


def test_token_starts():
    for t in ("plain text, here.", "日本語 🙂 naïve", " \n x"):
        s = tokens.token_starts(t, PATH)
        assert len(s) == tokens.count(t, PATH) and s[0] == 0 and (np.diff(s) >= 0).all() and s[-1] < len(t)
