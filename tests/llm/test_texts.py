import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chunking as K
from plumbline.llm import encoding as X
from plumbline.llm import leakage as L
from plumbline.llm import packing as P

WORDS = "amber basin canopy dense ember flat garden harbor inlet joint kiln ledger marsh nickel orchard pallet quarry ribbon silo tariff urn valve wharf yarrow zephyr".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (rnd.choice(".,;\n") if rnd.random() < 0.2 else "") for _ in range(n))


# --- pieces ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [prose(1, 6000), "x" * 30_000, "\r\n" * 9000, "é\u0301" * 9000, "😀" * 8001, "a" * 8001])
def test_pieces_cover_overlap_and_fit(text):
    cuts = K.cut_points(text, 8000, 200)
    assert cuts[0] == 0 and cuts[-1] == len(text) and cuts == sorted(set(cuts))
    starts = [0] + [c - 200 for c in cuts[1:-1]]
    assert all(b - a <= 8000 for a, b in zip(starts, cuts[1:]))
    assert "".join(text[a:b] for a, b in zip(cuts, cuts[1:])) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(10, 80), st.integers(0, 4))
def test_pieces_of_any_text(text, limit, overlap):
    cuts = K.cut_points(text, limit, overlap)
    assert cuts[0] == 0 and cuts[-1] == len(text)
    assert all((b - a + (overlap if i else 0)) <= limit for i, (a, b) in enumerate(zip(cuts, cuts[1:])))


def test_edits_alter_neighbouring_pieces_only():
    text = prose(2, 40_000)
    at = len(text) // 2
    edited = text[:at] + " inserted words here " + text[at:]
    a, b = ({t[x:y] for x, y in zip(K.cut_points(t), K.cut_points(t)[1:])} for t in (text, edited))
    assert len(b - a) <= 3 and len(a) > 20


def test_cuts_snap_to_boundaries():
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(2000))
    assert all(text[c - 1] == "\n" for c in K.cut_points(text)[1:-1])


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, "x" * 8000, "p"), (2, "y" * 8001, "p"), (3, None, "p"), (4, "", "p"), (2, "y" * 8001, "p")], "id bigint, content string, piece string")
    got = K.split_oversized(df, ["id"], "content").collect()
    assert {r.id for r in got} == {2} and len(got) == 4 and all(len(r.text) == r.length <= 8000 for r in got)
    assert K.split_oversized(df.limit(0), ["id"], "content").count() == 0


# --- packing --------------------------------------------------------------------------------------------------------------------------


def test_hilbert_is_a_bijection_of_neighbours():
    n = 1 << 3
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = P.hilbert(grid, 3)
    assert sorted(key) == list(range(n**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=300))
def test_packer_never_overfills(sizes):
    p, used = P.Packer(100, 0), {}
    for s in sizes:
        c = p.put(s)
        used[c] = used.get(c, 0) + s
    assert all(v <= 100 for v in used.values())


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    docs = [(i, prose(i, 20 + i * 7 % 300), 5) for i in range(200)] + [(500, prose(3, 9000), 5), (501, "", 5), (502, None, 5), (503, prose(9, 50), 5), (503, prose(9, 50), 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, tokens int")
    got = P.pack(df, capacity=512).collect()
    used, by = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.tokens))
    assert max(used.values()) <= 512
    for i, text, _ in docs[:203]:
        if text is None:
            assert i not in by
            continue
        n = P.count_tokens([text], P.default_tokenizer())[0]
        parts = sorted(by[i])
        assert sum(t for *_, t in parts) == n and (len(parts) == 1) == (n <= 512)
        assert [s for _, s, _ in parts] == [512 * j for j in range(len(parts))]
    assert len(by[503]) == 2
    assert P.usage(P.pack(df, capacity=512), 512).first().used > 0.9
    assert P.pack(df.limit(0)).count() == 0


def test_long_texts_have_the_tokens_of_their_parts():
    pytest.importorskip("public_tokenizers")
    text = "\n".join(prose(i, 40).replace("\n", " ") for i in range(1200))
    path = P.default_tokenizer()
    rows = [text, text.replace("\n", "\n\n  "), text.replace(" ", "")[:250_000], "a b" * 80_000, "word " + "x" * 3_001 + " \n\n" * 50_000]
    assert P.count_tokens(rows, path) == [len(P._encoder(path).encode_ordinary(t)) for t in rows]


# --- leaks ----------------------------------------------------------------------------------------------------------------------------


def levenshtein_search(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.lists(st.integers(-1, 4), max_size=30))
def test_bit_parallel_distance(pattern, text):
    want = levenshtein_search(pattern, [x if x >= 0 else 99 for x in text])
    got = L.edit_distance_within(pattern, text, len(pattern))
    assert (got[0] if got else len(pattern)) == want


def fresh(seed, n):
    rnd = random.Random(seed)
    return [f"{rnd.choice(WORDS)}{rnd.randrange(500)}" for _ in range(n)]


def leaks(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in L.find_leaks(d, q, **k).collect()}


def test_leaks(spark):
    item, short = fresh(1, 120), fresh(2, 9)
    noise = lambda s, n=80: " ".join(fresh(s, n))
    passage = item[40:68]
    swapped = [w if i % 11 != 5 else "other" for i, w in enumerate(passage)]
    docs = [
        (1, noise(10) + " " + " ".join(passage) + " " + noise(11)),
        (2, noise(12) + "\n> " + ", ".join(w.upper() for w in swapped) + "\n" + noise(13)),
        (3, noise(14) + " " + " ".join(item[40:52]) + " " + noise(15)),
        (4, noise(16)),
        (5, None),
        (6, ""),
        (7, "{\"p\": \"" + "\\n".join(f"<b>{w}</b>&nbsp;" for w in item) + "\"}"),
        (8, noise(17) + " " + " ".join(short) + " " + noise(18)),
        (9, noise(10) + " " + " ".join(passage) + " " + noise(11)),
        (10, noise(19, 30_000) + " " + " ".join(passage)),
        (11, noise(20) + " " + " ".join(passage[:14] + passage[15:]) + " " + noise(21)),
    ]
    got = leaks(spark, docs, [(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "")])
    assert got == {(1, 1), (2, 1), (7, 1), (8, 2), (9, 1), (10, 1), (11, 1)}
    assert leaks(spark, docs, []) == set() and leaks(spark, [], [(1, "a b")]) == set()


def test_short_items_are_found_by_their_pieces_as_by_search_of_all():
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 19)))) for i in range(60)]
    ix = L.build_index(items)
    for d in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for i, t in rnd.sample(items, 3):
            part = t.split()
            for _ in range(rnd.randint(0, len(part) // 6)):
                part[rnd.randrange(len(part))] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        ids = np.array([ix.vocabulary.get(t, -1) for t in text], np.int32)
        want = {i for (i, _), item in zip(items, ix.lists) if L.edit_distance_within(item, ids.tolist(), len(item) // 6)}
        assert {m[0] for m in L.match(ids, ix)} == want


def test_passages_in_scripts_without_blanks():
    import random

    rnd = random.Random(5)
    item = "".join(chr(rnd.randrange(0x4E00, 0x5E00)) for _ in range(300))
    cut = list(item[80:220])
    cut[30], cut[90] = "的", "了"
    ix = L.build_index([(1, item[:150] + "。" + item[150:])])
    find = lambda t: L.match(np.array([ix.vocabulary.get(x, -1) for x in L.tokens(t)], np.int32), ix)
    assert [m[0] for m in find("前" + "".join(cut) + "、後")] == [1]
    assert find(item[80:110]) == []  # fifteen words are too few
    assert L.tokens_and_words("ab 漢字漢 c漢d")[1] == [0, 1, 1, 2, 3, 4, 5]


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    docs = spark.createDataFrame([(i, " ".join(fresh(i, 60))) for i in range(12)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(fresh(i, 60))) for i in range(0, 12, 2)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in L.find_leaks(docs, items).collect()) == [(i, i) for i in range(0, 12, 2)]
    assert L.find_leaks(docs, items.limit(0)).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    a, b = fresh(5, 60), fresh(6, 60)
    docs = [(1, " ".join(a[10:50])), (2, " ".join(b[5:45]))]
    monkeypatch.setattr(L, "BLOCK_CHARS", 100)
    assert leaks(spark, docs, [(1, " ".join(a)), (2, " ".join(b))]) == {(1, 1), (2, 2)}


# --- encodings ------------------------------------------------------------------------------------------------------------------------

SENTENCES = ["Für jede Größe genügt eine kürzere Übersicht.", "La fenêtre paraît trop étroite, où la clé a été déplacée.", "Мы перенесли раздел, потому что журнал устарел.", "キャッシュを読み込んで索引を更新する。", "先读取函数，然后更新缓存。", "A “quoted” café — it’s naïve, 10 µs for €5 … déjà vu.", "La sesión está diseñada para mañana."]


def corpus():
    rnd = random.Random(3)
    return [" ".join(rnd.choice(SENTENCES) for _ in range(4)) + f" Item {i}." for i in range(400)]


def garble(text, meant, read):
    return text.encode(meant).decode(read, "replace")


CASES = [
    (SENTENCES[0], garble(SENTENCES[0], "utf-8", "latin-1")),
    (SENTENCES[1], garble(garble(SENTENCES[1], "utf-8", "latin-1"), "utf-8", "latin-1")),
    (SENTENCES[2], garble(SENTENCES[2], "cp1251", "latin-1")),
    (SENTENCES[3], garble(SENTENCES[3], "euc_jp", "latin-1")),
    (SENTENCES[0], garble(SENTENCES[0], "utf-8", "latin-1").encode("ascii", "xmlcharrefreplace").decode()),
    (SENTENCES[2], garble(SENTENCES[2], "koi8-r", "cp1251")),
    (SENTENCES[6], garble(SENTENCES[6], "cp1252", "mac_roman")),
]


@pytest.fixture(scope="module")
def table():
    pair, n = np.unique(np.concatenate([X._pairs(X._codes(f" {t} ")) for t in corpus()]), return_counts=True)
    return X.pair_table(np.append(pair, -1), np.append(n, sum(len(t) - 1 for t in corpus())).astype(float))


@pytest.mark.parametrize("want,got", CASES)
def test_garbled_texts_are_restored(table, want, got):
    found, fixed = X.examine(got, table)
    assert found and fixed == want


def test_lossy_texts_are_found(table):
    found, fixed = X.examine("La sesi\ufffdn est\ufffd lista.", table)
    assert len(found) == 2 and fixed is None


def test_correct_texts_stay(table):
    for t in [*SENTENCES, "", "plain ascii", "CONFIGURAÇÃO E INSTALAÇÃO: NÃO", "├── src\n│   └── a.rs", "x ≤ y and α ≠ β", "Ørsted § 4", "&uuml;ber and %C3%BC and \\u00fc"]:
        assert X.examine(t, table) == ([], t)
    assert X.examine(None, table) == ([], None)


def test_maximum_segments_against_brute_force(table):
    text = "plain words " + CASES[0][1] + " more plain words " + CASES[0][0]
    runs = X.improbable_runs(text, table)
    assert runs and all(a < b for a, b in runs) and all(x[1] <= y[0] for x, y in zip(runs, runs[1:]))
    odd = {m.start() for m in re.finditer("Ã", text)}
    assert all(any(a <= i < b for a, b in runs) for i in odd)


def test_find_garbled(spark):
    rows = [(i, t, "c") for i, t in enumerate(corpus())] + [(1000, CASES[0][1], "c"), (1001, None, "c"), (1002, "", "c"), (1000, CASES[0][1], "c"), (1003, "ok " * 100_000 + CASES[2][1], "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = X.find_garbled(df).collect()
    assert sorted(r.doc_id for r in got) == [1000, 1000, 1003] and got[0].restored
    assert X.find_garbled(df.limit(0)).count() == 0


def test_a_garbled_text_with_many_copies_is_found(spark):
    bad = garble(SENTENCES[2], "cp1251", "latin-1")
    rows = [(i, t) for i, t in enumerate(corpus())] + [(1000 + i, bad) for i in range(250)]
    got = X.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000, 1250)) and {r.restored for r in got} == {SENTENCES[2]}


def test_a_frequent_garbling_is_found(spark):
    rows = [(i, t) for i, t in enumerate(corpus()[:100])] + [(1000 + i, f"Item {i} doesnâ€™t fit, {WORDS[i % 25]} fÃ¼r {WORDS[i % 7]}.") for i in range(300)]
    got = X.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000, 1300))
    assert all("doesn’t" in r.restored and " für " in r.restored for r in got)


def test_well_formed_by_chance_stays(table):
    for t in ["┌─┐ and ─┐ and ─┤", "“CAFÉ” and “CAFÉ”", "уже цел, чем целуем", "╔═╗ ═╗"]:
        assert X._well_formed(t, table, []) == []


@pytest.mark.parametrize("n", [20, 400])
def test_long_lines_of_wide_encodings_are_restored(table, n):
    want = "".join(SENTENCES[4] + f" item {i} " for i in range(n))
    # The first lead byte is frequent here, so that the run begins within a character and does not decode by itself.
    score = table.score.copy()
    score[X._pairs(X._codes(" ÏÈ"))] = 0.0
    known = X.PairTable(score, table.floor, table.cut)
    found, fixed = X.examine(garble(want, "gbk", "latin-1"), known)
    assert found and fixed == want


def test_garbling_repeated_many_times_is_undone(table):
    text = SENTENCES[1]
    for _ in range(5):
        text = garble(text, "utf-8", "latin-1")
    found, fixed = X.examine(text, table)
    assert found and fixed == SENTENCES[1]


def test_pairs_are_counted_as_in_plain_python(spark):
    from collections import Counter

    texts = [*corpus(), "ß", "\U0001f600 x \ud7ff", "", "ascii only"]
    want: Counter = Counter()
    for t in texts:
        for a, b in zip(f" {t} ", f"{t} "):
            if a >= "\x80" or b >= "\x80":
                want[int(X._NUMBER[ord(a)]) * X.SYMBOLS + int(X._NUMBER[ord(b)])] += 1
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = {r.pair: r.n for r in X.count_pairs(df, "text").collect()}
    distinct = len(set(texts)) == len(texts)
    assert got.pop(-1) > 0 and set(got) == set(want) and (not distinct or all(abs(got[k] - want[k]) < 1e-6 for k in want))
    assert X._NUMBER[ord("Q")] == X._NUMBER[ord("q")] and X._NUMBER[ord("7")] == X._NUMBER[ord("0")] and X._NUMBER[0x2501] == X._NUMBER[0x2550] and X.SYMBOLS < 3000
