import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from loamgrid.llm import lines
from loamgrid.llm.common import WordHashes
from loamgrid.llm.linewords import _BYTES, _LETTER, _OTHER, line_words, normal

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ra", "te", "vo", "zi") for b in ("ba", "ko", "li", "mu", "ra", "te", "vo", "zi", "su", "do")]


def edited(rng, words, edits):
    """``words`` after ``edits`` insertions, deletions and replacements, spread as evenly as can be."""
    out, n = list(words), len(words)
    for k in reversed(range(edits)):
        at = min(n - 1, k * n // edits + n // edits // 2)
        out[at : at + 1] = rng.choice([[], [rng.choice(WORDS) + "x"], [rng.choice(WORDS) + "x"], [out[at], rng.choice(WORDS) + "x"]])
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_kept(texts):
    """For each line, in order, whether it is the first of its group."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        longest = max(len(a), len(b))
        if abs(len(a) - len(b)) <= longest // 5 and levenshtein(a, b) <= longest // 5:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) == i for i in range(len(texts))]


def families(rng, sizes, copies):
    out = []
    for n in sizes:
        base = [rng.choice(WORDS) for _ in range(n)]
        out += [base] + [edited(rng, base, max(0, n // 5 - k % 3)) for k in range(copies)]
    rng.shuffle(out)
    return out


def kept(spark, texts):
    got = lines.dedup_lines(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    return [r["n_removed"] == 0 for r in sorted(got, key=lambda r: r["doc_id"])]


def test_lines_with_one_word_in_five_changed_equal_brute_force(spark):
    texts = families(random.Random(21), [*range(12, 32), 47, 64, 70, 79, 80, 81, 100, 140], 3)
    assert kept(spark, texts) == brute_kept(texts)


def test_large_groups_of_a_piece_equal_brute_force(spark, monkeypatch):
    rng = random.Random(22)
    monkeypatch.setattr(lines, "PAIRS_UP_TO", 3)
    texts = families(rng, [15, 23, 40], 12)
    texts += [t[:4] + [rng.choice(WORDS) for _ in range(20)] for t in texts[:12]]
    assert kept(spark, texts) == brute_kept(texts)


def test_similar_lines_share_a_piece():
    rng, hashes = random.Random(23), WordHashes()
    for n in [*range(5, 40), 60, 90, 200]:
        for _ in range(20):
            a = [rng.choice(WORDS) for _ in range(n)]
            b = edited(rng, a, n // 5)
            if levenshtein(a, b) > max(len(a), len(b)) // 5 or min(len(a), len(b)) < 5:
                continue
            ids = np.array([hashes[w] for w in a + b], np.uint64)
            table = list(zip(*lines.pieces(ids, np.array([0, len(a)])), strict=True))
            longer = {h for h, line, _, own in table if own and line == (len(b) > len(a))}
            assert longer & {h for h, line, _, _ in table if line == (len(b) <= len(a))}, (a, b)


def test_short_lines_with_one_word_changed_equal_brute_force(spark):
    texts = families(random.Random(24), [5, 6, 7, 8, 9, 10, 11] * 3, 3)
    texts = [t for t in texts if len(t) >= 5]
    want = brute_kept(texts)
    assert kept(spark, texts) == want and sum(want) < len({tuple(t) for t in texts})


def test_operators_cut_copies_of_lines_of_few_words(spark, tmp_path):
    rows = [(1, "Menu\nAll rights reserved.\n\nMenu"), (2, "all rights RESERVED\nMenu\nAbout us"), (3, "About you\n--\n--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_chars"]) for r in lines.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 1, 26), 2: (3, 2, 8), 3: (3, 0, 15)}
    staged = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert staged == {1: "Menu\nAll rights reserved.\n", 2: "About us", 3: rows[2][1]}


def test_lines_of_documents_against_an_exact_search(spark, monkeypatch):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = lines.with_row(spark.read.parquet(path).select("doc_id", "text"))
    words = {}
    for r in docs.select("text").collect():
        for x in (r["text"] or "").split("\n"):
            w = line_words(x)
            if len(w) >= 5:
                words[int(lines.Lines([x]).key[0])] = w
    keys, sets, links = list(words), {k: set(lines.numbered(w)) for k, w in words.items()}, []
    for a, b in itertools.combinations(keys, 2):
        most = max(len(words[a]), len(words[b])) // 5
        if max(len(words[a]), len(words[b])) - len(sets[a] & sets[b]) <= most and lines.edit_distance(words[a], words[b], most) <= most:
            links.append((a, b))
    got, linked = {}, lines.linked_components

    def seen(*args):
        found = linked(*args)
        got.update({r["node"]: r["component"] for r in found.collect()})
        return found

    monkeypatch.setattr(lines, "linked_components", seen)
    lines.repeated_lines(docs).count()
    group = lambda k: got.get(k, k)
    assert len(links) > 20 and sum(group(a) == group(b) for a, b in links) >= 0.98 * len(links)


def grown_families(rng, sizes, copies):
    """Lines that differ from their family's first by up to a fifth of their words, at random places; not all are similar to each other."""
    out = []
    for n in sizes:
        base = [rng.choice(WORDS) for _ in range(n)]
        for _ in range(copies):
            line = list(base)
            for at in rng.sample(range(n), rng.randrange(n // 12, n // 5)):
                line[at] = rng.choice(WORDS)
            out.append(line)
    rng.shuffle(out)
    return out


def lost_links(texts, found):
    """Similar pairs, and those of them that ``found`` puts in different groups."""
    n, lost = 0, 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        most = max(len(a), len(b)) // 5
        if abs(len(a) - len(b)) <= most and lines.edit_distance(a, b, most) <= most:
            n += 1
            lost += found[i] != found[j]
    return n, lost


def groups_of(spark, texts, monkeypatch, exact=False):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got, linked = {}, lines.linked_components

    def seen(*args):
        found = linked(*args)
        got.update({r["node"]: r["component"] for r in found.collect()})
        return found

    with monkeypatch.context() as m:
        m.setattr(lines, "linked_components", seen)
        lines.repeated_lines(lines.with_row(docs), exact).count()
    keys = [int(lines.Lines([" ".join(t)]).key[0]) for t in texts]
    return [got.get(k, k) for k in keys]


@pytest.mark.parametrize("copies", [6, 23, 60, 200])
def test_families_of_many_lines_keep_their_links(spark, monkeypatch, copies):
    rng = random.Random(copies)
    texts = grown_families(rng, [30, 40, 60, 30, 40, 60] if copies < 100 else [40, 90], copies)
    n, lost = lost_links(texts, groups_of(spark, texts, monkeypatch))
    assert n > 10 and lost <= n * 0.01, (n, lost)


def test_the_exact_search_loses_no_link_at_any_length(spark, monkeypatch):
    rng = random.Random(77)
    texts = []
    for n in [5, 9, 14, 19, 20, 24, 25, 31, 33, 40, 41, 64, 119, 121, 150, 260]:
        base = [rng.choice(WORDS) for _ in range(n)]
        texts.append(base)
        for _ in range(4):  # as many edits as are allowed, at the worst places for runs
            texts.append(edited(rng, base, n // 5))
    texts = [t for t in texts if len(t) >= lines.EDITS]  # shorter ones are similar only if equal
    n, lost = lost_links(texts, groups_of(spark, texts, monkeypatch, exact=True))
    assert n > 60 and lost == 0, (n, lost)


def test_shuffled_rows_are_as_wide_as_their_lines_need():
    rng, hashes = random.Random(31), WordHashes()
    sizes = np.array([5, 12, 20, 21, 40, 48, 49, 90, 120, 121, 300, 20000])
    ids = np.array([hashes[rng.choice(WORDS) + str(rng.randrange(500))] for _ in range(sizes.sum())], np.uint64)
    starts = np.cumsum(sizes) - sizes
    key = np.arange(len(sizes), dtype=np.int64) - 5
    marks, sims = lines.word_sets(ids, starts), lines.pair_simhashes(ids, starts)
    for exact in (False, True):
        h, line, far, own = lines.pieces(ids, starts, exact)
        h = h & np.uint64(0x3FFFFFFFF)
        shard = (h >> np.uint64(32)).astype(np.uint16)
        some, packed = lines.packed_rows(h, line, far, own, shard, key, sizes, marks, sims, 4)
        got = set()
        for s, part in zip(some.tolist(), packed, strict=True):
            for form, rows in enumerate(lines.unpacked([part])):
                for r in rows:
                    at = int(r["id"]) + 5
                    assert int(r["n"]) >> 2 == sizes[at] and (form == 3 or sizes[at] <= lines.FORM_WORDS[form])
                    if form == 3:
                        assert (r["a"], r["b"]) == tuple((sims if r["n"] & 2 else marks)[k][at] for k in range(2))
                    got.add((s, int(r["run"]), at, bool(r["n"] & 2), bool(r["n"] & 1)))
        want = {(int(x) >> 32, int(x) & 0xFFFFFFFF, int(i), bool(f), bool(o)) for x, i, f, o in zip(h, line, far, own, strict=True)}
        assert got == want
        short = sizes[line] <= lines.FORM_WORDS[0]
        assert sum(map(len, packed)) < (17 * short + 32 * ~short).sum() + 16 * len(packed) < 34 * len(h)


def test_lines_of_different_forms_meet_in_the_narrower():
    rng, hashes = random.Random(32), WordHashes()
    for n in (14, 17, 20, 48, 57, 120):
        a = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
        b, c = a[: n - n // 5] + [], [rng.choice(WORDS) + "x" + str(k) for k in range(n)]
        every = [a, b, c + c[: n // 6]]
        sizes = np.array([len(x) for x in every])
        ids, starts = np.array([hashes[w] for x in every for w in x], np.uint64), np.cumsum(sizes) - sizes
        k, shard = len(every), np.zeros(len(every), np.uint16)
        packed = lines.packed_rows(np.full(k, 7, np.uint64), np.arange(k), np.zeros(k, bool), np.ones(k, bool), shard, np.arange(k), sizes, lines.word_sets(ids, starts), lines.pair_simhashes(ids, starts), 1)[1]
        rows = lines.shared_runs(packed)
        assert rows["n"].tolist() == sizes.tolist()
        assert lines.excess(rows[:1], rows[1:2])[0] <= 1 and lines.excess(rows[1:2], rows[:1])[0] <= 1
        assert (lines.excess(rows[:, None], rows[None])[:2, :2] <= 1).all() and lines.excess(rows[:1], rows[2:])[0] > 1


def test_rows_of_no_shared_run_give_none():
    assert not len(lines.shared_runs([]))


def test_words_of_texts_with_few_or_many_other_characters():
    rng = random.Random(33)
    for some in ("aé–b 1", "’“”… ñß\n", "日本語カナ xyz。", "".join(map(chr, range(0x2010, 0x2060))) + "a b\n", "กขค ab\ud800\u0301", "".join(map(chr, range(0x4E00, 0x4E40)))):
        for _ in range(20):
            text = "".join(rng.choice(some) for _ in range(60))
            low = _LETTER.sub(r" \1 ", _OTHER.sub(" ", text.lower())).encode("utf-8", "surrogatepass").translate(_BYTES)
            assert [x.split() for x in normal(text).split(b"\n")] == [x.split() for x in low.split(b"\n")]
