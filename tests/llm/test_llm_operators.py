import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import decontam, htmltext, langid, licenses, lines, linking, mixing, neardup, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ra", "te", "vo", "zi") for b in ("ba", "ko", "li", "mu", "ra", "te", "vo", "zi")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)


def awkward(rng):
    """Nulls, empty and blank texts, ties, repeated rows, a text of many words."""
    base = prose(rng, 60)
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, base, "en", "a"), (4, base, "en", "a"), (5, base, None, "a"), (6, "one", "en", None), (None, base, "en", "a"), (7, prose(rng, 30_000), "en", "b"), (8, "été ÉTÉ #1 & <x>", "fr", "b")]


# quality rules


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots, hit = {}, set()
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    for v in spots.values():
        if len(v) > 1:
            hit.update(i + k for i in v for k in range(3))
    kept = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(kept) - len(set(kept)), len(hit), len(kept)


def test_text_stats_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a a a a", "a b c a b c", "x\n\nx\n \nx", "no break\x1cno", "é #$\n<b>"] + ["".join(rng.choice("ab \n#\t") for _ in range(rng.randrange(80))) for _ in range(200)]
    for t in texts:
        assert quality.text_stats(t) == brute_stats(t), t


def test_quality_fences_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80), "en", f"s{i % 2}") for i in range(500)]
    rows += [(900, " ".join("x" * 40 for _ in range(60)) + " " + prose(rng, 5), "en", "s0"), (901, " ".join(w + "#" for w in prose(rng, 80).split()), "en", "s1"), *awkward(rng)]
    got = quality.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(500)) or sum(not kept[i] for i in range(10, 500)) == 0
    assert not kept[901] and not kept[1] and not kept[2] and not kept[900]


def test_sketches_merge_and_bound_the_error(spark):
    rng = np.random.default_rng(3)
    values = np.exp(rng.normal(size=4000))
    rows = [(i, "en", f"s{i % 5}", 100, int(v * 1000) + 1, 0, 0, 0, 1) for i, v in enumerate(values)]
    stats = spark.createDataFrame(rows, quality.STATS)
    sketch = quality.sketches(stats)
    got = quality.quantiles(sketch, ["lang"], {"q": 0.9}).where("metric = 'mean_word'").first()
    want = np.quantile([r[4] / 100 for r in rows], 0.9, method="inverted_cdf")
    assert got["n"] == 4000 and abs(got["q"] / want - 1) <= quality.ALPHA + 1e-9


# language and toxicity


def test_language_id(spark):
    rng = random.Random(4)
    tongues = {"aa": "abcde", "bb": "cdefg", "cc": "xyzäö"}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(30)), g, "s") for i, (g, s) in enumerate(list(tongues.items()) * 60)]
    rows += [(900, None, "aa", "s"), (901, "12 34 ...", "aa", "s"), (902, "abcde", None, "s"), (902, "abcde", None, "s")]
    got = langid.identify(frame(spark, rows), F.col("doc_id") % 4 != 2).select("doc_id", "lang", "found.*").collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (900, 901))
    held = [r for r in got if r["doc_id"] < 900 and r["doc_id"] % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_ngrams_of_blocks_equal_those_of_the_whole(monkeypatch):
    text, letters = "Größe und Übermut, weil es 3 mal so war " * 40, langid.letter_table()
    whole = langid.ngram_counts(text, letters)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.ngram_counts(text, letters) == whole).all()


def test_untrained_models_answer(spark):
    docs = frame(spark, [(1, "some words", None, "s")])
    assert langid.identify(docs, F.lit(True)).select("found.*").first()["lang_pred"] == "und"
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, none).select("found.score").first()[0] < 0.5


def brute_segments(scores):
    """All maximal scoring subsequences, by their recursive definition."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    _, _, _, i, j = best
    return brute_segments(scores[:i]) + [(i, j - 1, sum(scores[i:j]))] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 14)
        hits = [(i, rng.choice([1.03, 2.11, 3.17]) + rng.random() / 97) for i in range(n) if rng.random() < 0.4]
        scores = [dict(hits).get(i, -0.7) for i in range(n)]
        got, want = toxicity.segments(hits, 0.7), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 5 == 0:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(["nasty", "vile", "foulish", "foulest"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s")]
    marked = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int")
    got = {r["doc_id"]: r["s"] for r in toxicity.score_toxicity(frame(spark, rows), marked).select("doc_id", F.col("found.score").alias("s")).collect()}
    held = [i for i, _ in labels if i % 4 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95 and got[900] == got[901] < 0.5


# decontamination and licenses


def brute_contamination(docs, bench):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    spans = {(n, tuple(w[p : p + n])): set() for _, t in bench if (w := cut(t)) for n in [min(13, len(w))] for p in range(len(w) - n + 1)}
    for item, t in bench:
        w = cut(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if w else ():
            spans[n, tuple(w[p : p + n])].add(str(item))
    out = {}
    for i, t in docs:
        w, hit, items = cut(t), set(), set()
        for n in {k[0] for k in spans}:
            for p in range(len(w) - n + 1):
                if (found := spans.get((n, tuple(w[p : p + n])))) is not None:
                    hit.update(range(p, p + n))
                    items |= found
        out[i] = (len(w), len(hit), ",".join(sorted(items)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(7)
    bench = [(k, prose(rng, n)) for k, n in enumerate([2, 5, 12, 13, 14, 40, 60, 60])] + [(20, None), (21, ""), (22, bench_text := prose(rng, 20)), (23, bench_text)]
    docs = [(0, None), (1, ""), (2, "-- ,"), (3, bench[5][1]), (4, prose(rng, 300)), (9, bench[0][1].upper() + "!")]
    for k in range(40):
        words = prose(rng, 80).split()
        src = (rng.choice(bench)[1] or "x").split()
        a = rng.randrange(len(src))
        piece = src[a : a + rng.randrange(1, 30)]
        at = rng.randrange(80)
        docs.append((10 + k, ", ".join(words[:at] + piece + words[at:])))
    got = decontam.find_contamination(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in got.collect()} == brute_contamination(docs, bench)


def test_contamination_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.find_contamination(docs, none).collect()] == [False]
    assert decontam.find_contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_licenses(spark):
    rng = random.Random(8)
    gpl, mit = licenses.TEMPLATES["gpl-3.0-notice"], licenses.TEMPLATES["mit-short"]
    rows = [(1, f"{prose(rng, 30)} {gpl.upper()} {prose(rng, 30)}"), (2, mit), (3, prose(rng, 50)), (4, None), (5, " ".join(gpl.split()[:12])), (6, gpl.replace("redistribute", "share")), (2, mit)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.template_table(spark)).collect()

    def shingles(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {}
    for i, t in rows:
        for name, template in licenses.TEMPLATES.items():
            both = len(shingles(t) & shingles(template))
            if both >= 0.8 * len(shingles(template)):
                want[i, name] = both
    assert {(r["doc_id"], r["license_id"]): r["n_shared"] for r in got} == want and len(got) == len(want)
    assert {(1, "gpl-3.0-notice"), (2, "mit-short"), (6, "gpl-3.0-notice")} <= want.keys()


# near-duplicates and lines


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng):
    docs, k = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, " \n")], 10
    for n in (5, 12, 40, 150):
        for _ in range(4):
            base = prose(rng, n).split()
            for _ in range(rng.randrange(1, 7)):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, n // 7))):
                    copy[rng.randrange(n)] = rng.choice(WORDS) + "x"
                docs.append((k, " ".join(copy)))
                k += 1
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = near_copies(random.Random(9))
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, id int"), shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 6)
    monkeypatch.setattr(linking, "HUBS", 2)
    rng = random.Random(10)
    base, docs = prose(rng, 60).split(), []
    for k in range(50):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = rng.choice(WORDS) + "x"
        docs.append((k, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, 2, 80)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(11)
    for share in (0.0, 0.5, 0.8, 0.95):
        a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        b = np.where(rng.random(3000) < 2 * share / (1 + share), a, rng.integers(0, 2**64, 3000, dtype=np.uint64))
        ra, rb = neardup.registers([np.unique(a)]), neardup.registers([np.unique(b)])
        assert abs(neardup.estimate(ra, rb, np.array([3000]), np.array([3000]))[0] - share) < 0.15


def test_near_duplicates_of_repeated_and_nameless_rows(spark):
    text = prose(random.Random(12), 30)
    got = neardup.near_duplicates(spark.createDataFrame([(5, text), (5, text), (None, text), (9, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(5, 5, True), (5, 5, True), (9, 5, False)]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(13)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        want = levenshtein(a, b)
        assert lines.edit_distance(a, b, 20) == want
        assert lines.edit_distance(a, b, 2) == min(want, 3)


def test_lines(spark):
    rng = random.Random(14)
    long, other = prose(rng, 60), prose(rng, 30)
    changed = long.replace(long.split()[20], "newword", 1)
    rows = [(1, f"{long}\nAs.\n{other}"), (2, f"  {long.upper()}!!\nAs."), (3, f"{changed}\nkeep me here as I am new"), (4, None), (5, ""), (6, other), (6, other), (7, f"{other}\n{other}")]
    got = lines.dedup_lines(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, did int")).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "did", "n_lines", "n_removed"}
    assert texts[1] == rows[0][1] and texts[2] == "" and texts[4] is None and texts[5] == "" and texts[6] == "" and texts[7] == ""
    assert texts[3] == "keep me here as I am new"  # one word in sixty is changed


def test_lines_in_scripts_without_spaces(spark):
    rows = [(1, "我们昨天在城里看到了很多有趣的东西"), (2, "我们昨天在城里看到了很多有趣的东西\nok"), (3, "我们今天在城里看到了很多有趣的东西"), (4, "我们今天在城里吃了很多好吃的水果和蔬菜")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "ok", 3: "", 4: rows[3][1]}


# archives, pages, mixing


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "é", "é" * 500), (9, "http://a/9", big), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 9) if i in (1, 2) else ("response", None))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><div class="cookie-notice">We use cookies. Accept all of them please.</div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="content"><h1>The  title &amp; more</h1><p>First paragraph with <a href="x">a link</a> and some further words in it.</p>
<div class="ad">Buy this now</div><p>Second one,&nbsp;short.<form><label>Mail</label><input></form>
<section id="comments"><p>A reader says that this is a long and winding comment of many words.</p></section></div>
<aside>Related things</aside><!-- <p>hidden</p> --><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    tree = htmltext.train_tree()
    assert htmltext.main_text(PAGE, tree) == "The title & more First paragraph with a link and some further words in it. Second one, short."
    assert htmltext.main_text(None, tree) == "" and htmltext.main_text("", tree) == "" and htmltext.main_text("<p", tree) == ""
    assert htmltext.main_text("<article><p>cut off in a <b>word", tree) == "cut off in a word"
    assert htmltext.main_text("<article><p>5 < 6 and <i>so</i> on &lt;b&gt;", tree) == "5 < 6 and so on <b>"


def test_tree_learns_its_table():
    tree = htmltext.train_tree()
    assert np.mean([htmltext.decide(tree, np.array(r[:-1], float)) == r[-1] for r in htmltext.LABELLED]) > 0.95


def test_mixing_meets_its_targets(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 20 + i % 90), "en" if i % 3 else "fr", f"s{i % 7 % 3}") for i in range(600)] + awkward(rng)
    goals = {"=en": 0.5, "=fr": 0.3, "": 0.2}
    got = mixing.mix(frame(spark, rows), topic=F.lit("t"), langs=goals).select("doc_id", "mix.*", "p", "sampled").collect()
    assert len(got) == len(rows) and max(r["p"] for r in got) == pytest.approx(1) and all(r["p"] == 0 and not r["sampled"] for r in got if r["n_tokens"] == 0)
    sums = {g: sum(r["p"] * r["n_tokens"] for r in got if r["lang"] == g) for g in goals}
    assert [sums[g] / sum(sums.values()) for g in goals] == pytest.approx([goals[g] for g in goals], rel=0.02)
    assert mixing.mix(frame(spark, [])).collect() == []


def raked(cells, targets):
    """Iterative proportional fitting by numpy, to the end."""
    w = {k: float(v) for k, v in cells.items() if v > 0}
    for _ in range(400):
        for d, shares in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[d]] = sums.get(k[d], 0.0) + v
            w = {k: v * shares.get(k[d], 0.0) / sums[k[d]] if sums[k[d]] else 0.0 for k, v in w.items()}
    ratio = {k: v / cells[k] for k, v in w.items()}
    return {k: v / max(ratio.values()) for k, v in ratio.items()}


@pytest.mark.parametrize("most", [10_000, 0])
def test_mixing_settles_at_the_fitted_weights(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    rng = random.Random(16)
    rows = [(i, prose(rng, 5 + i % 50), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(500)]
    topic = F.substring("text", 1, 1)
    got = mixing.mix(frame(spark, rows), topic=topic).select("doc_id", "mix.*", "p").collect()
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    totals = [{}, {}, {}]
    for k, v in cells.items():
        for d in range(3):
            totals[d][k[d]] = totals[d].get(k[d], 0) + v
    want = raked(cells, [mixing.tempered(t) for t in totals])
    assert all(r.p == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-4) for r in got)


@pytest.mark.parametrize("most", [10_000, 0])
def test_contradicting_targets_end_with_a_warning(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    monkeypatch.setattr(mixing, "STALL", 2)
    # All of source a is in en, and all of b in fr; the languages' targets ask for something else.
    rows = [(i, "some words here", "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(60)]
    sources = spark.createDataFrame([("=a", 0.5), ("=b", 0.5)], "value string, share double")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.mix(frame(spark, rows), topic=F.lit("t"), sources=sources, langs={"=en": 0.9, "=fr": 0.1}).count()
