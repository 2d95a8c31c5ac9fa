import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, awkward, frame, prose

from loamgrid.llm import decontam, htmltext, langid, licenses, linking, mixing, neardup, quality, toxicity, warc
from loamgrid.session import durable


def test_segments_take_linear_time():
    rng = random.Random(1)
    hits = [(at, rng.random() * 3) for at in range(0, 3_000_000, 3)]
    began = time.process_time()
    assert toxicity.segments(hits, 1.0) and toxicity.segments([(3 * k, 1.0 + k / 1e6) for k in range(300_000)], 0.6)
    assert time.process_time() - began < 30


def test_rows_that_begin_and_end_alike_all_count(spark):
    same = "the same words begin each of these texts so that it is hard", "and the same words end each of these texts as well in the end"
    texts = [f"{same[0]} {w} {same[1]}" for w in ("nasty", "vile", "foul", "mean")]
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, toxic int")
    got = toxicity.sample_counts(rows.groupBy(F.xxhash64("text"), "toxic").agg(F.min("text").alias("text"))).where("feature in ('nasty', 'vile', 'foul', 'mean')")
    assert got.count() == 4


def brute_verdicts(rows):
    """kept of each row, from the definition of fences, with values rounded to the sketches' buckets."""
    stats = {r[0]: quality.text_stats(r[1]) for r in rows}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    names = {"n_words": 0, "word_chars": 1, "n_symbols": 2, "n_dup_lines": 3, "n_repeat_words": 4, "n_lines": 5}

    def rounded(x):
        return 2 * quality.GAMMA ** np.ceil(np.log(x) / np.log(quality.GAMMA)) / (1 + quality.GAMMA) if x > 0 else 0.0

    def low(values):
        return sorted(values)[(len(values) + 1) // 2 - 1]

    def spread(values, least, lengths):
        """The median, and the median distance from it, which no ratio's least step nor what values are known to falls under."""
        mid = low(values)
        some = [v for v in values if v > 0]
        unit = min([least / low(lengths), *([low(some)] if some else [])])
        return mid, max(low([abs(v - mid) for v in values]), unit, 0.02 * mid)

    # characters a word, symbols a word, repeated lines a line, words of repeated windows (two of three words at least) a word
    ratios = (("word_chars", "n_words", 0, True), ("n_symbols", "n_words", 1, False), ("n_dup_lines", "n_lines", 1, False), ("n_repeat_words", "n_words", 6, False))
    kept = {i: not f for i, f in failed.items()}
    group = {r[0]: (r[2], r[3]) for r in rows}
    for a, b, least, both in ratios:
        x = {i: s[names[a]] / s[names[b]] for i, s in stats.items() if not failed[i]}
        long = {i: rounded(stats[i][names[b]]) for i in x}
        for i, v in x.items():
            every = [j for j in x]
            lang = [j for j in x if group[j][0] == group[i][0]]
            own = [j for j in lang if group[j] == group[i]]
            of = [spread([rounded(x[j]) for j in some], least, [long[j] for j in some]) for some in (every, lang, own)]
            wide = [(len(lang) * p + 200 * q) / (len(lang) + 200) for p, q in zip(of[1], of[0], strict=True)]
            tight = [(len(own) * p + 200 * q) / (len(own) + 200) for p, q in zip(of[2], wide, strict=True)]
            if v > min(m + 12.2 * d for m, d in (wide, tight)) or both and v < max(m - 12.2 * d for m, d in (wide, tight)):
                kept[i] = False
    return kept


def test_groups_of_different_texts_have_different_fences(spark):
    from loamgrid.llm.common import table

    limits = quality.fences(quality.sketches(quality.base_stats(table(spark, "/root/testdata/sf0.1", "documents")))).collect()
    assert len(limits) == 80
    for m in ("mean_word", "symbols", "dup_lines", "repeats"):
        assert len({round(r[f"hi_{m}"], 6) for r in limits}) > 8, m


def test_fences_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        words = prose(rng, 60).split()
        if i % 9 == 0:
            words = [w + "#" * rng.randrange(2) for w in words]
        if i % 13 == 0:
            words = [w * rng.randrange(1, 6) for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None]), f"s{i % 5}"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, rows)).collect()}
    want = brute_verdicts(rows)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_templates_are_retrieved_by_bands_only(spark, monkeypatch):
    docs = spark.createDataFrame([(1, licenses.TEMPLATES["gpl-3.0-notice"]), (2, licenses.TEMPLATES["mit-short"])], "doc_id long, text string")
    known = licenses.template_table(spark, {"two": "MIT license", **licenses.TEMPLATES})
    assert {(r["doc_id"], r["license_id"]) for r in licenses.scan_licenses(docs, known).collect()} == {(1, "agpl-3.0-notice"), (1, "gpl-3.0-notice"), (2, "mit-short"), (2, "two")}  # the first two differ in a word
    monkeypatch.setattr(licenses, "band_keys", lambda s, step: F.array(F.lit(step).cast("long")))
    monkeypatch.setattr(licenses, "single_keys", lambda s: F.array().cast("array<bigint>"))
    assert licenses.scan_licenses(docs, known).collect() == []


def test_work_on_unlinked_halves_grows_with_the_items(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 16)
    made = []
    for n in (200, 400, 800):
        sets = {i: np.sort(np.append(np.arange(50, dtype=np.uint64) + np.uint64(1000 * (i % 2)), np.uint64(10_000 + i))).tobytes() for i in range(n)}
        held = durable(spark.createDataFrame(list(sets.items()), "id long, payload binary"))
        asked = []

        def payloads(wanted, held=held, asked=asked):
            wanted = durable(wanted)
            asked.append(wanted.agg(F.sum(F.greatest(F.size("slots"), F.lit(1)))).first()[0] or 0)
            return wanted.join(held, "id")

        items = spark.range(n).select("id", F.lit(1).cast("long").alias("gid"), F.lit(1).alias("weight"))
        found = {r["node"]: r["component"] for r in linking.linked_components(items, payloads, neardup.linker(80), 1 << 40, neardup.set_elements(80), neardup.set_needed(80)).collect()}
        assert found == {i: i % 2 for i in range(n)}
        made.append(sum(asked))
    assert made[1] < 2.6 * made[0] and made[2] < 2.6 * made[1]


def test_work_on_a_template_grows_with_the_items(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 16)
    made = []
    for n in (400, 800, 1600):
        # 85 elements of a template and 15 of its own: 85 of 115 in common, so nothing is linked
        sets = {i: np.sort(np.append(np.arange(85, dtype=np.uint64), np.arange(15, dtype=np.uint64) + np.uint64(1000 + 15 * i))).tobytes() for i in range(n)}
        held = durable(spark.createDataFrame(list(sets.items()), "id long, payload binary"))
        asked = []

        def payloads(wanted, held=held, asked=asked):
            wanted = durable(wanted)
            asked.append(wanted.agg(F.sum(F.greatest(F.size("slots"), F.lit(1)))).first()[0] or 0)
            return wanted.join(held, "id")

        items = spark.range(n).select("id", F.lit(1).cast("long").alias("gid"), F.lit(1).alias("weight"))
        found = linking.linked_components(items, payloads, neardup.linker(80), 1 << 40, neardup.set_elements(80), neardup.set_needed(80))
        assert found.where("node <> component").count() == 0
        made.append(sum(asked))
    assert made[1] < 2.6 * made[0] and made[2] < 2.6 * made[1] and made[2] < 12 * 1600, made


@pytest.mark.parametrize("seed", range(6))
def test_rare_elements_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(linking, "BLOCK", 4)
    monkeypatch.setattr(linking, "HUBS", 1)
    rng = np.random.default_rng(seed)
    bases = [rng.choice(200, 30, replace=False) for _ in range(6)]
    if seed > 2:  # a template that all have, so that links hang on a few elements
        bases = [np.append(np.arange(24), rng.choice(np.arange(24, 200), int(rng.integers(2, 9)), replace=False)) for _ in range(6)]
    sets = {}
    for i in range(60):
        s = set(bases[i % 6].tolist())
        for _ in range(rng.integers(0, 4)):
            s.discard(int(rng.choice(list(s))))
            s.add(int(rng.integers(200, 400)))
        sets[i] = s
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    held = spark.createDataFrame([(i, np.sort(np.array(list(s), np.uint64)).tobytes()) for i, s in sets.items()], "id long, payload binary")
    items = spark.range(60).select("id", F.lit(1).cast("long").alias("gid"), F.lit(1).alias("weight"))
    found = {r["node"]: r["component"] for r in linking.linked_components(items, lambda t: t.join(held, "id"), neardup.linker(80), 1 << 40, neardup.set_elements(80), neardup.set_needed(80)).collect()}
    assert {i: found.get(i, i) for i in range(60)} == {i: find(i) for i in range(60)}


def test_tables_are_broadcast_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(linking, "BROADCAST_BYTES", 1000)
    small, wide = spark.range(3), spark.createDataFrame([(1, ["x" * 600, "y" * 600])], "id long, s array<string>")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(linking.sized(small)) and not hinted(linking.sized(wide))


EXTRA = ("found", "mix", "p", "sampled", "n_words", "text_hash", "d", "h", "no", "known", "id", "gid")


def test_columns_of_clashing_names(spark):
    docs = frame(spark, [*awkward(random.Random(3)), (20, licenses.TEMPLATES["mit-short"], "en", "a")])
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("x"))
    n = docs.count()
    labels = spark.createDataFrame([(4, 1, "x"), (7, 0, "x")], "doc_id long, toxic int, found string")
    bench = spark.createDataFrame([(1, "one two", "x")], "item_id long, text string, n string")
    assert langid.identify(docs, F.lit(True)).count() == n
    assert toxicity.score_toxicity(docs, labels).count() == n
    assert quality.quality_rules(docs).count() == n
    assert decontam.find_contamination(docs, bench).count() == n
    assert mixing.mix(docs).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert [r["license_id"] for r in licenses.scan_licenses(docs, licenses.template_table(spark)).collect()] == ["mit-short"]


def test_empty_tables(spark, tmp_path):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert licenses.scan_licenses(docs, licenses.template_table(spark)).collect() == []
    assert toxicity.score_toxicity(docs, labels).collect() == [] and quality.quality_rules(docs).collect() == []
    assert langid.identify(docs, F.lit(True)).collect() == [] and htmltext.extract_text(pages).collect() == []
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect() == []


def test_pages_without_an_id(spark, tmp_path):
    rows = [(None, "u", "z" * 2000), (5, "u", "z" * 2000), (None, None, None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"]) for r in got) == [(-1, 0, "response"), (-1, 2000, "response"), (5, 2000, "response")]


def test_repeated_rows_are_each_judged(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta"), (1, "x alpha beta"), (1, "other"), (None, "alpha beta"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_hit"], r["contaminated"]) for r in decontam.find_contamination(docs, bench).collect())
    assert got == [(-1, 2, True), (1, 0, False), (1, 2, True), (1, 2, True), (2, 0, False)]


def test_links_around_blocks_frames_and_stray_tags():
    tree = htmltext.train_tree()
    menu = "".join(f"<a href=x><div>{w} page</div></a>" for w in ("Home", "News", "About"))
    body = "<article><h1>A heading</h1><p>Some text of an article with quite a few words in it. <math><mi>x</mi></math></p></article>"
    want = "A heading Some text of an article with quite a few words in it. x"
    assert htmltext.main_text(f"{menu}<div class='layout no-sidebar'>{body}</div>", tree) == want
    assert htmltext.main_text(f"<div class='page-with-comments'>{body}</div><div class='comments'><p>A reader says something here.</p></div>", tree) == want
    assert htmltext.main_text(f"<script src=x />var p = '<p>no</p>';</script>{body}", tree) == want
    began = time.process_time()
    htmltext.main_text("<div>" * 2000 + "x" + "</span></section>" * 100_000, tree)
    assert time.process_time() - began < 20


def test_long_texts(spark):
    rng = random.Random(4)
    long = prose(rng, 200_000)
    bench = spark.createDataFrame([(1, " ".join(long.split()[100_000:100_040]))], "item_id long, text string")
    docs = frame(spark, [(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, "a b", "en", "a")])
    assert {r["doc_id"]: r["n_hit"] for r in decontam.find_contamination(docs, bench).collect()} == {1: 40, 2: 40, 3: 0}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert quality.quality_rules(docs).where("n_words > 100000").count() == 2
