import hashlib
from collections import Counter

import pytest

from loamgrid.operators import backgrounds


def u(key, seed):
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:8], 16) / 2**32


def by_hand(items, harvested, field, seed, p_field, p_procedural):
    """The cascade with pools of everything but one label."""
    order = sorted(harvested, key=lambda f: (f[0] is not None, f[0] or "", f[1]))
    names = sorted(field)
    out = {}
    for key, label in items:
        pool = [f for f in order if f[0] != label] or order
        file = None
        if names and u(key, seed) < p_field:
            name, can = names[int(u(key, seed + 1) * len(names))]
            file = ("field", name) if can else None
        if file is None and order and u(key, seed + 2) >= p_procedural:
            _, name, can = pool[int(u(key, seed + 3) * len(pool))]
            file = ("harvested", name) if can else None
        out[key] = (*(file or ("procedural", None)), None if file else backgrounds.KINDS[int(u(key, seed + 4) * 6)])
    return out


def drawn(spark, items, harvested, field, **p):
    h = backgrounds.bank(spark.createDataFrame(harvested, "label string, file string, can boolean").repartition(3), "label", readable="can")
    f = backgrounds.bank(spark.createDataFrame(field, "file string, can boolean"), readable="can")
    return backgrounds.draw_backdrops(spark.createDataFrame(items, "k long, c string").repartition(4), "k", "c", h, f, 5, **p)


ITEMS = [(i, ["a", "b", None, "not in the bank"][i % 4]) for i in range(2000)]
BANK = [(label, f"{label}-{k}", k % 7 != 3) for label, n in (("a", 40), ("b", 3), ("c", 11), (None, 5)) for k in range(n)]
FIELD = [(f"f{k}", k % 3 > 0) for k in range(8)]


@pytest.mark.parametrize("join", [1 << 20, 0])
@pytest.mark.parametrize(("harvested", "field"), [(BANK, FIELD), (BANK, []), ([], FIELD), ([], []), ([b for b in BANK if b[0] == "a"], [])])
def test_draws_equal_the_cascade_by_hand(spark, monkeypatch, harvested, field, join):
    monkeypatch.setattr(backgrounds, "MOST_BROADCAST", join)
    found = {r.k: (r.source, r.file, r.kind) for r in drawn(spark, ITEMS, harvested, field, p_field=0.3, p_procedural=0.4).collect()}
    assert found == by_hand(ITEMS, harvested, field, 5, 0.3, 0.4)


def test_no_item_gets_its_own_label_and_files_are_drawn_evenly(spark):
    items = [(i, "b") for i in range(12_000)]
    bank = [(label, f"{label}{k}", True) for label in "abc" for k in range(8)]
    rows = drawn(spark, items, bank, [], p_procedural=0.25).collect()
    counts = Counter(r.file for r in rows if r.source == "harvested")
    assert set(counts) == {f for label, f, _ in bank if label != "b"}
    assert 8500 < sum(counts.values()) < 9500 and max(counts.values()) < 1.25 * min(counts.values())


def test_no_pool_is_built_and_no_labels_are_compared_pairwise(spark, monkeypatch):
    monkeypatch.setattr(backgrounds, "MOST_BROADCAST", 0)
    plan = drawn(spark, ITEMS, BANK, FIELD)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan


def test_no_items(spark):
    assert drawn(spark, [], BANK, FIELD).count() == 0
