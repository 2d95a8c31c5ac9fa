import random

import pytest

from loamgrid.llm import quality


def prose(rng, n, mark=""):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) + mark for _ in range(n))


@pytest.mark.parametrize("share", [0.05, 0.15, 0.3])
def test_junk_does_not_move_the_fence(spark, share):
    rng, rows = random.Random(31), []
    for i in range(600):
        # source s1 has the share of junk, s2 is all junk
        junk = i % 3 == 1 and rng.random() < share or i % 12 == 2
        rows.append((i, prose(rng, 60, "$$$" if junk else ""), "en", "s2" if i % 12 == 2 else f"s{i % 3 % 2}", junk))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert [kept[r[0]] for r in rows] == [not r[4] for r in rows]
