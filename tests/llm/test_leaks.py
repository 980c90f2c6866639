import random

import pytest
from pyspark.sql import functions as F

from arclume.llm import leaks
from helpers import rows

WORDS = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sa", "lo", "ny") for b in ("ra", "lem", "dor", "vis", "tun", "pok")]
LEAD = "Read the passage and answer the question."


def passage(rng, n=48):
    ws = [rng.choice(WORDS) for _ in range(n)]
    return ". ".join(" ".join(ws[i : i + 8]).capitalize() for i in range(0, n, 8)) + "."


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    out = [(i, (LEAD + " " if i % 2 else "") + passage(rng) + (" " if i % 3 else "")) for i in range(20)]
    return [*out, (20, None), (21, ""), (22, LEAD), (23, "安静的运河雨中交换了某位药铺四石桥抄写了苍白的盐湖又抄写了狭窄的石磨灯塔守护了")]


def body(items, i):
    return items[i][1].replace(LEAD, "").strip()


def found(items, text, ordered=True):
    ix = leaks.Index(leaks.read_items(items))
    return {i for _, i, _ in leaks.leaks_in([text], ix, 1 / 3, ordered)}


def test_whole_parts_and_disguise(items):
    b = body(items, 3)
    w = b.split()
    assert found(items, f"Before. {b} After.") == {3}
    assert found(items, " ".join(w[10:30])) == {3}
    assert found(items, " ".join(w[:9]) + " something else entirely stands here " * 6 + " ".join(w[30:40])) == {3}
    assert found(items, b.upper().replace(" ", "\n> ")) == {3}
    assert found(items, "<p>" + b.replace(" ", "</b> <b>") + "</p>") == {3}
    assert found(items, b.replace("a", "а").replace("o", "ο").replace("e", "e​").replace("i", "i­")) == {3}
    assert found(items, " ".join(f"**{x}**," if i % 3 else x for i, x in enumerate(w))) == {3}
    changed = [("other" if i % 9 == 5 else x) for i, x in enumerate(w)]
    assert found(items, " ".join(changed)) == {3}
    assert found(items, " ".join(x for i, x in enumerate(w) if i % 9 != 5)) == {3}


def test_not_leaks(items):
    b = body(items, 3)
    w = b.split()
    assert found(items, LEAD + " Nothing else.") == set()
    assert found(items, " ".join(w[:7]) + " and then something else.") == set()
    rng = random.Random(1)
    mixed = w[:]
    rng.shuffle(mixed)
    assert found(items, " ".join(mixed)) == set()
    assert found(items, " ".join(x + " filler filler" for x in w)) == set()
    assert found(items, "") == set() and found(items, passage(random.Random(99))) == set()


def test_characters(items):
    t = items[23][1]
    assert found(items, f"他说：{t}。") == {23}
    assert found(items, t[5:22]) == {23}
    assert found(items, "".join("很" if i % 6 == 3 else c for i, c in enumerate(t))) == {23}
    assert found(items, t[:4]) == set()
    mixed = list(t)
    random.Random(2).shuffle(mixed)
    assert found(items, "".join(mixed)) == set()


def test_tiles_are_maximal_and_apart():
    rng = random.Random(5)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(40)], [rng.randrange(4) for _ in range(25)]
        got = leaks.tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        for side, at in ((40, 0), (25, 1)):
            used = [x for t in got for x in range(t[at], t[at] + t[2])]
            assert len(used) == len(set(used)) and max(used, default=0) < side
        best = max((k for i in range(40) for j in range(25) for k in range(26) if i + k <= 40 and j + k <= 25 and a[i : i + k] == b[j : j + k]), default=0)
        assert best < 3 or max(n for *_, n in got) == best
    assert leaks.tiles([], [1], 3) == [] and leaks.tiles([1, 2, 3], [1, 2, 3], 3) == [(0, 0, 3)]


@pytest.mark.parametrize("block", [20_000, 7])
def test_find_leaks(spark, items, block):
    docs = [(1, body(items, 0)), (1, "twice"), (2, None), (3, ""), (4, "word " * 50_000 + body(items, 1) + " word" * 50_000), (5, body(items, 2) + "\n\n" + body(items, 23)), (None, body(items, 0))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, item_text string, coverage double")
    got = leaks.find_leaks(df, it, block=block)
    assert rows(got.select("doc_id", "item_id")) == [(1, 0), (4, 1), (5, 2), (5, 23), (None, 0)]
    assert got.filter("coverage < 1").count() == 0
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def test_short_stretches():
    rng = random.Random(7)
    w = rng.sample(WORDS, 36)
    items = [(0, " ".join(w)), (1, " ".join(x + "x" for x in w[:5])), (2, " ".join(x + "y" for x in w[:15]))]
    far = " ".join(f"z{i}" for i in range(200))
    carries = lambda *runs: found(items, f" {far} ".join(" ".join(r) for r in runs))
    assert carries(w[2:7], w[20:27]) == carries(w[2:6], w[20:28]) == carries(w[2:11], w[20:23]) == {0}
    assert carries(w[2:6], w[20:27]) == carries(w[20:28], w[2:6]) == carries(w[:7]) == set()
    assert carries([x + "x" for x in w[:5]]) == {1}
    assert carries([x + "y" for x in w[4:9]]) == {2} and carries([x + "y" for x in w[:5]]) == set()
    # a word behind a changed one at the end of a stretch
    assert carries([*w[5:15], "other", w[16]]) == carries([w[5], "other", *w[7:17]]) == {0}
    assert carries([*w[5:15], "other", "else", w[17]]) == set()


def test_markup_of_any_length(items):
    b = body(items, 3)
    w = b.split()
    tag = f'<span style="{"color: red; " * 40}">'
    for mark in (tag, f"<!-- {'note ' * 100} -->", "<!-- two\nlines -->", "<a\n href='x'\n class=\"y\">", f"[x](http://a.test/{'y' * 600}(z))"):
        assert found(items, " ".join(x + (mark if i % 4 == 3 else "") for i, x in enumerate(w))) == {3}
    assert found(items, f"a < {b} > c <!-- {b}") == {3}
    for part in ("](", "<!--", "<a ", "-\n"):
        assert found(items, part * 50_000 + b) == {3}


def test_moved_parts_only_out_of_order(items):
    w = body(items, 3).split()
    moved = " ".join(" ".join(w[i : i + 4]) + " filler" for i in range(44, -1, -4))
    assert found(items, moved) == set() and found(items, moved, ordered=False) == {3}
    assert found(items, " ".join(w[:9]), ordered=False) == set()


def test_too_many_items(spark, items, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_ITEMS", 3)
    with pytest.raises(ValueError):
        leaks.find_leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
