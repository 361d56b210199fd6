"""Near-duplicates by the LSH forest against all pairs of plain sets."""

import random
import re
from itertools import combinations

import pytest
from test_operators import CASES, SCHEMA, prose

from tableferry.llm import forest
from tableferry.llm.queries import QUERIES


def plain_set(text, words=5):
    found = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            parent[find(x)] = find(y)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[n]), least, i is not None and i == least))
    return out


def family(seed, members, words, edits):
    """Texts that each differ from a common one in a few words."""
    rng, base = random.Random(seed), prose(seed, words).split()
    for _ in range(members):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        yield " ".join(text)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = forest.groups(docs, **options).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows, options.get("percent", 85))))


def test_odd_rows_and_clashing_columns(spark):
    rows = [(i, t, lang, s, None, "clash", 7, "clash") for i, t, lang, s in CASES]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = forest.groups(docs).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute([(i, t) for i, t, _, _ in CASES])))
    assert forest.groups(docs.limit(0)).count() == 0


def test_near_copies_around_the_limit(spark):
    texts = [t for seed in range(12) for t in family(seed, 6, 150, 5)] + [prose(100 + s, 4) for s in range(5)]
    texts += ["one two three four five", "ONE two three  four\nfive", "one two three four", " one TWO three four "]
    random.Random(1).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_chains_of_near_copies(spark):
    # Each text has lost some more words: neighbours are alike, the ends are not.
    words = [f"u{i}" for i in range(200)]
    check(spark, [(100 - n, " ".join(words[6 * n : 6 * n + 120])) for n in range(14)])


@pytest.mark.parametrize("edits", [2, 9])
def test_crowded_regions_reach_the_last_level(spark, monkeypatch, edits):
    monkeypatch.setattr(forest, "CROWD", 4)
    monkeypatch.setattr(forest, "BLOCK", 5)
    monkeypatch.setattr(forest, "DEPTHS", (1, 2))
    rows = list(enumerate([*family(3, 60, 120, edits), *family(4, 30, 120, edits)]))
    check(spark, rows)


def test_orders_miss_one_in_a_million():
    for depth in forest.DEPTHS:
        orders = forest.orders_needed(85, depth)
        assert (1 - 0.85**depth) ** orders <= 1e-6 < (1 - 0.85**depth) ** (orders - 1)


def test_query_keeps_one_of_each_group(spark, sf_dir):
    found = QUERIES["op13_minhash_near_dedup"](spark, sf_dir)
    assert found.filter("kept").count() == found.select("component_id").distinct().count()


def crowd(seed, members, words):
    """Texts of a crowded region: half keep near a common one, the others are too far from it and each other."""
    return [*family(seed, members // 2, words, 4), *family(seed, members // 2, words, 14)]


def test_crowded_regions_need_no_deeper_labels(spark, monkeypatch):
    # Deeper labels are 224 rows a set; a region that a few tasks can compare needs none.
    monkeypatch.setattr(forest, "_deeper", lambda *_: pytest.fail("labels of a deeper level"))
    check(spark, list(enumerate(crowd(7, 160, 150))))


@pytest.mark.parametrize("blocks", [1, 50])
def test_crowded_regions_are_compared_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(forest, "CROWD", 4)
    monkeypatch.setattr(forest, "BLOCK", 6)
    monkeypatch.setattr(forest, "BLOCKS", blocks)
    monkeypatch.setattr(forest, "DEPTHS", (1, 2, 3))
    check(spark, list(enumerate([*crowd(8, 80, 120), *crowd(9, 30, 90)])))


def test_blocks_are_small_for_large_sets(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_BYTES", 8 * 146 * 10)
    check(spark, list(enumerate(crowd(10, 100, 150))))


def test_a_crowded_region_makes_fewer_links_than_it_has_sets(spark, monkeypatch):
    made = []
    across = forest._across

    def counted(members, regions, *rest):
        found = across(members, regions, *rest)
        made.append((found.count(), members.join(regions, ["ord", "label"]).count()))
        return found

    monkeypatch.setattr(forest, "_across", counted)
    check(spark, list(enumerate(crowd(11, 300, 60))))
    assert made and all(links < sets for links, sets in made)
