import hashlib
import re
from collections import defaultdict

from rainloom.llm import exactdup, neardup
from rainloom.llm.common import Scratch
from rainloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_exact_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = {(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in exactdup.duplicate_groups(documents).collect()} == want


def test_exact_heavy_and_light_paths_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    split = {tuple(r) for r in exactdup.duplicate_groups(df, share=0.01).collect()}
    plain = {tuple(r) for r in exactdup.duplicate_groups(df, share=0.9).collect()}
    assert split == plain
    assert sum(r[3] for r in split) == len({t for _, t in rows})


def test_exact_odd_rows(odd, empty):
    found = exactdup.duplicate_groups(odd).collect()
    assert len(found) == odd.count()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert by[1][0].keep_id == 2 and not by[1][0].kept and by[2][0].kept
    assert all(r.keep_id == 6 and r.group_size == 3 for r in by[5])
    assert by[None][0].kept
    kept = exactdup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 4, 6, 7, 8, 9]
    assert exactdup.duplicate_groups(empty).collect() == []


def test_near_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(documents).collect()}
    assert got == brute(rows)


def test_near_dense_group_around_a_hub(spark):
    """Variants that are near their common origin and often not each other must still meet it."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for _ in range(rng.choice((1, 1, 2, 2, 3))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert got == want


def test_near_odd_rows(odd, empty):
    found = {}
    for r in neardup.groups(odd).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [found[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert all(found[i][0].component_id == i and found[i][0].kept for i in (1, 2, 3, 4, 8, 9))
    assert found[6][0].component_id == 5 and not found[6][0].kept and len(found[5]) == 2
    assert found[8][0].n_shingles == 1
    assert neardup.groups(empty).collect() == []
    assert neardup.keep_representatives(odd).columns == odd.columns


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_split_region_covers_all_rows():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 3, (2_000, 12)).astype(">u2").view([("", ">u2")] * 12).ravel()).view(">u2").reshape(-1, 12)
    seen, sizes = set(), []
    neardup.split_region(keys, lambda rows: (seen.update(rows.tolist()), sizes.append(len(rows))), 0, 64, 16)
    assert seen == set(range(2_000)) and max(sizes) <= 64


def test_near_drops_rows_and_not_ids(spark):
    """Null and repeated ids: a row that loses takes no other row with it."""
    copy = " ".join(f"w{k}" for k in range(60))
    rows = [(1, copy), (None, copy + " more"), (None, "a text of its own without an id at all"), (7, copy + " again"), (7, "another text of its own with the same id")]
    left = neardup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text for r in left)) == sorted((rows[0][1], rows[2][1], rows[4][1]))


def test_near_template_families_over_a_region(spark):
    """Pairs just over the threshold among many documents of one template that are just under it."""
    import random

    rng = random.Random(5)
    base = [f"w{k}" for k in range(185)]
    rows = []
    for i in range(600):
        words = base + [f"o{i}x{k}" for k in range(15)]
        other = list(words)
        for k in rng.sample(range(4), 3):
            other[25 + 40 * k] = f"e{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_near_block_pairs_cover_a_region(spark):
    """Each two nodes of a region over REGION that are not of one component meet."""
    nodes = [f"n{k:03d}".encode() for k in range(600)]
    dense = spark.createDataFrame([("p", n) for n in nodes] + [("q", n) for n in nodes[:300]], "prefix string, node binary")
    roots = spark.createDataFrame([(n, nodes[0]) for n in nodes[:300]], "node binary, root binary")
    with Scratch(spark) as scratch:
        members = defaultdict(set)
        for r in neardup._block_pairs(dense, roots, scratch).collect():
            members[bytes(r.group)].add(bytes(r.node))
    met = {(a, b) for m in members.values() for a in m for b in m if a < b}
    assert all((a, b) in met for k, b in enumerate(nodes) if k >= 300 for a in nodes[:k])


def test_near_dense_family_does_not_depend_on_partitions(spark):
    """A family of 700 documents of one base, pairs just over the threshold and all others just under it."""
    import random

    rng = random.Random(3)
    base, rows, used = [f"w{k}" for k in range(400)], [], 0

    def varied(words, n):
        nonlocal used
        out = list(words)
        for at in rng.sample(range(0, 66), n):
            out[6 * at + 2] = f"u{used}"
            used += 1
        return out

    for _ in range(350):
        one = varied(base, 10)
        rows += [" ".join(one), " ".join(varied(one, 6))]
    rows = list(enumerate(rows))
    want, before = brute(rows), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    assert 300 < len({c for _, c in want.values()}) < 700
    try:
        for partitions, adaptive in ((4, "true"), (24, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_clashing_columns_are_carried(odd):
    for kept in (exactdup.drop_duplicates(odd), neardup.keep_representatives(odd)):
        assert kept.columns == odd.columns and {r.lost_key for r in kept.collect()} == {"y"}
