import random

from sourceloom.llm.common import stored_counting
from sourceloom.llm.neardup import components


def smallest_reachable(links):
    label = {n: n for link in links for n in link}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_chains_stars_and_chance(spark):
    rng = random.Random(5)
    chain = list(range(1000, 1040))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(7, k) for k in range(2000, 2300)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest_reachable(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_while_writing(spark):
    rows = spark.range(10)
    assert stored_counting(rows, rows.id > 6)[1] == 3
    out, n = stored_counting(rows.where("id < 0"))
    assert (out.count(), n) == (0, 0)
    assert stored_counting(spark.createDataFrame([], "id long").join(rows, "id"))[1] == 0


def test_signature_bytes_tell_unrelated_sets_apart():
    import numpy as np

    from sourceloom.llm import neardup

    rng = np.random.default_rng(3)
    for size in (20, 150, 600, 1500, 5000):
        sets = [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(40)]
        near = [np.concatenate([s[: size * 9 // 10], rng.integers(0, 2**63, size // 10, dtype=np.uint64)]) for s in sets]
        low, high = neardup.signatures(sets + near)
        held = (neardup.mix(np.concatenate([low, high]).T) >> np.uint64(56)).astype(np.uint8)
        agree = lambda a, b: 2 * np.count_nonzero(a == b) >= len(a)
        assert not any(agree(held[k], held[k + 1]) for k in range(39))
        assert all(agree(held[k], held[40 + k]) for k in range(40))
