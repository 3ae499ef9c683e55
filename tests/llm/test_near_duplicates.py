import random

import pytest

from chatrisk.llm import near_duplicates as nd
from chatrisk.llm.batches import spaced
from chatrisk.llm.components import components

SCHEMA = "doc_id bigint, text string"


def brute(rows, shingle, percent):
    """(set size, smallest id reachable) per row, by comparing all pairs."""
    sets, above = [], list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for _, text in rows:
        words = spaced((text or "").encode())
        width = min(shingle, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                above[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        own = [x for x in (least.get(top(i)), doc_id) if x is not None]
        least[top(i)] = min(own, default=None)
    return sorted((str(rows[i][0]), len(sets[i]), str(least[top(i)])) for i in range(len(rows)))


def copies(seed=7):
    """Unlike texts, exact copies, groups of near copies at many distances, and odd rows."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(60)]
    for group in range(3):
        origin = random.choices(words, k=120)
        for _ in range(40):
            text = list(origin)
            for _ in range(random.choice([0, 1, 2, 3, 4, 6])):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((1000 + len(rows), " ".join(text)))
    rows += [(5000 + i, rows[3][1].upper().replace(" ", "\n ")) for i in range(5)]
    rows += [(7, None), (8, ""), (8, "  "), (9000, "one"), (9001, "One"), (9002, "one two"), (None, rows[5][1]), (7, rows[6][1])]
    rows.append((9100, " ".join(random.choices(words, k=30_000))))
    return rows


@pytest.mark.parametrize("node, all_pairs", [(1024, 32), (6, 2)])
@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(table, monkeypatch, node, all_pairs, shingle, percent):
    monkeypatch.setattr(nd, "ALL_PAIRS", all_pairs)
    rows = copies()
    out = nd.near_duplicates(table(rows, SCHEMA), shingle, percent, node=node, levels=2).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out)
    assert got == brute(rows, shingle, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_one_document_of_each_group_stays(table):
    rows = copies()
    left = nd.deduplicated(table([(*r, "x") for r in rows], SCHEMA + ", key string")).collect()
    groups = brute(rows, 5, 80)
    assert len([r for r in left if (r["text"] or "").split()]) == len({(c,) for _, n, c in groups if n})
    assert len([r for r in left if not (r["text"] or "").split()]) == 3
    assert all(r["key"] == "x" for r in left)


def test_empty_table(table):
    assert nd.near_duplicates(table([], SCHEMA)).count() == 0
    assert nd.deduplicated(table([], SCHEMA)).count() == 0


def test_components_of_a_long_chain_and_a_star(session):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(session.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
