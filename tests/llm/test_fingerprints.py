import random

import pytest
import xxhash

from chatrisk.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(len(words) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, values, radius):
    above = list(range(len(ids)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                above[top(i)] = top(j)
    least = {}
    for i, doc_id in enumerate(ids):
        own = [x for x in (least.get(top(i)), doc_id) if x is not None]
        least[top(i)] = min(own, default=None)
    return [least[top(i)] for i in range(len(ids))]


def texts():
    random.seed(11)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(random.choices(words, k=random.randint(1, 80)))) for k in range(80)]
    for origin in range(4):
        base = random.choices(words, k=150)
        for _ in range(30):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((500 + len(rows), " ".join(own)))
    rows += [(3, rows[3][1].upper()), (3, None), (900, ""), (901, " \n"), (902, "One"), (903, "one"), (None, rows[9][1]), (None, "alone here")]
    rows.append((904, " ".join(random.choices(words, k=70_000))))
    return rows


@pytest.mark.parametrize("bucket", [64, 1])
def test_equals_brute_force(table, bucket):
    rows = texts()
    values = [plain(t) for _, t in rows]
    want = sorted(zip((str(i) for i, _ in rows), (f"{v:016x}" for v in values), map(str, smallest_reachable([i for i, _ in rows], values, 2))))
    out = fp.near_fingerprints(table(rows, SCHEMA), bucket=bucket).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    found = fp.masks(radius)
    assert len(found) == 2 ** (radius + 1) - 1
    random.seed(radius)
    for _ in range(3000):
        difference = sum(1 << bit for bit in random.sample(range(64), random.randint(1, radius)))
        assert any(difference & mask == 0 for mask in found)


@pytest.mark.parametrize("radius, bucket", [(1, 64), (1, 2), (2, 2)])
def test_links_in_buckets_of_any_size(session, radius, bucket):
    """A dense cloud of fingerprints: every class is linked with the others as all pairs say."""
    random.seed(5)
    values = {0, -1}
    while len(values) < 300:
        own = random.choice(sorted(values))
        for bit in random.sample(range(64), random.choice([1, 2, 3, 9])):
            own ^= fp._signed(1 << bit)
        values.add(own)
    values = sorted(values)
    classes = session.createDataFrame([(v,) for v in values], "bits bigint")
    members = fp.bucketed(classes, radius)
    small, large = members.filter(f"n <= {bucket}"), members.filter(f"n > {bucket}")
    labels = fp.components(fp.direct_links(small, radius).unionByName(fp.meeting_links(large, radius)))
    label = {r["node"]: r["component"] for r in labels.collect()}
    unsigned = [v & (2**64 - 1) for v in values]
    want = smallest_reachable(values, unsigned, radius)
    assert [label.get(v, v) for v in values] == want


def test_empty_and_clashing_columns(table):
    assert fp.near_fingerprints(table([], SCHEMA)).count() == 0
    clash = table([(4, "a b c", 1, 2), (2, "A  b c", 3, 4)], SCHEMA + ", bits int, component_id int")
    assert sorted(tuple(r) for r in fp.near_fingerprints(clash).select("doc_id", "component_id").collect()) == [(2, 2), (4, 2)]
