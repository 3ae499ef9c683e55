import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from chatrisk.llm import alignment as al

SCHEMA = "doc_id bigint, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(coders, text):
    """Groups of id lists on either side, from whole texts and shared end offsets; None without tokens."""
    if not text:
        return None
    (a,), b = coders.a.encode_batch([f" {text}"], add_special_tokens=False), coders.b.encode(text)
    spelt = [[coders.a_bytes[x] for x in a.ids], [coders.b_bytes[x] for x in b]]
    if any(b"".join(s) != f" {text}".encode() for s in spelt):
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in shared]
    for side, ids in enumerate((a.ids, b)):
        for end, token in zip(ends[side], ids):
            groups[bisect_left(shared, end)][side].append(token)
    return groups


def brute(coders, rows):
    found = [(i, whole(coders, t)) for i, t in rows]
    links = [Counter((a, b) for g in (groups or []) for a in g[0] for b in g[1]) for _, groups in found]
    count = Counter(pair for own in links for pair in own)
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for (i, groups), own in zip(found, links):
        line = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append((
            str(i), *(sum(len(g[k]) for g in groups or []) for k in (0, 1)), len(groups or []), sum(own.values()),
            sum(n for pair, n in own.items() if count[pair] == highest[pair[0]]), sum(n * count[pair] for pair, n in own.items()),
            hashlib.sha256(line.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def odd_rows():
    random.seed(3)
    words = ["the", "Theban", "naïve", "überall", "日本語", "文字", "x<|endoftext|>y", "don't", "100", "3.14", " odd", "a\tb", "é"]
    rows = [(k, " ".join(random.choices(words, k=random.randint(1, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "  two  spaces here "), (105, "line\nline\n\n next\r\n"), (106, "tab\t x y z")]
    rows += [(107, "has▁block"), (108, "<|endoftext|>"), (109, "<s> </s> <unk>"), (110, "<0x41> \x00 nul"), (111, "\U0001f600 \U0001f468‍\U0001f469"), (112, "a " * 30)]
    rows += [(5, rows[5][1]), (5, "other"), (None, rows[7][1]), (113, "a" * 3000), (114, "あ" * 700 + " end"), (115, "x\n y\u0085 z \x1c w")]
    rows += [(200, " ".join(random.choices(words, k=20_000)))]
    return rows


@pytest.mark.parametrize("chars", [al.CHUNK_CHARS, 50])
def test_equals_whole_texts(table, chars):
    rows = odd_rows()
    out = al.aligned(table(rows, SCHEMA).repartition(3), chars=chars).select(*COLUMNS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in out) == brute(al.tokenizers(al.BYTE_BPE, al.PIECE_BPE), rows)


def test_long_groups_and_forgotten_segments(table, monkeypatch):
    rows = odd_rows()
    coders = al.tokenizers(al.BYTE_BPE, al.PIECE_BPE)
    monkeypatch.setattr(al, "GROUP_LINKS", 1)
    monkeypatch.setattr(al, "MEMO_SEGMENTS", 4)
    memo = al.Segments(coders)
    for i, text in rows:
        own, groups = al.Aligned(memo, [text]), whole(coders, text)
        want = Counter((a, b) for g in (groups or []) for a in g[0] for b in g[1])
        assert dict(zip(((c >> 32, c & 0xFFFFFFFF) for c in own.codes.tolist()), own.times.tolist())) == want


def test_overlaps_are_coalesced():
    a, b = al.coalesced(np.array([2, 3, 1, 4]), np.array([1, 1, 4, 2, 2]))
    assert a.tolist() == [0, 1, 1, 2] and b.tolist() == [0, 0, 1, 2, 2]


def test_empty_and_clashing_columns(table):
    assert al.aligned(table([], SCHEMA)).count() == 0
    clash = table([(1, "a b", 7, "x"), (2, None, 8, "y")], SCHEMA + ", chunk int, codes string")
    assert sorted(tuple(r) for r in al.aligned(clash).select("doc_id", "n_a").collect()) == [(1, 2), (2, 0)]
    assert al.aligned(table([(1, None)], SCHEMA)).first()["groups_sha256"] == ""
