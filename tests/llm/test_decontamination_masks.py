"""Two substituted words at every pair of places of a window, against the rule itself (11 of 13 words)."""

import itertools

from prismflow.llm import decontamination


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def holds(text, item):
    for shift in range(-len(item), len(text)):
        same = [0 <= k - shift < len(item) and text[k] == item[k - shift] for k in range(len(text))]
        inside = [k for k in range(len(text)) if 0 <= k - shift < len(item)]
        if any(sum(same[k : k + 13]) >= 11 for k in inside if k + 12 in inside):
            return True
    return False


def test_two_substitutions_at_all_places(spark):
    docs, items, n = [], [], 0
    for length, changes in ((13, itertools.combinations(range(13), 2)), (13, [(0, 5, 9)]), (15, itertools.combinations(range(15), 2)), (20, [(2, 9, 16), (1, 8, 13), (0, 9, 18)]), (59, [tuple(range(0, 59, 6))])):
        for places in changes:
            item = words(f"i{n}x", length)
            text = [f"other{n}x{k}" if k in places else w for k, w in enumerate(item)]
            docs.append((n, words("before", 7) + text + words("after", 5)))
            items.append((n, item))
            n += 1
    expected = {(d, i) for (d, text), (i, item) in zip(docs, items, strict=True) if holds(text, item)}
    assert n - 1 == len(expected)
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == expected
