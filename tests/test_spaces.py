"""Object spaces along chains of revisions against a plain walk of each cell."""

import random
from collections import Counter

from pyspark.sql import functions as F

from leafmill.operators import spaces


def plain_space(head, bases, groups, held, entries, blobs, last=False):
    """(chain, objects, faults) of one cell."""
    chain, found, out, at = [], [], {}, head
    if head is None:
        return [], {}, [("no manifest", None, 0)]
    while at is not None:
        if at in chain:
            found.append(("cycle", chain[-1], len(chain) - 1))
            break
        chain.append(at)
        if at not in bases:
            found.append(("missing manifest", at, len(chain) - 1))
            break
        at = bases[at]
    seen = set()
    for rank, m in enumerate(chain):
        mine = sorted(groups.get(m, []), reverse=last)
        for _, g in mine:
            if g not in held:
                fault = "missing group"
            elif len(entries[g]["declared"]) != len(entries[g]["data"]):
                fault = "counts differ"
            else:
                fault = None
            if fault and g not in seen:
                found.append((fault, g, rank))
            seen.add(g)
            e = entries.get(g, {"declared": {}, "data": {}})
            parts = {}
            for pos in sorted(set(e["declared"]) & set(e["data"])):
                o, part = e["declared"][pos]
                parts[o, part] = e["data"][pos]
            for o in {o for o, _ in parts if o is not None}:
                meta, data, file = (parts.get((o, p)) for p in (spaces.META, spaces.DATA, spaces.FILE))
                if o in out or not meta or not data or meta[0] != "object" or data[0] != "object":
                    continue
                blob = file[2] if file and file[0] == "blob" else None
                has = bool(file and file[0] == "blob")
                out[o] = (rank, g, meta[1], data[1], blobs.get(blob), has and blob not in blobs)
    return chain, out, found


def made(seed):
    r = random.Random(seed)
    bases = {m: r.choice([None, m - 1, m - 1, m - 1, r.randrange(40), 999]) for m in range(40)} | {100 + i: 99 + i if i else None for i in range(70)}
    heads = {c: r.choice([None, r.randrange(40), r.randrange(40)]) for c in range(30)} | {77: 169}
    groups, held, entries = {}, set(), {}
    for g in range(60):
        groups.setdefault(r.randrange(40), []).append((len(groups) * 100 + g, g))
        if r.random() < 0.95:
            held.add(g)
        n = r.randrange(9)
        declared = {i: (r.choice([None, *range(4)]) if i % 5 == 0 else r.randrange(4), r.choice([1, 4, 1, 4, 2])) for i in range(n)}
        data = {i: (r.choice(["object", "object", "object", "blob", "excluded"]), r.choice([None, *range(90)]), r.choice([None, 1, 2, 3])) for i in range(n - (r.random() < 0.05))}
        entries[g] = {"declared": declared, "data": data}
    return bases, heads, groups, held, entries, {1: "one", 2: None}


def frames(spark, bases, heads, groups, held, entries, blobs):
    of = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return (
        of(list(heads.items()), "cell long, manifest long"),
        of([*bases.items(), (None, 3)], "manifest long, base long"),
        of([(m, pos, g) for m, each in groups.items() for pos, g in each], "manifest long, pos long, group long"),
        of([(g,) for g in held], "group long"),
        of([(g, i, *x) for g, e in entries.items() for i, x in e["declared"].items()], "group long, pos long, object long, part int"),
        of([(g, i, *x, [(1, 2)]) for g, e in entries.items() for i, x in e["data"].items()], "group long, pos long, kind string, value long, blob long, cells array<struct<a: long, b: long>>"),
        of(list(blobs.items()), "blob long, payload string"),
    )


def test_spaces(spark):
    for seed, last in ((1, False), (2, True)):
        bases, heads, groups, held, entries, blobs = made(seed)
        h, m, g, k, declared, data, b = frames(spark, bases, heads, groups, held, entries, blobs)
        want = {c: plain_space(x, bases, groups, held, entries, blobs, last) for c, x in heads.items()}
        chain = spaces.chains(h, m)
        assert Counter((x["cell"], x["manifest"], x["rank"]) for x in chain.collect()) == Counter((c, x, i) for c, (ch, _, _) in want.items() for i, x in enumerate(ch))
        found = spaces.faults(h, chain, m, g, k, declared, data)
        assert Counter(tuple(x) for x in found.collect()) == Counter((c, *x) for c, (_, _, fs) in want.items() for x in fs)
        got = spaces.objects(chain, g, declared, data, b, last).collect()
        mine = Counter((x["cell"], x["object"], x["rank"], x["group"], x["meta"], x["data"], x["file"], x["file_missing"]) for x in got)
        assert mine == Counter((c, o, *x) for c, (_, os, _) in want.items() for o, x in os.items())
        assert mine and all(x["cells"][0]["b"] == 2 for x in got)
        clean = {c for c, (_, _, fs) in want.items() if all(x[0] == "cycle" for x in fs)}
        assert {x["cell"] for x in spaces.without_faults(h, found).collect()} == clean
        empty = spaces.chains(h.limit(0), m)
        assert empty.count() == 0 and spaces.objects(empty, g, declared, data, b).count() == 0
        assert spaces.objects(chain, g.limit(0), declared.limit(0), data.limit(0), b.limit(0)).count() == 0
        assert spaces.chains(h, m.limit(0)).count() == sum(x is not None for x in heads.values())


def test_roots_take_the_newest(spark):
    chain = spark.createDataFrame([(1, 10, 0), (1, 9, 1), (2, 9, 0)], "cell long, manifest long, rank long")
    labels = spark.createDataFrame([(10, 0, 1, "new"), (10, 1, 1, "second"), (9, 0, 1, "old"), (9, 0, 2, "b"), (9, 0, 2, "a"), (8, 0, 3, "gone")], "manifest long, seq int, role int, root string")
    assert {tuple(x) for x in spaces.roots(chain, labels).collect()} == {(1, 1, "new"), (1, 2, "a"), (2, 1, "old"), (2, 2, "a")}


def test_labels_of_revisions_that_have_started(spark):
    schema = "space long, seq long, revision string, context string, role int, x int"
    starts = spark.createDataFrame([(1, 0, "a", None, 1, 0), (1, 5, "b", None, 1, 0), (1, 6, "b", "c", 1, 0), (2, 0, "z", None, 1, 0)], schema)
    declared = spark.createDataFrame([(1, 3, "b", None, 1, 0), (1, 7, "a", None, 1, 0), (1, 8, "q", None, 1, 0), (1, 9, "a", "c", 2, 0), (2, 1, "a", None, 1, 0)], schema)
    assert {tuple(x) for x in spaces.role_labels(starts, declared).collect()} == {(1, None, 1, "a"), (1, "c", 1, "b"), (1, "c", 2, "a"), (2, None, 1, "z")}


def test_references_of_the_own_space(spark):
    df = spark.createDataFrame([(1, 7, [(1, 7), (2, 8), (3, None), (4, 7)]), (2, None, [(1, 7)]), (3, 7, []), (4, 7, None)], "id int, space long, cells array<struct<a: long, b: long>>")
    got = {x["id"]: (x["contexts"], None if x["spaces"] is None else [tuple(s) for s in x["spaces"]]) for x in spaces.split_references(df, "cells", "space").collect()}
    assert got == {1: ([1, 4], [(2, 8), (3, None)]), 2: ([], [(1, 7)]), 3: ([], []), 4: (None, None)}
