"""Operator 10 against brute force: every pair of lines, on a generated corpus and on the smallest table."""

import random

import duckdb
import numpy as np
import pytest

from siltstone.llm.line_dedup import _Group, _shingle_sets, _windows, band_keys, dedup_lines, group_edges, prefix_keys

draw = random.Random(5)
VOCABULARY = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(300)]


def _sets(lines):
    return [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines]


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_force(rows, similarity=0.8):
    """``{doc: places removed}`` of rows with distinct ids."""
    places: dict = {}
    for doc, body in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        for at, line in enumerate(body.lower().split("\n")):
            if line := line.strip(" \t\x0b\x0c\r"):
                places.setdefault(line, []).append((doc, at))
    lines = list(places)
    sets = _sets(lines)
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(lines)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = set()
    for i, s in enumerate(sets):
        common: dict = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                up[top(j)] = top(i)
                pairs.add((i, j))
    groups: dict = {}
    for i, line in enumerate(lines):
        groups.setdefault(top(i), []).extend(places[line])
    removed: dict = {}
    for own in groups.values():
        for doc, at in sorted(own)[1:]:
            removed.setdefault(doc, set()).add(at)
    return removed, len(pairs)


def cut(rows, removed):
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed.get(d, ())) for d, t in rows}


def corpus():
    """Families of variants: near copies of one line, templates with a slot, short lines, accents and other scripts."""
    base = draw.choices(VOCABULARY, k=40)
    near = [" ".join(base[:k] + [f"x{n}"] + base[k + 1 :]) for n, k in enumerate(draw.choices(range(40), k=60))]
    slot = [" ".join(base[10:16] + draw.choices(VOCABULARY, k=3)) for _ in range(60)]
    short = ["page 1 of 20", "page 1 of 21", "the same short line", "the same short lines", "yes", "YES", "é", "a longer line of thirty chars!", "a longer line of thirty chars?"]
    wide = [" ".join(["汉字处理系统测试", *VOCABULARY[:20], f"第{n}章"]) for n in range(8)] + ["naïve straße " + " ".join(VOCABULARY[20:40]) + f" é{n}" for n in range(8)]
    lines = near + slot + short + wide + [" ".join(draw.choices(VOCABULARY, k=12)) for _ in range(60)]
    lines += draw.choices(lines, k=80)
    draw.shuffle(lines)
    return [(n + 1, "\n".join(lines[6 * n : 6 * n + 6])) for n in range(-(-len(lines) // 6))] + [(900, None), (901, ""), (902, " \n\t")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize(("crowd", "chars"), [(4096, 1 << 22), (40, 1 << 22), (3, 1 << 22), (4096, 900)])
def test_equals_brute_force(spark, rows, crowd, chars):
    """Also where buckets are crowded, and where they stay so after the second round."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = brute_force(rows)
    assert pairs > 100
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(frame, crowd=crowd, crowd_chars=chars, broadcast_rows=1_000_000 if crowd == 4096 else 0).collect()}
    texts = cut(rows, want)
    assert {d: n for d, (_, n) in got.items()} == {d: len(want.get(d, ())) for d in texts}
    assert {d: t for d, (t, _) in got.items()} == texts


def test_equals_brute_force_on_the_smallest_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want, _ = brute_force(rows)
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == {d: len(want.get(d, ())) for d, _ in rows}


def test_group_edges_join_what_links():
    base = draw.choices(VOCABULARY, k=30)
    for n in (2, 5, 7, 40, 150):
        lines = list(dict.fromkeys(" ".join(base[:k] + draw.choices(VOCABULARY, k=draw.randint(1, 3)) + base[k + 2 :]) for k in draw.choices(range(28), k=n)))
        sets = _sets(lines)
        want, got = list(range(len(lines))), list(range(len(lines)))
        for i in range(len(lines)):
            for j in range(i):
                if _jaccard(sets[i], sets[j]) >= 0.8:
                    want = [want[i] if x == want[j] else x for x in want]
        for i, j in group_edges(lines, 0.8):
            assert _jaccard(sets[i], sets[j]) >= 0.8
            got = [got[i] if x == got[j] else x for x in got]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_shingles_are_told_apart_as_strings_are():
    lines = ["abcdefgh", "straße é über", "汉字处理系统测试用例", "abcdefghi", "ĀāĂ㐀abcdefgh"]
    windows, ends, over = _windows(lines)
    at = np.setdiff1d(np.arange(len(windows)), over)
    text = "".join(lines)
    assert len(set(windows[at].tolist())) == len({text[i : i + 8] for i in at})
    assert [len(s) for s in _shingle_sets(lines)] == [len(s) for s in _sets(lines)]
    assert _shingle_sets(["abcdefgh"])[0] & _shingle_sets(["汉字abcdefgh"])[0]
    assert len(_Group(lines, 0.8).size) == len(lines)


def test_prefix_keys_miss_no_pair_and_bands_few():
    words = [draw.choices(VOCABULARY, k=30) for _ in range(300)]
    one = [" ".join(w) for w in words]
    two = [" ".join(w[:k] + [draw.choice(VOCABULARY)] + w[k + 1 :]) for w, k in zip(words, draw.choices(range(30), k=300), strict=True)]
    similar = [i for i in range(300) if one[i] != two[i] and _jaccard(*_sets([one[i], two[i]])) >= 0.8]
    assert len(similar) > 200
    bands = (band_keys(one) == band_keys(two)).any(axis=1)
    assert bands[similar].mean() > 0.97
    counts = np.random.default_rng(1).integers(0, 50, 1 << 20)
    for own in (None, counts):
        (a, na), (b, nb) = prefix_keys(one, 0.8, own), prefix_keys(two, 0.8, own)
        ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
        assert all(set(a[ends_a[i] - na[i] : ends_a[i]]) & set(b[ends_b[i] - nb[i] : ends_b[i]]) for i in similar)


def test_lines_far_from_their_hub_meet_all_others(spark):
    """A crowded key of several families, of which only the hub's own is similar to it."""
    from siltstone.llm import line_dedup
    from siltstone.llm.common import Scratch
    from siltstone.llm.graph import components

    lines = []
    for _ in range(5):
        base = draw.choices(VOCABULARY, k=30)
        lines += [" ".join(base[:k] + [f"y{k}"] + base[k + 1 :]) for k in draw.sample(range(30), 8)]
    rows = [(i, 7 * i, x) for i, x in enumerate(lines)]
    texts = spark.createDataFrame(rows, "h long, g long, line string")
    crowded = spark.createDataFrame([(1, h, len(x)) for h, _, x in rows] + [(2, h, len(x)) for h, _, x in rows if h % 2], "key long, h long, chars int")
    scratch = Scratch(spark, "hubs")
    edges, groups = line_dedup._around_hubs(scratch, crowded, texts, 0.8, crowd=6, crowd_chars=1 << 22)
    sizes = [r["count"] for r in groups.distinct().groupBy("grp").count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(lines) / 2
    joined = components(scratch, edges.unionAll(line_dedup._verified(groups.distinct(), texts, 0.8)))
    number = {r.node: r.h for r in texts.select("h", line_dedup._node().alias("node")).collect()}
    got = {number[r.node]: r.root for r in joined.collect()}
    sets = _sets(lines)
    want = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.8:
                want = [want[i] if x == want[j] else x for x in want]
    pairs = {(want[h], got.get(h, h)) for h in range(len(lines))}
    assert len(pairs) == len(set(want)) == len({b for _, b in pairs}) and len(set(want)) < len(lines)


def test_lines_meet_by_key_whatever_a_task_holds(spark, monkeypatch):
    from siltstone.llm import line_dedup

    some = random.Random(3)
    keys = [some.getrandbits(64) - (1 << 63) for _ in range(800)]
    rows = [([*some.choices(keys, k=some.randint(0, 4)), *([keys[0]] if h % 4 == 0 else [])] or None, h, 8 + h % 90) for h in range(600)] * 2
    want: dict = {}
    for own, h, _ in rows:
        for k in own or []:
            want.setdefault(k, set()).add(h)
    for held in (line_dedup._HELD, 40):
        monkeypatch.setattr(line_dedup, "_HELD", held)
        got = line_dedup._met(spark.createDataFrame(rows, "keys array<bigint>, h long, chars int").repartition(5), 10, 30, 4000).collect()
        assert {(x.key, x.h) for x in got if x.key is not None} == {(keys[0], h) for h in want[keys[0]]}
        groups: dict = {}
        for x in got:
            if x.key is None:
                groups.setdefault((x.grp, x.least), set()).add(x.h)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for k, g in want.items() if k != keys[0] and len(g) > 1}
        assert all(least == min(g) for (_, least), g in groups.items())


def test_joined_lines_are_not_compared_again():
    lines = [f"{'some line that is long enough ' * 3}{i % 5}" for i in range(40)]
    for few in (lines[:5], lines):
        assert len(group_edges(few, 0.8)) == len(few) - 1 and group_edges(few, 0.8, [0] * len(few)) == []
        assert len(group_edges(few, 0.8, [0, 0, 1, *[0] * (len(few) - 3)])) == 1
