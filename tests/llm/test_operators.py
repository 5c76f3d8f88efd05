"""The operators in Spark: edge cases and brute force on small tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import registry
from siltstone.llm.chat_format import format_chats, read_back
from siltstone.llm.common import Scratch
from siltstone.llm.decontamination import find_overlaps
from siltstone.llm.graph import components
from siltstone.llm.language_id import identify, sample_texts
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.packing import pack
from siltstone.llm.quality import quality
from siltstone.llm.secrets import learn, secret_spans
from siltstone.llm.simhash import bucket_edges, dense_edges, near_duplicates
from siltstone.llm.token_counts import count_tokens
from siltstone.llm.toxicity import Lexicon, learn_from, toxicity

draw = random.Random(11)
VOCABULARY = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)]
LONG = " ".join(draw.choices(VOCABULARY, k=30_000))
BODY = "\n".join(" ".join(draw.choices(VOCABULARY, k=25)) for _ in range(5))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, `row` long, node long, score double, at int"

#: Nulls in any column, empty and blank texts, a very long one, exact and repeated rows; further columns clash.
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 3), (4, BODY, "en", "a", 1), (5, BODY, None, "b", 1), (5, BODY, None, "b", 1), (6, LONG, "fr", "a", 1), (None, "few words here", "en", "a", 1), (7, "Ünï" * 3, "de", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, 9, 9, 0.5, 9) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(docs, none):
    ranks = registry.tokenizer_file("byte_bpe_50k.tiktoken")
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in count_tokens(docs, ranks).collect()]
    assert len(got) == len(ROWS) and got[:3] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)] and got[4] == got[5]
    assert got[6][1] == 30_000 and got[6][2] >= 30_000
    assert count_tokens(none, ranks).count() == 0


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    ids = {d: c for d, _, c in got}
    assert len(got) == len(ROWS) and ids[1] == ids[2] == ids[3] == 1 and ids[4] == ids[5] == 4 and ids[6] == 6
    assert ids[None] is None
    assert near_duplicates(none).count() == 0


def test_near_duplicates_with_crowded_buckets(spark):
    words = draw.choices(VOCABULARY, k=300)
    texts = [" ".join(words[:k] + [f"x{i}"] + words[k + 1 :]) for i, k in enumerate(draw.choices(range(300), k=60))] + [" ".join(draw.choices(VOCABULARY, k=50)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = near_duplicates(frame).collect()
    crowded = near_duplicates(frame, bucket_limit=3).collect()
    assert {r.doc_id: r.component_id for r in plain} == {r.doc_id: r.component_id for r in crowded}
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in plain}
    up = {d: d for d in fp}
    for _ in range(100):
        new = {d: min(up[e] for e in fp if (fp[d] ^ fp[e]).bit_count() <= 4) for d in fp}
        if new == up:
            break
        up = new
    assert {r.doc_id: r.component_id for r in plain} == up


def test_dense_buckets_link_as_others():
    import numpy as np

    for bits, n in ((8, 30), (14, 200), (14, 900), (3, 8)):
        some = draw.sample(range(1 << bits), n)
        prints = np.array([sum((x >> j & 1) << (4 * j + 1) for j in range(bits)) | 1 << 63 for x in some], dtype=np.uint64)

        def parts(edges):
            up = {int(p): int(p) for p in prints}
            for a, b in edges:
                assert (a ^ b).bit_count() <= 4 or edges is dense
                up = {k: up[a] if v == up[b] else v for k, v in up.items()}
            return {frozenset(k for k, v in up.items() if v == r) for r in up.values()}

        dense = dense_edges(prints, 4)
        assert parts(dense) == parts(bucket_edges(prints, 4))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (200, 150), (150, 120), (120, 200)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys((120, 150, 200), 120), **dict.fromkeys(range(500, 560), 500)}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, docs, none):
    rows = [(i, " ".join(draw.choices(v, k=80)), lang) for i, (lang, v) in enumerate([("aa", VOCABULARY), ("bb", ["ñandú", "zorro", "über", "wxyz", "qqq"])] * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = sample_texts(frame)
    out = frame.select("lang", identify(frame, samples).alias("f")).collect()
    assert all(r.lang == r.f.lang and 0 <= r.f.score <= 1 for r in out)
    got = docs.select("doc_id", identify(docs, samples).alias("f")).collect()
    assert [r.f.lang for r in got[:3]] == ["und"] * 3 and all(r.f.lang != "und" for r in got[3:])
    assert [r.f.lang for r in docs.select(identify(docs, {}).alias("f")).collect()] == ["und"] * len(ROWS)
    assert none.select(identify(none, samples)).count() == 0 and sample_texts(none) == {}


def test_toxicity(spark, docs, none):
    bad = ["vile", "rotten", "nasty"]
    rows = [(i, " ".join(draw.choices(VOCABULARY, k=40) + (draw.choices(bad, k=4) if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    lexicon = learn_from(frame.drop("y"), frame.select("doc_id", F.col("y").alias("toxic"), F.lit("x").alias("text")))
    out = frame.select("y", (toxicity(frame, lexicon) >= 0.7).alias("p")).collect()
    assert sum(r.y == r.p for r in out) >= 396
    scores = [r[0] for r in docs.select(toxicity(docs, lexicon)).collect()]
    assert len(scores) == len(ROWS) and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert learn_from(docs, labels) == Lexicon() and none.select(toxicity(none, lexicon)).count() == 0


def _brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_base(spark, docs, none):
    texts = [r[1] for r in ROWS] + ["a b c d e f g h " * 3, "a " * 30, "# x\n# x\n\n \n$$$", "p q r s t u v w x p q r s t u v w y " * 2, "\x0b\x0cé\x85b c"]
    frame = spark.createDataFrame([(i, t, "s", "z") for i, t in enumerate(texts)], "doc_id long, text string, source string, row string")
    for r in quality(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality(docs).count() == len(ROWS) and quality(none).count() == 0


def test_quality_removes_frequent_lines(spark):
    common = " ".join(VOCABULARY[:30])
    rows = [(i, f"{common} {i % 7}\n" + " ".join(draw.choices(VOCABULARY, k=12 if i % 2 else 60)), "h") for i in range(60)]
    rows += [(100, f"{common} 3\nshort words", "other"), (101, f"{common} 3\nshort", None)]
    out = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].removed_chars > 0 and out[i].kept == (i % 2 == 0) for i in range(60))
    assert out[100].removed_chars == out[101].removed_chars == 0 and out[100].kept


def test_quality_texts_lose_the_frequent_lines(spark):
    own = [f"Own {a}{b} line" for a in VOCABULARY[:8] for b in VOCABULARY[:5]]
    rows = [(i, f" Page {i} OF 12\r\n\n{x}\nMENU  \n\nmenu\n{x}\n", "h") for i, x in enumerate(own)]
    rows += [(50, "MENU\npage 3 of 4\r", "h"), (50, "MENU\npage 3 of 4\r", "h"), (51, "only this", "h"), (52, None, "h"), (53, "", "h"), (54, "MENU\nb", "other"), (55, "menu\n" * 3000 + "last", "h"), (56, "7 MENU", "h")]
    got = sorted((r.doc_id, r.text or "", r.text is None, r.removed_chars) for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    want = [(i, f"\n{x}\n\n{x}\n", False, 12 + 4 + 4) for i, x in enumerate(own)]
    want += [(50, "", False, 4 + 12)] * 2 + [(51, "only this", False, 0), (52, "", True, 0), (53, "", False, 0), (54, "MENU\nb", False, 0), (55, "last", False, 12000), (56, "7 MENU", False, 0)]
    assert got == want


def test_secrets(spark, docs, none):
    ratio = learn([" ".join(VOCABULARY)])
    got = docs.select("doc_id", secret_spans(docs, ratio).alias("s")).collect()
    assert len(got) == len(ROWS) and got[0].s == got[1].s == []
    one = spark.createDataFrame([(1, "é token: 0123456789abcdef0")], "doc_id long, text string")
    assert [tuple(x) for x in one.select(secret_spans(one, ratio).alias("s")).first().s] == [("assign", 2, 26), ("hex", 9, 26)]
    assert none.select(secret_spans(none, ratio)).count() == 0


def test_chats(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>\n"), (1, 0, "user", None), (2, 0, None, "x"), (None, 3, "assistant", ""), (3, 0, "user", "q"), (3, 0, "assistant", "q"), (4, None, "assistant", "n")]
    frame = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    out = format_chats(frame)
    got = {r.conv_id: r.r for r in out.select("conv_id", read_back(F.col("formatted"), F.col("loss_spans")).alias("r")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb<|im_end|>\n\n") and got[1].loss_sha256 == sha("b<|im_end|>\n") and got[1].loss_chars == 12
    assert got[2].n_turns == 1 and got[3].turns_sha256 == sha("assistant\nq\nuser\nq\n") and set(got) == {1, 2, 3, 4, None}
    assert format_chats(frame.limit(0)).count() == 0


def test_packing(docs, none):
    json = registry.tokenizer_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json)
    pieces = pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), json, block_tokens=20_000).collect()
    want = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS if r[0] is not None}
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, own in by_doc.items():
        raw = b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))
        assert raw == b"".join(i.to_bytes(4, "little") for i in want[d]) and all(p.doc_tokens == len(want[d]) for p in own)
        assert all(len(p.ids) == 4 * p.length for p in own)
    assert set(by_doc) == set(want)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert total == 4096 or math.log2(total).is_integer()
    assert pack(none, json).count() == 0


def test_decontamination(spark, docs, none):
    item = VOCABULARY[:30]
    changed = [w if i % 7 else "changed" for i, w in enumerate(item)]
    around = lambda xs: " ".join(draw.choices(VOCABULARY, k=50) + xs + draw.choices(VOCABULARY, k=50))
    rows = [(1, around(item)), (2, around(changed)), (3, around(item[:6])), (4, around([])), (5, " ".join(item).upper().replace(" ", ", ")), (6, None), (7, ""), (1, around(item)), (None, " ".join(item))]
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, "too short", 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc long")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (500_000, 0):
        got = {(r.doc_id, r.item_id): r.overlap for r in find_overlaps(frame, bench, broadcast_rows=bound).collect()}
        assert set(got) == {(1, 10), (2, 10), (5, 10), (None, 10)} and got[1, 10] == 1.0 and 0.8 <= got[2, 10] < 1
    assert find_overlaps(docs, bench).count() == 0
    assert find_overlaps(none, bench).count() == find_overlaps(frame, bench.limit(0)).count() == 0


def test_decontamination_of_items_under_the_window(spark):
    from itertools import combinations

    rows, bench = [], []
    for n in range(1, 13):
        item = [f"{w}{n}" for w in VOCABULARY[20 * n : 20 * n + n]]
        bench.append((n, " ".join(item)))
        for gone in combinations(range(n), n // 5):  # n // 5 is the most that leaves 0.8
            rows.append((100 * len(rows) + n, " ".join(["before", *("changed" if i in gone else w for i, w in enumerate(item)), "after"])))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for bound in (500_000, 0):
        assert {(r.doc_id, r.item_id) for r in find_overlaps(docs, items, broadcast_rows=bound).collect()} == {(d, d % 100) for d, _ in rows}


def test_line_dedup(spark, docs, none):
    line = " ".join(VOCABULARY[:60])
    near = line.replace(VOCABULARY[30], VOCABULARY[30] + "z")
    other = " ".join(VOCABULARY[100:140])
    rows = [(2, f"{line}\nshort\n\n{other}"), (1, f"short\n {near.upper()} "), (3, f"{line}\n{line}"), (4, None), (5, ""), (6, "short")]
    for crowd in (4096, 2):
        got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, min_chars=20).collect()}
        assert got[1].text == rows[1][1] and got[1].n_removed == 0
        assert got[2].text == f"short\n\n{other}" and got[2].n_removed == 1 and got[2].n_lines == 4
        assert got[3].text == "" and got[3].n_removed == 2
        assert got[4].text is None and got[5].text == "" and got[6].text == "short"
    out = dedup_lines(docs).collect()
    assert len(out) == len(ROWS)
    assert sum(r.n_removed for r in out if r.doc_id == 4) == 0 and all(r.n_removed == 5 for r in out if r.doc_id == 5)
    assert dedup_lines(none).count() == 0


def test_short_lines_link_to_equal_and_similar_ones(spark, tmp_path):
    from siltstone.llm import registry

    short = "nineteen characters"
    rows = [(1, f"yes\n\n{short}"), (2, f"no\nYES \n\n{short}s"), (3, f"{short}\n  \nno\nno"), (4, "é"), (5, "É\ny"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars) for r in registry.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, 24), 2: (4, 2, 3), 3: (4, 3, 2), 4: (1, 0, 1), 5: (2, 1, 1), 6: (1, 0, None)}
