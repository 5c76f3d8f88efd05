"""Retrieval operators against brute force."""

import math
import random
from collections import Counter

from siltstone.operators import ranking
from siltstone.plans import registry


def test_every_hundredth_row_is_a_query_and_blocks_change_nothing(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, [float(draw.choice((-0.5, 0.5))) for _ in range(4)], i % 3) for i in range(450)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)), 6)
    asked = [r for r in rows if r[0] % 100 == 0]
    order = {q: sorted(((-score(v, w), i, label) for i, w, label in rows)) for q, v, _ in asked}
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()

    want = {(q, i, -s, n) for q, found in order.items() for n, (s, i, _) in enumerate(found[:20], 1)}
    assert {(r.qid, r.id, r.score, r.rank) for r in run("vector_topk")} == want
    of = {(q, k): [x for x in found if x[2] == k] for q, found in order.items() for k in range(3)}
    want = {(q, i, -s, n) for q, _, k in asked for n, (s, i, _) in enumerate(of[q, k][:20], 1)}
    assert {(r.qid, r.id, r.score, r.rank) for r in run("vector_topk_scoped")} == want
    want = {(q, k, i, n) for (q, k), found in of.items() for n, (_, i, _) in enumerate(found[:3], 1)}
    assert {(r.qid, r.label, r.id, r.rank) for r in run("topk_per_label")} == want
    assert {(r.qid, r.id, r.rank) for r in run("rerank_pool")} == {(q, i, n) for q, found in order.items() for n, (_, i, _) in enumerate(found, 1)}

    queries = spark.createDataFrame([(q, v) for q, v, _ in asked], "qid long, q array<float>")
    vectors = spark.createDataFrame([(i, v) for i, v, _ in rows], "id long, vector array<float>")
    for block in (None, 2, 100):
        got = ranking.top_k(queries, vectors, 7, block=block)
        assert {(r.qid, r.id, r.rank) for r in got.collect()} == {(q, i, n) for q, found in order.items() for n, (_, i, _) in enumerate(found[:7], 1)}


def test_blocks_of_odd_rows(spark):
    """Nulls, other lengths, equal vectors and text ids, against a plain loop; few rows a block and cell, and none."""
    from siltstone.operators.nearest import nearest

    rows = [(f"v{i}", [1.0, 0.0] if i % 3 else [0.5, float(i % 5)], None if i == 7 else i % 2) for i in range(40)]
    rows += [("n", None, 0), ("short", [1.0], 1), ("hole", [1.0, None], 0), ("nan", [float("nan"), 1.0], 1), ("none", [], 0)]
    asked = [(1, [1.0, 0.5], 0), (2, [-1.0, 0.0], 1), (3, None, 0), (4, [0.0, 1.0], None), (5, [2.0], 1)]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>, kind int")
    queries = spark.createDataFrame(asked, "qid long, q array<double>, q_kind int")

    def plain(k, same, per):
        out = set()
        for q, a, own in asked:
            met = []
            for i, v, kind in rows:
                if a is None or v is None or len(a) != len(v) or None in v or (same and (own is None or own != kind)):
                    continue
                s = round(sum(x * y for x, y in zip(a, v, strict=True)), 6)
                if s == s:
                    met.append((-s, i, kind))
            for part in {m[2] for m in met} if per else {None}:
                own_part = sorted((m[:2] for m in met if not per or m[2] == part))
                out |= {(q, part, i, -s, n) for n, (s, i) in enumerate(own_part[:k], 1)}
        return out

    for same, per in ((None, None), (("kind", "q_kind"), None), (None, "kind")):
        for block in (None, 2):
            got = ranking.top_k(queries, vectors, 4, same=same, per=per, block=block).collect()
            assert {(r.qid, r.kind if per else None, r.id, r.score, r.rank) for r in got} == plain(4, same, per)
    small = nearest(queries, vectors, 4, block_rows=2, cell_rows=7)
    assert {(r.qid, r.id, r.score) for r in small.collect()} >= {(q, i, s) for q, _, i, s, _ in plain(4, None, None)}
    assert nearest(queries, vectors.limit(0), 4).count() == 0 and nearest(queries.limit(0), vectors, 4).count() == 0


def test_rerank_keeps_rows_without_a_vector_behind(spark):
    pool = spark.createDataFrame([(1, 10, None), (2, 11, [0.0, 1.0]), (3, 12, None), (4, 13, [1.0, 0.0])], "pos long, id long, vector array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qid long, q array<float>")
    got = {(r.qid, r.rank): r.id for r in ranking.rerank(queries, pool, block=1).collect()}
    assert [got[0, n] for n in range(1, 5)] == [13, 11, 10, 12] and [got[1, n] for n in range(1, 5)] == [11, 13, 10, 12]


def test_full_text_queries_ask_all_terms(spark, tmp_path):
    draw = random.Random(5)
    some = ["ab", "cd", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "x"]
    items = {i: [*draw.sample(some, 8), "uno"] for i in range(4)}
    docs = {i: draw.choices(some, k=draw.randint(1, 12)) for i in range(60)} | {60: items[0] + ["x"], 61: items[1], 62: items[0][:3]}
    spark.createDataFrame([(i, " ".join(w).title()) for i, w in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = {q: {t for t in w if len(t) >= 2} for q, w in items.items()}
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.qid, r.id) for r in run("fts_and_match")} == {(q, i) for q, t in asked.items() for i, w in docs.items() if t <= set(w)}

    df, mean = Counter(t for w in docs.values() for t in set(w)), sum(map(len, docs.values())) / len(docs)
    idf = {t: max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 0) or 1e-6 for t, n in df.items()}
    part = lambda t, w: idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    want = set()
    for q, terms in asked.items():
        found = sorted((-round(sum(part(t, w) for t in terms & set(w)), 6), i) for i, w in docs.items() if terms & set(w))
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(found[:5], 1)}
    assert {(r.qid, r.id, r.score, r.rank) for r in run("fts_bm25")} == want


def test_each_page_is_a_hit(spark, tmp_path):
    words = [f"w{i}" for i in range(1201)]
    docs = [(1, " ".join(words)), (2, "one page")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path, r.page): r.context for r in registry.queries()["context_window"](spark, str(tmp_path)).collect()}
    marks = lambda p: [line for line in got[p].split("\n") if line.startswith("---")]
    long, short = "/s/en/doc_1.txt", "/s/en/doc_2.txt"
    assert set(got) == {(long, 1), (long, 2), (long, 3), (short, 1)}
    assert marks((long, 1)) == ["--- Pag. 1 [PAG ACTUAL] ---", "--- Pag. 2 ---"] and marks((long, 3)) == ["--- Pag. 2 ---", "--- Pag. 3 [PAG ACTUAL] ---"]
    assert marks((long, 2))[1] == "--- Pag. 2 [PAG ACTUAL] ---" and got[short, 1] == "--- Pag. 1 [PAG ACTUAL] ---\none page"
