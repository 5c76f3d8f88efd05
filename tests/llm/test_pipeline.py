"""The registered queries on the smallest tables, and the pipeline's stages one after another."""

import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import registry

DATA = "/root/testdata/sf0.001"
SHINGLE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("pipeline", "op7_chat_format", "op8_packing", "op9_decontamination")])
def test_one_row_for_each_document(spark, texts, name):
    assert sorted(r.doc_id for r in registry.queries()[name](spark, DATA).select("doc_id").collect()) == sorted(texts)


def test_held_out_documents_are_named_right_and_told_right(spark):
    rows = registry.op3_language_id(spark, DATA).collect()
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_overlaps_hold_every_item_that_a_text_contains(spark, texts):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall())
    found = {(r.doc_id, r.item_id) for r in registry.op9_decontamination(spark, DATA).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= found


def test_conversations_come_back(spark):
    rows = {r.conv_id: r for r in registry.op7_chat_format(spark, DATA).collect()}
    said = duckdb.sql(f"SELECT conv_id, count(*), sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) FROM '{DATA}/conversations.parquet' GROUP BY 1").fetchall()
    assert {c: (n, k) for c, n, k in said} | {-1: (2, 34)} == {c: (r.n_turns, r.loss_chars) for c, r in rows.items()}


def test_stages_keep_columns_and_do_their_part(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    left = {r.doc_id: r.text for r in docs.collect()}
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    assert not any(x in t for t in left.values() for x in items)
    lines = [x.strip().lower() for t in left.values() for x in t.split("\n") if len(x.strip()) >= 20]
    assert len(lines) == len(set(lines))
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").collect()} == set(left)


def _brute_components(prints):
    """``{id: least id reached}`` of ``{id: fingerprint}`` at 4 bits."""
    up = {d: d for d in prints}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


def test_stages_equal_brute_force(spark):
    from siltstone.llm import simhash
    from test_line_dedup import brute_force, cut

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}

    scores = {r.doc_id: r.score for r in registry.op4_toxicity(spark, DATA).collect()}
    kept = stages["toxicity"](spark, docs, DATA)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts == {d: t for d, t in before.items() if scores[d] < 0.7}

    removed, _ = brute_force(sorted(texts.items()))
    want = {d: t for d, t in cut(sorted(texts.items()), removed).items() if d not in removed or SHINGLE.search(t)}
    kept = spark.createDataFrame(stages["line_dedup"](spark, kept, DATA).toPandas(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts == want and all(r.n_chars == len(r.text) for r in kept.collect() if r.doc_id in removed)

    prints = dict(zip(texts, simhash.fingerprints([(t or "").encode() for t in texts.values()]).tolist(), strict=True))
    root = _brute_components(prints)
    kept = spark.createDataFrame(stages["near_duplicates"](spark, kept, DATA).toPandas(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {d for d, r in root.items() if d == r}

    db = duckdb.connect()
    frame = kept.toPandas()  # noqa: F841  read by the SQL
    db.sql("CREATE VIEW documents AS SELECT * FROM frame")
    db.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    leaks = {r[0] for r in db.sql(registry.oracle_sql()["op9_decontamination"]).fetchall()}
    kept = stages["decontamination"](spark, kept, DATA)
    assert {r.doc_id for r in kept.collect()} == set(texts) - leaks


EDGES = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_removed int, h long, node long, copy_id long, score double"


def _edge_tables(spark, folder, rows):
    more = (7, 8, 9, 10, 11, 0.5)
    spark.createDataFrame([(*r, *more) for r in rows], EDGES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_edge_cases_pass_through_every_stage(spark, tmp_path):
    body = "\n".join(" ".join(f"w{(7 * i + 3 * k) % 97}" for k in range(12)) for i in range(5))
    leak = "before " + " ".join(f"bench{i}" for i in range(20)) + " after"
    long = " ".join(f"x{i * i % 9973}" for i in range(60_000))
    rows = [(1, body, "en", "a", 9), (2, body, None, None, None), (3, None, None, "a", None), (4, "", "en", "a", 0), (5, leak, "en", "a", 3), (6, long, "en", "a", 3), (7, "only these words stand here", "en", "a", 1), (7, "only these words stand here", "en", "a", 1), (None, "a row without its id", "en", "a", 1), (8, " \n\t", "en", "b", 3)]
    docs = _edge_tables(spark, str(tmp_path), rows)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == ids(docs)
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert ids(lines) == sorted([1, 3, 4, 5, 6, 7, 7, 8, None], key=repr) and lines.columns == docs.columns
    assert {(r.n_lines, r.n_removed, r.h) for r in lines.collect()} == {(7, 8, 9)}
    assert ids(stages["near_duplicates"](spark, docs, str(tmp_path))) == sorted([1, 3, 5, 6, 7, 7, None], key=repr)
    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == sorted([1, 2, 3, 4, 6, 7, 7, 8, None], key=repr)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 3, 6, 7, None}
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens[3] == 1 and tokens[7] % 2 == 0 and tokens[6] > 60_000 and all(len(p.ids) == 4 * p.length for p in pieces)


def test_empty_tables_pass_through_every_stage(spark, tmp_path):
    docs = _edge_tables(spark, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    assert registry.pipeline(spark, str(tmp_path)).count() == 0
