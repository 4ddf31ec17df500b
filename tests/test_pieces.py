"""Records made document by document, against those made fact by fact."""

import numpy as np
import pyarrow as pa
import pytest

from factloom.functions import text as X
from factloom.operators import mechanics as M
from factloom.operators import words as W
from factloom.plans import mechanic_queries as Q
from factloom.sources.tables import facts
from tests.test_words import TEXTS, plain, rows, told

LONG = "Ärger ÀÉÎ größe Σίσυφος ΟΔΥΣΣΕΥΣ " * 12 + "İstanbul the of Σ"
DOCS = [
    None, "", " ", "a. b? c!! d", f"{LONG}. {LONG}! {LONG}", ". . .", "if when requires level 3 party access. " * 30, "once x. y", LONG[:200] + "Σ. " + "Σ" * 300 + ". in january and", "january. in the of",
    "x" * 150 + " in. january in " + "y" * 150, "ends here. ", "日本語 。テキスト. " + "字" * 200 + ". z", " a  b\t\tc\x0bd \n. x\ty.\n z  ", "\ta  b\x1cc\u0085d. \f.  \r", "for a wall. once systems then. start. begin to move. costs. 5 food",
]


@pytest.mark.parametrize("policy", [M.Policy(), Q.PROSE])
def test_pieces_are_told_with_their_neighbours_around(policy):
    lengths = [1, 5, 1, len(TEXTS) - 7]
    doc = np.repeat(np.arange(4), lengths)
    edges = [[t[at] if len(t) > 40 else None for t in TEXTS] for at in (slice(-40, None), slice(40))]
    whole = [[e or t for e, t in zip(side, TEXTS, strict=True)] for side in edges]
    same = lambda i, k: 0 <= k < len(TEXTS) and doc[i] == doc[k]
    around = [" ".join([*([whole[0][i - 1]] if same(i, i - 1) else []), t, *([whole[1][i + 1]] if same(i, i + 1) else [])]) for i, t in enumerate(TEXTS)]
    got = told(policy).pieces(*(pa.array(x, pa.string()) for x in (TEXTS, *edges)), doc)
    assert rows([got]) == [plain(policy, t, a) for t, a in zip(TEXTS, around, strict=True)]


def test_white_space_collapses_as_columns_do(spark):
    texts = [t for d in DOCS for t in ([d] if d is None else [d, d.replace(" ", "  "), f" {d}\n"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert W.collapsed(pa.array(texts, pa.string())).to_pylist() == [r.c for r in df.select("i", X.collapse("t").alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize("most_bytes", [W.MOST_BYTES, 60])
def test_records_are_those_of_facts_with_their_context(spark, tmp_path, most_bytes):
    df = spark.createDataFrame([(i, t, "en", f"src{i}") for i, t in enumerate(DOCS)], "doc_id bigint, text string, lang string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    one = M.with_record(facts(spark, str(tmp_path), context=True), Q.BLOCKED, [], Q.BLOCK, Q.PATTERNS, Q.PROSE)
    names = [c for c in one.columns if c not in ("_told", "_around", "_low", "p")]
    old, tells = W.MOST_BYTES, lambda r: sorted((tuple(x[c] for c in names) for x in r.select(*names).collect()), key=repr)
    try:
        W.MOST_BYTES = most_bytes
        assert tells(Q.records(spark, str(tmp_path))) == tells(one)
    finally:
        W.MOST_BYTES = old


def test_parts_hold_whole_rows_in_their_order(monkeypatch):
    monkeypatch.setattr(W, "MOST_BYTES", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([["ab", None], [], ["c" * 9, "d"], ["e"], ["f", "g"]], pa.list_(pa.string()))], ["t"])
    assert [p["t"].to_pylist() for p in W.in_parts(batch[1:], "t")] == [[[]], [["c" * 9, "d"]], [["e"], ["f", "g"]]]
    assert [p["t"].to_pylist() for p in W.in_parts(batch, "t")][0] == [["ab", None], []]


@pytest.mark.parametrize("name", ["continuation_burden", "operational_values", "top_chunks"])
def test_no_surroundings_are_sent_and_no_fact_is_made_by_an_expression_for_each_condition(spark, name):
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("vocabulary(") == 1 and "regexp_replace(" not in plan and "lower(coalesce(" not in plan
