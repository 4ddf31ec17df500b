"""Every operator and every stage of the pipeline over nulls in each column, repeated rows, long and empty texts, empty tables, and
extra columns named as the operators name their own."""

import collections

import pytest

from factloom.llm import byte_bpe, content_sort, language, licences, mixing, near_dup, quality, secrets, toxicity, transport_stream
from factloom.llm.common import table
from factloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside or give to what they return.
CLASHING = "_dropped _quality _row _key _range _tokens _norm _keep _carried carried_0 kept keep_id group_size band bands component component_id lead part is_member score spans y t n_tokens text_sha256 _epoch _budget _cut".split()
TEXTS = [None, "", " \t\n", "a", "A", "one two", "w " * 30000, "x" * 70000, "same text of six words here", "same text of six words here", "same  text of six words here", "\U0001f600 é", "\x00 nul", "Released under the MIT License."]


@pytest.fixture(scope="module")
def odd(spark):
    plain = [(i, t, "en" if i % 3 else None, "src1" if i % 4 else None, len(t or "") if i % 5 else None) for i, t in enumerate(TEXTS)]
    plain += [plain[8], plain[1], plain[3]]  # whole rows again
    plain += [(None, "same text of six words here", None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["z" if k % 2 else None for k, _ in enumerate(CLASHING)]) for r in plain], schema)


def operators(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return {
        "secrets": lambda d: secrets.scan_secrets(d, secrets.fit_secrets(secrets.labelled_findings(spark))),
        "toxicity": lambda d: toxicity.tag_toxicity(d, toxicity.fit_toxicity(docs, labels)),
        "toxicity fitted on it": lambda d: toxicity.tag_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, labels)),
        "content sort": content_sort.content_sort_dedup,
        "near duplicates": near_dup.near_duplicates,
        "media": transport_stream.media_digests,
        "licences": licences.scan_licences,
        "tokens": lambda d: byte_bpe.encode_digests(d, *tokenizer()),
        "language": lambda d: language.identify(d, language.fit_languages(docs)),
        "language fitted on it": lambda d: language.identify(d, language.fit_languages(d)),
        "mixing": lambda d: mixing.mix(d, {}, fraction=1.0),
    }


#: Operators with a row for every row of their table; the others return findings or a selection.
WHOLE = ["toxicity", "toxicity fitted on it", "quality", "content sort", "near duplicates", "media", "tokens", "language", "language fitted on it", "mixing"]


@pytest.mark.parametrize("name", ["secrets", "licences", *WHOLE])
def test_operator(spark, odd, name):
    run = operators(spark)[name]
    out = run(odd)
    ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    if name in WHOLE:
        assert ids == collections.Counter(r.doc_id for r in odd.select("doc_id").collect())
    nothing = run(odd.limit(0))
    assert nothing.collect() == [] and nothing.dtypes == out.dtypes


def test_stages(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    for at, (_, stage) in enumerate(pipeline.STAGES):
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            n = len(out.collect())
            assert n <= docs.count()
            if at < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_run_over_nothing(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
