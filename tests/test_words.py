"""What words tell, a batch at once, against a plain reading word by word."""

import re

import pyarrow as pa
import pytest

from factloom.operators import mechanics as M
from factloom.operators import words as W
from factloom.operators.phrases import BETWEEN, Phrases
from factloom.plans.mechanic_queries import PROSE, records

TEXTS = [
    "", " ", "...", "a", "the", "you should build a wall, then fill it with food", "requires level 3 party access", "a_b c-d e.f 12ab 345", "once systems start they begin to move", "in january and in may",
    "größer — schöner… «niño» ha’penny", "ein fall für die sicherheit der arbeit", "日本語 テキスト 42", "école ́x", "costs 5 food; costs 6 food; costs x food", "electricity and meals for defence", "electricity power meals energy",
    "it is not is it is", "first one two three four five six seven eight nine ten eleven twelve then", "first one two three four five six seven eight nine ten eleven twelve thirteen then", "kaltkeit wärmekeit reinheit nation acción mercado", "research _ unlocks new tech", "٣ times ３ times 3 times",
]


def plain(policy: M.Policy, low: str, around: str) -> tuple:
    """The reading that the batch replaces."""
    of = lambda text: re.findall("[\\w\u0300-\u036f]+", text)
    words, near = of(low), of(around)
    specific = lambda ws: len({w for w in ws if len(w) >= 4} - set(M.GENERIC_TOKENS))
    known = lambda by: [by[e] for w in dict.fromkeys(words) for e in (w, "-" + w[-4:], "-" + w[-2:]) if e in by]
    tokens = re.findall("[a-z0-9]{3,}", low)
    own = list(dict.fromkeys(known(policy.systems)))[:4]
    classes = list(dict.fromkeys([*known(policy.families), *(M.FAMILY_OF.get(s, "other") for s in own)]))[:4]
    keywords = list(dict.fromkeys(M.SYNONYMS.get(w, w) for w in [w for w in dict.fromkeys(words) if len(w) >= 6][:3]))
    return *policy.found.fold(words), policy.around.fold(near)[0], specific(words), specific(near), len(tokens), len(set(tokens)), own, classes, keywords, list(dict.fromkeys([*own, *classes, *keywords]))[:6]


def told(policy: M.Policy) -> W.Told:
    return W.Told(policy.found, policy.around, policy.systems, policy.families, M.FAMILY_OF, M.SYNONYMS, M.GENERIC_TOKENS)


def rows(parts) -> list[tuple]:
    return [row for counts, lists in parts for row in zip(*(c.tolist() for c in counts), *(x.to_pylist() for x in lists), strict=True)]


@pytest.mark.parametrize("policy", [M.Policy(), PROSE])
@pytest.mark.parametrize("most_bytes", [W.MOST_BYTES, 60])
def test_a_batch_is_told_as_its_rows_are(policy, most_bytes, monkeypatch):
    monkeypatch.setattr(W, "MOST_BYTES", most_bytes)
    every = [w for ps in M.PHRASES.values() for p in ps for w in [re.sub(r"_\d+", "zz yy", p.split("|")[0]).replace("#", "7"), " x ".join(p.replace("|", " ").split())]]
    low = TEXTS + every
    around = [" ".join(low[max(0, i - 1) : i + 2]) for i in range(len(low))]
    got = told(policy)
    assert rows(got(pa.array(low), pa.array(around))) == [plain(policy, a, b) for a, b in zip(low, around, strict=True)]
    assert rows(got(pa.array(low)[3:9], pa.array(around)[3:9])) == [plain(policy, a, b) for a, b in zip(low[3:9], around[3:9], strict=True)]
    assert rows(got(pa.array([], pa.string()), pa.array([], pa.string()))) == []
    assert rows(got(pa.array([None, "the"], pa.string()), pa.array([None, ""], pa.string()))) == [plain(policy, "", ""), plain(policy, "the", "")]


def test_facts_are_not_read_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(Phrases, "fold", None)  # the reading of one row
    low = pa.array(["the legend of a base", "it depends on that"])
    assert len(rows(told(PROSE)(low, low))) == 2
    plan = records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "vocabulary(" in plan and BETWEEN not in plan  # words are not put in line by an expression for each fact


def test_methods_that_the_machine_does_not_compile_are_not_generated(spark):
    records(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
