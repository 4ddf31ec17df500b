"""Sections and chunks by hand and against plain loops."""

import random
import re

from pyspark.sql import functions as F

from factloom.operators import sections as Z
from factloom.plans import section_queries
from factloom.sources.tables import table


def values(spark, texts, column):
    df = Z.with_sections(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "s")
    return [r.o for r in df.select("i", column.alias("o")).orderBy("i").collect()]


TEXT = "before\n\n# Walls\nstone\n## Gates\niron\nmore iron\n1. First Steps\nwood\n# Roofs\ntile"


def test_sections_by_hand(spark):
    got = values(spark, [TEXT, "one\n\ntwo\nlines\n \n\nthree", "", None, "a\n\nTHE IRON AGES OF STONE:\nbody", "no heading: here\nbody"], F.col("s"))
    assert [(s.heading, s.text) for s in got[0]] == [("", "before"), ("# Walls", "# Walls\nstone"), ("## Gates", "## Gates\niron\nmore iron"), ("1. First Steps", "1. First Steps\nwood"), ("# Roofs", "# Roofs\ntile")]
    assert [s.text for s in got[1]] == ["one", "two\nlines", "three"] and got[2] == got[3] == []
    assert [s.heading for s in got[4]] == ["", ""]  # capitals and a colon: 45 of the 55 hundredths that it takes
    assert [s.text for s in got[5]] == ["no heading: here\nbody"]
    merged = values(spark, ["one\n\ntwo", "x" * 600 + "\n\nshort\n\n" + "y" * 600], Z.merge_tiny_sections(F.col("s")))
    assert [[s.text for s in m] for m in merged] == [["one\n\ntwo"], ["x" * 600 + "\n\nshort", "y" * 600]]


def test_paths_and_budget(spark):
    paths = Z.with_paths(F.col("s"))
    got = values(spark, [TEXT], paths)[0]
    assert [(s.path, s.parent, s.depth) for s in got] == [("", "", 0), ("Walls", "", 1), ("Walls > Gates", "Walls", 2), ("Walls > First Steps", "Walls", 2), ("Roofs", "", 1)]
    budget = values(spark, [TEXT], Z.merge_to_budget(paths, 4))[0]
    assert [s.path for s in budget] == ["", "Walls", "Walls > Gates", "Roofs"] and budget[2].text.endswith("1. First Steps\nwood")  # one parent before cheaper ones
    budget = values(spark, [TEXT], Z.merge_to_budget(paths, 2))[0]
    assert len(budget) == 2 and "".join(s.text for s in budget).replace("\n", "") == TEXT.replace("\n", "")
    same = values(spark, ["# A\none\n# A\ntwo\n# B\nthree"], Z.merge_same_path(paths))[0]
    assert [(s.path, s.text) for s in same] == [("A", "# A\none\n\n# A\ntwo"), ("B", "# B\nthree")]
    assert values(spark, [None], Z.merge_to_budget(paths, 1)) == [[]]


def plain_pack(parts, most, between):
    out = []
    for p in parts:
        whole = out[-1] + between + p if out else p
        if out and -(-len(whole) // 4) <= most:
            out[-1] = whole
        else:
            out.append(p)
    return out


def plain_large(text, most):
    small = []
    for s in filter(None, re.split(r"(?<=[.!?])\s+", text, flags=re.ASCII)):
        small += plain_pack([w for w in re.split(r"\s+", s, flags=re.ASCII) if w], most, " ") if -(-len(s) // 4) > most else [s]
    return plain_pack(small, most, " ")


def test_packing_against_plain_loops(spark):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 30) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["x" * 500 + " y. z"]
    assert values(spark, texts, Z.split_large(F.col("t"), 20)) == [plain_large(t, 20) for t in texts]


def test_chunks_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    chunks = {}
    for r in section_queries.chunk_texts(spark, sf).orderBy("doc_id", "chunk_id").collect():
        chunks.setdefault(r.doc_id, []).append(r.text)
        assert r.tokens <= Z.MOST_CHUNK and r.tokens == max(1, -(-len(r.text) // 4))
    squeeze = lambda x: re.sub(r"\s+", "", x, flags=re.ASCII)
    assert {d: squeeze("".join(c)) for d, c in chunks.items()} == {d: squeeze(t) for d, t in text.items() if squeeze(t)}
    wished = values(spark, ["word. " * 4000, "", None], Z.chunk_texts(F.col("t"), F.col("s"), 10))
    assert [len(w) for w in wished] == [4, 0, 0]  # a section larger than 1500 tokens is split by that, whatever is wished
    wished = values(spark, ["\n\n".join(["word " * 400] * 20)], Z.chunk_texts(F.col("t"), F.col("s"), 5))
    assert [len(w) for w in wished] == [10]  # of sections of 500 tokens three with what joins them have 1501
