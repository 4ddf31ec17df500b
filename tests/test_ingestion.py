"""Pages to facts by section against a plain loop; packages that were cut off; batches with broken jobs."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import ingestion as I
from factloom.operators import mechanics as M
from factloom.sources import packages

PAGES = [
    (1, "# Intro\nPlain walls stand here. Plain walls stand here! Tap on the menu. Heat moves over copper.\n## Walls\nPlain walls stand here. Doors slow the guards down.\n# Other\nHeat moves over copper. Doors slow the guards down. New stone floors shine."),
    (2, "No heading at all here. Heat moves over copper. "), (3, ""), (4, None), (5, "# Empty\n\n# Full\nWater runs down the pipe."),
]


def test_ingest_is_what_a_plain_loop_makes(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, text string")
    out = I.ingest(pages, M.Policy())
    rows = M.with_record(I.candidates(I.sections_of(pages))).select(*I.PLACE, "fact", "drop_reason").collect()
    seen, per, stays = {}, {}, {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in I.PLACE)):
        at = per.setdefault((r.page_id, r.section), {"candidates": 0, "passed": 0, "within": set(), "first": 0})
        at["candidates"] += 1
        if r.drop_reason is None:
            at["passed"] += 1
            at["within"].add(r.fact.lower())
            if r.fact.lower() not in stays:
                stays[r.fact.lower()] = tuple(r[c] for c in I.PLACE)
                at["first"] += 1
            seen.setdefault(r.fact.lower(), set()).add((r.page_id, r.section))
    density = {(r.page_id, r.section): r for r in out["density"].collect()}
    assert set(per) <= set(density) and {k for k, r in density.items() if r.candidates} == set(per)
    for k, r in density.items():
        want = per.get(k, {"candidates": 0, "passed": 0, "within": (), "first": 0})
        assert (r.candidates, r.passed, r.within, r["first"]) == (want["candidates"], want["passed"], len(want["within"]), want["first"])
        assert r.per_thousand_tokens == pytest.approx(r["first"] * 1000 / r.tokens if r.tokens else 0, abs=1e-3)
    facts = {r.fact.lower(): r for r in out["facts"].collect()}
    assert {k: tuple(r[c] for c in I.PLACE) for k, r in facts.items()} == stays and all(r.n_sections == len(seen[k]) for k, r in facts.items())
    assert len(stays) < sum(d.passed for d in density.values()) and any(r.drop_reason for r in rows)
    assert all(df.collect() == [] for df in I.ingest(pages.limit(0)).values())


def test_a_package_appears_as_a_whole(spark, tmp_path):
    path, one = str(tmp_path), spark.range(3)
    assert packages.read_package(spark, path) == {}
    assert packages.commit_package({"a": one, "b": spark.range(5)}, path, {"k": 1}) == 1
    broken = one.select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        packages.commit_package({"a": spark.range(9), "b": broken}, path)  # stopped between its parts
    read = packages.read_package(spark, path)
    assert {n: df.count() for n, df in read.items()} == {"a": 3, "b": 5}
    (tmp_path / "manifests" / "00000002.json").write_text('{"version": 2, "ru')  # stopped within its manifest
    assert packages.read_package(spark, path)["a"].count() == 3
    assert packages.commit_package({"a": spark.range(7)}, path) == 3
    assert {n: df.count() for n, df in packages.read_package(spark, path).items()} == {"a": 7}
    assert packages.read_package(spark, path, 1)["b"].count() == 5 and packages.read_package(spark, path, 9) == {}
    assert len(packages.purge_packages(spark, path, keep=1)) == 2 and packages.read_package(spark, path)["a"].count() == 7


def test_jobs_fail_one_by_one_and_only_those_left_run_again(spark):
    docs = spark.createDataFrame([(1, "Plain walls stand here. Tap on the menu."), (2, "x" * 50), (3, None), (4, ""), (5, "Tap on the menu."), (6, "Heat moves over copper.")], "doc_id long, text string")
    jobs = spark.createDataFrame([("a", "high", 1), ("b", "high", 2), ("c", "low", 3), ("d", "low", 4), ("e", "low", 5), ("f", None, 6), ("g", "low", 99), ("h", "low", None), ("i", "low", 6)], "job_id string, tier string, doc_id long")
    facts = M.with_record(docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "[.!?]+\\s+")).alias("fact")).withColumn("source", F.lit("s")))
    got = I.run_jobs(jobs, docs, facts, cap=45)
    codes = {r.job_id: (r.status, r.stage, r.code, r.candidates, r.kept) for r in got.collect()}
    assert codes == {
        "a": ("success", None, None, 2, 1), "b": ("failed", "fetch", "source-too-large", 0, 0), "c": ("failed", "fetch", "missing-source", 0, 0), "d": ("failed", "extract", "no-candidates", 0, 0), "e": ("failed", "normalize", "no-facts", 0, 0),
        "f": ("failed", "read", "bad-job", 0, 0), "g": ("failed", "fetch", "missing-source", 0, 0), "h": ("failed", "read", "bad-job", 0, 0), "i": ("success", None, None, 1, 1),
    }
    again = I.run_jobs(jobs, docs, facts, done=got)  # a larger cap now
    assert {r.job_id: r.status for r in again.collect()} == {j: "success" if j == "b" else "failed" for j in "bcdefgh"}
    report = {(r.tier, r.status, r.code): (r.jobs, r.kept) for r in I.run_report(got).collect()}
    assert report["high", "success", None] == (1, 1) and report["low", "failed", "missing-source"] == (2, 0) and sum(n for n, _ in report.values()) == 9
    assert I.run_report(I.run_jobs(jobs.limit(0), docs, facts)).collect() == []
