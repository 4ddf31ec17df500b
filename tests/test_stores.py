"""Job lists, stores, manifests, packages, logs and state on files made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import stores as R
from factloom.sources import tables as S


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_inputs_and_jobs(spark, tmp_path):
    assert R.one_input(None, "a", None) == "in"
    for wrong in ((None, None, None), ("u", "a", None)):
        with pytest.raises(ValueError):
            R.one_input(*wrong)
    assert [r.text for r in R.read_whole(spark, put(tmp_path / "t/a.txt", "one\ntwo")).collect()] == ["one\ntwo"]
    jobs, faults = R.read_jobs(spark, put(tmp_path / "jobs.json", [{"game": "A", "url": "u"}, {"game": " ", "in": "f"}, {"game": "B"}, {"game": "C", "url": "u", "in": "f"}, {"game": "D", "in": "f", "tier": "A"}]))
    assert [r.game for r in jobs.orderBy("place").collect()] == ["A", "D"] and sorted(r.fault for r in faults.collect()) == ["game-missing", "input-missing", "two-inputs"]


def test_fallback_stores(spark, tmp_path):
    put(tmp_path / "user/ring/facts.json", [{"id": "1", "text": "own"}])
    put(tmp_path / "shipped/ring/facts.json", [{"id": "2", "text": "shipped"}])
    put(tmp_path / "shipped/wall/facts.json", [{"id": "3", "text": "wall"}])
    put(tmp_path / "shipped/_default/facts.json", [{"id": "0", "text": "default"}])
    folders = [str(tmp_path / "user"), str(tmp_path / "shipped")]
    read = lambda name: [r.text for r in R.read_first(spark, folders, name, R.STORED_FACT).collect()]
    assert (read("ring"), read("wall"), read("none")) == (["own"], ["wall"], ["default"])
    assert R.read_first(spark, [str(tmp_path / "empty")], "x", R.STORED_FACT).collect() == []


def test_keyed_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = lambda *rows: spark.createDataFrame(rows, "game string, id string")
    assert R.read_keyed(spark, path, "game", "a", "game string, id string").collect() == []
    R.write_keyed(df(("a", "1"), ("b", "2")), path)
    R.write_keyed(df(("a", "3")), path)
    assert [r.id for r in R.read_keyed(spark, path, "game", "a", "").collect()] == ["3"] and [r.id for r in R.read_keyed(spark, path, "game", "b", "").collect()] == ["2"]
    stored = spark.createDataFrame([("1", "old", "official"), (None, "no id", None)], "id string, text string, sourceType string")
    added = spark.createDataFrame([("1", "again", "user"), ("2", "new", " Community "), ("3", "odd", "nobody")], stored.schema)
    got = {r.text: r.reliability for r in R.add_facts(stored, added).collect()}
    assert got == {"old": 3, "no id": 0, "new": 1, "odd": 0}


def test_manifests(spark, tmp_path):
    put(tmp_path / "steam/a.acf", '"AppState" {\n "appid" "12"\n "name" "Great Walls"\n "installdir" "C:\\\\g\\\\walls"\n}')
    put(tmp_path / "epic/x.item", {"AppName": " ", "CatalogItemId": "c1", "DisplayName": "Ring", "InstallLocation": "C:/g/ring/"})
    put(tmp_path / "epic/y.item", {"DisplayName": "No folder"})
    local = put(tmp_path / "local.json", [{"installPath": "C:\\g\\ring\\mods", "title": "Mods", "appId": "m"}, {"title": "no path"}, {"installPath": "C:\\G\\Ring", "title": "My ring"}])
    all_ = R.read_all_manifests(spark, local, str(tmp_path / "steam"), str(tmp_path / "epic"))
    assert sorted((r.src_rank, r.source, r.title) for r in all_.collect()) == [(0, "local", "Mods"), (0, "local", "My ring"), (1, "steam", "Great Walls"), (2, "epic", "Ring")]
    assert R.read_all_manifests(spark, None, None, None).collect() == []
    rows = spark.createDataFrame([(1, "c:\\g\\RING\\mods\\a.exe"), (2, "C:\\g\\ring\\ring.exe"), (3, "C:\\g\\ringing\\a.exe"), (4, None)], "id int, path string")
    assert {r.id: r.title for r in R.folder_owner(rows, "path", all_).collect()} == {1: "Mods", 2: "My ring", 3: None, 4: None}
    lists = spark.createDataFrame([('"path" "D:\\\\a"\n"1" "E:\\\\b"',), ('"1" "E:\\\\b"\n"2" "F:\\\\c"',), ("",)], "t string")
    assert [r.f for r in lists.select(R.library_folders("t").alias("f")).collect()] == [["D:\\a"], ["E:\\b", "F:\\c"], []]


def test_pages_files_and_packages(spark, tmp_path):
    put(tmp_path / "game/walls.json", {"facts": [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]})
    put(tmp_path / "game/neighborhood-1.json", {"facts": [{"id": "n"}]})
    put(tmp_path / "game/package.json", {"facts": [{"id": "p"}]})
    put(tmp_path / "game/empty.json", {"facts": []})
    assert sorted((r.page, r["index"], r.id) for r in R.read_fact_pages(spark, str(tmp_path / "game")).collect()) == [("walls", 0, "a"), ("walls", 1, "b")]
    put(tmp_path / "tree/a/b.txt", "1")
    put(tmp_path / "tree/node_modules/c.txt", "2")
    assert [r.path.rsplit("/", 1)[1] for r in R.list_files(spark, str(tmp_path / "tree")).collect()] == ["b.txt"]
    facts = spark.createDataFrame([("1", "a", "A"), ("2", "b", "B")], "id string, text string, layer string")
    assert sorted(r.value for r in R.write_result(facts, str(tmp_path / "dry"), dry_run=True).collect()) == ['{"id":"1","text":"a","layer":"A"}', '{"id":"2","text":"b","layer":"B"}'] and not (tmp_path / "dry").exists()
    R.write_result(facts, str(tmp_path / "out"), {"game": "g"})
    assert spark.read.json(str(tmp_path / "out/facts")).count() == 2 and spark.read.json(str(tmp_path / "out/meta")).first().game == "g"
    R.write_package({"facts": facts, "report": facts.groupBy().count()}, str(tmp_path / "pack"), by="layer")
    assert spark.read.json(str(tmp_path / "pack/facts")).where("layer = 'A'").count() == 1 and spark.read.json(str(tmp_path / "pack/report")).first()["count"] == 2
    decisions = spark.createDataFrame([("1", "rejected", 1), ("1", "approved", 2), ("9", "approved", 1)], "id string, decision string, at int")
    R.write_by_decision(facts, decisions, str(tmp_path / "review"))
    assert {r.id: r.decision for r in spark.read.json(str(tmp_path / "review")).collect()} == {"1": "approved", "2": "pending"}
    for _ in range(2):
        R.append_lines(facts, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    S.write_partitioned(facts, str(tmp_path / "parts"), "layer")
    assert spark.read.json(str(tmp_path / "parts")).count() == 2


def test_state_policy_and_sharing(spark, tmp_path):
    path = str(tmp_path / "state")
    assert R.load_state(spark, path, "s") == {}
    R.save_state(spark, path, "s", {"n": 1})
    R.save_state(spark, path, "s", {"n": 2})
    R.save_state(spark, path, "t", {"n": 9})
    assert R.load_state(spark, path, "s") == {"n": 2} and R.load_state(spark, path, "u") == {}
    policy = R.read_policy(spark, put(tmp_path / "p.json", {"sourcePolicy": {"blockList": [" Spam "], "allowList": []}, "dedupe": {"action": "keep"}}))
    assert policy["sourcePolicy"]["blockList"] == ["spam"] and policy["dedupe"] == {"similarity": 0.93, "minTokenOverlap": 6, "minTokens": 8, "action": "keep"}
    assert R.read_policy(spark, None) == R.read_policy(spark, put(tmp_path / "broken.json", "{")) == R.read_policy(spark, str(tmp_path / "none.json")) == R.POLICY
    assert R.merge_deep({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"b": 3, "c": []}, "e": None, "f": [4]}) == {"a": {"b": 3, "c": [1]}, "d": 2, "f": [4]}
    events = spark.createDataFrame([("x", k, k, float(k)) for k in range(30)] + [("y", 1, 5, 2.0)], "event_type string, ts long, event_id long, value double")
    got = {r.event_type: r for r in R.share_last(events).collect()}
    assert json.loads(got["x"].last) == {"event_id": 29, "value": 29.0} and [e["event_id"] for e in json.loads(got["x"].snapshots)] == list(range(29, 9, -1)) and len(json.loads(got["y"].snapshots)) == 1


def test_small_files_are_dealt(spark):
    df = S.table(spark, "/root/testdata/sf0.001", "documents")
    assert S.dealt(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and S.dealt(df).count() == df.count()
    rows = [(1, None, "en", "s"), (2, "One. Two", None, None)]
    assert spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select(F.count("text")).first()[0] == 1


def test_large_tables_in_few_files_are_dealt(spark, monkeypatch):
    df = S.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    monkeypatch.setattr(S, "SMALL_BYTES", 10_000)
    assert S.dealt(df).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and S.dealt(df).count() == df.count()
