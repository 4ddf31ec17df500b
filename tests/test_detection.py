"""Detection of applications from texts and windows, on cases made by hand."""

from factloom.operators import detection as D

# Names as the golden cases expect them, with the patterns that tell them; first match wins.
REGISTRY = [
    ("Counter-Strike 2", "Counter-Strike 2"), (r"Call of Duty:? Warzone", "Call of Duty: Warzone"), ("Dota 2", "Dota 2"), ("League of Legends", "League of Legends"), ("Elden Ring", "Elden Ring"), (r"Baldur'?s Gate (3|III)", "Baldur's Gate 3"),
    ("Minecraft", "Minecraft"), ("Terraria", "Terraria"), ("Project Zomboid", "Project Zomboid"), ("Phasmophobia", "Phasmophobia"), ("Hades", "Hades"), ("Slay the Spire", "Slay the Spire"), ("Fortnite", "Fortnite"), ("World of Warcraft", "World of Warcraft"),
    ("Hollow Knight", "Hollow Knight"), (r"\bGTA V\b|Grand Theft Auto V", "Grand Theft Auto V"), ("Assetto Corsa", "Assetto Corsa"), (r"\bFe\b", "Fe"), ("Brotato", "Brotato"), (r"\bV Rising\b", "V Rising"), ("Final Fantasy XIV", "Final Fantasy XIV"),
    ("Sekiro", "Sekiro: Shadows Die Twice"), ("Valheim", "Valheim"), ("Not For Broadcast", "Not For Broadcast"), ("Rimwor(l)?d", "RimWorld"),
]
# Thirty texts: one name each, one of several, or none.
CASES = [
    ("Not For Broadcast-ben mi a jatekos feladata?", "Not For Broadcast"), ("not for broadcast gameplay tips", "Not For Broadcast"), ("rimword colony tips", "RimWorld"), ("rimworld colony tips", "RimWorld"), ("Counter-Strike 2 spray pattern help", "Counter-Strike 2"), ("dota 2 item build", "Dota 2"),
    ("league of legends lane tips", "League of Legends"), ("elden ring bleed build", "Elden Ring"), ("baldurs gate 3 romance options", ["Baldur's Gate 3", "Baldur's Gate III"]), ("minecraft redstone farm", "Minecraft"), ("terraria early game guide", "Terraria"), ("project zomboid best traits", "Project Zomboid"),
    ("phasmophobia ghost types", "Phasmophobia"), ("hades boon tier list", "Hades"), ("slay the spire deck tips", "Slay the Spire"), ("fortnite ranked tips", "Fortnite"), ("world of warcraft mythic raid", "World of Warcraft"), ("hollow knight pantheon", "Hollow Knight"), ("gta v heist setup", ["GTA V", "Grand Theft Auto V"]),
    ("assetto corsa setup", "Assetto Corsa"), ("fe tips and walkthrough", "Fe"), ("a feladat megoldasa lepesrol lepesre", None), ("how to craft a sword in a game", None), ("political news today", None), ("brotato build", "Brotato"), ("v rising castle layouts", "V Rising"),
    ("final fantasy xiv raid", ["Final Fantasy XIV", "Final Fantasy XIV Online"]), ("call of duty: warzone loadout", "Call of Duty: Warzone"), ("sekiro parry timing", "Sekiro: Shadows Die Twice"), ("valheim base defense", "Valheim"),
]


def registry(spark, rows=REGISTRY):
    return spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(rows)], D.REGISTRY_SCHEMA)


def mappings(spark, rows=()):
    return spark.createDataFrame([(k, m, n) for k, (m, n) in enumerate(rows)], D.MAPPINGS_SCHEMA)


def test_golden_texts(spark):
    rows = [(k, t, e if isinstance(e, str) else None, e if isinstance(e, list) else None, e is None, False) for k, (t, e) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, text string, expect string, one_of array<string>, none boolean, any_ boolean")
    got = D.first_match(df, "text", registry(spark), "result").withColumn("ok", D.meets("result", "expect", "one_of", "none", "any_")).collect()
    assert len(got) == 30 and all(r.ok for r in got), [(r.text, r.result) for r in got if not r.ok]
    wrong = spark.createDataFrame([("x", None, None, True, None), (None, "a", None, None, None), ("B", "a", ["b"], None, None), (None, None, None, None, True), ("z", None, None, None, True), ("z", None, None, None, None)], "r string, e string, o array<string>, n boolean, a boolean")
    assert [r.ok for r in wrong.select(D.meets("r", "e", "o", "n", "a").alias("ok")).collect()] == [False, False, True, False, True, False]


def test_window_rules(spark):
    w = [
        # place, title, process, path, class, metadata -> name, score, reasons
        (1, "Elden Ring", "eldenring.exe", None, "UnityWndClass", None, ("Elden Ring", 6, "title+class")),
        (2, "Elden Ring guide - Google", "chrome.exe", None, "Chrome_WidgetWin_1", None, (None, 4, "title+browser-block")),
        (3, "My work note", "word.exe", None, None, None, (None, 0, "min-signal")),
        (4, "My work: note", None, None, None, None, ("Notes", 6, "mapping")),
        (5, "Hades", "x.exe", "C:\\\\g\\\\Hades.exe", "UnityWndClass", "Hades (store)", ("Hades (store)", 18, "metadata+title+process+class")),
        (6, None, None, None, None, None, (None, 0, "min-signal")),
        (7, "Something [Launcher]", None, None, "UnityWndClass", None, ("Something", 6, "title+class")),
        (8, "Visual Studio Code", "code.exe", None, "UnityWndClass", None, (None, 2, "class+min-signal")),
    ]
    df = spark.createDataFrame([r[:6] for r in w], "place int, title string, process string, path string, class string, metadata string")
    maps = mappings(spark, [("work: NOTE!", "Notes "), ("", "Never"), ("my", " ")])
    got = {r.place: (r.name, r.score, r.reasons) for r in D.score_titles(df.where("place <> 3"), registry(spark), maps, ["visual studio"], []).collect()}
    assert got == {r[0]: r[6] for r in w if r[0] != 3}
    assert D.score_titles(df.where("place = 3"), registry(spark), mappings(spark), [], []).first().reasons == "min-signal"
    assert D.score_titles(df.limit(0), registry(spark), maps).collect() == []


def test_snapshots(spark):
    rows = [
        (1, 0, True, "Hades", "hades.exe", "UnityWndClass"), (1, 1, False, "Valheim", None, None),  # the active one tells
        (2, 0, True, "Mail", "mail.exe", None), (2, 1, False, "Valheim map", None, None), (2, 2, False, "my work note", None, None),  # a mapping among the others
        (3, 0, True, "Mail", "mail.exe", None), (3, 1, False, "Valheim map", None, None),  # a title alone counts too little
        (4, 0, True, None, None, None),
    ]
    df = spark.createDataFrame([(*r[:4], r[4], None, r[5], None) for r in rows], "snapshot_id int, place int, is_active boolean, title string, process string, path string, class string, metadata string")
    maps = mappings(spark, [("work note", "Notes")])
    got = {r.snapshot_id: (r.name, r.source) for r in D.detect(df, registry(spark), maps).collect()}
    assert got == {1: ("Hades", "active"), 2: ("Notes", "fallback"), 3: (None, None), 4: (None, None)}
    assert {r.name for r in D.detect(df, registry(spark), maps, fallback=False).collect()} == {"Hades", None}
