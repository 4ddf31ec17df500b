"""Secret scan: candidates by one pattern, false positives removed by a random forest; DataFrame operations only."""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of 16 or more characters of keys and tokens, with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-.]*+[0-9])[A-Za-z0-9+/_=\-.]{16,}+"
BEFORE, AFTER = 48, 24
#: Pieces of text and finds that hold the BEFORE and AFTER characters around a find in any case.
PIECES = 13
#: Labelled findings that a forest is fitted on, and pairs of characters of which it knows how common they are, at most.
MAX_FINDINGS, MAX_BIGRAMS = 20_000, 2_000
TREES, DEPTH, SEED = 15, 5, 42

# Words that stand next to secrets, and next to what only looks like one.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "signature"]
OTHER_WORDS = ["sha", "commit", "checksum", "md5", "digest", "hash", "uuid", "guid", "example", "sample", "test", "dummy", "version", "build", "file", "path", "image", "page", "href", "src", "id"]
# Words that are found in names and paths.
DICTIONARY = ["about", "account", "admin", "application", "article", "assets", "back", "blog", "build", "category", "client", "common", "config", "content", "data", "default", "document", "download", "email", "error", "example", "feature", "file", "first", "form", "function", "group", "home", "image", "index", "info", "item", "learning", "library", "list", "local", "machine", "mail", "main", "message", "method", "model", "module", "name", "network", "number", "object", "order", "package", "page", "path", "photo", "post", "product", "profile", "project", "public", "query", "release", "report", "request", "resource", "response", "result", "search", "section", "server", "service", "session", "setting", "source", "static", "status", "string", "style", "system", "table", "template", "test", "text", "theme", "title", "type", "update", "upload", "user", "value", "version", "video", "view", "world"]
# What stands in the place of a secret without being one.
PLACEHOLDERS = ["required", "optional", "string", "null", "none", "true", "false", "undefined", "changeme", "yourtoken", "your-password", "<your-key>", "${PASSWORD}", "$TOKEN", "********", "xxxxxxxx", "invalid", "expired", "missing", "hidden", "enabled", "encrypted"]
# Ordinary words of prose in English, German, French and Spanish, which stand where secrets do without being one.
PROSE = ["authentication", "authorization", "information", "international", "management", "organization", "responsibility", "temporarily", "understanding", "unfortunately", "administrator", "certificate", "encryption", "permission", "protection", "reference", "subscription", "verification", "anmeldung", "anwendung", "bedeutung", "benutzer", "beschreibung", "bundesregierung", "datenschutzerklärung", "einstellung", "entwicklung", "gesellschaft", "geheimnis", "geschwindigkeit", "kennwort", "krankenversicherung", "möglichkeiten", "verantwortung", "verfassungsgericht", "verschlüsselung", "veröffentlichung", "wissenschaft", "zugangsdaten", "zusammenarbeit", "administration", "bibliothèque", "chiffrement", "connaissance", "développement", "environnement", "établissement", "gouvernement", "identifiant", "informatique", "utilisateur", "nécessaire", "particulièrement", "renseignements", "responsable", "signature", "confidentiel", "vérification", "administrador", "autenticación", "autorización", "biblioteca", "conocimiento", "contraseña", "desarrollo", "descripción", "documentación", "electrónico", "especialmente", "identificación", "investigación", "medioambiente", "presentación", "responsabilidad", "seguridad", "usuario"]
# Expressions of programs that fetch a secret from elsewhere.
CODE = ["os.environ", "os.environ.get", "os.getenv", "process.env.API_TOKEN", "process.env.SECRET_KEY", "getpass.getpass", "config.get", "config.secret", "settings.SECRET_KEY", "self.password", "self._token", "this.authToken", "request.headers", "request.form.password", "user.password", "session.token", "secrets.token_hex", "args.password", "options.auth.token", "env.ACCESS_KEY", "System.getenv", "input", "get_password", "readPassword", "generate_token", "hashlib.sha256"]
# Shapes of the tokens of known services, and the names of schemes with a password in their addresses.
KNOWN = [r"gh[pousr]_[A-Za-z0-9]{16,}", r"github_pat_[A-Za-z0-9_]{20,}", r"glpat-[A-Za-z0-9_\-]{16,}", r"(?:AKIA|ASIA)[A-Z0-9]{12,}", r"AIza[A-Za-z0-9_\-]{30,}", r"xox[abeoprs]-[A-Za-z0-9\-]{10,}", r"[psr]k_(?:live|test)_[A-Za-z0-9]{12,}", r"npm_[A-Za-z0-9]{30,}", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", r"eyJ[A-Za-z0-9_\-]{6,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]*"]
SCHEMES = ["postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "amqp", "https", "http", "ftp", "sftp", "smtp"]
KEY_KINDS = ["", "rsa ", "ec ", "dsa ", "openssh ", "encrypted "]
FEATURES = ["f_known", "f_password", "f_address", "f_key_block", "f_code", "f_joined", "f_length", "f_digits", "f_upper", "f_symbols", "f_entropy", "f_classes", "f_changes", "f_bigrams", "f_words", "f_path", "f_extension", "f_secret_word", "f_other_word", "f_assigned", "f_quoted"]

# A secret word, alone or as the first part of a key name, and what may stand between it and its value.
_WORD = "(?=[A-Ca-cPpSsTt])(?i:" + "|".join(map(re.escape, SECRET_WORDS)) + ")"
_NAMED = _WORD + r"(?:[_\-][A-Za-z0-9]{1,12})?(?:[_\-][A-Za-z0-9]{1,12})?"
_ASSIGNED = _NAMED + r"[\"'\])]?\s{0,4}[=:]{1,2}>?\s{0,4}"
_QUOTED = _NAMED + r"[\"'\])]?\s{0,4}(?:[=:]{1,2}>?|[,\s])\s{0,4}"
_VALUE = r"[^\s\"'`&;,<>(){}\[\]=]"
# The lines before the body of a private key, and what stands before the password of an address.
_KEY = r"-{5}BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-{5}\s{0,4}(?:[A-Z][A-Za-z\-]{1,30}: [^\r\n]{0,200}\r?\n\s{0,4}){0,4}"
_ADDRESS = r"://[^\s:/@\"'<>]{0,64}:"
#: The name and the marks before a value, as SCANNED takes them along.
PREFIX = rf"^(?:{_KEY}|{_ADDRESS}|{_ASSIGNED}[\"']?|{_QUOTED}[\"'])"
#: What scan_secrets looks at: bodies of private keys whole, passwords of addresses; after a secret word, whole quoted values (with blanks, if short and without a long run)
#: and assigned ones of any length; elsewhere every run of 16 or more characters of keys and tokens, '=' only as
#: padding at its end, so that the name in name=value is not part of the value.  A run that is such a name itself is
#: left to the alternatives before.
_BETWEEN = r"[\"'\])]?\s{0,4}(?:[=:]{1,2}>?|[,\s])\s{0,4}"
_WITHIN = "|".join(rf"{q}(?:[^\s{q}]++|(?![^{q}\r\n]{{0,80}}[A-Za-z0-9+/_\-.]{{16}})[^{q}\r\n]{{1,80}}+)(?={q})" for q in "\"'")
SCANNED = "|".join([
    rf"{_KEY}[A-Za-z0-9+/](?:[A-Za-z0-9+/=]|\s|\\n){{15,}}+",
    rf"{_ADDRESS}[^\s/@\"'<>]{{1,256}}+(?=@)",
    rf"{_NAMED}(?:{_BETWEEN}(?:{_WITHIN})|[\"'\])]?\s{{0,4}}[=:]{{1,2}}>?\s{{0,4}}[\"']?{_VALUE}++(?:={{1,2}}(?!=|{_VALUE}))?)",
    rf"(?<![A-Za-z0-9+/_\-])(?=[+/_\-.]*+[A-Za-z0-9])[A-Za-z0-9+/_\-.]{{16,}}+(?![\"'\])]?\s{{0,4}}[=:](?<={_NAMED}[\"'\])]?\s{{0,4}}[=:]){_VALUE}?)(?:={{1,2}}(?![A-Za-z0-9+/_=\-.]))?",
])
#: Finds over whose lengths one step of a running sum goes; it keeps the work for n finds of a text near n.
_STEP = 256


def with_candidates(docs: DataFrame, pattern: str = CANDIDATE, prefix: str | None = None) -> DataFrame:
    """doc_id, start, end, candidate, before, after of every match of the pattern; offsets in code points.

    Where a match begins with the prefix, the candidate is what follows it.  A null text has no match.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", text.alias("_text")).where(F.col("_text").rlike(pattern))
    cut = cut.select("doc_id", F.split("_text", pattern).alias("_gaps"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("_found"))
    # where the pattern cuts a text, its pieces and finds alternate: lengths of what stands before give the place
    cut = cut.withColumn("_sizes", F.expr("zip_with(slice(_gaps, 1, size(_found)), _found, (g, f) -> char_length(g) + char_length(f))"))
    cut = cut.withColumn("_sums", F.expr(f"transform(sequence(0, (size(_sizes) - 1) div {_STEP}), b -> aggregate(slice(_sizes, b * {_STEP} + 1, {_STEP}), 0, (n, x) -> n + x))"))
    cut = cut.withColumn("_sums", F.expr("transform(sequence(0, size(_sums) - 1), b -> aggregate(slice(_sums, 1, b), 0, (n, x) -> n + x))"))
    rows = cut.select("*", F.posexplode("_found").alias("_i", "_match"))
    value = F.regexp_replace("_match", prefix, "") if prefix else F.col("_match")
    rows = rows.withColumn("candidate", F.when(value == "", F.col("_match")).otherwise(value)).withColumn("_name", F.expr("left(_match, char_length(_match) - char_length(candidate))"))
    at = F.expr(f"_sums[_i div {_STEP}] + aggregate(slice(_sizes, _i div {_STEP} * {_STEP} + 1, _i % {_STEP}), 0, (n, x) -> n + x) + char_length(_gaps[_i]) + char_length(_name)")
    # other finds may stand in what is before and after
    before = F.expr(f"concat(array_join(transform(sequence(greatest(0, _i - {PIECES}), _i), k -> concat(if(k > 0, right(_found[greatest(k - 1, 0)], {BEFORE}), ''), right(_gaps[k], {BEFORE}))), ''), _name)")
    after = F.expr(f"array_join(transform(sequence(_i + 1, least(size(_found), _i + {PIECES})), k -> concat(left(_gaps[k], {AFTER}), if(k < size(_found), left(_found[least(k, size(_found) - 1)], {AFTER}), ''))), '')")
    rows = rows.select("doc_id", at.alias("start"), "candidate", F.lower(F.right(before, F.lit(BEFORE))).alias("before"), F.lower(F.left(after, F.lit(AFTER))).alias("after"))
    return rows.withColumn("end", F.col("start") + F.char_length("candidate"))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.greatest(F.char_length("candidate"), F.lit(1))


def with_features(found: DataFrame, bigrams: dict[str, float]) -> DataFrame:
    """Columns of FEATURES from candidate, before and after; nulls count as empty."""
    found = found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("candidate", "before", "after")})
    bigrams = bigrams or {"": -6.0}  # a map of no entries cannot be parsed back from JSON as one
    c, n = F.col("candidate"), F.greatest(F.char_length("candidate"), F.lit(1))
    low = F.lower(c)
    table = F.from_json(F.lit(json.dumps(bigrams)), "map<string,double>")
    floor = min(bigrams.values(), default=-6.0)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 1, F.lit(1))), lambda i: F.coalesce(table[F.substring(low, i, 2)], F.lit(floor)))
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: (n - F.char_length(F.replace(c, x, F.lit("")))) / n)
    any_of = lambda words: "(?<![a-z])(" + "|".join(map(re.escape, words)) + ")(?![a-z])"
    before, after = F.col("before"), F.col("after")
    return found.withColumns({
        "f_known": c.rlike("^(?:" + "|".join(KNOWN) + ")$").cast("double"),
        "f_password": before.rlike(r"(?:password|passwd|pwd|passphrase)[\"'\])]?\s{0,4}[=:]{1,2}>?\s{0,4}[\"']?$").cast("double"),
        "f_address": (before.rlike(_ADDRESS + "$") & F.startswith(after, F.lit("@"))).cast("double"),
        "f_key_block": (before.rlike(r"private key-{5}\s*$") | (before.rlike(r"dek-info: ") & c.rlike(r"^[A-Za-z0-9+/]{60}"))).cast("double"),
        "f_code": (c.rlike(r"^[A-Za-z_]+[0-9]{0,3}(?:\.[A-Za-z_]+[0-9]{0,3})+$") | after.rlike(r"^\s?[(\[]")).cast("double"),
        "f_joined": c.rlike(r"^[A-Za-z]{2,}(?:[-_ ][A-Za-z]{2,}){2,}$").cast("double"),
        "f_length": F.least(n, F.lit(200)).cast("double"), "f_digits": _share("[0-9]"), "f_upper": _share("[A-Z]"), "f_symbols": _share("[^A-Za-z0-9]"),
        "f_entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "f_classes": sum((c.rlike(p).cast("double") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "f_changes": F.regexp_count(c, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]")) / n,
        "f_bigrams": F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs),
        "f_words": F.least(sum((F.when(F.contains(low, F.lit(w)), F.lit(float(len(w)))).otherwise(0.0) for w in DICTIONARY), F.lit(0.0)) / n, F.lit(1.0)),
        "f_path": (F.contains(c, F.lit("/")) | F.col("before").rlike(r"[/\\]$")).cast("double"),
        "f_extension": low.rlike(r"\.[a-z]{2,4}[0-9]?$").cast("double"),
        "f_secret_word": F.col("before").rlike("(" + "|".join(map(re.escape, SECRET_WORDS)) + r")(?:[_\-][a-z0-9]{1,12}){0,2}[^a-z]{0,8}$").cast("double"),
        "f_other_word": F.col("before").rlike(any_of(OTHER_WORDS) + "[^a-z]{0,8}$").cast("double"),
        "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"), "f_quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double"),
    })


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Findings with labels, made by rule, for use where none are at hand: candidate, before, after, label.

    Secrets are random hex, base-64, mixed or letter strings, short passwords and pass phrases in places where secrets
    stand; tokens in the shapes of known services in any place; bodies of private keys under their heading; and
    passwords of addresses.  The others are checksums and identifiers in places of their own, names, paths, versions,
    dates, repeated marks and long words, and words of prose, placeholders and expressions of programs where secrets
    stand, tokens blotted out and ports of addresses.
    """
    i = F.col("id")
    text = i.cast("string")
    hexes, other = F.sha1(text.cast("binary")), F.md5(F.concat(F.lit("m"), text).cast("binary"))
    coded = lambda salt: F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256))), "+/=", "A9z")
    b64 = F.translate(F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), text).cast("binary"), 256))), 1, 40), "+/=", "A_9")
    number = lambda salt, k: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(k))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (number(salt, len(words)) + 1).cast("int"))
    choose = lambda columns, salt: F.element_at(F.array(*columns), (number(salt, len(columns)) + 1).cast("int"))
    word = lambda salt: pick(DICTIONARY, salt)
    letters = F.translate(b64, "0123456789_", "qxzjkvwyhgf")
    short = [
        F.concat(word(11), F.pmod(i, F.lit(97)).cast("string"), pick(["!", "#", "?", "$", "", "@"], 12)), F.concat(F.lower(F.substring(letters, 1, 6)), F.pmod(i, F.lit(10)).cast("string"), pick(["!", "#", "?", "$"], 12)),
        F.substring(b64, 1, 10), F.substring(letters, 3, 9), F.concat(F.initcap(word(13)), F.initcap(word(14)), F.pmod(i, F.lit(1000)).cast("string")),
    ]
    secrets = [hexes, F.upper(hexes), b64, F.concat(F.lit("k1_"), b64), other, F.concat(F.substring(b64, 1, 12), F.substring(hexes, 1, 12)), letters, F.upper(F.substring(letters, 1, 24)), *short]
    phrases = [F.concat_ws("-", word(21), word(22), word(23)), F.concat_ws("-", word(21), pick(PROSE, 22), word(23), word(24)), F.concat_ws("_", word(21), word(22), pick(PROSE, 23)), F.concat_ws(" ", word(21), word(22), word(23), word(24)), F.lower(F.concat_ws("-", F.substring(letters, 1, 7), F.substring(letters, 9, 5), F.substring(letters, 15, 7)))]
    numbers = F.lpad(F.abs(F.xxhash64(i, F.lit(31))).cast("string"), 12, "1")
    known = [
        F.concat(pick(["ghp_", "gho_", "ghs_", "ghu_"], 32), F.substring(coded("g"), 1, 36)), F.concat(F.lit("github_pat_"), F.substring(coded("g"), 1, 22), F.lit("_"), coded("h")), F.concat(F.lit("glpat-"), F.substring(coded("g"), 1, 20)),
        F.concat(pick(["AKIA", "ASIA"], 32), F.upper(F.substring(coded("g"), 1, 16))), F.concat(F.lit("AIza"), F.substring(coded("g"), 1, 35)), F.concat(pick(["xoxb-", "xoxp-", "xapp-", "xoxa-"], 32), F.substring(numbers, 1, 12), F.lit("-"), F.substring(coded("g"), 1, 24)),
        F.concat(pick(["sk_live_", "rk_live_", "sk_test_"], 32), F.substring(coded("g"), 1, 24)), F.concat(F.lit("npm_"), F.substring(coded("g"), 1, 36)), F.concat(F.lit("SG."), F.substring(coded("g"), 1, 22), F.lit("."), F.substring(coded("h"), 1, 43)),
        F.concat(F.lit("eyJ"), F.substring(coded("g"), 1, 17), F.lit(".eyJ"), F.substring(coded("h"), 1, 30), F.lit("."), F.substring(coded("k"), 1, 43)),
    ]
    block = F.concat_ws("\n", *[F.concat(coded(f"p{k}"), F.substring(coded(f"q{k}"), 1, 20)) for k in range(3)])
    marks = pick([' = "', ": ", "=", " = '", '": "'], 3)
    place = F.concat(F.lit("some text "), pick(SECRET_WORDS, 2), F.when(number(33, 4) == 0, " ").otherwise(marks))
    anywhere = F.concat(F.lit("some text "), pick([*OTHER_WORDS, "see", "of", "the", "und", "le", "with", "use"], 8), pick([" ", ": ", "=", ' "', "\n", ", ", "("], 9))
    phrase_place = F.concat(F.lit("some text "), pick(["password", "passwd", "pwd", "db_password"], 34), marks)
    address = F.concat(F.lit("see "), pick(SCHEMES, 35), F.lit("://"), F.when(number(36, 5) == 0, "").otherwise(word(37)), F.lit(":"))
    names = [
        F.concat_ws("/", word(4), word(5), text, word(6)), F.concat_ws("-", word(4), word(5), word(6), F.pmod(i, F.lit(100)).cast("string")), F.concat(word(4), F.lit("_"), word(5), text, F.lit(".png")),
        F.concat(F.lit("2024-01-"), F.lpad((F.pmod(i, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T00.00.00")), F.concat(F.lit("1.2."), text, F.lit(".20240101-beta")), F.repeat(F.pmod(i, F.lit(10)).cast("string"), 24),
        hexes, other, F.concat(F.lit("www."), word(4), word(5), F.pmod(i, F.lit(10)).cast("string"), F.lit(".example.com")), F.concat(F.repeat(F.lit("x"), 20), F.lit("1")),
        F.concat(word(4), word(5), word(6)), F.upper(F.concat_ws("_", word(4), word(5), word(6))), F.concat_ws("/", word(4), word(5), word(6)), F.concat(F.repeat(F.lit("-"), 20), word(4)), F.concat_ws("-", pick(PROSE, 4), pick(PROSE, 5)), F.concat_ws(".", word(4), word(5), pick(CODE, 6)),
    ]
    blotted = F.concat(pick(["ghp_", "AKIA", "sk_live_", "xoxb-", "glpat-", ""], 32), F.repeat(pick(["x", "X", "*", "0", "."], 38), 24))
    prose = choose([word(4), pick(PROSE, 4), F.initcap(pick(PROSE, 4)), F.concat(pick(PROSE, 4), pick(PROSE, 5)), F.initcap(F.concat(pick(PROSE, 4), pick(PROSE, 5))), pick(PLACEHOLDERS, 5)], 39)
    closing, plain = pick(['" and', "' and", "\nnext", " and", ""], 40), pick([" and", ".", "", "\nnext", ", "], 41)
    called = pick(["(", "()", '["KEY"]', '("KEY")', " ", ""], 42)
    any_place = F.when(number(43, 3) == 0, place).otherwise(anywhere)
    kinds = [  # parts of all findings, candidate, before, after, label
        (5, choose(secrets, 1), place, closing, 1), (3, choose(phrases, 20), phrase_place, closing, 1), (2, choose(known, 30), any_place, plain, 1),
        (1, block, F.concat(F.lit("-----begin "), pick(KEY_KINDS, 44), F.lit("private key-----\n")), F.lit("\n-----end "), 1), (1, choose([*short, b64], 45), address, F.lit("@host"), 1),
        (5, choose(names, 7), anywhere, plain, 0), (3, prose, place, closing, 0), (1, pick(CODE, 46), place, called, 0), (1, blotted, any_place, closing, 0),
        (1, choose([pick(PLACEHOLDERS, 5), F.concat(F.lit("$"), F.upper(word(47))), F.lit("xxxx"), F.lit("****")], 48), address, F.lit("@host"), 0),
    ]
    parts, at, made = sum(k[0] for k in kinds), 0, None
    for part, candidate, before, after, label in kinds:
        rows = spark.range(at * n // parts, (at + part) * n // parts, 1, 1).select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), F.lit(label).alias("label"))
        made, at = rows if made is None else made.unionByName(rows), at + part
    return made


def fit_bigrams(found: DataFrame) -> dict[str, float]:
    """Log-probabilities of the second character after the first in lower case, from harmless findings."""
    low = F.lower(F.col("candidate"))
    pairs = found.where("label = 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, 2))).alias("p"))
    rows = pairs.where(F.char_length("p") == 2).groupBy("p").count().orderBy(F.col("count").desc(), "p").limit(MAX_BIGRAMS).collect()
    first: dict[str, int] = {}
    for r in rows:
        first[r.p[0]] = first.get(r.p[0], 0) + r["count"]
    return {r.p: round(math.log(r["count"] / (first[r.p[0]] + 20)), 6) for r in rows}


def fit_secrets(findings: DataFrame) -> dict:
    """A random forest on at most MAX_FINDINGS labelled findings (candidate, before, after, label), as nested conditions.

    Findings with a null candidate or another label than 0 or 1 are no labels; null places count as empty; without
    any finding there are no trees, and every candidate scores 0; with one label alone all score that.
    """
    findings = findings.where("label IN (0, 1) AND candidate IS NOT NULL").select("candidate", "before", "after", "label").orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "after", "label").limit(MAX_FINDINGS)
    labels = [r.label for r in findings.select("label").distinct().collect()]
    if len(labels) < 2:
        return {"bigrams": {}, "trees": [("leaf", float(x)) for x in labels]}
    bigrams = fit_bigrams(findings)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(with_features(findings, bigrams)).select("x", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    return {"bigrams": bigrams, "trees": read_trees(forest.toDebugString)}


def read_trees(text: str) -> list:
    """Trees as ("leaf", class) or ("node", feature, threshold, left, right) from the forest's own description."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    trees, at = [], 0

    def node() -> tuple:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return ("leaf", float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # the Else line
        return ("node", int(m[1]), float(m[2]), left, node())

    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            trees.append(node())
        else:
            at += 1
    return trees


def forest_score(trees: list) -> Column:
    """The share of trees that hold a finding to be a secret."""

    def of(t: tuple) -> Column:
        if t[0] == "leaf":
            return F.lit(t[1])
        return F.when(F.col(FEATURES[t[1]]) <= t[2], of(t[3])).otherwise(of(t[4]))

    return sum((of(t) for t in trees), F.lit(0.0)) / max(1, len(trees))


def scan_secrets(docs: DataFrame, model: dict) -> DataFrame:
    """Every candidate of every document with its score.

    Returns doc_id, start, end, candidate, before, after, score, is_secret (score >= 0.5).  Null and empty texts
    have no candidates; repeated rows give repeated findings; an empty table gives an empty result; other
    columns are not read; long texts are searched whole.
    """
    found = with_features(with_candidates(docs, SCANNED, PREFIX), model["bigrams"])
    return found.select("doc_id", "start", "end", "candidate", "before", "after", forest_score(model["trees"]).alias("score")).withColumn("is_secret", F.col("score") >= 0.5)
