import random
import re

from corpus_fixture import alnum, collect, prose
from pyspark.sql import functions as F

from trialspark.llm import licenses, secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def secret_rows():
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHabcdefghijkl0123456789+/") for _ in range(40))
    parts = ["PassWord = 'abc123'", "token:x", "secret=token:abcdefgh", "AKIA" + "Z9" * 8, "AKIASHORT", "AKIA" + "A" * 40,
             "0123456789abcdef01234567", "0123456789abcdef0123456", "ſecret=abcdefgh", "toKen=abcdefgh", "api_key:  \"a.b-c_d=e\"",
             "😀 passwd=longenough", "password=", "password=short password=longer1", f"auth header {key} end",
             "authorization is a word that is followed_by_a_plain_identifier", "f" * 30]
    rows = [(i, prose(rng, "en", 8) + " " + " ".join(rng.sample(parts, 4)) + " " + prose(rng, "fr", 5)) for i in range(80)]
    return rows + [(100, f"bearer {key}"), (101, key), (102, None), (103, ""), (None, "token=abcdefg"), (104, "x" * 300_000), (105, "token " * 3000)]


def test_base_spans_match_plain_patterns(spark):
    rows = secret_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)
    out = collect(secrets.secret_spans(df).select("doc_id", secrets.digest("spans", secrets.KINDS[:3]).alias("b"),
                                                  secrets.digest("spans").alias("all"), "spans"))
    want = {d: ",".join(base(t)) for d, t in rows}
    assert {r["doc_id"]: r["b"] for r in out} == want and len(out) == len(rows)
    for r in out:
        assert [s for s in r["all"].split(",") if not s.startswith("novel")] == [s for s in r["b"].split(",") if s or r["all"] == ""]
        at = [(s["start"], secrets.KINDS.index(s["kind"])) for s in r["spans"]]
        assert at == sorted(at)


def test_novelty_finds_random_keys_in_sensitive_places_only(spark):
    rows = secret_rows()
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in collect(
        secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert out[100] == ["novel"] and out[101] == [] and out[104] == [] and out[105] == []
    plain = "the authorization of internationalization_and_localization is a secret internationalization_and_localization"
    got = collect(secrets.secret_spans(spark.createDataFrame([(1, plain)], "doc_id long, text string")))
    assert got[0]["spans"] == []
    assert collect(secrets.secret_spans(spark.createDataFrame([], "doc_id long, text string"))) == []


def license_base(text):
    w, out = alnum(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), out


def test_license_phrases_match_plain_search(spark):
    rng = random.Random(6)
    parts = ["MIT License", "mit-license", "Apache\nLicense", "GNU General Public License", "general public", "license mit license mit license",
             "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "All rights reserved.",
             "Licensed under CC BY-NC 4.0."]
    rows = [(i, " ".join([prose(rng, "en", 4), *rng.sample(parts, 3), prose(rng, "de", 30), rng.choice(parts)])) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the mit license"), (102, "mit license " * 4000), (7, "mit license"), (7, "mit license")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    out = collect(licenses.scan_licenses(df))
    want = sorted((str(d), *((lambda n, f: (n, len(f), min((i for i, _ in f), default=None), max((i for i, _ in f), default=None),
                                            ",".join(sorted({x for _, x in f}))))(*license_base(t)))) for d, t in rows)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out)
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in out:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert collect(licenses.scan_licenses(df.limit(0))) == []


def test_variants_of_a_license_keep_apart(spark):
    gpl = "licensed under the GNU General Public License, version {}"
    want = {t: {label} for label, t in licenses.TEMPLATES}
    want |= {
        "Licensed under CC BY-SA 4.0": set(), "Licensed under CC BY-ND 4.0": set(), "Licensed under CC BY-NC-SA 4.0": set(),
        "Licensed under CC BY-NC 3.0": set(), "Licensed under the Apache License, Version 2.1": set(), gpl.format(4): set(),
        "subject to the terms of the Mozilla Public License, v. 2.1": set(),
        "subject to the terms of the Mozilla Public License, version 2.0": {"mpl-2.0"},
        "licensed under the GNU Lesser General Public License, version 3": {"lgpl"},
        "licensed under the GNU Affero General Public License, version 3": {"agpl"},
        "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0": {"cc-by-4.0", "cc-by-nc-4.0"},
        gpl.format(2) + "; x y z w v u t s r; " + gpl.format(3): {"gpl-2.0", "gpl-3.0"},
    }
    rows = [(i, f"some words {t} and more") for i, t in enumerate(want)]
    phrases = {label for label, _ in licenses.PHRASES}
    got = {r["doc_id"]: set(r["labels"].split(",")) - phrases - {""}
           for r in collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_long_templates_tolerate_small_changes(spark):
    grant = licenses.TEMPLATES[0][1]
    rows = [(1, "x y " + grant), (2, grant.replace("free of charge", "without charge")),
            (3, grant.replace("hereby", "hereby now")), (4, " ".join(grant.split()[:6])), (5, prose(random.Random(1), "en", 50))]
    got = {r["doc_id"]: r["labels"] for r in collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1] == got[2] == got[3] == "mit-grant" and got[4] == got[5] == ""
    assert F is not None


def test_ids_of_any_type_pass_through(spark):
    rows = [("a", "password = hunter22"), ("b-1", None), (None, "token: abcdefgh")]
    for kind in ("string", "int", "decimal(20,0)"):
        ids = spark.createDataFrame(rows, "doc_id string, text string")
        if kind != "string":
            ids = ids.withColumn("doc_id", F.length("doc_id").cast(kind))
        out = secrets.secret_spans(ids)
        assert out.schema["doc_id"].dataType.simpleString() == kind
        got = collect(out.withColumn("doc_id", F.col("doc_id").cast("string")))
        want = {"a", "b-1", None} if kind == "string" else {"1", "3", None}
        assert {r["doc_id"] for r in got} == want and sum(len(r["spans"]) for r in got) == 2
