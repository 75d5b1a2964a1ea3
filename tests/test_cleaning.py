"""Cleaning helpers (P1-P12, J1, J8, Q12) and the end-to-end log cleaning."""
from pyspark.sql import functions as F

from trialspark.operators import cleaning, pairs_screen, summary


def test_text_practice_versions(spark):
    df = spark.createDataFrame([(1, 0.0, " Axe\t", " Tools "), (2, float("nan"), "dog", "ANIMAL"),
                                (3, 2.0, "CAT ", None)], "id int, list double, item_name string, category string")
    out = cleaning.normalise_text(cleaning.drop_practice(df))
    got = {r.id: r for r in out.collect()}
    assert set(got) == {3} and got[3].item == "cat"
    axe = cleaning.normalise_text(df).where("id = 1").first()
    assert axe.item == "ax" and axe.category == "tools"
    idx = spark.createDataFrame([("a", 4.0), ("b", 3.0), ("c", None)], "subject string, system_version double")
    assert {r.subject for r in cleaning.closed_loop_filter(idx).collect()} == {"b", "c"}   # R4


def test_overrides_allow_list_right_join(spark):
    ev = spark.createDataFrame([("s", 0, "f0"), ("s", 1, "f1"), ("t", 0, "g0")], "subject string, session int, eegfile string")
    fix = spark.createDataFrame([("s", 0, "fixed")], "subject string, session int, eegfile string")
    got = {(r.subject, r.session): r.eegfile for r in cleaning.override_value(ev, fix, ["subject", "session"], "eegfile").collect()}
    assert got[("s", 0)] == "fixed" and got[("s", 1)] == "f1"
    allowed = spark.createDataFrame([("s", 1)], "subject string, session int")
    assert cleaning.keep_allow_list(ev, allowed).count() == 1
    used = spark.createDataFrame([("s", 1), ("u", 9)], "subject_encoding string, session_encoding int")
    j = cleaning.sessions_used(ev, used, ["subject", "session"], ["subject_encoding", "session_encoding"])
    assert j.count() == 2 and j.where(F.col("subject").isNull()).count() == 1


def test_repeated_list_countdowns_and_recode(spark):
    ev = spark.createDataFrame([("COUNTDOWN", None), ("WORD", 0), ("WORD", 1), ("WORD", None)], "type string, serialpos int")
    assert cleaning.repeated_list_countdowns(ev).count() == 2
    df = spark.createDataFrame([("Cingulate",), ("MTL",)], "region string")
    got = [r[0] for r in df.select(cleaning.recode("region", {"Cingulate": "CC"})).collect()]
    assert got == ["CC", "MTL"]


def test_pair_screen_boundaries(spark):
    contacts = spark.createDataFrame(
        [(1, "A1", 0.0, 0.0, 0.0), (2, "A2", 24.99, 0.0, 0.0), (3, "A3", 25.0, 0.0, 0.0), (4, "B5", 0.0, 0.0, None),
         (5, "A4", 1.0, 0.0, 0.0)], "contact int, label string, vox_x double, vox_y double, vox_z double")
    pairs = spark.createDataFrame(
        [("s", 0, 1, 2, "A1-A2", "D", "D"),      # distance 24.99 -> kept
         ("s", 0, 1, 3, "A1-A3", "S", "S"),      # distance 25.0 -> dropped (strict)
         ("s", 0, 1, 5, "A1-A4", "D", "D"),      # depth, label gap 3 -> dropped
         ("s", 0, 2, 5, "A2-A4", "S", "S"),      # not depth, gap 2 -> kept
         ("s", 0, 1, 4, "A1-B5", "D", "D"),      # contact without coordinates -> dropped
         ("s", 0, 1, 2, "A1-A2", "uD", "uD"),    # micro -> dropped
         ("s", 0, 1, 2, "X-Y-Z", "D", "D")],     # three parts -> kept as is
        "subject string, montage int, contact_1 int, contact_2 int, label string, type_1 string, type_2 string")
    out = pairs_screen.screen_pairs(pairs, contacts, [], min_pairs=1, count_keys=["subject", "montage"])
    assert sorted(r.label for r in out.collect()) == ["A1-A2", "A2-A4", "X-Y-Z"]
    assert pairs_screen.screen_pairs(pairs, contacts, [], min_pairs=4, count_keys=["subject", "montage"]).count() == 0


def test_clean_atlas_placeholders(spark):
    df = spark.createDataFrame([(' "Left Amygdala" ',), (" Unknown ",), ("[]",), (None,)], "a string")
    got = [r[0] for r in df.select(summary.clean_atlas("a")).collect()]
    assert got == ["left amygdala", None, None, None]


def test_power_table_round_trip(spark, tmp_path):
    from trialspark.sources import tables
    df = spark.createDataFrame([("catFR1", "encoding", "s", 0, 1, [1.0, 2.0, 3.0, 4.0])],
                               "experiment string, period string, subject string, session int, event int, "
                               "features array<double>")
    tables.write_power(df, str(tmp_path / "power"))
    back = tables.read_power(spark, str(tmp_path / "power"), "catFR1", "encoding")
    long = tables.power_to_long(back, n_freqs=2).collect()
    assert len(long) == 4 and {(r.channel, r.frequency_index) for r in long} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert tables.read_power(spark, str(tmp_path / "power"), "FR1").count() == 0


def test_attach_localization(spark):
    pairs = spark.createDataFrame([("s", 0, "A1-A2"), ("s", 0, "A2-A3")], "subject string, montage int, label string")
    loc = spark.createDataFrame([("s", 0, "A1-A2", "hippocampus")], "subject string, montage int, label string, region string")
    got = {r.label: r.region for r in summary.attach_localization(pairs, loc).collect()}
    assert got == {"A1-A2": "hippocampus", "A2-A3": None}


def test_clean_log_runs_every_check_its_columns_feed(spark):
    rows = []

    def add(subject, session, lst, items, recalls, flags=None, offsets=None):
        for i, (kind, item) in enumerate([("WORD", x) for x in items] + [("REC", x) for x in recalls]):
            word = kind == "WORD"
            flag = int(item in (flags or recalls)) if word else None
            rows.append((subject, session, lst, kind, item, session * 10**6 + lst * 10**5 + i * 1000, len(rows),
                         i + 1 if word else None, flag, f"{subject}{session}", (offsets or range(9))[i] + lst * 100))

    add("a", 0, 1, "pqr", "p")
    add("a", 0, 2, "pqr", "p", flags="pq")                        # Q4: flagged without a recall
    add("a", 0, 3, "pqr", "p", offsets=[0, 2, 1, 3])              # Q9
    add("a", 0, 4, "pqr", "p"), add("a", 1, 4, "pqr", "q")        # Q7: other recalls, both go
    add("a", 0, 5, "pqr", "p"), add("a", 1, 5, "pqr", "p")        # Q8: the later copy goes
    add("a", 0, 6, "pqrs", "p")                                   # Q5
    add("b", 0, 1, "pqr", "p"), add("b", 0, 2, "qrs", "q")
    add("c", 0, 1, "pqz", "p")                                    # Q2: nobody else saw z
    log = spark.createDataFrame(rows, "subject string, session long, list long, type string, item string, mstime long, "
                                      "event_id long, serialpos long, recalled long, eegfile string, eegoffset long")

    def left(df, **more):
        out = cleaning.clean_log(df, ["mstime", "event_id"], "WORD", "REC", gap_min=1, gap_max=10_000, **more)
        return {tuple(r) for r in out.select("subject", "session", "list").distinct().collect()}

    good = {("a", 0, 1), ("a", 0, 5), ("b", 0, 1), ("b", 0, 2)}
    assert left(log, list_length=3, min_subjects=2) == good
    # each check that cannot run leaves its own lists
    every = {tuple(r[:3]) for r in rows}
    assert left(log.drop("recalled", "serialpos", "eegfile", "eegoffset"), list_length=None) == every
    assert left(log.drop("recalled"), list_length=3, min_subjects=2) == good | {("a", 0, 2)}
    assert left(log.drop("eegfile"), list_length=3, min_subjects=2) == good | {("a", 0, 3)}
    assert left(log.drop("serialpos"), list_length=3, min_subjects=2) == good | {("a", 0, 4), ("a", 1, 4), ("a", 1, 5)}


def _raw(subject, session, lst, items, recalled=(), mstime=None, step=2500, file="f", offset=None, rec=None):
    """A list's rows: presentations, then recalls of the given positions."""
    t0 = (mstime if mstime is not None else session * 1_000_000 + lst * 100_000)
    rows = []
    for k, item in enumerate(items, 1):
        rows.append([subject, session, lst, "WORD", item, k, int(k in recalled), t0 + k * step, file])
    for j, k in enumerate(recalled if rec is None else rec):
        rows.append([subject, session, lst, "REC_WORD", items[k - 1], k, 1, t0 + 50_000 + j * 1000, file])
    return [r + [r[7] if offset is None else r[7] + offset] for r in rows]


def test_clean_log_removes_one_bad_list_for_every_rule(spark):
    """Q1-Q9 each take what they should and nothing else."""
    from trialspark.operators import cleaning
    from trialspark.operators.ordered import row_order
    rows, n = [], 0

    def fresh(k=4):
        nonlocal n
        n += k
        return [f"w{i}" for i in range(n - k, n)]
    common = fresh()
    for s in ("a", "b"):  # every item of the good subjects is seen by two subjects
        rows += _raw(s, 1, 1, common, (1, 3), file=f"{s}1")
    shared = {name: fresh() for name in ("repeat", "flag", "length", "gap", "dup_enc", "dup_all", "offset", "fine")}

    def both(name, **kw):
        items = kw.pop("items", shared[name])
        for s in ("a", "b"):
            rows.extend(_raw(s, 1, kw.get("lst", 2), items, kw.get("recalled", (2,)), kw.get("mstime"), kw.get("step", 2500),
                             kw.get("file", f"{s}1"), kw.get("offset"), kw.get("rec")))
    both("repeat", lst=2, items=shared["repeat"][:3] + [shared["repeat"][0]])
    both("flag", lst=3, rec=())
    both("length", lst=4, items=shared["length"][:3])
    both("gap", lst=5, step=9000)
    both("fine", lst=6)
    both("offset", lst=7, offset=-500_000)
    for s in ("a", "b"):
        # Q7: the presentation is there twice, the recalls once: both copies go
        rows += _raw(s, 2, 8, shared["dup_enc"], (1,), file=f"{s}2") + _raw(s, 3, 8, shared["dup_enc"], (), file=f"{s}3")
        # Q8: all is there twice: the later copy goes
        rows += _raw(s, 2, 9, shared["dup_all"], (2,), file=f"{s}2") + _raw(s, 3, 9, shared["dup_all"], (2,), file=f"{s}3")
    rows += _raw("no_recalls", 1, 1, common, (), file="n1")                                   # Q1
    rows += _raw("rare", 1, 1, fresh(), (1,), file="r1")                                      # Q2
    rows += _raw("excluded", 1, 1, common, (1,), file="e1")                                   # P10
    rows += _raw("a", 1, -1, common, (1,), mstime=10, file="")                                # P2
    rows += _raw("a", 9, 1, shared["fine"], (1,), file="a9")                                  # J1: not in the population
    log = spark.createDataFrame([tuple(r) for r in rows], "subject string, session long, list long, type string, item string, "
                                "serialpos long, recalled long, mstime long, eegfile string, eegoffset long").repartition(3)
    log = row_order(log, ["subject", "session", "mstime", "type", "serialpos"])
    allowed = spark.createDataFrame([(s, i) for s in ("a", "b", "no_recalls", "rare", "excluded") for i in (1, 2, 3)], "subject string, session long")
    out = cleaning.clean_log(log, ["row_order"], "WORD", "REC_WORD", 4, 2350, 2800,
                             excluded_subjects=spark.createDataFrame([("excluded",)], "subject string"), allowed=allowed, min_subjects=2,
                             lagged=["item", "recalled"])
    got = {(r.subject, r.session, r.list) for r in out.collect()}
    # list 7's offsets were set back against list 6 of the same file
    assert got == {(s, i, j) for s in ("a", "b") for i, j in ((1, 1), (1, 6), (2, 9))}
    words = {(r.list, r.item): r for r in out.where("subject = 'a' and type = 'WORD'").collect()}
    assert words[1, common[0]].outpos == 1 and words[1, common[0]].first_recalled and words[1, common[2]].outpos == 2
    assert words[1, common[1]].outpos is None and words[1, common[1]].prev_item == common[0] and words[1, common[1]].prev_recalled == 1
