"""Role mapping: how the driver's tables play the parts of the trial data model.

The library's operators are parameterised by column names; this module fixes one
mapping of the generated tables onto subject -> session -> list -> serial
position so that every query reads the full tables:

* trial words (lineitem, orders, part): subject = o_custkey, session =
  year(o_orderdate), list = l_orderkey, serial position = rank of the line inside
  its order by a total five-column order, item = l_partkey, category = p_type,
  recalled = (l_returnflag = 'R'), value = l_extendedprice, mstime = ship time.
* event log (events): subject = user_id, session = day number, list = 6-hour
  block of the day (1..4), type = event_type, order = (ts, event_id), item = props.k.
* raw word log (lineitem, orders, part): what a recording system would have written of the same trials. WORD rows are
  line items by ship time, REC_WORD rows the recalled ones some time later (but not those of a full load of
  MAX_QUANTITY, whose recall is missing), REC_START rows the orders, whose list is unknown (-999) if their status is P;
  orders of low priority are practice lists (-1); items are untidy names; sessions of every fifth year have no
  recording file, and a line with the largest discount and tax has a recording offset that was set back.
* feature events (embeddings): each vector is one presented item; items are
  presented in vec_id order in lists of LIST_LEN, LISTS_PER_SESSION lists make a
  session and SESSIONS_PER_SUBJECT sessions a subject; category = label; label 0
  vectors are the baseline ("countdown") events of their session; element k of
  the vector is feature (channel k div N_FREQS, frequency k mod N_FREQS).
* feature trials (embeddings): the same vectors as a three-axis value, element k = (channel, frequency, time
  bin) of a T_CHANNELS x T_FREQS x T_BINS grid; label 0 = countdown event (baseline), label 1 = distractor event
  of its list, every other label a presented word. Words have positions 1..n in their list, are recalled if
  their first element is positive, and recalled words come out in order of their second element; as in the raw
  logs, a word that was not recalled has the output position -999.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.session import deal, file_bytes, initial_shuffle_partitions
from trialspark.sources.tables import read_table  # noqa: F401 (re-exported)

# Fixed values of the role mapping.
LIST_LEN = 12
LISTS_PER_SESSION = 8
SESSIONS_PER_SUBJECT = 2
N_CHANNELS = 8
N_FREQS = 8
BASELINE_LABEL = 0
EVENT_LIST_HOURS = 6
DISTRACTOR_LABEL = 1
T_CHANNELS, T_FREQS, T_BINS = 4, 4, 4
NO_OUTPOS = -999

MAX_QUANTITY, MAX_DISCOUNT, MAX_TAX = 50, 0.10, 0.08
DAY_MS, RECALL_DELAY_DAYS, SET_BACK_DAYS = 86_400_000, 3000, 4000
NO_LIST = -999

#: bytes of the lineitem files whose trial words one task sorts, whatever the table's size
WORD_BYTES = 4 << 20

# total order of lines inside an order ((l_orderkey, l_linenumber) is not unique)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _ms(ts):
    """Milliseconds since the epoch of a wall-clock (timestamp_ntz) value, truncated from
    microseconds (the same rule as the oracle). Computed on the NTZ value itself, so the
    session time zone (and its daylight-saving shifts) can never move or reorder events."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, ts) / 1000).cast("bigint")


def trial_words(spark: SparkSession, sf_dir: str, with_category: bool = True) -> DataFrame:
    """Presented items: one row per line item with its trial coordinates.

    Join order matters at scale: the item lookup (part) is joined first, then orders on the
    order key; the order-key partitioning of that join is what every later list-level window
    and the within-list pair join reuse (``list`` is the order key), so the rows are not
    shuffled again by item after the list work is laid out.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if with_category:
        p = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
        li = li.join(p, li.l_partkey == p.p_partkey, "left")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority")
    # every list-level sort and window runs in the tasks of this deal
    parts = initial_shuffle_partitions(file_bytes(spark, f"{sf_dir}/lineitem.parquet"), WORD_BYTES, 2)
    df = deal(li, "l_orderkey", parts).join(deal(o, "o_orderkey", parts), li.l_orderkey == o.o_orderkey, "inner")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    cols = [
        F.col("o_custkey").alias("subject"),
        F.year("o_orderdate").cast("bigint").alias("session"),
        F.col("l_orderkey").alias("list"),
        F.row_number().over(w).cast("bigint").alias("serialpos"),
        F.col("l_partkey").alias("item"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("recalled"),
        F.col("l_extendedprice").alias("value"),
        _ms(F.col("l_shipdate")).alias("mstime"),
        F.col("l_linestatus").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").cast("bigint").alias("urgent"),
    ]
    if with_category:
        cols.append(F.col("category"))
    return df.select(*cols)


def word_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw word log: subject, session, trial (the order, which parts rows of one time), list, type, item_name,
    category, serialpos, recalled (text), mstime, eegfile, eegoffset (s)."""
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    trial = F.col("o_orderkey")
    file = F.when(F.year("o_orderdate") % 5 == 0, "").otherwise(F.concat_ws("_", "o_custkey", F.year("o_orderdate")))
    number = F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(trial + 1)
    # order by order first: what the position needs of a line is not carried to the item lookup
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", *LINE_ORDER[:-1])
    ship = _ms(F.col("l_shipdate"))
    back = (F.round("l_discount", 2) == MAX_DISCOUNT) & (F.round("l_tax", 2) == MAX_TAX)
    recalled = F.col("l_returnflag") == "R"
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("subject"), F.year("o_orderdate").cast("bigint").alias("session"), trial.alias("trial"), number.alias("list"),
        "l_partkey", F.row_number().over(w).cast("bigint").alias("serialpos"), recalled.cast("bigint").cast("string").alias("recalled"),
        ship.alias("mstime"), file.alias("eegfile"),
        (F.floor(ship / 1000) - F.when(back, SET_BACK_DAYS * DAY_MS // 1000).otherwise(0)).alias("eegoffset"),
        (recalled & (F.col("l_quantity") < MAX_QUANTITY)).alias("_recall"))
    lines = lines.join(p, F.col("l_partkey") == p.p_partkey, "left").withColumns({
        "item_name": F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\t")),
        "category": F.concat(F.lower("p_type"), F.lit(" "))}).drop("l_partkey", "p_partkey", "p_brand", "p_type")
    # a line gives its word row and, if recalled, its recall row: the joins run once for both
    word, recall = (F.struct(F.lit(t).alias("type"), F.lit(d * DAY_MS).cast("bigint").alias("later"))
                    for t, d in (("WORD", 0), ("REC_WORD", RECALL_DELAY_DAYS)))
    lines = lines.withColumn("_as", F.explode(F.when(F.col("_recall"), F.array(word, recall)).otherwise(F.array(word))))
    lines = lines.withColumns({"type": F.col("_as.type"), "mstime": F.col("mstime") + F.col("_as.later"),
                               "eegoffset": F.col("eegoffset") + F.floor(F.col("_as.later") / 1000)}).drop("_as", "_recall")
    start = _ms(F.col("o_orderdate"))
    starts = o.select(F.col("o_custkey").alias("subject"), F.year("o_orderdate").cast("bigint").alias("session"), trial.alias("trial"),
                      F.when(F.col("o_orderstatus") == "P", NO_LIST).otherwise(number).alias("list"),
                      F.when(F.col("o_orderstatus") == "F", "REC_START").when(F.col("o_orderstatus") == "P", "REC_START").otherwise("ORIENT").alias("type"),
                      start.alias("mstime"), file.alias("eegfile"), F.floor(start / 1000).alias("eegoffset"))
    return lines.unionByName(starts, allowMissingColumns=True)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an ordered trial log."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("subject"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("session"),
        (F.floor(F.hour("ts") / EVENT_LIST_HOURS) + 1).cast("bigint").alias("list"),
        F.col("event_type").alias("type"),
        _ms(F.col("ts")).alias("mstime"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        F.col("value"),
    )


EVENT_ORDER = ["mstime", "event_id"]


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as events with their trial coordinates and a double feature array."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("event"),
        F.floor(F.col("vec_id") / (LIST_LEN * LISTS_PER_SESSION * SESSIONS_PER_SUBJECT)).alias("subject"),
        F.floor(F.col("vec_id") / (LIST_LEN * LISTS_PER_SESSION)).alias("session"),
        F.floor(F.col("vec_id") / LIST_LEN).alias("list"),
        (F.col("vec_id") % LIST_LEN + 1).alias("serialpos"),
        F.col("label").cast("bigint").alias("category"),
        (F.col("label") == BASELINE_LABEL).alias("is_baseline"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def feature_trials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, distractors, countdowns) of the feature trials, each with its three-axis ``features``. All windows
    stay inside one list of LIST_LEN events."""
    ev = feature_events(spark, sf_dir)
    words = ev.where(F.col("category") > DISTRACTOR_LABEL)
    in_list = Window.partitionBy("list").orderBy("event")
    recalled = (F.col("features")[0] > 0).cast("bigint")
    words = words.withColumns({"serialpos": F.row_number().over(in_list).cast("bigint"), "recalled": recalled})
    out = Window.partitionBy("list", "recalled").orderBy(F.col("features")[1], "event")
    words = words.withColumn("outpos", F.when(F.col("recalled") == 1, F.row_number().over(out)).otherwise(NO_OUTPOS).cast("bigint"))
    words = words.withColumn("first_recalled", (F.col("outpos") == 1).cast("bigint"))
    keep = ["event", "subject", "session", "list", "serialpos", "category", "features"]
    return (words.select(*keep, "recalled", "outpos", "first_recalled"),
            ev.where(F.col("category") == DISTRACTOR_LABEL).select(*keep), ev.where(F.col("is_baseline")).select(*keep))
