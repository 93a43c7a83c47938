"""Queries over labelling, sources of schedules, sampling and set operations (J*, R*, U*, S7-S15)."""
from pyspark.sql import functions as F

from floodlens.functions.columns import local_epoch
from floodlens.operators import evaluation as E
from floodlens.operators import labeling as L
from floodlens.operators import sampling as R
from floodlens.operators import sets as U
from floodlens.operators import views as V
from floodlens.operators.peer_windows import peer_windows
from floodlens.plans.packet_view import (ATTACKERS, ATTACKS_SQL, DIR_SQL, ROUNDS, SERVER, attacks, labelled_sql,
                                         packets, pk_sql, rounded, rounded_sql, table, win_sql)
from floodlens.plans.registry import query
from floodlens.plans.windows import ENC_SQL, FLOW_SQL, FLOWS_OUT_SQL, flows_out
from floodlens.schemas import ATTACKS, FEATURES, LABEL_NAMES, WINDOW_COLUMNS
from floodlens.session import shared_dir
from floodlens.sources.readers import catalog_attacks
from floodlens.sources.sinks import sequence_quality, write_sequences

SHORT = ["n_in", "n_out", "bytes_in", "icmp_ratio_in", "udp_ratio_in", "mean_size_in"]
LAB = f"WITH {pk_sql()}, {DIR_SQL}, {win_sql()}, {labelled_sql()}"
LAB3 = (f"WITH {pk_sql(3)}, {DIR_SQL}, {win_sql()}, "
        + labelled_sql().replace("w.peer_ip = e.ip", "w.peer_ip = e.ip"))
LABEL_KEY_SQL = "session, window_start, peer_ip, CAST(round AS INT) AS round, attack_rate, CAST(label AS INT) AS label"


def attacker_hosts(spark, sessions=1):
    return spark.createDataFrame([(f"s{s}", ip) for s in range(1, sessions + 1) for ip in ATTACKERS],
                                 "session string, ip string")


def schedule(spark, sessions=1):
    """The attack schedule, repeated for every session."""
    names = F.array(*[F.lit(f"s{s}") for s in range(1, sessions + 1)])
    return attacks(spark).withColumn("session", F.explode(names))


def labelled(spark, sf, sessions=1, features=SHORT, without=None):
    """Labelled windows; packets of the session `without` are left out before they are windowed."""
    p = packets(spark, sf, sessions)
    w = peer_windows(p if without is None else p.where(F.col("session") != without), [SERVER], features=features)
    return L.label_session(w, schedule(spark, sessions), attacker_hosts(spark, sessions))


def flag_rule(df):
    return df.withColumn("flagged", F.col("n_in") >= 3)


@query("detection_by_attack_rule", f"""{LAB}
SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS windows,
  round(avg(CASE WHEN n_in >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS flagged_share,
  CASE WHEN label = 0 THEN 'false positive' ELSE 'detection' END AS rate
FROM lab GROUP BY label""")
def q_flagship(spark, sf):
    d = flag_rule(labelled(spark, sf, features=["n_in"]))
    return d.groupBy("label").agg(
        F.count("*").alias("windows"), F.round(F.avg(F.col("flagged").cast("double")), 9).alias("flagged_share")
    ).withColumn("rate", F.when(F.col("label") == 0, "false positive").otherwise("detection"))


@query("label_windows", f"""{LAB}
SELECT session, window_start, peer_ip, CAST(label AS INT) AS label, attack_rate,
  CAST(hit IS NOT NULL AS INT) AS matched FROM hits""")
def q_label_windows(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    return L.label_windows(w, attacks(spark)).select(
        "session", "window_start", "peer_ip", "label", "attack_rate", F.col("matched").cast("int").alias("matched"))


@query("label_windows_shuffled", f"""{LAB}
SELECT session, window_start, peer_ip, CAST(label AS INT) AS label, attack_rate,
  CAST(hit IS NOT NULL AS INT) AS matched FROM hits""")
def q_label_windows_shuffled(spark, sf):
    """The way taken by a schedule too large to send to every task."""
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    return L.label_windows(w, attacks(spark), max_schedule=0).select(
        "session", "window_start", "peer_ip", "label", "attack_rate", F.col("matched").cast("int").alias("matched"))


@query("drop_unmatched", f"{LAB} SELECT session, window_start, peer_ip, CAST(label AS INT) AS label FROM lab")
def q_drop_unmatched(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    d = L.drop_unmatched(L.label_windows(w, attacks(spark)), attacker_hosts(spark))
    return d.select("session", "window_start", "peer_ip", "label")


@query("unmatched_count", f"""{LAB} SELECT CAST(count(*) AS BIGINT) AS unmatched_attacker_windows
FROM hits WHERE hit IS NULL AND peer_ip IN ('10.0.0.10', '10.0.0.11', '10.0.0.12')""")
def q_unmatched_count(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    return L.unmatched_count(L.label_windows(w, attacks(spark)), attacker_hosts(spark))


ROUND_SQL = f"{LAB} SELECT session, window_start, peer_ip, CAST(round AS INT) AS round FROM hits"


@query("assign_round", ROUND_SQL)
def q_assign_round(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    return L.assign_round(w, attacks(spark)).select("session", "window_start", "peer_ip", "round")


@query("assign_round_ordered", ROUND_SQL)
def q_assign_round_ordered(spark, sf):
    """The way taken by more rounds than may be sent to every task."""
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    return L.assign_round(w, attacks(spark), max_rounds=0).select("session", "window_start", "peer_ip", "round")


@query("labelled_windows", f"{LAB} SELECT {LABEL_KEY_SQL}, {rounded_sql(FEATURES)} FROM lab")
def q_labelled_windows(spark, sf):
    d = labelled(spark, sf, features=FEATURES).select(*WINDOW_COLUMNS)
    return d.select("session", "window_start", "peer_ip", "round", "attack_rate", "label", *rounded(FEATURES))


@query("labelled_flows", f"""WITH {pk_sql()}, {DIR_SQL}, {FLOW_SQL}, {labelled_sql(30.0, source='flow')}
SELECT {FLOWS_OUT_SQL}, CAST(round AS INT) AS round, attack_rate, CAST(label AS INT) AS label FROM lab""")
def q_labelled_flows(spark, sf):
    fl = V.flow_view(packets(spark, sf), [SERVER])
    d = L.label_session(fl, attacks(spark), attacker_hosts(spark), window_s=30.0)
    return flows_out(d, ["round", "attack_rate", "label"])


# --- A published capture: local times, other attacks, blocks -----------------------------

# Fixed values of the derived catalogue: attack name, label, local start and end (UTC-3)
CATALOG = [
    ("scan", -1, "1969-12-31 21:00", "1969-12-31 21:01"),
    ("flood", 4, "1969-12-31 21:01:30", "1969-12-31 21:02:30"),
    ("reflect", 5, "1969-12-31 21:03", "1969-12-31 21:04:15"),
]
CATALOG_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {label}, '{a}', '{b}')" for i, (n, label, a, b) in enumerate(CATALOG, 1)
) + """) t(round, name, label, s, e)),
ev AS (SELECT round, name, label,
    epoch(strptime(CASE WHEN length(s) = 16 THEN s || ':00' ELSE s END, '%Y-%m-%d %H:%M:%S')) + 3 * 3600 AS start_ts,
    epoch(strptime(CASE WHEN length(e) = 16 THEN e || ':00' ELSE e END, '%Y-%m-%d %H:%M:%S')) + 3 * 3600 AS end_ts
  FROM cat)"""
CATALOG_HOST = "10.0.0.14"


def catalog_schedule(spark, session="s1", host=CATALOG_HOST, rows=CATALOG, offset=-3):
    return catalog_attacks(spark, session, host, offset, rows)


CAT_LAB = f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()}, {CATALOG_SQL},
h AS (SELECT w.*, e.label AS hit, coalesce(e.label, 0) AS label, coalesce(e.name, '') AS attack
  FROM win w LEFT JOIN ev e ON w.peer_ip = '{CATALOG_HOST}' AND w.window_start + 1 > e.start_ts - 2
    AND w.window_start < e.end_ts + 2
  QUALIFY row_number() OVER (PARTITION BY w.window_start, w.peer_ip ORDER BY e.round DESC NULLS LAST) = 1),
k AS (SELECT * FROM h WHERE NOT (peer_ip = '{CATALOG_HOST}' AND hit IS NULL)),
pub AS (SELECT *, CAST(floor((window_start - min(window_start) OVER ()) / 60) AS INT) AS round FROM k WHERE label >= 0)"""


def catalog_labelled(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    hosts = spark.createDataFrame([("s1", CATALOG_HOST)], "session string, ip string")
    return L.label_catalog(w, catalog_schedule(spark), hosts, "pub", block_s=60.0)


@query("label_catalog", f"""{CAT_LAB} SELECT 'pub' AS session, window_start, peer_ip, CAST(label AS INT) AS label,
  round, '' AS attack_rate FROM pub""")
def q_label_catalog(spark, sf):
    return catalog_labelled(spark, sf)[0].select(
        "session", "window_start", "peer_ip", "label", "round", "attack_rate")


@query("catalog_attack_counts", f"""{CAT_LAB}
SELECT attack, CAST(count(*) AS BIGINT) AS windows FROM k WHERE peer_ip = '{CATALOG_HOST}' GROUP BY attack""")
def q_catalog_counts(spark, sf):
    return catalog_labelled(spark, sf)[1]


@query("drop_other_attacks", f"""{CAT_LAB}
SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS n FROM pub GROUP BY label""")
def q_drop_other_attacks(spark, sf):
    return catalog_labelled(spark, sf)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("time_blocks", """WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS t FROM orders)
SELECT o_orderkey, CAST(floor((t - min(t) OVER ()) / 2592000) AS INT) AS round FROM o""")
def q_time_blocks(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("window_start"))
    return L.time_blocks(o, 2_592_000.0).select("o_orderkey", "round")


@query("catalog_epoch", """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') ||
    CASE WHEN o_orderkey % 2 = 0 THEN ':30' ELSE '' END AS local_time, CAST(o_orderkey % 5 AS INT) - 2 AS utc_offset FROM orders)
SELECT o_orderkey, local_time, utc_offset,
  CAST(epoch(strptime(CASE WHEN length(local_time) = 16 THEN local_time || ':00' ELSE local_time END, '%Y-%m-%d %H:%M:%S'))
       - utc_offset * 3600 AS DOUBLE) AS epoch_s FROM t""")
def q_catalog_epoch(spark, sf):
    o = table(spark, sf, "orders")
    local = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm"),
                     F.when(F.col("o_orderkey") % 2 == 0, ":30").otherwise(""))
    return (o.select("o_orderkey", local.alias("local_time"),
                     ((F.col("o_orderkey") % 5).cast("int") - 2).alias("utc_offset"))
            .withColumn("epoch_s", local_epoch(F.col("local_time"), F.col("utc_offset"))))


# --- Joins on keys and whole vectors ------------------------------------------------------

SEQUENCE_SQL = f"""{LAB}, {ENC_SQL}
SELECT CAST(l.label AS INT) AS label, CAST(count(*) AS BIGINT) AS windows,
  CAST(median(s.length) AS DOUBLE) AS median_length,
  round(avg(CASE WHEN s.length = 32 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS full_share
FROM lab l JOIN (SELECT session, window_start, peer_ip, count(*) AS length FROM enc GROUP BY ALL) s
  USING (session, window_start, peer_ip) GROUP BY l.label"""


@query("attach_sequences", SEQUENCE_SQL)
def q_attach_sequences(spark, sf):
    w = labelled(spark, sf, features=["n_in"])
    s = V.sequence_view(packets(spark, sf), [SERVER])
    return sequence_quality(L.attach_sequences(w, s), ["label"])


@query("sequence_sink", SEQUENCE_SQL)
def q_sequence_sink(spark, sf):
    """Written row-aligned with the labelled windows and read back."""
    path = shared_dir(spark, "sequences")
    write_sequences(labelled(spark, sf, features=["n_in"]), V.sequence_view(packets(spark, sf), [SERVER]), path)
    return sequence_quality(spark.read.parquet(path), ["label"])


OVERLAP_COLS = ["n_in", "n_out", "bytes_in", "min_size_in", "max_size_in", "uniq_sport_in"]


@query("verbatim_overlap", f"""{LAB3.replace('session, round, ip', 'session0, round, ip')},
tr AS (SELECT DISTINCT {", ".join(OVERLAP_COLS)} FROM win WHERE session <> 's3'),
te AS (SELECT {", ".join(OVERLAP_COLS)} FROM win WHERE session = 's3')
SELECT CAST(count(tr.n_in) AS BIGINT) AS seen, CAST(count(*) AS BIGINT) AS rows,
  round(count(tr.n_in) / CAST(count(*) AS DOUBLE), 9) AS share FROM te LEFT JOIN tr USING ({", ".join(OVERLAP_COLS)})""")
def q_verbatim_overlap(spark, sf):
    w = R.holdout_session(peer_windows(packets(spark, sf, 3), [SERVER], features=OVERLAP_COLS))
    out = L.verbatim_overlap(w.where("is_test"), w.where("not is_test"), OVERLAP_COLS)
    return out.withColumn("share", F.round("share", 9))


LINE_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("verbatim_overlap_lines", f"""WITH tr AS (SELECT DISTINCT {", ".join(LINE_COLS)} FROM lineitem WHERE l_linenumber > 1)
SELECT CAST(count(tr.l_quantity) AS BIGINT) AS seen, CAST(count(*) AS BIGINT) AS rows,
  round(count(tr.l_quantity) / CAST(count(*) AS DOUBLE), 9) AS share
FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) te LEFT JOIN tr USING ({", ".join(LINE_COLS)})""")
def q_verbatim_overlap_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    out = L.verbatim_overlap(li.where("l_linenumber = 1"), li.where("l_linenumber > 1"), LINE_COLS)
    return out.withColumn("share", F.round("share", 9))


@query("duplicate_share", f"""WITH d AS (SELECT {", ".join(LINE_COLS)}, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_rows,
  round(1 - count(*) / CAST(sum(c) AS DOUBLE), 9) AS duplicate_share FROM d""")
def q_duplicate_share(spark, sf):
    return L.duplicate_share(table(spark, sf, "lineitem"), LINE_COLS).withColumn(
        "duplicate_share", F.round("duplicate_share", 9))


# --- Sampling and splitting ----------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_MD5 = "md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey)"
ROW_MD5 = "md5('42|' || session || '|' || CAST(window_start AS BIGINT) || '|' || peer_ip)"


def keyed_windows(spark, sf, sessions=1):
    return labelled(spark, sf, sessions, ["n_in"]).withColumn("slot", F.col("window_start").cast("bigint"))


@query("undersample", f"""WITH n AS (SELECT min(c) AS q FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_MD5}) <= (SELECT q FROM n)""")
def q_undersample(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag")
    return R.undersample(li, LINE_KEY, 7, "l_returnflag").select(*LINE_KEY, "l_returnflag")


CAP_ROWS = 500


@query("stratified_cap", f"""{LAB},
c AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY {ROW_MD5}) AS rn FROM lab)
SELECT session, window_start, peer_ip, CAST(label AS INT) AS label FROM c
WHERE total <= {CAP_ROWS} OR rn <= greatest(1, CAST(round_even({CAP_ROWS} * n / CAST(total AS DOUBLE), 0) AS BIGINT))""")
def q_stratified_cap(spark, sf):
    d = R.stratified_cap(keyed_windows(spark, sf), CAP_ROWS, ["session", "slot", "peer_ip"], 42)
    return d.select("session", "window_start", "peer_ip", "label")


@query("stratified_cap_lines", f"""WITH c AS (SELECT *, count(*) OVER () AS total,
    count(*) OVER (PARTITION BY l_returnflag) AS n,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_MD5}) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM c
WHERE total <= 5000 OR rn <= greatest(1, CAST(round_even(5000 * n / CAST(total AS DOUBLE), 0) AS BIGINT))""")
def q_stratified_cap_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag")
    return R.stratified_cap(li, 5000, LINE_KEY, 7, "l_returnflag").select(*LINE_KEY, "l_returnflag")


@query("holdout_session", f"""WITH {pk_sql(3)}, {DIR_SQL}, {win_sql()}
SELECT session, CAST(count(*) AS BIGINT) AS windows, CAST(session = (SELECT max(session) FROM win) AS INT) AS is_test
FROM win GROUP BY session""")
def q_holdout_session(spark, sf):
    w = R.holdout_session(peer_windows(packets(spark, sf, 3), [SERVER], features=["n_in"]))
    return w.groupBy("session", F.col("is_test").cast("int").alias("is_test")).agg(F.count("*").alias("windows"))


@query("stratified_group_kfold", f"""{LAB},
n AS (SELECT session, round, label, count(*) AS n FROM lab GROUP BY ALL),
c AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) AS share FROM n),
own AS (SELECT *, row_number() OVER (PARTITION BY session, round ORDER BY share DESC, label DESC) AS rn,
    sum(n) OVER (PARTITION BY session, round) AS size FROM c),
g AS (SELECT session, round, row_number() OVER (ORDER BY label, size DESC, session, round) - 1 AS pos FROM own WHERE rn = 1),
f AS (SELECT session, round, CASE WHEN (pos // 4) % 2 = 0 THEN pos % 4 ELSE 3 - pos % 4 END AS fold FROM g)
SELECT CAST(fold AS INT) AS fold, n.session, CAST(n.round AS INT) AS round, CAST(label AS INT) AS label, CAST(n AS BIGINT) AS windows
FROM n JOIN f ON n.session = f.session AND n.round = f.round""")
def q_group_kfold(spark, sf):
    d = R.stratified_group_kfold(labelled(spark, sf, features=["n_in"]), ["session", "round"], 4)
    return d.groupBy("fold", "session", "round", "label").agg(F.count("*").alias("windows"))


@query("group_shuffle_split", f"""{LAB},
g AS (SELECT DISTINCT session, round FROM lab),
v AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || session || '|' || round)) <= ceil(0.15 * count(*) OVER ()) AS is_val FROM g)
SELECT l.session, CAST(l.round AS INT) AS round, CAST(is_val AS INT) AS is_val, CAST(count(*) AS BIGINT) AS windows
FROM lab l JOIN v USING (session, round) GROUP BY ALL""")
def q_group_shuffle_split(spark, sf):
    d = R.group_shuffle_split(labelled(spark, sf, features=["n_in"]), ["session", "round"], 0.15, 42)
    return d.groupBy("session", "round", F.col("is_val").cast("int").alias("is_val")).agg(F.count("*").alias("windows"))


@query("stratified_split", f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS n,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_MD5}) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM c WHERE rn <= CAST(round_even(CAST(0.2 AS DOUBLE) * n, 0) AS BIGINT)""")
def q_stratified_split(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag")
    return R.stratified_split(li, LINE_KEY, 0.2, 7, "l_returnflag").select(*LINE_KEY, "l_returnflag")


@query("shuffle", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LINE_MD5} AS order_key FROM lineitem")
def q_shuffle(spark, sf):
    return R.shuffled(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY, 7)


@query("class_weights", f"""{LAB}
SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS n,
  round((SELECT count(*) FROM lab) / ((SELECT count(DISTINCT label) FROM lab) * CAST(count(*) AS DOUBLE)), 9) AS weight
FROM lab GROUP BY label""")
def q_class_weights(spark, sf):
    return R.class_weights(labelled(spark, sf, features=["n_in"])).withColumn("weight", F.round("weight", 9))


SETTINGS_SQL = """sources AS (SELECT DISTINCT session FROM win), settings AS (
SELECT session || ' only' AS trained_on, session FROM sources
UNION ALL SELECT 'all but ' || a.session, b.session FROM sources a JOIN sources b ON a.session <> b.session
UNION ALL SELECT 'all datasets', session FROM sources)"""


@query("training_grid", f"""WITH {pk_sql(3)}, {DIR_SQL}, {win_sql()}, {SETTINGS_SQL},
c AS (SELECT session, count(*) AS n FROM win GROUP BY session)
SELECT trained_on, CAST(sum(n) AS BIGINT) AS train_rows, CAST(count(*) AS BIGINT) AS sources
FROM settings JOIN c USING (session) GROUP BY trained_on""")
def q_training_grid(spark, sf):
    w = peer_windows(packets(spark, sf, 3), [SERVER], features=["n_in"]).groupBy("session").agg(F.count("*").alias("n"))
    return R.training_settings(w).join(w, "session").groupBy("trained_on").agg(
        F.sum("n").alias("train_rows"), F.count("*").alias("sources"))


# --- Sets -----------------------------------------------------------------------------------

@query("union_sessions", f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()}
SELECT 'a' AS source, peer_ip, CAST(count(*) AS BIGINT) AS windows FROM win GROUP BY peer_ip
UNION ALL SELECT 'b', peer_ip, CAST(count(*) AS BIGINT) FROM win GROUP BY peer_ip""")
def q_union_sessions(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    both = U.union_sessions([w.withColumn("source", F.lit("a")), w.withColumn("source", F.lit("b"))])
    return both.groupBy("source", "peer_ip").agg(F.count("*").alias("windows"))


@query("key_except", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def q_key_except(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return U.key_except(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("distinct_sources", f"""WITH {pk_sql()}
SELECT 'dst' AS name, CAST(count(DISTINCT dst) AS BIGINT) AS distinct_values FROM pk
UNION ALL SELECT 'proto', CAST(count(DISTINCT proto) AS BIGINT) FROM pk
UNION ALL SELECT 'src', CAST(count(DISTINCT src) AS BIGINT) FROM pk""")
def q_distinct_sources(spark, sf):
    return U.distinct_counts(packets(spark, sf), ["src", "dst", "proto"])


@query("binary_label", f"""{LAB}
SELECT CAST(label > 0 AS INT) AS attack, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY label > 0""")
def q_binary_label(spark, sf):
    return labelled(spark, sf, features=["n_in"]).groupBy((F.col("label") > 0).cast("int").alias("attack")).agg(
        F.count("*").alias("n"))


NAMES_SQL = "CASE label " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABEL_NAMES.items()) + " END"


@query("label_counts", f"""{LAB}
SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS n, {NAMES_SQL} AS name FROM lab GROUP BY label""")
def q_label_counts(spark, sf):
    return E.label_counts(labelled(spark, sf, features=["n_in"]))


__all__ = ["ATTACKS", "ATTACKS_SQL", "ROUNDS"]
