"""Sessions, schedules, counters, logs and scores as tables with explicit schemas."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.columns import local_epoch, name_of
from floodlens.operators.views import flow_features
from floodlens.schemas import ATTACKS, COUNTER_FLOWS, DETECTOR_LOG, FLOW_COLUMNS, FLOW_SECONDS, SCORES, SESSIONS

# --- Fixed values: protocol numbers and the attack each protocol stands for in counter tables
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1}
PROTOCOL_ATTACK = {"ICMP": 1, "UDP": 2, "TCP": 3}
COUNTER_BLOCK_S = 1800
# Lines of the capture tool's log, such as "120 packets dropped by kernel"
CAPTURE_COUNTERS = ["captured", "received by filter", "dropped by kernel"]
# -----------------------------------------------------------------------------------------------


def read_sessions(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(SESSIONS).option("multiLine", multi_line).json(path)


def session_hosts(sessions: DataFrame, role: str) -> DataFrame:
    """The hosts of one role ("attackers" or "clients"): session, name, ip."""
    return sessions.select("session", F.explode(role).alias("name", "ip"))


def read_attacks(spark: SparkSession, path) -> DataFrame:
    """Attack schedules; an empty one is legal. `ev_order` is an event's place: its file, the file's split, the row in it."""
    rows = spark.read.schema(ATTACKS).option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("ev_order"))


def catalog_attacks(spark: SparkSession, session: str, attacker: str, utc_offset: int, rows) -> DataFrame:
    """Schedule rows of a published capture from (name, label, local start, local end)."""
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows, 1)], "round int, rate string, label int, s string, e string")
    offset = F.lit(utc_offset)
    return table.select(
        F.lit(session).alias("session"), "round", F.lit(attacker).alias("ip"), "label", "rate",
        local_epoch(F.col("s"), offset).alias("start_ts"), local_epoch(F.col("e"), offset).alias("end_ts"),
        F.col("round").alias("ev_order"))


def read_counter_flows(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(COUNTER_FLOWS).option("header", True).csv(path)


def counter_flow_view(raw: DataFrame, session: str = "sdn", interval_s: float = FLOW_SECONDS) -> DataFrame:
    """Flow-counter rows as labelled flow rows. Counters already include the frame header."""
    proto = name_of(F.col("Protocol"), PROTOCOLS)
    label = F.when(F.col("label") != 0, name_of(F.col("Protocol"), PROTOCOL_ATTACK)).otherwise(F.lit(0))
    return (raw.where(F.col("pktperflow") > 0)
            .select(F.lit(session).alias("session"),
                    F.floor(F.col("dt") / COUNTER_BLOCK_S).cast("int").alias("round"),
                    F.col("dt").cast("double").alias("window_start"), F.col("src").alias("peer_ip"), "dst",
                    proto.alias("proto"),
                    *flow_features(F.col("pktperflow"), F.col("byteperflow"), F.col("Pairflow"), proto, interval_s),
                    F.lit("").alias("attack_rate"), label.alias("label"))
            .select(*FLOW_COLUMNS))


def split_windows_field(log: DataFrame) -> DataFrame:
    """The log's `windows` is a count or a list: keep the count, name the list `unscored`."""
    is_list = F.col("windows").startswith("[")
    return (log.withColumn("n_windows", F.when(~is_list, F.col("windows").cast("bigint")))
            .withColumn("unscored", F.when(is_list, F.col("windows"))).drop("windows"))


def read_detector_log(spark: SparkSession, path) -> DataFrame:
    """Detector events, one JSON object per line; lines that do not parse are dropped."""
    rows = spark.read.schema(DETECTOR_LOG).option("mode", "DROPMALFORMED").json(path)
    return split_windows_field(rows)


def stream_detector_log(spark: SparkSession, path, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream over a folder of rolled log files."""
    rows = (spark.readStream.schema(DETECTOR_LOG).option("mode", "DROPMALFORMED")
            .option("maxFilesPerTrigger", files_per_trigger).json(path))
    return split_windows_field(rows)


def tail_lines(spark: SparkSession, path, files_per_trigger: int = 100) -> DataFrame:
    """Complete lines of rolled text files as they appear, empty ones left out."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
            .where(F.length("value") > 0))


def read_scores(spark: SparkSession, path) -> DataFrame:
    """Scored windows; files without novel or model_version get 0 there.

    Columns are found by the names in each file's own header line, in whatever order they stand; in
    a file without one by the number of columns, in the usual order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    is_header = F.col("value").startswith("window_start")
    headers = lines.where(is_header).groupBy("file").agg(F.split(F.first("value"), ",").alias("names"))
    rows = lines.where(~is_header).join(headers, "file", "left").withColumn("parts", F.split("value", ","))
    forms = [[c for c in SCORES.names if c not in left_out] for left_out in (("novel", "model_version"), ("model_version",), ())]
    assumed = F.array()
    for form in forms:
        assumed = F.when(F.size("parts") == len(form), F.array(*map(F.lit, form))).otherwise(assumed)
    rows = rows.withColumn("names", F.coalesce("names", assumed))

    def named(name, kind, otherwise=None):
        at = F.array_position(F.transform("names", F.trim), name)
        value = F.when(at > 0, F.get("parts", (at - 1).cast("int")).cast(kind))
        return (value if otherwise is None else F.coalesce(value, F.lit(otherwise))).alias(name)

    return rows.select(
        named("window_start", "double"), named("peer_ip", "string"),
        named("n_in", "double").cast("bigint").alias("n_in"), named("score", "double"), named("novel", "int", 0),
        named("flagged", "int"), named("model_version", "int", 0)
    ).where(F.col("window_start").isNotNull()).select(*SCORES.names)


def capture_counters(lines: DataFrame, by: list[str] = ()) -> DataFrame:
    """Captured / received by filter / dropped by kernel from the capture tool's log lines (`value`)."""
    found = [F.max(F.regexp_extract("value", rf"(\d+) packets? {name}", 1).try_cast("bigint"))
             .alias(name.replace(" ", "_")) for name in CAPTURE_COUNTERS]
    return lines.groupBy(*by).agg(*found)
