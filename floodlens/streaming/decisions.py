"""Per-peer state machines over streams of scored windows (K7, K8, K12) and minute counts."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floodlens.operators.adaptive import CONSECUTIVE
from floodlens.operators.mitigation import ACTIONS
from floodlens.schemas import WINDOW_SECONDS

SCORED = "session string, peer_ip string, window_start double, now double, flagged boolean, score double, action_ok boolean"
OBSERVED = "session string, peer_ip string, window_start double, flag boolean"


def _in_order(frames) -> pd.DataFrame:
    """A key's windows of one micro-batch in time order: at most one per slot."""
    return pd.concat(list(frames)).sort_values("window_start", kind="stable", ignore_index=True)


def _run_positions(flag: np.ndarray, broken: np.ndarray, carried: int) -> np.ndarray:
    """How many flagged windows in a row end at each window, 0 where it is not flagged.

    `broken` marks windows before which a run ends; `carried` is the run held when the first arrives.
    """
    at = np.arange(len(flag))
    begin = np.where(~flag, at + 1, np.where(broken, at, -carried))
    return np.where(flag, at + 1 - np.maximum.accumulate(begin), 0)


def decide_peer(rows: pd.DataFrame, run: int, until: float, consecutive: int, seconds: float,
                spared: bool) -> tuple[pd.DataFrame, int, float]:
    """One peer's actions on windows in time order, and its state after them: run length and end of its block.

    The rows are cut at the blocks they set: between two of them, runs and candidates are found at once.
    """
    rest, found = rows, []
    while len(rest):
        counted = rest["flagged"].to_numpy(bool) & (rest["now"].to_numpy() >= until)
        position = _run_positions(counted, np.zeros(len(rest), bool), run)
        candidates = rest.assign(windows=position)[(position >= consecutive) & (not spared)]
        works = np.flatnonzero(candidates["action_ok"].to_numpy(bool))
        tried = candidates if not len(works) else candidates.iloc[:works[0] + 1]
        found.append(tried)
        if not len(works):
            run = int(position[-1])
            break
        set_at = candidates.index[works[0]]
        run, until = 0, float(rest.loc[set_at, "now"]) + seconds
        rest = rest.loc[set_at:].iloc[1:]
    actions = pd.concat(found) if found else rows.assign(windows=0)
    ok = actions["action_ok"].to_numpy(bool)
    out = pd.DataFrame(dict(zip(ACTIONS.names, (
        actions["session"], actions["peer_ip"], np.where(ok, "block", "error"), actions["now"], actions["score"],
        actions["windows"], np.where(ok, seconds, np.nan)))), index=actions.index)
    return out.replace({np.nan: None}), run, until


def stream_block_decisions(scored: DataFrame, consecutive: int = 2, seconds: float = 60.0,
                           whitelist: list[str] = ()) -> DataFrame:
    """Block and error actions as windows arrive; state per peer: run length and end of the block."""
    spared = list(whitelist)

    def decide(key, frames, state: GroupState):
        run, until = state.get if state.exists else (0, float("-inf"))
        rows = _in_order(frames).assign(session=key[0], peer_ip=key[1])
        actions, run, until = decide_peer(rows, run, until, consecutive, seconds, key[1] in spared)
        state.update((run, until))
        yield actions

    return scored.groupBy("session", "peer_ip").applyInPandasWithState(
        decide, ACTIONS, "streak int, until double", "append", GroupStateTimeout.NoTimeout)


PEERS = "session string, peer_ip string, streak int, until double"


def carried_decisions(scored: DataFrame, peers: DataFrame, consecutive: int = 2, seconds: float = 60.0,
                      whitelist: list[str] = ()) -> DataFrame:
    """Actions on one micro-batch of scored windows, and every peer's state after it, told apart by `kind`.

    `peers` is the state before it. Peers without windows keep theirs; a peer without a run whose block is over
    needs none, and leaves the table once its session's decisions have come that far.
    """
    spared = list(whitelist)
    names = [*ACTIONS.names, "kind", "streak", "until"]

    def decide(key, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        run, until = (int(state["streak"].iloc[0]), float(state["until"].iloc[0])) if len(state) else (0, float("-inf"))
        actions, run, until = decide_peer(rows.sort_values("window_start", kind="stable", ignore_index=True), run, until,
                                          consecutive, seconds, key[1] in spared)
        after = pd.DataFrame([(*key, "state", run, until)], columns=["session", "peer_ip", "kind", "streak", "until"])
        return pd.concat([actions.assign(kind="action"), after]).reindex(columns=names).replace({np.nan: None})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ACTIONS.fields) + ", kind string, streak int, until double"
    both = scored.select("session", "peer_ip", "window_start", "now", "flagged", "score", "action_ok").groupBy("session", "peer_ip").cogroup(
        peers.groupBy("session", "peer_ip")).applyInPandas(decide, schema)
    clock = scored.groupBy("session").agg(F.max("now").alias("_clock"))
    over = (F.col("kind") == "state") & (F.col("streak") == 0) & (F.col("until") <= F.coalesce("_clock", F.lit(float("-inf"))))
    return both.join(clock, "session", "left").where(~over).drop("_clock")


def stream_pseudo_labels(observed: DataFrame, consecutive: int = CONSECUTIVE,
                         window_s: float = WINDOW_SECONDS) -> DataFrame:
    """Kind of every window (benign, attack or null); state per peer: run length and last window."""

    def label(key, frames, state: GroupState):
        run, last = state.get if state.exists else (0, float("-inf"))
        rows = _in_order(frames)
        start, flag = rows["window_start"].to_numpy(float), rows["flag"].to_numpy(bool)
        position = _run_positions(flag, np.diff(start, prepend=last) > window_s, run)
        state.update((int(position[-1]), float(start[-1])))
        kind = np.select([~flag, position >= consecutive], ["benign", "attack"], None)
        yield rows.assign(kind=kind)[["session", "peer_ip", "window_start", "kind"]]

    return observed.groupBy("session", "peer_ip").applyInPandasWithState(
        label, "session string, peer_ip string, window_start double, kind string",
        "streak int, last double", "append", GroupStateTimeout.NoTimeout)


def stream_minute_stats(scored: DataFrame, delay: str = "0 seconds", every: str = "60 seconds") -> DataFrame:
    """Windows and flagged windows per minute of decision time."""
    at = scored.withColumn("at", F.timestamp_micros(F.round(F.col("now") * 1e6).cast("bigint"))).withWatermark("at", delay)
    return at.groupBy(F.window("at", every)).agg(
        F.count("*").alias("windows"), F.count_if(F.col("flagged")).alias("flagged")
    ).select((F.unix_seconds("window.start") / 60).cast("bigint").alias("minute"), "windows", "flagged")
