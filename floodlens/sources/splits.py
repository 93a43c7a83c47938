"""Byte ranges of large classic capture files, so that one file is read by many tasks.

Records follow each other without marks between them, so a range has to find where one begins. Every range looks for
the first place from which a chain of plausible record headers follows, walks its records and reports where its first
one begins, where the first one beyond it begins, and how many it holds. The first range of a file begins at its header,
for certain; a range that does not begin where the one before it ends has been misled (data may look like headers), and
is walked again from there. So the places are proven, not likely. Running counts number the frames.
"""
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from floodlens.session import shared_dir
from floodlens.sources.capture import PCAP_ENTRY, PCAP_HEADER, PCAP_MAGIC, CaptureFile, PcapFormat, open_location

SPLIT_BYTES = 64 << 20
# Headers that have to follow each other, and seconds that may lie between two of them
CHAIN, SPREAD_S = 6, 86_400
LOOK_BYTES = 1 << 20
FOUND = "file_idx int, path string, start long, end long, begins long, beyond long, frames long"


def _plausible(words: np.ndarray, form: PcapFormat) -> np.ndarray:
    """Whether rows of four header words can be a record's: fraction, kept and original length."""
    _, fraction, kept, original = words.T
    return (fraction < form.units) & (kept <= form.longest) & (kept <= original) & (original <= 1 << 20) & (original > 0)


def first_record(stream, form: PcapFormat, start: int, size: int) -> int:
    """Where the first record at `start` or later seems to begin; `size` if there is none."""
    reach = (CHAIN + 1) * (PCAP_ENTRY + form.longest)
    at = start
    while at < size:
        stream.seek(at)
        data = stream.read(LOOK_BYTES + reach)
        raw = np.frombuffer(data, np.uint8)
        n = min(LOOK_BYTES, len(raw) - PCAP_ENTRY + 1)
        if n <= 0:
            break
        words = np.lib.stride_tricks.sliding_window_view(raw, PCAP_ENTRY)[:n]
        for lead in np.flatnonzero(_plausible(np.ascontiguousarray(words).view(form.word), form)).tolist():
            if _chain(data, form, lead, at + len(data) >= size):
                return at + lead
        at += n
    return size


def _chain(data: bytes, form: PcapFormat, at: int, last: bool) -> bool:
    """Whether CHAIN plausible records follow each other from here, or all up to the file's end."""
    before = None
    for _ in range(CHAIN):
        if at == len(data) and last and before is not None:
            return True
        if at + PCAP_ENTRY > len(data):
            return last and before is not None  # a record that was cut off
        head = np.frombuffer(data, form.word, 4, at).astype(np.int64)
        if not _plausible(head[None, :], form)[0] or (before is not None and abs(int(head[0]) - before) > SPREAD_S):
            return False
        before, at = int(head[0]), at + PCAP_ENTRY + int(head[2])
    return at <= len(data) or last


def walked(path: str, start: int, end: int, begins: int | None) -> tuple[int, int, int]:
    """(begins, beyond, frames): the first record of a range, the first one after it, and how many it holds."""
    system, where = open_location(path)
    with system.open_input_file(where) as f:
        size, form = f.size(), PcapFormat(f.read(PCAP_HEADER))
        if begins is None:
            begins = first_record(f, form, start, size)
        at, frames = begins, 0
        if begins < end:
            f.seek(begins)
            for data, offsets in form.blocks(f, begins, end):
                if offsets:
                    frames += len(offsets)
                    last = offsets[-1]
                    at += last - (offsets[0]) + PCAP_ENTRY + form.entry.unpack_from(data, last)[2]
        return begins, at, frames


def _walk_all(ranges: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [walked(r.path, int(r.start), int(r.end), None if pd.isna(r.begins) else int(r.begins)) for r in batch.itertuples()]
            yield batch.assign(begins=[o[0] for o in out], beyond=[o[1] for o in out], frames=[o[2] for o in out])
    return ranges.mapInPandas(run, FOUND)


def cuts(files: list[CaptureFile], split_bytes: int) -> list[tuple]:
    """Ranges (file_idx, path, start, end, begins) of the classic files over `split_bytes`."""
    out = []
    for file in files:
        if file.member is not None:
            continue
        system, where = open_location(file.path)
        with system.open_input_file(where) as f:
            size = f.size()
            if size <= split_bytes or f.read(4) not in PCAP_MAGIC or size < PCAP_HEADER:
                continue
        edges = [PCAP_HEADER, *range(split_bytes, size, split_bytes), size]
        edges = [e for i, e in enumerate(edges) if not i or e > edges[i - 1]]
        out += [(file.file_idx, file.path, a, b, PCAP_HEADER if a == PCAP_HEADER else None) for a, b in zip(edges, edges[1:])]
    return out


def located(spark: SparkSession, files: list[CaptureFile], split_bytes: int) -> str | None:
    """A file in the shared folder with the proven ranges of all cut files, one per line; None if none is cut.

    The ranges of all files, a few numbers each, are planned on the driver, as file listings are.
    """
    todo, known = cuts(files, split_bytes), {}
    if not todo:
        return None
    while todo:
        rows = spark.createDataFrame([(*t, None, None) for t in todo], FOUND).repartition(len(todo), "file_idx", "start")
        for r in _walk_all(rows).collect():
            known[r.file_idx, r.start] = r
        todo, at, expected = [], None, PCAP_HEADER
        for r in (known[k] for k in sorted(known)):
            if r.file_idx != at:
                at, expected = r.file_idx, PCAP_HEADER
            if expected is None:
                continue  # behind a range that is walked again
            if r.begins != expected:
                todo.append((r.file_idx, r.path, r.start, r.end, expected))
            expected = r.beyond if r.begins == expected else None
    lines, no, at = [], 0, None
    for r in (known[k] for k in sorted(known)):
        no = 0 if r.file_idx != at else no
        at = r.file_idx
        if r.frames:
            lines.append(json.dumps([r.file_idx, r.path, None, r.begins, r.end, no]))
        no += r.frames
    path = shared_dir(spark, "ranges")
    system, where = open_location(path)
    with system.open_output_stream(where) as f:
        f.write("\n".join(lines).encode())
    return path

