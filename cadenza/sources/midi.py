"""Standard MIDI files: notes and tempi from their bytes, and bytes from notes.

A file is small and sequential by nature; it is parsed whole in one row of a binary scan, and files are dealt over tasks. Times are in quarter
notes. A file that is no MIDI file, or breaks off, has no notes and an error text; running status, note-on without velocity and notes that
are still held at the end of a track (they end there) are understood.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "file string, track int, channel int, program int, pitch int, velocity int, start double, duration double, error string"
#: Ticks of a quarter note in files that are written.
TICKS = 480
_MICROSECONDS = 60_000_000


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length, and the place after it."""
    value = 0
    while True:
        value = value << 7 | data[at] & 0x7F
        at += 1
        if data[at - 1] < 0x80:
            return value, at


def _variable(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _spans(track: bytes) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(tick, status, kind, begin, end) of each event of a track: the places of its data; meta events have status 255, and their type as kind."""
    at, tick, status = 0, 0, 0
    while at < len(track):
        delta, at = _number(track, at)
        tick += delta
        if track[at] >= 0x80:
            status = track[at]
            at += 1
        kind = b""
        if status == 0xFF:
            kind = track[at : at + 1]
            at += 1
        if status in (0xF0, 0xF7, 0xFF):
            size, at = _number(track, at)
        else:
            size = 1 if status >> 4 in (0xC, 0xD) else 2
        yield tick, status, kind, at, at + size
        at += size


def _events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of a track without system exclusive events; meta events have status 255 and their type as the first byte."""
    return ((tick, status, kind + track[a:b]) for tick, status, kind, a, b in _spans(track) if status not in (0xF0, 0xF7))


def _track_places(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """The division, and where each track begins and ends."""
    if data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    size, _, _, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("times in frames are not supported")
    at, out = 8 + size, []
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if name == b"MTrk":
            out.append((at + 8, min(at + 8 + size, len(data))))
        at += 8 + size
    return division, out


def _tracks(data: bytes) -> tuple[int, list[bytes]]:
    division, places = _track_places(data)
    return division, [data[a:b] for a, b in places]


def parse(data: bytes) -> list[tuple[int, int, int, int, int, float, float]]:
    """(track, channel, program, pitch, velocity, start, duration) of each note, in order of track, start and pitch."""
    division, tracks = _tracks(data)
    notes = []
    for number, track in enumerate(tracks):
        programs, held, tick = [0] * 16, {}, 0
        for tick, status, body in _events(track):
            channel, kind = status & 0x0F, status >> 4
            if status == 0xFF:
                continue
            if kind == 0xC:
                programs[channel] = body[0]
            elif kind == 0x9 and body[1]:
                held.setdefault((channel, body[0]), []).append((tick, body[1], programs[channel]))
            elif kind in (0x8, 0x9) and held.get((channel, body[0])):
                begun, velocity, program = held[(channel, body[0])].pop(0)
                notes.append((number, channel, program, body[0], velocity, begun / division, (tick - begun) / division))
        for (channel, pitch), left in held.items():
            notes += [(number, channel, program, pitch, velocity, begun / division, (tick - begun) / division) for begun, velocity, program in left]
    return sorted(notes, key=lambda n: (n[0], n[5], n[3]))


def tempi(data: bytes) -> list[tuple[float, float]]:
    """(time, beats a minute) of each tempo mark."""
    division, tracks = _tracks(data)
    return [
        (tick / division, _MICROSECONDS / int.from_bytes(body[1:], "big")) for t in tracks for tick, status,
        body in _events(t) if status == 0xFF and body[:1] == b"\x51"
    ]


def write(notes: list[tuple[int, float, float, int, int]], bpm: float = 120.0) -> bytes:
    """A file of one track from (pitch, start, duration, velocity, program) in quarters; a channel for each program, of which there are sixteen
    at most.
    """
    programs = {p: c for c, p in enumerate(sorted({n[4] for n in notes}))}
    if len(programs) > 16:
        raise ValueError("more than sixteen programs")
    events = [(0, 0, b"\xff\x51\x03" + round(_MICROSECONDS / bpm).to_bytes(3, "big"))] + [(0, 1, bytes([0xC0 | c, p])) for p, c in programs.items()]
    for pitch, start, duration, velocity, program in notes:
        begin, end = round(start * TICKS), round((start + duration) * TICKS)
        events += [(begin, 3, bytes([0x90 | programs[program], pitch, velocity])), (end, 2, bytes([0x80 | programs[program], pitch, 0]))]
    body, before = b"", 0
    for tick, _, event in sorted(events, key=lambda e: e[:2]):
        body += _variable(tick - before) + event
        before = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS) + b"MTrk" + struct.pack(">I", len(body)) + body


def with_tempo(data: bytes, bpm: float = 120.0) -> bytes:
    """The same file with every tempo mark set to one tempo; notes, and texts that look like a mark, are unchanged."""
    mark, out = round(_MICROSECONDS / bpm).to_bytes(3, "big"), bytearray(data)
    for begin, end in _track_places(data)[1]:
        for _, status, kind, a, b in _spans(data[begin:end]):
            if status == 0xFF and kind == b"\x51" and b - a == 3:
                out[begin + a : begin + b] = mark
    return bytes(out)


def normalized_tempo(contents: DataFrame, bpm: float = 120.0, name_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """(file, content, marks, error): files given as rows (name, bytes) with every tempo mark set to one tempo, and how many they have. A file that cannot
    be read stays as it is, with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["file"], frame["data"]):
                try:
                    rows.append((name, with_tempo(bytes(data), bpm), len(tempi(bytes(data))), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((name, bytes(data), None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["file", "content", "marks", "error"]).astype({"marks": "Int64"})

    return contents.select(F.col(name_col).cast("string").alias("file"), F.col(bytes_col).alias("data")).mapInPandas(run, "file string, content binary, marks int, error string")


def notes_of(contents: DataFrame, name_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """NOTES of files given as rows (name, bytes); a file that cannot be read is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NOTES.split(", ")]
        for frame in frames:
            for name, data in zip(frame["file"], frame["data"]):
                try:
                    rows = [(name, *n, None) for n in parse(bytes(data))]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(name, *[None] * 7, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("track", "channel", "program", "pitch", "velocity")})

    return contents.select(F.col(name_col).cast("string").alias("file"), F.col(bytes_col).alias("data")).mapInPandas(run, NOTES)


def read(spark: SparkSession, folder: str, pattern: str = "*.mid*") -> DataFrame:
    """NOTES of all files under a folder."""
    return notes_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def files_of(notes: DataFrame, by: str = "piece_id", bpm: float = 120.0) -> DataFrame:
    """(by, content): a MIDI file for each group of notes (pitch, start, duration, and velocity and program where there are such columns)."""
    velocity = F.col("velocity").cast("int") if "velocity" in notes.columns else F.lit(64)
    program = F.col("program").cast("int") if "program" in notes.columns else F.lit(0)
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("start").cast("double").alias("start"), "pitch", F.col("duration").cast("double").alias("duration"), velocity.alias("velocity"),
                program.alias("program")
            )
        )
    ).alias("notes")
    kind = notes.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [
                write([(int(n["pitch"]), n["start"], n["duration"], int(n["velocity"]), int(n["program"])) for n in ns], bpm) for ns in frame["notes"]
            ]
            yield pd.DataFrame({by: frame[by], "content": made})

    return notes.groupBy(by).agg(listed).mapInPandas(run, f"{by} {kind}, content binary")
