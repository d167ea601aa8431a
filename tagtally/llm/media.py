"""Audio columns: lossless 8-bit samples, and features computed from the bytes that were stored.

A clip is a WAV file of unsigned 8-bit mono samples at 16 kHz. Features are computed from what the file holds:

* polyphase resampling to 8 kHz: the two phases of a windowed-sinc low-pass filter run at the low rate;
* log-mel filterbanks over frames of 256 samples that overlap by half, with a Hann window and 32 bands;
* segmentation by energy with hysteresis: a segment opens where a frame's level passes the upper threshold and
  lasts while frames stay over the lower one; thresholds stand relative to the clip's own mean level.

Rows carry fixed-shape tensors: each clip's mel frames come in tiles of ``TILE`` frames x ``BANDS`` bands (the
last tile is padded with zeros, its count of frames stands beside it) with the time span of each tile in seconds.
Each clip's tiles, spans and levels are written as one Arrow stream whose tensor columns are fixed-shape tensors, and
the features of ``digests`` are computed from that stream, read back; ``write_tensors`` stores such streams.

A long clip is resampled, framed and transformed in runs of ``RUN`` frames, and its tiles go to the stream run by
run, so memory beyond the clip's own bytes and its tiles (half as much) is bounded, and a clip's values depend on its
bytes alone, not on the batch it comes in. A text of Spark is shorter than 2 GiB, within the 4 GiB of the format.

Defined results: a null or empty text is a payload of 64 zero bytes; a silent clip has no segments; repeated rows
and equal texts have equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagtally.llm._common import bounded_batches

RATE, LOW_RATE = 16_000, 8_000
FRAME, HOP, BANDS, TILE = 256, 128, 32, 64
TAPS = 16  # of each phase
UPPER, LOWER = 1.25, 0.8
RUN = 2048  # frames that are resampled and transformed at a time, a multiple of TILE

_HEAD = "<4sI4s4sIHHIIHH4sI"


def padded(data: bytes, unit: int = 64) -> bytes:
    """Bytes with zeros appended up to a positive multiple of ``unit``."""
    return data + bytes(unit - len(data) % unit if len(data) % unit or not data else 0)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload; a file of 4 GiB or more cannot be stored so."""
    n = len(payload)
    head = struct.pack(_HEAD, b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + bytes(n % 2)


def from_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and unsigned 8-bit samples of a WAV file, chunk by chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            if rate is None:
                raise ValueError("no format before the samples")
            return rate, np.frombuffer(data, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def low_pass(taps: int = 2 * TAPS) -> np.ndarray:
    """Windowed sinc with its cutoff at a quarter of the input rate; unit gain at zero."""
    k = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(k / 2) * np.hamming(taps)
    return (h / h.sum()).astype(np.float32)


def resample(samples: np.ndarray, h: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples ``first`` to ``last`` at half the rate by polyphase filtering: even and odd samples meet the even and odd taps.

    What stands before and after the input counts as zeros.
    """
    last = low_length(len(samples), len(h)) if last is None else last
    begin, end = 2 * first - (len(h) - 1), 2 * last
    x = np.zeros(end - begin + 1, np.float32)
    lo, hi = max(0, begin), min(len(samples), end)
    x[lo - begin : hi - begin] = samples[lo:hi]
    even, odd = np.ascontiguousarray(x[0::2]), np.ascontiguousarray(x[1::2])
    r, n = h[::-1], last - first
    return (np.convolve(even, r[0::2][::-1], "valid")[:n] + np.convolve(odd, r[1::2][::-1], "valid")[:n]).astype(np.float32)


def low_length(n: int, taps: int) -> int:
    """Samples at half the rate of ``n`` samples."""
    return (taps - 1 + n + n % 2 + 1) // 2 - taps // 2 + 1


def mel_filters(size: int = FRAME, bands: int = BANDS, rate: int = LOW_RATE) -> np.ndarray:
    """Triangles over the bins of a transform, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.arange(size // 2 + 1) * rate / size
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(np.minimum(up, down), 0).astype(np.float32)


class Features:
    """Tables of the transform, and the features of one clip."""

    def __init__(self):
        self.filter, self.mel = low_pass(), mel_filters()
        self.window = np.hanning(FRAME + 1)[:-1].astype(np.float32)

    def runs(self, samples: np.ndarray):
        """Yield ``(log-mel frames, levels)`` of a clip run by run; a clip has at least one frame."""
        length = low_length(len(samples), len(self.filter))
        n = max(1, -(-(length - FRAME) // HOP) + 1)
        for k in range(0, n, RUN):
            m = min(RUN, n - k)
            first, last = k * HOP, (k + m - 1) * HOP + FRAME
            x = np.zeros(last - first, np.float32)
            lo, hi = 2 * first - len(self.filter), 2 * last
            # The clip's samples that the run's filter reaches, as numbers from -1 to 1.
            part = (samples[max(0, lo) : hi].astype(np.float32) - 128) / 128
            shift = max(0, lo) // 2
            x[: min(last, length) - first] = resample(part, self.filter, first - shift, min(last, length) - shift)
            run = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * self.window
            spectrum = np.fft.rfft(run, axis=1)
            power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
            yield np.log(power @ self.mel + np.float32(1e-6)).astype(np.float32), np.einsum("ij,ij->i", run, run) / FRAME

    def frames(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel frames (frames x bands) and their levels (mean power)."""
        mel, level = zip(*self.runs(samples))
        return np.concatenate(mel), np.concatenate(level)

    @staticmethod
    def segments(level: np.ndarray) -> list[tuple[int, int]]:
        """Runs of frames (first, end) by hysteresis around the clip's mean level."""
        mean = float(level.mean())
        if mean <= 1e-9:
            return []
        over, opens = level >= LOWER * mean, level >= UPPER * mean
        edge = np.flatnonzero(np.diff(np.concatenate([[0], over.astype(np.int8), [0]])))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return []
        hit = np.add.reduceat(np.append(opens, False).astype(np.int64), np.ravel(np.column_stack([starts, ends])))[0::2] > 0
        return list(zip(starts[hit].tolist(), ends[hit].tolist()))

    def stream(self, stored: list[bytes]) -> pa.Buffer:
        """The tensors of stored clips as an Arrow stream: a row for each tile, with clip, frames and time span."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, TENSORS) as out:
            held: list[list] = [[], [], [], [], []]
            size = 0
            for i, data in enumerate(stored):
                at = 0
                for mel, level in self.runs(from_wav(data)[1]):
                    tiles = -(-len(mel) // TILE)
                    full = np.zeros((tiles * TILE, BANDS), np.float32)
                    full[: len(mel)] = mel
                    levels = np.zeros(tiles * TILE, np.float64)
                    levels[: len(level)] = level
                    held[0].append(np.full(tiles, i))
                    held[1].append(np.arange(at // TILE, at // TILE + tiles))
                    held[2].append(np.minimum(len(mel) - TILE * np.arange(tiles), TILE))
                    held[3].append(full)
                    held[4].append(levels)
                    at += len(mel)
                    size += tiles
                    if size >= RUN // TILE * 4:
                        out.write_batch(_tile_batch(held))
                        held, size = [[], [], [], [], []], 0
            if size:
                out.write_batch(_tile_batch(held))
        return sink.getvalue()


def _seconds(frame):
    return frame * HOP / LOW_RATE


_MEL = pa.fixed_shape_tensor(pa.float32(), [TILE, BANDS], dim_names=["frame", "band"])
_LEVEL = pa.fixed_shape_tensor(pa.float64(), [TILE], dim_names=["frame"])
TENSORS = pa.schema([("clip", pa.int64()), ("tile", pa.int64()), ("tile_frames", pa.int32()), ("start_seconds", pa.float64()), ("end_seconds", pa.float64()), ("mel", _MEL), ("level", _LEVEL)])


def _tensor(kind, values: np.ndarray, width: int) -> pa.Array:
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), width))


def _tile_batch(held: list[list]) -> pa.RecordBatch:
    clip, tile, frames, mel, level = map(np.concatenate, held)
    arrays = [pa.array(clip), pa.array(tile), pa.array(frames.astype(np.int32)), pa.array(_seconds(tile * TILE)), pa.array(_seconds(tile * TILE + frames)), _tensor(_MEL, mel, TILE * BANDS), _tensor(_LEVEL, level, TILE)]
    return pa.RecordBatch.from_arrays(arrays, schema=TENSORS)


def read_stream(data, clips: int) -> list[dict]:
    """Of each clip of a stream the tiles (tiles x TILE x BANDS), their frames, spans, levels and segments."""
    batches = pa.ipc.open_stream(data).read_all().combine_chunks()
    column = lambda c: batches[c].combine_chunks()
    own, frames = column("clip").to_numpy(), column("tile_frames").to_numpy()
    mel = column("mel").storage.flatten().to_numpy(zero_copy_only=False).reshape(-1, TILE, BANDS)
    level = column("level").storage.flatten().to_numpy(zero_copy_only=False).reshape(-1, TILE)
    start, end = column("start_seconds").to_numpy(), column("end_seconds").to_numpy()
    out = []
    for i in range(clips):
        lo, hi = np.searchsorted(own, i), np.searchsorted(own, i, "right")
        n = int(frames[lo:hi].sum())
        levels = level[lo:hi].ravel()[:n]
        out.append({"tiles": mel[lo:hi], "frames": frames[lo:hi], "mel": mel[lo:hi].reshape(-1, BANDS)[:n], "level": levels, "start": start[lo:hi], "end": end[lo:hi], "segments": Features.segments(levels)})
    return out


def _summary(clip: dict) -> str:
    """Frames, segments, and a digest of the segments and of the band means and spreads in hundredths."""
    mel = clip["mel"]
    mean = sum(mel[k : k + RUN].sum(0, dtype=np.float64) for k in range(0, len(mel), RUN)) / len(mel)
    spread = np.sqrt(sum(((mel[k : k + RUN] - mean) ** 2).sum(0) for k in range(0, len(mel), RUN)) / len(mel))
    rounded = np.round(np.concatenate([mean, spread]) * 100).astype("<i4")
    spans = np.array(clip["segments"], "<i8").tobytes()
    return f"{len(mel)}:{len(clip['segments'])}:{hashlib.sha256(rounded.tobytes() + spans).hexdigest()[:32]}"


_FORMS = {
    "digests": "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    "tensors": "media binary, tile long, tile_frames int, start_seconds double, end_seconds double, mel array<float>, segments array<struct<start_seconds:double,end_seconds:double>>",
}


def _applied(docs: DataFrame, form: str, id_column: str, text_column: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    spans = pa.list_(pa.struct([("start_seconds", pa.float64()), ("end_seconds", pa.float64())]))

    def run(batches):
        made = Features()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 256):
                raw = [(t.as_py() or "").encode() for t in texts[k : k + 256]]
                stored = [to_wav(padded(data)) for data in raw]
                clips = read_stream(made.stream(stored), len(stored))
                rows, picked = [], []
                for i, (data, media, clip) in enumerate(zip(raw, stored, clips)):
                    if form == "digests":
                        back = from_wav(media)[1].tobytes()
                        rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _summary(clip)))
                        picked.append(k + i)
                        continue
                    cut = [{"start_seconds": _seconds(a), "end_seconds": _seconds(b)} for a, b in clip["segments"]]
                    for t, tile in enumerate(clip["tiles"]):
                        rows.append((media if t == 0 else None, t, int(clip["frames"][t]), float(clip["start"][t]), float(clip["end"][t]), tile.ravel(), cut if t == 0 else None))
                        picked.append(k + i)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if form == "digests" else [pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()), spans]
                names = [x.split(" ")[0] for x in _FORMS[form].split(", ")]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(picked, pa.int64())), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]], [id_column, *names])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {_FORMS[form]}")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: sizes and digests of the payload read back and of the stored form, and a string of its features."""
    return _applied(docs, "digests", id_column, text_column)


def tensors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of tiles: a ``TILE`` x ``BANDS`` tensor each, with time spans; the first of a clip has the stored file
    and the clip's segments."""
    return _applied(docs, "tensors", id_column, text_column)


def tensor_table(rows: pa.Table) -> pa.Table:
    """The rows of ``tensors`` with ``mel`` as an Arrow fixed-shape-tensor column."""
    flat = rows["mel"].combine_chunks()
    at = rows.schema.get_field_index("mel")
    return rows.set_column(at, pa.field("mel", _MEL), _tensor(_MEL, flat.flatten().to_numpy(), TILE * BANDS))


def write_tensors(rows: DataFrame, folder: str) -> DataFrame:
    """Write Arrow IPC streams of the tensors as rows ``part, arrow`` under ``folder`` and return them re-read.

    Each row is one bounded stream whose schema holds the fixed-shape tensor; Spark stores it as binary, so any
    file system that Spark knows will do.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                table = tensor_table(pa.Table.from_batches([batch.slice(k, 512)]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows", "arrow"])

    rows.mapInArrow(run, "rows long, arrow binary").write.mode("errorifexists").parquet(folder)
    return rows.sparkSession.read.parquet(folder)
