"""Chroma audio fingerprints and the alignment of recordings.

A media column holds mono 16-bit PCM. Overlapping frames are folded into twelve pitch classes; rectangle filters over the
image of frames by pitch classes, each a few look-ups in its integral image, compare sums of neighbouring areas; each gives two
bits and sixteen make a packed 32-bit integer for each frame position.

Alignment: recordings with equal fingerprints form a class. A stated set of queries is held against all classes, in blocks of a bounded
size. A block's index of both halves of its integers (a run of one value counts once) goes to every task; each recording looks its own
halves up, equal halves vote for an offset, and every offset with a vote is verified by the share of differing bits over the whole overlap. At
``MOST_ERRORS`` independent errors a position gives a vote with probability 0.14, so 25 positions are missed altogether with 0.02. Where either
recording has ``SHORT`` positions or fewer, every offset is tried instead. Votes are expanded ``CHUNK`` at a time: a key that is common in
both costs time, not memory. Each block's links are written before the next block is collected.

Edge cases: null, empty, silent or too short recordings have an empty fingerprint and form one class without links; an odd last byte is
ignored; repeated rows share a class; a row without a key takes the class of its fingerprint; other columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, table

RATE = 4000
FRAME = 512
HOP = 384
SPAN = 16  # frames under a filter
PITCHES = 12
LOWEST, HIGHEST = 55.0, 1760.0
SILENCE = 1e-3
KEY_BITS = 16  # two halves of each integer
SHORT = 24
CHUNK = 1 << 20
MOST_ERRORS = 0.15
LEAST_OVERLAP = 0.5
QUERY_STEP = 100
#: Positions of all queries in one block: its index takes some 50 MB.
BLOCK_POSITIONS = 4_000_000


def _fold() -> np.ndarray:
    """Weights that send spectrum bins to pitch classes; a bin between two classes goes to both in part."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), PITCHES))
    for k, f in enumerate(hz):
        if LOWEST <= f <= HIGHEST:
            pitch = 12 * np.log2(f / 440.0) + 69
            low = int(np.floor(pitch))
            out[k, low % PITCHES] += 1 - (pitch - low)
            out[k, (low + 1) % PITCHES] += pitch - low
    return out


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, height and width of each filter, by rule: four kinds at four places, heights and widths that vary with the place."""
    return [(kind, 3 * place, (3, 6, 4, 8)[place], (16, 8, 12, 4)[(place + kind) % 4]) for place in range(4) for kind in range(4)]


FOLD, FILTERS = _fold(), _filters()
_WINDOW = np.hanning(FRAME)
#: Two-bit codes of which neighbours differ in one bit.
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
_STEPS = np.array([-0.12, 0.0, 0.12])


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, each frame scaled to length one; quiet frames are zero."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) @ FOLD
    norm = np.linalg.norm(power, axis=1, keepdims=True)
    return np.where(norm > SILENCE * FRAME, power / np.maximum(norm, 1e-12), 0.0)


def _areas(image: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each filter the two sums it compares, at every frame position; pitch classes wrap around."""
    n = len(image) - SPAN + 1
    total = np.zeros((len(image) + 1, 2 * PITCHES + 1))
    total[1:, 1:] = np.concatenate([image, image], axis=1).cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        rows = lambda t: total[t : t + n]
        return rows(t1)[:, p1] - rows(t0)[:, p1] - rows(t1)[:, p0] + rows(t0)[:, p0]

    out = []
    for kind, p, h, w in FILTERS:
        t, half_t, half_p = (SPAN - w) // 2, w // 2, h // 2
        if kind == 0:  # one area against the pitches above it
            a, b = area(t, t + w, p, p + half_p), area(t, t + w, p + half_p, p + h)
        elif kind == 1:  # before against after
            a, b = area(t, t + half_t, p, p + h), area(t + half_t, t + w, p, p + h)
        elif kind == 2:  # two corners against the other two
            a = area(t, t + half_t, p, p + half_p) + area(t + half_t, t + w, p + half_p, p + h)
            b = area(t, t + w, p, p + h) - a
        else:  # the middle against both sides in time
            q = max(w // 4, 1)
            a = area(t + q, t + w - q, p, p + h)
            b = area(t, t + w, p, p + h) - a
        out.append((a, b))
    return out


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Packed 32-bit integers of a recording."""
    pcm = pcm or b""
    samples = np.frombuffer(pcm[: len(pcm) // 2 * 2], dtype="<i2") / 32768.0
    image = chroma(samples)
    if len(image) < SPAN or not image.any():
        return np.zeros(0, dtype=np.uint32)
    out = np.zeros(len(image) - SPAN + 1, dtype=np.uint32)
    for a, b in _areas(image):
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(_STEPS, value)]
    return out


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits, and the overlap, when ``a``'s position i meets ``b``'s position i + offset."""
    first, last = max(0, -offset), min(len(a), len(b) - offset)
    if last <= first:
        return 1.0, 0
    return float(np.bitwise_count(a[first:last] ^ b[first + offset : last + offset]).sum()) / (32 * (last - first)), last - first


def fingerprints(df: DataFrame, key: str, media: str) -> DataFrame:
    """``key, fp`` (packed little-endian integers) and ``mark``, a hash of the fingerprint."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py()).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array([hashlib.sha256(x).digest() for x in fps], pa.binary())], names=[key, "fp", "mark"])

    return df.select(key, media).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp binary, mark binary")


def align(prints: DataFrame, key: str, is_query) -> tuple[DataFrame, DataFrame]:
    """Classes ``mark, cid, class_id, query`` and links ``one, other, offset, votes, bit_errors`` (by ``cid``) from classes with a query to other classes.

    ``offset``: position in ``other`` less position in ``one``.
    """
    classes = prints.groupBy("mark").agg(F.min(key).alias("class_id"), F.max(F.coalesce(is_query, F.lit(False))).alias("query"), F.first("fp").alias("fp"))
    # a number for each class: its least key, or a hash where no row has a key
    classes = materialise(classes.withColumn("cid", F.coalesce(F.col("class_id").cast("long"), F.xxhash64("mark"))), "audio-classes")

    asked = classes.where("query")
    size = asked.agg(F.sum(F.octet_length("fp"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_POSITIONS)))
    path = scratch_path(classes.sparkSession, "audio-links")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == block).select("cid", "fp").collect()
        held = classes.sparkSession.sparkContext.broadcast(Block.of(rows))
        _against(classes, held).write.mode("append").parquet(path)
        held.destroy()
    return classes.drop("fp"), classes.sparkSession.read.schema(LINK).parquet(path)


LINK = "one long, other long, offset int, votes int, bit_errors double"


class Block(NamedTuple):
    """Queries of one block as arrays."""

    cids: np.ndarray
    prints: list[np.ndarray]
    index: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: np.ndarray
    track: Track

    @classmethod
    def of(cls, rows: list) -> Block:
        prints = [np.frombuffer(bytes(r["fp"]), dtype="<u4") for r in rows]
        short = np.array([i for i, x in enumerate(prints) if 0 < len(x) <= SHORT], dtype=np.int64)
        return cls(np.array([r["cid"] for r in rows], dtype=np.int64), prints, [_index(prints, half) for half in range(2)], short, _track(prints))


class Track(NamedTuple):
    """Fingerprints end to end; gaps of ``SHORT`` positions before, between and after them are not ``valid``."""

    values: np.ndarray
    valid: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def _track(prints: list[np.ndarray]) -> Track:
    sizes = np.array([len(x) for x in prints], dtype=np.int64)
    starts = SHORT + np.cumsum(sizes + SHORT) - sizes - SHORT
    values, valid = np.zeros(SHORT + int((sizes + SHORT).sum()), dtype=np.uint32), np.zeros(SHORT + int((sizes + SHORT).sum()), dtype=bool)
    for x, at in zip(prints, starts.tolist(), strict=True):
        values[at : at + len(x)], valid[at : at + len(x)] = x, True
    return Track(values, valid, starts, sizes)


def _against(classes: DataFrame, held) -> DataFrame:
    """Links between the broadcast block of queries and all classes."""

    def run(batches):
        for batch in batches:
            block = held.value
            out = [
                (int(block.cids[q]), cid, offset, votes, share)
                for cid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for q, offset, votes, share in _matches(np.frombuffer(body, dtype="<u4"), block)
                if block.cids[q] != cid
            ]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in LINK.split(", ")])

    return classes.select("cid", "fp").mapInArrow(run, LINK)


def _keys(fp: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """One half of each integer, at the first position of each run of equal ones."""
    k = ((fp >> np.uint32(KEY_BITS * half)) & np.uint32((1 << KEY_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], first


def _index(prints: list[np.ndarray], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of all queries that are not short, with their query's number and position."""
    parts = [_keys(x if len(x) > SHORT else x[:0], half) for x in prints]
    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, dtype=np.int64)])
    order = np.argsort(keys, kind="stable")
    owner = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    at = np.concatenate([p for _, p in parts] or [np.zeros(0, dtype=np.int64)])
    return keys[order], owner[order].astype(np.int32), at[order].astype(np.int32)


def _voted(fp: np.ndarray, block: Block):
    """Chunks of ``(query, offset, votes)`` arrays: what equal halves vote for."""
    for half, (keys, owner, at) in enumerate(block.index):
        k, pos = _keys(fp, half)
        low = np.searchsorted(keys, k)
        ends = np.cumsum(np.searchsorted(keys, k, side="right") - low)
        for start in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            hit = np.arange(start, min(start + CHUNK, int(ends[-1])))
            i = np.searchsorted(ends, hit, side="right")
            rows = low[i] + hit - np.where(i > 0, ends[i - 1], 0)
            code, votes = np.unique((owner[rows].astype(np.int64) << 32) + (pos[i] - at[rows] + (1 << 31)), return_counts=True)
            yield code >> 32, (code & 0xFFFFFFFF) - (1 << 31), votes


def _shares(fp: np.ndarray, block: Block, q: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Share of differing bits over the whole overlap of each query and offset; 1 where they overlap too little."""
    n = block.track.sizes[q]
    first, last = np.maximum(0, -offset), np.minimum(n, len(fp) - offset)
    size, out = last - first, np.ones(len(q))
    todo = np.flatnonzero((size > 0) & (size >= LEAST_OVERLAP * np.minimum(n, len(fp))))
    cuts = np.cumsum(size[todo]) // CHUNK  # about CHUNK positions at once, or one overlap
    for part in np.split(todo, np.flatnonzero(np.diff(cuts)) + 1):
        if len(part):
            begin = np.cumsum(size[part]) - size[part]
            mine = np.arange(int(size[part].sum())) + np.repeat(first[part] - begin, size[part])
            bits = np.bitwise_count(block.track.values[mine + np.repeat(block.track.starts[q[part]], size[part])] ^ fp[mine + np.repeat(offset[part], size[part])])
            out[part] = np.add.reduceat(bits, begin, dtype=np.int64) / (32 * size[part])
    return out


def _everywhere(prints: list[np.ndarray], track: Track):
    """For short ``prints``, each offset against a track at which they match: arrays of print, number on the track, its position less the print's, share."""
    wide = len(track.values) - SHORT + 1
    step = max(1, CHUNK // wide)
    for base in range(0, len(prints), step):
        some = prints[base : base + step]
        own = np.array([len(x) for x in some])
        wrong, size = np.zeros((len(some), wide), dtype=np.int32), np.zeros((len(some), wide), dtype=np.int32)
        for i in range(int(own.max())):
            value, has = np.array([x[i] if i < len(x) else 0 for x in some], dtype=np.uint32), i < own
            both = has[:, None] & track.valid[None, i : i + wide]
            wrong += np.bitwise_count(value[:, None] ^ track.values[None, i : i + wide]) * both
            size += both
        # gaps are as wide as a print, so it meets one recording at a time: the last to start before its end
        at, s = np.nonzero((size > 0) & (wrong <= MOST_ERRORS * 32 * size))
        met = np.searchsorted(track.starts, s + own[at] - 1, side="right") - 1
        good = size[at, s] >= LEAST_OVERLAP * np.minimum(own[at], track.sizes[met])
        at, s, met = at[good], s[good], met[good]
        yield at + base, met, s - track.starts[met], wrong[at, s] / (32 * size[at, s])


def _matches(fp: np.ndarray, block: Block) -> list[tuple[int, int, int, float]]:
    """Queries that a recording matches: number, offset, votes (0 where every offset was tried) and share of differing bits.

    Of several offsets the one with most votes, then fewest errors, then nearest to zero, then least.
    """
    best: dict[int, dict[int, tuple[int, float]]] = {}
    if 0 < len(fp) <= SHORT:
        found = [(q, -at, np.zeros(len(q), dtype=np.int64), share) for _, q, at, share in _everywhere([fp], block.track)] if len(block.track.starts) else []
    elif len(fp):
        found = ((q, at, votes, _shares(fp, block, q, at)) for q, at, votes in _voted(fp, block))
        tried = _everywhere([block.prints[i] for i in block.short], _track([fp]))
        found = chain(found, ((block.short[p], at, np.zeros(len(p), dtype=np.int64), share) for p, _, at, share in tried))
    else:
        found = []
    for q, at, votes, share in found:
        good = share <= MOST_ERRORS
        for i, o, v, e in zip(q[good].tolist(), at[good].tolist(), votes[good].tolist(), share[good].tolist(), strict=True):
            kept = best.setdefault(i, {})
            kept[o] = (kept.get(o, (0, e))[0] + v, e)
    chosen = ((q, min(offsets, key=lambda o: (-offsets[o][0], offsets[o][1], abs(o), o)), offsets) for q, offsets in sorted(best.items()))
    return [(q, o, offsets[o][0], offsets[o][1]) for q, o, offsets in chosen]


def render(values, note: int = 768) -> bytes:
    """A tune from numbers: each is a tone of ``note`` samples, its pitch follows from the value; two partials, soft borders."""
    x = np.nan_to_num(np.asarray(values if values is not None else [], dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    if not len(x):
        return b""
    pitch = 45 + np.round(np.clip(x, -1, 1) * 96).astype(np.int64) % 36  # a unit vector's entries are small
    t = np.arange(note) / RATE
    hz = 440.0 * 2.0 ** ((pitch - 69) / 12.0)
    wave = 0.6 * np.sin(2 * np.pi * hz[:, None] * t) + 0.2 * np.sin(4 * np.pi * hz[:, None] * t)
    edge = np.minimum(1.0, np.minimum(np.arange(note), np.arange(note)[::-1]) / 40.0)
    return (wave * edge * 32000).astype("<i2").tobytes()


def op3_chroma_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a tune; rows whose id is divisible by 100 are aligned with all rows.

    One row for each vector with its class; the rows of a queried class's representative carry one link each.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def play(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.binary())], names=["vec_id", "media"])

    media = rows.mapInArrow(play, "vec_id long, media binary")
    prints = materialise(fingerprints(media, "vec_id", "media"), "audio-prints")
    classes, links = align(prints, "vec_id", F.col("vec_id") % QUERY_STEP == 0)
    names = classes.select("mark", "cid", "class_id", "query")
    named = links.join(names.select(F.col("cid").alias("other"), F.col("class_id").alias("match_class")), "other")
    members = prints.select("vec_id", "mark").join(names, "mark")
    carried = members.withColumn("one", F.when(F.col("vec_id") == F.col("class_id"), F.col("cid")))
    return carried.join(named, "one", "left").select("vec_id", "class_id", F.col("query").alias("queried"), "match_class", "offset", "votes", "bit_errors")


QUERIES = {"op3_chroma_align": op3_chroma_align}
ORACLES: dict[str, str] = {}
