"""Copies among images in a binary column, cropped or edited ones included.

Local descriptors: at several scales corners are found, each is turned by the direction of its
patch's intensity centroid, and 128 brightness comparisons around it become a binary descriptor.
Descriptors meet in Hamming tables, one for each two of five parts of their bits: two that differ in
at most ``SEED_BITS`` agree in two parts, so all such pairs of corners meet, and images with such a
pair are candidates.  A candidate is settled by geometric consensus over all corners of both images: of the
matches within ``max_bits``, ``min_agree`` places must fit the shift, turn and scale that one of
them tells.  Images of equal bytes are one image from the start, and crowded table entries are
settled in rounds of hubs (``rounds``), so a class of copies costs its size and no pair is left out.

Media are binary PGM (P5) or 8-bit PNG (not interlaced).  Defined results: null, empty, unreadable
or too large media (over ``MOST_PIXELS``) have no corners and are one class with what has the same
bytes; repeated rows share a class; a null image_id names a class only if all its members are null;
ties among copies do not matter, the least image_id names the class; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import read_table
from cloudloom.llm.rounds import link_rounds, meeting
from cloudloom.operators.graph import connected_components, stored

SCALES = (1.0, 0.9, 0.8, 0.7)
RADIUS, TURNS = 8, 32
#: Differing bits up to which all pairs of descriptors meet in the tables, and first bits of the parts, two more than that.
SEED_BITS = 3
EDGES = (0, 26, 52, 78, 103, 128)
MOST_PIXELS = 1 << 26
#: Corners of one table entry beyond which its pairs are not made at once.
CROWD = 64
_rng = np.random.default_rng(17)
_ENDS = _rng.normal(0, RADIUS / 2, (128, 2, 2))
#: Both ends of each comparison, inside the disc in every direction.
_TESTS = (_ENDS * np.minimum(1, (RADIUS - 0.5) / np.linalg.norm(_ENDS, axis=2, keepdims=True))).reshape(128, 4)


def _turned() -> np.ndarray:
    """Offsets (y1, x1, y2, x2) of the comparisons for each of ``TURNS`` directions."""
    out = np.zeros((TURNS, 128, 4), np.int64)
    for k in range(TURNS):
        c, s = np.cos(2 * np.pi * k / TURNS), np.sin(2 * np.pi * k / TURNS)
        for a in (0, 2):
            y, x = _TESTS[:, a], _TESTS[:, a + 1]
            out[k, :, a], out[k, :, a + 1] = np.rint(s * x + c * y), np.rint(c * x - s * y)
    return out


TURNED = _turned()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2) <= RADIUS**2


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey image, 0 to 255, of PGM or PNG bytes; None if it can't be read."""
    try:
        if not media:
            return None
        if media[:2] == b"P5":
            m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", media)
            w, h, top = int(m[1]), int(m[2]), int(m[3])
            if w * h > MOST_PIXELS or not 0 < top < 65536:
                return None
            pixels = np.frombuffer(media, np.uint8 if top < 256 else ">u2", w * h, m.end())
            return pixels.reshape(h, w).astype(np.float32) * np.float32(255 / top)
        if media[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(media)
    except (TypeError, ValueError, KeyError, IndexError, MemoryError, zlib.error):
        return None
    return None


def _png(media: bytes) -> np.ndarray | None:
    at, data, head = 8, [], b""
    while at + 8 <= len(media):
        size, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    if head[8] != 8 or head[12] or w * h > MOST_PIXELS:
        return None
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), h * (1 + w * n)), np.uint8).reshape(h, 1 + w * n)
    up, rows = np.zeros(w * n, np.uint8), []
    for line in raw:
        up = _unfiltered(int(line[0]), line[1:], up, n)
        rows.append(up)
    px = np.stack(rows).reshape(h, w, n)[:, :, : 3 if n > 2 else 1].astype(np.float32)
    return px @ np.array([0.299, 0.587, 0.114], np.float32) if n > 2 else px[:, :, 0]


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    """A PNG line of ``n`` bytes a pixel, from its filtered bytes and the line above."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + up
    out, above = bytearray(n), bytes(n) + up.tobytes()
    for x, v in enumerate(line.tolist()):
        a, b, c = out[x], above[x + n], above[x]
        if kind == 3:
            guess = (a + b) // 2
        elif kind == 4:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        else:
            raise ValueError(kind)
        out.append((v + guess) & 255)
    return np.frombuffer(bytes(out[n:]), np.uint8)


def pgm(image: np.ndarray) -> bytes:
    """PGM bytes of a grey image."""
    g = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (g.shape[1], g.shape[0]) + g.tobytes()


def _blur(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="edge")
    rows = p[:-2] + p[1:-1] + p[2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9


def _resize(g: np.ndarray, s: float) -> np.ndarray:
    if s == 1:
        return g
    h, w = max(1, int(g.shape[0] * s)), max(1, int(g.shape[1] * s))
    y, x = np.minimum((np.arange(h) + 0.5) / s - 0.5, g.shape[0] - 1), np.minimum((np.arange(w) + 0.5) / s - 0.5, g.shape[1] - 1)
    y0, x0 = np.clip(y.astype(int), 0, max(0, g.shape[0] - 2)), np.clip(x.astype(int), 0, max(0, g.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (g[y0][:, x0] * (1 - fy) * (1 - fx) + g[y0][:, x1] * (1 - fy) * fx + g[y1][:, x0] * fy * (1 - fx) + g[y1][:, x1] * fy * fx).astype(np.float32)


def describe(image: np.ndarray | None) -> list[tuple[float, float, float, int, int, int]]:
    """(x, y, scale, turn, low bits, high bits) of every corner, in the image's own pixels."""
    out: list[tuple[float, float, float, int, int, int]] = []
    if image is None or min(image.shape) < 2 * RADIUS + 6:
        return out
    for scale in SCALES:
        g = _blur(_resize(image, scale))
        h, w = g.shape
        if min(h, w) < 2 * RADIUS + 6:
            continue
        gy, gx = np.gradient(g)
        xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        inner = r[m : h - m, m : w - m]
        near = np.max([r[m + a : h - m + a, m + b : w - m + b] for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)], 0)
        y, x = np.nonzero((inner >= near) & (inner > 1.0))
        if not len(y):
            continue
        y, x = y + m, x + m
        patch = g[y[:, None, None] + _GRID[0], x[:, None, None] + _GRID[1]] * _DISC
        turn = np.rint(np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2))) / (2 * np.pi) * TURNS).astype(int) % TURNS
        t = TURNED[turn]
        bits = g[y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]] < g[y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
        words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        out += [((a + 0.5) / scale, (b + 0.5) / scale, scale, int(c), int(d[0]), int(d[1])) for a, b, c, d in zip(x, y, turn, words, strict=True)]
    return out


def pack(found: list[tuple[float, float, float, int, int, int]]) -> np.ndarray:
    """Three longs a corner: place in sixteenths of a pixel, scale and turn; low bits; high bits."""
    return np.array([(round(x * 16) << 40 | round(y * 16) << 16 | SCALES.index(s) << 8 | t, lo, hi) for x, y, s, t, lo, hi in found], np.int64).ravel()


def corners(images: DataFrame) -> DataFrame:
    """(image_id, digest, corners) of each row (image_id, media); corners are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [m.as_py() or b"" for m in batch.column(1)]
            digests = [hashlib.blake2b(m, digest_size=16).digest() for m in media]
            known: dict[bytes, np.ndarray] = {}
            for d, m in zip(digests, media, strict=True):
                if d not in known:
                    known[d] = pack(describe(decode(m)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([known[d] for d in digests], pa.list_(pa.int64()))], names=["image_id", "digest", "corners"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "media").mapInArrow(run, "image_id long, digest binary, corners array<long>")


def table_rows(found: DataFrame) -> DataFrame:
    """(key, node, probe, low, high) for each different corner of (node, corners) and each two parts of its bits; key tells the parts too."""
    corners = F.transform(F.sequence(F.lit(0), F.size("corners") - 1, F.lit(3)), lambda k: F.struct(F.col("corners")[k + 1].alias("low"), F.col("corners")[k + 2].alias("high")))
    each = found.where(F.size("corners") > 0).select("node", F.inline(F.array_distinct(corners)))
    parts = [(1 << b) - (1 << a) for a, b in pairwise(EDGES)]
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    masks = [(signed(m & (1 << 64) - 1), signed(m >> 64)) for m in map(sum, combinations(parts, len(parts) - SEED_BITS))]
    keys = [F.xxhash64(F.lit(k), F.col("low").bitwiseAND(F.lit(lo)), F.col("high").bitwiseAND(F.lit(hi))) for k, (lo, hi) in enumerate(masks)]
    return each.select(F.explode(F.array(*keys)).alias("key"), "node", F.lit(False).alias("probe"), "low", "high")


def consensus(min_agree: int, max_bits: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Whether places enough of two images' packed corners fit one shift, turn and scale.

    Each match tells a transformation; another agrees if its turn and scale are near and its
    place is where the transformation puts it.  A corner found at several scales is one place.
    """

    def same(a: np.ndarray, b: np.ndarray) -> bool:
        p, q = a.reshape(-1, 3), b.reshape(-1, 3)
        met = []
        for k in range(0, len(p), 512):
            bits = np.bitwise_count(p[k : k + 512, None, 1] ^ q[None, :, 1]) + np.bitwise_count(p[k : k + 512, None, 2] ^ q[None, :, 2])
            i, j = np.nonzero(bits <= max_bits)
            met.append(np.stack((i + k, j)))
        i, j = np.concatenate(met, 1) if met else (np.zeros(0, np.int64),) * 2
        if len(i) < min_agree:
            return False
        place = lambda c: (c >> 40) / 16 + 1j * ((c >> 16 & 0xFFFFFF) / 16)
        scale = lambda c: np.array(SCALES)[c >> 8 & 0xFF]
        cp, cq = p[i, 0], q[j, 0]
        x, y = place(cp), place(cq)
        turn, ratio = (cq - cp & 0xFF) % TURNS, scale(cp) / scale(cq)
        cells = lambda z: np.round(z.real / 6) * (1 << 24) + np.round(z.imag / 6)
        at, to = cells(x), cells(y)
        for k in range(0, len(i), 256):
            one = slice(k, k + 256)
            step = (turn - turn[one, None]) % TURNS
            move = ratio[one] * np.exp(2j * np.pi * turn[one] / TURNS)
            gone = x - x[one, None]
            miss = np.abs(y - y[one, None] - move[:, None] * gone)
            fits = (np.minimum(step, TURNS - step) <= 2) & (np.abs(np.log(ratio / ratio[one, None])) <= 0.2) & (miss <= 3 + 0.15 * np.abs(move[:, None] * gone))
            for row in fits[fits.sum(1) >= min_agree]:
                if min(len(np.unique(at[row])), len(np.unique(to[row]))) >= min_agree:
                    return True
        return False

    return same


def find_copies(images: DataFrame, min_agree: int = 6, max_bits: int = 12) -> DataFrame:
    """image_id, n_corners, class_id (least image_id reachable) and class_size (rows) of each row (image_id, media)."""
    named = stored(corners(images))
    found = named.groupBy("digest").agg(F.min("image_id").alias("image"), F.first("corners").alias("corners"), F.count(F.lit(1)).alias("n"))
    found = stored(found.withColumn("node", F.monotonically_increasing_id()))
    close = lambda p, q: F.bit_count(p("low").bitwiseXOR(q("low"))) + F.bit_count(p("high").bitwiseXOR(q("high"))) <= SEED_BITS
    load = lambda names: found.join(names, "node", "left_semi").select("node", F.col("corners").alias("payload"))
    links = link_rounds(stored(meeting(table_rows(found))), close, load, consensus(min_agree, max_bits), crowd=CROWD)
    rooted = found.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("component", "node"))
    classes = rooted.groupBy("root").agg(F.min("image").alias("class_id"), F.sum("n").alias("class_size"))
    info = rooted.select("digest", (F.size("corners") / 3).cast("long").alias("n_corners"), "root").join(classes, "root").drop("root")
    return named.select("image_id", "digest").join(info, "digest").select("image_id", "n_corners", "class_id", "class_size")


#: Numbers of the longest vector that is drawn, side of a picture, and edits of planted copies.
NUMBERS, SIDE = 4096, 48
EDITS = ("crop", "brightness", "turn", "noise", "smaller", "blur")


def _patterns(n: int) -> np.ndarray:
    """[n, SIDE, SIDE]: a smooth random pattern for each number of a vector."""
    out = np.random.default_rng(5).normal(size=(n, SIDE, SIDE)).astype(np.float32)
    for _ in range(4):
        out = np.stack([_blur(p) for p in out])
    return out


def picture(vector: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """A vector as the sum of its numbers' patterns, so that near vectors are alike all over."""
    g = np.tensordot(vector, patterns[: len(vector)], 1)
    return np.clip(np.rint(128 + 48 * (g - g.mean()) / max(float(g.std()), 1e-9)), 0, 255).astype(np.float32)


def edited(image: np.ndarray, edit: str) -> np.ndarray:
    """A copy of ``image`` after one of ``EDITS``."""
    if edit == "crop":
        return image[3:-5, 5:-3]
    if edit == "brightness":
        return image * 0.8 + 20
    if edit == "turn":
        return np.rot90(image)
    if edit == "noise":
        return image + np.random.default_rng(int(image.sum())).normal(0, 4, image.shape)
    return _resize(image, 0.9) if edit == "smaller" else _blur(image)


def media_from_vectors(vectors: DataFrame, every: int = 50) -> DataFrame:
    """(image_id, media): each vector (vec_id, embedding) as a picture, numbered 2 * vec_id.

    Of every ``every``-th vec_id an edited copy stands beside it, numbered one more; EDITS are taken in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = np.zeros((0, SIDE, SIDE), np.float32)
        for batch in batches:
            ids, media = [], []
            for name, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.nan_to_num(np.array([x or 0.0 for x in numbers or []], np.float32))[:NUMBERS]
                if len(v) > len(patterns):
                    patterns = _patterns(len(v))
                g = picture(v, patterns) if len(v) else None
                ids.append(None if name is None else 2 * name)
                media.append(None if g is None else pgm(g))
                if g is not None and name is not None and name % every == 0:
                    ids.append(2 * name + 1)
                    media.append(pgm(edited(g, EDITS[name // every % len(EDITS)])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["image_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, media binary")


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """Classes of copies among the pictures of all embeddings and edited copies of every 50th."""
    out = find_copies(media_from_vectors(read_table(spark, sf_dir, "embeddings")))
    number = F.floor(F.col("image_id") / 2)
    edit = F.element_at(F.array(*map(F.lit, EDITS)), (F.pmod(F.floor(number / 50), F.lit(len(EDITS))) + 1).cast("int"))
    return out.select(number.alias("vec_id"), F.when(F.col("image_id") % 2 == 1, edit).alias("edit"), "n_corners", F.floor(F.col("class_id") / 2).alias("class_id"), "class_size")
