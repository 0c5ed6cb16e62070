"""Media columns: grayscale images, and a search for cropped or edited copies by local descriptors.

Corners are found on several scales; each gets an orientation and binary brightness tests turned by it. Queries and images
are dealt as a grid of blocks, so that a task holds one block of queries and streams through images. In it descriptors meet
in eight tables, one for each 16 bits, which no pair within seven bits escapes; pairs that are close in all bits vote for a
placement of one image in the other, and a copy is where enough corners vote alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Pixels of a scale for one of its corners, the ratio of scales (all that fit are used), bits, the reach of the tests in pixels.
AREA, RATIO, TESTS, REACH = 128, 2**-0.25, 128, 11
#: Bits that two descriptors of one place may differ in, corners that must agree, the width in pixels of a vote's cell.
NEAR, AGREE, CELL = 16, 6, 12
TURNS = 30
#: Gray levels that a test must differ by.
MARGIN = 3
#: Queries of a block of the grid, images of a block, and pairs of descriptors compared at a time.
QUERIES, IMAGES, TILE = 4096, 2048, 1 << 20
#: Images that a task of `features` remembers, to describe equal ones once.
REMEMBERED = 1 << 16
#: Images that are compared with a block of queries at a time.
TOGETHER = 256
#: Pairs of corners with one value from which they are compared as a block.
OFTEN = 2048
#: A packed corner: x and y in eighths of a pixel, the number of the scale, the angle in 1024ths of a turn, the bits.
CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("scale", "u1"), ("angle", "<u2"), ("d0", "<u8"), ("d1", "<u8")])


def encode_image(pixels: np.ndarray) -> bytes:
    """A gray image (rows of uint8) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_image(data: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM; None for anything else."""
    found = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not found:
        return None
    width, height = int(found[1]), int(found[2])
    body = np.frombuffer(data, np.uint8, offset=found.end())
    return body[: width * height].reshape(height, width) if len(body) >= width * height > 0 else None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """The mean over squares of 2 r + 1 pixels, with edges repeated."""
    p = np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear sampling on pixel centres."""
    y = np.clip((np.arange(height) + 0.5) * x.shape[0] / height - 0.5, 0, x.shape[0] - 1)
    z = np.clip((np.arange(width) + 0.5) * x.shape[1] / width - 0.5, 0, x.shape[1] - 1)
    y0, z0 = np.minimum(y.astype(int), x.shape[0] - 2), np.minimum(z.astype(int), x.shape[1] - 2)
    fy, fz = (y - y0)[:, None], (z - z0)[None]
    a, b, c, d = x[y0][:, z0], x[y0][:, z0 + 1], x[y0 + 1][:, z0], x[y0 + 1][:, z0 + 1]
    return (a * (1 - fz) + b * fz) * (1 - fy) + (c * (1 - fz) + d * fz) * fy


def _pattern() -> np.ndarray:
    """TURNS x TESTS x 4: the two points of every test, turned."""
    r = np.random.default_rng(20240)
    points = np.clip(r.normal(0, REACH / 2, (TESTS, 2, 2)), -REACH * 0.7, REACH * 0.7)
    angles = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.array([[np.cos(angles), -np.sin(angles)], [np.sin(angles), np.cos(angles)]]).transpose(2, 0, 1)
    return np.rint(np.einsum("tij,npj->tnpi", turn, points)).astype(np.int64)


_PATTERN = _pattern()
_DISC = np.array([(y, x) for y in range(-9, 10) for x in range(-9, 10) if x * x + y * y <= 81])


def describe(pixels: np.ndarray) -> np.ndarray:
    """The CORNERs of an image, with places in its own pixels: the strongest of each scale, in proportion to its area."""
    base = pixels.astype(float)
    found = []
    for level in range(64):
        factor = RATIO**level
        h, w = int(round(base.shape[0] * factor)), int(round(base.shape[1] * factor))
        if min(h, w) < 2 * REACH + 4:
            break
        x = base if level == 0 else resize(_box(base, 1), h, w)
        gx, gy = np.gradient(x, axis=1), np.gradient(x, axis=0)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        score = a * b - c * c - 0.05 * (a + b) ** 2
        middle = score[1:-1, 1:-1]
        top = np.ones_like(middle, bool)
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    other = score[dy : dy + middle.shape[0], dx : dx + middle.shape[1]]
                    top &= (middle > other) if (dy, dx) < (1, 1) else (middle >= other)
        py, px = np.nonzero(top & (middle > 1.0))
        py, px = py + 1, px + 1
        inside = (py >= REACH) & (px >= REACH) & (py < h - REACH) & (px < w - REACH)
        py, px = py[inside], px[inside]
        if not len(py):
            continue
        order = np.lexsort((px, py, -score[py, px]))[: max(1, h * w // AREA)]
        py, px = py[order], px[order]
        disc = x[py[:, None] + _DISC[:, 0], px[:, None] + _DISC[:, 1]]
        disc = disc - disc.mean(1, keepdims=True)
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
        smooth = _box(x, 1)
        p = _PATTERN[turn]
        first = smooth[py[:, None] + p[:, :, 0, 1], px[:, None] + p[:, :, 0, 0]]
        second = smooth[py[:, None] + p[:, :, 1, 1], px[:, None] + p[:, :, 1, 0]]
        packed = np.packbits(first + MARGIN < second, axis=1).view(">u8")
        got = np.zeros(len(py), CORNER)
        got["x"], got["y"] = (np.minimum(np.rint((p + 0.5) / factor * 8), 65535) for p in (px, py))
        got["scale"], got["angle"] = level, np.rint(np.mod(angle / (2 * np.pi), 1) * 1024)
        got["d0"], got["d1"] = packed[:, 0], packed[:, 1]
        found.append(got)
    return np.concatenate(found) if found else np.zeros(0, CORNER)


def features(df: DataFrame) -> DataFrame:
    """(id, same, corners): the packed corners of the images (id, image, same) that have any; of rows with one `same` in a task only those of falling ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids, names, corners = [], [], []
            for i, data, same in zip(*(batch.column(c) for c in ("id", "image", "same")), strict=True):
                i, same = i.as_py(), same.as_py()
                if seen.get(same, i + 1) <= i:
                    continue  # equal to an image with a smaller id, which stands for both
                if len(seen) < REMEMBERED or same in seen:
                    seen[same] = i
                pixels = decode_image(data.as_py())
                if pixels is None or min(pixels.shape) < 2:
                    continue
                got = describe(pixels)
                if len(got):
                    ids.append(i)
                    names.append(same)
                    corners.append(got.tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "same": pa.array(names, pa.string()), "corners": pa.array(corners, pa.binary())})

    return df.mapInArrow(run, "id long, same string, corners binary")


class _Tables:
    """The corners of a block of queries, in a sorted table for each 16 bits of their descriptors."""

    def __init__(self, corners: list[bytes]) -> None:
        self.corners = np.frombuffer(b"".join(corners), CORNER)
        counts = np.array([len(c) // CORNER.itemsize for c in corners])
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.tables = []
        for k in range(8):
            value = self.part(self.corners, k)
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)), order, self.corners["d0"][order], self.corners["d1"][order]))

    @staticmethod
    def part(corners: np.ndarray, k: int) -> np.ndarray:
        return ((corners["d0" if k < 4 else "d1"] >> np.uint64(16 * (k % 4))) & np.uint64(0xFFFF)).astype(np.int64)

    def matches(self, corners: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (corner of a query, one of `corners`) that meet in a table and differ in at most `near` bits; each once."""
        left, right = [], []
        d0, d1 = np.ascontiguousarray(corners["d0"]), np.ascontiguousarray(corners["d1"])

        def take(k: int, i: np.ndarray, j: np.ndarray) -> None:
            """Those of the pairs (place in table k, corner) that are close and haven't met in an earlier table."""
            _, order, e0, e1 = self.tables[k]
            x, z = e0[i] ^ d0[j], e1[i] ^ d1[j]
            ok = np.bitwise_count(x) + np.bitwise_count(z) <= near
            for e in range(k):
                ok &= ((x if e < 4 else z) >> np.uint64(16 * (e % 4))) & np.uint64(0xFFFF) != 0
            left.append(order[i[ok]])
            right.append(j[ok])

        for k, (starts, order, e0, e1) in enumerate(self.tables):
            value = self.part(corners, k)
            sorted_ = np.argsort(value, kind="stable")
            values, first, own = np.unique(value[sorted_], return_index=True, return_counts=True)
            other = starts[values + 1] - starts[values]
            # Frequent values: all their corners against each other, a block at a time.
            for v in np.flatnonzero(own * other >= OFTEN).tolist():
                lo, hi = starts[values[v]], starts[values[v] + 1]
                step = max(1, TILE // int(hi - lo))
                for at in range(first[v], first[v] + own[v], step):
                    js = sorted_[at : min(at + step, first[v] + own[v])]
                    gap = np.bitwise_count(d0[js][:, None] ^ e0[lo:hi]) + np.bitwise_count(d1[js][:, None] ^ e1[lo:hi])
                    a, b = np.nonzero(gap <= near)
                    take(k, lo + b, js[a])
            rest = sorted_[np.repeat(own * other < OFTEN, own)]
            n = starts[value[rest] + 1] - starts[value[rest]]
            j = np.repeat(rest, n)
            take(k, np.repeat(starts[value[rest]] - (np.cumsum(n) - n), n) + np.arange(len(j)), j)
        return np.concatenate(left), np.concatenate(right)

    def copies(self, corners: np.ndarray, image: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, image, corners that agree on one scale, turn and shift) of the pairs (i, j) of corners, from AGREE on; image: the image of each of `corners`."""
        none = np.zeros(0, np.int64)
        width = int(image.max()) + 1 if len(image) else 1
        pair = self.owner[i] * width + image[j]
        keep = np.flatnonzero(np.bincount(pair)[pair] >= AGREE) if len(pair) else none
        i, j = i[keep], j[keep]
        pairs, pair = np.unique(pair[keep], return_inverse=True)
        q, c = self.corners[i], corners[j]
        level = q["scale"].astype(np.int64) - c["scale"]
        turn = (c["angle"].astype(float) - q["angle"]) * (2 * np.pi / 1024)
        step = np.rint(turn * 12 / (2 * np.pi)).astype(np.int64) % 12
        # Most pairs have too few votes for any scale and turn, wherever the corners are.
        vote = ((pair << 8) + level + 128) * 12 + step
        votes, own, n = np.unique(vote, return_inverse=True, return_counts=True)
        beside = np.zeros(len(votes), np.int64)
        for turned in (1, 11):  # the neighbouring turns
            at = votes - votes % 12 + (votes + turned) % 12
            place = np.minimum(np.searchsorted(votes, at), max(0, len(votes) - 1))
            beside = np.maximum(beside, np.where(votes[place] == at, n[place], 0))
        keep = np.flatnonzero((n + beside)[own] >= AGREE)
        if not len(keep):
            return none, none, none
        i, q, c, pair, level, turn, step = (v[keep] for v in (i, q, c, pair, level, turn, step))
        ratio = RATIO ** level.astype(float)
        x, y = q["x"] / 8, q["y"] / 8
        dx = c["x"] / 8 - ratio * (np.cos(turn) * x - np.sin(turn) * y)
        dy = c["y"] / 8 - ratio * (np.sin(turn) * x + np.cos(turn) * y)
        half = lambda d: np.floor(d * 2 / CELL).astype(np.int64) + (1 << 16)
        hx, hy = half(dx), half(dy)
        best: dict[int, int] = {}
        # A vote's cell is any two by two half cells, and any two neighbouring turns.
        for a in (0, 1):
            for b in (0, 1):
                for t in (0, 1):
                    cell = (((((level + 64) * 12 + (step + t) % 12) << 17) + ((hx + a) >> 1)) << 17) + ((hy + b) >> 1)
                    places, code = _codes(pair, cell)
                    once = np.unique(code * len(self.corners) + i) // len(self.corners)
                    who, n = np.unique(once, return_counts=True)
                    for p, m in zip(places[who[n >= AGREE]].tolist(), n[n >= AGREE].tolist(), strict=True):
                        best[p] = max(best.get(p, 0), m)
        who = np.array(sorted(best), np.int64)
        return pairs[who] // width, pairs[who] % width, np.array([best[p] for p in who.tolist()], np.int64)


def _codes(pair: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair of each code, code of each row): numbers for the distinct (pair, cell)."""
    order = np.lexsort((cell, pair))
    p, c = pair[order], cell[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return p[new], code


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (i, j, side): the copies that each cell of the grid has. The queries (side 0) of a cell come first."""
    cell, ids, corners, tables = None, [], [], None
    for batch in batches:
        where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j", "side")])
        cuts = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0)]) if where.shape[1] else []
        for a, b in zip(cuts, [*cuts[1:], where.shape[1]], strict=True):
            if cell != tuple(where[:2, a]):
                cell, ids, corners, tables = tuple(where[:2, a]), [], [], None
            own = batch.slice(int(a), int(b - a))
            if where[2, a] == 0:
                ids += own.column("same").to_pylist()
                corners += own.column("corners").to_pylist()
                continue
            if not ids:
                continue
            tables = tables or _Tables(corners)
            for at in range(0, own.num_rows, TOGETHER):
                part = own.slice(at, TOGETHER)
                raw = part.column("corners").to_pylist()
                found = np.frombuffer(b"".join(raw), CORNER)
                image = np.repeat(np.arange(len(raw)), [len(c) // CORNER.itemsize for c in raw])
                q, who, n = tables.copies(found, image, *tables.matches(found))
                if len(q):
                    yield pa.RecordBatch.from_pydict({"asked": pa.array([ids[x] for x in q.tolist()], pa.string()), "same": part.column("same").take(pa.array(who)), "n_inliers": pa.array(n)})


def find_copies(queries: DataFrame, images: DataFrame, key: str = "id", image: str = "image") -> DataFrame:
    """(query_id, class_id, n_images, n_inliers): the images of which a query is a cropped or edited copy.

    Images with the same bytes are one class, named by the least id; so are queries while they are searched. n_inliers is
    the number of corners of the query that agree on one scale, turn and shift; from AGREE on it is a copy. Null or broken
    images, images without corners and null ids match nothing; rows that repeat an id are all searched, each with its own
    image, and an empty table gives no rows. Other columns are not read.
    """
    spark = queries.sparkSession

    def corners(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, same) of all rows with an image, and (id, same, corners) of one row of each image."""
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(image).alias("image")).where("id is not null and image is not null").withColumn("same", F.sha2("image", 256))
        held = features(rows).groupBy("same").agg(F.min("id").alias("id"), F.first("corners").alias("corners"))
        return rows.select("id", "same"), cut(held)

    asked, sought = corners(queries)
    all_, held = corners(images)
    named = all_.groupBy("same").agg(F.countDistinct("id").alias("n_images"))
    across, down = (max(1, -(-frame.count() // size)) for frame, size in ((held, IMAGES), (sought, QUERIES)))
    # Each block of queries meets each block of images in one cell of the grid.
    block = lambda n: F.pmod(F.xxhash64("same"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sought.select(block(down).alias("i"), every(across).alias("j"), F.lit(0).alias("side"), "same", "corners")
    right = held.select(every(down).alias("i"), block(across).alias("j"), F.lit(1).alias("side"), "same", "corners")
    grid = left.unionByName(right).repartition(across * down, "i", "j").sortWithinPartitions("i", "j", "side", "same")
    found = cut(grid.mapInArrow(_search, "asked string, same string, n_inliers long"))
    classes = found.join(held.select("same", F.col("id").alias("class_id")), "same").join(named, "same")
    return classes.join(asked.select(F.col("id").alias("query_id"), F.col("same").alias("asked")), "asked").select("query_id", "class_id", "n_images", "n_inliers").distinct()


SIDE, GRID = 96, 8


def render(vector: np.ndarray) -> np.ndarray:
    """A picture of a vector of GRID * GRID numbers: a mosaic of its values, each tile split by a slanted edge."""
    v = np.clip(np.rint(128 + 420 * np.nan_to_num(np.resize(np.asarray(vector, float), GRID * GRID))), 0, 255).reshape(GRID, GRID)
    tile = SIDE // GRID
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    r, c = y // tile, x // tile
    slant = (x % tile) + np.where((r + c) % 2 == 0, y % tile, tile - 1 - y % tile) >= tile
    return np.where(slant, v[r, c], v[(r + 3) % GRID, (c + 5) % GRID]).astype(np.uint8)


def edit(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A copy that was cropped to three quarters of each side and whose contrast and brightness were changed."""
    r = np.random.default_rng(seed)
    h, w = pixels.shape[0] * 3 // 4, pixels.shape[1] * 3 // 4
    a, b = int(r.integers(0, pixels.shape[0] - h + 1)), int(r.integers(0, pixels.shape[1] - w + 1))
    return np.clip(np.rint((pixels[a : a + h, b : b + w].astype(float) - 128) * r.uniform(0.85, 1.1) + 128 + r.integers(-12, 13)), 0, 255).astype(np.uint8)


def pictures(df: DataFrame, key: str, vector: str, edited: bool = False) -> DataFrame:
    """(id, image): the pictures of vectors, or edited copies of them; a null vector has a null image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                pixels = render(np.array([x or 0 for x in v])) if v else None
                out.append(None if pixels is None else encode_image(edit(pixels, (i or 0) % (1 << 32)) if edited else pixels))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "image": pa.array(out, pa.binary())})

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, image binary")
