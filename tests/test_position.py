"""Constants of the index format, and rules held against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators import extents as X


def spread(x):
    return sum((x >> i & 1) << 2 * i for i in range(16))


def compact(x):
    return sum((x >> 2 * i & 1) << i for i in range(16))


def plain_tile(lat, lon):
    return (spread((lat + 910_000_000) >> 16) << 1 | spread((lon & 0xFFFFFFFF) >> 16)) ^ 0x40000000


def plain_index(values):
    """The definition: a box in rows and columns, widened in order."""
    if not values:
        return 0xFE
    box = None
    for v in values:
        if v >> 31:
            level = next((1 << k for k in range(7) if v >> k & 1), None)
            if level is None:
                return 0x80000080
            step = 2 * level.bit_length() - 1
            keep = ~((1 << 2 * step) - 1) & 0x7FFFFFFF
            lo = v & keep & 0x2AAAAAAA, v & keep & 0x55555555
            far = (1 << step + 1) - 1
            hi = spread((compact(lo[0] >> 1) + far) & 0xFFFF) << 1, spread((compact(lo[1]) + far) & 0xFFFF)
            box = [(a, b) for a, b in zip(lo, hi)] if box is None else [(min(m, a), max(n, b)) for (m, n), a, b in zip(box, lo, hi)]
        else:
            at = v & 0x2AAAAAAA, v & 0x55555555
            box = [(a, a) for a in at] if box is None else [(a, n) if a < m else (m, max(n, a)) for (m, n), a in zip(box, at)]
    if all(a == b for a, b in box):
        return values[0]
    ends = [(compact(a >> s), compact(b >> s)) for (a, b), s in zip(box, (1, 0))]
    for level in (1 << k for k in range(7)):
        step = 2 * level.bit_length() - 1
        mask = 0xFFFF << step & 0xFFFF
        if all(((b & mask) - (a & mask)) & 0xFFFFFFFF < 1 << step + 1 for a, b in ends):
            return (box[0][0] | box[1][0]) & ~((1 << 2 * step) - 1) & 0xFFFFFFFF | 0x80000000 | level
    return 0x80000080


def test_tiles(spark):
    cases = [(0, 0, 0x4A280AA2), (900_000_000, 1_800_000_000, 0x7CCFB849), (-900_000_000, -1_800_000_000, 0x0110C794), (-900_000_000, 0, 0x40008280), (900_000_001, 0, 0x7F17A791), (0, -1_800_000_001, 0x7F17A791)]
    df = spark.createDataFrame(cases, "lat long, lon long, want long")
    assert df.filter(P.place_tile(F.col("lat"), F.col("lon")) != F.col("want")).count() == 0
    assert P.MARKER_TILE == 0x7F17A791


def test_tiles_at_random(spark):
    rng = random.Random(1)
    cases = [(lat := rng.randint(-900_000_000, 900_000_000), lon := rng.randint(-1_800_000_000, 1_800_000_000), plain_tile(lat, lon)) for _ in range(500)]
    df = spark.createDataFrame(cases, "lat long, lon long, want long").withColumn("tile", P.place_tile(F.col("lat"), F.col("lon")))
    assert df.filter("tile <> want").count() == 0
    back = df.withColumn("south", P.tile_south(F.col("tile"))).withColumn("west", P.tile_west(F.col("tile")))
    assert back.filter("lat - south not between 0 and 65535 or lon - west not between 0 and 65535").count() == 0


def test_classes_and_orders(spark):
    cases = [(0x4A28E368, "tile"), (0xFE, "none"), (0xE21940C1, "level 0x1"), (0x8A400010, "level 0x10"), (0x80000080, "level 0x80")]
    df = spark.createDataFrame(cases, "idx long, want string")
    assert df.filter(P.class_of(F.col("idx")) != F.col("want")).count() == 0
    keys = spark.createDataFrame([(x,) for x in (0x80000101, 0x100, 0x101, 0x80000100)], "idx long").orderBy(*P.index_order(F.col("idx")))
    assert [r.idx for r in keys.collect()] == [0x100, 0x80000100, 0x101, 0x80000101]
    assert spark.range(1).select(P.coarse(F.lit(0x81234567))).head()[0] == 0x01234500


def fold(spark, lists):
    rows = [(i, pos, 1, pos, "", v) for i, values in enumerate(lists) for pos, v in enumerate(values)]
    values = spark.createDataFrame(rows, "relation_id long, pos long, kind int, ref long, role string, value long")
    ids = spark.createDataFrame([(i,) for i in range(len(lists))], "id long")
    return {r.id: r.idx for r in X.relation_index(ids, values).collect()}


def test_order_decides(spark):
    lists = [[0xDC000040, 0x71F4A824], [0x80000080, 1], [5], [None], [0xFE, 0x4A280AA2]]
    got = fold(spark, lists)
    assert got[0] == 0x80000080 and got[1] == 0x80000080 and got[2] == 5 and got[3] == 0xFE
    assert got[4] == plain_index(lists[4])


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_at_random(spark, seed):
    rng = random.Random(seed)

    def value():
        base = rng.choice([0x4A280AA2, rng.getrandbits(31), 0x71F4A824])
        v = (base ^ rng.getrandbits(rng.choice([2, 6, 12, 20, 30]))) & 0x7FFFFFFF
        if rng.random() < 0.4:
            level = rng.choice([1, 2, 4, 8, 0x10, 0x20, 0x40, 0x80])
            v = v & ~((1 << 2 * (2 * level.bit_length() - 1)) - 1) & 0x7FFFFFFF | 0x80000000 | level
        return v

    lists = [[value() for _ in range(rng.randint(1, 5))] for _ in range(600)]
    got = fold(spark, lists)
    assert all(got[i] == plain_index(v) for i, v in enumerate(lists))


def test_way_levels(spark):
    base = (1 << 14, 1 << 14)
    extents = [((1, 0), 1), ((0, 5), 2), ((3, 3), 1), ((4, 0), 2), ((20, 20), 4), ((80, 0), 8), ((300, 0), 0x10), ((2000, 0), 0x20), ((5000, 0), 0x40)]
    rows = [(i, p, p, spread(base[0] + r * p) << 1 | spread(base[1] + c * p), 0) for i, ((r, c), _) in enumerate(extents) for p in (0, 1)]
    located = spark.createDataFrame(rows, "way_id long, pos long, node_id long, tile long, lower long")
    got = {r.id: r.idx for r in X.way_index(spark.range(len(extents)), located).collect()}
    assert [got[i] & -got[i] for i in range(len(extents))] == [level for _, level in extents]


def test_text(spark):
    row = spark.range(1).select(P.degrees_text(F.lit(-5)).alias("a"), P.degrees_text(F.lit(1_234_567_890)).alias("b"), P.iso_timestamp(F.lit(1_767_302_490)).alias("c")).head()
    assert tuple(row) == ("-0.0000005", "123.4567890", "2026-01-01T21:21:30Z")


def test_places_take_little_code(spark):
    """Bits are spread by a table, all numbers of 16 bits alike, and a place names its position a few times only, so that its code stays small enough to be compiled."""
    got = [r[0] for r in spark.range(1 << 16).select(P.spread(F.col("id") + (5 << 16))).collect()]
    assert got == [sum((x >> i & 1) << 2 * i for i in range(16)) for x in range(1 << 16)]
    places = spark.range(9).select(P.place_tile(F.col("id"), F.col("id") * 7))
    assert places._jdf.queryExecution().optimizedPlan().toString().count("id#") < 16
