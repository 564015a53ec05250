"""Positions on a grid of tiles and extent indexes over it, as Column expressions.

Coordinates are integers of 1e-7 degrees. A tile index interleaves the upper 16 bits of the shifted latitude (odd bits) and
the longitude (even bits), with bit 30 flipped. An extent index is a tile, or with bit 31 set an aligned square of tiles
whose level is its lowest set bit, or NO_POSITION. All are kept as non-negative longs of 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the index format.
MAX_LAT, MAX_LON = 900_000_000, 1_800_000_000
MARKER_LAT, MARKER_LON = 1_000_000_000, 2_000_000_000
LAT_SHIFT = 910_000_000
ROW_BITS, COLUMN_BITS = 0x2AAAAAAA, 0x55555555
COMPOUND, ANYWHERE, NO_POSITION = 0x80000000, 0x80000080, 0xFE
#: Levels by their bit.
LEVELS = tuple(1 << k for k in range(8))


def _band(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask))


def _shr(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def _shl(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def level_step(level: int) -> int:
    """log2 of the tiles by which squares of a level are aligned: 1, 3, 5, ... An extent may be one step larger."""
    return 2 * level.bit_length() - 1


#: The bits of a byte at the even positions, byte by byte: as one literal, which takes no code.
_SPREAD_BYTES = "array(" + ", ".join(f"{sum((x >> i & 1) << 2 * i for i in range(8))}L" for x in range(256)) + ")"


def spread(x: Column) -> Column:
    """The lower 16 bits at the even positions. Looked up by bytes: masks and shifts would name the number 16 times, and what has too much code isn't compiled."""
    table = F.expr(_SPREAD_BYTES)
    byte = lambda n: F.get(table, _band(_shr(x, n), 0xFF).cast("int"))
    return byte(0).bitwiseOR(_shl(byte(8), 16))


def compact(x: Column) -> Column:
    """The even positions gathered in 16 bits."""
    x = _band(x, COLUMN_BITS)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = _band(x.bitwiseOR(_shr(x, shift)), mask)
    return x


def is_valid(lat: Column, lon: Column) -> Column:
    return lat.between(-MAX_LAT, MAX_LAT) & lon.between(-MAX_LON, MAX_LON)


def stored_lat(lat: Column, lon: Column) -> Column:
    return F.when(is_valid(lat, lon), lat).otherwise(F.lit(MARKER_LAT))


def stored_lon(lat: Column, lon: Column) -> Column:
    return F.when(is_valid(lat, lon), lon).otherwise(F.lit(MARKER_LON))


def row_word(lat: Column) -> Column:
    """Stored latitude as 32 bits."""
    return lat + F.lit(LAT_SHIFT)


def column_word(lon: Column) -> Column:
    return _band(lon, 0xFFFFFFFF)


def tile_index(lat: Column, lon: Column) -> Column:
    """Tile of a stored position."""
    return _shl(spread(_shr(row_word(lat), 16)), 1).bitwiseOR(spread(_shr(column_word(lon), 16))).bitwiseXOR(F.lit(1 << 30))


def lower_index(lat: Column, lon: Column) -> Column:
    """Position of a stored position inside its tile."""
    return _shl(spread(row_word(lat)), 1).bitwiseOR(spread(column_word(lon)))


def _spread(x: int) -> int:
    return sum((x >> i & 1) << 2 * i for i in range(16))


#: Where invalid positions go.
MARKER_TILE = (_spread((MARKER_LAT + LAT_SHIFT) >> 16) << 1 | _spread(MARKER_LON >> 16)) ^ 1 << 30
MARKER_LOWER = _spread((MARKER_LAT + LAT_SHIFT) & 0xFFFF) << 1 | _spread(MARKER_LON & 0xFFFF)


def place_tile(lat: Column, lon: Column) -> Column:
    """Tile of any position. What is tested is the position itself, so that the expression stays small."""
    return F.when(is_valid(lat, lon), tile_index(lat, lon)).otherwise(F.lit(MARKER_TILE))


def place_lower(lat: Column, lon: Column) -> Column:
    return F.when(is_valid(lat, lon), lower_index(lat, lon)).otherwise(F.lit(MARKER_LOWER))


def coarse(index: Column) -> Column:
    """Region of 16 by 16 tiles, without the compound bit."""
    return _band(index, 0x7FFFFF00)


def upper_row(index: Column) -> Column:
    """16-bit row of a tile; of an extent index, that of its masked bits."""
    return compact(_shr(_band(index, 0xAAAAAAAA), 1))


def upper_column(index: Column) -> Column:
    return compact(_band(index, COLUMN_BITS))


def tile_of_cell(row: Column, column: Column) -> Column:
    """Index bits of a row and a column of 16 bits, column bits as in an index (flip included)."""
    return _shl(spread(row), 1).bitwiseOR(spread(column))


def tile_south(index: Column) -> Column:
    """Least latitude of a tile."""
    return _shl(upper_row(index), 16) - F.lit(LAT_SHIFT)


def tile_west(index: Column) -> Column:
    """Least longitude of a tile."""
    return _shl(upper_column(index) - F.lit(1 << 15), 16)


#: What ``corners`` gives.
CORNERS = ("row_lo", "row_hi", "col_lo", "col_hi", "compound", "anywhere")
#: Bits of rows and columns, the compound bit's place included, in which corners are added up.
ROW_WORD, COLUMN_WORD = 0xAAAAAAAA, 0x55555555


def _plus(a: Column, b: Column | int, word: int) -> Column:
    """Sum of two numbers that are spread over the bits of ``word``, modulo its size: the bits between pass carries on."""
    return _band(a.bitwiseOR(F.lit(~word & 0xFFFFFFFF)) + (F.lit(b) if isinstance(b, int) else b), word)


def corners(index: Column) -> dict[str, Column]:
    """Lowest and highest row and column bits of an index's area, whether it is compound, and whether it has no bounds."""
    is_compound = _band(index, COMPOUND) != 0
    out = {name: F.when(~is_compound, _band(index, word)) for name, word in zip(CORNERS[:4], (ROW_BITS, ROW_BITS, COLUMN_BITS, COLUMN_BITS), strict=True)}
    for level in LEVELS[:-1]:
        step, has = level_step(level), _band(index, level) != 0
        below, reach = (1 << 2 * step) - 1, (1 << 2 * step + 2) - 1
        for axis, bits, word in (("row", ROW_BITS, ROW_WORD), ("col", COLUMN_BITS, COLUMN_WORD)):
            low = _band(index, bits & ~below)
            out[f"{axis}_lo"] = out[f"{axis}_lo"].when(has, low)
            out[f"{axis}_hi"] = out[f"{axis}_hi"].when(has, _plus(low, word & reach, word))
    return out | {"compound": is_compound, "anywhere": is_compound & (_band(index, 0x7F) == 0)}


def extent_index(first: Column, row_lo: Column, row_hi: Column, col_lo: Column, col_hi: Column) -> Column:
    """Index of a box of row and column bits whose first part has index ``first``; NO_POSITION for a null box.

    A box fits a level if on both axes its aligned ends are the same or neighbours.
    """
    out = F.when(row_lo.isNull(), F.lit(NO_POSITION)).when((row_lo == row_hi) & (col_lo == col_hi), first)
    for level in LEVELS[:-1]:
        step = level_step(level)
        below = (1 << 2 * step) - 1
        fits = []
        for low, high, word in ((row_lo, row_hi, ROW_WORD), (col_lo, col_hi, COLUMN_WORD)):
            kept = word & ~below
            a, b = _band(low, kept), _band(high, kept)
            fits.append((a == b) | ((a < b) & (b == _plus(a, word & (1 << 2 * step + 2) - 1 & ~below, kept))))
        out = out.when(fits[0] & fits[1], _band(row_lo.bitwiseOR(col_lo), ~below & 0xFFFFFFFF).bitwiseOR(F.lit(COMPOUND | level)))
    return out.otherwise(F.lit(ANYWHERE))


def has_geometry(index: Column) -> Column:
    """Whether elements of this index keep the positions of their parts: compound, but not of the first level."""
    return (_band(index, COMPOUND) != 0) & (_band(index, 1) == 0)


def class_of(index: Column) -> Column:
    """tile, none, or the level in hex."""
    return F.when(index == NO_POSITION, "none").when(_band(index, COMPOUND) == 0, "tile").otherwise(F.concat(F.lit("level 0x"), F.lower(F.hex(index.bitwiseAND(-index)))))


def index_order(index: Column) -> list[Column]:
    """Sort keys of extent indexes: the lower 31 bits, then all."""
    return [_band(index, 0x7FFFFFFF), index]


def block_number(node_id: Column) -> Column:
    return F.floor(node_id / F.lit(65536)).cast("long")


def slot(node_id: Column) -> Column:
    return _shl(_band(node_id, 0xFFFF), 2)


def iso_timestamp(seconds: Column) -> Column:
    """In UTC, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds.cast("long"), F.lit(86_400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    return F.format_string("%sT%02d:%02d:%02dZ", date, F.floor(rest / 3600).cast("int"), F.floor(rest / 60).cast("int") % 60, (rest % 60).cast("int"))


def degrees_text(value: Column) -> Column:
    """Exactly seven decimals."""
    return F.concat(F.when(value < 0, "-").otherwise(""), F.format_string("%d.%07d", F.floor(F.abs(value) / 10_000_000).cast("long"), F.abs(value) % 10_000_000))


def describe_index(index: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(index), 8, "0")))
