"""Queries over a graph and its indexes."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators.shards import in_ranges
from gridloom.operators.storage import stored

#: Rounds of a recursion after which what was found is written as one table, so that plans stay short.
SEEN_PARTS = 16
#: Points of a cell that an area meets together; pieces, and pairs of edges, of a cell beyond which it is divided.
PIECE, MOST_PIECES, MOST_PAIRS = 128, 64, 1 << 14


def _tile_runs(south: int, west: int, north: int, east: int, depth: int = 6) -> list[tuple[int, int]]:
    """Runs of tile indexes that cover a box: quadrants are divided ``depth`` times below the one that holds it."""
    rows = [(x + P.LAT_SHIFT) >> 16 for x in (south, north)]
    cols = [((x & 0xFFFFFFFF) >> 16) ^ 0x8000 for x in (west, east)]
    size = 16
    while size and all(a >> (size - 1) == b >> (size - 1) for a, b in (rows, cols)):
        size -= 1
    out: list[tuple[int, int]] = []

    def index(row: int, col: int) -> int:
        return sum((row >> i & 1) << 2 * i + 1 | (col >> i & 1) << 2 * i for i in range(16))

    def visit(row: int, col: int, bits: int, left: int) -> None:
        edge = (1 << bits) - 1
        if row > rows[1] or row + edge < rows[0] or col > cols[1] or col + edge < cols[0]:
            return
        inside = rows[0] <= row and row + edge <= rows[1] and cols[0] <= col and col + edge <= cols[1]
        if inside or not bits or not left:
            first = index(row, col)
            last = first + (1 << 2 * bits) - 1
            if out and out[-1][1] + 1 == first:
                out[-1] = (out[-1][0], last)
            else:
                out.append((first, last))
            return
        half = 1 << bits - 1
        for r in (0, half):
            for c in (0, half):
                visit(row + r, col + c, bits - 1, left - 1)

    visit(rows[0] >> size << size, cols[0] >> size << size, size, depth)
    return out


def _fewer(runs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most so many runs that cover the same: those with the narrowest gaps between them become one."""
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
    joined = set(gaps[: max(len(runs) - most, 0)])
    out: list[tuple[int, int]] = []
    for i, run in enumerate(runs):
        if i in joined:
            out[-1] = (out[-1][0], run[1])
        else:
            out.append(run)
    return out


def in_box(south: int, west: int, north: int, east: int, tile: str = "tile", most_runs: int = 12) -> Column:
    """Nodes in a box (bounds included; west > east crosses the date line), with ranges of the tile for the scan to prune by.

    For tables that hold the tile and are sorted by it; of a computed tile every range repeats the computation.
    """
    if west > east:
        return in_box(south, west, north, P.MAX_LON, tile, most_runs) | in_box(south, -P.MAX_LON, north, east, tile, most_runs)
    runs = reduce(lambda a, b: a | b, (F.col(tile).between(x, y) for x, y in _fewer(_tile_runs(south, west, north, east), most_runs)))
    return runs & F.col("lat").between(south, north) & F.col("lon").between(west, east)


def bbox_nodes(nodes: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    return nodes.filter(in_box(*box))


def bbox_ways(nodes: DataFrame, refs: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """(id) of ways with a node in the box."""
    return refs.join(bbox_nodes(nodes, box).select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()


def bbox_relations(nodes: DataFrame, refs: DataFrame, members: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """(id) of relations with a member node in the box, or a member way that has one."""
    found = bbox_nodes(nodes, box).select(F.lit(1).alias("kind"), F.col("id").alias("ref")).unionByName(bbox_ways(nodes, refs, box).select(F.lit(2).alias("kind"), F.col("id").alias("ref")))
    return members.join(found, ["kind", "ref"], "left_semi").select(F.col("relation_id").alias("id")).distinct()


def bbox_counts(nodes: DataFrame, refs: DataFrame, members: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """(type, n) in a box; the nodes in it, and the ways that have one, are found once."""
    own = stored(bbox_nodes(nodes, box).select("id"), "boxed")
    ways = stored(refs.select("way_id", "node_id").join(own.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct(), "boxed")
    below = own.select(F.lit(1).alias("kind"), F.col("id").alias("ref")).unionByName(ways.select(F.lit(2).alias("kind"), F.col("id").alias("ref")))
    relations = members.select("relation_id", "kind", "ref").join(below, ["kind", "ref"], "left_semi").select("relation_id").distinct()
    parts = {"node": own, "way": ways, "relation": relations}
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("type"), "n") for k, df in parts.items()))


def with_tag(tags: DataFrame, key: str, value: str | None = None, pattern: str | None = None) -> DataFrame:
    """(type, id) of elements (type, id, k, v) that have the key, and if given the value, or one that the pattern finds.

    A pattern is tried on the distinct values of the key only.
    """
    own = tags.filter(F.col("k") == key)
    if value is not None:
        own = own.filter(F.col("v") == value)
    if pattern is not None:
        own = own.join(own.select("v").distinct().filter(F.col("v").rlike(pattern)), "v", "left_semi")
    return own.select("type", "id").distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).dropDuplicates(["type", "id"])


def _reached(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of these and of all that steps (from, to) lead to, in rounds until none is new. Each round is written to the shared folder."""
    steps = stored(steps.distinct(), "steps")
    seen = fresh = stored(ids.select("id").distinct(), "seen")
    for n in count(1):
        next_ = steps.join(fresh.withColumnRenamed("id", "from"), "from", "left_semi").select(F.col("to").alias("id")).distinct()
        fresh = stored(next_.join(seen, "id", "left_anti"), "fresh")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        if n % SEEN_PARTS == 0:
            seen = stored(seen.repartition("id"), "seen")


def recurse_down(members: DataFrame, refs: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """(type, id) of everything below the relations (id), themselves included: relations in rounds until none is new, then ways and nodes.

    However deep relations are nested; cycles end since a relation is followed once. Each round is written to the shared folder.
    """
    children = members.filter("kind = 3").select(F.col("relation_id").alias("from"), F.col("ref").alias("to"))
    seen = _reached(children, relation_ids)
    own = members.join(seen.withColumnRenamed("id", "relation_id"), "relation_id", "left_semi")
    ways = own.filter("kind = 2").select(F.col("ref").alias("id")).distinct()
    nodes = own.filter("kind = 1").select(F.col("ref").alias("id")).unionByName(refs.join(ways.withColumnRenamed("id", "way_id"), "way_id", "left_semi").select(F.col("node_id").alias("id"))).distinct()
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("type"), "id") for k, df in (("relation", seen), ("way", ways), ("node", nodes))))


def recurse_up(members: DataFrame, refs: DataFrame, node_ids: DataFrame, nested: bool = False) -> DataFrame:
    """(type, id) of ways with one of the nodes (id), and of relations with one of the nodes or ways; if ``nested``, of relations with one of these as well, however deep."""
    ways = refs.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()
    below = node_ids.select(F.lit(1).alias("kind"), F.col("id").alias("ref")).unionByName(ways.select(F.lit(2).alias("kind"), F.col("id").alias("ref")))
    relations = members.join(below, ["kind", "ref"], "left_semi").select(F.col("relation_id").alias("id")).distinct()
    if nested:
        parents = members.filter("kind = 3").select(F.col("ref").alias("from"), F.col("relation_id").alias("to"))
        relations = _reached(parents, relations)
    return ways.select(F.lit("way").alias("type"), "id").unionByName(relations.select(F.lit("relation").alias("type"), "id"))


def around(nodes: DataFrame, lat: int, lon: int, radius: int) -> DataFrame:
    """(id, distance2): nodes within a radius, on the plane of coordinates (units of both 1e-7 degrees)."""
    box = (max(lat - radius, -P.MAX_LAT), max(lon - radius, -P.MAX_LON), min(lat + radius, P.MAX_LAT), min(lon + radius, P.MAX_LON))
    d = (F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lon") - lon) * (F.col("lon") - lon)
    return bbox_nodes(nodes, box).select("id", d.alias("distance2")).filter(F.col("distance2") <= radius * radius)


def around_metres(nodes: DataFrame, lat: int, lon: int, metres: float, earth: float = 6_371_000.0) -> DataFrame:
    """(id, metres): nodes within a great-circle distance. The box is widened where meridians converge."""
    import math

    reach = math.degrees(metres / earth) * 1e7
    wide = reach / max(math.cos(math.radians(min(abs(lat) + reach, P.MAX_LAT) / 1e7)), 1e-9)
    south, north = int(max(lat - reach - 1, -P.MAX_LAT)), int(min(lat + reach + 1, P.MAX_LAT))
    if wide >= P.MAX_LON:
        box = (south, -P.MAX_LON, north, P.MAX_LON)
    else:
        west, east = (int(lon + s * (wide + 1)) for s in (-1, 1))
        box = (south, west + 2 * P.MAX_LON if west < -P.MAX_LON else west, north, east - 2 * P.MAX_LON if east > P.MAX_LON else east)
    a, b, dl = F.radians(F.col("lat") / 1e7), math.radians(lat / 1e7), F.radians((F.col("lon") - lon) / 1e7)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin(dl / 2), 2)
    return bbox_nodes(nodes, box).select("id", (2 * earth * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).alias("metres")).filter(F.col("metres") <= metres)


def _pieces(points: DataFrame, cell: int, width: int) -> DataFrame:
    """(band, across, s, n, w, e, points): points of a cell, in arrays of at most ``PIECE`` that lie near each other, and their bounds."""
    place = lambda c, n: F.floor(F.col(c) / n)
    own = points.select("point_id", "lat", "lon", place("lat", cell).alias("band"), place("lon", width).alias("across"), place("lat", max(cell // 4, 1)).alias("strip"))
    dealt = in_ranges(own.filter("band is not null and across is not null"), "band", "across", "strip", "lon", "point_id")
    at = F.row_number().over(Window.partitionBy("_part", "band", "across").orderBy("strip", "lon", "point_id")) - 1
    grouped = dealt.withColumn("piece", F.floor(at / PIECE)).groupBy("_part", "band", "across", "piece")
    bounds = (F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    return grouped.agg(*bounds, F.collect_list(F.struct("point_id", "lat", "lon")).alias("points")).drop("_part", "piece")


def is_in(points: DataFrame, edges: DataFrame, cell: int = 1 << 22, width: int = 1 << 26) -> DataFrame:
    """(point_id, area_id): points (point_id, lat, lon) in areas of edges (area_id, lat1, lon1, lat2, lon2), by parity of crossings.

    Points and edges meet in bands of latitude, so that each edge goes to the bands that it spans rather than to every point.
    Where two edges that reach as far bound an area in a band, it is met only by pieces of the points between, in cells of
    ``width``, and each pair is decided where it is met; a piece between two upright edges is taken whole. Else crossings are
    counted. A point counts as inside on an area's lower and left border. Integer arithmetic in decimals, without rounding.
    """
    spark = points.sparkSession
    place = lambda c, n: F.floor(c / n)
    spans = edges.filter("lat1 <> lat2").withColumns({"low": F.least("lat1", "lat2"), "high": F.greatest("lat1", "lat2")})
    dealt = spans.withColumn("band", F.explode(F.sequence(place(F.col("low"), cell), place(F.col("high") - 1, cell))))
    d = lambda c: F.col(c).cast("decimal(19,0)")

    def east(e: str) -> Column:
        """Whether the edge lies east of the point: (lon - lon1) * (lat2 - lat1) < (lat - lat1) * (lon2 - lon1), for an edge that rises."""
        rises = F.when(F.col(f"{e}lat2") > F.col(f"{e}lat1"), F.lit(1)).otherwise(F.lit(-1))
        left = (d("lon") - d(f"{e}lon1")) * (d(f"{e}lat2") - d(f"{e}lat1")) * rises
        right = (d("lat") - d(f"{e}lat1")) * (d(f"{e}lon2") - d(f"{e}lon1")) * rises
        return F.when(F.col("lon") < F.least(f"{e}lon1", f"{e}lon2"), True).when(F.col("lon") >= F.greatest(f"{e}lon1", f"{e}lon2"), False).otherwise(left < right)

    edge = F.struct("lat1", "lon1", "lat2", "lon2", F.greatest(F.col("low"), F.col("band") * cell).alias("low"), F.least(F.col("high"), (F.col("band") + 1) * cell).alias("high"))
    both = dealt.groupBy("area_id", "band").agg(F.count(F.lit(1)).alias("n"), F.min(edge).alias("a"), F.max(edge).alias("b"))
    both = both.filter("n = 2 and a.low = b.low and a.high = b.high").select("area_id", "band", F.col("a.low").alias("low"), F.col("a.high").alias("high"), *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("lat1", "lon1", "lat2", "lon2")))
    ends = [f"{e}_lon{i}" for e in "ab" for i in (1, 2)]
    between = both.withColumns({"west": F.least(*ends), "end": F.greatest(*ends)}).filter("west < end")
    cells, parts = ["band", "across"], ["band", "across", "row", "col"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # cells have very different numbers of pairs
    across = F.explode(F.sequence(place(F.col("west"), width), place(F.col("end") - 1, width))).alias("across")

    def many(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))

    dense = many(points.select(place(F.col("lat"), cell).alias("band"), place(F.col("lon"), width).alias("across")), PIECE * MOST_PIECES, "rows")
    dense = dense.join(many(between.select("band", across), MOST_PAIRS, "cols"), cells).filter("rows > 1 or cols > 1")

    def divided(rows: DataFrame, key: Column, own: str, other: str) -> DataFrame:
        """A row of a dense cell goes to one ``own`` by its key, and to each ``other``; so a cell isn't one task's."""
        found = rows.join(F.broadcast(dense), cells, "left")
        found = found.withColumn(own, F.pmod(F.xxhash64(key), F.coalesce(F.col(f"{own}s"), F.lit(1))))
        return found.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1))).drop("rows", "cols").repartition(n, *parts)

    pieces = divided(_pieces(points, cell, width), F.col("points")[0]["point_id"], "row", "col")

    def met(pairs: DataFrame, whole: str) -> DataFrame:
        """Pairs of edges with each point between their bounds; of pieces that are ``whole`` no point is looked at."""
        near = pieces.join(divided(pairs.select("*", across), F.col("area_id"), "col", "row"), parts).filter("low <= n and s < high and west <= e and w < end")
        each = near.select(*(c for c in pairs.columns if c != "band"), F.expr(whole).alias("whole"), F.inline("points"))
        return each.filter("whole or (lat >= low and lat < high and lon >= west and lon < end)")

    upright = "a_lon1 = a_lon2 and b_lon1 = b_lon2"
    inside = met(between.filter(upright).select("area_id", "band", "low", "high", "west", "end"), "low <= s and n < high and west <= w and e < end")
    leaning = met(between.filter(f"not ({upright})"), "false").filter(east("a_") != east("b_"))
    rest = dealt.join(both.select("area_id", "band"), ["area_id", "band"], "left_anti")
    crossed = points.withColumn("band", place(F.col("lat"), cell)).join(rest, "band").filter("lat >= low and lat < high")
    counted = crossed.filter(east("")).groupBy("point_id", "area_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return reduce(DataFrame.unionByName, (df.select("point_id", "area_id") for df in (inside, leaning, counted)))


def centres(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(way_id, lat, lon): middle of the box of each way's nodes, rounded down."""
    own = refs.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy("way_id")
    middle = lambda c: F.floor((F.min(c) + F.max(c)) / 2).cast("long")
    return own.agg(middle("lat").alias("lat"), middle("lon").alias("lon"))


def closed_rings(edges: DataFrame) -> DataFrame:
    """(area_id, ok, n_edges): an area's edges (area_id, lat1, lon1, lat2, lon2) close if every end has an even number of edges."""
    ends = edges.select("area_id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).unionByName(edges.select("area_id", F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))
    degrees = ends.groupBy("area_id", "lat", "lon").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy("area_id").agg(F.bool_and(F.col("degree") % 2 == 0).alias("ok"), (F.sum("degree") / 2).cast("long").alias("n_edges"))


def area_edges(members: DataFrame, refs: DataFrame, nodes: DataFrame, relation_tags: DataFrame) -> DataFrame:
    """Edges of areas: of member ways of relations (relation_id, k, v) tagged as multipolygon or boundary, whose rings close. Edges that two ways share cancel out."""
    areas = relation_tags.filter("k = 'type' and v in ('multipolygon', 'boundary')").select("relation_id").distinct()
    ways = members.filter("kind = 2").join(areas, "relation_id", "left_semi").select(F.col("relation_id").alias("area_id"), F.col("ref").alias("way_id")).distinct()
    located = refs.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    pairs = located.withColumn("to", F.lead(F.struct("lat", "lon")).over(Window.partitionBy("way_id").orderBy("pos"))).filter("to is not null")
    steps = pairs.select("way_id", F.array_sort(F.array(F.struct("lat", "lon"), F.struct("to.lat", "to.lon"))).alias("e")).filter(F.col("e")[0] != F.col("e")[1])
    edges = ways.join(steps, "way_id").groupBy("area_id", "e").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    flat = edges.select("area_id", *(F.col("e")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in ("lat", "lon")))
    holes = pairs.filter("lat is null or to.lat is null").join(ways, "way_id").select("area_id").distinct()
    ok = closed_rings(flat).filter("ok").select("area_id").join(holes, "area_id", "left_anti")
    return flat.join(ok, "area_id", "left_semi")


def within(nodes: DataFrame, refs: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(area_id, type, id) of nodes in areas (edges as of ``area_edges``), and of ways and relations that have one of these."""
    inside = stored(is_in(nodes.select(F.col("id").alias("point_id"), "lat", "lon"), edges).select("area_id", F.col("point_id").alias("id")), "inside")
    ways = refs.join(inside.withColumnRenamed("id", "node_id"), "node_id").select("area_id", F.col("way_id").alias("id")).distinct()
    below = inside.select("area_id", F.lit(1).alias("kind"), F.col("id").alias("ref")).unionByName(ways.select("area_id", F.lit(2).alias("kind"), F.col("id").alias("ref")))
    relations = members.join(below, ["kind", "ref"]).select("area_id", F.col("relation_id").alias("id")).distinct()
    return reduce(DataFrame.unionByName, (df.select("area_id", F.lit(k).alias("type"), "id") for k, df in (("node", inside), ("way", ways), ("relation", relations))))
