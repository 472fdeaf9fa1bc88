"""Geographic grids: cells of a bounding box, refinement, classification of cells, and estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import query_plus
from .skew import unique_join

# Land-use tags that tell a place without or with people.
EMPTY_LANDUSE = [
    "desert", "sand", "beach", "dune", "water", "sea", "ocean", "lake", "pond", "reservoir", "basin", "forest", "wood",
    "scrub", "heath", "grassland", "meadow", "fell", "mountain", "rock", "cliff", "scree", "glacier", "ice", "wetland",
    "marsh", "swamp", "bog", "mud", "military", "danger_area", "quarry", "mine", "landfill", "farmland", "farmyard",
    "farm", "orchard", "vineyard",
]
POPULATED_LANDUSE = [
    "residential", "commercial", "retail", "industrial", "mixed_use", "construction", "institutional", "civic",
    "education", "healthcare", "tourism", "hotel", "resort", "port", "harbour", "airport", "urban", "village",
]
# Kilometres of a degree; (at least so many km, zoom); (area below so many km2, cell size in km).
KM = 111.0
ZOOMS = [(16, 11), (8, 12), (4, 13), (2, 14), (1, 15), (0.5, 16)]
CELL_SIZES = [(100, 0.5), (500, 1.0), (2000, 2.0), (10000, 3.0), (50000, 5.0)]


def _ladder(c: Column, steps, over: bool, last) -> Column:
    return reduce(lambda acc, s: acc.when(c >= s[0] if over else c < s[0], s[1]), steps, F.when(F.lit(False), last)).otherwise(last)


def zoom(km: Column) -> Column:
    return _ladder(km, ZOOMS, True, 17).cast("int")


def optimal_cell_size(area: Column) -> Column:
    return _ladder(area, CELL_SIZES, False, 10.0)


def leads_per_cell(km: Column) -> Column:
    return F.least(F.lit(120), F.bround(km * km * 8)).cast("long")


def parse_bounds(c: Column) -> Column:
    """north, south, east, west of a text "N,S,E,W"; raises for anything but four numbers with south < north and west < east.

    A null text gives null.
    """
    parts = F.transform(F.split(c, ","), lambda x: strip(x).try_cast("double"))
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"bounds must be {why}, got: "), c)).cast("array<double>")
    checked = F.when((F.size(parts) != 4) | F.exists(parts, lambda x: x.isNull()), wrong("four numbers")).otherwise(parts)
    checked = F.when((checked[1] >= checked[0]) | (checked[3] >= checked[2]), wrong("north above south and east of west")).otherwise(checked)
    return F.when(c.isNotNull(), F.struct(*[checked[i].alias(k) for i, k in enumerate(("north", "south", "east", "west"))]))


def grid_search_url(query: Column, root: str) -> Column:
    """The search of a query at the place and zoom of a cell (lat, lng, zoom)."""
    at = F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string"), F.concat(F.col("zoom").cast("string"), F.lit("z")))
    return F.concat(F.lit(root.rstrip("/") + "/"), query_plus(query), F.lit("/@"), at)


def box_metrics(df: DataFrame) -> DataFrame:
    """north, south, east, west with center_lat, center_lng, height_km, width_km."""
    lat = (F.col("north") + F.col("south")) / 2
    return df.select("*", lat.alias("center_lat"), ((F.col("east") + F.col("west")) / 2).alias("center_lng"), ((F.col("north") - F.col("south")) * KM).alias("height_km"), ((F.col("east") - F.col("west")) * KM * F.cos(F.radians(lat))).alias("width_km"))


#: Places of grids in a task, about.
TASK_CELLS = 500_000


def _steps(km: float) -> tuple[Column, Column]:
    """Degrees of latitude and longitude from one cell of a box to the next."""
    return F.lit(km) / KM, F.lit(km) / (F.lit(KM) * F.cos(F.radians((F.col("north") + F.col("south")) / 2)))


def _lines(km: float) -> tuple[Column, Column]:
    """Numbers of the last row and column of a box."""
    lat_step, lng_step = _steps(km)
    return F.ceil((F.col("north") - F.col("south")) / lat_step).cast("int"), F.ceil((F.col("east") - F.col("west")) / lng_step).cast("int")


def cell_parts(boxes: DataFrame, km: float, most: int = TASK_CELLS) -> int:
    """Into how many parts the cells of the boxes are dealt: as many as a shuffle has, more where these would be too large.

    It is told from the bounds of the boxes, without making a cell.
    """
    rows, cols = (F.greatest(n, F.lit(0)).cast("double") + 1 for n in _lines(km))
    places = boxes.agg(F.sum(rows * cols)).first()[0] or 0
    return max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(places // most) + 1)


def grid_cells(boxes: DataFrame, km: float, parts: int | None = None) -> DataFrame:
    """Cells whose centre is inside their box; boxes: id, north, south, east, west.

    Boxes are small and cells many, so rows of boxes are dealt to `parts` tasks (`cell_parts`) before cells are made of them.
    """
    (lat_step, lng_step), (rows, cols) = _steps(km), _lines(km)
    dealt = boxes.select("*", F.explode(F.sequence(F.lit(0), rows)).alias("row")).repartition(parts or cell_parts(boxes, km), "id", "row")
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), cols)).alias("col"))
    lat, lng = F.col("south") + F.col("row") * lat_step + lat_step / 2, F.col("west") + F.col("col") * lng_step + lng_step / 2
    inside = cells.withColumns({"lat": lat, "lng": lng}).where("lat <= north and lng <= east")
    return inside.select("id", F.concat(F.lit("r"), "row", F.lit("_c"), "col").alias("cell_id"), "row", "col", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.lit(km / 2).alias("radius_km"), zoom(F.lit(km)).alias("zoom"))


def subdivide(cells: DataFrame, d: int = 2) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(d - 1))
    parts = cells.select("*", F.explode(steps).alias("sr")).select("*", F.explode(steps).alias("sc"))
    lng_km = F.lit(KM) * F.cos(F.radians("lat"))
    lat = F.col("lat") - F.col("radius_km") / KM + (F.col("sr") + 0.5) * (F.col("radius_km") * 2 / d / KM)
    lng = F.col("lng") - F.col("radius_km") / lng_km + (F.col("sc") + 0.5) * (F.col("radius_km") * 2 / d / lng_km)
    return parts.select("id", F.concat("cell_id", F.lit("_s"), "sr", "sc").alias("cell_id"), F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"), (F.col("radius_km") / d).alias("radius_km"), zoom(F.col("radius_km") * 2 / d).alias("zoom"))


def cell_bounds(cells: DataFrame) -> DataFrame:
    dlat, dlng = F.col("radius_km") / KM, F.col("radius_km") / (F.lit(KM) * F.cos(F.radians("lat")))
    return cells.select("*", (F.col("lat") + dlat).alias("north"), (F.col("lat") - dlat).alias("south"), (F.col("lng") + dlng).alias("east"), (F.col("lng") - dlng).alias("west"))


def refine(cells: DataFrame, cap: int, d: int = 2) -> DataFrame:
    """One level of subdivision of the cells with `result_count` of `cap` or more, beside the cells below."""
    below = cells.where(F.coalesce("result_count", F.lit(0)) < cap).select("id", "cell_id", "lat", "lng", "radius_km", "zoom")
    return below.unionByName(subdivide(cells.where(F.col("result_count") >= cap), d))


def _result(populated: Column, confidence: Column, method: str) -> Column:
    return F.struct(populated.alias("is_populated"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))


def by_buildings(count: Column, least: int = 5) -> Column:
    """Null count: no answer."""
    confidence = F.when(count >= 100, 0.95).when(count >= 50, 0.90).when(count >= 20, 0.85).when(count >= least, 0.75).otherwise(0.65)
    return F.when(count.isNotNull(), _result(count >= least, confidence, "osm_buildings"))


def by_landuse(tags: Column) -> Column:
    """Null tags: no answer; unknown tags count as populated."""
    low = F.transform(tags, F.lower)
    has = lambda words: F.coalesce(F.arrays_overlap(low, F.array(*map(F.lit, words))), F.lit(False))
    populated, empty = has(POPULATED_LANDUSE), has(EMPTY_LANDUSE)
    return F.when(tags.isNotNull(), _result(populated | ~empty, F.when(populated, 0.80).when(empty, 0.75).otherwise(0.50), "osm_landuse"))


def by_results(count: Column, none_text: Column) -> Column:
    """Null count: the check failed, which counts as populated with little confidence."""
    confidence = F.when(count.isNull(), 0.30).when(count >= 1, 0.95).when(none_text, 0.90).otherwise(0.70)
    return _result(F.coalesce(count >= 1, F.lit(True)), confidence, "quick")


def classify(method: str, buildings: Column, landuse: Column, quick: Column | None = None) -> Column:
    """One result per cell; without any answer it counts as populated, with confidence 0."""
    nothing = _result(F.lit(True), F.lit(0.0), "fallback")
    if method == "buildings":
        return F.coalesce(buildings, nothing)
    if method == "landuse":
        return F.coalesce(landuse, nothing)
    if method == "quick":
        return F.coalesce(quick, nothing)
    if method == "combined":
        both = _result(buildings["is_populated"] | landuse["is_populated"], (buildings["confidence"] + landuse["confidence"]) / 2, "osm_combined")
        return F.when(buildings.isNotNull() & landuse.isNotNull(), both).otherwise(F.coalesce(buildings, landuse, nothing))
    sure = lambda r: F.when(r["confidence"] >= 0.70, r)
    return F.coalesce(sure(buildings), sure(landuse), *([quick] if quick is not None else []), buildings, nothing)


def grid_stats(cells: DataFrame, *by: str) -> DataFrame:
    """cells: is_scraped, is_empty, result_count.  Cells that are not empty count as populated, scraped or not."""
    total, done = F.count("*"), F.count_if("is_scraped")
    return cells.groupBy(*by).agg(
        total.alias("total"), done.alias("scraped"), (total - done).alias("unscraped"), F.count_if("is_empty").alias("empty"),
        F.count_if(~F.col("is_empty")).alias("populated"), F.coalesce(F.sum("result_count"), F.lit(0)).cast("long").alias("results"),
        F.coalesce(F.round(done / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0)).alias("completion_pct"),
    )


def scrape_estimate(cells: DataFrame, km: float, per_lead: float = 36.0, overhead: float = 23.0, *by: str) -> DataFrame:
    leads = leads_per_cell(F.lit(km))
    seconds = F.col("populated_cells") * (F.lit(overhead) + leads * per_lead)
    counts = cells.groupBy(*by).agg(F.count("*").alias("total_cells"), F.count_if(~F.col("is_empty")).alias("populated_cells"))
    return counts.select(*by, "total_cells", "populated_cells", (F.col("total_cells") - F.col("populated_cells")).alias("empty_cells"), leads.alias("avg_leads_per_cell"), (F.col("populated_cells") * leads).alias("estimated_leads"), F.bround(seconds).cast("long").alias("estimated_seconds"), F.bround(seconds / 60, 1).alias("estimated_minutes"), F.bround(seconds / 3600, 2).alias("estimated_hours"))


def cell_selectors(cells: DataFrame) -> DataFrame:
    """cells with `unscraped` (neither scraped nor empty), `scraped` and `empty`; an empty cell counts as scraped once marked."""
    return cells.withColumns({"unscraped": ~F.col("is_scraped") & ~F.col("is_empty"), "scraped": F.col("is_scraped"), "empty": F.col("is_empty")})


def _by_cell(df: DataFrame, by: tuple[str, ...], parts: int | None) -> DataFrame:
    """df dealt by cell to so many tasks, which are not put together again however well a shuffle packs; None: as Spark deals."""
    return df.repartition(parts, *by, "cell_id") if parts else df


def mark_scraped(cells: DataFrame, results: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """cells with the counts of results(by..., cell_id, result_count), which has each cell once; those are scraped.

    With `parts` (`cell_parts`) a task sorts a bounded number of cells.
    """
    found = results.select(*by, "cell_id", F.col("result_count").alias("__n"), F.lit(True).alias("__hit"))
    joined = _by_cell(cells, by, parts).join(_by_cell(found, by, parts), [*by, "cell_id"], "left")
    marks = {"is_scraped": F.col("is_scraped") | F.coalesce("__hit", F.lit(False)), "result_count": F.coalesce("__n", "result_count")}
    return joined.withColumns(marks).select(cells.columns)


def mark_empty(cells: DataFrame, checks: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """cells merged with checks(by..., cell_id, is_populated): those that are not populated are empty, and count as scraped.

    Cells without a check stay as they are; a cell is empty if any of its checks says so.  With `parts` the checks are dealt as
    `mark_scraped` deals cells, which are not dealt again.
    """
    empty = _by_cell(checks.where(~F.col("is_populated")).select(*by, "cell_id"), by, parts).distinct().withColumn("__hit", F.lit(True))
    joined = cells.join(empty, [*by, "cell_id"], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    return joined.withColumns({"is_empty": F.col("is_empty") | F.col("__hit"), "is_scraped": F.col("is_scraped") | F.col("__hit")}).select(cells.columns)


def grid_shape(cells: DataFrame, *by: str) -> DataFrame:
    """rows, cols and total_cells of each grid."""
    return cells.groupBy(*by).agg((F.coalesce(F.max("row"), F.lit(-1)) + 1).alias("rows"), (F.coalesce(F.max("col"), F.lit(-1)) + 1).alias("cols"), F.count("*").alias("total_cells"))


#: Cells in a document of a grid.
GRID_CELLS = 10_000
CELL = ["lat", "lng", "radius_km", "cell_id", "zoom", "row", "col", "is_scraped", "is_empty", "result_count"]


def grid_json(boxes: DataFrame, cells: DataFrame, km: float, most: int = GRID_CELLS) -> DataFrame:
    """(id, part, grid): grids as JSON documents with bounds, size, shape and cells, in the order of rows and columns.

    A document holds at most `most` places of a grid, whether it is wide or high, so that a large grid is written in parts,
    numbered from 0; each part has the shape of the whole grid.  A grid that holds most of all cells is dealt out by parts.
    """
    placed = unique_join(cells, grid_shape(cells, "id"), "id")
    part = F.floor((F.col("row").cast("long") * F.col("cols") + F.col("col")) / most).cast("long")
    shape = [F.first(c).alias(c) for c in ("rows", "cols", "total_cells")]
    lists = placed.groupBy("id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("row", "col", F.struct(*CELL).alias("cell")))).alias("c"), *shape)
    box = F.struct(*[F.col(k) for k in ("north", "south", "east", "west")]).alias("bounds")
    joined = lists.join(boxes.select("id", box), "id")
    whole = F.struct("bounds", F.lit(km).alias("cell_size_km"), "rows", "cols", "total_cells", F.transform("c", lambda x: x["cell"]).alias("cells"))
    return joined.select("id", "part", F.to_json(whole).alias("grid"))


def cells_of_json(grids: DataFrame) -> DataFrame:
    """The cells of (id, grid), as `grid_json` writes them."""
    cell = "array<struct<lat:double,lng:double,radius_km:double,cell_id:string,zoom:int,row:int,col:int,is_scraped:boolean,is_empty:boolean,result_count:int>>"
    return grids.select("id", F.inline(F.from_json("grid", f"cells {cell}")["cells"]))
