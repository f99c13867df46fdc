"""Attribute tables: complete and densifying joins, lookups, dictionaries, set checks, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonemill.model import Grid


def filter_zone(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.col(column) == name)


def in_scopes(df: DataFrame, column: str, scopes: list[str]) -> DataFrame:
    """One row per (record, scope that shows it); scope ``all`` shows every record."""
    shown = F.filter(F.array(F.lit("all"), F.col(column)), lambda s: s.isin(scopes))
    return df.withColumn("scope", F.explode(shown))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def with_color(df: DataFrame, column: str, palette: dict[str, str], default: str) -> DataFrame:
    """Colour by class. The palette is a constant of the plan, so no join takes place."""
    return df.withColumn("color", F.coalesce(literal_map(palette)[F.col(column)], F.lit(default)))


def scan_patterns(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """One row per (text, pattern found in it); the whole text is searched."""
    hits = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.lit(label)) for label, p in patterns.items()]))
    return df.select("*", F.explode(hits).alias("label"))


def component_groups(df: DataFrame, column: str, definition: list[tuple[str, str, float]]) -> DataFrame:
    """Component scores of a map column totalled per group, plain and weighted."""
    groups = literal_map({key: group for key, group, _ in definition})
    weights = literal_map({key: weight for key, _, weight in definition})
    return (df.select(F.explode(column).alias("component", "value"))
            .groupBy(groups[F.col("component")].alias("grp"))
            .agg(F.sum("value").alias("total"), F.sum(F.col("value") * weights[F.col("component")]).alias("weighted"),
                 F.count("value").alias("n")))


# --- Joins ---------------------------------------------------------------------------------------


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side that lacks them. Empty means a complete join."""
    # Distinct first: a key that fills one side becomes one row before it is shuffled.
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right"))
    return only_left.unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))


def join_complete(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Inner join that must match every key of both sides exactly once."""
    if check:
        absent = [r[0] for r in unmatched_keys(left, right, key).limit(5).collect()]
        if absent:
            raise ValueError(f"join on {key} is not complete, for example {absent}")
        for side in (left, right):
            if not side.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} is not unique")
    return left.join(right, key)


def reconcile_names(df: DataFrame, preferred: str, other: str) -> DataFrame:
    """Keep the preferred name and mark the rows where the two differ."""
    return df.withColumn("name", F.coalesce(preferred, other)).withColumn(
        "differs", ~F.col(preferred).eqNullSafe(F.col(other)))


def name_mismatches(df: DataFrame, preferred: str, other: str) -> DataFrame:
    return reconcile_names(df, preferred, other).where("differs")


def densify(fact: DataFrame, zones: DataFrame, years: list[int], zone_key: str = "sector_id",
            status: str = "source_status", default_status: str = "sector-unmatched") -> DataFrame:
    """Every zone in every year; combinations without a fact get the default status and null measures."""
    frame = zones.select(zone_key, F.explode(F.array(*map(F.lit, years))).alias("year"))
    return (frame.join(fact, [zone_key, "year"], "left")
            .withColumn(status, F.coalesce(status, F.lit(default_status))))


def nearest_edition(df: DataFrame, year: Column, editions: list[int]) -> DataFrame:
    """Closest published edition of a year; the earlier one wins a tie."""
    distance = F.array(*[F.struct(F.abs(year - e).alias("gap"), F.lit(e).alias("edition")) for e in editions])
    return df.withColumn("edition", F.array_min(distance)["edition"])


def align(left: DataFrame, right: DataFrame, left_grid: Grid, right_grid: Grid,
          keys: tuple[str, ...] = ("row_i", "col_i")) -> DataFrame:
    """Cell-by-cell join of two pixel tables; the grids must be the same."""
    if left_grid != right_grid:
        raise ValueError(f"grids differ: {left_grid} and {right_grid}")
    return left.join(right, list(keys))


def with_municipality(df: DataFrame, zones: DataFrame) -> DataFrame:
    return df.join(zones.select("sector_id", "municipality"), "sector_id")


def with_series(df: DataFrame, code: str, families: dict[str, list[str]]) -> DataFrame:
    """One row per series of a class: its family and the class itself."""
    owner = {c: family for family, codes in families.items() for c in codes}
    if len(owner) != sum(len(codes) for codes in families.values()):
        raise ValueError("a class belongs to more than one family")
    text = F.col(code).cast("string")
    family = literal_map(owner)[text]
    series = F.array(F.concat(F.lit("family:"), family), F.concat(F.lit("class:"), text))
    return df.where(family.isNotNull()).withColumn("series", F.explode(series))


def find_zone(zones: DataFrame, text: str, id_column: str, label_column: str) -> DataFrame:
    """Record whose id or label equals the text, regardless of case and outer blanks."""
    wanted = text.strip().lower()
    return zones.where((F.lower(F.trim(F.col(id_column).cast("string"))) == wanted)
                       | (F.lower(F.trim(F.col(label_column))) == wanted))


def scope_keys(df: DataFrame, municipality: str = "municipality", sector: str = "sector_id",
               region: str = "region:all") -> DataFrame:
    """One row per scope of a record: region, its municipality, its sector."""
    return df.withColumn("scope", F.explode(F.array(
        F.lit(region), F.concat(F.lit("municipality:"), municipality),
        F.concat(F.lit("sector:"), F.col(sector).cast("string")))))


def scoped(stats: DataFrame, requests: DataFrame) -> DataFrame:
    """Statistics of the scope each request asks for; null measures where the scope has none."""
    return requests.join(stats, "scope", "left")


def with_quality(obs: DataFrame, sidecars: DataFrame, keys: list[str]) -> DataFrame:
    return obs.join(sidecars, keys, "left")


# --- Sets ----------------------------------------------------------------------------------------


def union_by_id(parts: list[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """Union of tables; the last table that has a key provides its record, in it the last row by ``order``."""
    marked = [df.withColumn("part_no", F.lit(i)) for i, df in enumerate(parts)]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    columns = [c for c in everything.columns if c not in (key, "part_no")]
    best = everything.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("part_no", *([order] if order else []))).alias("record"))
    return best.select(key, *[F.col(f"record.{c}").alias(c) for c in columns])


def has_all(df: DataFrame, group: str, member: str, required: list) -> DataFrame:
    """Groups that contain every required member."""
    found = F.collect_set(F.when(F.col(member).isin(required), F.col(member)))
    return df.groupBy(group).agg(found.alias("found")).where(F.size("found") == len(set(required))).select(group)


def domain_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values outside the allowed domain with their counts."""
    return (df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
            .where(~F.col("value").isin(allowed) | F.col("value").isNull()))


def check_domain(df: DataFrame | GroupedData, column: str, allowed: list, classified: list) -> DataFrame:
    """Number of values outside the domain and whether any classified value occurs."""
    c = F.col(column)
    return df.agg(F.count_if(~F.coalesce(c.isin(allowed), F.lit(False))).alias("n_outside"),
                  F.coalesce(F.bool_or(c.isin(classified)), F.lit(False)).alias("has_classified"))


def missing_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual, keys, "left_anti").select(keys)


def overlapping_codes(groups: DataFrame, code: str = "code", group: str = "grp") -> DataFrame:
    """Codes that belong to more than one group. Empty means the groups are disjoint."""
    return (groups.groupBy(code).agg(F.count_distinct(group).alias("n_groups")).where("n_groups > 1"))


def stack(observations: list[tuple[DataFrame, Grid]]) -> DataFrame:
    """Observations of one grid put on top of each other."""
    grids = {grid for _, grid in observations}
    if len(grids) != 1:
        raise ValueError(f"observations are on {len(grids)} different grids")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for df, _ in observations])


# --- Order ---------------------------------------------------------------------------------------


def dominant(stats: DataFrame, keys: list[str], code: str, area: str) -> DataFrame:
    """Class with the largest area per key; the lower code wins a tie. Combines before the shuffle."""
    best = F.max(F.struct(F.col(area).alias("a"), (-F.col(code).cast("double")).alias("o"), F.col(code).alias("c")))
    return stats.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.c").alias("dominant_code"), F.col("b.a").alias(area))


def sort_classes(stats: DataFrame, keys: list[str], code: str, area: str) -> DataFrame:
    """Rank classes per key by area, then by code (a key has at most as many rows as classes)."""
    order = W.partitionBy(*keys).orderBy(F.desc(area), F.asc(code))
    return stats.withColumn("rank", F.row_number().over(order))


def sort_names(df: DataFrame, column: str, locale: str = "nl") -> DataFrame:
    """Order by name as readers of that language expect it."""
    return df.orderBy(F.collate(F.col(column), locale), F.col(column))


def last_wins(cells: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Value of the last feature that covers a cell."""
    return cells.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def latest(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Value of the newest record, per key or over all."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def grouped_breakdown(stats: DataFrame, keys: list[str], code: str, area: str, groups: dict[str, list]) -> DataFrame:
    """Rows above zero with their sub-group, in the fixed group order, largest first within a group."""
    owner = literal_map({str(c): g for g, codes in groups.items() for c in codes})
    position = literal_map({g: i for i, g in enumerate(groups)})
    rows = stats.where(F.col(area) > 0).withColumn("grp", owner[F.col(code).cast("string")]).where(F.col("grp").isNotNull())
    order = W.partitionBy(*keys).orderBy(position[F.col("grp")], F.desc(area), F.asc(code))
    return rows.withColumn("position", F.row_number().over(order))
