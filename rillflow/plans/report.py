"""Data behind reports: sections, tiles and titles, drawing and legend order, decimated and refined relief, colours and
light on it, lines laid on it, layers composed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import scalar as S

MOST_CELLS = 400
STREAM_STEP = 60.0

# Languages of texts, and the one that stands in for the others.
LANGUAGES = ("fr", "en", "es", "pt", "de")
FALLBACK_LANGUAGE = "en"

# Colours of relief (red, green, blue from 0 to 1) by share of the height, of a colour scale in 256 steps.
RELIEF_COLOURS = (
    (0.00, (0.2, 0.2, 0.6)),
    (0.15, (0.0, 0.6, 1.0)),
    (0.25, (0.0, 0.8, 0.4)),
    (0.50, (1.0, 1.0, 0.6)),
    (0.75, (0.5, 0.36, 0.33)),
    (1.00, (1.0, 1.0, 1.0)),
)

# The tiles of the overview: theme, and for each tile its field, decimals (None: as text) and the fields it cites.
TILES = (
    ("Occupation du sol", (("ocs_dom_pct", 0, ("ocs_dominante",)), ("peupl_pct", 1, ()), ("chab_hum_pct", 1, ("chab_cov_pct",)), ("bati_pct", 2, ("bati_nb",)))),
    ("Agriculture", (("rpg_pct", 1, ("herbe_pct",)), ("haies_dens", 1, ("haies_km",)), ("onf_pct", 1, ("onf_ha",)), ("bio_pct", 1, ()))),
    ("Nature et biodiversité", (("zonage_pct", 1, ("zonage_nb",)), ("gbif_esp_nb", 0, ("gbif_obs_nb",)))),
    ("Eau", (("me_code_eu", None, ("me_nom",)), ("aep_nb", 0, ("aep_vol_m3",)), ("roe_nb", 0, ("roe_par_km",)), ("vigi_km", 1, ("vigi_st_nb",)))),
    ("Pression anthropique", (("population_est", 0, ()), ("steu_nb", 0, ("steu_capa_tot_eh",)), ("preleve_vol_m3", 0, ("preleve_nb",)), ("basias_nb", 0, ("basol_nb", "sis_nb")), ("irep_nb", 0, ()))),
)


def sections(indicators: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """Indicators (key, field, ...) under ordered sections (section, section_ord, field, field_ord); sections without values do not appear."""
    return indicators.join(layout, "field").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("section_ord", "field_ord")))


def placed(blocks: DataFrame, key: str, order: str, height: str, start: float, limit: float) -> DataFrame:
    """Blocks in order with ``deferred``: those from the first on that does not fit, however short the later ones are."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = start + F.sum(height).over(w)
    return blocks.withColumn("deferred", F.max(end > limit).over(w))


def tiles(row: DataFrame, key: str, layout: Sequence[tuple[str, Sequence[tuple[str, int | None, Sequence[str]]]]] = TILES) -> DataFrame:
    """Overview tiles (key, theme, theme_ord, place, field, label, value, cited) of the basin row, one pass over it.

    A tile whose field is null or empty is left out and its place taken by the next; a theme without tiles does not appear.
    Fields that a tile cites come as "label : value", those without a value left out.
    """
    fields = {f.name: f for f in row.schema}
    label = lambda name: fields[name].metadata.get("label", name)
    plain = lambda name: S.blank_as_null(name) if fields[name].dataType.typeName() == "string" else S.adaptive_number(name)
    made = []
    for ord_, (theme, several) in enumerate(layout):
        for k, (name, decimals, cites) in enumerate(several):
            if name not in fields:
                continue
            value = S.blank_as_null(name) if decimals is None else F.when(F.col(name).isNotNull(), S.french_number(name, decimals))
            cited = [F.concat(F.lit(f"{label(c)} : "), plain(c)) for c in cites if c in fields]
            made.append(F.struct(F.lit(theme).alias("theme"), F.lit(ord_).alias("theme_ord"), F.lit(k).alias("_k"), F.lit(name).alias("field"), F.lit(label(name)).alias("label"), value.alias("value"), F.concat_ws(" · ", *cited).alias("cited")))
    each = row.select(key, F.explode(F.filter(F.array(*made), lambda t: t["value"].isNotNull())).alias("t")).select(key, "t.*")
    place = F.row_number().over(Window.partitionBy(key, "theme_ord").orderBy("_k"))
    return each.select(key, "theme", "theme_ord", place.alias("place"), "field", "label", "value", "cited")


def title(stream: Column, zone: Column, ident: Column) -> Column:
    """Title of a basin's report: by the stream, else the hydrographic zone (the first of several names), else the identifier."""
    name = F.coalesce(F.nullif(stream, F.lit("")), F.nullif(zone, F.lit("")))
    first = F.trim(F.substring_index(name, "/", 1))
    named = F.concat(F.lit("Bassin versant — "), F.upper(F.left(first, F.lit(1))), F.substr(first, F.lit(2)))
    return F.coalesce(named, F.concat(F.lit("Bassin versant "), F.coalesce(ident.cast("string"), F.lit(""))))


def subtitle(km2: Column, hectares: Column, body: Column, x: Column, y: Column, date: Column) -> Column:
    """Area, water body, outlet and date, those that are known."""
    area = F.format_string("%.3f km² (%.1f ha)", km2, F.coalesce(hectares, F.lit(0.0)))
    at = F.format_string("exutoire %.0f ; %.0f (Lambert 93)", F.rint(x), F.rint(y))
    parts = [F.when(km2.isNotNull(), area), F.concat(F.lit("masse d'eau "), F.nullif(body, F.lit(""))), F.when(x.isNotNull() & y.isNotNull(), at), F.nullif(date, F.lit(""))]
    return F.concat_ws(" · ", *parts)


def language(locale: Column) -> Column:
    """Two-letter language of a locale, or the fallback."""
    code = F.lower(F.left(F.coalesce(locale, F.lit("")), F.lit(2)))
    return F.when(code.isin(*LANGUAGES), code).otherwise(FALLBACK_LANGUAGE)


def translated(df: DataFrame, key: str, lang: str, texts: DataFrame, to: str = "text") -> DataFrame:
    """Texts of keys in each row's language from a table (key, lang, text): else in the fallback, else the key itself.

    Empty and null texts count as missing; of texts given twice the smallest stands. The table keeps a row a key.
    """
    known = texts.where("text is not null and text <> ''").groupBy("key", "lang").agg(F.min("text").alias("text"))
    by_key = known.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("_texts"))
    joined = df.join(by_key, F.col(key) == F.col("_key"), "left")
    text = F.coalesce(F.try_element_at("_texts", F.col(lang)), F.try_element_at("_texts", F.lit(FALLBACK_LANGUAGE)), F.col(key))
    return joined.withColumn(to, text).drop("_key", "_texts")


def draw_order(features: DataFrame, keys: Sequence[str], area: str, order: str) -> DataFrame:
    """Features with ``draw``: the largest first, so that small ones lie above; unknown areas as 0, ties in service order; without shape none is drawn."""
    first = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(area), F.lit(0.0)).desc(), order)
    return features.where("geom is not null").withColumn("draw", F.row_number().over(first))


def unique_labels(labels: DataFrame, keys: Sequence[str], label: str, limit: int = S.LABEL_MAX, to: str = "short") -> DataFrame:
    """Distinct labels with short forms; of labels whose short forms would be alike those that were shortened are cut by length."""
    short = labels.withColumn("_short", S.short_label(label, limit))
    clash = (F.count("*").over(Window.partitionBy(*keys, "_short")) > 1) & ~F.col(label).eqNullSafe(F.col("_short"))
    return short.withColumn(to, F.when(clash, S.cut_label(label, limit)).otherwise(F.col("_short"))).drop("_short")


def legend(features: DataFrame, keys: Sequence[str], label: str, area: Column, starts: Sequence[str]) -> DataFrame:
    """Legend entries (keys, label, area, place, short) of classes: by the first of ``starts`` that a label begins with, others last, then by name."""
    sums = features.groupBy(*keys, label).agg(F.coalesce(F.sum(F.coalesce(area, F.lit(0.0)).cast("decimal(28,4)")).cast("double"), F.lit(0.0)).alias("area"))
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    rank = F.coalesce(*[F.when(low.startswith(s), F.lit(k)) for k, s in enumerate(starts)], F.lit(len(starts)))
    placed_ = sums.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.coalesce(F.col(label), F.lit("")))))
    return unique_labels(placed_, keys, label)


def decimated(cells: DataFrame, keys: Sequence[str], h: Column, w: Column, most: int = MOST_CELLS) -> DataFrame:
    """Every grid at most ``most`` cells long, by the nearest source cell of each target cell."""
    factor = F.greatest(F.greatest(h, w) / F.lit(float(most)), F.lit(1.0))
    th, tw = F.greatest(F.lit(2), F.floor(h / factor)).cast("long"), F.greatest(F.lit(2), F.floor(w / factor)).cast("long")
    # a source cell serves the target cells whose centre falls into it
    first = lambda i, n, t: F.ceil(i * t / n - 0.5)
    span = lambda i, n, t: F.sequence(first(i, n, t), first(i + 1, n, t) - 1)
    has = lambda i, n, t: first(i + 1, n, t) > first(i, n, t)
    rows = cells.withColumns({"_th": F.when(factor <= 1, h).otherwise(th), "_tw": F.when(factor <= 1, w).otherwise(tw), "_h": h, "_w": w})
    kept = rows.where(has(F.col("r"), F.col("_h"), F.col("_th")) & has(F.col("c"), F.col("_w"), F.col("_tw")))
    kept = kept.withColumn("tr", F.explode(span(F.col("r"), F.col("_h"), F.col("_th")))).withColumn("tc", F.explode(span(F.col("c"), F.col("_w"), F.col("_tw"))))
    return kept.select(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"), "z")


def upsampled(cells: DataFrame, keys: Sequence[str], h: Column, w: Column, factor: int) -> DataFrame:
    """Grids ``factor`` times finer, bilinear between cell centres, edges repeated."""
    # each target cell gathers its four source cells; a source cell is sent to the targets that it has a part in
    def spread(df: DataFrame, axis: str, n: Column) -> DataFrame:
        i = F.col(axis)
        low = F.greatest((i - 1) * factor, F.lit(0))
        high = F.least((i + 2) * factor, n * factor) - 1
        df = df.withColumn(f"f{axis}", F.explode(F.sequence(low, high)))
        pos = F.least(F.greatest((F.col(f"f{axis}") + 0.5) / factor - 0.5, F.lit(0.0)), (n - 1).cast("double"))
        return df.withColumn(f"w{axis}", 1 - F.abs(pos - i)).where(F.col(f"w{axis}") > 0)

    rows = cells.withColumns({"_h": h, "_w": w})
    rows = spread(spread(rows, "r", F.col("_h")), "c", F.col("_w"))
    return rows.groupBy(*keys, "fr", "fc").agg((F.sum(F.col("z") * F.col("wr") * F.col("wc")) / F.sum(F.col("wr") * F.col("wc"))).alias("z")).withColumnsRenamed({"fr": "r", "fc": "c"})


def hillshade(slopes: DataFrame, dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 55.0) -> DataFrame:
    """Illumination from 0 to 1 of cells with gradients dx (east) and dy (south)."""
    import math

    az, alt = math.radians(azimuth), math.radians(altitude)
    east, north, up = math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt)
    light = (-dx * east + dy * north + up) / F.sqrt(dx * dx + dy * dy + 1)
    return slopes.withColumn("light", F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)))


def _piecewise(x: Column, channel: int) -> Column:
    out = None
    for (a, low), (b, high) in zip(RELIEF_COLOURS, RELIEF_COLOURS[1:]):
        value = low[channel] + (x - a) / (b - a) * (high[channel] - low[channel])
        out = F.when(x <= b, value) if out is None else out.when(x <= b, value)
    return out


def relief_colour(z: Column, low: Column, high: Column) -> Column:
    """Red, green and blue from 0 to 1 of elevations between two bounds; without a value, or between equal bounds, as the lower bound."""
    share = F.coalesce(F.try_divide(F.nanvl(z, low) - low, high - low), F.lit(0.0))
    step = F.least(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 256), F.lit(255)) / 255.0
    return F.array(*[_piecewise(step, k) for k in range(3)])


def in_light(rgb: Column, light: Column) -> Column:
    """Colours (0 to 1) under an illumination (0 to 1), by soft light: at 0.5 as they are."""
    return F.transform(rgb, lambda c: 2 * light * c + (1 - 2 * light) * c * c)


def as_bytes(rgb: Column) -> Column:
    return F.transform(rgb, lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int"))


def laid_on(points: DataFrame, cells: DataFrame, keys: Sequence[str], line: str, order: str, cell: float, least: int = 2) -> DataFrame:
    """Points (keys, line, order, x, y; y downward) with the elevation under them, in pieces: a line breaks where the
    grid has no value, and pieces of fewer than ``least`` points go."""
    at = points.withColumns({"r": F.floor(F.col("y") / cell), "c": F.floor(F.col("x") / cell)})
    met = at.join(cells.select(*keys, "r", "c", "z"), [*keys, "r", "c"], "left")
    along = Window.partitionBy(*keys, line).orderBy(order)
    known = met.withColumn("piece", F.sum(F.when(F.col("z").isNull(), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0))).where("z is not null")
    size = F.count("*").over(Window.partitionBy(*keys, line, "piece"))
    return known.withColumn("_n", size).where(F.col("_n") >= least).drop("_n")


def composed(base: Column, layers: Column) -> Column:
    """An RGB array under layers (structs of rgb, alpha 0-255, opacity), bottom to top, in floating point until the end."""
    def over(below: Column, layer: Column) -> Column:
        a = layer["alpha"] / 255.0 * layer["opacity"]
        return F.zip_with(below, layer["rgb"], lambda b, c: c * a + b * (1 - a))

    return F.aggregate(layers, F.transform(base, lambda x: x.cast("double")), over, lambda out: F.transform(out, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")))
