"""Scalar rules as Column expressions: casts, text rules, regulatory classes, labels, formats.

Every function takes and returns Columns and stays inside whole-stage codegen; null in gives null out
unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Words read as true and as false.
TRUE_WORDS = ("1", "true", "oui", "o", "yes", "y")
FALSE_WORDS = ("0", "false", "non", "n", "no")

# Discharge limits (mg/L, % removal) of the order of 21 July 2015, annex III.
CAPACITY_LARGE = 2000
CAPACITY_NUTRIENTS = 10000
CAPACITY_NUTRIENTS_HIGH = 100000
LIMITS = {
    "dbo5": {"small": (35.0, 60.0), "large": (25.0, 80.0)},
    "dco": {"small": (200.0, 60.0), "large": (125.0, 75.0)},
    "mes": {"small": (None, 50.0), "large": (35.0, 90.0)},
    "ngl": {"medium": (15.0, 70.0), "high": (10.0, 70.0)},
    "pt": {"medium": (2.0, 80.0), "high": (1.0, 80.0)},
}
OUTSIDE_ZONE_PREFIX = "FRHZS"

# Terms that make a crop label grassland, and the category that does without a label.
GRASS_TERMS = ("prairie", "surface pastorale")
GRASS_CATEGORY = "PP"

# Separators at which a legend label is cut by preference.
LABEL_CUTS = (" (", " - ", ", ")
LABEL_MAX = 46

# Colours by word of a forest formation, and by beginning of a soil-moisture label.
FOREST_COLOURS = (("feuillus", "#4f9d69"), ("conifères", "#2f6d5a"), ("mixte", "#7a9d4f"), ("peupleraie", "#8fbf9d"), ("lande", "#b5a05f"), ("herbacée", "#c4c48a"))
FOREST_DEFAULT = "#9aa89a"
MOISTURE_COLOURS = (
    ("très sec", "#d9c27a"),
    ("sec", "#e3d29a"),
    ("assez sec", "#ece0b4"),
    ("mésique", "#cfe3b5"),
    ("légèrement humide", "#a8d8d0"),
    ("humide", "#4fa3d1"),
    ("détrempé", "#2f7fbf"),
    ("aquatique", "#1f5f99"),
)
MOISTURE_DEFAULT = "#bdbdbd"

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_as_null(c: ColumnLike) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def first_nonempty(*columns: ColumnLike, default: str | None = None) -> Column:
    return F.coalesce(*[blank_as_null(c) for c in columns], F.lit(default))


def nonempty_attributes(attributes: ColumnLike) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(col(attributes), lambda _, v: v.isNotNull() & (v != ""))


def as_float(c: ColumnLike) -> Column:
    """The number that a text states, else null."""
    text = col(c).cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def as_bool(c: ColumnLike) -> Column:
    """True, false or unknown from the service's various spellings."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(text.isin(*FALSE_WORDS), F.lit(False))


def first_of_list(c: ColumnLike) -> Column:
    """First entry of an array, null if empty."""
    return F.get(col(c), F.lit(0))


def flow_nodes(direction: ColumnLike, first: ColumnLike, last: ColumnLike) -> tuple[Column, Column]:
    """(upstream, downstream) node of a reach: swapped if inverse, as given if direct, else both unknown."""
    text = F.lower(F.coalesce(col(direction), F.lit("")))
    inverse, direct = text.contains("inverse"), text.contains("direct")
    up = F.when(inverse, col(last)).when(direct, col(first))
    return up, F.when(inverse, col(first)).when(direct, col(last))


def height_from_text(exact: ColumnLike, label: ColumnLike) -> tuple[Column, Column]:
    """(height, origin): the exact value if positive ("mesuree"), else from the class label ("classe"):
    the middle of its first two numbers, or its only one."""
    value = as_float(exact)
    found = F.transform(
        F.regexp_extract_all(F.coalesce(col(label), F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")
    )
    known = value > 0
    height = F.when(known, value).when(F.size(found) >= 2, (F.get(found, F.lit(0)) + F.get(found, F.lit(1))) / 2).when(F.size(found) == 1, F.get(found, F.lit(0)))
    return height, F.when(known, F.lit("mesuree")).when(F.size(found) >= 1, F.lit("classe"))


def fish_pass(label: ColumnLike) -> Column:
    """Unknown if the label is empty; false if it states absence; else true."""
    text = blank_as_null(label)
    return F.when(text.isNotNull(), ~F.lower(text).startswith("absence"))


def type_label(label: ColumnLike, code: ColumnLike, prefix: str = "Type Sandre ", default: str = "Type non renseigné") -> Column:
    return F.coalesce(blank_as_null(label), F.concat(F.lit(prefix), blank_as_null(code)), F.lit(default))


def capacity(c: ColumnLike) -> Column:
    """Plant capacity; zero and below mean unknown."""
    value = as_float(c)
    return F.when(value > 0, value)


def sensitive_zone(code: ColumnLike) -> Column:
    """Whether a plant lies in a sensitive zone; unknown without a code."""
    text = F.upper(blank_as_null(code))
    return F.when(text.isNotNull(), ~text.startswith(OUTSIDE_ZONE_PREFIX))


def discharge_norms(capacity_eh: ColumnLike, in_zone: ColumnLike) -> dict[str, Column]:
    """The ten limits and the class by capacity; nutrients only in a sensitive zone above their threshold."""
    cap, zone = col(capacity_eh), F.coalesce(col(in_zone), F.lit(False))
    large = cap >= CAPACITY_LARGE
    nutrients = zone & (cap > CAPACITY_NUTRIENTS)
    high = cap > CAPACITY_NUTRIENTS_HIGH
    out = {}
    for name, table in LIMITS.items():
        for k, unit in enumerate(("mg_l", "rdt_pct")):
            if "small" in table:
                value = F.when(large, F.lit(table["large"][k]).cast("double")).when(cap.isNotNull(), F.lit(table["small"][k]).cast("double"))
            else:
                value = F.when(nutrients & high, F.lit(table["high"][k])).when(nutrients, F.lit(table["medium"][k]))
            out[f"norme_{name}_{unit}"] = value
    out["norme_classe"] = F.when(large, F.lit("≥ 2 000 EH")).when(cap.isNotNull(), F.lit("< 2 000 EH"))
    return out


def load_rate(capacity_eh: ColumnLike, incoming: ColumnLike) -> Column:
    """Load in % of capacity; above 100 a plant is saturated."""
    cap, load = col(capacity_eh), col(incoming)
    return F.when((load > 0) & (cap != 0), F.try_divide(100.0 * load, cap))


def capacity_class(capacity_eh: ColumnLike) -> Column:
    cap = col(capacity_eh)
    return (
        F.when(cap.isNull() | (cap == 0), F.lit("Capacité non renseignée"))
        .when(cap < CAPACITY_LARGE, F.lit("< 2 000 EH"))
        .when(cap < CAPACITY_NUTRIENTS, F.lit("2 000 à 9 999 EH"))
        .otherwise(F.lit("≥ 10 000 EH"))
    )


def fold(c: ColumnLike) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), _ACCENTED, _PLAIN)


def is_grass(label: ColumnLike, category: ColumnLike, terms: tuple[str, ...] = GRASS_TERMS, grass: str = GRASS_CATEGORY) -> Column:
    """By words of the label if there is one, else by category."""
    plain, has = fold(label), F.coalesce(col(label), F.lit("")) != ""
    named = reduce(lambda a, b: a | b, [plain.contains(t) for t in terms])
    return F.when(has, named).otherwise(F.coalesce(col(category) == grass, F.lit(False)))


def sides(xmin: ColumnLike, ymin: ColumnLike, xmax: ColumnLike, ymax: ColumnLike, extent: tuple, tolerance: float) -> Column:
    """The sides of an extent that a box comes nearer to than the tolerance, as text; null if none."""
    x0, y0, x1, y1 = extent
    near = [
        (col(xmin) - x0 < tolerance, "l'ouest"),
        (col(ymin) - y0 < tolerance, "le sud"),
        (x1 - col(xmax) < tolerance, "l'est"),
        (y1 - col(ymax) < tolerance, "le nord"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in near]))
    n = F.size(found)
    lead = F.array_join(F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.get(found, F.lit(0))).when(n > 1, F.concat(lead, F.lit(" et "), F.element_at(found, -1)))


def natura_link(key: ColumnLike, code: ColumnLike, template: str = "https://eunis.eea.europa.eu/sites/%s") -> Column:
    return F.when(col(key).isin("zsc", "zps") & blank_as_null(code).isNotNull(), F.format_string(template, col(code)))


def _cut(text: Column, limit: int) -> Column:
    return F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))


def short_label(c: ColumnLike, limit: int = LABEL_MAX) -> Column:
    """A label of at most ``limit`` characters, cut at the first kind of separator within reach, else by length."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    out = F.when(F.length(text) <= limit, text)
    for cut in LABEL_CUTS:
        at = F.locate(cut, text) - 1
        out = out.when((at > 0) & (at <= limit), F.left(text, at))
    return out.otherwise(_cut(text, limit))


def cut_label(c: ColumnLike, limit: int = LABEL_MAX) -> Column:
    """The label itself, or its first characters and an ellipsis."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(_cut(text, limit))


def group_title(c: ColumnLike, limit: int = 45) -> Column:
    """First of several names, without "(NC)", with single spaces, in sentence case, cut to length."""
    text = F.replace(F.replace(F.substring_index(col(c), "/", 1), F.lit("(NC)"), F.lit("")), F.lit("(nc)"), F.lit(""))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))
    return F.when(F.length(text) > limit, _cut(text, limit)).otherwise(text)


def split_unit(label: ColumnLike) -> tuple[Column, Column]:
    """(label without unit, unit) of "label (unit)" or "label — nombre"."""
    pattern, text, count = r"^(.*?)\s*\(([^()]*)\)\s*$", col(label), " — nombre"
    found = text.rlike(pattern)
    unit = F.regexp_extract(text, pattern, 2)
    name = F.when(found, F.regexp_extract(text, pattern, 1)).when(text.endswith(count), F.left(text, F.length(text) - len(count))).otherwise(text)
    return name, F.when(found & (unit == "sans unité"), F.lit("")).when(found, unit).when(text.endswith(count), F.lit("nombre")).otherwise(F.lit(""))


def filled(template: str, **values: ColumnLike) -> Column:
    """A template with ``{name}`` places; null if a value is null or empty."""
    parts, rest = [], template
    for name in sorted(values, key=lambda n: template.index("{" + n + "}")):
        lead, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(lead), F.nullif(col(values[name]).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def filled_text(template: ColumnLike, **values: ColumnLike) -> Column:
    """Templates of a column with ``{name}`` places; as they are where a place has no value."""
    out = col(template)
    for name, value in values.items():
        place = "{" + name + "}"
        out = F.when(col(template).contains(place), F.replace(out, F.lit(place), col(value).cast("string"))).otherwise(out)
    return F.when(out.rlike(r"\{[^{}]*\}"), col(template)).otherwise(F.coalesce(out, col(template)))


def french_integer(c: ColumnLike, space: str = " ") -> Column:
    """Thousands set apart by a space."""
    return F.replace(F.format_number(col(c), 0), F.lit(","), F.lit(space))


def french_number(c: ColumnLike, decimals: int = 2, space: str = " ") -> Column:
    """From 1000 on whole with spaced thousands, below with fixed decimals; empty if unknown."""
    value = col(c).cast("double")
    small = F.format_string(f"%.{decimals}f", value)
    return F.when(value.isNull(), F.lit("")).when(F.abs(value) >= 1000, french_integer(value, space)).otherwise(small)


def adaptive_number(c: ColumnLike, space: str = " ") -> Column:
    """Whole from 1000, one decimal from 100, below up to three without trailing zeros; null if unknown."""
    value = col(c).cast("double")
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), "0+$", ""), r"\.$", "")
    return F.when(F.abs(value) >= 1000, french_integer(value, space)).when(F.abs(value) >= 100, F.format_string("%.1f", value)).when(value.isNotNull(), small)


def yes_no(c: ColumnLike) -> Column:
    return F.when(col(c).isNull(), F.lit("non renseigné")).when(col(c), F.lit("oui")).otherwise(F.lit("non"))


def by_word(c: ColumnLike, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """Value of the first rule whose word the text contains."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.when(text.contains(rules[0][0]), F.lit(rules[0][1]))
    for word, value in rules[1:]:
        out = out.when(text.contains(word), F.lit(value))
    return out.otherwise(F.lit(default))


def by_start(c: ColumnLike, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """Value of the first rule that the text begins with."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.when(text.startswith(rules[0][0]), F.lit(rules[0][1]))
    for word, value in rules[1:]:
        out = out.when(text.startswith(word), F.lit(value))
    return out.otherwise(F.lit(default))


def forest_colour(label: ColumnLike) -> Column:
    return by_word(label, FOREST_COLOURS, FOREST_DEFAULT)


def moisture_colour(label: ColumnLike) -> Column:
    return by_start(label, MOISTURE_COLOURS, MOISTURE_DEFAULT)


def cyclic(rank: ColumnLike, palette: tuple[str, ...]) -> Column:
    """Entry of a palette by rank from 1, starting over at its end."""
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(col(rank) - 1, F.lit(len(palette))) + 1).cast("int"))


def tint(colour: ColumnLike, ratio: float = 0.65) -> Column:
    """"RRGGBB" mixed with white, as "FFRRGGBB"."""
    parts = [F.conv(F.substring(col(colour), k, 2), 16, 10).cast("int") for k in (1, 3, 5)]
    mixed = [F.lpad(F.hex(F.floor(p + (255 - p) * ratio)), 2, "0") for p in parts]
    return F.concat(F.lit("FF"), *mixed)


def linear_size(value: ColumnLike, most: ColumnLike, low: float = 1.5, high: float = 4.5) -> Column:
    """Symbol size growing from ``low`` at 0 to ``high`` at the maximum; ``low`` if unknown."""
    top = F.greatest(F.coalesce(F.nullif(col(most), F.lit(0.0)), F.lit(1.0)), F.lit(0.1))
    share = F.least(F.greatest(col(value) / top, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(low + (high - low) * share, F.lit(low))


def stream_width(order: ColumnLike) -> Column:
    return F.least(0.6 + 0.4 * F.coalesce(F.nullif(col(order), F.lit(0)), F.lit(1)), F.lit(2.6))


def service_error(body: ColumnLike) -> Column:
    """Text of a service's exception report, at most 200 characters."""
    text = col(body)
    inner = F.regexp_extract(text, r"(?s)<[^>]*Exception[^>]*>(.*?)</", 1)
    plain = F.trim(F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"\s+", " "))
    return F.coalesce(F.nullif(F.left(plain, F.lit(200)), F.lit("")), F.lit("sans explication du service"))


def gravelius(area: ColumnLike, perimeter: ColumnLike) -> Column:
    return F.try_divide(0.28 * col(perimeter), F.sqrt(area))


def equivalent_rectangle(area: ColumnLike, perimeter: ColumnLike) -> tuple[Column, Column]:
    """(length, width) of the rectangle of like area and perimeter; a square if more compact than a disc."""
    g, side = gravelius(area, perimeter), F.sqrt(area)
    ratio = F.try_divide(F.lit(1.128), g)
    length = F.when(ratio >= 1, side).otherwise(g * side / 1.128 * (1 + F.sqrt(F.greatest(1 - ratio * ratio, F.lit(0.0)))))
    return length, F.when(ratio >= 1, side).otherwise(F.try_divide(col(area), length))


def slope_index(z5: ColumnLike, z95: ColumnLike, length_m: ColumnLike) -> Column:
    """Useful drop by length in km (m/km)."""
    return F.try_divide(col(z5) - col(z95), col(length_m) / 1000)


def specific_relief(index: ColumnLike, area_km2: ColumnLike) -> Column:
    return col(index) * F.sqrt(area_km2)


def least_drained_area(upstream_km: ColumnLike) -> Column:
    """Smallest plausible drained area in m2 for a length of streams; 0 if unknown."""
    return F.coalesce(col(upstream_km) / 5 * 1e6, F.lit(0.0))


def snap_extent(xmin: ColumnLike, ymin: ColumnLike, xmax: ColumnLike, ymax: ColumnLike, step: ColumnLike) -> dict[str, Column]:
    """An extent rounded outward to a grid, with its size in cells."""
    s = col(step)
    x0, y0 = F.floor(col(xmin) / s) * s, F.floor(col(ymin) / s) * s
    x1, y1 = F.ceil(col(xmax) / s) * s, F.ceil(col(ymax) / s) * s
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "width": F.round((x1 - x0) / s).cast("long"), "height": F.round((y1 - y0) / s).cast("long")}


#: Cell sizes of the elevation service in metres, finest first.
RESOLUTIONS = (5.0, 10.0, 25.0, 50.0)


def choose_resolution(width: ColumnLike, height: ColumnLike, most: ColumnLike, steps: tuple[float, ...] = RESOLUTIONS) -> Column:
    """Finest cell size whose count of cells fits; else the coarsest."""
    out = None
    for s in steps:
        fits = (col(width) / s) * (col(height) / s) <= col(most)
        out = F.when(fits, F.lit(s)) if out is None else out.when(fits, F.lit(s))
    return out.otherwise(F.lit(steps[-1]))


def pixel_ceiling(free_bytes: ColumnLike, share: float = 0.35, each: int = 40) -> Column:
    """Cells that free memory allows, within bounds; a fixed count if memory is unknown."""
    budget = F.least(F.greatest(col(free_bytes) * share / each, F.lit(2e6)), F.lit(60e6))
    return F.coalesce(F.when(col(free_bytes) != 0, budget), F.lit(12e6))


def tile(x: ColumnLike, size: int) -> Column:
    return F.floor(col(x) / size).cast("long")
