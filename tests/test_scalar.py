import pytest
from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.operators import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def L(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), ("1,5", None), ("x", None), ("", None), (None, None), ("1d", None), (".5", 0.5), ("-3.", -3.0)])
def test_as_float(spark, text, want):
    assert one(spark, S.as_float(L(text))) == want


@pytest.mark.parametrize("text,want", [("Oui", True), (" N ", False), ("1", True), ("0", False), ("peut-être", None), ("", None), (None, None)])
def test_as_bool(spark, text, want):
    assert one(spark, S.as_bool(L(text))) is want


@pytest.mark.parametrize("cap", [None, 1999, 2000, 10000, 10001, 100000, 100001])
@pytest.mark.parametrize("zone", [True, False, None])
def test_norms(spark, cap, zone):
    got = spark.range(1).select(*[c.alias(n) for n, c in S.discharge_norms(L(cap, "double"), L(zone, "boolean")).items()]).first().asDict()
    if cap is None:
        assert set(got.values()) == {None}
        return
    large = cap >= 2000
    assert got["norme_dbo5_mg_l"] == (25.0 if large else 35.0) and got["norme_mes_mg_l"] == (35.0 if large else None) and got["norme_classe"] == ("≥ 2 000 EH" if large else "< 2 000 EH")
    assert got["norme_ngl_mg_l"] == ((10.0 if cap > 100000 else 15.0) if zone and cap > 10000 else None)
    assert got["norme_pt_rdt_pct"] == (80.0 if zone and cap > 10000 else None)


@pytest.mark.parametrize("exact,label,want", [("2.5", "x", (2.5, "mesuree")), ("0", "De 0,5 à 1 m", (0.75, "classe")), (None, "supérieure à 10m", (10.0, "classe")), ("", "", (None, None)), (None, None, (None, None))])
def test_height(spark, exact, label, want):
    h, o = S.height_from_text(L(exact), L(label))
    assert tuple(spark.range(1).select(h, o).first()) == want


def test_flow_nodes(spark):
    rows = [(d, *spark.range(1).select(*S.flow_nodes(L(d), L("i"), L("f"))).first()) for d in ("Sens direct", "Sens inverse", "Sans objet", None)]
    assert rows == [("Sens direct", "i", "f"), ("Sens inverse", "f", "i"), ("Sans objet", None, None), (None, None, None)]


def test_labels(spark):
    assert one(spark, S.short_label(L("Surface pastorale - herbe prédominante et ressources"), 20)) == "Surface pastorale"
    assert one(spark, S.short_label(L("x" * 50), 20)) == "x" * 19 + "…"
    assert one(spark, S.short_label(L("court"), 20)) == "court"
    assert one(spark, S.group_title(L("RUISSEAU DE (NC)  LA  FONT / AUTRE"))) == "Ruisseau de la font"
    name, unit = S.split_unit(L("Indice (sans unité)"))
    assert tuple(spark.range(1).select(name, unit).first()) == ("Indice", "")
    name, unit = S.split_unit(L("Obstacles — nombre"))
    assert tuple(spark.range(1).select(name, unit).first()) == ("Obstacles", "nombre")
    assert one(spark, S.type_label(L(None), L("1.1"))) == "Type Sandre 1.1" and one(spark, S.type_label(L(None), L(""))) == "Type non renseigné"
    assert one(spark, S.filled("a {x} b {y}", x=L("1"), y=L(None))) is None


def test_numbers(spark):
    assert one(spark, S.french_number(L(1234567.6, "double"))) == "1 234 568" and one(spark, S.french_number(L(3.14159, "double"))) == "3.14" and one(spark, S.french_number(L(None, "double"))) == ""
    assert [one(spark, S.adaptive_number(L(v, "double"))) for v in (0.5, 12.0, 123.456, 4567.8)] == ["0.5", "12", "123.5", "4 568"]
    assert [one(spark, S.yes_no(L(v, "boolean"))) for v in (True, False, None)] == ["oui", "non", "non renseigné"]
    assert one(spark, S.tint(L("804000"))) == "FFD2BCA5"
    assert one(spark, S.stream_width(L(9, "int"))) == pytest.approx(2.6) and one(spark, S.stream_width(L(None, "int"))) == pytest.approx(1.0)
    assert one(spark, S.linear_size(L(None, "double"), F.lit(4.0))) == 1.5 and one(spark, S.linear_size(F.lit(2.0), F.lit(4.0))) == 3.0


def test_rules(spark):
    assert one(spark, S.moisture_colour(L("Légèrement humide"))) == "#a8d8d0" and one(spark, S.moisture_colour(L("Très sec"))) == "#d9c27a" and one(spark, S.moisture_colour(L(None))) == S.MOISTURE_DEFAULT
    assert one(spark, S.forest_colour(L("Forêt fermée conifères"))) == "#2f6d5a"
    assert [one(spark, S.cyclic(F.lit(k), ("a", "b", "c"))) for k in (1, 3, 4)] == ["a", "c", "a"]
    assert [one(spark, S.capacity_class(L(v, "double"))) for v in (None, 1999, 2000, 9999, 10000)] == ["Capacité non renseignée", "< 2 000 EH", "2 000 à 9 999 EH", "2 000 à 9 999 EH", "≥ 10 000 EH"]
    assert one(spark, S.sides(F.lit(1), F.lit(50), F.lit(99), F.lit(50), (0, 0, 100, 100), 2)) == "l'ouest et l'est"
    assert one(spark, S.service_error(L("<a><ServiceException code='x'> no   such\nlayer </ServiceException></a>"))) == "no such layer"
    assert one(spark, S.sensitive_zone(L("frhzs_1"))) is False and one(spark, S.sensitive_zone(L(" "))) is None
    assert one(spark, S.pixel_ceiling(L(None, "double"))) == 12e6 and one(spark, S.pixel_ceiling(F.lit(1e9))) == pytest.approx(8.75e6) and one(spark, S.pixel_ceiling(F.lit(1e12))) == 60e6


def test_touching_tiles(spark):
    tiles = lambda x, y: {tuple(t) for t in one(spark, windows.touching_tiles(F.lit(x), F.lit(y), 10))}
    assert tiles(5.0, 5.0) == {(0, 0)} and tiles(10.0, 5.0) == {(0, 0), (1, 0)} and len(tiles(10.0, 10.0)) == 4
