"""Themes and assembly on squares whose results are known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import reshape
from rillflow.plans import basin as B
from rillflow.plans import schema
from rillflow.plans import themes as T
from rillflow.functions import geometry as G
from rillflow.sources import ledger

BOX = "xmin double, ymin double, xmax double, ymax double, geom binary"


def polygons(spark, rows, columns):
    """rows: (box, *values) in kilometres."""
    out = []
    for k, (b, *values) in enumerate(rows):
        b = [1000.0 * v for v in b]
        out.append((*values, k, f"f{k}", *b, bytearray(G.to_wkb(G.POLYGON, G.box(*b)))))
    return spark.createDataFrame(out, f"{columns}, ord long, fid string, {BOX}")


def lines(spark, rows, columns):
    out = []
    for k, (line, *values) in enumerate(rows):
        xy = 1000.0 * np.array(line, float)
        out.append((*values, k, *G.bounds([xy]), bytearray(G.to_wkb(G.LINE, [xy])), G.length([xy])))
    return spark.createDataFrame(out, f"{columns}, ord long, {BOX}, length double")


def points(spark, rows, columns):
    return spark.createDataFrame([(*v, k, 1000.0 * x, 1000.0 * y) for k, (x, y, *v) in enumerate(rows)], f"{columns}, ord long, x double, y double")


@pytest.fixture(scope="module")
def basins(spark):
    """a: 10 x 10 km; b: 2 x 2 km, elsewhere."""
    return polygons(spark, [((0, 0, 10, 10), "a", 1e8), ((50, 50, 52, 52), "b", 4e6)], "basin_id string, area double").drop("ord", "fid")


def of(theme):
    return {r.basin_id: r.asDict() for r in theme.summary.collect()}


def test_fields():
    assert len(schema.BASIN_FIELDS) == 171 and len(schema.LAYERS) == 16
    kinds = [k for _, k, _ in schema.BASIN_FIELDS]
    assert [kinds.count(k) for k in ("DOUBLE", "INT", "STRING", "BOOLEAN")] == [119, 25, 23, 4]
    assert [f for f in reshape.faults(schema.BASIN_FIELDS) if "begins like" not in f] == []
    assert schema.BASIN["surface_km2"].metadata == {"label": "Surface", "unit": "km²"}
    assert [len(schema.layer(n)) for n in schema.LAYERS] == [9, 12, 27, 7, 5, 6, 7, 2, 6, 5, 4, 4, 8, 5, 4, 8]


def test_land_cover(spark, basins):
    layer = polygons(spark, [((-5, 0, 5, 10), "311"), ((5, 0, 10, 5), "211"), ((5, 5, 10, 10), "312"), ((10, 0, 12, 2), "512")], "code_18 string")
    labels = spark.createDataFrame([("311", "Feuillus"), ("211", "Labours")], "code_18 string, libelle string")
    got = of(T.land_cover(layer, basins, labels))
    a, b = got["a"], got["b"]
    assert (a["ocs_foret_pct"], a["ocs_agri_pct"], a["ocs_eau_pct"], a["ocs_dominante"], a["ocs_dom_pct"]) == (75.0, 25.0, 0.0, "Feuillus", 50.0)
    assert b["ocs_foret_pct"] == 0.0 and b["ocs_dominante"] is None


def test_built_up_and_forest(spark, basins):
    buildings = polygons(spark, [((1, 1, 1.1, 1.1), 3), ((9.95, 5, 10.05, 5.1), 1)], "nombre_de_logements int")
    zones = polygons(spark, [((0, 0, 1, 1),)], "") if False else polygons(spark, [((0, 0, 1, 1), 1)], "one int")
    a = of(T.built_up(buildings, zones, basins))["a"]
    assert a["bati_nb"] == 2 and a["bati_ha"] == pytest.approx(1.5) and a["zone_hab_pct"] == pytest.approx(1.0)
    layer = polygons(spark, [((0, 0, 5, 2), "Forêt fermée Feuillus", "Chêne"), ((0, 2, 5, 3), "Lande", None)], "tfv_g11 string, essence string")
    theme = T.forest(layer, basins)
    a, b = of(theme)["a"], of(theme)["b"]
    assert (a["foret_pct"], a["peupl_pct"], a["foret_feui_pct"], a["foret_coni_pct"], a["foret_dom"]) == (15.0, 10.0, 10.0, None, "Forêt fermée Feuillus")
    assert (b["foret_ha"], b["peupl_pct"], b["foret_dom"]) == (0.0, 0.0, None)
    assert theme.details["forest"].count() == 2


def test_habitats(spark, basins):
    layer = polygons(spark, [((0, 0, 1, 1), "Prairie", "Légèrement humide", None), ((1, 0, 2, 1), "Marais", "Humide", "x"), ((2, 0, 3, 1), "", "Détrempé", None)], "nom_physio string, humidite_edaphique string, acidite_edaphique string")
    a, b = of(T.habitats(layer, basins))["a"], of(T.habitats(layer, basins))["b"]
    assert (a["chab_cov_pct"], a["chab_hum_pct"], a["chab_hum_ha"]) == (3.0, 2.0, 200.0)
    assert (b["chab_cov_pct"], b["chab_hum_pct"]) == (0.0, None)


def test_parcels(spark, basins):
    crops = spark.createDataFrame([("PPH", "Prairie permanente"), ("BTH", "Blé tendre")], "code string, libelle string")
    layer = polygons(spark, [((0, 0, 1, 1), "PPH", "PP"), ((1, 0, 3, 1), "BTH", "TA"), ((3, 0, 6, 1), "ZZZ", "??"), ((9, 9, 11, 11), "BTH", "TA")], "code_cultu string, cat_cult_p string")
    a, b = of(T.declared_parcels(layer, basins, crops))["a"], of(T.declared_parcels(layer, basins, crops))["b"]
    assert (a["rpg_nb"], a["rpg_ha"], a["rpg_med_ha"], a["rpg_moy_ha"]) == (4, 700.0, 150.0, 175.0)
    assert (a["herbe_ha"], a["rpg_cult_ha"], a["rpg_arable_pct"], a["rpg_perm_pct"]) == (100.0, 600.0, 3.0, None)
    assert a["rpg_dominante"] == "Blé tendre" or a["rpg_dominante"] == "Code non répertorié"
    assert (b["rpg_nb"], b["rpg_ha"], b["rpg_moy_ha"], b["herbe_ha"]) == (0, 0.0, None, None)
    bio = polygons(spark, [((0, 0, 1, 1), "true", "ab", "BTH"), ((1, 0, 2, 1), "1", "C2", "PPH"), ((2, 0, 4, 1), None, None, "BTH")], "bio string, cond_bio string, code_cultu string")
    theme = T.organic_parcels(bio, basins, crops)
    a = of(theme)["a"]
    assert (a["bio_ha"], a["conv_ha"], a["bio_nb"], a["bio_declare"]) == (100.0, 100.0, 2, 50.0)
    assert of(theme)["b"]["bio_declare"] is None and {r.stade for r in theme.details["organic_parcels"].collect()} == {"Certifiée agriculture biologique", "En conversion, 2e année"}


def test_areas_hedges_forests(spark, basins):
    layer = polygons(spark, [((0, 0, 1, 2), 1)], "one int")
    assert of(T.simple_area(layer, basins, "aoc"))["a"]["aoc_ha"] == 200.0
    hedge = lines(spark, [([(9, 9), (12, 9)], 1), ([(20, 20), (30, 20)], 2)], "id int")
    a = of(T.hedges(hedge, basins))["a"]
    assert (a["haies_km"], a["haies_dens"], a["haies_nb"]) == (1.0, 0.1, 1)
    onf = polygons(spark, [((0, 0, 1, 1), "OUI", "1", "D"), ((0, 0, 1, 1), "non", "2", None)], "cdom_frt string, iidtn_frt string, llib_frt string")
    theme = T.public_forests(onf, basins)
    assert of(theme)["a"]["onf_nb"] == 2 and {r.statut for r in theme.details["public_forests"].collect()} == {"domaniale", "collectivité"}


def test_zonings_count_overlaps_once(spark, basins):
    z = lambda rows: polygons(spark, rows, "nom_site string, id_mnhn string")
    theme = T.zonings({"zsc": [(z([((0, 0, 2, 2), "S1", "FR1"), ((1, 1, 3, 3), "S2", None)]), None)], "zps": [(z([((1, 1, 2, 2), "S3", "FR3")]), None)], "autres": [(z([((8, 8, 12, 12), "S4", "x")]), "réserve biologique")]}, basins)
    a, b = of(theme)["a"], of(theme)["b"]
    assert (a["zsc_ha"], a["zps_ha"], a["autres_ha"], a["zonage_ha"], a["zonage_nb"]) == (700.0, 100.0, 400.0, 1100.0, 4)
    assert a["znieff1_ha"] is None and (b["zonage_ha"], b["zonage_nb"], b["zsc_ha"]) == (0.0, 0, None)
    rows = {r.nom: r for r in theme.details["zonings"].collect()}
    assert rows["S1"].fiche.endswith("FR1") and rows["S2"].fiche is None and "S4 — réserve biologique" in rows


def test_points_in_basins(spark, basins):
    names = "CdObstEcoul NomPrincipalObstEcoul NomSecondaireObstEcoul LbTypeOuvrage CdTypeOuvrage LbEtOuvrage HautChutEtObstEcoul LbHautChutClObstEcoul LbTypeDispFranchPiscicole1 LbUsageObstEcoul1 GrenObstEcoul NomEntiteHydrographique".split()
    layer = points(spark, [(1, 1, "1", "A", None, None, "1.1", "Existant", "2.5", None, "Passe à bassins", None, "oui", "R"), (2, 2, "2", None, "B", "Seuil", None, "Détruit", "0", "De 0,5 à 1 m", "Absence de passe", None, "0", "R"), (10, 10, "3", None, None, None, None, "Existant", None, None, None, None, None, None), (20, 20, *["x"] * 12)], ", ".join(f"{n} string" for n in names))
    gauges = points(spark, [(3, 3, "Z9"), (4, 4, "A1")], "CdSiteHydro string")
    km = spark.createDataFrame([("a", 6.0)], "basin_id string, km double")
    theme = T.obstacles(layer, gauges, basins, km)
    a = of(theme)["a"]
    assert (a["roe_nb"], a["roe_exist_nb"], a["roe_grenelle"], a["roe_passe_nb"], a["sans_passe"], a["roe_h_cum_m"], a["roe_h_max_m"], a["roe_par_km"], a["hydro_codes"]) == (3, 2, 1, 1, 1, 3.25, 2.5, 0.5, "A1, Z9")
    b = of(theme)["b"]
    assert (b["roe_nb"], b["roe_h_cum_m"], b["hydro_codes"], b["sitehydro_nb"]) == (0, None, None, 0)
    assert [(r.code, r.provenance, r.passe, r.type) for r in theme.details["obstacles"].collect()][:2] == [("1", "mesuree", "oui", "Type Sandre 1.1"), ("2", "classe", "non", "Seuil")]


def test_plants(spark, basins):
    names = "CdOuvrageDepollution NomOuvrageDepollution CapaciteNom SomChrgMaxEntree CdEuZS NomZS LbNatureSystTraitementEauxUsees DateMiseServiceOuvrageDepollution DateMiseHorServiceOuvrageDepollution LbExistAutosurv LbConformiteAutosurveillance NomAgglomerationAssainissement LbCommuneLocalisation".split()
    row = lambda x, cap, zone, off: (x, 1, f"s{x}", "n", cap, "1500", zone, "Z", None, None, off, "Présence", None, None, None)
    layer = points(spark, [row(1, "2000", "FRHZS_00000", None), row(2, "100001", "S1", ""), row(3, "0", None, None), row(4, "5000", "S1", "2001-01-01")], ", ".join(f"{n} string" for n in names))
    theme = T.treatment_plants(layer, basins)
    a = of(theme)["a"]
    assert (a["steu_nb"], a["steu_service_nb"], a["steu_capa_tot_eh"], a["steu_sup2000_nb"], a["steu_zonesens_nb"]) == (4, 3, 102001.0, 2, 1)
    rows = {r.code: r for r in theme.details["treatment_plants"].collect()}
    assert (rows["s2"].nor_ngl, rows["s1"].nor_ngl, rows["s1"].nor_classe, rows["s3"].nor_dbo5, rows["s1"].taux_charge, rows["s1"].nom_zs) == (10.0, None, "≥ 2 000 EH", None, 75.0, None)


def test_withdrawals(spark):
    from rillflow.functions import projection as P

    x, y = (v[0] for v in P.to_metres(np.array([3.0]), np.array([46.5])))
    b = [x - 5000, y - 5000, x + 5000, y + 5000]
    basins = spark.createDataFrame([("a", 1e8, *map(float, b), bytearray(G.to_wkb(G.POLYGON, G.box(*b))))], f"basin_id string, area double, {BOX}")
    communes = spark.createDataFrame([("01001", *map(float, b), bytearray(G.to_wkb(G.POLYGON, G.box(*b))))], f"code_insee string, {BOX}")
    rec = [("w1", 2019, 5.0, "AEP eau potable", 3.0, 46.5, 0), ("w1", 2020, 7.0, "AEP eau potable", 3.0, 46.5, 1), ("w1", 2020, 9.0, "x", 3.0, 46.5, 2), ("w2", 2018, None, None, 3.001, 46.5, 3), ("w3", None, 1.0, "x", 3.0, 46.5, 4), ("w4", 2020, 1.0, "x", 9.0, 46.5, 5)]
    records = spark.createDataFrame([("01001", c, a, v, u, "n", "c", lon, lat, o) for c, a, v, u, lon, lat, o in rec], "code_commune string, code_ouvrage string, annee int, volume double, libelle_usage string, nom_ouvrage string, nom_commune string, longitude double, latitude double, ord long")
    theme = T.withdrawals(records, communes, basins)
    a = of(theme)["a"]
    assert (a["preleve_nb"], a["preleve_vol_m3"], a["preleve_an"], a["aep_nb"], a["aep_vol_m3"]) == (2, 7.0, 2020, 1, 7.0)


def test_population_and_occurrences(spark, basins):
    communes = polygons(spark, [((-10, 0, 5, 10), "A", "A", 300), ((5, 0, 10, 10), "B", "B", 80), ((10, 0, 12, 10), "C", "C", 10)], "code_insee string, nom_officiel string, population long")
    homes = polygons(spark, [((-1, 1, -0.9, 1.1), 10), ((1, 1, 1.1, 1.1), 5), ((4.9, 5, 5.1, 5.1), 4), ((6, 6, 6.1, 6.1), 0)], "nombre_de_logements int")
    theme = T.population(communes, homes, basins)
    assert of(theme)["a"]["population_est"] == pytest.approx(300 * 9 / 19 + 80 * 0 / 4)
    assert of(theme)["b"]["population_est"] is None
    layer = points(spark, [(1, 1, 10, [1, 359, 734], "PRESENT", False), (1, 1, 10, [1, 359], None, None), (1, 1, 11, [6], "PRESENT", None), (1, 1, 12, [6], "ABSENT", None), (1, 1, 13, [6], "PRESENT", True)], "speciesKey long, lineage array<int>, occurrenceStatus string, hasGeospatialIssue boolean")
    theme = T.occurrences(layer, basins)
    assert (of(theme)["a"]["gbif_obs_nb"], of(theme)["a"]["gbif_esp_nb"], of(theme)["b"]["gbif_obs_nb"]) == (3, 2, 0)
    assert {r.groupe: (r.observations, r.especes) for r in theme.details["occurrence_groups"].collect()} == {"mammiferes": (2, 1), "chiropteres": (1, 1), "plantes": (1, 1)}


def test_water(spark, basins):
    outlets = points(spark, [(5, 5, "a"), (30, 30, "b")], "basin_id string").drop("ord")
    me = polygons(spark, [((0, 0, 4.9, 10), "M1", None, "n1", "12.5", "1"), ((0, 0, 20, 20), "M2", None, "n2", None, "1"), ((30.1, 29, 40, 40), "M3", None, "n3", None, "1")], "CdEuMasseDEau string, CdMasseDEau string, NomBVSpeMDO string, SurfaceBVSpeMDO string, CdCategorieMasseDEau string")
    so = polygons(spark, [((0, 0, 9, 9), "G1", None, "big", "libre", "0", "900"), ((0, 0, 9, 9), "G2", None, "small", "captif", "1", "10"), ((0, 0, 9, 9), "G3", None, "unknown", None, None, None)], "CdEuMasseDEau string, CdMasseDEau string, NomMasseDEau string, NatureEcoulement string, Karstique string, SurfaceAffKm string")
    her = polygons(spark, [((0, 0, 9, 9), "21", "Massif")], "CdHER1 string, NomHER1 string")
    got = of(T.water_bodies(me, so, her, polygons(spark, [((0, 0, 9, 9), "58", "Haut")], "CdHER string, NomHER string"), outlets))
    assert (got["a"]["me_code_eu"], got["a"]["me_exut_dedans"], got["b"]["me_code_eu"], got["b"]["me_exut_dedans"]) == ("M2", True, "M3", False)
    assert (got["a"]["meso_code_eu"], got["a"]["meso_karst"], got["a"]["her1_code"], got["a"]["her2_nom"], got["b"]["her1_code"]) == ("G2", True, "21", "Haut", None)
    sage = polygons(spark, [((0, 0, 5, 10), "S1"), ((4, 0, 6, 10), "S2"), ((9.99, 0, 20, 1), "edge")], "NomZone string")
    reaches = lines(spark, [([(1, 1), (3, 1)], "R", "r1", "n"), ([(3, 1), (4, 1)], "R", "r2", "n"), ([(9, 9), (11, 9)], None, "r3", "m")], "cdentcru string, id string, lbentcru string")
    stations = points(spark, [(2, 2, "s", "l", "e")], "id string, lbentcru string, lbentitehy string")
    theme = T.water_management(sage, reaches, stations, basins)
    a = of(theme)["a"]
    assert (a["sage_nom"], a["vigi_km"], a["vigi_st_nb"]) == ("S1, S2", 4.0, 1) and a["sage_pct"] == pytest.approx(60.01)
    assert of(theme)["b"]["sage_nom"] is None and theme.details["flood_reaches"].count() == 2


def test_pressures(spark, basins):
    casias = points(spark, [(1, 1, "c", "m", "n", "e", "x", "f")], "code_inventaire string, code_metier string, nom_etablissement string, etat_activite string, nom_commune string, fiche_risque string")
    instr = points(spark, [(1, 1, "i", "n", "s", "x", "f"), (70, 70, "j", "n", "s", "x", "f")], "id_inventaire_instruction string, nom_etablissement string, statut_instruction string, nom_commune string, fiche_risque string")
    irep = points(spark, [(51, 51, "e", "a", "n", "c")], "idetab string, codeape string, nom string, nom_commune string")
    sis = polygons(spark, [((0, 0, 1, 1), "k", None, "n", "c")], "id_inventaire_classification string, identifiant string, nom string, nom_commune string")
    theme = T.pressures(casias, instr, sis, irep, basins)
    got = of(theme)
    assert [got["a"][c] for c in ("basias_nb", "basol_nb", "sis_nb", "sis_ha", "irep_nb")] == [1, 1, 1, 100.0, 0]
    assert [got["b"][c] for c in ("basias_nb", "sis_ha", "irep_nb")] == [0, 0.0, 1]
    assert theme.details["pollution_sites"].count() == 3


def valley_points(n=120, cell=25.0):
    """Elevation of a valley that runs south along x = n/2 cells, between ridges."""
    r, c = np.indices((n, n))
    z = 900 + 4.0 * np.minimum(np.abs(c - n // 2), n - np.abs(c - n // 2)) - 1.5 * np.abs(r - 12) + np.random.default_rng(3).random((n, n)) / 10
    return [((c0 + 0.5) * cell, (n - r0 - 0.5) * cell, float(z[r0, c0])) for r0 in range(n) for c0 in range(n)]


def test_batch(spark, tmp_path):
    n, cell = 120, 25.0
    x = (n // 2 + 0.5) * cell
    top = n * cell
    ys = [top - k * cell for k in (16, 40, 70, 90)]
    reach = [([(x / 1000, ys[i] / 1000), (x / 1000, ys[i + 1] / 1000)], f"r{i}", "Ecoulement", "Sens direct", f"n{i}", f"n{i + 1}", "Ruisseau", "C1", "perm", "petit") for i in range(3)]
    reaches = lines(spark, reach, "id string, nature string, direction string, ini string, fin string, nom string, code_hydro string, persistance string, largeur string")
    elevation = spark.createDataFrame(valley_points(n, cell), "x double, y double, z double")
    outlets = spark.createDataFrame([("a", x + 20, ys[2] - 5 * cell), ("far", 9e6, 9e6), ("nowhere", None, None)], "basin_id string, x double, y double")
    cover = polygons(spark, [((0, 0, 3, 3), "311")], "code_18 string")
    labels = spark.createDataFrame([("311", "Feuillus")], "code_18 string, libelle string")

    def themes(shapes, net):
        return {"network": lambda: T.network(reaches, shapes, net), "land cover": lambda: T.land_cover(cover, shapes, labels), "broken": lambda: T.hedges(cover.drop("geom"), shapes)}

    result = B.batch(spark, outlets, reaches, elevation, cell, themes, "2024-01-01", stream_cells=40)
    rows = result.row.collect()
    assert result.row.columns == [n for n, _, _ in schema.BASIN_FIELDS] and [r.id_bv for r in rows] == ["a"]
    r = rows[0]
    assert r.surface_km2 > 1 and r.gravelius > 1 and r.ocs_foret_pct == pytest.approx(100, abs=1) and r.lin_hydro_km > 1.2 and 0 < r.dens_drainage < 3
    assert r.reseau_dedans == pytest.approx(100, abs=1) and r.dist_reseau_m == pytest.approx(20) and math.isclose(r.x_clic, x + 20) and r.long_chem_km > 1
    assert [w.split(":")[0] for w in result.warnings] == ["broken"]
    assert {x.basin_id for x in result.refusals.collect()} == {"far"}
    written = B.write(result, str(tmp_path / "out"))
    assert {"basins", "streams", "outlets"} <= set(written)
    assert ledger.rows(spark, str(tmp_path / "out"), "streams").count() == 3
    for _ in range(2):
        B.write(result, str(tmp_path / "named"), "night")
    assert ledger.rows(spark, str(tmp_path / "named"), "streams").count() == 3 and ledger.rows(spark, str(tmp_path / "named"), "basins").count() == 1
    assert B.summary_text(result.row).first().resume.startswith("Bassin a : ")


def test_second_pass(spark):
    cell, fine = 50.0, 25.0
    n = 120
    x, top = (n // 2 + 0.5) * fine, n * fine
    ys = [top - k * fine for k in (16, 40, 70, 90)]
    reach = [([(x / 1000, ys[i] / 1000), (x / 1000, ys[i + 1] / 1000)], f"r{i}", "Ecoulement", "Sens direct", f"n{i}", f"n{i + 1}") for i in range(3)]
    reaches = lines(spark, reach, "id string, nature string, direction string, ini string, fin string")
    z = spark.createDataFrame(valley_points(n, fine), "x double, y double, z double")
    coarse = z.groupBy((F.floor(F.col("x") / cell) * cell + cell / 2).alias("x"), (F.floor(F.col("y") / cell) * cell + cell / 2).alias("y")).agg(F.avg("z").alias("z"))
    outlets = spark.createDataFrame([("a", x, ys[2] - 5 * fine)], "basin_id string, x double, y double")
    extents, net = B.upstream_extents(outlets, reaches)
    found = B.delineated(outlets, extents, net, reaches, coarse, cell, 10)
    first = found.first()
    assert first.refusal is None
    args = (outlets, extents, net, reaches)
    rows = B.refined(found, *args, {fine: z, cell: coarse}, cell, 10**7, 10_000.0, 40).collect()
    assert len(rows) == 1 and rows[0].step == fine and rows[0].margin == 10_000.0 and rows[0].area_before == first.area
    assert rows[0].area == pytest.approx(first.area, rel=0.15) and rows[0].cells > 3 * first.cells
    assert B.refined(found, *args, {fine: z}, cell, 100, 200.0, 40).count() == 0  # nothing finer fits
    assert B.refined(found, *args, {cell: coarse}, cell, 10**7, 200.0, 40).count() == 0  # nothing finer is there


def test_seed_extents(spark):
    zones = polygons(spark, [((0, 0, 10, 10), "Z", "K1")], "toponyme string, code_bdcarthage string")
    out = spark.createDataFrame([("a", 5000.0, 5000.0), ("b", 90000.0, 0.0)], "basin_id string, x double, y double")
    got = {r.basin_id: r for r in B.seed_extents(out, zones).collect()}
    assert (got["a"].zone_hydro, got["a"].xmin, got["a"].ymax, got["b"].zone_hydro, got["b"].xmin, got["b"].ymax) == ("Z", -2000.0, 12000.0, None, 85000.0, 5000.0)
