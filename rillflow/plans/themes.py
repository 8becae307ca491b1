"""Themes: what lies within basins, for all basins at once.

A theme takes layers and basins (basin_id, geom, box, area in m2) and returns a summary, one row a basin with
the columns of the basin row, and detail layers. A basin in which nothing is found has its row too:
0 where absence is a measure, null where it is not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.operators import aggregates as A
from rillflow.operators import spatial
from rillflow.plans.schema import ZONINGS
from rillflow.sources import layers

HA = 1e4
#: Side of the tiles in which shapes meet, in metres.
TILE = 2000.0
DETAIL = 500

# First digit of a land-cover code and the basin column; wooded groups; wet soils; parcel categories; stages.
LAND_COVER = {"1": "ocs_artif_pct", "2": "ocs_agri_pct", "3": "ocs_foret_pct", "4": "ocs_humide_pct", "5": "ocs_eau_pct"}
WOODED = {"foret_feui_pct": "feuillus", "foret_coni_pct": "conifères", "foret_mixt_pct": "mixte"}
WET = ("humide", "détrempé", "aquatique")
CATEGORIES = {"TA": "Terres arables", "CP": "Cultures permanentes", "PP": "Prairies permanentes"}
STAGES = {"AB": "Certifiée agriculture biologique", "C1": "En conversion, 1re année", "C2": "En conversion, 2e année", "C3": "En conversion, 3e année"}
TAXA = {"plantes": 6, "champignons": 5, "insectes": 216, "arachnides": 367, "mollusques": 52, "crustaces": 229, "poissons": 204, "amphibiens": 131, "reptiles": 358, "oiseaux": 212, "mammiferes": 359, "chiropteres": 734}
WITHDRAWAL_DETAIL, COMMUNE_DETAIL, HEDGES, HABITATS, CROPS = 300, 200, 200_000, 100_000, 12
SAGE_LEAST, WATER_REACH = 1.0, 250.0


@dataclass
class Theme:
    summary: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)


def _all(basins: DataFrame, found: DataFrame, **fill: Column | float | int) -> DataFrame:
    """One row a basin; of columns in ``fill`` a missing value becomes the given one."""
    out = basins.select("basin_id").join(found, "basin_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in fill.items()}) if fill else out


def _overlay(layer: DataFrame, basins: DataFrame) -> DataFrame:
    """Overlaps as (basin_id, whole: the basin's area, overlap, the layer's columns, geom)."""
    met = spatial.overlay(layer, basins, TILE)
    keep = [c for c in layer.columns if c not in spatial.BOX]
    return met.select(F.col("r_basin_id").alias("basin_id"), F.col("r_area").alias("whole"), "overlap", *keep, "r_geom", *spatial.BOX, *[f"r_{c}" for c in spatial.BOX])


def _points(layer: DataFrame, basins: DataFrame) -> DataFrame:
    """Points within basins (touching included), the basin's id in front."""
    met = spatial.pairs(spatial.as_points(layer, "x", "y").withColumn("geom", spatial.point_wkb("x", "y")), basins, TILE)
    return met.where(spatial.point_in("geom", "r_geom") == 1).select(F.col("r_basin_id").alias("basin_id"), *layer.columns)


def _pct(c: str | Column, whole: str = "whole") -> Column:
    return A.share(F.col(c) if isinstance(c, str) else c, F.col(whole))


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("id_bv", F.col("basin_id").cast("string"))


def _shares(over: DataFrame, label: str) -> DataFrame:
    """Classes by basin, largest first, with whole."""
    sums = over.groupBy("basin_id", "whole", label).agg(A.exact_sum("overlap").alias("area"), F.count("*").alias("n"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("basin_id").orderBy(F.desc("area"), label)))


def _largest(shares: DataFrame, label: str, name: str, pct: str) -> DataFrame:
    return shares.where("rank = 1").select("basin_id", F.col(label).alias(name), _pct("area").alias(pct))


def land_cover(layer: DataFrame, basins: DataFrame, labels: DataFrame) -> Theme:
    """Corine classes: shares at both levels; absent classes are 0, as the layer covers everything."""
    over = _overlay(layer, basins)
    shares = A.labelled(_shares(over, "code_18"), labels, "code_18", "libelle")
    first = over.withColumn("c1", F.substring("code_18", 1, 1)).groupBy("basin_id", "whole").agg(*[_pct_sum(F.col("c1") == k).alias(n) for k, n in LAND_COVER.items()])
    level1 = first.select("basin_id", *[_pct(n).alias(n) for n in LAND_COVER.values()])
    top = _largest(shares, "libelle", "ocs_dominante", "ocs_dom_pct")
    return Theme(_all(basins, level1.join(top, "basin_id", "left"), **dict.fromkeys(LAND_COVER.values(), 0.0)), {"land_cover": shares.withColumn("part_pct", _pct("area"))})


def _pct_sum(condition: Column) -> Column:
    return A.exact_sum(F.when(condition, F.col("overlap")).otherwise(0.0))


def built_up(buildings: DataFrame, settlements: DataFrame, basins: DataFrame) -> Theme:
    def total(layer: DataFrame, area: str, n: str) -> DataFrame:
        return _overlay(layer, basins).groupBy("basin_id").agg(A.exact_sum("overlap").alias(area), F.count("*").alias(n))

    both = basins.select("basin_id", F.col("area").alias("whole")).join(total(buildings, "b", "bati_nb"), "basin_id", "left").join(total(settlements, "s", "zones"), "basin_id", "left")
    b, s = F.coalesce("b", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return Theme(both.select("basin_id", (b / HA).alias("bati_ha"), _pct(b).alias("bati_pct"), F.coalesce("bati_nb", F.lit(0)).alias("bati_nb"), _pct(s).alias("zone_hab_pct")))


def forest(layer: DataFrame, basins: DataFrame) -> Theme:
    """Cover by formation; wooded stands by word of the formation; a group that is absent is null."""
    over = _overlay(layer, basins).withColumn("formation", F.coalesce(S.blank_as_null("tfv_g11"), F.lit("")))
    name = F.lower("formation")
    groups = {n: name.contains(w) for n, w in WOODED.items()}
    total = over.groupBy("basin_id", "whole").agg(A.exact_sum("overlap").alias("t"), *[_pct_sum(c).alias(n) for n, c in groups.items()])
    wooded = sum((F.col(n) for n in groups), F.lit(0.0))
    rows = total.select("basin_id", (F.col("t") / HA).alias("foret_ha"), _pct("t").alias("foret_pct"), (wooded / HA).alias("peupl_ha"), _pct(wooded).alias("peupl_pct"), *[_pct(F.nullif(F.col(n), F.lit(0.0))).alias(n) for n in groups])
    top = _largest(_shares(over, "formation"), "formation", "foret_dom", "foret_dom_pct")
    detail = _id(over).select("id_bv", "formation", S.blank_as_null("essence").alias("essence"), (F.col("overlap") / HA).alias("surface_ha"), _pct("overlap").alias("part_pct"))
    return Theme(_all(basins, rows.join(top, "basin_id", "left"), foret_ha=0.0, foret_pct=0.0, peupl_ha=0.0, peupl_pct=0.0), {"forest": detail})


def habitats(layer: DataFrame, basins: DataFrame) -> Theme:
    """Physiognomy and soil moisture; moist by how the label begins; null without coverage."""
    over = _overlay(layer, basins).withColumns(
        {"physio": S.first_nonempty("nom_physio", default="Physionomie non renseignée"), "humidite": S.first_nonempty("humidite_edaphique", default="Humidité non renseignée"), "acidite": S.blank_as_null("acidite_edaphique")}
    )
    wet = F.lit(False)
    for start in WET:
        wet = wet | F.lower("humidite").startswith(start)
    total = over.groupBy("basin_id", "whole").agg(A.exact_sum("overlap").alias("t"), _pct_sum(wet).alias("wet"))
    rows = total.select("basin_id", _pct("t").alias("chab_cov_pct"), (F.col("wet") / HA).alias("chab_hum_ha"), _pct("wet").alias("chab_hum_pct"))
    top = _largest(_shares(over, "physio"), "physio", "chab_dom", "chab_dom_pct")
    detail = _id(A.capped(over, ["basin_id"], [F.col("ord")], HABITATS)).select("id_bv", "physio", "humidite", "acidite", (F.col("overlap") / HA).alias("surface_ha"), "truncated")
    return Theme(_all(basins, rows.join(top, "basin_id", "left"), chab_cov_pct=0.0), {"habitats": detail})


def declared_parcels(layer: DataFrame, basins: DataFrame, crops: DataFrame) -> Theme:
    """Declared farming. Sizes of no parcel are null; categories outside the list fall together; crops past the first twelve are left out."""
    category = F.when(F.trim("cat_cult_p").isin(*CATEGORIES), F.trim("cat_cult_p")).otherwise(F.lit(""))
    over = _overlay(layer, basins).withColumns({"code": F.coalesce(F.trim("code_cultu"), F.lit("")), "cat": category})
    named = crops.select(F.col("code").alias("_c"), S.blank_as_null("libelle").alias("_l")).dropDuplicates(["_c"])
    over = over.join(named, F.col("code") == F.col("_c"), "left").withColumn("grass", S.is_grass("_l", "cat"))
    total = over.groupBy("basin_id", "whole").agg(
        A.exact_sum("overlap").alias("t"),
        F.count("*").alias("rpg_nb"),
        F.median("overlap").alias("med"),
        _pct_sum(F.col("grass")).alias("g"),
        _pct_sum(~F.col("grass")).alias("c"),
        *[A.exact_sum(F.when(F.col("cat") == k, F.col("overlap"))).alias(k) for k in CATEGORIES],
    )
    rows = total.select(
        "basin_id", (F.col("t") / HA).alias("rpg_ha"), _pct("t").alias("rpg_pct"), "rpg_nb", (F.col("t") / F.col("rpg_nb") / HA).alias("rpg_moy_ha"), (F.col("med") / HA).alias("rpg_med_ha"),
        (F.col("g") / HA).alias("herbe_ha"), _pct("g").alias("herbe_pct"), A.share(F.col("g"), F.col("t")).alias("herbe_part_declare"), (F.col("c") / HA).alias("rpg_cult_ha"), _pct("c").alias("rpg_cult_pct"),
        A.share(F.col("c"), F.col("t")).alias("cultures_part_declare"), _pct("TA").alias("rpg_arable_pct"), _pct("CP").alias("rpg_perm_pct"), _pct("PP").alias("rpg_prairie_pct"),
    )
    shares = _shares(over.withColumn("crop", F.coalesce("_l", F.lit("Code non répertorié"))), "code").where(F.col("rank") <= CROPS)
    crop = A.labelled(shares, crops.select("code", "libelle"), "code", "libelle", "Code non répertorié").withColumn("part_pct", _pct("area"))
    top = _largest(crop, "libelle", "rpg_dominante", "rpg_dom_pct")
    kind = F.coalesce(*[F.when(F.col("cat") == k, F.lit(v)) for k, v in CATEGORIES.items()], F.lit("Catégorie non renseignée"))
    detail = _id(over).select("id_bv", "code", F.coalesce("_l", "code").alias("culture"), kind.alias("categorie"), F.when(F.col("grass"), F.lit("herbe")).otherwise(F.lit("culture")).alias("nature"), (F.col("overlap") / HA).alias("surface_ha"), _pct("overlap").alias("part_pct"))
    return Theme(_all(basins, rows.join(top, "basin_id", "left"), rpg_ha=0.0, rpg_pct=0.0, rpg_nb=0), {"declared_parcels": detail, "crops": crop})


def organic_parcels(layer: DataFrame, basins: DataFrame, crops: DataFrame) -> Theme:
    """Certified and converting land; the declared share counts every parcel, organic or not; any stage but AB is conversion."""
    over = _overlay(layer, basins).withColumns({"organic": S.blank_as_null(F.col("bio").cast("string")).isNotNull() & ~F.coalesce(F.lower(F.trim(F.col("bio").cast("string"))).isin("0", "false", "non"), F.lit(False)), "stage": F.coalesce(F.upper(F.trim("cond_bio")), F.lit(""))})
    certified = F.col("organic") & (F.col("stage") == "AB")
    total = over.groupBy("basin_id", "whole").agg(_pct_sum(certified).alias("ab"), _pct_sum(F.col("organic") & (F.col("stage") != "AB")).alias("cv"), A.exact_sum("overlap").alias("t"), F.count_if("organic").alias("bio_nb"))
    rows = total.select("basin_id", (F.col("ab") / HA).alias("bio_ha"), _pct("ab").alias("bio_pct"), (F.col("cv") / HA).alias("conv_ha"), _pct("cv").alias("conv_pct"), "bio_nb", A.share(F.col("ab") + F.col("cv"), F.col("t")).alias("bio_declare"))
    stage = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in STAGES.items()], F.nullif(F.col("stage"), F.lit("")), F.lit("Non précisé"))
    named = A.labelled(over.where("organic").withColumn("code", F.coalesce(F.trim("code_cultu"), F.lit(""))), crops.select("code", F.col("libelle").alias("culture")), "code", "culture")
    detail = _id(named).select("id_bv", F.when(F.col("stage") == "AB", F.lit("Certifiée AB")).otherwise(F.lit("En conversion")).alias("statut"), stage.alias("stade"), "culture", (F.col("overlap") / HA).alias("surface_ha"), _pct("overlap").alias("part_pct"))
    return Theme(_all(basins, rows, bio_ha=0.0, bio_pct=0.0, conv_ha=0.0, conv_pct=0.0, bio_nb=0), {"organic_parcels": detail})


def simple_area(layer: DataFrame, basins: DataFrame, prefix: str) -> Theme:
    total = _overlay(layer, basins).groupBy("basin_id", "whole").agg(A.exact_sum("overlap").alias("t"))
    rows = total.select("basin_id", (F.col("t") / HA).alias(f"{prefix}_ha"), _pct("t").alias(f"{prefix}_pct"))
    return Theme(_all(basins, rows, **{f"{prefix}_ha": 0.0, f"{prefix}_pct": 0.0}))


def hedges(layer: DataFrame, basins: DataFrame) -> Theme:
    met = spatial.lines_in(layer, basins, TILE).where("inside > 0").withColumns({"basin_id": F.col("r_basin_id"), "whole": F.col("r_area")})
    total = met.groupBy("basin_id", "whole").agg(A.exact_sum("inside").alias("m"), F.count("*").alias("haies_nb"))
    rows = total.select("basin_id", (F.col("m") / 1000).alias("haies_km"), F.try_divide(F.col("m"), F.col("whole") / HA).alias("haies_dens"), "haies_nb")
    detail = _id(A.capped(met, ["basin_id"], [F.col("ord")], HEDGES)).select("id_bv", F.col("inside").alias("longueur_m"), "truncated")
    return Theme(_all(basins, rows, haies_km=0.0, haies_dens=0.0, haies_nb=0), {"hedges": detail})


def public_forests(layer: DataFrame, basins: DataFrame) -> Theme:
    over = _overlay(layer, basins)
    total = over.groupBy("basin_id", "whole").agg(A.exact_sum("overlap").alias("t"), F.count("*").alias("onf_nb"))
    rows = total.select("basin_id", (F.col("t") / HA).alias("onf_ha"), _pct("t").alias("onf_pct"), "onf_nb")
    state = F.when(F.upper("cdom_frt") == "OUI", F.lit("domaniale")).otherwise(F.lit("collectivité"))
    detail = _id(over).select("id_bv", F.col("iidtn_frt").alias("code"), S.first_nonempty("llib_frt", default="Forêt publique").alias("nom"), state.alias("statut"), (F.col("overlap") / HA).alias("surface_ha"), _pct("overlap").alias("part_pct"))
    return Theme(_all(basins, rows, onf_ha=0.0, onf_pct=0.0, onf_nb=0), {"public_forests": detail})


def _inside(over: DataFrame) -> DataFrame:
    """Overlaps with the shape cut to the basin, and the box of that."""
    lo = {c: F.greatest(F.col(c), F.col(f"r_{c}")) for c in ("xmin", "ymin")}
    hi = {c: F.least(F.col(c), F.col(f"r_{c}")) for c in ("xmax", "ymax")}
    return over.withColumns({"geom": spatial.clipped("geom", "r_geom"), **lo, **hi})


def zonings(layers_by_key: dict[str, list[tuple[DataFrame, str | None]]], basins: DataFrame) -> Theme:
    """Protected areas: per kind and over all kinds the area of the union, never the sum; kinds without site are null.

    Layers by key, several to a key with a sublabel each; sites carry name, code and link under any of their columns.
    """
    parts = []
    for key, several in layers_by_key.items():
        for layer, sub in several:
            have = lambda *names, layer=layer: S.first_nonempty(*[n for n in names if n in layer.columns] or [F.lit(None)])
            parts.append(layer.select("geom", *spatial.BOX, F.lit(key).alias("cle"), F.lit(sub).cast("string").alias("sub"), have("nom_site", "type_zone", "projet", "NOM_ZH").alias("site"), have("id_mnhn", "id_local", "identifiant", "CODE_ZH").alias("code"), have("url_fiche").alias("url")))
    sites = parts[0]
    for p in parts[1:]:
        sites = sites.unionByName(p)
    over = _inside(_overlay(sites, basins))
    names = {k: (label, nature) for k, label, nature in ZONINGS}
    by_key = spatial.union_areas(over, ["basin_id", "cle"], TILE)
    total = spatial.union_areas(over, ["basin_id"], TILE).select("basin_id", F.col("area").alias("t"))
    count = over.groupBy("basin_id").agg(F.count("*").alias("zonage_nb"))
    whole = basins.select("basin_id", F.col("area").alias("whole"))
    wide = by_key.groupBy("basin_id").agg(*[F.sum(F.when(F.col("cle") == k, F.col("area"))).alias(k) for k in names])
    cap = lambda c: F.least(F.lit(100.0), _pct(c))
    cols = [x for k in names for x in ((F.col(k) / HA).alias(f"{k}_ha"), cap(k).alias(f"{k}_pct"))]
    rows = whole.join(wide, "basin_id", "left").join(total, "basin_id", "left").join(count, "basin_id", "left")
    t = F.coalesce("t", F.lit(0.0))
    rows = rows.select("basin_id", *cols, (t / HA).alias("zonage_ha"), cap(t).alias("zonage_pct"), F.coalesce("zonage_nb", F.lit(0)).alias("zonage_nb"))
    text = lambda i: F.coalesce(*[F.when(F.col("cle") == k, F.lit(v[i])) for k, v in names.items()])
    title = F.when(F.col("sub").isNotNull(), F.concat_ws(" — ", "site", F.col("sub"))).otherwise(F.col("site"))
    detail = _id(over).select("id_bv", text(0).alias("zonage"), "cle", text(1).alias("nature"), title.alias("nom"), "code", (F.col("overlap") / HA).alias("surface_ha"), _pct("overlap").alias("part_pct"), F.coalesce("url", S.natura_link("cle", "code")).alias("fiche"))
    return Theme(rows, {"zonings": detail})


def _ranked(df: DataFrame, order: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows a basin, largest first, unknown as 0, then in service order."""
    return A.top(df, ["basin_id"], [F.coalesce(order, F.lit(0.0)).desc(), F.col("ord")], cap)


def obstacles(layer: DataFrame, gauges: DataFrame, basins: DataFrame, stream_km: DataFrame) -> Theme:
    """River obstacles and gauging sites; heights of 0 are unknown; density counts all obstacles (stream_km: basin_id, km)."""
    height, origin = S.height_from_text("HautChutEtObstEcoul", "LbHautChutClObstEcoul")
    rows = _points(layer, basins).withColumns(
        {"chute_m": height, "provenance": origin, "passe_b": S.fish_pass("LbTypeDispFranchPiscicole1"), "exist": F.coalesce(F.lower(F.trim("LbEtOuvrage")).startswith("existant"), F.lit(False)), "grenelle": S.as_bool("GrenObstEcoul")}
    )
    known = F.nullif(F.col("chute_m"), F.lit(0.0))
    total = rows.groupBy("basin_id").agg(
        F.count("*").alias("roe_nb"), F.count_if("exist").alias("roe_exist_nb"), F.count_if("grenelle").alias("roe_grenelle"), F.count_if("passe_b").alias("roe_passe_nb"), F.count_if(~F.col("passe_b")).alias("sans_passe"), A.exact_sum(known).alias("roe_h_cum_m"), F.max(known).alias("roe_h_max_m")
    )
    g = _points(gauges, basins).groupBy("basin_id").agg(F.count("*").alias("sitehydro_nb"), A.joined_text("CdSiteHydro", "CdSiteHydro").alias("hydro_codes"))
    out = _all(basins, total.join(stream_km, "basin_id", "left").withColumn("roe_par_km", F.try_divide("roe_nb", "km")).drop("km"), roe_nb=0, roe_exist_nb=0, roe_grenelle=0, roe_passe_nb=0)
    detail = _id(_ranked(rows, F.col("chute_m"), DETAIL)).select(
        "id_bv", F.col("CdObstEcoul").alias("code"), S.first_nonempty("NomPrincipalObstEcoul", "NomSecondaireObstEcoul").alias("nom"), S.type_label("LbTypeOuvrage", "CdTypeOuvrage").alias("type"), F.col("LbEtOuvrage").alias("etat"), "chute_m", "provenance",
        F.col("LbHautChutClObstEcoul").alias("classe"), S.yes_no("passe_b").alias("passe"), F.col("LbUsageObstEcoul1").alias("usage"), "grenelle", F.col("NomEntiteHydrographique").alias("cours_eau"),
    )
    return Theme(_all(basins, out.join(g, "basin_id", "left"), sitehydro_nb=0), {"obstacles": detail})


def treatment_plants(layer: DataFrame, basins: DataFrame) -> Theme:
    """Plants with the discharge limits that apply; totals over those in service."""
    rows = _points(layer, basins).withColumns({"cap": S.capacity("CapaciteNom"), "load": S.as_float("SomChrgMaxEntree"), "zone": S.sensitive_zone("CdEuZS"), "live": S.blank_as_null("DateMiseHorServiceOuvrageDepollution").isNull()})
    live = F.col("live")
    total = rows.groupBy("basin_id").agg(
        F.count("*").alias("steu_nb"), F.count_if(live).alias("steu_service_nb"), A.exact_sum(F.when(live, F.col("cap"))).alias("steu_capa_tot_eh"), F.count_if(live & (F.col("cap") >= S.CAPACITY_LARGE)).alias("steu_sup2000_nb"),
        F.count_if(live & F.col("zone")).alias("steu_zonesens_nb"), F.count_if(live & F.lower("LbExistAutosurv").startswith("prés")).alias("autosurv_nb"),
    )
    norms = S.discharge_norms("cap", "zone")
    short = {f"nor_{k}{'_r' if u == 'rdt_pct' else ''}": norms[f"norme_{k}_{u}"] for k in S.LIMITS for u in ("mg_l", "rdt_pct")}
    detail = _id(_ranked(rows, F.col("cap"), DETAIL)).select(
        "id_bv", F.col("CdOuvrageDepollution").alias("code"), F.col("NomOuvrageDepollution").alias("nom"), F.col("cap").alias("capacite_eh"), F.col("load").alias("charge_eh"), S.load_rate("cap", "load").alias("taux_charge"), F.col("LbNatureSystTraitementEauxUsees").alias("nature"),
        F.col("live").alias("en_service"), F.col("DateMiseServiceOuvrageDepollution").alias("date_serv"), F.col("LbExistAutosurv").alias("autosurv"), F.col("LbConformiteAutosurveillance").alias("conformite"), F.col("zone").alias("zone_sens"), F.when(F.col("zone"), S.blank_as_null("NomZS")).alias("nom_zs"),
        F.col("NomAgglomerationAssainissement").alias("agglo"), F.col("LbCommuneLocalisation").alias("commune"), norms["norme_classe"].alias("nor_classe"), *[c.alias(n) for n, c in short.items()], F.lit("arrêté du 21 juillet 2015, annexe III").alias("nor_source"),
    )
    return Theme(_all(basins, total, steu_nb=0, steu_service_nb=0, steu_sup2000_nb=0, steu_zonesens_nb=0), {"treatment_plants": detail})


def withdrawals(records: DataFrame, communes: DataFrame, basins: DataFrame) -> Theme:
    """Each works' latest year within the basin. Volumes unknown count 0; totals of none are null."""
    from rillflow.functions.projection import lambert93

    codes = spatial.features_in(communes, basins, TILE).select(F.col("code_insee").alias("code_commune"))
    near = layers.by_codes(records, codes, "code_commune") if "code_commune" in records.columns else records
    last = A.latest(near, ["code_ouvrage"], "annee", "ord").where("longitude is not null and latitude is not null").withColumn("p", lambert93("longitude", "latitude")).withColumns({"x": F.col("p.x"), "y": F.col("p.y")}).drop("p").where("x is not null")
    rows = _points(last, basins).withColumns({"v": F.coalesce("volume", F.lit(0.0)), "use": S.first_nonempty("libelle_usage", default="Usage non renseigné")})
    drink = F.lower("use").contains("potable")
    total = rows.groupBy("basin_id").agg(F.count("*").alias("preleve_nb"), A.exact_sum("v").alias("preleve_vol_m3"), F.max("annee").alias("preleve_an"), F.count_if(drink).alias("aep_nb"), A.exact_sum(F.when(drink, F.col("v"))).alias("aep_vol_m3"))
    by_use = rows.groupBy("basin_id", "use").agg(A.exact_sum("v").alias("volume_m3"))
    detail = _id(_ranked(rows, F.col("volume"), WITHDRAWAL_DETAIL)).select("id_bv", F.col("code_ouvrage").alias("code"), F.col("nom_ouvrage").alias("nom"), "annee", F.col("volume").alias("volume_m3"), F.col("libelle_usage").alias("usage"), F.col("nom_commune").alias("commune"))
    return Theme(_all(basins, total, preleve_nb=0), {"withdrawals": detail, "withdrawal_uses": by_use})


def population(communes: DataFrame, buildings: DataFrame, basins: DataFrame) -> Theme:
    """Residents by the share of a commune's housing that lies in the basin; a building counts for its first commune only.

    The ratio may pass 1, as a building at a border counts for two communes in the denominator; it is left so.
    """
    touched = spatial.features_in(communes, basins, TILE).select(F.col("r_basin_id").alias("basin_id"), F.col("r_area").alias("whole"), "code_insee", "nom_officiel", F.col("population").cast("double").alias("people"), F.col("ord").alias("commune_ord"), "geom", *spatial.BOX)
    homes = buildings.where("nombre_de_logements > 0")
    # housing of each commune touched
    places = touched.dropDuplicates(["code_insee"]).select("code_insee", "commune_ord", "geom", *spatial.BOX)
    within = spatial.pairs(homes, places, TILE).where(spatial.touching("geom", "r_geom") == 1)
    whole = within.groupBy(F.col("r_code_insee").alias("code_insee")).agg(F.sum("nombre_de_logements").alias("all_homes"))
    # buildings of the basin, each credited once
    mine = spatial.pairs(homes, basins, TILE).where(spatial.touching("geom", "r_geom") == 1).select(F.col("r_basin_id").alias("basin_id"), "fid", "nombre_de_logements")
    credit = mine.join(within.select("fid", F.col("r_code_insee").alias("code_insee"), F.col("r_commune_ord").alias("commune_ord")), "fid").join(touched.select("basin_id", "code_insee"), ["basin_id", "code_insee"], "left_semi")
    first = credit.withColumn("_r", F.row_number().over(Window.partitionBy("basin_id", "fid").orderBy("commune_ord"))).where("_r = 1")
    inside = first.groupBy("basin_id", "code_insee").agg(F.sum("nombre_de_logements").alias("homes"))
    rows = touched.join(whole, "code_insee", "left").join(inside, ["basin_id", "code_insee"], "left")
    rows = rows.withColumn("estimate", F.try_divide(F.col("people") * F.coalesce("homes", F.lit(0)), F.col("all_homes")))
    total = rows.groupBy("basin_id").agg(F.sum("estimate").alias("population_est"))
    detail = A.top(rows, ["basin_id"], [F.coalesce("estimate", F.lit(0.0)).desc(), F.col("commune_ord")], COMMUNE_DETAIL)
    return Theme(_all(basins, total), {"communes": detail.select("basin_id", "code_insee", "nom_officiel", "people", "estimate")})


def occurrences(layer: DataFrame, basins: DataFrame) -> Theme:
    """Sightings and species (present, without known fault of place), in all and by overlapping groups."""
    fine = layer.where("coalesce(occurrenceStatus, 'PRESENT') = 'PRESENT' and not coalesce(hasGeospatialIssue, false)")
    rows = _points(fine, basins)
    total = rows.groupBy("basin_id").agg(F.count("*").alias("gbif_obs_nb"), F.count_distinct("speciesKey").alias("gbif_esp_nb"))
    member = F.array_compact(F.array(*[F.when(F.array_contains("lineage", k), F.lit(n)) for n, k in TAXA.items()]))
    groups = rows.select("basin_id", F.explode(member).alias("groupe"), "speciesKey").groupBy("basin_id", "groupe").agg(F.count("*").alias("observations"), F.count_distinct("speciesKey").alias("especes"))
    return Theme(_all(basins, total, gbif_obs_nb=0, gbif_esp_nb=0), {"occurrence_groups": groups})


def water_bodies(catchments: DataFrame, aquifers: DataFrame, regions1: DataFrame, regions2: DataFrame, outlets: DataFrame) -> Theme:
    """Water body of each outlet (basin_id, x, y): the catchment that holds it, else the nearest whose box is near;
    the aquifer of smallest outcrop; the first eco-region of either level."""
    points = spatial.as_points(outlets, "x", "y").withColumn("geom", spatial.point_wkb("x", "y"))
    me = spatial.contained_or_nearest(points, catchments, "basin_id", "ord", WATER_REACH, TILE)
    me = me.select("basin_id", S.first_nonempty("r_CdEuMasseDEau", "r_CdMasseDEau").alias("me_code_eu"), F.col("r_NomBVSpeMDO").alias("me_nom"), S.as_float("r_SurfaceBVSpeMDO").alias("me_surface_km2"), F.col("r_CdCategorieMasseDEau").cast("string").alias("me_categorie"), F.col("exact").alias("me_exut_dedans"))
    held = lambda layer: spatial.pairs(points, layer, TILE).where(spatial.point_in("geom", "r_geom") == 1)
    area = F.coalesce(S.as_float("r_SurfaceAffKm"), F.lit(float("inf")))
    pick = F.struct(S.first_nonempty("r_CdEuMasseDEau", "r_CdMasseDEau").alias("code"), F.col("r_NomMasseDEau").alias("nom"), F.col("r_NatureEcoulement").alias("flow"), S.as_bool("r_Karstique").alias("karst"))
    so = held(aquifers).groupBy("basin_id").agg(F.min_by(pick, F.struct(area, "r_ord")).alias("a"), F.count("*").alias("n_aquifers")).select("basin_id", F.col("a.code").alias("meso_code_eu"), F.col("a.nom").alias("meso_nom"), F.col("a.flow").alias("meso_ecoul"), F.col("a.karst").alias("meso_karst"), "n_aquifers")
    out = me.join(so, "basin_id", "left")
    for k, layer in ((1, regions1), (2, regions2)):
        name = lambda *c, layer=layer: S.first_nonempty(*[f"r_{x}" for x in c if x in layer.columns])
        first = spatial.first_match(held(layer), "basin_id", "r_ord").select("basin_id", name(f"CdHER{k}", "CdHER").alias(f"her{k}_code"), name(f"NomHER{k}", "NomHER").alias(f"her{k}_nom"))
        out = out.join(first, "basin_id", "left")
    return Theme(out)


def water_management(sage: DataFrame, reaches: DataFrame, stations: DataFrame, basins: DataFrame) -> Theme:
    """SAGE areas (union; named from 1 % on), watched reaches by code, flood stations."""
    over = _inside(_overlay(sage, basins))
    part = _pct("overlap")
    named = over.where(part >= SAGE_LEAST).withColumn("o", F.struct(-F.col("overlap"), "NomZone")).groupBy("basin_id").agg(A.joined_text("NomZone", "o").alias("sage_nom"))
    union = spatial.union_areas(over, ["basin_id"], TILE).select("basin_id", F.col("area").alias("u"))
    met = spatial.lines_in(reaches, basins, TILE).where("inside > 0").withColumns({"basin_id": F.col("r_basin_id"), "code": F.coalesce(S.blank_as_null("cdentcru"), S.blank_as_null("id"))})
    watched = met.groupBy("basin_id", "code").agg(F.min_by("lbentcru", "ord").alias("nom"), A.exact_sum("inside").alias("longueur_m"))
    km = watched.groupBy("basin_id").agg((F.sum("longueur_m") / 1000).alias("vigi_km"))
    at = _points(stations, basins)
    n = at.groupBy("basin_id").agg(F.count("*").alias("vigi_st_nb"))
    rows = basins.select("basin_id", F.col("area").alias("whole")).join(union, "basin_id", "left").join(named, "basin_id", "left").join(km, "basin_id", "left").join(n, "basin_id", "left")
    rows = rows.select("basin_id", "sage_nom", F.least(F.lit(100.0), _pct(F.coalesce("u", F.lit(0.0)))).alias("sage_pct"), F.coalesce("vigi_km", F.lit(0.0)).alias("vigi_km"), F.coalesce("vigi_st_nb", F.lit(0)).alias("vigi_st_nb"))
    detail = {"flood_reaches": _id(watched).select("id_bv", "code", "nom", "longueur_m"), "flood_stations": _id(at).select("id_bv", F.col("id").alias("code"), F.col("lbentcru").alias("nom"), F.col("lbentitehy").alias("cours_eau"))}
    return Theme(rows, detail)


def pressures(casias: DataFrame, instruction: DataFrame, sis: DataFrame, irep: DataFrame, basins: DataFrame) -> Theme:
    """Soil and industrial inventories: counts, and the area of soil sectors; four schemas as one detail layer."""
    def sites(layer: DataFrame, name: str, **cols: str) -> DataFrame:
        at = _points(layer, basins)
        wanted = ("type", "code", "nom", "etat", "commune", "fiche")
        return _id(at).select("basin_id", "id_bv", F.lit(name).alias("inventaire"), *[(S.blank_as_null(cols[w]) if w in cols else F.lit(None).cast("string")).alias(w) for w in wanted])

    parts = {
        "basias": sites(casias, "CASIAS", code="code_inventaire", type="code_metier", nom="nom_etablissement", etat="etat_activite", commune="nom_commune", fiche="fiche_risque"),
        "basol": sites(instruction, "Instructions", code="id_inventaire_instruction", nom="nom_etablissement", etat="statut_instruction", commune="nom_commune", fiche="fiche_risque"),
        "irep": sites(irep, "IREP", code="idetab", type="codeape", nom="nom", commune="nom_commune"),
    }
    out = basins.select("basin_id")
    for key, df in parts.items():
        out = out.join(df.groupBy("basin_id").agg(F.count("*").alias(f"{key}_nb")), "basin_id", "left").withColumn(f"{key}_nb", F.coalesce(f"{key}_nb", F.lit(0)))
    over = _overlay(sis, basins)
    area = over.groupBy("basin_id").agg(F.count("*").alias("sis_nb"), (A.exact_sum("overlap") / HA).alias("sis_ha"))
    out = out.join(area, "basin_id", "left").withColumns({"sis_nb": F.coalesce("sis_nb", F.lit(0)), "sis_ha": F.coalesce("sis_ha", F.lit(0.0))})
    detail = parts["basias"].unionByName(parts["basol"]).unionByName(parts["irep"]).drop("basin_id")
    sectors = _id(over).select("id_bv", S.first_nonempty("id_inventaire_classification", "identifiant").alias("code"), F.col("nom"), F.col("nom_commune").alias("commune"), (F.col("overlap") / HA).alias("surface_ha"))
    return Theme(out, {"pollution_sites": detail, "soil_sectors": sectors})


def network(reaches: DataFrame, basins: DataFrame, upstream: DataFrame) -> Theme:
    """Streams within basins (clipped length, drainage density) and the share of each basin's upstream network
    (basin_id, id, outlet: whether it is the outlet's reach) that the basin contains; the outlet's reach is left out."""
    met = spatial.lines_in(reaches, basins, TILE).withColumns({"basin_id": F.col("r_basin_id"), "whole": F.col("r_area")})
    inside = met.where("inside > 0")
    total = inside.groupBy("basin_id", "whole").agg(A.exact_sum("inside").alias("m"))
    rows = total.select("basin_id", (F.col("m") / 1000).alias("lin_hydro_km"), F.try_divide(F.col("m") / 1000, F.col("whole") / 1e6).alias("dens_drainage"))
    ways = upstream.where("not outlet").select("basin_id", "id").join(reaches.select("id", "length"), "id").where("length > 0")
    held = ways.join(met.select("basin_id", "id", "inside"), ["basin_id", "id"], "left")
    ratio = held.groupBy("basin_id").agg(F.try_divide(100 * F.sum(F.coalesce("inside", F.lit(0.0))), F.sum("length")).alias("reseau_dedans"))
    detail = _id(inside).select("id_bv", F.col("nom"), F.col("code_hydro"), "nature", "persistance", "largeur", F.col("inside").alias("longueur_m"), F.col("id").cast("string").alias("cleabs"))
    return Theme(_all(basins, rows.join(ratio, "basin_id", "full"), lin_hydro_km=0.0), {"streams": detail})
