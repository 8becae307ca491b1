"""Output schemas: the wide basin row and the detail layers, as (name, type, label) tables."""

from __future__ import annotations

from rillflow.operators import reshape

# Columns of the basin row in order, their types (D double, I int, S string, B boolean) and labels with units.
_BASIN = (
    ("id_bv", "S", "Identifiant du bassin"),
    ("date_calcul", "S", "Date du calcul"),
    ("surface_km2", "D", "Surface (km²)"),
    ("surface_ha", "D", "Surface (ha)"),
    ("perimetre_km", "D", "Périmètre (km)"),
    ("perim_brut_km", "D", "Périmètre avant simplification (km)"),
    ("simplif_m", "D", "Tolérance de simplification du contour (m)"),
    ("gravelius", "D", "Indice de compacité de Gravelius (sans unité)"),
    ("rect_long_m", "D", "Rectangle équivalent — longueur (m)"),
    ("rect_larg_m", "D", "Rectangle équivalent — largeur (m)"),
    ("z_min_m", "D", "Altitude minimale (m NGF)"),
    ("z_max_m", "D", "Altitude maximale (m NGF)"),
    ("z_moyen_m", "D", "Altitude moyenne (m NGF)"),
    ("z_median_m", "D", "Altitude médiane (m NGF)"),
    ("z_hypso_5_m", "D", "Altitude dépassée par 5 % de la surface (m NGF)"),
    ("z_hypso_95_m", "D", "Altitude dépassée par 95 % de la surface (m NGF)"),
    ("denivelee_m", "D", "Dénivelée totale, maxi moins mini (m)"),
    ("deniv_utile_m", "D", "Dénivelée utile, H5 % moins H95 % (m)"),
    ("pente_deg", "D", "Pente moyenne du terrain (degrés)"),
    ("pente_pct", "D", "Pente moyenne du terrain (%)"),
    ("pente_med", "D", "Pente médiane du terrain (degrés)"),
    ("ig_m_par_km", "D", "Indice de pente global Ig (m/km)"),
    ("deniv_spec_m", "D", "Dénivelée spécifique Ds (m)"),
    ("long_chem_km", "D", "Plus long cheminement hydraulique (km)"),
    ("lin_hydro_km", "D", "Linéaire hydrographique BD TOPO dans le bassin (km)"),
    ("dens_drainage", "D", "Densité de drainage (km/km²)"),
    ("reseau_dedans", "D", "Réseau amont contenu dans le bassin (% du linéaire)"),
    ("roe_nb", "I", "Obstacles à l'écoulement ROE — nombre"),
    ("roe_exist_nb", "I", "Obstacles ROE encore existants — nombre"),
    ("roe_grenelle", "I", "Obstacles ROE classés Grenelle — nombre"),
    ("roe_passe_nb", "I", "Obstacles ROE avec passe à poissons — nombre"),
    ("roe_h_cum_m", "D", "ROE — chute cumulée, classes comprises (m)"),
    ("roe_h_max_m", "D", "Obstacles ROE — plus haute chute (m)"),
    ("roe_par_km", "D", "Obstacles ROE par km de cours d'eau (nb/km)"),
    ("sitehydro_nb", "I", "Sites hydrométriques Sandre — nombre"),
    ("hydro_codes", "S", "Sites hydrométriques — codes Sandre"),
    ("steu_nb", "I", "Stations de traitement des eaux usées — nombre"),
    ("steu_service_nb", "I", "Stations de traitement en service — nombre"),
    ("steu_capa_tot_eh", "D", "Stations de traitement — capacité nominale cumulée (EH)"),
    ("steu_sup2000_nb", "I", "Stations de traitement ≥ 2 000 EH — nombre"),
    ("steu_zonesens_nb", "I", "Stations de traitement en zone sensible — nombre"),
    ("preleve_nb", "I", "Ouvrages de prélèvement d'eau — nombre"),
    ("preleve_vol_m3", "D", "Prélèvements d'eau — volume annuel cumulé (m³)"),
    ("preleve_an", "I", "Prélèvements d'eau — année la plus récente connue"),
    ("ocs_dominante", "S", "Occupation du sol dominante (Corine Land Cover 2018)"),
    ("ocs_dom_pct", "D", "Part de la classe dominante (% de la surface)"),
    ("ocs_artif_pct", "D", "Territoires artificialisés (% de la surface)"),
    ("ocs_agri_pct", "D", "Territoires agricoles (% de la surface)"),
    ("ocs_foret_pct", "D", "Forêts et milieux semi-naturels (% de la surface)"),
    ("ocs_humide_pct", "D", "Zones humides (% de la surface)"),
    ("ocs_eau_pct", "D", "Surfaces en eau (% de la surface)"),
    ("bati_ha", "D", "Emprise au sol des bâtiments BD TOPO (ha)"),
    ("bati_pct", "D", "Emprise au sol des bâtiments (% de la surface)"),
    ("bati_nb", "I", "Nombre de bâtiments BD TOPO"),
    ("zone_hab_pct", "D", "Zones d'habitation BD TOPO (% de la surface)"),
    ("population_est", "D", "Population estimée (habitants)"),
    ("foret_ha", "D", "Couvert BD Forêt v2, landes comprises (ha)"),
    ("foret_pct", "D", "Couvert BD Forêt v2, landes comprises (%)"),
    ("peupl_ha", "D", "Surface boisée, peuplements seuls (ha)"),
    ("peupl_pct", "D", "Surface boisée, peuplements seuls (% de la surface)"),
    ("foret_dom", "S", "Formation forestière dominante (BD Forêt v2)"),
    ("foret_dom_pct", "D", "Part de la formation forestière dominante (%)"),
    ("foret_feui_pct", "D", "Forêt de feuillus (% de la surface)"),
    ("foret_coni_pct", "D", "Forêt de conifères (% de la surface)"),
    ("foret_mixt_pct", "D", "Forêt mixte (% de la surface)"),
    ("chab_cov_pct", "D", "Couverture du bassin par CarHab (%)"),
    ("chab_hum_ha", "D", "Sols humides à aquatiques, CarHab (ha)"),
    ("chab_hum_pct", "D", "Sols humides à aquatiques, CarHab (%)"),
    ("chab_dom", "S", "Physionomie dominante (CarHab)"),
    ("chab_dom_pct", "D", "Part de la physionomie dominante (%)"),
    ("rpg_ha", "D", "Surface déclarée à la PAC (ha)"),
    ("rpg_pct", "D", "Surface déclarée à la PAC (% de la surface)"),
    ("rpg_nb", "I", "Parcelles PAC dans le bassin — nombre"),
    ("rpg_moy_ha", "D", "Parcelle PAC — taille moyenne (ha)"),
    ("rpg_med_ha", "D", "Parcelle PAC — taille médiane (ha)"),
    ("herbe_ha", "D", "Prairies et surfaces pastorales déclarées (ha)"),
    ("herbe_pct", "D", "Prairies et pastoral déclarés (% de la surface)"),
    ("rpg_cult_ha", "D", "Cultures déclarées, hors prairies (ha)"),
    ("rpg_cult_pct", "D", "Cultures déclarées, hors prairies (% de la surface)"),
    ("rpg_arable_pct", "D", "Terres arables déclarées (% de la surface)"),
    ("rpg_perm_pct", "D", "Cultures permanentes déclarées (% de la surface)"),
    ("rpg_prairie_pct", "D", "Prairies permanentes déclarées (% de la surface)"),
    ("rpg_dominante", "S", "Culture déclarée dominante (RPG)"),
    ("rpg_dom_pct", "D", "Part de la culture dominante (% de la surface)"),
    ("bio_ha", "D", "Surface certifiée agriculture biologique (ha)"),
    ("bio_pct", "D", "Certifiée agriculture biologique (% de la surface)"),
    ("conv_ha", "D", "Surface en conversion biologique (ha)"),
    ("conv_pct", "D", "En conversion biologique (% de la surface)"),
    ("bio_nb", "I", "Parcelles bio ou en conversion — nombre"),
    ("bio_declare", "D", "Bio et conversion (% de la surface déclarée)"),
    ("bcae_ha", "D", "Prairies sensibles BCAE (ha)"),
    ("bcae_pct", "D", "Prairies sensibles BCAE (% de la surface)"),
    ("aoc_ha", "D", "Aires AOC viticoles (ha)"),
    ("aoc_pct", "D", "Aires AOC viticoles (% de la surface)"),
    ("haies_km", "D", "Linéaire de haies (km)"),
    ("haies_dens", "D", "Densité de haies (m par ha de bassin)"),
    ("haies_nb", "I", "Haies — nombre de tronçons"),
    ("onf_ha", "D", "Forêts publiques ONF (ha)"),
    ("onf_pct", "D", "Forêts publiques ONF (% de la surface)"),
    ("onf_nb", "I", "Forêts publiques ONF — nombre"),
    "zonings",
    ("zonage_ha", "D", "Total sous zonage, sans double compte (ha)"),
    ("zonage_pct", "D", "Total sous zonage, sans double compte (%)"),
    ("zonage_nb", "I", "Nombre de sites de zonage recoupant le bassin"),
    ("gbif_obs_nb", "I", "Observations naturalistes GBIF — nombre"),
    ("gbif_esp_nb", "I", "Espèces observées GBIF — nombre"),
    ("me_code_eu", "S", "Masse d'eau DCE — code européen"),
    ("me_nom", "S", "Masse d'eau DCE — dénomination"),
    ("me_surface_km2", "D", "Masse d'eau DCE — surface de son bassin versant (km²)"),
    ("me_categorie", "S", "Masse d'eau DCE — catégorie Sandre"),
    ("me_exut_dedans", "B", "Exutoire situé dans le bassin de la masse d'eau"),
    ("meso_code_eu", "S", "Masse d'eau souterraine — code européen"),
    ("meso_nom", "S", "Masse d'eau souterraine — dénomination"),
    ("meso_ecoul", "S", "Masse d'eau souterraine — nature de l'écoulement"),
    ("meso_karst", "B", "Masse d'eau souterraine karstique"),
    ("her1_code", "S", "Hydroécorégion de niveau 1 — code"),
    ("her1_nom", "S", "Hydroécorégion de niveau 1"),
    ("her2_code", "S", "Hydroécorégion de niveau 2 — code"),
    ("her2_nom", "S", "Hydroécorégion de niveau 2"),
    ("sage_nom", "S", "SAGE couvrant le bassin"),
    ("sage_pct", "D", "Bassin couvert par un SAGE (%)"),
    ("vigi_km", "D", "Cours d'eau surveillés par Vigicrues (km)"),
    ("vigi_st_nb", "I", "Stations Vigicrues — nombre"),
    ("aep_nb", "I", "Ouvrages de prélèvement pour l'eau potable — nombre"),
    ("aep_vol_m3", "D", "Prélèvements pour l'eau potable (m³/an)"),
    ("basias_nb", "I", "Anciens sites industriels BASIAS — nombre"),
    ("basol_nb", "I", "Sites pollués BASOL — nombre"),
    ("sis_nb", "I", "Secteurs d'information sur les sols — nombre"),
    ("sis_ha", "D", "Secteurs d'information sur les sols (ha)"),
    ("irep_nb", "I", "Établissements déclarant leurs rejets IREP — nombre"),
    ("x_exutoire", "D", "Exutoire retenu — X (m, Lambert 93)"),
    ("y_exutoire", "D", "Exutoire retenu — Y (m, Lambert 93)"),
    ("x_clic", "D", "Point cliqué — X (m, Lambert 93)"),
    ("y_clic", "D", "Point cliqué — Y (m, Lambert 93)"),
    ("dist_reseau_m", "D", "Distance du point cliqué au réseau BD TOPO (m)"),
    ("recalage_mnt_m", "D", "Recalage de l'exutoire sur le talweg du MNT (m)"),
    ("zone_hydro", "S", "Zone hydrographique BD TOPO"),
    ("code_zone", "S", "Zone hydrographique — code BD Carthage"),
    ("cours_d_eau", "S", "Cours d'eau de l'exutoire"),
    ("code_hydro", "S", "Tronçon d'exutoire — code hydrographique"),
    ("mnt_resolution", "D", "Résolution du modèle numérique de terrain (m)"),
    ("mnt_elargi", "B", "Maille élargie faute de mémoire"),
    ("mnt_affine", "B", "Recalculé à la maille la plus fine (bassin recadré)"),
    ("mnt_source", "S", "Source du modèle numérique de terrain"),
)

# Protected-area kinds in catalogue order: key, label in the basin row, nature.
ZONINGS = (
    ("znieff1", "ZNIEFF de type I", "inventaire"),
    ("znieff2", "ZNIEFF de type II", "inventaire"),
    ("zsc", "Natura 2000 — ZSC, habitats", "protection"),
    ("zps", "Natura 2000 — ZPS, oiseaux", "protection"),
    ("apb", "Arrêté de protection de biotope", "protection"),
    ("rnn", "Réserve naturelle nationale", "protection"),
    ("rnr", "Réserve naturelle régionale", "protection"),
    ("pnr", "Parc naturel régional", "protection"),
    ("ramsar", "Site Ramsar", "protection"),
    ("zhumide", "Zones humides et tourbières BCAE", "protection"),
    ("cen", "Conservatoire d'espaces naturels", "gestion"),
    ("compens", "Mesures compensatoires", "compensation"),
    ("autres", "Autres protections", "protection"),
    ("zhim", "Zones humides d'importance majeure", "inventaire"),
)

_KIND = {"D": "DOUBLE", "I": "INT", "S": "STRING", "B": "BOOLEAN"}


def _basin() -> list[tuple[str, str, str]]:
    out = []
    for entry in _BASIN:
        if entry == "zonings":
            for key, label, _ in ZONINGS:
                out += [(f"{key}_ha", "DOUBLE", f"{label} (ha)"), (f"{key}_pct", "DOUBLE", f"{label} (% de la surface)")]
        else:
            name, kind, label = entry
            out.append((name, _KIND[kind], label))
    return out


BASIN_FIELDS = _basin()
BASIN = reshape.schema(BASIN_FIELDS)

# Columns of the detail layers, each after id_bv.
LAYERS = {
    "zonings": (
        ("zonage", "S"),
        ("cle", "S"),
        ("nature", "S"),
        ("nom", "S"),
        ("code", "S"),
        ("surface_ha", "D"),
        ("part_pct", "D"),
        ("fiche", "S"),
    ),
    "obstacles": (
        ("code", "S"),
        ("nom", "S"),
        ("type", "S"),
        ("etat", "S"),
        ("chute_m", "D"),
        ("provenance", "S"),
        ("classe", "S"),
        ("passe", "S"),
        ("usage", "S"),
        ("grenelle", "B"),
        ("cours_eau", "S"),
    ),
    "treatment_plants": (
        ("code", "S"),
        ("nom", "S"),
        ("capacite_eh", "D"),
        ("charge_eh", "D"),
        ("taux_charge", "D"),
        ("nature", "S"),
        ("en_service", "B"),
        ("date_serv", "S"),
        ("autosurv", "S"),
        ("conformite", "S"),
        ("zone_sens", "B"),
        ("nom_zs", "S"),
        ("agglo", "S"),
        ("commune", "S"),
        ("nor_classe", "S"),
        ("nor_dbo5", "D"),
        ("nor_dbo5_r", "D"),
        ("nor_dco", "D"),
        ("nor_dco_r", "D"),
        ("nor_mes", "D"),
        ("nor_mes_r", "D"),
        ("nor_ngl", "D"),
        ("nor_ngl_r", "D"),
        ("nor_pt", "D"),
        ("nor_pt_r", "D"),
        ("nor_source", "S"),
    ),
    "withdrawals": (
        ("code", "S"),
        ("nom", "S"),
        ("annee", "I"),
        ("volume_m3", "D"),
        ("usage", "S"),
        ("commune", "S"),
    ),
    "forest": (
        ("formation", "S"),
        ("essence", "S"),
        ("surface_ha", "D"),
        ("part_pct", "D"),
    ),
    "organic_parcels": (
        ("statut", "S"),
        ("stade", "S"),
        ("culture", "S"),
        ("surface_ha", "D"),
        ("part_pct", "D"),
    ),
    "declared_parcels": (
        ("code", "S"),
        ("culture", "S"),
        ("categorie", "S"),
        ("nature", "S"),
        ("surface_ha", "D"),
        ("part_pct", "D"),
    ),
    "hedges": (
        ("longueur_m", "D"),
    ),
    "public_forests": (
        ("code", "S"),
        ("nom", "S"),
        ("statut", "S"),
        ("surface_ha", "D"),
        ("part_pct", "D"),
    ),
    "habitats": (
        ("physio", "S"),
        ("humidite", "S"),
        ("acidite", "S"),
        ("surface_ha", "D"),
    ),
    "flood_reaches": (
        ("code", "S"),
        ("nom", "S"),
        ("longueur_m", "D"),
    ),
    "flood_stations": (
        ("code", "S"),
        ("nom", "S"),
        ("cours_eau", "S"),
    ),
    "pollution_sites": (
        ("inventaire", "S"),
        ("type", "S"),
        ("code", "S"),
        ("nom", "S"),
        ("etat", "S"),
        ("commune", "S"),
        ("fiche", "S"),
    ),
    "soil_sectors": (
        ("code", "S"),
        ("nom", "S"),
        ("commune", "S"),
        ("surface_ha", "D"),
    ),
    "outlets": (
        ("origine", "S"),
        ("x", "D"),
        ("y", "D"),
    ),
    "streams": (
        ("nom", "S"),
        ("code_hydro", "S"),
        ("nature", "S"),
        ("persistance", "S"),
        ("largeur", "S"),
        ("longueur_m", "D"),
        ("cleabs", "S"),
    ),
}


def layer(name: str):
    return reshape.schema([("id_bv", "STRING", "Identifiant du bassin"), *[(n, _KIND[k], n) for n, k in LAYERS[name]]])
