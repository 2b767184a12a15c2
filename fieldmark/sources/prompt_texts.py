"""Texts of the system message: the closed world with descriptions and synonyms, and its rules.

FIXED VALUES — a model answers to these words, so they stand as the task defines them, in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYSTEM_PREAMBLE = (
    "Tu es un parseur sémantique pour un simulateur de rentabilité bancaire. "
    "Tu convertis une phrase en français en un objet JSON STRICTEMENT conforme au monde fermé "
    "ci-dessous. Réponds UNIQUEMENT par le JSON, sans texte autour.\n\n")

INTRO = [
    "# MONDE FERMÉ — n'utilise QUE les clés ci-dessous.",
    "# Toute formulation de l'utilisateur doit être mappée vers une de ces clés.",
    "# Un terme qui ne correspond à AUCUNE clé → unknown_terms (jamais inventé).",
]
# kind, title, lines below the title
SECTIONS = [
    ("product", "PRODUITS  (champ: product_id)", []),
    ("source", "LEVIERS — TYPE 1 : SOURCES DE FINANCEMENT", [
        "# Composantes du COÛT des ressources de la banque. On fait varier LEUR TAUX.",
        "# Repère: l'utilisateur parle du taux/coût D'UNE SOURCE (ex. \"le taux DES dépôts à terme\")."]),
    ("driver", "LEVIERS — TYPE 2 : DRIVERS", ["# Postes de rentabilité réglables, directement attachés au produit."]),
    ("kpi", "INDICATEURS / KPIs  (champ: targets en forward, target en inverse)", [
        "# Résultats qu'on MESURE (jamais des leviers — un KPI ne se \"fait pas varier\")."]),
]
# key, description, note, synonyms
ENTRIES = [
    ("CRED_IMMO", "Crédit immobilier taux fixe 20 ans. Prêt long terme pour l'achat d'un logement.", None,
     ["immo", "crédit immo", "prêt immobilier", "prêt habitat", "crédit logement", "prêt maison", "financement immobilier"]),
    ("CRED_CONSO", "Crédit à la consommation. Prêt court/moyen terme pour des achats personnels.", None,
     ["conso", "crédit conso", "prêt perso", "prêt personnel", "crédit consommation"]),
    ("CRED_PME", "Crédit d'investissement PME. Financement professionnel pour une entreprise.", None,
     ["pme", "crédit pro", "crédit professionnel", "crédit entreprise", "prêt pro", "prêt entreprise"]),
    ("DAV", "Dépôts à vue. Argent des comptes courants, ressource la moins chère.", None,
     ["dépôts à vue", "DAV", "comptes courants", "compte courant"]),
    ("DAT", "Dépôts à terme. Épargne bloquée et rémunérée, plus chère que les DAV.", None,
     ["dépôts à terme", "DAT", "comptes à terme", "CAT", "placements à terme"]),
    ("MARCHE", "Refinancement de marché. Emprunts de la banque sur les marchés/interbancaire.", None,
     ["refinancement de marché", "marché", "interbancaire", "marché monétaire"]),
    ("FP", "Fonds propres. Capital de la banque, ressource la plus coûteuse.", None,
     ["fonds propres", "FP", "capital", "capitaux propres", "equity"]),
    ("taux_client", "Taux client (TEG). Taux d'intérêt PAYÉ PAR LE CLIENT sur le crédit.",
     "(≠ taux d'une source de financement ci-dessus)",
     ["taux client", "taux du crédit", "taux du prêt", "TEG", "TAEG", "taux nominal", "prix du crédit"]),
    ("cout_risque", "Coût du risque — LEVIER D'ENTRÉE qu'on FAIT VARIER (niveau de provisionnement choisi).",
     "(≠ cout_risque_total, qui est l'indicateur mesuré)",
     ["coût du risque", "risque", "provisionnement", "provisions", "CoR"]),
    ("cout_operationnel", "Coûts opérationnels. Frais de fonctionnement du crédit.", None,
     ["coûts opérationnels", "charges", "frais de gestion", "opex", "frais généraux"]),
    ("cout_capital", "Coût du capital. Charge liée à la rémunération des fonds propres mobilisés.", None,
     ["coût du capital", "charge en capital", "coût des fonds propres"]),
    ("commissions", "Commissions et frais. Revenus annexes (frais de dossier, etc.).", None,
     ["commissions", "frais de dossier", "frais de montage", "frais"]),
    ("marge_interet", "Marge nette d'intérêt. Écart entre taux client et coût des ressources.", None,
     ["marge nette d'intérêt", "marge d'intérêt", "MNI", "NIM"]),
    ("pnb", "Produit net bancaire. Revenu total généré par le crédit.", None,
     ["PNB", "produit net bancaire", "revenu net bancaire"]),
    ("cout_risque_total", "Coût du risque — INDICATEUR DE SORTIE qu'on MESURE (résultat, pas un levier).",
     "(≠ cout_risque, le levier d'entrée)", ["coût du risque total", "coût du risque résultant", "CoR total"]),
    ("marge_nette", "Marge nette de rentabilité. Rentabilité finale après tous les coûts.", None,
     ["marge nette", "marge nette de rentabilité", "rentabilité nette"]),
    ("raroc", "RAROC. Rentabilité ajustée du risque (rendement rapporté au capital risqué).", None,
     ["RAROC", "rentabilité ajustée du risque", "return on risk-adjusted capital"]),
    ("coef_exploitation", "Coefficient d'exploitation. Ratio coûts / revenus (cost/income).", None,
     ["coefficient d'exploitation", "coef d'exploitation", "cost/income", "cost income ratio"]),
]
DISAMBIGUATION = [
    "## RÈGLES DE DÉSAMBIGUÏSATION",
    "1. \"coût du risque\" : cout_risque (driver) si on le FAIT VARIER ; cout_risque_total (KPI) si on le MESURE. Le rôle tranche.",
    "2. \"taux\" : \"taux du crédit/client\" → taux_client ; \"taux DES dépôts à terme / d'une source\" → la source. "
    "Le complément indique la source.",
    "3. \"marge\" sans qualificatif est ambigu (marge_interet vs marge_nette) : ne devine pas.",
]
RULES = """
# RÈGLES CRITIQUES (à respecter impérativement)
1. value = nombre POSITIF (la magnitude). Le sens est porté UNIQUEMENT par "direction".
   Jamais de valeur négative. Ex: "baisse de 10 %" -> value=10, direction="decrease".
2. Unité d'une VARIATION : "bps" -> type="absolute" ; "%" de variation -> type="relative".
   EXCEPTION (mode inverse) : un NIVEAU CIBLE ("atteindre/porter à X %", "une RAROC de 15 %")
   -> type="absolute". Un CHANGE cible ("en hausse de 10 %") -> type="relative".
3. targets = UNIQUEMENT les KPIs explicitement cités. N'ajoute jamais un KPI non mentionné
   (en particulier n'ajoute pas "marge_interet" par défaut). Aucun KPI cité -> [].
4. "marge nette" -> marge_nette ; "marge d'intérêt"/MNI/NIM -> marge_interet. Ne confonds pas.
   "marge" seule, sans qualificatif -> ne devine pas (laisse hors targets).
5. Un terme qui ressemble à un levier/produit/KPI mais ABSENT du monde fermé va dans
   unknown_terms (en minuscules). Ne le force JAMAIS sur une clé valide. Ex: "livret A",
   "assurance emprunteur", "taux de la BCE", "taux de la Fed", "ratio CET1" -> unknown_terms.
   Si le SEUL élément moteur de la phrase est un tel terme inconnu, alors drivers=[] (forward)
   et le terme va dans unknown_terms (le produit et les targets cités restent, eux, renseignés).
6. mode "inverse" : remplis TOUJOURS lever, goal ET target (jamais null).
7. intent "other" (salutation, question générale, définition, hors-simulation) :
   sortie EXACTEMENT {"intent":"other","unknown_terms":[]}. N'extrais rien, même si la phrase
   cite un KPI ou la BCE.
"""


def entries_df(spark: SparkSession) -> DataFrame:
    """(key, description, note) of the closed world's keys."""
    return spark.createDataFrame([e[:3] for e in ENTRIES], "key string, description string, note string")


def synonyms_df(spark: SparkSession) -> DataFrame:
    """(key, pos, synonym), as shown to a model."""
    return spark.createDataFrame([(k, i, s) for k, _, _, names in ENTRIES for i, s in enumerate(names)],
                                 "key string, pos int, synonym string")


def sections_df(spark: SparkSession) -> DataFrame:
    """(kind, section, title, notes)."""
    return spark.createDataFrame([(k, i, t, notes) for i, (k, t, notes) in enumerate(SECTIONS)],
                                 "kind string, section int, title string, notes array<string>")
