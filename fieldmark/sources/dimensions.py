"""Static dimensions (closed world, synonym dictionary, runs, models, variants, few-shots).

Every table here is tiny and of fixed size (at most 94 rows), so operators may
broadcast it without a size check.  Users who bring their own closed world or
dictionary pass a DataFrame with the same columns instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the evaluated task's closed world and dictionary.
# ---------------------------------------------------------------------------

PRODUCTS = ["CRED_IMMO", "CRED_CONSO", "CRED_PME"]
SOURCES = ["DAV", "DAT", "MARCHE", "FP"]
DRIVERS = ["taux_client", "cout_risque", "cout_operationnel", "cout_capital", "commissions"]
KPIS = ["marge_interet", "pnb", "cout_risque_total", "marge_nette", "raroc", "coef_exploitation"]
LEVER_KEYS = SOURCES + DRIVERS

INTENTS = ["simulation", "other"]
MODES = ["forward", "inverse"]
CHANGE_TYPES = ["absolute", "relative"]
CHANGE_UNITS = ["bps", "%"]
CHANGE_DIRECTIONS = ["increase", "decrease"]

UNIT_BPS = ["bps", "bp", "points de base", "pdb", "point de base"]
UNIT_PCT = ["%", "pct", "pourcent", "pourcentage", "percent"]
DIRECTION_UP = ["increase", "hausse", "augmente", "augmentation", "augmenter", "+", "monte", "hausser"]
DIRECTION_DOWN = ["decrease", "baisse", "baisser", "diminue", "diminution", "reduire", "-", "baisser"]

SPAN_LABELS = [
    "produit_credit", "source_financement", "driver_levier",
    "kpi_cible", "valeur_numerique", "unite_variation",
    "direction_variation", "terme_inconnu",
]
UNKNOWN_SPAN_THRESHOLD = 0.4
ERROR_SAMPLES_PER_RUN = 4
FUZZY_CUTOFF = 0.9
REVERSE_CONTAINMENT_MIN_LEN = 4

# Synonym dictionary, in its defining order (the order breaks length ties).
DICTIONARY = [
    ("cred_immo", "CRED_IMMO"), ("immo", "CRED_IMMO"), ("credit immo", "CRED_IMMO"),
    ("credit immobilier", "CRED_IMMO"), ("pret immobilier", "CRED_IMMO"), ("pret habitat", "CRED_IMMO"),
    ("credit logement", "CRED_IMMO"), ("pret maison", "CRED_IMMO"), ("financement immobilier", "CRED_IMMO"),
    ("cred_conso", "CRED_CONSO"), ("conso", "CRED_CONSO"), ("credit conso", "CRED_CONSO"),
    ("pret perso", "CRED_CONSO"), ("pret personnel", "CRED_CONSO"), ("credit consommation", "CRED_CONSO"),
    ("credit a la consommation", "CRED_CONSO"),
    ("cred_pme", "CRED_PME"), ("pme", "CRED_PME"), ("credit pro", "CRED_PME"),
    ("credit professionnel", "CRED_PME"), ("credit entreprise", "CRED_PME"), ("pret pro", "CRED_PME"),
    ("pret entreprise", "CRED_PME"), ("credit d'investissement pme", "CRED_PME"),
    ("dav", "DAV"), ("depots a vue", "DAV"), ("comptes courants", "DAV"), ("compte courant", "DAV"),
    ("dat", "DAT"), ("depots a terme", "DAT"), ("comptes a terme", "DAT"), ("cat", "DAT"),
    ("placements a terme", "DAT"),
    ("marche", "MARCHE"), ("refinancement de marche", "MARCHE"), ("interbancaire", "MARCHE"),
    ("marche monetaire", "MARCHE"),
    ("fp", "FP"), ("fonds propres", "FP"), ("capital", "FP"), ("capitaux propres", "FP"), ("equity", "FP"),
    ("taux_client", "taux_client"), ("taux client", "taux_client"), ("taux du credit", "taux_client"),
    ("taux du pret", "taux_client"), ("teg", "taux_client"), ("taeg", "taux_client"),
    ("taux nominal", "taux_client"), ("prix du credit", "taux_client"),
    ("cout_risque", "cout_risque"), ("cout du risque", "cout_risque"), ("risque", "cout_risque"),
    ("provisionnement", "cout_risque"), ("provisions", "cout_risque"), ("cor", "cout_risque"),
    ("cout_operationnel", "cout_operationnel"), ("couts operationnels", "cout_operationnel"),
    ("charges", "cout_operationnel"), ("frais de gestion", "cout_operationnel"),
    ("opex", "cout_operationnel"), ("frais generaux", "cout_operationnel"),
    ("cout_capital", "cout_capital"), ("cout du capital", "cout_capital"),
    ("charge en capital", "cout_capital"), ("cout des fonds propres", "cout_capital"),
    ("commissions", "commissions"), ("frais de dossier", "commissions"),
    ("frais de montage", "commissions"), ("frais", "commissions"),
    ("marge_interet", "marge_interet"), ("marge nette d'interet", "marge_interet"),
    ("marge d'interet", "marge_interet"), ("mni", "marge_interet"), ("nim", "marge_interet"),
    ("pnb", "pnb"), ("produit net bancaire", "pnb"), ("revenu net bancaire", "pnb"),
    ("cout_risque_total", "cout_risque_total"), ("cout du risque total", "cout_risque_total"),
    ("cout du risque resultant", "cout_risque_total"), ("cor total", "cout_risque_total"),
    ("marge_nette", "marge_nette"), ("marge nette", "marge_nette"),
    ("marge nette de rentabilite", "marge_nette"), ("rentabilite nette", "marge_nette"),
    ("raroc", "raroc"), ("rentabilite ajustee du risque", "raroc"),
    ("return on risk-adjusted capital", "raroc"),
    ("coef_exploitation", "coef_exploitation"), ("coefficient d'exploitation", "coef_exploitation"),
    ("coef d'exploitation", "coef_exploitation"), ("cost/income", "coef_exploitation"),
    ("cost income ratio", "coef_exploitation"),
]

# Precision-bench runs: (name, backend, precision, model, gguf_repo, quant, gated).
RUNS = [
    ("gemma-4-E2B-it", "vllm", "BF16", "google/gemma-4-E2B-it", None, None, True),
    ("gemma-4-E4B-it", "vllm", "BF16", "google/gemma-4-E4B-it", None, None, True),
    ("gemma-4-12B-it", "vllm", "BF16", "google/gemma-4-12B-it", None, None, True),
    ("gemma-3-12b-it", "vllm", "BF16", "google/gemma-3-12b-it", None, None, True),
    ("Qwen3-4B", "vllm", "BF16", "Qwen/Qwen3-4B", None, None, False),
    ("Qwen3-8B", "vllm", "BF16", "Qwen/Qwen3-8B", None, None, False),
    ("Ministral-8B", "vllm", "BF16", "mistralai/Ministral-8B-Instruct-2410", None, None, True),
    ("gemma-3-12b-it-Q8", "gguf", "Q8", "google/gemma-3-12b-it",
     "unsloth/gemma-3-12b-it-GGUF", "Q8_0", True),
    ("gemma-4-12B-it-Q8", "gguf", "Q8", "google/gemma-4-12B-it",
     "unsloth/gemma-4-12B-it-GGUF", "Q8_0", True),
    ("Mistral-Small-24B-Q8", "gguf", "Q8", "mistralai/Mistral-Small-24B-Instruct-2501",
     "unsloth/Mistral-Small-24B-Instruct-2501-GGUF", "Q8_0", False),
    ("gemma-4-26B-A4B-it-Q8", "gguf", "Q8", "google/gemma-4-26B-A4B-it",
     "unsloth/gemma-4-26B-A4B-it-GGUF", "Q8_0", True),
    ("Qwen3.6-35B-A3B-Q8", "gguf", "Q8", "Qwen/Qwen3.6-35B-A3B",
     "unsloth/Qwen3.6-35B-A3B-GGUF", "Q8_0", False),
    ("Mistral-Small-24B-Q4", "gguf", "Q4", "mistralai/Mistral-Small-24B-Instruct-2501",
     "unsloth/Mistral-Small-24B-Instruct-2501-GGUF", "Q4_K_M", False),
    ("gemma-4-26B-A4B-it-Q4", "gguf", "Q4", "google/gemma-4-26B-A4B-it",
     "unsloth/gemma-4-26B-A4B-it-GGUF", "Q4_K_M", True),
    ("Qwen3.6-35B-A3B-Q4", "gguf", "Q4", "Qwen/Qwen3.6-35B-A3B",
     "unsloth/Qwen3.6-35B-A3B-GGUF", "Q4_K_M", False),
]

# Main-bench models: (display name, model id, kind).
MODELS = [
    ("Qwen3-8B", "Qwen/Qwen3-8B", "llm"),
    ("Qwen3-4B", "Qwen/Qwen3-4B", "llm"),
    ("Qwen3-1.7B", "Qwen/Qwen3-1.7B", "llm"),
    ("Qwen3-0.6B", "Qwen/Qwen3-0.6B", "llm"),
    ("Gemma3-12B", "google/gemma-3-12b-it", "llm"),
    ("Gemma3-4B", "google/gemma-3-4b-it", "llm"),
    ("Phi-4-mini", "microsoft/Phi-4-mini-instruct", "llm"),
    ("Ministral-8B", "mistralai/Ministral-8B-Instruct-2410", "llm"),
    ("Mistral-Small-24B", "mistralai/Mistral-Small-24B-Instruct-2501", "llm"),
    ("SmolLM3-3B", "HuggingFaceTB/SmolLM3-3B", "llm"),
    ("NuExtract-2.0", "numind/NuExtract-2.0-2B", "baseline"),
    ("GLiNER-large", "urchade/gliner_multi-v2.1", "baseline"),
]

# Precision variants per base model, in comparison order.
VARIANTS = [
    ("gemma-3-12b-it", ["gemma-3-12b-it", "gemma-3-12b-it-Q8"]),
    ("gemma-4-12B-it", ["gemma-4-12B-it", "gemma-4-12B-it-Q8"]),
    ("Mistral-Small-24B", ["Mistral-Small-24B-Q8", "Mistral-Small-24B-Q4"]),
    ("gemma-4-26B-A4B-it", ["gemma-4-26B-A4B-it-Q8", "gemma-4-26B-A4B-it-Q4"]),
    ("Qwen3.6-35B-A3B", ["Qwen3.6-35B-A3B-Q8", "Qwen3.6-35B-A3B-Q4"]),
]

# ---------------------------------------------------------------------------
# DataFrame builders
# ---------------------------------------------------------------------------


def closed_world_rows():
    rows = []
    for kind, keys in (("product", PRODUCTS), ("source", SOURCES), ("driver", DRIVERS), ("kpi", KPIS)):
        for i, k in enumerate(keys):
            rows.append((k, kind, i))
    return rows


def closed_world_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(closed_world_rows(), "key string, kind string, ord int")


def dictionary_df(spark: SparkSession) -> DataFrame:
    """Raw dictionary ``(surface, canonical, ord)``; ``surface`` is folded by the linker."""
    rows = [(s, c, i) for i, (s, c) in enumerate(DICTIONARY)]
    return spark.createDataFrame(rows, "surface string, canonical string, ord int")


RUNS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("backend", T.StringType()),
    T.StructField("precision", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("gguf_repo", T.StringType()), T.StructField("quant", T.StringType()),
    T.StructField("gated", T.BooleanType()),
])


def runs_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, RUNS_SCHEMA)


def models_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, model_id string, kind string")


def variant_rows():
    return [(base, v, i) for base, vs in VARIANTS for i, v in enumerate(vs)]


def variants_df(spark: SparkSession) -> DataFrame:
    rows = [(base, v, i, k) for k, (base, vs) in enumerate(VARIANTS) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "base string, variant string, ord int, base_ord int")
