"""The report byte by byte against texts written by hand, and the pieces it is made of."""

import json
import random

from pyspark.sql import functions as F

from fieldmark.functions.json_text import number_text, string_text
from fieldmark.functions.records import REC_DDL
from fieldmark.operators.report import error_samples, precision_rows, report_lines, signed1
from fieldmark.operators.scoring import score_pairs
from fieldmark.operators.summary import summarize
from fieldmark.sources.dimensions import runs_df, variants_df


def change(kind, value, unit, direction):
    return (kind, value, unit, direction)


FORWARD = ("simulation", "forward", "CRED_IMMO", [("taux_client", change("relative", 5.0, "%", "increase"))], ["pnb"],
           None, None, None, [])
INVERSE = ("simulation", "inverse", None, None, None, ("FP",), change("absolute", 10.0, "bps", "decrease"), "raroc", ['a"b\n'])
OTHER = ("other", None, None, None, None, None, None, None, [])
WRONG = [
    ("simulation", "forward", "CRED_IMMO", [("taux_client", change("relative", 6.0, "%", "increase"))], [], None, None, None, []),
    ("simulation", "inverse", None, None, None, ("DAV",), None, "raroc", []),
    None,
]
HEADER = """# Rapport — Benchmark de quantification (BF16 vs Q8 vs Q4)

Évaluation de %d runs (modèle x précision) sur la tâche de semantic parsing bancaire (phrase FR -> JSON, monde fermé), sur le dataset augmenté.

- **Exemples** : %d (data partagée avec le benchmark principal, augmentée).
- **Métrique** : exact_match (égalité profonde ; listes comparées comme ensembles).
- **Moteurs** : BF16 -> vLLM ; Q8/Q4 (GGUF) -> llama.cpp. Décodage JSON contraint, température 0, prompt identique partout.
- **Latence** : médiane par requête. Note : vLLM (BF16) et llama.cpp (GGUF) sont des moteurs différents ; la latence reflète le couple modèle+moteur de déploiement réel, pas seulement la précision.

## 1. Classement général

| Rang | Run | Précision | Exact match | Forward | Inverse | Other | Schéma valide | Latence méd. |
|:---:|---|:---:|:---:|:---:|:---:|:---:|:---:|:---:|
"""
TWO_RUNS = HEADER % (2, 3) + """| 1 | gemma-3-12b-it | BF16 | 1.000 | 1/1 | 1/1 | 1/1 | 1.000 | 2.000 s |
| 2 | gemma-3-12b-it-Q8 | Q8 | 0.000 | 0/1 | 0/1 | 0/1 | 0.667 | 4.000 s |

## 2. Impact de la quantification (par modèle de base)

### gemma-3-12b-it

| Variante | Précision | Exact match | Latence méd. |
|---|:---:|:---:|:---:|
| gemma-3-12b-it | BF16 | 1.000 | 2.000 s |
| gemma-3-12b-it-Q8 | Q8 | 0.000 | 4.000 s |

Variation exact match BF16 -> Q8 : -100.0 points.

## 3. Fiche par run

### gemma-3-12b-it — BF16 (vllm) — exact_match 1.000

- Par type : forward 1/1, inverse 1/1, other 1/1.
- Schéma valide 1.000 ; latence médiane 2.000 s (p95 2.900 s).
- product_id 1.000 ; drivers P/R 1.000/1.000 ; change_acc 1.000 ; targets P/R 1.000/1.000.
- Inverse : lever 1.000, goal 1.000, target 1.000. unknown_terms P/R 1.000/1.000.
- Aucune erreur (exact_match parfait).

### gemma-3-12b-it-Q8 — Q8 (gguf) — exact_match 0.000

- Par type : forward 0/1, inverse 0/1, other 0/1.
- Schéma valide 0.667 ; latence médiane 4.000 s (p95 4.900 s).
- product_id 1.000 ; drivers P/R 1.000/1.000 ; change_acc 0.750 ; targets P/R 1.000/0.000.
- Inverse : lever 0.000, goal 0.000, target 1.000. unknown_terms P/R 1.000/0.667.
- Échantillon d'erreurs :
  - « texte un »
    - drivers: attendu={"taux_client": {"type": "relative", "value": 5.0, "unit": "%", "direction": "increase"}} / obtenu={"taux_client": {"type": "relative", "value": 6.0, "unit": "%", "direction": "increase"}}
    - targets: attendu=["pnb"] / obtenu=[]
  - « texte deux »
    - lever: attendu="FP" / obtenu="DAV"
    - goal: attendu={"type": "absolute", "value": 10.0, "unit": "bps", "direction": "decrease"} / obtenu=null
    - unknown_terms: attendu=["a\\"b\\n"] / obtenu=[]
  - « texte trois »
    - intent: attendu=other / obtenu=None
"""
ONE_RUN = HEADER % (1, 1) + """| 1 | inconnu | ? | 1.000 | 0/0 | 0/0 | 1/1 | 1.000 | 0.250 s |

## 2. Impact de la quantification (par modèle de base)

Données insuffisantes pour comparer les précisions (runs manquants).

## 3. Fiche par run

### inconnu — ? (?) — exact_match 1.000

- Par type : forward 0/0, inverse 0/0, other 1/1.
- Schéma valide 1.000 ; latence médiane 0.250 s (p95 0.250 s).
- product_id 1.000 ; drivers P/R -/- ; change_acc - ; targets P/R -/-.
- Inverse : lever -, goal -, target -. unknown_terms P/R 1.000/1.000.
- Aucune erreur (exact_match parfait).
"""
PAIRS = f"run string, row_id long, text string, gold {REC_DDL}, prediction {REC_DDL}, valid_json boolean, latency_s double"


def report(spark, rows, path):
    scored = score_pairs(spark.createDataFrame(rows, PAIRS))
    scored.write.parquet(str(path / "scored"))
    scored = spark.read.parquet(str(path / "scored"))
    summary = summarize(scored, runs_df(spark))
    summary.write.parquet(str(path / "summary"))
    return report_lines(spark.read.parquet(str(path / "summary")), variants_df(spark), error_samples(scored))


def text_of(lines):
    return "".join(r.line + "\n" for r in lines.orderBy("section", "rank", "ord").collect())


def two_runs():
    texts = ["texte un", "texte deux", "texte trois"]
    gold = [FORWARD, INVERSE, OTHER]
    rows = [("gemma-3-12b-it", i, t, g, g, True, i + 1.0) for i, (t, g) in enumerate(zip(texts, gold))]
    return rows + [("gemma-3-12b-it-Q8", i, t, g, p, p is not None, 0.0 if p is None else 4.0 + i)
                   for i, (t, g, p) in enumerate(zip(texts, gold, WRONG))]


def test_two_variants_byte_by_byte(spark, tmp_path):
    assert text_of(report(spark, two_runs(), tmp_path)) == TWO_RUNS


def test_one_run_without_errors_byte_by_byte(spark, tmp_path):
    assert text_of(report(spark, [("inconnu", 0, "t", OTHER, OTHER, True, 0.25)], tmp_path)) == ONE_RUN


def test_json_text_is_pythons(spark):
    texts = ['a"b\\c', "é中 /", "".join(map(chr, range(1, 33))), "", "\x7f", "\\n", "\\u000B", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", string_text(F.col("t")).alias("j")).collect()}
    assert got == {i: json.dumps(t, ensure_ascii=False) for i, t in enumerate(texts)}
    rng = random.Random(1)
    values = [0.0, -0.0, 5.0, 0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e22, 1.7976931348623157e308, 1e-3, 1e-4, 9.9e-5, 1e-5,
              2.5e-300, -2.5e-7, 123456789012345.6, 999999999999999.9, 1e100, None, float("nan"), float("inf"), float("-inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 18) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.j for r in df.select("i", number_text(F.col("v")).alias("j")).collect()}
    assert got == {i: json.dumps(v) for i, v in enumerate(values)}


def test_signed_points(spark):
    values = [0.0, 0.04, -0.04, 12.25, 12.35, -100.0, 1234.56, 0.05]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.s for r in df.select("i", signed1(F.col("v")).alias("s")).collect()}
    assert got == {i: f"{v:+.1f}" for i, v in enumerate(values)}


def test_variant_rows(spark):
    summary = spark.createDataFrame([("a1", "BF16", 0.5, 1.0), ("a2", "Q8", None, 2.0), ("a3", "Q4", 0.25, 3.0), ("b1", "Q8", 0.75, None),
                                     ("z", "?", 0.1, 1.0)], "model string, precision string, exact_match_rate double, latency_median_s double")
    variants = spark.createDataFrame([("a", "a0", 0), ("a", "a1", 1), ("a", "a2", 2), ("a", "a3", 3), ("b", "b1", 0), ("b", "b2", 1),
                                      ("c", "c1", 0)], "base string, variant string, ord int")
    got = sorted(tuple(r) for r in precision_rows(summary, variants).collect())
    assert got == [("a", 1, "a1", "BF16", 0.5, 1.0, None, None, None, True), ("a", 2, "a2", "Q8", None, 2.0, "a1", 0.5, None, True),
                   ("a", 3, "a3", "Q4", 0.25, 3.0, "a1", 0.5, -25.0, True), ("b", 1, "b1", "Q8", 0.75, None, None, None, None, False)]
