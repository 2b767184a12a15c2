"""Dictionary linking: worked goldens, and what must hold for every surface."""

from fieldmark.operators.linking import link
from fieldmark.sources.dimensions import DICTIONARY, dictionary_df

GOLDENS = {
    "Prêt immobilier": "CRED_IMMO", "le coût du risque total": "cout_risque_total", "marge": "marge_nette",
    "taux": "FP", "crédit": "CRED_PME", "coût": "cout_risque_total", "risk": "raroc",
    "depot a vue": "DAV", "prêt": "CRED_IMMO", "fonds": "cout_capital", "le PNB et la RAROC": "raroc",
    "marché immobilier": "MARCHE", "marches": "MARCHE", "comission": "commissions", "taux du pel": None,
    "catégorie": None, "taux de l'OAT": None, "livret A": None, "ratio CET1": None, "": None,
}


def run_link(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = link(df, "t", dictionary_df(spark), containment=True, fuzzy=True)
    return {r.i: r.key for r in out.collect()}


def test_worked_goldens(spark):
    texts = list(GOLDENS)
    got = run_link(spark, texts)
    assert {t: got[i] for i, t in enumerate(texts)} == GOLDENS


def test_spellings_of_every_surface(spark):
    """Case, accents and words around a surface do not change its key."""
    cases = [(v, c) for s, c in DICTIONARY for v in (s.upper(), s.replace("e", "é"), f"  {s} ", f"zz {s} zz")]
    got = run_link(spark, [t for t, _ in cases])
    bad = [(t, got[i], c) for i, (t, c) in enumerate(cases) if got[i] != c]
    assert not bad, bad[:10]


def test_longest_surface_of_a_span_wins(spark):
    cases = [(f"{s} ou {t}", c if len(s) > len(t) else d) for k, (s, c) in enumerate(DICTIONARY)
             for t, d in [DICTIONARY[(k * 7 + 3) % len(DICTIONARY)]] if len(s) != len(t)]
    got = run_link(spark, [t for t, _ in cases])
    bad = [(t, got[i], c) for i, (t, c) in enumerate(cases) if got[i] != c]
    assert not bad, bad[:10]


def test_misspelt_surfaces(spark):
    cases = {"provisionement": "cout_risque", "fraiss de gestion": "cout_operationnel", "intrbancaire": "MARCHE",
             "produit net bancair": "pnb", "rentabilite nettes": "marge_nette", "provxsxonnxment": None, "xyz": None}
    got = run_link(spark, list(cases))
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_dictionary_surface_links_to_its_key(spark):
    texts = [s for s, _ in DICTIONARY]
    got = run_link(spark, texts)
    for i, (s, c) in enumerate(DICTIONARY):
        assert got[i] == c, s
