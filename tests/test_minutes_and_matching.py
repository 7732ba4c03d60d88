"""Sections of minutes pages, references inside notices, counts by confidence."""

import collections
import random

from adjudica.operators.containment import contained
from adjudica.sources import minutes_page, readers

TABS = "<ul><li>Dossier Administratif</li><li>Dossier Technique</li><li>Concurrents Retenus</li></ul>"


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


PAGE = f"""<div id="ctl0_CONTENU_PAGE_mainPart"><script>var x = "Concurrents Retenus";</script>{TABS}
<div class="intitule-240 bold">R&eacute;f&eacute;rence</div><div class="content-bloc">11/BF/2025/ENA.</div><div class="intitule">Objet :</div> <div class="content-bloc">Travaux de <b>voirie</b></div>
<div class="intitule">Estimation (en Dhs TTC) * : 220 200,00</div><div class="content-bloc">5 000,00</div><div class="intitule">Caution provisoire</div><div class="content-bloc"></div>
<h3>Liste des concurrents ayant d&eacute;pos&eacute; un pli</h3>{table(["Concurrents"], ["ALPHA sarl"], ["Beta"], ["GAMMA"], ["Delta"], ["Epsilon"])}
<h3>Dossier Administratif</h3><p>Liste des concurrents ou architectes évincés</p>{table(["Concurrents"], ["Beta"])}
<p>Liste des concurrents ou architectes admissibles sans réserve</p>{table(["Concurrents"], ["alpha SARL"], ["Gamma"], ["Epsilon"])}
<h3>Dossier Technique</h3><p>Liste des concurrents ou architectes évincés</p>{table(["Concurrents"], ["GAMMA"])}<!-- Concurrents Retenus -->
<h3>Offre Financière</h3><p>Montant des actes d'engagement des concurrents</p>{table(["Concurrents", "Montant", "Apr&egrave;s"], ["ALPHA sarl", "210 000,00", "209 500,50"], ["Epsilon", "230 000,00"])}
<h3>Concurrents Retenus</h3>{table(["Concurrents", "Montant"], ["Alpha SARL", "209 500,50"])}
<h3>Justification du choix de l'attributaire</h3><p>Offre la moins disante</p><h3>Déclaration Infructueux</h3><p>N&eacute;ant</p></div>"""

LOTS = f"""<div id="ctl0_CONTENU_PAGE_mainPart">Montant des actes<h3>Liste des concurrents ayant déposé un pli</h3>{table(["Concurrents", "Lot"], ["Alpha", "1, 2"], ["Beta", "2"], ["Zeta", ""])}
<h3>Montant des actes d'engagement des concurrents</h3>{table(["Alpha", "1", "100 000,00 DH"], ["Alpha", "Lot B", "90 000,00"], ["Beta", "", "80 000,00"])}
<h3>Concurrents Retenus</h3>{table(["Alpha", "Lot B", "90 000,00"], ["Néant"])}<h3>Déclaration Infructueux</h3><p>Lot 1 infructueux</p></div>"""


def test_minutes_sections(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, LOTS), (3, "<html>empty shell</html>"), (4, None), (5, '<div id="ctl0_CONTENU_PAGE_mainPart">Montant des actes</div>')], "page long, html string")
    got = {r.id: r for r in minutes_page.read_minutes_pages(pages, "page", "html").collect()}
    assert set(got) == {1, 2, 5}
    one = got[1]
    assert (one.reference, one.title, one.estimation, one.deposit, one.justification, one.unsuccessful) == ("11/BF/2025/ENA.", "Travaux de voirie", 220200.0, 5000.0, "Offre la moins disante", False)
    assert (one.winner, one.amount, one.n_bidders, one.lots) == ("ALPHA sarl", 210000.0, 5, [])
    assert {(b.bidder, b.status, b.amount_deed, b.amount_checked) for b in one.bidders} == {
        ("ALPHA sarl", "attributaire", 210000.0, 209500.5), ("Beta", "ecarte_dossier_administratif_technique", None, None), ("GAMMA", "ecarte_offre_technique", None, None), ("Delta", "depose", None, None), ("Epsilon", "admis", 230000.0, None)
    }
    two = got[2]
    assert two.unsuccessful and [(x.lot, x.winner, x.amount) for x in two.lots] == [("Lot B", "Alpha", 90000.0)]
    assert got[5].bidders == [] and got[5].n_bidders == 0 and got[5].winner is None
    assert {b.lot for b in two.bidders if b.bidder == "Zeta"} == {None}


def test_contained_is_all_pairs(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab1/") for _ in range(n))
    large = [(k, rng.choice("op"), text(rng.randint(0, 25))) for k in range(150)] + [(900, None, "abab"), (901, "o", None)]
    small = [(k, rng.choice("op"), text(rng.randint(0, 7))) for k in range(150)] + [(k, b, t) for k, b, t in large[:20]] + [(900, None, "a"), (901, "o", None)]
    small = [(1000 + k, b, t) for k, (_, b, t) in enumerate(small)]
    kind = "id long, block string, text string"
    got = collections.Counter((r.id, r.id2) for r in contained(spark.createDataFrame(small, kind), spark.createDataFrame(large, kind)).collect())
    want = collections.Counter((a, b) for a, x, s in small for b, y, t in large if s and t and x == y and x is not None and s in t)
    assert got == want and len(want) > 100
    long_only = [r for r in small if r[2] and len(r[2]) >= 4]
    got = {(r.id, r.id2) for r in contained(spark.createDataFrame(long_only, kind), spark.createDataFrame(large, kind)).collect()}
    assert got == {p for p in want if p[0] in {r[0] for r in long_only}}


def test_matching_and_its_quality(spark):
    m = [("m1", "o", "12/2025", "Construction route nationale"), ("m2", "o", "77", "Entretien"), ("m3", "o", "5/26", "Peinture"), ("m4", "p", "12/2025", "Ecole"), ("m5", "o", None, "x"), ("m6", "q", "12/2025", "y")]
    n = [("n1", "o", "12/2025", "construction d'une ROUTE nationale"), ("n2", "o", "12/2025/X", "autre chose"), ("n3", "p", "AO 12 / 2025", "x"), ("n4", "o", "5/26", "Peinture murale"), ("n5", "o", "5/26 bis", "peinture")]
    got = readers.match_notices(spark.createDataFrame(m, "ref string, org string, reference string, title string"), spark.createDataFrame(n, "ref string, org string, reference string, text string"))
    rows = {r.ref: (r.notice_ref, r.candidates, r.confidence) for r in got.collect()}
    assert rows == {"m1": ("n1", 2, "objet"), "m2": (None, 0, "sans"), "m3": ("n4", 2, "a_verifier"), "m4": ("n3", 1, "reference"), "m5": (None, 0, "sans"), "m6": (None, 0, "sans")}
    assert {r.confidence: r.n for r in readers.matching_quality(got).collect()} == {"objet": 1, "sans": 3, "a_verifier": 1, "reference": 1}


def test_a_reference_is_sought_once_and_words_are_counted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(readers, "contained", lambda sought, texts: seen.append(sought.count()) or contained(sought, texts))
    titles = ["Construction route", "Peinture murale ecole", None]
    m = [(f"m{k}", "o", "12/2025", titles[k % 3]) for k in range(60)] + [("x", None, "12/2025", "route")]
    n = [(f"n{k:02d}", "o", "AO 12/2025", titles[k % 2]) for k in range(40)]
    rows = {r.ref: (r.notice_ref, r.common, r.candidates, r.confidence) for r in readers.match_notices(spark.createDataFrame(m, "ref string, org string, reference string, title string"), spark.createDataFrame(n, "ref string, org string, reference string, text string")).collect()}
    assert seen == [2] and len(rows) == 61
    assert rows["m0"] == ("n00", 2, 40, "a_verifier") and rows["m1"] == ("n01", 3, 40, "a_verifier") and rows["m2"] == ("n00", 0, 40, "a_verifier") and rows["x"] == (None, None, 0, "sans")
