"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from adjudica.operators.components import shared_folder
from adjudica.sources import readers, sinks
from adjudica.streaming import limits


def test_minutes_and_corrupt_files(spark, tmp_path):
    good = {"refConsultation": "7", "alertes": ["a", "b"], "portail": {"acheteur": "COMMUNE X", "reference": "1/26"}, "pv": {"objet": "Route", "infructueux": False, "soumissionnaires": [{"nom": "A", "montant_acte_engagement": 9.0, "statut": "admis", "lots": ["1", "2"]}]}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    tenders, bids = readers.read_minutes(spark, str(tmp_path))
    assert [(r.ref, r.buyer, r.alerts) for r in tenders.collect()] == [("7", "COMMUNE X", "a | b")]
    assert [(r.bidder, r.amount_deed, r.lots) for r in bids.collect()] == [("A", 9.0, "1,2")]


def test_extracts_last_file_wins(spark, tmp_path):
    row = {"refConsultation_annonce": "5", "orgAcronyme": "o", "present": True, "soumissionnaires": [{"nom": "A", "montant_acte_engagement": 1.0}]}
    (tmp_path / "1.json").write_text(json.dumps(row))
    (tmp_path / "2.json").write_text(json.dumps(row | {"soumissionnaires": [{"nom": "B", "montant_acte_engagement": 2.0}]}))
    (tmp_path / "3.json").write_text(json.dumps(row | {"present": False}))
    tenders, bids = readers.read_extracts(spark, str(tmp_path))
    assert [r.ref for r in tenders.collect()] == ["c5"] and [r.bidder for r in bids.collect()] == ["B"]


def test_estimations_and_merges(spark, tmp_path):
    (tmp_path / "e.csv").write_text('﻿refConsultation;refConsultation_annonce;reference;estimation;caution_provisoire;confiance;qualifications;classes\n1;2;12/26;1 000,50;10;sure;"[{""libelle"":""B.1"",""classe"":""3""}]";"[""3""]"\n', encoding="utf-8")
    r = readers.read_estimations(spark, str(tmp_path / "e.csv")).first()
    assert (r.ref, r.estimation, r.qualifications[0].libelle, r.classes) == ("1", 1000.5, "B.1", ["3"])
    shared_folder(spark)
    (tmp_path / "m.csv").write_text("cle_garder;cle_fusionner;raison\nb;a;x\nc;b;x\n")
    assert {(r.merged, r.kept) for r in readers.read_merges(spark, str(tmp_path / "m.csv")).collect()} == {("a", "c"), ("b", "c")}
    (tmp_path / "bad.csv").write_text("cle_garder;cle_fusionner;raison\nb;a;x\na;b;x\n")
    with pytest.raises(ValueError):
        readers.read_merges(spark, str(tmp_path / "bad.csv"))


def test_pages(spark):
    html = "<table><tr><th>Concurrent</th><th>Montant acte</th></tr><tr><td>STE A</td><td>1 200,00</td></tr><tr><td>B &amp; C</td><td>900</td></tr></table><table><tr><td>Estimation :</td><td>5 000</td></tr></table><a href='/x'>Un <b>lien</b></a>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [(r.bidder, r.amount_deed) for r in readers.minutes_bidders(pages, "id", "html").orderBy("seq").collect()] == [("STE A", 1200.0), ("B & C", 900.0)]
    assert readers.label_values(pages, "id", "html").first()["values"]["estimation"] == "5 000"
    assert [(r.href, r.text) for r in readers.page_links(pages, "id", "html").collect()] == [("/x", "Un lien")]


def test_matching(spark):
    m = spark.createDataFrame([("m1", "o", "12/2025", "Route de Taza")], "ref string, org string, reference string, title string")
    n = spark.createDataFrame([("n1", "o", "12/2025/X", "Route de Taza nord"), ("n2", "o", "12/2025", "autre chose"), ("n3", "p", "12/2025", "Route de Taza")], "ref string, org string, reference string, text string")
    r = readers.match_notices(m, n).first()
    assert (r.notice_ref, r.candidates, r.confidence) == ("n1", 2, "a_verifier")  # one long word in common


BODY = {"clients": ["Samir"], "appels_ouverts": [{"ref_annonce": "9", "date_limite": "2026-12-01", "objet": "x", "estimation": "1 000", "clients": ["Hicham", "Pako"], "lots": [{"lot": "2", "estimation": "5"}, {"lot": "1"}], "inconnu": 1}, {"ref_annonce": "", "date_limite": "2026-12-01"}, {"ref_annonce": "8"}]}


def test_push_contract(spark):
    parts = sinks.parse_push(spark.createDataFrame([(json.dumps(BODY),)], "body string"))
    good, bad = sinks.judged(parts["notices"])
    assert [r.notice_ref for r in good.collect()] == ["9"] and bad.count() == 2 and all(r.reason for r in bad.collect())
    assert "inconnu" in good.first().raw and good.first().estimation == 1000
    assert sorted(r.client for r in parts["clients"].where("notice_ref = '9'").collect()) == ["Hicham", "Pako", "Samir"]
    assert sorted(r.lot for r in parts["lots"].collect()) == ["1", "2"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, v double, always string")
    new = spark.createDataFrame([("a", None, None), ("c", 3.0, "z")], "k string, v double, always string")
    once = sinks.upsert(old, new, "k", ["v"], ["always"])
    twice = sinks.upsert(once, new, "k", ["v"], ["always"])
    want = {("a", 1.0, None), ("b", 2.0, "y"), ("c", 3.0, "z")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_changes_and_publication(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, v string")
    assert {(r.k, r.kind) for r in sinks.changes(a, b, ["k"], ["v"]).collect()} == {(2, "changement"), (3, "ajout")}
    path = str(tmp_path / "t")
    sinks.publish(spark, spark.range(100), path, "1")
    with pytest.raises(ValueError):
        sinks.publish(spark, spark.range(50), path, "2")
    sinks.write_snapshot(spark.range(3), str(tmp_path / "s"), "courant")
    sinks.write_snapshot(spark.range(2), str(tmp_path / "s"), "jusqua-2025")
    sinks.write_snapshot(spark.range(4), str(tmp_path / "s"), "courant")
    assert {(r.calculation, r["count"]) for r in spark.read.parquet(str(tmp_path / "s")).groupBy("calculation").count().collect()} == {("courant", 4), ("jusqua-2025", 2)}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, 1_767_225_600 + 40 * k, k % 3) for k in range(200)], "id long, s long, u long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = limits.tumbling(stream, "u", "ts", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in limits.tumbling(rows, "u", "ts", "10 minutes").collect()}
    assert {tuple(r) for r in spark.table("tumbling").collect()} == want
    seen = []
    limits.feed(stream, lambda batch, _: seen.append(batch.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 200


def test_limits(spark):
    rows = spark.createDataFrame([("u", s) for s in (0, 10, 59, 60, 61)], "u string, s long")
    assert [r.recent for r in limits.sliding_count(rows, "u", "s", 60).orderBy("s").collect()] == [1, 2, 3, 4, 4]  # what is exactly 60 seconds old counts
    assert [r.over for r in limits.refused(rows, "u", "s", {60: 2}).orderBy("s").collect()] == [False, False, True, True, True]


def test_lots_and_notices(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text(json.dumps({"ref": "7", "org": "o", "lots": [{"lot": "1", "intitule": "Voirie", "estimation": 10.5, "qualifications": [{"libelle": "B.1", "classe": "3"}]}, {"lot": "2", "caution_provisoire": 1.0}]}))
    (tmp_path / "l" / "b.json").write_text("[")
    got = {(r.ref, r.org, r.lot, r.title, r.estimation, r.deposit) for r in readers.read_lots(spark, str(tmp_path / "l")).collect()}
    assert got == {("7", "o", "1", "Voirie", 10.5, None), ("7", "o", "2", None, None, 1.0)}
    (tmp_path / "n.csv").write_text("\ufeffrefConsultation;orgAcronyme;texte\n9;x;12/2026 - Travaux de route\n", encoding="utf-8")
    r = readers.read_notices(spark, str(tmp_path / "n.csv")).first()
    assert (r.ref, r.org, r.reference) == ("9", "x", "12/2026")


def test_binary_files_by_their_first_bytes(spark, tmp_path):
    for name, raw in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"PK\x03\x04zz"), ("c.pdf", b"<html>")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.length) for r in readers.binary_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", 10), "b.pdf": ("zip", 6), "c.pdf": ("other", 6)}


def test_csv_export(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1+1", 2.5), ("plain é", None)], "name string, amount double").coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname;amount\n") and "'=1+1;2.5" in raw.decode() and "plain é;" in raw.decode()


def test_page_lots_and_sheets(spark):
    lots = "<table><tr><th>Montant</th></tr><tr><td>1</td></tr></table><table><tr><th>N° lot</th><th>Caution provisoire</th><th>Intitulé</th><th>Estimation</th></tr><tr><td>1</td><td>500,00</td><td>Voirie</td><td>1 000,50 DH</td></tr><tr><td>2</td><td></td><td>Éclairage</td><td></td></tr></table>"
    pages = spark.createDataFrame([(1, lots), (2, "<p>none</p>"), (3, None)], "id long, html string")
    assert {tuple(r) for r in readers.page_lots(pages, "id", "html").collect()} == {(1, "1", "Voirie", 1000.5, 500.0), (1, "2", "Éclairage", None, None)}
    details = spark.createDataFrame([(1, "<table><tr><td>Objet</td><td>Route</td></tr></table>"), (2, "<p>x</p>")], "id long, html string")
    minutes = spark.createDataFrame([(1, "<table><tr><th>Concurrent</th><th>Montant</th></tr><tr><td>A</td><td>9</td></tr><tr><td>B attributaire</td><td>8</td></tr></table>")], "id long, html string")
    got = {r.id: (r["values"], r.bidders, r.awarded) for r in readers.notice_sheets(details, minutes, "id", "html").collect()}
    assert got == {1: ({"objet": "Route"}, 2, True), 2: (None, 0, False)}
