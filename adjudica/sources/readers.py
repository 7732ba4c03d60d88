"""Readers of notices, minutes and estimations: schemas given, corrupt files skipped, work kept in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from adjudica.functions.text import buyer_key, flat, parse_amount, strip_html
from adjudica.operators.components import shared_folder
from adjudica.operators.containment import contained

MINUTES = (
    "refConsultation string, statut_extraction string, alertes array<string>, fichier string, portail struct<reference:string,acheteur:string,categorie:string,publie_le:string,lien:string>, "
    "pv struct<maitre_ouvrage:string,objet:string,numero_ao:string,procedure:string,date_ouverture_plis:string,attributaire:string,montant_attribue:double,infructueux:boolean,nombre_soumissionnaires:int,"
    "attributaires_par_lot:array<struct<lot:string,attributaire:string,montant:double>>,soumissionnaires:array<struct<nom:string,montant_acte_engagement:double,montant_apres_verification:double,statut:string,lots:array<string>>>>"
)
EXTRACT = "refConsultation_pv string, refConsultation_annonce string, orgAcronyme string, nouveau boolean, present boolean, soumissionnaires array<struct<nom:string,montant_acte_engagement:double,montant_apres_verification:double,statut:string,lots:array<string>>>"
LOTS_DETAIL = "ref string, org string, lots array<struct<lot:string,intitule:string,categorie:string,estimation:double,caution_provisoire:double,qualifications:array<struct<libelle:string,classe:string>>,agrements:string>>"
ESTIMATIONS = "refConsultation string, refConsultation_annonce string, reference string, estimation string, caution_provisoire string, confiance string, qualifications string, classes string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a file; a file that is no JSON gives a row of nulls, which goes."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).where("_corrupt IS NULL").drop("_corrupt")


def read_minutes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tenders, bids) of a folder of minutes."""
    rows = _json(spark, path, MINUTES).where("refConsultation IS NOT NULL")
    tenders = rows.select(
        F.col("refConsultation").alias("ref"), F.coalesce("portail.acheteur", "pv.maitre_ouvrage").alias("buyer"), "portail.reference", F.col("pv.objet").alias("title"), F.col("portail.publie_le").alias("published"),
        F.col("pv.date_ouverture_plis").alias("opened"), F.col("pv.attributaire").alias("winner"), F.col("pv.montant_attribue").alias("awarded"), F.coalesce("pv.infructueux", F.lit(False)).alias("unsuccessful"),
        F.concat_ws(" | ", "alertes").alias("alerts"), F.col("portail.lien").alias("link"),
    )
    return tenders, _bids(rows.select(F.col("refConsultation").alias("ref"), F.col("pv.soumissionnaires").alias("b")))


def _bids(rows: DataFrame) -> DataFrame:
    each = rows.select("ref", F.posexplode("b").alias("id", "x"))
    return each.select("ref", F.col("id").cast("long"), F.col("x.nom").alias("bidder"), F.col("x.montant_acte_engagement").alias("amount_deed"), F.col("x.montant_apres_verification").alias("amount_checked"), F.col("x.statut").alias("status"), F.concat_ws(",", "x.lots").alias("lots"))


def read_extracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extracts that are present and name a bidder; of one key the last file stays."""
    rows = _json(spark, path, EXTRACT).where("present AND size(soumissionnaires) > 0")
    key = F.coalesce("refConsultation_pv", F.concat(F.lit("c"), F.col("refConsultation_annonce")))
    last = rows.withColumn("ref", key).withColumn("_n", F.row_number().over(W.partitionBy("ref").orderBy(F.col("_file").desc()))).where("_n = 1 AND ref IS NOT NULL")
    return last.select("ref", F.col("orgAcronyme").alias("org"), F.col("nouveau").alias("new")), _bids(last.select("ref", F.col("soumissionnaires").alias("b")))


def read_lots(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, LOTS_DETAIL).select("ref", "org", F.explode("lots").alias("x"))
    return rows.select("ref", "org", F.col("x.lot").alias("lot"), F.col("x.intitule").alias("title"), F.col("x.estimation").alias("estimation"), F.col("x.caution_provisoire").alias("deposit"), F.col("x.qualifications").alias("qualifications"))


def read_estimations(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon file with a byte order mark and JSON cells."""
    rows = spark.read.schema(ESTIMATIONS).option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    plain = rows.withColumns({c: F.translate(c, "﻿", "") for c in rows.columns})
    return plain.select(
        F.col("refConsultation").alias("ref"), F.col("refConsultation_annonce").alias("notice_ref"), "reference", parse_amount(F.col("estimation")).alias("estimation"), parse_amount(F.col("caution_provisoire")).alias("deposit"),
        F.col("confiance").alias("confidence"), F.from_json("qualifications", "array<struct<libelle:string,classe:string>>").alias("qualifications"), F.from_json("classes", "array<string>").alias("classes"),
    )


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """(ref, org, text, reference): the reference is what stands before the first dash of the listed text."""
    rows = spark.read.option("sep", ";").option("header", True).schema("refConsultation string, orgAcronyme string, texte string").csv(path)
    return rows.select(F.translate("refConsultation", "﻿", "").alias("ref"), F.col("orgAcronyme").alias("org"), F.col("texte").alias("text"), F.regexp_extract("texte", r"^\s*([^\s].*?)\s+-\s", 1).alias("reference"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(merged, kept): manual merges with chains followed to their end; a cycle is an error."""
    rows = spark.read.option("sep", ";").option("header", True).schema("cle_garder string, cle_fusionner string, raison string").csv(path)
    return close_merges(rows.select(F.col("cle_fusionner").alias("merged"), F.translate("cle_garder", "﻿", "").alias("kept")))


def close_merges(links: DataFrame, max_steps: int = 30) -> DataFrame:
    """Each merged key with the last key of its chain. Steps double, so that 30 follow any real chain."""
    shared_folder(links.sparkSession)  # a checkpoint folder, where none is set
    now = links.select("merged", "kept")
    for _ in range(max_steps):
        nxt = now.select(F.col("merged").alias("_m"), F.col("kept").alias("_k"))
        step = now.join(nxt, now.kept == nxt._m, "left").select("merged", F.coalesce("_k", "kept").alias("kept"), F.col("_m").isNotNull().alias("_moved")).checkpoint()
        if step.where("merged = kept").limit(1).count():
            raise ValueError("manual merges form a cycle")
        now = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return now
    raise ValueError("manual merges form a cycle")


def portal_wins(ocr: DataFrame, portal: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both records of a key merged, the portal's values first; rows that only one side has stay."""
    a, b = ocr.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]), portal.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_portal"))
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_p_{c}", f"_o_{c}").alias(c) for c in columns], F.coalesce("_portal", F.lit(False)).alias("from_portal"))


def match_notices(minutes: DataFrame, notices: DataFrame) -> DataFrame:
    """(ref, notice_ref, common, candidates, confidence) of each minutes row (ref, org, reference, title) and its notice (ref, org, reference, text): of
    the same organisation, with a line (reference and text) that holds the row's reference. Of several the one with most long words of the title.

    confidence: ``reference`` where it is the only one, ``objet`` where three words or more are common and no other notice has as many,
    else ``a_verifier``; ``sans`` without any notice. Rows without reference have none. Ties go to the smallest notice_ref.
    """
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9/]", "")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[A-ZÀ-ÿ]{5,}"), F.lit(0)))
    line = F.concat_ws(" ", "reference", "text")
    m = minutes.select("ref", F.col("org").alias("block"), plain(F.col("reference")).alias("text"), F.sort_array(words(F.col("title"))).alias("_w"))
    n = notices.select(F.col("ref").alias("id"), F.col("org").alias("block"), plain(line).alias("text"))
    # a reference is sought once, however many rows have it, and rows and notices of the same words are counted, not paired
    sought = m.select(F.struct("block", "text").alias("id"), "block", "text").distinct()
    held = contained(sought, n).join(notices.select(F.col("ref").alias("id2"), F.sort_array(words(line)).alias("_v")), "id2").groupBy("id.block", "id.text", "_v").agg(F.count(F.lit(1)).alias("n"), F.min("id2").alias("least"))
    both = m.select("block", "text", "_w").distinct().join(held, ["block", "text"]).select("block", "text", "_w", F.size(F.array_intersect("_w", "_v")).alias("common"), "n", "least")
    levels = both.groupBy("block", "text", "_w", "common").agg(F.sum("n").alias("level"), F.min("least").alias("notice_ref"))
    first = levels.groupBy("block", "text", "_w").agg(F.sum("level").alias("candidates"), F.max_by(F.struct("common", "level", "notice_ref"), "common").alias("_b")).select("block", "text", "_w", "candidates", "_b.*")
    sure = F.when(F.col("notice_ref").isNull(), "sans").when(F.col("candidates") == 1, "reference").when((F.col("common") >= 3) & (F.col("level") == 1), "objet").otherwise("a_verifier")
    rows = m.join(first, ["block", "text", "_w"], "left")
    return rows.select("ref", "notice_ref", "common", F.coalesce("candidates", F.lit(0)).alias("candidates"), sure.alias("confidence"))


def matching_quality(matches: DataFrame) -> DataFrame:
    """(confidence, n, percent) of ``match_notices``' rows."""
    n = matches.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("confidence", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))  # one row


# HTML pages


class _Tables(HTMLParser):
    """Rows of cells of every table, and label/value pairs of definition lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.table = -1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self.rows.append([str(self.table)])
        elif tag in ("td", "th", "dt", "dd"):
            self.close_cell()
            if tag == "dt":
                self.rows.append(["-1"])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "dt", "dd", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def page_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, n, table_no, cells): every row of every table of a page, in order."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, html in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                parser = _Tables()
                parser.feed(html or "")
                parser.close()
                parser.close_cell()
                out += [(key, n, int(r[0]), r[1:]) for n, r in enumerate(parser.rows) if len(r) > 1]
            yield pd.DataFrame(out, columns=["id", "n", "table_no", "cells"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, n int, table_no int, cells array<string>")


def label_values(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, values): map of flat label to value, of rows of two cells; the first value of a label stays."""
    rows = page_rows(pages, id_col, html_col).where("size(cells) = 2").select("id", "n", flat(F.get("cells", 0)).alias("label"), F.get("cells", 1).alias("value")).where("label <> ''")
    first = rows.groupBy("id", "label").agg(F.min_by("value", "n").alias("value"))
    return first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("values"))


def minutes_bidders(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, seq, bidder, amount_deed, amount_checked, status) of the table whose header names a bidder and an amount."""
    rows = page_rows(pages, id_col, html_col).withColumn("head", flat(F.array_join("cells", " ")))
    heads = rows.where(F.col("head").rlike("(concurrent|soumissionnaire|societe)") & F.col("head").rlike("montant")).groupBy("id").agg(F.min(F.struct("n", "table_no")).alias("h"))
    body = rows.join(heads, "id").where("table_no = h.table_no AND n > h.n")
    amount = lambda k: parse_amount(F.get("cells", k))
    status = F.when(F.col("head").rlike("ecarte"), "ecarte").when(F.col("head").rlike("attributaire"), "attributaire").otherwise("admis")
    return body.select("id", F.col("n").alias("seq"), F.get("cells", 0).alias("bidder"), amount(1).alias("amount_deed"), amount(2).alias("amount_checked"), status.alias("status"))


def page_lots(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, lot, title, estimation, deposit) of the tables whose header names a lot; columns are found by their heading, wherever they stand."""
    rows = page_rows(pages, id_col, html_col).withColumn("flat", F.transform("cells", lambda c: flat(c)))
    heads = rows.where(F.exists("flat", lambda c: c.rlike(r"^(n )?lots?\b")) & (F.size("cells") > 1)).groupBy("id", "table_no").agg(F.min(F.struct("n", "flat")).alias("h"))
    body = rows.join(heads, ["id", "table_no"]).where("n > h.n")
    place = lambda pattern: F.array_position(F.transform("h.flat", lambda c: c.rlike(pattern)), True) - 1
    cell = lambda pattern: F.when(place(pattern) >= 0, F.get("cells", place(pattern).cast("int")))
    lots = body.select("id", "n", cell(r"^(n )?lots?\b").alias("lot"), cell("intitule|objet|designation").alias("title"), parse_amount(cell("estimation|cout")).alias("estimation"), parse_amount(cell("caution")).alias("deposit"))
    return lots.where("trim(coalesce(lot, '')) <> ''").drop("n")


def notice_sheets(details: DataFrame, minutes: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, values, bidders, awarded): a notice's labelled values, and of its minutes page, where there is one, the number of bidders and whether one was
    chosen."""
    told = label_values(details, id_col, html_col)
    bids = minutes_bidders(minutes, id_col, html_col).groupBy("id").agg(F.count(F.lit(1)).alias("bidders"), F.bool_or(F.col("status") == "attributaire").alias("awarded"))
    notices = details.select(F.col(id_col).alias("id")).distinct()
    return notices.join(told, "id", "left").join(bids, "id", "left").select("id", "values", F.coalesce("bidders", F.lit(0)).alias("bidders"), F.coalesce("awarded", F.lit(False)).alias("awarded"))


def page_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, href, text), each once a page."""
    pattern = r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2)).alias("text"))
    rows = pages.select(F.col(id_col).alias("id"), F.explode(pairs).alias("x"))
    return rows.select("id", "x.href", strip_html(F.col("x.text")).alias("text")).distinct()


def feature_flags(pages: DataFrame, html_col: str, patterns: dict[str, str]) -> DataFrame:
    return pages.withColumns({name: F.col(html_col).rlike(p) for name, p in patterns.items()})


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) of downloaded files, kind by the first bytes."""
    rows = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    return rows.select("path", "length", F.when(F.startswith(head, F.lit("25504446")), "pdf").when(F.startswith(head, F.lit("504B0304")), "zip").otherwise("other").alias("kind"))


def buyer_dimension(tenders: DataFrame) -> DataFrame:
    """(buyer_key, buyer, tenders): the most frequent spelling of each key."""
    n = tenders.groupBy(buyer_key(F.col("buyer")).alias("buyer_key"), "buyer").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("buyer_key").agg(F.max_by("buyer", F.struct("n", "buyer")).alias("buyer"), F.sum("n").alias("tenders"))
