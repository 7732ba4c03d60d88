"""Minutes pages as a state machine over parser events: the section that a heading opens says what a table's rows are.

A task turns a page into its labelled fields and its rows with their section, no more; who bid, was set aside, admitted or
chosen, for which lot and for what, is told by expressions over these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from adjudica.functions.text import flat_key, parse_amount

# Headings of the sections, and what marks a page that is no empty shell.
SECTIONS = {
    "deposes": "Liste des concurrents ayant d[ée]pos[ée] un pli",
    "dossier_administratif": "Dossier Administratif",
    "dossier_technique": "Dossier Technique",
    "offre_financiere": "Offre Financi[èe]re",
    "evinces": "Liste des concurrents ou architectes [ée]vinc[ée]s",
    "admis_sans_reserve": "Liste des concurrents ou architectes admissibles sans r[ée]serve",
    "admis_avec_reserve": "Liste des concurrents ou architectes admissibles avec r[ée]serve",
    "montants": "Montant des actes d'engagement des concurrents",
    "retenus": "Concurrents Retenus",
    "justification": "Justification du choix de l'attributaire",
    "infructueux": "D[ée]claration Infructueux",
    "achevement": "Date d'ach[èe]vement des travaux de la commission",
}
SHELL = ("ctl0_CONTENU_PAGE_mainPart", "Montant des actes")
STATUSES = ["depose", "admis", "ecarte_dossier_administratif_technique", "ecarte_offre_technique", "attributaire"]

_HEADINGS = [(name, re.compile(p, re.I)) for name, p in SECTIONS.items()]
_PAGE = "id {}, fields array<struct<label:string,value:string>>, rows array<struct<n:int,section:string,cells:array<string>>>, texts array<struct<section:string,text:string>>"


class _Minutes(HTMLParser):
    """States: the open section, the phase of the file (administrative or technical), the row and the cell or field being read."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.section, self.phase = "", ""
        self.rows: list[tuple[int, str, list[str]]] = []
        self.fields: list[tuple[str, str]] = []
        self.texts: dict[str, list[str]] = {}
        self.row: list[str] | None = None
        self.parts: list[str] | None = None  # of the open cell or field
        self.kind = ""
        self.never = self.depth = 0
        self.label = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.never += 1
        elif tag == "tr":
            self._row_ends()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self._piece_ends()
            self.parts, self.kind = [], "cell"
        elif tag == "div":
            said = dict(attrs).get("class") or ""
            kind = "label" if "intitule" in said else "value" if "content-bloc" in said and self.label is not None else ""
            if kind and self.kind != "cell":
                self._piece_ends()
                self.parts, self.kind, self.depth = [], kind, 0
            elif self.parts is not None:
                self.depth += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.never = max(0, self.never - 1)
        elif tag in ("td", "th") and self.kind == "cell":
            self._piece_ends()
        elif tag in ("tr", "table"):
            self._row_ends()
        elif tag == "div" and self.kind in ("label", "value"):
            if self.depth:
                self.depth -= 1
            else:
                self._piece_ends()

    def handle_data(self, data):
        if self.never:
            return
        if self.parts is not None:
            self.parts.append(data)
        if self.kind == "cell":
            return
        found = max(((m.end(), name) for name, p in _HEADINGS for m in p.finditer(data)), default=None)
        if found:
            self.section = found[1]
            if self.section.startswith("dossier"):
                self.phase = self.section
            data = data[found[0] :]
            self.texts[self.section] = []
        if self.section and data.strip():
            self.texts.setdefault(self.section, []).append(data)

    def _piece_ends(self):
        if self.parts is None:
            return
        text, kind = " ".join("".join(self.parts).split()), self.kind
        self.parts, self.kind = None, ""
        if kind == "cell":
            self.row.append(text)
        elif kind == "label":
            self.label = text.strip(" :*")
        else:
            self.fields.append((self.label, text))
            self.label = None

    def _row_ends(self):
        if self.kind == "cell":
            self._piece_ends()
        if self.row is not None and any(self.row):
            section = "evinces_technique" if self.section == "dossier_technique" or (self.section == "evinces" and self.phase == "dossier_technique") else self.section
            self.rows.append((len(self.rows), section, self.row))
        self.row = None

    def told(self) -> list[tuple[str, str]]:
        """Labels with their values, first ones only. A label that holds its value (`` : ``) passes the value beside it to the next label without one."""
        out, waiting = {}, ""
        for label, value in self.fields:
            if " : " in label:
                left, _, right = label.partition(" : ")
                out.setdefault(left.strip(" :*"), right.strip())
                waiting = value
            elif label:
                if not value and waiting:
                    value, waiting = waiting, ""
                out.setdefault(label, value)
        return list(out.items())


def minutes_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, fields, rows, texts) of each page that is no empty shell."""
    own = pages.where(F.col(html_col).contains(SHELL[0]) & F.col(html_col).contains(SHELL[1])).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, html in zip(frame.id, frame.html):
                parser = _Minutes()
                parser.feed(html)
                parser.close()
                parser._row_ends()
                out.append((key, parser.told(), parser.rows, [(k, " ".join(" ".join(v).split())) for k, v in parser.texts.items()]))
            yield pd.DataFrame(out, columns=["id", "fields", "rows", "texts"])

    return own.mapInPandas(run, _PAGE.format(pages.schema[id_col].dataType.simpleString()))


def page_bidders(rows: DataFrame) -> DataFrame:
    """(id, seq, bidder, lot, status, amount_deed, amount_checked): one row a company and lot of ``minutes_rows``.

    The strongest status of a company counts: chosen, set aside for its technical offer, for its file, admitted, deposited. A company
    that is described by lot has no row without lot.
    """
    levels = {"deposes": 0, "admis_sans_reserve": 1, "admis_avec_reserve": 1, "montants": 1, "evinces": 2, "evinces_technique": 3, "retenus": 4}
    level = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    each = rows.select("id", F.explode("rows").alias("r")).select("id", "r.n", "r.section", F.trim(F.get("r.cells", 0)).alias("bidder"), F.slice("r.cells", 2, 100).alias("others")).where(F.col("section").isin(*levels))
    each = each.where((F.col("bidder") != "") & ~F.col("bidder").rlike("(?i)^(concurrents?|entreprises participantes|num[ée]ro lot|lot|n[ée]ant|aucun r[ée]sultat)$"))
    amounts = F.array_compact(F.transform("others", lambda c: parse_amount(c)))
    words = F.filter("others", lambda c: (F.trim(c) != "") & parse_amount(c).isNull())
    priced = F.col("section").isin("montants", "retenus")
    each = each.withColumns({"amounts": amounts, "word": F.get(words, 0)}).where(~priced | (F.size("amounts") > 0))
    lots = F.when(priced | F.col("word").isNull(), F.array("word")).otherwise(F.split("word", r"\s*[,;/]\s*"))
    each = each.withColumn("lot", F.explode(lots)).withColumn("lot", F.nullif(F.trim("lot"), F.lit("")))
    each = each.withColumns({"key": flat_key(F.col("bidder")), "level": F.element_at(level, F.col("section"))})
    first = lambda section, value: F.max_by(F.when(F.col("section") == section, value), F.when(F.col("section") == section, F.col("n")))
    told = each.groupBy("id", "key", "lot").agg(
        F.min("n").alias("seq"), F.min_by("bidder", "n").alias("bidder"), F.max("level").alias("level"), first("montants", F.get("amounts", 0)).alias("deed"), first("retenus", F.get("amounts", 0)).alias("chosen"),
        first("montants", F.when(F.size("amounts") > 1, F.element_at("amounts", -1))).alias("amount_checked"),
    )
    lotted = told.where("lot IS NOT NULL").select("id", "key").distinct()
    kept = told.where("lot IS NOT NULL").unionByName(told.where("lot IS NULL").join(lotted, ["id", "key"], "left_anti"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("level") + 1)
    return kept.select("id", "seq", "bidder", "lot", status.alias("status"), F.coalesce("deed", "chosen").alias("amount_deed"), "amount_checked")


def read_minutes_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, reference, title, buyer, procedure, estimation, deposit, justification, unsuccessful, winner, amount, n_bidders, bidders, lots) of each page;
    winner and amount where one company and lot is chosen. ``bidders`` in order of the page; ``lots``: the chosen of each lot."""
    rows = minutes_rows(pages, id_col, html_col)
    bids = page_bidders(rows)
    chosen = F.col("status") == "attributaire"
    summed = bids.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "bidder", "lot", "status", "amount_deed", "amount_checked"))).alias("bidders"), F.count_distinct(flat_key(F.col("bidder"))).alias("n_bidders"),
        F.sort_array(F.collect_list(F.when(chosen & F.col("lot").isNotNull(), F.struct("lot", F.col("bidder").alias("winner"), F.col("amount_deed").alias("amount"))))).alias("lots"),
        F.when(F.count_if(chosen) == 1, F.max(F.when(chosen, F.struct("bidder", "amount_deed")))).alias("one"),
    )
    value = lambda pattern: F.get(F.transform(F.filter("fields", lambda f: f["label"].rlike(f"(?i){pattern}") & ~F.coalesce(f["value"], F.lit("")).isin("", "-", "*")), lambda f: f["value"]), 0)
    text = lambda section: F.get(F.transform(F.filter("texts", lambda t: t["section"] == section), lambda t: t["text"]), 0)
    head = rows.select(
        "id", value("^R[ée]f[ée]rence").alias("reference"), value("^Objet").alias("title"), value("Acheteur public").alias("buyer"), value("^Proc[ée]dure").alias("procedure"), parse_amount(value("^Estimation|Dhs TTC")).alias("estimation"),
        parse_amount(value("Caution provisoire")).alias("deposit"), F.left(F.nullif(text("justification"), F.lit("")), F.lit(400)).alias("justification"),
        (text("infructueux").isNotNull() & ~F.coalesce(text("infructueux"), F.lit("")).rlike(r"(?i)^\W*n[ée]ant")).alias("unsuccessful"),
    )
    done = head.join(summed, "id", "left")
    return done.select(*head.columns, F.col("one.bidder").alias("winner"), F.col("one.amount_deed").alias("amount"), F.coalesce("n_bidders", F.lit(0)).alias("n_bidders"), *[F.coalesce(c, F.array().cast(summed.schema[c].dataType)).alias(c) for c in ("bidders", "lots")])
