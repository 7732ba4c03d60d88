"""Keys, tokens, parsers and classifiers as Column expressions; pandas UDFs only where no expression exists."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from adjudica.schema import AMOUNT_CAP

# Letters with marks and the letters they are folded to.
_MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōřśšșťțùúûüūůýÿžźż"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooorsssttuuuuuuyyzzz"
# Legal forms that a company key drops.
LEGAL_FORMS = "ste|societe|sarl|sarlau|sa|sas|snc|au|groupement|gpt|cooperative|entreprise|ets|etablissements?|bureau|cabinet|group|groupe"
# Words that do not tell companies of the sector apart.
COMMON_WORDS = (
    "ste|societe|sarl|sarlau|sa|sas|snc|au|nf|groupement|gpt|gp|cooperative|coop|entreprise|ets|etablissements?|bureau|bet|cabinet|group|groupe|de|du|des|le|la|les|et|"
    "ingenierie|ingenieurie|ingenerie|engineering|consulting|conseil|conseils|services?|travaux|etudes?|etude|laboratoire|international"
)
# What a portal puts before a buyer's name.
PORTAL_PREFIX = r"^(?:[A-Z0-9][A-Z0-9_.\-]{0,11}\s*/\s*)+[A-Z0-9][A-Z0-9_.\-]{0,19}\s*-\s*"
# Where a title begins to say where the work is.
PLACE_WORDS = "a la commune|a l arrondissement|au niveau|relevant|province|prefecture|commune|ville de|au douar|douar|sis |sise |au profit|dans la|en deux lots|en 2 lots|lot "
# Words that do not tell buyers apart, and the words of each type of buyer, most precise type first.
GENERIC_BUYER_WORDS = (
    "de du des la le les l d et en a au aux pour sur dans par directeur direction provincial provinciale regional regionale delegue delegation chef gouverneur ministere province "
    "prefecture region commune rurale urbaine territoriale ct c t collectivite collectivites public publique royaume maroc"
).split()
BUYER_TYPES = (
    ("societe", ("societe", "omrane", "alomrane", "sa", "sarl", "multiservices", "amenagement")),
    ("agence", ("agence", "office", "anep", "etablissement", "caisse", "centre national")),
    ("enseignement", ("universite", "faculte", "institut", "ecole", "academie", "aref", "lycee", "cmc", "cite des metiers")),
    ("direction", ("directeur", "direction", "delegue", "delegation", "ministere", "inspecteur", "inspection", "secretariat", "haut commissariat", "gestionnaire", "ordonnateur", "tresorier", "receveur")),
    ("commune", ("commune", "collectivite", "arrondissement", "c t", "ct", "conseil communal", "mairie")),
    ("region", ("region", "conseil regional")),
    ("province", ("gouverneur", "province", "prefecture", "wilaya", "pachalik", "cercle", "caidat", "conseil provincial", "conseil prefectoral")),
)


def fold_accents(c: Column) -> Column:
    """Lower case without marks (Latin letters); œ and æ stay letters of their own, as in NFKD."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), _MARKED, _PLAIN)


def flat(c: Column) -> Column:
    """Folded words of letters and digits, one space between: "Travaux d'aménagement" -> "travaux d amenagement"."""
    return F.trim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", " "))


def company_key(c: Column) -> Column:
    folded = fold_accents(c)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9 ]", " "), rf"\b({LEGAL_FORMS})\b", " "), "[^a-z0-9]", "")
    return F.when(short != "", short).otherwise(F.regexp_replace(folded, "[^a-z0-9]", ""))


def flat_key(c: Column) -> Column:
    """Lower case, letters and digits only; marked letters are dropped, not folded."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def buyer_key(c: Column) -> Column:
    return flat_key(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), PORTAL_PREFIX, "")))


def distinctive_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_accents(c), "[^a-z0-9 ]", " "), rf"\b({COMMON_WORDS})\b", " "), "[^a-z0-9]", "")


def index_text(c: Column) -> Column:
    """Flat text without the words that are digits only."""
    return F.array_join(F.filter(F.split(flat(c), " "), lambda w: ~w.rlike("^[0-9]+$")), " ")


def search_words(c: Column) -> Column:
    return F.filter(F.split(flat(c), " "), lambda w: w != "")


def skeleton(c: Column, words: int = 8) -> Column:
    """What a title says to be done: up to where it begins to say where, without numbers, of at most ``words`` words."""
    cut = F.regexp_replace(F.concat(F.lit(" "), flat(c)), rf" ({PLACE_WORDS}).*$", "")
    kept = F.filter(F.split(cut, " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(kept, 1, words), " ")


def _words_in(text: Column, words: tuple[str, ...]) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = F.lit(False)
    for w in words:
        out = out | padded.contains(f" {w} ")
    return out


def buyer_type(c: Column) -> Column:
    text, out = flat(c), None
    for kind, words in BUYER_TYPES:
        out = F.when(_words_in(text, words), kind) if out is None else out.when(_words_in(text, words), kind)
    return out.otherwise("autre")


def buyer_variant(c: Column) -> Column:
    """What tells two entities of one place name apart; null where the name does not say."""
    text, office = flat(c), buyer_type(c) == "direction"
    return (
        F.when(_words_in(text, ("rurale", "rural")), "rurale").when(_words_in(text, ("urbaine", "urbain")), "urbaine")
        .when(office & _words_in(text, ("provincial", "provinciale")), "provinciale").when(office & _words_in(text, ("regional", "regionale")), "regionale")
    )


def buyer_core(c: Column) -> Column:
    words = F.split(flat(c), " ")
    kept = F.filter(words, lambda w: ~w.isin(*GENERIC_BUYER_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.array_join(words, " "))


def keyword_pattern(words: list[str]) -> str:
    """A pattern over flat text: whole words with a plural s or x, ``*`` at the end for any continuation."""
    parts = []
    for w in words:
        body = re.sub(r"[^a-z0-9]+", " ", w.lower().rstrip("*")).strip()
        parts.append(re.escape(body).replace(r"\ ", " ") + ("[a-z0-9]*" if w.endswith("*") else "[sx]?" if " " not in body else ""))
    return r"(?<![a-z0-9])(" + "|".join(parts) + r")(?![a-z0-9])"


def classify(c: Column, families: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first family, in order, of which a word is in the text."""
    text, out = flat(c), None
    for name, words in families:
        hit = text.rlike(keyword_pattern(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default).cast("string")) if out is not None else F.lit(default).cast("string")


def earliest(c: Column, families: list[tuple[str, list[str]]]) -> Column:
    """The family whose word comes first in the text; ties go to the first family."""
    text = flat(c)
    places = [F.when(F.regexp_instr(text, F.lit(keyword_pattern(words))) > 0, F.struct(F.regexp_instr(text, F.lit(keyword_pattern(words))).alias("p"), F.lit(k).alias("k"), F.lit(name).alias("n"))) for k, (name, words) in enumerate(families)]
    return F.array_min(F.array_compact(F.array(*places)))["n"]


def region_of(c: Column, regions: dict[str, list[str]]) -> Column:
    """The region of the leftmost keyword, the longest at one place; null without any."""
    by_word = {w.upper(): r for r, ws in regions.items() for w in ws}
    text = F.trim(F.regexp_replace(F.upper(fold_accents(c)), "[^A-Z]+", " "))
    pattern = r"\b(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(by_word, key=lambda w: (-len(w), w))) + r")\b"
    found = F.regexp_extract(text, pattern, 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(by_word.items()) for x in kv]), F.when(found != "", found))


# qualifications


def qualification_code(c: Column) -> Column:
    """"B.1- Travaux" -> "B.1", "b1" -> "B.1", "B" -> "B"; null for what is no code."""
    pattern = r"^\W*([A-Za-z])\s*[.\-]?\s*(\d{1,2})?(?!\w)"
    letter, number = F.upper(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)
    return F.when(letter != "", F.when(number != "", F.concat(letter, F.lit("."), number.cast("int").cast("string"))).otherwise(letter))


def class_number(c: Column) -> Column:
    digits = F.regexp_extract(c.cast("string"), r"(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def class_rank(c: Column) -> Column:
    """"S" -> 0, "Classe 3" -> 3; null outside S and 1 to 5. A lower rank is a higher class."""
    text, n = F.upper(F.trim(c.cast("string"))), class_number(c)
    return F.when(text.isin("S", "CLASSE S"), 0).when(n.between(1, 5), n)


def class_proximity(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.6).when(gap == 2, 0.3).otherwise(0.0)


def requirement_codes(c: Column) -> Column:
    """All codes with a number in a label: "B.1 ou B.3" -> ["B.1", "B.3"]."""
    pattern = r"(?<![A-Za-z0-9])([A-Za-z])\s*[.\-]\s*(\d{1,2})(?!\d)"
    letters, numbers = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(letters, numbers, lambda a, n: F.concat(F.upper(a), F.lit("."), n.cast("int").cast("string")))


# amounts and dates


def parse_amount(c: Column) -> Column:
    """"1 234 567,89 DH" -> 1234567.89; with both signs, points part thousands."""
    kept = F.regexp_replace(c, r"[^0-9,.\-]", "")
    kept = F.when(kept.contains(",") & kept.contains("."), F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept)
    return F.replace(kept, F.lit(","), F.lit(".")).try_cast("double")


def sane_amount(c: Column) -> Column:
    return F.when((c > 0) & (c <= AMOUNT_CAP), c)


def parse_day(c: Column) -> Column:
    """dd/MM/yyyy at the begin of a text, null where no such day exists."""
    return F.try_to_date(F.regexp_extract(c, r"^\s*(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy")


def parse_closing(c: Column) -> Column:
    """Seven ways of writing a closing time; a day alone ends at 23:59:59."""
    text = F.trim(F.split(F.replace(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("Z"), F.lit("")), r"\+").getItem(0))
    out = []
    for form, size in (("yyyy-MM-dd'T'HH:mm:ss", 19), ("yyyy-MM-dd HH:mm:ss", 19), ("yyyy-MM-dd'T'HH:mm", 16), ("yyyy-MM-dd HH:mm", 16), ("dd/MM/yyyy HH:mm", 16)):
        out.append(F.try_to_timestamp(F.when(F.length(text) >= size, F.substring(text, 1, size)), F.lit(form)))
    for form in ("yyyy-MM-dd", "dd/MM/yyyy"):
        out.append(F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" 23:59:59")), F.lit(form + " HH:mm:ss")))
    return F.coalesce(*out)


def sort_day(opening: Column, published: Column) -> tuple[Column, Column]:
    """(sort date yyyyMMdd, doubtful) from the texts of opening and publication: an opening that is no day, or later
    than publication and a day, is doubtful, and publication then sorts."""
    o, p = parse_day(opening), parse_day(published)
    told = F.trim(F.coalesce(opening, F.lit(""))) != ""
    doubtful = told & (o.isNull() | F.coalesce(o > F.date_add(p, 1), F.lit(False)))
    day = F.when(doubtful & p.isNotNull(), p).otherwise(F.coalesce(o, p))
    return F.date_format(day, "yyyyMMdd"), doubtful


def unescaped(c: Column) -> Column:
    """Character references decoded, named and numeric ones. Only texts with an ampersand go to Python, in Arrow batches."""
    import html

    import pandas as pd

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else html.unescape(t))

    some = F.when(c.contains("&"), c)
    return F.coalesce(F.pandas_udf(decode, "string")(some), c)


def strip_html(c: Column) -> Column:
    """Text of a fragment: tags to spaces, references decoded, one space between words."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"[\s\x{A0}]+", " "))


def clamp_text(c: Column, limit: int) -> Column:
    text = F.trim(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit))
    return F.when(text != "", text)


def french_number(c: Column, digits: int = 2) -> Column:
    """1234567.5 -> "1 234 567,50"."""
    return F.translate(F.format_number(c, digits), ",.", " ,")


def publication_rank(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits != "", digits.try_cast("decimal(38,0)"))


# similarity of short texts, after blocking


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by the standard library's matcher."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _common_subsequence(x: str, y: str) -> int:
    """Length, by a row of bits: those that stay set are the letters of x that no common subsequence has used yet."""
    at: dict[str, int] = {}
    for k, p in enumerate(x):
        at[p] = at.get(p, 0) | 1 << k
    full = row = (1 << len(x)) - 1
    for q in y:
        hit = row & at.get(q, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * longest common subsequence / both lengths."""
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * _common_subsequence(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype=float)


def same_company(a: Column, b: Column) -> Column:
    """Two spellings of one name, by what is distinctive in them."""
    x, y = distinctive_name(a), distinctive_name(b)
    long = (F.length(x) >= 5) & (F.length(y) >= 5)
    return (
        F.when((x == "") | (y == ""), flat_key(fold_accents(a)) == flat_key(fold_accents(b)))
        .when(x == y, True).when(long & (x.contains(y) | y.contains(x)), True)
        .when(long, matching_blocks_ratio(x, y) > 0.86).otherwise(False)
    )
