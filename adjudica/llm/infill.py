"""Fill-in-middle: documents cut in prefix, middle and suffix at token bounds, and put in another order.

A token is white space with the word that follows it, or white space that no word follows. The Split
pre-tokenizer of the tokenizers library, with each match of ``TOKEN`` isolated, gives the code-point offsets
of all tokens of a text; nothing is trained. The number of offsets is n, two draws of a hash of seed and
doc_id choose two ranks among them, and the offsets at these ranks are the cuts. Only n and the cuts come
back from Python: slices, forms and hashes are expressions, and the text stays where it was read. There is
no shuffle, so a lost executor costs its own rows.

Memory: a text's offsets are taken ``CHUNK`` code points at a time; a chunk ends after a word, where a token
ends in any case, so that the pieces give the tokens of the whole text.

Results in odd cases: a null text is empty; an empty text has n = 0, is plain and gives itself. A null doc_id
is hashed as the empty string. Rows that are equal, or share a doc_id, are cut alike, each for itself; there
are no ties, as a rank names one offset. Very long texts, and very long words or blanks, are cut like others.
Of the input only the two named columns are read, so that no other column can clash; an empty table gives
no row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm.common import base_rows

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 18

_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def chunks(text: str, size: int = CHUNK):
    """(start, part) of consecutive parts of ``text``, each of ``size`` code points and what its last token needs."""
    start = 0
    while len(text) - start > size:
        found = _WORD_END.search(text, start + size - 1)
        if found is None:
            break
        yield start, text[start : found.end()]
        start = found.end()
    if start < len(text):
        yield start, text[start:]


def token_splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(TOKEN), "isolated").pre_tokenize_str


def token_ends(split, text: str, size: int = CHUNK) -> list[int]:
    """Code points before the end of each token, in order."""
    return [start + end for start, part in chunks(text, size) for _, (_, end) in split(part)]


def _cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    split, rows = token_splitter(), []
    for t, a, b in zip(text, h1, h2):
        ends = token_ends(split, t)
        a, b = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
        rows.append((len(ends), ends[a - 1] if a else 0, ends[b - 1] if b else 0))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix, middle and suffix (null: plain), output: one row a document.

    ``fim_percent`` of the documents, drawn by hash, are cut, ``spm_percent`` of these with the suffix first. A text that is empty
    or holds one of the three marks stays plain, so that ``restored`` finds the marks and nothing else.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = base_rows(docs, id_col, text_col).withColumn("digest", digest)
    cuts = F.pandas_udf(_cuts, "n long, first long, second long")
    cut = rows.withColumn("cuts", cuts("text", _draw(F.col("digest"), 0), _draw(F.col("digest"), 1)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    sliced = cut.select("doc_id", "text", F.col("cuts.n").alias("n"), F.col("cuts.first").cast("int").alias("a"), F.col("cuts.second").cast("int").alias("b"), form.alias("form"))
    text, parts = F.col("text"), F.col("form") != "plain"
    sliced = sliced.withColumns({
        "prefix": F.when(parts, F.substr(text, F.lit(1), F.col("a"))),
        "middle": F.when(parts, F.substr(text, F.col("a") + 1, F.col("b") - F.col("a"))),
        "suffix": F.when(parts, F.substr(text, F.col("b") + 1)),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return sliced.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The document of an output and its form: the parts between the marks in reading order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return F.when(form == "psm", F.concat(first, F.get(parts, F.lit(3)), second)).when(form == "spm", F.concat(second, F.get(parts, F.lit(3)), first)).otherwise(output)


def contract(docs: DataFrame) -> DataFrame:
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
