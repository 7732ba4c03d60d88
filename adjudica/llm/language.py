"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary that are letters only, in lower case, of at most ``MAX_PIECE``
characters. Each language has a probability for every piece, and one for any other single letter. A
word's probability is the sum over all its segmentations, by a forward pass that is scaled as it goes, so that words of any
length have one; a text's is the product over its words (runs of letters), times the language's share of the fitted documents. Piece probabilities are fitted
by expectation-maximisation: forward and backward passes give expected uses of each piece, which Spark
sums over the distinct words of the fitted texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import base_rows, stored

MAX_PIECE = 6
#: Places after which the forward and backward passes are scaled anew, so that products stay within a double.
PART = 16
#: Places of a word of which the piece numbers are held at once.
REACH = 4096
_LETTERS = regex.compile(r"\p{L}+")
PREDICTED = "doc_id long, lang_pred string, score double"


def vocabulary(path: str) -> list[str]:
    """Pieces of a rank file (base64 bytes and rank a line): letters only, lower case, without leading space."""
    found = set()
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").removeprefix(" ").lower()
                if 0 < len(piece) <= MAX_PIECE and piece.isalpha():
                    found.add(piece)
    return sorted(found)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Pieces:
    """Numbers of pieces; the last two stand for any other single letter and for no piece at all."""

    def __init__(self, names: list[str]):
        self.at = {p: k for k, p in enumerate(names)}
        self.other, self.none = len(names), len(names) + 1

    def grid(self, words: list[str]) -> np.ndarray:
        """[word, start, length - 1] -> number, for words of one length."""
        n = len(words[0])
        get, none, other = self.at.get, self.none, self.other
        flat = [get(w[i : i + m], none) if m > 1 else get(w[i], other) for w in words for i in range(n) for m in range(1, MAX_PIECE + 1) if i + m <= n]
        out = np.full((len(words), n, MAX_PIECE), none, np.int32)
        i, m = np.array([(i, m - 1) for i in range(n) for m in range(1, MAX_PIECE + 1) if i + m <= n]).T
        out[:, i, m] = np.array(flat, np.int32).reshape(len(words), -1)
        return out


def forward(grid: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha [word, place, language], scale [part, word, language]): the probability of the first ``place`` letters over all
    segmentations is alpha * exp(scale of the place's part)."""
    words, n, _ = grid.shape
    alpha, scale = np.zeros((words, n + 1, p.shape[1])), np.zeros((n // PART + 1, words, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        own = (j - 1) // PART
        for m in range(1, min(MAX_PIECE, j) + 1):
            term = alpha[:, j - m] * p[grid[:, j - m, m - 1]]
            alpha[:, j] += term if (j - m) // PART == own else term * np.exp(scale[own - 1] - scale[own])
        if j % PART == 0:
            scale[own + 1] = scale[own] + np.log(alpha[:, j])
            alpha[:, j] = 1
    return alpha, scale


def log_probability(own: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """[word, language]: logarithms of what ``forward`` gives for whole words of one length, with the last places in hand only."""
    n = len(words[0])
    last = [np.ones((len(words), p.shape[1]))]  # of the places before, latest first
    scale = np.zeros((len(words), p.shape[1]))
    for c in range(0, n, REACH):
        begin = max(0, c - MAX_PIECE + 1)
        grid = own.grid([w[begin : c + REACH] for w in words])
        for j in range(c + 1, min(c + REACH, n) + 1):
            new = sum(a * p[grid[:, j - m - begin, m - 1]] for m, a in enumerate(last, 1))
            last = [new, *last[: MAX_PIECE - 1]]
            if j % PART == 0:
                scale += np.log(new)
                last = [a / new for a in last]
    return scale + np.log(np.maximum(last[0], 1e-300))


def expected_uses(grid: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """[piece, language]: expected uses over all segmentations of words seen ``times`` [word, language]."""
    words, n, _ = grid.shape
    alpha, scale = forward(grid, p)
    back = np.full_like(grid, len(p) - 1)  # the words read backwards: the piece of a length that ends where this one begins
    for m in range(1, MAX_PIECE + 1):
        if n >= m:
            back[:, : n - m + 1, m - 1] = grid[:, : n - m + 1, m - 1][:, ::-1]
    beta, after = forward(back, p)
    whole = np.log(np.maximum(alpha[:, n], 1e-300)) + scale[n // PART]
    out = np.zeros_like(p)
    for i in range(n):
        for m in range(1, min(MAX_PIECE, n - i) + 1):
            k, rest = grid[:, i, m - 1], n - i - m
            np.add.at(out, k, alpha[:, i] * p[k] * beta[:, rest] * np.exp(scale[i // PART] + after[rest // PART] - whole) * times)
    return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, of about 800,000 letters together at most, or of one word."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = min(20_000, max(1, 800_000 // n))
        for k in range(0, len(at), step):
            yield at[k : k + step]


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    languages: tuple[str, ...]
    prior: np.ndarray
    probability: np.ndarray  # [piece, language], with the rows of ``Pieces``


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def fit(labelled: DataFrame, vocabulary_path: str, docs_per_language: int = 2000, rounds: int = 4, floor: float = 1e-7) -> Model:
    """``labelled``: doc_id, text, lang. At most about ``docs_per_language`` documents of each language are fitted, chosen
    by a hash of doc_id; rows without language are left out. Labels are texts like any others: those that differ in case
    are languages of their own. What comes to the driver is bounded by the vocabulary times the languages. Without
    labelled rows the model has no language."""
    names = vocabulary(vocabulary_path)
    told = labelled.where("lang IS NOT NULL")
    shares = sorted((r.lang, r.n) for r in told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a language
    languages = tuple(lang for lang, _ in shares)
    if not languages:
        return Model(tuple(names), (), np.zeros(0), np.zeros((len(names) + 2, 0)))
    spark, width = labelled.sparkSession, len(languages)
    numbers = spark.createDataFrame([(lang, k, min(1.0, docs_per_language / n)) for k, (lang, n) in enumerate(shares)], "lang string, language int, share double")
    chosen = told.join(F.broadcast(numbers), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * F.col("share"))  # one row a language

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            split = [words_of(t) for t in frame.text]
            out = pd.DataFrame({"language": np.repeat(frame.language.to_numpy(), [len(w) for w in split]), "word": [w for ws in split for w in ws]})
            yield out.groupby(["language", "word"], as_index=False).size().rename(columns={"size": "n"})

    text = chosen.select(F.coalesce("text", F.lit("")).alias("text"), "language")
    summed = text.mapInPandas(words, "language int, word string, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))
    # a word's counts are a list of at most one entry a language
    counts = summed.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("n")).select("word", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("n", k), F.lit(0))).alias("n"))
    counts = stored(counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), "language-words")
    p = np.zeros((len(names) + 2, width))
    p[:-1] = 1 / (len(names) + 1)

    def round_of(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, q, out = Pieces(names_shared.value), shared.value, None
            for frame in frames:
                seen = frame.word.tolist()
                times = np.stack(frame.n.to_numpy()).astype(float)
                for at in by_length(seen):
                    got = expected_uses(own.grid([seen[k] for k in at.tolist()]), q, times[at])
                    out = got if out is None else out + got
            if out is not None:
                k, lang = np.nonzero(out)
                yield pd.DataFrame({"piece": k, "language": lang, "uses": out[k, lang]})

        return run

    names_shared = spark.sparkContext.broadcast(names)
    for _ in range(rounds):
        uses = counts.mapInPandas(round_of(spark.sparkContext.broadcast(p)), "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        got = uses.toPandas()  # at most vocabulary x languages rows
        new = np.zeros_like(p)
        new[got.piece, got.language] = got.uses
        new[:-1] = new[:-1] / np.maximum(new[:-1].sum(0), 1e-300)
        new[:-1] = (new[:-1] + floor) / (1 + floor * (len(names) + 1))
        new[-1] = 0
        p = new
    total = sum(n for _, n in shares)
    return Model(tuple(names), languages, np.log(np.array([n / total for _, n in shares])), p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", remember: int = 300_000) -> DataFrame:
    """(doc_id, lang_pred, score): the most probable language of each whole text and its posterior probability.

    ``und`` with score 0 where the text is null, has no letter, or the model no language; equal probabilities
    go to the first language by name. Rows are judged one by one, repeated or not; a task remembers the
    scores of up to ``remember`` words. Texts of any length are scored whole; only the two named columns are read, so that no other can
    clash; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own, width = Pieces(list(m.names)), len(m.languages)
        seen: dict[str, int] = {}
        table, used = np.zeros((1024, width)), 0
        for frame in frames:
            best, score = [], []
            for k in range(0, len(frame), 256):
                split = [words_of(t) if width else [] for t in frame.text.iloc[k : k + 256]]
                new = list(set().union(*split).difference(seen))
                if used + len(new) > remember and used:
                    seen.clear()
                    used = 0
                    new = list(set().union(*split))
                if used + len(new) > len(table):
                    table = np.concatenate([table[:used], np.zeros((used + 2 * len(new) + 1024, width))])
                for at in by_length(new):
                    part = [new[i] for i in at.tolist()]
                    table[used : used + len(part)] = log_probability(own, part, m.probability)
                    seen.update(zip(part, range(used, used + len(part))))
                    used += len(part)
                for words in split:
                    if not words:
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = m.prior + table[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))].sum(0)
                    top = int(total.argmax())
                    best.append(m.languages[top])
                    score.append(float(1 / np.exp(total - total[top]).sum()))
            yield pd.DataFrame({"doc_id": frame.doc_id, "lang_pred": best, "score": score})

    return base_rows(docs, id_col, text_col).mapInPandas(run, PREDICTED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def contract(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: fitted on rows of other folds that have a language, as ``fit`` chooses them, and
    predicted from the whole text alone; see ``predict`` for odd rows. A doc_id that is no number is an error; a
    null one is in no fold: it is neither fitted nor held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(rows.where(fold() != 0), vocabulary_path)
    return predict(rows, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
