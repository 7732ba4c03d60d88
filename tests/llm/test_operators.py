"""Each operator against a plain version, and on nulls, empties, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import decontaminate, html_text, language, lines, packing, quality, secrets, similar, substrings, token_files, tokens
from adjudica.llm.common import shared_dir

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def table(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def reference_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {k: t.encode(text or "", add_special_tokens=False).ids for k, text, *_ in rows}


# 1


def test_language(spark, rows):
    en, fr = ["the", "and", "there", "other", "with", "that"], ["le", "une", "dans", "avec", "les", "sont"]
    made = [(k, " ".join((en if k % 2 else fr)[(k * j) % 6] for j in range(1, 30)), "en" if k % 2 else "fr") for k in range(200)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = table(language.contract(frame, language.default_vocabulary()))
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in got) and held
    assert np.mean([got[k].lang_pred == ("en" if k % 2 else "fr") for k in held]) == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language.fit(frame, language.default_vocabulary())
    assert model.probability[:-1].sum(0) == pytest.approx(1)
    empty = language.predict(spark.createDataFrame([(1, None), (2, "12 !"), (None, "the other"), (4, "q" * 500)], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in empty[:2]] == ["und", "und"] and empty[2].lang_pred == "en" and empty[3].lang_pred in ("en", "fr")


def test_language_forward_sums_all_segmentations():
    names = ["a", "ab", "b", "ba"]
    p = np.zeros((6, 1))
    p[:, 0] = [0.3, 0.2, 0.2, 0.1, 0.2, 0.0]
    own = language.Pieces(names)

    def total(w):
        return 1.0 if not w else sum(p[own.at[w[:m]] if w[:m] in own.at else own.other, 0] * total(w[m:]) for m in range(1, len(w) + 1) if w[:m] in own.at or m == 1)

    for w in ("aba", "bab", "xab", "aabb"):
        assert language.forward(own.grid([w]), p)[0][0, -1, 0] == pytest.approx(total(w))
    uses = language.expected_uses(own.grid(["ab"]), p, np.array([[2.0]]))
    assert uses[own.at["ab"], 0] == pytest.approx(2 * 0.2 / 0.26) and uses[own.at["a"], 0] == pytest.approx(2 * 0.06 / 0.26)


def whole_forward(own, names_p, w):
    """Logarithm of the sum over all segmentations, in exact fractions."""
    from fractions import Fraction

    alpha = [Fraction(1)]
    for j in range(1, len(w) + 1):
        parts = ((own.at.get(w[j - m : j], own.other if m == 1 else None), alpha[j - m]) for m in range(1, min(language.MAX_PIECE, j) + 1))
        alpha.append(sum(Fraction(names_p[k]) * a for k, a in parts if k is not None))
    a = alpha[-1]
    shift = a.denominator.bit_length() - a.numerator.bit_length()
    return math.log(float(a * Fraction(2) ** shift)) - shift * math.log(2)


def test_language_long_words(monkeypatch):
    """Words of any length are summed whole, across the places where passes are scaled."""
    monkeypatch.setattr(language, "REACH", 64)
    rng = np.random.RandomState(5)
    names = ["a", "ab", "abab", "b", "ba", "bbabab"]
    p = np.zeros((8, 2))
    p[:-1] = rng.rand(7, 2) * 1e-6
    own = language.Pieces(names)
    for n in (1, 5, 31, 32, 33, 64, 65, 100, 200):
        words = ["".join(rng.choice(list("abx"), n)) for _ in range(3)]
        got = language.log_probability(own, words, p)
        alpha, scale = language.forward(own.grid(words), p)
        assert np.allclose(np.log(alpha[:, n]) + scale[n // language.PART], got, rtol=1e-10)
        for k, w in enumerate(words):
            for lang in (0, 1):
                assert got[k, lang] == pytest.approx(whole_forward(own, p[:, lang], w), rel=1e-10)
        uses = language.expected_uses(own.grid(words), p, np.ones((3, 2)))
        sizes = np.array([*map(len, names), 1, 0])
        assert sizes @ uses == pytest.approx([3 * n, 3 * n])  # every letter is in one piece
    monkeypatch.undo()
    assert np.isfinite(language.log_probability(own, ["ab" * 300_000], p)).all()


def test_language_labels_and_whole_predictions(spark):
    """Labels that clash as column names; every prediction equals one made of exact forward sums and the fitted model."""
    rng = np.random.RandomState(1)
    labels = ["en", "EN", "word", "zh.cn", "n", "`x`"]
    letters = {lang: rng.permutation(list("abcdefghijklmnop"))[:8] for lang in labels}
    made = [(k, " ".join("".join(rng.choice(letters[lang], rng.randint(2, 9))) for _ in range(12)) + " q" * (k % 3), lang) for k, lang in enumerate(labels * 25)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    fitted = language.fit(frame.where(language.fold() != 0), language.default_vocabulary())
    assert fitted.languages == tuple(sorted(labels))
    got = table(language.contract(frame, language.default_vocabulary()))
    own, right = language.Pieces(list(fitted.names)), []
    for k, text, lang in made[::7]:
        total = [fitted.prior[j] + sum(whole_forward(own, fitted.probability[:, j], w) for w in re.findall(r"[^\W\d_]+", text)) for j in range(len(labels))]
        top = int(np.argmax(total))
        assert got[k].lang_pred == fitted.languages[top]
        assert got[k].score == pytest.approx(1 / sum(math.exp(x - total[top]) for x in total), rel=1e-6)
    right = [got[k].lang_pred == lang for k, _, lang in made if got[k].held_out]
    assert np.mean(right) > 0.9


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.contract(docs, language.default_vocabulary()).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 100 and r.right > 0.95, r


def test_language_without_labels(none, odd):
    assert language.contract(none, language.default_vocabulary()).count() == 0
    got = language.contract(odd.withColumn("lang", F.lit(None).cast("string")), language.default_vocabulary()).collect()
    assert len(got) == 6 and {r.lang_pred for r in got} == {"und"}


# 2

PAGE = """<html><head><title>T</title><script>var t="</p>"</script></head><body><header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this very long notice that goes on and on for many words indeed</div><aside class=sidebar><p>Related stories and a longer teaser text here</p></aside>
<article><h1>Title &amp; more</h1><p><b>First   paragraph of the article<br>goes on with enough words to be text.<p>Short.</p><div class="ad">Buy now</div><ul><li>one</li><li>two</li></ul>
<form><label>Mail</label><input></form><p>Last paragraph, with a <a href=/x>link</a> and &eacute;&nbsp;mark.</p><section id="comments"><p>A reader comment that is quite long and says a lot of things.</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_text.content(PAGE) == "Title & more\nFirst paragraph of the article goes on with enough words to be text.\nShort.\none\ntwo\nLast paragraph, with a link and é mark."
    plain = "<div id=menu><a href=1>one</a> <a href=2>two</a></div><div><p>" + "words of a text " * 20 + "</p><p>End.</p><p>" + "more words " * 20 + "</p></div><div class=footer>foot</div>"
    assert html_text.content(plain).split("\n")[1] == "End." and "foot" not in html_text.content(plain)
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = html_text.contract(pages).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, got[0].n_chars, got[0].n_chars] and got[0].n_chars == len(got[0].text)
    assert html_text.contract(pages.limit(0)).count() == 0


def article(inner):
    return f"<html><body><nav>menu</nav><article><h1>Head</h1><p>{'words of the text ' * 12}</p>{inner}<p>{'more of the text ' * 12}</p></article></body></html>"


@pytest.mark.parametrize(
    "inner,text",
    [
        ("<p>P<script>var a=1;</script>Q</p>", "PQ"), ("<style>.x{a:b}</style><p>Q</p>", "Q"), ("<p>go <button>Click me</button>on</p>", "go on"), ("<noscript>enable js</noscript>", None),
        ("<p>Hello <span class='ad'>BUY <span>NOW</span> today</span> world</p>", "Hello world"), ("<p>a <svg><text>axis</text></svg>b</p>", "a b"), ("<div class=comment>said</div>", None),
        ("<section id='discussion'><p>" + "What the findings mean. " * 9 + "</p></section>", ("What the findings mean. " * 9).strip()), ("<div class='legal'><p>" + "The law of it all. " * 9 + "</p></div>", ("The law of it all. " * 9).strip()),
        ("<ul><li><a href=/x>one link</a></li></ul>", "one link"), ("<p>E = <math><mi>m</mi></math></p>", "E = m"), ("<header>By <b>A. Writer</b></header>", "By A. Writer"),
    ],
)
def test_html_pieces(inner, text):
    want = ["Head", ("words of the text " * 12).strip(), *([text] if text is not None else []), ("more of the text " * 12).strip()]
    assert html_text.content(article(inner)).split("\n") == want


def test_html_articles_and_containers():
    long = "a line of the text " * 15
    two = f"<main><p>intro</p><article><p>{long}1</p></article><article><h2>T</h2><p>{long}2</p></article></main><article class='teaser'><p>{long}3</p></article>"
    assert html_text.content(two).split("\n") == [long + "1", "T", long + "2"]
    paragraphs = "".join(f"<p>{long}{k}</p>" for k in range(5))
    got = html_text.content(f"<div><a href=1>a</a> <a href=2>b</a></div><div><h1>T</h1><p>by x</p>{paragraphs}<p>end</p><p>.</p></div><div class=footer>f</div>").split("\n")
    assert got[:2] == ["T", "by x"] and got[-2:] == ["end", "."] and len(got) == 9


def test_html_made_pages():
    """Pages made of known parts, in any order: what was put into the article comes back, whole and in order; one page is very long."""
    rng = np.random.RandomState(3)
    said = lambda n: " ".join("".join(rng.choice(list("abcdeé&"), rng.randint(2, 8))) for _ in range(n))
    escape = lambda t: t.replace("&", "&amp;").replace("é", ["é", "&eacute;", "&#233;"][rng.randint(3)])
    for k in range(150):
        size = 3000 if k == 0 else rng.randint(1, 25)
        want, inside = [], []
        for _ in range(size):
            text = said(rng.randint(1, 60))
            want.append(text)
            tag = ["p", "h2", "li", "blockquote"][rng.randint(4)]
            noise = ["", "<script>if (a<b) x('</p>');</script>", "<span class='ads'>buy</span>", "<!-- no -->", "<label>Mail</label>", "<textarea>type</textarea>"][rng.randint(6)]
            inside.append(f"<{tag}>{noise}{escape(text).replace(' ', '  ', 1)}" + (f"</{tag}>" if tag != "li" or rng.randint(2) else ""))
            if rng.randint(5) == 0:
                inside.append(["<aside><p>aside " + said(20) + "</p></aside>", "<div class='share-box'>share</div>", "<form>name <input></form>", "<section class=comments><p>" + said(30) + "</p></section>"][rng.randint(4)])
        around = ["<nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav>", "<header><h1>Site</h1></header>", "<div id='cookie-bar'>" + said(25) + "</div>", "<footer>&copy; " + said(8) + "</footer>", "<div class='ad'>" + said(4) + "</div>"]
        rng.shuffle(around)
        at = rng.randint(len(around) + 1)
        page = "<html><head><title>x</title><style>p{}</style></head><body>" + "".join([*around[:at], "<article>", *inside, "</article>", *around[at:]]) + "</body></html>"
        assert html_text.content(page).split("\n") == [" ".join(x.split()) for x in want], k


# 3


@pytest.mark.parametrize("top", [2, 50_000, 1 << 40, (1 << 53) + 9, (1 << 60) + 5, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 1024, 3000])
def test_words_round_trip(n, top):
    rng = np.random.RandomState(n + 1)
    ids = (rng.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(4) + np.uint64(3)) % np.uint64(top)
    words, blocks, escapes = token_files.encode_words(ids)
    assert (token_files.decode_words(words, escapes) == ids).all()
    for b in range(len(blocks)):  # any block is decoded from its own words
        part = words[blocks[b] : blocks[b + 1] if b + 1 < len(blocks) else None]
        assert (token_files.decode_words(part, escapes) == ids[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]).all()


def test_token_files(spark, docs, rows, reference_ids):
    path = f"{shared_dir(spark)}/test-token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, tokens.default_path())
    got = table(token_files.read_token_files(spark, path))
    start = 0
    for k, *_ in rows:
        want = np.array([*reference_ids[k], 2], "<u4")
        assert (got[k].start, got[k].n_tokens, bytes(got[k].ids)) == (start, len(want), want.tobytes())
        start += len(want)
    whole = b"".join(bytes(got[k].ids) for k, *_ in rows)
    for a, b in ((0, start), (5, 6), (1000, 1024), (1023, 4100), (start - 3, start + 9), (start, start + 5)):
        parts = sorted((r.start, bytes(r.ids)) for r in token_files.read_token_range(spark, path, a, b).collect())
        assert b"".join(p for _, p in parts) == whole[4 * a : 4 * b] and (not parts or parts[0][0] == a)


def test_token_files_odd(spark, odd, none):
    for name, frame, n in (("odd", odd, 6), ("none", none, 0)):
        path = f"{shared_dir(spark)}/test-token-files-{name}-{uuid.uuid4().hex}"
        token_files.write_token_files(frame, path, tokens.default_path())
        got = token_files.read_token_files(spark, path).collect()
        assert len(got) == n
        if n:
            by = sorted(got, key=lambda r: r.start)
            assert [r.doc_id for r in by] == [None, None, 5, 5, 6, 7] and by[0].n_tokens == 1


# 4


def base_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, docs, rows):
    got = table(secrets.contract(docs))
    for k, text, *_ in rows:
        want = base_spans(text or "")
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(x[1] == j for x in want) for j in range(3)]
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[j]}:{a}:{b}" for a, j, b in want).encode()).hexdigest()


def test_secret_ownership(spark):
    live, shared = "Zz9yX8wV7uT6sR5qP4oN3m", "Aa1bB2cC3dD4eE5fF6gG7h"
    rows = [(1, f"é use {live} here", "s1"), (2, f"{shared}", "s1"), (3, f"see {shared}", "s2"), (4, f"again {live}", "s1"), (5, "token=abc token=" + "q" * 9, None)]
    got = table(secrets.contract(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[1].spans == "live:6:28" and got[4].spans == "live:6:28" and got[2].spans == got[3].spans == ""
    assert (got[2].n_live, got[2].n_shared, got[1].n_live) == (0, 1, 1) and got[5].spans == "assign:10:25"


def test_secret_ownership_counts_repositories(spark):
    """A value of one owner is live in up to eight repositories; one that fifty hold is a copied example."""
    value = lambda k: f"Zz9yX8wV7uT6sR5qP4oN{k:02d}"
    rows = [(k, f"use {value(1)} here", "s") for k in range(50)] + [(100 + k, f"use {value(2)} here", "s") for k in range(8)] + [(200, f"token={value(3)} {value(4)}", "s")]
    got = table(secrets.contract(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all((got[k].spans, got[k].n_live, got[k].n_shared) == ("", 0, 1) for k in range(50))
    assert all((got[100 + k].spans, got[100 + k].n_live) == ("live:4:26", 1) for k in range(8))
    assert got[200].spans == "assign:0:28,live:29:51"  # what a base span covers is no candidate


def test_secrets_many_matches(spark):
    text = " ".join(f"token=abcdef{k}" for k in range(1500))
    r = secrets.contract(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    want = base_spans(text)
    assert r.n_assign == 1500 and r.base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in want).encode()).hexdigest()


def test_secrets_odd(odd, none):
    assert secrets.contract(odd).count() == 6 and secrets.contract(none).count() == 0


# 5


def line_key(x):
    return lower(x.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows):
    held = collections.defaultdict(set)
    for k, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[line_key(x)].add(k)
    out = {}
    for k, t, *_ in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if len(line_key(x)) < 20 or len(held[line_key(x)]) < 3 or max(held[line_key(x)]) == k]
        out[k] = (len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup(docs, rows):
    got = {k: (r.n_lines, r.n_dropped, r.kept_sha256) for k, r in table(lines.contract(docs)).items()}
    assert got == plain_lines(rows) and sum(v[1] for v in got.values()) > 5


def test_line_dedup_of_one_long_text(spark):
    """A text of many lines that all go but some, and lines that go at both ends."""
    long = "\n".join(f"line number {k} of the long text" if k % 3 else f"own {k}" for k in range(3000))
    made = [(1, long), (2, long + "\nand one line more that is its own"), (3, "head\n" + long), (3, "another text of the same id\n" + long[:900])]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.contract(frame).collect())
    want = plain_lines([(1, long), (2, made[1][1]), (3, made[2][1])])
    assert got[0] == (1, *want[1]) and got[1] == (2, *want[2]) and {r[2] for r in got[2:]} == {0}


def test_line_dedup_odd(odd, none):
    got = lines.drop_repeated_lines(odd.unionByName(odd)).collect()
    assert len(got) == 12 and all(r.n_words == 3 for r in got)
    assert lines.contract(none).count() == 0


def test_line_index_is_reversible(spark, docs, rows, monkeypatch):
    first, later = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    whole, part = lines.LineIndex.of(docs, shards=3), lines.LineIndex.of(first, shards=3)
    counts = lambda index: {tuple(r) for r in index.counts.collect()}
    kept = lambda index, frame: {r.doc_id: r._kept for r in index.drop(frame).collect()}

    def filters_fit(index):
        held = {r.shard: (lines.CuckooFilter.load(bytes(r.buckets)), r["size"]) for r in index.filters.collect()}
        keys = index.repeated().collect()
        assert sum(size for _, size in held.values()) == len(keys)
        for r in keys:
            assert held[r.k2 % index.shards][0].holds(np.array([r.k1], np.int64).view(np.uint64)).all()

    grown = part.insert(later)
    assert counts(grown) == counts(whole) and kept(grown, docs) == kept(whole, docs)
    filters_fit(grown)
    again = grown.insert(later)  # a batch that comes again changes nothing
    assert counts(again) == counts(whole)
    back = again.delete(later.select("doc_id"))
    assert counts(back) == counts(part) and kept(back, first) == kept(part, first)
    filters_fit(back)
    monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    split = part.insert(later)
    assert split.shards == 6 or split.repeated().count() <= 6
    filters_fit(split)
    assert kept(split, docs) == kept(whole, docs)


def test_cuckoo_filter():
    keys = np.random.RandomState(2).randint(0, 1 << 62, 20_000).astype(np.uint64)
    made = lines.build_filter(keys)
    assert made.holds(keys).all()
    other = np.random.RandomState(3).randint(0, 1 << 62, 20_000).astype(np.uint64)
    assert made.holds(other).mean() < 0.01
    made.remove(keys[:10_000])
    assert made.holds(keys[10_000:]).all() and made.holds(keys[:10_000]).mean() < 0.01


# 6


def plain_repeats(rows, n):
    seen, out = {}, {}
    for k, t, *_ in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            else:
                seen[raw[i : i + n]] = (k, i)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True, "many"])
def test_substrings(docs, rows, monkeypatch, hot):
    if hot == "many":  # no anchor is known before, and every one turns out to have many contexts
        monkeypatch.setattr(substrings, "common_anchors", lambda frame, length: np.zeros(0, np.uint64))
        monkeypatch.setattr(substrings, "MANY", 1)
    elif hot:  # every anchor is dealt by whole windows
        monkeypatch.setattr(substrings, "common_anchors", lambda frame, length: np.sort(np.array([r.h for r in frame.mapInPandas(_anchors(length), "h long").distinct().collect()], np.int64).view(np.uint64)))
    got = {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in table(substrings.contract(docs)).items()}
    assert got == plain_repeats(rows, 100)


def _anchors(length):
    def run(frames):
        import pandas as pd

        for frame in frames:
            for data, ends, _, _ in substrings._slices(frame, length):
                yield pd.DataFrame({"h": substrings.contexts(data, ends, length)[0].view(np.int64)})

    return run


def test_substrings_in_parts(docs, rows):
    import pandas as pd

    text = "".join(np.random.RandomState(4).choice(list("ab é"), 3_000_000))
    frame = pd.DataFrame({"doc": [1, 2], "text": [text, "short"]})
    n = 0
    for data, ends, ids, froms in substrings._slices(frame, 100):
        h, ctx, first, last = substrings.contexts(data, ends, 100)
        n += int((last - first + 1).sum())
    assert n == len(text.encode()) - 99


def test_interval_expansion():
    rng = np.random.RandomState(6)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 400)
    data[200:260] = data[50:110]
    for length in (1, 5, 20):
        order, label = substrings.expand_intervals(data, length)
        by = collections.defaultdict(set)
        for place, k in zip(order.tolist(), label.tolist()):
            if place + length <= len(data):
                by[k].add(bytes(data[place : place + length]))
        assert all(len(v) == 1 for v in by.values())
        assert len(by) == len({bytes(data[i : i + length]) for i in range(len(data) - length + 1)})


@pytest.mark.parametrize("many", [4096, 1])
def test_substrings_of_repeated_ids(spark, monkeypatch, many):
    """Rows of one doc_id are documents of their own, in order of their texts' hashes; equal rows are one document."""
    monkeypatch.setattr(substrings, "MANY", many)
    rng = np.random.RandomState(8)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 150)) for _ in range(3))
    made = [(1, a), (2, a), (2, b), (2, b), (3, b + c), (3, c + a), (None, "x" + a[:120]), (4, "short")]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    tie = {r.text: r.tie for r in frame.select("text", F.hash("text").alias("tie")).collect()}
    ranked = sorted(set(made), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = plain_repeats([(k, t) for k, (_, t) in enumerate(ranked)], 100)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.contract(frame).collect())
    assert got == sorted((d or 0, *want[ranked.index((d, t))]) for d, t in made)


def test_substrings_odd(odd, none):
    got = substrings.contract(odd).collect()
    assert len(got) == 6 and sum(r.n_removed for r in got) == 0
    assert substrings.contract(none).count() == 0


# 7


def test_quality_counts(docs, rows):
    got = table(quality.contract(docs))
    for k, t, *_ in rows:
        t = t or ""
        w = SPACES.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        split = [x for x in t.split("\n") if SPACES.search(x)]
        r, failed = got[k], len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(split) - len(set(split)), len(cover), failed)
        assert not (failed and r.kept)


def test_cascade_order_changes_work_only(docs):
    order = quality.cascade_order(docs)
    assert {r.name for r in order} == {r.name for r in quality.RULES}
    one = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert one == {r.doc_id for r in quality.contract(docs).collect() if r.kept}
    backwards = quality.judge(docs, quality.RULES[::-1])
    assert one == {r.doc_id for r in backwards.where("rejected_by IS NULL").collect()}


def test_order_by_gain():
    """Rejections are counted among the rows that are left, and a count that was made before costs nothing again."""
    rules = tuple(quality.Rule(n, c, lambda: F.lit(True)) for n, c in (("a", ("x",)), ("b", ("x", "y")), ("c", ("z",))))
    seconds = {"x": 1.0, "y": 1.0, "z": 3.0}
    order = lambda rejected: [r.name for r in quality.order_by_gain(rules, rejected, seconds)]
    assert order({}) == ["a", "b", "c"]
    assert order({(True, True, False): 10, (False, True, False): 1, (False, False, True): 4}) == ["a", "c", "b"]
    assert order({(True, False, True): 10, (False, False, True): 30}) == ["c", "a", "b"]
    assert order({(True, True, False): 4, (False, True, False): 5}) == ["b", "a", "c"]


def test_quality_of_long_texts(spark):
    rng = np.random.RandomState(9)
    made = [(k, " ".join("".join(rng.choice(list("abcé"), rng.randint(1, 4))) for _ in range(n)), "x") for k, n in enumerate((1500, 20_000))]
    made[1] = (1, made[1][1] + " " + made[1][1][:9000], "x")
    test_quality_counts(spark.createDataFrame(made, "doc_id long, text string, source string"), made)


def test_quality_odd(odd, none):
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge(odd).count() == 6 and quality.contract(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_is_native(docs):
    plan = quality.contract(docs)._jdf.queryExecution().toString() + secrets.contract(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 8


def test_packing(docs, rows, reference_ids):
    pieces = packing.digest(packing.pack_documents(docs, tokens.default_path(), block_docs=16)).collect()
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    for k, *_ in rows:
        ids, at = np.array([*reference_ids[k], 0], "<u4"), 0
        for p in sorted(of_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in of_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded


def test_packing_balances_cost():
    lengths = [700, 650, 600, 300, 300, 250, 200, 72]
    cost = collections.Counter()
    for _, _, n, s, _ in packing.assign(lengths, 1024, 1 / 1024):
        cost[s] += n + n * n / 1024
    assert len(cost) == 3 and max(cost.values()) < 1.25 * min(cost.values())


def test_packing_odd(odd, none):
    assert packing.pack_documents(odd, tokens.default_path()).select("doc_id").distinct().count() == 4
    assert packing.pack_documents(none, tokens.default_path()).count() == 0


def test_encoder_on_any_text():
    import random

    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), limit=50)
    rng = random.Random(1)
    for _ in range(500):
        x = "".join(rng.choice([*"ab é²½Ⅷ\x1c　 ́漢字😀'’s'll 12٣\n\t  <|endoftext|>_-", "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))
        assert np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() == own.ids_bytes(x)


def test_html_without_article_keeps_short_ends_and_links():
    six = [f"{k} " + "words of the text " * 22 for k in range(6)]
    body = lambda blocks: "<html><body><nav><a href=/>Menu</a></nav><div class=page>" + "".join(blocks) + "</div><footer>Foot</footer></body></html>"
    p = lambda xs: [f"<p>{x}</p>" for x in xs]
    for first, last in (([], ["one", "two", "three"]), (["by me", "today"], []), (["by me"], ["end"])):
        got = html_text.content(body(["<h1>Title</h1>", *p(first), *p(six), *p(last)])).split("\n")
        assert got == ["Title", *first, *[x.strip() for x in six], *last]
    got = html_text.content(body(["<h1>Title</h1>", *p(six[:3]), "<ul><li><a href=/x>a link alone</a></li></ul>", *p(six[3:])])).split("\n")
    assert "a link alone" in got and len(got) == 8


def test_added_tokens_inside_a_text(spark):
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(tokens.default_path()), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x{end}  {end}\n\ny é", f"{end} 's漢字 {end}12", "<|endoftext|", f"<|endoftext{end}|>", "plain"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]
    assert want[0].tolist() == [64, 220, 50256, 275]
    own = tokens.Encoder(tokens.default_path())
    assert [own.ids_bytes(x) for x in texts] == [x.tobytes() for x in want]
    frame, path = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write_token_files(frame, path, tokens.default_path())
    got, start = table(token_files.read_token_files(spark, path)), 0
    for k, ids in enumerate(want):
        assert got[k].start == start and bytes(got[k].ids) == ids.tobytes() + np.array([2], "<u4").tobytes()
        start += len(ids) + 1
    packed = table(packing.pack_documents(frame, tokens.default_path(), capacity=1 << 20))
    assert all(packed[k].doc_tokens == len(ids) + 1 for k, ids in enumerate(want))


# 9


def plain_groups(rows, t=0.8):
    sets = {}
    for k, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        n = min(5, len(w))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    named = {}
    for k in sorted(sets):
        if sets[k]:
            named.setdefault(sets[k], k)
    group, links = {k: k for k in named.values()}, collections.Counter()
    items = list(named.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if len(a & b) >= t * len(a | b) - 1e-9:
                links[x] += 1
                links[y] += 1
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if v == old else v for k, v in group.items()}
    return {k: (named.get(s, k), group.get(named.get(s, k), k), links[named.get(s, k)]) for k, s in sets.items()}


@pytest.mark.parametrize("block,grams", [(256, 1 << 19), (2, 1 << 19), (256, 400)])
def test_near_duplicates(docs, rows, monkeypatch, block, grams):
    monkeypatch.setattr(similar, "BLOCK_CLASSES", block)
    monkeypatch.setattr(similar, "BLOCK_GRAMS", grams)
    got = {k: (r.class_id, r.group_id, r.n_links) for k, r in table(similar.near_duplicates(docs)).items()}
    assert got == plain_groups(rows)


def plain_links(texts, t=0.8):
    """Pairs of row numbers of different sets, by an index of all n-grams."""
    sets, held = {}, collections.defaultdict(list)
    for k, text in enumerate(texts):
        w = WORD.findall(lower(text or ""))
        n = min(5, len(w))
        if w:
            sets.setdefault(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)), k)
    out = set()
    for grams, k in sets.items():
        met = collections.Counter(j for g in grams for j in held[g])
        sizes = {j: s for j, s in ((j, len(other)) for other, j in sets.items() if j in met)}
        out |= {(j, k) for j, n in met.items() if n >= t * (len(grams) + sizes[j] - n) - 1e-9}
        for g in grams:
            held[g].append(k)
    return out


def test_recall_on_the_documents(spark):
    """Links of the operator against all pairs of the documents of a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    links = plain_links([t for _, t in made])
    want = collections.Counter(made[k][0] for pair in links for k in pair)
    got = {r.class_id: r.n_links for r in similar.near_duplicates(docs).select("class_id", "n_links").distinct().collect() if r.n_links}
    assert sum(want.values()) >= 10 and sum(got.values()) / sum(want.values()) >= 0.999
    assert all(got[k] <= want[k] for k in got)


@pytest.mark.parametrize("block", [256, 8])
def test_large_group_is_compared_by_stars(spark, monkeypatch, block):
    """Copies with different words changed: which pairs are alike depends on both; some groups hang together by chance only."""
    monkeypatch.setattr(similar, "BLOCK_CLASSES", block)
    rng = np.random.RandomState(12)
    base = [f"w{k}" for k in range(120)]
    made = []
    for k in range(120):
        words = list(base)
        at = rng.randint(0, 110)
        words[at : at + rng.randint(0, 14)] = [f"n{k}"]
        made.append((k, " ".join(words)))
    want = collections.Counter(k for pair in plain_links([t for _, t in made]) for k in pair)
    got = {r.class_id: r.n_links for r in similar.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {k: n for k, n in got.items() if n} == dict(want) and len(set(want.values())) > 5


def test_dense_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:199], f"end{k}"]), None, None, None) for k in range(40)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = table(similar.near_duplicates(frame))
    assert all((r.group_id, r.n_links) == (0, 39) for r in got.values())
    assert [r.doc_id for r in similar.keep_one(frame).collect()] == [0]


def test_texts_that_share_a_doc_id(spark):
    """Different texts under one doc_id, and without any: no link is lost, and no text that is like no other goes."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, c), (7, b + " more"), (8, a), (8, c + " more"), (None, a + " more"), (None, "alone " * 9), (None, "alone " * 9), (5, b), (9, " ".join(a.split(" ")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id, r.class_size, r.group_id, r.n_links) for r in similar.near_duplicates(frame).collect())
    want = [(5, 5, 3, 5, 1), (5, 5, 2, 5, 1), (6, 6, 1, 6, 1), (7, 7, 1, 5, 1), (8, 5, 3, 5, 1), (8, 8, 1, 6, 1), (None, None, 1, 5, 1), (None, None, 2, None, 0), (None, None, 2, None, 0), (5, 5, 2, 5, 1), (9, 5, 3, 5, 1)]
    assert got == collections.Counter(want)
    kept = collections.Counter(tuple(r) for r in similar.keep_one(frame).collect())
    assert kept == collections.Counter([(5, a), (5, b), (6, c), (None, "alone " * 9)])
    apart = spark.createDataFrame([(5, "alpha beta gamma delta"), (5, "one two three four"), (6, "unlike any other text here")], "doc_id long, text string")
    assert similar.keep_one(apart).count() == 3


def test_banding():
    b, r = similar.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= similar.MAX_HASHES


def test_near_duplicates_odd(odd, none):
    got = similar.near_duplicates(odd).collect()
    assert len(got) == 6 and all(r.n_links == 0 for r in got)
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 5, 6, 7]
    assert similar.near_duplicates(none).count() == 0 and similar.keep_one(none).count() == 0


# 10


def plain_hits(rows, items, window=10):
    windows, short = collections.defaultdict(set), {}
    for name, text in items:
        w = WORD.findall(lower(text or ""))
        if 0 < len(w) < window:
            short.setdefault(tuple(w), set()).add(str(name))
        for i in range(len(w) - window + 1):
            windows[tuple(w[i : i + window])].add(str(name))
    out = {}
    for k, text, *_ in rows:
        w, hit, found = WORD.findall(lower(text or "")), set(), set()
        for i in range(len(w)):
            if tuple(w[i : i + window]) in windows and i + window <= len(w):
                hit.update(range(i, i + window))
                found |= windows[tuple(w[i : i + window])]
            for s, names in short.items():
                if tuple(w[i : i + len(s)]) == s:
                    hit.update(range(i, i + len(s)))
                    found |= names
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_automaton_on_long_repetitive_texts(spark, monkeypatch):
    """Few words, so that states have many transitions and links are long; one text of 60,000 words; many blocks."""
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    rng = np.random.RandomState(21)
    said = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    items = [(k, said(n)) for k, n in enumerate([40, 12, 9, 3, 25, 8, 10])]
    rows = [(k, said(n)) for k, n in enumerate([60_000, 300, 12, 9, 2])]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (200_000, 20):
        got = {}
        for r in decontaminate.find_contamination(frame, bench, block_words=words).collect():
            got[r.doc_id] = (r._words, sum(s.b - s.a for s in r._spans), len(r._items), hashlib.sha256(",".join(r._items).encode()).hexdigest(), bool(r._spans))
        assert got == plain_hits(rows, items)


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_decontamination(spark, docs, rows, block_words):
    items = [(1, " ".join((rows[0][1] or "").split()[5:30])), (2, rows[6][1].split("\n")[-1].upper()), (3, " ".join(rows[9][1].split()[:3])), (4, None), (5, "..."), (6, " ".join((rows[0][1] or "").split()[10:22])), (7, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.find_contamination(docs, bench, block_words=block_words)
    got = {}
    for r in hits.collect():
        names = ",".join(r._items)
        got[r.doc_id] = (r._words, sum(s.b - s.a for s in r._spans), len(r._items), hashlib.sha256(names.encode()).hexdigest(), bool(r._spans))
    assert got == plain_hits(rows, items) and sum(v[4] for v in got.values()) > 3


def test_removal_of_spans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    frame = spark.createDataFrame([(1, f"Clean é start. {item.title()}! and a clean end of the text that goes on for more words than were hit"), (2, item), (3, None), (4, "clean")], "doc_id long, text string")
    got = table(decontaminate.remove_contamination(frame, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert got[1].text == "Clean é start. ! and a clean end of the text that goes on for more words than were hit"
    assert set(got) == {1, 3, 4} and got[3].text is None and got[4].text == "clean"


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd, bench).count() == 6 and decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.remove_contamination(odd, bench).columns == odd.columns
