"""Main text: wrappers with boilerplate words, what smoothing decides, and a slow version over trees of made pages."""

import math
import random
import xml.etree.ElementTree as ET

import pytest

from adjudica.llm import html_text

TEXT = "words of the article that are long enough to be text " * 4
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize(
    "around,blocks",
    [
        ('<div class="container with-sidebar"><article>%s</article></div>', 1), ('<div id="page" class="nav-open"><article>%s</article></div>', 1), ('<div class="cookie-consent-shown"><article>%s</article></div>', 1),
        ('<article class="post comments-open">%s</article>', 1), ('<form id="aspnetForm"><article>%s</article></form>', 1), ('<div class="modal"><main>%s</main></div>', 1), ('<div class="popup">%s</div>', 1),
        (f'<article>{P}<section class="search-methods">%s</section></article>', 2), (f'<article>{P}<div class="related-work">%s</div></article>', 2), (f'<article>{P}<section class="comment-on-policy">%s</section></article>', 2),
        (f'<div class="share-buttons">%s</div><article>{P}</article>', 1), (f'<article>{P}<div class="comment-list">%s</div></article>', 1), (f'<div class="ad"><article>%s</article></div><article>{P}{P}</article>', 2), (f"<form>%s</form><article>{P}</article>", 1),
    ],
)
def test_wrappers_with_boilerplate_words(around, blocks):
    page = "<html><body><nav><a href=/>menu</a></nav>" + around.replace("%s", P) + "<footer>foot</footer></body></html>"
    assert html_text.content(page) == "\n".join([TEXT.strip()] * blocks)


def test_no_article_text_stays_empty():
    assert html_text.content("<html><body><nav>menu</nav><article></article><div class=ad>buy</div></body></html>") == ""
    assert html_text.content("<html><body><nav>menu</nav><footer>foot</footer></body></html>") == ""


BLOCKS, HARD = ["p", "div", "section", "li", "h1", "article", "main", "td"], ["nav", "footer", "aside", "form", "script"]
CLASSES = ["", "", "", "ad", "share-buttons", "related-work", "nav-open", "legal", "x7"]


def made_page(rng):
    def block(depth, above=()):
        tag = rng.choice(BLOCKS + HARD) if rng.random() < 0.4 else rng.choice(BLOCKS)
        if (tag in ("article", "main") and "nav" in above) or tag in above[-1:]:  # there a lenient parser ends what is open
            tag = "div"
        cls = rng.choice(CLASSES) if rng.random() < 0.4 else ""
        inner = "".join(rng.choice([lambda: block(depth + 1, (*above, tag)), words, lambda: f"<a>{words()}</a>", lambda: f"<b>{words()}</b>"])() for _ in range(rng.randint(1, 4))) if depth < 4 else words()
        if tag == "script":
            inner = "var"
        return f'<{tag} class="{cls}">{inner}</{tag}>' if cls else f"<{tag}>{inner}</{tag}>"

    def words():
        return " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 2, 30, 60]))) + rng.choice(["", " "])

    return "<html><body>" + "".join(block(0) for _ in range(rng.randint(1, 8))) + "</body></html>"


def slow_content(page, sigma=1.0, share=0.5):
    """The documented rules over a tree, each question answered by walking it again."""
    up, marks = {}, {}
    root = ET.fromstring(page)
    for node in root.iter():
        up.update(dict.fromkeys(node, node))

    def holders(node):
        while node is not None:
            yield node
            node = up.get(node)

    whole = {"ad": 2, "share-buttons": 2, "related-work": 1, "nav-open": 1, "legal": 1}
    for node in root.iter():
        cls = whole.get(node.get("class", ""), 0)
        kind = 4 if node.tag == "script" else 2 if node.tag == "form" else 3 if node.tag in HARD else (2 if node.get("class") == "ad" else 0) if node.tag == "article" else 0 if node.tag == "main" else cls
        if kind:
            marks[node] = kind
    is_article = lambda n: n.tag in ("article", "main") and n not in marks
    no_text = lambda n: any(marks.get(x) == 4 for x in holders(n))
    size = lambda n: sum(len(t) for x in n.iter() if not no_text(x) for t in [x.text or ""]) + sum(len(x.tail or "") for x in n.iter() if x is not n and not no_text(up[x]))
    outer = [n for n in root.iter() if is_article(n) and not any(is_article(x) for x in list(holders(n))[1:])]
    total = sum(map(size, outer))
    void = {m for m in marks if total and 2 * sum(size(a) for a in outer if m in list(holders(a))[1:]) >= total}

    def lines_of(classes_void):
        live = lambda m: m in marks and m not in void and not (classes_void and marks[m] < 3)
        out, parts, tags = [], [], 0

        def flush(path):
            nonlocal parts, tags
            if any(kind == "never" or not t.isspace() for t, kind, _, _ in parts if t):
                kept = [x for x in parts if x[1] != "never" and not any(live(m) and marks[m] > 1 for m in x[2])]
                text = " ".join("".join(t for t, *_ in kept).split())
                doubts = [d for t, _, hs, _ in kept if t.strip() for d in [[m for m in hs if live(m) and marks[m] == 1]] if d]
                out.append((text, max(1, tags), min(sum(len(t.strip()) for t, _, _, link in kept if link), len(text)), path, doubts[0][-1] if doubts else None))
                tags = 0
            parts = []

        def say(text, node):
            if text and (not no_text(node) or text.strip()):
                parts.append((text, "never" if no_text(node) else "", list(holders(node)), any(x.tag == "a" for x in holders(node))))

        def walk(node):
            nonlocal tags
            tags += 1
            if node.tag == "td":
                parts.append((" ", "", [], False))
            block = node.tag in html_text.BLOCKS
            if block:
                flush([x for x in holders(up.get(node))])
            say(node.text, node)
            for child in node:
                walk(child)
                say(child.tail, node)
            tags += 1
            if block:
                flush(list(holders(node)))

        walk(root)
        return out

    lines = lines_of(False)
    if not any(is_article(n) for n in root.iter()) and not any(x[0] for x in lines):
        lines = lines_of(True)
    if not any(x[0] for x in lines):
        return ""
    ratios = [(len(t) - k) / n / (2 if d is not None else 1) for t, n, k, _, d in lines]
    reach = max(1, math.ceil(2 * sigma))
    level = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        level.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(level) / len(level)
    cut = min(share * math.sqrt(sum((x - mean) ** 2 for x in level) / len(level)), mean)
    hits = [v >= cut - 1e-9 and r > 0 for v, r in zip(level, ratios)]
    hits = hits if any(hits) else [bool(x[0]) for x in lines]
    length = lambda keep: sum(len(x[0]) for x, h in zip(lines, hits) if keep(x, h))
    drop = {d for *_, d in lines if d is not None and 2 * length(lambda x, h: h and x[4] is d) <= length(lambda x, h: x[4] is d)}
    all_ = length(lambda x, h: h)
    nodes = [n for n in root.iter() if n.tag in ("article", "main", "section", "div", "td", "body")]
    most = [n for n in nodes if any(h and n in x[3] for x, h in zip(lines, hits)) and length(lambda x, h: h and n in x[3]) >= 0.6 * all_]
    articles = [n for n in nodes if n.tag == "article" and any(h and n in x[3] for x, h in zip(lines, hits))]
    if any(n.tag == "article" for n in most):
        region = [next(n for n in most if n.tag == "article")]
    elif articles and length(lambda x, h: any(a in x[3] for a in articles)) >= 0.6 * all_:
        region = articles
    elif any(n.tag == "main" for n in most):
        region = [next(n for n in most if n.tag == "main")]
    else:
        region = most[-1:]
    return "\n".join(x[0] for x in lines if x[0] and x[4] not in drop and (not region or any(n in x[3] for n in region)))


def test_made_pages_against_trees():
    rng, changed, unsmoothed = random.Random(8), 0, 0
    for _ in range(1500):
        page = made_page(rng)
        got = html_text.content(page)
        assert got == slow_content(page), page
        changed += got != ""
        unsmoothed += got != html_text.content(page, sigma=1e-3)
    assert changed > 1000 and unsmoothed > 30  # smoothing decides on many pages


def test_clusters_decide_on_doubt():
    doubt = '<section class="related-work"><p>see</p><p>one</p><p>two</p></section>'
    many = "".join(f"<p>{TEXT}</p>" for _ in range(4))
    page = f"<html><body><article>{many}{doubt}</article></body></html>"
    assert "see" not in html_text.content(page) and "see" in html_text.content(page.replace("<p>see</p>", f"<p>see {TEXT}</p>"))
    short = f'<html><body><article>{many}<p><b>a</b></p><div class="legal"><span>b</span></div>{many}</article></body></html>'
    assert "\nb\n" in html_text.content(short) and "\nb\n" not in html_text.content(short, sigma=1e-3)  # its neighbours hold it
