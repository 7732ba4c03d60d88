"""Operators 11 to 13 against plain versions, on made tables of hard cases."""

import collections
import gzip
import hashlib
import random
import re
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from adjudica.llm import infill, prefix_trie, warc
from adjudica.llm.common import shared_dir, stored

# 11

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    n = len(ends) - 1
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def infill_rows():
    rng = random.Random(5)
    made = ["".join(rng.choice(["ab", "é", "𝄞x", " ", "\n", "\t", " ", "<", "<P", ">", "\x00", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    hard = [None, "", " ", " \n\t", "a", "a ", " a", "has <P> inside", "has <S>", "<M>", "<<P", "S>S>", "w" * 300_000, " " * 600_000 + "x" + " " * 300_000, "word\n" * 120_000]
    texts = made + hard
    return [(k if k % 17 else None, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (3, "another text")]


def test_fill_in_middle(spark, infill_rows):
    frame = spark.createDataFrame(infill_rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1)).repartition(4)
    out = infill.fill_in_middle(frame).collect()
    assert collections.Counter((r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in out) == collections.Counter((k, *plain_infill(k, t)) for k, t in infill_rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert all(r.prefix + r.middle + r.suffix in {t for _, t in infill_rows} for r in out if r.form != "plain")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter((k, (p := plain_infill(k, t))[0], p[1], sha(p[4]), sha(t or "")) for k, t in infill_rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256) for r in infill.contract(frame).collect()) == want


def test_fill_in_middle_parameters(spark):
    frame = spark.createDataFrame([(k, f"some words {k} in a row") for k in range(50)], "key long, body string")
    forms = lambda **kw: {r.form for r in infill.fill_in_middle(frame, id_col="key", text_col="body", **kw).collect()}
    assert forms(fim_percent=0) == {"plain"} and forms(fim_percent=100, spm_percent=100) == {"spm"} and forms(fim_percent=100, spm_percent=0) == {"psm"}
    assert infill.contract(frame.limit(0).withColumnsRenamed({"key": "doc_id", "body": "text"})).count() == 0


def test_chunks_cut_at_token_ends():
    rng, split = random.Random(2), infill.token_splitter()
    for _ in range(300):
        text = "".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 80)))
        assert infill.token_ends(split, text, rng.randint(1, 20)) == [m.end() for m in TOKEN.finditer(text)]


# 12


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, role or "", (text or "")[:32], digest), (role or "", text or "")))
    own = {c: tuple(t for _, t in sorted(v)) for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + turns[h:]
    return out


def plain_trie(sequences):
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(sequences[c]) == len(p)))).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def conversation_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 - 300 if c % 5 else c * 100
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", None, "", "é𝄞", "a long turn " * 9]) if t else "hello"))
    rows += [(10**15 + 1 + k, t, "user", "hello" if t == 0 else f"same {t}") for k in range(150) for t in range(7)]  # copies
    rows += [(2**62 + 3, t, "user", f"{t % 3}") for t in range(700)] + [(2**62 + 4, t, "user", f"{t % 3}") for t in range(701)]  # long ones, in each other
    rows += [(40, 1, "user", "tie"), (40, 1, "user", "tie"), (40, 1, "assistant", "tie"), (None, 0, "user", "nobody's"), (10**15 + 1, 3, "user", "same 3")]
    return rows


TRIE_SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", [1, 23])
def test_prefix_trie(spark, partitions, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE_BYTES", 1 << 15 if partitions > 1 else 1 << 30)
    rows = conversation_rows(220, partitions)
    frame = spark.createDataFrame(rows, TRIE_SCHEMA).withColumn("units", F.lit(1)).withColumn("depth", F.lit("x")).repartition(partitions)
    got = prefix_trie.contract(frame).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_trie(plain_rebuilt(rows))


def test_prefix_trie_of_one_copied_conversation_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE_BYTES", 1 << 12)
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(6_000_000 + k, t, "user", f"t{t}") for k in range(500) for t in range(2)]
    assert collections.Counter(tuple(r) for r in prefix_trie.contract(spark.createDataFrame(rows, TRIE_SCHEMA)).collect()) == plain_trie(plain_rebuilt(rows))
    assert prefix_trie.contract(spark.createDataFrame([], TRIE_SCHEMA)).collect() == []


def test_merge_is_a_sort_with_prefixes():
    rng, u = random.Random(9), prefix_trie.UNIT
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(0, 9)):
            run = sorted((b"".join(bytes([rng.choice([0, 1, 255])]) * u for _ in range(rng.randint(0, 6))), rng.randint(0, 5)) for _ in range(rng.randint(1, 12)))
            runs.append([(s, c, prefix_trie.common_turns(run[k - 1][0], s) if k else 0) for k, (s, c) in enumerate(run)])
        got = list(prefix_trie.merge(runs))
        assert [g[:2] for g in got] == sorted(r[:2] for run in runs for r in run)
        assert [g[2] for g in got] == [prefix_trie.common_turns(got[k - 1][0], g[0]) if k else 0 for k, g in enumerate(got)]


# 13


def plain_warc(rows):
    by = collections.defaultdict(list)
    for k, (i, _, html) in enumerate(rows):
        by[(html or "").encode()].append((i is not None, i or 0, k))
    out = []
    for k, (i, _, html) in enumerate(rows):
        b = (html or "").encode()
        top = max(by[b])
        again = len(b) >= 1000 and top[2] != k
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", (top[1] if top[0] else None) if again else None))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(4)
    nasty = ["\r\n\r\n", "\r\n\r", "\n\r\n\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n", "\r", "é", "\x00", "<p>text</p>"]
    htmls = ["".join(rng.choice(nasty) for _ in range(rng.randint(0, 400))) for _ in range(80)]
    htmls += [None, "", "x" * 999, "x" * 999, "x" * 1000, "é" * 499, "é" * 499, "é" * 500, "é" * 500, "\r\n" * 150_000, "line\r\n\r\n" * 60_000]
    htmls += [htmls[k] for k in range(0, 60, 2)] + ["y" * 2000] * 300
    rows = [(k if k != 70 else None, f"https://a.example/{k}?q=1" if k % 9 else (None, "https://b.example/\r\nX: y")[k % 2], h) for k, h in enumerate(htmls)]
    return rows + [(5, "https://again.example/", "z" * 1500), (5, "https://again.example/", "z" * 1500), (None, None, "v" * 1200), (None, None, "v" * 1200), (None, None, None)]


def test_warc_round_trip(spark, page_rows):
    frame = stored(spark.createDataFrame(page_rows, "page_id long, url string, html string").withColumn("same", F.lit(1)).withColumn("n", F.lit("x")).repartition(5), "pages-test")
    assert collections.Counter(tuple(r) for r in warc.contract(frame).collect()) == plain_warc(page_rows)
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_warc(frame, path, date="2024-01-02T03:04:05Z")
    records = warc.read_warc(spark, path)
    kinds = collections.Counter(r.type for r in records.select("type").collect())
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(page_rows)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(page_rows) and all(len(r.requests) == len(r.metadata) == 1 and not r.response.truncated for r in rows)
    held = collections.Counter(bytes(r.response.payload) for r in rows if r.type == "response")
    assert set(held) == {(h or "").encode() for _, _, h in page_rows}
    assert {r.target_uri for r in rows} == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in page_rows}
    assert all(r.date == "2024-01-02T03:04:05Z" for r in rows)
    assert warc.contract(frame.limit(0)).count() == 0


def test_warc_of_other_writers(spark):
    """Members of their own, names in the other direction, records of no capture, a binary payload, a cut end."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    def record(kind, name, block, *extra, length=None):
        head = [f"WARC-Type: {kind}", f"warc-record-id: <{name}>", *extra, f"Content-Length: {len(block) if length is None else length}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    as_http = "Content-Type: application/http"
    made = [record("warcinfo", "w:0", b"software: x\r\n"), record("response", "r:1", http + b"\xff\xfe\r\n\r\n\x00", as_http, "WARC-Concurrent-To: <q:1>"), record("request", "q:1", b"GET / HTTP/1.1\r\n\r\n", as_http),
            record("metadata", "m:1", b"a: b", "WARC-Concurrent-To: <r:1>"), record("metadata", "m:2", b"c: d", "WARC-Concurrent-To: <r:1>"), record("request", "q:9", b"", as_http), record("metadata", "m:3", b"", "WARC-Concurrent-To: <r:7>")]
    path = f"{shared_dir(spark)}/warc-other-{uuid.uuid4().hex}".removeprefix("file:")
    import os

    os.makedirs(path)
    with open(f"{path}/one.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, made)))
    with open(f"{path}/two.warc.gz", "wb") as f:
        f.write(gzip.compress(record("response", "r:2", http + b"cut", as_http, length=5000)[:-4]))
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert set(got) == {"r:1", "r:2", "q:9", "r:7"}
    assert bytes(got["r:1"].response.payload) == b"\xff\xfe\r\n\r\n\x00" and [q.record_id for q in got["r:1"].requests] == ["q:1"] and {m.record_id for m in got["r:1"].metadata} == {"m:1", "m:2"}
    assert got["r:2"].response.truncated and bytes(got["r:2"].response.payload) == b"cut"
    assert got["q:9"].response is None and got["r:7"].type is None and len(got["r:7"].metadata) == 1
