"""HTML extraction, alignment of tokenizers, spelling variants, nearest neighbours, mixing and archives on awkward tables and against brute force."""

import hashlib
import html
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyway.llm import align, ann, bpe, html_text, mixing, spelling, warc
from tallyway.llm.tables import load

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
STORY = "The council met on a rainy evening and talked for hours about the old bridge, which nobody had crossed since the flood."


# ------------------------------------------------------- HTML


def article_by_hand(page):
    """The blocks of the given pages' one article, cut out by patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = load(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: article_by_hand(r["html"]) for r in pages.collect()}
    got = html_text.extracted(pages).collect()
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def blocks(n=3):
    return "".join(f"<p>{STORY} Part {i}.</p>" for i in range(n))


KEPT = "\n\n".join(f"{STORY} Part {i}." for i in range(3))
PAGES = {
    "by class": (f"<body class='has-sidebar'><div id=wrap><div class='top-menu'><a href=1>Home</a> <a href=2>About</a></div><div class=content><h1>Bridge</h1>{blocks()}<p>End.</p></div>"
                 f"<div id='comments'><p>{STORY} I was there and liked it very much.</p></div><div class='site-footer'>Imprint</div></div>", f"Bridge\n\n{KEPT}\n\nEnd."),
    "by tag": (f"<header><h1>Site</h1></header><main><article><header><h1>Bridge</h1></header>{blocks()}<ul><li>One point</li><li>Two</li></ul><aside>{STORY}</aside><p>End.</p><footer>By A</footer></article></main>"
               f"<nav><p>{STORY}</p></nav><form><label>{STORY}</label></form>", f"Bridge\n\n{KEPT}\n\nOne point\n\nTwo\n\nEnd."),
    "links in it": (f"<article>{blocks()}<ul><li><a href=1>Other story</a></li><li><a href=2>Another one</a></li></ul><p>See <a href=3>this</a>.</p></article>", f"{KEPT}\n\nSee this."),
    "comments as articles": (f"<article>{blocks()}</article><section class=comments><article><p>{STORY * 4}</p></article></section>", KEPT),
    "notice": (f"<div class='cookie-notice'><p>{STORY}</p></div><form id=all><article>{blocks()}</article></form><div style='display: none'>{STORY}</div>", KEPT),
    "no article, flat": (f"<p><a href=1>Home</a></p><p><a href=2>News</a></p><p><a href=4>Sport</a></p><h2>Bridge</h2>{blocks()}", f"Bridge\n\n{KEPT}"),
    "references": ("<p>a &lt; b &amp;&nbsp;c &eacute; &#233; &quo; &am\n\t d</p>", "a < b & c é é &quo; &am d"),
    "unclosed": ("<article><p>One<p>Two <b>bold <i>it</b> tail<div>three</div>four<li>five<li>six", "One\n\nTwo bold it tail\n\nthree\n\nfour\n\nfive\n\nsix"),
    "raw text": ("<p>a</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><textarea>no</textarea><p>b</p>", "a\n\nb"),
    "no markup": ("just words", "just words"),
    "odd markup": ("<![if x]><p>hi</p><![CDATA[ y ]]><?php z ?></nothing><p", "hi"),
    "nothing": ("<html><body><nav><a href=1>x</a></nav></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_no_markup_raises():
    rng = random.Random(5)
    bits = ["<", ">", "</", "<!", "<![", "<!--", "--!>", "<p>", "</p>", '<div class="ad">', "<article>", '<a href="', '"', "&", "&#", "&#x", "amp;", "x", "<script>", "</script", "<?", "\x00", "<br/>", "<td>", "]]>", "<title>", "<svg><style>"]
    for _ in range(3000):
        html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_pages_table(spark):
    long = "".join(f"<p>{STORY} {i}</p>" for i in range(20_000))
    rows = [(1, "u", None, 1), (None, None, "<p>x</p>", 2), (2, "u", "", 3), (3, "v", long, 4), (3, "v", long, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extracted(pages).collect()), key=str)
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "u", 0), (2, "u", 0), (3, "v", len(got[2][2])), (3, "v", len(got[2][2])), (None, None, 1)]
    assert got[2][2].count("\n\n") == 19_999
    assert html_text.extracted(pages.filter("page_id > 9")).count() == 0


# ------------------------------------------------------- alignment


def aligned_by_hand(texts):
    """Walks both token lists side by side."""
    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    both = align.Pair(A, B)
    entries = [x.to_pylist() for x in both.bytes]
    firsts, documents = [], Counter()
    for t in texts:
        spaced = f" {t}".encode()
        ids = (a_tok.encode(f" {t}", add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        spelt = [[e[i] for i in x] for e, x in zip(entries, ids, strict=True)]
        links, groups, i, j, ends = Counter(), [], 0, 0, [0, 0]
        if t and all(b"".join(s) == spaced for s in spelt):
            ends, group = [len(spelt[0][0]), len(spelt[1][0])], [[ids[0][0]], [ids[1][0]]]
            while True:
                links[ids[0][i], ids[1][j]] += 1
                one, two = ends[0] <= ends[1], ends[1] <= ends[0]
                if one and two:
                    groups.append("|".join(",".join(map(str, g)) for g in group))
                    group = [[], []]
                i, j = i + one, j + two
                if i == len(ids[0]):
                    break
                for on, k, at in ((one, 0, i), (two, 1, j)):
                    if on:
                        ends[k] += len(spelt[k][at])
                        group[k].append(ids[k][at])
        else:
            ids = ([], [])
        documents.update(links.keys())
        firsts.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (one, _), n in documents.items():
        best[one] = max(best[one], n)
    return [(a, b, g, sum(k.values()), sum(v for p, v in k.items() if documents[p] == best[p[0]]), sum(v * documents[p] for p, v in k.items()), s) for a, b, g, k, s in firsts]


ODD = ["", None, "a", "▁x", "x▁y z", "\x1c y", "  lead", "tail  ", "a\nb \n c\t\td", "<|endoftext|> </s> <s>", "é é ﬁ 日本語 😀", "don't I'll we've", "x" * 3000, " ", "\n", "a;\r\n\r\n b;\r", "q\r", "a b c", "the the the", "the the the"]
ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast_bytes,hot", [(32 << 20, 100_000), (0, 500), (0, 1)])
def test_alignment(spark, monkeypatch, broadcast_bytes, hot):
    """Whether the pair table is broadcast, or its hot rows alone, or none."""
    monkeypatch.setattr(align, "HOT", hot)
    docs = load(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "the the the")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, pair string").repartition(5)
    want = [(r[0], *x) for r, x in zip(rows, aligned_by_hand([r[1] for r in rows]), strict=True)]
    got = [(r["doc_id"], *(r[c] for c in ALIGNED)) for r in align.alignment(table, A, B, broadcast_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert align.alignment(table.filter("doc_id < 0"), A, B).count() == 0


def test_alignment_forgets_and_flushes(monkeypatch):
    """Small memories change nothing, and a task's partial counts add up wherever they are cut."""
    texts = [t or "" for t in ODD] * 3
    whole = align.aligned(texts, align.Pair(A, B))
    monkeypatch.setattr(align, "KNOWN", 5)
    small = align.Pair(A, B)
    for k, t in enumerate(texts):
        about, links = align.aligned([t], small)
        assert about.to_pylist() == whole[0].slice(k, 1).to_pylist()
    counts = [x.group_by("pair").aggregate([([], "count_all")]).rename_columns(["pair", "docs"]) for x in (whole[1].select(["pair"]), links.select(["pair"]))]
    merged = dict(zip(*[align.partial(counts)[c].to_pylist() for c in ("pair", "docs")], strict=True))
    assert sum(merged.values()) == len(whole[1]) + len(links)


# ------------------------------------------------------- spelling


def near_by_hand(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def spellings_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            counts[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    around = {w: [v for v in n if near_by_hand(w, v)] for w in n}
    form = {}
    for w, near in around.items():
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made_up(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "abababab", "Ärgerlich", "x" * 40]
    rows = []
    for doc in range(60):
        found = []
        for _ in range(60):
            w = rng.choice(stems)
            at, what = rng.randrange(len(w)), rng.random()
            w = w if what < 0.4 else w[:at] + w[at + 1 :] if what < 0.6 else w[:at] + rng.choice("abcZ") + w[at + (what < 0.8) :]
            found += [w, rng.choice([" ", ", ", "-", "1", "\n", "×" if rng.random() < 0.1 else " "])]
        rows.append((doc, "".join(found)))
    return rows + [(None, "Ärgerlich ärgerlich"), (1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1])] + [(100 + k, "abababab " * 12) for k in range(8)]


@pytest.mark.parametrize("split", [64, 0])
def test_spellings(spark, monkeypatch, split):
    """With no group split, and with every group split down to single letters."""
    rows = made_up(4)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    near = spelling.near
    monkeypatch.setattr(spelling, "near", lambda words: near(words, split))
    got = sorted(map(tuple, spelling.spellings(docs).collect()))
    want = spellings_by_hand(rows)
    assert got == want and any(r[1] for r in want) and max(r[4] for r in want) > 5
    assert spelling.spellings(docs.filter("doc_id < 0")).count() == 0


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).select("word", "root").collect()} == {(f"w{k}", "w9") for k in range(9)}


# ------------------------------------------------------- nearest neighbours


def nearest_by_hand(x, ids, q, k=20):
    score = np.einsum("ij,j->i", x, x[q])
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]]
    return [int(ids[j]) for j in order[:k]]


def recall_of(spark, x, asked):
    frame = ann.vectors_of(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
    got = defaultdict(set)
    for r in ann.search(frame, frame.filter(F.col("vec_id").isin(asked))).collect():
        got[r["query_id"]].add(r["vec_id"])
    ids = np.arange(len(x))
    assert all(len(got[q]) == min(20, len(x) - 1) for q in asked)
    return sum(len(got[q] & set(nearest_by_hand(x, ids, q))) for q in asked) / sum(min(20, len(x) - 1) for _ in asked)


@pytest.mark.parametrize("kind", ["clusters", "even", "norms", "one length far above"])
def test_recall(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64))
    if kind == "clusters":
        x += 3 * rng.standard_normal((6, 64))[np.arange(600) % 6]
    elif kind == "norms":
        x *= np.exp(rng.standard_normal(600))[:, None]
    elif kind == "one length far above":
        x[5] *= 1e4
    assert recall_of(spark, x, list(range(0, 600, 20))) >= 0.9


def test_recall_on_given_vectors(spark):
    rows = ann.vectors_of(load(spark, "/root/testdata/sf0.01", "embeddings")).orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["vector"] for r in rows])
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = defaultdict(list)
    for r in ann.search(table, table.filter("vec_id % 20 = 0")).collect():
        got[r["query_id"]].append(r["vec_id"])
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    assert sum(len(set(got[ids[k]]) & set(nearest_by_hand(x, ids, k))) for k in asked) >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("n", [1, 2, 6, 12, 20, 21])
def test_few_vectors_are_all_found(spark, n):
    assert n == 1 or recall_of(spark, np.random.default_rng(n).standard_normal((n, 64)), list(range(n))) == 1.0
    one = ann.vectors_of(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert n > 1 or ann.search(one, one).count() == 0


def test_exhaustive_and_lengths(spark):
    """With a recall of 1 the result is exact; vectors of another length are searched among themselves; repeated ids count once."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(0, x[0].tolist())] + [(1000 + i, v) for i, v in enumerate(rng.standard_normal((4, 5)).tolist())]
    frame = ann.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in ann.search(frame, frame.filter("vec_id IN (0, 7, 1002)"), recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: got[q] for q in (0, 7)} == {q: nearest_by_hand(x, np.arange(90), q) for q in (0, 7)}
    assert set(got[1002]) == {1000, 1001, 1003}


# ------------------------------------------------------- mixing


def mixed_by_hand(rows, target):
    """doc_id, source, tokens, copies, place, weight and epochs of (doc_id, text, source), by lists and one bisection after the other."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    each = [(i, s or "", number("" if i is None else str(i)) % mixing.BLOCKS, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, _, n in each:
        total[s] += n
    some = {s: n for s, n in total.items() if n}
    whole = sum(some.values())
    logs = {s: math.log(n / whole) for s, n in some.items()}

    def even(a):
        z = sum(math.exp(a * x) for x in logs.values())
        return math.log(z) - sum(math.exp(a * x) * a * x for x in logs.values()) / z >= target.entropy * math.log(len(some))

    def often(a):
        z = sum(math.exp(a * x) for x in logs.values())
        least, most = min(some.values()), max(some.values())
        budget = target.tokens if target.tokens is not None else most * z / math.exp(a * math.log(most / whole))
        return budget * math.exp(a * math.log(least / whole)) / z / least > target.repetition

    def bisected(up):
        lo, hi = 0.0, 1.0
        if up(1.0):
            return 1.0
        for _ in range(mixing.HALVINGS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if up(mid) else (lo, mid)
        return lo

    a = bisected(even) if target.entropy is not None else 0.0 if target.repetition is not None else 1.0
    a = max(a, bisected(often)) if target.repetition is not None else a
    p = {s: float(n) ** a for s, n in some.items()}
    z = sum(p.values())
    budget = target.tokens if target.tokens is not None else max((some[s] / p[s] for s in p), default=0) * z
    epochs = {s: budget * p[s] / z / some[s] if s in some else 1.0 for s in total}
    out = {}
    for s in total:
        blocks = Counter()
        for _, own, b, n in each:
            if own == s:
                blocks[b] += n
        order, before = sorted(blocks, key=lambda b: (number(f"{s}:{b}"), b)), 0
        times = math.floor(round(epochs[s], 6))
        for k, b in enumerate(order):
            out[s, b] = (times + (before + blocks[b] / 2 < (round(epochs[s], 6) - times) * total[s]), (k + 0.5) / len(order), p[s] / z if s in p else 0.0, epochs[s])
            before += blocks[b]
    return [(i, s, n, *out[s, b]) for i, s, b, n in each]


@pytest.mark.parametrize("target", [mixing.Target(entropy=0.98, repetition=3.0), mixing.Target(repetition=1.5), mixing.Target(entropy=0.9, tokens=5000), mixing.Target()])
def test_mixing_by_hand(spark, target):
    """The given documents, and rows that repeat, tie, have no source, no words or no doc_id."""
    docs = [(r["doc_id"], r["text"], r["source"]) for r in load(spark, FOLDER, "documents").collect()]
    odd = [(5001, "a b c", None), (5001, "a b c", None), (5002, "a b c", ""), (5003, None, "silent"), (5004, "", "silent"), (None, "x y", "tie one"), (5005, "x y", "tie two"), (5006, STORY * 500, "long")]
    rows = docs + odd
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted((tuple(r[c] for c in ("doc_id", "source", "n_tokens", "copies", "place", "weight", "epochs")) for r in mixing.mixed(frame, target).collect()), key=key)
    want = sorted(mixed_by_hand(rows, target), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4:] == pytest.approx(w[4:], rel=1e-6) for g, w in zip(got, want, strict=True))
    assert mixing.mixed(frame.filter("doc_id < 0"), target).count() == 0


# ------------------------------------------------------- WARC


def test_repeated_headers_are_errors():
    good = warc.spelled(1, "u", b"abc", None)
    assert warc.parsed(good).payload == b"abc"
    for name in (b"WARC-Type", b"Content-Length", b"WARC-Date"):
        line = next(x for x in good.split(b"\r\n") if x.startswith(name))
        with pytest.raises(ValueError, match="repeated header"):
            warc.parsed(good.replace(line, line + b"\r\n" + line, 1))
    twice = good.replace(b"WARC-Date", b"WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Date", 1)
    assert warc.parsed(twice).headers["warc-concurrent-to"] == "<a>"


def test_skippable_frames_between_records(monkeypatch):
    frame = lambda size: struct.pack("<II", warc.SKIPPABLE + 3, size) + b"s" * size
    pack = zstandard.ZstdCompressor(write_checksum=True)
    found = [pack.compress(warc.spelled(k, "u", b"x" * k, None)) for k in range(4)]
    data = frame(5) + found[0] + frame(0) + frame(3000) + found[1] + found[2] + frame(9) + found[3] + frame(40)
    for chunk in (1 << 20, 7, 100):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [len(r.payload) for r in warc.records(io.BytesIO(data))] == [0, 1, 2, 3]
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data[:-1])))


def test_encoders_are_released():
    path = public_tokenizers.path("byte_bpe_50k.json")
    before = [x.tolist() for x in bpe.encoded(["some words", None, "some other words"], path, 2)]
    bpe.release()
    assert not bpe._encoders
    assert [x.tolist() for x in bpe.encoded(["some words", None, "some other words"], path, 2)] == before
    bpe.release()
    bpe.release()
