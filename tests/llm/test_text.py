"""Tokenising, packing, chats, quality, pages and urls, and their odd rows."""

import hashlib
import random
import re
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import bpe, chat, crf, html, packing, urls
from strandlake.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "x" * 5000), (6, "don't we'll 'SE's 12½ ￼ <|endoftext|> é\u00a0\u2003z"), (None, "the cat"), (7, "the cat\n" * 4000)]
SCHEMA = "doc_id long, text string, n_tokens string, length string"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(vocabulary()))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "q", "q") for i, t in rows], SCHEMA)


def test_ids(codec, reference):
    rng = random.Random(3)
    letters = [*"ab '\n\t  stmdrevlTS019.,!é中  　²Ⅷ’", "'ll", "'re", " '", "<|endoftext|>", "\r\n", "\x1c", "\x85", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [t or "" for _, t in ODD] + ["ab" * 700, "\n" * 300, " " * 200 + "a"]
    texts += [chr(i) * 2 + " a" + chr(i) + "1!" + chr(i) for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    wanted = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    got = list(codec.encode(t.encode() for t in texts))
    assert [g.tolist() for g in got] == wanted
    assert all(codec.decode(g).decode() == reference.decode(w, skip_special_tokens=False) for g, w in zip(got, wanted, strict=True))


def test_long_texts_are_cut_where_no_word_crosses(reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    codec = bpe.Codec(bpe.load(vocabulary()))
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "é", "1", "<|endoftext|>", "!"]) for _ in range(2000))
    (ids,) = codec.encode(iter([text.encode()]))
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, reference):
    rows = bpe.round_trip(documents(spark, ODD), vocabulary()).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows), key=str)
    wanted = []
    for i, t in ODD:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    back = bpe.decode(bpe.encode(documents(spark, ODD), vocabulary()), vocabulary())
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)


def test_differencing():
    rng = random.Random(2)
    for n, k in ((0, 1), (1, 3), (7, 2), (60, 8)):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        at = packing.differencing(sizes, k)
        assert len(at) == n and (not n or 0 <= at.min() <= at.max() < k)
    sums = np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]  # the classical example of the method
    for _ in range(20):
        sizes = [rng.randint(1, 128) for _ in range(300)]
        at = packing.windows(sizes, 1024)
        sums = np.bincount(at, weights=sizes)
        assert sums.max() <= 1024 and len(sums) <= -(-sum(sizes) // 1024) + 1


def test_pack(spark, reference):
    rows = packing.pack(documents(spark, ODD), vocabulary(), with_ids=True).collect()
    used: dict = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in ODD:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        mine = [r for r in rows if r["doc_id"] == i]
        # every id of every copy lies in one piece, however the copies are cut
        assert Counter((r["start"] + k, x) for r in mine for k, x in enumerate(r["ids"])) == {(k, x): ODD.count((i, t)) for k, x in enumerate(ids)}
        assert all(r["doc_tokens"] == len(ids) for r in mine)
    assert sum(r["length"] for r in rows) == sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack(documents(spark, []), vocabulary()).count() == 0


def test_differencing_as_with_whole_vectors():
    """The sparse form against the method written down with vectors of all k windows."""

    def plain(sizes, k):
        parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
        while len(parts) > 1:
            parts.sort(key=lambda v: v[-1] - v[0])
            a, b, *parts = parts
            v = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
            parts.append([x - v[-1] for x in v])
        return parts[0][0] - parts[0][-1]

    rng = random.Random(7)
    spread = []
    for _ in range(200):
        sizes, k = [rng.randint(1, 128) for _ in range(rng.randint(2, 60))], rng.randint(1, 12)
        sums = np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)
        assert sums.sum() == sum(sizes)
        spread.append((sums.max() - sums.min(), plain(sizes, k)))
    mine, other = map(np.array, zip(*spread, strict=True))
    assert (mine == other).mean() > 0.8 and abs(mine.mean() - other.mean()) < 2  # ties may fall differently


def test_many_short_texts_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    at = packing.windows([1] * packing.PIECES, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(at).tolist() == [1024] * 64 and peak < 60e6


def test_pack_many_empty_texts(spark):
    """200,000 empty texts; padding only where a length is no power of two."""
    docs = spark.range(200_000).select(packing.F.col("id").alias("doc_id"), packing.F.lit(None).cast("string").alias("text")).coalesce(1)
    got = packing.pack(docs, vocabulary()).groupBy("sequence_id").agg(packing.F.sum("length").alias("n")).collect()
    assert sum(r["n"] for r in got) == 200_000
    assert sum(1024 - r["n"] for r in got if r["n"] & (r["n"] - 1)) < 0.02 * 200_000


# -- chats -----------------------------------------------------------------------------------


def test_every_turn_comes_back():
    rng = random.Random(4)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "\\", "\\n", "|", "user", "<", "é", " ", "assistant\n", "\\p"]
    for _ in range(4000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(2))
        shown, escaped = chat.render(role, text)
        assert chat.parse(shown) == [(role, text)]
        assert not escaped or chat.parse(f"{chat.START}{role}\n{text}{chat.END}\n") != [(role, text)]
        assert chat.parse(shown + chat.render("user", "x")[0]) == [(role, text), ("user", "x")]
    assert chat.parse("<|im_start|>user\nx") is None and chat.parse("x") is None


def test_chats(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", said), (2, 0, "assistant", said), (None, None, None, "z"), (3, 5, "system", "é" * 70_000), (3, 7, "assistant", "ü")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rendered int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(turns)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] or -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = chat.format_turns(turns).where("conv_id = 2").first()
    assert chat.unescape_text(shown["rendered"][shown["loss_start"] : shown["loss_end"]]) == said and shown["escaped"]
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


# -- quality ---------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, change = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = crf.forward_backward(score, doc, change)
    total = np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights, marginal, joint = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for code in range(1 << len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            w = np.exp(sum(score[i] * v for i, v in zip(at, y, strict=True)) + sum(change[a, b] for a, b in zip(y, y[1:], strict=False)))
            weights += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                joint[a, b] += w
        assert np.allclose(good[at], marginal / weights)
        total += joint / weights
    assert np.allclose(pairs, total)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = crf.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and ((got["predicted"] == got["quality"]).mean()) >= 0.95
    again = crf.score(docs.limit(20), labels)
    assert again.columns == ["doc_id", "held_out", "score", "predicted"]


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1.0, 0) for i, t in ODD], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = crf.score(docs, some).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)
        assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ODD if i}
        kept = crf.accepted(docs, some)
        assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert crf.score(docs.limit(0), labels).count() == 0


def test_lines_do_not_depend_on_blocks(monkeypatch):
    text = "\n".join("word " * (i % 9) + "!%&" * (i % 3) for i in range(400)).encode()
    whole = crf.lines_of(iter([text, b"", b"x y"]))
    monkeypatch.setattr(crf, "BLOCK", 100)
    parts = crf.lines_of(iter([text, b"", b"x y"]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


@pytest.fixture(scope="module")
def field():
    """A field fitted to made texts, with those texts."""
    rng = random.Random(4)
    texts = ["\n".join(("a good line of words. " if rng.random() < 0.9 - 0.8 * (k % 2) else "x%& 12 ") * rng.randrange(1, 4) for _ in range(rng.randrange(30))).encode() for k in range(80)]
    measures, lengths, doc, _ = crf.lines_of(iter(texts))
    return crf.fit(measures, lengths, doc, np.arange(80) % 2), texts


def test_scores_do_not_depend_on_pieces(field, monkeypatch):
    """Texts scored together, by themselves, or as long ones score the same; potentials come to what the features say."""
    model, texts = field
    measures, _, doc, docs = crf.lines_of(iter(texts))
    assert np.allclose(crf.lines_of(iter(texts), model)[0], crf.potentials(model, measures))
    added = crf.potentials(model, measures)
    assert np.allclose(crf._scores(model, added, doc), model["weight"][crf.features(measures, doc, model["edges"])].sum(1))
    whole = crf.quality(model, iter(texts))
    assert len(whole) == docs == 80 and whole.std() > 0.05
    monkeypatch.setattr(crf, "STEPS", 3)
    monkeypatch.setattr(crf, "PIECE", 4)
    assert np.allclose(crf.quality(model, iter(texts)), whole)
    monkeypatch.setattr(crf, "BLOCK", 50)
    assert np.allclose(crf.quality(model, iter(texts)), whole)
    assert crf.quality(model, iter([])).shape == (0,)


def test_many_short_lines_take_little_memory(field):
    """Beyond what a block takes, a one-letter line takes under 100 bytes (1,100 with its features held)."""
    peaks = []
    for n in (250_000, 1_000_000):
        tracemalloc.start()
        score = crf.quality(field[0], iter([b"a\nb\n" * (n // 2)]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert 0 <= score[0] <= 1
    assert peaks[1] - peaks[0] < 100 * 750_000


# -- pages -----------------------------------------------------------------------------------


def test_blocks():
    page = "a<p>b &amp; c<b>d</b><br>e<script>x<p>y</script><ul><li>1<li>2</ul><!-- z --><div class='ad x' id=q>f</div>g&nbsp;h<style>p{}</style><head><title>t</title></head>"
    assert [b[0] for b in html.blocks(page)] == ["a", "b & cd e", "1", "2", "f", "g h"]
    ad = html.blocks(page)[4]
    assert ad.inner == "div" and ad.said is False and ad.path == html.Path().into("div", ("ad", "x", "q")).bits
    assert [b.said for b in html.blocks("<article><p>a<div class=content-ads>b</div></article><header>c</header><main><header>d</header></main>")] == [True, False, False, True]
    began = time.perf_counter()
    assert html.blocks("<p>a</p><script>" + "</script " * 120_000) == html.blocks("<p>a</p>") and time.perf_counter() - began < 1
    assert [b[0] for b in html.blocks("<script>x</scripts></script\n a>b")] == ["b"]
    assert html.blocks("") == html.blocks("<p></p><p> </p>") == html.blocks("<script>x") == []
    assert [b[0] for b in html.blocks("<p>a < b <c")] == ["a < b"]


def test_deep_long_and_broken_pages():
    """Linear in depth, in open elements and in what is never closed."""
    assert len(html.blocks("<div>x" * 30_000)) == 30_000
    for page, n in (("<b>" * 20_000 + "<p>x</p>" * 20_000, 20_000), ("<a " * 100_000 + "'", 0), ("<p>x</i></b>" * 20_000, 20_000), ("<a href='" * 50_000, 0), ("</div>" * 50_000, 0), ("<table><tr><td>x" * 5_000, 5_000)):
        assert len(html.blocks(page)) == n
    assert [b.text for b in html.blocks("<p title=it's>a</p><p title='x>y'>b")] == ["a", "b"]


def test_long_pages_are_read_alike(monkeypatch):
    page = html.blocks("".join(f"<div class=c{i % 3}><p>word {i}, and so on.</p></div><li>x" for i in range(150)))
    model = html.Labeller(html.PATHS + html.WORDS + html.EXTRA)
    whole = model.probabilities([page])[0]
    monkeypatch.setattr(html, "LONG", 64)
    assert np.allclose(model.probabilities([page])[0], whole)


def test_gradient():
    rng = np.random.default_rng(2)
    model = html.Labeller(5, 3)
    x, lengths = rng.normal(size=(2, 4, 5)), np.array([4, 3])
    y = rng.integers(0, 2, (2, 4)).astype(float)
    there = np.arange(4) < lengths[:, None]

    def loss():
        p = 1 / (1 + np.exp(-(model.read(x, lengths) @ model.out[:-1] + model.out[-1])))
        return -(np.where(there, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / there.sum()

    keep: list = []
    p = 1 / (1 + np.exp(-(model.read(x, lengths, keep) @ model.out[:-1] + model.out[-1])))
    grads = model._back(x, np.where(there, p - y, 0) / there.sum(), keep)
    for k in range(2):
        for at in ((0, 0), (5, 7), (-1, 2), (6, 11)):
            model.w[k][at] += 1e-5
            up = loss()
            model.w[k][at] -= 2e-5
            down = loss()
            model.w[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    strange = """<html><body><nav><a href=x>Home</a></nav><main><article><h1>Title</h1><p>First words of it.</p><aside class="related"><p>See also</p></aside>
    <p>Second &amp; last words of it.</p></article></main><div id="comments"><p>Nice post, thanks for it.</p></div><form><p>Sign up now</p></form><footer>All rights</footer></body></html>"""
    odd = spark.createDataFrame([(9001, "u", None), (9002, None, ""), (None, "u", "<p>"), (9003, "u", strange), (9003, "u", strange)], "page_id long, url string, html string")
    got = html.extract(pages.unionByName(odd).withColumn("text", html.F.lit(1)), 60)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert [r["text"] for r in rows[9003]] == ["Title\n\nFirst words of it.\n\nSecond & last words of it."] * 2
    assert rows[9001][0]["text"] == rows[9002][0]["text"] == rows[None][0]["text"] == ""
    right = 0
    source = pages.collect()
    for p in source:
        body = re.sub(r"<br>", " ", re.search(r"<article>(.*)</article>", p["html"], re.S)[1])
        parts = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        right += rows[p["page_id"]][0]["text"] == "\n\n".join(x for x in parts if x)
    assert right >= 0.98 * len(source)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """The labeller trained on 160 pages, and pages that it hasn't seen."""
    source = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    return html.train(spark.createDataFrame([(i, "u", h) for i, h in enumerate(source[:160])], "page_id long, url string, html string")), source[160:]


@pytest.mark.parametrize("holder", ["article", "main", 'div class="content"'])
def test_short_main_text_is_kept(labelled, holder):
    """Short paragraphs, lists, tables, code and links within main text are kept, and whole sentences beside it are left out."""
    model, source = labelled
    rng = random.Random(2)
    whole = [b.text for h in source for b in html.blocks(h) if b.said and len(b.text.split()) >= 20]

    def words(n):
        w = rng.choice(whole).split()
        at = rng.randrange(len(w) - n)
        return " ".join(w[at : at + n])

    def items(element, texts):
        return "".join(f"<{element}>{t}</{element.split()[0]}>" for t in texts)

    shapes = {
        "p": lambda t: items("p", t),
        "li": lambda t: f"<ul>{items('li', t)}</ul>",
        "td": lambda t: f"<table><tr>{items('td', t)}</tr></table>",
        "link": lambda t: items("p", [f"<a href=x>{x}</a>" for x in t]),
        "pre": lambda t: items("pre", t),
    }
    sides, left = 0, 0
    for shape in shapes.values():
        kept = 0
        for _ in range(30):
            long, short = rng.sample(whole, 4), [words(8) for _ in range(4)]
            menu, foot, related = [words(2) for _ in range(4)], rng.sample(whole, 1), [words(6), *rng.sample(whole, 1)]
            main = items("p", long[:2]) + shape(short) + items("p", long[2:]) + f"<div class=related>{items('p', related)}</div>"
            page = f"<body><nav><ul>{items('li', menu)}</ul></nav><{holder}><h1>{words(4)}</h1>{main}</{holder.split()[0]}><footer>{items('p', foot)}</footer></body>"
            parsed = html.blocks(page)
            found = [b.text for b, y in zip(parsed, model.probabilities([parsed])[0], strict=True) if y >= 0.5]
            beside = {*menu, *foot, *related} - {*long, *short}
            kept += sum(t in found for t in short)
            sides, left = sides + len(beside), left + sum(t not in found for t in beside)
        assert kept >= 0.9 * 120
    assert left >= 0.95 * sides


def test_extraction_without_telling_names(labelled):
    """The labeller, trained on some pages, reads others whose classes and ids are random, and whose articles, menus and the like are plain boxes."""
    model, source = labelled
    rng = random.Random(1)
    hidden = [re.sub(r'(class|id|role)="[^"]*"', lambda m: f'{m[1]}="{rng.choice("abcdefgh") * 4}"', h) for h in source]
    boxes = [re.sub(r"<(/?)(article|main|nav|footer|aside|header|form|section)\b", r"<\1div", h) for h in hidden]
    said = [[b.text for b in html.blocks(h) if b.said] for h in source]
    for pages in (hidden, boxes):
        parsed = [html.blocks(h) for h in pages]
        found = [[b.text for b, y in zip(p, q, strict=True) if y >= 0.5] for p, q in zip(parsed, model.probabilities(parsed), strict=True)]
        assert sum(x == y for x, y in zip(found, said, strict=True)) >= 0.95 * len(said)


# -- urls ------------------------------------------------------------------------------------


def brute_rule(host, path):
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    rng = random.Random(5)
    hosts = ["Example.NET", "example.com", "a.example.com", "xexample.com", "org", "b.org", "net", "x.net:80", "example.org", ""]
    tails = ["", "/", "/en/", "/en/12", "/de/7?x=/fr/", "/fr/a#b", "?q", "#f", "/DE/1", "/de", "/de/" + "9" * 40 + "/x/y/z/w"]
    rows = [(i, rng.choice(["http://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(tails)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "http://example.net/en/"), (1002, "http://a.com/" + "s/" * 5000)]
    got = urls.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    found: dict = {}
    for r in got:
        found.setdefault(r["page_id"], []).append(r)
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule, verdict = brute_rule(host, path)
        for r in found[i]:
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rules = (("spam.org/ad/", "block"), ("spam.org/", "allow"))
    rows = [(i, f"http://spam.org/ad/{i}") for i in range(60)] + [(100 + i, f"http://spam.org/news/{i}") for i in range(60)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    score = {r["template"]: r["purity"] for r in got}
    assert score["/ad/{n}"] > urls.PURITY and score["/news/{n}"] < 0.2


def test_templates_on_pages_whose_labels_were_held_back(spark):
    """On the table itself: labels of a fifth of the pages are kept from the tree, which then judges them by their templates."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judge(pages, learn=urls.F.col("page_id") % 5 != 0).where("page_id % 5 = 0 AND rule IS NOT NULL").groupBy("verdict", "method").count().collect()
    n = {(r["verdict"], r["method"]): r["count"] for r in got}
    assert n.get(("block", "block"), 0) > 0 and n.get(("allow", "block"), 0) == 0  # hosts of this table have few pages of a section


def test_undecided_pages_are_rejected_with_their_template(spark):
    """Rules know some numbered pages of a section only; the others of the same template go with them, and those of a clean one stay."""
    rules = (("a.org/track/1", "block"), ("a.org/news/1", "allow"), ("b.org/", "allow"))
    rows = [f"http://a.org/{s}/{k}" for s in ("track", "news") for k in range(200)] + [f"http://b.org/{k}" for k in range(100)]
    got = {r["path"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()}
    assert got["/track/27"]["rule"] is None and got["/track/27"]["verdict"] == "block"
    assert {got[f"/track/{k}"]["verdict"] for k in range(200)} == {"block"} and {got[f"/news/{k}"]["verdict"] for k in range(200)} == {"allow"}


def test_url_templates_of_busy_and_deep_nodes(spark):
    """Neither many siblings nor deep paths take a template of its own from a section."""
    rules = (("example.com/de/", "block"), ("example.com/en/", "allow"), ("ads.a.org/", "block"), ("good.a.org/", "allow"))
    urls_ = [f"http://example.com/{s}/{k}" for s in ("de", "en") for k in range(40)]
    urls_ += [f"http://example.com/s{chr(97 + i // 26)}{chr(97 + i % 26)}/{k}" for i in range(100) for k in range(2)]
    # labels and undecided pages part at the fifth segment only
    rules += tuple((f"deep.net/a/b/c/d/{what}/x/", verdict) for what, verdict in (("bad", "block"), ("fine", "allow")))
    urls_ += [f"http://deep.net/a/b/c/d/{what}/{x}/{k}" for what in ("bad", "fine") for x in ("x", "y") for k in range(60)]
    urls_ += ["http://long.net/" + "/".join(f"v{chr(97 + k % 26)}" for k in range(300)), "http://slash.net//", "http://slash.net/a//b/"]
    got = {r["path"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), rules).collect() if r["host"] != "other"}
    assert len(got) == len(set(urls_))
    assert {got[f"/de/{k}"]["template"] for k in range(40)} == {"/de/{n}"} and {got[f"/de/{k}"]["verdict"] for k in range(40)} == {"block"}
    assert all(r["verdict"] == "allow" for r in got.values() if r["path"].startswith("/s"))
    assert all(got[f"/a/b/c/d/{w}/x/{k}"]["template"].startswith(f"/a/b/c/d/{w}/") for w in ("bad", "fine") for k in range(60))
    assert got["/" + "/".join(f"v{chr(97 + k % 26)}" for k in range(300))]["template"].count("/") == 300
    assert got["//"]["template"].count("/") == 2
