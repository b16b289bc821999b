import random
import struct
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import decontaminate, html_density, packing, quality_crf, secret_ledger, sstable, tokens

SMALL = "/root/testdata/sf0.001"


def ids_of(name, text):
    from tokenizers import Tokenizer

    if name not in ids_of.kept:
        ids_of.kept[name] = Tokenizer.from_file(tokens.public_path(name))
    return [*ids_of.kept[name].encode(text or "", add_special_tokens=False).ids, 2]


ids_of.kept = {}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


#: What split patterns, normal forms and special tokens could trip over.
PIECES = [*" \n\t\r\x0b\x1c\x85\u00a0\u1680\u2003\u2028\u3000aAbBéÉßİΣςſKñŉǅ日本語١2½'’“—….,;:!?-()<>|_/~`´", "  ", "\n\n", " ", " ", " ", "\u0301", "\u0338", "e\u0301", "'s", "'t", "'ll", "n't", "hello", "World", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|>", "3.14", "😀", "\u200b", "ﬁ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(rows, name, monkeypatch):
    odd = ["  a  b\n\n c", " hello world", " hello, world", " Hello\nworld", "a <|endoftext|> b", "x<|startoftext|>y", "a\tb c d  ", "\n\nab\n c ", "日本語 text, fine. 123abc!!", "'s 't it's ' s", "ends ", ""]
    rng = random.Random(7)
    fuzz = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts = [*odd, *fuzz, *(t for _, t in rows)]
    want = [ids_of(name, t)[:-1] for t in texts]
    monkeypatch.setattr(tokens, "KEPT", 500)  # so that parts beyond the table occur
    monkeypatch.setattr(tokens, "CHUNK", 3000)
    encoder = tokens.Encoder(tokens.public_path(name))
    got = []
    for first, end, ids, at in encoder.column(pa.array(texts, pa.string())):
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(end - first)]
    assert got == want
    assert encoder.encode(None).tolist() == [] and encoder.encode("ab cd").tolist() == ids_of(name, "ab cd")[:-1]


def test_token_shards(spark, docs, rows):
    want, start = {}, 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = ids_of("byte_bpe_50k.json", text)
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in sstable.token_shards(spark, docs).collect()} == want


def test_shard_look_up(tmp_path):
    path = tmp_path / "x.sst"
    entries = {k * k - 50_000: struct.pack("<3H", k % 9, 1, 2) * (k % 40) for k in range(2000)}
    with path.open("wb") as out:
        writer = sstable.ShardWriter(out, 2)
        for k, v in sorted(entries.items()):
            writer.add(sstable.key_of(k), v)
        writer.close()
    with path.open("rb") as file:
        reader = sstable.ShardReader(file)
        assert len(reader.index) > 1 and dict(reader) == entries
        assert all(reader.get(k) == v for k, v in entries.items())
        assert reader.get(-50_001) is None and reader.get(3) is None and reader.get(10**12) is None


def test_token_shard_cases(spark, none, repeated):
    assert sstable.token_shards(spark, none).count() == 0
    got = sorted(tuple(r) for r in sstable.token_shards(spark, repeated).collect())
    n = got[0][2]
    assert [(r[0], r[1]) for r in got] == [(1, 0), (1, n), (2, 2 * n)]


def check_packing(pieces, texts, window=4096):
    """Every id in one piece; sequences gapless and full, or of a power of two."""
    left, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        left[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc_id, text in texts:
        ids, at = ids_of("word_bpe_49k.json", text), 0
        for p in sorted(left.pop(doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not left
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(spark, docs, rows, window):
    check_packing(packing.pack_documents(spark, docs, window=window).collect(), rows, window)


def test_packing_by_a_shuffle(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_CUTS", -1)
    check_packing(packing.pack_documents(spark, docs, window=256).collect(), rows, 256)


def test_packing_cases(spark, none, repeated):
    assert packing.pack_documents(spark, none).count() == 0
    got = packing.pack_documents(spark, repeated, window=8).collect()
    assert sum(p.length for p in got) == 3 * len(ids_of("word_bpe_49k.json", "some words here in a text that is repeated")) + len(ids_of("word_bpe_49k.json", "no id"))


def test_least_squares_meets_the_histogram():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 54, 20, 22, 32]] = [30, 30, 40, 80, 50]
    rows, times = packing.combinations(histogram, 64)
    assert ((rows * times).sum(axis=1) == 64).all()
    counts = packing.rounded(rows, times, packing.least_squares(rows, times, histogram), histogram)
    used = np.bincount(rows.reshape(-1), (counts[:, None] * times).reshape(-1), minlength=65)
    assert (used <= histogram).all() and used.sum() >= 0.9 * histogram.sum()


def test_secrets(spark, docs, rows):
    got = {r.doc_id: r for r in secret_ledger.digest(secret_ledger.secret_scan(spark, docs)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        counts, digest, found = brute.secrets(text)
        r = got[i]
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (counts, digest)
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))


def test_secret_ledger_scans_what_it_lacks(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "none")], "doc_id long, text string")
    ledger, paths = secret_ledger.update(spark, first, secret_ledger.Ledger.empty(spark))
    assert ledger.scanned.select("blob").distinct().count() == 2 and ledger.found.count() == 1
    again, _ = secret_ledger.update(spark, first, ledger)
    assert again.scanned.count() == ledger.scanned.count() and again.found.count() == 1
    more = first.union(spark.createDataFrame([(1, "x token: ABCDEFGHI"), (4, "token=abcdefgh")], "doc_id long, text string"))
    later, paths = secret_ledger.update(spark, more, ledger)
    assert later.scanned.count() == ledger.scanned.count() + len(secret_ledger.RULES)
    rows = secret_ledger.digest(secret_ledger.joined(paths, later)).collect()
    assert sorted((r.doc_id, r.spans) for r in rows) == [(1, "assign:0:14"), (1, "assign:2:18"), (2, "assign:0:14"), (3, ""), (4, "assign:0:14")]
    newer, _ = secret_ledger.update(spark, first, later, version="2")
    assert newer.scanned.where("version = '2'").select("blob").distinct().count() == 2


def test_secret_cases(spark, none, repeated):
    assert secret_ledger.secret_scan(spark, none).count() == 0
    assert secret_ledger.secret_scan(spark, repeated).count() == 4


ITEM = "A train leaves Boston at 60 km per hour and Boston is 180 km from Albany so when does the train reach Albany after leaving"


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, -1])
def test_decontaminate(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    texts = [
        (1, "Before it. " + ITEM + ". After it."),
        (2, "Before " + ITEM.replace("Boston", "Paris").replace("Albany", "Lyon").replace("60", "90").replace("180", "450")),
        (3, ITEM.replace("Boston", "Paris", 1).replace("Albany", "Lyon").replace("60", "90")),
        (4, "A clean text about trains that leave and reach towns after an hour or two of travel on the line."),
        (5, None),
        (6, ITEM.upper()),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
    ]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in texts], "doc_id long, text string, item_id long, hash string")
    items = spark.createDataFrame([(9, ITEM), (10, "too short"), (11, None), (12, "5 6 7 8 9 10 11 12 13 14 15 16 17 18 19")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark, docs, items).collect()}
    # in 3 one name stands for two of the item's places and its like for another
    assert got == {(1, 9), (2, 9), (6, 9)} or got == {(1, 9), (2, 9)}


def test_decontaminate_finds_what_contains_an_item(spark):
    import re

    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark, docs, items).collect()} == want


def test_decontaminate_cases(spark, docs, none, repeated):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(spark, docs, items).count() == 0
    some = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "item_id long, text string")
    assert decontaminate.decontaminate(spark, none, some).count() == 0
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id long, text string")
    assert [tuple(r[:2]) for r in decontaminate.decontaminate(spark, twice, some).collect()] == [(1, 1)]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality_crf.quality(spark, docs, labels).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    known = [(found[r.doc_id].predicted, r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(p == q for p, q in known) / len(known) >= 0.95


def test_quality_cases(spark, docs, none, repeated):
    labels = spark.createDataFrame([(101, 1), (102, 1), (None, 0), (103, None)], "doc_id long, quality int")
    rows = quality_crf.quality(spark, docs, labels).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {1.0}
    assert quality_crf.quality(spark, none, labels).count() == 0
    assert {r.score for r in quality_crf.quality(spark, repeated, labels.limit(0)).collect()} == {0.5}
    both = spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert quality_crf.quality(spark, docs, both).where("score is null or isnan(score)").count() == 0


def test_marginals_against_all_labellings():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        unary, transition = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[k] * y[k] for k in range(n)) + sum(transition[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        got = quality_crf.marginals(unary, np.array([0, n]), transition)
        assert np.allclose(got[0], good / total) and np.allclose(got[1], pairs / total)


PAGES = {
    "<html><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One &amp; two<p>Three<br>four <b>bold</b> &eacute;</article><footer>&copy;</footer></body></html>": "Head\nOne & two\nThree\nfour bold é",
    "<body><div class='sidebar left'>Links</div><div><p>Some long text of an article here, with words.</p><p>And another paragraph\n\n of  it, which is long as well.</p></div><div id=comments><p>I disagree</p></div></body>": "Some long text of an article here, with words.\nAnd another paragraph of it, which is long as well.",
    "<script>var x='<p>no</p>'</script><p>Plain": "Plain",
    "": "",
    None: "",
    "no markup at all": "no markup at all",
    "<article><p>Text <!-- not this --> goes<form><p>mail</p><input></form><p>on</article>": "Text goes\non",
    "<div><p>unclosed <b>bold<p>next</div></div></p>": "unclosed bold\nnext",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_html(page):
    assert html_density.extract(page) == PAGES[page]


def test_html_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"<(?:p|/p|br|h1|/h1)>", inner)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    got = html_density.extract_pages(pages).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {k: (t, len(t)) for k, t in want.items()}


def test_html_cases(spark):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", deep), (2, "u", deep)]
    got = html_density.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "text", "text", "x"]
    assert html_density.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

MATHS = "What is 15 percent of 240 plus 30 percent of 90?"
LIST = "3 8 5 9 2 7 4 6 1 11 are the numbers to add up and halve"


def test_decontaminate_items_rich_in_slots(spark):
    """Runs go on over windows of few plain words, and items shorter than a window count as a whole."""
    texts = [
        (1, "So: " + MATHS + " Say it."),
        (2, "So: " + MATHS.replace("15", "25").replace("240", "80").replace("30 ", "40 ").replace("90", "60")),
        (3, "Here " + LIST + " now"),
        (4, "Here " + LIST.replace("11", "12").replace("3 8", "8 3") + " now"),
        (5, "we say: name the capital of France! or not"),
        (6, "3 8 5 9 2 7 4 6 1 11 15 240 30 90 3 8 5 9 2 7 4 6 1 11"),
        (7, "A name, a capital and what is of note."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, MATHS), (2, LIST), (3, "Name the capital of France"), (4, "15 240 30 90")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark, docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)}


STORY = "Alice has 3 apples. Bob has 5 apples. How many apples do they have in total?"
TALK = "The red boat and Bob sail past seven old mills until the wind turns at night"


def test_decontaminate_sees_through_names_case_and_wrapping(spark):
    texts = [
        (1, "Clara has 4 apples. Dave has 9 apples. How many apples do they have in total?"),
        (2, STORY.upper()),
        (3, STORY.lower()),
        (4, TALK.replace("and Bob", "and\nBob").replace("at night", "at  night")),
        (5, TALK.upper()),
        (6, "Clara has 4 pears. Dave has 9 plums. How few apples do we have in hand?"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, STORY), (2, TALK)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark, docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


PROSE = "The river rose again last night, and by morning the whole of the lower town stood under water."
WRAPPED = [
    f"<body><div class='has-sidebar'><article><p>{PROSE}</p></article><div class='sidebar'>Other news</div></div></body>",
    f"<body><div class='no-sidebar'><p>{PROSE}</p></div></body>",
    f"<body><form action='x'><nav>Home</nav><div><p>{PROSE}</p></div></form></body>",
    f"<body><div class='with-comments'><div class='text'><p>{PROSE}</p></div><div class='comments'><p>Nice.</p></div></div></body>",
    f"<body><div class='sidebar'><article>A card</article></div><main><p>{PROSE}</p><form>Search</form></main></body>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_html_keeps_wrapped_articles(page):
    assert html_density.extract(page) == PROSE


LINE = "The river rose again last night, and by morning the whole of the lower town stood under water."
LINKS = "".join(f"<li><a href=x>Topic {k}</a></li>" for k in range(40))
GRID = "".join(f"<div><span>Item</span> <span>{k}</span></div>" for k in range(60))
#: Pages without an article or main, and without a class that says anything.
BARE = {
    f"<body><div>{LINE}</div><div>" + "".join(f"<a href=x>Link number {k}</a> " for k in range(30)) + "</div></body>": LINE,
    f"<body><div class=x><ul>{LINKS}</ul></div><div><h1>Title</h1><p>{LINE}</p><h2>Sub</h2><p>{LINE}</p><p>Short.</p></div></body>": f"Title\n{LINE}\nSub\n{LINE}\nShort.",
    f"<body><div><h1>Title</h1><section><p>{LINE}</p><p>{LINE}</p></section><section><h2>More</h2><p>{LINE}</p></section><p>End.</p></div><div><a href=1>One</a> <a href=2>Two</a></div></body>": f"Title\n{LINE}\n{LINE}\nMore\n{LINE}\nEnd.",
    f"<body><div><p>{LINE}</p><p>{LINE}</p></div><div>{GRID}</div></body>": f"{LINE}\n{LINE}",
    f"<body><p>{LINE}</p><ul>{LINKS}</ul><p>{LINE}</p></body>": f"{LINE}\n{LINE}",
    f"<article><h1 class='header'>Head</h1><p class='notice'>Take care.</p><p class='promo'>{LINE}</p></article>": f"Head\nTake care.\n{LINE}",
}


@pytest.mark.parametrize("page", list(BARE))
def test_html_by_density(page):
    assert html_density.extract(page) == BARE[page]


def test_html_needs_the_densities(monkeypatch):
    monkeypatch.setattr(html_density, "density", lambda chars, *rest: 1.0 if chars else 0.0)
    assert [p for p, text in BARE.items() if html_density.extract(p) != text]


def test_html_densities_against_plain_ones(spark):
    """Counts by walking each node's whole subtree, the formula and the sums written out."""
    import math

    def walk(node, in_link):
        for p in node.parts:
            if type(p) is str:
                yield len(" ".join(p.split())), 0, in_link
            else:
                yield 0, 1, p.tag == "a"
                yield from walk(p, in_link or p.tag == "a")

    def counts(node):
        up, in_link = node, False
        while up is not None:
            in_link |= up.tag == "a"
            up = up.parent
        parts = list(walk(node, in_link))
        return sum(c for c, _, _ in parts), sum(c for c, _, link in parts if link), sum(t for _, t, _ in parts), sum(t for _, t, link in parts if link and t)

    def plain(c, lc, t, lt, cb, lcb):
        if c == 0:
            return 0.0
        inner = math.log(c / max(1, c - lc) * lc + lcb / max(1, cb) * c + math.e)
        return c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(1 + inner)

    some = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").limit(5).collect()]
    for page in [*BARE, *WRAPPED, *some]:
        root = html_density.parse(page)
        nodes, body = html_density._measure(root)
        cb, lcb, _, _ = counts(body)
        density = {x: plain(*counts(x), cb, lcb) for x in nodes}
        for x in nodes:
            assert math.isclose(x.density, density[x], abs_tol=1e-9)
            assert x.total >= sum(density[p] for p in x.parts if type(p) is not str) - 1e-9
        inside = [x for x in nodes if x is body or any(x is y for y in _below(body))]
        assert math.isclose(body.best.total, max(x.total for x in inside))


def _below(node):
    for p in node.parts:
        if type(p) is not str:
            yield p
            yield from _below(p)


@pytest.mark.parametrize("part", ["<a ", "<a \"'>", "<!--", "<script>", "<div>", "<div class='ad'>", "<p><b>"])
def test_html_reads_a_hostile_page_once(part):
    import time

    page = part * (1_000_000 // len(part)) + "text"
    began = time.process_time()
    html_density.extract(page)
    assert time.process_time() - began < 5


def test_html_hostile_page_takes_few_calls_a_tag():
    """Counted, as a time depends on the machine; and no garbage is looked for while a tree is built."""
    import gc
    import sys

    calls, rounds = [0], []
    page = "<p><b>" * 20_000 + "text"

    def counted(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    def noted(phase, info):
        rounds.append(phase)

    gc.collect()
    sys.setprofile(counted)
    try:
        assert html_density.extract(page) == "text"
    finally:
        sys.setprofile(None)
    assert calls[0] < 25 * 40_000
    gc.callbacks.append(noted)
    try:
        html_density.extract(page)
    finally:
        gc.callbacks.remove(noted)
    assert len(rounds) <= 4 and gc.isenabled()


def test_html_clashing_columns(spark):
    rows = [(1, "u", "<p>x</p>", "a", 3, "t")]
    got = html_density.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, `a.b` string"))
    assert [tuple(r) for r in got.collect()] == [(1, "u", "x", 1)]


def test_decontaminate_against_all_diagonals(spark):
    """The data's items and others, verbatim, wrapped, in other case, with other numbers and names, cut and shuffled, in documents of all kinds."""
    rng = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(1001, MATHS), (1002, LIST), (1003, STORY), (1004, TALK), (1005, "Name the capital of France"), (1006, "Mix 3 kg of sand with 2 l of water for 10 minutes"), (1007, "one two three four five six seven eight nine")]
    names = {"Alice": "Clara", "Bob": "Dave", "France": "Spain"}
    made = []
    for i, text in items:
        other = "".join(str((int(c) * 3 + 1) % 10) if c.isdigit() else c for c in text)
        for a, b in names.items():
            other = other.replace(a, b)
        words = text.split()
        cut = " ".join(words[: rng.randint(5, 16)])
        mixed = " ".join(rng.sample(words, len(words)))
        made += [f"Well then. {text} So much for that.", other, text.upper(), "\n".join(words), f"and {cut} and other things", mixed, f"x {other} y {cut}"]
    rng.shuffle(made)
    docs += [(10_000 + k, t) for k, t in enumerate(made)]
    want = brute.leaks(docs, items)
    found = decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 100
