"""Each operator against a brute-force version, and on awkward tables."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from ledgerspark.llm import byte_cnn, components, decontam, html_render, license_scan, line_dedup, mixing, queries, sharding, simhash, token_files, weak_rules
from ledgerspark.llm.license_rules import BASE, rules

from .conftest import AWKWARD

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def rows(df):
    return [r.asDict() for r in df.collect()]


def both(texts):
    return [(i, t) for i, t, _ in AWKWARD] + list(texts.items())


# --- 1 ---------------------------------------------------------------------------------------------------------


def brute_overlaps(text, items):
    """Every alignment of every item, window by window, without masks."""
    doc, found = decontam.tokens(text), set()
    for item, own in items.items():
        w = min(decontam.WINDOW, len(own))
        least = decontam.AGREE * w if len(own) >= decontam.MIN_ITEM else w
        for shift in range(-len(own) + 1, len(doc)):
            same = [own[p] == doc[p + shift] for p in range(len(own)) if 0 <= p + shift < len(doc)]
            if any(sum(same[s : s + w]) >= least for s in range(len(same) - w + 1)):
                found.add(item)
    return found


def test_decontamination_matches_brute_force():
    rng = np.random.default_rng(1)
    vocab = [f"t{i}" for i in range(12)]
    items = {i: [str(x).encode() for x in rng.choice(vocab, n)] for i, n in enumerate([5, 8, 9, 12, 14, 20, 30, 40])}
    searcher = decontam.Searcher([(i, b" ".join(x).decode()) for i, x in items.items()])
    for trial in range(60):
        doc = [str(x).encode() for x in rng.choice(vocab, int(rng.integers(0, 40)))]
        own = list(items[trial % 8])
        for at in rng.choice(len(own), len(own) // 8, replace=False):
            own[at] = b"other"
        text = b" ".join(doc[:7] + own[: int(rng.integers(1, 41))] + doc[7:]).decode()
        assert set(searcher.find(text)) == brute_overlaps(text, items)


def test_decontamination_finds_substituted_copies_and_leaves_the_rest(spark, awkward):
    passage = " ".join(f"word{i}" for i in range(40))
    changed = " ".join("other" if i % 9 == 4 else f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"before {passage.upper()} after"), (2, f"a, b; {changed}."), (3, " ".join(f"word{i}" for i in range(12))), (4, None), (4, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (8, None), (9, ""), (None, passage), (10, "too short")], "item_id long, text string")
    got = rows(decontam.overlaps(docs, bench))
    assert sorted((r["doc_id"], r["item_id"], r["n_aligned"], r["n_same"], r["doc_word"]) for r in got) == [(1, 7, 40, 40, 1), (2, 7, 40, 36, 2), (4, 7, 40, 40, 0)]
    assert sorted(r["doc_id"] for r in rows(decontam.clean(docs, bench))) == [3, 4]
    assert decontam.overlaps(awkward, bench).count() == 0
    assert decontam.clean(awkward, bench).columns == awkward.columns and decontam.clean(awkward, bench).count() == len(AWKWARD)
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.overlaps(docs.limit(0), bench).count() == 0


def test_masks_hit_every_window_that_agrees_enough():
    for w in range(decontam.MIN_ITEM, decontam.WINDOW + 1):
        spared = w - min(n for n in range(w + 1) if n >= decontam.AGREE * w)
        changed = [sum(1 << i for i in c) for c in combinations(range(w), spared)]
        own = [least for least in decontam.LOSSLESS if least <= w]
        masks = [int(m, 2) << at for m in decontam.LOSSLESS[max(own)] for at in range(w - len(m) + 1)]
        assert all(any(not c & m for m in masks) for c in changed), w


@pytest.mark.parametrize("n", [8, 9, 10, 12, 14, 15, 16, 18, 19, 20, 25, 38, 59])
def test_recall_is_that_of_a_search_without_masks(n):
    rng = np.random.default_rng(n)
    item = [f"w{i}".encode() for i in range(n)]
    searcher, w = decontam.Searcher([(1, b" ".join(item).decode())]), min(n, decontam.WINDOW)
    every_fifth = [[i for i in range(n) if i % 5 == r] for r in range(5)]
    for gone in every_fifth + [rng.choice(n, int(rng.integers(0, n // 4 + 2)), replace=False) for _ in range(300)]:
        same = np.ones(n, bool)
        same[gone] = False
        text = b" ".join([b"before"] * 3 + [x if s else b"other" for x, s in zip(item, same, strict=True)] + [b"after"]).decode()
        assert bool(searcher.find(text)) == any(same[s : s + w].sum() >= decontam.AGREE * w for s in range(n - w + 1)), gone


def test_items_without_an_id_and_short_items(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "So: a SHORT item, here"), (3, "a short other item"), (4, "Short item")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (5, "a short item"), (6, "short item"), (7, ""), (8, None)], "item_id long, text string")
    assert [r["doc_id"] for r in rows(decontam.clean(docs, bench))] == [3]
    got = sorted((r["doc_id"], r["item_id"], r["n_same"], r["n_aligned"], r["doc_word"]) for r in rows(decontam.overlaps(docs, bench)))
    assert got == [(2, 5, 3, 3, 1), (2, 6, 2, 2, 2), (4, 6, 2, 2, 0)]


def test_joins_by_shuffle_and_one_text_at_a_time_give_the_same(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(decontam.overlaps(docs, bench))
    assert key(decontam.overlaps(docs, bench, max_broadcast=0, max_item_tokens=0)) == want != []
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    searcher, n = decontam.Searcher(items), {i: len(decontam.tokens(x)) for i, x in items}
    assert want == sorted((r["doc_id"], i, *o, n[i]) for r in docs.collect() for i, o in searcher.find(r["text"]).items())


def test_one_overlap_over_two_regions_and_a_run_of_one_word(spark):
    item = [f"w{i}" for i in range(200)]
    middle = [f"x{i}" for i in range(60)]
    text = " ".join(["a"] * 5 + item[:70] + middle + item[130:])
    docs = spark.createDataFrame([(1, text), (2, "no " * 3000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "no " * 500)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.overlaps(docs, bench).collect())
    # four tokens of the changed middle lie in windows of either side
    assert got == [(1, 1, 140, 148, 5, 0, 200)] * 2 + [(2, 2, 500, 500, 0, 0, 500)]


def test_the_filter_holds_all_that_was_entered():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    bitmap = np.zeros(1 << 15, np.uint8)
    decontam.fill(bitmap, h)
    assert len(decontam.entered(bitmap, h)) == 5000 and len(decontam.entered(bitmap, rng.integers(0, 1 << 63, 200_000).astype(np.uint64))) < 2000
    assert not len(decontam.entered(np.zeros(16, np.uint8), h))


# --- 2 ---------------------------------------------------------------------------------------------------------

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div>b<div>c</div>": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul></ul>d": "- a\n- b\n  - c\n\nd",
    "<ol start=3><li>a</li><li>b</li></ol>": "3. a\n4. b",
    "<table><tr><th>name<th>n<tr><td>long one<td>5</table>": "name      n\nlong one  5",
    "<table><tr><td colspan=2>wide<tr><td>a<td>b</table>": "wide\na  b",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "a &amp; b &lt;&nbsp;c": "a & b < c",
    "<pre>x\n  y</pre>": "x\n  y",
    "a<br>b<br/>c": "a\nb\nc",
    "<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>": "yes",
    "<style>.ad,#x{display:none} p{margin:0}</style><div class='b ad'>no</div><i id=x>no</i>yes": "yes",
    "<script>var a='</p><p>';</script>t<!-- no --><noscript>no</noscript>": "t",
    "<b>un<i>closed": "unclosed",
    "a</p>b": "a\n\nb",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<blockquote>q</blockquote>z": "  q\n\nz",
    "": "",
    "<table><tr hidden><td>no</tr><tr style='display:none'><td>no<tr><td>yes</table>": "yes",
    "<table><tbody><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes</table>": "  yes",
    "<table><tbody style='visibility:hidden'><tr><td>no</tbody><tbody hidden><tr><td>no</tbody><tr><td>yes</table>": "yes",
    "<style>td.x{display:none} tr#y{visibility:collapse}</style><table><tr><td class=x>no<td>a<tr id=y><td>no</table>": "a",
    "<details><summary>more</summary>no</details><details open><summary>s</summary>yes</details>": "more\ns\nyes",
    "<ol start='--5'><li>a</ol><ol start=-2><li>b</ol><ol start=' +7x'><li>c</ol>": "1. a\n\n-2. b\n\n7. c",
    f"<ol start={'9' * 5000}><li>a</ol>": f"{2**31 - 1}. a",
    f"<table><tr><td colspan={'9' * 5000}>a<td rowspan={'1' * 5000}>b<tr><td>c</table>": "a  b\nc",
    "<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3</table>": "r  1\n   2\n   3",
    "<table><tr><td>a<td colspan=3>b<td>c<tr><td>dd<td>e</table>": "a   b  c\ndd  e",
    "<style>@media print{.a{display:none}} .b{display:none}/* .c{display:none}</style><p class=a>no<p class=b>no<p class=c>yes": "yes",
    "<div>" * 119 + "a" + "</div>" * 119 + "b": "a\nb",
    "<div>" * 121 + "a" + "</div>" * 121 + "b": "a\nb",
    "<!doctype html><html><head><title>no</title></head><body>x": "x",
}


@pytest.mark.parametrize("page", PAGES)
def test_rendering(page):
    assert html_render.render(page) == PAGES[page]


def test_all_visible_text_of_pages(spark, sf):
    from html.parser import HTMLParser

    class Naive(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_render.extract(pages).collect()}
    assert got.keys() == want.keys()
    for i, source in want.items():
        naive = Naive()
        naive.feed(source)
        letters = lambda t: "".join(t.split()).replace("-", "")  # noqa: E731  list marks aside
        assert letters(got[i]) == letters("".join(naive.out))


@pytest.mark.parametrize("page, text", [
    ('<div class="a"">Hello <a href="x">there</a></div>', "Hello there"), ("<p title=it's>text</p> it's", "text\n\nit's"), ('a <img alt=5"> text "b"', 'a text "b"'),
    ('<p a"hidden>x "y"', 'x "y"'), ('<p x = "a>b">c', "c"), ("<p hidden = ''>no</p>yes", "yes"), ('<p ="a>b"', 'b"'), ('<a href=x="y>z">t', 'z">t'), ('<a href=http://u/v/>w</a>', "w"),
])
def test_quotes_open_values_only_after_an_equals_sign(page, text):
    assert html_render.render(page) == text


def test_mutated_pages_never_raise(spark, sf):
    rng = np.random.default_rng(9)
    own = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(20).collect()] + [p for p in PAGES if len(p) < 3000]
    bits = [x for p in own for x in re.findall(r"<[^>]*>|[^<]+", p)] + ["<", ">", "'", '"', "</", "<!--", "--", "&#", "&#x110000;", "&#99999999999;", "{", "}", "/*", "\x00", "<td", " colspan=-1 ", " rowspan=65535", "<svg", "<![CDATA["]
    for _ in range(600):
        page = "".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(1, 80))))
        cut = sorted(rng.integers(0, len(page) + 1, 2))
        assert isinstance(html_render.render(page), str) and isinstance(html_render.render(page[cut[0] : cut[1]]), str)


def test_hostile_pages_take_time_in_proportion():
    import time

    for page in (
        "<table>" + "<tr>" + "<td rowspan=1000 colspan=1000>x" * 3, "<table>" + "<td colspan=1000 rowspan=9999>" * 5000 + "<tr><td>" * 5000, "<style>" + "a" * 200_000 + "</style>b", "<style>" + "/*" * 100_000,
        "<style>" + "a{" * 100_000, "<!--" * 50_000, "<a " + "b=' " * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<textarea>" * 20_000, "&" * 200_000, "<p>x" * 20_000 + " long" * 100_000,
    ):
        began = time.process_time()
        html_render.render(page)
        assert time.process_time() - began < 4, page[:40]


def test_odd_pages(spark):
    odd = spark.createDataFrame([(1, None, "k"), (None, "<p>x", "k"), (2, "", "k"), (2, "", "k"), (3, "<div>" * 5000 + "deep", "k"), (4, "<a b='", "k"), (5, "<table><td>x", "k")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_render.extract(odd).collect()) == [(0, "x"), (1, ""), (2, ""), (2, ""), (3, "deep"), (4, ""), (5, "x")]
    assert html_render.extract(odd.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------


def brute_lines(docs):
    lines = {i: t.split("\n") for i, t in docs.items() if t is not None}
    first, covered = {}, defaultdict(set)
    for i in sorted(lines):
        for p in range(len(lines[i]) - 2):
            w = tuple(lines[i][p : p + 3])
            if any(x.strip(" ") for x in w) and first.setdefault(w, (i, p)) != (i, p):
                covered[i] |= {p, p + 1, p + 2}
    return {i: (len(x), len(covered[i]), "\n".join(y for p, y in enumerate(x) if p not in covered[i])) for i, x in lines.items()}


def test_line_dedup_matches_brute_force(spark, documents, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(documents).collect()}
    assert got == brute_lines(texts) and sum(x[1] for x in got.values())


def test_line_dedup_on_awkward_rows(awkward):
    got = Counter((r["doc_id"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(awkward).collect())
    same = AWKWARD[6][1]
    assert got[None, 0, same] == 1 and got[7, 3, ""] == 1 and got[8, 3, ""] == 2  # the null id comes first
    assert got[9, 4, "x"] == 1 and got[1, 0, None] == 1 and got[2, 0, ""] == 1 and sum(got.values()) == len(AWKWARD)
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_line_dedup_shuffles_texts_without_their_lines(documents):
    plan, joined = line_dedup.dedup_lines(documents)._jdf.queryExecution().optimizedPlan(), []

    def look(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joined.extend(c.schema().simpleString() for c in children)
        for c in children:
            look(c)

    look(plan)
    assert any("text:string" in x for x in joined) and not any("array<string>" in x for x in joined)


# --- 4 ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """id -> smallest id reachable."""
    known = sorted(set(fps.values()))
    parent = {x: x for x in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    low = {}
    for i, f in fps.items():
        low[root(f)] = min(i, low.get(root(f), i))
    return {i: low[root(f)] for i, f in fps.items()}


def test_simhash_matches_brute_force(documents, texts):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_groups(fps)
    assert got == {i: (fps[i], groups[i]) for i in texts} and len(set(groups.values())) < len(groups)


def test_simhash_on_awkward_rows(spark, awkward):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect())
    zero = "0" * 16
    assert got[1, zero, 1] == got[2, zero, 1] == got[3, zero, 1] == got[None, zero, 1] == 1
    same = f"{brute_fingerprint(AWKWARD[6][1]):016x}"
    assert got[8, same, 7] == 2 and got[None, same, 7] == 1 and sum(got.values()) == len(AWKWARD)
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    kept = Counter(r["doc_id"] for r in simhash.keep_one(awkward).collect())
    assert kept == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1, 11: 1, None: 2} and simhash.keep_one(awkward).columns == awkward.columns


def test_keep_one_judges_texts_under_one_id_by_themselves(spark):
    a, b = "some words that stand here for the first text of all", "quite other words of the second text under the same id as before"
    c, d = "a third one that no other text is near to, all alone", "yet another text, the second one of its id, with words of its own"
    docs = spark.createDataFrame([(1, a), (2, b), (2, a), (2, a), (3, c), (3, c), (4, d), (4, c), (5, d), (5, d + " and more said of that at some length so that it is no copy")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted([(1, a), (2, b), (3, c), (4, d), (5, docs.collect()[9]["text"])])
    same = spark.createDataFrame([(1, a), (1, b), (1, c)], "doc_id long, text string")
    assert simhash.keep_one(same).count() == 3


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 63))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(24, 5, replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(1 << 63, size=200)}
    want = brute_groups(dict(enumerate(fps)))
    monkeypatch.setattr(simhash, "MAX_RUN", 10)
    edges = []

    def run(keyed, tier):
        import pyarrow as pa

        keyed.sort()
        cut = len(keyed) // 2
        made = []
        for part in (keyed[:cut], keyed[cut:]):
            t, k, f = (np.array([x[i] for x in part], np.uint64).view(np.int64) for i in range(3))
            made.append(pa.RecordBatch.from_arrays([pa.array(t), pa.array(k), pa.array(f)], ["t", "key", "fp"]))
        return [tuple(r.values()) for b in simhash._runs(iter(made), tier) for r in b.to_pylist()]

    u = lambda x: x % (1 << 64)
    first = run([(t, f & m, f) for f in fps for t, m in enumerate(simhash._block_masks())], 1)
    edges += [(u(a), u(b)) for a, b, over in first if over < 0]
    crowded = {(over, u(a)) for a, _, over in first if over >= 0}
    assert crowded
    second = [(t * 64 + j, f & m, f) for t, f in crowded for j, m in enumerate(simhash._sub_masks(simhash._block_masks()[t]))]
    monkeypatch.setattr(simhash, "MAX_RUN", 1 << 12)
    edges += [(u(a), u(b)) for a, b, _ in run(second, 2)]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    df = spark.createDataFrame([(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in edges], "a long, b long")
    root = {u(r["node"]): r["root"] for r in components.connected_components(df).collect()}
    ours = defaultdict(set)
    for i, f in enumerate(fps):
        ours[root.get(f, ("alone", f))].add(i)
    theirs = defaultdict(set)
    for i, c in want.items():
        theirs[c].add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("batches", [1, 3])
def test_second_tier_links_runs_of_all_its_open_bits(batches):
    import pyarrow as pa

    mask = max((m for t in simhash._block_masks() for m in simhash._sub_masks(t)), key=lambda m: 64 - m.bit_count())
    free = [b for b in range(64) if not mask >> b & 1]
    assert 1 << len(free) == simhash.MAX_SUB_RUN
    fps = np.array([sum(1 << b for i, b in enumerate(free) if n >> i & 1) for n in range(5000)], np.uint64).view(np.int64)
    made = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f), np.int64)), pa.array(np.zeros(len(f), np.int64)), pa.array(f)], ["t", "key", "fp"]) for f in np.array_split(fps, batches)]
    got = [r for b in simhash._runs(iter(made), 2) for r in b.to_pylist()]
    assert all(r["over"] < 0 and r["a"] != r["b"] for r in got) and len(got) == 4999 and {r["b"] for r in got} | {int(fps[0])} == set(fps.tolist())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3), (500, 400), (400, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 400: 400, 500: 400}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------


def brute_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, own = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        own |= {label} if at else set()
    normal, found = " " + "".join(x + " " for x in w), []
    for rank, (level, label, keyword, pattern) in enumerate(rules()):
        for m in re.finditer(pattern, normal) if keyword in normal else ():
            found.append((normal[: m.start()].count(" ") - 1, -(normal[: m.end()].count(" ")), level, rank, label))
    left = [d for d in found if not any(e != d and e[2] <= d[2] and e[0] <= d[0] and e[1] <= d[1] and (e[:2] != d[:2] or e[2:] < d[2:]) for e in found)]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[4] for d in left}))


def test_license_scan_matches_brute_force(spark, documents, awkward, texts):
    extra = [
        (90001, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT license; see LICENSE file. GPL v2 or later, GPL-3.0, lgpl 2.1"),
        (90002, "mit license mit license MIT-License apache  license, version 2.0 cc by-nc-sa 4.0 / CC BY 4.0 creative commons attribution share alike 4.0 all rights reserved"),
        (90003, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:7] for r in license_scan.scan(docs).collect()}
    want = {i: brute_scan(t) for i, t in [*texts.items(), *extra]}
    assert got == want and sum(x[1] > 0 for x in got.values()) > 3
    odd = license_scan.scan(awkward).collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in odd))) == sorted(repr((i, *brute_scan(t))) for i, t, _ in AWKWARD)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in odd) and license_scan.scan(awkward.limit(0)).count() == 0


def test_hundreds_of_rules():
    every = rules()
    assert len(every) > 200 and all(re.compile(p) and k == k.lower() for _, _, k, p in every)


# --- 6 ---------------------------------------------------------------------------------------------------------


def brute_counts(text):
    t = text or ""
    w, seen, dup = words(t), set(), 0
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    often = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    for x in t.split("\n"):
        dup += bool(words(x)) and x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(often)


def test_rule_counts_match_brute_force(texts):
    loops = "a b c d e f g h " * 3 + "x " * 12
    for _, t in [*both(texts), (0, loops), (0, "a b c d e f g h a b c d e f g h i"), (0, "\n\n a\n a\na")]:
        assert weak_rules.features(t)[:5] == brute_counts(t)


def test_weak_rules_on_awkward_rows(awkward, spark, sf, documents):
    got = weak_rules.judge(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert weak_rules.judge(awkward.limit(0)).count() == 0
    judged = {r["doc_id"]: r for r in weak_rules.judge(documents).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [judged[i]["kept"] == (q == 1) for i, q in labels.items() if not judged[i]["base_failed"]]
    assert np.mean(right) > 0.9


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(0)
    truth, acc = rng.random(20_000) < 0.7, np.array([0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((20_000, 4)) < acc, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, found = weak_rules.fit(patterns, counts.astype(float), 0.7)
    assert np.abs(found - acc).max() < 0.03


# --- 7 ---------------------------------------------------------------------------------------------------------


def check_shards(got, n_rows):
    assert len(got) == n_rows
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(sharding.SHARDS))


def test_shards(spark, documents, awkward, texts):
    got = rows(sharding.shard(documents))
    check_shards(got, len(texts))
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert rows(sharding.shard(documents.repartition(5))) and {r["doc_id"]: r["shard"] for r in rows(sharding.shard(documents.repartition(5)))} == {r["doc_id"]: r["shard"] for r in got}
    check_shards(rows(sharding.shard(awkward)), len(AWKWARD))
    assert sharding.shard(awkward.limit(0)).count() == 0


def test_shards_are_even_with_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i * 7919 % 60)) for i in range(12_000)], "doc_id long, text string")
    got = rows(sharding.shard(docs, task_rows=4000))
    check_shards(got, 12_000)
    size, of, text = Counter(), defaultdict(set), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        size[r["shard"]] += r["size"]
        of[text[r["doc_id"]]].add(r["shard"])
    assert max(size.values()) < 1.03 * min(size.values()) and len(of["hot text " * 20]) > 1 and sum(len(s) > 1 for s in of.values()) == 1


def test_pack_is_a_plain_argmax():
    rng = np.random.default_rng(5)
    items, lacks = rng.dirichlet(np.ones(300), 3).T, rng.dirichlet(np.ones(7), 3).T
    left, turn = [list(x) for x in lacks], 3
    want = []
    for item in items:
        best, at = None, None
        for k in range(7):
            s = (k + turn) % 7
            value = sum(w * i * r for w, i, r in zip(sharding.WEIGHTS, item, left[s], strict=True))
            if best is None or value > best + 1e-15:
                best, at = value, s
        want.append(at)
        left[at] = [r - i for r, i in zip(left[at], item, strict=True)]
    assert sharding.pack(items, lacks, turn).tolist() == want


@pytest.mark.parametrize("task_rows", [65_536, 100])
def test_groups_stay_whole_and_shards_even(spark, task_rows):
    """Held against plain counts of sf0.01, 25 documents a shard: every group in one shard (none is as large as a shard), shards within 2% of the mean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text, got = {r["doc_id"]: r["text"] for r in docs.collect()}, rows(sharding.shard(docs, task_rows=task_rows))
    check_shards(got, len(text))
    size, of, group = Counter(), defaultdict(set), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        of[text[r["doc_id"]]].add(r["shard"])
        group[text[r["doc_id"]]] += r["size"]
    mean = sum(size.values()) / sharding.SHARDS
    assert max(group.values()) <= mean and {len(x) for x in of.values()} == {1}
    assert max(abs(b - mean) for b in size.values()) <= (0.02 if task_rows > 1000 else 0.05) * mean


def test_shards_are_even_with_few_copies_of_a_long_text(spark):
    long = "long text " * 2000
    docs = spark.createDataFrame([(i, long if i < 15 else f"text {i} " * 18) for i in range(12_000)], "doc_id long, text string")
    got = rows(sharding.shard(docs))
    check_shards(got, 12_000)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.03 * min(size.values())


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_varint_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.choice([0, 8, 16, 24], n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(v), n) == v).all()


def test_token_files_match_the_library(spark, documents, awkward, texts, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text").where("doc_id is not null").selectExpr("-doc_id AS doc_id", "text"))
    token_files.write(docs, str(tmp_path / "out"), queries.tokenizer_path(), block_ids=5000)
    got = sorted(rows(token_files.read(spark, str(tmp_path / "out"), with_ids=True)), key=lambda r: r["start"])
    want = sorted([(i, t) for i, t in texts.items()] + [(-i, x) for i, x, _ in AWKWARD if i is not None], key=lambda x: x[0])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    for r in got:
        own = {tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,) for i, x in want if i == r["doc_id"]}
        assert tuple(r["ids"]) in own and r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]


def test_words_beyond_the_memory():
    texts = ["it's <|endoftext|> A<|startoftext|>b ÉÉ, don't", "é İstanbul 漢字 ß.", "x's 'LL y'm 1,000.5%", " ".join(f"w{i}x" for i in range(300)), "a", "b c"]
    whole = token_files.WordEncoder(queries.tokenizer_path())
    small = token_files.WordEncoder(queries.tokenizer_path(), cache_words=50)
    for t in texts * 2:
        want = whole._whole([t])[0]
        assert whole.encode(t).tobytes() == small.encode(t).tobytes() == want


def test_words_are_encoded_as_whole_texts_are():
    rng = np.random.default_rng(11)
    encoder = token_files.WordEncoder(queries.tokenizer_path())
    bits = ["a", "Ab", "é", "É", "ß", "İ", "ı", "'s", "'", "don't", "...", "!?", "1", "12,5", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", "\u00a0", "\u200d", "\u0301", "漢", "字", "𝒳", "ﬁ", "Ω", "_", "-", "\t", "\r", "\n", "\n\n", " ", "  ", "\ufeff", "\x00", "ñ", "Å", "ǆ"]
    for _ in range(4000):
        t = "".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(0, 14))))
        assert encoder.encode(t).tobytes() == encoder._whole([t])[0], repr(t)


def test_token_files_on_awkward_rows(awkward):
    got = rows(token_files.encode_and_read(awkward, queries.tokenizer_path()))
    assert len(got) == len(AWKWARD) and {r["doc_id"]: r["n_tokens"] for r in got}[2] == 1
    assert token_files.encode_and_read(awkward.limit(0), queries.tokenizer_path()).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_mix(which, request):
    docs = request.getfixturevalue(which)
    got = rows(mixing.mix(docs))
    size = {}
    for r in got:
        assert r["_ls_size"] == len(words(r["text"])) and 0 <= r["_ls_copies"] <= 2
        size[r["source"]] = size.get(r["source"], 0) + r["_ls_size"]
    target, taken = brute_targets(size), Counter()
    for r in got:
        assert r["_ls_target"] == pytest.approx(target[r["source"]]) and r["_ls_source_size"] == size[r["source"]]
        taken[r["source"]] += r["_ls_copies"] * r["_ls_size"]
    if which == "documents":
        assert all(abs(taken[s] - t) <= 0.02 * t + 100 for s, t in target.items())
    again = rows(mixing.mix(docs.repartition(7)))
    key = lambda x: sorted((repr(r["doc_id"]), repr(r["text"]), r["_ls_copies"]) for r in x)
    assert key(got) == key(again)
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(docs).count() == sum(r["_ls_copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sources_of_odd_sizes_come_near_their_targets(spark):
    """Beside long texts: one-word texts alone, a mix of one-word and huge texts, and empty texts alone."""
    docs = [(i, "w " * (300 + i % 200), "a") for i in range(400)] + [(1000 + i, "x", "b") for i in range(300)] + [(2000 + i, "y " * (5000 if i % 50 == 0 else 1), "c") for i in range(300)] + [(3000 + i, "", "d") for i in range(9)]
    got = rows(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), share=1.1))
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["_ls_copies"] * r["_ls_size"]
        target[r["source"]] = r["_ls_target"]
        longest[r["source"]] = max(longest[r["source"]], r["_ls_size"])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())  # copies are whole


def test_rates_are_exponential_tilts(spark):
    sizes = [(s, n) for s in "ab" for n in range(1, 400)]
    cells = spark.createDataFrame([(s, n, 3) for s, n in sizes], "key string, size long, n long")
    total = 3 * sum(range(1, 400))
    goal = spark.createDataFrame([("a", "a", total, 0.4 * total), ("b", "b", total, 1.7 * total)], "key string, source string, source_size long, target double")
    got = defaultdict(list)
    for r in mixing._tilt(cells, goal, 2).collect():
        got[r["key"]].append((r["size"], r["rate"]))
    for key, share in (("a", 0.4), ("b", 1.7)):
        own = sorted(got[key])
        assert sum(3 * s * r for s, r in own) == pytest.approx(share * total, rel=1e-5)
        slopes = [np.log(r) / s for s, r in own if s > 20 and 0 < r < 2]
        assert max(slopes) - min(slopes) < 1e-6


# --- 10 --------------------------------------------------------------------------------------------------------


def test_classifier(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in byte_cnn.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [got[i]["predicted"] == q for i, q in truth.items() if got[i]["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.95
    odd = byte_cnn.classify(awkward, labels).collect()
    assert len(odd) == len(AWKWARD) and byte_cnn.classify(awkward.limit(0), labels).count() == 0
    assert {r["score"] for r in byte_cnn.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert byte_cnn.keep_good(awkward, labels).columns == awkward.columns


def test_one_id_repeated_reaches_the_driver_once(spark):
    docs = spark.range(100_000).selectExpr("CASE WHEN id < 99000 THEN 1 ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'some good text' ELSE 'bad || text' END AS text")
    labels = spark.range(100_000).selectExpr("CASE WHEN id < 50000 THEN 1 ELSE id END AS doc_id", "CAST(id % 2 = 0 AS INT) AS quality")
    seen = []
    fit, byte_cnn.fit = byte_cnn.fit, lambda texts, y: seen.append((texts, y))
    try:
        byte_cnn.train(docs, labels, max_rows=40)
    finally:
        byte_cnn.fit = fit
    texts, y = seen[0]
    assert len(texts) == len(y) == 40 and sum(y) == 20


def test_score_is_that_of_a_plain_convolution():
    net, text = byte_cnn.start(), "Some text, é and more of it. " * 9
    x = byte_cnn._padded(text.encode())
    n = len(x) - byte_cnn.WIDTH + 1
    maps = np.array([sum(net.filters[k, x[p + k]] for k in range(byte_cnn.WIDTH)) for p in range(n)])
    chunks = [maps[s : s + 2 * byte_cnn.HALF].max(0) for s in range(0, n - byte_cnn.HALF, byte_cnn.HALF)]
    z = np.mean([np.maximum(c + net.bias, 0) for c in chunks], 0) @ net.out + net.base[0]
    assert byte_cnn.scores(net, [text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = {r["item_id"]: decontam.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    net = byte_cnn.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for i, (name, stage) in enumerate(pipeline.STAGES):
        old = rows(docs)
        made = stage(spark, docs, sf)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        new = rows(docs)
        ids = [r["doc_id"] for r in new]
        if name == "quality":
            assert sorted(ids) == sorted(r["doc_id"] for r, s in zip(old, byte_cnn.scores(net, [r["text"] for r in old]), strict=True) if s >= 0.7)
        elif name == "near_dedup":
            assert sorted(ids) == sorted(set(brute_groups({r["doc_id"]: brute_fingerprint(r["text"]) for r in old}).values()))
        elif name == "decontaminate":
            plain = [r["doc_id"] for r in old if not any(b" ".join(x) in b" ".join(decontam.tokens(r["text"])) for x in bench.values())]
            assert sorted(ids) == sorted(plain) and len(plain) < len(old)
        elif name == "mix":
            assert set(ids) <= {r["doc_id"] for r in old} and max(Counter(ids).values()) == 2
        else:
            assert sorted(ids) == sorted(r["doc_id"] for r in old)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_operators_give_back_what_others_remember_in_a_worker(spark):
    """The words of a worker that has tokenized stay from task to task, and go where another operator's task begins; so do those of a search."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], ["doc_id", "text"])
    index = SimpleNamespace(masks=["111"], bitmap=None)

    def tokenized():
        return len(list(token_files._tokenized(queries.tokenizer_path(), 2)(iter([batch]))))

    others = (
        lambda: byte_cnn.scorer(byte_cnn.start()).func(pd.Series(["x"])),
        lambda: simhash._fingerprints.func(pd.Series(["x"])),
        lambda: list(decontam._doc_regions(index)(iter([]))),
    )
    for other in others:
        assert tokenized() and token_files._encoder.cache_info().currsize
        words = token_files._encoder(queries.tokenizer_path()).known
        assert tokenized() and token_files._encoder(queries.tokenizer_path()).known is words and "some" in words
        other()
        assert not token_files._encoder.cache_info().currsize
    list(decontam._doc_regions(index)(iter([])))
    decontam.token_hashes("some words")
    assert decontam._names and tokenized() and not decontam._names


def test_pipeline_stages_on_awkward_rows(spark, sf, awkward):
    """Each stage on nulls, empty and very long texts, repeated rows and clashing columns, and on no rows."""
    import corpus_pipeline as pipeline

    kept = {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, awkward, sf)
        kept[name] = Counter((r["doc_id"], r["text"]) for r in made.collect()) if name != "tokenize" else Counter(r["doc_id"] for r in made.collect())
        assert stage(spark, awkward.limit(0), sf).count() == 0
        assert name == "tokenize" or made.columns == awkward.columns
    every = Counter((i, t) for i, t, _ in AWKWARD)
    assert kept["decontaminate"] == every and kept["tokenize"] == Counter(i for i, _, _ in AWKWARD)
    assert not kept["quality"] - every and len({kept["quality"][k] for k in every if not k[1]}) == 1  # null and empty texts share a score
    assert kept["near_dedup"][7, AWKWARD[6][1]] == 1 and kept["near_dedup"][8, AWKWARD[6][1]] == 0 and kept["near_dedup"][None, None] == 1
    assert all(n <= 2 * every[k] for k, n in kept["mix"].items()) and kept["mix"][1, None] == kept["mix"][2, ""] == 1


def test_line_dedup_sql_agrees(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(tuple(r) for r in con.sql(line_dedup.SQL).fetchall())
    assert want == sorted(tuple(r) for r in queries.op3_line_windows(spark, sf).collect())
