"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("textvec.llm")
from textvec.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, rank string, sig string"
ROWS = [
    (1, None, "en", None, 0, "x", "y"), (2, "", None, "a", 0, "x", "y"), (3, "one", "en", "a", 3, None, None), (4, "one two three four five six", "en", "a", 9, "x", "y"), (4, "one two three four five six", "en", "a", 9, "x", "y"),
    (5, "ONE two three four five six", "fr", "a", 9, "x", "y"), (None, "alone here", "fr", None, 9, "x", "y"), (6, "  \n\t ", "fr", "b", 9, "x", "y"), (7, "1234 5678", "fr", "b", 9, "x", "y"), (8, "word " * 40_000, "fr", "b", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, num):
    sets = {i: shingles(t, width) for i, t in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutants(n):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, 60)] = f"x{rng.integers(0, 40)}"
        out.append((i, " ".join(words[: rng.integers(52, 61)])))
    return out


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, width, num):
    from textvec.llm.jaccard_join import jaccard_components

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for table in (rows, mutants(320)):
        found = jaccard_components(spark.createDataFrame(table, "doc_id long, text string"), width, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(table, width, num)


@pytest.mark.parametrize("region", [1024, 16])
def test_jaccard_every_link(spark, monkeypatch, region):
    from textvec.llm import jaccard_join as j

    monkeypatch.setattr(j, "REGION", region)
    monkeypatch.setattr(j, "BLOCK", region // 2)
    table = mutants(160) + [(200 + i, t) for i, t in mutants(20)]
    sets, first = {i: shingles(t, 3) for i, t in table}, {}
    for i, _ in table:
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = [tuple(r) for r in j.jaccard_links(df, 3, 80, 100)[1].collect()]
    assert len(want) > 2 * len(reps) and sorted(found) == sorted(want)
    rows = {r.doc_id: (r.component_id, r.n_links) for r in j.jaccard_join(df, 3, 80, 100).collect()}
    whole = brute_components(table, 3, 80)
    assert rows == {i: (whole[i][1], sum(first[sets[i]] in p for p in want)) for i in sets}


def test_word_hashes_of_long_words(spark):
    """Words whose polynomials modulo 2^64 agree for every base are different words."""
    from textvec.llm.jaccard_join import jaccard_components

    x = "a"
    while len(x) < 2048:
        x += x.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, x), (2, x.translate({97: 98, 98: 97})), (3, x.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(df, 3, 90, 100).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_jaccard_parts_lose_no_link():
    """Random sets of all sizes with as many differences as the similarity allows share a cell."""
    from textvec.llm.jaccard_join import Bound

    rng, none = np.random.default_rng(11), np.empty(0, np.uint64)
    bound = Bound(90, 100)
    assert bound.parts and not Bound(80, 100).parts
    for n in [*range(1, 60), *rng.integers(60, 2000, 30).tolist()]:
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for gone in range(0, n + 1):
            new = 100 * (n - gone) // 90 - n
            if new < 0:
                break
            b = np.concatenate((a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)))
            cells = [set(bound.cells(np.unique(s), none, none).tolist()) for s in (a, b)]
            assert cells[0] & cells[1], (n, gone, new)


def test_jaccard_odd(odd):
    from textvec.llm.jaccard_join import jaccard_components

    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd, 3, 90, 100).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 4, 4), (5, 4, 4), (6, 0, 6), (None, 1, None), (8, 1, 8)} <= found
    assert jaccard_components(odd.limit(0)).count() == 0


def test_topk(spark):
    from textvec.llm.block_topk import exact_topk

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(700)] + [(700, None), (701, [None] * 5), (702, [float("nan")] * 5), (703, [float("inf")] * 5), (704, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in exact_topk(df, df.where("vec_id % 100 = 0"), 10, shard_rows=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows[:700]} | {704: np.zeros(5, int)}
    for i in range(0, 700, 100):
        best = sorted(((-int(fine[i] @ v), j) for j, v in fine.items() if j != i))[:10]
        assert got[i] == [(j, -s) for s, j in best]
    assert exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_repeats_and_clashing_columns(spark):
    from textvec.llm.block_topk import exact_topk

    rng = np.random.default_rng(4)
    rows = [(i % 90, [float(x) for x in rng.integers(-1, 2, 3)], "a", "b", "c", "d") for i in range(300)] + [(None, [1.0], "", "", "", "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, part string, score string, rank string").repartition(5)
    for size in (40, 32768):
        got = defaultdict(list)
        for r in exact_topk(df, df.where("vec_id % 10 = 0"), 12, shard_rows=size, query_rows=size).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(range(0, 90, 10))
        for i in got:
            own = 1024 * np.array(min(r[1] for r in rows if r[0] == i))
            best = sorted((-int(1024 * np.array(r[1]) @ own), r[0]) for r in rows if r[0] not in (i, None))[:12]
            assert got[i] == [(j, -s) for s, j in best]


def test_nearest_in_several_shards(spark):
    """Recall on the given vectors, in four full shards."""
    from textvec.llm.graph_ann import nearest

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(set)
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=500).collect():
        got[r.query_id].add(r.vec_id)
    scores = x[ids % 20 == 0] @ x.T
    asked = ids[ids % 20 == 0]
    scores[asked[:, None] == ids] = -np.inf
    hit = sum(len(got[i] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) for i, s in zip(asked.tolist(), scores))
    assert hit / (20 * len(asked)) >= 0.9


def test_nearest(spark):
    from textvec.llm.graph_ann import nearest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=500).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    hit = 0
    for i in range(0, 1500, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(got[i]) & set(np.lexsort((np.arange(1500), -np.round(s, 9)))[:20].tolist()))
    assert set(got) == set(range(0, 1500, 20)) and hit / (75 * 20) >= 0.9


def test_codec(spark, docs, odd):
    from tokenizers import Tokenizer

    from textvec.llm.lexicon_codec import bpe_codec

    text = q.tokenizer_json("byte_bpe_50k.json")
    lib = Tokenizer.from_str(text)
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(["<|endoftext|>a<|endoftext|>", "日本 x", "a\x1cb\x85c\xa0d  ", "it's I'LL 12 ²", "x" * 400])], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(extra), odd):
        found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec(df, text, size=2000).collect()}
        want = set()
        for r in df.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert found == want


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    from textvec.llm.packing import packing

    text = q.tokenizer_json("word_bpe_49k.json")
    lib = Tokenizer.from_str(text)
    for df, most in ((docs, 0.02), (odd.dropDuplicates(["doc_id"]), 1)):
        ids = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.collect()}
        parts, sequences = defaultdict(list), defaultdict(list)
        for r in packing(df, text).collect():
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            parts[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        for spans, end in [(v, len(ids[k])) for k, v in parts.items()] + [(v, None) for v in sequences.values()]:
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert at == end if end else at <= 2048
        sizes = [sum(n for _, n in s) for s in sequences.values()]
        assert set(parts) == set(ids) and sum(2048 - n for n in sizes if n & (n - 1)) <= most * sum(sizes) + 2048
    assert packing(odd.limit(0), text).count() == 0


def test_language(docs, odd):
    from textvec.llm.language_id import language_id

    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language_id(docs).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held) and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id(odd).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 6, 7)) and all(0 <= s <= 1 for _, s in found.values())
    assert language_id(odd.limit(0)).count() == 0


def test_html(spark):
    from textvec.llm.html_wrapper import html_extract

    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>\n two<p>three</p><aside>side</aside><div class='comments'>no</div></article><footer>f</footer></body></html>"
    plain = "<body><div><p>Same words</p></div><div><h2>{0}</h2><p>text {0}</p>{1}</div></body>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), (4, "x://g/1", plain.format("a", "")), (5, "x://g/2", plain.format("b", "<p>more</p>")), (6, "x://g/3", plain.format("c", "<ul><li>1</li><li>2</li></ul>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract(df).collect()}
    assert found == {1: "A & B\n\none two\n\nthree", 2: "", 3: "", 4: "a\n\ntext a", 5: "b\n\ntext b\n\nmore", 6: "c\n\ntext c\n\n1\n\n2"}
    assert html_extract(df.limit(0)).count() == 0


def test_html_articles_use_wrapper(spark):
    from textvec.llm.html_wrapper import html_extract

    page = "<body><nav>News</nav><article><h1>{0}</h1><div>Read also our letter</div><p>text {0}</p></article></body>"
    rows = [(i, f"http://h/{i}", page.format(x)) for i, x in enumerate(("a", "News", "c"))] + [(9, "http://one/1", page.format("d")), (10, "http://same/1", page.format("e")), (11, "http://same/2", page.format("e").replace("News", "Olds"))]
    found = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "{0}\n\nRead also our letter\n\ntext {0}"
    assert found == {0: "a\n\ntext a", 1: "News\n\ntext News", 2: "c\n\ntext c", 9: whole.format("d"), 10: whole.format("e"), 11: whole.format("e")}


def test_html_names_of_boxes():
    from textvec.llm.html_wrapper import main_text

    assert main_text('<div class="page has-sidebar"><article><p>Story</p></article></div>') == "Story"
    assert main_text('<div><p>The story</p></div><article class="comment"><p>hi</p></article>') == "The story"
    assert main_text('<main><div class="share-price-analysis"><p>Shares rose</p></div><p>B</p><div class="site-header cookie-bar">x</div></main>') == "Shares rose\n\nB"


def test_html_unclosed_quotes_are_linear():
    import time

    from textvec.llm.html_wrapper import blocks, main_text

    began = time.process_time()
    for part in ('<a "', "<a '", "<a <", "<p", "<div>", "</p>", "<i><p>"):
        blocks(part * (200_000 // len(part)))
    assert time.process_time() - began < 30
    assert main_text('<p title="a > b">x</p><p title=\'y>z</p>') == "x\n\nz"


def test_html_odd_tables(spark):
    from textvec.llm.html_wrapper import html_extract

    page = "<body><div>Same</div><p>own {0}</p></body>"
    rows = [(1, "h/1", page.format(1), "a"), (1, "h/1", page.format(1), "b"), (None, None, None, None), (2, "h/2", page.format(2), "c"), (3, "long/", "<p>" + "word " * 200_000 + "</p>", "d")]
    out = html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, fixed string"))
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 0), (1, 5), (1, 5), (2, 5), (3, 999_999)]


def test_html_large_pages(spark):
    from textvec.llm.html_wrapper import MOST, fold, blocks, html_extract, main_text, size

    page = "<body><div>Same menu</div>{}<div>Same words</div></body>"
    own = lambda i: "".join(f"<h{1 + (k * i) % 5}>own {i} {k}</h{1 + (k * i) % 5}><{t}>more {i} {k}</{t}>" for k in range(1100) for t in [("p", "pre", "section")[(k * k + i) % 3]])
    varied = lambda i: "".join(f"<{t}>v {i} {k}</{t}>" for k in range(60) for t in [("p", "pre", "section", "h1", "h2", "h3")[hash((i, k)) % 6]])
    rows = [(i, "http://large/", page.format(own(i))) for i in range(2)] + [(9, "http://large/", page.format("<p>short</p>"))] + [(20 + i, "http://varied/", page.format(varied(i))) for i in range(60)]
    assert size(fold(blocks(rows[1][2])[1])) > MOST
    found = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: main_text(html, {"Same menu", "Same words"}) for i, _, html in rows} and found[9] == "short"
    only = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows[:2], "page_id long, url string, html string")).collect()}
    assert only == {i: found[i] for i in (0, 1)}


def test_licenses(odd):
    from textvec.llm.license_scan import TEMPLATES, Scanner, license_scan

    scanner = Scanner(TEMPLATES, 0.8)
    for name, text in TEMPLATES.items():
        assert scanner.scan(f"before\n{text}\nafter")[0] == name and scanner.scan(text) == (name, 1.0, 0)
    assert scanner.scan("nothing of the kind here")[0] is None
    assert license_scan(odd).where("license is not null").count() == 0 and license_scan(odd.limit(0)).count() == 0


def test_license_windows(spark):
    import textwrap

    from textvec.llm.license_scan import FULL, TEMPLATES, Scanner, license_matches

    scanner, filler = Scanner(TEMPLATES, 0.8), "other words of no licence at all, again and again " * 30
    for name, text in TEMPLATES.items():
        for doc, line in ((f"{filler}\n" + textwrap.fill(text, 40, break_long_words=False) + f"\n{filler}", 2), (filler + text + " " + filler, 1)):
            assert (name, 1.0, line) in scanner.every(doc)
    texts = [filler + "\n" + "\n".join(textwrap.fill(t, 80, break_long_words=False) for t in [*FULL.values(), TEMPLATES["MPL-2.0"]]), filler, None]
    found = {(r.doc_id, r.license) for r in license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(0, n) for n in (*FULL, "MPL-2.0", "MIT-notice")}
    for name, text in FULL.items():  # each under its own name, with a word changed and wrapped
        doc = f"{filler}\n" + textwrap.fill(text.replace(" the ", " our ", 1), 72) + f"\n{filler}"
        assert Scanner(TEMPLATES | FULL, 0.8).scan(doc)[0] == name


def test_license_windows_by_brute_force():
    from textvec.llm.license_scan import Scanner, bigrams

    rng = np.random.default_rng(6)
    for _ in range(150):
        template = " ".join(rng.choice(list("abcdef"), 7))
        words = rng.choice(list("abcdefxy"), 40).tolist()
        scanner, own, pairs = Scanner({"t": template}, 0.5), bigrams(template), list(zip(words, words[1:]))
        want = max(2 * len(set(pairs[i:j]) & own) / (len(set(pairs[i:j])) + len(own)) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1))
        best = scanner.window("t", pairs, [i for i, x in enumerate(pairs) if x in own])
        assert (best[0] if best else 0) == (want if want >= 0.5 else 0)


def test_license_windows_of_long_repetitive_texts():
    import time

    from textvec.llm.license_scan import TEMPLATES, Scanner

    scanner, near = Scanner(TEMPLATES, 0.8), TEMPLATES["MPL-2.0"].replace("subject", "bound").replace("file", "page")
    for text in ((near + " ") * 3000, "released under " * 100_000 + TEMPLATES["MIT"], TEMPLATES["GPL-3.0-notice"].replace("free", "own") + " software you can" * 100_000):
        began = time.time()
        scanner.scan(text)
        assert time.time() - began < 10


def test_line_dedup(spark, odd):
    from textvec.llm.line_dedup import line_dedup

    long = "a line that is long enough to be compared by edits, number {}"
    rows = [(1, "short\n" + long.format(1)), (2, "short\n" + long.format(2) + "\nkept on its own, this one here it is"), (3, long.format("x").replace("line", "lane and")), (4, long.format(1).upper() + " "), (5, None), (6, "")]
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == (rows[0][1], 2, 0) and found[2] == ("short\nkept on its own, this one here it is", 3, 1)
    assert found[3][2] == 0 and found[4] == ("", 1, 1) and found[5] == (None, 0, 0) and found[6] == ("", 1, 0)
    out = line_dedup(odd)
    assert out.count() == len(ROWS) and set(odd.columns) < set(out.columns) and line_dedup(odd.limit(0)).count() == 0


def test_ledger(spark, odd, tmp_path):
    from textvec.llm.token_ledger import WORDS, Ledger, count_tokens, revision

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.totals().where(f"tokenizer = '{WORDS}'").collect()}
    assert total() == {}
    assert ledger.commit("one", count_tokens(odd, {})) and not ledger.commit("one", count_tokens(odd, {}))
    assert total()[("a", "en")] == (3, 13) and total()[(None, "en")] == (1, 0)
    part = odd.where("doc_id = 4")
    assert ledger.commit("two", count_tokens(part, {}, -1)) and total()[("a", "en")] == (1, 1)
    ledger.commit("three", revision(odd.where("doc_id = 3"), part, {}))
    assert total()[("a", "en")] == (2, 12) and ledger.batches() == ["one", "three", "two"]
    assert len(ledger._names("totals-")) == 2 and ledger._newest()[2] == {"one", "two", "three"}


def test_ledger_committers(spark, docs, tmp_path):
    """A broken attempt and a retry, two committers of one name, totals that lag, and counts by the library."""
    from tokenizers import Tokenizer

    from textvec.llm.token_ledger import Ledger, count_tokens, negated

    text = q.tokenizer_json("word_bpe_49k.json")
    lib = Tokenizer.from_str(text)
    some = docs.where("doc_id % 4 = 1")
    load = count_tokens(some, {"bpe": text}).cache()
    want = defaultdict(lambda: [0, 0])
    for r in some.collect():
        for name, n in (("words-1", len((r.text or "").encode().split())), ("bpe", len(lib.encode(r.text or "", add_special_tokens=False).ids))):
            cell = want[r.source, r.lang, name]
            cell[0] += 1
            cell[1] += n
    one, two = (Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    boom = load.withColumn("docs", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        one.commit("load", boom)
    assert one.batches() == [] and one.commit("load", load)
    two.batches = lambda: []  # as it was before the other committer came
    assert not two._publish(negated(load), "batch-load") and one.batches() == ["load"]
    found = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in one.totals().collect()}
    assert found == dict(want)
    assert one._publish(negated(load), "batch-late") and one.totals().count() == 0  # no totals name it yet
    one.maintain()
    assert one.totals().count() == 0 and one.commit("again", load) and one.totals().count() == len(want)


def test_language_many_short_texts(spark):
    """Vectors do not depend on how a chunk is cut, and many short texts of many trigrams stay within memory."""
    from textvec.llm import language_id as li

    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 100))) for _ in range(10_000)]
    own, lettered = li.profile(texts[:300])
    single = [li.profile([t])[0][0] for t in texts[:300]]
    assert lettered.all() and np.array_equal(own, np.array(single))
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)] + [(20_000, "plain words of english text", "en")], "doc_id long, text string, lang string")
    found = li.language_id(df).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in found} == {"zh", "en"} and sum(r["count"] for r in found) == 10_001


def test_language_by_brute_force(docs):
    """Prototypes and cosines of every document, trigram by trigram."""
    from textvec.llm import language_id as li

    def vector(text):
        code = [li._fold()[ord(c)] for c in f" {text} "]
        code = [c for i, c in enumerate(code) if c or not i or code[i - 1]]
        rows = li.letter_vectors(np.array(code, np.uint64)).astype(float)
        return sum((np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(rows, rows[1:], rows[2:])), np.zeros(li.DIM))

    rows = docs.where("length(text) < 600").collect()
    vectors = {r.doc_id: vector(r.text or "") for r in rows}
    whole = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            whole[r.lang] = whole.get(r.lang, 0) + vectors[r.doc_id]
    names = sorted(whole)
    unit = np.array([whole[n] / np.linalg.norm(whole[n]) for n in names])
    for r in li.language_id(docs.where("length(text) < 600")).collect():
        if r.lang_pred != "und":
            cosine = unit @ vectors[r.doc_id] / np.linalg.norm(vectors[r.doc_id])
            assert abs(max(0, cosine.max()) - r.score) < 1e-4 and cosine.max() - cosine[names.index(r.lang_pred)] < 1e-5


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    docs = odd
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns
    kept = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert kept == [3, 4, 5, 8, None]  # 5 has lost its one line to 4, of which there is one row left
    assert {r.doc_id for r in p.STAGES[-1][1](spark, docs, "").collect()} == set(kept)
    none = p.language_stage(spark, odd.withColumn("lang", F.lit(None).cast("string")), "").select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in none) == ["3", "4", "4", "5", "8", "None"]  # without labels letterless texts go, too
    rows = [(None, "--", "en"), (None, "words", "en"), (1, "words here", "en"), (1, "99", "en")]
    left = p.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert {(r.doc_id, r.text) for r in left} == {(None, "words"), (1, "words here")}


def test_pipeline_by_brute_force(spark, docs):
    """Survivors of each stage on a whole small table, found by other means."""
    import corpus_pipeline as p

    now = docs
    for (name, stage), next_ in zip(p.STAGES[:3], ("letters", "lines", "groups")):
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF)
        after = {r.doc_id: r.text for r in now.collect()}
        if next_ == "letters":
            assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif next_ == "lines":
            assert set(after) == set(before)
            seen = set()
            for i in sorted(before):
                kept = iter((after[i] or "").split("\n"))
                new = [x for x in (before[i] or "").split("\n") if len(x.strip(" ")) < 20 or not (x.strip(" ").lower() in seen or seen.add(x.strip(" ").lower()))]
                assert set(kept) <= {*new, ""}  # equal lines are gone; those within an edit are held by test_line_dedup
        else:
            whole = brute_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, component) in whole.items() if component == i}
    assert p.run(spark, SF).select("doc_id").distinct().count() == len(after)
