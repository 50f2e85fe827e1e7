import hashlib
import zlib

import time
from collections import Counter

import numpy as np
from ledgermint.llm import html, media


def test_media_round_trip(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 96), (5, "long text " * 20000), (6, "hello"), (6, "hello")]
    got = media.media_columns(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = by[i]
        assert media.read_wav(bytes(r.media)) == payload and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert by[1].fingerprint == by[6].fingerprint
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_tone_is_a_peak():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    assert {b for _, b in media.peaks(tone).tolist()} == {40}


def test_markup():
    page = '<html><body><nav>menu</nav><div class="sidebar">s</div><article><header><h1>T &amp; x</h1></header><p>One&nbsp; two<p>three <b>four</b><br>five<ul><li>a<li>b</ul><div class="share-buttons">share</div><form>f</form></article><div id="comments"><p>c</p></div><footer>f</footer></body></html>'
    assert html.main_text(page) == "T & x\nOne two\nthree four five\na\nb"
    assert html.main_text("just text &lt;b&gt;") == "just text <b>" and html.main_text("") == "" and html.main_text("<script>x</script>") == ""


def test_templates_of_a_site_go(spark):
    frame = '<html><body><div class="box1"><p>Welcome to our site</p></div><div class="body"><p>Story number {0}</p><p>Unique words {0}</p></div><div class="box2">All rights kept</div></body></html>'
    rows = [(i, f"http://a.example/{i}", frame.format(i), "x") for i in range(8)] + [(100 + i, f"http://b{i}.example/", frame.format(i), "x") for i in range(3)] + [(200, None, None, "x"), (201, "odd", "<p>x</p>", "x")]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3] == "Story number 3\nUnique words 3"
    assert got[101] == "Welcome to our site\nStory number 1\nUnique words 1\nAll rights kept"
    assert got[200] == "" and got[201] == "x"
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><div>Top of site</div><article><p>Same story</p></article></body>"
    rows = [(i, "http://a.example/x", page) for i in range(9)]
    assert {r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same story"}


def site(spark, page, n=8, **options):
    """The texts of `n` pages of one host, `page` formatted with their numbers."""
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(n)]
    return {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_a_wrapper_around_articles_is_no_template(spark):
    page = '<body><div id="page"><div class="top">Top of site</div><div><article><p>Story number {0}</p></article></div></div></body>'
    assert site(spark, page) == {i: f"Story number {i}" for i in range(8)}
    assert set(site(spark, page.replace("{0}", "one")).values()) == {"Story number one"}


def test_boxes_that_recur_inside_articles_go(spark):
    page = '<body><article><p>Story number {0}</p><div class="by"><p>Written by our staff</p></div></article></body>'
    assert site(spark, page) == {i: f"Story number {i}" for i in range(8)}
    same = page.replace("{0}", "one")
    assert set(site(spark, same).values()) == {"Story number one\nWritten by our staff"}
    # copies of one article beside different ones: its own paragraph stays, the box of all goes
    rows = [(i, f"http://a.example/{i}", page.format(i if i < 6 else 6)) for i in range(20)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story number {min(i, 6)}" for i in range(20)}


def test_text_outside_a_region_stays():
    assert html.main_text("<body><div class=content><p>The long story</p></div><article><p>Read this too</p></article></body>") == "The long story\nRead this too"


def test_hints_do_not_take_the_article():
    inner = "<h1>Title</h1><p>Text</p>"
    for page in (
        f'<body class="single no-sidebar"><article>{inner}</article></body>', f'<body class="sidebar"><p>{inner}</body>', f'<div id=content class="has-sidebar">{inner}</div>',
        f'<article class="post comment-open">{inner}</article>', f'<article class="post comment">{inner}</article>', f'<div class="widget"><div class="promo-1"><article>{inner}</article></div></div>',
        f'<div class="widget"><main>{inner}<div class="related"><article>Teaser</article></div></main></div>', f'<main class="alert">{inner}</main><div id="comments"><article class="comment">c</article></div>',
    ):
        assert html.main_text(page) == "Title\nText", page
    assert html.main_text('<div class="box sidebar">s</div><div class="ad-12">a</div><div class="site_footer">f</div><p>Text</p>') == "Text"


def test_every_sample_counts_alike():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 8192, dtype=np.uint8)

    def differ(at):
        changed = base.copy()
        changed[at : at + 8] = (32, 126) * 4
        return media.fingerprint(changed).tolist() != media.fingerprint(base).tolist()

    at_edges, between = (sum(differ(k * 512 + shift) for k in range(1, 15)) for shift in (-4, 28))
    assert at_edges >= 7 and between >= 7


def plain_fingerprint(samples):
    """The fingerprint by its definition: sums over a discrete Fourier transform, and loops over cells."""
    n, frame, hop = -(-len(samples) // media.HOP) + 1, media.FRAME, media.HOP
    x = samples.astype(float)
    at = lambda i: x[(lambda j: j if j < len(x) else 2 * len(x) - 2 - j)(abs(i))]  # noqa: E731  mirrored
    frames = np.array([[at(t * hop - frame // 2 + i) for i in range(frame)] for t in range(n)])
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / frame) for i in range(frame)])
    waves = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2), np.arange(frame)) / frame)
    power = np.abs(((frames - frames.mean(axis=1, keepdims=True)) * window) @ waves.T)
    cells = frame // 2 // media.BINS
    top = {(t, c): max((power[t, b], -b) for b in range(c * media.BINS, (c + 1) * media.BINS)) for t in range(n) for c in range(cells)}
    found = []
    for (t, c), (value, b) in sorted(top.items()):
        around = [top[t + i, c + j][0] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (t + i, c + j) in top]
        if value > max(around) and value > media.RISE * power[t].mean():
            found.append((t, -b))
    pairs = []
    for t, b in found:
        pairs += [(t, b, later, u - t) for u, later in [p for p in found if p[0] > t][: media.FAN]]
    return sorted(pairs)


def test_fingerprint_matches_its_definition():
    rng, some = np.random.default_rng(9), 0
    for n in (192, 384, 960, 3072):
        for words in (3, 40, 400):
            text = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(words)).encode()[:n].ljust(n)
            samples = np.frombuffer(text, np.uint8)
            got = media.fingerprint(samples)
            assert [tuple(r) for r in got.tolist()] == plain_fingerprint(samples)
            assert (got[:, 3] > 0).all()
            some += len(got) > 0
    assert some >= 6


def test_peaks_are_the_largest_of_frames_and_bins(monkeypatch):
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, 60000, dtype=np.uint8)
    got = media.peaks(samples)
    cells = {(t, b // media.BINS) for t, b in got.tolist()}
    assert len(cells) == len(got) > 20
    assert not any((t + i, c + j) in cells for t, c in cells for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert media.peaks(samples).tolist() == got.tolist()
    for n in (0, 1, 2, 191, 255, 256, 257, 513):
        assert media.peaks(samples[:n]).shape[1] == 2


def test_deep_and_long_pages_take_time_in_proportion():
    def seconds(page):
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    shapes = [lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: "<article>x</i>" * n, lambda n: "<a <!" * n, lambda n: "<div class=ad>" * n + "<article>x</article>"]
    for shape in shapes:
        seconds(shape(500))
        assert seconds(shape(40_000)) < 40 * max(seconds(shape(5_000)), 0.01)
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert html.main_text(long) == "\n".join(["word word"] * 50_000)
    assert html.main_text("a<!-- b > c") == "a" and html.main_text("<!-- a --> b > c") == "b > c"


def tree_site(rng):
    """Pages of two hosts as trees (tag, class, children); a string is a text."""
    shared = [("div", f"box{k}", [("p", "", [f"shared words {k}"]), ("div", "in", [f"more {k}"])]) for k in range(6)]
    pages = []
    for i in range(40):
        children = [("p", "", [f"own text {i} {j}"]) for j in range(int(rng.integers(1, 4)))]
        children += [shared[k] for k in np.flatnonzero(rng.random(6) < (0.1, 0.2, 0.3, 0.4, 0.6, 0.9))]
        children += [("div", "wrap", [shared[int(rng.integers(6))], ("p", "", [f"inner {i}"])])]
        rng.shuffle(children)
        pages.append((i, f"http://h{i % 2}.example/{i}", ("body", "", children)))
    return pages


def written(node):
    return node if isinstance(node, str) else f'<{node[0]} class="{node[1]}">{"".join(map(written, node[2]))}</{node[0]}>'


def test_templates_match_brute_force(spark):
    pages = tree_site(np.random.default_rng(11))
    subtrees = lambda node: [] if isinstance(node, str) else [written(node), *[x for c in node[2] for x in subtrees(c)]]
    seen, hosts = Counter(), Counter(url.split("/")[2] for _, url, _ in pages)
    for _, url, tree in pages:
        seen.update((url.split("/")[2], x) for x in set(subtrees(tree)) if not x.startswith("<body"))
    template = lambda host, x: seen[host, x] >= html.MIN_PAGES and seen[host, x] >= html.SHARE * hosts[host]

    def kept(host, node):
        if isinstance(node, str):
            return [node]
        return [] if template(host, written(node)) else [x for c in node[2] for x in kept(host, c)]

    rows = [(i, url, f"<html>{written(tree)}</html>") for i, url, tree in pages]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: "\n".join(kept(url.split("/")[2], tree)) for i, url, tree in pages}
    assert {r.page_id: r.text for r in html.extract_main_text(docs).collect()} == expected
    uncounted = {i: html.main_text(page) for i, _, page in rows}
    assert uncounted != expected and any(template("h0.example", f) for f in {x for _, _, t in pages for x in subtrees(t)})


def test_inline_chrome_goes_and_the_text_around_it_stays():
    for mark in ("<button>Share now</button>", "<select><option>One</option></select>", "<label>Name</label>", "<svg><text>Icon</text></svg>", '<span class="ad">Buy</span>', '<span class="cookie-banner">Cookies</span>', '<a class="nav" href="/">Home</a>', '<b><i class="share">Share</i></b>', "<i hidden>no</i>"):
        assert html.main_text(f"<p>Text {mark}</p>") == "Text" and html.main_text(f"<p>Some {mark} text <b>here</b></p><p>More</p>") == "Some text here\nMore", mark
    assert html.main_text('<p>A <span class="lead">lead</span> and a <a href="/x">link</a>.</p>') == "A lead and a link."


def test_shapes_beside_the_article(spark):
    story = lambda i: " ".join([f"Story number {i}"] * 9)
    article = "<article><p>" + "Story number {0} " * 9 + "</p></article>"
    # text of each page's own stays wherever it stands
    lede = '<body><div class="lede"><p>Unique summary number {0} of this page</p></div><h2 class="x{0}">Only here {0}</h2>' + article + "</body>"
    assert site(spark, lede) == {i: f"Unique summary number {i} of this page\nOnly here {i}\n{story(i)}" for i in range(8)}
    # a menu goes though its entries change and differ in number, as do boxes that take turns
    rows = []
    for i in range(12):
        menu = "".join(f'<li><a href="/{i}/{j}">Entry {i} {j}</a></li>' for j in range(2 + i % 3))
        rows.append((i, f"http://a.example/{i}", f'<body><div><ul>{menu}</ul></div><div class="box"><p>Turn {i % 3}</p></div>{article.format(i)}<div><h1>Title {i}</h1></div></body>'))
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{story(i)}\nTitle {i}" for i in range(12)}
    few = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows[:4], "page_id long, url string, html string")).collect()}
    assert few[1].startswith("Entry 1 0\n")
    # the longer text beside a small region is no template
    teaser = '<body><div class="content"><p><a href="/">' + "The long story {0} " * 9 + "</a></p></div><article><p>Read {0} too</p></article></body>"
    assert site(spark, teaser) == {i: " ".join([f"The long story {i}"] * 9) + f"\nRead {i} too" for i in range(8)}


def test_shapes_match_brute_force(spark):
    """Boxes of random classes, links and words beside articles; counted by their written shape."""
    rng = np.random.default_rng(5)
    kinds = [("div", f"k{'abcdef'[k]}", bool(k % 2), 1 + 2 * (k % 3)) for k in range(6)]
    rows, boxes = [], {}
    for i in range(40):
        own = [(kind, f"word{rng.integers(kind[3]) if rng.random() < 0.8 else i} end") for kind in kinds if rng.random() < 0.6]
        boxes[i] = own
        made = "".join(f'<{t} class="{c}"><p>{f"<a>{w}</a>" if linked else w}</p></{t}>' for (t, c, linked, _), w in own)
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<body>{made}<article><p>{f'story {i} ' * 60}</p></article></body>"))
    gone = set()
    for host in (0, 1):
        pages = [i for i in boxes if i % 2 == host]
        for kind in kinds:
            texts = [w for i in pages for k, w in boxes[i] if k == kind]
            if len(texts) >= html.MIN_PAGES and len(texts) >= html.SHARE * len(pages) and (kind[2] or len(set(texts)) <= html.VARIANTS * len(texts)):
                gone.add((host, kind))
        # a paragraph alone is content too, whatever box it stands in
        seen = Counter(x for i in pages for x in {(k[2], w) for k, w in boxes[i]})
        gone |= {(host, *x) for x, n in seen.items() if n >= html.MIN_PAGES and n >= html.SHARE * len(pages)}
    expected = {i: "\n".join([*(w for k, w in boxes[i] if (i % 2, k) not in gone and (i % 2, k[2], w) not in gone), " ".join([f"story {i}"] * 60)]) for i in boxes}
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_main_text(docs).collect()} == expected
    assert 0 < len(gone) and any("word" in t for t in expected.values())
