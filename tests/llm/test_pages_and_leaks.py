import re

import pytest
from pyspark.sql import functions as F

from barweave.llm import decontaminate as D
from barweave.llm import html as H
from barweave.llm import urls as U

# --- urls ---------------------------------------------------------------------------------------------------

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, text in RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    if best:
        return host, path, best[1], best[0]
    blocked = any(re.search(r.pattern, f"{host}#{path}") for r in U.PATTERN_RULES)
    return host, path, None, "block" if blocked else "allow"


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7x", "http://xcom/en/", "https://a.example.net/de/88?x", "https://a.example.net/DE/8", "http://casino-win.example.org", "http://notcasino.example.org/", "http://a.com?q=/en/", "http://com/en/", "ftp://u@x.org/es/#f", "http://x.example.de/ads/1", "http://É.com/en/", "http://a.net:80/de/1", "http://x y.com/en/a", "http://a b/c d/ads/", "http://x\ny.com/en/\n7"]


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string, rule string")
    want = {i: brute_url(u) for i, u in enumerate([*URLS, URLS[3]])}
    assert {r["page_id"]: tuple(r)[1:5] for r in U.filter_urls(pages).collect()} == want
    joined = U.filter_urls(pages, literal_rules=0)
    assert {r["page_id"]: tuple(r)[1:5] for r in joined.collect()} == want
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, U.filter_urls(pages).collect()), key=repr)


def test_many_rules(spark):
    """20,000 host rules and one without a literal: more than any plan holds."""
    rules = tuple(U.host_rule("block", f"site{i}.example/") for i in range(20_000))
    odd = U.Rule("block", "zz", ())
    pages = spark.createDataFrame([(i, f"http://www.site{i * 7}.example/{'zz' if i == 9 else ''}") for i in range(5000)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["n_candidates"]) for r in U.filter_urls(pages, rules, (odd,)).collect()}
    want = {i: (f"site{i * 7}.example/", "block", 2) if i * 7 < 20_000 else (None, "allow", 1) for i in range(5000)}
    assert got == want


def test_urls_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:5] for r in U.filter_urls(pages).collect()}
    assert got == {r["page_id"]: brute_url(r["url"]) for r in pages.collect()}
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://{'casino-' if i == 0 else ''}win.com/") for i in range(5)], "page_id long, url string")
    rule = U.host_words("casino", "win")
    assert U.rarest_tokens(U.url_parts(pages, "page_id", "url"), (rule,)) == ["casino"]
    fetched = {r["page_id"]: r["n_candidates"] for r in U.filter_urls(pages, (), (rule,)).collect()}
    assert fetched == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}


# --- pages --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, blocks",
    [
        (None, []),
        ("", []),
        ("<p>a<p>b", ["a", "b"]),
        ("x &amp; y &#233;&nbsp;z", ["x & y é\xa0z"]),
        ("<div>a<script>if(a<b){}</script>b</div>", ["ab"]),
        ("<nav>menu</nav><main><header><h1>T</h1></header><p>a<br>b</p><div class='comments'>no</div><aside>x</aside></main><footer>f</footer>", ["T", "a b"]),
        ("<article><p>in <b>bold</b> text</p><form>q</form><div class=\"ad\">buy</div></article><p>out</p>", ["in bold text"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<div id='cookie-notice'>c</div><p>ok</p><!-- gone --><style>p{}</style>", ["ok"]),
        ("<p>a &lt; b</p><p>cut <b", ["a < b", "cut"]),
    ],
)
def test_blocks(page, blocks):
    assert H.main_blocks(page) == blocks


def test_markup_words_do_not_delete_content():
    assert H.main_blocks('<article><h1>T</h1><div class="related-work"><p>content</p></div><section id="search"><p>On search</p></section></article>') == ["T", "content", "On search"]
    assert H.main_blocks('<article><div class="post-header"><h1>T</h1></div><p>one</p><div id="comments">I agree</div><ul class="comment-list"><li>me too</li></ul></article>') == ["T", "one"]
    assert H.main_blocks("<article>Teaser</article><div>main story</div>") == ["Teaser", "main story"]
    assert H.main_blocks('<article><p>one</p><div class="related-posts">x</div><div data-id="ad">two</div><p style="display: none">y</p></article>') == ["one", "two"]


def test_readers_comments_go_and_topics_stay():
    assert H.main_blocks('<main><p>Hello</p><section id="comments"><p>I agree</p></section></main>') == ["Hello"]
    assert H.main_blocks('<p>story</p><div class="user-comments"><p>bob: nice</p></div>') == ["story"]
    assert H.main_blocks('<article><h1 class="legal">T</h1><p class="legal">about law</p><div class="legal">terms</div><p class="ad">buy</p></article><p class="legal">terms</p>') == ["T", "about law"]


def hosts(spark):
    """A host with an unnamed notice in its articles and a story in an unnamed box, one without articles, small hosts,
    and one whose pages are copies and near copies."""
    article = "<nav>m{i}</nav><article><h1>Title</h1><div class='x'><p>Same notice on all pages</p></div><div class='x'><p>Story {i} of its own</p></div><p>All pages say this</p></article>"
    boxes = "<div class='box'>Same words on all pages</div><div class='body'>Story number {i} of its own</div>"
    rows = [(i, f"http://h.example/{i}", article.format(i=i)) for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", boxes.format(i=i)) for i in range(8)]
    rows += [(200 + i, f"http://g{i}.example/", boxes.format(i=i)) for i in range(3)]
    rows += [(300 + i, f"http://c.example/{i}", f"<article><h1>Title {i % 2}</h1><div><p>One story, copied often</p></div></article>") for i in range(40)]
    rows += [(400 + i, f"http://n.example/{i}", f"<article><h1>Title {i}</h1><div><p>One story, copied often</p></div></article>") for i in range(40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_style_tree_removes_template_wherever_it_stands(spark):
    pages = hosts(spark)
    got = {r["page_id"]: r["text"].split("\n\n") for r in H.extract_main_text(pages).collect()}
    for i in range(8):
        assert got[i] == ["Title", f"Story {i} of its own", "All pages say this"]
        assert got[100 + i] == [f"Story number {i} of its own"]
    for i in range(3):  # one page of a host shows nothing
        assert got[200 + i] == ["Same words on all pages", f"Story number {i} of its own"]
    for i in range(40):  # two different pages show nothing; where only titles would be left, nothing is template
        assert got[300 + i] == [f"Title {i % 2}", "One story, copied often"]
        assert got[400 + i] == [f"Title {i}", "One story, copied often"]
    without = {r["page_id"]: r["text"].split("\n\n") for r in H.extract_main_text(pages, importance=0.0).collect()}
    assert {i for i in got if got[i] != without[i]} == {*range(8), *range(100, 108)}


def test_style_tree_against_brute_force(spark):
    """Entropies from plain lists of (page, content, presentation) for each node."""
    import math
    from collections import Counter, defaultdict

    pages = hosts(spark)
    seen = defaultdict(set)
    for r in pages.collect():
        page = H.parse(r["html"])
        for at in range(1, len(page.name)):
            seen[re.search("://([^/]*)", r["url"])[1], page.name[at] - (1 << 63)].add((page.content[0], page.content[at], page.style[at]))
    got = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in H.style_tree(pages).collect()}
    assert got and set(got) <= set(seen)

    def entropy(values):
        m = len(values)
        return -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(max(m, 2)) if m > 1 else 1.0

    for key, (m, importance) in got.items():
        rows = list(seen[key])
        assert m == len(rows)
        assert abs(importance - 0.9 * entropy([r[1] for r in rows]) - 0.1 * entropy([r[2] for r in rows])) < 1e-9


def plain_article(page):
    """The blocks of the article of a page of the test tables, by the parser of the standard library."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag == "br":
                self.out[-1] += " "
            elif tag in ("p", "h1", "article"):
                self.out.append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1", "article"):
                self.out.append("")

        def handle_data(self, data):
            if self.inside:
                self.out[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    blocks = [re.sub("[ \t\n\r\f\v]+", " ", b).strip(" \t\n\r\f\v") for b in reader.out]
    return "\n\n".join(b for b in blocks if b)


def test_pages_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in H.extract_main_text(pages).collect()} == want
    assert H.style_tree(pages).count() > 100


@pytest.mark.parametrize("piece", ["<a ", '<a ="', "<b>x</i>", "<div><b>", "<div>x", "<li><p>", "<p><span class=ad>", "<!-- ", "</title ", "<title></title ", "&#", "<td>", "<a b='", "</"])
def test_long_pages_take_linear_time(piece):
    import time

    began = time.time()
    H.main_blocks("<i><article>" + piece * (300_000 // len(piece)))
    assert time.time() - began < 5


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, None, "<p>a</p>"), (2, "http://x/", None), (None, "http://x/", "<p>b"), (3, "u", "<p>c"), (3, "u", "<p>c")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_main_text(pages).collect()), key=repr)
    assert got == sorted([(1, "a", 1), (2, "", 0), (None, "b", 1), (3, "c", 1), (3, "c", 1)], key=repr)
    assert H.extract_main_text(pages.limit(0)).count() == 0


# --- leaks --------------------------------------------------------------------------------------------------


def norm(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words):
    k = min(5, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def weighted(a, b):
    keys = set(a) | set(b)
    return sum(min(a.count(k), b.count(k)) for k in keys) / sum(max(a.count(k), b.count(k)) for k in keys)


def brute_leaks(docs, items, least=0.8):
    """Every window of every document against every item; windows with too few of an item's shingles are passed over."""
    from bisect import bisect_left

    out = {}
    targets = [(i, shingles(norm(t)), len(norm(t))) for i, t in items if norm(t)]
    for d, text in docs:
        words = norm(text)
        grams = {}
        for i, target, n in targets:
            k = len(target[0])
            size = min(n, len(words))
            if size < k:
                continue
            if k not in grams:
                grams[k] = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
            own, w = set(target), size - k + 1
            hits = [p for p, g in enumerate(grams[k]) if g in own]
            best = 0
            for s in range(len(grams[k]) - w + 1) if hits else ():
                have = bisect_left(hits, s + w) - bisect_left(hits, s)
                if have >= best * max(w, len(target)) and have:
                    best = max(best, weighted(grams[k][s : s + w], target))
            if best >= least:
                out[d, i] = max(out.get((d, i), 0), round(best, 9))
    return out


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"


def test_leaks_against_brute_force(spark):
    words = ITEM.split()
    edited = " ".join([*words[:2], "CHANGED", *words[3:]])
    docs = [(1, f"before {ITEM} after"), (2, f"x {edited.upper()}, y"), (3, " ".join(words[:15])), (4, None), (5, ""), (6, f"{ITEM} {ITEM}"), (7, "short item"), (8, "a short item here"), (8, "a short item here"), (None, ITEM)]
    docs += [(9, " ".join(words[1:])), (10, " ".join(words[:-2])), (11, " ".join(words[17:] + words[:17])), (12, "none"), (12, f"of the same id {ITEM}"), (None, "no leak"), (13, "word " * 3000 + ITEM), (14, "4 4 4 4 4 4 4"), (15, "7 " * 50)]
    items = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, "4 4 4 4 4 4 4 4"), (6, ITEM), (6, ITEM), (None, "seven of the words that no document has"), (7, "a a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("key", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("shelf", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.contaminated(d, b).collect()}
    assert got == brute_leaks(docs, items) and {(9, 1), (10, 1), (12, 1)} <= set(got)
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_similarity_of_repeated_shingles(spark):
    import random
    from collections import Counter

    from barweave.llm.decontaminate import similarity

    rng = random.Random(3)
    rows = [([rng.randrange(-k, k + 1) for _ in range(rng.randint(1, 30))], [rng.randrange(-k, k + 1) for _ in range(rng.randint(1, 30))]) for k in (1, 3, 10, 1000) for _ in range(40)]
    rows += [([5] * 40, [5] * 30), ([1], [2])]
    for r in spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", similarity("a", "b").alias("s")).collect():
        x, y = Counter(r["a"]), Counter(r["b"])
        assert r["s"] == sum((x & y).values()) / sum((x | y).values())


def test_swapped_halves_are_found(spark):
    """The window over both halves has 52 of 60 shingles of the item, and no alignment of a shared shingle gives it."""
    import random

    random.seed(5)
    item = [f"w{random.randrange(10**6)}" for _ in range(64)]
    text = ["x"] * 50 + item[32:] + item[:32] + ["y"] * 50
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r["start"], r["n_words"], round(r["similarity"], 3)) for r in D.contaminated(docs, b).collect()] == [(50, 64, round(56 / 64, 3))]


def test_leaks_on_the_table(spark):
    """All windows of the table by brute force; and edited, swapped and cut items: recall and no false positive."""
    import random

    random.seed(9)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    plain = [(r["item_id"], r["text"]) for r in items.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    filler = norm(" ".join(t for _, t in rows[:20]))
    for _ in range(900):
        words = norm(random.choice(plain)[1])
        for _ in range(random.choice((0, 1, 1, 2))):
            words[random.randrange(len(words))] = random.choice(filler)
        if random.random() < 0.15:
            cut = random.randrange(len(words))
            words = words[cut:] + words[:cut]
        words = words[random.randrange(3) : len(words) - random.randrange(3)]
        at = random.randrange(len(filler) - 100)
        around = random.random() < 0.7
        rows.append((10_000 + len(rows), " ".join(filler[at : at + 30] * around + words + filler[at + 30 : at + 60] * around)))
    want = brute_leaks(rows, plain)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    print("recall", len(got), "of", len(want))
    assert len(want) > 200 and all(x <= want.get(k, 0) + 1e-6 for k, x in got.items()) and len(got) >= 0.98 * len(want)


def test_blocks_meet_within_the_radius():
    import random

    random.seed(1)
    assert sum(D.BLOCK_BITS) == 64
    for _ in range(2000):
        diff = sum(1 << b for b in random.sample(range(64), D.RADIUS))
        at, met = 0, False
        for bits in D.BLOCK_BITS:
            met |= bin((diff >> at) & ((1 << bits) - 1)).count("1") <= D.BLOCK_FLIPS
            at += bits
        assert met
