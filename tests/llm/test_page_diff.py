import random

from ledgerloom.llm.page_diff import blocks, common_lines, extract_main_text

SHELL = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
         '<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; me</footer></body></html>')


def text_of(html):
    return [b.text for b in blocks(html) if b.kept]


def test_markup():
    inner = ('<article><h1>A &amp; B&nbsp; c</h1><p><b>Lead<br>in<p>Two\n  lines <i>of</i> x&lt;y</p><div class="comments"><p>me too</p></div>'
             '<aside>side</aside><form><input value="z">go</form><!-- <p>no</p> --><p hidden>apart</p><table><tr><td>1<td>2</table>last</article>')
    assert text_of(SHELL % inner) == ["A & B c", "Lead in", "Two lines of x<y", "apart", "1", "2", "last"]
    assert text_of("<p>a<script>unclosed <p>b") == ["a"] and text_of("plain & simple") == ["plain & simple"]
    assert text_of(None) == text_of("") == text_of("<div class='ad'>x") == []
    assert text_of("<p class=\"leader\">ads in words</p><p>5 < 6</p>") == ["ads in words", "5 < 6"]
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]

    assert text_of('<article><div class="share-price">9.50</div><section id="related-work">R</section><p class="x site-footer">f</p>'
                   '<p>a <span class="ad-slot-2">buy</span>b<i class="comment-list">c</i></p></article>') == ["9.50", "R", "a b"]
    assert text_of('<div class="header">H</div><div class="article-header">Title</div><p>b</p>') == ["Title", "b"]


def test_marked_pages(spark):
    """Menus, footers and doubtful parts of marked articles go by comparison; the texts by a loop over the order."""
    draw = random.Random(3)
    rows = []
    for i in range(40):
        article = "".join(draw.choice(["<p>{0} quoted</p>", '<p class="share-price">{0} price</p>', '<p><a href="x">{0} link</a></p>',
                                       "<p>{0} own %d</p>" % i]).format(draw.choice("abc")) for _ in range(draw.randint(0, 9)))
        page = f"<nav><li>Home<li>{draw.choice('xyz')} news</nav><div>Top notice</div><article>{article}</article><footer>by a link</footer>"
        rows.append((i, f"http://h{i % 2}.org/{i // 2:02d}", page if i % 7 else f"<p>Top notice</p><div>{article}</div>"))
    ordered = sorted(rows, key=lambda r: r[1])
    gone = {r[0]: set() for r in rows}
    for (i, u, a), (j, v, b) in zip(ordered, ordered[1:]):
        if u.split("/")[2] == v.split("/")[2] and a != b:
            x, y = blocks(a), blocks(b)
            for p, q in common_lines([k.key() for k in x], [k.key() for k in y]):
                gone[i].update({p} if x[p].open() else ())
                gone[j].update({q} if y[q].open() else ())
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in extract_main_text(df.repartition(5)).collect()}
    for i, _, h in rows:
        parts = blocks(h)
        assert got[i]["text"] == "\n".join(b.text for k, b in enumerate(parts) if b.kept and k not in gone[i])
        assert got[i]["n_deleted"] == len(gone[i]) and got[i]["n_deleted"] > 0
        assert all(("%s quoted" % c in h) == ("%s quoted" % c in got[i]["text"]) for c in "abc" if i % 7)
        assert got[i]["n_by_markup"] == sum(not b.kept and k not in gone[i] for k, b in enumerate(parts))
    assert any(b.role and b.kept and k in gone[i] for i, _, h in rows for k, b in enumerate(blocks(h)))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_longest_common_lines():
    draw = random.Random(4)
    for _ in range(500):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 30))] for _ in "xy")
        pairs = common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == brute_lcs(a, b)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_neighbours(spark):
    page = "<div><p>Site notice of all pages</p><p>Own text {0} of this page</p><p>Site rules</p></div>"
    rows = [(i, f"http://h.org/a/{i:03d}", page.format(i)) for i in range(12)]
    rows += [(50, "http://other.org/a", page.format(50)), (51, None, page.format(51)), (52, "http://h.org/b", None), (53, "http://z.org/", ""),
             (54, "http://q.org/1", SHELL % "<article><p>Quoted</p><p>Mine</p></article>"), (55, "http://q.org/2", SHELL % "<article><p>Quoted</p><p>Yours</p></article>"),
             (60, "http://c.org/1", page.format(1)), (61, "http://c.org/1", page.format(1)), (None, "x", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' AS host", "1 AS path", "2 AS text")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df.coalesce(1)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Own text {i} of this page" for i in range(12))
    whole = "Site notice of all pages\nOwn text {0} of this page\nSite rules"
    assert got[50] == whole.format(50) and got[51] == whole.format(51) and got[52] == got[53] == ""
    assert got[54] == "Quoted\nMine" and got[55] == "Quoted\nYours" and got[60] == got[61] == whole.format(1)
    assert extract_main_text(df.limit(0)).count() == 0


def test_tasks_do_not_matter(spark):
    """The pages by a loop over their order, against few and many tasks."""
    draw = random.Random(11)
    rows = []
    for i in range(60):
        lines = "".join(f"<p>{draw.choice('abcdefgh')} line</p>" for _ in range(draw.randint(0, 12)))
        rows.append((i, f"http://h{draw.randint(0, 3)}.org/{draw.randint(0, 20):02d}", f"<div>{lines}</div>"))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    gone = {r[0]: set() for r in rows}
    for (i, u, a), (j, v, b) in zip(ordered, ordered[1:]):
        if u.split("/")[2] == v.split("/")[2] and a != b:
            for p, q in common_lines(text_of(a), text_of(b)):
                gone[i].add(p)
                gone[j].add(q)
    wanted = {i: "\n".join(t for k, t in enumerate(text_of(h)) if k not in gone[i]) for i, _, h in rows}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 4, 37, 90):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r["page_id"]: r["text"] for r in extract_main_text(df).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_equal_pages(spark):
    """Copies, in a run and at mirrored paths, are one page: all of them lose what the nearest different pages have."""
    page = "<div><p>Site notice</p><p>Own {0}</p><p>{1}</p></div>"
    rows = [(0, "http://h.org/a", page.format(0, "Top")), *((i, f"http://h.org/b?q={i}", page.format("b", "Top")) for i in range(1, 6)),
            (6, "http://h.org/c", page.format(6, "End")), (7, "http://h.org/m/b", page.format("b", "Top")),
            (8, "http://h.org/m/d", page.format(8, "End")), (9, "http://alone.org/b", page.format("b", "Top")), (10, None, page.format("b", "Top"))]
    wanted = {0: "Own 0", **{i: "Own b" for i in (1, 2, 3, 4, 5, 7)}, 6: "Own 6", 8: "Own 8",
              9: "Site notice\nOwn b\nTop", 10: "Site notice\nOwn b\nTop"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_main_text(df).collect()} == wanted
