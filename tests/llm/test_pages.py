"""Page text and WARC archives on small tables."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from cubewright.llm import pagediff, warc

PAGES = "page_id long, url string, html string, host string, path string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", None, "k") for r in rows], PAGES)


def test_blocks_and_chrome():
    html = """<!doctype html><title>t</title><script>var a="<p>no</p>";</script><nav>menu</nav><div class="cookie-notice">notice</div>
    <article><header><h1>Head &amp; <b>line</b></h1></header><p>One\n  two<br>three<p>Four &lt;x&gt; &#233;<ul><li>a<li>b</ul><aside>side</aside><div class="comments">said</div><form>f</form><pre>code  x</pre></article><footer>&copy; f</footer>"""
    assert pagediff.main_text(pagediff.blocks(html), None) == "Head & line\nOne two three\nFour <x> é\na\nb\ncode x"


@pytest.mark.parametrize("section", ["<![foo[x]]>", "<![ x >", "<![if x]>", "<![CDATA[x]]>", "<![>"])
def test_unknown_sections_lose_nothing_after(section):
    assert [b[0] for b in pagediff.blocks(f"<p>a</p>{section}<p>b</p>")] == ["a", "b"]


def texts_of(html):
    return pagediff.main_text(pagediff.blocks(html), None).split("\n")


def test_html_without_end_tags_and_with_self_closed_ones():
    assert texts_of("<html><head><title>t</title><meta charset=x><body><p>a<p>b") == ["a", "b"]
    assert texts_of("<head><style>p{}</style><article><p>a</article>") == ["a"]
    assert texts_of('<article><p>a <svg/> b</p><p>c <svg width="1"><path d=""/><g/></svg> d</p><math/><p>e</p></article>') == ["a b", "c d", "e"]
    assert texts_of("<article><p>a</p><div/><p>b</p></article>") == ["a", "b"]


@pytest.mark.parametrize("name", ["related-work", "side-effects", "share-price", "search-results-of-the-study", "notice-period", "commentary", "adsorption", "header-files"])
def test_article_parts_stay(name):
    assert texts_of(f'<article><p>a</p><section id="{name}"><p>b</p></section><div class="{name}">c</div></article>') == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "nav_item", "related-posts", "share-buttons", "sidebar2", "comments", "site-footer", "newsletter-signup", "breadcrumbs", "widget-area"])
def test_marked_chrome_goes(name):
    assert texts_of(f'<article><p>a</p><div class="x {name}"><p>b</p></div></article>') == ["a"]


def brute_extract(rows):
    """Every page against every other of its host: the longest common path prefix,
    the page before (by path, id and url) where as near; all blocks by plain LCS tables."""
    import re

    def parts(url):
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", url or "")
        return (m[2].lower(), m[3]) if m else ("", re.match(r"[^?#]*", url or "")[0])

    order = sorted(rows, key=lambda r: (*parts(r[1]), r[0], r[1]))
    out = []
    for i, (page_id, url, html) in enumerate(order):
        host, path = parts(url)
        others = [(len(os.path.commonprefix([path, parts(u)[1]])), -abs(j - i), j < i, pagediff.blocks(h)) for j, (_, u, h) in enumerate(order) if j != i and host and parts(u)[0] == host]
        mine = pagediff.blocks(html)
        if others:
            near = max(others, key=lambda x: x[:3])[3]
            a, b = [x[0] for x in mine], [x[0] for x in near]
            n = brute_lcs(a, b)
            # A block is deleted for sure if no longest alignment can do without it.
            sure = {k for k in range(len(a)) if brute_lcs(a[:k] + a[k + 1 :], b) < n}
            if n == len(a):
                sure = set()
        else:
            n, sure = 0, set()
        out.append((page_id, mine, n, sure))
    return out


def test_pages_against_brute_force(spark):
    rng = random.Random(12)
    shells = [["Home", "About us", "News"], ["Home", "Shop", "Basket", "Help"]]
    rows = []
    for i in range(90):
        menu, foot = shells[i % 7 == 3], f"Section {i // 9}"
        own = [f"<p>{rng.choice('abcdef')} {rng.randrange(6)}</p>" if rng.random() < 0.4 else f"<div>unique {i} {k}</div>" for k in range(rng.randrange(5))]
        body = "".join(f"<div>{m}</div>" for m in menu) + "".join(own) + f"<div>{foot}</div><div class='ad'>ad {i}</div>"
        if i % 11 == 5:
            body = f"<nav>n {i}</nav><article>{''.join(own)}</article>" + body
        rows.append((i, f"https://{rng.choice(['hot', 'hot', 'hot', 'b', 'c'])}.example/{rng.choice('xy')}/{i // 9}/{rng.randrange(1000)}", body))
    got = {r["page_id"]: r for r in pagediff.extract(pages(spark, rows)).collect()}
    for page_id, mine, n, sure in brute_extract(rows):
        r, held = got[page_id], any(article and not chrome for _, chrome, article, _ in mine)
        kept, prose = r["text"].split("\n") if r["text"] else [], [article and p and not chrome for _, chrome, article, p in mine]
        chrome = sum(c or held and not a for _, c, a, _ in mine)
        assert r["n_shared"] + r["n_chrome"] + len(kept) == len(mine)
        if not held:
            assert r["n_shared"] == (0 if n == len(mine) else n)
            rest = iter(t for k, (t, c, _, _) in enumerate(mine) if not c and k not in sure)
            assert all(t in rest for t in kept)
        else:
            assert kept == [t for (t, c, a, _), p in zip(mine, prose) if p or a and not c and t in kept] and r["n_chrome"] <= chrome
    assert sum(r["n_shared"] for r in got.values()) > 200


def test_shared_lines_go(spark):
    shell = lambda body: f"<body><div>Site name</div><div>Home About</div>{body}<div>All rights reserved</div></body>"
    rows = [(i, f"https://h.example/a/{i:02d}?x=1", shell(f"<p>Own text {i}</p><p>More {i}</p>")) for i in range(6)]
    rows += [(10, "https://other.example/", shell("<p>alone</p>")), (11, None, "<p>no url</p>"), (12, "x", None), (12, "x", None), (13, "https://h2.example/1", "<article><p>Same.</p><p>Mine</p></article>"), (14, "https://h2.example/2", "<article><p>Same.</p><p>Yours</p></article>"), (15, "https://h3.example/", "<p>" + "word " * 40_000)]
    got = {r["page_id"]: r for r in pagediff.extract(pages(spark, rows).coalesce(1)).collect()}
    assert all(got[i]["text"] == f"Own text {i}\nMore {i}" for i in range(6))
    assert got[10]["text"] == "Site name\nHome About\nalone\nAll rights reserved" and got[11]["text"] == "no url" and got[12]["text"] == ""
    assert got[13]["text"] == "Same.\nMine" and got[14]["text"] == "Same.\nYours" and got[15]["n_chars"] == 40_000 * 5 - 1
    assert pagediff.extract(pages(spark, rows)).count() == len(rows) and pagediff.extract(pages(spark, rows).limit(0)).count() == 0


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        same = sorted(pagediff.shared(a, b))
        assert len(same) == brute_lcs(a, b)
        at = iter(b)
        assert all(x in at for x in (a[i] for i in same))


def test_alignment_is_longest_at_size():
    """What was aligned by runs beyond 4,000,000 pairs: a long run that only crosses the longest."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(1500)]
    a, b = words + [f"r{i}" for i in range(700)], [f"r{i}" for i in range(700)] + [w for x in words for w in (x, *([x] if rng.random() < 0.4 else []))]
    assert len(a) * len(b) > 4_000_000 and len(pagediff.shared(a, b)) == brute_lcs(a, b) == 1500
    same = [rng.choice("xyz") for _ in range(2500)], [rng.choice("xyz") for _ in range(2500)]
    assert len(pagediff.shared(*same)) == brute_lcs(*same)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_do_not_depend_on_partitions(spark, parts):
    """One hot host over many ranges; repeated keys, and hosts of one and two pages."""
    body = lambda i: f"<div>Site</div><div>Menu {i // 2}</div><p>Own {i}</p>"
    rows = [(i, f"https://hot.example/{i // 3:03d}", body(i)) for i in range(60)] + [(90, "https://a.example/", body(90)), (91, "https://z.example/1", body(91)), (92, "https://z.example/2", body(92)), (20, "https://hot.example/006", body(20)), (20, "https://hot.example/006", body(7)), (93, None, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((r["page_id"], r["text"]) for r in pagediff.extract(pages(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = sorted(rows[:60], key=lambda r: (r[1], r[0]))
    assert len(got) == len(rows) and len(got) - len({i for i, _ in got}) == 2
    for (i, *_), (before, *_) in zip(by[1:], by):
        near = [k for k in (i - 1, i + 1) if k // 3 == i // 3] if i // 3 != 6 else []
        if near and i not in (20, 21):  # page 20 stands there three times; the first of two as near is compared
            text = [t for k, t in got if k == i]
            assert text == [f"Own {i}" if near[0] // 2 == i // 2 else f"Menu {i // 2}\nOwn {i}"]
    assert (0, "Own 0") in got and (91, "Menu 45\nOwn 91") in got and (90, "Site\nMenu 45\nOwn 90") in got


def test_round_trip(spark):
    inner = warc.record(7, "u", b"nested", warc.digest(b"nested"), 6, None)
    rows = [(3, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (4, "http://a/3", None), (5, "http://a/4", ""), (6, "http://a/\n5", "é" * 50_000), (7, "u", "x\x1f\x8b\x08 WARC/1.1 \r\n\r\n"), (8, "u", "".join(chr(b) for b in inner)), (None, "u", "lost")]
    rng = random.Random(1)
    rows += [(100 + i, "http://b/", "".join(rng.choice("abcé<>\n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    table = pages(spark, rows)
    html = {i: h or "" for i, _, h in rows}
    for split in (warc.SPLIT, 701, 64):
        got = warc.round_trip(table.repartition(3), split=split).collect()
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
        for r in got:
            payload = html[r["page_id"]].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            first = min((i for i, h in html.items() if i is not None and h.encode() == payload), default=None)
            if r["page_id"] == first or first is None:
                assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
            else:
                assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first, None)
    small = warc.revisits(table, min_bytes=5).where("refers_to IS NOT NULL").count()
    assert small == 0
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archives_are_plain_warc(spark):
    files = warc.write(pages(spark, [(1, "http://a", "one"), (2, "http://b", "two")]).coalesce(1), warc.new_path(spark, "warc")).collect()
    path = files[0]["path"].removeprefix("file:").replace("///", "/")
    data = gzip.open(path).read()
    assert data.count(b"WARC/1.1\r\n") == 2 and os.path.getsize(path) == files[0]["n_bytes"]


@pytest.mark.parametrize("cut", [1, 40])
def test_damaged_members_are_passed_over(tmp_path, cut):
    records = [warc.record(i, "u", p := bytes([97 + i]) * 200, warc.digest(p), 200, None) for i in range(5)]
    data = records[0] + records[1][:-cut] + records[2] + b"junk" + records[3] + records[4]
    (tmp_path / "x.gz").write_bytes(data)
    assert [r[0] for r in warc.read_range(str(tmp_path / "x.gz"), 0, len(data))][-2:] == [3, 4]


def test_one_response_for_each_payload(spark):
    """Rows that repeat the smallest page_id, with other urls and as entire rows."""
    rows = [(1, "http://b", "same"), (1, "http://a", "same"), (2, "http://a", "same"), (1, "http://a", "same"), (1, None, "other"), (1, None, "other"), (None, "u", "other"), (None, "u", "lone"), (None, "u", "lone"), (3, "x", ""), (3, "x", None)]
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, [
        (1, "http://a", "response", None, 4), (1, "http://a", "revisit", 1, 4), (1, "http://b", "revisit", 1, 4), (2, "http://a", "revisit", 1, 4),
        (1, "", "response", None, 5), (1, "", "revisit", 1, 5), (None, "u", "revisit", 1, 5), (None, "u", "response", None, 4), (None, "u", "response", None, 4),
        (3, "x", "response", None, 0), (3, "x", "revisit", 3, 0),
    ]))


def test_a_payload_that_differs_from_its_header_is_told(tmp_path):
    (tmp_path / "x.gz").write_bytes(data := warc.record(1, "u", b"abc", warc.digest(b"abd"), 3, None))
    with pytest.raises(ValueError, match="byte 0"):
        list(warc.read_range(str(tmp_path / "x.gz"), 0, len(data)))
