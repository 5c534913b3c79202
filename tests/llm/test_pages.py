"""The operators on pages."""

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import html_text, url_filter, warc

PAGES = "page_id long, url string, html string, text string, host string, n string, leaf string, digest string, b string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c", "c", "c") for r in rows], PAGES)


SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="post">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us and more</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for everyone.</div>
{article}
<aside>Something about the author of the page</aside><div id="comments"><p>First! A long reader comment that says a lot about nothing at all.</p></div>
<form><label>Subscribe to our letter</label><input></form><div class="ad">Buy now, a very good offer for you.</div><footer>&copy; 2024 Someone</footer></body></html>"""
BODY = "<h1>The  title</h1><p>One &amp; two&nbsp;three, a paragraph of <b>some</b> length that is text.</p><p>Short.<br>Line<p>Unclosed paragraph with words in it for the reader<ul><li>item one is here</li><li>item two</li></ul>"
TEXT = "The title One & two three, a paragraph of some length that is text. Short. Line Unclosed paragraph with words in it for the reader item one is here item two"


@pytest.mark.parametrize("article", [f"<article>{BODY}</article>", f"<main><div>{BODY}</div></main>", f'<div class="entry-content">{BODY}</div>', f"<div><div>{BODY}</div></div>"])
def test_main_text(article):
    assert html_text.main_text(SHELL.format(article=article)) == TEXT


LONG = "A paragraph of some length that is text for the reader of the page. " * 4
LONG_P = f"<p>{LONG}</p>"
LONG = LONG.strip()


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<div class="content with-sidebar"><article>{LONG_P * 3}</article></div><div class="legal">Copyright 2024.</div>', f"{LONG} {LONG} {LONG}"),
        (f'<div class="no-sidebar">{LONG_P}</div><div>tail</div>', LONG),
        (f'<div class="page sidebar-left"><div>{LONG_P}</div><div class=comments><p>A long comment.</p></div></div>', LONG),
        (f"<body><form><h1>T</h1>{LONG_P}</form></body>", f"T {LONG}"),
        (f"<div class=post><h1>Title</h1><p class=lead>Lead.</p><div class=entry-content>{LONG_P * 2}</div></div>", f"Title Lead. {LONG} {LONG}"),
        (f"<main><p>Intro.</p><article>{LONG_P}</article></main>", f"Intro. {LONG}"),
        (f"<div><div>{LONG_P * 2}</div><div>{LONG_P}</div></div>", f"{LONG} {LONG} {LONG}"),
        (f"<article>{LONG_P}<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></article>", f"{LONG} one two three"),
        (f"<div><h1>Title</h1></div><div>{LONG_P}</div>", f"Title {LONG}"),
    ],
)
def test_regions(html, text):
    assert html_text.main_text(html) == text


def unmarked(rnd):
    """(html, text) of a page whose menus and notices have no telling tag or class."""
    words = lambda a, b: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(a, b)))
    blocks = [words(30, 90) for _ in range(rnd.randint(3, 8))]
    menu = lambda: "<div>" + "".join(f"<div><a href=/x>{words(1, 2)}</a></div>" for _ in range(rnd.randint(4, 9))) + "</div>"
    paragraphs = "".join(f"<p>{b.replace(' ', chr(10) + '  ', 1)}</p>" for b in blocks)
    return f"<html><body>{menu()}<div>{paragraphs}</div>{menu()}<div><span>{words(1, 3)}</span></div></body></html>", " ".join(blocks)


def test_clusters_choose_the_content(monkeypatch):
    rnd = random.Random(4)
    cases = [unmarked(rnd) for _ in range(60)]
    assert [html_text.main_text(h) for h, _ in cases] == [t for _, t in cases]
    # without them menus come in
    monkeypatch.setattr(html_text, "_upper_cluster", lambda values: np.ones(len(values), dtype=bool))
    assert all(html_text.main_text(h) != t for h, t in cases)


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a</p>", "a"), ("<script>x</script>", ""), ("<p>a<", "a<"), ("<!-- only -->", ""), ("<p>un&eacute;&#8364;</p>", "uné€")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_everything_marked_as_noise_is_text():
    assert html_text.main_text('<div class="sidebar"><p>All there is on this page.</p></div>') == "All there is on this page."


def test_long_pages_are_taken_whole():
    words = " ".join(f"<p>paragraph number {i} &lt; next</p>" for i in range(6000))
    assert html_text.main_text(f"<article>{words}</article>").endswith("paragraph number 5999 < next")


def test_html_extraction(spark):
    rows = [(1, "u", "<p>é a</p>"), (2, None, None), (2, None, None), (None, "u", "")]
    got = sorted(tuple(r) for r in html_text.html_extraction(pages(spark, rows)).select("n_chars", "text").collect())
    assert got == [(0, ""), (0, ""), (0, ""), (3, "é a")]
    assert html_text.html_extraction(pages(spark, [])).count() == 0


# --- URLs ------------------------------------------------------------------------------

URLS = {
    "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://a.example.net/english": ("a.example.net", "/english", "net/", "block"),
    "http://EXAMPLE.COM/de/?q=1": ("example.com", "/de/", "example.com/de/", "block"),
    "http://myexample.com/de/x": ("myexample.com", "/de/x", None, None),
    "https://b.org/fr/x#y": ("b.org", "/fr/x", "org/fr/", "allow"),
    "https://b.org/FR/x": ("b.org", "/FR/x", None, None),
    "http://x.net": ("x.net", "", None, None),
    "http://x.net/": ("x.net", "/", "net/", "block"),
    "http://x.net?a/b": ("x.net", "", None, None),
    "no scheme": ("", "", None, None),
    "://h.net/p://q": ("h.net", "/p://q", "net/", "block"),
    "ftp://É.net/x?y": ("É.net", "/x", "net/", "block"),
}


def test_rules(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(99, None, ""), (99, None, "")]
    got = url_filter.url_filter(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict in ("allow", "block") and (verdict is None or by[i].verdict == verdict)
    assert (by[99].host, by[99].path, by[99].rule) == ("", "", None)
    assert url_filter.url_filter(pages(spark, [])).count() == 0


def test_trees_judge_what_no_rule_fits_by_other_labels(spark):
    url = lambda i: f"https://www.{'cheap-pills' if i % 4 == 0 else f'news{i % 9}'}{i % 7}.example.{'com' if i % 3 else 'org'}/en/{i}"
    host = lambda i: url(i).split("/")[2]
    labelled = spark.createDataFrame([(url(i), host(i), f"/en/{i}", i % 4 == 0) for i in range(1000, 2000)], "url string, host string, path string, blocked boolean")
    rows = [(i, url(i), "") for i in range(600)]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages(spark, rows), labelled).collect()}
    assert sum((got[i] == "block") == (i % 4 == 0) for i in range(600)) > 570


def rule_labelled(n=1500, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        top, lang = rnd.choice(("net", "com", "org")), rnd.choice(("en", "de", "fr", "es"))
        out.append((i, f"https://{rnd.choice(('www', 'm', 'blog'))}.h{rnd.randint(0, 60)}.example.{top}/{lang}/{rnd.randint(0, 9999)}", ""))
    return out


def test_labels_are_the_rules_verdicts_and_held_out_hosts_are_judged_well(spark):
    rows = url_filter.judged(pages(spark, rule_labelled()).selectExpr("page_id", "url as __url"))
    labelled = url_filter.sample(rows.where("by_rule is not null").selectExpr("__url as url", "host", "path", "by_rule = 'block' as blocked"))
    assert 500 < len(labelled) < 1500 and labelled == sorted(set(labelled), key=labelled.index)
    error, n = url_filter.held_out_error(labelled)
    assert n > 50 and error < 0.02
    # the one contrast that no rule of the host's suffix explains: what is above a rule's path
    got = {r.url: r.verdict for r in url_filter.url_filter(pages(spark, rule_labelled())).join(pages(spark, rule_labelled()), "page_id").select(F.col("url"), "verdict").collect()}
    assert all(v == "block" for u, v in got.items() if ".net/" in u and "/en/" not in u) and all(v == "allow" for u, v in got.items() if ".net/en/" in u or ".org/fr/" in u)


def test_scores_are_those_of_a_plain_walk_through_the_trees():
    data = [(u, u.split("/")[2], "/" + u.split("/", 3)[3], int(".net/" in u)) for _, u, _ in rule_labelled(400)]
    model = url_filter.fit(data)
    for (url, host, path, _), score in zip(data[:60], model.predict([r[:3] for r in data[:60]]), strict=True):
        basic, suffixes = url_filter.lexical(url, host, path)
        row = [*basic, *(model.rates.get((k, s), model.base) for k, s in enumerate(suffixes))]
        total = model.trees.prior
        for tree in model.trees.trees:
            at = 0
            while tree[at][0] >= 0:
                at = 2 * at + 1 + (row[tree[at][0]] > tree[at][1])
            total += tree[at][2]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_very_long_urls(spark):
    rows = [*rule_labelled(60), (900, "http://" + "a." * 50_000 + "net/" + "x/" * 50_000 + "?" + "p=1&" * 50_000, "")]
    got = {r.page_id: r for r in url_filter.url_filter(pages(spark, rows)).collect()}
    assert len(got) == 61 and got[900].rule == "net/" and got[900].verdict == "block" and len(got[900].path) == 100_001


def test_samples_are_bounded_at_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 100)
    rows = [(f"u{i if i % 3 else 0}", "h", "/", True) for i in range(9000)]  # one URL has a third of the rows
    assert 50 < len(url_filter.sample(spark.createDataFrame(rows, "url string, host string, path string, blocked boolean"))) < 150


def test_boosting_learns_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    assert ((url_filter.Boosted().fit(x, y).predict(x) > 0.5) == y).mean() > 0.98


# --- WARC ------------------------------------------------------------------------------


def records(n):
    return [(i, f"http://h/{i}", f"<p>page {i} é</p>\r\n\r\nmore") for i in range(n)]


def test_round_trip(spark, tmp_path):
    rows = records(50)
    warc.write_warc(pages(spark, rows), str(tmp_path / "w"))
    assert sorted(tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == rows
    part = next((tmp_path / "w").glob("*.gz"))
    assert gzip.open(part).read().startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n")


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_audit_finds_exactly_the_damage(spark, n):
    primary = records(n)
    replica = [(i, u, h + ("!" if i % 97 == 5 else "")) for i, u, h in primary if i != 11] + [(1000, "http://new/", "new")]
    rows = warc.audit(pages(spark, primary), pages(spark, replica)).collect()
    got = {r.id: r.status for r in rows}
    assert len({(r.root_digest, r.replica_root_digest) for r in rows}) == 1 and all(r.root_digest != r.replica_root_digest for r in rows)
    assert all((r.range_digest == r.replica_range_digest) <= (r.status == "ok") for r in rows)
    assert got == {i: "missing" if i == 11 else "corrupt" if i % 97 == 5 else "ok" for i in range(n)} | {1000: "extra"}


def test_equal_replicas_have_equal_roots(spark, monkeypatch):
    monkeypatch.setattr(warc, "ORDERED", 40)
    rows = records(130)
    got = sorted(warc.audit(pages(spark, rows), pages(spark, rows[::-1])).collect(), key=lambda r: r.leaf)
    assert all(r.status == "ok" for r in got) and [r.id for r in got] == list(range(130)) and [r.leaf for r in got] == list(range(130))
    at = 0
    for r, (i, u, h) in zip(got, rows, strict=True):
        text = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h.encode())}\r\n\r\n{h}"
        assert (r.offset, r.digest, r.length) == (at, hashlib.sha256(text.encode()).hexdigest(), len(text.encode()) + 4)
        at += r.length


def test_an_extra_record_changes_the_root(spark):
    rows = records(20)
    assert warc.differing(*(warc.tree(warc.manifest(pages(spark, r))) for r in (rows, rows[::-1]))) is None
    assert warc.differing(*(warc.tree(warc.manifest(pages(spark, r))) for r in (rows, [*rows, rows[3]]))).collect()
    got = warc.audit(pages(spark, rows), pages(spark, [*rows, rows[3], (5000, "u", "h")])).collect()
    assert sorted((r.id, r.status) for r in got if r.status != "ok") == [(3, "extra"), (5000, "extra")] and len(got) == 22


def brute(primary, replica):
    out = []
    for id_ in {r[0] for r in [*primary, *replica]}:
        a, b = (Counter(warc_text(*r) for r in rows if r[0] == id_) for rows in (primary, replica))
        x, y = sum((a - b).values()), sum((b - a).values())
        out += [(id_, "ok")] * sum((a & b).values()) + [(id_, "corrupt")] * min(x, y) + [(id_, "missing")] * max(0, x - y) + [(id_, "extra")] * max(0, y - x)
    return sorted(out, key=repr)


def warc_text(i, u, h):
    return (u or "", h or "")


@pytest.mark.parametrize("seed", range(2))
def test_audit_of_records_that_share_an_id(spark, seed):
    rnd = random.Random(seed)
    row = lambda: (rnd.choice([None, 1, 2, -7, 3000, 1 << 40]), "u", rnd.choice("abcdef"))
    primary = [row() for _ in range(40)]
    replica = [r if rnd.random() < 0.8 else row() for r in primary if rnd.random() < 0.9] + [row() for _ in range(4)]
    got = warc.audit(pages(spark, primary), pages(spark, replica)).collect()
    assert sorted(((r.id, r.status) for r in got), key=repr) == brute(primary, replica)
    mine = sorted((r for r in got if r.status != "extra"), key=lambda r: r.leaf)
    assert [r.leaf for r in mine] == list(range(len(primary)))
    assert [r.offset for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]


def test_descent_fetches_only_what_differs(spark):
    """A change in one range leaves the digests of all others, in every level, as they are."""
    rows = [(i * 997, "u", "h") for i in range(60)]
    changed = [(i, u, "x" if i == 997 else h) for i, u, h in rows]
    for depth, (a, b) in enumerate(zip(*(warc.tree(warc.manifest(pages(spark, r))) for r in (rows, changed)), strict=True)):
        names = warc._KEYS[:depth]
        differ = set(map(tuple, a.collect())) ^ set(map(tuple, b.collect()))
        assert {r[: depth] for r in differ if "prefix" not in names} in (set(), {tuple(997 >> 10 * (warc.LEVELS - k) if k < warc.LEVELS else 997 for k in range(depth))}), depth


def test_odd_records(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "h"), (2, "u", "")]
    got = warc.warc_fixity(pages(spark, rows)).collect()
    assert len(got) == 4 and all(r.status == "ok" for r in got) and sorted(r.leaf for r in got) == [0, 1, 2, 3]
    assert warc.warc_fixity(pages(spark, [])).count() == 0
