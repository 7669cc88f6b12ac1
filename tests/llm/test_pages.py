"""Archives and URL rules."""

import base64
import hashlib

import pytest

from strandloom.llm import warc
from strandloom.llm.urlrules import judge_urls

SCHEMA = "page_id long, url string, html string, path string, payload_digest int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_record_round_trip():
    long_payload = bytes(range(256)) * 70_000
    data = [warc.record(1, "http://a/\r\nx%0A", b"<p>", 3, warc.payload_digest(b"<p>")), warc.record(None, None, long_payload, len(long_payload), warc.payload_digest(long_payload)), warc.record(2, "u", None, 3, "D", 1)]
    content = b"".join(warc.gzip_row(d) + b"\x00" for d in data)
    got = list(warc.records(content))
    assert [g[2] for g in got] == [b"<p>", long_payload, b""]
    assert warc._unline(got[0][0]["WARC-Target-URI"]) == "http://a/\r\nx%0A"
    assert got[2][0]["WARC-Type"] == "revisit" and got[2][0]["Refers-To-Page-Id"] == "1"
    with pytest.raises((ValueError, IndexError)):
        list(warc.records(content[:-20]))


def test_revisits(spark):
    rows = [(k, f"http://h/{k}", ["same", "other", None, "", "é\x00🙂", f"one {k}"][k % 6]) for k in range(40)] + [(None, None, "same"), (7, "http://h/7b", "one 1"), (7, "http://h/7b", "one 1"), (100, "x", "long " * 50000)]
    best = {}
    key = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    for i, _, h in rows:
        best[key(h)] = max(best.get(key(h), -1), -1 if i is None else i)
    got = warc.deduplicate_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {}
    for x in got:
        seen.setdefault(x["payload_digest"], []).append(x)
    for d, group in seen.items():
        assert sum(x["record_type"] == "response" for x in group) == 1
        for x in group:
            if x["record_type"] == "response":
                assert x["page_id"] == best[d] and x["refers_to"] is None
            else:
                assert x["refers_to"] == best[d]
    assert sorted((x["page_id"] or -1, x["payload_bytes"], x["url"] or "") for x in got) == sorted((i or -1, len((h or "").encode()), u or "") for i, u, h in rows)
    assert all(x["record_type"] == "response" for x in warc.deduplicate_pages(pages(spark, rows), min_bytes=10**7).collect())


def test_given_revisits_are_resolved(spark, tmp_path):
    """An archive that already has revisit records keeps the payloads they refer to."""
    digest = {x: warc.payload_digest(x) for x in (b"aaa", b"bb", b"gone")}
    data = [
        warc.record(1, "u1", b"aaa", 3, digest[b"aaa"]), warc.record(9, "u9", None, 3, digest[b"aaa"], 1),
        warc.record(5, "u5", b"aaa", 3, digest[b"aaa"]), warc.record(2, "u2", b"bb", 2, digest[b"bb"]),
        warc.record(8, "u8", None, 2, digest[b"bb"], 2), warc.record(7, "u7", None, 4, digest[b"gone"], 70), warc.record(None, None, None, 3, digest[b"aaa"], 1),
    ]
    source, target, again = (str(tmp_path / x) for x in ("a", "b", "c"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(warc.gzip_row(d) + b"\x00" for d in data[:4]))
    (tmp_path / "a" / "two.warc.gz").write_bytes(b"".join(warc.gzip_row(d) + b"\x00" for d in data[4:]))
    want = sorted([(1, 3, "revisit", 5), (9, 3, "revisit", 5), (5, 3, "response", None), (2, 2, "response", None), (8, 2, "revisit", 2), (7, 4, "revisit", 70), (-1, 3, "revisit", 5)])
    for a, b, at_once in ((source, target, 1), (target, again, 10**6)):
        heads = warc.resolve_revisits(spark, a, b, at_once=at_once).collect()
        assert sorted((-1 if h["page_id"] is None else h["page_id"], h["payload_bytes"], h["record_type"], h["refers_to"]) for h in heads) == want
    kept = [payload for f in (tmp_path / "c").glob("*.txt") for _, _, payload in warc.records(f.read_bytes()) if payload]
    assert sorted(kept) == [b"aaa", b"bb"]
    low = warc.resolve_revisits(spark, source, str(tmp_path / "d"), min_bytes=3).collect()
    assert {h["page_id"]: h["record_type"] for h in low if h["payload_bytes"] < 3} == {2: "response", 8: "revisit"}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    import random

    r = random.Random(5)
    rows = [(k, f"u{k}", "".join(chr(r.randrange(33, 1000)) for _ in range(r.choice([10, 5000])))) for k in range(60)] + [(100, "big", "".join(chr(r.randrange(33, 1000)) for _ in range(400_000)))]
    warc.write_responses(pages(spark, rows).coalesce(2), str(tmp_path / "w"), archive_bytes=20_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("*.txt"))
    assert len(sizes) > 5 and sizes[-2] < 40_000 and sizes[-1] > 400_000
    assert warc.read_heads(spark, str(tmp_path / "w")).count() == 61
    got = warc.deduplicate_pages(pages(spark, rows + [(200, "x", rows[0][2])]), archive_bytes=20_000).collect()
    assert len(got) == 62 and sum(x["record_type"] == "revisit" for x in got) == 1


def test_empty_tables(spark):
    assert warc.deduplicate_pages(pages(spark, [])).count() == 0
    assert judge_urls(pages(spark, [])).count() == 0


def test_rules_and_parts(spark):
    urls = {
        1: ("HTTP://A.Example.NET/en/x?y#z", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        2: ("http://example.net/fr/", ("example.net", "/fr/", "net/", "block")),
        3: ("http://badexample.com/de/", ("badexample.com", "/de/", None, "allow")),
        4: ("https://www.example.com/de/?a=://b", ("www.example.com", "/de/", "example.com/de/", "block")),
        5: ("http://x.org/fr/1", ("x.org", "/fr/1", "org/fr/", "allow")),
        6: ("http://x.net", ("x.net", "", None, "allow")),
        7: ("no scheme", ("", "", None, "allow")),
        8: (None, ("", "", None, "allow")),
        9: ("", ("", "", None, "allow")),
        10: ("://İ.net/" + "p" * 100_000, ("İ.net", "/" + "p" * 100_000, "net/", "block")),
    }
    got = {x["page_id"]: tuple(x[c] for c in ("host", "path", "rule", "verdict")) for x in judge_urls(pages(spark, [(i, u, None) for i, (u, _) in urls.items()])).collect()}
    assert got == {i: e for i, (_, e) in urls.items()}


def test_decisions_reach_aliases(spark):
    canon = lambda u: f'<html><head><LINK href="{u}" rel="Canonical"></head>'
    rows = [
        (1, "http://a.com/1", canon("http://b.com/2")), (2, "http://b.com/2#frag", canon("//evil.net/x")), (3, "http://c.com/", '<meta http-equiv="refresh" content="0; url=/d">'), (4, "http://c.com/d", canon("http://evil.net/y")),
        (5, "http://c.com/d", canon("http://ok.example.net/en/z")), (6, "http://e.com/q/a", canon("b")), (7, "http://e.com/q/b", canon("mailto:x")), (8, "http://evil.net/x", ""), (9, None, canon("http://evil.net/x")),
    ]
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in judge_urls(pages(spark, rows)).collect()}
    assert got[1] == got[2] == (None, "block"), "an alias is blocked"
    assert got[3] == got[4] == got[5] == (None, "allow"), "an explicit allow comes first"
    assert got[6] == got[7] == (None, "allow") and got[8] == ("net/", "block") and got[9] == (None, "allow")
    redirects = spark.createDataFrame([("http://e.com/q/b", "http://evil.net/x")], "source string, target string")
    got = {x["page_id"]: x["verdict"] for x in judge_urls(pages(spark, rows), redirects=redirects).collect()}
    assert got[6] == got[7] == "block"


def test_links_are_decoded_and_resolved(spark):
    canon = lambda u: f'<link rel="canonical" href="{u}">'
    refresh = lambda c: f"<meta http-equiv=refresh content={c}>"
    target = "http://evil.net/p?page=2&ref=x"
    links = {
        1: canon("http://evil.net/p?page=2&amp;ref=x"), 2: canon("http://evil.net/p?page=2&#38;ref=x"), 3: canon("http&colon;&#x2f;&#x2F;evil.net/p?page=2&#x26;ref=x"),
        4: refresh('"0; url=http://evil.net/p?page=2&amp;ref=x"'), 5: refresh("'0;URL=\"http://evil.net/p?page=2&amp;ref=x\"'"), 6: refresh('"0; url=&#39;http://evil.net/p?page=2&amp;ref=x&#39;"'),
        7: canon("//evil.net/a/./b/../../p?page=2&amp;ref=x"), 8: canon("http://evil.net/../p?page=2&ref=x"),
    }
    rows = [(k, f"http://a.com/{k}", h) for k, h in links.items()] + [(20, target, "")]
    rows += [(30, "http://b.com/x/y/z", canon("../../q;v=1/.")), (31, "http://b.com/q;v=1/", refresh("'0; url=http://evil.net/s;t=1;u'")), (32, "http://evil.net/s;t=1;u", ""), (33, "http://c.com/k/../m", ""), (34, "http://c.com/m", canon("http://evil.net/s;t=1;u"))]
    rows += [(40, "http://d.com/1", canon("http://d.com/?a&amp;lt;b")), (41, "http://d.com/?a&lt;b", canon("http://evil.net/")), (42, "http://d.com/?a<b", ""), (43, "http://d.com/2", canon("http://d.com/&#233;&#128578;&#0;&#xD800;")), (44, "http://d.com/\u00e9\U0001f642&#0;&#xD800;", "")]
    got = {x["page_id"]: x["verdict"] for x in judge_urls(pages(spark, rows)).collect()}
    clean = {42, 43, 44}
    assert got == {r[0]: "allow" if r[0] in clean else "block" for r in rows}
    redirects = spark.createDataFrame([("http://d.com/u/../2", "http://evil.net/")], "source string, target string")
    got = {x["page_id"]: x["verdict"] for x in judge_urls(pages(spark, rows), redirects=redirects).collect()}
    assert got[43] == "block" and got[42] == "allow"


def judge(url, rules):
    """(rule, verdict) of a url by its own rules, in plain Python."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), v == "allow", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (None, "allow") if not fits else (max(fits)[2], "allow" if max(fits)[1] else "block")


def test_a_table_of_rules_is_as_a_list(spark, monkeypatch):
    import random

    from strandloom.llm import urlrules

    r = random.Random(4)
    labels = ["com", "net", "a", "b", "", "x-y"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: "".join(r.choice(["/", "d", "/en", "é"]) for _ in range(r.randrange(0, 5)))
    rules = [(r.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    urls = [(k, f"http://{host().upper()}{path()}{r.choice(['', '?q', '#f'])}", None) for k in range(300)] + [(900, None, None), (901, "none", None), (902, "http://", None), (903, "http://A.com/d", None), (903, "http://A.com/d", None)]
    urls += [(1000 + k, "http://hot.b.net/en/d", None) for k in range(300)]
    want = sorted((k, *judge(u, rules)) for k, u, _ in urls)
    for limit in (32, 10**6):
        monkeypatch.setattr(urlrules, "LITERAL_RULES", limit)
        got = judge_urls(pages(spark, urls), rules).collect()
        assert sorted(((x["page_id"], x["rule"], x["verdict"]) for x in got), key=str) == sorted(want, key=str)


def test_many_rules_and_a_hub(spark):
    rules = spark.range(0, 100_000).selectExpr("case when id % 2 = 0 then 'block' else 'allow' end as verdict", "concat('h', id, '.net') as host", "concat('/', id % 7, '/') as path")
    rows = spark.range(0, 3000).selectExpr("id as page_id", "concat('http://www.h', id, '.net/', id % 7, '/x') as url", "cast(null as string) as html")
    got = judge_urls(rows, rules).selectExpr("count_if(verdict = 'block') as b", "count_if(rule is null) as n").first()
    assert tuple(got) == (1500, 0)
    hub = spark.range(0, 20_000).selectExpr("concat('http://s', id, '.com/') as source", "'http://hub.org/' as target")
    rows = spark.range(0, 50).selectExpr("id as page_id", "concat('http://s', id * 400, '.com/') as url", "cast(null as string) as html")
    got = judge_urls(rows, [("block", "s19999.com", "/")], hub).groupBy("verdict").count().collect()
    assert [tuple(x) for x in got] == [("block", 50)]


def test_only_tags_of_the_page_are_links(spark):
    bad = "http://evil.net/x"
    link = f"<link rel=canonical href='{bad}'>"
    html = {
        1: f"<!-- {link} -->", 2: f"<script type=a>var s = \"{link}\";</script>", 3: f"<STYLE>{link}</style >", 4: f"<textarea>{link}</textarea>", 5: f"<title>{link}</title>", 6: f"<!-- never closed {link}",
        7: f"<link rel=alternate data-x=\"rel=canonical\" href='{bad}'>", 8: f"<link rel='xcanonical' href='{bad}'>", 9: f"<link rel=canonical title=\"href={bad}\">", 10: f"<p>rel=canonical href={bad}</p>", 11: f"<meta name=refresh content='0; url={bad}'>",
        20: f"<!-- c --> {link}", 21: f"<script>x</script>{link}<script>y", 22: f"<link title='a > b' rel='next canonical' href='{bad}'>", 23: f"<LINK\nHREF = \"{bad}\"\tREL=\"CANONICAL\" >", 24: f"<meta content=\"0;url={bad}\" title='>' http-equiv=REFRESH>",
        25: "<base href='http://evil.net/a/b'><link rel=canonical href='../x'>", 26: f"<base target=_top><base href='//evil.net/'><base href='http://fine.com/'><link rel=canonical href=x>", 27: f"<link rel=canonical href='{bad}' href='http://fine.com/'>",
    }
    rows = [(k, f"http://a{k}.com/", h) for k, h in html.items()] + [(99, bad, None)]
    got = {x["page_id"]: x["verdict"] for x in judge_urls(pages(spark, rows)).collect()}
    assert got == {k: "allow" if k < 20 else "block" for k, *_ in rows}


def test_a_very_long_page(spark):
    filler = "<p class='x'>" + "word " * 20 + "</p><!-- note --><script>if (a < b) {}</script>"
    html = filler * 20_000 + "<link rel=canonical href='http://evil.net/x'>" + "<link title=\"" + "a" * 2_000_000
    rows = [(1, "http://a.com/", html), (2, "http://b.com/", filler * 20_000 + "<link " + "a=b " * 100_000)]
    assert {x["page_id"]: x["verdict"] for x in judge_urls(pages(spark, rows)).collect()} == {1: "block", 2: "allow"}


def test_pages_without_links_write_nothing(spark, monkeypatch):
    from strandloom.llm import urlrules

    def never(*_, **__):
        raise AssertionError("a table was written")

    monkeypatch.setattr(urlrules, "materialize", never)
    assert judge_urls(pages(spark, [(1, "http://x.net/", "<p>text</p>"), (2, None, "<link rel=canonical href='http://x.net/'>"), (3, "http://a.com/b", None)])).count() == 3
