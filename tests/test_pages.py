"""I7 and I13 on layouts of publishers' pages, written anew, with the tables that they should give."""

import pytest

from quillspark.sources import html, pages

LONG = "Our method reads pages of many layouts and keeps the prose of each one as it stands."
MORE = "A second text that says somewhat more than the first one does, so that it is longer than it is."


def extracted(spark, body, selectors, url="https://a.org/1", **options):
    rule = spark.createDataFrame([("a.org", selectors, options.get("longest"), options.get("every_label"))], "host string, selectors array<string>, longest boolean, every_label boolean")
    r = pages.extract_pages(spark.createDataFrame([(url, body)], "url string, html string"), rule).first()
    return r["abstract"], r["reason"]


LAYOUTS = [
    # a block with its label as a heading, in bold, or as text
    ("<div class='card acl-abstract'><h5 class='t'>Abstract</h5><span>{}</span></div>", [".acl-abstract"]),
    ("<div class='abs'><strong>Abstract.</strong> {}</div>", ["div.abs"]),
    ("<div class='abs'><b>ABSTRACT</b>{}</div>", ["div.abs"]),
    ("<div class='abs'>Abstract: {}</div>", ["div.abs"]),
    ("<div class='abs'>Abstract — {}</div>", ["div.abs"]),
    ("<div class='abs'>\n Abstract \n{}</div>", ["div.abs"]),
    # nested, by attribute and child
    ("<section aria-labelledby='Abs1'><h2 id='Abs1'>Abstract</h2><div><p>{}</p></div></section>", ["section[aria-labelledby=Abs1]"]),
    ("<div id='Abs1-section'><h2>Abstract</h2><p>{}</p></div>", ["section[aria-labelledby=Abs1]", "div#Abs1-section"]),
    ("<div class='paper'><p><b>by Ann</b></p><div><p>no</p></div></div><div class='paper-data'><div><p>deep</p></div><p>{}</p></div>", [".paper-data > p"]),
    ("<main><p>x</p></main><article><div class='a b'><p lang='en'>{}</p></div></article>", ["article .b p[lang^=e]"]),
    # raw text after a heading, up to what ends it
    ("<h2>Title</h2><h3>Abstract</h3>\n{}\n<font>[abs][pdf]</font>", ["p.abstract", "after:h3"]),
    ("<h4>Authors</h4><p>Ann</p><strong>Abstract</strong><p>{}<ul><li>View the full text</li></ul>", ["after:strong"]),
    # meta elements and JSON-LD
    ("<meta name='citation_abstract' content='{}'>", [".abs", "meta:citation_abstract"]),
    ("<meta property='og:description' content='{}'>", ["meta:og:description"]),
    ("<script type='application/ld+json'>{{broken</script><script type='application/ld+json'>{{\"@graph\": [{{\"name\": \"x\"}}, {{\"abstract\": \"{}\"}}]}}</script>", ["ld:abstract"]),
    ("<div data-abstract='{}'></div>", ["div@data-abstract"]),
    # scripts and unclosed elements
    ("<div class='abs'><script>var a = '</div>';</script><p>{}<p></div><div>after", ["div.abs", "p"]),
]


def test_layouts(spark):
    texts = [LONG, "Abstractive summarisation models write what they read in other words, which is hard.", "Abstract interpretation finds what a program may do without running it at all."]
    rules = spark.createDataFrame([(f"h{i}.org", selectors) for i, (_, selectors) in enumerate(LAYOUTS)], "host string, selectors array<string>")
    rows = [(f"https://h{i}.org/{j}", body.format(text)) for i, (body, _) in enumerate(LAYOUTS) for j, text in enumerate(texts)]
    got = {r["url"]: r["abstract"] for r in pages.extract_pages(spark.createDataFrame(rows, "url string, html string"), rules).collect()}
    assert got == {f"https://h{i}.org/{j}": text for i in range(len(LAYOUTS)) for j, text in enumerate(texts)}


def test_bold_words_of_the_text_stay(spark):
    text = "<strong>Abstractive</strong> models and <b>abstract</b> ones differ, as is shown for texts of all lengths and kinds."
    want = "Abstractive models and abstract ones differ, as is shown for texts of all lengths and kinds."
    assert extracted(spark, f"<div class='abs'><h2>Abstract</h2>{text}</div>", [".abs"]) == (want, None)


def test_choices(spark):
    two = f"<div class='abs'>{LONG}</div><meta name='citation_abstract' content='{MORE}'>"
    assert extracted(spark, two, [".abs", "meta:citation_abstract"]) == (LONG, None)
    assert extracted(spark, two, [".abs", "meta:citation_abstract"], longest=True) == (MORE, None)
    labelled = f"<div class='abs'><h2>Abstract</h2><strong>Abstract</strong> {LONG}</div>"
    assert extracted(spark, labelled, [".abs"]) == (f"Abstract {LONG}", None)
    assert extracted(spark, labelled, [".abs"], every_label=True) == (LONG, None)
    assert extracted(spark, f"<meta name='description' content='{LONG[:-1]} …'>", ["meta:description"]) == (None, "no_abstract_available")
    assert extracted(spark, "<div class='abs'><h2>Abstract</h2>short</div>", [".abs"]) == (None, "empty_abstract")
    assert extracted(spark, None, [".abs"]) == (None, "no_abstract_available")
    spare = spark.createDataFrame([("*", ["p"]), ("b.org", ["div"])], "host string, selectors array<string>")
    rows = spark.createDataFrame([("https://c.org/1", f"<p>{LONG}</p>"), ("https://b.org/1", f"<p>{LONG}</p>")], "url string, html string")
    assert {r["url"]: r["ok"] for r in pages.extract_pages(rows, spare).collect()} == {"https://c.org/1": True, "https://b.org/1": False}


def test_trees():
    deep = html.Page("<div>" * 50_000 + "x").root
    assert deep.text() == "x" and len(html.select(deep, "div")) == 50_000
    root = html.Page("</p><ul><li id=a class='x y'>1<li id=b>2</ul></div>t<br>u").root
    assert [x.attrs["id"] for x in html.select(root, "ul li")] == ["a", "b"] and html.select(root, "li.y.x#a") and not html.select(root, "ul > b")
    assert [x.tag for x in html.select(root, "#b ..")] == ["li"] and root.text() == "1 2 t u"
    assert html.values(root, "li.x@id") == ["a"] and html.values(root, "[class$=y]") == ["1 2"] and html.values(root, "*[class*=' ']@class") == ["x y"]
    for wrong in ("!", "div > ", "a,b"):
        with pytest.raises(ValueError, match="no selector"):
            html.select(root, wrong)


def listed(spark, body, **rule):
    names = list(rule)
    rules = spark.createDataFrame([("a.org", *rule.values())], ", ".join(f"{n} string" for n in ["host", *names]))
    page = spark.createDataFrame([("https://a.org/list/", "ACL2023", body)], "url string, conf string, html string")
    return [(r["paper_name"], r["paper_authors"], r["paper_url"], r["paper_abstract"]) for r in pages.extract_listing(page, rules).orderBy("pos").collect()]


def test_entries_by_elements(spark):
    """Names lose their digits, titles keep theirs but lose a closing period."""
    body = """<ul><li class="entry"><nav><ul><li class="drop-down"><div><a href="https://doi.org/10.1/x">view</a></div></li></ul></nav>
      <span itemprop="name" title="Wei Wang 0001">Wei Wang</span>, <span itemprop="name" title="Ann Lee">A. Lee</span>
      <span class="title" itemprop="name">3D Gaussian Splatting.</span></li>
      <li class="entry"><li class="drop-down"><div><a href="/p/2">view</a></div></li><span class="title" itemprop="name">2001: a study</span></li>
      <li class="entry"><span class="title" itemprop="name"></span></li></ul>"""
    out = listed(spark, body, entry="li.entry", title=".title[itemprop=name]", link="li.drop-down > div > a @href", authors="span[title] @title")
    assert out[0] == ("3D Gaussian Splatting", ["Wei Wang", "Ann Lee"], "https://doi.org/10.1/x", "")
    assert out[1] == ("2001: a study", [], "https://a.org/p/2", "") and len(out) == 2


def test_entries_with_people_beside_and_abstracts_apart(spark):
    body = f"""<p><span><strong><a href="/2023.acl-long.1/">Proceedings of X 2</a></strong><br><a href="/people/w">Wei Wang 0002</a> | <a href="/people/a">Ann</a></span></p>
      <div id="abstract-2023--acl-long--1"><div>{LONG}</div></div>"""
    out = listed(spark, body, entry="strong", title="a", link="a @href", authors=".. > a[href^=/people/]", abstract="#abstract-{key}")
    assert out == [("Proceedings of X 2", ["Wei Wang", "Ann"], "https://a.org/2023.acl-long.1/", LONG)]


def test_entries_in_one_text(spark):
    body = "<ol><li>12. <a href='x'>3D scenes</a>. by Ann Lee 0003, Bo Xu</li><li>[4] 2001: a study by Cy</li><li>1984 revisited.</li></ol>"
    out = listed(spark, body, entry="li", separator="by")
    assert [(t, a) for t, a, _, _ in out] == [("3D scenes", ["Ann Lee", "Bo Xu"]), ("2001: a study", ["Cy"]), ("1984 revisited", [])]


def test_records_in_the_order_of_the_listings(spark):
    body = "<li><a href='/p/{}'>{}</a> by {}</li>"
    page = [("https://a.org/z", "A2020", body.format(1, "One", "A") + body.format(2, "Two", "B"), 7), ("https://a.org/y", "A2020", body.format(2, "Two", "B, C") + body.format(3, "Three", "D"), 9), ("https://a.org/x", "A2020", body.format(4, "Four", "E"), 8)]
    entries = pages.extract_listing(spark.createDataFrame(page, "url string, conf string, html string, seq long"), spark.createDataFrame([("a.org", "li", "by")], "host string, entry string, separator string"))
    out = pages.listing_records(entries.repartition(4)).orderBy("seq").collect()
    assert [(r["paper_name"], r["paper_authors"], tuple(r["seq"])) for r in out] == [("One", ["A"], (7, 0)), ("Two", ["B", "C"], (7, 1)), ("Four", ["E"], (8, 0)), ("Three", ["D"], (9, 1))]
