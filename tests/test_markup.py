from pyspark.sql import functions as F

from foliary.sources import markup

U, V = "0123abcd-0000-4000-8000-0123456789ab", "ffffffff-0000-4000-8000-0123456789ab"


def listing_html(n=100):
    row = "<tr><td>02/07/2026</td><td><a href='/view/Judgments/{u}/{v}/{k}/x#frag'>A  v <b>B</b> {k}</a></td><td><a href='/acc/{k} J.pdf'>PDF</a><td>Supreme Court<td>Woulfe J.</td><td>3 July 2026</td></tr>"
    rows = "".join(row.format(u=U[:-2] + f"{k:02d}", v=V, k=k) for k in range(n))
    pager = "".join(f"<a href='?q=x&page={p}'>{p}</a>" for p in (1, 2, 25))
    return f"<html><body><p>2,561 results</p><div class='a search-pager'>{pager}</div><table class='alfresco-table'><thead><tr><th>Date</th></tr></thead>{row.format(u=U, v=V, k='x').replace('/acc/x J.pdf', '')}<tr><td>short</td></tr>{rows}</table></body></html>"


def test_listing(spark):
    pages = spark.createDataFrame([(0, listing_html()), (1, "<p>nothing</p>"), (2, None)], "page int, html string")
    rows = markup.listing(pages, "https://h.example").orderBy("pdf_url").collect()
    assert len(rows) == 100
    r = next(x for x in rows if x.pdf_url.endswith("/acc/7%20J.pdf"))
    assert (r.title, r.court, r.judge, r.date_delivered, r.date_uploaded) == ("A  v B 7", "Supreme Court", "Woulfe J.", "2026-07-02", "2026-07-03")
    assert r.view_url == f"https://h.example/view/Judgments/{U[:-2]}07/{V}/7/x" and (r.document_uuid, r.collection_uuid) == (U[:-2] + "07", V)
    assert [tuple(x) for x in markup.listing_summary(pages).orderBy("page").collect()] == [(0, 100, 2561, 25), (1, 0, None, 0), (2, 0, None, 0)]


def test_details(spark):
    html = """<table><tr><td><span class="cell-title">Neutral Citation</span>: [2026] IESC 36</td><td><span class="x cell-title">Result:</span> Dismiss </td>
    <td><span class="cell-title">Result:</span> Allow</td><td>before <span class="cell-title">Odd</span> after</td></tr></table>
    <a href="/acc/alfresco/a/One J.pdf/pdf">One</a><a href="/acc/alfresco/a/One J.pdf/pdf#p2">again</a><a href="/acc/alfresco/b/Two.pdf/pdf"> </a><a href="/other">no</a><script>var a = "</td>";</script>"""
    frame = spark.createDataFrame([(1, html), (2, "<td><span class='cell-title'>Court</span> High"), (3, None)], "id int, html string")
    got = {r.id: r.meta for r in markup.details(frame, "https://h.example").select("id", "meta").collect()}
    assert got[1].neutral_citation == "[2026] IESC 36"
    assert got[1].fields == {"Neutral Citation": "[2026] IESC 36", "Result:": "Allow", "Odd": "before Odd after"}
    assert [tuple(x) for x in got[1].supplementary] == [("One", "https://h.example/acc/alfresco/a/One%20J.pdf/pdf"), ("Two.pdf", "https://h.example/acc/alfresco/b/Two.pdf/pdf")]
    assert got[2].neutral_citation is None and got[2].fields == {"Court": "High"} and not got[2].supplementary
    assert got[3].fields == {}


def test_page_fields(spark):
    frame = spark.createDataFrame([("<html lang=fr><title> A &amp;  B</title><h1>x<br>y</h1><a href='q'>z</a>",)], "html string")
    r = frame.select(markup.page_fields("html").alias("p")).select("p.*").first()
    assert (r.title, r.h1, r.lang, r.links) == ("A &  B", "x y", "fr", ["q"])
    assert frame.where(F.lit(False)).select(markup.page_fields("html")).count() == 0


def test_plain_pages_need_no_parser(monkeypatch):
    """Pages of whole tags come to the same tree as through the parser, and do not go through it."""
    def shape(node):
        return (node.tag, node.attrs, [x if isinstance(x, str) else shape(x) for x in node.children])

    pages = ["", "x", "a > b", "<p>a<br>b</p>c", "<TD Class='x'>1<td class=\"a b\" id=''>2</TD></table>", "<a href='../q#x'>A</a ><ul><li>1<li>2</ul>", "<tr><td>1</td><td>2<tr><td>3</table>t", listing_html(3).replace("&", "/")]
    odd = ["<p", "a < b", "a &amp b", "<!-- x --><p>y", "<script>if (a < b) c</script>d", "<title>a<b>c</title>", "<a href=x>y</a>", "<br/>z", "<p a='1'b='2'>", "<a b='<'>c", "</p x='1'>y"]
    plain = [shape(markup.tree(x)) for x in pages]
    mixed = [shape(markup.tree(x)) for x in odd]
    assert all(markup._plain(x) is None for x in odd) and all(markup._plain(x) is not None for x in pages)
    monkeypatch.setattr(markup, "_plain", lambda _: None)
    assert plain == [shape(markup.tree(x)) for x in pages] and mixed == [shape(markup.tree(x)) for x in odd]


def test_page_fields_of_cut_text(spark, tmp_path):
    """A reference that is cut off stays as it is; white space is one space; what a page lacks is '', and of no page nothing is known."""
    from foliary.plans import archive

    rows = [(1, '<html lang="en"><title>a &amp; b\n &amp</title><h1>x&#39;s &lt</h1><a href="q">z</a>'), (2, "<p>"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, archive.QUERIES["page_fields"](spark, str(tmp_path)).collect()))
    assert got == [(1, "a & b &amp", "x's &lt", "en", 1), (2, "", "", "", 0), (3, None, None, None, None)]


def test_flat_pages_are_read_without_python(spark, monkeypatch):
    """Flat pages come to what the parser makes of them, and only others go through Python."""
    row = "<tr class='r'><td>01/02/2024</td><td> <a title='t' href='/view/ {k}/a#x'> T <b>{k}</b>\n u </a></td><td><a href=''>-</a><a href='https://cdn/{k} J.pdf'>d</a></td><td>c<br>d</td><td></td><td>3 July 2026</td></tr>"
    table = "<div><p>1 result<table class='alfresco-table'>\n<thead><tr><th>x</th></tr></thead><tbody>" + row.format(k=1) + row.format(k=2) + "</tbody></table><table class='alfresco-table'></table></body>"
    few = "<table class='alfresco-table'><tr><td>1</td><td><a href='/v'>t</a></td></tr></table>"
    cell = "<td id='q'> <span class='cell-title'> {0}: </span> : v <i>w</i><a href='/acc/alfresco/x/in'>in</a> </td>"
    detail = "<html lang='en'><body><table><tr><td>" + cell.format("A") + cell.format("B").replace(" : v", "") + "<td>plain</td></tr></table><a href='/acc/alfresco/s/One J.pdf#p'>\t</a><a>none</a><a href='https://h/acc/alfresco/1'>x <em>y</em></a><a href='/other'>no</a>"
    flat = [table, few, detail, "", "only text", "<td>x</td>"]
    lists = [table.replace("href='/view/", "href='view/"), table.replace("/view/ ", "/view/../"), table.replace("<td>c", "<td>&amp;c"), table.replace("</td><td></td>", "<td></td>"), table.replace("<td>01", "<td><table><tr><td>1</table>01"), table.replace("</thead>", ""), "<table>" + table, table.replace("c<br>", "c\xa0"), table.replace("<div>", "<script>a</script>")]
    details = [detail.replace("href='/acc", "href='acc"), detail.replace("B:", "A:"), detail.replace("<td id='q'>", "<td><b>"), detail.replace("'cell-title'", "'x cell-title'"), detail.replace("plain", " &lt;"), detail.replace("<i>", "<I>"), detail.replace("/s/", "/./"), detail.replace("<em>", "<span>")]
    pages = [*flat, *lists, *details, None]
    absolute = markup.links.resolver("https://h/a/b")
    frame = spark.createDataFrame(list(enumerate(pages)), "page int, html string")

    def check(kept):
        some = frame.where(F.col("page").isin(kept))
        want = {k: markup.detail_of(pages[k], absolute) for k in kept}
        got = {r.page: (list(zip(r.k, r.v, strict=True)), [x.asDict() for x in r.s]) for r in markup.details(some, "https://h/a/b").select("page", F.map_keys("meta.fields").alias("k"), F.map_values("meta.fields").alias("v"), F.col("meta.supplementary").alias("s")).collect()}
        assert got == {k: (list(x["fields"].items()), x["supplementary"]) for k, x in want.items()}
        rows = sorted((k, r["title"], r["court"], r["judge"], absolute(r["view"]), absolute(r["pdf"])) for k in kept for r in markup.rows_of(markup.tree(pages[k])))
        assert sorted(map(tuple, markup.listing(some, "https://h/a/b").select("page", "title", "court", "judge", "view_url", "pdf_url").collect())) == rows

    check(list(range(len(pages))))
    assert len(markup.rows_of(markup.tree(table))) == 2 and len(markup.detail_of(detail, absolute)["supplementary"]) == 3

    def resolver(base):
        def used(href):
            raise ValueError(f"{href} was resolved by Python")

        return used

    monkeypatch.setattr(markup.links, "resolver", resolver)
    check(list(range(len(flat))))
