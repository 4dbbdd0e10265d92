"""Listings and blocks of pages on hand-written pages."""

from pyspark.sql import functions as F

from fieldbook.functions import html as h

FEED = """<?xml version="1.0"?><rss><item><title><![CDATA[湖滨 &amp; 山径]]></title><link>/n/1</link></item><item><title>x</title></item>
<entry><title>Atom</title><link href="https://a.cn/2"/></entry></rss>"""
MAP = "<urlset><url><loc>https://s.cn/a%20b</loc></url></urlset>"
PAGE = """<!-- <a href="/no">no</a> --><script><a href="/no2">no</a></script><a class=x href = '/p?a=1&amp;b=2'>湖滨 <b>赛</b></a><a href="q"><img src=i alt="图"></a>
<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="icon" href="/i.png"><a href="http://[bad">bad</a>"""


def test_listing_links(spark):
    rows = [(1, FEED, "https://f.cn/x/", "text/html"), (2, MAP, "https://s.cn/", "application/xml"), (3, PAGE, "https://p.cn/d/", "text/html"), (4, None, "https://p.cn", None), (5, "", None, None)]
    df = spark.createDataFrame(rows, "id int, body string, base string, kind string")
    got = [tuple(r) for r in h.listing_links(df, "id", "body", "base", "kind").orderBy("id", "rank").select("id", "url", "title", "method").collect()]
    assert got == [
        (1, "https://f.cn/n/1", "湖滨 & 山径", "rss"), (1, "https://a.cn/2", "Atom", "rss"), (2, "https://s.cn/a%20b", "/a b", "sitemap"), (3, "https://p.cn/p?a=1&b=2", "湖滨 赛", "html_link"), (3, "https://p.cn/d/q", "图", "html_link"), (3, "https://p.cn/feed", "rss", "html_link"),
    ]
    many = spark.createDataFrame([(1, "<a href='/x'>y</a>" * 300, "https://p.cn", "")], "id int, body string, base string, kind string")
    assert h.listing_links(many, "id", "body", "base", "kind").count() == 200


def card(k, name="湖滨赛", info="2026.5.3 · 浙江 杭州 西湖 湖滨 公园"):
    return f'<div class="event" style="padding-bottom: 10px"><a href="https://zuicool.com/event/{k}"><img src="/l{k}.png" class="logo"></a><h4 class="name">{name}</h4><div class="info">{info}</div><a class="status_bth x">点此报名</a>报名截止：2026-04-01 <br></div>'


DETAIL = """<title>湖滨赛 详情</title><meta property="og:image" content="https://i.cn/c.png"><a href="https://reg.zuicool.com/9">x</a><a href="https://reg.zuicool.com/7"> 点此报名 </a>
<div class="pkg2"><h4>全程马拉松</h4><div class="price"> 180.5</div></div><div class="pkg2"><h5></h5></div><div class="pkg2"><h5>越野 30km</h5>累计爬升 1500米，关门时间 8小时，</div><div class="clearfix">"""
REG = """<table><tr> <td class="name"><h4>全程马拉松</h4></td><td class="fee"><b></b><p> 200</td><a href="https://reg.zuicool.com/7/1">go</a></tr><tr><td class="name"><h4>亲子</h4></td></tr></table>"""


def test_connector_pages(spark):
    pages = spark.createDataFrame([("https://l.cn/1", card(1) + card(2, "") + card(1, "later") + card(3, info="") + '<nav class="pagination-wrap">'), ("https://l.cn/2", "nothing")], "base string, body string")
    cards = h.list_cards(pages, "body", "base", "https://zuicool.com/event/")
    got = {r["event_id"]: r for r in cards.collect()}
    assert set(got) == {"1", "3"} and (got["1"]["name"], got["1"]["detail_url"], got["1"]["deadline"], got["1"]["cover_image"], got["1"]["status_text"]) == ("湖滨赛", "https://zuicool.com/event/1", "2026-04-01", "https://l.cn/l1.png", "点此报名")
    detail = h.details(spark.createDataFrame([("1", DETAIL)], "event_id string, body string"), "event_id", "body")
    d = detail.first()
    assert (d["title"], d["page_image"], d["registration_url"]) == ("湖滨赛 详情", "https://i.cn/c.png", "https://reg.zuicool.com/7")
    assert [(c["category_name"], c["fee"], c["distance_km"], c["elevation_gain"], c["cutoff_time"]) for c in d["categories"]] == [("全程马拉松", 180.5, 42.2, None, None), ("越野 30km", None, 30.0, 1500, "关门时间 8小时")]
    reg = spark.createDataFrame([("1", REG)], "event_id string, body string").select("event_id", h.category_blocks(F.col("body"), h.TABLE_ROW).alias("registration_categories"))
    rows = {r["event_id"]: r for r in h.connector_rows(cards, detail, reg).collect()}
    one = rows["1"]
    assert (one["name"], one["race_date"], one["province"], one["venue"], one["data_quality"]) == ("湖滨赛 详情", "2026-05-03", "浙江", "湖滨 公园", "medium")
    assert [(c["category_name"], c["fee"], c["registration_url"]) for c in one["categories"]] == [("全程马拉松", 180.5, "https://reg.zuicool.com/7/1"), ("越野 30km", None, None), ("亲子", None, None)]
    assert rows["3"]["data_quality"] == "low" and rows["3"]["categories"] == [] and rows["3"]["race_date"] is None
