"""The outline of large pages: blocks of the fold give what one block gives, and time follows the number of tags."""

import time

import pytest

from crawlsift.operators import html


def pages(spark, *docs):
    return spark.createDataFrame([(i, "https://h/", d) for i, d in enumerate(docs)], "page_id bigint, url string, html string")


DOC = "<html><head><title>x</title></head><body>" + "".join(
    f"<div id=d{i}><ul><li>a<li class=c{i}>b</ul><p>one<p>two<table><tr><td>1<td>2</table><svg><g></g></svg></div>" for i in range(30)) + "</body></html>"


@pytest.mark.parametrize("block", [1, 2, 7, 100_000])
def test_blocks_don_t_change_the_tree(spark, monkeypatch, block):
    want = sorted(map(tuple, html.outline(pages(spark, DOC, "", "<p>", "<br>")).collect()), key=repr)
    monkeypatch.setattr(html, "OUTLINE_BLOCK", block)
    assert sorted(map(tuple, html.outline(pages(spark, DOC, "", "<p>", "<br>")).collect()), key=repr) == want and len(want) > 150


def test_time_follows_the_tags(spark):
    def seconds(n):
        table = pages(spark, "<body>" + "<p>x</p>" * n + "</body>")
        start = time.perf_counter()
        assert html.outline(table).count() == n + 1
        return time.perf_counter() - start

    seconds(5_000)
    # a quadratic fold would take sixteen times as long
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.5)
